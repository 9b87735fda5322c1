"""Operators of a training-data pipeline; nothing outside this subpackage imports it."""

import cohesia
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(cohesia)  # executors need no copy of the package
