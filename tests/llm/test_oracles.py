"""The registered queries against their SQL, and the SQL of quotes on messages that quote."""

import duckdb
import pytest

from cohesia.llm import oracles, queries, quotes
from compare import connect, difference

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, D).toPandas()
    assert difference(got, connect(D).execute(queries.ORACLES[name]).df()) is None


def test_quotes_sql(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\n\nAlso, how do I\nreverse it?"), (1, 1, "assistant", "> Also, how do I\n> REVERSE it?\nUse reversed(x)."),
        (1, 2, "user", ">> Also, how do I\n> Use reversed(x).\n\nThat returns an iterator."), (1, 3, "user", "Someone wrote:\n>That returns an iterator.\nYes, it does."),
        (1, 4, "user", "> Yes, it does.\n> How do I sort a list?\nOk > fine."), (2, 0, "user", "> How do I sort a list?\nno"), (2, 1, None, ""), (2, 2, "user", "\n\n  no quote  \n"),
    ]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.link_quotes(conversations).fillna(-1, ["parent_turn"]).toPandas()
    con = duckdb.connect()
    con.register("conversations", conversations.toPandas())
    assert difference(got, con.execute(oracles.QUOTES).df()) is None
    assert (got.parent_turn >= 0).sum() == 4
