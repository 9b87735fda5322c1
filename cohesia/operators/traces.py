"""Verdict rules over stored traces: frames(run_id, node_id, frame, t, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import quantiles, running_sums

R = "run_id"


def activity(frames: DataFrame, th: float) -> DataFrame:
    """Active count and share per frame."""
    a = F.count_if(F.col("v") > th)
    return frames.groupBy(R, "frame").agg(a.alias("active"), (a / F.count(F.lit(1))).alias("share"))


def islands(flags: DataFrame, flag: str) -> DataFrame:
    """(run_id, isle, start, stop, length) of maximal stretches of frames where `flag` holds.

    A stretch is keyed by the number of earlier frames where it does not.
    """
    breaks = F.when(F.col(flag), F.lit(0)).otherwise(F.lit(1))
    num = running_sums(flags, [R], [F.col("frame")], {"isle": breaks})
    return num.where(F.col(flag)).groupBy(R, "isle").agg(F.min("frame").alias("start"), F.max("frame").alias("stop"), F.count(F.lit(1)).alias("length"))


def sustained(frames: DataFrame, th: float, last_stimulus: int, dt: float, min_window: int = 1) -> DataFrame:
    """Longest run of frames with any active node after the last stimulus, in time; NULL when the window is too short."""
    act = activity(frames.where(F.col("frame") > last_stimulus), th).withColumn("on", F.col("active") > 0)
    best = islands(act, "on").groupBy(R).agg(F.max("length").alias("longest"))
    size = act.groupBy(R).agg(F.count(F.lit(1)).alias("window"))
    j = size.join(best, R, "left")
    return j.select(R, "window", F.when(F.col("window") >= min_window, F.coalesce("longest", F.lit(0)) * F.lit(dt)).alias("sustained"))


def upcrossings(frames: DataFrame, th: float) -> DataFrame:
    """Below-to-above transitions per node with first and last crossing frame. A node's series is one trace."""
    w = Window.partitionBy(R, "node_id").orderBy("frame")
    up = (F.lag("v").over(w) <= th) & (F.col("v") > th)
    x = frames.withColumn("up", F.coalesce(up, F.lit(False)))
    return x.groupBy(R, "node_id").agg(F.count_if("up").alias("crossings"), F.min(F.when(F.col("up"), F.col("frame"))).alias("first"), F.max(F.when(F.col("up"), F.col("frame"))).alias("last"))


def reentry_verdict(frames: DataFrame, th: float, last_stimulus: int, dt: float, min_time: float, max_share: float, min_reactivating: float) -> DataFrame:
    """Sustained long enough, never fully depolarised, and enough nodes reactivating."""
    s = sustained(frames, th, last_stimulus, dt)
    a = activity(frames.where(F.col("frame") > last_stimulus), th).groupBy(R).agg(F.min("share").alias("min_share"))
    c = upcrossings(frames.where(F.col("frame") > last_stimulus), th).groupBy(R).agg(F.avg((F.col("crossings") >= 2).cast("double")).alias("reactivating"))
    j = s.join(a, R).join(c, R)
    ok = (F.col("sustained") >= min_time) & (F.col("min_share") < max_share) & (F.col("reactivating") >= min_reactivating)
    return j.select(R, "sustained", "min_share", "reactivating", F.coalesce(ok, F.lit(False)).alias("verdict"))


def sustained_until_quiet(frames: DataFrame, th: float, start: int, quiet: int, dt: float, min_share: float = 0.0) -> DataFrame:
    """Time of the last active frame before the first quiet stretch of at least `quiet` frames."""
    act = activity(frames.where(F.col("frame") >= start), th).withColumn("on", F.col("share") > min_share)
    off = islands(act.withColumn("off", ~F.col("on")), "off").where(F.col("length") >= quiet)
    stop = off.groupBy(R).agg(F.min("start").alias("stop"))
    j = act.join(stop, R, "left").where(F.col("stop").isNull() | (F.col("frame") < F.col("stop")))
    last = j.groupBy(R).agg(F.max(F.when(F.col("on"), F.col("frame"))).alias("last"))
    runs = act.select(R).distinct()
    return runs.join(last, R, "left").select(R, F.coalesce((F.col("last") - start + 1) * F.lit(dt), F.lit(0.0)).alias("sustained"))


def origins(frames: DataFrame, th: float, after: int = -1) -> DataFrame:
    """Three origin definitions among nodes active after a frame; NULL when none. Ties go to the lowest id."""
    act = frames.where((F.col("frame") > after) & (F.col("v") > th)).groupBy(R, "node_id").agg(F.count(F.lit(1)).alias("c"), F.min("frame").alias("f"), F.max("frame").alias("l"))
    o = act.groupBy(R).agg(
        F.max_by("node_id", F.struct(F.col("c"), -F.col("node_id"))).alias("longest_active"), F.min_by("node_id", F.struct("f", "node_id")).alias("first_activation"),
        F.min_by("node_id", F.struct("l", "node_id")).alias("earliest_last"),
    )
    return frames.select(R).distinct().join(o, R, "left")


def order_parameter(phases: DataFrame, settle: int = 0) -> DataFrame:
    """Modulus of the mean unit phasor per frame, averaged after `settle`."""
    c, s = F.avg(F.cos("theta")), F.avg(F.sin("theta"))
    per = phases.groupBy(R, "frame").agg(F.sqrt(c * c + s * s).alias("r"))
    return per.where(F.col("frame") >= settle).groupBy(R).agg(F.avg("r").alias("order_parameter"))


def frequencies(phases: DataFrame, dt: float) -> DataFrame:
    """Unwrapped mean frequency per node: wrapped increments summed over the elapsed steps."""
    w = Window.partitionBy(R, "node_id").orderBy("frame")
    two_pi = 6.283185307179586
    d = F.col("theta") - F.lag("theta").over(w)
    wrapped = d - F.lit(two_pi) * F.ceil((d - F.lit(two_pi / 2)) / F.lit(two_pi))
    x = phases.withColumn("d", wrapped)
    s = x.groupBy(R, "node_id").agg(F.sum("d").alias("turn"), F.count("d").alias("steps"))
    return s.where("steps > 0").select(R, "node_id", (F.col("turn") / (F.lit(dt) * F.col("steps"))).alias("freq"))


def detuning(phases: DataFrame, dt: float, slip: float, r_below: float, settle: int = 0) -> DataFrame:
    """Spread of node frequencies around the run median, slip share, desynchronisation verdict and top two nodes."""
    f = frequencies(phases, dt)
    med = quantiles(f, [R], "freq", {"med": 0.5})
    d = f.join(med, R).withColumn("dev", F.abs(F.col("freq") - F.col("med")))
    key = F.struct(F.col("dev"), -F.col("node_id"))
    s = d.groupBy(R).agg(F.max("dev").alias("max_dev"), F.avg((F.col("dev") > slip).cast("double")).alias("slip_share"), F.max_by("node_id", key).alias("top1"))
    second = d.join(s.select(R, "top1"), R).where("node_id <> top1").groupBy(R).agg(F.max_by("node_id", key).alias("top2"))
    j = s.join(second, R, "left").join(order_parameter(phases, settle), R)
    return j.withColumn("desync", (F.col("order_parameter") < r_below) & (F.col("max_dev") > slip))


def battery(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Best over attempts(keys, attempt, inducible, sustained, origin): any, longest, origin of the first inducing one."""
    first = F.min_by("origin", F.when(F.col("inducible"), F.col("attempt")))
    s = attempts.groupBy(*keys).agg(F.bool_or("inducible").alias("inducible"), F.max("sustained").alias("sustained"), first.alias("__o"))
    return s.select(*keys, "inducible", "sustained", F.when(F.col("inducible"), F.col("__o")).alias("origin"))
