"""Mixing sources to target weights by Pfair scheduling: windows for every block, earliest deadline first.

A source's documents, in an order of their hashes, are cut into blocks of about BLOCK_CHARS characters.
With p(s) the weight of source s in blocks a round, a round has p(s) blocks of each source that has as
many left, or what it has left. Inside a round of L slots, block k (from 1) of a source with q blocks has
the release floor((k - 1) * L / q) and the deadline ceil(k * L / q), and every slot goes to the released
block of earliest deadline (ties: first source in name order). Unit blocks with such windows always fit,
so each source stays less than one block from its fluid share at every slot, and exactly on it at the end
of a round. When a source ends, the others go on in their proportions; no row is dropped or repeated.

Rounds of equal quotas share one schedule: with S sources there are at most 2 * S + 1 kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BLOCK_CHARS = 65_536
ROUND_BLOCKS = 400  # blocks of a round over all sources, about
CHUNK_ROWS = 50_000  # rows of a source that one task orders, about
LEAST_CHUNKS = 64


def temperature_weights(docs: DataFrame, exponent: float = 0.5) -> DataFrame:
    """(source, weight): characters of the source to the power `exponent`."""
    return docs.groupBy("source").agg(F.pow(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1), F.lit(exponent)).alias("weight"))


def _key():
    """Null and empty sources stay apart."""
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string"))).alias("__s")


def blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """Rows with __s (source key), block (from 0) and place (characters into it), and the sources' block counts.

    A source's rows are split by hash into chunks that tasks order on their own; chunk totals give the offsets.
    """
    size = F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1
    rows = docs.withColumn("__s", _key()).withColumn("__size", size).withColumn("__h", F.xxhash64("doc_id", "text"))
    largest = docs.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    chunks = max(LEAST_CHUNKS, -(-largest // CHUNK_ROWS))
    rows = rows.withColumn("__c", F.pmod("__h", F.lit(chunks)))
    totals = saved(rows.groupBy("__s", "__c").agg(F.sum("__size").alias("n")), "chunks")
    before = Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)  # at most `chunks` rows a source
    offsets = totals.select("__s", "__c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o"))
    sources = totals.groupBy("__s").agg(F.ceil(F.sum("n") / block_chars).cast("long").alias("n"))
    inner = Window.partitionBy("__s", "__c").orderBy("__h", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__b", F.coalesce(F.sum("__size").over(inner), F.lit(0))).join(F.broadcast(offsets) if chunks == LEAST_CHUNKS else offsets, ["__s", "__c"])
    at = F.col("__b") + F.col("__o")
    rows = rows.withColumn("block", F.floor(at / block_chars).cast("long")).withColumn("place", at - F.col("block") * block_chars)
    return rows.drop("__size", "__h", "__c", "__b", "__o"), sources


def schedule(sources: DataFrame, weights: DataFrame, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """One row for each kind of round, source and block: its slot, and what places the rounds of the kind.

    `sources` has __s and n, `weights` source and weight; a source without a positive weight gets one
    block a round. Columns: first and last round of the kind (last exclusive), slots before the first
    (base), slots a round (size), __s, k (from 1), p, release, deadline and slot inside the round.
    Everything here is bounded by the number of sources and round_blocks, not by rows.
    """
    w = weights.select(_key(), "weight").groupBy("__s").agg(F.max(F.when(F.col("weight") > 0, F.col("weight").cast("double"))).alias("w"))
    known = sources.join(F.broadcast(w), "__s", "left").select("__s", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    one = known.agg(F.array_sort(F.collect_list(F.struct("__s", "n", "w"))).alias("all"), F.sum("w").alias("total"))
    p = lambda s: F.greatest(F.lit(1), F.round(s["w"] / F.col("total") * round_blocks)).cast("long")
    one = one.select(F.transform("all", lambda s: F.struct(s["__s"].alias("s"), s["n"].alias("n"), F.coalesce(p(s), F.lit(1)).alias("p"))).alias("all"))
    cuts = F.flatten(F.transform("all", lambda s: F.array(F.lit(0).cast("long"), F.floor(s["n"] / s["p"]), F.ceil(s["n"] / s["p"]))))
    one = one.withColumn("cuts", F.array_sort(F.array_distinct(cuts)))
    kinds = one.select("all", "cuts", F.posexplode(F.slice("cuts", F.lit(1), F.greatest(F.size("cuts") - 1, F.lit(0)))).alias("j", "first")).withColumn("last", F.get("cuts", F.col("j") + 1))
    left = lambda s: F.least(s["p"], s["n"] - F.col("first") * s["p"])
    kinds = kinds.withColumn("quota", F.filter(F.transform("all", lambda s: F.struct(s["s"].alias("s"), s["p"].alias("p"), left(s).alias("q"))), lambda s: s["q"] > 0))
    kinds = kinds.withColumn("size", F.aggregate("quota", F.lit(0).cast("long"), lambda acc, s: acc + s["q"]))
    order = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each kind of round
    kinds = kinds.withColumn("base", F.coalesce(F.sum((F.col("last") - F.col("first")) * F.col("size")).over(order), F.lit(0))).drop("all", "cuts", "j")
    kinds = kinds.withColumn("spots", F.sequence(F.lit(0), F.size("quota") - 1))

    # One slot after another; `done` counts the scheduled blocks of each source. The winner sits in an
    # array of one, so that it is computed once and then used twice.
    def slot(acc, t):
        def bid(i):
            q, k = F.get("quota", i)["q"], F.get(acc["done"], i)
            open_ = (k < q) & (F.floor(k * F.col("size") / q) <= t)
            return F.when(open_, F.struct(F.ceil((k + 1) * F.col("size") / q).alias("deadline"), i.alias("i"), (k + 1).alias("k")))

        won = F.array(F.array_min(F.transform("spots", bid)))
        step = lambda w: F.struct(F.transform(acc["done"], lambda k, i: F.when(i == w["i"], k + 1).otherwise(k)).alias("done"), F.concat(acc["out"], F.array(w)).alias("out"))
        return F.get(F.transform(won, step), F.lit(0))

    zero = F.struct(F.transform("quota", lambda s: F.lit(0).cast("long")).alias("done"), F.array().cast("array<struct<deadline:bigint,i:int,k:bigint>>").alias("out"))
    kinds = kinds.withColumn("given", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), zero, slot)["out"])
    flat = kinds.select("first", "last", "base", "size", "quota", F.posexplode("given").alias("slot", "g"))
    own = F.get("quota", F.col("g.i"))
    return flat.select("first", "last", "base", "size", own["s"].alias("__s"), own["p"].alias("p"), F.col("g.k").alias("k"), F.floor((F.col("g.k") - 1) * F.col("size") / own["q"]).alias("release"), F.col("g.deadline").alias("deadline"), F.col("slot").cast("long").alias("slot"))


def mix_sources(docs: DataFrame, weights: DataFrame, block_chars: int = BLOCK_CHARS, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """The rows of docs with block, release, deadline, slot and place: sorted by (slot, place) they are mixed.

    `docs` needs doc_id, text and source; its columns of those five names are replaced, others kept.
    Null sources are a source of their own, null texts count as empty, repeated rows follow each other,
    an empty table gives no rows. Sources that `weights` lacks get one block a round.
    """
    new = ["block", "release", "deadline", "slot", "place"]
    rows, sources = blocks(docs.drop(*new), block_chars)
    plan = saved(schedule(saved(sources, "sources"), weights, round_blocks), "schedule")
    shares = plan.groupBy("__s").agg(F.max("p").alias("__p"))
    kinds = plan.groupBy("__s", "first", "last").agg(F.max("k").alias("n"))
    rows = rows.join(F.broadcast(shares), "__s").withColumn("__i", F.floor(F.col("block") / F.col("__p"))).withColumn("__k", F.col("block") - F.col("__i") * F.col("__p") + 1)
    # A source's kinds of round as one short array: at most 2 * S + 1.
    spans = kinds.groupBy("__s").agg(F.array_sort(F.collect_list("first")).alias("__f"))
    rows = rows.join(F.broadcast(spans), "__s").withColumn("__first", F.array_max(F.filter("__f", lambda f: f <= F.col("__i"))))
    at = plan.select("__s", F.col("first").alias("__first"), F.col("k").alias("__k"), "base", "size", F.col("release").alias("__r"), F.col("deadline").alias("__d"), F.col("slot").alias("__t"))
    rows = rows.join(F.broadcast(at), ["__s", "__first", "__k"])
    before = F.col("base") + (F.col("__i") - F.col("__first")) * F.col("size")
    rows = rows.withColumn("release", before + F.col("__r")).withColumn("deadline", before + F.col("__d")).withColumn("slot", before + F.col("__t"))
    return rows.select(*docs.drop(*new).columns, *new)


def mixed(docs: DataFrame, weights: DataFrame | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, sorted into the mixed order."""
    rows = mix_sources(docs, temperature_weights(docs) if weights is None else weights, block_chars)
    return rows.orderBy("slot", "place", "doc_id").select(docs.columns)
