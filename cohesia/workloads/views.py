"""Cohort views over the given tables: the same shapes the operators expect from surface files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.joins import clip

G = "graph_id"
PATCH = 250  # vertices per surface patch (10 rows of 25)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


# ---- trade: one weighted graph of nations per order year ---------------------------------------


def _trade_lines(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("string").alias(G))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("cn"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("sn"))
    return li.join(o, li.l_orderkey == o.o_orderkey).join(c, "o_custkey").join(s, "l_suppkey")


def trade(spark, d) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). One pass over lineitem feeds both through a (year, customer, supplier nation) rollup."""
    roll = _trade_lines(spark, d).groupBy(G, "cn", "sn").agg(
        F.sum("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("l_returnflag") == "R").alias("ret")
    )
    from ..plans.lineage import cut

    roll = cut(roll)  # at most years * nations^2 rows
    edges = roll.where("cn <> sn").groupBy(G, F.least("cn", "sn").alias("src"), F.greatest("cn", "sn").alias("dst")).agg(
        (F.sum("price") / F.lit(1e6)).alias("w")
    )
    fib = roll.groupBy(G, F.col("sn").alias("node_id")).agg((F.sum("ret") / F.sum("cnt")).alias("fibrosis"))
    ids = edges.select(G, F.col("src").alias("node_id")).union(edges.select(G, "dst")).distinct()
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_regionkey").cast("long").alias("region"))
    k = F.col("node_id")
    nodes = ids.join(n, "node_id").join(fib, [G, "node_id"], "left").select(
        G, "node_id", (k % 5).cast("double").alias("x"), F.floor(k / 5).cast("double").alias("y"), F.lit(0.0).alias("z"),
        F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"), F.lit(1.0).alias("fz"),
        F.coalesce("fibrosis", F.lit(0.0)).alias("fibrosis"), ((k % 5) / 4).cast("double").alias("u"), (F.floor(k / 5) / 4).cast("double").alias("v"), "region",
    )
    return nodes, edges


def sparse_trade(spark, d) -> tuple[DataFrame, DataFrame]:
    """Trade links at or above the year's median weight."""
    nodes, edges = trade(spark, d)
    from ..plans.ordered import quantiles

    med = quantiles(edges, [G], "w", {"med": 0.5}, group_rows=25 * 24 // 2)
    return nodes, edges.join(med, G).where("w >= med").select(G, "src", "dst", "w")


# ---- parts: bipartite part-supplier graph ------------------------------------------------------


def parts(spark, d) -> tuple[DataFrame, DataFrame]:
    """One graph; suppliers carry negative ids (-1 - suppkey) so ids stay disjoint."""
    li = table(spark, d, "lineitem")
    edges = li.groupBy(F.lit("parts").alias(G), (-1 - F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")).agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )
    nodes = edges.select(G, F.col("src").alias("node_id")).union(edges.select(G, "dst")).distinct()
    return nodes, edges


def retail(spark, d) -> tuple[DataFrame, DataFrame]:
    """One sparse graph: customers - orders - (part, supplier) pairs; many components of mixed size.

    All customers are nodes. Ids: customers 2k, orders 2k + 1, pairs from 2^62 on (keys below 2^31).
    """
    o = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst"))
    pair = F.lit(1 << 62) + F.col("l_partkey") * F.lit(1 << 31) + F.col("l_suppkey")
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 2 + 1).alias("src"), pair.alias("dst"))
    edges = o.union(li).select(F.lit("retail").alias(G), "src", "dst", F.lit(1.0).alias("w"))
    c = table(spark, d, "customer").select(F.lit("retail").alias(G), (F.col("c_custkey") * 2).alias("node_id"))
    nodes = c.union(edges.select(G, "src")).union(edges.select(G, "dst")).where("node_id is not null").distinct()
    return nodes, edges


# ---- points and surface patches from embeddings ------------------------------------------------


def _dims(spark, d, n: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(n)])


def points(spark, d) -> DataFrame:
    """Per label: the first three dims min-max scaled over the whole table; fibrosis from the fourth."""
    e = _dims(spark, d, 4)
    box = e.agg(*[F.min(f"e{i}").alias(f"l{i}") for i in range(1, 5)], *[F.max(f"e{i}").alias(f"h{i}") for i in range(1, 5)])
    j = e.crossJoin(F.broadcast(box))  # one row
    s = lambda i: (F.col(f"e{i}") - F.col(f"l{i}")) / (F.col(f"h{i}") - F.col(f"l{i}"))
    return j.select(
        F.concat(F.lit("l"), F.col("label").cast("string")).alias(G), F.col("vec_id").alias("node_id"),
        s(1).alias("x"), s(2).alias("y"), s(3).alias("z"), s(1).alias("u"), s(2).alias("v"), s(4).alias("fibrosis"),
    )


def surface(spark, d) -> tuple[DataFrame, DataFrame]:
    """(nodes, faces): every embedding is a lattice vertex, 25 per row, 10 rows per patch; two triangles per cell."""
    e = _dims(spark, d, 8)
    local = F.col("vec_id") % PATCH
    gid = F.concat(F.lit("p"), F.floor(F.col("vec_id") / PATCH).cast("string"))
    nodes = e.select(
        gid.alias(G), local.alias("node_id"), F.col("e1").alias("x"), F.col("e2").alias("y"), F.col("e3").alias("z"),
        F.col("e4").alias("fx"), F.col("e5").alias("fy"), F.col("e6").alias("fz"), clip(F.lit(0.5) + F.col("e7") * 2, 0.0, 1.0).alias("fibrosis"),
        ((local % 25) / 24).cast("double").alias("u"), (F.floor(local / 25) / 9).cast("double").alias("v"), F.col("label").alias("region"), "label",
        (F.lit(1.16) + F.col("e8")).alias("intensity"),
    )
    size = nodes.groupBy(G).agg(F.max("node_id").alias("last"))
    cell = nodes.join(size, G).where("node_id % 25 < 24 and node_id + 26 <= last")
    a = F.col("node_id")
    tri = lambda t, p, q, r: F.struct((a * 2 + t).alias("face_id"), p.alias("a"), q.alias("b"), r.alias("c"))
    faces = cell.select(G, F.explode(F.array(tri(0, a, a + 1, a + 25), tri(1, a + 1, a + 26, a + 25))).alias("f"),
                        F.col("label").cast("int").alias("tag"), F.col("fx").alias("vx"), F.col("fy").alias("vy"), F.col("fz").alias("vz"))
    return nodes, faces.select(G, "f.face_id", "f.a", "f.b", "f.c", "tag", "vx", "vy", "vz")


# ---- scored documents --------------------------------------------------------------------------


def scored(spark, d) -> DataFrame:
    """Labelled documents with three scores over the whole text."""
    doc = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, d, "labels")
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    blanks = F.length("text") - F.length(F.translate("text", " ", ""))
    return doc.join(lab, "doc_id").select(
        "doc_id", "lang", "source", (1 - F.col("quality")).cast("int").alias("low"), F.col("toxic").cast("int").alias("toxic"),
        F.col("n_chars").cast("double").alias("size"), (digits / F.length("text")).alias("digit_share"), (blanks + 1).cast("double").alias("tokens"),
        (F.lit(1.0) * (blanks + 1) / F.length("text")).alias("blank_share"),
    )


# ---- traces ------------------------------------------------------------------------------------


def traces(spark, d) -> DataFrame:
    """Hourly frames per event type (run) and user (node): v is the hour's largest value."""
    e = table(spark, d, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3600000000))
    return e.groupBy(F.col("event_type").alias("run_id"), F.col("user_id").alias("node_id"), hour.cast("long").alias("frame")).agg(
        F.max("value").alias("v")
    ).withColumn("t", F.col("frame").cast("double"))


def phases(spark, d) -> DataFrame:
    """Trace values scaled to (-pi, pi] by the run maximum."""
    tr = traces(spark, d)
    top = tr.groupBy("run_id").agg(F.max("v").alias("top"))
    return tr.join(top, "run_id").select("run_id", "node_id", "frame", ((F.col("v") / F.col("top") * 2 - 1) * F.lit(3.141592653589793)).alias("theta"))


# ---- arms --------------------------------------------------------------------------------------


def verdicts(spark, d) -> DataFrame:
    """Per customer and order year: did any order carry the top priority; cohort = market segment."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cohort"), "c_acctbal")
    v = o.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("tier")).agg(
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("y"), F.avg("o_totalprice").alias("score"), F.count(F.lit(1)).alias("cnt")
    )
    return v.join(c, "o_custkey").select(F.col("o_custkey").alias("subject"), "tier", "cohort", "y", "score", "cnt", F.col("c_acctbal").alias("cov"))
