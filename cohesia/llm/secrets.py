"""Secret scan: fixed patterns, then strings whose characters look random to a pair of Markov models."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

# Patterns and least lengths of the base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST = 6
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
# Possessive: a shorter match would be followed by a letter, which the look-ahead refuses.
WORD = "(?<![A-Za-z0-9+/_=-])[A-Za-z_-]{12,}+(?![A-Za-z0-9+/_=-])"
SHORT_WORD = "(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,14}+(?![A-Za-z0-9+/_=-])"
# Any base pattern, letters in either case; it is only tried at characters that one may begin with.
SECRET = "(?=[0-9A-Fa-fPpSsTt])(?:" + "|".join((ASSIGN, ACCESS, HEX)) + ")"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # 0 stands for any other character
THRESHOLD = 10.0  # log-likelihood ratio in nats above which a string is a secret, if
RATE = 0.4  # the ratio a character pair is also above this (or above what held-out ordinary strings reach)
FALSE_RATE = 0.001  # share of held-out ordinary strings that may pass
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"  # names of things, not secrets

_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _spans(text: str, kind: str, rank: int, pattern: str, needs: Column | None, keep=None) -> tuple[str, Column, Column]:
    """Column name and expression of the matches, and of their spans in code points.

    The gaps between matches come from split(); running lengths of gaps and matches are the places.
    """
    name = f"__{kind}"
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    matches = F.when(needs, found).otherwise(F.array().cast("array<string>")) if needs is not None else found
    gaps = F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(F.col(name)))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"))
        out = F.concat(acc["out"], F.array(span))
        return F.struct((start + F.length(x["hit"])).alias("at"), (out if keep is None else F.when(keep(x["hit"]), out).otherwise(acc["out"])).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    pairs = F.arrays_zip(gaps.alias("gap"), F.col(name).alias("hit"))
    spans = F.when(F.size(name) > 0, F.aggregate(pairs, zero, step)["out"]).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return name, matches, spans


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and an array of spans for each of assign, access and hex."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long_enough = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST
    kinds = [
        ("assign", 0, ASSIGN, F.contains("text", F.lit("=")) | F.contains("text", F.lit(":")), long_enough),
        ("access", 1, ACCESS, F.contains("text", F.lit("AKIA")), None),
        ("hex", 2, HEX, None, None),
    ]
    for kind, rank, pattern, needs, keep in kinds:
        name, matches, spans = _spans("text", kind, rank, pattern, needs, keep)
        rows = rows.withColumn(name, matches).withColumn(kind, spans).drop(name)
    return rows


def _identifiers(words: Column) -> Column:
    """Ordinary names out of a text's words: paths, snake, kebab and camel case, versions and dates, some with numbers."""

    def four(i):
        w = [F.lower(F.get(words, i + k)) for k in range(4)]
        return F.struct(F.array(*w).alias("w"), F.xxhash64(w[0], w[1], i).alias("h"))

    def name(x):
        w, h = [x["w"][k] for k in range(4)], x["h"]
        part = lambda bits, m, least=0: (F.pmod(F.shiftright(h, bits), F.lit(m)) + least).cast("string")
        n = part(8, 1000)
        day = F.concat(F.lit("20"), F.lpad(part(20, 40), 2, "0"), F.lit("-"), F.lpad(part(30, 12, 1), 2, "0"), F.lit("-"), F.lpad(part(40, 28, 1), 2, "0"))
        shapes = [
            F.concat_ws("_", *w), F.concat_ws("/", *w), F.concat(*map(F.initcap, w), n), F.concat_ws("-", w[0], w[1], day), F.concat_ws("/", w[0], w[1], n, w[2]),
            F.concat(F.upper(F.concat_ws("_", *w[:3])), F.lit("_"), n), F.concat(w[0], *map(F.initcap, w[1:])), F.concat(F.concat_ws("-", *w[:3]), F.lit("-v"), n), F.concat(w[0], n, F.lit("="), w[1], w[2]),
        ]
        # Branches, so that only the shape that is taken is built.
        taken = F
        for k, shape in enumerate(shapes):
            taken = taken.when(F.pmod(h, F.lit(len(shapes))) == k, shape)
        return taken

    return F.when(F.size(words) >= 8, F.transform(F.transform(F.sequence(F.lit(0), F.size(words) - 4, F.lit(8)), four), name))


def samples(docs: DataFrame) -> DataFrame:
    """Labelled strings (value, label): 1 for secrets, 0 for ordinary long words and identifiers.

    Secrets are the values that the base patterns find in any document and, as those are of few alphabets, digests
    of a quarter of the ordinary words in base64, with and without its signs. Words, and the names that are built of
    them, come from all documents, in one pass over the texts.
    """
    found = lambda pattern: F.regexp_extract_all(F.col("plain"), F.lit(pattern), F.lit(0))
    labelled = lambda values, label: F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(label).alias("label")))

    def value(s):
        hit = F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
        return F.when(s["kind"] == "assign", F.regexp_extract(hit, ASSIGN, 2)).otherwise(hit)

    # No pieces of secrets among the ordinary words.
    rows = find_base(docs).select(F.transform(F.concat("assign", "access", "hex"), value).alias("secrets"), F.regexp_replace("text", SECRET, " ").alias("plain"))
    rows = rows.select("secrets", found(SHORT_WORD).alias("words"), found(WORD).alias("long"))
    ordinary = F.concat("long", F.coalesce(_identifiers(F.col("words")), F.array().cast("array<string>")))
    each = rows.select(F.inline(F.concat(labelled(F.col("secrets"), 1), labelled(ordinary, 0))))
    digest = F.base64(F.unhex(F.sha2("value", 256)))
    at_random = F.array(digest, F.translate(digest, "+/=", ""))
    more = F.when((F.col("label") == 0) & (F.pmod(F.xxhash64("value"), F.lit(4)) == 0), labelled(at_random, 1)).otherwise(F.array().cast("array<struct<value:string,label:int>>"))
    return each.select(F.inline(F.concat(F.array(F.struct("value", "label")), more)))


def _held_out() -> Column:
    return (F.col("label") == 0) & (F.pmod(F.xxhash64("value"), F.lit(3)) == 1)


def least_rate(labelled: DataFrame, ratio: list[float]) -> float:
    """The ratio a character pair that only FALSE_RATE of the held-out ordinary strings of a candidate's length pass; RATE at least."""
    held = labelled.where(_held_out() & (F.length("value") >= 20)).select((llr(F.col("value"), ratio) / (F.length("value") - 1)).alias("rate"))
    return max(RATE, held.agg(F.percentile_approx("rate", F.lit(1 - FALSE_RATE), F.lit(10_000))).first()[0] or RATE)


def _code(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of the SIZE * SIZE character pairs, from labelled(value, label).

    Pair counts are summed by Spark; at most 2 * SIZE * SIZE of them come back. Both models are smoothed
    by half a count, so unseen pairs and missing classes have a defined ratio (no samples: all zero).
    """
    places = labelled.where((F.length("value") > 1) & ~_held_out()).select("label", "value", F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("i"))
    counts = places.groupBy("label", F.substring("value", F.col("i"), F.lit(2)).alias("pair")).count().where("length(pair) = 2")
    counts = counts.select("label", (_code(F.substring("pair", 1, 1)) * SIZE + _code(F.substring("pair", 2, 1))).alias("at"), "count").groupBy("label", "at").agg(F.sum("count").alias("n"))
    n = [[0.5] * (SIZE * SIZE) for _ in range(2)]
    for label, at, count in counts.collect():  # at most 2 * SIZE * SIZE rows
        n[label][at] += count
    ratio = []
    for a in range(SIZE):
        total = [sum(m[a * SIZE : (a + 1) * SIZE]) for m in n]
        ratio += [math.log(n[1][a * SIZE + b] / total[1]) - math.log(n[0][a * SIZE + b] / total[0]) for b in range(SIZE)]
    return ratio


def llr(value: Column, ratio: list[float]) -> Column:
    """Sum of the pair ratios of a string."""
    table = F.from_json(F.lit(json.dumps(ratio)), "array<double>")
    at = lambda i: _code(F.substring(value, i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, at(i) * SIZE + at(i + 1)))


def scan(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_model for every row of docs(doc_id, text).

    Base spans are leftmost and do not overlap within a kind. The model adds runs of CANDIDATE characters
    with a digit and a letter, no UUIDs, that no base span touches and whose ratio passes the threshold in sum and
    `rate` a character pair. Null and
    empty texts have no spans (and the digest of an empty string); repeated rows get a row each; spans of
    equal start go by kind; other columns are ignored. One pass over the texts, no shuffle.
    """
    rows = find_base(docs)
    name, matches, spans = _spans("text", "model", 3, CANDIDATE, None, lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & ~hit.rlike(UUID))
    rows = rows.withColumn(name, matches).withColumn("model", spans).drop(name)
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    free = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    least = lambda m: F.greatest(F.lit(threshold), F.lit(rate) * (m["end"] - m["start"] - 1))
    random = lambda m: llr(F.substring(F.col("text"), m["start"] + 1, m["end"] - m["start"]), ratio) > least(m)
    rows = rows.withColumn("model", F.filter("model", lambda m: free(m) & random(m)))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    long = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return rows.select("doc_id", long("assign"), long("access"), long("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "model"))).alias("spans"), long("model"))


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """scan() with models trained on the documents' own labelled samples, and the rate that held-out ones allow."""
    labelled = saved(samples(docs), "samples")
    ratio = train(labelled)
    return scan(docs, ratio, threshold, least_rate(labelled, ratio))
