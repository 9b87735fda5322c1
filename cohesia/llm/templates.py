"""Benchmark decontamination: texts become templates with typed slots, and template windows are joined by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

WINDOW = 5  # words
COVERED = 0.8  # share of an item's words that matched windows must cover
LITERALS = 2  # words of a window that are no slot, at least
BROADCAST_ROWS = 1_000_000  # item windows up to which they are sent to every task; beyond, both sides are shuffled

# Units of measure after a number: fixed values.
UNITS = "mm|cm|dm|m|km|in|ft|yd|mi|mg|g|kg|t|lb|lbs|oz|ml|cl|dl|l|s|sec|seconds|min|minutes|h|hr|hours|days|weeks|months|years|percent|dollars|euros|cents|usd|eur|gbp|meters|metres|kilometers|kilometres|miles|feet|inches|grams|kilograms|pounds|liters|litres|degrees|hz|khz|mhz|ghz|w|kw|v|a|pa|kpa|kb|mb|gb|tb"
NAME = r"(?<![\p{L}\p{M}])[\p{Ll}\p{M}]*+\p{Lu}[\p{L}\p{M}]*+"  # a word with a capital, wherever it stands
INSIDE = r"(?<=[\p{Ll}\p{Nd},;]\x20)[\p{Ll}\p{M}]*+\p{Lu}[\p{L}\p{M}]*+"  # one that starts no sentence, line or quote
NUMBER = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
TOKEN = rf"{NUMBER}|[\p{{L}}\p{{M}}]+"


def canonical(df: DataFrame, names: bool = True, out: str = "words") -> DataFrame:
    """Adds words, the template of text: lower case, no punctuation, a slot word for each name, number and unit.

    Every word of `raw(text)` has exactly one word here, so slots keep their values by place. Without
    `names`, capitals make no difference. The steps are columns of their own, so that none is evaluated
    again where it is used.
    """
    t = F.regexp_replace("text", NAME, "ǂname") if names else F.col("text")
    t = F.lower(F.regexp_replace(t, NUMBER, " ǂnum "))
    df = df.withColumn("__t", F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}]+", " ")))
    units = F.regexp_replace("__t", rf"(?<=ǂnum\x20)(?:{UNITS})(?=\x20|$)", "ǂunit")
    df = df.withColumn("__t", F.when(F.contains("__t", F.lit("ǂnum")), units).otherwise(F.col("__t")))
    return df.withColumn(out, F.when(F.length("__t") > 0, F.split("__t", " ")).otherwise(F.array().cast("array<string>"))).drop("__t")


def _said(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def raw(text: Column) -> Column:
    return F.transform(_said(text), lambda w: F.lower(w))


def _slot(word: Column) -> Column:
    return F.startswith(word, F.lit("ǂ"))


def _hashes(words: Column, window: int) -> Column:
    """Hash of each window by place; a text shorter than a window has none."""
    n = F.size(words)
    return F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(window))))).otherwise(F.array().cast("array<long>"))


def _let(value: Column, body) -> Column:
    """body(value), with the value evaluated once; a column named inside a lambda may be again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_text(df: DataFrame, key: str, name: str) -> DataFrame:
    df = df.select(F.col(key).cast("long").alias(name), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return df.withColumn("mark", F.xxhash64("text"))


def benchmark_items(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, mark, n_words, templates, said (words as written) and kind (num, unit, name or empty) of each item.

    A word is a name wherever it has a capital, and, if it has one inside a sentence, at every place of
    the item; an item without lower-case letters shows no names.
    """
    items = canonical(canonical(_with_text(benchmark, "item_id", "item_id").distinct()), False, "plain")
    names = F.transform(F.regexp_extract_all("text", F.lit(INSIDE), F.lit(0)), lambda w: F.lower(w))
    shown = F.struct(names.alias("names"), F.col("text").rlike(r"\p{Ll}").alias("cased"))
    items = items.withColumn("said", _said(F.col("text")))
    slot = lambda w, i, s: F.when(F.get("plain", i) == "ǂnum", "num").when(F.get("plain", i) == "ǂunit", "unit").when(s["cased"] & (w.rlike(r"\p{Lu}") | F.array_contains(s["names"], F.lower(w))), "name").otherwise("")
    kind = _let(shown, lambda s: F.transform("said", lambda w, i: slot(w, i, s)))
    return items.select("item_id", "mark", "words", "plain", F.size("said").alias("n_words"), "said", kind.alias("kind")).where("n_words > 0")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, mark, place, hash and size (0: template) of the windows by which items are found.

    These are the template windows, with and without slots for names, that have at least LITERALS plain
    words; windows with fewer plain words, and items under `window` words as a whole, by their values.
    """
    rich = lambda words: F.size(F.filter(F.slice(words, F.col("place") + 1, F.lit(window)), lambda w: ~_slot(w))) >= LITERALS
    found = []
    for words in ("words", "plain"):
        at = items.select("item_id", "mark", words, F.posexplode(_hashes(F.col(words), window)).alias("place", "hash"))
        found.append(at.where(rich(words)).select("item_id", "mark", "place", "hash", F.lit(0).alias("size")))
    values = items.withColumn("values", F.transform("said", lambda w: F.lower(w)))
    dense = values.select("item_id", "mark", "plain", F.posexplode(_hashes(F.col("values"), window)).alias("place", "hash"))
    found.append(dense.where(~rich("plain")).select("item_id", "mark", "place", "hash", F.lit(window).alias("size")))
    short = values.where(F.col("n_words") < window)
    found.append(short.select("item_id", "mark", F.lit(0).alias("place"), F.xxhash64("values").alias("hash"), F.col("n_words").alias("size")))
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out.distinct()


def _aligned(met: DataFrame, window: int, bare: Column) -> DataFrame:
    """Adds spots, the item's covered places on this diagonal, n_slots and same.

    met has the item's said and kind, and own, the document's words beside them (null outside of it). A
    place matches if the words are equal without case, or if both are values of one kind of slot: two
    numbers, two units, or a name and a word with a capital (any word where the document has no capitals).
    Items found by their values only (`bare`) need equal words.
    """
    low = lambda name, i: F.lower(F.get(name, i))
    number = lambda w: w.rlike(r"^\p{Nd}")
    cased = F.exists("own", lambda w: F.coalesce(w.rlike(r"\p{Lu}"), F.lit(False)))
    unit = lambda w, i: F.lower(w).rlike(f"^(?:{UNITS})$") & F.coalesce(number(F.get("own", i - 1)), F.lit(False))
    alike = lambda w, i, c: F.when(F.get("kind", i) == "num", number(w)).when(F.get("kind", i) == "unit", unit(w, i)).when(F.get("kind", i) == "name", ~number(w) & (~c | w.rlike(r"\p{Lu}"))).otherwise(False)
    equal = F.transform("own", lambda w, i: F.coalesce(F.lower(w) == low("said", i), F.lit(False)))
    fits = _let(cased, lambda c: F.transform("own", lambda w, i: F.coalesce((F.lower(w) == low("said", i)) | (~bare & alike(w, i, c)), F.lit(False))))
    width = F.least(F.lit(window), F.col("n_words"))

    def places(marks: Column) -> Column:
        starts = lambda m: F.filter(F.sequence(F.lit(0), F.col("n_words") - width), lambda i: F.forall(F.slice(m, i + 1, width), lambda x: x))
        return F.array_distinct(F.flatten(F.transform(_let(marks, starts), lambda i: F.sequence(i, i + width - 1))))

    def placed(marks: Column) -> Column:
        slots = lambda at: F.filter(at, lambda i: F.get("kind", i) != "")
        pairs = lambda at: F.array_distinct(F.transform(slots(at), lambda i: F.struct(low("said", i).alias("said"), low("own", i).alias("own"))))
        return _let(places(marks), lambda at: F.struct(at.alias("spots"), pairs(at).alias("pairs")))

    count = lambda p, field: F.size(F.array_distinct(F.transform(p["pairs"], lambda s: s[field])))
    one = lambda p: (count(p, "said") == F.size(p["pairs"])) & (count(p, "own") == F.size(p["pairs"]))
    # Slots that are not one-to-one: only windows of equal words count.
    met = met.withColumn("r", _let(placed(fits), lambda p: F.when(one(p), p).otherwise(placed(equal))))
    same = F.forall("r.pairs", lambda p: p["said"] == p["own"])
    return met.select("*", "r.spots", F.size("r.pairs").alias("n_slots"), same.alias("same"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, coverage, n_slots, literal) of every pair where the document holds the benchmark item.

    Coverage is the share of the item's words inside matched windows. Windows count along one diagonal
    (document place minus item place) at a time, and only if the diagonal's slots are consistent: a value
    of the item always meets the same value of the document, and the other way round; otherwise windows of
    equal words count. So a question with other numbers or names is caught, and chance mixtures of slots
    are not; `literal` tells that diagonals whose slots all kept their values suffice. An item under `window` words is held by a
    text with all its words in order. Null and empty texts match nothing. Repeated rows and ties give one
    row a pair; other columns are ignored; an empty side gives no rows.

    Each document's distinct window hashes are joined with the items' (sent to all tasks only up to
    BROADCAST_ROWS); every diagonal with one hit is aligned word by word.
    """
    items = saved(benchmark_items(benchmark, window), "items")
    windows = saved(item_windows(items, window), "windows")
    few = windows.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    sizes = sorted(r["size"] for r in windows.select("size").where("size > 0").distinct().collect())  # at most `window`
    hashes = windows.select("hash").distinct()

    def families(df: DataFrame) -> tuple[DataFrame, list[Column]]:
        df = canonical(canonical(df), False, "plain")
        df = df.withColumn("values", raw(F.col("text"))) if sizes else df
        return df, [_hashes(F.col("words"), window), _hashes(F.col("plain"), window), *[_hashes(F.col("values"), s) for s in sizes]]

    texts = _with_text(docs, "doc_id", "doc_id")
    seen, hashed = families(texts)
    seen = seen.select("doc_id", "mark", F.explode(F.array_distinct(F.concat(*hashed))).alias("hash"))
    # Hits only: each document's hits go on, whatever its length.
    hits = saved(seen.join(small(hashes), "hash", "left_semi").select("doc_id", "mark").distinct(), "hits")
    held = saved(texts.join(hits, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"]), "held")
    spots, hashed = families(held)
    spots = spots.select("doc_id", "mark", F.explode(F.array(*hashed)).alias("f")).select("doc_id", "mark", F.posexplode("f").alias("at", "hash"))
    near = spots.join(small(windows.withColumnRenamed("mark", "item_mark")), "hash")
    near = saved(near.groupBy("doc_id", "mark", "item_id", "item_mark", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.max("size").alias("size"), F.min("size").alias("least")), "near")

    met = near.join(held.withColumn("all", _said(F.col("text"))).drop("text"), ["doc_id", "mark"])
    what = items.select("item_id", F.col("mark").alias("item_mark"), "n_words", "said", "kind")
    met = met.join(small(what), ["item_id", "item_mark"])
    own = F.transform(F.sequence(F.lit(0), F.col("n_words") - 1), lambda k: F.get("all", F.col("diagonal") + k))
    met = _aligned(met.withColumn("own", own).drop("all"), window, F.col("least") > 0)
    words = met.select("doc_id", "item_id", "item_mark", "n_words", "n_slots", "same", F.explode("spots").alias("word"))
    out = words.groupBy("doc_id", "item_id", "item_mark", "n_words").agg(F.countDistinct("word").alias("covered"), F.max("n_slots").alias("n_slots"), F.countDistinct(F.when(F.col("same"), F.col("word"))).alias("kept"))
    out = out.withColumn("same", F.col("kept") >= covered * F.col("n_words"))
    out = out.where(F.col("covered") >= covered * F.col("n_words")).groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("covered") / F.col("n_words")).alias("coverage"), F.col("n_slots").cast("long").alias("n_slots"), F.col("same").alias("literal"))).alias("r"))
    return out.select("doc_id", "item_id", "r.coverage", "r.n_slots", "r.literal")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    bad = contaminated(docs, benchmark, window, covered).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
