"""Chat formatting by quotation linking: quotes point to the messages they come from, and leave the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

WORD = r"[\p{L}\p{Nd}]"  # a unit that may link has one
SENTENCE = r"(?<=[.!?…][\"')\]]?)\x20|(?<=[。！？])"  # what parts the sentences of a normalised paragraph
QUOTE = r"^\x20{0,3}(?:>\x20?)+"


def _normal(c):
    """Lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, the text without quotes, and its quoted passages (level, body) in order.

    A line's level is the number of `>` that it starts with; neighbouring lines of one level are a passage.
    A line that announces a quote ("... wrote:") directly before one goes with it.
    """
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\r\n|\n|\r", -1)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), lines.alias("line"))
    mark = lambda x: F.regexp_extract(x, QUOTE, 0)
    level = lambda x: F.length(F.regexp_replace(mark(x), "[^>]", ""))
    rows = rows.withColumn("line", F.transform("line", lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("body"))))
    intro = lambda x, i: (x["level"] == 0) & x["body"].rlike(r"\bwrote:\s*$") & (F.coalesce(F.get("line", i + 1)["level"], F.lit(0)) > 0)
    rows = rows.withColumn("own", F.filter("line", lambda x, i: (x["level"] == 0) & ~intro(x, i)))
    text = F.regexp_replace(F.array_join(F.transform("own", lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")
    # A passage starts where the level changes; its lines run to the next start.
    starts = F.filter(F.sequence(F.lit(0), F.size("line") - 1), lambda i: (F.get("line", i)["level"] > 0) & ((i == 0) | (F.get("line", i)["level"] != F.coalesce(F.get("line", i - 1)["level"], F.lit(-1)))))
    rows = rows.withColumn("starts", F.when(F.exists("line", lambda x: x["level"] > 0), starts).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("ends", F.filter(F.sequence(F.lit(0), F.size("line") - 1), lambda i: (F.get("line", i)["level"] > 0) & (F.coalesce(F.get("line", i + 1)["level"], F.lit(-1)) != F.get("line", i)["level"])))
    passage = lambda s, j: F.struct(F.get("line", s)["level"].alias("level"), F.transform(F.slice("line", s + 1, F.get("ends", j) - s + 1), lambda x: x["body"]).alias("body"))
    return rows.select("conv_id", "turn", "role", text.alias("text"), F.transform("starts", passage).alias("quotes"))


def _units(text, lines):
    """Hashes, with lengths, of a text as a whole and of its paragraphs, lines and sentences."""
    paragraphs = F.transform(F.split(text, r"\n\s*\n"), _normal)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE)))
    parts = F.array_distinct(F.filter(F.concat(F.array(_normal(text)), paragraphs, F.transform(lines, _normal), sentences), lambda u: u.rlike(WORD)))
    return F.transform(parts, lambda u: F.struct(F.xxhash64(u).alias("hash"), F.length(u).alias("chars")))


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message of messages(conv_id, turn, role, text): conv_id, turn, role, text (without quotes),
    n_quotes, max_level, parent_turn, thread (first turn of its reply tree) and depth.

    A quoted passage is looked up, as a whole and by its paragraphs, lines and sentences, among those of
    earlier messages of the conversation. The parent is the message with most characters matched by the
    shallowest linked quotes; on a tie the one that had most of them first, then the latest. Messages of
    equal text count as the earliest, and only units that are quoted are joined, so common ones stay few.
    A message without a linked quote starts a thread. Parents
    have smaller turns, so (conv_id, thread, turn) is a reply order. Null and empty texts have no quotes;
    null conv_id or turn: no links; rows of equal (conv_id, turn) share their links; other columns are
    ignored; an empty table gives no rows.
    """
    rows = saved(parsed(messages), "messages")
    units = rows.select("conv_id", "turn", F.xxhash64("text").alias("mark"), F.explode(_units(F.col("text"), F.split("text", "\n"))).alias("u"))
    units = units.select("conv_id", "turn", "mark", F.col("u.hash").alias("hash"))
    quoted = rows.where(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("no", "q"))
    asked = quoted.select("conv_id", "turn", F.col("q.level").alias("level"), F.explode(_units(F.array_join("q.body", "\n"), F.col("q.body"))).alias("u"))
    asked = saved(asked.select("conv_id", "turn", "level", F.col("u.hash").alias("hash"), F.col("u.chars").alias("chars")), "asked")
    on = ["conv_id", "hash"]
    owners = units.join(asked.select(on).distinct(), on, "left_semi").groupBy(*on, "mark").agg(F.min("turn").alias("owner"))
    owners = saved(owners.drop("mark"), "owners")
    owners = owners.join(owners.groupBy(*on).agg(F.min("owner").alias("first")), on)
    hits = asked.join(owners, on).where("owner < turn").groupBy("conv_id", "turn", "level", "owner").agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("owner") == F.col("first"), F.col("chars")).otherwise(0)).alias("early"))
    parents = hits.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), F.col("chars"), F.col("early"), F.col("owner"))).getField("owner").alias("parent_turn"))
    parents = saved(parents, "parents")

    # Pointer jumping: about log2 of the deepest chain of quotes.
    state = parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth"))
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        jumped = saved(state.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads")
        state = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    out = rows.join(parents, ["conv_id", "turn"], "left").join(state, ["conv_id", "turn"], "left")
    top = F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).cast("long")
    return out.select("conv_id", "turn", "role", "text", F.size("quotes").cast("long").alias("n_quotes"), top.alias("max_level"), "parent_turn", F.coalesce("up", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))


def conversations(messages: DataFrame) -> DataFrame:
    """The linked messages, sorted so that each conversation reads thread by thread in reply order."""
    return link_quotes(messages).orderBy("conv_id", "thread", "turn")
