"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping, and corpus-wide link counts.

Both tokenizers cover a text's bytes, so the byte offsets at which tokens end tell which belong together.
Where both have one token after the other with the same ends, the two arrays of ends agree at a fixed
index shift; such stretches are jumped by comparing slices of doubling length and halving back at the
first difference. A group that is not one to one is walked token by token, and leaves a new shift.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

STEP_BYTES = 1 << 20  # of texts encoded in one call, about
BROADCAST_PAIRS = 500_000  # id pairs whose counts are sent to every executor; more of them are joined by a shuffle
OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")
# How the byte-level format splits a text before merging: a fixed value.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def runs(ends_a: list[int], ends_b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Spans (i, k, j, l) of tokens a[i:k] and b[j:l], in order: stretches of one-to-one groups if both are longer
    than one token and of equal length, else one group. The ends are rising and finish at the same offset."""
    i = j = 0
    n = len(ends_a)
    while i < n:
        k, l = i, j  # noqa: E741
        if ends_a[k] == ends_b[l]:
            k, l, step = k + 1, l + 1, 1  # noqa: E741
            # Exponential probing along the diagonal.
            while k < n and ends_a[k : k + step] == ends_b[l : l + step]:
                k, l, step = k + step, l + step, 2 * step  # noqa: E741
            if k >= n:
                yield i, n, j, len(ends_b)
                return
            while step > 1:  # the first difference lies within this step
                step //= 2
                if ends_a[k : k + step] == ends_b[l : l + step]:
                    k, l = k + step, l + step  # noqa: E741
            yield i, k, j, l
            i, j = k, l
        # An irregular group: the side that is behind moves on.
        x, y = ends_a[k], ends_b[l]
        while x != y:
            if x < y:
                k += 1
                x = ends_a[k]
            else:
                l += 1  # noqa: E741
                y = ends_b[l]
        yield i, k + 1, j, l + 1
        i, j = k + 1, l + 1


def _byte_characters() -> dict[str, int]:
    """The format's characters for bytes: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: ids of space + text, and the bytes of every id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in texts are plain text
        chars = _byte_characters()
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(chars[c] for c in s) if all(c in chars for c in s) else s.encode() for s in names]
        self.ranked = self._ranked()

    def _ranked(self):
        """The same vocabulary in the library that merges by rank, several times faster; None if the file is of another kind."""
        import tiktoken

        told = json.loads(self.tokenizer.to_str())
        model, split = told["model"], told["pre_tokenizer"] or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        in_order = [model["vocab"].get("".join(m)) for m in merges] == list(range(256, 256 + len(merges)))
        if told["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or not in_order:
            return None
        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={self.bytes[i]: i for i in range(256 + len(merges))}, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        """Ranks for texts of Latin letters and common signs, whose classes all libraries agree on; the file's own library else."""
        easy = [self.ranked is not None and not OTHER.search(t) for t in texts]
        hard = iter(self.tokenizer.encode_batch_fast([" " + t for t, e in zip(texts, easy) if not e], add_special_tokens=False))
        return [self.ranked.encode_ordinary(" " + t) if e else next(hard).ids for t, e in zip(texts, easy)]


class Pieces:
    """Tokenizer B: ids of a text, to which it adds the space itself, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [(i, self.processor.id_to_piece(i)) for i in range(self.processor.get_piece_size())]
        self.bytes = [bytes([int(s[3:-1], 16)]) if self.processor.is_byte(i) else s.replace("▁", " ").encode() for i, s in names]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


class Pair:
    """Ids of whole texts under both tokenizers, with the sizes of their tokens in bytes."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = [[len(x) for x in t.bytes] for t in (self.a, self.b)]

    def __call__(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Both id lists of each text; None for a text that is empty or not spelled exactly by both."""
        out = []
        for text, ids_a, ids_b in zip(texts, self.a(texts), self.b(texts)):
            raw = b" " + text.encode()
            fits = text and b"".join(map(self.a.bytes.__getitem__, ids_a)) == raw and b"".join(map(self.b.bytes.__getitem__, ids_b)) == raw
            out.append((ids_a, ids_b) if fits else None)
        return out


def pair(path_a: str, path_b: str) -> Pair:
    """One pair for all tasks of a Python worker."""
    held = sys.modules.setdefault("cohesia_pairs", types.ModuleType("cohesia_pairs"))
    key = f"{path_a}|{path_b}"
    if not hasattr(held, key):
        setattr(held, key, Pair(path_a, path_b))
    return getattr(held, key)


NAMES = [str(i) for i in range(1 << 16)]


def _names(ids: list[int]) -> list[str]:
    return [NAMES[i] for i in ids] if max(ids, default=0) < len(NAMES) else list(map(str, ids))


def align(ids_a: list[int], ids_b: list[int], ends_a: list[int], ends_b: list[int]) -> tuple[int, str, list[int], list[int]]:
    """Number of groups, their text `a1,a2|b1;a3|b2,b3`, and the A and B ids of the links: tokens that end together.

    No token is empty, so a group's only link is that of its last two tokens.
    """
    told, link_a, link_b = [], [], []
    name_a, name_b = _names(ids_a), _names(ids_b)
    for i, k, j, l in runs(ends_a, ends_b):  # noqa: E741
        if ends_a[i] == ends_b[j]:  # one to one
            if k == i + 1:
                told.append(name_a[i] + "|" + name_b[j])
                link_a.append(ids_a[i])
                link_b.append(ids_b[j])
                continue
            told += [x + "|" + y for x, y in zip(name_a[i:k], name_b[j:l])]
            link_a += ids_a[i:k]
            link_b += ids_b[j:l]
        else:
            told.append(",".join(name_a[i:k]) + "|" + ",".join(name_b[j:l]))
            link_a.append(ids_a[k - 1])
            link_b.append(ids_b[l - 1])
    return len(told), ";".join(told), link_a, link_b


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, row (a number of its own), n_a, n_b, groups (text), links (a << 32 | b, one a link) of docs(doc_id, text).

    A text that is null or empty, or that the bytes of either tokenizer's tokens do not spell with the space
    before it, has no tokens.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = pair(path_a, path_b)
        shard, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, load = start, 0
                while stop < len(texts) and (stop == start or load + len(texts[stop] or "") <= STEP_BYTES):
                    load += len(texts[stop] or "")
                    stop += 1
                part = [t or "" for t in texts[start:stop]]
                rows = []
                for ids in encode(part):
                    if ids is None:
                        rows.append((0, 0, 0, "", b""))
                        continue
                    ids_a, ids_b = ids
                    n, told, link_a, link_b = align(ids_a, ids_b, list(accumulate(map(encode.size_a.__getitem__, ids_a))), list(accumulate(map(encode.size_b.__getitem__, ids_b))))
                    links = np.array(link_a, np.int64) << 32 | np.array(link_b, np.int64)
                    rows.append((len(ids_a), len(ids_b), n, hashlib.sha256(told.encode()).hexdigest(), links))
                sizes = [len(r[4]) for r in rows]
                flat = np.concatenate([np.asarray(r[4], np.int64) if len(r[4]) else np.zeros(0, np.int64) for r in rows])
                links = pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.array(flat))
                number = lambda k: pa.array([r[k] for r in rows], pa.int64())
                yield pa.record_batch([batch.column(0).slice(start, stop - start), pa.array([shard << 33 | seq + i for i in range(len(rows))], pa.int64()), number(0), number(1), number(2), pa.array([r[3] for r in rows]), links], names=["doc_id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
                seq += len(rows)
                start = stop

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>")


def link_counts(rows: DataFrame) -> DataFrame:
    """link, n and top (n is the highest of the link's B id, ties included) over all rows(links)."""
    counts = rows.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("link").alias("n"))
    counts = saved(counts.withColumn("b", F.col("link").bitwiseAND(F.lit((1 << 32) - 1))), "counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("top"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of docs(doc_id, text).

    A is a byte-level tokenizer that encodes space + text, B a piece tokenizer that adds the space itself.
    Byte offsets where tokens of both end cut them into groups; a link is a pair of tokens that end
    together; its count is the number of links of the whole table with the same two ids. n_best counts
    links whose count is the highest of their B id, count_sum adds up the counts. Texts that are null,
    empty or not spelled exactly by both have zeros and an empty digest. Repeated rows get a row each and
    count each; a null doc_id is kept; other columns are ignored; an empty table gives no rows.

    Texts are encoded once, into a table of links. Counts are summed in tasks before their shuffle; if at
    most `broadcast_pairs` different pairs exist, which is counted, they go to every executor, else links
    and counts meet in a shuffle. Sums of a document are formed where its links are, before their shuffle.
    """
    rows = saved(aligned(docs, path_a, path_b), "aligned")
    counts = saved(link_counts(rows), "pairs")
    counts = F.broadcast(counts) if counts.count() <= broadcast_pairs else counts.hint("merge")
    links = rows.select("row", F.explode("links").alias("link")).join(counts, "link")
    sums = links.groupBy("row").agg(F.count(F.when(F.col("top"), 1)).alias("n_best"), F.sum("n").alias("count_sum"))
    told = rows.select("doc_id", "row", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return told.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
