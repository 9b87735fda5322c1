"""Token ids as length-delimited binary records with a separate offset index.

A record is framed as: payload length (8 bytes), masked checksum of the length (4), payload, masked
checksum of the payload (4), all little-endian. The payload is the document's ids as unsigned integers
of 2 bytes if the tokenizer has at most 65,536 ids, else 4 bytes. The checksum is crc32; the mask rotates it right by 15 bits and adds 0xa282ead8, so that
checksums stored next to checksummed data stay distinct.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import scratch_path, width

SHARD_CHARS = 32 << 20  # text in a record file, about; files stay well below an executor's memory
CACHE_PIECES = 1_200_000
LONGEST_CACHED = 64
HEAD = "<QI"
# Characters outside the range where lower-casing and NFC change nothing else, and punctuation (no
# apostrophe, no underscore) between such a letter or digit and the end of a word.
OTHER = re.compile("[^\x00-\u012f\u0131-\u024f]")
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
ENDING = re.compile(r"([!-&(-/:-@\[-^`{-~](?<=[0-9a-zß-öø-ɏ][!-&(-/:-@\[-^`{-~])[!-&(-/:-@\[-^`{-~]*+)(?=[ \t\n\r0-9a-zß-öø-ɏ]|\Z)")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


class Encoder:
    """Ids of whole texts as little-endian bytes, `width` bytes an id.

    The tokenizer never joins text across white space, so a text's ids are those of its space-separated
    pieces. If it also lower-cases and splits letters from punctuation, texts of plain letters are
    lower-cased and split so before, which leaves fewer different pieces. Pieces met before are looked
    up; new ones go through the library, for many texts in one call.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.end = b"" if end_id is None else end_id.to_bytes(self.width, "little")
        told = json.loads(self.tokenizer.to_str())
        split = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        self.plain = "Lowercase" in json.dumps(told["normalizer"]) and split in json.dumps(told["pre_tokenizer"])
        # Lower-case Latin letters pass the normaliser unchanged and are one pre-token: the model alone does for them.
        self.letters = None
        if self.plain and told["pre_tokenizer"]["type"] == "Sequence":
            bare = told | {"normalizer": None, "pre_tokenizer": told["pre_tokenizer"]["pretokenizers"][-1]}
            self.letters = Tokenizer.from_str(json.dumps(bare)) if bare["pre_tokenizer"]["type"] == "ByteLevel" else None
        self.known: dict[str, bytes] = {"": b""}

    def _pieces(self, text: str | None) -> list[str]:
        text = text or ""
        if self.plain and (text.isascii() or not OTHER.search(text)) and "<|" not in text:
            text = ENDING.sub(r" \1 ", text.lower())
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        if len(self.known) > CACHE_PIECES:
            self.known = {"": b""}
        rows = [self._pieces(t) for t in texts]
        known = self.known
        new = list(set().union(*rows).difference(known))  # looks up the pieces; `- known.keys()` would walk all of known
        easy = [p for p in new if LETTERS.fullmatch(p)] if self.letters else []
        hard = list(set(new).difference(easy)) if easy else new
        for tokenizer, todo in ((self.letters, easy), (self.tokenizer, hard)):
            for a in range(0, len(todo), 20_000):
                part = todo[a : a + 20_000]
                ids = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                flat = np.fromiter(itertools.chain.from_iterable(ids), f"<u{self.width}").tobytes()
                ends = list(itertools.accumulate(self.width * len(i) for i in ids))
                known.update(zip(part, [flat[x:y] for x, y in zip([0, *ends], ends)]))
        out = [b"".join(map(known.__getitem__, row)) + self.end for row in rows]
        for p in new:
            if len(p) > LONGEST_CACHED:
                del known[p]
        return out


def encoder(path: str, end_id: int | None) -> Encoder:
    """One encoder for all tasks of a Python worker, so that its pieces are learned once."""
    held = sys.modules.setdefault("cohesia_encoders", types.ModuleType("cohesia_encoders"))
    key = f"{path}|{end_id}"
    if not hasattr(held, key):
        setattr(held, key, Encoder(path, end_id))
    return getattr(held, key)


def write_records(docs: DataFrame, tokenizer: str, end_id: int | None = 2, order: Sequence[str] = ("doc_id",), label: str = "records") -> tuple[str, DataFrame]:
    """Write every text's ids in ascending `order` (null keys first, ties by text); returns (folder, index).

    `docs` needs doc_id, text and the order columns; other columns are ignored. A null or empty text is
    a record of the end id alone; an empty table gives an empty index. Rows are dealt by range of the
    order, so file n holds records before those of file n + 1. The index (also a Parquet table under the
    folder) has shard, seq, doc_id, file, offset, length and the width of an id in bytes. A file's name is unique to the attempt that
    wrote it and only the index names it, so retried tasks leave no double records.
    """
    spark = docs.sparkSession
    base = scratch_path(spark, label)
    rows = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(order)], F.col("doc_id"), F.col("text").cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(width(spark), chars // SHARD_CHARS + 1)
    keys = [f"__k{i}" for i in range(len(order))]
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "text").select("doc_id", "text")
    kind = dealt.schema["doc_id"].dataType.simpleString()

    def write(batches):
        from pyarrow import fs

        encode = encoder(tokenizer, end_id)
        shard, name, stream, at, seq = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.rec", None, 0, 0
        store, folder = fs.FileSystem.from_uri(base)
        for b in batches:
            sizes, starts = [], []
            if b.num_rows and stream is None:
                store.create_dir(folder, recursive=True)
                stream = store.open_output_stream(f"{folder}/{name}")
            for s in range(0, b.num_rows, 256):
                out = []
                for payload in encode(b.column(1).slice(s, 256).to_pylist()):
                    record = frame(payload)
                    out.append(record)
                    sizes.append(len(payload))
                    starts.append(at)
                    at += len(record)
                stream.write(b"".join(out))
            m = b.num_rows
            yield pa.record_batch([pa.array([shard] * m, pa.int32()), pa.array(range(seq, seq + m), pa.int64()), b.column(0), pa.array([name] * m, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([encode.width] * m, pa.int32())], names=["shard", "seq", "doc_id", "file", "offset", "length", "width"])
            seq += m
        if stream is not None:
            stream.close()

    path = f"{base}/index"
    dealt.mapInArrow(write, f"shard int, seq long, doc_id {kind}, file string, offset long, length long, width int").write.parquet(path)
    return base, spark.read.parquet(path)


def records(stream, where: str = "") -> Iterator[bytes]:
    """Payloads of a record file from its start; raises on a checksum that does not match."""
    while head := stream.read(struct.calcsize(HEAD)):
        size, check = struct.unpack(HEAD, head)
        if masked(head[:8]) != check:
            raise ValueError(f"damaged length in {where}")
        payload = stream.read(size)
        if len(payload) != size or masked(payload) != struct.unpack("<I", stream.read(4))[0]:
            raise ValueError(f"damaged record in {where}")
        yield payload


def read_records(spark: SparkSession, base: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every record, read back from the files, by Spark tasks that take one file each."""
    index = spark.read.parquet(f"{base}/index")
    files = index.groupBy("shard").agg(F.max("file").alias("file"), F.max("width").alias("width"))
    extra = ", ids array<long>" if with_ids else ""

    def read(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(base)
        for b in batches:
            for shard, name, size in zip(*[c.to_pylist() for c in b.columns]):
                before, rows = 0, []
                with store.open_input_stream(f"{folder}/{name}", buffer_size=1 << 20) as stream:
                    for seq, payload in enumerate(records(stream, name)):
                        ids = np.frombuffer(payload, f"<u{size}").astype("<u4")
                        rows.append((shard, seq, before, len(ids), zlib.crc32(ids.tobytes()), *([ids.tolist()] if with_ids else [])))
                        before += len(ids)
                        if len(rows) == 4096:
                            yield _batch(rows, with_ids)
                            rows = []
                yield _batch(rows, with_ids)

    read_back = files.repartition(width(spark), "shard").mapInArrow(read, f"shard int, seq long, before long, n_tokens long, ids_crc32 long{extra}")
    total = read_back.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row per file: the running total of a file list.
    ahead = total.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    out = index.select("shard", "seq", "doc_id").hint("merge").join(read_back, ["shard", "seq"]).join(F.broadcast(ahead), "shard")
    return out.select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [("shard", pa.int32()), ("seq", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int64()))] if with_ids else [])
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])


def fetch(index_rows: DataFrame, base: str) -> DataFrame:
    """Shuffled reads: doc_id and ids of any rows of the index, each by one seek in its file."""

    def read(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(base)
        for b in batches:
            open_files, ids = {}, []
            for name, offset, size in zip(*[b.column(c).to_pylist() for c in ("file", "offset", "width")]):
                if name not in open_files:
                    open_files = {name: store.open_input_file(f"{folder}/{name}")} if len(open_files) > 64 else open_files | {name: store.open_input_file(f"{folder}/{name}")}
                f = open_files[name]
                f.seek(offset)
                ids.append(np.frombuffer(next(records(f, name)), f"<u{size}").astype("int64"))
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    rows = index_rows.select("doc_id", "file", "offset", "width")
    return rows.mapInArrow(read, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<long>")
