"""Quality score by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, remainder, saved, slices, utf8, words

MAX_ROWS = 40_000  # labelled rows that a fit may use: those of smallest hash
TREES, DEPTH, RATE, BIN_COUNT, LEAST, RIDGE = 60, 4, 0.2, 64, 20.0, 1.0

# Byte classes whose shares are features: fixed by ASCII.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t\v\f", "line": b"\n\r", "stop": b".?:;", "comma": b",", "bang": b"!", "hash": b"#", "star": b"*", "dollar": b"$", "percent": b"%", "amp": b"&", "bar": b"|", "at": b"@", "slash": b"/\\", "quote": b"\"'", "bracket": b"()[]{}<>", "line_mark": b"-_=+~"}
_KIND = np.full(256, len(_CLASSES), np.int64)  # other ASCII
for _i, _bytes in enumerate(_CLASSES.values()):
    _KIND[list(_bytes)] = _i
_KIND[128:] = len(_CLASSES) + 1
FEATURES = [f"share_{c}" for c in (*_CLASSES, "other", "wide")] + ["log_bytes", "log_words", "word_length", "word_spread", "one_letter", "distinct_words", "top_word", "distinct_pairs", "same_as_before", "log_lines", "line_words", "repeated_lines", "marked_ends"]


def _ratio(a, b):
    return a / np.maximum(b, 1)


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, and the count of its most frequent one."""
    _, at, count = np.unique(mix(h + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, doc[at], count)
    return np.bincount(doc[at], minlength=n), top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each whole text; all zero for a null or empty one."""
    raw, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    kinds = len(_CLASSES) + 2
    for i, j in slices(offsets):
        n, part, at = j - i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part) == 0:
            continue
        size = np.diff(at)
        owner = np.repeat(np.arange(n), size)
        count = np.bincount(owner * kinds + _KIND[part], minlength=n * kinds).reshape(n, kinds)
        h, doc, a, z = words(part, at)
        length = (z - a).astype(float)
        m = np.bincount(doc, minlength=n)
        mean = _ratio(np.bincount(doc, length, minlength=n), m)
        spread = np.sqrt(np.maximum(_ratio(np.bincount(doc, length * length, minlength=n), m) - mean * mean, 0))
        different, top = _distinct(h, doc, n) if len(h) else (m, m)
        inner = doc[1:] == doc[:-1]
        pair = mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15 | 1))[inner]
        pairs = _distinct(pair, doc[1:][inner], n)[0] if len(pair) else np.zeros(n)
        same = np.bincount(doc[1:][inner & (h[1:] == h[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
        # A line is a run of words with as many line ends before each.
        line = np.cumsum(part == 10)[a] if len(a) else np.zeros(0, np.int64)
        head = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | ~inner)) if len(a) else np.zeros(0, np.int64)
        lines = np.bincount(doc[head], minlength=n)
        if len(head):
            place = np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))
            text = np.add.reduceat(h * (mix(place.astype(np.uint64)) | np.uint64(1)), head)
            single = _distinct(text, doc[head], n)[0]
        else:
            single = lines
        marked = np.bincount(doc, np.isin(_KIND[part[z - 1]], [7, 8, 9, 10, 11, 12, 13]) if len(z) else None, minlength=n) if len(z) else np.zeros(n)
        out[i:j] = np.column_stack([count / np.maximum(size, 1)[:, None], np.log1p(size), np.log1p(m), mean, spread, _ratio(np.bincount(doc[length == 1], minlength=n), m), _ratio(different, m), _ratio(top, m), _ratio(pairs, m - 1), _ratio(same, m), np.log1p(lines), _ratio(m, lines), 1 - _ratio(single, lines) * (lines > 0), _ratio(marked, m)])
    return out


class Trees:
    """Boosted trees of equal depth as arrays: node t of a tree has children 2t+1 and 2t+2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting on histograms of at most BIN_COUNT quantile bins; gains use second-order sums.

    With no rows every score is 0.5; with one class, scores stay on its side.
    """
    n, f = x.shape
    rate = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, c], np.arange(1, BIN_COUNT) / BIN_COUNT)) if n else np.zeros(0) for c in range(f)]
    binned = np.column_stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)]) if n else np.zeros((0, f), int)
    cells = np.arange(f) * BIN_COUNT
    score, made = np.full(n, base), []
    inner = 2**DEPTH - 1
    for _ in range(TREES if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        feature, threshold, chosen = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner, np.int64) + BIN_COUNT
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * f * BIN_COUNT + cells[None, :] + binned).ravel()
            sums = [np.bincount(slot, np.repeat(v, f), minlength=width * f * BIN_COUNT).reshape(width, f, BIN_COUNT).cumsum(2) for v in (grad, hess)]
            g, h = sums
            tg, th = g[:, :, -1:], h[:, :, -1:]
            gain = g * g / (h + RIDGE) + (tg - g) ** 2 / (th - h + RIDGE) - tg * tg / (th + RIDGE)
            count = np.bincount(slot, minlength=width * f * BIN_COUNT).reshape(width, f, BIN_COUNT).cumsum(2)
            gain[(count < LEAST) | (count[:, :, -1:] - count < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for w in range(width):
                c, b = divmod(int(best[w]), BIN_COUNT)
                if gain[w, c, b] > 1e-9:
                    feature[first + w], threshold[first + w], chosen[first + w] = c, cuts[c][b], b
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > chosen[node])
        at = node - inner
        leaf = RATE * np.bincount(at, grad, minlength=2**DEPTH) / (np.bincount(at, hess, minlength=2**DEPTH) + RIDGE)
        score = score + leaf[at]
        made.append((feature, threshold, leaf))
    parts = [np.array([m[k] for m in made]) for k in range(3)] if made else [np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, 2**DEPTH))]
    return Trees(base, *parts)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, Trees]:
    """Statistics of every row (doc_id, x) on the shared folder, and the trees fitted to the labelled ones."""

    def measure(batches):
        for b in batches:
            x = statistics(b.column(1))
            yield pa.record_batch([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = saved(rows.mapInArrow(measure, "doc_id long, x array<double>"), "statistics")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    marked = marked.where(remainder("doc_id", 3) != 1)
    sample = known.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(max_rows).select("x", "y").toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), len(FEATURES))
    return known, fit(x, sample["y"].to_numpy(float))


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text), learned from labels(doc_id, quality).

    Rows whose crc32(doc_id) mod 3 is 1 are held out of the fit (a null doc_id: held_out null, never
    learned from). Null labels and labels other than 0 and 1 are skipped, repeated ones count each.
    The fit takes at most `max_rows` labelled rows, those of smallest hash. A null or empty text has
    all statistics zero and is scored like any other; other columns are ignored. No labels: score 0.5.
    """

    known, model = learn(docs, labels, max_rows)

    def apply(batches):
        for b in batches:
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            yield pa.record_batch([b.column(0), pa.array(model.score(values))], names=["doc_id", "score"])

    out = known.mapInArrow(apply, "doc_id long, score double")
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that the classifier does not reject: a second pass over the texts, without a shuffle."""
    _, model = learn(docs, labels, max_rows)
    at = docs.columns.index("text")

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(statistics(b.column(at))) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
