"""Language of a text by prediction by partial matching: the language whose model codes its bytes shortest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, slices, utf8

ORDER = 3  # longest context in bytes
SAMPLE_ROWS = 2_000  # documents a language learns from, about: those of smallest hash
MAX_CONTEXTS = 12_000  # contexts of each order with a row of code lengths: the most frequent ones
STEP_BYTES = 1 << 18  # texts scored together
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True


def _padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ORDER line ends before each, and the places of the texts' own bytes."""
    n = len(at) - 1
    place = np.arange(len(raw)) + ORDER * (np.repeat(np.arange(n), np.diff(at)) + 1)
    out = np.full(len(raw) + ORDER * n, 10, np.uint8)
    out[place] = raw
    return out, place


def count_contexts(sample: DataFrame) -> DataFrame:
    """lang, gram (ORDER + 1 bytes as an integer) and n over sample(lang, text), counted in batches before the shuffle."""

    def count(batches):
        for b in batches:
            langs = b.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = utf8(b.column(1))
            for i, j in slices(offsets, STEP_BYTES):
                at = offsets[i : j + 1] - offsets[i]
                buf, place = _padded(raw[offsets[i] : offsets[j]], at)
                gram = np.zeros(len(place), np.int64)
                for k in range(ORDER, -1, -1):
                    gram = gram * 256 + buf[place - k]
                owner = langs[i:j][np.repeat(np.arange(j - i), np.diff(at))]
                for lang in np.unique(langs[i:j].astype(str)):
                    g, n = np.unique(gram[owner == lang], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen context trees of all languages as tables.

    `into[k]` leads from the number of the last k symbols and a next symbol to the number of the last
    k + 1; -1 is a context that no language kept. `bits[state * symbols + symbol]` has a code length for
    each language, where the state is the longest kept context.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        if not langs:
            return
        seen = np.unique(np.concatenate([(gram >> (8 * k)) & 255 for k in range(ORDER + 1)] + [np.array([10])]))
        self.symbol = np.full(256, len(seen), np.int32)
        self.symbol[seen] = np.arange(len(seen))
        a = self.symbols = len(seen) + 1
        digits = [self.symbol[(gram >> (8 * k)) & 255] for k in range(ORDER, -1, -1)]
        last = digits[-1]
        # Order -1: all bytes alike; order 0: symbol counts.
        flat = np.full((len(langs), 1, a), 1 / 256)
        prob = [self._escape(self._counts(lang, np.zeros(len(gram), np.int64), last, n, 1), flat)]
        kept_ids = [np.zeros(1, np.int64)]
        self.into = []
        for k in range(1, ORDER + 1):
            code = np.zeros(len(gram), np.int64)
            for d in digits[ORDER - k : ORDER]:
                code = code * a + d
            values, inverse = np.unique(code, return_inverse=True)
            weight = np.bincount(inverse, n, minlength=len(values))
            shorter = values // a  # without its last symbol
            order = np.argsort(-weight, kind="stable")[:MAX_CONTEXTS]
            keep = np.zeros(len(values), bool)
            keep[order] = True
            if k > 1:
                known = kept_ids[-1]
                for part in (shorter, values % a ** (k - 1)):
                    spot = np.minimum(np.searchsorted(known, part), len(known) - 1)
                    keep &= known[spot] == part
            ids = values[keep]
            number = np.full(len(values), -1)
            number[keep] = np.arange(len(ids))
            own = number[inverse]
            sel = own >= 0
            count = self._counts(lang[sel], own[sel], last[sel], n[sel], len(ids))
            suffix = np.zeros(len(ids), np.int64) if k == 1 else np.searchsorted(kept_ids[-1], ids % a ** (k - 1))
            prob.append(self._escape(count, prob[-1][:, suffix]))
            prefix = np.zeros(len(ids), np.int64) if k == 1 else np.searchsorted(kept_ids[-1], ids // a)
            step = np.full((1 if k == 1 else len(kept_ids[-1])) * a + a, -1, np.int32)  # the last row answers number -1
            step[prefix * a + ids % a] = np.arange(len(ids))
            self.into.append(step)
            kept_ids.append(ids)
        self.first = np.concatenate([[0], np.cumsum([p.shape[1] for p in prob])])
        self.bits = np.ascontiguousarray(-np.log2(np.concatenate(prob, 1)).transpose(1, 2, 0).reshape(-1, len(langs))).astype(np.float32)

    def _counts(self, lang, context, symbol, n, contexts):
        """Symbol counts by language and context."""
        a = self.symbols
        return np.bincount((lang * contexts + context) * a + symbol, n, minlength=len(self.langs) * contexts * a).reshape(len(self.langs), contexts, a)

    @staticmethod
    def _escape(count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        total, kinds = count.sum(2, keepdims=True), (count > 0).sum(2, keepdims=True)
        return np.where(count > 0, count / np.maximum(total + kinds, 1), np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0) * shorter)

    def code_lengths(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        buf, place = _padded(raw, at)
        s = self.symbol[buf]
        number = self.into[0][s]
        state = np.where(number >= 0, number + self.first[1], 0)
        for k in range(2, ORDER + 1):
            before = np.append(-1, number[:-1])
            row = np.where(before >= 0, before, len(self.into[k - 1]) // self.symbols - 1)
            number = self.into[k - 1][row * self.symbols + s]
            state = np.where(number >= 0, number + self.first[k], state)
        bits = self.bits[state[place - 1] * self.symbols + s[place]]
        run = np.zeros((len(place) + 1, bits.shape[1]))
        np.cumsum(bits, axis=0, dtype=np.float64, out=run[1:])
        return run[at[1:]] - run[at[:-1]]


def _letters(column: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.append(0, np.cumsum(_ALPHA[raw]))
    wide = np.append(0, np.cumsum(raw > 127))
    has = run[offsets[1:]] > run[offsets[:-1]]
    for i in np.flatnonzero(~has & (wide[offsets[1:]] > wide[offsets[:-1]])):
        has[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return has


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from whole texts of docs(doc_id, text, lang) with a language whose crc32(doc_id) mod 4 is not 2.

    A language with more than `sample_rows` such documents learns from a share of about so many, by hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 4) != 2))
    share = rows.groupBy("lang").agg((F.lit(float(sample_rows)) / F.count("text")).alias("share"))
    sample = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    counts = count_contexts(sample).toPandas().sort_values(["lang", "gram"])
    langs = sorted(counts["lang"].unique())
    lang = np.searchsorted(np.array(langs, dtype=object), counts["lang"].to_numpy()) if langs else np.zeros(0, np.int64)
    return Model(langs, lang, counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod 4 is 2; null for a null doc_id), lang_pred and score for every row of docs(doc_id, text).

    The score is the posterior of the chosen language under equal priors. A text that is null, empty or
    has no letter is `und` with score 0, as is every text if no language was learned. Ties go to the
    first language in name order. Repeated rows get a row each; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            raw, offsets = utf8(b.column(1))
            names, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            letters = _letters(b.column(1), raw, offsets)
            for i, j in slices(offsets, STEP_BYTES) if model.langs else ():
                bits = model.code_lengths(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                best = bits.argmin(1)
                post = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                names[i:j] = np.array(model.langs, object)[best]
                score[i:j] = post
            names[~letters], score[~letters] = "und", 0.0
            yield pa.record_batch([b.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
