"""Hard negatives, nearest neighbours and token alignment against brute force, and on odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohesia.llm import align, negatives, vamana
from cohesia.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>, label int, d int, v string, rank int, score string, a string, g string"
ODD = [(None, [1.0, 0.0], 1), (901, None, 1), (902, [], 1), (903, [1.0, None], 1), (904, [1.0, math.nan], 1), (905, [math.inf, 1.0], 1), (906, [0.0, 0.0], 1), (908, [0.5, 0.25], None), (909, [0.5, 0.25, 0.125], 1), (910, [0.5], 2)]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 1, "x", "x", "x") for r in rows], VECTORS)


def some(seed, n, d, step=0.25):
    """Vectors on a coarse grid, so that scores tie often, with repeats and one common vector."""
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-4, 4) * step for _ in range(d)], rng.choice([0, 0, 0, 1, 2, 3])) for i in range(n)]
    common = [step] * d
    rows = [(i, common if i % 3 == 0 else v, y) for i, v, y in rows]
    return rows + rows[:5] + [rows[40], rows[20]]


# 11: hard negatives


@pytest.mark.parametrize("low, high, d", [(-200, 200, 64), (0, 3, 5), (-(2**30), 2**30, 3), (-(2**70), 2**70, 2), (-5, -1, 4), (0, 0, 3)])
def test_products_are_exact(low, high, d):
    rng = random.Random(low + d)
    a = np.array([[float(rng.randint(low, high)) for _ in range(d)] for _ in range(7)])
    c = np.array([[float(rng.randint(low, high)) for _ in range(d)] for _ in range(23)])
    limit = lambda x: min(max(x, -(2**63 - 1)), 2**63 - 1)
    want = [[limit(sum(int(x) * int(y) for x, y in zip(p, q))) for q in c] for p in a]
    assert negatives.products(a, c).tolist() == want
    assert negatives._wide_products(a, c, max(0, -int(a.min())), max(0, -int(c.min()))).tolist() == want
    assert negatives.products(a[:0], c).shape == (0, 23)


def brute_negatives(rows, every):
    good = {(i, tuple(v), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    good = [(i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in good]
    out = []
    for a, va, ya in good:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, y) for i, v, y in good if len(v) == len(va)]
        for s, p, _ in sorted(x for x in scored if x[2] == ya and x[1] != a)[:5]:
            fit = sorted(x for x in scored if x[2] != ya and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [8192, 7])
def test_hard_negatives(spark, block_rows):
    rows = some(1, 400, 6) + ODD
    got = negatives.hard_negatives(vectors(spark, rows), anchor_every=10, block_rows=block_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 10)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_hard_negatives_without_rows(spark):
    assert negatives.hard_negatives(vectors(spark, [])).count() == 0
    assert negatives.hard_negatives(vectors(spark, ODD)).count() == 0
    assert negatives.hard_negatives(vectors(spark, [(100, [1.0], 1), (101, [1.0], 1)])).count() == 0


# 12: nearest neighbours


def brute_nearest(rows, every, k):
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, vq in sorted(good, reverse=True):
        if q % every == 0:
            best = {}
            for i, v in good:
                if i != q and len(v) == len(vq):
                    best[i] = max(best.get(i, -math.inf), sum(x * y for x, y in zip(vq, v)))
            out[q] = sorted((-s, i) for i, s in best.items())[:k]
    return sorted((q, r + 1, i, -s) for q, found in out.items() for r, (s, i) in enumerate(found))


@pytest.mark.parametrize("shard_rows", [32_768, 90])
def test_nearest_small_is_exact(spark, shard_rows):
    rows = some(2, 300, 5) + ODD + [(920, [0.25, 1.0], 1), (940, [1.0, 0.25], 1)]
    got = vamana.nearest(vectors(spark, rows), shard_rows=shard_rows, block_rows=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_nearest(rows, 20, 20)
    assert vamana.nearest(vectors(spark, [])).count() == 0
    assert vamana.nearest(vectors(spark, ODD[:8])).count() == 0


def test_graph_recall_and_links():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32))
    v = centres[rng.integers(0, 20, 6000)] + rng.normal(size=(6000, 32))
    x = vamana.lifted(v)
    assert np.allclose((x * x).sum(1), 1, atol=1e-5)
    g = vamana.Graph(x)
    assert ((g.links >= -1) & (g.links < len(x)) & (g.links != np.arange(len(x))[:, None])).all()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in g.links)
    q = np.column_stack([v[:200], np.zeros(200)]).astype(np.float32)
    truth = np.argsort(-(v[:200] @ v.T), 1)[:, :20]
    found = g.find(q, vamana.BEAM)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(truth, found)]) > 0.97


def test_prune_keeps_diverse_links():
    """Of two candidates in one direction the nearer stays; alpha over one keeps the farther one too if it is far enough."""
    angle = lambda *deg: np.array([[np.cos(np.radians(t)), np.sin(np.radians(t))] for t in deg], np.float32)
    x = angle(0, 10, 25, -30)
    cand, sim = np.array([[1, 2, 3]]), x[[1, 2, 3]] @ x[0]
    assert vamana.prune(x, np.array([0]), cand, sim[None], 1.0, 3, 4).tolist() == [[1, 3, -1, -1]]
    assert vamana.prune(x, np.array([0]), cand, sim[None], 2.0, 3, 4).tolist() == [[1, 2, 3, -1]]


def test_nearest_query_recall(spark):
    """The registered query over its whole table, against all inner products."""
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    want = {(q, i) for q, _, i, _ in brute_nearest([(r.vec_id, r.embedding, r.label) for r in rows], 20, 20)}
    got = QUERIES["op12_nearest_neighbours"](spark, d).collect()
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got} & want) > 0.95 * len(want)
    by = {r.vec_id: r.embedding for r in rows}
    assert all(abs(r.score - sum(x * y for x, y in zip(by[r.query_id], by[r.vec_id]))) < 1e-12 for r in got)


# 13: token alignment


def cuts(ids_a, ids_b, ends_a, ends_b):
    both = sorted(set(ends_a) & set(ends_b))
    part = lambda ids, ends, x, y: ",".join(str(i) for i, e in zip(ids, ends) if x < e <= y)
    groups = [part(ids_a, ends_a, x, y) + "|" + part(ids_b, ends_b, x, y) for x, y in zip([0, *both], both)]
    return groups, [(a, b) for a, x in zip(ids_a, ends_a) for b, y in zip(ids_b, ends_b) if x == y]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(1, n)), st.sets(st.integers(1, n)))))
def test_runs_against_cuts(drawn):
    n, a, b = drawn
    a, b = sorted(a | {n}), sorted(b | {n})
    ids_a, ids_b = [100 + 3 * x for x in a], [200 + 7 * x for x in b]
    n_groups, told, link_a, link_b = align.align(ids_a, ids_b, a, b)
    groups, links = cuts(ids_a, ids_b, a, b)
    assert told == ";".join(groups) and n_groups == len(groups) and list(zip(link_a, link_b)) == links
    spans = list(align.runs(a, b))
    assert [s[0] for s in spans[1:]] == [s[1] for s in spans[:-1]] and spans[-1][1] == len(a) and spans[-1][3] == len(b)


def test_long_equal_stretches_are_jumped():
    a = list(range(1, 100_001))
    b = a[:50_000] + a[50_001:]  # one end less
    assert list(align.runs(a, b)) == [(0, 50_000, 0, 50_000), (50_000, 50_002, 50_000, 50_001), (50_002, 100_000, 50_001, 99_999)]
    assert list(align.runs(a, a)) == [(0, 100_000, 0, 100_000)] and list(align.runs([], [])) == []


TEXTS = [None, "", " ", "\n", "Hello world", "hello  world\n\n\tfoo", "naïve café 東京 😀", "<|endoftext|> and <s> </s> <0x41>", "a▁b", "x" * 5000, "word " * 3000, "don't we'll 12345 3.14", "Ünïcödé́", "the the the", "the the the", "\x00\x01"]


def test_ranks_give_the_ids_of_the_file():
    """The faster library agrees with the tokenizer file's own on every character that it is used for, and on odd mixtures."""
    a = align.ByteLevel(P.path("byte_bpe_50k.json"))
    assert a.ranked is not None
    rng = random.Random(4)
    plain = [c for c in map(chr, [*range(0x250), *range(0x2010, 0x2028), 0x20AC]) if not align.OTHER.search(c)]
    odd = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\u2028", "\u3000", "\u200b", "don't", "'s", "'S", "Zürich", "東京", "😀", "12", "3.5", "-", "<|endoftext|>", "e\u0301", "..", "\r\n", "the", "²", "½", "ª"]
    texts = plain + ["".join(rng.choices(plain, k=rng.randint(1, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice(odd) + rng.choice(["", "", " ", "  "]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    own = [e.ids for e in a.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    assert a(texts) == own and sum(not align.OTHER.search(t) for t in texts) > 4500


@pytest.mark.parametrize("broadcast_pairs", [500_000, 0])
def test_align_documents(spark, broadcast_pairs):
    a, b = align.ByteLevel(P.path("byte_bpe_50k.json")), align.Pieces(P.path("piece_bpe_32k.model"))
    rows = list(enumerate(TEXTS)) + [(None, "the end"), (4, TEXTS[4]), (4, "other")]
    docs = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], "doc_id long, text string, row string, links int, n_a int")
    want, counts = [], Counter()
    for i, t in rows:
        ids_a, ids_b = (a([t])[0], b([t])[0]) if t else ([], [])
        raw = b" " + (t or "").encode()
        if not t or b"".join(a.bytes[x] for x in ids_a) != raw or b"".join(b.bytes[x] for x in ids_b) != raw:
            ids_a, ids_b = [], []
        ends = [np.cumsum([len(v.bytes[x]) for x in ids]).tolist() if ids else [] for v, ids in ((a, ids_a), (b, ids_b))]
        groups, links = cuts(ids_a, ids_b, *ends)
        counts.update(links)
        want.append((i, ids_a, ids_b, groups, links))
    most = Counter()
    for (x, y), n in counts.items():
        most[y] = max(most[y], n)
    out = [(i, len(x), len(y), len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, x, y, g, k in want]
    got = align.align_documents(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), broadcast_pairs)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(out, key=key)
    by = {i: r for i, r in enumerate(out)}
    assert by[8][1] == 0 and by[4][1] > 0 and by[7][1] > 0 and by[15][1] > 0
    assert align.align_documents(docs.limit(0), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0
