"""The operators of cohesia.llm against brute force, round trips and held-out accuracy, and on odd rows."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohesia.llm import hnsw, langid, minhash, mixing, pages, quality, quotes, records, secrets, templates

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, block string, n_hex string, component_id string, words string, hash string"
WORDS = {"en": "the of and to in is that for with on are this was be by from or an it at".split(), "fr": "le la les des une est dans que pour par sur avec plus pas mais très été où".split(), "de": "der die das und nicht ein eine ist von mit für auf dem den über größe straße".split()}


def documents(spark, rows):
    """rows of (doc_id, text[, lang[, source]]); the other columns clash with names the operators use."""
    full = [(*r, *[None] * (4 - len(r)), 1, "x", "x", "x", "x", "x", "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "a", "ing", "er", "s"]) for _ in range(n))


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture
def rng():
    """Every test has its own generator: its data do not depend on the tests before it."""
    return random.Random(5)


ODD = [None, "", " \n\t", "one", "two words", "x" * 30_000, "word " * 5_000]


# 1: templates


def leaks(spark, docs, items):
    bench = spark.createDataFrame([(*i, "x", "x") for i in items], "item_id long, text string, doc_id string, hash string")
    return {(r.doc_id, r.item_id): r for r in templates.contaminated(documents(spark, docs), bench).collect()}


def test_templates_find_copies_and_new_parameters(spark, rng):
    item = "A farmer has 12 sheep and buys 30 more from Anna at the market, so how many sheep and 30 lambs does he own"
    other = item.replace("12", "75").replace("30", "91").replace("Anna", "Boris")
    mixed = item.replace("12", "75").replace("buys 30", "buys 91")  # the item's 30 meets 91 and 30
    plain = prose(rng, 40)
    docs = [(1, prose(rng, 50) + " " + item + " " + prose(rng, 9)), (2, prose(rng, 30) + "\n" + other), (3, mixed), (4, prose(rng, 90)), (5, plain.upper()), (6, item), (6, item)]
    docs += [(10 + i, t) for i, t in enumerate(ODD)]
    got = leaks(spark, docs, [(1, item), (2, plain), (3, None), (4, ""), (5, "too short"), (2, plain)])
    assert set(got) == {(1, 1), (2, 1), (5, 2), (6, 1)}
    assert got[1, 1].literal and not got[2, 1].literal and got[2, 1].n_slots > 0


def test_templates_empty(spark):
    assert leaks(spark, [], [(1, "a b c d e f g")]) == {}
    assert leaks(spark, [(1, "a b c d e f g")], []) == {}


def test_templates_against_brute_force(spark, rng):
    items = [(i, prose(rng, rng.randint(8, 30))) for i in range(12)]
    docs = []
    for d in range(60):
        w = prose(rng, 40).split()
        t = items[rng.randrange(12)][1].split()
        w[5:5] = t[: rng.choice([len(t), len(t) - 1, len(t) // 2, 4])]
        docs.append((d, " ".join(w)))
    got = leaks(spark, docs, items)
    want = set()
    for d, t in docs:
        w = t.split()
        for i, u in items:
            u = u.split()
            hit = {p for a in range(len(w) - 4) for b in range(len(u) - 4) if w[a : a + 5] == u[b : b + 5] for p in range(b, b + 5)}
            if len(hit) >= 0.8 * len(u):
                want.add((d, i))
    assert set(got) == want


def test_slots_keep_their_places(spark):
    df = templates.canonical(spark.createDataFrame([("It took Anna 5kg, 3.5 km and 1,000 m of the Road to Rome.",)], "text string")).withColumn("raw", templates.raw(F.col("text")))
    r = df.first()
    assert len(r.words) == len(r.raw)
    assert dict(zip(r.raw, r.words))["anna"] == "ǂname" and dict(zip(r.raw, r.words))["km"] == "ǂunit" and dict(zip(r.raw, r.words))["3.5"] == "ǂnum"


def test_templates_find_dense_and_short_items(spark, rng):
    items = ["What is 12 + 34 + 56 + 78 + 90 + 11 + 5?", "Find the next number: 2, 4, 8, 16, 32, 64, 128, 256", "Who wrote Hamlet?", "3, 1, 4, 1, 5, 9, 2, 6, 5",
             " ".join(f"{n} has {k} apples." for k, n in enumerate("Ada Bob Cleo Dan Eve Finn Gus Hal Ida Jon Kim Leo Mia Ned Oda Pam Quin Rob".split(), 2)) + " How many is that?"]
    docs = [(i, f"{prose(rng, 20)}. {t} {prose(rng, 9)}") for i, t in enumerate(items)]
    docs += [(10, "Who wrote the Hamlet?"), (11, "3, 1, 4, 1, 5, 8, 1, 7, 6"), (12, items[4].replace("Ada", "Zoe").replace(" 7 ", " 99 ")), (13, prose(rng, 90))]
    got = leaks(spark, docs, list(enumerate(items)))
    assert set(got) == {(i, i) for i in range(5)} | {(12, 4)}
    assert all(got[i, i].literal and got[i, i].coverage == 1 for i in range(5)) and not got[12, 4].literal


def test_templates_do_not_depend_on_capitals(spark, rng):
    tom = "Tom has 3 red marbles. Tom gives 2 to Ann. Tom buys 5 more. Tom now has how many?"
    trip = "When did Anna meet Boris in Paris before Clara moved to Rome with David?"
    german = "Der Bauer kauft im Markt einen Korb Äpfel und bringt das Obst der Nachbarin nach Hause"
    usa = 'The teacher said: "McDonald flew to NASA" and then (O Neil) left for the USA by boat'
    renamed = usa.replace("McDonald", "MacLeod").replace("NASA", "CERN").replace("USA", "UAE")
    docs = [(1, tom.replace("Tom", "Sam")), (2, trip.lower()), (3, trip.upper()), (4, german.lower()), (5, prose(rng, 30) + ". " + renamed), (6, german), (7, tom.replace("Tom gives", "Sam gives").replace("3", "4"))]
    got = leaks(spark, docs, [(1, tom), (2, trip), (3, german), (4, usa)])
    assert set(got) == {(1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (6, 3)}
    assert got[2, 2].literal and got[4, 3].literal and not got[1, 1].literal and not got[5, 4].literal



# 2: near copies


def near(spark, docs, **k):
    return {r.doc_id: r for r in minhash.near_duplicates(documents(spark, docs), **k).collect()}


def test_near_duplicates_against_brute_force(spark, rng):
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 12, 40, 150]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            docs.append((len(docs) * 3 + 1, " ".join(w).upper() if g % 2 else "\n".join(w)))
    docs += [(1000 + i, t) for i, t in enumerate(ODD * 2)]
    got = near(spark, docs)
    sets = {d: shingle_set(t, 4) for d, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(list(sets), links)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(s), comp[d], comp[d] == d) for d, s in sets.items()}


def test_near_duplicates_in_many_tiles(spark, rng, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for d in range(120):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4])):
            w[rng.randrange(200)] = f"v{d}-{rng.randrange(99)}"
        docs.append((d, " ".join(w)))
    got = near(spark, docs)
    sets = {d: shingle_set(t, 4) for d, t in docs}
    comp = components(list(sets), [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert {d: r.component_id for d, r in got.items()} == comp


def test_deduplicated_keeps_clean_rows_and_columns(spark, rng):
    a, b = prose(rng, 60), prose(rng, 60)
    docs = documents(spark, [(3, a), (1, a), (1, a), (2, b), (4, None), (5, ""), (None, "alone here and there again")])
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2, 4, 5]
    assert minhash.deduplicated(docs.limit(0)).count() == 0


# 3: quality


def test_quality(spark, rng):
    rows, labels = [], []
    for d in range(600):
        good = d % 3 > 0
        t = prose(rng, 60)
        rows.append((d, t if good else " ".join(w + "###" for w in t.upper().split())))
        labels.append((d, int(good), None))
    labels += [(None, 1, 0.0), (7, None, 0.0), (10_000, 1, 1.0), (8, 5, 0.0)]
    rows += [(2000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (3, "twice"), (3, "twice")]
    docs, lab = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, score double")
    out = quality.score_documents(docs, lab).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    known = out[out.doc_id < 600]
    assert (known.held_out == [zlib.crc32(str(int(d)).encode()) % 3 == 1 for d in known.doc_id]).all()
    held = known[(known.held_out == True) & (known.doc_id != 3)]  # noqa: E712
    assert ((held.doc_id % 3 > 0) == (held.predicted == 1)).mean() > 0.99
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and kept.where("doc_id < 600 and doc_id <> 3").count() == (out[(out.doc_id < 600) & (out.doc_id != 3)].predicted == 1).sum()
    assert quality.score_documents(docs, lab.limit(0)).where("score = 0.5").count() == len(rows)
    assert quality.score_documents(docs.limit(0), lab).count() == 0


def test_trees_fit_a_rule():
    g = np.random.default_rng(3)
    x = g.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    score = quality.fit(x, y).score(x)
    assert ((score >= 0.5) == y).mean() > 0.98 and quality.fit(x, np.ones(3000)).score(x).min() > 0.9


# 4: pages

HTML = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now.</div>
<article><h1>Title &amp; more</h1><p><b>First&nbsp;  paragraph<br>goes &lt;on&gt;.<p>Second one,\n with a  &quot;quote&quot;.</p><div class="advert"><p>Buy that as well, it is cheap.</p></div><p>Short.</p><form><p>Name</p></form></article>
<section class="comments"><h2>Comments</h2><p>A reader wrote this long remark, and it goes on and on. It has sentences.</p></section><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", HTML), (2, None, None), (3, "u", ""), (4, "u", "<p>only 1 < 2 text"), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "u", '<p class="cut'), (1, "u", HTML), (7, "u", "<article><h1>T</h1>" + "<p>" + "long " * 20_000 + "</p></article>")]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    out = {r.page_id: r for r in pages.extract(df).collect()}
    assert pages.extract(df).count() == len(rows)
    assert out[1].text == 'Title & more\n\nFirst paragraph goes <on>.\n\nSecond one, with a "quote".\n\nShort.'
    assert [out[i].text for i in (2, 3, 4, 6)] == ["", "", "only 1 < 2 text", ""]
    assert len(out[7].text) == 3 + 99_999 and all(r.n_chars == len(r.text) for r in out.values())
    assert pages.extract(df.limit(0)).count() == 0


def test_page_marginals_are_exact():
    """Message passing against the sum over all states of a small tree."""
    m = pages.Model(pages.PAGES)
    nodes = pages.parse('<div class="content"><p>Some text here.</p></div><div class="menu"><a href="x">Go</a></div>')
    import itertools

    total, good = 0.0, np.zeros(len(nodes))
    place = {id(n): i for i, n in enumerate(nodes)}
    for s in itertools.product((pages.WRAPS, pages.MAIN, pages.OFF), repeat=len(nodes)):
        w = 1.0
        for n, y in zip(nodes, s):
            e = 1.0
            for f in pages._features(n):
                e *= m.emit[f][y] ** (1 if pages._kind(n) == "container" else pages.TEMPER) if f in m.emit else 1
            for word in n.naming:
                e *= m.emit.get(("word", word), (1, 1, 1))[y]
            w *= e * (m.root[y] if n.parent is None else m.move[pages._kind(n), s[place[id(n.parent)]]][y])
        total += w
        good += w * (np.array(s) == pages.MAIN)
    assert np.allclose(good / total, m.marginals(nodes))


RIVER = "The river was low that summer, and the boats could not pass the second lock until the rains came in autumn. People walked along the banks to see it."
MANY = "Nobody in the village had seen it so low before, and they spoke of it for many years."
SHOES = "Buy our new shoes at half price today only"
TALK = "I was there too and I can only say that it has been far worse, whatever the others write here."
P2 = f"<p>{RIVER}</p><p>{MANY}</p>"
LAYOUTS = [
    P2, f"<html><body>{P2}</body></html>", f"<div>{P2}</div>", f'<article><p>{RIVER}</p><div class="ad">{SHOES}</div><p>{MANY}</p></article>',
    f'<article><p>{RIVER}</p><div class="related">{SHOES}</div><p>{MANY}</p></article>', f'<article><p>{RIVER}</p><p class="more">{MANY}</p></article>',
    f'<div id="top"><article>{P2}</article></div>', f'<div class="page has-sidebar"><div>{P2}</div></div>',
    f'<nav><a href="/">Home</a></nav><div id="main"><p>{RIVER}</p><aside>{"<span>" * 401}{SHOES}</aside><p>{MANY}</p></div><footer>{SHOES}</footer>',
    f'<div class="container"><div class="col">{P2}</div><div class="sidebar"><p>{SHOES}.</p></div></div><div class="comments"><p>{TALK}</p></div>',
    f'<main><section><p>{RIVER}</p></section><section><p>{MANY}</p></section></main><div class="cookie-banner">{SHOES} <button>{SHOES}</button></div>',
    f"<table><tr><td>{RIVER}</td></tr><tr><td>{MANY}</td></tr></table>", f"<ul><li>{RIVER}{'<i>' * 70}<li>{MANY}</ul>",
    f'<article>{P2}</article><section class="comments"><article><p>{TALK}</p></article></section>',
    f'<div class="post"><div class="post-body">{P2}</div><div class="post-footer">{SHOES}</div></div><div class="comment-list"><div class="comment"><p>{TALK}</p></div></div>',
]


@pytest.mark.parametrize("source", LAYOUTS)
def test_no_layout_loses_its_article(source):
    assert pages.Model(pages.PAGES).main_text(source) == f"{RIVER}\n\n{MANY}"


def test_inline_formulas_and_fallbacks_stay():
    m = pages.Model(pages.PAGES)
    assert m.main_text(f"<article><p>The area is <math><mi>x</mi><mo>+</mo><mi>y</mi></math> in all the cases. {RIVER}</p><p>{MANY}</p></article>").startswith("The area is x+y in all the cases. The river")
    assert "see map here" in m.main_text(f"<article><p>{RIVER} see <object>map</object> here.</p><p>{MANY}</p></article>")


# 5: secrets

BASE = [("assign", r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]


def test_secrets(spark, rng):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_string = lambda n, a=letters: "".join(rng.choice(a) for _ in range(n))
    rows = []
    for d in range(200):
        t = prose(rng, 40) + " internationalization_of_things donaudampfschifffahrtsgesellschaft "
        t += rng.choice(['token = "%s"' % random_string(32), "Secret:%s" % random_string(5), "AKIA" + random_string(16, letters[:26]), random_string(30, "0123456789abcdef"), "é😀 api_key='%s' secret=token:abcdefgh" % random_string(40), "nothing"])
        rows.append((d, t + " " + prose(rng, 5)))
    hidden = random_string(40)
    rows += [(900, "see " + hidden + " there"), (901, "a_very_long_identifier_of_type_2 is fine")] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(5, rows[5][1])]
    got = secrets.find_secrets(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, t in rows:
        spans = sorted((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(BASE) for m in re.finditer(p, t or "") if ok(m))
        r, n = by[d], Counter(k for *_, k in spans)
        told = ",".join(f"{k}:{a}:{z}" for a, _, z, k in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("model")) == told
    assert by[900].spans == f"model:4:{4 + len(hidden)}" and by[901].spans == ""
    empty = documents(spark, [])
    assert secrets.find_secrets(empty).count() == 0


def test_secret_model_by_length(spark, rng):
    """Random strings of every length are found, ordinary identifiers are not, whatever the seed."""
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789"]
    kinds = [(rng.choice(["token = ", "api_key: "]) + "".join(rng.choice(alphabets[i % 4]) for _ in range(rng.randint(20, 48)))) for i in range(60)]
    common = "market people water school number public money system question government company problem night story member power community minute service information nothing office teacher history result morning reason research education product quality picture student example subject evidence control project activity material analysis knowledge language experience effort village journey kitchen weather window winter bridge forest garden island letter machine mountain newspaper object pattern quarter river season summer ticket uncle vehicle worker yellow factor manner annual value index report".split()
    rows = [(d, " ".join(rng.choice(common) for _ in range(120)) + " " + rng.choice(kinds)) for d in range(300)]
    hidden, plain = [], []
    for i in range(400):
        n = (24, 32, 40, 64)[i % 4]
        s = "".join(rng.choice(alphabets[i // 4 % 4]) for _ in range(n))
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            hidden.append((1000 + i, n, s))
    words = ["account", "service", "manager", "index", "report", "figure", "backup", "monthly", "summary", "handler", "factory", "request", "server", "value"]
    for i in range(400):
        w = rng.sample(words, 4)
        n = rng.randint(1, 999)
        plain.append((5000 + i, [f"{w[0]}_{w[1]}_{w[2]}_{n}", f"{w[0]}/{w[1]}/{w[2]}/{n}/{w[3]}", "".join(x.title() for x in w) + str(n), f"{w[0]}-{w[1]}-2024-03-1{n % 10}-{w[2]}", f"{w[0].upper()}_{w[1].upper()}_{w[2].upper()}_{n}", "123e4567-e89b-12d3-a456-42661417%04d" % i][i % 6]))
    docs = documents(spark, rows + [(i, f"see {s} there") for i, _, s in hidden] + [(i, f"see {s} there") for i, s in plain])
    got = {r.doc_id: r.n_model for r in secrets.find_secrets(docs).collect()}
    for n in (24, 32, 40, 64):
        own = [got[i] for i, m, _ in hidden if m == n]
        assert sum(own) >= 0.97 * len(own), (n, sum(own), len(own))
    false = [s for i, s in plain if len(s) >= 20 and got[i]]
    assert len(false) <= 4, false


# 6: mixing


def check_schedule(out, weights, round_blocks):
    """Every block of every source has its own slot, within its window, and shares are kept in every round."""
    one = out.groupby(["key", "block"])[["slot", "release", "deadline"]].agg(["min", "max"])
    assert all((one[c]["min"] == one[c]["max"]).all() for c in ("slot", "release", "deadline"))
    slots = one["slot"]["min"]
    assert slots.is_unique and (one["release"]["min"] <= slots).all() and (slots < one["deadline"]["min"]).all()


def test_mixing(spark, rng):
    rows = [(d, prose(rng, rng.randint(1, 40)), "en", rng.choice(["a"] * 8 + ["b", "b", "c", None, ""])) for d in range(500)] + [(1000 + i, t, "en", "c") for i, t in enumerate(ODD)] + [(3, "same", "en", "b")] * 2
    docs = documents(spark, rows)
    weights = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", -1.0), ("none", 5.0)], "source string, weight double")
    out = mixing.mix_sources(docs, weights, block_chars=300, round_blocks=12).toPandas()
    assert sorted(out.doc_id) == sorted(r[0] for r in rows)
    out["key"] = out.source.map(lambda s: "-" if s is None else "+" + s)
    check_schedule(out, weights, 12)
    # The slots in use before a block's, by brute force: a source never strays a block from its share while all last.
    p = {"-": 1, "+": 1, "+a": 8, "+b": 4, "+c": 1}
    blocks = out.groupby(["key", "block"]).slot.min()
    ends = min(blocks[k].max() // 1 for k in p)
    n = {k: int(np.ceil((out[out.key == k].place + out[out.key == k].block * 300).max() / 300)) for k in p}
    full = min(n[k] // p[k] for k in p) * sum(p.values())
    for t in range(1, full + 1):
        for k in p:
            assert abs((blocks[k] < t).sum() - t * p[k] / sum(p.values())) < 1 + (len(set(range(blocks[k].index.max() + 1)) - set(blocks[k].index)))
    assert ends >= 0
    assert mixing.mix_sources(docs.limit(0), weights).count() == 0
    mixed = mixing.mixed(docs, weights, block_chars=300)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)


def test_schedule_is_earliest_deadline_first(spark):
    sources = spark.createDataFrame([("+a", 17), ("+b", 9), ("+c", 4)], "__s string, n long")
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "source string, weight double")
    got = sorted((r["first"], r["slot"], r["__s"], r["k"]) for r in mixing.schedule(sources, weights, 10).collect())
    left, want, r = {"+a": 17, "+b": 9, "+c": 4}, [], 0
    p, seen = {"+a": 5, "+b": 3, "+c": 2}, []
    while any(left.values()):
        q = {s: min(p[s], n) for s, n in left.items() if n}
        left = {s: n - q.get(s, 0) for s, n in left.items()}
        if q != seen:
            size, done = sum(q.values()), dict.fromkeys(q, 0)
            for t in range(size):
                _, s = min((-(-(done[s] + 1) * size // q[s]), s) for s in q if done[s] < q[s] and done[s] * size // q[s] <= t)
                done[s] += 1
                want.append((r, t, s, done[s]))
            seen = q
        r += 1
    assert got == want


# 7: quotes


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, depth string, hash string")
    return quotes.link_quotes(df).collect()


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\n\nAlso, how do I reverse it?"),
        (1, 1, "assistant", "> how do I   REVERSE it?\nAlso see below.\nUse reversed(x)."),
        (1, 2, "user", "> > Also, how do I reverse it?\n> Use reversed(x).\n\nThat returns an iterator."),
        (1, 3, "user", "On Monday someone wrote:\n>That returns an iterator.\nYes."),
        (1, 4, "user", "> something nobody has said\nOk > fine."),
        (2, 0, "user", "> How do I sort a list?\nother conversation"),
        (3, 0, None, None), (3, 1, "user", ""), (None, 1, "user", "> x"), (4, None, "user", "y"), (1, 3, "user", "On Monday someone wrote:\n>That returns an iterator.\nYes."),
        (5, 0, "user", "> " * 50 + "deep quote of nothing"), (5, 1, "user", "line\n" * 2000),
    ]
    got = linked(spark, rows)
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, t].parent_turn for t in range(5)] == [None, None, 1, 2, None]
    assert [by[1, t].thread for t in range(5)] == [0, 1, 1, 1, 4]
    assert [by[1, t].depth for t in range(5)] == [0, 0, 1, 2, 0]
    assert by[1, 2].text == "That returns an iterator." and by[1, 3].text == "Yes." and by[1, 4].text == "Ok > fine."
    assert by[1, 2].n_quotes == 2 and by[1, 2].max_level == 2 and by[2, 0].parent_turn is None and by[3, 0].text == "" and by[5, 0].max_level == 50
    assert linked(spark, rows[:1])[0].n_quotes == 0
    assert linked(spark, []) == []


def test_whole_paragraph_links(spark):
    got = {r.turn: r for r in linked(spark, [(1, 0, "u", "First line\nsecond line.\n\nA paragraph of two\nlines here."), (1, 5, "u", "> A paragraph of two\n> lines here.\nReply."), (1, 9, "u", "> Reply to nothing\n>> First line\nNo.")])}
    assert got[5].parent_turn == 0 and got[9].parent_turn == 0 and got[5].depth == 1


def test_trimmed_rewrapped_and_short_quotes_link(spark):
    rows = [
        (1, 0, "u", "Sorting is slow here. Is there a faster way? I have a long list\nof names. They are mostly sorted.\n\nThanks!"),
        (1, 1, "a", "> Is there a faster way?\nYes."),
        (1, 2, "u", "> Yes.\nWhy?"),
        (1, 3, "a", "> I have a long\n> list of names. They\n> are mostly sorted.\nThen use insertion."),
        (1, 4, "u", "> Why?\nNever mind."),
        (1, 5, "a", "Thanks!\nThen use insertion.\nIt is quick."),
        (1, 6, "u", "> Thanks!\n> Then use insertion.\nGood."),
        (1, 7, "u", "> Thanks!\nok"),
    ]
    got = {r.turn: r for r in linked(spark, rows)}
    assert [got[t].parent_turn for t in range(8)] == [None, 0, 1, 0, 2, None, 5, 0]
    assert [got[t].depth for t in range(8)] == [0, 1, 2, 1, 3, 0, 1, 1]


# 8: vectors


def brute_links(rows, least=0.98):
    ok = [(i, np.array(v, float), g) for i, v, g in rows if v and g is not None and i is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = set()
    for a in range(len(ok)):
        for b in range(a):
            (i, v, g), (j, u, h) = ok[a], ok[b]
            if i != j and g == h and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= least:
                links.add((min(i, j), max(i, j)))
    return links


@pytest.mark.parametrize("shard", [40, 100_000])
def test_vectors(spark, shard):
    g = np.random.default_rng(8)
    rows = []
    for c in range(40):
        centre = g.normal(size=16)
        for _ in range(int(g.choice([1, 3, 12]))):
            rows.append((len(rows) * 2, (centre + g.normal(size=16) * 0.05 * g.random()).astype(np.float32).tolist(), c % 3))
    rows += [(9000 + i, rows[0][1], rows[0][2]) for i in range(30)]
    rows += [(9100, None, 1), (9101, [], 1), (9102, [0.0] * 16, 1), (9103, [float("nan")] * 16, 1), (9104, [None] + [1.0] * 15, 1), (9105, rows[3][1], None), (9106, [1.0, 2.0], 1), (9107, [2.0, 4.0], 1), (9108, [float("inf")] * 16, 1), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<float>, label int, n string, kept string")
    got = hnsw.near_vectors(df, shard=shard, block=shard).collect()
    assert len(got) == len(rows)
    links = brute_links(rows)
    degree = Counter(i for pair in links for i in pair)
    comp = components({r[0] for r in rows}, links)
    assert all((r.n_links, r.component_id, r.kept) == (degree[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id) for r in got)
    assert hnsw.near_vectors(df.limit(0)).count() == 0


def test_graph_recall_and_wide_groups():
    g = np.random.default_rng(1)
    x = g.normal(size=(4000, 32))
    x[1000:1400] = x[0] + g.normal(size=(400, 32)) * 0.02
    x[2000:3000] = x[:1000] + g.normal(size=(1000, 32)) * 0.03
    unit = hnsw._unit(x)
    a, b = hnsw._pairs(hnsw.Graph(unit), x, x, 0.98)
    true = {(i, j) for i, j in zip(*np.nonzero(unit.astype(float) @ unit.T.astype(float) >= 0.98))}
    found = set(zip(a.tolist(), b.tolist()))
    assert len(found & true) / len(true) > 0.995 and len(found - true) <= len(true) * 1e-4


# 9: records

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_records_round_trip(spark, rng):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    alphabet = "aAbBzZéÉßİŸñ'’`\"#,.!?_-+=<>|&@[]^{}~ 019²½ªº×÷\t\n\r\x0b\x1c\x85\xa0  ıſΣσς́ñǅẞㄱ中あ😀"
    texts = ODD + [prose(rng, 30), "it's we'll I'M don't!''s a's,b", "<|endoftext|> a<|ENDOFTEXT|>b"] + ["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(300)]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    base, index = records.write_records(documents(spark, rows), TOKENIZER)
    got = {r.doc_id: r for r in records.read_records(spark, base, with_ids=True).collect()}
    start = 0
    for d, t in sorted(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        r = got[d]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids)
        start += len(ids)
    some = {r.doc_id: r.ids for r in records.fetch(index.where("doc_id % 2 = 0").orderBy(F.rand(1)), base).collect()}
    assert len(some) > 100 and all(got[d].ids == ids for d, ids in some.items())


def test_records_damage_repeats_and_emptiness(spark):
    base, index = records.write_records(documents(spark, [(1, "b"), (1, "a"), (None, "c"), (2, "d")]), TOKENIZER)
    assert [r.doc_id for r in records.read_records(spark, base).orderBy("start").collect()] == [None, 1, 1, 2]
    empty, _ = records.write_records(documents(spark, []), TOKENIZER)
    assert records.read_records(spark, empty).count() == 0
    import io

    good = records.frame(b"abcdef")
    assert list(records.records(io.BytesIO(good + good))) == [b"abcdef"] * 2
    for at in (0, 9, 14, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.records(io.BytesIO(bytes(bad))))


# 10: language


def test_language(spark, rng):
    rows = [(d, prose(rng, 40, lang), lang) for d, lang in enumerate(["en", "fr", "de"] * 80)]
    odd = [(1000 + i, t, None) for i, t in enumerate(ODD + ["123 !?", "中文", "\x00\x01"])] + [(None, "the of and", "en"), (1, rows[1][1], "fr"), (5000, None, "de")]
    docs = documents(spark, rows + odd)
    model = langid.train(docs)
    out = langid.predict(docs, model).toPandas()
    assert len(out) == len(rows) + len(odd) and out.score.between(0, 1).all()
    truth = {d: lang for d, _, lang in rows}
    held = out[(out.held_out == True) & out.doc_id.isin(truth)]  # noqa: E712
    assert len(held) > 30 and (held.lang_pred == held.doc_id.map(truth)).mean() > 0.98
    und = set(out[out.lang_pred == "und"].doc_id.dropna().astype(int))
    assert und == {1000, 1001, 1002, 1007, 1009, 5000}
    assert set(langid.predict(docs, langid.train(docs.limit(0))).toPandas().lang_pred) == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_code_lengths_against_plain_ppm():
    """The tables against a dictionary model: escape to the next shorter context, add up bits."""
    texts = {"a": [b"banana bandana", b"ananas"], "b": [b"mississippi", b"missing miss"]}
    grams = [(k, i, lang) for k, lang in enumerate(texts) for i in texts[lang]]
    counts = Counter()
    for k, t, _ in grams:
        padded = b"\n" * langid.ORDER + t
        for i in range(langid.ORDER, len(padded)):
            counts[k, int.from_bytes(padded[i - langid.ORDER : i + 1], "big")] += 1
    keys = sorted(counts)
    m = langid.Model(["a", "b"], np.array([k for k, _ in keys]), np.array([g for _, g in keys]), np.array([counts[k] for k in keys]))
    tables = [defaultdict(Counter) for _ in texts]
    for k, t, _ in grams:
        padded = b"\n" * langid.ORDER + t
        for i in range(langid.ORDER, len(padded)):
            for o in range(langid.ORDER + 1):
                tables[k][padded[i - o : i]][padded[i]] += 1

    def prob(table, context, c):
        below = 1 / 256 if not context else None
        seen = table.get(context)
        rest = below if below is not None else prob(table, context[1:], c)
        if not seen:
            return rest
        total = sum(seen.values()) + len(seen)
        return seen[c] / total if seen[c] else len(seen) / total * rest

    sample = b"banished mission, xyz"
    padded = b"\n" * langid.ORDER + sample
    want = [sum(-np.log2(prob(t, padded[i - langid.ORDER : i], padded[i])) for i in range(langid.ORDER, len(padded))) for t in tables]
    got = m.code_lengths(np.frombuffer(sample + sample, np.uint8), np.array([0, len(sample), 2 * len(sample)]))
    assert np.allclose(got, [want, want], rtol=1e-5)


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    from cohesia.llm.common import saved

    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = saved(stage(spark, docs, d), name)
        if name != "records":
            assert docs.columns == before.columns and docs.count() <= before.count()
            assert docs.exceptAll(before).count() == 0
        if name == "mix":
            assert docs.count() == before.count()
            order = [r.doc_id for r in docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert [r.doc_id for r in docs.orderBy("start").collect()] == order
    left = before.toPandas()
    sets = {r.doc_id: shingle_set(r.text, 5) for r in left.itertuples()}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in index[x] if j < i).items():
            assert 100 * n < 80 * (len(s) + len(sets[j]) - n)
    assert isinstance(left, pd.DataFrame) and corpus_pipeline.run(spark, d).count() == len(left)


def test_ordinary_strings_come_from_every_document(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("see "), F.translate(F.lpad(F.col("id").cast("string"), 14, "0"), "0123456789", "abcdefghij")).alias("text"))
    ordinary = secrets.samples(docs).where("label = 0")
    assert ordinary.select("value").distinct().count() == 6000


def test_samples_read_the_texts_once(spark, rng, tmp_path):
    """One pass gives the strings that the patterns give one by one; odd cases of secrets leave no ordinary words behind."""
    parts = ["ToKeN: ab", "api-key=internationalization", "PASSWD='Some_long-Value_here'", "akia" + "Q7" * 9, "DEADBEEF" * 4, "deadbeefdead", "mytoken=abcdefghijkl", "AKIA" + "B2" * 8, "0123456789abcdef" * 2, "snake_case_of_words", "kebab-case-of-words", "x1" * 9, "donaudampfschiff", "internationalization", "path/of/some/words", "é😀secret:longenough", "abcdefghijklmnopqrst1"]
    texts = [" ".join(rng.sample(parts, 4)) for _ in range(300)] + [t for t in ODD if t is None or len(t) < 20]
    path = str(tmp_path / "documents")
    documents(spark, list(enumerate(texts))).write.parquet(path)
    found = secrets.samples(spark.read.parquet(path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {label: Counter(r.value for r in found.where(F.col("label") == label).collect()) for label in (0, 1)}
    drop, edge = "(?i:" + "|".join(p.replace("(?i)", "") for p in (secrets.ASSIGN, secrets.ACCESS, secrets.HEX)) + ")", "[A-Za-z0-9+/_=-]"
    plain = [re.sub(drop, " ", t or "") for t in texts]
    assert got[0] == Counter(w for t in plain for w in re.findall(f"(?<!{edge})[A-Za-z_-]{{12,}}(?!{edge})", t))
    values = Counter(m[2] if k == "assign" else m[0] for t in texts for k, p, ok in BASE for m in re.finditer(p, t or "") if ok(m))
    digests = {w: base64.b64encode(hashlib.sha256(w.encode()).digest()).decode() for w in got[0]}
    drawn = [w for w, d in digests.items() if d in got[1]]
    assert drawn and got[1] == values + Counter({x: got[0][w] for w in drawn for x in (digests[w], re.sub("[+/=]", "", digests[w]))})
