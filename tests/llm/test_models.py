"""Mixing, classifiers, extraction, sharding, language model and rules against plain versions."""
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tracehound.llm import html_extract, language_id, mixing, ngram_lm, pages, quality_classifier, quality_rules, sharding

from corpora import sentence, vocabulary


# --- 2: mixing -----------------------------------------------------------------------------

def solve(n, p, want):
    """Nonnegative least squares by many plain projected-gradient steps."""
    share = n / n.sum()
    r = np.ones(len(n))
    step = 1 / np.linalg.eigvalsh((p * share[:, None]).T @ p)[-1]
    for _ in range(60_000):
        r = np.maximum(0, r - step * (p @ ((r * share) @ p - want)))
    return (r * share) @ p


@pytest.mark.parametrize("want", [(0.5, 0.3, 0.2), (0.98, 0.01, 0.01)])
def test_rates_fit_the_targets(spark, want):
    rng = np.random.default_rng(3)
    p = rng.dirichlet((0.6, 0.4, 0.2), 300)
    n = rng.integers(0, 400, 300)
    table = spark.createDataFrame([(k, k, int(n[k]), *map(float, p[k])) for k in range(300)], "rid long, doc_id long, n_tokens long, p_a double, p_b double, p_c double")
    out = mixing.fit_rates(table, dict(zip("abc", want)), steps=200).orderBy("rid").toPandas()
    assert (out.rate >= 0).all() and (out.rate[n == 0] == 1).all()
    got = ((out.rate * n / n.sum()).to_numpy()[:, None] * p).sum(axis=0)
    best = solve(n, p, np.array(want))
    assert np.abs(got - want).max() <= np.abs(best - want).max() + 4e-3


def test_largest_mix_without_repetition(spark):
    table = spark.createDataFrame([(k, k, 10, float(k < 8), float(k >= 8)) for k in range(10)], "rid long, doc_id long, n_tokens long, p_a double, p_b double")
    out = {r.rid: r.rate for r in mixing.fit_rates(table, {"a": 1.0, "b": 0.0}, upsample=False).collect()}
    assert all(abs(out[k] - (k < 8)) < 1e-3 for k in range(10))


@pytest.mark.parametrize("share, sharp", [(0.01, False), (0.002, True), (0.002, False)])
def test_a_rare_domain_reaches_its_target(spark, share, sharp):
    rng = np.random.default_rng(9)
    rows = 2000
    kind = np.where(np.arange(rows) < share * rows, 2, (np.arange(rows) % 5 == 0).astype(int))
    p = np.eye(3)[kind] if sharp else 0.94 * np.eye(3)[kind] + 0.06 * rng.dirichlet((8, 4, 0.01), rows)
    table = spark.createDataFrame([(k, k, 100, *map(float, p[k])) for k in range(rows)], "rid long, doc_id long, n_tokens long, p_a double, p_b double, p_c double")
    rate = mixing.fit_rates(table, {"a": 0.85, "b": 0.05, "c": 0.10}).orderBy("rid").toPandas().rate.to_numpy()
    assert np.abs(rate @ p / rows - [0.85, 0.05, 0.10]).max() < 1e-3


def test_a_fit_that_does_not_converge_says_so(spark):
    table = spark.createDataFrame([(k, 10, k / 10, 1 - k / 10) for k in range(11)], "rid long, n_tokens long, p_a double, p_b double")
    with pytest.raises(RuntimeError, match="residual"):
        mixing.fit_rates(table, {"a": 0.9, "b": 0.1}, steps=1)


def test_domains_are_told_apart(spark, make_docs):
    rng = random.Random(2)
    v = vocabulary(rng, 300)
    rows = [(k, sentence(rng, 60, v) + (" vile nasty vile" if k % 4 == 0 else "")) for k in range(200)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(120)], "doc_id long, quality int, toxic int")
    got = mixing.digest(make_docs(rows), labels, {"good": 0.75, "toxic": 0.25}).collect()
    assert all((r.p_toxic > 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id >= 120)
    tokens = sum(r.n_tokens for r in got)
    assert abs(sum(r.rate * r.n_tokens * r.p_toxic for r in got) / tokens - 0.25) < 5e-3
    assert all(r.copies in (math.floor(r.rate), math.ceil(r.rate)) for r in got)


# --- 3: quality classifier -----------------------------------------------------------------

def test_held_out_accuracy(spark, make_docs):
    rng = random.Random(4)
    v = vocabulary(rng, 300)
    rows = [(k, sentence(rng, 80, v) if k % 3 else " ".join(w + "!!" for w in sentence(rng, 20, v).upper().split()) + " " + "spam " * 40) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(240)], "doc_id long, quality int")
    got = quality_classifier.digest(make_docs(rows), labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(240) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)


def test_a_score_is_a_sparse_dot_product(spark, make_docs):
    w = np.random.default_rng(1).normal(size=1 << quality_classifier.BITS).astype(np.float32)
    text = "One two two three. FOUR 5 two two"
    idx, val = quality_classifier.features(text)
    assert len(set(idx.tolist())) == len(idx) and abs((val[1:] ** 2).sum() - 1) < 1e-5
    want = 1 / (1 + math.exp(-sum(float(w[i]) * float(x) for i, x in zip(idx, val))))
    assert abs(quality_classifier.score(make_docs([(1, text)]), w).first().score - want) < 1e-5


def test_ftrl_is_the_plain_rule(spark, make_docs):
    """The learnt weights against FTRL-proximal written out per coordinate, and the scores of the
    registered query against those weights, shards and all."""
    q = quality_classifier
    rng = random.Random(21)
    v = vocabulary(rng, 60)
    rows = [(k, sentence(rng, rng.randint(1, 25), v)) for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int")
    docs = make_docs(rows)
    learn = spark.createDataFrame([(k,) for k in range(60) if zlib.crc32(str(k).encode()) % 5], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()
    models = []
    for shard in range(q.SHARDS):
        mine = sorted((r.h, r.doc_id) for r in learn if r.h % q.SHARDS == shard)
        if not mine:
            continue
        z, n, used = {}, {}, set()

        def w(i):
            if abs(z.get(i, 0.0)) <= q.L1:
                return 0.0
            return (math.copysign(q.L1, z[i]) - z[i]) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)
        for _ in range(q.EPOCHS):
            for _, doc in mine:
                idx, val = q.features(dict(rows)[doc])
                pairs = [(int(i), float(x)) for i, x in zip(idx, val)]
                ws = {i: w(i) for i, _ in pairs}
                p = 1 / (1 + math.exp(-sum(ws[i] * x for i, x in pairs)))
                for i, x in pairs:
                    g = (p - int(doc % 3 > 0)) * x
                    sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / q.ALPHA
                    z[i] = z.get(i, 0.0) + g - sigma * ws[i]
                    n[i] = n.get(i, 0.0) + g * g
                    used.add(i)
        models.append({i: w(i) for i in used})
    mean = lambda i: sum(m.get(i, 0.0) for m in models) / len(models)
    for r in q.digest(docs, labels).collect():
        idx, val = q.features(dict(rows)[r.doc_id])
        assert abs(r.score - 1 / (1 + math.exp(-sum(mean(int(i)) * float(x) for i, x in zip(idx, val))))) < 1e-4


# --- 5: HTML extraction --------------------------------------------------------------------

def test_min_cut_is_minimal():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(1, 7)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side):
            return (sum(max(g, 0) for g, s in zip(gain, side) if not s) + sum(max(-g, 0) for g, s in zip(gain, side) if s)
                    + sum(c for a, b, c in edges if side[a] != side[b]))
        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(html_extract.min_cut(gain, edges)) - best) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var a="</p>";x(1 < 2);</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav><!-- ad --><div class="cookie-notice">We use
cookies.</div><main><article><header><h2>The   title &amp; more</h2></header><p>First <b>bold</b> para&shy;graph,<br>with a break.<p>Second, &lt;unclosed&gt; one.
<div class="ad">Buy now!</div><ul><li>An item that has several words in it.</li></ul><p><p>Third.</p><section class="comments"><p>Nice article, thanks a lot for writing it!</p></section></article></main>
<aside class="sidebar"><p>Related things to read elsewhere.</p></aside><form><label>Name</label><input><button>Send</button></form><footer>&copy; 2020 Site.</footer></body></html>"""


def test_extraction():
    want = "The title & more\n\nFirst bold para­graph, with a break.\n\nSecond, <unclosed> one.\n\nAn item that has several words in it.\n\nThird."
    assert html_extract.main_text(PAGE, html_extract.PRIOR) == want


def test_nothing_else_is_dropped():
    """Formulas and fallbacks inside the article stay, and an element that is never closed takes nothing
    with it."""
    page = ("<body><nav><a href=1>Home</a></nav><article><p>The area is <math><mi>pi</mi><mo>times</mo><mi>r squared</mi></math> for any circle.</p>"
            "<p>See the <object>drawing described here in words</object> and <svg><text>its label</text></svg> for more.</p>"
            "<noscript>Please switch scripts on.</noscript><p>The paragraph after it is read to its very end.</p>"
            "<noscript><p>And so is the one behind an element without an end.</p></article></body>")
    got = html_extract.main_text(page, html_extract.PRIOR)
    for piece in ("area is pitimesr squared for any", "drawing described here in words and its label", "after it is read", "behind an element without"):
        assert piece in got
    assert "switch scripts" not in got and "Home" not in got


@pytest.mark.parametrize("page, blocks", [
    ("<a " * 350_000, 1), ('<a "' * 250_000, 1), ("<aaaa" * 200_000, 1), ("<p>some words here, and more.</p><li><a>x</a></li>" * 50_000, 100_000),
    ("<div>x " * 100_000, 100_000), ("<nav>x " * 100_000, 100_000), ("<span>" * 50_000 + "</x>" * 50_000 + "<h1>a" * 50_000, 50_000),
    ("<!--" * 200_000, 0), ("<noscript>" * 50_000 + "kept", 1)], ids=lambda x: str(x)[:12])
def test_long_pages_take_linear_time(page, blocks):
    import time
    start = time.process_time()
    found = html_extract.blocks(page)
    html_extract.main_text(page, html_extract.PRIOR)
    assert len(found) == blocks and time.process_time() - start < 30


def test_cut_of_a_long_chain_is_minimal():
    """Against dynamic programming along a chain of 3,000 nodes with weak and strong gains."""
    rng = random.Random(12)
    gain = [rng.choice([0.05, 0.4, 2]) * rng.uniform(-1, 1) for _ in range(3000)]
    edges = [(k, k + 1, rng.uniform(0, 0.5)) for k in range(2999)]
    side = html_extract.min_cut(gain, edges)
    cost = sum(abs(g) for g, s in zip(gain, side) if (g > 0) != s) + sum(c for a, b, c in edges if side[a] != side[b])
    out, inside = max(gain[0], 0), max(-gain[0], 0)
    for g, (_, _, c) in zip(gain[1:], edges):
        out, inside = min(out, inside + c) + max(g, 0), min(inside, out + c) + max(-g, 0)
    assert abs(cost - min(out, inside)) < 1e-6


def test_extraction_without_roles(spark):
    """The classifier learns from marked pages and serves a page that marks nothing."""
    bare = ("<html><body><div><a href=1>Home</a> <a href=2>News</a></div><div>A long first paragraph with many words, some commas, and an end.</div>"
            "<div>Another long paragraph follows here, again with many words in it, and ends.</div><div><a href=3>Imprint</a></div></body></html>")
    rows = [(k, "u", PAGE) for k in range(5)] + [(9, None, bare)]
    got = {r.page_id: r for r in html_extract.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9].text == ("A long first paragraph with many words, some commas, and an end.\n\n"
                           "Another long paragraph follows here, again with many words in it, and ends.")
    assert got[9].n_chars == len(got[9].text) and "Nice article" not in got[1].text and "Third." in got[1].text


# --- 7: language ---------------------------------------------------------------------------

def test_languages(spark, make_docs):
    rng = random.Random(6)
    words = {"en": vocabulary(rng, 200, "abcdeghiklmnorstw"), "fr": vocabulary(rng, 200, "éèaeioulmnrst"), "xx": vocabulary(rng, 200, "бвгджзиклмн")}
    rows = [(k, sentence(rng, rng.randint(8, 60), words[lang]), lang) for k, lang in enumerate(["en", "en", "en", "fr", "xx"] * 60)]
    got = language_id.digest(make_docs(rows)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k, *_ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_a_language_is_the_smallest_compression(spark, make_docs):
    """Every prediction against compressing the text with each dictionary; every sampled text is in its
    language's dictionary, from its start to its end."""
    import zstandard
    rng = random.Random(16)
    words = {"aa": vocabulary(rng, 80, "abcdefg"), "bb": vocabulary(rng, 80, "efghijk"), "cc": vocabulary(rng, 80, "ijklmno")}
    rows = [(k, sentence(rng, rng.choice([3, 30, 900]), words[lang]), lang) for k, lang in enumerate(["aa", "bb", "cc", "aa"] * 30)]
    docs = make_docs(rows)
    held = language_id.learn(docs.where("doc_id < 100"))
    for k, text, lang in rows[:100]:
        for piece in ([text] if len(text) < 100 else [text[:40], text[-40:], text[len(text) // 3 + 20:len(text) // 3 + 50]]):
            assert piece.encode() in held[lang]
    got = {r.doc_id: r for r in language_id.predict(docs, held).collect()}
    for k, text, _ in rows:
        sizes = {}
        for lang, raw in held.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = len(zstandard.ZstdCompressor(dict_data=d, compression_params=language_id.PARAMETERS).compress(text.encode()))
        assert got[k].lang_pred == min(sizes, key=lambda x: (sizes[x], x))


def test_narrow_margins_are_rejected(spark, make_docs):
    docs = make_docs([(1, "zq")])
    same = {"aa": b"one two three four " * 40, "bb": b"one two three four " * 40}
    r = language_id.predict(docs, same, reject=True).first()
    assert (r.lang_pred, r.confident) == ("und", False)
    assert language_id.predict(docs, same).first().lang_pred == "aa"


# --- 8: sharding ---------------------------------------------------------------------------

def test_shards(spark, make_docs):
    rng = random.Random(8)
    rows = [(k, "the hot text") for k in range(700)]  # a third of all rows: more than a shard holds
    for g in range(150):
        rows += [(len(rows) + j, f"group {g}") for j in range(rng.randint(2, 8))]
    rows += [(len(rows) + j, f"single {j}") for j in range(2100 - len(rows) + 5)]
    got = sharding.digest(make_docs(rows)).collect()
    count = Counter(r.shard for r in got)
    assert sorted(count) == list(range(8)) and max(count.values()) - min(count.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    text = dict(rows)
    at = {}
    for r in got:
        at.setdefault(text[r.doc_id], set()).add(r.shard)
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    groups = [len(at[f"group {g}"]) for g in range(150)]
    assert sum(n == 1 for n in groups) >= 140  # by chance hardly any group would be whole
    hot = Counter(r.shard for r in got if text[r.doc_id] == "the hot text")
    assert sum(n for _, n in hot.most_common(3)) >= 400  # evenly dealt: 263


# --- 9: language model ---------------------------------------------------------------------

def plain_model(rows, learn):
    toks = {k: (t or "").lower().split() + [None] for k, t in rows}
    c1, c2, c0 = Counter(), Counter(), Counter()
    for k in learn:
        for a, b in zip([0, *toks[k]], toks[k]):
            c1[b] += 1
            c2[a, b] += 1
            c0[a] += 1
    return toks, c0, c1, c2


def test_language_model(spark, make_docs):
    rng = random.Random(12)
    v = vocabulary(rng, 60)
    rows = [(k, " ".join(x for w in sentence(rng, rng.randint(0, 30), v).split() for x in (w, w[::-1]))) for k in range(150)] + [(150, None)]
    learn = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 10]
    toks, c0, c1, c2 = plain_model(rows, learn)
    n, vocab = sum(c1.values()), len(c1)
    got = {r.doc_id: r for r in ngram_lm.digest(make_docs(rows)).collect()}
    side = ngram_lm._BINS + 2
    cells = Counter()
    for k in learn:
        for a, b in zip([0, *toks[k]], toks[k]):
            ctx = c0[a] - 1
            x = np.array([(c2[a, b] - 1) / max(ctx, 1), (c1[b] - 1) / (n - 1)])
            cells[(int(ngram_lm.context_class(np.array([ctx]))[0]) * side + int(ngram_lm._bin(x)[0])) * side + int(ngram_lm._bin(x)[1])] += 1
    at = sorted(cells)
    w = ngram_lm.learn_weights(np.array(at), np.array([cells[x] for x in at]), vocab)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all()
    prob = lambda a, b: float(w[ngram_lm.context_class(np.array([c0[a]]))[0]] @ [c2[a, b] / max(c0[a], 1), c1[b] / n, 1 / (vocab + 1)])
    for k, t in toks.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c1[x] > 0 for x in t), n)
        assert abs(r.base_score - sum(math.log10((c1[x] + 0.1) / (n + 0.1 * (vocab + 1))) for x in t)) < 1e-8
        assert abs(r.score - sum(math.log10(prob(a, b)) for a, b in zip([0, *t], t))) < 1e-8
    for a in [0, *list(c1)[:10]]:  # a distribution over the vocabulary and one unknown word
        if a is not None:
            assert abs(sum(prob(a, b) for b in c1) + prob(a, "unseen word") - 1) < 1e-9
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(5)
    side = ngram_lm._BINS + 2
    cells = np.unique(rng.integers(0, 20 * side * side, 400))
    n = rng.integers(1, 50, len(cells))
    prob = lambda b: np.where(b > 0, 2.0 ** (-(b - 1) / 2), 0.0)
    p = np.stack([prob(cells // side % side), prob(cells % side), np.full(len(cells), 1 / 101)])
    last = -np.inf
    for rounds in (1, 2, 5, 20, 60):
        w = ngram_lm.learn_weights(cells, n, 100, rounds)
        like = float((n * np.log((w[cells // (side * side)].T * p).sum(axis=0))).sum())
        assert like >= last - 1e-2
        last = like


def test_packed_numbers():
    rng = np.random.default_rng(7)
    for dtype in ("<u4", "<u8"):
        x = np.sort(rng.integers(0, 1 << 31, 1000)).astype(dtype)
        for y in (x, x[:1], x[:0]):
            assert (pages.stretch(pages.squeeze(y, True), dtype, True) == y).all() and (pages.stretch(pages.squeeze(y), dtype) == y).all()


# --- 10: rules -----------------------------------------------------------------------------

def test_measures():
    rng = random.Random(13)
    for _ in range(300):
        text = "".join(rng.choice("ab #\n\t|é") for _ in range(rng.randint(0, 120)))
        ws = text.replace("\t", " ").replace("\n", " ").split(" ")
        ws = [x for x in ws if x]
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure(text)))
        grams = Counter(tuple(ws[k:k + 8]) for k in range(len(ws) - 7))
        hit = {k + j for k in range(len(ws) - 7) if grams[tuple(ws[k:k + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if x.strip(" \t")]
        assert (m["n_words"], m["word_chars"], m["n_symbols"]) == (len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (m["n_repeat_words"], m["n_dup_lines"]) == (len(hit), len(lines) - len(set(lines)))


def test_policies_and_ablations(spark, make_docs):
    rng = random.Random(14)
    v = vocabulary(rng)
    rows = [(k, sentence(rng, rng.randint(5, 60), v) + (" ###" * 30 if k % 5 == 0 else "") + ("\nsame line" * 40 if k % 7 == 0 else "")) for k in range(120)]
    ledger = quality_rules.rule_ledger(make_docs(rows)).cache()
    masks = [r.rule_mask for r in ledger.collect()]
    for version, rules in quality_rules.POLICIES.items():
        full = quality_rules.policy_mask(version)
        assert [r.kept for r in quality_rules.apply_policy(ledger, version).collect()] == [m & full == 0 for m in masks]
        got = {r.rule: r for r in quality_rules.ablations(ledger, version).collect()}
        assert set(got) == set(rules)
        for rule, r in got.items():
            without = quality_rules.policy_mask(version, without=rule)
            assert r.n_kept == sum(m & full == 0 for m in masks) and r.n_failed == sum(m & quality_rules.BIT[rule] > 0 for m in masks)
            assert r.n_only == sum(m & without == 0 for m in masks) - r.n_kept
