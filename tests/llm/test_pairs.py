"""Jaccard join and decontamination against brute force."""
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tracehound.llm import decontaminate, jaccard_join
from tracehound.llm import pages as pages_
from tracehound.llm.common import shingle_set

from corpora import sentence, vocabulary


def brute_components(rows):
    sets = {}
    for doc, text in rows:
        w = (text or "").lower().split()
        sets[doc] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.fixture(scope="module")
def corpus():
    """A group of near copies over several blocks and frequency classes, chains, a passage that
    most texts share, exact copies, short texts."""
    rng = random.Random(11)
    v = vocabulary(rng, 3000)
    rows, doc = [], 0
    base = sentence(rng, 90, v).split()
    for _ in range(300):  # near copies of one text, 1 to 4 words changed
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(v)
        rows.append((doc, " ".join(w)))
        doc += 1
    w = sentence(rng, 120, v).split()
    for _ in range(25):  # a chain: each differs a little from the one before
        w[rng.randrange(len(w))] = rng.choice(v)
        rows.append((doc, " ".join(w)))
        doc += 1
    passage = sentence(rng, 40, v)
    for _ in range(150):
        rows.append((doc, sentence(rng, rng.randint(5, 60), v) + " " + passage))
        doc += 1
    for _ in range(60):
        t = sentence(rng, rng.randint(1, 12), v[:12])
        rows += [(doc, t), (doc + 1, t.upper())]
        doc += 2
    return rows


def test_components(spark, make_docs, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.digest(make_docs(corpus)).collect()}
    assert got == brute_components(corpus)


def test_linked_sets_share_an_index_key(corpus):
    sets = [shingle_set(t) for _, t in corpus[:330]]
    df = Counter(x for s in sets for x in s.tolist())
    cls = [np.array([min(255, int(4 * np.log2(df[x]))) if df[x] > 1 else 0 for x in s.tolist()]) for s in sets]
    keys = [jaccard_join.index_keys(s, c) for s, c in zip(sets, cls)]
    assert sum(k is not None and (c >= jaccard_join.FREQUENT).any() for k, c in zip(keys, cls)) > 100
    for i in range(0, len(sets), 7):
        for j in range(len(sets)):
            n = len(np.intersect1d(sets[i], sets[j]))
            if i != j and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                assert len(np.intersect1d(keys[i], keys[j]))


def test_short_sets_keep_the_guarantee():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        n = int(rng.integers(1, 40))
        a = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        b = a.copy()
        b[: int(rng.integers(0, max(1, len(a) // 6) + 1))] += np.uint64(1 << 41)
        b = np.unique(b)
        pool = np.unique(np.concatenate([a, b]))
        cls = {x: int(rng.choice([4, 19, 20, 40])) for x in pool.tolist()}
        n_both = len(np.intersect1d(a, b))
        if 100 * n_both >= 75 * (len(a) + len(b) - n_both):
            ka, kb = (jaccard_join.index_keys(s, np.array([cls[x] for x in s.tolist()])) for s in (a, b))
            assert len(np.intersect1d(ka, kb))


def weighted(a, b):
    grams = lambda w: Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    x, y = grams(a), grams(b)
    return sum((x & y).values()), sum((x | y).values())


def test_decontamination(spark, make_docs):
    rng = random.Random(21)
    v = vocabulary(rng, 2000)
    items = [(k, sentence(rng, rng.randint(14, 60), v)) for k in range(40)] + [(40, "one two"), (41, None), (42, "la la la la la la la la la la la la")]
    rows = []
    for doc in range(200):
        w = sentence(rng, rng.randint(30, 200), v).split()
        k = rng.randrange(40)
        p = items[k][1].split()
        for _ in range(doc % 3):  # none, one or two words changed
            p[rng.randrange(len(p))] = rng.choice(v)
        if doc % 4:
            at = rng.randrange(len(w))
            w[at:at] = p if doc % 8 != 5 else p[: len(p) * 2 // 3]
        rows.append((doc, " ".join(w).upper() if doc % 2 else " ".join(w)))
    rows += [(500, "la " * 30), (501, "x one two y"), (502, "one two")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.digest(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    seen = defaultdict(list)
    for doc, text in rows:
        w = text.lower().split()
        for item, passage in items:
            p = (passage or "").split()
            if p and any(100 * n >= 75 * m for n, m in (weighted(w[s:s + len(p)], p) for s in range(max(1, len(w) - len(p) + 1)))):
                want.add((doc, item))
    assert len(want) > 60 and set(got) == want
    for (doc, item), r in got.items():
        w = rows[doc][1].lower().split() if doc < 200 else dict(rows)[doc].lower().split()
        n, m = weighted(w[r.start_word:r.start_word + r.n_words], dict(items)[item].split())
        assert abs(r.similarity - n / m) < 1e-12 and r.distance <= decontaminate.RADIUS


def test_windows_at_the_limit_with_one_differing_run(spark, make_docs):
    """Tails and middles replaced, as long as 0.75 is kept: many are beyond the radius."""
    rng = random.Random(23)
    v = vocabulary(rng, 2000)
    items = [(k, sentence(rng, rng.choice([25, 40, 60, 100]), v)) for k in range(20)]
    rows = []
    for k, passage in items:
        p = passage.split()
        for _ in range(10):
            for lost in range(len(p), 0, -1):
                w = p[:len(p) - lost] + [rng.choice(v) for _ in range(lost)]
                n, m = weighted(w, p)
                if 100 * n >= 75 * m:
                    break
            rows.append((len(rows), " ".join([rng.choice(v) for _ in range(9)] + w + [rng.choice(v) for _ in range(9)])))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.digest(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(k, k // 10) for k in range(len(rows))}
    assert any(r.distance > decontaminate.RADIUS for r in got.values())


def test_every_fingerprint_within_the_radius_meets(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(30)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = spark.createDataFrame([(k, 9, 5, signed(f)) for k, f in enumerate(prints)], "item long, len int, gram int, fingerprint long")
    index = defaultdict(set)
    for r in decontaminate.item_index(items).collect():
        index[r.block, r.value].add(r.item)
    for k, f in enumerate(prints):
        for _ in range(40):
            g = f
            for b in rng.sample(range(64), decontaminate.RADIUS):
                g ^= 1 << b
            keys = [(j, g >> decontaminate._START[j] & ((1 << decontaminate._WIDTH[j]) - 1)) for j in range(decontaminate.BLOCKS)]
            assert any(k in index[x] for x in keys)


def test_a_buckets_answers_take_little_memory():
    """A bucket's answers are those of a plain count, and take under 45 bytes a token at once (60 before)."""
    import tracemalloc
    rng = np.random.default_rng(5)
    pages = [np.unique(rng.integers(0, 1 << 21, 400_000, dtype=np.uint32)) for _ in range(4)]
    many = [np.arange(0, len(v), 1000, dtype="<u4") for v in pages]
    group = pd.DataFrame({"page": range(4), "bucket": 7, "vals": [pages_.squeeze(v, ascending=True) for v in pages], "many": [m.tobytes() for m in many],
                          "times": [np.full(len(m), 3, "<u4").tobytes() for m in many]})
    tracemalloc.start()
    out = jaccard_join._answers(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    df = np.zeros(1 << 21, np.int64)
    for v, m in zip(pages, many):
        df[v] += 1
        df[v[m]] += 2
    for r in out.itertuples():
        v = pages[r.page]
        want = v[df[v] > 1]
        assert r.bucket == 7 and (pages_.stretch(r.vals, "<u4", ascending=True) == want).all()
        assert (pages_.stretch(r.cls, "<u1") == np.floor(4 * np.log2(df[want])).astype(np.uint8)).all()
    assert peak < 45 * sum(map(len, pages)), peak / sum(map(len, pages))
