"""Lexical search, the prefix trie and URL filters against brute force, and on awkward rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracehound.llm import lexical_search, prefix_trie, url_filter

from corpora import sentence, vocabulary

# ---- ranked lexical search -------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_search(docs, items, top=20):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    total = [sum(b.values()) for _, b in bags]
    n_docs, length = sum(x > 0 for x in total), sum(total)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        want, scored = terms(text), []
        for (d, b), n in zip(bags, total):
            s = 0
            for w in want:
                if w in b:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    m = 100 - 25 + (25 * n * n_docs) // length
                    s += weight * ((1000000000 * b[w]) // (1000 * b[w] + 12 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        scored.sort(key=lambda x: x[:3])
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(scored[:top])]
    return sorted(out, key=str)


def items_df(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "item_id long, text string, doc_id string, score string, rank int")


def got_rows(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


@pytest.fixture(scope="module")
def search_corpus():
    rng = random.Random(3)
    v = vocabulary(rng, 300) + ["Über", "naïve", "x1", "42", "中文"]
    rows = [(k, sentence(rng, rng.choice([1, 5, 40, 40, 200]), v)) for k in range(600)]
    rows += [(1000 + k, rows[7][1]) for k in range(70)]                      # ties: more copies than places
    rows += [(2000, None), (2001, ""), (2002, "-- !! --"), (None, rows[7][1]), (7, "again " + rows[3][1]), (2003, sentence(rng, 20_000, v))]
    rng.shuffle(rows)
    items = [(k, " ".join(sentence(rng, 12, v).split() + rows[k][1].split()[:9] if rows[k][1] else [])) for k in range(40)]
    items += [(50, None), (51, "unseenword"), (52, "the the " + rows[7][1] if rows[7][1] else "the"), (52, "AbC"), (None, rows[30][1])]
    return rows, items


def test_search_is_brute_force(spark, make_docs, search_corpus, monkeypatch):
    rows, items = search_corpus
    monkeypatch.setattr(lexical_search, "BUCKET_DOCS", 16)    # many buckets, so that bounds matter
    docs = make_docs(rows).repartition(3)
    got = lexical_search.digest(docs, items_df(spark, items))
    assert got_rows(got) == brute_search(rows, items)


def test_search_in_blocks_and_pages(spark, make_docs, search_corpus, monkeypatch):
    rows, items = search_corpus
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lexical_search, "PAGE_BYTES", 500)
    monkeypatch.setattr(lexical_search, "RUN_COORDS", 300)
    got = lexical_search.digest(make_docs(rows).repartition(2), items_df(spark, items[:12]).repartition(3))
    assert got_rows(got) == brute_search(rows, items[:12])


def test_search_empty_tables(spark, make_docs, search_corpus):
    rows, items = search_corpus
    none = make_docs([])
    assert lexical_search.digest(none, items_df(spark, items)).collect() == []
    assert lexical_search.digest(make_docs(rows[:5]), items_df(spark, [])).collect() == []
    assert lexical_search.digest(make_docs([(1, None), (2, "!")]), items_df(spark, [(1, "a b")])).collect() == []


def test_buckets_are_skipped(search_corpus):
    """The bounds do cut: with a threshold, most buckets and documents are never scored."""
    import numpy as np
    import pyarrow as pa
    weight = np.array([1000] * 50, np.int64)
    rng = np.random.default_rng(1)
    rows = []
    for k in range(40):
        coords = np.full(32, 4)
        term = np.concatenate([np.sort(rng.choice(50, 4, replace=False)) for _ in range(32)])
        impact = rng.integers(1, 1 + 100_000 // (k + 1), 128)
        square = np.add.reduceat(weight[term] * impact.astype(float) ** 2, np.arange(0, 128, 4))
        rows.append((float(np.sqrt(square.max())), np.arange(32 * k, 32 * k + 32).astype("<i8").tobytes(), coords.astype("<i4").tobytes(),
                     term.astype("<i4").tobytes(), impact.astype("<i4").tobytes()))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["longest", "doc_id", "coords", "term", "impact"])
    q = lexical_search.Query(1, 9, {3: 1, 7: 2, 11: 1}, weight)
    free = [r for b in lexical_search._search([q], weight, {})(iter([batch])) for r in b.to_pylist()]
    bound = min(r["score"] for r in free)
    tight = [r for b in lexical_search._search([q], weight, {1: bound})(iter([batch])) for r in b.to_pylist()]
    assert tight == free and sum(q.norm * r[0] < bound for r in rows) > 20


# ---- prefix trie --------------------------------------------------------------------------------
def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    seqs = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[:d - 1]].add(s[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conv_df(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows],
                                 "conv_id long, turn long, role string, text string, keys string, depth string, pid int")


def trie_rows(df):
    return sorted([tuple(r) for r in df.select(*prefix_trie.NODE).collect()], key=str)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(8)
    words = ["a", "bb", "ccc", "", "é中", "long " * 50]
    rows = []
    for c in list(range(0, 230)) + [305, 9_999_999_999, -7, -250, 700]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 9])):
            rows.append((c, t, rng.choice(["user", "user", "user", None]), rng.choice(words[:2] if t < 3 else words)))
    same = [(t, "user", f"copy {t}") for t in range(7)]
    rows += [(c, *t) for c in range(400, 520) for t in same]                         # a hot group of equal conversations
    rows += [(c, t, "user", f"copy {t}") for c in range(520, 530) for t in range(c - 517)]   # prefixes and extensions of it
    rows += [(600, t, "user", f"deep {t}") for t in range(300)] + [(601, t, "user", f"deep {t}") for t in range(290)]
    rows += [(610, None, None, None), (610, None, "z", "first"), (610, 2, "b", "tie"), (610, 2, "a", "tie"), (610, 2, "a", "other"),
             (610, 2, "a", "other"), (None, 1, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_trie_is_brute_force(spark, conversations, partitions, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 7)
    convs = prefix_trie.rebuilt(prefix_trie.conversations_in_order(conv_df(spark, conversations).repartition(3)))
    assert trie_rows(prefix_trie.prefix_trie(convs, partitions)) == brute_trie(conversations)


def test_trie_empty_and_single(spark):
    assert prefix_trie.digest(conv_df(spark, [])).collect() == []
    assert prefix_trie.digest(conv_df(spark, [(None, 1, "a", "b")])).collect() == []
    one = [(0, 0, "user", None)]
    assert trie_rows(prefix_trie.digest(conv_df(spark, one))) == brute_trie(one)
    bare = [(123_457, 0, "user", "gone")]    # h of this id is above 0 and there is no conversation 123400: turnless
    assert zlib.crc32(b"123457") % 6 > 0
    assert trie_rows(prefix_trie.digest(conv_df(spark, bare))) == brute_trie(bare)


# ---- URL filters -----------------------------------------------------------------------------------
URLS = [
    ("https://www.Example.com/en/7?x=1", "www.example.com", "/en/7", "www.example.com/en/", "allow"),
    ("http://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://shop.example.com/en/1#top", "shop.example.com", "/en/1", "example.com/en/", "block"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("ftp://a.b.net/es/x", "a.b.net", "/es/x", "net/es/", "block"),
    ("http://net/fr/9", "net", "/fr/9", "net/fr/", "block"),
    ("http://a.net/es", "a.net", "/es", None, None),
    ("http://x.com", "x.com", "", None, None),
    ("http://x.com?q=/en/", "x.com", "", None, None),
    ("http://X.ORG:80#/p", "x.org:80", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("no scheme/at/all", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://ÄB.org/" + "a/" * 3000, "Äb.org", "/" + "a/" * 3000, None, None),
]


def pages_df(spark, urls):
    return spark.createDataFrame([(k, u, "x", "x", "x", 1.0) for k, u in enumerate(urls)],
                                 "page_id long, url string, host string, path string, template string, purity double")


def labels_df(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, key string")


def test_url_parts_and_rules(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.digest(
        pages_df(spark, [u[0] for u in URLS] + [URLS[0][0]]), labels_df(spark, [])).collect()}
    assert len(got) == len(URLS) + 1 and got[len(URLS)] == got[0]
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert got[k] == (host, path, rule, verdict or "allow")   # nothing labelled: allowed


def test_url_filter_empty(spark):
    assert url_filter.digest(pages_df(spark, []), labels_df(spark, [(1, 1, 0)])).collect() == []


def test_bad_templates_are_rejected(spark):
    """On one host /deal/ pages are bad and /news/, /blog/ pages good, each with numbers, names of
    their own and unlabelled pages; another host is all good; labels repeat, clash and are null."""
    rng = random.Random(4)
    urls, labels, want = [], [], {}
    for k in range(900):
        kind = rng.choice(["news", "blog", "deal"])
        slug = "".join(rng.choice("abcdefgh") for _ in range(8))
        urls.append(f"http://one.org/{kind}/{slug}/{k}.html")
        want[k] = "block" if kind == "deal" else "allow"
        if rng.random() < 0.4:
            bad = (kind == "deal") != (rng.random() < 0.1)
            labels.append((k, 0 if bad else 1, 0) if rng.random() < 0.5 else (k, 1, int(bad)))
    urls += [f"http://two.org/deal/{k}" for k in range(900, 1000)]
    labels += [(k, 1, 0) for k in range(900, 960)] + [(3, None, None), (None, 0, 0), (901, 1, None)] + labels[:50]
    got = {r.page_id: r for r in url_filter.digest(pages_df(spark, urls), labels_df(spark, labels)).collect()}
    assert all(got[k].verdict == v for k, v in want.items())
    assert all(got[k].verdict == "allow" for k in range(900, 1000))
    assert got[0].template.startswith("/blog|news/*/") == (want[0] == "allow")
    assert len({got[k].template for k in want}) == 2    # names are wildcards, news and blog merged


@pytest.mark.parametrize("name", ["pages", "random"])
def test_url_filter_is_its_sql(spark, name):
    if name == "pages":
        pages, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("pages", "labels"))
    else:
        rng = random.Random(9)
        urls = [f"http://h{rng.randint(0, 3)}.org/" + "/".join(rng.choice("abc") + str(rng.randint(0, 9)) * rng.randint(0, 2)
                                                                for _ in range(rng.randint(0, 11))) for _ in range(1500)] + [None]
        pages = pages_df(spark, urls)
        labels = labels_df(spark, [(rng.randint(0, 99), rng.choice([0, 1, 1, None]), rng.choice([0, 0, 1])) for _ in range(150)])
    con = duckdb.connect()
    for t, df in (("pages", pages), ("labels", labels)):
        con.register(t, df.toPandas().astype(object).convert_dtypes() if t == "labels" else df.select("page_id", "url").toPandas())
    mine = url_filter.digest(pages, labels)
    theirs = con.execute(url_filter.DIGEST_SQL)
    cols = [c[0] for c in theirs.description]
    assert sorted(map(str, [tuple(r) for r in mine.select(*cols).collect()])) == sorted(map(str, theirs.fetchall()))


def test_registered_queries_are_their_sql(spark):
    from tracehound.llm.queries import ORACLE_SQL, QUERIES
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    for q in ("op11_lexical_search", "op12_prefix_trie"):
        theirs = con.execute(ORACLE_SQL[q])
        cols = [c[0] for c in theirs.description]
        assert sorted(map(str, [tuple(r) for r in QUERIES[q](spark, sf).select(*cols).collect()])) == sorted(map(str, theirs.fetchall()))
