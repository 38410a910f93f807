"""Every operator on awkward rows (nulls, empty and long texts, ties, repeats, clashing extra
columns) and on empty tables."""
import pytest
from pyspark.sql import functions as F

from tracehound.llm import (decontaminate, html_extract, jaccard_join, language_id, mixing, ngram_lm, quality_classifier,
                            quality_rules, sharding, token_codec)

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, quality int, toxic int, y string, domain string")


LABELS = [(4, 1, 0), (4, 0, 0), (5, 0, 1), (6, None, None), (None, 1, 0), (8, 0, 0), (9, 1, 1)]


def run(name, spark, docs, with_labels=True):
    lab = labels(spark, LABELS if with_labels else [])
    items = docs.where("doc_id in (4, 7)").select(F.col("doc_id").alias("item_id"), "text", "page", "n")
    return {
        "op1": lambda: token_codec.digest(docs, BPE), "op2": lambda: mixing.digest(docs, lab),
        "op3": lambda: quality_classifier.digest(docs, lab), "op4": lambda: jaccard_join.digest(docs),
        "op5": lambda: html_extract.digest(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "n")),
        "op6": lambda: decontaminate.digest(docs, items), "op7": lambda: language_id.digest(docs),
        "op8": lambda: sharding.digest(docs), "op9": lambda: ngram_lm.digest(docs), "op10": lambda: quality_rules.digest(docs),
    }[name]()


OPS = [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name", OPS)
def test_empty_table(name, spark, make_docs, no_rows):
    assert run(name, spark, make_docs(no_rows), with_labels=False).collect() == []


@pytest.mark.parametrize("name", [x for x in OPS if x != "op6"])
def test_a_row_for_every_row(name, spark, make_docs, edge_rows):
    got = run(name, spark, make_docs(edge_rows)).collect()
    key = "page_id" if name == "op5" else "doc_id"
    assert sorted(str(r[key]) for r in got) == sorted(str(r[0]) for r in edge_rows)
    by = {}
    for r in got:
        by.setdefault(r[key], []).append(r)
    if name == "op1":
        assert [by[k][0].n_tokens for k in (1, 2)] == [1, 1]
        starts = sorted((r.start, r.n_tokens) for r in got)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    if name == "op2":
        assert by[1][0].rate == 1.0 and len({r.rate for r in by[4]}) == 1 and all(r.rate >= 0 for r in got)
    if name == "op3":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    if name == "op4":
        assert [by[k][0].n_shingles for k in (1, 2, 3, 7)] == [0, 0, 0, 1]
        assert [by[k][0].component_id for k in (1, 4, 5, 6, 7, None)] == [1, 4, 4, 4, 7, 4]
    if name == "op5":
        assert [by[k][0].text for k in (1, 2, 3)] == ["", "", ""]
    if name == "op7":
        assert [by[k][0].lang_pred for k in (1, 2, 3, 10)] == ["und"] * 4 and by[4][0].lang_pred == "en"
    if name == "op8":
        assert by[1][0].size == 1 and by[1][0].text_crc32 == 0 and all(r.grown_shard is None for r in got)
    if name == "op9":
        assert [by[k][0].n_tokens for k in (1, 2, 3)] == [1, 1, 1] and all(r.score <= 0 for r in got)
    if name == "op10":
        assert [by[k][0].base_failed for k in (1, 2, 3, 4)] == [True, True, True, False] and by[8][0].n_words == 60_000


def test_decontaminate_edges(spark, make_docs, edge_rows):
    got = run("op6", spark, make_docs(edge_rows)).collect()
    # item 4 (three equal rows of one id) is found in 4, 5, 6 and the null id; item 7 ("A b") only in itself
    assert sorted({(str(r.doc_id), r.item_id) for r in got}) == [("4", 4), ("5", 4), ("6", 4), ("7", 7), ("None", 4)]


@pytest.mark.parametrize("name", ["op2", "op3", "op7"])
def test_nothing_to_learn_from(name, spark, make_docs):
    docs = make_docs([(1, "some words here", None), (2, None, None)])
    got = {r.doc_id: r for r in run(name, spark, docs, with_labels=False).collect()}
    assert {"op2": lambda r: r.rate == 1.0, "op3": lambda r: r.score == 0.5, "op7": lambda r: r.lang_pred == "und"}[name](got[1])
