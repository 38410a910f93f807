"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import (decontaminate, html_extract, jaccard_join, language_id, lexical_search, mixing, ngram_lm, prefix_trie, quality_classifier,
               quality_rules, sharding, token_codec, url_filter)
from .common import table


def op1_token_codec(spark, sf_dir):
    import public_tokenizers   # only this query needs it
    return token_codec.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_classifier(spark, sf_dir):
    return quality_classifier.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.digest(table(spark, sf_dir, "documents"))


def op5_html_extract(spark, sf_dir):
    return html_extract.digest(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark, sf_dir):
    return language_id.digest(table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    return sharding.digest(table(spark, sf_dir, "documents"))


def op9_ngram_lm(spark, sf_dir):
    return ngram_lm.digest(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark, sf_dir):
    return lexical_search.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.digest(table(spark, sf_dir, "conversations"))


def op13_url_filter(spark, sf_dir):
    return url_filter.digest(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_token_codec, op2_mixing, op3_quality_classifier, op4_jaccard_join, op5_html_extract, op6_decontaminate, op7_language_id, op8_sharding,
    op9_ngram_lm, op10_quality_rules, op11_lexical_search, op12_prefix_trie, op13_url_filter)}

ORACLE_SQL = {"op4_jaccard_join": jaccard_join.DIGEST_SQL, "op10_quality_rules": quality_rules.DIGEST_SQL,
              "op11_lexical_search": lexical_search.DIGEST_SQL, "op12_prefix_trie": prefix_trie.DIGEST_SQL,
              "op13_url_filter": url_filter.DIGEST_SQL}
