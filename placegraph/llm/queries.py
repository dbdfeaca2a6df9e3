"""Registered queries of the corpus operators, with SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placegraph.llm import (centroids, chat, embeddings, filter_audit, licenses, main_text, minhash, packing, pieces, quality, rules, sharding,
                            token_files)
from placegraph.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_minhash_near_dedup", minhash.SQL)
def op1(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), width=2)


@query("op2_sentencepiece_viterbi")
def op2(spark, sf):
    return pieces.piece_digests(table(spark, sf, "documents"))


@query("op3_quality_classifier")
def op3(spark, sf):
    return quality.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op4_best_two_fit_packing")
def op4(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op5_compression_bands")
def op5(spark, sf):
    return rules.quality_rules(table(spark, sf, "documents"))


@query("op6_rendezvous_sharding", sharding.SQL)
def op6(spark, sf):
    return sharding.shard_documents(table(spark, sf, "documents"))


@query("op7_rotated_codes_near_dedup", embeddings.SQL)
def op7(spark, sf):
    return embeddings.near_duplicate_vectors(table(spark, sf, "embeddings"))


@query("op8_chat_perspectives", chat.SQL)
def op8(spark, sf):
    return chat.perspectives(table(spark, sf, "conversations"))


@query("op9_token_files")
def op9(spark, sf):
    return token_files.token_file_round_trip(spark, table(spark, sf, "documents"))


@query("op10_license_patience")
def op10(spark, sf):
    return licenses.scan_licenses(table(spark, sf, "documents"))


@query("op11_filter_potentials", filter_audit.SQL)
def op11(spark, sf):
    return filter_audit.audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op12_vantage_point_clusters", centroids.SQL)
def op12(spark, sf):
    return centroids.cluster_vectors(table(spark, sf, "embeddings")).drop("opened")


@query("op13_page_differencing")
def op13(spark, sf):
    return main_text.extract_pages(table(spark, sf, "pages"))
