"""Registered queries of the corpus operators: thin wrappers that derive the contracts' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import decontam, html, licenses, linededup, ngramjoin, ordersketch, pii, quality, spm, toxicity, trie, urlgraph, whitening
from voxloom.llm.common import crc32_of_id, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text_of = lambda spans: f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(base_spans, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}") for k in pii.KINDS],
        F.sha2(F.expr(text_of("base_spans")), 256).alias("base_sha256"),
        F.expr(text_of("spans")).alias("spans"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(crc32_of_id() % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("toxic_spans").alias("n_spans"),
    )


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=5, percent=80)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordersketch.edited_report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_sentencepiece, op3_pii, op4_line_dedup, op5_toxicity, op6_html, op7_licenses, op8_decontamination, op9_urls, op10_ngram_join, op11_whitening, op12_prefix_trie, op13_order_minhash, pipeline)
    return {f.__name__: f for f in own}
