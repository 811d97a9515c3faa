"""The queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rookery.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rookery.llm.license_scan import scan_licenses

    return scan_licenses(spark, table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rookery.llm.quality import score_quality, train_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rookery.llm.pivot_search import top_k

    return top_k(spark, table(spark, sf_dir, "embeddings"))


#: Shares of tokens wanted for each domain, here the language.
MIX_TARGETS = {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13}


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled documents' domains."""
    return docs.select("doc_id", docs["lang"].alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rookery.llm.mixing import mix

    docs = table(spark, sf_dir, "documents")
    return mix(spark, docs.select("doc_id", "text"), domain_labels(docs, table(spark, sf_dir, "labels")), MIX_TARGETS, keep_text=False)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rookery.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rookery.llm.jaccard_join import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rookery.llm.decontaminate import digest, find_hits

    return digest(find_hits(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rookery.llm.toxicity import score_toxicity, train_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


#: Host, path start and verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rookery.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rookery.llm.token_codes import token_output

    return token_output(spark, table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_quality_classifier, op3_exact_top_k, op4_source_mixing, op5_html_extraction, op6_jaccard_join, op7_benchmark_decontamination, op8_toxicity, op9_url_filter, op10_token_output, pipeline)}
