"""The training-data operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import attn_lm, chat, decontam, embed_dedup, html_crf, licenses, mixing, ngram_join, pii, sessions, toxicity, warc, yinyang
from textloom.llm._spark import table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of a crawl over all pages, resolved; merged headers as name: value lines."""
    out = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "url_key", "ts", "outcome", "response_id", lines.alias("headers"), "digest")


def op2_pii_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, as counts and digests of spans."""
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, links at cosine 0.95."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, links at 0.85, over all documents."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over all documents."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("hits")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents."""
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and attention-model scores of all documents."""
    return attn_lm.lm_scores(table(spark, sf_dir, "documents"))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 1, 2, 3, with each one's first training position."""
    mixed = mixing.positions(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of four folds of five."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted; digests of what is read back from the result."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-1, 0, "user", words), (-1, 1, "assistant", words)], turns.schema)
    return chat.digest(chat.format_conversations(turns.unionByName(hard)))


def op12_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings after four rounds."""
    return yinyang.compress(table(spark, sf_dir, "embeddings"))


def op13_click_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all clicks."""
    return sessions.sessionise(table(spark, sf_dir, "clicks"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_revisits, op2_pii_semi_crf, op3_embedding_dedup, op4_ngram_jaccard_join, op5_license_scan, op6_decontamination,
        op7_attention_lm, op8_curriculum_mix, op9_toxicity, op10_html_extraction, op11_chat_formatting, op12_yinyang_codes,
        op13_click_sessions,
    )
}
