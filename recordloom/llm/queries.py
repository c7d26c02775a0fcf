"""Named queries over the given tables, one for each operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe, exact_dedup, html_blocks, language, mixing, neighbours, prefix_trie, private_data, records, simhash, spelling, top_products, warc
from recordloom.llm.common import read, work_folder
from recordloom.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

WARC_DATE = "2024-01-01T00:00:00Z"


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, F.col("vec_id") % 100 == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records of all pages, as read back from the files."""
    folder = work_folder(spark, "warc")
    warc.write_warc(warc.derivatives(warc.responses(read(spark, sf_dir, "pages"), WARC_DATE)), folder)
    header = F.col("headers")
    return warc.read_warc(spark, folder).select(
        header["warc-record-id"].alias("record_id"),
        "warc_type",
        header["warc-refers-to"].alias("refers_to"),
        header["warc-derived-with"].alias("derived_with"),
        header["warc-target-uri"].alias("target_uri"),
        header["warc-source-payload-digest"].alias("source_digest"),
        header["warc-block-digest"].alias("block_digest"),
        header["content-length"].cast("long").alias("content_length"),
        F.col("block").cast("string").alias("block"),
    )


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "records")
    index = records.write_records(read(spark, sf_dir, "documents"), folder)
    found = records.crc32_of_ids(records.read_records(spark, folder, index))
    starts = records.document_starts(index)
    return found.join(starts, ["file_number", "record"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = F.col("_mix_plan")
    return mixing.plan_draws(docs).select(
        "doc_id",
        plan["size"].alias("size"),
        plan["source_size"].alias("source_size"),
        plan["target"].alias("target"),
        (plan["size"] * F.size(plan["draws"])).alias("taken"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _joined(spans: str) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", parts)


def op7_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = private_data.private_spans(docs, private_data.train(docs))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(k) for k in private_data.KINDS],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(read(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~language.held_out()))
    texts = docs.select("doc_id", "text", language.held_out().alias("held_out"))
    return language.predictions(texts, model).select("doc_id", "held_out", "lang_pred", "score")


def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products.top_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_warc": op2_warc,
    "op3_records": op3_records,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_simhash": op6_simhash,
    "op7_private": op7_private,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_main_text": op9_main_text,
    "op10_language": op10_language,
    "op11_top_products": op11_top_products,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling": op13_spelling,
}
