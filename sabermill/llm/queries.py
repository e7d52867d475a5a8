"""The thin queries opN_<name> of the contract, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sabermill.llm.license import oracle
from sabermill.llm.shared import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sabermill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), Scratch(spark)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sabermill.llm.ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sabermill.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), words=3, distance=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def held_out(remainder: int, parts: int) -> Column:
    """Whether the CRC-32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sabermill.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    learn = F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2
    return identify(docs, train(docs, learn)).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sabermill.llm.katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"), Scratch(spark))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sabermill.llm.chat import format_conversations, read_back

    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sabermill.llm.linededup import passage_dedup

    cut = passage_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))
    return cut.select("doc_id", "total_lines", "removed_lines", "removed_chunks", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sabermill.llm.suffix import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The files of the licence scan: each document in the directory source / language / hundred of its id.
FILES = "concat_ws('/', source, lang, cast(floor(doc_id / 100) AS {long}), concat(cast(doc_id AS {string}), '.txt'))"


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sabermill.llm.license import license_scan

    docs = table(spark, sf_dir, "documents")
    return license_scan(docs.select("doc_id", F.expr(FILES.format(long="BIGINT", string="STRING")).alias("path"), "text"), Scratch(spark))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sabermill.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_packing": op1_packing, "op2_ann": op2_ann, "op3_simhash": op3_simhash, "op4_language_id": op4_language_id, "op5_katz": op5_katz, "op6_chat": op6_chat, "op7_line_dedup": op7_line_dedup, "op8_suffix_dedup": op8_suffix_dedup, "op9_license_scan": op9_license_scan, "op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {"op9_license_scan": oracle(f"SELECT doc_id, {FILES.format(long='BIGINT', string='VARCHAR')} AS path, text FROM documents")}
