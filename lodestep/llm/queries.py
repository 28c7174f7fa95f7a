"""Queries that apply the operators of this subpackage to the standard tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, importance, lexical_search, license_scan, media, near_dup, pii, preference, secret_scan, sql, token_count, toxicity, warc_zip
from .session import Scratch, ensure_importable

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Tokens of a context window.
LIMIT = 1024


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Queries must give the same pseudonyms each time; a corpus of one's own takes a secret key.
PII_KEY = b"lodestep documentation key"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms, and how many of each kind."""
    named = pii.pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    count = lambda kind: F.coalesce(F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    return named.select("doc_id", "text", *(count(k) for k in pii.KINDS))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to, as digests."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, RANKS, PATTERN)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def held_out(doc_id: Column) -> Column:
    """Rows that no model is fitted on."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a lexicon learnt from the labels that aren't held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels")
    lexicon = toxicity.fit(toxicity.training_rows(docs, labels, held_out=held_out(F.col("doc_id"))))
    return toxicity.score(docs, lexicon, hits="n_matches").select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "n_matches",
    )


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record in ZIP archives, and what is read back."""
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    archives = scratch.table(warc_zip.write(_read(spark, sf_dir, "pages").select("page_id", "url", "html"), folder), "manifest")
    return warc_zip.read(archives, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the patterned spans, and all spans."""
    found = secret_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("entropy"), F.sha2(_span_text(base), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against its curt variant, as prompt and masked completions."""
    turns = preference.conversations(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    pairs = turns.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), preference.curt(F.col("turns")).alias("rejected"))
    masks = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return preference.format_pairs(pairs).withColumn("chosen_spans", masks("chosen_spans")).withColumn("rejected_spans", masks("rejected_spans"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among images of the embeddings, the one table that holds signals: each vector drawn as a square."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return media.copies(vectors.select("vec_id", media.rendered(F.col("embedding")).alias("image")), "vec_id")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of two-word shingles have a similarity of 0.8 or more."""
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"), words=2, similarity=0.8)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses whose notices stand in a document, for each place the right one."""
    return license_scan.identify(_read(spark, sf_dir, "documents").select("doc_id", "text"), license_scan.notices(spark))


def op11_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return token_count.count(docs, TOKENIZER).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return lexical_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=50)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight towards the benchmark, and the rank of the 5 % that are drawn."""
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_pii, op3_byte_bpe, op4_warc_zip, op5_secret_scan, op6_preference, op7_decontaminate, op8_media, op9_near_duplicates, op10_license_scan, op11_token_count, op12_ranked_search, op13_importance)}


def oracle_sql() -> dict:
    return dict(sql.ORACLES)
