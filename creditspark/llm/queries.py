"""Registered queries of the numbered operators: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.llm import sql
from creditspark.llm.op01_url_filters import URL_PARTS, filter_urls
from creditspark.llm.op02_arc_to_warc import archive_pages
from creditspark.llm.op03_lz_fingerprint import edited_fingerprints
from creditspark.llm.op04_best_fit_packing import pack_documents
from creditspark.llm.op05_poisson_mixing import mix_sources
from creditspark.llm.op06_jaccard_join import jaccard_components
from creditspark.llm.op07_toxicity import toxicity_scores
from creditspark.llm.op08_template_extraction import extract_pages
from creditspark.llm.op09_itq_neardup import near_vectors
from creditspark.llm.op10_preference_chat import preference_pairs
from creditspark.llm.op11_token_alignment import alignment_digests
from creditspark.llm.op12_viterbi_repair import conversation_audits
from creditspark.llm.op13_prefix_bpe import encoding_digests
from creditspark.llm.scratch import share_package

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenizer_text(name: str) -> str:
    """A vocabulary file's text, which goes to the workers in a broadcast."""
    with open(tokenizer_path(name), encoding="utf-8") as file:
        return file.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries that follow from the pages: hosts, URLs, first folders and domains."""
    low = F.lower(F.trim("url"))
    host = F.regexp_extract(low, URL_PARTS, 2)
    path = F.regexp_extract(low, URL_PARTS, 3)
    labels = F.split(host, r"\.")
    added = F.expr("page_id * 13 % 1461").cast("int")
    rules = (
        ("page_id % 5 = 0", "block", "host", host, "spam"),
        ("page_id % 7 = 0", "block", "url", F.concat(host, path, F.regexp_extract(low, URL_PARTS, 4)), "malware"),
        ("page_id % 11 = 0", "allow", "path", F.concat(host, F.lit("/"), F.split(path, "/")[1]), "editorial"),
        ("page_id % 13 = 0", "block", "domain", F.array_join(F.slice(labels, -2, 2), "."), "ads"),
    )
    row = lambda when, name, kind, pattern, category, day, action: F.when(F.expr(when), F.struct(
        F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(category).alias("category"),
        day.alias("day"), F.lit(action).alias("action")))
    first = F.date_add(F.lit("2020-01-01").cast("date"), added)
    last = F.date_add(F.lit("2020-01-01").cast("date"), F.expr("cast(page_id * 13 % 1461 + 60 + page_id % 200 as int)"))
    rows = [row(when, *rest, first, "add") for when, *rest in rules]
    rows += [row(f"{when} and page_id % 2 = 0", *rest, last, "remove") for when, *rest in rules]
    entries = pages.where(host != "").select(F.explode(F.array(*rows)).alias("e")).where("e is not null").select("e.*")
    return entries.where("pattern <> '' and pattern is not null").distinct()


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures, fetched on a day that follows from the id, against derived lists."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2020-01-01").cast("date"), F.expr("cast(page_id * 37 % 1461 as int)")))
    return filter_urls(captures, derived_entries(pages))


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_itq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def derived_rejections(turns: DataFrame) -> DataFrame:
    """A rejected variant of every conversation: from a turn that follows from the id on,
    assistants answer otherwise, and every fourth conversation ends early."""
    cut = F.expr("conv_id % 3 + 1")
    kept = turns.where((F.col("conv_id") % 4 != 0) | (F.col("turn") <= cut + 1))
    answer = F.when((F.col("role") == "assistant") & (F.col("turn") >= cut), F.concat(F.lit("Well: "), F.col("text"))).otherwise(F.col("text"))
    return kept.withColumn("text", answer)


def op10_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pairs = preference_pairs(turns, derived_rejections(turns))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["length"], s["train"].cast("int"))), ",")
    return pairs.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return alignment_digests(table(spark, sf_dir, "documents"), tokenizer_text("byte_bpe_50k.json"), model)


def damaged(turns: DataFrame) -> DataFrame:
    """Faults by a hash of (conv_id, turn): rows dropped, emptied, without stops, repeated, or of role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(20))
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    rows = rows.withColumn("text", F.expr("case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '') else text end"))
    rows = rows.withColumn("role", F.expr("if(fault = 4, 'user', role)"))
    return rows.withColumn("fault", F.explode(F.expr("sequence(1, if(fault = 3, 2, 1))"))).drop("fault")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def op12_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, repaired after damage; one that lost all rows has zeros and empty texts."""
    turns = table(spark, sf_dir, "conversations")
    audits = conversation_audits(damaged(turns)).withColumnRenamed("conv_id", "repaired_id")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = every.join(audits, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left").drop("repaired_id")
    return found.na.fill(0, COUNTS).na.fill({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), tokenizer_text("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_arc_to_warc, op3_lz_fingerprint, op4_best_fit_packing, op5_poisson_mixing,
    op6_jaccard_join, op7_toxicity, op8_template_extraction, op9_itq_neardup, op10_preference_chat,
    op11_token_alignment, op12_viterbi_repair, op13_prefix_bpe,
)}

ORACLES = {
    "op1_url_filters": sql.OP1,
    "op2_arc_to_warc": sql.OP2,
    "op5_poisson_mixing": sql.OP5,
    "op6_jaccard_join": sql.OP6,
    "op9_itq_neardup": sql.OP9,
    "op10_preference_chat": sql.OP10,
    "op12_viterbi_repair": sql.OP12,
}
