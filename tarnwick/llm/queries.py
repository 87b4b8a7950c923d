"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm.common import table


#: Files of the public tokenizers; see their README.
WORD_TOKENIZER, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.quality_classifier import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.html_extract import extract_main

    return extract_main(table(spark, sf_dir, "pages"))


def op3_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tarnwick.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tarnwick.llm.token_attribution import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, fields=("source", "text"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), ["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


def op10_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.common import cut
    from tarnwick.llm.simhash_index import edited_prints, near_rows

    prints = cut(edited_prints(table(spark, sf_dir, "documents")))
    near = cut(near_rows(prints.select(prints.fp_own.alias("fp"))))  # a table, so that the join below may split a fingerprint with many rows
    return prints.join(near.withColumnRenamed("fp", "fp_own"), "fp_own").drop("fp_own")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.conversation_repair import audited

    return audited(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tarnwick.llm.token_alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.chat_format import format_chats, read_chats, text_content

    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(*own.columns).unionByName(own)
    read = read_chats(format_chats(rows.withColumn("content", text_content(F.col("text")))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(whole).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"), sha(F.col("trained")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
