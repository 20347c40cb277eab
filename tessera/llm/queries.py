"""The queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import table

from . import chat, embedding_dedup, lexical_search, licenses, line_dedup, ngram_join, packing, quality, sentencepiece_codec, token_counts, toxicity, warc, whitening

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of held-out documents aren't learnt from. Null and empty texts score as a text without n-grams."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by cosine >= 0.95. Null, zero and non-finite vectors link with nothing."""
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by Jaccard >= 0.9 of 3-word shingles. Null and wordless texts link with nothing."""
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), words=3, threshold=90)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, with begin and end ids, and what they decode to, as digests. A null text counts as empty."""
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(table(spark, sf_dir, "documents"), PIECES), PIECES)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back from the output. A null text counts as empty."""
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(probe)
    out = chat.read_chats(chat.format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens at most. A null text counts as empty: its end id alone."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTES, capacity=1024, end_id=2)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two derivatives of a response record made of each page. The records themselves are named by digests here."""
    out = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return out.select("page_id", "kind", "record_id", "refers_to", "target_uri", "date", "source_payload_digest", "block_digest", "content_type", F.octet_length("content").cast("long").alias("content_bytes"), F.sha2("content", 256).alias("content_sha256"), F.sha2("warc", 256).alias("record_sha256"), "error")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files. The table has no paths, so each gets one from its source and id: three levels of directories,
    each with the first of its documents, by a round id, as its LICENSE file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    at = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = (
        F.when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", "source", F.lit("LICENSE")))
        .when(F.col("doc_id") % 100 == 0, F.concat_ws("/", "source", at(1000), F.lit("LICENSE")))
        .when(F.col("doc_id") % 10 == 0, F.concat_ws("/", "source", at(1000), at(100), F.lit("LICENSE.txt")))
        .otherwise(F.concat_ws("/", "source", at(1000), at(100), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    )
    return licenses.license_scan(docs.withColumn("path", path)).withColumnRenamed("file_id", "doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents. Null and wordless texts fail and have no content share."""
    out = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents, without begin and end ids. A null text counts as empty."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES).withColumn("over_limit", F.col("n_tokens") > 4096)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points and more that 5 documents and more hold, kept in the last of them. A null text is one empty line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, least_chars=40, least_docs=5))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid vectors along up to 8 components. deviation is null where it is beyond a long (from about a million vectors on)."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=8).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each item of benchmark. Null texts have no terms."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_embedding_dedup, op3_ngram_jaccard_join, op4_sentencepiece, op5_chat_format, op6_best_fit_packing, op7_warc_derivatives,
        op8_license_scan, op9_quality_rules, op10_token_counts, op11_line_dedup, op12_embedding_whitening, op13_ranked_search,
    )
}
