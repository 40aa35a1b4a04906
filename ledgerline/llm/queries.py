"""Registered queries of the training-data operators: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (chat_format, collocations, divergence, language_id, learned_partitions, line_dedup, minhash_dedup, mixing, pivot_topk,
                            sentencepiece_codec, substring_dedup, token_files, token_rollup)
from ledgerline.llm.common import save, scratch, table, word_count
from ledgerline.session import apply_defaults

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def piece_model() -> str:
    """Path of the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_vocabulary() -> str:
    """Path of the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with begin and end ids and decoded again, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.encode(docs, piece_model(), decoded="decoded")
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op4_mixing"] = mixing.ORACLE


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their source as site, without the lines that are boilerplate there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE["op7_line_dedup"] = line_dedup.ORACLE


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that is made of control strings, formatted, read back and digested."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema))
    back = chat_format.read_chats(chat_format.format_chats(turns))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(digest, "UTF-8"), 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products of every hundredth vector with all others."""
    rows = pivot_topk.quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return pivot_topk.search(rows, F.col("vec_id") % 100 == 0)


ORACLE["op2_pivot_topk"] = pivot_topk.ORACLE


@query
def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector among all others."""
    return learned_partitions.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of two tokenizer versions after three batches: all documents in, exact copies out, and the counts of the
    sentence pieces revised to include the begin and end ids. The second batch is sent twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    coded = sentencepiece_codec.encode(docs, piece_model(), bos=False, eos=False)
    counted = save(coded.select("doc_id", "source", "lang", F.sha2("text", 256).alias("digest"), word_count("text").alias("words"),
                                (F.length("ids") / 4).cast("long").alias("pieces")), "token-counts")
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("first"))
    marked = counted.join(first.withColumnRenamed("digest", "d"), F.col("digest").eqNullSafe(F.col("d")))
    versions = F.array(F.struct(F.lit("words-1").alias("tokenizer"), F.col("words").alias("n_tokens")),
                       F.struct(F.lit("piece_bpe_32k").alias("tokenizer"), F.col("pieces").alias("n_tokens")))
    rows = counted.select("source", "lang", F.inline(versions))
    copies = marked.filter(F.col("doc_id") > F.col("first")).select("source", "lang", F.inline(versions))
    kept = marked.filter(F.col("doc_id") == F.col("first")).select("source", "lang", F.lit("piece_bpe_32k").alias("tokenizer"),
                                                                   (F.col("pieces") + 2).alias("n_tokens"), F.col("pieces").alias("old_tokens"))
    rollup = token_rollup.TokenRollup(spark, f"{scratch(spark, 'token-rollup')}/r")
    rollup.commit("1-insert", rows.withColumn("kind", F.lit("insert")))
    rollup.commit("2-copies", copies.withColumn("kind", F.lit("delete")))
    rollup.commit("3-begin-end", kept.withColumn("kind", F.lit("revise")))
    rollup.commit("2-copies", copies.withColumn("kind", F.lit("delete")))
    return rollup.totals()


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, its number of documents and whether it is the one that stays."""
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_class", (F.col("doc_id") == F.col("class_id")).alias("stays"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 20-word windows that also start earlier in the corpus."""
    kept = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(F.coalesce("kept", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ from each other, and the terms that set each apart from its language."""
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE["op11_source_divergence"] = divergence.ORACLE


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded into Arrow files of equal-length sequences, read back and digested."""
    folder = scratch(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_vocabulary(), folder)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two to four words of each language, by the score of their weakest cut."""
    return collocations.top(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE["op13_collocations"] = collocations.ORACLE
