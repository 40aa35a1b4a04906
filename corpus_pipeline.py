"""From raw documents to token ids: language filter, line dedup, near-dedup, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs; further columns of docs, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm import language_id, line_dedup, minhash_dedup, mixing, sentencepiece_codec
from ledgerline.llm.common import hinted, save, table
from ledgerline.llm.queries import piece_model
from ledgerline.session import apply_defaults

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SCORE = 0.2
DROPPED_IDS = 500_000


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stage on ``docs`` with its further columns under neutral names, and name the columns as before."""
    names = [c if c in COLUMNS else f"__extra{i}" for i, c in enumerate(docs.columns)]
    out = stage(docs.toDF(*names))
    return out.select(*[F.col(n) for n in names], *[F.col(c) for c in out.columns if c not in names]).toDF(
        *docs.columns, *[c for c in out.columns if c not in names])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: texts without a letter, or whose grams no learned language takes, go.

    ``MIN_SCORE`` doesn't decide: the scores of a text sum to 1, so the best is at least 1 / languages.
    """
    apply_defaults(spark)

    def stage(d: DataFrame) -> DataFrame:
        found = language_id.predict(d, language_id.train(d.select("doc_id", "text", "lang")), recognised=True)
        return found.filter("recognised").select(d.columns)

    return _apart(docs, stage)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source; n_chars follows a changed text."""
    apply_defaults(spark)

    def stage(d: DataFrame) -> DataFrame:
        cut = line_dedup.drop_boilerplate(d)
        if "n_chars" in d.columns:
            cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(d.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        return cut.select(d.columns)

    return _apart(docs, stage)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest doc_id; rows without id all stay."""
    apply_defaults(spark)

    def stage(d: DataFrame) -> DataFrame:
        found = save(minhash_dedup.near_duplicates(d.select("doc_id", "text")), "near-classes")
        gone = found.filter("doc_id != class_id").select("doc_id").distinct()
        kept = d.join(hinted(gone, gone.count(), DROPPED_IDS), "doc_id", "left_anti").select(d.columns)
        again = found.filter("doc_id = class_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
        if not again.limit(1).count():
            return kept
        one = Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in d.columns if c != "doc_id"])
        first = kept.join(again, "doc_id", "left_semi").withColumn("__n", F.row_number().over(one)).filter("__n = 1").select(d.columns)
        return kept.join(again, "doc_id", "left_anti").select(d.columns).unionByName(first)

    return _apart(docs, stage)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    apply_defaults(spark)
    return _apart(docs, lambda d: mixing.emit(mixing.mix(d)).select(d.columns))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their packed ids, the number of these, and whether they decode to the text."""
    apply_defaults(spark)

    def stage(d: DataFrame) -> DataFrame:
        coded = sentencepiece_codec.encode(d, piece_model(), out="token_ids", decoded="__decoded")
        return coded.withColumns({"n_tokens": (F.length("token_ids") / 4).cast("long"), "round_trip": F.col("__decoded") == F.coalesce("text", F.lit(""))}).drop("__decoded")

    return _apart(docs, stage)


STAGES = [("language_id", identify), ("line_dedup", drop_lines), ("minhash_near_dedup", near_dedup), ("mixing", mix_sources), ("sentencepiece", tokenise)]

#: Language identification is beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    apply_defaults(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage-{name}")
    return docs
