"""Header mapping (S3-S6): suggest a standard field for every raw header of every feed.

Input is a *table of headers* -- (feed_id, dataset_type, pos, header) -- so any
number of uploads are mapped in one job:

* pass 1 (exact name, else alias) is an equi-join of normalised headers with the
  alias registry (a fixed ~125-row table: a bounded broadcast) and a
  ``row_number`` so the first header of a feed wins a field;
* pass 2 scores every header left against every alias of the fields left (one
  row per pair, joined on the dataset type), keeps the best alias per (header,
  field) and lets each feed's headers choose in order of position: a fold over
  the feed's array of headers, as wide as its header line.
"""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.sources import registry as reg

MAPPING_SCHEMA = T.StructType([
    T.StructField("feed_id", T.LongType()),
    T.StructField("dataset_type", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("header", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("score", T.DoubleType()),
])


def normalize_header_col(c) -> Column:
    """S3 as a column expression: lowercase, drop everything but letters and digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def headers_of(spark: SparkSession, feeds: Sequence[tuple[int, str, Sequence[str]]]) -> DataFrame:
    """(feed_id, dataset_type, headers) triples -> the header table."""
    rows = [(int(fid), t, i, h) for fid, t, hs in feeds for i, h in enumerate(hs)]
    schema = "feed_id long, dataset_type string, pos int, header string"
    return spark.createDataFrame(rows, schema)


def _registry_frames(spark: SparkSession):
    aliases = spark.createDataFrame(reg.alias_rows(), "field string, field_order int, alias string")
    fields = spark.createDataFrame(reg.field_rows(), "dataset_type string, field string, field_pos int, required boolean")
    return aliases, fields


@F.pandas_udf(T.DoubleType())
def _similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of each pair of names."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def _similar_fields(p1: DataFrame, aliases: DataFrame, fields: DataFrame) -> DataFrame:
    """Pass 2: (feed_id, pos, field, score) for the headers that pass 1 left open."""
    names = fields.join(aliases, "field", "left").select("dataset_type", "field", "field_pos", F.coalesce("alias", "field").alias("alias"))
    taken = p1.where(F.col("field").isNotNull()).select("feed_id", "field")
    pairs = (p1.where(F.col("field").isNull()).select("feed_id", "dataset_type", "pos", normalize_header_col("header").alias("norm"))
             .join(F.broadcast(names), "dataset_type").join(taken, ["feed_id", "field"], "left_anti"))
    scored = (pairs.withColumn("score", _similarity("norm", "alias")).groupBy("feed_id", "pos", "field", "field_pos")
              .agg(F.max("score").alias("score")).where(F.col("score") >= reg.FUZZY_MATCH_THRESHOLD))
    # best first; of equal scores the field declared first
    wish = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "field_pos", "field", "score"))).alias("wish")
    feeds = scored.groupBy("feed_id", "pos").agg(wish).groupBy("feed_id").agg(F.array_sort(F.collect_list(F.struct("pos", "wish"))).alias("headers"))
    start = F.struct(F.array().cast("array<string>").alias("used"),
                     F.array().cast("array<struct<pos:int,field:string,score:double>>").alias("picks"))

    def choose(done, h):
        free = F.get(F.filter(h["wish"], lambda w: ~F.array_contains(done["used"], w["field"])), 0)
        pick = F.struct(h["pos"].alias("pos"), free["field"].alias("field"), free["score"].alias("score"))
        return F.when(free.isNull(), done).otherwise(F.struct(F.array_append(done["used"], free["field"]).alias("used"),
                                                              F.array_append(done["picks"], pick).alias("picks")))

    return feeds.select("feed_id", F.inline(F.aggregate("headers", start, choose)["picks"]))


def suggest_mapping(headers: DataFrame) -> DataFrame:
    """S4 for every feed: (feed_id, dataset_type, pos, header, field, method, score)."""
    spark = headers.sparkSession
    aliases, fields = _registry_frames(spark)
    h = headers.withColumn("norm", normalize_header_col("header"))
    # exact: the normalised header is itself a field of the feed's type
    fx = fields.select(F.col("dataset_type").alias("fx_type"), F.col("field").alias("f_exact"))
    exact = (h.join(F.broadcast(fx), (h.dataset_type == fx.fx_type) & (h.norm == fx.f_exact))
             .select("feed_id", "pos", "f_exact"))
    # alias: the first field (declaration order) listing the header among its aliases
    alias = (h.join(F.broadcast(aliases), h["norm"] == aliases["alias"])
             .groupBy("feed_id", "pos").agg(F.min_by("field", "field_order").alias("f_alias")))
    cand = (h.join(exact, ["feed_id", "pos"], "left").join(alias, ["feed_id", "pos"], "left")
            .withColumn("cand", F.coalesce("f_exact", "f_alias"))
            .withColumn("cand_method", F.when(F.col("f_exact").isNotNull(), "exact").when(F.col("f_alias").isNotNull(),
                                                                                         "alias")))
    # the candidate must belong to the type; the first header (by position) wins a field
    cand = cand.join(F.broadcast(fields.select("dataset_type", F.col("field").alias("cand"), F.lit(True).alias("ok"))),
                     ["dataset_type", "cand"], "left")
    w = Window.partitionBy("feed_id", "cand").orderBy("pos")
    win = F.when(F.col("ok") & (F.row_number().over(w) == 1), True).otherwise(False)
    p1 = cand.withColumn("win", win).select(
        "feed_id", "dataset_type", "pos", "header",
        F.when(F.col("win"), F.col("cand")).alias("field"),
        F.when(F.col("win"), F.col("cand_method")).alias("method"),
        F.when(F.col("win"), F.lit(1.0)).alias("score"))
    p2 = _similar_fields(p1, aliases, fields).select("feed_id", "pos", F.col("field").alias("f2"), F.col("score").alias("s2"))
    return p1.join(p2, ["feed_id", "pos"], "left").select(
        "feed_id", "dataset_type", "pos", "header", F.coalesce("field", "f2").alias("field"),
        F.coalesce("method", F.when(F.col("f2").isNotNull(), "fuzzy")).alias("method"), F.coalesce("score", "s2").alias("score"))


def unmapped_required(mapping: DataFrame) -> DataFrame:
    """Required fields of each feed's type that no header maps to (empty = importable)."""
    spark = mapping.sparkSession
    _, fields = _registry_frames(spark)
    feeds = mapping.select("feed_id", "dataset_type").distinct()
    req = feeds.join(F.broadcast(fields.where("required")), "dataset_type")
    mapped = mapping.where(F.col("field").isNotNull()).select("feed_id", "field")
    return req.join(mapped, ["feed_id", "field"], "left_anti").select("feed_id", "dataset_type", "field", "field_pos")


def mapping_dict(mapping: DataFrame, feed_id: int) -> dict[str, str | None]:
    """One feed's mapping as {header: field}: tens of entries of metadata, not data."""
    rows = mapping.where(F.col("feed_id") == feed_id).orderBy("pos").collect()
    return {r["header"]: r["field"] for r in rows}


def apply_mapping(raw: DataFrame, column_mapping: Mapping[str, str | None],
                  keep: Sequence[str] = ()) -> DataFrame:
    """Keep mapped columns under their standard names; first of duplicate targets wins.

    ``keep`` passes extra columns (e.g. a row-position key) through unchanged.
    """
    seen, cols = set(), []
    for c in raw.columns:
        tgt = column_mapping.get(c)
        if tgt and tgt not in seen:
            seen.add(tgt)
            cols.append(F.col(f"`{c}`").alias(tgt))
    return raw.select(*cols, *keep)


def preview(df: DataFrame, n: int = 10, order: Sequence[str] = ()) -> DataFrame:
    """First n rows (in ``order`` when given); NaN rendered as null."""
    out = df.orderBy(*order) if order else df
    nan_free = [F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
                for c, t in df.dtypes]
    return out.limit(n).select(*nan_free)
