"""Mixing sources to target weights.

Words are added up per source (partial sums before the shuffle), targets are filled like water: every source gets its
weight's share of 150% of all words, none more than twice its own, and what a capped source can't take is shared again
by weight. A document is then emitted floor(rate) times, plus once more if a number hashed from its id is below the
rate's fraction, so reruns and retries agree.

Results: a null text has size 0 and takes nothing; the null source is a source like any other and comes last; a source
without words has target and rate 0; repeated ids decide alike; an empty table gives an empty result. Only the table
of sources (one row each) passes through one task, to order the weights; documents aren't shuffled while the sources
are few enough to be broadcast, and are joined with skew handling beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerline.llm.common import hinted, save, with_schema, without, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
ADDED = [("size", T.LongType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("copies", T.LongType()), ("taken", T.LongType())]


def unit_hash(key: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1 made of the first 32 bits of md5(seed:key)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of a frame with ``source`` and ``size``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array([F.lit(w) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - before) / rest)
    # the sources that fill up come first; of the others the first has the common level, the largest of theirs
    level = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything)
    cap = F.col("cap").cast("double")
    return per.select("source", "source_size", F.coalesce(F.least(cap, level * F.col("weight")), cap).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, copies and taken (size times copies)."""
    sized = without(docs.withColumn("__size", word_count("text")), *(n for n, _ in ADDED))
    per = save(source_targets(sized.select("source", F.col("__size").alias("size")), weights, share, most), "mix-sources")
    per = hinted(per.select(F.col("source").alias("__source"), "source_size", "target"), per.count())
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = F.when(unit_hash(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    out = sized.join(per, F.col("source").eqNullSafe(F.col("__source")), "inner")
    out = out.withColumn("copies", F.floor(rate).cast("long") + extra).withColumn("taken", F.col("__size") * F.col("copies"))
    return out.withColumnRenamed("__size", "size").select([f"`{f.name}`" for f in with_schema(docs, ADDED).fields])


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of a mix as often as its copies say, without the columns that mix() added."""
    each = mixed.filter("copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return without(each, "__copy", *(n for n, _ in ADDED))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
              - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
              / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
m AS (SELECT *, max(CASE WHEN cap::DOUBLE / weight >= level THEN level END) OVER () AS common FROM l),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, common * weight), cap::DOUBLE) AS target FROM m),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
             ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM r
"""
