"""Line dedup by site-relative frequency, in DataFrame operations only.

Each page counts once for each of its distinct lines; a line is boilerplate on a site when it stands on at least
``min_pages`` of the site's pages and on more than ``ratio`` of them. Lines are grouped by 128 bits of hash, with
partial counts before the shuffle, so a site or line with a third of all rows is summed where it is read. A site has at
most (its mean lines a page) / ratio boilerplate lines; these come back to the pages as one array a site.

Results: null texts stay null and count as pages without lines; blank lines (only spaces and controls) are never
counted or dropped; the null site is a site like any other; a text that loses all its lines becomes empty; texts that
lose nothing are unchanged; repeated rows are separate pages; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import hinted, save, with_schema, without

RATIO = 0.1
MIN_PAGES = 3


def host_of(url: Column) -> Column:
    """Host of a URL, lower case, without port and a leading www."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, keys): the boilerplate lines of each site that has any."""
    pages = docs.select(F.col(site).alias("site"), F.col(text).alias("text"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    lines = pages.select("site", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter(F.col("line").rlike(r"[^\x00-\x20]"))
    counts = lines.select("site", line_key(F.col("line")).alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("pages"))
    often = counts.filter(F.col("pages") >= min_pages).withColumnRenamed("site", "at")
    often = often.join(totals, F.col("at").eqNullSafe(F.col("site"))).filter(F.col("pages") > F.lit(ratio) * F.col("total"))
    return often.groupBy("site").agg(F.collect_set("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines cut from ``text``, and n_lines and n_dropped added."""
    sites = save(boilerplate(docs, site, text, ratio, min_pages), "line-sites")
    sites = hinted(sites.select(F.col("site").alias("__site"), F.col("keys").alias("__keys")), sites.count())
    added = [("n_lines", T.LongType()), ("n_dropped", T.LongType())]
    out = without(docs, *(n for n, _ in added)).join(sites, F.col(site).eqNullSafe(F.col("__site")), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__keys"), line_key(x)))
    out = out.withColumn("__kept", F.when(F.col("__keys").isNotNull(), kept).otherwise(lines))
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("n_dropped", F.col("n_lines") - F.when(F.col(text).isNull(), 0).otherwise(F.size("__kept")))
    out = out.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("__kept", "\n")).otherwise(F.col(text)))
    return out.select([f"`{f.name}`" for f in with_schema(docs, added).fields])


ORACLE = r"""
WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT source, unnest(list_distinct(lines)) AS line FROM p),
c AS (SELECT source, line, count(*) AS pages FROM l WHERE regexp_matches(line, '[^\x00-\x20]') GROUP BY source, line),
t AS (SELECT source, count(*) AS total FROM p GROUP BY source),
b AS (SELECT c.source, list(c.line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      WHERE c.pages >= 3 AND c.pages::DOUBLE > 0.1::DOUBLE * t.total GROUP BY c.source),
k AS (SELECT p.doc_id, p.text, p.lines, CASE WHEN b.bad IS NULL THEN p.lines ELSE list_filter(p.lines, lambda x: NOT list_contains(b.bad, x)) END AS kept
      FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped,
       CASE WHEN len(kept) < len(lines) THEN array_to_string(kept, chr(10)) ELSE text END AS text FROM k
"""
