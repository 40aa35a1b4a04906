"""Source divergence audit by chunk factorization.

A chunk is what stands between ASCII white space, lower-cased (A-Z) and without the ASCII characters at its ends that no
term can have. Chunks are counted per document, in numpy, and summed by language,
source and chunk; each globally distinct chunk is then cut into its terms once, and its terms are joined back to the
counts. A document counts once for a term however many of its chunks have it: chunks of ``min_docs`` documents or more
settle their terms by themselves, and the others have at most two documents, whose numbers travel as a smallest and a
largest one, so that distinct documents are counted exactly without a row for every document and chunk.

Terms are kept per language if at least ``min_docs`` (1 to 3) of its rows have them. The share of a term in a group is
p = 1 + floor(10**9 (count+1) / (N + V)), with N the group's occurrences of kept terms and V the number of kept terms;
two shares differ by floor((p-q)**2 / q). Everything is integer arithmetic (decimals where 64 bits don't suffice).

Results: null text, lang and source are empty strings; a group without terms has N = 0 and takes part in pairs; rows
that are repeated are separate documents; ties go by the item's UTF-8 bytes; an empty table gives an empty result;
other columns are ignored. Words are partly summed in the tasks that read them, so a source, language or word with a
third of all rows costs no more elsewhere; the pairs of sources are summed over buckets of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import hinted, save, tidily
from ledgerline.llm.word_spans import byte_kinds, in_slices, words

#: A term is a maximal run of ASCII letters and of characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Cells (sources x terms) of one bucket of the pair sums, about.
BUCKET_CELLS = 1_000_000
SLICE_BYTES = 8 << 20
#: ASCII characters that are in no term.
_NO_TERM = "".join(chr(c) for c in range(128) if not chr(c).isalpha())
_KINDS = byte_kinds(b"\x20\x09\x0a\x0b\x0c\x0d")
_SUMS = pa.schema([("lang", pa.string()), ("s1", pa.int64()), ("s2", pa.int64()), ("value", pa.int64())])
_COUNTED = "lang string, source string, chunk string, n long, docs long, d1 long, d2 long"


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of some rows: occurrences and documents of every (lang, source, chunk), with the smallest and largest document
    number; a row with the chunk '' stands for each group."""
    for batch in batches:
        group = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        for at, texts in in_slices(batch.column("text"), SLICE_BYTES):
            langs, sources = (batch.column(c).slice(at, len(texts)).dictionary_encode() for c in ("lang", "source"))
            code = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            seen, code = np.unique(code, return_inverse=True)
            doc = batch.column("doc").slice(at, len(texts)).to_numpy()
            found = words(texts, _KINDS)
            chunk = found.text.dictionary_encode()
            bare = pc.utf8_trim(pc.ascii_lower(chunk.dictionary), characters=_NO_TERM).dictionary_encode()
            n_chunks = max(len(bare.dictionary), 1)
            which = bare.indices.to_numpy().astype(np.int64)[chunk.indices.to_numpy()]
            per_doc, n = np.unique(found.row * n_chunks + which, return_counts=True)  # (document, chunk)
            row, which = np.divmod(per_doc, n_chunks)
            order = np.argsort(code[row] * n_chunks + which, kind="stable")
            key = (code[row] * n_chunks + which)[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            last = np.append(first[1:], len(key)) - 1
            row = row[order]
            groups, which = np.divmod(key[first], n_chunks)
            groups = np.concatenate([groups, np.arange(len(seen))])
            pick_l, pick_s = np.divmod(seen[groups], len(sources.dictionary))
            none = pa.nulls(len(seen), pa.int64())
            zero = np.zeros(len(seen), np.int64)
            ids = doc[row]
            small = np.minimum.reduceat(ids, first) if len(first) else ids
            large = np.maximum.reduceat(ids, first) if len(first) else ids
            total = np.add.reduceat(n[order], first) if len(first) else n
            yield pa.record_batch({
                "lang": langs.dictionary.take(pa.array(pick_l)), "source": sources.dictionary.take(pa.array(pick_s)),
                "chunk": pa.concat_arrays([bare.dictionary.take(pa.array(which)).cast(pa.string()), pa.array([""] * len(seen))]),
                "n": np.concatenate([total, zero]), "docs": np.concatenate([last - first + 1, zero]),
                "d1": pa.concat_arrays([pa.array(small, pa.int64()), none]), "d2": pa.concat_arrays([pa.array(large, pa.int64()), none])})


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, chunk, n, docs, d1, d2) over all documents; see ``_chunk_counts``."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")],
                       F.monotonically_increasing_id().alias("doc"))
    parts = rows.mapInArrow(tidily(_chunk_counts), _COUNTED)
    return parts.groupBy("lang", "source", "chunk").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("d1").alias("d1"), F.max("d2").alias("d2"))


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(chunk, term) of distinct chunks, a row for each occurrence of a term in the chunk."""
    return chunks.select("chunk", F.explode(F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0))).alias("term"))


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE (count+1) / (n+v)); the product may pass 64 bits."""
    wide = (count + F.lit(1)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return (F.lit(1) + F.call_function("div", wide, (n + v).cast("decimal(20,0)"))).cast("long")


def _pair_sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over one bucket's terms of floor((p-q)**2 / q) for all ordered pairs of the language's sources; none without
    terms or with one source."""
    if not left.num_rows or not right.num_rows:
        return pa.Table.from_pylist([], _SUMS)
    base = right.column("p0").to_numpy()[np.argsort(right.column("at").to_numpy())]
    term = left.column("term").combine_chunks().dictionary_encode()
    codes = term.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    codes, at, p = codes[order], left.column("at").to_numpy()[order] - 1, left.column("p").to_numpy()[order]
    total = np.zeros((len(base), len(base)), np.int64)
    step = max(1, BUCKET_CELLS // len(base))
    for a in range(0, len(term.dictionary), step):
        b = min(a + step, len(term.dictionary))
        lo, hi = np.searchsorted(codes, [a, b])
        shares = np.repeat(base[:, None], b - a, axis=1)
        shares[at[lo:hi], codes[lo:hi] - a] = p[lo:hi]
        for s in range(len(base)):
            gap = shares[s] - shares
            total[s] += (gap * gap // shares).sum(axis=1)
    s1, s2 = (x.ravel() for x in np.indices(total.shape))
    other = s1 != s2
    return pa.table({"lang": pa.array([key[0].as_py()] * int(other.sum()), pa.string()), "s1": s1[other] + 1, "s2": s2[other] + 1, "value": total.ravel()[other]})


def _distinct_enough(joined: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) of at least ``min_docs`` documents."""
    numbers = F.when(F.col("docs") >= min_docs, F.array(F.lit(None).cast("long"))).otherwise(F.array("d1", "d2"))
    rows = joined.select("lang", "term", "docs", F.explode(numbers).alias("doc"))
    found = rows.groupBy("lang", "term").agg(F.max("docs").alias("most"), F.count_distinct("doc").alias("different"))
    return found.filter((F.col("most") >= min_docs) | (F.col("different") >= min_docs)).select("lang", "term")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and the terms
    that set it apart from the language as a whole. Needs the columns text, lang and source."""
    if not 1 <= min_docs <= 3:
        raise ValueError("min_docs must be 1, 2 or 3: a chunk carries two document numbers")
    counted = save(chunk_counts(docs), "chunk-counts")
    terms = chunk_terms(counted.select("chunk").distinct())
    joined = save(counted.join(terms, "chunk").drop("chunk"), "chunk-terms")
    kept = save(_distinct_enough(joined, min_docs), "kept-terms")
    counts = joined.groupBy("lang", "source", "term").agg(F.sum("n").alias("c")).join(kept, ["lang", "term"])
    counts = save(counts, "term-counts")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = counted.select("lang", "source").distinct()
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("c").alias("n")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"),
                           F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("at"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("n_sources"))
    groups = save(groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v")))), "source-groups")
    few = groups.count()
    shares = counts.join(hinted(groups, few), ["lang", "source"]).withColumn("p", _share(F.col("c"), F.col("n"), F.col("v")))

    whole = counts.groupBy("lang", "term").agg(F.sum("c").alias("c"))
    totals = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    whole = whole.join(hinted(totals, few), "lang").select("lang", "term", _share(F.col("c"), F.col("n"), F.col("v")).alias("q"))
    gap = F.col("p") - F.col("q")
    apart = shares.join(whole, ["lang", "term"]).filter("p > q")
    apart = apart.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", gap * gap, F.col("q")).alias("value"))

    buckets = (F.col("v") * F.col("n_sources") / BUCKET_CELLS).cast("long") + 1
    cells = shares.select("lang", F.pmod(F.xxhash64("term"), buckets).alias("bucket"), "term", "at", "p")
    bases = groups.filter("v > 0 AND n_sources > 1").select(F.col("lang").alias("lang"), F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)).alias("bucket"), F.col("at").alias("at"), F.col("p0").alias("p0"))
    sums = cells.groupBy("lang", "bucket").cogroup(bases.groupBy("lang", "bucket")).applyInArrow(_pair_sums, "lang string, s1 long, s2 long, value long")
    sums = sums.groupBy("lang", "s1", "s2").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "source", F.col("at").cast("long").alias("at"))
    pairs = names.withColumnRenamed("at", "s1").join(names.select("lang", F.col("source").alias("item"), F.col("at").alias("s2")), "lang").filter("s1 != s2")
    pairs = pairs.join(sums, ["lang", "s1", "s2"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = apart.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(apart)


ORACLE = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc FROM documents),
t AS (SELECT lang, source, doc, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(sum(c.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x
      LEFT JOIN c ON x.lang = c.lang AND x.source = c.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + v.v) AS p
      FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
n AS (SELECT lang, sum(n) AS n FROM g GROUP BY lang),
q AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.c) + 1)) // (n.n + v.v) AS q FROM c JOIN n ON c.lang = n.lang JOIN v ON c.lang = v.lang
      GROUP BY c.lang, c.term, n.n, v.v),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
         LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
         GROUP BY ALL),
term AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term
         WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value,
                      row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term) WHERE rank <= 200
"""
