"""Language identification with string kernels.

A text's features are the presence of its character 1-, 2- and 3-grams (folded to lower case, hashed to ``SLOTS``
slots); the kernel of two texts is the number of slots they share over the root of the product of their numbers. A
Nyström map over ``LANDMARKS`` landmark texts turns it into a few coordinates, and one ridge regression per language
(one against the rest, on 0/1 targets) gives the scores. Prediction is one matrix product a block of texts.

The scores of a text sum to 1, so they tell languages apart, but not whether a text is of any of them. ``recognised``
tells that by the text's 2- and 3-grams of letters, repeats counted: a language takes a text if the share of them that
its learned texts have too isn't below the middle of the language's slots by chance and of what its learned texts share
with each other, less 1 / root of the number of grams. A language of fewer than ``LEAST_TEXTS`` different learned texts
takes what is predicted to be of it, and a text without such grams is taken. No other language matters to this, nor
does the length of the text but for the allowance.

The fit uses a bounded sample: the ``PER_LANG`` labelled texts of smallest id hash for each language, as bit sets made
where the texts are (``SLOTS`` / 4 bytes each reach the driver). Everything else covers all rows and whole texts, and
prediction shuffles nothing. Results: a null text, or one without a letter, is ``und`` with score 0; ties go to the
smaller language; scores are clipped to 0..1; without labelled texts everything is ``und``; an empty table gives an
empty result; rows without id are predicted, but never learned from.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerline.llm.common import hinted, save, slices, tidily, with_schema, without

SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
SIZES = (1, 2, 3)
PER_LANG = 256
LEAST_TEXTS = 16
LANDMARKS = 128
RIDGE = 0.1
BLOCK_TEXTS = 64
SLICE_CHARS = 300_000
UNKNOWN = "und"


@dataclass
class LanguageModel:
    langs: list[str]
    landmarks: np.ndarray  # SLOTS x landmarks, 0/1
    roots: np.ndarray  # root of each landmark's number of slots
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    known: np.ndarray  # languages x SLOTS, 1 where a learned text has a gram of letters
    least: np.ndarray  # share of known grams from which a language takes a text; nan with too few texts to say


def presence(texts: list[str]) -> np.ndarray:
    """texts x SLOTS, 1 where the text has an n-gram of the slot."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    flat_out = out.reshape(-1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for a, b in slices(lengths, SLICE_CHARS):
        lowered = [t.lower() for t in texts[a:b]]
        size = np.fromiter(map(len, lowered), np.int64, b - a)
        code = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(a, b, dtype=np.int64) * SLOTS, size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the text's end
        h = np.zeros(len(code), np.uint32)
        for n in range(1, max(SIZES) + 1):
            h = h[: len(code) - n + 1] * np.uint32(0x01000193) ^ code[n - 1:]
            if n in SIZES:
                mixed = h * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B * n & 0xFFFFFFFF)
                at = row[: len(h)] + ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(SLOTS - 1))
                flat_out[at if n == 1 else at[left[: len(h)] >= n]] = 1
    return out


@cache
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def letter_grams(text: str) -> np.ndarray:
    """How often the text has a 2- or 3-gram of letters, by slot."""
    out = np.zeros(SLOTS, np.int64)
    whole = text.lower()
    for a in range(0, len(whole), SLICE_CHARS):
        code = np.frombuffer(whole[a:a + SLICE_CHARS + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter, h = _letters()[code], code * np.uint32(0x9E3779B1)
        run = letter
        for n in (2, 3):
            if len(code) < n:
                break
            run = run[:-1] & letter[n - 1:]
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x01000193) + code[n - 1:] * np.uint32(0x9E3779B1)
            at = h ^ (h >> np.uint32(15))
            at = (at * np.uint32(0x85EBCA6B))[:SLICE_CHARS][run[:SLICE_CHARS]] >> np.uint32(32 - SLOT_BITS)
            out += np.bincount(at, minlength=SLOTS)
    return out


def ordinary(grams: np.ndarray) -> float:
    """The share of known grams from which a language takes a text, from the gram sets of its learned texts."""
    grams = np.unique(grams[grams.any(axis=1)], axis=0)
    if len(grams) < LEAST_TEXTS:
        return np.nan
    count = grams.sum(axis=0, dtype=np.int64)
    shared = ((grams > 0) & (count > 1)).sum(axis=1) / grams.sum(axis=1, dtype=np.int64)
    return float((shared.mean() + (count > 0).mean()) / 2)


def takes(text: str, lang: int, m: LanguageModel) -> bool:
    """Whether any language takes the text, whose predicted language is ``lang``."""
    grams = letter_grams(text)
    n = int(grams.sum())
    if not n or np.isnan(m.least[lang]):
        return True
    return bool((m.known @ grams / n + 1 / np.sqrt(n) >= m.least).any())


def _rooted(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float64), 1))


def kernel(x: np.ndarray, model_slots: np.ndarray, roots: np.ndarray) -> np.ndarray:
    return (x.astype(np.float32) @ model_slots) / _rooted(x)[:, None] / roots[None, :]


def labelled(docs: DataFrame) -> Column:
    """Documents to learn from: text and lang known, and crc32 of the id not 2 modulo 4."""
    return F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel | None:
    """Fit on documents with doc_id, text, lang; None if no text can be learned from."""
    known = docs.filter(labelled(docs))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = save(known.select("doc_id", "lang").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_lang)
               .select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), "n"), "lang-sample")
    rows = known.join(hinted(ids, ids.count(), 100_000), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l")))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.packbits(np.concatenate([presence([t])[0], letter_grams(t) > 0])).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("n"), pa.array(packed, pa.binary())], ["lang", "n", "bits"])

    rows = rows.filter(has_letter("text")).select("lang", "n", "text").mapInArrow(tidily(bits), "lang string, n int, bits binary")
    sample = sorted((r["n"], r["lang"], bytes(r["bits"])) for r in rows.collect())  # turn by turn over the languages
    if not sample:
        return None
    langs = sorted({x[1] for x in sample})
    x = np.unpackbits(np.frombuffer(b"".join(s[2] for s in sample), np.uint8).reshape(len(sample), -1), axis=1)
    x, grams = np.ascontiguousarray(x[:, :SLOTS]), x[:, SLOTS:]
    of = np.array([langs.index(s[1]) for s in sample])
    known = np.stack([grams[of == i].any(axis=0) for i in range(len(langs))]).astype(np.float32)
    least = np.array([ordinary(grams[of == i]) for i in range(len(langs))])
    y = np.eye(len(langs))[of]
    at = x[: max(landmarks, 2 * len(langs))]
    slots, roots = np.ascontiguousarray(at.T.astype(np.float32)), _rooted(at)
    value, vector = np.linalg.eigh(kernel(at, slots, roots).astype(np.float64))
    use = value > 1e-6 * value.max()
    root = vector[:, use] / np.sqrt(value[use])  # Nyström map
    k = np.concatenate([kernel(x[i:i + 256], slots, roots) for i in range(0, len(x), 256)]).astype(np.float64)
    phi = k @ root
    mean, base = phi.mean(axis=0), y.mean(axis=0)
    centred = phi - mean
    w = np.linalg.solve(centred.T @ centred + ridge * np.eye(phi.shape[1]), centred.T @ (y - base))
    return LanguageModel(langs, slots, roots, root @ w, base - mean @ w, known, least)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", recognised: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score, and if asked for, recognised; only the text is looked at."""
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType())] + [("recognised", T.BooleanType())] * recognised
    if model is None:
        none = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "recognised": F.lit(False)}
        return without(docs, *(n for n, _ in added)).withColumns({n: none[n] for n, _ in added})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_schema(docs, added)
    names = [f.name for f in schema.fields[:-len(added)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            lang: list[str] = []
            score: list[float] = []
            taken: list[bool] = []
            yes = batch.column("__letter").to_pylist()
            for a in range(0, len(texts), BLOCK_TEXTS):
                f = kernel(presence(texts[a:a + BLOCK_TEXTS]), m.landmarks, m.roots) @ m.weights + m.bias
                best = np.round(f, 9).argmax(axis=1)
                lang += [m.langs[i] for i in best]
                score += np.round(np.clip(f[np.arange(len(f)), best], 0, 1), 6).tolist()
                if recognised:
                    taken += [y and takes(t, i, m) for t, y, i in zip(texts[a:a + BLOCK_TEXTS], yes[a:a + BLOCK_TEXTS], best.tolist(), strict=True)]
            lang = [x if y else UNKNOWN for x, y in zip(lang, yes, strict=True)]
            score = [x if y else 0.0 for x, y in zip(score, yes, strict=True)]
            found = [pa.array(lang, pa.string()), pa.array(score, pa.float64())] + [pa.array(taken, pa.bool_())] * recognised
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], [*names, *(n for n, _ in added)])

    marked = without(docs.withColumns({"__text": F.col(text).cast("string"), "__letter": has_letter(text)}), *(n for n, _ in added))
    return marked.mapInArrow(tidily(run), schema)
