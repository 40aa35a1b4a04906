import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import divergence as D


def plain(rows, min_docs=3, top=200):
    """rows: (text, lang, source)"""
    docs = []
    for text, lang, source in rows:
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(D.TERM, text or "")]
        docs.append((lang or "", source or "", terms))
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= min_docs}
        count = {s: Counter() for lg, s, _ in docs if lg == lang}
        for lg, s, terms in docs:
            if lg == lang:
                count[s].update(t for t in terms if t in kept)
        share = lambda c, t: 1 + D.SCALE * (c[t] + 1) // (sum(c.values()) + len(kept))
        whole = sum(count.values(), Counter())
        far = lambda p, q: (p - q) ** 2 // q
        for s, c in count.items():
            found = [(sum(far(share(c, t), share(o, t)) for t in kept), x) for x, o in count.items() if x != s]
            found.sort(key=lambda v: (-v[0], v[1].encode()))
            out += [(lang, s, "pair", x, v, i + 1) for i, (v, x) in enumerate(found)]
            found = [(far(share(c, t), share(whole, t)), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            found.sort(key=lambda v: (-v[0], v[1].encode()))
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(found[:top])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def audited(df, **kw):
    out = D.audit(df, **kw)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "A", "Bee", "bee,", "x-y", "x", "é", "É", "z'z", "12", "...", "Wort", "wort!", "日本", "naïve", " nb", "c\x00d", "𝒳", "k\x7fk"] + [f"t{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(9)]
    rows = [(" ".join(rng.choice(vocabulary[:rng.randint(2, len(vocabulary))]) for _ in range(rng.randint(0, 30))) + rng.choice(["", "\n", "\t x", " "]),
             rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "S3", None, "", "é"])) for _ in range(160)]
    rows += [(None, "en", "only-null"), ("", "fr", "alone"), ("1 2 3", "fr", "digits"), ("a a a", "nl", "x"), ("word " * 20_000, "en", "s1")] + [rows[0]] * 40
    df = frame(spark, rows).repartition(7).withColumns({c: F.lit(5) for c in ("doc", "chunk", "n", "docs", "term", "d1")})
    assert audited(df) == plain(rows)
    assert audited(df, top_terms=3) == plain(rows, top=3)


def test_documents_are_distinct_across_chunks(spark):
    """A term in several chunks of two documents isn't kept; the third document settles it."""
    rows = [("foo foo, (foo) foo.", "en", "a"), ("foo! foo? foo", "en", "b"), ("bar bar. bar!", "en", "a"), ("bar", "en", "b"), ("bar;", "en", "b")]
    got = audited(frame(spark, rows))
    assert got == plain(rows) and not any(r[3] == "foo" for r in got)
    for least in (1, 2):
        assert audited(frame(spark, rows), min_docs=least) == plain(rows, least)
    with pytest.raises(ValueError):
        D.audit(frame(spark, rows), min_docs=4)


def test_many_buckets_and_large_counts(spark, monkeypatch):
    rows = [(f"w{chr(97 + i % 26)}{chr(97 + i % 7)} common", "en", f"s{i % 5}") for i in range(300)]
    monkeypatch.setattr(D, "BUCKET_CELLS", 40)
    assert audited(frame(spark, rows)) == plain(rows)
    big = spark.createDataFrame([(10 ** 13, 10 ** 14, 7)], "c long, n long, v long").select(D._share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()[0]
    assert big == 1 + D.SCALE * (10 ** 13 + 1) // (10 ** 14 + 7)


def test_empty_table(spark):
    assert audited(frame(spark, [])) == []
