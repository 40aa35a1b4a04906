from pyspark.sql import functions as F

from ledgerline.llm import line_dedup as L


def plain(rows, ratio=L.RATIO, min_pages=L.MIN_PAGES):
    total, pages = {}, {}
    for _, text, site in rows:
        total[site] = total.get(site, 0) + 1
        for line in set(text.split("\n")) if text is not None else ():
            if any(ord(c) > 32 for c in line):
                pages[site, line] = pages.get((site, line), 0) + 1
    bad = {k for k, n in pages.items() if n >= min_pages and n > ratio * total[k[0]]}
    out = []
    for doc, text, site in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if (site, x) not in bad]
        out.append((doc, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return out


def test_sites_nulls_blanks_and_repeats(spark):
    rows = [(i, f"menu\nbody {i}\n\nbody {i}\n \nfoot", "a") for i in range(20)]
    rows += [(100 + i, f"menu\nother {i}", "b") for i in range(2)] + [(200 + i, "same", None) for i in range(3)]
    rows += [(300, None, "a"), (301, "", "a"), (302, "menu", "a"), (0, rows[0][1], "a"), (400, "rare\n" * 50_000, "a"), (None, "foot\nx", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = L.drop_boilerplate(df.withColumns({c: F.lit(1) for c in ("line", "KEYS", "n_lines", "total")}))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))
    assert out.columns == ["doc_id", "text", "source", "line", "KEYS", "total", "n_lines", "n_dropped"]
    assert L.drop_boilerplate(df.limit(0)).count() == 0


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(i, "a\nb", "s") for i in range(5)], "doc_id long, text string, source string")
    plan = L.drop_boilerplate(df)._jdf.queryExecution().executedPlan().toString() + L.boilerplate(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_host(spark):
    urls = ["http://www.A.example.com:80/x?y#z", "https://u:p@m.b.org", "ftp://c.net#q", "nothing", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(L.host_of(F.col("u"))).collect()]
    assert got == ["a.example.com", "m.b.org", "c.net", "", None]
