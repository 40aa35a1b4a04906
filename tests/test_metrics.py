from ledgerline.functions import metrics as met


def _df(spark, ys, ss):
    return spark.createDataFrame([(1, int(y), float(s)) for y, s in zip(ys, ss)], "company_id int, y int, s double")


def _auc_brute(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    return sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    ys = [0, 0, 1, 1, 0, 1, 1, 0, 1, 0]
    ss = [0.1, 0.4, 0.35, 0.8, 0.4, 0.4, 0.9, 0.2, 0.2, 0.7]
    got = met.roc_auc(_df(spark, ys, ss), "y", "s").first()["roc_auc"]
    assert abs(got - _auc_brute(ys, ss)) < 1e-12


def test_average_precision_step_form(spark):
    # scores: 0.9(+) 0.8(-) 0.4(+,-) tied -> AP = 1/2*1 + 1/2*(2/4)
    ys, ss = [1, 0, 1, 0], [0.9, 0.8, 0.4, 0.4]
    got = met.average_precision(_df(spark, ys, ss), "y", "s").first()["average_precision"]
    assert abs(got - (0.5 * 1.0 + 0.5 * 0.5)) < 1e-12


def test_single_class_auc_is_null(spark):
    assert met.roc_auc(_df(spark, [1, 1], [0.2, 0.3]), "y", "s").first()["roc_auc"] is None


def test_classification_zero_division(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "company_id int, y int, p int")
    r = met.classification_metrics(df, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_majority_baseline(spark):
    train = spark.createDataFrame([(1, 0), (1, 0), (1, 1)], "company_id int, y int")
    test = spark.createDataFrame([(1, 1), (1, 0)], "company_id int, y int")
    r = met.majority_baseline(train, test, "y").first()
    assert r["majority_class"] == 0 and r["accuracy"] == 0.5 and r["recall"] == 0.0


def test_prefix_sums_exact_across_slices(spark):
    """One hot group spread over many range slices plus small groups: running sums equal a local cumsum."""
    import random
    rnd = random.Random(11)
    rows = [(0, float(i), rnd.randrange(5)) for i in range(3000)]          # hot group
    rows += [(g, float(i), rnd.randrange(5)) for g in (1, 2) for i in range(7)]
    df = spark.createDataFrame(rows, "g int, s double, v long")
    got = {(r["g"], r["s"]): r["_cum_v"] for r in met.prefix_sums(df, ["g"], "s", ["v"], n_slices=13).collect()}
    for g in (0, 1, 2):
        acc = 0
        for _, s, v in sorted(r for r in rows if r[0] == g):
            assert got[(g, s)] == acc
            acc += v
    inc = {(r["g"], r["s"]): r["_cum_v"] for r in
           met.prefix_sums(df, ["g"], "s", ["v"], descending=True, inclusive=True, n_slices=5).collect()}
    assert inc[(0, 0.0)] == sum(r[2] for r in rows if r[0] == 0)
