"""Shipment delay models (C1-C19, H11): classifier + duration regressor, batch risk scoring.

Candidates are fitted on a time-based inner split with balanced sample
weights, selected by validation ROC-AUC (classifier) or MAE (duration), then
refitted on the full training split, each on all rows of its split. Up to
``FIT_ROWS`` training rows the classifiers are MLlib's; beyond, its forest
(which keeps a bootstrap weight a tree with each row) and its boosting (hundreds of short
jobs) are grown by ``models.trees``. Evaluation metrics are the DataFrame
aggregates of ``ledgerline.functions.metrics``; scoring is ``transform`` +
``vector_to_array`` plus array functions for the top risk factors, so a
shipment's explanation never leaves its row (no shuffle).
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import metrics as met
from ledgerline.functions.exprs import DELAY_TIERS, tier
from ledgerline.models import trees
from ledgerline.models.demand import FIT_ROWS, InsufficientData, each_fit, fit, fit_sample, forest_bytes, forest_of
from ledgerline.operators import demand_features as dfe
from ledgerline.operators import shipment_features as sfe
from ledgerline.session import side_by_side

SEED = 42
MIN_COMPLETED, MIN_TRAIN, MIN_TEST = 40, 20, 5
MIN_DELAYED, MIN_DUR_TRAIN, MIN_DUR_TEST = 30, 15, 5
TOP_FACTORS = 5
KEPT = StorageLevel.MEMORY_ONLY  # of feature rows: what doesn't fit into memory is read again from the table that they come from


@dataclass
class DelayModel:
    name: str
    model: PipelineModel | TreeScorer  # of a classifier: a pipeline or a TreeClassifier
    feature_names: list
    metrics: dict = field(default_factory=dict)
    kind: str = "classifier"


def encoder_stages() -> list:
    """Category -> index (unseen kept) -> one-hot with the last slot dropped.

    The 'keep' bucket is the last index and ``dropLast`` removes it, so an
    unseen category encodes as all zeros -- the reference's behaviour.
    """
    stages = []
    for c in sfe.CATEGORICAL_COLUMNS:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
    stages.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in sfe.CATEGORICAL_COLUMNS],
                                outputCols=[f"{c}_oh" for c in sfe.CATEGORICAL_COLUMNS], dropLast=True))
    stages.append(VectorAssembler(inputCols=sfe.NUMERIC_FEATURE_COLUMNS + [f"{c}_oh" for c in sfe.CATEGORICAL_COLUMNS],
                                  outputCol="features"))
    return stages


def classifier_candidates(total_weight: float, n_estimators: int | None = None) -> dict:
    """C3-C5. LR: sklearn C=1 on a weighted sum equals Spark regParam = 1/sum(w) on its weighted mean."""
    return {
        "logistic_regression": [StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                                LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="sample_weight",
                                                   regParam=1.0 / max(total_weight, 1.0), elasticNetParam=0.0,
                                                   standardization=False, maxIter=100, tol=1e-6)],
        "random_forest": [RandomForestClassifier(labelCol="label", weightCol="sample_weight",
                                                 numTrees=n_estimators or 200, maxDepth=8, minInstancesPerNode=3,
                                                 featureSubsetStrategy="sqrt", seed=SEED)],
        "gradient_boosting": [GBTClassifier(labelCol="label", weightCol="sample_weight", maxIter=n_estimators or 150,
                                            maxDepth=3, stepSize=0.05, seed=SEED)],
    }


#: C12 regressors of the reference: trees, depth, rows of a leaf, learning rate.
DURATION_CANDIDATES = {
    "random_forest": {"trees": 200, "depth": 8, "min_leaf": 2, "rate": None},
    "gradient_boosting": {"trees": 150, "depth": 3, "min_leaf": 1, "rate": 0.05},
}


#: C4, C5 as ``classifier_candidates`` has them, for ``models.trees``.
CLASSIFIER_TREES = {
    "random_forest": {"trees": 200, "depth": 8, "min_leaf": 3, "rate": None},
    "gradient_boosting": {"trees": 150, "depth": 3, "min_leaf": 1, "rate": 0.05, "logistic": True},
}


class TreeScorer:
    """Encoder stages and a forest: what a duration model is scored with."""

    def __init__(self, stages: list, forest: trees.Forest, slots: int) -> None:
        self.stages, self.forest, self.slots = stages, forest, slots

    def transform(self, df: DataFrame) -> DataFrame:
        return trees.predicted(PipelineModel(stages=self.stages).transform(df), _slots(self.slots), self.forest)

    def save(self, path: str) -> None:
        PipelineModel(stages=self.stages).write().overwrite().save(f"{path}/encoder")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.slots, bytearray(forest_bytes(self.forest)))], "slots int, forest binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeScorer:
        r = spark.read.schema("slots int, forest binary").parquet(f"{path}/forest").first()
        return cls(PipelineModel.load(f"{path}/encoder").stages, forest_of(bytes(r["forest"])), r["slots"])


class TreeClassifier(TreeScorer):
    """The same of a classifier: the forest's value is the probability, boosting's half the log odds."""

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scored(PipelineModel(stages=self.stages).transform(df))

    def scored(self, encoded: DataFrame) -> DataFrame:
        value = F.col("prediction")
        p = value if self.forest.kind == "random_forest" else 1.0 / (1.0 + F.exp(-2.0 * value))
        return trees.predicted(encoded, _slots(self.slots), self.forest).withColumn("p_delay", p).withColumn("prediction", (F.col("p_delay") > 0.5).cast("double"))


def _slots(n: int) -> list[Column]:
    x = vector_to_array("features")
    return [x[i] for i in range(n)]


def _split(df: DataFrame, frac: float, scope) -> tuple[DataFrame, DataFrame]:
    s = dfe.time_split(df, "order_date", frac, list(scope))
    return s.where(~F.col("is_test")).drop("cutoff", "is_test"), s.where(F.col("is_test")).drop("cutoff", "is_test")


def _weights(df: DataFrame, scope) -> DataFrame:
    return sfe.balanced_weights(df.withColumn("label", F.col("is_delayed").cast("double")), "label", list(scope))


def _p1(df: DataFrame) -> DataFrame:
    if "p_delay" in df.columns:
        return df
    return df.withColumn("p_delay", vector_to_array("probability")[1])


def _auc(pred: DataFrame) -> float:
    r = met.roc_auc(pred.withColumn("_g", F.lit(1)), "label", "p_delay", ["_g"]).first()
    return float(r["roc_auc"]) if r and r["roc_auc"] is not None else 0.0


def feature_frame(shipments: DataFrame, suppliers: DataFrame, scope=()) -> DataFrame:
    """Completed, supplier-joined shipment features with labels masked from the test cutoff on.

    One cutoff from completed shipments serves both the mask and the split.
    """
    sh = sfe.attach_suppliers(shipments, suppliers, "inner")
    done = sh.where(F.col("actual_delivery").isNotNull())
    cut = dfe.nearest_quantile_cutoff(done, "order_date", 1 - dfe.TEST_FRACTION, list(scope))
    if scope:
        sh = sh.join(F.broadcast(cut.select(*scope, "cutoff")), list(scope), "left")
    else:
        sh = sh.withColumn("cutoff", cut.select("cutoff").scalar())
    return sfe.shipment_feature_matrix(sh, train_end=F.col("cutoff"), completed_only=True, scope=list(scope))


def _encoded(df: DataFrame, encoder: PipelineModel, *keep: str) -> DataFrame:
    return encoder.transform(df).select("features", *keep).persist(KEPT)


def _row_keys(df: DataFrame) -> list[str]:
    return [c for c in ("company_id", "shipment_key", "external_shipment_id", "supplier_id", "order_date") if c in df.columns]


def _narrow(df: DataFrame, scope, *labels: str) -> DataFrame:
    """The columns that a training reads: model columns, labels and what names and orders a row."""
    return df.select(*dict.fromkeys([*scope, *_row_keys(df), "order_date", *sfe.NUMERIC_FEATURE_COLUMNS, *sfe.CATEGORICAL_COLUMNS, *labels]))


def _mllib_fits(rows: DataFrame, encoder: PipelineModel, total_weight: float, n_estimators: int | None, only: str | None) -> tuple[dict, DataFrame]:
    """How each candidate (or ``only`` one) is fitted by MLlib to all of ``rows``, and the frame that the fits share."""
    coded = _encoded(fit_sample(rows, _row_keys(rows)), encoder, "label", "sample_weight")
    coded.count()  # before the candidates, which are many short jobs each, read it side by side
    made = classifier_candidates(total_weight, n_estimators)
    return {name: lambda stages=stages: PipelineModel(stages=encoder.stages + Pipeline(stages=stages).fit(coded).stages)
            for name, stages in made.items() if only in (None, name)}, coded


def _tree_fits(rows: DataFrame, encoder: PipelineModel, total_weight: float, n_estimators: int | None, only: str | None) -> tuple[dict, trees.Packed | None]:
    """The same with trees grown by ``models.trees``, and the packed rows."""
    stages = classifier_candidates(total_weight, n_estimators)["logistic_regression"]
    plain = encoder.transform(rows).select("features", "label", "sample_weight")  # the regression keeps blocks of its own
    linear = lambda: PipelineModel(stages=encoder.stages + Pipeline(stages=stages).fit(plain).stages)
    if only == "logistic_regression":
        return {only: linear}, None
    slots = len(_names(encoder.stages))
    packed = trees.pack(_exploded(encoder.transform(rows), slots, "label", "sample_weight", *_row_keys(rows)), [F.col(f"s{i}") for i in range(slots)], "label",
                        _row_keys(rows), weight="sample_weight")
    subset = {"random_forest": math.ceil(math.sqrt(slots))}
    fits = {"logistic_regression": linear} | {name: lambda spec=spec, name=name: TreeClassifier(encoder.stages, fit(spec | {"subset": subset.get(name)}, packed, n_estimators), slots)
                                              for name, spec in CLASSIFIER_TREES.items()}
    return {name: run for name, run in fits.items() if only in (None, name)}, packed


def train_delay_classifier(feat: DataFrame, scope=(), n_estimators: int | None = None, mllib_rows: int = FIT_ROWS) -> DelayModel:
    """C1-C11, C14 on a precomputed feature frame (see ``feature_frame``).

    Categories are encoded once, from the training period. Fits, weights, counts and metrics cover all labelled rows of
    their split; MLlib grows the trees of at most ``mllib_rows`` training rows.
    """
    feat = feat.withColumn("label", F.col("is_delayed").cast("double"))
    feat = _narrow(feat, scope, "label", "is_delayed").persist(KEPT)
    held = [feat]
    try:
        n = feat.count()
        if n < MIN_COMPLETED:
            raise InsufficientData(f"delay classifier: {n} completed shipments, at least {MIN_COMPLETED} are needed")
        train_full, test = _split(feat, dfe.TEST_FRACTION, scope)
        known = train_full.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate")).first()
        n_tr, n_te = known["n"], test.count()
        if n_tr < MIN_TRAIN or n_te < MIN_TEST:
            raise InsufficientData(f"delay classifier: the time split leaves {n_tr} training and {n_te} test shipments")
        if known["rate"] in (0.0, 1.0):
            raise InsufficientData("delay classifier: all training shipments have the same outcome")
        encoder = Pipeline(stages=encoder_stages()).fit(train_full)
        sub, valid = _split(train_full, dfe.VALIDATION_FRACTION, scope)
        spark, by_trees = feat.sparkSession, n_tr > mllib_rows

        def fits(rows, only=None):
            weighted = _weights(rows, scope)
            total = weighted.select(F.sum("sample_weight")).first()[0] or 1.0
            made, shared = (_tree_fits if by_trees else _mllib_fits)(weighted, encoder, total, n_estimators, only)
            if not by_trees:
                held.append(shared)
            return made, shared

        val_v = _encoded(valid, encoder, "label")
        held.append(val_v)
        val_v.count()
        begun, shared = fits(sub)
        last = lambda m: m.scored(val_v) if by_trees and isinstance(m, TreeClassifier) else PipelineModel(stages=m.stages[len(encoder.stages):]).transform(val_v)
        scores = {name: lambda run=run: _auc(_p1(last(run()))) for name, run in begun.items()}
        val_auc = each_fit(spark, shared, scores) if by_trees else side_by_side(spark, scores)
        best = max(val_auc, key=val_auc.get)
        pm = fits(train_full, best)[0][best]()
        pred = _p1(pm.transform(test)).select("label", "p_delay", F.col("prediction").cast("int").alias("pred"), F.lit(1).alias("_g"))
        pred = pred.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(pred)
        cls = met.classification_metrics(pred, "label", "pred", ["_g"]).first().asDict()
        auc = met.roc_auc(pred, "label", "p_delay", ["_g"]).first()["roc_auc"]
        ap = met.average_precision(pred, "label", "p_delay", ["_g"]).first()["average_precision"]
        maj = met.majority_baseline(train_full.withColumn("_g", F.lit(1)), test.withColumn("_g", F.lit(1)), "label",
                                    ["_g"]).first().asDict()
        metrics = {
            "selected_model": best, "train_rows": n_tr, "test_rows": n_te,
            "positive_rate_train": known["rate"],
            "confusion_matrix_test": {k: cls[k] for k in ("true_positive", "true_negative", "false_positive",
                                                          "false_negative")},
            "comparison": {
                "majority_class_baseline": {k: maj[k] for k in ("accuracy", "precision", "recall", "f1")}
                | {"roc_auc": None, "pr_auc": None},
                best: {k: cls[k] for k in ("accuracy", "precision", "recall", "f1")} | {"roc_auc": auc, "pr_auc": ap},
            },
            "validation_auc": val_auc,
        }
        return DelayModel(best, pm, _names(pm.stages), metrics, "classifier")
    finally:
        for frame in held:
            frame.unpersist()


def train_duration_model(feat: DataFrame, scope=(), n_estimators: int | None = None) -> DelayModel:
    """Delay length in days, trained on delayed shipments only, all of the split."""
    dl = feat.where(F.col("is_delayed") == 1).withColumn("delay_days", F.col("delay_days").cast("double"))
    dl = _narrow(dl, scope, "delay_days").persist(KEPT)
    held = [dl]
    try:
        n = dl.count()
        if n < MIN_DELAYED:
            raise InsufficientData(f"duration model: {n} delayed shipments, at least {MIN_DELAYED} are needed")
        train_full, test = _split(dl, dfe.TEST_FRACTION, scope)
        known = train_full.agg(F.count(F.lit(1)).alias("n"), F.avg("delay_days").alias("mean")).first()
        n_tr, n_te = known["n"], test.count()
        if n_tr < MIN_DUR_TRAIN or n_te < MIN_DUR_TEST:
            raise InsufficientData(f"duration model: the time split leaves {n_tr} training and {n_te} test shipments")
        encoder = Pipeline(stages=encoder_stages()).fit(train_full)
        sub, valid = _split(train_full, dfe.VALIDATION_FRACTION, scope)
        slots = len(_names(encoder.stages))
        val_v = _encoded(valid, encoder, "delay_days")
        held.append(val_v)
        pack = lambda df: trees.pack(_exploded(encoder.transform(df), slots, "delay_days", *_row_keys(df)), [F.col(f"s{i}") for i in range(slots)], "delay_days", _row_keys(df))
        packed = pack(sub)

        def mae(forest, df):
            p = trees.predicted(df, _slots(slots), forest).select(F.avg(F.abs(F.greatest("prediction", F.lit(0.0)) - F.col("delay_days"))))
            return float(p.first()[0])

        val_mae = each_fit(feat.sparkSession, packed, {name: lambda spec=spec: mae(fit(spec, packed, n_estimators), val_v) for name, spec in DURATION_CANDIDATES.items()})
        best = min(val_mae, key=val_mae.get)
        pm = TreeScorer(encoder.stages, fit(DURATION_CANDIDATES[best], pack(train_full), n_estimators), slots)
        pred = pm.transform(test).withColumn("prediction", F.greatest("prediction", F.lit(0.0))) \
            .withColumn("mean_pred", F.lit(known["mean"])).withColumn("_g", F.lit(1))
        base = dfe.regression_metrics(pred, "delay_days", "mean_pred", ["_g"]).first()
        fin = dfe.regression_metrics(pred, "delay_days", "prediction", ["_g"]).first()
        metrics = {"selected_model": best, "train_rows": n_tr, "test_rows": n_te,
                   "comparison": {"mean_baseline": {k: base[k] for k in ("mae", "rmse", "r2")},
                                  best: {k: fin[k] for k in ("mae", "rmse", "r2")}},
                   "validation_maes": val_mae}
        return DelayModel(best, pm, _names(encoder.stages), metrics, "duration")
    finally:
        for frame in held:
            frame.unpersist()


def _exploded(df: DataFrame, slots: int, *keep: str) -> DataFrame:
    """The feature vector as columns s0, s1, ..., unpacked once a row."""
    x = df.select(*keep, vector_to_array("features").alias("x"))
    return x.select(*keep, *[F.col("x")[i].alias(f"s{i}") for i in range(slots)])


def feature_names(pm: PipelineModel) -> list[str]:
    return _names(pm.stages)


def _names(stages: list) -> list[str]:
    """Names of the assembled feature slots (numeric columns, then one-hot slots)."""
    names = list(sfe.NUMERIC_FEATURE_COLUMNS)
    for st in stages:
        if type(st).__name__ == "StringIndexerModel":
            col = st.getInputCol()
            names += [f"{col}_{lab}" for lab in st.labels]  # dropLast removes the 'keep' slot
    return names


def _importances(model: DelayModel) -> tuple[list[float], bool]:
    if isinstance(model.model, TreeClassifier):
        return [float(v) for v in model.model.forest.importance], False
    last = model.model.stages[-1]
    if hasattr(last, "featureImportances"):
        return list(last.featureImportances.toArray()), False
    return [float(v) for v in last.coefficients.toArray()], True


def score_shipments(shipments_feat: DataFrame, clf: DelayModel, dur: DelayModel | None = None) -> DataFrame:
    """Probability (4 dp), tier, expected delay days (1 dp) and the top-5 risk factors."""
    pred = _p1(clf.model.transform(shipments_feat))
    imp, signed = _importances(clf)
    names = clf.feature_names[:len(imp)]
    x = vector_to_array("features")
    facts = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"),
                         F.array(*[F.lit(float(abs(v))) for v in imp]).alias("importance"),
                         F.array(*[F.lit(float(v)) for v in imp]).alias("coef"),
                         x.alias("value"))
    top = F.slice(F.sort_array(F.transform(F.filter(facts, lambda s: s["importance"] > 0),
                                           lambda s: F.struct((-s["importance"]).alias("k"), s["feature"].alias("feature"),
                                                              s["importance"].alias("importance"),
                                                              s["value"].alias("value"),
                                                              (F.when(s["coef"] > 0, "increases_risk")
                                                               .otherwise("decreases_risk") if signed
                                                               else F.lit("unknown")).alias("direction")))),
                  1, TOP_FACTORS)
    out = pred.withColumn("top_risk_factors", F.transform(top, lambda s: s.dropFields("k")))
    out = out.withColumn("delay_probability", F.round("p_delay", 4)) \
             .withColumn("risk_tier", tier("p_delay", DELAY_TIERS))
    drop = [c for c in ("rawPrediction", "probability", "prediction", "scaled", "features") if c in out.columns]
    out = out.drop(*drop)
    idx_cols = [c for c in out.columns if c.endswith("_idx") or c.endswith("_oh")]
    out = out.drop(*idx_cols)
    if dur is not None:
        d = dur.model.transform(out).withColumn("expected_delay_days", F.round(F.greatest("prediction", F.lit(0.0)), 1))
        out = d.drop(*[c for c in ("prediction", "features") if c in d.columns]).drop(
            *[c for c in d.columns if c.endswith("_idx") or c.endswith("_oh")])
    else:
        out = out.withColumn("expected_delay_days", F.lit(None).cast("double"))
    return out


def serving_features(shipments: DataFrame, suppliers: DataFrame, scope=("company_id",)) -> DataFrame:
    """Features for scoring *every* shipment from real history (fixes the reference's serving skew):
    expanding rates over all known outcomes, in-flight rows' own label unknown."""
    sh = sfe.attach_suppliers(shipments, suppliers, "left")
    return sfe.shipment_feature_matrix(sh, train_end=None, completed_only=False, scope=list(scope))


def metrics_rows(spark, m: DelayModel, scope_label: str = "base") -> DataFrame:
    """Flatten the comparison dict to rows (one per compared model and metric)."""
    rows = []
    for model_name, vals in m.metrics["comparison"].items():
        for k, v in vals.items():
            rows.append((scope_label, m.kind, model_name, m.metrics["selected_model"], k,
                         None if v is None else float(v), int(m.metrics["train_rows"]), int(m.metrics["test_rows"])))
    schema = ("scope string, kind string, model string, selected_model string, metric string, value double, "
              "train_rows long, test_rows long")
    return spark.createDataFrame(rows, schema)


def shipment_detail(shipments: DataFrame, suppliers: DataFrame, clf: DelayModel, dur: DelayModel | None,
                    company_id: int, shipment_key: str) -> DataFrame:
    """One shipment's risk, with features from its tenant's full history (partition-pruned by tenant)."""
    tenant = shipments.where(F.col("company_id") == company_id)
    feat = serving_features(tenant, suppliers.where(F.col("company_id") == company_id), scope=("company_id",))
    return score_shipments(feat.where(F.col("shipment_key") == shipment_key), clf, dur)


# ---------------------------------------------------------------------------------------------
# Bundles and serving through the registry (G4 -> C15)
# ---------------------------------------------------------------------------------------------
def save_model(m: DelayModel, path: str) -> None:
    """Bundle: the fitted pipeline, and its name, kind, feature names and metrics."""
    spark = SparkSession.getActiveSession()
    if isinstance(m.model, TreeScorer):
        m.model.save(f"{path}/model")
    else:
        m.model.write().overwrite().save(f"{path}/model")
    meta = {"name": m.name, "kind": m.kind, "feature_names": m.feature_names, "metrics": m.metrics, "trees": isinstance(m.model, TreeScorer)}
    spark.createDataFrame([(json.dumps(meta, default=float),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark, path: str) -> DelayModel:
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
    scorer = TreeScorer if meta["kind"] == "duration" else TreeClassifier
    model = scorer.load(spark, f"{path}/model") if meta["trees"] else PipelineModel.load(f"{path}/model")
    return DelayModel(meta["name"], model, meta["feature_names"], meta["metrics"], meta["kind"])


def score_with_registry(feat: DataFrame, classifiers: DataFrame, durations: DataFrame) -> DataFrame:
    """C15 for every tenant with the models the registry holds for it.

    ``classifiers`` and ``durations`` come from ``governance.active_model``. A tenant is scored by its own classifier,
    else the base; a duration is given only by a duration model of the same source. Models, not tenants, are walked
    through: tenants of one pair of models are scored together.
    """
    spark = feat.sparkSession
    d = durations.select("company_id", F.col("model_path").alias("d_path"), F.col("model_source").alias("d_source"))
    pairs: dict[tuple, list] = {}
    for r in classifiers.join(d, "company_id", "left").select("company_id", "model_path", "model_source", "d_path", "d_source").collect():
        same = r["d_path"] if r["d_source"] == r["model_source"] else None
        pairs.setdefault((r["model_path"], r["model_source"], same), []).append(r["company_id"])
    out = None
    for (clf, source, dur), tenants in pairs.items():
        rows = feat.where(F.col("company_id").isin(tenants))
        scored = score_shipments(rows, load_model(spark, clf), load_model(spark, dur) if dur else None).withColumn("model_source", F.lit(source))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise InsufficientData("no tenant has an active delay classifier")
    return out
