"""Model governance jobs (G3, G5-G9): train base / tenant models and commit registry rows.

The registry is a folder with a log: a commit writes its rows (Parquet) to a folder of its own and then creates the next
numbered file of ``log``, which names that folder. Creating fails if the file is there, so of two trainings that commit at
once one gets the number and the other takes the next one; rows become visible all at once, and a lost commit changes
nothing. ``registry_id`` is made of the commit's number and the row's place, versions and status follow from it at read
time (``governance.registry_status``), and no earlier row is ever rewritten. Model artifacts have a path for each version.

All tenants whose data one task can hold are trained in one job, grouped by tenant; a tenant's failure is its outcome and
doesn't touch the others. Larger tenants are trained one after the other by the distributed learner.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.models import delay as dl
from ledgerline.models import demand as dm
from ledgerline.operators import governance as gov
from ledgerline.session import checkpoint_root

COMMIT_ROWS = 1_000_000  # of registry ids that belong to a commit
MODEL_TYPES = ("demand", "shipment_delay", "shipment_duration")


def registry_path(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/model_registry"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Numbers and row folders of the commits, in order."""
    fs, log = _fs(spark, f"{path}/log")
    if not fs.exists(log):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(log))
    return [(int(n.split("-")[0]), n.split("-", 1)[1]) for n in names if "-" in n]


def read_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The registry, empty before anything is committed; a storage error is an error, not an empty registry."""
    path = path or registry_path(spark)
    commits = _commits(spark, path)
    if not commits:
        return spark.createDataFrame([], gov.REGISTRY_SCHEMA)
    rows = spark.read.schema(gov.REGISTRY_SCHEMA).parquet(*[f"{path}/rows/{c:09d}-{folder}" for c, folder in commits])
    return rows


def commit_registry(spark: SparkSession, rows: DataFrame, path: str | None = None) -> int:
    """Add the rows (REGISTRY_SCHEMA; their registry_id only orders them) as one commit and return its number.

    The number is taken by creating ``log/<number>``, which only one writer can do; the commit counts from the moment
    its rows stand beside it (``log/<number>-<folder>``). A writer that is lost in between leaves a number without rows.
    """
    path = path or registry_path(spark)
    folder = uuid.uuid4().hex
    fs, log = _fs(spark, f"{path}/log")
    fs.mkdirs(log)
    number = max((int(s.getPath().getName().split("-")[0]) for s in fs.listStatus(log)), default=0) + 1
    while not _create(spark, f"{path}/log/{number:09d}"):
        number += 1
    order = F.row_number().over(gov.Window.orderBy("registry_id"))  # rows of one training
    numbered = rows.withColumn("registry_id", (F.lit(number * COMMIT_ROWS) + order).cast("long")).select(gov.REGISTRY_SCHEMA.names)
    numbered.coalesce(1).write.mode("overwrite").parquet(f"{path}/rows/{number:09d}-{folder}")
    if not _create(spark, f"{path}/log/{number:09d}-{folder}"):
        raise RuntimeError(f"commit {number} exists")
    return number


def _create(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already."""
    fs, p = _fs(spark, path)
    try:
        fs.create(p, False).close()
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or fs.exists(p):
            return False
        raise


def append_registry(spark: SparkSession, rows: list[tuple], path: str | None = None) -> None:
    """Commit rows (registry_id, company_id, model_type, model_source, training_date, dataset_size,
    history_days, metrics_json, model_path)."""
    if rows:  # in the order given
        commit_registry(spark, spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], gov.REGISTRY_SCHEMA), path)


def _save(model, spark, model_type, company_id) -> str:
    """Versioned artifact path; demand models are saved as a full bundle (see ``demand.save_model``)."""
    owner = "base" if company_id is None else f"company_{company_id}"
    path = f"{checkpoint_root(spark)}/models/{model_type}/{owner}/{uuid.uuid4().hex}"
    if isinstance(model, dm.DemandModel):
        dm.save_model(model, path)
    else:
        dl.save_model(model, path)
    return path


def _row(spark, model_type, company_id, fitted, metrics, size, days):
    path = _save(fitted, spark, model_type, company_id)
    return (uuid.uuid4().int >> 65, company_id, model_type, "base" if company_id is None else "company",
            dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), int(size), int(days),
            json.dumps(metrics, default=float), path)


def register_base(spark, sales: DataFrame, shipments: DataFrame, demand: dm.DemandModel, clf: dl.DelayModel, dur: dl.DelayModel | None) -> list[tuple]:
    """G5 for models that are fitted already: save them and give their registry rows."""
    span = sales.agg(F.count(F.lit(1)), F.datediff(F.max("sale_date"), F.min("sale_date"))).first()
    size = _completed(shipments)
    rows = [_row(spark, "demand", None, demand, demand.metrics, span[0], span[1]), _row(spark, "shipment_delay", None, clf, clf.metrics, *size)]
    return rows + ([_row(spark, "shipment_duration", None, dur, dur.metrics, *size)] if dur else [])


def train_base(spark, sales: DataFrame, shipments: DataFrame, suppliers: DataFrame, kind: str,
               n_estimators: int | None = None) -> list[tuple]:
    """Pooled model over every tenant (the one deliberate cross-tenant read)."""
    if kind == "demand":
        m = dm.train_demand_model(sales, keys=("company_id", "product_id"), scope=(), n_estimators=n_estimators)
        span = sales.agg(F.count(F.lit(1)), F.datediff(F.max("sale_date"), F.min("sale_date"))).first()
        return [_row(spark, "demand", None, m, m.metrics, span[0], span[1])]
    feat = dl.feature_frame(shipments, suppliers, scope=())
    clf = dl.train_delay_classifier(feat, n_estimators=n_estimators)
    size = _completed(shipments)
    out = [_row(spark, "shipment_delay", None, clf, clf.metrics, *size)]
    try:
        dur = dl.train_duration_model(feat, n_estimators=n_estimators)
        out.append(_row(spark, "shipment_duration", None, dur, dur.metrics, *size))
    except dm.InsufficientData:
        pass
    return out


def _completed(shipments: DataFrame) -> tuple[int, int]:
    """Completed shipments and the days their orders span: what the registry records of a shipment model's data."""
    r = shipments.where(F.col("actual_delivery").isNotNull()).agg(
        F.count(F.lit(1)), F.datediff(F.max("order_date"), F.min("order_date"))).first()
    return r[0], r[1] or 0


OUTCOME = "company_id int, model_type string, trained boolean, reason string"


def train_tenants(spark, companies: DataFrame, sales: DataFrame, store: str, n_estimators: int | None = None,
                  group_rows: int = dm.GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """G6/G9 for demand: a model for each *sufficient* tenant. Returns the registry rows and, for every tenant, whether a
    model was trained and why not. Models are stored under ``store`` (``stored_models`` and ``stored_means`` read them).

    Tenants of at most ``group_rows`` feature days are trained in one job; the others, of which there are at most
    (all days / group_rows), one after the other by the distributed learner.
    """
    suff = gov.demand_sufficiency(companies, sales)
    days = sales.groupBy("company_id", "product_id").agg((F.datediff(F.max("sale_date"), F.min("sale_date")) + 1).alias("d")).groupBy("company_id").agg(F.sum("d").alias("days"))
    todo = suff.where("is_sufficient").join(days, "company_id")
    trained = dm.train_tenant_models(sales, todo.where(F.col("days") <= group_rows), n_estimators=n_estimators)
    trained = trained.withColumn("model_path", F.concat(F.lit(f"{store}/company_"), F.col("company_id").cast("string")))
    trained.write.mode("overwrite").parquet(f"{store}/trained")
    for k, r in enumerate(todo.where(F.col("days") > group_rows).select("company_id").collect()):
        one = _train_large(spark, r["company_id"], sales, store, n_estimators)
        one.write.mode("append" if k else "overwrite").parquet(f"{store}/trained_large")
    done = tenant_models(spark, store)
    at = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = done.where("problem IS NULL").join(suff.select("company_id", "record_count", "history_days"), "company_id").select(
        F.col("company_id").cast("long").alias("registry_id"), F.col("company_id").cast("int"), F.lit("demand").alias("model_type"), F.lit("company").alias("model_source"),
        F.lit(at).alias("training_date"), F.col("record_count").cast("long").alias("dataset_size"), F.col("history_days").cast("long"), "metrics_json", "model_path")
    result = suff.select("company_id", "is_sufficient", "reason").join(done.select("company_id", "problem", F.lit(True).alias("tried")), "company_id", "left")
    outcomes = result.select(F.col("company_id").cast("int"), F.lit("demand").alias("model_type"), (F.coalesce("tried", F.lit(False)) & F.col("problem").isNull()).alias("trained"),
                             F.when(~F.col("is_sufficient"), F.col("reason")).otherwise(F.coalesce("problem", F.lit("trained company-specific model"))).alias("reason"))
    return rows, outcomes


def _train_large(spark, cid: int, sales: DataFrame, store: str, n_estimators: int | None) -> DataFrame:
    """One tenant's TENANT_ROW (and its path) by the distributed learner."""
    path = f"{store}/company_{cid}"
    none = dict.fromkeys(["name", "origin", "global_mean", "train_rows", "test_rows", "metrics_json", "forest", "product_id", "product_mean", "problem"])
    try:
        m = dm.train_demand_model(sales.where(F.col("company_id") == cid), scope=(), n_estimators=n_estimators)
        means = m.product_means.select("product_id", "product_mean_demand").collect()  # the products of one tenant
        row = none | {"name": m.name, "origin": m.origin, "global_mean": m.global_mean, "train_rows": m.metrics["train_rows"], "test_rows": m.metrics["test_rows"],
                      "metrics_json": json.dumps(m.metrics, default=float), "forest": bytearray(dm.forest_bytes(m.model)),
                      "product_id": [r[0] for r in means], "product_mean": [r[1] for r in means]}
    except Exception as e:  # noqa: BLE001 - one tenant's failure is its outcome and never loses the others' fits
        row = none | {"problem": f"{type(e).__name__}: {e}"}
    return spark.createDataFrame([{"company_id": cid, "model_path": path, **row}], dm.TENANT_ROW + ", model_path string")


def tenant_models(spark, store: str) -> DataFrame:
    """What ``train_tenants`` wrote: TENANT_ROW with model_path."""
    schema = dm.TENANT_ROW + ", model_path string"
    found = [f"{store}/{x}" for x in ("trained", "trained_large") if (lambda fs, p: fs.exists(p))(*_fs(spark, f"{store}/{x}"))]
    return spark.read.schema(schema).parquet(*found)


def stored_models(base: list[dm.DemandModel], paths: list[str], tenants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables that ``demand.forecast_with_registry`` serves from: MODEL_ROW rows, and product means by model path, of the
    base models at ``paths`` and the tenants' models."""
    spark = tenants.sparkSession
    rows = [(p, m.name, m.origin, float(m.global_mean), list(m.keys), json.dumps(m.metrics, default=float), bytearray(dm.forest_bytes(m.model))) for m, p in zip(base, paths, strict=True)]
    good = tenants.where("problem IS NULL")
    own = good.select("model_path", "name", "origin", "global_mean", F.array(F.lit("company_id"), F.lit("product_id")).alias("keys"), "metrics_json", "forest")
    models = spark.createDataFrame(rows, dm.MODEL_ROW).unionByName(own)
    means = good.select("model_path", F.col("company_id").alias("company_id"), F.inline(F.arrays_zip(F.col("product_id").alias("product_id"), F.col("product_mean").alias("product_mean_demand"))))
    for m, p in zip(base, paths, strict=True):
        means = means.unionByName(m.product_means.select(F.lit(p).alias("model_path"), F.col("company_id").cast("int").alias("company_id"), F.col("product_id").cast("long").alias("product_id"), "product_mean_demand"))
    return models, means


def ensure_model(spark, companies: DataFrame, kind: str, train_base_fn, train_tenants_fn=None, path: str | None = None) -> DataFrame:
    """Each tenant's own active model, else the base.

    Tenants without a model of their own are first offered to ``train_tenants_fn`` (companies -> registry rows and
    outcomes, as frames); the base is trained only if none exists.
    """
    reg = read_registry(spark, path)
    if train_tenants_fn is not None:
        own = reg.where((F.col("model_type") == kind) & F.col("company_id").isNotNull()).select("company_id").distinct()
        commit_registry(spark, train_tenants_fn(companies.join(own, "company_id", "left_anti"))[0], path)
        reg = read_registry(spark, path)
    if reg.where((F.col("model_type") == kind) & F.col("company_id").isNull()).limit(1).count() == 0:
        append_registry(spark, train_base_fn(), path)
        reg = read_registry(spark, path)
    return gov.active_model(companies, reg, kind)
