"""Validation and quality score (V1-V13) in one pass over a mapped upload.

Every rule becomes a boolean flag column; a single aggregate counts them all
(V3 duplicates come from one extra ``groupBy`` on the key columns, whose
partial aggregation runs map-side). The report is a handful of issue rows
built from that one aggregated row, and the quarantine is the flagged rows
with their reasons -- no rule needs a second scan of the facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import is_missing, to_date_lenient, to_double
from ledgerline.sources import registry as reg

ERROR_SHARE = 0.02   # missing share above which a missing-value issue is an error, not a warning

REPORT_COLUMNS = ["dataset_type", "severity", "field", "message", "data_quality_score", "row_count",
                  "valid_row_count"]


def _rules(dataset_type: str, cols: list[str]):
    """(name, field, severity, invalidates_row, flag expr, message template with %d) per rule."""
    req = reg.STANDARD_SCHEMA[dataset_type]["required"]
    rules = []
    for f in req:
        if f in cols:
            rules.append((f"missing_{f}", f, "missing", True, is_missing(f),
                          f"%d row(s) missing required value for '{f}'."))
    if dataset_type == "sales":
        if "quantity" in cols:
            rules.append(("negative_quantity", "quantity", "error", True,
                          F.coalesce(to_double("quantity") < 0, F.lit(False)),
                          "%d row(s) have negative quantity sold."))
        if "date" in cols:
            rules.append(("bad_date", "date", "error", True, to_date_lenient("date").isNull() & ~is_missing("date"),
                          "%d row(s) have an unparseable date."))
    if dataset_type == "inventory" and "inventory_level" in cols:
        rules.append(("negative_inventory", "inventory_level", "error", True,
                      F.coalesce(to_double("inventory_level") < 0, F.lit(False)),
                      "%d row(s) have negative inventory levels."))
    if dataset_type == "shipments":
        if "planned_delivery" in cols and "actual_delivery" in cols:
            p, a = to_date_lenient("planned_delivery"), to_date_lenient("actual_delivery")
            rules.append(("implausible_delivery", "actual_delivery", "warning", False,
                          F.coalesce(a < F.date_sub(p, 365), F.lit(False)),
                          "%d row(s) have an actual delivery date implausibly earlier than planned."))
        if "distance" in cols:
            rules.append(("negative_distance", "distance", "warning_once", False,
                          F.coalesce(to_double("distance") < 0, F.lit(False)),
                          "Some rows have a negative distance value."))
    if dataset_type == "suppliers":
        if "lead_time" in cols:
            rules.append(("negative_lead_time", "lead_time", "error", True,
                          F.coalesce(to_double("lead_time") < 0, F.lit(False)),
                          "%d row(s) have a negative/impossible lead time."))
        if "reliability" in cols:
            # null/unparseable also counts (pandas: ~NaN.between(0, 1) is True)
            rules.append(("reliability_range", "reliability", "warning", False,
                          ~F.coalesce(to_double("reliability").between(0, 1), F.lit(False)),
                          "%d row(s) have a reliability value outside the expected 0-1 range."))
    return rules


def flag_rows(df: DataFrame, dataset_type: str) -> DataFrame:
    """Adds one boolean column per rule, ``reasons`` (array) and ``is_invalid``."""
    rules = _rules(dataset_type, df.columns)
    out = df.select("*", *[r[4].alias(f"_v_{r[0]}") for r in rules])
    inval = [F.col(f"_v_{r[0]}") for r in rules if r[3]]
    reasons = F.filter(F.array(*[F.when(F.col(f"_v_{r[0]}"), F.lit(r[0])) for r in rules if r[3]]),
                       lambda x: x.isNotNull()) if inval else F.array().cast("array<string>")
    invalid = F.greatest(*inval, F.lit(False)) if inval else F.lit(False)
    return out.withColumn("reasons", reasons).withColumn("is_invalid", invalid)


def validation_report(df: DataFrame, dataset_type: str) -> DataFrame:
    """V1-V12 as rows: one 'summary' row plus one row per error or warning."""
    rules = _rules(dataset_type, df.columns)
    flagged = flag_rows(df, dataset_type)
    aggs = [F.count(F.lit(1)).alias("row_count"), F.count(F.when(F.col("is_invalid"), 1)).alias("invalid")]
    aggs += [F.count(F.when(F.col(f"_v_{r[0]}"), 1)).alias(f"n_{r[0]}") for r in rules]
    one = flagged.agg(*aggs)
    keys = [k for k in reg.DUPLICATE_KEYS if k in df.columns]
    if keys:  # nulls compare equal here, as in pandas' duplicated()
        dups = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_d")).agg(
            F.coalesce(F.sum("_d"), F.lit(0)).alias("n_duplicates"))
        one = one.withColumn("n_duplicates", dups.select("n_duplicates").scalar())
    else:
        one = one.withColumn("n_duplicates", F.lit(0).cast("long"))
    missing_fields = [f for f in reg.STANDARD_SCHEMA[dataset_type]["required"] if f not in df.columns]
    n = F.col("row_count")
    issues = []  # (condition, severity, field, message)
    for f in missing_fields:  # V1
        issues.append((F.lit(True), F.lit("error"), f, F.lit(f"Required field '{f}' is not mapped to any column.")))
    for name, field, kind, _, _, msg in rules:
        cnt = F.col(f"n_{name}")
        if kind == "missing":  # V2: error above 2 % of rows, else warning
            sev = F.when(cnt / F.greatest(n, F.lit(1)) > ERROR_SHARE, "error").otherwise("warning")
            issues.append((cnt > 0, sev, field, F.format_string(msg, cnt)))
        elif kind == "warning_once":
            issues.append((cnt > 0, F.lit("warning"), field, F.lit(msg)))
        else:
            issues.append((cnt > 0, F.lit(kind), field, F.format_string(msg, cnt)))
    if keys:  # V3
        issues.append((F.col("n_duplicates") > 0, F.lit("warning"), None,
                       F.format_string(f"%d duplicate row(s) detected based on {keys}.", F.col("n_duplicates"))))
    n_warn = sum((F.when(cond & (sev == "warning"), 1).otherwise(0) for cond, sev, _, _ in issues), F.lit(0))
    score = (F.lit(100.0) - F.when(n > 0, 40.0 * F.col("invalid") / n).otherwise(0.0)
             - 15.0 * len(missing_fields) - 2.0 * n_warn)
    one = one.withColumn("data_quality_score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(score, 0)))
                         .cast("long"))
    one = one.withColumn("valid_row_count", F.greatest(n - F.col("invalid"), F.lit(0)))
    structs = [F.struct(F.lit("summary").alias("severity"), F.lit(None).cast("string").alias("field"),
                        F.lit(None).cast("string").alias("message"))]
    structs += [F.when(cond, F.struct(sev.alias("severity"), F.lit(field).cast("string").alias("field"),
                                      msg.alias("message"))) for cond, sev, field, msg in issues]
    rows = one.select("data_quality_score", "row_count", "valid_row_count",
                      F.explode(F.filter(F.array(*structs), lambda x: x.isNotNull())).alias("i"))
    return rows.select(F.lit(dataset_type).alias("dataset_type"), "i.severity", "i.field", "i.message",
                       "data_quality_score", "row_count", "valid_row_count")


def quarantine(df: DataFrame, dataset_type: str) -> DataFrame:
    """The invalid rows with their reasons (the reference only counts them)."""
    f = flag_rows(df, dataset_type)
    keep = [c for c in df.columns]
    return f.where("is_invalid").select(*keep, F.array_join("reasons", ",").alias("reasons"))
