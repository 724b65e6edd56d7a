"""Counts that may leave a machine, and the warehouse of first runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X

#: Least share of passed cases of a suite that counts as good.
PASS_SHARE = 0.80
KINDS = [*X.FINDING_KINDS, "handoff.context", "handoff.reasoning"]
LANGUAGES = ["python", "typescript", "javascript", "auto", "unknown"]
PROVIDERS = ["override", "unknown"]


def allowed(value: Column, values: list[str]) -> Column:
    return F.when(value.isin(values), value).otherwise(F.lit("unknown"))


def model_name(value: Column) -> Column:
    return F.when(value.rlike(X.MODEL), value).otherwise(F.lit("unknown"))


def finite(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value.cast("double")) | (F.abs(value.cast("double")) == float("inf")), F.lit(0)).otherwise(value)


def events(found: DataFrame, scored: DataFrame) -> DataFrame:
    """(audit_id, score, findings_count, finding_kinds): counts by kind as a map, nothing of what was found."""
    kinds = found.groupBy("audit_id", allowed(F.col("kind"), KINDS).alias("kind")).agg(F.count("*").alias("n")).groupBy("audit_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return scored.join(kinds, "audit_id", "left").select("audit_id", "score", F.col("n_findings").alias("findings_count"), F.coalesce("kinds", empty).alias("finding_kinds"))


def valid_payloads(raw: DataFrame) -> DataFrame:
    """Pings in JSON that have all fields with their types, as columns; text that is no JSON object is none."""
    v = F.try_parse_json("body")

    def field(name: str, *types: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        return F.regexp_replace(kind, r"\(.*", "").isin(*types)

    text = [field(n, "STRING") for n in ("event", "os", "arch", "node", "v", "ts")]
    valid = field("vendors", "BIGINT", "DECIMAL", "DOUBLE")
    for t in text:
        valid = valid & t
    p = F.from_json("body", "event string, os string, arch string, node string, vendors double, v string, ts string")
    rows = raw.where(F.coalesce(valid, F.lit(False))).withColumn("p", p).where("p.event = 'init'")
    return rows.select("p.os", "p.arch", F.col("p.node").alias("node_version"), F.col("p.vendors").cast("int").alias("vendors"), F.col("p.v").alias("version"), F.col("p.ts").alias("client_ts"))


def total(inits: DataFrame) -> DataFrame:
    return inits.agg(F.count("*").alias("count"))


def counts(inits: DataFrame, key: str, by_key: bool = False) -> DataFrame:
    """Rows of each value of the key: the most frequent first, or in the order of the key."""
    return inits.groupBy(key).agg(F.count("*").alias("count")).orderBy(*([key] if by_key else [F.desc("count"), key]))


def recent(inits: DataFrame, n: int = 20) -> DataFrame:
    return inits.orderBy(F.desc("received_at"), "event_id").limit(n)


def daily(inits: DataFrame, n: int = 30) -> DataFrame:
    return inits.groupBy(F.to_date("received_at").alias("day")).agg(F.count("*").alias("count")).orderBy(F.desc("day")).limit(n)


def suite_results(outputs: DataFrame, threshold: float = PASS_SHARE) -> DataFrame:
    """(model, suite, passed, total, share, skipped, fails, good) of (model, suite, output): what a test run printed, parsed.

    "x/y passed" or "x passed, y failed"; good: a share of `threshold` at least.
    Runs that print neither have null counts, and those that say SKIP are skipped.
    """
    text = F.coalesce("output", F.lit(""))
    of = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit("")).cast("int")
    over, passed, failed = of(X.RUN_OVER, 1), of(X.RUN_COUNTS, 1), of(X.RUN_COUNTS, 2)
    total = F.coalesce(of(X.RUN_OVER, 2), passed + failed)
    rows = outputs.select("model", "suite", F.coalesce(over, passed).alias("passed"), total.alias("total"), F.exists(F.split(text, "\n"), lambda line: F.trim(line).rlike(X.RUN_SKIP)).alias("skipped"), F.regexp_extract_all(text, F.lit(X.RUN_FAIL), 1).alias("fails"))
    share = F.when(F.col("total") > 0, F.col("passed") / F.col("total"))
    return rows.select("model", "suite", "passed", "total", share.alias("share"), "skipped", F.transform("fails", F.trim).alias("fails"), F.coalesce(share >= threshold, F.lit(False)).alias("good"))


def pass_matrix(results: DataFrame) -> DataFrame:
    """(model, suites, passed, total, all_good): a row for each model over its suites that were not skipped."""
    return results.where("not skipped").groupBy("model").agg(F.count("*").alias("suites"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.min("good").alias("all_good"))


def change_rate(runs: DataFrame) -> DataFrame:
    """Share of runs whose second pass changed the scope, among those that had one."""
    return runs.where("reconcile_ran").agg(F.avg(F.col("reconcile_changed").cast("int")).alias("rate"))
