"""What a change adds beyond its authorised scope.

The scope of an audit is one row of arrays, so each membership test is a join
on audit_id and a predicate over its entries: no pair of an item and an entry
becomes a row.  Empty entries authorise nothing and are dropped on the way in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T

_KIND_OF = {"file": "scope.file", "dep": "scope.dep", "env": "scope.env", "endpoint": "scope.endpoint", "cron": "scope.cron", "listener": "scope.listener", "symbol": "scope.feature"}
FIELDS = ["files", "features", "endpoints", "deps", "env", "behavioral"]


def scope_rows(entries: DataFrame) -> DataFrame:
    """One row of arrays per audit from (audit_id, field, entry, pos)."""
    wide = entries.where("entry is not null and entry != ''").groupBy("audit_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("pos", "entry")))), lambda s: s["entry"]).alias(f) for f in FIELDS])
    return wide


def _fuzzy(item: Column, *fields: str) -> Column:
    """Whether the item is fuzzily equal to an entry of the fields, whose normal forms stand in columns n_<field>."""
    entries = F.concat(*[F.col(f"n_{f}") for f in fields])
    return T.let(T.norm(item), lambda n: F.exists(entries, lambda a: T.fuzzy_norm(n, a)))


def _keyword(words: list[str]) -> Column:
    said = F.lower(F.array_join(F.concat("features", "behavioral"), " "))
    return T.let(said, lambda s: F.exists(F.array(*map(F.lit, words)), lambda w: T.has(s, w)))


def _file(item: Column) -> Column:
    return (F.size("files") == 0) | T.support_file(item) | T.member_path(item, F.concat("files", "features"))


def _dep(item: Column) -> Column:
    same = F.exists("deps", lambda a: F.lower(a) == F.lower(item))
    return same | _fuzzy(item, "deps", "features", "endpoints", "env", "behavioral")


def _env(item: Column) -> Column:
    return F.exists("env", lambda a: F.lower(a) == F.lower(item)) | _fuzzy(item, "env")


def _endpoint(item: Column) -> Column:
    return T.let(T.norm_endpoint(item), lambda a: F.exists("candidates", lambda b: T.endpoint_matches(a, b)))


def _runtime(item: Column) -> Column:
    return _fuzzy(item, "features", "behavioral")


def _symbol(item: Column) -> Column:
    inside = F.concat(F.col("n_features"), F.col("n_behavioral"))

    def covered(n: Column) -> Column:
        near = F.exists(F.concat(inside, F.col("n_files")), lambda a: T.fuzzy_norm(n, a)) | F.exists(inside, lambda a: T.symbol_in_norm(n, a))
        return near | F.exists("leaves", lambda e: (F.length(e) >= 3) & ((n == e) | (T.has(n, e) & (F.length(e) >= F.length(n) * F.lit(0.7)))))

    return (F.length(item) < 5) | T.let(T.norm(item), covered)


def findings(actual: DataFrame, scope: DataFrame) -> DataFrame:
    """(audit_id, ord, kind, severity, detail, file, evidence) of rows of operators.diff.actual; ord from 1 in the order of kinds and of appearance.

    Without a scope nothing is authorised, and files are unconstrained.
    """
    none = F.array().cast("array<string>")
    # items and scope share the name env: items get a prefix
    items = actual.select("audit_id", *[F.col(k).alias(f"i_{k}") for k in _KIND_OF])
    rows = items.join(scope, "audit_id", "left").select("audit_id", *[f"i_{k}" for k in _KIND_OF], *[F.coalesce(f, none).alias(f) for f in FIELDS])
    rows = rows.select("*", *[F.transform(f, T.norm).alias(f"n_{f}") for f in FIELDS], F.flatten(F.transform("endpoints", T.endpoint_candidates)).alias("candidates"), F.transform("endpoints", lambda a: T.norm(F.regexp_replace(a, ".*/", ""))).alias("leaves"))
    each = {"file": _file, "dep": _dep, "env": _env, "endpoint": _endpoint, "symbol": _symbol}

    def uncovered(kind: str, test) -> Column:
        return F.filter(f"i_{kind}", lambda i: ~test(i))

    left = {k: uncovered(k, test) for k, test in each.items()}
    # one authorised cron job authorises all of its audit; a keyword authorises all listeners
    left["cron"] = F.when(_keyword(X.CRON_KEYWORDS) | F.exists("i_cron", _runtime), none).otherwise(F.col("i_cron"))
    left["listener"] = F.when(_keyword(X.LISTENER_KEYWORDS), none).otherwise(F.filter("i_listener", lambda i: ~_runtime(i)))
    rows = rows.select("audit_id", *[left[k].alias(k) for k in _KIND_OF])

    def named(kind: str):
        name = _KIND_OF[kind]
        severity, file = next((s, f) for k, s, f in X.KINDS if k == name)
        lead, end = X.DETAILS[name]
        return lambda i: F.struct(F.lit(name).alias("kind"), F.lit(severity).alias("severity"), F.concat(F.lit(lead), i, F.lit(end)).alias("detail"), (i if file is None else F.lit(file)).alias("file"), i.alias("evidence"))

    found = F.concat(*[F.transform(k, named(k)) for k in _KIND_OF])
    return rows.select("audit_id", F.posexplode(found).alias("ord", "f")).select("audit_id", (F.col("ord") + 1).alias("ord"), "f.kind", "f.severity", "f.detail", "f.file", "f.evidence")


def scores(found: DataFrame, audits: DataFrame) -> DataFrame:
    """(audit_id, n_findings, score, summary) for every audit, those without findings as well."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    kinds = found.groupBy("audit_id", "kind").agg(F.count("*").alias("n"), F.min("ord").alias("ord"), F.max(rank).alias("rank"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.col("n").cast("string"), F.lit(" "), F.col("kind")).alias("part")))), lambda s: s["part"]), ", ")
    total = kinds.groupBy("audit_id").agg(F.sum("n").alias("n"), F.max("rank").alias("rank"), parts.alias("parts"))
    n, score = F.coalesce("n", F.lit(0)), F.when(F.col("rank") == 3, "HIGH").when(F.col("rank") == 2, "MEDIUM").otherwise("LOW")
    end = F.concat(F.lit("scope_creep_score="), score)
    summary = F.when(n == 0, F.concat(F.lit("Diff adds 0 unauthorized thing(s). "), end)).otherwise(F.concat(F.lit("Diff adds "), n.cast("string"), F.lit(" unauthorized thing(s): "), F.col("parts"), F.lit(". "), end))
    return audits.select("audit_id").join(total, "audit_id", "left").select("audit_id", n.alias("n_findings"), score.alias("score"), summary.alias("summary"))
