"""Cross-file warnings on a change: one aggregate per audit over its files, then the rules in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X

_FLAGS = [*X.FILE_CLASSES, "source"]


def classified(stats: DataFrame) -> DataFrame:
    """operators.diff.file_stats with a flag for each class of file."""
    flags = [F.col("file").rlike("(?i)" + p).alias(c) for c, p in X.FILE_CLASSES.items()]
    return stats.select("*", *flags).withColumn("source", F.col("code") & ~F.col("test") & ~F.col("config"))


def _all(code: Column, patterns: list[str]) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(code, F.lit(p), 1) for p in patterns]))


def warnings(stats: DataFrame, keep: int = X.WARNINGS_KEPT) -> DataFrame:
    """(audit_id, ord, pattern, message, files, suggestion): the first `keep` rules that fire, for audits of two files or more.

    Files stand in the order of their headers.
    """
    none = F.array().cast("array<string>")
    read = F.when(F.col("source"), _all(F.col("added_code"), X.ENV_ALL)).otherwise(none)
    defined = F.when(F.col("env_file"), F.regexp_extract_all("added_code", F.lit("(?m)" + X.DOTENV), 1)).otherwise(none)
    row = F.struct(
        "ord", "file", "lines_added", "is_new", *_FLAGS, read.alias("read"), defined.alias("defined"), F.col("added_code").rlike(X.SECRET).alias("secret"), F.col("added_code").rlike(X.DEBT).alias("debt"), F.col("added_code").rlike(X.PACKAGE_LINE).alias("dep_line"),
        F.regexp_extract_all("added_code", F.lit(X.IMPORTED), 1).alias("imported"), F.element_at(F.split(F.regexp_replace("file", r"\.(ts|js|tsx|jsx|py|go|rs)$", ""), "/"), -1).alias("base"), "added_code",
    )
    sets = classified(stats).groupBy("audit_id").agg(F.array_sort(F.collect_list(row)).alias("f")).where(F.size("f") >= 2)
    f = F.col("f")

    def of(test) -> Column:
        return F.transform(F.filter(f, test), lambda x: x["file"])

    for flag in _FLAGS:
        sets = sets.withColumn(flag, _flagged(f, flag))
    union = lambda k: F.array_distinct(F.flatten(F.transform(f, lambda x: x[k])))
    sets = sets.withColumn("read", union("read")).withColumn("defined", union("defined")).withColumn("imported", union("imported"))
    sets = sets.withColumn("missing", F.array_except("read", "defined"))
    n = lambda c: F.size(c)
    missing, imported = F.col("missing"), F.col("imported")
    naming = of(lambda x: x["source"] & F.exists(missing, lambda v: F.contains(x["added_code"], v)))
    routes_new, big = of(lambda x: x["route"] & x["is_new"]), F.transform(F.filter(f, lambda x: x["lines_added"] >= 200), lambda x: F.concat(x["file"], F.lit(" (+"), x["lines_added"].cast("string"), F.lit(")")))
    secret, debt = of(lambda x: x["source"] & x["secret"]), of(lambda x: x["debt"])
    orphan = of(lambda x: x["is_new"] & x["source"] & ~F.exists(imported, lambda i: F.contains(i, x["base"])))
    wide = of(lambda x: x["route"] & (x["lines_added"] >= 5))
    plural = lambda files, tail: F.concat(n(files).cast("string"), F.when(n(files) > 1, F.lit(f" {tail}s")).otherwise(F.lit(f" {tail}")))
    fires: dict[str, tuple[Column, Column, Column | None]] = {
        "schema-no-migration": ((n("schema") > 0) & (n("migration") == 0), F.col("schema"), None),
        "env-not-in-dotenv": ((n(missing) > 0) & (n("env_file") > 0), F.concat(naming, F.col("env_file")), F.array_join(missing, ", ")),
        "env-defined-not-used": ((n("env_file") > 0) & (n("defined") > 0) & (n("read") == 0) & (n("source") > 0), F.col("env_file"), None),
        "route-no-test": ((n("test") == 0) & (n(routes_new) > 0), routes_new, None),
        "many-changes-no-tests": ((n("source") >= 3) & (n("test") == 0), F.col("source"), n("source").cast("string")),
        # needs a changed types file and none: never
        "exports-no-types": (F.lit(False), none, None),
        "infra-only": ((n("docker") + n("ci") > 0) & (n("source") == 0), F.concat("docker", "ci"), None),
        "config-sprawl": (n("config") >= 3, F.col("config"), n("config").cast("string")),
        "schema-migration-pair": ((n("schema") > 0) & (n("migration") > 0), F.concat("schema", "migration"), None),
        "deps-no-lockfile": ((n("package") > 0) & (n("lock") == 0) & F.exists(f, lambda x: x["package"] & x["dep_line"]), F.col("package"), None),
        "styles-no-component": ((n("style") > 0) & (n("component") == 0) & (n("source") == 0), F.col("style"), None),
        "auth-middleware-changed": (n("middleware") > 0, F.col("middleware"), None),
        "large-file": (n(big) > 0, big, plural(big, "file")),
        "hardcoded-secret": (n(secret) > 0, secret, None),
        "tech-debt-added": (n(debt) >= 2, debt, n(debt).cast("string")),
        "new-file-not-imported": (n(orphan) > 0, orphan, plural(orphan, "new file")),
        "api-no-docs": ((n("docs") == 0) & (n(wide) > 0), wide, None),
    }
    rows = []
    for rank, (pattern, message, suggestion) in enumerate(X.RULES, 1):
        test, files, count = fires[pattern]
        said = F.lit(message) if count is None else F.concat(count, F.lit(message[1:]))
        rows.append(F.when(test, F.struct(F.lit(rank).alias("rank"), F.lit(pattern).alias("pattern"), said.alias("message"), files.alias("files"), F.lit(suggestion).alias("suggestion"))))
    found = F.slice(F.filter(F.array(*rows), lambda x: x.isNotNull()), 1, keep)
    return sets.select("audit_id", F.posexplode(found).alias("ord", "w")).select("audit_id", (F.col("ord") + 1).alias("ord"), "w.pattern", "w.message", "w.files", "w.suggestion")


def _flagged(f: Column, flag: str) -> Column:
    return F.transform(F.filter(f, lambda x: x[flag]), lambda x: x["file"])
