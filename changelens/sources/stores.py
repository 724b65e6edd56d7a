"""Reading diffs, prompts and JSON stores, and writing reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


#: What a scope argument may have.
SCOPE_FIELDS = {"files_allowed": "files", "features_allowed": "features", "endpoints_allowed": "endpoints", "deps_allowed": "deps", "env_allowed": "env", "behavioral_changes_allowed": "behavioral"}


def read_diffs(spark: SparkSession, path: str, name: str = r"([^/]+?)(?:\.[^./]*)?$") -> DataFrame:
    """(audit_id, diff): one change for each file under path, named by what `name` finds in its path."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), name, 1).alias("audit_id"), F.col("value").alias("diff"))


def diff_sizes(changes: DataFrame) -> DataFrame:
    return changes.select("audit_id", F.regexp_count("diff", F.lit(r"(?m)^[+-]")).alias("changed_lines"))


def diff_sources(rows: DataFrame) -> DataFrame:
    """(audit_id, rank, label, changed_lines, chosen) of (audit_id, rank, label, diff): the sources that are not blank; the first of each audit is chosen."""
    some = rows.where(F.trim(F.regexp_replace("diff", r"\s+", " ")) != "").select("audit_id", "rank", "label", F.regexp_count("diff", F.lit(r"(?m)^[+-]")).alias("changed_lines"))
    first = F.min("rank").over(Window.partitionBy("audit_id"))
    return some.withColumn("chosen", F.col("rank") == first)


def scope_argument(rows: DataFrame, text: str = "scope") -> DataFrame:
    """(audit_id, valid, files, features, endpoints, deps, env, behavioral) of a scope given as JSON; not valid where it is no object, and then empty."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", "")
    parsed = F.from_json(raw, ", ".join(f"{k} array<string>" for k in SCOPE_FIELDS), {"mode": "PERMISSIVE"})
    valid = F.startswith(raw, F.lit("{")) & F.get_json_object(raw, "$").isNotNull()
    none = F.array().cast("array<string>")
    return rows.withColumn("v", valid).withColumn("p", parsed).select("audit_id", F.col("v").alias("valid"), *[F.when(F.col("v"), F.coalesce(F.col("p")[k], none)).otherwise(none).alias(n) for k, n in SCOPE_FIELDS.items()])


def prompt_of(*sources: Column) -> Column:
    """The first source that is not blank, in order of precedence."""
    return F.coalesce(*[F.when(F.trim(s) != "", s) for s in sources])


def read_store(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON array store (a file, which its cap keeps small); a missing or broken one, and one that is no array, is empty."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    row = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = spark.read.text(path, wholetext=True).where(F.regexp_like("value", F.lit(r"^\s*\[")) & F.get_json_object("value", "$").isNotNull())
    return whole.select(F.explode(F.from_json("value", ArrayType(row))).alias("r")).where("r is not null").select("r.*")


def append_store(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def cache_key(provider: Column, model: Column, prompt: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", provider, model, prompt), 256), 1, 32)


def cacheable(results: DataFrame) -> DataFrame:
    """Results whose scope may be cached: neither skipped nor made without a model."""
    return results.where("not coalesce(skipped, false) and not coalesce(deterministic, false)")


def with_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (…, provider, model, prompt) with the cached scope, null on a miss; of several the latest."""
    latest = cache.groupBy("prompt_hash").agg(F.max_by("scope", "cached_at").alias("cached_scope"))
    keyed = requests.withColumn("prompt_hash", cache_key(F.col("provider"), F.col("model"), F.col("prompt")))
    return keyed.join(latest, "prompt_hash", "left")


def to_json(results: DataFrame) -> DataFrame:
    return results.select("audit_id", F.to_json(F.struct(*results.columns)).alias("json"))


def report(found: DataFrame, low_kept: int = 3, low_limit: int = 5) -> DataFrame:
    """(audit_id, severity, n, shown): findings by severity as text; of more than low_limit low ones the first low_kept."""
    line = F.concat(F.col("kind"), F.lit(": "), F.col("detail"))
    sets = found.groupBy("audit_id", "severity").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda s: s["line"]).alias("lines"))
    short = (F.col("severity") == "low") & (F.col("n") > low_limit)
    return sets.select("audit_id", "severity", "n", F.array_join(F.when(short, F.slice("lines", 1, low_kept)).otherwise(F.col("lines")), "\n").alias("shown"))


def gate(scored: DataFrame, fail_on: str = "high") -> DataFrame:
    """exit_code as of a command (1 on HIGH), and gate_failed for scores in the comma-joined list."""
    listed = F.transform(F.split(F.lit(fail_on), ","), lambda s: F.lower(F.trim(s)))
    return scored.select("audit_id", "score", F.when(F.col("score") == "HIGH", 1).otherwise(0).alias("exit_code"), F.array_contains(listed, F.lower("score")).alias("gate_failed"))


def real_files(found: DataFrame, surface_lines: DataFrame) -> DataFrame:
    """Findings with real_file: the file of the first added line that has the evidence (audit_id, line_no, file, code); their own file where none has."""
    rows = found.join(surface_lines.select("audit_id", "line_no", F.col("file").alias("at_file"), "code"), "audit_id", "left").where(F.contains("code", F.col("evidence")) | F.col("code").isNull())
    first = rows.groupBy("audit_id", "ord").agg(F.min_by("at_file", "line_no").alias("at_file"))
    return found.join(first, ["audit_id", "ord"], "left").withColumn("real_file", F.when(F.col("kind") == "scope.file", F.col("file")).otherwise(F.coalesce("at_file", "file"))).drop("at_file")
