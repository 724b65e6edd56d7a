"""The surface that unified diffs add: files, symbols, imports, env, endpoints, cron jobs, dependencies, listeners.

Input are lines (audit_id, line_no, raw).  One exchange on audit_id serves all
windows, joins and aggregates, as every one of them has that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T

SURFACE = ["file", "symbol", "import", "env", "endpoint", "cron", "dep", "listener"]


def split_lines(changes: DataFrame) -> DataFrame:
    """(audit_id, line_no, raw) of (audit_id, diff); line numbers from 0.  Null diffs have no lines."""
    return changes.select("audit_id", F.posexplode(F.split("diff", "\r?\n")).alias("line_no", "raw"))


def scan(lines: DataFrame) -> DataFrame:
    """Lines with file (forward-filled from +++ b/ headers, '' before any), header, is_new (of the header's file), side ('+', '-' or null) and code.

    Each line gets one mark first, so every pattern runs once a line; the
    windows after it work on marks and headers alone.
    """
    raw, mark = F.col("raw"), F.col("mark")
    first = F.substring(raw, 1, 1)
    # n: new file mode, z: no old file, m: old file, p: new file, then added, deleted and other lines
    minus = F.when(F.regexp_extract(raw, X.MINUS, 1) == "/dev/null", "z").otherwise("m")
    plus = F.when(F.startswith(raw, F.lit("+++")), F.when(raw.rlike(X.PLUS), "p").otherwise(" ")).otherwise("+")
    dash = F.when(F.startswith(raw, F.lit("---")), F.when(raw.rlike(X.MINUS), minus).otherwise(" ")).otherwise("-")
    kind = F.when(first == "+", plus).when(first == "-", dash).when(raw.rlike(X.NEW_MODE), "n").otherwise(" ")
    marked = lines.withColumn("mark", kind)
    by = Window.partitionBy("audit_id").orderBy("line_no")
    so_far, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    header = F.when(mark == "p", F.regexp_extract(raw, X.PLUS, 1))
    new = F.max(F.when(mark.isin("n", "z"), F.col("line_no"))).over(before) > F.coalesce(F.max(F.when(~mark.isin("n", "z", "m"), F.col("line_no"))).over(before), F.lit(-1))
    out = marked.withColumn("header", header).select("*", F.coalesce(new, F.lit(False)).alias("fresh"), F.coalesce(F.last("header", ignorenulls=True).over(so_far), F.lit("")).alias("file"))
    # a file is new if any of its headers says so
    out = out.withColumn("is_new", F.max(F.col("header").isNotNull() & F.col("fresh")).over(Window.partitionBy("audit_id", "file")))
    side = F.when(mark.isin("+", "-"), mark)
    return out.select(*[c for c in out.columns if c not in ("mark", "fresh", "is_new")], "is_new", side.alias("side"), F.when(side.isNotNull(), F.substring(raw, F.lit(2), F.length(raw))).alias("code"))


def added_lines(scanned: DataFrame) -> DataFrame:
    return scanned.where("side = '+'").select("audit_id", "line_no", "file", "is_new", "code")


def _renamed(scanned: DataFrame) -> DataFrame:
    """Added and deleted lines with renamed: an added declaration whose shape equals that of a deleted one in the same change."""
    shaped = scanned.where("side is not null").withColumn("shape", T.shape(F.col("code")))
    gone = F.max(F.col("side") == "-").over(Window.partitionBy("audit_id", "shape"))
    return shaped.withColumn("renamed", F.col("shape").isNotNull() & gone).where("side = '+'")


def renames(scanned: DataFrame) -> DataFrame:
    """Added declarations whose shape equals that of a deleted one in the same change: audit_id, line_no."""
    return _renamed(scanned).where("renamed").select("audit_id", "line_no")


def surface(scanned: DataFrame) -> DataFrame:
    """(audit_id, kind, item, first): every item once per kind, first is its order of appearance.

    Each kind's patterns run on the lines that a cheap test lets through.
    """
    rows = _renamed(scanned).select("audit_id", "line_no", "file", "is_new", "code", "renamed", F.when(~T.is_comment(F.col("code")), F.col("code")).alias("live"))
    # one function over the line: a projection of all extractors would be more code than a compiled stage may have
    found = T.let(F.struct("code", "live", "file", "is_new", "renamed"), lambda r: _items(r["code"], r["live"], r["file"], r["is_new"], r["renamed"]))
    long = rows.select("audit_id", "line_no", F.explode(found).alias("s"))
    return long.groupBy("audit_id", F.col("s.kind").alias("kind"), F.col("s.item").alias("item")).agg(F.min(F.col("line_no").cast("long") * 16 + F.col("s.n")).alias("first"))


def _items(code: Column, live: Column, file: Column, is_new: Column, renamed: Column) -> Column:
    """What one added line adds: an array of (kind, item, n); live is the code of lines that are no comment."""
    found: list[tuple[str, Column]] = [
        ("file", F.nullif(file, F.lit(""))),
        ("endpoint", F.when(is_new, T.route_of_file(file))),
        ("import", T.python_import(code)),
        ("import", T.script_import(code)),
        ("import", T.go_import(code)),
        ("env", F.coalesce(T.env(live), T.dotenv(code, file))),
        ("endpoint", T.endpoint(live)),
        ("cron", T.cron(live)),
        ("listener", T.listener(live)),
        ("symbol", F.when(~renamed, T.symbol(code))),
        ("symbol", T.infrastructure(code, file)),
        ("dep", F.when(file != "", T.dependency(code, file))),
    ]
    return F.filter(F.array(*[F.struct(F.lit(kind).alias("kind"), item.alias("item"), F.lit(n).alias("n")) for n, (kind, item) in enumerate(found)]), lambda s: s["item"].isNotNull())


def actual(found: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per change: an array of items for each kind, in order of appearance; empty where there are none."""
    sets = found.groupBy("audit_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("first", "item")))), lambda s: s["item"]).alias(k) for k in SURFACE])
    return changes.select("audit_id").join(sets, "audit_id", "left").select("audit_id", *[F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in SURFACE])


def changed_files(scanned: DataFrame) -> DataFrame:
    """Files that a header names, with or without added lines."""
    return scanned.where("header is not null").select("audit_id", F.col("header").alias("file")).distinct()


def file_stats(scanned: DataFrame) -> DataFrame:
    """(audit_id, file, lines_added, added_code, is_new, ord) of files with added lines; ord: order of the files' headers."""
    heads = scanned.where("header is not null").groupBy("audit_id", F.col("header").alias("file")).agg(F.min("line_no").alias("ord"))
    stats = (
        added_lines(scanned)
        .where("file != ''")
        .groupBy("audit_id", "file")
        .agg(F.count("*").alias("lines_added"), F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "code"))), lambda s: s["code"]), "\n"), F.lit("\n")).alias("added_code"), F.max("is_new").alias("is_new"))
    )
    return stats.join(heads, ["audit_id", "file"])


def size_metrics(changes: DataFrame) -> DataFrame:
    """diff_lines: line feeds, and one more where the last line has none; 0 for empty diffs."""
    n = F.regexp_count("diff", F.lit("\n"))
    lines = F.when(F.col("diff") == "", 0).when(F.endswith(F.col("diff"), F.lit("\n")), n).otherwise(n + 1)
    return changes.select("audit_id", F.length("diff").alias("diff_chars"), lines.alias("diff_lines"))


def symbols_of_files(files: DataFrame) -> DataFrame:
    """(file, symbol, first) of whole file texts (file, text): the declarations of every line."""
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "code"))
    return lines.select("file", "line_no", T.symbol(F.col("code")).alias("symbol")).where("symbol is not null").groupBy("file", "symbol").agg(F.min("line_no").alias("first"))
