"""The ledger: an append-only table (entry_id, agent, task, file or files, score, findings_count, at, contract_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 500
TASK_CHARS = 200


def clipped(task: Column) -> Column:
    return F.when(F.length(task) > TASK_CHARS, F.concat(F.substring(task, 1, TASK_CHARS), F.lit("..."))).otherwise(task)


def appended(entries: DataFrame) -> DataFrame:
    """Entries without repeats of a contract id; the first stays, entries without one all do."""
    named = entries.where("contract_id is not null")
    first = named.groupBy("contract_id").agg(F.min("entry_id").alias("entry_id"))
    return named.join(first, ["contract_id", "entry_id"], "left_semi").select(*entries.columns).unionByName(entries.where("contract_id is null")).withColumn("task", clipped(F.col("task")))


def latest(entries: DataFrame, cap: int = CAP) -> DataFrame:
    return entries.orderBy(F.desc("entry_id")).limit(cap)


def same_file(a: Column, b: Column) -> Column:
    """Equal, or one is the other's end after a slash."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def by_file(entries: DataFrame, file: str) -> DataFrame:
    return entries.where(same_file(F.col("file"), F.lit(file)))


def by_agent(entries: DataFrame, agent: str) -> DataFrame:
    return entries.where(F.lower("agent") == agent.lower())


def ownership(entries: DataFrame) -> DataFrame:
    """(file, n, history): who touched each file, in order of time."""
    return entries.groupBy("file").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("at", "entry_id", "agent", "task"))).alias("history"))


def last_seen(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.lower("agent").alias("agent")).agg(F.max("at").alias("last_seen"))


def since(entries: DataFrame, cutoff: Column) -> DataFrame:
    return entries.where(F.col("at") > cutoff)


def cutoffs(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """(request_id, cutoff, note, invalid_since): the later of a given time and the agent's last entry.

    A time that can't be read is returned as invalid_since, without a cutoff; an
    agent without entries gives a note.
    """
    asked = F.nullif(F.col("since"), F.lit(""))
    given = F.try_to_timestamp(asked)
    invalid = F.when(given.isNull(), asked)
    rows = requests.join(last_seen(entries).withColumnRenamed("agent", "a"), F.lower("agent") == F.col("a"), "left")
    note = F.when(invalid.isNull() & (F.col("agent") != "") & F.col("last_seen").isNull(), F.format_string('no prior work recorded by "%s" — showing everything', "agent"))
    return rows.select("request_id", F.when(invalid.isNull(), F.greatest(given, F.col("last_seen"))).alias("cutoff"), note.alias("note"), invalid.alias("invalid_since"))


def catch_up(entries: DataFrame) -> DataFrame:
    """(agent, missed): for every agent, how many entries of others came after its own last one.

    Entries are counted backwards by running sums, over the days and within each
    day, at the agents' last entries; no pair of an agent and an entry becomes a row.
    """
    own = entries.groupBy("agent").agg(F.max("at").alias("own"))
    per = entries.groupBy("at").agg(F.count("*").alias("e")).withColumn("day", F.date_trunc("day", "at"))
    # totals of the days after; one row per day
    later = Window.orderBy(F.desc("day"))
    days = per.groupBy("day").agg(F.sum("e").alias("n")).withColumn("after", F.sum("n").over(later) - F.col("n")).select("day", "after")
    today = per.withColumn("today", F.sum("e").over(Window.partitionBy("day").orderBy(F.desc("at"))) - F.col("e"))
    return own.join(today.join(days, "day").withColumnRenamed("at", "own"), "own", "left").select("agent", (F.coalesce("after", F.lit(0)) + F.coalesce("today", F.lit(0))).alias("missed"))


def entry_line(rank: Column, agent: Column, task: Column, score: Column, findings: Column, files: Column, at: Column) -> Column:
    return F.format_string("%d. [%s] %s (%s, %d findings, files: %s) — %s", rank, agent, task, score, findings, F.when(files == "", "none").otherwise(files), at)


def deltas(entries: DataFrame) -> DataFrame:
    """(agent, n, text): what each agent missed, entries after its own last one in order, as text; agents that missed nothing as well.

    For the agents of one ledger, whose entries a cap bounds: a list per agent.
    """
    moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    own = last_seen(entries)
    later = own.join(entries.withColumnRenamed("agent", "other"), F.col("at") > F.col("last_seen"))
    rank = F.row_number().over(Window.partitionBy("agent").orderBy("at", "entry_id"))
    rows = later.withColumn("rank", rank).withColumn("line", entry_line(F.col("rank"), F.col("other"), F.col("task"), F.col("score"), F.col("findings_count"), F.col("file"), moment("at")))
    sets = rows.groupBy("agent").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n").alias("body"))
    origin = F.format_string("since %s last checked in (%s)", "agent", moment("last_seen"))
    n = F.coalesce("n", F.lit(0))
    text = F.when(n == 0, F.concat(F.lit("No work recorded "), origin, F.lit("."))).otherwise(F.concat(F.lit("Work "), origin, F.lit(" — "), n.cast("string"), F.when(n == 1, " new entry:\n").otherwise(" new entries:\n"), F.col("body")))
    return own.join(sets, "agent", "left").select("agent", n.alias("n"), text.alias("text"))


def lines(entries: DataFrame) -> DataFrame:
    """One line of text per entry."""
    return entries.select("entry_id", F.format_string("[%s] %s — %s (%s, %d findings)", F.date_format("at", "yyyy-MM-dd HH:mm:ss"), "agent", "task", "score", "findings_count").alias("line"))
