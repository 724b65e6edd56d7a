"""Check-ins, collisions between agents on a file, and the gate before a merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLIT_SYMBOLS = 4


def check_ins(events: DataFrame) -> DataFrame:
    """(agent, at, previous): every check-in with the one before it."""
    return events.select("agent", "at", F.lag("at").over(Window.partitionBy("agent").orderBy("at")).alias("previous"))


def delta_counts(checked: DataFrame, entries: DataFrame) -> DataFrame:
    """(agent, at, first, n): entries of the ledger a check-in reports.

    After a check-in, all entries later than the previous one; at the first,
    all entries of other agents.  An entry counts if it was there at the time.
    Entries and check-ins are counted by running sums over one order of time in
    each day, so no pair of a check-in and an entry becomes a row.
    """
    moments = entries.select("at", F.lit(1).alias("e")).unionByName(checked.select("at", F.lit(0).alias("e"))).unionByName(checked.where("previous is not null").select(F.col("previous").alias("at"), F.lit(0).alias("e")))
    per = moments.groupBy("at").agg(F.sum("e").alias("e"))
    day = F.date_trunc("day", "at")
    # totals of the days before; one row per day
    days = per.groupBy(day.alias("day")).agg(F.sum("e").alias("n"))
    days = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    upto = per.withColumn("day", day).join(days, "day").withColumn("upto", F.col("before") + F.sum("e").over(Window.partitionBy("day").orderBy("at"))).select("at", "upto")
    own = entries.groupBy(F.lower("agent").alias("who"), "at").agg(F.count("*").alias("c"))
    mine = checked.where("previous is null").select(F.lower("agent").alias("who"), F.col("at").alias("seen")).join(own, "who").where("at <= seen").groupBy("who").agg(F.sum("c").alias("mine"))
    rows = checked.join(upto, "at").join(upto.select(F.col("at").alias("previous"), F.col("upto").alias("old")), "previous", "left")
    rows = rows.join(mine, F.lower("agent") == F.col("who"), "left")
    first = F.col("previous").isNull()
    return rows.select("agent", "at", first.alias("first"), F.when(first, F.col("upto") - F.coalesce("mine", F.lit(0))).otherwise(F.col("upto") - F.col("old")).cast("long").alias("n"))


def active_claims(file_claims: DataFrame, scope_files: DataFrame) -> DataFrame:
    """(agent, files): files of both kinds of claims, sorted, for each agent."""
    both = file_claims.select("agent", "file").union(scope_files.select("agent", "file"))
    return both.groupBy("agent").agg(F.array_sort(F.collect_set("file")).alias("files"))


def claim_entries(file_claims: DataFrame, scope_files: DataFrame) -> DataFrame:
    """(agent, file, task, op) of file claims (agent, file, task) and of files of scope claims (agent, file, task, op)."""
    return file_claims.select("agent", "file", "task", F.lit("claim").alias("op")).union(scope_files.select("agent", "file", "task", "op"))


def renewed(checked: DataFrame, file_claims: DataFrame, hours: float = 2) -> DataFrame:
    """(agent, file, expires_at): own claims that had not expired at the check-in (agent, at) run for `hours` from it; exact agent names."""
    own = checked.select("agent", "at").join(file_claims.select("agent", "file", "expires_at"), "agent").where("expires_at >= at")
    return own.select("agent", "file", (F.col("at") + F.make_dt_interval(hours=F.lit(int(hours)))).alias("expires_at"))


def _listed(frame: DataFrame, key: str, name: str, line, *order: str) -> DataFrame:
    """(key, name, n_name): lines of each key in order, joined."""
    rows = frame.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("x"))
    return rows.select(key, F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias(name), F.size("x").alias(f"n_{name}"))


def check_in_text(checked: DataFrame, renewals: DataFrame, entries: DataFrame, deltas: DataFrame, records: DataFrame) -> DataFrame:
    """(agent, text): the report of each agent's check-in (agent, at, previous).

    renewals: (agent, file); entries: claim_entries of all agents; deltas:
    (agent, text); records: open conflicts (conflict_id, files, agents).  What
    is active is one text for all, so its claims should be those of one project.
    """
    op = F.when(F.col("op") != "claim", F.concat(F.lit(" ["), "op", F.lit("]"))).otherwise(F.lit(""))
    per = _listed(entries, "agent", "own", F.concat(F.lit("    "), "file", op, F.lit(" — "), "task"), "file", "op", "task")
    active = per.withColumn("k", F.lit(1)).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("agent", "own"))), lambda s: F.concat(F.lit("  "), s["agent"], F.lit(":\n"), s["own"])), "\n").alias("active"))
    mine = renewals.groupBy("agent").agg(F.array_join(F.array_sort(F.collect_list("file")), ", ").alias("names"), F.count("*").alias("n_names"))
    involved = records.select("conflict_id", "files", "agents", F.explode(F.array_distinct(F.transform("agents", F.lower))).alias("who"))
    about = _listed(involved, "who", "about", F.format_string("  %s — files [%s] between [%s] (open)", "conflict_id", F.array_join("files", ", "), F.array_join("agents", ", ")), "conflict_id")
    rows = checked.withColumn("k", F.lit(1)).withColumn("who", F.lower("agent")).join(mine, "agent", "left").join(F.broadcast(active), "k", "left").join(deltas.select("agent", F.col("text").alias("delta")), "agent", "left").join(about, "who", "left")
    claims = F.when(F.col("n_names") > 0, F.concat(F.lit("Your claims renewed: "), F.col("n_names").cast("string"), F.when(F.col("n_names") == 1, " file claim (").otherwise(" file claims ("), "names", F.lit(").")))
    conflicts = F.when(F.col("n_about") > 0, F.concat(F.lit("Conflicts involving you ("), F.col("n_about").cast("string"), F.when(F.col("n_about") == 1, " conflict):\n").otherwise(" conflicts):\n"), "about"))
    parts = [
        F.format_string("Checked in as %s at %s.", "agent", F.date_format("at", "yyyy-MM-dd HH:mm:ss")),
        F.when(F.col("previous").isNull(), "(first check-in — your claims renewed and prior work shown below.)"),
        F.coalesce(claims, F.lit("Your claims renewed: none (you have no active claims).")),
        F.lit(""), F.coalesce(F.concat(F.lit("Active across all agents:\n"), "active"), F.lit("Active across all agents: none.")),
        F.lit(""), F.coalesce("delta", F.lit("No prior work by other agents recorded.")),
        F.lit(""), F.coalesce(conflicts, F.lit("Conflicts involving you: none.")),
    ]
    return rows.select("agent", F.concat_ws("\n", *parts).alias("text"))


def involving(records: DataFrame, agent: str) -> DataFrame:
    return records.where(F.exists(F.array_append("holders", F.col("agent")), lambda a: F.lower(a) == agent.lower()))


def intents(requests: DataFrame, scope_files: DataFrame, file_claims: DataFrame) -> DataFrame:
    """(agent, file, source, op): what an agent means to do with a file; scope claims come first, create before modify before delete."""
    rank = F.when(F.col("op") == "create", 1).when(F.col("op") == "modify", 2).otherwise(3)
    known = scope_files.select("agent", "file", F.lit("scope").alias("source"), "op", rank.alias("rank")).union(file_claims.select("agent", "file", F.lit("file").alias("source"), F.lit(None).cast("string").alias("op"), F.lit(4).alias("rank")))
    best = known.groupBy("agent", "file").agg(F.min(F.struct("rank", "source", "op")).alias("b"))
    return requests.join(best, ["agent", "file"], "left").select("agent", "file", F.coalesce("b.source", F.lit("none")).alias("source"), F.col("b.op").alias("op"))


def collisions(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, contesting, n_symbols, split): whether a file that two or more agents contest has symbols enough to split it."""
    agents = found.where("source != 'none'").groupBy("file").agg(F.countDistinct("agent").alias("contesting"))
    n = symbols.groupBy("file").agg(F.count("*").alias("n_symbols"))
    rows = found.select("file").distinct().join(agents, "file", "left").join(n, "file", "left").na.fill(0, ["contesting", "n_symbols"])
    return rows.withColumn("split", (F.col("contesting") >= 2) & (F.col("n_symbols") >= SPLIT_SYMBOLS))


def holders(file_claims: DataFrame, scope_files: DataFrame) -> DataFrame:
    """(file, agent, kind, op): who holds each file, by file claims (op claim) and by scope claims."""
    return file_claims.select("file", "agent", F.lit("file").alias("kind"), F.lit("claim").alias("op")).union(scope_files.select("file", "agent", F.lit("scope").alias("kind"), "op"))


def gate_report(changed: DataFrame, records: DataFrame, held: DataFrame, strict: bool = False) -> DataFrame:
    """(audit_id, blocked, text) of the changed files (audit_id, file): the first open conflict of each file, files without a claim, and who holds the others."""
    open_ = records.where("status = 'open'").select(F.explode("files").alias("file"), F.struct("conflict_id", "agents").alias("c")).groupBy("file").agg(F.min("c").alias("c"))
    lines = F.array_sort(F.collect_list(F.struct("agent", "kind", "op")))
    by_file = held.groupBy("file").agg(lines.alias("h"))
    rows = changed.join(open_, "file", "left").join(by_file, "file", "left")
    line = lambda s: F.array_join(F.transform(s["h"], lambda x: F.concat(F.lit("  "), s["file"], F.lit(" ["), x["op"], F.lit("] — "), x["agent"], F.lit(" ("), x["kind"], F.lit(")"))), "\n")
    f = F.array_sort(F.collect_list(F.struct("file", "c", "h")))
    sets = rows.groupBy("audit_id").agg(f.alias("f"))
    stuck, free, taken = F.filter("f", lambda s: s["c"].isNotNull()), F.filter("f", lambda s: s["h"].isNull()), F.filter("f", lambda s: s["h"].isNotNull())
    rows = sets.select("audit_id", "f", stuck.alias("stuck"), free.alias("free"), taken.alias("taken"))
    blocked = (F.size("stuck") > 0) | (F.lit(strict) & (F.size("free") > 0))
    n = lambda c: F.size(c).cast("string")
    label = "Unclaimed — blocks the gate in --strict mode: " if strict else "Unclaimed — advisory (no active claim): "
    n_held = F.aggregate("taken", F.lit(0), lambda a, s: a + F.size(s["h"])).cast("string")
    parts = [
        F.concat(F.lit("Coordination check — "), n("f"), F.lit(" file(s) in the diff.")),
        F.when(F.size("stuck") > 0, F.concat(F.lit("\nBlocked — "), n("stuck"), F.lit(" file(s) with an open (unresolved) conflict:\n"), F.array_join(F.transform("stuck", lambda s: F.concat(F.lit("  "), s["file"], F.lit(" — conflict "), s["c"]["conflict_id"], F.lit(" between ["), F.array_join(s["c"]["agents"], ", "), F.lit("]"))), "\n"), F.lit("\n  Resolve the conflict (resolve_claim) before merging."))),
        F.when(F.size("free") > 0, F.concat(F.lit("\n" + label), n("free"), F.lit(" file(s):\n"), F.array_join(F.transform("free", lambda s: F.concat(F.lit("  "), s["file"])), "\n"))),
        F.when(F.size("taken") > 0, F.concat(F.lit("\nActively claimed: "), n_held, F.lit(" file(s):\n"), F.array_join(F.transform("taken", line), "\n"))),
        F.concat(F.lit("\n"), F.when(blocked, "RESULT: BLOCKED").otherwise("RESULT: PASS")),
    ]
    return rows.select("audit_id", blocked.alias("blocked"), F.concat_ws("\n", *parts).alias("text"))


def gate(changed: DataFrame, records: DataFrame, claims: DataFrame, strict: bool = False) -> DataFrame:
    """(audit_id, n_files, n_blocked, n_unclaimed, n_claimed, blocked) of (audit_id, file)."""
    open_ = records.where("status = 'open'").select(F.explode("files").alias("file")).distinct().withColumn("conflict", F.lit(1))
    held = claims.select("file").distinct().withColumn("held", F.lit(1))
    rows = changed.join(open_, "file", "left").join(held, "file", "left")
    out = rows.groupBy("audit_id").agg(F.count("*").alias("n_files"), F.count("conflict").alias("n_blocked"), F.count(F.when(F.col("held").isNull(), 1)).alias("n_unclaimed"), F.count("held").alias("n_claimed"))
    return out.withColumn("blocked", (F.col("n_blocked") > 0) | (F.lit(strict) & (F.col("n_unclaimed") > 0)))
