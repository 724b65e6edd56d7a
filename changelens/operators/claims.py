"""Claims on files and scopes, and conflicts between agents.

State changes are folds over events in order of time, because a refused claim
must not block later ones.  Events are dealt by their key and sorted within
partitions, so a fold reads its rows as a stream and holds the state of one key
at a time; nothing is collected.  File claims have the key (root, file); scope
claims are all or nothing over several files, so theirs is the root.
"""

from __future__ import annotations

import datetime as dt
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X

HOURS = 2
TOUCH_HOURS = 1


def expiry(duration: Column, as_of: Column) -> Column:
    """A count of minutes, hours or days from as_of, else a time as given, else HOURS from as_of."""
    unit = F.regexp_extract(duration, X.DURATION, 2)
    n = F.nullif(F.regexp_extract(duration, X.DURATION, 1), F.lit("")).cast("int")
    span = F.make_dt_interval(F.when(unit == "d", n).otherwise(0), F.when(unit == "h", n).otherwise(0), F.when(unit == "m", n).otherwise(0))
    return F.coalesce(F.when(unit != "", as_of + span), F.when(duration.rlike(X.ISO_TIME), F.try_to_timestamp(duration)), as_of + F.make_dt_interval(F.lit(0), F.lit(HOURS)))


def is_expired(expires: Column, as_of: Column) -> Column:
    """Strictly before as_of; a time that can't be read is expired."""
    return F.coalesce(F.try_to_timestamp(expires) < as_of, F.lit(True))


def is_after(moment: Column, as_of: Column, seconds: int) -> Column:
    """Within the last seconds before as_of, strictly; a time that can't be read is not."""
    return F.coalesce(F.try_to_timestamp(moment) > as_of - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))


def step(state: tuple | None, op: str, agent: str, at, hours: float = HOURS) -> tuple[tuple | None, str, str | None]:
    """One event on one file: the new (holder, expires), the outcome, and who held it against a claim."""
    if state and state[1] < at:
        state = None
    until = at + dt.timedelta(hours=hours)
    if op == "claim":
        if state and state[0] != agent:
            return state, "conflict", state[0]
        return (agent, until), "claimed", None
    mine = state is not None and state[0] == agent
    if op == "release":
        return (None, "released", None) if mine else (state, "none", None)
    if op == "extend":
        return ((agent, until), "extended", None) if mine else (state, "not_found", None)
    return state, "ignored", None


def fold_file_claims(events: DataFrame, hours: float = HOURS) -> DataFrame:
    """(op_id, root, file, agent, op, outcome, held_by) of (op_id, root, file, agent, op, at); ties in time by op_id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            outcome, held = [], []
            for row in frame.itertuples(index=False):
                if (row.root, row.file) != key:
                    key, state = (row.root, row.file), None
                state, result, by = step(state, row.op, row.agent, row.at.to_pydatetime(), hours)
                outcome.append(result)
                held.append(by)
            yield frame[["op_id", "root", "file", "agent", "op"]].assign(outcome=outcome, held_by=held)

    rows = events.select("op_id", "root", "file", "agent", "op", "at").repartition("root", "file").sortWithinPartitions("root", "file", "at", "op_id")
    return rows.mapInPandas(run, "op_id long, root string, file string, agent string, op string, outcome string, held_by string")


def active(folded: DataFrame, events: DataFrame, as_of, hours: float = HOURS) -> DataFrame:
    """(root, file, agent, expires_at): claims that hold at as_of."""
    good = folded.where("outcome in ('claimed', 'extended', 'released')").join(events.select("op_id", "at"), "op_id")
    last = good.groupBy("root", "file").agg(F.max_by(F.struct("agent", "outcome", "at"), F.struct("at", "op_id")).alias("x"))
    until = F.col("x.at") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return last.where("x.outcome != 'released'").select("root", "file", F.col("x.agent").alias("agent"), until.alias("expires_at")).where(F.col("expires_at") >= F.lit(as_of))


def by_agent(claims: DataFrame, as_of) -> DataFrame:
    """(agent, n_files, minutes_left, files): active claims of each agent, the least time left, and the files as text."""
    left = F.round((F.unix_timestamp("expires_at") - F.unix_timestamp(F.lit(as_of))) / 60).cast("long")
    return claims.groupBy("agent").agg(F.count("*").alias("n_files"), F.min(left).alias("minutes_left"), F.array_join(F.array_sort(F.collect_list("file")), ", ").alias("files"))


def outcomes(folded: DataFrame, *names: str) -> DataFrame:
    """(agent, one count for each name): how many events of each agent had these outcomes."""
    return folded.where(F.col("outcome").isin(*names)).groupBy("agent").agg(*[F.count(F.when(F.col("outcome") == n, 1)).alias(n) for n in names])


def conflicts(requests: DataFrame, claims: DataFrame, touches: DataFrame, hours: float = TOUCH_HOURS, claim_hours: float | None = None) -> DataFrame:
    """(request_id, file, agent, why) of (request_id, file, agent, at): what others hold, and what others touched within the last hours.

    claims (file, agent, expires_at) are those of one moment; with claim_hours,
    claims of many moments that run for so long, of which those at the request count.
    """
    held = requests.alias("r")
    if claim_hours is None:
        held = held.join(claims.alias("c"), "file").where("r.agent != c.agent and c.expires_at >= r.at")
    else:
        span = int(claim_hours * 3600)
        slot = lambda c: F.floor(F.unix_timestamp(c) / span)
        asked, ends = requests.withColumn("slot", F.explode(F.array(slot("at"), slot("at") + 1))), claims.withColumn("slot", slot("expires_at"))
        length = F.make_dt_interval(secs=F.lit(span))
        held = asked.alias("r").join(ends.alias("c"), ["file", "slot"]).where((F.col("r.agent") != F.col("c.agent")) & (F.col("c.expires_at") >= F.col("r.at")) & (F.col("c.expires_at") < F.col("r.at") + length))
    held = held.select("request_id", "file", F.col("c.agent").alias("agent"), F.lit("claimed").alias("why"))
    # buckets of the look-back's length: what is near lies in the request's bucket or the one before
    size = int(hours * 3600)
    bucket = F.floor(F.unix_timestamp("at") / size)
    asked = requests.withColumn("bucket", F.explode(F.array(bucket, bucket - 1)))
    near = asked.alias("r").join(touches.withColumn("bucket", bucket).alias("t"), ["file", "bucket"]).where((F.col("r.agent") != F.col("t.agent")) & (F.col("t.at") > F.col("r.at") - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col("t.at") <= F.col("r.at")))
    return held.union(near.select("request_id", "file", F.col("t.agent").alias("agent"), F.lit("touched").alias("why"))).distinct()


# --- scopes -----------------------------------------------------------------


def validate(scopes: DataFrame, text: str = "scope") -> DataFrame:
    """scopes with errors: what a scope in JSON breaks of its shape; an empty array where nothing."""
    raw = F.col(text)
    v = F.try_parse_json(raw)

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    def strings(path: str, name: str) -> Column:
        k = kind(path)
        return F.when(k.isNull(), F.lit(None)).when(~F.startswith(k, F.lit("ARRAY")), F.lit(f"scope.{name} must be an array")).when(~k.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(f"scope.{name} must contain only strings"))

    files = kind("$.files")
    found = [F.when(files.isNotNull() & ~F.startswith(files, F.lit("OBJECT")), F.lit("scope.files must be an object"))]
    found += [strings(f"$.files.{k}", f"files.{k}") for k in ("create", "modify", "delete")]
    found += [strings(f"$.{k}", k) for k in ("dependencies", "env_vars", "api_routes")]
    whole = F.when(v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.array(F.lit("scope must be an object")))
    return scopes.withColumn("errors", F.coalesce(whole, F.array_compact(F.array(*found))))


def fold_scope_claims(events: DataFrame, hours: float = HOURS) -> DataFrame:
    """(op_id, root, agent, status, conflicts, reason) of (op_id, root, agent, op, files, deps, parent, at).

    claim: locked, or rejected as a whole where another agent (but not the
    parent's) holds one of the files, or where it goes beyond its parent;
    complete: ends the agent's claims, which then hold no files; renew: sets
    the agent's claims anew, expired ones as well.  A task holds the live claims
    of one root, and looks at those on the files asked for.  conflicts: file:holder,
    comma-joined, the first holder of each file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # of one root: its live claims, their ends as a heap, and the claims on each file and of each agent in order
        root, claims, ends, on, of = None, {}, [], {}, {}

        def drop(key: int) -> None:
            c = claims.pop(key)
            of[c["agent"]].pop(key)
            for f in c["files"]:
                on[f].pop(key, None)

        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.root != root:
                    root, claims, ends, on, of = row.root, {}, [], {}, {}
                now, until = row.at.to_pydatetime(), row.at.to_pydatetime() + dt.timedelta(hours=hours)
                own = list(of.get(row.agent, ()))
                if row.op == "renew":
                    for k in own:
                        claims[k]["until"] = until
                        heapq.heappush(ends, (until, k))
                    out.append(("renewed" if own else "none", "", ""))
                    continue
                while ends and ends[0][0] < now:
                    end, k = heapq.heappop(ends)
                    if k in claims and claims[k]["until"] == end:
                        drop(k)
                if row.op == "complete":
                    own = list(of.get(row.agent, ()))
                    for k in own:
                        drop(k)
                    out.append(("completed" if own else "none", "", ""))
                    continue
                parent = claims.get(row.parent)
                spared = {row.agent, parent["agent"]} if parent else {row.agent}
                files = list(row.files)
                holders = [(f, next((claims[k]["agent"] for k in on.get(f, ()) if claims[k]["agent"] not in spared), None)) for f in files]
                taken = [f"{f}:{h}" for f, h in holders if h is not None]
                beyond = [f for f in files if f not in parent["files"]] if parent else []
                deps = [d for d in row.deps if d not in parent["deps"]] if parent else []
                if taken:
                    out.append(("rejected", ",".join(taken), "conflict"))
                elif beyond or deps:
                    out.append(("rejected", "", "files beyond parent" if beyond else "deps beyond parent"))
                else:
                    claims[row.op_id] = {"agent": row.agent, "files": files, "deps": set(row.deps), "until": until}
                    heapq.heappush(ends, (until, row.op_id))
                    of.setdefault(row.agent, {})[row.op_id] = None
                    for f in files:
                        on.setdefault(f, {})[row.op_id] = None
                    out.append(("locked", "", ""))
            status, taken, reason = zip(*out, strict=True) if out else ((), (), ())
            yield frame[["op_id", "root", "agent"]].assign(status=status, conflicts=taken, reason=reason)

    rows = events.select("op_id", "root", "agent", "op", "files", "deps", "parent", "at").repartition("root").sortWithinPartitions("root", "at", "op_id")
    return rows.mapInPandas(run, "op_id long, root string, agent string, status string, conflicts string, reason string")


def claimed_files(claims: DataFrame) -> DataFrame:
    """(claim_id, agent, file, op) of active claims with arrays create, modify and delete."""
    ops = F.concat(*[_with_op(k) for k in ("create", "modify", "delete")])
    return claims.where("status in ('locked', 'proposed')").select("claim_id", "agent", F.explode(ops).alias("x")).select("claim_id", "agent", "x.file", "x.op")


def _with_op(kind: str) -> Column:
    return F.transform(F.coalesce(kind, F.array().cast("array<string>")), lambda f: F.struct(f.alias("file"), F.lit(kind).alias("op")))


def purged(claims: DataFrame, as_of) -> DataFrame:
    """Completed claims stay for ever, others until they expire."""
    return claims.where((F.col("status") == "completed") | (F.col("expires_at") >= F.lit(as_of)))


def conflict_records(folded: DataFrame) -> DataFrame:
    """(conflict_id, op_id, agent, files, holders, agents, status) for every rejected claim with conflicts; the id is a digest of its content."""
    rows = folded.where("conflicts != ''")
    pairs = F.split("conflicts", ",")
    name = F.substring(F.sha2(F.concat_ws("|", "root", F.col("op_id").cast("string"), "conflicts"), 256), 1, 32)
    return rows.select(name.alias("conflict_id"), "op_id", "agent", F.transform(pairs, lambda p: F.split_part(p, F.lit(":"), F.lit(1))).alias("files"), F.array_distinct(F.transform(pairs, lambda p: F.split_part(p, F.lit(":"), F.lit(2)))).alias("holders"), F.array_union(F.array("agent"), F.transform(pairs, lambda p: F.split_part(p, F.lit(":"), F.lit(2)))).alias("agents"), F.lit("open").alias("status"))


def resolve(requests: DataFrame, records: DataFrame) -> DataFrame:
    """(request_id, conflict_id, outcome, detail): requests (request_id, conflict_id, strategy, resolved_by, at) in order; the first resolves an open conflict.

    records: (conflict_id, files, agents, status, strategy, resolved_by), the last two of resolved ones.
    """
    own = records.select("conflict_id", "files", "agents", "status", F.col("strategy").alias("by_strategy"), F.col("resolved_by").alias("by"), F.lit(True).alias("known"))
    rows = requests.join(own, "conflict_id", "left")
    order = Window.partitionBy("conflict_id").orderBy("at", "request_id")
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("first_strategy", F.first("strategy").over(order)).withColumn("first_by", F.first("resolved_by").over(order))
    before = F.col("status") == "resolved"
    outcome = F.when(F.col("known").isNull(), "not_found").when(before | (F.col("k") > 1), "already_resolved").otherwise("resolved")
    files, agents = F.array_join("files", ", "), F.array_join("agents", ", ")
    detail = (
        F.when(outcome == "not_found", F.concat(F.lit("No conflict with ID "), "conflict_id"))
        .when(outcome == "already_resolved", F.concat(F.lit("Conflict already resolved via "), F.when(before, F.col("by_strategy")).otherwise(F.col("first_strategy")), F.lit(" by "), F.when(before, F.col("by")).otherwise(F.col("first_by"))))
        .when(F.col("strategy") == "escalate", F.format_string(X.ESCALATE_DETAIL, files, agents))
        .otherwise(F.format_string(X.BLOCK_DETAIL, files, agents))
    )
    return rows.select("request_id", "conflict_id", outcome.alias("outcome"), detail.alias("detail"))


def open_conflicts(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Records that are open and that no request (conflict_id, outcome) resolved."""
    return records.where("status = 'open'").join(resolved.where("outcome = 'resolved'").select("conflict_id"), "conflict_id", "left_anti")


def active_scopes(claims: DataFrame, as_of) -> DataFrame:
    """Scope claims that are locked or proposed and have not expired."""
    return purged(claims, as_of).where("status in ('locked', 'proposed')")


def completed(claims: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """The ledger rows of claims that are completed now (claim_id of ids): no findings, LOW, all declared files."""
    none = F.array().cast("array<string>")
    files = F.concat(*[F.coalesce(k, none) for k in ("create", "modify", "delete")])
    return claims.join(ids.select("claim_id").distinct(), "claim_id", "left_semi").select("claim_id", "agent", "task", files.alias("files_touched"), F.lit(0).cast("long").alias("findings_count"), F.lit("LOW").alias("score"), F.lit(as_of).cast("timestamp").alias("at"))
