"""Contracts: ids, delegation chains, narrowing, expiry, and handoff decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from .. import tables

VERSION = "1.0"
CONCRETE = ["files", "endpoints", "deps", "env"]


def contract_id(prompt: Column, diff: Column, parent: Column) -> Column:
    return F.substring(F.sha2(F.concat(prompt, diff, F.coalesce(parent, F.lit("")), F.lit(VERSION)), 256), 1, 32)


def prompt_hash(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt, 256), 1, 16)


def chains(contracts: DataFrame) -> DataFrame:
    """(id, depth, chain) of (id, parent_id): the ids from the root to the parent, by pointer jumping.

    Each step doubles the ancestors known, until no chain has more, so chains of
    n links take log2(n) joins; chains that are whole take part as ancestors
    only.  A missing parent ends a chain; contracts in a ring are an error.
    """
    none = F.array().cast("array<bigint>")
    now = tables.written(contracts.select("id", F.col("parent_id").alias("top"), F.when(F.col("parent_id").isNotNull(), F.array("parent_id")).otherwise(none).alias("chain")), "chains")
    done, left, known, most = now.where("top is null"), now.where("top is not null"), 1, now.count()
    while not left.isEmpty():
        if known > most:
            raise ValueError("contracts are their own ancestors")
        up = done.union(left).select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("chain").alias("above"))
        now = tables.written(left.join(up, "top", "left").select("id", F.col("next").alias("top"), F.concat(F.coalesce("above", none), "chain").alias("chain")), "chains")
        done, left, known = done.union(now.where("top is null")), now.where("top is not null"), 2 * known
    return done.select("id", F.size("chain").alias("depth"), "chain")


def expansions(child: DataFrame, parent: DataFrame) -> DataFrame:
    """(id, field, item): what a contract authorises beyond its parent, by normal form, over the concrete fields.

    child: (id, parent_id, field, item); parent: (id, field, item).  advisory is
    true where the parent has none of the fields; such items are no expansion.
    """
    has = parent.where(F.col("field").isin(CONCRETE)).select(F.col("id").alias("parent_id"), "field", T.norm(F.col("item")).alias("n")).distinct()
    concrete = has.select("parent_id").distinct().withColumn("concrete", F.lit(True))
    rows = child.where(F.col("field").isin(CONCRETE) & F.col("parent_id").isNotNull()).withColumn("n", T.norm(F.col("item")))
    beyond = rows.join(has, ["parent_id", "field", "n"], "left_anti")
    return beyond.join(concrete, "parent_id", "left").select("id", "parent_id", "field", "item", F.col("concrete").isNull().alias("advisory"))


def narrowing(child: DataFrame, parent: DataFrame) -> DataFrame:
    """(id, parent_id, expansions, narrow, advisory) for every child with a parent."""
    found = expansions(child, parent).groupBy("id").agg(F.count("*").alias("n"), F.max("advisory").alias("a"))
    rows = child.where("parent_id is not null").select("id", "parent_id").distinct()
    concrete = parent.where(F.col("field").isin(CONCRETE)).select(F.col("id").alias("parent_id")).distinct().withColumn("c", F.lit(True))
    n = F.coalesce("n", F.lit(0))
    return rows.join(found, "id", "left").join(concrete, "parent_id", "left").select("id", "parent_id", n.alias("expansions"), (n == 0).alias("narrow"), F.col("c").isNull().alias("advisory"))


def whole(contracts: DataFrame) -> DataFrame:
    """Contracts (id, parent_id, goal, constraints, decisions, agent, prompt_hash, scope_summary, findings_count, score, issued_at) with what they inherit.

    (id, goal, constraints, decisions, links): the context is a contract's own
    or that of its nearest ancestor that has one; links run from the root to the
    parent, eight fields each, with the score of the contract that follows it.
    """
    own = ["goal", "constraints", "decisions"]
    steps = chains(contracts.select("id", "parent_id")).select("id", F.posexplode(F.concat("chain", F.array("id"))).alias("pos", "at"))
    known = contracts.select(F.col("id").alias("at"), *own, "agent", "prompt_hash", "scope_summary", "findings_count", "score", "issued_at")
    rows = steps.join(known, "at", "left")
    follows = Window.partitionBy("id").orderBy("pos")
    rows = rows.withColumn("next_score", F.lead("score").over(follows)).withColumn("last", F.lead("at").over(follows).isNull())
    link = F.struct(F.col("pos"), F.col("at").alias("contract_id"), F.coalesce("agent", F.lit("unknown")).alias("agent"), F.concat(F.lit("[prompt_hash:"), F.col("prompt_hash"), F.lit("]")).alias("task"), "scope_summary", F.array().cast("array<string>").alias("files_touched"), "findings_count", F.col("next_score").alias("score"), F.col("issued_at").alias("at"))
    inherited = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in own]
    return rows.groupBy("id").agg(*inherited, F.array_sort(F.collect_list(F.when(~F.col("last"), link))).alias("links"))


def with_skips(scored: DataFrame) -> DataFrame:
    """Scored audits (…, n_findings, score, extraction_failed, key_configured): where a configured extraction failed, the audit is skipped, without findings and LOW."""
    skipped = F.coalesce(F.col("extraction_failed") & F.col("key_configured"), F.lit(False))
    return scored.withColumn("skipped", skipped).withColumn("n_findings", F.when(F.col("skipped"), 0).otherwise(F.col("n_findings"))).withColumn("score", F.when(F.col("skipped"), "LOW").otherwise(F.col("score")))


def expired(contracts: DataFrame, as_of) -> DataFrame:
    """Contracts (id, parent_id, parent_expires_at) whose parent ran out before as_of: a high finding each, which raises the score to HIGH."""
    at = F.lit(as_of)
    minutes = F.round((F.unix_timestamp(at) - F.unix_timestamp("parent_expires_at")) / 60).cast("long")
    detail = F.format_string(X.EXPIRED_DETAIL, F.substring(F.col("parent_id").cast("string"), 1, 8), F.date_format("parent_expires_at", "yyyy-MM-dd HH:mm:ss"))
    return contracts.where(F.col("parent_expires_at") < at).select("id", F.lit("contract.expired").alias("kind"), F.lit("high").alias("severity"), detail.alias("detail"), F.concat(F.lit("expired "), minutes.cast("string"), F.lit("min ago")).alias("evidence"), F.lit("HIGH").alias("score"))


def expansion_findings(found: DataFrame) -> DataFrame:
    """A high finding for every expansion that is not advisory."""
    detail = F.format_string(X.EXPANSION_DETAIL, "item", "field")
    return found.where("not advisory").select("id", F.lit("contract.expansion").alias("kind"), F.lit("high").alias("severity"), detail.alias("detail"), F.concat("field", F.lit("+="), "item").alias("evidence"), F.lit("HIGH").alias("score"))


def handoff(scores: DataFrame) -> DataFrame:
    """decision of scored audits: deny on HIGH, flag where an advisory check failed, else allow."""
    return scores.withColumn("decision", F.when(F.col("score") == "HIGH", "deny").when(~F.coalesce("advisory_ok", F.lit(True)), "flag").otherwise("allow"))


def scope_source(audits: DataFrame, claims: DataFrame) -> DataFrame:
    """Which scope counts: a claim that exists, else an override, else extraction; with mode, confidence and a warning for claims that aren't locked."""
    rows = audits.join(claims.select("claim_id", F.col("status").alias("claim_status")), "claim_id", "left")
    source = F.when(F.col("claim_status").isNotNull(), "claim").when(F.col("has_override"), "override").otherwise("extraction")
    return rows.select("audit_id", source.alias("source"), F.when(source == "claim", "dsl").otherwise("inferred").alias("mode"), F.when(source == "claim", F.lit(1.0)).otherwise(F.lit(0.85)).alias("confidence"), F.coalesce((source == "claim") & (F.col("claim_status") != "locked"), F.lit(False)).alias("claim_warning"))


def summarize_scope(scopes: DataFrame) -> DataFrame:
    """A line with the sizes of the fields that are not empty."""
    parts = [F.when(F.size(f) > 0, F.concat(F.size(f).cast("string"), F.lit(f" {f}"))) for f in ("files", "features", "endpoints", "deps", "env", "behavioral")]
    return scopes.select("audit_id", F.concat_ws(", ", *parts).alias("summary"))
