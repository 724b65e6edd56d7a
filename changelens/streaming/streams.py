"""The same operators on streams: claims with timers, ledgers without repeats, daily counts, check-in sessions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.claims import HOURS, step

OUTCOMES = "op_id long, root string, file string, agent string, op string, outcome string, held_by string"


def file_claims(events: DataFrame, hours: float = HOURS, late: str = "10 minutes") -> DataFrame:
    """operators.claims.fold_file_claims on a stream: state is the holder of each (root, file), dropped when its claim runs out."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = (state.get[0], dt.datetime.fromtimestamp(state.get[1] / 1e6, dt.UTC).replace(tzinfo=None)) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "op_id"])
        outcome, by = [], []
        for row in rows.itertuples(index=False):
            held, result, holder = step(held, row.op, row.agent, row.at.to_pydatetime(), hours)
            outcome.append(result)
            by.append(holder)
        if held:
            state.update((held[0], round(held[1].replace(tzinfo=dt.UTC).timestamp() * 1e6)))
            state.setTimeoutTimestamp(max(int(held[1].replace(tzinfo=dt.UTC).timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield rows[["op_id", "root", "file", "agent", "op"]].assign(outcome=outcome, held_by=by)

    return events.withWatermark("at", late).groupBy("root", "file").applyInPandasWithState(update, OUTCOMES, "agent string, until long", "append", GroupStateTimeout.EventTimeTimeout)


def ledger(entries: DataFrame, late: str = "1 day") -> DataFrame:
    """Entries of a contract id once within the watermark; those without one all pass."""
    keyed = entries.withColumn("key", F.coalesce("contract_id", F.concat(F.lit("#"), F.col("entry_id").cast("string"))))
    return keyed.withWatermark("at", late).dropDuplicatesWithinWatermark(["key"]).drop("key")


def daily_counts(inits: DataFrame, late: str = "1 day") -> DataFrame:
    days = inits.withWatermark("received_at", late).groupBy(F.window("received_at", "1 day")).agg(F.count("*").alias("count"))
    return days.select(F.to_date("window.start").alias("day"), "count")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Runs of check-ins of an agent without a gap."""
    found = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "agent").agg(F.count("*").alias("n"))
    return found.select("agent", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
