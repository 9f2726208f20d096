"""Incidents: which events are sent on, as a batch and as a stream, by one state machine.

For each key (server, site, scope, channel) the state is the open problem's fingerprint and when it was
last sent.  A problem is sent if its fingerprint is new or 24 hours have gone by; a healthy event sends
one recovery if a problem is open and closes it; skipped events are dropped; webhooks get everything and
have no state.  State advances only where sending worked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.text import fingerprint, incident_key

REMIND = pd.Timedelta(hours=24)
HEALTHY = ("backup_succeeded", "no_change")
SKIPPED = "backup_skipped"
RESULT = "key string, ts timestamp, channel string, event string, recovery boolean, sent boolean"


def step(state: tuple[str, object], event: dict) -> tuple[tuple[str, object], dict | None]:
    """The state after an event, and the attempt to send it, if any."""
    mark, last = state
    out = {"key": event["key"], "ts": event["ts"], "channel": event["channel"], "event": event["event"], "recovery": False, "sent": bool(event["works"])}
    if event["channel_type"] == "webhook":
        return state, out
    if event["event"] == SKIPPED:
        return state, None
    if event["event"] in HEALTHY:
        if not mark:
            return state, None
        return (("", None) if event["works"] else state), out | {"recovery": True}
    if mark == event["fingerprint"] and last is not None and event["ts"] - last < REMIND:
        return state, None
    return ((event["fingerprint"], event["ts"]) if event["works"] else state), out


def keyed(events: DataFrame) -> DataFrame:
    """events(ts, seq, server_id, site, scope, channel, channel_type, event, error_category, error_message[, works])."""
    out = events if "works" in events.columns else events.withColumn("works", F.lit(True))
    return out.select(
        incident_key(F.col("server_id"), F.col("site"), F.col("scope"), F.col("channel")).alias("key"), "ts", "seq", "channel", "channel_type", "event",
        fingerprint(F.col("event"), F.col("error_category"), F.col("error_message")).alias("fingerprint"), "works",
    )


def deliveries(events: DataFrame) -> DataFrame:
    """Attempts of all events, each key in the order of time; keys stream through, so none has to fit in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, ("", None)
        for pdf in batches:
            out = []
            for event in pdf.to_dict("records"):
                if event["key"] != key:
                    key, state = event["key"], ("", None)
                state, attempt = step(state, event)
                if attempt:
                    out.append(attempt)
            yield pd.DataFrame(out, columns=["key", "ts", "channel", "event", "recovery", "sent"])

    own = keyed(events).repartition("key").sortWithinPartitions("key", "ts", "seq")
    return own.mapInPandas(run, RESULT)


class Incident(StatefulProcessor):
    """The state machine over a stream; what arrives in a batch is taken in the order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "mark string, last timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        state = (known[0], pd.Timestamp(known[1]) if known[1] is not None else None) if known else ("", None)
        out = []
        for event in pd.concat(list(rows)).sort_values(["ts", "seq"]).to_dict("records"):
            state, attempt = step(state, event)
            if attempt:
                out.append(attempt)
        self.state.update((state[0], state[1].to_pydatetime() if state[1] is not None else None))
        yield pd.DataFrame(out, columns=["key", "ts", "channel", "event", "recovery", "sent"])

    def close(self) -> None:
        pass


def stream_deliveries(events: DataFrame) -> DataFrame:
    """The same for a stream.  Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    return keyed(events).groupBy("key").transformWithStateInPandas(Incident(), outputStructType=RESULT, outputMode="Append", timeMode="None")


def recovery_routes(routed: DataFrame, channels: DataFrame) -> DataFrame:
    """routed(event, channel): healthy events also go to channels of problem events, except webhooks."""
    problem = routed.where(~F.col("event").isin(*HEALTHY, SKIPPED)).join(F.broadcast(channels.where("type <> 'webhook'").select(F.col("name").alias("channel"))), "channel", "left_semi").select("channel").distinct()
    healthy = problem.select(F.explode(F.array(*map(F.lit, HEALTHY))).alias("event"), "channel")
    return routed.select("event", "channel").unionByName(healthy).distinct()


def daily_counts(runs: DataFrame, watermark: str = "24 hours") -> DataFrame:
    """Runs by UTC day and status over a stream, late rows up to the watermark included."""
    return runs.withWatermark("started_at", watermark).groupBy(F.window("started_at", "1 day").alias("w"), "status").agg(F.count("*").alias("runs")).select(F.col("w.start").alias("day"), "status", "runs")


def once_per_period(reports: DataFrame) -> DataFrame:
    """Each (report_type, period) of a stream once, however late it comes again: periods are never forgotten.

    The state holds a key for each type and period, so it grows with days, not with runs.
    """
    return reports.dropDuplicates(["report_type", "period"])
