"""Forecasts that wait for their outcomes, as a stream: timers of event time close each of them once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

HOUR = 3_600_000
#: Hours after expiry from which a forecast with an outcome is evaluated, and at which one without is given up.
MATURE, LOST = 4, 8


def _closed(key, status: str, net: float | None) -> Row:
    return Row(fingerprint_id=key[0], status=status, net_return_pips=net)


class Waiting(StatefulProcessor):
    """Forecasts (id, expiry) and outcomes (id, net) to one row each: evaluated with its outcome, or outcome_unavailable."""

    def init(self, handle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "expiry long")
        self.net = handle.getValueState("net", "net double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            if r["_expiry"] is not None:
                self.expiry.update((r["_expiry"],))
                for hours in (MATURE, LOST):
                    self.handle.registerTimer(r["_expiry"] + hours * HOUR)
            else:
                self.net.update((r["_net"],))
                self.handle.registerTimer(r["_at"] + (MATURE + LOST) * HOUR)  # so that an outcome nobody asked for does not stay
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        if self.expiry.exists():
            expiry = self.expiry.get()[0]
            if self.net.exists() and at >= expiry + MATURE * HOUR:
                out.append(_closed(key, "evaluated", self.net.get()[0]))
            elif at >= expiry + LOST * HOUR:
                out.append(_closed(key, "outcome_unavailable", None))
            if not out:
                return iter([])
        self.expiry.clear()
        self.net.clear()
        return iter(out)

    def close(self) -> None:
        pass


def matured(forecasts: DataFrame, outcomes: DataFrame, late: str = "1 hour") -> DataFrame:
    """fingerprint_id, status, net_return_pips of forecasts (fingerprint_id, ts, expiry) and outcomes (fingerprint_id, ts, net_return_pips), streams whose times are timestamps.

    A forecast has one row, at the first watermark 4 hours past its expiry if its outcome is there, at 8 hours whether or not.
    """
    f = forecasts.select("fingerprint_id", F.col("ts").alias("_ts"), F.unix_millis("expiry").alias("_expiry"), F.lit(None).cast("double").alias("_net"))
    o = outcomes.select("fingerprint_id", F.col("ts").alias("_ts"), F.lit(None).cast("long").alias("_expiry"), F.col("net_return_pips").alias("_net"))
    both = f.unionByName(o).withWatermark("_ts", late).withColumn("_at", F.unix_millis("_ts"))
    return both.groupBy("fingerprint_id").transformWithState(Waiting(), "fingerprint_id string, status string, net_return_pips double", "Append", "EventTime")
