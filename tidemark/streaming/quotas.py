"""Requests to providers under quotas, as a stream: each service's counters are state, and requests are judged in the order of their times.

Requests wait until the watermark has passed their minute, so that late ones within the
watermark still take their place. The state of a service is what waits (as long as the
watermark looks back), today's counts, and the times of the last minute's requests.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.operations import Quotas

MINUTE = 60_000



class Judge(StatefulProcessor):
    """Rows (key, ts, tie, works) to rows (key, tie, provider, attempts)."""

    def __init__(self, chain: list[tuple[str, int, int]], names: list[str], kind: str):
        self.chain, self.names, self.kind = chain, names, kind

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", f"at long, tie {self.kind}", "works array<string>")
        self.counts = handle.getValueState("counts", "day long, used array<int>")
        self.recent = handle.getListState("recent", "provider int, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        minutes = set()
        for r in rows:
            at = int(r["_at"])
            self.waiting.updateValue((at, r["_tie"]), (list(r["_works"] or []),))
            minutes.add(at // (MINUTE * 1000))
        for m in minutes:
            self.handle.registerTimer((m + 1) * MINUTE)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator() if k[0] < end)
        day, used = self.counts.get() if self.counts.exists() else (None, [])
        quotas = Quotas(self.chain, day, used, [tuple(x) for x in self.recent.get()] if self.recent.exists() else [])
        out = []
        for at, tie, works in due:
            won, tried = quotas.ask(at, works)
            out.append(Row(**dict(zip(self.names, (key[0], tie, won, "; ".join(tried)), strict=True))))
            self.waiting.removeKey((at, tie))
        if due:
            self.counts.update((quotas.day, quotas.used))
            kept = quotas.kept()
            self.recent.put(kept) if kept else self.recent.clear()
        return iter(out)

    def close(self) -> None:
        pass


def with_fallback(requests: DataFrame, chain: list[tuple[str, int, int]], key: str, ts: str, tie: str, works: str, late: str = "1 hour") -> DataFrame:
    """``operators.operations.with_fallback`` over a stream whose column ``ts`` is a timestamp; ties are unique within a key and a time."""
    kinds = dict(requests.dtypes)
    rows = requests.withWatermark(ts, late).select(F.col(key).alias("_key"), ts, F.unix_micros(ts).alias("_at"), F.col(tie).alias("_tie"), F.col(works).alias("_works"))
    judge = Judge(chain, [key, tie, "provider", "attempts"], kinds[tie])
    return rows.groupBy("_key").transformWithState(judge, f"{key} {kinds[key]}, {tie} {kinds[tie]}, provider string, attempts string", "Append", "EventTime")
