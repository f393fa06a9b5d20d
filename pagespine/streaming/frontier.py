"""A crawl frontier as a stream: each URL once, the best of each host first, one at a time within a delay, resumable.

State is kept by host: the URLs popped, and those pending with their scores and times. All is event time: a pop that is due at T
happens when the watermark has passed T, and takes the best of what was found up to T, whatever else has arrived; the next is due ``delay``
later, or that long after the next URL is found. So what is popped and when follows from the rows alone, not from how they fall into
batches: a stream that was stopped goes on from its checkpoint as if it had not been. A URL found again with a better score counts with
that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import urls

POPPED = "host string, url string, score double, depth int, place long, at timestamp"
#: Without it, state needs a provider that keeps several kinds of it.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Frontier(StatefulProcessor):
    def __init__(self, delay_ms: int, each: int, per_host: int):
        self.delay_ms, self.each, self.per_host = delay_ms, each, per_host

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "url string", "popped boolean")
        self.pending = handle.getMapState("pending", "url string, at long, ord long", "score double, depth int")
        self.counts = handle.getValueState("counts", "known long, popped long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known, popped = self.counts.get() or (0, 0)
        frame = pd.concat(list(rows)).sort_values(["at", "ord", "url"], kind="stable")
        for url, at, ord_, score, depth in zip(frame["url"], frame["at"], frame["ord"], frame["score"], frame["depth"]):
            if not self.known.containsKey((url,)):
                if known >= self.per_host:
                    continue
                known += 1
                self.known.updateValue((url,), (False,))
            elif self.known.getValue((url,))[0]:
                continue
            self.pending.updateValue((url, int(at), int(ord_)), (float(score), int(depth)))
        self.counts.update((known, popped))
        if not any(True for _ in self.handle.listTimers()):
            first = min((at for _, at, _ in self.pending.keys()), default=None)
            if first is not None:
                self.handle.registerTimer(first + self.delay_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, popped = self.counts.get() or (0, 0)
        # a host's pending URLs are bounded by ``per_host`` and the times each is found
        left = sorted((-score, -at, -ord_, url, depth) for (url, at, ord_), (score, depth) in self.pending.iterator())
        due, out = expiredTimerInfo.getExpiryTimeInMs(), []
        while left:
            if due > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(due)
                break
            taken: dict[str, tuple] = {}
            for score, at, _, url, depth in left:
                if -at <= due and len(taken) < self.each:
                    taken.setdefault(url, (-score, depth))
            for url, (score, depth) in taken.items():
                popped += 1
                self.known.updateValue((url,), (True,))
                out.append((key[0], url, score, depth, popped, pd.Timestamp(due, unit="ms")))
            for entry in left:
                if entry[3] in taken:
                    self.pending.removeKey((entry[3], -entry[1], -entry[2]))
            left = [entry for entry in left if entry[3] not in taken]
            due = max(due, min((-entry[1] for entry in left), default=due)) + self.delay_ms
        self.counts.update((known, popped))
        if out:
            yield pd.DataFrame(out, columns=["host", "url", "score", "depth", "place", "at"])


def frontier(found: DataFrame, delay_seconds: int = 1, each: int = 1, per_host: int = 100_000, late: str = "0 seconds") -> DataFrame:
    """The stream of popped URLs from a stream of found ones (url, score, depth, ord, ts); rows that are no URL are left out."""
    canonical = found.withWatermark("ts", late).withColumn("url", urls.canonical(F.col("url"))).filter("url IS NOT NULL")
    keyed = canonical.withColumn("host", urls.part(F.col("url"), "host")).select("host", "url", F.col("score").cast("double").alias("score"), F.col("depth").cast("int").alias("depth"), F.col("ord").cast("long").alias("ord"), F.unix_millis("ts").alias("at"), "ts")
    return keyed.groupBy("host").transformWithStateInPandas(_Frontier(1000 * delay_seconds, each, per_host), outputStructType=POPPED, outputMode="append", timeMode="EventTime")
