"""Which networks limit us: refusals in event time, whatever the order in which they arrive, with timers and the cooldown that follows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.visits import COOLDOWN, MOST_COOLDOWN, REFUSAL_HOSTS, REFUSAL_SECONDS, TOO_MANY

OUT = "net bigint, event_id bigint, hosts bigint, limited boolean, cool_s bigint"
#: The state store that list state and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RefusalWindow(StatefulProcessor):
    """Of one network: refusals wait until the watermark has passed them, and are then judged in the order of their times.

    State: the waiting ones, those judged in the last ``seconds``, which a timer forgets when they are older, and how often the network was limited. So a late row
    counts where it belongs, and what a network holds is bounded by the watermark's delay and the window.
    """

    def __init__(self, seconds: int, hosts: int):
        self.span, self.least = seconds * 1_000_000, hosts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, event_id long, host long, status int")
        self.recent = handle.getListState("recent", "t long, host long")
        self.limited = handle.getValueState("limited", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            values = [tuple(map(int, r)) for r in pdf[["t", "event_id", "host", "status"]].itertuples(index=False)]
            if values:
                self.waiting.appendList(values)
                first = min(min(values)[0], first if first is not None else min(values)[0])
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get())
        due = [w for w in waiting if w[0] <= now]
        kept = [tuple(r) for r in self.recent.get()]
        n = self.limited.get()[0] if self.limited.exists() else 0
        out = []
        for i, (t, event_id, _, status) in enumerate(due):
            if not i or t != due[i - 1][0]:  # all refusals of one moment count for each other
                kept = [r for r in kept if t - r[0] <= self.span] + [(t, w[2]) for w in due[i:] if w[0] == t]
            hosts = len({h for _, h in kept})
            limited = status == TOO_MANY or hosts >= self.least
            n += limited
            out.append((int(key[0]), event_id, hosts, limited, min(COOLDOWN << min(n - 1, 20), MOST_COOLDOWN) if limited else None))
        kept = [r for r in kept if now - r[0] <= self.span]
        for state, values in ((self.waiting, waiting[len(due):]), (self.recent, kept)):
            if values:
                state.put(values)
            else:
                state.clear()
        self.limited.update((n,))
        ahead = [waiting[len(due)][0]] if len(due) < len(waiting) else [kept[0][0] + self.span] if kept else []
        for t in ahead:  # when the next one is due, or what is remembered is to be forgotten
            self.handle.registerTimer(-(-t // 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["net", "event_id", "hosts", "limited", "cool_s"]).astype({"cool_s": "Int64"})

    def close(self) -> None:
        pass


def network_limits(refusals: DataFrame, late: str = "1 hour", seconds: int = REFUSAL_SECONDS, hosts: int = REFUSAL_HOSTS) -> DataFrame:
    """The stream of ``visits.limits``: for each refusal (net, event_id, ts, host, status) the hosts of its network that refused in the ``seconds`` up to it, whether
    the network limits us, and for how long it is left alone then. Rows later than ``late`` are dropped; the others give what the batch gives, in whatever order they come.
    The session needs STORE."""
    rows = refusals.withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    return rows.groupBy("net").transformWithStateInPandas(statefulProcessor=RefusalWindow(seconds, hosts), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
