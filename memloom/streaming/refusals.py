"""Requests refused beyond a monthly cap, as a stateful stream.

State is one number for each team and period: the requests admitted so far. A batch's requests of a team and period are taken by
time and id; those within what the cap leaves are admitted and counted, the others refused and not counted. The state goes when the
watermark has passed the period's end; what comes for that period later isn't admitted (Spark leaves out what is behind the watermark
itself).

Teams are dealt to SHARDS shards, each with a map of its teams' numbers, and a call takes a period's requests of a shard at once, so
frames are worked on whole and only the teams of a batch are looked up and written.

Defined cases: a cap of 0 or less refuses none; where the requests have a column `cap` (a team's plan), it goes before the given
cap; a batch that is delivered again after a failure gives what it gave, as the state is that of its start; at most
cap requests of a team and period are held at a time, so a hot team doesn't fill a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Shards of the teams of a period. A stream that was begun with another number can't go on.
SHARDS = 1024


def period_end(period: str) -> int:
    """The first millisecond after a period (yyyy-MM) of UTC."""
    year, month = int(period[:4]), int(period[5:7])
    return int(datetime(year + month // 12, month % 12 + 1, 1, tzinfo=timezone.utc).timestamp() * 1000)


class Refusals(StatefulProcessor):
    """Admits the first requests of each team of a (period, shard), by ts and id, up to the cap."""

    def __init__(self, cap: int, columns: list[str], team: StructType):
        self.cap, self.columns, self.team = cap, columns, team

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", self.team, "used long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() >= period_end(key[0])
        numbers: dict = {}  # of the teams that came, in the order of the lists below
        used: list[int] = []
        left: list[float] = []
        count: list[int] = []
        held = None
        for frame in rows:
            if closed:
                yield frame[self.columns].assign(admitted=False)
                continue
            codes, names = pd.factorize(frame["team_id"], use_na_sentinel=False)
            last = np.zeros(len(names), int)
            np.maximum.at(last, codes, np.arange(len(codes)))
            caps = frame["cap"].iloc[last].tolist() if "cap" in frame.columns else [self.cap] * len(names)
            own = np.zeros(len(names), int)
            for i, (name, cap) in enumerate(zip(names.tolist(), caps, strict=True)):
                name = None if pd.isna(name) else name
                if name not in numbers:
                    numbers[name] = len(used)
                    known = self.used.getValue((name,))
                    used.append(int(known[0]) if known else 0)
                    left.append(0)
                    count.append(0)
                own[i] = numbers[name]
                left[own[i]] = max(0, int(cap) - used[own[i]]) if int(cap) > 0 else np.inf
            room, frame = np.array(left), frame[self.columns].assign(__team=own[codes])
            free = np.isinf(room)[frame["__team"]]
            if free.any():
                for n, k in frame["__team"][free].value_counts().items():
                    count[n] += k
                yield frame[free][self.columns].assign(admitted=True)
                frame = frame[~free]
            held = (frame if held is None else pd.concat([held, frame])).sort_values(["ts", "id"], kind="stable")
            over = (held.groupby("__team").cumcount() >= room[held["__team"]]).to_numpy()
            if over.any():
                yield held[over][self.columns].assign(admitted=False)
                held = held[~over]
        if held is not None and len(held):
            for n, k in held["__team"].value_counts().items():
                count[n] += k
            yield held[self.columns].assign(admitted=True)
        if not closed:
            for name, n in numbers.items():
                if count[n]:
                    self.used.updateValue((name,), (int(used[n] + count[n]),))
            self.handle.registerTimer(period_end(key[0]))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def admitted_stream(requests: DataFrame, cap: int, late: str = "1 day") -> DataFrame:
    """A stream of requests (team_id, id, ts timestamp, maybe cap, and others) with period and admitted. The session's state store has
    to be STORE, which `with_store` sees to."""
    named = requests.withColumn("period", F.date_format("ts", "yyyy-MM")).withWatermark("ts", late)
    out = StructType([f for f in named.schema.fields if f.name != "cap"]).add("admitted", "boolean")
    columns = [f.name for f in out.fields if f.name != "admitted"]
    team = StructType([named.schema["team_id"]])
    dealt = named.withColumn("__shard", F.pmod(F.xxhash64("team_id"), F.lit(SHARDS)).cast("int"))
    return dealt.groupBy("period", "__shard").transformWithStateInPandas(Refusals(cap, columns, team), out, "Append", "EventTime")


def with_store(spark: object) -> None:
    """Sets the session's state store to the one that such state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def run_refusals(requests: DataFrame, cap: int, out: str, checkpoint: str, late: str = "1 day") -> None:
    """Takes all requests that are there and not yet taken, and appends them with `admitted` to the files in out."""
    with_store(requests.sparkSession)
    stream = admitted_stream(requests, cap, late)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
