"""Airtime budgets: what a sender may still send, by its transmissions so far.

A budget starts full, at window x factor milliseconds, gains factor for each millisecond that passes, never above full, and
loses what is sent, never below nothing. `states` folds a table of transmissions; `live_states` does the same over a
stream, with state that a timer drops once the budget must be full again, as at the start."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import scans


@dataclass(frozen=True)
class Budget:
    """gate_ms: what has to be there before a sender may send, half the airtime of the longest packet."""

    window_ms: int = 3_600_000
    factor: float = 0.5
    gate_ms: float = 0.0

    @property
    def full(self) -> float:
        return self.window_ms * self.factor


def _walked(budget: Budget, left: float, last: int | None, at: list[int], air: list[int]) -> tuple[list[float], list[float], list[int]]:
    """What is left before and after each transmission and how long its sender should have waited. left at last; a sender
    that hasn't sent before has it at its first transmission."""
    before, after, wait = [], [], []
    for now, sent in zip(at, air, strict=True):
        if last is not None:
            left = min(budget.full, left + max(0, now - last) * budget.factor)
        last = now if last is None else max(last, now)
        before.append(left)
        wait.append(0 if left >= budget.gate_ms else math.floor((budget.gate_ms - left) / budget.factor))
        left = max(0.0, left - sent)
        after.append(left)
    return before, after, wait


def states(sent: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """sent (grp, at_ms, id, air_ms; none null but grp) with before_ms and after_ms, the sender's budget around each
    transmission, and wait_ms, how long it should have waited. Ties in at_ms go by id.

    A step turns a budget x into max(0, min(full, x + gain) - air). Steps in a row are one map of the kind
    min(high, max(low, x + shift)), so a piece of a sender is three numbers; these are applied piece after piece, and inside
    the pieces each transmission from what came in. No task holds a hot sender."""
    cut = scans.pieces(sent, ["at_ms", "id"])
    full, factor = budget.full, budget.factor

    def reduced(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["at_ms", "id"])
        low, high, shift, last = -math.inf, math.inf, 0.0, None
        for now, air in zip(t["at_ms"].tolist(), t["air_ms"].tolist(), strict=True):
            gain = 0.0 if last is None else (now - last) * factor
            last = now
            step = lambda x: max(0.0, min(full, x + gain) - air)  # noqa: B023, E731
            low, high, shift = step(low), step(high), shift + gain - air
        return pd.DataFrame({"grp": t["grp"].iloc[:1], "piece": t["piece"].iloc[:1], "first": t["at_ms"].iloc[:1], "last": [last], "low": [low], "high": [high], "shift": [shift]})

    key = cut.schema["grp"].dataType.simpleString()
    per = cut.groupBy("grp", "piece").applyInPandas(reduced, f"grp {key}, piece int, first long, last long, low double, high double, shift double")

    # one row for each sender and piece: of these a sender has as many as there are partitions, at most
    entry = lambda s, p: F.when(s["last"].isNull(), F.lit(full)).otherwise(F.least(F.lit(full), s["left"] + (p["first"] - s["last"]) * factor))

    def follow(s, p):
        come = entry(s, p)
        left = F.least(p["high"], F.greatest(p["low"], come + p["shift"]))
        return F.struct(left.alias("left"), p["last"].alias("last"), F.concat(s["starts"], F.array(F.struct(p["piece"].alias("piece"), come.alias("come")))).alias("starts"))

    none = F.struct(F.lit(full).alias("left"), F.lit(None).cast("long").alias("last"), F.expr("CAST(array() AS array<struct<piece:int,come:double>>)").alias("starts"))
    inputs = F.sort_array(F.collect_list(F.struct("piece", "first", "last", "low", "high", "shift")))
    starts = per.groupBy("grp").agg(inputs.alias("p")).select("grp", F.inline(F.aggregate("p", none, follow)["starts"]))

    def applied(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["at_ms", "id"])
        before, after, wait = _walked(budget, float(t["_come"].iloc[0]), None, t["at_ms"].tolist(), t["air_ms"].tolist())
        return t.drop(columns=["piece", "_come"]).assign(before_ms=before, after_ms=after, wait_ms=wait)

    met = scans.met(cut, starts.withColumnRenamed("come", "_come"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields)
    return met.groupBy("grp", "piece").applyInPandas(applied, f"{columns}, before_ms double, after_ms double, wait_ms long").select(*sent.columns, "before_ms", "after_ms", "wait_ms")


class _Sender(StatefulProcessor):
    """One sender's budget after its last transmission. Its timer is set to when it is full again whatever was sent."""

    def __init__(self, budget: Budget):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("budget", "left double, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(rows)).sort_values(["at_ms", "id"])
        left, last = self.state.get() if self.state.exists() else (self.budget.full, None)
        at = t["at_ms"].tolist()
        before, after, wait = _walked(self.budget, left, last, at, t["air_ms"].tolist())
        self.state.update((after[-1], max(at[-1], last or at[-1])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(at[-1], last or at[-1]) + self.budget.window_ms)
        yield pd.DataFrame({"grp": t["grp"], "id": t["id"], "at_ms": t["at_ms"], "before_ms": before, "after_ms": after, "wait_ms": wait})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_states(sent: DataFrame, budget: Budget = Budget(), lateness: str = "10 minutes") -> DataFrame:
    """grp, id, at_ms, before_ms, after_ms, wait_ms over a stream of transmissions (grp long, ts timestamp, id long, air_ms
    long): as by `states` where each sender's transmissions come in order. What comes within the watermark but before a
    transmission already seen gains nothing for the time between. The state store has to be RocksDB's."""
    rows = sent.withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", lateness)
    schema = "grp long, id long, at_ms long, before_ms double, after_ms double, wait_ms long"
    return rows.groupBy("grp").transformWithStateInPandas(statefulProcessor=_Sender(budget), outputStructType=schema, outputMode="Append", timeMode="EventTime")
