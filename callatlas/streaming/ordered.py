"""Stream rules that need a call's rows in order, whatever order they arrive in: state with event-time timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.clicks import THRESHOLD
from ..operators.keys import keyed
from ..operators.targets import REGISTRY, detection, observe
from .streams import CHANGES, CURSOR

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: (carried rows, row) -> (carried rows, rows told); a row of None ends the call.
Step = Callable[[list[tuple], tuple | None], tuple[list[tuple], list[tuple]]]


class InOrder(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them, then go through step in order of time. A gap of over idle
    milliseconds ends a call: what it carries is told and forgotten, and the next row begins anew."""

    def __init__(self, columns: list[str], row: str, carry: str, names: list[str], step: Step, idle: int):
        self.columns, self.row, self.carry_schema, self.names, self.step, self.idle = columns, row, carry, names, step, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.row)
        self.carry = handle.getListState("carry", self.carry_schema)
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if x != x else x for x in r) for b in rows for r in b[self.columns].astype(object).itertuples(index=False, name=None)]
        new = [(int(r[0]), *(x.item() if hasattr(x, "item") else x for x in r[1:])) for r in new]
        self.held.appendList(new)
        self.handle.registerTimer(max(min(r[0] for r in new) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        ready = [r for r in held if r[0] <= mark * 1000]
        last = self.last.get()[0] if self.last.exists() else None
        carried, out = [tuple(r) for r in self.carry.get()] if self.carry.exists() else [], []
        for r in ready:
            if last is not None and r[0] - last > self.idle * 1000:
                out += self.step(carried, None)[1]
                carried = []
            carried, told = self.step(carried, r)
            out += told
            last = r[0]
        rest = held[len(ready) :]
        ended = last is not None and not rest and mark * 1000 > last + self.idle * 1000
        if ended:
            out += self.step(carried, None)[1]
        for state, rows in ((self.held, rest), (self.carry, [] if ended else carried)):
            state.clear()
            if rows:
                state.appendList(rows)
        if ended or last is None:
            self.last.clear()
        else:
            self.last.update((last,))
            self.handle.registerTimer(max(last // 1000 + self.idle + 1, mark + 1))
        if rest:
            self.handle.registerTimer(max(rest[0][0] // 1000 + 1, mark + 1))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=self.names)

    def close(self) -> None:
        pass


def in_order(df: DataFrame, columns: dict[str, str], carry: str, output: str, step: Step, late: str, idle_ms: int) -> DataFrame:
    """df (call_id, ts and columns, each with its type) through step, by call and in order of ts, then of columns. The state store
    must keep lists and timers, so the session's is set to the one that does."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    row = ", ".join(["us long", *(f"{c} {t}" for c, t in columns.items())])
    given = [F.unix_micros("ts"), *[F.col(c).cast(t) for c, t in columns.items()]]
    row, plain = ", ".join(f"c{k} {x.split()[1]}" for k, x in enumerate(row.split(", "))), [f"c{k}" for k in range(len(given))]  # names that are no words of Python
    carry = ", ".join(f"c{k} {x.split()[1]}" for k, x in enumerate(carry.split(", ")))
    d = df.withWatermark("ts", late).select("call_id", "ts", *[c.alias(n) for c, n in zip(given, plain, strict=True)])
    p = InOrder(plain, row, carry, [c.split()[0] for c in output.split(", ")], step, idle_ms)
    return d.groupBy("call_id").transformWithStateInPandas(statefulProcessor=p, outputStructType=keyed(output, df), outputMode="Append", timeMode="EventTime")


def peaks(threshold: float = THRESHOLD) -> Step:
    """E2 in steps: the score before last and the last one are carried."""

    def step(carried: list[tuple], r: tuple | None) -> tuple[list[tuple], list[tuple]]:
        before, now, at = carried[0] if carried else (None, None, None)
        after = None if r is None else r[2]
        top = now is not None and now >= threshold and (before is None or now >= before) and (after is None or now > after)
        told = [(at, now, min(0.98, max(0.3, now / (threshold * 20))))] if top else []
        return ([] if r is None else [(now, float(after), float(r[1]))]), told

    return step


def state_changes(scores: DataFrame, late: str = "10 seconds", idle_ms: int = 3_600_000, threshold: float = THRESHOLD) -> DataFrame:
    """Scores (call_id, ts, time_s, fraction) to local maxima, in order across batches; a call's last score is told, and the
    call forgotten, once nothing has come for idle_ms of its time."""
    return in_order(scores, {"time_s": "double", "fraction": "double"}, "before double, now double, at double", CHANGES, peaks(threshold), late, idle_ms)


def cursor_session(blobs: DataFrame, late: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """(call_id, ts, time_s, x, y, n_pixels, small) of frame pairs to cursor samples, in order across batches."""

    def step(carried: list[tuple], r: tuple | None) -> tuple[list[tuple], list[tuple]]:
        if r is None:
            return [], []
        _, time_s, x, y, n, small = r
        if n >= 4 and small:
            return [(x, y)], [(time_s, x, y, 0.75)]
        return carried, [(time_s, *carried[0], 0.7)] if carried and n < 4 else []

    columns = {"time_s": "double", "x": "int", "y": "int", "n_pixels": "int", "small": "boolean"}
    return in_order(blobs, columns, "x int, y int", CURSOR, step, late, idle_ms)


def elements(detections: DataFrame, late: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """The stable elements of a call, told once it has been silent for idle_ms, as the batch rule gives them."""
    inner = "x1 int, y1 int, x2 int, y2 int, text string, text_confidence double, interactive_confidence double, class string, first double, last double, n int"

    def step(carried: list[tuple], r: tuple | None) -> tuple[list[tuple], list[tuple]]:
        if r is None:
            return [], [(k, *e) for k, e in enumerate(carried)]
        held = [{"box": list(e[:4]), "text": e[4], "text_confidence": e[5], "interactive_confidence": e[6], "class": e[7], "first": e[8], "last": e[9], "n": e[10]} for e in carried]
        seen = pd.Series(dict(zip(("x1", "y1", "x2", "y2", "text", "text_confidence", "interactive_confidence", "class_"), r[3:], strict=True)), dtype=object)
        observe(held, r[1], detection(seen))
        return [(*map(int, e["box"]), e["text"], float(e["text_confidence"]), float(e["interactive_confidence"]), e["class"], float(e["first"]), float(e["last"]), int(e["n"])) for e in held], []

    columns = {"time_s": "double", "det_seq": "long", **{c.split()[0]: c.split()[1] for c in inner.split(", ")[:8]}}
    return in_order(detections, columns, inner, REGISTRY, step, late, idle_ms)
