"""Metric series over a stream: the batch summary's numbers kept per series, with timers that close missed scrapes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_NUMBERS = "seen long, n long, total double, low double, high double, first_index long, last_index long, first_value double, last_value double, known double, pairs long, resets long"
_NAMES = [c.split(" ")[0] for c in _NUMBERS.split(", ")]
SUMMARY = "name string, labels string, kind string, samples long, mean double, minimum double, maximum double, known_delta double, resets long, scrapes long, delta double, closed_at long"


def _empty() -> dict:
    return dict.fromkeys(_NAMES) | {"seen": 0, "n": 0, "total": 0.0, "known": 0.0, "pairs": 0, "resets": 0}


def counted(s: dict, index: int, value: float | None) -> dict:
    """The numbers after one more scrape; one not later than the last counted is left out."""
    value = None if value is None or value != value else float(value)
    last = s["last_index"]
    if last is not None and index <= last:
        return s
    s = dict(s)
    if value is not None and s["last_value"] is not None:
        if value < s["last_value"]:
            s["resets"] += 1
        elif index == last + 1:
            s["known"], s["pairs"] = s["known"] + value - s["last_value"], s["pairs"] + 1
    if s["first_index"] is None:
        s["first_index"], s["first_value"] = index, value
    if value is not None:
        s["n"], s["total"] = s["n"] + 1, s["total"] + value
        s["low"], s["high"] = (value if s["low"] is None else min(s["low"], value)), (value if s["high"] is None else max(s["high"], value))
    s["seen"], s["last_index"], s["last_value"] = s["seen"] + 1, index, value
    return s


def summarised(s: dict) -> dict:
    whole = s["first_index"] is not None and not s["resets"] and s["n"] == s["last_index"] - s["first_index"] + 1
    return {
        "samples": s["n"], "mean": s["total"] / s["n"] if s["n"] else None, "minimum": s["low"], "maximum": s["high"], "known_delta": s["known"] if s["pairs"] else None, "resets": s["resets"],
        "scrapes": s["seen"], "delta": s["last_value"] - s["first_value"] if whole else None,
    }


class SeriesState(StatefulProcessor):
    """One series (name, labels): a value state of a few numbers per kind of sample in a map state (a gauge or counter has
    ``value``; a histogram's parts ``sum`` and ``count`` share their series), and a timer that reports a series that no
    scrape brought for ``patience_ms``."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kinds = handle.getMapState("kinds", "kind string", _NUMBERS)
        self.timer = handle.getValueState("timer", "at long")

    def _rows(self, key: tuple, closed: int | None) -> pd.DataFrame:
        rows = [{"name": key[0], "labels": key[1], "kind": kind[0], **summarised(dict(zip(_NAMES, state, strict=True))), "closed_at": closed} for kind, state in self.kinds.iterator()]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SUMMARY.split(", ")]).astype(object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("scrape_index")
        for kind, own in batch.groupby("kind"):
            state = dict(zip(_NAMES, self.kinds.getValue((kind,)), strict=True)) if self.kinds.containsKey((kind,)) else _empty()
            for index, value in zip(own["scrape_index"].tolist(), own["value"].tolist(), strict=True):
                state = counted(state, index, value)
            self.kinds.updateValue((kind,), tuple(state[n] for n in _NAMES))
        if self.patience:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.patience
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield self._rows(key, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield self._rows(key, expiredTimerInfo.getExpiryTimeInMs())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            self.kinds.updateValue((row.kind,), tuple(None if (v := getattr(row, n)) is None or v != v else (float(v) if kind == "double" else int(v)) for n, kind in (c.split(" ") for c in _NUMBERS.split(", "))))

    def close(self) -> None:
        pass


def series_stream(samples: DataFrame, patience_ms: int = 0, initial: DataFrame | None = None) -> DataFrame:
    """For a streaming frame of name, labels (text), kind, scrape_index and value: a row per series and kind whenever a
    micro-batch touches the series, with the summary so far; and, with ``patience_ms``, one with ``closed_at`` when no scrape
    came for so long. ``initial`` (``as_state``) starts series from an earlier batch. Needs the RocksDB state store."""
    grouped = samples.groupBy("name", "labels")
    mode = "ProcessingTime" if patience_ms else "None"
    start = initial.groupBy("name", "labels") if initial is not None else None
    return grouped.transformWithStateInPandas(SeriesState(patience_ms), SUMMARY, "Update", mode, start)


def as_state(samples: DataFrame) -> DataFrame:
    """The state that a batch of samples (name, labels, kind, scrape_index, value) leaves, one row per series and kind."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = _empty()
        for index, value in rows.sort_values("scrape_index")[["scrape_index", "value"]].itertuples(index=False):
            state = counted(state, int(index), value)
        return pd.DataFrame([{"name": key[0], "labels": key[1], "kind": key[2], **state}])

    return samples.groupBy("name", "labels", "kind").applyInPandas(fold, f"name string, labels string, kind string, {_NUMBERS}")
