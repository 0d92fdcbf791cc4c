"""Keyed state over unbounded logs with event-time timers: what is kept for a key goes when the watermark says so.

Every function takes a streaming DataFrame with a time in epoch milliseconds, puts the watermark on it and runs a
processor.  Rows at or before the watermark of the batches before are late and dropped by Spark.  A key's
rows of one batch are taken in order of time, then ``order``; earlier batches come first, as they do in a service.
Processors emit rows as they go (append mode) and need the RocksDB state store, which :func:`replay.replayed` sets.

State is bounded: windows by the watermark, saved values and epochs by a time to live, lists by a length.

Keys share state by their hash in ``BUCKETS`` buckets, so a call of Python, its looks at the state and its timers serve all
keys of a bucket at once.  A batch's rows of one bucket are in memory together; a log with more of them than a worker holds
takes more buckets.  A checkpoint belongs to its number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, ByteType, IntegerType, LongType, ShortType, StructField, StructType

BUCKETS = 512
_AT, _BUCKET, _NEW, _SEEN = "__at", "__bucket", "__new", "__seen"
#: Columns of the state beside a key's own.
_START, _N, _ORDER, _ENTRIES, _TOP, _LAST = "__start", "__n", "__order", "__entries", "__top", "__last"
_WHOLE = (ByteType, ShortType, IntegerType, LongType)


def _flag(name: str) -> str:
    return f"{name}__none"  # workers lose names that begin with an underscore


def _flagged(fields: list[StructField]) -> list[StructField]:
    """The fields as workers get them: whole numbers beside a mark of the missing ones, which pandas would turn all into doubles."""
    out: list[StructField] = []
    for f in fields:
        out.append(f)
        if isinstance(f.dataType, _WHOLE):
            out.append(StructField(_flag(f.name), BooleanType()))
    return out


def _names(fields: list[StructField]) -> list[str]:
    return [f.name for f in _flagged(fields)]


def _run(rows: DataFrame, key: str, ms: str, late: str, processor: StatefulProcessor, schema: StructType, taken: list[str]) -> DataFrame:
    """The processor's rows; it gets the columns ``taken`` beside the time and emits the fields of schema, both flagged."""
    whole = [f.name for f in rows.schema.fields if f.name in taken and isinstance(f.dataType, _WHOLE)]
    marked = rows.select(
        *[(F.coalesce(f"`{c}`", F.lit(0)) if c in whole and c != ms else F.col(f"`{c}`")).alias(c) for c in dict.fromkeys([*taken, ms])],
        *[F.col(f"`{c}`").isNull().alias(_flag(c)) for c in whole],
        F.timestamp_millis(F.col(f"`{ms}`")).alias(_AT), F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(BUCKETS)).alias(_BUCKET),
    )
    sent = StructType(_flagged([f for f in schema.fields if f.name in taken]) + [f for f in schema.fields if f.name not in taken])
    out = marked.withWatermark(_AT, late).groupBy(_BUCKET).transformWithStateInPandas(processor, sent, "append", "EventTime")
    return out.select(*[(F.when(~F.col(_flag(f.name)), F.col(f"`{f.name}`")) if f.name in whole else F.col(f"`{f.name}`")).alias(f.name) for f in schema.fields])


def _joined(held: pd.DataFrame | None, rows: pd.DataFrame) -> pd.DataFrame:
    return rows.copy() if held is None else pd.concat([held, rows], ignore_index=True)


class _Keyed(StatefulProcessor):
    """A processor that takes the rows of a bucket of keys in one batch, in order; its state is a list of rows."""

    def __init__(self, key: StructField, ms: str, order: str, kept: list[StructField], names: list[str]) -> None:
        fields = [*_flagged([key]), *kept]
        self.keys, self.ms, self.order, self.names = _names([key]), ms, order, names
        self.kept = [f.name for f in fields]
        self.schema = StructType([StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("held", self.schema)

    def held(self) -> pd.DataFrame | None:
        rows = list(self.state.get()) if self.state.exists() else []
        return pd.DataFrame(rows, columns=self.kept) if rows else None

    def hold(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.state.put(list(zip(*(rows[c].tolist() for c in self.kept), strict=True)))
        else:
            self.state.clear()

    def wake(self, before: int | None, at: int | None) -> None:
        """One timer a bucket, at the first time at which something goes."""
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is not None:
                self.handle.registerTimer(at)

    def of(self, rows: pd.DataFrame) -> Any:
        return rows.groupby(self.keys, sort=False, dropna=False)

    def beside(self, held: pd.DataFrame | None, new: pd.DataFrame) -> pd.DataFrame:
        """What is held, then new rows; rows of keys that have new ones are marked."""
        both = _joined(held, new)
        both[_NEW] = [False] * (len(both) - len(new)) + [True] * len(new)
        both[_SEEN] = self.of(both)[_NEW].transform("any")
        return both

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def expired(self, at: int) -> pd.DataFrame | None:
        return None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True).sort_values([self.ms, self.order], kind="stable", ignore_index=True)
        yield self.take(frame)[self.names]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = self.expired(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        if told is not None and len(told):
            yield told[self.names]

    def close(self) -> None:
        pass


class _Windows(_Keyed):
    """Counts by aligned window and key; a window's counts go when the watermark has passed its end."""

    def __init__(self, key: StructField, ms: str, order: str, limit: int, window_ms: int, names: list[str]) -> None:
        super().__init__(key, ms, order, [StructField(_N, LongType())], names)
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lists = StructType([StructField(f.name, ArrayType(f.dataType)) for f in self.schema.fields])
        self.counts = handle.getMapState("windows", "start long", lists)

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows[_START], rows[_N] = rows[self.ms] // self.window_ms * self.window_ms, 1
        held = {s: self.counts.getValue((s,)) for s in rows[_START].unique().tolist() if self.counts.containsKey((s,))}
        before = [pd.DataFrame(dict(zip(self.kept, map(list, lists), strict=True))).assign(**{_START: s}) for s, lists in held.items()]
        both = pd.concat([*before, rows[[*self.kept, _START]]], ignore_index=True)
        windows = both.groupby([_START, *self.keys], sort=False, dropna=False)[_N]
        place = windows.cumsum()[-len(rows) :].to_numpy()
        for start, own in windows.sum().reset_index().groupby(_START):
            self.counts.updateValue((int(start),), tuple(own[c].tolist() for c in self.kept))
            if start not in held:
                self.handle.registerTimer(int(start) + self.window_ms)
        fine = place <= self.limit
        wait = -(-(rows[_START] + self.window_ms - rows[self.ms]) // 1000)
        return rows.assign(window_start=rows[_START] // 1000, place=place, allowed=fine, retry_after_s=wait.where(~fine, 0))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.counts.removeKey((expiredTimerInfo.getExpiryTimeInMs() - self.window_ms,))
        return iter(())


def rate_limit(requests: DataFrame, key: str, ms: str, order: str, limit: int, window_ms: int = 60_000, late: str = "2 minutes") -> DataFrame:
    """requests plus window_start (s), place, allowed and retry_after_s: the first ``limit`` arrivals of a window pass.

    A request that arrives in a later batch, but not behind the watermark, counts in its own window.
    """
    told = StructType().add("window_start", "long").add("place", "long").add("allowed", "boolean").add("retry_after_s", "long")
    names = [*_names(requests.schema.fields), *told.fieldNames()]
    schema = StructType([*requests.schema.fields, *told.fields])
    return _run(requests, key, ms, late, _Windows(requests.schema[key], ms, order, limit, window_ms, names), schema, requests.columns)


class _Latest(_Keyed):
    """The last saved values of a key, until its time to live has passed."""

    def __init__(self, key: StructField, ms: str, order: StructField, values: list[StructField], ttl_ms: int, kind: str) -> None:
        self.kind, self.ttl_ms = kind, ttl_ms
        kept = {f.name: f for f in [StructField("at", LongType()), StructField(_ORDER, order.dataType), *_flagged(values)]}
        super().__init__(key, ms, order.name, list(kept.values()), [*_names([key]), "at", *_names(values), kind])

    def _due(self, held: pd.DataFrame | None) -> int | None:
        return None if held is None or not len(held) else int(held["at"].min()) + self.ttl_ms

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        held, new = self.held(), self.of(rows.assign(**{"at": rows[self.ms], _ORDER: rows[self.order]})[self.kept]).tail(1)
        both = self.beside(held, new)
        last = self.of(both.sort_values(["at", _ORDER], kind="stable")).tail(1)
        self.hold(last)
        self.wake(self._due(held), self._due(last))
        return last[last[_SEEN]].assign(**{self.kind: "saved"})

    def expired(self, at: int) -> pd.DataFrame | None:
        held = self.held()
        if held is None:
            return None
        gone = held["at"] + self.ttl_ms <= at
        self.hold(held[~gone])
        self.wake(None, self._due(held[~gone]))  # the timer that has fired is taken away by Spark
        return held[gone].assign(**{self.kind: "expired"})


def latest(rows: DataFrame, key: str, ms: str, order: str, *values: str, ttl_ms: int, late: str = "2 minutes", kind: str = "kind") -> DataFrame:
    """key, at, values and a column named by ``kind``: after each batch the last saved values of the keys in it (``saved``), and once what the watermark has outlived (``expired``)."""
    fields = rows.schema
    schema = StructType([fields[key]]).add("at", "long")
    for v in values:
        schema.add(fields[v])
    schema.add(kind, "string")
    processor = _Latest(fields[key], ms, fields[order], [fields[v] for v in values], ttl_ms, kind)
    return _run(rows, key, ms, late, processor, schema, list(dict.fromkeys([key, *values, order])))


class _Recent(_Keyed):
    """The items of a key that were used last, each once."""

    def __init__(self, key: StructField, ms: str, order: str, item: StructField, n: int) -> None:
        super().__init__(key, ms, order, [StructField("at", LongType()), StructField(_ORDER, LongType()), *_flagged([item])], [*_names([key]), "place", *_names([item]), "at"])
        self.item, self.items, self.n = item.name, _names([item]), n

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        held, new = self.held(), rows.assign(**{"at": rows[self.ms], _ORDER: rows[self.order]})[self.kept]
        both = self.beside(held, new)
        both = both.sort_values(["at", _ORDER, self.item], kind="stable").drop_duplicates([*self.keys, *self.items], keep="last")
        top = self.of(both).tail(self.n)
        self.hold(top)
        told = top[top[_SEEN]]
        return told.assign(place=self.of(told).cumcount(ascending=False) + 1)


def recents(rows: DataFrame, key: str, ms: str, order: str, item: str, n: int = 5, late: str = "2 minutes") -> DataFrame:
    """key, place, item, at: after each batch the n items that each key in it used last, the last first; order is a whole number."""
    schema = StructType([rows.schema[key]]).add("place", "long").add(rows.schema[item]).add("at", "long")
    return _run(rows, key, ms, late, _Recent(rows.schema[key], ms, order, rows.schema[item], n), schema, [key, item, order])


class _Ring(_Keyed):
    """The last n entries of a key in the order of their arrival."""

    def __init__(self, key: StructField, ms: str, order: str, n: int) -> None:
        super().__init__(key, ms, order, [StructField(_ENTRIES, ArrayType(LongType()))], [*_names([key]), "n", "first", "last"])
        self.n = n

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        held, entries = self.held(), {}
        if held is not None:
            entries = dict(zip(self._of_key(held), held[_ENTRIES].map(list), strict=True))
        seen = {}
        for k, entry in zip(self._of_key(rows), rows[self.order].tolist(), strict=True):
            seen.setdefault(k, []).append(int(entry))
        for k, more in seen.items():
            seen[k] = entries[k] = (entries.get(k, []) + more)[-self.n :]
        self.hold(pd.DataFrame([(*k, own) for k, own in entries.items()], columns=self.kept))
        return pd.DataFrame([(*k, len(own), own[0], own[-1]) for k, own in seen.items()], columns=self.names)

    def _of_key(self, rows: pd.DataFrame) -> list[tuple]:
        return list(zip(*(rows[c].tolist() for c in self.keys), strict=True))


def ring(rows: DataFrame, key: str, ms: str, order: str, n: int = 100, late: str = "2 minutes") -> DataFrame:
    """key, n, first, last: after each batch the number and the ends of what each key in it keeps; order is a whole number."""
    schema = StructType([rows.schema[key]]).add("n", "long").add("first", "long").add("last", "long")
    return _run(rows, key, ms, late, _Ring(rows.schema[key], ms, order, n), schema, [key, order])


class _Epochs(_Keyed):
    """The latest epoch of a key, until nothing has come for some time."""

    def __init__(self, key: StructField, ms: str, order: str, epoch: str, idle_ms: int, names: list[str]) -> None:
        super().__init__(key, ms, order, [StructField(_TOP, LongType()), StructField(_LAST, LongType())], names)
        self.epoch, self.idle_ms = epoch, idle_ms

    def _due(self, held: pd.DataFrame | None) -> int | None:
        return None if held is None or not len(held) else int(held[_LAST].min()) + self.idle_ms

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        missing = rows[_flag(self.epoch)]
        rows[_TOP], rows[_LAST] = rows[self.epoch].mask(missing, -(2**63)), rows[self.ms]
        held = self.held()
        both = _joined(held, rows[self.kept])
        before = self.of(both)[_TOP].cummax()[-len(rows) :].to_numpy()
        now = self.of(both)[[_TOP, _LAST]].max().reset_index()
        self.hold(now)
        self.wake(self._due(held), self._due(now))
        return rows[(rows[_TOP] >= before) & ~missing]

    def expired(self, at: int) -> None:
        held = self.held()
        if held is not None:
            left = held[held[_LAST] + self.idle_ms > at]
            self.hold(left)
            self.wake(None, self._due(left))  # the timer that has fired is taken away by Spark


def current_results(results: DataFrame, key: str, ms: str, order: str, epoch: str, idle_ms: int, late: str = "2 minutes") -> DataFrame:
    """Results that no earlier arrival of their key has overtaken with a later epoch; a key is forgotten idle_ms after its last result."""
    names = _names(results.schema.fields)
    return _run(results, key, ms, late, _Epochs(results.schema[key], ms, order, epoch, idle_ms, names), results.schema, results.columns)
