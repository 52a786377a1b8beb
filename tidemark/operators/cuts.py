"""Greedy cuts of ordered rows: sparse index entries, flushes, commit groups.

A cut is made where the bytes (or rows, or time) since the last cut reach a
threshold; the next cut depends on the last, so rows of one unit (a run, a
node) are a sequence. Units are dealt to tasks and streamed in order, a batch
at a time; units run in parallel. Within a batch the work is per cut, not per
row: a cut's successor is found by bisecting the running sums.

A null unit is a unit of its own, a null size counts as 0, and a null time
never ends a group: its wait counts from its first row with a time. Rows with a
null order come first. No rows give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_TIME = np.iinfo(np.int64).min


def _runs(units: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal units."""
    codes = units.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    begins = np.append(np.nonzero(np.diff(codes, prepend=-1))[0], len(codes))
    yield from zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)


def _fold(step: Callable, start: Callable, made: list[str], null: int):
    """Batches (unit, order, value) plus the columns that ``step(state, values)`` makes of a run of a unit's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, state = object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            values, parts = pc.fill_null(batch.column(2), null).to_numpy(zero_copy_only=False), []
            for a, b in _runs(batch.column(0)):
                if (now := batch.column(0)[a].as_py()) != unit:
                    unit, state = now, start()
                state, out = step(state, values[a:b])
                parts.append(out)
            columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *made])

    return run


def _by_unit(rows: DataFrame, unit: str, order: str, value: str, made: list[str], step: Callable, start: Callable, null: int = 0) -> DataFrame:
    slim = rows.select(F.col(unit), F.col(order).cast("long"), F.col(value).cast("long"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema] + [f"`{n}` bigint" for n in made])
    return slim.repartition(unit).sortWithinPartitions(unit, order).mapInArrow(_fold(step, start, made, null), schema)


def _greedy(begins: np.ndarray, last: int | None, limit: int) -> tuple[np.ndarray, int]:
    """Which rows are cuts, and where the last cut was made: a row is one if it begins ``limit`` or
    more after the last, or there was none."""
    cut = np.zeros(len(begins), np.int64)
    at = 0 if last is None else int(np.searchsorted(begins, last + limit))
    while at < len(begins):
        cut[at], last = 1, int(begins[at])
        at = max(at + 1, int(np.searchsorted(begins, last + limit)))
    return cut, last


def sparse_index(rows: DataFrame, unit: str, order: str, size: str, step_bytes: int = 4096) -> DataFrame:
    """(unit, order, offset): the first row of a run and each row that begins ``step_bytes`` or more after the last entry."""

    def step(state, sizes):
        at, last = state
        ends = at + np.cumsum(sizes)
        cut, last = _greedy(ends - sizes, last, step_bytes)
        return (int(ends[-1]), last), (ends - sizes, cut)

    out = _by_unit(rows, unit, order, size, ["offset", "cut"], step, lambda: (0, None))
    return out.filter("cut = 1").select(unit, order, "offset")


def flush_cuts(rows: DataFrame, unit: str, order: str, size: str, limit: int) -> DataFrame:
    """rows (unit, order, size) with ``segment``: a memtable is flushed before the first row that finds it full."""

    def step(state, sizes):
        at, last, segment = state
        ends = at + np.cumsum(sizes)
        cut, last = _greedy(ends - sizes, last, limit)
        segments = segment + np.cumsum(cut)
        return (int(ends[-1]), last, int(segments[-1])), (segments,)

    return _by_unit(rows, unit, order, size, ["segment"], step, lambda: (0, None, -1))


def commit_groups(rows: DataFrame, unit: str, order: str, ts: str, most: int = 100, wait_ns: int = 10_000_000) -> DataFrame:
    """rows with ``commit_group``: a group closes at ``most`` rows, or ``wait_ns`` after its first row."""

    def step(state, times):
        n, first, group = state
        groups, at = np.empty(len(times), np.int64), 0
        while at < len(times):
            # The group's rows from here: up to ``most``, or to the first that comes too late.
            part = times[at : at + most - n]
            if first == NO_TIME and (known := part[part != NO_TIME]).size:
                first = int(known[0])
            own = int(n == 0)  # a group holds its first row
            late = np.nonzero(part[own:] >= first + wait_ns)[0] + own if first != NO_TIME else part[:0]
            k = int(late[0]) if len(late) else len(part)
            groups[at : at + k] = group
            at, n = at + k, n + k
            if len(late) or n >= most:
                n, first, group = 0, NO_TIME, group + 1
        return (n, first, group), (groups,)

    return _by_unit(rows, unit, order, ts, ["commit_group"], step, lambda: (0, NO_TIME, 0), NO_TIME)
