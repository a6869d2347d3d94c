"""Rows in order over many tasks: running values, numbers and neighbours, with no group in one task.

`laid` deals rows by ranges of their keys and order, which also splits a single key's rows, and writes them. Each task then
reduces its part to its first and last group, what a task needs from those before or after it follows from these (a row
a partition, whatever the corpus), and a second pass over the written rows gives every row its value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cut import kept

Values = tuple[np.ndarray, ...]


@dataclass(frozen=True)
class Fold:
    """An associative operation on tuples of arrays, element by element; earlier rows are its first argument."""

    join: Callable[[Values, Values], Values]


SUM = Fold(lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))
#: The last value that is not NaN.
LAST = Fold(lambda a, b: tuple(np.where(np.isnan(y), x, y) for x, y in zip(a, b, strict=True)))


def laid(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """df in ranges of keys and order, nulls first, sorted within them and written; part_ is the number of the range."""
    by = [*map(F.col, keys), *[F.col(o) if isinstance(o, str) else o for o in order]]
    return kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part_", F.spark_partition_id()))


def starts(keys: Sequence[pa.Array]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; nulls are equal, and the first row counts as different."""
    n = len(keys[0]) if keys else 0
    out = np.zeros(n, bool)
    out[:1] = True
    for k in keys:
        codes = pc.dictionary_encode(k, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def scanned(fold: Fold, new: np.ndarray, values: Values) -> Values:
    """Running values of the stretches that begin where `new` is set, by doubling distances."""
    values, done, far = tuple(v.copy() for v in values), new.copy(), 1
    while far < done.size and (at := np.flatnonzero(~done[far:]) + far).size:
        joined = fold.join(tuple(v[at - far] for v in values), tuple(v[at] for v in values))
        ended = done[at - far]
        for v, x in zip(values, joined, strict=True):
            v[at] = x
        done[at] = ended
        far *= 2
    return values


def _row(columns: Sequence[pa.Array], i: int) -> tuple:
    return tuple(c[i].as_py() for c in columns)


def _ends(rows: DataFrame, keys: Sequence[str], values: Sequence[str], fold: Fold | None) -> list:
    """A row for each part that has any: part, first and last keys, and what it holds of these two groups.

    With a fold this is its value over the group's rows in the part, without one the first and the last row's values.
    one: both groups are the same.
    """
    nk, nv = len(keys), len(values)
    kinds = [rows.schema[k].dataType for k in keys], [rows.schema[v].dataType for v in values]
    fields = [T.StructField("part", T.IntegerType())]
    fields += [T.StructField(f"{e}{i}", t) for e in ("first_key", "last_key") for i, t in enumerate(kinds[0])]
    fields += [T.StructField(f"{e}{i}", t) for e in ("first", "last") for i, t in enumerate(kinds[1])]
    schema = T.StructType([*fields, T.StructField("one", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, tail, head_value, tail_value, one, arrow = None, None, None, None, None, True, None
        for b in batches:
            if not b.num_rows:
                continue
            ks, vs, part = b.columns[1 : 1 + nk], b.columns[1 + nk :], b.column(0)[0].as_py()
            arrow = [c.type for c in b.columns[1:]]
            if fold is None:
                if head is None:
                    head, head_value = _row(ks, 0), _row(vs, 0)
                tail, tail_value = _row(ks, b.num_rows - 1), _row(vs, b.num_rows - 1)
                continue
            new, vals = starts(ks), tuple(v.to_numpy(zero_copy_only=False).copy() for v in vs)
            if tail is not None and _row(ks, 0) == tail:
                for v, x in zip(vals, fold.join(tail_value, tuple(v[:1] for v in vals)), strict=True):
                    v[:1] = x
            elif tail is not None:
                head_value, one = (tail_value if one else head_value), False
            head = _row(ks, 0) if head is None else head
            vals, at = scanned(fold, new, vals), np.flatnonzero(new[1:])
            if at.size:
                head_value = tuple(v[at[:1]] for v in vals) if one else head_value
                one = False
            tail, tail_value = _row(ks, b.num_rows - 1), tuple(v[-1:] for v in vals)
        if part is not None:
            plain = lambda x: x if fold is None else [v[0].item() for v in x]
            cells = [part, *head, *tail, *plain(tail_value if one and fold else head_value), *plain(tail_value), one if fold else head == tail]
            types = [pa.int32(), *arrow[:nk], *arrow[:nk], *arrow[nk:], *arrow[nk:], pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=schema.names)

    got = rows.select("part_", *keys, *values).mapInArrow(run, schema).collect()
    return sorted([(r[0], tuple(r[1 : 1 + nk]), tuple(r[1 + nk : 1 + 2 * nk]), tuple(r[1 + 2 * nk : 1 + 2 * nk + nv]), tuple(r[1 + 2 * nk + nv : -1]), r[-1]) for r in got])


def running(rows: DataFrame, keys: Sequence[str], values: Sequence[str], fold: Fold, names: Sequence[str]) -> DataFrame:
    """laid rows with columns `names`: the fold of `values`, bigint or double and never null, from a group's first row to this one."""
    nk, kinds = len(keys), [rows.schema[v].dataType for v in values]
    carry, key, value = {}, None, None
    for part, first, last, first_value, last_value, one in _ends(rows, keys, values, fold):
        if key is not None and first == key:
            carry[part] = (key, value)
            first_value = tuple(x.item() for v in [fold.join(tuple(np.array([x]) for x in value), tuple(np.array([x]) for x in first_value))] for x in v)
        key, value = last, first_value if one else last_value
    every = rows.columns
    at = [every.index(c) for c in (*keys, *values)]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            ks, vals = [b.column(i) for i in at[:nk]], tuple(b.column(i).to_numpy(zero_copy_only=False).copy() for i in at[nk:])
            if tail is None and (known := carry.get(b.column(every.index("part_"))[0].as_py())):
                tail, state = known[0], tuple(np.array([x], v.dtype) for x, v in zip(known[1], vals, strict=True))
            if tail is not None and _row(ks, 0) == tail:
                for v, x in zip(vals, fold.join(state, tuple(v[:1] for v in vals)), strict=True):
                    v[:1] = x
            vals = scanned(fold, starts(ks), vals)
            tail, state = _row(ks, b.num_rows - 1), tuple(v[-1:] for v in vals)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, vals)], names=[*every, *names])

    return rows.mapInArrow(run, schema)


def numbered(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """laid rows with their number within their group, from 0."""
    counted = running(rows.withColumn("one_", F.lit(1).cast("long")), keys, ["one_"], SUM, [name])
    return counted.withColumn(name, F.col(name) - 1).drop("one_")


def neighbours(rows: DataFrame, keys: Sequence[str], before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> DataFrame:
    """laid rows with columns of the row before and of the row after within their group, null at its ends: {new name: column}."""
    before, after = before or {}, after or {}
    values = list(dict.fromkeys([*before.values(), *after.values()]))
    ends = _ends(rows, keys, values, None)
    earlier, later = {}, {}
    for (p, _, last, _, last_value, _), (q, first, _, first_value, *_) in zip(ends, ends[1:], strict=False):
        if last == first:
            earlier[q], later[p] = last_value, first_value
    every = rows.columns
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, rows.schema[c].dataType) for d in (before, after) for n, c in d.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lambda b, i: _row([b.column(every.index(k)) for k in keys], i)
        cell = lambda b, i: _row([b.column(every.index(c)) for c in values], i)

        def told(b: pa.RecordBatch, left: tuple | None, right: tuple | None) -> pa.RecordBatch:
            new = starts([b.column(every.index(k)) for k in keys])
            out = list(b.columns)
            for names, side in ((before, left), (after, right)):
                edge = new.copy() if names is before else np.append(new[1:], True)
                edge[0 if names is before else -1] = False
                for c in names.values():
                    column = b.column(every.index(c))
                    own = pa.array([side[values.index(c)] if side else None], column.type)
                    moved = [own, column.slice(0, len(column) - 1)] if names is before else [column.slice(1), own]
                    out.append(pc.if_else(pa.array(edge), pa.scalar(None, column.type), pa.concat_arrays(moved)))
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        held, left, part = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            if held is None:
                part = b.column(every.index("part_"))[0].as_py()
                left = earlier.get(part)
            else:
                same = key(held, held.num_rows - 1) == key(b, 0)
                yield told(held, left, cell(b, 0) if same else None)
                left = cell(held, held.num_rows - 1) if same else None
            held = b
        if held is not None:
            yield told(held, left, later.get(part))

    return rows.mapInArrow(run, schema)
