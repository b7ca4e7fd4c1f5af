"""Rank sums of every pair of groups from one histogram, along the value axis.

The histogram of a key is read in order of value, and a running array holds how many values of each group lie
below. Every spot adds to a matrix of all pairs of groups, so no row is copied per group. A key too large for one
task is cut into ranges of values; each range is summed alone, and ranges are joined in order by
their totals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised, shuffle_partitions
from .scan import BLOCK_ROWS, ordered

#: Entries of the dense matrices of spots and groups that are held at a time.
CELLS = 1_000_000


class Sums:
    """Sums over the spots seen so far, for groups as they turn up.

    ``n`` and ``m`` count the values that ask and that answer, ``u[a, b]`` the pairs in which a value of ``a`` exceeds
    one of ``b``, equality counting half, ``own`` and ``other`` the tie sums of a group by itself, ``t`` what pairs add.
    """

    def __init__(self):
        self.names, self.index = [], {}
        self.n, self.m, self.own, self.other = (np.zeros(0) for _ in range(4))
        self.u, self.t = np.zeros((0, 0)), np.zeros((0, 0))

    def places(self, names: Sequence) -> np.ndarray:
        new = [x for x in names if x not in self.index]
        if new:
            self.index.update({x: len(self.names) + k for k, x in enumerate(new)})
            self.names += new
            self.n, self.m, self.own, self.other = (np.pad(v, (0, len(new))) for v in (self.n, self.m, self.own, self.other))
            self.u, self.t = (np.pad(v, (0, len(new))) for v in (self.u, self.t))
        return np.array([self.index[x] for x in names], int)

    def add(self, names: Sequence, asks: np.ndarray, answers: np.ndarray) -> None:
        """Spots in ascending order behind all seen before: a row for each spot, a column for each name."""
        later = Sums()
        later.places(names)
        later.n, later.m = asks.sum(0), answers.sum(0)
        later.u = asks.T @ (np.cumsum(answers, axis=0) - answers / 2.0)
        later.t = 3.0 * ((asks * asks).T @ answers + asks.T @ (answers * answers))
        later.own, later.other = (asks**3 - asks).sum(0), (answers**3 - answers).sum(0)
        self.join(later)

    def join(self, later: Sums) -> None:
        """What lies behind all seen before, summed by itself."""
        i = self.places(later.names)
        self.u[i, :] += np.outer(later.n, self.m)
        inner = np.ix_(i, i)
        self.u[inner] += later.u
        self.t[inner] += later.t
        for name in ("n", "m", "own", "other"):
            getattr(self, name)[i] += getattr(later, name)


def _same_as_before(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it, missing values being equal."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    equal = pc.fill_null(pc.equal(a, b), False)
    return np.asarray(pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))))


def _starts(columns: Sequence[pa.Array], n: int) -> np.ndarray:
    same = np.ones(max(0, n - 1), bool)
    for column in columns:
        same &= _same_as_before(column)
    return np.flatnonzero(np.r_[True, ~same])


def _sums_by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Sums]]:
    """Of rows ``keys, at, group, ask, answer`` sorted by keys and place: each key with its sums."""
    kept, now, sums = None, None, Sums()
    for batch in _and_none(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            kept = batch if kept is None else pa.concat_batches([kept, batch])
        if kept is None:
            break
        spots = _starts(kept.columns[: keys + 1], kept.num_rows)
        # The last spot may go on in the next batch.
        ready, kept = (kept.slice(0, spots[-1]), kept.slice(spots[-1])) if batch is not None else (kept, None)
        if not ready.num_rows:
            continue
        spots = spots[spots < ready.num_rows]
        codes = ready.column(keys + 1).dictionary_encode()
        names, codes = codes.dictionary.to_pylist(), np.asarray(codes.indices)
        asks, answers = (ready.column(keys + k).to_numpy().astype(float) for k in (2, 3))
        spot = np.repeat(np.arange(len(spots)), np.diff(np.append(spots, ready.num_rows)))
        edges = np.append(_starts(ready.columns[:keys], ready.num_rows), ready.num_rows)
        for first, last in zip(edges, edges[1:]):
            key = tuple(ready.column(k)[int(first)].as_py() for k in range(keys))
            if key != now:
                if now is not None:
                    yield now, sums
                now, sums = key, Sums()
            groups, column = np.unique(codes[first:last], return_inverse=True)
            named, at = [names[g] for g in groups], spot[first:last] - spot[first]
            step = max(1, CELLS // len(groups))
            for low in range(0, int(at[-1]) + 1, step):
                rows = slice(*np.searchsorted(at, [low, low + step]))
                dense = np.zeros((2, min(step, int(at[-1]) + 1 - low), len(groups)))
                for side, values in enumerate((asks, answers)):
                    np.add.at(dense[side], (at[rows] - low, column[rows]), values[first:last][rows])
                sums.add(named, dense[0], dense[1])
    if now is not None:
        yield now, sums


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def rank_sums(
    counts: DataFrame,
    keys: Sequence[str],
    group: str,
    value: str,
    *,
    shift: float = 0.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """U statistic and tie sum of every ordered pair of groups, from a histogram.

    ``counts`` has ``keys, group, value, n``, without missing groups and values.  ``u`` counts the pairs in
    which a value of ``group`` exceeds a value of ``other`` by more than ``shift``, equality counting half.
    The histogram is moved once, or twice with a shift: once to ask, once moved up to answer.
    """
    keys = list(keys)
    x, n, none = F.col(value).cast("double"), F.col("n").cast("long"), F.lit(0).cast("long")
    facts = counts.select(*keys, x.alias("__at"), group, n.alias("__ask"), n.alias("__answer"))
    if shift:
        answers = counts.select(*keys, (x + F.lit(float(shift))).alias("__at"), group, none.alias("__ask"), n.alias("__answer"))
        facts = facts.withColumn("__answer", none).unionByName(answers)
    by = keys or ["__all"]
    if not keys:
        facts = facts.withColumn("__all", F.lit(0))
    along = ordered(facts, by, F.col("__at"), block_rows=block_rows)
    width, fields = len(by), [along.df.schema[k] for k in by]
    group_field = T.StructField(group, counts.schema[group].dataType)
    arrays = ["n", "m", "own", "other", "u", "t"]
    part_schema = T.StructType([*fields, T.StructField("__block", T.IntegerType()), T.StructField("names", T.ArrayType(group_field.dataType))])
    for name in arrays:
        part_schema.add(name, T.ArrayType(T.DoubleType()))
    out_schema = T.StructType([*fields, group_field, T.StructField("other", group_field.dataType)])
    for name, kind in (("n", T.LongType()), ("n_other", T.LongType()), ("u", T.DoubleType()), ("tie_sum", T.DoubleType())):
        out_schema.add(name, kind)

    def pairs_of(found: Iterator[tuple[tuple, Sums]], like: pa.Schema) -> Iterator[pa.RecordBatch]:
        for key, sums in found:
            a, b = np.nonzero(~np.eye(len(sums.names), dtype=bool))
            if len(a):
                named = pa.array(sums.names, like.field(group).type)
                columns = [pa.array([v] * len(a), like.field(k).type) for k, v in zip(by, key)] + [named.take(pa.array(a)), named.take(pa.array(b))]
                columns += [pa.array(v.astype(np.int64)) for v in (sums.n[a], sums.m[b])]
                columns += [pa.array(v) for v in (sums.u[a, b], sums.own[a] + sums.t[a, b] + sums.other[b])]
                yield pa.RecordBatch.from_arrays(columns, names=out_schema.names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from pairs_of(_sums_by_key(_with_first(first, batches), width), first.schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        like = first.schema
        types = [*(like.field(k).type for k in by), pa.int32(), pa.list_(like.field(group).type), *[pa.list_(pa.float64())] * len(arrays)]
        for key, sums in _sums_by_key(_with_first(first, batches), width + 1):
            row = [*key, sums.names, *(getattr(sums, name).ravel() for name in arrays)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=part_schema.names)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges of a key in order: only one sum is held at a time."""

        def found() -> Iterator[tuple[tuple, Sums]]:
            now, sums = None, Sums()
            for row in _rows(_with_first(first, batches)):
                key, later, size = tuple(row[k] for k in by), Sums(), len(row["names"])
                if key != now:
                    if now is not None:
                        yield now, sums
                    now, sums = key, Sums()
                later.places(row["names"])
                for name in arrays:
                    shape = (size, size) if name in ("u", "t") else (size,)
                    setattr(later, name, np.array(row[name], float).reshape(shape))
                sums.join(later)
            if now is not None:
                yield now, sums

        first = next(batches, None)
        if first is not None:
            fields = [*(first.schema.field(k) for k in by), pa.field(group, first.schema.field("names").type.value_type)]
            yield from pairs_of(found(), pa.schema(fields))

    tasks = shuffle_partitions(counts.sparkSession)
    columns = ["__at", group, "__ask", "__answer"]
    if along.split:
        rows = along.df.select(*by, "__block", *columns).repartition(tasks, *by, "__block").sortWithinPartitions(*by, "__block", "__at")
        found = materialised(rows.mapInArrow(parts, part_schema))
        out = found.repartition(tasks, *by).sortWithinPartitions(*by, "__block").mapInArrow(together, out_schema)
    else:
        rows = along.df.select(*by, *columns).repartition(tasks, *by).sortWithinPartitions(*by, "__at")
        out = rows.mapInArrow(whole, out_schema)
    return out.select(*keys, group, "other", "n", "n_other", "u", "tie_sum")


def _with_first(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
