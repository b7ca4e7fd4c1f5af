"""Exact top-k search by vector-approximation files.

Vectors of whole numbers are kept in blocks twice: exactly, and as cells of a grid, a byte for each
component. A search scans the cells only. From the corners of its cell every vector has a lower and
an upper bound of its inner product with the query, and those whose upper bound is below the k-th
best lower bound of the block are out. Exact vectors are then read in the order of their bounds: first the most
promising ones, then those that the k-th exact score does not rule out; then the block's result is certain.
Both forms of a block travel together, so that candidates are told apart where they are found: what a task
hands on is the best few of a query, however wide the cells are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortframe.session import materialised, shuffle_partitions

from .common import lookup

#: Cells of a component.
CELLS = 64
#: Vectors whose components place the cuts between cells: a bounded sample, taken by hash. The cuts set the speed
#: only; every vector is in the file, and bounds hold for all.
SAMPLE = 4_096
#: Vectors in a block of the file, and queries in a block.
BLOCK, QUERIES = 8_192, 4_096
#: Queries that a task holds against a block at a time.
ROWS = 64
#: Components stay below this in size, and below what would take scores beyond 64 bits.
LARGEST = 1 << 30


def whole(vectors: DataFrame, key: str, vector: str, factor: int) -> DataFrame:
    """``id, dim, ints``: each usable row's components ``floor(factor * x)`` as bytes of 32-bit numbers.

    Left out: missing and empty vectors, and those with a component that is missing, NaN or infinite, or so
    large (``LARGEST``, less for very long vectors) that scores would not fit 64 bits.
    """
    x = F.col(vector)
    limit = F.least(F.lit(float(LARGEST)), F.sqrt(F.lit(2.0**62) / F.size(x))) / factor
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < limit))
    usable = vectors.where(x.isNotNull() & (F.size(x) > 0) & fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets) * 4
            ints = np.floor(np.asarray(lists.flatten()) * float(factor)).astype("<i4").tobytes()
            start = ends[0] if len(ends) else 0
            found = [ints[a - start : b - start] for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends) // 4, pa.int32()), pa.array(found, pa.binary())], names=["id", "dim", "ints"]
            )

    return usable.select(F.col(key).alias("id"), x.cast("array<double>")).mapInArrow(run, "id long, dim int, ints binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim)


def cuts(classes: DataFrame, dim: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cuts between the cells of each component, and the least and largest value in each cell.

    Cuts are quantiles of a bounded sample. The outer cells end at the least and largest component of all vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dim)
                columns = [np.arange(dim, dtype=np.int32), x.min(0).astype(np.int64), x.max(0).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "low", "high"])

    ends = classes.select("ints").mapInArrow(run, "at int, low long, high long").groupBy("at")
    ends = ends.agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()  # a row per component
    low, high = np.array([r["low"] for r in ends]), np.array([r["high"] for r in ends])
    rows = classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("ints").collect()
    sample = np.frombuffer(b"".join(bytes(r["ints"]) for r in rows), "<i4").reshape(-1, dim)
    edges = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="nearest").T.astype(np.int64)  # dim x (cells - 1)
    # A value v is in the cell numbered by the cuts at or below it.
    least = np.concatenate([np.minimum(low[:, None], edges[:, :1] - 1), edges], axis=1)
    most = np.concatenate([edges - 1, np.maximum(high[:, None], edges[:, -1:])], axis=1)
    return edges, least, np.maximum(most, least)


def _codes(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1).astype(np.uint8)


def _write(dim: int, edges: np.ndarray, block: int):
    """Vectors as rows of blocks: a number of the block, the vectors' numbers, cells and exact components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def flush() -> pa.RecordBatch:
            cids, x = np.concatenate([c for c, _ in kept]), np.concatenate([x for _, x in kept])
            arrays = [pa.array([int(cids[0])]), *(pa.array([a.tobytes()], pa.binary()) for a in (cids, _codes(x, edges), x))]
            return pa.RecordBatch.from_arrays(arrays, names=["first", "cids", "codes", "exact"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                kept.append((part.column(0).to_numpy(), _matrix(part.column(1), dim)))
                held += part.num_rows
                if held >= block:
                    yield flush()
                    kept, held = [], 0
        if held:
            yield flush()

    return run


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, the least one if there are fewer."""
    k = min(k, x.shape[1])
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def _scan(dim: int, least: np.ndarray, most: np.ndarray, k: int):
    """``q, cid, score``: the ``k`` best vectors of a block for each query of a block, and ties.

    Twice the score lies within ``|q| . (most - least)`` of ``q . (least + most)``. All are whole numbers, in single precision
    where it is exact, else in double precision, with room for its rounding.
    """
    middle, width = least + most, most - least
    at = np.arange(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cids = np.frombuffer(batch.column(0)[row].as_py(), "<i8")
                codes = np.frombuffer(batch.column(1)[row].as_py(), np.uint8).reshape(-1, dim)
                exact = np.frombuffer(batch.column(2)[row].as_py(), "<i4").reshape(-1, dim)
                numbers = np.frombuffer(batch.column(3)[row].as_py(), "<i8")
                q = np.frombuffer(batch.column(4)[row].as_py(), "<i4").reshape(-1, dim)
                m, w = middle[at, codes], width[at, codes]
                reach = float(np.abs(q).max(initial=0)) * (float(np.abs(m).max()) + float(w.max())) * dim
                kind = np.float32 if reach < 1 << 23 else np.float64
                room = 0 if reach < 1 << 52 else reach * 2.0**-40
                m, w = m.astype(kind).T.copy(), w.astype(kind).T.copy()
                found = [(numbers[:0], cids[:0], cids[:0])]
                for first in range(0, len(q), ROWS):
                    part = q[first : first + ROWS].astype(kind)
                    centre, spread = part @ m, np.abs(part) @ w
                    low, high = centre - spread - room, centre + spread + room
                    i, j = np.nonzero(high >= _kth(low, k)[:, None])
                    i, j, score = _certain(q[first : first + ROWS], exact, i, j, high[i, j], k)
                    found.append((numbers[first + i], cids[j], score))
                columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "cid", "score"])

    return run


def _scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), BLOCK):
        part = slice(lo, lo + BLOCK)
        out[part] = np.einsum("ij,ij->i", q[i[part]].astype(np.int64), x[j[part]].astype(np.int64))
    return out


def _certain(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the candidates ``i, j`` the ``k`` best of each query ``i`` and ties, with their scores.

    Exact vectors are read in the order of the bounds ``high`` of twice the score: ``2 * k`` a query, then what the ``k``-th of
    these scores does not rule out.
    """
    order = np.lexsort((-high, i))
    i, j, high = i[order], j[order], high[order]
    early = np.arange(len(i)) - np.searchsorted(i, i) < 2 * k
    score = np.full(len(i), np.iinfo(np.int64).min)
    score[early] = _scores(q, x, i[early], j[early])
    # A query with fewer than ``k`` candidates, or early ones, keeps all.
    limit = _limits(i[early], score[early], len(q), k)
    late = ~early & (high >= 2.0 * limit[i])
    score[late] = _scores(q, x, i[late], j[late])
    read = early | late
    i, j, score = i[read], j[read], score[read]
    best = score >= _limits(i, score, len(q), k)[i]
    return i[best], j[best], score[best]


def _limits(i: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """The ``k``-th largest score of each of ``n`` queries, the least number if there are fewer."""
    order = np.lexsort((-score, i))
    at = i[order]
    kth = np.arange(len(at)) - np.searchsorted(at, at) == k - 1
    out = np.full(n, np.iinfo(np.int64).min)
    out[at[kth]] = score[order][kth]
    return out


def _best(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1; tasks drop what is beyond before rows are moved."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__k") <= k)


def _pairs(file: DataFrame, listed: DataFrame, slices: int, parts: int) -> DataFrame:
    """``cids, codes, exact, numbers, x``: each of the ``slices`` blocks of the file beside each of the ``parts`` blocks of queries.

    Both sides are spelled out, so that the keys of the join are as many as the pairs and no key has many of them. The
    optimizer takes a side for as large as before it was spelled out, and would broadcast the copies through the driver:
    both are dealt out by the key, once, and merged where they are.
    """
    tasks = max(1, min(parts * slices, 20 * shuffle_partitions(file.sparkSession)))
    salt = F.pmod(F.xxhash64("first"), F.lit(slices)).cast("int").alias("salt")
    places = file.select("cids", "codes", "exact", salt, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    copies = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    places, copies = (side.repartition(tasks, "part", "salt") for side in (places, copies))
    return places.hint("merge").join(copies.hint("merge"), ["part", "salt"]).select("cids", "codes", "exact", "numbers", "x")


def _search(classes: DataFrame, queries: DataFrame, dim: int, k: int, cells: int, block: int) -> DataFrame:
    """``q, cid, score`` that hold the ``k`` best classes of each query ``q``, a class too, and ties.

    ``classes`` are ``cid, ints`` and ``queries`` are ``q, ints``, both written before.
    """
    spark = classes.sparkSession
    edges, least, most = cuts(classes, dim, cells)
    file = classes.select("cid", "ints").mapInArrow(_write(dim, edges, block), "first long, cids binary, codes binary, exact binary")
    file = materialised(file)
    parts, slices = -(-queries.count() // QUERIES), file.count()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, x = np.array([i["q"] for i in items], "<i8"), b"".join(i["ints"] for i in items)
                yield pa.RecordBatch.from_pydict({"part": [number], "numbers": [ids.tobytes()], "x": [x]}, schema=_GATHERED)

    dealt = queries.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int"))
    listed = dealt.groupBy("part").agg(F.collect_list(F.struct("q", "ints")).alias("items"))  # about ``QUERIES`` each
    listed = materialised(listed.mapInArrow(gather, "part int, numbers binary, x binary"))
    # The best of all blocks are among the best of each.
    return _pairs(file, listed, slices, parts).mapInArrow(_scan(dim, least, most, k), "q long, cid long, score long")


_GATHERED = pa.schema([("part", pa.int32()), ("numbers", pa.binary()), ("x", pa.binary())])


def top_k(
    vectors: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    factor: int = 256,
    cells: int = CELLS,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the highest inner product for each query.

    Components are ``floor(factor * x)`` in double precision. The rows for which ``queries`` holds are
    queries, all rows but the query's own are candidates, ties go to the smaller key, a missing key
    coming last. Each row counts: equal vectors are searched once and listed as often as they occur, and
    repeated queries have repeated results. Vectors of different lengths are not compared. Left out, as
    query and as candidate: what :func:`whole` leaves out. Other columns are ignored; an empty table
    or one without queries gives no rows.
    """
    marked = vectors.select(F.col(key).alias("__key"), F.col(vector).alias("__vector"), F.coalesce(queries, F.lit(False)).alias("__query"))
    rows = materialised(whole(marked, "__key", "__vector", factor))
    asked = materialised(whole(marked.where("__query"), "__key", "__vector", factor))
    # The query's own row may be among the best, so that one more is needed; more of equal vectors are not.
    want = k + 1
    named = rows.groupBy("dim", "ints", "id").agg(F.count(F.lit(1)).alias("copies"))
    listed = F.struct(F.col("id").isNull().alias("none"), "id", F.least("copies", F.lit(want)).cast("int").alias("copies"))
    order = Window.partitionBy("dim", "ints").orderBy(F.asc_nulls_last("id"))
    held = named.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= want)
    held = held.groupBy("dim", "ints").agg(F.array_sort(F.collect_list(listed)).alias("ids"))
    spread = F.flatten(F.transform("ids", lambda x: F.array_repeat(x["id"], x["copies"])))
    classes = materialised(held.select("dim", "ints", F.slice(spread, 1, want).alias("ids"), F.monotonically_increasing_id().alias("cid")))
    asked = materialised(lookup(asked, classes.select("dim", "ints", "cid"), ["dim", "ints"]).select("id", "dim", "cid"))
    found = None
    for (dim,) in asked.select("dim").distinct().orderBy("dim").collect():
        here = materialised(classes.where(F.col("dim") == dim).select("cid", "ints"))
        wanted = materialised(here.join(asked.where(F.col("dim") == dim).select("cid").distinct(), "cid", "left_semi").withColumnRenamed("cid", "q"))
        part = _search(here, wanted, dim, want, cells, block)
        found = part if found is None else found.unionAll(part)
    schema = "query_id long, rank int, vec_id long, score long"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    found = materialised(found)
    best = materialised(_best(found, "q", [F.desc("score"), F.asc("cid")], want).drop("__k"))
    # Classes that tie with the last of them may hold smaller keys.
    last = best.groupBy("q").agg(F.min("score").alias("least"))
    tied = materialised(found.join(last, "q").where("score >= least").drop("least"))
    rows_of = materialised(lookup(tied, classes.select("cid", "ids"), ["cid"]).select("q", "cid", "score", F.posexplode("ids").alias("copy", "vec_id")))
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("cid"), F.asc("copy")]
    best = _best(rows_of, "q", order, want)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(F.col("__k").alias("k"), "cid", "vec_id", "score"))).alias("list"))
    out = lookup(asked, materialised(lists.withColumnRenamed("q", "cid")), ["cid"])
    # One row of the query's own vector and key is the query itself.
    own = F.array_position(F.transform("list", lambda x: (x["cid"] == F.col("cid")) & x["vec_id"].eqNullSafe(F.col("id"))), F.lit(True))
    others = F.filter("list", lambda x, i: i + 1 != F.col("own"))
    out = out.withColumn("own", own).select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
