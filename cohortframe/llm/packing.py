"""Best-fit packing with certified bin counts.

Documents become token sequences that are packed into bins of ``capacity`` tokens. Every
partition packs its pieces by best-fit decreasing and holds the number of bins against a lower
bound from dual-feasible functions. As many of its emptiest bins as are open, and as many with
many small pieces, are exchanged: they are dealt to fewer partitions, which pack them again, until
one partition is left. A partition never sees more than the open bins of ``FAN_IN`` others.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.session import materialised

from .token_counts import MARKS, STEP, spelled, tokenizer

CAPACITY = 4096
#: Pieces a partition packs in the first round, and partitions whose open bins meet in one.
PIECES = 16_384
FAN_IN = 16
#: Chunks a worker keeps.
CACHE_ROWS = 600_000


class TokenIds(dict):
    """Token ids by chunk, for byte-level tokenizers that drop white space; blanks and line feeds part a text."""

    def __init__(self, path: str):
        super().__init__({"": b""})
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model

    def __missing__(self, chunk: str) -> bytes:
        # Lower-casing acts on single letters, and below U+0250 Python agrees on each of them.
        if chunk.isalpha() and max(chunk) < "ɐ" and (word := chunk.lower()).isalpha():
            if word in self:
                ids = self[word]
            else:
                ids = array("I", [x.id for x in self.model.tokenize(spelled(word))]).tobytes()
        elif chunk[-1] in MARKS and chunk[:-1].isalpha() and normalize("NFC", chunk[:-1].lower()).isalpha():
            # Where lower-casing makes a combining mark of a part of a letter, the mark would join it.
            ids = self[chunk[:-1]] + self._whole(chunk[-1])
        else:
            ids = self._whole(chunk)
        if len(self) < CACHE_ROWS:
            self[chunk] = ids
        return ids

    def _whole(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Unsigned 32-bit ids of a whole text, in the machine's order, which is little-endian here."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def _worker_ids(path: str) -> TokenIds:
    return TokenIds(path)


def pieces(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document is its token ids followed by ``end_id``; only documents longer than ``capacity``
    are cut, all pieces but the last being full. A missing or empty text is ``end_id`` alone; a
    missing key stays missing. Rows are taken one by one: repeated rows give repeated pieces.
    Other columns, whatever their names, are left out.
    """
    fields = [docs.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType())]
    fields += [T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    step = 4 * capacity
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_ids(path)
        for batch in batches:
            for first in range(0, batch.num_rows, STEP):
                part = batch.slice(first, STEP)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, data in enumerate(part.column(1).to_pylist()):
                    data = encoder.ids(data or "") + end
                    for n, at in enumerate(range(0, len(data), step)):
                        cut = data[at : at + step]
                        row.append(k)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
                columns = [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(key, F.col(text)).mapInArrow(run, T.StructType(fields))


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that pieces of these sizes need at least, by dual-feasible functions.

    For a threshold ``t`` sizes above ``capacity - t`` count as a whole bin, sizes below ``t`` as
    nothing and the others as they are; with ``t = 0`` this is the total over the capacity.
    Computed for all thresholds at once from the histogram of the sizes.
    """
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    t = np.arange(capacity // 2 + 1)
    below = np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    whole = number[-1] - number[capacity - t]
    return int((whole + -(-(total[capacity - t] - below) // capacity)).max())


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin number of each piece, by best-fit decreasing; ties go in the order given.

    Bins are kept by the room left in them; a bit mask over the rooms in use finds the
    tightest one.
    """
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for k, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, bin_ = capacity, opened
            opened += 1
        bins[k] = bin_
        room -= size
        if room:
            rooms[room].append(bin_)
            mask |= 1 << room
    return bins


def _packed(ids: np.ndarray, sizes: np.ndarray, capacity: int, group: int, last: bool) -> pd.DataFrame:
    bins = best_fit(sizes, capacity)
    used = np.bincount(bins, weights=sizes).astype(np.int64)
    gap = len(used) - lower_bound(sizes, capacity)
    leave = np.zeros(len(used), bool)
    if not last:
        # The emptiest bins go on, as many as are open beyond the bound or by chance of the deal, which
        # is of the order of the root; and as many with the most pieces, which others can fill up with.
        spare = int(len(used) - sizes.sum() / capacity)
        number = min(2 * spare, gap + 2 * int(len(used) ** 0.5)) + 1
        leave[np.argsort(used, kind="stable")[:number]] = True
        if spare:
            leave[np.argsort(-np.bincount(bins), kind="stable")[:number]] = True
    order = np.lexsort((ids, bins))
    b, s = bins[order], sizes[order]
    before = np.cumsum(s) - s
    first = np.r_[True, b[1:] != b[:-1]]
    offset = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(b)]))
    return pd.DataFrame(
        {"row": ids[order], "length": s, "bin": b, "offset": offset, "open": leave[b], "grp": group, "gap": gap}
    )


def _packer(capacity: int, last: bool):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        return _packed(frame["row"].to_numpy(), frame["length"].to_numpy(), capacity, int(key[0]), last)

    return run


_PACKED = "row long, length long, bin long, offset long, open boolean, grp long, gap long"


def assign(rows: DataFrame, capacity: int = CAPACITY, pieces_each: int = PIECES) -> DataFrame:
    """``row, sequence_id, offset`` for the pieces ``row, length`` (``row`` unique, 1..capacity).

    Every partition reports in ``gap`` by how many bins it is above its certified bound. What the deal
    of the pieces costs beyond that is made up for by the exchange, not certified. No rows give
    no rows.
    """
    # Full pieces fill a bin each, numbered by the piece; shared bins get numbers below zero.
    full = rows.where(F.col("length") == capacity).select(
        "row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    todo = rows.where(F.col("length") < capacity).select("row", "length")
    parts = -(-max(1, todo.count()) // pieces_each)
    todo = todo.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(parts)))
    done, number = [full], 0
    while True:
        last = parts == 1

        packed = materialised(todo.groupBy("grp").applyInPandas(_packer(capacity, last), _PACKED))
        shared = -1 - F.expr(f"shiftleft(grp * 64 + {number}, 24) + bin")
        done.append(packed.where("not open").select("row", shared.alias("sequence_id"), "offset"))
        if last:
            break
        parts, number = -(-parts // FAN_IN), number + 1
        todo = packed.where("open").select("row", "length", F.floor(F.col("grp") / FAN_IN).cast("long").alias("grp"))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def pack(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of :func:`pieces` with their place: ``sequence_id`` and ``offset`` in it."""
    cut = pieces(docs, path, key, text, capacity, end_id, with_ids)
    # The number is given while the table is written and read back from it ever after.
    cut = materialised(cut.withColumn("row", F.monotonically_increasing_id()))
    return cut.join(assign(cut, capacity), "row").drop("row")
