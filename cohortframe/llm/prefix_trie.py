"""Conversation prefix trie by hashing blocks of turns.

Conversations are cut into blocks of a few turns. A prefix is named by the sum of hashes of its turns,
each mixed with its place, so names of blocks add up to names of prefixes and a conversation is
never gathered. Conversations are grouped by the names of successive blocks first. Where all that
come from one block go on into one and the same block, its turns are nodes without further
grouping; only where sibling blocks diverge are the boundaries of turns inside them compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.operators.scan import ordered, running, with_position
from cohortframe.session import materialised, shuffle_partitions

from .common import lookup

#: Turns in a block.
BLOCK = 4
#: Bits of each of the three parts of a name: sums of 2 ** 27 of them stay in a long.
PART = 36
#: Ids that are joined to one string before the strings of a node are hashed in order.
IDS = 4_096

_KEY = "struct<depth:bigint,a:bigint,b:bigint,c:bigint>"


def _root() -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(n) for n in ("depth", "a", "b", "c")])


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, pos, digest, points``: turns numbered from 0, named by SHA-256, with the code points of the text.

    By turn, a missing one first; ties go by role, then by digest. Missing roles and texts are empty.
    Rows without a conversation are left out, equal rows are two turns. Texts are not moved, and a
    conversation of any length is numbered in ranges.
    """
    who, said = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    # The length tells where the role ends.
    content = F.concat(F.length(who).cast("string"), F.lit(":"), who, said)
    named = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), who.alias("role"),
        F.unhex(F.sha2(content, 256)).alias("digest"), F.length(said).cast("long").alias("points"),
        F.monotonically_increasing_id().alias("row"),
    )
    numbered = with_position(named, ["conv"], ["turn", "role", "digest", "row"], "pos")
    return numbered.select("conv", (F.col("pos") - 1).alias("pos"), "digest", "points")


def _part(k: int) -> Column:
    """One of three numbers of ``PART`` bits from the place and the digest of a turn."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(k), "pos", "digest"), 64 - PART).alias("abc"[k])


def _plus(x: Column, y: Column) -> Column:
    return F.struct(*[(x[n] + y[n]).alias(n) for n in ("depth", "a", "b", "c")])


def _sum_of(items: Column, name: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + x[name])


def _blocks(turns: DataFrame, size: int) -> DataFrame:
    """``conv, level, parent, cum, points``: a conversation's blocks, the prefix before, and the sums inside up to each turn."""
    items = turns.select("conv", F.floor(F.col("pos") / size).alias("level"), "pos", "points", *map(_part, range(3)))
    one = F.struct("pos", "a", "b", "c", "points")
    listed = items.groupBy("conv", "level").agg(F.array_sort(F.collect_list(one)).alias("items"))  # at most ``size`` each

    def upto(o: Column) -> Column:
        head = F.slice("items", 1, o)
        sums = [_sum_of(head, n).alias(n) for n in "abc"]
        return F.struct(o.cast("long").alias("depth"), *sums)

    listed = listed.select(
        "conv", "level", F.transform(F.sequence(F.lit(1), F.size("items")), upto).alias("cum"), F.col("items.points").alias("points")
    )
    total = F.element_at("cum", -1)
    sums = {f"__{n}": ("sum", total[n]) for n in ("depth", "a", "b", "c")}
    chained = running(ordered(listed, ["conv"], F.col("level")), sums).plain()
    parent = F.struct(*[(F.col(f"__{n}") - total[n]).alias(n) for n in ("depth", "a", "b", "c")])
    return chained.select("conv", "level", parent.alias("parent"), "cum", "points")


def _turn_rows(blocks: DataFrame, *more: str) -> DataFrame:
    """A row for each turn of the distinct blocks: ``key, parent, points``, and other columns of the block."""
    spread = blocks.select("parent", "cum", "alone", *more, F.posexplode(F.arrays_zip("cum", "points")).alias("o", "t"))
    before = F.when(F.col("o") == 0, F.col("parent")).otherwise(_plus(F.col("parent"), F.get("cum", F.col("o") - 1)))
    return spread.select(_plus(F.col("parent"), F.col("t.cum")).alias("key"), before.alias("parent"), F.col("t.points").alias("points"), "alone", "o", *more)


def _nodes(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct blocks, with ``alone`` where a block has no siblings, and ``key, parent, points, n, least`` of all nodes but the root."""
    end = F.element_at("cum", -1)
    distinct = blocks.groupBy("parent", _plus(F.col("parent"), end).alias("key")).agg(
        F.first("cum").alias("cum"), F.first("points").alias("points"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("least")
    )
    distinct = materialised(distinct)
    only = distinct.groupBy("parent").agg(F.count(F.lit(1)).alias("k"), F.min("key").alias("key")).where("k = 1")
    # Joined on the block and not on its parent, which may have any number of blocks.
    distinct = materialised(distinct.join(only.select("key", F.lit(True).alias("alone")), "key", "left").withColumn("alone", F.col("alone").isNotNull()))
    turns = _turn_rows(distinct, "n", "least")
    merged = turns.where("not alone").groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("points").alias("points"), F.sum("n").alias("n"), F.min("least").alias("least")
    )
    return distinct, materialised(turns.where("alone").select(*merged.columns).unionByName(merged))


def _below(blocks: DataFrame, distinct: DataFrame, values: DataFrame, size: int) -> DataFrame:
    """``key, saved, leaves``: what the nodes of each subtree add up to, its top included.

    ``values`` are ``key, least, saved, leaf``. Each node counts in its smallest conversation, which is in all
    subtrees that the node is in. So the sum of a subtree is that of what its conversations
    hold from its depth on: one running total per conversation, and sums by node.
    """
    place = F.col("key.depth") - 1
    owned = values.groupBy(F.col("least").alias("conv"), F.floor(place / size).alias("level")).agg(
        F.collect_list(F.struct((place % size).alias("o"), "saved", "leaf")).alias("own")  # at most ``size``
    )
    held = blocks.join(owned, ["conv", "level"], "left")

    def inside(name: str, o: Column | None = None) -> Column:
        own = F.coalesce("own", F.array().cast("array<struct<o:bigint,saved:bigint,leaf:bigint>>"))
        own = own if o is None else F.filter(own, lambda x: x["o"] >= o)
        return _sum_of(own, name)

    names = {"saved": "saved", "leaves": "leaf"}
    rest = {f"__{n}": ("sum", inside(own)) for n, own in names.items()}
    held = running(ordered(held, ["conv"], F.col("level")), rest, descending=True).plain()
    sums = [
        F.sum(F.col(f"__{n}") - inside(own) + inside(own, F.lit(o))).alias(f"{n}_{o}") for n, own in names.items() for o in range(size)
    ]
    per_block = held.groupBy(_plus(F.col("parent"), F.element_at("cum", -1)).alias("key")).agg(*sums)
    columns = [F.array(*[f"{n}_{o}" for o in range(size)]).alias(n) for n in names]
    turns = _turn_rows(distinct.join(per_block.select("key", *columns), "key"), *names)
    turns = turns.select("key", "alone", *[F.get(n, F.col("o")).alias(n) for n in names])
    merged = turns.where("not alone").groupBy("key").agg(*[F.sum(n).alias(n) for n in names])
    return turns.where("alone").select(*merged.columns).unionByName(merged)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and id: the ids of a node as strings of up to ``IDS``, with the first of each."""
    for batch in batches:
        for at in range(0, batch.num_rows, IDS):
            part = batch.slice(at, IDS)
            depth, a, b, c, conv = (part.column(k).to_numpy() for k in range(5))
            new = np.zeros(len(conv), bool)
            for x in (depth, a, b, c):
                new[1:] |= x[1:] != x[:-1]
            start = np.append(np.flatnonzero(new | (np.arange(len(conv)) == 0)), len(conv))
            written = list(map(str, conv.tolist()))
            ids = [",".join(written[i:j]) for i, j in zip(start, start[1:])]
            first = pa.array(start[:-1])
            columns = [part.column(k).take(first) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.string())], names=["depth", "a", "b", "c", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and first id: the hash of each node's ids. It reads on and keeps nothing but the state of one hash."""
    names, now, state = ["depth", "a", "b", "c", "ends_sha256"], None, None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
        out = []
        for key, ids in zip(keys, batch.column(5).to_pylist()):
            if key == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=_HASHED)
    if now is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, state.hexdigest())))], schema=_HASHED)


_HASHED = pa.schema([*((n, pa.int64()) for n in ("depth", "a", "b", "c")), ("ends_sha256", pa.string())])


def _ends(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the nodes at which conversations end.

    Ids are sorted as a whole, so that a node with any number of them is spread over tasks, and
    written as strings; only these are brought together, in order, and hashed one after the other.
    """
    end = F.max_by(_plus(F.col("parent"), F.element_at("cum", -1)), "level").alias("key")
    ends = members.join(blocks.groupBy("conv").agg(end), "conv", "left").select(F.coalesce("key", _root()).alias("key"), "conv")
    ends = materialised(ends.select("key.*", "conv"))
    n, key = shuffle_partitions(blocks.sparkSession), ["depth", "a", "b", "c"]
    sorted_ = ends.repartitionByRange(n, *key, "conv").sortWithinPartitions(*key, "conv")
    written = sorted_.mapInArrow(_joined_ids, "depth long, a long, b long, c long, first long, ids string")
    together = written.repartition(n, *key).sortWithinPartitions(*key, "first")
    hashed = together.mapInArrow(_hashed, "depth long, a long, b long, c long, ends_sha256 string")
    return hashed.select(F.struct(*key).alias("key"), "ends_sha256")


def trie(turns: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of conversations: one for each distinct sequence of first turns, and the root.

    ``turns`` are ``conv, pos, digest, points`` as of :func:`turns_of`, with ``pos`` from 0 without gaps;
    ``members`` lists each ``conv``, a whole number, once, those without turns too. Returns ``conv_id`` (the
    smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of the
    subtree (each node's members beyond the first times the code points of its last text), and
    ``ends_sha256`` of the members that end here. No members give no nodes.
    """
    blocks, members = materialised(_blocks(turns, block)), materialised(members)
    distinct, nodes = _nodes(blocks)
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialised(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    saved = ((F.col("n") - 1) * F.col("points")).alias("saved")
    values = materialised(nodes.select("key", "least", saved, (F.col("n_children") == 0).cast("long").alias("leaf")))
    below = _below(blocks, distinct, values, block)
    first = F.count(F.when(F.col("key.depth") == 1, 1)).alias("children")
    total = values.agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"), first).first()  # three numbers
    whole = members.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least")).where("n > 0")
    number = lambda x, name: F.lit(x).cast("long").alias(name)
    root = whole.select(
        _root().alias("key"), F.lit(None).cast(_KEY).alias("parent"), "least", "n", number(total["children"], "n_children"),
        number(total["leaves"] or 1, "leaves"), number(total["saved"] or 0, "saved"),
    )
    known = nodes.join(below, "key").select(*root.columns)
    known = materialised(known.unionByName(root).join(_ends(blocks, members), "key", "left"))
    above = known.select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"))
    inner = lookup(known.where(F.col("parent").isNotNull()), above, ["parent"])
    top = known.where(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long"))
    return inner.unionByName(top).select(
        F.col("least").alias("conv_id"), F.col("key.depth").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
        "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """:func:`trie` of the conversations as they stand in ``rows``, a turn a row; other columns are left out."""
    turns = materialised(turns_of(rows, conv, turn, role, text))
    return trie(turns, turns.select("conv").distinct(), block)


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin like the first of their group: ``turns`` rebuilt, with the same columns.

    A conversation ``c`` takes the first ``h`` turns of ``c - c % group``, all if there are fewer and none if
    there is no such conversation, and then its own after its first ``h``; ``h`` is the CRC-32 of its
    number, modulo ``most``. ``turns`` is read more than once: pass a written table.
    """
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    first = turns.where((F.col("pos") < most - 1) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    convs = turns.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), head.alias("head"))
    taken = convs.join(first, "base").where("pos < head").select(*turns.columns)
    # A base has at most ``most`` rows here, and at most ``group`` conversations follow it.
    sizes = convs.join(first.groupBy("base").agg(F.count(F.lit(1)).alias("n")), "base").select("conv", F.least("n", "head").alias("given"))
    own = turns.withColumn("head", head).where("pos >= head")
    own = own.join(sizes, "conv", "left").withColumn("pos", F.col("pos") - F.col("head") + F.coalesce("given", F.lit(0)))
    return taken.unionByName(own.select(*turns.columns))
