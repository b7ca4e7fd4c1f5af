"""SimHash near-dedup by a self-join of binary tries.

Two fingerprints within ``budget`` bits agree on at least one of ``budget + 1`` blocks of bits. For
each block there is one trie in which that block comes first, so that equal blocks are equal
subtrees. Pairs of nodes are traversed together, differing bits are added up, and a pair is
dropped as soon as they exceed the budget. Large pairs of subtrees are split into pairs of children
until each fits a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.session import materialised, shuffle_partitions

from .common import components, forest, products, text_of

BITS = 64
#: Pairs of fingerprints that a task looks at, at most, for one pair of nodes.
PAIRS = 1 << 19
#: Shingles hashed at a time.
STEP = 1 << 16
#: Bits by which all nodes descend in a step inside a task.
STRIDE = 4


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """Bit ``i`` is set where more than half of the hashes of the shingles have it set."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(gaps) + 2 - words)
    starts = np.concatenate([[0], gaps[: n - 1] + 1])
    ends = np.concatenate([gaps[words - 1 :], [len(joined)]])
    hash_ = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, STEP):
        spans = zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist())
        hashes = np.array([hash_(joined[a:b], seed) for a, b in spans], np.uint64).view(np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``key, fingerprint`` (a signed long) of each whole text.

    A-Z are lower-cased; a text with fewer than ``words`` words is one shingle; one without words,
    or a missing one, has the fingerprint zero.
    """
    schema = T.StructType([docs.schema[key], T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=[key, "fingerprint"]
            )

    return docs.select(key, text_of(text).cast("binary")).mapInArrow(run, schema)


def blocks(budget: int, bits: int = BITS) -> list[tuple[int, int]]:
    """First bit and number of bits of each of the ``budget + 1`` blocks."""
    cuts = [bits * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _turned(value: Column, first: int, bits: int = BITS) -> Column:
    """Of the highest ``bits`` bits those from ``first`` on brought to the front; the others stay."""
    if first == 0:
        return value
    if bits == BITS:
        return F.shiftleft(value, first).bitwiseOR(F.shiftrightunsigned(value, BITS - first))
    low = F.lit((1 << (BITS - bits)) - 1)
    head = F.shiftrightunsigned(value, BITS - bits)
    head = F.shiftleft(head, first).bitwiseOR(F.shiftrightunsigned(head, bits - first)).bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftleft(head, BITS - bits).bitwiseOR(value.bitwiseAND(low))


def _prefix(value: Column, depth: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, (BITS - depth).cast("int"))


_TASK = ["trie", "depth", "left", "right", "diff", "l", "r"]


def node_pairs(entries: DataFrame, budget: int, pairs: int = PAIRS, bits: int = BITS) -> DataFrame:
    """Pairs of trie nodes ``trie, depth, left, right, diff, slices, l, r, task`` that tasks can take.

    It begins with each first block paired with itself and splits the pairs with more than
    ``pairs`` candidates, level by level, into the pairs of their children that stay within the
    budget. ``entries`` are ``trie, turned``; the first ``bits`` bits count as differences. Nodes that
    agree on all bits are cut into ``slices`` by a hash of the id, and ``l`` of one meets ``r`` of the other.
    """
    side = F.ceil(F.greatest("n_left", "n_right") / F.lit(max(1, int(pairs**0.5)))).cast("int")
    widths = [w for _, w in blocks(budget, bits)]
    starts = F.element_at(F.array(*[F.lit(w) for w in widths]), F.pmod("trie", F.lit(budget + 1)) + 1)
    at = entries.withColumn("depth", starts)
    nodes = materialised(
        at.groupBy("trie", "depth", _prefix(F.col("turned"), F.col("depth")).alias("node")).agg(F.count("*").alias("n"))
    )
    done = None
    todo = nodes.where("n > 1").select(
        "trie", "depth", F.col("node").alias("left"), F.col("node").alias("right"), F.lit(0).alias("diff"),
        F.col("n").alias("n_left"), F.col("n").alias("n_right"),
    )
    while True:
        todo = materialised(todo)
        small = (F.col("n_left") * F.col("n_right") <= pairs) | (F.col("depth") == BITS)
        fits = todo.where(small).withColumn("slices", F.when(F.col("n_left") * F.col("n_right") <= pairs, 1).otherwise(side))
        every = F.sequence(F.lit(0), F.col("slices") - 1)
        fits = fits.withColumn("l", F.explode(every)).withColumn("r", F.explode(every)).where("left <> right or l <= r")
        fits = fits.drop("n_left", "n_right")
        done = fits if done is None else done.unionAll(fits)
        large = todo.where(~small)
        if large.isEmpty():
            return done.withColumn("task", F.xxhash64(*_TASK))
        # Only what lies below large nodes is counted one level further down.
        tops = large.select("trie", "depth", F.explode(F.array("left", "right")).alias("node")).distinct()
        depth = large.agg(F.max("depth")).first()[0]  # all starts lie within a bit of each other
        counts = None
        for d in range(depth - 1, depth + 1):
            here = tops.where(F.col("depth") == d).select("trie", "node")
            inside = entries.withColumn("node", _prefix(F.col("turned"), F.lit(d))).join(here, ["trie", "node"], "left_semi")
            part = inside.groupBy("trie", _prefix(F.col("turned"), F.lit(d + 1)).alias("node")).agg(F.count("*").alias("n"))
            part = part.withColumn("depth", F.lit(d + 1))
            counts = part if counts is None else counts.unionAll(part)
        counts = materialised(counts)
        child = large.select(
            "trie", (F.col("depth") + 1).alias("depth"), "diff", "left", "right", F.explode(F.expr("sequence(0, 3)")).alias("c")
        ).select(
            "trie", "depth",
            F.expr("shiftleft(left, 1) | shiftright(c, 1)").alias("left"), F.expr("shiftleft(right, 1) | (c & 1)").alias("right"),
            F.expr(f"diff + int(depth <= {bits} and shiftright(c, 1) <> (c & 1))").alias("diff"),
            F.expr("left = right and c = 2").alias("again"),  # the mirror image of c = 1
        ).where((F.col("diff") <= budget) & ~F.col("again")).drop("again")
        left = counts.select("trie", "depth", F.col("node").alias("left"), F.col("n").alias("n_left"))
        right = counts.select("trie", "depth", F.col("node").alias("right"), F.col("n").alias("n_right"))
        todo = child.join(left, ["trie", "depth", "left"]).join(right, ["trie", "depth", "right"])
        todo = todo.where("left <> right or n_left > 1")


def traverse(
    values: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, budget: int, bits: int = BITS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within ``budget`` of the first ``bits`` bits, for many pairs of subtrees at once.

    ``values`` are sorted within ``group`` (numbered from 0, without gaps); ``left`` and ``right`` are
    the groups to compare, a group with itself meaning each pair inside it once.
    """
    n = len(values)
    counted = values & np.uint64(((1 << bits) - 1) << (BITS - bits))
    changed = np.r_[True, group[1:] != group[:-1]]
    start = np.flatnonzero(changed)
    stop = np.append(start[1:], n)
    for depth in range(STRIDE, BITS + 1, STRIDE):
        single = (stop[left] - start[left] == 1) & (stop[right] - start[right] == 1)
        i, j = start[left[single]], start[right[single]]
        near = (np.bitwise_count(counted[i] ^ counted[j]) <= budget) & (i != j)
        yield i[near], j[near]
        left, right = left[~single], right[~single]
        if not len(left):
            return
        shift = np.uint64(BITS - depth)
        prefix, seen = values >> shift, counted >> shift
        changed = changed.copy()
        changed[1:] |= prefix[1:] != prefix[:-1]
        node, start_ = np.cumsum(changed) - 1, np.flatnonzero(changed)
        a0, b0 = node[start[left]], node[start[right]]
        down_l, down_r = products(a0, node[stop[left] - 1] + 1 - a0, b0, node[stop[right] - 1] + 1 - b0, left == right)
        keep = np.bitwise_count(seen[start_[down_l]] ^ seen[start_[down_r]]) <= budget
        left, right = down_l[keep], down_r[keep]
        start, stop = start_, np.append(start_[1:], n)
    # What is left agrees on all bits inside each node; long lists of equal values go piece by piece.
    work = np.cumsum((stop[left] - start[left]) * (stop[right] - start[right])) // PAIRS
    for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(work)) + 1):
        u, v = left[part], right[part]
        i, j = products(start[u], stop[u] - start[u], start[v], stop[v] - start[v], u == v)
        yield i[i != j], j[i != j]


def _verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, label: np.ndarray, similarity: float) -> np.ndarray:
    """``label`` after linking those of the pairs whose sets have the similarity; linked ones are not compared again."""
    root = label.tolist()

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for x, y in zip(i.tolist(), j.tolist()):
        p, q = top(x), top(y)
        if p == q:
            continue
        a, b = sets[x], sets[y]
        if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
            continue
        both = len(np.intersect1d(a, b, assume_unique=True))
        if both >= similarity * (len(a) + len(b) - both) - 1e-9:
            root[max(p, q)] = min(p, q)
    return np.array([top(k) for k in range(len(root))], label.dtype)


def _links(budget: int, bits: int):
    """Links that connect what is connected, at most one per entry of each task."""

    def solve(rows: list[tuple[pa.StructArray, int]]) -> pa.RecordBatch:
        items = pa.concat_arrays([r for r, _ in rows])
        task = np.repeat([k for _, k in rows], [len(r) for r, _ in rows])
        side, values = items.field("side").to_numpy(), items.field("turned").to_numpy().view(np.uint64)
        order = np.lexsort((values, side, task))
        key = (task * 2 + side)[order]
        kinds, group = np.unique(key, return_inverse=True)
        left = np.flatnonzero(kinds % 2 == 0)
        right = left + np.isin(kinds[left] + 1, kinds)
        ids = items.field("id").to_numpy()[order]
        label = np.arange(len(ids))
        for i, j in traverse(values[order], group, left, right, budget, bits):
            i, j = (x[label[i] != label[j]] for x in (i, j))
            if len(i):
                label = forest(len(ids), label[i], label[j])[label]
        inner = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(ids[inner]), pa.array(ids[label[inner]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, work = [], 0
            for k, row in enumerate(batch.column(0)):
                side = row.values.field("side").to_numpy()
                rows.append((row.values, k))
                ones = int(side.sum())
                work += (len(side) - ones) * (ones or len(side))
                if work > 2 * PAIRS or k + 1 == batch.num_rows:
                    yield solve(rows)
                    rows, work = [], 0

    return run


def _tasks(entries: DataFrame, budget: int, pairs: int, bits: int = BITS) -> DataFrame | None:
    """``items``: for each task its entries ``task, trie, side, turned, id, code``; of ``entries`` ``trie, turned, id, code``."""
    tasks = materialised(node_pairs(entries.select("trie", "turned"), budget, pairs, bits))
    two = (F.col("left") != F.col("right")) | (F.col("l") != F.col("r"))
    one_side = F.struct(F.col("left").alias("node"), F.col("l").alias("slice"), F.lit(0).alias("side"))
    other = F.struct(F.col("right").alias("node"), F.col("r").alias("slice"), F.when(two, 1).alias("side"))
    sides = tasks.select("task", "trie", "depth", "slices", F.explode(F.array(one_side, other)).alias("s"))
    sides = sides.select("task", "trie", "depth", "slices", "s.*").where("side is not null")
    items = None
    for (depth,) in tasks.select("depth").distinct().orderBy("depth").collect():
        here = sides.where(F.col("depth") == depth).select("task", "trie", "node", "side", "slices", "slice")
        part = entries.withColumn("node", _prefix(F.col("turned"), F.lit(depth))).join(here, ["trie", "node"])
        part = part.where(F.pmod(F.xxhash64("id"), F.col("slices")) == F.col("slice"))
        part = part.select("task", F.struct("task", "trie", "side", "turned", "id", "code").alias("item"))
        items = part if items is None else items.unionAll(part)
    if items is None:
        return None
    # A task holds about 2 * ``pairs`` ** 0.5 entries, or ``pairs`` + 1 against one, by the way in which they were split.
    return items.groupBy("task").agg(F.collect_list("item").alias("items")).select("items")


def _no_links(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")


def _linked(entries: DataFrame, budget: int, pairs: int) -> DataFrame:
    """``a, b``: links between the ids of ``entries``: ``trie, turned, id, code``, written before."""
    tasks = _tasks(entries, budget, pairs)
    return _no_links(entries) if tasks is None else tasks.mapInArrow(_links(budget, BITS), "a long, b long")


def links(prints: DataFrame, budget: int = 4, pairs: int = PAIRS) -> DataFrame:
    """``a, b``: links that join exactly the fingerprints connected by steps of ``budget`` bits.

    ``prints`` holds distinct values of ``fingerprint``. Dense groups are not spelled out as pairs:
    each task returns one link for each fingerprint that it connects.
    """
    value = F.col("fingerprint")
    tries = F.array(*[F.struct(F.lit(k).alias("trie"), _turned(value, a).alias("turned")) for k, (a, _) in enumerate(blocks(budget))])
    entries = prints.select("fingerprint", F.explode(tries).alias("e"))
    entries = entries.select("e.trie", "e.turned", value.alias("id"), F.array(value).alias("code"))
    return _linked(materialised(entries), budget, pairs)


def _classes(prints: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """``id, component_id``: for each of ``prints`` (``id``, ``least`` key) the least key reachable."""
    found = components(materialised(linked)).withColumnRenamed("node", "id")
    classes = materialised(prints.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    least = materialised(classes.groupBy("component").agg(F.min("least").alias("component_id")))
    return materialised(classes.join(least, "component").select("id", "component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 4, words: int = 4) -> DataFrame:
    """``key, fingerprint, component_id`` of each row: hexadecimal digits, and the smallest key reachable.

    Fingerprints are linked at ``budget`` or fewer differing bits. Rows are kept one by one, and
    repeated rows share a class; a missing key is never the smallest; an empty table gives an
    empty one. Other columns are left out.
    """
    prints = materialised(fingerprints(docs, key, text, words))
    distinct = materialised(prints.groupBy("fingerprint").agg(F.min(key).alias("least")))
    named = _classes(distinct.withColumnRenamed("fingerprint", "id"), links(distinct, budget), key)
    return prints.join(named.withColumnRenamed("id", "fingerprint"), "fingerprint").select(
        key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: For a given similarity of shingle sets: longs of a code, and of one of fewer than ``FEW`` shingles, whose bits vary
#: more; longs that entries carry.
LONGS, FEW_LONGS, FEW, CARRIED = 8, 16, 64, 4
#: Pairs whose codes look less similar than asked for by this much are not compared.
MARGIN = 0.25
#: A trie stands for the texts that agree on its first bits, this many at least; more bits once nodes would hold more texts than
#: ``NODE`` on average. There are as many tries as leave out no more than the share ``MISSED`` of pairs at just the similarity.
LEAST_BITS, NODE, MISSED = 12, 1_024, 0.001
#: The share of a limit on all carried bits by which the first half of them may differ: at 0.8 five standard deviations
#: above what small sets do.
ROUGH = 0.75
#: Texts and bytes of a class of candidates that one task compares.
CLASS, CLASS_BYTES = 1_024, 1 << 24
#: Bytes of entries that a task takes.
TAKEN = 1 << 23


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The hashes of the distinct shingles, sorted; none of a text without words."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(gaps) + 2 - words)
    starts = np.concatenate([[0], gaps[: n - 1] + 1]).tolist()
    ends = np.concatenate([gaps[words - 1 :], [len(joined)]]).tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(starts, ends)), np.uint64, n))


def code(text: bytes, words: int) -> np.ndarray:
    """A long fingerprint of the set of shingles: bits from ``LONGS`` or more independent hashes of each."""
    first = shingle_set(text, words)
    longs = FEW_LONGS if len(first) < FEW else LONGS
    if not len(first):
        return np.zeros(longs, np.uint64)
    out = np.empty(longs, np.uint64)
    for k in range(longs):
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(first), STEP):
            # The usual finishing steps of a 64-bit hash, from another start for each long.
            z = first[at : at + STEP] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            ones += np.unpackbits(z.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(first), bitorder="little").view(np.uint64)[0]
    return out


def difference_of(similarity: float) -> float:
    """The share of bits in which the codes of two sets with this Jaccard similarity differ on average."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _coded(docs: DataFrame, key: Column, text: str, words: int) -> DataFrame:
    """``docs`` with ``__key``, ``__row``, a number of its own for each row, and ``__code``, written."""
    keyed = docs.select("*", key.alias("__key"), F.monotonically_increasing_id().alias("__row"), text_of(text).cast("binary").alias("__text"))
    kept = [f for f in keyed.schema.fields if f.name != "__text"]
    schema = T.StructType([*kept, T.StructField("__code", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, texts = batch.columns
            yield pa.RecordBatch.from_arrays([*columns, _lists([code(x.as_py(), words) for x in texts])], names=schema.names)

    return materialised(keyed.mapInArrow(run, schema))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in arrays)])))


def shape(n: int, similarity: float) -> tuple[int, int]:
    """Bits of a node and number of tries for ``n`` codes.

    Nodes keep their size while the table grows; the number of tries grows with a small power of ``n`` (0.24 at 0.8).
    """
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(1, n) / NODE))))
    agree = (1 - difference_of(similarity)) ** bits
    return bits, 1 if agree >= 1 else int(np.ceil(np.log(MISSED) / np.log1p(-agree)))


def places(bits: int, tries: int, of: int = LONGS * BITS) -> np.ndarray:
    """For each trie the bits of a code that come first in it: no bit in two tries until all are used up."""
    lap = np.arange(tries) // (of // bits)
    at = (np.arange(tries) % (of // bits))[:, None] * bits + np.arange(bits)
    step = np.array([pow(5, int(k), of) for k in lap])  # odd, so that no place comes twice in a lap
    return (at * step[:, None] + lap[:, None]) % of


def _matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Codes as rows of longs, filled with zeros, and which of them are long ones."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), FEW_LONGS), np.uint64)
    out[np.arange(FEW_LONGS) < sizes[:, None]] = lists.flatten().to_numpy().view(np.uint64)
    return out, sizes > LONGS


def _nodes(codes: np.ndarray, few: np.ndarray, bits: int, tries: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and node of each entry: the trie, then its first bits. Long codes have as many tries again in their second half."""
    at, powers = places(bits, tries), np.int64(1) << np.arange(bits, dtype=np.int64)
    rows, nodes = [], []
    for half, who in enumerate((np.arange(len(codes)), np.flatnonzero(few))):
        longs = np.ascontiguousarray(codes[who, half * LONGS : (half + 1) * LONGS])
        ones = np.unpackbits(longs.view(np.uint8), axis=1, bitorder="little")
        for k in range(tries):
            rows.append(who)
            nodes.append(((half * tries + k) << bits) + ones[:, at[k]] @ powers)
    return np.concatenate(rows), np.concatenate(nodes)


def _entry_type(longs: int) -> np.dtype:
    """An entry: its node, the slices ``l`` and ``r`` that meet and the entry's side, its id and code."""
    return np.dtype([("node", "<i8"), ("meet", "<i8"), ("id", "<i8"), ("code", "<u8", (longs,))])


def _crowded(codes: DataFrame, bits: int, tries: int, most: int) -> dict[int, int]:
    """Nodes of more than ``most`` entries, and into how many slices they are cut.

    Nodes hold ``NODE`` at most on average, so that these are few unless codes are very uneven.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = np.unique(_nodes(*_matrix(batch.column(0)), bits, tries)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n)], names=["node", "n"])

    counts = codes.select("code").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    return {r["node"]: -(-r["n"] // most) for r in counts.where(F.col("n") > most).collect()}


def _groups(codes: DataFrame, n: int, similarity: float, most: int, longs: int) -> DataFrame:
    """``part, data``: entries of ``codes`` ``id, code`` in bunches; what shares a node is in one partition.

    An entry is in one group of its node; in nodes of more than ``most`` entries it is in one for each slice that its own meets.
    """
    bits, tries = shape(n, similarity)
    crowded = _crowded(codes, bits, tries, most)
    hot, cuts = np.array(sorted(crowded), np.int64), np.array([crowded[k] for k in sorted(crowded)], np.int64)
    kind = _entry_type(longs)
    tasks = max(1, -(-n * tries * kind.itemsize // TAKEN), min(n, shuffle_partitions(codes.sparkSession)))
    parts = 8 * tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (values, few) = batch.column(0).to_numpy(), _matrix(batch.column(1))
            row, node = _nodes(values, few, bits, tries)
            meet = np.zeros(len(row), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, node), len(hot) - 1)
                slices = np.where(hot[at] == node, cuts[at], 1)
                again = np.repeat(np.arange(len(row)), slices)
                other = np.arange(len(again)) - np.repeat(np.cumsum(slices) - slices, slices)
                row, node = row[again], node[again]
                mine = _mixed(ids)[row] % slices[again]
                l, r = np.minimum(mine, other), np.maximum(mine, other)
                meet = l << 32 | r << 1 | (mine > other)
            part = _mixed(node * 0x2545F491 + (meet >> 1)) % parts
            order = np.lexsort((meet, node, part))
            out = np.empty(len(row), kind)
            row = row[order]
            out["node"], out["meet"], out["id"], out["code"] = node[order], meet[order], ids[row], values[row, :longs]
            part = part[order]
            start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
            data = [out[a:b].tobytes() for a, b in zip(start, [*start[1:], len(out)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[start]), pa.array(data, pa.binary())], names=["part", "data"])

    return codes.select("id", "code").mapInArrow(run, "part long, data binary").repartition(tasks, "part").select("data")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 31 bits that look random."""
    z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (z >> np.uint64(33)).astype(np.int64)


def _met(batches: Iterator[pa.RecordBatch], longs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a task in order of their groups, where each group begins, and how many of it are of the first side."""
    data = [x for batch in batches for x in batch.column(0).to_pylist()]
    entries = np.frombuffer(b"".join(data), _entry_type(longs))
    entries = entries[np.lexsort((entries["meet"], entries["node"]))]
    group, side = entries["meet"] >> 1, entries["meet"] & 1
    new = np.r_[True, (entries["node"][1:] != entries["node"][:-1]) | (group[1:] != group[:-1])] if len(entries) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    first = np.add.reduceat(1 - side, start) if len(start) else start
    return entries, start, first


def _near(codes: np.ndarray, a0: int, a: int, b0: int, b: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of two ranges, or within one if they are the same, whose codes differ by ``limit`` or less."""
    step = max(1, PAIRS // 2 // max(1, b))
    two = [np.ascontiguousarray(codes[b0 : b0 + b, k]) for k in range(2)]
    for at in range(a0, a0 + a, step):
        to = min(at + step, a0 + a)
        skip = at - a0 if a0 == b0 else 0  # what lies before is the mirror image
        apart = np.bitwise_count(codes[at:to, 0, None] ^ two[0][skip:])
        apart += np.bitwise_count(codes[at:to, 1, None] ^ two[1][skip:])
        i, j = np.nonzero(apart <= ROUGH * limit)
        yield _close(codes, i + at, j + b0 + skip, limit)


def _close(codes: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    ok = (i < j) & (np.bitwise_count(codes[i, :CARRIED] ^ codes[j, :CARRIED]).sum(1, dtype=int) <= limit)
    return i[ok], j[ok]


def _pairs(entries: np.ndarray, start: np.ndarray, first: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of all groups whose codes differ by ``limit`` or less."""
    codes = np.ascontiguousarray(entries["code"])
    n = np.diff(np.r_[start, len(entries)])
    same = first == n
    b0, b = np.where(same, start, start + first), np.where(same, n, n - first)
    large = first * b > 4_096
    for k in np.flatnonzero(large).tolist():
        yield from _near(codes, start[k], first[k], b0[k], b[k], limit)
    a0, a, b0, b, same = (x[~large] for x in (start, first, b0, b, same))
    work = np.cumsum(a * b) // PAIRS
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(work)) + 1):
        if len(part):
            i, j = products(a0[part], a[part], b0[part], b[part], same[part])
            apart = np.bitwise_count(codes[i, 0] ^ codes[j, 0]) + np.bitwise_count(codes[i, 1] ^ codes[j, 1])
            rough = apart <= ROUGH * limit
            yield _close(codes, i[rough], j[rough], limit)


def _candidates(limit: int):
    """Links that connect what the candidates connect, at most one per text of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, start, first = _met(batches, CARRIED)
        ids, at = np.unique(entries["id"], return_inverse=True)
        label = np.arange(len(ids))
        held, size = [(at[:0], at[:0])], 0
        for i, j in _pairs(entries, start, first, limit):
            i, j = at[i], at[j]
            new = label[i] != label[j]
            held.append((i[new], j[new]))
            size += int(new.sum())
            if size > PAIRS:
                label, held, size = _joined(label, held), [], 0
        if held:
            label = _joined(label, held)
        inner = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[inner]), pa.array(ids[label[inner]])], names=["a", "b"])

    return run


def _joined(label: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    i, j = (label[np.concatenate(x)] for x in zip(*links))
    return forest(len(label), i, j)[label]


def _first_met(codes: np.ndarray, i: np.ndarray, j: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first trie in whose bits two codes agree; as many as there are if none."""
    out = np.empty(len(i), int)
    for lo in range(0, len(i), STEP // 16):
        part = slice(lo, lo + STEP // 16)
        differ = np.ascontiguousarray(codes[i[part], :LONGS] ^ codes[j[part], :LONGS])
        ones = np.unpackbits(differ.view(np.uint8), axis=1, bitorder="little")
        agree = np.stack([~ones[:, a].any(1) for a in at] + [np.ones(len(ones), bool)], axis=1)
        out[part] = agree.argmax(1)
    return out


def _partners(limit: int):
    """``node, meet, id`` of the entries that have a candidate in their group, of full codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, start, first = _met(batches, FEW_LONGS)
        has = np.zeros(len(entries), bool)
        for i, j in _pairs(entries, start, first, limit):
            has[i] = has[j] = True
        found = entries[has]
        yield pa.RecordBatch.from_arrays([pa.array(found[c].copy()) for c in ("node", "meet", "id")], names=["node", "meet", "id"])

    return run


def _compared(words: int, similarity: float, limit: int, bits: int, tries: int):
    """Links of the texts of each row ``node, items`` whose sets have the similarity; each pair in the first trie it meets in."""
    at = places(bits, tries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                node, items = batch.column(0)[k].as_py(), batch.column(1)[k].values
                side, ids = items.field("side").to_numpy(), items.field("id").to_numpy()
                order = np.lexsort((ids, side))
                items, ids, ones = items.take(pa.array(order)), ids[order], int(side.sum())
                entries = np.zeros(len(ids), _entry_type(FEW_LONGS))
                entries["code"] = _matrix(items.field("code"))[0]
                sets = [shingle_set(x.as_py(), words) for x in items.field("text")]
                label = np.arange(len(ids))
                for i, j in _pairs(entries, np.zeros(1, int), np.array([len(ids) - ones]), limit):
                    if node is not None and len(i):
                        own = _first_met(entries["code"], i, j, at) >= min(node >> bits, tries)
                        i, j = i[own], j[own]
                    label = _verified(sets, i, j, label, similarity)
                inner = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[inner]), pa.array(ids[label[inner]])], names=["a", "b"])

    return run


#: Bits of the filter by which rows are left out before their texts are moved, at most.
FILTER = 1 << 23


def _only(rows: DataFrame, n: int, inside: bool = True):
    """For mapInArrow: the rows whose first column is among the ``n`` of ``rows``, and a few others; or else all but these."""
    size = 1 << int(min(FILTER, max(1 << 10, 16 * n))).bit_length() - 1

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(_mixed(batch.column(0).to_numpy()) & (size - 1))
            word, start = np.unique(bit >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), start) if len(start) else start.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    found = rows.mapInArrow(marks, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(max(1, size >> 6), np.uint64)
    words[found.column("word").to_numpy()] = found.column("value").to_numpy().view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _mixed(batch.column(0).to_numpy()) & (size - 1)
            yield batch.filter(pa.array((words[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1) == 1) == inside))

    return run


def _similar_classes(codes: DataFrame, text: str, words: int, similarity: float, pairs: int) -> DataFrame:
    """``code, component_id`` of the table of :func:`_coded`: the smallest ``__key`` of each class, as :func:`similar` tells it."""
    limit = int(BITS * CARRIED * difference_of(max(0.0, similarity - MARGIN)))
    side = max(1, int(pairs**0.5))
    size = F.octet_length(text_of(text).cast("binary"))
    distinct = codes.groupBy(F.col("__code").alias("code")).agg(F.min("__key").alias("least"), F.min(F.struct(F.col("__row").alias("row"), size.alias("size"))).alias("one"))
    distinct = materialised(distinct.select("code", "least", "one.*", F.monotonically_increasing_id().alias("id")))
    n = distinct.count()
    groups = _groups(distinct.select("id", "code"), n, similarity, 4 * side, CARRIED)
    linked = materialised(groups.mapInArrow(_candidates(limit), "a long, b long"))
    # Classes of candidates: a text is moved once, to its class, if that fits a task.
    classes = components(linked).select(F.col("node").alias("id"), F.col("component").alias("class"))
    near = materialised(distinct.select("id", "code", "row", "size").join(classes, "id"))
    total = near.count()
    sizes = near.groupBy("class").agg((F.count(F.lit(1)) <= min(CLASS, side)).alias("few"), (F.sum("size") <= CLASS_BYTES).alias("light"))
    near = materialised(near.join(sizes, "class").select("id", "code", "row", "class", (F.col("few") & F.col("light")).alias("small")))
    whole = codes.select(F.col("__row").alias("row"), text_of(text).cast("binary").alias("text"))
    texts = whole.mapInArrow(_only(near.select("row"), total), "row long, text binary").join(near, "row")
    texts = materialised(texts.select("id", "code", "class", "small", "text"))
    item = F.struct("side", "id", "code", "text")
    few = texts.where("small").withColumn("side", F.lit(0)).groupBy("class").agg(F.collect_list(item).alias("items"))
    few = few.select(F.lit(None).cast("long").alias("node"), "items")
    # Larger classes go through the tries again, among themselves.
    large = materialised(near.where(~F.col("small")).select("id", "code"))
    held = large.count()
    bits, tries = shape(held, similarity)
    if held:
        groups = _groups(large, held, similarity, side, FEW_LONGS)
        met = materialised(groups.mapInArrow(_partners(limit), "node long, meet long, id long"))
        met = met.select("node", F.expr("shiftright(meet, 1)").alias("meet"), F.expr("int(meet & 1)").alias("side"), "id")
        met = met.join(texts.where(~F.col("small")).select("id", "code", "text"), "id")
        few = few.unionByName(met.groupBy("node", "meet").agg(F.collect_list(item).alias("items")).select("node", "items"))
    linked = few.mapInArrow(_compared(words, similarity, limit, bits, tries), "a long, b long")
    classes = _classes(distinct.select("id", "least"), linked, "key")
    return materialised(distinct.join(classes, "id").select("code", "component_id"))


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, pairs: int = 2 * PAIRS) -> DataFrame:
    """``key, component_id``: classes of texts whose sets of shingles have this Jaccard similarity or more.

    One fingerprint of 64 bits cannot tell 0.8 from much less, so codes of ``LONGS`` longs are used.
    There are tries that each begin with other bits of the code; those that share a node at the depth of
    :func:`shape` meet, and are candidates if their codes do not differ much more than expected. Each class that
    candidates connect is brought together and its candidates' sets of hashed shingles are compared, so
    that nothing below the similarity is linked. Rows and keys are treated as by :func:`near_duplicates`.
    """
    codes = _coded(docs.select(key, text), F.col(key), text, words)
    found = _similar_classes(codes, text, words, similarity, pairs)
    return codes.select(key, F.col("__code").alias("code")).join(found, "code").select(key, "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, pairs: int = 2 * PAIRS) -> DataFrame:
    """``docs`` with one row of each class of :func:`similar`, all its columns as they are.

    The row with the smallest key stays, a missing key coming last; among rows that share it, one.
    Rows are told apart by a number that each gets while the table is written, so rows without a key
    are treated like all others, and repeated rows lose their copies. An empty table stays empty.
    """
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"))
    codes = _coded(docs, place, text, words)
    found = _similar_classes(codes, text, words, similarity, pairs)
    named = codes.select("__key", F.col("__code").alias("code")).join(found, "code")
    gone = materialised(named.where(F.col("__key.row") != F.col("component_id.row")).select("__key.row"))
    # Most rows stay, and are seen to stay where they are; only the others, and what looks like them, are moved to be told apart.
    n = gone.count()
    rows, schema = codes.select("__row", *docs.columns), T.StructType([T.StructField("__row", T.LongType()), *docs.schema.fields])
    stay = rows.mapInArrow(_only(gone, n, inside=False), schema)
    doubt = rows.mapInArrow(_only(gone, n), schema).join(gone, F.col("__row") == F.col("row"), "left_anti")
    return stay.unionByName(doubt).select(*docs.columns)
