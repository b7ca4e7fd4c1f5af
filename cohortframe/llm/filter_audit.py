"""Filter interaction audit by decision diagrams.

Every document fails some of the filters; its failures are a mask. Masks are counted per part by
Spark, and the at most ``2 ** k`` counts of a part become a decision diagram: a level for each
filter, two edges from each node (passed, failed), equal subdiagrams shared, and each node weighted
by the documents below it. Two neighbouring levels can be swapped without touching the others, so
walking through all orders costs one swap each; in every order the path on which all filters pass
shows what each step keeps and removes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.session import materialised

#: Filters that an audit of all their orders takes: the orders are the factorial of this.
MOST = 7

Weights = tuple[int, ...]


class Diagram:
    """A count-weighted decision diagram of failure masks.

    ``levels[i]`` lists the nodes of a level as pairs of places on the next level: what passes, and what
    fails. Below the last level stand the distinct weights. ``sums[i]`` are the weights below the
    nodes of a level. ``order`` names the variable of each level by its bit.
    """

    def __init__(self, variables: int, cells: Mapping[int, Weights]):
        self.order = list(range(variables))
        width = len(next(iter(cells.values()), (0,)))
        unique: list[dict] = [{} for _ in range(variables + 1)]

        def node(level: int, inside: dict[int, Weights]) -> int:
            if level == variables:
                key = tuple(map(sum, zip((0,) * width, *inside.values())))
            else:
                failed = {m: w for m, w in inside.items() if m >> level & 1}
                passed = {m: w for m, w in inside.items() if not m >> level & 1}
                key = (node(level + 1, passed), node(level + 1, failed))
            return unique[level].setdefault(key, len(unique[level]))

        node(0, dict(cells))
        self.levels: list[list[tuple[int, int]]] = [list(u) for u in unique[:-1]]
        self.sums: list[list[Weights]] = [[] for _ in range(variables)] + [list(unique[-1])]
        for level in reversed(range(variables)):
            self._weigh(level)

    def _weigh(self, level: int) -> None:
        below = self.sums[level + 1]
        self.sums[level] = [tuple(map(sum, zip(below[p], below[f]))) for p, f in self.levels[level]]

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the next; all other levels stay as they are."""
        lower, unique = self.levels[level + 1], {}
        for k, (p, f) in enumerate(self.levels[level]):
            pairs = ((lower[p][side], lower[f][side]) for side in (0, 1))
            self.levels[level][k] = tuple(unique.setdefault(pair, len(unique)) for pair in pairs)
        self.levels[level + 1] = list(unique)
        self._weigh(level + 1)
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def all_pass(self) -> list[tuple[Weights, Weights]]:
        """What each level keeps and removes on the path on which all filters pass."""
        at, steps = 0, []
        for level, nodes in enumerate(self.levels):
            at, failed = nodes[at]
            steps.append((self.sums[level + 1][at], self.sums[level + 1][failed]))
        return steps


def swaps(n: int) -> Iterator[int]:
    """Places of the neighbours to exchange so that all ``n!`` orders are met once, the present one first."""
    places, heading = list(range(n)), [-1] * n
    while True:
        # The largest item that can step over a smaller neighbour does so; all larger ones turn round.
        movable = [
            k for k, item in enumerate(places)
            if 0 <= k + heading[item] < n and places[k + heading[item]] < item
        ]
        if not movable:
            return
        k = max(movable, key=lambda k: places[k])
        item, to = places[k], k + heading[places[k]]
        places[k], places[to] = places[to], places[k]
        for larger in range(item + 1, n):
            heading[larger] = -heading[larger]
        yield min(k, to)


def audit_cells(variables: int, cells: Mapping[int, Weights]) -> Iterator[tuple[tuple[int, ...], int, Weights]]:
    """``order, step, numbers`` for each order of the filters and each step in it.

    The first of the weights counts documents. Numbers: kept, removed, redundant, failing this
    filter only, the other weights removed, and the filter's removals added up over all orders.
    """
    diagram, paths = Diagram(variables, cells), {}
    paths[tuple(diagram.order)] = diagram.all_pass()
    for level in swaps(variables):
        diagram.swap(level)
        paths[tuple(diagram.order)] = diagram.all_pass()
    first, last, total = [0] * variables, [0] * variables, [0] * variables
    for order, steps in paths.items():
        first[order[0]], last[order[-1]] = steps[0][1][0], steps[-1][1][0]
        for variable, (_, removed) in zip(order, steps):
            total[variable] += removed[0]
    for order, steps in paths.items():
        for step, (variable, (kept, removed)) in enumerate(zip(order, steps), 1):
            # All that fail a filter go if it comes first, and those that fail no other if it comes last.
            numbers = kept[0], removed[0], first[variable] - removed[0], last[variable], *removed[1:], total[variable]
            yield order, step, numbers


def audit(docs: DataFrame, failures: Mapping[str, Column], part: Column, flags: Mapping[str, Column] | None = None) -> DataFrame:
    """Every order of the filters, per part: a row for each step.

    ``failures`` maps the one-letter names of filters to what makes a document fail (missing: it
    passes), ``flags`` maps names of result columns to marks whose removed documents are counted.
    A missing part is the empty string. Returns ``part, filter_order, step, kept, removed, redundant,
    unique_fails``, the flags, and ``shapley``: what the step's filter removes added up over all
    orders. Rows count one by one; an empty table has no parts and gives no rows.
    """
    names, flags = list(failures), flags or {}
    if not 1 <= len(names) <= MOST or any(len(n) != 1 for n in names):
        raise ValueError(f"give 1 to {MOST} filters with names of one letter")
    mask = F.lit(0)
    for bit, fails in enumerate(failures.values()):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    marks = [F.sum(F.when(flag, 1).otherwise(0)) for flag in flags.values()]
    weights = F.array(F.count(F.lit(1)), *marks).alias("weights")
    cells = docs.groupBy(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask")).agg(weights)
    # At most 2 ** MOST rows a part.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "weights")).alias("cells"))
    counts = ["kept", "removed", "redundant", "unique_fails", *flags, "shapley"]
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())])
    for name in counts:
        schema.add(name, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = list(audit_cells(len(names), {c["mask"]: tuple(c["weights"]) for c in row["cells"]}))
                columns = [
                    pa.array([row["part"]] * len(found), pa.string()),
                    pa.array(["".join(names[v] for v in order) for order, _, _ in found], pa.string()),
                    pa.array([step for _, step, _ in found], pa.int32()),
                ]
                columns += [pa.array([numbers[k] for _, _, numbers in found], pa.int64()) for k in range(len(counts))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return parts.mapInArrow(run, schema)


def with_earlier_copy(rows: DataFrame, key: str, digest: str, name: str) -> DataFrame:
    """``rows``, written before, with a mark on those whose content a row with a smaller key has too.

    ``digest`` identifies the content. Rows that share the smallest key are not marked, nor are
    rows without a key. The join is on content and key together, so that a content that
    makes up much of the table is not gathered anywhere.
    """
    keyed = rows.where(F.col(key).isNotNull())
    first = keyed.groupBy(F.col(digest).alias("__digest")).agg(F.min(key).alias("__first"))
    same = (F.col(digest) == F.col("__digest")) & (F.col(key) == F.col("__first"))
    marked = keyed.join(first, same, "left").withColumn(name, F.col("__first").isNull()).drop("__digest", "__first")
    return marked.unionByName(rows.where(F.col(key).isNull()).withColumn(name, F.lit(False)))


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions on a text and its words: too short, repetitive, shouting, marked up."""
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def words_of(text: Column) -> Column:
    """Maximal runs of other characters than the blanks of ASCII, as they stand."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def audit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """:func:`audit` of the filters of :func:`text_failures` and of ``E``, identical to an earlier text.

    Texts are identical if their SHA-256 is. A missing text is empty. ``labels`` give ``quality`` and
    ``toxic`` by ``key``: ``good_lost`` and ``toxic_lost`` count removed documents with a 1. A document is
    marked if any of its labels says so; one without a key or without labels has no marks. A text
    is read once, and only its digest and its failures are moved. Other columns are left out.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).alias("id"), F.col(part).cast("string").alias("part"), content.alias("text"), words_of(content).alias("words"))
    found = text_failures(F.col("text"), F.col("words"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    rows = materialised(read.select("id", "part", digest, *[c.alias(n) for n, c in found.items()]))
    rows = with_earlier_copy(rows, "id", "digest", "E")
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    marks = marks.where("good = 1 or toxic = 1")
    failures = {n: F.col(n) for n in "ABCDE"}
    flags = {"good_lost": F.col("good") == 1, "toxic_lost": F.col("toxic") == 1}
    # Rows without a key have no label: kept apart, they do not meet in one task of the join.
    keyed = rows.where("id is not null").join(marks, "id", "left")
    rest = rows.where("id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    return audit(keyed.unionByName(rest), failures, F.col("part"), flags)
