"""Line dedup by a suffix array over line ids, in DataFrame operations only.

A document is a sequence of lines, a line ending at a line feed or at a full stop and a blank. Lines
that occur once end all runs and are left out. The others are ranked, and prefix doubling ranks
ever longer blocks of lines: the rank of a block of ``2 ** (k + 1)`` lines comes from the ranks of its
halves, so ranks order the suffixes by their first lines. It ends at the length at which every run
worth deleting has been told apart. Suffixes that share their first lines up to the least number of
words form an interval of the longest common prefix; the first of each interval stays, and the
others lose these lines. A longer repeated run is the union of the shortest blocks that begin and
of those that end at each of its lines, so both kinds are told apart and it goes whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortframe.session import materialised, shuffle_partitions

from .common import text_of

#: Words that a run needs at least to be deleted.
MIN_WORDS = 50
#: Values with more than this part of all rows are looked up apart.
SHARE = 1_000
_MARK = "\u0001"
_BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text, their ends included: joined together they give the text."""
    marked = F.replace(text, F.lit("\n"), F.lit("\n" + _MARK))
    marked = F.replace(marked, F.lit(". "), F.lit(". " + _MARK))
    # The mark itself may occur in a text; then a slower split does the same.
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, r"(?<=\n)|(?<=\.\x20)")).otherwise(F.split(marked, _MARK))


def _repeated(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, pos, rank, words`` of the lines that occur more than once."""
    # Where a line feed ends lines and single blanks alone part words, trimming and counting is cheap.
    odd = reduce(or_, [F.contains(text_of(text), F.lit(x)) for x in ("\t", "\x0b", "\x0c", "\r", "  ")]).alias("odd")
    line = F.when(F.col("odd"), F.trim("line", F.lit(_BLANK))).otherwise(F.trim(F.replace("line", F.lit("\n"), F.lit(""))))
    # Two steps: beside a generator the searches would run over the whole text for each of its lines.
    cut = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), odd, lines_of(text_of(text)).alias("lines"))
    lines = cut.select("doc", "odd", F.posexplode("lines").alias("pos", "line"))
    words = F.when(F.col("odd"), F.size(F.split(line, r"[\x20\x09-\x0D]+")))
    words = words.otherwise(1 + F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))))
    lines = lines.where("line <> ''").select(  # behind the last end there is no line
        "doc",
        "pos",
        F.xxhash64(line).alias("x"),
        F.xxhash64(F.lit(1), line).alias("y"),
        F.when(line == "", 0).otherwise(words).alias("words"),
    )
    return _ranked(materialised(lines), ["x", "y"], ["doc", "pos"]).where("rank is not null")


def _ranked(rows: DataFrame, by: list[str], place: list[str]) -> DataFrame:
    """``rows`` with the ``rank`` of their values ``by`` in place of these; none where they occur once or are missing.

    Ranks keep the order of the values. Values with more than one in ``SHARE`` of all rows, which are fewer than
    ``SHARE``, are broadcast with their ranks, and their rows spread by ``place``.
    """
    one, two = by
    classes = rows.where(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    classes = materialised(classes)
    total = classes.agg(F.sum("n")).first()[0] or 0
    # Partitions are ranges in order, and the number grows with the partition, then with the row.
    ordered = classes.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    ranks = materialised(ordered.withColumn("rank", F.monotonically_increasing_id()))
    hot = F.col("n") * SHARE > total
    frequent = ranks.where(hot).select(F.col(one).alias("__f1"), F.col(two).alias("__f2"), F.col("rank").alias("__hot"))
    others = ranks.where(~hot).select(F.col(one).alias("__o1"), F.col(two).alias("__o2"), "rank")
    found = rows.join(F.broadcast(frequent), (F.col(one) == F.col("__f1")) & (F.col(two) == F.col("__f2")), "left")
    open_ = F.col("__hot").isNull() & F.col(one).isNotNull() & F.col(two).isNotNull()
    found = found.withColumns(
        {"__k1": F.when(open_, F.col(one)).otherwise(F.xxhash64(*place)), "__k2": F.when(open_, F.col(two)).otherwise(0), "__open": open_}
    )
    found = found.drop(one, two, "__f1", "__f2")
    joined = found.join(others, (F.col("__k1") == F.col("__o1")) & (F.col("__k2") == F.col("__o2")), "left")
    rank = F.when(F.col("__open"), F.col("rank")).otherwise(F.col("__hot"))
    return joined.withColumn("rank", rank).drop("__k1", "__k2", "__o1", "__o2", "__open", "__hot")


def _runs(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """Runs of neighbouring repeated lines: ``doc, pos, ranks, blocks``.

    ``pos`` is the place of the first line, ``ranks`` the ranks of all, and ``blocks`` has an ``i, size`` for the
    least lines with enough words, counted in the run. A block begins or ends at each line; one that
    is the least in both directions is there once.
    """
    by = Window.partitionBy("doc")
    lines = _repeated(docs, key, text).withColumn("last", F.lag("pos").over(by.orderBy("pos")))
    lines = lines.where("last is null or last <> pos")  # equal rows count as one
    lines = lines.withColumn("run", F.col("pos") - F.row_number().over(by.orderBy("pos")))
    # A line counts with ``min_words`` at most: that bounds the frame and changes no comparison.
    lines = lines.withColumn("words", F.least("words", F.lit(min_words)).cast("long"))
    run = Window.partitionBy("doc", "run").orderBy("pos")
    lines = lines.withColumn("upto", F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("before", F.col("upto") - F.col("words"))
    whole = Window.partitionBy("doc", "run")
    # Most runs are chance repeats of a few words: they hold no block.
    lines = lines.withColumn("total", F.max("upto").over(whole)).where(F.col("total") >= min_words)
    ahead = whole.orderBy("before").rangeBetween(min_words, 2 * min_words)
    behind = whole.orderBy("upto").rangeBetween(-2 * min_words, -min_words)
    lines = lines.select(
        "doc", "run", "pos", "rank", "before",
        F.coalesce(
            F.min("pos").over(ahead),
            F.when(F.col("total") >= F.col("before") + min_words, F.max("pos").over(whole) + 1),
        ).alias("stop"),
        F.coalesce(
            F.max("pos").over(behind) + 1,
            F.when(F.col("upto") >= min_words, F.min("pos").over(whole)),
        ).alias("start"),
        F.coalesce(F.max("upto").over(behind), F.lit(0)).alias("skipped"),
    )
    # Without its last line it still has enough words: then it is not the block that begins at ``start``.
    longer = F.col("before") - F.col("skipped") >= min_words
    lines = lines.select("doc", "run", F.struct("pos", "rank", "stop", F.when(longer, F.col("start")).alias("start")).alias("line"))
    runs = lines.groupBy("doc", "run").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    first = F.col("lines")[0]["pos"]
    onward = F.transform("lines", lambda x: F.struct((x["pos"] - first).alias("i"), (x["stop"] - x["pos"]).alias("size")))
    back = F.transform("lines", lambda x: F.struct((x["start"] - first).alias("i"), (x["pos"] + 1 - x["start"]).alias("size")))
    blocks = F.filter(F.concat(onward, back), lambda x: x["size"].isNotNull())
    return materialised(runs.select("doc", first.alias("pos"), F.col("lines.rank").alias("ranks"), blocks.alias("blocks")))


def _doubled(runs: DataFrame, reach: int) -> DataFrame:
    """``runs`` with ranks of blocks of twice ``reach`` lines; only those with blocks that need them."""
    held = lambda x: F.get("ranks", x["i"]).isNotNull() & F.get("ranks", x["i"] + x["size"] - reach).isNotNull()
    runs = runs.withColumn("blocks", F.filter("blocks", lambda x: (x["size"] >= 2 * reach) & held(x))).where(F.size("blocks") > 0)
    n = F.size("ranks") - reach
    pairs = F.zip_with(F.slice("ranks", F.lit(1), n), F.slice("ranks", F.lit(1 + reach), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = runs.select("doc", "pos", "blocks", F.posexplode(pairs).alias("i", "pair"))
    rows = rows.select("doc", "pos", "i", F.when(F.col("i") == 0, F.col("blocks")).alias("blocks"), "pair.a", "pair.b")
    ranked = _ranked(rows, ["a", "b"], ["doc", "pos", "i"])
    runs = ranked.groupBy("doc", "pos").agg(
        F.array_sort(F.collect_list(F.struct("i", "rank"))).alias("l"), F.any_value("blocks", F.lit(True)).alias("blocks")
    )
    return materialised(runs.select("doc", "pos", F.col("l.rank").alias("ranks"), "blocks"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, pos``: the numbers of the lines that are later copies of a run of ``min_words`` words or more.

    Runs come first by key, then by place. A run that repeats itself overlapping keeps one whole copy.
    """
    runs, level, names = _runs(docs, key, text, min_words), 0, None
    largest = runs.agg(F.max(F.array_max(F.transform("blocks", lambda x: x["size"])))).first()[0] or 0
    while 1 << level <= largest:
        # A block is named by the ranks of its first and of its last 2 ** level lines.
        reach = 1 << level
        here = runs.select("doc", "pos", "ranks", F.explode(F.filter("blocks", lambda x: x["size"] < 2 * reach)).alias("b"))  # noqa: B023
        here = here.select(
            "doc",
            (F.col("pos") + F.col("b.i")).alias("pos"),
            "b.size",
            F.get("ranks", F.col("b.i")).alias("head"),
            F.get("ranks", F.col("b.i") + F.col("b.size") - reach).alias("tail"),
        ).where("head is not null and tail is not null")
        names = here if names is None else names.unionAll(here)
        if 2 * reach <= largest:
            runs = _doubled(runs, reach)
        level += 1
    if names is None:
        return runs.select("doc", "pos").where("false")
    names = materialised(names)
    interval = ["size", "head", "tail"]
    first = names.groupBy(*interval).agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = names.join(materialised(first.drop("n")), interval).where(F.struct("doc", "pos") != F.col("first"))
    same = F.col("doc").eqNullSafe(F.col("first.doc"))
    begin = F.when(same, F.greatest("pos", F.col("first.pos") + F.col("size"))).otherwise(F.col("pos"))
    spans = copies.select("doc", begin.alias("a"), (F.col("pos") + F.col("size") - 1).alias("b")).where("a <= b")
    # Overlapping spans of a document are merged before lines are listed.
    reach = F.max("b").over(Window.partitionBy("doc").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("a", F.greatest("a", F.coalesce(reach + 1, F.col("a")))).where("a <= b")
    return spans.select("doc", F.explode(F.sequence("a", "b")).alias("pos"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """``docs`` without the later copies of repeated line runs; texts without one stay as they are.

    All rows and columns stay, a document that is a copy as a whole with an empty text. ``removed``
    names a column for the number of lines taken out. Line ids are 128-bit hashes of the lines without
    white space at their ends. Missing texts stay missing. Equal rows count as one document and
    lose the same lines; rows without a key take no part. An empty table gives an empty one.
    """
    gone = repeated_lines(docs, key, text, min_words).groupBy("doc").agg(F.collect_set("pos").alias("__gone"))
    # One hash table per partition, whatever the size: texts are moved once and not sorted.
    gone = materialised(gone).withColumnRenamed("doc", "__doc").hint("shuffle_hash")
    joined = docs.join(gone, F.col(key) == F.col("__doc"), "left")

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
        return F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "")

    # A list of one list, so that the text is split once and not for each of its lines.
    left = F.get(F.transform(F.array(lines_of(F.col(text))), rest), F.lit(0))
    joined = joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left))
    if removed:
        joined = joined.withColumn(removed, F.coalesce(F.size("__gone"), F.lit(0)))
    return joined.drop("__doc", "__gone")
