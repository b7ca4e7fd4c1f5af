import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortframe.operators import joins, multiple, scan, summary, tidy


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds most rows, many of them tied; a NULL group; a NULL value."""
    rng = np.random.default_rng(3)
    g = rng.choice(["hot", "b", "c", None], 3000, p=[0.8, 0.1, 0.05, 0.05])
    x = np.round(rng.gamma(1.0, 5.0, 3000), 1)
    df = pd.DataFrame({"id": range(3000), "g": g, "x": x})
    df.loc[5, "x"] = None
    return df, spark.createDataFrame(df).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(5)


@pytest.mark.parametrize("block_rows", [10, 10_000_000])
def test_quantiles(rows, block_rows):
    pdf, df = rows
    got = scan.exact_quantiles(df, ["g"], "x", {"a": 0.0, "b": 0.37, "c": 1.0}, block_rows=block_rows).toPandas()
    got = {None if pd.isna(r.g) else r.g: (r.n, r.a, r.b, r.c) for r in got.itertuples()}
    for name, part in pdf.groupby("g", dropna=False):
        values = part["x"].dropna()
        want = (len(values), *np.quantile(values, [0.0, 0.37, 1.0]))
        assert got[None if pd.isna(name) else name] == pytest.approx(want)


@pytest.mark.parametrize("block_rows", [10, 10_000_000])
def test_average_ranks(rows, block_rows):
    pdf, df = rows
    got = scan.average_ranks(df.filter("g = 'hot'"), ["g"], "x", block_rows=block_rows).toPandas()
    part = pdf[pdf["g"] == "hot"].dropna()
    want = part.assign(r=part["x"].rank()).groupby("x")["r"].first()
    assert dict(zip(got["x"], got["avg_rank"])) == pytest.approx(want.to_dict())


@pytest.mark.parametrize("block_rows", [10, 10_000_000])
@pytest.mark.parametrize("by", [["g"], []])
def test_positions(rows, block_rows, by):
    _, df = rows
    got = scan.with_position(df, by, ["x", "id"], block_rows=block_rows).toPandas()
    for _, part in got.groupby(by or [lambda _: 0], dropna=False):
        ordered = part.sort_values(["x", "id"], na_position="first")
        assert list(ordered["rn"]) == list(range(1, len(part) + 1))


def test_cuts_follow_the_size(spark):
    df = spark.range(60_000).withColumn("g", F.lit(1))
    sizes = scan.ordered(df, ["g"], F.col("id"), block_rows=100).df.groupBy("__block").count().toPandas()["count"]
    assert len(sizes) > 400 and sizes.max() < 400


def test_ties_are_adjusted_together(spark):
    ps = [1.0] * 300 + [0.01, 0.02, 0.02, None]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(ps)], "id INT, p DOUBLE")
    for method in ("holm", "BH"):
        got = {r.id: r.q for r in multiple.adjust_p(df, "p", [], method, adjusted="q", block_rows=2).collect()}
        want = {"holm": [1.0] * 3, "BH": [1.0] * 3}[method]
        assert [got[300 + k] for k in range(3)] == pytest.approx(want) and got[303] is None and len(got) == 304


def test_blocks_stay_small_and_split_the_hot_group(rows):
    _, df = rows
    kept = scan.ordered(df.select("g", "id"), ["g"], F.col("id"), block_rows=200)
    sizes = kept.df.groupBy("g", "__block").count().toPandas()
    hot = sizes[sizes["g"] == "hot"]
    assert kept.split and len(hot) > 20 and hot["count"].max() < 600


@pytest.mark.parametrize("block_rows", [3, 10_000_000])
def test_hand_worked_adjustment(spark, block_rows):
    ps = [0.01, 0.04, 0.03, 0.005, None, 0.03]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "f STRING, i INT, p DOUBLE")
    holm = multiple.adjust_p(df, "p", ["f"], "holm", block_rows=block_rows).orderBy("i").toPandas()
    bh = multiple.adjust_p(df, "p", ["f"], "BH", block_rows=block_rows).orderBy("i").toPandas()
    none = float("nan")
    assert list(holm["adj_p_value"]) == pytest.approx([0.04, 0.09, 0.09, 0.025, none, 0.09], nan_ok=True)
    assert list(bh["adj_p_value"]) == pytest.approx([0.025, 0.04, 0.0375, 0.025, none, 0.0375], nan_ok=True)
    assert set(bh["method"]) == {"BH"} and set(holm["method"]) == {"holm"}


@pytest.mark.parametrize("method", ["holm", "BH"])
def test_adjustment_in_blocks_equals_plain(spark, method):
    rng = np.random.default_rng(1)
    rows = [(str(i % 2), i, float(p)) for i, p in enumerate(np.round(rng.random(400) ** 3, 3))]
    df = spark.createDataFrame(rows, "f STRING, i INT, p DOUBLE")
    a = multiple.adjust_p(df, "p", ["f"], method, block_rows=20).orderBy("i").toPandas()
    b = multiple.adjust_p(df, "p", ["f"], method).orderBy("i").toPandas()
    assert list(a["adj_p_value"]) == pytest.approx(list(b["adj_p_value"]))
    assert (a["adj_p_value"] >= a["p"] - 1e-12).all() and (a["adj_p_value"] <= 1).all()
    for _, part in a.groupby("f"):
        assert part.sort_values("p")["adj_p_value"].is_monotonic_increasing


@pytest.mark.parametrize("block_rows", [10, 10_000_000])
def test_ordinal_attachment(spark, block_rows):
    left = spark.range(200).select(F.concat(F.lit("s"), F.col("id") % 3).alias("s"), F.col("id").alias("row_idx"))
    right = spark.range(200).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("s"), (F.col("id") * 2 + 9).alias("row_idx"), F.col("id").alias("v")
    )
    got = joins.attach_by_ordinal(left, right, "s", block_rows=block_rows).toPandas()
    assert len(got) == 200 and (got["row_idx"] == got["v"]).all()
    with pytest.raises(Exception, match="row counts differ for s s1"):
        joins.attach_by_ordinal(left, right.filter("v <> 199"), "s", block_rows=block_rows).collect()


def test_box_and_mad_in_blocks(rows):
    _, df = rows
    for one, other in [
        (summary.box_stats(df, ["g"], "x", block_rows=10), summary.box_stats(df, ["g"], "x")),
        (
            summary.mad_flag(df, "x", ["g"], block_rows=10).select("id", "mad", "qc"),
            summary.mad_flag(df, "x", ["g"]).select("id", "mad", "qc"),
        ),
    ]:
        assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))


def test_batches(spark):
    df = spark.createDataFrame([(c,) for c in "badcfeaab"] + [(None,)], "p STRING")
    got = {r.p: r.batch for r in tidy.batch_groups(df, "p", 4).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 2, "f": 2}
