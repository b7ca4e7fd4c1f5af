import pytest
from pyspark.sql import functions as F

from cohortframe.functions.scalar import before_mark, joined_key, member, sample_key, share, split_column, without_suffix
from cohortframe.operators import joins, reshape, summary, tidy
from cohortframe.operators.keyed import constant_within, unique_by
from cohortframe.sources import schemas
from cohortframe.sources import tables as io


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv_round_trip_and_wrong_header(spark, tmp_path):
    df = spark.createDataFrame(
        [("MRD_43", "Dx", "basal", "HR", "yes"), (None, "D8", "drug", None, "no")], schemas.METADATA
    )
    io.write_csv(df.fillna("NA"), str(tmp_path / "m"))
    assert rows(io.read_csv(spark, str(tmp_path / "m"), schemas.METADATA)) == rows(df)
    with pytest.raises(Exception, match="(?i)header|schema"):
        io.read_csv(spark, str(tmp_path / "m"), "a STRING, b STRING, c STRING, d STRING, e STRING").collect()


def test_one_output_per_key_with_null(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "Sample_Name STRING, x INT")
    io.write_csv_per_key(df, str(tmp_path / "k"), "Sample_Name", parts=3)
    folders = {p.name for p in (tmp_path / "k").iterdir() if p.is_dir()}
    assert folders == {"Sample_Name=a", "Sample_Name=b", "Sample_Name=__HIVE_DEFAULT_PARTITION__"}
    back = spark.read.schema("x INT, Sample_Name STRING").csv(str(tmp_path / "k"), header=True)
    assert rows(back.select("Sample_Name", "x")) == rows(df)


def test_dataset_and_buckets(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("cell_id"), (F.col("id") % 3).alias("g"))
    io.save_dataset({"cells": df}, str(tmp_path / "d"), partition_by={"cells": ["g"]})
    assert rows(io.load_dataset(spark, str(tmp_path / "d"), ["cells"])["cells"].select("cell_id")) == rows(df.select("cell_id"))
    for name in ("bucket_a", "bucket_b"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        io.save_bucketed(df, name, "cell_id", 4, str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table("bucket_a").join(spark.table("bucket_b"), "cell_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
    for name in ("bucket_a", "bucket_b"):
        spark.sql(f"DROP TABLE {name}")


def test_drop_present(spark):
    assert io.drop_present(spark.range(1).withColumn("Unnamed: 0", F.lit("x")), ["Unnamed: 0", "plate"]).columns == ["id"]


def test_scalar_null_rules(spark):
    df = spark.createDataFrame([("MRD_43", "Dx", 1.0, 0.0), (None, "D8", 2.0, 4.0), ("Healthy", None, None, 1.0)], "i STRING, t STRING, a DOUBLE, b DOUBLE")
    got = df.select(
        sample_key("i", "t"), sample_key("i", "t", "nan"), joined_key("i", "t"), member("i", ["Healthy"]), share("a", "b")
    ).collect()
    assert [tuple(r) for r in got] == [
        ("MRD43_Dx", "MRD43_Dx", "MRD_43 Dx", False, None),
        (None, None, "NA D8", False, 0.5),
        (None, "Healthy_nan", "Healthy NA", True, None),
    ]


def test_text_pieces(spark):
    df = spark.createDataFrame([("CD10:a-b", "MRD43_Dx_x.csv"), ("CD34", "MRD01"), (None, None)], "m STRING, f STRING")
    got = split_column(
        df.select(before_mark(before_mark("m", "-"), ":").alias("m"), without_suffix("f", ".csv").alias("f")), "f", ["i", "t"]
    )
    assert [tuple(r) for r in got.collect()] == [("CD10", "MRD43", "Dx"), ("CD34", "MRD01", None), (None, None, None)]


def test_swap_twice_is_identity(spark):
    df = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c"), ("g", "a"), (None, "a"), ("f", None)], "k STRING, v STRING")
    rule = [(F.col("k") == "f", "v", {"a": "b", "b": "a"})]
    once = tidy.relabel(df, rule)
    assert [r.v for r in once.collect()] == ["b", "a", "c", "a", "a", None]
    assert once.transform(lambda d: tidy.relabel(d, rule)).collect() == df.collect()


def test_recode_needs_unique_mapping(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v STRING")
    mapping = spark.createDataFrame([("a", "x")], "o STRING, n STRING")
    assert [r.v for r in tidy.recode(df, "v", mapping, "o", "n").collect()] == ["x", "b", None]
    with pytest.raises(Exception, match="more than one row"):
        tidy.recode(df, "v", mapping.union(spark.createDataFrame([("a", "y")], mapping.schema)), "o", "n").collect()


def test_dependent_column_check(spark):
    df = spark.createDataFrame([("s", "x"), ("s", None), ("t", "y")], "k STRING, v STRING")
    assert rows(df.groupBy("k").agg(constant_within("v", "v"))) == [("s", "x"), ("t", "y")]
    with pytest.raises(Exception, match="not constant"):
        df.union(spark.createDataFrame([("s", "z")], df.schema)).groupBy("k").agg(constant_within("v", "v")).collect()
    with pytest.raises(Exception, match="more than one row"):
        unique_by(df, ["k"]).collect()


def test_volcano_boundaries(spark):
    df = spark.createDataFrame([(0.25, 2.0), (0.2, 1.0), (0.2, -1.5), (0.3, 3.0), (None, 3.0)], "p DOUBLE, fc DOUBLE")
    got = [r.volcano for r in tidy.volcano_class(df, "fc", "p", 0.25, 1.0).collect()]
    assert got == ["Log2 FC", "p-value", "p-value and log2 FC", "Log2 FC", None]


def test_join_features_and_cells_without_values(spark):
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell_id STRING")
    expr = spark.createDataFrame([("c1", "A", 2.0), ("c1", "Z", 9.0)], "cell_id STRING, gene STRING, logcount DOUBLE")
    wanted = spark.createDataFrame([("A",), ("B",)], "g STRING")
    want = [("c1", "A", 2.0), ("c1", "B", 0.0), ("c2", "A", 0.0), ("c2", "B", 0.0)]
    assert rows(joins.join_features(cells, expr, ["A", "B"])) == want
    assert rows(joins.join_features(cells, expr, wanted)) == want
    assert rows(reshape.wide_features(cells, expr, ["A", "B"])) == [("c1", 2.0, 0.0), ("c2", 0.0, 0.0)]


def test_group_pairs(spark):
    df = spark.createDataFrame([("a",), ("c",), ("b",), ("a",), (None,)], "g STRING")
    assert rows(joins.group_pairs(df, "g")) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_alignment_check(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k INT, x DOUBLE")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0 + 1e-9)], "k INT, y DOUBLE")
    assert joins.check_aligned(a, b, "k", "x", "y").first().aligned
    many = spark.range(1000).select(F.col("id").alias("k"), F.lit(1.0).alias("x"))
    one_off = many.select("k", F.when(F.col("k") == 7, 1.00001).otherwise(1.0).alias("y"))
    assert joins.check_aligned(many, one_off, "k", "x", "y").first().mean_rel_diff == pytest.approx(1e-5)
    assert not joins.check_aligned(a, b.filter("k = 1"), "k", "x", "y").first().aligned
    assert not joins.check_aligned(a, b.withColumn("y", F.when(F.col("k") == 1, F.col("y"))), "k", "x", "y").first().aligned


def test_csv_in_file_order(spark, tmp_path):
    for k, name in enumerate(["b.csv", "a.csv"]):
        (tmp_path / name).write_text("x,y\n" + "".join(f"{k * 1000 + i},{'v' * 20}\n" for i in (5, 3, 9, *range(100, 400))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        got = io.read_csv_in_order(spark, str(tmp_path), "x INT, y STRING").orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    one = [5, 3, 9, *range(100, 400)]
    assert [r.x for r in got] == [1000 + i for i in one] + one and [r.row_idx for r in got] == list(range(1, 607))


def test_csv_per_key_without_parts(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    io.write_csv_per_key(df, str(tmp_path / "k"), "k")
    assert sorted(p.name for p in (tmp_path / "k").glob("k=*")) == ["k=0", "k=1", "k=2"]
    assert spark.read.option("header", True).csv(str(tmp_path / "k")).count() == 100


def test_attach_rejects_double_keys(spark):
    a = spark.createDataFrame([(1,), (3,)], "k INT")
    b = spark.createDataFrame([(1, "x")], "k INT, v STRING")
    assert rows(joins.attach(a, b, "k")) == [(1, "x"), (3, None)]
    with pytest.raises(Exception, match="more than one row"):
        joins.attach(a, b.union(b), "k").collect()


def test_crosstab_properties(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), (None, "p")], "a STRING, b STRING")
    table = summary.composition(df, ["a", "b"], ["a"])
    assert rows(table) == [("x", "p", 1, 2, 0.5), ("x", "q", 1, 2, 0.5), ("y", "p", 1, 1, 1.0), ("y", "q", 0, 1, 0.0)]
    declared = summary.composition(df, ["a", "b"], ["a"], F.col("a") != "y", {"a": ["x", "y"]})
    assert [r for r in rows(declared) if r[0] == "y"] == [("y", "p", 0, 0, None), ("y", "q", 0, 0, None)]


@pytest.mark.parametrize("piece", [1, 2, 4_096])
def test_level_grid(spark, piece):
    a = spark.createDataFrame([(x,) for x in "pqr"], "a STRING")
    b = spark.createDataFrame([(x,) for x in (1, 2)], "b INT")
    c = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, 3.5)], "c DOUBLE")
    grid = joins.level_grid({"a": a, "b": b, "c": c}, piece=piece)
    assert grid.columns == ["a", "b", "c"]
    assert rows(grid) == sorted((x, y, z) for x in "pqr" for y in (1, 2) for z in (0.5, 1.5, 2.5, 3.5))
    assert rows(joins.level_grid({"a": a}, piece=piece)) == [("p",), ("q",), ("r",)]
    empty = joins.level_grid({"a": a, "b": b.where("false"), "c": c})
    assert empty.columns == ["a", "b", "c"] and rows(empty) == []


def test_level_grid_of_many_levels(spark):
    """No task writes more than its share, and no row holds the names of a dimension."""
    many = spark.range(100_000).select(F.concat(F.lit("level "), "id").alias("a"))
    few = spark.range(20).select(F.col("id").alias("b"))
    grid = joins.level_grid({"a": many, "b": few})
    assert "collect_" not in grid._jdf.queryExecution().toString()
    got = grid.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    want = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("b"))
    assert tuple(got) == tuple(want.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    sizes = [r["count"] for r in grid.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 2 and max(sizes) < 1_100_000


def test_levels_that_are_declared(spark):
    counts = spark.createDataFrame([("x", 1, 5), ("y", 2, 6), (None, 1, 7), ("z", 9, None)], "a STRING, b INT, n LONG")
    got = joins.complete_levels(counts, ["a", "b"], ["n"], {"b": [2, 1, 3]}, fill=0)
    assert rows(got) == [("x", 1, 5), ("x", 2, 0), ("x", 3, 0), ("y", 1, 0), ("y", 2, 6), ("y", 3, 0)]
    got = joins.complete_levels(counts, ["a", "b"], ["n"], {"a": spark.createDataFrame([("y",), ("y",), (None,)], "l STRING")})
    assert rows(got) == [("y", 1, 0), ("y", 2, 6)]
    assert rows(joins.complete_levels(counts.where("false"), ["a", "b"], ["n"])) == []


def test_zscore_of_constant_marker(spark):
    df = spark.createDataFrame([("p", "m", 2.0), ("q", "m", 2.0), ("p", "k", 1.0), ("q", "k", 3.0)], "p STRING, f STRING, x DOUBLE")
    got = {(r.p, r.f): r.z_score for r in summary.zscore_vs_global(df, "p", "f", "x").collect()}
    assert got[("p", "m")] is None and got[("q", "k")] == pytest.approx(1 / 2**0.5)
    assert [r.z_score for r in summary.zscore_within(df.filter("f = 'm'"), "x", ["f"]).collect()] == [None, None]


def test_single_value_has_no_error(spark):
    got = summary.mean_se(spark.createDataFrame([("a", 2.0)], "g STRING, x DOUBLE"), ["g"], "x").first()
    assert (got.n, got.mean, got.sd, got.se) == (1, 2.0, None, None)


def test_long_and_wide_round_trip(spark):
    wide = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0)], "k INT, a DOUBLE, b DOUBLE")
    long = reshape.to_long(wide, ["k"])
    assert long.count() == 4
    assert rows(reshape.to_wide(long, ["k"], "feature", "value", ["a", "b"])) == rows(wide)


def test_coverage(spark):
    s = spark.createDataFrame([("m", "CYCS"), ("m", "ATP5A"), ("m", "CYCS"), ("p", "CAD")], "signature STRING, gene STRING")
    detected = spark.createDataFrame([("CYCS",), ("CAD",)], "gene STRING")
    assert rows(tidy.feature_coverage(s, detected)) == [("m", 2, 1, False, ["ATP5A"]), ("p", 1, 1, True, [])]


def test_constant_density(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x DOUBLE")
    got = summary.binned_density(df, [], "x", 10).first()
    assert (got.bin, got.n, got.share, got.density) == (0, 2, 1.0, None)
