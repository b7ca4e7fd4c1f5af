"""The study's workflows on a small made cohort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.plans import cohort, constants
from cohortframe.sources import schemas


def test_sample_metadata(spark):
    raw = spark.createDataFrame(
        [
            ("MRD_43", "Dx", "basal", "HR", "yes"),
            ("Healthy", "D0", "basal", None, None),
            (None, "D8", "basal", "LR", "no"),
            ("MRD_01", "D8", "stimulated", "LR", "no"),
        ],
        schemas.METADATA,
    )
    got = cohort.sample_metadata(raw)
    assert got.columns == ["Sample_Name", "MRD_risk", "individual", "relapse", "timepoint"]
    assert [r.Sample_Name for r in got.collect()] == ["MRD43_Dx", "Healthy_D0", None]


def test_labels_and_repair(spark):
    cells = spark.createDataFrame(
        [
            ("c1", "cart_f", "SampleTag06_hs", "MRD43_Dx", "MRD_43", "Dx"),
            ("c2", "cart_f", "SampleTag07_hs", "MRD43_D33", "MRD_43", "D33"),
            ("c3", "cart_f", "SampleTag09_hs", "MRD01_Rx", "MRD_01", "Rx"),
            ("c4", "cart_a", "SampleTag06_hs", "Healthy_D0", "Healthy", "D0"),
            ("c5", "cart_a", "SampleTag06_hs", None, None, None),
        ],
        "cell_id STRING, orig_ident STRING, ident STRING, Sample_Name STRING, individual STRING, timepoint STRING",
    )
    typed = cohort.with_sample_type(cells)
    assert [r.sample_type for r in typed.collect()] == ["Diagnosis", "MRD timepoints", "Relapse", "Healthy", None]
    fixed = [(r.ident[9:11], r.Sample_Name, r.timepoint, r.sample_type) for r in cohort.with_repaired_tags(typed).collect()]
    assert fixed == [
        ("07", "MRD43_D33", "D33", "MRD timepoints"),
        ("06", "MRD43_Dx", "Dx", "Diagnosis"),
        ("09", "MRD01_Rx", "Rx", "Relapse"),
        ("06", "Healthy_D0", "D0", "Healthy"),
        ("06", None, None, None),
    ]


def test_gate_round_trip(spark):
    cells = spark.createDataFrame([("a", 1, "MRD43_Dx"), ("b", 2, "MRD01_Rx"), ("c", 3, "MRD43_Dx")], "cell_id STRING, row_idx BIGINT, Sample_Name STRING")
    gates = spark.createDataFrame(
        [(1, "x", "MRD01_Rx.csv", "Unfiltered"), (2, "x", "MRD43_Dx.csv", "Leukemia"), (3, "x", "MRD43_Dx.csv", "Unfiltered")], schemas.GATES
    )
    got = {r.cell_id: r.gate for r in cohort.import_gates(cells, gates).collect()}
    assert got == {"a": "Leukemia", "b": "Unfiltered", "c": "Unfiltered"}
    with pytest.raises(Exception, match="row counts differ"):
        cohort.import_gates(cells, gates.filter("row_idx < 3")).collect()
    adt = spark.createDataFrame([("a", "CD10:x-y", 1.5), ("b", "CD19-z", 2.0)], "cell_id STRING, marker STRING, logcount DOUBLE")
    expr = spark.createDataFrame([("a", "DNTT", 0.7)], "cell_id STRING, gene STRING, logcount DOUBLE")
    wide = cohort.adt_export(cells, adt, expr, {"tdt": "DNTT"}, ["CD10", "CD19"])
    assert wide.columns == ["cell_id", "CD10", "CD19", "tdt", "Sample_Name"]
    assert {tuple(r) for r in wide.collect()} == {("a", 1.5, None, 0.7, "MRD43_Dx"), ("b", None, 2.0, 0.0, "MRD01_Rx")}


@pytest.fixture(scope="module")
def made(spark):
    """Four patients at two time points, 12 cells each; signature genes and others."""
    rng = np.random.default_rng(11)
    genes = [*constants.SIGNATURES["Pyrimidine_synthesis"], "CYCS", "CS", *[f"G{i}" for i in range(25)]]
    cells, expr = [], []
    for p in range(4):
        for when, kind in (("Dx", "Diagnosis"), ("Rx", "Relapse")):
            for c in range(12):
                name = f"{p}{when}{c}"
                gate = "Leukemia" if c < 9 else "Unfiltered"
                kept = ("HSC", "Pro-B VDJ", "Monocyte")[c % 3]
                cells.append((name, f"MRD0{p}_{when}", f"MRD_0{p}", when, kind, "yes", gate, "B", str(c % 3), kept))
                for j, g in enumerate(genes):
                    mean = 6.0 * (5.0 if when == "Rx" and j in (0, 6, 7) else 1.0)
                    n = int(rng.negative_binomial(5, 5 / (5 + mean)))
                    if n:
                        expr.append((name, g, n, float(np.log2(1 + n))))
    schema = (
        "cell_id STRING, Sample_Name STRING, individual STRING, timepoint STRING, sample_type STRING, relapse STRING, "
        "gate STRING, Cell_Type_Experimental STRING, label STRING, predicted_BMM STRING"
    )
    return spark.createDataFrame(cells, schema), spark.createDataFrame(expr, schemas.EXPRESSION), genes


def test_signature_workflow(spark, made):
    cells, expr, genes = made
    means = cohort.signature_means(cells, expr, cohort.signature_table(spark), len(genes), features=expr, max_rank=len(genes))
    assert means.count() == 8 * 2
    tests = {(r.cohort, r.signature): r for r in cohort.signature_tests(means).collect()}
    assert set(tests) == {(c, s) for c in ("all", "relapse yes") for s in ("Mito_ETC", "Pyrimidine_synthesis")}
    assert all(r.n_1 == r.n_2 == 4 and r.method == "holm" for r in tests.values())


def test_expression_workflow(spark, made):
    cells, expr, genes = made
    de = cohort.expression_tests(
        cells.filter("gate = 'Leukemia'"),
        expr,
        ["sample_type", "individual"],
        {"individual": None, "sample_type": "Diagnosis"},
        {"Relapse": "sample_typeRelapse"},
        group="sample_type",
    )
    top = de.toPandas()
    assert set(top["gene"][:3]) == {genes[0], genes[6], genes[7]} and (top["log_fc"][:3] > 1).all()
    id_map = spark.createDataFrame([(g, str(i)) for i, g in enumerate(genes)], "gene STRING, entrez STRING")
    terms = spark.createDataFrame([("up", "0"), ("up", "6"), ("up", "7"), *[("rest", str(i)) for i in range(30)]], "term STRING, entrez STRING")
    found = cohort.enriched_terms(de, id_map, terms, min_size=2).collect()
    assert [r.term for r in found] == ["up"] and found[0].genes == "/".join(sorted(genes[i] for i in (0, 6, 7)))


def test_population_and_markers(made):
    cells, expr, _ = made
    shares = cohort.population_shares(cells, lineage_only=True).collect()
    assert {r.predicted_BMM for r in shares} == {"HSC", "Pro-B VDJ"} and all(r.share == 0.5 for r in shares)
    assert cohort.gate_markers(cells, expr).select("sample_type", "gate").distinct().count() == 4
    assert cohort.cluster_markers(cells, expr).select("label").distinct().count() == 3


def test_annotation(spark, made):
    cells, expr, genes = made
    loadings = spark.createDataFrame([(g, 2.5, 1.0, [float(i == 0), float(i == 1)]) for i, g in enumerate(genes)], "gene STRING, mean DOUBLE, sd DOUBLE, weights ARRAY<DOUBLE>")
    reference = spark.range(40).select(
        F.concat(F.lit("r"), "id").alias("ref_id"),
        F.when(F.col("id") % 2 == 0, "HSC").otherwise("CLP").alias("label"),
        F.array((F.col("id") % 2 * 2 - 1).cast("double"), (F.col("id") % 5 / 10).cast("double")).alias("embedding"),
    )
    got = cohort.annotate(cells, expr, loadings, reference, 2, k=5)
    assert got.count() == cells.count()
    labels = got.groupBy("predicted_BMM").agg(F.min("predicted_BMM_proba"), F.max("predicted_BMM_proba")).collect()
    assert {r[0] for r in labels} <= {"HSC", "CLP", "Unassigned"}
    assert all(r[2] == 0 for r in labels if r[0] == "Unassigned")


def test_annotation_projects_once(spark, made, monkeypatch):
    cells, expr, genes = made
    loadings = spark.createDataFrame([(g, 2.5, 1.0, [float(i)]) for i, g in enumerate(genes)], "gene STRING, mean DOUBLE, sd DOUBLE, weights ARRAY<DOUBLE>")
    reference = spark.range(9).select(F.concat(F.lit("r"), "id").alias("ref_id"), F.lit("HSC").alias("label"), F.array(F.col("id").cast("double")).alias("embedding"))
    given, align = [], cohort.embed.align_donors
    monkeypatch.setattr(cohort.embed, "align_donors", lambda scores, donor: given.append(scores) or align(scores, donor))
    cohort.annotate(cells, expr, loadings, reference, 1, k=3)
    # A written table, which the alignment may read as often as it likes.
    assert given[0].inputFiles()
