"""The study's workflows as compositions of the operators.

Each takes tables and returns a table; nothing is read from or kept in a session.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import before_mark, joined_key, member, sample_key, without_suffix
from ..operators import embed, enrich, glm, joins, markers, neighbours, pseudobulk, reshape, score, summary, tidy
from ..operators.keyed import constant_within
from ..session import materialised
from . import constants

# --- labels -----------------------------------------------------------------------------


def sample_metadata(raw: DataFrame) -> DataFrame:
    """One row per untreated sample, keyed by ``Sample_Name``."""
    named = raw.withColumn("Sample_Name", sample_key("individual", "timepoint"))
    return named.filter(F.col("condition") == "basal").select(
        "Sample_Name", "MRD_risk", "individual", "relapse", "timepoint"
    )


def with_sample_type(cells: DataFrame) -> DataFrame:
    """Healthy by individual, the others by time point; unknown time points give NULL."""
    rules = [
        (F.col("individual") == "Healthy", "Healthy"),
        (member("timepoint", constants.MRD_TIMEPOINTS), "MRD timepoints"),
        (F.col("timepoint") == "Dx", "Diagnosis"),
        (F.col("timepoint") == "Rx", "Relapse"),
    ]
    return tidy.classify(cells, "sample_type", rules)


def with_repaired_tags(cells: DataFrame) -> DataFrame:
    """Undo the swap of two sample tags in one cartridge, in every column that follows from it."""
    # The cartridge, the patient and the labels that were swapped.
    swapped = F.col("individual") == "MRD_43"
    return tidy.relabel(
        cells,
        [
            (
                F.col("orig_ident") == "cart_f",
                "ident",
                {"SampleTag07_hs": "SampleTag06_hs", "SampleTag06_hs": "SampleTag07_hs"},
            ),
            (swapped, "timepoint", {"Dx": "D33", "D33": "Dx"}),
            (swapped, "sample_type", {"Diagnosis": "MRD timepoints", "MRD timepoints": "Diagnosis"}),
            (swapped, "Sample_Name", {"MRD43_Dx": "MRD43_D33", "MRD43_D33": "MRD43_Dx"}),
        ],
    )


# --- gate round trip --------------------------------------------------------------------


def adt_export(cells: DataFrame, adt: DataFrame, expr: DataFrame, genes: Mapping[str, str], markers_kept: Sequence[str]):
    """Wide marker table for gating, with genes such as ``{"tdt": "DNTT"}`` and the sample name.

    Marker names lose what follows the first ``-`` or ``:``.
    """
    cleaned = adt.withColumn("marker", before_mark(before_mark("marker", "-"), ":"))
    wide = reshape.to_wide(cleaned, ["cell_id"], "marker", "logcount", markers_kept)
    with_genes = reshape.wide_features(wide, expr, list(genes.values())).withColumnsRenamed(
        {gene: name for name, gene in genes.items()}
    )
    return joins.attach(with_genes, cells.select("cell_id", "Sample_Name"), "cell_id")


def import_gates(cells: DataFrame, gates: DataFrame) -> DataFrame:
    """Attach the gate of each cell from the gated file, which keeps the order within a sample."""
    named = gates.select(
        without_suffix("OmiqFileIndex", ".csv").alias("Sample_Name"), "row_idx", F.col("OmiqFilter").alias("gate")
    )
    return joins.attach_by_ordinal(cells, named, "Sample_Name")


# --- annotation -------------------------------------------------------------------------


def annotate(
    cells: DataFrame,
    expr: DataFrame,
    loadings: DataFrame,
    reference: DataFrame,
    components: int,
    *,
    k: int = 30,
    threshold: float = 2.5,
) -> DataFrame:
    """Project cells onto a reference, transfer labels, and keep those that pass quality control.

    Cells that fail get the label ``Unassigned`` and probability 0.
    """
    donors = cells.select("cell_id", "individual")
    # The alignment reads the projection three times.
    projected = materialised(embed.project(expr, donors, loadings, components))
    placed = materialised(embed.align_donors(projected, "individual"))
    errors = neighbours.mapping_error(placed, reference, ["individual"], threshold=threshold)
    labels = neighbours.knn_label_transfer(placed, reference, k)
    final = neighbours.with_quality(labels, errors).select(
        "cell_id", F.col("final_label").alias("predicted_BMM"), F.col("final_proba").alias("predicted_BMM_proba")
    )
    kept = cells.drop("predicted_BMM", "predicted_BMM_proba")
    return joins.attach(kept, final, "cell_id").fillna({"predicted_BMM": "Unassigned", "predicted_BMM_proba": 0.0})


def population_shares(cells: DataFrame, lineage_only: bool = False) -> DataFrame:
    """Share of each predicted population in the leukemic cells, per sample type and outcome."""
    where = (F.col("gate") == "Leukemia") & (F.col("sample_type") != "Healthy")
    if lineage_only:
        where = where & member("predicted_BMM", constants.B_LINEAGE)
    return summary.composition(cells, ["predicted_BMM", "sample_type", "relapse"], ["sample_type", "relapse"], where)


# --- signatures -------------------------------------------------------------------------


def signature_table(spark: SparkSession, signatures: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    rows = [(name, gene) for name, genes in (signatures or constants.SIGNATURES).items() for gene in genes]
    return spark.createDataFrame(rows, "signature STRING, gene STRING")


def signature_means(
    cells: DataFrame,
    expr: DataFrame,
    signatures: DataFrame,
    n_features: int,
    *,
    features: DataFrame | None = None,
    **scoring,
) -> DataFrame:
    """Mean rank score of the leukemic cells per sample and signature.

    ``features`` is the table of detected genes; genes of a signature that it lacks are left out.
    """
    usable = signatures if features is None else tidy.present_features(signatures, features)
    gated = cells.filter(F.col("gate") == "Leukemia").select("cell_id", "Sample_Name", "sample_type", "relapse")
    scores = score.rank_score(gated, expr, usable, n_features, **scoring)
    return scores.groupBy("Sample_Name", "signature").agg(
        constant_within("sample_type", "sample_type"),
        constant_within("relapse", "relapse"),
        F.avg("score").alias("score"),
    )


def signature_tests(means: DataFrame) -> DataFrame:
    """Sample types compared pairwise per signature: in all samples, and by outcome."""
    known = F.when(F.col("relapse").isNotNull(), F.concat(F.lit("relapse "), "relapse"))
    cohorts = F.array_compact(F.array(F.lit("all"), known))
    return markers.pairwise_ranksum(
        means.withColumn("cohort", F.explode(cohorts)), "score", "sample_type", ["cohort", "signature"]
    )


# --- differential expression ------------------------------------------------------------


def expression_tests(
    cells: DataFrame,
    expr: DataFrame,
    by: Sequence[str],
    factors: Mapping[str, str | None],
    contrasts: Mapping[str, str | Mapping[str, float]],
    *,
    group: str,
    method: str = "holm",
) -> DataFrame:
    """Pseudobulk the given cells by ``by``, filter, normalise and test the contrasts.

    The design follows from the columns in ``by``; nothing is typed in by hand.
    """
    keyed = cells.withColumn("sample", joined_key(*by, sep="|"))
    samples = keyed.select("sample", *by).distinct()
    bulk = materialised(pseudobulk.pseudobulk(expr, keyed, ["sample"]))
    kept = materialised(pseudobulk.filter_by_expr(bulk, samples, group))
    design = glm.design_matrix(samples, factors)
    return glm.pseudobulk_de(kept, pseudobulk.tmm_factors(kept), design, contrasts, method=method)


def enriched_terms(
    de: DataFrame,
    id_map: DataFrame,
    terms: DataFrame,
    *,
    alpha: float = 0.05,
    min_effect: float = 1.0,
    **options,
) -> DataFrame:
    """Terms over-represented among the significant genes of each contrast.

    ``id_map`` is ``gene, entrez`` and ``terms`` ``term, entrez``.
    """
    strong = tidy.significant(de, "adj_p_value", alpha, "log_fc", min_effect, absolute=True)
    mapped = joins.map_ids(strong.select("contrast", "gene"), id_map, "gene")
    symbols = id_map.select("entrez", F.col("gene").alias("symbol"))
    return enrich.enrich(mapped.select("contrast", "entrez"), terms, ["contrast"], gene="entrez", symbols=symbols, **options)


# --- marker genes and clusters ----------------------------------------------------------


def cluster_markers(cells: DataFrame, expr: DataFrame, *, lfc: float = 1.0) -> DataFrame:
    """Markers of every cluster against any other, by rank sums."""
    return markers.combine_markers(markers.marker_wilcox(expr, cells, "label", lfc=lfc), "label", "auc")


def gate_markers(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """Markers between the gates of the B cells, within each sample type, by Welch tests."""
    chosen = cells.filter(F.col("Cell_Type_Experimental") == "B").dropna(subset=["sample_type", "gate"])
    pairs = markers.marker_ttest(expr, chosen, "gate", ["sample_type"])
    return markers.combine_markers(pairs, "gate", "log_fc", ["sample_type"])
