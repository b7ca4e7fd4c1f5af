"""The study's workflows over the driver tables, each as one query.

Customers stand in for cells, part names for genes, nations for samples, regions for sample types
and market segments for clusters, as in the other queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortframe.plans import cohort

from .domain import colour_signatures, customer_cells, customer_expr, part_loadings
from .registry import QUERIES, Tables, query


def nation_cells(t: Tables):
    """Customers with the nation as sample, the region as its type and an outcome per nation."""
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("cell_id"),
        F.col("n_name").alias("Sample_Name"),
        F.col("n_regionkey").cast("string").alias("sample_type"),
        F.when(F.col("n_nationkey") % 2 == 0, "yes").otherwise("no").alias("relapse"),
        F.lit("Leukemia").alias("gate"),
        F.col("n_name").alias("individual"),
    )


@query("P1_annotate")
def _(t: Tables):
    reference = t.customer.select(
        F.col("c_custkey").cast("string").alias("ref_id"),
        F.col("c_mktsegment").alias("label"),
        F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 7).cast("double")).alias("embedding"),
    )
    return cohort.annotate(nation_cells(t), customer_expr(t), part_loadings(t), reference, 3, k=10)


@query("P2_signature_tests")
def _(t: Tables):
    parts = t.part.select("p_name").distinct().count()
    means = cohort.signature_means(
        nation_cells(t), customer_expr(t), colour_signatures(t), parts, features=customer_expr(t), max_rank=parts
    )
    return cohort.signature_tests(means)


@query("P3_expression_tests")
def _(t: Tables):
    cells = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    cells = cells.select(
        F.col("o_orderkey").alias("cell_id"), F.col("n_regionkey").cast("string").alias("patient"), F.col("o_orderstatus").alias("status")
    )
    expr = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("cell_id"), F.col("p_name").alias("gene"), F.col("l_quantity").cast("bigint").alias("count")
    )
    contrasts = {"O": "statusO", "P": "statusP"}
    return cohort.expression_tests(cells, expr, ["patient", "status"], {"patient": None, "status": "F"}, contrasts, group="status")


@query("P4_cluster_markers")
def _(t: Tables):
    return cohort.cluster_markers(customer_cells(t), customer_expr(t))


@query("P5_gate_markers")
def _(t: Tables):
    """Market segments stand in for the gates of the B cells, regions for the sample types."""
    cells = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("cell_id"),
        F.lit("B").alias("Cell_Type_Experimental"),
        F.col("n_regionkey").cast("string").alias("sample_type"),
        F.col("c_mktsegment").alias("gate"),
    )
    return cohort.gate_markers(cells, customer_expr(t))


@query("P6_enriched_terms")
def _(t: Tables):
    """Differential expression between order statuses, then the part types over-represented among all genes that were tested."""
    genes = t.part.select(F.col("p_name").alias("gene"), F.concat(F.lit("E"), "p_name").alias("entrez")).distinct()
    terms = t.part.select(F.col("p_type").alias("term"), F.concat(F.lit("E"), "p_name").alias("entrez")).distinct()
    tested = QUERIES["P3_expression_tests"](t.spark, t.folder)
    return cohort.enriched_terms(
        tested, genes, terms, alpha=1.01, min_effect=0.0, min_size=2, max_size=100_000, p_cutoff=None, q_cutoff=None
    )
