"""Table operators: sources, rules, joins, summaries, windows, sets and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortframe.functions.scalar import before_mark, joined_key, member, sample_key, share, split_column, without_suffix
from cohortframe.operators import joins, reshape, scan, summary, tidy
from cohortframe.operators.keyed import constant_within
from cohortframe.session import new_folder
from cohortframe.sources import tables as io

from .registry import Tables, query, r

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# --- sources and sinks ------------------------------------------------------------------


@query(
    "A1_A5_csv_round_trip",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def _(t: Tables):
    path = new_folder(t.spark)
    io.write_csv(t.customer, path)
    schema = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    return io.read_csv(t.spark, path, schema)


@query(
    "A2_A3_dataset_round_trip",
    """SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def _(t: Tables):
    path = new_folder(t.spark)
    cells = t.orders.select("o_custkey", "o_totalprice", "o_orderpriority")
    io.save_dataset({"cells": cells, "meta": t.customer}, path, partition_by={"cells": ["o_orderpriority"]})
    saved = io.load_dataset(t.spark, path, ["cells", "meta"])
    joined = saved["cells"].join(saved["meta"], F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "A4_csv_with_key_column",
    """SELECT n_name AS gene, count(*) AS n, round(avg(c_acctbal), 6) AS mean
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def _(t: Tables):
    path = new_folder(t.spark)
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    table = named.groupBy(F.col("n_name").alias("gene")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("c_acctbal")).alias("mean")
    )
    io.write_csv(table, path)
    return io.read_csv(t.spark, path, "gene STRING, n BIGINT, mean DOUBLE")


@query(
    "A6_one_output_per_key",
    "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL",
)
def _(t: Tables):
    path = new_folder(t.spark)
    io.write_csv_per_key(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), path, "o_orderpriority", parts=4)
    written = t.spark.read.schema("o_orderkey BIGINT, o_totalprice DOUBLE, o_orderpriority STRING").csv(path, header=True)
    return written.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total")
    )


@query("A7_drop_if_present", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(t: Tables):
    return io.drop_present(t.supplier, ["Unnamed: 0", "s_name", "s_acctbal", "plate"])


# --- projection, rules, scalar functions ------------------------------------------------


@query(
    "B1_B2_B3_project_rename_derive",
    """SELECT l_orderkey AS cell_id, l_partkey AS gene, l_extendedprice * (1 - l_discount) AS net,
              l_quantity AS count FROM lineitem""",
)
def _(t: Tables):
    return (
        t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
        .withColumnsRenamed({"l_orderkey": "cell_id", "l_partkey": "gene", "l_quantity": "count"})
        .withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
        .drop("l_extendedprice", "l_discount")
    )


@query(
    "B4_rule_classification",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Healthy'
              WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'MRD timepoints'
              WHEN o_orderstatus = 'F' THEN 'Diagnosis'
              WHEN o_orderstatus = 'P' THEN 'Relapse' END AS sample_type FROM orders""",
)
def _(t: Tables):
    rules = [
        (F.col("o_orderpriority") == "1-URGENT", "Healthy"),
        (member("o_orderpriority", ["2-HIGH", "3-MEDIUM"]), "MRD timepoints"),
        (F.col("o_orderstatus") == "F", "Diagnosis"),
        (F.col("o_orderstatus") == "P", "Relapse"),
    ]
    return tidy.classify(t.orders, "sample_type", rules).select("o_orderkey", "sample_type")


@query(
    "B5_swap_labels",
    """SELECT o_orderkey,
              CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'O'
                   WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
              CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN '2-HIGH'
                   WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN '1-URGENT'
                   ELSE o_orderpriority END AS o_orderpriority
       FROM orders""",
)
def _(t: Tables):
    rules = [
        (F.col("o_orderpriority") == "5-LOW", "o_orderstatus", {"F": "O", "O": "F"}),
        (F.col("o_orderstatus") == "P", "o_orderpriority", {"1-URGENT": "2-HIGH", "2-HIGH": "1-URGENT"}),
    ]
    return tidy.relabel(t.orders, rules).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "B6_composite_key",
    """SELECT o_orderkey, concat_ws(' ', o_orderpriority, coalesce(nullif(o_orderstatus, 'P'), 'NA'),
              CAST(o_custkey AS VARCHAR)) AS sample FROM orders""",
)
def _(t: Tables):
    status = F.nullif("o_orderstatus", F.lit("P"))
    return t.orders.select("o_orderkey", joined_key("o_orderpriority", status, "o_custkey").alias("sample"))


@query(
    "B7_sample_name",
    """SELECT n_nationkey, replace(nullif(n_name, 'NATION_3'), '_', '') || '_' || nullif(r_name, 'ASIA') AS key_null,
              replace(nullif(n_name, 'NATION_3'), '_', '') || '_' || coalesce(nullif(r_name, 'ASIA'), 'nan') AS key_token
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def _(t: Tables):
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    patient, when = F.nullif("n_name", F.lit("NATION_3")), F.nullif("r_name", F.lit("ASIA"))
    return named.select(
        "n_nationkey",
        sample_key(patient, when).alias("key_null"),
        sample_key(patient, when, "nan").alias("key_token"),
    )


@query(
    "B8_strip_affixes",
    """SELECT p_partkey, regexp_replace(regexp_replace(p_name || ':text-' || p_brand, '-.*', ''), ':.*', '') AS antigen,
              replace(p_name || '.csv', '.csv', '') AS sample FROM part""",
)
def _(t: Tables):
    tag = F.concat("p_name", F.lit(":text-"), "p_brand")
    return t.part.select(
        "p_partkey",
        before_mark(before_mark(tag, "-"), ":").alias("antigen"),
        without_suffix(F.concat("p_name", F.lit(".csv")), ".csv").alias("sample"),
    )


@query(
    "B9_split_column",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS first,
              CASE WHEN strpos(p_name, ' ') > 0 THEN split_part(p_name, ' ', 2) END AS second,
              CAST(NULL AS VARCHAR) AS third FROM part""",
)
def _(t: Tables):
    return split_column(t.part.select("p_partkey", "p_name"), "p_name", ["first", "second", "third"], " ")


@query(
    "B10_recode_by_table",
    """SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation FROM customer
       LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""",
)
def _(t: Tables):
    mapping = t.nation.filter("n_regionkey <> 2").select(F.col("n_nationkey").cast("string").alias("old"), "n_name")
    cells = t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return tidy.recode(cells, "nation", mapping, "old", "n_name")


@query(
    "B11_level_order",
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS o_orderpriority,
              CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 4
                   WHEN '5-LOW' THEN 1 END AS BIGINT) AS ord FROM orders""",
)
def _(t: Tables):
    levels = ["5-LOW", "2-HIGH", "1-URGENT", "3-MEDIUM"]
    return tidy.with_level_order(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", levels)


@query(
    "B12_filters",
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE l_linestatus = 'F' AND nullif(l_returnflag, 'N') <> 'R'""",
)
def _(t: Tables):
    kept = t.lineitem.filter((F.col("l_linestatus") == "F") & (F.nullif("l_returnflag", F.lit("N")) != "R"))
    return kept.select("l_orderkey", "l_linenumber")


@query(
    "B13_membership",
    """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P') IN ('F', 'X'), false) AS is_f FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def _(t: Tables):
    wanted = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    status = F.nullif("o_orderstatus", F.lit("P"))
    return tidy.keep_members(t.orders, "o_custkey", wanted).select("o_orderkey", member(status, ["F", "X"]).alias("is_f"))


@query(
    "B14_significance_filter",
    "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount < 0.05 AND abs(l_quantity - 25) > 20",
)
def _(t: Tables):
    tests = t.lineitem.withColumn("effect", F.col("l_quantity") - 25)
    return tidy.significant(tests, "l_discount", 0.05, "effect", 20, absolute=True).select(
        "l_orderkey", "l_linenumber", "l_discount"
    )


@query(
    "B15_drop_missing",
    """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal FROM customer
       WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 0""",
)
def _(t: Tables):
    return t.customer.select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
    ).dropna(subset=["segment", "c_acctbal"])


@query(
    "B16_fill_missing",
    """SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'Unassigned') AS label,
              CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END AS proba FROM customer""",
)
def _(t: Tables):
    return t.customer.select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("label"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("proba"),
    ).fillna({"label": "Unassigned", "proba": 0.0})


@query(
    "B17_casts",
    """SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, CAST(p_size AS DOUBLE) AS size,
              TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_number,
              TRY_CAST(p_name AS DOUBLE) AS not_a_number FROM part""",
)
def _(t: Tables):
    return t.part.select(
        "p_partkey",
        F.col("p_size").cast("string").alias("size_text"),
        F.col("p_size").cast("double").alias("size"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("double").alias("brand_number"),
        F.col("p_name").try_cast("double").alias("not_a_number"),
    )


@query(
    "B18_scalar_math",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0 THEN log10(l_tax) END, 9) AS log_tax,
              round_even(100 * l_discount, 2) AS percent, round(l_discount / nullif(l_tax, 0), 9) AS ratio,
              round(sqrt(abs(l_quantity - 25)), 9) AS root FROM lineitem""",
)
def _(t: Tables):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        r(F.log10("l_tax"), 9).alias("log_tax"),
        F.bround(100 * F.col("l_discount"), 2).alias("percent"),
        r(share("l_discount", "l_tax"), 9).alias("ratio"),
        r(F.sqrt(F.abs(F.col("l_quantity") - 25)), 9).alias("root"),
    )


@query(
    "B19_B20_keys_as_column",
    "SELECT DISTINCT p_name AS gene FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_discount > 0.09",
)
def _(t: Tables):
    strong = t.lineitem.filter("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(strong, "p_partkey", "left_semi").select(F.col("p_name").alias("gene")).distinct()


def _brand_signatures(t: Tables):
    """Signature = brand, genes = part names; part sizes 1 to 10 stand for the detected genes."""
    return t.part.select(F.col("p_brand").alias("signature"), F.col("p_name").alias("gene"))


@query(
    "B21_feature_coverage",
    """WITH s AS (SELECT DISTINCT p_brand AS signature, p_name AS gene FROM part),
            f AS (SELECT DISTINCT p_name AS gene FROM part JOIN lineitem ON p_partkey = l_partkey
                  WHERE l_extendedprice > 103000)
       SELECT signature, count(*) AS n_requested, count(f.gene) AS n_found, count(*) = count(f.gene) AS complete,
              coalesce(string_agg(CASE WHEN f.gene IS NULL THEN s.gene END, ',' ORDER BY s.gene), '') AS missing
       FROM s LEFT JOIN f ON s.gene = f.gene GROUP BY signature""",
)
def _(t: Tables):
    sold = t.lineitem.filter("l_extendedprice > 103000").select(F.col("l_partkey").alias("p_partkey"))
    detected = t.part.join(sold, "p_partkey", "left_semi").select(F.col("p_name").alias("gene"))
    covered = tidy.feature_coverage(_brand_signatures(t), detected)
    return covered.withColumn("missing", F.array_join("missing", ","))


@query(
    "B22_volcano_classes",
    """WITH d AS (SELECT p_name AS gene, avg(l_quantity) - 25.5 AS effect, avg(l_discount) AS p
                  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
       SELECT gene, round(effect, 6) AS effect, round(-log10(p), 6) AS neg_log10_p,
              CASE WHEN p < 0.05 AND abs(effect) > 0.25 THEN 'p-value and log2 FC' WHEN p < 0.05 THEN 'p-value'
                   WHEN abs(effect) > 0.25 THEN 'Log2 FC' ELSE 'NS' END AS volcano FROM d""",
)
def _(t: Tables):
    de = (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_name").alias("gene"))
        .agg((F.avg("l_quantity") - 25.5).alias("effect"), F.avg("l_discount").alias("p"))
    )
    marked = tidy.volcano_class(de, "effect", "p", 0.05, 0.25)
    return marked.select("gene", r("effect").alias("effect"), r("neg_log10_p").alias("neg_log10_p"), "volcano")


# --- joins ------------------------------------------------------------------------------


@query(
    "C1_left_join_mapping",
    """SELECT n_name, s_suppkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0)
       ON n_nationkey = s_nationkey""",
)
def _(t: Tables):
    mapping = t.supplier.filter("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return joins.map_ids(t.nation, mapping, "n_nationkey", keep_unmapped=True).select("n_name", "s_suppkey")


@query(
    "C3_join_features",
    """WITH f AS (SELECT unnest(['red ring', 'blue bolt', 'small ring', 'no such gene']) AS feature),
            e AS (SELECT l_orderkey AS cell_id, p_name AS feature, sum(l_quantity) AS v
                  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
       SELECT o_orderkey AS cell_id, f.feature, coalesce(v, 0) AS abundance
       FROM orders CROSS JOIN f LEFT JOIN e ON e.cell_id = o_orderkey AND e.feature = f.feature""",
)
def _(t: Tables):
    expr = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("cell_id"), F.col("p_name").alias("gene"), F.col("l_quantity").alias("logcount")
    )
    cells = t.orders.select(F.col("o_orderkey").alias("cell_id"))
    return joins.join_features(cells, expr, ["red ring", "blue bolt", "small ring", "no such gene"])


@query(
    "C4_attach_by_key",
    """SELECT o_orderkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN
       (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey""",
)
def _(t: Tables):
    annotation = t.customer.filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal"
    )
    return joins.attach(t.orders.select("o_orderkey", "o_custkey"), annotation, "o_custkey").drop("o_custkey")


@query(
    "C5_attach_by_ordinal",
    """WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
            b AS (SELECT user_id, event_type AS gate,
                         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
       SELECT a.event_id, a.user_id, b.gate FROM a JOIN b ON a.user_id = b.user_id AND a.rn = b.rn""",
)
def _(t: Tables):
    cells = t.events.select("event_id", "user_id", F.col("event_id").alias("row_idx"))
    # The gate file has its own numbering; only the order within a user agrees.
    gates = t.events.select("user_id", F.col("event_type").alias("gate"), (F.col("event_id") * 3 + 7).alias("row_idx"))
    return joins.attach_by_ordinal(cells, gates, "user_id").select("event_id", "user_id", "gate")


@query(
    "C6_map_ids",
    "SELECT DISTINCT n_name AS symbol, s_suppkey AS entrez FROM nation JOIN supplier ON n_nationkey = s_nationkey",
)
def _(t: Tables):
    mapping = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("entrez"))
    return joins.map_ids(t.nation, mapping, "n_nationkey").select(F.col("n_name").alias("symbol"), "entrez")


@query(
    "C6_Q5_unmapped_ids",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def _(t: Tables):
    mapped = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.unmapped_ids(t.customer, mapped, "c_custkey")


@query(
    "C7_sample_metadata",
    """SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t: Tables):
    samples = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "n_name"
    )
    cells = t.orders.select("o_orderkey", "o_custkey")
    return joins.add_sample_metadata(cells, samples, "o_custkey").drop("o_custkey")


@query(
    "C8_group_pairs",
    """WITH g AS (SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS g FROM orders)
       SELECT a.status, a.g AS group_1, b.g AS group_2 FROM g a JOIN g b ON a.status = b.status AND a.g < b.g""",
)
def _(t: Tables):
    groups = t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("g"))
    return joins.group_pairs(groups, "g", ["status"])


@query(
    "C9_check_aligned",
    """SELECT CAST(count(*) FILTER (WHERE other IS NULL) AS BIGINT) AS one_sided_keys,
              CAST(0 AS BIGINT) AS one_sided_nulls,
              round(avg(abs(x - y)) FILTER (x <> y) / avg(abs(x)) FILTER (x <> y), 9) AS mean_rel_diff, false AS aligned
       FROM (SELECT a.o_orderkey, a.o_totalprice AS x, b.y, b.o_orderkey AS other FROM orders a LEFT JOIN (
           SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1.001 ELSE 1 END AS y FROM orders
           WHERE o_orderstatus <> 'P') b ON a.o_orderkey = b.o_orderkey)""",
)
def _(t: Tables):
    factor = F.when(F.col("o_orderkey") % 2 == 0, 1.001).otherwise(1.0)
    other = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", (F.col("o_totalprice") * factor).alias("y"))
    checked = joins.check_aligned(t.orders, other, "o_orderkey", "o_totalprice", "y")
    return checked.withColumn("mean_rel_diff", r("mean_rel_diff", 9))


@query(
    "C10_terms_with_symbols",
    """SELECT c_mktsegment AS term, string_agg(DISTINCT n_name, '/' ORDER BY n_name) AS symbols
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def _(t: Tables):
    hits = t.customer.select(F.col("c_mktsegment").alias("term"), F.col("c_nationkey").alias("n_nationkey"))
    return joins.terms_with_symbols(hits, t.nation, ["term"], "n_nationkey", "n_name")


@query(
    "C11_complete_levels",
    """WITH c AS (SELECT p_brand, p_size, p_type, count(*) AS n FROM part GROUP BY ALL)
       SELECT a.p_brand, b.p_size, q.p_type, coalesce(n, 0) AS n
       FROM (SELECT DISTINCT p_brand FROM c) a CROSS JOIN (SELECT DISTINCT p_size FROM c) b
       CROSS JOIN (SELECT DISTINCT p_type FROM c) q LEFT JOIN c USING (p_brand, p_size, p_type)""",
)
def _(t: Tables):
    dims = ["p_brand", "p_size", "p_type"]
    counts = t.part.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    return joins.complete_levels(counts, dims, ["n"])


# --- aggregations -----------------------------------------------------------------------


@query("D1_count_per_group", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "D2_distinct_count",
    """SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS patients
       FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL""",
)
def _(t: Tables):
    kept = t.orders.filter("o_orderpriority <> '5-LOW'")
    return kept.groupBy("o_orderstatus", "o_orderpriority").agg(F.countDistinct("o_custkey").alias("patients"))


@query(
    "D3_mean_ignoring_missing",
    "SELECT event_type, round(avg(CASE WHEN value > 1 THEN value END), 6) AS mean FROM events GROUP BY ALL",
)
def _(t: Tables):
    seen = t.events.withColumn("value", F.when(F.col("value") > 1, F.col("value")))
    return seen.groupBy("event_type").agg(r(F.avg("value")).alias("mean"))


@query(
    "D4_S23_mean_se",
    """SELECT event_type, user_id, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
              round(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM events GROUP BY ALL""",
)
def _(t: Tables):
    stats = summary.mean_se(t.events, ["event_type", "user_id"], "value")
    return stats.select("event_type", "user_id", "n", *[r(c).alias(c) for c in ("mean", "sd", "se")])


@query(
    "D5_S13_sample_means",
    """SELECT c_custkey, min(c_mktsegment) AS segment, min(n_name) AS nation, round(avg(o_totalprice), 6) AS mean
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE o_orderstatus = 'F' GROUP BY c_custkey""",
)
def _(t: Tables):
    cells = (
        t.orders.filter("o_orderstatus = 'F'")
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return cells.groupBy("c_custkey").agg(
        constant_within("c_mktsegment", "segment"),
        constant_within("n_name", "nation"),
        r(F.avg("o_totalprice")).alias("mean"),
    )


@query("D6_frequency_table", "SELECT event_type AS label, count(*) AS count FROM events GROUP BY ALL")
def _(t: Tables):
    return t.events.groupBy(F.col("event_type").alias("label")).count()


@query(
    "D7_crosstab_with_zeros",
    """WITH c AS (SELECT n_name, o_orderpriority, p_size, count(*) AS n FROM lineitem
                  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
                  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
       SELECT a.n_name, b.o_orderpriority, d.p_size, coalesce(n, 0) AS n
       FROM (SELECT DISTINCT n_name FROM c) a
       CROSS JOIN (SELECT DISTINCT o_orderpriority FROM c UNION SELECT '0-NONE') b
       CROSS JOIN (SELECT DISTINCT p_size FROM c) d LEFT JOIN c USING (n_name, o_orderpriority, p_size)""",
)
def _(t: Tables):
    cells = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    )
    declared = {"o_orderpriority": ["0-NONE", *PRIORITIES]}
    return summary.crosstab(cells, ["n_name", "o_orderpriority", "p_size"], declared)


@query(
    "D10_group_profile",
    """SELECT n_name AS population, p_brand AS marker, round(avg(l_quantity), 6) AS mean FROM lineitem
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def _(t: Tables):
    profile = summary.group_profile(_supplier_markers(t), ["population", "marker"], "l_quantity")
    return profile.withColumn("mean", r("mean"))


def _supplier_markers(t: Tables):
    return (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("n_name").alias("population"), F.col("p_brand").alias("marker"), "l_quantity")
    )


@query(
    "D11_box_stats",
    """WITH q AS (SELECT c_mktsegment AS g, count(*) AS n, quantile_cont(c_acctbal, 0.25) AS q1,
                         quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3
                  FROM customer GROUP BY ALL)
       SELECT g AS c_mktsegment, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
              min(CASE WHEN c_acctbal >= q1 - 1.5 * (q3 - q1) THEN c_acctbal END) AS whisker_low,
              max(CASE WHEN c_acctbal <= q3 + 1.5 * (q3 - q1) THEN c_acctbal END) AS whisker_high,
              count(*) FILTER (WHERE c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1)) AS n_outliers
       FROM customer JOIN q ON c_mktsegment = g GROUP BY ALL""",
)
def _(t: Tables):
    stats = summary.box_stats(t.customer, ["c_mktsegment"], "c_acctbal")
    return stats.withColumns({c: r(c) for c in ("q1", "median", "q3")})


@query(
    "D11_box_stats_events",
    """WITH q AS (SELECT event_type AS g, count(*) AS n, quantile_cont(value, 0.25) AS q1,
                         quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
                  FROM events GROUP BY ALL)
       SELECT g AS event_type, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
              min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END) AS whisker_low,
              max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high,
              count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
       FROM events JOIN q ON event_type = g GROUP BY ALL""",
)
def _(t: Tables):
    stats = summary.box_stats(t.events, ["event_type"], "value")
    return stats.withColumns({c: r(c) for c in ("q1", "median", "q3")})


@query(
    "D12_binned_density",
    """WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 200 AS w FROM events),
            b AS (SELECT event_type, CAST(least(floor((value - lo) / w), 199) AS BIGINT) AS bin, lo, w FROM events, e),
            k AS (SELECT DISTINCT event_type, unnest(range(200)) AS bin FROM events),
            c AS (SELECT k.event_type, k.bin, count(b.event_type) AS n FROM k LEFT JOIN b USING (event_type, bin) GROUP BY ALL)
       SELECT event_type, bin, round(e.lo + bin * e.w, 6) AS bin_start, n,
              round(n / sum(n) OVER (PARTITION BY event_type), 9) AS share,
              round(n / sum(n) OVER (PARTITION BY event_type) / e.w, 9) AS density FROM c, e""",
)
def _(t: Tables):
    binned = summary.binned_density(t.events, ["event_type"], "value", 200)
    return binned.withColumns({"bin_start": r("bin_start"), "share": r("share", 9), "density": r("density", 9)})


@query(
    "D13_mad_outliers",
    """WITH m AS (SELECT c_nationkey AS k, median(c_acctbal) AS med FROM customer GROUP BY ALL),
            d AS (SELECT k, med, 1.4826 * median(abs(c_acctbal - med)) AS mad FROM customer JOIN m ON c_nationkey = k
                  GROUP BY ALL)
       SELECT c_custkey, round(med, 6) AS median, round(mad, 6) AS mad,
              CASE WHEN c_acctbal > med + 1.2 * mad THEN 'Fail' ELSE 'Pass' END AS qc
       FROM customer JOIN d ON c_nationkey = k""",
)
def _(t: Tables):
    flagged = summary.mad_flag(t.customer, "c_acctbal", ["c_nationkey"], 1.2)
    return flagged.select("c_custkey", r("median").alias("median"), r("mad").alias("mad"), "qc")


# --- shares, z-scores, ranks ------------------------------------------------------------


@query(
    "D14_W1_share_of_total",
    """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
       SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total,
              round(n / sum(n) OVER (PARTITION BY o_orderstatus), 9) AS share FROM c""",
)
def _(t: Tables):
    counts = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return summary.share_of_total(counts, "n", ["o_orderstatus"]).withColumn("share", r("share", 9))


@query(
    "W2_zscore_within_gene",
    """WITH m AS (SELECT p_name AS gene, n_name AS sample, avg(l_quantity) AS mean FROM lineitem
                  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
                  JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
       SELECT gene, sample, round(mean, 6) AS mean,
              round((mean - avg(mean) OVER (PARTITION BY gene)) / nullif(stddev_samp(mean) OVER (PARTITION BY gene), 0), 6)
                AS z_score FROM m""",
)
def _(t: Tables):
    means = (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("p_name").alias("gene"), F.col("n_name").alias("sample"))
        .agg(F.avg("l_quantity").alias("mean"))
    )
    scored = summary.zscore_within(means, "mean", ["gene"])
    return scored.select("gene", "sample", r("mean").alias("mean"), r("z_score").alias("z_score"))


@query(
    "C2_W3_zscore_vs_global",
    """WITH e AS (SELECT n_name AS population, p_brand AS marker, l_quantity AS x FROM lineitem
                  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
                  JOIN part ON l_partkey = p_partkey),
            p AS (SELECT population, marker, avg(x) AS pop_mean FROM e GROUP BY ALL),
            g AS (SELECT marker, avg(x) AS global_mean, stddev_samp(x) AS global_sd FROM e GROUP BY ALL)
       SELECT population, marker, round(pop_mean, 6) AS pop_mean, round(global_mean, 6) AS global_mean,
              round(global_sd, 6) AS global_sd, round((pop_mean - global_mean) / nullif(global_sd, 0), 6) AS z_score
       FROM p JOIN g USING (marker)""",
)
def _(t: Tables):
    scored = summary.zscore_vs_global(_supplier_markers(t), "population", "marker", "l_quantity")
    return scored.withColumns({c: r(c) for c in ("pop_mean", "global_mean", "global_sd", "z_score")})


@query(
    "W4_average_ranks",
    """WITH h AS (SELECT l_returnflag, l_extendedprice, count(*) AS n FROM lineitem GROUP BY ALL)
       SELECT *, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS DOUBLE) - (n - 1) / 2.0
              AS avg_rank FROM h""",
)
def _(t: Tables):
    return scan.average_ranks(t.lineitem, ["l_returnflag"], "l_extendedprice")


@query(
    "W6_ordinal_in_sample",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events",
)
def _(t: Tables):
    numbered = scan.with_position(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"])
    return numbered.select("event_id", "rn")


@query(
    "W7_batch_groups",
    """SELECT p_name, row_number() OVER (ORDER BY p_name) AS pos,
              CAST(ceil(row_number() OVER (ORDER BY p_name) / 11) AS BIGINT) AS batch
       FROM (SELECT DISTINCT p_name FROM part)""",
)
def _(t: Tables):
    return tidy.batch_groups(t.part, "p_name", 11)


@query(
    "exact_quantiles",
    """SELECT l_shipmode AS g, count(*) AS n, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90
       FROM (SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS l_shipmode, l_extendedprice AS x FROM lineitem)
       GROUP BY ALL""",
)
def _(t: Tables):
    keyed = t.lineitem.select(F.nullif("l_returnflag", F.lit("N")).alias("g"), F.col("l_extendedprice").alias("x"))
    found = scan.exact_quantiles(keyed, ["g"], "x", {"p10": 0.1, "p90": 0.9})
    return found.withColumns({"p10": r("p10"), "p90": r("p90")})


# --- composition studies ----------------------------------------------------------------


def _cohort(t: Tables):
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )


_COHORT_SQL = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
                 JOIN nation ON c_nationkey = n_nationkey"""


def population_shares(t: Tables):
    """Share of each population per sample type and outcome among the selected cells."""
    selected = (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 48)
    dims = ["n_name", "o_orderpriority", "l_returnflag"]
    shares = summary.composition(_cohort(t), dims, ["o_orderpriority", "l_returnflag"], selected)
    return shares.withColumn("share", r("share", 6))


query(
    "S22_population_shares",
    f"""WITH c AS (SELECT n_name, o_orderpriority, l_returnflag, count(*) AS n FROM {_COHORT_SQL}
                   WHERE l_linestatus = 'F' AND l_quantity >= 48 GROUP BY ALL),
             f AS (SELECT a.n_name, b.o_orderpriority, d.l_returnflag, coalesce(n, 0) AS n
                   FROM (SELECT DISTINCT n_name FROM c) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM c) b
                   CROSS JOIN (SELECT DISTINCT l_returnflag FROM c) d
                   LEFT JOIN c USING (n_name, o_orderpriority, l_returnflag))
        SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderpriority, l_returnflag) AS BIGINT) AS total,
               round(n / nullif(sum(n) OVER (PARTITION BY o_orderpriority, l_returnflag), 0), 6) AS share FROM f""",
)(population_shares)


@query(
    "S22_two_call_comparison",
    f"""WITH c AS (SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM {_COHORT_SQL} GROUP BY ALL)
        SELECT *, CAST(sum(n) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS total,
               round(100 * n / sum(n) OVER (PARTITION BY c_mktsegment), 6) AS percent FROM c""",
)
def _(t: Tables):
    table = summary.composition(_cohort(t), ["c_mktsegment", "o_orderstatus"], ["c_mktsegment"])
    return table.select("c_mktsegment", "o_orderstatus", "n", "total", r(100 * F.col("share")).alias("percent"))


@query(
    "S22_lineage_only_shares",
    f"""WITH l AS (SELECT unnest(['NATION_1', 'NATION_2', 'NATION_3', 'NO CELLS']) AS n_name),
             c AS (SELECT n_name, o_orderstatus, count(*) AS n FROM {_COHORT_SQL}
                   WHERE n_name IN (SELECT n_name FROM l) GROUP BY ALL),
             f AS (SELECT l.n_name, b.o_orderstatus, coalesce(n, 0) AS n FROM l
                   CROSS JOIN (SELECT DISTINCT o_orderstatus FROM c) b LEFT JOIN c USING (n_name, o_orderstatus))
        SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total,
               round(n / nullif(sum(n) OVER (PARTITION BY o_orderstatus), 0), 6) AS share FROM f""",
)
def _(t: Tables):
    stages = ["NATION_1", "NATION_2", "NATION_3", "NO CELLS"]
    table = summary.composition(
        _cohort(t), ["n_name", "o_orderstatus"], ["o_orderstatus"], member("n_name", stages), {"n_name": stages}
    )
    return table.withColumn("share", r("share", 6))


@query(
    "S22_empty_stratum",
    """WITH l AS (SELECT unnest(['1-URGENT', '9-NEVER']) AS o_orderpriority),
            c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
            f AS (SELECT l.o_orderpriority, b.o_orderstatus, coalesce(n, 0) AS n FROM l
                  CROSS JOIN (SELECT DISTINCT o_orderstatus FROM c) b LEFT JOIN c USING (o_orderpriority, o_orderstatus))
       SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS total,
              round(n / nullif(sum(n) OVER (PARTITION BY o_orderpriority), 0), 6) AS share FROM f""",
)
def _(t: Tables):
    table = summary.composition(
        t.orders,
        ["o_orderpriority", "o_orderstatus"],
        ["o_orderpriority"],
        levels={"o_orderpriority": ["1-URGENT", "9-NEVER"]},
    )
    return table.withColumn("share", r("share", 6))


# --- sorting, sets, reshaping -----------------------------------------------------------


def _placed(df):
    """The position of each row in the order in which the rows come."""
    return scan.with_position(df.withColumn("__at", F.monotonically_increasing_id()), [], ["__at"], "position").drop("__at")


@query(
    "T1_sort_by_levels",
    """SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END,
              o_orderkey) AS position FROM orders""",
)
def _(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    return _placed(tidy.order_by_levels(rows, "o_orderstatus", ["P", "F"], "o_orderkey"))


@query(
    "T1_sort_by_first_seen",
    """SELECT event_id, event_type, row_number() OVER (ORDER BY latest DESC, event_id) AS position
       FROM (SELECT event_id, event_type, max(event_id) OVER (PARTITION BY event_type) AS latest FROM events)""",
)
def _(t: Tables):
    rows = t.events.select("event_id", "event_type")
    seen = t.events.select("event_type", (-F.col("event_id")).alias("event_id"))
    return _placed(tidy.order_by_first_seen(rows, "event_type", seen, "event_id"))


@query(
    "T2_sorted_results",
    """SELECT *, row_number() OVER (ORDER BY p_value, gene) AS position FROM (
           SELECT p_name AS gene, round(avg(l_discount), 9) AS p_value FROM lineitem JOIN part ON l_partkey = p_partkey
           GROUP BY ALL)""",
)
def _(t: Tables):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    table = joined.groupBy(F.col("p_name").alias("gene")).agg(r(F.avg("l_discount"), 9).alias("p_value"))
    return _placed(table.orderBy("p_value", "gene"))


@query(
    "Q1_union_distinct",
    """SELECT p_name AS gene FROM part WHERE p_size < 3 UNION SELECT p_name FROM part WHERE p_size > 48
       UNION SELECT p_name FROM part WHERE p_type = 'ECONOMY'""",
)
def _(t: Tables):
    gene = F.col("p_name").alias("gene")
    return tidy.union_distinct(
        t.part.filter("p_size < 3").select(gene),
        t.part.filter("p_size > 48").select(gene),
        t.part.filter("p_type = 'ECONOMY'").select(gene),
    )


@query(
    "Q2_concat_frames",
    """SELECT 'orders' AS source, o_orderstatus AS status, count(*) AS n, CAST(NULL AS DOUBLE) AS mean FROM orders GROUP BY ALL
       UNION ALL SELECT 'lines', l_linestatus, NULL, round(avg(l_tax), 9) FROM lineitem GROUP BY ALL""",
)
def _(t: Tables):
    first = t.orders.groupBy(F.lit("orders").alias("source"), F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )
    second = t.lineitem.groupBy(F.lit("lines").alias("source"), F.col("l_linestatus").alias("status")).agg(
        r(F.avg("l_tax"), 9).alias("mean")
    )
    return tidy.concat_frames([first, None, second])


@query("Q3_distinct", "SELECT DISTINCT l_suppkey FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_suppkey").distinct()


@query(
    "Q4_present_features",
    """SELECT p_brand AS signature, p_name AS gene FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 50
       AND p_type = 'SMALL')""",
)
def _(t: Tables):
    detected = t.part.filter("p_size = 50 AND p_type = 'SMALL'").select(F.col("p_name").alias("gene"))
    return tidy.present_features(_brand_signatures(t), detected)


@query(
    "Q5_absent_features",
    """SELECT p_brand AS signature, p_name AS gene FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 50
       AND p_type = 'SMALL')""",
)
def _(t: Tables):
    detected = t.part.filter("p_size = 50 AND p_type = 'SMALL'").select(F.col("p_name").alias("gene"))
    return tidy.absent_features(_brand_signatures(t), detected)


@query(
    "X1_wide_to_long",
    """SELECT l_orderkey, l_linenumber, marker, expression FROM
       (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
       UNPIVOT (expression FOR marker IN (l_quantity, l_extendedprice, l_discount, l_tax))""",
)
def _(t: Tables):
    wide = t.lineitem.select("l_orderkey", "l_linenumber", *MEASURES)
    return reshape.to_long(wide, ["l_orderkey", "l_linenumber"], name="marker", value="expression")


@query(
    "X1_D10_long_profile",
    """SELECT l_returnflag, marker, round(avg(expression), 6) AS mean FROM
       (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
       UNPIVOT (expression FOR marker IN (l_quantity, l_extendedprice, l_discount, l_tax)) GROUP BY ALL""",
)
def _(t: Tables):
    long = reshape.to_long(t.lineitem.select("l_returnflag", *MEASURES), ["l_returnflag"], name="marker", value="x")
    return summary.group_profile(long, ["l_returnflag", "marker"], "x").withColumn("mean", r("mean"))


@query(
    "X2_long_to_wide",
    """SELECT p_brand, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS A,
              round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS N,
              round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS R
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def _(t: Tables):
    profile = summary.group_profile(
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")), ["p_brand", "l_returnflag"], "l_quantity"
    )
    wide = reshape.to_wide(profile, ["p_brand"], "l_returnflag", "mean", ["A", "N", "R"])
    return wide.withColumns({c: r(c) for c in "ANR"})


@query(
    "X4_wide_features",
    """SELECT o_orderkey AS cell_id, coalesce(sum(l_quantity) FILTER (WHERE p_name = 'red ring'), 0) AS "red ring",
              coalesce(sum(l_quantity) FILTER (WHERE p_name = 'blue bolt'), 0) AS "blue bolt"
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def _(t: Tables):
    expr = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("cell_id"), F.col("p_name").alias("gene"), F.col("l_quantity").alias("logcount")
    )
    return reshape.wide_features(t.orders.select(F.col("o_orderkey").alias("cell_id")), expr, ["red ring", "blue bolt"])
