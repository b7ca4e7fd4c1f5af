"""Domain operators against dense brute force on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.functions import tails
from cohortframe.operators import embed, enrich, glm, graph, markers, metric, neighbours, pseudobulk, ranksums, score


@pytest.fixture(scope="module")
def cohort(spark):
    """60 cells, 12 genes, few distinct values, one cell without any."""
    rng = np.random.default_rng(7)
    dense = np.round(rng.poisson(1.0, (60, 12)) * 0.5, 1)
    dense[3] = 0
    cells = [f"c{i}" for i in range(60)]
    genes = [f"g{j}" for j in range(12)]
    groups = list(rng.choice(["a", "b", "d"], 60))
    expr = [(cells[i], genes[j], float(dense[i, j])) for i in range(60) for j in range(12) if dense[i, j]]
    frame = spark.createDataFrame(expr, "cell_id STRING, gene STRING, logcount DOUBLE")
    table = spark.createDataFrame(list(zip(cells, groups)), "cell_id STRING, label STRING")
    return dense, genes, np.array(groups), frame, table


def test_welch(cohort):
    dense, genes, groups, expr, cells = cohort
    got = {(r.gene, r.label, r.other): r for r in markers.marker_ttest(expr, cells, "label").collect()}
    assert len(got) == 12 * 6
    for (gene, a, b), row in got.items():
        x, y = (dense[groups == g, genes.index(gene)] for g in (a, b))
        va, vb = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
        assert row.log_fc == pytest.approx(x.mean() - y.mean())
        assert row.t == pytest.approx((x.mean() - y.mean()) / math.sqrt(va + vb))
        assert row.df == pytest.approx((va + vb) ** 2 / (va**2 / (len(x) - 1) + vb**2 / (len(y) - 1)))
        assert row.p_value == pytest.approx(tails.t_sf(np.array([row.t]), np.array([row.df]))[0])


@pytest.mark.parametrize("lfc, block_rows", [(0.0, 10_000), (0.5, 10_000), (0.5, 5)])
def test_wilcoxon(cohort, lfc, block_rows):
    dense, genes, groups, expr, cells = cohort
    got = markers.marker_wilcox(expr, cells, "label", lfc=lfc, block_rows=block_rows).collect()
    assert len(got) == 12 * 6
    for row in got:
        x, y = (dense[groups == g, genes.index(row.gene)] for g in (row.label, row.other))
        y = y + lfc
        u = (x[:, None] > y).sum() + 0.5 * (x[:, None] == y).sum()
        _, t = np.unique(np.concatenate([x, y]), return_counts=True)
        n = len(x) + len(y)
        sigma = math.sqrt(len(x) * len(y) / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
        assert (row.u, row.n, row.n_other) == (u, len(x), len(y))
        assert row.z == pytest.approx((u - len(x) * len(y) / 2 - 0.5) / sigma)


def test_both_directions_make_all_pairs(cohort):
    _, _, _, expr, cells = cohort
    got = {(r.gene, r.label, r.other): r for r in markers.marker_wilcox(expr, cells, "label", with_p=False).collect()}
    for (gene, a, b), row in got.items():
        assert row.u + got[(gene, b, a)].u == row.n * row.n_other


def test_strata_and_combination(spark, cohort):
    _, _, _, expr, cells = cohort
    halves = cells.withColumn("half", F.pmod(F.xxhash64("cell_id"), F.lit(2)))
    pairs = markers.marker_ttest(expr, halves, "label", ["half"])
    assert pairs.select("half").distinct().count() == 2
    combined = markers.combine_markers(pairs, "label", "log_fc", ["half"]).toPandas()
    raw = pairs.toPandas().dropna()
    for row in combined.itertuples():
        mine = raw[(raw.half == row.half) & (raw.label == row.label) & (raw.gene == row.gene)].sort_values("p_value")
        simes = (mine.p_value * len(mine) / np.arange(1, len(mine) + 1)).min()
        assert row.p_value == pytest.approx(min(1, simes))
        assert row.summary_log_fc == pytest.approx(mine.log_fc.iloc[0])
    assert (combined.fdr >= combined.p_value - 1e-12).all()


def test_two_groups_combine_to_themselves(cohort):
    _, _, _, expr, cells = cohort
    pairs = markers.marker_ttest(expr, cells.filter("label <> 'd'"), "label")
    combined = {(r.label, r.gene): r for r in markers.combine_markers(pairs, "label", "log_fc").collect()}
    for row in pairs.collect():
        assert combined[(row.label, row.gene)].p_value == pytest.approx(row.p_value)


@pytest.mark.parametrize("shift, block_rows, batch", [(0.0, 10**6, 10_000), (0.0, 20, 3), (0.5, 15, 7), (0.5, 10**6, 1)])
def test_rank_sums_of_all_pairs(spark, shift, block_rows, batch):
    rng = np.random.default_rng(6)
    rows = [(k, g, float(v), int(n)) for k in ["a", None, "c"] for g in range(6) for v, n in zip(rng.choice(40, 12, replace=False) / 4, rng.integers(1, 5, 12))]
    rows += [("d", 1, 0.0, 3), ("e", 2, 1.0, 10**4), ("e", 3, 1.0, 10**4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "key STRING, g INT, v DOUBLE, n BIGINT")
        ranked = ranksums.rank_sums(df, ["key"], "g", "v", shift=shift, block_rows=block_rows)
        got = {(r.key, r.g, r.other): tuple(r[3:]) for r in ranked.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k in {r[0] for r in rows}:
        held = {g: [(v, n) for kk, gg, v, n in rows if kk == k and gg == g] for g in {r[1] for r in rows if r[0] == k}}
        for a in held:
            for b in held:
                if a != b:
                    u = sum(n * m * ((x > y + shift) + (x == y + shift) / 2) for x, n in held[a] for y, m in held[b])
                    ties = {}
                    for x, n in [*held[a], *((y + shift, m) for y, m in held[b])]:
                        ties[x] = ties.get(x, 0) + n
                    want[k, a, b] = (sum(n for _, n in held[a]), sum(n for _, n in held[b]), u, float(sum(t**3 - t for t in ties.values())))
    assert got == want


def test_histogram_is_not_copied_per_group(spark):
    rows = [("k", g, float(v), 1) for g in range(12) for v in range(30)]
    df = spark.createDataFrame(rows, "key STRING, g INT, v DOUBLE, n BIGINT")
    ranked = ranksums.rank_sums(df, ["key"], "g", "v")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Relation") == 1
    assert ranked.count() == 12 * 11


def test_pairwise_ranksum_rules(spark):
    rows = [("f", "a", 1.0), ("f", "a", 2.0), ("f", "a", 3.5), ("f", "b", 4.0), ("f", "b", 5.0), ("f", "b", 6.0), ("f", "b", 7.0)]
    rows += [("f", "lonely", 9.0), ("f", "b", None), ("t", "a", 1.0), ("t", "a", 2.0), ("t", "b", 2.0), ("t", "b", 3.0)]
    df = spark.createDataFrame(rows, "family STRING, g STRING, x DOUBLE")
    got = {r.family: r for r in markers.pairwise_ranksum(df, "x", "g", ["family"]).collect()}
    assert set(got) == {"f", "t"}
    assert (got["f"].u, got["f"].n_1, got["f"].n_2) == (0.0, 3, 4)
    assert got["f"].p_value == pytest.approx(2 / 35) and got["f"].adj_p_value == pytest.approx(2 / 35)
    z = (0.5 - 2.0 + 0.5) / math.sqrt(4 / 12 * (5 - 6 / 12))
    assert got["t"].p_value == pytest.approx(2 * tails.normal_sf(np.array([-z]))[0])


@pytest.mark.parametrize("normaliser", ["trimmed", "plain"])
@pytest.mark.parametrize("max_rank", [4, 12])
def test_rank_score_equals_dense_ranks(spark, cohort, normaliser, max_rank):
    dense, genes, _, expr, cells = cohort
    signatures = {"one": ["g0", "g5", "g7"], "two": ["g5", "absent"], "three": ["g1"]}
    table = spark.createDataFrame([(s, g) for s, gs in signatures.items() for g in gs], "signature STRING, gene STRING")
    got = score.rank_score(cells, expr, table, 12, max_rank=max_rank, normaliser=normaliser).toPandas()
    assert len(got) == 60 * 3 and got["score"].between(0, 1).all()
    ranks = pd.DataFrame(-dense).rank(axis=1).to_numpy()
    zero = np.array([(dense[i] > 0).sum() + (12 - (dense[i] > 0).sum() + 1) / 2 for i in range(60)])
    for row in got.itertuples():
        i = int(row.cell_id[1:])
        r = np.array([ranks[i, genes.index(g)] if g in genes else zero[i] for g in signatures[row.signature]])
        n = len(r)
        if (r > max_rank).all():
            want = 0.0
        else:
            u = np.where(r > max_rank, max_rank + 1, r).sum() - n * (n + 1) / 2
            want = max(0.0, 1 - u / (n * max_rank - (n * (n + 1) / 2 if normaliser == "trimmed" else 0)))
        assert row.score == pytest.approx(want)


def test_enrichment_of_an_urn(spark):
    terms = spark.createDataFrame([("t", g) for g in "abcd"] + [("u", g) for g in "defghij"] + [("tiny", "a")], "term STRING, gene STRING")
    hits = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "e"), ("x", "unannotated"), ("x", "a")], "l STRING, gene STRING")
    symbols = spark.createDataFrame([(g, g.upper()) for g in "abcdefghij"], "gene STRING, symbol STRING")
    got = enrich.enrich(hits, terms, ["l"], symbols=symbols, min_size=2, p_cutoff=None, q_cutoff=None).collect()
    by_term = {r.term: r for r in got}
    assert set(by_term) == {"t", "u"}
    row = by_term["t"]
    assert (row.gene_ratio, row.bg_ratio, row.genes) == ("2/3", "4/10", "A/B")
    assert row.p_value == pytest.approx((6 * 6 + 4) / 120)
    assert enrich.enrich(hits.drop("l"), terms, min_size=2, p_cutoff=None, q_cutoff=None).count() == 2
    assert enrich.enrich(hits, terms, ["l"], min_size=2, p_cutoff=0.01).count() == 0


# --- pseudobulk -------------------------------------------------------------------------


def _bulk(spark, matrix, samples):
    rows = [(s, f"g{i:04d}", int(v)) for i, line in enumerate(matrix) for s, v in zip(samples, line) if v]
    return spark.createDataFrame(rows, "sample STRING, gene STRING, count BIGINT")


def test_equal_libraries_need_no_scaling(spark):
    line = np.arange(1, 41)
    bulk = _bulk(spark, np.column_stack([line, line * 2, line * 3]), ["a", "b", "c"])
    got = pseudobulk.tmm_factors(bulk).toPandas()
    assert list(got["norm_factor"]) == pytest.approx([1.0, 1.0, 1.0])


def test_factors_multiply_to_one(spark):
    rng = np.random.default_rng(0)
    bulk = _bulk(spark, rng.negative_binomial(3, 0.05, (200, 4)), list("abcd"))
    assert np.prod(pseudobulk.tmm_factors(bulk).toPandas()["norm_factor"]) == pytest.approx(1.0)


def test_pseudobulk_keeps_every_count(spark):
    expr = spark.createDataFrame([("c1", "g", 2), ("c2", "g", 3), ("c2", "h", 1), ("c3", "h", 4)], "cell_id STRING, gene STRING, count BIGINT")
    cells = spark.createDataFrame([("c1", "s", None), ("c2", "s", None), ("c3", "t", "p"), ("c4", "t", "p")], "cell_id STRING, a STRING, b STRING")
    got = sorted(tuple(r) for r in pseudobulk.pseudobulk(expr, cells, ["a", "b"]).collect())
    assert got == [("s", None, "g", 5, 2), ("s", None, "h", 1, 2), ("t", "p", "h", 4, 2)]


def test_closed_form_two_groups(spark):
    """With equal libraries the group means are the estimates, so the ratio is known."""
    matrix = np.array([[10, 12, 30, 33], [7, 7, 7, 7], [500, 480, 510, 495]])
    samples = ["a1", "a2", "b1", "b2"]
    bulk = _bulk(spark, matrix, samples)
    factors = spark.createDataFrame([(s, 1000.0, 1.0) for s in samples], "sample STRING, lib_size DOUBLE, norm_factor DOUBLE")
    table = spark.createDataFrame([(s, s[0]) for s in samples], "sample STRING, group STRING")
    design = glm.design_matrix(table, {"group": None})
    phi = 0.05
    dispersion = bulk.select("gene").distinct().withColumn("dispersion", F.lit(phi))
    got = {r.gene: r for r in glm.pseudobulk_de(bulk, factors, design, {"b": "groupb"}, dispersion=dispersion).collect()}

    def loglik(y, mu):
        return sum(
            math.lgamma(v + 1 / phi) - math.lgamma(1 / phi) - math.lgamma(v + 1)
            - math.log(1 + phi * mu) / phi + v * math.log(phi * mu / (1 + phi * mu))
            for v in y
        )

    for i, line in enumerate(matrix):
        a, b = line[:2], line[2:]
        ratio = 2 * (loglik(a, a.mean()) + loglik(b, b.mean()) - loglik(line, line.mean()))
        row = got[f"g{i:04d}"]
        assert row.lr == pytest.approx(ratio, abs=1e-6)
        assert row.p_value == pytest.approx(tails.chi2_1_sf(np.array([max(ratio, 0)]))[0], abs=1e-6)
        assert row.log_fc == pytest.approx(math.log2(b.mean() / a.mean()), abs=0.05)


def test_simulated_effects_are_found(spark):
    rng = np.random.default_rng(5)
    patients, groups, genes, phi = range(6), ["x", "y"], 300, 0.1
    samples = [f"p{p}{g}" for p in patients for g in groups]
    base = rng.gamma(2.0, 60.0, genes)
    effect = np.where(np.arange(genes) < 30, 3.0, 1.0)
    columns = []
    for p in patients:
        shift = rng.lognormal(0, 0.3, genes)
        for g in groups:
            mu = base * shift * (effect if g == "y" else 1.0) * rng.uniform(0.7, 1.4)
            columns.append(rng.negative_binomial(1 / phi, 1 / (1 + phi * mu)))
    bulk = _bulk(spark, np.column_stack(columns), samples)
    table = spark.createDataFrame([(s, s[:2], s[2]) for s in samples], "sample STRING, patient STRING, group STRING")
    design = glm.design_matrix(table, {"patient": None, "group": "x"})
    factors = pseudobulk.tmm_factors(bulk)
    dispersion = glm.estimate_dispersion(bulk, factors, design)
    assert dispersion.first().common == pytest.approx(phi, rel=0.5)
    assert dispersion.filter("at_bound").count() < genes / 10
    got = glm.pseudobulk_de(bulk, factors, design, {"y": "groupy", "x": {"groupy": -1}}, dispersion=dispersion, method="BH").toPandas()
    y, x = (got[got.contrast == c].set_index("gene").sort_index() for c in "yx")
    assert list(y.p_value) == pytest.approx(list(x.p_value), abs=1e-6)
    assert list(y.log_fc) == pytest.approx(list(-x.log_fc), abs=1e-6)
    true = y.index < "g0030"
    assert (y[true].adj_p_value < 0.05).mean() > 0.9 and (y[~true].adj_p_value < 0.05).mean() < 0.1
    assert y[true].log_fc.mean() == pytest.approx(math.log2(3), abs=0.25)


def _simulated(rng, genes, samples, phi_of, scatter=None):
    base = np.exp(rng.uniform(np.log(20), np.log(5000), genes))
    phi = phi_of(base) * (rng.chisquare(scatter, genes) / scatter if scatter else 1.0)
    library = rng.uniform(0.7, 1.4, samples)
    mu = base[:, None] * library
    return base, phi, rng.negative_binomial(1 / phi[:, None], 1 / (1 + phi[:, None] * mu))


def _two_groups(spark, samples):
    rows = [(f"s{k:02d}", "ab"[k % 2]) for k in range(samples)]
    return [r[0] for r in rows], glm.design_matrix(spark.createDataFrame(rows, "sample STRING, group STRING"), {"group": None})


def test_dispersion_follows_a_trend(spark):
    samples, design = _two_groups(spark, 10)
    base, phi, counts = _simulated(np.random.default_rng(11), 1500, 10, lambda m: 0.03 + 4.0 / m)
    bulk = _bulk(spark, counts, samples)
    got = glm.estimate_dispersion(bulk, pseudobulk.tmm_factors(bulk), design).toPandas().sort_values("gene")
    assert len(got) == 1500 and got.converged.mean() > 0.99
    ratio = got.trended.to_numpy() / phi
    assert (np.abs(np.log(ratio)) < np.log(1.5)).mean() > 0.99
    # All genes follow the trend, so that it is trusted far.
    assert got.prior_df.iloc[0] > 30
    assert np.median(np.abs(np.log(got.dispersion / phi))) < 0.15


def test_prior_follows_the_scatter_of_genes(spark):
    samples, design = _two_groups(spark, 12)
    found = []
    for scatter in (4, 30):
        _, _, counts = _simulated(np.random.default_rng(12), 1200, 12, lambda m: 0.1 + 0 * m, scatter)
        bulk = _bulk(spark, counts, samples)
        found.append(glm.estimate_dispersion(bulk, pseudobulk.tmm_factors(bulk), design).first().prior_df)
    assert 1.5 < found[0] < 12 < found[1]


def test_curves_that_do_not_converge_are_left_out(spark, monkeypatch):
    samples, design = _two_groups(spark, 6)
    _, _, counts = _simulated(np.random.default_rng(13), 60, 6, lambda m: 0.1 + 0 * m)
    bulk, profile = _bulk(spark, counts, samples), glm._profile
    factors = pseudobulk.tmm_factors(bulk)
    curves = glm.profile_curves(bulk, factors, design).toPandas()
    assert curves.converged.all()
    # By hand: the largest gene's curve is spoilt and marked.
    worst = curves.gene[curves.level.idxmax()]
    spoilt = spark.createDataFrame(curves.assign(converged=curves.gene != worst, curve=[[1e6 * v for v in c] if g == worst else c for g, c in zip(curves.gene, curves.curve)]))
    monkeypatch.setattr(glm, "profile_curves", lambda *a, **k: spoilt)
    got = glm.estimate_dispersion(bulk, factors, design, prior_df=5.0).toPandas().set_index("gene")
    assert not got.converged[worst] and got.converged.sum() == 59
    assert 0.03 < got.common.iloc[0] < 0.3 and (got.trended < 1).all()
    assert profile is glm._profile


def test_digamma_and_its_kin():
    assert glm._digamma(1.0) == pytest.approx(-0.5772156649015329) and glm._trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    assert glm._trigamma_inverse(glm._trigamma(3.7)) == pytest.approx(3.7)
    assert glm._trigamma_inverse(glm._trigamma(250.0)) == pytest.approx(250.0)


def test_design_rejects_confounding(spark):
    table = spark.createDataFrame([("a", "p", "x"), ("b", "q", "y")], "sample STRING, patient STRING, group STRING")
    with pytest.raises(ValueError, match="told apart"):
        glm.design_matrix(table, {"patient": None, "group": None})


# --- neighbours and graphs --------------------------------------------------------------


def _vectors(spark, matrix, name="cell_id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(matrix)], f"{name} BIGINT, embedding ARRAY<DOUBLE>")


@pytest.mark.parametrize("blocks", [{}, {"query_rows": 30, "reference_rows": 17}])
def test_neighbours_by_brute_force(spark, blocks):
    rng = np.random.default_rng(2)
    q, r = rng.normal(size=(80, 5)).round(1), rng.normal(size=(60, 5)).round(1)
    r[10:25] = r[10]
    got = neighbours.nearest(_vectors(spark, q), _vectors(spark, r, "ref_id"), 7, **blocks).toPandas()
    for i in range(80):
        distance = np.sqrt(((q[i] - r) ** 2).sum(axis=1)).round(12)
        want = sorted(range(60), key=lambda j: (distance[j], j <= i, j))[:7]
        mine = got[got.cell_id == i].sort_values("rank")
        assert list(mine.ref_id) == want
        assert list(mine.distance) == pytest.approx(list(distance[want]))


def _clustered(rng, rows, clusters=80, dim=6):
    return rng.normal(size=(clusters, dim))[rng.integers(0, clusters, rows)] * 20 + rng.normal(size=(rows, dim))


def test_pruned_search_looks_at_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    both = _clustered(rng, 7000)
    q, r = both[:1000], both[1000:]
    seen, search = [], metric.search

    def counting(pairs, index, *rest):
        seen.append(pairs.join(index.blocks, "block").agg(F.sum("n")).first()[0] + 2 * len(index.pivots) * len(q))
        return search(pairs, index, *rest)

    monkeypatch.setattr(metric, "search", counting)
    got = neighbours.nearest(_vectors(spark, q), _vectors(spark, r, "ref_id"), 5, reference_rows=200).toPandas()
    assert sum(seen) <= 0.1 * len(q) * len(r)
    for i in range(0, 1000, 7):
        distance = np.sqrt(((q[i] - r) ** 2).sum(axis=1))
        assert list(got[got.cell_id == i].sort_values("rank").ref_id) == list(np.argsort(distance)[:5])


def test_queries_travel_once_to_a_block_of_many_cells(spark, monkeypatch):
    # Nothing to prune: every query has to see nearly all of some 40 cells, which share a few blocks.
    rng = np.random.default_rng(21)
    r = rng.normal(size=(1600, 16)).round(2)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(r)], "cell_id BIGINT, embedding ARRAY<FLOAT>")
    sent, search = [], metric.search

    def counting(pairs, *rest):
        sent.append(pairs.count())
        return search(pairs, *rest)

    monkeypatch.setattr(metric, "search", counting)
    got = neighbours.nearest(df, df.withColumnRenamed("cell_id", "ref_id"), 4, exclude_self=True, reference_rows=400).toPandas()
    assert sent[0] == len(r) and sent[1] <= len(r) * 2 * len(r) / 400
    x = r.astype(np.float32).astype(float)
    for i in range(0, len(r), 37):
        distance = np.sqrt(((x[i] - x) ** 2).sum(axis=1))
        want = sorted((j for j in range(len(r)) if j != i), key=lambda j: (distance[j], j <= i, j))[:4]
        mine = got[got.cell_id == i].sort_values("rank")
        assert list(mine.ref_id) == want and list(mine.distance) == pytest.approx(list(distance[want]))


def test_far_queries_of_a_block_of_copies():
    # Queries far outside all cells, whose first tile says little about the next; each reference stands three times.
    rng = np.random.default_rng(23)
    refs = np.repeat(rng.normal(size=(400, 3)).round(1), 3, axis=0)[rng.permutation(1200)]
    queries, pivots = rng.normal(size=(60, 3)) + np.linspace(5, 90, 60)[:, None], rng.normal(size=(9, 3))
    away = metric._away(queries, pivots)
    cell = metric._away(refs, pivots).argmin(axis=1)
    after, same = rng.integers(0, 1200, 60), rng.integers(-1, 1200, 60)
    known = cell, pivots, away.argmin(axis=1), away.min(axis=1), np.full(60, np.inf)
    got = pd.concat(pd.DataFrame({"q": i, "p": p, "d": d}) for i, p, d in neighbours._nearest_in_block(queries, after, same, refs, 7, *known))
    for i in range(60):
        distance = np.sqrt(((queries[i] - refs) ** 2).sum(axis=1))
        want = sorted((j for j in range(1200) if j != same[i]), key=lambda j: (distance[j], (j - after[i]) % 1200))[:7]
        assert list(got[got.q == i].p) == want


def test_index_is_read_in_bounded_pieces():
    # As many rows as an Arrow batch has, and as many pivots as there are at most: no table of all their distances.
    import pyarrow as pa
    rng, seen = np.random.default_rng(22), []
    x, pivots = rng.normal(size=(3000, 4)), rng.normal(size=(metric.PIVOTS, 4))

    class Rows:
        schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(list(x))], names=["i", "v"])
    for part in metric._with_cell(Rows(), pivots)(iter([batch])):
        seen.append(part.num_rows)
        near = ((np.vstack(part.column(1).to_numpy(zero_copy_only=False))[:, None] - pivots) ** 2).sum(axis=2)
        assert list(part.column(2).to_numpy()) == list(near.argmin(axis=1))
    assert sum(seen) == len(x) and max(seen) * len(pivots) <= 1_000_000


@pytest.mark.parametrize("k", [3, 40])
def test_pruned_search_of_copies_rings_and_lone_rows(spark, k):
    # A crowd of copies, one large cell to cut into rings, far rows, and more neighbours wanted than a block holds.
    rng = np.random.default_rng(9)
    r = np.vstack([np.zeros((60, 3)), rng.normal(size=(200, 3)).round(2), rng.normal(size=(6, 3)) * 1e4, [[0.5, 0, 0]] * 5])
    df = _vectors(spark, r)
    got = neighbours.nearest(df, df.withColumnRenamed("cell_id", "ref_id"), k, exclude_self=True, reference_rows=10).toPandas()
    for i in range(0, len(r), 3):
        distance = np.sqrt(((r[i] - r) ** 2).sum(axis=1))
        want = sorted((j for j in range(len(r)) if j != i), key=lambda j: (distance[j], j <= i, j))[:k]
        mine = got[got.cell_id == i].sort_values("rank")
        assert list(mine.ref_id) == want, i


def test_few_or_no_rows_to_search(spark):
    df, none = _vectors(spark, np.arange(12.0).reshape(4, 3)), _vectors(spark, np.zeros((0, 3)), "ref_id")
    assert neighbours.nearest(df, none, 2).count() == 0
    found = neighbours.nearest(df, df.withColumnRenamed("cell_id", "ref_id"), 9, reference_rows=1)
    assert found.count() == 16


def test_copies_do_not_make_hubs(spark):
    matrix = np.vstack([np.ones((150, 3)), np.random.default_rng(1).normal(size=(60, 3)) + 9])
    df = _vectors(spark, matrix)
    found = neighbours.nearest(df, df.withColumnRenamed("cell_id", "ref_id"), 5, exclude_self=True, reference_rows=1000)
    named = found.filter("cell_id < 150").groupBy("ref_id").count().agg(F.max("count")).first()[0]
    assert named <= 5 * 2


def test_vote_ties_and_error_cut(spark):
    ref = spark.createDataFrame(
        [("r1", [0.0], "b"), ("r2", [1.0], "a"), ("r3", [10.0], "a"), ("r4", [11.0], "a")],
        "ref_id STRING, embedding ARRAY<DOUBLE>, label STRING",
    )
    query = spark.createDataFrame(
        [("q1", [0.4], "d"), ("q2", [10.4], "d"), ("q3", [0.5], "d"), ("q4", [900.0], "d"), ("q5", [10.6], "d")],
        "cell_id STRING, embedding ARRAY<DOUBLE>, individual STRING",
    )
    labels = {r.cell_id: (r.initial_label, r.proba) for r in neighbours.knn_label_transfer(query, ref, 2).collect()}
    assert labels["q1"] == ("b", 0.5) and labels["q3"] == ("a", 0.5) and labels["q2"] == ("a", 1.0)
    errors = neighbours.mapping_error(query, ref, ["individual"])
    assert {r.cell_id for r in errors.collect() if r.qc == "Fail"} == {"q4"}
    final = neighbours.with_quality(neighbours.knn_label_transfer(query, ref, 2), errors)
    assert {r.cell_id: r.final_label for r in final.collect()}["q4"] is None


def test_separate_clusters_become_communities(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [20, 0], [0, 20]])
    matrix = np.vstack([c + rng.normal(size=(40, 2)) for c in centres])
    edges = graph.snn_graph(_vectors(spark, matrix), 6)
    assert edges.filter("src >= dst").count() == 0
    found = graph.communities(edges).toPandas().sort_values("node")
    truth = np.repeat([0, 1, 2], 40)
    for _, part in found.groupby("community"):
        assert len(set(truth[part["node"]])) == 1
    best = graph.modularity(edges, spark.createDataFrame(found)).first()[0]
    planted = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "node BIGINT, community BIGINT")
    assert best >= graph.modularity(edges, planted).first()[0] - 0.05


def test_two_triangles(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 1.0)], "src INT, dst INT, weight DOUBLE")
    found = {r.node: r.community for r in graph.communities(edges).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    parts = spark.createDataFrame(list(found.items()), "node INT, community INT")
    assert graph.modularity(edges, parts).first()[0] == pytest.approx(6 / 7 - 2 * (7 / 14) ** 2)


def _spans(nodes, edges, community):
    """Communities that fall apart when only the edges inside them are left, by walking through them."""
    near = {n: set() for n in nodes}
    for a, b, _ in edges:
        if community[a] == community[b]:
            near[a].add(b)
            near[b].add(a)
    broken = 0
    for c in set(community.values()):
        held = {n for n in nodes if community[n] == c}
        seen, todo = set(), [min(held)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near[n]
        broken += seen != held
    return broken


def test_communities_hang_together(spark):
    rng = np.random.default_rng(14)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 90, 170), rng.integers(0, 90, 170), rng.integers(1, 6, 170))]
    df = spark.createDataFrame(edges, "src INT, dst INT, weight DOUBLE")
    rows = graph.communities(df).collect()
    community = {r.node: r.community for r in rows}
    assert set(community) == {x for a, b, _ in edges for x in (a, b)} and all(community[c] == c for c in community.values())
    assert _spans(list(community), edges, community) == 0
    assert len({r.settled for r in rows}) == 1
    total = sum(w for *_, w in edges)
    inside = sum(w for a, b, w in edges if community[a] == community[b])
    degree = {}
    for a, b, w in edges:
        for x in (a, b):
            degree[community[x]] = degree.get(community[x], 0) + w
    mine = inside / total - sum(d * d for d in degree.values()) / (4 * total * total)
    assert graph.modularity(df, spark.createDataFrame(list(community.items()), "node INT, community INT")).first()[0] == pytest.approx(mine)
    assert mine > 0.5


def test_refinement_cuts_a_community_that_hangs_by_nothing(spark):
    # Two triangles in one community without an edge between them, and a third that leans on a fourth node.
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (6, 7, 1.0), (6, 6, 2.0)]
    both, nodes = graph._nodes_of(spark.createDataFrame(edges, "src INT, dst INT, weight DOUBLE"))
    state = nodes.withColumn("community", F.when(F.col("node") < 6, 0).otherwise(6))
    parts = {r.node: r.part for r in graph._refined(both, state, 1.0).collect()}
    groups = {frozenset(n for n in parts if parts[n] == p) for p in set(parts.values())}
    assert all(g <= {0, 1, 2} or g <= {3, 4, 5} or g <= {6, 7} for g in groups) and len(groups) < 8


def test_connected_components(spark):
    rng = np.random.default_rng(15)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(400, 470)]
    nodes = spark.createDataFrame([(n,) for n in range(480)], "node INT")
    got = {r.node: r.component for r in graph.connected_components(nodes, spark.createDataFrame(edges, "src INT, dst INT")).collect()}
    label = list(range(480))
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == dict(enumerate(label))


def test_variance_trend(spark):
    rng = np.random.default_rng(16)
    x = rng.uniform(-3, 3, 2000)
    rows = [(f"g{k:04d}", float(np.exp(v)), float(np.exp(0.3 + 1.2 * v - 0.08 * v * v))) for k, v in enumerate(x)]
    rows += [("none", 0.0, 0.0), ("flat", 1.0, 0.0), ("wild", 1.0, 50.0)]
    got = pseudobulk.trended_residuals(spark.createDataFrame(rows, "gene STRING, mean DOUBLE, variance DOUBLE")).toPandas().set_index("gene")
    assert len(got) == 2001 and got.drop("wild").residual.abs().max() < 0.05
    assert got.residual.idxmax() == "wild"
    assert (got.trend + got.residual).to_numpy() == pytest.approx(np.log(got.variance.to_numpy()))


# --- components -------------------------------------------------------------------------


def test_cell_pca_matches_svd(spark):
    matrix = np.random.default_rng(3).normal(size=(50, 4)) * [5, 3, 1, 0.5] + 10
    scores, explained = embed.cell_pca(_vectors(spark, matrix), 2)
    got = np.vstack(scores.orderBy("cell_id").toPandas()["pca"])
    centred = matrix - matrix.mean(axis=0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u * s)[:, :2], abs=1e-8)
    assert [r.explained for r in explained.orderBy("component").collect()] == pytest.approx(list((s**2 / (s**2).sum())[:2]))


def test_sample_pca_matches_svd(spark):
    matrix = np.random.default_rng(8).normal(size=(6, 30))
    rows = [(f"s{i}", f"g{j}", float(matrix[i, j])) for i in range(6) for j in range(30)]
    rows += [(f"s{i}", "flat", 2.0) for i in range(6)]
    long = spark.createDataFrame(rows, "sample STRING, gene STRING, log_cpm DOUBLE").repartition(5)
    got = embed.sample_pca(long, 3).orderBy("sample").toPandas()[["PC1", "PC2", "PC3"]].to_numpy()
    z = (matrix - matrix.mean(axis=0)) / matrix.std(axis=0, ddof=1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u * s)[:, :3], abs=1e-8)


def test_projection_counts_zeros(spark):
    loadings = spark.createDataFrame([("g", 1.0, 2.0, [1.0, -1.0]), ("h", 3.0, 1.0, [0.5, 2.0]), ("flat", 1.0, 0.0, [9.0, 9.0])], "gene STRING, mean DOUBLE, sd DOUBLE, weights ARRAY<DOUBLE>")
    expr = spark.createDataFrame([("c1", "g", 5.0)], "cell_id STRING, gene STRING, logcount DOUBLE")
    cells = spark.createDataFrame([("c1", "d"), ("c2", "e")], "cell_id STRING, donor STRING")
    placed = embed.project(expr, cells, loadings, 2)
    got = {r.cell_id: r.embedding for r in placed.collect()}
    assert got["c1"] == pytest.approx([2.0 - 1.5, -2.0 - 6.0]) and got["c2"] == pytest.approx([-0.5 - 1.5, 0.5 - 6.0])
    moved = [r.embedding for r in embed.align_donors(placed, "donor").collect()]
    assert moved[0] == pytest.approx(moved[1])


@pytest.mark.parametrize("block", [1, 2, 100])
def test_profile_distance(spark, block):
    long = spark.createDataFrame([("a", "x", 3.0), ("b", "y", 4.0), ("c", "x", 3.0)], "p STRING, f STRING, v DOUBLE")
    got = sorted(tuple(r) for r in embed.profile_distances(long, "p", "f", "v", block=block).collect())
    assert got == [("a", "b", 5.0), ("a", "c", 0.0), ("b", "c", 5.0)]
