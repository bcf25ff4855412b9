"""Operators on Spark against NumPy, and files read back."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegeno.functions import kernels as k
from sparsegeno.functions.passes import collect_matrix
from sparsegeno.operators import covariance, frequency, genotype, inbreeding, pca, scans
from sparsegeno.sources import reads, sinks, text

SITES, SAMPLES = 60, 8


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    f = rng.uniform(0.15, 0.85, (SITES, 2))[:, rng.integers(0, 2, SAMPLES)]
    g = rng.binomial(2, f)
    depth = rng.poisson(3, g.shape)
    alt = rng.binomial(depth, np.array([0.01, 0.5, 0.99])[g])
    w = np.stack([0.99 ** (depth - alt) * 0.01**alt, 0.5**depth, 0.01 ** (depth - alt) * 0.99**alt])
    w /= w.sum(0)
    return w[0], w[1]


@pytest.fixture(scope="module")
def panel(spark, data):
    l0, l1 = data
    rows = [(i, l0[i].tolist(), l1[i].tolist()) for i in range(SITES)]
    return spark.createDataFrame(rows, "site_idx long, l0 array<double>, l1 array<double>").repartition(3).cache()


def column(df, name):
    return np.array([r[name] for r in df.orderBy("site_idx").select(name).collect()])


def em(data, tol=1e-6):
    l0, l1 = data
    f = k.em_step(l0, l1, np.full(SITES, 0.25))
    for n in range(1, 501):
        f1 = k.em_step(l0, l1, f)
        f2 = k.em_step(l0, l1, f1)
        u, v = f1 - f, f2 - f1 - (f1 - f)
        c = min(max(-(u @ u) / (u @ v), 1), 256)
        new = k.em_step(l0, l1, np.clip((1 - c) * f1 + c * f2, 1e-5, 1 - 1e-5))
        done = np.sqrt(((new - f) ** 2).mean()) < tol
        f = new
        if done:
            break
    return f, n


def test_frequencies(panel, data):
    fit = frequency.allele_frequencies(panel)
    f, rounds = em(data)
    assert fit.converged and fit.rounds == rounds
    assert np.allclose(column(fit.panel, "f"), f, atol=1e-9)


def test_hard_calls_stop_at_once(spark):
    rows = [(i, [1.0, 0.0, 0.0], [0.0, 1.0, float(i % 2)]) for i in range(6)]
    fit = frequency.allele_frequencies(spark.createDataFrame(rows, "site_idx long, l0 array<double>, l1 array<double>"))
    assert fit.rounds == 1 and fit.converged


def test_empty_panel(spark):
    none = spark.createDataFrame([], "site_idx long, l0 array<double>, l1 array<double>")
    assert frequency.allele_frequencies(none).panel.count() == 0
    assert covariance.covariance(frequency.em_steps(none, 2)).count() == 0


def fitted(panel):
    return frequency.filter_maf(frequency.em_steps(panel, 5))


def test_individual_frequencies(panel, data):
    model = pca.fit_pi(fitted(panel), 2, fixed_rounds=4)
    l0, l1 = data
    f = k.em_step(l0, l1, np.full(SITES, 0.25))
    for _ in range(4):
        f = k.em_step(l0, l1, f)
    keep = (f >= 0.05) & (f <= 0.95)
    l0, l1, f = l0[keep], l1[keep], f[keep]
    e = k.dosage(l0, l1, f[:, None]) - 2 * f[:, None]
    for step in range(5):
        u, s, vt = np.linalg.svd(e, full_matrices=False)
        pi = k.clamp_pi(u[:, :2] * s[:2] @ vt[:2], f)
        if step < 4:
            e = k.dosage(l0, l1, pi) - 2 * f[:, None]
    assert np.allclose(column(model.panel, "pi"), pi, atol=1e-8)
    z = k.standardised(l0, l1, pi, f)
    cov = z.T @ z / len(f)
    np.fill_diagonal(cov, k.spread(l0, l1, pi, f).mean(0))
    assert np.allclose(collect_matrix(model.cov), cov, atol=1e-8)

    rows = scans.scans(model.panel, 2)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(column(rows, "selection"), len(f) * u[:, :2] ** 2, atol=1e-6)
    b = u[:, :2] * s[:2]
    sd = np.sqrt(((z - b @ vt[:2]) ** 2).sum(1) / (SAMPLES - 2))[:, None]
    assert np.allclose(np.abs(column(rows, "pcadapt")), np.abs(b / sd), atol=1e-6)
    assert np.allclose(np.abs(column(rows, "weight")), np.abs(u[:, :2] * s[:2] ** 2 / len(f)), atol=1e-8)
    far = scans.p_values(scans.distances(rows, components=2).select("site_idx", "d2"), "d2", 2)
    p = column(far, "p")
    assert ((p >= 0) & (p <= 1)).all() and p.max() > 0.5


def test_inbreeding(panel, data):
    rows = covariance.as_pi(fitted(panel)).cache()
    l0, l1 = np.array(column(rows, "l0")), np.array(column(rows, "l1"))
    pi = column(rows, "pi")
    x, _, _ = inbreeding.per_sample(rows, SAMPLES, fixed_rounds=1)

    def step(v):
        seen, want = k.heterozygosity(l0, l1, pi, v[None, :])
        return np.clip(1 - seen.sum(0) / want.sum(0), -1, 1)

    s0 = step(np.zeros(SAMPLES))
    s1, s2 = step(s0), step(step(s0))
    u, v = s1 - s0, s2 - s1 - (s1 - s0)
    c = min(max(-(u @ u) / (u @ v), 1), 256)
    assert np.allclose(x, step(np.clip((1 - c) * s1 + c * s2, -1, 1)), atol=1e-9)
    fit = inbreeding.per_site(rows)
    lrt = column(inbreeding.likelihood_ratios(fit.panel), "lrt")
    assert np.isfinite(lrt).all()
    calls = column(genotype.calls(rows, 0.9), "call")
    assert set(np.unique(calls)) <= {0, 1, 2, -9}


@pytest.mark.parametrize(("samples", "sites", "n"), [(2000, 150, 3), (40, 25, 30), (30, 60, 2)])
def test_leading_vectors_without_the_whole_matrix(spark, samples, sites, n):
    rng = np.random.default_rng(6)
    e = rng.normal(size=(sites, samples)) + 2 * rng.normal(size=(sites, 3)) @ rng.normal(size=(3, samples))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "site_idx long, e array<double>").repartition(3).cache()
    _, s2, vt = np.linalg.svd(e, full_matrices=False)
    for start in (None, np.eye(samples)[:, :n]):
        v, s = pca.leading(rows, n, start, direct=0)
        assert np.allclose(v.T @ v, np.eye(n))
        rank = min(n, sites)
        assert np.allclose(s[:rank], s2[:rank])
        assert np.allclose(v[:, :rank] @ v[:, :rank].T, vt[:rank].T @ vt[:rank], atol=1e-6)
    with pytest.raises(ValueError):
        pca.leading(rows, samples, direct=0)


def test_individual_frequencies_of_many_samples(panel, monkeypatch):
    whole = pca.fit_pi(fitted(panel), 2, fixed_rounds=3).panel
    want, scores = column(whole, "pi"), column(scans.scans(whole, 2), "selection")
    monkeypatch.setattr(pca.leading, "__defaults__", (None, 0))
    part = pca.fit_pi(fitted(panel), 2, fixed_rounds=3).panel
    assert np.allclose(column(part, "pi"), want, atol=1e-7)
    assert np.allclose(column(scans.scans(part, 2), "selection"), scores, atol=1e-5)


def test_sums_of_wide_matrices(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 700))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "site_idx long, e array<double>").repartition(5)
    assert np.allclose(collect_matrix(covariance.gram(rows)), x.T @ x)
    assert np.allclose(collect_matrix(covariance.gram(rows, mean=True)), x.T @ x / 30)


def test_beagle_round_trip(spark, panel, data, tmp_path):
    path = f"{tmp_path}/beagle"
    sinks.write_beagle(panel, path)
    back = text.scan_beagle(spark, path, check=True)
    assert np.allclose(column(back, "l0"), data[0]) and np.allclose(column(back, "l1"), data[1])
    mask = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(SITES)], "site_idx long, keep int")
    part = text.scan_beagle(spark, path, mask, [1, 0, 1, 1, 0, 1, 1, 1])
    assert np.allclose(column(part, "l0"), data[0][::3][:, [0, 2, 3, 5, 6, 7]])
    with pytest.raises(ValueError):
        text.scan_beagle(spark, path, mask, [2] * SAMPLES)


def test_hard_call_files(spark, tmp_path):
    codes = [[3, 1, 2, 0, 0], [0, 0, 3, 2, 1]]
    packed = bytes(sum(c << 2 * i for i, c in enumerate(row[:4])) for row in codes)
    assert packed[0] == 0b00100111
    body = b"".join(bytes([sum(c << 2 * i for i, c in enumerate(r[:4])), r[4]]) for r in codes)
    (tmp_path / "x.bed").write_bytes(b"\x6c\x1b\x01" + body)
    (tmp_path / "x.fam").write_text("a\n" * 5)
    rows = text.scan_plink(spark, str(tmp_path / "x"))
    table = {0: (1, 0), 1: (0.333333, 0.333333), 2: (0, 1), 3: (0, 0)}
    for name, at in (("l0", 0), ("l1", 1)):
        assert np.allclose(column(rows, name), [[table[c][at] for c in r] for r in codes])
    worked = spark.createDataFrame([(0, b"\xe4")], "site_idx long, codes binary")
    assert column(text.decode_bed(worked, 4), "l0").tolist() == [[1.0, 0.333333, 0.0, 0.0]]


def test_masks_vectors_and_names(spark, panel, tmp_path):
    (tmp_path / "mask").write_text("1\n0\n1\n")
    assert [tuple(r) for r in text.load_mask(spark, str(tmp_path / "mask")).orderBy("site_idx").collect()] == [(0, 1), (1, 0), (2, 1)]
    (tmp_path / "bad").write_text("1\n2\n")
    with pytest.raises(Exception, match="0 and 1"):
        text.load_mask(spark, str(tmp_path / "bad")).collect()
    odd = panel.where("site_idx % 2 = 1")
    (tmp_path / "lrt").write_text("".join(f"{i}.5\n" for i in range(SITES // 2)))
    vector = text.load_vector(spark, str(tmp_path / "lrt"))
    assert column(text.attach_vector(odd, vector), "lrt").tolist() == [i + 0.5 for i in range(SITES // 2)]
    with pytest.raises(ValueError):
        text.attach_vector(panel, vector)
    assert text.load_names(spark, None, 3).count() == 3


def test_text_sinks(spark, panel, tmp_path):
    rows = covariance.as_pi(fitted(panel))
    sinks.write_posteriors(genotype.posteriors(rows), f"{tmp_path}/post")
    lines = [r[0] for r in text.numbered_lines(spark, f"{tmp_path}/post").orderBy("line").select("value").collect()]
    assert len(lines) == rows.count() and all(len(x.split("\t")) == 3 * SAMPLES for x in lines)
    sinks.write_site_matrix(rows, "pi", f"{tmp_path}/pi", files=1)
    lines = text.numbered_lines(spark, f"{tmp_path}/pi").orderBy("line").collect()
    assert np.allclose([[float(v) for v in r["value"].split()] for r in lines], column(rows, "pi"), atol=1e-7)


def test_panel_from_reads(spark):
    rows = spark.createDataFrame([(4, 0, 1), (4, 0, 0), (4, 2, 1)], "site_idx long, sample_idx int, alt int")
    got = reads.panel_from_reads(rows, 3).first()
    w = np.array([0.99 * 0.01, 0.25, 0.99 * 0.01])
    assert got["l0"][0] == pytest.approx(w[0] / w.sum())
    assert got["l0"][1] == pytest.approx(1 / 3)
    w = np.array([0.01, 0.5, 0.99])
    assert got["l1"][2] == pytest.approx(w[1] / w.sum())


def test_sites_kept_and_hwe(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 30.0), (3, float("nan"))], "site_idx long, lrt double")
    kept = frequency.filter_hwe(rows)
    assert [r[0] for r in kept.select("site_idx").collect()] == [1]
    flags = frequency.sites_kept(rows, kept).orderBy("site_idx").select("keep").collect()
    assert [r[0] for r in flags] == [1, 0, 0]
    assert rows.where(F.isnan("lrt")).count() == 1
