"""The whole job on a small table, and its refusals."""

from __future__ import annotations

import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparsegeno.functions.passes import collect_matrix
from sparsegeno.jobs import run as job
from sparsegeno.operators import admixture, covariance, frequency, genotype, inbreeding, pca, scans
from sparsegeno.sources import text


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    rng = np.random.default_rng(3)
    f = rng.uniform(0.2, 0.8, (40, 2))[:, [0, 0, 0, 1, 1, 1]]
    g = rng.binomial(2, f)
    like = np.full((40, 6, 3), 0.05)
    for k in range(3):
        like[..., k] += (g == k) * 0.85
    lines = ["marker a b " + " ".join(f"I{i} " * 3 for i in range(6))]
    lines += [f"s{j} 0 1 " + " ".join(f"{x:.6f}" for x in like[j].ravel()) for j in range(40)]
    path = tmp_path_factory.mktemp("in") / "table.txt"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_everything(spark, table, tmp_path):
    out = str(tmp_path / "out")
    flags = (
        "--selection --pcadapt --snp-weights --inbreed-sites --inbreed-samples --post --post-inbreed --tree --admix"
        " --maf-save --pi-save --dosage-save --sites-save --geno 0.5 --geno-inbreed 0.5 --admix-iter 2 --admix-batch 2"
        " --iter 3 --eig 1 --inbreed-iter 3"
    )
    log = job.run(spark, job.parser().parse_args(["--beagle", table, "--out", out, *flags.split()]))
    assert log["samples"] == 6 and log["components"] == 1
    sites = log["sites"]
    for name, lines in {
        "cov": 6, "selection": sites, "weights": sites, "pcadapt.zscores": sites, "inbreed.sites": sites, "lrt.sites": sites,
        "inbreed.samples": 6, "post": sites, "post.inbreed": sites, "admix.2.Q": 6, "admix.2.P": sites, "freqs": sites,
        "sites": 40, "tree.cov": 6, "tree": 1, "log": 1,
    }.items():
        assert text.numbered_lines(spark, f"{out}/{name}").count() == lines, name
    for name in ("geno", "geno.inbreed", "dosage", "pi", "pcadapt.pvalues"):
        assert spark.read.parquet(f"{out}/{name}").count() == sites, name


def numbers(spark, path):
    return np.array([[float(x) for x in line.split()] for line in lines(spark, path)])


def test_values_of_the_files(spark, table, tmp_path):
    """Every file holds what its operator gives for the same panel, in the order of sites and samples."""
    out = str(tmp_path / "out")
    flags = (
        "--selection --pcadapt --snp-weights --inbreed-sites --inbreed-samples --post --tree --admix --maf-save --pi-save --dosage-save"
        " --npy --geno 0.5 --geno-inbreed 0.5 --admix-iter 3 --admix-batch 2 --iter 3 --eig 1 --inbreed-iter 3 --tree-samples"
    )
    (tmp_path / "names").write_text("".join(f"tip{i}\n" for i in range(6)))
    args = ["--beagle", table, "--out", out, *flags.split(), str(tmp_path / "names")]
    log = job.run(spark, job.parser().parse_args(args))
    panel = frequency.filter_maf(frequency.allele_frequencies(text.scan_beagle(spark, table)).panel)
    model = pca.fit_pi(panel, 1, most_rounds=3)
    rows = model.panel.orderBy("site_idx").cache()

    def column(df, name):
        return np.array([r[0] for r in df.orderBy("site_idx").select(name).collect()])

    def close(name, want, digits=2e-6):
        got = numbers(spark, f"{out}/{name}")
        assert np.allclose(got.reshape(np.shape(want)), want, atol=digits), name

    close("cov", collect_matrix(model.cov))
    close("freqs", column(rows, "f"))
    scanned = scans.scans(rows, 1).cache()
    close("selection", column(scanned, "selection"), 1e-4)
    for name, own in (("weights", "weight"), ("pcadapt.zscores", "pcadapt")):
        assert np.allclose(np.abs(numbers(spark, f"{out}/{name}")), np.abs(column(scanned, own)), atol=1e-5)
    per = inbreeding.likelihood_ratios(inbreeding.per_site(rows, 1e-5, 3).panel)
    close("inbreed.sites", column(per, "inbreed"))
    close("lrt.sites", column(per, "lrt"), 1e-5)
    inbred, _, _ = inbreeding.per_sample(rows, 6, 1e-5, 3)
    close("inbreed.samples", inbred)
    posts = genotype.posteriors(rows)
    close("post", np.stack([column(posts, c) for c in ("p0", "p1", "p2")], axis=2).reshape(len(column(rows, "f")), -1))
    between = covariance.pi_covariance(rows)
    close("tree.cov", collect_matrix(between))
    tips = {r["name"]: (r["depth"], r["length"]) for r in text.load_tree(spark, f"{out}/tree").collect()}
    edges = {r["child"]: (r["parent"], r["length"]) for r in spark.read.parquet(f"{out}/tree.edges").collect()}

    def depth(node):
        return 0 if node == "root" else 1 + depth(edges[node][0])

    # one component leaves several trees of equal length, so the text is compared with the edges, not with another run
    assert tips == {n: (depth(n), pytest.approx(edges[n][1], abs=1e-6)) for n in edges if n.startswith("tip")}
    assert set(tips) == {f"tip{i}" for i in range(6)}
    fit = admixture.admix(rows, 6, 2, most_rounds=3, batches=2)
    close("admix.2.Q", fit.q, 1e-5)
    close("admix.2.P", column(fit.panel, "anc"), 1e-5)
    assert log["log_likelihood"] == pytest.approx(fit.log_likelihood)
    wanted = {
        "pi": column(rows, "pi"),
        "dosage": column(covariance.dosage_out(rows), "e"),
        "geno": column(genotype.calls(rows, 0.5), "call"),
        "geno.inbreed": column(genotype.calls(rows, 0.5, inbred), "call"),
    }
    for name, want in wanted.items():
        own = {"pi": "pi", "dosage": "e"}.get(name, "call")
        assert np.allclose(column(spark.read.parquet(f"{out}/{name}"), own), want, atol=1e-6), name
        found = np.load(f"{out}/{name}.npy")
        assert found.dtype == (np.int8 if own == "call" else np.float32) and np.allclose(found, want, atol=1e-6), name
    found = json.loads(lines(spark, f"{out}/log")[0])
    assert found["sites"] == len(column(rows, "f")) and found["samples"] == 6 and found["options"]["iter"] == 3


def test_no_rounds_are_the_null_model(spark, table, tmp_path):
    out = str(tmp_path / "out")
    args = ["--beagle", table, "--out", out, "--iter", "0", "--inbreed-sites", "--inbreed-samples"]
    job.run(spark, job.parser().parse_args(args))
    panel = frequency.filter_maf(frequency.allele_frequencies(text.scan_beagle(spark, table)).panel)
    assert np.allclose(numbers(spark, f"{out}/cov"), collect_matrix(covariance.covariance(panel)), atol=2e-6)
    per = inbreeding.likelihood_ratios(inbreeding.per_site(covariance.as_pi(panel)).panel).orderBy("site_idx").collect()
    assert np.allclose(numbers(spark, f"{out}/ngsf.inbreed.sites")[:, 0], [r["inbreed"] for r in per], atol=2e-6)
    assert np.allclose(numbers(spark, f"{out}/ngsf.lrt.sites")[:, 0], [r["lrt"] for r in per], atol=1e-5)
    inbred, _, _ = inbreeding.per_sample(covariance.as_pi(panel), 6)
    assert np.allclose(numbers(spark, f"{out}/ngsf.inbreed.samples")[:, 0], inbred, atol=2e-6)


def test_refusals(spark, table, tmp_path):
    for flags in (["--post-inbreed"], ["--maf", "0.7"]):
        with pytest.raises(SystemExit):
            job.run(spark, job.parser().parse_args(["--beagle", table, "--out", str(tmp_path), *flags]))
    with pytest.raises(SystemExit):
        job.validate(job.parser().parse_args(["--plink", "x", "--out", "y", "--filter", "z"]))


def lines(spark, path):
    return [r["value"] for r in text.numbered_lines(spark, path).orderBy("line").collect()]


def test_sites_of_the_input_are_flagged_under_a_mask(spark, table, tmp_path):
    mask = [int(i % 4 != 0) for i in range(40)]
    (tmp_path / "mask").write_text("\n".join(map(str, mask)) + "\n")
    out = str(tmp_path / "out")
    flags = ["--filter-sites", str(tmp_path / "mask"), "--sites-save", "--maf-save", "--model", "population", "--maf", "0.3"]
    job.run(spark, job.parser().parse_args(["--beagle", table, "--out", out, *flags]))
    kept = [int(x) for x in lines(spark, f"{out}/sites")]
    assert len(kept) == 40 and all(k <= m for k, m in zip(kept, mask, strict=True))
    assert 0 < sum(kept) < sum(mask) and sum(kept) == len(lines(spark, f"{out}/freqs"))


def test_likelihood_ratios_of_one_run_filter_the_next(spark, table, tmp_path):
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    common = ["--beagle", table, "--model", "population"]
    job.run(spark, job.parser().parse_args([*common, "--out", first, "--inbreed-sites"]))
    found = [float(x) for x in lines(spark, f"{first}/ngsf.lrt.sites")]
    log = job.run(spark, job.parser().parse_args([*common, "--out", second, "--hwe", f"{first}/ngsf.lrt.sites", "--hwe-tole", "0.2"]))
    assert 0 < log["sites"] == sum(x < frequency.hwe_bound(0.2) for x in found) < len(found)


def test_gzipped_tables_are_dealt_out(spark, table, tmp_path):
    import gzip
    import pathlib

    (tmp_path / "t.gz").write_bytes(gzip.compress(pathlib.Path(table).read_bytes()))
    rows = text.scan_beagle(spark, str(tmp_path / "t.gz"))
    plain = text.scan_beagle(spark, table)
    assert rows.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, plain.collect()))
