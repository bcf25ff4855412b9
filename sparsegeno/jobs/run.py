"""One job from a likelihood table or hard calls to the requested results.

    spark-submit -m sparsegeno.jobs.run --beagle TABLE --out FOLDER --selection --inbreed-samples ...

Every result is a folder below ``--out``: ordered text for vectors and matrices, Parquet for
calls, dosages and individual frequencies, and ``log`` with one row of run metadata.
"""

from __future__ import annotations

import argparse
import json
import time

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..functions.passes import checkpointed, collect_matrix
from ..operators import admixture, covariance, frequency, genotype, inbreeding, pca, scans, tree
from ..sources import sinks, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--out", required=True)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--beagle", help="likelihood table, plain or gzip")
    source.add_argument("--plink", help="prefix of .bed and .fam")
    p.add_argument("--filter", help="sample mask, one 0 or 1 per line (likelihood tables)")
    p.add_argument("--filter-sites", help="site mask, one 0 or 1 per line (likelihood tables)")
    p.add_argument("--geno-error", type=float, default=0.0, help="error rate of hard calls")
    p.add_argument("--eig", type=int, default=0, help="components; 0 chooses them")
    p.add_argument("--model", choices=("individual", "population"), default="individual")
    p.add_argument("--maf", type=float, default=0.05)
    p.add_argument("--maf-iter", type=int, default=500)
    p.add_argument("--maf-tole", type=float, default=1e-6)
    p.add_argument("--hwe", help="likelihood ratios of an earlier run, one per kept site")
    p.add_argument("--hwe-tole", type=float, default=1e-6)
    p.add_argument("--iter", type=int, default=100, help="rounds of individual frequencies; 0 is the population model")
    p.add_argument("--tole", type=float, default=1e-5)
    for flag in ("selection", "snp-weights", "pcadapt", "inbreed-sites", "inbreed-samples", "post", "post-inbreed"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--selection-eig", type=int, default=0)
    p.add_argument("--inbreed-iter", type=int, default=500)
    p.add_argument("--inbreed-tole", type=float, default=1e-5)
    p.add_argument("--geno", type=float, help="call genotypes above this posterior")
    p.add_argument("--geno-inbreed", type=float)
    p.add_argument("--strict-prior", action="store_true", help="take inbreeding from heterozygotes in posteriors, too")
    p.add_argument("--admix", action="store_true")
    p.add_argument("--admix-K", type=int, default=0)
    p.add_argument("--admix-iter", type=int, default=500)
    p.add_argument("--admix-tole", type=float, default=1e-5)
    p.add_argument("--admix-batch", type=int, default=10)
    p.add_argument("--admix-alpha", type=float, default=0.0)
    p.add_argument("--admix-seed", type=int, default=0)
    p.add_argument("--admix-auto", type=float, help="search alpha up to this value")
    p.add_argument("--admix-depth", type=int, default=7)
    p.add_argument("--tree", action="store_true")
    p.add_argument("--tree-samples", help="sample names, one per line")
    for flag in ("maf-save", "pi-save", "dosage-save", "sites-save"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--npy", action="store_true", help="calls, dosages and frequencies as .npy files, too (mounted --out only)")
    return p


def validate(a: argparse.Namespace) -> None:
    if a.iter == 0:
        a.model = "population"
    if a.plink and (a.filter or a.filter_sites):
        raise SystemExit("masks are for likelihood tables only")
    if (a.post_inbreed or a.geno_inbreed is not None) and not a.inbreed_samples:
        raise SystemExit("inbreeding-aware results need --inbreed-samples")
    if not 0 <= a.maf < 0.5:
        raise SystemExit("--maf must be in [0, 0.5)")


def load(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.plink:
        return text.scan_plink(spark, a.plink, a.geno_error)
    sites = text.load_mask(spark, a.filter_sites) if a.filter_sites else None
    samples = None
    if a.filter:
        samples = [r["keep"] for r in text.load_mask(spark, a.filter).orderBy("site_idx").collect()]  # one per sample
    return text.scan_beagle(spark, a.beagle, sites, samples, check=True)


def write_site_inbreeding(
    panel: DataFrame,
    out: str,
    prefix: str = "",
    tol: float = 1e-5,
    rounds: int = 500,
    digits: tuple[int, int] = (sinks.DIGITS, sinks.DIGITS),
) -> int:
    """Inbreeding and likelihood ratio of each site of a panel with pi, below ``out``; the rounds that it took."""
    per = inbreeding.per_site(panel, tol, rounds)
    tested = inbreeding.likelihood_ratios(per.panel).persist(StorageLevel.MEMORY_AND_DISK)
    sinks.write_site_vector(tested, "inbreed", f"{out}/{prefix}inbreed.sites", digits=digits[0])
    sinks.write_site_vector(tested, "lrt", f"{out}/{prefix}lrt.sites", digits=digits[1])
    tested.unpersist()
    per.release()
    return per.rounds


def write_tree(between: DataFrame, names: list[str], out: str) -> None:
    """The neighbour-joining tree of a covariance (i, j, v), its edges and the covariance, below ``out``."""
    spark = between.sparkSession
    newick, edges = tree.neighbour_joining(collect_matrix(tree.to_distance(between)), names)
    spark.createDataFrame([(newick,)], "value string").coalesce(1).write.text(f"{out}/tree")
    spark.createDataFrame(edges, "parent string, child string, length double").write.parquet(f"{out}/tree.edges")
    sinks.write_cells(between, f"{out}/tree.cov")


def write_log(spark: SparkSession, log: dict, out: str) -> None:
    """One line of JSON below ``out``."""
    spark.createDataFrame([(json.dumps(log),)], "value string").coalesce(1).write.text(f"{out}/log")


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Runs the job and returns its log."""
    validate(a)
    began, log = time.time(), {"options": {k: v for k, v in vars(a).items() if v not in (None, False)}}

    def path(name: str) -> str:
        return f"{a.out}/{name}"

    def write_sites(rows: DataFrame, column: str, name: str, kind: str) -> None:
        sinks.write_table(rows.select("site_idx", column), path(name))
        if a.npy:
            sinks.write_npy(rows, column, path(f"{name}.npy"), kind)

    loaded = checkpointed(load(spark, a))
    fit = frequency.allele_frequencies(loaded, a.maf_tole, a.maf_iter)
    panel = frequency.filter_maf(fit.panel, a.maf)
    if a.hwe:
        vector = text.load_vector(spark, a.hwe)
        panel = frequency.filter_hwe(text.attach_vector(panel, vector), a.hwe_tole).drop("lrt")
    panel = checkpointed(panel)
    fit.release()
    first = panel.first()
    if first is None:
        raise SystemExit("no site is left")
    samples = len(first["l0"])
    log |= {"samples": samples, "sites": panel.count(), "maf_rounds": fit.rounds, "maf_converged": fit.converged}

    if a.model == "population":
        cov, components = covariance.covariance(panel), max(a.eig, 1)
        panel = covariance.as_pi(panel)
    else:
        model = pca.fit_pi(panel, a.eig, a.tole, a.iter)
        panel, cov, components = model.panel, model.cov, model.components
        log |= {"components": components, "rounds": model.rounds, "converged": model.converged}
    panel = checkpointed(panel).persist(StorageLevel.MEMORY_AND_DISK)
    sinks.write_cells(cov, path("cov"))

    lead = a.selection_eig or components
    if a.selection or a.snp_weights or a.pcadapt:
        scanned = scans.scans(panel, lead).persist(StorageLevel.MEMORY_AND_DISK)
        if a.selection:
            sinks.write_site_matrix(scanned, "selection", path("selection"))
        if a.snp_weights:
            sinks.write_site_matrix(scanned, "weight", path("weights"))
        if a.pcadapt:
            sinks.write_site_matrix(scanned, "pcadapt", path("pcadapt.zscores"))
            far = scans.distances(scanned, components=lead)
            sinks.write_table(scans.p_values(far.select("site_idx", "d2"), "d2", lead), path("pcadapt.pvalues"))
        scanned.unpersist()
    prefix = "ngsf." if a.model == "population" else ""  # the null model's inbreeding has names of its own
    if a.inbreed_sites:
        log |= {"inbreed_sites_rounds": write_site_inbreeding(panel, a.out, prefix, a.inbreed_tole, a.inbreed_iter)}
    inbred: np.ndarray | None = None
    if a.inbreed_samples:
        inbred, rounds, _ = inbreeding.per_sample(panel, samples, a.inbreed_tole, a.inbreed_iter)
        rows = spark.createDataFrame([(i, 0, float(x)) for i, x in enumerate(inbred)], "i int, j int, v double")
        sinks.write_cells(rows, path(f"{prefix}inbreed.samples"))
        log |= {"inbreed_samples_rounds": rounds}
    if a.post:
        sinks.write_posteriors(genotype.posteriors(panel), path("post"))
    if a.post_inbreed:
        sinks.write_posteriors(genotype.posteriors(panel, inbred, a.strict_prior), path("post.inbreed"))
    if a.geno is not None:
        write_sites(genotype.calls(panel, a.geno), "call", "geno", "|i1")
    if a.geno_inbreed is not None:
        called = genotype.calls(panel, a.geno_inbreed, inbred, a.strict_prior)
        write_sites(called, "call", "geno.inbreed", "|i1")
    if a.tree:
        between = covariance.pi_covariance(panel)
        names = [r["name"] for r in text.load_names(spark, a.tree_samples, samples).orderBy("sample_idx").collect()]
        write_tree(between, names, a.out)
    if a.admix:
        k = a.admix_K or components + 1
        fitting = admixture.fits_over(panel, samples, k, a.admix_tole, a.admix_iter, a.admix_batch, a.admix_seed)
        with fitting as fits:
            if a.admix_auto is not None:
                alpha, found = admixture.alpha_search(fits, a.admix_auto, a.admix_depth)
            else:
                alpha, found = a.admix_alpha, fits([a.admix_alpha])[0]
        q = [(i, j, float(found.q[i, j])) for i in range(samples) for j in range(k)]
        sinks.write_cells(spark.createDataFrame(q, "i int, j int, v double"), path(f"admix.{k}.Q"))
        sinks.write_site_matrix(found.panel, "anc", path(f"admix.{k}.P"))
        log |= {"alpha": alpha, "log_likelihood": found.log_likelihood, "frobenius": found.frobenius}
    if a.maf_save:
        sinks.write_site_vector(panel, "f", path("freqs"))
    if a.dosage_save:
        write_sites(covariance.dosage_out(panel), "e", "dosage", "<f4")
    if a.pi_save:
        write_sites(panel, "pi", "pi", "<f4")
    if a.sites_save:
        # one flag per site of the input, also for those that a mask took out
        every = text.load_mask(spark, a.filter_sites) if a.filter_sites else loaded
        sinks.write_site_flags(frequency.sites_kept(every, panel), path("sites"))
    log["seconds"] = round(time.time() - began, 1)
    panel.unpersist()
    write_log(spark, log, a.out)
    return log


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sparsegeno").getOrCreate()
    print(json.dumps(run(spark, a)))


if __name__ == "__main__":
    main()
