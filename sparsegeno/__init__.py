"""Population genetics of low-depth sequencing data on Spark.

A panel is a DataFrame with one row per site: ``site_idx`` and, per sample, the
likelihoods of zero and one copies of the counted allele (``l0``, ``l1``; two copies have
1 - l0 - l1). Whatever is local to a site is a narrow pass over Arrow batches; sums over
sites are partial sums per task and then an aggregation; only sample-by-sample and
sample-by-component state is ever on the driver.
"""
