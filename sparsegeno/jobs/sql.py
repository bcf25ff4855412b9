"""DuckDB SQL of the registered queries, from shared pieces.

Float literals carry an exponent so that they are doubles, and results are rounded.
"""

from __future__ import annotations

CELLS = """
reads AS (
  SELECT l_partkey AS site_idx, n_nationkey AS sample_idx, n_regionkey AS region,
         CASE WHEN (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 1000
                   < 100 + (l_partkey * 37 + n_regionkey * 211 * (l_partkey % 3)) % 800 THEN 1 ELSE 0 END AS alt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey),
counts AS (SELECT site_idx, sample_idx, sum(alt) AS a, count(*) - sum(alt) AS r FROM reads GROUP BY ALL),
grid AS (
  SELECT site_idx, n_nationkey AS sample_idx, n_regionkey AS region
  FROM (SELECT DISTINCT site_idx FROM reads), nation),
raw AS (
  SELECT site_idx, sample_idx, region, pow(0.99e0, r) * pow(0.01e0, a) AS w0, pow(0.5e0, r + a) AS w1,
         pow(0.01e0, r) * pow(0.99e0, a) AS w2
  FROM grid LEFT JOIN counts USING (site_idx, sample_idx)),
cells AS MATERIALIZED (
  SELECT CAST(site_idx AS BIGINT) AS site_idx, CAST(sample_idx AS INT) AS sample_idx, region,
         coalesce(w0 / (w0 + w1 + w2), 1e0 / 3e0) AS l0, coalesce(w1 / (w0 + w1 + w2), 1e0 / 3e0) AS l1
  FROM raw)"""


def w(p: str) -> tuple[str, str, str]:
    return (
        f"(l0 * (1e0 - {p}) * (1e0 - {p}))",
        f"(2e0 * l1 * {p} * (1e0 - {p}))",
        f"((1e0 - l0 - l1) * {p} * {p})",
    )


def total(p: str) -> str:
    return "(" + " + ".join(w(p)) + ")"


def dosage(p: str) -> str:
    a, b, c = w(p)
    return f"(({b} + 2e0 * {c}) / {total(p)})"


def em(name: str, source: str, p: str = "f") -> str:
    return f"{name} AS (SELECT site_idx, sum({dosage(p)}) / (2e0 * count(*)) AS f FROM {source} GROUP BY site_idx)"


def em_chain(steps: int, stem: str = "em") -> str:
    parts = [em(f"{stem}1", "cells", "0.25e0")]
    parts += [em(f"{stem}{i}", f"cells JOIN {stem}{i - 1} USING (site_idx)") for i in range(2, steps + 1)]
    return ",\n".join(parts)


EM5 = em_chain(5)
FIT = f"""{EM5},
kept AS (SELECT * FROM em5 WHERE f BETWEEN 0.05e0 AND 0.95e0),
c AS MATERIALIZED (SELECT site_idx, sample_idx, region, l0, l1, f FROM cells JOIN kept USING (site_idx))"""
GROUP = """
grp AS (SELECT site_idx, region, (sum(alt) + 1) / (count(*) + 2.0e0) AS p FROM reads GROUP BY ALL),
g AS MATERIALIZED (
  SELECT c.site_idx, c.sample_idx, c.l0, c.l1, c.f, coalesce(grp.p, 0.5e0) AS pi
  FROM c LEFT JOIN grp ON c.site_idx = grp.site_idx AND c.region = grp.region)"""


def query(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((CELLS, *ctes)) + "\n" + select


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0e0"


SCALED = "sqrt(2e0 * f * (1e0 - f))"


def spread(p: str) -> str:
    a, b, c = w(p)
    m = "2e0 * f"
    return (
        f"((({m}) * ({m}) * {a} + (1e0 - {m}) * (1e0 - {m}) * {b} + (2e0 - {m}) * (2e0 - {m}) * {c})"
        f" / {total(p)} / (2e0 * f * (1e0 - f)))"
    )


def cov(source: str, p: str) -> str:
    """CTE ``cov(i, j, v)`` over ``source`` with frequencies ``p``."""
    return f"""
std AS MATERIALIZED (SELECT site_idx, sample_idx, ({dosage(p)} - 2e0 * f) / {SCALED} AS e, {spread(p)} AS d FROM {source}),
m AS (SELECT count(DISTINCT site_idx) AS m FROM std),
cov AS MATERIALIZED (
  SELECT a.sample_idx AS i, b.sample_idx AS j,
         CASE WHEN a.sample_idx = b.sample_idx THEN sum(a.d) ELSE sum(a.e * b.e) END / any_value(m) AS v
  FROM std a JOIN std b USING (site_idx), m GROUP BY 1, 2)"""


def power(name: str, source: str, squarings: int = 9) -> str:
    """CTE ``name(i, j, v)``: projection on the leading eigenvector of ``source(i, j, v)``, by squaring."""
    parts, last = [], source
    for k in range(squarings):
        this = f"{name}_{k}"
        parts.append(
            f"{this}_q AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY 1, 2),\n"
            f"{this} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {this}_q WHERE i = j) AS v FROM {this}_q)"
        )
        last = this
    parts.append(f"{name} AS (SELECT * FROM {last})")
    return ",\n".join(parts)


def two_powers(name: str, source: str) -> str:
    """CTE ``name(i, j, v)``: projection on the two leading eigenvectors, the second after the first is taken out."""
    value = f"(SELECT sum(a.v * b.v) FROM {source} a JOIN {name}_a b ON a.i = b.j AND a.j = b.i)"
    return ",\n".join(
        (
            power(f"{name}_a", source, 14),
            f"{name}_d AS MATERIALIZED (SELECT s.i, s.j, s.v - {value} * p.v AS v FROM {source} s JOIN {name}_a p USING (i, j))",
            power(f"{name}_b", f"{name}_d", 14),
            f"{name} AS MATERIALIZED (SELECT i, j, x.v + y.v AS v FROM {name}_a x JOIN {name}_b y USING (i, j))",
        )
    )


def gram(name: str, source: str, column: str = "e") -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT a.sample_idx AS i, b.sample_idx AS j, sum(a.{column} * b.{column}) AS v"
        f" FROM {source} a JOIN {source} b USING (site_idx) GROUP BY 1, 2)"
    )


def _pi_rounds(rounds: int, lead=power) -> str:
    """CTEs up to ``pi(site_idx, sample_idx, l0, l1, f, pi)`` after that many rounds with the components of ``lead``."""
    parts = [f"e0 AS MATERIALIZED (SELECT *, {dosage('f')} - 2e0 * f AS e FROM c)"]
    for k in range(rounds + 1):
        parts += [gram(f"gram{k}", f"e{k}"), lead(f"proj{k}", f"gram{k}")]
        last = f"pi{k}" if k < rounds else "pi"
        parts.append(
            f"{last} AS MATERIALIZED (SELECT x.site_idx, x.sample_idx, x.l0, x.l1, x.f,"
            f" greatest(1e-4, least(1e0 - 1e-4, (p.s + 2e0 * x.f) / 2e0)) AS pi FROM e{k} x JOIN"
            f" (SELECT e{k}.site_idx, v.j, sum(e{k}.e * v.v) AS s FROM e{k} JOIN proj{k} v ON e{k}.sample_idx = v.i GROUP BY 1, 2) p"
            f" ON x.site_idx = p.site_idx AND x.sample_idx = p.j)"
        )
        if k < rounds:
            parts.append(f"e{k + 1} AS MATERIALIZED (SELECT *, {dosage('pi')} - 2e0 * f AS e FROM pi{k})")
    return ",\n".join(parts)


PI = _pi_rounds(2)
SCAN = f"""
s AS MATERIALIZED (SELECT site_idx, sample_idx, ({dosage("pi")} - 2e0 * f) / {SCALED} AS e FROM pi),
{gram("sgram", "s")},
{power("sproj", "sgram")},
size AS (SELECT count(DISTINCT site_idx) AS m, count(DISTINCT sample_idx) AS n FROM s),
lead AS (SELECT sum(a.v * b.v) AS ss FROM sgram a JOIN sproj b ON a.i = b.j AND a.j = b.i),
-- eV is, up to its sign, the product with any column of the projection over that column's length
pick AS (SELECT j, sqrt(v) AS len FROM sproj WHERE i = j ORDER BY v DESC, j LIMIT 1),
b AS (
  SELECT s.site_idx, sum(s.e * v.v) / any_value(len) AS b, sum(s.e * s.e) AS total
  FROM s JOIN sproj v ON s.sample_idx = v.i JOIN pick ON v.j = pick.j GROUP BY 1),
scan AS MATERIALIZED (
  SELECT site_idx, m * b * b / ss AS selection,
         CASE WHEN total - b * b > 1e-12 * total THEN b / sqrt((total - b * b) / (n - 1)) ELSE 0e0 END AS pcadapt,
         b * sqrt(ss) / m AS weight
  FROM b, size, lead)"""


def prior(p: str, f: str) -> tuple[str, str, str]:
    a = f"greatest(1e-4, (1e0 - {p}) * (1e0 - {p}) + {p} * (1e0 - {p}) * {f})"
    b = f"greatest(1e-4, 2e0 * {p} * (1e0 - {p}) * (1e0 - {f}))"
    c = f"greatest(1e-4, {p} * {p} + {p} * (1e0 - {p}) * {f})"
    return a, b, c


def inbreed(name: str, source: str, key: str, f: str) -> str:
    a, b, c = prior("pi", f)
    # the normalisation of the prior cancels in the posterior
    het = f"(l1 * {b} / (l0 * {a} + l1 * {b} + (1e0 - l0 - l1) * {c}))"
    return (
        f"{name} AS MATERIALIZED (SELECT {key}, greatest(-1e0, least(1e0,"
        f" 1e0 - sum({het}) / sum(2e0 * pi * (1e0 - pi)))) AS x FROM {source} GROUP BY {key})"
    )


def accelerated(stem: str, key: str, step, start: str, low: str, high: str, rounds: int) -> tuple[str, str]:
    """CTEs of accelerated rounds from CTE ``start(key, x)``; the name of the last state."""
    parts, last = [], start
    for k in range(rounds):
        a, b, cf, j, n = (f"{stem}{k}{x}" for x in ("a", "b", "c", "j", "n"))
        parts += [
            step(a, last),
            step(b, a),
            f"{cf} AS MATERIALIZED (SELECT CASE WHEN sum(u * v) = 0 THEN 1e0"
            f" ELSE least(256e0, greatest(1e0, -sum(u * u) / sum(u * v))) END AS k"
            f" FROM (SELECT {a}.x - {last}.x AS u, {b}.x - {a}.x - ({a}.x - {last}.x) AS v"
            f" FROM {last} JOIN {a} USING ({key}) JOIN {b} USING ({key})))",
            f"{j} AS MATERIALIZED (SELECT {key}, greatest({low}, least({high}, (1e0 - k) * {a}.x + k * {b}.x)) AS x"
            f" FROM {a} JOIN {b} USING ({key}), {cf})",
            step(n, j),
        ]
        last = n
    return ",\n".join(parts), last


def converged(stem: str, key: str, step, start: str, low: str, high: str, tol: str, most: int = 500) -> str:
    """A recursive CTE ``stem(turn, key, x, change)``: accelerated rounds until the change of one is below ``tol``."""
    rounds, last = accelerated("r", key, step, "now", low, high, 1)
    return f"""{stem} AS (
  SELECT 0 AS turn, {key}, x, 1e9 AS change FROM {start}
  UNION ALL
  SELECT * FROM (
    WITH now AS MATERIALIZED (SELECT turn, {key}, x FROM {stem} WHERE change >= {tol} AND turn < {most}),
{rounds},
    far AS (SELECT sqrt(avg(({last}.x - now.x) * ({last}.x - now.x))) AS change FROM {last} JOIN now USING ({key}))
    SELECT turn + 1, {key}, {last}.x, change FROM {last} JOIN now USING ({key}), far)),
{stem}_end AS (SELECT {key}, x FROM {stem} WHERE turn = (SELECT max(turn) FROM {stem}))"""


def em_x(name: str, source: str) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT site_idx, sum({dosage('x')}) / (2e0 * count(*)) AS x"
        f" FROM cells JOIN {source} USING (site_idx) GROUP BY site_idx)"
    )


def in_site(name: str, source: str) -> str:
    return inbreed(name, f"g JOIN {source} USING (site_idx)", "site_idx", "x")


def in_sample(name: str, source: str) -> str:
    return inbreed(name, f"g JOIN {source} USING (sample_idx)", "sample_idx", "x")


QN = f"""{em_chain(3)},
parts AS (
  SELECT em1.site_idx, em1.f AS f0, em2.f AS f1, em3.f AS f2 FROM em1 JOIN em2 USING (site_idx) JOIN em3 USING (site_idx)),
qn AS (
  SELECT least(256e0, greatest(1e0, -sum((f1 - f0) * (f1 - f0)) / sum((f1 - f0) * (f2 - f1 - (f1 - f0))))) AS c FROM parts)"""

#: Deterministic starting values for the admixture steps, two components.
Q0 = "CASE WHEN k = 0 THEN (1 + sample_idx % 7) ELSE (8 - sample_idx % 7) END / 9e0"
F0 = "(1 + (site_idx * (k + 2)) % 17) / 19e0"
NMF = f"""
ks AS (SELECT unnest([0, 1]) AS k),
q AS MATERIALIZED (SELECT sample_idx, k, {Q0} AS q FROM (SELECT DISTINCT sample_idx FROM g), ks),
anc AS MATERIALIZED (SELECT site_idx, k, {F0} AS f FROM (SELECT DISTINCT site_idx FROM g), ks),
fit AS MATERIALIZED (
  SELECT g.site_idx, g.sample_idx, any_value(l0) AS l0, any_value(l1) AS l1, any_value(pi) AS pi, sum(q.q * anc.f) AS x
  FROM g JOIN q USING (sample_idx) JOIN anc ON anc.site_idx = g.site_idx AND anc.k = q.k GROUP BY 1, 2)"""

DIST = """
d AS MATERIALIZED (
  SELECT x.i, x.j, greatest(0e0, a.v + b.v - 2e0 * x.v) AS v
  FROM cov x JOIN cov a ON a.i = x.i AND a.j = x.i JOIN cov b ON b.i = x.j AND b.j = x.j)"""
PI_COV = """
z AS MATERIALIZED (SELECT site_idx, sample_idx, (pi - f) / sqrt(f * (1e0 - f)) AS e FROM g),
cov AS MATERIALIZED (
  SELECT a.sample_idx AS i, b.sample_idx AS j, sum(a.e * b.e) / (SELECT count(DISTINCT site_idx) FROM z) AS v
  FROM z a JOIN z b USING (site_idx) GROUP BY 1, 2)"""

_a, _b, _c = w("pi")
INBRED = "0.1e0 * (1 + sample_idx % 5)"
_ia = f"(l0 * ((1e0 - pi) * (1e0 - pi) + pi * (1e0 - pi) * {INBRED}))"
_ib = "(l1 * 2e0 * pi * (1e0 - pi))"
_ic = f"((1e0 - l0 - l1) * (pi * pi + pi * (1e0 - pi) * {INBRED}))"


def posterior(a: str, b: str, c: str) -> str:
    t = f"({a} + {b} + {c})"
    return "SELECT site_idx, sample_idx, " + ", ".join(
        f"{r(f'greatest(1e-10, {x} / {t})')} AS p{i}" for i, x in enumerate((a, b, c))
    )


def calls(a: str, b: str, c: str, delta: str) -> str:
    t = f"({a} + {b} + {c})"
    return (
        f"SELECT site_idx, sample_idx, CAST(CASE WHEN {a} > {b} AND {a} > {c} THEN (CASE WHEN {a} / {t} > {delta} THEN 0 ELSE -9 END)"
        f" WHEN {b} > {c} THEN (CASE WHEN {b} / {t} > {delta} THEN 1 ELSE -9 END)"
        f" ELSE (CASE WHEN {c} / {t} > {delta} THEN 2 ELSE -9 END) END AS TINYINT) AS call FROM g"
    )


def cell_value(x: str, source: str, name: str = "e") -> str:
    return f"SELECT site_idx, sample_idx, {r(x)} AS {name} FROM {source}"


def _nmf_f() -> str:
    return query(
        f"""SELECT anc.site_idx, CAST(anc.k AS INT) AS k,
  {r("greatest(1e-4, least(1e0 - 1e-4, anc.f * a.a / h.h))")} AS f
FROM anc JOIN (SELECT site_idx, k, sum(pi * q) AS a FROM g JOIN q USING (sample_idx) GROUP BY 1, 2) a USING (site_idx, k)
JOIN (SELECT anc.site_idx, qq.k2 AS k, sum(anc.f * qq.v) AS h FROM anc JOIN
      (SELECT x.k AS k1, y.k AS k2, sum(x.q * y.q) AS v FROM q x JOIN q y USING (sample_idx) GROUP BY 1, 2) qq ON anc.k = qq.k1
      GROUP BY 1, 2) h USING (site_idx, k)""",
        FIT,
        GROUP,
        NMF,
    )


def _nmf_q() -> str:
    return query(
        f"""SELECT sample_idx, CAST(k AS INT) AS k, {r("u / sum(u) OVER (PARTITION BY sample_idx)")} AS q FROM (
  SELECT q.sample_idx, q.k, greatest(1e-4, least(1e0 - 1e-4, q.q * xf.v / (h.h + 0.1e0))) AS u
  FROM q JOIN (SELECT sample_idx, k, sum(pi * anc.f) AS v FROM g JOIN anc USING (site_idx) GROUP BY 1, 2) xf USING (sample_idx, k)
  JOIN (SELECT q.sample_idx, ff.k2 AS k, sum(q.q * ff.v) AS h FROM q JOIN
        (SELECT x.k AS k1, y.k AS k2, sum(x.f * y.f) AS v FROM anc x JOIN anc y USING (site_idx) GROUP BY 1, 2) ff ON q.k = ff.k1
        GROUP BY 1, 2) h USING (sample_idx, k))""",
        FIT,
        GROUP,
        NMF,
    )


_MAF_ACC, _MAF_LAST = accelerated("acc", "site_idx", em_x, "start0", "1e-5", "1e0 - 1e-5", 3)
_SITE_ACC, _SITE_LAST = accelerated("ins", "site_idx", in_site, "in1", "-1e0", "1e0", 2)
_SAMPLE_ACC, _SAMPLE_LAST = accelerated("inn", "sample_idx", in_sample, "in1", "-1e0", "1e0", 2)
_SITE_START = inbreed("in1", "g", "site_idx", "0e0")
_SAMPLE_START = inbreed("in1", "g", "sample_idx", "0e0")
_pa, _pb, _pc = prior("pi", "x")
_LRT = f"""
lrt AS MATERIALIZED (
  SELECT site_idx, 2e0 * (sum(ln((l0 * {_pa} + l1 * {_pb} + (1e0 - l0 - l1) * {_pc}) / ({_pa} + {_pb} + {_pc}))) - sum(ln({total("pi")}))) AS lrt
  FROM g JOIN {_SITE_LAST} USING (site_idx) GROUP BY site_idx)"""
_SITE = (FIT, GROUP, _SITE_START, _SITE_ACC)
_MAF_END = converged("maf", "site_idx", em_x, "start0", "1e-5", "1e0 - 1e-5", "1e-6")
_SITE_END = converged("sites", "site_idx", in_site, "in1", "-1e0", "1e0", "1e-5")
_SAMPLE_END = converged("samples", "sample_idx", in_sample, "in1", "-1e0", "1e0", "1e-5")
_Q999 = "2.705543454095404e0"


def _upper(x: str) -> str:
    """Upper tail of chi-square with one degree of freedom: 1 - erf z with z^2 = x / 2, by its series."""
    z = f"sqrt(greatest(least({x}, 1200e0), 1e-300) / 2e0)"
    term = f"exp((2e0 * i + 1e0) * ln({z}) + 2e0 * i * ln(2e0) + lgamma(i + 1e0) - lgamma(2e0 * i + 2e0) - {z} * {z})"
    return f"greatest(0e0, 1e0 - 2e0 / sqrt(pi()) * list_sum(list_transform(range(0, 900), lambda i: {term})))"


def _drawn() -> str:
    """The hash of (seed 0, site, component) that stands for a uniform number; 64 bits in 128."""
    two64 = "18446744073709551616::UHUGEINT"
    x = f"((site_idx::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT + k::UHUGEINT + {0x632BE59BD9B4E019}::UHUGEINT) % {two64})::UBIGINT"
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = f"((xor({x}, ({x}) >> {shift}::UBIGINT)::UHUGEINT * {mul}::UHUGEINT) % {two64})::UBIGINT"
    return f"((xor({x}, ({x}) >> 31::UBIGINT) >> 11::UBIGINT)::DOUBLE / 9007199254740992e0)"


ORACLE: dict[str, str] = {
    "fixture_cells": query(f"SELECT site_idx, sample_idx, {r('l0')} AS l0, {r('l1')} AS l1 FROM cells"),
    "scan_beagle": query(f"SELECT site_idx, sample_idx, {r('l0')} AS l0, {r('l1')} AS l1 FROM"
                         " (SELECT dense_rank() OVER (ORDER BY site_idx) - 1 AS site_idx, sample_idx, l0, l1 FROM cells)"),
    "scan_beagle_sites": query(f"SELECT site_idx, sample_idx, {r('l0')} AS l0, {r('l1')} AS l1 FROM"
                               " (SELECT dense_rank() OVER (ORDER BY site_idx) - 1 AS site_idx, sample_idx, l0, l1 FROM cells) WHERE site_idx % 7 <> 0"),
    "scan_beagle_samples": query(f"SELECT site_idx, CAST(dense_rank() OVER (ORDER BY sample_idx) - 1 AS INT) AS sample_idx, {r('l0')} AS l0, {r('l1')} AS l1 FROM"
                                 " (SELECT dense_rank() OVER (ORDER BY site_idx) - 1 AS site_idx, sample_idx, l0, l1 FROM cells) WHERE sample_idx % 5 <> 3"),
    "scan_beagle_both": query(f"SELECT site_idx, CAST(dense_rank() OVER (ORDER BY sample_idx) - 1 AS INT) AS sample_idx, {r('l0')} AS l0, {r('l1')} AS l1 FROM"
                              " (SELECT dense_rank() OVER (ORDER BY site_idx) - 1 AS site_idx, sample_idx, l0, l1 FROM cells) WHERE sample_idx % 5 <> 3 AND site_idx % 7 <> 0"),
    "decode_bed": query("""SELECT site_idx, sample_idx,
  CASE code WHEN 0 THEN 0.99e0 * 0.99e0 WHEN 2 THEN 0.01e0 * 0.99e0 WHEN 3 THEN 0.01e0 * 0.01e0 ELSE 0.333333e0 END AS l0,
  CASE code WHEN 0 THEN 2e0 * 0.01e0 * 0.99e0 WHEN 2 THEN 0.99e0 * 0.99e0 + 0.01e0 * 0.01e0 WHEN 3 THEN 2e0 * 0.01e0 * 0.99e0 ELSE 0.333333e0 END AS l1
FROM (SELECT CAST(site_idx AS BIGINT) AS site_idx, CAST(sample_idx AS INT) AS sample_idx,
             CASE WHEN n IS NULL THEN 1 WHEN a = 0 THEN 0 WHEN a = n THEN 3 ELSE 2 END AS code
      FROM grid LEFT JOIN (SELECT site_idx, sample_idx, a, a + r AS n FROM counts) USING (site_idx, sample_idx))"""
                        ).replace("0.99e0 * 0.99e0 WHEN 2", "round(0.99e0 * 0.99e0, 6) WHEN 2"),
    "maf_em_step": query(f"SELECT site_idx, {r('f')} AS f FROM em1", em_chain(1)),
    "maf_em_fixed": query(f"SELECT site_idx, {r('f')} AS f FROM em5", EM5),
    "maf_em_accelerated": query(f"SELECT site_idx, {r('x')} AS f FROM {_MAF_LAST}", em_chain(1), "start0 AS (SELECT site_idx, f AS x FROM em1)", _MAF_ACC),
    "qn_step": query(f"SELECT {r('c')} AS c FROM qn", QN),
    "maf_jump": query(f"SELECT site_idx, {r('greatest(1e-5, least(1e0 - 1e-5, (1e0 - c) * f1 + c * f2))')} AS f FROM parts, qn", QN),
    "rmse1d": query(f"SELECT {r('sqrt(avg((em1.f - em2.f) * (em1.f - em2.f)))')} AS value FROM em1 JOIN em2 USING (site_idx)", em_chain(2)),
    "rmse2d": query(f"SELECT {r('sqrt(avg((pi - f) * (pi - f)))')} AS value FROM g", FIT, GROUP),
    "frobenius": query(f"SELECT {r('sqrt(sum((pi - f) * (pi - f)))')} AS value FROM g", FIT, GROUP),
    "filter_maf": query(f"SELECT site_idx, {r('f')} AS f FROM kept", FIT),
    "filter_hwe": query(f"SELECT site_idx, {r('lrt')} AS lrt FROM lrt WHERE lrt < {_Q999}", *_SITE, _LRT),
    "sites_kept": query("SELECT site_idx, CAST(f BETWEEN 0.05e0 AND 0.95e0 AS INT) AS keep FROM em5", EM5),
    "dosage_pop": query(cell_value(f"{dosage('f')} - 2e0 * f", "c"), FIT),
    "dosage_ind": query(cell_value(f"{dosage('pi')} - 2e0 * f", "g"), FIT, GROUP),
    "dosage_std": query(cell_value(f"({dosage('pi')} - 2e0 * f) / {SCALED}", "g"), FIT, GROUP),
    "dosage_out": query(cell_value(dosage("pi"), "g"), FIT, GROUP),
    "fake_freqs": query(cell_value("f", "c", "pi"), FIT),
    "cov_pop_tiles": query(f"SELECT i, j, {r('v')} AS c FROM cov", FIT, cov("c", "f")),
    "cov_pop": query(f"SELECT i, j, {r('v')} AS c FROM cov", FIT, cov("c", "f")),
    "cov_ind": query(f"SELECT i, j, {r('v', 5)} AS c FROM cov", FIT, PI, cov("pi", "pi")),
    "svd_topk": query(f"SELECT i, j, {r('v')} AS v FROM p", FIT, f"e0 AS MATERIALIZED (SELECT *, {dosage('f')} - 2e0 * f AS e FROM c)", gram("gm", "e0"), power("p", "gm")),
    "project": query(cell_value("s", "(SELECT site_idx, p.j AS sample_idx, sum(e * p.v) AS s FROM e0 JOIN p ON e0.sample_idx = p.i GROUP BY 1, 2)", "proj"),
                     FIT, f"e0 AS MATERIALIZED (SELECT *, {dosage('f')} - 2e0 * f AS e FROM c)", gram("gm", "e0"), power("p", "gm")),
    "fit_pi_k1": query(f"SELECT site_idx, sample_idx, {r('pi', 5)} AS pi FROM pi", FIT, PI),
    "fit_pi_k2": query(f"SELECT site_idx, sample_idx, {r('pi', 5)} AS pi FROM pi", FIT, _pi_rounds(2, two_powers)),
    "selection_fastpca_k1": query(f"SELECT site_idx, {r('selection', 5)} AS value FROM scan", FIT, PI, SCAN),
    "pcadapt_abs_k1": query(f"SELECT site_idx, {r('abs(pcadapt)', 5)} AS value FROM scan", FIT, PI, SCAN),
    "weights_abs_k1": query(f"SELECT site_idx, {r('abs(weight)', 5)} AS value FROM scan", FIT, PI, SCAN),
    "pcadapt_stat_k1": query(f"SELECT site_idx, {r('(pcadapt - (SELECT median(pcadapt) FROM scan)) * (pcadapt - (SELECT median(pcadapt) FROM scan))', 5)} AS d2 FROM scan", FIT, PI, SCAN),
    "inbreed_sites_step": query(f"SELECT site_idx, {r('x')} AS f FROM in1", FIT, GROUP, _SITE_START),
    "inbreed_sites_fixed": query(f"SELECT site_idx, {r('x')} AS f FROM {_SITE_LAST}", *_SITE),
    "hwe_lrt": query(f"SELECT site_idx, {r('lrt', 5)} AS lrt FROM lrt", *_SITE, _LRT),
    "inbreed_samples_step": query(f"SELECT sample_idx, {r('x')} AS f FROM in1", FIT, GROUP, _SAMPLE_START),
    "inbreed_samples_fixed": query(f"SELECT sample_idx, {r('x')} AS f FROM {_SAMPLE_LAST}", FIT, GROUP, _SAMPLE_START, _SAMPLE_ACC),
    "inbreed_jump": query(
        f"SELECT site_idx, {r('greatest(-1e0, least(1e0, -0.5e0 * a.x + 1.5e0 * b.x))')} AS f FROM in1 a JOIN in2 b USING (site_idx)",
        FIT, GROUP, _SITE_START, in_site("in2", "in1")),
    "posterior": query(posterior(_a, _b, _c) + " FROM g", FIT, GROUP),
    "posterior_inbreed": query(posterior(_ia, _ib, _ic) + " FROM g", FIT, GROUP),
    "call": query(calls(_a, _b, _c, "0.6e0"), FIT, GROUP),
    "call_inbreed": query(calls(_ia, _ib, _ic, "0.6e0"), FIT, GROUP),
    "nmf_update_f": _nmf_f(),
    "nmf_update_q": _nmf_q(),
    "admix_loglik": query(f"SELECT {r('sum(ln(' + total('x') + '))', 4)} AS value FROM fit", FIT, GROUP, NMF),
    "admix_frobenius": query(f"SELECT {r('sqrt(sum((x - pi) * (x - pi)))', 5)} AS value FROM fit", FIT, GROUP, NMF),
    "pi_standardize": query(cell_value("(pi - f) / sqrt(f * (1e0 - f))", "g", "z"), FIT, GROUP),
    "pi_cov": query(f"SELECT i, j, {r('v')} AS c FROM cov", FIT, GROUP, PI_COV),
    "cov_to_dist": query(f"SELECT i, j, {r('v')} AS d FROM d", FIT, GROUP, PI_COV, DIST),
    "nj_q": query(f"""SELECT d.i, d.j, {r('(n - 2) * d.v - a.r - b.r')} AS q FROM d
  JOIN (SELECT i, sum(v) AS r, count(*) AS n FROM d GROUP BY i) a ON d.i = a.i
  JOIN (SELECT i, sum(v) AS r FROM d GROUP BY i) b ON d.j = b.i WHERE d.i <> d.j""", FIT, GROUP, PI_COV, DIST),
    "load_mask": query("SELECT CAST(dense_rank() OVER (ORDER BY site_idx) - 1 AS BIGINT) AS site_idx, CAST(f BETWEEN 0.05e0 AND 0.95e0 AS INT) AS keep FROM em5", EM5),
    "load_lrt": query(f"SELECT site_idx, {r('lrt', 7)} AS lrt FROM lrt", *_SITE, _LRT),
    "sink_freqs": query(f"SELECT CAST(row_number() OVER (ORDER BY site_idx) - 1 AS BIGINT) AS line, {r('f', 7)} AS f FROM kept", FIT),
    "sink_cov": query(f"SELECT i, j, {r('v', 7)} AS c FROM cov", FIT, cov("c", "f")),
    "load_names": """SELECT CAST(n_nationkey AS INT) AS sample_idx, n_name || '-' || coalesce(n, 0) AS name
FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) USING (n_nationkey)""",
    "chi2_pvalue": query(f"SELECT site_idx, {r(_upper('selection'), 5)} AS p FROM scan", FIT, PI, SCAN),
    "pcadapt_pvalue_k1": query(
        f"SELECT site_idx, {r(_upper('d2'), 5)} AS p FROM (SELECT site_idx,"
        " (pcadapt - (SELECT median(pcadapt) FROM scan)) * (pcadapt - (SELECT median(pcadapt) FROM scan)) AS d2 FROM scan)", FIT, PI, SCAN),
    "nmf_init": query(f"SELECT site_idx, CAST(k - 1 AS INT) AS k, {r(f'greatest(1e-4, least(1e0 - 1e-4, {_drawn()}))')} AS f FROM kept, (SELECT unnest([1, 2]) AS k)", FIT),
}
_by_site = "CAST(dense_rank() OVER (ORDER BY site_idx) - 1 AS BIGINT) AS line"
ORACLE |= {
    "scan_beagle_gzip": ORACLE["scan_beagle"],
    "scan_beagle_block_gzip": ORACLE["scan_beagle"],
    "sink_calls_npy": ORACLE["call"],
    "sink_dosage_npy": ORACLE["dosage_out"],
    "sink_pi_npy": query(cell_value("pi", "g", "pi"), FIT, GROUP),
    "scan_plink": "SELECT CAST(dense_rank() OVER (ORDER BY site_idx) - 1 AS BIGINT) AS site_idx, sample_idx, l0, l1 FROM (" + ORACLE["decode_bed"] + ")",
    "sink_selection": query(f"SELECT {_by_site}, CAST(0 AS INT) AS k, {r('selection', 5)} AS value FROM scan", FIT, PI, SCAN),
    "sink_weights": query(f"SELECT {_by_site}, CAST(0 AS INT) AS k, {r('abs(weight)', 5)} AS value FROM scan", FIT, PI, SCAN),
    "sink_zscores": query(f"SELECT {_by_site}, CAST(0 AS INT) AS k, {r('abs(pcadapt)', 5)} AS value FROM scan", FIT, PI, SCAN),
    "sink_inbreed_sites": query(f"SELECT {_by_site}, {r('x')} AS f FROM {_SITE_LAST}", *_SITE),
    "sink_lrt_sites": query(f"SELECT {_by_site}, {r('lrt', 5)} AS f FROM lrt", *_SITE, _LRT),
    "sink_inbreed_samples": query(f"SELECT CAST(sample_idx AS BIGINT) AS line, {r('x')} AS f FROM in1", FIT, GROUP, _SAMPLE_START),
    "sink_calls": ORACLE["call"],
    "sink_calls_inbreed": ORACLE["call_inbreed"],
    "sink_dosage": ORACLE["dosage_out"],
    "sink_pi": query(cell_value("pi", "g", "pi"), FIT, GROUP),
    "sink_tree_cov": ORACLE["pi_cov"],
    "sink_admix_f": f"SELECT {_by_site}, k, f AS value FROM ({ORACLE['nmf_update_f']})",
    "sink_admix_q": f"SELECT CAST(sample_idx AS BIGINT) AS line, k, q AS value FROM ({ORACLE['nmf_update_q']})",
    "sink_sites": query("SELECT CAST(dense_rank() OVER (ORDER BY site_idx) - 1 AS BIGINT) AS site_idx,"
                        " CAST(site_idx % 7 <> 0 AND f BETWEEN 0.05e0 AND 0.95e0 AS INT) AS keep FROM em5", EM5),
}
for _name, _source in (("sink_posterior", "posterior"), ("sink_posterior_inbreed", "posterior_inbreed")):
    ORACLE[_name] = f"""SELECT CAST(dense_rank() OVER (ORDER BY site_idx) - 1 AS BIGINT) AS line, sample_idx,
  CAST(unnest([0, 1, 2]) AS INT) AS genotype, unnest([p0, p1, p2]) AS p FROM ({ORACLE[_source]})"""
ORACLE["scan_plink_sites"] = f"SELECT * FROM ({ORACLE['scan_plink']}) WHERE site_idx < 150 AND site_idx % 3 = 0"


def recursive(select: str, *ctes: str) -> str:
    return query(select, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE |= {
    "maf_em": recursive(
        f"SELECT site_idx, {r('x', 4)} AS f FROM maf_end", em_chain(1), "start0 AS (SELECT site_idx, f AS x FROM em1)", _MAF_END
    ),
    "inbreed_sites": recursive(f"SELECT site_idx, {r('x', 4)} AS f FROM sites_end", FIT, GROUP, _SITE_START, _SITE_END),
    "inbreed_samples": recursive(f"SELECT sample_idx, {r('x')} AS f FROM samples_end", FIT, GROUP, _SAMPLE_START, _SAMPLE_END),
}

#: Neighbour joining: in each turn the distances that are left (kind 0) and the edges of the last join (kind 1).
NJ = """
nj AS (
  SELECT 0 AS turn, 0 AS kind, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, v FROM d
  UNION ALL
  SELECT * FROM (
    WITH now AS MATERIALIZED (SELECT turn, i, j, v FROM nj WHERE kind = 0),
    m AS MATERIALIZED (SELECT count(DISTINCT i) AS n, max(i) + 1 AS p, any_value(turn) AS turn FROM now),
    sums AS MATERIALIZED (SELECT i, sum(v) AS r FROM now GROUP BY i),
    pairs AS MATERIALIZED (
      SELECT now.i AS a, now.j AS b, now.v, greatest(0e0, 0.5e0 * now.v + (x.r - y.r) / (2e0 * (n - 2))) AS l,
             (n - 2) * now.v - x.r - y.r AS q
      FROM now JOIN sums x ON x.i = now.i JOIN sums y ON y.i = now.j, m WHERE n > 3),
    near AS MATERIALIZED (SELECT min(q) FILTER (a < b) + 1e-9 * max(abs(q)) AS upto FROM pairs),
    best AS MATERIALIZED (SELECT a, b, v, l FROM pairs, near WHERE a < b AND q <= upto ORDER BY a, b LIMIT 1),
    rest AS MATERIALIZED (SELECT now.i, now.j, now.v FROM now, best WHERE now.i NOT IN (a, b) AND now.j NOT IN (a, b)),
    joined AS MATERIALIZED (
      SELECT x.i, p, greatest(0e0, 0.5e0 * (x.v + y.v - best.v)) AS v
      FROM best JOIN now x ON x.j = best.a JOIN now y ON y.j = best.b AND y.i = x.i, m WHERE x.i NOT IN (a, b))
    SELECT m.turn + 1, x.kind, x.i, x.j, x.v FROM m, (
      SELECT 0 AS kind, i, j, v FROM rest UNION ALL SELECT 0, i, p, v FROM joined UNION ALL SELECT 0, p, i, v FROM joined
      UNION ALL SELECT 0, p, p, 0e0 FROM m, best
      UNION ALL SELECT 1, p, a, l FROM m, best UNION ALL SELECT 1, p, b, greatest(0e0, v - l) FROM m, best) x)),
three AS (SELECT i, j, v FROM nj WHERE kind = 0 AND turn = (SELECT max(turn) FROM nj)),
ends AS (SELECT i, sum(v) AS r FROM three GROUP BY i),
final AS (
  SELECT t.i AS a, t.j AS b, t.v, greatest(0e0, 0.5e0 * t.v + (x.r - y.r) / 2e0) AS l
  FROM three t JOIN ends x ON x.i = t.i JOIN ends y ON y.i = t.j WHERE t.i < t.j ORDER BY a, b LIMIT 1),  -- of three nodes all pairs tie
tree AS (
  SELECT i AS parent, j AS child, v AS length FROM nj WHERE kind = 1
  UNION ALL SELECT NULL, a, l FROM final
  UNION ALL SELECT NULL, b, greatest(0e0, v - l) FROM final
  UNION ALL SELECT NULL, x.i, greatest(0e0, 0.5e0 * (x.v + y.v - f.v))
    FROM final f JOIN three x ON x.j = f.a JOIN three y ON y.j = f.b AND y.i = x.i WHERE x.i NOT IN (f.a, f.b)),
tips AS (SELECT max(i) AS last FROM d),
above AS (
  SELECT child AS tip, parent, length, 1 AS depth FROM tree, tips WHERE child <= last
  UNION ALL SELECT tip, tree.parent, above.length, depth + 1 FROM above JOIN tree ON tree.child = above.parent)"""
_NULL_G = "g AS MATERIALIZED (SELECT *, f AS pi FROM c)"
_NULL_LRT = _LRT.replace(_SITE_LAST, "sites_end")
ORACLE |= {
    "nj_tree": recursive(
        f"""SELECT CASE WHEN parent IS NULL THEN 'root' ELSE 'node' || (parent - last) END AS parent,
  CASE WHEN child <= last THEN CAST(child + 1 AS VARCHAR) ELSE 'node' || (child - last) END AS child,
  {r('length', 5)} AS length FROM tree, tips""",
        FIT, cov("c", "f"), DIST, NJ,
    ),
    "sink_tree": recursive(
        f"SELECT CAST(tip + 1 AS VARCHAR) AS name, CAST(depth AS INT) AS depth, {r("CAST(printf('%.7g', length) AS DOUBLE)", 5)} AS length FROM above WHERE parent IS NULL",
        FIT, cov("c", "f"), DIST, NJ,
    ),
    "sink_log": recursive(
        "SELECT count(DISTINCT sample_idx) AS samples, count(*) FILTER (sample_idx = 0 AND x BETWEEN 0.05e0 AND 0.95e0) AS sites"
        " FROM cells JOIN maf_end USING (site_idx)",
        em_chain(1), "start0 AS (SELECT site_idx, f AS x FROM em1)", _MAF_END,
    ),
    "sink_null_model": recursive(
        f"SELECT CAST(row_number() OVER (ORDER BY site_idx) - 1 AS BIGINT) AS line, {r('x', 4)} AS f, {r('lrt', 3)} AS t"
        " FROM sites_end JOIN lrt USING (site_idx)",
        FIT, _NULL_G, _SITE_START, _SITE_END, _NULL_LRT,
    ),
}
