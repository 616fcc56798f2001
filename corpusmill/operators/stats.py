"""Paired contrasts, resampling, false-discovery control, agreement and scale statistics.

Sums, ranks and matrices of counts are DataFrame work; resampling runs in numpy on a group's sufficient statistics."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import average_rank

# Pre-registered settings.
LEAST_PAIRS, RESAMPLES, SEED, MIN_DELTA, MIN_DZ, FDR = 10, 10_000, 1234, 0.25, 0.2, 0.05
# End of fixed values.


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks with ties averaged."""
    _, inv, n = np.unique(x, return_inverse=True, return_counts=True)
    end = np.cumsum(n)
    return (end - (n - 1) / 2)[inv]


def wilcoxon(diff: np.ndarray) -> float:
    """Two-sided signed-rank p without zeros: exact up to 50 differences without ties, else normal with tie correction."""
    zeros = int((diff == 0).sum())
    d = diff[diff != 0]
    n = len(d)
    if not n:
        return 1.0
    r = ranks(np.abs(d))
    plus = r[d > 0].sum()
    t = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and not zeros and len(np.unique(r)) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for i in range(1, n + 1):
            ways[i:] = ways[i:] + ways[:-i]
        return float(min(1.0, 2 * ways[: int(t) + 1].sum() / 2.0**n))
    _, ties = np.unique(r, return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    return float(min(1.0, math.erfc(abs(t - n * (n + 1) / 4) / math.sqrt(2 * var)))) if var > 0 else 1.0


def bootstrap_mean(diff: np.ndarray, n: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """95 % percentile interval of the mean; resamples are drawn in blocks of bounded memory from one generator."""
    rng, means, step = np.random.default_rng(seed), [], max(1, 4_000_000 // max(1, len(diff)))
    for lo in range(0, n, step):
        means.append(diff[rng.integers(0, len(diff), (min(step, n - lo), len(diff)))].mean(1))
    lo, hi = np.percentile(np.concatenate(means), [2.5, 97.5])
    return float(lo), float(hi)


def paired(scores: DataFrame, contrasts: list[tuple[str, str]], by: str = "model", item: str = "question_id", variant: str = "variant", value: str = "score") -> DataFrame:
    """by, contrast, n, mean_a, mean_b, mean_diff, median_diff, ci_lo, ci_hi, p, dz of each contrast (a, b) on the items both have.

    Repeated scores of one item and variant are averaged first. Contrasts with fewer than LEAST_PAIRS pairs are left out."""
    cells = scores.groupBy(by, item, variant).agg(F.avg(value).alias("s"))
    tags = F.array(*[F.struct(F.lit(f"{a} vs {b}").alias("contrast"), F.lit(a).alias("va"), F.lit(b).alias("vb")) for a, b in contrasts])
    x = cells.select("*", F.inline(tags)).where(F.col(variant).isin(*{v for c in contrasts for v in c})).where(f"{variant} in (va, vb)")
    pairs = x.groupBy(by, "contrast", item).agg(F.max(F.when(F.col(variant) == F.col("va"), F.col("s"))).alias("a"), F.max(F.when(F.col(variant) == F.col("vb"), F.col("s"))).alias("b")).dropna(subset=["a", "b"])

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        a, b = pdf.a.to_numpy(), pdf.b.to_numpy()
        d = b - a
        if len(d) < LEAST_PAIRS:
            return pd.DataFrame(columns=["model", "contrast", "n", "mean_a", "mean_b", "mean_diff", "median_diff", "ci_lo", "ci_hi", "p", "dz"])
        lo, hi = bootstrap_mean(d)
        sd = d.std(ddof=1)
        p = 1.0 if np.allclose(d, 0) else wilcoxon(d)
        row = [pdf[by].iloc[0], pdf.contrast.iloc[0], len(d), *(round(float(v), 3) for v in (a.mean(), b.mean(), d.mean(), np.median(d), lo, hi)), p, round(float(d.mean() / sd), 3) if sd > 0 else 0.0]
        return pd.DataFrame([row], columns=["model", "contrast", "n", "mean_a", "mean_b", "mean_diff", "median_diff", "ci_lo", "ci_hi", "p", "dz"])

    return pairs.groupBy(by, "contrast").applyInPandas(test, "model string, contrast string, n long, mean_a double, mean_b double, mean_diff double, median_diff double, ci_lo double, ci_hi double, p double, dz double")


def benjamini_hochberg(df: DataFrame, p: str, key: list[str], by: list[str] | None = None, name: str = "p_bh") -> DataFrame:
    """Add the adjusted p of each family (by); rows without p get null. A family is a table of tests, not of data rows."""
    by = by or []
    fam = [F.lit(0)] if not by else [F.col(c) for c in by]
    some = F.col(p).isNotNull()
    w = Window.partitionBy(*fam, some)
    up = w.orderBy(F.col(p), *key)
    x = df.withColumn("i_", F.row_number().over(up)).withColumn("m_", F.count(p).over(w)).withColumn("q_", F.col(p) * F.col("m_") / F.col("i_"))
    down = w.orderBy(F.desc("i_")).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(name, F.when(some, F.least(F.lit(1.0), F.min("q_").over(down)))).drop("i_", "m_", "q_")


def practical(df: DataFrame) -> DataFrame:
    """Add bh_sig and practically_sig from values that are rounded already."""
    sig = F.coalesce(F.col("p_bh") <= FDR, F.lit(False))
    return df.withColumn("bh_sig", sig).withColumn("practically_sig", (F.abs("mean_diff") >= MIN_DELTA) & (F.abs("dz") >= MIN_DZ) & sig)


def cluster_sums(df: DataFrame, by: list[str], cluster: str, value: str) -> DataFrame:
    """by, cluster, total, n: what cluster resampling needs."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def cluster_interval(total: np.ndarray, n: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """95 % interval of the ratio of resampled sums to resampled sizes."""
    rng, out, step = np.random.default_rng(seed), [], max(1, 4_000_000 // max(1, len(n)))
    for lo in range(0, resamples, step):
        i = rng.integers(0, len(n), (min(step, resamples - lo), len(n)))
        out.append(total[i].sum(1) / n[i].sum(1))
    a, b = np.percentile(np.concatenate(out), [2.5, 97.5])
    return float(a), float(b)


def sign_flip(total: np.ndarray, n: np.ndarray, side: str = "both", shift: float = 0.0, resamples: int = RESAMPLES, seed: int = SEED) -> float:
    """p of the mean against `shift` when whole clusters change sign: (1 + hits) / (1 + resamples). side: both, greater or less."""
    t = total - shift * n
    seen, size = t.sum() / n.sum(), n.sum()
    rng, hits, step = np.random.default_rng(seed), 0, max(1, 4_000_000 // max(1, len(n)))
    for lo in range(0, resamples, step):
        m = (rng.integers(0, 2, (min(step, resamples - lo), len(n))) * 2 - 1) @ t / size
        hits += int({"both": np.abs(m) >= abs(seen) - 1e-12, "greater": m >= seen - 1e-12, "less": m <= seen + 1e-12}[side].sum())
    return (1 + hits) / (1 + resamples)


def clustered(df: DataFrame, by: str, cluster: str, value: str, margin: float = MIN_DELTA) -> DataFrame:
    """by, clusters, n, mean, ci_lo, ci_hi, p, p_equiv, verdict: cluster bootstrap, sign-flip p and equivalence within the margin."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c_")
        t, n = pdf.total.to_numpy(float), pdf.n.to_numpy(float)
        lo, hi = cluster_interval(t, n)
        p = sign_flip(t, n)
        equiv = max(sign_flip(t, n, "greater", -margin), sign_flip(t, n, "less", margin))
        verdict = {(True, True): "different but small", (True, False): "different", (False, True): "equivalent", (False, False): "undecided"}[(p <= FDR, equiv <= FDR)]
        return pd.DataFrame([[pdf[by].iloc[0], len(n), int(n.sum()), round(t.sum() / n.sum(), 6), round(lo, 6), round(hi, 6), p, equiv, verdict]], columns=["grp", "clusters", "n", "mean", "ci_lo", "ci_hi", "p", "p_equiv", "verdict"])

    sums = cluster_sums(df.withColumn("c_", F.col(cluster).cast("string")).withColumn(by, F.col(by).cast("string")), [by], "c_", value)
    return sums.groupBy(by).applyInPandas(run, "grp string, clusters long, n long, mean double, ci_lo double, ci_hi double, p double, p_equiv double, verdict string")


def agreement(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """by, n, pearson, spearman, mae, kappa (quadratic weights), within_half, within_one."""
    by = by or []
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    group = by or [F.lit("all").alias("g_")]
    x = x.select("*", *[g for g in group if not isinstance(g, str)])
    names = by or ["g_"]
    x = average_rank(average_rank(x, names, "a", "ra"), names, "b", "rb")
    d = F.abs(F.col("a") - F.col("b"))
    # 1 - sum (a - b)^2 / sum over all pairs of marginals (a - b)^2 / n, which needs sums and squares only
    n, sa, sb = F.count("*"), F.sum("a"), F.sum("b")
    expected = F.sum(F.col("a") ** 2) + F.sum(F.col("b") ** 2) - 2 * sa * sb / n
    kappa = 1 - F.sum((F.col("a") - F.col("b")) ** 2) / F.nullif(expected, F.lit(0.0))
    out = x.groupBy(*names).agg(n.alias("n"), F.round(F.corr("a", "b"), 6).alias("pearson"), F.round(F.corr("ra", "rb"), 6).alias("spearman"), F.round(F.avg(d), 6).alias("mae"), F.round(kappa, 6).alias("kappa"), F.round(F.avg((d <= 0.5).cast("double")), 6).alias("within_half"), F.round(F.avg((d <= 1).cast("double")), 6).alias("within_one"))
    return out if by else out.drop("g_")


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: tau_b, from the counts of distinct (a, b) cells; pairs of cells stand for all pairs of rows, so the work grows with the
    number of distinct scores and not with the rows."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    other = cells.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
    s = cells.join(other, F.col("a") < F.col("a2")).agg(F.sum(F.col("n") * F.col("n2") * F.signum(F.col("b2") - F.col("b"))).alias("s"))
    ties = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(name))
    all_ = cells.agg((F.sum("n") * (F.sum("n") - 1) / 2).alias("pairs"))
    x = s.crossJoin(all_).crossJoin(ties("a", "ta")).crossJoin(ties("b", "tb"))  # four tables of one row
    return x.select(F.round(F.col("s") / F.sqrt((F.col("pairs") - F.col("ta")) * (F.col("pairs") - F.col("tb"))), 6).alias("tau_b"))


def krippendorff(df: DataFrame, unit: str, value: str) -> DataFrame:
    """One row: alpha for interval data, from sums and squares of each unit with two ratings or more."""
    u = df.where(F.col(value).isNotNull()).groupBy(unit).agg(F.count("*").alias("m"), F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("q")).where("m > 1")
    within = F.sum((2 * F.col("m") * F.col("q") - 2 * F.col("s") ** 2) / (F.col("m") - 1))
    n, s, q = F.sum("m"), F.sum("s"), F.sum("q")
    return u.agg(F.round(1 - (within / n) / F.nullif((2 * n * q - 2 * s * s) / (n * (n - 1)), F.lit(0.0)), 6).alias("alpha"))


def spearman(x: np.ndarray, y: np.ndarray) -> float:
    a, b = ranks(x), ranks(y)
    return float(np.corrcoef(a, b)[0, 1]) if a.std() and b.std() else 0.0


def exact_spearman_p(x: np.ndarray, y: np.ndarray) -> float:
    """Two-sided p over all orders of y; for at most nine points."""
    seen = abs(spearman(x, y))
    every = [abs(spearman(x, np.array(p))) >= seen - 1e-12 for p in permutations(y)]
    return sum(every) / len(every)


def trend(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, slope, intercept, zero (where the fitted line crosses 0)."""
    slope, cut = F.regr_slope(y, x), F.regr_intercept(y, x)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(slope, 6).alias("slope"), F.round(cut, 6).alias("intercept"), F.round(-cut / F.nullif(slope, F.lit(0.0)), 6).alias("zero"))


def rasch(right: np.ndarray, ridge: float = 0.01, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(ability of systems, difficulty of items) of a systems x items matrix of 0, 1 and NaN, by Newton steps on the ridged likelihood."""
    seen = ~np.isnan(right)
    y, a, d = np.nan_to_num(right), np.zeros(right.shape[0]), np.zeros(right.shape[1])
    for _ in range(steps):
        p = seen / (1 + np.exp(d[None, :] - a[:, None]))
        v = p * (1 - p)
        da = ((y - p).sum(1) - ridge * a) / (v.sum(1) + ridge)
        a = a + np.clip(da, -1, 1)
        p = seen / (1 + np.exp(d[None, :] - a[:, None]))
        v = p * (1 - p)
        dd = ((p - y).sum(0) - ridge * d) / (v.sum(0) + ridge)
        d = d + np.clip(dd, -1, 1)
        if max(np.abs(da).max(initial=0), np.abs(dd).max(initial=0)) < 1e-9:
            break
    a, d = a - d.mean(), d - d.mean()
    return np.round(a, 6), np.round(d, 6)
