"""Mixing by ratio, group selection that skips what overflows, stratified and grouped splits, deterministic order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: shares of the three sources.
RATIOS = {"hpn": 0.6, "rag": 0.2, "generic": 0.2}


def order_key(seed: int, key: Column) -> Column:
    """Hex digest whose text order is the shuffled order."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def feasible(counts: dict[str, int], ratios: dict[str, float] = RATIOS) -> dict[str, int]:
    """Target of each source for the largest total that all of them can fill; the remainder goes by descending ratio."""
    total = min(int(counts.get(k, 0) / r) for k, r in ratios.items() if r > 0)
    out = {k: int(total * r) for k, r in ratios.items()}
    order = sorted(ratios, key=lambda k: -ratios[k])
    for i in range(total - sum(out.values())):
        out[order[i % len(order)]] += 1
    return out


def groups_of(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """grp, size, h: groups with their hash, which gives the order."""
    return df.groupBy(key.alias("grp")).agg(F.count("*").alias("size")).withColumn("h", order_key(seed, F.col("grp")))


def select_groups(groups: DataFrame, target: int) -> DataFrame:
    """Groups taken in the order of h as long as each fits into what is left of target; what does not fit is skipped.

    Each pass takes the longest run of groups that fit together and drops all that are larger than what is left then. Only sums by
    hash prefix (256 of them) reach the driver, and one prefix's groups are ordered in a window: hashes spread evenly."""
    left, rest, taken = target, groups, None
    while left > 0:
        rest = rest.where(F.col("size") <= left)
        sums = sorted(rest.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sum("size").alias("s")).collect())
        if not sums:
            break
        before, edge = 0, None
        for p, s in sums:
            if before + s > left:
                edge = p
                break
            before += s
        whole = rest.where(F.substring("h", 1, 2) < edge) if edge else rest
        if edge:
            inside = rest.where(F.substring("h", 1, 2) == edge)
            run = F.sum("size").over(Window.partitionBy(F.substring("h", 1, 2)).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)) + before
            inside = inside.withColumn("run_", run)
            fits = inside.where(F.col("run_") <= left)
            got = fits.agg(F.max("run_"), F.max("h")).first()
            before, last = (got[0], got[1]) if got[0] is not None else (before, None)
            whole = whole.unionByName(fits.drop("run_"))
            over = inside.where(F.col("run_") > left).agg(F.min("h")).first()[0]
            rest = rest.where(F.col("h") > over)
            del last
        taken = whole if taken is None else taken.unionByName(whole)
        left -= before
        if not edge:
            break
    return taken if taken is not None else groups.limit(0)


def select_rows(df: DataFrame, key: Column, target: int, seed: int) -> DataFrame:
    """Rows of the selected groups; if no group fits, the first group's first rows (by row hash)."""
    g = groups_of(df, key, seed)
    first = g.orderBy("h").limit(1).first()
    marked = df.withColumn("grp_", key)
    if first and first["size"] > target:
        only = marked.where(F.col("grp_").eqNullSafe(F.lit(first["grp"]))).withColumn("r_", order_key(seed, F.to_json(F.struct(*df.columns))))
        return only.orderBy("r_").limit(target).drop("r_", "grp_")
    return marked.join(select_groups(g, target).select(F.col("grp").alias("grp_")), "grp_", "left_semi").drop("grp_")


def validation_groups(groups: DataFrame, share: float) -> DataFrame:
    """Groups of the validation side: in the order of h as long as they fit into share of all rows; at least the first one."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    target = round(total * share)
    val = select_groups(groups, target)
    return val if target == 0 or not val.isEmpty() else groups.orderBy("h").limit(1)


def largest_remainder(raw: list[float], target: int) -> list[int]:
    out = [int(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda i: out[i] - raw[i])[: max(0, target - sum(out))]:
        out[i] += 1
    return out


def stratified(df: DataFrame, strata: list[str], key: str, n_dev: int, n_test: int, seed: int) -> DataFrame:
    """df with `part` (dev, test or rest): places are dealt to the strata by largest remainder and filled in hash order.

    One count a stratum reaches the driver. A stratum's threshold hash is found from its least hashes, so no window holds a whole
    stratum: WindowGroupLimit keeps only the places' worth of rows in each task."""
    counts = sorted(map(tuple, df.groupBy(*strata).count().collect()), key=lambda r: tuple(map(str, r[:-1])))
    sizes, want = [r[-1] for r in counts], n_dev + n_test
    total = sum(sizes)
    take = [min(a, s) for a, s in zip(largest_remainder([s * want / total for s in sizes], min(want, total)), sizes, strict=True)] if total else []
    dev = [min(d, t) for d, t in zip(largest_remainder([t * n_dev / want for t in take], min(n_dev, sum(take))), take, strict=True)]
    h = order_key(seed, F.col(key))
    schema = df.select(*strata).schema.add("take_", "integer").add("dev_", "integer")
    plan = df.sparkSession.createDataFrame([(*r[:-1], t, d) for r, t, d in zip(counts, take, dev, strict=True)], schema)
    most = max(take, default=0)
    ranked = df.select(*strata, key).withColumn("r_", F.row_number().over(Window.partitionBy(*strata).orderBy(h, key))).where(F.col("r_") <= most)
    placed = ranked.join(F.broadcast(plan), strata).where("r_ <= take_").select(key, F.when(F.col("r_") <= F.col("dev_"), "dev").otherwise("test").alias("part"))
    return df.join(placed, key, "left").na.fill("rest", ["part"])


def hash_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """df with `test`: a fixed share of the keys by hash."""
    return df.withColumn("test", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000))


def crossing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides of a split; empty when nothing leaks."""
    return a.select(key).intersect(b.select(key))
