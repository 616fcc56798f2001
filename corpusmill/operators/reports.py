"""Report tables over scores, logs and runs. Each is one aggregation (or two at most), so a hot group is combined before it is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n(c: Column) -> Column:
    """Rows for which c holds."""
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def _share(n: Column, total: Column, digits: int = 6) -> Column:
    return F.round(n / F.greatest(total, F.lit(1)), digits)


def presence(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """One row a key of `row`, one column a value: `yes` where they occur together, else a dash."""
    grid = df.groupBy(row).pivot(column, values).count()
    return grid.select(row, *[F.when(F.col(f"`{v}`") > 0, "yes").otherwise("—").alias(v) for v in values])


def dimension_report(df: DataFrame, by: list[str], measures: list[str], digits: int = 2) -> DataFrame:
    """by, dimension, n, mean, least, most: every measure from one aggregation; 0.0 where a group has no number."""
    stat = lambda f, m: F.coalesce(F.round(f(m), digits), F.lit(0.0))
    row = lambda m: F.struct(F.lit(m).alias("dimension"), F.count(m).alias("n"), stat(F.avg, m).alias("mean"), stat(F.min, m).alias("least"), stat(F.max, m).alias("most"))
    return df.groupBy(*by).agg(F.array(*[row(m) for m in measures]).alias("r_")).select(*by, F.inline("r_"))


def counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """counter, value, n: how often each value stands in each of the columns; null counts as empty."""
    pairs = F.array(*[F.struct(F.lit(c).alias("counter"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("counter", "value").agg(F.count("*").alias("n"))


def reject_rates(df: DataFrame, by: str, reason: str, checks: list[str]) -> DataFrame:
    """by, check, rejected, candidates, rate for each source and for all of them (null source), zero rejections included."""
    one = [F.struct(F.lit(c).alias("check"), _n(F.col(reason) == c).alias("rejected"), F.count("*").alias("candidates")) for c in checks]
    got = df.rollup(by).agg(F.array(*one).alias("r_")).select(by, F.inline("r_"))
    return got.withColumn("rate", _share(F.col("rejected"), F.col("candidates")))


def calibration(df: DataFrame, difficulty: str, targets: dict[str, float], tiers: dict[str, str]) -> DataFrame:
    """kind, name, n, share, gap: rows of each difficulty among the accepted (gap: share less its target), rows that each tier answered
    right and rows without a difficulty (dropped) among all."""
    kept = F.count(difficulty)
    found = [F.struct(F.lit("difficulty").alias("kind"), F.lit(d).alias("name"), _n(F.col(difficulty) == d).alias("n"), kept.alias("of"), F.lit(goal).alias("goal")) for d, goal in targets.items()]
    none = F.lit(None).cast("double").alias("goal")
    found += [F.struct(F.lit("tier").alias("kind"), F.lit(k).alias("name"), _n(F.expr(p)).alias("n"), F.count("*").alias("of"), none) for k, p in tiers.items()]
    found.append(F.struct(F.lit("dropped").alias("kind"), F.lit("all").alias("name"), _n(F.col(difficulty).isNull()).alias("n"), F.count("*").alias("of"), none))
    rows = df.agg(F.array(*found).alias("r_")).select(F.inline("r_"))
    share = F.col("n") / F.greatest(F.col("of"), F.lit(1))
    return rows.select("kind", "name", "n", F.round(share, 6).alias("share"), F.round(share - F.col("goal"), 6).alias("gap"))


def hardware(df: DataFrame, by: str, order: str, first: list[str], peaks: list[str]) -> DataFrame:
    """by, the attributes of the first run in `order`, and each peak over all runs; a peak of 0 was not recorded and is null."""
    head = F.min_by(F.struct(*first), F.col(order)).alias("f_")
    return df.groupBy(by).agg(head, *[F.nullif(F.max(p), F.lit(0.0)).alias(p) for p in peaks]).select(by, "f_.*", *peaks)


def run_summary(df: DataFrame, by: list[str], averages: list[str], peaks: list[str], digits: int = 6) -> DataFrame:
    """by, runs, averages over the runs that have the number, and peaks."""
    return df.groupBy(*by).agg(F.count("*").alias("runs"), *[F.round(F.avg(a), digits).alias(a) for a in averages], *[F.max(p).alias(p) for p in peaks])


def length_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, least, most, mean (1 digit), the upper median and the entry at place floor(0.95 n) of the sorted lengths.

    Lengths are counted before they are ordered, so a window holds distinct lengths and not rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c_"))
    group = Window.partitionBy(*by)
    upto = F.sum("c_").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    x = counts.select("*", upto.alias("e_"), F.sum("c_").over(group).alias("n_"))
    at = lambda place: F.min(F.when(F.col("e_") > place, F.col(value)))
    mean = F.round(F.sum(F.col(value) * F.col("c_")) / F.first("n_"), 1)
    out = x.groupBy(*by).agg(F.first("n_").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), mean.alias("mean"), at(F.floor(F.col("n_") / 2)).alias("median"), at(F.floor(F.col("n_") * 0.95)).alias("p95"))
    return out


def perplexity(df: DataFrame, by: list[str], loss: str, tokens: str, digits: int = 6) -> DataFrame:
    """by, loss, perplexity: the mean loss weighted by tokens and its exponential; null without tokens."""
    mean = F.sum(F.col(loss) * F.col(tokens)) / F.nullif(F.sum(F.when(F.col(loss).isNotNull(), F.col(tokens))).cast("double"), F.lit(0.0))
    x = df.groupBy(*by).agg(mean.alias("m_"))
    return x.select(*by, F.round("m_", digits).alias("loss"), F.round(F.exp("m_"), digits).alias("perplexity"))


def best_then_enough(df: DataFrame, by: str, value: str, most: int, least: float) -> DataFrame:
    """The `most` keys of the greatest value (ties: the least key), of which those below `least` then go: fewer may stay."""
    top = df.groupBy(by).agg(F.max(value).alias("score")).orderBy(F.desc("score"), by).limit(most)
    return top.where(F.col("score") >= least)


def folded_logs(df: DataFrame, by: str, check: str, passed: Column, note: str) -> DataFrame:
    """by, passed_checks (distinct, sorted) and issues (every failed check's note, sorted): the log lines of an item in one row."""
    ok = F.array_sort(F.collect_set(F.when(passed, F.col(check))))
    bad = F.array_sort(F.collect_list(F.when(~passed, F.struct(check, note))))
    return df.groupBy(by).agg(ok.alias("passed_checks"), bad.alias("issues"))


def composition(df: DataFrame, refs: str, kind: str, words: Column) -> DataFrame:
    """One row a kind: items, percent of all (whole, half to even), distinct references, and mean, median and range of the word counts.

    References are made distinct before they are counted, so a row never multiplies the word counts."""
    seen = df.select(kind, F.explode(refs).alias("x_")).distinct().groupBy(kind).agg(F.count("x_").alias("references"))
    base = df.select(kind, words.alias("w_")).groupBy(kind).agg(F.count("*").alias("items"), F.bround(F.avg("w_")).cast("long").alias("mean"), F.bround(F.percentile("w_", F.lit(0.5))).cast("long").alias("median"), F.min("w_").alias("least"), F.max("w_").alias("most"))
    out = base.join(seen, kind, "left").withColumn("t_", F.sum("items").over(Window.partitionBy()))
    return out.select(kind, "items", F.bround(100 * F.col("items") / F.col("t_")).cast("long").alias("percent"), F.coalesce("references", F.lit(0)).cast("long").alias("references"), "mean", "median", "least", "most")


def by_setting(df: DataFrame, by: str, setting: str, a: str, b: str, value: str, digits: int = 6) -> DataFrame:
    """by, the means under settings a and b, their numbers, and b less a."""
    mean = lambda s: F.avg(F.when(F.col(setting) == s, F.col(value)))
    x = df.groupBy(by).agg(mean(a).alias("a_"), mean(b).alias("b_"), _n(F.col(setting) == a).alias("n_a"), _n(F.col(setting) == b).alias("n_b"))
    return x.select(by, F.round("a_", digits).alias("mean_a"), F.round("b_", digits).alias("mean_b"), "n_a", "n_b", F.round(F.col("b_") - F.col("a_"), digits).alias("delta"))


def slice_means(df: DataFrame, by: str, value: str, total: str = "all", digits: int = 6) -> DataFrame:
    """slice, mean, n, place: slices and the total, by falling mean."""
    x = df.rollup(by).agg(F.round(F.avg(value), digits).alias("mean"), F.count(value).alias("n"), F.grouping(by).alias("g_"))
    name = F.when(F.col("g_") == 1, total).otherwise(F.col(by))
    return x.select(name.alias("slice"), "mean", "n", F.row_number().over(Window.orderBy(F.desc("mean"), name)).alias("place"))


def newest(df: DataFrame, key: str, refs: str, years: DataFrame, on: str, year: str) -> DataFrame:
    """key, newest: the greatest year among an item's references; items without a known one are absent."""
    x = df.select(key, F.explode(F.array_distinct(refs)).alias(on)).join(years.select(on, year), on)
    return x.where(F.col(year).isNotNull()).groupBy(key).agg(F.max(year).alias("newest"))


def level_offset(df: DataFrame, by: list[str], shift: Column, digits: int = 6) -> DataFrame:
    """by, n, mean and sample deviation of the shift, median and 95th percentile of its size, and the greatest size."""
    x = df.select(*by, shift.alias("s_")).where(F.col("s_").isNotNull())
    q = lambda p: F.round(F.percentile(F.abs("s_"), F.lit(p)), digits)
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("s_"), digits).alias("mean"), F.round(F.stddev_samp("s_"), digits).alias("sd"), q(0.5).alias("median"), q(0.95).alias("p95"), F.round(F.max(F.abs("s_")), digits).alias("most"))


def verdict_flips(df: DataFrame, by: list[str], a: Column, b: Column, bar: float) -> DataFrame:
    """by, n, over the bar under a, of these still so under b, verdicts that flip either way, signs that flip, their rates, and
    differences that move by more than the bar."""
    x = df.select(*by, a.alias("a_"), b.alias("b_")).where("a_ is not null and b_ is not null")
    big_a, big_b = F.abs("a_") >= bar, F.abs("b_") >= bar
    sign = F.signum("a_") != F.signum("b_")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return x.groupBy(*by).agg(F.count("*").alias("n"), _n(big_a).alias("over"), _n(big_a & big_b).alias("held"), _n(big_a != big_b).alias("verdict_flips"), rate(big_a != big_b).alias("verdict_rate"), _n(sign).alias("sign_flips"), rate(sign).alias("sign_rate"), _n(F.abs(F.col("b_") - F.col("a_")) > bar).alias("moved"))


def consensus(df: DataFrame, unit: str, weights: dict[str, float], digits: int = 4) -> DataFrame:
    """unit, raters, the mean of each dimension over the raters, and their weighted sum."""
    x = df.groupBy(unit).agg(F.count("*").alias("raters"), *[F.avg(d).alias(d) for d in weights])
    total = reduce(lambda s, d: s + F.col(d) * weights[d], list(weights)[1:], F.col(next(iter(weights))) * next(iter(weights.values())))
    return x.select(unit, "raters", *[F.round(d, digits).alias(d) for d in weights], F.round(total, digits).alias("composite"))


def order_rank(df: DataFrame, by: list[str], value: str, tie: str, name: str = "place") -> DataFrame:
    """df with its place by falling value inside a group; ties go by the tie key, so places are 1 to n without gaps."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie)))


def leaderboard(a: DataFrame, b: DataFrame, system: str, value: str, digits: int = 6) -> DataFrame:
    """system, mean_a, mean_b, rank_a, rank_b, rank_delta of the systems that both judges scored; best first, ties by name.

    Only one mean a system is ranked."""
    mean = lambda df, n: df.groupBy(system).agg(F.round(F.avg(value), digits).alias(n))
    both = mean(a, "mean_a").join(mean(b, "mean_b"), system)
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), system))
    x = both.withColumn("rank_a", rank("mean_a")).withColumn("rank_b", rank("mean_b"))
    return x.withColumn("rank_delta", F.col("rank_a") - F.col("rank_b"))


def sign_flips(overall: DataFrame, strata: DataFrame, on: list[str], stratum: str, effect: str) -> DataFrame:
    """on, stratum, overall, effect: strata whose effect has another sign than the overall one."""
    x = strata.select(*on, stratum, effect).join(overall.select(*on, F.col(effect).alias("overall")), on)
    return x.where(F.signum(effect) != F.signum("overall")).select(*on, stratum, "overall", effect)


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows under the union of the columns; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def cluster_summary(df: DataFrame, cluster: str) -> DataFrame:
    """items, clusters, mean and greatest size, the design effect if members of a cluster always agree (the mean size) and how much
    wider intervals then are (its root)."""
    s = df.groupBy(cluster).agg(F.count("*").alias("s_"))
    return s.agg(F.sum("s_").alias("items"), F.count("*").alias("clusters"), F.round(F.avg("s_"), 3).alias("mean_size"), F.max("s_").alias("max_size"), F.round(F.sqrt(F.avg("s_")), 3).alias("ci_inflation")).withColumn("design_effect", F.col("mean_size"))


def paired_judges(a: DataFrame, b: DataFrame, keys: list[str], dimensions: list[str]) -> DataFrame:
    """keys, <dimension>_a, <dimension>_b of the keys that both judges scored; a key that one judge has twice is an error."""
    for side in (a, b):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("a judge scored one key twice")
    mark = lambda df, m: df.select(*keys, *[F.col(d).alias(f"{d}_{m}") for d in dimensions])
    return mark(a, "a").join(mark(b, "b"), keys)


def speedup(a: DataFrame, b: DataFrame, key: str, order: str, value: str, digits: int = 6) -> DataFrame:
    """key, a, b, ratio: the last run of each key on either side and a / b (null where b is 0)."""
    last = lambda df, n: df.groupBy(key).agg(F.max_by(value, order).alias(n))
    x = last(a, "a").join(last(b, "b"), key)
    return x.withColumn("ratio", F.round(F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), digits))


def variant(run: Column, baselines: list[str]) -> Column:
    """struct(code, setting) of a run by its name: baselines, then by the kinds of training it names; retrieval lifts three of the codes."""
    n = F.lower(run)
    rag, cpt, lora, sft = (n.contains(m) for m in ("rag-", "cpt", "lora", "sft"))
    base = F.when(~sft & ~cpt, "P1").when(lora & cpt & sft, "P5").when(lora & sft, "P2").when(cpt & sft, "P4").when(sft, "P3").otherwise("P?")
    lifted = F.when(base == "P1", "P6").when(base == "P4", "P7").when(base == "P5", "P8").otherwise(F.concat(base, F.lit("+RAG")))
    code = F.when(n.isin([b.lower() for b in baselines]), "BASE-API").when(rag, lifted).otherwise(base)
    return F.struct(code.alias("code"), F.when(code.isin("P6", "P7", "P8"), "open_book").otherwise("closed_book").alias("setting"))


def equivalence_verdict(difference: Column, p_differs: Column, p_equivalent: Column, q: float = 0.05) -> Column:
    """The four outcomes of a test against zero and one for equivalence within the margin."""
    side = F.when(difference > 0, "higher").otherwise("lower")
    differs, same = p_differs <= q, p_equivalent <= q
    return F.when(differs & same, F.concat(side, F.lit(", but below the practical margin"))).when(differs, F.concat(F.lit("meaningfully "), side)).when(same, "equivalent").otherwise("inconclusive")


def normalization_report(papers: DataFrame) -> DataFrame:
    """One row over papers(method, source_pdf, sections, confidence, total_section_tokens): counts and averages; zeros for none."""
    avg = lambda c, d: F.coalesce(F.round(F.avg(c), d), F.lit(0.0))
    structured = _n(F.col("method") == "structured")
    return papers.agg(F.count("*").alias("papers"), structured.alias("structured"), (F.count("*") - structured).alias("fallback"), _n(F.col("source_pdf") != "").alias("mapped"), avg(F.size("sections"), 2).alias("sections"), avg("confidence", 3).alias("confidence"), avg("total_section_tokens", 1).alias("section_tokens"))
