"""Filters, joins, aggregates, rankings and reports over score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Weights of the composite score and the bounds of accepted answers.
WEIGHTS = (("correctness", 0.4), ("completeness", 0.3), ("clarity", 0.2), ("conciseness", 0.1))
BOUNDS = {"rag_unanswerable": (40, 240), "rag": (100, 420), "": (80, 420)}
LOW_QUALITY = r"(?iU)(table of contents|acknowledgements|organization of thesis|chapter 1|chapter 2|references\s+\d)"
META_TALK = r"(?iU)(as an ai|i do not have access|i cannot browse|language model)"
# End of fixed values.


def composite(weights: tuple = WEIGHTS) -> Column:
    out = F.lit(0.0)
    for name, w in weights:
        out = out + F.col(name) * w
    return out


def overlap(response: Column, evidence: Column) -> Column:
    """Share of the response's content tokens that the evidence has; 0 when either has none."""
    r, e = T.content_tokens(response), T.content_tokens(evidence)
    return F.when((F.size(r) > 0) & (F.size(e) > 0), F.size(F.array_intersect(r, e)) / F.size(r)).otherwise(0.0)


def _bounds(category: Column, split: Column) -> tuple[Column, Column]:
    pick = lambda i: F.when(category == "rag_unanswerable", BOUNDS["rag_unanswerable"][i]).when(split == "rag", BOUNDS["rag"][i]).otherwise(BOUNDS[""][i])
    return pick(0), pick(1)


def reject_reason(df: DataFrame) -> DataFrame:
    """df(system, question, response, category, source_split, paper_title, evidence_text, n_evidence) with `reason` (first failing check,
    empty: none) and `quality` = 2 * in range + overlap + 0.2 * cites, 4 digits."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    words, low, high = T.word_count(text("response")), *_bounds(text("category"), text("source_split"))
    common = overlap(text("response"), text("evidence_text"))
    head, asks = text("question").startswith("Excerpts:\n\n"), F.contains(text("question"), F.lit("\n\nQuestion: "))
    shape = F.when(text("source_split") == "rag", head & asks).otherwise(~head)
    blank = F.lit(False)
    for c in ("system", "question", "response", "category"):
        blank = blank | (F.length(T.strip(text(c))) == 0)
    dirty = F.lit(False)
    for c in ("question", "response", "evidence_text"):
        dirty = dirty | text(c).rlike(LOW_QUALITY)
    reason = (
        F.when(blank, "missing_required_fields")
        .when(~shape, "bad_question_format")
        .when(F.coalesce("n_evidence", F.lit(0)) == 0, "missing_evidence")
        .when(dirty, "low_quality_front_matter")
        .when(text("response").rlike(META_TALK), "assistant_meta_language")
        .when(words < low, "response_too_short")
        .when(words > high, "response_too_long")
        .when(common < 0.05, "low_evidence_overlap")
        .when(text("paper_title") == "Unknown", "unknown_paper_title")
        .otherwise("")
    )
    cites = text("response").contains("[1]") | text("response").contains("[2]")
    quality = F.bround(F.when(words.between(low, high), 2.0).otherwise(0.0) + common + F.when(cites, 0.2).otherwise(0.0), 4)
    return df.withColumn("reason", reason).withColumn("quality", quality)


def good_bad(df: DataFrame, score: str | None, good: float, bad: float) -> DataFrame:
    """df with `side`: good above one strict bound, bad below the other; rows without a numeric score go. The score column is found by
    name when none is given."""
    score = score or next(c for n in ("overall", "score", "rating") for c in df.columns if n in c.lower())
    s = F.expr(f"try_cast({score} as double)")
    return df.where(s.isNotNull()).withColumn("side", F.when(s > good, "good").when(s < bad, "bad").otherwise("middle"))


def one_to_one(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that refuses double keys on either side and lost rows of a."""
    for side, name in ((a, "left"), (b, "right")):
        if not side.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"double keys on the {name} side")
    if not a.join(b, on, "left_anti").isEmpty():
        raise ValueError("rows without a partner")
    return a.join(b, on)


def same_keys(a: DataFrame, b: DataFrame, on: list[str]) -> bool:
    """Whether both sides cover the same keys."""
    x, y = a.select(*on).distinct().withColumn("l_", F.lit(1)), b.select(*on).distinct().withColumn("r_", F.lit(1))
    return x.join(y, on, "full_outer").where("l_ is null or r_ is null").isEmpty()


def answered_by_all(df: DataFrame, item: str, system: str) -> DataFrame:
    """Items that every system answered."""
    n = df.agg(F.count_distinct(system)).first()[0]
    return df.groupBy(item).agg(F.count_distinct(system).alias("n_")).where(F.col("n_") == n).select(item)


def nested_lookup(df: DataFrame, key: str, refs: str, table: DataFrame, on: str, value: str) -> DataFrame:
    """(key, values): table's value for each element of the array column refs, in its order; null where there is none."""
    x = df.select(key, F.posexplode_outer(refs).alias("i_", on)).join(table.select(on, value), on, "left")
    got = x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i_", value))).alias("v_"))
    return got.select(key, F.transform("v_", lambda s: s[value]).alias("values"))


def drop_if_empty(df: DataFrame, column: str) -> DataFrame:
    """df without a column that is empty in every row; an error if it is not."""
    if not df.where(F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "")).isEmpty():
        raise ValueError(f"{column} has values")
    return df.drop(column)


def require_known(df: DataFrame, key: str, known: DataFrame, on: str) -> DataFrame:
    """df, or an error if a key is unknown."""
    missing = df.select(F.col(key).alias(on)).where(F.col(on).isNotNull()).distinct().join(known.select(on), on, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"unknown: {[r[0] for r in missing]}")
    return df


def average_rank(df: DataFrame, by: list[str], value: str, name: str, descending: bool = False) -> DataFrame:
    """Add the rank of value inside its group, ties sharing their mean rank. Values are counted before they are ordered, so what a
    window holds is the distinct values and not the rows."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n_"))
    w = Window.partitionBy(*by).orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, -1)
    r = n.withColumn(name, F.coalesce(F.sum("n_").over(w), F.lit(0)) + (F.col("n_") + 1) / 2)
    return df.join(r.drop("n_"), [*by, value])


def best_per_group(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """The row with the greatest value of each group, the least tie key first."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min(F.struct((-F.col(value)).alias("v_"), F.col(tie).alias("t_"), F.struct(*rest).alias("r_"))).alias("b_"))
    return best.select(*by, "b_.r_.*")


def islands(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """by, first, last, n: runs of consecutive rows (in order) for which flag holds."""
    w = Window.partitionBy(*by).orderBy(order)
    x = df.withColumn("a_", F.row_number().over(w)).where(flag).withColumn("g_", F.col("a_") - F.row_number().over(w))
    return x.groupBy(*by, "g_").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("g_")


def strictly_rising(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, rising: whether value grows from each row to the next."""
    prev = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("ok_", F.coalesce(F.col(value) > prev, F.lit(True))).groupBy(*by).agg(F.every("ok_").alias("rising"))


def wins(a: DataFrame, b: DataFrame, on: str, value: str, by: list[str]) -> DataFrame:
    """by, n, wins, ties, losses, delta of b against a on common items."""
    x = a.select(on, *by, F.col(value).alias("a_")).join(b.select(on, F.col(value).alias("b_")), on)
    d = F.col("b_") - F.col("a_")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return x.groupBy(*by).agg(F.count("*").alias("n"), count(d > 0).alias("wins"), count(d == 0).alias("ties"), count(d < 0).alias("losses"), F.round(F.avg(d), 6).alias("delta"))


def deviations(df: DataFrame, a: str, b: str, slices: dict[str, str], within: float, over: float) -> DataFrame:
    """One row a slice (a predicate; slices may overlap): n, mean absolute and mean difference, shares within and over bounds, maximum,
    correlation, share of equal signs about 3. All slices come from one pass: each row goes to the slices it satisfies."""
    tags = F.filter(F.array(*[F.when(F.expr(p), F.lit(name)) for name, p in slices.items()]), lambda x: x.isNotNull())
    d = F.col(b) - F.col(a)
    same = F.signum(F.col(a) - 3) == F.signum(F.col(b) - 3)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("slice", F.explode(tags))
    return x.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(d)), 6).alias("mad"), F.round(F.avg(d), 6).alias("bias"), share(F.abs(d) <= within).alias("within"), share(F.abs(d) > over).alias("over"), F.round(F.max(F.abs(d)), 6).alias("worst"), F.round(F.corr(a, b), 6).alias("corr"), share(same).alias("same_sign"))


def difficulty(weak: Column, mid: Column, strong: Column) -> Column:
    """Null (dropped) when the strong model fails; easy, medium or hard by who else succeeds."""
    return F.when(~strong, F.lit(None).cast("string")).when(weak & mid, "easy").when(mid, "medium").otherwise("hard")


def confidence(*checks: Column) -> Column:
    """STRONG, LIKELY or WEAK by the number of passed checks; a missing check passes."""
    n = F.lit(0)
    for c in checks:
        n = n + F.coalesce(c, F.lit(True)).cast("int")
    return F.when(n >= 3, "STRONG").when(n == 2, "LIKELY").otherwise("WEAK")


def threshold_grid(df: DataFrame, a: str, b: str, extra: str, xs: list[float], ys: list[float]) -> DataFrame:
    """x, y, n: rows with |a| >= x, |b| >= y and extra, for each pair of thresholds; the grid is a list of literals."""
    grid = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in xs for y in ys])
    hit = df.where(extra).select(F.abs(a).alias("a_"), F.abs(b).alias("b_"), F.inline(grid))
    return hit.groupBy("x", "y").agg(F.sum(((F.col("a_") >= F.col("x")) & (F.col("b_") >= F.col("y"))).cast("int")).alias("n"))
