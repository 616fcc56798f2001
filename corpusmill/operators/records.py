"""Checks, promotion, routing and sampling of generated records: cards, drafts, anchors, study sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sampling import order_key

# Lengths and words that decide about a record.
LEAST_PROBLEM = 15
NOT_OURS = ("not hpn", "not hpn-relevant")
QUOTE, BACKFILL, KEYWORDS = 480, 240, 7
LEAST_ANCHOR_WORDS = 20
FRONT_MATTER = r"(?i)(table of contents|acknowledgements|chapter 1|chapter 2|organization of thesis|abstract \.\s*v)"
# End of fixed values.


def low_quality_chunk(text: Column, title: Column) -> Column:
    """Chunks that are empty, of an unknown paper, front matter, or the dotted lines of a table of contents."""
    x = T.strip(F.coalesce(text, F.lit("")))
    dots = x.startswith(".") & F.lower(F.substring(x, 1, 120)).contains("chapter")
    return (F.length(x) == 0) | F.coalesce(title == "Unknown", F.lit(False)) | x.rlike(FRONT_MATTER) | dots


def generation_papers(papers: DataFrame, score: Column, least_confidence: float, least_score: int, limit: int = 0) -> DataFrame:
    """Structured papers with a title, enough confidence, no front matter as abstract and a keyword score of at least `least_score`, the best
    `limit` (0: all): by score, confidence, number of sections, section tokens, then paper_id."""
    fit = papers.withColumn("keyword_score", score).where((F.col("method") == "structured") & (F.col("confidence") >= least_confidence) & (F.col("title") != "Unknown"))
    fit = fit.where(~F.coalesce("abstract", F.lit("")).rlike(FRONT_MATTER) & (F.col("keyword_score") >= least_score))
    best = fit.orderBy(F.desc("keyword_score"), F.desc("confidence"), F.desc(F.size("sections")), F.desc("total_section_tokens"), "paper_id")
    return best.limit(limit) if limit > 0 else best


def good_anchors(df: DataFrame, category: str, question: str, response: str, order: str, least: int = LEAST_ANCHOR_WORDS) -> DataFrame:
    """Rows with a question and a response of `least` words or more; of equal (category, question, response), white space and case
    aside, the first in `order`. Null counts as empty; the first is found by min before the shuffle, so a hot key stays cheap."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fit = df.where((F.length(T.strip(text(question))) > 0) & (F.length(T.strip(text(response))) > 0) & (T.word_count(text(response)) >= least))
    key = F.sha2(F.concat_ws("\x1f", *[F.lower(T.squeeze(text(c))) for c in (category, question, response)]), 256)
    marked = fit.withColumn("key_", key)
    first = marked.groupBy("key_").agg(F.min(order).alias(order))
    return marked.join(first, ["key_", order], "left_semi").drop("key_")


def schema_error(rules: dict[str, str]) -> Column:
    """Name of the first rule (a predicate) that a row breaks, empty if none; a rule without an answer is broken."""
    out = None
    for name, rule in rules.items():
        bad = ~F.coalesce(F.expr(rule), F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return F.lit("") if out is None else out.otherwise("")


def checked_cards(cards: DataFrame, key: str, problem: str, anchors: str, passages: DataFrame, passage: str) -> DataFrame:
    """key, reason, anchors, n_bogus, n_repeated for cards(key, problem, anchors array<struct<passage, ..>>).

    Anchors of unknown passages go, then all but the first of each passage. reason: self_reported, short_problem, no_anchors or empty."""
    at = cards.select(key, F.posexplode(anchors).alias("i_", "a_")).withColumn(passage, F.col(f"a_.{passage}"))
    known = at.join(passages.select(passage).distinct().withColumn("known_", F.lit(1)), passage, "left")
    one = known.groupBy(key, passage).agg(F.min(F.struct("i_", "a_")).alias("m_"), F.count("*").alias("c_"), F.max("known_").alias("known_"))
    real = F.col("known_").isNotNull()
    kept = one.groupBy(key).agg(F.array_sort(F.collect_list(F.when(real, F.col("m_")))).alias("k_"), F.sum(F.when(real, 0).otherwise(F.col("c_"))).alias("n_bogus"), F.sum(F.when(real, F.col("c_") - 1).otherwise(0)).alias("n_repeated"))
    x = cards.join(kept, key, "left")
    p = F.lower(T.strip(F.coalesce(F.col(problem), F.lit(""))))
    foreign = F.lit(False)
    for w in NOT_OURS:
        foreign = foreign | p.contains(w)
    got = F.coalesce(F.transform("k_", lambda s: s["a_"]), F.array().cast(cards.schema[anchors].dataType))
    reason = F.when(foreign, "self_reported").when(F.length(p) < LEAST_PROBLEM, "short_problem").when(F.size(got) == 0, "no_anchors").otherwise("")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return x.select(key, reason.alias("reason"), got.alias("anchors"), zero("n_bogus"), zero("n_repeated"))


def promoted(drafts: DataFrame, key: str, paper: str, evidence: str, passages: DataFrame, passage: str, text: str, categories: list[str], other: str) -> DataFrame:
    """Drafts(key, paper, question, reference_answer, category, keywords, evidence array<struct<passage, quote>>) as question records.

    Drafts without a question or an answer go. Evidence of passages that the paper does not have goes; where none is left, the paper's
    least passage with its first characters stands in; a paper without passages loses its drafts. Unknown categories become `other`."""
    full = lambda c: F.length(T.strip(F.coalesce(F.col(c), F.lit("")))) > 0
    d = drafts.where(full("question") & full("reference_answer"))
    own = passages.select(paper, passage).distinct()
    at = d.select(key, paper, F.posexplode(evidence).alias("i_", "e_")).withColumn(passage, F.col(f"e_.{passage}"))
    item = F.struct("i_", F.col(passage).alias("passage_id"), F.substring(T.strip(F.coalesce(F.col("e_.quote"), F.lit(""))), 1, QUOTE).alias("quote"))
    good = at.join(own, [paper, passage]).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["passage_id"].alias("passage_id"), s["quote"].alias("quote"))).alias("good_"))
    least = passages.groupBy(paper).agg(F.min(F.struct(F.col(passage).alias("passage_id"), F.substring(F.coalesce(F.col(text), F.lit("")), 1, BACKFILL).alias("quote"))).alias("least_"))
    x = d.join(good, key, "left").join(least, paper, "left").where("good_ is not null or least_ is not null")
    words = F.filter(F.transform(F.coalesce(F.col("keywords"), F.array().cast("array<string>")), T.strip), lambda w: F.length(w) > 0)
    kind = F.when(F.col("category").isin(categories), F.col("category")).otherwise(other)
    return x.select(key, paper, kind.alias("category"), T.strip(F.col("question")).alias("question"), T.strip(F.col("reference_answer")).alias("reference_answer"), F.coalesce("good_", F.array("least_")).alias("evidence"), F.col("good_").isNull().alias("backfilled"), F.slice(words, 1, KEYWORDS).alias("keywords"))


def routed(df: DataFrame, key: str, prefixes: dict[str, str]) -> DataFrame:
    """df with `route`, the pool of the first prefix that its key has; other keys go. A key that occurs twice is an error."""
    route = F.lit(None).cast("string")
    for p, name in reversed(prefixes.items()):
        route = F.when(F.col(key).startswith(p), name).otherwise(route)
    out = df.withColumn("route", route).where("route is not null")
    twice = out.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"double keys: {[r[0] for r in twice]}")
    return out


def require_sources(counts: dict[str, int], strict: bool = True) -> dict[str, int]:
    """counts, or an error that names the sources without a row."""
    empty = [k for k, n in counts.items() if n == 0]
    if strict and empty:
        raise ValueError(f"sources without rows: {', '.join(empty)}")
    return counts


def append_exactly(base: DataFrame, anchors: DataFrame, keys: list[str], order: str, count: int, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Exactly `count` anchors that base does not have (white space and case aside), with `part`: the first round(count * share) of the
    hash order are for validation. Fewer than `count` is an error. The order is total: equal hashes go by key."""
    sig = F.sha2(F.concat_ws("\x1f", *[F.lower(T.squeeze(F.coalesce(F.col(k), F.lit("")))) for k in keys]), 256)
    free = anchors.withColumn("sig_", sig).join(base.select(sig.alias("sig_")).distinct(), "sig_", "left_anti").drop("sig_")
    h = order_key(seed, F.col(order))
    got = free.withColumn("h_", h).orderBy("h_", order).limit(count)
    r = F.row_number().over(Window.orderBy("h_", order))
    out = got.withColumn("part", F.when(r <= round(count * share), "validation").otherwise("train")).drop("h_")
    if out.count() < count:
        raise ValueError(f"fewer than {count} anchors are left")
    return out


def study_sample(df: DataFrame, key: str, stratum: str, fixed: list, fill: dict[str, int], seed: int = 42) -> DataFrame:
    """df's rows of the fixed keys, and of each stratum so many others, the first in hash order."""
    taken = F.col(key).isin(fixed)
    most = F.lit(0)
    for s, k in fill.items():
        most = F.when(F.col(stratum) == s, k).otherwise(most)
    r = F.row_number().over(Window.partitionBy(stratum).orderBy("h_", key))
    rest = df.where(~taken).withColumn("h_", order_key(seed, F.col(key))).withColumn("r_", r).where(F.col("r_") <= max(fill.values(), default=0)).where(F.col("r_") <= most)
    return df.where(taken).withColumn("chosen", F.lit("fixed")).unionByName(rest.drop("h_", "r_").withColumn("chosen", F.lit("fill")))


def cluster_pairs(df: DataFrame, cluster: str, key: str, pairs: int, seed: int = 42) -> DataFrame:
    """cluster, a, b: up to `pairs` pairs of members of each cluster.

    Members stand in hash order and pairs are numbered by their later member, so the first `pairs` pairs need only the first few members
    of a cluster, however large it is: no cluster's pairs are all made."""
    need = 2
    while need * (need - 1) // 2 < pairs:
        need += 1
    r = F.row_number().over(Window.partitionBy(cluster).orderBy("h_", key))
    x = df.select(cluster, key).withColumn("h_", order_key(seed, F.col(key))).withColumn("r_", r).where(F.col("r_") <= need)
    members = x.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("r_", key))).alias("m_"))
    later = lambda j: F.transform(F.slice("m_", 1, j["r_"] - 1), lambda i: F.struct(i[key].alias("x_"), j[key].alias("y_")))
    made = members.select(cluster, F.inline(F.slice(F.flatten(F.transform("m_", later)), 1, pairs)))
    return made.select(cluster, F.least("x_", "y_").alias("a"), F.greatest("x_", "y_").alias("b"))


def known_flags(df: DataFrame, other: DataFrame, text: str, prefix: int) -> DataFrame:
    """df with `same_text` and `same_prefix`: whether another table has a row of equal signature, or of an equal, non-empty letter prefix."""
    keys = lambda d: d.select(F.sha2(T.signature(F.col(text)), 256).alias("s_"), T.prefix_key(F.col(text), prefix).alias("p_"))
    seen = keys(other)
    s = seen.select("s_").distinct().withColumn("hs_", F.lit(True))
    p = seen.select("p_").where("p_ <> ''").distinct().withColumn("hp_", F.lit(True))
    x = df.withColumn("s_", F.sha2(T.signature(F.col(text)), 256)).withColumn("p_", T.prefix_key(F.col(text), prefix))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return x.join(s, "s_", "left").join(p, "p_", "left").select(*df.columns, yes("hs_").alias("same_text"), yes("hp_").alias("same_prefix"))
