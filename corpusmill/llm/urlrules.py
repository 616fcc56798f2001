"""URL filter by association rules: FP-growth mines the token combinations of labelled URLs, rules that are confident and frequent
enough are kept, and an inverted index from each rule's rarest token finds the rules a URL may satisfy."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, stored, table, width

#: Fixed by the query's contract: host and path of a rule, and what it says.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Share of the labelled URLs that a combination needs, and how often as bad as all labelled URLs it must be, at every size.
SUPPORT, LIFT = 0.005, 1.2
#: The confidence that is compared is the lower end of a Wilson interval so many standard errors wide: few URLs prove little, and of the
#: thousands of combinations that are tried on labels without any rule hardly one passes by chance (1 in 2000 each).
ERRORS = 3.3
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path segments, query names and fragment."""
    h, p = F.split(host(url), "[.]"), F.split(path(url), "[/.]")
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), "&")
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)#(.*)$", 1)
    named = lambda c, mark: F.transform(c, lambda x: F.concat(F.lit(mark), F.lower(x)))
    both = F.concat(named(h, "h:"), named(p, "p:"), named(F.transform(query, lambda x: F.substring_index(x, "=", 1)), "q:"), named(F.array(rest), "f:"))
    return F.array_distinct(F.filter(both, lambda x: F.length(x) > 2))


def curated(h: Column, p: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits the host or a subdomain of it and the path's start; null if none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rh, _, rp = rule.partition("/")
        out = F.when(((h == rh) | h.endswith("." + rh)) & p.startswith("/" + rp), rule).otherwise(out)
    return out


def merged(baskets: DataFrame, support: float, rows: int) -> DataFrame:
    """(id, items): the frequent tokens of each basket (id, tokens), one for all tokens that stand in the same baskets.

    Such tokens have the same rules, so nothing is lost, and a template's many constant parts are one item: without this the item sets
    of one template would be as many as its parts have subsets."""
    each = baskets.select("id", F.explode("tokens").alias("token"))
    where = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("s")).where(F.col("n") >= support * rows)
    names = where.select("token", F.first("token").over(Window.partitionBy("n", "x", "s").orderBy("token")).alias("item"))
    return each.join(names, "token").groupBy("id").agg(F.collect_set("item").alias("items"))


def mine(labelled: DataFrame, support: float = SUPPORT, lift: float = LIFT) -> DataFrame:
    """(antecedent, confidence, support) of rules that name bad URLs, from labelled(url, bad).

    A rule counts if at least `support` of the labelled URLs have its tokens and the lower bound of the share of bad ones among them (ERRORS
    standard errors) is above `lift` times the share among all. The bound is its confidence. A rule goes if a part of it is as confident."""
    spark, schema = labelled.sparkSession, "antecedent array<string>, confidence double, support double"
    urls = stored(labelled.select(F.monotonically_increasing_id().alias("id"), tokens(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")).where("size(tokens) > 0"))
    rows, bad = urls.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
    if not bad:
        return spark.createDataFrame([], schema)
    items = merged(urls, support, rows).join(urls.select("id", "bad"), "id")
    items = items.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(support / 2, 1 / rows), minConfidence=bad / rows, numPartitions=width(spark)).fit(items)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD))
    # support of a rule is of its tokens with the label; that of its tokens alone is support / confidence. FPGrowth knows the share of baskets.
    n, base = items.count(), bad / rows
    k, p, z = F.round(F.col("support") * n / F.col("confidence")), F.col("confidence"), ERRORS
    low = (p + z * z / (2 * k) - z * F.sqrt(p * (1 - p) / k + z * z / (4 * k * k))) / (1 + z * z / k)
    rules = stored(found.select("antecedent", low.alias("confidence"), (k / rows).alias("support")).where((F.col("support") >= support) & (F.col("confidence") > lift * base)))
    # an antecedent is implied if a shorter one inside it is at least as confident; both share the shorter one's first token
    short = rules.select(F.array_sort("antecedent").alias("s"), F.col("confidence").alias("sc")).withColumn("key", F.element_at("s", 1))
    long = rules.select("antecedent", "confidence", F.explode("antecedent").alias("key"))
    implied = long.join(short, "key").where("size(s) < size(antecedent) AND sc >= confidence AND size(array_except(s, antecedent)) = 0").select("antecedent").distinct()
    return rules.join(implied, "antecedent", "left_anti")


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, antecedent) of one rule each distinct URL satisfies: its most confident, then the first by name."""
    toks = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rare = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(toks, "token").groupBy("antecedent", "confidence").agg(F.min(F.struct("n", "token")).alias("m"))
    index = stored(rare.select("antecedent", "confidence", F.col("m.token").alias("token")))
    urls = pages.select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(index) if index.count() <= BROADCAST_IDS // 10 else index, "token")
    hits = hits.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "antecedent")).alias("m")).select("url", F.col("m.antecedent").alias("antecedent"), (-F.col("m.c")).alias("confidence"))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined, confidence of every row.

    A curated rule decides where one fits; elsewhere a URL is blocked if a mined rule fits, else allowed. A null URL or one without
    `://` has empty host and path and fits no curated rule; a null URL has no tokens and is allowed. Rows that repeat get the same answer; without labels nothing is mined; an empty table gives no row; other columns are not read."""
    found = match(pages, mine(labelled))
    h, p = host(F.col("url")), path(F.col("url"))
    out = pages.select("page_id", "url").join(found, "url", "left").select("page_id", h.alias("host"), p.alias("path"), curated(h, p, rules).alias("rule"), "antecedent", "confidence")
    said = F.lit(None).cast("string")
    for rule, verdict in rules:
        said = F.when(F.col("rule") == rule, verdict).otherwise(said)
    return out.select("page_id", "host", "path", "rule", F.coalesce(said, F.when(F.col("antecedent").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.col("antecedent").alias("mined"), "confidence")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(F.expr("toxic = 1 OR quality = 0"), F.lit(False))).alias("bad"))
    return filter_urls(pages, pages.select("page_id", "url").join(marks, "page_id"))
