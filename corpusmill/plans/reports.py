"""Report and record operators as queries over the driver's tables, and the SQL that checks them. Importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, graph, records, reports, retrieval, stats
from .catalog import _ranked, query, t

WORDS = r"[\p{L}\p{N}_]+"
REASON = "CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 3000 THEN 'long' ELSE '' END"

# ---------------------------------------------------------------- reports


@query("SELECT o_custkey, " + ", ".join(f"CASE WHEN count(*) FILTER (WHERE o_orderstatus = '{s}') > 0 THEN 'yes' ELSE '—' END AS {s}" for s in "FOP") + " FROM orders GROUP BY o_custkey")
def presence_grid(spark, sf_dir):
    return reports.presence(t(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _measures(by: str) -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(f"SELECT {head}'{m}' AS dimension, count({m}) AS n, coalesce(round(avg({m}), 4), 0.0) AS mean, coalesce(round(min({m}), 4), 0.0) AS least, coalesce(round(max({m}), 4), 0.0) AS most FROM lineitem{tail}" for m in MEASURES)


@query(_measures("l_returnflag"))
def dimension_report(spark, sf_dir):
    return reports.dimension_report(t(spark, sf_dir, "lineitem"), ["l_returnflag"], MEASURES, 4)


@query(_measures(""))
def judged_summary(spark, sf_dir):
    return reports.dimension_report(t(spark, sf_dir, "lineitem"), [], MEASURES, 4)


@query("SELECT 'lang' AS counter, coalesce(lang, '') AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(source, ''), count(*) FROM documents GROUP BY ALL")
def counters(spark, sf_dir):
    return reports.counters(t(spark, sf_dir, "documents"), ["lang", "source"])


@query(f"""WITH x AS (SELECT source, {REASON} AS reason FROM documents), g AS (SELECT source, list(reason) AS r, count(*) AS candidates FROM x GROUP BY ROLLUP (source)), c AS (SELECT source, r, candidates, unnest(['empty', 'short', 'long']) AS c FROM g)
SELECT source, c AS "check", CAST(len(list_filter(r, lambda y: y = c)) AS BIGINT) AS rejected, candidates, round(len(list_filter(r, lambda y: y = c)) / candidates, 6) AS rate FROM c""")
def reject_rates(spark, sf_dir):
    x = t(spark, sf_dir, "documents").select("source", F.expr(REASON).alias("reason"))
    return reports.reject_rates(x, "source", "reason", ["empty", "short", "long"])


LEVEL = "CASE WHEN l_quantity <= 5 THEN NULL WHEN l_quantity <= 20 THEN 'easy' WHEN l_quantity <= 40 THEN 'medium' ELSE 'hard' END"
GOALS = {"easy": 0.25, "medium": 0.45, "hard": 0.30}
TIERS = {"weak": "l_discount > 0.07", "mid": "l_discount > 0.04", "strong": "l_discount > 0.01"}


@query(f"WITH x AS (SELECT {LEVEL} AS d, l_discount FROM lineitem), k AS (SELECT count(d) AS k, count(*) AS m FROM x)" + " UNION ALL ".join(
    [f" SELECT 'difficulty' AS kind, '{d}' AS name, count(*) FILTER (WHERE d = '{d}') AS n, round(count(*) FILTER (WHERE d = '{d}') / any_value(k), 6) AS share, round(count(*) FILTER (WHERE d = '{d}') / any_value(k) - CAST({g} AS DOUBLE), 6) AS gap FROM x, k" for d, g in GOALS.items()]
    + [f" SELECT 'tier', '{n}', count(*) FILTER (WHERE {p}), round(count(*) FILTER (WHERE {p}) / any_value(m), 6), NULL FROM x, k" for n, p in TIERS.items()]
    + [" SELECT 'dropped', 'all', any_value(m - k), round(any_value(m - k) / any_value(m), 6), NULL FROM x, k"]))
def calibration_report(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select(F.expr(LEVEL).alias("d"), "l_discount")
    return reports.calibration(x, "d", GOALS, TIERS)


@query("SELECT user_id, min_by(event_type, event_id) AS event_type, min_by(props, event_id) AS props, nullif(max(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 0) AS peak, nullif(max(value), 0) AS value FROM events GROUP BY user_id")
def hardware_inventory(spark, sf_dir):
    x = t(spark, sf_dir, "events").withColumn("peak", F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0))
    return reports.hardware(x, "user_id", "event_id", ["event_type", "props"], ["peak", "value"])


@query("SELECT event_type, count(*) AS runs, round(avg(value), 6) AS value, round(avg(CASE WHEN user_id % 3 <> 0 THEN value END), 6) AS first_token, max(user_id) AS user_id FROM events GROUP BY event_type")
def run_summary(spark, sf_dir):
    x = t(spark, sf_dir, "events").withColumn("first_token", F.when(F.col("user_id") % 3 != 0, F.col("value")))
    return reports.run_summary(x, ["event_type"], ["value", "first_token"], ["user_id"])


@query("""WITH x AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents WHERE n_chars IS NOT NULL GROUP BY lang)
SELECT lang, CAST(len(v) AS BIGINT) AS n, v[1] AS least, v[-1] AS most, round(list_avg(v), 1) AS mean, v[len(v) // 2 + 1] AS median, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95 FROM x""")
def length_stats(spark, sf_dir):
    return reports.length_stats(t(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 6) AS perplexity FROM lineitem GROUP BY l_returnflag")
def perplexity(spark, sf_dir):
    return reports.perplexity(t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")


@query("SELECT * FROM (SELECT o_custkey, max(o_totalprice) AS score FROM orders GROUP BY o_custkey ORDER BY score DESC, o_custkey LIMIT 40) WHERE score >= 400000")
def best_papers(spark, sf_dir):
    return reports.best_then_enough(t(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 40, 400000.0)


@query("""SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type) FILTER (WHERE value > 50))), ',') AS passed, CAST(count(*) FILTER (WHERE NOT value > 50) AS BIGINT) AS issues,
 coalesce(array_to_string(list_sort(list(event_type || ':' || props) FILTER (WHERE NOT value > 50)), ','), '') AS notes FROM events GROUP BY user_id""")
def folded_logs(spark, sf_dir):
    x = reports.folded_logs(t(spark, sf_dir, "events"), "user_id", "event_type", F.col("value") > 50, "props")
    notes = F.array_sort(F.transform("issues", lambda s: F.concat(s["event_type"], F.lit(":"), s["props"])))
    return x.select("user_id", F.array_join("passed_checks", ",").alias("passed"), F.size("issues").cast("long").alias("issues"), F.array_join(notes, ",").alias("notes"))


@query("""WITH w AS (SELECT lang, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS BIGINT) AS w FROM documents)
SELECT lang, count(*) AS items, CAST(round_even(100.0 * count(*) / sum(count(*)) OVER (), 0) AS BIGINT) AS percent, CAST(count(DISTINCT source) AS BIGINT) AS "references", CAST(round_even(avg(w), 0) AS BIGINT) AS mean,
 CAST(round_even(quantile_cont(w, 0.5), 0) AS BIGINT) AS median, min(w) AS least, max(w) AS most FROM w GROUP BY lang""")
def composition(spark, sf_dir):
    x = t(spark, sf_dir, "documents").withColumn("refs", F.array_compact(F.array("source")))
    return reports.composition(x, "refs", "lang", F.size(T.space_words(F.coalesce("text", F.lit("")))).cast("long"))


@query("""SELECT l_returnflag, round(avg(l_tax) FILTER (WHERE l_linestatus = 'F'), 6) AS mean_a, round(avg(l_tax) FILTER (WHERE l_linestatus = 'O'), 6) AS mean_b, count(*) FILTER (WHERE l_linestatus = 'F') AS n_a,
 count(*) FILTER (WHERE l_linestatus = 'O') AS n_b, round(avg(l_tax) FILTER (WHERE l_linestatus = 'O') - avg(l_tax) FILTER (WHERE l_linestatus = 'F'), 6) AS delta FROM lineitem GROUP BY l_returnflag""")
def by_setting(spark, sf_dir):
    return reports.by_setting(t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "F", "O", "l_tax")


@query("""SELECT slice, mean, n, row_number() OVER (ORDER BY mean DESC, slice) AS place FROM (SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS slice, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY ROLLUP (event_type))""")
def slice_means(spark, sf_dir):
    return reports.slice_means(t(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH y AS (SELECT l_orderkey AS o_orderkey, max(p_size) AS newest FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT o_orderkey, newest, o_totalprice FROM orders JOIN y USING (o_orderkey)""")
def newest_sources(spark, sf_dir):
    items = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_partkey")).alias("refs"))
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(reports.newest(items, "o_orderkey", "refs", t(spark, sf_dir, "part"), "p_partkey", "p_size"), "o_orderkey").select("o_orderkey", "newest", "o_totalprice")


@query("""WITH x AS (SELECT l_returnflag, l_tax - l_discount AS s FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, round(quantile_cont(abs(s), 0.5), 6) AS median,
 round(quantile_cont(abs(s), 0.95), 6) AS p95, round(max(abs(s)), 6) AS most FROM x GROUP BY l_returnflag""")
def level_offset(spark, sf_dir):
    return reports.level_offset(t(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_tax") - F.col("l_discount"))


@query("""WITH x AS (SELECT l_returnflag, l_quantity - 25 AS a, l_quantity - 25 + (l_linenumber - 3) * 2 AS b FROM lineitem), y AS (SELECT *, abs(a) >= 8 AS p, abs(b) >= 8 AS q, sign(a) <> sign(b) AS s FROM x)
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE p) AS over, count(*) FILTER (WHERE p AND q) AS held, count(*) FILTER (WHERE p <> q) AS verdict_flips, round(avg(CAST(p <> q AS INT)), 6) AS verdict_rate, count(*) FILTER (WHERE s) AS sign_flips,
 round(avg(CAST(s AS INT)), 6) AS sign_rate, count(*) FILTER (WHERE abs(b - a) > 8) AS moved FROM y GROUP BY l_returnflag""")
def verdict_flips(spark, sf_dir):
    a = F.col("l_quantity") - 25
    return reports.verdict_flips(t(spark, sf_dir, "lineitem"), ["l_returnflag"], a, a + (F.col("l_linenumber") - 3) * 2, 8.0)


@query("""SELECT l_orderkey, count(*) AS raters, round(avg(l_quantity), 9) AS l_quantity, round(avg(l_discount), 9) AS l_discount, round(avg(l_tax), 9) AS l_tax,
 round(avg(l_quantity) * CAST(0.4 AS DOUBLE) + avg(l_discount) * CAST(0.35 AS DOUBLE) + avg(l_tax) * CAST(0.25 AS DOUBLE), 9) AS composite FROM lineitem GROUP BY l_orderkey""")
def rater_consensus(spark, sf_dir):
    return reports.consensus(t(spark, sf_dir, "lineitem"), "l_orderkey", {"l_quantity": 0.4, "l_discount": 0.35, "l_tax": 0.25}, 9)


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def order_rank(spark, sf_dir):
    return reports.order_rank(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", "o_orderkey").select("o_orderkey", "o_orderpriority", "place")


@query("""WITH a AS (SELECT n_name, round(avg(c_acctbal), 6) AS mean_a FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), b AS (SELECT n_name, round(avg(s_acctbal), 6) AS mean_b FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT n_name, mean_a, mean_b, row_number() OVER (ORDER BY mean_a DESC, n_name) AS rank_a, row_number() OVER (ORDER BY mean_b DESC, n_name) AS rank_b FROM a JOIN b USING (n_name)) SELECT *, rank_a - rank_b AS rank_delta FROM r""")
def leaderboard(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    side = lambda name, k, v: t(spark, sf_dir, name).join(n, F.col(k) == n.n_nationkey).select("n_name", F.col(v).alias("v"))
    return reports.leaderboard(side("customer", "c_nationkey", "c_acctbal"), side("supplier", "s_nationkey", "s_acctbal"), "n_name", "v")


@query("""WITH x AS (SELECT event_type, user_id % 10 AS stratum, value - 50 AS d FROM events), o AS (SELECT event_type, round(avg(d), 6) AS overall FROM x GROUP BY ALL), s AS (SELECT event_type, stratum, round(avg(d), 6) AS effect FROM x GROUP BY ALL)
SELECT event_type, stratum, overall, effect FROM s JOIN o USING (event_type) WHERE sign(effect) <> sign(overall)""")
def sign_flips(spark, sf_dir):
    x = t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("stratum"), (F.col("value") - 50).alias("d"))
    effect = lambda *by: x.groupBy(*by).agg(F.round(F.avg("d"), 6).alias("effect"))
    return reports.sign_flips(effect("event_type"), effect("event_type", "stratum"), ["event_type"], "stratum", "effect")


@query("SELECT 'part' AS side, p_partkey AS id, p_brand AS brand, NULL AS balance FROM part UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier UNION ALL SELECT 'customer', c_custkey, NULL, c_acctbal FROM customer")
def stacked_rows(spark, sf_dir):
    part = t(spark, sf_dir, "part").select(F.lit("part").alias("side"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    side = lambda name, k, v: t(spark, sf_dir, name).select(F.lit(name).alias("side"), F.col(k).alias("id"), F.col(v).alias("balance"))
    return reports.stacked(part, side("supplier", "s_suppkey", "s_acctbal"), side("customer", "c_custkey", "c_acctbal"))


@query("WITH s AS (SELECT user_id, count(*) AS s FROM events GROUP BY user_id) SELECT CAST(sum(s) AS BIGINT) AS items, count(*) AS clusters, round(avg(s), 3) AS mean_size, max(s) AS max_size, round(sqrt(avg(s)), 3) AS ci_inflation, round(avg(s), 3) AS design_effect FROM s")
def cluster_summary(spark, sf_dir):
    return reports.cluster_summary(t(spark, sf_dir, "events"), "user_id")


@query("""WITH o AS (SELECT o_custkey, o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY ALL)
SELECT a.o_custkey, a.o_orderpriority, a.price AS price_a, b.price AS price_b FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'""")
def paired_judges(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority", "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("price"))
    return reports.paired_judges(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey", "o_orderpriority"], ["price"])


@query("""WITH a AS (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), b AS (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT o_custkey, a, b, round(a / nullif(b, 0), 6) AS ratio FROM a JOIN b USING (o_custkey)""")
def speedups(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return reports.speedup(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", "o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- records


@query(rf"""WITH x AS (SELECT doc_id, lang, source, text FROM documents WHERE trim(coalesce(source, '')) <> '' AND len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) >= 20)
SELECT min(doc_id) AS doc_id FROM x GROUP BY lower(trim(regexp_replace(coalesce(lang, ''), '\s+', ' ', 'g'))), lower(trim(regexp_replace(source, '\s+', ' ', 'g'))), lower(trim(regexp_replace(text, '\s+', ' ', 'g')))""")
def good_anchors(spark, sf_dir):
    return records.good_anchors(t(spark, sf_dir, "documents"), "lang", "source", "text", "doc_id").select("doc_id")


@query(r"""SELECT doc_id, trim(coalesce(text, ''), E' \t\n\r') = '' OR coalesce(lang = 'fr', false) OR regexp_matches(coalesce(text, ''), '(?i)(table of contents|acknowledgements|organization of thesis|chapter 1|chapter 2|abstract \.\s*v)') AS bad FROM documents""")
def low_quality_chunks(spark, sf_dir):
    title = F.when(F.col("lang") == "fr", "Unknown").otherwise(F.col("lang"))
    return t(spark, sf_dir, "documents").select("doc_id", records.low_quality_chunk(F.col("text"), title).alias("bad"))


RULES = {"text": "length(text) > 0", "lang": "lang IN ('en', 'de', 'fr')", "n_chars": "n_chars >= 300"}


@query("SELECT doc_id, CASE " + " ".join(f"WHEN NOT coalesce({rule}, false) THEN '{name}'" for name, rule in RULES.items()) + " ELSE '' END AS error FROM documents")
def schema_errors(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", records.schema_error(RULES).alias("error"))


PROBLEM = "CASE WHEN o_orderkey % 11 = 0 THEN 'This is Not HPN work' WHEN o_orderkey % 7 = 0 THEN ' too short ' ELSE 'Problem of ' || o_orderpriority || ' kind' END"


@query(f"""WITH c AS (SELECT o_orderkey, {PROBLEM} AS problem FROM orders), a AS (SELECT l_orderkey AS o_orderkey, l_partkey % 5 AS p, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 5, l_suppkey) AS l_linenumber FROM lineitem),
g AS (SELECT o_orderkey, p, count(*) AS c, p < 3 AS known, min_by(l_suppkey, l_linenumber) AS s, min(l_linenumber) AS l FROM a GROUP BY o_orderkey, p),
k AS (SELECT o_orderkey, CAST(sum(CASE WHEN known THEN 0 ELSE c END) AS BIGINT) AS n_bogus, CAST(sum(CASE WHEN known THEN c - 1 ELSE 0 END) AS BIGINT) AS n_repeated, count(*) FILTER (WHERE known) AS n,
 string_agg(p || '/' || s, ',' ORDER BY l) FILTER (WHERE known) AS anchors FROM g GROUP BY o_orderkey)
SELECT o_orderkey, CASE WHEN contains(lower(problem), 'not hpn') THEN 'self_reported' WHEN length(trim(problem)) < 15 THEN 'short_problem' WHEN coalesce(n, 0) = 0 THEN 'no_anchors' ELSE '' END AS reason, coalesce(anchors, '') AS anchors,
 coalesce(n_bogus, 0) AS n_bogus, coalesce(n_repeated, 0) AS n_repeated FROM c LEFT JOIN k USING (o_orderkey)""")
def card_checks(spark, sf_dir):
    anchor = F.struct("l_linenumber", F.struct((F.col("l_partkey") % 5).alias("passage_id"), "l_suppkey").alias("a"))
    a = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(anchor)), lambda s: s["a"]).alias("anchors"))
    cards = t(spark, sf_dir, "orders").select("o_orderkey", F.expr(PROBLEM).alias("problem")).join(a, "o_orderkey", "left")
    known = t(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("passage_id"))
    x = records.checked_cards(cards, "o_orderkey", "problem", "anchors", known, "passage_id")
    return x.withColumn("anchors", F.array_join(F.transform("anchors", lambda s: F.concat_ws("/", s["passage_id"], s["l_suppkey"])), ","))


@query("""WITH p AS (SELECT c_nationkey AS paper, c_custkey AS passage, c_name || ' ' || c_mktsegment AS text FROM customer WHERE c_nationkey < 15), l AS (SELECT paper, min_by(passage, passage) AS passage, min_by(text, passage) AS text FROM p GROUP BY paper),
d AS (SELECT o_orderkey, o_orderkey % 25 AS paper, o_custkey AS e, o_orderpriority FROM orders WHERE o_orderkey % 9 <> 0)
SELECT o_orderkey, d.paper, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'other' END AS category, coalesce(p.passage, l.passage) AS passage_id, coalesce(CASE WHEN p.passage IS NOT NULL THEN 'q' || e END, l.text) AS quote, p.passage IS NULL AS backfilled,
 'a,b,c,d,e,f,g' AS keywords FROM d JOIN l USING (paper) LEFT JOIN p ON p.paper = d.paper AND p.passage = d.e""")
def promoted_drafts(spark, sf_dir):
    c = t(spark, sf_dir, "customer").where("c_nationkey < 15")
    passages = c.select(F.col("c_nationkey").cast("long").alias("paper"), F.col("c_custkey").alias("passage"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    evidence = F.array(F.struct(F.col("o_custkey").alias("passage"), F.concat(F.lit(" q"), F.col("o_custkey").cast("string")).alias("quote")))
    words = F.array(*[F.lit(w) for w in ("a", " b", "", "c ", "d", "e", "f", "g", "h")])
    o = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 25).alias("paper"), F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise("why?").alias("question"), F.lit("so").alias("reference_answer"), F.col("o_orderpriority").alias("category"), words.alias("keywords"), evidence.alias("evidence"))
    x = records.promoted(o, "o_orderkey", "paper", "evidence", passages, "passage", "text", ["1-URGENT", "2-HIGH"], "other")
    return x.select("o_orderkey", "paper", "category", F.col("evidence")[0]["passage_id"].alias("passage_id"), F.col("evidence")[0]["quote"].alias("quote"), "backfilled", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT id, CASE WHEN id LIKE '1-%' THEN 'urgent' WHEN id LIKE '2-%' THEN 'high' ELSE 'low' END AS route FROM (SELECT o_orderpriority || ':' || o_orderkey AS id FROM orders) WHERE id LIKE '1-%' OR id LIKE '2-%' OR id LIKE '5-%'")
def routed_ids(spark, sf_dir):
    x = t(spark, sf_dir, "orders").select(F.concat_ws(":", "o_orderpriority", "o_orderkey").alias("id"))
    return records.routed(x, "id", {"1-": "urgent", "2-": "high", "5-": "low"})


SIGNED = r"sha256(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))))"


@query(f"""WITH a AS (SELECT doc_id, {SIGNED} AS s FROM documents), f AS (SELECT doc_id, sha256('42:' || doc_id) AS h FROM a WHERE s NOT IN (SELECT {SIGNED} FROM benchmark) ORDER BY h, doc_id LIMIT 40)
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY h, doc_id) <= 4 THEN 'validation' ELSE 'train' END AS part FROM f""")
def appended_anchors(spark, sf_dir):
    return records.append_exactly(t(spark, sf_dir, "benchmark"), t(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "doc_id", 40, 0.1).select("doc_id", "part")


@query("""SELECT doc_id, 'fixed' AS chosen FROM documents WHERE doc_id IN (3, 5, 8) UNION ALL SELECT doc_id, 'fill' FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM documents WHERE doc_id NOT IN (3, 5, 8))
WHERE r <= CASE lang WHEN 'en' THEN 7 WHEN 'de' THEN 4 ELSE 0 END""")
def study_sample(spark, sf_dir):
    return records.study_sample(t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", [3, 5, 8], {"en": 7, "de": 4}).select("doc_id", "chosen")


@query("""WITH m AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || vec_id), vec_id) AS r FROM embeddings), p AS (SELECT y.label, x.vec_id AS u, y.vec_id AS v, row_number() OVER (PARTITION BY y.label ORDER BY y.r, x.r) AS n FROM m x JOIN m y ON x.label = y.label AND x.r < y.r AND y.r <= 5)
SELECT label, least(u, v) AS a, greatest(u, v) AS b FROM p WHERE n <= 8""")
def cluster_pairs(spark, sf_dir):
    return records.cluster_pairs(t(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id", 8)


SIG, HEAD = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))", "left(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 12)"


@query(f"""WITH h AS (SELECT doc_id, {SIG} AS s, {HEAD} AS p FROM documents WHERE lang = 'en'), r AS (SELECT {SIG} AS s, {HEAD} AS p FROM documents WHERE lang <> 'en' OR lang IS NULL UNION ALL SELECT {SIG}, {HEAD} FROM benchmark)
SELECT doc_id, coalesce(s IN (SELECT coalesce(s, '') FROM r), '' IN (SELECT coalesce(s, '') FROM r)) AS same_text, coalesce(p IN (SELECT p FROM r WHERE p <> ''), false) AS same_prefix FROM h""")
def known_items(spark, sf_dir):
    d, b = t(spark, sf_dir, "documents").select("doc_id", "lang", "text"), t(spark, sf_dir, "benchmark").select("text")
    rest = d.where("lang <> 'en' or lang is null").select("text").unionByName(b)
    return records.known_flags(d.where("lang = 'en'").select("doc_id", "text"), rest, "text", 12).select("doc_id", "same_text", "same_prefix")


@query()
def ranked_sources(spark, sf_dir):
    """Every rank of every question with the origin of what was found there."""
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return _ranked(spark, sf_dir, 10).join(d, "doc_id")


@query()
def question_dedup(spark, sf_dir):
    """Exact duplicates by source and text, then by language and text: the first row of a key stays, unless its other key was taken."""
    d = t(spark, sf_dir, "documents")
    sig = F.sha2(T.signature(F.col("text")), 256)
    keys = {"duplicate_question_response": F.concat_ws("|", "source", sig), "duplicate_question": F.concat_ws("|", "lang", sig)}
    return graph.first_by_keys(d, "doc_id", [-F.col("n_chars")], keys).select("doc_id", "kept", "kept_by", "reason")


@query()
def normalized_papers(spark, sf_dir):
    x = chunking.normalized(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return x.select("doc_id", "paper_id", "title", "authors", "method", "raw_char_count", "abstract_tokens", "total_section_tokens", "source_pdf")


@query()
def retrieval_chunks(spark, sf_dir):
    papers = chunking.parsed(t(spark, sf_dir, "documents"), "doc_id", "text")
    return chunking.section_chunks(papers, "doc_id").select("doc_id", "chunk_no", "n_chunks", "chunk_id", "n_tokens", F.sha2("text", 256).alias("digest"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, q.vec_id AS own, e.vec_id AS item_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))) AS s
 FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) SELECT query_id, round(max(s), 4) AS score, max(round(s, 6)) > 0.35 AS leaks FROM s GROUP BY query_id""")
def cosine_leak(spark, sf_dir):
    """The stated query set against all other rows: the nearest one and whether it is nearer than allowed."""
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = retrieval.cosine_top(e, e.where("id % 100 = 0"), 2).where("item_id <> query_id")
    return near.groupBy("query_id").agg(F.round(F.max("score"), 4).alias("score"), (F.max("score") > 0.35).alias("leaks"))


@query()
def chunk_bundles(spark, sf_dir):
    papers = chunking.parsed(t(spark, sf_dir, "documents"), "doc_id", "text")
    return chunking.bundles(chunking.profile_chunks(papers, "doc_id", "base"), "doc_id")


TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'), lambda x: len(x) > 2 AND NOT list_contains(['" + "','".join(T.TITLE_STOP) + "'], x)))"


@query(f"""WITH p AS (SELECT p_partkey, {TOKENS.format("p_name || ' ' || p_brand")} AS g, {TOKENS.format("p_brand || ' ' || p_type")} AS w FROM part)
SELECT p_partkey, round(CASE WHEN len(g) = 0 OR len(w) = 0 THEN 0.0 ELSE greatest(len(list_intersect(g, w)) / len(list_distinct(list_concat(g, w))), len(list_intersect(g, w)) / len(w) * CAST(0.95 AS DOUBLE)) END, 6) AS score FROM part JOIN p USING (p_partkey)""")
def bibliographic_scores(spark, sf_dir):
    guess, title = F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_brand", "p_type")
    return t(spark, sf_dir, "part").select("p_partkey", F.round(T.bibliographic_score(guess, title), 6).alias("score"))


@query()
def leading_titles(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", T.leading_title(T.strip_banners(F.coalesce("text", F.lit("")))).alias("title"))


@query()
def system_intervals(spark, sf_dir):
    """Mean and cluster bootstrap interval of each system."""
    x = stats.clustered(t(spark, sf_dir, "events"), "event_type", "user_id", "value")
    return x.select(F.col("grp").alias("event_type"), "n", "clusters", F.round("mean", 3).alias("mean"), F.round("ci_lo", 3).alias("ci_lo"), F.round("ci_hi", 3).alias("ci_hi"), F.round((F.col("ci_hi") - F.col("ci_lo")) / 2, 3).alias("half_width"))
