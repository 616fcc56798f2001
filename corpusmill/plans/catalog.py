"""The reference operators as queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T
from ..operators import chunking, dedup, evidence, graph, retrieval, sampling, stats, tables
from ..streaming import progress

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


W = r"[\p{L}\p{N}_]+"


# ---------------------------------------------------------------- text


@query(rf"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{W}')) AS BIGINT) AS words, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS space_words,
 CAST(len(regexp_extract_all(text, '{W}|[^\p{{L}}\p{{N}}_\s]')) AS BIGINT) AS tokens, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS signature,
 left(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 40) AS prefix, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed FROM documents""")
def text_keys(spark, sf_dir):
    c = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", T.word_count(c).cast("long").alias("words"), F.size(T.space_words(c)).cast("long").alias("space_words"), T.token_estimate(c).cast("long").alias("tokens"), F.sha2(T.signature(c), 256).alias("signature"), T.prefix_key(c).alias("prefix"), F.sha2(T.squeeze(c), 256).alias("squeezed"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\S+@\S+\.(com|edu|org|net|io|ai)', '', 'g'), '(University|Institute|Laboratory|Inc\.|Corp\.|Ltd\.) of [\p{L}\p{N}_]+', '', 'g') AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '[\p{L}\p{N}_]+ (University|Institute|College|Laboratory)', '', 'g'), '([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g') AS x FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(x, '[^\x00-\x7F]+', ' ', 'g'), '[{}()\[\]|@,;]', ' ', 'g') AS x FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '[.]{2,}', '.', 'g'), '[-]{2,}', '-', 'g'), '[_]{2,}', '_', 'g') AS x FROM c),
e AS (SELECT doc_id, regexp_replace(regexp_replace(x, 'https?://\S+', '', 'g'), '\.([A-Z])', '. \1', 'g') AS x FROM d),
f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(x, '[.!?]{2,}', '.', 'g'), '\s+', ' ', 'g')) AS x FROM e)
SELECT doc_id, CASE WHEN length(x) > 20 AND NOT (x = upper(x) AND x <> lower(x)) THEN x ELSE '' END AS cleaned FROM f""")
def text_clean(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(rf"""SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '{W}'), lambda x: length(x) >= 3 AND NOT list_contains(['{"','".join(T.STOPWORDS)}'], x)))) AS BIGINT) AS n_content,
 CAST(len(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+'), lambda x: length(x) > 1)) AS BIGINT) AS n_search, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS n_lines,
 CASE WHEN len(regexp_extract_all(text, '{W}|[^\p{{L}}\p{{N}}_\s]')) < 400 THEN 'short' WHEN len(regexp_extract_all(text, '{W}|[^\p{{L}}\p{{N}}_\s]')) < 900 THEN 'medium' WHEN len(regexp_extract_all(text, '{W}|[^\p{{L}}\p{{N}}_\s]')) < 1600 THEN 'long' ELSE 'xlong' END AS bucket FROM documents""")
def text_sets(spark, sf_dir):
    c = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", F.size(T.content_tokens(c)).cast("long").alias("n_content"), F.size(T.search_tokens(c)).cast("long").alias("n_search"), F.size(F.split(T.drop_blank_lines(c), "\n")).cast("long").alias("n_lines"), T.length_bucket(T.token_estimate(c)).alias("bucket"))


@query()
def text_sentences(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.size(T.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"), F.element_at(s, 1).alias("first"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS parses FROM events""")
def json_lenient(spark, sf_dir):
    fenced = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))
    got = J.lenient(F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, fenced).otherwise(F.concat(F.lit("x "), F.col("props"), F.lit(" y"))))
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object(got, "$.k").cast("long").alias("k"), got.isNotNull().alias("parses"))


@query("""WITH x AS (SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'system') AS s, min_by(text, turn) FILTER (WHERE role = 'user') AS q, max_by(text, turn) FILTER (WHERE role = 'assistant') AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(trim(s), '') <> '' AS has_system, sha256(CASE WHEN coalesce(trim(q), '') = '' OR coalesce(trim(r), '') = '' THEN '' ELSE (CASE WHEN coalesce(trim(s), '') = '' THEN '' ELSE '<|im_start|>system' || chr(10) || trim(s) || '<|im_end|>' || chr(10) END) || '<|im_start|>user' || chr(10) || trim(q) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || trim(r) || '<|im_end|>' END) AS chat FROM x""")
def conversation_examples(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    pick = lambda f, role: f(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    x = c.groupBy("conv_id").agg(pick(F.max_by, "system").alias("s"), pick(F.min_by, "user").alias("q"), pick(F.max_by, "assistant").alias("r"))
    return x.select("conv_id", (F.coalesce(F.trim("s"), F.lit("")) != "").alias("has_system"), F.sha2(T.chat(F.lit("qwen"), F.col("s"), F.col("q"), F.col("r")), 256).alias("chat"))


# ---------------------------------------------------------------- chunks


@query(rf"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '{W}|[^\p{{L}}\p{{N}}_\s]') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(greatest(0, len(w) - 256) / 224.0) AS BIGINT) + 1)) AS i FROM d WHERE len(w) > 0)
SELECT doc_id, i AS chunk_no, 'paper_' || CASE WHEN length(CAST(doc_id AS VARCHAR)) >= 4 THEN left(CAST(doc_id AS VARCHAR), 4) ELSE lpad(CAST(doc_id AS VARCHAR), 4, '0') END || '__p' || lpad(CAST(i AS VARCHAR), 3, '0') AS chunk_id, CAST(least(256, len(w) - i * 224) AS BIGINT) AS n_tokens, w[i * 224 + 1] AS first_token FROM c""")
def chunk_windows(spark, sf_dir):
    x = chunking.windows(t(spark, sf_dir, "documents"), "doc_id", T.tokens(F.col("text")), 256, 32)
    return x.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.element_at("tokens", 1).alias("first_token"))


@query()
def chunk_sentences(spark, sf_dir):
    return chunking.sentence_chunks(t(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def parse_sections(spark, sf_dir):
    x = chunking.parsed(t(spark, sf_dir, "documents"), "doc_id", "text")
    return x.select("doc_id", "confidence", "method", F.size("sections").cast("long").alias("n_sections"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT flatten(list(list_append(w, '</s>') ORDER BY doc_id)) AS a FROM w), b AS (SELECT a, unnest(range(0, len(a) // 512)) AS i FROM f)
SELECT i AS block, sha256(array_to_string(a[i * 512 + 1:(i + 1) * 512], ' ')) AS digest FROM b""")
def token_blocks(spark, sf_dir):
    x = t(spark, sf_dir, "documents").select("doc_id", T.space_words(F.col("text")).alias("w"))
    return chunking.token_blocks(x, "doc_id", "w", 512, "</s>").select("block", F.sha2(F.array_join("tokens", " "), 256).alias("digest"))


# ---------------------------------------------------------------- duplicates and graphs


@query("""WITH s AS (SELECT doc_id, lang, n_chars, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS g FROM documents)
SELECT doc_id, first_value(doc_id) OVER w = doc_id AS kept, first_value(doc_id) OVER w AS kept_by FROM s WINDOW w AS (PARTITION BY lang, g ORDER BY n_chars DESC, doc_id)""")
def exact_dedup(spark, sf_dir):
    x = dedup.exact(t(spark, sf_dir, "documents"), "text", ["lang"], [-F.col("n_chars")], "doc_id")
    return x.select("doc_id", "kept", "kept_by")


@query()
def near_dedup(spark, sf_dir):
    return dedup.near(t(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id", "text", ["lang"], "doc_id").select("doc_id", "kept", "kept_by")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 4) AS cosine
 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) > 0.88""")
def cosine_pairs(spark, sf_dir):
    x = dedup.cosine_pairs(t(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.88)
    return x.select("a", "b", F.round("cosine", 4).alias("cosine"))


@query()
def cosine_dedup(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    x = graph.first_come(e, dedup.cosine_pairs(e, "vec_id", "embedding", 0.88), "vec_id", "vec_id")
    return x.select("vec_id", "kept", "kept_by")


@query("""WITH RECURSIVE d AS (SELECT DISTINCT doc_id, item_id FROM documents, benchmark WHERE contains(lower(documents.text), lower(benchmark.text))),
e AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM d x JOIN d y ON x.item_id = y.item_id),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS doc_id, min(b) AS component FROM r GROUP BY a""")
def item_components(spark, sf_dir):
    q = retrieval.quoted(t(spark, sf_dir, "benchmark"), t(spark, sf_dir, "documents"))
    first = q.groupBy("item_id").agg(F.min("doc_id").alias("b"))
    c = graph.connected(q.join(first, "item_id").select(F.col("doc_id").alias("a"), "b"), "a", "b")
    return c.select(F.col("node").alias("doc_id"), "component")


# ---------------------------------------------------------------- retrieval and leakage

_BM25 = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+'), lambda x: length(x) > 1) AS w FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term),
i0 AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df, n), m AS (SELECT 0.25 * avg(idf) AS eps FROM i0), idf AS (SELECT term, CASE WHEN idf < 0 THEN eps ELSE idf END AS idf FROM i0, m),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), q AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+'), lambda x: length(x) > 1)) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (term), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _ranked(spark, sf_dir, k=10):
    return retrieval.bm25(t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


@query(_BM25 + " SELECT item_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10")
def bm25_top(spark, sf_dir):
    return _ranked(spark, sf_dir).select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    _BM25
    + """, g AS (SELECT DISTINCT item_id, doc_id FROM documents, benchmark WHERE contains(lower(documents.text), lower(benchmark.text))),
h AS (SELECT g.item_id, min(CASE WHEN rank <= 10 THEN rank END) AS f FROM g LEFT JOIN r ON g.item_id = r.item_id AND g.doc_id = r.doc_id GROUP BY g.item_id)
SELECT count(*) AS n, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN f <= 4 THEN 1.0 ELSE 0 END), 6) AS recall_4, round(avg(CASE WHEN f <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, CAST(quantile_cont(f, 0.5) AS DOUBLE) AS median_rank FROM h"""
)
def retrieval_recall(spark, sf_dir):
    gold = retrieval.quoted(t(spark, sf_dir, "benchmark"), t(spark, sf_dir, "documents")).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("item_id"))
    return retrieval.recall(_ranked(spark, sf_dir).withColumnRenamed("doc_id", "item_id"), gold)


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, item_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, item_id) AS rank FROM s) SELECT query_id, item_id, round(score, 4) AS score, rank FROM r WHERE rank <= 30""")
def vector_top(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.cosine_top(e, e.where("id % 100 = 0"), 30).select("query_id", "item_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)), bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)),
c AS (SELECT item_id, count(*) AS n_grams, count(dg.g) AS n_found FROM bg LEFT JOIN dg USING (g) GROUP BY item_id)
SELECT b.item_id, coalesce(n_grams, 0) AS n_grams, coalesce(n_found, 0) AS n_found, round(coalesce(n_found / n_grams, 0.0), 6) AS ratio, coalesce(n_found, 0) > 0 AS leaked FROM b LEFT JOIN c USING (item_id)""")
def gram_containment(spark, sf_dir):
    return retrieval.gram_containment(t(spark, sf_dir, "benchmark"), t(spark, sf_dir, "documents"))


@query("SELECT DISTINCT item_id, doc_id FROM documents, benchmark WHERE contains(lower(documents.text), lower(benchmark.text)) AND benchmark.text <> ''")
def quoted_passages(spark, sf_dir):
    return retrieval.quoted(t(spark, sf_dir, "benchmark"), t(spark, sf_dir, "documents"))


@query()
def fused_ranking(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    vec = retrieval.cosine_top(e, e.join(t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "id"), 30)
    return retrieval.fuse([vec, _ranked(spark, sf_dir, 30).withColumnRenamed("doc_id", "item_id")])


# ---------------------------------------------------------------- tables of scores


@query("""SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS most FROM events GROUP BY event_type""")
def value_summary(spark, sf_dir):
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.round(F.max("value"), 6).alias("most"))


@query("""SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) / nullif(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0), 6) AS ratio, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS n_f, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS n_o FROM lineitem GROUP BY l_returnflag""")
def pivot_ratio(spark, sf_dir):
    p = t(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    return p.select("l_returnflag", F.round(F.col("F_q") / F.nullif("O_q", F.lit(0.0)), 6).alias("ratio"), F.coalesce("F_n", F.lit(0)).cast("long").alias("n_f"), F.coalesce("O_n", F.lit(0)).cast("long").alias("n_o"))


@query("""SELECT metric, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT 'quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY metric""")
def melted_means(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_quantity AS quantity", "l_discount AS discount", "l_tax AS tax")
    return x.unpivot("l_orderkey", ["quantity", "discount", "tax"], "metric", "v").groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) AS p FROM orders GROUP BY ALL), x AS (SELECT a.o_custkey, c_mktsegment, a.p AS a, b.p AS b FROM o a JOIN o b USING (o_custkey) JOIN customer ON c_custkey = a.o_custkey WHERE a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '5-LOW')
SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(b > a AS INT)) AS BIGINT) AS wins, CAST(sum(CAST(b = a AS INT)) AS BIGINT) AS ties, CAST(sum(CAST(b < a AS INT)) AS BIGINT) AS losses, round(avg(b - a), 3) AS delta FROM x GROUP BY c_mktsegment""")
def head_to_head(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("p"))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    a = o.where("o_orderpriority = '1-URGENT'").join(c, "o_custkey")
    x = tables.wins(a, o.where("o_orderpriority = '5-LOW'"), "o_custkey", "p", ["c_mktsegment"])
    return x.withColumn("delta", F.round("delta", 3))


@query("""SELECT slice, count(*) AS n, round(avg(abs(b - a)), 6) AS mad, round(avg(b - a), 6) AS bias, round(avg(CASE WHEN abs(b - a) <= 0.02 THEN 1.0 ELSE 0 END), 6) AS within, round(avg(CASE WHEN abs(b - a) > 0.05 THEN 1.0 ELSE 0 END), 6) AS over, round(max(abs(b - a)), 6) AS worst
 FROM (SELECT 'all' AS slice, l_discount AS a, l_tax AS b FROM lineitem UNION ALL SELECT 'returned', l_discount, l_tax FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'large', l_discount, l_tax FROM lineitem WHERE l_quantity > 40) GROUP BY slice""")
def deviation_slices(spark, sf_dir):
    x = tables.deviations(t(spark, sf_dir, "lineitem"), "l_discount", "l_tax", {"all": "true", "returned": "l_returnflag = 'R'", "large": "l_quantity > 40"}, 0.02, 0.05)
    return x.select("slice", "n", "mad", "bias", "within", "over", "worst")


@query("""WITH s AS (SELECT n_name, p_brand, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)
SELECT n_name, p_brand, round(revenue, 2) AS revenue FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY round(revenue, 2) DESC, p_brand) AS r FROM s) WHERE r = 1""")
def best_brand(spark, sf_dir):
    li, p, s, n = (t(spark, sf_dir, x) for x in ("lineitem", "part", "supplier", "nation"))
    x = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    x = x.groupBy("n_name", "p_brand").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return tables.best_per_group(x, ["n_name"], "revenue", "p_brand").select("n_name", "p_brand", "revenue")


@query("""SELECT p_partkey, p_brand, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS DOUBLE) AS rank FROM part""")
def average_rank(spark, sf_dir):
    x = tables.average_rank(t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size", "rank")
    return x.select("p_partkey", "p_brand", F.col("rank").cast("double").alias("rank"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS a FROM d), g AS (SELECT user_id, day, a - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM f WHERE v > 100)
SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM g GROUP BY user_id, g""")
def busy_runs(spark, sf_dir):
    d = t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return tables.islands(d.withColumn("hot", F.col("v") > 100), ["user_id"], "day", "hot").select("user_id", "first", "last", "n")


@query("""WITH g AS (SELECT * FROM (VALUES (0.01), (0.03), (0.05), (0.07)) a(x), (VALUES (10.0), (20.0), (30.0), (40.0)) b(y)) SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(sum(CAST(abs(l_discount) >= x AND abs(l_quantity) >= y AS INT)) AS BIGINT) AS n FROM lineitem, g WHERE l_returnflag <> 'A' GROUP BY x, y""")
def threshold_grid(spark, sf_dir):
    return tables.threshold_grid(t(spark, sf_dir, "lineitem"), "l_discount", "l_quantity", "l_returnflag <> 'A'", [0.01, 0.03, 0.05, 0.07], [10.0, 20.0, 30.0, 40.0])


@query("""WITH m AS (SELECT count(DISTINCT event_type) AS m FROM events) SELECT user_id FROM events, m GROUP BY user_id, m HAVING count(DISTINCT event_type) = m""")
def answered_by_all(spark, sf_dir):
    return tables.answered_by_all(t(spark, sf_dir, "events"), "user_id", "event_type")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def without_excluded(spark, sf_dir):
    bad = t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(bad, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


# ---------------------------------------------------------------- sampling


@query("""WITH c AS (SELECT lang, count(*) AS n, count(*) * 180.0 / sum(count(*)) OVER () AS raw FROM documents GROUP BY lang), f AS (SELECT lang, CAST(floor(raw) AS BIGINT) AS fl, row_number() OVER (ORDER BY raw - floor(raw) DESC, lang) AS r, 180 - sum(CAST(floor(raw) AS BIGINT)) OVER () AS rest FROM c),
a AS (SELECT lang, fl + CASE WHEN r <= rest THEN 1 ELSE 0 END AS take FROM f), v AS (SELECT lang, take, take * 60.0 / 180 AS raw FROM a), g AS (SELECT lang, take, CAST(floor(raw) AS BIGINT) AS fl, row_number() OVER (ORDER BY raw - floor(raw) DESC, lang) AS r, 60 - sum(CAST(floor(raw) AS BIGINT)) OVER () AS rest FROM v),
p AS (SELECT lang, take, fl + CASE WHEN r <= rest THEN 1 ELSE 0 END AS dev FROM g), k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, CASE WHEN r <= dev THEN 'dev' WHEN r <= take THEN 'test' ELSE 'rest' END AS part FROM k JOIN p USING (lang)""")
def stratified_split(spark, sf_dir):
    return sampling.stratified(t(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 60, 120, 7).select("doc_id", "part")


@query("""WITH RECURSIVE g AS (SELECT user_id AS grp, count(*) AS size, sha256('3:' || user_id) AS h FROM events GROUP BY user_id), o AS (SELECT *, row_number() OVER (ORDER BY h) AS i FROM g), n AS (SELECT CAST(floor(sum(size) * 0.2) AS BIGINT) AS target FROM g),
f AS (SELECT i, grp, CASE WHEN size <= target THEN size ELSE 0 END AS got, size <= target AS taken FROM o, n WHERE i = 1 UNION ALL SELECT o.i, o.grp, CASE WHEN got + size <= target THEN got + size ELSE got END, got + size <= target FROM f JOIN o ON o.i = f.i + 1, n)
SELECT grp AS user_id FROM f WHERE taken""")
def group_selection(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    g = sampling.groups_of(e, F.col("user_id"), 3)
    return sampling.select_groups(g, int(e.count() * 0.2)).select(F.col("grp").alias("user_id"))


@query("SELECT doc_id, sha256('11:' || doc_id) AS place FROM documents")
def shuffled(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", sampling.order_key(11, F.col("doc_id")).alias("place"))


# ---------------------------------------------------------------- statistics


@query()
def paired_contrasts(spark, sf_dir):
    e = t(spark, sf_dir, "events").selectExpr("'all' AS model", "user_id AS question_id", "event_type AS variant", "value AS score")
    kinds = [r[0] for r in e.select("variant").distinct().orderBy("variant").collect()]
    x = stats.paired(e, [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :]])
    return stats.practical(stats.benjamini_hochberg(x, "p", ["contrast"])).withColumn("p", F.round("p", 6)).withColumn("p_bh", F.round("p_bh", 6))


@query("""WITH t AS (SELECT event_type, CAST(user_id AS BIGINT) AS user_id, avg(value) / 200 AS p FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, user_id) AS i, count(*) OVER (PARTITION BY event_type) AS m FROM t)
SELECT event_type, user_id, round(least(1.0, min(p * m / i) OVER (PARTITION BY event_type ORDER BY i DESC)), 6) AS p_bh FROM k""")
def false_discovery(spark, sf_dir):
    x = t(spark, sf_dir, "events").groupBy("event_type", "user_id").agg((F.avg("value") / 200).alias("p"))
    return stats.benjamini_hochberg(x, "p", ["user_id"], ["event_type"]).select("event_type", "user_id", F.round("p_bh", 6).alias("p_bh"))


@query("""WITH x AS (SELECT quality AS a, toxic AS b FROM labels), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x)
SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(avg(abs(a - b)), 6) AS mae,
 round(1 - sum((a - b) * (a - b)) / (sum(a * a) + sum(b * b) - 2.0 * sum(a) * sum(b) / count(*)), 6) AS kappa, round(avg(CASE WHEN abs(a - b) <= 0.5 THEN 1.0 ELSE 0 END), 6) AS within_half, round(avg(CASE WHEN abs(a - b) <= 1 THEN 1.0 ELSE 0 END), 6) AS within_one FROM r""")
def rater_agreement(spark, sf_dir):
    return stats.agreement(t(spark, sf_dir, "labels"), "quality", "toxic")


@query("""WITH x AS (SELECT doc_id, quality AS a, toxic AS b FROM labels), p AS (SELECT sum(sign(x.a - y.a) * sign(x.b - y.b)) AS s, sum(CAST(x.a <> y.a AS INT)) AS na, sum(CAST(x.b <> y.b AS INT)) AS nb FROM x JOIN x y ON x.doc_id < y.doc_id) SELECT round(s / sqrt(CAST(na AS DOUBLE) * nb), 6) AS tau_b FROM p""")
def kendall_tau(spark, sf_dir):
    return stats.kendall(t(spark, sf_dir, "labels"), "quality", "toxic")


@query("""WITH u AS (SELECT user_id, value AS v, count(*) OVER (PARTITION BY user_id) AS m FROM events), w AS (SELECT * FROM u WHERE m > 1), n AS (SELECT count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM w), d AS (SELECT sum(x) AS d FROM (SELECT (2 * count(*) * sum(v * v) - 2 * sum(v) * sum(v)) / (count(*) - 1) AS x FROM w GROUP BY user_id))
SELECT round(1 - (d / n) / ((2 * n * q - 2 * s * s) / (n * (n - 1))), 6) AS alpha FROM d, n""")
def krippendorff_alpha(spark, sf_dir):
    return stats.krippendorff(t(spark, sf_dir, "events"), "user_id", "value")


@query("""SELECT event_type, count(*) AS n, round(regr_slope(value, x), 6) AS slope, round(regr_intercept(value, x), 4) AS intercept FROM (SELECT event_type, value, CAST(day(ts) AS DOUBLE) AS x FROM events) GROUP BY event_type""")
def score_trend(spark, sf_dir):
    x = t(spark, sf_dir, "events").select("event_type", "value", F.dayofmonth("ts").cast("double").alias("x"))
    return stats.trend(x, ["event_type"], "x", "value").select("event_type", "n", "slope", F.round("intercept", 4).alias("intercept"))


@query()
def cluster_inference(spark, sf_dir):
    return stats.clustered(t(spark, sf_dir, "events").withColumn("score", F.col("value") - 50), "event_type", "user_id", "score", 1.0)


# ---------------------------------------------------------------- progress (extensions)


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, round(max_by(value, event_id), 6) AS value FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    x = progress.latest(t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")
    return x.withColumn("value", F.round("value", 6))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, round(avg(value), 6) AS mean, round(max(value), 6) AS most, count(*) AS n FROM events GROUP BY ALL")
def telemetry(spark, sf_dir):
    x = progress.telemetry(t(spark, sf_dir, "events"), "ts", "event_type", "value", "1 hour")
    return x.withColumn("mean", F.round("mean", 6)).withColumn("most", F.round("most", 6))


# ---------------------------------------------------------------- evidence and selection


@query("""WITH w AS (SELECT lang, list_filter(regexp_extract_all(lower(text), '[a-z0-9]{2,}'), lambda x: NOT list_contains(['""" + "','".join(T.STOPWORDS) + """'], x)) AS w FROM documents),
g AS (SELECT lang, unnest(list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM w), tf AS (SELECT lang, term, count(*) AS tf FROM g GROUP BY ALL),
n AS (SELECT count(DISTINCT lang) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM tf GROUP BY term), x AS (SELECT lang, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN d USING (term), n WHERE df <= 0.85 * n),
s AS (SELECT lang, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY lang)), 6) AS weight FROM x) SELECT lang, term, round(weight, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS r FROM s) WHERE r <= 5""")
def top_terms(spark, sf_dir):
    return evidence.top_terms(t(spark, sf_dir, "documents"), "lang", "text", 5).select("lang", "term", F.round("weight", 4).alias("weight"))


@query("""SELECT doc_id, CAST(contains(lower(text), 'tion') AS BIGINT) + CAST(contains(lower(text), 'ment') AS BIGINT) + CAST(contains(lower(text), '|') AS BIGINT) AS score FROM documents""")
def keyword_score(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", evidence.keyword_score(F.col("text"), ["tion", "ment", "|"]).cast("long").alias("score"))


@query("""WITH p AS (SELECT item_id, item_id % 50 AS doc_id, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE text END AS quote FROM benchmark UNION ALL SELECT doc_id + 1000000, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE doc_id END, left(text, 40) FROM documents)
SELECT item_id, CASE WHEN trim(quote) = '' THEN 'empty_quote' WHEN d.doc_id IS NULL THEN 'unknown_passage' WHEN NOT contains(lower(d.text), lower(quote)) THEN 'not_in_passage' ELSE '' END AS failure FROM p LEFT JOIN documents d ON d.doc_id = p.doc_id""")
def quote_checks(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    own = t(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 50).alias("passage_id"), F.when(F.col("item_id") % 7 == 0, " ").otherwise(F.col("text")).alias("quote"))
    more = d.select((F.col("doc_id") + 1000000).alias("item_id"), F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("doc_id")).alias("passage_id"), F.substring("text", 1, 40).alias("quote"))
    return evidence.quote_checks(own.unionByName(more), d.select(F.col("doc_id").alias("passage_id"), "text")).select("item_id", "failure")


@query()
def fuzzy_titles(spark, sf_dir):
    return evidence.fuzzy_others(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title")))
