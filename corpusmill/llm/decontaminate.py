"""Benchmark decontamination by winnowing: both sides keep the least K-gram hash of every W consecutive K-grams, equal hashes join
them, and hits are extended to whole windows whose words are then compared. K + W - 1 = WINDOW, so no shared window is missed."""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, ASCII_LOWER, blocks, in_arrow, ngrams, runs_of, table, utf8, winnow, words

WINDOW, K = 10, 5
#: Benchmark text in one broadcast block; a larger benchmark is cut into more blocks, used one after another.
BLOCK_TEXT = 8 << 20


def _spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    low = ASCII_LOWER[data[s[0] : e[-1]]].tobytes()
    return b" ".join(low[a - s[0] : b - s[0]] for a, b in zip(s.tolist(), e.tolist(), strict=True))


def index_block(items: list[tuple[str, str]], window: int = WINDOW, k: int = K) -> dict:
    """For each window length n: its fingerprints, and hash -> {words: items}. Items shorter than a window use their own length,
    with every n-gram as its fingerprint."""
    data, offs = utf8(pa.array([t for _, t in items], pa.string()))
    row, s, e, h = words(data, offs, ALNUM, True)
    at = runs_of(row, len(items))
    lengths = defaultdict(list)
    for i in range(len(items)):
        if n := int(at[i + 1] - at[i]):
            lengths[min(n, window)].append(i)
    out = {}
    for n, which in lengths.items():
        chosen = np.concatenate([np.arange(at[i], at[i + 1]) for i in which])
        r, hh = row[chosen], h[chosen]
        first, g = ngrams(r, hh, n)
        full: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
        for p, x in zip(first.tolist(), g.tolist(), strict=True):
            c = chosen[p : p + n]
            full[x][_spans(data, s[c], e[c])].add(items[r[p]][0])
        kk = k if n == window else n
        f, gk = ngrams(r, hh, kk)
        sel = winnow(r[f], gk, n - kk + 1)
        out[n] = {"prints": np.unique(gk[sel]), "windows": np.array(sorted(full), np.uint64), "full": {x: dict(y) for x, y in full.items()}}
    return out


def match(data: np.ndarray, offs: np.ndarray, index: dict, window: int = WINDOW, k: int = K):
    """Word count of each row, and {row: (hit word numbers, items)} for rows with hits."""
    row, s, e, h = words(data, offs, ALNUM, True)
    rows = len(offs) - 1
    at = runs_of(row, rows)
    found: dict[int, tuple[set, set]] = {}
    for n, ix in index.items():
        kk = k if n == window else n
        f, g = ngrams(row, h, kk)
        if not len(f):
            continue
        sel = winnow(row[f], g, n - kk + 1)
        sel = sel[np.isin(g[sel], ix["prints"])]
        if not len(sel):
            continue
        # extend: each window that holds a matching fingerprint
        starts = np.unique((f[sel][:, None] - np.arange(n - kk + 1)[None, :]).ravel())
        starts = starts[(starts >= 0) & (starts + n <= len(row))]
        starts = starts[row[starts] == row[starts + n - 1]]
        acc = h[starts].copy()
        from .common import _Q, mix

        for j in range(1, n):
            acc = acc * _Q + h[starts + j]
        acc = mix(acc)
        for p, x in zip(starts[(ok := np.isin(acc, ix["windows"]))].tolist(), acc[ok].tolist(), strict=True):
            items = ix["full"][x].get(_spans(data, s[p : p + n], e[p : p + n]))
            if items:
                r = int(row[p])
                hit, names = found.setdefault(r, (set(), set()))
                hit.update(range(p - int(at[r]), p - int(at[r]) + n))
                names |= items
    return np.diff(at), found


def index(benchmark: DataFrame, window: int = WINDOW, k: int = K) -> list:
    """Broadcasts of the benchmark's index, cut into blocks of about BLOCK_TEXT bytes of text at most (a longer item is a block of
    its own): a task holds one block at a time, however large the benchmark."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (BLOCK_TEXT // 2)))
    part = lambda b: bench if n == 1 else bench.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b)
    return [spark.sparkContext.broadcast(pickle.dumps(index_block([tuple(r) for r in part(b).collect()], window, k))) for b in range(n)]


def matches(batches: Iterator[pa.RecordBatch], casts: list, window: int, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, dict]]:
    one = pickle.loads(casts[0].value) if len(casts) == 1 else None
    for batch, data, offs in blocks(batches):
        found: dict[int, tuple[set, set]] = {}
        for c in casts:
            n_words, part = match(data, offs, one if one is not None else pickle.loads(c.value), window, k)
            for r, (hit, names) in part.items():
                old = found.setdefault(r, (set(), set()))
                old[0].update(hit)
                old[1].update(names)
        yield batch, n_words, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits (word numbers), items of every row of docs.

    Null or empty texts have no words and no hits; items without words, null items and null ids match nothing; repeated rows are
    judged each; an empty benchmark contaminates nothing; other columns are not read."""
    casts = index(benchmark, window, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n_words, found in matches(batches, casts, window, k):
            both = [found.get(r, (set(), set())) for r in range(batch.num_rows)]
            names = [sorted(x[1]) for x in both]
            n_hit = np.array([len(x[0]) for x in both], np.int64)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n_words": pa.array(n_words.astype(np.int64)),
                    "n_hit": pa.array(n_hit),
                    "n_items": pa.array([len(x) for x in names], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                    "contaminated": pa.array(n_hit > 0),
                    "hits": pa.array([sorted(x[0]) for x in both], pa.list_(pa.int64())),
                    "items": pa.array(names, pa.list_(pa.string())),
                }
            )

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<long>, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows of docs, all columns, without any window of the benchmark."""
    casts = index(benchmark, window, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found in matches(batches, casts, window, k):
            yield batch.filter(pa.array([r not in found for r in range(batch.num_rows)], pa.bool_()))

    return in_arrow(docs, run, docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits", "items")


#: Brute force over all words and windows.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
lens AS (SELECT DISTINCT n FROM b),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
