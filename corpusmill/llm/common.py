"""Vectorised text kernels and small Spark helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once; bounds the temporaries of the numpy kernels (about 40 bytes for each byte).
BLOCK_BYTES = 1 << 19
#: Bytes in one Arrow batch on its way to Python.
BATCH_BYTES = 4 << 20
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the checkpoint folder all executors see; a local master may do without that setting, a cluster may not."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Folders of the stored tables of the innermost scratch.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
_SPENT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write df as compressed Parquet in the shared folder and read it back: cuts lineage and keeps it compact. Nothing reads the
    write's shuffle files again, so they go with its end; the table goes with the scratch it is made in, or by discard."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    if (own := _scratch.get()) is not None:
        own.append(path)
    before = spark.conf.get(_SPENT, None)
    spark.conf.set(_SPENT, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_SPENT) if before is None else spark.conf.set(_SPENT, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_folder"] = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What stored() writes inside is deleted at the end, but for the tables passed to the function this gives: those belong to the scratch
    around this one, if any. A frame that is used after the end may read inputs and such tables only."""
    outer, own = _scratch.get(), []
    token = _scratch.set(own)

    def keep(table: DataFrame) -> DataFrame:
        own.remove(table.__dict__["_folder"])
        if outer is not None:
            outer.append(table.__dict__["_folder"])
        return table

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for folder in own:
            _delete(spark, folder)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that stored() gave and that no frame reads any more; any other frame is left alone."""
    for t in tables:
        if t is not None and (folder := t.__dict__.pop("_folder", None)):
            _delete(t.sparkSession, folder)
            if folder in (own := _scratch.get() or []):
                own.remove(folder)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as it takes to differ from every column of df."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ Arrow blocks


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `limit` bytes of text each: (rows, UTF-8 bytes, row offsets). Null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = utf8(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            j = min(j, batch.num_rows)
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, with batches of at most BATCH_BYTES (or one row), so that long texts do not pile up in a task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column; null is empty."""
    return utf8(col.cast(pa.large_binary()), b"", pa.large_binary())


def utf8(col: pa.Array, null: str | bytes = "", as_: pa.DataType = pa.large_string()) -> tuple[np.ndarray, np.ndarray]:
    col = pc.fill_null(col, null).cast(as_)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


# ------------------------------------------------------------------ hashing


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_SPAN = BLOCK_BYTES + (1 << 16)
_cache: dict = {}
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased: digits, letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start byte, end byte, 64-bit hash) of each word; bytes after lower-casing decide. All separators are ASCII, so bytes serve for characters."""
    low = ASCII_LOWER[data] if lower else data
    n = len(low)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    w = is_word[low]
    st, en = w.copy(), w.copy()
    st[1:] &= ~w[:-1]
    en[:-1] &= ~w[1:]
    full = offs[1:] > offs[:-1]
    first, last = offs[:-1][full], offs[1:][full] - 1
    st[first], en[last] = w[first], w[last]
    s, e = np.flatnonzero(st), np.flatnonzero(en) + 1
    return np.searchsorted(offs, s, "right") - 1, s, e, hash_spans(low, s, e)


def hash_spans(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    if "p" not in _cache:
        _cache["p"] = _powers(_SPAN)
    up, down = _cache["p"]
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = int(np.searchsorted(e, s[i] + _SPAN, "right"))
        if j <= i:  # one word longer than a span
            out[i] = int.from_bytes(hashlib.blake2b(low[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        lo = s[i]
        part = low[lo : e[j - 1]]
        c = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=c[1:])
        out[i:j] = (c[e[i:j] - lo] - c[s[i:j] - lo]) * down[s[i:j] - lo]
        i = j
    return mix(out)


def ngrams(row: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of k words inside one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g = g * _Q + h[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return at, mix(g[at])


def winnow(row: np.ndarray, g: np.ndarray, w: int) -> np.ndarray:
    """Indices into g kept by winnowing: the rightmost least hash of every w consecutive grams of one row."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if w == 1:
        return np.arange(len(g))
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        x = g[j : j + n]
        less = x <= best
        best[less] = x[less]
        at[less] = np.flatnonzero(less) + j
    ok = row[:n] == row[w - 1 :]
    return np.unique(at[ok])


def runs_of(row: np.ndarray, rows: int) -> np.ndarray:
    """Offsets of each row's items when `row` is sorted."""
    return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))) if rows else np.zeros(1, np.int64)


# ------------------------------------------------------------------ connected components


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for the nodes of the edges, by alternating large-star and small-star steps.

    The edges never leave the executors; every round is written to the shared folder, so a lost executor costs one round at most and
    a plan never reads the one before. Star steps keep components and only move links towards smaller nodes; it ends when the links are
    stars, no node being in the middle of one and at the end of another or at the ends of two, and raises an error if that takes more
    than `rounds`."""
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    for _ in range(rounds):
        both = e.select(F.expr("inline(array(struct(u, v), struct(v as u, u as v)))"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.expr("inline(array(struct(u, m as v), struct(v as u, m as v)))"))
        last, e = e, stored(small.where("u <> v").distinct())
        discard(last)
        ends = e.select(F.expr("inline(array(struct(u as x, 1 as end, 0 as middle), struct(v as x, 0 as end, 1 as middle)))"))
        if ends.groupBy("x").agg(F.sum("end").alias("n"), F.max("middle").alias("m")).where("n > 1 or n = 1 and m = 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components: links still change after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# ------------------------------------------------------------------ joins with a checked small side

#: Ids that a broadcast may hold: a few tens of MB on each executor. More of them go by shuffle.
BROADCAST_IDS = 1_000_000


def keep_ids(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi", n: int | None = None) -> DataFrame:
    """Semi or anti join on one narrow key; broadcast only where the ids were counted and are few."""
    n = ids.count() if n is None else n
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, on, how)
