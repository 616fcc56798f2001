"""Language ID by nearest centroid: normalised TF-IDF vectors of hashed byte n-grams against a few clustered centroids a language, by
cosine. A text whose best cosine lies below its language's radius is rejected."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, free_name, in_arrow, table

DIMS, CENTROIDS, STEPS = 4096, 4, 12
#: Labelled documents a language that the fit may take (about; a fixed hash of doc_id chooses them, whole texts are read).
SAMPLE = 400
#: A text is rejected below this share of its language's 1 % quantile of training cosines.
RADIUS = 0.25
UNKNOWN = "und"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string")) % n


def features(data: np.ndarray, offs: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """rows x dims term frequencies (log-damped) of 1- to 3-byte n-grams inside the rows; all but letters counts as space."""
    rows, n = len(offs) - 1, len(data)
    out = np.zeros(rows * dims, np.float32)
    if n:
        b = _FOLD[data].astype(np.uint32)
        row = np.repeat(np.arange(rows, dtype=np.int64) * dims, np.diff(offs))
        out += np.bincount(row + b, minlength=rows * dims)
        g = b
        for k in (1, 2):
            g = (g[:-1] << np.uint32(8)) | b[k:]
            same = row[:-k] == row[k:]
            h = ((g * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(dims - 256) + np.uint32(256)
            out += np.bincount((row[:-k] + h)[same], minlength=rows * dims)
    return np.log1p(out, out=out).reshape(rows, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, dims: int = DIMS) -> dict:
    """Model from docs(doc_id, text, lang), all of them labelled: idf, centroids, their languages and radii.

    At most about `sample` documents a language are read by the fit; their vectors, of fixed size, reach the driver."""
    docs = docs.where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    n = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return {"langs": [], "idf": np.ones(dims, np.float32), "centroids": np.zeros((0, dims), np.float32), "radius": np.zeros(0)}
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1_000_000, sample * 1_000_000 // v + 1))])
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share[F.col("lang")])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            x = features(data, offs, dims)
            yield pa.record_batch({"lang": batch.column("lang"), "doc_id": batch.column("doc_id").cast(pa.int64()), "x": pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())})

    got = sorted((r.lang, r.doc_id, bytes(r.x)) for r in chosen.select("doc_id", "lang", "text").mapInArrow(vectors, "lang string, doc_id long, x binary").collect())
    langs = np.array([g[0] for g in got])
    x = np.frombuffer(b"".join(g[2] for g in got), np.float16).reshape(-1, dims).astype(np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = _unit(x * idf)
    cents, names, radius = [], [], []
    for lang in sorted(n):
        own = x[langs == lang]
        if not len(own):
            continue
        c = own[[0]]
        while len(c) < min(centroids, len(own)):  # the text farthest from the centroids so far
            c = np.vstack([c, own[(own @ c.T).max(1).argmin()]])
        for _ in range(STEPS):
            at = (own @ c.T).argmax(1)
            c = _unit(np.stack([own[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))]))
        cents.append(c)
        names += [lang] * len(c)
        radius += [RADIUS * float(np.quantile((own @ c.T).max(1), 0.01))] * len(c)
    return {"langs": names, "idf": idf, "centroids": np.vstack(cents).astype(np.float32), "radius": np.array(radius)}


def judge(model: dict, batch: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, letters: str = "letters_") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, cosine, rejected) of each row; the last centroid number plus one stands for no language."""
    ok = batch.column(letters).to_numpy(zero_copy_only=False).astype(bool)
    none = len(model["langs"])
    if not none:
        return np.full(len(ok), none), np.zeros(len(ok)), np.ones(len(ok), bool)
    cos = _unit(features(data, offs, len(model["idf"])) * model["idf"]) @ model["centroids"].T
    best = cos.argmax(1)
    top = cos[np.arange(len(best)), best].clip(0, 1).astype(float)
    return np.where(ok, best, none), np.where(ok, top, 0.0), ~ok | (top < model["radius"][best])


def _letters(name: str = "letters_") -> Column:
    return F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias(name)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid), rejected of every row.

    `und`, 0 and rejected for a null text or one without a letter, and for every text when the fit saw no language. Rows that repeat
    are judged each; other columns are not read; an empty table gives no row. The model has a fixed size (dims x centroids)."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        langs = np.array([*m["langs"], UNKNOWN], dtype=object)
        for batch, data, offs in blocks(batches, limit=1 << 19):
            best, top, bad = judge(m, batch, data, offs)
            yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "lang_pred": pa.array(langs[best].tolist(), pa.string()), "score": pa.array(top), "rejected": pa.array(bad)})

    return in_arrow(docs.select("doc_id", "text", _letters()), run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all columns whatever their names, that the model does not reject: no null texts and none without a letter."""
    cast, name = docs.sparkSession.sparkContext.broadcast(model), free_name(docs, "letters_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, limit=1 << 19):
            yield batch.filter(pa.array(~judge(cast.value, batch, data, offs, name)[2])).drop_columns([name])

    return in_arrow(docs.select("*", _letters(name)), run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    out = predict(docs, fit(docs.where(~F.coalesce(held, F.lit(False)))))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def python_crc_mod(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n
