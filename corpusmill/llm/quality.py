"""Quality classifier: a byte-level convolutional network in numpy. Learned filters run over every byte of a document in overlapping
chunks; a chunk keeps each filter's maximum, and the maxima's maximum and mean give one probability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table, utf8
from .langid import crc_mod

FILTERS, SPAN, CHUNK = 12, 4, 256
#: Labelled documents the fit may take (about; a fixed hash of doc_id chooses them, whole texts are read).
SAMPLE = 1200
EPOCHS, BATCH, RATE, DECAY, SEED = 14, 32, 0.02, 1e-4, 7


def grid(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks x (CHUNK + SPAN - 1) byte codes, first chunk of each row). A chunk repeats the next one's first bytes; code 256 is padding."""
    n = np.diff(offs)
    per = -(-n // CHUNK)
    first = np.concatenate(([0], np.cumsum(per)))
    flat = np.full((int(first[-1]) + 1) * CHUNK, 256, np.int16)
    if len(data):
        flat[np.arange(len(data)) + np.repeat(first[:-1] * CHUNK - offs[:-1], n)] = data
    chunks = flat.reshape(-1, CHUNK)
    tail = chunks[1:, : SPAN - 1].copy()
    if len(tail):
        ends = first[1:][per > 0] - 1  # a row's last chunk is followed by padding
        tail[ends] = 256
    return np.hstack([chunks[:-1], tail]), first


def convolve(codes: np.ndarray, taps: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """chunks x CHUNK x filters."""
    out = taps[0][codes[:, :CHUNK]]
    for w in range(1, SPAN):
        out += taps[w][codes[:, w : CHUNK + w]]
    return out + bias


def pooled(maxima: np.ndarray, first: np.ndarray) -> np.ndarray:
    """rows x 2 filters: maximum and mean over the chunks; 0 for a row without any."""
    rows, f = len(first) - 1, maxima.shape[1]
    out = np.zeros((rows, 2 * f), np.float32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some, :f] = np.maximum.reduceat(maxima, first[some])
        out[some, f:] = np.add.reduceat(maxima, first[some]) / np.diff(first)[some][:, None]
    return out


def fit_arrays(texts: list[str], labels: np.ndarray) -> dict:
    rng = np.random.default_rng(SEED)
    f = FILTERS
    p = {"taps": rng.normal(0, 0.3, (SPAN, 257, f)).astype(np.float32), "bias": np.zeros(f, np.float32), "head": rng.normal(0, 0.1, 2 * f).astype(np.float32), "base": np.zeros(1, np.float32)}
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    p["base"][0] = np.log(share / (1 - share))
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            data, offs = utf8(pa.array([texts[i] for i in pick], pa.string()))
            codes, first = grid(data, offs)
            z = convolve(codes, p["taps"], p["bias"])
            at = z.argmax(1)  # chunks x filters
            m = np.maximum(np.take_along_axis(z, at[:, None, :], 1)[:, 0], 0)
            x = pooled(m, first)
            y = labels[pick].astype(np.float32)
            d = (1 / (1 + np.exp(-(x @ p["head"] + p["base"][0]))) - y) / len(pick)
            grad = {"head": x.T @ d + DECAY * p["head"], "base": np.array([d.sum()], np.float32)}
            n, row = np.diff(first), np.repeat(np.arange(len(pick)), np.diff(first))
            g = (d[:, None] * p["head"][f:] / np.maximum(n, 1)[:, None])[row]
            peak = m == x[row, :f]
            ties = np.maximum(np.stack([np.bincount(row, peak[:, j], len(pick)) for j in range(f)], 1), 1)
            g += peak * (d[:, None] * p["head"][:f] / ties)[row]
            g = (g * (m > 0)).astype(np.float32)
            grad["bias"], grad["taps"] = g.sum(0), DECAY * p["taps"]
            j = np.broadcast_to(np.arange(f), at.shape)
            for w in range(SPAN):
                np.add.at(grad["taps"][w], (np.take_along_axis(codes, at + w, 1), j), g)
            step += 1
            for k, v in grad.items():
                a, b = state[k]
                a += 0.1 * (v - a)
                b += 0.001 * (v * v - b)
                p[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Model from docs(doc_id, text) and labels(doc_id, quality). About `sample` labelled documents, whole, reach the driver."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < min(1_000_000, sample * 1_000_000 // max(n, 1) + 1))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").collect()  # bounded by `sample`
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit_arrays([r.text for r in rows], np.array([r.quality for r in rows]))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row; null and empty texts get the score of no evidence. Rows that repeat are scored each; other columns
    are not read; an empty table gives no row. Without any labels the score is about one half."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = cast.value
        for batch, data, offs in blocks(batches, limit=1 << 18):
            codes, first = grid(data, offs)
            m = np.empty((len(codes), p["taps"].shape[2]), np.float32)
            for lo in range(0, len(codes), 64):
                m[lo : lo + 64] = np.maximum(convolve(codes[lo : lo + 64], p["taps"], p["bias"]).max(1), 0)
            x = pooled(m, first)
            s = 1 / (1 + np.exp(-(x @ p["head"] + p["base"][0]).astype(float)))
            yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "score": pa.array(s)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    out = score(docs, fit(docs, labels.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
