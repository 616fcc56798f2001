"""Packing: concatenate and cut. Token ids are made once and stored; two passes of prefix sums over partition totals give each
document its global offset; fixed windows then cut the stream, and a document that crosses a window gives a piece on each side."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, hash_spans, in_arrow, stored, table
from .pieces import byte_level_cuts, plain_rows, runs

TOKENIZER = "byte_bpe_50k.json"
EOS = 1
LENGTH = 2048
#: Distinct pieces whose ids a task remembers; beyond it the memory starts anew.
CACHE = 400_000
#: Bytes of new pieces that the tokenizer gets as one text.
TOGETHER = 16_384


def tokenizer(path: str):
    """Of one thread: a task has one core, and each thread would keep memory of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of texts. Texts are cut into pieces whose ids do not depend on their surroundings; the tokenizer sees each distinct piece
    once, and texts whose pieces cannot be told by bytes as a whole.

    Ids of all pieces lie in one buffer. New pieces that are a space and what follows it up to the next one are written one after the
    other and encoded together: a token that begins with the space begins a piece."""

    def __init__(self, path: str, cache: int = CACHE):
        self.tok, self.most = tokenizer(path), cache
        vocab = self.tok.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # the space in byte-level vocabularies
        self._forget()

    def _forget(self) -> None:
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for lo in range(0, len(texts), 2_000) for e in self.tok.encode_batch_fast(texts[lo : lo + 2_000], add_special_tokens=False)]

    def _together(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many ids each has) of pieces that all begin with a space and hold no other."""
        n = e - s
        end = np.cumsum(n)
        raw = data[np.repeat(s - (end - n), n) + np.arange(end[-1])].tobytes()
        edges = np.unique(np.concatenate(([0], np.searchsorted(end, np.arange(TOGETHER, end[-1], TOGETHER)), [len(s)])))
        at = np.concatenate(([0], end))
        got = self._encode([raw[at[i] : at[j]].decode() for i, j in zip(edges[:-1], edges[1:], strict=True)])
        sizes = []
        for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            begin = np.flatnonzero(self.begins[got[k]])
            if len(begin) != j - i or begin[0]:  # a vocabulary with another rule
                own = self._encode([raw[at[x] : at[x + 1]].decode() for x in range(i, j)])
                got[k] = np.concatenate(own)
                sizes.append(np.array([len(x) for x in own]))
            else:
                sizes.append(np.diff(np.append(begin, len(got[k]))))
        return np.concatenate(got), np.concatenate(sizes)

    def _learn(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, keys: np.ndarray) -> None:
        """Add the pieces data[s:e] with ascending, unknown keys."""
        space = np.concatenate(([0], np.cumsum((data == 32) | (data == 10))))
        alone = (data[s] == 32) & (space[e] - space[s] == 1) & (e - s > 1)
        order = np.concatenate((np.flatnonzero(alone), np.flatnonzero(~alone)))
        ids, sizes = [], []
        if alone.any():
            i, n = self._together(data, s[alone], e[alone])
            ids.append(i)
            sizes.append(n)
        if not alone.all():
            raw = data.tobytes()
            other = self._encode([raw[a:b].decode() for a, b in zip(s[~alone].tolist(), e[~alone].tolist(), strict=True)])
            ids += other
            sizes.append(np.array([len(x) for x in other]))
        size = np.concatenate(sizes)
        number = np.empty(len(s), np.int64)
        number[order] = len(self.size) + np.arange(len(s))
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, *ids))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.number = np.insert(self.keys, at, keys), np.insert(self.number, at, number)

    def _pieces(self, data: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Number of the piece at each place s."""
        if len(self.keys) > self.most:
            self._forget()
        e = np.append(s[1:], len(data))
        uniq, at, inverse = np.unique(hash_spans(data, s, e), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, uniq)
        new = (place >= len(self.keys)) if not len(self.keys) else self.keys[place.clip(0, len(self.keys) - 1)] != uniq
        if new.any():
            self._learn(data, s[at[new]], e[at[new]], uniq[new])
            place = np.searchsorted(self.keys, uniq)
        return self.number[place][inverse]

    def rows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, how many each row has)."""
        out, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for a, b, plain in runs(plain_rows(data, offs)):
            part, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            if not len(part):
                counts.append(np.zeros(b - a, np.int64))
            elif not plain:
                raw = part.tobytes()
                got = self._encode([raw[i:j].decode() for i, j in zip(at[:-1], at[1:], strict=True)])
                out += got
                counts.append(np.array([len(x) for x in got]))
            else:
                s = byte_level_cuts(part, at)
                number = self._pieces(part, s)
                n = self.size[number]
                end = np.cumsum(n)
                out.append(self.ids[np.repeat(self.first[number] - (end - n), n) + np.arange(end[-1])])
                counts.append(np.diff(np.concatenate(([0], end))[np.searchsorted(s, at)]))
        return np.concatenate(out), np.concatenate(counts)


def _path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def token_ids(docs: DataFrame, tokenizer: str = TOKENIZER, eos: int = EOS) -> DataFrame:
    """(doc_id, part, first, n, ids): ids with the end mark, as bytes; first counts the ids before it in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, enc = TaskContext.get().partitionId(), 0, Encoder(_path(tokenizer))
        for batch, data, offs in blocks(batches):
            ids, n = enc.rows(data, offs)
            at = np.cumsum(n)
            raw = np.insert(ids, at, eos).astype("<u4").tobytes()
            n += 1
            at = 4 * np.concatenate(([0], np.cumsum(n)))
            ids = [raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "part": pa.array(np.full(len(n), part, np.int64)), "first": pa.array(first + np.cumsum(n) - n), "n": pa.array(n), "ids": pa.array(ids, pa.binary())})
            first += int(n.sum())

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, part long, first long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    All documents, in the order of the stored table, form one stream that is cut every `length` ids; only the last sequence can be
    short. Null text is empty and gives the end mark alone; repeated rows are packed each; an empty table gives no row. A row's
    place is (part, first), not its doc_id, so ties and null ids are harmless; other columns are not read.

    The first pass stores the ids beside their running sum inside the task; one number a task, its total, reaches the driver for
    the second sum. The second pass is a map over the stored table, without a shuffle."""
    kept = stored(token_ids(docs, tokenizer, eos))
    base, run = {}, 0
    for part, n in sorted(map(tuple, kept.groupBy("part").agg(F.sum("n")).collect())):  # as long as the list of tasks
        base[part], run = run, run + n
    lookup = docs.sparkSession.sparkContext.broadcast(base)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = lookup.value
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc, part, first, n, ids in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "part", "first", "n", "ids")], strict=True):
                g, done = base[part] + first, 0
                while done < n:
                    seq, off = divmod(g + done, length)
                    take = min(length - off, n - done)
                    piece = ids[4 * done : 4 * (done + take)]
                    for k, v in zip(out, (doc, done, take, zlib.crc32(piece), n, seq, off, piece if with_ids else None), strict=True):
                        out[k].append(v)
                    done += take
            if not with_ids:
                out.pop("ids")
            yield pa.record_batch({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return in_arrow(kept, pieces, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
