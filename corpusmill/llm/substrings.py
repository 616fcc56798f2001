"""Substring dedup by suffix automata of reference shards.

A window is WINDOW consecutive words; one whose words also start earlier is removed. The reference is every passage with a later copy:
winnowed fingerprints find the documents that can share a window, hashes of the windows around shared fingerprints nominate each
window's first copy, and the first copies, cut into shards of bounded size, become suffix automata. The nominated passages of later
documents stream through their shard's automaton; its matching statistics and first positions alone decide what goes.

The automata are not sent to every executor: the reference grows with the corpus, so it has no bound a broadcast could rest on. A
shard travels to the tasks that stream documents against it, and a shard that many documents need is copied to several tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, _Q, blocks, in_arrow, keep_ids, mix, ngrams, runs_of, stored, table, width, winnow, words
from .linededup import with_unique_ids

WINDOW = 20
#: Words of reference in one automaton, and of documents streamed through one copy of it.
SHARD_WORDS, STREAM_WORDS = 50_000, 500_000


class SuffixAutomaton:
    """Of several sequences, with the first end position of every state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, nxt: dict, link: int, length: int, first: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def add(self, symbols: list, at: int) -> None:
        """Add one sequence whose symbols have the positions at, at + 1, ...; call in ascending order of positions."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for pos, c in enumerate(symbols, at):
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[last] + 1 == length[q] else self._split(last, q, c)
                continue
            cur = self._state({}, 0, length[last] + 1, pos)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[p] + 1 == length[q] else self._split(p, q, c)
            last = cur

    def _split(self, p: int, q: int, c) -> int:
        nxt, link = self.next, self.link
        clone = self._state(dict(nxt[q]), link[q], self.length[p] + 1, self.first[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def windows(self, symbols: list, size: int) -> Iterator[tuple[int, int]]:
        """(start of a window in symbols, first end position of an equal window in the reference), by matching statistics."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        v = n = 0
        for i, c in enumerate(symbols):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            w = nxt[v].get(c)
            if w is None:
                continue
            v, n = w, n + 1
            if n >= size:
                u = v
                while length[link[u]] >= size:
                    u = link[u]
                yield i - size + 1, first[u]


def _profile(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, whole (digest of the words), prints (winnowed fingerprints that every shared window shares)."""
    k = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            row, _, _, h = words(data, offs, NOT_SPACE, False)
            f, g = ngrams(row, h, k)
            sel = winnow(row[f], g, window - k + 1)
            r, x = row[f][sel], g[sel].view(np.int64)
            n, at = np.diff(runs_of(row, batch.num_rows)), runs_of(r, batch.num_rows)
            raw = data.tobytes()
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n_words": pa.array(n.astype(np.int64)),
                    "whole": pa.array([hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offs[:-1], offs[1:], strict=True)]),
                    "prints": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)),
                }
            )

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_words long, whole string, prints array<long>")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(w, doc_id, at): hash and start of each window whose fingerprint is in `shared`."""
    k = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            row, _, _, h = words(data, offs, NOT_SPACE, False)
            starts = runs_of(row, batch.num_rows)
            f, g = ngrams(row, h, k)
            shared = batch.column("shared")
            lists = [np.asarray(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else np.zeros(0, np.int64) for x in shared]
            keep = np.zeros(len(g), bool)
            grow = row[f]
            at = runs_of(grow, batch.num_rows)
            for i, own in enumerate(lists):
                keep[at[i] : at[i + 1]] = np.isin(g[at[i] : at[i + 1]].view(np.int64), own)
            # windows whose winnowed gram is shared: the same choice as in _profile
            n = len(g) - (window - k)
            if n <= 0:
                continue
            best, pick = g[:n].copy(), np.arange(n)
            for j in range(1, window - k + 1):
                x = g[j : j + n]
                less = x <= best
                best[less] = x[less]
                pick[less] = np.flatnonzero(less) + j
            ok = (grow[:n] == grow[window - k :]) & keep[pick]
            first = f[:n][ok]
            acc = h[first].copy()
            for j in range(1, window):
                acc = acc * _Q + h[first + j]
            yield pa.record_batch({"w": pa.array(mix(acc).view(np.int64)), "doc_id": batch.column("doc_id").take(pa.array(row[first])), "at": pa.array((first - starts[row[first]]).astype(np.int32))})

    return in_arrow(docs.select("doc_id", "text", "shared"), run, "w long, doc_id long, at int")


def _runs(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Word ranges [a, b) that the windows at the ascending starts cover, joined where they touch or overlap."""
    out: list[list[int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return [tuple(x) for x in out]


def repeated_windows(docs: DataFrame, profile: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, starts): the windows that also start earlier, in documents that are first of their kind (whole texts apart)."""
    whole = profile.where(f"n_words >= {window} and doc_id is not null")
    firsts = whole.groupBy("whole").agg(F.min("doc_id").alias("first"))
    copies = stored(whole.select("whole", "doc_id").join(firsts, "whole").where("doc_id > first").select("doc_id").distinct())
    base = keep_ids(whole.select("doc_id", "prints"), copies, "doc_id", "left_anti").select("doc_id", F.explode("prints").alias("p"))
    often = stored(base.groupBy("p").agg(F.count("*").alias("n")).where("n > 1").select("p"))
    shared = stored(keep_ids(base, often, "p").groupBy("doc_id").agg(F.collect_set("p").alias("shared")))
    n = shared.count()
    some = keep_ids(docs.select("doc_id", "text"), shared.select("doc_id"), "doc_id", n=n).join(shared, "doc_id")
    wins = stored(_windows(some, window))
    first = wins.groupBy("w").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.count("*").alias("n")).where("n > 1").select("w", F.col("f.doc_id").alias("owner"), F.col("f.at").alias("o_at"))
    hits = wins.join(first, "w")
    # one row for each document: its windows that are first copies (owner: itself), and those with an earlier copy
    roles = stored(hits.groupBy("doc_id", "owner").agg(F.sort_array(F.collect_set("at")).alias("ats")))
    shards = F.pmod(F.xxhash64("owner"), F.lit(max(1, -(-int(roles.where("doc_id = owner").agg(F.sum(F.size("ats"))).first()[0] or 0) // SHARD_WORDS))))
    roles = roles.withColumn("shard", shards)
    per_doc = roles.groupBy("doc_id").agg(F.collect_list(F.struct("owner", "shard", "ats")).alias("roles"))
    some = keep_ids(docs.select("doc_id", "text"), roles.select("doc_id").distinct(), "doc_id").join(per_doc, "doc_id")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("shard", "ref", "doc_id", "at", "words")}
            for doc, text, roles in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "roles")], strict=True):
                w = text.encode().split()
                by: dict[tuple[int, bool], set] = {}
                for r in roles:
                    by.setdefault((r["shard"], r["owner"] == doc), set()).update(r["ats"])
                for (shard, own), ats in by.items():
                    for a, b in _runs(sorted(ats), window):
                        for k, v in zip(out, (shard, own, doc, a, b" ".join(w[a:b])), strict=True):
                            out[k].append(v)
                        if own:  # a first copy can have a later copy in its own document
                            for k, v in zip(out, (shard, False, doc, a, b" ".join(w[a:b])), strict=True):
                                out[k].append(v)
            yield pa.record_batch({k: pa.array(v, {"ref": pa.bool_(), "words": pa.binary()}.get(k, pa.int64())) for k, v in out.items()})

    pieces = stored(in_arrow(some.select("doc_id", "text", "roles"), spans, "shard long, ref boolean, doc_id long, at long, words binary"))
    load = pieces.where("not ref").groupBy("shard").agg(F.sum(F.octet_length("words") / 6).alias("load")).select("shard", F.greatest(F.lit(1), F.ceil(F.col("load") / STREAM_WORDS)).cast("int").alias("copies"))
    placed = pieces.join(load, "shard").withColumn("copy", F.explode(F.when(F.col("ref"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int")))))
    placed = placed.repartition(width(docs.sparkSession), "shard", "copy").sortWithinPartitions("shard", "copy", F.desc("ref"), "doc_id", "at")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, auto, where, size = None, None, [], 0
        for batch in batches:
            docs_, starts = [], []
            for shard, copy, ref, doc, at, seq in zip(*[batch.column(c).to_pylist() for c in ("shard", "copy", "ref", "doc_id", "at", "words")], strict=True):
                if (shard, copy) != key:
                    key, auto, where, size = (shard, copy), SuffixAutomaton(), [], 0
                w = seq.split(b" ")
                if ref:
                    auto.add(w, size)
                    where.append((size, doc, at))
                    size += len(w)
                    continue
                ends = [x[0] for x in where]
                for i, end in auto.windows(w, window):
                    base, o_doc, o_at = where[int(np.searchsorted(ends, end, "right")) - 1] if len(ends) < 64 else where[_bisect(ends, end)]
                    if (o_doc, o_at + end - base - window + 1) < (doc, at + i):
                        docs_.append(doc)
                        starts.append(at + i)
            yield pa.record_batch({"doc_id": pa.array(docs_, pa.int64()), "at": pa.array(starts, pa.int64())})

    found = in_arrow(placed.select("shard", "copy", "ref", "doc_id", "at", "words"), stream, "doc_id long, at long")
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("starts")), copies


#: Removed runs of words, as Spark and as Arrow name them.
SPAN = "array<struct<first:int,past:int>>"
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))


def _bisect(ends: list[int], x: int) -> int:
    from bisect import bisect_right

    return bisect_right(ends, x) - 1


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and on demand spans: the removed runs of words, each from its first word's
    place (from 0) up to, not including, `past`.

    Words are runs of characters other than the six ASCII spaces. A word goes if a window over it also starts earlier, in a document
    with a smaller doc_id or further up in the same one; the windows are those of the input. Null and empty texts have no words; a
    text shorter than a window keeps all; a text whose words are those of an earlier one, a window or more, loses all. Rows that
    repeat a doc_id with other texts are documents of their own, in the order of a hash of their texts; rows that repeat both are one
    document; null ids keep all. An empty table gives no row; other columns are not read."""
    docs, own_ids = with_unique_ids(docs.select("doc_id", "text"))
    out = _removed(docs, window, with_spans)
    return out if own_ids is None else own_ids(out)


def _removed(docs: DataFrame, window: int, with_spans: bool) -> DataFrame:
    profile = stored(_profile(docs, window))
    starts, copies = repeated_windows(docs, profile, window)
    starts = stored(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, sha, spans = [], [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                w = (text or "").encode().split()
                runs, kept, p = _runs(at, window), [], 0
                for a, b in runs:
                    kept += w[p:a]
                    p = b
                kept += w[p:]
                gone.append(len(w) - len(kept))
                spans.append([{"first": a, "past": b} for a, b in runs])
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            more = {"spans": pa.array(spans, SPANS)} if with_spans else {}
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "gone": pa.array(gone, pa.int64()), "sha": pa.array(sha, pa.string()), **more})

    changed = keep_ids(docs.select("doc_id", "text"), starts.select("doc_id"), "doc_id").join(starts, "doc_id")
    changed = in_arrow(changed.select("doc_id", "text", "starts"), cut, "doc_id long, gone long, sha string" + (f", spans {SPAN}" if with_spans else "")).dropDuplicates(["doc_id"])
    out = profile.drop("prints").join(changed, "doc_id", "left").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left")
    none = hashlib.sha256(b"").hexdigest()
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("past")))
    spans = F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.array().cast(SPAN))).alias("spans") if with_spans else None
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(none)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
        *([spans] if with_spans else []),
    )


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Brute force over all windows.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
k AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
