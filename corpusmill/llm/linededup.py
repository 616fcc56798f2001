"""Line dedup by suffix arrays over line-ID sequences, built by distributed prefix doubling.

Every line is a 64-bit id. Round by round the suffixes that start with the same h lines, a longest-common-prefix interval of depth h,
get one rank, in order; joining a suffix's rank with that of the suffix h lines on gives depth 2h. A suffix that shares its first h
lines with none is in its final place and leaves, so rounds shrink with the repeats and stop at the longest one. An interval's first
suffix is the kept copy; every other suffix of depth MIN_LINES or more is a later copy, and its lines go. Shorter copies go on request
if they are long in characters or whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, in_arrow, keep_ids, scratch, stored, table, width

#: Lines in the shortest run that counts as repeated.
MIN_LINES = 3
#: Characters in a shorter run that counts all the same, where a caller asks for such runs.
MIN_CHARS = 100


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", "at", F.xxhash64("line").alias("r"))


def ranked(intervals: DataFrame) -> DataFrame:
    """Add `rank`, the dense position in the order of (r, r2): sorted ranges, numbered inside, then shifted by the sizes before."""
    n = width(intervals.sparkSession)
    ordered = intervals.repartitionByRange(n, "r", "r2").sortWithinPartitions("r", "r2")
    schema = intervals.schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), 0
        for b in batches:
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * k, pa.int32()), pa.array(range(first, first + k), pa.int64())], names=[*b.schema.names, "part", "i"])
            first += k

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    numbered = stored(in_arrow(ordered, number, f"{names}, part int, i long"))
    base, run = [], 0
    for part, size in sorted(map(tuple, numbered.groupBy("part").agg(F.count("*")).collect())):  # one number a range
        base.append((part, run))
        run += size
    shift = intervals.sparkSession.createDataFrame(base, "part int, base long")
    return numbered.join(F.broadcast(shift), "part").withColumn("rank", F.col("base") + F.col("i")).drop("part", "i", "base")


def with_unique_ids(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame] | None]:
    """docs as they are and None where no doc_id repeats. Else docs with new ids, one for each doc_id and text, in the order of doc_id and a
    hash of the text, and a function that gives a result its own ids back. Null ids stay null."""
    some = docs.where("doc_id is not null")
    if some.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs, None
    t = free_name(docs, "text_hash_")
    hashed = docs.withColumn(t, F.xxhash64(F.coalesce("text", F.lit(""))))
    with scratch(docs.sparkSession) as keep:
        keys = keep(stored(ranked(hashed.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("r"), F.col(t).alias("r2")).distinct())))
    rank = free_name(docs, "rank")
    new = hashed.join(keys.select(F.col("r").alias("doc_id"), F.col("r2").alias(t), F.col("rank").alias(rank)), ["doc_id", t], "left")
    new = new.select(*[F.col(rank).alias("doc_id") if c == "doc_id" else F.col(c) for c in docs.columns])

    def own(out: DataFrame) -> DataFrame:
        back = keys.select(F.col("rank").alias("doc_id"), F.col("r").alias(free_name(out, "own_id_")))
        return out.join(back, "doc_id", "left").select(*[F.col(free_name(out, "own_id_")).alias("doc_id") if c == "doc_id" else F.col(c) for c in out.columns])

    return stored(new), own


def deeper(level: DataFrame, step: int) -> DataFrame | None:
    """(doc_id, at, r, f_doc, f_at) at `step` lines more than `level`: suffixes still shared, their interval's rank and first suffix."""
    after = level.select("doc_id", (F.col("at") - step).alias("at"), F.col("r").alias("r2"))
    with scratch(level.sparkSession) as keep:
        pairs = stored(level.select("doc_id", "at", "r").join(after, ["doc_id", "at"]))
        shared = pairs.groupBy("r", "r2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("f")).where("n > 1")
        shared = ranked(shared.select("r", "r2", F.col("f.doc_id").alias("f_doc"), F.col("f.at").alias("f_at")))
        out = keep(stored(pairs.join(shared, ["r", "r2"]).select("doc_id", "at", F.col("rank").alias("r"), "f_doc", "f_at")))
    return None if out.isEmpty() else out


def levels(docs: DataFrame, min_lines: int, deepest: int | None = None, short: bool = False) -> Iterator[tuple[int, DataFrame]]:
    """(depth, shared suffixes): depth min_lines, then its doublings as long as anything is shared (or up to `deepest`); with `short`
    every depth below min_lines comes before."""
    lines = lines_of(docs)
    often = lines.groupBy("r").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("f")).where("n > 1")
    often = stored(often.select("r", F.col("f.doc_id").alias("f_doc"), F.col("f.at").alias("f_at")))
    level: DataFrame | None = stored(lines.join(often, "r").dropDuplicates(["doc_id", "at"]))
    discard(often)
    depth = 1
    while level is not None:
        if short or depth >= min_lines:
            yield depth, level
        if deepest is not None and depth >= deepest:
            return
        step = depth if depth >= min_lines else 1 if short else min(depth, min_lines - depth)
        level, depth = deeper(level, step), depth + step


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, deepest: int | None = None, short: bool = False) -> tuple[DataFrame | None, DataFrame | None]:
    """(doc_id, starts) of the suffixes with an earlier copy of min_lines or more, as (at, k = min_lines), and (doc_id, longest): the
    depth of the deepest interval in which a suffix of the document is a later copy. With `short` the starts of shorter copies of k
    lines come too; blank lines alone do not."""
    starts, deep = None, None
    for depth, level in levels(docs, min_lines, deepest, short):
        later = level.where("doc_id <> f_doc or at <> f_at")
        if depth == 1 < min_lines:
            later = later.where(F.col("r") != F.xxhash64(F.lit("")))
        if depth <= min_lines:
            own = later.select("doc_id", "at", F.lit(depth).alias("k"))
            starts = own if starts is None else starts.unionByName(own)
        at = later.select("doc_id").distinct().withColumn("depth", F.lit(depth))
        deep = at if deep is None else deep.unionByName(at)
    if starts is None:
        return None, None
    return stored(starts.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("at", "k"))).alias("starts"))), deep.groupBy("doc_id").agg(F.max("depth").alias("longest"))


MARKS = "n_lines long, n_removed long, n_runs long, copy_depth int"


def without(lines: list[str], copies: list[tuple[int, int]]) -> tuple[list[str], int]:
    """(lines outside the copies (start, length) in ascending order, how many runs after joining those that touch)."""
    kept: list[str] = []
    runs, end = 0, -1
    for s, k in copies:
        if s > end:
            kept += lines[max(end, 0) : s]
            runs += 1
        end = max(end, s + k)
    return kept + lines[max(end, 0) :], runs


def counts(lines: list[str], s: int, k: int, min_chars: int) -> bool:
    """Whether a copy of fewer than min_lines lines goes: it has min_chars characters, or it is the whole of a text that is not blank."""
    n = sum(len(x.strip()) for x in lines[s : s + k])
    return n >= min_chars or (n > 0 and k == len(lines))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, deepest: int | None = None, min_chars: int | None = None) -> DataFrame:
    """Every row of docs with its columns, text being what is kept, and n_lines, n_removed, n_runs, copy_depth.

    Lines are the parts between line feeds. A run of min_lines or more lines that also starts earlier (smaller doc_id, or further up
    in the same document) is removed, run by run as long as the intervals go; the first copy stays. Runs are judged on the input. An
    empty text is one empty line; null texts stay null, with 0 lines; null ids keep all; rows that repeat a doc_id with other texts are
    documents of their own, in the order of a hash of their texts, and rows that repeat both are one; an empty table gives no row. Columns of docs named like the four new ones are replaced. copy_depth is the depth of
    the deepest interval in which the document is a later copy (min_lines times a power of two; 0: none).

    With min_chars a repeated run of fewer lines goes as well if its lines, stripped, have that many characters or if it is a whole
    text that is not blank, so that a single long line and a copy of a short document count."""
    docs = docs.drop(*[c.split()[0] for c in MARKS.split(", ")])
    docs, own_ids = with_unique_ids(docs)
    out = _deduped(docs, min_lines, deepest, min_chars)
    return out if own_ids is None else own_ids(out)


def _deduped(docs: DataFrame, min_lines: int, deepest: int | None, min_chars: int | None) -> DataFrame:
    copies_ = free_name(docs, "copies_")
    zero = [F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_runs"), F.lit(0).alias("copy_depth")]
    same = lambda d: d.select("*", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"), *zero)
    with scratch(docs.sparkSession) as keep:
        starts, deep = later_copies(docs, min_lines, deepest, min_chars is not None)
        if starts is None:
            return same(docs)
        ids = keep(stored(starts.join(deep, "doc_id").select("doc_id", F.struct("starts", "longest").alias(copies_))))
    n = ids.count()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, gone, runs, texts, depth = [], [], [], [], []
            for text, at in zip(b.column("text").to_pylist(), b.column(copies_).to_pylist(), strict=True):
                lines = text.split("\n")
                copies = [(s["at"], s["k"]) for s in at["starts"] if s["at"] < len(lines)]
                kept, k = without(lines, [(s, k) for s, k in copies if k >= min_lines or counts(lines, s, k, min_chars)])
                n_lines.append(len(lines))
                gone.append(len(lines) - len(kept))
                runs.append(k)
                texts.append("\n".join(kept))
                depth.append(at["longest"] if k else 0)
            b = b.drop_columns([copies_]).set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            new = [pa.array(x, pa.int64()) for x in (n_lines, gone, runs)] + [pa.array(depth, pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *[c.split()[0] for c in MARKS.split(", ")]])

    schema = same(docs).schema
    own = [f.name for f in docs.schema]
    changed = keep_ids(docs, ids.select("doc_id"), "doc_id", n=n).select(own).where("text is not null").join(ids, "doc_id").select(*own, copies_)
    rest = keep_ids(docs, ids.select("doc_id"), "doc_id", "left_anti", n=n).select(own)
    nulls = keep_ids(docs.where("text is null"), ids.select("doc_id"), "doc_id", n=n).select(own)
    return in_arrow(changed, cut, schema).unionByName(same(rest)).unionByName(same(nulls))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Brute force over all runs of three lines.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], chr(10)) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS j FROM r),
k AS (SELECT doc_id, list(j) AS gone, count(*) FILTER (WHERE NOT p) AS runs FROM (SELECT doc_id, j, coalesce(lag(j) OVER (PARTITION BY doc_id ORDER BY j) = j - 1, false) AS p FROM c) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_runs,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
