"""HyperMinHash near-duplicate classes.

Each set of word shingles is hashed into K buckets; a bucket keeps the leading-zero count and MANTISSA bits of its least hash, and an
empty bucket borrows from a filled one chosen by a fixed hash of its number, so a register agrees with the probability of the Jaccard
similarity whatever the set's size. Bands of the compressed registers nominate pairs; a collision-corrected estimate drops what is
far below the threshold; whole shingle sets confirm the rest.

Equal sets are one class from the start. A band group first tries its members with one leader only, and is over once all of them are
in one class, so n near copies cost n pairs and not n * n. Members of different classes are then tried pair by pair where they are
few. In a larger group every set is reduced to what it differs in from one pivot, and only pairs whose differences share enough can be
linked (see prefix_rows): copies with random edits of their own meet nothing there. No pair that the bands hold together and that could
be similar stays untried unless its two members are connected already.

Pairs carry ids. Registers and sets of a pair meet by streaming: a leader's go once to a task, its partners' past them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, blocks, components, discard, in_arrow, keep_ids, mix, ngrams, raw_bytes, runs_of, scratch, stored, table, width, words

SHINGLE, PERCENT, ROWS, MANTISSA = 5, 80, 6, 10
#: Probability with which a pair exactly at the threshold may share no band.
MISS = 1e-6
#: Groups of so few members try all their pairs of different classes at once.
SMALL = 6
#: Partners of one document that stream past one copy of it.
STREAM = 512
#: Ratio of neighbouring size classes of sets.
STEP = 1.03
_ONE = np.uint64(1)


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles, sorted by both; fewer words make one shingle, no words none."""
    row, _, _, h = words(data, offs, NOT_SPACE, True)
    rows = len(offs) - 1
    at, g = ngrams(row, h, k)
    parts = [(row[at], g)]
    n = np.diff(runs_of(row, rows))
    for m in range(1, k):
        if len(few := np.flatnonzero(n == m)):
            pick = np.flatnonzero(np.isin(row, few))
            a, x = ngrams(row[pick], h[pick], m)
            parts.append((row[pick][a], mix(x + np.uint64(m))))
    r, g = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((g, r))
    r, g = r[order], g[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return r[new], g[new]


def registers(r: np.ndarray, g: np.ndarray, rows: int, k: int) -> np.ndarray:
    """rows x k compressed registers (leading zeros << MANTISSA | mantissa); rows without shingles are all 0."""
    top = np.iinfo(np.uint64).max
    least = np.full(rows * k, top, np.uint64)
    np.minimum.at(least, r * k + (g % np.uint64(k)).astype(np.int64), mix(g ^ np.uint64(0x5851F42D4C957F2D)))
    least = least.reshape(rows, k)
    filled = least != top
    some = filled.any(1)
    i, j = np.nonzero(~filled & some[:, None])
    out = least.copy()
    for t in range(1, 65):
        if not len(i):
            break
        c = (mix(j.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(t)) % np.uint64(k)).astype(np.int64)
        ok = filled[i, c]
        out[i[ok], j[ok]] = least[i[ok], c[ok]]
        i, j = i[~ok], j[~ok]
    if len(i):  # the next filled bucket
        c = (j + 1) % k
        while not (step := filled[i, c]).all():
            c = np.where(step, c, (c + 1) % k)
        out[i, j] = least[i, c]
    out[~some] = top
    # 53 leading bits suffice: float exponents give the leading zeros
    zeros = (63 - np.frexp((out >> np.uint64(1)).astype(np.float64) + 0.5)[1]).clip(0, 63).astype(np.uint64)
    mantissa = (out << (zeros + _ONE).clip(0, 63)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype("<u2")


def sketches(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the whole set; null when empty), regs (eight bytes of n_shingles, then the registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            r, g = shingle_sets(data, offs, shingle)
            regs, at = registers(r, g, batch.num_rows, k), runs_of(r, batch.num_rows)
            some = np.diff(at) > 0
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n_shingles": pa.array(np.diff(at).astype(np.int64)),
                    "set_key": pa.array([hashlib.blake2b(g[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    "regs": pa.array([n.tobytes() + x.tobytes() if s else None for n, x, s in zip(np.diff(at).astype("<i8"), regs, some, strict=True)], pa.binary()),
                }
            )

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, set_key binary, regs binary")


def band_keys(reps: DataFrame, rows: int, bands: int) -> DataFrame:
    """(band, id), one row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = raw_bytes(batch.column("regs"))[0].reshape(batch.num_rows, -1)[:, 8:].copy().view("<u2").reshape(batch.num_rows, bands, rows).astype(np.uint64)
            h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), regs.shape[:2]).copy()
            for i in range(rows):
                h = mix(h + regs[:, :, i] + _ONE)
            yield pa.record_batch({"band": pa.array(h.ravel().view(np.int64)), "id": pa.array(np.repeat(batch.column("id").to_numpy(), bands))})

    return in_arrow(reps.select("id", "regs"), run, "band long, id long")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less the share that equal only by their few bits."""
    k = a.shape[1]
    seen = (a == b).mean(1)
    z = np.arange(64)

    def zeros(n: np.ndarray) -> np.ndarray:  # P(the least of n / k hashes has z leading zeros)
        m = np.maximum(n / k, 1.0)[:, None]
        return (1 - 2.0 ** -(z + 1.0)) ** m - (1 - 2.0**-z) ** m

    by_chance = (zeros(na) * zeros(nb)).sum(1) / 2**MANTISSA
    return (seen - by_chance) / (1 - by_chance)


def facing(pairs: DataFrame, payload: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Rows of the kernel over the pairs (a, b): the bodies of the b's stream past the body of their a.

    payload is (id, body). An a is sent once to a task for every STREAM of its pairs, whatever its pairs number, and never beside each b: a
    group with one leader costs one body a pair, and a leader of very many is copied to as many tasks as that takes. kernel(own, many) gets the
    bodies of a and (ids, bytes, offsets) of b's, and returns a record batch without column a."""
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("copies"))
    refs = load.select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")).join(payload.select(F.col("id").alias("a"), "body"), "a")
    many = pairs.join(load, "a").select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"), "b").join(payload.select(F.col("id").alias("b"), "body"), "b")
    rows = refs.select("a", "salt", F.lit(None).cast("long").alias("b"), "body").unionByName(many.select("a", "salt", "b", "body"))
    rows = rows.repartition(width(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            a, salt = batch.column("a").to_numpy(), batch.column("salt").to_numpy()
            ref = np.asarray(batch.column("b").is_null())
            data, offs = raw_bytes(batch.column("body"))
            edges = np.flatnonzero((a[1:] != a[:-1]) | (salt[1:] != salt[:-1]) | (ref[1:] != ref[:-1])) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(a)], strict=True):
                if ref[i]:
                    if (a[i], salt[i]) != key:
                        key, own = (a[i], salt[i]), []
                    own += [data[offs[x] : offs[x + 1]].copy() for x in range(i, j)]
                    continue
                out = kernel(own if (a[i], salt[i]) == key else [], batch.column("b").slice(i, j - i).to_numpy(), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                if out.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, a[i])), *out.columns], names=["a", *out.schema.names])

    return in_arrow(rows.select("a", "salt", "b", "body"), run, schema)


def shared_counts(own: np.ndarray, other: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of each run of `other` are in the sorted, distinct `own`."""
    if not len(own) or not len(other):
        return np.zeros(len(offs) - 1, np.int64)
    at = np.searchsorted(own, other).clip(0, len(own) - 1)
    c = np.concatenate(([0], np.cumsum(own[at] == other)))
    return c[offs[1:]] - c[offs[:-1]]


def confirmed(pairs: DataFrame, bodies: DataFrame, percent: int, k: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets have Jaccard similarity of at least percent / 100: the estimate from registers drops what
    is far below it, the stored shingle sets decide."""
    t, head = percent / 100, 8 + 2 * k

    def check(own: list, ids: np.ndarray, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        top = data[offs[:-1, None] + np.arange(head)]
        nb, rb = top[:, :8].copy().view("<i8")[:, 0], top[:, 8:].copy().view("<u2")
        ok = np.zeros(len(ids), bool)
        for x in own:
            na, ra, set_ = np.full(len(ids), x[:8].view("<i8")[0]), x[8:head].view("<u2")[None, :], x[head:].copy().view("<u8")
            slack = 7 * np.sqrt(t * (1 - t) / np.minimum(np.minimum(na, nb), k)) + 0.02
            near = (estimate(ra, rb, na.astype(float), nb.astype(float)) >= t - slack) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ~ok
            if len(some := np.flatnonzero(near)):
                both = shared_counts(set_, np.concatenate([data[offs[i] + head : offs[i + 1]] for i in some]).view("<u8"), np.concatenate(([0], np.cumsum(nb[some]))))
                ok[some] = 100 * both >= percent * (len(set_) + nb[some] - both)
        return pa.record_batch({"b": pa.array(ids[ok])})

    return facing(pairs, bodies, check, "a long, b long")


def whole_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, body): the sorted 64-bit shingle hashes of the documents in `ids`, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches):
            r, g = shingle_sets(data, offs, shingle)
            at, raw = 8 * runs_of(r, batch.num_rows), g.astype("<u8").tobytes()
            yield pa.record_batch({"id": batch.column("doc_id").cast(pa.int64()), "n_shingles": pa.array(np.diff(at) // 8), "body": pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    text = keep_ids(docs.select("doc_id", "text").where("text is not null"), ids.withColumnRenamed("id", "doc_id"), "doc_id")
    return in_arrow(text, run, "id long, n_shingles long, body binary")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable through links), kept (it is that document) of every row.

    Words are runs of non-space characters after A-Z are lower-cased; a text with fewer words than a shingle has is one shingle; null
    and empty texts have none and stay alone. Equal texts, however many, are one class by one aggregation. doc_id should be unique and
    not null: rows that repeat a doc_id get the class of their own set each, under that id; a null id stays alone. An empty table gives no row;
    other columns are not read. Links are lost only with probability `miss` (default one in a million, at the threshold)."""
    with scratch(docs.sparkSession) as keep:
        out = keep(stored(_classes(docs, shingle, percent, rows, bands_for(percent, rows, miss))))
    return out.withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)))


def _classes(docs: DataFrame, shingle: int, percent: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, component_id. Registers, sets and groups are discarded when the last step that reads them is over."""
    k = bands * rows
    sketched = stored(sketches(docs, shingle, k))
    reps = stored(sketched.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")))
    all_rows = stored(sketched.select("doc_id", "n_shingles", "set_key"))
    discard(sketched)
    keyed = band_keys(reps, rows, bands)
    shared = keyed.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("band")
    groups = stored(keyed.join(shared, "band").select(F.col("band").alias("grp"), "id"))
    # A member's degree is how many others its groups hold: the text that many near copies were made from has the greatest, and the
    # copies are often similar to it and not to each other. It leads its groups.
    size = groups.groupBy("grp").agg(F.count("*").alias("n"))
    degree = stored(groups.join(size, "grp").groupBy("id").agg(F.sum("n").alias("degree")))
    sets = whole_sets(docs, degree.select("id"), shingle)
    bodies = stored(reps.join(sets, ["id", "n_shingles"]).select("id", F.concat("regs", "body").alias("body")))
    ids = stored(reps.select("set_key", "id"))
    discard(reps)
    links = labels = None

    def tried(pairs: DataFrame, more: DataFrame | None = None) -> None:
        nonlocal links, labels
        pairs = stored(pairs.distinct())
        new = confirmed(pairs, bodies, percent, k)
        new = stored(new if more is None else new.unionByName(more))
        discard(pairs)
        if links is None or not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            last, labels = labels, stored(components(links))
            discard(last)

    # 1. Every member of a band group with the group's leader.
    leaders = stored(with_leader(groups, degree))
    tried(leaders.where("id <> a").select("a", F.col("id").alias("b")))
    every, groups = groups, stored(several(labelled(groups, labels)))
    discard(every)
    if not groups.isEmpty():
        # 2. Groups that are still of several classes: the pairs of different classes of the small ones; the large ones by what their
        # members' sets differ in from one pivot.
        sized = groups.join(groups.groupBy("grp").agg(F.count("*").alias("n")), "grp")
        large = stored(sized.where(f"n > {SMALL}").select("grp", "id"))
        small = cross(sized.where(f"n <= {SMALL}"))
        if large.isEmpty():
            tried(small)
        else:
            differ = differences(large, leaders, degree, bodies, percent, k)
            prefixes = stored(prefix_rows(differ, percent))
            # Texts that are near each other and not near the pivot: a leader of each shared difference first, as in 1.
            far = several(labelled(prefixes.where("not near and side = 1").select(F.xxhash64("a", "e").alias("grp"), "id").distinct(), labels))
            led = with_leader(far, degree).where("id <> a and label <> la").select("a", F.col("id").alias("b"))
            tried(small.unionByName(led), differ.where("near").select("a", "b").distinct())
            # 3. What differences still suggest.
            tried(suggested(prefixes, labels, percent))
    out = all_rows.join(ids, "set_key", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "id", "doc_id").alias("component_id"))


def with_leader(groups: DataFrame, degree: DataFrame) -> DataFrame:
    """groups with `a`, the member of greatest degree of each group, the least id among equals (and its label `la`)."""
    label = F.col("label") if "label" in groups.columns else F.lit(None).cast("long")
    lead = groups.join(degree, "id").groupBy("grp").agg(F.min(F.struct((-F.col("degree")).alias("d"), "id", label.alias("label"))).alias("l"))
    return groups.join(lead.select("grp", F.col("l.id").alias("a"), F.col("l.label").alias("la")), "grp")


def labelled(groups: DataFrame, labels: DataFrame) -> DataFrame:
    return groups.join(labels.withColumnRenamed("node", "id"), "id", "left").select("grp", "id", F.coalesce("root", "id").alias("label"))


def several(groups: DataFrame) -> DataFrame:
    """The groups whose members are of more than one class."""
    open_ = groups.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("grp")
    return groups.join(open_, "grp")


def cross(groups: DataFrame) -> DataFrame:
    """(a, b) of the members of different classes of each group; for groups of a few members."""
    x = groups.select("grp", F.col("id").alias("a"), F.col("label").alias("la"))
    y = groups.select("grp", F.col("id").alias("b"), F.col("label").alias("lb"))
    return x.join(y, "grp").where("a < b and la <> lb").select("a", "b")


def differences(large: DataFrame, leaders: DataFrame, degree: DataFrame, bodies: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b, k, n, d, near, e), one row for each shingle e that is in only one of the sets of the pivot a and of b, a member of a large
    group: k tells apart several sets of one id, n is the size of b's set, d of the difference, near whether a and b are linked.

    The pivot of a group is the leader of greatest degree that any member was compared with in any group, so that the groups around one
    text share a pivot."""
    ids = large.select("id").distinct()
    met = keep_ids(leaders.select("id", "a"), ids, "id").join(degree.withColumnRenamed("id", "a"), "a")
    best = met.groupBy("id").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("a").alias("a"))).alias("m"))
    pivot = large.join(best, "id").groupBy("grp").agg(F.min("m").alias("m")).select("grp", F.col("m.a").alias("a"))
    pairs = stored(large.join(pivot, "grp").where("id <> a").select("a", F.col("id").alias("b")).distinct())
    head = 8 + 2 * k
    def differ(own: list, ids: np.ndarray, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        pivot = min(own, key=lambda x: x.tobytes())[head:].copy().view("<u8") if own else None
        out = {c: [] for c in ("b", "k", "n", "d", "near", "e")}
        for i, b in enumerate(ids.tolist() if own else ()):
            other = data[offs[i] + head : offs[i + 1]].copy().view("<u8")
            e = np.setxor1d(pivot, other, assume_unique=True).view("<i8")
            m, n = len(e), len(other)
            both = (len(pivot) + n - m) // 2
            near = 100 * both >= percent * (len(pivot) + n - both)
            for c, v in zip(out, (b, int(np.bitwise_xor.reduce(other).view("<i8")), n, m, near), strict=False):
                out[c].append(np.full(m, v))
            out["e"].append(e)
        return pa.record_batch({c: pa.array(np.concatenate(v) if v else np.zeros(0)).cast(pa.bool_() if c == "near" else pa.int64()) for c, v in out.items()})

    return stored(facing(pairs, bodies, differ, "a long, b long, k long, n long, d long, near boolean, e long"))


def prefix_rows(differ: DataFrame, percent: int) -> DataFrame:
    """Rows by which pairs under one pivot can meet: (a, e, size_class, target, side, id, k, n, d, pos, near).

    Let x, y be the sizes of two sets A, B and D, E what they differ in from the pivot. Linked sets differ in at most s = eps * (x + y)
    shingles, eps = (1 - t) / (1 + t), so D and E share at least (|D| + |E| - s) / 2, more than 0 unless both are near the pivot and so
    linked through it. In one order of all shingles, the rarest first, they share one of the first shingles of each: of E, the smaller
    difference, of the first eps * (x + y) / 2 + 1 (side 0, one row for each class of x it can meet), of D of the first eps * (x + y) + 1 (side 1,
    under its own class of x). Random edits of one text put only shingles of their own there, which nothing meets."""
    t = percent / 100
    eps = (1 - t) / (1 + t)
    df = differ.groupBy("a", "e").agg(F.count("*").alias("df"))
    lists = differ.join(df, ["a", "e"]).groupBy("a", "b", "k").agg(F.first("n").alias("n"), F.first("d").alias("d"), F.first("near").alias("near"), F.sort_array(F.collect_set(F.struct("df", "e"))).alias("x"))
    class_of = lambda n: F.floor(F.log(n) / math.log(STEP)).cast("int")
    lists = lists.withColumn("own", class_of(F.col("n").cast("double")))
    reach = lambda bound: F.least(F.floor(bound + 1e-6) + 1, F.col("d")).cast("int")
    n = F.col("n")
    small = lists.withColumn("size_class", F.explode(F.sequence(class_of(n * t) - 1, class_of(n / t) + 1))).withColumn("m", reach((F.pow(F.lit(STEP), F.col("size_class") + 1) + n) * (eps / 2)))
    large = lists.withColumn("size_class", F.col("own")).withColumn("m", reach((n + n / t) * eps))
    each = lambda rows, side: rows.select("a", "b", "k", "n", "d", "near", "size_class", F.lit(side).alias("side"), F.posexplode(F.slice("x", F.lit(1), F.col("m"))).alias("pos", "y")).where("y.df > 1")
    rows = each(small, 0).unionByName(each(large, 1))
    return rows.select("a", F.col("y.e").alias("e"), "size_class", "side", F.col("b").alias("id"), "k", "n", "d", "pos", "near")


def suggested(prefixes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs of different classes that meet in a prefix, can be similar by their sizes and by what their lists still hold from
    there on, and are not both near the pivot."""
    eps = (1 - percent / 100) / (1 + percent / 100)
    rows = prefixes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("root", "id"))
    # a near one meets far ones only
    small = rows.where("side = 0").withColumn("other_near", F.explode(F.when(F.col("near"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    x = small.select("a", "e", "size_class", "other_near", *[F.col(c).alias(f"{c}0") for c in ("id", "n", "d", "pos", "label")])
    y = rows.where("side = 1").select("a", "e", "size_class", F.col("near").alias("other_near"), *[F.col(c).alias(f"{c}1") for c in ("id", "n", "d", "pos", "label")])
    both = x.join(y, ["a", "e", "size_class", "other_near"]).where(
        f"label0 <> label1 and (d0 < d1 or (d0 = d1 and id0 < id1)) and d1 - d0 <= {eps} * (n0 + n1) + 1e-6 and 2 * least(d0 - pos0, d1 - pos1) >= d0 + d1 - {eps} * (n0 + n1) - 1e-6"
    )
    return both.select(F.least("id0", "id1").alias("a"), F.greatest("id0", "id1").alias("b"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, but for documents that have a near duplicate of smaller doc_id in their class."""
    with scratch(docs.sparkSession) as keep:
        gone = keep(stored(near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct()))
    return keep_ids(docs, gone, "doc_id", "left_anti").select(docs.columns)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
