"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL expressions only.

A sketch has three subtables of cells (count, xor of digests, xor of their checks); a digest enters one cell of each. Two sketches of
one size subtract cell by cell; digests both texts have vanish, and peeling cells with a single digest recovers the others. A difference
that does not peel is taken again from larger tables. Tables are sorted arrays of their cells that are not empty, made by one sort and one
pass, so a text of n paragraphs costs about n log n and a large table no more than a small one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, width

#: Bits of a cell number of one subtable in the fingerprint; rounds of peeling; larger tables that are tried, each four times the one before.
BITS, ROUNDS, LARGER = 3, 40, 8
BASE = 1 << BITS
#: A paragraph is a line; a line is also cut after every mark that white space follows, and after the full-width marks that end a
#: sentence without a space, so that texts of one line have parts.
CUT = "\\\\n+|\\\\s(?<=[\\\\p{P}\\\\p{S}]\\\\s)\\\\s*|(?<=[\\u3002\\uFF01\\uFF1F\\uFF1B])"
LOWEST = -(2**63)


def digests(text: str, cut: str = CUT) -> str:
    """SQL for the distinct digests of the paragraphs of a text: 63 bits, the lowest is left to signs."""
    return f"array_remove(array_distinct(transform(split({text}, '{cut}'), x -> xxhash64(x) & -2L)), xxhash64('') & -2L)"


def named(value: str, name: str, body: str) -> str:
    """SQL for body with a name for value: a lambda's argument is computed once, an expression at each of its uses."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _place(k: str, j: int, w: str, salt: str) -> str:
    """SQL for the cell of digest k in subtable j: bits of the digest in a fingerprint (salt null), else a hash by the table's salt."""
    return f"if({salt} IS NULL, shiftrightunsigned(shiftleft({k}, {21 * j}), {64 - BITS}), pmod(xxhash64({k}, {salt} + {j}L), {w})) + {j} * {w}"


def items(of: str, k: str, g: str, w: str, salt: str) -> str:
    """SQL for the three cell entries of each element d of an array, its digest being k and its sign g."""
    entry = lambda j: f"named_struct('p', {_place(k, j, w, salt)}, 'c', {g}, 'k', {k}, 'h', xxhash64({k}, 77L))"
    return f"flatten(transform({of}, d -> array({entry(0)}, {entry(1)}, {entry(2)})))"


def table_of(entries: str) -> str:
    """SQL for the cells, by ascending place, that an array of entries adds up to; empty cells are left out."""
    add = "named_struct('p', a.p, 'c', a.c + x.c, 'k', a.k ^ x.k, 'h', a.h ^ x.h)"
    end = "coalesce(try_element_at(st, j + 2), size(z) + 1)"
    cell = f"if({end} = i + 1, element_at(z, i), aggregate(slice(z, i, {end} - i), named_struct('p', element_at(z, i).p, 'c', 0, 'k', 0L, 'h', 0L), (a, x) -> {add}))"
    cells = f"filter(transform(st, (i, j) -> {cell}), c -> c.c <> 0 OR c.k <> 0L OR c.h <> 0L)"
    starts = "filter(sequence(1, size(z)), i -> i = 1 OR element_at(z, i).p <> element_at(z, i - 1).p)"
    return named(f"sort_array({entries})", "z", f"if(size(z) = 0, z, {named(starts, 'st', cells)})")


def turned(x: str, bits: int) -> str:
    return f"(shiftleft({x}, {bits}) | shiftrightunsigned({x}, {64 - bits}))" if bits else x


def sketch(u: str) -> str:
    """SQL for the sketch of an array of digests, the same as table_of(items(...)). A subtable's cells are the runs of equal first bits in
    the sorted digests, turned so that the subtable's bits come first; turning and xor can change places."""

    def subtable(j: int) -> str:
        end = "coalesce(try_element_at(st, n + 2), size(z) + 1)"
        back = lambda x: turned(x, (64 - 21 * j) % 64)
        fold = lambda of: f"aggregate(slice(z, i, {end} - i), 0L, (a, x) -> a ^ {of})"
        cell = f"named_struct('p', shiftrightunsigned(element_at(z, i), {64 - BITS}) + {j * BASE}L, 'c', {end} - i, 'k', {named(fold('x'), 'k', back('k'))}, 'h', {fold(f'xxhash64({back("x")}, 77L)')})"
        starts = f"filter(sequence(1, size(z)), i -> i = 1 OR shiftright(element_at(z, i), {64 - BITS}) <> shiftright(element_at(z, i - 1), {64 - BITS}))"
        return named(f"sort_array(transform({u}, d -> {turned('d', 21 * j)}))", "z", named(f"if(size(z) = 0, cast(array() as array<int>), {starts})", "st", f"array_sort(transform(st, (i, n) -> {cell}), (x, y) -> cast(x.p - y.p as int))"))

    return f"concat({subtable(0)}, {subtable(1)}, {subtable(2)})"


def minus(a: str, b: str) -> str:
    return table_of(f"concat({a}, transform({b}, x -> named_struct('p', x.p, 'c', -x.c, 'k', x.k, 'h', x.h)))")


FOUND = "array<struct<k:bigint,g:int>>"


def peel(cells: str, w: str, salt: str) -> str:
    """SQL for the digests (k, g) of a difference of sketches, g 1 for those of the first and -1 for those of the second; null if it does not
    peel. A round takes out all digests that are alone in some cell."""
    pure = "filter(s.t, c -> abs(c.c) = 1 AND c.h = xxhash64(c.k, 77L))"
    out = table_of(f"concat(s.t, {items('ps', 'd.k', '-d.g', w, salt)})")
    found = named(out, "t2", "named_struct('t', t2, 'found', concat(s.found, ps), 'done', size(t2) = 0)")
    alone = lambda g: f"transform(array_distinct(transform(filter(pure, c -> c.c = {g}), c -> c.k)), k -> named_struct('k', k, 'g', {g}))"  # noqa: E731  distinct by hash for longs, by comparison for structs
    found = named(f"concat({alone(1)}, {alone(-1)})", "ps", found)
    step = named(pure, "pure", f"if(size(pure) = 0, named_struct('t', s.t, 'found', s.found, 'done', true), {found})")
    zero = f"named_struct('t', cells, 'found', cast(array() as {FOUND}), 'done', size(cells) = 0)"
    return named(cells, "cells", f"aggregate(sequence(1, {ROUNDS}), {zero}, (s, x) -> if(s.done, s, {step}), s -> if(size(s.t) = 0, s.found, NULL))")


def alone(z: str) -> str:
    """SQL for the digests (k, g) of z, the sorted digests of two texts (those of the second with their lowest bit set), if one subtable of a
    large table tells them all: each is alone in its cell or meets its like, which cancels it, there. Else null."""
    cell = lambda i: f"shiftright(element_at(z, {i}), s)"
    single = f"filter(sequence(1, size(z)), i -> (i = 1 OR {cell('i')} <> {cell('i - 1')}) AND (i = size(z) OR {cell('i')} <> {cell('i + 1')}))"
    pairs = "size(filter(sequence(1, size(z)), i -> i < size(z) AND (element_at(z, i) ^ coalesce(try_element_at(z, i + 1), 0L)) = 1L))"
    found = f"if(size(si) + 2 * {pairs} = size(z), transform(si, i -> named_struct('k', element_at(z, i) & -2L, 'g', cast(1 - 2 * (element_at(z, i) & 1L) as int))), NULL)"
    body = named(f"50 - cast(ceil(log2(size(z) + 1)) as int)", "s", named(single, "si", found))
    return named(f"sort_array({z})", "z", f"if(size(z) = 0, cast(array() as {FOUND}), {body})")


def difference(a: str, b: str, fa: str, fb: str) -> str:
    """SQL for the digests (k, g) that only one of two texts has: from their sketches fa and fb, or, should those not peel, from larger and
    larger tables of their digests a and b: one subtable of about 16 000 cells a digest, then three that are peeled."""
    w, salt = "(4L * size(both) * shiftleft(1L, 2 * y))", "(100L * y)"
    signed = f"concat(transform({a}, d -> named_struct('k', d, 'g', 1)), transform({b}, d -> named_struct('k', d, 'g', -1)))"
    larger = named(w, "w", named(salt, "salt", peel(table_of(items("both", "d.k", "d.g", "w", "salt")), "w", "salt")))
    again = named(signed, "both", f"aggregate(sequence(1, {LARGER}), cast(NULL as {FOUND}), (g, y) -> if(g IS NOT NULL, g, {larger}))")
    both = f"concat({a}, transform({b}, d -> d | 1L))"
    return f"coalesce({peel(minus(fa, fb), f'{BASE}L', 'cast(NULL as bigint)')}, {alone(both)}, {again})"


def likeness(a: str, b: str, diff: str) -> str:
    """SQL for the Jaccard similarity of two texts' paragraph sets from their numbers and that of their differences."""
    size = f"(size({a}) + size({b}))"
    return f"if({size} = 0, 1D, ({size} - size({diff})) / ({size} + size({diff})))"


def text_form(cells: str, u: str) -> str:
    return f"concat(size({u}), ';', array_join(transform({cells}, c -> concat(c.p, ',', c.c, ',', hex(c.k), ',', hex(c.h))), ';'))"


def fingerprints(docs: DataFrame, cut: str = CUT) -> DataFrame:
    """doc_id, n_units, fingerprint of every row: equal texts have equal ones. Null text is empty and has no paragraph."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("u", F.expr(digests("text", cut))).withColumn("f", F.expr(sketch("u")))
    return out.select("doc_id", F.size("u").alias("n_units"), F.expr(text_form("f", "u")).alias("fingerprint"))


def _bucket(bounds: list[int], col: str) -> Column:
    """How many of the ascending bounds are at most the column, by binary search."""
    arr = f"array({', '.join(f'{b}L' for b in bounds)})" if bounds else "array(cast(null as bigint))"
    steps, mid = max(1, len(bounds).bit_length()), "cast((s.lo + s.hi) div 2 as int)"
    return F.expr(f"""aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(bounds)}), (s, x) -> if(s.lo < s.hi,
        if({arr}[{mid}] <= {col}, named_struct('lo', {mid} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid})), s), s -> s.lo)""")


def with_next(docs: DataFrame, of_text: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by ascending doc_id, of the first one after the last; and each column `name`
    of `of_text`, computed once a text, with next_`name`.

    Ids are cut into ranges at quantiles that are ids themselves; a range's first row is sent to the range before it as well, so
    each range finds all its neighbours alone, in one shuffle of the texts. Null ids come first; rows with one id follow by text hash."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LOWEST)).alias("o"))
    n = width(docs.sparkSession) * 4
    got = base.agg(F.percentile_approx("o", [i / n for i in range(1, n)], 10_000).alias("q"), F.min("o").alias("least"), F.count("*").alias("n")).first()
    least = got.least if got.least is not None else 0
    bounds = sorted({b for b in (got.q or []) if b > least})
    arr = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    placed = base.withColumn("b", _bucket(bounds, "o"))
    ghost = lambda b, wrap: F.struct(b.cast("int").alias("b"), F.lit(True).alias("ghost"), F.lit(wrap).alias("wrap"))
    places = F.array(
        F.struct(F.col("b").cast("int").alias("b"), F.lit(False).alias("ghost"), F.lit(0).alias("wrap")),
        F.when(F.array_contains(arr, F.col("o")), ghost(F.col("b") - 1, 1)),
        F.when(F.col("o") == least, ghost(F.lit(len(bounds)), 2)),
    )
    spread = placed.select("doc_id", "text", "o", F.inline(F.filter(places, lambda x: x.isNotNull())))
    w = Window.partitionBy("b").orderBy("wrap", "o", F.xxhash64("text"))
    spread = spread.repartition(width(docs.sparkSession), "b")
    for name, c in (of_text or {}).items():
        spread = spread.withColumn(name, c)
    names = ["text", *(of_text or {})]
    out = spread.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in names]).where("not ghost")
    return out.select("doc_id", *names, *[f"next_{c}" for c in names])


def compare_with_edits(docs: DataFrame, cut: str = CUT) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, removed, added of every row: a text against
    its edited version (second half replaced by the next document's start) and against the next document; removed and added are the
    digests of the paragraphs that only the text and only its edited version have, as peeling recovers them.

    Null text is empty; two texts without paragraphs are alike (1). Rows that repeat are each other's neighbours. An empty table gives
    no row; other columns are not read. A document's own lists are all the memory a row needs."""
    half = "cast(floor(length(text) / 2) as int)"
    d = with_next(docs, {"u": F.expr(digests("text", cut)), "f": F.expr(sketch("u"))}).withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))"))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "u", "f", "next_u", "next_f", F.expr(digests("edited", cut)).alias("ue")).withColumn("fe", F.expr(sketch("ue")))
    d = d.select("*", F.expr(difference("u", "ue", "f", "fe")).alias("de"), F.expr(difference("u", "next_u", "f", "next_f")).alias("dn"))
    only = lambda g: F.expr(f"transform(filter(de, x -> x.g = {g}), x -> x.k)")
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.expr(text_form("f", "u")).alias("fingerprint"),
        F.expr(text_form("fe", "ue")).alias("edited_fingerprint"),
        F.expr(likeness("u", "ue", "de")).alias("near_edited"),
        F.expr(likeness("u", "next_u", "dn")).alias("near_next"),
        only(1).alias("removed"),
        only(-1).alias("added"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents")).drop("removed", "added")
