"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import decontaminate, fingerprints, langid, linededup, minhash, packing, quality, substrings, tokens, urlrules

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega élan über".split()
DDL = "doc_id long, text string, lang string, source string, n_chars long, n_hit string, kept string, score string"


def made(n=60, seed=0):
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", ",", "."]) for _ in range(k))
    shared, long = "\n".join(line(9) for _ in range(5)), "\n".join(line(30) for _ in range(300))
    texts = []
    for i in range(n):
        t = "\n".join(line(rng.randint(3, 14)) for _ in range(rng.randint(1, 8)))
        if i % 6 == 1:
            t = t + "\n" + shared
        if i % 7 == 2 and texts:
            t = texts[rng.randrange(len(texts))] or ""
        if i % 7 == 4 and texts:
            w = (texts[rng.randrange(len(texts))] or "x").split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        texts.append(t)
    texts[3:6] = [None, "", "  \n\n "]
    texts[8], texts[9], texts[10] = "one", "One two", "!!! ... ???"
    texts[20], texts[21] = long, long + "\nend"
    return [(i * 3 - 5, t, ["en", "fr", None][i % 3], "s", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ------------------------------------------------------------------ packing and tokens


def test_packing_round_trip(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing._path(packing.TOKENIZER))
    got = packing.pack(docs, length=64, with_ids=True).collect()
    for doc, text, *_ in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == ids.tobytes() and all(r.doc_tokens == len(ids) for r in pieces)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
    full: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert full.get(r.sequence_id, 0) == r.offset
        full[r.sequence_id] = r.offset + r.length
    assert sorted(full) == list(range(len(full))) and all(n == 64 for k, n in full.items() if k < len(full) - 1)
    assert packing.pack(empty).count() == 0


def test_pieces_are_what_the_tokenizers_give(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    odd = ["", "a  b ", "don't, won't!", "x\n\ny \n z\n", "12,3 ...wow!! |", "×÷ <|endoftext|> ok", "<|startoftext|>a", "a\tb", "中文 Σ ς", "İ é", "\u00a0x"]
    odd += ["".join(rng.choice("aBé1 \n,'st<|.ß") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    word, byte = (Tokenizer.from_file(packing._path(n)) for n in (tokens.TOKENIZER, packing.TOKENIZER))
    got = by_id(tokens.count_tokens(df))
    for i, t in enumerate(odd):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(word.encode(t, add_special_tokens=False).ids), len(t.encode())), t
    ids = {r.doc_id: bytes(r.ids) for r in packing.token_ids(df).collect()}
    for i, t in enumerate(odd):
        assert ids[i] == np.array([*byte.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes(), t


def test_token_counts_of_nulls_and_nothing(spark, docs, empty):
    got = by_id(tokens.count_tokens(docs, limit=100))
    assert (got[4].n_tokens, got[4].over_limit, got[55].over_limit) == (0, False, True)
    assert tokens.count_tokens(empty).count() == 0


# ------------------------------------------------------------------ decontamination


def brute_decontamination(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for doc, text, *_ in rows:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(10, len(b))
            own = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in own:
                    hit |= set(range(i, i + n))
                    names.add(str(item))
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_is_brute_force(spark, docs, rows, empty, monkeypatch):
    some = [(t or "").replace("\n", " / ").upper() for _, t, *_ in rows]
    items = [(1, some[0][5:160]), (2, some[20][100:900]), (10, "one"), (11, "one TWO"), (12, ""), (13, None), (14, "Never seen words in this order at all, not once here"), (15, some[1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_decontamination(rows, items)
    for limit in (decontaminate.BLOCK_TEXT, 400):  # the second cuts the benchmark into several blocks
        monkeypatch.setattr(decontaminate, "BLOCK_TEXT", limit)
        got = by_id(decontaminate.decontaminate(docs, bench))
        assert {k: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for k, r in got.items()} == want
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, v in want.items() if not v[4]}
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


# ------------------------------------------------------------------ duplicates


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = {d: sets_of(t, k) for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_are_brute_force(docs, rows, k, percent):
    got = by_id(minhash.near_duplicates(docs, k, percent))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute_components(rows, k, percent)
    assert all(r.kept == (r.component_id == d) for d, r in got.items())


def test_near_copies_in_a_large_group_and_bystanders(spark):
    """Many near copies of one text, many documents that share half of it, and chains of small changes."""
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base, rows = fresh(60).split(), []
    for _ in range(80):
        w = list(base)
        w[rng.randrange(60)] = fresh(1)
        rows.append((len(rows), " ".join(w)))
    for _ in range(80):
        rows.append((len(rows), " ".join(base[:30]) + " " + fresh(30)))
    w = fresh(60).split()
    for i in range(0, 30, 2):
        w[i] = fresh(1)
        rows.append((len(rows), " ".join(w)))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))
    assert {d: r.component_id for d, r in got.items()} == {d: c for d, (_, c) in brute_components(rows, 3, 85).items()}


def test_near_duplicates_edges(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, None), (4, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 1, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True)]


def test_estimate_is_near_the_truth():
    rng, k = np.random.default_rng(0), 384
    for shared in (0, 500, 900):
        a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        b = np.concatenate([a[:shared], rng.integers(1, 2**63, 1000 - shared).astype(np.uint64)])
        ra, rb = (minhash.registers(np.zeros(1000, int), np.sort(x), 1, k) for x in (a, b))
        n = np.array([1000.0])
        assert abs(minhash.estimate(ra, rb, n, n)[0] - shared / (2000 - shared)) < 0.1


def brute_windows(seqs, n):
    """Positions covered by windows of n items that start earlier, by ascending id."""
    seen, gone = set(), {}
    for d, w in sorted(seqs.items()):
        cover = set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            cover |= set(range(i, i + n)) if g in seen else set()
            seen.add(g)
        gone[d] = cover
    return gone


def test_removed_substrings_are_brute_force(docs, rows, empty):
    seqs = {d: (t or "").encode().split() for d, t, *_ in rows}
    for n in (20, 6):
        gone = brute_windows(seqs, n)
        got = by_id(substrings.remove_repeats(docs, n, with_spans=True))
        for d, w in seqs.items():
            kept = b" ".join(x for i, x in enumerate(w) if i not in gone[d])
            assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone[d]), hashlib.sha256(kept).hexdigest()), (n, d)
            assert [i for a, b in got[d].spans for i in range(a, b)] == sorted(gone[d]), (n, d)
    assert substrings.remove_repeats(empty).count() == 0


def test_suffix_automaton_finds_first_positions():
    rng = random.Random(2)
    for _ in range(30):
        parts = [[rng.choice("ab") for _ in range(rng.randint(1, 15))] for _ in range(4)]
        auto, at, starts = substrings.SuffixAutomaton(), 0, []
        for p in parts:
            auto.add(p, at)
            starts.append(at)
            at += len(p)
        q = [rng.choice("ab") for _ in range(20)]
        want = {}
        for i in range(18):
            hits = [s + j + 2 for s, p in zip(starts, parts, strict=True) for j in range(len(p) - 2) if p[j : j + 3] == q[i : i + 3]]
            if hits:
                want[i] = min(hits)
        assert dict(auto.windows(q, 3)) == want


def test_removed_lines_are_brute_force(docs, rows, empty):
    seqs = {d: (t.split("\n") if t is not None else []) for d, t, *_ in rows}
    for n in (3, 2):
        gone = brute_windows(seqs, n)
        out = linededup.dedup_lines(docs, n)
        got = by_id(out)
        assert out.columns[: len(docs.columns)] == docs.columns
        for d, t, *_ in rows:
            kept = "\n".join(x for i, x in enumerate(seqs[d]) if i not in gone[d]) if t is not None else None
            assert (got[d].n_lines, got[d].n_removed, got[d].text) == (len(seqs[d]), len(gone[d]), kept), (n, d)
            assert bool(got[d].copy_depth) == bool(gone[d])
    assert linededup.dedup_lines(empty).count() == 0


# ------------------------------------------------------------------ language, quality, fingerprints, URLs


def test_language_id(spark, empty):
    rng = random.Random(0)
    own = {"en": "the of and to in is that for was with", "de": "der die und das ist nicht mit für auf ein", "es": "el la de que los por con una para está"}
    rows = [(i, " ".join(rng.choice(own[lang].split()) for _ in range(rng.randint(5, 60))), lang) for i, lang in enumerate(["en", "de", "es"] * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "en"), (902, "日本語の文章です", None), (903, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 5 <> 0"))
    got = by_id(langid.predict(docs, model))
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i % 5 == 0]) > 0.95
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (900, 901, 903)) and got[902].rejected
    assert {r.doc_id for r in langid.accepted(docs, model).collect()} == {i for i, r in got.items() if not r.rejected} >= {i for i, *_ in rows}
    none = langid.predict(docs, langid.fit(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"} and langid.predict(empty, model).count() == 0


def test_quality(spark, empty):
    rng = random.Random(0)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 300)))
    bad = lambda: good() + " " + " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(30))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(160)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(160)] + [(5, None), (900, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 1"))
    got = by_id(quality.score(docs, model))
    assert np.mean([(got[i].score >= 0.5) == (i % 4 != 0) for i in range(160) if i % 3 == 1]) > 0.9
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    assert quality.score(empty, model).count() == 0 and quality.score(docs, quality.fit(docs, labels.limit(0))).count() == 162


def test_every_byte_counts_in_the_network():
    texts = ["a" * 1000, "a" * 1000 + "Z", "", "Z" + "a" * 5, "ab"]
    from corpusmill.llm.common import utf8

    data, offs = utf8(pa.array(texts))
    codes, first = quality.grid(data, offs)
    assert [int((codes[a:b, : quality.CHUNK] < 256).sum()) for a, b in zip(first[:-1], first[1:], strict=True)] == [len(t) for t in texts]
    assert bytes(codes[0, quality.CHUNK :].astype(np.uint8)) == b"a" * (quality.SPAN - 1) and (codes[first[1] - 1, quality.CHUNK :] == 256).all()


def units(text):
    out = set()
    for p in re.split(r"\n+|(?<=[^\w\s])\s+|(?<=_)\s+|(?<=[\u3002\uff01\uff1f\uff1b])", text or ""):
        out |= {p} if p else set()
    return out


def test_fingerprints(docs, rows, empty):
    got = by_id(fingerprints.compare_with_edits(docs))
    order = sorted(rows)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (d, t, *_), (_, nxt, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].near_edited == pytest.approx(like(units(t), units(edited)), abs=1e-9), d
        assert got[d].near_next == pytest.approx(like(units(t), units(nxt)), abs=1e-9), d
        assert (len(got[d].removed), len(got[d].added)) == (len(units(t) - units(edited)), len(units(edited) - units(t)))
    same: dict = {}
    for d, t, *_ in rows:
        assert same.setdefault(t or "", got[d].fingerprint) == got[d].fingerprint
    assert fingerprints.compare_with_edits(empty).count() == 0


def test_next_document_of_one_and_of_ties(spark):
    one = fingerprints.with_next(spark.createDataFrame([(7, "x")], "doc_id long, text string")).collect()
    assert [(r.text, r.next_text) for r in one] == [("x", "x")]
    rows = [(i // 2, f"t{i}") for i in range(40)] + [(None, "n")]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == sorted(t for _, t in rows) == sorted(r.next_text for r in got)


def test_url_filter(spark):
    rng = random.Random(0)
    urls = [f"https://{'ads' if i % 4 == 0 else 'news'}.site.example.org/{'track' if i % 8 == 0 else 'p'}/{i}" for i in range(400)]
    odd = [None, "no scheme", "http://A.Example.NET/en/x?q", "http://example.net/en", "http://xnet/", "https://a.example.com/de/", "http://b.org/fr/1", "x://", "http://evil.net/", "http://evil.net"]
    pages = spark.createDataFrame([*enumerate(urls), *enumerate(odd, 1000)], "page_id long, url string")
    marked = spark.createDataFrame([(u, i % 4 == 0) for i, u in enumerate(urls) if i % 3], "url string, bad boolean")
    got = {r.page_id: r for r in urlrules.filter_urls(pages, marked).collect()}
    assert len(got) == len(urls) + len(odd)
    assert all(got[i].verdict == ("block" if i % 4 == 0 else "allow") and got[i].rule is None for i in range(400))
    want = [("", "", None), ("", "", None), ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/en", "net/"), ("xnet", "/", None), ("a.example.com", "/de/", "example.com/de/"), ("b.org", "/fr/1", "org/fr/"), ("", "", None), ("evil.net", "/", "net/"), ("evil.net", "", None)]
    assert [(got[1000 + i].host, got[1000 + i].path, got[1000 + i].rule) for i in range(len(odd))] == want
    assert got[1002].verdict == got[1006].verdict == "allow" and got[1003].verdict == got[1005].verdict == "block"
    none = urlrules.filter_urls(pages, marked.limit(0)).collect()
    assert len(none) == len(got) and urlrules.filter_urls(pages.limit(0), marked).count() == 0


# ------------------------------------------------------------------ pipeline


def test_stages(spark, tmp_path):
    rows = [r[:5] for r in made(40, 5)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/documents.parquet")
    quote = " ".join((rows[0][1] or "").split()[:12])
    spark.createDataFrame([(1, quote), (2, "nothing of this kind occurs anywhere in these documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        if name == "near_dedup":
            want = {d for d, (_, c) in brute_components([tuple(r) for r in before.collect()], 5, 80).items() if d == c}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "decontamination":
            bad = brute_decontamination([tuple(r) for r in before.collect()], [(1, quote)])
            assert {r.doc_id for r in docs.collect()} == {d for d, v in bad.items() if not v[4]}
    assert len(rows) > sizes[0] >= sizes[1] >= sizes[2] > sizes[3] > 0
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert docs.where(F.length("text") != F.col("n_chars")).isEmpty()
