"""Queries and stages do the whole job: inputs on which a coarser paragraph, a floor or a subset of the rows loses results."""

import random
import re
import time
import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from corpusmill.llm import common, fingerprints, langid, linededup, minhash, packing, registry, substrings, urlrules

WORDS = "one two three four six seven eight nine zehn hundert mille дом мир 語 文 x9 7".split()


def paragraphs(text):
    """Lines, cut after every mark; the texts here have no other marks than these."""
    return {p for p in re.split(r"\n+|(?<=[.,;!?])\s+|(?<=[。！？；])", text or "") if p}


def test_op6_cuts_after_every_mark(spark, tmp_path):
    rng = random.Random(4)
    sentence = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 9))) + rng.choice([". ", "! ", "? ", ", ", "; ", "。", "！"])
    rows = [(i, "".join(sentence() for _ in range(rng.randint(8, 60)))) for i in range(40)] + [(40, None), (41, ""), (42, rng.choice(WORDS)), (43, "a. a. a. b"), (44, "\n\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op6_fingerprints(spark, str(tmp_path)).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert len(got) == len(rows)
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[d].near_edited == pytest.approx(like(paragraphs(t), paragraphs(edited)), abs=1e-9), d
        assert got[d].near_next == pytest.approx(like(paragraphs(t), paragraphs(nxt)), abs=1e-9), d
        assert got[d].near_edited > 0 or d >= 40, d


def brute_line_copies(rows, min_lines, min_chars):
    """What is left of each text without the runs that also start earlier: min_lines or more lines, min_chars characters, or a whole text."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        w, gone = t.split("\n"), set()
        for i in range(len(w)):
            for k in range(1, min(min_lines, len(w) - i) + 1):
                run, n = tuple(w[i : i + k]), sum(len(x.strip()) for x in w[i : i + k])
                if run in seen and (k == min_lines or n >= min_chars or (n and k == len(w))):
                    gone |= set(range(i, i + k))
                seen.add(run)
        out[d] = [x for j, x in enumerate(w) if j not in gone]
    return out


def test_pipeline_line_dedup_takes_long_lines_and_short_documents(spark):
    rng = random.Random(6)
    line = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(k))
    long, pair, short, three = line(20), line(6) + "\n" + line(6), "a short one", "p\nq\nr"
    rows = [(0, f"{line(4)}\n{long}\nend"), (1, f"new {line(3)}\n{long}\nend"), (2, long), (3, short), (4, short), (5, f"{short}\nand more"), (6, f"{pair}\n{line(3)}")]
    rows += [(7, f"{line(2)}\n{pair}"), (8, pair), (9, three), (10, f"{line(2)}\n{three}\n\n{long}"), (11, ""), (12, ""), (13, "a\n\nb\n\n"), (14, f"{long}\n{long}"), (15, "two\nlines"), (16, "two\nlines")]
    want = brute_line_copies(rows, linededup.MIN_LINES, linededup.MIN_CHARS)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r for r in linededup.dedup_lines(docs, min_chars=linededup.MIN_CHARS).collect()}
    assert {d: (r.text, r.n_removed, bool(r.copy_depth)) for d, r in got.items()} == {d: ("\n".join(want[d]), len(t.split("\n")) - len(want[d]), len(t.split("\n")) > len(want[d])) for d, t in rows}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {d: "\n".join(x) for d, x in want.items() if x}
    assert {2, 4, 8, 14, 16}.isdisjoint(d for d, x in want.items() if x) and want[1] != dict(rows)[1].split("\n")


def test_components_do_not_end_early(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        common.components(edges, rounds=1)
    assert {r.root for r in common.components(edges).collect()} == {0}


def test_pipeline_packing_returns_token_ids(spark):
    docs = spark.createDataFrame([(1, "one two three " * 900), (2, "four"), (3, None)], "doc_id long, text string")
    got = sorted(corpus_pipeline.packed(spark, docs, "").collect(), key=lambda r: (r.doc_id, r.start))
    for r in packing.token_ids(docs).collect():
        assert b"".join(bytes(x.ids) for x in got if x.doc_id == r.doc_id) == bytes(r.ids)
    assert len(got) > 3 and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)


def test_spent_tables_and_shuffles_are_deleted(spark, tmp_path):
    """What a step stores for itself goes when the step is over; what its result reads stays, and so do the inputs."""
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    rng = random.Random(9)
    line = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(k))
    run = [line(8) for _ in range(4)]
    rows = [(i, "\n".join([line(9), *run[: 3 + i % 2], line(9)] if i % 3 else [line(12), line(9)]), "en", "s") for i in range(30)]
    rows += [(100 + i, rows[i][1].replace("\n", "\nx ", 1), "en", "s") for i in range(0, 30, 3)] + [(200, None, "en", "s")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this kind occurs anywhere in these documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def left(make):
        before = set(shared.iterdir())
        out = make()
        new = set(shared.iterdir()) - before
        return len(new), sorted(map(str, out.collect())), len(new - set(shared.iterdir()))

    for make in (lambda: linededup.dedup_lines(docs), lambda: minhash.near_duplicates(docs), lambda: minhash.one_of_each(docs), lambda: corpus_pipeline.run(spark, str(tmp_path))):
        n, got, gone = left(make)
        assert n == 1 and got and not gone
    assert docs.count() == len(rows)
    assert spark.conf.get(common._SPENT) == "false"
    with common.scratch(spark) as keep:
        a, b = common.stored(docs), keep(common.stored(docs))
    assert not Path(a.__dict__["_folder"]).exists() and b.count() == len(rows)
    common.discard(b, docs, None)
    assert not Path(b.inputFiles()[0].removeprefix("file:")).exists() and docs.count() == len(rows)
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = {tracker.shuffleStatuses().size()}
    common.stored(docs.groupBy("text").count())
    deadline = time.time() + 20
    while (n := tracker.shuffleStatuses().size()) not in before and time.time() < deadline:
        time.sleep(0.2)
    assert n in before


def test_texts_under_one_id_keep_what_repeats_nowhere(spark):
    """A doc_id that repeats with other texts: each text is judged as a document of its own."""
    rows = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nx"), (2, "p\nq\nr\ns"), (2, "p\nq\nr\ns"), (None, "a\nb\nc"), (3, "p\nq\nr")]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, rank string")
    got = sorted((r.doc_id or 0, r.text, r.rank) for r in linededup.dedup_lines(docs).collect())
    assert got == sorted([(0, "a\nb\nc", "k"), (1, "a\nb\nc\nd", "k"), (2, "x", "k"), (2, "p\nq\nr\ns", "k"), (2, "p\nq\nr\ns", "k"), (3, "", "k")])
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, words("a", 30)), (2, words("a", 25) + " x"), (2, words("b", 50)), (3, words("c", 10) + " " + words("b", 22))]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 30, 0), (2, 26, 25), (2, 50, 0), (3, 32, 22)]


def test_columns_with_the_operators_own_names(spark):
    rows = [(i, f"line {i}\n" + "one\ntwo\nthree", "en", i, i, i, i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, copies_ long, letters_ long, text_hash_ long, n_lines long")
    assert sorted(r.copies_ for r in linededup.dedup_lines(docs).collect()) == list(range(6))
    kept = langid.accepted(docs, langid.fit(docs))
    assert kept.columns == docs.columns and kept.count() == 6
    assert sorted(r.letters_ for r in minhash.one_of_each(docs).collect()) == list(range(6))


def test_rules_decide_where_labels_depend_on_tokens(spark):
    rng = random.Random(3)
    parts = "&".join(f"q{i}=1" for i in range(30))  # a template of thirty constant parts is one item, not 2 ** 30 sets
    urls = [f"https://h{i % 50}.example.org/{rng.choice('abc')}/{i}?{parts}" for i in range(300)] + [f"http://m{i}.farm.biz/casino/{i % 7}" for i in range(60)]
    bad = [rng.random() < 0.2 for _ in range(300)] + [rng.random() < 0.9 for _ in range(60)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(400, None), (401, "no mark casino"), (402, "http://new.farm.biz/x"), (403, "http://www.example.net/en/casino")]
    labelled = spark.createDataFrame(list(zip(urls, bad, strict=True)), "url string, bad boolean")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urlrules.filter_urls(pages, labelled).collect()}
    assert len(got) == len(rows) and got[402].verdict == "block" and got[402].mined and got[403].verdict == "allow" and got[400].verdict == got[401].verdict == "allow"
    assert all(got[i].verdict == "block" for i in range(300, 360)) and sum(got[i].verdict == "block" for i in range(300)) < 60
    none = spark.createDataFrame([(u, rng.random() < 0.3) for u in urls[:300]], "url string, bad boolean").select("url", "bad")
    assert {r.verdict for r in urlrules.filter_urls(pages.where("page_id < 300"), none.limit(0)).collect()} == {"allow"}


def test_registered_queries_keep_their_splits(spark, tmp_path):
    rng = random.Random(5)
    langs = {"en": "the cat and dog with house of", "fr": "le chat et chien avec maison où", "de": "der und hund mit haus über die"}
    rows = [(i, " ".join(rng.choice(langs[x].split()) for _ in range(40)), x) for i, x in enumerate([*langs] * 25)] + [(90, None, "en"), (91, "123 ...", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int("cat" in (t or "")), 0) for d, t, _ in rows if d % 4], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    q = registry.queries()
    got = {r.doc_id: r for r in q["op5_language_id"](spark, str(tmp_path)).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(got[d].lang_pred == x and 0 <= got[d].score <= 1 for d, _, x in rows[:75]) and got[90].lang_pred == got[91].lang_pred == "und"
    got = {r.doc_id: r for r in q["op7_quality"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for d, r in got.items())
    got = q["op3_packing"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows} and sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
    assert {r.doc_id: r.over_limit for r in q["op8_token_counts"](spark, str(tmp_path)).collect()} == {r[0]: False for r in rows}
    assert {r.doc_id for r in q["op9_near_duplicates"](spark, str(tmp_path)).collect() if r.kept} == {r[0] for r in rows}
