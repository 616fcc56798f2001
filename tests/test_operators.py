import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking, dedup, graph, retrieval, sampling, stats, tables
from corpusmill.sources import files
from corpusmill.streaming import progress


def test_windows_stop_at_the_end(spark):
    df = spark.createDataFrame([(7, list("abcdefg")), (8, []), (9, list("ab"))], "d long, t array<string>")
    got = {(r.d, r.chunk_no): r.tokens for r in chunking.windows(df, "d", F.col("t"), 4, 1).collect()}
    assert got == {(7, 0): list("abcd"), (7, 1): list("defg"), (9, 0): list("ab")}


def test_sentence_packing():
    text = " ".join(f"Sentence number {i} has some words." for i in range(30))
    chunks = chunking.pack_sentences(text, 40, 8, 10)
    assert all(chunking.count_tokens(c) <= 48 for c in chunks) and len(chunks) > 4
    short = "Hi. Word " + "word " * 50 + "end. Bye."
    assert chunking.pack_sentences(short, 20, 4, 5) and "Hi." not in chunking.pack_sentences(short, 20, 4, 5)[0]
    assert chunking.pack_sentences(short, 20, 4, 5, lossless=True)[0] == "Hi."


def test_sections():
    p = chunking.parse("A Title  Someone  Abstract We do things. 1 Introduction It starts. 2. Design It goes on. 3 Evaluation It ends.")
    assert [s[1] for s in p["sections"]] == ["Introduction", "Design", "Evaluation"] and p["abstract"] == "We do things."
    assert p["confidence"] == round(0.55 + 0.45 * 3 / 8, 3)
    assert chunking.parse("no headings at all")["sections"] == []
    assert chunking.parse("I. OVERVIEW The text. II. RESULTS More text.")["sections"][0][:2] == ("I", "Overview")


def test_token_blocks_cross_rows(spark):
    rows = [(i, [f"{i}.{j}" for j in range(i % 5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "o long, t array<string>")
    flat = [x for _, t in rows for x in [*t, "E"]]
    got = {r.block: r.tokens for r in chunking.token_blocks(df, "o", "t", 7, "E", keep_rest=True).collect()}
    assert [x for b in sorted(got) for x in got[b]] == flat
    assert chunking.token_blocks(df, "o", "t", 7, "E").count() == len(flat) // 7


def test_padding(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (1, [4])], "b int, ids array<int>")
    got = chunking.padded(df, "b", "ids", 0).where("size(ids) = 1").first()
    assert (got.input_ids, got.attention_mask, got.labels) == ([4, 0, 0], [1, 0, 0], [4, -100, -100])


def test_first_come_keeps_what_a_rejected_row_would_reject(spark):
    rng = random.Random(5)
    for _ in range(3):
        n, pairs = 25, {tuple(sorted(rng.sample(range(25), 2))) for _ in range(20)}
        kept = set()
        for i in range(n):
            if not any((a in kept and b == i) or (b in kept and a == i) for a, b in pairs):
                kept.add(i)
        rows, edges = spark.range(n).withColumnRenamed("id", "k"), spark.createDataFrame(sorted(pairs), "a long, b long")
        assert {r.k for r in graph.first_come(rows, edges, "k", "k").where("kept").collect()} == kept


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 14] + [(40, 40)], "a long, b long")
    got = {r.node: r.component for r in graph.connected(e, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(15)}, **{i: 15 for i in range(15, 31)}, 40: 40}


def test_near_dedup_by_simhash(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "a", base), (2, "a", base + " extra"), (3, "b", base), (4, "a", "something else entirely here"), (5, "a", ""), (6, "a", "of the")]
    got = {r.d: (r.kept, r.kept_by) for r in dedup.near(spark.createDataFrame(rows, "d long, s string, x string"), "d", "x", ["s"], "d").collect()}
    assert got[1] == (True, None) and got[3] == (True, None) and got[4] == (True, None)
    assert got[5][0] and got[6] == (False, 5)


def test_harvest_gates(spark):
    rows = [(1, "a", "T one", "10/x", None), (2, "b", "T two", "10/x", "u"), (3, "c", "T-One", "", "u"), (4, "d", "T four", None, "u"), (5, "e", "Known", None, "u"), (6, "f", "New", None, "u"), (7, "g", "T FOUR", "10/y", "u"), (8, "h", "T eight", "10/y", "u")]
    p = spark.createDataFrame(rows, "seq long, source_id string, title string, doi string, pdf_url string")
    out = dedup.harvest(p, spark.createDataFrame([("known",)], "norm_title string"), spark.createDataFrame([("f",)], "source_id string"))
    assert [r.outcome for r in out.orderBy("seq").collect()] == ["no_pdf", "duplicate_doi", "duplicate_title", "kept", "duplicate_title", "resumed", "duplicate_title", "duplicate_doi"]


def test_title_index(spark):
    rows = [(1, "A b", 3, 100, ["x", "y"]), (2, "a B!", 3, 102, ["x", "y"]), (3, "a b", 9, 100, ["x", "y"]), (4, "a b", None, None, None), (5, "?", 1, 1, [])]
    got = dedup.title_index(spark.createDataFrame(rows, "seq long, raw_title string, page_count int, size_bytes long, tokens array<string>"))
    assert [r.status for r in got.orderBy("seq").collect()] == ["new", "strong", "weak", "strong", "extract_failed"]


def test_cosine_pairs_meet_across_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 8))
    v[7], v[30] = v[3] * 2, v[3] + 0.01
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if u[i] @ u[j] > 0.6}
    assert {(r.a, r.b) for r in dedup.cosine_pairs(df, "id", "v", 0.6, block=9).collect()} == want


def test_fusion_and_recall(spark):
    x = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, item_id long, rank int")
    y = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, item_id long, rank int")
    got = retrieval.fuse([x, y]).orderBy("rank").collect()
    assert [r.item_id for r in got] == [11, 10, 12] and math.isclose(got[0].score, round(1 / 61 + 1 / 62, 9))
    r = retrieval.recall(x, spark.createDataFrame([(1, 11), (2, 5)], "query_id long, item_id long"), (1, 4)).first()
    assert (r.n, r.recall_1, r.recall_4, r.mrr) == (2, 0.0, 0.5, 0.25)


def test_group_selection_skips_and_goes_on(spark):
    rng = random.Random(1)
    for target in (0, 3, 37, 120, 10_000):
        rows = [(f"g{i}", rng.choice([1, 2, 5, 30, 60]), f"{rng.randrange(16**6):06x}") for i in range(120)]
        total, want = 0, set()
        for g, s, _ in sorted(rows, key=lambda r: r[2]):
            if total + s <= target:
                want.add(g)
                total += s
        got = sampling.select_groups(spark.createDataFrame(rows, "grp string, size long, h string"), target)
        assert {r.grp for r in got.collect()} == want


def test_mixing_counts():
    assert sampling.feasible({"hpn": 3, "rag": 1, "generic": 1}) == {"hpn": 3, "rag": 1, "generic": 1}
    assert sampling.feasible({"hpn": 0, "rag": 9, "generic": 9}) == {"hpn": 0, "rag": 0, "generic": 0}
    assert sampling.largest_remainder([1.5, 1.5, 1.0], 4) == [2, 1, 1]


def test_wilcoxon_matches_enumeration():
    rng = np.random.default_rng(3)
    for n in (3, 6, 10):
        d = rng.permutation(np.arange(1, n + 1)) * rng.choice([-1, 1], n) * 1.0
        r = stats.ranks(np.abs(d))
        seen = min(r[d > 0].sum(), r[d < 0].sum())
        all_ = [sum(r[i] for i in range(n) if m >> i & 1) for m in range(2**n)]
        assert math.isclose(stats.wilcoxon(d), min(1.0, 2 * sum(v <= seen for v in all_) / 2**n))
    assert stats.wilcoxon(np.zeros(5)) == 1.0


def test_false_discovery(spark):
    p = [0.001, 0.01, 0.03, 0.04, 0.9, None]
    df = spark.createDataFrame(list(enumerate(p)), "k long, p double")
    got = [r.p_bh for r in stats.benjamini_hochberg(df, "p", ["k"]).orderBy("k").collect()]
    assert np.allclose(got[:5], [0.005, 0.025, 0.05, 0.05, 0.9]) and got[5] is None


def test_krippendorff_published_example(spark):
    a = [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None]
    b = [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3]
    c = [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None]
    d = [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None]
    rows = [(u, float(v)) for r in (a, b, c, d) for u, v in enumerate(r) if v is not None]
    assert abs(stats.krippendorff(spark.createDataFrame(rows, "u long, v double"), "u", "v").first().alpha - 0.849) < 0.001


def test_agreement_of_equal_and_opposed_raters(spark):
    df = spark.createDataFrame([(float(i % 5), float(i % 5), float(4 - i % 5)) for i in range(50)], "a double, b double, c double")
    same, other = stats.agreement(df, "a", "b").first(), stats.agreement(df, "a", "c").first()
    assert (same.kappa, same.pearson, other.spearman) == (1.0, 1.0, -1.0)
    assert stats.kendall(df, "a", "b").first().tau_b == 1.0 and stats.kendall(df, "a", "c").first().tau_b == -1.0


def test_resampling_and_rasch():
    rng = np.random.default_rng(1)
    total, n = rng.normal(5, 1, 40) * 3, np.full(40, 3.0)
    lo, hi = stats.cluster_interval(total, n, 500)
    assert lo < total.sum() / n.sum() < hi
    assert stats.sign_flip(total, n, resamples=500) < 0.01 < stats.sign_flip(total - total.mean(), n, resamples=500)
    right = np.array([[1, 1, 1, 0], [1, 1, 0, 0], [1, 0, 0, 0], [1, 1, 1, 1]], float)
    a, d = stats.rasch(right)
    assert list(np.argsort(a)) == [2, 1, 0, 3] and list(np.argsort(d)) == [0, 1, 2, 3]
    assert stats.exact_spearman_p(np.arange(5.0), np.arange(5.0)) == pytest.approx(2 / 120)


def test_rejection_order(spark):
    long = " ".join(["fiber switch routing latency network"] * 20)
    base = {"system": "s", "question": "q", "response": long, "category": "c", "source_split": "hpn", "paper_title": "P", "evidence_text": long, "n_evidence": 1}
    cases = [({}, ""), ({"system": " "}, "missing_required_fields"), ({"source_split": "rag"}, "bad_question_format"), ({"n_evidence": 0}, "missing_evidence"), ({"response": "short"}, "response_too_short"), ({"response": long * 5 + " x"}, "response_too_long"), ({"evidence_text": "zebra"}, "low_evidence_overlap"), ({"paper_title": "Unknown"}, "unknown_paper_title")]
    cases += [({"system": "\t\n"}, "missing_required_fields"), ({"evidence_text": long + " Table of Contents"}, "low_quality_front_matter"), ({"evidence_text": long + " permission to make digital copies"}, "")]
    cases += [({"response": long + " I do not have access"}, "assistant_meta_language"), ({"response": long + " i cannot say"}, ""), ({"question": "References  1"}, "low_quality_front_matter")]
    df = spark.createDataFrame([{**base, **c, "i": i} for i, (c, _) in enumerate(cases)])
    assert [r.reason for r in tables.reject_reason(df).orderBy("i").collect()] == [w for _, w in cases]


def test_checked_join_and_islands(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, 5)], "k long, v long")
    with pytest.raises(ValueError):
        tables.one_to_one(a, b, ["k"])
    assert not tables.same_keys(a, b, ["k"])
    x = spark.createDataFrame([(1, i, i not in (3, 6)) for i in range(8)], "g long, o long, f boolean")
    assert sorted((r["first"], r["last"], r.n) for r in tables.islands(x, ["g"], "o", "f").collect()) == [(0, 2, 3), (4, 5, 2), (7, 7, 1)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert files.write_jsonl(df, f"{tmp_path}/x") == 2
    assert sorted(map(tuple, files.jsonl(spark, f"{tmp_path}/x", "k long, v string").collect())) == [(1, "a"), (2, None)]
    assert files.jsonl(spark, f"{tmp_path}/none", "k long").count() == 0
    (tmp_path / "c.json").write_text('["one", {"text": " two "}, " "]')
    assert [tuple(r) for r in files.corpus(spark, f"{tmp_path}/c.json", 1).orderBy("doc_id").collect()] == [(1, "one"), (2, "two")]
    (tmp_path / "b.json").write_text('{"metadata": {}, "questions": [{"id": "q1", "category": "c", "keywords": ["k"]}]}')
    assert files.benchmark(spark, f"{tmp_path}/b.json").first().keywords == ["k"]
    assert files.append_new(df, f"{tmp_path}/p", "k").count() == 2
    assert files.append_new(df.union(spark.createDataFrame([(3, "c")], "k long, v string")), f"{tmp_path}/p", "k").count() == 1


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, s long, v string")
    df.write.parquet(f"{tmp_path}/in")
    q = progress.latest(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", "s").writeStream.outputMode("complete").format("memory").queryName("latest_").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("latest_").collect())) == [(1, 2, "b"), (2, 1, "c")]


def test_quotes_and_titles(spark):
    from corpusmill.operators import evidence

    text = " ".join(f"word{i}" for i in range(200))
    assert evidence.closest("word5  word6", text) > 0.3 and evidence.closest("WORD5", text) == evidence.closest("nothing alike", "zzz") == evidence.closest("", text) == 0.0
    assert evidence.closest("abc def", "x abc dxf") == pytest.approx(2 * 6 / 14)
    best, score = evidence.repair(" ".join(f"word{i}" for i in range(50, 70)), text)
    assert best.startswith("word45 word46") and len(best) <= 240 and score == 20 / 25
    odd = " ".join(f"w{i}" for i in range(30)) + " target words here " + " ".join(f"v{i}" for i in range(31))
    assert evidence.repair("target words here v0 v1 v2 v3 v4 v5 v6 v7 v8", odd)[0].split()[0] == "w17"  # every window is tried
    assert evidence.repair("none of these", text) == ("", 0.0)
    a = spark.createDataFrame([(1, "Deep learning for optical networks"), (2, "A survey of optical switching in data centers today"), (3, "Unrelated")], "l_id long, title string")
    b = spark.createDataFrame([(10, "deep LEARNING, for optical networks"), (11, "A survey of optical switching in data centers"), (12, "optical"), (13, None)], "r_id long, title string")
    got = {r.l_id: (r.r_id, r.exact) for r in evidence.fuzzy_titles(a, b, 0.8).collect()}
    assert got == {1: (10, True), 2: (11, False)}


def test_small_expressions(spark):
    from corpusmill.operators import evidence

    df = spark.createDataFrame([("WDM and OWDM, WDM2", ["u", "v"])], "x string, a array<string>")
    assert df.select(evidence.expand_acronyms(F.col("x"), {"WDM": "wavelength WDM", "OWDM": "o"})).first()[0] == "WDM wavelength WDM and OWDM o, WDM2"
    chunks = spark.createDataFrame([([("T", "2.1", "Design", "u"), ("x" * 81, None, None, "v"), ("U", "", "Abstract", "w")],)], "c array<struct<title:string,number:string,heading:string,text:string>>")
    want = f"Excerpts:\n\n[1] Paper: 'T' | Section: 2.1 Design\nu\n\n[2] Paper: '{'x' * 77}…' | Section: Body\nv\n\n[3] Paper: 'U' | Section: Abstract\nw\n\nQuestion: q?"
    assert chunks.select(evidence.user_turn(F.col("c"), F.lit("q?"))).first()[0] == want
    label = lambda t, n, h: df.select(evidence.chunk_label(F.lit(t), F.lit(n), F.lit(h))).first()[0]
    assert (label("T", "2.1", "Design"), label("y" * 41, "", "Abstract")) == ("T §2.1 Design", "y" * 40 + "… §Abstract")
    blocked = "https://ieeexplore.ieee.org/x.pdf"
    rows = [[("", "repository"), (blocked, "journal"), ("https://arxiv.org/r", None)], [(blocked, "journal")], [(blocked, "journal"), (blocked + "2", "repository")], [("j", "journal"), ("r", "repository")], []]
    places = spark.createDataFrame([(r,) for r in rows], "p array<struct<pdf_url:string,type:string>>")
    assert [r[0] for r in places.select(evidence.pdf_url(F.col("p"))).collect()] == ["https://arxiv.org/r", blocked, blocked + "2", "j", None]
    rows = [["https://x", "http://CreativeCommons.org/licenses/BY-nc/4.0"], ["https://www.elsevier.com/tdm/x", "https://acm.org"], ["https://www.acm.org/y"], ["https://creativecommons.org/publicdomain/zero"], [], [None, ""]]
    urls = spark.createDataFrame([(r,) for r in rows], "u array<string>")
    assert [r[0] for r in urls.select(evidence.licence(F.col("u"))).collect()] == ["cc-by-nc", "publisher-tdm (elsevier)", "publisher-copyright (acm)", "publisher-specific", "not-stated", "not-stated"]
    ranked = spark.createDataFrame([(1, i, "q", "t" * i) for i in range(6)], "query_id long, item_id long, query string, text string")
    assert [r.item_id for r in evidence.rerank(ranked, lambda q, x: x.str.len(), 2).orderBy("rank").collect()] == [5, 4]
    checked = evidence.first_failure(ranked, [("a", F.col("item_id") > 0), ("b", F.col("item_id") > 3)])
    assert [r.failed for r in checked.orderBy("item_id").collect()] == ["a", "b", "b", "b", "", ""]
