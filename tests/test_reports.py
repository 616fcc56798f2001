import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking, graph, records, reports


def test_title_and_authors():
    text = "A Study of Fast Networks  Ann Lee  Bob Ray  University of Somewhere  ABSTRACT We do."
    assert chunking.title_authors(text) == ("A Study of Fast Networks", "Ann Lee Bob Ray University of Somewhere")
    assert chunking.title_authors("") == ("Unknown", "Unknown")
    assert chunking.title_authors("ACM paper  x") == ("Unknown", "ACM paper x")
    long = "word " * 100
    title, authors = chunking.title_authors(long)
    assert title.endswith("...") and len(title) <= 223 and authors == "Unknown"


def test_normalized_papers(spark):
    text = "A Title Here  Ann Lee  Abstract We do things. 1 Introduction It starts. 2. Design It goes on. 3 Evaluation It ends."
    corpus = spark.createDataFrame([(0, text), (1, "nothing here"), (2, None)], "i long, text string")
    rows = {r.i: r for r in chunking.normalized(corpus, "i", "text", ["b.pdf", "A.pdf", "c.PDF", "x.txt"]).collect()}
    assert (rows[0].paper_id, rows[0].title, rows[0].authors, rows[0].source_pdf, rows[0].mapping) == ("paper_0001", "A Title Here", "Ann Lee", "A.pdf", "positional_sorted")
    assert [s["heading"] for s in rows[0].sections] == ["Introduction", "Design", "Evaluation"] and rows[0].method == "structured"
    assert rows[0].total_section_tokens == sum(s["n_tokens"] for s in rows[0].sections) and rows[1].method == "fallback" and rows[2].raw_char_count == 0
    few = chunking.normalized(corpus, "i", "text", ["b.pdf"])
    assert {r.mapping for r in few.collect()} == {"unavailable"}
    report = reports.normalization_report(few).first()
    assert (report.papers, report.structured, report.fallback, report.mapped) == (3, 1, 2, 0)


def test_retrieval_chunks(spark):
    text = "\n\n".join(" ".join(f"Sentence {i} of paragraph {p} has words." for i in range(6)) for p in range(8))
    chunks = chunking.pack_units(text, 100, 20, 10)
    assert len(chunks) > 3 and all(chunking.count_tokens(c) <= 140 for c in chunks)
    assert chunks[1].startswith("Sentence") and f"Sentence 5 of paragraph {0}" in chunks[0]
    for p in range(8):
        assert any(f"Sentence 3 of paragraph {p}" in c for c in chunks)
    assert chunking.pack_units("too short") == [] and chunking.pack_units("") == []
    assert chunking.cut_tokens("a b c d", 2) == "a b"
    assert chunking.cut_at_sentence("One two three four. Five six", 6) == "One two three four."
    assert chunking.cut_at_sentence("One. two three four five six seven", 6) == "One. two three four five"
    papers = spark.createDataFrame([("p1", "Short one.", [("1", "Design", text, 1)]), ("p2", "", [])], "id string, abstract string, sections array<struct<number:string,heading:string,text:string,n_tokens:int>>")
    rows = chunking.section_chunks(papers, "id", 100, 20, 10).orderBy("chunk_no").collect()
    assert [r.chunk_id for r in rows[:2]] == ["p1_rag_000", "p1_rag_001"] and rows[0].is_abstract and rows[0].n_chunks == len(rows) == len(chunks) + 1
    rows = chunking.profile_chunks(papers, "id", "small", 60, 10, 5).collect()
    assert {r.n_chunks for r in rows} == {len(rows)} and {r.id for r in rows} == {"p1"}


def test_first_by_keys(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("xy"), f"q{rnd.randrange(25)}", f"r{rnd.randrange(4)}" if rnd.random() > 0.1 else None, rnd.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, cat string, q string, r string, score int")
    keys = {"pair": F.concat_ws("|", "q", "r"), "question": F.when(F.col("r").isNotNull(), F.concat_ws("|", "cat", "q"))}
    got = {r.id: (r.kept, r.kept_by, r.reason) for r in graph.first_by_keys(df, "id", [-F.col("score")], keys).collect()}
    seen, want = {}, {}
    for i, cat, q, r, _ in sorted(rows, key=lambda x: (-x[4], x[0])):
        mine = [("pair", f"{q}|{r}" if r else q), ("question", f"{cat}|{q}" if r else None)]
        hit = next(((seen[k], k[0]) for k in mine if k[1] and k in seen), None)
        want[i] = (False, *hit) if hit else (True, None, None)
        if not hit:
            seen.update({k: i for k in mine if k[1]})
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    assert all(got[v[1]][0] for v in got.values() if v[1] is not None) and got.keys() == want.keys()
    assert graph.first_by_keys(df.limit(0), "id", [F.col("score")], keys).count() == 0


def test_records(spark):
    cards = spark.createDataFrame([(1, "a problem of some length", [("p", "1"), ("p", "2"), ("z", "3")]), (2, "Not HPN at all, sorry", [("p", "1")]), (3, "short", None), (4, "a problem without anchors", None)], "id long, problem string, anchors array<struct<pid:string,note:string>>")
    passages = spark.createDataFrame([("p",), ("p",)], "pid string")
    rows = {r.id: r for r in records.checked_cards(cards, "id", "problem", "anchors", passages, "pid").collect()}
    assert [a["note"] for a in rows[1].anchors] == ["1"] and (rows[1].n_bogus, rows[1].n_repeated, rows[1].reason) == (1, 1, "")
    assert [rows[i].reason for i in (2, 3, 4)] == ["self_reported", "short_problem", "no_anchors"]
    with pytest.raises(ValueError, match="double keys"):
        records.routed(spark.createDataFrame([("A-1",), ("A-1",)], "id string"), "id", {"A-": "a"})
    with pytest.raises(ValueError, match="rag"):
        records.require_sources({"hpn": 3, "rag": 0})
    assert records.require_sources({"rag": 0}, strict=False) == {"rag": 0}
    with pytest.raises(ValueError, match="fewer"):
        t = spark.createDataFrame([(1, "Same  Text"), (2, "other")], "id long, text string")
        records.append_exactly(spark.createDataFrame([("same text",)], "text string"), t, ["text"], "id", 2)


def test_report_rules(spark):
    x = spark.createDataFrame([(n, i) for i, n in enumerate(["m-lora-cpt-sft", "rag-m-cpt-sft", "m", "GPT-X", "rag-m-sft", "m-lora-sft"])], "run string, i int")
    got = [tuple(r.v) for r in x.select("i", reports.variant(F.col("run"), ["gpt-x"]).alias("v")).orderBy("i").collect()]
    assert got == [("P5", "closed_book"), ("P7", "open_book"), ("P1", "closed_book"), ("BASE-API", "closed_book"), ("P3+RAG", "closed_book"), ("P2", "closed_book")]
    v = spark.createDataFrame([(0.3, 0.01, 0.01), (-0.3, 0.01, 0.9), (0.1, 0.5, 0.01), (0.1, 0.5, 0.5)], "d double, a double, b double")
    assert [r[0] for r in v.select(reports.equivalence_verdict(F.col("d"), F.col("a"), F.col("b"))).collect()] == ["higher, but below the practical margin", "meaningfully lower", "equivalent", "inconclusive"]
    empty = v.limit(0)
    assert reports.dimension_report(empty, [], ["d"]).first()["mean"] == 0.0 and reports.length_stats(empty, ["d"], "a").count() == 0


def test_titles_and_names(spark):
    from corpusmill.functions import text as T

    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x"))).first()[0]
    assert one(T.marked_blocks, "junk PDF_START: a.pdf ---\n body one \nPDF_END\nPDF_START: b.pdf\n \nPDF_END PDF_START: c.pdf\nno end") == ["body one"]
    assert one(T.leading_title, " 12  A Great\nTitle: of things. Email: a@b.c rest") == "A Great Title: of things"
    assert len(one(T.leading_title, "w " * 50).split()) == 16 and one(T.leading_title, "") == ""
    banner = "arXiv:2101.01234v1 [cs.NI] 3 Jan 2021 SUBMITTED TO IEEE 7 Title Fast Nets and more"
    assert one(T.strip_banners, banner).endswith("Nets and more") and "arXiv" not in one(T.strip_banners, banner)
    assert one(T.model_key, "/x/hpn_judged_m-1_by_judge.xlsx") == "m-1"
    assert [one(T.benchmark_tag, f"/d/hpn_qa_benchmark{x}.json") for x in ("", "_v4_general")] == ["", "v4_general"] and one(T.benchmark_tag, "other.json") == ""
    s = spark.createDataFrame([("the fast net paper extra", "Fast net paper"), ("", "x")], "a string, b string")
    assert [round(r[0], 4) for r in s.select(T.bibliographic_score(F.col("a"), F.col("b"))).collect()] == [0.95, 0.0]


def test_bundles(spark):
    rows = [(p, i, f"{p}_{i}", h, i == 0, 100 * (i + 1)) for p in ("a", "b", "c") for i, h in enumerate(["Abstract", "Design", "Evaluation", "Design", "Other", "Other"])]
    x = chunking.bundles(spark.createDataFrame(rows, "id string, chunk_no int, chunk_id string, heading string, is_abstract boolean, n_tokens int"), "id")
    got = sorted((r.kind, tuple(r.paper_ids), tuple(r.chunk_ids), r.n_tokens) for r in x.collect())
    assert len(got) == 3 * 4 + 3 + 2
    assert ("cross_paper_design", ("a", "b"), ("a_1", "b_1"), 400) in got and ("abstract_plus_body", ("c",), ("c_0", "c_1"), 300) in got


def test_merged_sources(spark):
    from corpusmill.operators import dedup

    many, schema = [f"w{i}" for i in range(30)], "seq long, raw_title string, page_count int, size_bytes long, tokens array<string>"
    a = spark.createDataFrame([(1, "One", 3, 100, many), (2, "", 1, 1, [])], schema)
    b = spark.createDataFrame([(1, "ONE!", 3, 101, many), (2, "one", 4, 500, ["x"]), (3, "Two", 1, 1, [])], schema)
    got = {(r.source, r.seq): r.status for r in dedup.merged_sources({"a": a, "b": b}).collect()}
    assert got == {("a", 1): "new", ("a", 2): "extract_failed", ("b", 1): "strong", ("b", 2): "weak", ("b", 3): "new"}
    few = spark.createDataFrame([(1, "One", 3, 100, ["x"]), (2, "One", 3, 100, ["y"])], schema)
    assert {r.status for r in dedup.title_index(few).collect()} == {"new", "strong"}
    plan = dedup.deletion_plan(spark.createDataFrame([("e", "d", "STRONG"), ("e", "f", "LIKELY"), ("e", "g", None)], "existing string, duplicate string, confidence string"), "LIKELY")
    assert [r.action for r in plan.collect()] == ["delete", "delete", "skip"]


def test_readers(spark, tmp_path):
    import json

    from corpusmill.sources import files

    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    (tmp_path / "a.csv").write_text("x\n1\n2\n")
    for name in ("a.jsonl", "a.json", "a.csv"):
        assert [r.x for r in files.rows(spark, str(tmp_path / name), "x long").orderBy("x").collect()] == [1, 2]
    with pytest.raises(ValueError, match="no reader"):
        files.rows(spark, "a.xml", "x long")
    (tmp_path / "p").mkdir()
    rag = {"profile_type": "rag", "summary": {"question_count": 3, "avg_total_time_s": 2.0}, "model_load": {"retriever_load_time_s": 1.111, "generator_load_time_s": 2}}
    (tmp_path / "p" / "inference_r.json").write_text(json.dumps(rag, indent=1))
    (tmp_path / "p" / "inference_m.json").write_text(json.dumps({"profile_type": "llm", "benchmark_prompts": [{"avg_total_time_s": 1.0}, {"avg_total_time_s": 2.0}], "summary": {"avg_ttft_s": 0.5}, "model_load": {"load_time_s": 9.0}}))
    got = {r.label: r for r in files.profiles(spark, str(tmp_path / "p")).collect()}
    assert (got["r"].question_count, got["r"].avg_total_time_s, got["r"].load_time_s, got["r"].avg_ttft_s) == (3, 2.0, 3.11, None)
    assert (got["m"].question_count, got["m"].avg_total_time_s, got["m"].load_time_s, got["m"].avg_ttft_s) == (2, 1.5, 9.0, 0.5)
    (tmp_path / "d").mkdir()
    for name, stamp in (("a.pdf", "1"), ("b.pdf", "2"), ("c.bin", "1"), ("d.bin", "2")):
        (tmp_path / "d" / name).write_bytes(b"%PDF \xff /CreationDate (D:" + stamp.encode() + b") rest")
    for name, year in (("e.xlsx", 2020), ("f.xlsx", 2021)):
        with zipfile.ZipFile(tmp_path / "d" / name, "w") as z:
            z.writestr("docProps/core.xml", f'<p><dcterms:created xsi:type="t">{year}</dcterms:created></p>')
            z.writestr("xl/sheet.xml", "<s/>")
    d = {r.file: r.sha256 for r in files.digests(spark, str(tmp_path / "d")).collect()}
    assert d["a.pdf"] == d["b.pdf"] and d["c.bin"] != d["d.bin"]
    assert d["e.xlsx"] == d["f.xlsx"] and d["e.xlsx"]
    assert files.settings({"a": 1}, {"a": int, "b": float}, {"b": 2}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError, match="unknown: z; missing: b; a: int expected"):
        files.settings({"a": True, "z": 1}, {"a": int, "b": float})
