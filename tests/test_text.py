from pyspark.sql import functions as F

from corpusmill.functions import json as J
from corpusmill.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_references_follow_the_order_of_the_patterns(spark):
    text = "a\nBibliography\nb\nreferences\nc"
    assert one(spark, text, T.cut_references) == "a\nBibliography\nb"
    assert one(spark, "nothing here", T.cut_references) == "nothing here"


def test_cleaning_steps(spark):
    assert one(spark, "net-\n work", T.join_hyphens) == "network"
    assert "acm" not in one(spark, "x\nKeywords: acm, ai\ny", T.strip_boilerplate)
    assert one(spark, "| a | b |\n| c | d |\nrest", T.strip_tables) == "\nrest"
    assert one(spark, "END OF THE STORY TOLD IN CAPITALS", T.clean_text) == ""
    assert one(spark, "too short", T.clean_text) == ""
    assert one(spark, "A plain sentence, long enough... to stay.Next", T.clean_text) == "A plain sentence long enough. to stay. Next"
    assert one(spark, None, T.clean_text) is None


def test_keys_and_counts(spark):
    assert one(spark, "Deep-Learning:  Für ALLE_x", T.title_key) == "deep learning für alle_x"
    assert one(spark, "  A\x00b \n c ", T.squeeze) == "A b c"
    assert one(spark, "Héllo, world!", T.token_estimate) == 4
    assert one(spark, "one two", lambda c: T.ngrams(T.space_words(c), 3)) == []
    assert one(spark, "a b c d", lambda c: T.ngrams(T.space_words(c), 3)) == ["a b c", "b c d"]
    assert one(spark, "The cat and THE cats", T.content_tokens) == ["cat", "cats"]
    assert one(spark, "Why? Yes. no (Maybe) e.g. x", T.sentences) == ["Why?", "Yes. no (Maybe) e.g. x"]
    assert one(spark, "..bad/name?. ", T.safe_filename) == "badname"
    assert one(spark, "///", T.safe_filename) == "untitled"
    assert one(spark, ' My  "Paper": a/b. ', T.safe_filename) == "My  Paper ab"
    assert one(spark, "word " * 40, T.safe_filename) == " ".join(["word"] * 30)
    assert (one(spark, " My Profile (v2) ", T.slug), one(spark, "??", T.slug)) == ("my_profile_v2", "profile")


def test_truncation_keeps_the_original(spark):
    assert one(spark, "one, two  three; four", lambda c: T.head_tokens(c, 2)) == "one, two"
    assert one(spark, "one, two  three; four.", lambda c: T.tail_tokens(c, 2)) == "three; four."
    assert one(spark, "one", lambda c: T.tail_tokens(c, 2)) == "one"


def test_abstract_from_positions(spark):
    f = T.abstract_from_positions
    assert one(spark, {"b": [1], "a": [0, 2]}, f, "map<string,array<int>>") == "a b a"
    assert one(spark, {}, f, "map<string,array<int>>") == ""
    assert one(spark, None, f, "map<string,array<int>>") is None


def test_chat_and_answer(spark):
    df = spark.createDataFrame([(k, "s", "q", "r") for k in T.CHAT], "k string, s string, q string, r string")
    made = df.withColumn("c", T.chat(F.col("k"), F.col("s"), F.col("q"), F.col("r")))
    assert all(r.a == "r" for r in made.select(T.answer(F.col("k"), F.col("c")).alias("a")).collect())
    assert df.select(T.chat(F.col("k"), F.lit(None), F.lit(""), F.col("r"))).first()[0] == ""


def test_lenient_json(spark):
    f = lambda c: J.lenient(c)
    assert one(spark, '{"a": 1}', f) == '{"a": 1}'
    assert one(spark, 'Sure ```json\n{"a": 1}\n``` bye', f) == '{"a": 1}'
    assert one(spark, 'x {"a": "b"} y', f) == '{"a": "b"}'
    assert one(spark, "no", f) is None
    assert one(spark, r'{"a": "\alpha"}', lambda c: F.get_json_object(J.lenient(c), "$.a")) == r"\alpha"
    assert one(spark, 'pre [1, {"x": "}"}] post', J.extract) == '[1, {"x": "}"}]'
    assert one(spark, '{"a": "4", "b": 5}', lambda c: J.scores(c, ("a", "b"))) == {"a": 4.0, "b": 5.0}
    assert one(spark, '{"a": "x", "b": 5}', lambda c: J.scores(c, ("a", "b"))) is None
    assert [one(spark, v, J.relevance) for v in ("RELEVANT", "not_relevant: no", "???")] == [True, False, True]


def test_long_texts_do_not_end_the_stack(spark):
    words = " ".join(f"w{i}" for i in range(60_000))
    assert one(spark, words, lambda c: T.tail_tokens(c, 900)) == " ".join(f"w{i}" for i in range(59_100, 60_000))
    assert one(spark, words, lambda c: T.head_tokens(c, 50_000)) == " ".join(f"w{i}" for i in range(50_000))
    assert one(spark, "x\n" + "|a|b|\n" * 20_000 + "|c|\ny", T.strip_tables) == "x\n\ny"
    long = "A sentence of enough words see http://x/" + "aB0%2F" * 20_000 + " and then more words follow here"
    assert one(spark, long, T.clean_text) == "A sentence of enough words see and then more words follow here"


def test_fallback_body_follows_the_abstract(spark):
    from corpusmill.operators import chunking

    df = spark.createDataFrame([(1, "Title X\nAbstract  we do\nthings"), (2, "no mark at all"), (3, None)], "k long, t string")
    got = {r.k: r for r in chunking.parsed(df, "k", "t").collect()}
    assert [got[k].sections[0].text for k in (1, 2, 3)] == ["we do things", "no mark at all", ""] and got[1].method == "fallback"
