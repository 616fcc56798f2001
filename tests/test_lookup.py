"""fuzzy_titles looks every document up against all others, on whole texts."""

import random
import re


def brute(rows, least):
    toks = {d: frozenset(x for x in re.findall("[a-z0-9]+", (t or "").lower()) if len(x) > 2) for d, t in rows}
    key = {d: " ".join(re.sub(r"[^\w\s]", " ", (t or "").lower()).split()) for d, t in rows}
    out = {}
    for d, _ in rows:
        same = [e for e in key if e != d and key[d] and key[e] == key[d]]
        near = [(-len(toks[d] & toks[e]) / len(toks[d] | toks[e]), e) for e in toks if e != d and toks[d] & toks[e]]
        best = min((x for x in near if -x[0] >= least), default=None)
        if same:
            out[d] = (min(same), 1.0, True)
        elif best:
            out[d] = (best[1], round(-best[0], 6), False)
    return out


def test_fuzzy_titles_is_all_against_all(spark, tmp_path):
    from corpusmill.plans import catalog

    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(300)}x" for _ in range(n)]
    texts = []
    for _ in range(25):
        w = fresh(rng.choice([3, 8, 20, 60, 90]))
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            v = list(w)
            for _ in range(rng.randint(0, len(v) // 12 + 1)):
                v[rng.randrange(len(v))] = fresh(1)[0]
            texts.append(rng.choice([" ", ", "]).join(v if rng.random() < 0.7 else v[::-1]))
    texts += [None, "", "a b", "a, b", "!!", "W1x w2x", "w1x; w2x!"] + [" ".join(f"v{j}z" for j in range(20) if j != i) for i in range(20)]
    far = " ".join(f"u{j}t" for j in range(120))
    texts += [far + " here", far + " there", far[:300] + " " + " ".join(fresh(60))]
    rows = [(i * 10 + 3, t) for i, t in enumerate(texts)]  # ids of one last digit, differences after the first 200 characters
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.l_id: (r.r_id, r.score, r.exact) for r in catalog.fuzzy_titles(spark, str(tmp_path)).collect()}
    assert got == brute(rows, 0.85)
    assert {False, True} == {x[2] for x in got.values()} and len({x[1] for x in got.values()}) > 3


def test_quotes_of_every_length_stand_where_brute_force_says(spark):
    from corpusmill.operators import retrieval

    rng = random.Random(8)
    words = ["alpha", "Beta", "gam", "gamma", "delta,", "eps", "a", "of"]
    docs = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "")]
    items = [(i, " ".join(docs[rng.randrange(60)][1].split()[:k])) for i, k in enumerate([1, 1, 2, 2, 3, 4, 6, 9, 10, 12, 20, 30])]
    items += [(50, "MMA del"), (51, "lph"), (52, ""), (53, None), (54, "ta gam"), (55, "zzz"), (56, "amma delta, eps a o"), (57, docs[3][1]), (58, docs[4][1][1:-1])]
    got = retrieval.quoted(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    want = {(i, d) for i, q in items for d, t in docs if q and q.lower() in (t or "").lower()}
    assert sorted(map(tuple, got.collect())) == sorted(want)
