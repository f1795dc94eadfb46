import random
import unicodedata

import numpy as np
import pytest

from pulseloom.llm.leakage import align, find_leaks, gram_keys, words_of

VOCAB = [f"w{i}" for i in range(30)]


def common_run(a, b):
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else 0)
        row = new
        best = max(best, *row)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_every_long_common_run_is_found(spark, seed):
    rng = random.Random(seed)
    text = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    passages = [(i, " ".join(text(rng.choice([4, 9, 10, 25, 60])))) for i in range(25)]
    docs = []
    for i in range(60):
        words = text(rng.choice([0, 5, 80, 200]))
        if rng.random() < 0.7:
            own = rng.choice(passages)[1].split()
            low = rng.randrange(len(own))
            at = rng.randrange(len(words) + 1)
            words[at:at] = own[low : low + rng.choice([5, 9, 10, 11, 40])]
        docs.append((i, rng.choice([" ", "\n+", "\r\n- "]).join(words)))
    expected = {(d, p) for d, a in docs for p, b in passages if common_run(words_of(a), words_of(b)) >= 10}
    got = find_leaks(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(passages, "p long, x string"), "d", "t", "p", "x")
    rows = got.collect()
    assert {(r["d"], r["p"]) for r in rows if r["run_words"] >= 10} == expected
    runs = {(d, p): common_run(words_of(a), words_of(b)) for d, a in docs for p, b in passages}
    assert all(r["run_words"] <= runs[(r["d"], r["p"])] and (runs[(r["d"], r["p"])] < 10 or r["run_words"] == runs[(r["d"], r["p"])]) for r in rows)


def test_edited_copies(spark):
    passage = "the early keeper paints one hollow granary above the quiet hedge while seven potters agree about rain and every glazier sings"
    edited = passage.replace("hollow ", "").replace("quiet", "loud").replace("agree about", "agree on").upper()
    docs = spark.createDataFrame([(1, "x " + edited + " y"), (2, "nothing of the kind here"), (3, None), (4, "")], "id long, body string")
    items = spark.createDataFrame([(7, passage), (8, passage), (9, None), (10, ""), (11, "too short")], "item long, passage string")
    rows = find_leaks(docs, items, "id", "body", "item", "passage").collect()
    assert {(r["id"], r["item"]) for r in rows} == {(1, 7), (1, 8)}
    assert all(0.6 < r["score"] < 1 for r in rows)


def edited_copy(rng, words, rate):
    """Each word is replaced, dropped or followed by a new one with the given probability."""
    out = []
    for w in words:
        kind = rng.choice("rdi") if rng.random() < rate else "k"
        out += {"k": [w], "r": [f"new{rng.randrange(10**6)}"], "d": [], "i": [w, f"new{rng.randrange(10**6)}"]}[kind]
    return out


def edit_recall(spark, sf_dir, rates, copies):
    """Share of planted edited copies of real passages that are found, by edit rate, in the whole corpus."""
    rng = random.Random(11)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = [(r["item_id"], words_of(r["passage"])) for r in spark.read.parquet(f"{sf_dir}/eval_item.parquet").select("item_id", "passage").where("passage is not null").orderBy("item_id").collect()]
    filler = [w for r in docs.where("text is not null").orderBy("doc_id").limit(50).collect() for w in words_of(r["text"])]
    planted = []
    for rate in rates:
        for _ in range(copies):
            item, words = rng.choice(items)
            at = rng.randrange(len(filler) - 300)
            around = filler[at : at + 300]
            planted.append((-len(planted) - 1, " ".join([*around[:150], *edited_copy(rng, words, rate), *around[150:]]), item, rate))
    whole = docs.union(spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in find_leaks(whole, spark.read.parquet(f"{sf_dir}/eval_item.parquet"), "doc_id", "text", "item_id", "passage").where("doc_id < 0").collect()}
    return {rate: sum((d, i) in found for d, _, i, r in planted if r == rate) / copies for rate in rates}


def test_recall_of_edited_copies(spark, sf_dir):
    recall = edit_recall(spark, sf_dir, [0.1, 0.2, 0.3], 60)
    assert recall[0.1] >= 0.95 and recall[0.2] >= 0.9 and recall[0.3] >= 0.9, recall


def test_edited_copy_beside_a_verbatim_one(spark):
    passage = " ".join(VOCAB[:24])
    edited = " ".join(w if i % 7 != 6 else "other" for i, w in enumerate(VOCAB[:24]))  # runs of six words, all of them in the verbatim copy too
    docs = spark.createDataFrame([(1, passage), (2, edited), (3, "w3 w4 w5 w6")], "d long, t string")
    items = spark.createDataFrame([(7, passage)], "p long, x string")
    rows = {r["d"]: r for r in find_leaks(docs, items, "d", "t", "p", "x").collect()}
    assert set(rows) == {1, 2} and rows[1]["run_words"] == 24 and rows[2]["run_words"] == 6 and rows[2]["score"] > 0.7
    assert {r["d"] for r in find_leaks(docs, items, "d", "t", "p", "x", edited=False).where("run_words >= 10").collect()} == {1}


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, " ".join(VOCAB), 5, 6)], "id long, text string, item int, numbers int")
    items = spark.createDataFrame([(1, " ".join(VOCAB), 3)], "k long, passage string, id int")
    assert [tuple(r)[:3] for r in find_leaks(docs, items, "id", "text", "k", "passage").collect()] == [(1, 1, 30)]
    assert find_leaks(docs.limit(0), items, "id", "text", "k", "passage").collect() == []
    assert find_leaks(docs, items.limit(0), "id", "text", "k", "passage").collect() == []


def test_words_and_alignment():
    assert words_of("Ａb_c-Ⅷ １２\r\n+x²") == ["ab", "c", "viii", "12", "x2"]
    assert words_of("Straße") == [unicodedata.normalize("NFKC", "straße")]
    a = np.array([1, 2, 3, 4, 5])
    pairs = [(a, a), (a, np.array([9, 1, 2, 3, 8, 4, 5])), (a, np.array([1, 2, 4, 5])), (a, np.array([0, 0])), (a, a[:0])]
    score, run = align(pairs)
    assert score.tolist() == [10, 9, 7, 0, 0] and run.tolist() == [5, 3, 2, 0, 0]
    pairs, single = gram_keys(np.array([1, 2, 3, 7, 1, 2, 3]), [2, 3])
    assert single[0] == single[4] and len(set(single.tolist())) == 4 and len(pairs) == 6 and not set(pairs.tolist()) & set(single.tolist())
    assert [len(k) for k in gram_keys(np.array([1, 2]), [5, 3, 2])] == [0, 0, 1]


def test_hidden_cases_at_small_scale(spark, sf_dir):
    """The whole query against a plain search over all pairs."""
    from pulseloom.llm.queries import p8_found

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text is not null").collect()
    items = spark.read.parquet(f"{sf_dir}/eval_item.parquet").select("item_id", "passage").where("passage is not null").collect()
    grams = {}
    for r in items:
        w = words_of(r["passage"])
        for i in range(len(w) - 9):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(r["item_id"])
    expected = set()
    for r in docs:
        w = words_of(r["text"])
        for i in range(len(w) - 9):
            expected |= {(r["doc_id"], item) for item in grams.get(tuple(w[i : i + 10]), ())}
    assert {tuple(r) for r in p8_found(spark, sf_dir).collect()} == expected
