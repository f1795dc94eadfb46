import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import language as L

SENTENCES = {
    "en": ["the old check compared seconds with samples which can never be right", "please keep an eye on the window report after the next release", "until now the last samples of every file were silently skipped"],
    "de": ["bisher wurden die letzten werte jeder datei stillschweigend verworfen", "niemand weiß mehr warum das zwei durchläufe brauchte", "bitte behaltet den bericht nach der nächsten auslieferung im auge"],
    "fr": ["plus personne ne sait pourquoi cette fonction faisait deux passages", "les tests couvrent maintenant les entrées vides et les battements isolés", "nous avons reçu trois signalements depuis le déplacement"],
    "ru": ["тесты теперь проверяют пустой ввод и одиночные удары", "пожалуйста следите за этим после следующего выпуска", "раньше последние отсчёты каждого файла молча пропускались"],
    "ja": ["空の入力と一拍だけの入力も試験の対象に加えました", "取り消し操作のたびに同じ処理が二回呼ばれていたことが分かりました", "同じ不具合の報告が三件ありました"],
}


def commit(message):
    return "commit 0123456789abcdef\nAuthor: A B <a@b.example>\nDate:   2020-01-01 00:00:00 +0000\n\n" + "\n".join("    " + line for line in message.split("\n")) + "\n\ndiff --git a/x b/x\n+der die das und nicht\n"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for k in range(40):
        for lang, parts in SENTENCES.items():
            text = ". ".join(parts[(k + j) % 3].capitalize() for j in range(2)) + "."
            rows.append((len(rows), commit(text), lang if k % 8 else "en"))
    return spark.createDataFrame(rows, "id long, text string, lang string")


@pytest.fixture(scope="module")
def model(corpus):
    return L.fit(corpus, "id", "text", "lang")


def test_codewords_are_far_apart():
    assert L.CODEWORDS.shape == (11, 15)
    for i in range(11):
        for j in range(i):
            assert (L.CODEWORDS[i] != L.CODEWORDS[j]).sum() == 8


def test_wrong_labels_do_not_spoil_the_classifiers(model):
    parts = [s for own in SENTENCES.values() for s in own]
    truth = [lang for lang, own in SENTENCES.items() for _ in own]
    best, sure = model.decode(parts)
    assert [L.LANGUAGES[b] for b in best] == truth and sure.min() > 0.9


def languages(spark, corpus, model, rows):
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    return {r["id"]: r for r in L.find_languages(df, "id", "text", "lang", model=model).groupBy("id", "label").agg(F.sort_array(F.collect_list("lang")).alias("langs"), F.first("parts").alias("parts")).collect()}


def test_mixed_messages_and_parts(spark, corpus, model):
    mixed = SENTENCES["en"][0].capitalize() + ". " + SENTENCES["fr"][1].capitalize() + ".\n\n> " + SENTENCES["ja"][0] + "。\n\nSigned-off-by: Der Die <das@und.example>"
    got = languages(spark, corpus, model, [(1, commit(mixed), "en"), (2, commit(SENTENCES["de"][0] + "."), "German")])
    assert got[1]["langs"] == ["en", "fr", "ja"] and [p["lang"] for p in got[1]["parts"]] == ["en", "fr", "ja"]
    assert got[2]["langs"] == ["de"] and got[2]["label"] == "de"


def test_edge_cases(spark, corpus, model):
    broken = SENTENCES["fr"][1].encode("utf-8").decode("cp1252", "replace")
    rows = [
        (1, None, "en"), (2, "", "en"), (3, commit("fix"), None), (4, commit(broken + "."), "und"), (5, commit(SENTENCES["en"][0] + "."), " "),
        (6, commit(SENTENCES["ru"][0]).replace("\n", "\r\n"), "ru_RU"), (7, "diff --git a/x b/x\n+nothing", "en"), (8, commit((SENTENCES["en"][1] + ". ") * 3000), "EN"),
        (9, "From: A <a@b.example>\nDate: 2020\nSubject: [PATCH] " + SENTENCES["de"][1] + "\n\n---\ndiff --git a/x b/x\n", "nl-BE"),
    ]
    got = languages(spark, corpus, model, rows)
    assert set(got) == {4, 5, 6, 8, 9}
    assert got[4]["langs"] == ["fr"] and got[4]["label"] is None
    assert got[5]["label"] is None and got[6]["langs"] == ["ru"] and got[6]["label"] == "ru" and got[8]["langs"] == ["en"]
    assert got[9]["langs"] == ["de"] and got[9]["label"] == "nl"
    empty = corpus.limit(0)
    assert L.find_languages(empty, "id", "text", "lang").collect() == []


def test_labels(spark):
    names = ["en", "EN", "en_US", "pt-BR", "ger", "deu", "Japanese", "und", "", " ", None, "n/a", "unknown", "en_US.UTF8", "xx", "fi"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "l string").select(L.named_language(F.col("l"))).collect()]
    assert got == ["en", "en", "en", "pt", "de", "de", "ja", None, None, None, None, None, None, "en", None, None]


def test_message_without_header_trailers_and_diff():
    text = commit("Fix it\n\n(cherry picked from commit 123)\nRefs: #1\n# Conflicts:\n#\ta/b")
    assert [line for _, line in L.message_of(text) if line] == ["Fix it"]
    assert L.sentences_of([(False, "refactor(x): See src/a_b.py for the old checks"), (False, "that are gone. ok")]) == ["see for the old checks that are gone. ok"]


def test_ngrams_match_a_plain_count():
    bucket, owner = L.ngrams(["ab", "abc"])
    assert np.bincount(owner).tolist() == [4 + 3 + 2 + 1, 5 + 4 + 3 + 2]


def test_held_out_accuracy(spark, sf_dir):
    """Labels of held-out single-language messages, most of which are right, agree with what is decoded."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    fitted = L.fit(df.where(~held), "doc_id", "text", "lang")
    got = L.find_languages(df.where(held), "doc_id", "text", "lang", model=fitted).where("n_languages = 1 and label is not null")
    right = got.select(F.avg((F.col("lang") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.85
