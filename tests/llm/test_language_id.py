import random

import numpy as np
from aicensus.llm import language_id as lid
from pyspark.sql import functions as F

random.seed(3)
PARTS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["ção", "nho", "lha", "eu"]}


def sentence(lang, n=12):
    return " ".join("".join(random.choices(PARTS[lang], k=random.randint(1, 3))) for _ in range(n))


TRAIN = [(i, sentence(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))


def test_presence_is_the_set_of_grams():
    text = "Abcé🙂ab"
    grams = {text.lower()[i:i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}
    assert len(lid.presence(text)) == len(grams)
    long = "".join(random.choices("abcdefgh é🙂", k=5000))
    assert (lid.presence(long, part=100) == lid.presence(long)).all()


def test_collapsed_scores_equal_kernel_times_weights():
    texts, langs = [t for _, t, _ in TRAIN[:40]], [x for *_, x in TRAIN[:40]]
    model = lid.train(texts, langs, 40, 1e-6)
    sets = [lid.presence(t) for t in texts]
    kernel = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    target = np.where(np.array(langs)[:, None] == np.array(model.languages), 1.0, -1.0)
    dual = np.linalg.lstsq(kernel.T @ kernel + 1e-6 * 40 * kernel + 1e-8 * np.eye(40), kernel.T @ target, rcond=1e-10)[0]
    assert np.abs(lid.presence_rows(sets, model.grams, model.weights) - kernel @ dual).max() < 1e-2


def test_held_out_texts(spark):
    model = lid.fit(frame(spark, [*TRAIN, (None, "x", "aa"), (900, None, "bb"), (901, "x", None)]), per_language=50)
    rows = [(i, sentence(lang, 4), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    found = {r["doc_id"]: r for r in lid.classify(frame(spark, rows), model).collect()}
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in rows) >= 58
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_no_letters_long_texts_and_empty_tables(spark):
    model = lid.fit(frame(spark, TRAIN))
    rows = [(1, None, None), (2, "", None), (3, "12 !? 🙂", None), (None, sentence("bb", 40_000), None), (None, "é", None)]
    found = lid.classify(frame(spark, rows), model).collect()
    assert [(r["lang_pred"], r["score"]) for r in found if r["doc_id"]] == [("und", 0.0)] * 3
    assert "bb" in [r["lang_pred"] for r in found if r["doc_id"] is None]
    assert lid.classify(frame(spark, []), model).count() == 0
    blank = lid.fit(frame(spark, []))
    assert [r["lang_pred"] for r in lid.classify(frame(spark, [(1, "abc", None)]), blank).collect()] == ["und"]
