"""Language identification: held-out accuracy, the machines, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import language
from tests.conftest import SF


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = language.op12_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_and_sources_are_no_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, F.lit(True))
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    turned = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": -F.col("doc_id")})
    assert {-r.doc_id: (r.lang_pred, r.score) for r in language.identify(turned, model).collect()} == plain


def test_a_machine_separates_two_classes_of_unlike_size():
    rng = np.random.RandomState(1)
    y = np.where(np.arange(400) < 40, 1.0, -1.0)
    x = (rng.normal(size=(400, 5)) + np.outer(y, [2, 0, 0, 1, 0])).astype(np.float32)
    w, b = language.machine(x, y)
    right = np.sign(x @ w + b) == y
    assert right[:40].mean() > 0.95 and right[40:].mean() > 0.95


def test_three_languages_of_a_family_are_voted_on():
    said = {"de": "und der die das nicht", "en": "the and of that with", "nl": "het een van niet zijn", "fr": "le la les dans pour"}
    texts, langs = [], []
    for lang, words in said.items():
        for k in range(30):
            rng = np.random.RandomState(k)
            texts.append(" ".join(rng.choice(words.split(), 12)).encode())
            langs.append(lang)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, total, found = language.runs(data, offs, 512)
    x = np.zeros((len(texts), 513), np.float32)
    row = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(found[0]))))
    for f in found:
        np.add.at(x, (row, f), 1)
    model = language.Model.fit((x[:, :-1] / total[:, None]).astype(np.float32), langs)
    got, score = model.predict(data, offs)
    assert list(got) == langs and score.min() > 0.4
    assert model.languages == {"germanic": ["de", "en", "nl"], "romance": ["fr"]}


def test_runs_are_those_of_the_letters():
    data = np.frombuffer("ab, c--é".encode(), np.uint8)
    starts, total, found = language.runs(data, np.array([0, 0, len(data)]), 1 << 20, (2,))
    kept = " ab c é ".encode()
    assert starts.tolist() == [0, 2] and total.tolist() == [1, len(kept) - 1]
    again = language.runs(np.frombuffer("AB  C é".lower().encode(), np.uint8), np.array([0, 8]), 1 << 20, (2,))
    assert found[0][2:].tolist() == again[2][0].tolist()


def test_odd_rows_of_languages(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "... 12", "x"), (4, "日本語", "ja"), (5, "The the and", None), (None, "Ünd der", "de"), (6, "a" * 100_000, "en"), (6, "a" * 100_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash")).withColumn("_text", F.lit(1)).withColumn("_h", F.lit(2))
    got = language.identify(docs, language.fit(docs, F.lit(True))).collect()
    assert len(got) == 8 and [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert all(r.lang_pred in ("en", "de", "ja", "x") for r in got if r.doc_id not in (1, 2, 3))
    none = language.identify(docs, language.fit(docs, F.lit(False))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    one = language.identify(docs, language.fit(docs, F.col("lang") == "de")).collect()
    assert {r.lang_pred for r in one} == {"de", "und"}
    assert language.identify(docs.limit(0), language.fit(docs.limit(0), F.lit(True))).count() == 0
