import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from countygeo.llm import language, quality, toxicity
from countygeo.llm.model import fold, logistic_fit, sigmoid

SYLLABLES = {"aa": ["the", "ing", "an", "wh", "ed"], "bb": ["ich", "sch", "ung", "der", "ö"], "cc": ["ción", "os", "el", "ñ", "que"]}
BAD = ["vilo", "grumf", "zonk"]


def _corpus(n=420, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        lang = rnd.choice(list(SYLLABLES))
        words = ["".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(rnd.randint(8, 60))]
        toxic = rnd.random() < 0.25
        for _ in range(rnd.randint(1, 3) * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + rnd.choice(["", "s", "ed"]))
        good = rnd.random() < 0.75
        if not good:
            words = [w + rnd.choice(["###", "$$$"]) for w in words]
        docs.append((k, ". ".join(" ".join(words[i:i + 9]).capitalize() for i in range(0, len(words), 9)), lang))
        labels.append((k, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = _corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"label": F.lit("clash"), "score": F.lit(0)})
    return table.cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def _truth(labels, column):
    return {r["doc_id"]: r[column] for r in labels.collect()}


def test_fold_is_crc32_of_the_id(spark):
    import zlib

    got = spark.range(50).select("id", fold("id", 4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)


def test_language_on_the_held_out_fold(spark, corpus, odd_docs, no_docs):
    docs, _ = corpus
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 420 and len(held) > 60
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got) and np.mean([r["rejected"] for r in got]) < 0.02
    model = language.fit_model(docs)
    odd = {r["doc_id"]: r for r in language.predict_language(odd_docs, model).collect()}
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["rejected"] and odd[k]["score"] == 0 for k in (1, 2, 3, 8))
    assert odd[7]["lang_pred"] != "und" and language.predict_language(odd_docs, model).count() == odd_docs.count()
    assert language.predict_language(no_docs, model).count() == 0
    assert language.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_labels_of_the_held_out_fold_are_never_used(corpus):
    docs, _ = corpus
    changed = docs.withColumn("lang", F.when(fold("doc_id", 4) == 2, "zz").otherwise(F.col("lang")))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    assert a == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(changed).collect()}


def test_subwords_equal_a_loop():
    texts = ["Ab c", "", "éa-b", "x"]
    data, bounds = language.raw(language._lower(pa.array(texts)))
    bucket, row, letters = language.subwords(data, bounds)
    count = np.bincount(row, minlength=4)
    expected = []
    for t in texts:
        b = t.lower().encode()
        inside = [chr(c).isalpha() or c >= 128 for c in b]
        n = sum(inside)
        n += sum(inside[k] or inside[k + 1] for k in range(len(b) - 1))
        n += sum(inside[k + 1] for k in range(len(b) - 2))
        expected.append(n)
    assert count.tolist() == expected and letters.tolist() == [True, False, True, True]


def test_language_of_texts_without_a_unicode_letter():
    model = language.Model(["aa", "bb"], np.zeros((language.BUCKETS, 2)), np.zeros(2), 1.0)
    texts = ["10 \u2013 12", "\u201c1\u201d", "5 \u20ac", "1\u00a0000", "\U0001f600", "\u0663\u0664", "", None, "1 \u2013 x", "\u4e2d", "\u00c9", "\u02b0"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = next(language._predict(model)(iter([batch])))
    letters = [False] * 8 + [True] * 4
    assert [x != "und" for x in got.column("lang_pred").to_pylist()] == letters
    assert [x > 0 for x in got.column("score").to_pylist()] == letters


def test_quality_on_the_held_out_fold(corpus, odd_docs, no_docs, spark):
    docs, labels = corpus
    got = {r["doc_id"]: r for r in quality.grade(docs, labels).collect()}
    truth = _truth(labels, "quality")
    held = [k for k, r in got.items() if r["held_out"]]
    assert len(got) == 420 and np.mean([got[k]["predicted"] == truth[k] for k in held]) > 0.95
    changed = labels.withColumn("quality", F.when(fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {k: r["score"] for k, r in got.items()} == {r["doc_id"]: r["score"] for r in quality.grade(docs, changed).collect()}
    odd = quality.grade(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.grade(no_docs, labels).count() == 0
    assert quality.grade(docs, labels.limit(0)).count() == 420


def test_quality_score_is_the_sparse_dot_product(corpus):
    docs, labels = corpus
    model = quality.fit_model(docs, labels)
    text = "The ing### an wh. The ing### ed ed"
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    bucket, size = quality.features(batch)
    dense = np.zeros(quality.BUCKETS)
    dense[bucket] = 1 / np.sqrt(len(bucket))
    expected = sigmoid(model.slope * (dense @ model.dense()) + model.bias)
    got = quality.score_quality(docs.sparkSession.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["score"]
    assert got == pytest.approx(float(expected)) and size.tolist() == [len(set(bucket.tolist()))]


def test_toxicity_on_the_held_out_fold(corpus, odd_docs, no_docs):
    docs, labels = corpus
    got = {r["doc_id"]: r for r in toxicity.grade(docs, labels).collect()}
    truth = _truth(labels, "toxic")
    held = [k for k, r in got.items() if r["held_out"]]
    assert len(got) == 420 and np.mean([got[k]["predicted"] == truth[k] for k in held]) > 0.95
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans = [texts[k][s["start"]:s["end"]] for k, r in got.items() for s in r["toxic_spans"]]
    assert len(spans) > 100 and np.mean([any(w.startswith(tuple(BAD)) for w in s.lower().split()) for s in spans]) > 0.95
    changed = labels.withColumn("toxic", F.when(fold("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {k: r["score"] for k, r in got.items()} == {r["doc_id"]: r["score"] for r in toxicity.grade(docs, changed).collect()}
    odd = toxicity.grade(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.grade(no_docs, labels).count() == 0
    assert toxicity.grade(docs, labels.limit(0)).count() == 420


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    size = np.array([1, 4, 2, 3])
    begin = np.cumsum(size) - size
    emission, start, move = rng.normal(size=10), rng.normal(size=2), rng.normal(size=(2, 2))
    p, pairs, log_z = toxicity.marginals(emission, begin, size, start, move)
    expected, expected_pairs, total = np.zeros(10), np.zeros((2, 2)), 0.0
    for b, n in zip(begin, size, strict=True):
        paths = list(itertools.product((0, 1), repeat=n))
        weight = np.array([np.exp(start[y[0]] + sum(emission[b + k] * y[k] for k in range(n)) + sum(move[y[k - 1], y[k]] for k in range(1, n))) for y in paths])
        total += np.log(weight.sum())
        weight /= weight.sum()
        for y, w in zip(paths, weight, strict=True):
            expected[b:b + n] += w * np.array(y)
            for k in range(1, n):
                expected_pairs[y[k - 1], y[k]] += w
    assert p == pytest.approx(expected) and pairs == pytest.approx(expected_pairs) and log_z == pytest.approx(total)


def test_copies_of_a_toxic_document_teach_nothing_new(spark):
    docs, labels = _corpus(300, 5)
    copy = "Grumf " + " ".join("".join(c) for c in itertools.product("bdf", "aeiou", "klm"))
    docs += [(1000 + k, copy, "aa") for k in range(200)]
    labels += [(1000 + k, 1, 1) for k in range(200)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marked = table.join(spark.createDataFrame(labels, "doc_id long, quality int, label int"), "doc_id").select("text", "label")
    found = toxicity.Sieve(toxicity.toxic_features(marked))
    hashed, start, end, _, _, _, data, _ = toxicity.sentences(pa.RecordBatch.from_arrays([pa.array([copy])], ["text"]))
    value = toxicity.token_features(data, hashed, start, end)
    assert set((found.find(value)[0] // value.shape[1]).tolist()) == {0}


def test_copies_of_a_clean_document_clear_no_word(spark):
    docs, labels = _corpus(300, 5)
    copy = "They said grumf " + " ".join("".join(c) for c in itertools.product("bdf", "aeiou", "klm"))
    rows = [(t, toxic) for (_, t, _), (_, _, toxic) in zip(docs, labels, strict=True)] + [(copy, 0)] * 300 + [(None, 0), ("", 0)]
    found = toxicity.toxic_features(spark.createDataFrame(rows, "text string, label int"))
    word = toxicity.sentences(pa.RecordBatch.from_arrays([pa.array(["grumf"])], ["text"]))
    assert set(toxicity.token_features(word[6], *word[:3])[0, 1:3].tolist()) <= set(found.tolist())


def test_short_texts_are_families_of_their_own():
    texts = ["a b c", "a b", "b a", "a b c d", "", "x a b c d", "a b"]
    hashed, _, _, row, *_ = toxicity.sentences(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    family = toxicity.families(hashed, row, len(texts)).tolist()
    assert family[1] == family[6] and len(set(family[:5])) == 5


def test_logistic_fit_recovers_weights():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < sigmoid(x @ [2.0, -1.0] + 0.5)).astype(int)
    assert logistic_fit(x, y, 1e-6) == pytest.approx([2.0, -1.0, 0.5], abs=0.25)
    assert sigmoid(logistic_fit(x, np.zeros(4000))[-1]) < 0.05
