"""The trained operators: held-out results on the given tables, odd rows, and the same models by brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clerkwise.llm import language as la
from clerkwise.llm import quality as qu
from clerkwise.llm import toxicity as tx
from clerkwise.llm.language import fit_language, identify_language
from clerkwise.llm.quality import fit_quality, keep_good, pool_adjacent, score_quality
from clerkwise.llm.registry import queries
from clerkwise.llm.toxicity import fit_toxicity, score_toxicity, train
from clerkwise.llm.text_arrays import Powers

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None, 1, "a"), (2, "", 1, "b"), (3, "123 ... \n", 1, None), (4, "日本語", 1, "c"), (5, "x" * 300_000, 1, "d"), (5, "x" * 300_000, 1, "d"), (None, "some words", 2, "e")]
SCHEMA = "doc_id long, text string, score int, lang_pred string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_language(spark, odd):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = queries()["op1_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id")
    hit = [r["lang"] == r["lang_pred"] for r in out.where("held_out").collect()]
    assert len(hit) > 150 and np.mean(hit) > 0.97
    model = fit_language(docs.limit(200), per_language=20, landmarks_per_language=5)
    got = identify_language(odd, model).collect()
    assert len(got) == len(ODD)
    assert [r["lang_pred"] == "und" for r in got] == [True, True, True, False, False, False, False]
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = fit_language(docs.limit(0))
    assert {r["lang_pred"] for r in identify_language(odd, nothing).collect()} == {"und"}
    assert identify_language(odd.limit(0), model).count() == 0


def test_toxicity(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learn, test = labels.where("crc32(cast(doc_id as string)) % 5 <> 0"), labels.where("crc32(cast(doc_id as string)) % 5 = 0")
    model = fit_toxicity(docs, learn.select("doc_id", "toxic"), positives=300, unlabelled=1500, words=300, steps=200)
    out = score_toxicity(docs, model).join(test, "doc_id").collect()
    toxic = [r["predicted"] for r in out if r["toxic"] == 1]
    clean = [r["predicted"] for r in out if r["toxic"] == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.02
    got = score_toxicity(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]
    none = fit_toxicity(docs, labels.select("doc_id", "toxic").where("toxic = 0"))
    assert {r["predicted"] for r in score_toxicity(odd, none).collect()} == {0}
    assert score_toxicity(odd.limit(0), model).count() == 0


def test_risk_correction():
    """A third of the unlabelled rows are positive; the corrected risk still finds the border."""
    rnd = np.random.default_rng(3)
    positive, negative = rnd.normal(2, 1, (300, 2)), rnd.normal(-2, 1, (400, 2))
    unlabelled = np.concatenate([rnd.normal(2, 1, (200, 2)), negative])
    weights, bias = train(positive, unlabelled, 1 / 3, 400)
    assert ((positive @ weights + bias) > 0).mean() > 0.95 and ((negative @ weights + bias) > 0).mean() < 0.05


def test_quality(spark, odd):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = queries()["op8_quality"](spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.95
    model = fit_quality(docs, labels.select("doc_id", "quality"))
    got = score_quality(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]
    left = keep_good(odd, model)
    assert left.columns == odd.columns and left.count() == sum(r["predicted"] for r in got)
    blank = fit_quality(docs, labels.select("doc_id", "quality").limit(0))
    assert {r["score"] for r in score_quality(odd, blank).collect()} == {0.5}
    assert score_quality(odd.limit(0), model).count() == 0


def test_pooling():
    value, weight = np.array([0.1, 0.5, 0.2, 0.2, 0.9, 0.8]), np.array([1.0, 1, 1, 2, 1, 3])
    got = pool_adjacent(value, weight)
    assert (np.diff(got) >= 0).all() and np.isclose((got * weight).sum(), (value * weight).sum())
    assert np.allclose(got[1:4], 1.1 / 4)


def grams(text):
    """Slots of all 1- to 4-byte strings of the lower-cased text."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return {int(s) for slots in la.gram_slots(data) for s in slots}


def test_language_equals_a_dense_kernel(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 400")
    model = fit_language(docs, per_language=15, landmarks_per_language=6)
    place = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("p")).collect()}
    rows = sorted((r for r in docs.collect() if r["text"] and r["lang"]), key=lambda r: place[r["doc_id"]])
    languages = sorted({r["lang"] for r in rows})
    # Of each language the ids of the lowest hashes, below a threshold that lets half as many more pass.
    share = {k: 1.5 * 15 / sum(r["lang"] == k for r in rows) for k in languages}
    low = [r for r in rows if (place[r["doc_id"]] / 2.0 ** 63 + 1) / 2 <= share[r["lang"]]]
    learned = [[grams(r["text"]) for r in low if r["lang"] == k][:15] for k in languages]
    texts = [(g, j) for j, mine in enumerate(learned) for g in mine]
    marks = [g for mine in learned for g in mine[:6]]

    def kernel(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b))

    k_tm = np.array([[kernel(t, m) for m in marks] for t, _ in texts])
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    weight = np.array([1 / len(learned[j]) for _, j in texts])
    target = np.array([[1.0 if j == k else -1.0 for k in range(len(languages))] for _, j in texts])
    alpha = np.linalg.solve(k_tm.T @ (k_tm * weight[:, None]) + 1e-2 * k_mm + 1e-6 * np.eye(len(marks)), k_tm.T @ (target * weight[:, None]))
    some = docs.orderBy("doc_id").limit(60)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_language(some, model).collect()}
    for r in some.collect():
        if re.search(r"[^\W\d_]", r["text"] or ""):
            value = np.array([kernel(grams(r["text"]), m) for m in marks]) @ alpha
            chance = np.exp(4 * value) / np.exp(4 * value).sum()
            assert got[r["doc_id"]][0] == languages[int(value.argmax())] and abs(got[r["doc_id"]][1] - chance.max()) < 1e-4


def test_rare_languages_and_repeated_ids_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"same {k % 2}", "xx") for k in range(50)] + [(k, "ab cd ef", f"l{k:02d}") for k in range(20)], "doc_id long, text string, lang string")
    model = fit_language(docs, most_languages=5, most_texts=10, most_landmarks=5)
    assert model.languages == ("l00", "l01", "l02", "l03", "xx")
    assert identify_language(docs, model).count() == 70


def test_risk_and_training_equal_plain_loops():
    """The non-negative risk, its corrected gradient and Adam, one number at a time."""
    rnd = np.random.default_rng(1)
    positive, unlabelled, prior = (rnd.random((7, 3)) < 0.6).astype(float), (rnd.random((11, 3)) < 0.4).astype(float), 0.45
    theta, first, second, undone = [0.0, 0.0, 0.0, np.log(prior / (1 - prior))], [0.0] * 4, [0.0] * 4, 0
    for step in range(1, 61):
        def chance(x):
            return 1 / (1 + np.exp(-(sum(a * b for a, b in zip(x, theta, strict=False)) + theta[3])))

        loss_p = np.mean([-np.log(1 - chance(x)) for x in positive])
        loss_u = np.mean([-np.log(1 - chance(x)) for x in unlabelled])
        risk = [0.0] * 4
        for d in range(4):
            def part(rows, residual, d=d):
                return np.mean([residual(chance(x)) * (x[d] if d < 3 else 1.0) for x in rows])

            negative = part(unlabelled, lambda c: c) - prior * part(positive, lambda c: c)
            if loss_u - prior * loss_p < 0:
                risk[d] = -negative
                undone += 1
            else:
                risk[d] = prior * part(positive, lambda c: c - 1) + negative
            risk[d] += 1e-4 * theta[d] if d < 3 else 0
        for d in range(4):
            first[d] = 0.9 * first[d] + 0.1 * risk[d]
            second[d] = 0.999 * second[d] + 0.001 * risk[d] ** 2
        theta = [t - 0.1 * (f / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8) for t, f, s in zip(theta, first, second, strict=True)]
    weights, bias = train(positive, unlabelled, prior, 60)
    assert np.allclose([*weights, bias], theta, atol=1e-6)


def test_toxicity_scores_are_sums_over_distinct_words(spark):
    words = ["idiots", "idiot", "weather", "fine", "Fine", "ä"]

    def slots(text):
        found, _ = tx.word_slots(pa.record_batch([pa.array([text])], ["text"]), Powers())
        return set(found.tolist())

    known = sorted(slots("idiots") | slots("fine"))
    model = tx.ToxicityModel(np.array(known), np.linspace(-1, 2, len(known)), -0.5)
    weight = dict(zip(known, model.weights.tolist(), strict=True))
    rnd = np.random.default_rng(2)
    texts = [" ".join(rnd.choice(words, rnd.integers(0, 9))) for _ in range(40)]
    got = {r["doc_id"]: r["score"] for r in score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    for i, t in enumerate(texts):
        held = set().union(*[slots(w) for w in t.split()]) if t else set()
        assert abs(got[i] - 1 / (1 + np.exp(0.5 - sum(weight.get(s, 0) for s in held)))) < 1e-9


def test_unlabelled_texts_may_come_from_all_documents(spark):
    docs = spark.createDataFrame([(k, "vile words here" if k < 8 else f"plain text {k % 7}") for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k < 4 else 0) for k in (0, 1, 2, 3, 10, 11)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels, prior=0.1, words=20, pool=docs)
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    assert min(got[k] for k in range(8)) > max(got[k] for k in range(8, 80))
    # One text of a hot id is learned from.
    hot = docs.unionAll(spark.range(300).selectExpr("cast(1 AS bigint) AS doc_id", "concat('vile ', id) AS text"))
    assert len(fit_toxicity(hot, labels, prior=0.1, words=20, pool=docs).slots) > 0


def test_quality_equals_one_least_squares_solve(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 600")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality").where("doc_id < 600")
    model = fit_quality(docs, labels, features=40)
    rows = docs.join(labels, "doc_id").select("text", "quality").collect()
    stats = np.concatenate([qu.statistics(pa.record_batch([pa.array([r["text"]], pa.string())], ["text"]), Powers()) for r in rows])
    y = np.array([float(r["quality"]) for r in rows])
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.scale, np.maximum(stats.std(axis=0), 0.02))
    z = np.array([[np.cos(sum((s[d] - model.mean[d]) / model.scale[d] * model.waves[d, k] for d in range(len(s))) + model.phases[k]) * np.sqrt(2 / 40) for k in range(40)] + [1.0]
                  for s in stats])
    # Ridge regression as least squares with a row for each penalty.
    extra = np.sqrt(1e-3 * len(y) / 40) * np.eye(41)
    weights = np.linalg.lstsq(np.concatenate([z, extra]), np.concatenate([y, np.zeros(41)]), rcond=None)[0]
    assert np.allclose(model.weights, weights, atol=1e-6)


def test_pooling_equals_the_minimax_formula():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        value, weight = rnd.random(9), rnd.integers(1, 5, 9).astype(float)
        mean = lambda a, b: (value[a:b] * weight[a:b]).sum() / weight[a:b].sum()
        want = [max(min(mean(a, b) for b in range(i + 1, 10)) for a in range(i + 1)) for i in range(9)]
        assert np.allclose(pool_adjacent(value, weight), want)
