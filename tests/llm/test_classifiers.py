import random

import numpy as np
import pytest

from tabmend.llm.queries import op1_toxicity_fm, op5_quality_nbsvm
from tabmend.llm.quality import NaiveBayesSupportVectors, ngram_features, quality_scores
from tabmend.llm.toxicity import FactorizationMachine, decided, term_features, toxicity_scores

from .conftest import WORDS


def labelled(n, mark):
    """Texts of which those with label 1 hold one of ten marked words with endings never seen twice."""
    rng = random.Random(4)
    texts, y = [], []
    for i in range(n):
        words = [f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(60)]
        label = int(rng.random() < 0.25)
        if label:
            words[rng.randrange(60)] = f"{mark}{rng.randrange(10**6)}"
        texts.append(" ".join(words))
        y.append(label)
    return texts, np.array(y)


def test_factorization_machine_finds_marked_words_held_out():
    texts, y = labelled(900, "insul")
    f = term_features()
    rows = [f(t) for t in texts]
    model = FactorizationMachine().fit(y[:600], rows[:600])
    predicted = np.array([model.score(r) >= 0.3 for r in rows[600:]])
    assert (predicted == y[600:]).mean() > 0.97


def test_factorization_machine_learns_pairs():
    rng = random.Random(5)
    rows, y = [], []
    f = term_features()
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join([rng.choice(WORDS), *(["aaa"] if a else []), *(["bbb"] if b else [])])
        rows.append(f(text))
        y.append(int(a and b))
    model = FactorizationMachine(epochs=40).fit(np.array(y), rows)
    assert model.score(f("alpha aaa bbb")) > 0.5 > max(model.score(f("alpha aaa")), model.score(f("alpha bbb")), model.score(f("alpha")))


def test_support_vectors_tell_junk_held_out():
    rng = random.Random(6)
    texts, y = [], []
    for i in range(400):
        words = [f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(60)]
        kind = rng.randrange(6)
        y.append(int(kind > 1))
        texts.append(" ".join([words[0]] * 40 if kind == 0 else [w + "$$$" for w in words] if kind == 1 else words))
    f = ngram_features()
    rows = [f(t) for t in texts]
    model = NaiveBayesSupportVectors().fit(np.array(y[:250]), rows[:250])
    assert np.mean([(model.score(r) >= 0.7) == v for r, v in zip(rows[250:], y[250:], strict=True)]) > 0.97
    assert f("").size == 0 and 0 <= model.score(f("")) <= 1


def test_models_without_rows_or_with_one_class():
    for model in (FactorizationMachine(), NaiveBayesSupportVectors()):
        model.fit(np.array([], np.int8), [])
        assert 0 <= model.score(np.array([1, 2], np.int32)) <= 1
    rows = [np.array([1, 2], np.int32)] * 60
    for label in (0, 1):
        for model in (FactorizationMachine(), NaiveBayesSupportVectors()):
            model.fit(np.full(60, label, np.int8), rows)
            assert 0 <= model.score(rows[0]) <= 1


@pytest.mark.parametrize(("scores", "label"), [(toxicity_scores, "toxic"), (quality_scores, "quality")])
def test_odd_rows_and_repeatable_scores(spark, make_docs, odd_rows, scores, label):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (7, 0), (None, 1), (99, 1), (8, None)], f"doc_id long, {label} int")
    out = decided(scores(docs, docs, labels, out="score"), 0.3)
    rows = out.collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    same = [r["score"] for r in rows if r["text"] == odd_rows[3][1]]
    assert len(same) == 4 and len(set(same)) == 1
    again = [r["score"] for r in scores(docs, docs, labels, out="score").collect()]
    assert again == [r["score"] for r in rows]
    assert set(docs.columns) < set(out.columns)
    assert scores(make_docs([]), docs, labels).collect() == []
    assert len(scores(docs, docs, labels.limit(0)).collect()) == len(odd_rows)


@pytest.mark.parametrize(
    ("query", "make", "model", "label", "threshold"),
    [(op1_toxicity_fm, term_features, FactorizationMachine, "toxic", 0.3), (op5_quality_nbsvm, ngram_features, NaiveBayesSupportVectors, "quality", 0.7)],
)
def test_queries_equal_a_plain_fit_and_tell_held_out_texts(spark, tmp_path, fold, query, make, model, label, threshold):
    texts, y = labelled(500, "insul")
    if label == "quality":
        y = 1 - y
        texts = [t if good else " ".join(f"{w}$$" for w in t.split()) for t, good in zip(texts, y, strict=True)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, int(v), int(v)) for i, v in enumerate(y)] + [(5000 + i, 1, 1) for i in range(50)]  # labels of documents that aren't there
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r["doc_id"]: r for r in query(spark, str(tmp_path)).collect()}
    assert len(out) == len(docs)

    features = make()
    sample = sorted((int(y[i]), features(t).tobytes()) for i, t in enumerate(texts) if fold(i, 4) != 2)
    plain = model().fit(np.array([v for v, _ in sample], np.int8), [np.frombuffer(x, np.int32) for _, x in sample])
    for i, text, *_ in docs:
        assert out[i]["score"] == pytest.approx(plain.score(features(text or "")), abs=1e-12)
        assert (out[i]["held_out"], out[i]["predicted"]) == (fold(i, 4) == 2, int(out[i]["score"] >= threshold))
    held = [i for i in range(len(texts)) if fold(i, 4) == 2]
    assert np.mean([out[i]["predicted"] == y[i] for i in held]) > 0.97
