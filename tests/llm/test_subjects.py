"""Subjects of made-up passages: unseen words, single sentences, code, empty texts."""

import random

import numpy as np
import pytest

S = pytest.importorskip("loomgraph.llm.subjects")

SUBJECTS = ("sea", "kitchen", "maths", "yard")
_RNG = random.Random(1)
TERMS = {s: ["".join(_RNG.choice("bdfgklmnprtv") + _RNG.choice("aeiou") for _ in range(4)) for _ in range(50)] for s in SUBJECTS}
FORMS = ("The {} comes after the {}.", "Nobody saw the {} without the {}.", "Every {} has its own {}.", "Most people put the {} next to the {}.", "Is the {} older than the {}?")


def sentence(rng, subject, words=None):
    return rng.choice(FORMS).format(*rng.sample(words or TERMS[subject], 2))


def corpus(rng, n):
    docs, truth = [], set()
    for i in range(n):
        parts = []
        for subject in rng.sample(list(TERMS), 2):
            k = rng.choice((1, 2, 4))
            parts.append(" ".join(sentence(rng, subject) for _ in range(k)))
            if k > 1 and subject != "yard":
                truth.add((i, subject))
        parts.append(f"{TERMS['maths'][0]}_{TERMS['maths'][1]}_count = 3;\n{TERMS['maths'][2]}_{TERMS['maths'][3]} = 4;")
        docs.append((i, "\n\n".join(parts), 1))
    return docs, truth


def examples(rng):
    """Only thirty of the fifty terms of each subject are shown; the everyday words have no label."""
    return [(" ".join(sentence(rng, s, TERMS[s][:30]) for _ in range(3)), s) for s in ("sea", "kitchen", "maths") for _ in range(20)]


def test_unseen_terms_are_learned(spark, monkeypatch):
    monkeypatch.setattr(S, "COMMON_IN", 3)
    rng = random.Random(4)
    docs, truth = corpus(rng, 500)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, subject int")
    ex = spark.createDataFrame(examples(rng), "text string, subject string")
    found = {tuple(r) for r in S.find_subjects(df, ex).collect()}
    right = len(found & truth)
    assert right / len(found) > 0.9 and right / len(truth) > 0.9


def test_empty_inputs(spark):
    ex = spark.createDataFrame([("The oven comes after the whisk. Every oven has its own whisk.", "kitchen"), (None, "sea"), ("x", None)], "text string, subject string")
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (None, "...")], "doc_id bigint, text string")
    assert S.find_subjects(df, ex).count() == 0
    assert S.find_subjects(df.limit(0), ex).count() == 0
    assert S.find_subjects(df, ex.limit(0)).count() == 0


def test_runs_need_two_sentences_of_one_passage():
    subject, of = np.array([1, 1, -1, 1, 2, 2, 2, 0, 0]), np.array([0, 0, 0, 0, 0, 1, 1, 1, 2])
    assert S.passage_runs(subject, of) == {(0, 1), (1, 2)}
    assert S.passage_runs(np.zeros(0, int), np.zeros(0, int)) == set()


def test_paragraphs_and_terms():
    text = "/*\n * One long\n * line. Two.\n */\nint a_b = 3;\n// Three.\n\n* Four.\n1. Five."
    assert ["".join(p.split()) for p in S.paragraphs(text)] == ["Onelongline.Two.", "Three.", "Four.Five."]
    assert S.terms("The steel bridge, and bridges.", frozenset({"the", "and"})) == ["steel bridge", "bridge"]
    assert S.terms("snake_case 3.5 --", frozenset()) is None
    assert S.terms("没有光", frozenset({"没有"})) == ["有光"]
    known = np.zeros(S.PLACES, bool)
    known[S.place("steel bridge")] = True
    assert S.terms("wtih steel bridges", frozenset(), known) == ["steel bridge"]


def test_digamma():
    x = np.array([0.1, 0.5, 1.0, 3.0, 50.0], np.float64)
    assert np.allclose(np.log(S._exp_digamma(x)), [-10.4237549, -1.9635100, -0.5772157, 0.9227843, 3.9019897], atol=1e-5)


def test_one_long_text(spark, monkeypatch):
    monkeypatch.setattr(S, "COMMON_IN", 3)
    rng = random.Random(9)
    long = " ".join(sentence(rng, "maths") for _ in range(4000))
    ex = spark.createDataFrame(examples(rng), "text string, subject string")
    found = S.find_subjects(spark.createDataFrame([(1, long), (2, sentence(rng, "yard"))], "doc_id bigint, text string"), ex).collect()
    assert [(r.doc_id, r.subject) for r in found] == [(1, "maths")]


def copied(rng, subject):
    """A passage of two sentences, the second of terms that no labelled passage shows."""
    return sentence(rng, subject, TERMS[subject][:30]) + " " + sentence(rng, subject, TERMS[subject][30:])


def test_a_third_of_copies_keep_their_subject(spark, monkeypatch):
    monkeypatch.setattr(S, "COMMON_IN", 3)
    rng = random.Random(6)
    docs, truth = corpus(rng, 500)
    text = copied(rng, "kitchen")
    docs += [(i, text, 1) for i in range(500, 750)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, subject int")
    ex = spark.createDataFrame(examples(rng), "text string, subject string")
    found = {tuple(r) for r in S.find_subjects(df, ex).collect()}
    assert {f for f in found if f[0] >= 500} == {(i, "kitchen") for i in range(500, 750)}
    others = {f for f in found if f[0] < 500}
    assert len(others & truth) / len(others) > 0.9 and len(others & truth) / len(truth) > 0.9


def test_ten_documents_keep_their_subjects(spark, monkeypatch):
    monkeypatch.setattr(S, "COMMON_IN", 3)
    rng = random.Random(7)
    text = {s: copied(rng, s) for s in ("sea", "kitchen")}
    docs = [(i, text["sea" if i % 2 else "kitchen"]) for i in range(10)]
    ex = spark.createDataFrame(examples(rng), "text string, subject string")
    found = {tuple(r) for r in S.find_subjects(spark.createDataFrame(docs, "doc_id bigint, text string"), ex).collect()}
    assert found == {(i, "sea" if i % 2 else "kitchen") for i in range(10)}
