import random

import numpy as np

from ledgerline.llm import toxicity as t


def test_ordinal_fit_recovers_grades():
    r = np.random.default_rng(0)
    true = np.array([2.0, 1.0, -1.0, 0.5])
    x = r.poisson(1.0, (4000, 4)).astype(float)
    cuts = np.array([0.5, 2.0, 4.0])
    grade = ((x @ true)[:, None] + r.logistic(size=(4000, 1)) > cuts[None, :]).sum(axis=1)
    row, feature = np.nonzero(x)
    w, cut = t.fit_ordinal(row, feature, x[row, feature], grade, np.ones(4000), 4, 4, steps=1500)
    assert np.allclose(w, true, atol=0.2) and np.allclose(cut, cuts, atol=0.3) and (np.diff(cut) > 0).all()
    model = t.OrdinalModel(np.arange(4), w, cut)
    above = model.at_least(x @ w)
    assert (np.diff(above, axis=1) <= 0).all() and np.corrcoef(above.sum(axis=1), grade)[0, 1] > 0.7


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(n):
        grade = r.choice([0, 0, 0, 1, 2])
        words = [word() for _ in range(40)]
        for _ in range(grade * 3):
            words[r.randrange(40)] = r.choice(["zorble", "zorbled", "vexnik"]) + word()[: r.randrange(3)]
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_accuracy(spark, docs_of):
    rows = corpus(1200, 1)
    docs = docs_of([(i, text) for i, text, _ in rows])
    grades = spark.createDataFrame([(i, g) for i, _, g in rows if i % 2], "doc_id long, grade int")
    model = t.fit_toxicity(docs, grades, sample=400)
    got = {r["doc_id"]: r for r in t.score_toxicity(docs, model).collect()}
    test = [(got[i], g) for i, _, g in rows if i % 2 == 0]
    assert sum(r["toxic"] == (g > 0) for r, g in test) / len(test) > 0.97
    mean = lambda k: np.mean([r["severity"] for r, g in test if g == k])
    assert mean(0) < 0.2 < mean(1) < mean(2)


def test_without_labels_and_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "a"), (2, "")])
    none = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, grade int")
    assert t.fit_toxicity(docs, none) is None
    assert [r["severity"] for r in t.score_toxicity(docs, None).collect()] == [0.0] * 4
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    assert [r["grade"] for r in t.label_grades(labels).collect()] == [0, 1, 2, None, 1]
    kept = t.keep_clean(docs.withColumnRenamed("lang", "toxic"), labels.limit(0))
    assert kept.count() == 4 and "toxic" in kept.columns


def test_scores_equal_a_plain_loop(spark, docs_of):
    """Severity and probability of each row, a word at a time."""
    from math import exp, log1p

    r = np.random.default_rng(4)
    words = ["alpha", "beta", "Gamma", "delta9", "épsilon", "ze"]
    feats = sorted({f for w in words for f in t.word_features(w.encode().translate(t._LETTERS).split()[0])})
    model = t.OrdinalModel(np.array(feats), r.normal(size=len(feats)), np.array([0.3, 1.1]))
    rows = [(i, " ".join(r.choice(words, r.integers(0, 12)))) for i in range(60)] + [(90, None), (91, ""), (92, "none of these"), (92, "none of these")]
    got = sorted((x["doc_id"], x["severity"], x["p_toxic"], x["toxic"]) for x in t.score_toxicity(docs_of(rows), model).collect())
    want = []
    for key, text in rows:
        counts = {}
        for w in t.words_of(text):
            for f in t.word_features(w):
                counts[f] = counts.get(f, 0) + 1
        score = sum(model.weights[feats.index(f)] * log1p(n) for f, n in counts.items() if f in feats)
        p = [1 / (1 + exp(c - score)) for c in model.thresholds]
        want.append((key, sum(p), p[0], p[0] >= 0.5))
    want.sort()
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 and abs(a[2] - b[2]) < 1e-9 and a[3] == b[3]
