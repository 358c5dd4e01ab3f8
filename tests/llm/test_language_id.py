import random

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import language_id as g


def test_gradients():
    """Going back through time against differences."""
    net = g.BiGru(["x", "y", "z"], seed=1, hidden=5, embed=4)
    words = [b"abc", b"a", b"hello", "é".encode()]
    target = np.eye(3)[[0, 1, 2, 0]]
    weight = np.array([1.0, 2.0, 0.5, 1.0])
    _, grad = net.loss(words, target, weight)
    r = np.random.default_rng(0)
    for name, x in net.p.items():
        for _ in range(6):
            i = tuple(r.integers(0, s) for s in x.shape)
            if name == "E":
                i = (words[2][int(r.integers(0, 5))], i[1])
            old = x[i]
            x[i] = old + 1e-5
            up = net.loss(words, target, weight)[0]
            x[i] = old - 1e-5
            down = net.loss(words, target, weight)[0]
            x[i] = old
            assert abs((up - down) / 2e-5 - grad[name][i]) < 1e-6, name


def corpus():
    r = random.Random(3)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ent", "ung", "ö"], "cc": ["eau", "ré", "oui", "lle"]}
    rows = []
    for i in range(240):
        lang = r.choice(list(parts))
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60))).capitalize() + ".", lang))
    return rows


def test_held_out_accuracy(docs_of):
    rows = corpus()
    docs = docs_of(rows + [(900, None, "aa"), (901, "12 -- !", "bb"), (902, "", None), (903, "kalo " * 9000, None), (904, "x" * 2000, None)])
    model = g.train_language_id(docs.where("doc_id % 2 = 0 and doc_id < 900"), spans=300)
    got = {r["doc_id"]: r for r in g.identify_language(docs, model).collect()}
    test = [(got[i]["lang_pred"], lang) for i, _, lang in rows if i % 2]
    assert sum(a == b for a, b in test) / len(test) > 0.97
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())


def scalar(net, raw):
    """Labels of every position, a number at a time."""
    from math import exp, tanh

    h, p = net.p["Uf"].shape[0], {k: v.astype(float).tolist() for k, v in net.p.items()}
    both = []
    for d in "fb":
        state, states = [0.0] * h, {}
        for i in range(len(raw)) if d == "f" else range(len(raw) - 1, -1, -1):
            e, w, u, c = p["E"][raw[i]], p[f"W{d}"], p[f"U{d}"], p[f"c{d}"]
            pre = [c[j] + sum(e[k] * w[k][j] for k in range(len(e))) for j in range(3 * h)]
            z, r = ([1 / (1 + exp(-pre[o + j] - sum(state[k] * u[k][o + j] for k in range(h)))) for j in range(h)] for o in (0, h))
            g = [tanh(pre[2 * h + j] + sum(r[k] * state[k] * u[k][2 * h + j] for k in range(h))) for j in range(h)]
            states[i] = state = [(1 - z[j]) * state[j] + z[j] * g[j] for j in range(h)]
        both.append(states)
    out = []
    for i in range(len(raw)):
        y = [exp(p["o"][k] + sum(both[0][i][j] * p["O"][j][k] + both[1][i][j] * p["O"][h + j][k] for j in range(h))) for k in range(len(net.languages))]
        out.append([v / sum(y) for v in y])
    return np.array(out)


def test_labels_equal_a_plain_loop():
    net = g.BiGru(["x", "y", "z"], seed=2).lighter()
    raw = g.folded("Ab 1, cde - É ab zz, 42. The end")[:32]
    assert len(raw) == 32
    want = scalar(net, raw)
    x = np.frombuffer(raw, dtype=np.uint8)[:, None]
    assert np.allclose(net.label(x)[:, 0], want, atol=1e-5)
    assert np.allclose(net.positions([raw])[0][0], want, atol=1e-5)
    letters = g._LETTER[x[:, 0]] > 0
    assert np.allclose(g.pooled(net, [raw])[0], want[letters].mean(axis=0), atol=1e-5)


def test_every_letter_is_counted_once():
    """Texts around the borders of spans; the mean does not depend on what else is read."""
    net = g.BiGru(["x", "y"], seed=3).lighter()
    r = random.Random(1)
    texts = [bytes(r.choice(b"abc 1") for _ in range(n)) for n in (1, 31, 32, 33, 255, 256, 257, 288, 479, 480, 481, 5000)]
    together = g.pooled(net, texts)
    assert np.allclose(together, np.concatenate([g.pooled(net, [t]) for t in texts]), atol=1e-6)
    for t, p in zip(texts, together, strict=True):
        counted = np.zeros(len(t), int)
        for start in g.spans_of(len(t)):
            low, high = (g.CONTEXT if start else 0), (g.SPAN - g.CONTEXT if start + g.SPAN < len(t) else len(t) - start)
            counted[start + low : start + high] += 1
        assert (counted == 1).all()
        assert abs(p.sum() - (1 if any(c in b"abc" for c in t) else 0)) < 1e-5


def test_nothing_to_learn(docs_of):
    docs = docs_of([(1, None, "aa"), (2, "text", None), (2, "text", None)])
    assert g.train_language_id(docs) is None
    clash = docs.withColumn("lang_pred", F.lit("mine"))
    assert [r["lang_pred"] for r in g.identify_language(clash, None).collect()] == ["und"] * 3
