"""The toxicity model against naive versions of its parts, and with few labels."""

import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import text_kernel as K
from spindrift.llm import toxicity as X

WORDS = st.lists(st.sampled_from(["idiot", "Ídiot", "stone", "a", "ab", "über", "stones", "idi0t", "北京", "x" * 40]), max_size=70)


def naive_members(word):
    text = f"<{word}>"
    data, offsets = K.lowered(pa.array([word]))
    whole = K.span_hashes(data, np.array([0]), offsets[1:])
    out = [int(whole[0]) % X.BUCKETS]
    for g in X.GRAMS:
        for i in range(len(text) - g + 1):
            d = np.frombuffer(text[i : i + g].encode(), np.uint8)
            out.append(int(K.mix64(K.span_hashes(d, np.array([0]), np.array([len(d)])), g)[0]) % X.BUCKETS)
    return out


def naive_score(model, words):
    starts = [0]
    while starts[-1] + X.WINDOW < len(words):
        starts.append(starts[-1] + X.WINDOW // 2)
    best = -math.inf
    for s in starts if words else []:
        s = max(0, min(s, len(words) - X.WINDOW))
        bag = [m for w in set(words[s : s + X.WINDOW]) for m in naive_members(w)]
        best = max(best, sum(float(model.scores[m]) for m in bag) / max(len(bag), X.FLOOR) + model.bias)
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(WORDS, max_size=5))
def test_scores_are_those_of_plain_windows(texts):
    model = X.Model(np.random.default_rng(0).normal(size=X.BUCKETS), 0.25)
    got = model.score(pa.array([" ".join(t) for t in texts], pa.string()))
    want = [naive_score(model, [w.lower() for w in t]) for t in texts]
    assert np.allclose(got, want, atol=1e-5)


def test_fit_is_full_batch_adam_on_averages():
    rng = np.random.default_rng(2)
    rows, members = 30, 12
    count = rng.integers(0, 3, (rows, members))
    y = rng.integers(0, 2, rows)
    total = np.maximum(count.sum(axis=1) + rng.integers(0, 5, rows), X.FLOOR)
    A = count / total[:, None]
    bag, column = np.nonzero(count)
    start = [rng.normal(0, 0.1, (members, X.DIM)), rng.normal(0, 0.1, (X.DIM, 2)), np.zeros(2)]
    got = [q.astype(np.float32) for q in start]
    X._fit((column, A[bag, column].astype(np.float32)[:, None], np.searchsorted(bag, np.arange(rows + 1)), bag), y, got, 15)
    E, W, b = (q.copy() for q in start)
    state = [[np.zeros_like(q), np.zeros_like(q)] for q in (E, W, b)]
    weight = np.array([1 / (2 * (y == c).sum()) for c in y])
    for t in range(1, 16):
        H = A @ E
        z = H @ W + b
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        dz = (p - np.eye(2)[y]) * weight[:, None]
        for q, g, s in zip((E, W, b), (A.T @ (dz @ W.T) + X.DECAY * E, H.T @ dz + X.DECAY * W, dz.sum(axis=0)), state):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.98 * s[1] + 0.02 * g * g
            q -= X.RATE * s[0] / (1 - 0.9**t) / (np.sqrt(s[1] / (1 - 0.98**t)) + 1e-8)
    for a, q in zip(got, (E, W, b)):
        assert np.allclose(a, q, atol=2e-3)


def test_each_fold_is_scored_by_the_fit_that_did_not_see_it():
    texts = pa.array([("you utter snorkwad " if i % 2 else "a calm river ") + f"and word{i} " * 3 for i in range(80)])
    y, fold = np.arange(80) % 2, np.arange(80) // 2 % X.FOLDS
    model, score = X.fold_fit(texts, y, fold, 1)
    again = X.fitted(texts.filter(pa.array(fold != 1)), y[fold != 1], seed=1)
    assert np.allclose(model.scores, again.scores) and np.allclose(score, again.score(texts.filter(pa.array(fold == 1))))
    whole = X.train(texts, y)
    assert ((whole.score(texts) > whole.threshold) == y).all()


def test_labels_of_absent_documents_do_not_use_up_the_bound(spark):
    docs = spark.createDataFrame([(i, ("you utter snorkwad " if i % 2 else "a calm river ") + "and other words " * 3) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(-5000, 60)], "doc_id long, quality int, toxic int")
    model = X.trained(docs, labels, per_class=30)
    assert sorted(r.doc_id for r in X.toxic_documents(docs, model).collect()) == list(range(1, 60, 2))


def test_few_labels_leave_clean_documents_alone(spark, docs):
    """On the smallest labels, 45 toxic ones, three quarters train and the rest is judged."""
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = sorted((r.doc_id, r.toxic) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.doc_id in text)
    held = np.array([d * 2654435761 % 2**32 % 4 == 0 for d, _ in rows])
    y, texts = np.array([t for _, t in rows]), pa.array([text[d] for d, _ in rows])
    model = X.train(texts.filter(pa.array(~held)), y[~held])
    flagged = model.score(texts) > model.threshold
    assert flagged[held & (y == 0)].mean() < 0.05 and flagged[held & (y == 1)].mean() > 0.2
    assert flagged[~held & (y == 0)].mean() < 0.05
