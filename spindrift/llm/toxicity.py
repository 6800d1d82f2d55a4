"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in NumPy.

A word is the bag of its character n-grams of 3 to 5 characters, with ``<`` and ``>``
around the word, and of the whole word; every member has an embedding in a hashed table.
A text is the average of the embeddings of all its members, and two linear outputs with a
softmax give its probability of being toxic.  Embeddings and outputs are trained together,
full-batch with Adam, from documents with labels.  A misspelling that training hasn't seen
shares most n-grams with the word it comes from.

The model is trained from a sample of labelled documents: the ``per_class`` documents of
either class with the least hash of doc_id, and ``FIRST`` of their windows in the first
round.  These are the only bounded things here and documented parameters.  Every document
is scored, over its whole text.

Average over a long text drowns a toxic sentence, so a document is scored by windows of
``WINDOW`` words, half overlapping, and by its worst window.  A window's average is over the
members of its distinct words, and over ``FLOOR`` members at least, so that a text of two
words needs stronger evidence than a sentence.

The model is cross-fitted: the sample is cut into ``FOLDS`` parts, each fit leaves one out,
and the folds' fits, made by ``FIT_TASKS`` tasks, are averaged, which is one linear model again.  The
threshold is the middle of the widest range of scores that does best on documents scored by
the fit that didn't see them.

As the outputs are linear, scoring needs one number for each member, the difference of its
two logits; words are scored once in each slice of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import text_kernel as K
from spindrift.shipping import ship

PER_CLASS = 2000
BUCKETS = 1 << 18
DIM = 8
WINDOW = 16
EPOCHS = 12
FIRST = 16_000
FOLDS = 4
FIT_TASKS = 2  # so that an executor need not hold two fits at once
ROUNDS = 8
FLOOR = 96
RATE = 0.1
DECAY = 1e-4
LEAST = 5
GRAMS = (3, 4, 5)
# how much is worked on at a time, which bounds memory and changes nothing
SOME_WORDS, SOME_WINDOWS, SOME_RANGES = 1 << 14, 1 << 14, 1 << 11


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed members of words given as byte spans, grouped by word, and the offsets; some
    words at a time."""
    members, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for a in range(0, len(starts), SOME_WORDS):
        part = slice(a, a + SOME_WORDS)
        got, offs = _subwords(data, starts[part], ends[part], hashes[part])
        members.append(got)
        counts.append(np.diff(offs))
    return np.concatenate(members), np.cumsum(np.concatenate(counts))


def _subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(starts)
    size = ends - starts + 2
    base = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=base[1:])
    text = np.empty(int(base[-1]), np.uint8)
    text[base[:-1]] = ord("<")
    text[base[1:] - 1] = ord(">")
    inner = size - 2
    at = np.repeat(base[:-1] + 1 - (np.cumsum(inner) - inner), inner) + np.arange(inner.sum())
    text[at] = data[np.repeat(starts - (np.cumsum(inner) - inner), inner) + np.arange(inner.sum())]
    first = np.flatnonzero((text & 0xC0) != 0x80)  # where characters begin
    word = np.searchsorted(base, first, side="right") - 1
    stop = np.append(first, len(text))
    members, owners = [hashes], [np.arange(n)]
    for g in GRAMS:
        last = np.arange(len(first) - g + 1)
        last = last[word[last] == word[last + g - 1]]
        members.append(K.mix64(K.span_hashes(text, first[last], stop[last + g]), g))
        owners.append(word[last])
    member, owner = np.concatenate(members), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (member % np.uint64(BUCKETS)).astype(np.int32)[order], np.searchsorted(owner[order], np.arange(n + 1))


def parsed(texts: pa.Array):
    """Distinct words' members and offsets, each word's place among them, row offsets."""
    data, offsets = K.lowered(texts)
    starts, ends, rows = K.word_spans(data, offsets)
    hashes = K.span_hashes(data, starts, ends)
    distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    order = np.argsort(first)  # spans must be in the order of the text
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first = first[order]
    members, offs = subwords(data, starts[first], ends[first], hashes[first])
    return members, offs, rank[place], rows


class Model:
    """Logit differences of members, bias, and the threshold on a document's worst window."""

    def __init__(self, scores: np.ndarray, bias: float, threshold: float = 0.0):
        self.scores, self.bias, self.threshold = scores.astype(np.float32), float(bias), float(threshold)

    def windows(self, members, offs, place, rows):
        """Logits of all windows, their word ranges, and the rows' first windows."""
        weight = np.diff(offs).astype(np.float64)
        value = np.add.reduceat(self.scores[members], offs[:-1], dtype=np.float64)
        lo, hi, at = word_windows(rows)
        before, out = previous(place, rows), np.empty(len(lo))
        for a in range(0, len(lo), SOME_WINDOWS):
            part = slice(a, a + SOME_WINDOWS)
            word, begin = new_words(lo[part], hi[part], before)
            word = place[word]
            out[part] = np.add.reduceat(value[word], begin) / np.maximum(np.add.reduceat(weight[word], begin), FLOOR)
        return out + self.bias, lo, hi, at

    def worst(self, members, offs, place, rows):
        """Word range of each row's worst window; an empty range where there are no words."""
        value, lo, hi, at = self.windows(members, offs, place, rows)
        order = np.lexsort((-value, np.repeat(np.arange(len(rows) - 1), np.diff(at))))
        some = np.diff(at) > 0
        a, b = rows[:-1].copy(), rows[:-1].copy()
        first = order[at[:-1][some]]
        a[some], b[some] = lo[first], hi[first]
        return a, b

    def score(self, texts: pa.Array) -> np.ndarray:
        """Worst window's logit of each text; -inf for a text without words."""
        members, offs, place, rows = parsed(texts)
        out = np.full(len(rows) - 1, -np.inf)
        if len(place):
            value, _, _, at = self.windows(members, offs, place, rows)
            some = np.flatnonzero(np.diff(at))
            out[some] = np.maximum.reduceat(value, at[some])
        return out


def word_windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges of the windows of all rows, and the rows' offsets into the windows."""
    n = np.diff(rows)
    half = WINDOW // 2
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // half) + 1), 0)
    ends = np.cumsum(count)
    k = np.arange(ends[-1]) - np.repeat(ends - count, count)
    first, stop = np.repeat(rows[:-1], count), np.repeat(rows[1:], count)
    lo = first + k * half
    hi = np.minimum(lo + WINDOW, stop)
    return np.maximum(first, np.minimum(lo, hi - WINDOW)), hi, np.append(0, ends)


def previous(place: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the text had each word before, -1 for a word's first time."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((row, place)) if len(rows) > 2 else np.argsort(place, kind="stable")
    before = np.full(len(place), -1, np.int64)
    a, b = order[:-1], order[1:]
    again = (place[a] == place[b]) & (row[a] == row[b])
    before[b[again]] = a[again]
    return before


def new_words(lo: np.ndarray, hi: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the ranges [lo, hi), each distinct word of a range once, and where each
    range begins among them."""
    n = hi - lo
    word = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    new = before[word] < np.repeat(lo, n)
    begin = np.concatenate([[0], np.cumsum(np.add.reduceat(new, np.cumsum(n) - n, dtype=np.int64))])[:-1] if len(n) else np.zeros(0, np.int64)
    return word[new], begin


def _bags(lo: np.ndarray, hi: np.ndarray, place: np.ndarray, before: np.ndarray, members: np.ndarray, offs: np.ndarray, known: np.ndarray):
    """Averages as sparse rows: for word ranges [lo, hi), none empty, the known members'
    columns, their shares of all members of the range, the offsets of the ranges, and each
    entry's range; some ranges at a time."""
    columns, shares, bags = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [np.zeros(0, np.int32)]
    width = int(known.max()) + 2
    for a in range(0, len(lo), SOME_RANGES):
        part = slice(a, a + SOME_RANGES)
        word, begin = new_words(lo[part], hi[part], before)
        bag = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(word))))
        word = place[word]
        size = np.diff(offs)[word]
        total = np.bincount(bag, size, len(begin))
        column = known[members[np.repeat(offs[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())]]
        bag = np.repeat(bag, size)
        key = np.sort((bag * width + column)[column >= 0])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(key)))
        bag = key[first] // width
        columns.append((key[first] % width).astype(np.int32))
        shares.append((times / np.maximum(total, FLOOR)[bag]).astype(np.float32))
        bags.append((bag + a).astype(np.int32))
    bag = np.concatenate(bags)
    return np.concatenate(columns), np.concatenate(shares)[:, None], np.searchsorted(bag, np.arange(len(lo) + 1)), bag


def _gathered_sums(table: np.ndarray, index: np.ndarray, share: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``table[index] * share`` over the runs between offsets, some entries at a time."""
    out = np.zeros((len(offsets) - 1, table.shape[1]), np.float32)
    for a, b in K.slices(offsets, 1 << 15):
        lo, hi = offsets[a], offsets[b]
        some = np.flatnonzero(np.diff(offsets[a : b + 1]))
        if len(some):
            out[a + some] = np.add.reduceat(table[index[lo:hi]] * share[lo:hi], offsets[a + some] - lo)
    return out


def _fit(bags, y: np.ndarray, params, epochs: int) -> None:
    """Adam over all bags; embeddings, outputs and bias change in place."""
    column, share, at, bag = bags
    E, W, b = params
    by_column = np.argsort(column, kind="stable").astype(np.int32)
    column_at = np.searchsorted(column[by_column], np.arange(len(E) + 1))
    bag, share_of = bag[by_column], share[by_column]
    del by_column
    state = [(np.zeros_like(q), np.zeros_like(q)) for q in params]
    target = np.eye(2, dtype=np.float32)[y]
    balance = (1 / (2 * np.maximum(1, np.bincount(y, minlength=2))))[y][:, None]
    for t in range(1, epochs + 1):
        H = _gathered_sums(E, column, share, at)
        z = H @ W + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        dz = ((p - target) * balance).astype(np.float32)
        dE = _gathered_sums(dz @ W.T, bag, share_of, column_at) + DECAY * E
        for q, g, (m, v) in zip(params, (dE, H.T @ dz + DECAY * W, dz.sum(axis=0)), state):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            q -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)


def fitted(texts: pa.Array, toxic: np.ndarray, *, epochs: int = EPOCHS, seed: int = 0) -> Model | None:
    """One fit on labelled texts, without a threshold; none without words of both classes.

    Members that fewer than ``LEAST`` training documents have are left out.  The first
    round learns from ``FIRST`` windows in all, evenly drawn from the documents, the others
    from the worst window of each document under the model so far, which is what scoring
    looks at.
    """
    y = np.asarray(toxic, dtype=np.int64)
    members, offs, place, rows = parsed(texts)
    filled = np.diff(rows) > 0
    if len(np.unique(y[filled])) < 2:
        return None
    rng = np.random.default_rng(seed)
    before = previous(place, rows)
    doc_word = np.unique(np.repeat(np.arange(len(y)), np.diff(rows)) * (len(offs) - 1) + place)
    times = np.bincount(doc_word % (len(offs) - 1), minlength=len(offs) - 1)
    common = np.bincount(members, np.repeat(times, np.diff(offs)), BUCKETS) >= LEAST
    known = np.where(common, np.cumsum(common) - 1, -1)
    if not common.any():
        return None
    params = (
        rng.normal(0, 0.1, (int(common.sum()), DIM)).astype(np.float32),
        rng.normal(0, 0.1, (DIM, 2)).astype(np.float32),
        np.zeros(2, np.float32),
    )
    scores = np.zeros(BUCKETS)
    # the first round: some windows of each document, all with its label
    lo, hi, at = word_windows(rows)
    of = np.repeat(np.arange(len(y)), np.diff(at))
    drawn = rng.permutation(len(lo))
    turn = np.empty(len(lo), np.int64)  # how many of its document were drawn before
    drawn = drawn[np.argsort(of[drawn], kind="stable")]
    turn[drawn] = np.arange(len(lo)) - at[of[drawn]]
    some = np.sort(np.lexsort((of, turn))[:FIRST])
    word_range, label = (lo[some], hi[some]), y[of[some]]
    docs = np.flatnonzero(filled)
    clean = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(ROUNDS + 1):
        _fit(_bags(*word_range, place, before, members, offs, known), label, params, epochs)
        scores[common] = params[0] @ (params[1][:, 1] - params[1][:, 0])
        model = Model(scores, params[2][1] - params[2][0])
        if k < ROUNDS:  # windows of clean documents that were the worst once stay
            lo, hi = (x[docs] for x in model.worst(members, offs, place, rows))
            word_range = np.concatenate([lo, clean[0]]), np.concatenate([hi, clean[1]])
            label = np.append(y[docs], np.zeros(len(clean[0]), np.int64))
            clean = word_range[0][label == 0], word_range[1][label == 0]
    return model


def fold_fit(texts: pa.Array, toxic: np.ndarray, fold: np.ndarray, k: int, **options) -> tuple[Model | None, np.ndarray]:
    """A fit without the documents of fold ``k``, and the scores that it gives those."""
    own = pa.array(fold == k)
    model = fitted(texts.filter(pa.array(fold != k)), toxic[fold != k], seed=k, **options)
    held = texts.filter(own)
    return model, model.score(held) if model else np.full(len(held), -np.inf)


def averaged(models: list[Model], score: np.ndarray, toxic: np.ndarray) -> Model:
    """The mean of the folds' linear scores, which is one model again, with the threshold
    that suits the scores of documents under the fit that didn't see them."""
    if not models:
        return nothing()
    scores = np.mean([m.scores for m in models], axis=0)
    return Model(scores, np.mean([m.bias for m in models]), best_threshold(score, toxic))


def nothing() -> Model:
    """A model that finds nothing toxic."""
    return Model(np.zeros(BUCKETS), 0.0, np.inf)


def train(texts: pa.Array, toxic: np.ndarray, **options) -> Model:
    """Cross-fitted model of labelled texts.  Without both classes nothing is ever toxic."""
    toxic = np.asarray(toxic, dtype=np.int64)
    fold = np.zeros(len(toxic), np.int64)
    for c in (0, 1):
        fold[toxic == c] = np.arange((toxic == c).sum()) % FOLDS
    fits = [fold_fit(texts, toxic, fold, k, **options) for k in range(FOLDS)]
    used = [k for k in range(FOLDS) if fits[k][0]]
    held = [np.flatnonzero(fold == k) for k in used]
    return averaged([fits[k][0] for k in used], np.concatenate([fits[k][1] for k in used] or [[]]), toxic[np.concatenate(held or [np.zeros(0, np.int64)])])


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap between scores where balanced accuracy is highest; of several such
    gaps the widest.  Infinite where one of the classes has no score."""
    finite = np.isfinite(score)
    score, y = score[finite], y[finite]
    if len(np.unique(y)) < 2:
        return np.inf
    order = np.argsort(score, kind="stable")
    score, y = score[order], y[order]
    good = np.cumsum(1 - y) / (1 - y).sum() + (1 - np.cumsum(y) / y.sum())
    gap = np.append(np.diff(score), 0)
    good[:-1][gap[:-1] <= 0] = -np.inf
    best = np.flatnonzero(good >= good.max() - 1e-12)
    k = best[np.argmax(gap[best])]
    return float(score[k] + gap[k] / 2)


def trained(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> Model:
    """Cross-fitted on the ``per_class`` labelled documents of either class with least hashes.

    Labels other than 0 and 1, labels without a document and null texts aren't used and
    don't count towards the bound; rows that repeat a doc_id are used each.  A document
    with several labels is toxic if one of them says so.  Without labels of both classes,
    nothing is ever toxic.
    """
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    labels = labels.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = [
        labels.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
        for c in (0, 1)
    ]
    rows = [(r["doc_id"], r["toxic"], i % FOLDS) for part in picked for i, r in enumerate(part)]
    if not rows:
        return nothing()
    chosen = F.broadcast(spark.createDataFrame(rows, "doc_id long, toxic int, fold int"))  # 2 x per_class rows
    sample = texts.join(chosen, "doc_id")
    ship(spark)

    def fit(key, tab):  # a task's folds, one after the other
        tab = tab.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        fold, toxic, texts = tab["fold"].to_numpy(), tab["toxic"].to_numpy(), K.one_array(tab["text"])
        out = []
        for k in range(key[0].as_py(), FOLDS, FIT_TASKS):
            m, score = fold_fit(texts, toxic, fold, k)
            out.append((k, m and m.scores.tobytes(), m and m.bias, score.tolist(), toxic[fold == k].tolist()))
        kinds = {"k": pa.int32(), "scores": pa.binary(), "bias": pa.float64(), "held": pa.list_(pa.float64()), "toxic": pa.list_(pa.int32())}
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), zip(*out))})

    got = (
        sample.withColumn("task", F.explode(F.array(*map(F.lit, range(FIT_TASKS)))))
        .groupBy("task")
        .applyInArrow(fit, "k int, scores binary, bias double, held array<double>, toxic array<int>")
        .where("scores is not null")
        .collect()
    )
    got.sort(key=lambda r: r["k"])
    models = [Model(np.frombuffer(r["scores"], np.float32), r["bias"]) for r in got]
    return averaged(models, np.array([x for r in got for x in r["held"]]), np.array([x for r in got for x in r["toxic"]]))


def toxic_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the documents whose worst window is above the threshold.

    ``score`` is the worst window's logit above the threshold, rounded to 6 digits; a text
    at the threshold isn't toxic.  Null or empty texts and texts without words are never
    toxic.  Texts of any length are scored whole.  A row without doc_id is reported with a
    null doc_id, repeated rows each.  Other columns are not looked at.  An empty table gives
    an empty result.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for a, texts in K.text_slices(batch.column(1)):
                score = shared.value.score(texts) - shared.value.threshold
                bad = pa.array(score > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)).filter(bad), pa.array(np.round(score, 6)).filter(bad)], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``toxic_documents`` doesn't report, with all their columns;
    judged row by row, so null and empty texts and rows without doc_id stay, and repeated
    rows stay or go together."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a, texts in K.text_slices(batch.column(at), 1 << 21):
                good = ~(shared.value.score(texts) > shared.value.threshold)
                yield batch.slice(a, len(texts)).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
