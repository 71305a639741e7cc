"""Quality classifier: a linear-chain conditional random field over lines.

Every line gets features of its bytes and words and of its neighbouring
lines; the chain labels lines good or bad.  Forward-backward gives each line's
marginal of being good, and the mean of the marginals weighted by line length
is the document's score.

The chain is trained on documents with a quality label, every line of which
carries the document's label.  The sample is bounded: of the labelled
documents outside the held-out fifth, the ``train_docs`` with the smallest
hash of their id; of a document with more than ``train_lines`` lines a run of
that many adjacent ones is learnt from, begun at a place that follows from a
hash of its text, so every transition is one between neighbours.  Scores use
nothing but the text, and all of it.

Defined results: null text counts as empty, and an empty text is one line of
weight 1.  Labels other than 0 and 1 are not learnt from; of labels that
contradict each other for one document the larger holds; of texts that
repeat a doc_id the one of smallest digest is learnt from.  Without labels of
both kinds the weights stay zero and every score is 0.5.  Repeated rows each
get their row; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgrade.llm.common import whole_text

KINDS = ["upper", "lower", "digit", "blank", "point", "sign", "high"]
_KIND = np.full(256, KINDS.index("sign"), dtype=np.uint8)
for _chars, _kind in ((range(65, 91), "upper"), (range(97, 123), "lower"), (range(48, 58), "digit"), (b" \t\r\x0b\x0c", "blank"), (b".,;:?'\"()-", "point"), (range(128, 256), "high")):
    _KIND[list(_chars)] = KINDS.index(_kind)
N_OWN = 14
N_FEATURES = 3 * N_OWN + 3
_MIX = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, their byte lengths, and the number
    of lines of each text.  One pass over the bytes of the whole batch."""
    joined = "\n".join(texts) + "\n"
    data = np.frombuffer(joined.encode("utf-8", "replace"), dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = ends - starts
    n_lines = np.array([t.count("\n") + 1 for t in texts])
    n, size = len(ends), np.maximum(lengths, 1).astype(float)
    kind = _KIND[data]
    kind[ends] = KINDS.index("blank")
    shares = np.stack([np.add.reduceat(kind == k, starts, dtype=np.int64) - (1 if name == "blank" else 0) for k, name in enumerate(KINDS)], axis=1) / size[:, None]
    # words: maximal runs without blanks
    full = kind != KINDS.index("blank")
    w_start = np.flatnonzero(full & np.concatenate(([True], ~full[:-1])))
    w_line = np.searchsorted(ends, w_start)
    n_words = np.bincount(w_line, minlength=n)
    words = np.maximum(n_words, 1)
    if len(w_start):
        # a word's hash: its bytes' random values, each weighted by its place
        place = np.arange(len(data), dtype=np.int64)
        owner = np.cumsum(np.bincount(w_start, minlength=len(data)))[:] - 1
        inside = (place - w_start[np.maximum(owner, 0)]).astype(np.uint64)
        value = np.where(full, _MIX[data] * (inside * np.uint64(2) + np.uint64(1)), np.uint64(0))
        h = np.add.reduceat(value, w_start)
        last = np.concatenate((w_start[1:], [len(data)])) - 1
        w_len = np.add.reduceat(full, w_start, dtype=np.int64)
        same = (h[1:] == h[:-1]) & (w_line[1:] == w_line[:-1])
        near = (h[2:] == h[:-2]) & (w_line[2:] == w_line[:-2])
        again = np.bincount(w_line[1:][same], minlength=n) / words
        again2 = np.bincount(w_line[2:][near], minlength=n) / words
        closing = w_start + w_len - 1
        closed = np.bincount(w_line, weights=kind[closing] == KINDS.index("sign"), minlength=n) / words
        del last
    else:
        again = again2 = closed = np.zeros(n)
    final = data[np.maximum(ends - 1, 0)]
    own = np.column_stack([shares, again, again2, closed, np.log1p(lengths) / 5, np.minimum(lengths / words, 30) / 10,
                           np.isin(final, list(b".?!:;")) & (lengths > 0), n_words == 1]).astype(float)
    first = np.zeros(n, dtype=bool)
    first[np.concatenate(([0], np.cumsum(n_lines)[:-1])).astype(int)] = True
    final_line = np.concatenate((first[1:], [True]))
    before = np.where(first[:, None], 0.0, np.roll(own, 1, axis=0))
    after = np.where(final_line[:, None], 0.0, np.roll(own, -1, axis=0))
    return np.column_stack([own, before, after, first, final_line, np.ones(n)]), np.maximum(lengths, 1).astype(float), n_lines


def forward_backward(unary: np.ndarray, n_lines: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1 for every line, expected transitions of every
    text (texts x 2 x 2) and log partitions.  ``unary`` is the score of label
    1 against 0; texts run side by side, longest first."""
    order = np.argsort(-n_lines, kind="stable")
    start = np.concatenate(([0], np.cumsum(n_lines)[:-1]))[order]
    count = n_lines[order]
    alpha, beta = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    scores = np.column_stack([np.zeros(len(unary)), unary])
    alpha[start] = scores[start]
    steps = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(1, steps + 1), side="right")  # texts with at least so many lines
    for t in range(1, steps):
        at = start[:active[t]] + t
        alpha[at] = scores[at] + np.logaddexp(alpha[at - 1, :1] + pairs[0], alpha[at - 1, 1:] + pairs[1])
    for t in range(steps - 2, -1, -1):
        at = start[:active[t + 1]] + t
        ahead = scores[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(pairs[:, 0] + ahead[:, :1], pairs[:, 1] + ahead[:, 1:])
    both = alpha + beta
    marginal = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    finish = start + count - 1
    log_z = np.empty(len(n_lines))
    log_z[order] = np.logaddexp(alpha[finish, 0], alpha[finish, 1])
    moves = np.zeros((len(n_lines), 2, 2))
    inner = np.ones(len(unary), dtype=bool)
    inner[finish] = False
    at = np.flatnonzero(inner)
    text = np.repeat(np.arange(len(n_lines)), n_lines)[at]
    for a in (0, 1):
        for b in (0, 1):
            p = np.exp(alpha[at, a] + pairs[a, b] + scores[at + 1, b] + beta[at + 1, b] - log_z[text])
            moves[:, a, b] = np.bincount(text, weights=p, minlength=len(n_lines))
    return marginal, moves, log_z


def train(features: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, steps: int = 120, rate: float = 0.15, l2: float = 1e-3) -> dict:
    """Weights by gradient ascent (Adam) on the conditional likelihood of the
    line labels, each document's share divided by its number of lines and
    both labels weighing the same."""
    mean, spread = features.mean(axis=0), features.std(axis=0)
    mean[-1], spread[-1] = 0, 1
    x = (features - mean) / np.maximum(spread, 1e-6)
    x = np.clip(x, -6, 6)
    w, pairs = np.zeros(features.shape[1]), np.zeros((2, 2))
    model = {"mean": mean, "spread": np.maximum(spread, 1e-6), "w": w, "pairs": pairs}
    if len(set(labels.tolist())) < 2:
        return model
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / n_lines
    per_line, gold = np.repeat(weight, n_lines), np.repeat(labels, n_lines).astype(float)
    stay = (n_lines - 1) * weight
    gold_moves = np.diag([stay[labels == 0].sum(), stay[labels == 1].sum()])
    m, v, scale = np.zeros(len(w) + 4), np.zeros(len(w) + 4), 1 / len(labels)
    for t in range(1, steps + 1):
        marginal, moves, _ = forward_backward(x @ w, n_lines, pairs)
        g_w = x.T @ (per_line * (gold - marginal)) * scale - l2 * w
        g_p = (gold_moves - (moves * weight[:, None, None]).sum(axis=0)) * scale - 0.02 * pairs
        g = np.concatenate([g_w, g_p.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, pairs = w + step[:-4], pairs + step[-4:].reshape(2, 2)
    return model | {"w": w, "pairs": pairs}


def document_scores(texts: list[str], model: dict) -> np.ndarray:
    """Length-weighted mean of the lines' marginals of being good."""
    features, lengths, n_lines = line_features(texts)
    x = np.clip((features - model["mean"]) / model["spread"], -6, 6)
    marginal, _, _ = forward_backward(x @ model["w"], n_lines, model["pairs"])
    at = np.concatenate(([0], np.cumsum(n_lines)[:-1]))
    return np.add.reduceat(marginal * lengths, at) / np.add.reduceat(lengths, at)


def blocks(texts: list[str], most: int = 1 << 19):
    """Runs of texts of about ``most`` characters, so that the arrays over a
    batch's bytes stay small; a longer text is a run of its own."""
    first, chars = 0, 0
    for i, t in enumerate(texts):
        if i > first and chars + len(t) > most:
            yield first, i
            first, chars = i, 0
        chars += len(t)
    if first < len(texts):
        yield first, len(texts)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = 4000, train_lines: int = 128) -> dict:
    """Fit the chain on a bounded sample, collected to the driver: at most
    ``train_docs`` documents of ``train_lines`` lines."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)  # the bound
    picked = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id")

    def features_of(batches):
        for pdf in batches:
            for a, b in blocks(list(pdf["text"])):
                x, _, n_lines = line_features(list(pdf["text"][a:b]))
                firsts = np.concatenate(([0], np.cumsum(n_lines)[:-1]))
                for doc_id, q, text, at, n in zip(pdf["doc_id"][a:b], pdf["quality"][a:b], pdf["text"][a:b], firsts, n_lines):
                    digest = zlib.crc32(text.encode("utf-8", "replace"))
                    kept = min(n, train_lines)
                    at += digest % (n - kept + 1)
                    yield pd.DataFrame({"doc_id": [doc_id], "quality": [q], "n": [kept], "digest": [digest], "x": [x[at:at + kept].astype("f4").ravel()]})

    got = picked.mapInPandas(features_of, "doc_id long, quality int, n int, digest long, x array<float>").toPandas()
    got = got.sort_values(["doc_id", "digest"], kind="stable").drop_duplicates("doc_id")
    if not len(got):
        return train(np.zeros((1, N_FEATURES)), np.array([1]), np.array([1]))
    x = np.concatenate([np.asarray(v, dtype=float) for v in got["x"]]).reshape(-1, N_FEATURES)
    return train(x, got["n"].to_numpy(), got["quality"].to_numpy())


def classify(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if score >= threshold)."""
    import pyarrow as pa

    kept = docs.drop("score", "predicted")

    def score(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            s = np.concatenate([document_scores(texts[a:b], model) for a, b in blocks(texts)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype("i4"))],
                                             names=[*batch.schema.names, "score", "predicted"])
    from pyspark.sql.types import DoubleType, IntegerType, StructType
    schema = StructType([*kept.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return kept.mapInArrow(score, schema)


def quality(docs: DataFrame, labels: DataFrame, train_docs: int = 4000, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, train_docs)
    return classify(docs.select("doc_id", "text"), model, threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")
