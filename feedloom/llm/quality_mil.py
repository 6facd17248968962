"""Attention-based multiple-instance learning of document quality.

A document is a bag of passages. Every passage of the whole text is encoded; a
gated attention network gives each passage a weight, and a logistic unit scores
the weighted sum of the passage vectors. Only the document labels are known in
training; which passages speak for them is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.storage import stored
from feedloom.llm.text_arrays import SPACES, blocks

PASSAGE = 640  # bytes
CELLS = 1024  # cells of the hashed byte-trigram histogram
FOLDED = 32  # cells that enter the vector
HIDDEN = 24
GATE = 12
SLICE = 1024  # passages whose histograms are held at a time
SAMPLE = 6000  # labelled documents to fit on
SAMPLE_PASSAGES = 300_000  # passages of all these documents together: their vectors go to the driver

GROUPS = np.zeros(256, np.int64)  # byte classes counted in each passage
for _k, _chars in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", SPACES, b".", b",", b"!", b"?;:'\"-()", b"#*$%&|<>", b"/\\@=_+[]{}~^`"), 1
):
    GROUPS[list(_chars)] = _k
GROUPS[128:192] = 11
GROUPS[192:] = 12
N_GROUPS = 13
N_FEATURES = N_GROUPS + 5 + FOLDED


def passages(block) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of a block and the document of each; an empty text has one passage of zeros."""
    sizes = np.diff(block.offsets)
    n_each = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.arange(block.n_docs), n_each)
    first = np.cumsum(n_each) - n_each
    # Equal cuts: no document ends in a sliver. A byte's passage is place * n // size, rounded down.
    turn = np.arange(len(owner)) - first[owner]
    cuts = np.append(block.offsets[:-1][owner] - (-turn * sizes[owner] // n_each[owner]), len(block.data))
    words = block.words()[:2]
    vectors = [
        _vectors(block, cuts[i : i + SLICE + 1], owner[i : i + SLICE], words) for i in range(0, len(owner), SLICE)
    ]
    return np.concatenate([*vectors, np.zeros((0, N_FEATURES), np.float32)]), owner


def _vectors(block, cuts: np.ndarray, owner: np.ndarray, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Vectors of the consecutive passages between ``cuts``."""
    n, begin, end = len(owner), cuts[0], cuts[-1]
    spot = np.repeat(np.arange(n), np.diff(cuts))
    data = block.data[begin:end]
    length = np.diff(cuts).astype(np.float32)
    share = np.maximum(length, 1)[:, None]
    groups = np.bincount(spot * N_GROUPS + GROUPS[data], minlength=n * N_GROUPS).reshape(n, N_GROUPS)
    # No trigram reaches into the document before.
    at = np.flatnonzero(np.arange(begin, end) - block.offsets[owner][spot] >= 2)
    low = block.data[max(0, begin - 2) : end].astype(np.int64)
    shift = begin - max(0, begin - 2)
    tri = ((low[at + shift - 2] << 16) | (low[at + shift - 1] << 8) | low[at + shift]) * 0x9E3779B1 >> 13
    cells = np.bincount(spot[at] * CELLS + (tri & (CELLS - 1)), minlength=n * CELLS).reshape(n, CELLS)
    some = slice(*np.searchsorted(words[0], [begin, end]))
    in_passage, sizes = spot[words[0][some] - begin], words[1][some] - words[0][some]
    counts = np.bincount(in_passage, minlength=n)
    letters = np.bincount(in_passage, sizes, n)
    long_words = np.bincount(in_passage, sizes**2, n)
    mean = letters / np.maximum(1, counts)
    vectors = np.concatenate(
        [
            np.sqrt(groups / share),
            (np.count_nonzero(cells, axis=1)[:, None] / share),
            np.sqrt(cells.max(1)[:, None] / share),
            np.sqrt((cells.astype(np.float32) ** 2).sum(1)[:, None]) / share,
            mean[:, None] / 8,
            np.sqrt(np.maximum(0, long_words / np.maximum(1, counts) - mean**2))[:, None] / 8,
            np.sqrt(cells.reshape(n, CELLS // FOLDED, FOLDED).sum(1) / share),
        ],
        axis=1,
    )
    return vectors.astype(np.float32)


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` whose rows don't depend on how many others there are, to the last bit (BLAS deals rows to unlike kernels)."""
    return np.einsum("ij,jk->ik" if w.ndim == 2 else "ij,j->i", x, w)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """h = relu(E x); a = softmax(w . (tanh(V h) * sigmoid(U h))); score = sigmoid(c . sum(a h) + b)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, owner: np.ndarray, n_docs: int) -> dict[str, np.ndarray]:
        p = self.weights
        x = (x - self.mean) / self.scale
        pre = _times(x, p["E"]) + p["e"]
        h = np.maximum(pre, 0)
        t, g = np.tanh(_times(h, p["V"])), _sigmoid(_times(h, p["U"]))
        logit = _times(t * g, p["w"])
        starts = np.searchsorted(owner, np.arange(n_docs))
        top = np.maximum.reduceat(logit, starts)
        e = np.exp(logit - top[owner])
        a = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "pre": pre, "h": h, "t": t, "g": g, "a": a, "z": z, "starts": starts, "out": _sigmoid(_times(z, p["c"]) + p["b"])}

    def step(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        """Gradients of the mean log-loss of some bags."""
        p, f = self.weights, self.forward(x, owner, len(y))
        d_out = (f["out"] - y) / len(y)
        d_z = d_out[:, None] * p["c"]
        d_a = (d_z[owner] * f["h"]).sum(1)
        d_logit = f["a"] * (d_a - np.add.reduceat(f["a"] * d_a, f["starts"])[owner])
        d_t = d_logit[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        d_g = d_logit[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        d_h = f["a"][:, None] * d_z[owner] + d_t @ p["V"].T + d_g @ p["U"].T
        d_pre = d_h * (f["pre"] > 0)
        grads = {
            "E": f["x"].T @ d_pre, "e": d_pre.sum(0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_g,
            "w": (f["t"] * f["g"]).T @ d_logit, "c": f["z"].T @ d_out, "b": np.array([d_out.sum()]),
        }
        return {k: g + decay * p[k] for k, g in grads.items()}

    def score(self, x: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the documents and the attention of every passage."""
        f = self.forward(x, owner, n_docs)
        return f["out"].astype(np.float64), f["a"]


def fit_bags(
    x: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 0
) -> AttentionModel | None:
    """Train by Adam over shuffled bags; None without both labels."""
    if len(y) == 0 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    weights = {
        "E": normal(x.shape[1], HIDDEN), "e": np.zeros(HIDDEN), "V": normal(HIDDEN, GATE), "U": normal(HIDDEN, GATE),
        "w": normal(GATE), "c": normal(HIDDEN), "b": np.zeros(1),
    }
    model = AttentionModel(x.mean(0), x.std(0) + 1e-3, weights)
    bounds = np.searchsorted(owner, np.arange(len(y) + 1))
    m = {k: np.zeros_like(v) for k, v in weights.items()}
    v2 = {k: np.zeros_like(v) for k, v in weights.items()}
    t = 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs) + 1e-5
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            bags = order[i : i + batch]
            rows = np.concatenate([np.arange(bounds[b], bounds[b + 1]) for b in bags])
            local = np.repeat(np.arange(len(bags)), bounds[bags + 1] - bounds[bags])
            t += 1
            for k, g in model.step(x[rows], local, y[bags], decay).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                weights[k] = weights[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's digits leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def within(sizes: list[int], labels: list[int], most: int) -> int:
    """How many documents, from the first on, have at most ``most`` passages together; as many at least as show both labels."""
    total = 0
    for i, size in enumerate(sizes):
        total += size
        if total > most and len(set(labels[:i])) > 1:
            return i
    return len(sizes)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_passages: int = SAMPLE_PASSAGES) -> AttentionModel | None:
    """Fit on at most ``sample`` labelled documents, taken by a hash of their id, with all their passages.

    If these have over ``sample_passages`` passages together, the first of them by
    the same hash that don't are fitted on; no document is learned from in part.
    Rows with a null id or label, or of the held-out third, are not learned from;
    of labels or documents that share an id one row of each is used. The passage
    vectors are all that reaches the driver.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = (
        usable.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("quality"))
        .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
        .limit(sample)
        .collect()
    )
    if not chosen:
        return None
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r["doc_id"], r["quality"]) for r in chosen], "doc_id long, quality int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for block in blocks(batch.column("text")):
                x, owner = passages(block)
                cuts = np.searchsorted(owner, np.arange(block.n_docs + 1))
                vectors = [x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.first, block.n_docs), pa.array(np.diff(cuts)), pa.array(vectors, pa.binary())],
                    names=["doc_id", "n", "x"],
                )

    # Stored, so that their sizes are known before any vector is collected.
    found = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").select("doc_id", "text").mapInArrow(run, "doc_id long, n long, x binary"),
        "passages",
    )
    sizes = {r["doc_id"]: r["n"] for r in found.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    quality = {r["doc_id"]: r["quality"] for r in chosen}
    first = within([sizes[d] for d in quality], list(quality.values()), sample_passages)
    fitted = list(quality)[:first]
    if len(fitted) < len(quality):
        kept = F.broadcast(spark.createDataFrame([(d,) for d in fitted], "doc_id long"))
        found = found.join(kept, "doc_id", "left_semi")
    bags: dict[int, bytes] = {}
    for r in found.select("doc_id", "x").collect():
        bags[r["doc_id"]] = min(bytes(r["x"]), bags.get(r["doc_id"], bytes(r["x"])))
    order = sorted(bags)
    xs = [np.frombuffer(bags[d], np.float32).reshape(-1, N_FEATURES) for d in order]
    owner = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    return fit_bags(np.concatenate(xs).astype(np.float64), owner, np.array([quality[d] for d in order], float))


def _score_block(model: AttentionModel | None, block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, owner = passages(block)
    n_each = np.bincount(owner, minlength=block.n_docs)
    if model is None:
        return np.full(block.n_docs, 0.5), n_each, 1 / n_each
    scores, attention = model.score(x, owner, block.n_docs)
    return scores, n_each, np.maximum.reduceat(attention, np.searchsorted(owner, np.arange(block.n_docs)))


def score_documents(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """``doc_id, score, n_passages, top_attention`` of every whole text.

    Nulls: a null text is scored as an empty one, a null doc_id stays null.
    Repeated rows get equal scores. Without a model (no labels, or of one class
    only) every score is 0.5. An empty table gives no rows; labels, lang, source
    and doc_id never enter a score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), 1 << 20):
                score, n, top = _score_block(model, block)
                own = batch.column("doc_id").slice(block.first, block.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(score), pa.array(n.astype(np.int64)), pa.array(top.astype(np.float64))],
                    names=["doc_id", "score", "n_passages", "top_attention"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, n_passages long, top_attention double")


def keep_good(docs: DataFrame, model: AttentionModel | None, at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text scores ``at_least``."""

    def score_all(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            column = pa.array(some, pa.string(), from_pandas=True)
            found = [_score_block(model, block)[0] for block in blocks(column, 1 << 20)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    score = F.pandas_udf(score_all, T.DoubleType())
    return docs.where(score("text") >= at_least)
