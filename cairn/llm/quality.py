"""Document quality by random-indexing word vectors and a small network.

Each word has a fixed sparse random index vector, a function of the word. A word's vector is that and the mean of the index
vectors around it in the fitted texts; words that are hardly seen there take the surroundings of their shape. A document is
the mean over its words, which a two-layer network scores; its probabilities are calibrated by one temperature.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import WORD, crc_fold, ids_and_text, real_id
from cairn.llm.learn import Adam, sample, sigmoid
from cairn.llm.words import groups, mixed

DIM, ONES, WINDOW, HIDDEN = 96, 6, 2, 24
#: Times that a word stands in the fitted texts from which on its own surroundings count.
SEEN = 3
#: Rows of either class that the model is fitted on, and the longest text among them.
SAMPLE, MOST_CHARS = 4000, 20_000


def index_vectors(words: list[str]) -> np.ndarray:
    """One place of +1 or -1 in each of ONES equal parts, by the word's mixed checksum."""
    codes = mixed(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words)))
    out, part = np.zeros((len(words), DIM), dtype=np.float32), DIM // ONES
    for k in range(ONES):
        own = codes >> np.uint64(10 * k)
        at = (own & np.uint64(511)) % np.uint64(part)
        out[np.arange(len(words)), at.astype(np.int64) + k * part] = np.where(own >> np.uint64(9) & np.uint64(1), 1.0, -1.0)
    return out


def shape(word: str) -> str:
    """<lower>, <UPPER>, <Title>, <mixed>, <digits> or <marks>, by the kind of characters."""
    if word[0].isalnum() or word[0] == "_":
        if word.isdigit():
            return "<digits>"
        return "<lower>" if word.islower() else "<UPPER>" if word.isupper() and len(word) > 1 else "<Title>" if word.istitle() else "<mixed>"
    return "<marks>"


SHAPES = ("<lower>", "<UPPER>", "<Title>", "<mixed>", "<digits>", "<marks>")
#: Stand beside a word that repeats the one before it, or the one before that.
AGAIN = ("<again>", "<again2>")


def repeats(words: list[str]) -> list[np.ndarray]:
    """For each of AGAIN the places of the words that it stands beside."""
    out = []
    for gap in (1, 2):
        same = np.fromiter(map(eq, words[gap:], words[:-gap]), dtype=bool, count=max(0, len(words) - gap))
        out.append(np.flatnonzero(same) + gap)
    return out


@dataclass
class Model:
    rows: dict[str, int] = field(default_factory=dict)  # word, shape or AGAIN -> row of around
    around: np.ndarray = field(default_factory=lambda: np.zeros((len(SHAPES), DIM), dtype=np.float16))
    layers: tuple = ()
    temperature: float = 1.0
    share: float = 0.5  # what an untrained model answers

    def vectors(self, words: list[str]) -> np.ndarray:
        shapes = [shape(w) for w in words]
        near = np.fromiter((self.rows[s] if (r := self.rows.get(w)) is None else r for w, s in zip(words, shapes, strict=True)), dtype=np.int64, count=len(words))
        kinds = index_vectors(list(SHAPES))
        return index_vectors(words) + kinds[[SHAPES.index(s) for s in shapes]] + self.around[near].astype(np.float32)

    def pooled(self, texts: list[str]) -> np.ndarray:
        """A row for each text. A text's words are looked up once each."""
        out = np.zeros((len(texts), DIM))
        if not self.rows:
            return out
        again = index_vectors(list(AGAIN)) + self.around[[self.rows[name] for name in AGAIN]].astype(np.float32)
        begin = 0
        for group in groups(texts):
            split = [WORD.findall(t) for t in group]
            number: dict[str, int] = {}
            ids = [np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words)) for words in split]
            table = self.vectors(list(number)) if number else np.zeros((0, DIM), dtype=np.float32)
            for k, (words, at) in enumerate(zip(split, ids, strict=True), begin):
                for lo in range(0, len(at), 1 << 14):
                    out[k] += table[at[lo : lo + (1 << 14)]].sum(axis=0, dtype=np.float64)
                for vector, places in zip(again, repeats(words), strict=True):
                    out[k] += len(places) * vector.astype(np.float64)
                out[k] /= max(1, len(at))
            begin += len(group)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, std, w1, b1, w2, b2 = self.layers
        return np.maximum((x - mean) / std @ w1 + b1, 0) @ w2 + b2[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.share)
        return sigmoid(self.logits(self.pooled(texts)) / self.temperature)


def learn_vectors(texts: list[list[str]], model: Model) -> None:
    """Fills model.rows and model.around: every word within WINDOW places adds its index vector and that of its shape. What stands
    around a word also counts for its shape."""
    seen = Counter(w for t in texts for w in t)
    words = [*SHAPES, *AGAIN, *sorted(w for w, n in seen.items() if n >= SEEN)]
    model.rows = {w: i for i, w in enumerate(words)}
    kinds = index_vectors(list(SHAPES))
    total, count = np.zeros((len(words), DIM), dtype=np.float32), np.zeros(len(words))
    for t in texts:
        kind = np.fromiter((SHAPES.index(shape(w)) for w in t), dtype=np.int64, count=len(t))
        own = np.fromiter((model.rows.get(w, -1) for w in t), dtype=np.int64, count=len(t))
        index = index_vectors(t) + kinds[kind]
        around = np.zeros((len(t), DIM), dtype=np.float32)
        for d in range(1, min(WINDOW, len(t) - 1) + 1):
            around[d:] += index[:-d]
            around[:-d] += index[d:]
        known = np.flatnonzero(own >= 0)
        again = [(np.full(len(p), model.rows[name]), around[p]) for name, p in zip(AGAIN, repeats(t), strict=True)]
        for rows, near in [(own[known], around[known]), (kind, around), *again]:
            if not len(rows):
                continue
            order = np.argsort(rows, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0])
            at = rows[order][starts]
            total[at] += np.add.reduceat(near[order], starts, axis=0)
            count[at] += np.diff(np.r_[starts, len(rows)])
    total /= np.maximum(count, 1)[:, None].astype(np.float32) * 2 * WINDOW
    model.around = total.astype(np.float16)


def fit(rows: list[tuple[int, str, int]], counts: dict[int, int], seed: int = 11, epochs: int = 60) -> Model:
    """rows: (doc_id, text, label). A fifth of them calibrates the temperature. Without rows of both classes every score is
    the share of rows with label 1, or 0.5."""
    y = np.array([r[2] for r in rows], dtype=float)
    total = sum(counts.values())
    if not 0 < y.sum() < len(y):
        return Model(share=(counts.get(1, 0) + 0.5) / (total + 1) if total else 0.5)
    model, rng = Model(), np.random.default_rng(seed)
    learn_vectors([WORD.findall(r[1]) for r in rows], model)
    x = model.pooled([r[1] for r in rows])
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    weight /= weight.mean()
    order = rng.permutation(len(y))
    held, learnt = order[: max(2, len(y) // 5)], order[max(2, len(y) // 5) :]
    learnt = learnt if len(learnt) else held
    mean, std = x[learnt].mean(axis=0), x[learnt].std(axis=0) + 1e-3
    w1, b1 = rng.normal(0, np.sqrt(2 / DIM), (DIM, HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)
    model.layers = (mean, std, w1, b1, w2, b2)
    z, adam = (x - mean) / std, Adam(w1, b1, w2, b2, rate=0.005)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(learnt), max(1, len(learnt) // 128)):
            hidden = np.maximum(z[part] @ w1 + b1, 0)
            slope = weight[part] * (sigmoid(hidden @ w2 + b2[0]) - y[part]) / len(part)
            back = np.outer(slope, w2) * (hidden > 0)
            adam.step(z[part].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ slope + 1e-4 * w2, np.array([slope.sum()]))
    logits, ones = model.logits(x[held]), y[held].sum()
    # Platt's targets, so that a held part without mistakes doesn't call for certainty
    target = np.where(y[held] == 1, (ones + 1) / (ones + 2), 1 / (len(held) - ones + 2))

    def loss(t: float) -> float:
        p = np.clip(sigmoid(logits / t), 1e-9, 1 - 1e-9)
        return -(weight[held] * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum()

    model.temperature = min(np.geomspace(0.25, 8, 101).tolist(), key=loss)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on a bounded sample: SAMPLE rows of either class, texts of at most MOST_CHARS characters."""
    return fit(*sample(docs, labels, "quality", SAMPLE, MOST_CHARS, id_col, text_col))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1). Null and empty texts get the score of a zero vector; null
    identifiers stay null; repeated rows are repeated; other columns are ignored; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id.to_numpy(), "score": shared.value.scores(list(batch.text))})

    return ids_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, score double").withColumn("doc_id", real_id())


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(
        "doc_id",
        F.coalesce(crc_fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
