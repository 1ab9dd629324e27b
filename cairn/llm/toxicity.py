"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents, so tokens are labelled first: a token of a toxic document counts as toxic if its word or
one of its beginnings is far commoner in toxic documents than in others. A chain with two states learns from those tokens;
forward-backward gives each token's marginal, and a calibrated sum of marginals gives a document's score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import crc_fold, ids_and_text, real_id, tidy
from cairn.llm.learn import Adam, logistic, sample, sigmoid
from cairn.llm.words import groups

TOKEN = re.compile(r"\w+")
#: Tokens that are gone through together, and tokens of a segment of a chain.
TOGETHER, STEP = 1 << 18, 32
#: Rows of either class that the model is fitted on, and the longest text among them.
SAMPLE, MOST_CHARS = 3000, 20_000
#: A feature marks toxic tokens from this many standard deviations and this ratio of rates.
SIGMAS, RATIO = 6.0, 8.0


#: Lengths of the beginnings of words that are features.
KINDS = range(3, 9)


def feature_of(token: str, kind: int) -> str | None:
    """The word itself (kind 0) or one of its beginnings; None if it is too short."""
    if not kind:
        return token
    n = KINDS[kind - 1]
    return f"{token[:n]}*" if len(token) >= n else None


def features(token: str) -> list[str]:
    return [f for kind in range(len(KINDS) + 1) if (f := feature_of(token, kind))]


@dataclass
class Chains:
    """Texts cut into segments of STEP tokens, one segment a column, so that a step goes on by one token in all segments. The chain goes
    on across the cuts: what a segment does to either state is a 2 x 2 matrix, and the states at its ends follow from these.

    cell[k]: place (step x segments + segment) of the k-th token of all texts; real: places that hold a token; first: segments
    that begin a text; base, many: first segment and number of segments of each text with tokens, the longest text first."""

    cell: np.ndarray
    real: np.ndarray
    first: np.ndarray
    base: np.ndarray
    many: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray) -> Chains:
        many = -(-sizes // STEP)
        base, n = np.cumsum(many) - many, int(many.sum())
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cell = inside % STEP * n + np.repeat(base, sizes) + inside // STEP
        real, first = np.zeros(STEP * n, dtype=bool), np.zeros(n, dtype=bool)
        real[cell] = True
        first[base[sizes > 0]] = True
        order = np.argsort(-many, kind="stable")[: (many > 0).sum()]
        return cls(cell, real.reshape(STEP, n), first, base[order], many[order])

    def laid(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.real.size)
        out[self.cell] = values
        return out.reshape(self.real.shape)

    def passes(self, s: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward; s: score of state 1 over state 0 of each token, edge: 2 x 2 transition scores. For each place: odds of the
        token by itself; share of state 1 before it and up to it; odds that what follows adds."""
        odds, ((t00, t01), (t10, t11)), real, first = np.exp(np.clip(self.laid(s), -30, 30)), np.exp(edge), self.real, self.first
        n = len(first)
        m = np.repeat(np.array([1.0, 0.0, 0.0, 1.0])[:, None], n, axis=1)  # from state 0 to 0 and 1, from state 1 to 0 and 1
        for k in range(STEP):
            new = np.stack([m[0] * t00 + m[1] * t10, (m[0] * t01 + m[1] * t11) * odds[k], m[2] * t00 + m[3] * t10, (m[2] * t01 + m[3] * t11) * odds[k]])
            if not k:  # nothing leads to a text's first token
                new = np.where(first, np.stack([m[0], m[1] * odds[k], m[2], m[3] * odds[k]]), new)
            m = np.where(real[k], new / new.sum(axis=0), m)
        start, end = np.full(n, 0.5), np.ones(n)
        longest = int(self.many[0]) if len(self.many) else 0
        share, ratio = np.full(len(self.many), 0.5), np.ones(len(self.many))
        for k in range(longest):
            live = int(np.searchsorted(-self.many, -k, side="left"))  # texts of more than k segments
            at = self.base[:live] + k
            start[at] = a = share[:live]
            one, zero = (1 - a) * m[1, at] + a * m[3, at], (1 - a) * m[0, at] + a * m[2, at]
            share[:live] = one / (one + zero)
        for k in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-self.many, -k, side="left"))
            at = self.base[:live] + k
            end[at] = r = ratio[:live]
            ratio[:live] = (m[2, at] + m[3, at] * r) / (m[0, at] + m[1, at] * r)
        before, ahead, back = (np.empty((STEP, n)) for _ in range(3))
        a = start
        for k in range(STEP):
            before[k] = a
            one, zero = ((1 - a) * t01 + a * t11) * odds[k], (1 - a) * t00 + a * t10
            if not k:
                one, zero = np.where(first, a * odds[k], one), np.where(first, 1 - a, zero)
            ahead[k] = a = np.where(real[k], one / (one + zero), a)
        r = end
        for k in range(STEP - 1, -1, -1):
            back[k] = r
            next_ = odds[k] * r
            r = np.where(real[k], (t10 + t11 * next_) / (t00 + t01 * next_), r)
        return odds, before, ahead, back


def marginals(s: np.ndarray, sizes: np.ndarray, edge: np.ndarray, chains: Chains | None = None) -> np.ndarray:
    """Probability of state 1 of each token of all texts, one text after the other; s: their scores, sizes: tokens of each text."""
    chains = chains or Chains.of(sizes)
    _, _, ahead, back = chains.passes(s, edge)
    one = ahead * back
    return (one / (one + 1 - ahead)).reshape(-1)[chains.cell]


def pair_sums(s: np.ndarray, chains: Chains, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of state 1 of each token, expected number of steps from state a to state b: 2 x 2)."""
    odds, f, ahead, back = chains.passes(s, edge)
    t, after, inside = np.exp(edge), odds * back, chains.real.copy()
    inside[0] &= ~chains.first
    joint = [(1 - f) * t[0, 0], (1 - f) * t[0, 1] * after, f * t[1, 0], f * t[1, 1] * after]
    whole = inside / sum(joint)
    one = ahead * back
    return (one / (one + 1 - ahead)).reshape(-1)[chains.cell], np.array([(x * whole).sum() for x in joint]).reshape(2, 2)


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    edge: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    final: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, -4.0]))
    bias: float = -8.0

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def score(self, token: str) -> float:
        if (s := self.known.get(token)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            s = self.known[token] = self.bias + sum(self.weights.get(f, 0.0) for f in features(token))
        return s

    def tokens(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginals of each text's tokens, over the whole text."""
        out, begin, n = [], 0, 0
        for k, t in enumerate(texts):
            n += len(t)
            if n >= TOGETHER or k == len(texts) - 1:
                part = texts[begin : k + 1]
                sizes = np.array([len(x) for x in part], dtype=np.int64)
                flat = np.fromiter((self.score(x) for y in part for x in y), dtype=np.float64, count=int(sizes.sum()))
                p = marginals(flat, sizes, self.edge) if len(flat) else flat
                out += np.split(p, np.cumsum(sizes)[:-1])
                begin, n = k + 1, 0
        return out

    def document(self, p: np.ndarray) -> np.ndarray:
        """Most likely token, expected number of toxic tokens and their share."""
        if not len(p):
            return np.zeros(3)
        return np.array([p.max(), np.log1p(p.sum()), np.sqrt(p.sum() / len(p))])

    def scores(self, ps: list[np.ndarray]) -> np.ndarray:
        x = np.array([self.document(p) for p in ps]).reshape(-1, 3)
        return sigmoid(x @ self.final[:-1] + self.final[-1])


def marks(names: list[str], ids: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> set[str]:
    """Features of words that mark toxic tokens. names: the distinct tokens; ids: those of all texts' tokens; owner: their texts; toxic:
    whether a text is. One kind of feature is counted at a time: whole words, then beginnings of each length."""
    n, n1, out = len(toxic), int(toxic.sum()), set()
    p = n1 / n
    for kind in range(len(KINDS) + 1):
        own: dict[str, int] = {}
        feature = np.array([own.setdefault(f, len(own)) if (f := feature_of(t, kind)) else -1 for t in names], dtype=np.int64)
        pairs = owner * max(1, len(own)) + feature[ids]
        pairs = np.unique(pairs[feature[ids] >= 0])
        texts, f = pairs // max(1, len(own)), pairs % max(1, len(own))
        seen, seen1 = np.bincount(f, minlength=len(own)), np.bincount(f[toxic[texts]], minlength=len(own))
        z = (seen1 - seen * p) / np.sqrt(np.maximum(seen, 1) * p * (1 - p))
        ratio = (seen1 / n1) / ((seen - seen1 + 0.5) / (n - n1 + 1))
        good = (z >= SIGMAS) & (ratio >= RATIO) & (seen1 > 0)
        out |= {name for name, i in own.items() if good[i]}
    return out


def fit(rows: list[tuple[int, str, int]], counts: dict[int, int], steps: int = 60) -> Model:
    """rows: (doc_id, text, label); all their tokens are learnt from, by the features that toxic ones have. Without rows of both classes
    the score is the share of toxic rows, or near 0."""
    y = np.array([r[2] for r in rows], dtype=bool)
    n1, total = int(y.sum()), sum(counts.values())
    if not 0 < n1 < len(y):
        share = (counts.get(1, 0) + 0.5) / (total + 1) if total else 0.01
        return Model(final=np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))]))
    tokens, texts = {}, []
    for _, text, _ in rows:
        found = TOKEN.findall(text.lower())
        texts.append(np.fromiter((tokens.setdefault(t, len(tokens)) for t in found), dtype=np.int32, count=len(found)))
    names, sizes = list(tokens), np.array(list(map(len, texts)), dtype=np.int64)
    ids, owner = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
    del texts, tokens
    marked = marks(names, ids, owner, y)
    toxic = np.array([any(f in marked for f in features(t)) for t in names], dtype=bool)
    gold = (toxic[ids] & y[owner]).astype(np.float64)
    known = sorted({f for t, bad in zip(names, toxic.tolist(), strict=True) if bad for f in features(t)})
    index = {f: i + 1 for i, f in enumerate(known)}
    held = np.zeros((len(names), len(KINDS) + 1), dtype=np.int32)  # the features of each distinct token; 0 stands for none
    for row, t in enumerate(names):
        held[row] = [index.get(feature_of(t, kind), 0) for kind in range(len(KINDS) + 1)]
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(2 * TOGETHER, sizes.sum(), 2 * TOGETHER)) + 1
    parts = [(k, Chains.of(sizes[k])) for k in np.split(np.arange(len(sizes)), np.unique(cuts)) if len(k)]
    ends = np.r_[0, np.cumsum(sizes)]
    same = np.flatnonzero(owner[1:] == owner[:-1])
    seen = np.bincount((2 * gold[same] + gold[same + 1]).astype(np.int64), minlength=4).reshape(2, 2)
    del same, owner
    w, edge, bias = np.zeros(len(index) + 1), np.zeros((2, 2)), np.array([-3.0])
    adam = Adam(w, edge, bias, rate=0.2)
    for _ in range(steps):
        score, by_token, ge = w[held].sum(axis=1) + bias[0], np.zeros(len(names)), -seen.astype(float)
        for k, chains in parts:
            at = slice(ends[k[0]], ends[k[-1] + 1])
            p, expected = pair_sums(score[ids[at]], chains, edge)
            # the slope of the log likelihood is what the model expects less what the labels have
            by_token += np.bincount(ids[at], p - gold[at], minlength=len(names))
            ge += expected
        slope = by_token / len(y)
        gw = np.bincount(held.reshape(-1), np.repeat(slope, held.shape[1]), minlength=len(w)) + 1e-5 * w
        gw[0] = 0
        adam.step(gw, ge / len(y) + 1e-3 * edge, np.array([slope.sum()]))
    model = Model({f: float(w[i]) for f, i in index.items()}, edge, bias=float(bias[0]))
    score, x = w[held].sum(axis=1) + bias[0], []
    for k, chains in parts:
        p = marginals(score[ids[ends[k[0]] : ends[k[-1] + 1]]], sizes[k], edge, chains)
        x += [model.document(q) for q in np.split(p, np.cumsum(sizes[k])[:-1])]
    weight = np.where(y, counts[1] / n1, counts[0] / (len(y) - n1))
    model.final = logistic(np.array(x), y.astype(float), weight / weight.mean())
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on a bounded sample: SAMPLE rows of either class, texts of at most MOST_CHARS characters."""
    return fit(*sample(docs, labels, "toxic", SAMPLE, MOST_CHARS, id_col, text_col))


def lowered(text: str) -> tuple[str, list[int] | None]:
    """(text in lower case, place in text of each of its characters; None if they are the same)."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    places = [i for i, c in enumerate(text) for _ in c.lower()]
    return low, [*places, len(text)]


def spans_of(text: str, p: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """(start, end, highest marginal) of runs of tokens with a marginal of at least `least`; offsets are characters of text."""
    if not len(p) or p.max() < least:
        return []
    low, places = lowered(text)
    out: list[list] = []
    last = -2
    for i, m in enumerate(TOKEN.finditer(low)):
        if p[i] >= least:
            if last == i - 1:
                out[-1][1:] = [m.end(), max(out[-1][2], float(p[i]))]
            else:
                out.append([m.start(), m.end(), float(p[i])])
            last = i
    return [(a, b, q) if places is None else (places[a], places[b - 1] + 1, q) for a, b, q in out]


def judged(model: Model, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, list[np.ndarray]]]:
    """(some of the texts, their scores, the marginals of their tokens), in order."""
    for group in groups(texts):
        ps = model.tokens([TOKEN.findall(t.lower()) for t in group])
        yield group, model.scores(ps), ps


def tag(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1) and spans (start, end, p: characters of the text and highest marginal). Null and
    empty texts get the score of a text without tokens; null identifiers stay null; repeated rows are repeated; other columns are
    ignored; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores, spans = [], []
            for group, score, ps in judged(shared.value, list(batch.text)):
                scores.append(score)
                spans += [[{"start": a, "end": b, "p": q} for a, b, q in spans_of(t, p, least)] for t, p in zip(group, ps, strict=True)]
            yield pd.DataFrame({"doc_id": batch.doc_id.to_numpy(), "score": np.concatenate([*scores, np.zeros(0)]), "spans": spans})

    schema = "doc_id long, score double, spans array<struct<start: int, end: int, p: double>>"
    return ids_and_text(docs, id_col, text_col).mapInPandas(run, schema).withColumn("doc_id", real_id())


def toxic_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and spans for every row."""
    scored = tag(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(
        "doc_id",
        F.coalesce(crc_fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "spans",
    )


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns; texts don't move."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.concatenate([*(s for _, s, _ in judged(shared.value, [t or "" for t in texts])), np.zeros(0)])
        tidy()
        return pd.Series(out)

    return docs.filter(score(F.col(f"`{text_col}`")) < threshold)
