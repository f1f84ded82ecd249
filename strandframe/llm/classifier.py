"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A word's index vector is sparse, ternary and derived from the word's hash. Its word vector adds the
index vectors of its neighbours in the fitted texts. Words that those texts hold too rarely are
replaced by their shape. A document is the mean of its word vectors with its length and the share of
words that repeat the word before; the network's output is calibrated by one temperature.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import per_text
from strandframe.llm.sampling import fold, labelled_sample

DIMENSIONS = 64
NONZERO = 4
WINDOW = 2
LEAST_COUNT = 20
HIDDEN = 24
PER_LABEL = 1024
MOST_CHARS = 50_000
EPOCHS = 400
SEED = 7
MEMO_WORDS = 400_000


def shape(word: str) -> str:
    """A for capitals, a for small letters, 0 for digits, other characters as they are; repeats shrink to one."""
    core = word if word.isalpha() else word[:-1] if word[:-1].isalpha() and not word[-1].isdigit() else ""
    if core:
        tail = word[len(core) :]
        if core.islower():
            return f"\x00a{tail}"
        if len(core) > 1 and core[0].isupper() and core[1:].islower():
            return f"\x00Aa{tail}"
    out = re.sub(r"\d", "0", word)
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in out)
    return "\x00" + re.sub(r"(.)\1+", r"\1", out)[:8]


def index_vector(unit: str) -> np.ndarray:
    v = np.zeros(DIMENSIONS, dtype=np.float32)
    for k in range(NONZERO):
        h = xxhash.xxh64_intdigest(unit.encode("utf-8", "surrogatepass"), k)
        v[(h >> 1) % DIMENSIONS] += 1.0 if h & 1 else -1.0
    return v


@dataclass
class QualityModel:
    vocabulary: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0
    memo: dict[str, int] = field(default_factory=dict)

    def unit(self, word: str) -> int:
        k = self.vocabulary.get(word)
        if k is None:
            k = self.vocabulary.get(shape(word), 0)
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        if len(word) <= 64:
            self.memo[word] = k
        return k

    def pooled(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        n = len(words)
        out = np.zeros(DIMENSIONS + 3, dtype=np.float32)
        if not n:
            return out
        memo, unit = self.memo, self.unit
        ids = np.fromiter([k if (k := memo.get(w)) is not None else unit(w) for w in words], dtype=np.int32, count=n)
        for i in range(0, n, 8192):
            out[:DIMENSIONS] += self.vectors[ids[i : i + 8192]].sum(axis=0)
        out[:DIMENSIONS] /= n
        out[-3] = np.log1p(n)
        out[-2] = sum(map(eq, words, words[1:])) / n
        out[-1] = len(set(words)) / n**0.85
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, texts: Sequence[str | None]) -> list[float]:
        if not len(texts):
            return []
        z = self.logits(np.vstack([self.pooled(t) for t in texts]))[:, 0] / self.temperature
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()


def word_vectors(texts: Sequence[str]) -> tuple[dict[str, int], np.ndarray]:
    """Words and shapes with at least LEAST_COUNT places, and their vectors; row 0 stands for all others."""
    split = [t.split() for t in texts]
    counts = Counter(w for ws in split for w in ws)
    shapes: Counter[str] = Counter()
    for w, n in counts.items():
        if n < LEAST_COUNT:
            shapes[shape(w)] += n
    units = sorted([w for w, n in counts.items() if n >= LEAST_COUNT] + [s for s, n in shapes.items() if n >= LEAST_COUNT])
    vocabulary = {u: i + 1 for i, u in enumerate(units)}
    index = np.vstack([np.zeros((1, DIMENSIONS), dtype=np.float32), *[index_vector(u)[None] for u in units]])
    context = np.zeros_like(index)
    known: dict[str, int] = {}
    for ws in split:
        ids = np.array([known[w] if w in known else known.setdefault(w, vocabulary.get(w) or vocabulary.get(shape(w), 0)) for w in ws], dtype=np.int64)
        for step in range(1, WINDOW + 1):
            np.add.at(context, ids[step:], index[ids[:-step]])
            np.add.at(context, ids[:-step], index[ids[step:]])
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return vocabulary, index + context / np.maximum(length, 1e-6)


def fit(rows: Sequence[tuple[str, int]]) -> QualityModel:
    """Fits on four fifths of the rows and sets the temperature on the rest. Without rows of both labels every score is the share of label 1 (0.5 without rows)."""
    texts, y = [t or "" for t, _ in rows], np.array([int(q) for _, q in rows], dtype=np.float64)
    vocabulary, vectors = word_vectors(texts)
    width = DIMENSIONS + 3
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, 1)), np.zeros(1)]
    model = QualityModel(vocabulary, vectors, np.zeros(width), np.ones(width), layers)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        model.layers = [layers[0] * 0, layers[1], layers[2] * 0, np.array([np.log(share / (1 - share))])]
        return model
    x = np.vstack([model.pooled(t) for t in texts]).astype(np.float64)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    test, train = order[:cut], order[cut:]
    z, t = (x[train] - model.mean) / model.scale, y[train][:, None]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for epoch in range(1, EPOCHS + 1):
        w1, b1, w2, b2 = layers
        h = np.maximum(z @ w1 + b1, 0)
        d = (1 / (1 + np.exp(-(h @ w2 + b2))) - t) / len(z)
        dh = d @ w2.T * (h > 0)
        for k, g in enumerate((z.T @ dh + 1e-3 * w1, dh.sum(axis=0), h.T @ d + 1e-3 * w2, d.sum(axis=0))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] -= 0.01 * first[k] / (1 - 0.9**epoch) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
    model.layers = layers
    out, truth = model.logits(x[test])[:, 0], y[test]
    loss = lambda s: np.mean(np.logaddexp(0, out / s) - truth * out / s)
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, per_label: int = PER_LABEL, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of `docs`: id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Learns from at most `per_label` texts of each label that are not held out. Null and empty texts
    are scored as a document without words. Repeated rows give repeated rows; other columns are
    ignored; an empty table gives an empty result, and without labels every score is 0.5.
    """
    known = labels.select(id_col, F.col(label_col).alias("label"))
    rows = labelled_sample(docs, known, per_label=per_label, most_chars=most_chars, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def make() -> Callable:
        model = shared.value

        def work(texts: Sequence[str | None]) -> dict[str, list]:
            return {"score": model.scores(texts)}

        return work

    out = per_text(docs, make, "score double", id_col=id_col, text_col=text_col)
    return out.select(id_col, (fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
