"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts sums, over n = 1, 2, 3, the share of character
n-grams that both hold (cosine of the presence vectors). N-grams are over lower-case code points of
any script; what is no letter counts as one gap. They are hashed to 2^18 places an order. Nyström
landmarks turn kernel rows into features, on which one ridge regression per language is solved;
scoring a batch is two matrix products.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import per_text
from strandframe.llm.sampling import fold, labelled_sample

#: The places of the n-grams of one order are so many bits wide.
PLACE_BITS = 18
PER_LANGUAGE = 384
LANDMARKS = 192
MOST_CHARS = 50_000
RIDGE = 1e-2
SHARPNESS = 6.0
ORDERS = (1, 2, 3)
PLACES = 1 << PLACE_BITS
#: Odd multipliers of the hash: one between the letters of an n-gram, one that spreads the result.
STEP = np.uint64(0x100000001B3)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point the lower-case letter, or 0 if it is none."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint64)


def letters(text: str) -> np.ndarray:
    """The lower-case code points of the letters; other runs shrink to one 0."""
    out = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    gap = out == 0
    return out[~(gap & np.concatenate([[False], gap[:-1]]))]


def ngrams(text: str | None, flags: np.ndarray) -> list[np.ndarray]:
    """For each order the places of the n-grams that the text holds, none for a text without a letter; `flags` is scratch space, false before and after."""
    c = letters(text or "")
    if not c.any():
        return [np.zeros(0, dtype=np.int64) for _ in ORDERS]
    out, mixed = [], c
    for n in ORDERS:
        if n > 1:
            mixed = mixed[:-1] * STEP + c[n - 1 :] if len(c) >= n else c[:0]
        place = ((mixed + np.uint64(n)) * SPREAD >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
        if len(place) > 4000:
            flags[place] = True
            found = np.flatnonzero(flags)
            flags[found] = False
        else:
            found = np.unique(place)
        out.append(found)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    column: np.ndarray  # of each n-gram: its row in `landmarks`, or the last row, which is zero
    landmarks: np.ndarray  # n-grams x landmarks
    order_of: np.ndarray  # of each row: its order's index
    weights: np.ndarray  # (landmarks + 1) x languages

    def kernel(self, grams: Sequence[list[np.ndarray]]) -> np.ndarray:
        rows = np.zeros((len(grams), len(self.landmarks)), dtype=np.float32)
        for i, orders in enumerate(grams):
            for k, codes in enumerate(orders):
                if len(codes):
                    rows[i, self.column[codes + PLACES * k]] = 1 / np.sqrt(len(codes))
        rows[:, -1] = 0
        return rows @ self.landmarks

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        flags = np.zeros(PLACES, dtype=bool)
        langs, scores = [], []
        for i in range(0, len(texts), 128):
            part = texts[i : i + 128]
            grams = [ngrams(t, flags) for t in part]
            k = self.kernel(grams)
            z = np.hstack([k, np.ones((len(k), 1), dtype=np.float32)]) @ self.weights
            p = np.exp(SHARPNESS * (z - z.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for j, g in enumerate(grams):
                blank = not len(g[0])
                langs.append("und" if blank else self.languages[best[j]])
                scores.append(0.0 if blank else float(p[j, best[j]]))
        return langs, scores


def fit(rows: Sequence[tuple[str, str]], *, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """A model of the languages in `rows`; with no rows every text is `und` or the one language there is."""
    languages = sorted({lang for _, lang in rows})
    flags = np.zeros(PLACES, dtype=bool)
    grams = [ngrams(t, flags) for t, _ in rows]
    by = {lang: [i for i, (_, x) in enumerate(rows) if x == lang] for lang in languages}
    each = max(1, landmarks // max(1, len(languages)))
    chosen = [i for lang in languages for i in by[lang][:: max(1, len(by[lang]) // each)][:each]]
    seen = sorted({int(c) + PLACES * k for i in chosen for k, codes in enumerate(grams[i]) for c in codes})
    column = np.full(PLACES * len(ORDERS), len(seen), dtype=np.int32)
    column[seen] = np.arange(len(seen))
    marks = np.zeros((len(seen) + 1, len(chosen)), dtype=np.float32)
    for j, i in enumerate(chosen):
        for k, codes in enumerate(grams[i]):
            if len(codes):
                marks[column[codes + PLACES * k], j] = 1 / np.sqrt(len(codes)) / len(ORDERS)
    model = LanguageModel(languages, column, marks, np.zeros(0), np.zeros((len(chosen) + 1, max(1, len(languages))), dtype=np.float32))
    if not languages:
        model.languages = ["und"]
        return model
    k = np.vstack([model.kernel(grams[i : i + 256]) for i in range(0, len(grams), 256)]).astype(np.float64)
    values, vectors = np.linalg.eigh(k[chosen])
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.hstack([k @ root, np.ones((len(k), 1))])
    y = np.array([[1.0 if lang == x_ else -1.0 for x_ in languages] for _, lang in rows])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.linalg.solve(x.T @ x / len(x) * 1.0 + penalty / len(x) ** 0.5, x.T @ y / len(x))
    model.weights = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def identify(docs: DataFrame, *, per_language: int = PER_LANGUAGE, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: id, held_out, lang_pred, score (0 to 1).

    Learns from at most `per_language` texts of each language that are not held out. Null texts and
    texts without a letter are `und` with score 0; a null language is not learned from. Repeated
    rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    labels = docs.select(id_col, F.col(lang_col).alias("label"))
    rows = labelled_sample(docs, labels, per_label=per_language, most_chars=most_chars, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def make() -> Callable:
        model = shared.value

        def work(texts: Sequence[str | None]) -> dict[str, list]:
            langs, scores = model.predict(texts)
            return {"lang_pred": langs, "score": scores}

        return work

    out = per_text(docs, make, "lang_pred string, score double", id_col=id_col, text_col=text_col)
    return out.select(id_col, (fold(id_col) == 0).alias("held_out"), "lang_pred", "score")
