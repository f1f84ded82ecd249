"""Hidden Markov models, local alignment scores and random sequences, each per sequence in Arrow batches."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sequences that step together have at most so many symbols, padding included.
CELLS = 1 << 20


@dataclass(frozen=True)
class HiddenMarkov:
    """`start` (M), `move` (M x M), `end` (M) and `emit` (M x K) probabilities; symbols outside the alphabet are emitted with probability 1."""

    alphabet: str
    start: Sequence[float]
    move: Sequence[Sequence[float]]
    end: Sequence[float]
    emit: Sequence[Sequence[float]]

    def _emissions(self, seq: str) -> np.ndarray:
        e = np.asarray(self.emit, float)
        table = {c: e[:, k] for k, c in enumerate(self.alphabet)}
        other = np.ones(len(e))
        return np.array([table.get(c, other) for c in seq])

    def _blocks(self, seqs: Sequence[str], cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The places of nonempty sequences, the longest first, their lengths, and their symbols' numbers, one row each; a block has at most `cells` symbols or one sequence."""
        letters = np.array([ord(c) for c in self.alphabet], dtype=np.uint32)
        order = np.argsort(letters)
        places = sorted((k for k, s in enumerate(seqs) if s), key=lambda k: -len(seqs[k]))
        at = 0
        while at < len(places):
            part = places[at : at + max(1, cells // len(seqs[places[at]]))]
            lengths = np.array([len(seqs[k]) for k in part])
            codes = np.zeros((len(part), lengths[0]), dtype=np.int64)
            found = np.frombuffer("".join(seqs[k] for k in part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            near = order[np.minimum(np.searchsorted(letters, found, sorter=order), len(letters) - 1)]
            codes[np.arange(lengths[0]) < lengths[:, None]] = np.where(letters[near] == found, near, len(letters))
            yield np.array(part), lengths, codes
            at += len(part)

    def _emitted(self) -> np.ndarray:
        """Emissions by symbol number; the last row is that of other symbols."""
        e = np.asarray(self.emit, float)
        return np.vstack([e.T, np.ones(len(e))])

    def log_likelihoods(self, seqs: Sequence[str]) -> np.ndarray:
        """Natural logs of the sequences' probabilities by the forward recursion, scaled at each step; all sequences of a block step together. An empty sequence gives 0."""
        out, move, emitted = np.zeros(len(seqs)), np.asarray(self.move, float), self._emitted()
        for part, lengths, codes in self._blocks(seqs):
            total, f = np.zeros(len(part)), np.tile(np.asarray(self.start, float), (len(part), 1))
            with np.errstate(divide="ignore"):
                for k in range(lengths[0]):
                    m = np.searchsorted(-lengths, -k, side="left")  # rows longer than k
                    now = (f[:m] if k == 0 else f[:m] @ move) * emitted[codes[:m, k]]
                    s = now.sum(axis=1)
                    total[:m] += np.log(s)
                    f[:m] = now / np.where(s > 0, s, 1)[:, None]
                out[part] = total + np.log(f @ np.asarray(self.end, float))
        return out

    def log_likelihood(self, seq: str) -> float:
        return float(self.log_likelihoods([seq])[0])

    def posterior(self, seq: str) -> np.ndarray:
        """Probability of each state at each place."""
        e, move = self._emissions(seq), np.asarray(self.move, float)
        n = len(e)
        if not n:
            return np.zeros((0, len(self.start)))
        f, b = np.zeros((n, len(move))), np.zeros((n, len(move)))
        for k in range(n):
            f[k] = (np.asarray(self.start, float) if k == 0 else f[k - 1] @ move) * e[k]
            f[k] /= f[k].sum() or 1.0
        b[-1] = np.asarray(self.end, float)
        for k in range(n - 2, -1, -1):
            b[k] = move @ (e[k + 1] * b[k + 1])
            b[k] /= b[k].sum() or 1.0
        p = f * b
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)

    def expected_counts(self, seq: str) -> tuple[np.ndarray, ...]:
        """The log-likelihood, and expected numbers of starts, moves, ends and emissions over all paths of a sequence."""
        e, move = self._emissions(seq), np.asarray(self.move, float)
        n, states = len(e), len(move)
        f, b, scale = np.zeros((n, states)), np.zeros((n, states)), np.zeros(n)
        for k in range(n):
            f[k] = (np.asarray(self.start, float) if k == 0 else f[k - 1] @ move) * e[k]
            scale[k] = f[k].sum()
            f[k] /= scale[k]
        last = float(f[-1] @ np.asarray(self.end, float))
        b[-1] = np.asarray(self.end, float) / last
        for k in range(n - 2, -1, -1):
            b[k] = move @ (e[k + 1] * b[k + 1]) / scale[k + 1]
        p = f * b
        moves = move * (f[:-1].T @ (e[1:] * b[1:] / scale[1:, None])) if n > 1 else np.zeros_like(move)
        at = {c: k for k, c in enumerate(self.alphabet)}
        emitted = np.zeros((states, len(self.alphabet)))
        for c, row in zip(seq, p):
            if c in at:
                emitted[:, at[c]] += row
        return np.array([np.log(scale).sum() + np.log(last)]), p[0], moves, p[-1], emitted

    def summed_counts(self, seqs: Sequence[str]) -> tuple[np.ndarray, ...]:
        """The sums of `expected_counts` over sequences, all of a block stepping together; empty ones and those that the model cannot give are left out."""
        states, kinds = len(self.start), len(self.alphabet)
        start, move, end, emitted = np.asarray(self.start, float), np.asarray(self.move, float), np.asarray(self.end, float), self._emitted()
        log, starts, moves, ends, emits = np.zeros(1), np.zeros(states), np.zeros((states, states)), np.zeros(states), np.zeros((kinds + 1, states))
        for _, lengths, codes in self._blocks(seqs, max(1, CELLS // states)):
            n, longest = codes.shape
            f, b, scale = np.zeros((longest, n, states)), np.zeros((longest, n, states)), np.ones((longest, n))
            held = [int(np.searchsorted(-lengths, -k, side="left")) for k in range(longest)]  # rows longer than k
            for k, m in enumerate(held):
                now = (np.tile(start, (m, 1)) if k == 0 else f[k - 1, :m] @ move) * emitted[codes[:m, k]]
                scale[k, :m] = now.sum(axis=1)
                f[k, :m] = now / np.where(scale[k, :m] > 0, scale[k, :m], 1)[:, None]
            rows = np.arange(n)
            last = f[lengths - 1, rows] @ end
            known = (scale > 0).all(axis=0) & (last > 0)
            log += np.log(scale[:, known]).sum() + np.log(last[known]).sum()
            b[lengths - 1, rows] = np.where(known[:, None], end / np.where(known, last, 1)[:, None], 0.0)
            for k in range(longest - 2, -1, -1):
                m = held[k + 1]
                ahead = emitted[codes[:m, k + 1]] * b[k + 1, :m] / np.where(scale[k + 1, :m] > 0, scale[k + 1, :m], 1)[:, None]
                b[k, :m] = ahead @ move.T
                moves += f[k, :m].T @ ahead
            p = f * b  # nothing for what is left out, as b is zero there
            starts += p[0].sum(axis=0)
            ends += p[lengths - 1, rows].sum(axis=0)
            for state in range(states):
                emits[:, state] += np.bincount(codes.T.ravel(), weights=p[:, :, state].ravel(), minlength=kinds + 1)
        return log, starts, move * moves, ends, emits[:kinds].T

    def best_paths(self, seqs: Sequence[str]) -> list[tuple[float, list[int]]]:
        """Log probability and states of each sequence's likeliest path; ties take the least state."""
        out: list[tuple[float, list[int]]] = [(0.0, [])] * len(seqs)
        with np.errstate(divide="ignore"):
            start, move, end, emitted = (np.log(np.asarray(x, float)) for x in (self.start, self.move, self.end, self._emitted()))
        for part, lengths, codes in self._blocks(seqs):
            n, longest = codes.shape
            back = np.zeros((longest, n, len(start)), dtype=np.int32)
            v = start + emitted[codes[:, 0]]
            for k in range(1, longest):
                m = np.searchsorted(-lengths, -k, side="left")
                step = v[:m, :, None] + move
                back[k, :m] = step.argmax(axis=1)
                v[:m] = step.max(axis=1) + emitted[codes[:m, k]]
            v = v + end
            path = np.zeros((n, longest), dtype=np.int64)
            rows = np.arange(n)
            path[rows, lengths - 1] = v.argmax(axis=1)
            for k in range(longest - 1, 0, -1):
                m = np.searchsorted(-lengths, -k, side="left")
                path[:m, k - 1] = back[k, rows[:m], path[:m, k]]
            for row, place in enumerate(part):
                out[place] = (float(v[row].max()), path[row, : lengths[row]].tolist())
        return out

    def best_path(self, seq: str) -> tuple[float, list[int]]:
        return self.best_paths([seq])[0]


def per_sequence(seq: Column, f: Callable[[str], object], returns: str) -> Column:
    """`f` of each sequence; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if s is None else f(s) for s in batch])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returnType=returns)(seq)


def _per_batch(seq: Column, f: Callable[[list[str]], Sequence], returns: str) -> Column:
    """`f` of the sequences of a batch together; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            held = batch[batch.notna()]
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            for place, value in zip(held.index, f(held.tolist())):
                out.at[place] = value
            yield out

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returnType=returns)(seq)


def log_likelihood(seq: Column, model: HiddenMarkov) -> Column:
    return _per_batch(seq, lambda seqs: model.log_likelihoods(seqs).tolist(), "double")


def best_path(seq: Column, model: HiddenMarkov) -> Column:
    return _per_batch(seq, lambda seqs: [path for _, path in model.best_paths(seqs)], "array<int>")


def local_score(a: str, b: str, scores: Mapping[tuple[str, str], float], opening: float, extending: float, other: float = 0.0) -> float:
    """Best local alignment score with affine gaps. A gap opens from a match only: no insertion follows a deletion. Pairs outside `scores` score `other`; never below 0."""
    n = len(b)
    if not a or not n:
        return 0.0
    rows = {c: np.array([scores.get((c, d), other) for d in b]) for c in set(a)}
    m = np.zeros(n + 1)
    x = np.full(n + 1, -np.inf)
    y = np.full(n + 1, -np.inf)
    best, steps = 0.0, extending * np.arange(n + 1)
    for c in a:
        before = np.maximum(np.maximum(m, np.maximum(x, y)), 0.0)
        new = np.zeros(n + 1)
        new[1:] = before[:-1] + rows[c]
        x = np.maximum(m + opening, x + extending)  # gaps along b's side, from the row above
        # along the row: the best opening so far, extended, is a running maximum
        run = np.maximum.accumulate(new + opening - steps)
        y = np.full(n + 1, -np.inf)
        y[1:] = run[:-1] + steps[:-1]
        m = new
        best = max(best, float(m.max()))
    return best


def shuffled(seq: Column, key: Column, *, seed: int) -> Column:
    """The symbols of each sequence in random order; the same seed and key give the same order on every attempt."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, keys in batches:
            out = []
            for s, k in zip(texts, keys):
                letters = list(s or "")
                random.Random(f"{seed}:{k}").shuffle(letters)
                out.append(None if s is None else "".join(letters))
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returnType="string")(seq, key.cast("string"))


def shuffle_pairs(seq: str, rng: random.Random) -> str:
    """A random order with the same counts of neighbouring pairs: a walk over all pairs, whose last exits form a tree to the last symbol."""
    if len(seq) < 3:
        return seq
    exits: dict[str, list[str]] = {}
    for a, b in zip(seq, seq[1:]):
        exits.setdefault(a, []).append(b)
    end = seq[-1]
    while True:
        last = {a: rng.choice(outs) for a, outs in exits.items() if a != end}
        reaches = {end}
        grown = True
        while grown:
            new = {a for a, b in last.items() if b in reaches} - reaches
            reaches |= new
            grown = bool(new)
        if set(last) <= reaches:
            break
    for a, outs in exits.items():
        if a in last:
            outs.remove(last[a])
        rng.shuffle(outs)
        if a in last:
            outs.append(last[a])
    at, out, used = seq[0], [seq[0]], dict.fromkeys(exits, 0)
    while used.get(at, 0) < len(exits.get(at, [])):
        k = used[at]
        used[at] += 1
        at = exits[at][k]
        out.append(at)
    return "".join(out)


def train(df: DataFrame, seq: str, model: HiddenMarkov, *, rounds: int = 20, tolerance: float = 1e-6, floor: float = 1e-6) -> tuple[HiddenMarkov, list[float]]:
    """The model after at most `rounds` rounds of expectation and maximisation, and the log-likelihood before each.

    Each task sums the expected counts of its sequences; what is summed over tasks is one number per
    parameter, whatever the number of sequences. `floor` is added to every count that may be nonzero.
    Sequences that the model cannot give, empty ones and nulls are left out.
    """
    size, kinds = len(model.start), len(model.alphabet)

    def flat(counts: tuple[np.ndarray, ...]) -> np.ndarray:
        return np.concatenate([np.ravel(c) for c in counts])

    def summed(now: HiddenMarkov) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + size + size * size + size + size * kinds)
            for batch in batches:
                total += flat(now.summed_counts(batch["s"].tolist()))
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

        return run

    seqs, history = df.select(F.col(seq).alias("s")).where("s IS NOT NULL AND s <> ''"), []
    for _ in range(rounds):
        rows = seqs.mapInPandas(summed(model), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # one row per parameter
        total = np.zeros(1 + size + size * size + size + size * kinds)
        for r in rows:
            total[r["k"]] = r["v"]
        history.append(float(total[0]))
        start, move, end, emit = np.split(total[1:], np.cumsum([size, size * size, size]))
        start = start + floor * (np.asarray(model.start) > 0)
        leave = np.hstack([move.reshape(size, size) + floor * (np.asarray(model.move) > 0), (end + floor * (np.asarray(model.end) > 0))[:, None]])
        leave /= np.maximum(leave.sum(axis=1, keepdims=True), 1e-300)
        emit = emit.reshape(size, kinds) + floor * (np.asarray(model.emit) > 0)
        emit /= np.maximum(emit.sum(axis=1, keepdims=True), 1e-300)
        model = HiddenMarkov(model.alphabet, (start / start.sum()).tolist(), leave[:, :-1].tolist(), leave[:, -1].tolist(), emit.tolist())
        if len(history) > 1 and history[-1] - history[-2] < tolerance * abs(history[-1]):
            break
    return model, history
