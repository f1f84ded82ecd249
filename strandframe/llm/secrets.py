"""Secret scans: fixed patterns, and values in credential contexts judged by what a guesser would pay.

The cost of a value is the least sum, over all ways to cut it into spans, of the spans' log10 guesses:
words (rank in a list, times the ways to write capitals and look-alike digits), dates, repeats,
keyboard walks, and brute force for the rest. A value whose cost reaches the threshold is a secret.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import lru_cache
from math import log10

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import bound_batches, per_text, text_udf

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

#: Credential contexts of the added spans: a name and a sign. A scheme before the value belongs to the context.
CONTEXT = re.compile(r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|(?:api|access|private|auth|secret)[_-]?key|auth(?:orization)?|credentials?|bearer)["']?\x20*(?::|=>|=|\bis\b)\x20*""", re.IGNORECASE | re.ASCII)
SCHEME = re.compile(r"(?:bearer|basic|digest|token)\x20+", re.IGNORECASE)
#: What follows: up to the closing quote on the line, or without one up to a space, quote, bracket, comma or semicolon.
QUOTED = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*(?={q})") for q in "\"'"}
UNQUOTED = re.compile(r"""[^\s"'<>(){}\[\],;]*""")
GUESS_LEAST = 6
CONTEXT_WORDS = ("pass", "pwd", "pin", "secret", "token", "key", "auth", "credential", "bearer")

#: log10 of the guesses from which a value counts as a secret.
LEAST_COST = 11.0
WORD_MOST = 24
LEAST_LETTERS = 3
#: The start of an address names nothing secret.
SCHEMES = re.compile(r"[a-z][a-z0-9+]{1,9}://(?:www\.)?", re.IGNORECASE | re.ASCII)
LOOK_ALIKE = str.maketrans("0134578@$!", "oieastbasi")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Frequent words of passwords and of the texts around them, the most frequent first.
COMMON_WORDS = """
password love admin welcome monkey dragon master hello login letmein shadow sunshine princess football
baseball superman batman trustno charlie michael jordan summer winter spring autumn flower cheese
computer secret access example sample test user guest root default changeme token key value string
null none true false your my the and for with this that from are not you all can was one our out day
get has him his how man new now old see two way who boy did its let put say she too use here there
""".split()


@lru_cache(maxsize=4)
def ranked_words(path: str) -> tuple[str, ...]:
    """The common words, then the whole words of a vocabulary file with `</w>` word ends, in its order: the more frequent a word, the sooner it was merged."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = (k[:-4].lower() for k in sorted(vocabulary, key=vocabulary.get) if k.endswith("</w>"))
    return tuple(dict.fromkeys([*COMMON_WORDS, *(w for w in whole if len(w) >= LEAST_LETTERS and w.isascii() and w.isalpha())]))


class GuessCost:
    """Least log10 guesses of a value. Every kind of span has a bounded number of starts per place, so the time is linear in the value."""

    def __init__(self, words: Sequence[str] = COMMON_WORDS):
        self.rank = {w.lower(): i + 1 for i, w in reversed(list(enumerate(words)))}
        self.most = max(map(len, self.rank), default=0)
        self.next_to: set[tuple[str, str]] = set()
        for row in ROWS:
            for a, b in zip(row, row[1:]):
                self.next_to |= {(a, b), (b, a)}

    def word(self, part: str) -> float | None:
        low = part.lower()
        rank, plain = self.rank.get(low), low
        if rank is None:
            plain = low.translate(LOOK_ALIKE)
            rank = self.rank.get(plain)
        if rank is None:
            return None
        cost = log10(rank + 1)
        if part != part.lower():
            cost += log10(2) if part.istitle() or part.isupper() else log10(2) * min(len(part), 8)
        return cost + (log10(2) * sum(a != b for a, b in zip(low, plain)))

    @staticmethod
    def alphabet(part: str) -> int:
        return 10 * any("0" <= c <= "9" for c in part) + 26 * any("a" <= c <= "z" for c in part) + 26 * any("A" <= c <= "Z" for c in part) + 33 * any(c < "\x80" and not c.isalnum() for c in part) + 100 * any(c >= "\x80" for c in part) or 10

    def spans(self, value: str) -> list[tuple[int, int, float]]:
        """(start, end, cost) of all words, dates, repeats and walks."""
        n, out = len(value), []
        for i in range(n):
            for j in range(i + 2, min(n, i + min(self.most, WORD_MOST)) + 1):
                c = self.word(value[i:j])
                if c is not None:
                    out.append((i, j, c))
        for m in re.finditer(r"(?=((?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?))", value, re.ASCII):
            out.append((m.start(), m.start() + len(m[1]), log10(200) + (log10(12) if len(m[1]) > 4 else 0) + (log10(31) if len(m[1]) > 7 else 0)))
        for m in re.finditer(r"(?=((?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d))", value, re.ASCII):
            out.append((m.start(), m.start() + len(m[1]), log10(200 * 372)))
        out += [(m.start(), m.end(), 1.0) for m in SCHEMES.finditer(value)]
        for period in range(1, 9):
            i = 0
            while i + period < n:
                j = i
                while j + period < n and value[j] == value[j + period]:
                    j += 1
                if j - i >= max(2, period):
                    out.append((i, j + period, period * log10(self.alphabet(value[i : i + period])) + log10((j + period - i) // period + 1)))
                i = j + 1
        i = 0
        while i + 1 < n:
            j = i
            while j + 1 < n and ((value[j].lower(), value[j + 1].lower()) in self.next_to):
                j += 1
            if j - i >= 2:
                turns = sum(ord(b) - ord(a) != ord(c) - ord(b) for a, b, c in zip(value[i:j], value[i + 1 :], value[i + 2 : j + 1]))
                out.append((i, j + 1, log10(47) + log10(j + 1 - i) + 0.3 * min(turns, 4)))
            i = max(j, i + 1)
        i = 0
        while i + 1 < n:  # rows of codes: abcd, 9876
            step = ord(value[i + 1]) - ord(value[i])
            j = i
            while j + 1 < n and ord(value[j + 1]) - ord(value[j]) == step:
                j += 1
            if abs(step) == 1 and j - i >= 2:
                out.append((i, j + 1, log10(47) + log10(j + 1 - i)))
            i = max(j, i + 1)
        return out

    def __call__(self, value: str) -> float:
        n = len(value)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i, j, c in self.spans(value):
            ending[j].append((i, c))
        each = log10(self.alphabet(value))
        best = [0.0] * (n + 1)
        for j in range(1, n + 1):
            best[j] = min([best[j - 1] + each, *(best[i] + c for i, c in ending[j])])
        return best[n]


class Scanner:
    def __init__(self, least_cost: float = LEAST_COST, words: Sequence[str] = COMMON_WORDS):
        self.cost, self.least = GuessCost(words), least_cost

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the fixed patterns, by start and then kind."""
        low = text.lower()
        out = []
        if any(w in low for w in ASSIGN_WORDS):
            out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if "AKIA" in text:
            out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
        out += [(*m.span(), "hex") for m in HEX.finditer(text)]
        return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))

    def added(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Values in credential contexts that are dear to guess and that the fixed patterns do not cover. What lies within a value that was judged is not judged again."""
        low = text.lower()
        if not any(w in low for w in CONTEXT_WORDS):
            return []
        out, k, judged, run = [], 0, 0, 0
        for m in CONTEXT.finditer(text):
            a, quoted = m.end(), None
            if scheme := SCHEME.match(text, a):
                a = scheme.end()
            if quotes := QUOTED.get(text[a : a + 1]):
                a += 1
                quoted = quotes.match(text, a)
                if scheme := SCHEME.match(text, a):
                    a = scheme.end()
            if quoted:
                b = quoted.end()
            else:
                if run <= a:  # a run is looked through once, however many names it holds
                    run = UNQUOTED.match(text, a).end()
                b = run
                while b > a and text[b - 1] in ".:!?":
                    b -= 1
            if b - a < GUESS_LEAST or b <= judged:
                continue
            while k < len(base) and base[k][1] <= a:
                k += 1
            i, covered = k, a
            while covered < b and i < len(base) and base[i][0] <= covered:
                covered = max(covered, base[i][1])
                i += 1
            if covered >= b:
                continue
            judged = b
            if self.cost(text[a:b]) >= self.least:
                out.append((a, b, "guess"))
        return out

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        if not text:
            return [], []
        base = self.base(text)
        more = self.added(text, base)
        return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def _shared(spark: SparkSession, least_cost: float, words: Sequence[str]) -> Callable[[], Scanner]:
    """Makes the scanner in a task; the dictionary, whose size its file bounds, is sent to an executor once."""
    sent = spark.sparkContext.broadcast(tuple(words))
    return lambda: Scanner(least_cost, sent.value)


def scan_documents(docs: DataFrame, *, least_cost: float = LEAST_COST, words: Sequence[str] = COMMON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_assign, n_access, n_hex, n_guess, base (string), spans (string).

    A null or empty text has no spans and empty strings. Spans that begin together are in the order
    of KINDS. Repeated rows give repeated rows; other columns are ignored; an empty table gives an
    empty result. `words` ranks the dictionary, the most frequent first.
    """
    scanner = _shared(docs.sparkSession, least_cost, words)

    def make() -> Callable:
        scan = scanner()

        def work(texts: Sequence[str | None]) -> dict[str, list]:
            both = [scan.spans(t) for t in texts]
            count = lambda kind: [sum(k == kind for *_, k in every) for _, every in both]
            return {f"n_{k}": count(k) for k in KINDS} | {"base": [listed(b) for b, _ in both], "spans": [listed(e) for _, e in both]}

        return work

    return per_text(docs, make, ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string", id_col=id_col, text_col=text_col)


def redact_column(docs: DataFrame, column: Column, *, least_cost: float = LEAST_COST, words: Sequence[str] = COMMON_WORDS) -> Column:
    """The text with every span replaced by [SECRET]; null stays null, an empty text stays empty. Overlapping spans leave one mark. A row's text is all that counts, so repeated rows, other columns and empty tables are no cases of their own."""
    bound_batches(docs.sparkSession)
    scanner = _shared(docs.sparkSession, least_cost, words)

    def make() -> Callable:
        scan = scanner()

        def work(texts: Sequence[str | None]) -> dict[str, list]:
            return {"text": [t if not t or not (s := scan.spans(t)[1]) else redacted(t, s) for t in texts]}

        return work

    return text_udf(make, "text string")(column)["text"]


def digest(scanned: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    return scanned.select(id_col, "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_guess")
