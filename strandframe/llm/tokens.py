"""Token counts with a SentencePiece vocabulary, exact for documents of any length.

Short texts are encoded whole. Longer ones are encoded in overlapping chunks, with the places of the
tokens. Merging works on neighbours only, so a sequence of tokens is the encoding of a text exactly if
every two neighbours are (as encoding the two alone would give them back). Where the encodings of two
overlapping chunks share the token before and the token after a boundary, the splice of both at that
boundary has only neighbours that stand in one of the two, so it is the encoding of the joined text.
Where they share no such boundary, the overlap is doubled until they do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import per_text

MARK = "▁"
#: Longer texts are encoded in chunks of so many characters that overlap by so many at first.
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256


class Tokens:
    """The tokens of a chunk: ids, and the first place and the place behind each in the whole text. The library's own mark before a chunk lies before its start; of a character spelled in bytes, the first byte has it all."""

    def __init__(self, ids: np.ndarray, widths: np.ndarray, start: int):
        self.ids = ids
        self.end = np.cumsum(widths) + start
        self.begin = self.end - widths

    def between(self, low: int, high: int) -> int:
        """How many tokens begin in [low, high)."""
        return int(np.count_nonzero((self.begin >= low) & (self.begin < high)))


class PieceCounter:
    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Whether the library puts a space before a text.
        self.adds_mark = self.model.encode("x", out_type=str)[0].startswith(MARK)
        self.width = np.array([self._width(i) for i in range(self.model.get_piece_size())], dtype=np.int64)
        self.chunk, self.overlap = chunk, overlap
        self.splices = self.widened = 0

    def _width(self, i: int) -> int:
        """The characters of the text that a token stands for."""
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return int(not 0x80 <= int(piece[3:5], 16) < 0xC0)
        return 1 if self.model.is_unknown(i) else len(piece)

    def count(self, text: str | None) -> int:
        """The number of tokens that the library gives for the text; 0 for null."""
        if not text:
            return 0
        if len(text) <= self.chunk:
            return len(self.model.encode(text))
        return self.chunked(text)

    def _tokens(self, text: str, start: int, end: int) -> Tokens | None:
        """None if the tokens do not add up to the characters: then the normaliser has changed the text, and places are not known."""
        ids = np.array(self.model.encode(text[start:end]), dtype=np.int64)
        out = Tokens(ids, self.width[ids], start - self.adds_mark)
        return out if len(ids) and out.end[-1] == end else None

    def chunked(self, text: str) -> int:
        n, total = len(text), 0
        done, start, end = -1, 0, min(self.chunk, n)  # tokens that begin before `done` are counted
        current = self._tokens(text, start, end)
        while end < n:
            overlap = self.overlap
            while True:
                first = max(0, end - overlap)
                following_end = min(n, max(first, end) + self.chunk)
                following = self._tokens(text, first, following_end)
                if current is None or following is None:
                    return len(self.model.encode(text))
                at = self._splice(current, following, max(first, done), end)
                if at is not None:
                    break
                self.widened += 1
                if first <= done:  # nothing left to widen: take both chunks as one
                    first = start
                    following = self._tokens(text, start, following_end)
                    if following is None:
                        return len(self.model.encode(text))
                    at = done
                    break
                overlap *= 2
            self.splices += 1
            total += current.between(done, at)
            current, start, end, done = following, first, following_end, at
        return len(self.model.encode(text)) if current is None else total + current.between(done, n + 1)

    @staticmethod
    def _splice(a: Tokens, b: Tokens, low: int, high: int) -> int | None:
        """The last boundary in (low, high) with the same token on either side in both."""
        right = int(np.searchsorted(b.begin, high))
        known = {(int(b.begin[k]), int(b.ids[k - 1]), int(b.ids[k]), int(b.begin[k - 1])) for k in range(1, right)}
        for k in range(len(a.ids) - 1, 0, -1):
            at = int(a.begin[k])
            if at <= low:
                return None
            if a.end[k] > at and (at, int(a.ids[k - 1]), int(a.ids[k]), int(a.begin[k - 1])) in known:
                return at
        return None


@lru_cache(maxsize=4)
def counter(path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> PieceCounter:
    return PieceCounter(path, chunk, overlap)


def count_tokens(docs: DataFrame, path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null counts as the empty text: no bytes, no tokens. Repeated rows give repeated rows; other
    columns are ignored; an empty table gives an empty result.
    """

    def make() -> Callable:
        count = counter(path)

        def work(texts: Sequence[str | None]) -> dict[str, list]:
            return {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": [count.count(t) for t in texts]}

        return work

    return per_text(docs, make, "n_bytes long, n_tokens long", id_col=id_col, text_col=text_col).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
