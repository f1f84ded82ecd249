"""Exact byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A sequence of tokens is the encoding of a word exactly if every two neighbours are compatible, that
is, encoding their joined text gives back the two. So the encoder takes the longest token at the
current place (from one Aho-Corasick pass over the word), accepts it when it is compatible with the
token before it, tries ever shorter prefixes otherwise, and steps back when none fits. A bit per
place remembers dead ends, so each (place, token) is tried once and the time is linear in the word.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from strandframe.llm.common import per_text

#: Characters whose lower-casing and composition need no tables beyond Python's: ASCII and Latin letters.
SIMPLE = regex.compile(r"[\t\n\r\x20-\x7e¡-įı-ſ]*+")
#: A word memo is emptied when it holds so many words; longer words are not kept.
MEMO_WORDS = 600_000
MEMO_CHARS = 64
#: First code of the letters that stand for a byte at the end of a word.
END = 0xE000


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The encoder of one vocabulary file with `</w>` word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split_re = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.path = path
        self._library = None
        letters = byte_letters()
        self.inner = {c: chr(b) for b, c in enumerate(letters)}
        self.inner_text = {ord(c): chr(b) for b, c in enumerate(letters)}
        self._build(model["merges"])
        self._offsets(spec)
        self.memo: dict[str, bytes] = {}

    def _key(self, token: str) -> str:
        """The token over an alphabet of 512 letters: the bytes, and the bytes that end a word."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)].translate(self.inner_text)
            return body[:-1] + chr(END + ord(body[-1]))
        return token.translate(self.inner_text)

    def _build(self, merges: list) -> None:
        n = max(self.vocab.values()) + 1
        self.rank = [-1] * n
        self.left, self.right = list(range(n)), list(range(n))
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merged[x, y] = r
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.keys = {self._key(t): i for t, i in self.vocab.items()}
        self.length = [0] * n
        self.automaton = ahocorasick.Automaton()
        reachable = {k: i for k, i in self.keys.items() if len(k) == 1 or self._replay(k) == [i]}
        for k, i in reachable.items():
            self.length[i] = len(k)
            self.automaton.add_word(k, i)
        self.automaton.make_automaton()
        self.shorter: list[int] = [-1] * n  # the longest other token that starts a token
        for k, i in reachable.items():
            for m in range(len(k) - 1, 0, -1):
                if (j := reachable.get(k[:m])) is not None:
                    self.shorter[i] = j
                    break
        self.compatible: dict[tuple[int, int], bool] = {}

    def _replay(self, key: str) -> list[int]:
        """The merges applied one by one; only used to find tokens that their own text never gives."""
        ids = [self.keys[c] for c in key]
        while len(ids) > 1:
            r, at = min((self.merged.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if r == 1 << 60:
                break
            ids[at : at + 2] = [self._of_rank(ids[at], ids[at + 1])]
        return ids

    def _of_rank(self, a: int, b: int) -> int:
        if not hasattr(self, "_names"):
            self._names = {i: t for t, i in self.vocab.items()}
        return self.vocab[self._names[a] + self._names[b]]

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the seam of a and b: their merges are undone from the last, and a pair at the seam must never have come first."""
        pair = (a, b)
        known = self.compatible.get(pair)
        if known is not None:
            return known
        rank, limit, ok = self.rank, 1 << 60, True
        while True:
            r = self.merged.get((a, b))
            if r is not None and r < limit:
                ok = False
                break
            if rank[a] < 0 and rank[b] < 0:
                break
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            else:
                limit, b = rank[b] + 1, self.left[b]
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[pair] = ok
        return ok

    def word_ids(self, word: str) -> list[int]:
        """The ids of one word, given as its UTF-8 bytes in Latin-1."""
        key = word[:-1] + chr(END + ord(word[-1]))
        whole = self.keys.get(key)
        if whole is not None and self.length[whole]:
            return [whole]
        n = len(key)
        longest = [-1] * (n + 1)
        size = self.length
        for end, token in self.automaton.iter(key):
            start = end + 1 - size[token]
            if longest[start] < 0 or size[token] > size[longest[start]]:
                longest[start] = token
        alive = [True] * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + size[token]
                if alive[end] and (last < 0 or self.fits(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at]
            else:
                alive[at] = False
                if last < 0:
                    raise ValueError("the vocabulary lacks a byte")
                out.pop()
                at -= size[last]
                token = last
        return out

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens. Texts beyond Latin letters go through the library's own normaliser and splitter, whose Unicode tables may be older or newer than Python's."""
        if SIMPLE.fullmatch(text):
            return self.split_re.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [w.translate(self.inner_text).encode("latin-1").decode() for w, _ in words]

    def _word_bytes(self, word: str) -> bytes:
        ids = np.array(self.word_ids(word if word.isascii() else word.encode().decode("latin-1")), dtype="<u4").tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers. Null gives none, as the empty text does."""
        if not text:
            return b""
        if self.special_re is not None and "<|" in text:
            parts = self.special_re.split(text)
        else:
            parts = [text]
        out, memo = [], self.memo
        for part in parts:
            if part in self.special:
                out.append(int(self.special[part]).to_bytes(4, "little"))
            elif part:
                out += [memo.get(w) or self._word_bytes(w) for w in self.words(part)]
        return b"".join(out)

    def _offsets(self, spec: dict) -> None:
        names = dict((i, t) for t, i in self.vocab.items()) | {i: t for t, i in self.special.items()}
        parts = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
        if spec.get("decoder") is not None:
            raise ValueError("only vocabularies without a decoder step are read")

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts, one space between two, in UTF-8: each id's bytes are gathered from the blob by its offset."""
        out, step = [], 1 << 16
        codes = np.frombuffer(ids, dtype="<u4")
        for i in range(0, len(codes), step):
            part = codes[i : i + step]
            size = self.size[part]
            ends = np.cumsum(size)
            index = np.repeat(self.start[part] - (ends - size), size)
            index += np.arange(ends[-1])
            out.append(self.blob[index].tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


ENCODE_SCHEMA = "n_tokens long, ids binary, decoded string"
DIGEST_SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded text.

    Null and empty texts have no tokens and decode to the empty text. Repeated rows give repeated
    rows; columns other than the two named are ignored. An empty table gives an empty result.
    """

    def make() -> Callable:
        bpe = encoder(path)

        def work(texts: Sequence[str | None]) -> dict[str, list]:
            ids = [bpe.encode(t) for t in texts]
            return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [bpe.decode(x).decode() for x in ids]}

        return work

    return per_text(docs, make, ENCODE_SCHEMA, id_col=id_col, text_col=text_col)


def _digests(path: str, with_ids: bool) -> Callable:
    def make() -> Callable:
        bpe = encoder(path)

        def work(texts: Sequence[str | None]) -> dict[str, list]:
            out: dict[str, list] = {"n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
            for t in texts:
                ids = bpe.encode(t)
                out["n_tokens"].append(len(ids) // 4)
                out["ids"].append(ids if with_ids else None)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            if not with_ids:
                del out["ids"]
            return out

        return work

    return make


def digest_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, but with the SHA-256 of the ids and of the decoded text in place of them, so that only digests leave the task."""
    return per_text(docs, _digests(path, False), DIGEST_SCHEMA, id_col=id_col, text_col=text_col)


def encode_and_digest(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As digest_documents, with the ids besides."""
    return per_text(docs, _digests(path, True), "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string", id_col=id_col, text_col=text_col)
