"""Integer and symbol codes as strings of bits, written by column expressions."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def elias_gamma(n: Column) -> Column:
    """n >= 1: as many zeros as n has bits after the first, then n."""
    b = F.bin(n.cast("long"))
    return F.when(n >= 1, F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b))


def elias_delta(n: Column) -> Column:
    b = F.bin(n.cast("long"))
    return F.when(n >= 1, F.concat(elias_gamma(F.length(b)), F.substr(b, F.lit(2), F.length(b))))


def golomb_rice(n: Column, low_bits: int) -> Column:
    """n >= 0: n >> low_bits ones, a zero, and the low bits."""
    q = F.shiftright(n.cast("long"), low_bits)
    low = F.lpad(F.bin(n.cast("long").bitwiseAND(F.lit((1 << low_bits) - 1))), low_bits, "0") if low_bits else F.lit("")
    return F.when(n >= 0, F.concat(F.repeat(F.lit("1"), q.cast("int")), F.lit("0"), low))


def exponential_golomb(n: Column) -> Column:
    return elias_gamma(n + 1)


def decode_elias_gamma(bits: str) -> list[int]:
    out, at = [], 0
    while at < len(bits):
        zeros = bits.index("1", at) - at
        out.append(int(bits[at + zeros : at + 2 * zeros + 1], 2))
        at += 2 * zeros + 1
    return out


def huffman_table(counts: Mapping[str, int]) -> dict[str, str]:
    """Canonical codes, shortest first; one symbol alone has the code 0. Counts are one per symbol of an alphabet."""
    heap = [(n, k, [s]) for k, (s, n) in enumerate(sorted(counts.items())) if n > 0]
    heapq.heapify(heap)
    depth = {s: 0 for _, _, (s,) in heap}
    if len(heap) == 1:
        return {s: "0" for s in depth}
    fresh = len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        heapq.heappush(heap, (n + m, fresh, a + b))
        fresh += 1
    out, code, width = {}, 0, 0
    for s, d in sorted(depth.items(), key=lambda kv: (kv[1], kv[0])):
        code <<= d - width
        out[s], width = format(code, f"0{d}b"), d
        code += 1
    return out


def huffman_encode(text: Column, table: Mapping[str, str]) -> Column:
    """The text's bits; null if it holds a symbol without a code."""
    codes = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    bits = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.try_element_at(codes, c))
    return F.when(F.forall(bits, lambda b: b.isNotNull()), F.array_join(bits, ""))


def huffman_decode(bits: str, table: Mapping[str, str]) -> str:
    back, out, word = {v: k for k, v in table.items()}, [], ""
    for b in bits:
        word += b
        if word in back:
            out.append(back[word])
            word = ""
    if word:
        raise ValueError("bits left over")
    return "".join(out)
