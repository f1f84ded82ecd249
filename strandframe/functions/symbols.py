"""Symbol-level column functions: alphabets, alignment rows, translation and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The letters spread over four nucleotides in turn; used to give codon and strand operators an input.
TO_DNA = "".join("ACGT"[i % 4] for i in range(26))
DNA_COMPLEMENT = ("ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn")
GAP = "-"


def residues_only(text: Column) -> Column:
    """ASCII letters in upper case; everything else is dropped. Accented letters are dropped, not folded."""
    return F.regexp_replace(F.translate(text, LOWER, UPPER), "[^A-Z]", "")


def aligned(text: Column, width: int) -> Column:
    """One alignment row: letters in upper case, gaps for all else, padded with gaps to `width`."""
    return F.rpad(F.regexp_replace(F.translate(text, LOWER, UPPER), "[^A-Z]", GAP), width, GAP)


def as_dna(text: Column) -> Column:
    """Letters mapped onto ACGT, the rest dropped."""
    return F.translate(residues_only(text), UPPER, TO_DNA)


def reverse_complement(seq: Column) -> Column:
    """Degenerate nucleotide codes included; U counts as T."""
    return F.reverse(F.translate(seq, *DNA_COMPLEMENT))


#: What each named conversion replaces, and by what; both cases, degenerate codes of nucleotides to N.
CONVERSIONS = {
    "dna": ("Uu", "Tt"),
    "rna": ("Tt", "Uu"),
    "lower": (UPPER, LOWER),
    "upper": (LOWER, UPPER),
    "no_degenerate": ("RYMKSWHBVDrymkswhbvd", "N" * 10 + "n" * 10),
    "no_x": ("Xx", "Nn"),
}


def converted(seq: Column, *names: str, gap: str | None = None, replace: tuple[str, str] | None = None) -> Column:
    """The named conversions in turn; `gap` first replaces all gap symbols, `replace` is (from, to), where a single `to` stands for all."""
    pairs = [replace] if replace else []
    pairs += [("-_.", gap)] if gap else []
    for old, new in pairs + [CONVERSIONS[n] for n in names]:
        if len(new) not in (1, len(old)):
            raise ValueError("as many new symbols as old ones are needed, or one")
        seq = F.translate(seq, old, new * len(old) if len(new) == 1 else new)
    return seq


def reversed_structure(marks: Column) -> Column:
    """The brackets of the other strand: reversed, with openings and closings exchanged, letters too."""
    swap = F.translate(marks, "<>()[]{}" + UPPER + LOWER, "><)(][}{" + LOWER + UPPER)
    return F.reverse(swap)


def mask_range(seq: Column, start: int, end: int, symbol: str = "X", *, invert: bool = False) -> Column:
    """Letters at 1-based places start..end become `symbol`; with `invert` those outside."""
    inside = F.substring(seq, start, end - start + 1)
    before, after = F.substring(seq, 1, start - 1), F.substring(seq, F.lit(end + 1), F.length(seq))
    hide = lambda c: F.regexp_replace(c, "[A-Za-z]", symbol)
    return F.concat(hide(before), inside, hide(after)) if invert else F.concat(before, hide(inside), after)


def jenkins_checksum(text: Column) -> Column:
    """32-bit one-at-a-time hash of the characters' codes, as a long."""
    m = F.lit(0xFFFFFFFF)
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))

    def step(h: Column, c: Column) -> Column:
        a = (h + c).bitwiseAND(m)
        b = (a + F.shiftleft(a, 10)).bitwiseAND(m)
        return b.bitwiseXOR(F.shiftright(b, 6))

    def end(h: Column) -> Column:
        a = (h + F.shiftleft(h, 3)).bitwiseAND(m)
        b = a.bitwiseXOR(F.shiftright(a, 11))
        return (b + F.shiftleft(b, 15)).bitwiseAND(m)

    return F.when(F.length(text) > 0, F.aggregate(codes, F.lit(0).cast("long"), step, end)).otherwise(F.lit(0).cast("long"))


def digitised(seq: Column, alphabet: str = UPPER) -> Column:
    """0-based codes of the symbols as an array; -1 for symbols outside the alphabet."""
    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)


def textised(codes: Column, alphabet: str = UPPER) -> Column:
    return F.array_join(F.transform(codes, lambda k: F.substring(F.lit(alphabet), k + 1, 1)), "")


#: Fixed value: a range's first place, anything but digits, and its last place, which may be missing.
RANGE_PATTERN = r"^(\d+)\D+(\d*)$"


def coordinates(text: Column) -> Column:
    """struct(first, last) of a range such as 10..23 or 39-91; last is 0 where it is missing. Other text, and numbers beyond a long, give null."""
    first, last = F.regexp_extract(text, RANGE_PATTERN, 1), F.regexp_extract(text, RANGE_PATTERN, 2)
    first, last = first.try_cast("long"), F.when(last == "", 0).otherwise(last.try_cast("long"))
    return F.when(text.rlike(RANGE_PATTERN) & first.isNotNull() & last.isNotNull(), F.struct(first.alias("first"), last.alias("last")))
