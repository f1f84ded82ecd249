"""Alignment files: readers and writers of eight formats, each file or record parsed in a task.

Rows: path, aln (place of the alignment in its file), seqidx, name, aseq. An alignment is parsed
whole, as its formats are interleaved; many files are read in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Rows = list[tuple[str, str]]
SCHEMA = "path string, aln int, seqidx int, name string, aseq string"


class FormatError(ValueError):
    pass


def _same_width(rows: Rows) -> Rows:
    if not rows:
        raise FormatError("no sequences")
    widths = {len(s) for _, s in rows}
    if len(widths) > 1:
        raise FormatError(f"rows of different length: {sorted(widths)}")
    return rows


def _gathered(blocks: Sequence[Sequence[tuple[str, str]]]) -> Rows:
    """The rows of blocks that all hold the same names, each once, in the same order."""
    blocks = [b for b in blocks if b]
    if not blocks:
        raise FormatError("no sequences")
    names = [n for n, _ in blocks[0]]
    if len(set(names)) < len(names):
        raise FormatError(f"a name stands twice in one block: {next(n for k, n in enumerate(names) if n in names[:k])}")
    for block in blocks[1:]:
        if [n for n, _ in block] != names:
            raise FormatError("blocks with different names")
    return _same_width([(n, "".join(b[k][1] for b in blocks)) for k, n in enumerate(names)])


def parse_stockholm(text: str) -> Iterator[Rows]:
    blocks: list[list[tuple[str, str]]] | None = None
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("# STOCKHOLM"):
            if blocks is not None:
                raise FormatError("header inside an alignment")
            blocks = [[]]
        elif line == "//":
            if blocks is None:
                raise FormatError("end without a header")
            yield _gathered(blocks)
            blocks = None
        elif not line and blocks and blocks[-1]:
            blocks.append([])
        elif line and not line.startswith("#"):
            fields = line.split()
            if blocks is None or len(fields) != 2:
                raise FormatError(f"bad line: {line[:60]}")
            blocks[-1].append((fields[0], fields[1]))
    if blocks is not None:
        raise FormatError("no end of the alignment")


def stockholm_annotation(text: str) -> list[tuple[int, str, str | None, str, str]]:
    """(alignment, kind GF/GS/GC/GR, sequence, tag, value); parts of GC and GR lines are joined, repeats of GF and GS by a line end."""
    out: dict[tuple[int, str, str | None, str], list[str]] = {}
    n = 0
    for line in text.splitlines():
        n += line.strip() == "//"
        m = re.match(r"#=(G[FSCR])\s+(.*)", line.strip())
        if m:
            sizes = 2 if m[1] in ("GF", "GC") else 3
            f = m[2].split(None, sizes - 1)
            f += [""] * (sizes - len(f))
            key = (n, m[1], None if sizes == 2 else f[0], f[-2])
            out.setdefault(key, []).append(f[-1])
    return [(*k, ("" if k[1] in ("GC", "GR") else "\n").join(v)) for k, v in out.items()]


def _records(text: str) -> Rows:
    parts = re.split(r"(?m)^>", text)
    if parts[0].strip():
        raise FormatError("text before the first record")
    out = []
    for p in parts[1:]:
        head, _, rest = p.partition("\n")
        if not head.split():
            raise FormatError("a record without a name")
        out.append((head.split()[0], "".join(rest.split())))
    return out


def parse_afa(text: str) -> Iterator[Rows]:
    yield _same_width(_records(text))


def parse_a2m(text: str) -> Iterator[Rows]:
    """Lower case and dots are insertions before the next capital or dash; all rows are padded to the widest insertion."""
    rows = [(n, re.findall(r"([a-z.]*)([A-Z*-]|$)", s)) for n, s in _records(text)]
    if not rows or len({len(p) for _, p in rows}) > 1:
        raise FormatError("rows with different numbers of consensus columns")
    wide = [max(len(p[k][0].replace(".", "")) for _, p in rows) for k in range(len(rows[0][1]))]
    yield _same_width([(n, "".join(i.replace(".", "").ljust(w, ".") + c for (i, c), w in zip(p, wide))) for n, p in rows])


def _interleaved(lines: Sequence[str]) -> Rows:
    """Blocks of lines `name residues`, with an optional count at the end, between blank lines."""
    blocks: list[list[tuple[str, str]]] = [[]]
    for line in lines:
        f = line.split()
        if not f:
            blocks.append([])
            continue
        if len(f) == 3 and f[2].isdigit():
            f.pop()
        if len(f) != 2:
            raise FormatError(f"bad line: {line[:60]}")
        blocks[-1].append((f[0], f[1]))
    return _gathered(blocks)


def parse_clustal(text: str) -> Iterator[Rows]:
    lines = text.splitlines()
    heads = [k for k, x in enumerate(lines) if x.strip()]
    if not heads or not (lines[heads[0]].startswith("CLUSTAL") or "multiple sequence alignment" in lines[heads[0]]):
        raise FormatError("no heading line")
    yield _interleaved([x for x in lines[heads[0] + 1 :] if not x.strip() or not x[0].isspace()])


def parse_psiblast(text: str) -> Iterator[Rows]:
    yield _interleaved(text.splitlines())


def parse_selex(text: str) -> Iterator[Rows]:
    """Blocks of `name residues`; spaces inside residues are gaps. Lines #= and % are annotation or comments."""
    blocks = [[x for x in b.splitlines() if x.strip() and x[0] not in "#%"] for b in re.split(r"\n[ \t\r]*\n", text)]
    parts = []
    for block in filter(None, blocks):
        starts = [m.end() for x in block if (m := re.match(r"\S+\s+", x))]
        if len(starts) < len(block):
            raise FormatError("a name without residues")
        left, right = min(starts), max(len(x.rstrip()) for x in block)
        parts.append([(x.split()[0], x.rstrip()[left:].ljust(right - left).replace(" ", ".")) for x in block])
    yield _gathered(parts)


def _phylip_head(lines: list[str]) -> tuple[int, int, list[str]]:
    rows = [x for x in lines if x.strip()]
    f = rows[0].split() if rows else []
    if len(f) < 2 or not (f[0].isdigit() and f[1].isdigit()):
        raise FormatError("no line with two numbers")
    return int(f[0]), int(f[1]), rows[1:]


def parse_phylip(text: str, name_width: int = 10) -> Iterator[Rows]:
    n, width, rows = _phylip_head(text.splitlines())
    if not n or len(rows) % n:
        raise FormatError(f"{len(rows)} lines for {n} sequences")
    names = [x[:name_width].strip() for x in rows[:n]]
    parts = [[x[name_width:]] for x in rows[:n]]
    for k, x in enumerate(rows[n:]):
        parts[k % n].append(x)
    out = _same_width([(a, re.sub(r"\s", "", "".join(p))) for a, p in zip(names, parts)])
    if len(out[0][1]) != width:
        raise FormatError(f"length {len(out[0][1])}, not {width}")
    yield out


def parse_phylips(text: str, name_width: int = 10) -> Iterator[Rows]:
    n, width, rows = _phylip_head(text.splitlines())
    out: Rows = []
    for x in rows:
        if not out or len(out[-1][1]) >= width:
            out.append((x[:name_width].strip(), re.sub(r"\s", "", x[name_width:])))
        else:
            out[-1] = (out[-1][0], out[-1][1] + re.sub(r"\s", "", x))
    if len(out) != n or any(len(s) != width for _, s in out):
        raise FormatError("sizes differ from the heading")
    yield out


PARSERS: dict[str, Callable[[str], Iterator[Rows]]] = {
    "stockholm": parse_stockholm, "pfam": parse_stockholm, "afa": parse_afa, "a2m": parse_a2m, "clustal": parse_clustal,
    "phylip": parse_phylip, "phylips": parse_phylips, "psiblast": parse_psiblast, "selex": parse_selex,
}


def guess(path: str, text: str) -> str:
    """The format, by the first line and then the suffix."""
    first = next((x for x in text.splitlines() if x.strip()), "")
    if first.startswith("# STOCKHOLM"):
        return "stockholm"
    if first.startswith(">"):
        return "a2m" if path.endswith(".a2m") else "afa"
    if first.startswith("CLUSTAL") or "multiple sequence alignment" in first:
        return "clustal"
    if re.fullmatch(r"\s*\d+\s+\d+\s*", first):
        try:
            next(parse_phylip(text))
            return "phylip"
        except FormatError:
            return "phylips"
    return "psiblast" if path.endswith(".pb") else "selex"


def read(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """All alignments of the files at `path`. A malformed file raises FormatError in its task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, content in zip(batch["path"], batch["content"]):
                text = bytes(content).decode("utf-8", "replace").replace("\r\n", "\n")
                for k, rows in enumerate(PARSERS[form or guess(place, text)](text)):
                    yield pd.DataFrame([(place, k, i, n, s) for i, (n, s) in enumerate(rows)], columns=["path", "aln", "seqidx", "name", "aseq"])

    return files.mapInPandas(run, SCHEMA)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """The annotation of Stockholm files, one row per mark: path, aln, kind (GF of the alignment, GS of a sequence, GC by column, GR by residue), name (of the sequence, else null), tag, value."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, content in zip(batch["path"], batch["content"]):
                notes = stockholm_annotation(bytes(content).decode("utf-8", "replace").replace("\r\n", "\n"))
                yield pd.DataFrame([(place, *n) for n in notes], columns=["path", "aln", "kind", "name", "tag", "value"])

    return files.mapInPandas(run, "path string, aln int, kind string, name string, tag string, value string")


def column_counts(spark: SparkSession, path: str) -> DataFrame:
    """path, col, res, n of files that hold one alignment with one line a row: in one pass over the lines, so a file of any size is split among tasks and no alignment is ever held."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("_l")).where("_l <> '' AND _l NOT LIKE '#%' AND _l <> '//'")
    long = lines.select("path", F.posexplode(F.split(F.regexp_extract("_l", r"^\S+\s+(\S+)$", 1), "")).alias("_at", "res")).where("res <> ''")
    return long.groupBy("path", (F.col("_at") + 1).alias("col"), "res").agg(F.count("*").alias("n"))


def residue_annotations(notes: DataFrame) -> DataFrame:
    """GC and GR marks in long form: path, aln, name (null for GC), tag, col, mark."""
    long = notes.where("kind IN ('GC', 'GR')").select("path", "aln", "name", "tag", F.posexplode(F.split("value", "")).alias("col", "mark"))
    return long.where("mark <> ''").withColumn("col", F.col("col") + 1)


def _blocks(rows: Rows, width: int) -> Iterator[list[tuple[str, str]]]:
    for at in range(0, max(1, len(rows[0][1])), width):
        yield [(n, s[at : at + width]) for n, s in rows]


def render(rows: Rows, form: str, width: int = 60) -> str:
    """The alignment as text in the named format."""
    pad = max(len(n) for n, _ in rows) + 1
    line = lambda n, s: n.ljust(pad) + s
    if form in ("phylip", "phylips") and len({n[:10] for n, _ in rows}) < len(rows):
        raise FormatError("names that are equal in their first ten characters")
    if form in ("stockholm", "pfam"):
        blocks = [rows] if form == "pfam" else _blocks(rows, width)
        return "# STOCKHOLM 1.0\n\n" + "\n\n".join("\n".join(line(*r) for r in b) for b in blocks) + "\n//\n"
    if form in ("afa", "a2m"):
        if form == "a2m":
            consensus = [sum(s[k].isalpha() for _, s in rows) * 2 >= len(rows) for k in range(len(rows[0][1]))]
            rows = [(n, "".join(c.upper() if keep and c.isalpha() else "-" if keep else c.lower() if c.isalpha() else "" for c, keep in zip(s, consensus))) for n, s in rows]
        return "".join(f">{n}\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)) for n, s in rows)
    if form == "clustal":
        marks = lambda b: "".join("*" if len(set(c)) == 1 and "A" <= c[0] <= "Z" else " " for c in zip(*(s.upper() for _, s in b)))
        return "CLUSTAL W (1.83) multiple sequence alignment\n\n\n" + "\n\n".join("\n".join([*(line(*r) for r in b), line("", marks(b))]) for b in _blocks(rows, width)) + "\n"
    if form in ("psiblast", "selex"):
        return "\n\n".join("\n".join(line(*r) for r in b) for b in _blocks(rows, width)) + "\n"
    if form == "phylip":
        first = True
        out = [f" {len(rows)} {len(rows[0][1])}"]
        for b in _blocks(rows, width):
            out += [n[:10].ljust(10) + s if first else s for n, s in b] + [""]
            first = False
        return "\n".join(out) + "\n"
    if form == "phylips":
        return f" {len(rows)} {len(rows[0][1])}\n" + "".join(n[:10].ljust(10) + s + "\n" for n, s in rows)
    raise ValueError(f"unknown format {form}")


def to_text(rows: DataFrame, form: str, *, aln: str = "aln", key: str = "seqidx", name: str = "name", aseq: str = "aseq") -> DataFrame:
    """(aln, value): each alignment rendered by the task that holds it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        return pd.DataFrame({"aln": [pdf["_a"].iloc[0]], "value": [render(list(zip(pdf["_n"], pdf["_s"])), form)]})

    part = rows.selectExpr(f"`{aln}` AS _a", f"`{key}` AS _k", f"cast(`{name}` AS string) AS _n", f"`{aseq}` AS _s")
    return part.groupBy("_a").applyInPandas(run, f"aln {part.schema['_a'].dataType.simpleString()}, value string")


def render_annotated(rows: Rows, notes: Sequence[tuple[str, str | None, str, str]]) -> str:
    """Stockholm text, one line per row, with notes (kind GF/GS/GC/GR, name, tag, value): GF and GS before the rows, GR below its row, GC last."""
    pad = max([len(n) for n, _ in rows] + [len(f"#=GR {n or ''} {t}") for k, n, t, _ in notes if k in ("GC", "GR")]) + 1
    out = ["# STOCKHOLM 1.0", ""]
    for want in ("GF", "GS"):
        out += [" ".join(filter(None, (f"#={k}", n, t, part))) for k, n, t, v in notes if k == want for part in v.split("\n")]
    out.append("")
    of: dict[str | None, list[str]] = {}
    for k, n, t, v in notes:
        if k == "GR":
            of.setdefault(n, []).append(f"#=GR {n} {t}".ljust(pad) + v)
    for name, s in rows:
        out.append(name.ljust(pad) + s)
        out += of.get(name, [])
    out += [f"#=GC {t}".ljust(pad) + v for k, _, t, v in notes if k == "GC"]
    return "\n".join(out) + "\n//\n"


def to_annotated(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """(aln, value) of rows (aln, seqidx, name, aseq) and notes (aln, kind, name, tag, value): a text is one alignment, so one task holds it. Alignments without rows give no text."""

    def run(r: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        if r.empty:
            return pd.DataFrame({"aln": r["aln"], "value": r["aseq"]})
        r, n = r.sort_values("seqidx"), n.sort_values(["kind", "tag"], kind="stable")
        marks = [(k, None if pd.isna(m) else m, t, v) for k, m, t, v in zip(n["kind"], n["name"], n["tag"], n["value"])]
        return pd.DataFrame({"aln": [r["aln"].iloc[0]], "value": [render_annotated(list(zip(r["name"], r["aseq"])), marks)]})

    return rows.groupBy("aln").cogroup(notes.groupBy("aln")).applyInPandas(run, f"aln {dict(rows.dtypes)['aln']}, value string")
