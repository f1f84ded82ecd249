import pytest
from pyspark.sql import functions as F

from strandframe.sources import alignments, datasource, packed, reports, sequences, tables

ROWS = [("one", "AC-GTacgA"), ("two", "ACCGT---A"), ("three", "----TACGA")]


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "first one", "ACGT" * 40), ("b", "", "GG"), ("c", "none", "")], "name string, d string, s string")
    sequences.save(sequences.to_fasta(df, name=F.col("name"), seq=F.col("s"), description=F.col("d")), str(tmp_path / "x"))
    got = {(r.name, r.description, r.seq) for r in sequences.read(spark, str(tmp_path / "x")).collect()}
    assert got == {("a", "first one", "ACGT" * 40), ("b", "", "GG"), ("c", "none", "")}


def test_flat_files(spark, tmp_path):
    (tmp_path / "e").write_text("ID   X1; SV 1\nAC   P1; P2;\nDE   two\nDE   lines\nSQ   Sequence 8 BP;\n     acgt acgt   8\n//\nID   X2\nSQ   x\n     gg  2\n//\n")
    got = [(r.name, r.accession, r.description, r.seq) for r in sequences.read(spark, str(tmp_path / "e")).collect()]
    assert got == [("X1", "P1", "two lines", "acgtacgt"), ("X2", "", "", "gg")]
    (tmp_path / "g").write_text("LOCUS       L1 8 bp\nDEFINITION  a long\n            name.\nACCESSION   A1\nORIGIN\n        1 acgtac gt\n//\n")
    got = [(r.name, r.accession, r.description, r.seq) for r in sequences.read(spark, str(tmp_path / "g")).collect()]
    assert got == [("L1", "A1", "a long name.", "acgtacgt")]


@pytest.mark.parametrize("form", ["stockholm", "pfam", "afa", "clustal", "phylip", "phylips", "psiblast", "selex"])
def test_alignment_round_trips(form):
    rows = [(n, s * 20) for n, s in ROWS]
    text = alignments.render(rows, form)
    assert list(alignments.PARSERS[form](text)) == [rows]


def test_a2m_pads_insertions():
    assert list(alignments.parse_a2m(">a\nACgT\n>b\nA-T\n")) == [[("a", "ACgT"), ("b", "A-.T")]]


@pytest.mark.parametrize("form, text", [("stockholm", "# STOCKHOLM 1.0\na AC\n"), ("afa", ">a\nAC\n>b\nA\n"), ("clustal", "a AC\n"), ("phylip", "2 3\na         ACG\n"), ("phylips", "1 4\na         ACG\n"), ("stockholm", "//\n")])
def test_malformed_alignments_are_errors(form, text):
    with pytest.raises(alignments.FormatError):
        list(alignments.PARSERS[form](text))


def test_annotation():
    text = "# STOCKHOLM 1.0\n#=GF ID x\n#=GS a AC P1\na AC\n#=GR a SS <\n#=GC RF xx\na GT\n#=GR a SS >\n#=GC RF x.\n//\n"
    assert alignments.stockholm_annotation(text) == [(0, "GF", None, "ID", "x"), (0, "GS", "a", "AC", "P1"), (0, "GR", "a", "SS", "<>"), (0, "GC", None, "RF", "xxx.")]


def test_alignment_files(spark, tmp_path):
    df = spark.createDataFrame([(1, i, n, s) for i, (n, s) in enumerate(ROWS)], "aln int, seqidx int, name string, aseq string")
    text = alignments.to_text(df, "stockholm").first().value
    (tmp_path / "x.sto").write_text(text * 2)
    got = alignments.read(spark, str(tmp_path)).collect()
    assert sorted((r.aln, r.seqidx, r.name, r.aseq) for r in got) == [(k, i, n, s) for k in (0, 1) for i, (n, s) in enumerate(ROWS)]


def test_text_tables(spark, tmp_path):
    cells = [(a, b, float(a == b)) for a in "ACGT" for b in "ACGT"]
    (tmp_path / "m").write_text("# note\n" + tables.format_score_matrix(cells))
    assert [tuple(r) for r in tables.read_score_matrix(spark, str(tmp_path / "m")).collect()] == cells
    assert tables.rate_matrix("1 2 3\n.5 .3 .2", 3) == ([(1, 0, 1.0), (0, 1, 1.0), (2, 0, 2.0), (0, 2, 2.0), (2, 1, 3.0), (1, 2, 3.0)], [0.5, 0.3, 0.2])
    assert tables.mask_columns("# x\n10\n1\n") == [(1, True), (2, False), (3, True)]
    assert tables.mixture("2 1 # sizes\n1.0 0.5 0.25\n") == [(1.0, [0.5, 0.25])]
    (tmp_path / "h").write_text("q t 90.0 10 1 0 1 10 30 21 1e-5 50\n# c\n")
    hits = tables.tabular_hits(spark, str(tmp_path / "h"))
    assert reports.to_lines(hits, "gff", source="s", feature="hit").first()[0] == 't\ts\thit\t30\t21\t50.0\t+\t.\tgene "q"'
    with pytest.raises(ValueError):
        tables.rate_matrix("1 2E-1 x\n.5 .3 .2", 3)
    assert tables.rate_matrix("1 2E-1 3\n.5 .3 .2 a remark", 3)[0][2] == (2, 0, 0.2)


def test_packed_store_and_key_index(spark, tmp_path):
    rows = [("a", "ACGTACG", "X1"), ("b", "", "X2"), ("c", "ACGNT", "X3")]
    df = spark.createDataFrame(rows, "name string, seq string, acc string")
    packed.write(df, str(tmp_path / "p"), key="name", seq="seq", names=["name", "acc"], partitions=2)
    assert sorted(tuple(r) for r in packed.read(spark, str(tmp_path / "p")).select("name", "seq", "acc").collect()) == rows
    keys = spark.createDataFrame([("X3",), ("a",), ("zz",)], "key string")
    assert sorted((r.key, r.n_found, r.seq) for r in packed.fetch(spark, str(tmp_path / "p"), keys).collect()) == [("X3", 1, "ACGNT"), ("a", 1, "ACGTACG"), ("zz", 0, None)]


def test_blocks_must_agree(spark):
    head, end = "# STOCKHOLM 1.0\n", "//\n"
    read = lambda body: list(alignments.parse_stockholm(head + body + end))
    assert read("a AC\nb GT\n\na A\nb G\n") == [[("a", "ACA"), ("b", "GTG")]]
    for bad in ("a AC\na GT\nb ACGT\n", "a AC\nb GT\n\nb AC\na GT\n", "a AC\nb GT\n\na AC\n"):
        with pytest.raises(alignments.FormatError):
            read(bad)
    with pytest.raises(alignments.FormatError):
        alignments.render([("abcdefghijk", "A"), ("abcdefghijl", "C")], "phylip")


def test_files_as_formats(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "a").mkdir()
    for k in range(3):
        (tmp_path / "a" / f"{k}.sto").write_text(alignments.render(ROWS, "stockholm") * 2)
    got = spark.read.format("alignment").load(str(tmp_path / "a")).collect()
    assert sorted((r.aln, r.seqidx, r.name, r.aseq) for r in got) == sorted([(k, i, n, s) for k in (0, 1) for i, (n, s) in enumerate(ROWS)] * 3)
    (tmp_path / "f.fa").write_text(">x one two\nAC\nGT\n>y\n\n")
    assert sorted(map(tuple, spark.read.format("fasta").load(str(tmp_path / "f.fa")).collect())) == [("x", "one two", "ACGT"), ("y", "", "")]
    assert spark.read.format("alignment").option("form", "afa").load(str(tmp_path / "f.fa")) is not None


def test_records_of_daemons(spark, tmp_path):
    (tmp_path / "d").write_text(">one first thing\nACG\nTT\n// end\n>two\nGG\n//\n>none\n//\n")
    rows = sequences.read(spark, str(tmp_path / "d"), "daemon").collect()
    assert {(r.name, r.description, r.seq) for r in rows} == {("one", "first thing", "ACGTT"), ("two", "", "GG"), ("none", "", "")}
    (tmp_path / "h").write_text("# 7 1 2 2 2 2 Thu Nov 26\n>1 101\nACGTT\n>#2 111\nGG\n")
    assert {(r.name, r.seq) for r in sequences.read(spark, str(tmp_path / "h")).collect()} == {("1", "ACGTT"), ("#2", "GG")}


def test_marks_below_clustal_blocks():
    text = alignments.render([("a", "ACg-TTN"), ("bb", "ATG-tAN")], "clustal", 4)
    assert text.splitlines()[3:] == ["a  ACg-", "bb ATG-", "   * * ", "", "a  TTN", "bb tAN", "   * *"]
    assert list(alignments.parse_clustal(text)) == [[("a", "ACg-TTN"), ("bb", "ATG-tAN")]]
