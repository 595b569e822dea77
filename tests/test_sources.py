"""Tagged files with awkward content, mixed formats, and texts between records."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions.latex import de_latex
from citeweave.sources import mixed, tagged

RIS = "﻿TY  - JOUR\r\nAU  - Smith, Jane\r\nAU  - et al.\r\nTI  - A long\r\n title\r\nT2  - Nature\r\nSP  - 5\r\nEP  - 9\r\nPY  - 2019\r\nDA  - 2019/03/15/\r\nSN  - 1234-5678\r\nDO  - 10.1000/x.\r\nER  - \r\nplain text here\n\nTY  - BOOK\nT1  - Book\nA2  - Ed, A\nT2  - Ser\nSP  - 237\nPY  - 2001\nER  - \n"
ENW = "%0 Journal Article\n%A Doe, Jo\n%T Title two\n%J J\n%P 1–9\n%D 2020\n%8 March 5\n\n%0 Book\n%T B\n%B Series\n"
BIB = """@string{jn = "Journal of X"}
@article{k1, author = {M{\\"u}ller, J. and {World Org}}, title = {The {DNA} of \\'{e}t\\'e \\& more}, journal = jn # " B", year = 2020, month = mar, pages = {1--9}, doi={10.1000/a}, doi={10.1000/b}}
@inproceedings{k2, crossref = {P}, title="In it", author={Ada Lovelace}}
@proceedings{p, title={Proc Book}, year=1999, publisher={Pub}}
@misc{k4, title={A {Deep} one}, eprint={2101.00001v2}, archivePrefix={arXiv}, author={Roe, R. and others}}
@misc{k3, title={broken"""


def test_records_of_mixed_files(spark):
    files = spark.createDataFrame([(1, RIS), (2, ENW), (3, BIB), (4, None), (5, ""), (6, "no record at all")], "file_id int, content string")
    got = {(r.file_id, r.title): r for r in tagged.records(files).collect()}
    one, book = got[1, "A long title"], got[1, "Book"]
    assert (one.type, one.container, one.pages, one.year, one.month, one.day, one.doi, one.issn, one.others) == ("journal-article", "Nature", "5-9", "2019", 3, 15, "10.1000/x", "1234-5678", True)
    assert [p.family for p in one.authors] == ["Smith"] and [p.family for p in book.editors] == ["Ed"] and (book.series, book.container, book.num_pages, book.pages) == ("Ser", "", "237", "")
    assert (got[2, "Title two"].pages, got[2, "Title two"].day, got[2, "B"].series) == ("1-9", 5, "Series")
    first, child, eprint = got[3, "The DNA of été & more"], got[3, "In it"], got[3, "A Deep one"]
    assert (first.container, first.month, first.doi) == ("Journal of X B", 3, "10.1000/a") and [(p.family, p.literal) for p in first.authors] == [("Müller", False), ("World Org", True)]
    assert (child.container, child.year, child.publisher) == ("Proc Book", "1999", "Pub") and (eprint.doi, eprint.others) == ("10.48550/arXiv.2101.00001", True)
    assert not any(f > 3 for f, _ in got)
    assert {(r.file_id, r.text) for r in tagged.plain_chunks(files).collect()} == {(1, "plain text here"), (3, "@misc{k3, title={broken"), (6, "no record at all")}
    assert tagged.records(files.limit(0)).count() == 0


def test_latex(spark):
    cases = {r"{\'e}t\'e": "été", r"\o{}re \ss": "øre ß", r"\"{\i}": "ï", "a--b---c ``d''": "a–b—c “d”", r"10\% \& {X}": "10% & X", r"\textit{in} vivo": "in vivo", "plain": "plain", "": "", r"\c{C}a": "Ça", r"$\alpha$ ray": "α ray"}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", de_latex(F.col("t")).alias("y")).collect()
    assert {k: next(r.y for r in rows if r.i == i) for i, k in enumerate(cases)} == cases


PASTE = """intro text
TY  - JOUR
TI  - A
ER  - 
between

more plain
%0 Book
%T B

after enw
@article{k, title={A {nested {very {deep {five}}}} one},
  note = {@not{an entry}}
}
@misc{b, x=1}
tail
TY  - BOOK
TI  - open to the end"""
CHUNKS = [
    ("plain", "intro text"), ("ris", "TY  - JOUR\nTI  - A\nER  -"), ("plain", "between\n\nmore plain"), ("enw", "%0 Book\n%T B"), ("plain", "after enw"),
    ("bibtex", "@article{k, title={A {nested {very {deep {five}}}} one},\n  note = {@not{an entry}}\n}"), ("bibtex", "@misc{b, x=1}"), ("plain", "tail"), ("ris", "TY  - BOOK\nTI  - open to the end"),
]


def test_chunks_of_a_paste_in_order(spark):
    rows = [(1, PASTE), (2, None), (3, ""), (4, "@misc{broken, title={x\n@misc{c, y={1}}\nz"), (5, "\ufeff" + PASTE.replace("\n", "\r\n"))]
    for at_once in (3, None):
        got = {}
        for r in mixed.chunks(mixed.lines_of(spark.createDataFrame(rows, "file_id int, content string"), at_once), at_once is not None).orderBy("file_id", "chunk_no").collect():
            got.setdefault(r.file_id, []).append((r.kind, r.text))
        assert got == {1: CHUNKS, 4: [("bibtex", "@misc{broken, title={x"), ("bibtex", "@misc{c, y={1}}"), ("plain", "z")], 5: CHUNKS}


def test_a_file_in_many_splits_gives_the_rows_of_one(spark, tmp_path):
    (tmp_path / "big.txt").write_text("\n\n".join(f"{PASTE}\nER  - \nfile part {i}" for i in range(200)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = lambda: [tuple(r)[1:] for r in mixed.chunks(mixed.read_lines(spark, f"file:{tmp_path}/big.txt")).orderBy("chunk_no").collect()]
    whole = read()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert mixed.read_lines(spark, f"file:{tmp_path}/big.txt").select("split").distinct().count() > 8
        assert read() == whole and len(whole) == 200 * 9 + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_parents_and_macros_are_not_broadcast(spark):
    content = "@string{p = {Press}}\n@book{a, title={T}, publisher=p}\n@inbook{b, crossref={a}, title={C}}"
    files = spark.range(1).select(F.col("id").alias("file_id"), F.lit(content).alias("content"))
    got = tagged.inherited(tagged.bib_entries(files))
    assert {r.key: (r.fields.get("booktitle"), r.fields["publisher"]) for r in got.collect()} == {"a": (None, "Press"), "b": ("T", "Press")}
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString()
