"""Case of titles, files of unknown encoding, Word files."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from citeweave.functions import casing as c
from citeweave.sources import files


def every(spark, expr, cases):
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, x string").select("n", expr(F.col("x")).alias("y")).collect()
    assert {k: next(r.y for r in rows if r.n == n) for n, k in enumerate(cases)} == cases


def test_case(spark):
    every(spark, c.case_of, {"THE ORIGIN OF SPECIES": "upper", "The Origin of Great Species": "title", "The origin of great species": "sentence", "The Origin of great Species there": "mixed", "": None, "12": None, "DNA": "sentence"})
    every(spark, c.to_title_case, {"the role of dna in ferns": "The Role of Dna in Ferns", "a study: the DNA of x": "A Study: The DNA of X", "growth in vitro of well-known cells": "Growth in vitro of Well-Known Cells", "": ""})
    words, names = F.array(*map(F.lit, "role fern growth great origin species study well known".split())), F.array(F.lit("rose"))
    every(spark, lambda x: c.to_sentence_case(x, words, names), {
        "The Role of DNA in Great Ferns": "The role of DNA in great ferns", "Origin of Darwin Species: A Study": "Origin of Darwin species: A study", "The Rose of Great Growth": "The Rose of great growth", "Already in sentence form here": "Already in sentence form here",
        "Well-Known Origin of Species": "Well-Known origin of species",
    })


def test_bytes(spark):
    text = "Déjà vu — “naïve” €"
    cases = [text.encode(), b"\xef\xbb\xbf" + text.encode(), text.encode("utf-16"), text.encode("utf-16-le"), text.encode("utf-16-be"), text.encode("cp1252"), b""]
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, b binary").select("n", files.decode_bytes(F.col("b")).alias("t")).collect()
    assert [next(r.t for r in rows if r.n == n) for n in range(7)] == [text] * 6 + [""]
    kinds = spark.createDataFrame([(b"%PDF-1.4", "x"), (b"PK\x03\x04", "a.DOCX"), (b"TY", "a.RIS"), (b"", "a")], "b binary, n string").select(files.kind_of(F.col("b"), F.col("n"))).collect()
    assert [k[0] for k in kinds] == ["pdf", "docx", "ris", ""]


def docx(*paragraphs):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr>{r}</w:p>' for s, r in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


def test_word_files(spark):
    run = lambda t, more="": f"<w:r>{more}<w:t>{t}</w:t></w:r>"
    good = docx(("Normal", run("Intro")), ("Heading1", run("R e f e r e n c e s")), ("", run("Smith, J. (2020). One.") + run("gone", "<w:rPr><w:vanish/></w:rPr>")), ("", run("Jones, A.") + "<w:r><w:tab/></w:r>" + run("(2019). Two.")), ("", run("Appendix A")), ("", run("Doe, B. (2018). Not it.")))
    table = spark.createDataFrame([("a", good), ("b", b"no zip"), ("c", None)], "path string, content binary")
    paras = files.read_docx(table)
    got = paras.collect()
    assert {r.path for r in got if r.error} == {"b", "c"} and [r.text for r in got if r.path == "a"][2] == "Smith, J. (2020). One."
    assert [r.text for r in files.reference_section(paras.filter("error is null")).orderBy("para_no").collect()] == ["Smith, J. (2020). One.", "Jones, A. (2019). Two."]
    assert files.read_docx(table.limit(0)).count() == 0
