"""Files of unknown encoding as text, told apart by their first bytes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import let
from citeweave.functions.text import CP1252, CP1252_CODES

#: What a document may unpack to, and how many parts it may have.
UNPACKED, PARTS = 64 << 20, 10_000
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode_bytes(content: Column) -> Column:
    """Text of bytes: by their mark, as UTF-16 where more than a quarter of one half of the first bytes is zero, as UTF-8, else Windows-1252."""
    head = F.hex(F.substring(content, 1, 3))
    sample = F.hex(F.substring(content, 1, 4096))

    def zeros(s: Column) -> Column:
        pairs = F.regexp_extract_all(s, F.lit("[0-9A-F]{2}"), F.lit(0))
        odd = F.size(F.filter(pairs, lambda p, i: (p == "00") & (i % 2 == 1)))
        even = F.size(F.filter(pairs, lambda p, i: (p == "00") & (i % 2 == 0)))
        return F.struct((odd * 4 > F.size(pairs)).alias("little"), (even * 4 > F.size(pairs)).alias("big"))

    latin = F.translate(F.decode(content, "ISO-8859-1"), CP1252_CODES, CP1252)
    plain = content.cast("string")
    by_form = let(zeros(sample), lambda z: F.when(z["little"], F.decode(content, "UTF-16LE")).when(z["big"], F.decode(content, "UTF-16BE")).when(F.is_valid_utf8(plain), plain).otherwise(latin))
    return (
        F.when(head.startswith("EFBBBF"), F.substring(content, 4, 1 << 30).cast("string")).when(head.startswith("FFFE"), F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(F.substring(content, 3, 1 << 30), "UTF-16BE")).otherwise(by_form)
    )


def kind_of(content: Column, name: Column) -> Column:
    """Kind of a file by its first bytes, then its ending."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "pdf").when((head == "504B0304") & F.lower(name).endswith(".docx"), "docx").when(head == "504B0304", "zip").otherwise(F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))


def paragraphs(data: bytes) -> Iterator[tuple[str, str, bool]]:
    """(text, style, in a table) of a Word file's paragraphs; deleted and hidden runs are left out, tabs are blanks."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        infos = archive.infolist()
        if len(infos) > PARTS or archive.getinfo("word/document.xml").file_size > UNPACKED:
            raise ValueError("too large")
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    tables = {id(p) for t in root.iter(f"{WORD}tbl") for p in t.iter(f"{WORD}p")}
    for p in root.iter(f"{WORD}p"):
        gone = {id(x) for tag in ("del", "moveFrom") for d in p.iter(f"{WORD}{tag}") for x in d.iter()}
        text = []
        for run in p.iter(f"{WORD}r"):
            if id(run) in gone or run.find(f"{WORD}rPr/{WORD}vanish") is not None:
                continue
            text += [{f"{WORD}t": n.text or "", f"{WORD}tab": " ", f"{WORD}br": "\n", f"{WORD}noBreakHyphen": "-"}.get(n.tag, "") for n in run]
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        yield re.sub("[ \t]+", " ", "".join(text)).strip(), "" if style is None else style.get(f"{WORD}val", ""), id(p) in tables


def read_docx(files: DataFrame) -> DataFrame:
    """(path, para_no, text, style, in_table, error): paragraphs of Word files in order; a file that can't be read is a row with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, n, *p, None) for n, p in enumerate(paragraphs(content or b""))]
                except (ValueError, KeyError, OSError, zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, RuntimeError, EOFError) as e:
                    rows.append((path, -1, None, None, None, str(e) or type(e).__name__))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "para_no", "text", "style", "in_table", "error"])

    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, "path string, para_no int, text string, style string, in_table boolean, error string")


#: Headings of a list of references, of what follows one, and captions, in several languages (fixed values).
HEADINGS = (
    r"(?i)^(?:[0-9]+\.?\s+)?(?:references?|references cited|literature cited|works cited|bibliography|literatur(?:verzeichnis)?|bibliographie|références|referencias|bibliografía|bibliografia|referências|riferimenti"
    r"|литература|список литературы|参考文献|引用文献|참고문헌)\s*[:.]?$"
)
AFTER = r"(?i)^(?:[0-9]+\.?\s+)?(?:appendix|appendices|supplementary|acknowledg(?:e)?ments?|figure captions|tables?|author contributions|conflicts? of interest|funding|data availability)\b"
CAPTION = r"(?i)^(?:fig(?:ure)?\.?|table|plate)\s*[0-9]+[.:]"


def reference_section(paras: DataFrame) -> DataFrame:
    """(path, para_no, text) of each file's list: behind its last heading that a reference follows, up to the next section.

    A file without such a heading gives the paragraphs that look like references.
    """
    from citeweave.functions.segment import YEAR_IN, opens

    spaced = F.regexp_replace("text", r"^(?:\p{L} )+\p{L}$", "")
    title = F.when(spaced == "", F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.col("text"))
    told = paras.filter("text <> ''").withColumns({"heading": title.rlike(HEADINGS), "like": opens(F.col("text")) & F.col("text").rlike(YEAR_IN), "after": title.rlike(AFTER), "caption": F.col("text").rlike(CAPTION)})
    from pyspark.sql.window import Window

    followed = told.withColumn("followed", F.lead("like").over(Window.partitionBy("path").orderBy("para_no")))
    start = followed.groupBy("path").agg(F.max(F.when(F.col("heading") & F.col("followed"), F.col("para_no"))).alias("start"))
    placed = told.join(start, "path")
    stop = placed.filter("start is not null and para_no > start and after").groupBy("path").agg(F.min("para_no").alias("stop"))
    inside = placed.join(stop, "path", "left").filter((F.col("start").isNull() & F.col("like")) | ((F.col("para_no") > F.col("start")) & (F.col("stop").isNull() | (F.col("para_no") < F.col("stop"))) & ~F.col("caption")))
    return inside.select("path", "para_no", "text")
