"""The record of a work: its columns, and rows set right so that every column can be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.bibliographic import kind, same_pages, valid_edition
from citeweave.functions.names import PERSON, initials

TEXTS = (
    "type", "doi", "url", "title", "subtitle", "container", "series", "number", "short_container", "institution", "edition", "num_pages", "genre", "year", "volume", "issue", "pages",
    "publisher", "place", "issn", "isbn", "abstract", "language", "database", "accession", "original_title",
)
ACCESSED = "struct<year:int,month:int,day:int>"


def harden(df: DataFrame) -> DataFrame:
    """``df`` with every column of a record, of its type, and no nulls in it.

    Missing texts are '', people an empty list (nameless ones dropped), month and day 0 if
    impossible, the year its four digits. A person's initials are made once, as ``ini``. Other columns (an id) stay as they are.
    """

    def text(name: str) -> Column:
        return F.trim(F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("")), r"\s+", " ")) if name in df.columns else F.lit("")

    def people(name: str) -> Column:
        return F.transform(plain_people(name), lambda p: p.withField("ini", initials(p["given"])))

    def plain_people(name: str) -> Column:
        if name not in df.columns:
            return F.array().cast(f"array<{PERSON}>")
        held = [f.name for f in df.schema[name].dataType.elementType.fields]
        part = lambda p, k: F.coalesce(p[k], F.lit("")) if k in held else F.lit("")
        literal = lambda p: F.coalesce(p["literal"], F.lit(False)) if "literal" in held else F.lit(False)
        whole = F.transform(F.col(name), lambda p: F.struct(part(p, "family").alias("family"), part(p, "given").alias("given"), part(p, "suffix").alias("suffix"), literal(p).alias("literal")))
        return F.coalesce(F.filter(whole, lambda p: p["family"] != ""), F.array().cast(f"array<{PERSON}>"))

    def number(name: str, most: int) -> Column:
        value = F.coalesce(F.col(name).cast("int"), F.lit(0)) if name in df.columns else F.lit(0)
        return F.when(value.between(1, most), value).otherwise(0)

    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)
    own = {name: text(name) for name in TEXTS if name not in ("year", "pages", "edition")}
    own |= {"authors": people("authors"), "editors": people("editors"), "others": flag("others"), "article": flag("article"), "month": number("month", 12), "day": number("day", 31)}
    own["year"] = F.when(text("year").rlike("^[0-9]{4}[a-z]?$"), text("year")).otherwise(F.regexp_extract(text("year"), "[0-9]{4}", 0))
    own["pages"], own["edition"] = same_pages(text("pages")), valid_edition(text("edition"))
    own["accessed"] = F.col("accessed").cast(ACCESSED) if "accessed" in df.columns else F.lit(None).cast(ACCESSED)
    out = df.withColumns(own).withColumn("day", F.when(F.col("month") > 0, F.col("day")).otherwise(0))
    return out.withColumn("kind", kind(F.col("type"), F.col("container"), F.col("volume")))
