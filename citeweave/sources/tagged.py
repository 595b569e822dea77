"""RIS, EndNote and BibTeX files as tables: a row a record, read by expressions and grouping.

Lines are numbered within a file; a running count of record starts names each line's
record, so a file of many records is no row of its own. A BibTeX file is cut where a line
opens an entry. Texts outside records are rows of kind ``plain``. A null or blank file
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeweave.functions import let
from citeweave.functions.bibliographic import hyphen, joined, tagged_date
from citeweave.functions.identifiers import doi_of, id_numbers
from citeweave.functions.latex import de_latex
from citeweave.functions.names import OTHERS, bib_names, tagged_name

RIS_START, ENW_START = r"^\s*TY\s{1,2}-", r"^\s*%0(?:\s|$)"
RIS_TAG, ENW_TAG = r"^\s*([A-Z][A-Z0-9])\s{1,2}-\s?(.*)$", r"^\s*%(\S)\s?(.*)$"
#: Record types of tagged files (fixed values).
RIS_TYPES = {
    "JOUR": "journal-article", "EJOUR": "journal-article", "MGZN": "journal-article", "NEWS": "journal-article", "CHAP": "book-chapter", "ECHAP": "book-chapter", "BOOK": "book", "EBOOK": "book", "EDBOOK": "book",
    "CONF": "proceedings-article", "CPAPER": "proceedings-article", "UNPB": "posted-content", "DATA": "dataset", "COMP": "software", "THES": "dissertation", "RPRT": "report",
}
ENW_TYPES = {
    "journal article": "journal-article", "electronic article": "journal-article", "magazine article": "journal-article", "newspaper article": "journal-article", "book section": "book-chapter", "book": "book",
    "edited book": "book", "electronic book": "book", "conference paper": "proceedings-article", "conference proceedings": "proceedings-article", "unpublished work": "posted-content", "manuscript": "posted-content",
    "preprint": "posted-content", "dataset": "dataset", "computer program": "software", "thesis": "dissertation", "report": "report",
}
BIB_TYPES = {
    "article": "journal-article", "incollection": "book-chapter", "inbook": "book-chapter", "book": "book", "inproceedings": "proceedings-article", "conference": "proceedings-article", "phdthesis": "dissertation",
    "mastersthesis": "dissertation", "thesis": "dissertation", "techreport": "report", "report": "report", "dataset": "dataset", "software": "software", "online": "webpage", "unpublished": "posted-content",
}
#: Fields that an entry takes from its parent (fixed values).
INHERITED = ("title", "booktitle", "editor", "publisher", "year", "address", "series", "volume", "isbn", "edition", "month")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def tagged_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no, record_no, format, tag, value): tag lines of RIS and EndNote records; others have no tag.

    A record ends with its ``ER`` line; a line without a tag behind one goes on with the value before.
    """
    text = F.regexp_replace(F.replace(F.coalesce("content", F.lit("")), F.lit("\ufeff"), F.lit("")), r"\r\n?", "\n")
    lines = files.select("file_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    starts = F.when(F.col("line").rlike(RIS_START), "ris").when(F.col("line").rlike(ENW_START), "enw").when(F.col("line").rlike(r"^\s*@[A-Za-z][\w-]*\s*[{(]"), "bibtex")
    ends = F.col("line").rlike(r"^\s*ER\s{1,2}-\s*$")
    order = Window.partitionBy("file_id").orderBy("line_no")
    marked = lines.withColumns({"starts": starts, "ends": ends})
    placed = marked.withColumn("record_no", F.count("starts").over(order)).withColumn("format", F.last_value("starts", True).over(order))
    closed = placed.withColumn("closed", F.coalesce(F.sum(F.col("ends").cast("int")).over(Window.partitionBy("file_id", "record_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = closed.filter((F.col("format").isin("ris", "enw")) & (F.col("closed") == 0))
    tag = F.when(F.col("format") == "ris", F.regexp_extract("line", RIS_TAG, 1)).otherwise(F.regexp_extract("line", ENW_TAG, 1))
    value = F.when(F.col("format") == "ris", F.regexp_extract("line", RIS_TAG, 2)).otherwise(F.regexp_extract("line", ENW_TAG, 2))
    tagged = inside.withColumns({"tag": F.nullif(tag, F.lit("")), "value": F.when(tag != "", value).otherwise(F.trim("line"))})
    own = Window.partitionBy("file_id", "record_no").orderBy("line_no")
    fields = tagged.filter("tag is not null or value <> ''").withColumn("field_no", F.count("tag").over(own)).filter("field_no > 0")
    whole = fields.groupBy("file_id", "record_no", "format", "field_no").agg(F.first("tag", True).alias("tag"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), " ").alias("value"))
    return whole.withColumn("value", F.trim("value"))


def tag_maps(files: DataFrame) -> DataFrame:
    """(file_id, record_no, format, tags): the values of each tag in order."""
    fields = tagged_lines(files).groupBy("file_id", "record_no", "format", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("field_no", "value"))), lambda x: x["value"]).alias("held"))
    return fields.groupBy("file_id", "record_no", "format").agg(F.map_from_entries(F.collect_list(F.struct("tag", "held"))).alias("tags"))


def _first(*tags: str) -> Column:
    """The first value of the first of the tags that has one; '' without."""
    return F.coalesce(*[F.nullif(F.get(F.element_at("tags", F.lit(t)), F.lit(0)), F.lit("")) for t in tags], F.lit(""))


def _all(*tags: str) -> Column:
    return F.concat(*[F.coalesce(F.element_at("tags", F.lit(t)), F.array().cast("array<string>")) for t in tags])


def _people(values: Column) -> Column:
    return F.filter(F.transform(values, tagged_name), lambda p: p.isNotNull() & (p["family"] != ""))


def _record(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    return df.select("file_id", "record_no", "format", *[c.alias(n) for n, c in fields.items()])


def ris_records(maps: DataFrame) -> DataFrame:
    """Records of RIS tags: secondary authors are a book's editors, pages are joined, dates reconciled."""
    ty = F.upper(_first("TY"))
    kind = F.coalesce(F.element_at(_map(RIS_TYPES), ty), F.lit("other"))
    books = ty.isin("CHAP", "ECHAP", "BOOK", "EBOOK", "EDBOOK", "CONF", "CPAPER")
    part = ty.isin("CHAP", "ECHAP", "CONF", "CPAPER")
    container = F.coalesce(F.nullif(_first("T2", "JF"), F.lit("")), F.nullif(F.when(part, _first("BT")).otherwise(""), F.lit("")), F.nullif(_first("JO", "JA"), F.lit("")), F.lit(""))
    series = F.when((kind == "book") & (_first("T3") == ""), container).otherwise(_first("T3"))
    start, end = hyphen(_first("SP")), _first("EP")
    counted = ty.isin("BOOK", "EBOOK", "EDBOOK", "THES", "RPRT") & start.rlike(r"^[0-9]+(?:\s*pp?\.?)?$") & (end == "")
    pages = F.when(counted, "").when((start != "") & (end != "") & (end != start) & ~start.rlike(r"[0-9]-\S"), F.concat(start, F.lit("-"), end)).otherwise(F.coalesce(F.nullif(start, F.lit("")), end))
    numbers = id_numbers(_all("SN"))
    issue = F.when((_first("IS") == "") & (kind == "journal-article") & _first("M1").rlike(r"^[A-Za-z]?[0-9]+[A-Za-z]?(?:[-–/][0-9]+)?$"), _first("M1")).otherwise(_first("IS"))
    date = tagged_date(_first("PY"), _first("DA"), _first("Y1"))
    retyped = F.when(ty.isin("GENERIC", "GEN"), F.when((container != "") & ((pages != "") | (F.size(numbers["isbn"]) > 0)) & (_first("VL") == "") & (issue == ""), "book-chapter").when((container == "") & (F.size(numbers["isbn"]) > 0), "book").otherwise(kind)).otherwise(kind)
    doi = F.coalesce(doi_of(F.array_join(_all("DO"), " ")), doi_of(F.array_join(_all("UR"), " ")), F.lit(""))
    editors = F.when(books, _all("ED", "A2")).otherwise(_all("ED"))
    fields = {
        "type": retyped, "title": _first("TI", "T1", "CT", "BT"), "authors": _people(_all("AU", "A1")), "others": F.exists(_all("AU", "A1"), lambda a: a.rlike(OTHERS)), "editors": _people(editors),
        "container": F.when(kind == "book", "").otherwise(container), "series": series, "volume": _first("VL"), "issue": issue, "pages": pages, "num_pages": F.when(counted, F.regexp_extract(start, "^[0-9]+", 0)).otherwise(""),
        "date": date, "publisher": _first("PB"), "place": _first("CY", "PP"), "issn": F.coalesce(F.get(numbers["issn"], F.lit(0)), F.lit("")), "isbn": F.coalesce(F.get(numbers["isbn"], F.lit(0)), F.lit("")), "doi": doi,
        "url": _first("UR"), "abstract": _first("AB", "N2"), "language": _first("LA"), "edition": _first("ET"), "genre": _first("M3"), "database": _first("DP", "DB"), "accession": _first("AN"),
    }
    return _dated(_record(maps.filter("format = 'ris'"), fields))


def enw_records(maps: DataFrame) -> DataFrame:
    """Records of EndNote tags."""
    kind = F.coalesce(F.element_at(_map(ENW_TYPES), F.lower(_first("0"))), F.lit("other"))
    container = _first("J", "B")
    moved = (kind == "book") & (_first("J") == "") & (_first("S") == "")
    numbers = id_numbers(_all("@"))
    fields = {
        "type": kind, "title": _first("T"), "authors": _people(_all("A")), "others": F.exists(_all("A"), lambda a: a.rlike(OTHERS)), "editors": _people(_all("E")), "container": F.when(moved, "").otherwise(container),
        "series": F.when(moved, container).otherwise(_first("S")), "volume": _first("V"), "issue": _first("N"), "pages": hyphen(_first("P")), "num_pages": F.lit(""), "date": tagged_date(_first("D"), joined(" ", _first("8"), _first("D")), F.lit("")),
        "publisher": _first("I"), "place": _first("C"), "issn": F.coalesce(F.get(numbers["issn"], F.lit(0)), F.lit("")), "isbn": F.coalesce(F.get(numbers["isbn"], F.lit(0)), F.lit("")),
        "doi": F.coalesce(doi_of(F.array_join(_all("R"), " ")), doi_of(F.array_join(_all("U"), " ")), F.lit("")), "url": _first("U"), "abstract": _first("X"), "language": _first("G"), "edition": _first("7"), "genre": _first("9"),
        "database": _first("W"), "accession": _first("M"),
    }
    return _dated(_record(maps.filter("format = 'enw'"), fields))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.when(F.col("date.y") > 0, F.col("date.y").cast("string")).otherwise(""), "month": F.col("date.m"), "day": F.col("date.d")}).drop("date")


#: A braced text with braces in it, up to four deep; RE2-like engines can't nest, so the depth is spelled out by rule.
BRACED = r"[^{}]*"
for _ in range(4):
    BRACED = rf"[^{{}}]*(?:\{{{BRACED}\}}[^{{}}]*)*"
VALUE = rf"\{{{BRACED}\}}|\"(?:[^\"{{}}]|\{{{BRACED}\}})*\"|[A-Za-z0-9_.:-]+"


def bib_entries(files: DataFrame) -> DataFrame:
    """(file_id, record_no, entrytype, key, fields): entries of BibTeX files with macros filled in; the first of equal fields holds.

    A file is cut where a line opens an entry, so one that never closes ends there.
    """
    text = F.regexp_replace(F.replace(F.coalesce("content", F.lit("")), F.lit("\ufeff"), F.lit("")), r"\r\n?", "\n")
    chunks = files.select("file_id", F.posexplode(F.split(F.concat(F.lit("\n"), text), r"\n(?=\s*@[A-Za-z][\w-]*\s*[{(])")).alias("record_no", "chunk"))
    head = r"(?s)^\s*@([A-Za-z][\w-]*)\s*[{(]\s*([^,\s{}()=]*)\s*,?"
    read = chunks.filter(F.col("chunk").rlike(head)).withColumns({"entrytype": F.lower(F.regexp_extract("chunk", head, 1)), "key": F.regexp_extract("chunk", head, 2)})
    pattern = rf"(?s)(?:^|[,{{(])\s*([A-Za-z][\w-]*)\s*=\s*((?:{VALUE})(?:\s*#\s*(?:{VALUE}))*)"
    names, values = (F.regexp_extract_all("chunk", F.lit(pattern), F.lit(k)) for k in (1, 2))
    pairs = read.withColumn("pairs", F.arrays_zip(F.transform(names, lambda n: F.lower(n)).alias("name"), values.alias("value")))
    macros = pairs.filter("entrytype = 'string'").select("file_id", F.explode("pairs").alias("p")).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("p.name", "p.value"))).alias("macros")).hint("merge")
    months = _map({m: m.capitalize() for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()})

    def unquoted(v: Column) -> Column:
        return F.regexp_replace(F.trim(v), r"(?s)^[{\"](.*)[}\"]$", "$1")

    def filled(v: Column) -> Column:
        pieces = F.regexp_extract_all(v, F.lit(rf"(?s){VALUE}"), F.lit(0))
        word = lambda p: p.rlike("^[A-Za-z]")
        return F.array_join(F.transform(pieces, lambda p: F.when(word(p), F.coalesce(unquoted(F.element_at("macros", F.lower(p))), F.element_at(months, F.lower(p)), p)).otherwise(unquoted(p))), "")

    entries = pairs.filter("entrytype not in ('string', 'comment', 'preamble')").join(macros, "file_id", "left").withColumn("macros", F.coalesce("macros", F.create_map().cast("map<string,string>")))
    first = F.filter("pairs", lambda p, i: F.array_position(F.transform("pairs", lambda q: q["name"]), p["name"]) == i + 1)
    fields = F.map_from_entries(F.transform(first, lambda p: F.struct(p["name"].alias("k"), F.trim(F.regexp_replace(filled(p["value"]), r"\s+", " ")).alias("v"))))
    return entries.select("file_id", "record_no", "entrytype", "key", fields.alias("fields"))


def inherited(entries: DataFrame, depth: int = 4) -> DataFrame:
    """Entries with what they lack taken from the entry that ``crossref`` or ``xdata`` names, up to ``depth`` steps.

    A parent's title is its child's book title. The first of entries of one key is the parent.
    Parents and macros grow with the files and are taken for small ones, so they are merged: a
    broadcast would hold them in the driver.
    """
    parents = entries.groupBy("file_id", F.lower("key").alias("parent")).agg(F.min_by("fields", "record_no").alias("given")).hint("merge")
    out = entries.withColumn("parent", F.lower(F.coalesce(F.element_at("fields", F.lit("crossref")), F.element_at("fields", F.lit("xdata")), F.lit(""))))
    for _ in range(depth):
        step = out.join(parents, ["file_id", "parent"], "left")
        as_book = F.map_filter("given", lambda k, _: k.isin(*INHERITED) & (k != "title"))
        title = F.coalesce(F.element_at("given", F.lit("booktitle")), F.element_at("given", F.lit("title")))
        offered = F.when(title.isNotNull(), F.map_concat(F.map_filter(as_book, lambda k, _: k != "booktitle"), F.create_map(F.lit("booktitle"), title))).otherwise(as_book)
        lacking = F.map_filter(offered, lambda k, _: ~F.array_contains(F.map_keys("fields"), k))
        merged = F.when(F.col("given").isNotNull(), F.map_concat("fields", lacking)).otherwise(F.col("fields"))
        further = F.lower(F.coalesce(F.element_at("given", F.lit("crossref")), F.element_at("given", F.lit("xdata")), F.lit("")))
        out = step.select("file_id", "record_no", "entrytype", "key", merged.alias("fields"), F.when(F.col("given").isNotNull(), further).otherwise("").alias("parent"))
    return out.drop("parent")


def bib_records(entries: DataFrame) -> DataFrame:
    """Records of BibTeX entries: LaTeX as text, an arXiv eprint as a DOI, school and institution as publisher."""
    field = lambda *names: F.coalesce(*[F.nullif(F.element_at("fields", F.lit(n)), F.lit("")) for n in names], F.lit(""))
    text = lambda *names: de_latex(field(*names))
    kind = F.coalesce(F.element_at(_map(BIB_TYPES), F.col("entrytype")), F.lit("other"))
    kind = F.when((F.col("entrytype") == "misc") & F.lower(field("note")).isin("preprint", "dataset", "software", "standard"), F.replace(F.lower(field("note")), F.lit("preprint"), F.lit("posted-content"))).otherwise(kind)
    people = lambda name: F.transform(bib_names(field(name)), lambda p: p.withField("family", de_latex(p["family"])).withField("given", de_latex(p["given"])))
    eprint = F.when(F.lower(field("archiveprefix", "eprinttype")) == "arxiv", F.concat(F.lit("10.48550/arXiv."), F.regexp_replace(field("eprint"), r"v[0-9]+$", ""))).otherwise("")
    link = F.regexp_extract(field("howpublished"), r"https?://[^\s{}]+", 0)
    date = tagged_date(joined(" ", field("year"), field("month")), field("date"), F.lit(""))
    fields = {
        "type": kind, "title": text("title"), "authors": people("author"), "others": field("author").rlike(r"(?i)\sand\s+others\s*$"), "editors": people("editor"), "container": text("journal", "journaltitle", "booktitle"), "series": text("series"),
        "volume": field("volume"), "issue": field("number", "issue"), "pages": hyphen(F.when(field("pages") != "", field("pages")).otherwise(field("eid"))), "num_pages": field("pagetotal"), "date": date,
        "publisher": text("publisher", "school", "institution", "organization"), "place": text("address", "location"), "issn": field("issn"), "isbn": field("isbn"), "doi": F.coalesce(doi_of(field("doi")), doi_of(field("url")), eprint),
        "url": F.coalesce(F.nullif(field("url"), F.lit("")), link), "abstract": text("abstract"), "language": field("language"), "edition": field("edition"), "genre": field("type"), "database": F.lit(""), "accession": F.lit(""),
    }
    return _dated(_record(entries.withColumn("format", F.lit("bibtex")), fields))


def records(files: DataFrame) -> DataFrame:
    """Records of mixed files of all three formats, in order of file and place; untitled ones with few fields are none."""
    maps = tag_maps(files)
    made = ris_records(maps).unionByName(enw_records(maps)).unionByName(bib_records(inherited(bib_entries(files))))
    return made.filter(let(F.struct(F.col("title").alias("t"), F.col("doi").alias("d")), lambda x: (x["t"] != "") | (x["d"] != "")))


def plain_chunks(files: DataFrame) -> DataFrame:
    """(file_id, chunk_no, text): what stands before, between and behind records, for reading as references."""
    text = F.regexp_replace(F.replace(F.coalesce("content", F.lit("")), F.lit("\ufeff"), F.lit("")), r"\r\n?", "\n")
    cut = rf"(?s)(?m)^\s*TY\s{{1,2}}-.*?^\s*ER\s{{1,2}}-[ \t]*$|^\s*%0(?:[ \t].*?)?(?:\n(?!\s*\n).*?)*?(?=\n\s*\n|\z)|^\s*@[A-Za-z][\w-]*\s*\{{{BRACED}\}}"
    parts = files.select("file_id", F.posexplode(F.split(text, cut)).alias("chunk_no", "text")).withColumn("text", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")))
    return parts.filter("text <> ''")
