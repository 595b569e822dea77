"""Derived works written to tagged files and read again; BibTeX entries that inherit fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.latex import de_latex
from citeweave.plans import styles
from citeweave.plans.sql import MADE
from citeweave.plans.sql import SQL as RENDERED
from citeweave.records import harden
from citeweave.sources import mixed
from citeweave.sources.tagged import inherited, records, tag_maps
from citeweave.tables import load, works

#: Works of one derived file, and of one paste.
FILE, PASTED = 16, 24


def _files(spark: SparkSession, sf_dir: str, form: str, between: str = "\n") -> DataFrame:
    made = harden(works(spark, sf_dir)).select(F.floor(F.col("id") / FILE).alias("file_id"), "id", styles.EXPORTS[form]().alias("text"))
    rows = F.array_sort(F.collect_list(F.struct("id", "text")))
    return made.groupBy("file_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), between).alias("content"))


def _read(spark: SparkSession, sf_dir: str, form: str, between: str = "\n") -> DataFrame:
    got = records(_files(spark, sf_dir, form, between))
    people = F.array_join(F.transform("authors", lambda p: F.concat_ws("/", p["family"], p["given"])), ";")
    return got.select("file_id", "title", "year", "month", "volume", "issue", "pages", "container", "publisher", "edition", "doi", people.alias("people"))


def ris_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works exported as RIS files and read again."""
    return _read(spark, sf_dir, "ris", "")


def endnote_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works exported as EndNote files and read again."""
    return _read(spark, sf_dir, "endnote")


def bibtex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works exported as BibTeX files and read again."""
    return _read(spark, sf_dir, "bibtex", "\n\n")


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each tag the RIS files of the works hold."""
    maps = tag_maps(_files(spark, sf_dir, "ris", ""))
    return maps.select(F.explode("tags").alias("tag", "held")).groupBy("tag").agg(F.sum(F.size("held")).alias("n"))


def bib_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries derived from parts, in chains of parents: what each has in the end."""
    part = load(spark, sf_dir, "part")
    field = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("k"), value.alias("v")))
    key = lambda c: F.concat(F.lit("e"), c.cast("string"))
    own = [
        field("title", F.col("p_name")), field("crossref", F.when(F.col("p_partkey") % 4 > 0, key(F.col("p_partkey") - 1))), field("publisher", F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand"))),
        field("year", F.when(F.col("p_partkey") % 4 == 1, F.col("p_size").cast("string"))), field("note", F.when(F.col("p_partkey") % 2 == 0, F.lit("own"))),
    ]
    entries = part.select(F.floor(F.col("p_partkey") / 64).alias("file_id"), F.col("p_partkey").alias("record_no"), F.lit("inbook").alias("entrytype"), key(F.col("p_partkey")).alias("key"), F.map_from_entries(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("fields"))
    get = lambda name: F.element_at("fields", F.lit(name)).alias(name)
    return inherited(entries).select("key", get("title"), get("booktitle"), get("publisher"), get("year"), get("note"))


def latex_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names written with accent commands, read as text."""
    written = F.concat(F.lit("{\\'e}t{\\\"u}de of "), F.replace(F.col("p_name"), F.lit("o"), F.lit("\\o{}")), F.lit(" \\& {"), F.col("p_brand"), F.lit("}--x"))
    return load(spark, sf_dir, "part").select("p_partkey", de_latex(written).alias("text"))


def pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content): pastes of works by turns as RIS, EndNote, BibTeX and APA text, blank lines between."""
    made = harden(works(spark, sf_dir))
    forms = F.array(*(F.when(F.col("id") % 4 == i, form) for i, form in enumerate((styles.ris(), styles.endnote(), styles.bibtex(), styles.apa()))))
    pieces = made.select(F.floor(F.col("id") / PASTED).alias("file_id"), "id", F.explode(F.filter(forms, lambda x: x.isNotNull())).alias("piece"))
    rows = F.array_sort(F.collect_list(F.struct("id", "piece")))
    return pieces.groupBy("file_id").agg(F.array_join(F.transform(rows, lambda r: r["piece"]), "\n\n").alias("content"))


def mixed_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three formats and texts between them, in the order of the paste."""
    return mixed.chunks(mixed.lines_of(pasted(spark, sf_dir)), several=False)


QUERIES = {f.__name__: f for f in (ris_roundtrip, endnote_roundtrip, bibtex_roundtrip, tag_counts, bib_inherit, latex_names, mixed_paste)}


def _held(container: str, pages: str = "pages") -> str:
    """Fields as they were exported; a month needs a year."""
    people = "array_to_string(list_transform(a, lambda p: p.fam || '/' || p.given), ';')"
    return f"""{MADE} SELECT id // {FILE} AS file_id, title, year, (CASE WHEN year = '' THEN 0 ELSE month END)::INT AS month, volume, issue, {pages} AS pages, CASE WHEN {container} THEN container ELSE '' END AS container,
  publisher, edition, doi, {people} AS people FROM g"""


#: A lone page of a book, thesis or report is read as its number of pages.
_LONE = "CASE WHEN p2 = '' AND kind IN ('book', 'thesis', 'report') THEN '' ELSE pages END"
_FORMS = " UNION ALL ".join(f"SELECT id, '{kind}' AS kind, text FROM ({RENDERED[query]}) WHERE id % 4 = {i}" for i, (kind, query) in enumerate((("ris", "export_ris"), ("enw", "export_endnote"), ("bibtex", "export_bibtex"), ("plain", "style_apa"))))
SQL = {
    "mixed_paste": f"""SELECT id // {PASTED} AS file_id, (row_number() OVER (PARTITION BY id // {PASTED} ORDER BY id) - 1)::INT AS chunk_no, kind,
  regexp_replace(replace(text, chr(13), ''), '^\\s+|\\s+$', '', 'g') AS text FROM ({_FORMS})""",
    "ris_roundtrip": _held("kind <> 'book'", _LONE),
    "endnote_roundtrip": _held("kind <> 'book'"),
    "bibtex_roundtrip": _held("kind IN ('journal', 'chapter', 'proceedings')"),
    "tag_counts": f"""{MADE}, t AS (SELECT unnest(list_concat(['TY', 'TI', 'T2'], list_transform(a, lambda p: 'AU'), list_transform(e, lambda p: 'ED'), list_filter([
    CASE WHEN edition <> '' THEN 'ET' END, CASE WHEN volume <> '' THEN 'VL' END, CASE WHEN issue <> '' THEN 'IS' END, CASE WHEN p1 <> '' THEN 'SP' END, CASE WHEN p2 <> '' THEN 'EP' END, CASE WHEN year <> '' THEN 'PY' END,
    CASE WHEN year <> '' THEN 'DA' END, CASE WHEN publisher <> '' THEN 'PB' END, CASE WHEN place <> '' THEN 'CY' END, CASE WHEN doi <> '' THEN 'DO' END, CASE WHEN link <> '' THEN 'UR' END, 'ER'], lambda x: x IS NOT NULL))) AS tag FROM g)
SELECT tag, count(*) AS n FROM t GROUP BY tag""",
    "bib_inherit": """WITH e AS (SELECT p_partkey AS k, p_partkey // 64 AS f, p_name AS title, p_brand, p_size FROM part)
SELECT 'e' || e.k AS key, e.title, CASE WHEN e.k % 4 > 0 THEN b.title END AS booktitle, CASE WHEN e.k % 4 = 0 THEN e.p_brand ELSE r.p_brand END AS publisher,
  CASE WHEN e.k % 4 = 1 THEN e.p_size::VARCHAR WHEN e.k % 4 > 1 THEN y.p_size::VARCHAR END AS year, CASE WHEN e.k % 2 = 0 THEN 'own' END AS note
FROM e LEFT JOIN e b ON b.k = e.k - 1 AND b.f = e.f LEFT JOIN e r ON r.k = e.k - e.k % 4 AND r.f = e.f LEFT JOIN e y ON y.k = e.k - e.k % 4 + 1 AND y.f = e.f""",
    "latex_names": "SELECT p_partkey, 'étüde of ' || replace(p_name, 'o', 'ø') || ' & ' || p_brand || '–x' AS text FROM part",
}
