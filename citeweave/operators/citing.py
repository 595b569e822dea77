"""Citations in a text and the entries of its list that they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.text import fold
from citeweave.plans import styles
from citeweave.plans.sql import MADE
from citeweave.records import harden
from citeweave.tables import works

LIST = 16
YEAR = r"(?:1[5-9]|20)[0-9]{2}"
#: The longest range of numbers that stands for its members.
RANGE = 50


def author_year_spans(texts: DataFrame) -> DataFrame:
    """(doc, span_no, first, form, year, suffix): citations by name and year, within brackets or with the year in brackets.

    ``form`` is the cited head ("Abel & Borg", "Abel et al."); a year alone goes on with the name before it.
    """
    groups = F.regexp_extract_all("text", F.lit(rf"\(([^()]*?{YEAR}[a-z]?[^()]*)\)|(\p{{Lu}}[\p{{L}}'’-]+(?: (?:and|&) \p{{Lu}}[\p{{L}}'’-]+| et al\.)? \({YEAR}[a-z]?\))"), F.lit(0))
    pieces = F.flatten(F.transform(groups, lambda g: F.split(F.regexp_replace(F.regexp_replace(g, rf"^(\p{{Lu}}.*?) \(({YEAR}[a-z]?)\)$", "$1, $2"), r"^\(|\)$", ""), r";\s*")))
    rows = texts.select("doc", F.posexplode(pieces).alias("span_no", "piece"))
    said = F.trim(F.regexp_extract("piece", rf"^(.*?),?\s+{YEAR}", 1))
    year, suffix = (F.regexp_extract("piece", rf"({YEAR})([a-z]?)", k) for k in (1, 2))
    form = F.regexp_replace(F.regexp_replace(said, r"^(?:see|e\.g\.|cf\.|also),?\s+", ""), r"\s+and\s+", " & ")
    first = fold(F.regexp_extract(form, r"^(.*?)(?:,| & | et al\.?|$)", 1))
    return rows.select("doc", "span_no", first.alias("first"), fold(form).alias("form"), year.alias("year"), suffix.alias("suffix")).filter("year <> '' and first <> ''")


def numeric_spans(texts: DataFrame) -> DataFrame:
    """(doc, span_no, entry_no): numbers in square brackets, ranges of up to ``RANGE`` as their members."""
    found = F.regexp_extract_all("text", F.lit(r"\[([0-9]{1,4}(?:\s*[,–-]\s*[0-9]{1,4})*)\]"), F.lit(1))

    def numbers(part: Column) -> Column:
        low, high = (F.nullif(F.regexp_extract(part, r"^\s*([0-9]+)(?:\s*[–-]\s*([0-9]+))?\s*$", k), F.lit("")).cast("int") for k in (1, 2))
        top = F.coalesce(high, low)
        return F.when((top >= low) & (top - low <= RANGE), F.sequence(low, top)).otherwise(F.array().cast("array<int>"))

    every = F.transform(found, lambda g: F.flatten(F.transform(F.split(g, ","), numbers)))
    return texts.select("doc", F.posexplode(every).alias("span_no", "held")).select("doc", "span_no", F.explode("held").alias("entry_no"))


def link_by_name(spans: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, span_no, entry_no): the entry of each citation by first name and year.

    Of several the one whose own cited form is the same, then the one with the same letter,
    then the first. ``entries`` has (doc, entry_no, first, form, year, suffix).
    """
    other = entries.select("doc", "first", "year", F.col("entry_no"), F.col("form").alias("own_form"), F.col("suffix").alias("own_suffix"))
    fits = F.struct((F.col("own_form") != F.col("form")).cast("int").alias("a"), (F.col("own_suffix") != F.col("suffix")).cast("int").alias("b"), "entry_no")
    return spans.join(other, ["doc", "first", "year"]).groupBy("doc", "span_no").agg(F.min(fits).alias("best")).select("doc", "span_no", "best.entry_no")


def link_by_number(spans: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, span_no, entry_no): all numbers of a bracket, if the list has every one of them; else none."""
    known = entries.select("doc", "entry_no", F.lit(True).alias("held"))
    joined = spans.join(known, ["doc", "entry_no"], "left")
    whole = joined.groupBy("doc", "span_no").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("whole")).filter("whole").select("doc", "span_no")
    return spans.join(whole, ["doc", "span_no"], "left_semi").select("doc", "span_no", "entry_no")


def _derived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(texts, entries): documents that cite each work of their list by name, then some by number."""
    made = harden(works(spark, sf_dir)).filter("year <> '' and size(authors) > 0").withColumn("doc", F.floor(F.col("id") / LIST))
    head = F.regexp_extract(styles.in_text("apa"), r"^\((.*), [0-9]{4}\)$", 1)
    rows = made.select("doc", "id", (F.col("id") % LIST + 1).cast("int").alias("entry_no"), F.get("authors", F.lit(0))["family"].alias("family"), head.alias("head"), "year")
    entries = rows.select("doc", "entry_no", fold(F.col("family")).alias("first"), fold(F.col("head")).alias("form"), "year", F.lit("").alias("suffix"))
    cited = F.array_sort(F.collect_list(F.struct("entry_no", F.concat(F.col("head"), F.lit(", "), F.col("year")).alias("said"))))
    body = F.concat(F.lit("As found before ("), F.array_join(F.transform(cited, lambda c: c["said"]), "; "), F.lit("), and again [1, 3-5] and [2, 99]."))
    return rows.groupBy("doc").agg(body.alias("text")), entries


def citation_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations by name and year, and the entries they mean."""
    texts, entries = _derived(spark, sf_dir)
    return link_by_name(author_year_spans(texts), entries)


def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations by number, and the entries they mean."""
    texts, entries = _derived(spark, sf_dir)
    return link_by_number(numeric_spans(texts), entries)


QUERIES = {f.__name__: f for f in (citation_link, citation_numbers)}
_ENTRIES = f"""{MADE}, n AS (SELECT id // {LIST} AS doc, id, (id % {LIST} + 1)::INT AS entry_no, year, CASE WHEN len(a) = 1 THEN a_fm[1] WHEN len(a) = 2 THEN a_fm[1] || ' & ' || a_fm[2] ELSE a_fm[1] || ' et al.' END AS form
FROM g WHERE year <> '' AND len(a) > 0)"""
SQL = {
    "citation_link": f"""{_ENTRIES} SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY entry_no) - 1)::INT AS span_no, min(entry_no) OVER (PARTITION BY doc, form, year) AS entry_no FROM n""",
    "citation_numbers": f"""{_ENTRIES}, d AS (SELECT doc FROM n WHERE entry_no IN (1, 3, 4, 5) GROUP BY doc HAVING count(*) = 4) SELECT doc, 0 AS span_no, unnest([1, 3, 4, 5]) AS entry_no FROM d""",
}
