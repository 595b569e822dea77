"""Loading tables, and the citation-shaped works derived from the parts table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Invented people of the derived works; one without a given name is an organisation.
FAMILIES = ("Abel", "Borg", "Costa", "Dietz", "Evans", "Fabre", "Grant", "Holm", "Ivers", "Jansen", "Kato", "Lund", "Moreau", "Nunez", "Okafor", "Petrov")
GIVENS = ("Anna", "Ben Carl", "Chloe", "Dan", "Eva Maria", "Finn", "Greta", "Hugo", "Ida", "Jean-Paul", "Kim", "")
TYPES = ("book", "book-chapter", "dissertation", "posted-content", "report", "proceedings-article", "journal-article", "journal-article", "journal-article", "journal-article")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: tuple[str, ...], index: str) -> str:
    return f"element_at(array({', '.join(repr(n) for n in names)}), cast(({index}) % {len(names)} + 1 AS int))"


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work a part: identifiers, people, title, container, date and locators; each lacks some of them."""
    given = _pick(GIVENS, "p_partkey * 5 + i")
    person = f"named_struct('family', {_pick(FAMILIES, 'p_partkey * 7 + i * 3')}, 'given', {given}, 'literal', {given} = '')"
    people = lambda last: f"transform(sequence(0, {last}), i -> {person})"
    none = "cast(array() AS array<struct<family:string,given:string,literal:boolean>>)"
    return load(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "concat(upper(left(p_name, 1)), substr(p_name, 2), ' of the ', lower(p_type), ' series') AS title",
        f"if(p_partkey % 19 = 8, {none}, {people('p_size % 8')}) AS authors",
        f"if(p_partkey % 4 = 1, {people('p_size % 3')}, {none}) AS editors",
        "if(p_partkey % 17 = 6, NULL, cast(1970 + p_partkey % 55 AS int)) AS year",
        "cast(p_partkey % 13 AS int) AS month",
        "if(p_partkey % 5 = 2, NULL, cast(1 + p_partkey % 40 AS int)) AS volume",
        "if(p_partkey % 3 = 1, NULL, cast(1 + p_partkey % 12 AS int)) AS issue",
        "if(p_partkey % 11 = 4, NULL, concat(1 + p_partkey * 13 % 900, '-', 1 + p_partkey * 13 % 900 + p_size % 30)) AS pages",
        "if(p_partkey % 10 = 7, cast(1 + p_size % 12 AS string), NULL) AS edition",
        "concat('Journal of ', initcap(p_type), ' Studies') AS container",
        "if(p_partkey % 13 = 5, NULL, concat(replace(p_brand, '#', ' '), ' Press')) AS publisher",
        "if(p_partkey % 6 = 0, 'Oslo', NULL) AS place",
        "if(p_partkey % 7 = 3, NULL, concat('10.', 1000 + p_partkey % 9000, '/', lower(p_type), '.', p_partkey)) AS doi",
        f"{_pick(TYPES, 'p_partkey')} AS type",
    )


_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_PEOPLE = lambda last: (
    f"list_transform(range(0, {last} + 1), lambda i: {{'family': {_LIST(FAMILIES)}[(p_partkey * 7 + i * 3) % {len(FAMILIES)} + 1], 'given': {_LIST(GIVENS)}[(p_partkey * 5 + i) % {len(GIVENS)} + 1]}})"
)

#: The same derivation in SQL; missing texts are null here too.
WORKS_SQL = f"""works AS (
  SELECT p_partkey AS id, upper(p_name[1]) || p_name[2:] || ' of the ' || lower(p_type) || ' series' AS title,
    CASE WHEN p_partkey % 19 = 8 THEN [] ELSE {_PEOPLE('p_size % 8')} END AS authors, CASE WHEN p_partkey % 4 = 1 THEN {_PEOPLE('p_size % 3')} ELSE [] END AS editors,
    CASE WHEN p_partkey % 17 <> 6 THEN (1970 + p_partkey % 55)::INT END AS year, (p_partkey % 13)::INT AS month, CASE WHEN p_partkey % 5 <> 2 THEN (1 + p_partkey % 40)::INT END AS volume,
    CASE WHEN p_partkey % 3 <> 1 THEN (1 + p_partkey % 12)::INT END AS issue, CASE WHEN p_partkey % 11 <> 4 THEN (1 + p_partkey * 13 % 900) || '-' || (1 + p_partkey * 13 % 900 + p_size % 30) END AS pages,
    CASE WHEN p_partkey % 10 = 7 THEN (1 + p_size % 12)::VARCHAR END AS edition, 'Journal of ' || upper(p_type[1]) || lower(p_type[2:]) || ' Studies' AS container,
    CASE WHEN p_partkey % 13 <> 5 THEN replace(p_brand, '#', ' ') || ' Press' END AS publisher, CASE WHEN p_partkey % 6 = 0 THEN 'Oslo' END AS place,
    CASE WHEN p_partkey % 7 <> 3 THEN '10.' || (1000 + p_partkey % 9000) || '/' || lower(p_type) || '.' || p_partkey END AS doi, {_LIST(TYPES)}[p_partkey % {len(TYPES)} + 1] AS type
  FROM part)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line): the non-empty lines of every document, numbered from 0."""
    split = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("line_no", "line"))
    return split.withColumn("line", F.trim("line")).filter("line <> ''")


LINES_SQL = r"""lines AS (
  SELECT doc_id, (unnest(range(1, len(parts) + 1)) - 1)::INT AS line_no, trim(unnest(parts), ' ') AS line
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS parts FROM documents)),
kept_lines AS (SELECT * FROM lines WHERE line <> '')"""
