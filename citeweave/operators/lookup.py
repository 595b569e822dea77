"""Looking works up: exact identifiers first, then fallbacks, each a join; what sources fill in for one another.

Services are tables here: ``crossref``, ``openalex``, ``openlibrary`` and an identifier map,
derived from parts, as the engine reads no network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.bibliographic import update_kind
from citeweave.functions.identifiers import extract_pmid, isbn_digits, to_doi
from citeweave.functions.names import split_name
from citeweave.functions.text import fold, trim_punct
from citeweave.tables import WORKS_SQL, load, works


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(crossref, openalex, openlibrary, id map), each with some of the works."""
    made = works(spark, sf_dir).withColumn("isbn", F.concat(F.lit("978"), F.lpad(F.col("id").cast("string"), 10, "0")))
    crossref = made.filter("id % 3 <> 0 and doi is not null").select("doi", "title", "year", "publisher", F.when(F.col("id") % 2 == 0, F.col("place")).alias("place"), "isbn", "type")
    openalex = made.filter("id % 3 = 0 and doi is not null").select("doi", F.col("title").alias("display_name"), F.col("year").alias("publication_year"), F.get("authors", F.lit(0)).alias("first"))
    openlibrary = made.filter("type = 'book'").select("isbn", F.col("title").alias("ol_title"), F.coalesce("place", F.lit("Bergen")).alias("ol_place"), F.col("year").alias("ol_year"))
    ids = made.filter("id % 4 = 0 and doi is not null").select((F.col("id") + 100_000).cast("string").alias("pmid"), "doi")
    return crossref, openalex, openlibrary, ids


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cell): a DOI link, a PubMed id, an ISBN or a title for each work, by turns."""
    made = works(spark, sf_dir)
    cell = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("PMID: "), (F.col("id") + 100_000).cast("string"))).when(F.col("id") % 4 == 1, F.concat(F.lit("https://doi.org/"), F.coalesce("doi", F.lit(""))))
        .when(F.col("id") % 4 == 2, F.concat(F.lit("doi:"), F.coalesce("doi", F.lit("")), F.lit("."))).otherwise(F.upper("title"))
    )
    return made.select("id", cell.alias("cell"))


def id_lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's work: by DOI, by PubMed id, by title; the route it came by, or none."""
    crossref, openalex, _, ids = _sources(spark, sf_dir)
    asked = _asked(spark, sf_dir).withColumns({"said": to_doi(F.col("cell")), "pmid": extract_pmid(F.col("cell"))})
    by_id = asked.join(ids.withColumnRenamed("doi", "mapped"), "pmid", "left").withColumn("wanted", F.coalesce("said", "mapped"))
    found = by_id.join(crossref.select(F.col("doi").alias("wanted"), F.col("title").alias("cr_title")), "wanted", "left")
    found = found.join(openalex.select(F.col("doi").alias("wanted"), F.col("display_name").alias("oa_title")), "wanted", "left")
    # A title may be several works': the least DOI stands for them.
    titles = crossref.groupBy(fold(F.col("title")).alias("key")).agg(F.min("doi").alias("title_doi"))
    found = found.withColumn("key", F.when(F.col("wanted").isNull(), fold(F.col("cell")))).join(titles, "key", "left")
    via = F.when(F.col("cr_title").isNotNull(), F.when(F.col("said").isNotNull(), "doi").otherwise("pmid")).when(F.col("oa_title").isNotNull(), "openalex").when(F.col("title_doi").isNotNull(), "title").otherwise("none")
    return found.select("id", via.alias("via"), F.when(via == "none", None).otherwise(F.coalesce("wanted", "title_doi")).alias("doi"))


def book_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by ISBN of either source: the first's values, filled by the other's place and year."""
    crossref, _, openlibrary, _ = _sources(spark, sf_dir)
    both = crossref.filter("type = 'book'").join(openlibrary, "isbn", "full")
    return both.select("isbn", F.coalesce("title", "ol_title").alias("title"), F.coalesce("place", "ol_place").alias("place"), F.coalesce("year", "ol_year").alias("year"), F.col("title").isNotNull().alias("in_crossref"))


def openalex_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of the second source in the first one's shape: names parted, type mapped, bare DOI."""
    _, openalex, _, _ = _sources(spark, sf_dir)
    shown = F.concat_ws(" ", F.nullif("first.given", F.lit("")), "first.family")
    named = split_name(shown)
    return openalex.select("doi", F.col("display_name").alias("title"), F.col("publication_year").cast("string").alias("year"), named["family"].alias("family"), named["given"].alias("given"))


def regrade_by_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DOI in a text against the record it names: good if the titles are equal and the years a year apart at most, else to check (`grading.regrade` grades the whole text)."""
    crossref, *_ = _sources(spark, sf_dir)
    said = works(spark, sf_dir).filter("doi is not null").select("id", "doi", F.when(F.col("id") % 5 == 0, F.lit("Other words entirely")).otherwise(F.col("title")).alias("said"), (F.coalesce("year", F.lit(0)) + F.when(F.col("id") % 7 == 0, 9).otherwise(0)).alias("said_year"))
    joined = said.join(crossref.select("doi", "title", "year"), "doi", "left")
    fits = (F.col("title") == F.col("said")) & F.coalesce(F.abs(F.col("year") - F.col("said_year")) <= 1, F.lit(True))
    return joined.select("id", F.when(F.col("title").isNull(), "none").when(fits, "good").otherwise("check").alias("grade"))


def preprint_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprints with the DOI they were published under, where a relation names one that is held."""
    made = works(spark, sf_dir).filter("doi is not null")
    related = made.filter("type = 'posted-content'").select("id", F.col("doi").alias("preprint"), (F.col("id") + 3).alias("published_id"))
    held = made.filter("type = 'journal-article'").select(F.col("id").alias("published_id"), F.col("doi").alias("published"))
    return related.join(held, "published_id", "left").select("id", F.coalesce("published", "preprint").alias("doi"), F.col("published").isNotNull().alias("swapped"))


def journal_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short name of each work's journal: from the first list, else the second, else its own."""
    names = works(spark, sf_dir).select("container").distinct()
    first = names.filter("length(container) % 2 = 0").select(fold(F.col("container")).alias("key"), F.concat(F.left("container", F.lit(9)), F.lit(".")).alias("nlm"))
    second = names.filter("length(container) % 3 = 0").select(fold(F.col("container")).alias("key"), F.concat(F.left("container", F.lit(7)), F.lit(".")).alias("jabref"))
    keyed = works(spark, sf_dir).select("id", "container", fold(F.col("container")).alias("key"))
    return keyed.join(first, "key", "left").join(second, "key", "left").select("id", F.coalesce("nlm", "jabref", "container").alias("short"))


def uncached_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs that have to be fetched: each once, less those whose cached answer is fresh (hits last longer than misses)."""
    asked = works(spark, sf_dir).filter("doi is not null").select("doi").unionByName(works(spark, sf_dir).filter("doi is not null and id % 2 = 0").select("doi"))
    cached = works(spark, sf_dir).filter("doi is not null").select("doi", (F.col("id") % 900).alias("age_min"), (F.col("id") % 3 > 0).alias("hit"))
    fresh = cached.filter(F.col("age_min") < F.when(F.col("hit"), 360).otherwise(10))
    return asked.dropDuplicates(["doi"]).join(fresh, "doi", "left_anti")


def list_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of one title in a publisher's list, each pointing to the first."""
    made = works(spark, sf_dir).select("id", "publisher", F.md5(fold(F.col("title"))).alias("k"))
    first = made.groupBy("publisher", "k").agg(F.min("id").alias("first_id"))
    same = F.col("p").eqNullSafe(F.col("publisher")) & (F.col("kk") == F.col("k"))
    return made.join(first.select(F.col("publisher").alias("p"), F.col("k").alias("kk"), "first_id"), same).filter("id <> first_id").select("id", "first_id")


def retraction_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with a notice that says something is wrong with them, and what."""
    kinds = F.array(*map(F.lit, ("Retraction", "new_edition", "expression-of-concern", "Corrigendum", "addendum")))
    notices = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("type"))
    worst = F.min(F.when(update_kind(F.col("type")) == "retraction", 0).when(update_kind(F.col("type")) == "concern", 1).otherwise(2))
    told = notices.filter(update_kind(F.col("type")).isNotNull()).groupBy("id").agg(F.count("*").alias("notices"), worst.alias("worst"))
    return told.select("id", "notices", F.get(F.array(*map(F.lit, ("retraction", "concern", "correction"))), F.col("worst")).alias("warning"))


def isbn_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers' numbers that hold as ISBNs, bare, and the place a catalogue gives, trimmed."""
    made = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("978-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("said"), F.concat("o_orderpriority", F.lit(" : ")).alias("place"))
    return made.select("o_orderkey", isbn_digits(F.col("said")).alias("isbn"), trim_punct(F.col("place")).alias("place")).filter("isbn is not null")


QUERIES = {
    f.__name__: f
    for f in (id_lookup_cascade, book_merge, openalex_records, regrade_by_doi, preprint_versions, journal_abbreviations, uncached_dois, list_duplicates, retraction_warnings, isbn_books)
}
_MADE = f"WITH {WORKS_SQL}, made AS (SELECT *, '978' || lpad(id::VARCHAR, 10, '0') AS isbn FROM works)"
_PLAIN = lambda c: f"lower({c})"
SQL = {
    "id_lookup_cascade": f"""{_MADE}, asked AS (SELECT id, CASE WHEN id % 4 IN (1, 2) THEN doi END AS said, CASE WHEN id % 4 = 0 THEN doi END AS mapped, CASE WHEN id % 4 = 3 OR (id % 4 IN (1, 2) AND doi IS NULL) OR (id % 4 = 0 AND doi IS NULL)
    THEN CASE WHEN id % 4 = 3 THEN lower(title) ELSE '-' END END AS key FROM made),
titles AS (SELECT lower(title) AS key, min(doi) AS title_doi FROM made WHERE id % 3 <> 0 AND doi IS NOT NULL GROUP BY 1),
found AS (SELECT asked.id, said, coalesce(said, mapped) AS wanted, title_doi, asked.id % 3 <> 0 AS cr FROM asked LEFT JOIN titles USING (key))
SELECT id, CASE WHEN wanted IS NOT NULL AND cr THEN CASE WHEN said IS NOT NULL THEN 'doi' ELSE 'pmid' END WHEN wanted IS NOT NULL THEN 'openalex' WHEN title_doi IS NOT NULL THEN 'title' ELSE 'none' END AS via, coalesce(wanted, title_doi) AS doi FROM found""",
    "book_merge": f"""{_MADE}, c AS (SELECT * FROM made WHERE id % 3 <> 0 AND doi IS NOT NULL AND type = 'book'), o AS (SELECT * FROM made WHERE type = 'book')
SELECT o.isbn, o.title, coalesce(CASE WHEN c.id % 2 = 0 THEN c.place END, o.place, 'Bergen') AS place, o.year, c.id IS NOT NULL AS in_crossref FROM o LEFT JOIN c USING (isbn)""",
    "openalex_records": f"""{_MADE} SELECT doi, title, year::VARCHAR AS year, coalesce(authors[1].family, '') AS family, coalesce(authors[1].given, '') AS given FROM made WHERE id % 3 = 0 AND doi IS NOT NULL""",
    "regrade_by_doi": f"""{_MADE} SELECT id, CASE WHEN id % 3 = 0 THEN 'none' WHEN id % 5 <> 0 AND (year IS NULL OR id % 7 <> 0) THEN 'good' ELSE 'check' END AS grade FROM made WHERE doi IS NOT NULL""",
    "preprint_versions": f"""{_MADE} SELECT a.id, coalesce(b.doi, a.doi) AS doi, b.doi IS NOT NULL AS swapped FROM made a LEFT JOIN made b ON b.id = a.id + 3 AND b.type = 'journal-article' AND b.doi IS NOT NULL
WHERE a.type = 'posted-content' AND a.doi IS NOT NULL""",
    "journal_abbreviations": f"{_MADE} SELECT id, CASE WHEN len(container) % 2 = 0 THEN container[:9] || '.' WHEN len(container) % 3 = 0 THEN container[:7] || '.' ELSE container END AS short FROM made",
    "uncached_dois": f"{_MADE} SELECT doi FROM made WHERE doi IS NOT NULL AND NOT (id % 900 < CASE WHEN id % 3 > 0 THEN 360 ELSE 10 END)",
    "list_duplicates": f"{_MADE} SELECT id, first_id FROM (SELECT id, min(id) OVER (PARTITION BY publisher, lower(title)) AS first_id FROM made) WHERE id <> first_id",
    "retraction_warnings": """SELECT o_custkey AS id, count(*) AS notices, CASE min(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END) WHEN 0 THEN 'retraction' WHEN 1 THEN 'concern' ELSE 'correction' END AS warning
FROM orders WHERE o_orderkey % 5 IN (0, 2, 3) GROUP BY o_custkey""",
    "isbn_books": """WITH i AS (SELECT o_orderkey, '978' || lpad(o_orderkey::VARCHAR, 10, '0') AS isbn, o_orderpriority AS place FROM orders)
SELECT * FROM i WHERE list_sum(list_transform(range(1, 14), lambda k: isbn[k]::INT * CASE WHEN k % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0""",
}
