"""Lists of works and lines of texts: letters, duplicates, order, wrapped lines, furniture, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeweave.functions.bibliographic import ordinal
from citeweave.functions.identifiers import extract_doi, isbn13_holds
from citeweave.functions.text import fold, fold_spelling, tokens
from citeweave.operators.matching import TOKENS_SQL
from citeweave.operators.ranking import rank_within
from citeweave.tables import LINES_SQL, WORKS_SQL, lines, load, works

#: A line of so many documents or more is furniture.
REPEATS = 3


def doc_line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a non-empty line."""
    return lines(spark, sf_dir)


def line_merge_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that open with a lower-case letter continue the row before: how many lines and characters each row has."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    opens = F.when(F.col("line").rlike("^[a-z]"), 0).otherwise(1)
    rows = lines(spark, sf_dir).withColumn("row_no", F.sum(opens).over(order))
    return rows.groupBy("doc_id", "row_no").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, digits apart, that recur in REPEATS documents or more. Copies in a document are dropped before the count."""
    keys = lines(spark, sf_dir).select("doc_id", F.regexp_replace("line", "[0-9]", "#").alias("line_key")).distinct()
    return keys.groupBy("line_key").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= REPEATS)


def bijective_letters(at: Column) -> Column:
    """a for 0, z for 25, aa for 26, and so on without end."""
    digits = F.aggregate(
        F.sequence(F.lit(1), F.lit(14)),
        F.struct(at.cast("long").alias("rest"), F.lit("").alias("made")),
        lambda x, _: F.when(x["rest"] >= 0, F.struct((F.floor(x["rest"] / 26) - 1).alias("rest"), F.concat(F.char(F.lit(97) + x["rest"] % 26), x["made"]).alias("made"))).otherwise(x),
    )
    return digits["made"]


def letters(works: DataFrame) -> DataFrame:
    """(id, letter): a, b ... for works of one first surname (accents folded) and year, by title without its article, then id.

    A lone work has none, nor has one without a year or a person.
    """
    people = F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.col("editors")) if "editors" in works.columns else F.col("authors")
    title = F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"^\s*(?:a|an|the)\s+", "")
    made = works.select("id", fold(F.get(people, F.lit(0))["family"]).alias("family"), F.col("year").cast("string").alias("year"), title.alias("key"))
    known = made.filter("family is not null and year is not null and year <> ''")
    several = known.groupBy("family", "year").agg(F.count("*").alias("works")).filter("works > 1").select("family", "year")
    ranked = rank_within(known.join(several, ["family", "year"], "left_semi"), ["family", "year"], F.left("key", F.lit(2)), ["key", "id"])
    lettered = ranked.select("id", bijective_letters(F.col("place") - 1).alias("letter"))
    return made.select("id").join(lettered, "id", "left").select("id", F.coalesce("letter", F.lit("")).alias("letter"))


def year_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters(works(spark, sf_dir))


def duplicate_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal tokens point to the first of them. The key is pre-aggregated, then joined, so no group meets in one task."""
    keyed = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(tokens(F.coalesce("text", F.lit(""))), " "), 256).alias("k"))
    first = keyed.groupBy("k").agg(F.min("doc_id").alias("first_id"))
    return keyed.join(first, "k").filter("doc_id <> first_id").select("doc_id", "first_id")


def list_order_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each work in its publisher's list, newest first (no year last), then surname (none first), then id."""
    made = works(spark, sf_dir).select("publisher", "id", F.coalesce("year", F.lit(0)).alias("year"), F.coalesce(F.get("authors", F.lit(0))["family"], F.lit("")).alias("family"))
    return rank_within(made, ["publisher"], -F.col("year"), ["family", "id"]).select("publisher", "id", "place")


def list_order_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each work in its publisher's list, oldest first (no year last), then id."""
    made = works(spark, sf_dir).select("publisher", "id", F.coalesce("year", F.lit(9999)).alias("year"))
    return rank_within(made, ["publisher"], F.col("year"), ["id"]).select("publisher", "id", "place")


def isbn_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether 13 digits derived from the order key hold as an ISBN."""
    made = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("978"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("isbn"))
    return made.select("o_orderkey", "isbn", isbn13_holds(F.col("isbn")).alias("holds"))


def edition_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.concat(ordinal(F.col("p_size")), F.lit(" ed.")).alias("edition"))


def doi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DOI of a line with a link, a query, a landing page or closing punctuation, by turns."""
    tails = F.array(*map(F.lit, (").", "?utm_source=x).", "/full).", "’s", "</a>", "#section")))
    made = works(spark, sf_dir).select("id", F.concat(F.lit("See (https://doi.org/"), "doi", F.get(tails, (F.col("id") % 6).cast("int"))).alias("line"))
    return made.select("id", extract_doi(F.col("line")).alias("doi"))


def spelling_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens whose spelling has another form."""
    words = load(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", fold_spelling(F.col("word")).alias("folded")).filter("word <> folded")


def case_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of small and capitalised forms of each ASCII word of three letters or more, and the label they give."""
    words = load(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w"))
    counted = words.groupBy(F.lower("w").alias("word")).agg(F.count_if(F.col("w").rlike("^[a-z]+$")).alias("low"), F.count_if(F.col("w").rlike("^[A-Z][a-z]+$")).alias("cap"))
    common = (F.col("low") >= 2) & (F.col("cap") * 5 <= F.col("low"))
    proper = (F.col("cap") >= 2) & (F.col("cap") >= 2 * F.col("low"))
    return counted.select("word", "low", "cap", F.when(common, "common").when(proper, "proper").otherwise("open").alias("label"))


QUERIES = {
    f.__name__: f
    for f in (doc_line_split, line_merge_wrapped, furniture_lines, year_letters, duplicate_of, list_order_newest, list_order_oldest, isbn_checksum, edition_ordinal, doi_extract, spelling_fold, case_evidence)
}

_KEY = TOKENS_SQL.replace("text", "coalesce(text, '')")
SQL = {
    "doc_line_split": f"WITH {LINES_SQL} SELECT * FROM kept_lines",
    "line_merge_wrapped": f"""WITH {LINES_SQL}, r AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[a-z]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS row_no FROM kept_lines)
SELECT doc_id, row_no::BIGINT AS row_no, count(*) AS n_lines, sum(len(line))::BIGINT AS n_chars FROM r GROUP BY ALL""",
    "furniture_lines": f"""WITH {LINES_SQL} SELECT line_key, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, regexp_replace(line, '[0-9]', '#', 'g') AS line_key FROM kept_lines)
GROUP BY line_key HAVING count(*) >= {REPEATS}""",
    "year_letters": f"""WITH {WORKS_SQL}, k AS (SELECT id, lower(coalesce(authors[1].family, editors[1].family)) AS family, year, regexp_replace(lower(title), '^(a|an|the) ', '') AS key FROM works),
r AS (SELECT id, family IS NOT NULL AND year IS NOT NULL AND count(*) OVER (PARTITION BY family, year) > 1 AS several, row_number() OVER (PARTITION BY family, year ORDER BY key, id) - 1 AS n FROM k)
SELECT id, CASE WHEN NOT several THEN '' WHEN n < 26 THEN chr((97 + n)::INT) WHEN n < 702 THEN chr((96 + n // 26)::INT) || chr((97 + n % 26)::INT)
  ELSE chr((97 + (n - 702) // 676)::INT) || chr((97 + (n - 702) // 26 % 26)::INT) || chr((97 + (n - 702) % 26)::INT) END AS letter FROM r""",
    "duplicate_of": f"SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string({_KEY}, ' ')) AS first_id FROM documents) WHERE doc_id <> first_id",
    "list_order_newest": f"WITH {WORKS_SQL} SELECT publisher, id, row_number() OVER (PARTITION BY publisher ORDER BY coalesce(year, 0) DESC, coalesce(authors[1].family, ''), id) AS place FROM works",
    "list_order_oldest": f"WITH {WORKS_SQL} SELECT publisher, id, row_number() OVER (PARTITION BY publisher ORDER BY coalesce(year, 9999), id) AS place FROM works",
    "isbn_checksum": """WITH i AS (SELECT o_orderkey, '978' || lpad(o_orderkey::VARCHAR, 10, '0') AS isbn FROM orders)
SELECT o_orderkey, isbn, list_sum(list_transform(range(1, 14), lambda k: isbn[k]::INT * CASE WHEN k % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 AS holds FROM i""",
    "edition_ordinal": """SELECT p_partkey, p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END || ' ed.' AS edition FROM part""",
    "doi_extract": f"WITH {WORKS_SQL} SELECT id, doi FROM works",
    "spelling_fold": f"""WITH t AS (SELECT DISTINCT word FROM (SELECT unnest({TOKENS_SQL}) AS word FROM documents)),
a AS (SELECT word, replace(replace(replace(replace(replace(replace(word, 'sulph', 'sulf'), 'ael', chr(1)), 'oel', chr(2)), 'ae', 'e'), 'oe', 'e'), chr(1), 'ael') AS w FROM t),
b AS (SELECT word, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(w, chr(2), 'oel'), 'our$', 'or'), 'i[sz]ation$', 'ization'), 'i[sz]e[sd]?$', 'ize'), 'y[sz]e[sd]?$', 'yze') AS w FROM a),
c AS (SELECT word, replace(replace(replace(regexp_replace(w, '([tb])re$', '\\1er'), 'lli', 'li'), 'lle', 'le'), 'lla', 'la') AS w FROM b),
f AS (SELECT word, CASE WHEN len(word) < 6 THEN CASE WHEN word = 'grey' THEN 'gray' ELSE word END ELSE regexp_replace(regexp_replace(w, 'mme$', 'm'), 'logue$', 'log') END AS folded FROM c)
SELECT word, folded FROM f WHERE word <> folded""",
    "case_evidence": """WITH c AS (SELECT lower(w) AS word, count(*) FILTER (regexp_full_match(w, '[a-z]+')) AS low, count(*) FILTER (regexp_full_match(w, '[A-Z][a-z]+')) AS cap
  FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS w FROM documents) GROUP BY 1)
SELECT word, low, cap, CASE WHEN low >= 2 AND cap * 5 <= low THEN 'common' WHEN cap >= 2 AND cap >= 2 * low THEN 'proper' ELSE 'open' END AS label FROM c""",
}
