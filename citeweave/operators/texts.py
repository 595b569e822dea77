"""Whole texts, pages and paragraphs: cleaning, scripts, splits, similarity of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeweave.functions.bibliographic import kind, partial_date, same_pages
from citeweave.functions.names import initials, join_and
from citeweave.functions.text import dominant_script, fold, one_edit, strip_tags, tokens
from citeweave.operators.matching import TOKENS_SQL
from citeweave.tables import WORKS_SQL, load, works


def clean_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's text: scripts and styles away, tags as blanks, basic entities decoded, white space single."""
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</(?:script|style)>", " ")
    text = strip_tags(bare, " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return load(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " ")).alias("text"))


def html_title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title element of a page; null without one."""
    found = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"[ \t\n\r]+", " "))
    return load(spark, sf_dir, "pages").select("page_id", F.nullif(found, F.lit("")).alias("title"))


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs: what blank lines part, numbered from 0."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    parts = F.filter(F.transform(F.split(text, r"\n[ \t]*(?:\n[ \t]*)+"), lambda p: F.trim(p)), lambda p: p != "")
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("para_no", "para"))
    return rows.select("doc_id", "para_no", F.char_length("para").alias("n_chars"), F.md5("para").alias("para_md5"))


def dominant_script_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script with most letters of each document."""
    return load(spark, sf_dir, "documents").select("doc_id", dominant_script(F.coalesce("text", F.lit(""))).alias("script"))


def fold_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded words that stand for several written ones."""
    words = load(spark, sf_dir, "documents").select(F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("word")).filter("word is not null")
    return words.distinct().groupBy(fold(F.col("word")).alias("folded")).agg(F.count("*").alias("n"), F.min("word").alias("first_word")).filter("n > 1")


def osa_one_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of passage words of six letters or more that one edit or swap parts.

    Two such words share their first or second half or differ in it alone, so pairs meet by a
    half (shifted by one at most) and no word is compared with all.
    """
    words = load(spark, sf_dir, "benchmark").select(F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("word")).filter("word rlike '^[a-z]{6,}$'").distinct()
    half = F.floor(F.char_length("word") / 2).cast("int")
    keys = F.array(
        F.concat(F.lit("a"), F.left("word", half - 1)), F.concat(F.lit("a"), F.left("word", half)), F.concat(F.lit("a"), F.left("word", half + 1)), F.concat(F.lit("a"), F.left("word", half - 2)),
        F.concat(F.lit("z"), F.right("word", half - 1)), F.concat(F.lit("z"), F.right("word", half)), F.concat(F.lit("z"), F.right("word", half + 1)), F.concat(F.lit("z"), F.right("word", half - 2)),
    )
    dealt = words.select("word", F.explode(keys).alias("key"))
    pairs = dealt.join(dealt.select(F.col("word").alias("other"), "key"), "key").filter("word < other").select("word", "other").distinct()
    return pairs.filter(one_edit(F.col("word"), F.col("other")))


def title_score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each passage's words another passage has, for pairs that share any."""
    own = load(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("words"))
    each = own.select("item_id", F.size("words").alias("wanted"), F.explode_outer("words").alias("token")).filter("token is not null")
    other = each.select(F.col("item_id").alias("other_id"), "token")
    shared = each.join(other, "token").filter("item_id <> other_id").groupBy("item_id", "other_id", "wanted").agg(F.count("*").alias("n"))
    return shared.select("item_id", "other_id", (F.col("n") / F.col("wanted")).alias("score"))


def distinct_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each order in order of line, each once."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("held"))
    return lines.select("l_orderkey", F.array_join(F.array_distinct(F.transform("held", lambda x: x["l_suppkey"])), ",").alias("suppliers"))


def page_range_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges derived from lines: equal ends as one page."""
    made = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", F.col("l_partkey"), F.col("l_partkey") + F.col("l_linenumber") % 3).alias("pages"))
    return made.select("l_orderkey", "l_linenumber", same_pages(F.col("pages")).alias("pages"))


def partial_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders written in several ways, read as year, month and day."""
    day = F.col("o_orderdate")
    written = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy/MM/dd/")).when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "yyyy///")).when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "d MMM yyyy"))
        .when(F.col("o_orderkey") % 5 == 3, F.date_format(day, "yyyy-MM")).otherwise(F.concat(F.lit("c"), F.date_format(day, "yyyy"), F.lit(" Spring")))
    )
    return load(spark, sf_dir, "orders").select("o_orderkey", partial_date(written).alias("d")).select("o_orderkey", "d.y", "d.m", "d.d")


def name_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", initials(F.regexp_replace("p_name", " ", "-")).alias("hyphened"), initials(F.col("p_name"), "", "").alias("bare"))


def author_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surnames of each work joined for a sentence, with and without the serial comma."""
    family = F.transform("authors", lambda a: a["family"])
    return works(spark, sf_dir).select("id", join_and(family).alias("serial"), join_and(family, "&", False).alias("plain"))


def kind_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).groupBy(kind(F.col("type"), F.col("container"), F.col("volume").cast("string")).alias("kind")).agg(F.count("*").alias("n"))


def fill_forward_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each publisher's list a dash stands for the row before's author: the author that each row means."""
    made = works(spark, sf_dir).select("publisher", "id", F.when(F.col("id") % 3 == 0, F.get("authors", F.lit(0))["family"]).alias("said"))
    order = Window.partitionBy("publisher", F.floor(F.col("id") / 4096)).orderBy("id")
    # Within a part the last one said holds; what a part begins with comes from the parts before.
    inside = made.withColumn("part", F.floor(F.col("id") / 4096)).withColumn("author", F.last_value("said", True).over(order))
    ends = inside.groupBy("publisher", "part").agg(F.max_by("said", F.when(F.col("said").isNotNull(), F.col("id"))).alias("at_end"))
    before = Window.partitionBy("publisher").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("publisher").alias("of"), F.col("part").alias("at"), F.last_value("at_end", True).over(before).alias("carried"))
    joined = inside.join(carried, F.col("publisher").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return joined.select("publisher", "id", F.coalesce("author", "carried").alias("author"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_html_text, html_title_extract, paragraph_split, dominant_script_of, fold_collisions, osa_one_edit, title_score_pairs, distinct_ordered, page_range_format, partial_date_parse, name_initials, author_list, kind_classify,
        fill_forward_author,
    )
}
_TAG = "</?[A-Za-z][\\w:.-]*(?:\\s[^<>]*)?/?>|<!--(?s:.*?)-->"
_AND = lambda n, word, oxford: f"CASE WHEN len({n}) = 0 THEN '' WHEN len({n}) = 1 THEN {n}[1] WHEN len({n}) = 2 THEN {n}[1] || ' {word} ' || {n}[2] ELSE array_to_string({n}[:len({n}) - 1], ', ') || '{oxford} {word} ' || {n}[len({n})] END"
_COUNT = lambda cls: f"len(regexp_replace(coalesce(text, ''), '[^{cls}]', '', 'g'))"
SQL = {
    "clean_html_text": f"""WITH b AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<(script|style)\\b.*?</(?:script|style)>', ' ', 'g') AS t FROM pages),
c AS (SELECT page_id, regexp_replace(t, '{_TAG}', ' ', 'g') AS t FROM b)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS text FROM c""",
    "html_title_extract": "SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r]+', ' ', 'g'), ' '), '') AS title FROM pages",
    "paragraph_split": """WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n[ \\t]*(?:\\n[ \\t]*)+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, (i - 1)::INT AS para_no, len(parts[i])::INT AS n_chars, md5(parts[i]) AS para_md5 FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)""",
    "dominant_script_of": f"""WITH c AS (SELECT doc_id, {_COUNT("\\p{Latin}")} AS l, {_COUNT("\\p{Cyrillic}")} AS c, {_COUNT("\\p{Greek}")} AS g, {_COUNT("぀-ヿ㐀-鿿가-힯")} AS k FROM documents)
SELECT doc_id, CASE WHEN greatest(l, c, g, k) = 0 THEN NULL WHEN l = greatest(l, c, g, k) THEN 'Latin' WHEN c = greatest(l, c, g, k) THEN 'Cyrillic' WHEN g = greatest(l, c, g, k) THEN 'Greek' ELSE 'CJK' END AS script FROM c""",
    "fold_collisions": """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}{3,}')) AS word FROM documents),
f AS (SELECT word, replace(replace(replace(replace(replace(replace(strip_accents(word), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'ł', 'l'), 'đ', 'd') AS folded FROM w)
SELECT folded, count(*) AS n, min(word) AS first_word FROM f GROUP BY folded HAVING count(*) > 1""",
    "osa_one_edit": f"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest({TOKENS_SQL}) AS word FROM benchmark) WHERE regexp_full_match(word, '[a-z]{{6,}}'))
SELECT a.word, b.word AS other FROM w a JOIN w b ON a.word < b.word AND abs(len(a.word) - len(b.word)) <= 1 WHERE damerau_levenshtein(a.word, b.word) <= 1""",
    "title_score_pairs": f"""WITH w AS (SELECT item_id, list_distinct({TOKENS_SQL}) AS words FROM benchmark), e AS (SELECT item_id, len(words) AS wanted, unnest(words) AS token FROM w)
SELECT a.item_id, b.item_id AS other_id, count(*) / any_value(a.wanted)::DOUBLE AS score FROM e a JOIN e b ON a.token = b.token AND a.item_id <> b.item_id GROUP BY a.item_id, b.item_id""",
    "distinct_ordered": """WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY first_line, l_suppkey) AS suppliers FROM f GROUP BY l_orderkey""",
    "page_range_format": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey::VARCHAR ELSE l_partkey || '-' || (l_partkey + l_linenumber % 3) END AS pages FROM lineitem",
    "partial_date_parse": """SELECT o_orderkey, year(o_orderdate)::INT AS y, CASE WHEN o_orderkey % 5 IN (0, 2, 3) THEN month(o_orderdate) ELSE 0 END::INT AS m,
  CASE WHEN o_orderkey % 5 IN (0, 2) THEN day(o_orderdate) ELSE 0 END::INT AS d FROM orders""",
    "name_initials": """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || '.'), '-') AS hyphened,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])), '') AS bare FROM part""",
    "author_list": f"WITH {WORKS_SQL}, n AS (SELECT id, list_transform(authors, lambda a: a.family) AS fam FROM works) SELECT id, {_AND('fam', 'and', ',')} AS serial, {_AND('fam', '&', '')} AS plain FROM n",
    "kind_classify": f"""WITH {WORKS_SQL} SELECT CASE type WHEN 'journal-article' THEN 'journal' WHEN 'book-chapter' THEN 'chapter' WHEN 'dissertation' THEN 'thesis' WHEN 'posted-content' THEN 'preprint'
  WHEN 'proceedings-article' THEN 'proceedings' ELSE type END AS kind, count(*) AS n FROM works GROUP BY 1""",
    "fill_forward_author": f"""WITH {WORKS_SQL}, s AS (SELECT publisher, id, CASE WHEN id % 3 = 0 THEN authors[1].family END AS said FROM works)
SELECT publisher, id, last_value(said IGNORE NULLS) OVER (PARTITION BY publisher ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS author FROM s""",
}
