"""Lines of pages by their place: text size, gaps, columns, furniture, margins.

Derived geometry: an order is a page set, a line item a line; its quantity, price and tax
give place and size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeweave.tables import load


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp")).select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), (F.col("q") * 10).alias("y"), (F.lit(8) + F.col("part") % 5).cast("double").alias("size"), F.col("part").cast("string").alias("text"), (F.col("supp") % 3).alias("dir"),
    )


def size_mode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within 8 % of the size in which most text of their document stands."""
    lines = _page_lines(spark, sf_dir)
    sums = lines.groupBy("doc", "size").agg(F.sum(F.char_length("text")).alias("chars"))
    mode = sums.groupBy("doc").agg(F.max(F.struct("chars", "size")).alias("m")).select("doc", F.col("m.size").alias("mode"))
    return lines.join(mode, "doc").filter("abs(size - mode) <= 0.08 * mode").select("doc", "seq", "size", "mode")


def line_gap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower median of the gaps between a document's lines."""
    gap = F.col("y") - F.lag("y").over(Window.partitionBy("doc").orderBy("y", "seq"))
    gaps = _page_lines(spark, sf_dir).withColumn("gap", gap).filter("gap is not null")
    return gaps.groupBy("doc").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)").alias("median_gap"), F.count("*").alias("gaps"))


def line_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks joined to lines: one begins where the baseline moves by more than 20."""
    order = Window.partitionBy("doc").orderBy("y", "seq")
    moved = _page_lines(spark, sf_dir).withColumn("starts", F.coalesce((F.col("y") - F.lag("y").over(order) > 20).cast("int"), F.lit(1)))
    numbered = moved.withColumn("line_no", F.sum("starts").over(order))
    return numbered.groupBy("doc", "line_no").agg(F.count("*").alias("chunks"), F.sum(F.char_length("text")).alias("chars"))


def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before which a blank line stands: the gap is over 1.6 and under 6 times the median."""
    order = Window.partitionBy("doc").orderBy("y", "seq")
    gaps = _page_lines(spark, sf_dir).withColumn("gap", F.col("y") - F.lag("y").over(order))
    medians = line_gap_median(spark, sf_dir).select("doc", "median_gap")
    return gaps.join(medians, "doc").filter("gap > 1.6 * median_gap and gap < 6 * median_gap").select("doc", "seq", "gap")


def reading_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction in which most text of a document runs."""
    sums = _page_lines(spark, sf_dir).groupBy("doc", "dir").agg(F.sum(F.char_length("text")).alias("chars"))
    return sums.groupBy("doc").agg(F.max(F.struct("chars", "dir")).alias("m")).select("doc", F.col("m.dir").alias("dir"))


def margin_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of bare numbers at one place, three or more a document: line numbers, not text."""
    placed = _page_lines(spark, sf_dir).filter("text rlike '^[0-9]{1,3}$'").groupBy("doc", F.floor(F.col("size") / 4).alias("place")).agg(F.count("*").alias("n"))
    return placed.filter("n >= 3")


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of pages, digits apart, that recur on a share of the pages: furniture.

    A line is kept as text if it stands on fewer pages than three tenths of them, three at
    most and two at least.
    """
    texts = load(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.regexp_replace(F.trim(F.regexp_extract("text", r"^[^\n]*", 0)), "[0-9]", "#").alias("line_key"))
    pages = texts.groupBy("source").agg(F.count("*").alias("pages"))
    seen = texts.filter("line_key <> ''").groupBy("source", "line_key").agg(F.count("*").alias("on_pages"))
    least = F.greatest(F.lit(2), F.least(F.lit(3), F.ceil(F.col("pages") * 3 / 10)))
    return seen.join(pages, "source").filter(F.col("on_pages") >= least).select("source", F.md5("line_key").alias("line_md5"), "on_pages")


def reference_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents most of whose lines look like references: a year and an opening capital."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).filter("trim(line) <> ''")
    hit = F.col("line").rlike("^[A-Z]") & F.col("line").rlike("(1[5-9]|20)[0-9][0-9]")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(hit).alias("hits")).withColumn("is_list", (F.col("hits") * 2 >= F.col("n_lines")) & (F.col("hits") >= 3))


QUERIES = {f.__name__: f for f in (size_mode_filter, line_gap_median, line_sessions, paragraph_breaks, reading_direction, margin_numbers, edge_lines, reference_like)}
_LINES = """WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS seq, min(l_quantity) * 10 AS y, (8 + min(l_partkey) % 5)::DOUBLE AS size, min(l_partkey)::VARCHAR AS text, min(l_suppkey) % 3 AS dir FROM lineitem GROUP BY ALL),
g AS (SELECT *, y - lag(y) OVER (PARTITION BY doc ORDER BY y, seq) AS gap FROM l), m AS (SELECT doc, quantile_disc(gap, 0.5) AS median_gap, count(*) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY doc)"""
SQL = {
    "size_mode_filter": f"""{_LINES}, s AS (SELECT doc, size, sum(len(text)) AS chars FROM l GROUP BY ALL), o AS (SELECT doc, size AS mode FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY chars DESC, size DESC) AS r FROM s) WHERE r = 1)
SELECT doc, seq, size, mode FROM l JOIN o USING (doc) WHERE abs(size - mode) <= 0.08 * mode""",
    "line_gap_median": f"{_LINES} SELECT * FROM m",
    "line_sessions": f"{_LINES}, n AS (SELECT *, sum(CASE WHEN gap <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY y, seq)::BIGINT AS line_no FROM g) SELECT doc, line_no, count(*) AS chunks, sum(len(text))::BIGINT AS chars FROM n GROUP BY ALL",
    "paragraph_breaks": f"{_LINES} SELECT doc, seq, gap FROM g JOIN m USING (doc) WHERE gap > 1.6 * median_gap AND gap < 6 * median_gap",
    "reading_direction": f"{_LINES}, s AS (SELECT doc, dir, sum(len(text)) AS chars FROM l GROUP BY ALL) SELECT doc, dir FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY chars DESC, dir DESC) AS r FROM s) WHERE r = 1",
    "margin_numbers": f"{_LINES} SELECT doc, floor(size / 4)::BIGINT AS place, count(*) AS n FROM l WHERE regexp_full_match(text, '[0-9]{{1,3}}') GROUP BY ALL HAVING count(*) >= 3",
    "edge_lines": """WITH t AS (SELECT source, regexp_replace(trim(regexp_extract(text, '^[^\\n]*'), ' '), '[0-9]', '#', 'g') AS k FROM documents), p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
s AS (SELECT source, k, count(*) AS on_pages FROM t WHERE k <> '' GROUP BY ALL) SELECT source, md5(k) AS line_md5, on_pages FROM s JOIN p USING (source) WHERE on_pages >= greatest(2, least(3, ceil(pages * 3 / 10.0)))""",
    "reference_like": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), h AS (SELECT doc_id, count(*) AS n_lines,
  count(*) FILTER (regexp_matches(line, '^[A-Z]') AND regexp_matches(line, '(1[5-9]|20)[0-9][0-9]')) AS hits FROM l WHERE trim(line, ' ') <> '' GROUP BY doc_id) SELECT *, hits * 2 >= n_lines AND hits >= 3 AS is_list FROM h""",
}
