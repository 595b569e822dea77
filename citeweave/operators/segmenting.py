"""Reference lists of derived works, cut apart again in each layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.segment import bare_title, layout, split_references
from citeweave.plans import styles
from citeweave.plans.sql import APA, VANCOUVER
from citeweave.records import harden
from citeweave.tables import works

#: Works of one derived list.
LIST = 16


def derived_lists(spark: SparkSession, sf_dir: str, style: str, lead: str, between: str) -> DataFrame:
    """(list_id, text): LIST works a list, each on a line behind ``lead`` (``#`` is its number)."""
    made = harden(works(spark, sf_dir)).select(F.floor(F.col("id") / LIST).alias("list_id"), "id", styles.STYLES[style]().alias("line"))
    rows = F.array_sort(F.collect_list(F.struct("id", "line")))
    text = F.array_join(F.transform("rows", lambda r, i: F.concat(F.replace(F.lit(lead), F.lit("#"), (i + 1).cast("string")), r["line"])), between)
    return made.groupBy("list_id").agg(rows.alias("rows")).select("list_id", text.alias("text"))


def _split(spark: SparkSession, sf_dir: str, style: str, lead: str, between: str, mode: str) -> DataFrame:
    lists = derived_lists(spark, sf_dir, style, lead, between)
    return lists.select("list_id", F.posexplode(split_references(F.col("text"), mode)).alias("ref_no", "text"))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of one reference a line."""
    return _split(spark, sf_dir, "apa", "", "\n", "lines")


def split_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of paragraphs."""
    return _split(spark, sf_dir, "apa", "", "\n\n", "blank")


def split_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lists."""
    return _split(spark, sf_dir, "vancouver", "#. ", "\n", "numbered")


def split_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lists whose layout is found out."""
    return _split(spark, sf_dir, "vancouver", "#. ", "\n", "auto")


#: Layouts of derived lists: what stands in front of a reference, how its wrapped lines go on, and what parts references.
LAYOUTS = {"hanging": ("", "\n    ", "\n"), "numbered": ("[#] ", "\n", "\n"), "bulleted": ("• ", "\n", "\n"), "paragraphs": ("", "\n", "\n\n"), "per line": ("", " ", "\n")}
WIDTH = 70


def wrapped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(list_id, form, text): lists of APA references, each list in every layout, under a heading, lines of ``WIDTH`` characters and a page's number in the middle."""
    made = harden(works(spark, sf_dir)).select(F.floor(F.col("id") / LIST).alias("list_id"), "id", F.explode(F.array(styles.STYLES["apa"]())).alias("line"))
    rows = made.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("rows"))
    broken = lambda line, between: F.regexp_replace(line, rf"(.{{30,{WIDTH}}}) (?=.)", f"$1{between}")
    text = lambda lead, on, between: F.concat(F.lit("References\n"), F.array_join(F.transform("rows", lambda r, i: F.concat(F.replace(F.lit(lead), F.lit("#"), (i + 1).cast("string")), broken(r["line"], on))), between))
    each = F.array(*(F.struct(F.lit(name).alias("form"), text(*parts).alias("text")) for name, parts in LAYOUTS.items()))
    return rows.select("list_id", F.explode(each).alias("x")).select("list_id", "x.form", "x.text")


def split_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped lists in five layouts, each found out and cut apart."""
    return wrapped_lists(spark, sf_dir).select("list_id", "form", F.posexplode(split_references(F.col("text"))).alias("ref_no", "text"))


def layouts_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lines of each of those lists have in common."""
    lines = F.split(F.regexp_replace("text", "^References\n", ""), "\n")
    return wrapped_lists(spark, sf_dir).select("list_id", "form", layout(lines).alias("l")).select("list_id", "form", "l.numbered", "l.bulleted", "l.hanging", "l.blank")


def list_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lines of each list have in common."""
    lists = derived_lists(spark, sf_dir, "vancouver", "#. ", "\n")
    return lists.select("list_id", layout(F.split("text", "\n")).alias("l")).select("list_id", "l.numbered", "l.bulleted", "l.hanging", "l.per_line", "l.titles", "l.blank", "l.count")


def bare_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, journal and year of lines that hold a title alone."""
    made = works(spark, sf_dir).select("id", F.concat_ws(", ", "title", F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "Nature"), F.col("year").cast("string"))).alias("line"))
    return made.select("id", bare_title(F.col("line")).alias("t")).select("id", "t.title", "t.journal", "t.year")


QUERIES = {f.__name__: f for f in (split_lines, split_blank, split_numbered, split_auto, split_layouts, layouts_found, list_layout, bare_titles)}
_ROWS = lambda style: f"SELECT id // {LIST} AS list_id, (row_number() OVER (PARTITION BY id // {LIST} ORDER BY id) - 1)::INT AS ref_no, text FROM ({style})"
SQL = {
    "split_lines": _ROWS(APA),
    "split_blank": _ROWS(APA),
    "split_numbered": _ROWS(VANCOUVER),
    "split_auto": _ROWS(VANCOUVER),
    "split_layouts": f"SELECT list_id, form, ref_no, text FROM ({_ROWS(APA)}), (SELECT unnest({list(LAYOUTS)}) AS form)",
    "layouts_found": f"""SELECT list_id, form, form = 'numbered' AND n >= 2 AS numbered, form = 'bulleted' AND n >= 2 AS bulleted, form = 'hanging' AS hanging, form = 'paragraphs' AND n > 1 AS blank
FROM (SELECT list_id, count(*) AS n FROM ({_ROWS(APA)}) GROUP BY list_id), (SELECT unnest({list(LAYOUTS)}) AS form)""",
    "list_layout": f"SELECT p_partkey // {LIST} AS list_id, count(*) >= 2 AS numbered, false AS bulleted, false AS hanging, false AS per_line, false AS titles, false AS blank, count(*)::INT AS count FROM part GROUP BY 1",
    "bare_titles": """SELECT p_partkey AS id, upper(p_name[1]) || p_name[2:] || ' of the ' || lower(p_type) || ' series' AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Nature' ELSE '' END AS journal,
  CASE WHEN p_partkey % 17 <> 6 THEN (1970 + p_partkey % 55)::VARCHAR ELSE '' END AS year FROM part""",
}
