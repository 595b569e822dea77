"""Queries over rendered works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.bibliographic import joined
from citeweave.operators.lists import letters
from citeweave.operators.ranking import rank_within
from citeweave.plans import styles
from citeweave.plans.sql import SQL
from citeweave.records import harden
from citeweave.tables import works

__all__ = ["QUERIES", "SQL"]


def _render(form: str):
    return lambda spark, sf_dir: styles.render(works(spark, sf_dir), form)


QUERIES = {f"style_{name}": _render(name) for name in styles.STYLES} | {f"export_{name}": _render(name) for name in styles.EXPORTS}


def lettered(works: DataFrame) -> DataFrame:
    """Hardened works whose year carries the letter that tells works of one first name and year apart."""
    known = letters(works).filter("letter <> ''")
    joint = harden(works).join(known, "id", "left")
    return joint.withColumn("year", F.concat("year", F.coalesce("letter", F.lit("")))).drop("letter")


def in_text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in a sentence in every style, with year letters in the author-date styles."""
    rows = lettered(works(spark, sf_dir))
    forms = {"apa": styles.in_text("apa"), "apa_narrative": styles.in_text("apa", "narrative"), "harvard": styles.in_text("harvard", pages="5-6"), "carnegie": styles.in_text("carnegie", pages="5-6")}
    plain = harden(works(spark, sf_dir)).select("id", styles.in_text("mla", pages="5").alias("mla"), styles.in_text("ieee", pages="5").alias("ieee"), styles.in_text("chicago", "short").alias("chicago_short"))
    return rows.select("id", *[c.alias(n) for n, c in forms.items()]).join(plain, "id")


def style_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APA as HTML: text escaped, titles in italics."""
    return styles.render(works(spark, sf_dir), "apa", html=True).select("id", F.col("text").alias("html"))


def style_apa_lettered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APA references with the letters that tell works of one name and year apart."""
    return lettered(works(spark, sf_dir)).select("id", styles.apa().alias("text"))


def all_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every work in every style: one pass over the works, a row a style."""
    made = harden(works(spark, sf_dir))
    each = F.array(*[F.struct(F.lit(name).alias("style"), make().alias("text")) for name, make in styles.STYLES.items()])
    return made.select("id", F.explode(each).alias("made")).select("id", "made.style", "made.text")


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSL JSON of each work: fields in a fixed order, those that a record lacks left out."""
    made = harden(works(spark, sf_dir))
    some = lambda name: F.nullif(F.col(name), F.lit(""))
    people = lambda name: F.when(F.size(name) > 0, F.transform(name, lambda a: F.struct(F.when(~a["literal"], a["family"]).alias("family"), F.when(~a["literal"], a["given"]).alias("given"), F.when(a["literal"], a["family"]).alias("literal"))))
    issued = F.when(F.col("year") != "", F.struct(F.array(F.array(F.col("year").cast("int"))).alias("date-parts")))
    fields = [F.col("type"), some("title").alias("title"), people("authors").alias("author"), people("editors").alias("editor"), some("container").alias("container-title"), issued.alias("issued")]
    fields += [some("volume").alias("volume"), some("issue").alias("issue"), some("pages").alias("page"), some("publisher").alias("publisher"), some("doi").alias("DOI")]
    return made.select("id", F.to_json(F.struct(*fields)).alias("json"))


def list_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered list lines: numbers count a publisher's works that have a title and a DOI, in order of id; others get none."""
    made = harden(works(spark, sf_dir)).select("publisher", "id", (F.col("doi") != "").alias("good"), styles.vancouver().alias("text"))
    ranked = rank_within(made, ["publisher"], F.floor(F.col("id") / 4096), ["id"], weight=F.col("good"))
    return ranked.select("publisher", "id", joined(". ", F.when(F.col("good"), F.col("place").cast("string")).otherwise(""), F.col("text")).alias("line"))


def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One BibTeX file a publisher: entries in order of id, a blank line between; matched and missed works counted."""
    made = harden(works(spark, sf_dir)).select("publisher", "id", (F.col("doi") != "").alias("good"), styles.bibtex().alias("text"))
    entries = F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("id", "text"))))
    grouped = made.groupBy("publisher").agg(entries.alias("entries"), F.count_if("good").alias("matched"), F.count_if(~F.col("good")).alias("missed"))
    return grouped.select("publisher", "matched", "missed", F.sha2(F.array_join(F.transform("entries", lambda e: e["text"]), "\n\n"), 256).alias("content_sha256"))


QUERIES |= {f.__name__: f for f in (in_text_forms, style_html, style_apa_lettered, all_styles, export_json, list_frame, export_files)}
