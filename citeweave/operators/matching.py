"""Linking texts to candidates: shared tokens, grades, runner-up, hysteresis and fallback tiers.

Candidates come from an equi-join on all tokens, and scores from the number of tokens
shared, so no pair with a common token is lost and no text is compared in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeweave.functions.bibliographic import grade
from citeweave.functions.text import tokens
from citeweave.tables import load

MARGIN, NEAR, LEAST = 0.05, 0.15, 0.5


def scored_pairs(texts: DataFrame, candidates: DataFrame, beginnings: int = 0) -> DataFrame:
    """(doc_id, item_id, score) of all texts and candidates that share a token: shared tokens are counted over an equi-join.

    ``beginnings`` compares the first letters of tokens alone.
    """
    words = tokens(F.col("text"))
    words = F.array_distinct(F.transform(words, lambda w: F.left(w, F.lit(beginnings))) if beginnings else words)
    # Outer, as Spark would compute the words again for the filter that it puts before an inner explode.
    docs = texts.select("doc_id", F.explode_outer(words).alias("token")).filter("token is not null")
    items = candidates.select("item_id", words.alias("want"))
    each = items.select("item_id", F.size("want").alias("wanted"), F.explode_outer("want").alias("token")).filter("token is not null")
    shared = docs.join(each, "token").groupBy("doc_id", "item_id", "wanted").agg(F.count("*").alias("shared"))
    return shared.select("doc_id", "item_id", (F.col("shared") / F.col("wanted")).alias("score"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def best_of(pairs: DataFrame) -> DataFrame:
    """The best candidate of each text; ties go to the smallest id. A pre-aggregated maximum."""
    top = pairs.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("item_id")).alias("less"))).alias("top"))
    return top.select("doc_id", (-F.col("top.less")).alias("item_id"), F.col("top.score").alias("score"), grade(F.col("top.score")).alias("grade"))


def match_best_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_of(_pairs(spark, sf_dir))


def match_grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_of(_pairs(spark, sf_dir))
    graded = load(spark, sf_dir, "documents").select("doc_id").join(best, "doc_id", "left").select(F.coalesce("grade", F.lit("none")).alias("grade"))
    return graded.groupBy("grade").agg(F.count("*").alias("n"))


def match_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best other candidate of at least LEAST within NEAR of the best."""
    ranked = _pairs(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "item_id")))
    first = ranked.filter("rank = 1").select("doc_id", F.col("item_id").alias("best_id"), F.col("score").alias("best_score"))
    second = ranked.filter("rank = 2").select("doc_id", F.col("item_id").alias("alt_id"), F.col("score").alias("alt_score"))
    return first.join(second, "doc_id").filter((F.col("alt_score") >= LEAST) & (F.col("best_score") - F.col("alt_score") <= NEAR))


def match_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in order of id; one replaces the best only if it beats it by more than MARGIN."""
    seen = _pairs(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "score"))).alias("seen"))
    start = F.struct(F.lit(-1).cast("long").alias("item_id"), F.lit(-1.0).alias("score"))
    best = F.aggregate("seen", start, lambda a, x: F.when(x["score"] > a["score"] + MARGIN, x).otherwise(a))
    return seen.select("doc_id", best.alias("best")).select("doc_id", "best.item_id", "best.score")


def match_tier_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches over all passages: by whole words, then, for texts below 0.8 there, by their first five letters too.

    The second tier's score replaces the first's only if it is higher; an equal one keeps the first.
    """
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    one = scored_pairs(docs, items).withColumn("tier", F.lit(1))
    settled = one.filter("score >= 0.8").select("doc_id").distinct()
    two = scored_pairs(docs.join(settled, "doc_id", "left_anti"), items, beginnings=5).withColumn("tier", F.lit(2))
    top = one.unionByName(two).groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("tier")).alias("t"), (-F.col("item_id")).alias("i"))).alias("top"))
    return top.select("doc_id", (-F.col("top.i")).alias("item_id"), F.col("top.score").alias("score"), (-F.col("top.t")).alias("tier"))


def match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades by language: conditional sums."""
    best = load(spark, sf_dir, "documents").select("doc_id", "lang").join(best_of(_pairs(spark, sf_dir)), "doc_id", "left")
    return best.groupBy("lang").agg(F.count_if(F.col("grade") == "good").alias("good"), F.count_if(F.col("grade") == "check").alias("to_check"), F.count("*").alias("n"), F.max(F.coalesce("score", F.lit(0.0))).alias("best"))


def token_profile_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = load(spark, sf_dir, "documents").select("lang", F.explode(tokens(F.col("text"))).alias("token"))
    return each.groupBy("lang", "token").agg(F.count("*").alias("c")).groupBy("lang").agg(F.sum("c").alias("tokens"), F.count("*").alias("distinct_tokens"))


def word_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the best passage that the text lacks, and the other way round."""
    best = match_best_passage(spark, sf_dir).select("doc_id", "item_id")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("have"))
    items = load(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("want"))
    both = best.join(items, "item_id").join(docs, "doc_id")
    return both.select("doc_id", "item_id", F.size(F.array_except("want", "have")).cast("long").alias("missing"), F.size(F.array_except("have", "want")).cast("long").alias("unexplained"))


QUERIES = {f.__name__: f for f in (match_best_passage, match_grade_counts, match_runner_up, match_hysteresis, match_tier_fallback, match_metrics, token_profile_by_lang, word_set_difference)}

_FOLD = "replace(replace(replace(replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th')"
TOKENS_SQL = f"list_filter(regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}]+'), lambda w: len(w) >= 3)"


def _pair_sql(name: str, docs: str, items: str) -> str:
    return f"""{name}_d AS (SELECT doc_id, list_distinct({TOKENS_SQL}) AS have FROM {docs}),
{name}_i AS (SELECT item_id, list_distinct({TOKENS_SQL}) AS want FROM {items}),
{name} AS (SELECT doc_id, item_id, count(*) / any_value(wanted)::DOUBLE AS score FROM (SELECT doc_id, unnest(have) AS token FROM {name}_d)
  JOIN (SELECT item_id, len(want) AS wanted, unnest(want) AS token FROM {name}_i) USING (token) GROUP BY doc_id, item_id)"""


_PAIRS = f"WITH {_pair_sql('pairs', 'documents', 'benchmark')}"
_BEST = f"""{_PAIRS}, best AS (SELECT doc_id, item_id, score, CASE WHEN score >= 0.8 THEN 'good' WHEN score >= 0.5 THEN 'check' ELSE 'weak' END AS grade
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM pairs) WHERE r = 1)"""
SQL = {
    "match_best_passage": f"{_BEST} SELECT * FROM best",
    "match_grade_counts": f"{_BEST} SELECT coalesce(grade, 'none') AS grade, count(*) AS n FROM documents LEFT JOIN best USING (doc_id) GROUP BY 1",
    "match_runner_up": f"""{_PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM pairs)
SELECT a.doc_id, a.item_id AS best_id, a.score AS best_score, b.item_id AS alt_id, b.score AS alt_score FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND a.r = 1 AND b.r = 2
WHERE b.score >= {LEAST} AND a.score - b.score <= {NEAR}""",
    "match_hysteresis": f"""{_PAIRS}, seen AS (SELECT doc_id, list({{'item_id': item_id, 'score': score}} ORDER BY item_id) AS seen FROM pairs GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(list_prepend({{'item_id': (-1)::BIGINT, 'score': (-1.0)::DOUBLE}}, seen), lambda a, x: CASE WHEN x.score > a.score + {MARGIN} THEN x ELSE a END) AS best FROM seen)
SELECT doc_id, best.item_id AS item_id, best.score AS score FROM folded""",
    "match_tier_fallback": f"""WITH {_pair_sql('one', 'documents', 'benchmark')},
two AS (SELECT doc_id, item_id, count(*) / any_value(wanted)::DOUBLE AS score FROM (SELECT doc_id, unnest(list_distinct(list_transform(have, lambda w: w[:5]))) AS token FROM one_d
    WHERE doc_id NOT IN (SELECT doc_id FROM one WHERE score >= 0.8))
  JOIN (SELECT item_id, len(want) AS wanted, unnest(want) AS token FROM (SELECT item_id, list_distinct(list_transform(want, lambda w: w[:5])) AS want FROM one_i)) USING (token) GROUP BY doc_id, item_id),
every AS (SELECT *, 1 AS tier FROM one UNION ALL SELECT *, 2 FROM two)
SELECT doc_id, item_id, score, tier FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tier, item_id) AS r FROM every) WHERE r = 1""",
    "match_metrics": f"""{_BEST} SELECT lang, count(*) FILTER (grade = 'good') AS good, count(*) FILTER (grade = 'check') AS to_check, count(*) AS n, max(coalesce(score, 0.0)) AS best
FROM documents LEFT JOIN best USING (doc_id) GROUP BY lang""",
    "token_profile_by_lang": f"SELECT lang, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM (SELECT lang, unnest({TOKENS_SQL}) AS token FROM documents) GROUP BY lang",
    "word_set_difference": f"""{_BEST} SELECT doc_id, item_id, len(list_filter(want, lambda w: NOT list_contains(have, w))) AS missing, len(list_filter(have, lambda w: NOT list_contains(want, w))) AS unexplained
FROM best JOIN pairs_d USING (doc_id) JOIN pairs_i USING (item_id)""",
}
