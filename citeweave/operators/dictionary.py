"""The casing dictionary, built from the corpus: evidence, candidates, admission, rank, coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeweave.operators.lists import SQL as LISTS_SQL
from citeweave.operators.lists import case_evidence
from citeweave.operators.ranking import rank_within
from citeweave.tables import load

#: Endings of Latin names of plants and animals, which are no common words (fixed values).
TAXON = "(?:idae|inae|aceae|ensis|oides)$"
BUDGET = 60_000


def stems(word: Column) -> Column:
    """What a word may be an ending of: -s, -es, -ies, -ing, -ed, -ly, and a doubled or lost letter."""
    end = lambda suffix, by="": F.when(word.endswith(suffix) & (F.char_length(word) > len(suffix) + 2), F.concat(F.left(word, F.char_length(word) - len(suffix)), F.lit(by)))
    made = F.array(end("s"), end("es"), end("ies", "y"), end("ing"), end("ing", "e"), end("ed"), end("ed", "e"), end("ly"), end("ily", "y"))
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull()))


def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common words of the corpus that are endings of other common words there."""
    common = case_evidence(spark, sf_dir).filter("label = 'common'").select("word")
    each = common.select("word", F.explode(stems(F.col("word"))).alias("stem"))
    return each.join(common.select(F.col("word").alias("stem")), "stem", "left_semi").groupBy("word").agg(F.array_join(F.array_sort(F.collect_list("stem")), ",").alias("stems"))


def admitted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the dictionary and why each was turned away, by ordered rules.

    Candidates are the corpus's common and open words and those of parts; a name there, a
    taxon's ending, an ending of an admitted word, or a word without small forms is left out.
    """
    seen = case_evidence(spark, sf_dir)
    parts = load(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), "[^a-z]+")).alias("word")).filter("length(word) >= 3")
    pool = seen.filter("label <> 'proper'").select("word").unionByName(parts).distinct()
    nations = load(spark, sf_dir, "nation").select(F.explode(F.split(F.lower("n_name"), "[^a-z]+")).alias("word")).withColumn("is_name", F.lit(True)).distinct()
    stem = pool.select("word", F.explode(stems(F.col("word"))).alias("stem")).join(seen.filter("label = 'common'").select(F.col("word").alias("stem")), "stem", "left_semi")
    joined = pool.join(seen, "word", "left").join(nations, "word", "left").join(stem.select("word", F.lit(True).alias("derived")).distinct(), "word", "left")
    why = (
        F.when(F.col("is_name"), "name").when(F.col("word").rlike(TAXON), "taxon").when(F.col("derived"), "derived").when(F.coalesce("low", F.lit(1)) == 0, "never small").otherwise("admitted")
    )
    return joined.select("word", why.alias("why"))


def ranked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted words in order of tier and evidence, as many as ``BUDGET`` bytes hold, one byte a separator.

    The rank comes from pre-summed bytes of each (tier, evidence) and beginning of words, so no
    task orders all words, nor those seen once, which are most.
    """
    seen = case_evidence(spark, sf_dir).select("word", "label", "low")
    kept = admitted_words(spark, sf_dir).filter("why = 'admitted'").join(seen, "word", "left")
    tier = F.when(F.col("label") == "common", 0).when(F.col("label").isNotNull(), 1).otherwise(2)
    rows = kept.select("word", tier.alias("tier"), F.coalesce("low", F.lit(0)).cast("long").alias("evidence"), (F.octet_length("word") + 1).alias("size"))
    sums = rows.groupBy("tier", "evidence").agg(F.sum("size").alias("held"))
    before = Window.orderBy("tier", F.desc("evidence")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("tier", "evidence", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = rank_within(rows, ["tier", "evidence"], F.left("word", F.lit(3)), ["word"], weight=F.col("size"), name="inside")
    return inside.join(starts, ["tier", "evidence"]).select("word", "tier", "evidence", (F.col("start") + F.col("inside")).alias("end_byte")).filter(F.col("end_byte") <= BUDGET)


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two words share."""
    n = F.least(F.char_length(a), F.char_length(b))
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (F.left(a, i) == F.left(b, i)) & (i <= n)))


def front_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in order, each as the number of characters it shares with the one before and the rest.

    The word before stands in the same two-letter group, but for a group's first, which
    follows the last word of the group before; groups are few, so only they meet in one task.
    """
    words = case_evidence(spark, sf_dir).select("word", F.left("word", F.lit(2)).alias("lead"))
    inside = words.withColumn("previous", F.lag("word").over(Window.partitionBy("lead").orderBy("word")))
    ends = words.groupBy("lead").agg(F.max("word").alias("last")).select("lead", F.lag("last").over(Window.orderBy("lead")).alias("before"))
    both = inside.join(ends, "lead").withColumn("previous", F.coalesce("previous", "before", F.lit("")))
    shared = shared_prefix(F.col("word"), F.col("previous"))
    return both.select("word", shared.alias("shared"), F.substring("word", shared + 1, F.char_length("word")).alias("rest"))


QUERIES = {f.__name__: f for f in (word_stems, admitted_words, ranked_words, front_code)}
_END = lambda suffix, by="": f"CASE WHEN ends_with(word, '{suffix}') AND len(word) > {len(suffix) + 2} THEN word[:-{len(suffix) + 1}] || '{by}' END"
_STEMS = f"list_distinct(list_filter([{', '.join(_END(*p) for p in (('s',), ('es',), ('ies', 'y'), ('ing',), ('ing', 'e'), ('ed',), ('ed', 'e'), ('ly',), ('ily', 'y')))}], lambda x: x IS NOT NULL))"
_ADMITTED = f"""WITH seen AS ({LISTS_SQL["case_evidence"]}), pool AS (SELECT word FROM seen WHERE label <> 'proper' UNION SELECT unnest(string_split_regex(lower(p_name), '[^a-z]+')) FROM part),
p AS (SELECT DISTINCT word FROM pool WHERE len(word) >= 3), n AS (SELECT DISTINCT unnest(string_split_regex(lower(n_name), '[^a-z]+')) AS word FROM nation),
d AS (SELECT DISTINCT word FROM (SELECT word, unnest({_STEMS}) AS stem FROM p) WHERE stem IN (SELECT word FROM seen WHERE label = 'common')),
a AS (SELECT p.word, CASE WHEN p.word IN (SELECT word FROM n) THEN 'name' WHEN regexp_matches(p.word, '{TAXON}') THEN 'taxon' WHEN p.word IN (SELECT word FROM d) THEN 'derived' WHEN seen.low = 0 THEN 'never small'
  ELSE 'admitted' END AS why, label, coalesce(low, 0) AS low FROM p LEFT JOIN seen USING (word))"""
SQL = {
    "word_stems": f"""WITH c AS (SELECT word FROM ({LISTS_SQL["case_evidence"]}) WHERE label = 'common')
SELECT word, string_agg(stem, ',' ORDER BY stem) AS stems FROM (SELECT word, unnest({_STEMS}) AS stem FROM c) WHERE stem IN (SELECT word FROM c) GROUP BY word""",
    "admitted_words": f"{_ADMITTED} SELECT word, why FROM a",
    "ranked_words": f"""{_ADMITTED}, r AS (SELECT word, CASE WHEN label = 'common' THEN 0 WHEN label IS NOT NULL THEN 1 ELSE 2 END::INT AS tier, low::BIGINT AS evidence FROM a WHERE why = 'admitted')
SELECT * FROM (SELECT word, tier, evidence, sum(strlen(word) + 1) OVER (ORDER BY tier, evidence DESC, word ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS end_byte FROM r) WHERE end_byte <= {BUDGET}""",
    "front_code": f"""WITH w AS (SELECT word, coalesce(lag(word) OVER (ORDER BY word), '') AS previous FROM ({LISTS_SQL["case_evidence"]})),
s AS (SELECT word, len(list_filter(range(1, least(len(word), len(previous)) + 1), lambda i: word[:i] = previous[:i]))::INT AS shared FROM w) SELECT word, shared, word[shared + 1:] AS rest FROM s""",
}
