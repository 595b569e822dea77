"""Texts and records word by word: accents lent, slips named, style titles matched, cells and lines with their links."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.identifiers import doi_url
from citeweave.functions.text import fold, one_edit, tokens
from citeweave.operators.candidates import osa
from citeweave.operators.matching import TOKENS_SQL
from citeweave.tables import WORKS_SQL, load, works


def diacritic_lending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain words of the corpus that have one accented form there, and that form."""
    words = load(spark, sf_dir, "documents").select(F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("word")).filter("word is not null").distinct()
    accented = words.filter(F.col("word").rlike("[^a-z]")).select(fold(F.col("word")).alias("plain"), "word")
    single = accented.groupBy("plain").agg(F.min("word").alias("lent"), F.count("*").alias("n")).filter("n = 1").select("plain", "lent")
    return words.select(F.col("word").alias("plain")).join(single, "plain").filter("plain <> lent")


def word_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of an altered passage that the passage lacks, and the word of it that is one edit away (the least of several)."""
    made = load(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("have"))
    said = F.array_distinct(F.transform("have", lambda w: F.when(F.char_length(w) >= 6, F.regexp_replace(w, "^(.)(.)(.)", "$1$3$2")).otherwise(w)))
    odd = made.withColumn("odd", F.explode_outer(F.array_except(said, "have"))).filter("odd is not null")
    near = F.filter("have", lambda w: (F.abs(F.char_length(w) - F.char_length("odd")) <= 1) & one_edit(F.col("odd"), w))
    return odd.select("item_id", F.col("odd").alias("said"), F.array_min(near).alias("meant"))


def style_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names asked for in another order of words: the known name of the same words in order, else of the same set of words."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_name"), r"\s+").alias("words"))
    joined, as_set = lambda w: F.array_join(w, " "), lambda w: F.array_join(F.array_sort(F.array_distinct(w)), " ")
    exact = part.groupBy(joined(F.col("words")).alias("key")).agg(F.min("p_partkey").alias("exact_id"))
    loose = part.groupBy(as_set(F.col("words")).alias("set_key")).agg(F.min("p_partkey").alias("set_id"))
    asked = part.withColumn("words", F.when(F.col("p_partkey") % 2 == 0, F.col("words")).otherwise(F.reverse("words")))
    both = asked.withColumns({"key": joined(F.col("words")), "set_key": as_set(F.col("words"))}).join(exact, "key", "left").join(loose, "set_key", "left")
    return both.select("p_partkey", F.coalesce("exact_id", "set_id").alias("match_id"), F.when(F.col("exact_id").isNotNull(), "order").when(F.col("set_id").isNotNull(), "set").otherwise("none").alias("by"))


def linked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a pasted list with a link behind those that were matched."""
    made = works(spark, sf_dir).select("id", F.col("title").alias("line"), "doi")
    return made.select("id", F.when(F.col("doi").isNotNull(), F.concat("line", F.lit(" "), doi_url(F.col("doi")))).otherwise(F.col("line")).alias("line"))


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet's rows as cells with their place, and whether each is a number."""
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", F.array("s_name", F.col("s_nationkey").cast("string"), F.lit("")).alias("cells"))
    cells = rows.select(F.col("s_suppkey").alias("r"), F.posexplode("cells").alias("c", "value")).filter("value <> ''")
    return cells.withColumn("is_number", F.col("value").rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"))


#: What it costs to take one word of a text for one of the record, by kind; a word of either alone; words without likeness.
COSTS = {"same": 0, "case": 1, "accent": 1, "spelling": 2, "initial": 3, "year": 3, "number": 3}
ALONE, UNLIKE = 4, 9
_YEAR = re.compile(r"(?:1[5-9]|20)[0-9]{2}[a-z]?")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def likeness(said: str, meant: str) -> str | None:
    """The kind of difference of two words, the least that explains it; null if they are two words."""
    if said == meant:
        return "same"
    if said.lower() == meant.lower():
        return "case"
    plain = [unicodedata.normalize("NFKD", w.lower()).encode("ascii", "ignore").decode() for w in (said, meant)]
    if plain[0] and plain[0] == plain[1]:
        return "accent"
    if len(said) == len(meant) == 1 and said.isalpha() and meant.isalpha():
        return "initial"
    if _YEAR.fullmatch(said) and _YEAR.fullmatch(meant):
        return "year"
    if said.isdigit() and meant.isdigit():
        return "number"
    most = 2 if min(map(len, plain)) >= 9 else 1 if min(map(len, plain)) >= 4 else 0
    return "spelling" if most and not (said.isdigit() or meant.isdigit()) and osa(*plain, most) <= most else None


def aligned(said: list[str], meant: list[str]) -> list[tuple[str, str | None, str | None]]:
    """(kind, said, meant) of the cheapest alignment in order: pairs with their difference, words missing (of the record) or extra.

    Of alignments of one cost the one that pairs words earlier.
    """
    n, m = len(said), len(meant)
    cost = [[ALONE * (n - i + m - j) for j in range(m + 1)] for i in range(n + 1)]
    kinds = [[likeness(a, b) for b in meant] for a in said]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            pair = cost[i + 1][j + 1] + COSTS.get(kinds[i][j], UNLIKE)
            cost[i][j] = min(pair, cost[i + 1][j] + ALONE, cost[i][j + 1] + ALONE)
    i = j = 0
    out: list[tuple[str, str | None, str | None]] = []
    while i < n or j < m:
        if i < n and j < m and cost[i][j] == cost[i + 1][j + 1] + COSTS.get(kinds[i][j], UNLIKE):
            out.append((kinds[i][j] or "other", said[i], meant[j]))
            i, j = i + 1, j + 1
        elif j < m and (i == n or cost[i][j] == cost[i][j + 1] + ALONE):
            out.append(("missing", None, meant[j]))
            j += 1
        else:
            out.append(("extra", said[i], None))
            i += 1
    return out


def differences(pairs: DataFrame) -> DataFrame:
    """(id, no, kind, said, meant): what tells each text from its record's, word by word; ``pairs`` has (id, text, record).

    Words are aligned by edit costs; the kinds are case, accent, spelling, initial, year,
    number, missing and extra. Null texts have no words. The cost of an alignment is the product of
    two references' words, so texts are cut at ``LONGEST`` words, which no reference has.
    """
    id_type = pairs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "no", "kind", "said", "meant")}
            for key, text, record in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "record")), strict=True):
                found = aligned(_WORD.findall(text or "")[:LONGEST], _WORD.findall(record or "")[:LONGEST])
                for no, (kind, said, meant) in enumerate(d for d in found if d[0] != "same"):
                    for name, value in zip(out, (key, no, kind, said, meant), strict=True):
                        out[name].append(value)
            types = (batch.schema.field("id").type, pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return pairs.select("id", "text", "record").mapInArrow(run, f"id {id_type}, no int, kind string, said string, meant string")


LONGEST = 2_000


def text_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of works with a fault each, by turns, against their records: another year, a slip, another initial, a word left out, accents."""
    made = works(spark, sf_dir).filter("year is not null and size(authors) > 0")
    family, key = F.get("authors", F.lit(0))["family"], F.col("id") % 5
    year = F.col("year").cast("string")
    line = lambda name, initial, when, title: F.concat(name, F.lit(", "), initial, F.lit(". ("), when, F.lit("). "), title)
    slip, short = F.regexp_replace("title", "^(.)(.)(.)(.)", "$1$3$2$4"), F.replace("title", F.lit(" of the"), F.lit(" of"))
    text = line(F.when(key == 4, F.translate(family, "aou", "áöü")).otherwise(family), F.when(key == 2, "Z").otherwise("A"), F.when(key == 0, F.col("year") + 1).otherwise(year), F.when(key == 1, slip).when(key == 3, short).otherwise(F.col("title")))
    return differences(made.select("id", text.alias("text"), line(family, F.lit("A"), year, F.col("title")).alias("record")))


QUERIES = {f.__name__: f for f in (diacritic_lending, word_slips, style_titles, linked_lines, sheet_cells, text_differences)}
_FOLDED = "replace(replace(replace(replace(replace(replace(strip_accents(word), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'ł', 'l'), 'đ', 'd')"
SQL = {
    "text_differences": f"""WITH {WORKS_SQL}, w AS (SELECT id, year, title, string_split(title, ' ')[1] AS word, authors[1].family AS family FROM works WHERE year IS NOT NULL AND len(authors) > 0),
d AS (
  SELECT id, 0 AS no, 'year' AS kind, (year + 1)::VARCHAR AS said, year::VARCHAR AS meant FROM w WHERE id % 5 = 0
  UNION ALL SELECT id, 0, 'spelling', word[1] || word[3] || word[2] || word[4:], word FROM w WHERE id % 5 = 1 AND word[2] <> word[3] AND len(word) >= 4
  -- Shorter words are two words: the record's is missing, the text's is extra.
  UNION ALL SELECT id, unnest([0, 1]), unnest(['missing', 'extra']), unnest([NULL, word[1] || word[3] || word[2]]), unnest([word, NULL]) FROM w WHERE id % 5 = 1 AND word[2] <> word[3] AND len(word) = 3
  UNION ALL SELECT id, 0, 'initial', 'Z', 'A' FROM w WHERE id % 5 = 2
  UNION ALL SELECT id, 0, 'missing', NULL, 'the' FROM w WHERE id % 5 = 3
  UNION ALL SELECT id, 0, 'accent', translate(family, 'aou', 'áöü'), family FROM w WHERE id % 5 = 4 AND family <> translate(family, 'aou', 'áöü'))
SELECT id, no, kind, said, meant FROM d""",
    "diacritic_lending": f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}{{3,}}')) AS word FROM documents),
a AS (SELECT {_FOLDED} AS plain, min(word) AS lent FROM w WHERE regexp_matches(word, '[^a-z]') GROUP BY 1 HAVING count(*) = 1) SELECT plain, lent FROM a WHERE plain <> lent AND plain IN (SELECT word FROM w)""",
    "word_slips": f"""WITH h AS (SELECT item_id, list_distinct({TOKENS_SQL}) AS have FROM benchmark),
s AS (SELECT item_id, have, unnest(list_distinct(list_transform(have, lambda w: CASE WHEN len(w) >= 6 THEN w[1] || w[3] || w[2] || w[4:] ELSE w END))) AS said FROM h)
SELECT item_id, said, list_min(list_filter(have, lambda w: damerau_levenshtein(said, w) <= 1)) AS meant FROM s WHERE NOT list_contains(have, said)""",
    "style_titles": """WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part), q AS (SELECT p_partkey, array_to_string(w, ' ') AS key, array_to_string(list_sort(list_distinct(w)), ' ') AS sk, array_to_string(list_reverse(w), ' ') AS rk FROM p),
e AS (SELECT key AS k, min(p_partkey) AS exact_id FROM q GROUP BY 1), l AS (SELECT sk AS k, min(p_partkey) AS set_id FROM q GROUP BY 1)
SELECT p_partkey, coalesce(exact_id, set_id) AS match_id, CASE WHEN exact_id IS NOT NULL THEN 'order' WHEN set_id IS NOT NULL THEN 'set' ELSE 'none' END AS "by"
FROM q LEFT JOIN e ON e.k = CASE WHEN p_partkey % 2 = 0 THEN key ELSE rk END LEFT JOIN l ON l.k = sk""",
    "linked_lines": f"WITH {WORKS_SQL} SELECT id, CASE WHEN doi IS NOT NULL THEN title || ' https://doi.org/' || doi ELSE title END AS line FROM works",
    "sheet_cells": "SELECT s_suppkey AS r, 0 AS c, s_name AS value, false AS is_number FROM supplier UNION ALL SELECT s_suppkey, 1, s_nationkey::VARCHAR, true FROM supplier",
}
