"""Spans of texts: phrases of a list, entries of a reference list, runs of citations, and spans that don't overlap.

Offsets count code points from 0, ends are exclusive. Null texts have no spans; repeated rows
of a text give their spans once a key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import let
from citeweave.functions.text import fold, fold_map
from citeweave.plans import styles
from citeweave.plans.sql import SQL as RENDERED
from citeweave.records import harden
from citeweave.tables import WORKS_SQL, load, works

#: The longest phrase, in words.
WORDS = 8
#: Rows of a level of the trie that is broadcast, at most.
SMALL = 100_000
#: Folded characters by which an entry is looked for, first and if that fails; shorter entries are not.
FIRST, LESS, SHORT = 40, 20, 8
YEAR = r"(?:1[5-9]|20)[0-9]{2}"
#: Name particles and words before a year that are no names (fixed values).
PARTICLES = "van|von|de|del|della|der|den|du|da|di|dos|la|le|ter|ten"
NOT_NAMES = (
    "see also in and the table tables fig figs figure figures eq eqs equation section chapter appendix supplementary january february march april may june july august september october november december spring summer autumn winter"
).split()


def disjoint(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of ``spans`` (key, start, end, ...) those that don't overlap: from the left, the longest of those that start together.

    Sorted spans are read as a stream that holds where the last one taken ends. Of wholly equal
    ranges the first by the other columns stays; empty spans are dropped.
    """
    others = [c for c in spans.columns if c not in (key, "start", "end")]
    ordered = spans.filter("end > start").repartition(key).sortWithinPartitions(key, "start", F.desc("end"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, upto = None, -1
        for batch in batches:
            taken = []
            for k, start, end in zip(*(batch.column(c).to_pylist() for c in (key, "start", "end")), strict=True):
                if last is None or k != last[0]:
                    last, upto = (k,), -1
                taken.append(start >= upto)
                upto = end if taken[-1] else upto
            yield batch.filter(pa.array(taken, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema)


def placed_words(texts: DataFrame, ahead: int = 1) -> DataFrame:
    """(doc_id, at, word_1, end_1, ...): small words of each text, where they stand, each with those behind it, ``ahead`` in all.

    Arrow batches; a text's words are found in one pass, so long texts cost in proportion.
    """
    pattern = re.compile(r"[^\W_]+")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "at", *(f"{x}_{k}" for k in range(1, ahead + 1) for x in ("word", "end"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").to_pylist(), strict=True):
                found = [(m.start(), m.end(), m[0].lower()) for m in pattern.finditer(text or "")]
                if found:
                    at, end, word = zip(*found, strict=True)
                    n = len(found)
                    behind = [pa.array(x[k:] + (None,) * min(k, n), kind) for k in range(ahead) for x, kind in ((word, pa.string()), (end, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * n, batch.schema.field("doc_id").type), pa.array(at, pa.int32()), *behind], names)

    each = ", ".join(f"word_{k} string, end_{k} int" for k in range(1, ahead + 1))
    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, at int, {each}")


def phrase_spans(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, start, end, phrase): phrases in texts, the longest of those that start together, none over another.

    Phrases (small words parted by single blanks, ``WORDS`` at most) are a trie as a table: one
    row for each beginning, and whether a phrase ends there. A word goes with those behind it, so
    that texts are read once; those that start a phrase meet the trie level by level. Levels of up
    to ``SMALL`` rows are broadcast: then no word is written to disk that starts no phrase.
    """
    split = phrases.select(F.split("phrase", " ").alias("words")).filter(F.size("words").between(1, WORDS)).distinct()
    beginnings = split.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.struct(F.array_join(F.slice("words", 1, n), " ").alias("path"), n.alias("level"), (n == F.size("words")).alias("ends")))).alias("x"))
    trie = beginnings.select("x.path", "x.level", "x.ends").groupBy("path", "level").agg(F.bool_or("ends").alias("ends"))
    sizes = {r["level"]: r["count"] for r in trie.groupBy("level").count().collect()}  # WORDS rows at most
    deepest = max(sizes, default=1)
    open_ = placed_words(texts, deepest).withColumn("path", F.col("word_1"))
    best = F.struct(F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("phrase"))
    for k in range(1, deepest + 1):
        level = trie.filter(F.col("level") == k).select(F.col("path").alias("key"), "ends")
        # A path that has ended meets no beginning, wherever it is dealt to.
        keyed = open_.withColumn("key", F.coalesce("path", F.concat(F.lit("\0"), F.col("at").cast("string"))))
        met = keyed.join(F.broadcast(level) if sizes.get(k, 0) <= SMALL else level, "key", "inner" if k == 1 else "left")
        here = F.col("path").isNotNull() & F.col("ends").isNotNull()
        longest = F.when(here & F.col("ends"), F.struct(F.col(f"end_{k}").alias("end"), F.col("path").alias("phrase"))).otherwise(F.col("best") if k > 1 else best)
        after = F.when(here, F.concat("path", F.lit(" "), f"word_{k + 1}")) if k < deepest else F.lit(None).cast("string")
        open_ = met.withColumns({"best": longest, "path": after}).drop("key", "ends", f"word_{k}", f"end_{k}")
    found = open_.filter("best.end is not null").select("doc_id", F.col("at").alias("start"), "best.end", "best.phrase")
    return disjoint(found.distinct())


def entry_places(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, entry_no, start, end): where the entries of each text's list stand in it, in order; those not found are left out.

    Texts are compared by folded letters and digits. An entry is looked for behind the one
    before (all of it that is sure: the whole, if all its letters stand there, else ``LESS`` of
    them), by its first ``FIRST`` characters, then by ``LESS``; it ends where its letters run out
    or the next one starts, with the marks behind it. ``entries`` has (doc, entry_no, entry).
    """
    lists = entries.select("doc", "entry_no", fold_map(F.coalesce("entry", F.lit("")))["folded"].alias("key"))
    lists = lists.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("entry_no", "key"))).alias("entries"))
    both = texts.select("doc", F.col("text").alias("text"), F.explode(F.array(fold_map(F.coalesce("text", F.lit(""))))).alias("map")).join(lists, "doc")

    def step(acc: Column, e: Column) -> Column:
        n = F.char_length(e["key"])
        first = F.call_function("locate", F.left(e["key"], F.lit(FIRST)), F.col("map.folded"), acc["from"])
        second = F.when(n > 30, F.call_function("locate", F.left(e["key"], F.lit(LESS)), F.col("map.folded"), acc["from"])).otherwise(0)

        def placed(at: Column) -> Column:
            here = F.struct(e["entry_no"].alias("entry_no"), at.alias("at"), n.alias("n"))
            sure = F.when(F.substring(F.col("map.folded"), at, n) == e["key"], n).otherwise(F.least(F.lit(LESS), n))
            return F.struct(F.when(at > 0, at + sure).otherwise(acc["from"]).alias("from"), F.when(at > 0, F.concat(acc["found"], F.array(here))).otherwise(acc["found"]).alias("found"))

        return let(F.when(n < SHORT, 0).when(first > 0, first).otherwise(second), placed)

    kind = f"array<struct<entry_no:{entries.schema['entry_no'].dataType.simpleString()},at:int,n:int>>"
    start = F.struct(F.lit(1).alias("from"), F.array().cast(kind).alias("found"))
    rows = both.withColumn("found", F.aggregate("entries", start, step)["found"])
    rows = rows.select("doc", "text", "map", F.explode(F.transform("found", lambda f, i: F.struct(f["entry_no"].alias("entry_no"), f["at"].alias("at"), f["n"].alias("n"), F.get("found", i + 1)["at"].alias("next")))).alias("f"))
    place = lambda k: F.get("map.at", k - 1)
    last = F.greatest(F.col("f.at"), F.least(F.col("f.at") + F.col("f.n"), F.coalesce("f.next", F.char_length("map.folded") + 1)) - 1)
    rows = rows.select("doc", "f.entry_no", "text", place(F.col("f.at")).alias("start"), (place(last) + 1).alias("end"), F.coalesce(place(F.col("f.next")), F.char_length("text")).alias("stop"))
    tail = F.regexp_extract(F.substring("text", F.col("end") + 1, F.least(F.lit(3), F.col("stop") - F.col("end"))), "^[.,;:)\\]”'\"]*", 0)
    return rows.select("doc", "entry_no", "start", (F.col("end") + F.char_length(tail)).alias("end"))


_SURNAME = rf"(?:\b(?i:{PARTICLES})\s+)*\p{{Lu}}[\p{{L}}\p{{N}}'’\-]+"
_HEAD = rf"{_SURNAME}(?:\s*,\s*{_SURNAME})*(?:,?\s+(?:and|&)\s+{_SURNAME})?(?:\s+et\s+al\.?)?(?:['’]s)?"
_DATE = rf"(?:\b{YEAR}[a-z]?\b|\bn\.\s?d\.|\b(?i:in press|forthcoming)\b)"
_PLACE = rf"(?:\s*:\s*|,\s*(?:pp?|ch|fig|table|sec)\.?\s*)(?!{YEAR}[a-z]?\b)[0-9]+[a-z]?(?:\s*[–-]\s*[0-9]+)?(?:,\s*(?!{YEAR}[a-z]?\b)[0-9]+(?:\s*[–-]\s*[0-9]+)?)*"
_RUN = rf"{_HEAD}[\s,(\[]*{_DATE}(?:{_PLACE})?(?:[\s,]{{1,4}}{_DATE}(?:{_PLACE})?)*"


def citation_runs(texts: DataFrame) -> DataFrame:
    """(doc, run_no, at_no, names, second, etal, year, suffix, locator): citations by name and year, each year of a run by itself.

    "Smith 2019, 2020a: 5" are two years of one name: the name is carried on, the locator (pages,
    chapter, figure) belongs to the year before it. ``names`` are the folded surnames before
    the year in order, as the first may be another word ("in Russia, Smith (2019)"); ``second``
    is the last of two names. A year not given is "nd", one to come "inpress".
    """
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_RUN), F.lit(0))
    rows = texts.select("doc", F.posexplode(runs).alias("run_no", "run"))
    head = F.regexp_extract("run", rf"^({_HEAD})", 1)
    etal = head.rlike(r"et\s+al\.?")
    bare = F.regexp_replace(F.regexp_replace(head, r"['’]s$", ""), r"\s+et\s+al\.?$", "")
    named = F.filter(F.transform(F.split(bare, r"\s*,\s*(?:(?:and|&)\s+)?|\s+(?:and|&)\s+"), lambda n: F.regexp_replace(fold(n), r"[^\p{L}\p{N}]", "")), lambda n: (n != "") & ~n.isin(*NOT_NAMES))
    dates = F.regexp_extract_all(F.substring("run", F.char_length(head) + 1, 10_000), F.lit(rf"{_DATE}(?:{_PLACE})?"), F.lit(0))
    each = rows.select("doc", "run_no", named.alias("names"), etal.alias("etal"), F.posexplode(dates).alias("at_no", "said"))
    year = F.when(F.col("said").rlike(r"^n\."), "nd").when(F.col("said").rlike("^(?i:in press|forthcoming)"), "inpress").otherwise(F.left("said", F.lit(4)))
    suffix = F.regexp_extract("said", rf"^{YEAR}([a-z])\b", 1)
    locator = F.regexp_replace(F.regexp_extract("said", rf"^{_DATE}({_PLACE})$", 1), r"^\s*[:,]\s*", "")
    second = F.when(~F.col("etal") & (F.size("names") == 2), F.get("names", F.lit(1))).otherwise("")
    return each.filter(F.size("names") > 0).select("doc", "run_no", "at_no", "names", second.alias("second"), "etal", year.alias("year"), suffix.alias("suffix"), locator.alias("locator"))


def link_runs(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, run_no, at_no, entry_no): the entries that each year of a run means.

    By year, letter (if one is cited) and first surname; an entry answers to its first author's
    whole name and to its last words ("de Silva" to "Silva", an organisation to its last word).
    The first name that any entry answers counts. Of several those with the second name, then
    those without a letter stay. ``entries`` has (doc, entry_no, first, authors, year, suffix),
    ``first`` in words, ``authors`` folded.
    """
    words = F.split(F.regexp_replace(fold(F.col("first")), r"[^\p{L}\p{N}\s]", ""), r"\s+")
    names = F.array_distinct(F.filter(F.transform(words, lambda w, i: F.array_join(F.slice(words, i + 1, F.size(words)), "")), lambda n: n != ""))
    able = entries.select("doc", "year", F.col("suffix").alias("own"), "entry_no", "authors", F.explode(names).alias("name"))
    asked = runs.select("doc", "run_no", "at_no", "year", "suffix", "second", F.posexplode("names").alias("rank", "name"))
    met = asked.join(able, ["doc", "year", "name"]).filter("suffix = '' or suffix = own")
    key = ("doc", "run_no", "at_no")
    hit = F.struct("rank", F.when((F.col("second") != "") & F.contains("authors", F.col("second")), 0).otherwise(1).alias("a"), F.when((F.col("suffix") == "") & (F.col("own") != ""), 1).otherwise(0).alias("b"))
    best = met.withColumn("fit", hit).groupBy(*key).agg(F.min("fit").alias("best"))
    return met.withColumn("fit", hit).join(best, list(key)).filter("fit = best").select(*key, "entry_no").distinct()


#: Phrases of the query: the first words of a passage, so many of them.
LENGTHS = (2, 3, 5)
LIST = 16


def phrases_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two, three and five words of every passage, found in all documents."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    phrases = load(spark, sf_dir, "benchmark").select(F.explode(F.array(*(F.when(F.size(words) >= n, F.array_join(F.slice(words, 1, n), " ")) for n in LENGTHS))).alias("phrase")).filter("phrase is not null")
    return phrase_spans(load(spark, sf_dir, "documents").filter("doc_id is not null"), phrases)


def entry_list_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APA lists of works, set with other blanks and hyphens, and where each entry stands; every seventh differs behind its beginning."""
    made = styles.render(works(spark, sf_dir), "apa").select(F.floor(F.col("id") / LIST).alias("doc"), (F.col("id") % LIST).cast("int").alias("entry_no"), "text")
    # Written out once: the list and the text come from the same rows.
    rows = made.select("doc", "entry_no", F.explode(F.array("text")).alias("entry"))
    said = F.array_sort(F.collect_list(F.struct("entry_no", F.replace("entry", F.lit(" "), F.lit("  ")).alias("text"))))
    texts = rows.groupBy("doc").agg(F.concat(F.lit("Works cited here:\n"), F.array_join(F.transform(said, lambda e: e["text"]), "\n\n")).alias("text"))
    other = F.when(F.col("entry_no") % 7 == 3, F.concat(F.left("entry", F.lit(34)), F.lit(" quite another end of it"))).otherwise(F.col("entry"))
    return entry_places(texts, rows.filter("entry_no % 7 <> 3 or char_length(entry) > 60").select("doc", "entry_no", other.alias("entry")))


def citation_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that cite works with runs of years and pages: each year with its name and locator."""
    made = harden(works(spark, sf_dir)).filter("year <> '' and size(authors) > 1")
    family = lambda i: F.get("authors", F.lit(i))["family"]
    year = F.col("year").cast("int")
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("As shown ("), family(0), F.lit(" & "), family(1), F.lit(" "), year, F.lit(", "), year + 1, F.lit("b: "), F.col("id") % 90 + 1, F.lit("; see n. 5)")))
    text = text.when(F.col("id") % 3 == 1, F.concat(F.lit("In March, "), family(0), F.lit(" et al.'s ("), year, F.lit("a, p. 7–9, "), year + 2, F.lit(", n.d.) account"))).otherwise(F.concat(family(0), F.lit(" (in press); "), family(1), F.lit(", "), year, F.lit(", pp. 3, 8.")))
    runs = citation_runs(made.select(F.col("id").alias("doc"), text.alias("text")))
    return runs.select("doc", "run_no", "at_no", F.array_join("names", " ").alias("names"), "second", "year", "suffix", "locator")


QUERIES = {f.__name__: f for f in (phrases_in_documents, entry_list_places, citation_years)}

SQL = {
    # Every run of words of a text that is a phrase, then from the left the longest that starts behind the one before.
    "phrases_in_documents": f"""
WITH RECURSIVE b AS (SELECT list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)) AS w FROM benchmark),
p AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS phrase, n FROM b, (SELECT unnest({list(LENGTHS)}) AS n) WHERE len(w) >= n),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS pieces FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM d),
f AS (SELECT doc_id, i, lower(piece) AS word, sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, len(piece) AS n, regexp_matches(piece, '^[\\p{{L}}\\p{{N}}]') AS is_word FROM e),
w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no, word, (upto - n)::INT AS at_, upto::INT AS upto FROM f WHERE is_word),
g AS (SELECT doc_id, no, at_, list(word) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead, list(upto) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ends FROM w),
hits AS (SELECT doc_id, at_ AS start, ends[n] AS end_, phrase FROM g JOIN p ON array_to_string(ahead[1:n], ' ') = phrase AND len(ahead) >= n),
longest AS (SELECT doc_id, start, max(end_) AS end_, arg_max(phrase, end_) AS phrase FROM hits GROUP BY doc_id, start),
taken AS (
  SELECT doc_id, start, end_, phrase FROM longest QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start) = 1
  UNION ALL
  SELECT l.doc_id, l.start, l.end_, l.phrase FROM taken t JOIN longest l ON l.doc_id = t.doc_id AND l.start >= t.end_
    QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY l.start) = 1)
SELECT doc_id, start, end_ AS "end", phrase FROM taken""",
    "entry_list_places": f"""
WITH r AS ({RENDERED["style_apa"]}),
s AS (SELECT id // {LIST} AS doc, (id % {LIST})::INT AS entry_no, replace(text, ' ', '  ') AS said, text FROM r),
t AS (SELECT *, 18 + coalesce(sum(len(said) + 2) OVER (PARTITION BY doc ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_, len(regexp_replace(text[:34], '[^A-Za-z0-9]', '', 'g')) + 19 AS n FROM s),
u AS (SELECT *, CASE WHEN entry_no % 7 = 3 THEN len(regexp_extract(said, '^(?:[^A-Za-z0-9]*[A-Za-z0-9]){{' || n || '}}')) ELSE len(said) END AS got FROM t WHERE entry_no % 7 <> 3 OR len(text) > 60 AND n - 19 >= {LESS})
SELECT doc, entry_no, at_::INT AS start, (at_ + got + len(regexp_extract(said[got + 1:got + 3], '^[.,;:)\\]”''"]*')))::INT AS "end" FROM u""",
    "citation_years": f"""
WITH {WORKS_SQL}, w AS (SELECT id, year, lower(authors[1].family) AS a, lower(authors[2].family) AS b FROM works WHERE year IS NOT NULL AND len(authors) > 1)
SELECT id AS doc, 0 AS run_no, 0 AS at_no, a || ' ' || b AS names, b AS second, year::VARCHAR AS year, '' AS suffix, '' AS locator FROM w WHERE id % 3 = 0
UNION ALL SELECT id, 0, 1, a || ' ' || b, b, (year + 1)::VARCHAR, 'b', (id % 90 + 1)::VARCHAR FROM w WHERE id % 3 = 0
UNION ALL SELECT id, 0, 0, a, '', year::VARCHAR, 'a', 'p. 7–9' FROM w WHERE id % 3 = 1
UNION ALL SELECT id, 0, 1, a, '', (year + 2)::VARCHAR, '', '' FROM w WHERE id % 3 = 1
UNION ALL SELECT id, 0, 2, a, '', 'nd', '', '' FROM w WHERE id % 3 = 1
UNION ALL SELECT id, 0, 0, a, '', 'inpress', '', '' FROM w WHERE id % 3 = 2
UNION ALL SELECT id, 1, 0, b, '', year::VARCHAR, '', 'pp. 3, 8' FROM w WHERE id % 3 = 2""",
}
