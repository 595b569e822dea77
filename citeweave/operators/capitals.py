"""Titles in capitals: words, names and acronyms told apart by the corpus.

A word that the corpus knows gets the form it mostly has there: small, capitalised or all
capitals. Any other is judged by its letters: a model of letter triples, learnt from the small
words of the corpus by sums over all documents, gives the mean log probability of a letter in
its place. Words that a language could have are names ("Wajilitage"); runs of letters that it
hardly could are acronyms ("XRF"). Figures and symbols are formulas where they can be read as
one, roman numerals stay.

Null titles are empty. Titles with small letters stay as they are. Without a corpus every
unknown word is a name, but for those of one or two letters and those without a vowel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import formulas, let
from citeweave.functions.casing import ROMAN, SMALL
from citeweave.tables import load

#: Letters before a word, and the mark behind it.
EDGE, END = "^^", "$"
#: Added to each count, for triples never seen; letters and marks that may follow.
SMOOTH, FOLLOWING = 0.5, 40
#: The mean log probability (natural) that a word has at least, just below that of letters drawn evenly; how often a word is seen until its form counts.
LEAST, SEEN = -3.7, 2
_SCOTS = "^MC[B-DF-HJ-NP-TV-Z][A-Z]{2}"
_WORDS = r"[\p{L}][\p{L}\p{M}]*(?:['’][\p{L}]+)?"


def word_forms(texts: DataFrame) -> DataFrame:
    """(word, small, capital, upper): how often each word of the corpus has each form; first words of a sentence don't count."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), rf"(?:^|[.!?:\n]\s*){_WORDS}", " ")
    words = texts.select(F.explode(F.regexp_extract_all(bare, F.lit(_WORDS), F.lit(0))).alias("w"))
    small, upper = F.col("w") == F.lower("w"), (F.col("w") == F.upper("w")) & (F.char_length("w") > 1)
    counted = words.groupBy(F.lower("w").alias("word")).agg(F.count_if(small).alias("small"), F.count_if(~small & ~upper).alias("capital"), F.count_if(upper).alias("upper"))
    return counted.filter("small + capital + upper > 0")


def letter_counts(forms: DataFrame) -> DataFrame:
    """(before, letter, n): how often a letter stands behind two others in small words; partial sums of distinct words."""
    edged = F.concat(F.lit(EDGE), "word", F.lit(END))
    triples = F.transform(F.sequence(F.lit(1), F.char_length("word") + 1), lambda i: F.struct(F.substring(edged, i, F.lit(2)).alias("before"), F.substring(edged, i + 2, F.lit(1)).alias("letter")))
    each = forms.filter("small > 0").select("small", F.explode(triples).alias("t"))
    return each.groupBy("t.before", "t.letter").agg(F.sum("small").alias("n"))


def likelihoods(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, score): the mean log probability of a letter of each distinct small ``word``.

    Counts are bounded by the alphabet cubed; they are joined, not collected.
    """
    totals = counts.groupBy("before").agg(F.sum("n").alias("total"))
    edged = F.concat(F.lit(EDGE), "word", F.lit(END))
    triples = F.transform(F.sequence(F.lit(1), F.char_length("word") + 1), lambda i: F.struct(F.substring(edged, i, F.lit(2)).alias("before"), F.substring(edged, i + 2, F.lit(1)).alias("letter")))
    each = words.select("word").distinct().select("word", F.explode(triples).alias("t")).select("word", "t.before", "t.letter")
    joined = each.join(counts, ["before", "letter"], "left").join(totals, "before", "left")
    chance = (F.coalesce("n", F.lit(0)) + SMOOTH) / (F.coalesce("total", F.lit(0)) + SMOOTH * FOLLOWING)
    return joined.groupBy("word").agg(F.avg(F.log(chance)).alias("score"))


def _capital(w: Column) -> Column:
    """Capitalised; the letter behind O' and Mc too."""
    low = F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.char_length(w))))
    named = F.when(w.rlike(r"^\p{L}['’]\p{L}{2}"), F.concat(F.left(w, F.lit(2)), F.upper(F.substring(w, 3, 1)), F.lower(F.substring(w, F.lit(4), F.char_length(w))))).otherwise(low)
    return F.when(w.rlike(_SCOTS), F.concat(F.lit("Mc"), F.substring(w, 3, 1), F.lower(F.substring(w, F.lit(4), F.char_length(w))))).otherwise(named)


def restored_words(titles: DataFrame, forms: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, at, piece, text, kind): the pieces of capitalised titles (id, title), each as it is written otherwise.

    ``kind`` says by what: small, capital and upper by the corpus, name or acronym by letters,
    formula, code, roman, other (marks and blanks).
    """
    pieces = F.regexp_extract_all("title", F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’.]*(?<!\.)|[^\p{L}\p{N}]+|."), F.lit(0))
    each = titles.select("id", F.posexplode(pieces).alias("at", "piece")).withColumn("word", F.when(F.col("piece").rlike(rf"^{_WORDS}$"), F.lower("piece")))
    seen = forms.filter(F.col("small") + F.col("capital") + F.col("upper") >= SEEN)
    most = F.when((F.col("small") >= F.col("capital")) & (F.col("small") >= F.col("upper")), "small").when(F.col("capital") >= F.col("upper"), "capital").otherwise("upper")
    known = seen.select("word", most.alias("form"))
    asked = each.filter("word is not null").select("word").distinct()
    unknown = likelihoods(asked.join(known, "word", "left_anti"), counts)
    judged = each.join(known, "word", "left").join(unknown, "word", "left")
    piece = F.col("piece")
    vowels, n = piece.rlike("(?i)[AEIOUYÀ-Ý]"), F.char_length("piece")
    symbols = F.when(piece.rlike(r"^[A-Z0-9.]*[0-9][A-Z0-9.]*$") & piece.rlike("[A-Z]"), formulas.restore(piece))
    kind = (
        F.when(~piece.rlike(r"[\p{L}\p{N}]"), "other").when(symbols.isNotNull(), "formula").when(piece.rlike(r"\p{N}"), "code").when((n >= 2) & piece.rlike(ROMAN), "roman").when(F.lower("piece").isin(*SMALL), "small")
        .when(F.col("form").isNotNull(), F.col("form")).when(piece.rlike(_SCOTS) & vowels, "name").when((n <= 2) | ~vowels | (F.col("score") < LEAST), "acronym").otherwise("name")
    )
    text = F.when(F.col("kind") == "formula", symbols).when(F.col("kind") == "small", F.lower("piece")).when(F.col("kind").isin("capital", "name"), _capital(piece)).otherwise(piece)
    return judged.withColumn("kind", kind).select("id", "at", "piece", text.alias("text"), "kind")


def restore_titles(titles: DataFrame, forms: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, title): titles (id, title) in capitals as sentences; others as they are."""
    made = titles.select("id", F.coalesce("title", F.lit("")).alias("title"))
    shouted = made.filter(F.col("title").rlike(r"\p{Lu}") & ~F.col("title").rlike(r"\p{Ll}"))
    words = restored_words(shouted, forms, counts)
    joined = words.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("made"))
    first = let(F.col("made"), lambda t: F.concat(F.regexp_extract(t, r"^[^\p{L}\p{N}]*", 0), F.upper(F.substring(t, F.char_length(F.regexp_extract(t, r"^[^\p{L}\p{N}]*", 0)) + 1, F.lit(1))), F.substring(t, F.char_length(F.regexp_extract(t, r"^[^\p{L}\p{N}]*", 0)) + 2, F.char_length(t))))
    return made.join(joined.select("id", first.alias("made")), "id", "left").select("id", F.coalesce("made", "title").alias("title"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_forms(load(spark, sf_dir, "documents"))


def letter_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letter model of the documents."""
    return letter_counts(_corpus(spark, sf_dir))


def caps_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten words of each document in capitals, each with the form that it gets."""
    forms = _corpus(spark, sf_dir)
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}]+"), F.lit(0)), 1, 10)
    titles = load(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("id"), F.upper(F.array_join(words, " ")).alias("title"))
    return restored_words(titles, forms, letter_counts(forms)).filter("kind <> 'other'").select("id", "at", "text", "kind")


QUERIES = {f.__name__: f for f in (letter_triples, caps_restore)}
_W = "[\\p{L}][\\p{L}\\p{M}]*(?:[''’][\\p{L}]+)?"
_FORMS = f"""b AS (SELECT unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '(?:^|[.!?:\\n][ \\t\\n\\r\\f\\v]*){_W}', ' ', 'g'), '{_W}')) AS w FROM documents),
forms AS (SELECT lower(w) AS word, count(*) FILTER (w = lower(w)) AS small, count(*) FILTER (w <> lower(w) AND NOT (w = upper(w) AND len(w) > 1)) AS capital, count(*) FILTER (w <> lower(w) AND w = upper(w) AND len(w) > 1) AS upper_ FROM b GROUP BY 1),
triples AS (SELECT small, ('^^' || word || '$')[i:i + 1] AS before, ('^^' || word || '$')[i + 2] AS letter FROM (SELECT *, unnest(range(1, len(word) + 2)) AS i FROM forms WHERE small > 0)),
counts AS (SELECT before, letter, sum(small)::BIGINT AS n FROM triples GROUP BY ALL)"""
_SMALL = ", ".join(f"'{w}'" for w in SMALL)
SQL = {
    "letter_triples": f"WITH {_FORMS} SELECT before, letter, n FROM counts",
    "caps_restore": f"""WITH {_FORMS}, totals AS (SELECT before, sum(n) AS total FROM counts GROUP BY before),
t AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}]+')[:10] AS ws FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT id, (2 * (i - 1))::INT AS at_, upper(replace(ws[i], 'ß', 'ss')) AS piece, lower(upper(replace(ws[i], 'ß', 'ss'))) AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM t)),
k AS (SELECT word, CASE WHEN small >= capital AND small >= upper_ THEN 'small' WHEN capital >= upper_ THEN 'capital' ELSE 'upper' END AS form FROM forms WHERE small + capital + upper_ >= {SEEN}),
u AS (SELECT word, ('^^' || word || '$')[i:i + 1] AS before, ('^^' || word || '$')[i + 2] AS letter FROM (SELECT word, unnest(range(1, len(word) + 2)) AS i FROM (SELECT DISTINCT word FROM p WHERE word NOT IN (SELECT word FROM k)))),
s AS (SELECT word, avg(ln((coalesce(n, 0) + {SMOOTH}) / (coalesce(total, 0) + {SMOOTH * FOLLOWING}))) AS score FROM u LEFT JOIN counts USING (before, letter) LEFT JOIN totals USING (before) GROUP BY word),
j AS (SELECT *, CASE WHEN len(piece) >= 2 AND regexp_full_match(piece, '[MDCLXVI].*') AND regexp_full_match(piece, 'X{{0,3}}(IX|IV|V?I{{0,3}})') THEN 'roman' WHEN word IN ({_SMALL}) THEN 'small' WHEN form IS NOT NULL THEN form
  WHEN regexp_matches(piece, '{_SCOTS}') AND regexp_matches(piece, '[AEIOUYÀ-Ý]') THEN 'name' WHEN len(piece) <= 2 OR NOT regexp_matches(piece, '(?i)[AEIOUYÀ-Ý]') OR score < {LEAST} THEN 'acronym' ELSE 'name' END AS kind FROM p LEFT JOIN k USING (word) LEFT JOIN s USING (word))
SELECT id, at_ AS "at", CASE WHEN kind = 'small' THEN lower(piece) WHEN kind IN ('capital', 'name') AND regexp_matches(piece, '{_SCOTS}') THEN 'Mc' || piece[3] || lower(piece[4:])
  WHEN kind IN ('capital', 'name') THEN upper(piece[1]) || lower(piece[2:]) ELSE piece END AS text, kind FROM j""",
}
