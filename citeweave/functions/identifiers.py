"""Identifiers: DOI, arXiv, PubMed, ISBN, ISSN. Null in, null out; no match is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import let

DOI = r"10\.[0-9]{4,9}/[^\s\"']+"
#: Tags that abut a DOI in pasted markup (fixed values); a SICI's ``<857::AID-SIM777>`` is none.
DOI_TAGS = r"(?i)</?(?:a|br|p|div|span|i|b|em|strong|sub|sup|u|li|td|tr|font)\b[^<>]*>"
#: Landing pages behind a DOI (fixed values).
LANDING = r"(?i)/(?:full|abstract|pdf|epdf|epub|fulltext|html|meta|summary|references|figures|tables|supplemental|suppl_file)(?:[/;].*)?$"
CLOSING = r"[.,;:!?*…—\"'“”‘’]+$"
LOCATOR = r"\bpp?\.?|\bpages?|\bvol\.?|\bvolume|\bno\.?|\bnr\.?|\bdoi:?"


def _found(text: Column) -> Column:
    """An empty match is none."""
    return F.nullif(text, F.lit(""))


def _unbalanced(doi: Column, opening: str, closing: str) -> Column:
    """Closing brackets at the end that nothing opens are dropped."""

    def cut(d: Column) -> Column:
        count = lambda marks: F.char_length(d) - F.char_length(F.translate(d, marks, ""))
        run = F.char_length(F.regexp_extract(d, f"[{closing}]+$", 0))
        extra = F.greatest(count(closing.replace("\\", "")) - count(opening), F.lit(0))
        return F.left(d, F.char_length(d) - F.least(run, extra))

    return let(doi, cut)


def _plain_text(text: Column) -> Column:
    out = F.regexp_replace(text, DOI_TAGS, " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def _bared(doi: Column) -> Column:
    """What stands behind a DOI taken off, in as many rounds as anything is bared in practice."""
    out = doi
    for _ in range(4):
        out = F.regexp_replace(out, LANDING, "")
        out = F.regexp_replace(F.regexp_replace(out, r"['’]s$", ""), r"[²³¹⁰-₟]+$", "")
        out = _unbalanced(_unbalanced(F.regexp_replace(out, CLOSING, ""), "([", r")\]"), "<", ">")
    return out


def extract_doi(col: Column) -> Column:
    """The first DOI, without what stands around it: markup, query, landing page, version, closing marks."""

    def of(text: Column) -> Column:
        raw = F.left(F.regexp_extract(text, DOI, 0), F.lit(1000))
        before = F.regexp_extract(text, r"(?s)^(.*?)10\.[0-9]{4,9}/[^\s\"']", 1)
        linked = let(F.regexp_replace(raw, r"[?#].*$", ""), lambda d: F.coalesce(F.try_url_decode(F.replace(d, F.lit("+"), F.lit("%2B"))), d))
        return F.when(before.rlike(r"(?i)https?://[^\s\"'<>]*$"), linked).otherwise(raw)

    def unversioned(doi: Column) -> Column:
        page = r"(?i)(?:v[0-9]+)?(?:\.(?:full|abstract|full-text|supplementary-material|article-info|article-metrics)(?:\.pdf(?:\+html)?)?)?$"
        return F.when(doi.startswith("10.1101/"), F.regexp_replace(doi, page, "")).when(F.lower(doi).startswith("10.48550/arxiv."), F.regexp_replace(doi, r"v[0-9]+$", "")).otherwise(doi)

    return let(let(_bared(let(_plain_text(col), of)), unversioned), lambda d: F.when(d.rlike(r"^10\.[0-9]{4,9}/."), d))


def extract_arxiv(col: Column) -> Column:
    """arXiv id without version, new or old form, from a link, an ``arXiv:`` form or the whole text."""
    text = F.trim(col)
    named = F.regexp_extract(text, r"(?i)(?:arxiv\.org/(?:abs|pdf|html)/|arxiv:\s*)([0-9]{4}\.[0-9]{4,5}|[a-z\-]+(?:\.[A-Z]{2})?/[0-9]{7})(?:v[0-9]+)?", 1)
    return F.coalesce(_found(named), _found(F.regexp_extract(text, r"^([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?\.?$", 1)))


def to_doi(col: Column) -> Column:
    """A DOI, or that of an arXiv id."""
    return F.coalesce(extract_doi(col), F.concat(F.lit("10.48550/arXiv."), extract_arxiv(col)))


def extract_pmid(col: Column) -> Column:
    """PMC id first, then a named PubMed id, then a bare number of 4 to 9 digits that is the whole input."""
    pmc = F.upper(F.regexp_extract(col, r"(?i)\b(PMC[0-9]{4,9})\b", 1))
    named = F.regexp_extract(col, r"(?i)(?:pmid\s*:?\s*|pubmed\.ncbi\.nlm\.nih\.gov/|pubmed/)([0-9]{4,9})", 1)
    return F.coalesce(_found(pmc), _found(named), _found(F.regexp_extract(col, r"^\s*([0-9]{4,9})\s*$", 1)))


def id_to_doi(col: Column) -> Column:
    """A cell's DOI as {doi, other}: a DOI or arXiv id, else a named PubMed or PMC id to look up; bare numbers are neither."""
    other = F.when(F.trim(col).rlike(r"^[0-9]+$"), None).otherwise(extract_pmid(col))
    return let(to_doi(col), lambda doi: F.struct(doi.alias("doi"), F.when(doi.isNull(), other).alias("other")))


def doi_of(col: Column) -> Column:
    """The DOI of a field of a tagged file: a SICI keeps its balanced ``<...>``; an unpaired one ends it."""
    raw = F.regexp_extract(col, DOI, 0)
    whole = F.regexp_extract(raw, r"^(?:[^<>]|<[^<>]*>)*", 0)
    return _found(F.regexp_replace(whole, r"[.,;:]+$", ""))


#: Characters that break a link, beside those that aren't ASCII.
BREAKING = r"[<>\"\s#?\[\]{}|\\^`]|[^\x00-\x7F]"


def doi_url(doi: Column) -> Column:
    """A link; only characters that break one are percent-encoded, so a SICI stays readable."""

    def encoded(safe: Column) -> Column:
        each = F.transform(F.split(safe, ""), lambda c: F.when(c.rlike(BREAKING), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
        return F.when(safe.rlike(BREAKING), F.array_join(each, "")).otherwise(safe)

    return F.concat(F.lit("https://doi.org/"), let(F.regexp_replace(doi, r"%(?![0-9A-Fa-f]{2})", "%25"), encoded))


def doi_link(doi: Column, url: Column) -> Column:
    return F.when(doi != "", doi_url(doi)).otherwise(url)


def _digits(col: Column) -> Column:
    return F.transform(F.split(col, ""), lambda c: F.when(c == "X", 10).otherwise(c.try_cast("int")))


def _weighted(col: Column, size: int, weight) -> Column:
    return F.aggregate(F.transform(F.slice(_digits(col), 1, size), lambda d, i: d * weight(i)), F.lit(0), lambda a, x: a + x)


def isbn13_holds(col: Column) -> Column:
    """Weights 1 and 3 by turns, sum divisible by 10."""
    return F.coalesce(col.rlike("^97[89][0-9]{10}$") & (_weighted(col, 13, lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0), F.lit(False))


def isbn10_holds(col: Column) -> Column:
    """Weights 10 to 1, sum divisible by 11; X counts ten at the end."""
    return F.coalesce(col.rlike("^[0-9]{9}[0-9X]$") & (_weighted(col, 10, lambda i: 10 - i) % 11 == 0), F.lit(False))


def isbn_digits(col: Column) -> Column:
    """The bare digits of an ISBN whose checksum holds, in either length."""
    thirteen = lambda d: d.rlike("^[0-9]{13}$") & (_weighted(d, 13, lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0)
    return let(F.upper(F.regexp_replace(col, r"[\s-]", "")), lambda d: F.when(thirteen(d) | isbn10_holds(d), d))


def extract_isbn(col: Column) -> Column:
    """The first ISBN of free text: with its name, of 13 digits, hyphenated in four groups, or the whole text.

    Numbers behind a word for pages, volumes or issues are none, unless named.
    """
    whole = F.regexp_extract(F.trim(col), r"^([0-9]{9}[0-9Xx])$", 1)
    named = r"(?i)\bISBN(?:-?1[03])?\s*:?\s*(97[89](?:[\s-]?[0-9]){10}|[0-9](?:[\s-]?[0-9]){8}[\s-]?[0-9Xx])(?![0-9Xx])"
    lead = rf"(?i)((?:{LOCATOR})\s*)?(?<![0-9-])"
    bare = lead + r"(97[89](?:[\s-]?[0-9]){10})(?![0-9Xx])(?!-[0-9])"
    four = lead + r"([0-9]{1,5}-[0-9]{1,7}-[0-9]{1,7}-[0-9Xx])(?![0-9Xx-])"
    every = [F.transform(F.regexp_extract_all(col, F.lit(named), F.lit(1)), isbn_digits)]

    def unled(pattern: str, size: int) -> Column:
        leads, numbers = (F.regexp_extract_all(col, F.lit(pattern), F.lit(k)) for k in (1, 2))
        return F.zip_with(leads, numbers, lambda a, n: F.when((F.coalesce(a, F.lit("")) == "") & (F.char_length(F.regexp_replace(n, r"[\s-]", "")) == size), isbn_digits(n)))

    every += [unled(bare, 13), unled(four, 10)]
    first = F.get(F.filter(F.concat(*every), lambda d: d.isNotNull()), F.lit(0))
    return F.when(whole != "", isbn_digits(whole)).otherwise(first)


def issn_holds(col: Column) -> Column:
    """Weights 8 to 1, sum divisible by 11."""
    bare = F.replace(col, F.lit("-"), F.lit(""))
    return F.coalesce(bare.rlike("^[0-9]{7}[0-9X]$") & (_weighted(bare, 8, lambda i: 8 - i) % 11 == 0), F.lit(False))


def id_numbers(values: Column) -> Column:
    """{issn, isbn} of an array of fields: notes in brackets and names dropped, ISSNs hyphenated, each once, in order."""
    text = F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v, r"\([^()]{0,80}\)", " "), r"(?i)\b(?:e-?|p-?)?(?:ISSN|ISBN)(?:-1[03])?:?", " "))
    parts = F.filter(F.transform(F.flatten(F.transform(text, lambda v: F.split(v, "[;,]"))), lambda p: F.trim(p)), lambda p: p != "")
    book = r"^(?:97[89][0-9]{9}[0-9Xx]|[0-9]{9}[0-9Xx])$"
    serial = r"^(?:[0-9]{4}-[0-9]{3}[0-9Xx]|[0-9]{7}[0-9Xx])$"
    is_book = lambda p: F.regexp_replace(p, r"[\s‐‑–-]", "").rlike(book)
    # A part of blanks and digits that is one number as a whole, else its words one by one.
    words = F.flatten(F.transform(parts, lambda p: F.when(is_book(p), F.array(F.regexp_replace(p, r"\s+", "-"))).otherwise(F.split(p, r"\s+"))))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^0-9Xx]+|[^0-9Xx]+$", ""))
    issn = F.transform(F.filter(bare, lambda w: w.rlike(serial)), lambda w: F.regexp_replace(F.upper(w), r"^([0-9]{4})-?", "$1-"))
    return F.struct(F.array_distinct(issn).alias("issn"), F.array_distinct(F.filter(bare, is_book)).alias("isbn"))
