"""Pages, dates, editions, kinds and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import let

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Month names as the styles print them (fixed values).
MONTH_NAMES = {
    "full": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "ieee": ("Jan.", "Feb.", "Mar.", "Apr.", "May", "Jun.", "Jul.", "Aug.", "Sep.", "Oct.", "Nov.", "Dec."),
    "mla": ("Jan.", "Feb.", "Mar.", "Apr.", "May", "June", "July", "Aug.", "Sept.", "Oct.", "Nov.", "Dec."),
    "nlm": ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
}
ORDINALS = ("First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth")
DASHES = r"\s*[-–—]+\s*"


def joined(by: str, *parts) -> Column:
    """The parts that are not empty, with ``by`` between."""
    cells = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.array_join(F.filter(F.array(*cells), lambda x: x != ""), by)


def given(condition: Column, *parts) -> Column:
    """The parts in a row if the condition holds, else nothing."""
    cells = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.when(condition, F.concat(*cells) if len(cells) > 1 else cells[0]).otherwise("")


def month_name(month: Column, form: str = "full") -> Column:
    """Name of a month; nothing for 0."""
    return F.coalesce(F.get(F.array(*map(F.lit, MONTH_NAMES[form])), month - 1), F.lit(""))


def en_dash(pages: Column) -> Column:
    return F.regexp_replace(pages, DASHES, "–")


def hyphen(pages: Column) -> Column:
    return F.regexp_replace(pages, DASHES, "-")


def is_range(pages: Column) -> Column:
    return pages.rlike("[-–—]")


def same_pages(pages: Column) -> Column:
    """``263-263`` is ``263``."""
    return F.regexp_replace(pages, r"^\s*(\S+?)\s*[-‐-―]+\s*\1\s*$", "$1")


def pp(pages: Column) -> Column:
    """``p. 45`` or ``pp. 45–47``."""
    return F.concat(F.when(is_range(pages), "pp. ").otherwise("p. "), en_dash(pages))


def page_range(first: Column, last: Column) -> Column:
    """``263`` for equal pages, an en dash between others."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first, F.lit("–"), last))


def nlm_pages(pages: Column) -> Column:
    """Leading digits that repeat are left out of the last page: 123-129 is 123-9."""

    def short(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^([0-9]+)-", 1), F.regexp_extract(p, r"-([0-9]+)$", 1)
        n = F.char_length(a)
        shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (F.left(a, i) == F.left(b, i)) & (i < n)))
        rising = (n == F.char_length(b)) & (b > a)
        return F.when(p.rlike("^[0-9]+-[0-9]+$") & rising, F.concat(a, F.lit("-"), b.substr(shared + 1, n))).otherwise(p)

    return let(hyphen(pages), short)


def short_page_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(nlm_pages(F.concat(first, F.lit("-"), last)))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th ... 11th, 12th, 13th."""
    teen = (n % 100).between(11, 13)
    ending = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n, ending)


def valid_edition(col: Column) -> Column:
    """Placeholders for no edition are none."""
    return F.when(col.rlike(r"(?i)^(?:0+|none|null|undefined|n/?a|-)$"), "").otherwise(col)


def edition_label(col: Column, style: str = "apa") -> Column:
    """``3`` is ``3rd ed.``, ``3rd edn.`` (harvard) or ``Third Edition`` (carnegie); words pass through."""
    number = F.regexp_extract(col, r"(?i)^([0-9]+)(?:st|nd|rd|th)?\.?$", 1)

    def labelled(n: Column) -> Column:
        worded = F.coalesce(F.get(F.array(*map(F.lit, ORDINALS)), n - 1), F.concat(n, F.lit("th")))
        end = {"harvard": " edn.", "carnegie": " Edition"}.get(style, " ed.")
        return F.concat(worded if style == "carnegie" else ordinal(n), F.lit(end))

    other = F.when(col.rlike(r"(?i)edition|ed\."), col).otherwise(F.concat(col, F.lit(" Edition" if style == "carnegie" else " ed.")))
    return F.when(col == "", "").when(number != "", let(F.nullif(number, F.lit("")).cast("int"), labelled)).otherwise(other)


def partial_date(col: Column) -> Column:
    """{y, m, d} of year-month-day forms or of a year with a month word; 0 is unknown. Never a DATE."""
    numeric = r"^([0-9]{4})(?:[-/.]([0-9]{1,2})?)?(?:[-/.]([0-9]{1,2})?)?[-/.]*"

    def number(text: Column) -> Column:
        return F.coalesce(F.nullif(text, F.lit("")).cast("int"), F.lit(0))

    def of(text: Column) -> Column:
        whole = F.regexp_extract(text, numeric, 0)
        by_form = (whole != "") & ((F.regexp_extract(text, numeric, 2) != "") | (F.char_length(whole) == F.char_length(text)))
        formed = F.struct(*[number(F.regexp_extract(text, numeric, k)).alias(n) for k, n in ((1, "y"), (2, "m"), (3, "d"))])
        year = F.regexp_extract(text, r"(?:^|[^0-9])(1[5-9][0-9]{2}|20[0-9]{2})(?![0-9])", 1)
        rest = F.when(year != "", F.regexp_replace(text, r"(^|[^0-9])(?:1[5-9][0-9]{2}|20[0-9]{2})(?![0-9])", "$1 ")).otherwise(text)
        word = F.lower(F.left(F.regexp_extract(rest, "[A-Za-z]{3,}", 0), F.lit(3)))
        month = F.array_position(F.array(*map(F.lit, MONTHS)), word).cast("int")
        worded = F.struct(number(year).alias("y"), month.alias("m"), number(F.regexp_extract(rest, r"(?<![0-9A-Za-z])([0-9]{1,2})(?![0-9A-Za-z])", 1)).alias("d"))
        return let(F.when(by_form, formed).otherwise(worded), valid)

    def valid(x: Column) -> Column:
        month = x["m"].between(1, 12)
        longest = F.when(x["m"] == 2, 29).when(x["m"].isin(4, 6, 9, 11), 30).otherwise(31)
        return F.struct(x["y"].alias("y"), F.when(month, x["m"]).otherwise(0).alias("m"), F.when(month & x["d"].between(1, longest), x["d"]).otherwise(0).alias("d"))

    return let(F.trim(F.coalesce(col, F.lit(""))), of)


def tagged_date(published: Column, dated: Column, older: Column) -> Column:
    """The date of a RIS record: PY's year; DA, then Y1, add month and day if they are of that year and month."""

    def of(d: Column) -> Column:
        py, da, y1 = d["py"], d["da"], d["y1"]
        adds = lambda x: (x["y"] == py["y"]) & (x["m"] > 0) & ((py["m"] == 0) | (x["m"] == py["m"]))
        return F.when((py["y"] == 0) & (da["y"] > 0), da).when(py["y"] == 0, y1).when(adds(da), da).when(adds(y1), y1).otherwise(py)

    return let(F.struct(partial_date(published).alias("py"), partial_date(dated).alias("da"), partial_date(older).alias("y1")), of)


def cited_year(text: Column, latest: int) -> Column:
    """The first year from 1500 to ``latest`` outside links, DOIs and ranges; 0 without one."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://\S+|10\.[0-9]{4,9}/\S+", " "), r"[0-9]+\s*[-‐-―−]\s*[0-9]+", " ")
    year = F.regexp_extract(bare, r"(?<![\w])((?:1[5-9]|20)[0-9]{2})[a-z]?(?![\w])", 1)
    return let(F.coalesce(F.nullif(year, F.lit("")).cast("int"), F.lit(0)), lambda y: F.when(y <= latest, y).otherwise(0))


def kind(work_type: Column, container: Column | None = None, volume: Column | None = None) -> Column:
    """Kind of a work by its type; an article without a journal is a preprint, an unknown type with journal and volume a journal's."""
    has = lambda c: (c.isNotNull() & (c != "")) if c is not None else F.lit(False)
    known = (
        F.when(work_type.isin("journal-article", "article-journal", "article-magazine", "article-newspaper"), "journal")
        .when(work_type.isin("book-chapter", "chapter", "book-section", "book-part", "reference-entry", "entry-encyclopedia", "entry-dictionary", "entry"), "chapter")
        .when(work_type.isin("book", "monograph", "edited-book", "reference-book"), "book")
        .when(work_type.isin("proceedings-article", "paper-conference"), "proceedings")
        .when(work_type.isin("posted-content", "preprint"), "preprint")
        .when(work_type.isin("dissertation", "thesis"), "thesis")
        .when(work_type.isin("report", "report-component", "report-series"), "report")
        .when(work_type.isin("webpage", "post-weblog", "web-page", "post"), "web")
        .when(work_type.isin("dataset", "software", "standard"), work_type)
    )
    open_ = F.when((work_type == "article") & ~has(container), "preprint").when((work_type == "article") | (has(container) & has(volume)), "journal").otherwise("generic")
    return F.coalesce(known, F.when((F.coalesce(work_type, F.lit("")) == "") & has(container), "journal"), open_)


#: Preprint servers by the shape of their DOIs (fixed values); the first that fits.
PREPRINTS = (
    (r"^10\.1101/(?:[0-9]{4}\.[0-9]{2}\.[0-9]{2}\.[0-9]+|[0-9]{5,7})(?:v[0-9]+)?$", "bioRxiv"), (r"^10\.31234/", "PsyArXiv"), (r"^10\.31219/", "OSF Preprints"), (r"^10\.31235/", "SocArXiv"),
    (r"^10\.31222/", "MetaArXiv"), (r"^10\.31224/", "engrXiv"), (r"^10\.31730/", "AfricArXiv"), (r"^10\.21203/rs\.", "Research Square"), (r"^10\.26434/chemrxiv", "ChemRxiv"),
    (r"^10\.20944/preprints", "Preprints.org"), (r"^10\.31223/", "EarthArXiv"), (r"^10\.32942/", "EcoEvoRxiv"), (r"^10\.22541/(?:au|essoar)", "Authorea"), (r"^10\.36227/techrxiv", "TechRxiv"),
    (r"^10\.2139/ssrn", "SSRN"), (r"^10\.48550/arxiv", "arXiv"), (r"^10\.1590/scielopreprints", "SciELO Preprints"), (r"^10\.5194/egusphere-", "EGUsphere"),
    (r"^10\.5194/[a-z]+-[0-9]{4}-[0-9]+(?:-[a-z]+[0-9]*)?$", "Copernicus discussion paper"), (r"^10\.1002/essoar", "ESSOAr"), (r"^10\.33774/", "Cambridge Open Engage"),
)
#: Publishing houses and their imprints (fixed values).
HOUSES = {
    "elsevier": r"elsevier|pergamon|academic\s+press|north[-\s]holland|butterworths?|saunders|mosby|morgan\s+kaufmann|excerpta\s+medica",
    "springer": r"springer|kluwer|plenum|birkh(?:ä|a)user|physica[-\s]verlag|steinkopff|humana\s+press", "wiley": r"wiley|interscience|blackwell|jossey[-\s]bass",
    "taylor": r"taylor\s*(?:&|and)\s*francis|routledge|crc\s+press|chapman\s*(?:&|and)\s*hall|garland|balkema", "mcgraw": r"mcgraw[-\s]?hill",
    "pearson": r"pearson|prentice[-\s]hall|addison[-\s]wesley|longman", "oup": r"oxford\s+university\s+press|clarendon\s+press", "cup": r"cambridge\s+university\s+press",
    "degruyter": r"de\s+gruyter|oldenbourg", "macmillan": r"macmillan|palgrave|w\.\s*h\.\s*freeman", "dover": r"dover\s+publications|dover(?=[,.:;\s]+(?:new\s+york|mineola))",
}
#: Notices about a paper, which share its title (fixed values).
NOTICE = (
    r"(?i)^(?:corrigendum|erratum|errata|correction|retraction|retracted|expression of concern|editorial|reply|authors?['’]?s?\s+reply|response|comment|commentary on|faculty opinions|review of"
    r"|book review|withdrawn|addendum|author correction|publisher correction|supplementary (?:material|information|data)|supplemental)\b"
)
NOTICE_LEAD = r"(?i)^\s*(?:letter\s*:|discussion\s+(?:of|on)\b|closure\s+(?:to|of)\b|in\s+reply\b)"
NOTICE_TAIL = r"(?i)(?:[—–:(]|\s-)\s*(?:in\s+)?(?:reply|discussion|closure|letter)\b(?:\s+(?:to|by|on)\b[^.;]*)?\)?\s*(?:[.;]\s|[.;]?\s*$)"
UPDATE_KINDS = {
    "retraction": "retraction", "partial_retraction": "retraction", "withdrawal": "retraction", "removal": "retraction", "expression_of_concern": "concern", "correction": "correction",
    "corrigendum": "correction", "erratum": "correction",
}
ASIDES = ("dataset", "grant", "posted-content", "preprint", "component", "peer-review", "journal-issue")
BOOKS = ("book", "edited-book", "monograph", "reference-book")
BOOKISH = (*BOOKS, "book-chapter", "book-part", "book-section", "reference-entry")
CONTAINERS = ("journal", "journal-issue", "journal-volume", "book-series", "book-set", "proceedings-series", "report-series", "book-track")


def preprint_server(doi: Column) -> Column:
    """The preprint server of a DOI; null for any other."""
    out = None
    for pattern, name in PREPRINTS:
        fits = doi.rlike(f"(?i){pattern}")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def houses(text: Column) -> Column:
    """The publishing houses that a text names, imprints counted as their house."""
    return F.filter(F.array(*[F.when(text.rlike(rf"(?i)(?<!\w)(?:{pattern})(?!\w)"), name) for name, pattern in HOUSES.items()]), lambda h: h.isNotNull())


def is_notice(title: Column) -> Column:
    return F.coalesce(title.rlike(NOTICE) | title.rlike(NOTICE_LEAD) | title.rlike(NOTICE_TAIL), F.lit(False))


def update_kind(update_type: Column) -> Column:
    """What an update says of a work: retraction, concern or correction; null for what isn't wrong with it."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in UPDATE_KINDS.items() for x in pair]), F.regexp_replace(F.lower(update_type), r"[\s-]+", "_"))


def grade(score: Column) -> Column:
    """good from 0.8, check from 0.5, weak below; none without a score."""
    return F.when(score.isNull(), "none").when(score >= 0.8, "good").when(score >= 0.5, "check").otherwise("weak")
