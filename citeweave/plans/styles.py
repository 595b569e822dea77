"""Citation styles and export formats as expressions over hardened records.

Every style leaves out what a record lacks: no part is printed without its value, so no
text is null. A style is built with a ``Mark``: ``PLAIN`` gives text, ``HTML`` escapes it
and sets titles in italics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import let
from citeweave.functions.bibliographic import edition_label, en_dash, given, hyphen, is_range, joined, month_name, nlm_pages, pp
from citeweave.functions.identifiers import doi_link, doi_url
from citeweave.functions.marks import marks_to_html, marks_to_latex, marks_to_text
from citeweave.functions.names import full_last, init_last, join_and, last_full, last_init, nlm
from citeweave.functions.text import ascii_key, ends_punct
from citeweave.records import harden

C = F.col
MASTERS = r"(?i)m\.?\s?[as]\.?|master"


class Mark:
    """How text and titles are written."""

    def __init__(self, text: Callable[[Column], Column], italic: Callable[[Column], Column]):
        self.text, self.italic = text, italic


PLAIN = Mark(lambda c: c, lambda c: c)
HTML = Mark(marks_to_html, lambda c: F.when(c == "", "").otherwise(F.concat(F.lit("<i>"), marks_to_html(c, in_italics=True), F.lit("</i>"))))


def stopped(text: Column) -> Column:
    """A full stop behind a text that has none, inside or behind a closing tag."""
    return let(text, lambda c: F.when((c == "") | c.rlike("[.?!][”’\"']?(?:</i>)?$"), c).otherwise(F.concat(c, F.lit("."))))


def _has(name: str) -> Column:
    return F.size(name) > 0 if name in ("authors", "editors") else C(name) != ""


def _is(*kinds: str) -> Column:
    return C("kind").isin(*kinds)


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _names(people: str, one: Callable[[Column], Column]) -> Column:
    return F.transform(people, lambda p: one(p))


def _pick(*options: Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def link() -> Column:
    return doi_link(C("doi"), C("url"))


def host() -> Column:
    """Where a work stands: its container, server or repository, or publisher."""
    return _pick(C("container"), C("institution"), C("publisher"))


def shown_publisher() -> Column:
    """The publisher beside a host that is another body, never a repository's owner."""
    return given(~_is("journal") & _has("publisher") & ~(_has("institution") & ~_has("container")) & (C("publisher") != host()), C("publisher"))


def place_publisher() -> Column:
    return joined(": ", C("place"), C("publisher"))


def school() -> Column:
    return _pick(C("institution"), C("publisher"), C("container"))


def accessed(british: bool = False) -> Column:
    month, day = month_name(C("accessed.month")), C("accessed.day").cast("string")
    when = joined(" ", given(C("accessed.day") > 0, day), month, C("accessed.year").cast("string")) if british else joined(", ", joined(" ", month, given((C("accessed.day") > 0) & (month != ""), day)), C("accessed.year").cast("string"))
    return F.when(C("accessed.year") > 0, when).otherwise("")


def issue_month(form: str) -> Column:
    """The month of an issue: a date with a day is the day it went online."""
    return given(C("day") == 0, month_name(C("month"), form))


def apa(m: Mark = PLAIN) -> Column:
    def listed(people: str) -> Column:
        def of(n: Column) -> Column:
            size, last = F.size(n), F.element_at(n, -1)
            many = _cat(F.array_join(F.slice(n, 1, 19), ", "), ", . . . ", last)
            return F.when(size > 20, many).when(size > 1, _cat(F.array_join(F.slice(n, 1, F.greatest(size - 1, F.lit(1))), ", "), ", & ", last)).otherwise(F.coalesce(F.get(n, F.lit(0)), F.lit("")))

        return F.when(F.size(people) > 0, let(_names(people, last_init), of)).otherwise("")

    is_author = lambda name: F.exists("authors", lambda p: p["literal"] & (F.lower(p["family"]) == F.lower(name)))
    editors = given(_has("editors"), listed("editors"), F.when(F.size("editors") > 1, " (Eds.)").otherwise(" (Ed.)"))
    authors = F.when(C("others"), _cat(F.array_join(_names("authors", last_init), ", "), ", et al.")).otherwise(listed("authors"))
    people = F.when(_has("authors"), authors).otherwise(editors)
    dated = given(_is("web") & (C("month") > 0), ", ", month_name(C("month")), given(C("day") > 0, " ", C("day").cast("string")))
    year = _cat("(", given(_has("year"), C("year"), dated), given(~_has("year"), "n.d."), ").")
    volume = _cat(m.italic(C("volume")), given(_has("issue"), "(", m.text(C("issue")), ")"))
    pages = given(_has("pages"), F.when(C("article"), "Article ").otherwise(""), m.text(en_dash(C("pages"))))
    source = joined(", ", m.italic(C("container")), volume, pages)
    editing = given(_has("editors"), m.text(join_and(_names("editors", init_last), "&", pair="")), F.when(F.size("editors") > 1, " (Eds.), ").otherwise(" (Ed.), "))
    inside = joined(", ", m.text(edition_label(C("edition"))), given(_has("pages"), m.text(pp(C("pages")))))
    within = F.when(_has("container"), _cat("In ", editing, m.italic(C("container")), given(inside != "", " (", inside, ")"), ".")).otherwise(given(_has("pages"), m.text(pp(C("pages"))), "."))
    edition = given(_has("edition"), "(", m.text(edition_label(C("edition"))), ")")
    book = stopped(joined(" ", m.italic(C("title")), edition))
    book = F.when(_has("edition"), _cat(joined(" ", m.italic(C("title")), edition), ".")).otherwise(book)
    degree = F.when(C("genre").rlike(MASTERS), "Master's thesis").otherwise("Doctoral dissertation")
    label = F.when(_is("thesis"), joined(", ", degree, school())).when(_is("dataset"), "Data set").when(_is("software"), "Computer software").otherwise("")
    numbered = F.when(C("number").rlike("(?i)publication no"), C("number")).otherwise(_cat("Publication No. ", C("number")))
    reported = F.when(_has("series"), _cat(C("series"), " ", C("number"))).when(C("number").rlike(r"(?i)\b(?:no|number|rep|report|pub)\b"), C("number")).otherwise(_cat("Report No. ", C("number")))
    number = given(_has("number") & _is("thesis", "report"), "(", m.text(F.when(_is("thesis"), numbered).otherwise(reported)), ")")
    work = joined(" ", m.italic(C("title")), number, given(label != "", "[", m.text(label), "]"))
    work = F.when((label != "") | (number != ""), _cat(work, ".")).otherwise(stopped(work))
    at = given(~_is("thesis") & ~is_author(host()), m.text(stopped(host())))
    archive = given(_is("thesis"), m.text(stopped(F.when(_has("publisher") & (C("publisher") != school()), C("publisher")).otherwise(C("database")))))
    read = given(_is("web") & (link() != "") & (accessed() != ""), "Retrieved ", accessed(), ", from ", m.text(link()))
    publisher = m.text(stopped(C("publisher")))
    title = F.when(_is("book"), book).when(_is("journal", "chapter", "proceedings"), m.text(stopped(C("title")))).otherwise(work)
    head = F.when(people != "", joined(" ", m.text(stopped(people)), year, title)).otherwise(joined(" ", title, year))
    tail = (
        F.when(_is("journal"), given(source != "", source, ".")).when(_is("chapter", "proceedings"), joined(" ", within, publisher))
        .when(_is("book"), given(~is_author(C("publisher")), publisher)).otherwise(joined(" ", at, archive))
    )
    return joined(" ", head, tail, F.when(read != "", read).otherwise(m.text(link())))


def _lead(people: str, first: Callable, others: Callable, most: int) -> Column:
    """``first`` of one, two joined by ``, and``, more than ``most`` as the first et al."""
    n = F.size(people)
    one = first(F.get(people, F.lit(0)))
    return F.when(n > most, _cat(one, ", et al")).when(n == 2, _cat(one, ", and ", others(F.get(people, F.lit(1))))).when(n == 1, one).otherwise("")


def _editor_list() -> Column:
    return F.when(F.size("editors") > 2, _cat(full_last(F.get("editors", F.lit(0))), " et al.")).otherwise(join_and(_names("editors", full_last), "and", False))


def mla(m: Mark = PLAIN) -> Column:
    first = last_full(F.get("authors", F.lit(0)))
    authors = F.when(C("others") & _has("authors"), _cat(first, ", et al")).otherwise(_lead("authors", last_full, full_last, 2))
    editors = given(_has("editors"), _lead("editors", last_full, full_last, 2), F.when(F.size("editors") > 1, ", editors").otherwise(", editor"))
    leads = _is("book", "chapter", "proceedings")
    people = F.when(_has("authors"), authors).otherwise(given(leads, editors))
    edited = given(_has("editors") & ((_has("authors") & _is("book")) | (~_has("authors") & ~leads)), "Edited by ", m.text(_editor_list()))
    when = (
        F.when(~_has("year"), "").when(_is("journal"), joined(" ", issue_month("mla"), C("year"))).when(_is("book") | (C("month") == 0), C("year"))
        .otherwise(joined(" ", given(C("day") > 0, C("day").cast("string")), month_name(C("month"), "mla"), C("year")))
    )
    holder = F.when(_has("container"), m.italic(C("container"))).otherwise(given(~_is("journal"), m.text(host())))
    by = given(_is("chapter", "proceedings") & _has("editors"), "edited by ", m.text(_editor_list()))
    parts = [holder, by, edited, given(_has("volume"), "vol. ", m.text(C("volume"))), given(_has("issue"), "no. ", m.text(C("issue"))), m.text(shown_publisher()), when, given(_has("pages"), m.text(pp(C("pages"))))]
    database = _has("database")
    at = F.when(database, "").otherwise(m.text(link()))
    held = F.when(_is("book"), joined(", ", edited, m.text(C("publisher")), when, at)).otherwise(joined(", ", *parts, at))
    title = F.when(_is("book"), stopped(m.italic(C("title")))).otherwise(_cat("“", m.text(stopped(C("title"))), "”"))
    base = given(database, joined(", ", m.text(C("database")), m.text(link())), ".")
    return joined(" ", m.text(stopped(people)), title, given(held != "", held, "."), base)


def chicago(m: Mark = PLAIN) -> Column:
    def inverted(people: str) -> Column:
        return F.transform(people, lambda p, i: F.when(i == 0, last_full(p)).otherwise(full_last(p)))

    def listed(n: Column) -> Column:
        size = F.size(n)
        every = F.when(size > 1, _cat(F.array_join(F.slice(n, 1, F.greatest(size - 1, F.lit(1))), ", "), ", and ", F.element_at(n, -1))).otherwise(F.get(n, F.lit(0)))
        return F.when(size > 10, _cat(F.array_join(F.slice(n, 1, 7), ", "), ", et al")).when(C("others"), _cat(F.array_join(n, ", "), ", et al")).otherwise(every)

    def edited(n: Column) -> Column:
        size = F.size(n)
        return F.when(size > 1, _cat(F.array_join(F.slice(n, 1, F.greatest(size - 1, F.lit(1))), ", "), ", and ", F.element_at(n, -1), ", eds")).otherwise(_cat(F.get(n, F.lit(0)), ", ed"))

    people = F.when(_has("authors"), let(inverted("authors"), listed)).when(_has("editors"), let(inverted("editors"), edited)).otherwise("")
    year = _pick(C("year"), F.lit("n.d."))
    quoted = _cat("“", m.text(stopped(C("title"))), "”")
    dated = given(_has("year"), joined(" ", issue_month("full"), m.text(C("year"))))
    numbers = joined(" ", m.italic(C("container")), m.text(C("volume")))
    journal = _cat(joined(", ", numbers, given(_has("issue"), "no. ", m.text(C("issue")))), " (", _pick(dated, F.lit("n.d.")), ")", given(_has("pages"), ": ", m.text(en_dash(C("pages")))))
    imprint = m.text(stopped(joined(", ", place_publisher(), year)))
    editors = m.text(join_and(_names("editors", full_last), "and", True))
    by = given(_has("editors"), F.when(_has("container"), "edited by ").otherwise("Edited by "), editors)
    within = joined(", ", given(_has("container"), "In ", m.italic(C("container"))), by, given(_has("pages"), m.text(en_dash(C("pages")))))
    degree = F.when(C("genre").rlike(MASTERS), "Master's thesis").otherwise("PhD diss.")
    undated = _is("web") & ~_has("year") & (accessed() != "")
    at = F.when(_is("thesis"), joined(", ", degree, _pick(C("institution"), C("publisher")), C("year"))).otherwise(joined(", ", host(), F.when(undated, "").otherwise(year)))
    body = (
        F.when(_is("journal"), joined(" ", quoted, stopped(F.trim(journal))))
        .when(_is("book"), joined(" ", stopped(m.italic(C("title"))), m.text(stopped(edition_label(C("edition")))), imprint))
        .when(_is("chapter", "proceedings"), joined(" ", quoted, stopped(within), imprint))
        .otherwise(joined(" ", quoted, m.text(stopped(at)), given(undated, "Accessed ", accessed(), ".")))
    )
    source = _cat(C("database"), given(_has("accession"), " (", C("accession"), ")"))
    end = F.when(_has("doi"), link()).when(_has("database"), source).otherwise(link())
    return joined(" ", m.text(stopped(people)), body, given(end != "", m.text(end), "."))


def harvard(m: Mark = PLAIN) -> Column:
    name = lambda p: last_init(p, "", False)

    def listed(people: str, one: Callable) -> Column:
        return F.when(F.size(people) > 3, _cat(one(F.get(people, F.lit(0))), " et al.")).otherwise(join_and(_names(people, one), "and", False))

    label = F.when(F.size("editors") > 1, " (eds)").otherwise(" (ed.)")
    authors = F.when(C("others"), _cat(name(F.get("authors", F.lit(0))), " et al.")).otherwise(listed("authors", name))
    editors = given(_has("editors"), listed("editors", name), label)
    people = F.when(_has("authors"), authors).otherwise(_pick(editors, given(_is("web"), C("container"))))
    year = _cat("(", _pick(C("year"), F.lit("no date")), ")")
    imprint = m.text(stopped(place_publisher()))
    book = F.when(_has("edition"), joined(", ", m.italic(C("title")), m.text(stopped(edition_label(C("edition"), "harvard"))))).otherwise(stopped(m.italic(C("title"))))
    quoted = _cat("‘", m.text(C("title")), "’")
    editing = given(_has("editors"), m.text(listed("editors", lambda p: init_last(p, "", False))), label, " ")
    chapter = F.when(_has("container"), _cat(quoted, ", in ", editing, stopped(m.italic(C("container"))))).otherwise(_cat(quoted, "."))
    tail = m.text(stopped(joined(", ", place_publisher(), given(_has("pages"), pp(C("pages"))))))
    degree = F.when(C("genre").rlike(r"(?i)^ph\.?\s?d\.?$") | ~_has("genre"), "PhD").otherwise(C("genre"))
    thesis = F.when(degree.rlike("(?i)thesis|dissertation"), degree).otherwise(_cat(degree, " thesis"))
    thesis = joined(" ", stopped(m.italic(C("title"))), m.text(stopped(thesis)), m.text(stopped(_pick(C("institution"), C("publisher")))))
    report = joined(" ", stopped(m.italic(C("title"))), given(_is("report"), m.text(stopped(joined(": ", C("place"), _pick(C("publisher"), C("institution")))))))
    holder = F.when(_has("container"), m.italic(C("container"))).otherwise(given(~_is("journal"), m.text(host())))
    pages = given(_has("pages"), F.when(C("article"), _cat("article ", m.text(C("pages")))).otherwise(m.text(pp(C("pages")))))
    other = stopped(joined(", ", quoted, holder, _cat(m.text(C("volume")), given(_has("issue"), "(", m.text(C("issue")), ")")), m.text(shown_publisher()), pages))
    body = F.when(_is("book"), joined(" ", book, imprint)).when(_is("chapter", "proceedings"), joined(" ", chapter, tail)).when(_is("thesis"), thesis).when(_is("report", "web"), report).otherwise(other)
    return joined(" ", m.text(people), year, body, given(link() != "", "Available at: ", m.text(link()), given(accessed(True) != "", " (Accessed: ", accessed(True), ").")))


def vancouver(m: Mark = PLAIN) -> Column:
    persons, bodies = F.filter("authors", lambda p: ~p["literal"]), F.filter("authors", lambda p: p["literal"])
    listed = let(F.transform(persons, nlm), lambda n: F.when(F.size(n) > 6, _cat(F.array_join(F.slice(n, 1, 6), ", "), ", et al")).otherwise(F.array_join(n, ", ")))
    authors = joined("; ", listed, F.array_join(F.transform(bodies, nlm), ", "))
    authors = let(authors, lambda a: F.when(C("others") & ~a.contains("et al"), _cat(a, ", et al")).otherwise(a))
    label = F.when(F.size("editors") > 1, ", editors").otherwise(", editor")
    editors = given(_has("editors"), F.array_join(_names("editors", nlm), ", "), label)
    people = F.when(_has("authors"), authors).otherwise(editors)
    imprint = _cat(place_publisher(), given(_has("year"), "; ", C("year")))
    when = given(_has("year"), joined(" ", C("year"), month_name(C("month"), "nlm"), given((C("month") > 0) & (C("day") > 0), C("day").cast("string"))))
    issue = m.text(C("issue"))
    numbers = F.when(_has("volume"), _cat(";", m.text(C("volume")), given(_has("issue"), "(", issue, ")"))).otherwise(given(_has("issue"), ";", F.when(C("issue").rlike("^[0-9]+$"), _cat("(", issue, ")")).otherwise(issue)))
    tail = F.regexp_replace(_cat(when, numbers, given(_has("pages"), ":", m.text(nlm_pages(C("pages"))))), "^[;:]", "")
    name = m.text(stopped(_pick(C("short_container"), C("container"))))
    journal = F.when(tail != "", _cat(joined(" ", name, tail), ".")).otherwise(name)
    counted = given(C("num_pages").rlike("^[0-9]+$"), C("num_pages"), " p.")
    edition = m.text(edition_label(C("edition")))
    within = given(_has("container"), "In: ", given(_has("editors"), m.text(editors), ". "), m.text(stopped(C("container"))))
    chapter = joined(" ", within, edition, given(_has("volume"), "Vol. ", m.text(C("volume")), "."), m.text(stopped(imprint)), given(_has("pages"), "p. ", m.text(nlm_pages(C("pages"))), "."))
    other = m.text(stopped(joined("; ", F.regexp_replace(host(), r"\.$", ""), C("year"))))
    body = F.when(_is("journal"), journal).when(_is("book"), joined(" ", edition, m.text(stopped(imprint)), counted)).when(_is("chapter", "proceedings"), chapter).otherwise(other)
    return joined(" ", m.text(stopped(people)), m.text(stopped(C("title"))), body, given(_has("doi"), "doi: ", m.text(C("doi")), "."))


def ieee(m: Mark = PLAIN) -> Column:
    first = init_last(F.get("authors", F.lit(0)))
    authors = F.when(C("others") | (F.size("authors") > 6), _cat(first, " et al.")).otherwise(join_and(_names("authors", init_last), "and"))
    listed = join_and(_names("editors", init_last), "and")
    label = F.when(F.size("editors") > 1, ", Eds.").otherwise(", Ed.")
    people = F.when(_has("authors"), authors).otherwise(given(_has("editors"), listed, label))
    dated = given(_has("year"), joined(" ", month_name(C("month"), "ieee"), m.text(C("year"))))
    edition = m.text(edition_label(C("edition")))
    doi = given(_has("doi"), "doi: ", m.text(C("doi")))
    imprint = joined(", ", place_publisher(), C("year"))
    title = F.when(_has("edition"), joined(", ", m.italic(C("title")), edition)).otherwise(stopped(m.italic(C("title"))))
    book = joined(" ", title, stopped(joined(", ", m.text(imprint), doi)))
    quoted = _cat("“", m.text(C("title")), ",”")
    named = C("container").rlike(r"(?i)\bvol\.?\s*[0-9]") & C("container").contains(C("volume"))
    editing = given(_has("editors"), ", ", m.text(listed), label, ",")
    held = given(_has("container"), " in ", m.italic(C("container")), given(_has("volume") & ~named, ", vol. ", m.text(C("volume"))), editing)
    tail = joined(", ", m.text(place_publisher()), dated, given(_has("pages"), m.text(pp(C("pages")))), doi)
    between = (
        F.when(_has("editors"), joined(" ", F.lit(" "), edition, F.lit(" "))).when(_has("edition"), _cat(", ", edition, " "))
        .when(ends_punct(C("container")), " ").when(_is("proceedings"), ", ").otherwise(". ")
    )
    between = F.regexp_replace(between, "^  +", " ")
    between = F.regexp_replace(between, "  +$", " ")
    chapter = F.when(_has("container") & (tail != ""), _cat(quoted, held, between, stopped(tail))).when(_has("container"), stopped(_cat(quoted, held))).otherwise(joined(" ", quoted, stopped(tail)))
    holder = F.when(_has("container"), m.italic(C("container"))).otherwise(given(~_is("journal"), m.text(host())))
    rest = joined(
        ", ", holder, given(_has("volume"), "vol. ", m.text(C("volume"))), given(_has("issue"), "no. ", m.text(C("issue"))), given(_has("pages") & ~C("article"), m.text(pp(C("pages")))),
        m.text(shown_publisher()), dated, given(_has("pages") & C("article"), "Art. no. ", m.text(C("pages"))), doi,
    )
    body = F.when(_is("book"), book).when(_is("chapter", "proceedings"), chapter).otherwise(stopped(joined(" ", quoted, rest)))
    return joined(" ", given(people != "", m.text(people), ","), body, given(~_has("doi") & (link() != ""), "[Online]. Available: ", m.text(link())))


def carnegie(m: Mark = PLAIN) -> Column:
    lead = lambda people: F.transform(people, lambda p, i: F.when(i == 0, last_init(p, "")).otherwise(init_last(p, "")))
    authors = let(join_and(lead("authors"), "and", True, ","), lambda a: F.when(C("others"), _cat(a, ", et al")).otherwise(a))
    label = lambda one, more: F.when(F.size("editors") > 1, more).otherwise(one)
    people = F.when(_has("authors"), authors).otherwise(given(_has("editors"), join_and(lead("editors"), "and", True, ","), label(" (ed.)", " (eds.)")))
    pages = hyphen(C("pages"))
    imprint = stopped(joined(", ", C("publisher"), C("place")))
    editing = given(_has("editors"), " (", join_and(_names("editors", lambda p: init_last(p, "")), "and"), label(", ed.)", ", eds.)"))
    edited = stopped(joined(", ", C("title"), edition_label(C("edition"), "carnegie")))
    counted = given(C("num_pages").rlike("^[0-9]+$"), C("num_pages"), " pp.")
    volume = given(_has("volume"), C("volume"), given(_has("issue"), "(", C("issue"), ")"))
    journal = stopped(F.when(_has("volume") & _has("pages"), joined(", ", C("container"), joined(":", volume, pages))).otherwise(joined(", ", C("container"), volume, pages)))
    serial = _has("volume") & (_has("series") | _has("publisher"))
    numbered = joined(" ", given(_has("container"), "In ", C("container"), editing, "."), _cat(_pick(C("series"), C("publisher")), ", ", C("volume"), given(_has("pages"), ":", pages), "."))
    held = F.when(_has("container"), stopped(_cat(F.when(_has("pages"), _cat("Pp. ", pages, ", in ")).otherwise("In "), C("container"), editing))).otherwise(given(_has("pages"), "Pp. ", pages, "."))
    held = F.when(_has("container") & _has("editors"), _cat(F.when(_has("pages"), _cat("Pp. ", pages, ", in ")).otherwise("In "), C("container"), editing, ".")).otherwise(held)
    chapter = joined(" ", stopped(C("title")), F.when(serial, numbered).otherwise(joined(" ", held, imprint)))
    genre = (
        F.when(~_has("genre"), "Ph.D. Dissertation").when(C("genre").rlike("(?i)thesis|dissertation"), C("genre"))
        .when(C("genre").rlike("(?i)^m|master"), _cat(C("genre"), " Thesis")).otherwise(_cat(C("genre"), " Dissertation"))
    )
    thesis = joined(" ", stopped(C("title")), stopped(joined(", ", _cat("Unpublished ", genre), _pick(C("publisher"), C("institution")), C("place"))))
    available = given(_has("doi") | _has("url"), "Available from ", link())
    preprint = joined(" ", stopped(C("title")), given(host() != "", host(), " preprint."), available)
    series = stopped(joined(" ", _pick(C("series"), given(_is("report"), C("container"))), C("number")))
    report = joined(" ", stopped(C("title")), series, stopped(joined(", ", _pick(C("publisher"), C("institution")), C("place"))), counted)
    cited = F.when(C("accessed.year") > 0, _cat(C("title"), " [cited ", accessed(True), "].")).otherwise(stopped(C("title")))
    web = joined(" ", cited, stopped(host()), available)
    body = (
        F.when(_is("journal"), joined(" ", edited, journal)).when(_is("book"), joined(" ", edited, imprint, counted)).when(_is("chapter", "proceedings"), chapter).when(_is("thesis"), thesis)
        .when(_is("preprint"), preprint).when(_is("report") | (~_is("web") & ~_has("doi") & ~_has("url")), report).otherwise(web)
    )
    return m.text(joined(" ", stopped(people), given(_has("year"), C("year"), "."), given(~_has("year"), "n.d."), body))


STYLES = {"apa": apa, "mla": mla, "chicago": chicago, "harvard": harvard, "vancouver": vancouver, "ieee": ieee, "carnegie": carnegie}
NUMBERED = ("vancouver", "ieee")
AUTHOR_DATE = ("apa", "harvard", "carnegie")


def _cited(style: str, word: str, oxford: bool) -> Column:
    """Surnames in a sentence: the first alone from the style's length of list."""
    least = {"harvard": 4, "chicago": 4}.get(style, 3)
    people = F.when(_has("authors"), C("authors")).otherwise(C("editors"))

    def of(family: Column) -> Column:
        return F.when(F.size(family) == 0, "").when(C("others") | (F.size(family) >= least), _cat(F.get(family, F.lit(0)), " et al.")).otherwise(join_and(family, word, oxford))

    return let(F.transform(people, lambda p: p["family"]), of)


def short_title() -> Column:
    """The title, or what stands before its colon if that is short; without one, what the work belongs to."""
    main = F.regexp_extract(C("title"), r"^(.*?):\s+", 1)
    short = F.when((main != "") & (F.size(F.split(main, r"\s+")) <= 5), main).otherwise(C("title"))
    return _pick(short, C("container"), C("doi"), F.lit("Untitled"))


def in_text(style: str = "apa", form: str = "paren", pages: str = "", number: Column | None = None) -> Column:
    """A citation in a sentence: ``paren``, ``narrative`` (APA, Harvard), a number, or Chicago's ``note`` and ``short`` note."""
    part = F.when(_is("journal", "chapter", "proceedings", "web", "thesis"), _cat("“", short_title(), "”")).otherwise(short_title())
    located, bare = (pp(F.lit(pages)), en_dash(F.lit(pages))) if pages else (F.lit(""), F.lit(""))
    year = _pick(C("year"), F.lit("no date" if style == "harvard" else "n.d."))
    if style in ("apa", "harvard"):
        narrative = form == "narrative"
        who = _pick(_cited(style, "&" if style == "apa" and not narrative else "and", False), part)
        when = joined(", ", year, located)
        return _cat(who, " (", when, ")") if narrative else _cat("(", joined(", ", who, when), ")")
    if style == "mla":
        return _cat("(", joined(" ", _pick(_cited(style, "and", False), part), bare), ")")
    if style == "carnegie":
        family = F.transform(F.when(_has("authors"), C("authors")).otherwise(C("editors")), lambda p: p["family"])
        who = let(family, lambda f: F.when(F.size(f) > 2, _cat(F.get(f, F.lit(0)), " et al.")).otherwise(F.array_join(f, " and ")))
        return _cat("(", _pick(who, C("container"), F.lit("Anon.")), " ", year, given(bare != "", ":", bare), ")")
    n = (number if number is not None else F.lit(1)).cast("string")
    if style == "vancouver":
        return _cat("(", n, ")")
    if style == "ieee":
        return _cat("[", joined(", ", n, located), "]")
    if style != "chicago":
        raise ValueError(f"no citations in style {style}")
    return _short_note(bare) if form == "short" else _note(bare)


def _short_note(bare: Column) -> Column:
    whole = ~_is("journal", "chapter", "proceedings", "web", "thesis")
    title = F.when(whole, joined(", ", short_title(), bare)).otherwise(_cat("“", short_title(), F.when(bare == "", "”").otherwise(_cat(",” ", bare))))
    return _cat(joined(", ", _cited("chicago", "and", True), title), ".")


def _note(bare: Column) -> Column:
    def listed(people: str) -> Column:
        return F.when(F.size(people) >= 4, _cat(full_last(F.get(people, F.lit(0))), " et al.")).otherwise(join_and(_names(people, full_last), "and"))

    authors = F.when(C("others"), _cat(full_last(F.get("authors", F.lit(0))), " et al.")).otherwise(listed("authors"))
    people = F.when(_has("authors"), authors).otherwise(given(_has("editors"), listed("editors"), F.when(F.size("editors") > 1, ", eds.").otherwise(", ed.")))
    title = _pick(C("title"), short_title())
    quoted = _cat("“", title, F.when(title.rlike("[?!]$") | _is("thesis"), "").otherwise(","), "”")
    year = _pick(C("year"), F.lit("n.d."))
    imprint = _cat(" (", joined(", ", place_publisher(), year), ")")
    dated = given(_has("year"), joined(" ", issue_month("full"), C("year")))
    page = F.when(bare != "", joined(", ", bare, given(C("article"), C("pages")))).otherwise(en_dash(C("pages")))
    numbers = joined(" ", joined(", ", joined(" ", C("container"), C("volume")), given(_has("issue"), "no. ", C("issue"))), _cat("(", _pick(dated, F.lit("n.d.")), ")"))
    journal = joined(" ", quoted, joined(": ", numbers, page))
    by = given(_has("editors") & _has("authors"), "ed. ", join_and(_names("editors", full_last), "and"))
    within = joined(", ", given(_has("container"), "in ", C("container")), by)
    chapter = joined(", ", _cat(joined(" ", quoted, within), imprint), _pick(bare, en_dash(C("pages"))))
    degree = F.when(C("genre").rlike(MASTERS), "Master's thesis").otherwise("PhD diss.")
    thesis = joined(", ", _cat(quoted, " (", joined(", ", degree, _pick(C("institution"), C("publisher")), C("year")), ")"), bare)
    book = joined(", ", _cat(joined(", ", title, edition_label(C("edition"))), imprint), bare)
    other = joined(", ", joined(" ", quoted, joined(", ", host(), year)), bare)
    when = F.when(_has("year"), joined(", ", joined(" ", month_name(C("month")), given(C("day") > 0, C("day").cast("string"))), C("year"))).otherwise(given(accessed() != "", "accessed ", accessed()))
    web = joined(", ", quoted, C("container"), when)
    body = F.when(_is("journal"), journal).when(_is("book"), book).when(_is("chapter", "proceedings"), chapter).when(_is("thesis"), thesis).when(_is("web"), web).otherwise(other)
    base = _cat(C("database"), given(_has("accession"), " (", C("accession"), ")"))
    note = joined(", ", people, body, F.when(_has("doi"), link()).when(_has("database"), base).otherwise(link()))
    return _cat(F.replace(note, F.lit(",”, "), F.lit(",” ")), ".")


#: Title words that a key passes over (fixed values).
SMALL = "the|and|for|with|from|into|over|under|that|this|are|was|were|its|our|their"
BIB_ESCAPES = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "{": r"\{", "}": r"\}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_"}


def bib_escape(col: Column) -> Column:
    """Characters that BibTeX reads as commands, written so that it prints them."""
    each = F.create_map(*[F.lit(x) for pair in BIB_ESCAPES.items() for x in pair])
    return F.when(col.rlike(r"[\\~^{}&%$#_]"), F.array_join(F.transform(F.split(col, ""), lambda c: F.coalesce(F.element_at(each, c), c)), "")).otherwise(col)


def bib_protect(title: Column) -> Column:
    """Words with capitals in braces, but a plain capitalised first one: styles that lower titles keep them."""
    words = F.transform(F.split(title, " "), lambda w, i: F.when((F.lower(w) == w) | ((i == 0) & (F.lower(F.substring(w, 2, 200)) == F.substring(w, 2, 200))), w).otherwise(_cat("{", w, "}")))
    return F.array_join(words, " ")


def bib_name(p: Column) -> Column:
    part = lambda c: F.when(c.rlike(r"(?i)\sand\s"), _cat("{", bib_escape(c), "}")).otherwise(bib_escape(c))
    named = F.when(p["suffix"] != "", joined(" ", _cat(part(p["family"]), ", ", bib_escape(p["suffix"]), ","), part(p["given"]))).otherwise(joined(", ", part(p["family"]), part(p["given"])))
    return F.when(p["literal"], _cat("{", bib_escape(p["family"]), "}")).otherwise(named)


def bib_key() -> Column:
    """First surname, year and first telling word of the title."""
    words = F.filter(F.transform(F.split(C("title"), r"[\s‐-―/-]+"), ascii_key), lambda w: w.rlike("[A-Za-z]{3,}") & ~w.rlike(f"(?i)^(?:{SMALL})$"))
    family = ascii_key(F.coalesce(F.get("authors", F.lit(0))["family"], F.get("editors", F.lit(0))["family"], F.lit("")))
    first = lambda w, k: F.coalesce(F.get(w, F.lit(k)), F.lit(""))
    return let(words, lambda w: F.when(family != "", _cat(family, C("year"), first(w, 0))).otherwise(_cat(F.initcap(_pick(first(w, 0), F.lit("ref"))), C("year"), first(w, 1))))


def host_publisher() -> Column:
    return F.when(_has("institution") & ~_has("container"), C("institution")).otherwise(C("publisher"))


def _lines(by: str, *rows: Column) -> Column:
    return F.array_join(F.filter(F.array(*rows), lambda x: x != ""), by)


def bibtex() -> Column:
    kinds = (
        F.when(_is("journal"), "article").when(_is("chapter"), "incollection").when(_is("book"), "book").when(_is("proceedings"), "inproceedings")
        .when(_is("thesis") & C("genre").rlike(MASTERS), "mastersthesis").when(_is("thesis"), "phdthesis").when(_is("report"), "techreport").otherwise("misc")
    )
    field = lambda key, value: given(value != "", f"  {key} = {{", value, "}")
    text = lambda key, value: field(key, bib_escape(value))
    people = lambda name: F.array_join(F.transform(name, bib_name), " and ")
    braced = lambda value: F.replace(F.replace(value, F.lit("{"), F.lit("%7B")), F.lit("}"), F.lit("%7D"))
    container = F.when(_is("journal"), text("journal", C("container"))).when(_is("chapter", "proceedings"), text("booktitle", C("container")))
    container = container.when(_is("book"), given(C("container") != C("series"), text("series", C("container")))).otherwise(text("howpublished", C("container")))
    body = F.when(_is("thesis"), text("school", _pick(C("publisher"), C("institution")))).when(_is("report"), text("institution", _pick(C("publisher"), C("institution")))).otherwise(text("publisher", host_publisher()))
    note = F.when(_is("preprint", "dataset", "software", "standard"), _cat("  note = {", F.initcap("kind"), "}")).otherwise("")
    month = given(C("month") > 0, "  month = ", F.lower(month_name(C("month"), "nlm")))
    rows = [
        field("title", bib_protect(bib_escape(C("title")))), field("author", people("authors")), field("editor", people("editors")), container, text("series", C("series")),
        given(_is("report"), text("number", C("number"))), text("edition", C("edition")), text("volume", C("volume")), text("number", C("issue")), text("pages", F.replace(en_dash(C("pages")), F.lit("–"), F.lit("--"))),
        given(C("article"), text("eid", C("pages"))), text("year", C("year")), month, body, text("address", C("place")), field("issn", C("issn")), field("isbn", C("isbn")), field("doi", braced(C("doi"))),
        field("url", braced(link())), note, text("abstract", C("abstract")),
    ]
    return _cat("@", kinds, "{", bib_key(), ",\n", _lines(",\n", *rows), "\n}")


def _tagged_name(p: Column) -> Column:
    return F.when(p["literal"], _cat(F.replace(p["family"], F.lit(","), F.lit(",,")), ",")).otherwise(last_full(p))


RIS_TYPES = {"journal": "JOUR", "chapter": "CHAP", "book": "BOOK", "proceedings": "CONF", "preprint": "UNPB", "dataset": "DATA", "software": "COMP", "thesis": "THES", "report": "RPRT", "standard": "STAND", "web": "ELEC"}
ENDNOTE_TYPES = {
    "journal": "Journal Article", "chapter": "Book Section", "book": "Book", "proceedings": "Conference Paper", "preprint": "Unpublished Work", "dataset": "Dataset", "software": "Computer Program",
    "thesis": "Thesis", "report": "Report", "standard": "Standard", "web": "Web Page",
}


def _typed(types: dict[str, str], encyclopedia: str, dictionary: str, other: str) -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for pair in types.items() for x in pair]), C("kind"))
    return F.when(C("type").isin("reference-entry", "entry-encyclopedia", "entry"), encyclopedia).when(C("type") == "entry-dictionary", dictionary).otherwise(F.coalesce(known, F.lit(other)))


def ris() -> Column:
    end = "\r\n"
    row = lambda tag, value: given(value != "", f"{tag}  - ", value)
    people = lambda tag, name: F.array_join(F.transform(name, lambda p: _cat(f"{tag}  - ", _tagged_name(p))), end)
    first, last = (F.regexp_extract(C("pages"), r"^(.+?)\s*[-–—]\s*(.+)$", k) for k in (1, 2))
    pages = F.when(last != "", _cat("SP  - ", first, end, "EP  - ", last)).otherwise(row("SP", C("pages")))
    two = lambda n: given(n > 0, F.lpad(n.cast("string"), 2, "0"))
    rows = [
        _cat("TY  - ", _typed(RIS_TYPES, "ENCYC", "DICT", "GEN")), people("AU", "authors"), people("ED", "editors"), row("TI", C("title")), row("T2", C("container")), row("T3", C("series")), row("ET", C("edition")),
        given(C("short_container") != C("container"), row("JO", C("short_container"))), row("VL", C("volume")), row("IS", C("issue")), pages, row("PY", C("year")),
        given(_has("year"), "DA  - ", C("year"), "/", two(C("month")), "/", two(C("day")), "/"), row("PB", host_publisher()), row("CY", C("place")), row("SN", C("isbn")), row("SN", C("issn")), row("DO", C("doi")),
        row("UR", link()), row("LA", C("language")), row("AB", C("abstract")), row("DP", C("database")), row("AN", C("accession")), F.lit("ER  - "),
    ]
    return _cat(_lines(end, *rows), end)


def endnote() -> Column:
    row = lambda tag, value: given(value != "", f"%{tag} ", value)
    people = lambda tag, name: F.array_join(F.transform(name, lambda p: _cat(f"%{tag} ", _tagged_name(p))), "\n")
    rows = [
        _cat("%0 ", _typed(ENDNOTE_TYPES, "Encyclopedia", "Dictionary", "Generic")), people("A", "authors"), people("E", "editors"), row("T", C("title")),
        F.when(_is("journal"), row("J", C("container"))).otherwise(row("B", C("container"))), row("S", C("series")), row("7", C("edition")), row("V", C("volume")), row("N", C("issue")), row("P", hyphen(C("pages"))),
        row("D", C("year")), row("8", joined(" ", month_name(C("month")), given((C("month") > 0) & (C("day") > 0), C("day").cast("string")))), row("I", host_publisher()), row("C", C("place")), row("@", C("isbn")),
        row("@", C("issn")), row("R", C("doi")), row("U", link()), row("G", C("language")), row("X", C("abstract")), row("W", C("database")), row("M", C("accession")),
    ]
    return _cat(_lines("\n", *rows), "\n")


EXPORTS = {"bibtex": bibtex, "ris": ris, "endnote": endnote}


def render(works: DataFrame, form: str, html: bool = False) -> DataFrame:
    """(id, text) of every work in a style or export format; an unknown one is an error.

    Marks in titles (scripts, italics) are kept as HTML or LaTeX has them, and as Unicode has them elsewhere.
    """
    if form in STYLES:
        text = STYLES[form](HTML) if html else marks_to_text(STYLES[form](PLAIN))
    elif form in EXPORTS:
        text = (marks_to_latex if form == "bibtex" else marks_to_text)(EXPORTS[form]())
    else:
        raise ValueError(f"unknown style: {form}")
    return harden(works).select("id", text.alias("text"))


__all__ = ["AUTHOR_DATE", "EXPORTS", "HTML", "NUMBERED", "PLAIN", "STYLES", "doi_url", "in_text", "is_range", "render", "short_title"]
