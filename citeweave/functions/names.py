"""Names of people and organisations: parts, initials, orders, lists.

A person is {family, given, suffix, literal}; an organisation or a single name has
``literal`` true and its whole name in ``family``. Empty is '', never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import let

PERSON = "struct<family:string,given:string,suffix:string,literal:boolean>"
#: Lower-case particles of family names, suffixes and degrees (fixed values).
PARTICLES = "van|von|de|der|den|del|della|delle|da|di|du|la|le|los|las|dos|das|ter|ten|zu|zur|af|av"
SUFFIXES = r"Jr\.?|Sr\.?|II|III|IV|2nd|3rd|4th"
DEGREES = r"Ph\.?\s?D\.?|D\.?Phil\.?|[MBD]\.?Sc\.?|M\.?D\.?|J\.?D\.?|M\.?P\.?H\.?|M\.?B\.?A\.?|D\.?D\.?S\.?|D\.?V\.?M\.?|Esq\.?|FRS|FRCP|FRCS|FACS|RN"
#: Last words of an organisation that a deposit splits like a name, and words that make an author one (fixed values).
ORG_LAST = "Community|Consortium|Collaboration|Team|Group|Project|Society|Committee|Association|Initiative|Network|Institute|Organi[sz]ation|Council"
ORG_WORDS = (
    r"\b(?:Survey|Museum|Society|Institutes?|Institution|University|College|Academy|Association|Organi[sz]ation|Commission|Committee|Council|Agency|Administration|Department|Ministry|Office"
    r"|Bureau|Panel|Service|Cent(?:er|re)s?|Laborator(?:y|ies)|Foundation|Consortium|Collaboration|Group|Team|Project|Program(?:me)?|Database|Network|Board|Authority|Corporation|Company|Trust"
    r"|Union|Bank|Nations|Archives?|Gardens?|Canada|Inc|Ltd|GmbH|Press)\b"
)
OTHERS = r"(?i)^(?:et\s+al\.?|and\s+others|others)$"
#: Letters that have a case, and scripts without one whose names have no initials.
CAPITAL = "A-ZÀ-ÖØ-Þ"
CASELESS = r"[֐-׿؀-ۿऀ-ॿ฀-๿ᄀ-ᇿ぀-ヿ一-鿿가-힯]"


def person_of(family: Column, given: Column | None = None, suffix: Column | None = None, literal: Column | None = None) -> Column:
    text = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    return F.struct(text(family).alias("family"), text(given).alias("given"), text(suffix).alias("suffix"), (literal if literal is not None else F.lit(False)).alias("literal"))


def is_degree(col: Column, sure: bool = False) -> Column:
    """An academic degree; one all in capitals may be initials unless ``sure``."""
    return col.rlike(f"(?i)^(?:{DEGREES})$") & (F.lit(sure) | col.rlike("[a-z]"))


def is_suffix(col: Column) -> Column:
    return col.rlike(f"^(?:{SUFFIXES})$")


def is_particle(col: Column) -> Column:
    return col.rlike(f"^(?:{PARTICLES})$")


def is_organisation(col: Column) -> Column:
    """Words of an organisation, unless the name is shaped like a person's: ``Press, William H.``, ``Bank JA``."""
    shaped = col.rlike(r"^[A-Z]\S*,\s*(?:[A-Z][a-z]+|[A-Z]\.?)(?:[\s.\-]*[A-Z]\.?)*$") | col.rlike(r"^[A-Z][a-z]+(?:\s[A-Z][a-z]+)?\s[A-Z]{1,3}$")
    return F.regexp_extract(col, "^[^,]*", 0).rlike(ORG_WORDS) & ~shaped


def uncaps(col: Column) -> Column:
    """A name written in capitals in title case; any other as it is."""
    raised = F.array_join(F.transform(F.regexp_extract_all(F.lower(col), F.lit(r"[\s\-']|[^\s\-']+"), F.lit(0)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 200))), "")
    return F.when((F.char_length(col) > 1) & (F.upper(col) == col) & (F.lower(col) != col), raised).otherwise(col)


def split_name(col: Column) -> Column:
    """A name as displayed: ``Georg Kucsko``, ``de la Cruz, Ana``, ``King, Martin Luther, Jr.``, ``John Smith, PhD``."""
    degree = rf"(?i),\s*(?:{DEGREES})(?=,|$)"
    plain_degree = r"\s+(?:Ph\.?\s?D\.?|D\.?Phil\.?|[MBD]\.?Sc\.?|Esq\.?)$"

    def of(name: Column) -> Column:
        bare = F.when(name.rlike(r"^\S+\s+\S.*,|^[^,]+,[^,]+,"), F.regexp_replace(name, degree, "")).otherwise(F.regexp_replace(name, r",\s*(?:Ph\.?D\.?|D\.?Phil\.?|[MBD]\.?Sc\.?|Esq\.?)$", ""))
        return let(F.when(bare.contains(","), bare).otherwise(F.regexp_replace(bare, plain_degree, "")), parts)

    def parts(name: Column) -> Column:
        suffix = F.regexp_extract(name, rf"[\s,]({SUFFIXES})$", 1)
        rest = F.regexp_replace(name, rf"[\s,]+(?:{SUFFIXES})$", "")
        return F.when(rest.contains(","), let(rest, lambda r: person_of(F.regexp_extract(r, r"^([^,]*?)\s*,", 1), F.regexp_extract(r, r",\s*(.*)$", 1), suffix))).otherwise(let(rest, lambda r: natural(r, suffix)))

    return let(F.trim(col), of)


def natural(rest: Column, suffix: Column) -> Column:
    """``Given particle Family``; one word alone is a literal name."""
    family = F.regexp_extract(rest, rf"(?:^|\s)((?:(?:{PARTICLES})\s+)*\S+)$", 1)
    given = F.trim(F.left(rest, F.char_length(rest) - F.char_length(family)))
    return F.when(rest.rlike(r"\s"), person_of(family, given, suffix)).otherwise(person_of(rest, F.lit(""), suffix, (suffix == "")))


def tagged_name(col: Column) -> Column:
    """An author of a tagged file: ``Family, Given, Suffix``, ``Smith JA``, ``Organisation,``; null for "et al."."""

    def of(name: Column) -> Column:
        piece = lambda k: F.trim(F.get(F.split(name, ","), F.lit(k)))
        initials_last = name.rlike(r"^\S+(?:\s+\S+)*\s+[A-Z]{1,3}$") & (name.rlike("[a-z].*\\s") | name.rlike(r"^[A-Z]{3,}\s+[A-Z]{1,2}$"))
        family = F.regexp_extract(name, r"^(.*)\s+[A-Z]{1,3}$", 1)
        dotted = F.regexp_replace(F.regexp_extract(name, r"\s([A-Z]{1,3})$", 1), "([A-Z])", "$1. ")
        return (
            F.when((name == "") | name.rlike(OTHERS), None)
            .when(name.rlike(r",\s*$"), person_of(F.regexp_replace(F.regexp_replace(name, r",\s*$", ""), ",,", ","), literal=F.lit(True)))
            .when(is_organisation(name), person_of(name, literal=F.lit(True)))
            .when(name.contains(","), person_of(piece(0), piece(1), F.array_join(F.transform(F.slice(F.split(name, ","), 3, 9), lambda x: F.trim(x)), ", ")))
            .when(initials_last, person_of(family, F.trim(dotted)))
            .otherwise(split_name(name))
        )

    return let(F.trim(F.coalesce(col, F.lit(""))), of)


def bib_names(col: Column) -> Column:
    """People of a BibTeX field: parted by ``and`` outside braces; ``{Organisation}`` is one name."""
    word = r"(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|[^{}\s])+"
    pieces = F.regexp_extract_all(col, F.lit(rf"(?i)(?:^|\sand\s+)((?:(?!and\s){word}(?:\s+(?!and\s)|$)?)+)"), F.lit(1))

    def of(name: Column) -> Column:
        bare = lambda c: F.trim(F.translate(c, "{}", ""))
        part = lambda k: bare(F.get(F.split(name, ","), F.lit(k)))
        count = F.size(F.split(name, ","))
        return (
            F.when(name.rlike(r"^\{.*\}$"), person_of(bare(name), literal=F.lit(True)))
            .when(count == 2, person_of(part(0), part(1)))
            .when(count > 2, person_of(part(0), part(2), part(1)))  # the suffix stands second
            .otherwise(split_name(bare(name)))
        )

    return F.transform(F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(OTHERS)), of)


def person(family: Column, given: Column, suffix: Column) -> Column:
    """A deposited person set right: suffixes in a wrong field, capitals, glued initials, organisations."""

    def of(p: Column) -> Column:
        fam, giv = p["family"], p["given"]
        in_family = F.regexp_extract(fam, rf"(?i)^(.+?),\s*({SUFFIXES})$", 2)
        in_given = F.regexp_extract(giv, rf"^(.*?\S)[\s,]+({SUFFIXES})$", 2)
        own = F.coalesce(F.nullif(p["suffix"], F.lit("")), F.nullif(in_family, F.lit("")), F.nullif(in_given, F.lit("")), F.lit(""))
        fam = F.when(in_family != "", F.regexp_replace(fam, r",\s*[^,]*$", "")).otherwise(fam)
        giv = F.when(in_given != "", F.regexp_replace(giv, rf"[\s,]+(?:{SUFFIXES})$", "")).otherwise(giv)
        return let(F.struct(fam.alias("family"), giv.alias("given"), own.alias("suffix")), named)

    def named(p: Column) -> Column:
        fam, giv = p["family"], p["given"]
        organisation = (giv != "") & (giv.rlike(r"^The\s") | fam.rlike(f"^(?:{ORG_LAST})$"))
        caps = (F.upper(giv) == giv) & (F.lower(giv) != giv) & (F.char_length(giv) > 1)
        family_caps = (F.upper(fam) == fam) & (F.lower(fam) != fam)
        word = lambda w: F.when(w.contains(".") | (w.rlike("^[A-Z]{1,3}$") & ~w.rlike("[AEIOUY]")) | (~family_caps & (F.char_length(w) < 3)), w).otherwise(uncaps(w))
        recased = F.when(caps, F.array_join(F.transform(F.split(giv, r"\s+"), word), " ")).otherwise(giv)
        return (
            F.when(organisation, person_of(F.concat(giv, F.lit(" "), fam), literal=F.lit(True)))
            .when((giv == "") & (p["suffix"] == ""), person_of(F.replace(fam, F.lit(",,"), F.lit(",")), literal=F.lit(True)))
            .otherwise(person_of(uncaps(fam), recased, p["suffix"]))
        )

    hyphen = lambda c: F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[‐‑]", "-")
    spaced = F.regexp_replace(hyphen(given), r"([a-zß-öø-ÿ])([A-Z])\.(?=[\s.A-Z]|$)", "$1 $2.")
    lettered = let(spaced, lambda g: F.when(g.rlike(r"\p{L}"), g).otherwise(""))
    return let(F.struct(hyphen(family).alias("family"), lettered.alias("given"), F.trim(F.coalesce(suffix, F.lit(""))).alias("suffix")), of)


def initials(given: Column, dot: str = ".", space: str = " ") -> Column:
    """``Jean-Paul`` is ``J.-P.``, ``Eva Maria`` ``E. M.``, ``PC`` ``P. C.``; nicknames and conjunctions don't count.

    A name in a script without letter case is kept whole.
    """
    plain = F.regexp_replace(F.regexp_replace(given, r"\s*(?:\([^()]*\)|\"[^\"]*\"|“[^”]*”)\s*", " "), r"(^|\s)(?:'[^'\s][^']*'|‘[^’]*’)(?=\s|$)", "$1")
    spaced = F.trim(F.regexp_replace(plain, r"\.(?![\-‐‑])", ". "))
    words = F.filter(F.transform(F.split(spaced, r"\s+"), lambda w: F.regexp_replace(w, r"^[\-‐‑]+|[\-‐‑.]+$", "")), lambda w: (w != "") & ~w.rlike("(?i)^(?:&|and)$"))
    split = F.flatten(F.transform(words, lambda w: F.when(w.rlike(f"^[{CAPITAL}]{{2,3}}$"), F.split(w, "")).otherwise(F.array(w))))

    def one(w: Column) -> Column:
        parts = F.filter(F.split(F.replace(w, F.lit("."), F.lit("")), r"[\-‐‑]"), lambda q: q != "")
        hyphened = F.concat(F.array_join(F.transform(parts, lambda q: F.upper(F.left(q, F.lit(1)))), f"{dot}-"), F.lit(dot))
        return F.when(w.rlike(CASELESS), w).otherwise(hyphened)

    joined = lambda ws: F.when(F.exists(ws, lambda w: w.rlike(CASELESS)), F.array_join(ws, " ")).otherwise(F.array_join(ws, space))
    return F.coalesce(let(F.transform(split, one), joined), F.lit(""))


def join_and(names: Column, word: str = "and", oxford: bool = True, pair: str = "") -> Column:
    """0, 1, 2 and more names; ``pair`` stands before the word between two."""

    def of(n: Column) -> Column:
        size = F.size(n)
        head, last = F.array_join(F.slice(n, 1, F.greatest(size - 1, F.lit(1))), ", "), F.element_at(n, -1)
        return (
            F.when(size <= 0, "").when(size == 1, F.get(n, F.lit(0))).when(size == 2, F.concat(F.get(n, F.lit(0)), F.lit(f"{pair} {word} "), last))
            .otherwise(F.concat(head, F.lit(f"{',' * oxford} {word} "), last))
        )

    return let(names, lambda n: F.when(F.size(n) > 0, of(n)).otherwise(""))


def _suffixed(p: Column, by: str = ", ") -> Column:
    return F.when(p["suffix"] != "", F.concat(F.lit(by), p["suffix"])).otherwise("")


def _led(lead: Column, by: str, rest: Column) -> Column:
    """Both parts with ``by`` between, or the one there is."""
    return F.when(lead == "", rest).when(rest == "", lead).otherwise(F.concat(lead, F.lit(by), rest))


def _initials_of(p: Column, dot: str, space: str) -> Column:
    """Initials of a person that a record holds already (``ini``), in another form: stops and blanks away, but a caseless name stays."""
    out = p["ini"]
    for away, kept in ((" ", space), (".", dot)):
        out = out if kept == away else F.replace(out, F.lit(away), F.lit(kept))
    return out if (dot, space) == (".", " ") else F.when(p["given"].rlike(CASELESS), p["ini"]).otherwise(out)


def last_init(p: Column, space: str = " ", suffix: bool = True) -> Column:
    """``King, M. L., Jr.``"""
    made = F.concat(_led(p["family"], ", ", _initials_of(p, ".", space)), _suffixed(p) if suffix else F.lit(""))
    return F.when(p["literal"], p["family"]).otherwise(made)


def init_last(p: Column, space: str = " ", suffix: bool = True) -> Column:
    """``M. L. King, Jr.``"""
    made = F.concat(_led(_initials_of(p, ".", space), " ", p["family"]), _suffixed(p) if suffix else F.lit(""))
    return F.when(p["literal"], p["family"]).otherwise(made)


def last_full(p: Column) -> Column:
    """``King, Martin Luther, Jr.``"""
    return F.when(p["literal"], p["family"]).otherwise(F.concat(_led(p["family"], ", ", p["given"]), _suffixed(p)))


def full_last(p: Column) -> Column:
    """``Martin Luther King Jr.``"""
    return F.when(p["literal"], p["family"]).otherwise(F.concat(_led(p["given"], " ", p["family"]), _suffixed(p, " ")))


def nlm(p: Column) -> Column:
    """``King ML Jr``, ``Frei E 3rd``; initials without hyphens or stops."""
    bare = F.replace(p["suffix"], F.lit("."), F.lit(""))
    number = F.coalesce(F.element_at(F.create_map(*map(F.lit, ("II", "2nd", "III", "3rd", "IV", "4th"))), F.upper(bare)), bare)
    made = F.concat(_led(p["family"], " ", _initials_of(p, "", "")), F.when(p["suffix"] != "", F.concat(F.lit(" "), number)).otherwise(""))
    return F.when(p["literal"], p["family"]).otherwise(made)


def reference_authors(text: Column) -> Column:
    """People of a reference's strict ``Family, I.`` list before its first year; empty if any part is none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*(?:\[[0-9]{1,4}\]|[0-9]{1,4}[.)])\s+", "")
    head = F.regexp_extract(bare, r"^(.{2,300}?)[\s,]*\(?(?:1[5-9]|20)[0-9]{2}[a-z]?\)?(?=[\s.,;:)]|$)", 1)
    listed = F.regexp_replace(F.regexp_replace(head, r"[\s,(]+$", ""), r"(?i),?\s*et\s+al\.?$", "")
    parts = F.split(listed, r"\s*;\s*|,?\s+(?:and|&)\s+")
    good = r"^(?:\p{Lu}[\p{L}'’-]+(?:\s+\p{Lu}[\p{L}'’-]+)*,\s*(?:(?:\p{Lu}\.\s?-?\s?)+|\p{Lu}\p{Ll}+(?:\s+\p{Lu}\.)*)(?:,\s*|$))+$"
    pair = r"(\p{Lu}[\p{L}'’-]+(?:\s+\p{Lu}[\p{L}'’-]+)*),\s*((?:\p{Lu}\.\s?-?\s?)+|\p{Lu}\p{Ll}+(?:\s+\p{Lu}\.)*)(?:,\s*|$)"

    def of(p: Column) -> Column:
        families, givens = (F.regexp_extract_all(p, F.lit(pair), F.lit(k)) for k in (1, 2))
        return F.zip_with(families, givens, lambda f, g: person_of(f, F.trim(g)))

    people = let(parts, lambda ps: F.when(F.forall(ps, lambda p: p.rlike(good)), F.flatten(F.transform(ps, of))))
    return F.coalesce(people, F.array().cast(f"array<{PERSON}>"))
