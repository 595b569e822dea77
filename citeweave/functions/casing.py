"""Case of titles: what they are in, and the other case, with a dictionary given as sets of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import let

#: Words that a title in title case keeps small (fixed values).
SMALL = "a an and as at but by for from in into nor of off on onto or over per the to up via vs with without".split()
LATIN = ("in vitro", "in vivo", "in situ", "et al", "sensu lato", "sensu stricto", "incertae sedis", "a priori", "per se", "de novo", "ex situ", "ad hoc")
ROMAN = r"^(?=[MDCLXVI])(?:X{0,3})(?:IX|IV|V?I{0,3})$"


def words_of(title: Column) -> Column:
    """Words, marks and blanks of a title, in order; joiners, apostrophes and inner stops stay inside words."""
    return F.regexp_extract_all(title, F.lit(r"<[^<>]+>|&[A-Za-z#0-9]+;|[\p{L}\p{N}]+(?:[-'’.‐/][\p{L}\p{N}]+)*\.?|\s+|[^\s\p{L}\p{N}]"), F.lit(0))


def _is_word(w: Column) -> Column:
    return w.rlike(r"^[\p{L}\p{N}]")


def case_of(title: Column) -> Column:
    """upper, title, sentence or mixed; null without words.

    Of the words that could be small (four letters or more, not the first of a sentence), three
    quarters capitalised make a title, less than two fifths a sentence.
    """

    def of(words: Column) -> Column:
        inner = F.filter(words, lambda w, i: (i > 0) & (F.char_length(w) >= 4) & w.rlike(r"^\p{L}") & (F.upper(w) != w))
        capital = F.size(F.filter(inner, lambda w: w.rlike(r"^\p{Lu}")))
        letters = F.regexp_replace(F.array_join(words, ""), r"[^\p{L}]", "")
        upper = F.char_length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) >= 0.8 * F.char_length(letters)
        share = F.try_divide(capital, F.size(inner))
        return F.when(letters == "", None).when(upper & (F.char_length(letters) > 3), "upper").when(share >= 0.75, "title").when(share.isNull() | (share < 0.4), "sentence").otherwise("mixed")

    return let(F.filter(words_of(F.coalesce(title, F.lit(""))), _is_word), of)


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 500))


def to_title_case(title: Column) -> Column:
    """Words capitalised but small ones inside; words with capitals or digits in them, and Latin phrases, stay."""

    def of(words: Column) -> Column:
        n = F.size(words)
        restarts = lambda i: (i == 0) | F.coalesce(F.get(words, i - 2).rlike("[:?!.]$") | F.get(words, i - 1).rlike("[:?!(“\"]$"), F.lit(False))
        phrase = lambda w, i: F.concat(F.lower(w), F.lit(" "), F.coalesce(F.lower(F.get(words, i + 2)), F.lit(""))).isin(*LATIN) | F.concat(F.coalesce(F.lower(F.get(words, i - 2)), F.lit("")), F.lit(" "), F.lower(w)).isin(*LATIN)
        hyphened = lambda w: F.array_join(F.transform(F.split(w, "-"), lambda p, k: F.when((k > 0) & p.isin(*SMALL), p).otherwise(_capital(p))), "-")
        one = lambda w, i: (
            F.when(~_is_word(w) | F.substring(w, 2, 500).rlike(r"\p{Lu}|[0-9]") | w.rlike("^[0-9]") | phrase(w, i), w)
            .when(F.lower(w).isin(*SMALL) & ~restarts(i) & (i < n - 1), F.lower(w)).otherwise(hyphened(w))
        )
        return F.array_join(F.transform(words, one), "")

    return let(words_of(F.coalesce(title, F.lit(""))), of)


def to_sentence_case(title: Column, common: Column, names: Column) -> Column:
    """Words that ``common`` holds made small, but a sentence's first; those in ``names``, with inner capitals or digits stay.

    ``common`` and ``names`` are arrays of small words. A title in sentence case already, and
    what stands in quotes, is left as it is; unknown capitalised words are made small in a
    title in title case only if their stem (-s, -es, -ed, -ing, -ly) is common.
    """

    def of(words: Column) -> Column:
        stem = lambda w: F.regexp_replace(w, "(?:ies|es|s|ed|ing|ly)$", "")
        restarts = lambda i: (i == 0) | F.coalesce(F.get(words, i - 2).rlike("[:?!]$") | F.get(words, i - 1).rlike("[:?!“\"]$"), F.lit(False))

        def known(w: Column) -> Column:
            parts = F.split(F.lower(w), "[-‐]")
            return F.forall(parts, lambda p: F.array_contains(common, p) | F.array_contains(common, stem(p)) | F.array_contains(common, F.concat(stem(p), F.lit("e"))) | p.isin(*SMALL))

        plain = lambda w: _is_word(w) & ~F.substring(w, 2, 500).rlike(r"\p{Lu}|[0-9]") & ~F.array_contains(names, F.lower(w)) & ~w.rlike(ROMAN)
        return F.array_join(F.transform(words, lambda w, i: F.when(plain(w) & ~restarts(i) & known(w), F.lower(w)).otherwise(w)), "")

    return let(F.coalesce(title, F.lit("")), lambda t: F.when(case_of(t) == "sentence", t).otherwise(let(words_of(t), of)))


#: Chemical elements (fixed values).
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re "
    "Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu"
).split()
