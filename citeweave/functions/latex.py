"""LaTeX in fields as text."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import let

#: Accent commands and their combining marks; letters and symbols of commands (fixed values).
ACCENTS = {
    "`": "\u0300", "'": "\u0301", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "d": "\u0323", "b": "\u0331", "k": "\u0328", "r": "\u030a",
}
LETTERS = {
    "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "mu": "μ", "pi": "π", "sigma": "σ", "omega": "ω", "Delta": "Δ", "Gamma": "Γ", "Omega": "Ω", "times": "×", "pm": "±",
    "textendash": "–", "textemdash": "—", "ldots": "…", "dots": "…", "textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^", "copyright": "©", "degree": "°",
}


def _accented() -> dict[str, str]:
    """Every accent command on a letter that has a composed form, by the rule of Unicode composition."""
    made = {}
    for command, mark in ACCENTS.items():
        for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzıȷ":
            composed = unicodedata.normalize("NFC", {"ı": "i", "ȷ": "j"}.get(letter, letter) + mark)
            if len(composed) == 1:
                made[command + letter] = composed
    return made


def de_latex(col: Column) -> Column:
    """Accents, letters, symbols, scripts, dashes and quotes as characters; other commands and braces away."""
    accents, letters = (F.from_json(F.lit(json.dumps(m)), "map<string,string>") for m in (_accented(), LETTERS))
    accent = r"\\([`'^\"~=.]|[uvHcdbkr](?=[\s{]))\s*\{?\\?([A-Za-zıȷ])\}?"
    word = r"\\([A-Za-z]+)(?![A-Za-z])(?:\{\}|\s)?"

    def each(text: Column, pattern: str, one) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(rf"(?s){pattern}|[^\\]+|\\"), F.lit(0))
        return F.array_join(F.transform(pieces, one), "")

    def composed(p: Column) -> Column:
        key = F.concat(F.regexp_extract(p, accent, 1), F.regexp_extract(p, accent, 2))
        return F.coalesce(F.element_at(accents, key), F.when(p.rlike(f"^(?:{accent})$"), F.regexp_extract(p, accent, 2)), p)

    def named(p: Column) -> Column:
        return F.when(p.rlike(f"^(?:{word})$"), F.coalesce(F.element_at(letters, F.regexp_extract(p, word, 1)), F.lit(""))).otherwise(p)

    def of(text: Column) -> Column:
        done = let(each(text, accent, composed), lambda t: each(F.regexp_replace(t, r"\\([&%$#_{}])", "\u0002$1"), word, named))
        for old, new in (("---", "—"), ("--", "–"), ("``", "“"), ("''", "”"), ("~", " "), ("$", "")):
            done = F.replace(done, F.lit(old), F.lit(new))
        bare = F.regexp_replace(F.regexp_replace(done, "(?<!\u0002)[{}]", ""), r"\\ ", " ")
        return F.trim(F.regexp_replace(F.replace(bare, F.lit("\u0002"), F.lit("")), r"\s+", " "))

    return let(F.coalesce(col, F.lit("")), lambda t: F.when(t.rlike(r"[\\{}~$]|--|``|''"), of(t)).otherwise(F.trim(t)))
