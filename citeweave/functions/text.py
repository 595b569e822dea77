"""Cleaning, folding, spelling and tokens. Null in, null out unless stated."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import let


def _folded_letters() -> tuple[str, str]:
    """Letters that decompose to one ASCII letter and marks, and that letter: Latin blocks and full-width forms."""
    found = {}
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F)):
        for code in block:
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
            if len(plain) == 1 and plain.isascii():
                found[chr(code)] = plain
    return "".join(found), "".join(found.values())


#: Accented and full-width letters and what they fold to, made by the rule of Unicode decomposition.
ACCENTED, PLAIN = _folded_letters()
#: Letters without a decomposition (fixed values), and ligatures.
LETTERS = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i"}
PAIRS = (
    ("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th"),
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st"),
)
#: Named entities of deposited titles (fixed values).
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "alpha": "α", "beta": "β", "gamma": "γ", "Gamma": "Γ", "delta": "δ", "Delta": "Δ", "epsilon": "ε", "epsi": "ε",
    "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "Theta": "Θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "Lambda": "Λ", "mu": "μ", "nu": "ν", "xi": "ξ", "Xi": "Ξ",
    "pi": "π", "Pi": "Π", "rho": "ρ", "sigma": "σ", "Sigma": "Σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "Phi": "Φ", "chi": "χ", "psi": "ψ", "Psi": "Ψ", "omega": "ω", "Omega": "Ω",
    "micro": "µ", "minus": "−", "ndash": "–", "mdash": "—", "times": "×", "deg": "°", "plusmn": "±", "middot": "·", "prime": "′", "Prime": "″", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "hellip": "…", "le": "≤", "ge": "≥", "rarr": "→", "harr": "↔", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß",
    "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó", "uacute": "ú", "agrave": "à", "egrave": "è", "ntilde": "ñ", "ccedil": "ç", "Aring": "Å", "aring": "å", "oslash": "ø",
    "Oslash": "Ø",
}
#: Characters spelled out in braces by some publishers (fixed values).
PLACEHOLDERS = {
    "middle dot": "·", "bullet": "•", "times": "×", "degree": "°", "degrees": "°", "plus minus": "±", "plus or minus": "±", "minus": "−", "en dash": "–", "em dash": "—", "prime": "′",
    "double prime": "″", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "Delta": "Δ", "epsilon": "ε", "mu": "μ", "micro": "µ", "sigma": "σ", "Sigma": "Σ", "lambda": "λ", "pi": "π",
    "theta": "θ", "omega": "ω", "Omega": "Ω", "approximately": "≈", "less than or equal to": "≤", "greater than or equal to": "≥", "square": "□", "box": "□", "right arrow": "→", "rightarrow": "→",
}
#: British to American spellings, applied one after another (fixed values).
SPELLINGS = (
    ("sulph", "sulf"), ("ae(?!l)", "e"), ("oe(?!l)", "e"), ("our$", "or"), ("i[sz]ation$", "ization"), ("i[sz]e[sd]?$", "ize"),
    ("y[sz]e[sd]?$", "yze"), ("(t|b)re$", "$1er"), ("ll(?=[iea])", "l"), ("mme$", "m"), ("logue$", "log"),
)
#: Cyrillic letters in Latin script (fixed values); the first row one to one, then those of several letters.
CYRILLIC, LATIN = "абвгдеёзийклмнопрстуфыэіґў", "abvgdeeziyklmnoprstufyeigu"
CYRILLIC_MORE = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "ї": "yi", "є": "ye"}
CJK = r"぀-ヿ㐀-鿿가-힯"
#: Raised and lowered digits and signs, and the plain ones.
SCRIPTS, SCRIPTS_PLAIN = "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻₊₋", "01234567890123456789+-+-"
TAG = r"</?[A-Za-z][\w:.-]*(?:\s[^<>]*)?/?>|(?s:<!--.*?-->)"
SCRIPT_NAMES = ("Latin", "Cyrillic", "Greek", "CJK")


def to_ascii(col: Column) -> Column:
    """Letters folded, all else kept: García is Garcia, ø is o, ligatures are their letters."""
    return let(col, lambda c: F.when(F.octet_length(c) == F.char_length(c), c).otherwise(_folded(c)))


def _folded(col: Column) -> Column:
    out = F.regexp_replace(F.translate(col, ACCENTED + "".join(LETTERS), PLAIN + "".join(LETTERS.values())), r"[̀-ͯ]", "")
    for letter, pair in PAIRS:
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def fold(col: Column) -> Column:
    """Lower case without accents."""
    return F.lower(to_ascii(col))


def ascii_key(col: Column) -> Column:
    """Folded letters and digits alone, in their case: for keys."""
    return F.regexp_replace(to_ascii(col), "[^A-Za-z0-9]", "")


def fold_map(col: Column) -> Column:
    """{folded, at}: folded letters and digits, and where each stood (from 0)."""
    each = F.transform(F.split(col, ""), lambda c, i: F.struct(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]", "").alias("c"), i.alias("i")))
    kept = F.filter(each, lambda x: x["c"] != "")
    places = F.flatten(F.transform(kept, lambda x: F.transform(F.split(x["c"], ""), lambda _: x["i"])))
    return F.struct(F.array_join(F.transform(kept, lambda x: x["c"]), "").alias("folded"), places.alias("at"))


def translit(col: Column) -> Column:
    """Lower-case Cyrillic letters in Latin script."""
    out = F.translate(col, CYRILLIC, LATIN)
    for letter, latin in CYRILLIC_MORE.items():
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def tokens(col: Column, least: int = 3) -> Column:
    """Folded runs of letters and digits of at least ``least`` characters, in order."""
    words = F.regexp_extract_all(fold(F.translate(col, SCRIPTS, SCRIPTS_PLAIN)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(words, lambda w: F.char_length(w) >= least)


def _pairs_of(run: Column) -> Column:
    """A run of CJK characters: its pairs, and the characters of one of up to four."""
    n = F.char_length(run)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(pairs, F.when(n <= 4, F.split(run, "")).otherwise(F.array().cast("array<string>")))


def match_tokens(col: Column, latin: bool = True, markup: bool = True) -> Column:
    """Tokens by which texts of all scripts are matched.

    Words of three characters or more; a Cyrillic word is followed by its Latin form (if
    ``latin``); a run of CJK characters gives its pairs (and its characters, if up to four).
    Without ``markup`` the text is taken as clean.
    """
    text = F.replace(fold(F.translate(clean(col) if markup else F.coalesce(col, F.lit("")), SCRIPTS, SCRIPTS_PLAIN)), F.lit("ё"), F.lit("е"))
    runs = F.regexp_extract_all(text, F.lit(rf"[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"), F.lit(0))

    def one(w: Column) -> Column:
        other = translit(w)
        word = F.when(w.rlike("[Ѐ-ӿ]") & (other != w) & (F.char_length(other) >= 3), F.array(w, other)).otherwise(F.array(w)) if latin else F.array(w)
        return F.when(w.rlike(rf"[{CJK}]"), _pairs_of(w)).when(F.char_length(w) >= 3, word).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(runs, one))


def fold_spelling(col: Column) -> Column:
    """One spelling for variants of words of six letters or more; all rules apply, in order."""
    out = col
    for pattern, new in SPELLINGS:
        out = F.regexp_replace(out, pattern, new)
    return F.when(F.char_length(col) >= 6, out).otherwise(F.when(col == "grey", "gray").otherwise(col))


def _named(names: dict[str, str]) -> Column:
    """A constant map: folded once, and one node of the plan instead of two an entry."""
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _pieces(text: Column, pattern: str, one) -> Column:
    """The text with every piece of the pattern put through ``one``."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one), "")


def decode_entities(col: Column) -> Column:
    """Named and numeric entities, encoded up to four times over, and braced placeholders.

    A number that stands for no character (zero, a surrogate, private use) gives nothing.
    """

    def char(e: Column) -> Column:
        code = F.when(e.rlike("^&#[xX]"), F.conv(F.regexp_extract(e, "([0-9a-fA-F]+);$", 1), 16, 10).cast("int")).otherwise(F.regexp_extract(e, "([0-9]+);$", 1).cast("int"))
        good = lambda n: (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF) & ~n.between(0xE000, 0xF8FF) & (n < 0xF0000)
        return let(code, lambda n: F.when(good(n), F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")).otherwise(""))

    def entity(e: Column) -> Column:
        return F.when(e.rlike("^&#"), char(e)).when(e.rlike("^&.+;$"), F.coalesce(F.element_at(_named({f"&{k};": v for k, v in ENTITIES.items()} | {"&amp;": "&"}), e), e)).otherwise(e)

    def placed(text: Column) -> Column:
        filled = _pieces(text, r"\{[A-Za-z ]{2,25}\}|[^{]+|\{", lambda p: F.coalesce(F.element_at(_named({f"{{{k}}}": v for k, v in PLACEHOLDERS.items()}), p), p))
        return F.when(text.contains("{"), filled).otherwise(text)

    def decoded(text: Column) -> Column:
        once = F.regexp_replace(text, r"&(?:amp;){1,4}(?=(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z]+);)", "&")
        return F.when(text.contains("&"), _pieces(once, r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);|[^&]+|&", entity)).otherwise(text)

    return let(let(col, placed), decoded)


def strip_tags(col: Column, by: str = "") -> Column:
    """Real tags only: a bare ``<`` before a digit or blank is text."""
    return F.regexp_replace(col, TAG, by)


def scrub(col: Column) -> Column:
    """Zero-width, direction and private-use characters away; joiners are spelling and stay."""
    return F.regexp_replace(col, "[\\x{200B}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{FEFF}\\x{E000}-\\x{F8FF}]", "")


def clean(col: Column) -> Column:
    """Tags away, entities decoded, white space single, none before closing marks; null is empty."""
    text = F.coalesce(col, F.lit(""))
    encoded = F.regexp_replace(text, r"&lt;(/?(?:i|b|em|strong|sub|sup|p|title|scp|jats:[a-z]+)(?:\s[^<>&]*)?)&gt;", "<$1>")
    flat = F.regexp_replace(scrub(decode_entities(strip_tags(encoded))), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(flat, r" ([,;:.!?])(?= |$)", "$1"))


def trim_punct(col: Column) -> Column:
    """Marks that a catalogue leaves behind a place or publisher."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"[\s,:;/]+$", ""))


def clean_abstract(col: Column) -> Column:
    return F.regexp_replace(clean(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?i)</(?:jats:p|jats:title|jats:sec|p|title|sec)>", " ")), r"(?i)^(?:Abstract|Summary)\b[\s.:]*", "")


def colon_space(col: Column) -> Column:
    return F.regexp_replace(col, r"\s+:(?=\s)", ":")


def clean_place(col: Column) -> Column:
    """``[Chicago]`` is Chicago; ``[S.l.]`` (no place) is empty."""
    bare = F.trim(F.regexp_replace(trim_punct(col), r"^\[([^\[\]]*)\]$", "$1"))
    return let(bare, lambda p: F.when(p.rlike(r"(?i)^(?:s\.\s?l\.?|sine loco|n\.\s?p\.?)$"), "").otherwise(p))


def clean_container(col: Column) -> Column:
    """Without its one full stop at the end; one that closes an abbreviation stays."""
    return let(trim_punct(colon_space(clean(col))), lambda c: F.when(c.rlike(r"^[^.]*[^.]\.$"), F.regexp_replace(c, r"\.$", "")).otherwise(c))


def ends_punct(col: Column) -> Column:
    return F.coalesce(col.rlike("[.?!][”’\"']?$"), F.lit(False))


def dot(col: Column) -> Column:
    """A full stop behind a text that has none; nothing behind nothing."""
    return let(F.coalesce(col, F.lit("")), lambda c: F.when((c == "") | ends_punct(c), c).otherwise(F.concat(c, F.lit("."))))


def escape_html(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def pdf_cleanup(col: Column) -> Column:
    """Text of a page: ligatures as letters, special blanks as blanks, controls and soft hyphens away."""
    out = col
    for letter, pair in PAIRS[7:]:
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.regexp_replace(F.regexp_replace(out, "[\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\t]", " "), "[\\x{0000}-\\x{0008}\\x{000B}\\x{000C}\\x{000E}-\\x{001F}\\x{00AD}]", "")


def mojibake(col: Column) -> Column:
    """A line of UTF-8 that was read as Windows-1252 or Latin-1, read anew; any other as it stands."""

    def again(text: Column) -> Column:
        latin = F.translate(text, CP1252, CP1252_CODES)
        raw = F.when(~latin.rlike("[^\\x{0000}-\\x{00FF}]"), F.encode(latin, "ISO-8859-1").cast("string"))
        suspect = text.rlike("[ÃÂÄÅÐÑâ][\\x{0080}-\\x{00BF}" + CP1252 + "]")
        return F.when(suspect, F.coalesce(let(raw, lambda r: F.when(F.is_valid_utf8(r), r)), text)).otherwise(text)

    return let(col, again)


#: Windows-1252 characters of the codes 128 to 159 that have one, and those codes (made by rule).
CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") for b in range(128, 160))
CP1252_CODES = "".join(chr(b) for b in range(128, 160) if bytes([b]).decode("cp1252", "ignore"))


def script_letters(col: Column, script: str) -> Column:
    if script == "CJK":
        return F.char_length(F.regexp_replace(col, f"[^{CJK}]", ""))
    return F.char_length(F.regexp_replace(col, rf"[^\p{{Is{script}}}]", ""))


def dominant_script(col: Column) -> Column:
    """The script with most letters; of equal ones the first of ``SCRIPT_NAMES``; null without letters."""
    counts = F.array(*[F.struct(script_letters(col, s).alias("n"), F.lit(-i).alias("order"), F.lit(s).alias("name")) for i, s in enumerate(SCRIPT_NAMES)])
    return let(F.array_max(counts), lambda m: F.when(m["n"] > 0, m["name"]))


def hits_ratio(have: Column, want: Column) -> Column:
    """Share of the distinct wanted words that occur."""
    wanted = F.array_distinct(want)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(F.array_distinct(have), wanted)) / F.size(wanted)).otherwise(F.lit(0.0))


def one_edit(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion, exchange or swap of neighbours makes ``a`` into ``b`` (or none)."""
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.char_length(a), F.char_length(b)), F.lit(1))), lambda i: (F.left(a, i) == F.left(b, i)) & (i <= F.char_length(a))))
    swapped = F.concat(F.left(a, shared), F.substring(a, shared + 2, F.lit(1)), F.substring(a, shared + 1, F.lit(1)), F.substring(a, shared + 3, F.char_length(a)))
    return (F.levenshtein(a, b) <= 1) | (swapped == b)
