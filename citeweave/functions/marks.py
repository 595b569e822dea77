"""Markup of titles: deposited tags, MathML and TeX as marks in the text, and marks as plain text, HTML or LaTeX.

A title with markup is a text with six marks, one to open and one to close subscripts,
superscripts and italics. Tags and MathML are read by one machine: a fold over tags and texts
whose state is the stack of open elements, each with what it holds so far; an element that
closes is put into the one around it. Marks are characters that Unicode reserves for use inside
programs, so no text brings its own.

A null title is empty. A closing tag that doesn't fit the open element, and an element that
never closes, give their texts without marks; so does one inside another of its kind. Elements
more than ``DEPTH`` deep are read as text of the one around them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import let
from citeweave.functions.casing import ELEMENTS
from citeweave.functions.text import ENTITIES, _named, _pieces, clean, escape_html

#: Marks: subscript, superscript, italics, each opened and closed; and what parts MathML's scripts behind from those before.
SUB, SUB_END, SUP, SUP_END, ITALIC, ITALIC_END, BEFORE = (chr(0xFDD0 + i) for i in range(7))
OPENS, CLOSES = SUB + SUP + ITALIC, SUB_END + SUP_END + ITALIC_END
ALL = OPENS + CLOSES + BEFORE
DEPTH = 48
#: Tags that mark text, and elements of MathML whose children have places (fixed values).
TAGS = {"sub": (SUB, SUB_END), "inf": (SUB, SUB_END), "sup": (SUP, SUP_END), "i": (ITALIC, ITALIC_END), "em": (ITALIC, ITALIC_END), "italic": (ITALIC, ITALIC_END)}
PLACED = ("msub", "msup", "msubsup", "mmultiscripts")
#: Tags that may arrive with their brackets as entities (fixed values).
ENCODED = "i|b|em|strong|sub|sup|inf|sc|scp|u|italic|bold|span|math|mi|mo|mn|msub|msup|msubsup|mrow|mtext|mmultiscripts|mprescripts|none|inline-formula|disp-formula|tex-math|alternatives"
#: Commands of TeX and their characters (fixed values); Greek letters are those of the named entities.
TEX = {
    "times": "×", "cdot": "·", "pm": "±", "mp": "∓", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "sim": "∼", "simeq": "≃", "infty": "∞",
    "rightarrow": "→", "to": "→", "leftarrow": "←", "leftrightarrow": "↔", "rightleftharpoons": "⇌", "prime": "′", "circ": "∘", "degree": "°", "partial": "∂", "nabla": "∇", "sum": "∑",
    "prod": "∏", "int": "∫", "propto": "∝", "ell": "ℓ", "hbar": "ℏ", "AA": "Å", "ast": "*", "star": "⋆", "bullet": "•", "ldots": "…", "cdots": "⋯", "dots": "…", "varphi": "φ",
    "vartheta": "ϑ", "varepsilon": "ε", "varrho": "ϱ", "varsigma": "ς", "upmu": "μ", "textmu": "µ", "square": "□", "Box": "□", "langle": "⟨", "rangle": "⟩", "vert": "|", "mid": "|",
    "parallel": "∥", "perp": "⊥", "in": "∈", "subset": "⊂", "cup": "∪", "cap": "∩",
} | {name: char for name, char in ENTITIES.items() if "Ͱ" <= char <= "Ͽ"}
#: Characters that have a lowered or raised form (fixed values).
LOWERED = ("0123456789+-−=()xni", "₀₁₂₃₄₅₆₇₈₉₊₋₋₌₍₎ₓₙᵢ")
RAISED = ("0123456789+-−=()nim", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁻⁼⁽⁾ⁿⁱᵐ")
_ELEMENT = "(?:" + "|".join(sorted(ELEMENTS, key=lambda e: (-len(e), e))) + ")"
#: Symbols that read as English words: one of them alone before a blank is none of a formula.
_WORDLIKE = "(?:In|As|At|No|Be|He|I|Am|Ho|Es|Pa|Po|Os|U|Y|W)"
_FORMULA_GOES_ON = rf"(?=[)\],;:.{OPENS}]|\([A-Z□]|(?!{_WORDLIKE}\s)(?:{_ELEMENT})+(?:[\s0-9()\[\],<+−·\-{ALL}]|$))"


def _frame(name: Column, kids: Column) -> Column:
    return F.struct(name.alias("name"), kids.alias("kids"))


def _put(stack: Column, text: Column) -> Column:
    """``text`` into the innermost open element: as a child of its own where places count."""
    top = F.element_at(stack, -1)
    kids = F.when(top["name"].isin(*PLACED), F.concat(top["kids"], F.array(text))).otherwise(F.array(F.concat(F.coalesce(F.get(top["kids"], F.lit(0)), F.lit("")), text)))
    return F.concat(F.slice(stack, 1, F.size(stack) - 1), F.array(_frame(top["name"], kids)))


def _low(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(SUB), text, F.lit(SUB_END))).otherwise("")


def _high(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(SUP), text, F.lit(SUP_END))).otherwise("")


def _scripts(kids: Column) -> Column:
    """Pairs of (below, above) as marks."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(kids) - 1, F.lit(0)), F.lit(2)), lambda i: F.concat(_low(F.get(kids, i)), _high(F.get(kids, i + 1))))
    return F.array_join(pairs, "")


def _closed(frame: Column) -> Column:
    """What an element that closes puts into the one around it."""
    name, kids = frame["name"], frame["kids"]
    kid = lambda i: F.coalesce(F.get(kids, F.lit(i)), F.lit(""))
    at = F.array_position(kids, F.lit(BEFORE)).cast("int")
    behind = F.when(at > 0, F.slice(kids, 2, F.greatest(at - 2, F.lit(0)))).otherwise(F.slice(kids, 2, F.size(kids)))
    ahead = F.when(at > 0, F.slice(kids, at + 1, F.size(kids))).otherwise(F.array().cast("array<string>"))
    out = F.when(name == "msub", F.concat(kid(0), _low(kid(1)))).when(name == "msup", F.concat(kid(0), _high(kid(1)))).when(name == "msubsup", F.concat(kid(0), _low(kid(1)), _high(kid(2))))
    out = out.when(name == "mmultiscripts", F.concat(_scripts(ahead), kid(0), _scripts(behind)))
    for tag, (open_, close) in TAGS.items():
        out = out.when(name == tag, F.concat(F.lit(open_), kid(0), F.lit(close)))
    return out.otherwise(F.array_join(kids, ""))


def read_tags(text: Column) -> Column:
    """Tags and MathML of a text as marks."""
    tokens = F.regexp_extract_all(text, F.lit(r"</?[A-Za-z][^<>]*>|[^<]+|<"), F.lit(0))

    def step(stack: Column, token: Column) -> Column:
        tag = F.regexp_extract(token, r"^</?(?:[\w.-]+:)?([A-Za-z][\w-]*)[^<>]*>$", 1)
        name = F.lower(tag)
        in_math, placed = F.exists(stack, lambda f: f["name"] == "math"), F.element_at(stack, -1)["name"].isin(*PLACED)
        fits = (F.element_at(stack, -1)["name"] == name) & (F.size(stack) > 1)
        inner = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(1)))
        return (
            F.when((tag == "") & (in_math | placed) & token.rlike(r"^\s+$"), stack).when(tag == "", _put(stack, token)).when(name == "mprescripts", _put(stack, F.lit(BEFORE))).when(token.endswith("/>"), F.when(placed, _put(stack, F.lit(""))).otherwise(stack))
            .when(token.startswith("</"), F.when(fits, _put(inner, _closed(F.element_at(stack, -1)))).otherwise(stack))
            .when(F.size(stack) <= DEPTH, F.concat(stack, F.array(_frame(name, F.array().cast("array<string>"))))).otherwise(stack)
        )

    root = F.array(_frame(F.lit(""), F.array().cast("array<string>")))
    return F.aggregate(tokens, root, step, lambda stack: F.array_join(F.flatten(F.transform(stack, lambda f: f["kids"])), ""))


def balance(marked: Column) -> Column:
    """Marks without a partner, wrongly crossed or inside another of their kind away, and those that hold nothing."""
    tokens = F.regexp_extract_all(marked, F.lit(f"[{OPENS}{CLOSES}]|[^{OPENS}{CLOSES}]+"), F.lit(0))

    def step(acc: Column, token: Column) -> Column:
        opens, closes = token.rlike(f"^[{OPENS}]$"), token.rlike(f"^[{CLOSES}]$")
        stack, gone, at = acc["stack"], acc["gone"], acc["at"]
        top, nested = F.try_element_at(stack, F.lit(-1)), F.exists(stack, lambda s: (s["mark"] == token) & ~s["idle"])
        fits = F.coalesce(F.translate(top["mark"], OPENS, CLOSES) == token, F.lit(False))
        entry = F.array(F.struct(token.alias("mark"), at.alias("at"), nested.alias("idle")))
        shorter = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        stack_next = F.when(opens, F.concat(stack, entry)).when(closes & fits, shorter).otherwise(stack)
        drop = F.when(opens & nested, F.array(at)).when(closes & (~fits | top["idle"]), F.array(at)).otherwise(F.array().cast("array<int>"))
        return F.struct(stack_next.alias("stack"), F.concat(gone, drop).alias("gone"), (at + 1).alias("at"))

    start = F.struct(F.array().cast("array<struct<mark:string,at:int,idle:boolean>>").alias("stack"), F.array().cast("array<int>").alias("gone"), F.lit(0).alias("at"))
    out = let(F.aggregate(tokens, start, step, lambda acc: F.concat(acc["gone"], F.transform(acc["stack"], lambda s: s["at"]))), lambda gone: F.array_join(F.filter(tokens, lambda t, i: ~F.array_contains(gone, i)), ""))
    for _ in range(3):  # as many kinds may hold one another
        out = F.regexp_replace(out, f"{SUB}{SUB_END}|{SUP}{SUP_END}|{ITALIC}{ITALIC_END}", "")
    return F.when(marked.rlike(f"[{OPENS}{CLOSES}]"), out).otherwise(marked)


def tex_marks(tex: Column) -> Column:
    """TeX of a formula as text with marks: symbols by name, scripts from the inside out, commands and braces away."""
    body = F.regexp_replace(tex, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    body = F.coalesce(F.nullif(F.regexp_extract(body, r"(?s)\\begin\{document\}(.*?)\\end\{document\}", 1), F.lit("")), body)
    for pattern, new in (
        (r"\\(?:documentclass|usepackage)(?:\[[^\]]*\])?\{[^}]*\}|\$\$?|\\[()\[\]]", ""),
        (r"\\(?:mathrm|mathit|mathbf|mathsf|mathtt|mathnormal|text|textrm|textit|textbf|operatorname|mbox|rm|it|bf|boldsymbol|bm|mathup|up)\s*(?=\{)", ""),
        (r"\^\s*\{?\s*\\circ\s*\}?", "°"), (r"\\([%&_#$ ])", "$1"), (r"\\[,;:!]|\\q?quad\b|~", " "), (r"\\(?:left|right|big|Big|bigg|Bigg)\b\s*", ""),
    ):
        body = F.regexp_replace(body, pattern, new)
    command = r"^\\([A-Za-z]+)\s*$"
    named = _pieces(body, r"\\[A-Za-z]+\s*|[^\\]+|\\", lambda p: F.when(p.rlike(command), F.coalesce(F.element_at(_named(TEX), F.regexp_extract(p, command, 1)), F.lit(""))).otherwise(p))

    def once(text: Column, _: Column) -> Column:
        low = F.regexp_replace(text, r"_\s*(?:\{([^{}]*)\}|([^\s{}_^]))", f"{SUB}$1$2{SUB_END}")
        return F.regexp_replace(low, r"\^\s*(?:\{([^{}]*)\}|([^\s{}_^]))", f"{SUP}$1$2{SUP_END}")

    return F.regexp_replace(F.aggregate(F.sequence(F.lit(1), F.lit(10)), named, once), "[{}]", "")


def _joined_lines(marked: Column) -> Column:
    """Line breaks of pretty-printed markup: none inside a formula, a blank elsewhere."""
    isotope = rf"(?={_ELEMENT}(?![a-z]))"
    out = F.regexp_replace(F.regexp_replace(marked, r"\s*\n\s*", "\n"), f"\n(?={SUB})", "")
    out = F.regexp_replace(out, rf"\n({SUP}\s*[0-9]{{1,3}}m?\s*{SUP_END})\n?{isotope}", " $1")
    out = F.regexp_replace(out, rf"({SUP}\s*[0-9]{{1,3}}m?\s*{SUP_END})\n{isotope}", "$1")
    out = F.regexp_replace(out, rf"({SUB_END}|{SUP_END})\n{_FORMULA_GOES_ON}", "$1")
    out = F.regexp_replace(out, f"\n(?={SUP})", "")
    out = F.regexp_replace(out, f"([-‐-‒(\\[/])\n(?=[{OPENS}])", "$1")
    return F.regexp_replace(out, f"([{CLOSES}])\n(?=[-‐-‒)\\]/,.;:])", "$1")


def _apart_italics(marked: Column) -> Column:
    """Blanks that deposits drop around words in italics; a single letter is notation and stays tight."""
    letter = "A-Za-zÀ-ɏ"
    word = f"(?=[{letter}][^{ALL}]+[{letter}]{ITALIC_END})"
    out = F.regexp_replace(marked, f"([{letter}:;,]){ITALIC}{word}", f"$1 {ITALIC}")
    return F.regexp_replace(out, f"({ITALIC}[{letter}][^{ALL}]+[{letter}]{ITALIC_END})([{letter}(])", "$1 $2")


def title_marks(html: Column) -> Column:
    """A deposited title as text with marks."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), f"[{ALL}]", "")
    encoded = rf"(?i)&(?:amp;)?lt;(/?(?:[A-Za-z][\w.-]*:)?(?:{ENCODED})(?:\s(?:[^<>&]|&(?:amp;)?(?:quot|apos);)*)?/?)&(?:amp;)?gt;"
    text = F.regexp_replace(text, encoded, "<$1>")

    def formulas(t: Column) -> Column:
        # Of two renderings of a formula that of MathML stays.
        both = r"(?is)(<(?:[\w.-]+:)?alternatives\b[^<>]*>(?:(?!</(?:[\w.-]+:)?alternatives>).)*?<(?:[\w.-]+:)?math\b(?:(?!</(?:[\w.-]+:)?alternatives>).)*?)<((?:[\w.-]+:)?tex-math)\b[^<>]*>.*?</\2>"
        behind = r"(?is)(<(?:[\w.-]+:)?alternatives\b[^<>]*>(?:(?!</(?:[\w.-]+:)?alternatives>|<(?:[\w.-]+:)?math\b).)*?)<((?:[\w.-]+:)?tex-math)\b[^<>]*>.*?</\2>(?=(?:(?!</(?:[\w.-]+:)?alternatives>).)*?<(?:[\w.-]+:)?math\b)"
        one = F.regexp_replace(F.regexp_replace(t, both, "$1"), behind, "$1")
        tex = r"(?is)<((?:[\w.-]+:)?tex-math)\b[^<>]*>(.*?)</\1>"
        shaped = _pieces(one, rf"{tex}|(?:(?!<(?:[\w.-]+:)?tex-math\b).)+|<", lambda p: F.when(p.rlike(f"^{tex}$"), tex_marks(F.regexp_extract(p, tex, 2))).otherwise(p))
        return F.regexp_replace(F.regexp_replace(shaped, r"(?i)(<(?:[\w.-]+:)?inline-formula\b[^<>]*>)\s+", "$1"), r"(?i)\s+(</(?:[\w.-]+:)?inline-formula>)", "$1")

    text = let(text, lambda t: F.when(t.rlike(r"(?i)<(?:[\w.-]+:)?(?:tex-math|inline-formula|alternatives)\b"), formulas(t)).otherwise(t))
    read = let(text, lambda t: F.when(t.contains("<"), read_tags(t)).otherwise(t))
    return let(let(read, lambda t: _apart_italics(_joined_lines(t))), lambda t: balance(clean(t)))


def script_of(text: Column, forms: tuple[str, str]) -> Column:
    """Characters in their lowered or raised form where they have one; letters only if all of the text's have."""
    plain, shaped = forms
    signs = [(p, s) for p, s in zip(plain, shaped, strict=True) if not p.isalpha()]
    letters = "".join(p for p in plain if p.isalpha())
    return F.when(text.rlike(f"[A-Za-z&&[^{letters}]]"), F.translate(text, "".join(p for p, _ in signs), "".join(s for _, s in signs))).otherwise(F.translate(text, plain, shaped))


def marks_to_text(marked: Column) -> Column:
    """Plain text, with scripts as the characters that Unicode has for them."""
    inner = lambda p: F.substring(p, F.lit(2), F.char_length(p) - 2)
    one = lambda p: F.when(p.rlike(f"^{SUB}.*{SUB_END}$"), script_of(inner(p), LOWERED)).when(p.rlike(f"^{SUP}.*{SUP_END}$"), script_of(inner(p), RAISED)).otherwise(p)
    pieces = _pieces(marked, f"(?s){SUB}[^{SUB}{SUB_END}]*{SUB_END}|{SUP}[^{SUP}{SUP_END}]*{SUP_END}|[^{SUB}{SUP}]+|.", one)
    return F.when(marked.rlike(f"[{ALL}]"), F.regexp_replace(pieces, f"[{ALL}]", "")).otherwise(marked)


def _written(marked: Column, forms: tuple[str, ...]) -> Column:
    for mark, form in zip((SUB, SUB_END, SUP, SUP_END, ITALIC, ITALIC_END), forms, strict=True):
        marked = F.replace(marked, F.lit(mark), F.lit(form))
    return marked


def marks_to_html(marked: Column, in_italics: bool = False) -> Column:
    """HTML: other text escaped; italics inside italics stand upright."""
    italics = ('<span style="font-style:normal">', "</span>") if in_italics else ("<i>", "</i>")
    return _written(escape_html(marked), ("<sub>", "</sub>", "<sup>", "</sup>", *italics))


def marks_to_latex(escaped: Column) -> Column:
    """LaTeX commands for marks; the rest is taken as escaped."""
    return _written(escaped, ("\\textsubscript{", "}", "\\textsuperscript{", "}", "\\textit{", "}"))


def strip_marks(marked: Column) -> Column:
    return F.regexp_replace(marked, f"[{ALL}]", "")


def transfer_marks(marked: Column, plain: Column) -> Column:
    """The marks of a title on the same title in another case; ``plain`` as it is where any letter differs.

    Letters are aligned one by one; one whose other case has more letters (ß, SS) stands
    against all of them.
    """

    def step(acc: Column, c: Column) -> Column:
        at = acc["at"]
        here = F.substring(plain, at, F.lit(1))
        wide = F.greatest(F.char_length(F.upper(c)), F.char_length(F.lower(c)))
        chunk = F.substring(plain, at, wide)
        same = (here == c) | (F.lower(here) == F.lower(c)) | (F.upper(here) == F.upper(c))
        longer = (wide > 1) & (chunk.isin(F.upper(c), F.lower(c)) | (F.lower(chunk) == F.lower(c)) | (F.upper(chunk) == F.upper(c)))
        mark = c.rlike(f"^[{ALL}]$")
        took = F.when(mark, F.lit(0)).when(same & (here != ""), 1).when(longer, wide).otherwise(-1)
        return let(took, lambda n: F.when(~acc["ok"], acc).otherwise(F.struct(F.concat(acc["out"], F.when(n == 0, c).otherwise(F.substring(plain, at, F.greatest(n, F.lit(0))))).alias("out"), (at + F.greatest(n, F.lit(0))).alias("at"), (n >= 0).alias("ok"))))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), F.lit(True).alias("ok"))
    done = F.aggregate(F.filter(F.split(marked, ""), lambda c: c != ""), start, step)
    return let(done, lambda d: F.when(d["ok"] & (d["at"] == F.char_length(plain) + 1), d["out"]).otherwise(plain))
