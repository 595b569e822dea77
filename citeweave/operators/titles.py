"""Queries over titles: markup, phrases, formulas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import formulas, marks
from citeweave.functions.casing import ELEMENTS
from citeweave.tables import load

#: Deposited titles of parts: faults and forms of markup by turns, with a name, a type and a number.
DEPOSITED = (
    ("<i>{w}</i> in CaCO<sub>{n}</sub>", "<i>{w}</i> in CaCO<sub>{n}</sub>"),
    ("of<i>{w}</i>in {t}", "of <i>{w}</i> in {t}"),
    ("<i>{w}<sub>{n}</i>x</sub>", "{w}<sub>{n}x</sub>"),
    ("{w} &lt;sub&gt;{n}&lt;/sub&gt; &amp;amp; {t}", "{w} <sub>{n}</sub> &amp; {t}"),
    ("<mml:math><mml:msubsup><mml:mi>Fe</mml:mi> <mml:mn>{n}</mml:mn><mml:mrow><mml:mn>2</mml:mn><mml:mo>+</mml:mo></mml:mrow></mml:msubsup></mml:math> of {w}", "Fe<sub>{n}</sub><sup>2+</sup> of {w}"),
    ("<alternatives><tex-math>$\\mathrm{Fe}_{{n}}$</tex-math></alternatives> and <tex-math>$\\alpha^{{n}}$</tex-math> of {w}", "Fe<sub>{n}</sub> and α<sup>{n}</sup> of {w}"),
    ("{w} SiO\n  <sub>{n}</sub>\n  and {t}", "{w} SiO<sub>{n}</sub> and {t}"),
    ("x<sup>{n}<sup>+</sup></sup> <i>{w}", "x<sup>{n}+</sup> {w}"),
)


def _filled(template: str, put) -> list:
    """Parts of a template: texts and the columns in braces."""
    return [put(p[1:-1], True) if re.fullmatch(r"\{[wtn]\}", p) else put(p, False) for p in re.split(r"(\{[wtn]\})", template) if p]


def title_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposited titles as HTML and plain text, and their marks on the title in capitals."""
    cols = {"w": F.col("p_name"), "t": F.lower("p_type"), "n": F.col("p_size").cast("string")}
    put = lambda x, is_col: cols[x] if is_col else F.lit(x)
    deposited = F.coalesce(*(F.when(F.col("p_partkey") % len(DEPOSITED) == i, F.concat(*_filled(html, put))) for i, (html, _) in enumerate(DEPOSITED)))
    # Written apart, so that each step is planned once.
    marked = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(marks.title_marks(deposited))).alias("marked"))
    upper = F.upper(marks.strip_marks(F.col("marked")))
    return marked.select("p_partkey", marks.marks_to_html(F.col("marked")).alias("html"), marks.marks_to_text(F.col("marked")).alias("text"), marks.marks_to_html(marks.transfer_marks(F.col("marked"), upper)).alias("upper_html"))


#: Symbols of the derived formulas.
METALS = ("Fe", "Al", "Si", "Ti", "V", "Cr", "Mn", "Ca", "Na", "Co", "Ni", "U", "Nb", "Sc")


def _metal(index) -> F.Column:
    return F.get(F.array(*map(F.lit, METALS)), (index % len(METALS)).cast("int"))


def _formula() -> F.Column:
    """A metal, another one for two of three, oxygen or sulfur; counts by the part's size and number."""
    key, size = F.col("p_partkey"), F.col("p_size")
    count = lambda n: F.when(n % 4 > 0, (n % 4 + 1).cast("string")).otherwise("")
    return F.concat(_metal(key), count(size), F.when(key % 3 > 0, F.concat(_metal(key * 5 + 3), count(size + key))).otherwise(""), F.when(key % 2 == 0, "O").otherwise("S"), (size % 7 + 2).cast("string"))


def formula_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of parts set in capitals, with their symbols restored."""
    return load(spark, sf_dir, "part").select("p_partkey", F.upper(_formula()).alias("capitals")).withColumn("restored", formulas.restore(F.col("capitals")))


def title_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with a formula, an ion, a hydrate and isotopes, as plain text with lowered and raised figures."""
    key = F.col("p_partkey")
    title = F.concat(F.lit("Sorption of Ca2+ on "), _metal(key), F.lit("2O"), F.col("p_size") % 6 + 3, F.lit(" ("), F.col("p_name"), F.lit(", Mg"), key % 8 + 2, F.lit("Si2O5·"), key % 5 + 2, F.lit("H2O) and 87Sr/86Sr by PC12"))
    marked = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(formulas.mark_formulas(title))).alias("marked"))
    return marked.select("p_partkey", marks.marks_to_text(F.col("marked")).alias("text"))


QUERIES = {f.__name__: f for f in (title_marks, formula_restore, title_formulas)}


def _sql(template: str, upper: bool = False, plain: bool = False) -> str:
    """A template filled in SQL: tags kept, or scripts as Unicode has them."""
    out, text = [], template
    for tag in ("<sub>", "</sub>", "<sup>", "</sup>", "<i>", "</i>", "&amp;"):
        text = text.replace(tag, f"\0{tag}\0")
    level = None
    for piece in text.split("\0"):
        if piece.startswith("<") or piece == "&amp;":
            if not plain or piece == "&amp;":
                out.append(f"'{piece if not plain else '&'}'")
            level = piece[1:4] if piece in ("<sub>", "<sup>") else None if piece.startswith("</") else level
            continue
        parts = _filled(piece, lambda x, is_col: {"w": "p_name", "t": "lower(p_type)", "n": "p_size::VARCHAR"}[x] if is_col else "'" + x + "'")
        for part in parts:
            part = f"upper({part})" if upper else part
            out.append(f"translate({part}, '0123456789+x', '₀₁₂₃₄₅₆₇₈₉₊ₓ')" if plain and level == "sub" else f"translate({part}, '0123456789+', '⁰¹²³⁴⁵⁶⁷⁸⁹⁺')" if plain and level == "sup" else part)
    return " || ".join(out)


def _cases(**form) -> str:
    return f"CASE p_partkey % {len(DEPOSITED)} " + " ".join(f"WHEN {i} THEN {_sql(want, **form)}" for i, (_, want) in enumerate(DEPOSITED)) + " END"


_LIST = "[" + ", ".join(f"'{m}'" for m in METALS) + "]"
_METAL = lambda index: f"{_LIST}[({index}) % {len(METALS)} + 1]"
_COUNT = lambda n: f"CASE WHEN ({n}) % 4 > 0 THEN (({n}) % 4 + 1)::VARCHAR ELSE '' END"
_SYMBOLS = ", ".join(f"('{e.upper()}', '{e}', {formulas.SYMBOL + formulas.SCARCE * (e in formulas.RARE) - formulas.PAIR * (len(e) == 2)})" for e in ELEMENTS)
SQL = {
    "title_marks": f"SELECT p_partkey, {_cases()} AS html, {_cases(plain=True)} AS text, {_cases(upper=True)} AS upper_html FROM part",
    # Every way to read the letters as symbols, one or two at a time; the cheapest, then the one that takes single letters first.
    "formula_restore": f"""
WITH RECURSIVE s(name, symbol, price) AS (VALUES {_SYMBOLS}),
f AS (SELECT p_partkey, upper({_METAL("p_partkey")} || {_COUNT("p_size")} || CASE WHEN p_partkey % 3 > 0 THEN {_METAL("p_partkey * 5 + 3")} || {_COUNT("p_size + p_partkey")} ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN 'O' ELSE 'S' END || (p_size % 7 + 2)) AS capitals FROM part),
w AS (
  SELECT p_partkey, capitals, capitals AS rest, '' AS text, 0 AS cost, '' AS path FROM f
  UNION ALL
  SELECT p_partkey, capitals, rest[len(regexp_extract(rest, CASE n WHEN 1 THEN '^[A-Z][0-9.]*' ELSE '^[A-Z][A-Z][0-9.]*' END)) + 1:], text || symbol || regexp_extract(rest[n + 1:], '^[0-9.]*'), cost + price, path || n
  FROM w, (VALUES (1), (2)) AS t(n), s WHERE rest <> '' AND name = rest[1:n] AND len(name) = n)
SELECT p_partkey, capitals, arg_min(text, struct_pack(c := cost, p := path)) FILTER (rest = '') AS restored FROM w GROUP BY ALL""",
    "title_formulas": f"""SELECT p_partkey, 'Sorption of Ca²⁺ on ' || {_METAL("p_partkey")} || '₂O' || translate((p_size % 6 + 3)::VARCHAR, '0123456789', '₀₁₂₃₄₅₆₇₈₉') || ' (' || p_name || ', Mg' || translate((p_partkey % 8 + 2)::VARCHAR, '0123456789', '₀₁₂₃₄₅₆₇₈₉')
  || 'Si₂O₅·' || (p_partkey % 5 + 2) || 'H₂O) and ⁸⁷Sr/⁸⁶Sr by PC12' AS text FROM part""",
}
