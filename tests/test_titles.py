"""Markup of titles: tags, MathML, TeX, balance, transfer, and the forms in which marks are written."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from citeweave.functions import marks as m

S, S_, P, P_, I, I_ = m.SUB, m.SUB_END, m.SUP, m.SUP_END, m.ITALIC, m.ITALIC_END
HTML = {
    "Growth of <i>Mytilus</i> in CaCO<sub>3</sub>": "Growth of <i>Mytilus</i> in CaCO<sub>3</sub>",
    "beds of<i>Ostrea</i>at low tide; p<i>K</i>a": "beds of <i>Ostrea</i> at low tide; p<i>K</i>a",
    "<i>a<sub>b</i>c</sub> x": "a<sub>bc</sub> x", "x<sub>1<sub>2</sub></sub>": "x<sub>12</sub>", "open <i>never closed": "open never closed", "</i>closed</sub>": "closed", "a<sub></sub>b": "ab",
    "MgSiO\n  <sub>3</sub>\n  and more": "MgSiO<sub>3</sub> and more", "Fe\n <sub>3</sub>\n S": "Fe<sub>3</sub>S", "CO\n <sub>2</sub>\n In soils": "CO<sub>2</sub> In soils", "of\n <sup>87</sup>\n Sr": "of <sup>87</sup>Sr",
    "<mml:math><mml:msub><mml:mi>H</mml:mi> <mml:mn>2</mml:mn></mml:msub><mml:mi>O</mml:mi></mml:math> ice": "H<sub>2</sub>O ice",
    "<math><msup><msub><mi>x</mi><mn>1</mn></msub><mn>2</mn></msup></math>": "x<sub>1</sub><sup>2</sup>",
    "<math><mmultiscripts><mi>C</mi><mprescripts/><none/><mn>13</mn></mmultiscripts></math> data": "<sup>13</sup>C data",
    "<math><mmultiscripts><mi>U</mi><mn>2</mn><mn>+</mn><mprescripts/><mn>92</mn><mn>235</mn></mmultiscripts></math>": "<sub>92</sub><sup>235</sup>U<sub>2</sub><sup>+</sup>",
    "<math><msubsup><mi>SO</mi><mn>4</mn><mrow><mn>2</mn><mo>-</mo></mrow></msubsup></math>": "SO<sub>4</sub><sup>2-</sup>",
    "&lt;inline-formula&gt;&lt;tex-math notation=\"LaTeX\"&gt;$\\alpha_{2}$&lt;/tex-math&gt;&lt;/inline-formula&gt; decay": "α<sub>2</sub> decay",
    "<tex-math>$\\mathrm{Fe}_{2}\\mathrm{O}_3^{2+}$</tex-math>": "Fe<sub>2</sub>O<sub>3</sub><sup>2+</sup>", "<tex-math>\\(25^{\\circ}\\mathrm{C} \\pm x_{i_{j}}\\)</tex-math>": "25°C ±x<sub>ij</sub>",
    "<alternatives><tex-math>$x$</tex-math><mml:math><mml:mi>y</mml:mi></mml:math></alternatives> z": "y z", "<alternatives><mml:math><mml:mi>y</mml:mi></mml:math><tex-math>$x$</tex-math></alternatives> z": "y z",
    "a < b &amp; c": "a &lt; b &amp; c", "": "", None: "", "di-\n<i>tert</i>\n-butyl": "di-<i>tert</i>-butyl", f"no {S}marks{S_} of its own": "no marks of its own",
}


def test_deposited_titles(spark):
    df = spark.createDataFrame(list(enumerate(HTML)), "i int, t string")
    got = {r.i: r.h for r in df.select("i", m.marks_to_html(m.title_marks(F.col("t"))).alias("h")).collect()}
    wrong = [(t, got[i], want) for i, (t, want) in enumerate(HTML.items()) if got[i] != want]
    assert not wrong


def test_written_forms(spark):
    df = spark.createDataFrame([(f"{S}1−x{S_} {S}max{S_} {S}CO2{S_} {P}2+{P_} {I}a{I_}<",)], "t string")
    row = df.select(m.marks_to_text(F.col("t")), m.marks_to_html(F.col("t"), True), m.marks_to_latex(F.col("t")), m.strip_marks(F.col("t"))).first()
    assert tuple(row) == (
        "₁₋ₓ max CO₂ ²⁺ a<", '<sub>1−x</sub> <sub>max</sub> <sub>CO2</sub> <sup>2+</sup> <span style="font-style:normal">a</span>&lt;',
        r"\textsubscript{1−x} \textsubscript{max} \textsubscript{CO2} \textsuperscript{2+} \textit{a}<", "1−x max CO2 2+ a<",
    )


def test_marks_are_carried_over(spark):
    cases = [
        (f"{I}Na{S}2{S_}{I_} straße", "NA2 STRASSE", f"{I}NA{S}2{S_}{I_} STRASSE"), (f"a{S}2{S_}b", "A2B", f"A{S}2{S_}B"), (f"a{S}2{S_}b", "A2BC", "A2BC"), (f"a{S}2{S_}b", "A2", "A2"), (f"x{S}a{S_}y", "x b y", "x b y"),
        ("plain", "Plain", "Plain"), ("", "", ""), (f"{I}É{I_}t", "éT", f"{I}é{I_}T"),
    ]
    df = spark.createDataFrame(cases, "marked string, plain string, want string")
    assert all(r.got == r.want for r in df.select("want", m.transfer_marks(F.col("marked"), F.col("plain")).alias("got")).collect())


def test_long_and_deep_titles_end(spark):
    deep, flat, bare = "<i><sub>" * 300 + "x" + "</sub></i>" * 300, "<sub>1</sub>" * 600, "<" * 20_000
    df = spark.createDataFrame([(deep,), (flat,), (bare,)], "t string")
    start = time.time()
    got = [r[0] for r in df.select(m.marks_to_text(m.title_marks(F.col("t")))).collect()]
    assert time.time() - start < 60 and got[0] == "ₓ" and got[1] == "₁" * 600 and set(got[2]) == {"<"}
