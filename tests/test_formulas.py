"""Formulas, ions and isotopes in titles, and formulas restored from capitals."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from citeweave.functions import formulas
from citeweave.functions.casing import ELEMENTS
from citeweave.functions.marks import marks_to_text

MARKED = {
    "films of (Ca2SiO4) on (BaCO3)": "films of (Ca₂SiO₄) on (BaCO₃)", "Mn3+ and Mn3+/ΣMn": "Mn³⁺ and Mn³⁺/ΣMn", "The [6]Al3+-O bond in Y3Al2[Al3O12]": "The [⁶]Al³⁺-O bond in Y₃Al₂[Al₃O₁₂]", "143Nd/144Nd ages": "¹⁴³Nd/¹⁴⁴Nd ages",
    "snow δ17O and 17O": "snow δ¹⁷O and ¹⁷O", "(Ca, Sr)TiO3 glass": "(Ca, Sr)TiO₃ glass", "(Ca,Sr)TiO3-glass": "(Ca,Sr)TiO₃-glass", "NH3 and SO2 in": "NH₃ and SO₂ in", "Mg2+, NH4+, PO43− and NO2− in fog": "Mg²⁺, NH₄⁺, PO₄³⁻ and NO₂⁻ in fog",
    "MgSO4·7H2O loss": "MgSO₄·7H₂O loss", "Ca0.7Na0.3TiO3": "Ca₀.₇Na₀.₃TiO₃", "Cr3+-bearing and Al2O3-rich": "Cr³⁺-bearing and Al₂O₃-rich", "S2- transport": "S²⁻ transport", "Nd2Fe14B wear": "Nd₂Fe₁₄B wear", "20Ne/22Ne and 26Al ages": "²⁰Ne/²²Ne and ²⁶Al ages",
    "Mn2+3Al2Si3O12 ore": "Mn²⁺₃Al₂Si₃O₁₂ ore", "KMn2+Fe3+(SO4)2": "KMn²⁺Fe³⁺(SO₄)₂", "SO2+H2O": "SO₂+H₂O", "(SO2+ H2O + KCl)": "(SO₂+ H₂O + KCl)", "[Co(CN)6]3− dye": "[Co(CN)₆]³⁻ dye", "Ni1−xO": "Ni₁₋ₓO", "Ni1-xO": "Ni₁₋ₓO", "δ18OVSMOW": "δ¹⁸OVSMOW",
    "15NO3−": "¹⁵NO₃⁻", "34SO2": "³⁴SO₂", "pCO2 of lakes": "pCO₂ of lakes", "SO2- and H2O-bearing": "SO₂- and H₂O-bearing", "O2 and SO2": "O₂ and SO₂", "O2 fugacity": "O₂ fugacity", "δ57/54Fe": "δ⁵⁷/⁵⁴Fe", "C70+": "C₇₀⁺", "S22−": "S₂²⁻", "OH− band": "OH⁻ band",
}
SAME = [
    "H5N1 flu", "Vitamin B6 and K2 levels", "18S and 60S subunits", "8K video in 4D", "Na- and K-rich lavas", "ISO14001 and W3C", "SARS-CoV-2 in 2021", "CD8+ T cells", "B+ trees in C++", "The Mn(IV) state", "Rb-Sr dates", "mm2 by km3", "CSIRO and NIST", "P21 and TP63", "Landsat 7",
    "https://doi.org/10.1000/S0012-821X(98)00123-4", "C2+C5 plants", "Sr2+Ba2+ exchange", "CD3+CD28+ beads", "Na+K ratio", "SH3", "H2A", "C4H", "C3C9", "U3OS", "NOS1", "F2 hybrids", "60K", "9B", "200W", "", "NOx and SOx", "a+b", "Fe1S", "Ca100O2",
]


def test_titles(spark):
    cases = {**MARKED, **{t: t for t in SAME}, None: "", "x" * 300 + "H2O": "x" * 300 + "H2O"}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: r.x for r in df.select("i", marks_to_text(formulas.mark_formulas(F.col("t"))).alias("x")).collect()}
    wrong = [(t, got[i], want) for i, (t, want) in enumerate(cases.items()) if got[i] != want]
    assert not wrong


def readings(text):
    """All ways to read capitals as symbols: (cost, path, text)."""
    if not text:
        yield 0, "", ""
        return
    upper = {e.upper(): e for e in ELEMENTS}
    for n in (1, 2):
        name = text[:n]
        if name in upper:
            digits = len(text[n:]) - len(text[n:].lstrip("0123456789."))
            for cost, path, rest in readings(text[n + digits :]):
                yield cost + 10 + 15 * (upper[name] in formulas.RARE) - (n == 2), str(n) + path, upper[name] + text[n : n + digits] + rest


def test_restored_is_the_cheapest_reading(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("CONSIHFPBALEGR") + rng.choice(("", "", "2", "3", "0.5")) for _ in range(rng.randint(1, 8))) for _ in range(300)] + ["SIO2", "40AR", "XQ", "", "sio2", "2", None]
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", formulas.restore(F.col("t")).alias("x")).collect()}
    for t in texts:
        lead = "".join(itertools.takewhile(lambda c: c in "0123456789.", t or ""))
        able = list(readings((t or "")[len(lead) :])) if t and t[len(lead) :] and t.isupper() else []
        assert got[t] == (lead + min(able)[2] if able else None), (t, got[t])
