"""Chemical formulas, ions and isotopes in titles, as text with marks; formulas restored from capitals.

A formula is recognised by its shape, found by taking bracketed groups away from the inside
out, and by evidence that it is one: a group, an element of two letters, two counts, or a
simple molecule's form. An ion is a formula or element with a charge that its element can
have. An isotope of an element of one letter must be a known one ("50K" is a size); of two
letters its mass must fit the element's number.

Null titles are empty. Words longer than ``LONGEST`` stay as they are, and so do words with marks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import let
from citeweave.functions.casing import ELEMENTS
from citeweave.functions.marks import ALL, SUB, SUB_END, SUP, SUP_END
from citeweave.functions.text import _named

LONGEST = 200
#: Known isotopes of elements of one letter, and tracers in labelled molecules (fixed values).
ISOTOPES = {
    "H": "1 2 3", "B": "10 11", "C": "11 12 13 14", "N": "13 14 15", "O": "15 16 17 18", "F": "18 19", "P": "31 32 33", "S": "32 33 34 35 36", "K": "39 40 41", "V": "50 51", "Y": "89 90",
    "I": "123 125 127 129 131", "W": "182 183 184 186", "U": "233 234 235 236 238",
}
LABELLED = "13C 14C 15N 17O 18O 34S 35S 36Cl 37Cl 99Tc 57Fe 65Cu 67Zn 98Mo 44Ca 32P 33P 86Sr 87Sr".split()
#: Greatest charges of elements of one letter; others may have eight (fixed values). Elements whose bare sign means something else.
CHARGES = {"H": 1, "B": 0, "C": 0, "N": 5, "O": 2, "F": 1, "P": 5, "S": 6, "K": 1, "V": 5, "Y": 3, "I": 7, "W": 6, "U": 6}
NO_BARE = ("O", "Rh", "B", "C")
BARE_IONS = ("OH", "CN", "SCN", "HS", "NO", "CO", "ClO", "OCl", "BrO", "IO")
#: Simple molecules of elements of one letter, and the forms of more (fixed values).
SIMPLE = (
    "H2O CO2 CO3 CH2 CH3 CH4 NH2 NH3 NH4 NO2 NO3 N2O SO2 SO3 SO4 PO3 PO4 H2S H3O HCO3 CS2 CF4 BF3 BF4 NF3 SF4 SF6 PF5 PF6 UF4 UF6 WF6 IF5 IF7 K2O K2S WS2 WO3 WO4 VO2 VO4 UO2 UO3 IO3 IO4 BH3 BH4 PH3 CH3OH CH2O "
    "CH3CN CH3COOH HNO2 HNO3 KNO3 KIO3 YPO4 KOH2 H2O2"
).split()
FORMS = r"^(?:[A-Z]\d*O\d*|[BCNP]H\d|H\dS|[BCNPSUWI]\d?F[1-7]|(?:H\d?|K|Y|U)?[BCNPSI]O[2-4]|C\d*H\d+(?:C\d*H\d+|COOH|OOH|CO|CN|O\d*H?|N\d*H\d*)*)$"
NO_FORMULA = r"^(?:H\d{1,2}N\d{1,2}|B16F\d+|(?:Ca|Na|Co)V\d.*)$"
#: Words that say a title is about gases, so that H2 and O2 are molecules (fixed values).
GAS = r"(?i)\b(?:gas|gases|gaseous|fluids?|fugacity|pressures?|atmospheres?|atmospheric|oxygen|hydrogen|nitrogen|chlorine|fluorine|degassing|outgassing|combustion|adsorption|electrolysis|evolution reaction)\b"
#: Symbols that capitals seldom mean (fixed values).
RARE = "No Co Ho Po Cs Sc Os Hf Np Pa Er Pm Cd Es Am Cf Bk Fm Md Lr Tc Pr Tm Tb Dy Ac Fr Ra Rn At".split()
SYMBOL, SCARCE, PAIR = 10, 15, 1

EL = "(?:" + "|".join(sorted(ELEMENTS, key=lambda e: (-len(e), e))) + "|□)"
#: Stand-ins, of characters reserved for use inside programs: a group read, a kept blank, a cut.
GROUP, BLANK, CUT = "\uFDD8", "\uFDD9", "\uFDDA"
_COUNT = r"(?:\d+(?:\.\d+)?[−+-]\d*(?:\.\d+)?[xyδ](?![a-z])|\d+(?:\.\d+)?|\d*(?:\.\d+)?[xyδ](?:[−+-]\d+(?:\.\d+)?)?(?![a-z]))"
_METAL = "(?:" + "|".join(sorted([e for e in ELEMENTS if len(e) == 2] + ["V", "U", "W", "Y", "K"], key=lambda e: (-len(e), e))) + ")"
#: A metal's charge inside a formula, before a count, a bracket or a comma; before another element too if ``open_``.
_STATE = rf"(?<={_METAL})(?:\d[+−](?=[\d(\[,)\]{GROUP}]))"
_STATE_OPEN = rf"(?<={_METAL})(?:\d[+−](?=[\d(\[,)\]A-Z□{GROUP}]|$))"


def _low(text: Column) -> Column:
    return F.concat(F.lit(SUB), text, F.lit(SUB_END))


def _high(text: Column) -> Column:
    return F.concat(F.lit(SUP), text, F.lit(SUP_END))


def _is_shaped(core: Column, state: str) -> Column:
    """Elements, counts and groups throughout; groups are taken away from the inside out."""
    unit = rf"(?:(?:{EL}|{GROUP})(?:{state})?(?:{_COUNT})?)"
    inner = rf"[(\[]{unit}+(?:,[\s{BLANK}]?{unit}+)*[)\]]"
    flat = F.aggregate(F.sequence(F.lit(1), F.lit(6)), core, lambda text, _: F.regexp_replace(text, inner, GROUP))
    return flat.rlike(rf"^{unit}+$")


def _accepted(core: Column, loose: Column) -> Column:
    """Whether a well-shaped formula without charge is one."""
    bare = F.regexp_replace(core, r"\d[+−](?=[\d(\[,)\]A-Z□]|$)", "")
    counts = F.regexp_extract_all(bare, F.lit(_COUNT), F.lit(0))
    elements = F.size(F.regexp_extract_all(core, F.lit(EL), F.lit(0)))
    bad_count = F.exists(counts, lambda n: (n == "1") | n.rlike(r"^\d{3,}$"))
    repeated = core.rlike(r"([A-Z][a-z]?)\d+\1(?![a-z])")
    lone = core.rlike(r"[A-Za-z][xyδ]$") & ~F.exists(counts, lambda n: n.rlike("[−+-]"))
    evidence = core.rlike(rf"[(\[]|[A-Z][a-z](?![a-z])|\d[+−]") | loose | core.isin(*SIMPLE) | core.rlike(FORMS) | (F.size(counts) >= 2)
    return (core == "O3") | ((elements >= 2) & (F.size(counts) > 0) & ~bad_count & ~repeated & ~lone & ~core.rlike(NO_FORMULA) & evidence)


def _rendered(core: Column, state: str) -> Column:
    """Counts lowered, charges within raised."""
    pieces = F.regexp_extract_all(core, F.lit(rf"(?:{state})|(?<=[A-Za-z)\]□+−]){_COUNT}|[A-Z][a-z]?|."), F.lit(0))
    # "Bx": a symbol's second letter must not be taken for a count.
    one = lambda p: F.when(p.rlike(r"^\d[+−]$"), _high(p)).when(p.rlike(rf"^{_COUNT}$"), _low(F.replace(p, F.lit("-"), F.lit("−")))).otherwise(p)
    return F.array_join(F.transform(pieces, one), "")


def neutral(core: Column, loose: Column) -> Column:
    """A formula without charge as marked text; null for anything else."""
    distinct = F.size(F.array_distinct(F.regexp_extract_all(core, F.lit(EL), F.lit(0))))
    mineral = core.rlike(r"[(\[]") | (distinct >= 3)
    tight = F.when(_is_shaped(core, _STATE) & _accepted(core, loose), _rendered(core, _STATE))
    return F.coalesce(tight, F.when(mineral & core.rlike(r"\d[+−]") & _is_shaped(core, _STATE_OPEN) & _accepted(core, loose), _rendered(core, _STATE_OPEN)))


def charged(word: Column, loose: Column) -> Column:
    """A formula or element with a charge at its end as marked text; null for anything else."""
    body, sign = (F.regexp_extract(word, r"^(.+?)([+−]{1,2}|-{1,2})$", k) for k in (1, 2))

    def of(x: Column) -> Column:
        core, mark = x["body"], F.replace(x["sign"], F.lit("-"), F.lit("−"))
        symbol, digits = (F.regexp_extract(core, rf"^({EL})(\d*)$", k) for k in (1, 2))
        number = digits.try_cast("int")
        most = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in CHARGES.items() for v in pair]), symbol), F.lit(8))
        single = (
            F.when(digits == "", F.when(~symbol.isin(*NO_BARE), F.concat(symbol, _high(mark)))).when(F.char_length(mark) > 1, None)
            .when((digits == "2") & (symbol.isin("H", "N") | ((symbol == "O") & (mark == "+"))), F.concat(symbol, _low(digits), _high(mark)))
            .when(F.char_length(digits) == 1, F.when((number >= 1) & (number <= most), F.concat(symbol, _high(F.concat(digits, mark)))))
            .when(symbol.isin("O", "S", "C") & (digits == "22"), F.concat(symbol, _low(F.lit("2")), _high(F.concat(F.lit("2"), mark)))).when((symbol == "C") & digits.isin("60", "70"), F.concat(symbol, _low(digits), _high(mark)))
        )
        tail = F.regexp_extract(core, r"(\d+)$", 1)
        n = F.char_length(tail)
        bracket, stated = core.rlike(r"\]\d$"), core.rlike(rf"{_METAL}\d[+−].*[A-Za-z]\d$") & (F.char_length(mark) == 1)
        own = F.when(bracket | stated, F.concat(tail, mark)).when(n >= 2, F.concat(F.right(tail, F.lit(1)), mark)).otherwise(mark)
        base = F.when(bracket | stated | (n >= 2), F.left(core, F.char_length(core) - 1)).otherwise(core)
        several = let(base, lambda b: F.when(b.isin(*BARE_IONS) & (n == 0), F.concat(b, _high(own))).otherwise(F.concat(neutral(b, F.lit(False)), _high(own))))
        suspended = x["sign"].startswith("-") & (tail == "")  # "Mg- and Fe-rich"
        return F.when((x["sign"] == "") | suspended, None).when(symbol != "", single).otherwise(several)

    return let(F.struct(body.alias("body"), sign.alias("sign")), of)


def isotope(word: Column, labelled: bool = True) -> Column:
    """A mass and an element as marked text; null for anything else."""
    mass, meta, symbol = (F.regexp_extract(word, r"^(\d{1,3})(m?)([A-Z][a-z]?)$", k) for k in (1, 2, 3))
    known = [f"{m}{e}" for e, masses in ISOTOPES.items() for m in masses.split()]
    place = F.element_at(_named({e: str(i + 1) for i, e in enumerate(ELEMENTS)}), symbol).cast("int")
    fits = (F.char_length(symbol) == 2) & (meta == "") & mass.cast("int").between(place, 2.7 * place + 3)
    return F.when((symbol != "") & (word.isin(*known, "99mTc") | F.coalesce(fits, F.lit(False))), F.concat(_high(F.concat(mass, meta)), symbol))


def piece(text: Column, behind_dot: Column, loose: Column) -> Column:
    """One part of a word: its coefficient, site, Greek letter and isotope or formula; null if it holds none."""
    coefficient = F.when(behind_dot, F.regexp_extract(text, r"^(\d+(?:\.\d+)?|[nx])(?=[A-Z(])", 1)).otherwise("")

    def rest(t: Column, lead: Column) -> Column:
        site = F.regexp_extract(t, r"^\[(\d{1,2})\]", 1)
        greek = F.regexp_extract(F.regexp_replace(t, r"^\[\d{1,2}\]", ""), "^[δΔεμΣ]", 0)
        core = F.regexp_replace(F.regexp_replace(t, r"^\[\d{1,2}\]", ""), "^[δΔεμΣ]", "")
        ahead = F.concat(lead, F.when(site != "", _high(F.concat(F.lit("["), site, F.lit("]")))).otherwise(""), greek)

        def of(c: Column) -> Column:
            qualified = F.when((greek != "") & (site == ""), let(F.regexp_extract(c, r"^(\d{1,3}[A-Z][a-z]?)(?:V?SMOW|V?PDB|V?CDT|SLAP|AIR|NBS\d*|SRM\d*|NIST\d*)$", 1), lambda i: F.concat(isotope(i), F.substring(c, F.char_length(i) + 1, 20))))
            named = F.when((greek != "") & (site == ""), let(F.regexp_extract(c, r"^(\d{1,3}[A-Z])[a-z]{1,6}$", 1), lambda i: F.concat(isotope(i), F.substring(c, F.char_length(i) + 1, 20))))
            tracer = F.regexp_extract(c, r"^(\d{2,3}m?)([A-Z][a-z]?)(?=[A-Z(\[\d])", 1)
            of_tracer = F.substring(c, F.char_length(tracer) + 1, 200)
            labels = F.when((greek == "") & (tracer != "") & F.regexp_replace(F.regexp_extract(c, r"^(\d{2,3}m?[A-Z][a-z]?)(?=[A-Z(\[\d])", 1), "m", "").isin(*LABELLED), F.concat(_high(tracer), F.coalesce(charged(of_tracer, loose), neutral(of_tracer, F.lit(True)))))
            amount = F.regexp_extract(c, r"^([fpa]|X)[A-Z]", 1)
            of_gas = F.substring(c, 2, 200)
            gas = F.when((greek == "") & (amount != ""), F.concat(amount, F.when(of_gas.isin("H2", "O2", "N2", "Cl2", "F2"), F.concat(F.regexp_replace(of_gas, "2$", ""), _low(F.lit("2")))).otherwise(neutral(of_gas, F.lit(False)))))
            site_alone = F.when((site != "") & c.rlike("^[A-Z]"), c)
            return F.concat(ahead, F.coalesce(isotope(c), qualified, named, charged(c, loose), neutral(c, loose), labels, gas, site_alone))

        return let(core, of)

    return let(coefficient, lambda k: let(F.substring(text, F.char_length(k) + 1, LONGEST), lambda t: rest(t, k)))


_SEPARATORS = r"--+|[/–—@·•⋅]|−(?=[A-Z(\[□])|-(?=[A-Za-zδΔε]|\d{1,3}m?[A-Z])"


def word(text: Column) -> Column:
    """A word of a title with its formulas marked; as it is where it has none."""

    def of(w: Column) -> Column:
        opens, closes = (F.char_length(F.regexp_replace(w, f"[^{c}]", "")) for c in (r"(\[{", r")\]}"))
        lead = F.regexp_extract(w, r"^[\"'“‘]*", 0)
        lead = F.concat(lead, F.when(opens > closes, F.regexp_extract(F.substring(w, F.char_length(lead) + 1, 3), r"^[(\[{]", 0)).otherwise(""))
        tail = F.regexp_extract(w, r"[\"'”’,.;:!?]*$", 0)
        body = F.substring(w, F.char_length(lead) + 1, F.greatest(F.char_length(w) - F.char_length(lead) - F.char_length(tail), F.lit(0)))
        last = F.when(closes > opens, F.regexp_extract(body, r"[)\]}]$", 0)).otherwise("")
        core = F.left(body, F.char_length(body) - F.char_length(last))
        wrapped = core.rlike(r"^\((?:[^()]|\([^()]*\))*\)$|^\[(?!\d{1,2}\])(?:[^\[\]])*\]$") & ~core.rlike(r"^\([^()]*\).*\([^()]*\)$")
        peeled = F.struct(F.concat(lead, F.when(wrapped, F.left(core, F.lit(1))).otherwise("")).alias("lead"), F.when(wrapped, F.substring(core, F.lit(2), F.char_length(core) - 2)).otherwise(core).alias("core"), F.concat(F.when(wrapped, F.right(core, F.lit(1))).otherwise(""), last, tail).alias("tail"))
        return let(peeled, lambda p: F.concat(p["lead"], inner(p["core"]), p["tail"]))

    def inner(core: Column) -> Column:
        core = F.regexp_replace(core, r"(\d)[-–](?=[xyδ](?:[A-Z(\[)\],□]|$))", "$1−")

        def parts_of(c: Column) -> Column:
            parts = F.split(F.regexp_replace(c, rf"({_SEPARATORS})", f"{CUT}$1{CUT}"), CUT)
            dotted = c.rlike("[·•⋅]")

            def plus(p: Column, i: Column) -> Column:
                # A sum is marked only if every side is a formula or a compound; a charge inside a formula comes first.
                whole = piece(p, F.get(parts, i - 1).rlike("[·•⋅]"), dotted)
                sides = F.transform(F.split(p, r"\+(?=[A-Z(\[])"), lambda s: F.coalesce(piece(s, F.lit(False), F.lit(False)), F.when(s.rlike(rf"^{EL}{{2,}}$"), s)))
                total = F.when(p.rlike(r"\+(?=[A-Z(\[])") & F.forall(sides, lambda s: s.isNotNull()), F.array_join(sides, "+"))
                return F.coalesce(whole, total, p)

            return F.array_join(F.transform(parts, lambda p, i: F.when(p.rlike(rf"^(?:{_SEPARATORS})$|^$"), p).otherwise(plus(p, i))), "")

        ratio = F.regexp_extract(core, r"^([δΔεμ])(\d{1,3})/(\d{1,3}[A-Z][a-z]?)$", 2)
        both = F.concat(F.left(core, F.lit(1)), _high(ratio), F.lit("/"), isotope(F.regexp_extract(core, r"/(.*)$", 1)))
        return let(core, lambda c: F.when(~c.rlike("[A-Z]") | c.rlike(r"(?i)://|^doi:|^10\."), c).otherwise(F.coalesce(F.when(ratio != "", both), parts_of(c))))

    return F.when((F.char_length(text) > LONGEST) | ~text.rlike(r"[A-Z].*\d|\d.*[A-Z]|[A-Z][a-z]?[+−]") | text.rlike(f"[{ALL}]"), text).otherwise(let(text, of))


def mark_formulas(title: Column) -> Column:
    """A title with counts in formulas lowered, and charges and masses raised, as marks.

    A sign that only joins ("CO2- and H2O-bearing") stays a sign. Molecules of two atoms of an
    element (H2) look like genes and generations, so they need another formula or a gas in the title.
    """
    kept = F.regexp_replace(F.coalesce(title, F.lit("")), r"\(((?:[A-Z][a-z]?,)+)\s([A-Z][a-z]?\))", f"($1{BLANK}$2")
    words = F.regexp_extract_all(kept, F.lit(r"\s+|\S+"), F.lit(0))

    def each(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            after = F.regexp_replace(F.coalesce(F.get(ws, i + 2), F.lit("")), r"^[\"'“‘(\[]+|[\"'”’,.;:!?)\]]+$", "")
            later = F.coalesce(F.get(ws, i + 4), F.lit(""))
            sign = F.regexp_extract(w, r"[A-Za-z0-9)\]+−]([-+])$", 1)
            joins = F.when(sign == "-", (after.rlike("^(?i:and|or|nor|to|&|\\+|und|et)$") & ~later.rlike("[+−](?:-|$)")) | after.rlike("[^+−]-$") | w.rlike("[+−]-$"))
            joins = joins.when(sign == "+", (after == "+") | (after.rlike(rf"^{EL}.*\d") & ~after.rlike("[-+−]$"))).otherwise(False)
            return F.when(joins, F.concat(word(F.left(w, F.char_length(w) - 1)), sign)).otherwise(word(w))

        return F.transform(ws, one)

    def gases(made: Column) -> Column:
        near = F.exists(made, lambda w: w.contains(SUB)) | F.coalesce(title, F.lit("")).rlike(GAS)
        pair = r"^([(\"'“‘\[]*)(H|O|N|Cl|F)2((?:-[a-z]+)?[)\"'”’\],.;:]*)$"
        return F.when(near, F.transform(made, lambda w: F.regexp_replace(w, pair, f"$1$2{SUB}2{SUB_END}$3"))).otherwise(made)

    return F.replace(F.array_join(let(let(words, each), gases), ""), F.lit(BLANK), F.lit(" "))


def restore(text: Column) -> Column:
    """A formula in capitals ("SIO2") with its symbols as written (SiO₂ is "SiO2"); null if no symbols make it up.

    A dynamic program from the last letter to the first: of the ways to read the rest that of
    fewest symbols, where a rare symbol costs more and one of two letters a little less.
    """
    number, body = (F.regexp_extract(text, r"^([\d.]*)([A-Z][A-Z\d.]*)$", k) for k in (1, 2))
    units = F.reverse(F.regexp_extract_all(body, F.lit(r"[A-Z][\d.]*"), F.lit(0)))
    symbols = _named({e.upper(): e for e in ELEMENTS})
    way = "struct<cost:int,text:string>"
    none = F.lit(None).cast(way)

    def read(name: Column, count: Column, rest: Column) -> Column:
        symbol = F.element_at(symbols, name)
        price = SYMBOL + F.when(symbol.isin(*RARE), SCARCE).otherwise(0) - F.when(F.char_length(symbol) == 2, PAIR).otherwise(0)
        return F.when(symbol.isNotNull() & rest.isNotNull(), F.struct((rest["cost"] + price).cast("int").alias("cost"), F.concat(symbol, count, rest["text"]).alias("text")))

    def step(acc: Column, unit: Column) -> Column:
        """``one`` reads from this letter on, ``two`` from the next, ``behind`` is the next letter with its count."""
        letter, count = F.left(unit, F.lit(1)), F.substring(unit, F.lit(2), F.char_length(unit))
        single = read(letter, count, acc["one"])
        double = F.when((count == "") & (acc["behind"] != ""), read(F.concat(letter, F.left(acc["behind"], F.lit(1))), F.substring(acc["behind"], F.lit(2), F.char_length(acc["behind"])), acc["two"]))
        best = F.when(single.isNull() | (double["cost"] < single["cost"]), double).otherwise(single)
        return F.struct(best.cast(way).alias("one"), acc["one"].alias("two"), unit.alias("behind"))

    empty = F.struct(F.lit(0).alias("cost"), F.lit("").alias("text")).cast(way)
    start = F.struct(empty.alias("one"), none.alias("two"), F.lit("").alias("behind"))
    return let(F.aggregate(units, start, step)["one"], lambda w: F.when(body != "", F.concat(number, w["text"])))
