"""Styles, citations and exports against the examples that style guides print, and records that lack fields."""

from __future__ import annotations

import pytest

from citeweave.plans import styles
from citeweave.records import ACCESSED, harden
from citeweave.functions.names import PERSON

SCHEMA = (
    f"id int, type string, doi string, url string, title string, container string, short_container string, series string, number string, institution string, edition string, num_pages string, genre string, "
    f"year string, month int, day int, volume string, issue string, pages string, article boolean, publisher string, place string, isbn string, database string, accession string, others boolean, "
    f"authors array<{PERSON}>, editors array<{PERSON}>, accessed {ACCESSED}"
)


def person(family, given="", suffix=""):
    return (family, given, suffix, not given and not suffix)


def people(text):
    """``Family, Given; Family, Given, Suffix; Organisation``"""
    return [person(*(x.strip() for x in one.split(","))) for one in text.split(";")] if text else []


def record(authors="", editors="", **own):
    return {"authors": people(authors), "editors": people(editors), "type": "journal-article"} | own


ORRIN = {"title": "Seasonal oxygen loss in a shallow lake", "container": "Upland Waters", "volume": "8", "issue": "2", "pages": "31-44", "year": "2013", "doi": "10.1000/upland.8"}
CHAP = record("Holt, A", type="book-chapter", title="Charts", pages="5-9", publisher="Mapro", year="2000")
#: A note that the Chicago Manual prints (fixed value).
SWING = record("Smith, Zadie", type="book", title="Swing Time", publisher="Penguin Press", place="New York", year="2016")

#: The entries of the museum's annals, and those of authors Sánchez Prado, Austen and Orchard, are printed by the guides (fixed values); others are invented.
PRINTED = [
    ("carnegie", record("Wahlert, J. H.", year="1977", title="Cranial foramina and relationships of Eutypomys (Rodentia, Eutypomyidae)", container="American Museum Novitates", volume="2626", pages="1-8"),
     "Wahlert, J.H. 1977. Cranial foramina and relationships of Eutypomys (Rodentia, Eutypomyidae). American Museum Novitates, 2626:1-8."),
    ("carnegie", record("Soltis, D. E.; Soltis, P. S.", year="1992", title="The distribution of selfing rates in homosporous ferns", container="American Journal of Botany", volume="79", pages="97-100"),
     "Soltis, D.E., and P.S. Soltis. 1992. The distribution of selfing rates in homosporous ferns. American Journal of Botany, 79:97-100."),
    ("carnegie", record("", "Holmgren, P. K.; Holmgren, N. H.; Barnett, L. C.", year="1990", title="Index Herbariorum, Part I", edition="8", container="Regnum Vegetabile", volume="120", pages="1-693"),
     "Holmgren, P.K., N.H. Holmgren, and L.C. Barnett (eds.). 1990. Index Herbariorum, Part I, Eighth Edition. Regnum Vegetabile, 120:1-693."),
    ("carnegie", record("Samways, M. J.", type="book", year="1994", title="Insect Conservation Biology", publisher="Chapman and Hall", place="London", num_pages="380"),
     "Samways, M.J. 1994. Insect Conservation Biology. Chapman and Hall, London. 380 pp."),
    ("carnegie", record("Ostle, B.; Mensing, R. W.", type="book", year="1975", title="Statistics in Research", edition="3", publisher="Iowa State University Press", place="Ames, Iowa"),
     "Ostle, B., and R.W. Mensing. 1975. Statistics in Research, Third Edition. Iowa State University Press, Ames, Iowa."),
    ("carnegie", record("Asher, R. J.", "Rose, K. D.; Archibald, J. D.", type="book-chapter", year="2005", title="Insectivoran-grade placentals", container="The Rise of Placental Mammals", pages="50-70",
                        publisher="The Johns Hopkins University Press", place="Baltimore"),
     "Asher, R.J. 2005. Insectivoran-grade placentals. Pp. 50-70, in The Rise of Placental Mammals (K.D. Rose and J.D. Archibald, eds.). The Johns Hopkins University Press, Baltimore."),
    ("carnegie", record("Rasmussen, D. L.", type="dissertation", year="1977", title="Geology of the Cabbage Patch Formation", genre="Ph.D.", institution="University of Kansas", place="Lawrence, Kansas"),
     "Rasmussen, D.L. 1977. Geology of the Cabbage Patch Formation. Unpublished Ph.D. Dissertation, University of Kansas, Lawrence, Kansas."),
    ("carnegie", record("Fetzner, J. W., Jr.", type="webpage", year="2008", title="Biodiversity Services Facility", accessed=(2008, 7, 16), url="http://iz.carnegiemnh.org/CMIC/Default.org"),
     "Fetzner, J.W., Jr. 2008. Biodiversity Services Facility [cited 16 July 2008]. Available from http://iz.carnegiemnh.org/CMIC/Default.org"),
    ("carnegie", record("Ash, A.", year="2001", title="T", container="J", volume="12", issue="3", pages="10-20"), "Ash, A. 2001. T. J, 12(3):10-20."),
    ("apa", CHAP, "Holt, A. (2000). Charts. pp. 5–9. Mapro."), ("chicago", CHAP, "Holt, A. “Charts.” 5–9. Mapro, 2000."), ("harvard", CHAP, "Holt, A. (2000) ‘Charts’. Mapro, pp. 5–9."),
    ("ieee", CHAP, "A. Holt, “Charts,” Mapro, 2000, pp. 5–9."), ("mla", CHAP, "Holt, A. “Charts.” Mapro, 2000, pp. 5–9."), ("vancouver", CHAP, "Holt A. Charts. Mapro; 2000. p. 5-9."),
    ("apa", CHAP | {"container": "Atlas"}, "Holt, A. (2000). Charts. In Atlas (pp. 5–9). Mapro."), ("ieee", CHAP | {"container": "Atlas"}, "A. Holt, “Charts,” in Atlas. Mapro, 2000, pp. 5–9."),
    ("apa", record("The Lake Data Group", type="software", title="Lakekit", institution="Zenodo", year="2022", doi="10.5281/zenodo.1"),
     "The Lake Data Group. (2022). Lakekit [Computer software]. Zenodo. https://doi.org/10.5281/zenodo.1"),
    ("apa", record(title="x", type=None), "x. (n.d.)."), ("apa", record(type=None), "(n.d.)."),
    ("apa", record("Smith, J.", type="dissertation", title="Of carp", publisher="University of X", year="1999"), "Smith, J. (1999). Of carp [Doctoral dissertation, University of X]."),
    ("apa", record("Smith, J.", type="posted-content", title="Of carp", institution="bioRxiv", publisher="Cold Spring Harbor Laboratory", year="2020", doi="10.1101/2020.1"),
     "Smith, J. (2020). Of carp. bioRxiv. https://doi.org/10.1101/2020.1"),
    ("apa", record("; ".join(f"A{chr(97 + i)}, B." for i in range(22)), title="T", container="J", year="2000"), ", ".join(f"A{chr(97 + i)}, B." for i in range(19)) + ", . . . Av, B. (2000). T. J."),
    ("apa", record("", "Moreau, J.; Petrov, S.", type="book", title="Worlds", edition="2", publisher="P", year="2001"), "Moreau, J., & Petrov, S. (Eds.). (2001). Worlds (2nd ed.). P."),
    ("mla", record("Sánchez Prado, Ignacio M.", type="book", title="Mexico", publisher="Cambridge UP", year="2018"), "Sánchez Prado, Ignacio M. Mexico. Cambridge UP, 2018."),
    ("mla", record("Austen, Jane", "Chapman, R. W.", type="book", title="Emma", publisher="Oxford UP", year="1988"), "Austen, Jane. Emma. Edited by R. W. Chapman, Oxford UP, 1988."),
    ("mla", record("Doe, Jo", title="Song", container="PMLA", volume="1", issue="2", month=1, year="2013", pages="69-88", database="JSTOR", url="www.jstor.org/stable/41403188"),
     "Doe, Jo. “Song.” PMLA, vol. 1, no. 2, Jan. 2013, pp. 69–88. JSTOR, www.jstor.org/stable/41403188."),
    ("chicago", record("Doe, Jo; Roe, Al", title="Song", container="Ethics", volume="111", issue="2", month=4, year="2016", pages="1-9"), "Doe, Jo, and Al Roe. “Song.” Ethics 111, no. 2 (April 2016): 1–9."),
    ("chicago", record("Doe, Jo", type="dissertation", title="Song", institution="University of Chicago", year="2013"), "Doe, Jo. “Song.” PhD diss., University of Chicago, 2013."),
    ("harvard", record("Doe, Jo Ann", type="book", title="How to research", edition="4", publisher="Open Press", place="London", year="2010"), "Doe, J.A. (2010) How to research, 4th edn. London: Open Press."),
    ("vancouver", record("Orchard, T J; Diabetes Prevention Program Research Group", title="On it", short_container="Ann Intern Med", year="2005", month=1, volume="62", issue="1", pages="112-116"),
     "Orchard TJ; Diabetes Prevention Program Research Group. On it. Ann Intern Med. 2005 Jan;62(1):112-6."),
    ("ieee", record("Doe, Jo", title="Song", container="J. Appl. Mech.", volume="91", issue="6", month=8, year="2007", pages="061103", article=True),
     "J. Doe, “Song,” J. Appl. Mech., vol. 91, no. 6, Aug. 2007, Art. no. 061103."),
]

CITED = [
    (record("Orrin, Tove; Velde, Pia C.", **ORRIN), {"style": "apa", "pages": "55-56"}, "(Orrin & Velde, 2013, pp. 55–56)"),
    (record("Orrin, Tove; Velde, Pia C.", **ORRIN), {"style": "apa", "form": "narrative", "pages": "55"}, "Orrin and Velde (2013, p. 55)"),
    (record("Orrin, G.; Velde, P. C.; Lund, N. Y.", **ORRIN), {"style": "apa"}, "(Orrin et al., 2013)"),
    (record("Orrin, G.; Velde, P. C.; Lund, N. Y.", **ORRIN), {"style": "harvard"}, "(Orrin, Velde and Lund, 2013)"),
    (record("", **ORRIN), {"style": "apa"}, "(“Seasonal oxygen loss in a shallow lake”, 2013)"),
    (record("", **ORRIN | {"title": "Slow water: A history of lakes in nine maps"}), {"style": "apa"}, "(“Slow water”, 2013)"),
    (record("", "Moreau, J.; Petrov, S.", type="book", title="X", year="2013"), {"style": "apa"}, "(Moreau & Petrov, 2013)"),
    (record("Orrin, G.", others=True, **ORRIN), {"style": "apa"}, "(Orrin et al., 2013)"),
    (record("Orrin, G.; Velde, P. C.", **ORRIN), {"style": "mla", "pages": "55-56"}, "(Orrin and Velde 55–56)"),
    (record("Orrin, G.", **ORRIN), {"style": "vancouver"}, "(1)"), (record("Orrin, G.", **ORRIN), {"style": "ieee", "pages": "55"}, "[1, p. 55]"),
    (record("Orrin, G.", **ORRIN), {"style": "carnegie", "pages": "55"}, "(Orrin 2013:55)"),
    (record(type=None), {"style": "apa"}, "(Untitled, n.d.)"),
    (record("Orrin, Tove; Velde, Pia C.", **ORRIN), {"style": "chicago", "form": "note", "pages": "55"},
     "Tove Orrin and Pia C. Velde, “Seasonal oxygen loss in a shallow lake,” Upland Waters 8, no. 2 (2013): 55, https://doi.org/10.1000/upland.8."),
    (SWING, {"style": "chicago", "form": "note", "pages": "315-16"}, "Zadie Smith, Swing Time (New York: Penguin Press, 2016), 315–16."),
    (SWING, {"style": "chicago", "form": "short", "pages": "315-16"}, "Smith, Swing Time, 315–16."),
]


def table(spark, records):
    names = [f.name for f in spark.createDataFrame([], SCHEMA).schema]
    return spark.createDataFrame([tuple({"id": i, **r}.get(n) for n in names) for i, r in enumerate(records)], SCHEMA)


@pytest.mark.parametrize("style", styles.STYLES)
def test_printed_examples(spark, style):
    mine = [(r, want) for s, r, want in PRINTED if s == style]
    got = {r.id: r.text for r in styles.render(table(spark, [r for r, _ in mine]), style).collect()}
    assert [got[i] for i in range(len(mine))] == [want for _, want in mine]


def test_citations_in_sentences(spark):
    works = harden(table(spark, [r for r, *_ in CITED]))
    rows = works.select("id", *[styles.in_text(**form).alias(f"t{i}") for i, (_, form, _) in enumerate(CITED)]).collect()
    assert [next(r[f"t{i}"] for r in rows if r.id == i) for i in range(len(CITED))] == [want for *_, want in CITED]
    with pytest.raises(ValueError):
        styles.in_text("other")


def test_no_text_is_null_whatever_lacks(spark):
    whole = record("Abel, A.", "Borg, B.", **ORRIN | {"publisher": "P", "place": "Q", "edition": "2", "series": "S", "number": "7"})
    types = ("journal-article", "book", "book-chapter", "proceedings-article", "dissertation", "posted-content", "report", "webpage", "dataset", None)
    works = [{k: v for k, v in whole.items() if k != lacking} | {"type": t} for t in types for lacking in whole] + [{}]
    df = harden(table(spark, works))
    every = [make().alias(name) for name, make in {**styles.STYLES, **styles.EXPORTS}.items()]
    for row in df.select(*every).collect():
        for text in row:
            assert text is not None and "  " not in text.replace("\n  ", "").replace("  - ", "") and ", ," not in text and ".." not in text.replace(". . .", "")
    with pytest.raises(ValueError):
        styles.render(df, "unknown")


def test_html_escapes_and_marks_titles(spark):
    works = table(spark, [record("A, B.", type="book", title="x <b> & y", publisher="P & Q", year="2000")])
    assert styles.render(works, "apa", html=True).first().text == "A, B. (2000). <i>x &lt;b&gt; &amp; y</i>. P &amp; Q."


def test_exports(spark):
    works = table(spark, [
        record("Borg & Sons, Inc; Çelik, Ö.; Kato, Ben Carl, Jr.", title="The Place of DNA in mosses", container="J. & K.", year="2020", month=3, day=5, pages="1–9", doi="10.1/a{b", volume="3"),
        record("Web, A.", type="report", title="T", number="12", institution="USGS", year="1999"),
    ])
    bib = {r.id: r.text for r in styles.render(works, "bibtex").collect()}
    assert bib[0].splitlines()[:4] == ["@article{BorgSons2020Place,", "  title = {The {Place} of {DNA} in mosses},", r"  author = {Borg \& Sons, Inc and Çelik, Ö. and Kato, Jr., Ben Carl},", r"  journal = {J. \& K.},"]
    assert "  pages = {1--9},\n  year = {2020},\n  month = mar," in bib[0] and "doi = {10.1/a%7Bb}" in bib[0]
    assert bib[1].startswith("@techreport{Web1999,") and "  number = {12}," in bib[1] and "  institution = {USGS}" in bib[1]
    ris = styles.render(works, "ris").orderBy("id").first().text
    assert ris.startswith("TY  - JOUR\r\nAU  - Borg & Sons, Inc\r\nAU  - Çelik, Ö.\r\nAU  - Kato, Ben Carl, Jr.\r\nTI  - ") and "SP  - 1\r\nEP  - 9\r\nPY  - 2020\r\nDA  - 2020/03/05/\r\n" in ris and ris.endswith("ER  - \r\n")
    enw = styles.render(works, "endnote").orderBy("id").first().text
    assert "%8 March 5\n" in enw and "%P 1-9\n" in enw
