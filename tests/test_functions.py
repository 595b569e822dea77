from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions import bibliographic as b
from citeweave.functions import identifiers as i
from citeweave.functions import names
from citeweave.functions import text as t


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()[0]


SICI = "10.1002/(SICI)1520-6300(199905)11:3<301::AID-AJHB4>3.0.CO;2-Q"


def every(spark, expr, cases):
    """All cases in one job: {value: wanted}."""
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, x string").select("n", expr(F.col("x")).alias("y")).collect()
    assert {k: next(r.y for r in rows if r.n == n) for n, k in enumerate(cases)} == cases


def test_doi(spark):
    every(spark, i.extract_doi, {
        "see https://doi.org/10.1234/AbC.5). More": "10.1234/AbC.5", "none": None, "10.1234/": None, "": None,
        "http://dx.doi.org/10.1000/abc?utm_source=x": "10.1000/abc", "https://doi.org/10.1000/abc#section": "10.1000/abc", "10.1000/abc?x": "10.1000/abc?x",
        "https://doi.org/10.1002/(SICI)1098-2353(200001)13:1%3C44::AID-CA6%3E3.0.CO;2-Z": "10.1002/(SICI)1098-2353(200001)13:1<44::AID-CA6>3.0.CO;2-Z",
        SICI: SICI, f"(doi: {SICI}).": SICI, "10.1016/S0024-4937(99)00041-7)": "10.1016/S0024-4937(99)00041-7", "10.1000/ab(c": "10.1000/ab(c",
        "“10.1000/abc”": "10.1000/abc", "‘10.1000/abc’": "10.1000/abc", "10.1000/abc’s": "10.1000/abc", "(see 10.1000/abc.)": "10.1000/abc", "10.1000/abc.).": "10.1000/abc",
        "10.1000/abc>.": "10.1000/abc", "10.1000/abc</a>": "10.1000/abc", "10.1000/abc<br/>next": "10.1000/abc", "10.1000/abc))": "10.1000/abc",
        "https://onlinelibrary.wiley.com/doi/10.1111/fwb.12027/abstract;jsessionid=ABC": "10.1111/fwb.12027",
        "https://www.biorxiv.org/content/10.1101/2021.07.08.451234v3.full": "10.1101/2021.07.08.451234", "10.1000/" + ")" * 50_000: None, "10.1000/abc" + "." * 50_000: "10.1000/abc",
    })
    every(spark, i.to_doi, {
        "arXiv:2101.00001v2": "10.48550/arXiv.2101.00001", "https://arxiv.org/html/2301.00001v2": "10.48550/arXiv.2301.00001", "2301.00001.": "10.48550/arXiv.2301.00001",
        "arXiv:hep-th/9901001": "10.48550/arXiv.hep-th/9901001", "volume 2301.00001 of": None,
    })
    every(spark, i.doi_url, {SICI: "https://doi.org/10.1002/(SICI)1520-6300(199905)11:3%3C301::AID-AJHB4%3E3.0.CO;2-Q", "10.1/é%": "https://doi.org/10.1/%C3%A9%25"})
    every(spark, i.doi_of, {f"DOI {SICI}.": SICI, "10.1000/abc>": "10.1000/abc", "10.1000/a<b": "10.1000/a", "no": None})


def test_pubmed(spark):
    every(spark, i.extract_pmid, {"PMID: 123456": "123456", "pmc123456 and PMID 99999": "PMC123456", " 12345 ": "12345", "volume 12345": None})
    every(spark, lambda c: i.id_to_doi(c)["other"], {"12345": None, "PMID 12345": "12345", "10.1000/abc": None})


def test_isbn(spark):
    every(spark, i.extract_isbn, {
        "ISBN 978-0-521-38707-1": "9780521387071", "ISBN 0521387078": "0521387078", "0-521-38707-8": "0521387078", "0521387078": "0521387078", "see 978 0 306 40615 7.": "9780306406157",
        "pp. 978-0-306-40615-7": None, "978-0-306-40615-8": None, "page 0-521-38707-8": None, "tel 0521387078 now": None,
    })
    got = one(spark, lambda c: i.id_numbers(F.array(c, F.lit("ISSN 1234-567x (Print)"))), "978 0 306 40615 7; 03785955, 0378-5955")
    assert (got.issn, got.isbn) == (["0378-5955", "1234-567X"], ["978-0-306-40615-7"])


def test_checksums(spark):
    assert one(spark, i.isbn13_holds, "9780306406157") and not one(spark, i.isbn13_holds, "9780306406158")
    assert one(spark, i.isbn10_holds, "0306406152") and one(spark, i.isbn10_holds, "080442957X")
    assert one(spark, i.issn_holds, "0378-5955") and not one(spark, i.issn_holds, "0378-5954")
    assert one(spark, i.isbn13_holds, "") is False


def test_dates(spark):
    assert tuple(one(spark, b.partial_date, "1999-05-31")) == (1999, 5, 31)
    assert tuple(one(spark, b.partial_date, "2001/13/01")) == (2001, 0, 0)
    assert tuple(one(spark, b.partial_date, "12 March 2004")) == (2004, 3, 12)
    assert tuple(one(spark, b.partial_date, "1999-02-30")) == (1999, 2, 0)


def test_names_and_pages(spark):
    assert one(spark, names.initials, "Jean-Paul Marie") == "J.-P. M."
    pages = spark.sql("SELECT 123 AS a, 129 AS b UNION ALL SELECT 99, 101 UNION ALL SELECT 7, 7")
    assert sorted(r[0] for r in pages.select(b.short_page_range(F.col("a"), F.col("b"))).collect()) == ["123-9", "7", "99-101"]
    n = spark.range(1, 23).select(b.ordinal(F.col("id")))
    assert [r[0] for r in n.collect()][9:13] == ["10th", "11th", "12th", "13th"]


def test_text(spark):
    every(spark, t.fold, {"Straße Ærø Ñandú": "strasse aero nandu", "Łódź ﬁeld ð": "lodz field d", "e\u0301 Ａ": "e a"})
    every(spark, t.clean, {"<b>A</b> &lt;5 , x": "A <5, x", "CD4 <200 and >1000": "CD4 <200 and >1000", "a\u200b\u00a0\n b": "a b", "&lt;i&gt;x&lt;/i&gt;": "x", "": ""})
    every(spark, t.decode_entities, {"&amp;amp;delta;18O &#8220;x&#x201D;": "δ18O “x”", "{middle dot} {other}": "· {other}", "&zz; &amp; &#57344;": "&zz; & "})
    every(spark, t.mojibake, {"CafÃ© â€œxâ€\x9d": "Café “x”", "Café": "Café", "Ãnew": "Ãnew"})
    every(spark, t.clean_place, {"[Chicago] :": "Chicago", "[S.l.]": "", "London,": "London"})
    every(spark, t.clean_container, {"Proc. Soc.": "Proc. Soc.", "Proceedings of X.": "Proceedings of X", "A : b": "A: b"})
    every(spark, t.dominant_script, {"abc где": "Latin", "где а abc": "Cyrillic", "王明 a": "CJK", "12 .": None})
    every(spark, t.match_tokens, {"Пароникян 王明 Fe₂O₃ of": ["пароникян", "paronikyan", "王明", "王", "明", "fe2o3"], "": []})
    every(spark, lambda c: t.one_edit(c, F.lit("abcdef")), {"abdcef": True, "abcdef": True, "abcde": True, "abcdxf": True, "acbdfe": False, "bacdef": True, "abcdfe": True, "": False})
    assert one(spark, t.fold_spelling, "colour") == "color" and one(spark, t.fold_spelling, "grey") == "gray"


def test_pairs_without_a_rare_token(spark):
    from citeweave.operators.matching import scored_pairs

    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha omega")], "doc_id long, text string")
    items = spark.createDataFrame([(i, "alpha beta gamma delta") for i in range(3)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in scored_pairs(docs, items).collect()}
    assert got == {(d, i): s for d, s in ((1, 1.0), (2, 0.25)) for i in range(3)}


def test_all_spelling_rules(spark):
    words = {"modelling": "modeling", "palaeography": "paleography", "organised": "organize", "calibre": "caliber", "analysed": "analyze", "bisulphite": "bisulfite", "aelian": "aelian", "sulphurised": "sulfurize", "poet": "poet"}
    df = spark.createDataFrame(list(words.items()), "word string, want string")
    assert {r.word: r.got for r in df.select("word", t.fold_spelling(F.col("word")).alias("got")).collect()} == words


def test_spelling_rules_build_on_one_another(spark):
    words = {"choaein": "chein", "beeringntouroae": "beeringntoure", "anoael": "anoael", "oaeellen": "eelen", "choaen": "chen"}
    df = spark.createDataFrame(list(words.items()), "word string, want string")
    assert {r.word: r.got for r in df.select("word", t.fold_spelling(F.col("word")).alias("got")).collect()} == words


def test_names(spark):
    from citeweave.functions import names as n

    every(spark, lambda c: F.concat_ws("|", n.split_name(c)["family"], n.split_name(c)["given"], n.split_name(c)["suffix"]), {
        "Tove Orrin": "Orrin|Tove|", "Pia C. Velde": "Velde|Pia C.|", "van der Holt, Åse": "van der Holt|Åse|", "Ben Carl Kato, Jr.": "Kato|Ben Carl|Jr.",
        "Kato, Ben Carl, Jr.": "Kato|Ben Carl|Jr.", "Ana de la Cruz": "de la Cruz|Ana|", "John Smith, PhD": "Smith|John|", "John Smith III": "Smith|John|III", "Plato": "Plato||", "Smith, J.D.": "Smith|J.D.|",
    })
    every(spark, lambda c: F.concat_ws("|", n.tagged_name(c)["family"], n.tagged_name(c)["given"], n.tagged_name(c)["literal"].cast("string")), {
        "Smith, Jane A.": "Smith|Jane A.|false", "Smith JA": "Smith|J. A.|false", "USDOE,, Washington,": "USDOE, Washington||true", "U.S. Geological Survey": "U.S. Geological Survey||true", "Press, William H.": "Press|William H.|false",
        "et al.": "", "Bank JA": "Bank|J. A.|false",
    })
    every(spark, lambda c: F.array_join(F.transform(n.bib_names(c), lambda p: F.concat_ws("/", p["family"], p["given"], p["suffix"])), "; "), {
        "Kato, Jr., Ben Carl and {Lake Data Group} and Ida Holm": "Kato/Ben Carl/Jr.; Lake Data Group//; Holm/Ida/", "Smith, J. and others": "Smith/J./",
    })
    fixed = spark.createDataFrame([("SMITH", "JOHN", ""), ("Dorn, III", "R.", ""), ("Group", "The Lake Data", ""), ("Miller", "GeorgeR.", ""), ("WHO", ",", ""), ("Doe", "AL", "")], "f string, g string, s string")
    got = [tuple(r[0]) for r in fixed.select(n.person(F.col("f"), F.col("g"), F.col("s"))).collect()]
    assert got == [("Smith", "John", "", False), ("Dorn", "R.", "III", False), ("The Lake Data Group", "", "", True), ("Miller", "George R.", "", False), ("WHO", "", "", True), ("Doe", "AL", "", False)]
    every(spark, n.initials, {"Jean-Paul Marie": "J.-P. M.", "PC": "P. C.", "Aswathi (Asha)": "A.", "Robert \"Bob\"": "R.", "J & K": "J. K.", "王明": "王明", "": "", "J.-P.": "J.-P.", "P.C.": "P. C."})
    every(spark, lambda c: F.array_join(F.transform(n.reference_authors(c), lambda p: F.concat_ws("/", p["family"], p["given"])), "; "), {
        "Smith, J., Doe, A. B. and Roe, C. (2001). Title": "Smith/J.; Doe/A. B.; Roe/C.", "[3] Smith, J. 2001. T": "Smith/J.", "The title of it 2001": "", "": "",
    })


def test_more_dates(spark):
    every(spark, lambda c: F.concat_ws("-", b.partial_date(c)["y"].cast("string"), b.partial_date(c)["m"].cast("string"), b.partial_date(c)["d"].cast("string")), {
        "2019/03/15/": "2019-3-15", "2019///": "2019-0-0", "March 15": "0-3-15", "15 Mar 2019": "2019-3-15", "2020, May 1": "2020-5-1", "2020/Jun/05": "2020-6-5", "2019-21": "2019-0-0", "": "0-0-0",
    })
    every(spark, lambda c: b.cited_year(c, 2027), {"Smith (1964a) 81, 1932–1952": 1964, "see https://x.org/2001 1999": 1999, "pages 1932-1952": 0, "in 2999": 0})
    every(spark, b.nlm_pages, {"123-129": "123-9", "99–101": "99-101", "e12": "e12", "129-123": "129-123"})
    every(spark, lambda c: b.edition_label(c, "carnegie"), {"3": "Third Edition", "11": "11th Edition", "Rev. ed.": "Rev. ed.", "": ""})
    every(spark, b.preprint_server, {"10.1101/2021.07.08.451234": "bioRxiv", "10.48550/arXiv.1": "arXiv", "10.1038/x": None})
    every(spark, lambda c: F.array_join(b.houses(c), ","), {"Pergamon Press, Oxford": "elsevier", "John Wiley and CRC Press": "wiley,taylor", "Own": ""})
    every(spark, b.is_notice, {"Reply to X": True, "Energy policy: discussion and analysis": False, "Title: Reply": True, "Immune response to x": False, "Discussion of “T”": True})


def test_rank_within(spark):
    from citeweave.operators.ranking import rank_within

    rows = [(g, x, x % 3 > 0) for g in ("a", None) for x in range(50)]
    df = spark.createDataFrame(rows, "g string, x int, good boolean")
    got = {(r.g, r.x): r.place for r in rank_within(df, ["g"], F.floor(F.col("x") / 7), ["x"]).collect()}
    assert got == {(g, x): x + 1 for g, x, _ in rows}
    got = {(r.g, r.x): r.place for r in rank_within(df, ["g"], F.floor(F.col("x") / 7), ["x"], weight=F.col("good")).collect()}
    assert all(got[g, x] == sum(y % 3 > 0 for y in range(x + 1)) for g, x, _ in rows)


def test_letters_without_end(spark):
    from citeweave.operators.lists import bijective_letters

    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in (0, 25, 26, 701, 702, 18277, 18278)], "x long").select("x", bijective_letters(F.col("x"))).collect()}
    assert got == {0: "a", 25: "z", 26: "aa", 701: "zz", 702: "aaa", 18277: "zzz", 18278: "aaaa"}
