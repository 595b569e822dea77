"""Titles restored from capitals: forms by the corpus, names and acronyms by their letters."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from citeweave.operators import capitals

CORPUS = ["We saw that the lakes of Norway lose oxygen. They say the NASA data and the lakes there are old. In it, Norway and NASA agree: the carp said it.", "of the lakes and of Norway with NASA, and a little more about carp, salt and water here", None, ""]


def model(spark, texts):
    forms = capitals.word_forms(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).cache()
    return forms, capitals.letter_counts(forms)


def test_titles(spark):
    forms, counts = model(spark, CORPUS)
    cases = {
        "THE LAKES OF NORWAY AND NASA": "The lakes of Norway and NASA", "OXYGEN IN SIO2 AND H2O": "Oxygen in SiO2 and H2O", "CARP II: O'NEIL AND MCMURDO": "Carp II: O'Neil and McMurdo", "XRF OF B12X": "XRF of B12X", "Already in small": "Already in small",
        "": "", None: "", "«NORWAY»": "«Norway»", "40AR OF LAKES": "40Ar of lakes",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, title string")
    got = {r.id: r.title for r in capitals.restore_titles(df, forms, counts).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases
    assert capitals.restore_titles(df.limit(0), forms, counts).count() == 0
    assert {r.title for r in capitals.restore_titles(df.filter("id = 0"), forms.limit(0), counts.limit(0)).collect()} == {"The Lakes of Norway and Nasa"}


def test_letters_tell_words_from_acronyms(spark):
    """The model learns from half of the documents; words that only the others have, and runs of letters drawn at random, are told apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    forms = capitals.word_forms(docs.filter("doc_id % 2 = 0")).cache()
    counts = capitals.letter_counts(forms)
    fresh = capitals.word_forms(docs.filter("doc_id % 2 = 1")).join(forms, "word", "left_anti").filter("small > 0 and char_length(word) between 4 and 9").limit(2_000)
    rng = random.Random(4)
    strange = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 6))) for _ in range(1_000)]
    words = capitals.likelihoods(fresh, counts).agg(F.avg((F.col("score") >= capitals.LEAST).cast("int"))).first()[0]
    runs = capitals.likelihoods(spark.createDataFrame([(w,) for w in strange], "word string"), counts).agg(F.avg((F.col("score") < capitals.LEAST).cast("int"))).first()[0]
    assert words > 0.9 and runs > 0.7, (words, runs)
