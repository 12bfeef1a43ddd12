from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioscope.functions import numbers, similarity, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (" https://doi.org/10.1/AB.. ", "10.1/ab"),
        ("DOI:10.1000/x", "10.1000/x"),
        ("http://dx.doi.org/10.1000/x", "10.1000/x"),
        ("doi:https://doi.org/10.1000/x", None),  # prefixes come off once each, in order
        ("https://doi.org/doi:10.1000/x", "10.1000/x"),
        ("11.1000/x", None),
        ("10.1", None),
        (None, None),
        ("", None),
    ],
)
def test_doi(spark, raw, want):
    assert one(spark, text.normalize_doi(lit(raw))) == want


def test_title_norm(spark):
    a = one(spark, text.title_norm(lit("Suicide, self-harm & <i>ideation</i>: a review")))
    assert a == one(spark, text.title_norm(lit("suicide self harm and ideation a review"))) == "suicide self harm and ideation a review"
    assert one(spark, text.title_norm(lit("Crème brûlée ﬁne Ａ"))) == "creme brulee fine a"
    assert one(spark, text.title_norm(lit(None))) == ""


def test_folding_agrees_with_the_standard_tables(spark):
    rng = random.Random(3)
    letters = [c for c in map(chr, range(0xA0, 0x2FFF)) if unicodedata.category(c) != "Cn"]
    words = ["".join(rng.choice(letters + list("abc ")) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    plain = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    for r in df.select("w", text.fold_accents(F.col("w")).alias("f")).collect():
        assert r["f"] == plain(r["w"]), [hex(ord(c)) for c in r["w"]]


def test_venue_key(spark):
    assert one(spark, text.title_key(lit("J Am Med Assoc (Online)"))) == "journal american medicine association"
    assert one(spark, text.title_key(lit("The Journal of Affect Disord & Ment Hlth"))) == "journal affective disorders mental health"
    assert one(spark, text.title_key(lit("自杀学"))) == ""


def test_block_key(spark):
    key = lambda t, y: one(spark, text.block_key(lit(t), F.lit(y).cast("int")))
    assert key("The prevalence of X", 2001) == key("A Prevalence: of x", 2001) == "2001|preval"
    assert key("prevalence", 2002) != key("prevalence", 2001)
    assert key("an of", None) == "0|_"


def test_signature_and_id(spark):
    import hashlib

    want = hashlib.sha1(b"a title|None|lancet").hexdigest()[:16]
    assert one(spark, text.signature(lit("A Title"), F.lit(None).cast("int"), lit("Lancet"))) == want
    ids = lambda d, p: one(spark, text.record_id(lit(d), lit(p), lit("s")))
    assert (ids("10.1/a", "5"), ids("", "5"), ids(None, None)) == ("doi:10.1/a", "pmid:5", "sig:s")


def test_authors(spark):
    names = "array<struct<name:string>>"
    key = lambda rows: one(spark, text.first_author_key(F.from_json(lit(rows), names)))
    assert key('[{"name": ""}, {"name": "José Peña-Núñez"}]') == "nunez"
    assert key("[]") == "" and key(None) == ""
    form = lambda n: one(spark, text.normalize_author(lit(n)))
    assert form("Smith, John A.") == form("John A Smith") == "John A Smith"
    assert form("o'neil, mary-anne") == "Mary-Anne O'Neil"
    assert form(None) == ""


def test_dates_and_sections(spark):
    date = lambda y, m, d, t: one(spark, text.publication_date(lit(y), lit(m), lit(d), lit(t)))
    assert date("1998", "Nov", "3", None) == "1998-11-03"
    assert date("1998", None, None, None) == "1998-01-01"
    assert date(None, None, None, "1998 Nov-Dec") == "1998"
    assert date(None, None, None, None) is None
    sections = F.from_json(lit('[{"label":"METHODS","body":"We did."},{"label":null,"body":"Then."},{"label":"X","body":""}]'), "array<struct<label:string,body:string>>")
    assert one(spark, text.labelled_abstract(sections)) == "Methods: We did. Then."


def test_linear_text(spark):
    index = F.from_json(lit('{"b": [1, 3], "a": [0], "c": [2]}'), "map<string,array<int>>")
    assert one(spark, text.linear_text(index)) == "a b c b"
    assert one(spark, text.linear_text(F.from_json(lit("{}"), "map<string,array<int>>"))) is None


def test_json(spark):
    cases = {'["a","b"]': ["a", "b"], "[bad": [], "x": ["x"], "": [], None: []}
    for raw, want in cases.items():
        assert one(spark, text.json_list(lit(raw))) == want
    assert one(spark, text.model_answer(lit('Sure: {"q": "yes"} ok'), "q")) == "yes"
    assert one(spark, text.model_answer(lit("no idea"), "q")) == "uncertain"
    assert [one(spark, text.answer(lit(x))) for x in (" Yes ", "NaN", "none", "")] == ["yes", None, None, None]


def test_focus(spark):
    focus = lambda t, m: one(spark, text.topic_focus(lit(t), F.from_json(lit(m), "array<string>")))
    assert focus("Trends in suicide", None) == focus("x", '["Self Mutilation"]') == "focused"
    assert focus("Depression", '["Depression"]') == focus(None, None) == "peripheral"


def test_orcid(spark):
    assert one(spark, text.orcid(lit("https://orcid.org/0000-0001-2345-678X"))) == "0000-0001-2345-678X"
    assert one(spark, text.orcid(lit("none"))) is None


def test_decade_and_growth(spark):
    years = [1950, 1989, 1990, 1999, 2000, 2019, 2020, None]
    df = spark.createDataFrame([(y,) for y in years], "y int").select(numbers.decade(F.col("y")).alias("d"))
    assert [r["d"] for r in df.collect()] == ["1989", "1989", "1990s", "1990s", "2000s", "2010s", "2020s", None]
    assert one(spark, numbers.cagr(F.lit(100), F.lit(200), F.lit(1))) == pytest.approx(100)
    for bad in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        assert one(spark, numbers.cagr(*map(F.lit, bad))) is None
    assert one(spark, numbers.share(F.lit(1), F.lit(0))) is None


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_similarity(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))), "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    for a, b in pairs:
        assert similarity.lcs_length(a, b) == slow_lcs(a, b)
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.token_sort_ratio(F.col("a"), F.col("b")).alias("s"), similarity.may_reach(F.col("a"), F.col("b"), 60.0).alias("may"))
    for r in df.collect():
        x, y = (" ".join(sorted(v.split())) for v in (r["a"], r["b"]))
        assert r["s"] == pytest.approx(similarity.indel_ratio(x, y))
        assert r["may"] or r["s"] < 60  # the bound never rules out a pair that reaches
    assert one(spark, similarity.token_sort_ratio(lit("b a"), lit("a b"))) == 100
