from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.operators import metrics as M
from folioscope.operators import quality, validation

SCHEMA = "record_id string, year int, venue string, venue_tier string, n_authors int, cited_by_count int, is_scientific boolean, is_empirical boolean, methodology string, labels array<string>, source string, doi string"
ROWS = [
    ("a", 1989, "V", "core_a", 1, 0, True, True, "quantitative", ["x", "y"], "p", "10.1"),
    ("b", 1990, "V", "core_a", 2, 10, True, True, "qualitative", ["x"], "p+q", None),
    ("c", 1990, "W", "dispersed", 4, 30, True, False, None, [], "q", None),
    ("d", 1991, None, None, 0, None, True, None, None, None, "q", "10.2"),
    ("e", 1991, "", "dispersed", 3, 5, False, None, None, ["y"], None, None),
    ("f", None, "W", "dispersed", 1, 1, True, True, "mixed", ["y"], "p", None),
    ("g", 2024, "W", "core_a", 9, 7, True, True, "quantitative", ["z"], "p", None),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(frame, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in frame.collect()}


def test_growth(df):
    g = M.growth_by_year(df, 1989, 1991)
    r = rows(g, "year")
    assert {y: (x["n_articles"], x["n_journals"]) for y, x in r.items()} == {1989: (1, 1), 1990: (2, 2), 1991: (2, 1)}
    s = M.growth_summary(g).first()
    assert (s["first_year"], s["last_year"], s["n_intervals"], s["total_articles_in_window"]) == (1989, 1991, 2, 5)
    assert s["article_cagr_pct"] == round((2**0.5 - 1) * 100, 2)
    assert M.growth_summary(g.where("year is null")).count() == 0
    fitted = rows(M.fitted_growth(g, M.growth_summary(g)), "year")
    assert fitted[1989]["fitted"] == 1 and fitted[1991]["fitted"] == pytest.approx(2)


def test_decades(df):
    r = rows(M.records_by_decade(df), "decade")
    assert {k: x["n"] for k, x in r.items()} == {"1989": 1, "1990s": 4, "2020s": 1}
    assert r["1990s"]["pct"] == 66.7


def test_empirical(df):
    r = rows(M.empiricism_by_year(df, 1991), "year")
    assert (r[1990]["n_total"], r[1990]["n_empirical"], r[1990]["pct_empirical"]) == (2, 1, 50.0)
    assert 1991 not in r  # nothing known there
    h = M.empiricism_headline(df).first()
    assert (h["n_scientific"], h["n_empirical"], h["n_non_empirical"], h["n_unknown"]) == (6, 4, 1, 1)
    assert (h["pct_of_all"], h["pct_of_known"]) == (66.67, 80.0)


def test_methods(df):
    r = rows(M.methodology_distribution(df), "methodology")
    assert {k: x["n"] for k, x in r.items()} == {"quantitative": 2, "qualitative": 1, "mixed": 1}
    by = rows(M.methodology_by_decade(df), "decade", "methodology")
    assert by["1990s", "qualitative"]["pct"] == 100.0


def test_collaboration(df):
    r = rows(M.collaboration_by_year(df, 2000), "year")
    assert (r[1990]["mean_authors"], r[1990]["median_authors"], r[1990]["n"]) == (3.0, 3.0, 2)
    assert r[1989]["pct_single_authored"] == 100 and r[1989]["pct_multi_authored"] == 0
    assert rows(M.author_count_distribution(df), "n_authors")[1]["n"] == 2


def test_citations(df):
    s = M.citation_summary(df, 2022).first()
    assert (s["n_papers"], s["total_citations"], s["median_citations"], s["max"]) == (4, 45, 7.5, 30)
    assert s["p90"] == pytest.approx(24.0) and s["pct_uncited"] == 25.0 and s["pct_cited_at_least_once"] == 75.0
    assert M.citation_summary(df.where("false"), 2022).count() == 0
    v = rows(M.citations_by_venue(df, 2022, least=1), "venue")
    assert v["V"]["total_citations"] == 10 and v["V"]["pct_uncited"] == 50 and "W" in v
    assert [r["venue"] for r in M.top_venues(df, k=1, last=2022, least=1).collect()] == ["V"]
    assert rows(M.uncited_by_year(df, 2022), "year", "is_empirical")[1990, False]["pct_uncited"] == 0
    assert rows(M.specialty_vs_dispersed(df, 2022), "venue_group")["specialty"]["n_papers"] == 2


def test_fields(df):
    r = rows(M.field_distribution(df, "labels"), "labels")
    assert r["y"]["n"] == 3 and r["y"]["pct"] == 42.9
    single = rows(M.field_distribution(df, "venue_tier", multi=False), "venue_tier")
    assert single["core_a"]["pct"] == 50.0
    by = M.field_by_decade(df, "labels")
    assert rows(by, "decade", "labels")["1990s", "y"] == {"decade": "1990s", "labels": "y", "n": 1, "pct": 25.0, "denominator": 4}
    wide = rows(M.decade_pivot(by, "labels", 2), "labels")
    assert set(wide) == {"x", "y"} and wide["x"]["2020s"] == 0.0
    assert M.complement_of(M.field_distribution(df, "labels"), "labels", "absent").first()["pct"] == 100.0


def test_sources_and_dispersion(df):
    r = rows(M.source_overlap(df), "source_combination")
    assert r["p+q"]["n_sources"] == 2 and sum(x["n"] for x in r.values()) == 6
    assert M.single_source_share(M.source_overlap(df)).first()["pct_single"] == 83.33
    d = rows(M.dispersion_by_year(df, 1991), "year")
    assert d[1990]["pct_specialty"] == 50.0 and d[1991]["n_specialty"] == 0
    c = M.corpus_block(df, 1991).first()
    assert c["n_partial_years"] == 1 and c["partial_years"] == [2024] and c["doi_coverage_pct"] == 28.57


def test_quality(df):
    q = quality.qa_checks(df.withColumns({"title": F.col("venue"), "abstract": F.col("venue")}), venue="venue")
    r = q.first()
    assert (r["n_records"], r["duplicate_record_ids"], r["missing_venue"], r["missing_year"], r["zero_author_records"]) == (7, 0, 2, 1, 1)
    assert r["hard_failures"] == []
    twice = quality.qa_checks(df.unionByName(df).withColumns({"title": F.col("venue"), "abstract": F.col("venue")}), venue="venue").first()
    assert twice["duplicate_record_ids"] == 7 and twice["hard_failures"] == ["duplicate_record_ids"]
    checks = quality.verify(df, M.growth_by_year(df), df.withColumn("screen_pass", F.lit(True)))
    assert {r["name"]: r["passed"] for r in checks.collect()}["growth counts every record in the window"]
    assert quality.duplicates(df, ["venue"]).count() == 2


def test_kappa(spark):
    pairs = spark.createDataFrame([("1", "1")] * 4 + [("0", "0")] * 3 + [("1", "0")] * 2 + [("0", "1")] * 1 + [(None, "1")], "a string, b string")
    r = validation.agreement(pairs).first()
    assert r["n_pairs"] == 10 and r["percent_agreement"] == 70.0
    pe = (6 * 5 + 4 * 5) / 100
    assert r["cohens_kappa"] == pytest.approx((0.7 - pe) / (1 - pe))
    same = validation.agreement(pairs.where("a = '1' and b = '1'")).first()
    assert same["cohens_kappa"] is None and same["percent_agreement"] == 100.0
    prf = rows(validation.per_class(pairs), "label")
    assert prf["1"]["precision"] == 0.8 and prf["1"]["recall"] == pytest.approx(4 / 6)
    assert validation.agreement(pairs.where("false")).count() == 0


def test_sampling(spark):
    df = spark.range(400).select(F.col("id").alias("record_id"), (F.col("id") % 4).alias("s"))
    got = validation.stratified_sample(df, ["s"], 40)
    assert {r["s"]: r["count"] for r in got.groupBy("s").count().collect()} == {k: 10 for k in range(4)}
    again = validation.stratified_sample(df.repartition(3), ["s"], 40)
    assert {r["record_id"] for r in got.collect()} == {r["record_id"] for r in again.collect()}
    held = validation.holdout(df, 0.25).where("held_out").count()
    assert 60 <= held <= 140
    folds = validation.folds_by_group(df, "s", 2).collect()
    assert len(folds) == 4 and {r["fold"] for r in folds} == {0, 1}
    assert [v for v, _, _ in validation.leave_one_out(df, "s")] == [0, 1, 2, 3]
    sheet = validation.shuffled(df.limit(20), 5)
    assert sheet.where("batch = 'calibration'").count() == 5
    with pytest.raises(ValueError, match="coders would see"):
        validation.for_coders(df.withColumn("model_x", F.lit(1)), ("record_id", "model_x"))


def test_coders(spark):
    a = spark.createDataFrame([("r1", " Yes ", None), ("r2", "no", None), ("r3", "", None), ("r4", "no", "x")], "record_id string, Q1 string, FLAG string")
    b = spark.createDataFrame([("r1", "yes", None), ("r2", "yes", None), ("r3", "no", None), ("r4", "no", None)], "record_id string, Q1 string, FLAG string")
    both = validation.paired(a, b, ("Q1",))
    todo = {r["record_id"]: r["reasons"] for r in validation.adjudication(both, ("Q1",)).collect()}
    assert todo == {"r2": ["Q1"], "r3": ["Q1"], "r4": ["FLAG"]}
    decided = spark.createDataFrame([("r2", "no")], "record_id string, Q1 string")
    assert {r["record_id"]: r["Q1"] for r in validation.consensus(both, decided, ("Q1",)).collect()} == {"r1": "yes", "r2": "no", "r3": None, "r4": "no"}
    with pytest.raises(ValueError, match="unlike"):
        validation.paired(a, b.where("record_id <> 'r1'"), ("Q1",))
    with pytest.raises(ValueError, match="unique"):
        validation.paired(a.unionByName(a), b, ("Q1",))
