from __future__ import annotations

import json
import random

import pytest

from folioscope.operators import model, relational
from folioscope.plans import pipeline
from folioscope.sources import shards

TEMPLATES = (
    ("Journal Article; Randomized Controlled Trial", "A randomised trial of {} and suicide", "Methods: participants were recruited and data were collected. Results: regression showed an odds ratio of note for {}."),
    ("Journal Article", "Interviews about suicide and {}", "We interviewed people with {}; thematic analysis of semi-structured interviews described lived experience of suicidal thoughts."),
    ("Meta-Analysis; Journal Article", "Suicide and {}: a meta-analysis", "A systematic review; we searched PubMed and studies were included; pooled odds for {} are given."),
    ("Editorial", "Why suicide and {} matter", "In this issue we are pleased to introduce papers on {} and reflect on a conceptual framework for what comes next."),
)
TOPICS = ("veterans", "adolescents", "farmers", "prisoners", "nurses", "students", "older adults", "migrants")
PAD = " More words follow so that every abstract has the length that the screen wants to see, whatever it is about."


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("shards")
    rng = random.Random(1)
    rows = []
    for i in range(240):
        kind, title, body = TEMPLATES[i % 4]
        topic = TOPICS[i % 8] + f" number {i}"
        rows.append({
            "source": "pubmed", "source_id": str(i), "pmid": str(1000 + i), "doi": f"10.1/{i}", "title": title.format(topic), "abstract": body.format(topic) + PAD, "year": 1990 + i % 30, "journal_raw": ("Crisis", "J Affect Disord")[i % 2],
            "issn_l": ("1-1", None)[i % 2], "doc_type_raw": kind, "authors": [{"name": f"Doe, Jo {i % 9}.", "position": 1}], "n_authors": 1 + i % 4, "cited_by_count": rng.randint(0, 50), "venue_tier": ("core_a", "dispersed")[i % 2],
            "mesh_terms": ["Suicide", "Adult"], "mesh_major_terms": ["Suicide"], "funders": ["F"],
        })
    twins = [{**r, "source": "openalex", "pmid": None, "title": r["title"].upper(), "cited_by_count": 99} for r in rows[::6]]
    for name, part in (("pubmed_2000", rows), ("openalex_2000", twins)):
        (folder / f"{name}.ndjson").write_text("\n".join(map(json.dumps, part)))
        shards.mark_complete(spark, str(folder / f"{name}.ndjson"))
    return pipeline.run(spark, str(folder), min_df=2.0, least=20)


def test_whole_way(spark, run):
    records, tables, reports = run
    report = reports["dedup"].first()
    assert (report["input_records"], report["output_records"], report["duplicates_removed"]) == (280, 240, 40)
    got = [r.asDict() for r in records.collect()]
    assert len(got) == 240 and sum(r["source"] == "openalex+pubmed" for r in got) == 40
    assert {r["is_scientific"] for r in got if "Editorial" in r["doc_type_raw"]} == {False}
    assert {(r["is_empirical"], r["methodology"]) for r in got if "Meta" in r["doc_type_raw"]} == {(True, "review")}
    assert tables["growth_summary"].first()["total_articles_in_window"] == 240
    assert all(frame.columns for frame in tables.values())
    assert tables["sdoh_domain_by_decade"].count() > 0 and tables["top_journals"].count() == 2
    assert all(r["passed"] for r in reports["verification"].collect())
    checks = {r["name"]: r["passed"] for r in reports["identities"].collect()}
    assert len(checks) >= 36 and all(checks.values()), [k for k, ok in checks.items() if not ok]
    assert reports["qa"].first()["hard_failures"] == []


def test_relations(spark, run):
    records, _, _ = run
    frames = relational.frames(records)
    j = {r["canonical_name"]: r for r in frames["journals"].collect()}
    assert sorted(r["journal_id"] for r in j.values()) == [1, 2] and j["Crisis"]["venue_tier"] == "core_a"
    assert frames["authors"].count() == 9 and frames["paper_authors"].count() == 240
    assert frames["paper_mesh"].count() == 480 and frames["paper_mesh"].where("is_major_topic").count() == 240
    assert {r["name"]: r["violations"] for r in relational.constraints(frames).collect()} == {k: 0 for k in (r["name"] for r in relational.constraints(frames).collect())}
    assert spark.sql("SELECT count(*) FROM v_analytic_corpus WHERE NOT is_scientific").first()[0] == 0
    out = spark.sql("SELECT * FROM v_annual_output ORDER BY year").collect()
    assert out and all(r["prop_empirical"] is None or r["prop_empirical"] >= r["prop_empirical_of_all"] for r in out)


def test_numbered(spark):
    from pyspark.sql import functions as F

    df = relational.numbered(spark.range(1000).select(F.concat(F.lit("n"), F.col("id")).alias("name")), "name", "k").collect()
    assert [r["name"] for r in sorted(df, key=lambda r: r["k"])] == sorted(r["name"] for r in df) and sorted(r["k"] for r in df) == list(range(1, 1001))


def test_model(spark):
    rows = [(i, 1990 + i % 6, "trial of drugs with regression" if i // 6 % 2 else "essay on meaning and theory", "true" if i // 6 % 2 else "false") for i in range(120)]
    df = spark.createDataFrame(rows, "record_id int, year int, title string, label_is_empirical string").selectExpr("*", "'' as abstract")
    fitted = model.fit_stage(model.prepared(df), "label_is_empirical", min_df=1.0)
    said = model.predict_stage(model.prepared(df), fitted, "x")
    assert said.where("pred_x = label_is_empirical and conf_x > 0.5").count() == 120
    assert "fewer than 40" in model.fit_stage(model.prepared(df.limit(50)), "label_is_empirical")
    assert "two classes" in model.fit_stage(model.prepared(df.where("label_is_empirical = 'true'")), "label_is_empirical")
    cv = model.grouped_cross_validation(df, "label_is_empirical", k=2, min_df=1.0, least=10).collect()
    assert len(cv) == 2 and all(r["percent_agreement"] == 100.0 for r in cv)
