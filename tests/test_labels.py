from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.operators import labels, screening
from folioscope.plans import config, patterns

PAD = " This sentence makes the abstract as long as the screen asks for, and says nothing of its own." * 2


@pytest.mark.parametrize(
    ("title", "abstract", "year", "tier", "want"),
    [
        ("Suicide gene therapy in tumours", "x" + PAD, 2000, "dispersed", "metaphorical_use"),
        ("A political suicide", "x" + PAD, 2000, "dispersed", "metaphorical_use"),
        ("Survivors of a suicide bombing", "mental health" + PAD, 2000, "dispersed", "pass"),
        ("Suicide in youth", "x" + PAD, 2000, "dispersed", "pass"),
        ("Suicide in youth", "short", 2000, "core_a", "no_or_short_abstract"),
        ("Grief", "x" + PAD, 2000, "core_a", "pass"),
        ("Grief", "x" + PAD, 2000, None, "no_topical_term"),
        ("Suicide", "x" + PAD, None, "core_a", "no_publication_year"),
        (None, None, None, None, "no_or_short_abstract"),
    ],
)
def test_screen(spark, title, abstract, year, tier, want):
    df = spark.createDataFrame([(title, abstract, year, tier)], "title string, abstract string, year int, venue_tier string")
    got = screening.screen(df).first()
    assert (got["screen_reason"], got["screen_pass"]) == (want, want == "pass")


def rules(spark, abstract, title=""):
    return labels.rule_labels(spark.createDataFrame([(title, abstract)], "title string, abstract string")).first()


def test_rules(spark):
    r = rules(spark, "We used semi-structured interviews and thematic analysis.")
    assert (r["rule_methodology"], r["rule_is_empirical"]) == ("qualitative", True)
    assert rules(spark, "A systematic review with pooled odds ratio.")["rule_methodology"] == "review"
    assert rules(spark, "A mixed-methods study with regression.")["rule_methodology"] == "mixed"
    r = rules(spark, "This paper argues for a conceptual framework.")
    assert r["rule_is_empirical"] is False and r["rule_methodology"] is None
    r = rules(spark, "Firearm access among veterans and neighbourhood effects on suicide deaths; safety planning.")
    assert "firearm" in r["means_focus"] and r["sdoh_focus"] and "veteran_military" in r["population"] and "suicide_death" in r["outcome_construct"] and r["prevention_level"] == "indicated"
    r = rules(spark, None)
    assert (r["prevention_level"], r["outcome_construct"], r["population"], r["study_design"], r["sdoh_domain"], r["means_focus"], r["sdoh_focus"]) == ("not_applicable", ["not_specified"], ["general_population"], [], ["none"], ["none"], False)
    assert rules(spark, "An obituary.")["rule_is_scientific"] is False
    assert rules(spark, "regression; focus group")["rule_methodology"] == "mixed"  # one hit each
    assert "indigenous" in rules(spark, "MĀORI communities")["population"]


def test_literals_are_needed(spark):
    """What a plain search leaves out, no pattern matches; literals stand in their patterns word by word."""
    alts = [a for d, _, _ in patterns.DICTIONARIES.values() for alternatives in d.values() for a in alternatives]
    assert all(w in b.lower() for a in alts for b in patterns.branches(a) for w in patterns.required_literal(b).split())
    for branch, want in (("[0-9]{4,}", ""), (r"ab{0,3}cde", "cde"), (r"\bLatin[oax]+\b", " latin"), (r"cats?", "cat"), (r"\bgun\b", " gun "), (r"\bself-harm(?:ing)?\b", " self harm"), (r"\b95%\s*CI\b", " 95 ")):
        assert patterns.required_literal(branch) == want
    texts = ["the 95% CI was", "n = 12", "p < 0.05", "we analysed data", "Time-series ARIMA", "LGBT", "case control", "casecontrol", "income level", "heatwave", "a barrier", "self-harm", "Self Mutilation", "ſelf-harm", "SELF-İNJURY", "(gun)", "gun", "a gunner", "gun-law", "95%CI", "écut", "cut.", "\n gay\tmen,", "self--harm", "time_series time–series"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    groups = [*[alts for d, _, _ in patterns.DICTIONARIES.values() for alts in d.values()], patterns.EMPIRICAL, patterns.QUANTITATIVE]
    pairs = [F.struct(patterns.holds(F.col("t"), g).alias("a"), F.col("t").rlike(patterns.pattern(g)).alias("b")).alias(f"g{k}") for k, g in enumerate(groups)]
    for row in df.select("t", *pairs).collect():
        assert not [groups[k] for k in range(len(groups)) if row[f"g{k}"]["a"] != row[f"g{k}"]["b"]], row["t"]


def test_heads_and_signs_leave_nothing_out(spark):
    """Rules that look at heads and signs first say the same as patterns alone; few searches are left for a text that says nothing."""
    assert patterns.head(" self harm ") == "self" and patterns.head("structured interview") == "inter" and patterns.head(" obituar") == "obitu" and patterns.head(" gun") == patterns.head("poisoning ") == ""
    assert patterns.spelled_out(r"\b(?:a|b(?:c|d)e)\b") == [r"\ba\b", r"\bb(?:c|d)e\b"] and patterns.spelled_out("(?:a)(?:b)") == ["(?:a)(?:b)"]
    assert [patterns.required_signs(b) for b in (r"\bn\s*=\s*\d", r"p\s*[<>=]\s*0?", "a=?", "a(?:b)", "x[<>=]*")] == ["=", "<>=", "", "", ""]
    groups = [*[alts for d, _, _ in patterns.DICTIONARIES.values() for alts in d.values()], patterns.EMPIRICAL, patterns.QUANTITATIVE, patterns.METHODS_HEADING, patterns.RESULTS_HEADING, patterns.EMPIRICAL_MARKER, patterns.SYSTEMATIC_TEXT]
    words = sorted({w for g in groups for a in g for b in patterns.branches(a) for w in patterns.required_literal(b).split()})
    texts = [" ".join(words[k : k + 3]) for k in range(0, len(words), 2)] + [w.upper() + "s, x" for w in words] + ["n = 12", "N=3", "p<.05", "p > 0.1", "p 0.1", "Methods: x", "METHOD :", "Findings:", "CBT", "dbt.", "gun-law", "(guns)", "self-harm", "selfharm", "ſelf-harm", "nonbinary", "logistic regression, odds ratio; cox regression; randomized control group and p < .05", "in-depth interviews, a case study, focus groups, IPA", "", "plain words alone"]
    df, (t, low, heads) = patterns.worded(spark.createDataFrame([(x,) for x in texts], "t string"), F.col("t"))
    pairs = [F.struct(patterns.holds(t, g, low, heads).alias("a"), F.col("t").rlike(patterns.pattern(g)).alias("b")).alias(f"g{k}") for k, g in enumerate(groups)]
    rows = df.select("t", "_text_heads", *pairs).collect()
    counts = df.select("t", *(F.struct(patterns.hits(t, g, low, heads).alias("a"), F.regexp_count(t, F.lit(patterns.pattern(g))).alias("b")).alias(f"g{k}") for k, g in enumerate((patterns.QUANTITATIVE, patterns.QUALITATIVE))))
    assert not [r for r in counts.collect() for k in range(2) if r[f"g{k}"]["a"] != r[f"g{k}"]["b"]]
    assert not [(r["t"], groups[k]) for r in rows for k in range(len(groups)) if r[f"g{k}"]["a"] != r[f"g{k}"]["b"]]
    assert [r["_text_heads"] for r in rows if r["t"] == "plain words alone"] == [[]]


def evidence(spark, doc_type, abstract="", mesh=None):
    df = spark.createDataFrame([("", abstract, doc_type, mesh)], "title string, abstract string, doc_type_raw string, mesh_terms array<string>")
    return labels.composite_labels(labels.metadata_labels(labels.rule_labels(df)))


def test_metadata(spark):
    r = evidence(spark, "Journal Article; Randomized Controlled Trial", mesh=["Suicide"]).first()
    assert (r["meta_is_scientific"], r["meta_is_empirical"], r["meta_methodology"], r["meta_source"]) == (True, True, "quantitative", "medline")
    assert evidence(spark, "Editorial").first()["meta_is_scientific"] is False
    assert evidence(spark, "Journal Article; Review").first()["meta_methodology"] is None
    r = evidence(spark, "Meta-Analysis, Journal Article").first()
    assert (r["meta_is_empirical"], r["meta_methodology"]) == (True, "review")
    assert evidence(spark, None).first()["meta_is_scientific"] is None


def test_composite(spark):
    r = evidence(spark, "Review").first()
    assert (r["review_type"], r["label_is_empirical"], r["label_source_is_empirical"]) == ("narrative", False, "medline_narrative_review")
    r = evidence(spark, "Review", "We searched PubMed.").first()
    assert (r["label_is_empirical"], r["label_methodology"], r["label_source_methodology"]) == (True, "review", "medline_systematic_review")
    r = evidence(spark, "article", "Methods: x. Results: y." + PAD).first()
    assert r["label_source_is_empirical"] == "structured_abstract"
    r = evidence(spark, None, "This paper argues. Data were collected.").first()
    assert r["label_is_empirical"] is None  # a marker of data speaks against
    r = evidence(spark, None, "An obituary").first()
    assert (r["label_is_scientific"], r["label_source_is_scientific"]) == (False, "lexical_rule")
    assert labels.label_report(evidence(spark, "Review")).count() == 2
    assert {r["stage"]: r["n_labelled"] for r in labels.label_coverage(evidence(spark, "Review")).collect()} == {"is_scientific": 1, "is_empirical": 1, "methodology": 0}


def decided(df, **model):
    for s in labels.STAGES:
        pred, conf = model.get(s, (None, None))
        df = df.withColumns({f"pred_{s}": F.lit(pred).cast("string"), f"conf_{s}": F.lit(conf).cast("double")})
    return labels.decide(df).first()


def test_decide(spark):
    r = decided(evidence(spark, "Journal Article; Randomized Controlled Trial"), is_empirical=("false", 0.99))
    assert (r["is_scientific"], r["is_empirical"], r["methodology"], r["cls_confidence"]) == (True, True, "quantitative", 1.0)
    assert r["cls_backend"] == "scientific:human_indexing|empirical:human_indexing|method:human_indexing"
    r = decided(evidence(spark, None, "plain"), is_scientific=("true", 0.9), is_empirical=("true", 0.8), methodology=("mixed", 0.5))
    assert (r["is_empirical"], r["methodology"], r["cls_backend"]) == (True, None, "scientific:model|empirical:model|method:uncertain")
    r = decided(evidence(spark, None, "plain"), is_scientific=("false", 0.9))
    assert (r["is_scientific"], r["is_empirical"], r["methodology"], r["cls_backend"]) == (False, None, None, "scientific:model|empirical:na|method:na")
    r = decided(evidence(spark, None, "plain").withColumn("rule_is_scientific", F.lit(None).cast("boolean")))
    assert r["is_scientific"] is True  # blinded evidence doesn't deny


def test_answers(spark):
    df = spark.createDataFrame([("r", "t", "a"), ("s", "no", "b")], "record_id string, title string, abstract string")

    def ask(stage, title, abstract):
        return "garbage" if stage == "methodology" else 'I say {"%s": "%s"}' % (stage, "false" if title == "no" else "True")

    got = {r["record_id"]: r for r in labels.answered_labels(df, ask).collect()}
    assert (got["r"]["is_scientific"], got["r"]["is_empirical"], got["r"]["methodology"]) == ("true", "true", "uncertain")
    assert (got["s"]["is_scientific"], got["s"]["is_empirical"]) == ("false", None)


def test_config(tmp_path):
    p = tmp_path / "c.yml"
    p.write_text("date_range:\n  trend_end_year: 2001\n")
    cfg = config.load(str(p))
    assert cfg["date_range"]["trend_end_year"] == 2001 and cfg["date_range"]["baseline_year"] == 1989 and config.DEFAULTS["date_range"]["trend_end_year"] == 2025
