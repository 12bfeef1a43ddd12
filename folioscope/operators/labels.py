"""Labels by rules, by provider metadata and by both, and the decision over all evidence. Native expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.plans import patterns as P

HUMAN = ("medline", "medline_narrative_review", "medline_systematic_review")
STRUCTURAL = ("structured_abstract",)
CONFIDENCE_FLOOR = 0.55


def match_all(text: Column, dictionary: dict[str, tuple[str, ...]], low: Column | None = None, heads: Column | None = None) -> Column:
    """Every label whose pattern the text holds, in declared order. `low` and `heads` are the text's lowered form and its words' heads, if they're at hand."""
    return F.array_compact(F.array(*(F.when(P.holds(text, alts, low, heads), F.lit(label)) for label, alts in dictionary.items())))


def match_first(text: Column, dictionary: dict[str, tuple[str, ...]], low: Column | None = None, heads: Column | None = None) -> Column:
    """The first label in declared order whose pattern the text holds, else null. Later patterns aren't tried."""
    return F.coalesce(*(F.when(P.holds(text, alts, low, heads), F.lit(label)) for label, alts in dictionary.items()))


def methodology(text: Column, low: Column | None = None, heads: Column | None = None) -> Column:
    """review before mixed before the tradition with more hits; equal hits are mixed, none at all null."""
    quant, qual = P.hits(text, P.QUANTITATIVE, low, heads), P.hits(text, P.QUALITATIVE, low, heads)
    some = P.holds(text, P.QUANTITATIVE, low, heads) | P.holds(text, P.QUALITATIVE, low, heads)
    # each is counted once, so one expression tells the three outcomes
    counts = F.when(some, F.get(F.array(*map(F.lit, ("quantitative", "mixed", "qualitative"))), (F.signum(qual - quant) + 1).cast("int")))
    return F.when(P.holds(text, P.REVIEW, low, heads), "review").when(P.holds(text, P.MIXED, low, heads), "mixed").otherwise(counts)


def empirical(text: Column, low: Column | None = None, heads: Column | None = None) -> Column:
    """True by a marker of data, false by one of argument alone, else null."""
    return F.when(P.holds(text, P.EMPIRICAL, low, heads), True).when(P.holds(text, P.NON_EMPIRICAL, low, heads), False)


def rule_labels(records: DataFrame, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """With the rule_ columns and the six dictionaries' labels."""
    text = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(". "), F.coalesce(F.col(abstract), F.lit("")))
    df, (text, low, heads) = P.worded(records, text)
    found = {"rule_is_scientific": ~P.holds(text, P.NON_SCIENTIFIC, low, heads), "rule_is_empirical": empirical(text, low, heads), "rule_methodology": methodology(text, low, heads)}
    for name, (dictionary, several, _) in P.DICTIONARIES.items():
        found[name] = match_all(text, dictionary, low, heads) if several else match_first(text, dictionary, low, heads)
    df = df.withColumns(found).withColumn("sdoh_focus", F.size("sdoh_domain") > 0)
    given = {
        name: F.when(F.size(name) == 0, F.array(F.lit(default))).otherwise(F.col(name)) if several else F.coalesce(name, F.lit(default))
        for name, (_, several, default) in P.DICTIONARIES.items()
        if default is not None
    }
    return df.withColumns(given).drop("_text", "_text_low", "_text_heads")


def tags(doc_type: Column) -> Column:
    """A provider's document types as lower-case tags; comma and semicolon both separate."""
    parts = F.transform(F.split(F.lower(F.coalesce(doc_type, F.lit(""))), "[;,]"), lambda t: F.trim(t))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def _literals(values) -> Column:
    return F.array(*map(F.lit, values))


def metadata_labels(records: DataFrame, doc_type: str = "doc_type_raw", mesh: str = "mesh_terms") -> DataFrame:
    """With meta_is_scientific, meta_is_empirical, meta_methodology and meta_source; null is no evidence."""
    df = records.withColumn("_tags", tags(F.col(doc_type)))
    has = lambda tag: F.array_contains("_tags", tag)
    some = F.size("_tags") > 0
    return df.withColumns({
        "meta_is_scientific": F.when(some, ~F.arrays_overlap("_tags", _literals(P.NON_SCIENTIFIC_TAGS))),
        "meta_is_empirical": F.coalesce(*(F.when(has(t), F.lit(e)) for t, e, _ in P.TAG_PRIORITY)),
        "meta_methodology": F.coalesce(*(F.when(has(t), F.lit(m)) for t, _, m in P.TAG_PRIORITY if m)),
        "meta_source": F.when(F.size(mesh) > 0, "medline").when(some, "provider_type"),
    }).drop("_tags")


def review_signal(doc_type: Column, abstract: Column, low: Column | None = None, heads: Column | None = None) -> Column:
    """systematic or narrative for what is tagged a review, else null."""
    own = tags(doc_type)
    systematic = F.arrays_overlap(own, _literals(P.SYSTEMATIC_TAGS))
    return F.when(systematic, "systematic").when(F.array_contains(own, "review"), F.when(P.holds(F.coalesce(abstract, F.lit("")), P.SYSTEMATIC_TEXT, low, heads), "systematic").otherwise("narrative"))


def structured_abstract_signal(abstract: Column, low: Column | None = None, heads: Column | None = None) -> Column:
    """empirical for an abstract of 150 characters or more with headings for methods and for results, else null."""
    return F.when((F.length(abstract) >= 150) & P.holds(abstract, P.METHODS_HEADING, low, heads) & P.holds(abstract, P.RESULTS_HEADING, low, heads), "empirical")


def _first(*cases: tuple[Column, Column, str]) -> Column:
    """struct(label, source) of the first case whose condition is true."""
    return reduce(
        lambda rest, case: F.when(case[0], F.struct(case[1].alias("label"), F.lit(case[2]).alias("source"))).otherwise(rest),
        reversed(cases),
        F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("source")),
    )


def composite_labels(records: DataFrame, abstract: str = "abstract", doc_type: str = "doc_type_raw") -> DataFrame:
    """With label_ and label_source_ columns for the three stages, and review_type. Needs the rule_ and meta_ columns."""
    df, body = P.worded(records, F.coalesce(F.col(abstract), F.lit("")), "_body")
    df = df.withColumns({"review_type": review_signal(F.col(doc_type), *body), "_structure": structured_abstract_signal(*body), "_marker": P.holds(body[0], P.EMPIRICAL_MARKER, *body[1:])}).drop("_body", "_body_low", "_body_heads")
    text = lambda c: F.col(c).cast("string")
    yes, no = F.lit("true"), F.lit("false")
    is_review = lambda kind: F.col("review_type").eqNullSafe(kind)
    denied = lambda c: F.col(c).eqNullSafe(False)
    scientific = _first((F.col("meta_is_scientific").isNotNull(), text("meta_is_scientific"), "medline"), (denied("rule_is_scientific"), no, "lexical_rule"))
    empirical = _first(
        (F.col("meta_is_empirical").isNotNull(), text("meta_is_empirical"), "medline"),
        (is_review("narrative"), no, "medline_narrative_review"),
        (is_review("systematic"), yes, "medline_systematic_review"),
        (F.col("_structure").isNotNull(), yes, "structured_abstract"),
        (denied("rule_is_empirical") & ~F.col("_marker"), no, "lexical_rule"),
    )
    df = df.withColumns({"_scientific": scientific, "_empirical": empirical})
    argued = F.col("_empirical.label").eqNullSafe("false")
    method = _first(
        (F.col("meta_methodology").isNotNull(), F.col("meta_methodology"), "medline"),
        (is_review("systematic"), F.lit("review"), "medline_systematic_review"),
        (F.col("rule_methodology").isNotNull() & ~argued, F.col("rule_methodology"), "lexical_rule"),
    )
    df = df.withColumn("_method", method)
    out = {}
    for stage, c, kind in (("is_scientific", "_scientific", "boolean"), ("is_empirical", "_empirical", "boolean"), ("methodology", "_method", "string")):
        out[f"label_{stage}"] = F.col(f"{c}.label").cast(kind)
        out[f"label_source_{stage}"] = F.col(f"{c}.source")
    return df.withColumns(out).drop("_structure", "_marker", "_scientific", "_empirical", "_method")


def decide(records: DataFrame, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """The final labels by the hierarchy of evidence, with cls_backend and cls_confidence.

    Needs the composite labels and, for each stage, a model's prediction `pred_` (text) and confidence `conf_`, null
    where no model was fitted. People's indexing stands before structure, structure before a confident model, that
    before rules; without any of them the label is null. A stage is skipped where the one before rules it out.
    """
    human = lambda s: F.coalesce(F.col(f"label_source_{s}").isin(*HUMAN), F.lit(False)) & F.col(f"label_{s}").isNotNull()
    conf = lambda s: F.coalesce(F.col(f"conf_{s}"), F.lit(0.0))
    sure = lambda s: (conf(s) >= floor) & F.col(f"pred_{s}").isNotNull()

    def made(label: Column, source: str, confidence: Column) -> Column:
        return F.struct(label.cast("string").alias("label"), F.lit(source).alias("source"), confidence.cast("double").alias("conf"))

    one, nothing = F.lit(1.0), F.lit(None)
    s = "is_scientific"
    df = records.withColumn("_s", F.when(human(s), made(F.col(f"label_{s}"), "human_indexing", one)).when(sure(s), made(F.col(f"pred_{s}"), "model", conf(s))).otherwise(made(F.coalesce("rule_is_scientific", F.lit(True)), "rule", conf(s))))
    e = "is_empirical"
    structural = F.coalesce(F.col(f"label_source_{e}").isin(*STRUCTURAL), F.lit(False)) & F.col(f"label_{e}").isNotNull()
    df = df.withColumn(
        "_e",
        F.when(F.col("_s.label") != "true", made(nothing, "na", one))
        .when(human(e), made(F.col(f"label_{e}"), "human_indexing", one))
        .when(structural, made(F.col(f"label_{e}"), "structured_abstract", F.lit(0.95)))
        .when(sure(e), made(F.col(f"pred_{e}"), "model", conf(e)))
        .when(F.col(f"label_{e}").isNotNull(), made(F.col(f"label_{e}"), "rule", conf(e)))
        .otherwise(made(nothing, "uncertain", conf(e))),
    )
    m = "methodology"
    df = df.withColumn(
        "_m",
        F.when(~F.col("_e.label").eqNullSafe("true"), made(nothing, "na", one))
        .when(human(m), made(F.col(f"label_{m}"), "human_indexing", one))
        .when(sure(m), made(F.col(f"pred_{m}"), "model", conf(m)))
        .when(F.col(f"label_{m}").isNotNull(), made(F.col(f"label_{m}"), "rule", conf(m)))
        .otherwise(made(nothing, "uncertain", conf(m))),
    )
    return df.withColumns({
        "is_scientific": F.col("_s.label").cast("boolean"),
        "is_empirical": F.col("_e.label").cast("boolean"),
        "methodology": F.col("_m.label"),
        "cls_backend": F.concat(F.lit("scientific:"), "_s.source", F.lit("|empirical:"), "_e.source", F.lit("|method:"), "_m.source"),
        "cls_confidence": F.round(F.least("_s.conf", "_e.conf", "_m.conf"), 4),
    }).drop("_s", "_e", "_m")


STAGES = ("is_scientific", "is_empirical", "methodology")


def label_report(records: DataFrame) -> DataFrame:
    """(stage, source, label, n): labelled records by stage, source and class; null labels aren't counted."""
    rows = records.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"label_source_{s}").alias("source"), F.col(f"label_{s}").cast("string").alias("label")) for s in STAGES))).alias("x"))
    return rows.select("x.*").where("label is not null").groupBy("stage", "source", "label").agg(F.count(F.lit(1)).alias("n"))


def label_coverage(records: DataFrame) -> DataFrame:
    """(stage, n_records, n_labelled, pct_labelled)."""
    one = records.agg(F.count(F.lit(1)).alias("n"), *(F.count(f"label_{s}").alias(s) for s in STAGES))
    rows = one.select("n", F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("n_labelled")) for s in STAGES))).alias("x"))
    return rows.select("x.stage", F.col("n").alias("n_records"), "x.n_labelled", F.round(100.0 * F.col("x.n_labelled") / F.greatest("n", F.lit(1)), 2).alias("pct_labelled"))


def backend_mix(records: DataFrame, top: int = 12) -> DataFrame:
    """The most frequent ways in which labels were decided."""
    return records.groupBy("cls_backend").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cls_backend").limit(top)


def answered_labels(records: DataFrame, ask, stages: tuple[str, ...] = STAGES, title: str = "title", abstract: str = "abstract", key: str = "record_id") -> DataFrame:
    """(key, one column a stage) from any answering model: `ask(stage, title, abstract)` returns prose with a JSON object.

    A later stage isn't asked once an earlier one was answered `false`. Answers that can't be read are `uncertain`.
    `ask` runs in Python workers, batch by batch; it must be picklable.
    """
    import json
    import re

    import pandas as pd

    kind = records.schema[key].dataType.simpleString()

    def read(said: str, stage: str) -> str:
        found = re.search(r"\{.*\}", said or "", re.S)
        try:
            value = json.loads(found[0]).get(stage) if found else None
        except (ValueError, AttributeError):
            value = None
        return "uncertain" if value is None else str(value).lower()

    def run(batches):
        for batch in batches:
            out = {key: batch[key], **{s: [] for s in stages}}
            for t, a in zip(batch[title], batch[abstract]):
                stopped = False
                for s in stages:
                    value = None if stopped else read(ask(s, t or "", a or ""), s)
                    out[s].append(value)
                    stopped = stopped or value == "false"
            yield pd.DataFrame(out)

    return records.select(key, title, abstract).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{s} string" for s in stages))
