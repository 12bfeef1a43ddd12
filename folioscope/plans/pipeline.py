"""The whole way from shards to tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import enrich, labels, linkage, metrics, model, quality, relational, screening, venues
from folioscope.operators.graph import checkpointed
from folioscope.plans import config
from folioscope.sources import shards


@dataclass
class Integrated:
    records: DataFrame
    reports: dict[str, DataFrame] = field(default_factory=dict)


def integrate(records: DataFrame, cfg: dict | None = None) -> Integrated:
    """Duplicates out, venues named, topic screened, quality counted; in that order, so that names see each work once."""
    if "row_id" not in records.columns:
        records = records.withColumn("row_id", F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("source_id", F.lit("")), F.xxhash64("doi", "pmid", "title", "abstract").cast("string"))).dropDuplicates(["row_id"])
    works, review, report = linkage.deduplicate(records)
    by_issn, by_key = venues.learn(works)
    named = venues.resolve(works, by_issn, by_key)
    screened = checkpointed(screening.screen(named, cfg))
    return Integrated(screened, {"dedup": report, "review_pairs": review, "venues": venues.normalisation_log(screened), "screen": screening.report(screened), "qa": quality.qa_checks(screened)})


def classify(records: DataFrame, min_df: float = model.MIN_DF, least: int = model.LEAST_PER_CLASS, hashed: bool = False) -> DataFrame:
    """Evidence by rules and metadata, a text model where labels suffice, and the decision over all."""
    labelled = checkpointed(labels.composite_labels(labels.metadata_labels(labels.rule_labels(records))))
    return labels.decide(model.predict(labelled, model.fit(labelled, min_df, least, hashed)))


def analyse(records: DataFrame, cfg: dict | None = None) -> dict[str, DataFrame]:
    """All tables of the analysis, by name. Publication counts and citations end in different years."""
    dates = (cfg or config.DEFAULTS)["date_range"]
    first, last, cited_to = dates["baseline_year"], dates["trend_end_year"], dates["citation_end_year"]
    df = records.where("year is not null")
    growth = metrics.growth_by_year(df, first, last, venue="journal_canonical")
    out = {
        "growth_by_year": growth,
        "growth_summary": metrics.growth_summary(growth),
        "records_by_decade": metrics.records_by_decade(df),
        "empiricism_by_year": metrics.empiricism_by_year(df, last),
        "empiricism_by_decade": metrics.empiricism_by_decade(df),
        "empiricism_headline": metrics.empiricism_headline(df),
        "methodology_overall": metrics.methodology_distribution(df),
        "methodology_by_year": metrics.methodology_by_year(df, last),
        "methodology_by_decade": metrics.methodology_by_decade(df),
        "collaboration_by_year": metrics.collaboration_by_year(df, last),
        "collaboration_by_decade": metrics.collaboration_by_decade(df),
        "author_count_distribution": metrics.author_count_distribution(df),
        "citation_summary": metrics.citation_summary(df, cited_to),
        "top_journals": metrics.top_venues(df, last=cited_to, venue="journal_canonical"),
        "citations_by_methodology": metrics.citations_by_methodology(df, cited_to),
        "uncited_by_year": metrics.uncited_by_year(df, cited_to),
        "dispersion_by_year": metrics.dispersion_by_year(df, last),
        "specialty_vs_dispersed": metrics.specialty_vs_dispersed(df, cited_to),
        "sdoh_focus_by_decade": metrics.focus_share(df, "sdoh_focus", by_decade=True),
        "source_overlap": metrics.source_overlap(df),
        "corpus": metrics.corpus_block(df, last, venue="journal_canonical"),
    }
    for name in ("prevention_level", "outcome_construct", "population", "study_design", "sdoh_domain", "means_focus"):
        multi = name != "prevention_level"
        out[f"{name}_overall"] = metrics.field_distribution(df, name, multi)
        out[f"{name}_by_decade"] = metrics.field_by_decade(df, name, multi)
    return out


def run(spark: SparkSession, shard_folder: str, channels: list[str] | None = None, citation_metrics: DataFrame | None = None, cfg: dict | None = None, min_df: float = model.MIN_DF, least: int = model.LEAST_PER_CLASS) -> tuple[DataFrame, dict[str, DataFrame], dict[str, DataFrame]]:
    """(records, tables, reports): shards -> works -> screened -> enriched -> classified -> tables; views are registered."""
    done = integrate(shards.read_shards(spark, shard_folder, channels).drop("channel"), cfg)
    records = screening.passed(done.records)
    if citation_metrics is not None:
        records = enrich.attach(records, citation_metrics)
    records = checkpointed(classify(records, min_df, least))
    relational.register(spark, relational.frames(records))
    tables = analyse(records, cfg)
    done.reports["verification"] = quality.verify(records, tables["growth_by_year"], done.records)
    done.reports["identities"] = quality.identities(tables)
    return records, tables, done.reports
