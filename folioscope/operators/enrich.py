"""Enrichment with citation metrics by PMID."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The provider's field and ours.
ATTACHED = {
    "relative_citation_ratio": "relative_citation_ratio", "nih_percentile": "nih_percentile", "field_citation_rate": "field_citation_rate", "expected_citations_per_year": "expected_citations_per_year",
    "cited_by_clin": "n_clinical_citations", "is_clinical": "is_clinical", "human": "research_level_human", "animal": "research_level_animal", "molecular_cellular": "research_level_molecular",
}


def attach(records: DataFrame, metrics: DataFrame, overwrite: bool = False, key: str = "pmid", cited: str = "cited_by_count", source_name: str = "icite") -> DataFrame:
    """Fills citation counts that are null (all, with overwrite) and attaches the other measures to every match.

    A record without a match keeps its nulls: unknown isn't 0. Several metric rows of one key count once.
    """
    m = metrics.where(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string")).dropDuplicates(["_key"])
    found = [c for c in ATTACHED if c in m.columns]
    m = m.select("_key", F.col("citation_count").cast("int").alias("_count"), *(F.col(c).alias(f"_m_{c}") for c in found))
    df = records.withColumn("_key", F.col(key).cast("string")).join(m, "_key", "left")
    fill = F.col("_count").isNotNull() if overwrite else F.col("_count").isNotNull() & F.col(cited).isNull()
    out = {cited: F.when(fill, F.col("_count")).otherwise(F.col(cited)), "citation_source": F.when(fill, source_name).otherwise(F.col("citation_source") if "citation_source" in records.columns else F.lit(None))}
    for c in found:
        value = F.col(f"_m_{c}")
        if dict(metrics.dtypes)[c].startswith("array"):
            value = F.when(value.isNotNull(), F.size(value))
        out[ATTACHED[c]] = F.coalesce(value, F.col(ATTACHED[c])) if ATTACHED[c] in records.columns else value
    return df.withColumns(out).drop("_key", "_count", *(f"_m_{c}" for c in found))


def report(before: DataFrame, after: DataFrame, key: str = "pmid", cited: str = "cited_by_count") -> DataFrame:
    """One row: records, with an id, with a count before and after."""
    b = before.agg(F.count(F.lit(1)).alias("n_records"), F.count(key).alias("n_with_id"), F.count(cited).alias("n_counted_before"))
    a = after.agg(F.count(cited).alias("n_counted_after"))
    return b.join(a).withColumn("n_filled", F.col("n_counted_after") - F.col("n_counted_before"))  # one row each


def source_mix(records: DataFrame, top: int = 10) -> DataFrame:
    return records.where("citation_source is not null").groupBy("citation_source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "citation_source").limit(top)
