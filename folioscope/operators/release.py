"""Release: what may be published, its figures and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.numbers import share

WITHHELD = ("abstract",)
WITHHELD_PREFIXES = ("meta_", "rule_", "label_", "_")
KEPT = ("label_source_is_scientific", "label_source_is_empirical", "label_source_methodology")


def public(df: DataFrame) -> DataFrame:
    """Without abstracts and working columns; the sources of labels stay."""
    return df.drop(*(c for c in df.columns if c in WITHHELD or c.startswith(WITHHELD_PREFIXES) and c not in KEPT))


def manifest(df: DataFrame, key: str = "record_id", year: str = "year", doi: str = "doi", venue: str = "journal_canonical") -> DataFrame:
    """One row: records, span, coverage, venues."""
    one = df.agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(key).alias("n_ids"), F.min(year).alias("year_min"), F.max(year).alias("year_max"), F.count(doi).alias("_doi"), F.countDistinct(venue).alias("n_venues"))
    return one.withColumn("doi_coverage_pct", share(F.col("_doi"), F.col("n_records"))).drop("_doi")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below a path, hashed where they're read. Files over 2 GB can't be read whole."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write(df: DataFrame, path: str) -> None:
    public(df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def rendered(template: str, values: dict) -> str:
    """A text with `{{a.b[0].c|fmt}}` filled in; a name that isn't there is an error, never an empty place."""
    import re

    def fill(m: re.Match) -> str:
        path, _, fmt = m[1].strip().partition("|")
        here = values
        for name, index in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path):
            here = here[int(index)] if index else here[name]
        return format(here, fmt.strip()) if fmt else str(here)

    return re.sub(r"\{\{([^{}]+)\}\}", fill, template)
