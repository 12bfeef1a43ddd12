"""The relational model: dimensions, link tables and views over the flat table of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import graph

TIERS = ("core_a", "adjacent_b", "dispersed")

VIEWS = {
    "v_analytic_corpus": """
        SELECT p.*, j.canonical_name AS journal, j.venue_tier AS journal_tier,
               e.prevention_level, e.sdoh_focus, e.sdoh_domain, e.population, e.outcome_construct, e.study_design, e.means_focus
        FROM papers p LEFT JOIN journals j ON p.journal_id = j.journal_id LEFT JOIN paper_extraction e ON p.record_id = e.record_id
        WHERE p.screen_pass AND p.is_scientific""",
    # prop_empirical leaves unknown status out; prop_empirical_of_all counts it as not empirical
    "v_annual_output": """
        SELECT publication_year AS year, count(*) AS n_articles, count(DISTINCT journal_id) AS n_journals, round(avg(n_authors), 2) AS mean_authors,
               round(avg(CASE WHEN is_empirical THEN 1.0D WHEN NOT is_empirical THEN 0.0D END), 4) AS prop_empirical,
               round(avg(CASE WHEN is_empirical THEN 1.0D ELSE 0.0D END), 4) AS prop_empirical_of_all,
               round(avg(CASE WHEN cited_by_count = 0 THEN 1.0D WHEN cited_by_count > 0 THEN 0.0D END), 4) AS prop_uncited
        FROM v_analytic_corpus GROUP BY publication_year""",
}


def numbered(dimension: DataFrame, order: str, name: str, parts: int | None = None) -> DataFrame:
    """With 1..n in the order of a column, without gathering rows in one task.

    Rows are sorted over partitions by range and written once, so that sizes and numbers speak of the same partitions;
    only the partitions' sizes, one number each, meet in one place.
    """
    n = parts or int(dimension.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = graph.checkpointed(dimension.repartitionByRange(n, F.col(order)).withColumn("_p", F.spark_partition_id()))
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    sizes = local.groupBy("_p").agg(F.max("_k").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return local.join(F.broadcast(before), "_p").withColumn(name, (F.col("_k") + F.col("_before")).cast("long")).drop("_p", "_k", "_before")  # a row for each partition


def journals(df: DataFrame, venue: str = "journal_canonical", issn: str = "issn_l", publisher: str = "publisher", tier: str = "venue_tier", year: str = "year", key: str = "record_id") -> DataFrame:
    """(journal_id, canonical_name, issn_l, publisher, venue_tier, first_year): ids in order of name, the best tier, the smallest record's known values."""
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key)))
    rank = F.min(F.when(F.col(tier) == TIERS[0], 0).when(F.col(tier) == TIERS[1], 1).otherwise(2))
    best = F.element_at(F.array(*map(F.lit, TIERS)), rank + 1)
    g = df.where(F.coalesce(F.col(venue), F.lit("")) != "").groupBy(F.col(venue).alias("canonical_name")).agg(known(issn).alias("issn_l"), known(publisher).alias("publisher"), best.alias("venue_tier"), F.min(year).alias("first_year"))
    return numbered(g, "canonical_name", "journal_id").select("journal_id", "canonical_name", "issn_l", "publisher", "venue_tier", "first_year")


_PAPER = {
    "record_id": "record_id", "doi": "doi", "pmid": "pmid", "title": "title", "abstract": "abstract", "journal_id": "journal_id", "journal_raw": "journal_raw", "publication_year": "year",
    "publication_date": "pub_date", "volume": "volume", "issue": "issue", "pages": "pages", "doc_type_raw": "doc_type_raw", "language": "language", "is_open_access": "is_oa",
    "references_count": "references_count", "cited_by_count": "cited_by_count", "citation_source": "citation_source", "url": "url", "source_ids": "source_ids", "harvest_ts": "harvest_ts",
    "schema_version": "schema_version", "venue_tier": "venue_tier", "topic_focus": "topic_focus", "screen_pass": "screen_pass", "screen_reason": "screen_reason", "is_scientific": "is_scientific",
    "is_empirical": "is_empirical", "methodology": "methodology", "cls_backend": "cls_backend", "cls_confidence": "cls_confidence",
}
_EXTRACTED = ("prevention_level", "outcome_construct", "population", "study_design", "sdoh_focus", "sdoh_domain", "means_focus", "geography")


def papers(df: DataFrame, journal_table: DataFrame, venue: str = "journal_canonical") -> DataFrame:
    """One row a record, the venue replaced by its id; columns that df lacks are left out."""
    ids = journal_table.select(F.col("canonical_name").alias("_name"), "journal_id")
    joined = df.join(ids, F.col(venue) == F.col("_name"), "left")
    columns = [F.col(c).alias(name) for name, c in _PAPER.items() if c in joined.columns]
    return joined.select(*columns, F.coalesce("n_authors", F.lit(0)).cast("int").alias("n_authors"), F.coalesce("retracted", F.lit(False)).alias("is_retracted"), F.split("source", "[+]").alias("sources"))


def author_links(df: DataFrame, key: str = "record_id", authors: str = "authors") -> DataFrame:
    """(record_id, author_position, author_key, display_name, normalized_name, orcid, raw_affiliation): named authors; the first at a position stands."""
    rows = df.select(F.col(key).alias("record_id"), F.posexplode(authors).alias("_i", "a")).where(F.coalesce(F.col("a.name"), F.lit("")) != "")
    normal = text.normalize_author(F.col("a.name"))
    rows = rows.select("record_id", F.coalesce(F.nullif("a.position", F.lit(0)), F.lit(1)).alias("author_position"), "_i", F.col("a.name").alias("display_name"), normal.alias("normalized_name"), F.col("a.orcid").alias("orcid"), F.col("a.affiliation").alias("raw_affiliation"))
    rows = rows.withColumn("author_key", F.when(F.coalesce("orcid", F.lit("")) != "", F.concat(F.lit("orcid:"), "orcid")).otherwise(F.concat(F.lit("name:"), F.lower("normalized_name"))))
    first = Window.partitionBy("record_id", "author_position").orderBy("_i")
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_i")


def authors(links: DataFrame) -> DataFrame:
    """(author_id, display_name, normalized_name, orcid, is_disambiguated): one row a key, ids in order of key, the name of the smallest record."""
    order = F.struct("record_id", "author_position")
    g = links.groupBy("author_key").agg(F.min_by("display_name", order).alias("display_name"), F.min_by("normalized_name", order).alias("normalized_name"), F.max(F.nullif("orcid", F.lit(""))).alias("orcid"))
    return numbered(g, "author_key", "author_id").withColumn("is_disambiguated", F.col("orcid").isNotNull())


def paper_authors(links: DataFrame, author_table: DataFrame) -> DataFrame:
    return links.join(author_table.select("author_key", "author_id"), "author_key").select("record_id", "author_id", "author_position", "raw_affiliation", (F.col("author_position") == 1).alias("is_first"))


def paper_terms(df: DataFrame, key: str = "record_id", terms: str = "mesh_terms", major: str = "mesh_major_terms") -> DataFrame:
    """(record_id, descriptor, is_major_topic), each descriptor once a record."""
    rows = df.select(F.col(key).alias("record_id"), F.explode(F.array_distinct(terms)).alias("descriptor"), F.col(major).alias("_major")).where("descriptor <> ''")
    return rows.select("record_id", "descriptor", F.coalesce(F.array_contains("_major", F.col("descriptor")), F.lit(False)).alias("is_major_topic")).dropDuplicates(["record_id", "descriptor"])


def paper_funders(df: DataFrame, key: str = "record_id", funders: str = "funders") -> DataFrame:
    return df.select(F.col(key).alias("record_id"), F.explode(funders).alias("funder_name")).where("funder_name <> ''").distinct()


def paper_extraction(df: DataFrame) -> DataFrame:
    return df.select("record_id", *(c for c in _EXTRACTED if c in df.columns), F.col("cls_backend").alias("extraction_backend"), F.col("cls_confidence").alias("extraction_confidence"))


def frames(df: DataFrame) -> dict[str, DataFrame]:
    """All seven tables."""
    j = journals(df)
    links = author_links(df)
    a = authors(links)
    return {"journals": j, "papers": papers(df, j), "authors": a.drop("author_key"), "paper_authors": paper_authors(links, a), "paper_mesh": paper_terms(df), "paper_funders": paper_funders(df), "paper_extraction": paper_extraction(df)}


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Tables and views for spark.sql()."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, violations) of keys, references and ranges."""
    p, j = tables["papers"], tables["journals"]

    def unique(df: DataFrame, *columns: str) -> DataFrame:
        known = df.dropna(subset=list(columns))
        return known.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("violations"))

    def orphans(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
        return child.where(F.col(column).isNotNull()).join(parent.select(column).distinct(), column, "left_anti").agg(F.count(F.lit(1)).alias("violations"))

    found = {
        "papers.record_id is unique": unique(p, "record_id"), "papers.doi is unique": unique(p, "doi"), "papers.pmid is unique": unique(p, "pmid"), "journals.canonical_name is unique": unique(j, "canonical_name"),
        "authors.orcid is unique": unique(tables["authors"], "orcid"), "papers.journal_id refers": orphans(p, j, "journal_id"), "paper_authors.author_id refers": orphans(tables["paper_authors"], tables["authors"], "author_id"),
        "years and citations in range": p.agg(F.count_if((F.col("publication_year") < 1800) | (F.col("publication_year") > 2100) | (F.col("cited_by_count") < 0)).alias("violations")),
    }
    out = None
    for name, frame in found.items():
        row = frame.select(F.lit(name).alias("name"), "violations")
        out = row if out is None else out.unionByName(row)
    return out
