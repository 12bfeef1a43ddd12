"""Data quality: conditional counts in one pass, constraints, and named checks of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.numbers import share

#: Checks that must count nothing.
HARD = ("duplicate_record_ids", "year_out_of_range", "negative_citations")


def qa_checks(df: DataFrame, key: str = "record_id", doi: str = "doi", title: str = "title", abstract: str = "abstract", year: str = "year", venue: str = "journal_canonical", n_authors: str = "n_authors", cited: str = "cited_by_count", years: tuple[int, int] = (1900, 2026)) -> DataFrame:
    """One row of counts and coverages, and hard_failures: the names of the checks in HARD that count something."""
    empty = lambda c: F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) == 0
    y, c, n = F.col(year), F.coalesce(F.col(cited), F.lit(0)), F.coalesce(F.col(n_authors), F.lit(0))
    one = df.agg(
        F.count(F.lit(1)).alias("n_records"),
        (F.count(F.lit(1)) - F.countDistinct(F.coalesce(F.col(key).cast("string"), F.lit("\x00")))).alias("duplicate_record_ids"),
        (F.count(doi) - F.countDistinct(doi)).alias("duplicate_dois"),
        F.count_if(empty(title)).alias("missing_title"), F.count_if(empty(abstract)).alias("missing_abstract"), F.count_if(y.isNull()).alias("missing_year"), F.count_if(empty(venue)).alias("missing_venue"),
        F.count_if((y < years[0]) | (y > years[1])).alias("year_out_of_range"), F.count_if(n == 0).alias("zero_author_records"), F.count_if(n > 200).alias("implausible_author_count"),
        F.count_if(c < 0).alias("negative_citations"), F.count(doi).alias("_doi"), F.count(cited).alias("_cited"), F.countDistinct(venue).alias("n_unique_venues"), F.min(y).alias("year_min"), F.max(y).alias("year_max"),
    )
    n = F.col("n_records")
    one = one.withColumns({"doi_coverage_pct": share(F.col("_doi"), n), "abstract_coverage_pct": share(n - F.col("missing_abstract"), n), "citation_coverage_pct": share(F.col("_cited"), n)}).drop("_doi", "_cited")
    return one.withColumn("hard_failures", F.array_compact(F.array(*(F.when(F.col(k) > 0, F.lit(k)) for k in HARD))))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass; null is a value."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x"))
    return rows.groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): values that occur more than once; rows with a null among the keys are left out."""
    some = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return df.where(some).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check(name: str, condition: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.coalesce(condition, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))


def close(name: str, actual: Column, expected: Column, tolerance: float) -> Column:
    return check(name, F.abs(actual - expected) <= tolerance, F.concat_ws(" vs ", actual.cast("string"), expected.cast("string")))


def checked(one_row: DataFrame, checks: list[Column]) -> DataFrame:
    """(name, passed, detail) of checks over one row of figures."""
    return one_row.select(F.explode(F.array(*checks)).alias("x")).select("x.*")


def verify(df: DataFrame, growth: DataFrame, screened: DataFrame | None = None, first: int = 1989, last: int = 2025) -> DataFrame:
    """Identities that results must satisfy, recomputed from the records without the metric operators."""
    y, e, s = F.col("year"), F.col("is_empirical"), F.col("is_scientific")
    inside = y.between(first, last)
    base = df.agg(
        F.count_if(inside).alias("records"), F.countDistinct(F.when(inside, y)).alias("years"), F.count_if(s).alias("scientific"), F.count_if(s & e).alias("yes"), F.count_if(s & ~e).alias("no"),
        F.count_if(s & e.isNull()).alias("unknown"), F.count_if(~s & e.isNotNull()).alias("stray_empirical"), F.count_if(F.coalesce(~e, F.lit(True)) & F.col("methodology").isNotNull()).alias("stray_method"),
        (F.count(F.lit(1)) - F.countDistinct("record_id")).alias("doubles"), F.count_if(F.col("cited_by_count") < 0).alias("negative"),
    )
    grown = growth.agg(F.coalesce(F.sum("n_articles"), F.lit(0)).alias("grown"), F.count(F.lit(1)).alias("grown_years"))
    one = base.join(grown)
    checks = [
        check("growth counts every record in the window", F.col("grown") == F.col("records"), F.concat_ws(" vs ", "grown", "records")),
        check("growth has every year in the window", F.col("grown_years") == F.col("years"), F.concat_ws(" vs ", "grown_years", "years")),
        check("empirical parts sum to the scientific records", F.col("yes") + F.col("no") + F.col("unknown") == F.col("scientific"), F.col("scientific")),
        check("only scientific records have an empirical status", F.col("stray_empirical") == 0, F.col("stray_empirical")),
        check("only empirical records have a methodology", F.col("stray_method") == 0, F.col("stray_method")),
        check("record ids are unique", F.col("doubles") == 0, F.col("doubles")),
        check("citations aren't negative", F.col("negative") == 0, F.col("negative")),
    ]
    if screened is not None:
        one = one.join(screened.agg(F.count(F.lit(1)).alias("seen"), F.count_if("screen_pass").alias("ok"), F.count_if(~F.col("screen_pass")).alias("out")))
        checks.append(check("passed and excluded sum to all", F.col("ok") + F.col("out") == F.col("seen"), F.col("seen")))
    return checked(one, checks)


def _all(frame: DataFrame, name: str, condition: Column) -> DataFrame:
    """(name, passed, detail): whether a condition holds in every row; detail is the number of rows."""
    return frame.agg(F.coalesce(F.bool_and(condition), F.lit(True)).alias("passed"), F.count(F.lit(1)).cast("string").alias("detail")).select(F.lit(name).alias("name"), "passed", "detail")


def identities(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, passed, detail) of what the analysis' tables must satisfy among themselves; each is a small aggregate."""
    near = lambda a, b, t: F.abs(a - b) <= t
    c = F.col
    out: list[DataFrame] = []
    for name in ("records_by_decade", "methodology_overall", "source_overlap", "author_count_distribution"):
        whole = tables[name].agg(F.sum("pct").alias("pct"), F.count(F.lit(1)).alias("k")).where("k > 0")
        out.append(_all(whole, f"{name}: shares sum to 100", near(c("pct"), F.lit(100), 0.05 * c("k") + 0.01)))
    for name, by in (("methodology_by_year", "year"), ("methodology_by_decade", "decade")):
        whole = tables[name].groupBy(by).agg(F.sum("pct").alias("pct"), F.count(F.lit(1)).alias("k"))
        out.append(_all(whole, f"{name}: shares sum to 100 in each {by}", near(c("pct"), F.lit(100), 0.05 * c("k") + 0.01)))
    for name in ("collaboration_by_year", "collaboration_by_decade"):
        out.append(_all(tables[name], f"{name}: single and multi sum to 100", near(c("pct_single_authored") + c("pct_multi_authored"), F.lit(100), 0.11)))
        out.append(_all(tables[name], f"{name}: a mean of one author at least", c("mean_authors") >= 1))
    for name in ("empiricism_by_year", "empiricism_by_decade"):
        out.append(_all(tables[name], f"{name}: part within whole", c("n_empirical") <= c("n_total")))
        out.append(_all(tables[name], f"{name}: share follows from counts", near(c("pct_empirical"), 100.0 * c("n_empirical") / c("n_total"), 0.051)))
    head = tables["empiricism_headline"]
    out.append(_all(head, "empiricism_headline: parts sum to the whole", c("n_empirical") + c("n_non_empirical") + c("n_unknown") == c("n_scientific")))
    out.append(_all(head, "empiricism_headline: the share of all is the smaller", F.coalesce(c("pct_of_all") <= c("pct_of_known"), F.lit(True))))
    for name in ("citation_summary", "specialty_vs_dispersed"):
        out.append(_all(tables[name], f"{name}: cited and uncited sum to 100", near(c("pct_uncited") + c("pct_cited_at_least_once"), F.lit(100), 0.011)))
        out.append(_all(tables[name], f"{name}: quantiles rise to the maximum", (c("median_citations") <= c("p90")) & (c("p90") <= c("p99")) & (c("p99") <= c("max"))))
        out.append(_all(tables[name], f"{name}: the total holds the maximum", c("total_citations") >= c("max")))
    parts = tables["specialty_vs_dispersed"].agg(F.coalesce(F.sum("n_papers"), F.lit(0)).alias("parts"), F.coalesce(F.sum("total_citations"), F.lit(0)).alias("cites"))
    both = parts.join(tables["citation_summary"].agg(F.coalesce(F.sum("n_papers"), F.lit(0)).alias("whole"), F.coalesce(F.sum("total_citations"), F.lit(0)).alias("all_cites")))
    out.append(_all(both, "specialty_vs_dispersed: papers sum to the summary's", c("parts") == c("whole")))
    out.append(_all(both, "specialty_vs_dispersed: citations sum to the summary's", c("cites") == c("all_cites")))
    out.append(_all(tables["citations_by_methodology"], "citations_by_methodology: cited and uncited sum to 100", near(c("pct_uncited") + c("pct_cited"), F.lit(100), 0.011)))
    out.append(_all(tables["uncited_by_year"], "uncited_by_year: shares lie in 0 to 100", c("pct_uncited").between(0, 100)))
    out.append(_all(tables["dispersion_by_year"], "dispersion_by_year: both shares sum to 100", near(c("pct_specialty") + c("pct_dispersed"), F.lit(100), 0.011)))
    out.append(_all(tables["dispersion_by_year"], "dispersion_by_year: part within whole", c("n_specialty") <= c("n_total")))
    out.append(_all(tables["top_journals"], "top_journals: first year before last", c("first_year") <= c("last_year")))
    grown = tables["growth_by_year"].agg(F.sum("n_articles").alias("n"), F.min("year").alias("a"), F.max("year").alias("b"))
    out.append(_all(grown.join(tables["growth_summary"]), "growth_summary: totals and ends are the years' own", (c("n") == c("total_articles_in_window")) & (c("a") == c("first_year")) & (c("b") == c("last_year"))))
    out.append(_all(tables["growth_by_year"], "growth_by_year: no more venues than records", c("n_journals") <= c("n_articles")))
    counted = tables["corpus"].join(tables["records_by_decade"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("decades"))).join(tables["source_overlap"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sourced")))
    out.append(_all(counted, "records_by_decade: decades sum to the corpus", c("decades") == c("n_records")))
    out.append(_all(counted, "source_overlap: combinations sum to the corpus", c("sourced") <= c("n_records")))
    out.append(_all(tables["corpus"], "corpus: tiers sum to no more than the whole", c("n_core_a") + c("n_adjacent_b") + c("n_dispersed") <= c("n_records")))
    out.append(_all(tables["corpus"], "corpus: coverages lie in 0 to 100", c("doi_coverage_pct").between(0, 100) & c("citation_coverage_pct").between(0, 100)))
    for name in sorted(k for k in tables if k.endswith("_by_decade") and "denominator" in tables[k].columns):
        out.append(_all(tables[name], f"{name}: no label has more records than its decade", c("n") <= c("denominator")))
    return reduce(DataFrame.unionByName, out)


def degenerate(distribution: DataFrame, by: list[str], most: float = 97.0) -> DataFrame:
    """Groups where one class holds over `most` per cent: a kappa there says little."""
    return distribution.groupBy(*by).agg(F.max("pct").alias("modal_pct")).where(F.col("modal_pct") > most)
