"""The family of scientometric tables. Each is one aggregation, partial before the shuffle.

Column names are parameters, so the same operators run over any table with a year, an id and so on. Years, groups and
labels that are null are left out of tables by them, as a group without a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.numbers import cagr, decade, share
from folioscope.functions.text import count_sources


def _n() -> Column:
    return F.count(F.lit(1))


def _window(df: DataFrame, year: str, first: int | None, last: int | None) -> DataFrame:
    df = df.where(F.col(year).isNotNull())
    if first is not None:
        df = df.where(F.col(year) >= first)
    return df if last is None else df.where(F.col(year) <= last)


def _with_decade(df: DataFrame, year: str) -> DataFrame:
    return df.where(F.col(year).isNotNull()).withColumn("decade", decade(F.col(year)))


def _shares(counts: DataFrame, by: list[str], digits: int) -> DataFrame:
    """pct of n within the groups `by`. The window runs over the counts, never the records."""
    whole = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", share(F.col("n"), whole, digits))


# --- growth


def growth_by_year(df: DataFrame, first: int | None = 1989, last: int | None = 2025, year: str = "year", key: str = "record_id", venue: str = "venue") -> DataFrame:
    """(year, n_articles, n_journals): records and distinct venues a year, inside the window."""
    return _window(df, year, first, last).groupBy(F.col(year).alias("year")).agg(F.count(key).alias("n_articles"), F.countDistinct(venue).alias("n_journals"))


def growth_summary(growth: DataFrame) -> DataFrame:
    """One row: first and last year, what they hold, growth rates over the intervals between them, and the total. No row for no year."""
    ends = growth.agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min_by("n_articles", "year").alias("articles_first"), F.max_by("n_articles", "year").alias("articles_last"),
        F.min_by("n_journals", "year").alias("journals_first"), F.max_by("n_journals", "year").alias("journals_last"),
        F.sum("n_articles").alias("total_articles_in_window"),
    ).where("first_year is not null").withColumn("n_intervals", F.col("last_year") - F.col("first_year"))
    articles, journals = (cagr(F.col(f"{x}_first"), F.col(f"{x}_last"), F.col("n_intervals")) for x in ("articles", "journals"))
    return ends.withColumns({"article_cagr_pct": F.round(articles, 2), "journal_cagr_pct": F.round(journals, 2), "cagr_differential_pp": F.round(articles - journals, 2)})


def fitted_growth(growth: DataFrame, summary: DataFrame) -> DataFrame:
    """(year, n_articles, fitted): the curve of constant growth from the first year's count."""
    one = summary.select("first_year", "last_year", "articles_first", "articles_last", "n_intervals")
    rate = F.pow(F.col("articles_last").cast("double") / F.col("articles_first"), F.lit(1.0) / F.nullif("n_intervals", F.lit(0)))
    joined = growth.join(F.broadcast(one), F.col("year").between(F.col("first_year"), F.col("last_year")))  # one row is broadcast
    return joined.select("year", "n_articles", (F.col("articles_first") * F.pow(rate, F.col("year") - F.col("first_year"))).alias("fitted"))


def records_by_decade(df: DataFrame, year: str = "year", key: str = "record_id") -> DataFrame:
    return _shares(_with_decade(df, year).groupBy("decade").agg(F.count(key).alias("n")), [], 1)


# --- empirical work and methodology


def _empirical(df: DataFrame, by: str, empirical: str, digits: int) -> DataFrame:
    g = df.where(F.col(empirical).isNotNull()).groupBy(by).agg(F.count(empirical).alias("n_total"), F.count_if(empirical).alias("n_empirical"))
    return g.withColumn("pct_empirical", share(F.col("n_empirical"), F.col("n_total"), digits))


def _scientific(df: DataFrame, scientific: str | None) -> DataFrame:
    return df if scientific is None else df.where(F.col(scientific).eqNullSafe(True))


def empiricism_by_year(df: DataFrame, last: int | None = 2025, year: str = "year", empirical: str = "is_empirical", scientific: str | None = "is_scientific") -> DataFrame:
    """(year, n_total, n_empirical, pct_empirical) of the scientific records with a known status."""
    return _empirical(_window(_scientific(df, scientific), year, None, last).withColumn("year", F.col(year)), "year", empirical, 2)


def empiricism_by_decade(df: DataFrame, year: str = "year", empirical: str = "is_empirical", scientific: str | None = "is_scientific") -> DataFrame:
    return _empirical(_with_decade(_scientific(df, scientific), year), "decade", empirical, 1)


def empiricism_headline(df: DataFrame, empirical: str = "is_empirical", scientific: str | None = "is_scientific") -> DataFrame:
    """One row; pct_of_all counts unknown status in the denominator, pct_of_known doesn't."""
    e = F.col(empirical)
    one = _scientific(df, scientific).agg(_n().alias("n_scientific"), F.count_if(e).alias("n_empirical"), F.count_if(~e).alias("n_non_empirical"), F.count_if(e.isNull()).alias("n_unknown"))
    return one.withColumns({"pct_of_all": share(F.col("n_empirical"), F.col("n_scientific")), "pct_of_known": share(F.col("n_empirical"), F.col("n_empirical") + F.col("n_non_empirical"))})


def _methods(df: DataFrame, empirical: str, method: str) -> DataFrame:
    return df.where(F.col(empirical).eqNullSafe(True) & F.col(method).isNotNull()).withColumn("methodology", F.col(method))


def methodology_distribution(df: DataFrame, empirical: str = "is_empirical", method: str = "methodology") -> DataFrame:
    return _shares(_methods(df, empirical, method).groupBy("methodology").agg(_n().alias("n")), [], 1)


def methodology_by_decade(df: DataFrame, year: str = "year", empirical: str = "is_empirical", method: str = "methodology") -> DataFrame:
    return _shares(_with_decade(_methods(df, empirical, method), year).groupBy("decade", "methodology").agg(_n().alias("n")), ["decade"], 1)


def methodology_by_year(df: DataFrame, last: int | None = 2025, year: str = "year", empirical: str = "is_empirical", method: str = "methodology") -> DataFrame:
    d = _window(_methods(df, empirical, method), year, None, last)
    return _shares(d.groupBy(F.col(year).alias("year"), "methodology").agg(_n().alias("n")), ["year"], 2)


# --- collaboration


def _collaboration(df: DataFrame, by: str, n_authors: str, digits: int) -> DataFrame:
    a = F.col(n_authors)
    g = df.where(a > 0).groupBy(by).agg(F.sum(a.cast("long")).alias("_sum"), F.median(a).alias("median_authors"), _n().alias("n"), F.count_if(a == 1).alias("_single"))
    g = g.withColumns({"mean_authors": F.round(F.col("_sum").cast("double") / F.col("n"), 2), "pct_single_authored": share(F.col("_single"), F.col("n"), digits), "pct_multi_authored": share(F.col("n") - F.col("_single"), F.col("n"), digits)})
    return g.select(by, "mean_authors", "median_authors", "n", "pct_single_authored", "pct_multi_authored")


def collaboration_by_year(df: DataFrame, last: int | None = 2025, year: str = "year", n_authors: str = "n_authors") -> DataFrame:
    return _collaboration(_window(df, year, None, last).withColumn("year", F.col(year)), "year", n_authors, 2)


def collaboration_by_decade(df: DataFrame, year: str = "year", n_authors: str = "n_authors") -> DataFrame:
    return _collaboration(_with_decade(df, year), "decade", n_authors, 1)


def author_count_distribution(df: DataFrame, n_authors: str = "n_authors") -> DataFrame:
    return _shares(df.where(F.col(n_authors) > 0).groupBy(F.col(n_authors).alias("n_authors")).agg(_n().alias("n")), [], 1)


# --- citations


def _cited(df: DataFrame, last: int | None, year: str, cited: str) -> DataFrame:
    return _window(df, year, None, last).where(F.col(cited).isNotNull()).withColumn("_c", F.col(cited).cast("double"))


def citation_summary(df: DataFrame, last: int | None = 2022, by: list[str] | None = None, year: str = "year", cited: str = "cited_by_count") -> DataFrame:
    """The citation distribution, one row (or one for each group `by`); quantiles are exact and interpolated. No row for no record."""
    c = F.col("_c")
    g = _cited(df, last, year, cited).groupBy(*(by or [])).agg(
        _n().alias("n_papers"), F.sum(c).cast("long").alias("total_citations"), (F.sum(c) / _n()).alias("_mean"), F.median(c).alias("median_citations"),
        F.count_if(c == 0).alias("_none"), F.count_if(c > 0).alias("_some"), F.percentile(c, F.array(F.lit(0.9), F.lit(0.99))).alias("_p"), F.max(c).cast("long").alias("max"),
    )
    return g.where("n_papers > 0").select(
        *(by or []), "n_papers", "total_citations", F.round("_mean", 2).alias("mean_citations"), "median_citations", share(F.col("_none"), F.col("n_papers")).alias("pct_uncited"),
        share(F.col("_some"), F.col("n_papers")).alias("pct_cited_at_least_once"), F.get("_p", 0).alias("p90"), F.get("_p", 1).alias("p99"), "max",
    )


def citations_by_venue(df: DataFrame, last: int | None = 2022, least: int = 25, venue: str = "venue", year: str = "year", cited: str = "cited_by_count") -> DataFrame:
    """Seven measures for each venue of `least` papers or more."""
    c = F.col("_c")
    g = _cited(df, last, year, cited).where(F.col(venue).isNotNull()).groupBy(F.col(venue).alias("venue")).agg(
        _n().alias("n_papers"), F.sum(c).cast("long").alias("total_citations"), F.median(c).alias("median_citations"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_if(c == 0).alias("_none"),
    )
    g = g.where(F.col("n_papers") >= least).withColumns({"mean_citations": F.round(F.col("total_citations").cast("double") / F.col("n_papers"), 2), "pct_uncited": share(F.col("_none"), F.col("n_papers"))})
    return g.select("venue", "n_papers", "mean_citations", "median_citations", "total_citations", "first_year", "last_year", "pct_uncited")


def top_venues(df: DataFrame, k: int = 60, **arguments) -> DataFrame:
    """The k venues with most papers, ties by name; kept as a heap in each task, not sorted whole."""
    return citations_by_venue(df, **arguments).orderBy(F.desc("n_papers"), "venue").limit(k)


def citations_by_methodology(df: DataFrame, last: int | None = 2022, method: str = "methodology", year: str = "year", cited: str = "cited_by_count") -> DataFrame:
    c = F.col("_c")
    g = _cited(df, last, year, cited).where(F.col(method).isNotNull()).groupBy(F.col(method).alias("methodology")).agg(_n().alias("n"), F.sum(c).alias("_sum"), F.median(c).alias("median_citations"), F.count_if(c == 0).alias("_none"))
    return g.select("methodology", "n", F.round(F.col("_sum") / F.col("n"), 2).alias("mean_citations"), "median_citations", share(F.col("_none"), F.col("n")).alias("pct_uncited"), share(F.col("n") - F.col("_none"), F.col("n")).alias("pct_cited"))


def uncited_by_year(df: DataFrame, last: int | None = 2022, by: str = "is_empirical", year: str = "year", cited: str = "cited_by_count") -> DataFrame:
    g = _cited(df, last, year, cited).where(F.col(by).isNotNull()).groupBy(F.col(year).alias("year"), by).agg(_n().alias("n"), F.count_if(F.col("_c") == 0).alias("_none"))
    return g.select("year", by, share(F.col("_none"), F.col("n")).alias("pct_uncited"), "n")


# --- venues, fields, providers


def dispersion_by_year(df: DataFrame, last: int | None = 2025, year: str = "year", tier: str = "venue_tier", core: str = "core_a") -> DataFrame:
    """Share of the core venues in each year's output; a null tier isn't core."""
    g = _window(df, year, None, last).groupBy(F.col(year).alias("year")).agg(_n().alias("n_total"), F.count_if(F.col(tier).eqNullSafe(core)).alias("n_specialty"))
    return g.withColumns({"pct_specialty": share(F.col("n_specialty"), F.col("n_total")), "pct_dispersed": share(F.col("n_total") - F.col("n_specialty"), F.col("n_total"))})


def specialty_vs_dispersed(df: DataFrame, last: int | None = 2022, tier: str = "venue_tier", core: str = "core_a", **columns: str) -> DataFrame:
    """citation_summary of core venues and of all others, side by side in one pass."""
    return citation_summary(df.withColumn("venue_group", F.when(F.col(tier).eqNullSafe(core), "specialty").otherwise("dispersed")), last, ["venue_group"], **columns)


def field_distribution(df: DataFrame, field: str, multi: bool = True) -> DataFrame:
    """(field, n, pct): of records for a list of labels (a record may count under several), of labels for a single one."""
    if not multi:
        return _shares(df.where(F.col(field).isNotNull()).groupBy(field).agg(_n().alias("n")), [], 1)
    whole = df.agg(_n().alias("_all"))
    g = df.select(F.explode_outer(field).alias(field)).where(F.col(field).isNotNull()).groupBy(field).agg(_n().alias("n"))
    return g.join(F.broadcast(whole)).select(field, "n", share(F.col("n"), F.col("_all"), 1).alias("pct"))  # one row is broadcast


def field_by_decade(df: DataFrame, field: str, multi: bool = True, year: str = "year") -> DataFrame:
    """field_distribution within each decade, with the number of its records as denominator."""
    d = _with_decade(df, year)
    sizes = d.groupBy("decade").agg(_n().alias("denominator"))
    # explode_outer: before explode() the optimiser would filter by the labels' size, and so compute them twice
    values = d.select("decade", (F.explode_outer(field) if multi else F.col(field)).alias(field)).where(F.col(field).isNotNull())
    g = values.groupBy("decade", field).agg(_n().alias("n")).join(F.broadcast(sizes), "decade")  # at most one row a decade
    whole = F.col("denominator") if multi else F.sum("n").over(Window.partitionBy("decade"))
    return g.select("decade", field, "n", share(F.col("n"), whole, 1).alias("pct"), "denominator")


def decade_pivot(by_decade: DataFrame, field: str, top: int = 8) -> DataFrame:
    """pct of the `top` most frequent labels, a row each, a column for each decade, 0 where a label is absent."""
    decades = ["1989", "1990s", "2000s", "2010s", "2020s"]
    most = by_decade.groupBy(field).agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), field).limit(top).select(field)
    return by_decade.join(F.broadcast(most), field).groupBy(field).pivot("decade", decades).agg(F.first("pct")).fillna(0.0)  # `top` rows are broadcast


def focus_share(df: DataFrame, flag: str, by_decade: bool = False, year: str = "year") -> DataFrame:
    """How many records a flag marks, overall or by decade."""
    d = _with_decade(df, year).groupBy("decade") if by_decade else df.groupBy()
    return d.agg(_n().alias("n_total"), F.count_if(flag).alias("n")).withColumn("pct", share(F.col("n"), F.col("n_total"), 1))


def source_overlap(df: DataFrame, source: str = "source") -> DataFrame:
    """(source_combination, n, pct, n_sources)."""
    g = df.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source_combination")).agg(_n().alias("n"))
    return _shares(g, [], 2).withColumn("n_sources", count_sources(F.col("source_combination")))


def single_source_share(overlap: DataFrame) -> DataFrame:
    return overlap.agg(F.sum("n").alias("n_total"), F.coalesce(F.sum(F.when(F.col("n_sources") == 1, F.col("n"))), F.lit(0)).alias("n_single")).withColumn("pct_single", share(F.col("n_single"), F.col("n_total")))


def corpus_block(df: DataFrame, last: int = 2025, year: str = "year", tier: str = "venue_tier", venue: str = "venue", doi: str = "doi", cited: str = "cited_by_count") -> DataFrame:
    """One row on the whole corpus: size, tiers, coverages, span of years, and the years after the window with their records."""
    y = F.col(year)
    one = df.agg(
        _n().alias("n_records"), F.countDistinct(venue).alias("n_venues"), *(F.count_if(F.col(tier) == t).alias(f"n_{t}") for t in ("core_a", "adjacent_b", "dispersed")),
        F.count(doi).alias("_doi"), F.count(cited).alias("_cited"), F.min(y).alias("year_min"), F.max(y).alias("year_max"), F.count_if(y > last).alias("n_partial_years"),
        F.array_sort(F.collect_set(F.when(y > last, y))).alias("partial_years"),
    )
    return one.withColumns({"doi_coverage_pct": share(F.col("_doi"), F.col("n_records")), "citation_coverage_pct": share(F.col("_cited"), F.col("n_records"))}).drop("_doi", "_cited")


def complement_of(distribution: DataFrame, field: str, label: str) -> DataFrame:
    """100 less the pct of one label, e.g. of `none`; 100 if it's absent."""
    return distribution.agg((F.lit(100.0) - F.coalesce(F.max(F.when(F.col(field) == label, F.col("pct"))), F.lit(0.0))).alias("pct"))
