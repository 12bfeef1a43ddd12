"""Topical screening with auditable reason codes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.plans import config


def any_phrase(phrases: list[str]) -> str:
    """A Java pattern of literal phrases, without regard to case."""
    return "(?iU)" + "|".join(re.escape(p).replace("\\ ", " ") for p in phrases)


def reason(cfg: dict | None = None, title: str = "title", abstract: str = "abstract", year: str = "year", tier: str = "venue_tier") -> Column:
    """The first of the reasons that applies, else `pass`. Records of a core venue need no topical term."""
    cfg = cfg or config.DEFAULTS
    ex = cfg["exclusions"]
    body = F.coalesce(F.col(abstract), F.lit(""))
    text = F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), body)
    core = F.coalesce(F.col(tier) == "core_a", F.lit(False))
    out = F.when(F.lit(bool(ex["require_abstract"])) & (F.length(F.trim(body)) < int(ex["min_abstract_chars"])), "no_or_short_abstract")
    out = out.when(F.col(year).isNull(), "no_publication_year")
    out = out.when(~core & ~text.rlike("(?iU)" + cfg["topic_pattern"]), "no_topical_term")
    out = out.when(~core & text.rlike(any_phrase(ex["metaphorical_phrases"])) & ~text.rlike(any_phrase(ex["keep_if_also"])), "metaphorical_use")
    return out.otherwise("pass")


def screen(records: DataFrame, cfg: dict | None = None, **columns: str) -> DataFrame:
    """With screen_reason and screen_pass. Narrow: no record moves."""
    return records.withColumn("screen_reason", reason(cfg, **columns)).withColumn("screen_pass", F.col("screen_reason") == "pass")


def passed(screened: DataFrame) -> DataFrame:
    return screened.where("screen_pass")


def report(screened: DataFrame) -> DataFrame:
    """(screen_reason, n), most frequent first."""
    return screened.groupBy("screen_reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "screen_reason")


def summary(screened: DataFrame) -> DataFrame:
    """One row: total_evaluated, passed, excluded."""
    return screened.agg(F.count(F.lit(1)).alias("total_evaluated"), F.count_if("screen_pass").alias("passed"), F.count_if(~F.col("screen_pass")).alias("excluded"))
