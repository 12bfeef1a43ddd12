"""Canonical venue names, learnt from the records themselves: by ISSN, then by key, then by likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import similarity, text
from folioscope.operators import candidates, graph

# Fixed values.
FUZZY_ACCEPT, FUZZY_REVIEW = 93.0, 85.0


def _best(counts: DataFrame, by: str) -> DataFrame:
    """The most frequent title of each key, the longest of those, then the first by name."""
    # the smallest name on ties: names are compared downwards by turning the order of counts round
    ranked = F.struct(-F.col("n"), -F.length("raw"), F.col("raw"))
    return counts.groupBy(by).agg(F.min_by("raw", ranked).alias("canonical"))


def learn(records: DataFrame, venue: str = "journal_raw", issn: str = "issn_l") -> tuple[DataFrame, DataFrame]:
    """(issn -> canonical, key -> canonical). Titles are counted before they're keyed, so each distinct one is keyed once."""
    raw = F.trim(F.col(venue))
    titles = records.where(F.coalesce(raw, F.lit("")) != "").groupBy(raw.alias("raw"), F.nullif(F.trim(F.col(issn)), F.lit("")).alias("issn")).agg(F.count(F.lit(1)).alias("n"))
    by_issn = _best(titles.where("issn is not null"), "issn")
    spelled = titles.groupBy("raw").agg(F.sum("n").alias("n")).withColumn("key", text.title_key(F.col("raw")))
    by_key = _best(spelled.where("key <> ''"), "key")
    own = by_issn.select(text.title_key(F.col("canonical")).alias("key"), "canonical").where("key <> ''").groupBy("key").agg(F.min("canonical").alias("canonical"))
    return by_issn, by_key.unionByName(own.join(by_key.select("key"), "key", "left_anti"))


def resolve(records: DataFrame, by_issn: DataFrame, by_key: DataFrame, venue: str = "journal_raw", issn: str = "issn_l", fuzzy: bool = True) -> DataFrame:
    """With journal_canonical, venue_method (issn, exact_key, fuzzy_auto, fuzzy_review, new, unresolved) and venue_score.

    Likeness is only asked for keys that nothing knows, once for each distinct key, against known keys of a length in
    reach; the optimiser broadcasts the learnt tables if their measured size allows it.
    A title whose key is empty stays as it is.
    """
    raw = F.trim(F.coalesce(F.col(venue), F.lit("")))
    df = records.withColumns({"_raw": raw, "_issn": F.nullif(F.trim(F.col(issn)), F.lit(""))})
    df = df.join(by_issn.select(F.col("issn").alias("_issn"), F.col("canonical").alias("_by_issn")), "_issn", "left")
    # each different title is keyed and looked up once
    names = df.groupBy("_raw").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("_by_issn").isNull()).alias("_open")).withColumn("_key", text.title_key(F.col("_raw")))
    names = graph.checkpointed(names.join(by_key.select(F.col("key").alias("_key"), F.col("canonical").alias("_by_key")), "_key", "left"))
    total = names.agg(F.sum("n")).first()[0] or 0
    if fuzzy:
        unknown = names.where("_open and _by_key is null and _key <> ''").select("_key").distinct()
        near = nearest_keys(unknown.select(F.col("_key").alias("key")), by_key)
        names = names.join(near.select(F.col("key").alias("_key"), F.col("canonical").alias("_near"), F.col("score").alias("_score")), "_key", "left")
    else:
        names = names.withColumns({"_near": F.lit(None).cast("string"), "_score": F.lit(None).cast("double")})
    df = graph.spread_join(df, names.drop("_open", "_key"), "_raw", total)
    chain = F.when(F.col("_by_issn").isNotNull(), "issn").when(F.col("_raw") == "", "unresolved").when(F.col("_by_key").isNotNull(), "exact_key")
    method = chain.when(F.col("_score") >= FUZZY_ACCEPT, "fuzzy_auto").when(F.col("_score").isNotNull(), "fuzzy_review").otherwise("new")
    return df.withColumns({"journal_canonical": F.coalesce("_by_issn", "_by_key", "_near", "_raw"), "venue_method": method, "venue_score": F.when(method.startswith("fuzzy"), F.round("_score", 1))}).drop("_raw", "_issn", "_by_issn", "_by_key", "_near", "_score")


def nearest_keys(unknown: DataFrame, by_key: DataFrame, least: float = FUZZY_REVIEW) -> DataFrame:
    """(key, canonical, score): the likest known key from `least` on, ties by key; keys meet through an index of their rarest grams."""
    side = lambda df, known, canonical: df.select(F.concat(F.lit(f"{int(known)}"), "key").alias("row_id"), F.lit(0).alias("block"), similarity.token_sorted(F.col("key")).alias("x"), F.lit(known).alias("known"), "key", canonical.alias("canonical"))
    both = graph.checkpointed(side(unknown, False, F.lit(None).cast("string")).unionByName(side(by_key, True, F.col("canonical"))))
    pairs = candidates.indexed_pairs(both.select("row_id", "block", "x", "known"), least, F.col("l_known") != F.col("r_known"))
    # an unknown key's row_id is the smaller one
    left = both.where("not known").select(F.col("row_id").alias("l_row_id"), F.col("x").alias("l_x"), "key")
    right = both.where("known").select(F.col("row_id").alias("r_row_id"), F.col("x").alias("r_x"), F.col("key").alias("other"), "canonical")
    scored = candidates.scored(pairs.join(left, "l_row_id").join(right, "r_row_id"), least)
    best = scored.groupBy("key").agg(F.min_by(F.struct("canonical", "score"), F.struct(-F.col("score"), F.col("other"))).alias("x"))
    return best.select("key", "x.canonical", "x.score")


def normalisation_log(resolved: DataFrame) -> DataFrame:
    """(venue_method, n, n_venues)."""
    return resolved.groupBy("venue_method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("journal_canonical").alias("n_venues"))


def fuzzy_decisions(resolved: DataFrame, venue: str = "journal_raw") -> DataFrame:
    """The distinct likeness decisions, for people to check."""
    return resolved.where(F.col("venue_method").startswith("fuzzy")).select(F.col(venue).alias("raw"), "journal_canonical", "venue_score", "venue_method").distinct()
