"""The canonical record of a scholarly work, and the closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())

AUTHOR = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("orcid", T.StringType()),
    T.StructField("affiliation", T.StringType()),
    T.StructField("position", T.IntegerType()),
])


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


#: A record as a provider gives it. Null means unknown everywhere; a flag that's null was declined, never false.
PAPER = T.StructType([
    *_fields(T.StringType(), "source source_id doi pmid title abstract journal_raw issn_l publisher"),
    T.StructField("year", T.IntegerType()),
    *_fields(T.StringType(), "pub_date volume issue pages doc_type_raw language"),
    T.StructField("authors", T.ArrayType(AUTHOR)),
    T.StructField("n_authors", T.IntegerType()),
    *_fields(_STRINGS, "affiliations_raw countries funders mesh_terms mesh_major_terms keywords"),
    *_fields(T.IntegerType(), "references_count cited_by_count"),
    T.StructField("citation_source", T.StringType()),
    *_fields(T.BooleanType(), "is_oa retracted"),
    *_fields(T.StringType(), "url venue_tier topic_focus harvest_ts schema_version"),
])

# The vocabularies that results must use.
VENUE_TIERS = ("core_a", "adjacent_b", "dispersed")
TOPIC_FOCUS = ("focused", "peripheral")
METHODOLOGIES = ("quantitative", "qualitative", "mixed", "review")
SCREEN_REASONS = ("no_or_short_abstract", "no_publication_year", "no_topical_term", "metaphorical_use", "pass")
PREVENTION_LEVELS = ("universal", "selective", "indicated", "treatment", "postvention", "not_applicable")
