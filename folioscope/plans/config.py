"""Configuration: time windows, topic terms, exclusions, venue tiers."""

from __future__ import annotations

import copy

# The windows, terms and phrases that results depend on.
DEFAULTS = {
    "date_range": {"start": "1989-01-01", "end": "2026-12-31", "trend_end_year": 2025, "citation_end_year": 2022, "citation_accrual_years_min": 3, "baseline_year": 1989},
    "pubmed": {
        "mesh_terms": ["Suicide", "Suicidal Ideation", "Self-Injurious Behavior", "Suicide Prevention"],
        "title_abstract_terms": ["suicid*", "self-harm", "self harm", "self-injur*", "para-suicide", "parasuicide", "non-suicidal self-injury", "NSSI", "deliberate self-poisoning"],
    },
    "openalex": {
        "search_terms": ["suicide", "suicidal", "suicidality", "suicidology", "self-harm", "self-injury", "parasuicide"],
        "restrict_types": ["article", "review"],
        "delineation_field": "title",
        "require_abstract": True,
    },
    "europepmc": {
        "search_terms": ["suicide", "suicidal", "suicidality", "suicidology", "self-harm", "self-injury", "parasuicide", "non-suicidal self-injury"],
        "delineation_field": "TITLE",
        "require_abstract": True,
    },
    "exclusions": {
        "metaphorical_phrases": [
            "suicide gene", "suicide substrate", "suicide inhibitor", "suicide inhibition", "suicide enzyme", "suicidal inactivation", "suicide bag", "cell suicide", "apoptosis",
            "suicide gene therapy", "political suicide", "economic suicide", "career suicide", "suicide squeeze", "suicide bomb", "suicide bomber", "suicide attack", "suicide terrorism",
            "suicide mission", "suicide gene expression", "suicidal DNA", "suicide door",
        ],
        "keep_if_also": ["suicidal ideation", "suicide attempt", "suicide risk", "suicide rate", "suicide prevention", "self-harm", "psychiatric", "mental health", "depression", "psychological autopsy"],
        "min_abstract_chars": 150,
        "require_abstract": True,
    },
    "topic_pattern": "suicid|self[-\\s]?harm|self[-\\s]?injur|parasuicide|self[-\\s]?poison|\\bNSSI\\b|self[-\\s]?mutilat|自杀",
}


def load(path: str | None = None) -> dict:
    """The defaults, overlaid section by section with a YAML file's."""
    out = copy.deepcopy(DEFAULTS)
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            for section, values in (yaml.safe_load(f) or {}).items():
                if isinstance(values, dict):
                    out.setdefault(section, {}).update(values)
                else:
                    out[section] = values
    return out
