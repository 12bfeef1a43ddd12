"""Text functions over columns: folding, matching keys, identifiers, names and dates. All run inside the engine."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes, word lists and abbreviations that keys must agree on.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:")
TITLE_STOP_WORDS = ("the", "a", "an", "of", "and", "in", "on", "for", "to", "with")
VENUE_STOP_WORDS = ("the", "of", "and", "a", "an", "for", "in", "on", "de", "la", "le", "des")
VENUE_ABBREVIATIONS = (
    ("j", "journal"), ("int", "international"), ("am", "american"), ("br", "british"), ("eur", "european"), ("psychiatr", "psychiatry"), ("psychol", "psychology"), ("res", "research"),
    ("behav", "behavior"), ("threat", "threatening"), ("ment", "mental"), ("soc", "social"), ("sci", "science"), ("med", "medicine"), ("epidemiol", "epidemiology"),
    ("public hlth", "public health"), ("hlth", "health"), ("commun", "community"), ("dis", "disease"), ("nerv", "nervous"), ("ment hlth", "mental health"), ("affect", "affective"),
    ("disord", "disorders"), ("clin", "clinical"), ("adolesc", "adolescent"), ("child", "child"), ("gen", "general"), ("hosp", "hospital"), ("assoc", "association"),
    ("q", "quarterly"), ("stud", "studies"), ("prev", "prevention"), ("nurs", "nursing"), ("crisis interv", "crisis intervention"),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FOCUS_DESCRIPTORS = (
    "Suicide", "Suicide, Attempted", "Suicide, Completed", "Suicidal Ideation", "Suicide Prevention", "Self-Injurious Behavior", "Self Mutilation", "Assisted Suicide", "Suicide, Assisted",
)
FOCUS_TITLE = "(?iU)\\bsuicid|self[-\\s]?harm|self[-\\s]?injur|parasuicide|self[-\\s]?poison|\\bNSSI\\b|self[-\\s]?destructive|self[-\\s]?mutilat"
ORCID = "\\d{4}-\\d{4}-\\d{4}-[\\dXx]{4}"


def let(value: Column, body) -> Column:
    """body(value), evaluated once although the body may use it often."""
    return F.get(F.transform(F.array(value), body), 0)


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, several) by compatibility decomposition without marks: one-to-one characters, marks to drop last, and one-to-many."""
    single, several, marks = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        if not unicodedata.decomposition(ch):
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != ch:
            single.append((ch, plain))
        elif len(plain) > 1:
            several.append((ch, plain))
    return "".join(a for a, _ in single) + "".join(marks), "".join(b for _, b in single), tuple(several)


def fold_accents(text: Column) -> Column:
    """Compatibility decomposition with marks dropped. ASCII texts, the usual ones, pass untouched; Hangul stays composed.

    Texts of Latin letters are done after one small table; only others meet the whole one, and the characters that
    become several are replaced only where a text has any.
    """
    source, target, several = _folding()
    latin = "".join(c for c in source if ord(c) < 0x250 or 0x300 <= ord(c) < 0x370 or 0x1E00 <= ord(c) < 0x1F00)
    # marks stand at the end of the source, without a target
    latin = "".join(c for c in latin if source.index(c) < len(target)) + "".join(c for c in latin if source.index(c) >= len(target))
    plain = "".join(target[k] for c in latin if (k := source.index(c)) < len(target))
    table = F.split(F.lit("\x01".join(f"{a}\x02{b}" for a, b in several)), "\x01", -1)
    odd = "".join(a for a, _ in several)
    spread = lambda t: F.aggregate(table, t, lambda s, p: F.replace(s, F.substring_index(p, "\x02", 1), F.substring_index(p, "\x02", -1)))
    whole = lambda t: let(F.translate(t, source, target), lambda u: F.when(F.length(F.translate(u, odd, "")) < F.length(u), spread(u)).otherwise(u))
    return F.when(ascii_only(text), text).otherwise(let(F.translate(text, latin, plain), lambda t: F.when(ascii_only(t), t).otherwise(whole(t))))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def normalize_doi(doi: Column) -> Column:
    """Trimmed, lower, each prefix taken off once in turn, without trailing dots; null unless it begins with 10. and has 7 characters."""
    t = F.lower(F.trim(doi))
    prefix = "^" + "".join(f"({p.replace('.', chr(92) + '.')})?" for p in DOI_PREFIXES)
    t = F.regexp_replace(F.trim(F.regexp_replace(t, prefix, "")), "\\.+$", "")
    return F.when(t.startswith("10.") & (F.length(t) >= 7), t)


def title_norm(title: Column) -> Column:
    """For comparison: folded, lower, without markup and punctuation, single spaces. Null gives the empty string."""
    t = F.lower(fold_accents(F.coalesce(title, F.lit(""))))
    t = let(t, lambda u: F.when(u.contains("<"), F.regexp_replace(u, "<[^>]+>", " ")).otherwise(u))
    return F.trim(F.regexp_replace(_plain_only(F.replace(t, F.lit("&"), F.lit(" and "))), " {2,}", " "))


#: ASCII characters that are neither a small letter nor a digit.
_PUNCTUATION = "".join(c for c in map(chr, range(128)) if not (c.islower() or c.isdigit()))


def _plain_only(t: Column) -> Column:
    """All but a-z and 0-9 as spaces. A table does ASCII, as a pattern for it takes eight times as long; only texts with other characters meet one."""
    return let(F.translate(t, _PUNCTUATION, " " * len(_PUNCTUATION)), lambda u: F.when(ascii_only(u), u).otherwise(F.regexp_replace(u, "[^\\x00-\\x7F]", " ")))


def title_key(name: Column) -> Column:
    """A venue's matching key: folded, abbreviations expanded in order, stop words dropped. Never for display."""
    t = F.replace(F.lower(fold_accents(F.coalesce(name, F.lit("")))), F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(F.regexp_replace(t, "\\(.*?\\)", " "), "[^a-z0-9\\s]", " ")
    t = reduce(lambda c, p: F.regexp_replace(c, f"\\b{p[0]}\\b", p[1]), VENUE_ABBREVIATIONS, t)
    stops = F.array(*map(F.lit, VENUE_STOP_WORDS))
    return F.array_join(F.filter(F.split(squeeze(t), " "), lambda w: (w != "") & ~F.array_contains(stops, w)), " ")


def block_key(title: Column, year: Column) -> Column:
    """Year and the first six letters of the first telling title word; `_` without one, 0 without a year."""
    return block_key_of(title_norm(title), year)


def block_key_of(norm: Column, year: Column) -> Column:
    """block_key() of a title that title_norm() has done."""
    stops = F.array(*map(F.lit, TITLE_STOP_WORDS))
    telling = F.filter(F.split(norm, " "), lambda w: (F.length(w) > 2) & ~F.array_contains(stops, w))
    return F.concat_ws("|", F.coalesce(year, F.lit(0)).cast("string"), F.coalesce(F.substring(F.get(telling, 0), 1, 6), F.lit("_")))


def signature(title: Column, year: Column, venue: Column) -> Column:
    """16 hexadecimal digits that stand for a work without identifiers. A missing year is written None."""
    basis = F.concat_ws("|", title_norm(title), F.coalesce(year.cast("string"), F.lit("None")), F.lower(F.coalesce(venue, F.lit(""))))
    return F.substring(F.sha1(basis), 1, 16)


def record_id(doi: Column, pmid: Column, sig: Column) -> Column:
    """doi: before pmid: before sig:; empty identifiers count as missing."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(F.concat(F.lit("doi:"), some(doi)), F.concat(F.lit("pmid:"), some(pmid)), F.concat(F.lit("sig:"), sig))


def first_author_key(authors: Column) -> Column:
    """The last word of the first named author's normalised name, or the empty string."""
    named = F.get(F.filter(authors, lambda a: F.coalesce(a["name"], F.lit("")) != ""), 0)["name"]
    return F.coalesce(F.element_at(F.split(title_norm(named), " "), -1), F.lit(""))


def title_case(text: Column) -> Column:
    """Every letter after a non-letter is upper, every other lower."""
    runs = F.regexp_extract_all(text, F.lit("(\\p{L}+|\\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def normalize_author(name: Column) -> Column:
    """One surface form for a personal name: `Last, First` turned round, folded, without dots and commas, in title case."""
    turned = F.when(name.contains(","), F.concat_ws(" ", F.trim(F.regexp_extract(name, "^[^,]*,(.*)$", 1)), F.trim(F.substring_index(name, ",", 1)))).otherwise(name)
    return title_case(squeeze(F.regexp_replace(fold_accents(F.coalesce(turned, F.lit(""))), "[.,]", " ")))


def topic_focus(title: Column, major_terms: Column) -> Column:
    """focused if the title names the topic or a major descriptor does, else peripheral."""
    major = F.coalesce(F.arrays_overlap(major_terms, F.array(*map(F.lit, FOCUS_DESCRIPTORS))), F.lit(False))
    return F.when(F.coalesce(title, F.lit("")).rlike(FOCUS_TITLE) | major, "focused").otherwise("peripheral")


def month_number(month: Column) -> Column:
    """01 to 12 from a name, an abbreviation or a number; null for anything else."""
    names = F.create_map(*(x for k, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(f"{k + 1:02d}"))))
    low = F.lower(F.trim(month))
    return F.when(low.rlike("^[0-9]{1,2}$"), F.lpad(low, 2, "0")).otherwise(F.element_at(names, F.substring(low, 1, 3)))


def publication_date(year: Column, month: Column, day: Column, free_text: Column) -> Column:
    """year-month-day, month and day 01 where they're missing; without a year the first one named in a free date, alone."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    full = F.concat_ws("-", some(year), F.coalesce(month_number(month), F.lit("01")), F.lpad(F.coalesce(some(day), F.lit("01")), 2, "0"))
    named = F.nullif(F.regexp_extract(F.coalesce(free_text, F.lit("")), "\\b(1[89]\\d{2}|20\\d{2})\\b", 1), F.lit(""))
    return F.when(some(year).isNotNull(), full).otherwise(named)


def labelled_abstract(sections: Column) -> Column:
    """Sections of (label, body) as `Label: body`, joined by spaces; empty bodies are left out."""
    shown = F.transform(F.filter(sections, lambda s: F.coalesce(F.trim(s["body"]), F.lit("")) != ""), lambda s: F.when(F.coalesce(s["label"], F.lit("")) != "", F.concat(title_case(F.trim(s["label"])), F.lit(": "), F.trim(s["body"]))).otherwise(F.trim(s["body"])))
    return F.array_join(shown, " ")


def orcid(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), f"({ORCID})", 1), F.lit(""))


def linear_text(inverted: Column) -> Column:
    """map<word, positions> as running text, words in order of position, joined by single spaces; null for null or empty."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " "), F.lit(""))


def cleaned(value: Column) -> Column:
    """Null for the ways in which a missing value comes as text."""
    return F.when(F.lower(F.trim(value)).isin("", "nan", "none"), F.lit(None)).otherwise(value)


def answer(value: Column) -> Column:
    """A coder's answer: trimmed and lower, null if blank."""
    return F.lower(F.trim(cleaned(value)))


def json_list(value: Column) -> Column:
    """array<string> of a JSON list in text; bad JSON gives an empty list, another text a list of itself, null and empty an empty list."""
    t = F.coalesce(value, F.lit(""))
    empty = F.array().cast("array<string>")
    return F.when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), empty)).when(t == "", empty).otherwise(F.array(t))


def json_object_text(value: Column) -> Column:
    """The JSON object inside some prose, from the first brace to the last; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), "(?s)(\\{.*\\})", 1), F.lit(""))


def model_answer(value: Column, key: str) -> Column:
    """One field of a JSON answer with prose around it; `uncertain` where it can't be read."""
    return F.coalesce(F.get_json_object(json_object_text(value), f"$.{key}"), F.lit("uncertain"))


def count_sources(combination: Column) -> Column:
    """How many providers a combination `a+b` names."""
    return F.size(F.split(combination, "[+]"))
