"""Document fingerprints: a canonical exact digest, in DataFrame functions throughout.

A text is brought to one canonical form (compatibility composition of Unicode, case folding, runs of white space as one
space) and hashed to 128 bits, two xxhash64 values of unlike seeds. Texts whose digests are equal are the same only if
their canonical forms are, byte by byte.

The engine has no function for Unicode normalisation, so it is composed: characters that map to one other character by
translate(); those that map to several by replacements that run only for texts that hold such characters. Letters with
marks after them are cut out as clusters; the distinct ones of a text, a short string, go through the tables of
compositions and are put back in one replacement each. All tables come from Python's unicodedata when the plan is built.

Neighbours are found on light rows: keys and hashes are numbered by range partitions, and what a document needs of its
successor's text is sent to it. Texts are shuffled once, by key and hash, never by ranges.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that the folding of Unicode leaves alone: most Latin, Greek and Cyrillic letters and common signs.
_PLAIN = "[^\\x00-\\x9F¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žƀ-ǃΑ-Ωα-ωЀ-џ‐‒-―‘-‟€]"
#: Light rows of a partition in which successors are found, about.
ORDER_ROWS = 1_000_000
#: Hashes of texts with a shared digest that are broadcast, at most (40 bytes each); more are joined by a shuffle of the texts.
MOST_SENT = 500_000
_HANGUL_BASE, _HANGUL_N = 0xAC00, 11172


@dataclass(frozen=True)
class _Tables:
    """single: characters that fold to one other (from, to); several: to more than one; split: canonical parts; joined: by class of mark, what may stand between, and (letter, mark, whole); marks: (mark, its class as a letter); tails: marks, and letters that join the one before them."""

    single: tuple[str, str]
    several: list[tuple[str, str]]
    split: list[tuple[str, str]]
    joined: list[tuple[str, list[tuple[str, str, str]]]]
    hangul: list[tuple[str, str]]
    marks: tuple[str, str]
    tails: str


def _escaped(chars) -> str:
    """Characters for a pattern or its brackets, runs of code points as ranges."""
    codes, out, k = sorted(map(ord, chars)), [], 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\x{{{codes[k]:X}}}" + (f"-\\x{{{codes[j]:X}}}" if j > k else ""))
        k = j + 1
    return "".join(out)


@lru_cache(maxsize=1)
def _tables() -> _Tables:
    single, several, split, tails = [], [], [], set()
    joined: dict[int, list[tuple[int, str, str, str]]] = {}
    marks = [chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    for c in range(0xA0, sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000 or _HANGUL_BASE <= c < _HANGUL_BASE + _HANGUL_N:
            continue
        ch = chr(c)
        parts = unicodedata.decomposition(ch)
        if not parts:
            continue
        folded = unicodedata.normalize("NFKC", ch)
        if folded != ch:
            (single if len(folded) == 1 else several).append((ch, folded))
        elif not parts.startswith("<"):
            split.append((ch, unicodedata.normalize("NFD", ch)))
            base, mark = (chr(int(x, 16)) for x in parts.split())
            tails.add(mark)
            joined.setdefault(unicodedata.combining(mark), []).append((len(unicodedata.normalize("NFD", ch)), _escaped(base), _escaped(mark), ch))
    by_class = []
    for k in sorted(joined):
        lower = _escaped(m for m in marks if unicodedata.combining(m) < k)
        by_class.append((f"([{lower}]*)" if k and lower else "()", [row[1:] for row in sorted(joined[k])]))
    hangul = []
    for k in range(_HANGUL_N):
        s = chr(_HANGUL_BASE + k)
        if k % 28 == 0:
            hangul.insert(k // 28, (unicodedata.normalize("NFD", s), s))
        else:
            hangul.append((chr(_HANGUL_BASE + k - k % 28) + unicodedata.normalize("NFD", s)[-1], s))
    return _Tables(
        ("".join(a for a, _ in single), "".join(b for _, b in single)), several, split, by_class, hangul,
        ("".join(marks), "".join(chr(0x4E00 + unicodedata.combining(m)) for m in marks)), "".join(sorted({*marks, *tails})),
    )


def _pairs(rows: list[tuple[str, str]]) -> Column:
    """A table as two literals joined by control characters that no key holds: small as a plan, split once for each text."""
    joined = "\x01".join(f"{a}\x02{b}" for a, b in rows)
    return F.split(F.lit(joined), "\x01", -1)


def _replace_all(text: Column, rows: list[tuple[str, str]], each) -> Column:
    return F.aggregate(_pairs(rows), text, lambda t, p: each(t, F.substring_index(p, "\x02", 1), F.substring_index(p, "\x02", -1)))


def _let(value: Column, body) -> Column:
    """body(value), with the value in the expression once."""
    return F.get(F.transform(F.array(value), body), 0)


def _where(value: Column, pattern: str, change) -> Column:
    """The value, changed if it holds the pattern."""
    return _let(value, lambda t: F.when(t.rlike(pattern), change(t)).otherwise(t))


def _in_order(text: Column, marks: tuple[str, str]) -> Column:
    """Marks in a row by their class, equal classes as they stand."""
    own = _escaped(marks[0])
    runs = F.regexp_extract_all(text, F.lit(f"([{own}]+|[^{own}]+)"), 1)

    def ordered(run: Column) -> Column:
        chars = F.regexp_extract_all(run, F.lit("(?s)(.)"), 1)
        keyed = F.transform(chars, lambda c, i: F.struct(F.translate(c, *marks).alias("k"), i.alias("i"), c.alias("c")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), "")

    return F.array_join(F.transform(runs, lambda r: F.when((F.length(r) > 1) & r.rlike(f"^[{own}]"), ordered(r)).otherwise(r)), "")


def _join_class(text: Column, joined: tuple[str, list[tuple[str, str, str]]]) -> Column:
    """Letters joined with the marks of one class that follow them, across marks of lower classes."""
    between, rows = joined
    table = F.split(F.lit("\x01".join("\x02".join(r) for r in rows)), "\x01", -1)
    part = lambda p, k: F.get(F.split(p, "\x02", -1), k)
    return F.aggregate(table, text, lambda s, p: F.regexp_replace(s, F.concat(part(p, 0), F.lit(between), part(p, 1)), F.concat(part(p, 2), F.lit("$1"))))


def folded_unicode(text: Column) -> Column:
    """Compatibility composition; plain texts are told by one scan and pass unchanged.

    Clusters are taken apart, their marks ordered and joined to the letters again, a mark's class after another. Longer
    clusters are put back before shorter ones that open them; what is composed holds no cluster that would change.
    """
    t = _tables()
    odd, tail = f"[{_escaped(a for a, _ in t.several)}]", _escaped(t.tails)

    def composed(text: Column) -> Column:
        x = _in_order(_replace_all(text, t.split, F.replace), t.marks)
        return reduce(_join_class, t.joined, x)

    def clustered(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)[^{tail}]?[{tail}]+"), 0))
        longest = F.array_sort(found, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))

        def put_back(own: Column) -> Column:
            # a text that holds the separator goes through the tables whole
            whole = text.contains("\x01")

            def replaced(done: Column) -> Column:
                pairs = F.zip_with(own, F.split(done, "\x01", -1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
                return F.when(whole, done).otherwise(F.aggregate(pairs, text, lambda s, p: F.replace(s, p["a"], p["b"])))

            return _let(composed(F.when(whole, text).otherwise(F.array_join(own, "\x01"))), replaced)

        return _let(longest, put_back)

    def fold(text: Column) -> Column:
        x = _where(F.translate(text, *t.single), odd, lambda x: _replace_all(x, t.several, F.replace))
        x = _where(x, f"[{tail}]", clustered)
        return _where(x, "[\\x{1100}-\\x{11FF}]", lambda x: _replace_all(x, t.hangul, F.replace))

    return F.when((F.octet_length(text) > F.length(text)) & text.rlike(_PLAIN), fold(text)).otherwise(text)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    t = _let(F.coalesce(text.cast("string"), F.lit("")), folded_unicode)
    # upper, then lower: one letter may fold to two; the replacement keeps the optimiser from dropping upper()
    t = F.replace(F.lower(F.replace(F.upper(t), F.lit("ẞ"), F.lit("SS"))), F.lit("ς"), F.lit("σ"))
    return F.trim(F.regexp_replace(t, "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+", " "))


def digest(canonical_text: Column) -> Column:
    """32 lowercase hexadecimal digits of a canonical form."""
    part = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canonical_text))), 16, "0")
    return F.concat(part("left"), part("right"))


def fingerprint(text: Column) -> Column:
    return _let(canonical(text), digest)


def alike(a: Column, fp_a: Column, b: Column, fp_b: Column) -> Column:
    """1 if two texts have one canonical form, else 0; bytes are compared only where the digests are equal."""
    return F.when(fp_a != fp_b, F.lit(0.0)).when(a.eqNullSafe(b), F.lit(1.0)).otherwise(_let(F.transform(F.array(a, b), canonical), lambda x: (F.get(x, F.lit(0)) == F.get(x, F.lit(1))).cast("double")))


#: What names a row: its key (a null one apart) and 128 bits of its text. Rows equal in these are equal.
_ROW = ["k", "no_key", "h1", "h2"]


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("key", F.coalesce("key", F.lit(0)).alias("k"), F.col("key").isNull().alias("no_key"), F.xxhash64(F.lit("l"), "text").alias("h1"), F.xxhash64(F.lit("r"), "text").alias("h2"), "text")


def _marked(rows: DataFrame) -> DataFrame:
    """Light rows with n_chars and fp, one for each row, written once."""
    from folioscope.llm import _text

    return _text.checkpointed(rows.select("key", *_ROW, F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fp")))


@dataclass
class _Groups:
    """forms: (fp, n, several, form) of the digests that n rows share, form being the first row with that canonical form; clash: (fp, h1, h2, own_form) where a digest has several forms, none if no digest has."""

    forms: DataFrame
    clash: DataFrame | None
    rows: int


def _grouped(rows: DataFrame, marks: DataFrame) -> _Groups:
    """Byte comparison inside equal buckets: texts, then their canonical bytes, are grouped by digest.

    Texts whose digest no other row has stay where they are: the hashes of the others pick these out, sent along where
    they are few, else met in a shuffle. Rows are named by 128 bits of their texts; should two texts of one digest share
    these too, comparing their bytes shows it, and that is an error.
    """
    from folioscope.llm import _text

    n_rows = marks.count()
    texts = marks.groupBy("fp", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("no_key", "k", "h1", "h2")).alias("form"))
    texts = _text.checkpointed(texts)
    shared = texts.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.min("form").alias("form")).where("n > 1")
    shared = _text.checkpointed(shared)
    hashes = _text.checkpointed(texts.join(shared.select("fp"), "fp", "left_semi").select("h1", "h2", "fp", "n"))
    few = hashes.count() <= MOST_SENT
    picked = rows.join(F.broadcast(hashes.drop("n")), ["h1", "h2"]) if few else _text.spread_join(rows, hashes, ["h1", "h2"], n_rows)
    copies = picked.groupBy("fp", "text").agg(F.min(F.struct("no_key", "k", "h1", "h2")).alias("form"))
    named = copies.groupBy("fp", canonical(F.col("text")).alias("bytes")).agg(F.min("form").alias("form"), F.count(F.lit(1)).alias("texts"))
    split = named.groupBy("fp").agg((F.count(F.lit(1)) > 1).alias("several"), F.sum("texts").alias("texts"))
    split = _text.checkpointed(split.join(shared, "fp"))
    if not split.where("texts <> kinds").isEmpty():
        raise ValueError("two texts share a digest and 128 bits of hash")
    forms = split.select("fp", "n", "several", "form")
    if split.where("several").isEmpty():
        return _Groups(forms, None, n_rows)
    again = copies.join(split.where("several").select("fp"), "fp", "left_semi").select("fp", "form.h1", "form.h2", canonical(F.col("text")).alias("bytes"))
    clash = again.join(named, ["fp", "bytes"]).select("fp", "h1", "h2", F.col("form").alias("own_form"))
    return _Groups(forms, _text.checkpointed(clash), n_rows)


def _with_form(light: DataFrame, groups: _Groups) -> DataFrame:
    """With form, the first row whose text has the same canonical bytes, and several."""
    from folioscope.llm import _text

    found = _text.spread_join(light, groups.forms, "fp", groups.rows, "left")
    own = F.struct("no_key", "k", "h1", "h2")
    if groups.clash is None:
        return found.withColumn("form", F.coalesce("form", own))
    return found.join(groups.clash, ["fp", "h1", "h2"], "left").withColumn("form", F.coalesce("own_form", "form", own)).drop("own_form")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, group_id): a row for each row of docs; group_id is the smallest key with the same canonical bytes.

    Rows with a null key belong to a group, but don't name it unless all its keys are null. Null texts are empty ones.
    """
    rows = _rows(docs, text, key)
    marks = _marked(rows)
    found = _with_form(marks, _grouped(rows, marks))
    return found.select(F.col("key").alias(key), F.col("fp").alias("fingerprint"), F.when(~F.col("form.no_key"), F.col("form.k")).alias("group_id"))


def _followed(distinct_marks: DataFrame, parts: int, *carry: str) -> DataFrame:
    """Distinct light rows with `after`, a struct of the next one's _ROW and `carry` by descending key; after the last comes the first.

    Rows are cut into ranges of keys and hashes. Inside one the successor is a window's; the last row of a range takes
    the first of the next, of which there are as many as ranges.
    """
    from folioscope.llm import _text

    dealt = distinct_marks.repartitionByRange(parts, F.asc("no_key"), F.desc("k"), "h1", "h2").withColumn("part", F.spark_partition_id())
    dealt = _text.checkpointed(dealt)
    order = Window.partitionBy("part").orderBy("no_key", F.desc("k"), "h1", "h2")
    row = F.struct(*_ROW, *carry)
    held = dealt.withColumns({"after": F.lead(row).over(order), "place": F.row_number().over(order)})
    heads = held.where("place = 1").select("part", row.alias("head"))
    ring = Window.orderBy("part")
    opens = heads.select("part", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("opens"))
    return held.drop("place").join(opens, "part").withColumn("after", F.coalesce("after", "opens")).drop("opens", "part")


def _parts(marks: DataFrame) -> int:
    from folioscope.llm import _text

    return _text.parts(marks, marks.count(), ORDER_ROWS)


def _sent(texts: DataFrame, followed: DataFrame, part) -> DataFrame:
    """followed with text, and with `part(the next one's text)` as sent."""
    asked = followed.select(*(F.col(f"after.{c}").alias(c) for c in _ROW), *(F.col(c).alias(f"to_{c}") for c in _ROW), "n_chars")
    sent = texts.join(asked, _ROW).select(*(F.col(f"to_{c}").alias(c) for c in _ROW), part(F.col("text")).alias("sent"))
    return texts.join(followed, _ROW).join(sent, _ROW)


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """(key, text, next): each whole text and that of the next document by descending key; after the last comes the first.

    Keys must be numbers. Rows with a null key come last; rows with one key stand in the order of their texts' hashes,
    equal ones next to each other. The one row of a table of one row is its own successor.
    """
    rows = _rows(docs, text, key)
    marks = rows.groupBy(*_ROW).agg(F.count(F.lit(1)).alias("n"), F.first(F.length("text")).alias("n_chars"))
    found = _sent(rows.dropDuplicates(_ROW), _followed(marks, buckets or _parts(marks)), lambda t: t)
    # equal rows follow one another; the last of them has the next one
    nexts = F.concat(F.array("sent"), F.array_repeat("text", (F.col("n") - 1).cast("int")))
    return found.select(F.when(~F.col("no_key"), F.col("k")).alias(key), F.col("text").alias(text), F.explode(nexts).alias("next"))


def edited(text: Column, other: Column) -> Column:
    """A text whose last third (rounded down, in code points) gives way to as many characters of the other's beginning."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(other, F.lit(1), third))


def edit_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id) of every whole text.

    Nulls count as empty texts. An exact digest knows two degrees of likeness only: 1 for one canonical form, else 0.
    group_id is the smallest key of the texts with the same canonical bytes, as exact_groups() has it; likeness to the
    next document is that of its group. Equal rows follow one another.
    """
    rows = _rows(docs, text, key)
    marks, texts = _marked(rows), rows.select(*_ROW, "text").dropDuplicates(_ROW)
    followed = _followed(marks.groupBy(*_ROW, "n_chars", "fp").agg(F.count(F.lit(1)).alias("n")), _parts(marks), "fp")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    found = _sent(texts, followed, lambda t: F.substring(t, F.lit(1), third))
    begin = F.substring("text", F.lit(1), F.length("text") - third)

    def judged(sent: Column) -> Column:
        def digests(changed: Column) -> Column:
            return _let(fingerprint(changed), lambda f: F.struct(F.sha2(changed, 256).alias("sha"), f.alias("fp"), alike(F.col("text"), F.col("fp"), changed, f).alias("alike")))

        return _let(F.concat(begin, sent), digests)

    # equal rows follow one another; the last of them has the next one
    nexts = F.when(F.col("n") > 1, F.array("sent", F.substring("text", F.lit(1), third))).otherwise(F.array("sent"))
    found = found.select(*_ROW, "n_chars", "fp", F.col("n").alias("equal_rows"), "after", F.transform(nexts, judged).alias("results"))
    groups = _grouped(rows, marks)
    found = _with_form(found, groups)
    same = F.col("fp") == F.col("after.fp")
    if groups.clash is not None:
        next_form = groups.clash.select(*(F.col(c).alias(f"next_{c}") for c in ("fp", "h1", "h2")), F.col("own_form").alias("next_form"))
        found = found.join(next_form, (F.col("after.fp") == F.col("next_fp")) & (F.col("after.h1") == F.col("next_h1")) & (F.col("after.h2") == F.col("next_h2")), "left")
        same &= ~F.coalesce("several", F.lit(False)) | F.col("form").eqNullSafe(F.col("next_form"))
    of = lambda k, near: F.struct(F.get("results", F.lit(k)).alias("last"), near.alias("near"))
    results = F.concat(F.array(of(0, same.cast("double"))), F.array_repeat(of(1, F.lit(1.0)), (F.col("equal_rows") - 1).cast("int")))
    return found.withColumn("x", F.explode(results)).select(
        F.when(~F.col("no_key"), F.col("k")).alias(key),
        "n_chars",
        F.col("x.last.sha").alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.col("x.last.fp").alias("edited_fingerprint"),
        F.col("x.last.alike").alias("near_edited"),
        F.col("x.near").alias("near_next"),
        F.when(~F.col("form.no_key"), F.col("form.k")).alias("group_id"),
    )
