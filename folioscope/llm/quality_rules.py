"""Quality rules as a short-circuit cascade, in DataFrame functions throughout.

Each rule is a condition that a text fails. The cost and the selectivity of each are estimated on a small sample; rules
then stand in one chain of WHENs by rejections per cost. What a rule alone needs is computed inside its WHEN, from the
raw text, so a text that a cheap rule rejects never pays for the dear ones.

A rule's cost is the work of its features on the sample: their prices (PRICES, nanoseconds for each character and each
word, measured once with an empty job taken off) times the sample's sizes. Work is counted and not timed again, so
the order, and with it the rule that a rejected text is named by, is the same in every run. The verdict doesn't depend
on the order at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that costs and selectivities are estimated on, at most in expectation.
SAMPLE_ROWS = 500
#: Nanoseconds of a feature for each character and for each word of a text. Words themselves are shared by all rules.
PRICES = {"words": (0, 0), "word_chars": (20, 0), "symbols": (5, 0), "dup_lines": (8, 0), "echo_words": (0, 80), "repeat_words": (0, 520), "lines": (1, 0), "shouts": (5, 0)}
#: What a comparison costs beside its features, in nanoseconds.
COMPARED = 20

SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+", -1), "")


def _let(value: Column, body) -> Column:
    """body(value), with the value in the expression once."""
    return F.get(F.transform(F.array(value), body), 0)


def _echoes(w: Column) -> Column:
    return F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x)))


def _grams(w: Column) -> Column:
    """Hashes of the 8-word windows; null where there are none that could repeat."""
    return F.when(F.size(w) > 8, F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.xxhash64(F.slice(w, i, F.lit(8)))))


def _twice(grams: Column) -> Column:
    """The windows that occur twice or more, ascending; null where all are distinct, which a distinct count tells."""
    at = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(at: Column) -> Column:
        last = F.size(at) - 1
        same = F.filter(at, lambda x, k: ((k > 0) & (F.get(at, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(at, k + 1)["h"] == x["h"])))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), _let(at, places))


def _covered(twice: Column) -> Column:
    """How many words the windows cover."""
    n = F.aggregate(
        twice,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, i: F.struct((s["n"] + i + 8 - F.greatest(s["to"], i)).alias("n"), (i + 8).alias("to")),
        lambda s: s["n"],
    )
    return F.coalesce(n, F.lit(0))


def features(text: Column, w: Column) -> dict[str, Column]:
    """Each feature as one expression over the whole text and its words' hashes; a null text counts as empty."""
    own = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(own, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    found = {
        "words": F.size(w),
        "word_chars": F.length(F.regexp_replace(own, "[ \\t-\\r]+", "")),
        "symbols": F.regexp_count(own, F.lit(f"[{SYMBOLS}]")),
        "dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "echo_words": _echoes(w),
        "repeat_words": _let(_grams(w), lambda g: _let(_twice(g), _covered)),
        "lines": F.size(F.split(own, "\n", -1)),
        "shouts": F.length(own) - F.length(F.replace(own, F.lit("!"), F.lit(""))),
    }
    return {k: x.cast("long") for k, x in found.items()}


def hashed_words(text: Column) -> Column:
    return F.transform(words(F.coalesce(text.cast("string"), F.lit(""))), lambda w: F.xxhash64(w))


def measured(docs: DataFrame, text: str = "text", drop_words: bool = True) -> DataFrame:
    """docs with the columns q_words, q_word_chars, q_symbols, q_dup_lines and q_repeat_words (all long); a null text counts as empty.

    q_repeat_words: words covered by 8-word windows that occur twice or more in the text. A text without repeated
    windows, the usual one, is told by a distinct count over window hashes; only others sort their windows. Columns that
    docs has under q_ names are replaced.
    """
    df = docs.withColumn("q_w", hashed_words(F.col(text)))
    own = features(F.col(text), F.col("q_w"))
    df = df.withColumns({f"q_{k}": own[k] for k in ("words", "word_chars", "symbols", "dup_lines")} | {"q_grams": _grams(F.col("q_w"))})
    df = df.withColumn("q_twice", _twice(F.col("q_grams"))).drop("q_grams")
    df = df.withColumn("q_repeat_words", _covered(F.col("q_twice")).cast("long")).drop("q_twice")
    return df.drop("q_w") if drop_words else df


#: Name of each rule, the features it reads, and the condition of failing over them. Integer comparisons, so that every engine judges alike.
RULES = {
    "few_words": (("words",), lambda words: words < 20),
    "repeated_words": (("repeat_words", "words"), lambda repeat, words: repeat * 100 > words * 30),
    "symbols": (("symbols", "words"), lambda symbols, words: symbols * 10 > words * 3),
    "short_words": (("word_chars", "words"), lambda chars, words: chars < words * 2),
    "long_words": (("word_chars", "words"), lambda chars, words: chars > words * 15),
    "echoes": (("echo_words", "words"), lambda echoes, words: echoes * 10 > words * 3),
    "repeated_lines": (("dup_lines", "lines"), lambda dup, lines: dup * 2 > lines),
    "shouting": (("shouts", "words"), lambda shouts, words: shouts * 10 > words * 5),
}


def rules(text: str = "text", known: tuple[str, ...] = ()) -> dict[str, Column]:
    """Name and condition of failing, over the text, its words' hashes in q_w, and the q_ columns of features that are `known`."""
    own = features(F.col(text), F.col("q_w")) | {k: F.col(f"q_{k}") for k in known}
    return {name: fails(*(own[k] for k in needs)) for name, (needs, fails) in RULES.items()}


def costs(chars: float, n_words: float, known: tuple[str, ...] = ()) -> dict[str, float]:
    """Nanoseconds of each rule for a text of so many characters and words; features that are `known` are paid for already."""
    price = lambda k: 0 if k in known else PRICES[k][0] * chars + PRICES[k][1] * n_words
    return {name: COMPARED + sum(map(price, needs)) for name, (needs, _) in RULES.items()}


def plan(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> list[str]:
    """The rules' names, best rejection per cost first; equal ones, and all of an empty sample, as they're declared."""
    own = list(RULES)
    n = docs.count()
    if not n:
        return own
    rate = min(1.0, sample_rows / n)
    sample = docs.select(F.col(key).alias("q_key"), F.col(text).alias("q_text")).where(F.pmod(F.xxhash64("q_key", F.lit(7)), F.lit(1_000_000)) < rate * 1_000_000)
    sample = sample.withColumn("q_w", hashed_words(F.col("q_text")))
    sizes = [F.count(F.lit(1)).alias("n"), F.avg(F.length("q_text")).alias("chars"), F.avg(F.size("q_w")).alias("words")]
    total = sample.agg(*sizes, *(F.count_if(c).alias(k) for k, c in rules("q_text").items())).first()
    if not total["n"]:
        return own
    cost = costs(total["chars"] or 0.0, total["words"] or 0.0, known)
    return sorted(own, key=lambda k: (-(total[k] / total["n"]) / cost[k], own.index(k)))


def cascade(docs: DataFrame, order: list[str], text: str = "text", known: tuple[str, ...] = (), hashed: bool = False) -> DataFrame:
    """With kept (no rule fails) and failed_rule (the first in `order` that does, else null). Needs the q_ columns of what's `known`; `hashed` says that q_w is there."""
    docs = docs if hashed else docs.withColumn("q_w", hashed_words(F.col(text)))
    own = features(F.col(text), F.col("q_w")) | {k: F.col(f"q_{k}") for k in known} | {"words": F.size("q_w").cast("long")}

    def rest(k: int, made: dict[str, Column]) -> Column:
        """The chain from rule k on; a feature that later rules read too is computed where the first of them is reached."""
        if k == len(order):
            return F.lit(None).cast("string")
        needs, fails = RULES[order[k]]
        later = {n for name in order[k + 1 :] for n in RULES[name][0]}
        for n in needs:
            if n not in made and n in later:
                return _let(own[n], lambda x: rest(k, made | {n: x}))
        return F.when(fails(*(made.get(n, own[n]) for n in needs)), F.lit(order[k])).otherwise(rest(k + 1, made))

    chain = rest(0, {n: own[n] for n in (*known, "words")})
    return docs.withColumn("failed_rule", chain).withColumn("kept", F.col("failed_rule").isNull()).drop("q_w")


#: Features that measured() gives.
MEASURED = ("words", "word_chars", "symbols", "dup_lines", "repeat_words")


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, measures: bool = True) -> DataFrame:
    """docs with failed_rule and kept, and with the q_ columns of measured() if `measures`; without them a rule's features are only computed where it's reached.

    Null and empty texts fail few_words; repeated rows are judged each; an empty table gives an empty one. Columns of
    docs named kept, failed_rule or q_* like one made here are replaced.
    """
    known = MEASURED if measures else ()
    df = measured(docs, text, drop_words=False) if measures else docs
    return cascade(df, plan(docs, text, key, sample_rows, known), text, known, measures)
