"""Agreement and validation: kappa, confusion, per-class scores; samples and splits; the coding workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.functions.numbers import decade
from folioscope.operators import relational

# A coder's answer and the model's value it is held against.
CONFIRM = {
    "Q1_communication_type": ("model_is_scientific", {"scientific": "true", "other_scholarly": "false"}),
    "Q2_empirical_status": ("model_is_empirical", {"empirical": "true", "non_empirical": "false"}),
    "Q3_methodology": ("model_methodology", {"quantitative": "quantitative", "qualitative": "qualitative", "mixed": "mixed", "review": "review"}),
}
FIELDS = ("Q1_communication_type", "Q2_empirical_status", "Q3_methodology", "Q4_prevention_level", "Q5_sdoh_addressed")
BLINDED = (
    "meta_is_scientific", "meta_is_empirical", "meta_methodology", "label_is_scientific", "label_is_empirical", "label_methodology", "label_source_is_scientific", "label_source_is_empirical",
    "label_source_methodology", "rule_is_scientific", "rule_is_empirical", "rule_methodology", "review_type",
)
HUMAN = ("medline", "medline_narrative_review", "medline_systematic_review")


# --- agreement


def confusion(pairs: DataFrame, a: str = "a", b: str = "b", by: list[str] | None = None) -> DataFrame:
    """(by, a, b, n) of pairs that both have; everything else follows from these few rows."""
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(by or []), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def agreement(pairs: DataFrame, a: str = "a", b: str = "b", by: list[str] | None = None) -> DataFrame:
    """(by, n_pairs, n_agree, percent_agreement, cohens_kappa, modal_pct). kappa is null where only one category occurs."""
    by = by or []
    cells = confusion(pairs, a, b, by)
    rows = cells.groupBy(*by, F.col("a").alias("c")).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(*by, F.col("b").alias("c")).agg(F.sum("n").alias("nb"))
    both = rows.withColumn("nb", F.lit(0).cast("long")).unionByName(cols.withColumn("na", F.lit(0).cast("long"))).groupBy(*by, "c").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    chance = both.groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("_chance"), F.max("na").alias("_mode"), F.count(F.lit(1)).alias("_classes"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n_pairs"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("n_agree"))
    one = total.join(chance, by) if by else total.join(chance)
    n = F.col("n_pairs").cast("double")
    po, pe = F.col("n_agree") / n, F.col("_chance") / (n * n)
    kappa = F.when(F.col("_classes") > 1, (po - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return one.where("n_pairs > 0").select(*by, "n_pairs", "n_agree", F.round(100.0 * F.col("n_agree") / F.col("n_pairs"), 2).alias("percent_agreement"), kappa.alias("cohens_kappa"), F.round(100.0 * F.col("_mode") / F.col("n_pairs"), 2).alias("modal_pct"))


def band(kappa: Column) -> Column:
    return F.when(kappa < 0.2, "poor").when(kappa < 0.4, "fair").when(kappa < 0.6, "moderate").when(kappa < 0.8, "substantial").when(kappa.isNotNull(), "almost perfect").otherwise("undefined")


def interpreted(agreed: DataFrame) -> DataFrame:
    """With band and caution: a mode over 85 per cent makes a kappa under 0.6 harsh."""
    return agreed.withColumns({"band": band(F.col("cohens_kappa")), "caution": (F.col("modal_pct") > 85) & F.coalesce(F.col("cohens_kappa") < 0.6, F.lit(False))})


def per_class(pairs: DataFrame, truth: str = "a", predicted: str = "b") -> DataFrame:
    """(label, support, precision, recall, f1); a class that's never predicted has precision 0."""
    cells = confusion(pairs, truth, predicted)
    rows = cells.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("hit"))
    cols = cells.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("called"))
    j = rows.join(cols, "label", "full").na.fill(0, ["support", "hit", "called"])
    p, r = (F.coalesce(F.col("hit").cast("double") / F.nullif(c, F.lit(0)), F.lit(0.0)) for c in ("called", "support"))
    j = j.withColumns({"precision": p, "recall": r})
    f1 = F.coalesce(2 * F.col("hit").cast("double") / F.nullif(F.col("support") + F.col("called"), F.lit(0)), F.lit(0.0))
    return j.select("label", "support", "precision", "recall", f1.alias("f1"))


def macro_f1(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("f1").alias("macro_f1"))


def marginals(df: DataFrame, column: str) -> DataFrame:
    g = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(F.lit(0))), 3))


# --- samples and splits; an md5 of seed and key stands for chance, so every engine and run draws alike


def lot(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def stratified_sample(df: DataFrame, strata: list[str], n: int, seed: int = 7, key: str = "record_id") -> DataFrame:
    """n records, as equal a number from each stratum as n allows; smaller strata give all they have. Null strata are left out.

    Each stratum is cut to its own share by a ranking inside it, which Spark prunes before the shuffle.
    """
    known = df
    for s in strata:
        known = known.where(F.col(s).isNotNull())
    k = known.select(*strata).distinct().count()
    if not k:
        return known.withColumn("lot", F.lit("")).limit(0)
    per = max(1, n // k)
    w = Window.partitionBy(*strata).orderBy("lot", key)
    drawn = known.withColumn("lot", lot(key, seed)).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per).drop("_k")
    return drawn.orderBy("lot", key).limit(n)


def with_decades(df: DataFrame, year: str = "year") -> DataFrame:
    return df.withColumn("decade", decade(F.col(year)))


def holdout(df: DataFrame, share_out: float = 0.2, seed: int = 7, key: str = "record_id") -> DataFrame:
    """With held_out: a fixed fifth (or other share) of the keys by hash. Narrow: nothing is sorted or moved."""
    return df.withColumn("held_out", F.conv(F.substring(lot(key, seed), 1, 8), 16, 10).cast("long") < int(share_out * (1 << 32)))


def folds_by_group(df: DataFrame, group: str, k: int = 3) -> DataFrame:
    """(group, fold): whole groups dealt to k folds, largest first, each to the fold with least so far. One row a group reaches the driver."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()
    load, out = [0] * k, []
    for r in sorted(sizes, key=lambda r: (-r["n"], str(r[group]))):
        f = load.index(min(load))
        load[f] += r["n"]
        out.append((r[group], f))
    return df.sparkSession.createDataFrame(out, f"{group} {dict(df.dtypes)[group]}, fold int")


def leave_one_out(df: DataFrame, group: str = "decade") -> list[tuple[object, DataFrame, DataFrame]]:
    """(value, the rest, the group) for each value of a column of few values."""
    values = [r[0] for r in df.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).collect()]
    return [(v, df.where(F.col(group) != v), df.where(F.col(group) == v)) for v in values]


def shuffled(df: DataFrame, n_calibration: int, seed: int = 7, key: str = "record_id") -> DataFrame:
    """A sample for coders in a fixed chance order: row from 1, and batch (calibration for the first ones, then main)."""
    numbered = relational.numbered(df.withColumn("_lot", F.concat_ws("|", lot(key, seed), F.col(key).cast("string"))), "_lot", "row").drop("_lot")
    return numbered.withColumn("row", F.col("row").cast("int")).withColumn("batch", F.when(F.col("row") <= n_calibration, "calibration").otherwise("main"))


# --- truth, blinding


def truth(df: DataFrame, stage: str) -> Column:
    """What people's indexing says of a stage, as text; null without any."""
    return F.when(F.col(f"label_source_{stage}").isin(*HUMAN), F.col(f"label_{stage}").cast("string"))


def blinded(df: DataFrame) -> DataFrame:
    """With all evidence that came from labels set to null, kinds kept."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in BLINDED if c in df.columns})


def for_coders(df: DataFrame, columns: tuple[str, ...] = ("row", "batch", "record_id", "year", "journal_canonical", "title", "abstract")) -> DataFrame:
    """The coders' sheet: the columns shown, and empty ones for answers; fails if a model's opinion would leak."""
    leaks = [c for c in columns if c.startswith(("model_", "label_", "rule_", "meta_", "pred_", "cls_"))]
    if leaks:
        raise ValueError(f"coders would see {leaks}")
    return df.select(*(c for c in columns if c in df.columns), *(F.lit(None).cast("string").alias(c) for c in (*FIELDS, "FLAG", "NOTES")))


# --- two coders


def paired(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "record_id") -> DataFrame:
    """Both coders' answers side by side, cleaned. Fails if an id is missing on a side or comes twice."""
    clean = lambda df, s: df.select(F.col(key), *(text.answer(F.col(c).cast("string")).alias(f"{s}_{c}") for c in (*fields, "FLAG") if c in df.columns))
    left, right = clean(a, "a"), clean(b, "b")
    for df in (left, right):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} isn't unique")
    if left.select(key).exceptAll(right.select(key)).limit(1).count() or right.select(key).exceptAll(left.select(key)).limit(1).count():
        raise ValueError("the coders' sheets hold unlike records")
    return left.join(right, key)


def long_pairs(both: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "record_id") -> DataFrame:
    """(record_id, field, a, b)."""
    return both.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in fields))).alias("x")).select(key, "x.*")


def reliability(both: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """agreement() and its reading for each field."""
    return interpreted(agreement(long_pairs(both, fields), by=["field"]))


def adjudication(both: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Records to decide: any field on which the coders differ (a blank differs from an answer), or a flag; with the reasons."""
    reasons = [F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]
    if "a_FLAG" in both.columns:
        reasons.append(F.when(F.col("a_FLAG").isNotNull() | F.col("b_FLAG").isNotNull(), F.lit("FLAG")))
    return both.withColumn("reasons", F.array_compact(F.array(*reasons))).where(F.size("reasons") > 0)


def consensus(both: DataFrame, decided: DataFrame | None = None, fields: tuple[str, ...] = FIELDS, key: str = "record_id") -> DataFrame:
    """(record_id, fields): the decided value, else what both say, else null."""
    df = both
    if decided is not None:
        df = df.join(decided.select(key, *(text.answer(F.col(f)).alias(f"d_{f}") for f in fields)), key, "left")
    agreed = lambda f: F.when(F.col(f"a_{f}") == F.col(f"b_{f}"), F.col(f"a_{f}"))
    return df.select(key, *((F.coalesce(F.col(f"d_{f}"), agreed(f)) if decided is not None else agreed(f)).alias(f) for f in fields))


def confirmatory(agreed: DataFrame, scoring_key: DataFrame, key: str = "record_id") -> DataFrame:
    """agreement of the consensus with the model's values, field by field; one record to one, else it fails."""
    for df in (agreed, scoring_key):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} isn't unique")
    joined = agreed.join(scoring_key, key)
    rows = []
    for field, (model, values) in CONFIRM.items():
        mapped = F.coalesce(*(F.when(F.col(field) == k, F.lit(v)) for k, v in values.items()))
        rows.append(F.struct(F.lit(field).alias("field"), mapped.alias("a"), text.answer(F.col(model).cast("string")).alias("b")))
    return interpreted(agreement(joined.select(F.explode(F.array(*rows)).alias("x")).select("x.*"), by=["field"]))


def score_template(coded: DataFrame, stages: tuple[str, ...] = ("is_scientific", "is_empirical", "methodology")) -> DataFrame:
    """agreement of human_ with model_ columns, stage by stage."""
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), text.answer(F.col(f"human_{s}").cast("string")).alias("a"), text.answer(F.col(f"model_{s}").cast("string")).alias("b")) for s in stages))
    return agreement(coded.select(F.explode(rows).alias("x")).select("x.*"), by=["stage"])
