"""The text model: TF-IDF over words and word pairs, balanced logistic regression, one model a stage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, HashingTF, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import fold_accents
from folioscope.operators import labels, validation

# Fixed values.
LEAST_PER_CLASS, MIN_DF, MAX_DF, VOCABULARY, STRENGTH = 40, 5, 0.6, 120_000, 4.0


@dataclass
class StageModel:
    """A fitted stage: text to counts, damped counts to classes; its classes in index order."""

    counts: PipelineModel
    rest: PipelineModel
    classes: list[str]


@dataclass
class Classifier:
    """Models of the stages that had enough labels, and the reasons why others have none."""

    stages: dict[str, StageModel] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)


def prepared(df: DataFrame, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """With model_text: title and abstract, folded."""
    return df.withColumn("model_text", F.lower(fold_accents(F.concat_ws(". ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(abstract), F.lit(""))))))


@F.udf(VectorUDT())
def _damped(counts):
    """1 + ln of each count. The one row-wise function of this module: vectors can't enter Arrow batches."""
    import numpy as np

    return Vectors.sparse(counts.size, counts.indices, 1.0 + np.log(counts.values)) if len(counts.values) else counts


def _counting(min_df: float, hashed: bool) -> list:
    """Tokens without stop words, pairs of them, counts. Hashing keeps the vocabulary off the driver."""
    counter = HashingTF(inputCol="grams", outputCol="counts", numFeatures=1 << 17) if hashed else CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=VOCABULARY, minDF=min_df, maxDF=MAX_DF)
    return [
        RegexTokenizer(inputCol="model_text", outputCol="all_words", pattern="\\w\\w+", gaps=False),
        StopWordsRemover(inputCol="all_words", outputCol="words"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
        counter,
    ]


def fit_stage(df: DataFrame, label: str, min_df: float = MIN_DF, least: int = LEAST_PER_CLASS, hashed: bool = False, max_iter: int = 50) -> StageModel | str:
    """A model of the records whose `label` isn't null, or the reason why there's none. Needs model_text."""
    known = df.where(F.col(label).isNotNull()).withColumn("label_text", F.col(label).cast("string"))
    sizes = {r["label_text"]: r["n"] for r in known.groupBy("label_text").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return "fewer than two classes"
    if min(sizes.values()) < least:
        return f"a class has fewer than {least} records"
    total = sum(sizes.values())
    weight = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(total / (len(sizes) * n)))))
    known = known.withColumn("weight", F.element_at(weight, F.col("label_text"))).select("model_text", "label_text", "weight")
    counting = Pipeline(stages=_counting(min_df, hashed)).fit(known)
    # read by each of the fits below; lost parts are computed again
    counted = counting.transform(known).select("label_text", "weight", _damped("counts").alias("damped")).persist(StorageLevel.MEMORY_AND_DISK)
    idf = IDF(inputCol="damped", outputCol="weighed").fit(counted)
    # frequencies are weighed by 1 + idf, so that a word of every record still counts
    scale = ElementwiseProduct(inputCol="damped", outputCol="weighed", scalingVec=Vectors.dense(idf.idf.toArray() + 1.0))
    indexer = StringIndexer(inputCol="label_text", outputCol="label_index", stringOrderType="alphabetAsc").fit(counted)
    regression = LogisticRegression(featuresCol="features", labelCol="label_index", weightCol="weight", regParam=1.0 / (STRENGTH * total), maxIter=max_iter)
    rest = Pipeline(stages=[scale, Normalizer(inputCol="weighed", outputCol="features", p=2.0), regression]).fit(indexer.transform(counted))
    counted.unpersist()
    back = IndexToString(inputCol="prediction", outputCol="predicted_text", labels=indexer.labels)
    return StageModel(counting, PipelineModel(stages=[*rest.stages, back]), list(indexer.labels))


def predict_stage(df: DataFrame, model: StageModel, stage: str) -> DataFrame:
    """With pred_ and conf_ of a stage."""
    out = model.rest.transform(model.counts.transform(df).withColumn("damped", _damped("counts")))
    return out.select(*df.columns, F.col("predicted_text").alias(f"pred_{stage}"), F.array_max(vector_to_array("probability")).alias(f"conf_{stage}"))


def fit(df: DataFrame, min_df: float = MIN_DF, least: int = LEAST_PER_CLASS, hashed: bool = False) -> Classifier:
    """Three stages, each on the records that its labels reach; a stage short of labels is skipped, and that's recorded."""
    out = Classifier()
    ready = prepared(df)
    for stage in labels.STAGES:
        got = fit_stage(ready, f"label_{stage}", min_df, least, hashed)
        if isinstance(got, str):
            out.skipped[stage] = got
        else:
            out.stages[stage] = got
    return out


def predict(df: DataFrame, classifier: Classifier) -> DataFrame:
    """With pred_ and conf_ of every stage, null where a stage has no model; labels.decide() takes it from there."""
    out = prepared(df)
    for stage in labels.STAGES:
        if stage in classifier.stages:
            out = predict_stage(out, classifier.stages[stage], stage)
        else:
            out = out.withColumns({f"pred_{stage}": F.lit(None).cast("string"), f"conf_{stage}": F.lit(None).cast("double")})
    return out.drop("model_text")


def grouped_cross_validation(df: DataFrame, label: str, group: str = "year", k: int = 3, **arguments) -> DataFrame:
    """(fold, agreement with the label) with whole groups held out in turn."""
    ready = prepared(df).where(F.col(label).isNotNull()).join(validation.folds_by_group(df, group, k), group)
    out = None
    for fold in range(k):
        model = fit_stage(ready.where(F.col("fold") != fold), label, **arguments)
        if isinstance(model, str):
            continue
        said = predict_stage(ready.where(F.col("fold") == fold), model, "x").select(F.lit(fold).alias("fold"), F.col(label).cast("string").alias("a"), F.col("pred_x").alias("b"))
        out = said if out is None else out.unionByName(said)
    if out is None:
        raise ValueError("no fold had enough labels")
    return validation.agreement(out, by=["fold"])


def temporal_validation(df: DataFrame, label: str, group: str = "decade", **arguments) -> DataFrame:
    """(group, agreement) with each decade held out in turn."""
    ready = prepared(validation.with_decades(df)).where(F.col(label).isNotNull())
    out = None
    for value, rest, own in validation.leave_one_out(ready, group):
        model = fit_stage(rest, label, **arguments)
        if isinstance(model, str):
            continue
        said = predict_stage(own, model, "x").select(F.lit(value).alias(group), F.col(label).cast("string").alias("a"), F.col("pred_x").alias("b"))
        out = said if out is None else out.unionByName(said)
    if out is None:
        raise ValueError("no group left enough labels")
    return validation.agreement(out, by=[group])


def holdout_validation(df: DataFrame, share_out: float = 0.2, seed: int = 7, **arguments) -> DataFrame:
    """(stage, agreement): models fitted without the held-out records, judged on those that people indexed, evidence blinded."""
    split = validation.holdout(df, share_out, seed)
    classifier = fit(split.where("not held_out"), **arguments)
    own = split.where("held_out")
    for stage in labels.STAGES:
        own = own.withColumn(f"truth_{stage}", validation.truth(own, stage))
    said = labels.decide(predict(validation.blinded(own), classifier))
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"truth_{s}").alias("a"), F.col(s).cast("string").alias("b")) for s in labels.STAGES))
    return validation.agreement(said.select(F.explode(rows).alias("x")).select("x.*"), by=["stage"])
