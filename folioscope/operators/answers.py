"""Labels from an answering model, whose answers are kept under the hash of what was asked.

A prompt is asked once, however many records share it, and never again once its answer is in the store; so a run that was
cut off, or one over a grown corpus, asks only what is new. Stages are asked one after another within a task, and a record
that a stage rules out isn't asked further. Texts are shuffled once, to be distinct and to meet the store; answers are joined
back to light rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import graph

STORED = "prompt_id string, stage string, label string, confidence double"
#: What a stage may answer, as (answer, value); any other answer leaves the stage undecided.
ANSWERS = {
    "is_scientific": (("scientific", "true"), ("non_scientific", "false")),
    "is_empirical": (("empirical", "true"), ("non_empirical", "false")),
    "methodology": (("quantitative", "quantitative"), ("qualitative", "qualitative"), ("mixed", "mixed"), ("review", "review")),
}


def parsed(said: str | None) -> tuple[str, float]:
    """(label, confidence) of a JSON object, alone or amid prose; what can't be read is uncertain with confidence 0."""
    found = re.search(r"\{.*\}", said or "", re.S)
    try:
        value = json.loads(found[0]) if found else {}
    except ValueError:
        value = {}
    label = value.get("label")
    try:
        sure = float(value.get("confidence") or 0)
    except (TypeError, ValueError):
        sure = 0.0
    return ("uncertain", 0.0) if label is None else (str(label).lower(), sure)


def _value(stage: str, label: Column) -> Column:
    return F.coalesce(*(F.when(label == said, F.lit(v)) for said, v in ANSWERS[stage]))


def stored(spark: SparkSession, store: str) -> DataFrame:
    """(prompt_id, a struct of label and confidence for each stage), one row a prompt; the store is made if it isn't there.

    A prompt that two runs answered at the same time has the lesser answer, so that all readers see the same one.
    """
    spark.createDataFrame([], STORED).write.mode("ignore").parquet(store)
    rows = spark.read.schema(STORED).parquet(store)
    return rows.groupBy("prompt_id").agg(*(F.min(F.when(F.col("stage") == s, F.struct("label", "confidence"))).alias(s) for s in ANSWERS))


def ask_new(texts: DataFrame, ask: Callable[[str, str], str | None], store: str) -> None:
    """Asks about each of (prompt_id, text) what the store doesn't know yet, and appends what was said.

    Files show up in the store only once their whole job is done; a task that is lost asks its prompts again.
    """
    order = [(stage, {said for said, v in known if v == "true"}) for stage, known in ANSWERS.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for stage, going_on in order:
                    said = row[stage]
                    if said is None:
                        said = parsed(ask(stage, f"{stage}\n{row['text']}"))
                        out.append((row["prompt_id"], stage, *said))
                    if said[0] not in going_on:
                        break
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], ["prompt_id", "stage", "label", "confidence"])

    labels = {s: F.col(f"{s}.label") for s in ANSWERS}
    open_ = reduce(lambda rest, s: labels[s].isNull() | _value(s, labels[s]).eqNullSafe("true") & rest, reversed(ANSWERS), F.lit(False))
    distinct = texts.groupBy("prompt_id").agg(F.min("text").alias("text"))
    new = distinct.join(stored(texts.sparkSession, store), "prompt_id", "left").where(open_)
    new.select("prompt_id", "text", *(F.when(labels[s].isNotNull(), F.array(labels[s])).alias(s) for s in ANSWERS)).mapInArrow(run, STORED).write.mode("append").parquet(store)


def answered(records: DataFrame, ask: Callable[[str, str], str | None], store: str, name: str, key: str = "record_id", title: str = "title", abstract: str = "abstract") -> DataFrame:
    """(key, is_scientific, is_empirical, methodology, cls_backend, cls_confidence) of every record.

    `ask(stage, prompt)` returns prose with a JSON object of label and confidence; a prompt is the stage, the whole title
    and the whole abstract, a line each. It runs in Python workers and must be picklable. `name` names the model and is
    part of what is hashed, so another model's answers are its own. A record that isn't scientific is asked no further,
    nor is one that isn't empirical; confidence is the least of those asked. Null and empty texts are asked like any
    other. An error of `ask` fails the run, and what earlier runs were told stays stored. Rows are judged one by one,
    repeated ones and null keys too.
    """
    text = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(F.col(abstract), F.lit("")))
    prompt_id = F.sha2(F.concat(F.lit(f"{name}\n"), text), 256).alias("prompt_id")
    ask_new(records.select(prompt_id, text.alias("text")), ask, store)
    rows = graph.checkpointed(records.select(F.col(key).alias("k"), prompt_id))
    counts = rows.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"))
    # shared prompts, as empty texts are, may be most of all rows
    met = graph.spread_join(rows, stored(records.sparkSession, store).join(counts, "prompt_id"), "prompt_id", rows.count())
    value = {s: _value(s, F.col(f"{s}.label")) for s in ANSWERS}
    scientific = value["is_scientific"].eqNullSafe("true")
    empirical = scientific & value["is_empirical"].eqNullSafe("true")
    asked = [F.col("is_scientific.confidence"), F.when(scientific, F.col("is_empirical.confidence")), F.when(empirical, F.col("methodology.confidence"))]
    return met.select(
        F.col("k").alias(key), scientific.alias("is_scientific"), F.when(scientific, value["is_empirical"].cast("boolean")).alias("is_empirical"), F.when(empirical, value["methodology"]).alias("methodology"),
        F.lit(f"answers:{name}").alias("cls_backend"), F.round(F.least(*asked), 4).alias("cls_confidence"),
    )
