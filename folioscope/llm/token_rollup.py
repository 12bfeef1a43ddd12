"""Token counts as rollups that signed deltas maintain.

A batch of changes is a table of signed contributions: an insert adds a document and its tokens, a delete takes both
away, a revised count adds the difference. Each batch is summed by source, language and tokenizer version before
anything is shuffled or stored, so it costs as much as it has groups. Totals are sums over the batches committed.

A commit is the rename of a folder written elsewhere in the store to the batch's name. It happens once: a batch whose
name is there already is left alone, so a retry or replay changes nothing, and a run that dies leaves no half batch.

A snapshot holds the totals of the batches that it names. Totals are the newest snapshot and the batches outside it, so
what a reader lists and reads doesn't grow with the store's age where snapshots are taken.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer")


def words_count(text: Column) -> Column:
    """Tokens of version words-1: runs without white space. A null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def alnum_count(text: Column) -> Column:
    """Tokens of version alnum-1: runs of ASCII letters and digits. A null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[A-Za-z0-9]+")), F.lit(0)).cast("long")


def _delta(docs: DataFrame, tokenizer: str, n_docs: int, tokens: Column, source: str, lang: str) -> DataFrame:
    return docs.select(F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(n_docs).cast("long").alias("docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def inserted(docs: DataFrame, tokens: Column, tokenizer: str, source: str = "source", lang: str = "lang") -> DataFrame:
    return _delta(docs, tokenizer, 1, tokens, source, lang)


def deleted(docs: DataFrame, tokens: Column, tokenizer: str, source: str = "source", lang: str = "lang") -> DataFrame:
    """Takes away what the documents had added: `tokens` must be the count that the rollup holds for them."""
    return _delta(docs, tokenizer, -1, -tokens, source, lang)


def revised(docs: DataFrame, old: Column, new: Column, tokenizer: str, source: str = "source", lang: str = "lang") -> DataFrame:
    return _delta(docs, tokenizer, 0, F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0)), source, lang)


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """A store of committed batches in one folder that all executors share. Null sources and languages are groups like others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batches/{quote(batch, safe='')}"

    def _names(self, below: str) -> list[str]:
        """The folders below one of the store's, a driver-side list of names."""
        root = self._at(f"{self.path}/{below}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def committed(self) -> list[str]:
        """The folders of the batches that count."""
        return [f"{self.path}/batches/{n}" for n in self._names("batches")]

    def _newest(self) -> str | None:
        """The folder of the newest snapshot that was written whole; its name counts up."""
        names = self._names("snapshots")
        return f"{self.path}/snapshots/{names[-1]}" if names else None

    def _parts(self) -> tuple[str | None, list[str], list[str]]:
        """(newest snapshot, names of the batches in it, names of those outside)."""
        newest = self._newest()
        inside = [r["batch"] for r in self.spark.read.parquet(f"{newest}/names").collect()] if newest else []
        known = set(inside)
        return newest, inside, [n for n in self._names("batches") if n not in known]

    def compact(self) -> bool:
        """Writes the totals so far as a snapshot; False if no batch is outside the newest one. Batches stay, so replays are still told.

        Like a commit it is one rename. Two runs at once that count to the same number leave one snapshot; both hold
        what they name, so either is right.
        """
        import uuid

        newest, inside, outside = self._parts()
        if not outside:
            return False
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        summed(self._read(newest, outside)).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(n,) for n in [*inside, *outside]], "batch string").write.parquet(f"{staged}/names")
        number = int(newest.rsplit("/", 1)[1]) + 1 if newest else 1
        return self._placed(staged, f"{self.path}/snapshots/{number:012d}")

    def _placed(self, staged: str, target: str) -> bool:
        """The staged folder under its final name; False, and it is gone, if that name is taken."""
        at, own = self._at(target), self._at(staged)
        self._fs.mkdirs(at.getParent())
        if self._fs.exists(at) or not self._fs.rename(own, at):
            self._fs.delete(own, True)  # another run was first
            return False
        inner = self._at(f"{target}/{own.getName()}")
        if self._fs.exists(inner):  # the name appeared between the check and the rename, and the folder went into it
            self._fs.delete(inner, True)
            return False
        return True

    def _read(self, snapshot: str | None, names: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        folders = [*([f"{snapshot}/totals"] if snapshot else []), *(f"{self.path}/batches/{n}" for n in names)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Adds the sum of the changes under the batch's name; False, and nothing is done, if that name is committed already."""
        if self._fs.exists(self._at(self._folder(batch))):
            return False
        import uuid

        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        summed(reduce(DataFrame.unionByName, changes)).write.parquet(staged)
        return self._placed(staged, self._folder(batch))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of all committed batches; groups without documents and tokens are left out."""
        newest, _, outside = self._parts()
        return summed(self._read(newest, outside)).where("docs <> 0 or tokens <> 0")
