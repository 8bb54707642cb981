"""Token counts as delta-maintained rollups.

A rollup is a folder of committed batches. Each batch holds signed sums by source, language and tokenizer version: an
insert adds, a delete takes away, a revision takes the old count away and adds the new one. Totals are the sum over all
committed batches; nothing is recounted when documents change.

A batch is written beside the rollup and moved into place with one rename, under its own name. A batch whose name is there already is
not applied again, so a retried or repeated commit changes nothing, and a job that dies before the rename leaves nothing
behind that counts. Sums are made before the shuffle, so a source with a third of all rows costs one row a task.

Defined results: null texts and texts without tokens count as documents of 0 tokens; null source or language is a group of its own; repeated
rows each count; a delete of something never inserted gives negative totals, which is the caller's error and is shown, not hidden.
Groups whose sums are all 0 are left out. Empty batches commit and add nothing. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words_bpe

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counted(docs: DataFrame, path: str, version: str, text: str = "text") -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words_bpe.load(path)
        for b in batches:
            n = [np.diff(at) for *_, at in coder.encode(b.column(3))]
            yield pa.record_batch([*b.columns[:3], pa.array(np.concatenate(n) if n else np.zeros(0), pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(of, "doc_id long, source string, lang string, n_tokens long").withColumn("tokenizer", F.lit(version))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """From counts before and after: the documents may change source, language, tokenizer or count."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        at = self._path(f"{self.folder}/batches")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Applies signed deltas (SCHEMA) once under the name batch; False if that batch is there already."""
        if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", batch):
            raise ValueError("a batch is named with letters, digits, '.', '_' and '-'")
        place = self._path(f"{self.folder}/batches/{batch}")
        if self._fs.exists(place):
            return False
        draft = f"{self.folder}/drafts/{batch}-{uuid.uuid4().hex}"
        deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(draft)
        self._fs.mkdirs(place.getParent())
        if not self._fs.exists(place) and self._fs.rename(self._path(draft), place):
            if not self._fs.exists(self._path(f"{place.toString()}/{self._path(draft).getName()}")):
                return True
            self._fs.delete(self._path(f"{place.toString()}/{self._path(draft).getName()}"), True)  # another commit of this batch came first
        self._fs.delete(self._path(draft), True)
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/batches/{b}" for b in names])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which all machines share; one of our own where it is unset, as in tests."""
    import tempfile

    sc = spark.sparkContext
    top = sc._jsc.sc().getCheckpointDir()
    top = top.get() if top.isDefined() else spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestat-")
    return f"{top}/{name}-{uuid.uuid4().hex}"
