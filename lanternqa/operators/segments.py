"""A search index that grows: immutable segments, removals, and a log of commits.

Texts that are added become a new segment, of which only they are read. A text
that is removed, or added again, is struck out of the segments before by a small
table of ids. A search sees all live segments as one index; its statistics come
from counts of the segments, so results equal those of an index built anew.

A change is written first and then committed by one row of the log, so a change
that broke off leaves nothing behind that a search could see. One writer at a
time; searches go on beside it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternqa.functions.text import words
from lanternqa.operators.retrieval import CorpusIndex
from lanternqa.session import exists, fits_broadcast

LOG = "no long, kind string, name string"
# Kinds of commits: texts added, texts struck out, and a segment that stands for all before it.
TEXTS, STRUCK, MERGED = "texts", "struck", "merged"


class GrowingIndex:
    """The index at `path` of texts named by a column `doc` of type `doc_type`."""

    def __init__(self, spark: SparkSession, path: str, doc: str = "page_id", doc_type: str = "bigint") -> None:
        self.spark, self.path, self.doc, self.doc_type = spark, path, doc, doc_type

    def commits(self) -> list[tuple[int, str, str]]:
        """The commits that count, in order."""
        log = f"{self.path}/log"
        if not exists(self.spark, log):
            return []
        rows = [tuple(r) for r in self.spark.read.schema(LOG).parquet(log).orderBy("no").collect()]
        merged = [i for i, (_, kind, _) in enumerate(rows) if kind == MERGED]
        return rows[merged[-1] :] if merged else rows

    def _commit(self, kind: str, name: str) -> None:
        log = f"{self.path}/log"
        before = self.spark.read.schema(LOG).parquet(log).agg(F.max("no")).first()[0] if exists(self.spark, log) else None
        row = (0 if before is None else before + 1, kind, name)
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(log)

    def _read(self, name: str, columns: str) -> DataFrame:
        schema = f"`{self.doc}` {self.doc_type}, {columns}" if columns else f"`{self.doc}` {self.doc_type}"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _strike(self, ids: DataFrame) -> None:
        """Strike out the ids that live segments hold."""
        if not self.commits():
            return
        struck = ids.select(F.col(self.doc).cast(self.doc_type).alias(self.doc)).distinct()
        held = self._live("docs", "dl int").join(struck, self.doc, "left_semi").select(self.doc)
        name = f"struck-{uuid.uuid4().hex}"
        held.write.parquet(f"{self.path}/{name}")
        if not self._read(name, "").isEmpty():
            self._commit(STRUCK, name)

    def _live(self, table: str, columns: str) -> DataFrame:
        """The rows of all segments that were not struck out later."""
        out: list[DataFrame] = []
        for _, kind, name in self.commits():
            if kind != STRUCK:
                out.append(self._read(f"{name}/{table}", columns))
                continue
            gone = self._read(name, "")
            gone = F.broadcast(gone) if fits_broadcast(gone) else gone
            out = [rows.join(gone, self.doc, "left_anti") for rows in out]
        if out:
            return reduce(DataFrame.unionByName, out)
        return self.spark.createDataFrame([], T.StructType.fromDDL(f"`{self.doc}` {self.doc_type}, {columns}"))

    def _write_words(self, counted: DataFrame, name: str) -> None:
        """Each file by term, so that a reader of some terms can skip parts of it; no row moves for that."""
        counted.sortWithinPartitions("term", self.doc).write.parquet(f"{self.path}/{name}/words")

    def add(self, corpus: DataFrame) -> None:
        """Add texts (`doc`, text); an id that is there already gets the new text. Rows without id are no texts.

        Only `corpus` and the ids of earlier texts are read.
        """
        # Texts are dealt by id once, and words are counted where a text lies: only texts are moved, not their words.
        texts = corpus.filter(F.col(self.doc).isNotNull()).select(
            F.col(self.doc).cast(self.doc_type).alias(self.doc), F.coalesce("text", F.lit("")).alias("text")
        ).repartition(self.doc)
        rows = texts.select(self.doc, words(F.col("text")).alias("ws"))
        name = f"segment-{uuid.uuid4().hex}"
        # Each text has a row without term, too, which stands for it whatever its words are.
        terms = F.concat(F.array(F.lit(None).cast("string")), "ws")
        counted = rows.select(self.doc, F.size("ws").alias("dl"), F.explode(terms).alias("term"))
        counted = counted.groupBy(self.doc, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        self._write_words(counted, name)
        written = self._read(f"{name}/words", "dl int, term string, tf bigint")
        written.filter("term IS NULL").select(self.doc, "dl").write.parquet(f"{self.path}/{name}/docs")
        self._strike(self._read(f"{name}/docs", "dl int"))
        self._commit(TEXTS, name)

    def remove(self, ids: DataFrame) -> None:
        """Take texts out by id; ids that are not there change nothing."""
        self._strike(ids)

    def merge(self) -> None:
        """Write all that is live as one segment, which stands for those before."""
        name = f"segment-{uuid.uuid4().hex}"
        self._write_words(self._live("words", "dl int, term string, tf bigint"), name)
        self._live("docs", "dl int").write.parquet(f"{self.path}/{name}/docs")
        self._commit(MERGED, name)

    def index(self) -> CorpusIndex:
        """What is live, as one index for searches and keyword rankings."""
        size = self._live("docs", "dl int").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).first()
        live = self._live("words", "dl int, term string, tf bigint").filter("term IS NOT NULL")
        return CorpusIndex(live, size["n"], (size["words"] or 0) / max(size["n"], 1) or 1.0, self.doc)
