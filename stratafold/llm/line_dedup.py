"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

Every line long enough to count becomes a hash (128 bits of SHA-256 of its key).  Documents come
in batches by falling id.  A batch is reduced to one row for each hash (documents that hold it
and the largest of them), loses by merge-anti-joins with the runs what they have settled already (enough documents, and
none of the batch after the run's), and is written as a run of its own: a table bucketed and sorted by hash, so
that joining it moves nothing.  ``FAN`` runs of a level are compacted to one run of the next.
Adding a batch touches that batch and at most ``FAN`` runs a level, never the lines of earlier ones.

Lines whose key the merged runs condemn are then looked up in all documents: the hashes of the
most frequent lines, at most ``HEAVY``, are broadcast, the others joined by an ordinary shuffle.

Defined results: a null text counts as empty, which is one empty line; a document is its id, so rows that
repeat an id count once and all of them keep a line if that id is the largest; a null id is an id, less than all
others; an empty table gives an empty result; other columns are ignored by ``line_digests`` and
carried by ``drop_common_lines``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.scratch import materialize, shared_root

#: Keys shorter than this, in code points, and keys in fewer documents stay.
LEAST_LENGTH = 20
LEAST_DOCS = 3
#: Batches of one table, and runs of a level that are compacted together.
BATCHES = 8
FAN = 4
#: Hashes that are broadcast at most, and counters of the sketch that finds them.
HEAVY = 256
COUNTERS = 4096

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def line_hashes(docs: DataFrame, batch: Column, least: int = LEAST_LENGTH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, place, key, batch for lines whose key is long enough."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), batch.alias("batch"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    keys = lines.select("doc_id", "text_hash", "place", line_key(F.col("line")).alias("key"), "batch").where(F.char_length("key") >= least)
    return keys.withColumn("key", F.unhex(F.substring(F.sha2("key", 256), 1, 32)))


def counted(lines: DataFrame) -> DataFrame:
    """One row per key: key, top (largest id that holds it), n_docs."""
    each = lines.groupBy("key", "doc_id").agg(F.lit(1).alias("__one"))
    return each.groupBy("key").agg(F.max("doc_id").alias("top"), F.count("*").alias("n_docs"))


class LineRuns:
    """Levelled sorted runs of (key, top, n_docs).  Batches must not share a document."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fan: int = FAN) -> None:
        self.spark, self.least_docs, self.fan = spark, least_docs, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _path(self, name: str) -> str:
        return f"{shared_root(self.spark)}/{name}"

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", self._path(name)).saveAsTable(name)
        return name

    def _merge(self, names: list[str]) -> DataFrame:
        # Read as plain files: a union of bucketed tables claims a partitioning that its scans need not keep.
        runs = self.spark.read.schema("key binary, top bigint, n_docs bigint").parquet(*map(self._path, names))
        return runs.groupBy("key").agg(F.max("top").alias("top"), F.sum("n_docs").alias("n_docs"))

    def add(self, batch: DataFrame) -> None:
        """batch: key, top, n_docs, a row for each key."""
        fresh = batch.select("key", F.col("top").cast("bigint").alias("top"), "n_docs")
        for name in [n for level in self.levels for n in level]:
            run = self.spark.table(name).select(F.col("key").alias("__key"), F.col("top").alias("__top"), F.col("n_docs").alias("__n"))
            settled = (F.col("key") == F.col("__key")) & (F.col("__n") >= self.least_docs) & (F.col("top").isNull() | (F.col("__top") >= F.col("top")))
            fresh = fresh.join(run.hint("merge"), settled, "left_anti")
        self._put(0, self._write(fresh))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(self._merge(full))
            self._forget(full)
            self._put(level + 1, merged)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def common(self) -> DataFrame:
        """key and top of keys that enough documents hold."""
        names = [n for level in self.levels for n in level]
        return self._merge(names).where(F.col("n_docs") >= self.least_docs).select("key", "top")

    def close(self) -> None:
        """Forgets the runs; their files go with the other scratch tables."""
        self._forget([n for level in self.levels for n in level])
        self.levels = []


def batch_number(docs: DataFrame, batches: int) -> Column:
    """0 for the largest ids of docs(doc_id), and so on; each id is in one batch, null in the last."""
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    return reduce(lambda total, cut: total + F.when(F.col("doc_id") > cut, 0).otherwise(1), sorted(set(cuts)), F.lit(0))


def common_places(docs: DataFrame, least_docs: int = LEAST_DOCS, least: int = LEAST_LENGTH, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, gone: numbers of the lines that go, for documents that lose any."""
    spark = docs.sparkSession
    lines = materialize(line_hashes(docs, batch_number(docs, batches), least), "line-hashes")
    runs = LineRuns(spark, least_docs, fan)
    try:
        for k in range(batches):
            runs.add(counted(lines.where(F.col("batch") == k)))
        common = materialize(runs.common(), "line-common")
    finally:
        runs.close()
    frequent = lines.agg(F.expr(f"approx_top_k(hex(key), {HEAVY}, {COUNTERS})").alias("top"))
    suspects = frequent.select(F.explode("top").alias("t")).select(F.unhex("t.item").alias("key"))
    heavy = F.broadcast(materialize(common.join(F.broadcast(suspects), "key", "left_semi"), "line-heavy"))
    hot = lines.join(heavy, "key")
    cold = lines.join(heavy, "key", "left_anti").join(common, "key")
    gone = hot.unionByName(cold).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("gone"))


def without_common_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least: int = LEAST_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (docs' columns), doc_id, text (the lines that stay; empty for null), n_lines, n_dropped."""
    whole = F.coalesce(F.col(text), F.lit(""))
    places = common_places(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), least_docs, least)
    places = places.select(F.col("doc_id").alias("same_id"), F.col("text_hash").alias("same_hash"), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("doc_id"), F.split(whole, "\n").alias("lines"), F.xxhash64(whole).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("same_id")) & (F.col("text_hash") == F.col("same_hash"))
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    joined = rows.join(places, same, "left").withColumn("stay", F.when(F.col("gone").isNotNull(), F.array_except(numbers, "gone")))
    kept = F.coalesce(F.transform("stay", lambda i: F.get("lines", i)), F.col("lines"))
    n_lines = F.size("lines").cast("bigint")
    return joined.select("row", "doc_id", F.array_join(kept, "\n").alias("text"), n_lines.alias("n_lines"), F.coalesce(n_lines - F.size("stay"), F.lit(0)).cast("bigint").alias("n_dropped"))


def drop_common_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least: int = LEAST_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines that stay as its text, all columns kept; a null text stays null."""
    done = without_common_lines(docs, least_docs, least, doc_id, text)
    return done.select(*(F.when(F.col("row")[c].isNotNull(), F.col("text")).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def line_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    done = without_common_lines(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
