"""Reading and writing record tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, NumericType, StringType

from stratafold.schema import spark_type

#: Texts that stand for a missing value in delimited files.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
FORMATS = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".txt": "csv", ".tsv": "tsv", ".jsonl": "jsonl", ".ndjson": "jsonl"}


@dataclass(frozen=True)
class DataSource:
    """Where records came from; the checksum is of the file's bytes (of a directory's data files, see ``combined``)."""

    path: str
    sha256: str
    rows: int
    format: str
    columns: tuple[str, ...]


#: Files up to this size are digested by executors, each in one row; larger ones stream through the driver's JVM.
ROW_BYTES = 512 << 20


def combined(digests: dict[str, str], algorithm: str = "sha256") -> str:
    """One digest for the files of a directory, by their names below it."""
    lines = "".join(f"{name} {digests[name]}\n" for name in sorted(digests))
    return hashlib.new(algorithm, lines.encode()).hexdigest()


def file_checksum(path: str | Path, algorithm: str = "sha256") -> str:
    """Digest of a local file, or of a directory's data files, read a mebibyte at a time in this process."""
    path = Path(path)

    def of(file: Path) -> str:
        digest = hashlib.new(algorithm)
        with file.open("rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        return digest.hexdigest()

    if path.is_file():
        return of(path)
    return combined({p.relative_to(path).as_posix(): of(p) for p in path.rglob("*") if p.is_file() and not p.name.startswith(("_", "."))}, algorithm)


def _store(spark: SparkSession, path: str | Path) -> tuple:
    """The file system that holds the path, and the whole path there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    store = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, store.makeQualified(found)


def dataset_checksum(spark: SparkSession, path: str | Path) -> str:
    """The same as ``file_checksum``, for any path that Spark reads; executors digest the files."""
    store, root = _store(spark, path)
    sizes, walk = {}, store.listFiles(root, True)
    while walk.hasNext():
        status = walk.next()
        if not status.getPath().getName().startswith(("_", ".")):
            sizes[status.getPath().toString()] = status.getLen()
    small = [f for f, n in sizes.items() if n <= ROW_BYTES]
    digests = {}
    if small:
        files = spark.read.format("binaryFile").load(small).select("path", F.sha2("content", 256).alias("digest"))
        digests = {r["path"]: r["digest"] for r in files.collect()}  # a row for each file
    for f in sizes.keys() - digests.keys():
        stream = store.open(spark._jvm.org.apache.hadoop.fs.Path(f))
        try:
            digests[f] = spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()
    top = root.toString().rstrip("/")
    return digests[top] if top in digests else combined({f.removeprefix(top + "/"): d for f, d in digests.items()})


def _typed(df: DataFrame, name: str) -> Column:
    kind, wanted, column = df.schema[name].dataType, spark_type(name), F.col(f"`{name}`")
    if wanted is None or kind == wanted:
        return column
    if isinstance(wanted, StringType):
        return column.cast("string").alias(name)
    if isinstance(kind, BooleanType | NumericType):
        return column.cast("double").alias(name)
    return F.trim(column.cast("string")).try_cast(DoubleType()).alias(name)


def coerce_types(df: DataFrame) -> DataFrame:
    """Known columns in their types: what is no number becomes null; other columns are left alone."""
    return df.select(*(_typed(df, c) for c in df.columns))


def _broken_lines(spark: SparkSession, path: str) -> list[str]:
    """Files in which a line holds an odd number of quotes: only there may a quoted field go on in the next line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    return [r["file"] for r in lines.where(F.col("quotes") % 2 == 1).select("file").distinct().collect()]  # a name for each file


def _delimited(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Text columns of delimited files.  A pass over the lines tells which files must be read whole; the others are split over tasks."""
    reader = spark.read.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"')
    whole = reader.option("multiLine", True).csv(path)
    broken = _broken_lines(spark, path)
    if not broken:
        return reader.option("multiLine", False).schema(whole.schema).csv(path)
    name = F.col("_metadata.file_path")
    lines = reader.option("multiLine", False).schema(whole.schema).csv(path)
    kept = whole.columns
    return lines.where(~name.isin(broken)).select(kept).unionByName(whole.where(name.isin(broken)).select(kept))


def scan(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table as it is stored.  Delimited files are read as text: 0001 stays 0001, and NA texts are null."""
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "jsonl":
        return spark.read.json(path)
    raw = _delimited(spark, path, "\t" if kind == "tsv" else ",")
    return raw.select(*(F.when(~F.col(f"`{c}`").isin(list(NA_TEXTS)), F.col(f"`{c}`")).alias(c) for c in raw.columns))


def format_of(path: str | Path) -> str:
    suffix = Path(path).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file type {suffix!r}; known: {', '.join(FORMATS)}")
    return FORMATS[suffix]


def load_records(spark: SparkSession, path: str | Path, coerce: bool = True) -> tuple[DataFrame, DataSource]:
    """Records and where they came from; the path may lie in any file system that Spark reads, and relative ones in its default."""
    kind = format_of(path)
    store, where = _store(spark, path)
    if not store.exists(where):
        raise FileNotFoundError(path)
    df = scan(spark, where.toString(), kind)
    if coerce:
        df = coerce_types(df)
    return df, DataSource(str(path), dataset_checksum(spark, path), df.count(), kind, tuple(df.columns))


def write_records(df: DataFrame, path: str | Path, single: bool = False) -> None:
    """Write by suffix; a directory of part files, or one of them as a plain file."""
    kind = format_of(path)
    if kind == "tsv":
        raise ValueError("tables are not written as .tsv")
    store, target = _store(df.sparkSession, path)
    out = (df.coalesce(1) if single else df).write.mode("overwrite")
    where = target.toString() + (".parts" if single else "")
    if kind == "csv":
        out.option("header", True).option("escape", '"').csv(where)
    elif kind == "jsonl":
        out.json(where)
    else:
        out.parquet(where)
    if single:
        parts = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
        part = next(s.getPath() for s in store.listStatus(parts) if s.getPath().getName().startswith("part-"))
        store.delete(target, True)
        store.rename(part, target)
        store.delete(parts, True)
