"""Joins of a corpus with what is decided about its row numbers, without moving texts.

Decisions (dropped, taken so often) become bitmaps: one bit, or a few, for each row number,
``BITS`` numbers to a bitmap.  They are broadcast to the scan while there are at most
``BROADCAST_BITMAPS`` of them (64 MB, half a billion rows); beyond that the rows themselves
are joined by a shuffle.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.scratch import materialize

#: Row number column that operators add to a corpus; no column of a corpus has this name.
RID = "__sf_rid"
#: Decision about a row: a number, 0 where there is none.
MARK = "__sf_mark"
#: Row numbers of one bitmap of ``bitmap_construct_agg``: 4096 bytes.
BITS = 15
#: Bitmaps up to which they are broadcast.
BROADCAST_BITMAPS = 1 << 14


#: What a plan may hold above one scan of Parquet files for its rows to keep their places there.
_PLACED = re.compile(r"^[\s+:*()\d-]*(FileScan parquet|Scan parquet|ColumnarToRow|Filter|Project|WholeStageCodegen|InputAdapter)\b")
_DRAWN = re.compile(r"\b(rand|randn|uuid|shuffle|monotonically_increasing_id)\b", re.IGNORECASE)
#: Rows of a file at most, as a power of two.
FILE_BITS = 40


def steady(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows are those of Parquet files (filtered or projected), else a written copy."""
    plan = docs._jdf.queryExecution().executedPlan().toString().strip().splitlines()
    stored = all(_PLACED.match(line) for line in plan) and "FileScan parquet" in plan[-1] and not any(_DRAWN.search(line) for line in plan)
    return docs if stored else materialize(docs, "numbered")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` (``steady``) with ``RID``: the place of a row's file among the files by name, and its place in the file.

    It is the same in every read, however the files are split: with more or fewer executors, or another split size.
    """
    if RID in docs.columns:
        raise ValueError(f"a corpus must not have a column {RID}")
    name, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    paths = sorted(r[0] for r in docs.select(name).distinct().collect())  # a name for each file
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), "__sf_file bigint, __sf_path string")
    rows = docs.select("*", name.alias("__sf_name"), place.alias("__sf_place"))
    number = F.shiftleft("__sf_file", FILE_BITS) + F.col("__sf_place")
    return rows.join(F.broadcast(files), F.col("__sf_name") == F.col("__sf_path")).select(*docs.columns, number.alias(RID))


def _bit(bitmap: Column, place: Column) -> Column:
    """A bit of a bitmap, 0 where there is no bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7))).cast("int"), F.lit(0))


def marked(docs: DataFrame, marks: DataFrame, top: int = 1) -> DataFrame:
    """docs with ``MARK``: that of marks(RID, MARK) from 1 to ``top``, and 0 for rows without one."""
    marks = materialize(marks.select(RID, F.col(MARK).cast("int").alias(MARK)), "marks")
    place = F.col(RID).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    digits = range(top.bit_length())
    each = [F.bitmap_construct_agg(F.when(F.getbit(MARK, F.lit(k)) == 1, place)).alias(f"__sf_bits{k}") for k in digits]
    maps = materialize(marks.groupBy(F.shiftright(RID, BITS).alias("__sf_bucket")).agg(*each), "bitmaps")
    if maps.count() * len(digits) > BROADCAST_BITMAPS:
        return docs.join(marks, RID, "left").select(*docs.columns, F.coalesce(MARK, F.lit(0)).alias(MARK))
    mark = reduce(lambda total, k: total + F.shiftleft(_bit(F.col(f"__sf_bits{k}"), place), k), digits, F.lit(0))
    found = docs.withColumn("__sf_bucket", F.shiftright(RID, BITS)).join(F.broadcast(maps), "__sf_bucket", "left")
    return found.select(*docs.columns, mark.alias(MARK))


def without(docs: DataFrame, losers: DataFrame) -> DataFrame:
    """docs without the rows that losers(RID) names."""
    return marked(docs, losers.withColumn(MARK, F.lit(1))).where(F.col(MARK) == 0)
