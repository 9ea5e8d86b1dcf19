"""Which columns determine which, for any number of columns in one scan.

Every row stands once for each of its columns; rows of one column and value are added up, map-side first, so what is
shuffled is a row for each value and task.  A column determines another if each of its values meets one value of the
other, seen by the extremes of two 64-bit hashes: fixed-width, so that a hash aggregate serves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Determined:
    """Of one column: its values, rows of the rarest, and by other column whether each value has one (None: they never meet)."""

    values: int
    least: int | None
    by: dict[str, bool | None]


def _hashes(c: Column) -> tuple[Column, Column]:
    text = c.cast("string")
    return F.when(text.isNotNull(), F.xxhash64(text)), F.when(text.isNotNull(), F.xxhash64(text, F.lit(1)))


def dependencies(rows: DataFrame, columns: Sequence[str], ranges: dict[str, tuple[str, str]] | None = None) -> dict[str, Determined]:
    """For each of the columns what it determines among the others.  Null is no value.

    ranges: further things to be determined, of which a row holds the least and the largest value, in two columns.
    """
    names = list(dict.fromkeys(columns))
    found = grouped_dependencies(rows.withColumn("__all", F.lit("all")), names, "__all", ranges)
    return found.get("all", {c: Determined(0, None, dict.fromkeys([*names, *(ranges or {})])) for c in names})


def grouped_dependencies(rows: DataFrame, columns: Sequence[str], group: str, ranges: dict[str, tuple[str, str]] | None = None) -> dict[str, dict[str, Determined]]:
    """``dependencies`` within each group of rows, still in one scan."""
    names = list(dict.fromkeys(columns))
    ranges = ranges or {}
    held = [F.struct(*(h.alias(f"h{m}") for m, h in enumerate(_hashes(F.col(c))))).alias(f"c{k}") for k, c in enumerate(names)]
    spans = [F.col(x).alias(f"r{k}_{end}") for k, pair in enumerate(ranges.values()) for end, x in zip(("low", "high"), pair, strict=True)]
    keys = F.array(*(F.struct(F.lit(k).alias("column"), F.col(c).cast("string").alias("value")) for k, c in enumerate(names)))
    each = rows.select(F.col(group).alias("group"), F.explode(keys).alias("key"), *held, *spans).where("key.value is not null")
    facts = [F.count("*").alias("n")]
    for k in range(len(names)):
        facts.append(F.count(f"c{k}.h0").alias(f"met{k}"))
        facts += [(F.min(f"c{k}.h{m}") != F.max(f"c{k}.h{m}")).alias(f"many{k}_{m}") for m in (0, 1)]
    for k in range(len(ranges)):
        facts += [F.count(f"r{k}_low").alias(f"range_met{k}"), (F.min(f"r{k}_low") != F.max(f"r{k}_high")).alias(f"range_many{k}")]
    by = each.groupBy("group", "key.column", "key.value").agg(*facts)
    over = [F.count("*").alias("values"), F.min("n").alias("least")]
    for k in range(len(names)):
        over += [F.max(F.col(f"met{k}") > 0).alias(f"met{k}"), F.max(F.coalesce(F.col(f"many{k}_0") | F.col(f"many{k}_1"), F.lit(False))).alias(f"many{k}")]
    for k in range(len(ranges)):
        over += [F.max(F.col(f"range_met{k}") > 0).alias(f"range_met{k}"), F.max(F.coalesce(F.col(f"range_many{k}"), F.lit(False))).alias(f"range_many{k}")]
    out: dict[str, dict[str, Determined]] = {}
    for r in by.groupBy("group", "column").agg(*over).collect():  # a row for each group and column
        told = {other: (not r[f"many{m}"] if r[f"met{m}"] else None) for m, other in enumerate(names)}
        told |= {other: (not r[f"range_many{m}"] if r[f"range_met{m}"] else None) for m, other in enumerate(ranges)}
        own = out.setdefault(r["group"], {c: Determined(0, None, dict.fromkeys([*names, *ranges])) for c in names})
        own[names[r["column"]]] = Determined(r["values"], r["least"], told)
    return out


def distinct_counts(rows: DataFrame, by: Sequence[str], columns: Sequence[str], facts: dict[str, Column] | None = None, flag: Column | None = None) -> DataFrame:
    """by, rows, n0, n1, ...: distinct values of each column, exact, null not counted; f_NAME: sums of facts; flagged: values of the first column with the flag.

    Each row stands once for each column and is added up by (by, column, value), so no row is copied whole, and
    several distinct counts need one shuffle of values.
    """
    facts = facts or {}
    keys = F.array(*(F.struct(F.lit(k).alias("column"), F.col(c).cast("string").alias("value")) for k, c in enumerate(columns)))
    first = F.col("key.column") == 0
    each = rows.select(*by, F.explode(keys).alias("key"), *(f.alias(f"f_{n}") for n, f in facts.items()), *([flag.alias("flag")] if flag is not None else []))
    inner = each.groupBy(*by, "key.column", "key.value").agg(
        F.count("*").alias("rows"), *(F.sum(F.when(first, F.col(f"f_{n}"))).alias(f"f_{n}") for n in facts), *([F.max("flag").alias("flag")] if flag is not None else [])
    )
    first, known = F.col("column") == 0, F.col("value").isNotNull()
    return inner.groupBy(*by).agg(
        F.sum(F.when(first, F.col("rows"))).alias("rows"), *(F.count_if((F.col("column") == k) & known).alias(f"n{k}") for k in range(len(columns))),
        *(F.coalesce(F.sum(f"f_{n}"), F.lit(0)).alias(f"f_{n}") for n in facts), *([F.count_if(first & known & F.col("flag")).alias("flagged")] if flag is not None else []),
    )
