"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: its weight's share of all words,
at most ``CAP`` times its own size, the excess reshared by weight until none is
above its cap.  A document is expected ``target / source size`` times.  Expected
copies are prefix-summed within the source, shifted by one random offset, and the
document is emitted once per integer boundary crossed.

Within a source, documents are ordered by size, so neighbours are alike and the
words taken miss the target by no more than about one large document.  The order
comes from a range partitioning over (source, size, doc_id): a hot source spreads
over many tasks, each task ranks its own rows, and only row counts per (task,
source) are added up.  The water-filling runs over one row per source.

Defined results: null text has size 0; a null source is a source of its own, last
in the order; a source of size 0 has target 0 and its documents are taken 0 words;
rows repeating id and size are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.joins import MARK, RID, marked, numbered, steady
from stratafold.scratch import materialize

#: Weights repeat over the sources in code-point order.
WEIGHTS = (1, 2, 3)
#: No source, and no document, is taken more often.
CAP = 3
#: A word: fixed by the size's definition.
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words of a text as bigint, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size) -> with target and rate, one row per source.

    Water-filling: sources ordered by cap per weight; those whose cap lies below the
    common level are capped, and the level is fixed by what the others must share.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    weight_of = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    filled = (
        sizes.withColumn("weight", weight_of.cast("bigint"))
        .withColumn("fill", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
        .withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(cap * F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        # The first source not below its cap fixes the level for itself and all after it.
        .withColumn("open", F.col("fill") >= F.col("level"))
        .withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_fill))
    )
    target = F.when(F.col("final").isNull(), (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("final"))
    target = F.least(target, (cap * F.col("source_size")).cast("double"))
    return filled.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def _copies(rate: Column, rank: Column, offset: Column) -> Column:
    return (F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)).cast("bigint")


def sampled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, weights: Sequence[int] = WEIGHTS, cap: int = CAP, rid: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies (and rid)."""
    extra = [F.col(rid).alias("rid")] if rid else []
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), *extra)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialize(materialize(sized, "mix-sizes").repartitionByRange(n, "source", "size", "doc_id").withColumn("part", F.spark_partition_id()), "mix-order")
    parts = ordered.groupBy("part", "source").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("rows").over(ahead), F.lit(0)))
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))), 1, 5), 16, 10)
    offset = (u.cast("double") + 0.5) / float(1 << 20)
    facts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.part", F.col("p.source").alias("source"), "ahead", "source_size", "target", "rate")
    facts = materialize(facts.withColumn("offset", offset), "mix-targets")
    local = Window.partitionBy("part", "source").orderBy("size", "doc_id")
    ranked = ordered.withColumn("rank", F.row_number().over(local))
    o, f = ranked.alias("o"), facts.alias("f")
    joined = o.join(f, (F.col("o.part") == F.col("f.part")) & F.col("o.source").eqNullSafe(F.col("f.source")))
    copies = _copies(F.col("rate"), F.col("rank") + F.col("ahead"), F.col("offset"))
    return joined.select("o.doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *(["o.rid"] if rid else []))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: rows of ``docs`` repeated as often as they are taken, all columns kept."""
    docs = steady(docs)
    rows = numbered(docs)
    takes = sampled(rows, doc_id, text, source, seed, weights, cap, RID).where("copies > 0")
    takes = marked(rows, takes.select(F.col("rid").alias(RID), F.col("copies").alias(MARK)), cap).where(F.col(MARK) > 0)
    return takes.withColumn(MARK, F.explode(F.sequence(F.lit(1), F.col(MARK)))).select(docs.columns)
