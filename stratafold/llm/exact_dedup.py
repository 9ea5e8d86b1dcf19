"""Exact duplicate removal with a heavy-hitter split.

One pass digests every text.  A Misra-Gries style frequent-items sketch
(``approx_top_k``: mergeable, a fixed number of counters) names digests that may
be very frequent; an exact aggregate over those few digests verifies their size
and winner, and at most ``HEAVY`` verified rows are broadcast, so rows of hot
groups are decided map-side and never meet in one task.  All other digests, of
at most ``rows / HEAVY`` rows each, go through an ordinary shuffle: groups of two
and more are aggregated with map-side maxima and counts and joined back, a join whose
large keys are split at run time.

Defined results: a null text counts as the empty text; of equal texts the row
with the largest ``doc_id`` stays (a null id is smallest, and of rows repeating
both id and text exactly one stays); an empty table gives an empty result; other
columns are ignored by ``exact_duplicates`` and carried by ``drop_exact_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.joins import RID, numbered, steady, without
from stratafold.scratch import materialize

#: Verified heavy digests that are broadcast at most, and counters of the sketch.
HEAVY = 256
COUNTERS = 4096


def _decided(rows: DataFrame) -> DataFrame:
    """rows(doc_id, digest, rid) -> with winner (struct doc_id, rid) and group size."""
    ident = F.struct("doc_id", "rid")
    found = rows.agg(F.expr(f"approx_top_k(hex(digest), {HEAVY}, {COUNTERS})").alias("top"))
    suspects = found.select(F.explode("top").alias("t")).where("t.count > 1").select(F.unhex("t.item").alias("digest"))
    heavy = (
        rows.join(F.broadcast(suspects), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(ident).alias("winner"), F.count("*").alias("group_size"))
    )
    heavy = materialize(heavy, "dedup-heavy")
    split = rows.join(F.broadcast(heavy), "digest", "left")
    hot = split.where(F.col("group_size").isNotNull())
    cold = split.where(F.col("group_size").isNull()).select("doc_id", "rid", "digest")
    groups = cold.groupBy("digest").agg(F.max(ident).alias("winner"), F.count("*").alias("group_size")).where("group_size > 1")
    alone = {"winner": F.coalesce("winner", ident), "group_size": F.coalesce("group_size", F.lit(1).cast("bigint"))}
    cold = cold.join(groups, "digest", "left").withColumns(alone)
    return hot.select(cold.columns).unionByName(cold)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("rid"),
    )
    done = _decided(materialize(digests, "dedup-digests"))
    return done.select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("winner.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    docs = steady(docs)
    rows = numbered(docs)
    digests = rows.select(
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
        F.col(RID).alias("rid"),
    )
    done = _decided(materialize(digests, "dedup-digests"))
    losers = done.where(F.col("rid") != F.col("winner.rid")).select(F.col("rid").alias(RID))
    return without(rows, losers).select(docs.columns)
