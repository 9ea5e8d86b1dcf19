"""Order statistics of all replicates at once, for panels of any size.

The panel is ranked once and cut into cells of consecutive ranks.  A task counts and sums the values of its units by
cell, weighs them for all replicates by one matrix product, and passes a histogram for each replicate on.
The summed histograms say for each replicate which cell holds each rank that its estimator needs, and
what lies before it; only the rows of those cells are read again, and each cell answers the replicates
that ask for it.  What is moved is the panel once to be ranked, its counts by unit and cell, and those rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.leave_out import Form
from stratafold.operators.multiplicity import AT_ONCE, ITSELF, UNIT, WITHIN, weights
from stratafold.operators.ranks import ranked
from stratafold.scratch import materialize

#: Cells of a policy at least, and rows of a cell at most.
CELLS = 64
CELL_ROWS = 1 << 20
#: Replicates whose histograms meet in one group.
BLOCK = 8
#: Unit and cell counts that a task weighs together.
GATHERED = 1 << 16


def replicates(rows: DataFrame, policies: Sequence[str], form: Form, seed: int, n_resamples: int, streams: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, b, policy_id, estimate), null where a policy has no value.  rows: keys, ``UNIT`` (and ``WITHIN``), policy_id, value (finite)."""
    spark = rows.sparkSession
    counters = [c for c in (*UNIT, *WITHIN) if c in rows.columns]
    places, estimate = form
    # A group's policy is a policy of its own here: draws are numbered within the group.
    groups = [tuple(r) for r in rows.select(*keys).distinct().collect()] if keys else [()]
    named = [(f"{g}|{k}", *group, p, k) for g, group in enumerate(groups) for k, p in enumerate(policies)]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*keys, "policy_id")]
    names = F.broadcast(spark.createDataFrame(named, ", ".join(["__name string", *kinds, "__stream bigint"])))
    own = rows.join(names.drop("__stream"), [*keys, "policy_id"]).withColumn("policy_id", F.col("__name")).drop(*keys, "__name")
    stream_of = {n[0]: streams[0 if len(streams) == 1 else n[-1]] for n in named}
    policies = [n[0] for n in named]
    order = ranked(own, ["policy_id"], "value", counters).withColumnRenamed("__rank", "rank")
    cells = F.greatest(F.lit(CELLS), F.ceil(F.col("__n") / CELL_ROWS))
    order = materialize(order.withColumn("cell", F.floor((F.col("rank") - 1) * cells / F.col("__n"))), "histogram-ranks")
    sizes = {r["policy_id"]: r["n"] for r in order.groupBy("policy_id").agg((F.max("cell") + 1).alias("n")).collect()}  # a row for each policy
    numbers = np.arange(ITSELF, n_resamples)
    starts = dict(zip(policies, np.cumsum([0, *(sizes.get(p, 0) for p in policies[:-1])]).tolist(), strict=True))
    width = sum(sizes.values())

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, len(numbers), width))
        for table in frames:
            for p in policies:
                part = table[table["policy_id"] == p]
                for at in range(0, len(part), GATHERED):
                    mine = part.iloc[at : at + GATHERED]
                    place = starts[p] + mine["cell"].to_numpy()
                    leaf = mine.groupby(counters, sort=False).ngroup().to_numpy()
                    leaves = mine[counters].iloc[np.unique(leaf, return_index=True)[1]]
                    step = max(1, AT_ONCE // len(mine))
                    cut = np.argsort(place, kind="stable")
                    first = np.flatnonzero(np.concatenate(([True], np.diff(place[cut]) > 0)))
                    for b in range(0, len(numbers), step):
                        w = weights(seed, stream_of[p], numbers[b : b + step], leaves)[:, leaf[cut]]
                        for k, c in enumerate(("n", "s")):
                            total[k][b : b + step, place[cut][first]] += np.add.reduceat(w * mine[c].to_numpy()[cut], first, axis=1)
        for at in range(0, len(numbers), BLOCK):
            yield pd.DataFrame({"block": [at // BLOCK], "counts": [total[0][at : at + BLOCK].tobytes()], "sums": [total[1][at : at + BLOCK].tobytes()]})

    counted = order.groupBy(*counters, "policy_id", "cell").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("s"))
    partial = counted.mapInPandas(weigh, "block bigint, counts binary, sums binary")

    def add(group: pd.DataFrame) -> pd.DataFrame:
        block = numbers[int(group["block"].iloc[0]) * BLOCK :][:BLOCK]
        counts, sums = (sum(np.frombuffer(x, float) for x in group[c]).reshape(len(block), width) for c in ("counts", "sums"))
        made = [pd.DataFrame({"b": block, "policy_id": p, "counts": list(counts[:, starts[p] : starts[p] + sizes[p]]), "sums": list(sums[:, starts[p] : starts[p] + sizes[p]])}) for p in policies if p in sizes]
        return pd.concat(made, ignore_index=True)

    hist = partial.groupBy("block").applyInPandas(add, "b bigint, policy_id string, counts array<double>, sums array<double>")
    n = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    at = places(F.col("n"))
    looks = hist.withColumn("n", n.cast("bigint")).select("b", "policy_id", "counts", "sums", "n", F.posexplode(F.array(*(x.cast("bigint") for x in at))).alias("look", "rank"))
    looks = looks.where("n > 0").mapInPandas(_cells, "b bigint, policy_id string, n bigint, look int, cell bigint, left double, before double")
    looks = materialize(looks, "histogram-looks")
    cell = ["policy_id", "cell"]

    def answer(key: tuple, values: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"b": [], "policy_id": [], "n": [], "look": [], "value": [], "total": []})
        values = values.sort_values("rank")
        x = values["value"].to_numpy(float)
        leaf = values.groupby(counters, sort=False).ngroup().to_numpy() if len(values) else np.zeros(0, np.int64)
        leaves = values[counters].iloc[np.unique(leaf, return_index=True)[1]]
        found, total = np.full(len(asked), np.nan), asked["before"].to_numpy(float).copy()
        need = asked["left"].to_numpy(float)
        for b, which in asked.reset_index(drop=True).groupby("b").groups.items():
            if not len(values):
                continue
            w = weights(seed, stream_of[key[0]], np.array([b]), leaves)[0][leaf]
            reach, sums = np.cumsum(w), np.cumsum(w * x)
            for i in which:
                if need[i] <= 0:
                    continue
                k = int(np.searchsorted(reach, need[i]))
                found[i] = x[k]
                total[i] += sums[k] - (reach[k] - need[i]) * x[k]
        return pd.DataFrame({"b": asked["b"].to_numpy(), "policy_id": key[0], "n": asked["n"].to_numpy(), "look": asked["look"].to_numpy(), "value": found, "total": total})

    wanted = looks.select(*cell).distinct()
    near = order.join(F.broadcast(wanted), cell, "left_semi").select(*cell, *counters, "rank", "value")  # at most two rows for each replicate and policy
    told = near.groupBy(*cell).cogroup(looks.groupBy(*cell)).applyInPandas(answer, "b bigint, policy_id string, n bigint, look int, value double, total double")
    pick = lambda c, k: F.max(F.when(F.col("look") == k, F.nanvl(F.col(c), F.lit(None).cast("double"))))
    v, s = ([pick(c, k) for k in (0, 1)] for c in ("value", "total"))
    each = told.groupBy("b", "policy_id", "n").agg(estimate(F.col("n"), v, s).alias("estimate"))
    whole = spark.range(ITSELF, n_resamples).withColumnRenamed("id", "b").crossJoin(names)  # replicates times policies
    told = each.select("b", F.col("policy_id").alias("__name"), "estimate")
    return whole.join(told, ["b", "__name"], "left").select(*keys, "b", "policy_id", "estimate")


def _cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cell that holds each rank, how far into it the rank lies, and the sum of the values before the cell."""
    for table in frames:
        made = []
        for counts, sums, rank in zip(table["counts"], table["sums"], table["rank"], strict=True):
            reach = np.cumsum(counts)
            cell = int(np.searchsorted(reach, rank)) if rank > 0 else 0
            made.append((cell, rank - (reach[cell - 1] if cell else 0.0), float(np.sum(sums[:cell]))))
        cell, left, before = (np.array(c) for c in zip(*made, strict=True)) if made else (np.zeros(0),) * 3
        yield table[["b", "policy_id", "n", "look"]].assign(cell=cell.astype(np.int64), left=left.astype(float), before=before.astype(float))
