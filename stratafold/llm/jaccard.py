"""N-gram Jaccard join by PartEnum signatures.

A document is its set of five-word shingles; two link when their Jaccard similarity
reaches ``percent`` per cent.  Sizes fall into bands whose ends grow by the inverse
threshold, so that linked sets lie in the same or adjacent bands and meet in the band
of the larger one.  For each of its two bands a set signs: the shingle domain is cut
into partitions, and the part of the set in a partition is one signature (the
enumeration of partition subsets with all but one second-level part left out: the cheapest
setting, see ``partitions``).  Sets that differ in at most D shingles agree in all
non-empty partitions but D, so linked sets share at least

    t = non-empty partitions - D(size, band)

signatures, where D follows from the threshold and the sizes.  A set that happens to leave so many partitions
empty that t is 0 has no guarantee; a band that holds one signs shingle by shingle instead, all its
sets alike, where t = size - D is never 0 (``fine``: bands are found by a first pass, which counts).

The search goes by lists: the sets that share a signature, equal lists counted once.  It
never forms all pairs of a list.  A set with fewer than t shared signatures is linked with
nobody and leaves; this removes what only shares a passage.  Each list is first compared with
one pivot, the member that shares most; verified links are contracted, and lists within one
component are done.  Then a set leaves if the other components, by narrow bands of sizes, do
not cover as many of its shingles as a linked set would.  The few that remain find each other
by their rarest shingles: so many that a linked set must have one of them.  This is exact: no
candidate is capped, and nothing is left out that could be linked.

Sets are never shuffled to find candidates.  Signatures travel in blocks of about nine
bytes each, one block per slice of texts and bucket, with the number of buckets following the exact
number of signatures.  Equal sets collapse to one node first: frequent equal sets are
found by a sketch and signed once.  A candidate's size and a 512-bit sketch of its set
rule out most unlinked pairs before sets are joined for the exact test.

Sets are of 64-bit hashes.  A node is the 64-bit hash of its set; a second hash tells sets apart
whose nodes are equal, and all but one of these get nodes of their own (``_apart``), so that
128 bits say which sets are equal.

Defined results: null, empty and blank texts have the empty set, link with nothing and
are their own component; repeated rows and equal texts link; a null id takes part in
links but is never a component's name unless all its ids are null; ties do not arise
(components are named by the least id); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.arrow import map_texts, slices
from stratafold.llm.components import components
from stratafold.llm.joins import RID, numbered, steady, without
from stratafold.llm.shingles import mix, shingle_sets
from stratafold.scratch import materialize

PERCENT = 75
#: Signatures in a bucket of the candidate search.
BUCKET = 500_000
#: Frequent equal sets that are broadcast at most, and counters of their sketch.
HEAVY, COUNTERS = 256, 4096
#: Ids of sets to verify up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Nodes that several sets share, at most; each is a chance in 2^63.
CLASHES = 100_000
#: Nodes of a list in one row.
PART = 64
#: Growth of the narrow size bands.
NARROW = 1.05
#: Longs of a set's sketch.
SKETCH = 8
#: Sets up to this size are signed shingle by shingle.
SINGLE = 24

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BAND = np.uint64(0xD1342543DE82EF95)


def band_ends(percent: int = PERCENT, most: int = 10**9) -> np.ndarray:
    """Largest size of each band; a linked set's size is in the same or the next band."""
    ends = [1]
    while ends[-1] < most:
        ends.append((ends[-1] + 1) * 100 // percent)
    return np.array(ends, np.int64)


def differing(sizes: np.ndarray, ends: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Most shingles in which a set differs from a linked one met in the band that ends there."""
    return np.minimum(sizes * (100 - percent) // percent, (sizes + ends) * (100 - percent) // (100 + percent))


def partitions(ends: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Partitions of the domain in a band, somewhat more than the D of its largest sets; 0: one per shingle."""
    share = 2 * (100 - percent) / (100 + percent)
    return np.where(ends <= SINGLE, 0, np.ceil(1.15 * share * ends + np.sqrt(ends) + 1)).astype(np.uint64)


def signatures(hashes: np.ndarray, sizes: np.ndarray, percent: int = PERCENT, fine: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the row of each, and by row and band the guaranteed number t (2 columns, even and odd bands).

    hashes: ascending within each row.  A signature's lowest bit is its band's.  fine: bands signed shingle by shingle.
    """
    ends = band_ends(percent)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    signs, rows, sure = [], [], np.zeros((len(sizes), 2), np.int64)
    for step in (0, 1):
        band = np.searchsorted(ends, sizes) + step
        count = np.where(np.isin(band, list(fine)), np.uint64(0), partitions(ends[band], percent))[owner]
        part = np.where(count > 0, ((hashes >> np.uint64(32)) * count) >> np.uint64(32), hashes)
        first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])))) if len(owner) else np.zeros(0, np.int64)
        if len(first):
            total = np.add.reduceat(mix(hashes), first) + part[first] * _GOLD + band[owner[first]].astype(np.uint64) * _BAND
            signs.append((mix(total) & ~np.uint64(1)) | (band[owner[first]] & 1).astype(np.uint64))
            rows.append(owner[first])
        filled = np.bincount(owner[first], minlength=len(sizes))
        sure[np.arange(len(sizes)), band & 1] = np.maximum(0, filled - differing(sizes, ends[band], percent))
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (np.concatenate(signs) if signs else empty[0]), (np.concatenate(rows) if rows else empty[1]), sure


def nodes_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each set as a signed long; 0 for the empty set."""
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = mix(np.add.reduceat(mix(hashes ^ _GOLD), starts) + sizes[full].astype(np.uint64) * _BAND) | np.uint64(1)
    return out.view(np.int64)


def checks_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A second, independent hash of each set."""
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        out[full] = mix(np.add.reduceat(mix((hashes ^ _BAND) * _GOLD), (np.cumsum(sizes) - sizes)[full]))
    return out.view(np.int64)


def _described(texts: list) -> tuple[None, list[pa.Array]]:
    hashes, sizes = shingle_sets(texts)
    _, rows, sure = signatures(hashes, sizes)
    ends = band_ends()
    band = np.searchsorted(ends, sizes)
    single = [sizes - differing(sizes, ends[band + step]) for step in (0, 1)]
    bits = np.zeros((len(sizes), 64 * SKETCH), bool)
    bits[np.repeat(np.arange(len(sizes)), sizes), (hashes & np.uint64(64 * SKETCH - 1)).astype(np.int64)] = True
    longs = np.packbits(bits, axis=1).view(np.int64)
    made = [sizes, nodes_of(hashes, sizes), checks_of(hashes, sizes), np.bincount(rows, minlength=len(sizes)), sure[:, 0], sure[:, 1], band, *single]
    return None, [*map(pa.array, made), *(pa.array(np.ascontiguousarray(longs[:, k])) for k in range(SKETCH))]


_DESCRIBED = "n_shingles bigint, node bigint, check bigint, n_signs bigint, t0 bigint, t1 bigint, band bigint, single bigint, single_next bigint, " + ", ".join(f"s{k} bigint" for k in range(SKETCH))


def _described_docs(docs: DataFrame, rid: str | None, doc_id: str, text: str) -> DataFrame:
    chosen = docs.select(F.col(doc_id).alias("doc_id"), *([F.col(rid).alias("rid")] if rid else []), F.col(text).alias("text"))
    return materialize(map_texts(chosen, _described, _DESCRIBED), "jaccard-described")


def _guaranteed(described: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """described with a t of 1 and more for every set, and the bands that sign shingle by shingle for it."""
    upper = F.col("band") + 1
    even = lambda band: F.pmod(band, F.lit(2)) == 0
    own = lambda band: F.when(even(band), F.col("t0")).otherwise(F.col("t1"))
    lost = described.where("n_shingles > 0").select(F.explode(F.array(F.when(own(F.col("band")) < 1, F.col("band")), F.when(own(upper) < 1, upper))).alias("band"))
    fine = frozenset(r[0] for r in lost.where("band is not null").distinct().collect())  # bands are as many as the logarithm of the largest set
    if not fine:
        return described, fine
    low, high = F.col("band").isin(*fine), upper.isin(*fine)
    now = lambda odd: F.when(even(F.col("band")) != F.lit(odd), F.when(low, F.col("single"))).otherwise(F.when(high, F.col("single_next")))
    signs = F.when(low & high, 2 * F.col("n_shingles")).when(low | high, F.col("n_signs") + F.col("n_shingles")).otherwise(F.col("n_signs"))
    return described.withColumns({"t0": F.coalesce(now(False), F.col("t0")), "t1": F.coalesce(now(True), F.col("t1")), "n_signs": signs}), fine


def _apart(described: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """described with a node for each set, and the new nodes by (node, check) of sets that had one with others.

    Equal nodes of different sets are as rare as equal 63-bit hashes: the sets squared over 2^64.
    """
    shared = described.where("n_shingles > 0").groupBy("node").agg(F.min("check").alias("stays"), F.max("check").alias("other")).where("stays != other")
    shared = materialize(shared.select("node", "stays"), "jaccard-shared")
    if shared.isEmpty():
        return described, {}
    if shared.count() > CLASHES:
        raise RuntimeError("so many sets with equal hashes cannot come from chance")
    moved = described.join(F.broadcast(shared), "node").where("check != stays").select("node", "check").distinct()
    moved = materialize(moved.withColumn("new", F.xxhash64("node", "check")), "jaccard-moved")
    named = {(r["node"], r["check"]): r["new"] for r in moved.collect()}
    joined = described.join(F.broadcast(moved), ["node", "check"], "left")
    return materialize(joined.withColumn("node", F.coalesce("new", "node")).drop("new"), "jaccard-described"), named


def _blocks(heavy: dict[int, object], buckets: int, moved: dict[tuple[int, int], int], fine: frozenset[int]):
    """Mapper: (doc_id, text) batches -> one block of signatures per slice and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1)):
                part = batch.slice(start, end - start)
                hashes, sizes = shingle_sets(part.column(1).to_pylist())
                nodes = nodes_of(hashes, sizes)
                if moved:
                    nodes = np.array([moved.get(pair, pair[0]) for pair in zip(nodes.tolist(), checks_of(hashes, sizes).tolist(), strict=True)], np.int64)
                names = part.column(0).to_pylist()
                once = np.flatnonzero([n not in heavy or heavy[n] == i for n, i in zip(nodes.tolist(), names, strict=True)])
                kept = np.zeros(len(nodes), bool)
                kept[once[np.unique(nodes[once], return_index=True)[1]]] = True
                signs, rows, _ = signatures(hashes, sizes, fine=fine)
                use = kept[rows]
                signs, rows = signs[use], rows[use]
                bucket = ((signs >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
                order = np.argsort(bucket, kind="stable")
                signs, rows, bucket = signs[order], rows[order], bucket[order].astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else [0]
                out = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    used, place = np.unique(rows[a:b], return_inverse=True)
                    # The 16 bits below the top ones are implied by the bucket only in part, so 48 bits are kept.
                    low = (signs[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    mid = ((signs[a:b] >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)
                    small = len(used) <= 65536
                    out.append((int(bucket[a]), low.tobytes(), mid.tobytes(), place.astype(np.uint16 if small else np.uint32).tobytes(), nodes[used].tobytes()))
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "low", "mid", "place", "nodes"])

    return run


def _met(key: tuple, table: pa.Table) -> pa.Table:
    """All blocks of a bucket -> the distinct lists of nodes that share signatures, with the number m of these.

    A list has an id (gid) that says the same everywhere; long lists come in parts of ``PART`` nodes.
    """
    signs, nodes = [], []
    for low, mid, place, names in zip(*(table.column(c) for c in ("low", "mid", "place", "nodes")), strict=True):
        low, mid, names = np.frombuffer(low.as_buffer(), np.uint32), np.frombuffer(mid.as_buffer(), np.uint16), np.frombuffer(names.as_buffer(), np.int64)
        raw = place.as_buffer()
        place = np.frombuffer(raw, np.uint16 if len(raw) == 2 * len(low) else np.uint32)
        signs.append((mid.astype(np.uint64) << np.uint64(32)) | low)
        nodes.append(names[place])
    sign, node = np.concatenate(signs), np.concatenate(nodes)
    signs = nodes = None
    order = np.argsort(sign, kind="stable")
    sign, node = sign[order], node[order]
    first = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1])))
    count = np.diff(np.concatenate((first, [len(sign)])))
    lone = np.repeat(count == 1, count)
    sign, node = sign[~lone], node[~lone]
    # The same set may come from several slices.
    order = np.lexsort((node, sign))
    sign, node = sign[order], node[order]
    fresh = np.concatenate(([True], (sign[1:] != sign[:-1]) | (node[1:] != node[:-1]))) if len(sign) else np.zeros(0, bool)
    sign, node = sign[fresh], node[fresh]
    first = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1]))) if len(sign) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((first, [len(sign)])))
    first, count = first[count > 1], count[count > 1]
    odd = sign[first] & np.uint64(1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(node.view(np.uint64) ^ _BAND), dtype=np.uint64)))
    gid, lead, times = np.unique(mix(total[first + count] - total[first] + count.astype(np.uint64) * _GOLD + odd), return_index=True, return_counts=True)
    first, count, odd = first[lead], count[lead], odd[lead].astype(np.int64)
    parts = -(-count // PART)
    of = np.repeat(np.arange(len(count)), parts)
    part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(PART, count[of] - part * PART)
    offsets = np.concatenate(([0], np.cumsum(size)))
    where = np.arange(offsets[-1]) + np.repeat(first[of] + part * PART - offsets[:-1], size)
    members = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(node[where]))
    return pa.table([pa.array(gid.view(np.int64)[of]), pa.array(odd[of]), pa.array(part), pa.array(times[of]), members], names=["gid", "odd", "part", "m", "members"])


def _sets(texts: list) -> tuple[None, list[pa.Array]]:
    hashes, sizes = shingle_sets(texts)
    ends = np.cumsum(sizes)
    return None, [pa.array([hashes[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _few(rows: DataFrame) -> DataFrame:
    """rows (written already), broadcast if there are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _possible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """pairs(a, b and more) that sizes and sketches leave, with the facts of both ends."""
    a, b = (facts.select([F.col(c).alias(f"{side}_{c}") for c in facts.columns]) for side in "ab")
    joined = pairs.join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
    apart: Column = sum((F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(SKETCH)), F.lit(0))
    most, least, total = F.greatest("a_n_shingles", "b_n_shingles"), F.least("a_n_shingles", "b_n_shingles"), F.col("a_n_shingles") + F.col("b_n_shingles")
    return joined.where((100 * least >= PERCENT * most) & ((100 + PERCENT) * apart <= (100 - PERCENT) * total))


def _fetched_sets(docs: DataFrame, reps: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(node, shingles) of the given nodes, from one text each.  reps: one row per node with a rid."""
    needed = materialize(reps.join(nodes, "node").select("rid", "node"), "jaccard-needed")
    chosen = docs.join(_few(needed), "rid").select("node", F.col(text).alias("text"))
    return materialize(map_texts(chosen, _sets, "shingles binary"), "jaccard-sets")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of pairs (written already).  Only sets that take part are moved."""
    left = _few(materialize(pairs.select(F.col("a").alias("node")).distinct(), "jaccard-ends"))
    right = _few(materialize(pairs.select(F.col("b").alias("node")).distinct(), "jaccard-ends"))
    x = sets.join(left, "node", "left_semi").select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.join(right, "node", "left_semi").select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_linked, "a bigint, b bigint")


def _across(rows: DataFrame, labels: DataFrame | None, *ends: str) -> DataFrame:
    """rows with the component of each end (the node itself if it has none)."""
    for end in ends:
        if labels is None:
            rows = rows.withColumn(f"c_{end}", F.col(end))
        else:
            named = labels.select(F.col("node").alias(end), F.col("component").alias("found"))
            rows = rows.join(named, end, "left").withColumn(f"c_{end}", F.coalesce("found", end)).drop("found")
    return rows


def _spanning(rows: DataFrame) -> DataFrame:
    """Rows (gid, odd, m, a, c_a) of lists that span two components, with the size of the list."""
    spread = rows.groupBy("gid").agg(F.min("c_a").alias("low"), F.max("c_a").alias("high"), F.count("*").alias("members")).where("low != high")
    return rows.drop("members").join(spread.select("gid", "members"), "gid")


def _sure(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of nodes whose shared signatures number t or more; others are linked with nobody.  Adds have, their number."""
    have = rows.groupBy("a", "odd").agg(F.sum("m").alias("have"))
    need = reps.select(F.col("node").alias("a"), "t0", "t1")
    enough = have.join(need, "a").where(F.col("have") >= F.when(F.col("odd") == 0, F.col("t0")).otherwise(F.col("t1"))).select("a", "odd", "have")
    return rows.drop("have").join(enough, ["a", "odd"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component, n, shingles) -> one row per shingle."""
    for batch in batches:
        for k in range(batch.num_rows):
            found = np.frombuffer(batch.column(3)[k].as_buffer(), np.int64)
            same = [pa.array(np.full(len(found), batch.column(c)[k].as_py(), np.int64)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(found), *same], names=["e", "node", "component", "n"])


def _least_shared(n: Column, k: Column) -> Column:
    """100 + percent times what linked sets of these sizes share at least."""
    return F.lit(PERCENT) * (n + k)


def _last_pairs(rows: DataFrame, labels: DataFrame, facts: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of different components among the nodes of rows (a, c_a).

    A node that the sets of other components do not cover enough is left out: of a linked
    set of size k it holds ``_least_shared``, and sizes are taken in narrow bands.  The
    others are found by shingles: of a node's shingles, rarest first, a linked set misses
    no more than n less what both share, so it has one of those up to there.  The node of
    the smaller component looks for the other.
    """
    sizes = labels.groupBy("component").agg(F.count("*").alias("members"))
    nodes = rows.select(F.col("a").alias("node"), F.col("c_a").alias("component")).distinct().join(facts.select("node", F.col("n_shingles").alias("n")), "node")
    table = materialize(nodes.join(sets, "node").select("node", "component", "n", "shingles").mapInArrow(_elements, "e bigint, node bigint, component bigint, n bigint"), "jaccard-elements")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(NARROW))).cast("int")
    held = table.groupBy("e", band.alias("band")).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    held = held.groupBy("e").agg(F.collect_list(F.struct("band", "low", "high")).alias("held"), F.min("low").alias("least"), F.max("high").alias("most")).where("least != most").select("e", "held")
    seen = table.join(held, "e").select("node", "component", "n", F.inline("held"))
    seen = seen.where("low != component or high != component").groupBy("node", "n", "band").agg(F.count("*").alias("shared"))
    other = F.floor(F.pow(F.lit(NARROW), F.col("band")) - 1e-6)
    stays = seen.where((100 + PERCENT) * F.col("shared") >= _least_shared(F.col("n"), other)).select("node").distinct()
    stays = stays.join(nodes, "node").join(sizes, "component", "left").select("node", F.coalesce("members", F.lit(1)).alias("members"))
    table = materialize(table.join(stays, "node"), "jaccard-covered")
    common = table.groupBy("e").agg(F.count("*").alias("df"))
    # The shingles of one set.
    rarest = Window.partitionBy("node").orderBy("df", "e")
    looking = table.join(common, "e").withColumn("rank", F.row_number().over(rarest))
    enough = lambda k: (100 + PERCENT) * (F.col("n") - F.col("rank") + 1) >= _least_shared(F.col("n"), k)
    looking = looking.where((F.col("df") > 1) & enough(F.ceil(F.col("n") * PERCENT / 100)))
    there = table.select("e", F.col("node").alias("o_node"), F.col("component").alias("o_component"), F.col("n").alias("o_n"), F.col("members").alias("o_members"))
    smaller = (F.col("members") < F.col("o_members")) | ((F.col("members") == F.col("o_members")) & (F.col("component") < F.col("o_component")))
    pairs = looking.join(there, "e").where(smaller & (F.col("component") != F.col("o_component")) & (100 * F.col("o_n") >= PERCENT * F.col("n")) & enough(F.col("o_n")))
    return pairs.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def _node_components(docs: DataFrame, described: DataFrame, moved: dict[tuple[int, int], int], fine: frozenset[int], text: str) -> tuple[DataFrame, DataFrame]:
    """One row per distinct non-empty set, and (node, component) of the linked ones.  docs has rid."""
    full = described.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "rid")).alias("first")
    same = [F.any_value(c).alias(c) for c in ("n_shingles", "n_signs", "t0", "t1", *(f"s{k}" for k in range(SKETCH)))]
    reps = full.groupBy("node").agg(first, F.count("*").alias("copies"), *same).select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.rid").alias("rid"), "copies", *(c for c in ("n_shingles", "n_signs", "t0", "t1", *(f"s{k}" for k in range(SKETCH)))))
    reps = materialize(reps, "jaccard-nodes")
    # At most HEAVY rows, each of a set with very many copies.
    found = {r["node"]: r["rid"] for r in reps.where("copies > 1").orderBy(F.col("copies").desc(), "node").limit(HEAVY).select("node", "rid").collect()}
    total = reps.agg(F.sum("n_signs")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    blocks = docs.select("rid", F.col(text).alias("text")).mapInArrow(_blocks(found, buckets, moved, fine), "bucket bigint, low binary, mid binary, place binary, nodes binary")
    lists = blocks.groupBy("bucket").applyInArrow(_met, "gid bigint, odd bigint, part bigint, m bigint, members array<bigint>")
    lists = materialize(materialize(lists, "jaccard-met").groupBy("gid", "odd", "part").agg(F.sum("m").alias("m"), F.any_value("members").alias("members")), "jaccard-lists")
    rows = lists.select("gid", "odd", "m", F.explode("members").alias("a"))
    facts = reps.select("node", "n_shingles", "t0", "t1", *(f"s{k}" for k in range(SKETCH)))
    rows = materialize(_sure(rows, reps), "jaccard-rows")
    rows = materialize(_sure(_spanning(_across(rows, None, "a")), reps), "jaccard-rows")
    # A first star in each list, around the node that shares most.
    pivots = rows.groupBy("gid").agg(F.max(F.struct("have", "a"))["a"].alias("p"))
    fresh = rows.join(pivots, "gid").where("a != p").select(F.least("a", "p").alias("a"), F.greatest("a", "p").alias("b")).distinct()
    fresh = materialize(_possible(fresh, facts).select("a", "b"), "jaccard-fresh")
    nodes = rows.select(F.col("a").alias("node")).distinct()
    sets = _fetched_sets(docs, reps, nodes, text)
    links = materialize(_links(fresh, sets), "jaccard-links")
    labels = materialize(components(links, "jaccard-components"), "jaccard-labels")
    rows = materialize(_sure(_spanning(_across(rows.select("gid", "odd", "m", "a"), labels, "a")), reps), "jaccard-rows")
    fresh = materialize(_possible(_last_pairs(rows, labels, facts, sets), facts).select("a", "b"), "jaccard-fresh")
    links = links.unionByName(materialize(_links(fresh, sets), "jaccard-links"))
    return reps, materialize(components(links, "jaccard-components"), "jaccard-labels")


def _named(docs: DataFrame) -> DataFrame:
    """docs(doc_id, rid, text) -> doc_id, rid, n_shingles, component (a node; null for empty sets), component_id."""
    described, fine = _guaranteed(_described_docs(docs, "rid", "doc_id", "text"))
    described, moved = _apart(described)
    reps, labels = _node_components(docs, described, moved, fine, "text")
    named = _across(reps.select("node", "doc_id"), labels, "node")
    names = named.groupBy("c_node").agg(F.min("doc_id").alias("component_id"))
    named = named.join(names, "c_node").select("node", F.col("c_node").alias("component"), "component_id")
    rows = described.select("doc_id", "rid", "n_shingles", "node").join(named, "node", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "rid", "n_shingles", "component", own.alias("component_id"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows = numbered(steady(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))).withColumnRenamed(RID, "rid")
    return _named(rows).select("doc_id", "n_shingles", "component_id")


def keep_one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the row of the least id (nulls last, then the first row) of each component, all columns kept.

    Documents without shingles all stay.
    """
    docs = steady(docs)
    rows = numbered(docs)
    named = materialize(_named(rows.select(F.col(doc_id).alias("doc_id"), F.col(RID).alias("rid"), F.col(text).alias("text"))), "jaccard-named")
    order = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "rid")
    first = named.where("component is not null").groupBy("component").agg(F.min(order)["rid"].alias("first"))
    losers = named.join(first, "component").where("rid != first").select(F.col("rid").alias(RID))
    return without(rows, losers).select(docs.columns)
