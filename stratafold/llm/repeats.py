"""Strings that repeat: sampling anchors, then longest-previous-factor arrays where they meet.

The symbols of a text are its bytes, or its words as 64-bit hashes (``shingles.word_hashes``).
Bytes are cut out where ``LENGTH`` of them also start anywhere else; words are counted where
``WORDS`` of them also stand in another text, as short words make such passages shorter
than ``LENGTH`` bytes.

A window is ``LENGTH`` symbols of one text.  Its anchor is the position of the least hash among
the ``GRAM``-byte strings in it (leftmost of equals), so equal windows have equal anchor
strings at equal places.  The windows of a text with the same anchor are consecutive;
they and their bytes are a segment, about 1.4 windows long.  Every window belongs to
exactly one segment, and equal windows lie in segments with equal anchor strings.

1.  One pass finds all segments: hash of the anchor string, 128 bits of BLAKE2b of the whole segment.
2.  Anchor strings that occur once have no repeated window.  Segments that occur twice or
    more have only repeated windows.  Neither needs its bytes.
3.  Of what is left, one copy of each distinct segment is fetched and buckets of them get
    a suffix order, previous and next smaller positions in it, and from these the longest
    previous (and next) factor of every window, cut at ``LENGTH``.
4.  The distinct segments of an anchor string with more than ``SPLIT`` of them are cut again by longer anchor
    strings, as if they were texts, and so on up to whole windows: a longer string is shared by fewer.
    Every window stays in one group, so the rows grow with the segments.
5.  Repeated windows become spans of the texts, which are cut out (or all copies but the
    first are kept track of, see ``keep``).
Hashes of anchor strings only gather what may be equal; what is equal is told by the 128 bits or by the symbols.

Defined results: null text is empty; texts shorter than a window have no repeats;
matches never cross texts and may overlap within one; repeated rows count as repeats of
each other; null ids are carried; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.arrow import slices
from stratafold.llm.joins import RID, numbered, steady
from stratafold.llm.shingles import mix, word_hashes
from stratafold.scratch import materialize

LENGTH = 400
GRAM = 128
#: Words of a passage, and of an anchor string in it.
WORDS = 50
WORD_GRAM = 16
#: Symbols handled at once in the first pass; longer texts are cut into overlapping chunks.
CHUNK = 500_000
#: Symbols of segments in a bucket, and distinct segments of an anchor string above which longer ones part them.
BUCKET = 500_000
SPLIT = 1500
#: Places in texts (of up to seven longs each) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_PLACES = 500_000

_rng = np.random.default_rng(20240301)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _tables[k] = np.cumprod(table, dtype=np.uint64)
    return _tables


class Hashed:
    """Hashes of any substrings of an array of symbols (bytes, or words by their hashes)."""

    def __init__(self, data: np.ndarray) -> None:
        power, self.inverse = _powers(len(data) + 1)
        values = _BYTE[data] if data.dtype == np.uint8 else data
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[: len(data)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of concatenated texts: first and last window start, anchor hash, and two halves of the segment's digest.

    bounds: starts of the texts and the end of the last; positions are in ``data``, which
    is shorter than 16 MiB.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    hashed, width = Hashed(data), length - gram + 1
    at = np.arange(len(data) - gram + 1)
    grams = hashed.of(at, at + gram)
    least = sliding_minimum((grams & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64), width)
    start = np.arange(len(least))
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(bounds, start, side="right") - 1
    inside = start + length <= bounds[text + 1]
    start, anchor, text = start[inside], anchor[inside], text[inside]
    if not len(start):
        return none, none, none, none, none
    fresh = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    first, last = start[fresh], start[np.concatenate((fresh[1:] - 1, [len(start) - 1]))]
    return first, last, grams[anchor[fresh]].view(np.int64), *digests(data, first, last + length)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each stretch of symbols, as two longs."""
    view, size = memoryview(np.ascontiguousarray(data)).cast("B"), data.itemsize
    made = b"".join(hashlib.blake2b(view[a * size : b * size], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    both = np.frombuffer(made, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Suffixes:
    """Order of suffixes by their first ``depth`` symbols, equal ones by position, and exact common prefixes up to there."""

    def __init__(self, data: np.ndarray, depth: int = LENGTH) -> None:
        self.depth, n = depth, len(data)
        self.unit = 8 if data.dtype == np.uint8 else 1
        self.data = np.concatenate((data, np.zeros(self.unit + 2 * depth, data.dtype)))
        if self.unit == 8:
            words = np.lib.stride_tricks.sliding_window_view(self.data, 8)[: n + 2 * depth]
            first = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
        else:
            first = self.data
        self.levels = [(self.unit, self._ranks(first))]
        while 2 * self.levels[-1][0] <= depth:
            size, rank = self.levels[-1]
            key = rank[:-size].astype(np.uint64) * np.uint64(len(rank) + 1) + rank[size:]
            self.levels.append((2 * size, self._ranks(key)))
        self.n = n

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate(([False], ordered[1:] != ordered[:-1]))
        rank = np.empty(len(key), np.uint32)
        rank[order] = np.cumsum(fresh, dtype=np.uint32)
        return rank

    def order(self, starts: np.ndarray) -> np.ndarray:
        """starts (ascending) in suffix order."""
        size, rank = self.levels[-1]
        key = rank[starts].astype(np.uint64) * np.uint64(len(rank) + 1) + rank[starts + self.depth - size]
        return starts[np.argsort(key, kind="stable")]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and y, at most ``depth``."""
        done, x, y = np.zeros(len(x), np.int64), x.copy(), y.copy()
        for size, rank in self.levels[::-1]:
            for _ in range(2 if size == self.levels[-1][0] else 1):
                same = rank[x] == rank[y]
                step = np.where(same, size, 0)
                done, x, y = done + step, x + step, y + step
        for _ in range(self.unit - 1):
            same = self.data[x] == self.data[y]
            done, x, y = done + same, x + same, y + same
            if not same.any():
                break
        return np.minimum(done, self.depth)


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each index the last one before it with a smaller value, -1 if none; by pointer jumping."""
    found = np.arange(-1, len(values) - 1)
    open_ = np.arange(len(values))
    while len(open_):
        at = found[open_]
        open_ = open_[(at >= 0) & (values[at] > values[open_])]
        found[open_] = found[found[open_]]
    return found


def longest_factors(suffixes: Suffixes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of each start: longest prefix that also starts earlier (later) among the starts."""
    order = suffixes.order(starts)
    best = []
    for sign in (1, -1):
        length = np.zeros(len(order), np.int64)
        for turn in (1, -1):
            seen = order[::turn]
            near = nearest_smaller(sign * seen)
            has = np.flatnonzero(near >= 0)
            common = np.zeros(len(order), np.int64)
            common[has] = suffixes.common(seen[has], seen[near[has]])
            length = np.maximum(length, common[::turn])
        back = np.empty(len(order), np.int64)
        back[np.searchsorted(starts, order)] = length
        best.append(back)
    return best[0], best[1]


def shared_windows(suffixes: Suffixes, starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the equal windows of each start (ascending) lie in texts of different numbers; low, high: least and greatest by start."""
    order = suffixes.order(starts)
    fresh = np.concatenate(([True], suffixes.common(order[1:], order[:-1]) < suffixes.depth))
    at, lead = np.searchsorted(starts, order), np.flatnonzero(fresh)
    differ = np.minimum.reduceat(low[at], lead) != np.maximum.reduceat(high[at], lead)
    out = np.empty(len(order), bool)
    out[at] = differ[np.cumsum(fresh) - 1]
    return out


def _pieces(rows: Iterator[tuple[object, np.ndarray]], length: int) -> Iterator[list[tuple[object, int, np.ndarray]]]:
    """(row, symbols) -> lists of (row, offset, symbols) of about ``CHUNK`` symbols; windows lie in exactly one piece."""
    waiting, size = [], 0
    for name, text in rows:
        for at in range(0, max(1, len(text) - length + 1), CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            if size and size + len(piece) > CHUNK:
                yield waiting
                waiting, size = [], 0
            waiting.append((name, at, piece))
            size += len(piece)
    if waiting:
        yield waiting


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _symbols(texts: pa.Array, words: bool) -> Iterator[np.ndarray]:
    """The symbols of each text."""
    if not words:
        yield from (np.frombuffer(_encoded(t.as_py()), np.uint8) for t in texts)
        return
    for start, end in slices(texts):
        hashes, counts = word_hashes(texts.slice(start, end - start).to_pylist())
        yield from np.split(hashes, np.cumsum(counts)[:-1])


_SEGMENTS = "rid bigint, first bigint, last bigint, anchor bigint, segment bigint, check bigint, copies bigint"
#: What names a distinct segment.
KEY = ("anchor", "segment", "check")


def _segments(length: int, gram: int, spare: int, words: bool, across: bool):
    """Mapper: (rid, text) -> segments, one row for those that repeat within a piece, and spans (anchor null) of these.

    spare: how many of the equal segments of a piece are not spans (1: the first stays).
    across: no spans, but ``others`` has how far behind the first of equal segments the others of the piece start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), _symbols(batch.column(1), words), strict=True)
            for pieces in _pieces(rows, length):
                names, offsets, bodies = (list(x) for x in zip(*pieces, strict=True))
                bounds = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
                first, last, anchor, segment, check = segments(np.concatenate(bodies), bounds, length, gram)
                owner = np.searchsorted(bounds, first, side="right") - 1
                rid = np.array(names, np.int64)[owner]
                shift = np.array(offsets, np.int64)[owner] - bounds[owner]
                # Equal segments of a piece become one row with a count.
                order = np.lexsort((check, segment, anchor, owner))
                fresh = np.zeros(len(order), bool)
                fresh[:1] = True
                for x in (owner, anchor, segment, check):
                    fresh[1:] |= x[order][1:] != x[order][:-1]
                lead = np.flatnonzero(fresh)
                copies = np.diff(np.concatenate((lead, [len(order)])))
                rank = np.arange(len(order)) - np.repeat(lead, copies)
                one = order[lead]
                if across:
                    behind = (first + shift)[order] - np.repeat((first + shift)[one], copies)
                    others = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(copies - 1))), pa.int32()), pa.array(behind[rank > 0], pa.int64()))
                    columns = [pa.array(np.asarray(x, np.int64)) for x in (rid[one], (first + shift)[one], (last + shift)[one], anchor[one], segment[one], check[one], copies)]
                    yield pa.RecordBatch.from_arrays([*columns, others], names=["rid", "first", "last", *KEY, "copies", "others"])
                    continue
                local = np.sort(order[(np.repeat(copies, copies) > 1) & (rank >= spare)])
                start, end = (first + shift)[local], (last + shift)[local] + length
                if len(local):  # spans that touch become one
                    cut = np.flatnonzero(np.concatenate(([True], (start[1:] > end[:-1]) | (rid[local][1:] != rid[local][:-1]))))
                    start, end, spans_of = start[cut], end[np.concatenate((cut[1:] - 1, [len(local) - 1]))], rid[local][cut]
                else:
                    spans_of = local
                lost = pa.nulls(len(start), pa.int64())
                joined = [(rid[one], spans_of), ((first + shift)[one], start), ((last + shift)[one], end)]
                columns = [pa.array(np.concatenate(pair).astype(np.int64)) for pair in joined]
                columns += [pa.concat_arrays([pa.array(np.asarray(x, np.int64)), lost]) for x in (anchor[one], segment[one], check[one], copies)]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "first", "last", *KEY, "copies"])

    return run


_WANTED = ("different", *KEY, "n", "low_rid", "high_rid", "rid", "first")


def _fetched(length: int, words: bool):
    """Mapper: (wanted segments of a text, text) -> their symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wanted, text in zip(batch.column(0), _symbols(batch.column(1), words), strict=True):
                rows = wanted.values
                columns = [rows.field(k) for k in _WANTED]
                spans = zip(rows.field("first").to_pylist(), rows.field("last").to_pylist(), strict=True)
                columns.append(pa.array([text[a : b + length].tobytes() for a, b in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*_WANTED, "symbols"])

    return run


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and last indices of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2] - 1


def _factored(length: int, first_stays: bool, words: bool, across: bool):
    """All distinct segments of a bucket -> runs of their windows that repeat."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rid", "ascending"), ("first", "ascending")]).combine_chunks()
        data = np.frombuffer(b"".join(table.column("symbols").to_pylist()), np.uint64 if words else np.uint8)
        sizes = pc.binary_length(table.column("symbols")).to_numpy() // data.itemsize
        begin = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(sizes)), windows)
        starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begin[owner]
        suffixes = Suffixes(data, length)
        if across:
            repeats = shared_windows(suffixes, starts, *(table.column(k).to_numpy()[owner] for k in ("low_rid", "high_rid")))
        else:
            before, after = longest_factors(suffixes, starts)
            repeats = before >= length
            if not first_stays:
                repeats |= (after >= length) | (table.column("n").to_numpy() > 1)[owner]
        mask = np.zeros(sizes.sum() + 1, bool)
        mask[starts[repeats]] = True
        low, high = _runs(mask)
        of = np.searchsorted(begin, low, side="right") - 1
        return pa.table([*(table.column(k).take(pa.array(of)) for k in KEY), pa.array(low - begin[of]), pa.array(high - begin[of])], names=[*KEY, "low", "high"])

    return run


#: Of a part of a distinct segment: what names the segment, and the place in it.
_PARENT = ("in_anchor", "in_segment", "in_check")
_PARTS = ", ".join(f"{k} bigint" for k in (*_PARENT, "at", "span", "rid", "first", *KEY, "n", "low_rid", "high_rid"))


def longer(gram: int, length: int) -> int:
    """The next longer anchor string; at last the whole window."""
    return length - (length - gram) * 3 // 8


def _parts(length: int, gram: int, words: bool):
    """Mapper: distinct segments with symbols -> their parts by anchor strings of ``gram`` symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(batch.schema.get_field_index("symbols"))):
                rows = batch.slice(begin, end - begin)
                bodies = [np.frombuffer(x.as_buffer(), np.uint64 if words else np.uint8) for x in rows.column("symbols")]
                bounds = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
                first, last, anchor, segment, check = segments(np.concatenate(bodies), bounds, length, gram)
                owner = np.searchsorted(bounds, first, side="right") - 1
                own = {k: rows.column(k).to_numpy()[owner] for k in (*KEY, "rid", "first", "n", "low_rid", "high_rid")}
                at = first - bounds[owner]
                # Parts of other anchor strings stay apart; whole windows are told apart by their digest at once.
                inner = segment ^ check if gram == length else anchor
                joined = mix(own["anchor"].view(np.uint64) * _BASE + inner.view(np.uint64)).view(np.int64)
                columns = [own["anchor"], own["segment"], own["check"], at, last - first, own["rid"], own["first"] + at, joined, segment, check, own["n"], own["low_rid"], own["high_rid"]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[c.split(" ")[0] for c in _PARTS.split(", ")])

    return run


def _cut(length: int, words: bool):
    """Mapper: (symbols of a segment, place and span of a part, and what is wanted of it) -> the part's symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = 8 if words else 1
        for batch in batches:
            places = zip(batch.column("symbols"), batch.column("at").to_pylist(), batch.column("span").to_pylist(), strict=True)
            parts = [x.as_buffer()[at * unit : (at + span + length) * unit].to_pybytes() for x, at, span in places]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in _WANTED), pa.array(parts, pa.binary())], names=[*_WANTED, "symbols"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as maximal spans in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _joined(docs: DataFrame, side: DataFrame, places: str, how: str) -> DataFrame:
    """docs joined on rid with a written table of arrays of places, broadcast only if these are few in all."""
    total = side.agg(F.sum(F.coalesce(F.size(places), F.lit(0)) + 1)).first()[0] or 0
    return docs.join(F.broadcast(side) if total <= BROADCAST_PLACES else side, "rid", how)


def _merged_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, spans) with overlapping and touching spans made one; ``others`` of a span: how far behind it equal ones start."""
    for batch in batches:
        starts, ends = [], []
        for spans in batch.column(1):
            start, end = (spans.values.field(k).to_numpy() for k in ("start", "end"))
            if spans.values.type.num_fields == 3:
                others = spans.values.field("others")
                of, behind = pc.list_parent_indices(others).to_numpy(), pc.list_flatten(others).to_numpy()
                start, end = np.concatenate((start, start[of] + behind)), np.concatenate((end, end[of] + behind))
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            cut = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
            starts.append(start[cut])
            ends.append(end[np.concatenate((cut[1:] - 1, [len(end) - 1]))])
        fields = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (starts, ends)]
        offsets = pa.array(np.cumsum([0, *map(len, starts)]), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "end"]))], names=["rid", "spans"])


def _repeats(found: DataFrame, carry: tuple[str, ...], fetch: Callable[[DataFrame], DataFrame], length: int, gram: int, stays: bool, words: bool, across: bool) -> DataFrame:
    """(carry, low, high): runs of windows that repeat, numbered like ``at``.

    found: segments (carry, at, span, rid, first, KEY, n, low_rid, high_rid), in texts or in other segments.
    fetch: distinct ones of them (``_WANTED``, carry, at, span) -> ``_WANTED`` and symbols.
    """
    twice = F.min("low_rid") != F.max("high_rid") if across else F.sum("n") > 1
    several = (F.min("segment") != F.max("segment")) | (F.min("check") != F.max("check"))
    often = found.groupBy("anchor").agg(twice.alias("twice"), several.alias("mixed")).where("twice").select("anchor", "mixed")
    found = materialize(found.join(often, "anchor"), "repeats-frequent")
    lead = F.min(F.struct("rid", "first", *carry, "at", "span")).alias("lead")
    whole = (*carry, F.col("at").alias("low"), (F.col("at") + F.col("span")).alias("high"))
    if stays:  # every copy but the first goes whole
        firsts = found.groupBy(*KEY).agg(F.min(F.struct("rid", "first")).alias("lead"))
        runs = found.join(firsts, list(KEY)).where(F.struct("rid", "first") != F.col("lead")).select(*whole)
    else:
        runs = found.where("not mixed").select(*whole)
    mixed = found.where("mixed")
    distinct = mixed.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("low_rid").alias("low_rid"), F.max("high_rid").alias("high_rid"), lead)
    distinct = materialize(distinct.select(*KEY, "n", "low_rid", "high_rid", "lead.*"), "repeats-distinct")
    per_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("different"))
    fetched = materialize(fetch(distinct.join(per_anchor, "anchor")), "repeats-fetched")
    total = fetched.agg(F.sum(F.length("symbols"))).first()[0] or 0
    buckets = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (BUCKET * (8 if words else 1))))
    few = fetched.where(F.col("different") <= SPLIT).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    inside = few.groupBy("bucket").applyInArrow(_factored(length, stays, words, across), ", ".join(f"{k} bigint" for k in (*KEY, "low", "high")))
    many = fetched.where(F.col("different") > SPLIT)
    if not many.isEmpty():
        gram = longer(gram, length)
        parts = materialize(many.mapInArrow(_parts(length, gram, words), _PARTS), "repeats-parts")

        def cut(wanted: DataFrame) -> DataFrame:
            of = [F.col(k).alias(f"in_{k}") for k in KEY]
            bodies = many.select(*of, "symbols")
            return wanted.join(bodies, list(_PARENT)).select(*_WANTED, "at", "span", "symbols").mapInArrow(_cut(length, words), ", ".join(f"{k} bigint" for k in _WANTED) + ", symbols binary")

        deeper = _repeats(parts, _PARENT, cut, length, gram, stays, words, across)
        inside = inside.unionByName(deeper.select(*(F.col(f"in_{k}").alias(k) for k in KEY), "low", "high"))
    inside = materialize(inside, "repeats-runs").select(*KEY, F.col("low").alias("from"), F.col("high").alias("to"))
    # Where the first copy stays, these windows are repeats already there.
    hits = (distinct if stays else mixed).select(*carry, "at", *KEY).join(inside, list(KEY))
    return runs.unionByName(hits.select(*carry, (F.col("at") + F.col("from")).alias("low"), (F.col("at") + F.col("to")).alias("high")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none", words: bool = False, across: bool = False) -> DataFrame:
    """docs(rid, text) -> rid and its maximal spans of repeated symbols (array of start, end).

    keep: "none" marks every copy, "first" all but the first in order of rid and place.
    words: symbols are words, not bytes.  across: only what also stands in another text
    repeats (with keep "none").
    """
    stays = keep == "first"
    if across and stays:
        raise ValueError("across texts every copy is marked")
    kinds = _SEGMENTS + ", others array<bigint>" * across
    found = materialize(docs.select("rid", "text").mapInArrow(_segments(length, gram, int(stays), words, across), kinds), "repeats-segments")

    def fetch(distinct: DataFrame) -> DataFrame:
        last = (F.col("first") + F.col("span")).alias("last")
        wanted = distinct.groupBy("rid").agg(F.collect_list(F.struct(*_WANTED, last)).alias("wanted"))  # segments of one text
        joined = _joined(docs, materialize(wanted, "repeats-wanted"), "wanted", "inner")
        return joined.select("wanted", "text").mapInArrow(_fetched(length, words), ", ".join(f"{k} bigint" for k in _WANTED) + ", symbols binary")

    placed = found.where("anchor is not null").select("rid", "first", F.col("first").alias("at"), (F.col("last") - F.col("first")).alias("span"), *KEY, F.col("copies").alias("n"), F.col("rid").alias("low_rid"), F.col("rid").alias("high_rid"))
    placed = placed.withColumn("of", F.col("rid"))
    made = (F.col("of").alias("rid"), F.col("low").alias("start"), (F.col("high") + length).alias("end"))
    if across:  # what is shared in a segment is shared in those of the text that equal it
        runs = _repeats(placed.withColumn("place", F.col("first")), ("of", "place"), fetch, length, gram, stays, words, across)
        more = found.where(F.size("others") > 0).select(F.col("rid").alias("of"), F.col("first").alias("place"), "others")
        spans = runs.join(more, ["of", "place"], "left").select(*made, "others")
    else:
        spans = found.where("anchor is null").select("rid", F.col("first").alias("start"), F.col("last").alias("end"))
        spans = spans.unionByName(_repeats(placed, ("of",), fetch, length, gram, stays, words, across).select(*made))
    # The spans of one text.
    by_text = spans.groupBy("rid").agg(F.collect_list(F.struct(*spans.columns[1:])).alias("spans"))
    return materialize(by_text.mapInArrow(_merged_spans, "rid bigint, spans array<struct<start: bigint, end: bigint>>"), "repeats-spans")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return numbered(steady(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))).withColumnRenamed(RID, "rid")


def _shared(rows: DataFrame, words: int, gram: int) -> DataFrame:
    """(rid, n_shared_words) of the texts that have any."""
    spans = repeated_spans(rows, words, gram, words=True, across=True)
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda done, s: done + s["end"] - s["start"])
    return spans.select("rid", total.alias("n_shared_words"))


def shared_words(docs: DataFrame, words: int = WORDS, gram: int = WORD_GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shared_words, the words in passages of at least ``words`` words that also stand in another document.

    A-Z in lower case, any space between words; nothing is cut out.
    """
    rows = _rows(docs, doc_id, text)
    found = rows.select("doc_id", "rid").join(_shared(rows, words, gram), "rid", "left")
    return found.select("doc_id", F.coalesce("n_shared_words", F.lit(0)).cast("bigint").alias("n_shared_words"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none", doc_id: str = "doc_id", text: str = "text", passages: int | None = None, passage_gram: int = WORD_GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes).

    passages: words of a passage; before kept then stands n_shared_words, as ``shared_words`` counts them.
    """
    rows = _rows(docs, doc_id, text)
    marks, counts = repeated_spans(rows, length, gram, keep), []
    if passages:
        counts = ["n_shared_words"]
        marks = materialize(marks.join(_shared(rows, passages, passage_gram), "rid", "full"), "repeats-marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, spans in zip(batch.column(1), batch.column(2), strict=True):
                body = _encoded(body.as_py())
                gone = list(zip(spans.values.field(0).to_pylist(), spans.values.field(1).to_pylist(), strict=True)) if spans.is_valid else []
                edges = [0, *(x for span in gone for x in span), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            *made, kept = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[3:], kept], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *counts, "kept"]
    numbers = (F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts)
    joined = _joined(rows, marks, "spans", "left").select("doc_id", "text", "spans", *numbers)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, {''.join(f'{c} bigint, ' for c in counts)}kept binary")
