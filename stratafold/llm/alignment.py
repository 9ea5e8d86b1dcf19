"""Alignment of two tokenizers over the same text, by elementary intervals.

A text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B).  Both cut the same bytes, so
the union of both arrays of token ends cuts the text into elementary intervals; ``searchsorted`` finds the A
token and the B token that own each.  Every interval is one overlap of a pair of tokens, and an end that both have closes
a group: the least run of A tokens and of B tokens that cover the same bytes.

Three steps over the corpus, each a map in Arrow batches.  The first encodes once and keeps, for each
document, its digests and its distinct id pairs with their numbers.  The second adds pairs up over the corpus: a
task adds up its own before anything is shuffled.  The third looks the counts up: those of the ``HEAVY`` most
frequent pairs, which make up nearly all links, in two arrays that are broadcast (17 bytes a pair), all
others by a shuffle join of (document, pair) rows.

No token of either vocabulary goes on past a space that follows something else than white space (checked when
the vocabularies are read; otherwise texts stay whole), so both have an end at each such place, and a text's groups and pairs are those of its
stretches, one after the other.  A slice of texts is cut at once, each distinct stretch is encoded and aligned once, frequent
ones are kept in memory, and what a document has is gathered from what is known of its stretches.

Defined results: texts that are null, empty, or not given back byte for byte by a vocabulary (after one
space) have no tokens: zeros, and an empty digest; special tokens' strings are plain text; repeated
rows count each; a null id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.arrow import map_texts
from stratafold.llm.packing import byte_of, encoder
from stratafold.scratch import materialize

#: Most frequent pairs whose counts every task holds.
HEAVY = 1 << 18
#: Bytes of one part of a text that is encoded for itself, and stretches that are gathered at once.
PART = 1 << 17
#: Bytes of texts that are cut into stretches at once.
SLICE = 1 << 20
#: Stretches kept in memory, bytes of them and of what is known of them, and the longest that outlives others, in bytes.
KEPT = 1 << 18
KEPT_BYTES = 1 << 26
KEPT_LENGTH = 1 << 8
#: Bytes of new stretches that are encoded as one text: the piece encoder takes three times as long for a byte of a text of megabytes.
TOGETHER = 1 << 10
#: Distinct pairs that a task gathers before it passes their numbers on.
GATHERED = 1 << 20

_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
#: White space before which a space does not begin a stretch: of one byte, of more.
_NARROW = np.array([chr(c).isspace() and c < 128 for c in range(256)])
_WIDE = np.array([int.from_bytes(c.encode()) for c in map(chr, range(128, 0x3001)) if c.isspace()])


class Ragged:
    """Rows of bytes of unequal length, in one array that grows."""

    def __init__(self) -> None:
        self.rows, self.data, self.offsets = 0, np.zeros(1 << 10, np.uint8), np.zeros(1 << 10, np.int64)

    def size(self) -> int:
        return int(self.offsets[self.rows])

    def add(self, data: np.ndarray, lengths: np.ndarray) -> None:
        at, end = self.size(), self.rows + len(lengths)
        while len(self.data) < at + len(data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        while len(self.offsets) <= end:
            self.offsets = np.concatenate((self.offsets, np.zeros_like(self.offsets)))
        self.data[at : at + len(data)] = data
        self.offsets[self.rows + 1 : end + 1] = at + np.cumsum(lengths)
        self.rows = end

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the rows one after the other, and where each begins, with the end."""
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.rows, [None, pa.py_buffer(self.offsets), pa.py_buffer(self.data)])
        taken = held.take(pa.array(rows))
        _, offsets, data = taken.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(rows) + 1]
        return np.frombuffer(data, np.uint8)[: offsets[-1]] if data else np.zeros(0, np.uint8), offsets


def _ragged(words: list[bytes]) -> Ragged:
    made = Ragged()
    made.add(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64))
    return made


class Vocabularies:
    """Both encoders, the bytes of their tokens, the strings of their ids, and what is known of stretches."""

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        import sentencepiece

        with open(byte_bpe, encoding="utf-8") as f:
            parts = json.load(f)
        alphabet = byte_of()
        special = {t["id"] for t in parts.get("added_tokens") or ()}
        entries = {i: bytes(alphabet[c] for c in t) for t, i in parts["model"]["vocab"].items() if i not in special}
        a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.encode_a = encoder(byte_bpe, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(_BYTE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.n_a, self.n_b = len(a_bytes), len(b_bytes)
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)
        self.tokens = _ragged(a_bytes), _ragged(b_bytes)
        self.a_sizes, self.b_sizes = (np.diff(t.offsets[: t.rows + 1]) for t in self.tokens)
        #: A id and comma, A id and bar, B id and comma, B id and semicolon.
        self.words = _ragged([f"{i}{end}".encode() for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for end in ends for i in range(n)])
        self.forget()

    def forget(self) -> None:
        """Nothing is known of any stretch."""
        self.place: dict[bytes, int] = {}
        self.name_bytes = 0
        #: By place: n_a, n_b, n_groups, n_links; slices that had the stretch; whether a vocabulary does not give it back.
        self.numbers, self.used, self.bad = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        #: By place: the stretch's groups, each with its semicolon, and its pairs, 8 bytes each.
        self.said, self.pairs = Ragged(), Ragged()

    def _pieces(self, text: str) -> list[int]:
        """Ids of B for a text that begins with a space, which B adds itself."""
        return self.b.encode(text[1:], num_threads=1)

    def _back(self, side: int, ids: np.ndarray) -> bytes:
        return self.tokens[side].take(ids)[0].tobytes()

    def bounds(self, data: bytes, closes: np.ndarray) -> np.ndarray:
        """Where stretches of texts begin that end at ``closes``: at their first bytes, and at spaces, but the last byte, that follow no white space."""
        codes, firsts = np.frombuffer(data, np.uint8), np.concatenate(([0], closes[:-1]))
        if not self.splits:
            return firsts
        begins = codes == 32
        begins[firsts], begins[closes - 1] = False, False
        at = np.flatnonzero(begins)
        begins[at[_NARROW[codes[at - 1]]]] = False
        wide = at[codes[at - 1] > 127]  # no text's first bytes, as each begins with a space
        three = codes[wide - 3].astype(np.int64) << 16 | codes[wide - 2].astype(np.int64) << 8 | codes[wide - 1]
        begins[wide[np.isin(three, _WIDE) | np.isin(three & 0xFFFF, _WIDE)]] = False
        begins[firsts] = True
        return np.flatnonzero(begins)

    def _ids(self, groups: list[list[bytes]], side: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches, a group of them encoded as one text, and their number for each stretch."""
        encode, sizes = ((self.encode_a, self.a_sizes), (self._pieces, self.b_sizes))[side]
        ids, counts = [], []
        for group in groups:
            own = np.array(encode(b"".join(group).decode()), np.int64)
            reach, ends = sizes[own].cumsum(), np.array(list(map(len, group))).cumsum()
            cuts = reach.searchsorted(ends)
            if len(own) and cuts[-1] == len(own) - 1 and (reach[cuts] == ends).all():
                cuts[1:] -= cuts[:-1].copy()
                cuts[0] += 1
                counts.append(cuts)
            else:  # not given back
                each = [encode(s.decode()) for s in group]
                own = np.array(list(chain.from_iterable(each)), np.int64)
                counts.append(np.array([len(x) for x in each], np.int64))
            ids.append(own)
        return np.concatenate(ids), np.concatenate(counts)

    def learn(self, names: list[bytes]) -> None:
        """Encodes and aligns new stretches, which begin with a space; one that ends in white space ends its group."""
        groups, size = [], TOGETHER
        for s in names:
            if size >= TOGETHER or not self.splits:
                groups.append([])
                size = 0
            groups[-1].append(s)
            size = TOGETHER if s[-1] < 33 or s[-1] > 127 and s.decode()[-1].isspace() else size + len(s)
        sides, counts = zip(*(self._ids(groups, side) for side in (0, 1)), strict=True)
        whole, lengths = b"".join(names), np.array([len(s) for s in names])
        bad = np.zeros(len(names), bool)
        for side, (ids, own) in enumerate(zip(sides, counts, strict=True)):
            back, offsets = self.tokens[side].take(ids)
            told = back.tobytes()
            if told != whole:
                stops = offsets[np.cumsum(own)].tolist()
                bad |= [told[i:j] != s for s, i, j in zip(names, [0, *stops[:-1]], stops, strict=True)]
        if bad.any():
            sides = [ids[np.repeat(~bad, own)] for ids, own in zip(sides, counts, strict=True)]
            counts, lengths = [np.where(bad, 0, own) for own in counts], np.where(bad, 0, lengths)
        ends, pairs, shared, codes = elementary(self, *sides)
        closes = np.cumsum(lengths)
        of = lambda x: np.diff(np.searchsorted(x, closes, side="right"), prepend=0)
        numbers = np.stack((*counts, of(shared), of(ends)), axis=1)
        said, offsets = self.words.take(codes)
        self.said.add(said, np.diff(offsets[np.cumsum(counts[0] + counts[1])], prepend=0))
        self.pairs.add(pairs.view(np.uint8), 8 * numbers[:, 3])
        self.name_bytes += len(whole)
        self.place.update(zip(names, range(len(self.place), len(self.place) + len(names)), strict=True))
        self.numbers, self.bad = np.concatenate((self.numbers, numbers)), np.concatenate((self.bad, bad))
        self.used = np.concatenate((self.used, np.zeros(len(names), np.int64)))

    def places(self, names: list[bytes]) -> np.ndarray:
        """Places of distinct stretches."""
        new = [s for s in names if s not in self.place]
        if new:
            self.learn(new)
        found = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        self.used[found] += 1
        return found

    def trim(self) -> None:
        """Forgets most when too much is kept: what the most slices had stays."""
        if len(self.place) <= KEPT and self.name_bytes + self.said.size() + self.pairs.size() <= KEPT_BYTES:
            return
        names, used, numbers, bad, said, pairs = list(self.place), self.used, self.numbers, self.bad, self.said, self.pairs
        short = np.flatnonzero(np.array([len(s) for s in names]) <= KEPT_LENGTH)
        stay = np.sort(short[np.argsort(-used[short], kind="stable")[: KEPT // 2]])
        self.forget()
        self.place = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.name_bytes = sum(map(len, self.place))
        self.numbers, self.used, self.bad = numbers[stay], used[stay] // 2, bad[stay]
        for kept, held in ((self.said, said), (self.pairs, pairs)):
            data, offsets = held.take(stay)
            kept.add(data, np.diff(offsets))

    def encoded(self, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B for each part of space + text; none where a vocabulary does not give its bytes back."""
        if not text:
            return []
        whole = (" " + text).encode()
        begins = self.bounds(whole, np.array([len(whole)]))
        cuts = [0]
        for start, end in zip(begins.tolist(), [*begins[1:].tolist(), len(whole)], strict=True):
            if end - cuts[-1] > PART and start > cuts[-1]:
                cuts.append(start)
        parts = [whole[i:j] for i, j in zip(cuts, [*cuts[1:], len(whole)], strict=True)]
        made = [tuple(np.array(encode(part.decode()), np.int64) for encode in (self.encode_a, self._pieces)) for part in parts]
        if all(self._back(side, ids[side]) == part for ids, part in zip(made, parts, strict=True) for side in (0, 1)):
            return made
        a, b = (np.concatenate([m[k] for m in made]) for k in (0, 1))
        return [(a, b)] if self._back(0, a) == self._back(1, b) == whole else []


@lru_cache(maxsize=1)
def vocabularies(byte_bpe: str, piece_bpe: str) -> Vocabularies:
    """One per Python worker and pair of files."""
    return Vocabularies(byte_bpe, piece_bpe)


def _union(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``np.union1d`` of ascending arrays, by a merge: its own way of finding what is distinct takes longer."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both


def elementary(t: Vocabularies, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For ids of the same bytes: ends of all intervals, the pair that owns each, ends of groups, and the words of all groups."""
    a_ends, b_ends = np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b])
    ends = _union(a_ends, b_ends)
    own_a, own_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    shared = ends[(a_ends[own_a] == ends) & (b_ends[own_b] == ends)]
    a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
    order = np.argsort(np.concatenate((2 * a_group, 2 * b_group + 1)), kind="stable")
    codes = np.concatenate((a + t.n_a * (shared[a_group] == a_ends), b + 2 * t.n_a + t.n_b * (shared[b_group] == b_ends)))[order]
    return ends, a[own_a] * t.n_b + b[own_b], shared, codes


class Slice:
    """What is known of the documents of one slice."""

    def __init__(self, tables: Vocabularies, n: int, with_groups: bool) -> None:
        self.tables, self.n = tables, n
        self.numbers = np.zeros((4, n), np.int64)
        self.digests = [hashlib.sha256() for _ in range(n)]
        self.begun = [False] * n
        self.groups: list[list[str]] | None = [[] for _ in range(n)] if with_groups else None
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def _say(self, docs: list[int], said: np.ndarray, stops: list[int]) -> None:
        """Words of documents, one after the other up to ``stops``; each ends in a semicolon, which is not said at the end."""
        at, view = 0, memoryview(said)
        for doc, stop in zip(docs, stops, strict=True):
            if self.begun[doc]:
                self.digests[doc].update(b";")
            self.digests[doc].update(view[at : stop - 1])
            self.begun[doc] = True
            if self.groups is not None:
                self.groups[doc].append(bytes(view[at : stop - 1]).decode())
            at = stop

    def _pair(self, owners: np.ndarray, pairs: np.ndarray) -> None:
        keys, times = np.unique(owners * (self.tables.n_a * self.tables.n_b) + pairs, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)

    def add(self, docs: list[int], a_parts: list[np.ndarray], b_parts: list[np.ndarray]) -> None:
        """Aligns parts that follow each other; a document's parts come in order."""
        t = self.tables
        a, b = np.concatenate(a_parts), np.concatenate(b_parts)
        ends, pairs, shared, codes = elementary(t, a, b)
        a_counts, b_counts = (np.array([len(p) for p in parts]) for parts in (a_parts, b_parts))
        closes = np.cumsum(t.a_sizes[a])[np.cumsum(a_counts) - 1]
        owners = np.array(docs)
        part = np.searchsorted(closes, ends)
        for k, found in enumerate((a_counts, b_counts, np.bincount(np.searchsorted(closes, shared), minlength=len(docs)), np.bincount(part, minlength=len(docs)))):
            np.add.at(self.numbers[k], owners, found)
        self._pair(owners[part], pairs)
        said, offsets = t.words.take(codes)
        self._say(docs, said, offsets[np.cumsum(a_counts + b_counts)].tolist())

    def add_stretches(self, owners: np.ndarray, places: np.ndarray) -> None:
        """Adds known stretches to their documents, which ascend; a document's stretches come in order."""
        t = self.tables
        firsts = np.flatnonzero(np.diff(owners, prepend=-1))
        docs, stops = owners[firsts], np.append(firsts[1:], len(owners))
        self.numbers[:, docs] += np.add.reduceat(t.numbers[places], firsts, axis=0).T
        said, offsets = t.said.take(places)
        self._say(docs.tolist(), said, offsets[stops].tolist())
        pairs, offsets = t.pairs.take(places)
        self._pair(np.repeat(owners, np.diff(offsets) // 8), pairs.view(np.int64))

    def columns(self) -> list[pa.Array]:
        base = self.tables.n_a * self.tables.n_b
        keys, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.keys, self.times))
        if len(self.keys) > 1:
            keys, back = np.unique(keys, return_inverse=True)
            times = np.bincount(back, weights=times).astype(np.int64) if len(keys) else times
        offsets = pa.array(np.searchsorted(keys, np.arange(self.n + 1) * base).astype(np.int32))
        digests = [d.hexdigest() if begun else "" for d, begun in zip(self.digests, self.begun, strict=True)]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (keys % base, times.astype(np.int64))]
        groups = [] if self.groups is None else [pa.array([";".join(g) for g in self.groups], pa.string())]
        return [*map(pa.array, self.numbers), pa.array(digests, pa.string()), *lists, *groups]


def slice_of(tables: Vocabularies, texts: list, with_groups: bool = False) -> Slice:
    """Aligns texts stretch by stretch, each distinct one once; texts with one that is not given back as wholes."""
    tables.trim()
    done = Slice(tables, len(texts), with_groups)
    docs = np.array([k for k, text in enumerate(texts) if text], np.int64)
    if not len(docs):
        return done
    wholes = [(" " + texts[k]).encode() for k in docs]
    closes, data = np.cumsum([len(w) for w in wholes]), b"".join(wholes)
    begins = tables.bounds(data, closes)
    cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)]).dictionary_encode()
    places = tables.places(cut.dictionary.to_pylist())[cut.indices.to_numpy()]
    owners = docs[np.searchsorted(closes, begins, side="right")]
    if tables.bad[places].any():
        odd = np.isin(owners, owners[tables.bad[places]])
        for doc in np.unique(owners[odd]).tolist():
            for a, b in tables.encoded(texts[doc]):
                done.add([doc], [a], [b])
        owners, places = owners[~odd], places[~odd]
    for at in range(0, len(owners), PART):
        done.add_stretches(owners[at : at + PART], places[at : at + PART])
    return done


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, files: tuple[str, str] | None = None, with_groups: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (A id times B's ids + B id), times (and groups)."""
    files = files or default_files()
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def kernel(texts: list) -> tuple[None, list[pa.Array]]:
        return None, slice_of(vocabularies(*files), texts, with_groups).columns()

    added = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
    return map_texts(chosen, kernel, added + (", groups string" if with_groups else ""), SLICE)


def _flat(batch: pa.RecordBatch, pairs: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and number of each entry of a batch's lists."""
    lists = batch.column(pairs)
    return pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy(), batch.column(times).flatten().to_numpy()


def pair_counts(rows: DataFrame) -> DataFrame:
    """rows(pairs, times) -> pair, count: links of the corpus that hold the pair linked."""

    def added(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        names, back = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, back, np.concatenate(times))
        return names, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, size = [], [], 0
        for batch in batches:
            _, own, n = _flat(batch, 0, 1)
            pairs.append(own)
            times.append(n)
            size += len(own)
            if size > 2 * GATHERED:
                names, total = added(pairs, times)
                if len(names) > GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["pair", "count"])
                    names, total = names[:0], total[:0]
                pairs, times, size = [names], [total], len(names)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in added(pairs, times)], names=["pair", "count"])

    return rows.select("pairs", "times").mapInArrow(run, "pair bigint, count bigint").groupBy("pair").agg(F.sum("count").alias("count"))


def alignment(docs: DataFrame, files: tuple[str, str] | None = None, with_groups: bool = False, heavy: int = HEAVY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``aligned`` without the pairs, with n_best and count_sum."""
    files = files or default_files()
    spark = docs.sparkSession
    rows = materialize(aligned(docs, files, with_groups, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "aligned")
    n_b = _piece_count(files[1])
    counts = materialize(pair_counts(rows), "pair-counts").withColumn("b", F.pmod("pair", F.lit(n_b)))
    # One row for each id of B.
    most = F.broadcast(counts.groupBy("b").agg(F.max("count").alias("most")))
    counts = materialize(counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-best")
    top = counts.orderBy(F.desc("count"), "pair").limit(heavy).toPandas().sort_values("pair")  # at most ``heavy`` rows
    held = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["count"].to_numpy(np.int64), top["best"].to_numpy(bool)))
    names = [c for c in rows.columns if c not in ("pairs", "times")]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = held.value
        for batch in batches:
            at, pairs, times = _flat(batch, batch.num_columns - 2, batch.num_columns - 1)
            place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], at[hit], times[hit] * best[place[hit]])
            np.add.at(sums[1], at[hit], times[hit] * count[place[hit]])
            offsets = pa.array(np.searchsorted(at[~hit], np.arange(batch.num_rows + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(v[~hit])) for v in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *map(pa.array, sums), *rest], names=[*names, "n_best", "count_sum", "pairs", "times"])

    scored = materialize(rows.select(*names, "pairs", "times").mapInArrow(run, schema), "aligned-scored")
    rest = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    rest = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("times") * F.col("count")).alias("__sum"))
    whole = scored.drop("pairs", "times").join(rest, "row", "left")
    return whole.withColumns({"n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0))}).drop("row", "__best", "__sum")


def _piece_count(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
