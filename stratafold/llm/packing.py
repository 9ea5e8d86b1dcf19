"""Packing token sequences by best-fit decreasing.

A document is its token ids and one closing id 0.  Overlong documents are first cut
into full windows; what remains of each document is a tail shorter than a window.
Tails go, longest first, into the open window with the least sufficient room, found by
a segment tree over remaining capacities.

Tokenising is the costly step, is done once in a map over the documents and its result
(one small row per piece) is written to the shared folder.  Pieces are then dealt at
random into shards of about ``SHARD`` pieces, each packed in one task: the last, partly
filled windows of a shard are its only loss, a fixed number per shard.

Defined results: null text counts as empty, so it is the single id 0; strings of special
tokens are those tokens, as the tokenizer reads them; repeated rows are packed each; a null id stays null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.arrow import map_texts
from stratafold.scratch import materialize

WINDOW = 1024
#: Pieces packed together in one task.
SHARD = 32768
#: Texts with a longer stretch without a space go to the reference encoder, whose time does not grow with its square.
LONG_STRETCH = 2000


def byte_of() -> dict[str, int]:
    """The usual byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE file, as ``tokenizers`` gives them without adding special tokens.

    Strings of special tokens that stand in a text are those tokens, or with ``plain`` ordinary text.  A faster encoder
    built from the same vocabulary does ordinary texts.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = plain
        self.fast = None
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        added = parts.get("added_tokens") or ()
        special = {t["content"]: t["id"] for t in added}
        self.special = () if plain else tuple(special)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the usual byte-level split
        split = parts.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not parts.get("normalizer")
        usual = usual and not any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip"))
        if usual and parts["model"].get("type") == "BPE":
            alphabet = byte_of()
            ranks = {bytes(alphabet[c] for c in t): i for t, i in parts["model"]["vocab"].items() if t not in special}
            merges = [m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"]]
            merged = [parts["model"]["vocab"][a + b] for a, b in merges]
            if len(ranks) == 256 + len(merged) and merged == sorted(merged):  # then ranks say as much as the list of merges
                self.fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or len(text) > LONG_STRETCH and max(map(len, text.split(" "))) > LONG_STRETCH:
            return self.slow.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str, plain: bool = False) -> Encoder:
    """One per Python worker, file and reading of special tokens."""
    return Encoder(path, plain)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and ids, 4 bytes each)."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def cut(texts: list) -> tuple[list[int], list[pa.Array]]:
        encode = encoder(tokenizer)
        index, out = [], []
        for k, words in enumerate(texts):
            ids = np.array([*encode(words or ""), 0], "<u4")
            for start in range(0, len(ids), window):
                data = ids[start : start + window].tobytes()
                index.append(k)
                out.append((start, len(data) // 4, zlib.crc32(data), len(ids), data))
        columns = list(zip(*out, strict=True)) or [()] * 5
        return index, [*(pa.array(c, pa.int64()) for c in columns[:4]), *([pa.array(columns[4], pa.binary())] if with_ids else [])]

    added = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids binary" if with_ids else "")
    return map_texts(chosen, cut, added)


class Rooms:
    """Open windows by remaining capacity; a segment tree counts the windows below each node."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, name: int) -> None:
        self.open[room].append(name)
        at = self.size + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``: its room and its name."""
        at = self.size + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces are at most one window long."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms, opened = Rooms(window), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = rooms.take(need)
        if found is None:
            found, opened = (window, opened), opened + 1
        room, name = found
        number[k], offset[k] = name, window - room
        if room > need:
            rooms.put(room - need, name)
    return number, offset


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard: int = SHARD, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``token_pieces`` with sequence_id and offset for every piece."""
    cut = token_pieces(docs, tokenizer or default_tokenizer(), window, with_ids, doc_id, text)
    pieces = materialize(cut.withColumn("piece", F.monotonically_increasing_id()), "pack-pieces")
    shards = max(1, -(-pieces.count() // shard))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "piece"], ascending=[False, True], kind="stable")
        number, offset = best_fit_decreasing(group["length"].to_numpy(), window)
        return group.assign(sequence_id=(group["shard"].to_numpy() << 32) + number, offset=offset)[["piece", "sequence_id", "offset"]]

    small = pieces.select("piece", "length", F.pmod(F.xxhash64("piece"), F.lit(shards)).alias("shard"))
    placed = small.groupBy("shard").applyInPandas(packed, "piece bigint, sequence_id bigint, offset bigint")
    return pieces.join(placed, "piece").drop("piece")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> one row per sequence: sequence_id, ids (4 bytes each), length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return whole.select("sequence_id", joined.alias("ids"), "length")
