"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns near hits, checksum validation.

One automaton pass over the text (A-Z in lower case) finds keywords; a pattern is only
tried, anchored, at a hit.  Long hexadecimal runs carry no keyword: a byte mask finds
them.  Tokens with an embedded checksum (the last six base-62 digits are the CRC-32 of
the body) are reported only if it holds.

Kinds: ``assign``, ``access``, ``hex`` (leftmost, non-overlapping within the kind, exact
definitions in the patterns below), then the checksummed ``github`` and ``npm``.

Spans are (kind, start, end) in code points of the original text, end exclusive.
Defined results: null text counts as empty; a text without secrets has no spans; rows
are independent, so repeated rows repeat their result; other columns are ignored.
Every row is handled on its own in one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.arrow import map_texts

# The formats that are looked for.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex", "github", "npm")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_MATCHER = _automaton()


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` in six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits


def _checked(pattern: re.Pattern, text: str, at: int) -> tuple[int, bool]:
    m = pattern.match(text, at)
    return (m.end(), base62_crc(m[1]) == m[2]) if m else (at, False)


def _tried(kind: str, text: str, at: int) -> tuple[int, bool]:
    """End of the match that starts there (``at`` if none) and whether it counts."""
    if kind == "assign":
        m = ASSIGN.match(text, at)
        return (m.end(), len(m[2]) >= ASSIGN_VALUE) if m else (at, False)
    if kind == "access":
        m = ACCESS.match(text, at)
        return (m.end(), m.end() - at >= ACCESS_LENGTH) if m else (at, False)
    return _checked(GITHUB if kind == "github" else NPM, text, at)


def _hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Byte ranges of maximal runs of lower-case hexadecimal digits, long enough ones."""
    mask = _HEX[np.frombuffer(data, np.uint8)]
    # A long run covers several consecutive samples at an eighth of its least length and more.
    step = HEX_LENGTH // 3
    sample = mask[::step]
    if len(data) < HEX_LENGTH or not (sample[:-1] & sample[1:]).any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= HEX_LENGTH
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind as listed in ``KINDS``."""
    if not text:
        return []
    spans, free = [], dict.fromkeys(KINDS, 0)
    data = text.encode("utf-8", "surrogatepass")
    lowered = data.lower().decode("utf-8", "surrogatepass")
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in _MATCHER.iter(lowered))
    for start, kind in hits:
        if start >= free[kind]:
            end, counts = _tried(kind, text, start)
            if end > start:
                free[kind] = end
            if counts:
                spans.append((kind, start, end))
    runs = _hex_runs(data)
    if runs and len(data) > len(text):  # bytes before a run that continue a character count for nothing
        more = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)
        runs = [(start - int(more[start]), end - int(more[start])) for start, end in runs]
    spans += [("hex", start, end) for start, end in runs]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and spans, an array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scanned(texts: list) -> tuple[None, list[pa.Array]]:
        return None, [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in texts], kind)]

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_texts(chosen, scanned, "spans array<struct<kind: string, start: bigint, end: bigint>>")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as text."""
    found = find_secrets(docs)
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
    )
