"""How often each unit is drawn in each replicate, without drawing.

K draws with replacement from K units give multinomial counts.  They are split down a fixed binary tree
over the units: a node of n units with c draws passes Binomial(c, left / n) of them to its left half.  Each split is the
quantile at one uniform number, a hash of (seed, stream, root, replicate, first unit, units) and
nothing else, so any task computes the count of any unit by itself, in as many hashes as the tree is deep, and any
engine can repeat it.  Nothing is shuffled, and a task that holds few units visits few nodes.

Several roots may stand side by side: groups with their own units, or the sub-units of drawn units.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Seed streams.
BASE, CANDIDATE, SUB = 0, 1, 2
#: The replicate that draws every unit once: its estimates are those of the panel.
ITSELF = -1

# Odd 64-bit constants of the counters, and those of the splitmix64 finaliser.
SEED_WORD = 0x9E3779B97F4A7C15
STREAM_WORD = 0xC2B2AE3D27D4EB4F
ROOT_WORD = 0x165667B19E3779F9
REPLICATE_WORD = 0xD6E8FEB86659FD93
FIRST_WORD = 0xA0761D6478BD642F
SIZE_WORD = 0xE7037ED1A0B428DB
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

#: Standard deviations, and steps besides, around the mean beyond which a binomial has no weight in doubles.
REACH, MARGIN = 9, 20
#: Counts (replicates times nodes) computed at once.
AT_ONCE = 1 << 20
_FEW = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 256, dtype=float)))))


def uniform(seed: int, stream: int, root: np.ndarray, b: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, one row for each replicate and one column for each node."""
    mask = (1 << 64) - 1
    word = lambda x, w: np.asarray(x, np.int64).astype(np.uint64) * np.uint64(w)  # noqa: E731  modulo 2**64
    node = word(root, ROOT_WORD) + word(first, FIRST_WORD) + word(size, SIZE_WORD) + np.uint64((seed * SEED_WORD + stream * STREAM_WORD) & mask)
    z = word(b, REPLICATE_WORD)[:, None] + node[None, :]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[1])
    z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def log_factorial(n: np.ndarray) -> np.ndarray:
    m = np.maximum(n, 255).astype(float)
    large = m * np.log(m) - m + 0.5 * np.log(2 * np.pi * m) + 1 / (12 * m) - 1 / (360 * m**3) + 1 / (1260 * m**5)
    return np.where(n < 256, _FEW[np.minimum(n, 255)], large)


def binomial_quantile(u: np.ndarray, c: np.ndarray, left: int, n: int) -> np.ndarray:
    """Number of k in 0..c - 1 whose distribution function of Binomial(c, left / n) is below u."""
    p = left / n
    sizes, back = np.unique(c, return_inverse=True)
    spread = REACH * np.sqrt(sizes * p * (1 - p)) + MARGIN
    low = np.maximum(0, np.floor(sizes * p - spread)).astype(np.int64)
    width = int((np.minimum(sizes, np.ceil(sizes * p + spread)).astype(np.int64) - low).max()) + 1
    out = np.empty(len(c), np.int64)
    rows = max(1, AT_ONCE // width)
    for at in range(0, len(sizes), rows):
        own, start = sizes[at : at + rows, None], low[at : at + rows, None]
        k = start + np.arange(width)
        inside = np.minimum(k, own)
        mass = np.exp(log_factorial(own) - log_factorial(inside) - log_factorial(own - inside) + inside * np.log(p) + (own - inside) * np.log1p(-p))
        below = np.where(k >= own, 1.5, np.cumsum(np.where(k <= own, mass, 0.0), axis=1))
        here = (back >= at) & (back < at + rows)
        row = back[here] - at
        # Each row lies between two and three of its number, so one sorted array holds them all.
        place = np.searchsorted((below + 2.0 * np.arange(len(below))[:, None]).ravel(), u[here] + 2.0 * row)
        out[here] = place - row * width + start[row, 0]
    return out


def split(seed: int, stream: int, b: np.ndarray, counts: np.ndarray, root: np.ndarray, sizes: np.ndarray, wanted_root: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of the wanted units, in their order, a row for each replicate.

    counts: draws of each root (column) in each replicate.  root: names of the roots; sizes: their units.
    wanted_root: place of each wanted unit's root; wanted: its number there.
    """
    starts = np.cumsum(sizes) - sizes
    place, back = np.unique(starts[wanted_root] + wanted, return_inverse=True)
    first, size, name, offset = np.zeros(len(sizes), np.int64), sizes.astype(np.int64), root.astype(np.int64), starts.astype(np.int64)
    has = lambda at, n: np.searchsorted(place, at + n) > np.searchsorted(place, at)
    keep = has(offset, size)
    first, size, name, offset, counts = first[keep], size[keep], name[keep], offset[keep], counts[:, keep]
    while (size > 1).any():
        parts = np.where(size > 1, 2, 1)
        node = np.repeat(np.arange(len(size)), parts)
        right = np.concatenate(([False], node[1:] == node[:-1]))
        half = size // 2
        left = counts.copy()
        for n in np.unique(size[size > 1]):
            which = np.flatnonzero(size == n)
            u = uniform(seed, stream, name[which], b, first[which], size[which])
            left[:, which] = binomial_quantile(u.ravel(), counts[:, which].ravel(), int(n) // 2, int(n)).reshape(u.shape)
        made = np.where(right[None, :], counts[:, node] - left[:, node], left[:, node])
        grown = np.where(size[node] == 1, 1, np.where(right, size[node] - half[node], half[node]))
        moved = np.where(right, half[node], 0)
        first, offset, name = first[node] + moved, offset[node] + moved, name[node]
        keep = has(offset, grown)
        first, size, name, offset, counts = first[keep], grown[keep], name[keep], offset[keep], made[:, keep]
    return counts[:, back]


#: Columns that say what is drawn.  unit_ix: number of the unit; k: units of its group; group: place of the group.
UNIT = ("unit_ix", "k")
#: Besides, for a second stage: a name of the unit's list of sub-units, number within it, its length.
WITHIN = ("root", "sub_ix", "n_subs")


def weights(seed: int, stream: int, b: np.ndarray, leaves: pd.DataFrame, group: np.ndarray | None = None, apart: bool = False) -> np.ndarray:
    """How often each replicate draws each row of ``leaves`` (``UNIT``, and ``WITHIN`` for two stages).

    group: number of each row's group.  A group's draws are those that it would have alone, or with ``apart``
    differ by the number.
    """
    if not len(leaves):
        return np.zeros((len(b), 0), np.int64)
    group = np.zeros(len(leaves), np.int64) if group is None else group
    names, at, mine = np.unique(group, return_index=True, return_inverse=True)
    sizes = leaves["k"].to_numpy(np.int64)[at]
    unit = leaves["unit_ix"].to_numpy(np.int64)
    whole = np.broadcast_to(sizes, (len(b), len(sizes)))
    drawn = split(seed, stream, b, whole, names if apart else np.zeros(len(sizes), np.int64), sizes, mine, unit)
    if "root" in leaves:
        _, at, mine = np.unique(leaves["root"].to_numpy(np.int64), return_index=True, return_inverse=True)
        sizes = leaves["n_subs"].to_numpy(np.int64)[at]
        drawn = split(seed, SUB + stream, b, drawn[:, at] * sizes, 1 + leaves["root"].to_numpy(np.int64)[at], sizes, mine, leaves["sub_ix"].to_numpy(np.int64))
    drawn = drawn.copy()
    drawn[b == ITSELF] = 1
    return drawn


def multiplicity_sql(name: str, seed: int, stream: int, roots: str, keys: str = "b", depth: int = 12) -> str:
    """Common table expressions ending in ``name``({keys}, root, unit_ix, w), the same counts in SQL, for roots of up to 2 ** depth units.

    roots: a query giving keys (one of them b), root, n (units) and c (draws).
    """
    mix = lambda z, shift, word: f"((xor({z}, {z} >> {shift})::UHUGEINT * {word}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    fixed = (seed * SEED_WORD + stream * STREAM_WORD) % (1 << 64)
    word = f"((root::HUGEINT * {ROOT_WORD} + b::HUGEINT * {REPLICATE_WORD} + lo::HUGEINT * {FIRST_WORD} + n::HUGEINT * {SIZE_WORD} + {fixed}::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT"
    steps = [f"{name}_0 AS (SELECT {keys}, root::BIGINT AS root, 0::BIGINT AS lo, n::BIGINT AS n, c::BIGINT AS c FROM ({roots}))"]
    for i in range(depth):
        at, u, q, to = f"{name}_{i}", f"{name}_u{i}", f"{name}_q{i}", f"{name}_{i + 1}"
        steps += [
            f"{u} AS (SELECT *, n // 2 AS nl, {word} AS z0, {mix('z0', 30, MIX[0])} AS z1, {mix('z1', 27, MIX[1])} AS z2, ((xor(z2, z2 >> 31) >> 11)::DOUBLE + 0.5) / 9007199254740992.0::DOUBLE AS u FROM {at})",
            f"{q} AS (SELECT c, n, sum(mass) OVER (PARTITION BY c, n ORDER BY j) AS f FROM (SELECT c, n, j, exp(lgamma(c + 1) - lgamma(j + 1) - lgamma(c - j + 1) + j * ln(nl::DOUBLE / n) + (c - j) * ln(1 - nl::DOUBLE / n)) AS mass FROM (SELECT DISTINCT c, n, nl FROM {u} WHERE n > 1 AND c > 0), LATERAL (SELECT unnest(range(c)) AS j)))",
            f"{name}_l{i} AS (SELECT {keys}, root, lo, n, nl, c, (SELECT count(*) FROM {q} q WHERE q.c = x.c AND q.n = x.n AND q.f < x.u) AS l FROM {u} x WHERE n > 1)",
            f"{to} AS (SELECT {keys}, root, lo, nl AS n, l AS c FROM {name}_l{i} UNION ALL SELECT {keys}, root, lo + nl, n - nl, c - l FROM {name}_l{i} UNION ALL SELECT {keys}, root, lo, n, c FROM {at} WHERE n = 1)",
        ]
    return ", " + ", ".join([*steps, f"{name} AS (SELECT {keys}, root, lo AS unit_ix, c AS w FROM {name}_{depth} WHERE c > 0)"])
