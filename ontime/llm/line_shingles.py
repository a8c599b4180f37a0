"""Character shingles of lines in numpy: their hashes, minima, and which lines of a group are similar."""

import numpy as np

from ontime.llm.common import blocks

WIDTH = 8  #: characters of a shingle
HASHES, BAND = 24, 3  #: minima, and minima of a band
BLOCK = 1 << 14  #: shingles that are hashed at once
FEW = 8  #: rows of a group that are compared in pairs, without an index
PAIRS, PAIR = 4096, 64  #: pairs that are compared at once, if they have so many shingles on average; fewer of longer lines

_PAD = 0x110000  # no character
_random = np.random.default_rng(20_240_501)
_NEXT = _random.integers(0, 1 << 63, 3, np.uint64) * np.uint64(2) + np.uint64(1)
_SEED, _TIMES = (_random.integers(0, 1 << 63, HASHES // 2, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HALF, _LOW = np.uint64(32), np.uint64((1 << 32) - 1)
_HELD = np.uint64(14)  # bits of a shingle that give way to the number of its pair


def _mix(x: np.ndarray, times: np.uint64) -> np.ndarray:
    """64 bits of which each depends on all, in place."""
    x *= times
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all lines, one after the other, and where each line's start and the last ends."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    full = np.maximum(sizes, WIDTH)
    ends = np.concatenate([[0], np.cumsum(full)])
    whole = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    if (sizes < WIDTH).any():
        codes = np.full(ends[-1], _PAD, np.uint64)
        within = np.arange(ends[-1]) - np.repeat(ends[:-1], full)
        codes[within < np.repeat(sizes, full)] = whole
    else:
        codes = whole.astype(np.uint64)
    for k in range(3):  # of 1, 2, 4 and at last 8 characters
        step = 1 << k
        codes = codes[:-step] * _NEXT[k] + codes[step:] if len(codes) > step else codes[:0]
    starts = ends - np.arange(len(ends)) * (WIDTH - 1)
    inner = np.ones(len(codes), bool)  # not across the end of a line
    for k in range(1, WIDTH):
        inner[ends[1:-1] - k] = False
    hashes = _mix(codes[inner], _SEED[0])
    hashes ^= hashes >> _HALF
    return hashes, starts


def minima(lines: list[str]) -> np.ndarray:
    """The ``HASHES`` minima of each line, 32 bits each. A shingle is hashed anew for each two of them."""
    out = np.empty((len(lines), HASHES), np.uint64)
    first = 0
    while first < len(lines):
        last, held = first, 0
        while last < len(lines) and (last == first or held + len(lines[last]) <= BLOCK):
            held += max(len(lines[last]), WIDTH)
            last += 1
        hashes, starts = shingles(lines[first:last])
        for k in range(HASHES // 2):
            x = _mix(hashes ^ _SEED[k], _TIMES[k])
            out[first:last, 2 * k] = np.minimum.reduceat(x >> _HALF, starts[:-1])
            x &= _LOW
            out[first:last, 2 * k + 1] = np.minimum.reduceat(x, starts[:-1])
        first = last
    return out.view(np.int64)


def buckets(signed: np.ndarray) -> np.ndarray:
    """One number for each band of each line: equal where all its minima and the band are."""
    made = []
    for band in range(HASHES // BAND):
        x = np.full(len(signed), band + 1, np.uint64)
        for k in range(BAND):
            x = _mix(x ^ signed[:, band * BAND + k].astype(np.uint64) + _SEED[0], _TIMES[k])
            x ^= x >> _HALF
        made.append(x.view(np.int64))
    return np.stack(made, 1)


class Sets:
    """The different shingles of lines, in order, one line after the other."""

    def __init__(self, lines: list[str]):
        hashes, starts = shingles(lines)
        row = np.repeat(np.arange(len(lines)), np.diff(starts))
        # Lines in blocks, as a line's number and the hash share 64 bits.
        parts, self.sizes = [], np.zeros(len(lines), np.int64)
        for first in range(0, len(lines), 1 << 14):
            span = slice(*starts[[first, min(first + (1 << 14), len(lines))]])
            made = _different(row[span] - first, hashes[span])
            self.sizes += np.bincount((made >> np.uint64(50)).astype(np.int64) + first, minlength=len(lines))
            parts.append(made << _HELD)
        self.flat = np.concatenate(parts) if parts else hashes
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])

    def __getitem__(self, row: int) -> np.ndarray:
        return self.flat[self.ends[row] : self.ends[row + 1]]

    def _of(self, rows: np.ndarray) -> np.ndarray:
        """The shingles of some lines, below each one's place among them."""
        sizes = self.sizes[rows]
        at = np.arange(sizes.sum()) + np.repeat(self.ends[rows] - np.cumsum(sizes) + sizes, sizes)
        return np.repeat(np.arange(len(rows), dtype=np.uint64) << np.uint64(50), sizes) | self.flat[at] >> _HELD

    def similar(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of lines have a Jaccard similarity of 0.8 or more, in whole numbers."""
        near = np.zeros(len(left), bool)
        a, b = self.sizes[left], self.sizes[right]
        fit = np.flatnonzero((5 * a >= 4 * b) & (5 * b >= 4 * a))
        for part in blocks(np.maximum(a + b, PAIR)[fit].tolist(), PAIRS * PAIR):
            some = fit[part]
            both = np.sort(np.concatenate([self._of(left[some]), self._of(right[some])]))
            twice = both[1:][both[1:] == both[:-1]] >> np.uint64(50)
            shared = np.bincount(twice.astype(np.int64), minlength=len(some))
            near[some] = 5 * shared >= 4 * (a[some] + b[some] - shared)
        return near


def _different(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Each row's different hashes, in order: the row above 50 bits of the hash."""
    both = np.sort(row.astype(np.uint64) << np.uint64(50) | hashes >> _HELD)
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def _joining(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The pairs that join up what earlier ones don't."""
    root, kept = list(range(n)), []
    for i, j in pairs:
        a, b = i, j
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def few_pairs(block: list[int], far: list[bool]) -> list[tuple[int, int]]:
    """The pairs of a small group to look at: of which one at least is far, and between its blocks if there are two."""
    two = len(set(block)) > 1
    n = len(far)
    return [(i, j) for i in range(n) for j in range(i + 1, n) if (far[i] or far[j]) and not (two and block[i] == block[j])]


def group_links(members: Sets, block: list[int], far: list[bool]) -> list[tuple[int, int]]:
    """Links that join up what is similar among the members of a bucket, of which one at least is ``far``.

    Pairs are looked at within a block if there is one block only, else between the two. In
    larger groups, similar sets must share one of their rarest fifth of shingles, so only those that do are compared.
    """
    if len(far) <= FEW:
        pairs = np.array(few_pairs(block, far), np.int64).reshape(-1, 2)
        return _joining(pairs[members.similar(*pairs.T)].tolist(), len(far))
    two, side = len(set(block)) > 1, np.array(block)
    sizes, n = members.sizes, len(far)
    # Shingles that one member alone has come first in any order by rarity, and never matter again.
    both = np.sort(members.flat | np.repeat(np.arange(n, dtype=np.uint64), sizes))
    number = np.cumsum(np.concatenate([[False], both[1:] >> _HELD != both[:-1] >> _HELD]))
    often = np.bincount(number)
    rarity = np.empty(len(often), np.uint64)
    rarity[np.argsort(often, kind="stable")] = np.arange(len(often), dtype=np.uint64)
    shared = often[number] > 1
    both = np.sort((both[shared] & np.uint64((1 << 14) - 1)) << _HALF | rarity[number[shared]])
    row, token = (both >> _HALF).astype(np.int64), (both & _LOW).astype(np.int64)
    ends = np.searchsorted(row, np.arange(n + 1))
    held = np.diff(ends)
    place = np.arange(len(row)) - ends[row] + (sizes - held)[row]
    rare = place < (sizes - (4 * sizes + 4) // 5 + 1)[row]
    rare_row, rare_token = row[rare], token[rare]
    by_row = np.searchsorted(rare_row, np.arange(n + 1))
    by_token = np.argsort(rare_token, kind="stable")
    sorted_token, sorted_row = rare_token[by_token], rare_row[by_token]
    low, high = np.searchsorted(sorted_token, rare_token), np.searchsorted(sorted_token, rare_token, side="right")
    found, joined = [], np.arange(n)  # the component of each row
    mine = np.zeros(len(often), np.int64)
    for i in np.flatnonzero(far).tolist():
        span = slice(by_row[i], by_row[i + 1])
        met = np.zeros(n, bool)
        for a, b in zip(low[span].tolist(), high[span].tolist(), strict=True):
            met[sorted_row[a:b]] = True
        met &= (joined != joined[i]) & (5 * held >= 4 * sizes[i]) & (5 * held[i] >= 4 * sizes)
        if two:
            met &= side != block[i]
        others = np.flatnonzero(met)
        if not len(others):
            continue
        spans = held[others]
        starts = np.cumsum(spans) - spans
        mine[token[ends[i] : ends[i + 1]]] = 1
        both = np.add.reduceat(mine[token[np.arange(spans.sum()) + np.repeat(ends[others] - starts, spans)]], starts)
        mine[token[ends[i] : ends[i + 1]]] = 0
        for j in others[5 * both >= 4 * (sizes[i] + sizes[others] - both)].tolist():
            if joined[j] != joined[i]:
                joined[joined == joined[j]] = joined[i]
                found.append((i, j))
    return found
