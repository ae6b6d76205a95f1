"""Suffix array of a byte shard by induced sorting, and its permuted common prefixes.

Suffixes are classified as larger or smaller than their right neighbour, the leftmost-smaller
substrings are sorted by inducing from their first letters and named, the string of names is
sorted in turn by the same function, and the whole array is induced from it. Inducing walks
over the buckets of the alphabet; what one bucket sends on is placed in one array operation,
so the walk is linear in the text and short in Python. Names are written as two digits each,
which keeps the alphabet as small as the square root of their number: suffixes that start at
a first digit have the order of the names' suffixes. No two neighbours are leftmost-smaller,
so the string of digits is always shorter than the one before. Where it is short, and a walk
would be all overhead, the recursion ends in a doubling of ranks.
"""

from __future__ import annotations

import numpy as np

END, GAP = 0, 1
# Letters compared in one go.
BLOCK = 1 << 18
# Names whose digits are fewer are sorted by doubling.
SHORT = 1 << 18


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a shard (bytes from 2, a gap after each part, one end) and the parts' starts."""
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    letters = np.zeros(int(sizes.sum()) + 1, np.int16)
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    letters[:-1] = raw
    letters[:-1] += 2
    ends = np.cumsum(sizes) - 1
    letters[ends] = GAP
    return letters, ends - sizes + 1


def smaller_types(letters: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last one is by definition."""
    n = len(letters)
    step = np.sign(letters[1:] - letters[:-1])
    # Equal neighbours have the type of the next position that differs.
    after = np.arange(n - 1, dtype=np.int32)
    after[step == 0] = n
    after = np.minimum.accumulate(after[::-1])[::-1]
    types = np.ones(n, bool)
    types[:-1] = step[np.minimum(after, n - 2)] > 0
    return types


class Inducer:
    """Buckets and types of a shard."""

    def __init__(self, letters: np.ndarray):
        self.letters = letters
        self.smaller = smaller_types(letters)
        self.leftmost = self.smaller.copy()
        self.leftmost[0] = False
        self.leftmost[1:] &= ~self.smaller[:-1]
        counts = np.bincount(letters)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.present = np.flatnonzero(counts)

    def send(self, array, fill, found, smaller: bool) -> None:
        """Places what stands before ``found`` into its buckets, in that order."""
        before = found[found > 0] - 1
        before = before[self.smaller[before] == smaller]
        if not len(before):
            return
        letters = self.letters[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        first = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
        sizes = np.diff(np.append(first, len(letters)))
        within = np.arange(len(letters)) - np.repeat(first, sizes)
        if smaller:
            array[fill[letters] - 1 - within] = before
            fill[letters[first]] -= sizes
        else:
            array[fill[letters] + within] = before
            fill[letters[first]] += sizes

    def induce(self, leftmost: np.ndarray) -> np.ndarray:
        """The array induced from leftmost-smaller positions in the given order."""
        array = np.full(len(self.letters), -1, np.int32)
        letters = self.letters[leftmost]
        order = np.argsort(letters, kind="stable")
        counts = np.bincount(letters, minlength=len(self.ends))
        firsts = np.cumsum(counts) - counts
        sorted_letters = letters[order]
        array[(self.ends - counts - firsts)[sorted_letters] + np.arange(len(order))] = leftmost[order]
        heads = self.starts.copy()
        for c in self.present:
            done = self.starts[c]
            while done < heads[c]:
                wave, done = array[done : heads[c]], heads[c]
                self.send(array, heads, wave, False)
            if counts[c]:
                self.send(array, heads, array[self.ends[c] - counts[c] : self.ends[c]], False)
        tails = self.ends.copy()
        for c in self.present[::-1]:
            done = self.ends[c]
            while done > tails[c]:
                wave, done = array[tails[c] : done][::-1], tails[c]
                self.send(array, tails, wave, True)
            self.send(array, tails, array[self.starts[c] : heads[c]][::-1], True)
        array[0] = len(self.letters) - 1
        return array

    def names(self, ordered: np.ndarray) -> np.ndarray:
        """Names of leftmost-smaller substrings in their sorted order: equal ones share a name."""
        places = np.flatnonzero(self.leftmost)
        length = np.ones(len(self.letters), np.int32)
        length[places[:-1]] = np.diff(places) + 1
        same = length[ordered[:-1]] == length[ordered[1:]]
        pairs = np.flatnonzero(same)
        # Substrings are compared about ``BLOCK`` letters at a time.
        ends = np.cumsum(length[ordered[pairs]], dtype=np.int64)
        cuts = np.searchsorted(ends, np.arange(BLOCK, int(ends[-1]) if len(ends) else 0, BLOCK))
        for some in np.split(pairs, np.unique(cuts)):
            if not len(some):
                continue
            a, b = ordered[some], ordered[some + 1]
            sizes = length[a]
            first = np.cumsum(sizes, dtype=np.int32) - sizes
            within = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first, sizes)
            equal = self.letters[np.repeat(a, sizes) + within] == self.letters[np.repeat(b, sizes) + within]
            same[some] = np.logical_and.reduceat(equal, first)
        return np.concatenate([[0], np.cumsum(~same, dtype=np.int32)])


def two_digits(names: np.ndarray) -> np.ndarray:
    """Each name as two digits from 1, and an end."""
    base = int(np.ceil(np.sqrt(int(names.max()) + 1)))
    letters = np.zeros(2 * len(names) + 1, np.int16 if base < 32000 else np.int32)
    letters[0:-1:2] = names // base + 1
    letters[1:-1:2] = names % base + 1
    return letters


def doubled(ranks: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a short string, by ranks of prefixes of doubling length."""
    n, width = len(ranks), 1
    ranks = ranks.astype(np.int64) + 1
    while True:
        keys = ranks * (n + 2)
        keys[: n - width] += ranks[width:]
        order = np.argsort(keys)
        new = np.concatenate([[0], np.cumsum(keys[order][1:] != keys[order][:-1])]) + 1
        ranks = np.empty(n, np.int64)
        ranks[order] = new
        if new[-1] == n:
            return order
        width = min(2 * width, n)


def sorted_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names."""
    if 2 * len(names) < SHORT:
        return doubled(names)
    array = suffix_array(two_digits(names))
    return array[(array % 2 == 0) & (array < 2 * len(names))] // 2


def suffix_array(letters: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; the last letter is the only ``END``."""
    inducer = Inducer(letters)
    leftmost = np.flatnonzero(inducer.leftmost).astype(np.int32)
    if not len(leftmost):
        return np.arange(len(letters) - 1, -1, -1, dtype=np.int32)
    rough = inducer.induce(leftmost)
    ordered = rough[inducer.leftmost[rough]]
    del rough
    names = inducer.names(ordered)
    if names[-1] + 1 < len(names):
        by_place = np.empty(len(letters), np.int32)
        by_place[ordered] = names
        string = by_place[leftmost]
        del by_place, names, ordered
        ordered = leftmost[sorted_names(string)]
    return inducer.induce(ordered)


def common_prefixes(letters: np.ndarray, array: np.ndarray, starts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, before): for each position the common prefix with the suffix sorted before it.

    A value is one less than that of the position to its left unless the letters to the left
    differ; only at those places, and at the starts of parts, letters are compared. Values
    are exact up to ``limit`` within a part.
    """
    n = len(letters)
    before = np.empty(n, np.int32)
    before[array[1:]] = array[:-1]
    before[array[0]] = -1
    irreducible = np.ones(n, bool)
    inner = np.flatnonzero(before[1:] > 0).astype(np.int32) + 1
    irreducible[inner] = letters[inner - 1] != letters[before[inner] - 1]
    irreducible[starts] = True
    del inner
    places = np.flatnonzero(irreducible).astype(np.int32)
    found = np.zeros(len(places), np.int32)
    padded = np.concatenate([letters, np.full(4 + limit, END, np.int16)])
    words = np.ndarray((n + limit,), "<u8", padded.data, strides=(2,))
    live = np.flatnonzero(before[places] >= 0).astype(np.int32)
    at = 0
    while len(live) and at < limit:
        a, b = places[live] + at, before[places[live]] + at
        inside = (a < n) & (b < n)
        differ = np.where(inside, words[np.minimum(a, n)] ^ words[np.minimum(b, n)], np.uint64(1))
        equal = differ == 0
        rest = differ[~equal]
        # Letters are 16 bits: the lowest differing one ends the prefix.
        low = (rest & (~rest + np.uint64(1))).astype(np.float64)
        found[live[~equal]] = at + (np.log2(low).astype(np.int32) // 16)
        live = live[equal]
        at += 4
    found[live] = limit
    # From one irreducible place to the next, values fall by one.
    sizes = np.diff(np.append(places, n))
    found += places
    prefix = np.repeat(found, sizes)
    prefix -= np.arange(n, dtype=np.int32)
    return prefix, before


def repeated_windows(parts: list[bytes], window: int) -> list[np.ndarray]:
    """For each part which of its windows also start somewhere else, in this or another part."""
    letters, starts = joined(parts)
    array = suffix_array(letters)
    longest = max(map(len, parts), default=0)
    prefix, before = common_prefixes(letters, array, starts, longest + 4)
    n = len(letters)
    del letters, array
    hit = prefix >= window
    del prefix
    for start, part in zip(starts, parts, strict=True):
        # No window starts in a part's last bytes.
        hit[start + max(0, len(part) - window + 1) : start + len(part) + 1] = False
    marked = np.zeros(n, bool)
    marked[before[hit]] = True
    marked |= hit
    return [
        marked[start : start + max(0, len(part) - window + 1)] for start, part in zip(starts, parts, strict=True)
    ]
