"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classified as S (smaller than the next one) or L.  The leftmost S
suffixes (LMS) are put in the order of their substrings by one induction, named, and the
string of names is sorted by recursion, unless all names differ; from the order of the LMS suffixes a second induction
gives all suffixes.  A string of few letters is induced letter by letter and, within one, by
generations, so every step is an array operation on all suffixes that are induced at once.  A string of names has too many
letters for that: there an L suffix is ranked by its letters up to the next LMS suffix and the rank of that, and then an S
suffix by its letters up to the next L suffix and the rank of that.  The letters of such a chain are joined two, four, eight
at a time.
"""

from __future__ import annotations

import numpy as np

LETTERS = 256  # a string of at most so many is induced letter by letter


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last suffix is L: the end counts as smaller than any letter."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])  # last place of each run but the final one
    rising = np.zeros(len(differs) + 1, bool)
    rising[:-1] = s[differs] < s[differs + 1]
    return np.repeat(rising, np.diff(np.concatenate([[-1], differs, [n - 1]])))


def deal(lists: dict, places: np.ndarray, letters: np.ndarray) -> None:
    """Appends places to the lists of their letters, in order."""
    if not len(places):
        return
    order = np.argsort(letters, kind="stable")
    places, letters = places[order], letters[order]
    cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    for part, letter in zip(np.split(places, cuts), letters[np.concatenate([[0], cuts])].tolist()):
        lists.setdefault(letter, []).append(part)


def induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, letters: list[int]) -> np.ndarray:
    """All suffixes from LMS suffixes that are in order within each letter."""
    none = np.zeros(0, lms.dtype)
    start: dict = {}
    deal(start, lms, s[lms])
    waiting: dict = {int(s[-1]): [np.array([len(s) - 1], lms.dtype)]}
    left: dict[int, np.ndarray] = {}

    def preceding(places, want_s):
        before = places[places > 0] - 1
        return before[is_s[before] == want_s]

    for c in letters:
        now, all_of = np.concatenate(waiting.pop(c, [none])), []
        while len(now):
            all_of.append(now)
            before = preceding(now, False)
            same = s[before] == c
            now = before[same]
            deal(waiting, before[~same], s[before[~same]])
        left[c] = np.concatenate(all_of) if all_of else none
        for part in start.get(c, []):
            before = preceding(part, False)
            deal(waiting, before, s[before])
    right: dict[int, np.ndarray] = {}
    for c in reversed(letters):  # from the largest suffix down
        now, all_of = np.concatenate(waiting.pop(c, [none])), []
        while len(now):
            all_of.append(now)
            before = preceding(now, True)
            same = s[before] == c
            now = before[same]
            deal(waiting, before[~same], s[before[~same]])
        right[c] = np.concatenate(all_of) if all_of else none
        before = preceding(left[c][::-1], True)
        deal(waiting, before, s[before])
    return np.concatenate([x for c in letters for x in (left[c], right[c][::-1])])


def names_of(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """(names of the LMS substrings in text order, number of names); ``ordered`` has the LMS places by substring."""
    ends = np.empty(len(s) + 1, np.int64)
    ends[lms] = np.append(lms[1:], len(s) - 1)  # a substring reaches to the next LMS place, inclusive
    a, b = ordered[:-1], ordered[1:]
    size_a, size_b = ends[a] - a, ends[b] - b
    differ = size_a != size_b
    differ |= (ends[a] == len(s) - 1) | (ends[b] == len(s) - 1)  # the last one ends in the end of the text
    active, k = np.flatnonzero(~differ), 0
    while len(active):
        unequal = s[a[active] + k] != s[b[active] + k]
        differ[active[unequal]] = True
        active = active[~unequal]
        k += 1
        active = active[k <= size_a[active]]
    name = np.concatenate([[0], np.cumsum(differ)])
    by_place = np.empty(len(s), np.int64)
    by_place[ordered] = name
    return by_place[lms], int(name[-1]) + 1


def dense(key: np.ndarray) -> np.ndarray:
    """The rank of each key among the different keys, from 0."""
    order = np.argsort(key)
    out = np.empty(len(key), np.int64)
    key = key[order]
    out[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    return out


def chain_ranks(key: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The rank of each entry by the keys of the chain that starts there: the number of smaller entries. The last entry of a
    chain follows itself, and its key is not the key of an entry before the end of a chain. Entries that differ from all others
    and entries whose keys are all compared are left alone."""
    n = len(key)
    active = np.argsort(key)
    new = starts(key[active])
    rank, following = np.empty(n, np.int64), following.copy()
    rank[active] = first_places(new)
    active = active[~alone(new) & (following[active] != active)]
    while len(active):  # all of a group of equal rank, or none of it
        both = rank[active] * n + rank[following[active]]
        order = np.argsort(both)
        active, both = active[order], both[order]
        old, new = rank[active], starts(both)
        rank[active] = old - first_places(starts(old)) + first_places(new)
        further = following[active]
        active = active[~alone(new) & (following[further] != further)]
        following[active] = following[following[active]]
    return rank


def starts(ordered: np.ndarray) -> np.ndarray:
    """True for the first of equal entries."""
    return np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)]


def first_places(new: np.ndarray) -> np.ndarray:
    """For each entry the place of the first one of its group."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def alone(new: np.ndarray) -> np.ndarray:
    return new & np.append(new[1:], True)


def ranks_by_chains(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, lms_rank: np.ndarray) -> np.ndarray:
    """The rank of every suffix, induced from the ranks of the LMS suffixes: equal ones give equal ranks to suffixes that are
    alike as far as that tells."""
    n = len(s)
    letter = s.astype(np.int64) * 2 + is_s  # of suffixes with one first letter, the L suffixes are smaller
    out = np.empty(n, np.int64)

    def induced(places, last, ranks):
        """Ranks of places followed by others of them, where ``last``, with their ranks, end the chains."""
        number = np.full(n + 1, len(places), np.int64)  # the end of the text is the last entry
        number[places] = np.arange(len(places))
        following = number[places + 1]
        following[number[last]] = number[last]
        key = np.append((letter[places] + 1) * (n + 2), 0)
        key[number[last]] += ranks + 1
        return chain_ranks(key, np.append(following, len(places)))[:-1]

    chained = ~is_s
    chained[lms] = True
    places = np.flatnonzero(chained)
    out[places] = induced(places, lms, lms_rank)
    falling = np.flatnonzero(~is_s)
    everything = np.arange(n)
    return induced(everything, falling, out[falling])


def induced_array(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, lms_rank: np.ndarray) -> np.ndarray:
    return np.argsort(ranks_by_chains(s, is_s, lms, lms_rank)).astype(lms.dtype)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes of a string of letters from 0 on, an integer array, in order."""
    n = len(s)
    kind = np.int32 if n < 1 << 31 else np.int64
    if n < 2:
        return np.arange(n, dtype=kind)
    is_s = suffix_types(s)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(kind)
    letters = np.flatnonzero(np.bincount(s)).tolist()
    few = len(letters) <= LETTERS
    if len(lms) < 2:
        return induce(s, is_s, lms, letters) if few else induced_array(s, is_s, lms, np.zeros(len(lms), np.int64))
    if few:
        first = induce(s, is_s, lms, letters)
        marked = np.zeros(n, bool)
        marked[lms] = True
        names, count = names_of(s, lms, first[marked[first]])
    else:
        names = dense(ranks_by_chains(s, is_s, lms, np.zeros(len(lms), np.int64))[lms])
        count = int(names.max()) + 1
    order = np.argsort(names) if count == len(lms) else suffix_array(names)
    if few:
        return induce(s, is_s, lms[order], letters)
    rank = np.empty(len(lms), np.int64)
    rank[order] = np.arange(len(lms))
    return induced_array(s, is_s, lms, rank)


def common_prefixes(data: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes, in text order: for each suffix the length, up to ``most``, that it has in common with the
    suffix before it in the array (0 for the first). The text counts as ended by letters that match nothing.

    Where a suffix and the one before it are those of the place before, each less its first letter, which is the same, the
    length is one less than there, so letters are compared only at the first place of such a run."""
    n = len(places)
    before = np.full(n, -1, np.int64)
    before[places[1:]] = places[:-1]
    words = word_at(np.concatenate([data, np.zeros(8, np.uint8)]), n)
    new = np.ones(n, bool)
    new[1:] = (before[:-1] < 0) | (before[1:] != before[:-1] + 1) | (data[:n - 1] != data[before[:-1]])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    length = np.zeros(len(first), np.int64)
    run = np.flatnonzero(before[first] >= 0)
    at, other = first[run], before[first[run]]
    room = np.minimum(n - np.maximum(at, other), sizes[run] + most)
    k = 0
    while len(run):
        x = words[at + k] ^ words[other + k]
        same = np.full(len(x), 8)
        unequal = x != 0
        low = x[unequal] & (~x[unequal] + np.uint64(1))  # the lowest set bit
        same[unequal] = (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        length[run] += np.minimum(same, room - k)
        k += 8
        going = ~unequal & (room > k)
        run, at, other, room = run[going], at[going], other[going], room[going]
    inside = np.arange(n) - np.repeat(first, sizes)
    return np.clip(np.repeat(length, sizes) - inside, 0, most).astype(np.int16)


def word_at(padded: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of n places on, as little-endian numbers."""
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out |= padded[j:j + n].astype(np.uint64) << np.uint64(8 * j)
    return out
