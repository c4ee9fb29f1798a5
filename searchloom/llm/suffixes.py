"""Suffix order of a byte text by two-stage sorting, and common prefixes of neighbours.

Only suffixes smaller than their successors are sorted directly, eight bytes at a time. All others follow by scanning the buckets
of first bytes in ascending order: a suffix that is larger than its successor stands behind it in the order of its own
bucket, so the order inside a bucket is the order in which its members are met.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zero bytes follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        padded = (padded[:-width] << np.uint64(8 * width)) | padded[width:]
    return padded[: len(text)]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is not, as the empty suffix is smaller."""
    step = np.full(len(text), -1, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    ends = np.flatnonzero(step)
    return np.repeat(step[ends] > 0, np.diff(np.concatenate(([-1], ends))))


def sorted_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of their suffixes, compared to ``depth`` bytes."""
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))[: len(order)]
    group = np.cumsum(fresh)
    tied = _tied(fresh)
    for at in range(8, depth, 8):
        if not len(tied):
            break
        here, own = order[tied], group[tied]
        after = here + at
        key = np.where(after < len(words), words[np.minimum(after, len(words) - 1)], 0)
        by = np.lexsort((key, own))
        order[tied] = here[by]
        key = key[by]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
        still = _tied(fresh)
        # groups only need to differ from their neighbours in the tied part
        group[tied] = np.cumsum(fresh)
        tied = tied[still]
    return order


def _tied(fresh: np.ndarray) -> np.ndarray:
    """Places that share a group with a neighbour, where ``fresh`` marks the first of each group."""
    if not len(fresh):
        return np.empty(0, np.int64)
    last = np.concatenate((fresh[1:], [True]))
    return np.flatnonzero(~(fresh & last))


def suffix_order(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of ``text`` (uint8) in ascending order of their first ``depth`` bytes."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    words = words_at(text) if words is None else words
    direct = sorted_directly(np.flatnonzero(smaller_than_next(text)), words, depth)
    starts = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        own = np.concatenate(induced[byte]) if induced[byte] else np.empty(0, np.int64)
        found, front = [own], own
        while len(front):  # runs of this byte that a smaller one follows
            front = front[front > 0] - 1
            front = front[text[front] == byte]
            found.append(front)
        bucket = np.concatenate([*found, direct[starts[byte] : starts[byte + 1]]])
        induced[byte] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > byte], first[first > byte]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part, head in zip(np.split(before, cuts), first[np.concatenate(([0], cuts))] if len(first) else []):
            induced[head].append(part)
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, words: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it, at most ``limit``; 0 for the first."""
    shared = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    a, b = order[:-1], order[1:]
    for at in range(0, limit, 8):
        if not len(active):
            break
        left, right = a + at, b + at
        inside = (left < len(words)) & (right < len(words))
        active, a, b, left, right = active[inside], a[inside], b[inside], left[inside], right[inside]
        differ = words[left] ^ words[right]
        equal = differ == 0
        ended = differ[~equal]
        lead = np.zeros(len(ended), np.int64)
        for k in range(1, 8):
            lead += (ended >> np.uint64(64 - 8 * k)) == 0
        shared[active[~equal]] = at + lead
        active, a, b = active[equal], a[equal], b[equal]
        shared[active] = at + 8
    return np.minimum(shared, limit)
