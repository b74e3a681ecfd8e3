"""Deep-shallow sorting of suffixes to a bounded depth: multikey quicksort to a shallow depth, blind tries below.

Both halves work on a buffer of bytes and an array of start positions within one task, and give the
suffixes in order with the length of the prefix that each shares with the one before.  Characters of
the quicksort are eight bytes wide.  What still shares ``SHALLOW`` bytes goes to blind tries: a trie
that keeps only branching depths, so that a suffix walks down by single bytes, is compared once with
the leaf it reaches, and is inserted at the depth where the two part.  A trie of two leaves is one
comparison, and all of these are made at once.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def _word(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as a big-endian number."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | buf[at + i]
    return out


def multikey_quicksort(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int = SHALLOW, several: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, number, single): the suffixes that share their first ``depth`` bytes with another of their group, in order, and those of ``several`` that do not.

    ``group`` numbers are not decreasing; suffixes of different groups are not compared.  All
    groups are partitioned around a pivot of their own at once: what is less, equal (and goes on
    with the next character) or greater.  Suffixes that have become unique are dropped, unless
    ``several`` marks their position as one at which several equal suffixes begin.  ``buf`` holds 8 bytes at least after each position that is read.
    """
    at, done, single = np.zeros(len(starts), np.int64), [], [starts[:0]]
    while len(starts):
        edge = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        size = np.diff(np.append(edge, len(group)))
        own = np.repeat(np.arange(len(edge)), size)
        ready = (size == 1) | (at[edge] >= depth)
        deep = ready & (size > 1)
        if deep.any():
            mine = deep[own]
            done.append((starts[mine], group[mine]))
        if several is not None:
            left = starts[(size == 1)[own]]
            single.append(left[several[left]])
        live = ~ready
        if not live.any():
            break
        keep = live[own]
        starts, at, group = starts[keep], at[keep], group[keep]
        size = size[live]
        edge = np.cumsum(size) - size
        own = np.repeat(np.arange(len(size)), size)
        word = _word(buf, starts + at)
        first, middle, last = word[edge], word[edge + size // 2], word[edge + size - 1]
        pivot = np.maximum(np.minimum(first, middle), np.minimum(np.maximum(first, middle), last))[own]
        less, same = word < pivot, word == pivot
        place = np.empty(len(starts), np.int64)
        begin, number = edge.copy(), np.zeros(len(starts), np.int64)
        for k, part in enumerate((less, same, ~(less | same))):
            count = np.add.reduceat(part.astype(np.int64), edge)
            rank = np.cumsum(part) - 1
            before = np.cumsum(count) - count
            place[part] = begin[own[part]] + rank[part] - before[own[part]]
            number[part] = 3 * own[part] + k
            begin += count
        order = np.empty(len(starts), np.int64)
        order[place] = np.arange(len(starts))
        starts, at, group = starts[order], (at + 8 * same)[order], number[order]
    if not done:
        return starts[:0], group[:0], np.concatenate(single)
    # Groups were numbered anew in each round, so what was finished in different rounds is told apart by its round.
    found = np.concatenate([s for s, _ in done])
    size = np.concatenate([np.diff(np.append(np.flatnonzero(np.diff(g, prepend=g[0] - 1)), len(g))) for _, g in done])
    return found, np.repeat(np.arange(len(size)), size), np.concatenate(single)


def blind_trie(text: bytes, starts: list[int], begin: int, end: int) -> tuple[list[int], list[int]]:
    """For suffixes equal up to ``begin``: their order, and what each shares with the one before, up to ``end``.

    A node is [depth, children by byte, a leaf below]; a leaf is the number of a suffix, and
    suffixes equal up to ``end`` share one.
    """
    same: list[list[int]] = [[] for _ in starts]
    root = None
    for i, s in enumerate(starts):
        own = text[s : s + end]
        if root is None:
            root = i
            same[i].append(i)
            continue
        node = root
        while type(node) is list:  # walk down blindly
            node = node[1].get(own[node[0]], node[2])
        other = text[starts[node] : starts[node] + end]
        if own == other:
            same[node].append(i)
            continue
        same[i].append(i)
        low, high = begin, end  # the first byte at which they part
        while low < high:
            mid = (low + high + 1) >> 1
            if own[begin:mid] == other[begin:mid]:
                low = mid
            else:
                high = mid - 1
        parent, node = None, root
        while type(node) is list and node[0] < low:
            parent, node = node, node[1][own[node[0]]]
        if type(node) is list and node[0] == low:
            node[1][own[low]] = i
            continue
        leaf = node[2] if type(node) is list else node
        new = [low, {text[starts[leaf] + low]: node, own[low]: i}, leaf]
        if parent is None:
            root = new
        else:
            parent[1][own[parent[0]]] = new

    order, shared, waiting = [], [], [(root, begin)]
    while waiting:
        node, depth = waiting.pop()
        if type(node) is list:
            children = [node[1][b] for b in sorted(node[1], reverse=True)]
            waiting += [(c, node[0]) for c in children[:-1]]
            waiting.append((children[-1], depth))
        else:
            order += same[node]
            shared += [depth] + [end] * (len(same[node]) - 1)
    return order, shared


def deep_shallow(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int, several: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, shared, first, single): in order, the suffixes that share ``SHALLOW`` bytes with another of their group, and those of ``several`` that do not.

    shared is the length, up to ``length``, of the prefix that a suffix has in common with the one
    before; where ``first``, another part of the order begins and it counts for nothing.
    """
    starts, part, single = multikey_quicksort(buf, starts, group, several=several)
    if not len(starts):
        return starts, np.zeros(0, np.int64), np.zeros(0, bool), single
    first = np.diff(part, prepend=-1) != 0
    shared = np.full(len(starts), SHALLOW, np.int64)
    size = np.bincount(part)
    two = np.flatnonzero(first & (size[part] == 2))
    a, b = starts[two], starts[two + 1]
    live, common = np.arange(len(two)), np.full(len(two), SHALLOW, np.int64)
    for at in [*range(SHALLOW, length - 7, 8), *([length - 8] if length % 8 else [])]:
        x, y = _word(buf, a[live] + at), _word(buf, b[live] + at)
        apart = x != y
        bits = x[apart] ^ y[apart]
        common[live[apart]] = np.minimum(length, at + sum((bits >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8)))
        common[live[~apart]] = at + 8
        turned = live[apart][x[apart] > y[apart]]
        starts[two[turned]], starts[two[turned] + 1] = b[turned], a[turned]
        live = live[~apart]
    shared[two + 1] = common
    text = None
    for k in np.flatnonzero(first & (size[part] > 2)):
        text = buf.tobytes() if text is None else text
        own = slice(k, k + size[part[k]])
        order, shared[own] = blind_trie(text, starts[own].tolist(), SHALLOW, length)
        starts[own] = starts[own][order]
    return starts, shared, first, single


def repeated(buf: np.ndarray, starts: np.ndarray, length: int, group: np.ndarray | None = None, several: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, leads): the positions whose next ``length`` bytes begin at another of their group too; of equal ones one leads.

    A position that ``several`` marks stands for as many suffixes, which follow each other in the order: it repeats wherever it comes to stand.
    """
    if length < SHALLOW:
        raise ValueError(f"length must be {SHALLOW} at least")
    starts, shared, first, single = deep_shallow(buf, starts, np.zeros(len(starts), np.int64) if group is None else group, length, several)
    like_before = (shared >= length) & ~first
    again = like_before | np.append(like_before[1:], False)
    if several is not None:
        again |= several[starts]
    return np.concatenate([starts[again], single]), np.concatenate([~like_before[again], np.ones(len(single), bool)])
