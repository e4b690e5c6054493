"""Deep-shallow sorting of byte strings: multikey quicksort first, blind tries for what ties for long."""

from __future__ import annotations

import numpy as np

WORD = 8  # bytes that the quicksort takes as one character


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of different strings of one length by a blind trie, which stores branching places only.

    A node is ``[place, {byte: node or leaf}, leaf]`` with some leaf below it. A string goes down by the bytes at branching
    places alone, is compared once with the leaf it arrives at, and branches off where they differ.
    """
    root: list | int = 0
    for number in range(1, len(strings)):
        string, node = strings[number], root
        while not isinstance(node, int):
            node = node[1].get(string[node[0]], node[2])
        other = strings[node]
        place = next(i for i in range(len(string)) if string[i] != other[i])
        above, node = None, root
        while not isinstance(node, int) and node[0] < place:
            above, node = node, node[1][string[node[0]]]
        if not isinstance(node, int) and node[0] == place:
            node[1][string[place]] = number
            continue
        leaf = node if isinstance(node, int) else node[2]
        branch = [place, {strings[leaf][place]: node, string[place]: number}, leaf]
        if above is None:
            root = branch
        else:
            above[1][string[above[0]]] = branch
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, int):
            order.append(node)
        else:
            waiting.extend(below for _, below in sorted(node[1].items(), reverse=True))
    return order


def _mixed(words: np.ndarray) -> np.ndarray:
    total = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        total = (total ^ (total >> np.uint64(29)) ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(32))


def deep_shallow(groups: np.ndarray, rows: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows (width a multiple of ``WORD``) within groups, and common prefixes of neighbours.

    Rows are split by one word at a time, and only ties go on to the next word, up to ``shallow`` words. Ties that
    are left are ordered by blind tries of their different rests. The common prefix of the first row of a group
    is -1.
    """
    words = rows.view(">u8").astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    part = np.cumsum(np.append(0, groups[order][1:] != groups[order][:-1])) if len(order) else np.zeros(0, np.int64)
    for depth in range(shallow):
        tied = _tied(part)
        if not len(tied):
            break
        rows_ = order[tied]
        again = np.lexsort((words[rows_, depth], part[tied]))
        order[tied] = rows_[again]
        same = np.append(False, (part[1:] == part[:-1]))
        key = words[order, depth]
        same[1:] &= key[1:] == key[:-1]
        # within parts that were not tied nothing changes: they have one row
        part = np.cumsum(~same) - 1
    tied = _tied(part)
    if len(tied) and shallow < words.shape[1]:
        rows_ = order[tied]
        rest = _mixed(words[rows_, shallow:])
        again = np.lexsort((rest, part[tied]))
        rows_, rest, parts = rows_[again], rest[again], part[tied][again]
        new = np.append(True, (rest[1:] != rest[:-1]) | (parts[1:] != parts[:-1]))
        firsts = np.flatnonzero(new)  # one row of each different rest
        ranks = np.zeros(len(firsts), np.int64)
        owners = parts[firsts]
        begins = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        for a, b in zip(begins, np.append(begins[1:], len(owners)), strict=True):
            if b - a > 1:
                rests = [rows[rows_[i], shallow * WORD :].tobytes() for i in firsts[a:b]]
                ranks[a:b][blind_trie_order(rests)] = np.arange(b - a)
        rank = ranks[np.cumsum(new) - 1]
        order[tied] = rows_[np.lexsort((rank, parts))]
    sorted_rows, sorted_groups = rows[order], groups[order]
    common = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        differ = np.hstack([sorted_rows[1:] != sorted_rows[:-1], np.ones((len(order) - 1, 1), bool)])
        common[1:] = np.where(sorted_groups[1:] == sorted_groups[:-1], differ.argmax(1), -1)
    return order, common


def _tied(part: np.ndarray) -> np.ndarray:
    """Places in parts of several rows."""
    if not len(part):
        return np.zeros(0, np.int64)
    same = part[1:] == part[:-1]
    return np.flatnonzero(np.append(False, same) | np.append(same, False))
