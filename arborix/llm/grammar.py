"""Grammars of token sequences, inferred for whole batches of files at once (p1).

Two grammars are used. ``repair`` replaces frequent pairs of a file by rules until no pair repeats: how small it gets tells how much of the file
is one pattern over and over. In each of its rounds all pairs that are more frequent than the pairs they overlap are replaced together, which
gives Re-Pair's grammars but for ties in a number of rounds that grows with the logarithm of the file. ``anchored`` lets a hash of the pair decide in place of its
frequency, so equal stretches of tokens get equal rules in whatever file they stand, and a rule can be known again in another repository
without a dictionary shared between tasks.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a hash of every element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: Smaller rules are idioms of the language, and fewer uses are no pattern of a file.
RULE_TOKENS, RULE_USES = 6, 4


def _winners(prio: np.ndarray) -> np.ndarray:
    """Pairs that beat both pairs they overlap; among equals in a row (as in aaaa) every other one from the left.

    ``prio[i]`` is the priority of the pair (i, i+1), 0 where it may not be replaced.
    """
    n = len(prio)
    left = np.zeros(n, prio.dtype)
    left[1:] = prio[:-1]
    right = np.zeros(n, prio.dtype)
    right[:-1] = prio[1:]
    win = (prio > 0) & (prio >= right) & (prio >= left)
    if not win.any():
        return win
    # runs of neighbouring winners have one priority: take every other
    starts = win.copy()
    starts[1:] &= ~win[:-1]
    idx = np.arange(n)
    first = np.maximum.accumulate(np.where(starts, idx, -1))
    return win & ((idx - first) % 2 == 0)


def repair(tokens: np.ndarray, files: np.ndarray, n_files: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, reuse) of each file: the length of its final sequence, the number of its rules, and the largest share of its tokens
    that one rule of at least ``RULE_TOKENS`` tokens produces in at least ``RULE_USES`` places.

    ``tokens``: small non-negative token ids of all files, file after file; ``files``: the file number of each token. A file's grammar has
    symbols + 2 * rules symbols in all.
    """
    seq = tokens.astype(np.int64)
    file = files.astype(np.int64)
    rules = np.zeros(n_files, np.int64)
    active = np.ones(n_files, bool)
    total = np.bincount(file, minlength=n_files)
    length = total.copy()
    size = np.ones(len(seq), np.int64)
    reuse = np.zeros(n_files)
    nxt = int(seq.max(initial=0)) + 1
    # whether the pair (i, i+1) may repeat: one that stands alone does so until one of its symbols is replaced
    live = np.ones(len(seq), bool)
    for _ in range(rounds):
        if len(seq) < 2:
            break
        # pairs are numbered per file, and none reaches from one file into the next
        ok = np.flatnonzero(live[:-1] & (file[:-1] == file[1:]))
        if not len(ok):
            break
        f, x, y = file[ok], seq[ok], seq[ok + 1]
        pair = (f * nxt + x) * nxt + y
        if n_files * nxt * nxt > 1 << 62:
            pair = mix(mix(f * np.int64(0x9E3779B9) + x) + y.astype(np.uint64)).view(np.int64)
        order = np.argsort(pair)
        sp = pair[order]
        edge = np.empty(len(sp), bool)
        edge[0] = True
        np.not_equal(sp[1:], sp[:-1], out=edge[1:])
        number = np.cumsum(edge) - 1
        counts = np.bincount(number)
        ident = np.zeros(len(seq) - 1, np.int64)
        ident[ok[order]] = number
        freq = np.zeros(len(seq) - 1, np.int64)
        freq[ok] = np.where(counts[ident[ok]] > 1, counts[ident[ok]], 0)
        # ties between different pairs fall by a hash of the place in the file where each comes first, so that neighbours' turns come in few rounds
        # and other files at hand do not matter
        begins = np.append(0, np.flatnonzero(file[1:] != file[:-1]) + 1)
        first = np.minimum.reduceat(ok[order], np.flatnonzero(edge))
        place = first - begins[np.searchsorted(begins, first, "right") - 1]
        turn = (mix(place.astype(np.uint64) + np.uint64(1)) >> np.uint64(34)).astype(np.int64)
        prio = np.where(freq > 0, (freq << 30) + turn[ident], 0)
        win = _winners(prio)
        # a pair that won in one place only (the others overlap better pairs) makes no rule
        if not win.any():
            break
        won = np.bincount(ident[win], minlength=len(counts))
        win &= won[ident] > 1
        if not win.any():
            break
        at = np.flatnonzero(win)
        names, one = np.unique(ident[at], return_index=True)
        one = at[one]  # one place of each new rule
        rules += np.bincount(file[one], minlength=n_files)
        grown = size[one] + size[one + 1]
        uses = won[ident[one]]
        big = (grown >= RULE_TOKENS) & (uses >= RULE_USES)
        if big.any():
            np.maximum.at(reuse, file[one[big]], grown[big] * uses[big] / total[file[one[big]]])
        new = np.full(len(counts), -1, np.int64)
        new[names] = nxt + np.arange(len(names))
        seq[at] = new[ident[at]]
        size[at] += size[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        changed = np.zeros(len(seq), bool)
        changed[at] = True
        live = np.append(freq > 0, False)[keep]
        seq, file, size, changed = seq[keep], file[keep], size[keep], changed[keep]
        live |= changed
        live[:-1] |= changed[1:]
        nxt += len(names)
        # files that did not change are done
        now = np.bincount(file, minlength=n_files)
        active &= (now != length) & (now > 0)
        length = np.where(now > 0, now, length)
        stay = active[file]
        if not stay.all():
            seq, file, size, live = seq[stay], file[stay], size[stay], live[stay]
    return length, rules, reuse


def anchored(hashes: np.ndarray, files: np.ndarray, least: int = 12, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rule, file, size) of the stretches into which hash-chosen pairs fold every file: size is the number of tokens below the rule.

    ``hashes``: 64-bit hash of each token. A stretch stops growing once it has ``least`` tokens; a rule's name is a hash of its whole
    expansion's structure, the same wherever the same tokens stand, apart from the ends of the common part.
    """
    seq = hashes.astype(np.uint64)
    file = files.astype(np.int64)
    size = np.ones(len(seq), np.int64)
    for _ in range(rounds):
        if len(seq) < 2:
            break
        ok = (file[:-1] == file[1:]) & (size[:-1] < least) & (size[1:] < least)
        if not ok.any():
            break
        pair = mix(seq[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(seq[1:]))
        prio = np.where(ok, (pair >> np.uint64(2)).astype(np.int64) | 1, 0)
        at = np.flatnonzero(_winners(prio))
        if not len(at):
            break
        seq[at] = pair[at]
        size[at] += size[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, file, size = seq[keep], file[keep], size[keep]
    return seq, file, size
