"""Double-array tries over phrases of word numbers, built and walked with whole-array operations (numpy, inside a task).

A word number is ``DIGITS`` digits below ``1 << bits``; a phrase of k words is a path of k times as many digits below the
root of its language. A state is a place in ``check``: digit d leads from s to t = base[s] + d where check[t] = s.
"""

from __future__ import annotations

import numpy as np

#: Few digits make few steps, many make small sets of children, which leave fewer places free.
DIGITS = 3


def _place(groups: np.ndarray, digits: np.ndarray, used: np.ndarray, radix: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Bases for groups of digits (``groups`` ascending, from 0) so that no two of base + digit meet, and the places used.

    Groups of half of all digits get a window of their own. Others take places by size, the largest first, in
    rounds of random tries; of those that meet in a round the first stays. Where few find a place, the array grows.
    """
    sizes = np.bincount(groups)
    starts = np.cumsum(sizes) - sizes
    bases = np.full(len(sizes), -1, np.int64)

    def spread(todo):
        """Owner (index into todo) and digit of every member of the groups."""
        reps = sizes[todo]
        owner = np.repeat(np.arange(len(todo)), reps)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(reps) - reps, reps)
        return owner, digits[np.repeat(starts[todo], reps) + inside]

    dense = np.flatnonzero(sizes >= max(2, radix // 2))
    bases[dense] = len(used) - radix + radix * np.arange(len(dense))
    used = np.concatenate([used, np.zeros(radix * len(dense), bool)])
    owner, digit = spread(dense)
    used[bases[dense][owner] + digit] = True

    order = np.argsort(-sizes, kind="stable")
    order = order[bases[order] < 0]
    for todo in np.split(order, np.flatnonzero(np.diff(np.ceil(np.log2(sizes[order])))) + 1) if len(order) else ():
        if sizes[todo[0]] == 1:
            # Groups of one digit fit into any free place.
            free = np.flatnonzero(~used[radix:])[: len(todo)] + radix
            if len(free) < len(todo):
                free = np.concatenate([free, len(used) + np.arange(len(todo) - len(free))])
                used = np.concatenate([used, np.zeros(len(todo), bool)])
            bases[todo] = free - digits[starts[todo]]
            used[free] = True
            continue
        while len(todo):
            tries = rng.integers(radix, len(used) - radix, len(todo))
            owner, digit = spread(todo)
            at = tries[owner] + digit
            bad = np.zeros(len(todo), bool)
            bad[owner[used[at]]] = True
            clear = ~bad[owner]
            at, owner = at[clear], owner[clear]
            by = np.lexsort((owner, at))
            meets = at[by[1:]] == at[by[:-1]]
            bad[owner[by[1:][meets]]] = True
            good = ~bad[owner]
            used[at[good]] = True
            bases[todo[~bad]] = tries[~bad]
            if 20 * (len(todo) - bad.sum()) < len(todo):
                used = np.concatenate([used, np.zeros(len(used) // 4 + 4 * radix, bool)])
            todo = todo[bad]
    return bases, used


class DoubleArray:
    """``roots``: state by root number. ``ends``: state by phrase number."""

    def __init__(self, base, check, ends, roots, bits):
        self.base, self.check, self.ends, self.roots, self.bits = base, check, ends, roots, bits
        self.accept = np.full(len(check), -1, np.int32)
        self.accept[ends] = np.arange(len(ends))

    @classmethod
    def build(cls, roots: np.ndarray, phrases: np.ndarray, n_words: int, slack: float = 1.3) -> DoubleArray:
        """A trie of distinct phrases: row i is the words of phrase i (from 1, padded with 0) below root ``roots[i]``."""
        bits = max(1, -(-int(n_words).bit_length() // DIGITS))
        radix = 1 << bits
        n, width = phrases.shape
        path = np.stack([phrases >> bits * d & (radix - 1) for d in reversed(range(DIGITS))], axis=2).reshape(n, DIGITS * width)
        n_roots = int(roots.max()) + 1 if n else 1
        # Nodes level by level: a node is (its parent, digit); node numbers are dense over all levels.
        parents, digits, node, total = [], [], roots.astype(np.int64), n_roots
        ends = np.full(n, -1, np.int64)
        active = np.arange(n)
        for level in range(DIGITS * width):
            active = active[phrases[active, level // DIGITS] > 0]
            if not len(active):
                break
            key = node[active] * radix + path[active, level]
            distinct, which = np.unique(key, return_inverse=True)
            parents.append(distinct // radix)
            digits.append(distinct % radix)
            node[active] = total + which
            total += len(distinct)
            if level % DIGITS == DIGITS - 1:
                ends[active] = node[active]
        parents = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        digits = np.concatenate(digits) if digits else np.zeros(0, np.int64)

        size = int(slack * len(parents)) + n_roots + 4 * radix
        used = np.zeros(size + radix, bool)
        used[: radix + n_roots] = True  # roots stand behind the first radix places
        # Levels follow each other and are ascending inside, so parents ascend.
        inner, group = np.unique(parents, return_inverse=True)
        bases, used = _place(group, digits, used, radix, np.random.default_rng(7))
        state = np.concatenate([radix + np.arange(n_roots), bases[group] + digits])
        base = np.full(len(used), -radix, np.int32)
        check = np.full(len(used), -1, np.int32)
        base[state[inner]] = bases
        check[state[n_roots:]] = state[parents]
        return cls(base, check, state[ends].astype(np.int32), (radix + np.arange(n_roots)).astype(np.int32), bits)

    def _step(self, states: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.base[states] + digits
        # A state without children has a base below all places.
        np.clip(to, 0, len(self.check) - 1, out=to)
        alive = np.flatnonzero(self.check[to] == states)
        return alive, to[alive]

    def _word(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states have the word (0 is none), and where they lead: a step for every digit."""
        kept, to = np.arange(len(states)), states
        for d in reversed(range(DIGITS)):
            alive, to = self._step(to, words[kept] >> self.bits * d & ((1 << self.bits) - 1))
            kept = kept[alive]
        return kept, to

    def count(self, root: int, own: np.ndarray, numbers: np.ndarray, width: int, totals: np.ndarray) -> None:
        """Adds to ``totals`` (by phrase) how often each phrase stands in a text.

        The text is given as ``numbers``, and ``own`` turns a number into the trie's word, or 0 where no phrase has it.
        The first word's steps are taken once a distinct word; then all positions advance together, digit by digit, and
        those that fall off are dropped.
        """
        start = np.zeros(len(own), np.int32)
        known = np.flatnonzero(own)
        alive, to = self._word(np.full(len(known), self.roots[root], np.int32), own[known])
        start[known[alive]] = to
        at = np.flatnonzero((start > 0)[numbers])
        states = start[numbers[at]]
        for k in range(width):
            if k:
                inside = at + k < len(numbers)
                at, states = at[inside], states[inside]
                alive, states = self._word(states, own[numbers[at + k]])
                at = at[alive]
            hits = self.accept[states]
            found = np.bincount(hits[hits >= 0])
            totals[: len(found)] += found

    def add(self, root: int, phrases: np.ndarray, times: np.ndarray, totals: np.ndarray) -> None:
        """Adds the ``times`` of ``phrases`` (rows of the trie's words, padded with 0) to their places in ``totals``; phrases
        that the trie does not have are passed over. All phrases advance together, digit by digit."""
        at, states = np.arange(len(phrases)), np.full(len(phrases), self.roots[root], np.int32)
        for k in range(phrases.shape[1]):
            alive, states = self._word(states, phrases[at, k])
            at = at[alive]
            whole = phrases[at, k + 1] == 0 if k + 1 < phrases.shape[1] else np.ones(len(at), bool)
            hits = self.accept[states[whole]]
            np.add.at(totals, hits[hits >= 0], times[at[whole]][hits >= 0])
            at, states = at[~whole], states[~whole]

    def parts(self) -> dict:
        return {"base": self.base.tobytes(), "check": self.check.tobytes(), "ends": self.ends.tobytes(), "roots": self.roots.tobytes(),
                "bits": self.bits}

    @classmethod
    def of(cls, parts) -> DoubleArray:
        return cls(*(np.frombuffer(parts[k], np.int32) for k in ("base", "check", "ends", "roots")), parts["bits"])
