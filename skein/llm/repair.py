"""Re-Pair grammars of token sequences."""

from __future__ import annotations

from collections import Counter
from math import inf
from operator import add
from typing import NamedTuple

#: Tokens of a sequence that is short.
SMALL = 1500


class Grammar(NamedTuple):
    sequence: list[int]  # the start rule, of terminals and rules
    rules: dict[int, tuple[int, int]]  # a rule's two symbols
    uses: dict[int, int]  # how often a rule stands in the start rule and in other rules
    lengths: dict[int, int]  # terminals a rule stands for


def infer(tokens: list[int], least: int = 2, limit: float = inf) -> Grammar | None:
    """Replace the most frequent pair of neighbours by a new rule, as long as one occurs
    ``least`` times. ``tokens``: terminals, any non-negative ints.

    Pairs are kept with the places where they begin, the sequence as a linked list, so a
    replacement costs as much as it changes. Of pairs equally frequent the one met first is
    replaced first.

    None if the grammar would have more than ``limit`` symbols, the start rule's and two a rule,
    as soon as that is certain: a sequence has no more different pairs than the grammar of it
    has symbols, so those of a sequence half replaced and the rules so far are a lower bound.
    """
    if len(tokens) <= SMALL:
        made = _small(tokens, least, limit)
        return made and _grammar(*made)
    n = len(tokens)
    seq = list(tokens)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = {}
    last_pair, last_at = None, -2
    for i in range(n - 1):
        pair = seq[i], seq[i + 1]
        if pair == last_pair and last_at == i - 1:  # of aaa the second pair overlaps
            last_pair = None
            continue
        places.setdefault(pair, set()).add(i)
        last_pair, last_at = pair, i
    buckets: dict[int, dict] = {}
    for pair, at in places.items():
        if len(at) >= least:
            buckets.setdefault(len(at), {})[pair] = None
    most = max(buckets, default=0)
    symbol = max(tokens, default=0) + 1
    rules: dict[int, tuple[int, int]] = {}

    while most >= least:
        bucket = buckets.get(most)
        if not bucket:
            most -= 1
            continue
        pair = next(iter(bucket))
        x, y = pair
        done = False
        for i in sorted(places[pair]):
            j = after[i]
            if seq[i] != x or j >= n or seq[j] != y:
                continue
            h, k = before[i], after[j]
            # the pairs that the two symbols made with their neighbours are gone
            for old, at in (((seq[h], x), h), ((y, seq[k]) if k < n else None, j)) if h >= 0 else (((y, seq[k]) if k < n else None, j),):
                found = places.get(old)
                if found and at in found:
                    size = len(found)
                    found.discard(at)
                    if size >= least:
                        buckets[size].pop(old, None)
                        if size > least:
                            buckets.setdefault(size - 1, {})[old] = None
            seq[i], seq[j] = symbol, -1
            after[i] = k
            if k < n:
                before[k] = i
            done = True
            for new, at in (((seq[h], symbol), h), ((symbol, seq[k]) if k < n else None, i)) if h >= 0 else (((symbol, seq[k]) if k < n else None, i),):
                if new is None:
                    continue
                found = places.get(new)
                if found is None:
                    places[new] = {at}
                elif at not in found:
                    size = len(found) + 1
                    found.add(at)
                    if size > least:
                        buckets[size - 1].pop(new, None)
                    if size >= least:
                        buckets.setdefault(size, {})[new] = None
                        if size > most:
                            most = size
        size = len(places.pop(pair, ()))
        for b in {size, most}:
            buckets.get(b, {}).pop(pair, None)
        if done:
            rules[symbol] = pair
            symbol += 1
    sequence, i = [], 0
    while i < n:
        sequence.append(seq[i])
        i = after[i]
    return None if len(sequence) + 2 * len(rules) > limit else _grammar(sequence, rules)


def _small(tokens: list[int], least: int, limit: float) -> tuple[list[int], dict[int, tuple[int, int]]] | None:
    """(start rule, rules) of a short sequence, as a text of one sign a symbol: counting all its
    pairs anew for each rule is cheaper there than keeping their places."""
    text, symbol = "".join(map(chr, tokens)), max(tokens, default=0) + 1
    rules: dict[int, tuple[int, int]] = {}
    while True:
        best, most = "", least - 1
        pairs = Counter(map(add, text, text[1:]))
        if 2 * len(rules) + len(pairs) > limit:
            return None
        for pair, n in pairs.items():
            if n > most and (pair[0] != pair[1] or (n := text.count(pair)) > most):  # of aaa the second pair overlaps
                best, most = pair, n
        if not best:
            return None if len(text) + 2 * len(rules) > limit else (list(map(ord, text)), rules)
        text = text.replace(best, chr(symbol))
        rules[symbol] = ord(best[0]), ord(best[1])
        symbol += 1


def _grammar(sequence: list[int], rules: dict[int, tuple[int, int]]) -> Grammar:
    uses: dict[int, int] = dict.fromkeys(rules, 0)
    for s in (*sequence, *(s for pair in rules.values() for s in pair)):
        if s in uses:
            uses[s] += 1
    lengths: dict[int, int] = {}
    for r, (a, b) in rules.items():  # parts come before the rules made of them
        lengths[r] = lengths.get(a, 1) + lengths.get(b, 1)
    return Grammar(sequence, rules, uses, lengths)


def expand(grammar: Grammar) -> list[int]:
    """The token sequence a grammar stands for."""
    out, stack = [], list(reversed(grammar.sequence))
    while stack:
        s = stack.pop()
        if s in grammar.rules:
            a, b = grammar.rules[s]
            stack += (b, a)
        else:
            out.append(s)
    return out
