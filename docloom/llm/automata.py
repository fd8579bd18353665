"""Weighted finite-state transducers over strings of symbols.

A transducer is a function (state, symbol) -> [(output, weight, next state)]. ``compose`` runs
one behind the other with lazily made, memoised product states; ``Grammar`` is an acceptor of
weighted patterns; ``best`` finds the heaviest path (weights add up along it).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

Step = Callable[[object, str], list[tuple[str, float, object]]]


def compose(first: Step, second: Step) -> Step:
    """The transducer that gives the output of ``first`` to ``second``; its states are pairs, (None, None) to start."""

    @functools.lru_cache(100_000)
    def step(state, symbol):
        a, b = state or (None, None)
        return [(out, v + w, (x, y)) for mid, v, x in first(a, symbol) for out, w, y in second(b, mid)]

    return step


class Grammar:
    """An acceptor of rules (kind, weight, pattern), each found anywhere in a string.

    A pattern's items are symbols, alternatives ``a|b``, optional ``a?``, repeated ``a*`` or a gap
    ``..n`` of at most n symbols. A gap costs GAP a symbol; ``reported`` symbols (``~a``) match
    as ``a`` at the cost REPORTED. ``context`` symbols (kind -> weights) count wherever they stand.
    """

    GAP, REPORTED = -0.02, -0.5

    def __init__(self, rules: Iterable[tuple[str, float, str]], sets: dict[str, str], context: dict[str, dict[str, float]]):
        self.arcs: list[dict[str, list[tuple[float, int]]]] = []  # state -> symbol -> (weight, next); "*" is any symbol
        self.skips: list[list[tuple[float, int]]] = []  # arcs that read nothing, forward only
        self.ends: dict[int, str] = {}
        self.firsts: dict[str, list[tuple[float, int]]] = {}
        self.context = context
        for kind, weight, pattern in rules:
            at = start = self._state()
            self.skips[start] = []
            for item in pattern.split():
                at = self._item(at, item, sets)
            self.ends[at] = kind
            self._enter(start, weight, set())

    def _state(self) -> int:
        self.arcs.append({})
        self.skips.append([])
        return len(self.arcs) - 1

    def _item(self, at: int, item: str, sets: dict[str, str]) -> int:
        if item.startswith(".."):
            for _ in range(int(item[2:])):
                to = self._state()
                self.arcs[at]["*"] = [(self.GAP, to)]
                self.skips[at].append((0.0, to))
                at = to
            to = self._state()
            self.skips[at].append((0.0, to))
            return to
        names = [n for name in item.rstrip("?*").split("|") for n in sets.get(name, name).split("|")]
        to = self._state()
        for n in names:
            loop = at if item.endswith("*") else to
            self.arcs[at].setdefault(n, []).append((0.0, loop))
            self.arcs[at].setdefault("~" + n, []).append((self.REPORTED, loop))
        if item[-1] in "?*":
            self.skips[at].append((0.0, to))
        return to

    def _enter(self, state: int, weight: float, seen: set[int]) -> None:
        for symbol, arcs in self.arcs[state].items():
            self.firsts.setdefault(symbol, []).extend((weight + w, to) for w, to in arcs)
        for w, to in self.skips[state]:
            if to not in seen:
                seen.add(to)
                self._enter(to, weight + w, seen)

    def _close(self, states: dict[int, float]) -> None:
        todo = list(states)
        while todo:
            s = todo.pop()
            for w, to in self.skips[s]:
                if states[s] + w > states.get(to, -9.0):
                    states[to] = states[s] + w
                    todo.append(to)

    def best(self, symbols: Iterable[str]) -> tuple[float, str | None]:
        """(weight, kind) of the heaviest rule in the string, context counted; (0.0, None) without one."""
        now: dict[int, float] = {}
        found: dict[str, float] = {}
        around = dict.fromkeys(self.context, 0.0)
        for symbol in symbols:
            for kind, weights in self.context.items():
                around[kind] += weights.get(symbol, 0.0)
            new: dict[int, float] = {}
            for s, v in now.items():
                arcs = self.arcs[s]
                for w, to in (*arcs.get(symbol, ()), *arcs.get("*", ())):
                    if v + w > new.get(to, -9.0):
                        new[to] = v + w
            for w, to in self.firsts.get(symbol, ()):
                if w > new.get(to, -9.0):
                    new[to] = w
            self._close(new)
            for s, v in new.items():
                if (kind := self.ends.get(s)) and v > found.get(kind, 0.0):
                    found[kind] = v
            now = new
        rated = [(min(1.0, v + max(-0.9, around.get(k, 0.0))), k) for k, v in found.items()]
        return max([r for r in rated if r[0] > 0], default=(0.0, None))
