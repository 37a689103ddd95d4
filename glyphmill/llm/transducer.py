"""Weighted finite-state transducers over small symbol alphabets, sequential on their input."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Transducer:
    """``arcs[state][symbol] = (output, weight, next state)``; a symbol without an arc passes unchanged
    with weight 0 to ``default[state]`` (the same state if not given).  ``carries``: whether the weight of an
    output symbol's token is counted at this arc is decided by the last machine of a composition."""

    start: str
    arcs: dict = field(default_factory=dict)
    default: dict = field(default_factory=dict)

    def on(self, state: str, symbol: str, output: str, weight: float, after: str) -> Transducer:
        self.arcs.setdefault(state, {})[symbol] = (output, weight, after)
        return self

    def step(self, state: str, symbol: str) -> tuple[str, float, str]:
        got = self.arcs.get(state, {}).get(symbol)
        return got or (symbol, 0.0, self.default.get(state, state))

    def states(self) -> set[str]:
        found = {self.start, *self.arcs, *self.default, *self.default.values()}
        return found | {a[2] for m in self.arcs.values() for a in m.values()}

    def compose(self, then: Transducer, alphabet: set[str]) -> Transducer:
        """The transducer that feeds this one's output to ``then``; weights add up."""
        out, todo, seen = Transducer(f"{self.start}|{then.start}"), [(self.start, then.start)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            for symbol in alphabet:
                mid, w1, a2 = self.step(a, symbol)
                last, w2, b2 = then.step(b, mid)
                out.on(f"{a}|{b}", symbol, last, w1 + w2, f"{a2}|{b2}")
                todo.append((a2, b2))
        return out

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for s in symbols:
            o, w, state = self.step(state, s)
            out.append((o, w))
        return out
