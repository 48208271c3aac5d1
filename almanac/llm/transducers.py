"""Weighted finite-state transducers over small alphabets: arcs, composition, and the weight of all paths of an input."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence
from typing import NamedTuple

State = Hashable


class Transducer(NamedTuple):
    """``arcs[state][symbol]`` lists what may be done there: ``(output, weight, next state)``. ``final`` has the weights of ending.

    A path weighs the product of its arcs and of its end; an input weighs the sum of its paths. A state without an arc for a
    symbol refuses it.
    """

    start: State
    arcs: dict[State, dict[int, list[tuple[int, float, State]]]]
    final: dict[State, float]


def copying(start: State, alphabet: Iterable[int], states: Iterable[State], arcs: dict[tuple[State, int], tuple[int, float, State]], final: dict[State, float] | None = None) -> Transducer:
    """A transducer that copies every symbol and stays where it is, but for ``arcs``. All states end with weight 1 unless ``final`` is given."""
    alphabet, states = list(alphabet), list(states)
    every = {s: {a: [arcs.get((s, a), (a, 1.0, s))] for a in alphabet} for s in states}
    return Transducer(start, every, {s: 1.0 for s in states} if final is None else final)


def compose(first: Transducer, then: Transducer) -> Transducer:
    """The transducer that gives the output of ``first`` to ``then``: states are pairs, weights multiply.

    Only pairs that the start reaches, and from which an end can be reached, are kept.
    """
    start = (first.start, then.start)
    arcs: dict[State, dict[int, list[tuple[int, float, State]]]] = {}
    todo = [start]
    while todo:
        p, q = pair = todo.pop()
        if pair in arcs:
            continue
        out: dict[int, list[tuple[int, float, State]]] = {}
        for symbol, steps in first.arcs[p].items():
            for middle, w1, p2 in steps:
                for output, w2, q2 in then.arcs[q].get(middle, ()):
                    out.setdefault(symbol, []).append((output, w1 * w2, (p2, q2)))
                    todo.append((p2, q2))
        arcs[pair] = out
    final = {(p, q): first.final[p] * then.final[q] for p, q in arcs if p in first.final and q in then.final}
    useful, grown = set(final), True
    while grown:
        more = {s for s, out in arcs.items() if s not in useful and any(t in useful for steps in out.values() for _, _, t in steps)}
        useful, grown = useful | more, bool(more)
    kept = {s: {a: [x for x in steps if x[2] in useful] for a, steps in out.items()} for s, out in arcs.items() if s in useful or s == start}
    return Transducer(start, kept, final)


def numbered(machine: Transducer) -> Transducer:
    """The same with numbers for states; arcs of a symbol that lead to the same state are one, their weights added and outputs left out (0)."""
    number = {s: i for i, s in enumerate(machine.arcs)}
    arcs: dict[State, dict[int, list[tuple[int, float, State]]]] = {}
    for s, out in machine.arcs.items():
        arcs[number[s]] = {}
        for a, steps in out.items():
            total: dict[State, float] = {}
            for _, weight, t in steps:
                total[number[t]] = total.get(number[t], 0.0) + weight
            if total:
                arcs[number[s]][a] = [(0, w, t) for t, w in total.items()]
    return Transducer(number[machine.start], arcs, {number[s]: w for s, w in machine.final.items()})


def weigh(machine: Transducer, inputs: Iterable[Sequence[tuple[int, float]]]) -> float:
    """The summed weight of all paths over ``inputs``: at each place one of several symbols may be read, each with a weight of its own.

    States carry the weight of all ways to them, so time grows with the length and not with the number of paths.
    """
    live = {machine.start: 1.0}
    for choices in inputs:
        reached: dict[State, float] = {}
        for state, so_far in live.items():
            out = machine.arcs[state]
            for symbol, own in choices:
                for _, weight, t in out.get(symbol, ()):
                    reached[t] = reached.get(t, 0.0) + so_far * own * weight
        live = reached
    return sum(w * machine.final.get(s, 0.0) for s, w in live.items())
