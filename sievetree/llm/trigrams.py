"""Boolean trigram queries derived from regular expressions.

A query says which trigrams a text must hold if the expression matches anywhere in it. Queries are ("all",) for no demand,
("tri", t), ("and", parts) or ("or", parts). The derivation walks the parsed expression and keeps, for each part, the exact
strings it can match while those are few; where that ends, the strings' trigrams are demanded and the walk starts anew.
Everything is derived for lower-cased texts, so that it holds for either case.
"""

from __future__ import annotations

from itertools import product
from re import _parser as parser

ALL = ("all",)
_MAX_STRINGS, _MAX_CLASS = 64, 6


def both(a: tuple, b: tuple) -> tuple:
    return _join("and", [a, b])


def _join(kind: str, parts: list[tuple]) -> tuple:
    flat: list[tuple] = []
    for p in parts:
        for q in p[1] if p[0] == kind else [p]:
            if q not in flat:
                flat.append(q)
    if kind == "and":
        flat = [p for p in flat if p != ALL]
        return ALL if not flat else flat[0] if len(flat) == 1 else (kind, flat)
    return ALL if ALL in flat or not flat else flat[0] if len(flat) == 1 else (kind, flat)


def demand(strings: set[str]) -> tuple:
    """That one of these strings is in the text."""
    return _join("or", [_join("and", [("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _node(op, arg) -> tuple[set[str] | None, tuple]:
    """The exact strings of a part, or None and what the part demands."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, ALL
    if name == "IN":
        chars: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < _MAX_CLASS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ALL
        return (chars, ALL) if len(chars) <= _MAX_CLASS else (None, ALL)
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= _MAX_STRINGS:
            return set().union(*(e for e, _ in parts)), ALL
        return None, _join("or", [q if e is None else demand(e) for e, q in parts])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = arg
        exact, query = _sequence(inner)
        if exact is not None and most == 1 and least == 0:
            return exact | {""}, ALL
        if exact is not None and least == most and len(exact) ** min(least, 8) <= _MAX_STRINGS and least <= 8:
            return {"".join(x) for x in product(exact, repeat=least)}, ALL
        if least == 0:
            return None, ALL
        if exact is None:
            return None, query
        few = {"".join(x) for x in product(exact, repeat=min(least, 3))} if len(exact) ** min(least, 3) <= _MAX_STRINGS else set()
        return None, demand(few) if few else ALL
    if name == "AT":
        return {""}, ALL
    return None, ALL


def _sequence(parsed) -> tuple[set[str] | None, tuple]:
    run, query, whole = {""}, ALL, True
    for op, arg in parsed:
        exact, inner = _node(op, arg)
        if exact is not None and len(run) * len(exact) <= _MAX_STRINGS:
            run = {a + b for a in run for b in exact}
            continue
        query, whole = both(both(query, demand(run)), inner), False
        run = exact if exact is not None else {""}
    return (run, ALL) if whole else (None, both(query, demand(run)))


def query_of(pattern: str) -> tuple:
    exact, query = _sequence(parser.parse(pattern))
    return demand(exact) if exact is not None else query


def trigrams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set() if query == ALL else set().union(*map(trigrams_of, query[1]))
