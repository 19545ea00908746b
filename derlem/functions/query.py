"""Search strings: normal form, and their meaning as a boolean expression over phrases."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column

OPERATORS = ("AND", "OR", "NOT")
_PIECES = re.compile(r'-?"[^"]+"|-?[^\s"()]+|[()]')


def normalise(query: str) -> str:
    """Explicit operators between all terms, prefix stars on bare words, balanced quotes and parentheses."""
    if query.count('"') % 2:
        query += '"'
    out: list[str] = []
    for piece in _PIECES.findall(query):
        last = out[-1] if out else ""
        if piece.upper() in OPERATORS:
            if out and last not in OPERATORS:
                out.append(piece.upper())
            continue
        if piece in "()":
            out.append(piece)
            continue
        minus = piece.startswith("-")
        term = piece[1:] if minus else piece
        if not term:
            continue
        if minus and last not in OPERATORS:
            out.append("NOT")
        elif not minus and out and last not in (*OPERATORS, "("):
            out.append("AND")
        out.append(term if term.startswith('"') or term.endswith("*") else term + "*")
    while out and out[-1] in OPERATORS:
        out.pop()
    depth, balanced = 0, []
    for piece in out:
        depth += (piece == "(") - (piece == ")")
        if depth < 0:
            depth = 0
            continue
        balanced.append(piece)
    return " ".join(balanced + [")"] * depth)


class QuerySyntaxError(ValueError):
    """The normal form isn't a valid expression; searches answer with no rows."""


@dataclass
class Match:
    """phrases: (words, last word is a prefix); expression: a phrase's number, or (operator, left, right)."""

    phrases: list[tuple[tuple[str, ...], bool]] = field(default_factory=list)
    expression: object = None

    def column(self, present) -> Column:
        """present: a phrase's number -> boolean column."""

        def of(e) -> Column:
            if isinstance(e, int):
                return present(e)
            op, a, b = e
            return {"AND": lambda: of(a) & of(b), "OR": lambda: of(a) | of(b), "NOT": lambda: of(a) & ~of(b)}[op]()

        return of(self.expression)


def parse(match: str, words_of) -> Match:
    """A normal form, with NOT binding before AND before OR; words_of folds and splits a term as the index does."""
    pieces = re.findall(r'"[^"]*"|[()]|[^\s()]+', match)
    found, at = Match(), 0

    def term():
        nonlocal at
        if at == len(pieces) or pieces[at] in (*OPERATORS, ")"):
            raise QuerySyntaxError(match)
        piece = pieces[at]
        at += 1
        if piece == "(":
            inner = level(0)
            if at == len(pieces) or pieces[at] != ")":
                raise QuerySyntaxError(match)
            at += 1
            return inner
        words = tuple(words_of(piece.strip('"').removesuffix("*")))
        if not words:
            raise QuerySyntaxError(match)
        found.phrases.append((words, piece.endswith("*")))
        return len(found.phrases) - 1

    def level(k: int):
        nonlocal at
        if k == 3:
            return term()
        left = level(k + 1)
        while at < len(pieces) and pieces[at] == ("OR", "AND", "NOT")[k]:
            at += 1
            left = (("OR", "AND", "NOT")[k], left, level(k + 1))
        return left

    found.expression = level(0)
    if at != len(pieces):
        raise QuerySyntaxError(match)
    return found


def fold_words(term: str) -> list[str]:
    """The index's tokens of a short term, on the driver."""
    from .text import ACCENTED, PLAIN

    folded = term.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return re.findall(r"[^\W_]+", folded)


