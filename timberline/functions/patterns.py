"""What a regular expression says about the texts it matches, found in its syntax tree."""

from __future__ import annotations

import re
import warnings
from re import _constants as kinds
from re import _parser as parser

# Escapes that Java's and Python's expressions read differently, and flags under which letters are not what they say.
_OTHERWISE = re.compile(r"\\[0vZzhHRXQEGpPN]|&&|\(\?[a-zA-Z]*[ixud]")
_REPEATS = (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT)


def required_literals(pattern: str) -> tuple[str, ...]:
    """Strings without LF one of which every match of ``pattern`` holds; none if there is no telling.

    ``pattern`` is in Java's syntax. Where it is not in Python's as well, or may mean something else there, there is no telling.
    Of several such sets the one whose shortest string is the longest is taken.
    """
    if _OTHERWISE.search(pattern):
        return ()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = parser.parse(pattern)
    except (re.error, Warning, RecursionError, OverflowError):
        return ()
    if tree.state.flags & re.IGNORECASE:
        return ()
    return tuple(sorted(_best(_sets(tree))))


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


def _sets(tree) -> list[frozenset[str]]:
    """Sets of strings of which every match of the sequence ``tree`` holds one each."""
    found: list[frozenset[str]] = []
    run: list[str] = []

    def end_run() -> None:
        found.extend(frozenset([part]) for part in "".join(run).split("\n") if part)
        run.clear()

    for kind, value in tree:
        if kind is kinds.LITERAL:
            run.append(chr(value))
            continue
        if kind is kinds.SUBPATTERN and not value[1] and not value[2] and all(k is kinds.LITERAL for k, _ in value[3]):
            # A group of letters goes on with what stands beside it.
            run.extend(chr(v) for _, v in value[3])
            continue
        if kind is kinds.AT:
            continue
        end_run()
        if kind is kinds.SUBPATTERN and not value[1] & re.IGNORECASE:
            found += _sets(value[3])
        elif kind is kinds.ATOMIC_GROUP:
            found += _sets(value)
        elif kind in _REPEATS and value[0] > 0:
            found += _sets(value[2])
        elif kind is kinds.BRANCH:
            ways = [_best(_sets(way)) for way in value[1]]
            if all(ways):
                found.append(frozenset().union(*ways))
    end_run()
    return found
