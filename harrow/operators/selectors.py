"""CSS selectors over parsed pages: a selector is compiled once and asked of every element.

Known are tags, ``*``, ``.class``, ``#id``, attributes (``[a]``, ``=``, ``~=``, ``|=``, ``^=``,
``$=``, ``*=``, each with ``i``), ``:first-child``, ``:last-child``, ``:only-child``,
``:nth-child`` and ``:nth-last-child`` (number, odd, even, an+b), ``:empty``, ``:not`` of
one compound, the combinators descendant, ``>``, ``+`` and ``~``, and lists with commas.
Anything else is an error that names the selector.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

_NAME = r"-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"
_VALUE = rf"\"[^\"]*\"|'[^']*'|{_NAME}|[\w-]+"
_SIMPLE = re.compile(
    rf"(?P<tag>\*|{_NAME})|\.(?P<cls>{_NAME})|\#(?P<id>[\w-]+)"
    rf"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>{_VALUE})\s*(?P<fold>[iI])?\s*)?\]"
    rf"|:(?P<pseudo>first-child|last-child|only-child|empty)(?![\w-])"
    rf"|:(?P<nth>nth-child|nth-last-child)\(\s*(?P<rule>[^)]*?)\s*\)|:not\(\s*(?P<no>(?:[^()]|\([^)]*\))+?)\s*\)"
)
_JOIN = re.compile(r"\s*([>+~])\s*|\s+")
_RULE = re.compile(r"(?:([+-]?\d*)n)?\s*([+-]?\s*\d+)?")
Test = Callable[[object, Callable], bool]


def _nth(rule: str) -> tuple[int, int]:
    """a and b of an+b."""
    rule = {"odd": "2n+1", "even": "2n"}.get(rule.lower(), rule.lower())
    found = _RULE.fullmatch(rule)
    if not rule or not found:
        raise ValueError(rule)
    step, start = found.groups()
    a = 0 if step is None else int(step + "1") if step in ("", "+", "-") else int(step)
    return a, int((start or "0").replace(" ", ""))


def _attribute(name: str, op: str | None, value: str | None, fold: str | None) -> Test:
    name = name.lower()
    want = (value or "").strip("\"'") if value and value[0] in "\"'" else value or ""
    low = str.lower if fold else str
    want = low(want)
    tests = {
        None: lambda x: True,
        "=": lambda x: x == want,
        "~=": lambda x: bool(want) and want in x.split(),
        "|=": lambda x: x == want or x.startswith(want + "-"),
        "^=": lambda x: bool(want) and x.startswith(want),
        "$=": lambda x: bool(want) and x.endswith(want),
        "*=": lambda x: bool(want) and want in x,
    }
    test = tests[op]
    return lambda n, _: name in n.attrs and test(low(n.attrs[name]))


def _simple(m: re.Match) -> Test:
    g = m.groupdict()
    if g["tag"]:
        tag = g["tag"].lower()
        return (lambda n, _: True) if tag == "*" else lambda n, _: n.name == tag
    if g["cls"]:
        return lambda n, _, c=g["cls"]: c in n.attrs.get("class", "").split()
    if g["id"]:
        return lambda n, _, i=g["id"]: n.attrs.get("id") == i
    if g["attr"]:
        return _attribute(g["attr"], g["op"], g["value"], g["fold"])
    if g["no"]:
        test = _compound(g["no"])
        return lambda n, place: not test(n, place)
    if g["pseudo"] == "empty":
        return lambda n, _: not any(not isinstance(k, str) or k for k in n.kids)
    if g["pseudo"]:
        return {"first-child": lambda n, place: place(n)[0] == 1, "last-child": lambda n, place: place(n)[1] == 1, "only-child": lambda n, place: place(n) == (1, 1)}[g["pseudo"]]
    (a, b), side = _nth(g["rule"]), g["nth"] == "nth-last-child"

    def nth(n, place):
        rest = place(n)[side] - b
        return rest == 0 if not a else rest % a == 0 and rest // a >= 0

    return nth


def _compound(text: str) -> Test:
    at, tests = 0, []
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or m.group("tag") and tests:
            raise ValueError(text)
        tests.append(_simple(m))
        at = m.end()
    if not tests:
        raise ValueError(text)
    return lambda n, place: all(t(n, place) for t in tests)


def _steps(text: str) -> list[tuple[str, Test]]:
    """(combinator before it, test) of each compound, from left to right."""
    out, at, join = [], 0, " "
    while True:
        start = at
        while m := _SIMPLE.match(text, at):
            at = m.end()
        out.append((join, _compound(text[start:at])))
        if at == len(text):
            return out
        m = _JOIN.match(text, at)
        if not m:
            raise ValueError(text)
        join, at = m.group(1) or " ", m.end()


def _split(selector: str) -> list[str]:
    """The parts between commas that are in no brackets or quotes."""
    parts, depth, quote = [""], 0, ""
    for c in selector:
        if quote or c in "\"'":
            quote = "" if c == quote else quote or c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if c == "," and not depth and not quote:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts]


@lru_cache(256)
def compile_selector(selector: str) -> list[list[tuple[str, Test]]]:
    try:
        return [_steps(p) for p in _split(selector)]
    except ValueError as e:
        raise ValueError(f"selector not supported: {selector.strip()!r}") from e


def select(root, selector: str) -> list:
    """Elements below ``root`` that the selector finds, in order of the document."""
    paths, places, met = compile_selector(selector), {}, {}

    def place(n) -> tuple[int, int]:
        """Number among the elements of its parent, from the start and from the end."""
        if id(n) not in places:
            own = [k for k in n.up.kids if not isinstance(k, str)]
            places.update((id(k), (j + 1, len(own) - j)) for j, k in enumerate(own))
        return places[id(n)]

    def before(n) -> list:
        return [k for k in n.up.kids if not isinstance(k, str)][: place(n)[0] - 1]

    def fits(n, path: int, k: int) -> bool:
        key = (id(n), path, k)
        if key not in met:
            join, test = paths[path][k]
            met[key] = test(n, place) and (k == 0 or leads(n, path, k - 1, join))
        return met[key]

    def leads(n, path: int, k: int, join: str) -> bool:
        if join in "+~":
            own = before(n)
            return any(fits(x, path, k) for x in (own[-1:] if join == "+" else own))
        up = n.up
        while up is not None and up.up is not None:
            if fits(up, path, k):
                return True
            if join == ">":
                return False
            up = up.up
        return False

    return [n for n in root.walk() if any(fits(n, p, len(path) - 1) for p, path in enumerate(paths))]
