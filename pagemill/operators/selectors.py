"""CSS selectors as predicates over a page's elements.

A selector's text is compiled once, on the driver; what runs is a column expression. Known are type and universal selectors,
attribute tests ([a], =, ~=, ^=, $=, *=, |=, with an i flag), lists, and the descendant and child combinators, whose
left sides are types. Only elements that a page's struct keeps can be asked for; others are refused when
compiled, not silently absent.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.html import KEPT
from .features import Dom

# Attributes whose values html compares without case.
CASELESS = set("accept accept-charset align alink axis bgcolor charset checked clear codetype color compact declare defer dir direction disabled enctype face frame hreflang http-equiv lang language link media method multiple nohref noresize noshade nowrap readonly rel rev rules scope scrolling selected shape target text type valign valuetype vlink".split())

_NAME = r"[a-zA-Z][\w-]*"
_TEST = re.compile(rf"\[\s*({_NAME})\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*(i|I)?\s*)?\]")
_COMPOUND = re.compile(rf"(\*|{_NAME})?((?:{_TEST.pattern})*)")
_SPLIT = re.compile(r"""("[^"]*"|'[^']*'|\[[^\]]*\])|(,)|\s*(>)\s*|(\s+)""")

Pred = Callable[[Column], Column]


def _parts(text: str) -> list[list[str]]:
    """Selectors of a list, each as compounds and combinators (' ' or '>') in turn."""
    lists, now, at = [[]], "", 0
    for m in _SPLIT.finditer(text):
        now += text[at : m.start()]
        at = m.end()
        if m[1]:
            now += m[1]
            continue
        if now:
            lists[-1].append(now)
            now = ""
        if m[2]:
            lists.append([])
        elif m[3]:
            lists[-1].append(">")
        elif lists[-1] and lists[-1][-1] not in (">", " "):
            lists[-1].append(" ")
    if now + text[at:]:
        lists[-1].append(now + text[at:])
    return [p[:-1] if p and p[-1] == " " else p for p in lists]


def _test(name: str, op: str | None, value: str, fold: bool) -> Pred:
    name = name.lower()
    fold = fold or name in CASELESS
    want = value.lower() if fold else value

    def check(e: Column) -> Column:
        got = F.lower(e["attrs"][name]) if fold else e["attrs"][name]
        if op is None:
            return got.isNotNull()
        if op == "=":
            return got == want
        if op == "|=":
            return (got == want) | got.startswith(want + "-")
        if not want or (op == "~=" and re.search(r"\s", want)):
            return F.lit(False)
        return {"~=": F.array_contains(F.split(got, r"[ \t\n\f\r]+"), want), "^=": got.startswith(want), "$=": got.endswith(want), "*=": got.contains(want)}[op]

    return check


def _compound(text: str) -> Pred:
    m = _COMPOUND.fullmatch(text)
    if not text or not m:
        raise ValueError(f"selector not understood: {text!r}")
    tag = (m[1] or "*").lower()
    if tag != "*" and tag not in KEPT:
        raise ValueError(f"elements {tag} are not kept")
    tests = [_test(t[1], t[2], next((v for v in t.group(3, 4, 5) if v is not None), ""), bool(t[6])) for t in _TEST.finditer(m[2])]

    def check(e: Column) -> Column:
        return reduce(Column.__and__, [t(e) for t in tests], F.lit(True) if tag == "*" else e["tag"] == tag)

    return check


def _above(parts: list[str]) -> str:
    """Regex over an element's ancestors ('/html/body/nav/') for the types and combinators on its left."""
    out = ""
    for name, combinator in zip(parts[::2], parts[1::2], strict=True):
        if not re.fullmatch(rf"\*|{_NAME}", name):
            raise ValueError(f"left of a combinator only types are known: {name!r}")
        out += ("[^/]+" if name == "*" else re.escape(name.lower())) + "/" + ("" if combinator == ">" else "(?:.*/)?")
    return rf"^(?:/|.*/){out}$"


def predicate(selector: str) -> Pred:
    """Whether an element matches a selector."""
    alternatives: list[Pred] = []
    for parts in _parts(selector.strip()):
        if not parts or len(parts) % 2 == 0:
            raise ValueError(f"selector not understood: {selector!r}")
        own, above = _compound(parts[-1]), _above(parts[:-1]) if len(parts) > 1 else None
        alternatives.append(own if above is None else lambda e, own=own, above=above: own(e) & e["up"].rlike(above))
    return lambda e: F.coalesce(reduce(Column.__or__, [a(e) for a in alternatives]), F.lit(False))


def select(dom: Dom, selector: str) -> Column:
    """Elements that match, in document order."""
    return F.filter(dom["els"], predicate(selector))


def count(dom: Dom, selector: str) -> Column:
    return F.size(select(dom, selector))


def first(dom: Dom, selector: str) -> Column:
    return F.get(select(dom, selector), 0)
