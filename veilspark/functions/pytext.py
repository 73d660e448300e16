"""The redaction of one string in Python, for trees of values that column expressions can't walk."""

from __future__ import annotations

import re
from functools import cache
from re import _constants as ops, _parser as parser

from veilspark.functions.catalog import DIGIT_FREE, LITERALS, SAFE_KEYS, SENSITIVE_FRAGMENTS, Detector
from veilspark.functions.columns import token
from veilspark.functions.policy import Policy


_compiled: dict[Detector, re.Pattern] = {}


def compiled(d: Detector) -> re.Pattern:
    if d not in _compiled:
        _compiled[d] = re.compile(d.pattern, re.IGNORECASE if d.ignore_case else 0)
    return _compiled[d]


def _digits(tree) -> int:
    """A number of digits that each match of a parsed pattern has at least."""
    n = 0
    for op, value in tree:
        if op is ops.LITERAL:
            n += chr(value).isdecimal()
        elif op is ops.IN:
            n += all(v is ops.CATEGORY_DIGIT if o is ops.CATEGORY else o is ops.LITERAL and 48 <= v <= 57 or o is ops.RANGE and 48 <= v[0] and v[1] <= 57 for o, v in value)
        elif op is ops.BRANCH:
            n += min(map(_digits, value[1]))
        elif op is ops.SUBPATTERN:
            n += _digits(value[3])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            n += value[0] * _digits(value[2])
    return n


@cache
def least(d: Detector) -> tuple[int, int]:
    """The characters and the digits that a match has at least."""
    tree = parser.parse(d.pattern, re.IGNORECASE if d.ignore_case else 0)
    return tree.getwidth()[0], _digits(tree)


_known: dict[int, tuple[Policy, list[tuple], list[tuple]]] = {}


def _steps(policy: Policy) -> tuple[Policy, list[tuple], list[tuple]]:
    """The policy (so that its identity stays its own), and what its plain and its gated detectors need."""
    if id(policy) not in _known:
        if len(_known) > 100:
            _known.clear()
        _known[id(policy)] = (policy, *([(d, *least(d), d.name not in DIGIT_FREE, LITERALS.get(d.name) or (), tuple(w.lower() for w in d.keywords)) for d in ds] for ds in (policy.plain, policy.gated)))
    return _known[id(policy)]


def redact_text(text: str, policy: Policy) -> tuple[str, list[str]]:
    types = []
    _, plain, gated = _steps(policy)
    size, digits = len(text), sum(map(str.isdecimal, text))
    digit = digits > 0
    for d, chars, numbers, bound, literals, _ in plain:
        if size < chars or digits < numbers or (bound and not digit) or (literals and not any(x in text for x in literals)):
            continue
        text, n = compiled(d).subn(token(d), text)
        if n:
            types.append(d.name)
            size, digits = len(text), sum(map(str.isdecimal, text))
    for d, chars, numbers, _, _, keywords in gated:
        if len(text) < chars or sum(map(str.isdecimal, text)) < numbers:
            continue
        hit, low = False, text.lower()
        if not any(w in low for w in keywords):
            continue
        for m in reversed(list(compiled(d).finditer(text))):
            near = text[max(0, m.start() - d.window) : m.end() + d.window].lower()
            if any(w.lower() in near for w in d.keywords):
                text, hit = text[: m.start()] + token(d) + text[m.end() :], True
        if hit:
            types.append(d.name)
    return text, types


def sensitive_key(key: str, policy: Policy) -> bool:
    key = key.lower()
    return key not in SAFE_KEYS and (key in policy.keys or any(f in key for f in SENSITIVE_FRAGMENTS))
