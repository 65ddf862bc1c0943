"""Python-`re` compatible regular expressions for Spark's Java engine.

The audit rules are specified as Python patterns.  Java gives `\\b`, `\\d` and
`\\s` ASCII (or, with `(?U)`, slightly different Unicode) meanings, so the
three escapes are rewritten to explicit classes that match what Python's
`re` does on `str` input:

* word character  = letters, numbers, underscore  -> `[\\p{L}\\p{N}_]`
* `\\d`            = decimal digits                -> `\\p{Nd}`
* `\\s`            = Java `\\s` plus U+001C..U+001F, U+0085 and separators
                    (`\\p{Z}`, which covers no-break, em and ideographic space)

Everything else in the supported patterns means the same in both dialects.
"""

from __future__ import annotations

import re

WORD_CLASS = r"[\p{L}\p{N}_]"
WORD_BOUNDARY = (
    rf"(?:(?<={WORD_CLASS})(?!{WORD_CLASS})|(?<!{WORD_CLASS})(?={WORD_CLASS}))"
)
DIGIT = r"\p{Nd}"
SPACE_MEMBERS = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
SPACE = f"[{SPACE_MEMBERS}]"


NOT_AFTER_WORD = f"(?<!{WORD_CLASS})"    # boundary before a word character
NOT_BEFORE_WORD = f"(?!{WORD_CLASS})"    # boundary after a word character

_WORD_ONLY_CLASS = re.compile(r"\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9])+\]")


def _required(pattern: str, j: int) -> bool:
    """Is the token ending at j required (not followed by ?, * or {0,...})?"""
    return not (pattern.startswith("?", j) or pattern.startswith("*", j) or pattern.startswith("{0", j))


def _word_token_after(pattern: str, i: int) -> bool:
    """Does the pattern at i start with a required token that only matches
    word characters (\\d or a class of ASCII letter/digit ranges)?"""
    if pattern.startswith("\\d", i):
        return _required(pattern, i + 2)
    m = _WORD_ONLY_CLASS.match(pattern, i)
    return m is not None and _required(pattern, m.end())


def _word_token_before(pattern: str, i: int) -> bool:
    """Does the pattern end at i with such a token (optionally quantified by
    {m}, {m,n}, + or ? is excluded since it may match nothing)?"""
    head = pattern[:i]
    head = re.sub(r"(\{[1-9]\d*(,\d*)?\}|\+)$", "", head)
    if head.endswith("\\d"):
        return True
    m = re.search(r"\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9])+\]$", head)
    return m is not None


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite a Python pattern into an equivalent Java pattern.

    Where the token next to a `\\b` can only match a word character, the
    boundary reduces exactly to one look-around (not preceded / not followed
    by a word character), which is much cheaper to evaluate at every offset.
    (Quantifiers that allow zero repetitions are not treated as word tokens.)"""
    out: list[str] = []
    in_class = False
    i = 0
    n = len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt == "b" and not in_class:
                if _word_token_after(pattern, i + 2):
                    out.append(NOT_AFTER_WORD)
                elif _word_token_before(pattern, i):
                    out.append(NOT_BEFORE_WORD)
                else:
                    out.append(WORD_BOUNDARY)
            elif nxt == "d":
                out.append(DIGIT)
            elif nxt == "s":
                out.append(SPACE_MEMBERS if in_class else SPACE)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            i += 1
            # a leading '^' and a leading ']' belong to the class body
            if i < n and pattern[i] == "^":
                out.append("^")
                i += 1
            if i < n and pattern[i] == "]":
                out.append(r"\]")
                i += 1
            continue
        if ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    java = "".join(out)
    return ("(?iu)" + java) if ignore_case else java
