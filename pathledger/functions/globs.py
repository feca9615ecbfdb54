"""Globs with ``*``, ``?``, ``[...]`` and ``[!...]``."""

import re


def tokens(glob):
    """(kind, text) of each part: ``star``, ``any``, ``class`` (its inside), or ``char``, a plain one."""
    at = 0
    while at < len(glob):
        char = glob[at]
        # A bracket closes after at least one character, so "[]]" is a set of one.
        close = glob.find("]", at + 2 + (glob[at + 1 : at + 2] == "!")) if char == "[" else -1
        if close > 0:
            yield "class", glob[at + 1 : close]
            at = close
        else:
            yield {"*": "star", "?": "any"}.get(char, "char"), char
        at += 1


def _char_class(body):
    """Regular expression of the inside of a glob's brackets; ranges that run backwards are empty."""
    negate, items, at = body.startswith("!"), [], 0
    body = body[1:] if negate else body
    while at < len(body):
        low = high = body[at]
        if body[at + 1 : at + 2] == "-" and at + 2 < len(body):
            high = body[at + 2]
            at += 2
        if low <= high:
            items.append("-".join(re.sub(r"[\\\[\]&^-]", r"\\\g<0>", c) for c in (low, high)))
        at += 1
    if not items:
        return "." if negate else "(?!)"
    return f"[{'^' if negate else ''}{''.join(items)}]"


_REGEX = {"star": lambda _: ".*", "any": lambda _: ".", "class": _char_class, "char": re.escape}


def glob_regex(glob):
    """Anchored regular expression of a glob."""
    return "(?s)^" + "".join(_REGEX[kind](text) for kind, text in tokens(glob)) + r"\z"
