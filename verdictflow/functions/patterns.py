"""White space with one meaning everywhere, that of the web platform."""

from __future__ import annotations

import re

#: White space and line ends as scripts on the web platform have them; fixed values.
SPACE = "\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_SPACE_RUN = re.compile(f"[{SPACE}]+")
_EDGES = re.compile(f"^[{SPACE}]+|[{SPACE}]+\\Z")


def trim(text: str) -> str:
    return _EDGES.sub("", text)


def squeeze(text: str) -> str:
    """Runs of white space become one space."""
    return _SPACE_RUN.sub(" ", text)


def words(text: str) -> list[str]:
    """Split at white space; an empty first or last word stays, as in a split."""
    return _SPACE_RUN.split(text)


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "￿" for c in text)
