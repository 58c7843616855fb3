"""Directives against a system's instructions, found as phrases: sequences of words with a set for each place.

A phrase is written as places divided by spaces; a place lists its words with bars and may be left out if it begins with a question mark. Words are what white space divides; punctuation ends a
phrase unless a place names it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .patterns import SPACE


class Place(NamedTuple):
    words: frozenset[str]
    optional: bool


def phrase(text: str) -> tuple[Place, ...]:
    return tuple(Place(frozenset(p.lstrip("?").split("|")), p.startswith("?")) for p in text.split())


MODES = "unrestricted|developer|jailbreak|dan|stan|god|unfiltered|evil|anarchist|uncensored|liberated|unlocked|maximum"
OVERRIDES = phrase("ignore|disregard|forget|override ?all ?previous|prior|above|existing|system instruction|instructions|prompt|prompts|rule|rules|mandate|mandates|policies|guard|guards")
ADOPTION = phrase(f"you are now ?in ?a|an|the {MODES}")
MODE_NAMES = phrase("dan|jailbreak|unrestricted|god mode")
REPUDIATIONS = (phrase("as ?an ai|assistant without ?any restriction|restrictions"), phrase("operating without rules"), phrase("no longer bound by"))
PURPOSES = phrase("for debugging|testing|benchmark purpose|purposes")
SKIPS = phrase("skip|bypass|disable|ignore ?all security|safety|auth|verification|audit")
TAGS = frozenset("system assistant im_start im_end rules prompt_instructions".split())
CONTROLS = frozenset("bypass ignore override admin unrestricted".split())

#: What a text must hold for any of this.
HINTS = ("ignore", "disregard", "forget", "override", "you", "mode", "without", "bound", "purpose", "<", "[instruction")
_WORDS = re.compile(rf"[a-z0-9_]+|[^a-z0-9_{SPACE}]")


def follows(places: tuple[Place, ...], words: list[str], at: int) -> int:
    """The place behind a phrase that begins at word `at`, or -1."""
    for k, place in enumerate(places):
        if at < len(words) and words[at] in place.words:
            at += 1
        elif not place.optional:
            return -1
    return at


def tagged(low: str) -> bool:
    """Whether a text holds a tag of a chat template: a name of TAGS in angle brackets."""
    for part in low.split("<")[1:]:
        inside, close, _ = part[:80].partition(">")
        if close and inside.strip().removeprefix("/").strip() in TAGS:
            return True
    return False


def directive(text: str) -> str | None:
    """What kind of directive a text holds, if any."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return None
    found = [(m.group(), m.start()) for m in _WORDS.finditer(low)]
    words = [w for w, _ in found]
    for k, w in enumerate(words):
        if w in OVERRIDES[0].words and follows(OVERRIDES, words, k) > 0:
            return "Directive to drop earlier instructions"
        if w == "you" and (at := follows(ADOPTION, words, k)) > 0 and any(x in ("mode", "role") for x in words[at : at + 3]):
            return "Adoption of an unbound mode or role"
        if w in MODE_NAMES[0].words and follows(MODE_NAMES, words, k) > 0:
            return "Name of an unbound mode"
        if w in ("as", "operating", "no") and any(follows(p, words, k) > 0 for p in REPUDIATIONS):
            return "Claim to be free of constraints"
        if w == "for" and (at := follows(PURPOSES, words, k)) > 0:
            near = next((j for j in range(at, min(at + 24, len(words))) if found[j][1] - found[at - 1][1] > 56), min(at + 24, len(words)))
            if any(follows(SKIPS, words, j) > 0 for j in range(at, near)):
                return "Bypass framed by a purpose"
        if w == "[" and words[k + 1 : k + 3] == ["instruction", ":"] and words[k + 3 : k + 4] and words[k + 3] in CONTROLS and words[k + 4 : k + 5] == ["]"]:
            return "Bracketed control token"
    return "Chat template tag" if "<" in low and tagged(low) else None
