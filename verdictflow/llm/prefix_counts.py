"""Exact token counts at every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

The greedy merges of BPE have a prefix property: if a string's encoding is t1 .. tk, then the encoding of the prefix
that ends with t(k-1) is t1 .. t(k-1). So the encoding of each prefix is known from one back pointer, its last token:
last[i] is the only token t ending at i for which (last[i - len(t)], t) stays unmerged. count[i] is then
count[i - len(t)] + 1. Texts are first cut as the tokenizer's own pattern cuts them, and units (a run of white space with
the piece that follows) are solved once and cached, so a text costs one look-up per word.

What is stored per text: the total and `deltas`, one signed byte per character (code point): the count at each prefix minus the
count at the prefix before. Truncation and budget questions are answered from these without encoding again.
"""

from __future__ import annotations

import gc
import json
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerationCache, alone

#: White space as the tokenizer library has it (Python's own class also holds the separators 1C to 1F).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The published split pattern of this family of byte-level vocabularies; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space before a piece belongs to its unit, since prefixes that end in it count differently.
UNIT = r"""(?:\s*[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])?'(?:[stmd]|re|ve|ll)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"""


def compiled(pattern: str):
    """`pattern` with its white space class written out."""
    outside = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])")
    return regex.compile(outside.replace(r"\s", f"[{SPACE}]"))


#: Units longer than this are solved but not cached.
LONGEST_CACHED = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins by which such vocabularies write single bytes, by their rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


WIDE = 0x80


def steps(counts: list[int]) -> bytes:
    """Differences of neighbours, a signed byte each; one that doesn't fit is the byte WIDE and four bytes."""
    found = [b - a for a, b in zip(counts, counts[1:])]
    if found and (max(found) > 127 or min(found) < -127):
        return b"".join([bytes([x & 255]) if -127 <= x <= 127 else bytes([WIDE]) + x.to_bytes(4, "little", signed=True) for x in found])
    return bytes([x & 255 for x in found])


class PrefixCounter:
    """Counts for one vocabulary file in the `tokenizers` JSON form (byte-level BPE, no normalizer)."""

    def __init__(self, path: str, cache: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        raw = {t: bytes(back[c] for c in t) for t in model["vocab"] if all(c in back for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(raw[a], raw[b]): k for k, (a, b) in reversed(list(enumerate(merges)))}
        self.special = sorted((x["content"] for x in spec.get("added_tokens", [])), key=len, reverse=True)
        made = {a + b for a, b in self.rank} | {bytes([b]) for b in range(256)}
        self.tokens = sorted(t for t in made if self.merge(t) == [t])
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.tokens):
            self.automaton.add_word(t.decode("latin-1"), (len(t), k))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.pieces, self.units, self.lead = compiled(PATTERN), compiled(UNIT), compiled(r"^\s*")
        self.odd_space = compiled(r"^\s|\s$|\s | \s")
        self.cut_special = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None
        self.unit_cache = TwoGenerationCache(self.solve_unit, cache)
        self.cache = TwoGenerationCache(self.solve, cache)

    def merge(self, text: bytes) -> list[bytes]:
        """The encoding by definition: merge the leftmost pair of least rank until none is left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, pair: int) -> bool:
        """Whether the encoding of two tokens, written one after the other, is just these two."""
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        a, b = self.tokens[pair >> 20], self.tokens[pair & 0xFFFFF]
        found = self.fits[pair] = self.merge(a + b) == [a, b]
        return found

    def prefixes(self, piece: bytes) -> list[int]:
        """count[i] for every byte prefix of one piece of the split pattern.

        The automaton names the tokens that end at each byte, longest first; the first that stays apart from the last token of
        what stands before it is the one.
        """
        count, last, fits = [0] * (len(piece) + 1), [-1] * (len(piece) + 1), self.fits
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if not count[end]:
                at = end - length
                if at:
                    pair = last[at] << 20 | token
                    ok = fits.get(pair)
                    if not (ok or ok is None and self.fit(pair)):
                        continue
                count[end] = count[at] + 1
                last[end] = token
        return count

    def at_chars(self, piece: str) -> list[int]:
        """Counts at the character prefixes of one piece, the empty one included."""
        raw = piece.encode("utf-8", "surrogatepass")
        count = self.prefixes(raw)
        if len(raw) == len(piece):
            return count
        return [c for c, b in zip(count, raw + b" ") if b & 0xC0 != 0x80]

    def solve(self, unit: str) -> tuple[int, bytes]:
        """(total, deltas) of one unit or of a run of units joined by single spaces."""
        if unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            own = self.at_chars(unit)
            return own[-1], steps(own)
        found = [self.unit_cache[u] if len(u) <= LONGEST_CACHED else self.solve_unit(u) for u in self.units.findall(unit)]
        return sum([f[0] for f in found]), b"".join([f[1] for f in found])

    def solve_unit(self, u: str) -> tuple[int, bytes]:
        own = self.unit_prefixes(u)
        return own[-1], steps(own)

    def unit_prefixes(self, u: str) -> list[int]:
        lead = self.lead.match(u).end()
        if not lead and u.isalpha() or u[0] == " " and u[1:].isalpha():
            return self.at_chars(u)
        # White space that ends a prefix is one piece with all white space before it, and the two letters of a contraction only count
        # as one piece once both are there.
        out = self.at_chars(u[:lead])[:]
        if lead == len(u):
            return out
        cut = self.pieces.findall(u)
        whole = sum(self.at_chars(p)[-1] for p in cut[:-1])
        tail = cut[-1]
        own = self.at_chars(tail)
        inside = len(tail) - (len(u) - lead)  # white space that the last piece takes in
        for k in range(inside + 1, len(tail) + 1):
            if tail[0] == "'" and 1 < k < len(tail):
                out.append(whole + sum(self.at_chars(p)[-1] for p in self.pieces.findall(tail[:k])))
            else:
                out.append(whole + own[k])
        return out

    def ordinary(self, text: str) -> tuple[int, bytes]:
        """Total and deltas of a text without special strings."""
        if not text:
            return 0, b""
        if self.odd_space.search(text):
            keys = self.units.findall(text)
        else:
            first, *rest = text.split(" ")
            keys = [first, *[" " + w for w in rest]]
        get, solve = self.cache, self.solve
        found = [get[k] if len(k) <= LONGEST_CACHED else solve(k) for k in keys]
        return sum([f[0] for f in found]), b"".join([f[1] for f in found])

    def text(self, text: str) -> tuple[int, bytes]:
        """Total and deltas of any text; a special string is one token, as the library's default has it.

        Prefixes that end inside a special string count as ordinary text.
        """
        if not self.special or not any(s in text for s in self.special):
            return self.ordinary(text)
        total, deltas, at = 0, [], 0
        for m in self.cut_special.finditer(text):
            n, d = self.ordinary(text[at : m.start()])
            base, seen = total + n, [total + n]
            for k in range(1, m.end() - m.start()):
                seen.append(total + self.ordinary(text[at : m.start() + k])[0])
            seen.append(base + 1)
            deltas += [d, steps(seen)]
            total, at = base + 1, m.end()
        n, d = self.ordinary(text[at:])
        return total + n, b"".join([*deltas, d])


def counts(deltas: bytes) -> np.ndarray:
    """Token count at prefixes of 0, 1, 2 .. characters."""
    if WIDE not in deltas:
        return np.concatenate([[0], np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)])
    found, at = [0], 0
    while at < len(deltas):
        wide = deltas[at] == WIDE
        found.append(int.from_bytes(deltas[at + wide : at + (5 if wide else 1)], "little", signed=True))
        at += 5 if wide else 1
    return np.cumsum(found)


def longest_within(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    fits = np.flatnonzero(counts(deltas) <= budget)
    return int(fits[-1]) if len(fits) else 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
        gc.freeze()  # the tables hold no cycles; the collector needn't walk them again and again
        gc.set_threshold(100_000, 50, 1000)
    return _COUNTERS[path]


def prefix_token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, prefix_deltas) for every row of `df`.

    Null texts count as empty: no bytes, no tokens, no deltas. Repeated rows and null ids stay as they are; columns other
    than the two named are not read. A text of any length is held once, with one byte per character. No shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("prefix_counts", _COUNTERS.clear)
        own = counter(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                total, size, deltas = array("q"), array("q"), []
                for x in part.column(1).to_pylist():
                    n, d = own.text(x or "")
                    total.append(n)
                    size.append(len((x or "").encode("utf-8", "surrogatepass")))
                    deltas.append(d)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(deltas, pa.binary())], names=[id_col, "n_bytes", "n_tokens", "prefix_deltas"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, prefix_deltas binary")


def budget_prefix(df: DataFrame, budget: int) -> DataFrame:
    """`df` of prefix_token_counts with `fit_chars`: characters of the longest prefix within `budget` tokens, from the deltas alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit = pa.array([longest_within(d or b"", budget) for d in b.column("prefix_deltas").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fit], names=[*b.schema.names, "fit_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, fit_chars long")
