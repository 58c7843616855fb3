"""Byte-level BPE encoding and decoding on padded numpy matrices.

The pieces that are new in a batch are put into buckets by length, one padded matrix of token ids per bucket. In each round every row
merges its leftmost pair of least rank; rows without such a pair are done and leave the matrix, and as every other row loses just
one token, the matrix shrinks by one column (compaction). Ranks of pairs come from an open-addressing hash table held in numpy arrays.
Only the two pairs beside a merge are looked up anew. Pieces of more than LONG bytes, which hardly occur, go through a heap of pairs with the same result.
"""

from __future__ import annotations

import base64
import gc
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerationCache, alone
from .prefix_counts import PATTERN, compiled

NONE = np.int64(1 << 40)  # the rank of a pair that isn't merged
LONG = 256  # bytes; a longer piece would make its matrix quadratic, and is merged through a heap
ROWS = 8192  # of a matrix at most
LONGEST_CACHED = 64
DOCS = 256  # texts whose new pieces are encoded together


class PairTable:
    """(left id, right id) -> id of the merged token, by multiplicative hashing and linear probing."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        left, at = np.arange(len(pairs)), self.home(pairs)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = pairs[left[free]]  # of two that want one place, the last one gets it
            won = self.keys[at] == pairs[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair isn't merged or a side is padding (negative)."""
        keys = (left << 20) | right
        keys[(left < 0) | (right < 0)] = -2
        out = np.full(len(keys), NONE, np.int64)
        open_, at = np.arange(len(keys)), self.home(keys)
        while len(open_):
            seen, own = self.keys[at], keys[open_]
            hit = seen == own
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (seen != -1)
            open_, at = open_[go], (at[go] + 1) & self.mask
        return out


class ByteBpe:
    def __init__(self, path: str, pattern: str = PATTERN, cache: int = 300_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = compiled(pattern)
        self.odd_space = compiled(r"^\s|\s$|\s | \s")
        self.by_spaces = pattern == PATTERN  # texts may then be cut at single spaces first
        pairs, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if token[:k] in ranks and token[k:] in ranks:
                    pairs.append(ranks[token[:k]] << 20 | ranks[token[k:]])
                    values.append(rank)
        self.table = PairTable(np.array(pairs, np.int64), np.array(values, np.int64))
        self.bytes_ids = np.full(257, -1, np.int64)
        for b in range(256):
            self.bytes_ids[b] = ranks[bytes([b])]
        top = max(ranks.values()) + 1
        own = [b""] * top
        for token, rank in ranks.items():
            own[rank] = token
        self.lengths = np.array([len(t) for t in own], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(own), np.uint8)
        self.cache = TwoGenerationCache(None, cache)

    # encoding

    def matrix(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        """The ids of each of `rows`, all of at most `width` bytes."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
        size = np.array([len(r) for r in rows])
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        inside = np.arange(width) < size[:, None]
        tok = self.bytes_ids[np.where(inside, raw, 256)]
        rank = self.table.find(tok[:, :-1].ravel(), tok[:, 1:].ravel()).reshape(len(rows), width - 1)
        who = np.arange(len(rows))
        while len(who):
            if rank.shape[1]:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(who)), at]
            else:
                at, best = np.zeros(len(who), np.int64), np.full(len(who), NONE)
            done = best == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[who[r]] = tok[r, : size[r]]
                go = ~done
                tok, rank, who, size, at, best = tok[go], rank[go], who[go], size[go], at[go], best[go]
                if not len(who):
                    break
            n, w = tok.shape
            every = np.arange(n)
            tok[every, at] = best
            keep = np.ones((n, w), bool)
            keep[every, at + 1] = False
            tok = tok[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), bool)
            keep[every, at] = False
            rank = rank[keep].reshape(n, w - 2)
            size = size - 1
            before = at > 0
            rank[every[before], at[before] - 1] = self.table.find(tok[every[before], at[before] - 1], tok[every[before], at[before]])
            after = at < w - 2
            rank[every[after], at[after]] = self.table.find(tok[every[after], at[after]], tok[every[after], at[after] + 1])
            most = int(size.max())
            if most < tok.shape[1] - 8:  # long rows have left
                tok, rank = tok[:, :most].copy(), rank[:, : most - 1].copy()
        return out

    def rank_of(self, left: int, right: int) -> int:
        """find() for one pair."""
        key = left << 20 | right
        at = (key * int(self.table.MIX) & (1 << 64) - 1) >> int(self.table.shift)
        keys = self.table.keys
        while (own := keys[at]) != key:
            if own == -1:
                return int(NONE)
            at = at + 1 & self.table.mask
        return int(self.table.values[at])

    def single(self, piece: bytes) -> np.ndarray:
        """One piece that is longer than any matrix: its pairs stand in a heap by rank and place, so its time is that of a sort."""
        tok = self.bytes_ids[np.frombuffer(piece, np.uint8)]
        n, none = len(tok), int(NONE)
        rank = [*self.table.find(tok[:-1], tok[1:]).tolist(), none]
        tok, after, before, gone = tok.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [r << 40 | k for k, r in enumerate(rank) if r != none]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, at = top >> 40, top & (1 << 40) - 1
            if gone[at] or rank[at] != r:  # merged since, or another pair now
                continue
            right = after[at]
            tok[at], gone[right], after[at] = r, 1, after[right]
            if after[at] < n:
                before[after[at]] = at
            for k in (before[at], at):
                if k >= 0:
                    rank[k] = self.rank_of(tok[k], tok[after[k]]) if after[k] < n else none
                    if rank[k] != none:
                        heapq.heappush(heap, rank[k] << 40 | k)
        return np.array([t for t, g in zip(tok, gone) if not g])

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if len(p) > LONG:
                out[k] = self.single(p).astype("<u4").tobytes()
            elif p:
                buckets.setdefault(max(2, -(-len(p) // 4) * 4 if len(p) <= 32 else 1 << (len(p) - 1).bit_length()), []).append(k)
        for width, own in buckets.items():
            for at in range(0, len(own), ROWS):
                part = own[at : at + ROWS]
                for k, ids in zip(part, self.matrix([pieces[k] for k in part], width)):
                    out[k] = ids.astype("<u4").tobytes()
        return out

    def keys(self, text: str) -> list[str]:
        """Cuts of `text` that no piece crosses."""
        if not self.by_spaces or self.odd_space.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        cache, fresh, all_keys, got = self.cache, {}, [], []
        for t in texts:
            keys = self.keys(t) if t else []
            found = [cache.get(k) for k in keys]
            if None in found:
                fresh |= {k: None for k, f in zip(keys, found) if f is None}
            all_keys.append(keys)
            got.append(found)
        new = []
        for k in fresh:
            if (known := cache.old.get(k)) is not None:
                fresh[k] = known
            else:
                new.append(k)
        cuts = [self.pattern.findall(k) for k in new]
        pieces = list({p: None for c in cuts for p in c})
        ids = dict(zip(pieces, self.encode_pieces([p.encode("utf-8") for p in pieces])))
        for k, c in zip(new, cuts):
            fresh[k] = b"".join([ids[p] for p in c])
        out = [b"".join([f if f is not None else fresh[k] for k, f in zip(keys, found)]) for keys, found in zip(all_keys, got)]
        for k, v in fresh.items():
            if len(k) <= LONGEST_CACHED:
                cache.put(k, v)
        return out

    # decoding

    def decode(self, ids: bytes) -> bytes:
        own = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(own):
            return b""
        size = self.lengths[own]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.starts[own] - ends + size, size) + np.arange(ends[-1])].tobytes()


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str = PATTERN) -> ByteBpe:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(path, pattern)
        gc.freeze()
        gc.set_threshold(100_000, 50, 1000)
    return _CODERS[path, pattern]


def encode(df: DataFrame, vocabulary: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, n_tokens, token_ids): token_ids is binary, little-endian unsigned 32-bit integers. With `decoded`, the bytes decoded from them too.

    Null and empty texts have no tokens. Repeated rows and null ids stay; other columns are not read. Texts of any length are
    encoded whole. No shuffle; memory is that of one batch, the vocabulary and a bounded cache.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("byte_bpe", _CODERS.clear)
        own = coder(vocabulary, pattern)
        for b in batches:
            for at in range(0, b.num_rows, DOCS):
                part = b.slice(at, DOCS)
                ids = own.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "token_ids", "decoded"][: len(columns)])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, token_ids binary" + ", decoded binary" * decoded)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, decoded): the bytes that the ids stand for. Null ids decode to no bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], names=[id_col, "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
