"""Hierarchical multi-length packing of tokenized documents.

Documents are routed to the smallest of several context-size tiers (powers of two) that holds them; of longer ones, full windows of the
longest tier are cut off first. When a tier has gathered a step group's worth of tokens, its windows are packed: each starts with
the tier's longest item, and the gap is filled with whole items of the shorter tiers, the largest that fits first, and at last with a cut of one
item, whose rest is routed anew. So every window is exactly full. What is left at the end of a partition goes into ever shorter windows, by
halves, so that nothing is padded. Windows of one tier form step groups of equal token counts.

Everything runs within a partition of the input: no shuffle, and the buffers hold a step group per tier at most.
"""

from __future__ import annotations

import bisect
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerationCache, alone, by_bytes, release
from .prefix_counts import compiled

LONGEST_CACHED = 64
STEP = 1 << 17  # words whose ids are dealt out at once


class WordTokenizer:
    """Ids of a lower-casing vocabulary with word ends that drops white space.

    What stands between spaces or line ends is a key, encoded on its own, once for many texts, and cached. Its words, of Latin letters at least, are
    cached too, and the new ones go to the library in one string; each ends with a token that closes a word.
    """

    #: The vocabulary's published split pattern; a fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, end_id: int, cache: int = 520_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = end_id.to_bytes(4, "little")
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.latin = compiled(self.PATTERN), regex.compile("[\x00-\u024f]*")
        self.cache, self.word_cache = TwoGenerationCache(None, cache), TwoGenerationCache(None, cache)

    def whole(self, part: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(part, add_special_tokens=False).ids])

    def new_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            own = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(own), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(own):
                raw, at_ = ids.tobytes(), [0, *(4 * ends).tolist()]
                out += [raw[i:j] for i, j in zip(at_, at_[1:])]
            else:
                out += [self.whole(w) for w in own]
        return out

    def parts(self, keys: list[str]) -> list[bytes]:
        """The ids of each of `keys`, which differ and hold no space or line end."""
        cache, word_cache = self.cache, self.word_cache
        found = [cache.get(k) for k in keys]
        cuts, words = [], {}
        for at, k in enumerate(keys):
            if found[at] is not None:
                continue
            if (known := cache.old.get(k)) is not None:
                found[at] = known
            elif k.isascii() and k.isalpha():
                cuts.append((at, (w := k.lower(),)))
                words[w] = None
            elif self.latin.fullmatch(k) and "<|" not in k:
                cuts.append((at, own := self.words.findall(k.lower())))
                words |= dict.fromkeys(own)
            else:
                found[at] = self.whole(k)
            if found[at] is not None and len(k) <= LONGEST_CACHED:
                cache.put(k, found[at])
        new = []
        for w in words:
            known = word_cache.get(w) or word_cache.old.get(w)
            if known is None:
                new.append(w)
            else:
                words[w] = known
        for w, ids in zip(new, self.new_words(new)):
            words[w] = ids
            if len(w) <= LONGEST_CACHED:
                word_cache.put(w, ids)
        for at, cut in cuts:
            found[at] = ids = words[cut[0]] if len(cut) == 1 else b"".join([words[w] for w in cut])
            if len(keys[at]) <= LONGEST_CACHED:
                cache.put(keys[at], ids)
        return found

    def encode(self, texts: pa.Array) -> tuple[bytes, list[int]]:
        """Little-endian unsigned 32-bit ids of all texts, the end id after each, and where each text's begin and the last one's end, in bytes.

        Equal keys of the texts are looked up once; their ids are then dealt out by their numbers.
        """
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        del lists
        own = [*self.parts(coded.dictionary.to_pylist()), self.end]
        which = np.insert(coded.indices.to_numpy(), ends, len(own) - 1)
        del coded
        size = np.array([len(x) // 4 for x in own])
        flat, starts = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size
        del own
        many = size[which]
        upto = np.cumsum(many)
        ids = np.empty(upto[-1] if len(upto) else 0, "<u4")
        for at in range(0, len(which), STEP):
            n, to = many[at : at + STEP], upto[at : at + STEP]
            first = to[0] - n[0]
            ids[first : to[-1]] = flat[np.repeat(starts[which[at : at + STEP]] - to + n, n) + np.arange(first, to[-1])]
        return ids.tobytes(), [0, *(4 * upto[ends + np.arange(len(ends))]).tolist()]


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def forget_tokenizers() -> None:
    _TOKENIZERS.clear()


def word_tokenizer(path: str, end_id: int) -> WordTokenizer:
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = WordTokenizer(path, end_id)
        gc.freeze()
        gc.set_threshold(100_000, 50, 1000)
    return _TOKENIZERS[path, end_id]


class Item:
    """What is not yet placed of a document: its ids from `start` on, `size` of them."""

    __slots__ = ("doc", "start", "size", "ids", "total")

    def __init__(self, doc, start: int, size: int, ids: bytes, total: int):
        self.doc, self.start, self.size, self.ids, self.total = doc, start, size, ids, total

    def take(self, n: int) -> tuple:
        """Cut off the first n ids: (doc, start, n, ids, total)."""
        piece = (self.doc, self.start, n, self.ids[: 4 * n], self.total)
        self.start, self.size, self.ids = self.start + n, self.size - n, self.ids[4 * n :]
        return piece


class Packer:
    """Packs one partition; `put` and `finish` return finished windows as (tier, step group, pieces)."""

    def __init__(self, tiers: Iterable[int], group_tokens: int):
        self.tiers = sorted(tiers)
        if any(t & (t - 1) for t in self.tiers) or group_tokens % self.tiers[-1]:
            raise ValueError("tiers are powers of two, and a step group holds whole windows of each")
        self.group = group_tokens
        self.items: list[list[tuple[int, int, Item]]] = [[] for _ in self.tiers]  # by size, ascending
        self.held = [0] * len(self.tiers)
        self.windows = {}
        self.serial = 0

    def route(self, item: Item) -> int:
        k = bisect.bisect_left(self.tiers, item.size)
        self.serial += 1
        bisect.insort(self.items[k], (item.size, self.serial, item))
        self.held[k] += item.size
        return k

    def pop(self, k: int, at: int) -> Item:
        size, _, item = self.items[k].pop(at)
        self.held[k] -= size
        return item

    def emit(self, size: int, pieces: list[tuple]) -> tuple:
        n = self.windows[size] = self.windows.get(size, 0) + 1
        return size, (n - 1) * size // self.group, pieces

    def put(self, doc, ids: bytes) -> list[tuple]:
        total = len(ids) // 4
        item, out, top = Item(doc, 0, total, ids, total), [], self.tiers[-1]
        while item.size >= top:
            out.append(self.emit(top, [item.take(top)]))
        if item.size:
            k = self.route(item)
            if self.held[k] >= self.group:
                while self.held[k] >= self.group // 2:
                    out.append(self.window(self.tiers[k], k))
        return out

    def window(self, size: int, top: int) -> tuple:
        """A full window of `size` from the tiers up to `top`, which hold that many ids at least."""
        pieces, room = [], size
        while room:
            for k in range(top, -1, -1):  # the largest item that fits whole
                at = bisect.bisect_right(self.items[k], (room, float("inf"))) - 1
                if at >= 0:
                    item = self.pop(k, at)
                    room -= item.size
                    pieces.append(item.take(item.size))
                    break
            else:  # none fits: cut the smallest
                k = next(k for k in range(top + 1) if self.items[k])
                item = self.pop(k, 0)
                pieces.append(item.take(room))
                room = 0
                self.route(item)
        return self.emit(size, pieces)

    def finish(self) -> list[tuple]:
        out, size = [], self.tiers[-1]
        while size:
            while sum(self.held) >= size:
                out.append(self.window(size, len(self.tiers) - 1))
            size //= 2
        return out


PIECES = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("token_ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("tier", pa.int64()), ("step_group", pa.int64())])


def pack(df: DataFrame, vocabulary: str, tiers: Iterable[int] = (256, 512, 1024, 2048, 4096), group_tokens: int = 65_536, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: id, start, length, token_ids, doc_tokens, sequence_id, offset, sequence_tokens, tier, step_group.

    A null or empty text is the end id alone. Each row is a document of its own, also if ids or texts repeat or the id is null; other columns are
    not read. Documents of any length are cut over as many windows as they need. An empty table gives no rows. sequence_id is unique over all partitions
    (partition number and a running number); step_group counts within a partition and tier. Windows shorter than the shortest tier, from
    the end of a partition, carry their own size as tier.
    """
    tiers = tuple(tiers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("packing", forget_tokenizers)
        coder, packer = word_tokenizer(vocabulary, end_id), Packer(tiers, group_tokens)
        first, n = TaskContext.get().partitionId() << 36, 0
        kind = None

        def rows(windows: list[tuple]) -> pa.RecordBatch:
            nonlocal n
            cols: list[list] = [[] for _ in range(10)]
            for size, group, pieces in windows:
                at = 0
                for doc, start, length, ids, total in pieces:
                    for c, v in zip(cols, (doc, start, length, ids, total, first | n, at, size, size, group)):
                        c.append(v)
                    at += length
                n += 1
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, f.type) for c, f in zip(cols[1:], PIECES)]], names=[id_col, *PIECES.names])

        for b in batches:
            kind = b.schema.field(0).type
            for part in by_bytes(b, 1, 4 << 20):
                raw, cuts = coder.encode(part.column(1))
                done: list[tuple] = []
                for doc, i, j in zip(part.column(0).to_pylist(), cuts, cuts[1:]):
                    done += packer.put(doc, raw[i:j])
                if done:
                    yield rows(done)
        if kind is not None and (done := packer.finish()):
            yield rows(done)
        release()  # the worker outlives the task

    own = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {own}, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier long, step_group long")
