"""Jaccard join of word n-gram sets by chosen paths.

Equal sets are one class from the start. Each set has a signature of T minhashes. A run starts with all sets in one bucket and splits it recursively: a
bucket's path chooses one coordinate of the signature, and with probability EXTRA a second one, and the sets that share the token sampled there
go on together. Buckets of at most SMALL sets, or at depth DEPTH, are compared by brute force. Two sets whose signatures agree in a share a stay together at
one split with probability (1 - EXTRA) a + EXTRA (1 - (1 - a)^2). All runs see the same T coordinates, so the number of runs follows from the recall that is
asked for at the threshold and the full depth as an expectation over the binomial agreement of the T coordinates, less what the filter on signatures loses.

Large buckets are compared block by block. A pair counts only in the first bucket that its sets share, so no pair is counted twice, and each comparison
returns link counts and a spanning forest, never its pairs. Signatures sort out pairs first; what is left is verified on the sets themselves.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerationCache, alone, by_bytes, connected_components, cut, release

T = 64  # coordinates of a signature
EXTRA = 0.25
SMALL = 64
DEPTH = 4
BLOCK = 256  # sets of a large bucket that are compared with so many others at once
SIGMAS = 4.5  # a pair whose signatures agree this many deviations less than expected at the threshold isn't verified, unless the recall needs it
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, T, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, T, dtype=np.uint64)


def _share(agree: int, threshold: float) -> float:
    """The share of pairs at the threshold whose signatures agree in so many coordinates."""
    return math.comb(T, agree) * threshold**agree * (1 - threshold) ** (T - agree)


def least_agreement(recall: float, threshold: float) -> int:
    """Coordinates in which signatures must agree for a pair to be verified; this loses at most half of what `recall` allows."""
    least = max(0, math.ceil(threshold * T - SIGMAS * math.sqrt(T * threshold * (1 - threshold))))
    while least and sum(_share(k, threshold) for k in range(least)) > (1 - recall) / 2:
        least -= 1
    return least


def missed(runs: float, recall: float, threshold: float) -> float:
    """The share of pairs at the threshold that `runs` runs of full depth and the filter lose."""
    lost, least = 0.0, least_agreement(recall, threshold)
    for agree in range(T + 1):
        a = agree / T
        one = (1 - EXTRA) * a + EXTRA * (1 - (1 - a) ** 2)
        lost += _share(agree, threshold) * (1.0 if agree < least else (1 - one**DEPTH) ** runs)
    return lost


def runs_for(recall: float, threshold: float) -> int:
    if missed(math.inf, recall, threshold) > 1 - recall:
        raise ValueError(f"signatures of {T} coordinates can't reach a recall of {recall} at {threshold}")
    high = 1
    while missed(high, recall, threshold) > 1 - recall:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if missed(mid, recall, threshold) > 1 - recall else (low, mid)
    return high


_WORDS = TwoGenerationCache(lambda w: xxhash.xxh3_64_intdigest(w), 100_000)


def forget_words() -> None:
    _WORDS.forget()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of lower-cased words; a text of fewer words is one n-gram, one without words has none."""
    words = np.array(list(map(_WORDS.__getitem__, text.lower().split())), np.uint64)
    if not len(words):
        return words
    w = min(n, len(words))
    h = np.full(len(words) - w + 1, w, np.uint64)
    for k in range(w):
        h = mixed(h + words[k : len(words) - w + 1 + k])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        out = np.minimum(out, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1))
    return (out >> np.uint64(33)).astype(np.int32)


def _keys(sets: list[bytes]) -> list[pa.Array]:
    """The two halves of each set's 128-bit key."""
    own = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in sets]), "<i8").reshape(-1, 2)
    return [pa.array(own[:, 0]), pa.array(own[:, 1])]


def _sets(df: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, n, sig): a 128-bit key of each document's set, its size and signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("chosen_path", forget_words)
        gc.freeze()
        gc.set_threshold(100_000, 50, 1000)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                own = [shingles(t or "", n) for t in part.column(1).to_pylist()]
                size, sig = [len(s) for s in own], [signature(s) for s in own]
                k1, k2 = _keys([s.tobytes() for s in own])
                flat = pa.array(np.concatenate(sig) if sig else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), k1, k2, pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(range(0, T * len(own) + 1, T), pa.int32()), flat)], names=["doc_id", "k1", "k2", "n", "sig"])
        forget_words()  # the worker outlives the task
        release()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, n int, sig array<int>")


def _split(rows: DataFrame) -> DataFrame:
    """(rep, path) -> (rep, path) one level deeper; `rows` has sig."""
    pick = lambda k: F.pmod(F.xxhash64("path", F.lit(k)), F.lit(T)).cast("int")
    child = lambda i: F.xxhash64("path", i, F.get("sig", i))
    second = (F.pmod(F.xxhash64("path", F.lit(2)), F.lit(1000)) < int(1000 * EXTRA)) & (pick(1) != pick(0))
    return rows.select("rep", F.explode(F.when(second, F.array(child(pick(0)), child(pick(1)))).otherwise(F.array(child(pick(0))))).alias("path"))


def buckets(reps: DataFrame, runs: int) -> DataFrame:
    """(rep, bucket, size): the buckets of at least two sets that are compared by brute force."""
    sigs = reps.select("rep", "sig")
    frontier = sigs.select("*", F.explode(F.array(*[F.lit(r) for r in range(runs)])).alias("run")).select("rep", "sig", F.xxhash64("run", F.lit(7)).alias("path"))
    done = None
    for level in range(1, DEPTH + 1):
        nodes = _split(frontier)
        shared = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        rows = cut(nodes.join(shared, "path").select("rep", F.col("path").alias("bucket"), "size"))
        last = level == DEPTH
        own = rows if last else rows.where(F.col("size") <= SMALL)
        done = own if done is None else done.unionAll(own)
        large = rows.where(F.col("size") > SMALL)
        if last or large.isEmpty():
            return done
        frontier = large.select("rep", F.col("bucket").alias("path")).join(sigs, "rep")
    raise AssertionError


def _blocks(live: DataFrame, detail: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each two blocks of a bucket that meet: (bucket, lo, hi, items). As n_links counts every partner, each set of a large bucket meets all its blocks."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = live.join(detail, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.groupBy("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list(F.struct("rep", "own", *columns)).alias("items")).where(F.size("items") > 1)


def _meeting(own: np.ndarray, lists: list[list[int]], bucket: int, lo: int, hi: int) -> np.ndarray:
    """Which pairs (upper triangle) are to be compared here: across the two blocks, or within the one, and in no earlier bucket."""
    n = len(own)
    meet = np.triu(np.ones((n, n), bool), 1)
    if lo != hi:
        meet &= own[:, None] != own[None, :]
    places: dict[int, list[int]] = {}
    for k, own_list in enumerate(lists):
        for b in own_list:
            if b >= bucket:
                break
            places.setdefault(b, []).append(k)
    before = [p for p in places.values() if len(p) > 1]
    if before:
        m = np.zeros((n, len(before)), np.float32)
        for c, p in enumerate(before):
            m[p, c] = 1
        meet &= m @ m.T == 0
    return meet


def _numbers(column: pa.Array, name: str) -> np.ndarray:
    return column.field(name).to_numpy(zero_copy_only=False)


def _likely(recall: float, threshold: float):
    """Per two blocks: the sets that have a pair worth verifying here."""
    least = least_agreement(recall, threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("chosen_path", forget_words)
        for b in batches:
            items, out = b.column(3), ([], [], [], [], [])
            for k in range(b.num_rows):
                g = items[k].values
                size, sig = _numbers(g, "n"), g.field("sig").flatten().to_numpy().reshape(-1, T)
                bucket, lo, hi = b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].as_py()
                agree = np.zeros((len(size), len(size)), np.int16)
                for c in range(T):
                    agree += sig[:, c][:, None] == sig[:, c][None, :]
                good = (agree >= least) & (np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]))
                np.fill_diagonal(good, False)
                if not good.any():
                    continue
                own, rep = _numbers(g, "own"), _numbers(g, "rep")
                good &= _meeting(own, g.field("buckets").to_pylist(), bucket, lo, hi)
                for i in np.flatnonzero(good.any(axis=0) | good.any(axis=1)).tolist():
                    for o, v in zip(out, (bucket, lo, hi, int(rep[i]), int(own[i]))):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))], names=["bucket", "lo", "hi", "rep", "own"])
        release()

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    rank = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    row, col = row[keep], rank[inverse[keep]]
    out = np.zeros((n, n), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        i, j = np.searchsorted(col, [at, at + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[row[i:j], col[i:j] - at] = 1
        out += m @ m.T
    out[np.diag_indices(n)] = [len(s) for s in sets]
    return out


def _verified(threshold: float):
    """Per two blocks: (rep, links, root) of each set, its verified links here and the root of its tree here."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("chosen_path", forget_words)
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for k in range(b.num_rows):
                g = b.column(3)[k].values
                g = g.take(pa.array(np.unique(_numbers(g, "rep"), return_index=True)[1]))  # texts of one id and set come once
                rep, many = _numbers(g, "rep"), _numbers(g, "mult")
                sets = [np.frombuffer(x, np.uint64) for x in g.field("set").to_pylist()]
                both, size = overlaps(sets), np.array([len(s) for s in sets])
                linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                linked &= _meeting(_numbers(g, "own"), g.field("buckets").to_pylist(), b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].as_py())
                linked |= linked.T
                links, root = linked @ many, np.arange(len(rep))
                while True:  # the smallest number among neighbours, until nothing moves
                    new = np.minimum(root, np.where(linked, root[None, :], len(rep)).min(axis=1))
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                hit = links > 0
                for o, v in zip(out, (rep[hit], links[hit], rep[root[hit]])):
                    o += v.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["rep", "links", "root"])
        release()

    return run


def jaccard_join(df: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, rep_id, n_links), a row for each row of `df`.

    Two documents are linked if the Jaccard similarity of their sets of `n`-grams of words is at least `threshold`; documents of equal sets are. rep_id is the
    smallest id of the same set, class_id the smallest id reachable by links, n_links the number of other rows linked directly. Every link reported is exact; a link at
    the threshold is found with probability `recall` at least. Null and texts without words are linked with nothing, nor are rows whose set has no id but null.
    Rows may repeat (each counts); rows of one id and different texts are documents of their own. Other columns are not read. An empty table gives no rows. Ids are integers.
    """
    all_ = cut(_sets(df, n, id_col, text_col))
    own = all_.where("n > 0 and doc_id is not null").groupBy("k1", "k2")
    reps = own.agg(F.min(F.col("doc_id").cast("long")).alias("low"), F.count(F.lit(1)).alias("mult"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))  # a set's number; least ids may be shared
    live = buckets(reps, runs_for(recall, threshold))
    lists = live.groupBy("rep").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    detail = cut(reps.join(lists, "rep").select("rep", "low", "k1", "k2", "n", "mult", "sig", "buckets"))
    likely = cut(_blocks(live, detail.select("rep", "n", "sig", "buckets"), ["n", "sig", "buckets"]).mapInArrow(_likely(recall, threshold), "bucket long, lo int, hi int, rep long, own int"))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("chosen_path", forget_words)
        for b in batches:
            for part in by_bytes(b, 1, 1 << 20):
                found = [shingles(t or "", n).tobytes() for t in part.column(1).to_pylist()]
                k1, k2 = _keys(found)
                yield pa.RecordBatch.from_arrays([part.column(0), k1, k2, pa.array(found, pa.binary())], names=["low", "k1", "k2", "set"])
        forget_words()
        release()

    used = detail.join(likely.select("rep").distinct(), "rep", "left_semi").select("rep", "low", "k1", "k2", "mult", "buckets")
    texts = df.select(F.col(id_col).cast("long").alias("low"), F.col(text_col).alias("text")).join(used.select("low").distinct(), "low", "left_semi").dropDuplicates(["low", "text"])
    full = texts.mapInArrow(sets, "low long, k1 long, k2 long, set binary").join(used, ["low", "k1", "k2"]).select("rep", "mult", "buckets", "set")
    pairs = likely.join(full, "rep").groupBy("bucket", "lo", "hi").agg(F.collect_list(F.struct("rep", "own", "mult", "buckets", "set")).alias("items")).where(F.size("items") > 1)
    found = cut(pairs.mapInArrow(_verified(threshold), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), reps.select(F.col("rep").alias("node"), "low"))
    classes = classes.select(F.col("node").alias("rep"), F.col("component").alias("class_id"))
    of = reps.select("k1", "k2", "rep", "low", "mult").join(links, "rep", "left").join(classes, "rep", "left")
    of = of.select("k1", "k2", F.col("low").alias("rep_id"), F.coalesce("class_id", "low").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    joined = all_.select("doc_id", "k1", "k2", "n").join(of, ["k1", "k2"], "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep_id", "doc_id").alias("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
