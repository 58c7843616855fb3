"""Toxic spans by a linear-chain conditional random field.

Labels mark documents, so labelled tokens are made first: word beginnings whose documents are toxic far more often than chance allows
mark tokens of toxic documents; clean documents hold none. The field has two states, emission weights over hashed word features and transition weights, and is
fitted by its exact likelihood (forward-backward) on a bounded sample. Every text is then scored whole: marginals of all tokens by forward-backward, side by
side for texts of similar length, are aggregated to a calibrated document score and the offsets of offending tokens.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TwoGenerationCache, alone, by_bytes, release

BUCKETS = 1 << 16  # of hashed features
#: Bounds of the labelled sample: this many toxic and clean documents at most, those of least hash.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 3500
SAMPLE_BYTES = 48 << 20  # of the texts of each class
FIT_CLEAN = 800  # clean documents of the sample that the field itself is fitted to; all of them count for signs and calibration
SURE = 20.0  # likelihood ratio from which a word beginning counts as a sign of toxic documents
COVERS = 12.0  # the same, for documents that no other sign explains
SIDE_BY_SIDE, PLACES = 256, 300_000  # texts, and places of the padded matrix, in one forward-backward pass
_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_WORD = regex.compile(r"\S+")


def beginnings(token: str) -> list[str]:
    """Word beginnings of 3 to 6 letters and more, where "$" is the end of a word."""
    w = _LETTERS.sub("", token.lower())
    if not w:
        return []
    w += "$"
    return [f"<{w[:n]}" for n in (3, 4, 5, 6) if n <= len(w)] or [f"<{w}"]


def features(token: str) -> list[int]:
    """Hashed features of a token; the first is the bias, which all tokens have."""
    names = beginnings(token)
    if names:
        names = [*names, ">" + _LETTERS.sub("", token.lower())[-3:]]
    return [0, *[1 + zlib.crc32(n.encode()) % (BUCKETS - 1) for n in names]]


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def _log_mix(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds of the next state from those of this one, r, and the transition weights t[from, to]."""
    return np.logaddexp(t[0, 1], t[1, 1] + r) - np.logaddexp(t[0, 0], t[1, 0] + r)


def forward_backward(emission: np.ndarray, size: np.ndarray, start: float, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of state 1 by what stands before (with the token itself) and by what stands after, and the marginals.

    `emission` is texts by tokens, padded on the right. Working on log-odds keeps any length in range.
    """
    n, w = emission.shape
    before, after = np.zeros((n, w)), np.zeros((n, w))
    r = np.full(n, start)
    for k in range(w):
        r = (r if not k else _log_mix(r, t)) + emission[:, k]
        before[:, k] = r
    r = np.zeros(n)
    back = t.T
    for k in range(w - 2, -1, -1):
        r = _log_mix(r + emission[:, k + 1], back)
        r[k >= size - 1] = 0.0
        after[:, k] = r
    return before, after, 1 / (1 + np.exp(-np.clip(before + after, -40, 40)))


def groups(sizes: np.ndarray) -> list[np.ndarray]:
    """Texts of similar length together; one very long text is a group of its own."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    out, at = [], 0
    while at < len(order):
        end = min(len(order), at + SIDE_BY_SIDE)
        while end - at > 1 and (sizes[order[end - 1]] > 2 * sizes[order[at]] + 64 or (end - at) * sizes[order[end - 1]] > PLACES):
            end = at + max(1, (end - at) // 2)
        out.append(order[at:end])
        at = end
    return out


def padded(rows: list[np.ndarray], own: np.ndarray, fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(rows[k]) for k in own])
    m = np.full((len(own), int(size.max())), fill)
    m[np.arange(m.shape[1]) < size[:, None]] = np.concatenate([rows[k] for k in own])
    return m, size


@dataclass
class Crf:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    start: float = 0.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: tuple[float, float, float] = (-8.0, 0.0, 0.0)  # of a document: constant, per unit of peak log-odds, per offending token (log)
    threshold: float = 0.5  # marginal from which a token offends

    def document(self, marginals: np.ndarray) -> tuple[float, float]:
        """Peak log-odds and the logarithm of 1 + the marginal mass of offending tokens."""
        if not len(marginals):
            return -12.0, 0.0
        top = min(max(float(marginals.max()), 6e-6), 1 - 6e-6)
        return float(np.log(top / (1 - top))), float(np.log1p(marginals[marginals >= self.threshold].sum()))

    def score(self, marginals: np.ndarray) -> float:
        a, b = self.document(marginals)
        c = self.calibration
        return float(1 / (1 + np.exp(-np.clip(c[0] + c[1] * a + c[2] * b, -40, 40))))


def signs(docs: list[np.ndarray], toxic: np.ndarray, n_names: int, new_contexts: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Which word beginnings mark toxic documents, by the likelihood ratio of their document counts.

    `docs` holds the distinct beginnings of each document as numbers. The ratio asked for grows with the number of beginnings that are
    tried, so that none passes by chance. `new_contexts(document, beginnings)` keeps those that the document has between neighbours not
    met before: words of a toxic text that was copied many times are no signs for that.
    """
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    count = lambda own: np.bincount(np.concatenate([*own, np.empty(0, np.int64)]), minlength=n_names).astype(float)
    clean = count([d for d, t in zip(docs, toxic) if not t])

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        def like(k, n, x):
            return k * np.log(np.maximum(x, 1e-12)) + (n - k) * np.log(np.maximum(1 - x, 1e-12))

        both = (a + b) / (n1 + n0)
        r = 2 * (like(a, n1, a / n1) + like(b, n0, b / n0) - like(a, n1, both) - like(b, n0, both))
        return np.where(a * n0 > b * n1 * 8, r, 0.0)  # at least eight times as frequent

    left = [d for d, t in zip(docs, toxic) if t]
    all_ = count(left)
    tried = int(((all_ + clean) >= 3).sum())
    hopeful = (all_ >= 2) & (ratio(all_, clean) >= 5)
    left = [new_contexts(k, d[hopeful[d]]) for k, d in zip(np.flatnonzero(toxic), left)]
    all_ = count(left)
    found = (all_ >= 3) & (ratio(all_, clean) >= max(SURE, 2 * np.log(max(1, tried)) + 4))
    while True:  # signs of documents that have none yet
        left = [d for d in left if not found[d].any()]
        own = count(left) * (clean == 0)
        r = np.where(own >= 2, ratio(own, clean), 0.0)
        best = int(r.argmax()) if len(r) else 0
        if not len(r) or r[best] < max(COVERS, 2 * np.log(max(1, int((own >= 2).sum()))) + 6):
            return found
        found[best] = True


def train(texts: list[str], toxic: list[int], epochs: int = 30, rate: float = 0.6, ridge: float = 0.02) -> Crf:
    """Fit the field and its calibration. Without both classes, or without any sign, nothing is toxic."""
    y = np.array(toxic, bool)
    model = Crf()
    if not y.any() or y.all():
        return model
    types: dict[str, int] = {}
    rows = [np.array([types.setdefault(w, len(types)) for w in t.split()], np.int32) for t in texts]
    numbers: dict[str, int] = {}
    flat, feature, first, of = array("i"), array("i"), array("i", [0]), array("i")
    for k, w in enumerate(types):
        flat.extend([numbers.setdefault(n, len(numbers)) for n in beginnings(w)])
        first.append(len(flat))
        hashed = features(w)
        feature.extend(hashed)
        of.extend([k] * len(hashed))
    n_types, n_names = len(types), len(numbers)
    del types, numbers
    flat, feature, first, of = (np.array(x, np.int32) for x in (flat, feature, first, of))

    def all_names(r: np.ndarray) -> np.ndarray:
        many = first[r + 1] - first[r]
        return np.unique(flat[np.repeat(first[r] - np.cumsum(many) + many, many) + np.arange(many.sum())]) if len(r) else r

    own = [all_names(np.unique(r)) for r in rows]
    met: set[tuple[int, int, int]] = set()

    def new_contexts(k: int, among: np.ndarray) -> np.ndarray:
        wanted, r, fresh = set(among.tolist()), rows[k].tolist(), set()
        for at, word in enumerate(r):
            for n in wanted.intersection(flat[first[word] : first[word + 1]].tolist()):
                context = (n, r[at - 1] if at else -1, r[at + 1] if at + 1 < len(r) else -1)
                if context not in met:
                    met.add(context)
                    fresh.add(n)
        return np.array(sorted(fresh), np.int64)

    sure = signs(own, y, n_names, new_contexts)
    del own, met
    marked = np.bincount(np.repeat(np.arange(n_types), np.diff(first)), weights=sure[flat], minlength=n_types) > 0
    labels = [marked[r] & bool(t) for r, t in zip(rows, y)]
    use = [k for k in range(len(rows)) if y[k] and labels[k].any()]
    use += [k for k in range(len(rows)) if not y[k] and len(rows[k])][: FIT_CLEAN]
    if not any(labels[k].any() for k in use):
        return model
    sizes = np.array([len(rows[k]) for k in use])
    parts = []
    for g in groups(sizes):
        ids, size = padded([rows[use[k]] for k in g], np.arange(len(g)), 0)
        want, _ = padded([labels[use[k]].astype(float) for k in g], np.arange(len(g)))
        parts.append((ids.astype(np.int32), want.astype(np.float32), size, np.arange(ids.shape[1]) < size[:, None]))
    total = len(use)
    w, t, start = model.weights, model.transitions, -3.0
    t[:] = [[0.5, -0.5], [0.0, 0.0]]
    w[0] = -3.0
    seen, seen_t, seen_s = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(epochs):
        by_type = np.bincount(of, weights=w[feature], minlength=n_types)
        grad_type, grad_t, grad_s = np.zeros(n_types), np.zeros((2, 2)), 0.0
        for ids, want, size, inside in parts:
            e = by_type[ids] * inside
            before, after, p = forward_backward(e, size, start, t)
            grad_type += np.bincount(ids[inside], weights=(want - p)[inside], minlength=n_types)
            grad_s += float((want[:, 0] - p[:, 0]).sum())
            # pair marginals: log-weights of (a, b) at neighbours, up to a constant
            left, right = before[:, :-1], (after + e)[:, 1:]
            logs = np.stack([np.broadcast_to(t[0, 0], left.shape), t[0, 1] + right, t[1, 0] + left, t[1, 1] + left + right])
            logs = np.exp(logs - logs.max(axis=0))
            logs /= logs.sum(axis=0)
            pairs = inside[:, 1:]
            y0, y1 = want[:, :-1], want[:, 1:]
            seen_pairs = [(1 - y0) * (1 - y1), (1 - y0) * y1, y0 * (1 - y1), y0 * y1]
            for k in range(4):
                grad_t[k // 2, k % 2] += float((seen_pairs[k] - logs[k])[pairs].sum())
        g = np.bincount(feature, weights=grad_type[of], minlength=BUCKETS) - ridge * w
        seen += g * g / total
        w += rate * g / np.sqrt(seen * total)
        gt = grad_t - ridge * t
        seen_t += gt * gt / total
        t += 0.3 * gt / np.sqrt(seen_t * total)
        seen_s += grad_s**2 / total
        start += 0.3 * grad_s / np.sqrt(seen_s * total)
    model.start = start
    # calibration over all documents of the sample
    by_type = np.bincount(of, weights=w[feature], minlength=n_types)
    x = np.array([[1.0, *model.document(m)] for at in range(0, len(rows), 512) for m in marginals_of(model, [by_type[r] for r in rows[at : at + 512]])])
    c = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (p - y) + 0.5 * c)
        c -= step
        if np.abs(step).max() < 1e-6:
            break
    model.calibration = (float(c[0]), float(c[1]), float(c[2]))
    return model


def marginals_of(model: Crf, emissions: list[np.ndarray]) -> list[np.ndarray]:
    out = [np.empty(0)] * len(emissions)
    for own in groups(np.array([len(e) for e in emissions])):
        m, size = padded(emissions, own)
        p = forward_backward(m, size, model.start, model.transitions)[2]
        for k, row, n in zip(own, p, size):
            out[k] = row[:n]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, most_bytes: int = SAMPLE_BYTES) -> Crf:
    """Train on labelled documents that aren't held out: at most `toxic` toxic and `clean` clean ones, those of least hash, and of each class those that together have `most_bytes` at most, or the first alone.

    Labels other than 0 and 1 and null ids are not used; of repeated labels of a document the higher one counts, of texts that share an id the least. Two passes: ids of the sample,
    then their texts, by a broadcast of at most toxic + clean ids.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).where(F.col("_toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    own = own.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    picked = [own.where(F.col("_toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, toxic), (0, clean))]
    sample = picked[0].unionAll(picked[1])
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(sample), "_id")
    rows = texts.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).withColumn("_hash", F.xxhash64("_id"))
    before = Window.partitionBy("_toxic").orderBy("_hash", "_id")  # of at most toxic + clean rows
    rows = rows.withColumn("_upto", F.sum(F.octet_length("_text")).over(before)).withColumn("_first", F.row_number().over(before) == 1)
    rows = rows.where((F.col("_upto") <= most_bytes) | F.col("_first")).drop("_upto", "_first").collect()
    rows.sort(key=lambda r: (r["_hash"], r["_id"]))  # train() fits the field to the first clean ones
    return train([r["_text"] for r in rows], [r["_toxic"] for r in rows])


class Tagger:
    """A model with the emissions of tokens that it has met."""

    def __init__(self, model: Crf, cache: int = 80_000):
        self.model = model
        w = model.weights.tolist()
        self.cache = TwoGenerationCache(lambda t: sum([w[f] for f in features(t)]), cache)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        get = self.cache.__getitem__
        return marginals_of(self.model, [np.array(list(map(get, t.split()))) for t in texts])


_TAGGERS: dict[str, Tagger] = {}


def score(df: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, score_col: str = "score", spans_col: str = "offending") -> DataFrame:
    """(id, score, offending array<struct<start, end, probability>>) for each row; with `keep`, behind all columns of `df`.

    Null and empty texts are scored as texts without tokens. Offsets are code points, ends exclusive. Every text is scored whole, and memory holds the texts of about 4 MB at a time, or one longer one.
    The results are named `score_col` and `spans_col`; with `keep`, columns of `df` that have these names give way to them.
    """
    names = [c for c in df.columns if c not in (score_col, spans_col)] if keep else [id_col]
    sent = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, whatever the input
    key = str(id(sent)) + str(model.calibration)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
    result = pa.struct([("score", pa.float64()), ("offending", spans_type)])

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        alone("toxicity", _TAGGERS.clear)
        if key not in _TAGGERS:
            _TAGGERS.clear()
            _TAGGERS[key] = Tagger(sent.value)
            gc.freeze()
            gc.set_threshold(100_000, 50, 1000)
        tagger = _TAGGERS[key]
        for column in batches:
            done = []
            for part in by_bytes(pa.RecordBatch.from_arrays([column], names=["text"]), 0, 4 << 20):
                texts = [t or "" for t in part.column(0).to_pylist()]
                found, spans = tagger(texts), []
                for t, m in zip(texts, found):
                    hits = set(np.flatnonzero(m >= tagger.model.threshold).tolist())
                    spans.append([{"start": w.start(), "end": w.end(), "probability": float(m[k])} for k, w in enumerate(_WORD.finditer(t)) if k in hits] if hits else [])
                done.append(pa.StructArray.from_arrays([pa.array([tagger.model.score(m) for m in found], pa.float64()), pa.array(spans, spans_type)], fields=list(result)))
            yield pa.concat_arrays(done) if done else pa.array([], result)
        tagger.cache.forget()  # the worker outlives the task, and other stages need the memory
        release()

    # only the texts travel to the workers, and nothing of them comes back
    judged = F.arrow_udf(judge, "struct<score: double, offending: array<struct<start: long, end: long, probability: double>>>").asNondeterministic()
    scored = df.select(*[F.col(f"`{c}`") for c in names], judged(F.col(text_col)).alias("_judged"))
    return scored.select(*[F.col(f"`{c}`") for c in names], F.col("_judged.score").alias(score_col), F.col("_judged.offending").alias(spans_col))
