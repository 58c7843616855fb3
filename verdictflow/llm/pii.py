"""Personal data by weak supervision.

Patterns propose candidate spans. Five labelers vote on each (1 for, -1 against, 0 abstains): the strict form of the kind, a gazetteer, words just before it that announce the
kind, words just before it that name something else, and words just after it. Expectation-maximisation over the counts of vote patterns, taken over all rows, estimates how reliable each
labeler is on each kind; its posteriors are the soft labels of a logistic span classifier over votes and shape features, which decides on what the strict forms leave open.
Spans of the four base kinds that pass their checks always stay.

A text is scanned for a kind only if it holds what every span of that kind needs, which is looked for first and cheaply.
DataFrame functions only: the driver sees counts of vote and feature patterns, at most FEATURE_SPACE rows whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

#: Candidate patterns. Possessive and guarded by what stands before, so that a scan is linear and needs no stack; they find what the plain
#: forms find: nothing follows the repeated groups, and a match can only start where a run of its first class starts or a match has just ended. Cards are
#: looked for from 16 digits on, as shorter runs never pass their check.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "loose": r"(?<![\w+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])",
    "secret": r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_-]{8,}+[\"']?",
}
#: What a text must hold to be scanned for a source: a string, then a pattern that begins with a rare character.
NEEDS = {
    "email": ("@", r"@[A-Za-z0-9-]"),
    "ip": (".", r"[0-9]\.[0-9]++\.[0-9]"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": ("+", r"\+[0-9]"),
    "loose": ("", r"[0-9]{3}[\x20.-][0-9]{4}"),
    "secret": ("", r"[=:]\x20?[\"']?[A-Za-z0-9+/_-]{8}"),
}
#: A column of candidates -> its kind.
SOURCES = {"email": "email", "ip": "ip", "card": "card", "phone": "phone", "loose": "phone", "secret": "secret"}

# Gazetteers; fixed values: generic and country domains, calling codes, first digits of card issuers, networks that aren't public, names of credentials.
DOMAINS = """com org net edu gov mil int info biz name io dev app ai me tv co eu
    ar at au be bg br ca ch cl cn cz de dk ee es fi fr gr hk hr hu ie il in is it jp kr lt lu lv mx nl no nz pe pl pt ro rs ru se si sk sg th tr tw ua uk us za""".split()
CALLING = """1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98
    212 213 216 218 234 254 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 852 886 961 962 965 966 971 972 974""".split()
ISSUERS = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 6011 65 35 36 38 62".split()
PRIVATE_NETWORKS = ("0", "10", "127", "169.254", "192.168", "255", *[f"172.{k}" for k in range(16, 32)], *map(str, range(224, 255)))
CREDENTIALS = "password passwd pwd secret token api".split()


def _any(names) -> str:
    return "(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")"


#: Patterns over a span, from the gazetteers, that speak for a kind.
GAZETTEER = {
    "email": rf"(?i)\.{_any(DOMAINS)}$",
    "ip": rf"^(?!{_any(PRIVATE_NETWORKS)}\.)",
    "card": rf"^{_any(ISSUERS)}",
    "phone": rf"^(?:\+\x20?{_any(CALLING)}|\(?[2-9])",
    "secret": rf"(?i)^{_any(CREDENTIALS)}",
}
#: Words that announce a kind within CONTEXT characters before a span.
CUES = {
    "email": r"(?i)mail|contact|write|@",
    "ip": r"(?i)\bip\b|host|server|address",
    "card": r"(?i)card|visa|credit|konto|tarjeta|carte",
    "phone": r"(?i)phone|tel|call|fax|mobile|ruf",
    "secret": r"(?i)login|user|auth|key|pass",
}
#: Words there that name another thing with such a form.
OTHERS = {
    "email": r"(?i)package|import|decorator|version",
    "ip": r"(?i)version|release|section|chapter|\bv\x20?$",
    "card": r"(?i)isbn|order|invoice|tracking|serial|iban",
    "phone": r"(?i)isbn|order|invoice|version|page|total",
    "secret": r"(?i)example|sample|placeholder|dummy",
}
#: Words that speak for a kind within CONTEXT characters behind a span.
BEHIND = {
    "email": r"(?i)^[\x20,;)>]*(?:or|for|phone|tel|call|und|oder|ou|para)\b",
    "ip": r"(?i)^[\x20,;)]*(?:port|on|host|:[0-9])",
    "card": r"(?i)^[\x20,;)]*(?:exp|valid|cvv|cvc|until)",
    "phone": r"(?i)^[\x20,;)]*(?:ext|fax|or|mobile|email|e-mail)\b",
    "secret": r"(?i)^[\x20,;)]*(?:host|user|port|and|for)\b",
}
CONTEXT = 24
LABELERS = ("strict", "gazetteer", "context", "other", "behind")
FEATURES = {"size": 4, "left": 3, "right": 3, "digits": 3}  # feature -> number of values
FEATURE_SPACE = len(KINDS) * 3 ** len(LABELERS) * 4 * 3 * 3 * 3  # far fewer occur: two labelers only speak for a kind, one only against


def _luhn(text: Column) -> Column:
    """Whether a string of digits and separators has 16 to 19 digits and a right check digit."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)

    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.struct((acc["sum"] + F.when(acc["even"], twice).otherwise(d)).alias("sum"), (~acc["even"]).alias("even"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("even"))
    total = F.aggregate(F.split(F.reverse(digits), "(?<=[0-9])(?=[0-9])"), start, add, lambda acc: acc["sum"])
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(False)


def _strict(kind: str, text: Column) -> Column:
    """The check that a base span of `kind` must pass."""
    if kind == "ip":
        return ~F.exists(F.split(text, "[.]"), lambda p: ~p.rlike(r"\A0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\z"))
    if kind == "card":
        return _luhn(text)
    if kind == "phone":
        return F.length(F.regexp_replace(text, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


BLOCK = 128  # items that are folded before their results are joined to those before


def _fold(items: Column, state: Column, step, kind: str) -> Column:
    """struct<s, all array<kind>>: the last state and what `step` (state, item) -> (state, array of results) gave, in order.

    Results are gathered block by block, so a long array isn't copied for each of its items.
    """
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        s, found = step(acc["s"], x)
        return F.struct(s.alias("s"), acc["all"].alias("all"), F.concat(acc["own"], found).alias("own"))

    def block(acc: Column, own: Column) -> Column:
        return F.aggregate(own, F.struct(acc["s"].alias("s"), acc["all"].alias("all"), none.alias("own")), one, lambda a: F.struct(a["s"].alias("s"), F.concat(a["all"], F.array(a["own"])).alias("all")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    return F.aggregate(blocks, F.struct(state.alias("s"), nothing.alias("all")), block, lambda a: F.struct(a["s"].alias("s"), F.flatten(a["all"]).alias("all")))


def _places(source: str) -> Column:
    """Starts of the matches, in code points, from what lies between them."""
    m, g = F.col(f"_m_{source}"), F.col(f"_g_{source}")
    sizes = F.arrays_zip(F.transform(F.slice(g, F.lit(1), F.size(m)), F.length).alias("gap"), F.transform(m, F.length).alias("own"))
    starts = _fold(sizes, F.lit(0).cast("int"), lambda at, x: (at + x["gap"] + x["own"], F.array(at + x["gap"])), "int")["all"]
    return F.when(F.size(m) > 0, starts).otherwise(F.array().cast("array<int>"))


def _side(c: Column) -> Column:
    """0: an edge of the text or white space; 1: a quote, bracket or sentence mark; 2: anything else."""
    return F.when(c.rlike(r"\A\s?\z"), 0).when(c.rlike(r"[\"'()\[\]<>,;:=.!?]"), 1).otherwise(2)


def _spans(source: str) -> Column:
    kind = SOURCES[source]
    m, g, s = F.col(f"_m_{source}"), F.col(f"_g_{source}"), F.col(f"_s_{source}")

    def span(x: Column, i: Column) -> Column:
        before, after, start = F.get(g, i), F.get(g, i + 1), F.get(s, i)
        near, behind = F.substring(before, -CONTEXT, CONTEXT), F.substring(after, 1, CONTEXT)
        ok = F.lit(False) if source == "loose" else _strict(kind, x)
        size, digits = F.length(x), F.length(F.regexp_replace(x, "[^0-9]", "")) / F.length(x)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            start.alias("start"),
            (start + size).alias("end"),
            (ok if kind in BASE_KINDS else F.lit(False)).alias("base"),
            (F.lit(0) if source == "loose" else F.when(ok, 1).otherwise(-1)).cast("int").alias("strict"),
            F.when(x.rlike(GAZETTEER[kind]), 1).otherwise(-1).alias("gazetteer"),
            F.when(near.rlike(CUES[kind]), 1).otherwise(0).alias("context"),
            F.when(near.rlike(OTHERS[kind]), -1).otherwise(0).alias("other"),
            F.when(behind.rlike(BEHIND[kind]), 1).otherwise(0).alias("behind"),
            F.when(size < 10, 0).when(size < 16, 1).when(size < 32, 2).otherwise(3).alias("size"),
            _side(F.substring(before, -1, 1)).alias("left"),
            _side(F.substring(after, 1, 1)).alias("right"),
            F.when(digits < 0.3, 0).when(digits < 0.8, 1).otherwise(2).alias("digits"),
        )

    return F.transform(m, span)


def candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with `_candidates`: array<struct<kind, start, end, base, votes .., features ..>>."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = df
    for source, p in PATTERNS.items():
        needed, pattern = NEEDS[source]
        guard = text.contains(needed) & text.rlike(pattern) if needed else text.rlike(pattern)
        found = found.withColumn(f"_m_{source}", F.when(guard, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")))
    found = found.withColumns({f"_g_{s}": F.when(F.size(f"_m_{s}") > 0, F.split(text, p, -1)) for s, p in PATTERNS.items()})
    found = found.withColumns({f"_s_{s}": _places(s) for s in PATTERNS})
    found = found.withColumns({f"_c_{s}": _spans(s) for s in PATTERNS})
    strong = lambda c: F.exists("_c_phone", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    found = found.withColumn("_c_loose", F.filter("_c_loose", lambda c: ~strong(c)))
    return found.withColumn("_candidates", F.concat(*[F.col(f"_c_{s}") for s in PATTERNS])).drop(*[f"_{x}_{s}" for x in "mgsc" for s in PATTERNS])


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities by kind, and the weights of the classifier: feature name -> value -> weight."""

    reliability: dict[str, dict[str, float]]
    bias: float
    weights: dict[str, dict[int, float]]

    def probability(self, c: Column) -> Column:
        z = F.lit(self.bias)
        for name, by_value in self.weights.items():
            own = F.lit(0.0)
            for value, w in by_value.items():
                own = F.when(c[name] == value, F.lit(w)).otherwise(own)
            z = z + own
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def expectation_maximisation(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict[str, dict[str, float]]]:
    """Posterior of each vote pattern, and each labeler's estimated accuracy where it votes; patterns start from the mean vote."""
    post = 1 / (1 + np.exp(-votes.sum(axis=1) * 1.5))
    reliability: dict[str, dict[str, float]] = {}
    for _ in range(rounds):
        new = post.copy()
        for k in np.unique(kinds):
            own = kinds == k
            n, p = counts[own], post[own]
            prior = (np.sum(n * p) + 2) / (n.sum() + 4)
            log = np.full(own.sum(), np.log(prior) - np.log(1 - prior))
            reliability[KINDS[k]] = {}
            for j, name in enumerate(LABELERS):
                v = votes[own, j]
                # a labeler is taken to be better than chance: pseudo-counts of 4 agreeing votes for each one that disagrees
                like = {}
                for value in (-1, 0, 1):
                    for y, w in ((1, p), (0, 1 - p)):
                        agree = 4.0 if value * (2 * y - 1) > 0 else 1.0
                        like[value, y] = (np.sum(n * w * (v == value)) + agree) / (np.sum(n * w) + 6.0)
                log += np.array([np.log(like[x, 1]) - np.log(like[x, 0]) for x in v])
                right, wrong = like[1, 1] + like[-1, 0], like[-1, 1] + like[1, 0]
                reliability[KINDS[k]][name] = float(right / (right + wrong))
            new[own] = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        if np.abs(new - post).max(initial=0.0) < 1e-6:
            break
        post = new
    return post, reliability


def fit(df: DataFrame, text_col: str = "text", rounds: int = 200) -> SpanModel:
    """Estimate reliabilities and train the span classifier on all rows of `df`. Without any candidate the model keeps to the votes."""
    names = ["kind", *LABELERS, *FEATURES]
    values: dict[str, tuple[int, ...]] = {n: (-1, 0, 1) for n in LABELERS} | {n: tuple(range(k)) for n, k in FEATURES.items()} | {"kind": tuple(range(len(KINDS)))}

    def code(c: Column) -> Column:
        """A candidate's kind, votes and features as one number, so that only numbers are exploded."""
        out = F.lit(0)
        for name in names:
            out = out * len(values[name]) + c[name] - values[name][0]
        return out

    one = candidates(df.select(text_col), text_col).select(F.explode(F.transform("_candidates", code)).alias("code"))
    rows = []
    for r in sorted(one.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()):
        left, row = r["code"], {"n": r["n"]}
        for name in reversed(names):
            left, digit = divmod(left, len(values[name]))
            row[name] = values[name][digit]
        rows.append(row)
    columns = [(n, v) for n, vs in values.items() for v in vs]
    kinds, counts = np.array([r["kind"] for r in rows], int), np.array([r["n"] for r in rows], float)
    votes = np.array([[r[n] for n in LABELERS] for r in rows], float).reshape(-1, len(LABELERS))
    soft, reliability = expectation_maximisation(kinds, votes, counts)
    x = np.array([[float(r[n] == v) for n, v in columns] for r in rows]).reshape(-1, len(columns))
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.array([0.8 * v if n in LABELERS else 0.0 for n, v in columns] + [0.0])
    for _ in range(rounds if len(x) else 0):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - soft)) + 1.0 * w
        hessian = (x * (counts * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    weights: dict[str, dict[int, float]] = {n: {} for n in values}
    for (n, v), value in zip(columns, w):
        weights[n][v] = float(value)
    return SpanModel(reliability, float(w[-1]), weights)


def find(df: DataFrame, model: SpanModel, threshold: float = 0.9, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """`df` with `spans_col`: array<struct<kind string, start int, end int, base boolean, probability double>>, by kind as listed, then start.

    Offsets are code points, ends exclusive. Null texts have no spans. Base spans stay whatever their probability; other candidates need `threshold`.
    Rows may repeat; a column of `df` named `spans_col` gives way to the result; names that begin with an underscore and a letter and underscore are used within.
    """
    kept = F.filter(F.transform("_candidates", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), model.probability(c).alias("probability"))), lambda c: c["base"] | (c["probability"] >= threshold))
    named = F.transform(F.sort_array(kept), lambda c: F.struct(F.get(F.array(*[F.lit(k) for k in KINDS]), c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["probability"].alias("probability")))
    return candidates(df, text_col).withColumn(spans_col, named).drop("_candidates")


def redact(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its kind in angle brackets; of overlapping spans the first one, and of those that start together the longest, counts."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        piece = F.array(F.substr(text, at + 1, s["start"] - at), F.concat(F.lit("<"), s["kind"], F.lit(">")))
        skip = s["start"] < at
        return F.when(skip, at).otherwise(s["end"]), F.when(skip, F.array().cast("array<string>")).otherwise(piece)

    joined = F.transform(F.array(_fold(ordered, F.lit(0).cast("int"), step, "string")), lambda r: F.concat(F.array_join(r["all"], ""), F.substr(text, r["s"] + 1)))
    return F.when(F.size(spans) > 0, F.get(joined, 0)).otherwise(text)
