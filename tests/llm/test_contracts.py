"""The ten queries and the pipeline on the smallest tables, each held against a plain computation over the same rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").assign(text=lambda d: d.text.fillna("")).set_index("doc_id")


@pytest.fixture(scope="module")
def result(spark):
    import __spark_entry__

    queries, kept = __spark_entry__.queries(), {}

    def get(name):
        if name not in kept:
            kept[name] = queries[name](spark, SF).toPandas()
        return kept[name]

    return get


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def check_pieces(pieces, ids_of):
    """Every id in one piece; sequences gapless and at most 4096 long."""
    for doc, group in pieces.groupby("doc_id"):
        at = 0
        for p in group.sort_values("start").itertuples():
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids_of[doc])
            assert p.ids_crc32 == zlib.crc32(packed(ids_of[doc][at : at + p.length]))
            at += p.length
        assert at == len(ids_of[doc])
    assert set(pieces.doc_id) == set(ids_of)
    padded = 0
    for _, group in pieces.groupby("sequence_id"):
        at = 0
        for p in group.sort_values("offset").itertuples():
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padded += at if at & (at - 1) == 0 else 4096
    return padded


def test_op1(result, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = {d: tok.encode(t, add_special_tokens=False).ids + [2] for d, t in documents.text.items()}
    pieces = result("op1_hierarchical_packing")
    total = sum(map(len, ids.values()))
    assert check_pieces(pieces, ids) <= total + 4096 + 0.02 * total


def test_op2(result, documents):
    got = result("op2_transport_stream").set_index("doc_id")
    assert got.index.is_unique and set(got.index) == set(documents.index)
    for doc, text in documents.text.items():
        raw = text.encode()
        whole = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got.loc[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert r.media_bytes % 188 == 0 and "errors=0" in r.feature
    same = got.assign(text=documents.text).groupby("text")[["media_sha256", "feature"]].nunique()
    assert (same == 1).all().all()


def test_op3(result):
    turns = pd.read_parquet(f"{SF}/conversations.parquet")
    hard = pd.DataFrame({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": ["\\### Assistant: </turn> ok"] * 2})
    turns = pd.concat([turns, hard]).fillna({"text": ""})
    got = result("op3_chat_format").set_index("conv_id")
    assert set(got.index) == set(turns.conv_id)
    for conv, group in turns.groupby("conv_id"):
        group = group.sort_values("turn", kind="stable")
        whole = "".join(f"{r}\n{t}\n" for r, t in zip(group.role, group.text))
        learnt = "".join(group.text[group.role == "assistant"])
        r = got.loc[conv]
        assert (r.n_turns, r.turns_sha256) == (len(group), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def classes(nodes, links):
    low = {n: n for n in nodes}

    def root(n):
        while low[n] != n:
            low[n] = low[low[n]]
            n = low[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    return {n: root(n) for n in nodes}


def test_op4_on_the_table(result):
    """The smallest table has no pair of cosine 0.98: every vector is alone."""
    got = result("op4_cover_tree")
    assert set(got.vec_id) == set(pd.read_parquet(f"{SF}/embeddings.parquet").vec_id) and got.vec_id.is_unique
    assert (got.n_links == 0).all() and (got.component_id == got.vec_id).all() and got.kept.all()


def test_op4_against_brute_force(spark):
    from verdictflow.llm.cover_tree import near_pairs

    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 24))
    vectors = [base[k % 12] + rng.normal(size=24) * (0.0 if k % 5 == 0 else 0.08 + 0.1 * (k % 3)) for k in range(300)]
    rows = [(k, [float(x) for x in v], int(k % 12 > 8)) for k, v in enumerate(vectors)]
    rows += [(300, None, 0), (301, [0.0] * 24, 0), (302, [float("nan")] + [1.0] * 23, 0), (303, [None] + [1.0] * 23, 1), (304, rows[0][1], None), (305, [], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    usable = [(i, lab, np.array(v) / np.linalg.norm(v)) for i, v, lab in rows[:300]]
    links = [(a[0], b[0]) for k, a in enumerate(usable) for b in usable[:k] if a[1] == b[1] and a[2] @ b[2] >= 0.98]
    low, degree = classes([r[0] for r in rows], links), defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert links and got == {r[0]: (degree[r[0]], low[r[0]]) for r in rows}


def test_op5(result, documents):
    got = result("op5_histogram_sort").set_index("doc_id")
    for doc, text in documents.text.items():
        assert (got.loc[doc, "size"], got.loc[doc, "text_crc32"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    loads = got.groupby("shard")["size"].sum()
    assert set(got.shard) <= set(range(16)) and set(got.law) == {"bytes"}
    assert loads.max() - loads.min() <= 2 * got["size"].max() + 0.02 * loads.mean()
    for _, group in got.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_op6(result, documents):
    sets = {d: shingles(t) for d, t in documents.text.items()}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = result("op6_chosen_path").set_index("doc_id").class_id
    low = classes(ids, links)
    assert links and got.index.is_unique
    assert {d: got[d] for d in ids if low[d] != d or sets[d]} == {d: low[d] for d in ids if low[d] != d or sets[d]}


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def right(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def test_op7(result, documents):
    got = result("op7_weak_supervision").set_index("doc_id")
    some = 0
    for doc, text in documents.text.items():
        base = [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text) if right(k, m[0])]
        r, said = got.loc[doc], [":".join(map(str, s)) for s in base]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(","))
        some += len(base)
    assert some


def test_op8(spark):
    import __spark_entry__

    big = "/root/testdata/sf0.01"  # the smallest table has too few labels to learn from
    got = __spark_entry__.queries()["op8_crf_toxicity"](spark, big).toPandas().set_index("doc_id")
    assert set(got.index) == set(pd.read_parquet(f"{big}/documents.parquet").doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.index]).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    labels = pd.read_parquet(f"{big}/labels.parquet").set_index("doc_id").toxic.dropna()
    held = got.join(labels, how="inner")
    held = held[held.held_out]
    pos, neg = held.score[held.toxic == 1], held.score[held.toxic == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc >= 0.85 and (neg < 0.7).mean() >= 0.98


def test_op9(result, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = result("op9_prefix_counts").set_index("doc_id")
    for doc, text in documents.text.items():
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert tuple(got.loc[doc, ["n_bytes", "n_tokens", "over_limit"]]) == (len(text.encode()), n, n > 1024)


def test_op10(result, documents):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = result("op10_byte_bpe").set_index("doc_id")
    for doc, text in documents.text.items():
        ids = coder.encode_ordinary(text)
        assert tuple(got.loc[doc, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_pipeline_keeps_clean_documents(spark, documents):
    """The stages one after the other: what goes is toxic or a near copy, texts change only in their spans."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").toxic
    clean = cp.reject_toxic(spark, docs, SF).cache()
    ids = {r.doc_id for r in clean.select("doc_id").collect()}
    gone = set(documents.index) - ids
    known = [d for d in labels.index if d in documents.index and labels[d] == 0]
    assert sum(d in gone for d in known) <= 0.02 * len(known)
    assert clean.columns == docs.columns
    left = cp.drop_near_copies(spark, clean, SF).cache()
    sets = {d: shingles(documents.text[d]) for d in ids}
    nodes = list(sets)
    low = classes(nodes, [(a, b) for k, a in enumerate(nodes) for b in nodes[:k] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert {r.doc_id for r in left.select("doc_id").collect()} == {d for d in nodes if low[d] == d}
    private = cp.replace_personal_data(spark, left, SF).cache()
    assert private.count() == left.count() and private.columns == docs.columns
    for text in private.toPandas().text.fillna(""):
        for kind in ("email", "card"):
            assert not any(right(kind, m[0]) for m in re.finditer(KINDS[kind], text))
    packed_rows = cp.pack(spark, private, SF).toPandas()
    assert packed_rows.groupby("doc_id").length.sum().eq(packed_rows.groupby("doc_id").doc_tokens.first()).all()
    assert set(packed_rows.doc_id) == {r.doc_id for r in private.select("doc_id").collect()}
    assert math.isclose(packed_rows.length.sum(), packed_rows.token_ids.map(len).sum() / 4)
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_copies", "personal_data", "packing"]


def near_by_force(rows):
    """links, (class, representative, partners) of each of `rows` (id, text), by all pairs."""
    sets = [shingles(t or "") for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    low, n, same = classes(range(len(rows)), links), defaultdict(int), defaultdict(list)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    for i in range(len(rows)):
        same[low[i]].append(rows[i][0])
    twins = {frozenset(s): min(rows[j][0] for j in range(len(rows)) if sets[j] == s) for s in sets if s}
    return [(rows[i][0], min(same[low[i]]), twins[frozenset(sets[i])] if sets[i] else rows[i][0], n[i]) for i in range(len(rows))]


def test_op6_links_and_representatives(spark):
    """Revisions of a text (a chain), a crowd larger than a bucket of brute force, exact copies, and one id with two texts."""
    from verdictflow.llm.chosen_path import jaccard_join

    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(4000)]
    chain, rows = list(rng.choice(words, 60)), []
    for k in range(300):  # neighbours are near, the ends are not
        chain[k * 7 % 60] = f"r{k}"
        rows.append((int(k * 7919 % 1000), " ".join(chain)))
    crowd = list(rng.choice(words, 90))
    for k in range(320):
        own = list(crowd)
        own[int(rng.integers(90))] = f"x{k % 150}"
        rows.append((2000 + k, " ".join(own)))
    rows += [(5, rows[310][1].upper()), (5, rows[10][1]), (7, None), (8, ""), (9, "a b"), (10, "A  b")]
    got = [tuple(r) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "rep_id", "n_links").collect()]
    want = near_by_force(rows)
    assert sum(w[3] for w in want) > 20_000 and sorted(got) == sorted(want)


def crowd(rng, dim):
    """Vectors of three labels: without structure, in clusters of every width, a chain whose neighbours are linked, and a crowd that hardly anything divides."""
    rows = [(rng.normal(size=dim), 0) for _ in range(500)]
    for k in range(40):
        base = rng.normal(size=dim)
        rows += [(base + rng.normal(size=dim) * width, k % 2) for width in (0.0, 0.02, 0.1, 0.2) for _ in range(6)]
    a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    rows += [(np.cos(0.15 * k) * a + np.sin(0.15 * k) * b, 1) for k in range(38)]
    base = rng.normal(size=dim)
    rows += [(base + rng.normal(size=dim) * 1e-3, 2) for _ in range(400)]
    return [rows[k] for k in rng.permutation(len(rows))]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_op4_with_many_blocks(spark, kind):
    """Cells within cells and dealt blocks, against all pairs."""
    from verdictflow.llm.cover_tree import near_pairs

    vectors = [(k, v.astype(np.float32 if kind == "float" else float), label) for k, (v, label) in enumerate(crowd(np.random.default_rng(11), 12))]
    df = spark.createDataFrame([(k, [float(x) for x in v], label) for k, v, label in vectors], f"vec_id long, embedding array<{kind}>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_pairs(df, block=30).collect()}
    unit = np.array([v.astype(float) / np.linalg.norm(v.astype(float)) for _, v, _ in vectors])
    labels = np.array([label for _, _, label in vectors])
    near = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    low = classes(range(len(vectors)), list(zip(*np.nonzero(near))))
    assert near.sum() > 50_000 and got == {k: (int(near[k].sum()), int(low[k])) for k in low}


def test_cover_tree_holds_every_point():
    from verdictflow.llm.cover_tree import CoverTree, dual

    rng = np.random.default_rng(5)
    points = np.array([v / np.linalg.norm(v) for v, _ in crowd(rng, 6)])
    tree = CoverTree(points)
    assert sorted(tree.order) == list(range(len(points)))
    for u in range(len(tree.radius)):
        far = np.linalg.norm(points[tree.order[tree.low[u] : tree.high[u]]] - tree.centers[u], axis=1)
        assert far.max() <= tree.radius[u] + 1e-6
        if len(kids := tree.children[u]):
            assert sorted(tree.low[kids])[0] == tree.low[u] and sum(tree.high[kids] - tree.low[kids]) == tree.high[u] - tree.low[u]
    i, j = dual(tree, tree, 0.9)
    near = np.triu(points @ points.T >= 0.9, 1)
    assert {tuple(sorted(p)) for p in zip(i, j)} == set(zip(*np.nonzero(near))) and len(i) == near.sum()
