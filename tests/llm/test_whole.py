"""Whole results where a bound could cut them."""

import base64
import hashlib
import math

import corpus_pipeline
from pyspark.sql import functions as F

from verdictflow.llm import chosen_path, pii, toxicity
from verdictflow.llm.histogram_sort import histogram_shards

DOCS = "doc_id long, text string, n_chars int"


def secret(k, size):
    return base64.b64encode(b"".join(hashlib.sha256(f"{k}-{i}".encode()).digest() for i in range(-(-size // 40)))).decode()[:size]


def test_long_secrets_vanish_whole(spark):
    sizes = [8, 40, 199, 200, 201, 420, 840]
    rows = [(k, f"login of service {k}: token = {secret(k, sizes[k % 7])} and so on", 0) for k in range(28)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in pii.find(docs, pii.fit(docs)).collect()}
    for k, text, _ in rows:
        spans = [(s.start, s.end) for s in got[k].pii_spans if s.kind == "secret"]
        assert spans == [(text.index("token"), text.index(" and so on"))]
    left = {r.doc_id: r.text for r in corpus_pipeline.replace_personal_data(spark, docs, "").collect()}
    assert left == {k: f"login of service {k}: <secret> and so on" for k in left} and len(left) == 28


def test_links_at_the_threshold(spark):
    """Crowds in which every pair has the same similarity, too large to be compared before full depth: the links found are counted."""
    shapes, size = {0.8: (80, 10), 0.82: (164, 18), 0.85: (170, 15)}, 200  # words that all share, words of one text
    rows = []
    for s, (core, own) in shapes.items():
        for crowd in range(5 if s == 0.8 else 2):
            shared = [f"c{s}-{crowd}-{k}" for k in range(core)]
            rows += [(len(rows) + k, " ".join(shared + [f"o{s}-{crowd}-{k}-{j}" for j in range(own)]), s) for k in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s double")
    links = {r.s: r.n for r in docs.join(chosen_path.jaccard_join(docs, n=1, threshold=0.8), "doc_id").groupBy("s").agg({"n_links": "sum"}).toDF("s", "n").collect()}
    lost = {s: 1 - links[s] / (sum(r[2] == s for r in rows) * (size - 1)) for s in shapes}
    assert all(v <= 1e-4 for v in lost.values())


def test_runs_reach_the_recall():
    for s in (0.7, 0.8, 0.85):
        runs, lost = chosen_path.runs_for(0.9999, s), 0.0
        least = s * 64 - 4.5 * math.sqrt(64 * s * (1 - s))
        for agree in range(65):
            stay = 0.75 * agree / 64 + 0.25 * (1 - (1 - agree / 64) ** 2)
            lost += math.comb(64, agree) * s**agree * (1 - s) ** (64 - agree) * ((1 - stay**4) ** runs if agree >= least else 1)
        assert lost <= 1e-4


def test_field_fits_clean_texts_of_least_hash(spark, monkeypatch):
    labels = spark.createDataFrame([(k, int(k % 50 == 0)) for k in range(4000)], "doc_id long, toxic int")
    docs = labels.selectExpr("doc_id", "concat('text ', doc_id) as text")
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: [t for t, y in zip(texts, toxic) if not y])
    fitted = toxicity.fit(docs, labels)[: toxicity.FIT_CLEAN]
    clean = labels.where((labels.toxic == 0) & ~toxicity.held_out(labels.doc_id)).orderBy(F.xxhash64("doc_id")).limit(toxicity.FIT_CLEAN)
    assert fitted == [f"text {r.doc_id}" for r in clean.collect()] and len(fitted) == toxicity.FIT_CLEAN


def test_one_large_row_does_not_loosen_the_shards(spark):
    """Groups of copies of a third of a shard beside one row of nearly half a shard: only the boundary that falls into this row is off."""
    rows = [(k, f"group {k % 50}", 10) for k in range(20_000)] + [(20_000, "large", 5_000)]
    placed = histogram_shards(spark.createDataFrame(rows, "doc_id long, key string, size long"), ["key"], ["doc_id"], "size", shards=16)
    loads = {r.shard: r.size for r in placed.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    mean, below, off = 205_000 / 16, 0, []
    for k in range(15):
        below += loads.get(k, 0)
        off.append(abs(below - mean * (k + 1)))
    assert sum(loads.values()) == 205_000 and sorted(off)[-2] <= 0.01 * mean and max(off) <= 2_500 + 0.01 * mean


def test_texts_of_one_id_are_apart(spark):
    """Of two texts that share an id only near copies go, and of those the ones of least id stay."""
    words = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    rows = [(5, words("a")), (5, words("b")), (5, words("b")), (3, words("b") + " end"), (7, words("a") + " end"), (8, None), (8, ""), (9, words("c")), (9, words("c") + " end"), (None, words("a"))]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], DOCS)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    c = [x for x in left if x[0] == 9]
    assert len(c) == 1 and c[0] in rows
    assert sorted((x for x in left if x[0] != 9), key=str) == sorted([rows[0], rows[3], rows[5], rows[6], rows[9]], key=str)


def test_texts_full_of_spans(spark):
    """Thousands of spans, long runs of digits and of hexadecimal digits in a text: all are found, in time that grows with the text."""
    mails = " ".join(f"user{k}@example.org, 10.0.{k % 256}.{k // 256}" for k in range(4000))
    digits, hexes = "7" * 60_000, hashlib.sha256(b"x").hexdigest() * 400
    chain = " ".join("4111 1111 1111 1111, no" for _ in range(500))
    docs = spark.createDataFrame([(1, mails, 0), (2, digits, 0), (3, hexes, 0), (4, chain, 0)], DOCS)
    got = {r.doc_id: r.pii_spans for r in pii.find(docs, pii.fit(docs)).collect()}
    kinds = lambda k, name: sum(s.kind == name and s.base for s in got[k])
    assert (kinds(1, "email"), kinds(1, "ip"), kinds(2, "card"), kinds(4, "card")) == (4000, 4000, 0, 500)
    assert [mails[s.start : s.end] for s in got[1][:2]] == ["user0@example.org", "user1@example.org"]
    clean = {r.doc_id: r.text for r in corpus_pipeline.replace_personal_data(spark, docs, "").collect()}
    assert clean[1] == " ".join(["<email>, <ip>"] * 4000) and clean[3] == hexes
