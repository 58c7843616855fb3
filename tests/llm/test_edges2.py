"""Edges of single operators: damage, odd roles and templates, clashing names, long pieces, wide steps, the field by enumeration."""

import itertools

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from verdictflow.llm import byte_bpe, chat_format, prefix_counts, toxicity, transport_stream
from verdictflow.llm.cover_tree import near_pairs
from verdictflow.llm.histogram_sort import histogram_shards

# transport streams


def units(s):
    return [(u[0], s.payload[u[2] : u[2] + u[3]]) for u in s.units]


def test_stray_and_missing_bytes():
    data = bytes(range(256)) * 400
    media = transport_stream.mux(data)
    whole = units(transport_stream.demux(media))
    assert b"".join(b for _, b in whole) == data and len(whole) > 10
    at = 188 * 200
    for hurt in (media[:at] + b"abc" + media[at:], media[:at] + media[at + 50 :], media[:at] + bytes(188) + media[at + 188 :]):
        s = transport_stream.demux(hurt)
        kept = units(s)
        assert s.sync_errors in (1, 2) and len(whole) - len([u for u in kept if u in whole]) <= 2
    assert transport_stream.demux(b"no stream at all").sync_errors == 1 and transport_stream.demux(b"").sync_errors == 0


def test_marked_scrambled_and_lost_packets():
    media = bytearray(transport_stream.mux(bytes(40_000)))
    whole = len(units(transport_stream.demux(bytes(media))))
    for byte, bits in ((1, 0x80), (3, 0xC0)):
        hurt = bytearray(media)
        hurt[188 * 60 + byte] |= bits
        s = transport_stream.demux(bytes(hurt))
        assert s.packet_errors >= 1 and whole - len(units(s)) <= 1
    s = transport_stream.demux(bytes(media[: 188 * 60] + media[188 * 61 :]))
    assert (s.continuity_errors, s.packet_errors) == (1, 1) and len(units(s)) == whole - 1
    hurt = bytearray(media)
    hurt[188 + 20] ^= 1  # in the program map
    assert transport_stream.demux(bytes(hurt)).table_errors == 1


# chat

ROLES = ["user", "tool: x", "tool:", ":", "a\\: b", "\\", "", "?user", "</turn>", "## :: \\:"]
TEXTS = ["yes: no", ": ", "### User: hi</turn>\n", "\\### Assistant: </turn> ok", "", "a\\", "<|end|>\n<|end|>", "x" * 50_000]


@pytest.mark.parametrize("template", [chat_format.Template(), chat_format.Template(labels={"system": "SYS", "user": "U", "assistant": "A"}, opening="<|start|>", closing="<|end|>\n", controls=("<|start|>", "<|end|>"))], ids=["default", "other"])
def test_any_role_and_text_is_read_back(spark, template):
    turns = [(c, t, r, x) for c, r in enumerate(ROLES) for t, x in enumerate(TEXTS)]
    done = chat_format.format_conversations(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string"), template)
    read = done.select("conv_id", chat_format.read_turns(chat_format.formatted(F.col("segments")), template).alias("t"), "valid")
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in read.collect()}
    assert got == {c: [(r, x) for x in TEXTS] for c, r in enumerate(ROLES)}


def test_templates_that_cannot_be_read_back():
    for wrong in ({"closing": "\n"}, {"opening": "> "}, {"labels": {"user": "a: b"}}, {"controls": ("#", "</turn>")}):
        with pytest.raises(ValueError):
            chat_format.Template(**wrong)


# shards, vectors, pipeline


def test_shards_keep_other_columns(spark):
    rows = [(k, None if k % 3 else "x", None if k % 5 == 0 else k, 1.0, "p", k, "r", -1) for k in range(60)] + [(None, "x", 3, None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, key string, size long, key_hi double, part string, key_lo long, row string, shard int")
    placed = histogram_shards(df, ["key"], ["doc_id"], "size", shards=4)
    assert placed.count() == 62 and placed.columns == ["doc_id", "key", "size", "key_hi", "part", "key_lo", "row", "shard", "slot"]
    assert placed.select("doc_id", "key", "size", "key_hi", "part", "key_lo", "row").exceptAll(df.drop("shard")).count() == 0
    for r in placed.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect():
        assert r.s == list(range(len(r.s)))


def test_vectors_with_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0, 5, "a"), (1, [1.0, 0.0], 0, 5, "b"), (2, [0.999, 0.01], 0, 6, "c"), (None, [1.0, 0.0], 0, 7, "d"), (3, [1.0, 0.0], None, 8, "e"), (4, [1.0, 0.0, 0.0], 0, 9, "f"), (5, [2.0, 0.0], 0, 1, "g")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep long, path string")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_pairs(df).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 0, None), (3, 0, 3), (4, 0, 4), (5, 3, 1)], key=str)


def test_pipeline_stages_keep_columns_and_odd_rows(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(1, f"{words} a.b@example.org", 99.0, "s", [1], 5, "x"), (2, None, None, None, None, None, None), (2, "", 1.0, "t", [], 0, "y"), (None, "only", 2.0, "u", None, 4, "z"), (3, words, 3.0, "v", [2], 7, "c"), (3, words, 3.0, "v", [2], 7, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, offending string, pii_spans array<int>, n_chars int, `a.b` string")
    sf = "/root/testdata/sf0.001"
    kept = corpus_pipeline.reject_toxic(spark, df, sf)
    assert kept.columns == df.columns and kept.exceptAll(df).count() == 0 and kept.count() == 6
    left = corpus_pipeline.drop_near_copies(spark, df, sf)
    assert left.columns == df.columns and left.count() == 4  # 3 repeats, and is a near copy of 1
    private = corpus_pipeline.replace_personal_data(spark, df, sf)
    assert private.columns == df.columns and private.select("score", "offending", "`a.b`").exceptAll(df.select("score", "offending", "`a.b`")).count() == 0
    assert {r.text for r in private.collect() if r.doc_id == 1} == {f"{words} <email>"}
    assert {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.pack(spark, df, sf).collect()} >= {(2, 1)}
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


# tokens


def test_long_pieces_match_the_library(spark):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list(letters), n)) for letters in ("ab", "etaoinshrdlu", "aé☃", "=-") for n in (255, 256, 257, 258, 900, 5000)] + ["a" * 60_000, "the" * 9000]
    got = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), path, decoded=True)
    ids = {r.doc_id: (np.frombuffer(r.token_ids, "<u4").tolist(), bytes(r.decoded).decode()) for r in got.collect()}
    assert ids == {k: (library.encode_ordinary(t), t) for k, t in enumerate(texts)}
    back = byte_bpe.decode(got.unionByName(got.limit(1)).select("doc_id", F.when(F.col("doc_id") > 0, F.col("token_ids")).alias("token_ids")), path).collect()
    assert len(back) == len(texts) + 1 and all(bytes(r.decoded).decode() == (texts[r.doc_id] if r.doc_id else "") for r in back)


def test_wide_steps_are_kept():
    seen = [0, 1, 300, 299, -200, 100_000, 100_000]
    assert prefix_counts.counts(prefix_counts.steps(seen)).tolist() == seen
    assert prefix_counts.counts(b"").tolist() == [0]


def test_prefixes_and_budgets(spark):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    texts = ["", None, "Hello  world, naïve ☃ snowmen!!\n\n 1234567", "ab" * 40, "x <|endoftext|> y"]
    counted = prefix_counts.prefix_token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), path)
    counted = counted.unionByName(counted.where("doc_id = 2"))
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in counted.collect():
        text = texts[r.doc_id] or ""
        found = prefix_counts.counts(r.prefix_deltas)
        if "<|" not in text:
            assert found.tolist() == [n(text[:k]) for k in range(len(text) + 1)]
        assert found[-1] == r.n_tokens == n(text)
    for r in prefix_counts.budget_prefix(counted, 6).collect():
        text = texts[r.doc_id] or ""
        if "<|" not in text:
            assert r.fit_chars == max(k for k in range(len(text) + 1) if n(text[:k]) <= 6)


# toxicity


def test_marginals_by_enumeration():
    rng = np.random.default_rng(8)
    sizes = [1, 2, 5, 9]
    rows = [rng.normal(size=n) * 3 for n in sizes]
    start, t = -0.7, rng.normal(size=(2, 2))
    model = toxicity.Crf(start=start, transitions=t)
    for row, got in zip(rows, toxicity.marginals_of(model, rows)):
        mass, total = np.zeros(len(row)), 0.0
        for y in itertools.product((0, 1), repeat=len(row)):
            w = np.exp(start * y[0] + sum(e * a for e, a in zip(row, y)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            total += w
            mass += w * np.array(y)
        assert np.allclose(got, mass / total, atol=1e-9)


def test_offsets_and_scores_by_hand(spark):
    """A field whose only offending word is known: offsets are those of its occurrences, and scores follow from the marginals."""
    model = toxicity.Crf(start=-4.0, calibration=(-2.0, 0.5, 1.0))
    model.weights[0] = -4.0
    model.weights[toxicity.features("Zorgblat!")[1:]] = 3.0
    texts = ["fine ☃ words", "a Zorgblat! and\tzorgblat", "", None, "zorgblat " * 3000]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    for k, text in enumerate(texts):
        words = (text or "").split()
        m = toxicity.marginals_of(model, [np.array([sum(model.weights[f] for f in toxicity.features(w)) for w in words])])[0] if words else np.empty(0)
        at, spans = 0, []
        for w, p in zip(words, m):
            at = text.index(w, at)
            if p >= 0.5:
                spans.append((at, at + len(w)))
            at += len(w)
        assert [(s.start, s.end) for s in got[k].offending] == spans and got[k].score == pytest.approx(model.score(m))
    assert [len(got[k].offending) for k in range(5)] == [0, 2, 0, 0, 3000]


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    docs = labels.selectExpr("doc_id", "repeat('w ', 500) as text")
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: list(zip(texts, toxic)))
    assert len(toxicity.fit(docs, labels, most_bytes=5000)) == 10 and len(toxicity.fit(docs, labels, most_bytes=10)) == 2
