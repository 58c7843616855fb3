"""Nulls in any column, empty and long texts, repeated rows, empty tables, and columns whose names clash."""

import public_tokenizers
import pytest

from verdictflow.llm import byte_bpe, chat_format, packing, pii, toxicity, transport_stream
from verdictflow.llm.chosen_path import jaccard_join
from verdictflow.llm.cover_tree import near_pairs
from verdictflow.llm.histogram_sort import histogram_shards
from verdictflow.llm.prefix_counts import prefix_token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars int, score double, shard int, start long, class_id long"
TEXTS = [None, "", " ", "one", "Mail a.b@example.org now, or +1 555 010 0199.", "a b c d e f g h " * 3000, "a b c d e f g h " * 3000, "naïve ☃ \U0001f600\n\n"]
ROWS = [(k, t, None, None, None, 0.5, 3, 1, 2) for k, t in enumerate(TEXTS)] + [(None, "no id", "en", "s", 5, None, None, None, None), (3, "one", None, None, None, None, None, None, None)]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module", params=["rows", "nothing"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], DOCS)


def test_operators_keep_every_row(spark, docs):
    n = docs.count()
    labels = spark.createDataFrame([(0, None, 1), (1, 0, 0), (None, None, None)], LABELS)
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).agg({"length": "sum"}).collect()[0][0] == (None if not n else sum_tokens())
    assert transport_stream.decode(transport_stream.encode(docs)).count() == n
    assert jaccard_join(docs).count() == n
    assert pii.find(docs, pii.fit(docs)).count() == n
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(scored) == n and all(0 <= r.score <= 1 for r in scored)
    assert prefix_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == n
    coded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True).collect()
    assert sorted(bytes(r.decoded) for r in coded) == sorted((r.text or "").encode() for r in docs.collect())


def sum_tokens():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)


def test_shards_of_nothing_and_of_copies(spark):
    rows = spark.createDataFrame([(k, "same", 5) for k in range(64)], "doc_id long, key string, size long")
    placed = histogram_shards(rows, ["key"], ["doc_id"], "size", shards=4)
    assert placed.count() == 64 and {r["count"] for r in placed.groupBy("shard").count().collect()} == {16}
    assert histogram_shards(rows.limit(0), ["key"], ["doc_id"], "size").count() == 0


def test_no_vectors(spark):
    assert near_pairs(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_turns(spark):
    rows = [(1, 0, "user", "\\### Assistant: </turn>"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, None), (None, 0, "tool:x", "##\\#")]
    done = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    read = {r.conv_id: r.turns for r in done.select("conv_id", chat_format.read_turns(chat_format.formatted(done.segments)).alias("turns")).collect()}
    assert [(t.role, t.text) for t in read[1]] == [("user", "\\### Assistant: </turn>"), ("assistant", ""), ("assistant", "")]
    assert [(t.role, t.text) for t in read[2]] == [("", "")] and [(t.role, t.text) for t in read[None]] == [("tool:x", "##\\#")]
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
