"""Workers outlive stages: what an operator has cached in one must be gone when another operator works there."""

import public_tokenizers
import pyarrow as pa

from verdictflow.llm import chosen_path, common, packing


class Sent:
    """Takes the place of a table and keeps the function that an operator sends to the workers."""

    def __init__(self, docs):
        self.schema = docs.schema

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        self.function = function
        return self


def held(docs, function):
    """(tokenizers, words) that a worker holds once `function` has run there, and once another operator has begun."""

    def look(batches):
        for _ in function(batches):
            pass
        words = chosen_path._WORDS
        now = lambda: (len(packing._TOKENIZERS), len(words) + len(words.old))
        first = now()
        common.alone("another", int)
        yield pa.RecordBatch.from_arrays([pa.array([n]) for n in (*first, *now())], names=["a", "b", "c", "d"])

    return [tuple(r) for r in docs.mapInArrow(look, "a long, b long, c long, d long").collect()]


def test_workers_let_go(spark):
    docs = spark.createDataFrame([(k, f"w{k} some words of a text") for k in range(40)], "doc_id long, text string").repartition(2)
    packed = held(docs, packing.pack(Sent(docs), public_tokenizers.path("word_bpe_49k.json")).function)
    assert all(r[0] == 1 and r[2] == 0 for r in packed) and packed
    hashed = held(docs, chosen_path._sets(Sent(docs), 5, "doc_id", "text").function)
    assert all(r[1] == r[3] == 0 for r in hashed) and hashed


def test_arrow_gives_back():
    own = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:")) / 1024
    common.release()
    parts = [pa.array(range(20_000), pa.int64()) for _ in range(600)]  # 96 MB in small pieces
    full = own()
    kept = parts[::100]
    del parts
    common.release()
    assert full - own() > 60 and len(kept) == 6
