"""Python workers are used again: what one stage keeps in them must not stay through the others."""

import gc
import random
import tracemalloc

import pyarrow as pa

from evidentia.llm import base, columns, sentencepiece_codec, token_counts


def test_a_stage_leaves_what_others_hold():
    sentencepiece_codec._WORKER[b"model"] = "codec"
    base.leave(sentencepiece_codec.__name__)
    assert base.held(sentencepiece_codec.__name__) == {b"model": "codec"}
    token_counts._WORKER["content"] = ("tokenizer", {})
    base.leave(token_counts.__name__)
    assert not sentencepiece_codec._WORKER and token_counts._WORKER
    base.leave("evidentia.llm.quality_rules")
    assert not token_counts._WORKER


def test_workers_drop_the_models_of_the_stage_before(spark):
    def keep(batches):
        from evidentia.llm import base

        base.held("another.module")["model"] = "kept"
        yield from batches

    def look(batches):
        from evidentia.llm import base

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(base.held("another.module"))] * len(batch), pa.int64())], ["n"])

    rows = spark.range(64).repartition(8)
    base.arrow_map(rows, keep, "id long").collect()
    assert {r["n"] for r in base.arrow_map(rows, look, "n long").collect()} == {0}


def test_tables_of_all_stages_stay_until_the_module_changes():
    base.leave("one")
    columns._powers(columns._BASE, 10)
    base.leave("one")
    assert columns._POWERS
    base.leave("other")
    assert not columns._POWERS


def test_kept_parts_take_little_memory():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        own = sentencepiece_codec.Codec(file.read())
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdefghij", k=9)) for _ in range(20_000)})
    own.encode(["a b"])
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        own.encode([" ".join(words)])
        gc.collect()
        after = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(own.recent) >= len(words) and (after - before) / len(words) < 300
