"""What Python workers keep from task to task."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from public_tokenizers import path

from graphloom.llm import common, near_copies, packing, sentence_pieces, token_alignment
from graphloom.llm.registry import tokenizer_path


def test_a_stage_drops_what_another_kind_of_task_kept():
    """A tokenizer and the words it met take 150 MB; a worker that goes on to sketch texts must not hold them."""
    texts = pd.Series(["one two three four five six", None])
    packing._ids(tokenizer_path())
    first, *rest = near_copies.sketches.func(iter([texts]))
    assert packing._ids.cache_info().currsize == 0
    assert not rest and first.n.tolist() == [2, 0]
    with_tokenizer = packing._ids(tokenizer_path())
    common.give_back(packing._ids)
    assert packing._ids(tokenizer_path()) is with_tokenizer
    common.give_back()


def test_freed_batches_go_back_to_the_system():
    def held():
        return int(next(x for x in open("/proc/self/smaps_rollup") if x.startswith("Private_Dirty")).split()[1]) / 1024

    @common.tidy()
    def batch_sizes(batches):
        for batch in batches:
            yield len(batch.to_pylist())

    text = pa.array([f"{k} " + "word " * 100 for k in range(100_000)])  # 50 MB
    before = held()
    assert list(batch_sizes(iter([text, text]))) == [100_000, 100_000]
    assert held() - before < 20


def test_units_that_come_round_again_are_not_learnt_again(monkeypatch):
    """A worker meets the same 300,000 words over and over; each is merged and compared with the library once."""
    codec, learnt = sentence_pieces.Codec(path("piece_bpe_32k.model"), check=False), []
    learn = codec._learn
    monkeypatch.setattr(codec, "_learn", lambda units: (learnt.append(len(units)), learn(units)))
    texts = [" ".join(f"{k:x}" for k in range(at, at + 1000)) for at in range(0, 300_000, 1000)]
    for _ in range(2):
        for at in range(0, len(texts), 50):
            codec.encode(texts[at : at + 50])
    assert sum(learnt) == 300_000


def held():
    return int(next(x for x in open("/proc/self/smaps_rollup") if x.startswith("Private_Dirty")).split()[1]) / 1024


def test_a_packing_worker_does_not_grow_with_new_words():
    """A worker met 600,000 words and kept them, in two tables, with their ids."""
    ids = packing._ids(tokenizer_path())
    texts = [" ".join(f"w{k:x}q" for k in range(at, at + 1000)) for at in range(0, 700_000, 1000)]
    packing.token_bytes(texts[0], ids)
    common.give_back(packing._ids)
    before = held()
    for text in texts:
        packing.token_bytes(text, ids)
    common.give_back(packing._ids)
    assert held() - before < 20
    common.give_back()


def test_texts_come_in_small_batches(spark):
    """Texts of 16 MB came to a worker at once; the session's own settings are in force again afterwards."""
    before = {k: spark.conf.get(k) for k in common.BATCH}

    @F.pandas_udf("long")
    def together(batch: pd.Series) -> pd.Series:
        return pd.Series([batch.str.len().sum()] * len(batch))

    rows = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text"))
    with common.small_batches(spark):
        most = common.written(rows.select(together("text").alias("n")), "batches").agg(F.max("n")).first()[0]
    assert most <= 5_000_000 and {k: spark.conf.get(k) for k in common.BATCH} == before


def test_an_aligning_worker_gives_its_batches_back():
    """The aligner stays known; the memory of a task's texts and rows goes back to the system, and other tasks drop the aligner."""
    run = token_alignment._aligned(tokenizer_path(), path("piece_bpe_32k.model")).func
    own = token_alignment.aligner(tokenizer_path(), path("piece_bpe_32k.model"))
    texts = pd.Series(["some words again " * 4000] * 60)
    list(run(iter([texts[:5]])))
    before = held()
    rows = [(len(x), x.a.map(lambda v: v.dtype == "int32").all()) for x in run(iter([texts] * 3))]
    assert sum(n for n, _ in rows) == 180 and all(narrow for _, narrow in rows)
    assert held() - before < 20 and token_alignment.aligner(tokenizer_path(), path("piece_bpe_32k.model")) is own
    list(near_copies.sketches.func(iter([texts[:1]])))
    assert token_alignment.aligner.cache_info().currsize == 0
