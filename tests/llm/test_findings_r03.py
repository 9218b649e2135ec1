"""What the third round found in the corpus operators."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from prudentia.llm import token_store


def test_segments_are_encoded_together_and_exactly():
    """op2: hundreds of new segments are one call's text, and every text has the ids
    that the library gives it whole, whatever stands at its ends."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    letters = list("abcdefgh\u00e9\u4e00'19.,\n\t")
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(4000)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 4000, 40)] + ["", None, " x", "x ", "  two  blanks  ", "a<|endoftext|> b <|endoftext|>", "\u00a0a \u00a0b", "\u2003 c d", "it's we 'll"]
    token_store._encoders.clear()
    encoder = token_store._encoder(path)
    asked = []
    learn = encoder._encode
    encoder._encode = lambda parts: asked.append((len(parts), learn(parts))) or asked[-1][1]
    ids, first = encoder(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text
    n, (flat, sizes) = asked[0]
    assert len(sizes) == n > 2000 and sizes.sum() == len(flat)


def test_an_encoder_that_is_not_over_bytes_gets_segments_one_by_one():
    from prudentia.llm.wordcache import joined

    calls = []
    encode = joined(lambda texts: calls.append(texts) or [[1] * len(t.split()) for t in texts], np.array([0, 2]))
    flat, sizes = encode(["a", " bcd", " e"])
    assert flat.tolist() == [1, 1, 1] and sizes.tolist() == [1, 1, 1]
    assert calls == [["a bcd e"], ["a", " bcd", " e"]]


def test_stages_of_the_pipeline_leave_no_working_tables(spark):
    """pipeline: what a stage has used up is deleted when it returns, so the next one
    has the disk; what its result is read from stays."""
    import corpus_pipeline as p
    from prudentia.llm.storage import shared_dir

    where = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in fs.listStatus(where)} if fs.exists(where) else set()
    shared = " ".join(f"passage{i}" for i in range(60))
    rows = [(i, f"own{i} " * 12 + " ".join(f"w{i}x{k}" for k in range(40)) + (f" {shared} {i} end" if i % 2 else ""), "en", "s", 1) for i in range(12)]
    docs = spark.createDataFrame([*rows, (50, rows[0][1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {}
    for stage, work in (("judged", p.quality), ("near", p.near_dedup), ("passages", p.passage_dedup)):
        before = names()
        made = work(spark, docs, "")
        left[stage] = {n.rsplit("-", 1)[0] for n in names() - before}
        got = {r.doc_id: r.text for r in made.collect()}
        if stage == "near":
            assert set(got) == set(range(12))
        if stage == "passages":
            assert not any("passage30" in t for t in got.values()) and got[3].endswith("3 end") and got[50] == "" == got[0]
    assert left["judged"] <= {"scored", "bands"} and left["near"] <= {"gone", "repeated-rows"} and left["passages"] == {"spans"}


def test_texts_go_to_workers_in_small_batches(spark):
    """pipeline: a batch of whole texts stood several times in the memory of an
    executor, whatever its rows amounted to."""
    import corpus_pipeline
    from prudentia.plans.session import BATCH_BYTES

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat('word ', 1000) || id text", "'en' lang", "'a' source", "5000L n_chars")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(0), "")
        sizes = docs.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "n"]) for b in batches), "bytes long, n long").collect()
        assert sum(r.n for r in sizes) == 3000
        assert max(r.bytes for r in sizes) < BATCH_BYTES + 10_000
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "9m")
    corpus_pipeline.ship_package(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "9m"  # the user's own stays
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_scoring_tables_go_with_their_stage():
    """pipeline: workers held the quality rules' tables through all later stages."""
    from prudentia.llm import perplexity, textscan

    batch = pa.record_batch([pa.array(["a b", None])], ["text"])
    perplexity._tables[("folder", "en")] = (np.zeros(1 << 16, np.int32), np.zeros((300, 256), np.float32))
    assert [p.num_rows for p in textscan.chunks([batch], "text", keep=textscan.SCORING)] == [2]
    assert len(perplexity._tables) == 1
    assert [p.num_rows for p in textscan.chunks([batch], "text")] == [2]
    assert not perplexity._tables


def test_executors_collect_what_a_stage_has_left(spark):
    """pipeline: heaps that ended stages had filled stood beside the workers of the next."""
    from prudentia.llm.storage import release

    context = spark.sparkContext
    context.setJobGroup("released", "")
    release(spark)
    jobs = context.statusTracker().getJobIdsForGroup("released")
    context.setLocalProperty("spark.jobGroup.id", None)
    stages = [context.statusTracker().getStageInfo(s) for j in jobs for s in context.statusTracker().getJobInfo(j).stageIds]
    assert [(s.numTasks, s.numCompletedTasks) for s in stages] == [(context.defaultParallelism,) * 2]
