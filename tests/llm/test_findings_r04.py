"""What the fourth round found in the corpus operators."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from prudentia.llm import word_model
from prudentia.llm.textscan import column_bytes, mix
from tests.llm import brute


@pytest.mark.parametrize("heavy, buckets", [(30, 1), (12, 1), (12, 16)])
def test_words_told_apart_have_their_continuations_from_all_parts(spark, monkeypatch, heavy, buckets):
    """op7: a word met very often is dealt by the word before it; what follows it was
    counted within each part, so bits hung on how many parts there were."""
    rng = random.Random(5)
    docs = {}
    for i in range(50):
        docs[i] = (rng.choice(["en", "fr", None]), [rng.choice("aaabbcdefghijk") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 25))])
    docs[60] = docs[3]

    def turn_of(lang, word):
        w, of, _, _ = word_model._word_hashes(*column_bytes(pa.array([word.replace("<", "x")])), [lang])
        return int(mix(of + np.uint64(1))[0] if word == "<" else w[0]) % word_model.ROUNDS

    rows = [(i, lang, " ".join(w) + " ") for i, (lang, w) in docs.items()]
    total = sum(len(r[2]) for r in rows)
    monkeypatch.setattr(word_model, "HEAVY", heavy)
    monkeypatch.setattr(word_model, "BUCKET_BYTES", max(1, total // (word_model.ROUNDS * buckets)))
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    assert len(word_model.heavy_words(frame, "text", "lang", total)[0]) >= 3
    data, offsets = column_bytes(pa.array([r[2] for r in rows]))
    keys = word_model.doc_keys(data, offsets, [r[1] for r in rows]).tolist()
    want = brute.kneser_ney_bits(docs, turn_of, lambda w: 1.5 * (len(w) + 1))
    found = word_model.word_bits(frame, lambda data, offsets, languages, begin, end, doc: (end - begin) * 1.5, total)
    got = {r.doc: r.word_bits for r in found.collect()}
    assert len(got) == len({k for i, k in enumerate(keys) if rows[i][2].strip()})
    assert all(abs(got[k] - want[r[0]]) < 1e-5 for k, r in zip(keys, rows, strict=True) if docs[r[0]][1])
