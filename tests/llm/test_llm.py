"""The corpus operators against brute force, round trips and edge cases."""

import io
import math
import random
import time
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "  a", " a b ", "a  b", "é ü\n x", "a 　b c", "▁ a ▁b", "<|endoftext|> a <|endoftext|>b", "a\tb  c d\r\n e", "日本 語 テキスト",
    "\x00a b\x1f c", "emoji 😀 x 😀😀 y", "don't we'll I'm 'tis a 's", " \n \n a", "a \n b   ", "x" * 700, "one two three four five six " * 60, "a b c d",
]


def odd_docs(spark, extra=True):
    """Null ids and texts, ties, repeated rows and a clashing extra column."""
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 5 else None) for i, t in enumerate(ODD)]
    rows += [rows[17], rows[18], (100, ODD[18], "en", "s1"), (101, ODD[17], "en", None), (102, "word " * 40 + "end", "fr", "s0")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.withColumn("size", F.lit("clash")).withColumn("class", F.lit(1)) if extra else frame


def small_docs(spark, below=10**9):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").where(F.col("doc_id") < below)


def texts_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


# ---- 1: suffix dedup -------------------------------------------------------


def test_merged_transforms_find_all_repeats():
    from prudentia.llm import bwt

    rng = random.Random(1)
    for _ in range(12):
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 300))) for _ in range(5)]
        strings = []
        for _ in range(12):
            a, b = rng.choice(base), rng.choice(base)
            strings.append(a[rng.randint(0, len(a)) :] + b[: rng.randint(0, len(b))])
        weight, length = np.array([rng.choice([1, 1, 2]) for _ in strings]), rng.choice([25, 50, 100])
        count = brute.Counter()
        for s, w in zip(strings, weight, strict=True):
            for i in range(len(s) - length + 1):
                count[s[i : i + length]] += w
        want = [(k, i) for k, s in enumerate(strings) for i in range(len(s) - length + 1) if count[s[i : i + length]] > 1]
        data, bounds = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0] + [len(s) for s in strings])
        string, offset = bwt.repeated(data, bounds, weight, length, rng.choice([64, 500, 10**6]))
        assert list(zip(string.tolist(), offset.tolist(), strict=True)) == want


def test_common_prefixes_of_the_merge():
    from prudentia.llm import bwt

    strings = [b"x" * 60 + b"a" * 50, b"x" * 60 + b"b" * 50, b"y" * 110]
    data, bounds = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0] + [len(s) for s in strings])
    c = bwt.Collection(data, bounds)
    suffixes, _, common = bwt.merge(c, [c.transform(s) for s in bwt.shards(c, bounds, 100)], 4)
    for k in range(1, len(suffixes)):
        pair = [strings[c.string[s]][c.offset[s] :] if s >= c.ends else b"" for s in suffixes[k - 1 : k + 1]]
        shared = 0
        while shared < 4 and all(len(p) >= 25 * (shared + 1) for p in pair) and pair[0][25 * shared : 25 * shared + 25] == pair[1][25 * shared : 25 * shared + 25]:
            shared += 1
        assert common[k] == shared


@pytest.mark.parametrize(("hot", "large"), [(2000, 4096), (2, 4096), (2, 1)])
def test_suffix_dedup(spark, monkeypatch, hot, large):
    from prudentia.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "LARGE", large)  # 4096: every anchor of so few is split, 1: none
    docs = small_docs(spark, 60).select("doc_id", "text")
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefg ") for _ in range(300))
    made = [(1000 + i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 300))) + passage[i:] + "é" * i) for i in range(12)]
    made += [(2000 + i, t) for i, t in enumerate(["", None, "a" * 1000, "a" * 199, "a" * 200, "é" * 300, "xyz" * 400])]
    docs = docs.union(spark.createDataFrame(made, "doc_id long, text string"))
    docs = docs.union(docs.limit(1))
    got = suffix_dedup.remove_repeats(docs, keep_text=False).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == brute.without_repeats(texts_of(docs), 200)


def test_suffix_dedup_of_a_long_text(spark):
    from prudentia.llm import suffix_dedup

    rng = np.random.default_rng(4)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    passage, long = letters(450), letters(1_300_000)
    cut = suffix_dedup.SCAN_BYTES
    long = long[: cut - 200] + passage + long[cut : 2 * cut - 100] + passage[:250] + long[2 * cut :]  # over both ends of a scan
    docs = spark.createDataFrame([(1, long), (2, letters(30) + passage[100:] + letters(40)), (3, letters(3000))], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, keep_text=False).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == brute.without_repeats(texts_of(docs), 200)
    assert {r.doc_id: r.n_spans for r in got} == {1: 2, 2: 1, 3: 0}


def test_suffix_dedup_keeps_rows_and_columns(spark):
    from prudentia.llm.suffix_dedup import remove_repeats

    docs = odd_docs(spark)
    got = remove_repeats(docs)
    assert got.count() == docs.count() and got.columns[: len(docs.columns)] == docs.columns
    assert {r.text for r in got.where("doc_id IN (18, 100)").collect()} == {""}
    assert got.where("doc_id = 1").first().text is None
    assert remove_repeats(docs.limit(0)).count() == 0
    with_clash = remove_repeats(docs.withColumn("removed", F.lit(1)).withColumn("_row", F.lit(2)))
    assert {"removed", "removed_input", "_row_input"} <= set(with_clash.columns) and with_clash.first().removed_input == 1


# ---- 2: token store --------------------------------------------------------


def test_elias_fano():
    from prudentia.llm import elias_fano

    rng = np.random.default_rng(0)
    for n, top in [(0, 0), (1, 0), (1, 5), (700, 10), (700, 10**6), (3000, 10**12)]:
        values = np.sort(rng.integers(0, top + 1, n))
        coded = elias_fano.encode(values, top)
        found = elias_fano.Sequence(b"xx" + coded, 2)
        assert [found.select(i) for i in range(n)] == values.tolist()
        assert found.values(0, n).tolist() == values.tolist() and found.values(n // 3, n // 2).tolist() == values[n // 3 : n // 2].tolist()
        if n == 3000:
            assert len(coded) < n * 6


def test_token_store_round_trip(spark):
    from tokenizers import Tokenizer

    from prudentia.llm.token_store import Part, read_store, write_store

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = odd_docs(spark).union(small_docs(spark, 40).select("doc_id", "text", "lang", "source").withColumn("doc_id", F.col("doc_id") + 1000).withColumn("size", F.lit("x")).withColumn("class", F.lit(2)))
    docs = docs.union(docs.where("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long")))
    manifest = write_store(docs, path, 0, 3)
    want, at = [], 0
    for d, t in sorted(texts_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in read_store(manifest).collect()), key=str) == sorted(want, key=str)
    first = manifest.orderBy("part").first()
    part = Part(first.folder, first.path)
    assert crc32(part.ids(2).astype("<u4").tobytes()) == want[2][3]
    assert read_store(write_store(docs.limit(0), path)).count() == 0


# ---- 3: archives -----------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines(version):
    from prudentia.llm import archives as a

    blocks = [b"", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody", b"line\nhttp://a 0 0 0 9\n"]
    data = a.arc_head(version, "n.arc", "20010203040506") + b"".join(a.arc_record(version, f"http://h/{i}", "20010203040506", "text/html", "n.arc", 0, b) for i, b in enumerate(blocks))
    found = list(a.read_arc(io.BytesIO(data)))
    assert [f[2] for f in found] == blocks and [f[1]["URL"] for f in found] == ["http://h/0", "http://h/1", "http://h/2"]
    assert a.payload_of(found[1][1], blocks[1]) == b"body"
    assert a.iso_time("20010203040506") == "2001-02-03T04:05:06Z" and a.iso_time("2001") == "2001-01-01T00:00:00Z"
    with pytest.raises(a.ArcError):
        list(a.read_arc(io.BytesIO(data[:-5])))
    with pytest.raises(a.ArcError):
        list(a.read_arc(io.BytesIO(b"http://x 1 2 3 4\n")))


def test_page_that_begins_like_an_http_head(spark):
    from prudentia.llm.archives import convert, page_of, warc_index, write_arcs

    html = "HTTP/1.1 200 OK\r\nX: y\r\n\r\n<html>saved response</html>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, "http://b/", None)], "page_id long, url string, html string")
    got = {r.page: (r.payload_bytes, r.payload_digest) for r in warc_index(convert(write_arcs(pages))).withColumn("page", page_of(F.col("url"))).collect()}
    assert got == {1: (len(html), sha256(html.encode()).hexdigest()), 2: (0, sha256(b"").hexdigest())}


def test_archives(spark):
    from prudentia.llm.archives import convert, page_of, warc_index, write_arcs

    long = "<p>" + "é" * 60
    rows = [(5, "http://a/ b", long), (3, None, long), (9, "http://c", "short"), (2, "http://d", "short"), (7, "http://e", None), (8, "http://f", ""), (None, "http://g", "z" * 200), (11, "http://h", "HTTP/1.0 200\r\n\r\nx"), (5, "http://a/ b", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    files = write_arcs(pages, F.when(F.col("page_id") % 2 == 0, 1).otherwise(2))
    found = warc_index(convert(files)).withColumn("page", page_of(F.col("url"))).collect()
    assert len(found) == len(rows) and len({r.record_id for r in found}) == len(rows)
    by = {(r.page, r.record_type): r for r in found}
    assert by[(3, "response")].payload_digest == sha256(long.encode()).hexdigest()
    assert by[(5, "revisit")].refers_to_page == 3 and by[(5, "revisit")].refers_to_id == by[(3, "response")].record_id
    assert {p for p, kind in by if kind == "response"} == {3, 9, 2, 7, 8, None, 11}
    assert warc_index(convert(write_arcs(pages.limit(0)))).count() == 0


# ---- 4: sharding -----------------------------------------------------------


def test_shards_match_the_mixture(spark):
    from prudentia.llm.sharding import interleave

    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise(F.when(F.col("id") % 2 == 0, "c")).alias("source"), F.lit("clash").alias("n"))
    got = interleave(docs, 7, "source", ["doc_id"])
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == list(range(1003))
    counts = brute.Counter(r.shard for r in rows)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for k in range(7):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k]))
        for s, n in brute.Counter(r.source for r in rows).items():
            assert abs(sum(r.shard == k and r.source == s for r in rows) - n / 7) <= 2
    assert sorted(map(tuple, interleave(docs.repartition(3), 7, "source", ["doc_id"]).collect())) == sorted(map(tuple, rows)) if all(r.source for r in rows) else True
    few = interleave(odd_docs(spark).drop("size", "class"), 40, "source", ["doc_id", "text"])
    assert few.count() == odd_docs(spark).count()
    assert interleave(docs.limit(0), 7, "source", ["doc_id"]).count() == 0


# ---- 5: pieces -------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    import sentencepiece

    from prudentia.llm.pieces import SpanEncoder, encode_and_decode, encode_with_spans

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = odd_docs(spark).withColumnRenamed("size", "spam")
    for r in encode_with_spans(docs, path).collect():
        text = r.text or ""
        assert r.ids == library.encode(text)
        raw, at = text.encode(), 0
        for s in r.spans:
            assert s.begin <= s.end <= len(raw) and s.begin <= at
            at = max(at, s.end)
        assert at == len(raw)
        pieces = [(library.id_to_piece(i), s) for i, s in zip(r.ids, r.spans, strict=True) if not library.is_byte(i)]
        assert all(raw[s.begin : s.end].decode().replace(" ", "▁") in (p, p.removeprefix("▁")) for p, s in pieces)
    for r in encode_and_decode(docs, path).collect():
        assert r.ids == [1, *library.encode(r.text or ""), 2]
        assert r.decoded_sha256 == sha256(library.decode(r.ids).encode()).hexdigest()
    whole = SpanEncoder(path)
    ids, spans, first = whole(pa.array(ODD))
    for i, t in enumerate(ODD):
        assert np.array_equal(whole.project(t or "", library.encode(t or "")), spans[first[i] : first[i + 1]])


def trie(entries):
    """A double-array over byte strings with a pool, as models hold it."""
    pool, place = b"", {}
    for key, value in entries.items():
        place[key] = len(pool)
        pool += value + b"\0"
    units, used = {0: 0}, {0}

    def fill(node, prefix):
        below = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        labels = ([0] if prefix in entries else []) + below
        base = next(b for b in range(256, 100000) if all((node ^ b) ^ c not in used for c in labels) and b >> 10 == 0 or False) if labels else 0
        units[node] = units.get(node, 0) | base << 10 | (256 if prefix in entries else 0)
        for c in labels:
            used.add(node ^ base ^ c)
        for c in labels:
            if c:
                units[node ^ base ^ c] = c
                fill(node ^ base ^ c, prefix + bytes([c]))
            else:
                units[node ^ base] = 0x80000000 | place[prefix]

    fill(0, b"")
    size = max(units) + 1
    array = b"".join(int(units.get(i, 0)).to_bytes(4, "little") for i in range(size))
    return len(array).to_bytes(4, "little") + array + pool


def test_character_map_takes_the_longest_prefix():
    from prudentia.llm.pieces import CharacterMap, Normalizer

    blob = trie({b"a": b"1", b"abc": b"22", "é".encode(): b"e", b"\t": b" "})
    mapped = CharacterMap(blob)
    assert mapped.longest(b"abcd", 0) == (b"22", 3) and mapped.longest(b"abx", 0) == (b"1", 1)
    assert mapped.longest(b"zab", 0) is None and mapped.longest("xé".encode(), 1) == (b"e", 2)
    normalizer = Normalizer(b"")
    normalizer.map, normalizer.prefix, normalizer.squeeze, normalizer.escape = mapped, True, True, True
    out, source = normalizer("  abc é\t ab ".encode())
    assert out.decode() == "▁22▁e▁1b"
    assert source.tolist() == [2, 2, 2, 2, 2, 5, 5, 5, 6, 8, 8, 8, 10, 11, 12]


# ---- 6: mixing -------------------------------------------------------------


def test_mix_reaches_its_targets(spark):
    from prudentia.llm.mixing import mix, word_count

    rng = random.Random(5)
    rows = [(i, f"s{rng.choice([0, 0, 0, 1, 2, 3])}" if i % 50 else None, rng.randint(0, 60)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long").withColumn("whole", F.lit(1))
    got = mix(docs, "source", "words", "doc_id", [5.0, 2.0, 1.0], 3.0).collect()
    assert len(got) == len(rows)
    names = sorted({r[1] for r in rows if r[1]}) + [None]
    sizes = [sum(w for _, s, w in rows if s == n) for n in names]
    targets = brute.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for n, size, target in zip(names, sizes, targets, strict=True):
        own = [r for r in got if r.source == n]
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 * max(1, target) for r in own)
        assert abs(sum(r.repeats * r.words for r in own) - target) <= 30
        assert 0 <= min(r.repeats for r in own) and max(r.repeats for r in own) <= 3
    again = mix(docs.repartition(5), "source", "words", "doc_id", [5.0, 2.0, 1.0], 3.0).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix(docs.limit(0), "source", "words", "doc_id", [1.0]).count() == 0
    counted = odd_docs(spark).select("text", word_count(F.col("text")).alias("n")).collect()
    assert all(r.n == len(brute.WORD.findall(r.text or "")) for r in counted)


# ---- 7: quality ------------------------------------------------------------


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_strings_that_polynomials_confuse():
    from prudentia.llm.near_dup import shingles
    from prudentia.llm.perplexity import statistics
    from prudentia.llm.textscan import column_bytes

    for n in (1024, 4096):
        a, b = thue_morse(n)
        assert statistics(*column_bytes(pa.array([f"{a}\n{b}"])))["n_dup_lines"].tolist() == [0]
        left, right = (shingles(*column_bytes(pa.array([t])))[0] for t in (f"p q r s {a}", f"p q r s {b}"))
        assert left.tolist() != right.tolist()


def test_statistics_equal_brute_force(spark):
    from prudentia.llm.perplexity import BASE, statistics
    from prudentia.llm.textscan import column_bytes

    texts = [*ODD, "a\na\n a\na\n", "a b c d e " * 4, "\n", "日本 # |\n#|\n#|", *[t for _, t in texts_of(small_docs(spark))]]
    made = statistics(*column_bytes(pa.array(texts)))
    assert np.stack([made[c] for c in BASE], 1).tolist() == [brute.statistics(t) for t in texts]


def test_model_is_a_distribution():
    from prudentia.llm.perplexity import Model, trigrams
    from prudentia.llm.textscan import column_bytes

    data, offsets = column_bytes(pa.array(["the cat sat on the mat. " * 5, "the dog sat on the log", ""]))
    grams, counts = np.unique(trigrams(data, offsets), return_counts=True)
    model = Model.fit(grams, counts)
    assert (model.keys[1:] > model.keys[:-1]).all() and (model.contexts[1:] > model.contexts[:-1]).all()
    for context in (0, ord("t"), ord("t") << 8 | ord("h"), ord("q") << 8 | ord("z")):
        assert abs(model.probabilities(context << 8 | np.arange(256)).sum() - 1) < 1e-4
    row, bits = model.table()
    assert np.allclose(2.0 ** -bits[row[grams >> 8], grams & 255], model.probabilities(grams), rtol=1e-4)


def test_judge_bands(spark):
    from prudentia.llm.perplexity import judge

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = judge(docs, keep_text=False).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.9 and kept[0] < 0.5
    odd = odd_docs(spark)
    out = judge(odd)
    assert out.count() == odd.count() and out.where("text IS NULL AND kept").count() == 0
    assert judge(odd.limit(0)).count() == 0


def test_words_in_wrong_order_are_not_kept(spark):
    from prudentia.llm.perplexity import judge

    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    follows = {w: rng.sample(vocabulary, 5) for w in vocabulary}
    rows = []
    for i in range(400):
        text = [rng.choice(vocabulary)]
        while len(text) < 150:
            text.append(rng.choice(follows[text[-1]]))
        if i >= 390:  # the same words, out of order
            rng.shuffle(text)
        rows.append((i, " ".join(text), "en"))
    out = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    fair = [i for i in range(390) if not out[i].base_failed]
    assert len(out) == 400 and len(fair) > 300 and all(out[i].kept for i in fair)
    assert not any(out[i].kept for i in range(390, 400))
    assert min(out[i].word_bits for i in range(390, 400)) > max(out[i].word_bits for i in range(390))


def flat_spelling(data, offsets, languages, begin, end, doc):
    return (end - begin) * 1.5


@pytest.mark.parametrize("heavy", [1_000_000, 300])
def test_word_bits_equal_brute_force(spark, monkeypatch, heavy):
    from prudentia.llm import word_model
    from prudentia.llm.textscan import column_bytes, mix

    rng = random.Random(11)
    docs = {}
    for i in range(60):
        words = [rng.choice("abcdefgh") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 25))]
        docs[i] = (rng.choice(["en", "fr", None]), words)
    docs[60] = docs[3]
    rows = [(i, lang, " ".join(w)) for i, (lang, w) in docs.items()]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")

    def hashed(lang, word):
        w, of, _, _ = word_model._word_hashes(*column_bytes(pa.array([word.replace("<", "x")])), [lang])
        return mix(of + np.uint64(1))[0] if word == "<" else w[0]

    def turn_of(lang, word):
        return int(hashed(lang, word)) % word_model.ROUNDS

    total = sum(len(r[2]) for r in rows)
    if heavy < total:  # which words are told apart; what becomes of them is another test's
        monkeypatch.setattr(word_model, "HEAVY", 60)
        hashes, parts = word_model.heavy_words(frame, "text", "lang", total)
        often = brute.Counter((lang, w) for lang, words in docs.values() for w in words)
        assert {int(hashed(*k)) for k, n in often.items() if n > 60} <= set(hashes.tolist()) and all(parts > 1)
        return
    want = brute.kneser_ney_bits(docs, turn_of, lambda w: 1.5 * (len(w) + 1))
    whole = [(i, lang, t + " ") for i, lang, t in rows]  # the byte after a word ends its spelling
    data, offsets = column_bytes(pa.array([r[2] for r in whole]))
    keys = word_model.doc_keys(data, offsets, [r[1] for r in whole]).tolist()
    got = {r.doc: r.word_bits for r in word_model.word_bits(spark.createDataFrame(whole, "doc_id long, lang string, text string"), flat_spelling, total).collect()}
    assert len(got) == len({k for i, k in enumerate(keys) if docs[i][1]})
    assert all(abs(got[k] - want[i]) < 1e-5 for i, k in enumerate(keys) if docs[i][1])


def test_spelling_of_stretches_equals_that_of_bytes(monkeypatch):
    from prudentia.llm import perplexity
    from prudentia.llm.textscan import column_bytes

    texts, languages = ["ab cd é", "", "cd", "ab ab"], ["en", None, "fr", "en"]
    data, offsets = column_bytes(pa.array(texts))
    model = {}
    for x in ("en", "fr", None):
        own = [t for t, k in zip(texts, languages, strict=True) if k == x]
        model[x] = perplexity.Model.fit(*np.unique(perplexity.trigrams(*column_bytes(pa.array(own))), return_counts=True)).table()
    monkeypatch.setattr(perplexity, "_table", lambda folder, language: model[language])
    cost = perplexity.byte_costs("", data, offsets, languages)
    begin, end, doc = np.array([0, 3, 6, 8, 9, 13]), np.array([3, 6, 8, 10, 10, 15]), np.array([0, 0, 0, 2, 2, 3])
    got = perplexity.spelling_of("")(data, offsets, languages, begin, end, doc)
    assert np.allclose(got, [cost[a:b].sum() for a, b in zip(begin, end, strict=True)])


def test_buckets_of_words_pack_and_tell_heavy_words_apart():
    from prudentia.llm import word_model

    rng = np.random.default_rng(3)
    entries = {c: rng.integers(0, min(np.iinfo(k).max, 1 << 60), 500).astype(k) for c, k in word_model.ENTRY.items()}
    entries["g"] = np.sort(entries["g"])
    again = word_model.unpack(word_model.pack(entries), 500)
    assert all(np.array_equal(again[c], entries[c]) for c in entries)
    part = pa.RecordBatch.from_arrays([pa.array(["a x b a x c", "d x b", "e x b"]), pa.array(["en"] * 3)], ["text", "lang"])
    x = word_model._word_hashes(*(lambda d: (d[0], d[1]))(__import__("prudentia.llm.textscan", fromlist=["x"]).column_bytes(pa.array(["x"]))), ["en"])[0]
    alone = [word_model._entries(part, "text", "lang", flat_spelling, (x[:0], np.zeros(0, np.int64)), t)[0] for t in range(word_model.ROUNDS)]
    apart = [word_model._entries(part, "text", "lang", flat_spelling, (x, np.array([1000])), t)[0] for t in range(word_model.ROUNDS)]
    size = lambda many: (sum(len(e["g"]) for e in many), len({int(v) for e in many for v in e["g"]}))
    assert size(alone)[0] == size(apart)[0] == 12 and size(apart)[1] == size(alone)[1] + 2


# ---- 8: token counts -------------------------------------------------------


def test_token_counts_equal_greedy_matching(spark):
    from prudentia.llm.token_counts import END, Automaton, count_tokens, load_vocabulary

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = set(load_vocabulary(path))
    for r in count_tokens(odd_docs(spark).union(odd_docs(spark)), path).collect():
        counts = [brute.greedy((*w.encode(), END), tokens) for w in brute.WORD.findall(brute.lowered(r.text))]
        assert (r.n_words, r.n_unknown) == (len(counts), sum(c < 0 for c in counts))
        assert r.n_tokens == sum(1 if c < 0 else c for c in counts)
        assert r.longest_word_tokens == max([0, *(1 if c < 0 else c for c in counts)])
    rng = random.Random(2)
    for _ in range(30):
        own = {tuple(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) for _ in range(5)} | {(97,), (END,)}
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(20)]
        got = Automaton(own).count(np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0] + [len(s) for s in strings]))
        assert got.tolist() == [brute.greedy((*s, END), own) for s in strings]
        many = strings * 10  # enough to be read side by side for a while
        got = Automaton(own).count(np.frombuffer(b"".join(many), np.uint8), np.cumsum([0] + [len(s) for s in many]))
        assert got.tolist() == [brute.greedy((*s, END), own) for s in many]


def test_long_words_take_time_in_proportion(spark):
    from prudentia.llm.token_counts import END, automaton, count_tokens, load_vocabulary

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(3)
    word = rng.integers(97, 123, 80_000).astype(np.uint8)
    machine = automaton(path)
    began = time.process_time()
    got = machine.count(word, np.array([0, len(word)]))
    assert time.process_time() - began < 0.5
    tokens = set(load_vocabulary(path))
    assert got.tolist() == [brute.greedy((*word.tolist(), END), tokens, max(map(len, tokens)))]
    whole = word.tobytes().decode() * 25  # 2 MB without a blank, and 20 MB of words
    short = ("tokens are counted " * 100 + "\n") * 10_500
    docs = spark.createDataFrame([(1, whole, 7), (2, short, 7), (3, None, 7)], "doc_id long, text string, n_words int")
    rows = {r.doc_id: r for r in count_tokens(docs, path, keep_text=False).collect()}
    assert rows[1].n_words == 1 and rows[1].n_tokens == machine.count(np.frombuffer(whole.encode(), np.uint8), np.array([0, len(whole)]))[0]
    assert rows[2].n_words == 3_150_000 and rows[2].n_tokens == 1_050_000 * sum(brute.greedy((*w.encode(), END), tokens) for w in ("tokens", "are", "counted"))
    assert (rows[3].n_words, rows[3].n_tokens, rows[3].n_words_input) == (0, 0, 7)
    assert count_tokens(docs.limit(0), path).collect() == []


# ---- 9: nearest neighbours -------------------------------------------------


def test_search_recall_and_order(spark):
    from prudentia.llm.permutation_index import search

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in vectors.collect()}
    found = {}
    for r in search(vectors, vectors.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array(sorted(rows))
    matrix, right = np.stack([rows[i] for i in ids]), []
    for q, hits in found.items():
        score = matrix @ rows[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21)) and hits == sorted(hits, key=lambda h: (-h[2], h[1]))
        assert all(abs(rows[h[1]] @ rows[q] - h[2]) < 1e-12 for h in hits)
        right.append(len({h[1] for h in hits} & set(ids[order].tolist())) / 20)
    assert len(found) == sum(1 for i in rows if i % 20 == 0) and np.mean(right) >= 0.9


def test_inverted_files_hold_each_entry_once_and_are_read_in_part():
    from prudentia.llm import permutation_index as index

    rng = np.random.default_rng(5)
    near = np.stack([rng.permutation(index.PIVOTS) for _ in range(300)]).astype(np.uint8)
    shard = index.Shard(near)
    assert all(np.array_equal(np.sort(row), np.arange(300)) for row in shard._posted)
    query = rng.permutation(index.PIVOTS).astype(np.uint8)
    place = np.argsort(near, axis=1)
    off = np.minimum(np.abs(place[:, query[: index.READ]] - np.arange(index.READ)), index.WINDOW + 1)
    assert np.array_equal(shard.nearness(query), (index.WINDOW + 1 - off).sum(axis=1))
    read = sum(b - a for _, _, a, b in shard.stretches(query))
    assert read < 0.3 * 300 * index.PIVOTS


def test_search_odd_vectors(spark):
    from prudentia.llm.permutation_index import search

    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [-1.0, 0.0]), (9, [float("inf"), 0.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = search(vectors, vectors.where("vec_id % 20 = 0"), k=3).collect()
    lists = {q: [(r.vec_id, r.score) for r in sorted(got) if r.query_id == q] for q in (0, 20, 40)}
    assert lists == {0: [(1, 1.0), (20, 1.0), (2, 0.0)], 20: [(0, 1.0), (1, 1.0), (2, 0.0)], 40: []}
    assert search(vectors.limit(0), vectors.limit(0)).count() == 0


# ---- 10: near duplicates ---------------------------------------------------


def near_family(n, seed):
    """Texts with edits around one of them, and others that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage, out = [word() for _ in range(120)], [word() for _ in range(60)], []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = word()
        out.append(" ".join(own))
        out.append(" ".join([word() for _ in range(60)] + passage))
    return out


@pytest.mark.parametrize("leaf", [48, 3])
def test_near_duplicates(spark, monkeypatch, leaf):
    from prudentia.llm import near_dup

    monkeypatch.setattr(near_dup, "LEAF", leaf)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, t) for i, t in enumerate(near_family(25, 1))] + [(500, ODD[18]), (501, ODD[18].upper()), (501, ODD[18].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("clash"))
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute.near_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_pipeline_drops_near_duplicates_from_80_percent(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]
    other = words[:94] + [f"x{i}" for i in range(10)]  # 90 common shingles of 110
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate((words, other, [f"y{i}" for i in range(50)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()} == {0, 2}


def test_pipeline_stages_take_clashing_columns(spark):
    import corpus_pipeline

    docs = small_docs(spark, 20)
    for name in ("kept", "bits", "removed", "n_bytes", "size", "ids"):
        docs = docs.withColumn(name, F.lit("clash"))
    for stage in (corpus_pipeline.quality, corpus_pipeline.passage_dedup, corpus_pipeline.mix_sources, corpus_pipeline.encode):
        assert set(corpus_pipeline.COLUMNS) <= set(stage(spark, docs, FOLDER).columns)


def test_border_of_a_pivot_and_number_of_trees():
    from prudentia.llm import near_dup

    # a member at 0.70 to the pivot may be linked at 0.85 to one that left
    least = near_dup._Join(None, None, "", "", 85)._border_floor()
    n = near_dup.COORDINATES
    missed = sum(math.comb(n, k) * 0.7**k * 0.3 ** (n - k) for k in range(least))
    assert missed < 1e-5
    rng = random.Random(3)
    for similarity in (0.8, 0.85):
        trees, found = near_dup.trees_for(similarity, 1 - 1e-7), 0

        def meet(level):
            if level == len(near_dup.LEVELS):
                return True
            branches, width = near_dup.LEVELS[level]
            return any(all(rng.random() < similarity for _ in range(width)) and meet(level + 1) for _ in range(branches))

        for _ in range(20_000):
            found += rng.random() < similarity and meet(0)
        assert (1 - found / 20_000) ** trees < 2e-7


def test_near_duplicates_without_rows_or_ids(spark):
    from prudentia.llm.near_dup import near_duplicates

    assert near_duplicates(small_docs(spark).limit(0)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()} == {(None, None, False), (1, 1, True)}


def test_components(spark):
    from prudentia.llm.components import components

    links = [(i, i + 1) for i in range(1, 40)] + [(100, 99), (99, 98), (7, 7), (None, 3), (200, 150)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 1 for i in range(2, 41)} | {100: 98, 99: 98, 200: 150}


# ---- the pipeline ----------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as pipeline
    from prudentia.llm.storage import written

    docs, folder = small_docs(spark), FOLDER
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "stage")
        kept[name] = docs.collect()
    first = kept["quality rules"]
    assert all(b[0] >= 10 and 100 * b[4] <= 20 * b[0] for b in (brute.statistics(r.text) for r in first))
    groups = brute.near_groups([(r.doc_id, r.text) for r in first], 80)  # as the stage asks
    second = kept["near-duplicates"]
    assert {r.doc_id for r in second} == {d for d, g in groups.items() if g[2]}
    third = {r.doc_id: sha256(r.text.encode()).hexdigest() for r in kept["repeated passages"]}
    want = brute.without_repeats([(r.doc_id, r.text) for r in second], 200)
    assert set(third) == {w[0] for w in want}
    assert sum(third[w[0]] == w[4] for w in want) >= len(want) - 2  # but for characters cut apart
    sizes = {r.doc_id: len(brute.WORD.findall(r.text)) for r in kept["repeated passages"]}
    mixed = brute.Counter(r.doc_id for r in kept["source mix"])
    assert max(mixed.values()) <= 3 and abs(sum(sizes[d] * n for d, n in mixed.items()) / sum(sizes.values()) - 1) < 0.25
    assert len(kept["piece encoding"]) == sum(mixed.values()) and all(r.n_tokens == len(r.ids) for r in kept["piece encoding"])
