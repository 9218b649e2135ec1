"""SimHash by vantage-point trees, whitening and periodic runs, against brute
force and on odd input."""

import random
from decimal import Decimal
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prudentia.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return (text or "").encode().split()


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


# ---- 11 --------------------------------------------------------------------


def brute_print(text, width=4):
    words = words_of((text or "").lower() if (text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in text))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for k in range(64):
            count[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * count[k] > len(grams))


def brute_components(rows, most=4):
    """rows: (doc_id, fingerprint); smallest doc_id reachable for each row."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= most:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(rows))]


def test_simhash_query_equals_brute_force(spark):
    docs = documents(spark)
    prints = [(d, brute_print(t)) for d, t in docs]
    want = sorted(zip([d for d, _ in docs], [f"{p:016x}" for _, p in prints], brute_components(prints), strict=True))
    assert sorted(map(tuple, queries()["op11_vantage_simhash"](spark, FOLDER).collect())) == want


def test_simhash_on_odd_rows(spark):
    from prudentia.llm.simhash import simhash_duplicates

    rows = [(5, None), (3, ""), (4, " \n\t"), (None, ""), (7, "One TWO three four five"), (8, "one two\nthree  four five"), (8, "a"), (8, "a"), (None, "zz top"), (9, "É é ü"), (2, "word " * 300_000 + "end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1)).withColumn("print", F.lit("x"))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_duplicates(frame).collect()]
    prints = [(d, brute_print(t)) for d, t in rows]
    want = list(zip([d for d, _ in rows], [f"{p:016x}" for _, p in prints], brute_components(prints), strict=True))
    assert sorted(got, key=str) == sorted(want, key=str)
    empty = simhash_duplicates(frame.where("false"))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.isEmpty()


@pytest.mark.parametrize("kind", ["random", "cluster", "mixed"])
def test_vantage_tree_finds_every_pair(kind):
    from prudentia.llm.vantage import Tree, cell_links, close

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 1 if kind == "cluster" else 900, dtype=np.uint64) * np.uint64(2)
    flips = [np.uint64(1) << rng.integers(0, 64 if kind != "cluster" else 14, 900).astype(np.uint64) for _ in range(3)]
    near = base[rng.integers(0, len(base), 900)] ^ flips[0] ^ flips[1] ^ flips[2]
    values = np.unique(np.concatenate([base, near, np.array([0, 2**64 - 1], np.uint64)] if kind != "random" else [base]))
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    want = {(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(np.triu(far <= 4, 1)), strict=True)}
    tree, got = Tree.over(values[::5], 20, 4), []
    for _, members, queries_ in tree.routed(values):
        got += [(members[a], members[b]) for x, y in close(members, None, 4) for a, b in zip(x, y, strict=True)]
        got += [(members[a], queries_[b]) for x, y in close(members, queries_, 4) for a, b in zip(x, y, strict=True)]
    got = [tuple(sorted(map(int, p))) for p in got]
    assert len(got) == len(set(got)) and set(got) == want
    assert kind == "cluster" or tree.leaves > 3
    forest = cell_links(values, None, 4)
    assert len(forest) < len(values) and {tuple(sorted(map(int, p))) for p in forest} <= want
    assert brute_groups(values, forest) == brute_groups(values, want)


def brute_groups(values, links):
    up = {int(v): int(v) for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        x, y = sorted((root(int(a)), root(int(b))))
        up[y] = x
    return {v: root(v) for v in up}


def test_blocks_of_a_large_shard(spark, monkeypatch):
    """Cells of tiny blocks, several leaves, and one dense group: groups as by all pairs."""
    from prudentia.llm import vantage

    for name, value in (("SHARD", 300), ("BLOCK", 70), ("SMALL", 16)):
        monkeypatch.setattr(vantage, name, value)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    dense = base[0] ^ rng.integers(0, 1 << 10, 600, dtype=np.uint64)
    values = np.unique(np.concatenate([base, dense, base ^ np.uint64(5)]))
    frame = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "print long")
    links = [(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in vantage.hamming_links(frame, "print", 4).collect()]
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    want = [(values[i], values[j]) for i, j in zip(*np.nonzero(np.triu(far <= 4, 1)), strict=True)]
    assert brute_groups(values, links) == brute_groups(values, want)
    assert all((int(a) ^ int(b)).bit_count() <= 4 for a, b in links)


# ---- 12 --------------------------------------------------------------------


def whitened_by_numpy(rows, components=4):
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = {i: tuple(int(np.floor(256 * float(c))) for c in v) for i, v in fine}
    fit = np.array(sorted(set(x.values())), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    y = np.array([[float(c) for c in row] for row in fit]) - (sums / n).astype(float)
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    out = {}
    for i, row in x.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
        centred = np.array([float(a) for a in row]) - (sums / n).astype(float)
        for j in range(components):
            out[i, j + 1] = (n, int(deviation), float(centred @ basis[:, j]) / values[j] ** 0.5, values[j] / values.sum())
    return out


def test_whitening_query_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want, got = whitened_by_numpy(rows), queries()["op12_svd_whitening"](spark, FOLDER).collect()
    assert len(got) == len(want)
    signs = {}
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        if abs(whitened) > 1e-3:
            assert signs.setdefault(r.component, np.sign(whitened * r.whitened)) == np.sign(whitened * r.whitened)
        assert abs(abs(r.whitened) - abs(whitened)) < 1e-8
        assert abs(r.explained / explained - 1) < 1e-9 and 0 <= r.identity_error < 1e-8


def test_whitening_on_odd_rows(spark):
    from prudentia.llm.whitening import whiten

    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None, 0.0]), (3, [nan, 1.0, 0.0]), (4, [1.0, -inf, 0.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.0]), (None, [-0.0, 1.5, 3.0]), (7, [4.0, -1.25, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).withColumn("Component", F.lit(0))
    got = whiten(frame).collect()
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i in (6, None, 7) for c in (1, 2)}  # the third dimension doesn't vary
    assert len(got) == 8 and {r.n for r in got} == {3} and {r.n_input for r in got} == {"clash"}
    want = whitened_by_numpy([(1, rows[5][1]), (2, rows[7][1]), (3, rows[8][1])], 2)
    for r in got:
        n, deviation, whitened, explained = want[{6: 1, None: 2, 7: 3}[r.vec_id], r.component]
        assert r.deviation == deviation and abs(abs(r.whitened) - abs(whitened)) < 1e-9 and abs(r.explained - explained) < 1e-9
    names = whiten(frame).columns
    for few in (frame.where("false"), frame.where("vec_id = 6"), frame.where("vec_id < 5")):
        assert whiten(few).columns == names and whiten(few).isEmpty()


def test_whitening_of_huge_entries(spark):
    """Sums of products beyond 64 bits: exact in decimals, null where a long won't do."""
    from prudentia.llm.whitening import deviation, Whitening, whiten

    frame = spark.createDataFrame([(1, [2.0**45, 1.0]), (2, [-(2.0**45), 0.0]), (3, [5.0, 7.0]), (4, [1e300, -1e300])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whiten(frame.where("vec_id < 4")).collect()}
    assert got[1, 1].deviation is None and got[3, 1].n == 3
    assert whiten(frame).count() > 0
    model = Whitening(2, 3, 2**53, [2**54, 3], 0.0, [], [])
    exact = spark.sql("SELECT array(9007199254740992L, -7L) AS x").select(deviation(F.col("x"), model)).first()[0]
    assert exact == Decimal((3 * 2**53 - 2**54) ** 2 + (3 * -7 - 3) ** 2)


# ---- 13 --------------------------------------------------------------------


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(6, 4 * q):
                part = words[s : s + length]
                if not any(all(part[k] == part[k + r] for k in range(length - r)) for r in range(1, q)):
                    out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words, h = words_of(text), crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda b: sha256(b).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), digest(kept))


def test_periodic_runs_query_equals_brute_force(spark):
    short = [(d, t) for d, t in documents(spark) if len(words_of(t)) <= 1500]  # all lags by hand take the square of it
    got = {r.doc_id: tuple(r) for r in queries()["op13_periodic_runs"](spark, FOLDER).collect()}
    assert len(got) == len(documents(spark)) and len(short) > 100
    want = {d: brute_row(d, t) for d, t in short}
    assert {d: got[d] for d in want} == want
    assert sum(r[1] > 0 for r in want.values()) > 5


def test_runs_equal_brute_force():
    from prudentia.llm.periodic_runs import likely_lags, runs_of

    rng = random.Random(3)
    for _ in range(1500):
        n, k = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5])
        ids = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 8:
                a, p = rng.randrange(n), rng.randint(1, 9)
                for i in range(a + p, min(n, a + rng.randint(1, n))):
                    ids[i] = ids[i - p]
        want = brute_runs(ids)
        assert runs_of(np.array(ids, dtype=np.int64)) == want
        assert {q for _, _, q in want} <= set(likely_lags(np.array(ids, dtype=np.int64)))


def test_runs_of_long_and_odd_texts(spark):
    from prudentia.llm.periodic_runs import periodic_runs

    period = " ".join(f"w{i}" for i in range(1234))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "x " + "a b " * 4 + "c"), (6, "start " + (period + " ") * 90 + "end"), (7, "é " * 200_000), (8, " ".join(map(str, range(400_000))))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("RUNS", F.lit(1)).withColumn("collapsed", F.lit("old"))
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed, r.RUNS_input, r.collapsed_input) for r in periodic_runs(frame).collect()), key=lambda r: (r[0] or 0, r[1]))
    assert {r[3:] for r in got} == {(1, "old")}
    want = [(None, [(1, 8, 2)], "x a b c"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [], "a a a a a"), (5, [(0, 6, 1)], "a"), (5, [(0, 6, 1)], "a"), (6, [(1, 1234 * 90, 1234)], f"start {period} end"), (7, [(0, 200_000, 1)], "é"), (8, [], rows[-1][1])]
    assert [r[:3] for r in got] == want
    assert periodic_runs(frame.where("false")).isEmpty()


# ---- storage ----------------------------------------------------------------


def test_a_local_session_without_a_shared_folder_gets_one(spark):
    from types import SimpleNamespace

    from prudentia.llm.storage import shared_dir

    conf = SimpleNamespace(get=lambda name, default=None: default)
    local = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]", applicationId="app-x"))
    assert shared_dir(local) == shared_dir(local) and shared_dir(local).startswith("file://")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host", applicationId="app-y")))


# ---- 7 ---------------------------------------------------------------------


def test_a_trigram_met_more_often_than_two_bytes_count(spark):
    """No count has a ceiling: a document that says a word 70,000 times."""
    import pyarrow as pa

    from prudentia.llm import word_model
    from prudentia.llm.textscan import column_bytes, mix
    from tests.llm import brute

    docs = {0: ("en", ["a"] * 70_000 + ["b"]), 1: ("en", ["a"] * 66_000 + ["c", "a", "a", "b"]), 2: ("en", ["b", "a", "a", "c"]), 3: ("en", ["a", "a", "a"])}

    def turn_of(lang, word):
        w, of, _, _ = word_model._word_hashes(*column_bytes(pa.array([word.replace("<", "x")])), [lang])
        return int(mix(of + np.uint64(1))[0] if word == "<" else w[0]) % word_model.ROUNDS

    rows = [(i, lang, " ".join(w) + " ") for i, (lang, w) in docs.items()]
    data, offsets = column_bytes(pa.array([r[2] for r in rows]))
    keys = word_model.doc_keys(data, offsets, [r[1] for r in rows]).tolist()
    want = brute.kneser_ney_bits(docs, turn_of, lambda w: 1.5 * (len(w) + 1))
    found = word_model.word_bits(spark.createDataFrame(rows, "doc_id long, lang string, text string"), lambda data, offsets, languages, begin, end, doc: (end - begin) * 1.5, sum(len(r[2]) for r in rows))
    got = {r.doc: r.word_bits for r in found.collect()}
    assert all(abs(got[k] - want[i]) < 1e-5 for i, k in enumerate(keys))


# ---- 2 ---------------------------------------------------------------------


def test_starts_over_many_blocks_of_parts(spark, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from prudentia.llm import token_store

    monkeypatch.setattr(token_store, "BLOCK", 2)
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(60)], "doc_id long, text string")
    manifest = token_store.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 7)
    rows = sorted(token_store.read_store(manifest).collect())
    assert manifest.count() > 4 and [r.doc_id for r in rows] == list(range(60))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
