"""The index of captions: the same answers as the scan, from a share of the postings."""

import random

import pytest

from prudentia.operators import resolve
from prudentia.sources import text_index
from prudentia.sources.text_index import TextIndex


def captions(n, seed=1):
    """Captions of which a tenth share a beginning, with names that few share."""
    rng = random.Random(seed)
    names = ["".join(rng.choice("ABCDEFGHIJKLMNOPRSTUVZ") for _ in range(rng.randint(4, 10))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = [rng.choice(names) for _ in range(rng.randint(1, 3))] + ["CAUSA"] * (rng.random() < 0.5) + ["PROVINCIAL" if i % 20 else "PROVINCIA"] * (i % 10 == 0) + ["OTRO"] * rng.randint(0, 2)
        rng.shuffle(words)
        rows.append((f"fallos:{i % 400 + 1}:{i}", " ".join(words)))
    return rows, names


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows, names = captions(6000)
    rulings = spark.createDataFrame([*rows, ("none", None), ("blank", "  "), ("short", "a b")], "id string, caption string")
    return TextIndex.build(rulings, f"file://{tmp_path_factory.mktemp('index')}/i"), rulings, names


def answers(frame):
    return sorted((r.query, r.place, r.id, r.score) for r in frame.select("query", "place", "id", "score").collect())


def test_same_answers_as_the_scan(spark, index):
    built, rulings, names = index
    rng = random.Random(5)
    raw = [f"{rng.choice(names)} {rng.choice(names)[:-1]}x y otro s/ causa" for _ in range(40)] + ["provincial", "provincia de causa", "CAUSA OTRO", "nowhere", "", "a b", None, names[0], names[0]]
    asked = spark.createDataFrame(list(enumerate(raw)), "query long, raw string")
    for most in (1, 5):
        got = answers(built.search(asked, "raw", most))
        assert got == answers(resolve.suggest_captions(asked, "raw", rulings, most)) and got


def test_few_postings_are_opened(spark, index):
    built, _, names = index
    asked = spark.createDataFrame([(i, f"{names[2 * i]} {names[2 * i + 1]} provincia causa otro") for i in range(30)], "query long, raw string")
    opened, matched = built.work(asked, "raw")
    assert opened < 0.2 * matched, (opened, matched)


def test_a_common_beginning_is_many_blocks(index):
    built, *_ = index
    blocks = built._table("blocks").where("prefix = 'PROV'").collect()
    sizes = [len(r.postings) for r in blocks]
    assert sum(sizes) == 600 and len(sizes) >= 5 and max(sizes) < 3 * text_index.BLOCK
    shared = {r.prefix: r.df for r in built._table("beginnings").collect()}
    assert (shared["PROV"], shared["PROVINCIA"], shared["PROVINCIAL"]) == (600, 600, 300) and "PR" not in shared


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id string, caption string")
    built = TextIndex.build(none, f"{tmp_path}/none")
    asked = spark.createDataFrame([(1, "anything")], "query long, raw string")
    assert built.search(asked, "raw").isEmpty() and built.work(asked, "raw") == (0, 0)


def test_equal_captions_are_one_class(spark, tmp_path):
    """a caption that many rulings have is indexed and scored once, counts as
    often as it occurs, and its rulings are found in the order of their ids."""
    rows = [(f"fallos:{300 + i % 7}:{i}", ("anillo grande", "perno grande", "perno")[i % 3]) for i in range(3000)] + [("fallos:1:1", "Anillo, otro")]
    rulings = spark.createDataFrame(rows, "id string, caption string")
    built = TextIndex.build(rulings, f"{tmp_path}/equal")
    assert built.docs == 3001 and built._table("captions").count() == 4 and built._table("members").count() == 3001
    assert {r.prefix: r.df for r in built._table("beginnings").collect()}["GRANDE"] == 2000
    asked = spark.createDataFrame([(1, "anillo grande"), (2, "grande"), (3, "perno otro")], "query long, raw string")
    for most in (5, text_index.FIRST + 9):
        assert answers(built.search(asked, "raw", most)) == answers(resolve.suggest_captions(asked, "raw", rulings, most))


def test_equal_forms_are_answered_once(spark):
    """as many queries as like ask for a form; each gets its answer."""
    rulings = spark.createDataFrame([(f"fallos:300:{p}", 300, p, f"perno {p}") for p in range(1, 40)], "id string, volume int, page int, caption string")
    seen = []

    def search(asked, raw, most):
        seen.append(asked.count())
        return resolve.suggest_captions(asked, raw, rulings, most)

    asked = spark.createDataFrame([(i, ("Fallos: 300:12", "perno", None, "nada")[i % 4]) for i in range(80)], "query long, raw string")
    got = {}
    for r in resolve.suggest(asked, "raw", rulings, captions=search).collect():
        got.setdefault(r.query, []).append((r.rank, r.id))
    assert seen == [3] and set(got) == {i for i in range(80) if i % 4 < 2} and all(len(v) == 5 for v in got.values())
    assert {tuple(sorted(v)) for k, v in got.items() if k % 4 == 0} == {((1, "fallos:300:21"), (2, "fallos:300:2"), (3, "fallos:300:22"), (4, "fallos:300:32"), (5, "fallos:300:10"))}
