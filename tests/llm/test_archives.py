"""Record lines of real archives, and what is no record."""

import gzip
import io
import random

import pytest

from prudentia.llm import archives as a

LINES = [
    (1, "http://e.org/ 1.2.3.4 20010203040506 text/html; charset=utf-8 22", ["http://e.org/", "1.2.3.4", "20010203040506", "text/html; charset=utf-8", "22"]),
    (1, "http://e.org/a b c 1.2.3.4 20010203040506 text/html 0", ["http://e.org/a b c", "1.2.3.4", "20010203040506", "text/html", "0"]),
    (1, "http://e.org/ 1.2.3.4 20010203040506 x 1.2.3.5 20010203040507 no-type 9", ["http://e.org/ 1.2.3.4 20010203040506 x", "1.2.3.5", "20010203040507", "no-type", "9"]),
    (1, "dns:e.org 2001:db8::1 2001 text/dns 7", ["dns:e.org", "2001:db8::1", "2001", "text/dns", "7"]),
    (2, "http://e.org/ 1.2.3.4 20010203040506 text/html; charset=x y 200 - http://f/ 88 n.arc 5", ["http://e.org/", "1.2.3.4", "20010203040506", "text/html; charset=x y", "200", "-", "http://f/", "88", "n.arc", "5"]),
]


@pytest.mark.parametrize("version,line,want", LINES)
def test_fields_by_form(version, line, want):
    assert list(a.arc_fields(line, a.FIELDS[version].split()).values()) == want


@pytest.mark.parametrize("line", ["", "http://e.org/", "http://e.org/ 1.2.3.4 20010203040506 text/html x", "http://e.org/ 20010203040506 1.2.3.4 text/html 5", "http://e.org/ 1.2.3.4 20010203040506 5"])
def test_lines_that_are_none(line):
    with pytest.raises(a.ArcError):
        a.arc_fields(line, a.FIELDS[1].split())


def test_fields_of_another_list():
    assert a.arc_fields("a b c d 5", ["URL", "Archive-date", "Archive-length"]) == {"URL": "a b c", "Archive-date": "d", "Archive-length": "5"}


def made(*records):
    return a.arc_head(1, "n.arc", "20010203040506") + b"".join(records)


def record(i, block):
    return a.arc_record(1, f"http://h/{i}", "20010203040506", "text/html", "n.arc", 0, block)


def test_what_is_no_record_is_told_and_passed_over():
    good = [record(i, b"block %d" % i) for i in range(3)]
    broken = b"http://h/x 1.2.3.4 20010203040506 text/html -5\nits block\nmore of it\n"
    short = b"http://h/y 1.2.3.4 20010203040506 text/html 500\nends"
    data, bad = made(good[0], broken, good[1], good[2], short), []
    found = list(a.read_arc(io.BytesIO(data), bad))
    assert [f[2] for f in found] == [b"block 0", b"block 1", b"block 2"]
    at = data.index(broken)
    assert bad == [(at, len(broken), "no length"), (data.index(short), len(short), "4 of 500 bytes")]
    with pytest.raises(a.ArcError):
        list(a.read_arc(io.BytesIO(data)))
    bad = []
    assert list(a.read_arc(io.BytesIO(b"no archive\nat all"), bad)) == [] and bad == [(0, 17, "no version block")]
    assert list(a.read_arc(io.BytesIO(b""), bad)) == [] and len(bad) == 1


def test_noise_never_stops_the_reading():
    rng = random.Random(3)
    for _ in range(200):
        data = bytearray(made(*[record(i, bytes(rng.randrange(256) for _ in range(rng.randrange(40)))) for i in range(5)]))
        for _ in range(rng.randrange(4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        bad = []
        for _, fields, block in a.read_arc(io.BytesIO(bytes(data)), bad):
            assert len(block) == int(list(fields.values())[-1])


def test_conversion_passes_over_what_is_no_record(spark, tmp_path):
    (tmp_path / "x.arc.gz").write_bytes(gzip.compress(made(record(1, b"one" * 50), b"garbage\n", record(2, b"one" * 50), record(3, b""))))
    (tmp_path / "y.arc.gz").write_bytes(gzip.compress(b"nothing"))
    files = spark.createDataFrame([(f"file://{tmp_path}", "x.arc.gz"), (f"file://{tmp_path}", "y.arc.gz")], "folder string, path string")
    assert sorted((r.path, r.bytes, r.reason) for r in a.arc_errors(files).collect()) == [("x.arc.gz", 8, "a line without the fields stated"), ("y.arc.gz", 7, "no version block")]
    found = a.warc_index(a.convert(files)).collect()
    assert sorted((r.url, r.record_type, r.payload_bytes) for r in found) == [("http://h/1", "response", 150), ("http://h/2", "revisit", 150), ("http://h/3", "response", 0)]
