"""Removing byte strings that occur again, by merged suffix transforms.

Every window of ``LENGTH`` bytes is owned by an anchor: the ``GRAM``-byte string
within it whose hash is smallest (the leftmost of equal ones).  Equal windows
have equal anchors at equal places, so windows are compared only with those of
the same anchor.  Windows in a row with one anchor form a segment; anchors met
once need no further look, and equal segments are counted rather than kept.

Groups of different segments with one anchor are the shards' collections: each
shard gets its Burrows-Wheeler transform and the transforms are merged (module
``bwt``), which gives the repeated windows.  A group of a single segment that
occurs again repeats as a whole.  A group with very many different segments is
cut into shorter runs of windows, grouped by the bytes that these share, down
to single windows; so no group outgrows a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from prudentia.llm import bwt
from prudentia.llm.storage import aside, release, scratch, written
from prudentia.llm.textscan import SubstringHash, chunks, column_bytes, give_back, in_group

U64 = np.uint64
LENGTH = 200
GRAM = 24
#: Bits of the hash that order anchors; the rest holds positions.
_ORDER_BITS = 34
#: Different segments above which a group is cut further.
HOT = 2000
#: Share of all segments, as one in this many, above which an anchor is split,
#: and the parts it is split into.
LARGE, SPLIT = 4096, 64
#: Windows of the runs that hot groups are cut into, from level to level.
LEVELS = (16, 4, 1)
#: Bytes that are merged at once, and bytes of one shard.
BATCH_BYTES, SHARD_BYTES = 1 << 19, 1 << 17
#: Bytes of a text that are scanned at once.
SCAN_BYTES = 1 << 19
_SALT = U64(0x5851F42D4C957F2D)


def segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(at, n, lead, anchor, content) of all segments: where its first window
    starts in ``data``, how many windows it has, how many bytes stand before its
    anchor, and hashes of the anchor and of all its bytes."""
    size, span = len(data), LENGTH - GRAM + 1
    for begin in range(0, max(0, size - LENGTH + 1), SCAN_BYTES):
        end = min(size, begin + SCAN_BYTES + LENGTH - 1)
        part = data[begin:end]
        starts = len(part) - LENGTH + 1
        if starts <= 0:
            return
        h = SubstringHash(part)
        grams = len(part) - GRAM + 1
        place = np.arange(grams)
        hashes = h(place, place + GRAM)
        key = (hashes >> U64(64 - _ORDER_BITS) << U64(64 - _ORDER_BITS)) | place.astype(np.uint64)
        padded = np.full(-(-grams // span) * span + span, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:grams] = key
        table = padded.reshape(-1, span)
        to_end = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        from_begin = np.minimum.accumulate(table, axis=1).ravel()
        least = np.minimum(to_end[:starts], from_begin[span - 1 : span - 1 + starts])
        chosen = (least & U64((1 << 64 - _ORDER_BITS) - 1)).astype(np.int64)
        valid = np.ones(starts, dtype=bool)
        inner = offsets[(offsets > begin) & (offsets < end)] - begin
        for k in inner.tolist():  # windows over the end of a text
            valid[max(0, k - LENGTH + 1) : k] = False
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        anchor = chosen[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        at, anchor = at[first], anchor[first]
        yield at + begin, n, anchor - at, hashes[anchor], h(at, at + n + LENGTH - 1)


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64), pa.int64()) for c in columns]


def anchors(docs: DataFrame) -> DataFrame:
    """(row, at, n, lead, a, s) of every segment of (row, text): position in the
    text, windows, bytes before the anchor, anchor and content."""

    def scan(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", SCAN_BYTES):
            data, offsets = column_bytes(part.column("text"))
            rows = part.column("row").to_numpy()
            for at, n, lead, anchor, content in segments(data, offsets):
                text = np.searchsorted(offsets, at, "right") - 1
                yield pa.RecordBatch.from_arrays(_longs(rows[text], at - offsets[text], n, lead, anchor, content), ["row", "at", "n", "lead", "a", "s"])

    return docs.select("row", "text").mapInArrow(scan, "row long, at long, n long, lead long, a long, s long")


def _combined(found: DataFrame) -> DataFrame:
    """(a, s, n, lead, row, at, w) of the segments, equal ones of a task as one row
    with their number and one of their places."""

    names = ["a", "s", "n", "lead", "row", "at", "w"]

    def combine(batches) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            a, s, n, lead, row, at, w = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((s, a))
            a, s, w = a[order], s[order], w[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
            first = np.flatnonzero(new)
            pick = order[first]
            return pa.RecordBatch.from_arrays(_longs(a[first], s[first], n[pick], lead[pick], row[pick], at[pick], np.add.reduceat(w, first)), names)

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy() for c in names])
            if sum(len(x[0]) for x in held) >= 1_000_000:
                yield out()
                held.clear()
        if held:
            yield out()
            held.clear()
        give_back()

    return found.select(names).mapInArrow(combine, ", ".join(f"{c} long" for c in names))


def _groups(found: DataFrame) -> DataFrame:
    """(a, s, n, lead, row, at, w, different) of the segments whose anchor occurs
    twice or more, each once; ``different`` counts those of the anchor.

    Anchors that hold more than one in ``LARGE`` of all segments, so fewer than
    ``LARGE`` of them, are dealt to ``SPLIT`` tasks each.
    """
    large = F.count("*") * LARGE > found.count()
    hot = written(found.groupBy("a").agg(large.alias("_hot")).where("_hot"), "hot")  # fewer than LARGE rows
    split = F.when(F.col("_hot"), F.pmod("s", F.lit(SPLIT))).otherwise(F.lit(0).cast("long"))
    dealt = _combined(found).join(F.broadcast(hot), "a", "left").withColumn("_deal", split).repartition("a", "_deal")
    # one of the equal places, all from the same row: the least by (row, at)
    each = dealt.groupBy("a", "_deal", "s").agg(F.max("_hot").alias("_hot"), F.sum("w").alias("w"), F.max("n").alias("n"), F.max("lead").alias("lead"), F.min(F.struct("row", "at")).alias("place"))
    own = W.partitionBy("a", "_deal")
    counted = each.withColumn("total", F.sum("w").over(own)).withColumn("different", F.count("*").over(own))
    counted = written(counted.where("total > 1 OR _hot").select("a", "s", "n", "lead", "place.row", "place.at", "w", "_hot", "total", "different"), "groups")
    # a split anchor's parts are summed, and told to all of them
    whole = counted.where("_hot").groupBy("a").agg(F.sum("w").alias("_total"), F.count("*").alias("_different"))
    told = counted.join(F.broadcast(whole), "a", "left")
    return told.where("coalesce(_total, total) > 1").select("a", "s", "n", "lead", "row", "at", "w", F.coalesce("_different", "different").alias("different"))


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted segments (a, s, n, lead, w, row, at) with their ``bytes``."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("at", "n", "lead", "a", "s", "w")).alias("cuts"))  # of one text

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", SCAN_BYTES):
            data, offsets = column_bytes(part.column("text"))
            lists = part.column("cuts")
            flat = lists.flatten()
            count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            rel, n, lead, a, s, w = (flat.field(k).to_numpy() for k in ("at", "n", "lead", "a", "s", "w"))
            text = np.repeat(np.arange(part.num_rows), count)
            begin, size = offsets[:-1][text] + rel, n + LENGTH - 1
            bounds = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(begin, size) + in_group(size)
            body = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[take])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*_longs(a, s, n, lead, w, part.column("row").to_numpy()[text], rel), body], ["a", "s", "n", "lead", "w", "row", "at", "bytes"])

    return docs.select("row", "text").join(lists, "row").mapInArrow(cut, "a long, s long, n long, lead long, w long, row long, at long, bytes binary")


def _merged(bodies: DataFrame) -> DataFrame:
    """(a, s, begin, end): runs of repeated windows in each segment, from the
    merged transforms of the groups."""
    names = ["a", "s", "begin", "end"]

    def solve(tables: list[pa.Table]) -> pa.RecordBatch:
        whole = pa.concat_tables(tables)
        body = whole.column("bytes").combine_chunks().cast(pa.large_binary())
        bounds = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
        data = np.frombuffer(body.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        string, offset = bwt.repeated(data, bounds - bounds[0], whole.column("w").to_numpy(), LENGTH, SHARD_BYTES)
        new = np.ones(len(string), dtype=bool)
        new[1:] = (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(string)))
        of = string[first]
        return pa.RecordBatch.from_arrays(_longs(whole.column("a").to_numpy()[of], whole.column("s").to_numpy()[of], offset[first], offset[first] + n), names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = table.column("a").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            bytes_at = np.concatenate([[0], np.cumsum(table.column("n").to_numpy() + LENGTH - 1)])
            at = 0
            for k in range(len(cuts) - 1):  # a batch of whole groups is solved when it is large enough
                if size + bytes_at[cuts[k]] - bytes_at[at] >= BATCH_BYTES and (k or keys[0] != last):
                    if cuts[k] > at:
                        held.append(table.slice(at, cuts[k] - at))
                    yield solve(held)
                    held, size, at = [], 0, cuts[k]
            held.append(table.slice(at))
            size += int(bytes_at[-1] - bytes_at[at])
            last = keys[-1]
        if held:
            yield solve(held)
            held = []
        give_back()

    return bodies.select("a", "s", "n", "w", "bytes").repartition("a").sortWithinPartitions("a").mapInArrow(run, "a long, s long, begin long, end long")


def _shorter(bodies: DataFrame, windows: int) -> DataFrame:
    """The segments cut into runs of ``windows`` windows, counted from their
    anchor, as (a, s, n, lead, row, at, w) with (parent_a, parent_s, shift).

    Runs at one place from the anchor are grouped by the bytes that all windows
    there share; a run that its segment has only a part of holds them too.
    """
    names = ["a", "s", "n", "lead", "row", "at", "w", "parent_a", "parent_s", "shift"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            body = batch.column("bytes").cast(pa.large_binary())
            bounds = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
            data = np.frombuffer(body.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
            n, lead, a, s, w, row, at = (batch.column(c).to_numpy() for c in ("n", "lead", "a", "s", "w", "row", "at"))
            phase = (LENGTH - lead) % windows
            pieces = -(-(n + phase) // windows)
            of = np.repeat(np.arange(len(n)), pieces)
            whole = in_group(pieces) * windows - phase[of]  # where the run would begin
            shift, end = np.maximum(whole, 0), np.minimum(whole + windows, n[of])
            base = (bounds[:-1] - bounds[0])[of]
            h = SubstringHash(data)
            place = ((LENGTH - lead[of] + whole) // windows).astype(np.uint64)
            core = h(base + whole + windows - 1, base + whole + LENGTH) ^ ((a[of].view(np.uint64) + place) * _SALT)
            content = h(base + shift, base + end + LENGTH - 1)
            yield pa.RecordBatch.from_arrays(_longs(core, content, end - shift, lead[of] - shift, row[of], at[of] + shift, w[of], a[of], s[of], shift), names)
        give_back()

    return bodies.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _runs(docs: DataFrame, found: DataFrame, level: int) -> DataFrame:
    """(a, s, begin, end): runs of repeated windows of segments (a, s, n, lead,
    row, at, w), relative to the segment."""
    groups = _groups(found)
    out = groups.where("different = 1").select("a", "s", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"))
    out = out.union(_merged(_cut(docs, groups.where(f"different BETWEEN 2 AND {HOT}"))))
    hot = groups.where(f"different > {HOT}")
    if level < len(LEVELS) and not hot.isEmpty():
        pieces = written(_shorter(_cut(docs, hot), LEVELS[level]), "pieces")
        inner = _runs(docs, pieces, level + 1)
        moved = pieces.join(inner, ["a", "s"]).select(F.col("parent_a").alias("a"), F.col("parent_s").alias("s"), (F.col("begin") + F.col("shift")).alias("begin"), (F.col("end") + F.col("shift")).alias("end"))
        out = out.union(moved)
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(row, spans): for each text of (row, text) with repeated windows, the
    bytes they cover, as unordered and overlapping (begin, end) pairs.

    ``row`` tells texts apart; rows equal in it have equal texts, and count as
    often as they occur.
    """
    spark = docs.sparkSession
    with scratch(spark):  # all of it is gone before texts are moved
        found = written(anchors(docs), "anchors")
        runs = written(_runs(docs, found.withColumn("w", F.lit(1).cast("long")), 0), "runs")
        release(spark)
        hits = found.select("a", "s", "row", "at").join(runs, ["a", "s"])
        spans = hits.groupBy("row").agg(F.collect_set(F.struct((F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("end") + (LENGTH - 1)).alias("end"))).alias("spans"))  # of one text
        return written(spans, "spans", stays=True)


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Remove every byte covered by a ``LENGTH``-byte string that also starts
    anywhere else in the texts, the same one included.

    Strings are judged on the input and never reach over a text's end.  Adds
    ``n_bytes`` and ``n_removed`` (bytes of the UTF-8 text), ``n_spans``
    (maximal removed runs), ``kept_sha256`` (of the bytes that stay) and
    ``removed`` (the runs); with ``keep_text`` the text is replaced by what
    stays, characters that were cut apart left out, else it isn't returned.
    A null text counts as empty and stays null.  All rows are kept; rows with
    equal texts lose all of them that is long enough.  Other columns pass; ones
    with an added name come back with ``_input`` behind it.  An empty table
    gives an empty result.
    """
    docs = aside(docs, ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "_row", "_spans"], (ident, text))
    keyed = docs.withColumn("_row", F.xxhash64(F.col(ident), F.col(text)))
    spans = repeated_spans(keyed.select(F.col("_row").alias("row"), F.col(text).alias("text")).where(F.octet_length("text") >= LENGTH))
    joined = keyed.join(spans.select(F.col("row").alias("_row"), F.col("spans").alias("_spans")), "_row", "left").drop("_row")
    kept = [c for c in docs.columns if keep_text or c != text]
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*[f for f in docs.schema.fields if f.name in kept], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), T.StructField("removed", T.ArrayType(span))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, SCAN_BYTES):
            data, offsets = column_bytes(part.column(text))
            bytes_, removed, count, digest, texts, lists = [], [], [], [], [], []
            spans = part.column("_spans")
            null = part.column(text).is_null().to_pylist()
            for i in range(part.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                runs: list[tuple[int, int]] = []
                if spans[i].is_valid:
                    pairs = spans[i].values
                    begin, end = pairs.field("begin").to_numpy(), pairs.field("end").to_numpy()
                    order = np.argsort(begin, kind="stable")
                    begin, reach = begin[order], np.maximum.accumulate(end[order])
                    new = np.ones(len(begin), dtype=bool)
                    new[1:] = begin[1:] > reach[:-1]
                    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)
                    runs = list(zip(begin[new].tolist(), reach[last].tolist(), strict=True))
                edges = [0, *(x for r in runs for x in r), len(own)]
                rest = b"".join(own[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))
                bytes_.append(len(own))
                removed.append(len(own) - len(rest))
                count.append(len(runs))
                digest.append(sha256(rest).hexdigest())
                lists.append([{"begin": a, "end": b} for a, b in runs])
                if keep_text:
                    texts.append(None if null[i] else rest.decode("utf-8", "ignore"))
            columns = [pa.array(texts, pa.string()) if c == text else part.column(c) for c in kept]
            columns += [*[pa.array(x, pa.int64()) for x in (bytes_, removed, count)], pa.array(digest, pa.string()), pa.array(lists, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return joined.mapInArrow(run, schema)
