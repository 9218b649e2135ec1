"""Token ids as flat binary files with Elias-Fano document boundaries.

A store is a folder of part files.  Part k holds the documents of one range of
doc_id, ascending, and parts follow one another in the same order::

    magic "EFTOK2\\0\\0"
    unsigned 64-bit: bytes of one id (2 where all fit, else 4), ids in the part,
    bytes of the boundary section, bytes of the doc_id section
    signed 64-bit: the part's smallest doc_id; unsigned 64-bit: documents without
    a doc_id, which come first
    Elias-Fano sequence: where each document begins, and the total
    Elias-Fano sequence: doc_id minus the part's smallest one; the store needs it to
    name documents
    the ids, little-endian unsigned, concatenated

Offsets of single documents come from ``select`` on the boundaries.  Ids are
read by position, so a reader needs the head of a part and the ids it is after.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prudentia.llm import elias_fano
from prudentia.llm.storage import new_dir, written
from prudentia.llm.textscan import chunks
from prudentia.llm.wordcache import SegmentEncoder, joined

MAGIC = b"EFTOK2\0\0"
#: Mark, bytes of an id, ids, bytes of both sequences, first doc_id, documents
#: without a doc_id, which come first.
HEAD = "<8sQQQQqQ"
HEAD_BYTES = struct.calcsize(HEAD)
#: Bytes of text that a part file is planned to hold.
PART_BYTES = 32 << 20
#: Bytes of text that are encoded together: in more text fewer segments are new.
CHUNK_BYTES = 4 << 20
#: Part files whose sizes are summed together.
BLOCK = 1024


_encoders: dict[str, SegmentEncoder] = {}


def _encoder(path: str) -> SegmentEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        id_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        id_bytes[list(vocabulary.values())] = list(map(len, vocabulary))  # byte-level pieces have a character for each byte
        _encoders[path] = SegmentEncoder(joined(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], id_bytes))
    return _encoders[path]


def _encoded(batches, tokenizer: str, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids (Arrow), sizes, ids) of each slice of the batches, end ids included."""
    encoder = _encoder(tokenizer)
    for part in chunks(batches, "text", CHUNK_BYTES):
        ids, first = encoder(part.column("text"))
        n = part.num_rows
        flat = np.empty(len(ids) + n, dtype=np.uint32)
        bounds = first + np.arange(n + 1)
        keep = np.ones(len(flat), dtype=bool)
        keep[bounds[1:] - 1] = False
        flat[keep] = ids
        flat[~keep] = end_id
        yield part.column("doc_id"), np.diff(bounds), flat


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 0, parts: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into a store in shared storage; returns
    its manifest.

    ``end_id`` ends every document; a null or empty text is ``end_id`` alone.
    The manifest has a row per part: ``part`` (its order), ``path``, ``n_docs``,
    ``n_ids``, ``folder``.  A file is named anew by each attempt to write it and
    only whole files enter the manifest, so a task run twice does no harm.
    Documents with equal doc_id are all kept, ordered by text; those without a
    doc_id come first.  An empty table gives an empty manifest.
    """
    folder = new_dir(docs.sparkSession, "tokens")
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts or parts_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches) -> Iterator[pa.RecordBatch]:
        names: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        bodies: list[np.ndarray] = []
        most = end_id
        for doc_ids, counts, ids in _encoded(batches, tokenizer, end_id):
            names.append(doc_ids)
            sizes.append(counts)
            most = max(most, int(ids.max()))
            bodies.append(ids.astype("<u2") if most < 1 << 16 else ids.astype("<u4"))
        if not names:
            return
        width = 2 if most < 1 << 16 else 4
        named, counts = pa.chunked_array(names, pa.int64()), np.concatenate(sizes)
        nameless = named.null_count  # at the front
        doc_ids = named.slice(nameless).to_numpy()
        base = int(doc_ids[0]) if len(doc_ids) else 0
        doc_ids = np.concatenate([np.full(nameless, base), doc_ids])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        edge = elias_fano.encode(bounds, int(bounds[-1]))
        name = elias_fano.encode((doc_ids - base).astype(np.uint64), int(doc_ids[-1] - base))
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        number = TaskContext.get().partitionId()
        path = f"part-{number:06d}-{uuid.uuid4().hex}.tok"
        with fs.open_output_stream(f"{root}/{path}") as out:
            out.write(struct.pack(HEAD, MAGIC, width, int(bounds[-1]), len(edge), len(name), base, nameless))
            out.write(edge)
            out.write(name)
            for body in bodies:
                out.write(body.astype(f"<u{width}", copy=False))
        row = {"part": number, "path": path, "n_docs": len(doc_ids), "n_ids": int(bounds[-1]), "folder": folder}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("folder", pa.string())]))

    return written(ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long, folder string"), "manifest")


class Part:
    """One part file: ``ids(i)`` reads the i-th document alone."""

    def __init__(self, folder: str, name: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        self._file = fs.open_input_file(f"{root}/{name}")
        magic, self._width, self.n_ids, edge, names, self.base, self.nameless = struct.unpack(HEAD, self._file.read_at(HEAD_BYTES, 0))
        if magic != MAGIC:
            raise ValueError(f"not a token part: {name}")
        head = self._file.read_at(edge + names, HEAD_BYTES)
        self.bounds = elias_fano.Sequence(head)
        self.names = elias_fano.Sequence(head, edge)
        self._body = HEAD_BYTES + edge + names
        self.n_docs = self.names.n

    def ids(self, i: int) -> np.ndarray:
        at, to = self.bounds.select(i), self.bounds.select(i + 1)
        return self._read(at, to)

    def _read(self, at: int, to: int) -> np.ndarray:
        return np.frombuffer(self._file.read_at(self._width * (to - at), self._body + self._width * at), f"<u{self._width}")

    def scan(self, docs: int = 1024) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(doc_ids, bounds, ids) of so many documents after another."""
        for at in range(0, self.n_docs, docs):
            to = min(at + docs, self.n_docs)
            bounds = self.bounds.values(at, to + 1)
            yield pa.array(self.names.values(at, to) + self.base, pa.int64(), mask=np.arange(at, to) < self.nameless), bounds, self._read(int(bounds[0]), int(bounds[-1]))


def read_store(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store, read
    from its files.

    ``start`` counts the ids of all documents before; it needs the totals of
    the parts before, which Spark sums by blocks of parts.
    """
    block = F.floor(F.col("part") / BLOCK)
    sums = manifest.groupBy(block.alias("block")).agg(F.sum("n_ids").alias("n"))
    within, until = Window.partitionBy("block").orderBy("part"), Window.orderBy("block")  # a row for every BLOCK part files
    sums = sums.select("block", (F.sum("n").over(until) - F.col("n")).alias("blocks_before"))
    parts = manifest.withColumn("block", block).withColumn("in_block", F.sum("n_ids").over(within) - F.col("n_ids"))
    files = parts.join(sums, "block").select("folder", "path", (F.col("blocks_before") + F.col("in_block")).alias("before"))
    files = files.repartition(max(1, manifest.count()), "path")

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for names, bounds, ids in Part(r["folder"], r["path"]).scan():
                    rel = bounds - bounds[0]
                    body = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    sums = [crc32(body[4 * a : 4 * b]) for a, b in zip(rel[:-1].tolist(), rel[1:].tolist(), strict=True)]
                    columns = [bounds[:-1] + r["before"], np.diff(bounds), np.array(sums, np.int64)]
                    yield pa.RecordBatch.from_arrays([names, *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def parts_for(docs: DataFrame) -> int:
    """Part files for a table, by the bytes of its texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // PART_BYTES))
