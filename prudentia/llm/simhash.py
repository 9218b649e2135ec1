"""SimHash fingerprints of whole texts, and the documents they put together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from prudentia.llm.components import components
from prudentia.llm.storage import written
from prudentia.llm.textscan import chunks
from prudentia.llm.vantage import hamming_links

SEED = 42
#: Shingles hashed at once.
STEP = 1 << 16
#: For each byte, a 64-bit word whose byte k is bit k: adding up to 255 of them
#: counts eight bits at a time.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    total = np.zeros(64, dtype=np.int64)
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    edges = np.arange(0, len(hashes), 255)
    if len(edges):
        total += np.add.reduceat(spread, edges, axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, width: int) -> int:
    """The fingerprint of a text: bit k is set if more than half of the hashes of
    its shingles, each as often as it occurs, have it."""
    words = text.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    ends = ends[-n:]
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, n, STEP):
        bounds = zip(begins[k : min(k + STEP, n)].tolist(), ends[k : k + STEP].tolist(), strict=True)
        counts += bit_counts(np.array([xxh64_intdigest(body[a:b], SEED) for a, b in bounds], dtype=np.uint64))
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, ident: str, text: str, width: int) -> DataFrame:
    """(doc_id, print): the fingerprint of every row, as a long."""

    def scan(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            found = np.array([fingerprint((t.as_py() or "").encode(), width) for t in part.column(text)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(ident), pa.array(found.view(np.int64))], ["doc_id", "print"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(scan, f"doc_id {kind}, print long")


def simhash_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Fingerprints, as 16 lower-case hex digits, come from ``width``-word shingles of
    the lower-cased (A-Z) text; a text with fewer words is one shingle.  Rows
    whose fingerprints differ in at most ``most`` bits are linked, and
    ``component_id`` is the smallest doc_id that links lead to.  Null texts, empty
    ones and those without words have fingerprint zero and are linked like any
    other.  Repeated rows are linked, being equal; rows with the same doc_id are
    judged one by one.  Rows without a doc_id link others, but no component is
    named after them: one of such rows only has a null name.  Other columns play
    no part.  An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, ident, text, width), "fingerprints")
    classes = written(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    links = written(hamming_links(classes, "print", most), "fingerprint-links")
    found = components(links, "a", "b")
    rooted = classes.join(found, F.col("print") == F.col("vertex"), "left").select("print", "first", F.coalesce("component", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
