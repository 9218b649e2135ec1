"""SentencePiece encoding with byte spans in the original text, and decoding.

The model's compiled character map is a double-array trie over byte strings
with a pool of replacements.  Normalisation takes the longest entry that is a
prefix of what is left, else one character, and records for every byte that it
emits where in the source it came from.  The library encodes; its pieces tile
the normalised text, so the recorded alignment projects each of them to a span
of original bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prudentia.llm.storage import aside
from prudentia.llm.textscan import chunks, column_bytes, task_cache
from prudentia.llm.wordcache import SegmentEncoder

MARK = "▁".encode()
#: Distinct segments that a worker remembers; the pipeline shares its workers.
MOST_KEPT = 200_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: numbers or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """A compiled character map: ``longest(data, at)`` is (replacement, bytes
    read), or None if no entry is a prefix of what stands there."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self._units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self._pool = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self._units)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        units, found = self._units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            if not byte:
                break
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        begin, read = found
        return self._pool[begin : self._pool.index(b"\0", begin)], read


class Normalizer:
    """The normalisation that a model file describes."""

    def __init__(self, model: bytes):
        spec = dict(_fields(next((x for n, x in _fields(model) if n == 3), b"")))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised, source): ``source[i]`` is where byte i of the result
        came from; one more entry for its end."""
        out, source = bytearray(), []
        at = 0
        space = MARK if self.escape else b" "
        chars: list[tuple[bytes, int, int]] = []
        while at < len(text):
            entry = self.map.longest(text, at) if self.map else None
            if entry is None:
                lead = text[at]
                read = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                entry = text[at : at + read], read
            chars.append((entry[0], at, entry[1]))
            at += entry[1]
        if self.squeeze:
            while chars and not chars[0][0].strip(b" "):
                chars.pop(0)
        if self.prefix and chars:
            out += space
            source += [chars[0][1]] * len(space)
        previous = self.squeeze
        for made, begin, _ in chars:
            if previous:
                made = made.lstrip(b" ")
            for byte in made:
                one = space if byte == 0x20 else bytes([byte])
                out += one
                source += [begin] * len(one)
            if made:
                previous = self.squeeze and made.endswith(b" ")
        end = chars[-1][1] + chars[-1][2] if chars else 0
        if self.squeeze:
            while out.endswith(space):
                end = source[len(out) - len(space)]
                del out[-len(space) :], source[-len(space) :]
        return bytes(out), np.array([*source, end], dtype=np.int64)


class SpanEncoder:
    """Ids of whole texts, with the byte span in its text of every piece."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        self.normalize = Normalizer(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.vocab_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self._byte = np.array([self.library.is_byte(i) for i in range(n)])
        self._unknown = self.library.unk_id()
        self._size = np.array([1 if b else len(s.encode()) for s, b in zip(names, self._byte.tolist(), strict=True)])
        inside = any("▁" in s.lstrip("▁") for s in names)
        # a cut at single spaces is exact only if nothing reaches over one
        self._free = not self.normalize.map and not self.normalize.squeeze and self.normalize.escape and self.normalize.prefix and not inside
        self.ids = SegmentEncoder(self._encode, cut=self._free, drop=self._free, most=MOST_KEPT)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def project(self, text: str, ids: list[int]) -> np.ndarray:
        """(pieces, 2): begin and end of each piece in the UTF-8 of ``text``.

        Pieces of one source character that the map expands, or that is spelt
        in bytes, get that whole character.
        """
        normal, source = self.normalize(text.encode())
        ids = np.asarray(ids, dtype=np.int64)
        if self._unknown in ids:
            sizes = self._unknown_sizes(normal, ids)
        else:
            sizes = self._size[ids]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if bounds[-1] != len(normal):
            raise ValueError(f"pieces cover {bounds[-1]} of {len(normal)} normalised bytes")
        begins = source[bounds[:-1]]
        ends = source[bounds[1:]]
        # within a character: up to the next place that has another source
        later = np.searchsorted(source[:-1], begins, "right")
        if not len(ids):
            return np.zeros((0, 2), np.int64)
        spans = np.stack([begins, np.maximum(ends, source[later])], axis=1)
        if self.normalize.prefix and sizes[0] == len(MARK):  # the mark put before the text has no source
            spans[0, 1] = spans[0, 0]
        return spans

    def _unknown_sizes(self, normal: bytes, ids: np.ndarray) -> np.ndarray:
        sizes, at = [], 0
        for k, i in enumerate(ids.tolist()):
            if i != self._unknown:
                size = int(self._size[i])
            elif k + 1 == len(ids):
                size = len(normal) - at
            else:
                following = self.library.id_to_piece(int(ids[k + 1])).encode()
                size = normal.index(following, at + 1) - at
            sizes.append(size)
            at += size
        return np.array(sizes)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, spans, first): ids and (begin, end) of all pieces of all texts,
        and for each text where its own begin, with the total at the end."""
        data, offsets = column_bytes(column)
        parts, first, starts = self.ids.segments(column)
        ids, counts = self.ids.encode(parts)
        edge = np.concatenate([[0], np.cumsum(counts)])
        inner = np.ones(len(starts), dtype=bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        inner &= self._free
        segment = np.repeat(np.arange(len(starts)), counts)
        sizes = self._size[ids]
        ends = np.cumsum(sizes)
        ends -= (np.concatenate([[0], ends])[edge[:-1]])[segment] if len(ids) else 0
        begins = ends - sizes
        # Without a map, a normalised segment is the mark and its own bytes; the
        # mark of an inner one stands for the space that it was cut at.
        extra = inner.astype(np.int64)[segment]
        mark = len(MARK)
        spans = np.stack([np.where(begins < mark, 0, begins - mark + extra), np.where(ends <= mark, extra, ends - mark + extra)], axis=1)
        bytewise = np.flatnonzero(self._byte[ids])
        if len(bytewise):
            spans[bytewise] = self._whole_characters(data, spans[bytewise] + starts[segment[bytewise]][:, None]) - starts[segment[bytewise]][:, None]
        blanks = np.concatenate([[0], np.cumsum(data == 0x20)])
        bounds = np.append(starts, len(data))
        odd = blanks[bounds[1:]] - blanks[bounds[:-1]] > inner
        if not self._free:
            odd[:] = True
        odd[segment[ids == self._unknown]] = True
        for k in np.flatnonzero(odd).tolist():
            a, b = edge[k], edge[k + 1]
            spans[a:b] = self.project(data[starts[k] + inner[k] : bounds[k + 1]].tobytes().decode(), ids[a:b])
            if inner[k] and b > a:
                spans[a:b] += 1
                spans[a, 0] = 0
        spans += (starts - np.repeat(offsets[:-1], np.diff(first)))[segment][:, None]
        return ids, spans, edge[first]

    @staticmethod
    def _whole_characters(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
        lead = (data & 0xC0) != 0x80
        at = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))
        leads = np.append(np.flatnonzero(lead), len(data))
        return np.stack([at[spans[:, 0]], leads[np.searchsorted(leads, spans[:, 1])]], axis=1)


_encoders: dict[str, SpanEncoder] = task_cache()


def _encoder(path: str) -> SpanEncoder:
    if path not in _encoders:
        _encoders[path] = SpanEncoder(path)
    return _encoders[path]


def encode_with_spans(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int, without begin and end ids) and ``spans``
    (array of struct(begin, end): byte spans in the UTF-8 text) to ``docs``.

    A null or empty text has empty arrays.  Other columns and repeated rows
    pass unchanged; a column named ``ids`` or ``spans`` comes back with
    ``_input`` behind its name.  An empty table gives an empty result.
    """
    docs = aside(docs, ["ids", "spans"], (text,))
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("spans", T.ArrayType(span))])

    def encode(batches) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for part in chunks(batches, text):
            ids, spans, first = encoder(part.column(text))
            bounds = pa.array(first.astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["begin", "end"])
            made = [pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(bounds, pairs)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "ids", "spans"])

    return docs.mapInArrow(encode, schema)


def _covered(spans: np.ndarray) -> int:
    """Distinct bytes in a text's spans."""
    reach = np.maximum.accumulate(np.concatenate([[0], spans[:, 1]]))
    return int(np.maximum(0, spans[:, 1] - np.maximum(spans[:, 0], reach[:-1])).sum())


def digest(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, n_bytes_covered, ids_sha256, decoded_sha256) of each
    whole text, with begin and end ids, decoded again from the ids.

    ``n_bytes_covered`` sums the lengths of the pieces' spans over the distinct
    bytes they cover; it is the length of the text whenever pieces tile it.
    A null or empty text has begin and end ids only.  Rows are taken one by one,
    repeated ones and null doc_ids too; other columns are left out.  An empty
    table gives an empty result.
    """

    def encode(batches) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        bos, eos = encoder.library.bos_id(), encoder.library.eos_id()
        for part in chunks(batches, "text"):
            ids, spans, first = encoder(part.column("text"))
            sizes, hashes, texts, covered = [], [], [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.concatenate([[bos], ids[a:b], [eos]]).astype("<u4")
                sizes.append(len(own))
                hashes.append(sha256(own).hexdigest())
                texts.append(sha256(encoder.library.decode(own.tolist()).encode()).hexdigest())
                covered.append(_covered(spans[a:b]))
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(covered, pa.int64()), pa.array(hashes), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_bytes_covered", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, n_bytes_covered long, ids_sha256 string, decoded_sha256 string")


def encode_and_decode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int, with begin and end ids), ``n_tokens``,
    ``n_bytes_covered`` (distinct bytes of the text in the pieces' spans) and
    ``decoded_sha256`` (of the text that the ids decode to) to ``docs``.

    A null or empty text has begin and end ids only.  Other columns and repeated
    rows pass unchanged; columns with an added name come back with ``_input``
    behind it.  An empty table gives an empty result.
    """
    names = ["ids", "n_tokens", "n_bytes_covered", "decoded_sha256"]
    docs = aside(docs, names, (text,))
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes_covered", T.LongType()), T.StructField("decoded_sha256", T.StringType())])

    def encode(batches) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        bos, eos = encoder.library.bos_id(), encoder.library.eos_id()
        for part in chunks(batches, text):
            ids, spans, first = encoder(part.column(text))
            covered = [_covered(spans[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            bounds = first + 2 * np.arange(len(first))
            flat = np.empty(int(bounds[-1]), dtype=np.int32)
            inner = np.ones(len(flat), dtype=bool)
            inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
            flat[bounds[:-1]], flat[bounds[1:] - 1] = bos, eos
            flat[inner] = ids
            texts = [sha256(encoder.library.decode(flat[a:b].tolist()).encode()).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            made = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat)), pa.array(np.diff(bounds), pa.int64()), pa.array(covered, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *names])

    return docs.mapInArrow(encode, schema)
