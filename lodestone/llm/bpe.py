"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts each text where its content says so, hence copied passages give equal chunks
wherever they stand. A first pass counts chunk hashes over all documents; chunks found twice or more are marked in a
bit table of fixed size and encoded once each. A second pass encodes every document without such a chunk where it lies,
and cuts the others into references to chunks and the runs between these, which it encodes. Then each document's
parts are put in order, and every join is repaired: the text around it, back and on to the nearest space or line end,
is encoded anew. Before a text is cut, the file's own tokenizer encodes the text around each join, and has to agree
exactly with the repair; where it doesn't, more text is taken, and a document with a join that never agrees is encoded
as a whole.

A mark may be wrong in a full table; such a chunk takes the way of shared ones and the result is the same. Null and
empty texts have no tokens. Equal, tied, null or repeated ids are fine, as rows are kept apart by their place, which is
written down before it is used. Very long texts are cut into chunks like others; their parts meet in one task. Input
columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bpe, _shared, _words

WINDOW, LEAST, MOST, MASK = 16, 512, 8192, 1023
#: The table of repeated chunks has 2**TABLE_BITS bits (2 MB), whatever the corpus.
TABLE_BITS = 24
_SLICE_BITS = 18
#: Bytes of text on each side of a join that its check looks at, one try after the other.
CONTEXTS = (24, 96, 2048)
_U = np.uint64
_B32 = 0x9E3779B1
RESULTS = ["n_tokens", "ids_sha256", "decoded_sha256"]
_PART = [("head", T.BinaryType()), ("ids", T.BinaryType()), ("tail", T.BinaryType()), ("solid", T.BooleanType())]
_PART_ARROW = [pa.binary()] * 3 + [pa.bool_()]


def rolling(data: np.ndarray) -> np.ndarray:
    """For each place from WINDOW on a hash of the WINDOW bytes before it, by doubling the length that is hashed."""
    out, length = _words.BYTE32[data], 1
    while length < WINDOW:
        out = out[:-length] * np.uint32(pow(_B32, length, 1 << 32)) + out[length:]
        length *= 2
    return out


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of every chunk and the end, the document of each, and the hash of its bytes.

    A cut stands where the rolling hash of the WINDOW bytes before it ends in zeros, LEAST to MOST bytes after the last
    one, and never inside a character.
    """
    n = len(data)
    apart = (data & 0xC0) != 0x80
    hashed = rolling(data)[:-1] if n > WINDOW else np.zeros(0, np.uint32)
    # the high bits of the hash depend on all of its bytes
    wanted = np.flatnonzero(((hashed >> np.uint32(22)) & np.uint32(MASK)) == 0) + WINDOW
    wanted = wanted[apart[wanted]]
    cuts, doc = [], []
    for d, (a, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        inner = wanted[np.searchsorted(wanted, a + LEAST) : np.searchsorted(wanted, end)].tolist()
        at = 0
        while a < end:
            cuts.append(a)
            doc.append(d)
            while at < len(inner) and inner[at] < a + LEAST:
                at += 1
            b = inner[at] if at < len(inner) and inner[at] <= a + MOST else a + MOST
            if b >= end:
                break
            while not apart[b]:
                b -= 1
            a = b
    start = np.array(cuts, np.int64)
    doc = np.array(doc, np.int64)
    stop = offsets[doc + 1].copy()
    if len(start) > 1:
        same = doc[1:] == doc[:-1]
        stop[:-1][same] = start[1:][same]
    return np.append(start, n), doc, _words.span_hashes(data, start, stop)


def _spaces(text: bytes) -> tuple[int, int]:
    """Places of the first and the last space or line end; -1 without any."""
    first = min((x for x in (text.find(b" "), text.find(b"\n")) if x >= 0), default=-1)
    return first, max(text.rfind(b" "), text.rfind(b"\n"))


def _first_words(text: bytes, least: int) -> bytes:
    """So many bytes from the start of a text or more, up to a space or line end."""
    if len(text) <= least:
        return text
    end = _spaces(text[least : least + 8192])[0]
    return text[: least + end] if end >= 0 else text


def _last_words(text: bytes, least: int) -> bytes:
    if len(text) <= least:
        return text
    begin = max(0, len(text) - least - 8192)
    found = _spaces(text[begin : len(text) - least])[1]
    return text[begin + found :] if found >= 0 else text


def _around(data: bytes, at: int, least: int) -> bytes:
    """The text around a place: so many bytes or more on both sides, up to spaces or line ends."""
    begin = max(0, at - least - 8192)
    while begin < at and (data[begin] & 0xC0) == 0x80:
        begin += 1
    end = min(len(data), at + least + 8192)
    while end < len(data) and (data[end] & 0xC0) == 0x80:
        end += 1
    return _last_words(data[begin:at], least) + _first_words(data[at:end], least)


class _Parts:
    """Encodes runs of text into parts: head, ids and tail.

    The ids are those of the text between the first and the last space; head and tail are the text before and after. A
    run without a space is all head.
    """

    def __init__(self, json: str):
        self.coder = _bpe.coder(_bpe.WordCoder, json)

    def encode(self, runs: list[bytes]) -> list[tuple]:
        out, inner = [], []
        for run in runs:
            first, last = _spaces(run)
            inner.append("" if first < 0 else run[first:last].decode())
            out.append((run, b"", True) if first < 0 else (run[:first], run[last:], False))
        return [(h, ids, t, s) for (h, t, s), ids in zip(out, self.coder.encode(inner), strict=True)]

    def join(self, documents: list[list[tuple]]) -> list[bytes]:
        """The ids of documents from their parts, each join repaired: encoded anew from space to space."""
        texts, shape = [], []
        for parts in documents:
            own, open_text = [], b""
            for head, inner, tail, solid in parts:
                open_text += head
                if not solid:
                    own += [len(texts), inner]
                    texts.append(open_text.decode())
                    open_text = tail
            own.append(len(texts))
            texts.append(open_text.decode())
            shape.append(own)
        repaired = self.coder.encode(texts)
        return [b"".join(x if isinstance(x, bytes) else repaired[x] for x in own) for own in shape]

    def unlike(self, documents: list[bytes], joins: list[tuple[int, int]]) -> set[int]:
        """The documents in which a join (document, place) doesn't agree with what the file's own tokenizer gives.

        What a repair takes as boundaries, the spaces around a join, has to be such for the tokenizer: the text around
        the join has the same ids as a whole and from space to space. Where it hasn't, more text is looked at.
        """
        todo = joins
        for least in CONTEXTS:
            if todo:
                texts = [_around(documents[d], at, least).decode() for d, at in todo]
                whole, pieces = self.coder.own(texts), self.coder.encode(texts)
                todo = [j for j, x, y in zip(todo, whole, pieces, strict=True) if x != y]
        return {d for d, _ in todo}

    def digest(self, ids: bytes) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(
            self.coder.decode(ids).encode()
        ).hexdigest()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in _shared.blocks(batch.column(0)):
            value, n = np.unique(chunks(data, offsets)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["chunk", "n"])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << TABLE_BITS, bool)
    for batch in batches:
        table[(batch.column(0).to_numpy().view(_U) & _U((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
    yield _slices({s: np.packbits(x) for s, x in enumerate(table.reshape(-1, 1 << _SLICE_BITS)) if x.any()})


def _slices(table: dict[int, np.ndarray]) -> pa.RecordBatch:
    bits = [zlib.compress(x.tobytes(), 1) for x in table.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(table), pa.int32()), pa.array(bits, pa.binary())], ["slice", "bits"]
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(x), np.uint8)
            total[s] = total[s] | x if s in total else x
    yield _slices(total)


def repeated(texts: DataFrame) -> np.ndarray:
    """The bit table of chunks that all documents together hold twice or more."""
    many = texts.mapInArrow(
        _hashes, "chunk long, n long"
    ).groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1").select("chunk")
    found = many.mapInArrow(
        _marks, "slice int, bits binary"
    ).repartition("slice").mapInArrow(_merge, "slice int, bits binary").collect()
    bits = np.zeros((1 << (TABLE_BITS - _SLICE_BITS), 1 << (_SLICE_BITS - 3)), np.uint8)
    for s, x in found:
        bits[s] = np.frombuffer(zlib.decompress(x), np.uint8)
    return bits.reshape(-1)


def encode(
    docs: DataFrame, vocabulary: str, *, text_col: str = "text", carry: list[str] | None = None, with_ids: bool = True
) -> DataFrame:
    """docs (or its columns in `carry`) with n_tokens, the SHA-256 of ids and of decoded text, and the ids themselves.

    The ids are little-endian unsigned 32-bit numbers.
    """
    spark = docs.sparkSession
    _shared.tune(spark)
    context = spark.sparkContext
    json = context.broadcast(_bpe.read(vocabulary))
    texts = docs.select(_shared.text_or_empty(text_col).alias("_text"))
    bits = context.broadcast(repeated(texts))
    results = [*RESULTS, "ids"] if with_ids else RESULTS
    own = [c for c in (docs.columns if carry is None else carry) if c.lower() not in (*RESULTS, "ids")]
    rows = docs.select(
        F.struct(*own).alias("_row"),
        F.monotonically_increasing_id().alias("_place"),
        _shared.text_or_empty(text_col).alias("_text"),
    )
    row_type = rows.schema["_row"].dataType

    def cut(texts: pa.Array) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]], list[bool]]]:
        """Of each document: row, bytes, chunks (from, to, hash) and which of them are marked."""
        for first, end, data, offsets in _shared.blocks(texts):
            start, doc, value = chunks(data, offsets)
            slot = value & _U((1 << TABLE_BITS) - 1)
            marked = (bits.value[(slot >> _U(3)).astype(np.int64)] >> (7 - (slot & _U(7)).astype(np.uint8))) & 1
            lo = np.searchsorted(doc, np.arange(end - first + 1))
            for d in range(end - first):
                a, b = int(lo[d]), int(lo[d + 1])
                base, stop = int(offsets[d]), int(offsets[d + 1])
                ends = [*start[a + 1 : b].tolist(), stop] if b > a else []
                parts = zip(start[a:b].tolist(), ends, value[a:b].view(np.int64).tolist(), strict=True)
                yield first + d, data[base:stop].tobytes(), [
                    (x - base, y - base, h) for x, y, h in parts
                ], marked[a:b].astype(bool).tolist()

    def done(parts: _Parts, ids: list[bytes]) -> list[pa.Array]:
        columns = [list(x) for x in zip(*map(parts.digest, ids), strict=True)] or [[]] * 3
        return [
            *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)),
            *([pa.array(ids, pa.binary())] if with_ids else []),
        ]

    part_columns = [f"_p_{k}" for k, _ in _PART]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of three kinds: documents without marked chunks, done; parts of the others; and marked chunks' bytes."""
        parts = _Parts(json.value)
        seen: set[int] = set()
        for batch in batches:
            place = batch.column(1).to_pylist()
            alone, mixed = [], []
            if len(seen) > 500_000:
                seen.clear()
            for i, data, pieces, marked in cut(batch.column(2)):
                if not any(marked):
                    alone.append(i)
                    continue
                spans, a = [], 0
                for (x, y, h), m in zip(pieces, marked, strict=True):
                    if m:
                        spans += [(a, x, None)] * (a < x) + [(x, y, h)]
                        a = y
                spans += [(a, len(data), None)] * (a < len(data))
                mixed.append((i, data, spans))
            joins = [(k, x) for k, (_, _, spans) in enumerate(mixed) for x, _, _ in spans[1:]]
            unlike = parts.unlike([data for _, data, _ in mixed], joins)
            owner, nth, chunk, runs, last, found = [], [], [], [], [], {}
            for k, (i, data, spans) in enumerate(mixed):
                for j, (x, y, h) in enumerate([] if k in unlike else spans):
                    owner.append(i)
                    nth.append(j)
                    chunk.append(h)
                    runs.append(data[x:y] if h is None else None)
                    last.append(j == len(spans) - 1)
                    if h is not None and h not in seen:
                        seen.add(h)
                        found[h] = data[x:y]
            text = batch.column(2).take(pa.array(alone, pa.int64())).to_pylist()
            ids = parts.coder.encode(text) + parts.coder.own([mixed[k][1].decode() for k in sorted(unlike)])
            alone += [mixed[k][0] for k in sorted(unlike)]
            coded = iter(parts.encode([r for r in runs if r is not None]))
            filled = [next(coded) if r is not None else (None,) * len(_PART) for r in runs]
            # the carried columns go with a row's last part
            taken = [*alone, *(i if e else None for i, e in zip(owner, last, strict=True)), *[None] * len(found)]
            n, m, o = len(alone), len(owner), len(found)
            columns = [
                pa.array([0] * n + [1] * m + [2] * o, pa.int8()),
                batch.column(0).take(pa.array(taken, pa.int64())),
                *[pa.concat_arrays([x, pa.nulls(m + o, x.type)]) for x in done(parts, ids)],
                pa.array([None] * n + [place[i] for i in owner] + [None] * o, pa.int64()),
                pa.array([None] * n + nth + [None] * o, pa.int32()),
                pa.array([None] * n + chunk + list(found), pa.int64()),
                *[pa.array([None] * n + [f[c] for f in filled] + [None] * o, t) for c, t in enumerate(_PART_ARROW)],
                pa.array([None] * (n + m) + list(found.values()), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    types = {"n_tokens": "long", "ids": "binary"}
    out = T.StructType().add("_row", row_type, True)
    for c in results:
        out = out.add(f"_{c}", types.get(c, "string"))
    schema = T.StructType().add("_kind", "byte")
    for f in out.fields:
        schema = schema.add(f.name, f.dataType, True)
    schema = schema.add("_place", "long").add("_nth", "integer").add("_chunk", "long")
    for k, t in _PART:
        schema = schema.add(f"_p_{k}", t)
    schema = schema.add("_data", "binary")
    # each text is cut and encoded once; what follows reads the table, where a place can't change either
    split_rows = _shared.staged(rows.mapInArrow(split, schema), "bpe-parts")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(json.value)
        for batch in batches:
            columns = [
                list(x) for x in zip(*parts.encode(batch.column(1).to_pylist()), strict=True)
            ] or [[]] * len(_PART)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip(columns, _PART_ARROW, strict=True))],
                ["_chunk", *part_columns],
            )

    chunk_schema = T.StructType().add("_chunk", "long")
    for k, t in _PART:
        chunk_schema = chunk_schema.add(f"_p_{k}", t)
    once = split_rows.where("_kind = 2").select("_chunk", "_data").dropDuplicates(["_chunk"]).mapInArrow(
        encoded, chunk_schema
    )
    pieces = split_rows.where("_kind = 1")
    shared = pieces.where("_chunk IS NOT NULL").select(
        "_row", "_place", "_nth", "_chunk"
    ).join(once, "_chunk").drop("_chunk")
    whole = pieces.where("_chunk IS NULL").select("_row", "_place", "_nth", *part_columns).unionByName(shared)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(json.value)
        open_place, held = None, []
        for batch in batches:
            ready, documents = [], []
            columns = [batch.column(c).to_pylist() for c in range(3, 3 + len(_PART))]
            valid = batch.column(0).is_valid().to_pylist()
            for i, (place, *part) in enumerate(zip(batch.column(1).to_pylist(), *columns, strict=True)):
                if place != open_place:
                    open_place, held = place, []
                held.append(tuple(part))
                if valid[i]:
                    ready.append(i)
                    documents.append(held)
                    open_place, held = None, []
            row = batch.column(0).take(pa.array(ready, pa.int64()))
            yield pa.RecordBatch.from_arrays([row, *done(parts, parts.join(documents))], [f.name for f in out])

    together = whole.repartition(_shared.n_partitions(spark), "_place").sortWithinPartitions("_place", "_nth").select(
        "_row", "_place", "_nth", *part_columns
    )
    names = [F.col(f"_{c}").alias(c) for c in results]
    simple = split_rows.where("_kind = 0").select("_row", *[f"_{c}" for c in results])
    return simple.union(together.mapInArrow(assemble, out)).select("_row.*", *names)
