"""Byte-pair encoding and decoding of a corpus through a table of its distinct words."""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that splits text into words before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: key: a chunk for its documents' rows, -1 - part for words.
SPLIT = "key long, chunk long, part int, ids array<long>, sizes array<long>, data binary"


def read_pieces(path: str) -> dict[bytes, int]:
    """The vocabulary: piece to id, from a file with one base64 piece and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def squeeze(values: np.ndarray) -> bytes:
    """32-bit integers by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def word_blob(words: list[bytes]) -> bytes:
    sizes = squeeze(np.array([len(w) for w in words], dtype=np.int64))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(b"".join(words), 3)


def blob_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unsqueeze(data[4 : 4 + n]).astype(np.int64)).tolist()
    text = zstandard.decompress(data[4 + n :])
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def split_batches(pattern: str, parts: int, chunk_chars: int):
    """A mapInArrow function: for each chunk a row of its documents' word numbers, and rows of its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, at = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        words: dict[str, int] = {}
        ids, sizes, numbers, chars = [], [], [], 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = find(text) if text else []
                add = words.setdefault
                numbers.append(np.fromiter((add(w, len(words)) for w in found), dtype=np.uint32, count=len(found)))
                ids.append(doc)
                sizes.append(-1 if text is None else len(found))
                chars += len(text or "")
                if chars >= chunk_chars:
                    yield _split_rows(at, words, ids, sizes, numbers, parts)
                    words, ids, sizes, numbers, chars, at = {}, [], [], [], 0, at + 1
        if ids:
            yield _split_rows(at, words, ids, sizes, numbers, parts)

    return run


def _split_rows(chunk: int, words: dict[str, int], ids: list, sizes: list, numbers: list, parts: int) -> pa.RecordBatch:
    """Words are renumbered by part, then alphabet, so that a part's answer needs no numbers."""
    coded = [w.encode() for w in words]
    part = np.fromiter((zlib.crc32(w) % parts for w in coded), dtype=np.int64, count=len(coded))
    order = sorted(range(len(coded)), key=coded.__getitem__)
    order = np.array(order, dtype=np.int64)[np.argsort(part[order], kind="stable")] if coded else np.empty(0, np.int64)
    place = np.empty(len(order), dtype=np.uint32)
    place[order] = np.arange(len(order))
    flat = np.concatenate([np.empty(0, np.uint32), *numbers])
    rows = [(chunk, chunk, -1, ids, sizes, squeeze(flat)), (chunk, chunk, -2, None, None, squeeze(place))]
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if edges[p] < edges[p + 1]:
            own = [coded[i] for i in order[edges[p] : edges[p + 1]]]
            rows.append((-1 - p, chunk, p, None, None, word_blob(own)))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=["key", "chunk", "part", "ids", "sizes", "data"])


def encode_part(pattern: str, vocabulary: str):
    """An applyInArrow function over a part's words of all chunks, blob by blob: each distinct word is encoded once. Chunks give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = None, {}
        for batch in batches:
            for k in range(len(batch)):
                if batch.column("key")[k].as_py() >= 0:
                    continue
                if encode is None:
                    import tiktoken

                    encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=read_pieces(vocabulary), special_tokens={}).encode_ordinary
                ids, sizes = [], []
                for w in blob_words(batch.column("data")[k].as_py()):
                    code = known.get(w)
                    if code is None:
                        code = known[w] = array("i", encode(w.decode()))
                    ids += code
                    sizes.append(len(code))
                a, b = squeeze(np.array(ids, dtype=np.int64)), squeeze(np.array(sizes, dtype=np.int64))
                out = pa.array([len(a).to_bytes(4, "little") + a + b], type=pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(k, 1), batch.column("part").slice(k, 1), out], names=["chunk", "part", "codes"])

    return run


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of values at starts, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Pieces:
    """The table of pieces by id, and its join with lists of ids by position."""

    def __init__(self, path: str):
        pieces = read_pieces(path)
        self.table = [b""] * (max(pieces.values()) + 1)
        for piece, i in pieces.items():
            self.table[i] = piece
        self.known = np.zeros(len(self.table), dtype=bool)
        self.known[list(pieces.values())] = True
        self.sizes = np.array([len(p) for p in self.table], dtype=np.int64)
        self.starts, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.table), dtype=np.uint8)

    def texts(self, lists: pa.ListArray) -> pa.Array:
        total = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)))
        # runs of rows with about 2^18 ids: indices of bytes take many times the text's memory
        edges, out = [0, *np.flatnonzero(np.diff(total // (1 << 18))) + 1, len(lists)], []
        for at, to in zip(edges, edges[1:]):
            part = lists.slice(int(at), int(to - at))
            ids, counts = part.flatten().to_numpy(), np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            if len(ids) and not ((ids >= 0) & (ids < len(self.known))).all() or not self.known[ids].all():
                raise ValueError("an id isn't in the vocabulary")
            text = gather(self.data, self.starts[ids], self.sizes[ids]).tobytes()
            ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))[np.concatenate(([0], np.cumsum(counts)))].tolist()
            null = part.is_null().to_pylist()
            out.append(pa.array([None if n else text[a:b].decode("utf-8", "replace") for n, a, b in zip(null, ends, ends[1:])], type=pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], type=pa.string())


def place_codes(vocabulary: str | None = None):
    """A cogrouped function: a chunk's documents with ids, from its word numbers and the codes of its words; with a vocabulary the text is decoded from the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("text", pa.string())] * (vocabulary is not None))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or left.column("key")[0].as_py() < 0:
            return schema.empty_table()
        rows = {r["part"]: r for r in left.to_pylist()}
        docs, place = rows[-1], unsqueeze(rows[-2]["data"])
        codes, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
        order = np.argsort(right.column("part").to_numpy(), kind="stable")
        for data in (right.column("codes")[int(k)].as_py() for k in order):
            n = int.from_bytes(data[:4], "little")
            codes.append(unsqueeze(data[4 : 4 + n]))
            lengths.append(unsqueeze(data[4 + n :]))
        codes, lengths = np.concatenate(codes).astype(np.int32), np.concatenate(lengths).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        word = place[unsqueeze(docs["data"])]
        sizes = np.array(docs["sizes"], dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
        parts, offsets = [np.empty(0, np.int32)], np.concatenate(([0], np.cumsum(lengths[word])))[ends].astype(np.int32)
        for k in range(0, len(word), 1 << 18):
            w = word[k : k + (1 << 18)]
            parts.append(gather(codes, starts[w], lengths[w]))
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)), mask=pa.array(sizes < 0))
        columns = [pa.array(docs["ids"], type=pa.int64()), lists]
        if vocabulary is not None:
            columns.append(Pieces(vocabulary).texts(lists))
        return pa.table(columns, schema=schema)

    return run


def encode_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, chunk_chars: int = 8_000_000, part_chars: int = 20_000_000, max_parts: int = 4096, decode: bool = False
) -> DataFrame:
    """(doc_id, ids): the byte-pair codes of whole texts, equal to those that the tokenizer gives a text itself.

    Texts are split into words in chunks, which keep their documents' words as numbers. The distinct words of a
    chunk go, sorted and compressed, to parts by hash: together these are the table of the corpus's distinct words. A part takes the chunks' words one after
    another, encodes each distinct word once and sends codes back to the chunks, which put them where the numbers stand. No row a word is ever shuffled;
    a chunk sends max_parts rows at most, whatever the corpus. With decode, a column text is made from the ids again (see decode_documents).

    A null text has null ids, an empty one none. A long text makes a chunk of its own. Repeated rows and null doc_ids are rows like others. An empty table gives no
    rows. Other columns are ignored. Rank files aren't copied: vocabulary is a path that executors can read.
    """
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = min(max_parts, max(1, math.ceil(chars / part_chars)))
    cut = known.mapInArrow(split_batches(pattern, parts, chunk_chars), SPLIT).groupBy("key")
    # both sides group the same rows by the same key, so that Spark splits texts once and reuses the exchange
    codes = cut.applyInArrow(encode_part(pattern, vocabulary), "chunk long, part int, codes binary")
    codes = codes.select(F.col("chunk").alias("c"), "part", "codes")
    out = "doc_id long, ids array<int>" + ", text string" * decode
    return cut.cogroup(codes.groupBy("c")).applyInArrow(place_codes(vocabulary if decode else None), out)


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encoded(doc_id, ids) with text, by a join of the ids with the table of pieces.

    The table has one row an id, 50,256 for the default vocabulary, whatever the corpus; so it is held by each task and joined
    by position, batch by batch. Null ids give null text, no ids an empty one, ids that aren't in the vocabulary an
    error; bytes that aren't UTF-8 become U+FFFD. Repeated rows and null doc_ids are rows like others; an empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pieces.texts(batch.column(1))], names=["doc_id", "ids", "text"])

    known = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return known.mapInArrow(run, "doc_id long, ids array<int>, text string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the text decoded from these, within the task that has them."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), decode=True)


def bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    return decode_documents(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "text")


SQL_ROUNDTRIP = "SELECT doc_id, text FROM documents"
