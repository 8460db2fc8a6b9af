"""Codecs of posting lists: variable bytes and Elias gamma, over the flat values of many lists at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

BLOCKS = "term string, blk long, n long, carry long, vbyte binary, gamma binary"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Binary digits of positive integers below 2^63."""
    n, rest = np.ones(len(values), dtype=np.int64), values.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(step)
        n[big] += step
        rest = np.where(big, rest >> np.uint64(step), rest)
    return n


def binary_lists(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end at ends, one after another in data."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encode_vbyte(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Seven bits a byte, least first, the high bit on the last byte; bounds[i] to bounds[i + 1] are the values of list i."""
    size = -(-bit_lengths(np.maximum(values, 1)) // 7)
    end = np.cumsum(size)
    data = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        data[end[has] - size[has] + k] = (values[has] >> (7 * k)) & 127
    data[end - 1] |= 128
    return binary_lists(data, np.concatenate(([0], end))[bounds[1:]])


def encode_gamma(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """As many zeros as binary digits follow the first, then the digits; each list is padded to bytes. Values below 1 count as 1."""
    values = np.maximum(values, 1)
    digits = bit_lengths(values)
    used = np.concatenate(([0], np.cumsum(2 * digits - 1)))
    per_list = used[bounds[1:]] - used[bounds[:-1]]
    ends = np.cumsum(-(-per_list // 8))
    shift = np.concatenate(([0], ends[:-1])) * 8 - used[bounds[:-1]] if len(ends) else ends
    first = used[:-1] + digits - 1 + np.repeat(shift, np.diff(bounds))
    bits = np.zeros(int(ends[-1]) * 8 if len(ends) else 0, dtype=np.uint8)
    for k in range(int(digits.max(initial=0))):
        has = np.flatnonzero(digits > k)
        bits[first[has] + k] = (values[has] >> (digits[has] - 1 - k)) & 1
    return binary_lists(np.packbits(bits), ends)


def decode_vbyte(data: bytes, count: int) -> list[int]:
    b = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(b & 128)[:count]
    if not len(last):
        return []
    first = np.concatenate(([0], last[:-1] + 1))
    b = b[: last[-1] + 1]
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first).tolist()


def decode_gamma(data: bytes, count: int) -> list[int]:
    bits, out, at = "".join(f"{b:08b}" for b in data), [], 0
    while len(out) < count:
        one = bits.index("1", at)
        at = 2 * one - at + 1
        out.append(int(bits[one:at], 2))
    return out


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the bounds of each list."""
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))


def encode_blocks(value: str):
    """A mapInArrow function over rows (term, blk, carry, docs, tfs), no list empty: doc_ids or their gaps (value: doc_id, gap), and the frequencies, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (values, bounds), (tfs, _) = _flat(batch, "docs"), _flat(batch, "tfs")
            if value == "gap" and len(values):
                gaps = np.diff(values, prepend=0)
                gaps[bounds[:-1]] = values[bounds[:-1]] - batch.column("carry").to_numpy()
                values = gaps
            yield pa.RecordBatch.from_arrays(
                [batch.column("term"), batch.column("blk"), pa.array(np.diff(bounds)), batch.column("carry"), encode_vbyte(values, bounds), encode_gamma(tfs, bounds)],
                names=["term", "blk", "n", "carry", "vbyte", "gamma"],
            )

    return run


def running_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (term, before, gaps) the running sums of each list, from before on, as (term, docs)."""
    for batch in batches:
        gaps, bounds = _flat(batch, "gaps")
        sums = np.concatenate(([0], np.cumsum(gaps)))
        docs = sums[1:] + np.repeat(batch.column("before").to_numpy() - sums[bounds[:-1]], np.diff(bounds))
        yield pa.RecordBatch.from_arrays([batch.column("term"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(docs, pa.int64()))], names=["term", "docs"])


def decode_blocks(gaps: bool):
    """A mapInPandas function from encode_blocks back to (term, doc_id, tf)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            terms, docs, tfs = [], [np.empty(0, np.int64)], []
            for term, n, carry, v, g in zip(pdf["term"], pdf["n"], pdf["carry"], pdf["vbyte"], pdf["gamma"]):
                values = np.array(decode_vbyte(v, n), dtype=np.int64)
                docs.append(np.cumsum(values) + carry if gaps else values)
                terms += [term] * n
                tfs += decode_gamma(g, n)
            yield pd.DataFrame({"term": terms, "doc_id": np.concatenate(docs), "tf": tfs})

    return run
