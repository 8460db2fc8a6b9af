"""Chroma audio fingerprints of binary media columns, and their alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import materialize

RATE, FRAME, HOP = 11025, 4096, 1365
#: Weights by which a frame's pitch classes are smoothed over time.
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: (kind, first pitch class, pitch classes, frames): sixteen rectangles over WIDTH frames, each compared in two halves or thirds.
WIDTH = 16
FILTERS = (
    (0, 0, 3, 15), (0, 4, 4, 8), (0, 8, 4, 12), (1, 0, 6, 14), (1, 4, 8, 10), (1, 6, 6, 16), (2, 0, 12, 16), (2, 2, 8, 8),
    (2, 6, 6, 12), (3, 0, 10, 16), (3, 2, 6, 8), (4, 1, 9, 12), (4, 3, 6, 16), (5, 0, 12, 15), (5, 5, 6, 9), (0, 0, 12, 5),
)


@cache
def pitch_classes(rate: int, frame: int) -> np.ndarray:
    """A matrix that adds the energies of a spectrum's bins, 28 to 3520 Hz, into 12 pitch classes."""
    f = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(f), 12))
    ok = np.flatnonzero((f >= 28) & (f <= 3520))
    out[ok, np.round(12 * np.log2(f[ok] / 440)).astype(int) % 12] = 1
    return out


def chroma(pcm: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Frames by pitch classes, smoothed over time, each of unit length; silent frames are 0."""
    if len(pcm) < frame:
        return np.zeros((0, 12))
    frames, window = np.lib.stride_tricks.sliding_window_view(pcm, frame)[::hop], np.hamming(frame).astype(pcm.dtype)
    classes = pitch_classes(rate, frame)
    # some hundred frames at once: a recording may last hours
    energy = np.concatenate([np.abs(np.fft.rfft(frames[k : k + 256] * window, axis=1)) ** 2 @ classes for k in range(0, len(frames), 256)])
    if len(energy) < len(SMOOTH):
        return np.zeros((0, 12))
    smooth = np.stack([np.convolve(energy[:, c], SMOOTH, mode="valid") for c in range(12)], axis=1)
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > 1e-9, smooth / np.maximum(norm, 1e-9), 0)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each window of WIDTH frames: two bits, in Gray code, for each filter over an integral image."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(x1, y1, x2, y2):
        return total[at + x2, y2] - total[at + x1, y2] - total[at + x2, y1] + total[at + x1, y1]

    out = np.zeros(n, dtype=np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, y, w, y + h)
        if kind == 0:  # all against the rest of the window
            b = area(0, 0, w, 12) - whole
            a = whole * (12 - h) / h if h < 12 else area(w // 2, 0, w, 12)
            b = b if h < 12 else area(0, 0, w // 2, 12)
        elif kind == 1:  # upper and lower half
            a = area(0, y + h // 2, w, y + h)
            b = whole - a
        elif kind == 2:  # later and earlier half
            a = area(w // 2, y, w, y + h)
            b = whole - a
        elif kind == 3:  # opposite quarters
            a = area(0, y, w // 2, y + h // 2) + area(w // 2, y + h // 2, w, y + h)
            b = whole - a
        elif kind == 4:  # middle third of the pitch classes
            a = 2 * area(0, y + h // 3, w, y + 2 * h // 3)
            b = whole - a / 2
        else:  # middle third of the time
            a = 2 * area(w // 3, y, 2 * w // 3, y + h)
            b = whole - a / 2
        level = np.log1p(a) - np.log1p(b)
        step = np.searchsorted([-0.15, 0.0, 0.15], level)
        out = (out << np.uint32(2)) | np.array([0, 1, 3, 2], dtype=np.uint32)[step]
    return out


def pcm_fingerprint(pcm: bytes | memoryview | None, rate: int = RATE) -> np.ndarray | None:
    """The fingerprint of 16-bit little-endian mono samples; a last odd byte is ignored."""
    if pcm is None:
        return None
    samples = np.frombuffer(pcm, dtype="<i2", count=len(pcm) // 2)
    return fingerprint(chroma(samples / np.float32(32768), rate)).astype(np.int64)


def _prints(ids: pa.Array, fps: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(fps, type=pa.list_(pa.int64()))], names=["id", "fp"])


def fingerprint_media(media: DataFrame, id_col: str, pcm_col: str, rate: int = RATE) -> DataFrame:
    """(id, fp): chroma fingerprints of a binary column of 16-bit little-endian mono PCM at rate.

    fp is array<bigint>, one value for each of FRAME samples' hop. Null media: null. Recordings too short for one window, and empty ones,
    have an empty fp; a last odd byte is ignored. Repeated rows are fingerprinted each, null ids too. An empty table gives no rows.
    Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _prints(batch.column(0), [pcm_fingerprint(x.as_buffer() and memoryview(x.as_buffer()), rate) for x in batch.column(1)])

    return media.select(F.col(id_col).cast("bigint").alias("id"), F.col(pcm_col).alias("pcm")).mapInArrow(run, "id long, fp array<long>")


def bit_errors(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the bits that differ between two fingerprints of one length."""
    return float(np.bitwise_count((a ^ b).astype(np.uint32)).sum() / (32 * max(1, len(a))))


MATCHES = "query_id long, id long, offset long, overlap long, error double"


def offset_histograms(query: np.ndarray, values: np.ndarray, sizes: np.ndarray, silent: int) -> tuple[np.ndarray, np.ndarray]:
    """(wrong bits, pairs of values) of a query's fingerprint against those of rows, for each row and offset from 1 - len(query) up.

    Each pair of a query's and a row's value counts at the offset that aligns them; two silent ones don't count. values is padded to one length.
    """
    n, (rows, width) = len(query), values.shape
    kind = np.uint16 if n * 32 < 1 << 16 else np.int32
    wrong = np.zeros((rows, width + n - 1), dtype=kind)
    offset, size = np.arange(1 - n, width), sizes[:, None]
    pairs = np.minimum(n - np.maximum(0, -offset), size - np.maximum(0, offset)).astype(np.int32)
    real, quiet = np.arange(width) < size, values == silent
    padded = not real.all()
    for i, v in enumerate(query):
        bits = np.bitwise_count(values ^ v)
        if padded:
            bits *= real
        wrong[:, n - 1 - i : n - 1 - i + width] += bits
        if v == silent:
            pairs[:, n - 1 - i : n - 1 - i + width] -= quiet & real
    return wrong, pairs


def alignments(q_ids: np.ndarray, q_prints: list[np.ndarray], r_ids: np.ndarray, r_prints: list[np.ndarray], silent: int, max_error: float, min_overlap: int) -> pa.Table:
    """MATCHES of the recordings of two blocks; those of about the same length are held against a query at once."""
    sizes = np.array([len(x) for x in r_prints], dtype=np.int64)
    found = [np.empty((5, 0))]
    for length in np.unique(np.ceil(np.log2(np.maximum(1, sizes))).astype(int)):
        every = np.flatnonzero(np.ceil(np.log2(np.maximum(1, sizes))).astype(int) == length)
        for k in range(0, len(every), step := max(1, (1 << 18) >> length)):
            rows = every[k : k + step]
            width = int(sizes[rows].max())
            values = np.zeros((len(rows), width), dtype=np.uint32)
            values[np.arange(width) < sizes[rows][:, None]] = np.concatenate([r_prints[r] for r in rows])
            for x, query in enumerate(q_prints):
                wrong, pairs = offset_histograms(query, values, sizes[rows], silent)
                row, at = np.nonzero((wrong <= (32 * max_error) * pairs) & (pairs >= max(1, min_overlap)) & (r_ids[rows] != q_ids[x])[:, None])
                if not len(row):
                    continue
                offset, overlap = at + 1 - len(query), pairs[row, at]
                error = wrong[row, at] / (32.0 * overlap)
                order = np.lexsort((offset, np.abs(offset), error, row))
                order = order[np.append(True, np.diff(row[order]) != 0)]
                found.append(np.stack([np.full(len(order), x), rows[row[order]], offset[order], overlap[order], error[order]]))
    x, y, offset, overlap, error = np.concatenate(found, axis=1)
    whole = lambda c: c.astype(np.int64)
    return pa.table([q_ids[whole(x)], r_ids[whole(y)], whole(offset), whole(overlap), error], names=["query_id", "id", "offset", "overlap", "error"])


def align_media(queries: DataFrame, prints: DataFrame, max_error: float = 0.2, min_overlap: int = 10, block: int = 8192, query_block: int = 64) -> DataFrame:
    """Recordings of prints(id, fp) that are the same as one of queries(id, fp) at some offset: query_id, id, offset, overlap, error.

    For each pair a histogram over all offsets of the recording against the query counts wrong bits and pairs of values; the
    offset with the least share of wrong bits counts, then the one nearest 0, then the lower; it is reported if that share is at
    most max_error with min_overlap pairs of values. So the result is that of all pairs and offsets. Pairs of silent values (the value of an all-zero
    image) don't count, since silence carries no tune. A recording isn't compared with itself.

    queries is a stated set. Each block of it meets each block of recordings in a task of its own; nothing is shuffled but the blocks,
    and a value that is frequent costs no more than others. Null ids and null or empty fingerprints match nothing. Rows that repeat an id
    are one recording with the first fingerprint in sort order. Empty tables give no rows. Other columns are ignored.
    """
    silent = int(fingerprint(np.zeros((WIDTH, 12)))[0])

    def known(df: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
        once = df.filter("id is not null and size(fp) > 0").groupBy(F.col("id").cast("bigint").alias("id")).agg(F.min("fp").alias("fp"))
        once = materialize(once, name)
        n = max(1, -(-once.count() // size))
        return once.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n))), n

    (asked, n_asked), (held, n_held) = known(queries, "queries", query_block), known(prints, "prints", block)
    left = asked.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_held - 1)))).groupBy("part", "other")
    right = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))).groupBy("other", "part")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        sides = [(t.column("id").to_numpy(), [x.values.to_numpy().astype(np.uint32) for x in t.column("fp")]) for t in (a, b)]
        return alignments(*sides[0], *sides[1], silent, max_error, min_overlap)

    return left.cogroup(right).applyInArrow(meet, MATCHES)


NOTES = 220.0 * 2 ** (np.arange(12) / 12)


@cache
def mixing(slices: int, components: int) -> np.ndarray:
    """For each slice a matrix, the same always, that makes the loudness of twelve notes of a vector's components."""
    return np.random.default_rng(11).normal(size=(slices, 12, components))


@cache
def tones(rate: int) -> np.ndarray:
    return np.sin(2 * np.pi * NOTES[:, None] * np.arange(rate // 4) / rate)


def recording(vector: np.ndarray | None, seconds: float = 6.0, rate: int = RATE) -> bytes | None:
    """A vector as sound: in each quarter second all its components set the loudness of twelve notes, in another mixture each time.

    So similar vectors sound alike throughout, and others differ in each part. NaN counts as 0.
    """
    if vector is None:
        return None
    v = np.nan_to_num(np.asarray(vector, dtype=float), posinf=0, neginf=0)
    loud = np.maximum(mixing(max(1, int(seconds * 4)), len(v)) @ v, 0)
    loud /= np.maximum(loud.max(axis=1, keepdims=True), 1e-9)
    return ((loud @ tones(rate)).ravel() * 2000).astype("<i2").tobytes()


def sonify(embeddings: DataFrame, seconds: float = 6.0, rate: int = RATE) -> DataFrame:
    """(vec_id, pcm): each vector as a recording (see recording), since the tables hold no sound.

    A null vector has null pcm, an empty one silence; repeated rows and null ids are rows like others; an empty table gives no rows.
    A vector makes a thousand times its bytes of sound, which goes on in small batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 16):
                part = batch.slice(k, 16)
                pcm = [recording(x.values and x.values.to_numpy(zero_copy_only=False), seconds, rate) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(pcm, type=pa.binary())], names=["vec_id", "pcm"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "vec_id long, pcm binary")


def fingerprint_vectors(embeddings: DataFrame, seconds: float = 6.0, rate: int = RATE) -> DataFrame:
    """(id, fp): fingerprint_media of sonify, one recording at a time within the task that makes it; no sound passes through the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _prints(batch.column(0), [pcm_fingerprint(recording(x.values and x.values.to_numpy(zero_copy_only=False), seconds, rate), rate) for x in batch.column(1)])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "id long, fp array<long>")


def op7_chroma_prints(spark, sf_dir: str) -> DataFrame:
    """(vec_id, fp, block, matches): the fingerprint of each recording, and in rows of their own the matches of those whose id is divisible by 100.

    matches holds (id, offset, error) in the order of ids, those of a range of 65,536 ids, the block, in a row.
    """
    prints = materialize(fingerprint_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "fingerprints")
    found = align_media(prints.filter("id % 100 = 0"), prints)
    found = found.groupBy(F.col("query_id").alias("vec_id"), F.floor(F.col("id") / 65536).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "offset", "error"))).alias("matches"))
    return prints.withColumnRenamed("id", "vec_id").unionByName(found, allowMissingColumns=True)
