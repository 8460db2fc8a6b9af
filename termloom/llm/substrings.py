"""Substring dedup by fixed-block anchors: exact repeats of word sequences across documents."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.hashing import NOT_SPACE, Rolling, U, blocks, give_back, pack, unpack

CELLS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("windows", pa.binary()), ("anchors", pa.binary()), ("checks", pa.binary())])
CELL_TYPES = "part int, chunk int, windows binary, anchors binary, checks binary"
#: Partitions of an exchange of chunks.
MOST_TASKS = 8192
FOUND = pa.schema([("part_chunk", pa.int32()), ("hashes", pa.binary()), ("later", pa.binary()), ("checks", pa.binary())])
FOUND_TYPES = "part_chunk int, hashes binary, later binary, checks binary"


def distinct_in_rows(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the hashes in their order, each as often as rows have it."""
    order = np.lexsort((rows, hashes))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return order[new]


def cells(chunk: int, windows: np.ndarray, anchors: np.ndarray, parts: int, bits: int, checks: np.ndarray | None = None) -> pa.Table:
    """One row for each part of the hash range that has windows: sorted, and packed as differences; checks are second hashes as they are.

    bits: as many high bits of a hash are kept; the part is found from the highest.
    """
    windows, anchors = windows >> U(64 - bits), anchors >> U(64 - bits)
    edges = np.array([(p << bits) // parts for p in range(1, parts)], dtype=U)
    cut = np.searchsorted(windows, edges)
    w, a = np.split(windows, cut), np.split(anchors, np.searchsorted(anchors, edges))
    c = [b""] * parts if checks is None else [x.tobytes() for x in np.split(checks, cut)]
    rows = [(p, chunk, pack(x), pack(y), z) for p, (x, y, z) in enumerate(zip(w, a, c)) if len(x)]
    return pa.table([pa.array(c, type=t.type) for c, t in zip(zip(*rows), CELLS)], schema=CELLS) if rows else CELLS.empty_table()


def checks_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=U) for x in column.to_pylist()]


def repeated(table: pa.Table, need_anchor: bool) -> pa.Table:
    """The hashes of a part that two documents have: for each chunk those that it has, and of these the later ones.

    Later: a lower chunk has it as well. With need_anchor only hashes that are anchors count; without, two windows
    are the same if their second hashes are too.
    """
    chunks = table.column("chunk").to_numpy()
    order = np.argsort(chunks, kind="stable")
    lists = [unpack(x) for x in table.column("windows").to_pylist()]
    checks = [np.zeros(len(x), dtype=U) for x in lists] if need_anchor else checks_of(table.column("checks"))
    every, check = np.concatenate(lists), np.concatenate(checks)
    at = np.lexsort((check, every))
    every, check = every[at], check[at]
    same = np.flatnonzero((every[1:] == every[:-1]) & (check[1:] == check[:-1]))
    twice, first = np.unique(every[same], return_index=True)
    second = check[same][first]
    if need_anchor:
        ok = members(twice, np.sort(np.concatenate([unpack(x) for x in table.column("anchors").to_pylist()])))
        twice, second = twice[ok], second[ok]
    seen = np.zeros(len(twice), dtype=bool)
    out = []
    for i in order:
        if not len(twice):
            break
        at = np.searchsorted(twice, lists[i])
        at[at == len(twice)] = 0
        at = np.unique(at[(twice[at] == lists[i]) & (second[at] == checks[i])])
        if len(at):
            mine = twice[at]
            out.append((int(chunks[i]), pack(mine), pack(mine[seen[at]]), b"" if need_anchor else second[at].tobytes()))
            seen[at] = True
    return pa.table([pa.array(c, type=t.type) for c, t in zip(zip(*out), FOUND)], schema=FOUND) if out else FOUND.empty_table()


def members(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted array."""
    if not len(known):
        return np.zeros(len(hashes), dtype=bool)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return known[at] == hashes


def joined(lists: list[bytes]) -> np.ndarray:
    return np.sort(np.concatenate([unpack(x) for x in lists])) if lists else np.empty(0, dtype=U)


def candidates(roll: Rolling, anchors: np.ndarray, k: int, length: int, bits: int) -> np.ndarray:
    """First words of the windows of length words that contain a hit: a window of k words that is a repeated anchor."""
    starts, hashes = roll.windows(k)
    hit = starts[members(hashes >> U(64 - bits), anchors)]
    n = len(roll.total)
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, np.maximum(hit - (length - k), 0), 1)
    np.add.at(depth, hit + 1, -1)
    wide, _ = roll.windows(length)
    return wide[np.cumsum(depth)[wide] > 0]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    depth = np.zeros(n + 1, dtype=np.int64)
    depth[starts] += 1
    np.add.at(depth, starts + length, -1)
    return np.cumsum(depth)[:n] > 0


def find_repeats(docs: DataFrame, length: int, chunk_chars: int, part_words: int, emit: Callable, out: str) -> DataFrame:
    """Apply emit to each row's block, its repeated windows and the later ones among these.

    1. Documents go to chunks, ranges of the hash of doc_id. Each chunk sends the hashes of its reference blocks (every k-th
       window of k words, k being half of length) and of all rolling windows of k words, packed, to parts of the hash range.
    2. A part returns the anchors that two documents have; whoever shares length words has one inside.
    3. A chunk extends each hit: the windows of length words around it go to parts again, with two independent hashes of 64 bits, and those that
       two documents have come back. What overlaps or touches among them is a maximal repeat.
    """
    k = length // 2
    total = docs.agg(F.sum(F.length("text")), F.count("*")).first()
    chars = total[0] or 0
    chunks, parts = max(1, math.ceil(chars / chunk_chars)), max(1, math.ceil(chars / 5 / part_words))
    bits = min(64, max(34, math.ceil(math.log2(max(2, chars / 5))) + 6))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)
    texts = docs.select("*", place.alias("__at"), F.floor(place * chunks / (1 << 31)).cast("int").alias("__chunk"))
    texts = texts.repartition(min(chunks, MOST_TASKS), "__chunk")  # then a task holds several chunks, one after another

    def scan(table: pa.Table) -> pa.Table:
        windows, anchors, at, rows = [], [], [], row_keys(table)
        for block in blocks(table.column("text"), NOT_SPACE):
            starts, hashes = Rolling(block).windows(k)
            row = np.searchsorted(block.bounds, starts, side="right") - 1
            windows.append(hashes)
            at.append(rows[block.first + row])
            anchors.append(hashes[(starts - block.bounds[row]) % k == 0])
        w, a = np.concatenate([np.empty(0, U), *windows]), np.concatenate([np.empty(0, U), *anchors])
        w = w[distinct_in_rows(w, np.concatenate([np.empty(0, np.int64), *at]))]
        return cells(table.column("__chunk")[0].as_py(), w, np.unique(a), parts, bits)

    def widen(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return CELLS.empty_table()
        anchors, rows, wide, check, at = joined(right.column("hashes").to_pylist()), row_keys(left), [], [], []
        for block in blocks(left.column("text"), NOT_SPACE):
            roll = Rolling(block)
            starts = candidates(roll, anchors, k, length, bits)
            wide.append(roll.spans(starts, starts + length))
            check.append(Rolling(block, second=True).spans(starts, starts + length) if len(starts) else starts.astype(U))
            at.append(rows[block.first + np.searchsorted(block.bounds, starts, side="right") - 1])
        w, c = np.concatenate(wide), np.concatenate(check)
        once = distinct_in_rows(w, np.concatenate(at))
        return cells(left.column("__chunk")[0].as_py(), w[once], np.empty(0, U), parts, 64, c[once])

    def report(left: pa.Table, right: pa.Table) -> pa.Table:
        twice, later = (np.concatenate([np.empty(0, U), *(unpack(x) for x in right.column(c).to_pylist())]) for c in ("hashes", "later"))
        order = np.argsort(twice)
        checks = np.concatenate([np.empty(0, U), *checks_of(right.column("checks"))])
        return emit(left, (twice[order], checks[order]), np.sort(later))

    def returned(sent: DataFrame, need_anchor: bool) -> DataFrame:
        return sent.groupBy("part").applyInArrow(lambda t: tidy(repeated, t, need_anchor), FOUND_TYPES)

    hits = returned(texts.groupBy("__chunk").applyInArrow(lambda t: tidy(scan, t), CELL_TYPES), True)
    wide = texts.groupBy("__chunk").cogroup(hits.groupBy("part_chunk")).applyInArrow(lambda a, b: tidy(widen, a, b), CELL_TYPES)
    return texts.groupBy("__chunk").cogroup(returned(wide, False).groupBy("part_chunk")).applyInArrow(lambda a, b: tidy(report, a, b), out)


def tidy(work: Callable, *args) -> pa.Table:
    """A group's result, after which its memory is given back."""
    out = work(*args)
    give_back()
    return out


def row_keys(table: pa.Table) -> np.ndarray:
    """A number for each distinct doc_id, nulls included."""
    codes = table.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode")
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    return codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def row_repeats(table: pa.Table, twice: tuple[np.ndarray, np.ndarray], later: np.ndarray, length: int):
    """For each row: the block, its first and end word, which words repeats cover, and which of these go.

    In a chunk, documents are ordered by the hash of doc_id, then doc_id; the first document that has a window keeps it,
    unless a lower chunk has it.
    """
    keys = row_keys(table)
    ids = table.column("doc_id").to_numpy(zero_copy_only=False)
    place = table.column("__at").to_numpy()
    names = ["" if x is None or x != x else f"{int(x) + (1 << 63):020d}" for x in ids]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[sorted(range(len(keys)), key=lambda i: (place[i], names[i]))] = np.arange(len(keys))
    least = np.full(int(keys.max(initial=0)) + 1, len(keys))
    np.minimum.at(least, keys, rank)
    rank = least[keys]  # rows of one document count as one
    found = []
    for block in blocks(table.column("text"), NOT_SPACE):
        starts, hashes = Rolling(block).windows(length)
        at = np.flatnonzero(members(hashes, twice[0]))
        if len(at):
            second = Rolling(block, second=True).spans(starts[at], starts[at] + length)
            at = at[twice[1][np.searchsorted(twice[0], hashes[at])] == second]
        starts, hashes = starts[at], hashes[at]
        row = block.first + np.searchsorted(block.bounds, starts, side="right") - 1
        found.append((block, starts, hashes, row))
    own = np.concatenate([np.empty(0, U), *[h for _, _, h, _ in found]])
    own_rank = np.concatenate([np.empty(0, np.int64), *[rank[r] for _, _, _, r in found]])
    order = np.lexsort((own_rank, own))
    uniq, first = np.unique(own[order], return_index=True)
    first_rank = own_rank[order][first]
    for block, starts, hashes, row in found:
        n = len(block.hashes)
        gone = members(hashes, later)
        if len(hashes):
            gone |= rank[row] > first_rank[np.searchsorted(uniq, hashes)]
        yield block, covered(starts, length, n), covered(starts[gone], length, n)


def spans(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of the runs of a mask, cut at the bounds of rows."""
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    inner = bounds[(bounds > 0) & (bounds < len(mask))]
    begin[inner] = mask[inner]
    end[inner - 1] = mask[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def repeated_spans(docs: DataFrame, length: int = 50, chunk_chars: int = 8_000_000, part_words: int = 4_000_000) -> DataFrame:
    """Maximal spans of documents whose every window of length words is, word for word, in another document too.

    Words are runs of bytes that aren't ASCII white space, compared by 128 bits of hashes of the words' bytes (at 100 TB one chance match in some trillion such
    corpora); white space between them isn't compared. Any passage of at least length words that two documents share is found (a repeat contains a whole
    reference block of either document); passages within one document alone aren't.

    Returns doc_id, start_word, n_words, start_byte, end_byte (UTF-8), n_removed: how many of the span's words
    remove_repeats takes out here, since an earlier document, by the order of xxhash64(doc_id), has them.
    Null, empty and short texts have no spans. Rows that repeat a doc_id are one document and give their spans each; so do null ids.
    An empty table gives no rows. Other columns are ignored.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start_word", "n_words", "start_byte", "end_byte", "n_removed")])

    def emit(left: pa.Table, twice: tuple[np.ndarray, np.ndarray], later: np.ndarray) -> pa.Table:
        if not len(left) or not len(twice[0]):
            return schema.empty_table()
        out = []
        for block, mask, gone in row_repeats(left, twice, later, length):
            s, e = spans(mask, block.bounds)
            if not len(s):
                continue
            row = np.searchsorted(block.bounds, s, side="right") - 1
            removed = np.concatenate(([0], np.cumsum(gone)))
            first, base = block.bounds[row], block.offsets[row]
            ids = left.column("doc_id").take(pa.array(block.first + row)).combine_chunks()
            out.append(pa.table([ids, pa.array(s - first), pa.array(e - s), pa.array(block.starts[s] - base), pa.array(block.ends[e - 1] - base), pa.array(removed[e] - removed[s])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return find_repeats(known, length, chunk_chars, part_words, emit, ", ".join(f"{c} long" for c in schema.names))


def remove_repeats(docs: DataFrame, length: int = 50, chunk_chars: int = 8_000_000, part_words: int = 4_000_000) -> DataFrame:
    """docs without the words of repeats (see repeated_spans) that an earlier document has, by the order of xxhash64(doc_id).

    All columns stay. A document of which nothing is left is dropped; null, empty and blank texts stay as they are.
    Of a removed span, the white space after it goes too. Rows that repeat a doc_id are one document.
    """
    named = {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)}  # no name of docs can clash
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])

    def emit(left: pa.Table, twice: tuple[np.ndarray, np.ndarray], later: np.ndarray) -> pa.Table:
        plain = left.drop_columns(["__at", "__chunk"])
        if not len(left) or not len(twice[0]):
            return plain
        texts, keep = [], []
        for block, _, gone in row_repeats(left, twice, later, length):
            n = len(block.data)
            s, e = spans(gone, block.bounds)
            row = np.searchsorted(block.bounds, s, side="right") - 1
            stop = np.append(block.starts, n)[np.minimum(e, len(block.starts))]
            stop = np.where(e < block.bounds[row + 1], stop, block.offsets[row + 1])
            drop = np.zeros(n + 1, dtype=np.int64)
            np.add.at(drop, block.starts[s], 1)
            np.add.at(drop, stop, -1)
            stays = np.cumsum(drop)[:n] == 0
            data, at = block.data[stays].tobytes(), np.concatenate(([0], np.cumsum(stays)))[block.offsets]
            lost = np.zeros(len(at) - 1, dtype=bool)
            lost[row] = True
            for i in range(len(at) - 1):
                t = data[at[i] : at[i + 1]].decode()
                texts.append(t.rstrip() if lost[i] else t)
                keep.append(not lost[i] or bool(t.strip()))
        text = pa.array(texts, type=pa.string())
        text = pa.compute.if_else(plain.column("text").combine_chunks().is_null(), pa.scalar(None, pa.string()), text)
        at = plain.schema.get_field_index("text")
        return plain.set_column(at, plain.schema.field(at), text.cast(plain.schema.field(at).type)).filter(pa.array(keep))

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)
    done = find_repeats(inner, length, chunk_chars, part_words, emit, out)
    return done.select(*[F.col(n).alias(c) for c, n in named.items()])


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
