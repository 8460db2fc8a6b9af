"""N-gram Jaccard self-join by chosen paths (Christiani and Pagh, 2017), with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.components import components
from termloom.llm.hashing import ALNUM, Rolling, U, blocks, give_back, mix
from termloom.session import materialize

COORDS = 64
#: Columns of candidates: a pair (a, b) found in a run, or a row (a) of a bucket that goes on, with the coordinates used so far as bits.
FOUND = ["a", "b", "run", "path", "inst", "sig", "used"]
FOUND_TYPES = "a long, b long, run int, path long, inst int, sig binary, used long"
#: inst of the rows of a bucket that further coordinates didn't make small, and of groups.
TILED = -1
#: A thick set of over so many times limit rows is a group: its rows are listed instead of its pairs.
GROUP = 4
#: Pairs that a task holds at once.
HELD = 1 << 20


def seeds(batch: int) -> tuple[np.ndarray, ...]:
    """Independent hash functions for the coordinates of each batch of runs."""
    rng = np.random.default_rng(20177 + batch)
    return (
        rng.integers(0, 2**63, COORDS, dtype=U),
        (rng.integers(0, 2**32, COORDS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32),
        rng.integers(0, 2**32, COORDS, dtype=np.uint32),
        rng.integers(0, 2**63, COORDS, dtype=U) * U(2) + U(1),
    )


def grams(texts, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, Rolling]]:
    """For each block: first row, bounds of the rows' n-grams, their hashes, and the rolling hashes.

    A row of fewer than n words has one gram, of all its words; a row without words has none.
    """
    for block in blocks(texts, ALNUM):
        roll = Rolling(block)
        starts, hashes = roll.windows(n)
        words = np.diff(block.bounds)
        short = np.flatnonzero((words > 0) & (words < n))
        per_row = np.maximum(words - n + 1, 0)
        if len(short):
            whole = roll.spans(block.bounds[short], block.bounds[short + 1])
            hashes = np.insert(hashes, (np.cumsum(per_row) - per_row)[short], whole)
            per_row[short] = 1
        yield block.first, np.concatenate(([0], np.cumsum(per_row))), hashes, roll


def signature_batches(n: int, firsts: int, batch: int = 0):
    """A mapInArrow function: MinHash values of the first coordinates, and one byte of each of all 64."""
    add, odd32, xor32, odd64 = seeds(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bounds, g, roll in grams(batch.column(1), n):
                rows = np.flatnonzero(np.diff(bounds))
                if not len(rows):
                    continue
                at = bounds[:-1][rows]
                sig = np.empty((len(rows), COORDS), dtype=np.uint8)
                paths = np.empty((len(rows), firsts), dtype=U)
                low = (g >> U(32)).astype(np.uint32)
                for c in range(COORDS):
                    if c < firsts:
                        paths[:, c] = mix(np.minimum.reduceat(g * odd64[c] ^ add[c], at) + add[c])
                        sig[:, c] = (paths[:, c] >> U(56)).astype(np.uint8)
                    else:
                        least = np.minimum.reduceat((low ^ xor32[c]) * odd32[c], at)
                        sig[:, c] = (mix(least.astype(U) + U(c)) >> U(56)).astype(np.uint8)
                words = roll.bounds
                whole = roll.spans(words[rows], words[rows + 1])
                other = mix(np.add.reduceat(mix(g ^ U(0xA5A5A5A5)) * (np.arange(len(g), dtype=U) * U(2) + U(1) - np.repeat(at.astype(U) * U(2), np.diff(bounds)[rows])), at))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + rows)),
                        pa.array(whole.view(np.int64)), pa.array(other.view(np.int64)), pa.array((words[rows + 1] - words[rows])),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, paths.size + 1, firsts, dtype=np.int32)), pa.array(paths.view(np.int64).ravel())),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDS), len(rows), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary()),
                    ],
                    names=["doc_id", "h1", "h2", "words", "paths", "sig"],
                )
            give_back()

    return run


def least_equal(threshold: float, miss: float) -> int:
    """The most equal coordinates to ask for so that a pair at the threshold fails with probability miss at most."""
    below, k = 0.0, 0
    while (below := below + math.comb(COORDS, k) * threshold**k * (1 - threshold) ** (COORDS - k)) <= miss:
        k += 1
    return k


class Paths:
    """Candidates within buckets: small ones are compared pair by pair, large ones are split on.

    grouped: a large set of rows that are like their whole bucket is kept as a group, that is as rows, since its pairs grow with its square.
    """

    def __init__(self, threshold: float, limit: int, grouped: bool = False, sketch_miss: float = 0.001):
        self.least = least_equal(threshold, sketch_miss)
        self.least_group = GROUP * limit if grouped else math.inf
        self.held = 0
        self.groups: list[tuple[int, np.ndarray]] = []
        self.dense, self.limit = 0.9 * threshold, limit
        self.branches = max(1, round(1 / threshold))
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def compare(self, sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """A pair is kept in each bucket that it shares: whether an earlier one was small enough to compare all isn't known here."""
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            ok = (sig[a] == sig[b]).sum(axis=1) >= self.least
            self.keep(a[ok], b[ok])

    def keep(self, i: np.ndarray, j: np.ndarray) -> None:
        self.left.append(i)
        self.right.append(j)
        self.held += len(i)

    def group(self, sig: np.ndarray, rows: np.ndarray, thick: np.ndarray, seed: int) -> None:
        """Keep the thick rows as a group. Others join it if they may be similar to over limit of them, else their pairs with it are kept."""
        mine, rest, joins = rows[thick], np.flatnonzero(~thick), thick.copy()
        for k in range(0, len(rest), step := max(1, (1 << 16) // len(mine))):
            part = rest[k : k + step]
            ok = (sig[rows[part]][:, None, :] == sig[mine][None, :, :]).sum(axis=2) >= self.least
            joins[part] = many = ok.sum(axis=1) > self.limit
            x, y = np.nonzero(ok & ~many[:, None])
            self.keep(rows[part[x]], mine[y])
        self.groups.append((seed, rows[joins]))

    def small(self, sig: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """All pairs of each of many small buckets, which are runs of rows."""
        for size in np.unique(sizes):
            at = starts[sizes == size]
            x, y = np.triu_indices(size, 1)
            for k in range(0, len(at), step := max(1, (1 << 18) // len(x))):
                part = at[k : k + step]
                self.compare(sig, (part[:, None] + x).ravel(), (part[:, None] + y).ravel())

    def large(self, sig: np.ndarray, rows: np.ndarray, seed: int, used: tuple[int, ...]) -> Iterator[None]:
        """Split recursively on sampled coordinates beyond those used; a row that is like its whole bucket is compared with it.

        Stops each time that many pairs are held.
        """
        stack = [(rows, seed, used)]
        while stack:
            rows, seed, used = stack.pop()
            if len(rows) > self.limit and len(used) < COORDS:
                s = sig[rows]
                like = np.zeros(len(rows))
                for c in range(COORDS):
                    like += np.bincount(s[:, c], minlength=256)[s[:, c]]
                thick = (like - COORDS) / COORDS >= self.dense * (len(rows) - 1)
            else:
                thick = np.ones(len(rows), dtype=bool)
            mine = np.flatnonzero(thick)
            if len(mine) > self.least_group:
                self.group(sig, rows, thick, seed)
                mine = mine[:0]
            rank = np.full(len(rows), len(rows))
            rank[mine] = np.arange(len(mine))
            for k in range(0, len(mine), step := max(1, (1 << 19) // max(1, len(rows)))):
                part = mine[k : k + step]
                x, y = np.nonzero(rank[None, :] > rank[part][:, None])
                self.compare(sig, rows[part[x]], rows[y])
                if self.held > HELD:
                    yield
            rest = rows[~thick]
            if len(rest) < 2:
                continue
            rng = np.random.default_rng(seed & 0x7FFFFFFFFFFFFFFF)
            free = np.setdiff1d(np.arange(COORDS), used)
            for c in rng.choice(free, min(self.branches, len(free)), replace=False):
                order = rest[np.argsort(sig[rest, c], kind="stable")]
                cut = np.flatnonzero(np.diff(sig[order, c])) + 1
                for g in np.split(order, cut):
                    if len(g) > 1:
                        stack.append((g, hash((seed, int(c), int(sig[g[0], c]))), (*used, int(c))))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.concatenate(self.left) if self.left else np.empty(0, dtype=np.int64)
        j = np.concatenate(self.right) if self.right else np.empty(0, dtype=np.int64)
        self.left, self.right, self.held = [], [], 0
        return i, j


def as_batch(**columns) -> pa.RecordBatch:
    """A batch of FOUND, null where nothing is given."""
    n = len(next(iter(columns.values())))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(columns[c], type=t) if c in columns else pa.nulls(n, t) for c, t in zip(FOUND, types)], names=FOUND)


def sig_matrix(column: pa.Array) -> np.ndarray:
    raw = column.cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset]
    return np.frombuffer(raw.buffers()[2], dtype=np.uint8)[at : at + len(raw) * COORDS].reshape(-1, COORDS)


def distinct_pairs(x: np.ndarray, y: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), run], axis=1)[x != y], axis=0)
    return as_batch(a=both[:, 0], b=both[:, 1], run=both[:, 2].astype(np.int32))


def bucket_batches(threshold: float, limit: int, firsts: int, task_rows: int, levels: int = 3, grouped: bool = False):
    """A mapInArrow function over rows sorted by bucket; gives pairs (a, b, run), and the rows of buckets above task_rows again.

    Such a bucket goes on by each of 1 / threshold further coordinates, as large ones within a task do; one that levels
    of these didn't make small goes to tiles, where all its pairs are compared. Groups (see Paths) come as rows like those of tiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths(threshold, limit, grouped)

        def coords_of(used) -> tuple[int, ...]:
            return tuple(c for c in range(COORDS) if int(used) >> c & 1)

        def whole(path, ids, sig, inst, used):
            """Output for whole buckets."""
            cut = np.flatnonzero(np.diff(path)) + 1
            starts = np.concatenate(([0], cut))
            sizes = np.diff(np.concatenate((starts, [len(path)])))
            low = (sizes > 1) & (sizes <= limit)
            paths.small(sig, starts[low], sizes[low])
            for s, n in zip(starts[sizes > limit], sizes[sizes > limit]):
                if n > task_rows:
                    yield from split(*[x[s : s + n] for x in (path, ids, sig, inst, used)])
                    continue
                # the parts of a bucket that was sent on draw their own coordinates
                again = used[s] != 1 << int(inst[s])
                for _ in paths.large(sig, np.arange(s, s + n), int(path[s]) if again else int(inst[s]), coords_of(used[s])):
                    i, j = paths.take()
                    yield distinct_pairs(ids[i], ids[j], inst[i] // paths.branches)
                for seed, rows in paths.groups:
                    name = mix(path[s : s + 1].view(U) ^ mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], dtype=U))).view(np.int64)
                    yield as_batch(a=ids[rows], path=np.repeat(name, len(rows)), inst=np.full(len(rows), TILED, dtype=np.int32))
                paths.groups = []
                if paths.held > HELD:
                    i, j = paths.take()
                    yield distinct_pairs(ids[i], ids[j], inst[i] // paths.branches)
            i, j = paths.take()
            yield distinct_pairs(ids[i], ids[j], inst[i] // paths.branches)

        def split(path, ids, sig, inst, used):
            sigs = [x.tobytes() for x in sig]
            if len(coords_of(used[0])) > levels:
                yield as_batch(a=ids, run=(inst // paths.branches).astype(np.int32), path=path, inst=np.full(len(ids), TILED, dtype=np.int32), sig=sigs, used=used)
                return
            rng = np.random.default_rng(int(path[0]) & 0x7FFFFFFFFFFFFFFF)
            free = np.setdiff1d(np.arange(firsts, COORDS), coords_of(used[0]))
            for c in rng.choice(free, min(paths.branches, len(free)), replace=False):
                new = mix(path.view(U) ^ mix(sig[:, c] + U(int(c) << 32)))
                yield as_batch(a=ids, path=new.view(np.int64), inst=inst.astype(np.int32), sig=sigs, used=used | np.int64(1) << np.int64(c))

        held, over = None, None
        for batch in batches:
            if not len(batch):
                continue
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), sig_matrix(batch.column(3)), batch.column(2).to_numpy(), batch.column(4).to_numpy()]
            if over is not None:
                n = int(np.searchsorted(new[0] != over, True))
                if n:
                    yield from split(*[x[:n] for x in new])
                if n == len(new[0]):
                    continue
                new, over = [x[n:] for x in new], None
            cols = new if held is None else [np.concatenate(p) for p in zip(held, new)]
            tail = len(cols[0]) - int(np.searchsorted(cols[0][::-1] != cols[0][-1], True))
            if tail:
                yield from whole(*[x[:tail] for x in cols])
            held = [x[tail:] for x in cols]
            if len(held[0]) > task_rows:
                yield from split(*held)
                over, held = held[0][-1], None
        if held is not None:
            yield from whole(*held)

    return run


def tile_pairs(threshold: float):
    """An applyInArrow function over one tile of a bucket: rows of side i with those of side j."""

    def run(table: pa.Table) -> pa.Table:
        paths = Paths(threshold, 0)
        ids, block = table.column("a").to_numpy(), table.column("block").to_numpy()
        sig = sig_matrix(table.column("sig").combine_chunks())
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for at in range(0, len(left), step := max(1, (1 << 19) // max(1, len(right)))):
            x, y = (z.ravel() for z in np.meshgrid(left[at : at + step], right, indexing="ij"))
            ok = x < y if i == j else slice(None)
            paths.compare(sig, x[ok], y[ok])
        i, j = paths.take()
        return pa.Table.from_batches([distinct_pairs(ids[i], ids[j], np.full(len(i), table.column("run")[0].as_py()))])

    return run


def gram_sets(texts, n: int) -> list[np.ndarray]:
    out = []
    for _, bounds, g, _ in grams(texts, n):
        out += [np.unique(g[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets, by products of incidence matrices of some thousand grams each."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    grams_ = np.concatenate(sets)[order]
    owner = np.repeat(np.arange(len(sets)), size)[order]
    col = np.cumsum(np.concatenate(([0], np.diff(grams_) != 0)))
    shared = np.bincount(col)[col] > 1
    owner, col = owner[shared], col[shared]
    out = np.diag(size.astype(np.float64))
    np.fill_diagonal(out, 0)
    if len(col):
        col = np.cumsum(np.concatenate(([0], np.diff(col) != 0)))
        step = min(int(col[-1]) + 1, max(256, (1 << 22) // len(sets)))  # most tiles have few texts, and few grams in common
        for at in range(0, int(col[-1]) + 1, step):
            lo, hi = np.searchsorted(col, [at, at + step])
            m = np.zeros((len(sets), step), dtype=np.float32)
            m[owner[lo:hi], col[lo:hi] - at] = 1
            out += m @ m.T
    return out


class Texts(NamedTuple):
    """known(doc_id, text): all documents; members(doc_id, rep, weight): the class of each text, by its least doc_id, and its size."""

    known: DataFrame
    members: DataFrame


def signed_texts(known: DataFrame, n: int, firsts: int, batch: int) -> DataFrame:
    return known.mapInArrow(signature_batches(n, firsts, batch), "doc_id long, h1 long, h2 long, words long, paths array<long>, sig binary")


def text_classes(signed: DataFrame) -> DataFrame:
    """(h1, h2, words, rep, weight, paths, sig) of each distinct text; repeated rows count once, and copies are combined before each shuffle."""
    first = [F.first("paths").alias("paths"), F.first("sig").alias("sig")]
    once = signed.groupBy("h1", "h2", "words", "doc_id").agg(*first)
    return once.groupBy("h1", "h2", "words").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), *first)


def candidates(classes: DataFrame, threshold: float, firsts: int, limit: int, task_rows: int, block: int, groups: list[DataFrame] | None = None) -> DataFrame:
    """(a, b, hits): pairs of texts that met in a bucket, and in how many runs.

    Given a list of groups, those of this batch (path, a) are added to it, and their pairs aren't listed.
    """
    todo = classes.select(F.posexplode("paths").alias("inst", "path"), F.col("rep").alias("a"), "sig").withColumn("used", F.expr("shiftleft(1L, inst)"))
    found, tiled, find = [], [], bucket_batches(threshold, limit, firsts, task_rows, grouped=groups is not None)
    while True:  # as often as buckets are sent on, that is levels times
        rows = todo.select("path", "a", "inst", "sig", "used").repartition("path").sortWithinPartitions("path")
        out = materialize(rows.mapInArrow(find, FOUND_TYPES), "candidates")
        found.append(out.filter("b is not null").select("a", "b", "run"))
        tiled.append(out.filter(F.col("inst") == TILED).select("path", "a", "run", "sig"))
        todo = out.filter(F.col("inst") != TILED).select("path", "a", "inst", "sig", "used")
        if not todo.limit(1).count():
            break
    tiles = reduce(DataFrame.union, tiled)
    if groups is not None:
        groups.append(tiles.select("path", "a").distinct())
        return met_pairs(found)
    sides = tiles.groupBy("path").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    mine = tiles.join(sides, "path").withColumn("block", F.pmod(F.xxhash64("a"), F.col("n")).cast("int"))
    both = mine.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")).select("path", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "a", "run", "sig")
    found.append(both.groupBy("path", "i", "j").applyInArrow(tile_pairs(threshold), FOUND_TYPES).select("a", "b", "run"))
    return met_pairs(found)


def met_pairs(found: list[DataFrame]) -> DataFrame:
    met = reduce(DataFrame.union, found).groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1L, run)")).alias("runs"))
    return materialize(met.select("a", "b", F.bit_count("runs").cast("int").alias("hits")), "pairs")


def missed(near: int, once: int, twice: int, runs: int) -> float:
    """The share of pairs that no run found, by Chao's estimate from those that one run and two runs found."""
    unseen = (runs - 1) / runs * once * max(0, once - 1) / (2 * (twice + 1))
    return unseen / max(1.0, near + unseen)


def similar_texts(
    docs: DataFrame, threshold: float, n: int, target_recall: float, runs: int, limit: int, task_rows: int, block: int = 4096, pairs: bool = False
) -> tuple[Texts, DataFrame]:
    """Classes of texts, and what tiles of verified pairs report (see verified). Batches of runs follow until the target is reached."""
    branches = max(1, round(1 / threshold))
    firsts = runs * branches
    if firsts > COORDS // 2:
        raise ValueError("runs of one batch take at most half of the coordinates")
    known = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    signed = materialize(signed_texts(known, n, firsts, 0), "signatures")
    classes = materialize(text_classes(signed), "classes")
    key = ["h1", "h2", "words"]
    members = signed.select("doc_id", *key).distinct().join(classes.select(*key, "rep", "weight"), key).select("doc_id", "rep", "weight")
    members = materialize(members, "members")
    length = classes.groupBy(F.col("rep").alias("a")).agg(F.sum("words").alias("words"))
    met, batch, groups = None, 0, []
    while True:
        new = candidates(classes, threshold, firsts, limit, task_rows, block, groups)
        met = new if met is None else met.union(new).groupBy("a", "b").agg(F.sum("hits").cast("int").alias("hits"))
        grouped = materialize(reduce(DataFrame.union, groups), "groups")
        if grouped.limit(1).count():
            placed, meet = clumps(grouped, length)
            out = verified(known, members, outside(met, placed, meet), threshold, n, pairs).union(verified_clumps(known, members, placed, meet, threshold, n, pairs))
        else:
            out = verified(known, members, met, threshold, n, pairs)
        out = materialize(out, "verified")
        batch += 1
        near, once, twice = out.filter("near is not null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("near", "once", "twice")]).first()
        if missed(near, once, twice, runs * batch) <= 1 - target_recall:
            return Texts(known, members), out
        classes = materialize(text_classes(signed_texts(known, n, firsts, batch)), "classes")


#: What a tile reports: a document's links, an edge of a spanning forest, how often runs met pairs near the threshold, a pair.
REPORT = pa.schema([(c, pa.int64()) for c in ("a", "links", "p", "q", "near", "once", "twice", "x", "y")] + [("jaccard", pa.float64())])
REPORT_TYPES = ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'long'}" for f in REPORT)


def report(**columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in REPORT], schema=REPORT)


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number connected to each of n."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(known: DataFrame, members: DataFrame, cand: DataFrame, threshold: float, n: int, pairs: bool, side: int = 192) -> DataFrame:
    """Exact similarities of candidate pairs (a, b, hits), as rows of REPORT: each tile sums up its own pairs.

    Pairs go to cells by their documents' least neighbour, which copies of one text have in common, and a large
    cell is cut into blocks of about side by side documents; so a text is sent few times, not once a pair, and a tile
    gives as many rows as it has documents. With pairs, each similar pair is a row (x, y, jaccard) besides.
    """
    both = cand.select("a", "b").union(cand.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("cell"))
    celled = cand.join(near, "a")
    sides = celled.groupBy("cell").agg(F.ceil(F.sqrt(2.0 * F.count("*")) / side).alias("s"))
    i, j = F.pmod(F.xxhash64("a"), F.col("s")), F.pmod(F.xxhash64("b"), F.col("s"))
    tiled = materialize(celled.join(sides, "cell").select("cell", F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), "a", "b", "hits"), "tiles")
    wanted = tiled.select(F.col("cell").alias("c"), F.col("i").alias("ci"), F.col("j").alias("cj"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    weight = members.filter("doc_id = rep").groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    texts = wanted.hint("merge").join(weight.hint("merge"), "doc_id").join(known, "doc_id")  # the same plan at every size

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, hits = (left.column(c).to_numpy() for c in ("a", "b", "hits"))
        ids, weights = right.column("doc_id").to_numpy(), right.column("weight").to_numpy()
        if not len(a) or not len(ids):
            return REPORT.empty_table()
        sets = gram_sets(right.column("text"), n)
        uniq, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
        both = overlaps(sets)
        size = np.array([len(s) for s in sets], dtype=float)
        x, y = np.searchsorted(uniq, a), np.searchsorted(uniq, b)
        if len(uniq) == len(ids):
            p, q = first[x], first[y]
            score = both[p, q] / (size[p] + size[q] - both[p, q])
        else:  # rows that repeat an id: the most similar texts count
            rows = [np.flatnonzero(inverse == k) for k in range(len(uniq))]
            score = np.array([max(both[p, q] / max(1.0, size[p] + size[q] - both[p, q]) for p in rows[u] for q in rows[v]) for u, v in zip(x, y)])
        ok = score >= threshold
        if not ok.any():
            return REPORT.empty_table()
        x, y, hits, score = x[ok], y[ok], hits[ok], score[ok]
        weights = weights[first]
        links = np.bincount(x, weights[y], len(uniq)) + np.bincount(y, weights[x], len(uniq))
        label = forest(len(uniq), x, y)
        some, child = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(uniq)))
        edge = hits[score < threshold + 0.1]
        parts = [report(a=uniq[some], links=links[some].astype(np.int64)), report(p=uniq[label[child]], q=uniq[child]), report(near=[len(edge)], once=[int((edge == 1).sum())], twice=[int((edge == 2).sum())])]
        if pairs:
            parts.append(report(x=a[ok], y=b[ok], jaccard=score))
        del sets, both
        give_back()
        return pa.concat_tables(parts)

    return tiled.groupBy("cell", "i", "j").cogroup(texts.groupBy("c", "ci", "cj")).applyInArrow(check, REPORT_TYPES)


def clumps(groups: DataFrame, length: DataFrame, side: int = 1024, block_words: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """placed(a, clump, block): each text of a group in one clump, by the least text of any of its groups; meet(c, d, nc, nd): clumps
    of one group, c <= d, and how many blocks they have, of about side texts and block_words words at most.

    All pairs of the texts of two clumps that meet are compared, so all pairs of a group are, and each once.
    """
    least = groups.groupBy("path").agg(F.min("a").alias("least"))
    own = groups.join(least, "path").groupBy("a").agg(F.min("least").alias("clump"))
    own = materialize(own.join(length, "a"), "clumps")
    sides = own.groupBy("clump").agg(F.ceil(F.greatest(F.count("*") / side, F.sum("words") / block_words)).cast("int").alias("n"))
    placed = materialize(own.join(sides, "clump").select("a", "clump", F.pmod(F.xxhash64("a"), F.col("n")).cast("int").alias("block"), "n"), "placed")
    inside = groups.join(placed, "a").select("path", "clump", "n").distinct()
    c, d = inside.select("path", F.col("clump").alias("c"), F.col("n").alias("nc")), inside.select("path", F.col("clump").alias("d"), F.col("n").alias("nd"))
    return placed, materialize(c.join(d, "path").filter("c <= d").select("c", "d", "nc", "nd").distinct(), "meet")


def outside(met: DataFrame, placed: DataFrame, meet: DataFrame) -> DataFrame:
    """The pairs of met that clumps don't have."""
    a, b = placed.select("a", F.col("clump").alias("ca")), placed.select(F.col("a").alias("b"), F.col("clump").alias("cb"))
    both = met.join(a, "a", "left").join(b, "b", "left").withColumns({"c": F.least("ca", "cb"), "d": F.greatest("ca", "cb")})
    both = both.withColumns({c: F.when(F.col("ca").isNotNull() & F.col("cb").isNotNull(), F.col(c)) for c in ("c", "d")})
    return both.join(meet.select("c", "d"), ["c", "d"], "left_anti").select("a", "b", "hits")


def overlaps_between(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one: grams of few sets pair by pair, others by products of incidence matrices."""
    n, m = len(left), len(right)
    out = np.zeros((n, m), dtype=np.float32)
    owned = []
    every = [np.concatenate(sets) for sets in (left, right)]
    common = np.intersect1d(*every)
    if not len(common):
        return out
    for sets, g in zip((left, right), every):
        at = np.searchsorted(common, g)
        at[at == len(common)] = 0
        ok = common[at] == g
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[ok]
        order = np.argsort(at[ok], kind="stable")
        count = np.bincount(at[ok], minlength=len(common))
        owned.append((owner[order], np.cumsum(count) - count, count))
    (lo, ls, lc), (ro, rs, rc) = owned
    size = lc * rc
    thin = np.flatnonzero(size * 64 < n * m)
    for k in np.split(thin, np.flatnonzero(np.diff(np.cumsum(size[thin]) >> 21)) + 1):
        of = np.repeat(k, size[k])
        i = np.arange(len(of)) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
        pair = lo[ls[of] + i // rc[of]] * np.int64(m) + ro[rs[of] + i % rc[of]]
        out += np.bincount(pair, minlength=n * m).reshape(n, m)
    wide = np.flatnonzero(size * 64 >= n * m)
    for k in range(0, len(wide), 1024):
        some = wide[k : k + 1024]
        matrices = []
        for rows, (owner, start, count) in zip((n, m), owned):
            col = np.repeat(np.arange(len(some)), count[some])
            i = np.arange(len(col)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            x = np.zeros((rows, len(some)), dtype=np.float32)
            x[owner[start[some][col] + i], col] = 1
            matrices.append(x)
        out += matrices[0] @ matrices[1].T
    return out


def verified_clumps(known: DataFrame, members: DataFrame, placed: DataFrame, meet: DataFrame, threshold: float, n: int, pairs: bool) -> DataFrame:
    """Exact similarities of all pairs of clumps that meet, block by block, as rows of REPORT like those of verified; a text is sent once for each block it meets.

    Runs don't count here: nothing is missed.
    """
    at, blocks_of = placed.select(F.col("a").alias("doc_id"), "clump", "block"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = meet.join(at.withColumnRenamed("clump", "c"), "c").select("c", "d", F.col("block").alias("i"), blocks_of("nd").alias("j"), "doc_id", F.lit(0).alias("side"))
    right = meet.join(at.withColumnRenamed("clump", "d"), "d").select("c", "d", blocks_of("nc").alias("i"), F.col("block").alias("j"), "doc_id", F.lit(1).alias("side"))
    wanted = left.filter("c < d or i <= j").union(right.filter("c < d or i < j"))
    weight = members.filter("doc_id = rep").groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    texts = wanted.hint("merge").join(weight.hint("merge"), "doc_id").join(known, "doc_id")

    def check(table: pa.Table) -> pa.Table:
        alone = table.column("c")[0].as_py() == table.column("d")[0].as_py() and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sides = []
        for side in (0,) if alone else (0, 1):
            mine = table.filter(pa.compute.equal(table.column("side"), side)).sort_by("doc_id")
            uniq, first = np.unique(mine.column("doc_id").to_numpy(), return_index=True)
            sides.append((uniq, first, mine.column("weight").to_numpy()[first], gram_sets(mine.column("text"), n)))
        (a, first_a, weight_a, left), (b, first_b, weight_b, right) = sides[0], sides[-1]
        if not len(a) or not len(b):
            return REPORT.empty_table()
        score = overlaps_between(left, right).astype(np.float64)
        score /= np.maximum(1.0, np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - score)
        if len(a) < len(left):  # rows that repeat an id: the most similar texts count
            score = np.maximum.reduceat(score, first_a, axis=0)
        if len(b) < len(right):
            score = np.maximum.reduceat(score, first_b, axis=1)
        if alone:
            np.fill_diagonal(score, 0)
        ok = score >= threshold
        x, y = np.nonzero(np.triu(ok) if alone else ok)
        if not len(x):
            return REPORT.empty_table()
        ids, links, y_at = a, ok @ weight_b, y
        if not alone:
            ids, links, y_at = np.concatenate((a, b)), np.concatenate((links, weight_a @ ok)), y + len(a)
        order = np.argsort(ids)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        ids, links = ids[order], links[order]
        label = forest(len(ids), rank[x], rank[y_at])
        some, child = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
        parts = [report(a=ids[some], links=links[some].astype(np.int64)), report(p=ids[label[child]], q=ids[child])]
        if pairs:
            parts.append(report(x=np.minimum(a[x], b[y]), y=np.maximum(a[x], b[y]), jaccard=score[x, y]))
        del sides, left, right, score, ok
        give_back()
        return pa.concat_tables(parts)

    return texts.groupBy("c", "d", "i", "j").applyInArrow(check, REPORT_TYPES)


def linked(texts: Texts, out: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) of the documents that have a copy or are similar to another one."""
    reps = texts.members.select("doc_id", "rep")
    several = reps.groupBy("doc_id").agg(F.min("rep").alias("p"), F.max("rep").alias("q")).filter("p <> q")  # texts of one id
    edges = out.filter("p is not null").select(F.col("p").alias("a"), F.col("q").alias("b")).union(reps.join(several.select("doc_id", "p"), "doc_id").filter("p <> rep").select("p", "rep"))
    labels = components(materialize(edges, "similar")).select(F.col("id").alias("rep"), "label")
    links = out.filter("a is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    each = texts.members.join(links, "rep", "left").join(labels, "rep", "left").filter("weight > 1 or links is not null or label is not null")
    each = each.select("doc_id", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return each.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def jaccard_join(docs: DataFrame, threshold: float = 0.5, n: int = 3, target_recall: float = 0.98, runs: int = 6, limit: int = 64, task_rows: int = 20_000) -> DataFrame:
    """Documents whose sets of word n-grams have a Jaccard similarity of at least threshold with another's.

    Sets are embedded by MinHash in 64 coordinates. Each run splits all sets on 1/threshold of them, in a
    shuffle; a bucket of up to limit sets is compared pair by pair, a larger one splits on by further sampled
    coordinates, within its task or, above task_rows, over the cluster, and a set that is like its whole bucket is compared with all of it.
    Buckets that don't get smaller are compared in tiles. Candidates are verified on the full sets, so each link is exact.

    Runs come in batches with hash functions of their own, until the pairs just above the threshold (up to 0.1) that no run found are at most
    1 - target_recall by Chao's estimate, which takes how many pairs were found by one run and by two. Pairs that
    are more similar are missed less. A sketch of one byte a coordinate loses another 0.1 % at the threshold.

    Returns one row for each document that has a link: doc_id, class_id (the least doc_id of all that links connect it with),
    n_links (documents that are similar to it; those with the same words in the same order count too). A document without a row has no link.
    jaccard_pairs gives the pairs. Words are runs of ASCII letters, digits, underscores and non-ASCII characters, in lower case.
    A text of fewer than n words is one gram; one without words, a null text or a null doc_id has no link.
    Repeated rows count once; rows that repeat a doc_id with other texts are one document, which has the links of each.
    An empty table gives no rows. Other columns are ignored.
    """
    return linked(*similar_texts(docs, threshold, n, target_recall, runs, limit, task_rows))


def jaccard_pairs(docs: DataFrame, threshold: float = 0.5, n: int = 3, target_recall: float = 0.98, runs: int = 6, limit: int = 64, task_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """The links of jaccard_join as pairs(doc_a, doc_b, jaccard) of different texts' least ids, doc_a < doc_b, and members(doc_id, rep).

    Of an id that has several texts the most similar count, and none with itself.
    """
    texts, out = similar_texts(docs, threshold, n, target_recall, runs, limit, task_rows, pairs=True)
    return out.filter("x is not null").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"), "jaccard"), texts.members.select("doc_id", "rep")


def keep_one(docs: DataFrame, threshold: float = 0.5, n: int = 3, target_recall: float = 0.98, runs: int = 6, limit: int = 64, task_rows: int = 20_000) -> DataFrame:
    """The rows of docs without near copies: of each group that similarity connects, the least doc_id stays.

    Columns as in docs. What jaccard_join doesn't link stays, nulls included; rows that repeat a doc_id stay or go together.
    """
    gone = jaccard_join(docs, threshold, n, target_recall, runs, limit, task_rows).filter("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id and n_links of the documents that are similar to others."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
