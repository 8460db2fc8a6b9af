import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from termloom.llm import bpe, jaccard, line_quality, line_spread, packing, sharding, substrings, toxicity
from tests.llm import fixtures as fx


def normal(line):
    return re.sub(r"[\t-\r ]+", " ", line).strip(" ").lower()


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def spread_by_hand(rows, min_sites):
    sites, first = defaultdict(set), {}
    for d, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if n := normal(line):
                if s is not None:
                    sites[n].add(s)
                if d is not None:
                    first[n] = min(first.get(n, d), d)
    out = []
    for d, t, lang, s, n in rows:
        if t is None:
            continue
        kept = "\n".join(x for x in t.split("\n") if not normal(x) or len(sites[normal(x)]) < min_sites or d == first.get(normal(x)))
        if re.search(r"\S", kept):
            out.append((d, kept, lang, s, n))
    return out


@pytest.mark.parametrize("min_sites", [2, 7, 10])
def test_line_spread(spark, min_sites):
    rows = fx.awkward()
    got = line_spread.site_spread_dedup(fx.frame(spark, rows), min_sites).collect()
    same([tuple(r) for r in got], spread_by_hand(rows, min_sites))


@pytest.mark.parametrize("max_docs", [1, 2, 20])
def test_line_quality(spark, max_docs):
    rows = fx.awkward()
    docs = defaultdict(set)
    for d, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            docs[s, normal(line)].add(d)
    want = []
    for d, t, _, s, _ in rows:
        # repeated rows of an id drop what any of them drops
        if t is None:
            continue
        gone = {normal(x) for q in rows if q[0] == d and q[3] == s for x in (q[1] or "").split("\n") if normal(x) and len(docs[s, normal(x)]) > max_docs}
        kept = "\n".join(x for x in t.split("\n") if normal(x) not in gone)
        if re.search(r"\S", kept) and len(kept) >= 0.3 * len(t):
            want.append((d, kept, len(gone)))
    got = line_quality.line_frequency_rule(fx.frame(spark, rows), max_docs).select("doc_id", "text", "n_removed").collect()
    same([tuple(r) for r in got], want)


def pairs_of(spark, rows, **how):
    """{(a, b): jaccard} of all documents, from the pairs of texts and their members."""
    pairs, members = jaccard.jaccard_pairs(fx.frame(spark, rows), **how)
    of, got = defaultdict(set), {}
    for r in members.collect():
        of[r["rep"]].add(r["doc_id"])
    found = [(r["doc_a"], r["doc_b"], r["jaccard"]) for r in pairs.collect()]
    assert all(a < b for a, b, _ in found) and len({(a, b) for a, b, _ in found}) == len(found)
    for a, b, j in found + [(r, r, 1.0) for r in of]:
        got |= {(min(x, y), max(x, y)): j for x in of[a] for y in of[b] if x != y}
    return got


def links_by_hand(pairs):
    """{doc: (class, links)} of pairs."""
    parent, links = {}, Counter(x for p in pairs for x in p)

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {d: (root(d), n) for d, n in links.items()}


def similar_rows():
    more = fx.documents(seed=8, n=50)
    return fx.awkward() + [(1000 + r[0], r[1] + " tail", *r[2:]) for r in more] + [(2000 + r[0], "head " + r[1], *r[2:]) for r in more]


@pytest.mark.parametrize("how", [{}, {"task_rows": 10, "limit": 4}])
def test_jaccard_join_equals_brute_force(spark, how):
    rows = similar_rows()
    want = fx.jaccard_pairs(rows, 0.5)
    got = pairs_of(spark, rows, **how)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and len(want) > 60
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)
    rows_out = jaccard.jaccard_join(fx.frame(spark, rows), **how).collect()
    assert len({r["doc_id"] for r in rows_out}) == len(rows_out)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows_out} == links_by_hand(got)


def test_texts_of_one_id_are_one_document(spark):
    a, b = " ".join(fx.words(60, 1)), " ".join(fx.words(60, 2))
    rows = [(1, a, "en", "s", 1), (2, a + " x", "en", "s", 1), (3, a, "en", "s", 1), (3, b, "en", "s", 1), (4, b + " y", "en", "s", 1), (5, "other words here", "en", "s", 1)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(fx.frame(spark, rows)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 3), 4: (1, 1)}


def test_jaccard_join_of_one_large_group(spark):
    rows = [(i, " ".join(fx.words(200, 1)[: 150 + i % 50]), "en", "s", 1) for i in range(400)]
    want = fx.jaccard_pairs(rows, 0.5)
    got = pairs_of(spark, rows, limit=16, task_rows=90)
    assert set(got) == set(want)


def test_a_large_group_of_near_copies_is_not_written_as_pairs(spark, monkeypatch):
    """600 near copies have 179,700 pairs; what is written on the way grows with the texts. Links and classes stay whole."""
    plain, written = jaccard.materialize, {}

    def counted(df, name):
        out = plain(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    rows = [(i, " ".join(fx.words(200, 1)[: 140 + i % 60] + [f"own{i}"] + fx.words(9, 2 + i % 7)), "en", "s", 1) for i in range(600)]
    rows += [(1000 + i, " ".join(fx.words(150, 100 + i // 2, 10**6) + [f"own{i}"]), "en", "s", 1) for i in range(40)]
    want = links_by_hand(fx.jaccard_pairs(rows, 0.5))
    assert sum(n for _, n in want.values()) > 300_000
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(fx.frame(spark, rows)).collect()}
    assert got == want
    assert all(written[name] < 100_000 for name in ("candidates", "pairs", "tiles", "groups"))


@pytest.mark.parametrize("block_sets", [(7, 5), (200, 180)])
def test_overlaps_between_equal_set_intersections(block_sets):
    import numpy as np

    rng = np.random.default_rng(5)
    left, right = ([np.unique(rng.zipf(1.3, 80).astype(np.uint64)) for _ in range(k)] for k in block_sets)
    got = jaccard.overlaps_between(left, [*right, np.empty(0, np.uint64)])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in right] + [0] for x in left]


def test_overlaps_of_few_texts_take_little_room():
    """Most tiles have two texts; their matrix once had two million columns."""
    import tracemalloc

    import numpy as np

    sets = [np.arange(500, dtype=np.uint64), np.arange(100, 700, dtype=np.uint64)]
    tracemalloc.start()
    try:
        assert jaccard.overlaps(sets)[0, 1] == 400
        assert tracemalloc.get_traced_memory()[1] < 1_000_000
    finally:
        tracemalloc.stop()


def test_a_bucket_of_equal_signatures_goes_to_tiles(spark):
    """Splits can't make it smaller: it must end, and keep each pair."""
    same_start = fx.words(3_000, 1, 10**6)
    rows = [(i, " ".join(same_start + [f"own{i}"]), "en", "s", 1) for i in range(60)]
    texts = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.large_string())], names=["doc_id", "text"])
    signed = pa.Table.from_batches(list(jaccard.signature_batches(3, 12)(iter([texts]))))
    assert len(set(signed.column("sig").to_pylist())) < 5
    classes = spark.createDataFrame(signed.select(["doc_id", "paths", "sig"]).to_pandas()).withColumnRenamed("doc_id", "rep")
    got = {(r["a"], r["b"]) for r in jaccard.candidates(classes, 0.5, 12, 4, 10, 7).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60)}


def test_runs_repeat_until_the_target_recall(spark, monkeypatch):
    """One run an attempt finds too little; batches follow until the estimate is met."""
    rows = template_group(60, 5, 58, 9, 32)
    batches = []
    plain = jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda *a, **k: batches.append(1) or plain(*a, **k))
    want = {(k, k + 1) for k in range(0, len(rows), 2)}
    found = set(pairs_of(spark, rows, runs=2, limit=8, target_recall=0.97))
    assert found <= want and len(found) >= 0.95 * len(want) and len(batches) > 1


def test_estimate_of_missed_pairs():
    assert jaccard.missed(0, 0, 0, 6) == 0 and jaccard.missed(100, 0, 5, 6) == 0
    rng = random.Random(3)
    hits = [h for h in (sum(rng.random() < 0.35 for _ in range(6)) for _ in range(20_000)) if h]
    assert abs(jaccard.missed(len(hits), hits.count(1), hits.count(2), 6) - 0.65**6) < 0.02


def test_sketch_loses_one_in_a_thousand():
    from math import comb

    for t in (0.3, 0.5, 0.8):
        k = jaccard.least_equal(t, 0.001)
        assert sum(comb(64, i) * t**i * (1 - t) ** (64 - i) for i in range(k)) <= 0.001 < sum(comb(64, i) * t**i * (1 - t) ** (64 - i) for i in range(k + 1))


def template_group(pairs, seed, template, pair, own):
    """Rows 2p and 2p + 1 share a template and words of their own pair; all others share the template only."""
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    common, rows = some(template), []
    for p in range(pairs):
        both = common + some(pair)
        rows += [(2 * p + k, " ".join(both + some(own)), "en", "s", 1) for k in range(2)]
    return rows


def test_jaccard_join_keeps_pairs_of_a_bucket_that_is_sent_on(spark):
    rows = template_group(300, 1, 58, 9, 32)
    want = fx.jaccard_pairs([r for r in rows if r[0] < 10], 0.5)
    assert set(want) == {(k, k + 1) for k in range(0, 10, 2)} and max(want.values()) < 0.55
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        got = set(pairs_of(spark, rows, limit=16, task_rows=60))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got <= {(k, k + 1) for k in range(0, len(rows), 2)} and 2 * len(got) / len(rows) >= 0.97


def test_large_buckets_keep_pairs_that_earlier_ones_may_have_split():
    rows = template_group(1000, 1, 52, 16, 34)
    texts = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.large_string())], names=["doc_id", "text"])
    signed = pa.Table.from_batches(list(jaccard.signature_batches(3, 12)(iter([texts]))))
    keys = sorted((path, a, inst, sig, 1 << inst) for a, ps, sig in zip(*(signed.column(c).to_pylist() for c in ("doc_id", "paths", "sig"))) for inst, path in enumerate(ps))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keys), types)], names=["path", "a", "inst", "sig", "used"])
    out = [o.to_pydict() for o in jaccard.bucket_batches(0.5, 8, 12, 200_000)(iter([batch]))]
    got = {p for o in out for p in zip(o["a"], o["b"])}
    assert sum((k, k + 1) in got for k in range(0, len(rows), 2)) >= 0.975 * len(rows) / 2


def test_keep_one_keeps_the_least_of_each_group(spark):
    rows = fx.awkward()
    label = links_by_hand(fx.jaccard_pairs(rows, 0.5))
    want = [r for r in rows if label.get(r[0], (r[0], 0))[0] == r[0]]
    same([tuple(r) for r in jaccard.keep_one(fx.frame(spark, rows)).collect()], want)


@pytest.mark.parametrize("chunk_chars", [8_000_000, 3_000])
def test_repeated_spans(spark, chunk_chars):
    rows = fx.awkward()
    want = fx.repeated_words(rows, 20)
    got = substrings.repeated_spans(fx.frame(spark, rows), 20, chunk_chars, 2_000).collect()
    by_doc, texts = defaultdict(set), defaultdict(set)
    for i, w in want:
        by_doc[rows[i][0]].add(w)
    for r in rows:
        texts[r[0]].add(r[1])
    mine = defaultdict(set)
    for r in got:
        mine[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
        cut = [t.encode()[r["start_byte"] : r["end_byte"]].decode().split() for t in texts[r["doc_id"]] if t]
        assert any(len(c) == r["n_words"] for c in cut)
    assert mine == by_doc and want


def test_windows_of_equal_hashes_but_other_checks_are_different():
    """A chance match of the first hash alone isn't a repeat."""
    import numpy as np

    cell = lambda chunk, h, c: substrings.cells(chunk, np.array(h, np.uint64), np.empty(0, np.uint64), 1, 64, np.array(c, np.uint64))
    table = pa.concat_tables([cell(0, [5, 7, 9], [1, 2, 3]), cell(1, [5, 7, 7], [1, 4, 2]), cell(2, [7, 9], [6, 8])])
    out = {r["part_chunk"]: r for r in substrings.repeated(table, False).to_pylist()}
    hashes = {k: substrings.unpack(r["hashes"]).tolist() for k, r in out.items()}
    assert hashes == {0: [5, 7], 1: [5, 7]} and substrings.unpack(out[1]["later"]).tolist() == [5, 7] and not out[0]["later"]
    assert np.frombuffer(out[1]["checks"], np.uint64).tolist() == [1, 2]


def test_remove_repeats_leaves_one_copy(spark):
    rows = fx.awkward()
    left = [tuple(r) for r in substrings.remove_repeats(fx.frame(spark, rows), 20, 5_000, 2_000).collect()]
    assert not fx.repeated_words(left, 20)
    windows = lambda rs: {tuple(w[k : k + 20]) for r in rs if r[1] for w in [r[1].split()] for k in range(len(w) - 19)}
    clean = {r[0] for i, r in enumerate(rows) if not any(j == i for j, _ in fx.repeated_words(rows, 20))}
    assert {r[0] for r in left} >= clean
    passage = tuple(fx.words(70, 999)[:20])
    assert passage in windows(rows) and passage in windows(left)


def hand_pack(lengths, capacity):
    bins = []
    for n in lengths:
        open_ = [(b, i) for i, b in enumerate(bins) if b >= n]
        i = min(open_)[1] if open_ else len(bins)
        if not open_:
            bins.append(capacity)
        bins[i] -= n
        yield i


@pytest.mark.parametrize("capacity", [7, 100, 2048])
def test_best_fit_is_the_tightest(capacity):
    import random

    rng = random.Random(capacity)
    lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(800)), reverse=True)
    assert packing.best_fit(lengths, capacity) == list(hand_pack(lengths, capacity))


def test_pack_documents(spark):
    rows = fx.awkward()
    got = packing.pack_documents(fx.frame(spark, rows), 100, 1_000).collect()
    pieces = Counter()
    load = Counter()
    for r in got:
        pieces[r["doc_id"]] += r["length"]
        load[r["bin_id"]] += r["length"]
        assert 1 <= r["length"] <= 100 and r["start"] == 100 * r["piece"]
    want = Counter()
    for r in rows:
        if r[1] and r[1].split():
            want[r[0]] += len(r[1].split())
    assert pieces == want and max(load.values()) <= 100
    order = sorted(got, key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["piece"]))
    assert [r["bin_id"] for r in order] == list(hand_pack([r["length"] for r in order], 100))
    # shards are packed each by itself, with one bin at most that is half full or less, and hold what one packing holds
    many = packing.pack_documents(fx.frame(spark, rows), 100, 10).collect()
    shards = defaultdict(list)
    for r in sorted(many, key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["piece"])):
        shards[r["bin_id"] >> 32].append(r)
    assert len(shards) > 3
    for rows_of in shards.values():
        assert [r["bin_id"] & 0xFFFFFFFF for r in rows_of] == list(hand_pack([r["length"] for r in rows_of], 100))
        full = Counter()
        for r in rows_of:
            full[r["bin_id"]] += r["length"]
        assert sum(n <= 50 for n in full.values()) <= 1
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"])
    assert Counter(map(key, many)) == Counter(map(key, got))


def test_place_takes_the_highest_product():
    import numpy as np

    groups = np.array([[0.5, 0.1, 0.2], [0.5, 0.4, 0.2], [0.1, 0.5, 0.2], [0.3, 0.3, 0.3], [0.3, 0.3, 0.3]])
    left, want = np.ones((2, 3)), np.empty(5, dtype=int)
    for i in np.argsort(-groups.max(axis=1), kind="stable"):
        best = max((s for s in range(2) if (left[s] >= groups[i] - 1e-12).all()), key=lambda s: (left[s] @ groups[i], -s))
        want[i], left[best] = best, left[best] - groups[i]
    assert sharding.place(groups, 2).tolist() == want.tolist()


def test_sharding_balances(spark):
    rows = [r for r in fx.awkward() if len(r[1] or "") < 10_000] + [(3000 + i, " ".join(fx.words(80 + i % 7, i)), "en", "hot", 1) for i in range(400)]
    total = sum(len((r[1] or "").encode()) for r in rows)
    got = sharding.shard_documents(fx.frame(spark, rows), shard_bytes=total // 5, cell_shards=8).collect()
    same([(r["doc_id"], r["bytes"], r["tokens"]) for r in got], [(r[0], len((r[1] or "").encode()), len((r[1] or "").split())) for r in rows])
    for load in loads_of(got):
        assert len(load) == 5 and max(load.values()) < 1.15 * sum(load.values()) / 5


def loads_of(got):
    load = [Counter(), Counter(), Counter()]
    for r in got:
        for c, x in zip(load, (r["bytes"], r["tokens"], 1)):
            c[r["shard_id"]] += x
    return load


def test_cells_are_balanced_against_each_other(spark):
    """Sixty-four shards in four cells: as level as one packing of them all, which is that by hand, in every dimension."""
    import numpy as np

    rng = random.Random(1)
    rows = []
    for i in range(12_000):
        n = int(rng.paretovariate(1.5) * 10) % 400 + 1
        word = "x" if i % 3 else "longerword" * 3
        rows.append((i, " ".join([word] * n), "en", f"site{i % 900}" if i % 4 else "hot", 1))
    total = sum(len(r[1]) for r in rows)
    many = sharding.shard_documents(fx.frame(spark, rows), shard_bytes=total // 64, cell_shards=16).collect()
    one = sharding.shard_documents(fx.frame(spark, rows), shard_bytes=total // 64, cell_shards=100).collect()
    for a, b in zip(loads_of(many), loads_of(one)):
        assert len(a) == len(b) == 64
        # cells in use are four times as large, and so are the pieces that they differ by
        assert max(a.values()) <= 1.04 * sum(a.values()) / 64 and max(b.values()) <= 1.021 * sum(b.values()) / 64
    # one cell is the packing by hand of the same pieces
    by_doc = {r["doc_id"]: r for r in one}
    sizes = np.array([[by_doc[r[0]][d] for d in ("bytes", "tokens")] + [1] for r in rows], dtype=float)
    unit = sizes.sum(axis=0) / 64
    pieces = defaultdict(lambda: np.zeros(3))
    whole = defaultdict(lambda: np.zeros(3))
    for r, x in zip(rows, sizes):
        whole[r[3]] += x
    shard_of, n_parts = defaultdict(set), {g: max(1, int(np.ceil((x / unit).max() * 16 - 1e-9))) for g, x in whole.items()}
    hashed = {r["doc_id"]: r["h"] for r in fx.frame(spark, rows).selectExpr("doc_id", "xxhash64(doc_id, 7) as h").collect()}
    for r, x in zip(rows, sizes):
        key = (r[3], hashed[r[0]] % n_parts[r[3]])
        pieces[key] += x
        shard_of[key].add(by_doc[r[0]]["shard_id"])
    order = sorted(pieces)
    capacity = sizes.sum(axis=0) / 64 * 1.02
    want = dict(zip(order, sharding.place(np.array([pieces[k] / capacity for k in order]), 64).tolist()))
    assert len(order) > 1000 and sum(len(shard_of[k]) == 1 for k in order) == len(order)
    assert all(shard_of[k] == {want[k]} for k in order)


def merge_by_hand(word, ranks):
    """Byte-pair merges of one word: always the pair of the lowest rank, the first of equals."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_bpe_equals_plain_merges_and_round_trips(spark):
    import regex

    rows = fx.awkward() + [(200, "it's  a test\t\n\n don't 12345 <|endoftext|> ", "en", "s", 1), (201, "x" * 300, "en", "s", 1), (202, "ungewöhnlichste Überraschungen\u00a0\u2028 \u0301", "de", "s", 1)]
    ranks, pattern = bpe.read_pieces(bpe.VOCABULARY), regex.compile(bpe.PATTERN)
    known = {}

    def code(w):
        if w not in known:
            known[w] = merge_by_hand(w.encode(), ranks)
        return known[w]

    want = [(r[0], None if r[1] is None else [i for w in pattern.findall(r[1]) for i in code(w)], r[1]) for r in rows]
    df = fx.frame(spark, rows)
    small = dict(chunk_chars=4_000, part_chars=20_000)
    same([(r["doc_id"], r["ids"], r["text"]) for r in bpe.decode_documents(bpe.encode_documents(df, **small)).collect()], want)
    same([(r["doc_id"], r["ids"], r["text"]) for r in bpe.encode_documents(df, **small, decode=True).collect()], want)
    same([(r["doc_id"], r["ids"]) for r in bpe.encode_documents(df, **small, max_parts=2).collect()], [w[:2] for w in want])


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    """A part's words, of all chunks, against the number of calls of the encoder."""
    import tiktoken

    calls, plain = Counter(), tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, w: calls.update([w]) or plain(self, w))
    blobs = [[b"one", b"two"], [b"one", b"three"], [b"two"]]
    batch = pa.RecordBatch.from_arrays([pa.array([-1] * 3), pa.array([0, 1, 2]), pa.array([0] * 3, pa.int32()), pa.array([bpe.word_blob(b) for b in blobs])], names=["key", "chunk", "part", "data"])
    out = list(bpe.encode_part(bpe.PATTERN, bpe.VOCABULARY)(iter([batch])))
    assert len(out) == 3 and calls == {"one": 1, "two": 1, "three": 1}


def test_decoding_of_awkward_ids(spark):
    ranks = bpe.read_pieces(bpe.VOCABULARY)
    half = ranks["é".encode()[:1]]
    ids = spark.createDataFrame([(1, [ranks[b"a"], half]), (2, []), (3, None), (None, [ranks[b"a"]]), (2, [])], "doc_id long, ids array<int>").selectExpr("*", "'x' as text", "1 as a")
    same([tuple(r) for r in bpe.decode_documents(ids).select("doc_id", "text").collect()], [(1, "a\ufffd"), (2, ""), (3, None), (None, "a"), (2, "")])
    assert bpe.decode_documents(ids.limit(0)).collect() == []
    for bad in (10**6, -1):
        with pytest.raises(Exception, match="isn't in the vocabulary"):
            bpe.decode_documents(spark.createDataFrame([(1, [bad])], "doc_id long, ids array<int>")).collect()


def toxic_corpus(n=900):
    import random

    rng = random.Random(4)
    clean, bad = [f"plain{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)], ["foulword", "slurry", "vileness", "nastier", "hateful", "scumbag"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = rng.choices(clean, k=60)
        if toxic:
            for b in rng.sample(bad, 3):
                w.insert(rng.randrange(60), b)
        docs.append((i, " ".join(w), "en", "s", 1))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_unlabelled_documents(spark):
    docs, labels = toxic_corpus()
    marks = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(fx.frame(spark, docs + fx.awkward()[60:]), toxicity.toxic_lexicon(fx.frame(spark, docs), marks)).collect()
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 3 == 0]
    assert sum(r["is_toxic"] == (r["doc_id"] % 5 == 0) for r in held if r["doc_id"] not in (0,)) >= 0.97 * (len(held) - 1)
    assert all(r["toxicity"] == 0 and not r["is_toxic"] for r in out if not (r["text"] or "").strip())


def words_by_hand(text):
    """[(word, (word before, word after))] of the words of three letters or more, once each, where they come first."""
    found = re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())
    out = {}
    for i, w in enumerate(found):
        if len(w) >= 3:
            out.setdefault(w, (found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None))
    return out


def test_words_and_their_contexts():
    texts = ["An idiot, IDIOTS and fools9fools; an idiot", "", None, "ünïcödé ünï 漢字漢字漢字漢 ab abc", "one idiot and", "an idiot, idiots"]
    hashed, contexts, names = {}, defaultdict(set), set()
    base = 0
    for ws in toxicity.words_of(pa.array(texts, pa.large_string())):
        for k in range(len(ws.row)):
            text, word = texts[base + ws.row[k]], ws.name(k, 0)
            assert word in words_by_hand(text)
            names.add((base + ws.row[k], word))
            contexts[words_by_hand(text)[word]].add(int(ws.context[k]))
            for c, f in enumerate(toxicity.features(word)):
                column = 0 if not c else 1 + toxicity.STEMS.index(len(f) - 1)
                assert ws.name(k, column) == f and hashed.setdefault(f, int(ws.keys[k, column])) == int(ws.keys[k, column]) != 0
            assert (ws.keys[k] != 0).sum() == len(toxicity.features(word))
        base += len(ws.block.bounds) - 1
    assert names == {(i, w) for i, t in enumerate(texts) if t for w in words_by_hand(t)}
    assert all(len(c) == 1 for c in contexts.values()) and len({next(iter(c)) for c in contexts.values()}) == len(contexts)
    assert len(set(hashed.values())) == len(hashed)


def test_walk_weights_equal_those_of_dense_matrices():
    import numpy as np

    rng = np.random.default_rng(5)
    docs = rng.random((400, 12)) < np.linspace(0.1, 0.5, 12)
    docs[:60, :4] = True
    both = docs.T.astype(float) @ docs
    kinds = np.array([1, 1, 0, 0, 0, 0, 0, 0, 2, 2, 2, 2])
    graph = np.maximum(0, np.log(both * 400 / np.outer(np.diag(both), np.diag(both))))
    graph[8:, 8:] = 0
    np.fill_diagonal(graph, 0)
    root = np.sqrt(graph.sum(axis=1))
    want = []
    for k in (1, 2):
        start = np.where(kinds == k, np.diag(both), 0) / np.diag(both)[kinds == k].sum()
        p = start
        for _ in range(60):
            p = 0.85 * (graph / np.outer(root, root)) @ p + 0.15 * start
        want.append(p + 1e-9 / 12)
    i, j = np.array([(i, j) for i in range(12) for j in range(i, 12) if i == j or i < 8]).T
    got = toxicity.polarity(i, j, both[i, j], 400, kinds)
    assert np.allclose(got, np.log(want[0] / want[1])) and got[2] > got[5]


def test_counts_of_the_word_graph(spark):
    """Terms near seeds, and meetings of nodes, against plain sets; copies of a document count once."""
    import numpy as np

    docs, _ = toxic_corpus(200)
    docs += [(1000 + k, docs[5][1], "en", "s", 1) for k in range(40)]
    texts = pa.array([d[1] for d in docs], pa.large_string())
    key = {}
    for ws in toxicity.words_of(texts):
        for k in range(len(ws.row)):
            for c, f in enumerate(toxicity.features(ws.name(k, 0))):
                key[f] = ws.keys[k, 0 if not c else 1 + toxicity.STEMS.index(len(f) - 1)]
    seeds = np.sort(np.array([key["foulword"], key["slurry"]]))
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    got = defaultdict(set)
    for b in toxicity.near_seeds(seeds, np.zeros(0, np.uint64))(iter([batch])):
        for k, _, context, text in zip(*(c.to_numpy().view(np.uint64).tolist() for c in b.columns)):
            got[k].add((context, text))
    seeded = [d[1] for d in docs if {"foulword", "slurry"} & set(d[1].split())]
    want = defaultdict(set)
    for t in seeded:
        for w, around in words_by_hand(t).items():
            if w not in ("foulword", "slurry"):
                want[w].add((around, t))
    assert {int(key[w]): len(x) for w, x in want.items()} == {k: len(x) for k, x in got.items() if k in {int(key[w]) for w in want}}
    assert len(got[0]) == len(set(seeded)) and len(got[1]) == len({d[1] for d in docs})
    names = sorted(["foulword", "slurry", "hateful", "plainaa", "plainab"], key=lambda w: int(key[w]))
    nodes, clean = np.array([key[w] for w in names]), np.array([w.startswith("plain") for w in names])
    met, plain_counts, named = defaultdict(set), Counter(), {}
    for b in toxicity.meetings(nodes, clean)(iter([batch])):
        for i, j, context, n, name in zip(*(c.to_pylist() for c in b.columns)):
            met[names[i], names[j]].add(context)
            plain_counts[names[i]] += n
            if name:
                named[names[i]] = name
    assert named == {w: w for w in ("foulword", "slurry", "hateful")}
    for i in range(5):
        for j in range(i, 5):
            a, b = names[i], names[j]
            have = [words_by_hand(d[1]) for d in docs if a in d[1].split() and b in d[1].split()]
            if a == b and clean[i]:
                assert plain_counts[a] == len(have)
            elif not (clean[i] and clean[j]):
                assert len(met[a, b]) == len({(h[a], h[b]) for h in have}), (a, b)


def test_a_word_without_labels_is_induced(spark):
    docs, labels = toxic_corpus()
    docs = [(d, t + " newinsult" if d % 15 == 0 else t, *r) for d, t, *r in docs]
    assert not any(d % 15 == 0 for d, _, _ in labels)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.toxic_lexicon(fx.frame(spark, docs), marks)
    terms = {r["term"]: r["weight"] for r in lexicon.collect()}
    assert "newinsult" in terms and {"foulword", "scumbag"} <= set(terms) and not any(t.startswith("plain") for t in terms)
    # one document copied a hundred times makes none of its words toxic
    copied = docs + [(5000 + k, docs[5][1] + " harmlessa harmlessb", "en", "s", 1) for k in range(100)]
    assert not any(t.startswith(("plain", "harm")) for t in (r["term"] for r in toxicity.toxic_lexicon(fx.frame(spark, copied), marks).collect()))


def test_scores_by_hand(spark):
    rows = [("bad*", 2.0), ("badly", 3.0), ("other", 1.0)]
    texts = ["badly badness bad bad other", None, "", "nothing here", "badgers BADLY"]
    ws = next(toxicity.words_of(pa.array(["badly badness bad other badgers"])))
    key = {ws.name(k, 0 if c == 0 else c): int(ws.keys.view("int64")[k, c]) for k in range(len(ws.row)) for c in range(4) if ws.keys[k, c]}
    lexicon = spark.createDataFrame([(t, key.get(t, key.get("badl*") if t == "bad*" else None), w, 3.0) for t, w in rows], toxicity.LEXICON)
    out = toxicity.score_toxicity(fx.frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), lexicon).orderBy("doc_id").collect()
    # badl* stands in for bad*: beginnings have four letters or more
    assert [(r["toxicity"], r["is_toxic"]) for r in out] == [(4.0, True), (0.0, False), (0.0, False), (0.0, False), (3.0, True)]


def test_toxicity_without_labels_keeps_all(spark):
    docs = fx.frame(spark, fx.awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same([tuple(r) for r in toxicity.drop_toxic(docs, none).collect()], fx.awkward())


def labels_of(spark):
    return fx.with_clashes(spark.createDataFrame(toxic_corpus()[1], "doc_id long, quality int, toxic int"))


OPERATORS = {
    "sharding": lambda s, d: sharding.shard_documents(d),
    "line_quality": lambda s, d: line_quality.line_frequency_rule(d),
    "jaccard": lambda s, d: jaccard.jaccard_join(d),
    "lexicon": lambda s, d: toxicity.toxic_lexicon(d, labels_of(s)),
    "pairs": lambda s, d: jaccard.jaccard_pairs(d)[0],
    "keep_one": lambda s, d: jaccard.keep_one(d),
    "encode": lambda s, d: bpe.encode_documents(d),
    "spread": lambda s, d: line_spread.site_spread_dedup(d, 2),
    "packing": lambda s, d: packing.pack_documents(d),
    "toxic": lambda s, d: toxicity.drop_toxic(d, labels_of(s)),
    "spans": lambda s, d: substrings.repeated_spans(d, 20),
    "remove": lambda s, d: substrings.remove_repeats(d, 20),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, fx.frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    docs = fx.frame(spark, fx.awkward())
    plain, wide = OPERATORS[name](spark, docs), OPERATORS[name](spark, fx.with_clashes(docs))
    cols = [c for c in plain.columns if c != "n_removed" or name != "line_quality"]
    same([tuple(r[c] for c in cols) for r in plain.collect()], [tuple(r[c] for c in cols) for r in wide.collect()])
    if name in ("keep_one", "spread", "toxic", "remove"):
        assert wide.columns == fx.with_clashes(docs).columns
