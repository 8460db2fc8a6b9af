import json
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from termloom.llm import audio, chat
from tests.llm import fixtures as fx

U, A = ("user", "hi"), ("assistant", "yes")
LAYOUTS = {
    "messages": ({"messages": [{"role": " USER ", "content": "hi"}, {"content": "yes", "role": "gpt"}]}, [U, A]),
    "from_value": ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}], "system": "s"}, [("system", "s"), U, A]),
    "speaker_utterance": ({"dialog": {"turns": [{"speaker": {"role": "user"}, "utterance": {"text": "hi"}}]}}, [U]),
    "exchanges": ({"exchanges": [{"user": "hi", "assistant": "yes"}, {"user": "hi", "assistant": "yes"}]}, [U, A, U, A]),
    "prompt_response": ({"prompt": "hi", "response": "yes"}, [U, A]),
    "prompt_completion": ({"completion": "yes", "prompt": "hi", "system": "s"}, [("system", "s"), U, A]),
    "instruction": ({"instruction": "hi", "input": "there", "output": "yes"}, [("user", "hi\n\nthere"), A]),
    "question_answer": ({"question": "hi", "answer": 7}, [U, ("assistant", "7")]),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(spark, layout):
    record, want = LAYOUTS[layout]
    df = spark.createDataFrame([(1, json.dumps(record), "x")], "conv_id long, raw string, layout string")
    got = chat.canonical_turns(df).orderBy("turn").collect()
    assert {r["layout"] for r in got} == {layout}
    assert [(r["role"], r["text"]) for r in got] == want
    assert [r["turn"] for r in got] == list(range(len(want)))


def test_unmapped_null_empty_and_repeated_records(spark):
    rows = [(1, None), (2, ""), (3, "{not json"), (4, '{"other": 1}'), (5, '{"messages": []}'), (6, '{"prompt": "", "response": null}'), (None, '{"prompt": "a", "response": "b"}')]
    rows += [(7, '{"prompt": "%s", "response": "b"}' % ("long " * 50_000))] * 2
    got = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, raw string")).collect()
    by = Counter((r["conv_id"], r["layout"], r["role"]) for r in got)
    assert all(by[i, "unmapped", None] == 1 for i in (1, 2, 3, 4))
    assert [(r["role"], r["text"]) for r in got if r["conv_id"] == 6] == [("user", "")]
    assert by[None, "prompt_response", "user"] == 1 and by[7, "prompt_response", "user"] == 2
    assert chat.canonical_turns(spark.createDataFrame([], "conv_id long, raw string")).collect() == []


def test_turns_survive_their_layouts(spark):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"t{c}-{k}") for c in range(20) for k in range(1 + c % 5)]
    got = chat.canonical_turns(chat.raw_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in got) == Counter(rows)


def tune(seconds, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(audio.RATE // 4) / audio.RATE
    return np.concatenate([sum(np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in rng.choice(12, 3, replace=False)) for _ in range(seconds * 4)]) * 3000


def pcm(x):
    return x.astype("<i2").tobytes()


def test_areas_of_the_integral_image():
    rng = np.random.default_rng(1)
    image = rng.random((audio.WIDTH + 5, 12))
    got = audio.fingerprint(image)
    for i in range(6):
        w, bits = image[i : i + audio.WIDTH], 0
        for kind, y, h, n in audio.FILTERS:
            box = lambda a, b, c, d: w[a:b, c:d].sum()
            whole = box(0, n, y, y + h)
            if kind == 0 and h < 12:
                a, b = whole * (12 - h) / h, box(0, n, 0, 12) - whole
            elif kind == 0:
                a, b = box(n // 2, n, 0, 12), box(0, n // 2, 0, 12)
            elif kind in (1, 2, 3):
                a = {1: lambda: box(0, n, y + h // 2, y + h), 2: lambda: box(n // 2, n, y, y + h), 3: lambda: box(0, n // 2, y, y + h // 2) + box(n // 2, n, y + h // 2, y + h)}[kind]()
                b = whole - a
            else:
                part = box(0, n, y + h // 3, y + 2 * h // 3) if kind == 4 else box(n // 3, 2 * n // 3, y, y + h)
                a, b = 2 * part, whole - part
            level = np.log1p(a) - np.log1p(b)
            bits = bits << 2 | [0, 1, 3, 2][int(np.searchsorted([-0.15, 0.0, 0.15], level))]
        assert bits == int(got[i])


def test_shifted_and_noisy_recordings_align(spark):
    rng = np.random.default_rng(2)
    a, other = tune(20, 1), tune(20, 9)
    shift = 20 * audio.HOP
    rows = [(1, pcm(a)), (2, pcm(a[shift:])), (3, pcm(a + rng.normal(0, 30, len(a)))), (4, pcm(other)), (5, None), (6, b""), (7, b"\x01"), (8, pcm(np.zeros(200_000))), (9, pcm(np.zeros(200_000))), (None, pcm(a)), (1, pcm(a))]
    df = spark.createDataFrame(rows, "id long, pcm binary")
    prints = audio.fingerprint_media(df, "id", "pcm")
    got = {r["id"]: r["fp"] for r in prints.collect()}
    assert got[5] is None and got[6] == [] and got[7] == []
    assert got[1] == audio.fingerprint(audio.chroma(np.frombuffer(pcm(a), "<i2") / 32768)).tolist()
    pairs = {(r["query_id"], r["id"]): r["offset"] for r in audio.align_media(prints, prints).collect()}
    assert pairs == {(1, 2): -20, (2, 1): 20, (1, 3): 0, (3, 1): 0, (2, 3): 20, (3, 2): -20}
    none = audio.fingerprint_media(spark.createDataFrame([], "id long, pcm binary"), "id", "pcm")
    assert none.collect() == [] and audio.align_media(none, prints).collect() == [] and audio.align_media(prints, none).collect() == []
    wide = df.selectExpr("*", *[f"1 as {c}" for c in ("fp", "query_id", "votes", "offset", "value", "key", "g")])
    assert Counter(str(r) for r in audio.fingerprint_media(wide, "id", "pcm").collect()) == Counter(str(r) for r in prints.collect())


def alignments_by_hand(queries, prints, max_error, min_overlap):
    """{(query, id): least error over all offsets} of all pairs."""
    out = {}
    for q, a in queries.items():
        for r, b in prints.items():
            best = 1.0
            for offset in range(-len(a), len(b)):
                x, y = max(0, -offset), max(0, offset)
                n = min(len(a) - x, len(b) - y)
                if n >= min_overlap:
                    best = min(best, audio.bit_errors(np.array(a[x : x + n]), np.array(b[y : y + n])))
            if q != r and best <= max_error:
                out[q, r] = best
    return out


def test_noisy_copies_against_all_pairs_and_offsets(spark):
    """Copies with up to a fifth of their bits wrong are found as by brute force."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(12):
        clean = tune(8, 100 + k)
        rows.append((100 * k, clean))
        for m in range(1, 7):
            start = int(rng.integers(0, 8)) * audio.HOP
            rows.append((100 * k + m, clean[start:] + rng.normal(0, 1500 * m, len(clean) - start)))
    df = spark.createDataFrame([(i, pcm(np.clip(x, -32768, 32767))) for i, x in rows], "id long, pcm binary")
    prints = audio.materialize(audio.fingerprint_media(df, "id", "pcm"), "prints")
    fps = {r["id"]: r["fp"] for r in prints.collect()}
    want = alignments_by_hand({i: f for i, f in fps.items() if i % 100 == 0}, fps, 0.2, 10)
    got = {(r["query_id"], r["id"]): r["error"] for r in audio.align_media(prints.filter("id % 100 = 0"), prints).collect()}
    hard = {p for p, e in want.items() if e > 0.1}
    assert len(want) > 30 and len(hard) > 8
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in got)


def test_recordings_of_vectors(spark):
    v = np.linspace(-1, 1, 64)
    n = audio.RATE // 4
    assert audio.recording(None) is None and len(audio.recording(v)) == 2 * 24 * n
    assert set(audio.recording(np.zeros(0))) == {0} and audio.recording(v) != audio.recording(np.abs(v))
    assert audio.recording(np.append(v[:63], np.nan)) == audio.recording(np.append(v[:63], 0.0))
    long = np.random.default_rng(1).normal(size=800)
    assert audio.recording(long) != audio.recording(np.append(long[:-1], 9.0))
    t, at = np.arange(n) / audio.RATE, slice(5 * n, 6 * n)
    loud = [max(0.0, float(audio.mixing(24, 64)[5, k] @ v)) for k in range(12)]
    want = sum(x / max(loud) * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k, x in enumerate(loud))
    assert np.abs(np.frombuffer(audio.recording(v), "<i2")[at] - want * 2000).max() <= 1.001
    rows = [(1, v.tolist()), (2, None), (3, []), (None, v.tolist()), (1, v.tolist()), (4, long.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as pcm", "2 as fp", "3 as id")
    one = audio.fingerprint_media(audio.sonify(df), "vec_id", "pcm").collect()
    assert Counter(map(str, one)) == Counter(map(str, audio.fingerprint_vectors(df).collect())) and len(one) == 6
    assert audio.fingerprint_vectors(df.limit(0)).collect() == [] and audio.sonify(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = audio.op7_chroma_prints(spark, folder).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    fps = {r["vec_id"]: r["fp"] for r in rows if r["matches"] is None}
    assert set(fps) == set(vectors) and all(len(f) for f in fps.values())
    for i in list(vectors)[:20]:
        assert fps[i] == audio.pcm_fingerprint(audio.recording(np.array(vectors[i]))).tolist()
    want = alignments_by_hand({i: f for i, f in fps.items() if i % 100 == 0}, fps, 0.2, 10)
    got = {(r["vec_id"], m["id"]): m["error"] for r in rows if r["matches"] is not None for m in r["matches"]}
    assert set(got) == set(want) and want and all(abs(got[p] - want[p]) < 1e-12 for p in got)


def test_histograms_and_blocks_by_hand(spark):
    """Wrong bits and pairs at each offset against plain loops, with silence and any lengths, and the same matches whatever the blocks."""
    rng = np.random.default_rng(8)
    lists = [rng.integers(0, 64, rng.integers(1, 40)).tolist() for _ in range(30)] + [[5] * 20, [5] * 30, [7, 9] + [5] * 12 + [60] * 9]
    silent, width = 5, max(map(len, lists))
    values = np.array([x + [0] * (width - len(x)) for x in lists], dtype=np.uint32)
    for a in lists[::5] + lists[-2:]:
        wrong, pairs = audio.offset_histograms(np.array(a, dtype=np.uint32), values, np.array([len(x) for x in lists]), silent)
        for r, b in enumerate(lists):
            want = defaultdict(lambda: [0, 0])
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    if not x == y == silent:
                        want[j - i][0] += (x ^ y).bit_count()
                        want[j - i][1] += 1
            for offset in range(1 - len(a), len(b)):
                k = offset + len(a) - 1
                assert [wrong[r, k], pairs[r, k]] == want[offset]
    quiet = int(audio.fingerprint(np.zeros((audio.WIDTH, 12)))[0])
    df = spark.createDataFrame([(k, [quiet if x == silent else x for x in part]) for k, part in enumerate(lists)], "id long, fp array<long>")
    df = df.union(df.selectExpr("id + 40", "transform(fp, x -> x ^ 1)"))
    one, many = (Counter(map(str, audio.align_media(df.filter("id < 7 or id > 29"), df, max_error=0.06, **k).collect())) for k in ({}, {"block": 4, "query_block": 2}))
    assert one == many and one and not any("query_id=30, id=31," in r or "query_id=31, id=30," in r for r in one)


def test_long_recording_in_blocks():
    a = tune(60, 3)
    frames = np.lib.stride_tricks.sliding_window_view(a, audio.FRAME)[:: audio.HOP]
    energy = np.abs(np.fft.rfft(frames * np.hamming(audio.FRAME), axis=1)) ** 2 @ audio.pitch_classes(audio.RATE, audio.FRAME)
    smooth = np.stack([np.convolve(energy[:, c], audio.SMOOTH, "valid") for c in range(12)], axis=1)
    want = smooth / np.maximum(np.linalg.norm(smooth, axis=1, keepdims=True), 1e-12)
    got = audio.chroma(a)
    assert len(frames) > 256 and got.shape == want.shape and np.allclose(got, want, atol=1e-4)


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    folder = tmp_path_factory.mktemp("sf")
    from tests.llm.test_text_operators import toxic_corpus

    docs, labels = toxic_corpus()
    fx.frame(spark, docs + [(5000 + r[0] if r[0] is not None else None, *r[1:]) for r in fx.awkward()]).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return str(folder)


def test_pipeline_stage_by_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = docs.collect(), None
        docs = corpus_pipeline.materialize(stage(spark, docs, tables), "stage")
        after = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = Counter(r["doc_id"] for r in after)
        assert ids <= Counter(r["doc_id"] for r in before)
        if name == "toxicity":
            gone = {r["doc_id"] for r in before} - set(ids)
            assert sum(g % 5 == 0 for g in gone) >= 0.97 * len(gone) and len(gone) >= 0.95 * 180
        if name == "n-gram Jaccard join":
            left = {(min(p), max(p)) for p in fx.jaccard_pairs([tuple(r) for r in after if r["doc_id"] is not None and r["doc_id"] >= 5000], 0.5)}
            assert len(left) <= 1
        if name == "substring dedup":
            assert not fx.repeated_words([tuple(r) for r in after], 50)
        assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None and name in ("line dedup", "substring dedup"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    want = Counter()
    for r in docs.collect():
        if r["text"] and r["text"].split():
            want[r["doc_id"]] += len(r["text"].split())
    got, load = Counter(), Counter()
    for r in packed.collect():
        got[r["doc_id"]] += r["length"]
        load[r["bin_id"]] += r["length"]
    assert got == want and max(load.values()) <= 2048


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, tables, stage):
    assert dict(corpus_pipeline.STAGES)[stage](spark, fx.frame(spark, []), tables).collect() == []


def test_run_is_the_stages(spark, tables):
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, tables).collect())
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, tables), "again")
    assert got == Counter(tuple(r) for r in docs.collect())


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_with_clashing_columns(spark, tables, stage):
    """Awkward documents with columns of any names: the same decisions, and all columns but in the last stage."""
    docs, run = fx.frame(spark, fx.awkward()), dict(corpus_pipeline.STAGES)[stage]
    plain, wide = run(spark, docs, tables), run(spark, fx.with_clashes(docs), tables)
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert wide.columns == fx.with_clashes(docs).columns
    cols = plain.columns
    assert Counter(tuple(r) for r in plain.collect()) == Counter(tuple(r[c] for c in cols) for r in wide.collect())


def test_run_on_empty_tables(spark, tmp_path):
    fx.frame(spark, []).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_records_of_awkward_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "user", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as raw", "2 as t", "3 as layout")
    raw = chat.raw_records(df)
    assert Counter(r["conv_id"] for r in raw.collect()) == Counter([1, 2, 3, None]) and chat.raw_records(df.limit(0)).collect() == []
    got = Counter((r["conv_id"], r["role"], r["text"]) for r in chat.canonical_turns(raw).collect())
    assert got == Counter([(1, "user", "a"), (1, "user", "a"), (1, "assistant", "b"), (2, None, None), (None, "user", "x"), (None, "assistant", "y"), (3, "user", "long " * 50_000)])
