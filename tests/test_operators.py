import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import codecs, stem, urls
from termloom.functions import text as tx
from termloom.operators import boolean, corpus, evaluate, graph, index, rank, ranks
from termloom.plans.queries import QUERIES, SQL
from termloom.plans.registry import Tables
from termloom.plans.retrieval_queries import retrieved
from termloom.sources import collections as src
from termloom.sources import sinks
from termloom.streaming import index_stream
from tests.parity import check


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def fold(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if ord(c) < 128)


TEXTS = [
    "foo-bar  Straße naïve x_y 3.5 don't", "", "Visit HTTP://a.b/c?d=1, or mail a.b@c.org on 12/03/2020; pay 50% of 1.234,5 now.",
    "El Sr. Juan de la Cruz y Ana Paz viven en EE.UU. con J.R. Perez", "Ana 5 Luis", "24 digits: 123456789012345678901234x end", "ÁRBOL Ñandú Ünï", None,
]


@pytest.mark.parametrize("text", TEXTS)
def test_fold_and_words(spark, text):
    assert one(spark, tx.ascii_fold, text) == (None if text is None else fold(text))
    want = None if text is None else re.findall(r"[a-z]+(?:[-'][a-z]+)*", fold(text.lower()))
    assert one(spark, tx.tokens_words, text) == want


def typed_by_hand(text):
    out = Counter()
    for ty, rx in tx.TYPED.items():
        flags = re.I if "i" in rx[: rx.index(")")] else 0
        body = re.compile(rx[rx.index(")") + 1 :], flags)
        for m in body.finditer(text):
            out[ty, fold(m[0]).strip() if ty in ("abbrev", "proper") else m[0]] += 1
        text = body.sub(lambda m: " " * len(m[0]), text)
    for w in re.findall(r"\b[a-z]+(?:[-'][a-z]+)*\b", fold(text.lower())):
        out["word", w] += 1
    return out


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_typed_tokens_mask_in_order(spark, text):
    assert Counter((r["ty"], r["tok"]) for r in one(spark, tx.tokens_typed, text)) == typed_by_hand(text)


def test_typed_tokens_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", tx.tokens_typed(F.col("text")).alias("x")).collect()
    assert all(Counter((t["ty"], t["tok"]) for t in r["x"]) == typed_by_hand(r["text"]) for r in docs)


def test_a_type_is_searched_once(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = corpus.typed_terms(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{1,4}") == 1  # a part of the pattern of abbreviations


def test_stemmers():
    porter = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat",
              "vietnamization": "vietnam", "electrical": "electr", "adoption": "adopt", "controll": "control", "roll": "roll", "cease": "ceas", "sky": "sky"}
    assert {w: stem.porter_stem(w) for w in porter} == porter
    lancaster = {"maximum": "maxim", "presumably": "presum", "multiply": "multiply", "provision": "provid", "owed": "ow", "ear": "ear", "saying": "say", "crying": "cry", "string": "string", "cement": "cem"}
    assert {w: stem.lancaster_stem(w) for w in lancaster} == lancaster
    spanish = {"para": "par", "chicas": "chic", "torneos": "torne", "torpedearon": "torped", "cheques": "chequ", "universidades": "univers", "nacionales": "nacional", "haciendo": "hac"}
    assert {w: stem.spanish_stem(w) for w in spanish} == spanish


def vbyte_by_hand(n):
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127)
    return bytes(out[:-1] + [out[-1] | 128])


def gamma_by_hand(values):
    bits = "".join("0" * (len(f"{v:b}") - 1) + f"{v:b}" for v in values)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def test_codecs_by_hand():
    rng = random.Random(2)
    lists = [[0, 1, 5, 127, 128, 300, 16383, 16384, 2**31, 2**40, 2**62], [], [7]] + [[rng.randrange(1 << rng.randrange(1, 40)) for _ in range(rng.randrange(30))] for _ in range(40)]
    flat, bounds = np.array([x for part in lists for x in part]), np.cumsum([0] + [len(x) for x in lists])
    got = codecs.encode_vbyte(flat, bounds).to_pylist()
    assert got == [b"".join(map(vbyte_by_hand, x)) for x in lists]
    assert [codecs.decode_vbyte(g, len(x)) for g, x in zip(got, lists)] == lists
    got = codecs.encode_gamma(flat, bounds).to_pylist()
    assert got == [gamma_by_hand([max(1, v) for v in x]) for x in lists]
    assert [codecs.decode_gamma(g, len(x)) for g, x in zip(got, lists)] == [[max(1, v) for v in x] for x in lists]


def postings_by_hand(seed=3, docs=90):
    """{term: [(doc_id, tf)]} of terms in few and in all documents."""
    rng, out = random.Random(seed), {}
    for k, share in enumerate((0.02, 0.1, 0.5, 1.0, 0.3)):
        rows = [(d, rng.randrange(1, 9)) for d in range(docs) if rng.random() < share]
        if rows:
            out[f"t{k}"] = rows
    return out


def frame_of(spark, lists):
    return spark.createDataFrame([(d, t, n) for t, ps in lists.items() for d, n in ps], "doc_id long, term string, tf long")


@pytest.mark.parametrize("width", [7, index.BLOCK])
def test_blocks_carry_from_one_to_the_next(spark, width):
    lists = postings_by_hand()
    tf = frame_of(spark, lists)
    ids = {t: [d for d, _ in ps] for t, ps in lists.items()}
    gapped = index.gaps(tf, width)
    assert {(r["term"], r["doc_id"]): r["gap"] for r in gapped.collect()} == {(t, d): d - p for t, ds in ids.items() for p, d in zip([0, *ds], ds)}
    assert {tuple(r) for r in index.gaps_inverse(gapped, width).collect()} == {(t, d) for t, ds in ids.items() for d in ds}
    skips = {(r["term"], r["doc_id"], r["idx"]) for r in index.skip_list(tf, width).collect()}
    assert skips == {(t, d, i) for t, ds in ids.items() if len(ds) > 1 for i, d in enumerate(ds) if i % math.isqrt(len(ds)) == 0}
    for value in ("gap", "doc_id"):
        blocks = index.compressed(tf, value, width)
        assert {tuple(r) for r in index.decompress(blocks, value == "gap").collect()} == {(t, d, n) for t, ps in lists.items() for d, n in ps}
        assert (blocks.count() > len(lists)) == (width == 7)
    blocks = index.posting_blocks(tf, width).collect()
    assert sorted((r["term"], *p) for r in blocks for p in r["postings"]) == sorted((t, d, n) for t, ps in lists.items() for d, n in ps)
    assert all(r["df"] == len(r["postings"]) and r["cf"] == sum(p["tf"] for p in r["postings"]) and all(p["doc_id"] // width == r["blk"] for p in r["postings"]) for r in blocks)


def test_lists_of_gaps_stay_rows_of_blocks(spark):
    docs = {"a": [0, 1, 5, 6, 14, 30], "b": [13], "c": [2, 21, 22]}
    tf = spark.createDataFrame([(t, d, d % 3 + 1) for t, ds in docs.items() for d in ds], "term string, doc_id long, tf long")
    blocks = index.gap_blocks(index._lists(tf, 7))
    assert {(r["term"], r["blk"]): list(r["gaps"]) for r in blocks.collect()} == {
        ("a", 0): [0, 1, 4, 1], ("a", 2): [8], ("a", 4): [16], ("b", 1): [13], ("c", 0): [2], ("c", 3): [19, 1],
    }
    back = index.gap_rows_inverse(blocks.select("term", "blk", "gaps"))
    assert back._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # postings become rows at the end
    assert sorted(tuple(r) for r in back.collect()) == sorted((t, d) for t, ds in docs.items() for d in ds)


def test_intersection_by_skips(spark):
    lists = postings_by_hand()
    ids = {t: [d for d, _ in ps] for t, ps in lists.items()}
    segments = index.skip_segments(frame_of(spark, lists), 7)
    for r in segments.collect():
        step = math.isqrt(len(ids[r["term"]]))
        assert r["docs"] == ids[r["term"]][r["seg"] * step : (r["seg"] + 1) * step] and (r["low"], r["high"]) == (r["docs"][0], r["docs"][-1])
    pairs = [(f"{a}{b}", a, b) for a in ids for b in ids if a != b and len(ids[a]) <= len(ids[b])] + [("none", "t0", "nosuch")]
    got = {r["qid"]: (r["docs"], r["read"], r["passed"]) for r in index.skip_and(spark.createDataFrame(pairs, "qid string, short string, long string"), segments).collect()}
    for qid, a, b in pairs:
        both, long = set(ids[a]) & set(ids.get(b, [])), ids.get(b, [])
        step = max(1, math.isqrt(len(long)))
        parts = [long[k : k + step] for k in range(0, len(long), step)]
        read = sum(any(x[0] <= d <= x[-1] for d in ids[a]) for x in parts)
        assert got[qid] == (len(both), read, len(parts) - read)
    assert any(p for _, _, p in got.values())


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cats run and cats sleep", "a"), (2, "cats sleep", None), (70_000, "dogs run", "b"), (4, "", "c"), (5, None, "d")], "doc_id long, text string, source string")
    path = f"file://{tmp_path}"
    index.write_index(docs, f"{path}/full")
    index.write_index(docs, f"{path}/bare", buckets=2, frequencies=False)
    full, bare = index.Stored(spark, f"{path}/full"), index.Stored(spark, f"{path}/bare")
    want = {("cats", 1, 2), ("cats", 2, 1), ("dogs", 70_000, 1), ("run", 1, 1), ("run", 70_000, 1), ("sleep", 1, 1), ("sleep", 2, 1)}
    assert full.has_frequencies and not bare.has_frequencies
    assert {tuple(r) for r in full.postings().collect()} == want and {tuple(r) for r in bare.postings().collect()} == {(t, d, 1) for t, d, _ in want}
    assert {tuple(r) for r in full.vocabulary.collect()} == {(1, "cats", 2, 3, 0), (2, "dogs", 1, 1, 16), (3, "run", 2, 2, 24), (4, "sleep", 2, 2, 40)}
    assert {r["term"]: r["seek"] for r in bare.vocabulary.collect()} == {"cats": 0, "dogs": 8, "run": 12, "sleep": 20}
    assert {tuple(r) for r in full.documents.collect()} == {(1, "a", 4), (2, None, 2), (70_000, "b", 2), (4, "c", 0), (5, "d", 0)}
    asked = spark.createDataFrame([("run",), ("nosuch",), ("run",)], "term string")
    for terms, pushed in ((["run", "nosuch"], 9), (asked, 9), (asked, 1)):
        assert {(r["term"], r["docs"][0]) for r in full.matching(terms, pushed).collect()} == {("run", 1), ("run", 70_000)}
    assert "In(term, [nosuch,run])" in full.postings(asked)._jdf.queryExecution().toString().replace(", ", ",").replace("term,[", "term, [")
    assert {tuple(r) for r in index.lookup(full, "CATS").collect()} == {(1, "a", 2), (2, "?", 1)}


@pytest.mark.parametrize("gaps", [True, False])
def test_compressed_index_on_disk(spark, tmp_path, gaps):
    lists = postings_by_hand()
    path = f"file://{tmp_path}/c"
    index.write_compressed(frame_of(spark, lists), path, gaps, width=20)
    every = {(t, d, n) for t, ps in lists.items() for d, n in ps}
    assert {tuple(r) for r in index.read_compressed(spark, path).collect()} == every
    assert {tuple(r) for r in index.read_compressed(spark, path, ["t2"]).collect()} == {x for x in every if x[0] == "t2"}
    at = [0, 0]
    for r in spark.read.parquet(f"{path}/vocabulary").orderBy("term").collect():
        assert r["df"] == len(lists[r["term"]]) and [r["vbyte_seek"], r["gamma_seek"]] == at
        at = [at[0] + r["vbyte_bytes"], at[1] + r["gamma_bytes"]]


def test_documents_that_contain_a_topic(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(12)}" for _ in range(n))
    texts = [words(60) for _ in range(60)] + [None, ""]
    topics = [t[k : k + n] for t in texts[:25] if t for k, n in ((rng.randrange(40), rng.randrange(3, 60)),)] + ["w1", "w1 w2", "  ", "", "not there at all by any means", "w1\tw2 w3 w4 w5 w6 w7"]
    texts += [f"x{topics[0]}y", "pre w1\tw2 w3 w4 w5 w6 w7post"]
    got = evaluate.containing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(topics)), "qid long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == Counter((q, d) for d, t in enumerate(texts) if t is not None for q, topic in enumerate(topics) if topic in t)


def test_equal_scores_go_by_document(spark):
    """Sums of one score in different orders differ in their last bits, and must not rank."""
    third = [0.1, 0.2, 0.3, 0.4, 1e-9 / 3]
    scores = [(5, sum(third)), (3, sum(reversed(third))), (9, sum(third) + 4e-8), (1, 0.5), (2, 2.0)]
    df = spark.createDataFrame([(1, d, float(x)) for d, x in scores], "qid long, doc_id long, score double")
    assert [r["doc_id"] for r in rank.top(df, 4).orderBy("rank").collect()] == [2, 3, 5, 9]


def test_rankings_by_shares_of_documents(spark, monkeypatch):
    monkeypatch.setattr(rank, "SHARE", 16)  # many shares, each of which keeps more than it has of the first 50
    check(spark, QUERIES["q_rank_union"], SQL["q_rank_union"])
    monkeypatch.setattr(rank, "SHARE", 100)
    check(spark, lambda s, d: retrieved(Tables(s, d), ("bm25",), 5), SQL["q_rank_bm25"].replace("rank < 50", "rank < 5"))


def test_numbers_of_rows_with_many_ties(spark):
    rows = [(0.0 if i % 3 else float(i % 5), f"u{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "v double, url string")
    got = {r["url"]: r["n"] for r in ranks.in_order(df, [F.desc("v"), "url"], "n", parts=7).collect()}
    assert [u for u, _ in sorted(got.items(), key=lambda x: x[1])] == [u for _, u in sorted(rows, key=lambda r: (-r[0], r[1]))]
    assert sorted(got.values()) == list(range(1, 901)) and ranks.in_order(df.limit(0), ["url"], "n").collect() == []


def test_links_are_resolved_as_by_the_standard(spark):
    from urllib.parse import urljoin

    bases = ["http://a.com/x/y.html?q#f", "https://B.com", "http://a.com/x/", "HTTP://c.com/z", "ftp://a.com/x"]
    refs = ["/p", "/", "//h.org/p", "http://d.com/../e", "http://a.com/./f", "https://d.com", "p", "../p", "./", "?q=1", "/a/../b", "/a//b", "mailto:x@y", "http://d.com/a b", "/q?x=/../y", "/w;v", "http:p", "http:///p"]
    pages = spark.createDataFrame([(b, page(*refs)) for b in bases], "url string, html string")
    want = Counter()
    for b in bases:
        for i, r in enumerate(refs):
            dst = urljoin(b, r).split("#")[0]
            host = re.match(r"^https?://([^/?#]*)", dst)
            if host and re.fullmatch(r"[^.]+(\.[^.]+)+", host[1]):
                want[b, i, dst] += 1
    assert Counter(tuple(r) for r in graph.links(pages).collect()) == want


def test_students_t(spark):
    for t, n, p in ((12.7062, 1, 0.05), (2.7764, 4, 0.05), (2.2281, 10, 0.05), (2.0, 10, 0.073388), (0.0, 7, 1.0), (3.4995, 7, 0.01), (1.96, 100_000, 0.05)):
        assert abs(evaluate.student_tail(t, n) - p) < 2e-5 and evaluate.student_tail(-t, n) == evaluate.student_tail(t, n)
    rows = [("a", q, x) for q, x in enumerate((0.1, 0.5, 0.3, 0.4))] + [("b", q, x) for q, x in enumerate((0.2, 0.6, 0.3, 0.6))] + [("c", q, x) for q, x in enumerate((0.1, 0.5, 0.3, 0.4))] + [("b", 9, 0.4)]
    df = spark.createDataFrame(rows, "model string, qid long, ap double")
    got = {r["model"]: r for r in evaluate.significance(df, "a").collect()}
    d = [0.1, 0.1, 0.0, 0.2]
    t = (sum(d) / 4) / (math.sqrt(sum((x - 0.1) ** 2 for x in d) / 3) / 2)
    assert math.isclose(got["b"]["t"], t, rel_tol=1e-6) and math.isclose(got["b"]["p"], evaluate.student_tail(t, 3), rel_tol=1e-6) and got["c"]["p"] is None
    assert [tuple(r) for r in evaluate.common_queries(df, ("a", "b", "c")).orderBy("qid").limit(1).collect()] == [(0, 0.1, 0.2, 0.1)]


def test_order_of_query_numbers(spark):
    df = spark.createDataFrame([("10", 1), ("9", 1), ("x2", 0), ("9", 0), ("x10", 0)], "qid string, rank long")
    assert [tuple(r) for r in evaluate.by_query(df, "rank").collect()] == [("9", 0), ("9", 1), ("10", 1), ("x10", 0), ("x2", 0)]


def test_analyzers(spark):
    docs = spark.createDataFrame([(1, "Running runs, at http://www.example.org/a-very-long-address-indeed of Ana Paz; the supercalifragilisticexpialidociousness")], "doc_id long, text string")
    assert Counter(r["term"] for r in corpus.typed_terms(docs).collect()) == Counter(["http://www.example.org/a-very-long-address-indeed", "Ana Paz", "running", "runs"])
    got = Counter(r["term"] for r in corpus.stemmed_terms(stem.porter)(docs).collect())
    words = [w for w in re.findall(r"[a-z]+(?:[-'][a-z]+)*", docs.first()["text"].lower()) if 2 <= len(w) <= 25 and w not in corpus.STOP]
    assert got == Counter(map(stem.porter_stem, words)) and got["run"] == 2


@pytest.mark.parametrize("query,want", [("a and b", {1}), ("a or b", {1, 2, 3}), ("not a", {3, 4}), ("a & ~b", {2}), ("~(a|b)", {4}), ("TRUE", {1, 2, 3, 4}), ("false or a", {1, 2}), ("x", set()), ("a and", set()), ("a-b", set()), ("a or b and b", {1, 2, 3})])
def test_boolean(spark, query, want):
    tf = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1), (3, "b", 2)], "doc_id long, term string, tf long")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id long")
    assert {r["doc_id"] for r in boolean.search({"q": query}, tf, docs).collect()} == want


def test_queries_by_blocks(spark):
    rng = random.Random(5)
    docs = {t: set(rng.sample(range(40), n)) for t, n in (("a", 25), ("b", 18), ("c", 30), ("d", 1))}
    tf = spark.createDataFrame([(t, d, 1) for t, ds in docs.items() for d in ds], "term string, doc_id long, tf long")
    queries = {"q": "ab", "r": "cab", "s": "dx", "t": "xy", "u": "ad"}
    terms = spark.createDataFrame([(q, i + 1, t) for q, ts in queries.items() for i, t in enumerate(ts)], "qid string, i int, term string")
    blocks = index._lists(tf, 7).select("term", "blk", "docs")
    sets = {q: [docs.get(t, set()) for t in ts] for q, ts in queries.items()}
    every = {(q, d) for q, s in sets.items() for d in set.intersection(*s)}
    pairs = lambda df: sorted((r["qid"], r["doc_id"]) for r in df.collect())
    assert pairs(boolean.conjunction_of_blocks(terms.select("qid", "term"), blocks)) == sorted(every)
    assert pairs(boolean.difference(terms, blocks)) == sorted((q, d) for q, s in sets.items() for d in s[0] - s[1])
    assert pairs(boolean.union_of_blocks(terms.select("qid", "term"), blocks)) == sorted((q, d) for q, s in sets.items() for d in set.union(*s))
    sizes = {r["qid"]: r["docs"] for r in boolean.common_sizes(terms.select("qid", "term"), blocks).collect()}
    assert sizes == {q: len(set.intersection(*s)) for q, s in sets.items() if set.union(*s)}


def test_evaluation_by_hand(spark):
    run = spark.createDataFrame([("m", "q1", 0, 10), ("m", "q1", 1, 11), ("m", "q1", 2, 12), ("m", "q2", 0, 10)], "model string, qid string, rank long, doc_id long")
    qrels = spark.createDataFrame([("q1", 10, 1), ("q1", 12, 1), ("q1", 99, 1), ("q1", 11, 0)], "qid string, doc_id long, label int")
    got = {r["qid"]: r for r in evaluate.per_query(run, qrels).collect()}
    assert got["q1"]["p10"] == 0.2 and math.isclose(got["q1"]["ap"], (1 + 2 / 3) / 3) and math.isclose(got["q1"]["rprec"], 2 / 3)
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert math.isclose(got["q1"]["ndcg10"], (1 + 1 / math.log2(4)) / ideal)
    assert got["q2"]["ap"] is None and got["q2"]["p10"] is None
    levels = {r["level"]: r["precision"] for r in evaluate.interpolated(run, qrels).filter("qid = 'q1'").collect()}
    assert levels[0.0] == 1 and levels[0.3] == 1 and math.isclose(levels[0.6], 2 / 3) and levels[0.7] == 0


def test_daat_cosine_of_single_terms_and_common_terms(spark):
    tf = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (1, "c", 1), (2, "c", 1), (3, "c", 9)], "doc_id long, term string, tf long")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3)], "doc_id long")
    q = spark.createDataFrame([("one", 1, "a"), ("all", 1, "c"), ("mix", 1, "a"), ("mix", 2, "c"), ("twice", 1, "a"), ("twice", 2, "a")], "qid string, pos int, term string")
    got = {(r["qid"], r["doc_id"]): r["score"] for r in rank.daat_cosine(tf, docs, q).collect()}
    assert got["one", 1] == got["one", 2] == 1 and ("all", 1) not in got and got["mix", 3] == 0 and got["twice", 1] == 1


def test_ranks_and_running_sums(spark):
    rows = [(f"t{i % 50}", i % 7, i) for i in range(50)]
    df = spark.createDataFrame(rows, "term string, cf long, key long")
    got = {r["term"]: r["rank"] for r in ranks.by_frequency(df).collect()}
    assert [t for t, _ in sorted(got.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    total = {r["key"]: r["s"] for r in ranks.running(df, "cf", "key", ["term"], "s", width=8).collect()}
    assert all(total[i] == sum(r[1] for r in rows if r[2] <= i) for i in range(50))


def test_language_identification_sums_to_one_and_finds_languages(spark):
    docs = spark.createDataFrame([(1, "the thing with the other", "en"), (2, "der und nicht die auch schön", "de"), (3, "", "en"), (4, None, "de")], "doc_id long, text string, lang string")
    texts = corpus.language_texts(docs)
    sums = corpus.unigram_model(texts).groupBy("lang").agg(F.sum("p")).collect()
    assert all(math.isclose(s[1], 1) for s in sums)
    assert {r["doc_id"]: r["predicted"] for r in corpus.predict_language(texts, corpus.bigram_model(texts)).collect()} == {1: "en", 2: "de"}


def test_letters_are_counted_without_a_row_each(spark, monkeypatch):
    monkeypatch.setattr(corpus, "LETTERS_AT_ONCE", 5)
    rows = [(1, "en", "abab"), (2, "en", "a"), (3, "en", ""), (4, "es", "ñzéé"[1:]), (5, "es", None), (6, None, "ab"), (7, "en", "ba")]
    texts = spark.createDataFrame(rows, "doc_id long, lang string, s string").coalesce(1)
    pairs = Counter((lang, s[i : i + 2]) for _, lang, s in rows for i in range(len(s or "") - 1))
    letters = tx.ALPHABET
    got = corpus._gram_counts(texts, 2)
    assert "Generate" not in got._jdf.queryExecution().toString()
    assert {(r["lang"], letters[r["g"] // 49] + letters[r["g"] % 49]): r["n"] for r in got.collect()} == pairs
    model = {(r["lang"], r["x"] + r["y"]): r["p"] for r in corpus.bigram_model(texts).collect()}
    after = Counter()
    for (lang, b), n in pairs.items():
        after[lang, b[0]] += n
    assert all(math.isclose(p, 1 / 49 if lang is None else (pairs[lang, b] + 1) / (after[lang, b[0]] + 49)) for (lang, b), p in model.items())
    best = {r["doc_id"]: r["predicted"] for r in corpus.predict_language(texts.filter("lang is not null"), corpus.bigram_model(texts.filter("lang is not null"))).collect()}
    score = lambda s, g: sum(math.log(model[g, s[i : i + 2]]) for i in range(len(s) - 1))
    assert best == {d: max(("en", "es"), key=lambda g: score(s, g)) for d, lang, s in rows if lang and len(s or "") > 1}


def test_urls(spark):
    u = " https://User@WWW.Example.com:80/a//b.php/?#x "
    assert one(spark, urls.normal_url, u) == "https://User@WWW.Example.com:80/a//b.php/?"
    assert one(spark, lambda c: urls.domain(urls.normal_url(c)), u) == "user@www.example.com:80"
    assert one(spark, urls.domain, "http://www.www.a.b/") == "www.a.b"
    assert one(spark, urls.physical_depth, "http://a.b/c//d/") == 2
    assert [one(spark, urls.is_valid, x) for x in ("http://a.b", "http://a", "http://a..b", "x")] == [True, False, False, False]
    assert [one(spark, urls.kind, x) for x in ("http://a.b/x.php", "http://a.b/x?y=1", "http://a.b/x.html", "http://a.b/x?")] == ["dynamic", "dynamic", "static", "static"]


def page(*links):
    return "<html><body>" + "".join(f'<a href="{x}">t</a>' for x in links) + "</body></html>"


SITE = {
    "http://a.com/": page("/1", "/2#frag", "http://b.org/", "javascript:x", "#top", ""), "http://a.com/1": page("/2", "/deep/er/still/more"), "http://a.com/2": page("/1", "/", "/gone", "3"),
    "http://b.org/": page("http://a.com/1", "/x"), "http://a.com/3": page(),
}


def test_crawls(spark):
    pages = spark.createDataFrame(list(SITE.items()), "url string, html string")
    seeds = spark.createDataFrame([("http://a.com/#s", 0)], "url string, ord long")
    visited, edges, counters = graph.crawl(seeds, pages, max_logical=2, max_physical=3)
    levels = {r["url"]: (r["logical"], r["fetched"]) for r in visited.collect()}
    assert levels == {"http://a.com/": (0, True), "http://a.com/1": (1, True), "http://a.com/2": (1, True), "http://b.org/": (1, True), "http://a.com/gone": (2, False), "http://a.com/3": (2, True), "http://b.org/x": (2, False)}
    assert edges.filter("src = 'http://a.com/'").count() == 3 and ("http://a.com/1", "http://a.com/deep/er/still/more") in {tuple(r) for r in edges.collect()}
    assert counters.filter("level = 0").first()["ok"] == 1
    visited, edges, _ = graph.crawl(seeds, pages, per_site=None, max_logical=9, max_physical=None, one_domain=True, max_pages=3)
    assert [r["url"] for r in visited.filter("fetched").orderBy("logical", "ord").collect()] == ["http://a.com/", "http://a.com/1", "http://a.com/2"]
    assert not edges.filter("dst like '%b.org%'").count()
    visited, _, _ = graph.crawl(seeds, pages, per_site=2, max_logical=3)
    assert visited.filter("url like '%a.com%'").count() == 2


def test_pagerank_and_hits(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("a", "d")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "url string")
    got = {r["url"]: r["pagerank"] for r in graph.pagerank(nodes, edges, tol=1e-9).collect()}
    r = dict.fromkeys("abcde", 0.2)
    out = {"a": "bd", "b": "a", "c": "a"}
    for _ in range(200):
        loose = sum(r[x] for x in "de")
        r = {x: 0.03 + 0.85 * (loose / 5 + sum(r[s] / len(d) for s, d in out.items() if x in d)) for x in "abcde"}
    assert math.isclose(sum(got.values()), 1) and all(abs(got[x] - r[x]) < 1e-6 for x in r)
    hits = {r["url"]: (r["authority"], r["hub"]) for r in graph.hits(nodes, spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d")], "src string, dst string")).collect()}
    assert math.isclose(sum(a for a, _ in hits.values()), 1, abs_tol=1e-9) and hits["b"][0] > hits["d"][0] > 0 and hits["e"] == (0, 0)
    assert {r["authority"] for r in graph.hits(nodes, edges.limit(0)).collect()} == {0}


def test_sums_over_neighbours_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "SPAN", 4)
    monkeypatch.setattr(graph, "CHUNK", 8)
    rng = random.Random(3)
    rows = [(f"n{rng.randrange(30)}", f"n{rng.randrange(33)}") for _ in range(120)]  # some twice, some to nodes that aren't there
    g = graph.Packed(spark.createDataFrame([(f"n{i}",) for i in range(30)], "url string"), spark.createDataFrame(rows, "src string, dst string"))
    ids = {r["url"]: r["id"] for r in g.nodes.collect()}
    assert sorted(ids.values()) == list(range(30))
    into, out, vector = np.zeros(30), np.zeros(30), np.arange(30.0) ** 2
    for a, b in set(rows):
        if b in ids:
            into[ids[b]] += vector[ids[a]]
            out[ids[a]] += vector[ids[b]]
    assert np.allclose(g.sums(vector, "d"), into) and np.allclose(g.sums(vector, "s"), out)
    degree = Counter(a for a, _ in set(rows))
    assert all(g.degrees()[ids[x]] == degree[x] for x in ids)
    assert "Exchange" not in g.chunks("d")._jdf.queryExecution().toString()  # a step shuffles nothing


def test_supply_ranks_have_converged(spark, tmp_path):
    rows = [(p, s) for p in range(12) for s in range(3) if (p + s) % 3 < 2 and (p, s) != (1, 0)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    got = {r["url"]: r["pagerank"] for r in QUERIES["q_pagerank_supply_converged"](spark, f"file://{tmp_path}").collect()}
    edges = [(f"p{p}", f"s{s}") for p, s in rows]
    edges += [(b, a) for a, b in edges]
    deg = Counter(a for a, _ in edges)
    r = dict.fromkeys(deg, 1 / len(deg))
    for _ in range(500):
        new = dict.fromkeys(deg, 0.15 / len(deg))
        for a, b in edges:
            new[b] += 0.85 * r[a] / deg[a]
        r = new
    assert got.keys() == r.keys() and all(abs(got[x] - r[x]) < 2e-8 for x in r)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c" / "sub").mkdir(parents=True)
    (tmp_path / "c" / "b.txt").write_bytes(b"two \xff words")
    (tmp_path / "c" / "sub" / "a.html").write_text("<p>x</p>")
    (tmp_path / "c" / "n.pdf").write_text("no")
    docs = src.numbered_by_path(src.read_collection(spark, f"file://{tmp_path}/c"))
    assert [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()] == [(0, "two  words"), (1, "<p>x</p>")]
    put = lambda name, text: (tmp_path / name).write_text(text) and f"file://{tmp_path}/{name}"
    assert {r[0] for r in src.read_stopwords(spark, put("s.txt", "The\n\n of \nthe\n")).collect()} == {"the", "of"}
    stats, expected = src.read_expected(spark, put("e.json", '{"statistics": {"N": 2, "num_tokens": 9, "num_terms": 4},\n "data": [{"term": "a", "df": 2}]}'))
    assert tuple(stats.first()) == (2, 9, 4) and tuple(expected.first()) == ("a", 2)
    trec = put("t.xml", "<DOC>\n<DOCNO> 1 </DOCNO>\n<TEXT>some\n text</TEXT></DOC>\n<DOC><DOCNO>2</DOCNO> <b>bold</b> x</DOC><DOC>none</DOC>")
    assert [tuple(r) for r in src.read_trec_documents(spark, trec).orderBy("docno").collect()] == [("1", "some text"), ("2", "bold x")]
    assert src.parse_trec_queries("<top><num>Number: 7</num><title>big cats</title></top>") == [("7", "big cats")]
    assert src.parse_trec_queries("<DOC><DOCNO>3</DOCNO>plain words</DOC>") == [("3", "plain words")]
    assert src.parse_trec_queries(".I 1\n.W\nfirst one\n.I 2\n.W\nsecond") == [("1", "first one"), ("2", "second")]
    assert {tuple(r) for r in src.read_qrels(spark, put("q.txt", "1 0 d1 1.0\n2 d2 0\nbad\n")).collect()} == {("1", "d1", 1), ("2", "d2", 0)}
    assert [tuple(r) for r in src.read_query_log(spark, put("l.txt", "9:Two Terms\n\nBare one\n")).orderBy("qid").collect()] == [("2", ["bare", "one"]), ("9", ["two", "terms"])]
    dump = put("p.txt", "b:9:3,1,7\nx:1\ny:1:,\nc:1:4,bad,99999999999,2\nb:9:3,1,\n")
    assert {r["term"]: (r["df"], r["docids"]) for r in src.read_posting_dump(spark, dump).collect()} == {"b": (2, [1, 3]), "c": (2, [2, 4])}
    low = put("low.xml", "<doc>\n<docno>7</docno> one </doc> <Doc id=x><DocNo>8</DocNo> two</dOC>")
    assert [tuple(r) for r in src.read_trec_documents(spark, low).orderBy("docno").collect()] == [("7", "one"), ("8", "two")]
    assert [tuple(r) for r in src.read_trec_queries(spark, put("top.xml", "<top><num>Number: 7</num><title>big cats</title></top>")).collect()] == [("7", "big cats")]
    assert [r[0] for r in src.read_trec_text(spark, put("d.xml", "<DOC><DOCNO>1</DOCNO>a <b>c</DOC>\n<DOC>d</DOC>")).collect()] == ["a <b>c", "d"]
    assert [r[0] for r in src.read_trec_text(spark, put("plain.txt", "no blocks <doc>x</doc>")).collect()] == ["no blocks <doc>x</doc>"]
    langs = src.read_language_training(spark, {"en": put("en.txt", "the\nthing"), "fr": put("fr.txt", "le")})
    assert {tuple(r) for r in langs.collect()} == {("en", "the\nthing"), ("fr", "le")}
    vocabulary = spark.createDataFrame([("a", 3), ("b", 2)], "term string, df long")
    groups = src.read_query_groups(spark, put("g.txt", "A b\n\na\na nosuch\nb a a\n"), vocabulary).collect()
    assert Counter((r["n_terms"], tuple(r["terms"]), r["postings"]) for r in groups) == Counter([(2, ("a", "b"), 5), (1, ("a",), 3), (3, ("b", "a", "a"), 8)])
    lang = src.read_language_test(spark, put("a.txt", "hello\nsalut\n"), put("b.txt", "1 en\n2\n3 fr\n"))
    assert [tuple(r) for r in lang.orderBy("line_no").collect()] == [(0, "hello", "en"), (1, "salut", "fr")]
    terms = spark.createDataFrame([("b", 2, 1), ("a", 3, 2)], "term string, cf long, df long")
    sinks.write_term_list(terms, f"file://{tmp_path}/terms")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/terms").collect()] == ["a 3 2", "b 2 1"]


def test_sinks_of_results(spark, tmp_path):
    path = f"file://{tmp_path}"
    lines = lambda name: [r[0] for r in spark.read.text(f"{path}/{name}").collect()]
    csv = lambda name: [tuple(r) for r in spark.read.csv(f"{path}/{name}", header=True).collect()]
    stats = spark.createDataFrame([(3, 10, 5, 10 / 3, 2.0, 4.256, 1, 0, 7, 5, 2)], "n_docs long, n_tokens long, n_terms long, avg_tokens double, avg_terms double, avg_length double, min_tokens long, min_terms long, max_tokens long, max_terms long, hapax long")
    sinks.write_statistics(stats, f"{path}/stats")
    assert lines("stats") == ["3", "10 5", "3.33 2.00", "4.26", "1 0 7 5", "2"]
    terms = spark.createDataFrame([("b", 2, 1), ("a", 3, 2), ("c", 2, 1)], "term string, cf long, df long")
    sinks.write_extremes(terms, f"{path}/ends", 2)
    assert lines("ends") == ["most frequent", "a 3", "b 2", "least frequent", "b 2", "c 2"]
    sinks.write_stem_comparison(spark.createDataFrame([("b", "x", "y"), ("a", "u", "v")], "term string, porter string, lancaster string"), f"{path}/stems")
    assert csv("stems") == [("a", "u", "v"), ("b", "x", "y")]
    sinks.write_heaps(spark.createDataFrame([(2, 2), (1, 1)], "n long, v long"), f"{path}/heaps")
    assert csv("heaps") == [("1", "1"), ("2", "2")]
    run = spark.createDataFrame([("m", "7", 0, 10, 0.5), ("m", "7", 1, 11, 0.25)], "model string, qid string, rank long, doc_id long, score double")
    docs = spark.createDataFrame([(10, "Ten", "10.txt"), (11, "Eleven", "11.txt")], "doc_id long, title string, name string")
    sinks.write_run_table(run, spark.createDataFrame([("7", "big cats")], "qid string, text string"), docs, f"{path}/run")
    assert csv("run") == [("m", "7", "big cats", "0", "10", "0.5", "Ten", "10.txt"), ("m", "7", "big cats", "1", "11", "0.25", "Eleven", "11.txt")]
    sinks.write_rankings(run, docs, f"{path}/rankings")
    assert csv("rankings/qid=7") == [("1", "10.txt", "0.500000"), ("2", "11.txt", "0.250000")]
    sinks.write_run(run, f"{path}/by_query")
    assert spark.read.csv(f"{path}/by_query", header=True).count() == 2
    edges = spark.createDataFrame([("a", "b"), ("a", "b")], "src string, dst string")
    sinks.write_edges(edges, f"{path}/edges")
    assert csv("edges") == [("a", "b")] * 2
    ranked = spark.createDataFrame([("http://a.com/x", 0.25, 0.5), ("http://a.com/", 0.75, 1 / 3)], "url string, pagerank double, authority double")
    visited = spark.createDataFrame([("http://a.com/x", 1, 1), ("http://a.com/", 1, 0)], "url string, ord long, logical int")
    sinks.write_pages(ranked, f"{path}/pages")
    assert [r[0] for r in csv("pages")] == ["http://a.com/", "http://a.com/x"]
    sinks.write_ranked_pages(ranked, visited, f"{path}/ranked")
    assert csv("ranked") == [("http://a.com/", "1", "0", "0.75000000", "0.33333333"), ("http://a.com/x", "2", "1", "0.25000000", "0.50000000")]
    lists = postings_by_hand()
    sinks.write_skips(frame_of(spark, lists), f"{path}/skips")
    kept = spark.read.parquet(f"{path}/skips/skips").groupBy("term").count().collect()
    assert {r["term"]: r["n_skips"] for r in spark.read.parquet(f"{path}/skips/vocabulary").collect()} == {r["term"]: r["count"] for r in kept} and kept


def test_running_counts_of_a_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'cats run' as text union all select timestamp'2024-01-01 01:10:00', 'cats'").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, text string").parquet(f"file://{tmp_path}/in")
    running = index_stream.running_term_counts(stream, "ts")
    running.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    got = spark.sql("select hour(window.start) as h, term, cf from counts").collect()
    assert {tuple(r) for r in got} == {(0, "cats", 1), (0, "run", 1), (1, "cats", 1)}


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def words_by_hand(text):
    return [w for w in re.findall(r"[a-z]+(?:[-'][a-z]+)*", fold(text.lower())) if 2 <= len(w) <= 25 and w not in corpus.STOP]


def typed_terms_by_hand(text):
    return [t for (ty, t), n in typed_by_hand(text).items() for _ in range(n) if len(t) >= 2 and (ty in ("url", "email", "proper") or len(t) <= 25) and t not in corpus.STOP]


def term_stats_of(docs, analyze):
    cf, df = Counter(), Counter()
    for _, text in docs:
        tf = Counter(analyze(text))
        cf.update(tf)
        df.update(set(tf))
    return {t: (n, df[t]) for t, n in cf.items()}


def test_term_statistics_of_other_analyzers(spark):
    docs, folder = documents(spark), "/root/testdata/sf0.001"
    got = {r["term"]: (r["cf"], r["df"]) for r in QUERIES["q_term_stats_typed"](spark, folder).collect()}
    assert got == term_stats_of(docs, typed_terms_by_hand)
    got = {r["stem"]: (r["cf"], r["df"]) for r in QUERIES["q_term_stats_snowball"](spark, folder).collect()}
    assert got == term_stats_of(docs, lambda t: [s for w in re.findall(r"[a-z]+(?:[-'][a-z]+)*", fold(t.lower())) if 2 <= len(s := stem.spanish_stem(w)) <= 25 and s not in corpus.STOP])
    words = {w for _, t in docs for w in re.findall(r"[a-z]+(?:[-'][a-z]+)*", t.lower())}
    p, q = {w: stem.porter_stem(w) for w in words}, {w: stem.lancaster_stem(w) for w in words}
    equal = sum(p[w] == q[w] for w in words)
    got = QUERIES["q_stem_compare"](spark, folder).first()
    assert (got["n_words"], got["porter_stems"], got["lancaster_stems"], got["n_equal"], got["n_different"]) == (len(words), len(set(p.values())), len(set(q.values())), equal, len(words) - equal)


def topics_of(spark):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]


def ranked_by_hand(scores, k):
    out = {}
    for qid, by_doc in scores.items():
        for r, (d, s) in enumerate(sorted(by_doc.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]):
            out[qid, r] = (d, round(s, 6))
    return out


def test_rankings_of_other_analyzers(spark):
    docs, topics, folder = documents(spark), topics_of(spark), "/root/testdata/sf0.001"
    tf = {d: Counter(typed_terms_by_hand(t)) for d, t in docs}
    df = Counter(t for c in tf.values() for t in c)
    weight = lambda c: {t: (1 + math.log(n)) * math.log(len(docs) / df[t]) for t, n in c.items() if t in df and df[t] < len(docs)}
    vectors = {d: weight(c) for d, c in tf.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    scores = {}
    for qid, text in topics:
        q = weight(Counter(typed_terms_by_hand(text)))
        scores[qid] = {d: s / (length(v) * length(q)) for d, v in vectors.items() if (s := sum(x * v.get(t, 0) for t, x in q.items())) > 0}
    got = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in QUERIES["q_vsm_cosine_typed"](spark, folder).collect()}
    assert got == ranked_by_hand(scores, 10)
    stems = lambda t: [stem.porter_stem(w) for w in words_by_hand(t)]
    tf = {d: Counter(stems(t)) for d, t in docs}
    df, dl, n = Counter(t for c in tf.values() for t in c), {d: sum(c.values()) for d, c in tf.items()}, len(docs)
    avdl, scores = sum(dl.values()) / n, {}
    for qid, text in topics:
        q = Counter(stems(text))
        scores[qid] = {
            d: sum(c[t] * 9 * k / ((8 + k) * (1.2 * (0.25 + 0.75 * dl[d] / avdl) + c[t])) * math.log2((n - df[t] + 0.5) / (df[t] + 0.5)) for t, k in q.items() if t in c)
            for d, c in tf.items() if set(q) & set(c)
        }
    got = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in QUERIES["q_rank_bm25_stemmed"](spark, folder).collect()}
    assert got == ranked_by_hand(scores, 50)


def test_heaps_fit_is_least_squares(spark):
    folder = "/root/testdata/sf0.001"
    curve = [(r["n"], r["v"]) for r in QUERIES["q_heaps_curve"](spark, folder).collect()]
    n, v = np.array(sorted(curve), dtype=float).T
    fit = QUERIES["q_heaps_fit"](spark, folder).first()
    loss = lambda k, b: float(((v - k * n**b) ** 2).sum())
    best = loss(fit["k"], fit["beta"])
    assert all(loss(fit["k"] * (1 + x), fit["beta"] + y) >= best * (1 - 1e-9) for x in (-1e-3, 0, 1e-3) for y in (-1e-3, 0, 1e-3))
    assert abs(fit["r2"] - (1 - best / float(((v - v.mean()) ** 2).sum()))) < 1e-5


def test_stream_of_documents(spark, tmp_path):
    spark.createDataFrame([(1, "cats run"), (2, "cats sleep")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"file://{tmp_path}/in")
    index_stream.append_postings(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination(60)
    got = spark.read.parquet(f"file://{tmp_path}/out").groupBy("term").agg(F.count("*").alias("df")).collect()
    assert {r["term"]: r["df"] for r in got} == {"cats": 2, "run": 1, "sleep": 1}


def test_points_of_the_curve_are_made_in_passing(spark, monkeypatch):
    monkeypatch.setattr(corpus, "POINTS_AT_ONCE", 3)
    texts = {3: "aa bb x aa cc", 1: "bb dd", 2: "", 7: None, 5: "aa bb", 9: "ee aa ff ff"}
    table = corpus.heaps_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).coalesce(1)
    assert sorted((r["n0"], r["m"], r["v0"], tuple(r["new"])) for r in table.collect()) == [
        (0, 2, 0, (0, 1)), (2, 0, 2, ()), (2, 4, 2, (0, 3)), (6, 2, 4, ()), (8, 0, 4, ()), (8, 4, 4, (0, 2)),
    ]
    curve = corpus.heaps_curve(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(tuple(r) for r in curve.collect()) == list(zip(range(1, 13), [1, 2, 3, 3, 3, 4, 4, 4, 5, 5, 6, 6]))
