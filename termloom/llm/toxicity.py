"""Toxicity by lexicon induction: random walks over a graph of positive pointwise mutual information."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.hashing import U, Block, blocks, bytes_of, give_back, mix, span_hashes
from termloom.llm.jaccard import grams
from termloom.session import materialize

#: Letters: those of ASCII and all characters beyond.
LETTERS = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])
STEMS = (4, 5, 6)
LEXICON = "term string, key long, weight double, cut double"


def features(word: str) -> list[str]:
    """A word of three letters or more and its beginnings, which stand for its inflected and compound forms."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)] if len(word) >= 3 else []


class Words:
    """The words of three letters or more of a block, once a row, where they come first: row, features (0: none) and context.

    keys[:, 0] is a hash of the word, the others are hashes of its beginnings. The context is a hash of the words around it.
    """

    def __init__(self, block: Block):
        lead = (block.data & 0xC0) != 0x80
        at, number = np.append(np.flatnonzero(lead), len(block.data)), np.cumsum(lead) - 1
        first = number[block.starts]
        size = number[block.ends - 1] + 1 - first if len(first) else first
        row = np.searchsorted(block.bounds, np.arange(len(first)), side="right") - 1
        around = np.concatenate((np.zeros(1, U), block.hashes, np.zeros(1, U)))
        inner = row.astype(U)
        before = np.where(np.append(-1, row[:-1]) == row, around[:-2], U(0)) if len(row) else inner
        after = np.where(np.append(row[1:], -1) == row, around[2:], U(0)) if len(row) else inner
        long = np.flatnonzero(size >= 3)
        _, once = np.unique(mix(block.hashes[long] + mix(row[long].astype(U))), return_index=True)
        long = long[np.sort(once)]
        starts, first, size = block.starts[long], first[long], size[long]
        self.block, self.at, self.row, self.long = block, at, row[long], long
        self.context = mix(before[long] + mix(after[long] + U(1)))
        self.keys = np.zeros((len(long), 1 + len(STEMS)), dtype=U)
        self.keys[:, 0] = block.hashes[long]
        for c, k in enumerate(STEMS, 1):
            has = np.flatnonzero(size > k)
            self.keys[has, c] = mix(span_hashes(block, starts[has], at[first[has] + k]) + U(k))

    def name(self, word: int, column: int) -> str:
        block, i = self.block, self.long[word]
        text = bytes_of(block, block.starts[i], block.ends[i]).decode("utf-8", "replace")
        return text if not column else f"{text[: STEMS[column - 1]]}*"

    def once(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, column) of the chosen entries of keys, each key once a row, where it comes first."""
        w, c = np.nonzero(chosen & (self.keys != 0))
        _, at = np.unique(mix(self.keys[w, c] + mix(self.row[w].astype(U) + U(3))), return_index=True)
        at = np.sort(at)
        return w[at], c[at]


def words_of(texts: pa.Array | pa.ChunkedArray) -> Iterator[Words]:
    """Blocks of consecutive texts; they are put in lower case and hashed in small runs, for many tasks share a machine's memory."""
    for k in range(0, len(texts), 256):
        lower = pc.utf8_lower(texts.slice(k, 256).cast(pa.large_string()))
        yield from (Words(b) for b in blocks(lower, LETTERS))
    give_back()


def position(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in a sorted array, -1 of what isn't there."""
    if not len(known):
        return np.full(keys.shape, -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where((known[at] == keys) & (keys != 0), at, -1)


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """z-scores of the difference of smoothed log odds of document frequencies."""
    a, b = toxic + 0.5, clean + 0.5
    return (np.log(a / (n_toxic + 1 - a)) - np.log(b / (n_clean + 1 - b))) / np.sqrt(1 / a + 1 / b)


def binomial_tail(hits: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Chernoff's bound of the probability of so many hits or more among n: never too small. Of so few: binomial_tail(n - hits, n, 1 - p)."""
    q = hits / np.maximum(1, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(q > p, q * np.log(q / p), 0) + np.where((q > p) & (q < 1), (1 - q) * np.log((1 - q) / (1 - p)), 0)
    return np.exp(-n * far)


def discoveries(p: np.ndarray, rate: float, tests: int) -> np.ndarray:
    """Which of the least p-values of tests are low, with a share of about rate false ones among them (Benjamini and Hochberg, 1995)."""
    order = np.argsort(p, kind="stable")
    ok = np.flatnonzero(p[order] <= rate * np.arange(1, len(p) + 1) / max(1, tests))
    return p <= p[order[ok[-1]]] if len(ok) else np.zeros(len(p), dtype=bool)


def walk(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray, start: np.ndarray, stay: float = 0.85, steps: int = 60) -> np.ndarray:
    """Probabilities of a walk over a graph of undirected edges (i, j), normalised on both sides, that restarts with the probabilities of start."""
    x, y, w = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((weight, weight))
    degree = np.sqrt(np.maximum(np.bincount(x, w, n), 1e-12))
    p = start
    for _ in range(steps):
        p = stay * np.bincount(x, w * (p / degree)[y], n) / degree + (1 - stay) * start
    return p


def first_copies(texts: pa.Array | pa.ChunkedArray, coords: int = 32) -> np.ndarray:
    """Marks the texts that share no two consecutive MinHash values of their word trigrams with one before.

    The words of a toxic text that was copied many times would all look toxic.
    """
    first, seen, rng = np.ones(len(texts), dtype=bool), set(), np.random.default_rng(9)
    odd = rng.integers(0, 2**63, coords, dtype=U) * U(2) + U(1)
    for row, bounds, g, _ in grams(texts, 3):
        rows = np.flatnonzero(np.diff(bounds))
        if not len(rows):
            continue
        least = np.stack([np.minimum.reduceat(mix(g * a), bounds[:-1][rows]) for a in odd], axis=1)
        keys = mix(least[:, ::2] + mix(least[:, 1::2] + np.arange(coords // 2, dtype=U)))
        for r, ks in zip(rows + row, keys.tolist()):
            first[r] = seen.isdisjoint(ks)
            seen.update(ks)
    return first


#: What the labelled sample says of a feature: a seed, toxic or clean, or nothing but that it can't be a candidate.
TOXIC, CLEAN, PLAIN = 1, 2, 3


def find_seeds(texts: pa.Array, toxic: np.ndarray, min_df: int, rate: float, prior: float, clean_share: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """(keys, kinds) of the features in min_df texts or more, copies aside.

    Toxic seeds are the discoveries, by the binomial tail, whose share of toxic documents is above 0.9, with other words around them in most
    documents, and for a beginning with documents that aren't mostly those of one word; clean seeds are words in clean_share of the texts that don't lean to toxic ones.
    Plain features are those of which the labels show that less than half of their documents are toxic, where prior is the share of all labelled ones.
    """
    first = first_copies(texts)
    n_toxic, n_clean = int((toxic & first).sum()), int((~toxic & first).sum())
    if not n_toxic or not n_clean:
        return np.empty(0, U), np.empty(0, np.int64)

    def entries():
        """Each block's words, and the (word, column, text) of features in texts that are no copies."""
        at = 0
        for ws in words_of(texts):
            w, c = ws.once(first[at + ws.row][:, None] & np.ones(ws.keys.shape, dtype=bool))
            yield ws, w, c, at + ws.row[w]
            at += len(ws.block.bounds) - 1

    keys, flags = [np.empty(0, U)], [np.empty(0, np.uint8)]
    for ws, w, c, row in entries():
        keys.append(ws.keys[w, c])
        flags.append(toxic[row].astype(np.uint8) + 2 * (c == 0).astype(np.uint8))
    keys, flags = np.concatenate(keys), np.concatenate(flags)
    counted = []
    for part in range(16):  # ranges of keys, so that no sort is large
        mine = np.flatnonzero(keys >> U(60) == part)
        own, inverse = np.unique(keys[mine], return_inverse=True)
        n = [np.bincount(inverse, x, len(own)) for x in (None, flags[mine] & 1, flags[mine] >> 1)]
        ok = n[0] >= min_df
        counted.append((own[ok], n[0][ok], n[1][ok], n[2][ok] > 0))
    terms, df, df_toxic, is_word = (np.concatenate(x) for x in zip(*counted))
    del keys, flags
    z = log_odds(df_toxic, df - df_toxic, n_toxic, n_clean)
    a, b = (df_toxic + 0.5) / n_toxic, (df - df_toxic + 0.5) / n_clean
    odds = (1 - prior) / prior * n_toxic / n_clean
    half = odds / (1 + odds)  # the share of toxic documents that a term of half toxic ones has in the sample
    kind = np.where(binomial_tail(df - df_toxic, df, 1 - half) < 0.05, PLAIN, 0)
    kind[is_word & (z < 1) & (df >= clean_share * (n_toxic + n_clean))] = CLEAN
    p = binomial_tail(df_toxic, df, n_toxic / (n_toxic + n_clean))
    found = np.flatnonzero(discoveries(p, rate, len(p)) & (a / (a + b) > 0.9))
    contexts, words = [np.empty((2, 0), U)], [np.empty((2, 0), U)]
    for ws, w, c, row in entries():
        at = position(ws.keys[w, c], terms[found])
        hit = np.flatnonzero(at >= 0)
        contexts.append(np.stack([at[hit].astype(U), ws.context[w[hit]]]))
        hit = hit[toxic[row[hit]]]
        words.append(np.stack([at[hit].astype(U), ws.keys[w[hit], 0]]))
    around = np.bincount(np.unique(np.concatenate(contexts, axis=1), axis=1)[0].astype(np.int64), minlength=len(found))
    pairs, n = np.unique(np.concatenate(words, axis=1), axis=1, return_counts=True)
    most = np.zeros(len(found))
    np.maximum.at(most, pairs[0].astype(np.int64), n)
    kind[found[(around >= 0.5 * df[found]) & (is_word[found] | (most <= 0.5 * df_toxic[found]))]] = TOXIC
    return terms[kind > 0], kind[kind > 0]


def near_seeds(toxic: np.ndarray, plain: np.ndarray):
    """A mapInArrow function: (key, word, context, text) of features in documents with a toxic seed, and of all documents.

    Features of a word that has a seed itself, and plain ones, aren't listed. text is a hash of the whole text. Rows of key 0 stand for
    the documents with a seed, of key 1 for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ws in words_of(batch.column(0)):
                seeded = (position(ws.keys, toxic) >= 0).any(axis=1)
                text = np.zeros(len(ws.block.bounds) - 1, dtype=U)
                np.add.at(text, ws.row, mix(ws.keys[:, 0] + ws.context))
                has = np.bincount(ws.row, seeded, len(text)) > 0
                w, c = ws.once((has[ws.row] & ~seeded)[:, None] & (position(ws.keys, plain) < 0))
                zeros, ones = np.zeros(int(has.sum()), U), np.ones(len(text), U)
                columns = (np.concatenate((ws.keys[w, c], zeros, ones)), np.concatenate((ws.keys[w, 0], zeros, ones)), np.concatenate((ws.context[w], text[has], text)), np.concatenate((text[ws.row[w]], text[has], text)))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names=["key", "word", "context", "text"])

    return run


def contexts_of(known: np.ndarray, toxic: np.ndarray):
    """A mapInArrow function: (key, context) of the known features of words without a toxic seed in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ws in words_of(batch.column(0)):
                free = (position(ws.keys, toxic) < 0).all(axis=1)
                w, c = ws.once(free[:, None] & (position(ws.keys, known) >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(ws.keys[w, c].view(np.int64)), pa.array(ws.context[w].view(np.int64))], names=["key", "context"])

    return run


def meetings(nodes: np.ndarray, clean: np.ndarray):
    """A mapInArrow function: (i, j, context, n, name) of nodes, by number, that stand in one document.

    clean marks nodes: two of these make no edge, and their own documents (i = j) are counted at once, n, without contexts. Features of one word don't meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named: set[int] = set()
        for batch in batches:
            for ws in words_of(batch.column(0)):
                at = position(ws.keys, nodes)
                w, c = ws.once(at >= 0)
                node, row, context = at[w, c], ws.row[w], ws.context[w]
                plain = clean[node]
                counts = np.bincount(node[plain], minlength=len(nodes))
                some = np.flatnonzero(counts)
                rare = np.flatnonzero(~plain)
                own_names = []
                for k in rare:
                    own_names.append(None if int(node[k]) in named else ws.name(w[k], c[k]))
                    named.add(int(node[k]))
                size = np.bincount(row, minlength=len(ws.block.bounds) - 1)
                begin = np.cumsum(size) - size
                reach = size[row[rare]]
                x = np.repeat(rare, reach)
                order = np.argsort(row, kind="stable")  # words come by row already, columns of a word stand together
                y = order[np.repeat(begin[row[rare]], reach) + np.arange(len(x)) - np.repeat(np.cumsum(reach) - reach, reach)]
                ok = (w[x] != w[y]) & (plain[y] | (node[x] < node[y]))
                x, y = x[ok], y[ok]
                both = mix(context[x] + mix(context[y] + U(5)))
                swap = node[x] > node[y]
                i, j = np.where(swap, node[y], node[x]), np.where(swap, node[x], node[y])
                none = [None] * len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((some, node[rare], i))), pa.array(np.concatenate((some, node[rare], j))),
                        pa.array(np.concatenate((np.zeros(len(some), U), context[rare], both)).view(np.int64)),
                        pa.array(np.concatenate((counts[some], np.zeros(len(rare) + len(x), np.int64)))),
                        pa.array([None] * len(some) + own_names + none, type=pa.string()),
                    ],
                    names=["i", "j", "context", "n", "name"],
                )

    return run


def polarity(i: np.ndarray, j: np.ndarray, n: np.ndarray, total: int, kinds: np.ndarray) -> np.ndarray:
    """Weights of nodes: log of the ratio of their probabilities in walks from the toxic and from the clean seeds.

    n of (i, i): documents of a node; of (i, j): of both. Edges are positive pointwise mutual information. A walk restarts at its seeds in
    proportion to their documents, so that a language with many inflected seeds weighs no more than its share of the documents.
    """
    df = np.ones(len(kinds))
    df[i[i == j]] = np.maximum(1, n[i == j])
    edge = i != j
    i, j, n = i[edge], j[edge], n[edge]
    ppmi = np.maximum(0, np.log(n * float(total) / (df[i] * df[j]))) if len(i) else np.zeros(0)
    starts = [np.where(kinds == k, df, 0) for k in (TOXIC, CLEAN)]
    walks = [walk(len(kinds), i, j, ppmi, s / s.sum()) + 1e-9 / len(kinds) for s in starts]
    return np.log(walks[0] / walks[1])


def score_texts(texts: pa.Array | pa.ChunkedArray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text the sum over its distinct words of the largest weight of their features; keys are sorted."""
    out, value = [np.zeros(0)], np.append(weights, 0.0)
    for ws in words_of(texts):
        out.append(np.bincount(ws.row, value[position(ws.keys, keys)].max(axis=1), len(ws.block.bounds) - 1))
    return np.concatenate(out)


def cut_for(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best F1 on held-out documents, in the middle of its gap."""
    order = np.argsort(-scores, kind="stable")
    s, t = scores[order], toxic[order]
    hits = np.cumsum(t)
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + max(1, t.sum()))
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores aren't separated
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_toxic: int, sample_clean: int) -> tuple[DataFrame, float]:
    """The share of toxic labels, and (doc_id, text, t, held) of about sample_toxic and sample_clean labelled documents, taken by hash of doc_id; a quarter is held out."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).alias("t"))
    n = {r["t"]: r["count"] for r in marks.groupBy("t").count().collect()}
    odds = F.when(F.col("t"), min(1.0, sample_toxic / max(1, n.get(True, 0)))).otherwise(min(1.0, sample_clean / max(1, n.get(False, 0))))
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(1 << 30))
    marks = marks.filter(place(9) < odds * (1 << 30)).withColumn("held", place(10) < (1 << 28))
    known = docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sample = materialize(known.join(F.broadcast(marks), "doc_id"), "sample")  # bounded by the sample sizes
    return sample, min(0.5, max(1, n.get(True, 0)) / max(1, sum(n.values())))


def signed(keys: np.ndarray) -> list[int]:
    return keys.view(np.int64).tolist()


def toxic_lexicon(
    docs: DataFrame, labels: DataFrame, sample_toxic: int = 3000, sample_clean: int = 6000, min_df: int = 5, support: float = 0.001, rate: float = 0.001, min_weight: float = 0.5
) -> DataFrame:
    """(term, key, weight, cut): polarity weights of terms, and the score from which a document is toxic. key is the hash of the term.

    1. A sample of about sample_toxic and sample_clean labelled documents, the only bound, gives seed terms in one task: toxic ones by their share of toxic documents,
       clean ones by frequency. Terms are words and beginnings of words.
    2. Over all documents, terms are counted in those with a toxic seed. Terms in support of these, and in min_df at least, are counted in all
       documents, and those that favour documents with a seed (discoveries at a false rate of rate, half of their documents or more) become candidates, labelled or
       not. Copies count once: a term's documents are told apart by the words around it, and a term isn't a candidate if those are the same in
       most of its texts, as in groups of near copies.
    3. Over all documents, the seeds and candidates that stand in one document are counted. Positive pointwise mutual information makes them a
       graph, and two walks with restart, from the toxic and from the clean seeds, give each toxic seed and candidate a weight; those of min_weight or more stay.
    4. The cut has the best F1 on a quarter of the sample that step 1 doesn't see.

    The number of candidates is bounded by support, whatever the corpus: a document with a seed has so many terms, and each candidate is in 1 of 1,000 of them.
    Null texts and null labels don't count; rows of labels that repeat a doc_id are toxic if one is; repeated documents count once.
    Terms that are as significant as the last discovery are all kept. Without documents of both labels, without seeds and for empty tables the lexicon is empty.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    none = spark.createDataFrame([], LEXICON)
    sample, prior = labelled_sample(docs, labels, sample_toxic, sample_clean)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        keys, kinds = find_seeds(table.column("text"), table.column("t").to_numpy().astype(bool), min_df, rate, prior)
        return pa.table({"key": keys.view(np.int64), "kind": kinds.astype(np.int64)})

    rows = sample.filter("not held").groupBy(F.lit("all")).applyInArrow(fit, "key long, kind long").toArrow()
    keys, kinds = rows.column("key").to_numpy().view(U), rows.column("kind").to_numpy()
    of = lambda k: np.sort(keys[kinds == k])
    toxic, clean, plain = of(TOXIC), of(CLEAN), np.sort(keys[kinds != TOXIC])
    if not len(toxic) or not len(clean):
        return none
    texts = docs.filter("text is not null").select("text")
    met = texts.mapInArrow(near_seeds(toxic, plain), "key long, word long, context long, text long").distinct()
    met = met.groupBy("key", "word", "context").agg(F.count("*").alias("texts")).groupBy("key", "word").agg(F.count("*").alias("n"), F.sum("texts").alias("texts"))
    met = met.groupBy("key").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"), F.max("n").alias("most"), F.max(F.col("key") != F.col("word")).alias("stem"))
    met = materialize(met, "near")
    counts = {r["key"]: r["n"] for r in met.filter("key in (0, 1)").collect()}
    near, total = counts.get(0, 0), counts.get(1, 0)
    common = met.filter("key not in (0, 1)").filter(F.col("n") >= max(min_df, support * near)).filter("not stem or most <= 0.5 * n").filter("n >= 0.5 * texts").select("key", "n")
    common = common.toArrow()  # bounded by support
    known = common.column("key").to_numpy().view(U)
    every = texts.mapInArrow(contexts_of(np.sort(known), toxic), "key long, context long").distinct().groupBy("key").agg(F.count("*").alias("df")).toArrow()
    df = dict(zip(every.column("key").to_pylist(), every.column("df").to_pylist()))
    a, d = common.column("n").to_numpy().astype(float), np.array([df.get(k, 1) for k in signed(known)], dtype=float)
    p = min(0.5, max(near, 1) / max(1, total))
    extra = known[discoveries(binomial_tail(a, d, p), rate, met.count()) & (a >= 0.5 * d)]
    nodes = np.sort(np.concatenate((toxic, clean, extra)))
    kind = np.zeros(len(nodes), dtype=np.int64)
    kind[position(toxic, nodes)], kind[position(clean, nodes)] = TOXIC, CLEAN
    pairs = texts.mapInArrow(meetings(nodes, kind == CLEAN), "i long, j long, context long, n long, name string")
    pairs = pairs.groupBy("i", "j", "context").agg(F.sum("n").alias("n"), F.max("name").alias("name"))
    pairs = pairs.groupBy("i", "j").agg(F.sum(F.greatest("n", F.lit(1))).alias("n"), F.max("name").alias("name"))

    def weigh(table: pa.Table) -> pa.Table:
        i, j, n = (table.column(c).to_numpy() for c in "ijn")
        weight = polarity(i, j, n, total, kind)
        names = {x: t for x, y, t in zip(i.tolist(), j.tolist(), table.column("name").to_pylist()) if x == y}
        keep = np.flatnonzero((kind != CLEAN) & (weight >= min_weight))
        keep = keep[[names.get(int(k)) is not None for k in keep]]
        return pa.table([[names[int(k)] for k in keep], nodes[keep].view(np.int64), weight[keep]], names=["term", "key", "weight"])

    lexicon = materialize(pairs.groupBy(F.lit("all")).applyInArrow(weigh, "term string, key long, weight double"), "lexicon")
    found = lexicon.toArrow()
    if not len(found):
        return none
    held = sample.filter("held").select("text", "t")
    held = (held if held.limit(1).count() else sample.select("text", "t")).toArrow()  # bounded by the sample sizes
    cut = cut_for(score_texts(held.column("text"), *sorted_weights(found)), held.column("t").to_numpy().astype(bool))
    return lexicon.withColumn("cut", F.lit(cut))


def sorted_weights(lexicon: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, weights = lexicon.column("key").to_numpy().view(U), lexicon.column("weight").to_numpy()
    order = np.argsort(keys)
    return keys[order], weights[order]


def score_toxicity(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """docs with toxicity (double) and is_toxic; null and empty texts score 0, and nothing is toxic at 0.

    Whole texts are scored, batch by batch. Input columns of these two names are replaced. The lexicon is bounded (see toxic_lexicon); an empty one finds nothing.
    Repeated rows and null ids are scored like others; equal scores are treated alike. An empty table gives no rows.
    """
    rows = lexicon.toArrow()
    keys, weights = sorted_weights(rows)
    cut = max(rows.column("cut").to_pylist(), default=float("inf"))

    @F.arrow_udf("double")
    def toxicity(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(score_texts(t, keys, weights))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("toxicity", "is_toxic")]
    scored = docs.select(*kept, toxicity("text").alias("toxicity"))
    return scored.withColumn("is_toxic", (F.col("toxicity") >= cut) & (F.col("toxicity") > 0))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't toxic, with the columns of docs; a lexicon is induced from docs and labels first.

    Repeated rows are scored each; rows of labels that repeat a doc_id count as toxic if one is. Null doc_id: scored like any.
    An empty table gives an empty table.
    """
    lexicon = toxic_lexicon(docs, labels)
    scored = score_toxicity(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text"), lexicon)
    return scored.filter(~F.col("is_toxic")).select("__row.*")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, toxicity and is_toxic of all documents."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, toxic_lexicon(docs, labels)).select("doc_id", "toxicity", "is_toxic")
