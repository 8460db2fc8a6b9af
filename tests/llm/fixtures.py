"""Small documents with every awkward case, and brute-force counterparts."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return.
CLASHING = ("__d", "__l", "__h", "__row", "__text", "__dropped", "__at", "__chunk", "__gone", "a", "b", "rep", "n_removed", "toxicity", "is_toxic", "bytes", "shard_id", "piece", "bin_id", "x.y")


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed=3, n=60):
    """Random texts, exact and near copies, shared passages and lines; ids from 0."""
    rng = random.Random(seed)
    texts = []
    passage = " ".join(words(70, 999))
    for i in range(n):
        w = words(rng.randrange(5, 160), seed * 1000 + i)
        if i % 7 == 3 and texts:
            w = texts[rng.randrange(len(texts))].split()
            w[rng.randrange(len(w))] = "changed"
        if i % 11 == 5 and texts:
            w = texts[rng.randrange(len(texts))].split()
        if i % 9 == 4:
            at = rng.randrange(len(w))
            w = w[:at] + passage.split() + w[at:]
        lines = [" ".join(w[k : k + 12]) for k in range(0, len(w), 12)]
        if i % 2:
            lines.insert(rng.randrange(len(lines) + 1), "Shared   FOOTER line")
        texts.append("\n".join(lines))
    return [(i, t, "en", f"site{i % 14}", len(t)) for i, t in enumerate(texts)]


def awkward():
    """documents() with nulls in every column, empty, blank and very long texts, and repeated rows."""
    rows = documents()
    long = " ".join(words(30_000, 5))
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " \n\t ", "en", "s", 4), (103, long, "en", "s", len(long)), (104, long, None, None, None)]
    rows += [(None, rows[5][1], "en", "site1", 1), (None, None, None, None, None), rows[7], rows[7], (105, "one", "en", "s", 3), (106, "ünï cödé ß 漢字 \U0001f600", "de", None, 9)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(c).alias(c) for c in CLASHING])


def grams(text, n=3):
    found = re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+", (text or "").lower())
    if not found:
        return set()
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))}


def jaccard_pairs(rows, threshold):
    """{(a, b): similarity} with a < b; the most similar texts of an id count."""
    texts = {}
    for r in rows:
        if r[0] is not None and grams(r[1]):
            texts.setdefault(r[0], []).append(grams(r[1]))
    out = {}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            best = max(len(x & y) / len(x | y) for x in texts[a] for y in texts[b])
            if best >= threshold:
                out[a, b] = best
    return out


def repeated_words(rows, length):
    """{(row, word)} of the words in windows that another document has as well."""
    where = {}
    for i, r in enumerate(rows):
        w = re.split(r"[\t-\r\x1c-\x20]+", r[1].strip("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")) if r[1] and r[1].strip() else []
        for k in range(len(w) - length + 1):
            where.setdefault(tuple(w[k : k + length]), []).append((r[0], i, k))
    covered = set()
    for found in where.values():
        if len({d for d, _, _ in found}) > 1:
            covered |= {(i, k + j) for _, i, k in found for j in range(length)}
    return covered
