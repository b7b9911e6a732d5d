"""Source divergence, lexical search and inner-product search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tabflow.llm import inner_product_search, lexical_search, source_divergence
from tabflow.llm.words import LETTERS, LETTERS_AND_DIGITS, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTER_RUNS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD_RUNS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def test_words_equal_the_patterns():
    r = random.Random(2)
    alphabet = [chr(i) for i in range(128)] + list("ÀßéİıſK漢😀  \u0085")
    for _ in range(500):
        text = "".join(r.choices(alphabet, k=r.randint(0, 60)))
        assert [w.decode() for w in words(text, LETTERS)] == LETTER_RUNS.findall(text.translate(LOWER))
        assert [w.decode() for w in words(text, LETTERS_AND_DIGITS)] == WORD_RUNS.findall(text.translate(LOWER))
    assert words(None, LETTERS) == []


# ---------------------------------------------------------------- divergence
def audit_by_hand(rows, min_docs=10, top=10):
    groups, langs, df = {}, {}, {}
    for _, text, lang, source, *_ in rows:
        found = LETTER_RUNS.findall((text or "").translate(LOWER))
        groups.setdefault((lang or "", source or ""), Counter()).update(found)
        langs.setdefault(lang or "", Counter()).update(found)
        df.setdefault(lang or "", Counter()).update(set(found))
    out = []
    for lang, total in langs.items():
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)

        def shares(count):
            whole = sum(count[t] for t in kept) + 2 * len(kept)
            return [1 + 1_000_000_000 * (count[t] + 2) // whole for t in kept]

        q = shares(total)
        mine = {s: shares(c) for (g, s), c in groups.items() if g == lang}
        for s, p in mine.items():
            pairs = [(sum((a - b) ** 2 // (a + b) for a, b in zip(p, o)), x) for x, o in mine.items() if x != s]
            terms = [((a - b) ** 2 // (a + b), t) for a, b, t in zip(p, q, kept) if groups[lang, s][t] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(64, 4096), (2, 5)])
def test_audit_equals_hand_count(spark, odd, blocks):
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdé漢" for b in ("x", "Yy", "z😀", "ß")]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 30))) + "-9", r.choice(["en", "fr", None]),
             r.choice(["s1", "s2", "s3", "s4", "", None, "é", "Z"]), 0) for i in range(160)]
    rows += [(500, None, "de", "a", 0), (501, "solo", "de", "b", 0), (502, None, "it", None, 0)]
    rows += [tuple(x[:5]) for x in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    for name in ("term", "n", "part", "value", "side"):
        df = df.withColumn(name, df["lang"])
    got = source_divergence.audit(df, group_block=blocks[0], term_block=blocks[1]).collect()
    assert sorted(tuple(x) for x in got) == audit_by_hand(rows)


def test_audit_of_nothing(no_docs):
    assert source_divergence.audit(no_docs).collect() == []


def test_shares_beyond_plain_products():
    n = np.array([0, 5, 10 ** 11, 3 * 10 ** 14], np.int64)
    whole = int(n.sum())
    assert source_divergence.shares(n, whole, 4).tolist() == [1 + 10 ** 9 * (x + 2) // (whole + 8) for x in n.tolist()]


# ------------------------------------------------------------ lexical search
def search_by_hand(docs, items, k=10):
    found = [(i, WORD_RUNS.findall((t or "").translate(LOWER))) for i, t in docs]
    found = [(i, w, Counter(w)) for i, w in found if w]
    n_docs, total = len(found), sum(len(w) for _, w, _ in found)
    df = Counter(t for _, _, c in found for t in c)
    out = []
    for item, text in items:
        terms = set(WORD_RUNS.findall((text or "").translate(LOWER)))
        scores = []
        for doc, w, tf in found:
            m = 100 - 90 + 90 * len(w) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
                    for t in terms if t in tf)
            if s > 0:
                scores.append((-s, doc is None, doc))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_docs": 20, "block_postings": 90, "leaf": 2, "batch_terms": 12}])
def test_search_equals_hand_scores(spark, odd, sizes):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "漢字", "7up"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 25)))) for i in range(200)]
    docs += [(1000 + i, "w1 w2 w3 w3") for i in range(40)] + [(77, "w1 w2 w3 w3"), (77, "w1 w2 w3 w3"), (None, "w1 w2 w3 w3")]
    docs += [tuple(x) for x in odd.select("doc_id", "text").collect()]
    items = [(1, "w1 w2 w3"), (2, "w5 W5 été"), (3, None), (4, ""), (5, "no such 漢字 7UP"), (None, "w9 w1"), (1, "w30 w31 w32 w33"),
             (6, " ".join(vocabulary)), (7, "alpha word")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    for name in ("item", "n", "idx", "rank", "score"):
        df, it = df.withColumn(name, df["text"]), it.withColumn(name, it["text"])
    got = lexical_search.search(df, it, **sizes)
    assert sorted(((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in got.collect()), key=str) == search_by_hand(docs, items)


def test_search_of_nothing(spark, no_docs):
    it = spark.createDataFrame([(1, "word")], "item_id long, text string")
    some = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert lexical_search.search(no_docs, it).collect() == []
    assert lexical_search.search(some, it.limit(0)).collect() == []


def test_balls_prune_clustered_documents():
    """Bounds hold for every document, and far clusters are never scored."""
    r = np.random.default_rng(3)
    rows = []
    for c in range(8):
        for _ in range(64):
            idx = np.sort(r.choice(np.arange(c * 30, c * 30 + 30), 20, replace=False))
            rows.append((idx, r.integers(400_000, 1_000_000, 20)))
    tree_row = lexical_search._tree_row(list(range(len(rows))), [i for i, _ in rows], [v for _, v in rows], 16)
    import pyarrow as pa
    kinds = {"doc_ids": pa.int64()}
    tree = lexical_search.Tree({c: pa.array(v, kinds.get(c)) if c == "doc_ids" else np.asarray(v) for c, v in tree_row.items()})
    terms = np.arange(0, 12)
    q = tree.weights([(terms, np.full(12, 3000))])
    bound = tree.bounds(q)
    scored = []
    whole = tree.leaf_scores
    tree.leaf_scores = lambda node, w: scored.append(node) or whole(node, w)
    best = tree.search(q[0], bound[:, 0], 10, 1)
    exact = np.array([sum(3000 * v for i, v in zip(idx, val) if i < 12) for idx, val in rows])
    assert [s for s, _ in best] == sorted(exact.tolist(), reverse=True)[:10]
    assert len(scored) <= (tree.left < 0).sum() / 4, len(scored)
    for node in range(len(tree.first)):
        inside = [tree_row["doc_ids"][i] for i in range(tree.first[node], tree.last[node])]
        assert bound[node, 0] >= exact[inside].max()


# ------------------------------------------------------ inner-product search
def top_by_hand(vectors, k=5, step=50):
    good = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in vectors
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i is None or i % step:
            continue
        scores = sorted(((-int(q @ x), j is None, j or 0) for b, (j, x) in enumerate(good) if a != b and len(x) == len(q)))
        out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["clusters", "spread", "odd"])
def test_top_k_equals_brute_force(spark, kind):
    r = np.random.default_rng(11)
    if kind == "clusters":
        centres = r.normal(size=(12, 16)) * 4
        rows = [(i, (centres[i % 12] + 0.05 * r.normal(size=16)).tolist()) for i in range(900)]
    elif kind == "spread":
        rows = [(i, r.normal(size=24).tolist()) for i in range(700)]
    else:
        same = [0.5, -0.25, 1.0]
        rows = [(i, same) for i in range(300)] + [(i, [float(i % 7), 1.0, -1.0]) for i in range(300, 400)]
        rows += [(400, None), (450, [1.0, None, 2.0]), (500, [float("nan")] * 3), (550, [float("inf"), 0.0, 0.0]), (600, []), (650, []),
                 (700, [1.0]), (750, [2.0, 3.0]), (800, [0.0, 0.0, 0.0]), (0, same), (None, same), (None, [9.0, 9.0, 9.0]), (850, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for name in ("row", "dim", "block", "cell", "x", "score"):
        df = df.withColumn(name, df["vec_id"])
    got = inner_product_search.search(df, data_block=64, query_block=5, leaf=8)
    assert sorted(((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got.collect()), key=str) == top_by_hand(rows)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert inner_product_search.search(df).collect() == []


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large for exact inner products"):
        inner_product_search.search(df).collect()


def test_cover_tree_covers_and_prunes():
    r = np.random.default_rng(4)
    x = np.floor(256 * (r.normal(size=(10, 8))[r.integers(0, 10, 600)] + 0.02 * r.normal(size=(600, 8))))
    order, first, last, middle, reach, child, children = inner_product_search.cover_tree(x, 16)
    assert sorted(order.tolist()) == list(range(600))
    for a in range(len(first)):
        inside = x[order[first[a]:last[a]]]
        assert np.sqrt(((inside - x[order[middle[a]]]) ** 2).sum(axis=1)).max() <= reach[a]
        kids = range(child[a], child[a] + children[a])
        if children[a]:
            assert first[kids[0]] == first[a] and last[kids[-1]] == last[a]
            assert all(last[b] == first[b + 1] for b in kids[:-1])
            assert all(reach[b] <= reach[a] / 2 * (1 + 1e-6) or last[b] - first[b] <= 16 for b in kids)
