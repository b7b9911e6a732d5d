"""Corpus operators: archives, toxicity, near duplicates, decontamination, components."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.llm import arc_warc, decontaminate, itq, ngram_join, toxicity
from tabflow.llm.common import connected_components
from tabflow.session import scratch_path

from conftest import SF001  # noqa: F401


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def union(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


# ---------------------------------------------------------------- components
@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components_equal_union_find(spark, kind):
    r = random.Random(4)
    edges = {"random": [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)], "path": [(i, i + 1) for i in range(60)],
             "star": [(77, i) for i in range(200)], "none": [(5, 5)]}[kind]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        union(parent, a, b)
    want = {x: find(parent, x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["node"]: x["component"] for x in got} == want and len(got) == len(want)


# ---------------------------------------------------------------- archives
PAGES = "page_id long, url string, html string, block string, archive string"


def test_round_trip_and_revisits(spark):
    big, other = "x" * 1500 + "é", "y" * 1000
    rows = [(1, "http://a/1", big, "c", "c"), (2, "http://a/2", big, "c", "c"), (9, "http://a/9", big, "c", "c"),
            (9, "http://a/9", big, "c", "c"), (None, None, big, None, None), (3, "http://a/ 3\n", other, "c", "c"),
            (4, "http://a/4", "short", "c", "c"), (5, "http://a/5", "short", "c", "c"), (6, None, None, None, None),
            (7, "", "", "", ""), (8, "http://a/8", "WARC/1.0\r\n\r\n" + "z" * 2000 + "\r\n\r\nWARC/1.0\r\n", "c", "c"),
            (10, "http://a/10", "line\nHTTP/1.0 200 OK\r\n\r\n" * 4000, "c", "c")]
    df = spark.createDataFrame(rows, PAGES).repartition(4)
    got = sorted(arc_warc.archive_round_trip(df).collect(), key=str)
    want = []
    for k, _, html, *_ in rows:
        body = (html or "").encode()
        top = max((p for p, _, h, *_ in rows if h == html and p is not None), default=None)
        again = len(body) >= 1000 and top is not None and (k is None or k < top)
        want.append((k, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None, True))
    assert [tuple(x) for x in got] == sorted(want, key=lambda t: str(type(got[0])(*t) if False else
                                             f"Row(page_id={t[0]}, payload_bytes={t[1]}, payload_digest={t[2]!r}, record_type={t[3]!r}, "
                                             f"refers_to={t[4]}, digest_ok={t[5]})"))


def test_parse_arc_versions_and_broken_lines():
    one = b"filedesc://f.arc 0.0.0.0 19970101000000 text/plain 76\n1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n"
    body = one.split(b"\n", 1)[1]
    one = one.replace(b" 76\n", b" %d\n" % len(body)) + b"\n"
    data = one + b"http://x/a b 1.2.3.4 19970102030405 text/html 5\nhello\nnot a header\n\nhttp://y/ 1.2.3.4 1997 text/plain 0\n\n"
    got = [(v, h["URL"], h["Archive-date"], bytes(c)) for _, v, h, c in arc_warc.parse_arc(data)]
    assert got == [(1, "http://x/a b", "19970102030405", b"hello"), (1, "http://y/", "1997", b"")]
    assert arc_warc.iso_date("19970102030405") == "1997-01-02T03:04:05Z" and arc_warc.iso_date("1997") == "1997-01-01T00:00:00Z"
    assert arc_warc.iso_date(None) == "1970-01-01T00:00:00Z"
    two = b"2 0 Archive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    data = b"filedesc://g.arc 0.0.0.0 1998 text/plain 200 - - 0 g.arc %d\n" % len(two) + two
    data += b"\nhttp://z/ 1.1.1.1 19980203040506 image/gif 200 abc - 99 g.arc 3\nGIF\n"
    assert [(v, h["Result-code"], bytes(c)) for _, v, h, c in arc_warc.parse_arc(data)] == [(2, "200", b"GIF")]


def test_warc_files_are_well_formed(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    arc_warc.write_arc(pages, arc)
    arc_warc.convert(spark, arc, warc)
    n = ids = 0
    seen = set()
    for f in spark.read.format("binaryFile").load(warc).collect():
        data = zlib.decompressobj(31).decompress(bytes(f["content"]))
        assert data.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo") and data.endswith(b"\r\n\r\n")
        for h, block in arc_warc.parse_warc(data):
            assert len(block) == int(h["content-length"])
            seen.add(h["warc-record-id"])
            ids += 1
            n += h["warc-type"] in ("response", "revisit")
    assert n == pages.count() and len(seen) == ids
    assert arc_warc.read_warc(spark, warc).where("not digest_ok").count() == 0


def test_no_pages(spark):
    assert arc_warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


# ---------------------------------------------------------------- toxicity
def labelled(spark, n=600):
    r = random.Random(8)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.25
        words = [word() for _ in range(r.randint(10, 60))]
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["qxidiom", "zzscab", "wormkin" + word(), "idiot"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(r.random() < 0.5), int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels})


def test_toxicity_held_out_accuracy_and_label_use(spark):
    docs, labels, truth = labelled(spark)
    rows = toxicity.predict(docs, labels).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    # labels of held-out rows have no influence
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.predict(docs, turned).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)


def test_label_model_recovers_rates(spark):
    rng = np.random.default_rng(1)
    n, m = 40_000, 12
    y = rng.random(n) < 0.3
    rate = np.stack([np.full(m, 0.05), np.linspace(0.4, 0.8, m)])
    rate[:, 5] = (0.6, 0.1)  # a voter that speaks for clean
    votes = rng.random((n, m)) < rate[y.astype(int)]
    votes[:, 1] = votes[:, 0]  # a copied voter must not count twice
    label = np.where(np.arange(n) < 400, y, -1)
    counts = {}
    for v, lab in zip(votes, label, strict=True):
        key = (tuple(np.flatnonzero(v).tolist()), int(lab))
        counts[key] = counts.get(key, 0) + 1
    sets = spark.createDataFrame([(list(v), lab, k) for (v, lab), k in counts.items()], "votes array<int>, y int, n long").repartition(3)
    model = toxicity.fit_label_model(sets, m)
    assert np.abs(model.rate - np.stack([votes[~y].mean(0), votes[y].mean(0)])).max() < 0.05
    assert abs(model.prior[1] - 0.3) < 0.03
    assert model.parent[1] == 0 or model.parent[0] == 1
    post = model.posterior(votes.astype(float), np.full(n, -1))
    assert np.mean((post >= 0.5) == y) > 0.95
    # the copy adds next to nothing to what its twin says
    one, both = np.zeros((1, m)), np.zeros((1, m))
    both[0, :2] = 1
    odds = lambda x: float(np.log(model.posterior(x, np.array([-1])) / (1 - model.posterior(x, np.array([-1]))))[0])
    single = np.log(model.rate[1, 0] / model.rate[0, 0] * (1 - model.rate[0, 0]) / (1 - model.rate[1, 0]))
    assert odds(both) - odds(one) < 1.3 * single


def test_posterior_equals_plain_products():
    rng = np.random.default_rng(3)
    given = rng.uniform(0.1, 0.9, (2, 2, 4))
    model = toxicity.LabelModel(4, np.array([0.7, 0.3]), given[:, 0], np.array([-1, 0, 0, 2]), given)
    x = np.array([[k >> j & 1 for j in range(4)] for k in range(16)], float)
    for label in (-1, 0, 1):
        got = model.posterior(x, np.full(16, label))
        for row, p in zip(x, got, strict=True):
            like = []
            for y in (0, 1):
                v = model.prior[y] * (1 if label < 0 else toxicity.TRUTH if label == y else 1 - toxicity.TRUTH)
                for j, up in enumerate((-1, 0, 0, 2)):
                    q = given[y, int(row[up]) if up >= 0 else 0, j]
                    v *= q if row[j] else 1 - q
                like.append(v)
            assert abs(p - like[1] / sum(like)) < 1e-12


def test_toxicity_odd_rows(spark, odd, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.predict(odd, none).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    odd_labels = spark.createDataFrame([(1, None, 1), (1, 0, 0), (None, 1, 1), (2, 1, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.reject(odd, odd_labels)
    assert out.columns == odd.columns and out.count() <= odd.count()
    assert toxicity.predict(no_docs, none).count() == 0


def test_toxicity_lexicon_copies_and_width(spark):
    docs, labels, _ = labelled(spark)
    plain = toxicity.learn_lexicon(docs, toxicity.training_labels(labels))
    r = random.Random(9)
    ordinary = " ".join("".join(r.choice("hjkvwx") + r.choice("aeiou") for _ in range(4)) for _ in range(400))
    # copies of one toxic text are one text: its words are no entries and take no real entry away
    copies = [i for i in range(1000, 1150) if zlib.crc32(str(i).encode()) % 5]
    docs = docs.unionByName(spark.createDataFrame([(i, ordinary) for i in copies], "doc_id long, text string")).repartition(5)
    labels = labels.unionByName(spark.createDataFrame([(i, 0, 1) for i in copies], "doc_id long, quality int, toxic int"))
    got = toxicity.learn_lexicon(docs, toxicity.training_labels(labels))
    assert not {e[2:] for e in got} & {e[2:] for e in toxicity.entries_of(ordinary)}
    assert {"w:qxidiom", "w:zzscab", "w:idiot"} <= set(got) & set(plain)
    # every entry that passes is kept and is a feature
    vile = ["".join(c) for c in zip(*[iter("".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(1200)))] * 6, strict=False)]
    rows = [(i, " ".join([f"t{chr(97 + i % 26)}{chr(97 + i // 26)}", *(vile if i % 2 else [])]), i % 2) for i in range(200)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert {"w:" + w for w in vile} <= set(model.lexicon) and len(model.lexicon) > 400
    assert all(model.weights[model.index["w:" + w]] > 0 for w in vile)


def test_logistic_of_sparse_cells():
    rng = np.random.default_rng(2)
    x = rng.random((300, 40)) * (rng.random((300, 40)) < 0.2)
    y, w = (x[:, :5].sum(1) > 0.5).astype(float), rng.uniform(0.5, 2, 300)
    row, col = np.nonzero(x)
    b = toxicity.fit_logistic(row, col, x[row, col], 40, y, w)
    p = 1 / (1 + np.exp(-(x @ b[:-1] + b[-1])))
    gradient = np.hstack([x, np.ones((300, 1))]).T @ (w / w.sum() * (p - y)) + 1e-3 * np.append(b[:-1], 0)
    assert np.abs(gradient).max() < 1e-7


# ---------------------------------------------------------------- n-gram join
def grams(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_bands_reach_the_recall():
    b, r = ngram_join.choose_bands()
    assert b * r <= ngram_join.MAX_HASHES and 1 - (1 - 0.8 ** r) ** b >= ngram_join.TARGET_RECALL


@pytest.mark.parametrize("block", [512, 5])
def test_join_equals_brute_force(spark, docs, block):
    r = random.Random(6)
    rows = [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()]
    base = rows[7][1].split()[:120]
    for i in range(40):  # near copies of one text
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = f"w{r.randint(0, 9)}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, "two words"), (20_001, "Two, words!"), (20_002, "two word"), (20_003, None), (20_004, "")]
    sets = {i: grams(t) for i, t in rows}
    ids = sorted(sets)
    parent, links = {i: i for i in ids}, dict.fromkeys(ids, 0)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                union(parent, i, j)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in ngram_join.join(df, block=block).collect()}
    assert {i: got[i]["class_id"] for i in ids} == {i: find(parent, i) for i in ids}
    assert {i: got[i]["n_links"] for i in ids} == links
    assert all(got[i]["kept"] == (find(parent, i) == i) for i in ids)


def test_join_odd_rows(odd, no_docs):
    rows = ngram_join.join(odd).collect()
    assert len(rows) == odd.count()
    same = [r for r in rows if r["doc_id"] in (1, 2)]
    assert {(r["class_id"], r["n_links"]) for r in same} == {(1, 2)} and sum(r["kept"] for r in same) == 1
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in rows if r["doc_id"] in (3, 4, 5)} == {(3, 3, 0), (4, 4, 0), (5, 5, 0)}
    out = ngram_join.deduplicate(odd.drop("_row"))
    assert out.columns == odd.drop("_row").columns and out.count() == odd.count() - 2
    assert ngram_join.join(no_docs).count() == 0 and ngram_join.deduplicate(no_docs).count() == 0


# ---------------------------------------------------------------- embeddings
def cosine_truth(rows):
    ids = [r[0] for r in rows]
    parent, links = {i: i for i in ids}, dict.fromkeys(ids, 0)
    fine = {}
    for i, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, float)
            fine[i] = (x / np.linalg.norm(x), label)
    for i in fine:
        for j in fine:
            if j < i and fine[i][1] == fine[j][1] and float(fine[i][0] @ fine[j][0]) >= 0.93:
                links[i] += 1
                links[j] += 1
                union(parent, i, j)
    return links, {i: find(parent, i) for i in ids}


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(60):
        c = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 7))):
            v = c / np.linalg.norm(c) + rng.normal(size=32) * rng.choice([0.0, 0.01, 0.03, 0.06])
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.uniform(0.5, 2)], int(g % 3)))
    hot = rng.normal(size=32)
    rows += [(1000 + i, [float(np.float32(x)) for x in hot + rng.normal(size=32) * 0.05], 1) for i in range(150)]
    n = len(rows)
    rows += [(5000, None, 1), (5001, [0.0] * 32, 1), (5002, [float("nan")] + [1.0] * 31, 1), (5003, [None] + [1.0] * 31, 1),
             (5004, [float("inf")] + [1.0] * 31, 1), (5005, rows[0][1], None), (5006, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).repartition(4)
    got = {r["vec_id"]: r for r in itq.near_duplicates(df).collect()}
    links, parts = cosine_truth(rows)
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(rows) and all(got[i]["n_links"] <= links[i] for i in links)
    assert found >= 0.98 * sum(links.values())
    assert np.mean([got[i]["component_id"] == parts[i] for i in list(links)[:n]]) >= 0.98
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(5000, 5007))


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9])
def test_near_duplicates_recall_at_64_dimensions(spark, share):
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(np.sqrt(share) * unit(rng.normal(size=(1, 64))) + np.sqrt(1 - share) * unit(rng.normal(size=(900, 64))))
    a = x[:300]
    to = rng.normal(size=a.shape)
    to -= (to * a).sum(1, keepdims=True) * a
    x = np.vstack([x, 0.935 * a + np.sqrt(1 - 0.935 ** 2) * unit(to)])
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    same = np.arange(len(x)) % 3
    links = (x @ x.T >= 0.93) & (same[:, None] == same)
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r["n_links"] for r in itq.near_duplicates(df).collect()}
    assert all(got[i] <= links[i].sum() for i in got)
    assert links.sum() >= 600 and sum(got.values()) >= 0.9 * links.sum()


def test_near_duplicates_of_every_dimension(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [0.0, 1.0, 0.0], 1),
            (4, [1.0, 0.0], 1), (5, [2.0, 0.01], 1), (6, [0.0, 1.0], 1), (7, [0.0, 1.0, 0.0], 2), (8, [3.0], 1), (9, [2.0], 1)]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {
        1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True), 7: (0, 7, True),
        8: (1, 8, True), 9: (1, 8, False)}


def test_choice_of_radius():
    assert itq.choose_radius([{"links": 0.95, "random": 0.8}, {"links": 0.97, "random": 0.91}]) == 2
    assert itq.choose_radius([{"links": 0.5}, {"links": 0.7}]) is None
    # a hot group weighs about as much as a vector
    x = np.random.default_rng(4).normal(size=(3000, 64))
    x[::3] = x[0] + 0.01 * x[::3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = itq.spread(x)
    assert w[::3].sum() < 2 and w[1::3].min() == 1


def test_embeddings_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert itq.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    assert itq.near_duplicates(spark.createDataFrame([(1, None, None)], kind)).collect()[0][:] == (1, 0, 1, True)
    rows = itq.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (2, [1.0, 0.0], 2),
                                                      (3, [1.0, 0.0, 0.0], 1)], kind)).collect()
    assert sorted(map(str, [tuple(r) for r in rows])) == sorted(map(str, [
        (1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 0, 2, True), (3, 0, 3, True)]))


# ---------------------------------------------------------------- decontamination
WORD = re.compile(decontaminate.WORD)
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def contamination_truth(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found |= {str(item)} if item is not None else set()
    return (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(words))


def test_contamination_equals_brute_force(spark):
    r = random.Random(9)
    words = ["a", "B", "cc", "é", "É", "7", "d\x00d", "漢"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.randint(13, 30))) for i in range(8)] + [(8, text(4)), (9, "zz"), (10, None), (11, "..."), (None, text(15)), (3, text(14))]
    rows = []
    for i in range(120):
        t = text(r.randint(0, 40))
        if i % 2:
            item = r.choice(items)[1] or ""
            t += r.choice([" ", ", "]) + " ".join(item.split()[r.randint(0, 3):]) + "\n" + text(r.randint(0, 300))
        rows.append((i, t))
    rows += [(500, None), (501, ""), (None, items[0][1]), (502, "... !"), (503, items[0][1] * 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("w", F.lit("k"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: tuple(x)[1:] for x in decontaminate.contamination(docs, bench).collect()}
    want = {i: contamination_truth(t, items) for i, t in rows}
    assert got == want
    left = {x["doc_id"] for x in decontaminate.remove_documents(docs, bench).collect()}
    assert left == {i for i, w in want.items() if not w[4]}
    monkey = decontaminate.BROADCAST_BYTES
    try:
        decontaminate.BROADCAST_BYTES = 0  # the way beyond the broadcast bound
        assert {x["doc_id"]: tuple(x)[1:] for x in decontaminate.contamination(docs, bench).collect()} == want
    finally:
        decontaminate.BROADCAST_BYTES = monkey


def test_remove_spans(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, f"Keep this. {item}! And this."), (2, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item.upper())], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert got[2] == "clean" and got[3] is None
    assert got[1].split() == "Keep this. ! And this.".split()


def test_decontamination_empty(spark, odd, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contamination(odd, none).collect()
    assert len(rows) == odd.count() and not any(r["contaminated"] for r in rows)
    assert decontaminate.contamination(no_docs, none).count() == 0
    assert decontaminate.remove_documents(odd, none).count() == odd.count()


# ---------------------------------------------------------------- odd urls, names and chains
def test_filedesc_urls_are_pages(spark):
    rows = [(1, "filedesc:abc", "one"), (2, "filedesc://y", "two"), (3, "http://a/", "x\nfiledesc://z 0.0.0.0 20010203040506 text/plain 5\n"),
            (4, "filedesc:// 0.0.0.0 1 text/plain 12", "1 0 Archive\nURL IP-address\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 4):
        got = {r["page_id"]: r["payload_bytes"] for r in arc_warc.archive_round_trip(df.repartition(n)).collect()}
        assert got == {k: len(h) for k, _, h in rows}


def test_version_block_opens_a_member_only():
    import gzip
    block = b"1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n"
    opening = b"filedesc://f.arc 0.0.0.0 20010203040506 text/plain %d\n" % len(block) + block
    page = b"http://a/ 0.0.0.0 20010203040506 text/html 3\nabc\n"
    joined = gzip.compress(opening + b"\n" + page) + gzip.compress(opening + b"\n" + page)
    data, starts = arc_warc._unzip(joined)
    assert len(starts) == 2 and [h["URL"] for _, _, h, _ in arc_warc.parse_arc(data, starts)] == ["http://a/"] * 2
    inside = [h["URL"] for _, _, h, _ in arc_warc.parse_arc(opening + b"\n" + page + opening + b"\n" + page)]
    assert inside == ["http://a/", "filedesc://f.arc", "http://a/"]


def test_head_ends_at_the_first_empty_line():
    for end, body in ((b"\n\n", b"x\r\n\r\ny"), (b"\r\n\r\n", b"x\n\ny")):
        head = b"HTTP/1.0 200 OK" + end[:len(end) // 2] + b"A: b" + end
        assert arc_warc._head(head + body) == len(head)
    long = b"HTTP/1.0 200 OK\r\nA: " + b"b" * 70_000 + b"\r\n\r\n"
    assert arc_warc._head(long + b"body") == len(long) and arc_warc._head(b"HTTP/1.0 200 OK") == 0


def test_columns_named_like_the_operators_own(spark, odd):
    own = odd.withColumn("_row", F.concat(F.lit("mine"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    kept = ngram_join.deduplicate(own)
    assert kept.columns == own.columns and all(r["_row"].startswith("mine") for r in kept.collect())
    named = odd
    for c in ("_bench_key", "_bench_hits", "key", "stretches", "doc", "gram_id", "t"):
        named = named.withColumn(c, F.lit("mine"))
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "漢字")], "item_id long, text string")
    left = decontaminate.remove_documents(named, bench)
    assert left.columns == named.columns and {r["_bench_key"] for r in left.collect()} == {"mine"}
    assert left.count() == named.count() - 4  # three copies of the item, and the short item's document
    cut = decontaminate.remove_spans(named, bench)
    assert cut.columns == named.columns and cut.count() == named.count()
    assert {(r["_bench_hits"], r["stretches"], r["doc"]) for r in cut.collect()} == {("mine",) * 3}
    assert {r["text"].strip() for r in cut.where("doc_id = 1").collect()} == {""}


def test_window_of_many_items(spark):
    """A window that all items share is listed for each of them, once a document."""
    words = [f"w{i}" for i in range(20)]
    shared = " ".join(words[:13])
    bench = spark.createDataFrame([(i, f"{shared} only{i} tail") for i in range(50)] + [(None, shared)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {shared} y {shared}"), (2, "x"), (3, f"{shared} only7 tail")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.contamination(docs, bench).collect()}
    ids = hashlib.sha256(",".join(sorted(map(str, range(50)))).encode()).hexdigest()
    assert got == {1: (26, 50, ids), 2: (0, 0, hashlib.sha256(b"").hexdigest()), 3: (15, 50, ids)}


def test_join_of_a_long_chain(spark):
    """Neighbours in the chain are similar, far ends are not: its buckets are verified
    instead of all pairs, with the same links."""
    r = random.Random(21)
    words = ["".join(r.choices(string.ascii_lowercase, k=7)) for _ in range(700)]
    texts = [" ".join(words[i * 2:i * 2 + 90]) for i in range(220)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    links = [sum(len(a & b) / len(a | b) >= 0.8 for b in sets) - 1 for a in sets]
    rows = {x["doc_id"]: x for x in ngram_join.join(df, block=40).collect()}
    assert {i: x["n_links"] for i, x in rows.items()} == dict(enumerate(links))
    parent = {i: i for i in range(len(texts))}
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                union(parent, i, j)
    assert {i: x["class_id"] for i, x in rows.items()} == {i: find(parent, i) for i in parent}
    assert {i for i, x in rows.items() if x["kept"]} == {find(parent, i) for i in parent}
