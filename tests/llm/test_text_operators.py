"""Row-wise operators: tokens, packing, personal data, secrets."""

import hashlib
import random
import re

import numpy as np
import pytest

from tabflow.llm import byte_bpe, packing, pii, secret_scan, token_counts
from tabflow.session import scratch_path


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# ---------------------------------------------------------------- byte BPE
def test_bpe_equals_library_and_round_trips(docs):
    rows = {r["doc_id"]: r for r in byte_bpe.encode_texts(docs, with_ids=True).collect()}
    enc = byte_bpe.codec(byte_bpe.rank_path()).encoding
    for r in docs.collect():
        got, ids = rows[r["doc_id"]], enc.encode_ordinary(r["text"])
        assert got["ids"] == ids and got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert got["decoded_sha256"] == sha(r["text"])


def test_bpe_cuts_change_no_id(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CUT_CHARS", 4)
    monkeypatch.setattr(byte_bpe, "RUN_CHARS", 9)
    c = byte_bpe.codec(byte_bpe.rank_path())
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab1 2\n\t  '.!éñ漢\x1c　\xa0s") for _ in range(r.randint(0, 60)))
        assert c.encode(t) == c.encoding.encode_ordinary(t), repr(t)
        assert c.decode(c.encode(t)) == t.encode()


def test_bpe_odd_rows(odd, no_docs):
    rows = byte_bpe.encode_texts(odd).collect()
    assert len(rows) == odd.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert byte_bpe.encode_texts(no_docs).count() == 0


def test_decode_ids(spark):
    df = spark.createDataFrame([([31373, 995],), (None,), ([99_999_999],)], "ids array<int>")
    assert [None if r["decoded"] is None else bytes(r["decoded"]) for r in byte_bpe.decode_ids(df).collect()] == [b"hello world", None, None]


# ---------------------------------------------------------------- token counts
def library_counts(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_counts.tokenizer_path())
    return [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_equal_library(docs):
    src = docs.select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in src], library_counts([r["text"] for r in src]), strict=True))
    for r in token_counts.token_counts(docs).collect():
        assert r["n_tokens"] == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 2048)


def test_run_sums_equal_library():
    r = random.Random(2)
    parts = ["a", "B", "é", "é", "1", " ", "\n", "\x1c", "\x85", "　", "<|endoftext|>", "'s", "!", "漢", "İ", "́"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    want = library_counts(texts)
    assert token_counts.RunCounter(token_counts.tokenizer_path()).count(texts) == want
    assert library_counts([re.sub("[ \t\r\n]+", " ", t).strip(" ") for t in texts]) == want


def test_cache_is_used_and_appended(spark, odd, no_docs):
    path = scratch_path(spark, "cache")
    first = token_counts.token_counts(odd, path).collect()
    n = spark.read.parquet(path).count()
    version = token_counts.tokenizer_digest(token_counts.tokenizer_path())
    assert n == token_counts.read_cache(spark, path, version).select("content").distinct().count()
    assert sorted(token_counts.token_counts(odd, path).collect(), key=str) == sorted(first, key=str)
    assert spark.read.parquet(path).count() == n  # nothing is encoded twice
    more = spark.createDataFrame([(1, "brand new text"), (2, "brand  new\ttext ")], "doc_id long, text string")
    assert {r["n_tokens"] for r in token_counts.token_counts(more, path).collect()} == {3}
    assert spark.read.parquet(path).count() == n + 1
    assert {(r["n_bytes"], r["n_tokens"]) for r in first if r["doc_id"] in (3, 4)} == {(0, 0)}
    assert len(first) == odd.count() and token_counts.token_counts(no_docs).count() == 0


def test_poisoned_cache_shows_that_counts_come_from_it(spark):
    path = scratch_path(spark, "cache")
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    version = token_counts.tokenizer_digest(token_counts.tokenizer_path())
    spark.createDataFrame([(version, sha("one two three"), 77)], token_counts.CACHE_SCHEMA).write.parquet(path)
    assert token_counts.token_counts(df, path).first()["n_tokens"] == 77


# ---------------------------------------------------------------- packing
def naive_free(lengths, length):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(length - n)
    return sorted(free)


def test_best_fit_decreasing_equals_naive():
    r = random.Random(0)
    for _ in range(300):
        length = r.choice([1, 7, 8, 16, 31, 100])
        sizes = [r.randint(0, length) for _ in range(r.randint(0, 60))]
        rows = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in row) for row in rows) == naive_free(sizes, length)


@pytest.mark.parametrize("window", [4_000_000, 3000])
def test_packing_is_lossless(spark, odd, window):
    length = 512
    rows = packing.write_packed(odd, scratch_path(spark, "packed"), length=length, window_tokens=window).collect()
    pad = len(byte_bpe.codec(byte_bpe.rank_path()).bytes_of)
    parts = {}
    for r in rows:
        ids, places = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        ends = r["cu_seqlens"]
        assert len(ids) == len(places) == length and ends[0] == 0 and ends[-1] == r["n_tokens"] <= length
        assert (ids[ends[-1]:] == pad).all()
        for doc, part, a, b in zip(r["doc_ids"], r["parts"], ends, ends[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((part, ids[a:b].tolist()))
    want = {}
    for r in byte_bpe.encode_texts(odd, with_ids=True).collect():
        want.setdefault(r["doc_id"], []).append(r["ids"])
    for doc, texts in want.items():
        assert sorted(sum(texts, [])) == sorted(i for _, ids in parts[doc] for i in ids)
        if len(texts) == 1:
            assert texts[0] == [i for _, ids in sorted(parts[doc]) for i in ids]
    assert len({r["pack_id"] for r in rows}) == len(rows)


def test_packing_empty_and_described(spark, no_docs, docs):
    assert packing.pack_texts(no_docs).count() == 0
    d = packing.describe(packing.pack_texts(docs)).collect()
    assert sum(r["n_tokens"] for r in d) == sum(r["n_tokens"] for r in byte_bpe.encode_texts(docs).collect())
    assert {i for r in d for i in r["doc_ids"]} == {r["doc_id"] for r in docs.collect()}


# ---------------------------------------------------------------- personal data
def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for kind, pattern, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if lo <= len(d) <= hi and (kind == 3 or pii.luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_patterns():
    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choice("ab@.1 2+-()9%é25\n") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == brute_pii(t), repr(t)


def test_scan_keeps_base_spans(docs):
    field = pii.train(docs)
    for r, d in zip(sorted(pii.scan(docs, field).collect()), sorted(docs.select("doc_id", "text").collect()), strict=True):
        base = brute_pii(d["text"])
        assert r["base_sha256"] == sha(pii.spans_text(base))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        listed = r["spans"].split(",") if r["spans"] else []
        assert set(pii.spans_text(base).split(",")) - {""} <= set(listed)
        starts = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) for x in listed]
        assert starts == sorted(starts)


def test_field_learns_disguised_entities():
    field = pii.fit_field(pii.generated_windows())
    held = pii.generated_windows(seed=99)
    right = sum(pii.field_spans(t, field) == s for t, s in held)
    assert right >= 0.9 * len(held)


def test_field_gradient_matches_finite_differences():
    text, toks, gold = pii.labelled_window("call 555 0100 200 now", [(5, 3, 17)])
    r = random.Random(0)
    field = pii.Field({(y, f): r.uniform(-1, 1) for y in range(5) for f in ("bias", "o:w", "o:dig3", "len:1", "ngroups:3")})

    def log_z(w):
        lat, top = pii.lattice(text, toks), [0.0]
        f = pii.Field(w)
        for j in range(len(toks)):
            vals = [top[j] + f.score(0, pii._one(text, toks[j]))]
            vals += [top[j + 1 - k] + f.score(y, x) for k, x in lat[j] for y in range(1, 5)]
            top.append(np.logaddexp.reduce(vals))
        return top[-1]
    grad, empty = field.gradient(text, toks, gold), field.gradient(text, toks, {})
    key, eps = (4, "ngroups:3"), 1e-5
    up = log_z({**field.w, key: field.w[key] + eps})
    assert abs(-(up - log_z(field.w)) / eps - empty.get(key, 0.0)) < 1e-3
    assert abs(grad[key] - empty.get(key, 0.0) - 1.0) < 1e-9  # the labelled span has the feature


def test_pii_odd_rows_and_redaction(odd, no_docs):
    field = pii.fit_field(pii.generated_windows())
    rows = pii.scan(odd, field).collect()
    assert len(rows) == odd.count()
    assert sum(r["n_email"] for r in rows) == 1 and sum(r["n_phone"] for r in rows) == 1
    assert {r["spans"] for r in rows if r["doc_id"] in (3, 4)} == {""}
    out = pii.redact(odd, field)
    assert out.columns == odd.columns
    texts = {r["text"] for r in out.collect()}
    assert "mail me at [EMAIL] or [PHONE]" in texts and None in texts and "" in texts
    assert pii.scan(no_docs).count() == 0 and pii.redact(no_docs).count() == 0


# ---------------------------------------------------------------- secrets
def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(secret_scan.ASSIGN, t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(secret_scan.ACCESS, t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(secret_scan.HEX, t) if len(m.group()) >= 24]
    return sorted(out)


def listed(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_secret_base_spans(spark):
    r = random.Random(5)
    parts = ["token", "=", ":", " ", "\"", "abc", "AKIA", "ABCDEFGHIJKLMNOP1", "0123456789abcdef0123456789", "é😀", "secret", "a", "\n",
             "api_key", "PASSWD", "deadbeef" * 20]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(600)]
    texts += ["x " + "token=abcdefg " * 1500, "deadbeef" * 5000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secret_scan.scan(df, secret_scan.ratios([])).collect():
        want = brute_secrets(texts[row["doc_id"]] or "")
        assert row["base_sha256"] == sha(listed(want))
        assert row["n_assign"] == sum(s[1] == 0 for s in want)
        assert set(listed(want).split(",")) <= set(row["spans"].split(","))


def test_markov_runs(spark):
    r = random.Random(3)
    words = ["".join(r.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(8)) for _ in range(300)]
    random64 = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(i, " ".join(words[i * 3:i * 3 + 3])) for i in range(100)] + [(1000, f"see {random64} here"), (1001, "theronanre" * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["spans"] for x in secret_scan.scan(df).collect()}
    assert got[1000] == "markov:4:44"
    assert got[1001] == "" and not any(got[i] for i in range(100))


def test_secrets_odd_rows(odd, no_docs):
    rows = secret_scan.scan(odd).collect()
    assert len(rows) == odd.count() and all(x["base_sha256"] == sha("") for x in rows if x["doc_id"] in (3, 4, 5))
    assert secret_scan.scan(no_docs).count() == 0


def test_short_random_strings_are_scored(spark):
    short, other = "q7Zk29Xv0LmTr4P", "x8Kp2Qz7"
    text = f"the key {short} is here, {other} is too short, and characteristics-of-words is ordinary"
    df = spark.createDataFrame([(1, text)] + [(i, "some ordinary-identifier and_longer_identifier here") for i in range(2, 40)],
                               "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(df).collect()}
    assert spans[1] == f"markov:{text.index(short)}:{text.index(short) + len(short)}" and not any(spans[i] for i in range(2, 40))


def test_many_runs_beside_many_base_spans(spark):
    r = random.Random(3)
    make = lambda a, n: "".join(r.choice(a) for _ in range(n))
    parts = []
    for _ in range(1500):
        parts += [make("0123456789abcdef", 30), make("abcXYZ0189QwvkJ", 24), "token=" + make("Zx9kQ", 14)]
    text = " ".join(parts)
    row = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), [1.0] * (128 * 128)).first()
    base = sorted((m.start(2) - len("token="), m.end()) for m in re.finditer(secret_scan.ASSIGN, text))
    base = sorted(base + [m.span() for m in re.finditer(secret_scan.HEX, text) if len(m.group()) >= 24])
    runs = [m.span() for m in re.finditer(secret_scan.CANDIDATE, text)]
    want = [x for x in runs if not any(a < x[1] and b > x[0] for a, b in base[:])] if len(runs) < 5000 else None
    got = [tuple(map(int, s.split(":")[1:])) for s in row["spans"].split(",") if s.startswith("markov")]
    assert got == want and len(got) >= 1400


# ------------------------------------------------- cache, packing, personal data
def test_repeated_cache_rows_count_once(spark):
    path = scratch_path(spark, "cache")
    df = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    first = sorted(token_counts.token_counts(df, path).collect())
    spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
    spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
    assert sorted(token_counts.token_counts(df, path + "-twice").collect()) == first and len(first) == 2


def test_counts_of_a_tokenizer_that_keeps_white_space(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a  b\n\n c", " lead", "x\t\ty ", "", None, "plain words here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, path=path, fold_space=False).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_packing_is_that_of_the_whole_corpus_in_any_layout(spark, docs):
    rows = [x["n_tokens"] for x in byte_bpe.encode_texts(docs).collect()]
    length = 512
    sizes = [s for n in rows for s in [length] * (n // length) + [n % length] if s]
    want = naive_free(sizes, length)
    for parts in (1, 40):
        got = packing.pack_texts(docs.repartition(parts), length=length).collect()
        assert sorted(length - r["n_tokens"] for r in got) == want
        assert sorted(r["pack_id"] for r in got) == list(range(len(got)))


def test_empty_texts_are_spread_over_rows(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 100 = 0, repeat('word ', 40), '') as text")
    got = packing.pack_texts(df, length=64).collect()
    listed = [len(r["doc_ids"]) for r in got]
    assert sum(listed) == 3000 and max(listed) <= 2 * min(listed)
    none = packing.pack_texts(spark.range(100).selectExpr("id as doc_id", "cast(null as string) as text"), length=8).collect()
    assert sum(len(r["doc_ids"]) for r in none) == 100 and len(none) == 13


def test_personal_data_with_every_kind_of_digit(spark):
    import sys
    import unicodedata
    odd_digits = [chr(i) for i in range(0x80, sys.maxunicode) if unicodedata.category(chr(i)) in ("Nd", "Nl", "No")]
    r = random.Random(6)
    texts = ["host 1.2.3.4² is down", "10.2.3.4①", "²³", "+1² 555 010 9999", "a@b.c²"]
    for d in odd_digits:
        texts.append(f"x {r.randint(1, 255)}.2.{d}.4{d} +{d}1 ({d}55) 010-{d}999 {d}{d}{d}{d} jo{d}@mail{d}.com")
    field = pii.train(spark.createDataFrame([], "doc_id long, text string"))
    for t in texts:
        base, spans = pii.all_spans(t, field)
        assert set(base) <= set(spans) and pii.redact_text(t, field)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.scan(df, field).count() == len(texts) and pii.redact(df, field).where("text is null").count() == 0


def test_best_segmentation_equals_enumeration():
    r = random.Random(12)
    pieces = ["12", "3456", "7", "@", "mail", "com", ".", "-", " ", "\n", "+", "555", "(", ")", "call", "²"]
    field = pii.fit_field(pii.generated_windows(each=6))
    r2 = random.Random(1)
    field = pii.Field({k: w + r2.uniform(-1, 1) for k, w in field.w.items()})
    for _ in range(150):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 9)))
        toks = [m.span() for m in pii._TOKEN.finditer(text)]
        lat = pii.lattice(text, toks)

        def every(j):
            if j == 0:
                yield 0.0, ()
                return
            for s, path in every(j - 1):
                yield s + field.score(0, pii._one(text, toks[j - 1])), path
            for k, feats in lat[j - 1]:
                for y in range(1, 5):
                    for s, path in every(j - k):
                        yield s + field.score(y, feats), (*path, (j - k, j - 1, y))

        best = max(s for s, _ in every(len(toks)))
        got = list(field.best(text, toks))
        feats = {(j - k + 1, j): f for j in range(len(toks)) for k, f in lat[j]}
        covered = {i for a, b, _ in got for i in range(a, b + 1)}
        mine = sum(field.score(y, feats[a, b]) for a, b, y in got)
        mine += sum(field.score(0, pii._one(text, toks[i])) for i in range(len(toks)) if i not in covered)
        assert mine == pytest.approx(best, abs=1e-9)


def test_long_number_table_takes_little_memory():
    import tracemalloc
    r = random.Random(9)
    for end in ("\n", " "):
        text = "".join(f"{r.randint(0, 99999)} {r.randint(0, 999)}.{r.randint(0, 99)}{end}" for _ in range(4000))
        field = pii.Field({(1, "bias"): -1.0})
        tracemalloc.start()
        pii.all_spans(text, field)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300 * len(text)


def test_field_span_across_many_base_spans(monkeypatch):
    text = " ".join("1.2.3.4" for _ in range(30)) + " tail"
    monkeypatch.setattr(pii, "field_spans", lambda t, f: [(0, 3, 8), (60, 3, 80), (len(text) - 4, 3, len(text))])
    base, spans = pii.all_spans(text, pii.Field())
    assert set(spans) - set(base) == {(len(text) - 4, 3, len(text))}
