"""Personal data by a semi-Markov conditional random field.

Base spans come from four fixed patterns. Around every digit group and every
``@`` a region of tokens is laid; inside it a semi-Markov CRF scores whole
candidate spans (digit count and grouping, separators, octets, check digit, cue
words on either side) and a dynamic program over spans of bounded length picks
boundaries and types jointly. Text outside the regions cannot hold a candidate,
so leaving it out of the program changes nothing.

The field is trained here by conditional likelihood (forward-backward over
segments): the labelled rows are generated examples plus a bounded sample of
corpus windows whose labels are the base spans (``SAMPLE_WINDOWS``). The base
spans always stay; field spans that touch none of them are added.

Defined results: a null text is the empty text (no spans); repeated rows are
scanned like any other; an empty table gives an empty result and the field is
then trained on the generated examples alone; other columns are left out of
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import ready, text_of

KINDS = ("email", "ip", "card", "phone")
#: bound of the corpus sample that the field is fitted on, and passes over it
SAMPLE_WINDOWS = 200
EPOCHS = 6
#: longest candidate span and widest gap inside a region, in tokens
MAX_SPAN = 14
REGION_GAP = 6

# Fixed patterns of the base kinds.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only start where a digit run starts, so the look-behind changes nothing
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
# ASCII digits throughout: str.isdigit also holds for superscript and circled ones
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: every start in the run before an ``@`` reaches the same
    ``@``, so the run's first character decides and no start is tried twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds, by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# ---------------------------------------------------------------- the field
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s0-9]")
_MAYBE = re.compile(r"[0-9@\[(]")
_ANCHOR = re.compile(r"[0-9@\[(](?:(?<=[0-9])[0-9]*|(?<=@)|\s?at\s?[\])])")
_AT = re.compile(r"[\[(]\s?at\s?[\])]")
_CUES = {"phone", "tel", "call", "mobile", "fax", "email", "mail", "contact", "card", "visa", "account", "ip", "host",
         "address", "server"}
OTHER = 0  # label 0 is "no entity", labels 1.. are KINDS


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Character ranges that can hold a candidate: anchors at most a few tokens
    apart, widened by a few tokens on either side."""
    lo = hi = None
    reach = REGION_GAP * 8
    for m in _ANCHOR.finditer(text):
        if lo is None:
            lo, hi = m.start(), m.end()
        elif m.start() - hi <= reach:
            hi = m.end()
        else:
            yield lo, hi
            lo, hi = m.start(), m.end()
    if lo is not None:
        yield lo, hi


def tokens_of(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    a, b = max(0, lo - 40), min(len(text), hi + 40)
    return [m.span() for m in _TOKEN.finditer(text, a, b)]


def span_features(s: str, before: str, after: str) -> list[str] | None:
    """Whole-span features, or None where the span cannot be an entity."""
    digits = _NOT_DIGIT.sub("", s)
    n = len(digits)
    mail = "@" in s or _AT.search(s) is not None
    if n < 4 and not mail:
        return None
    if not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum():
        return None
    letters = sum(c.isalpha() for c in s)
    if letters and not mail:
        return None
    if not letters and mail:
        return None
    runs = _DIGITS.findall(s)
    groups = [len(g) for g in runs]
    f = ["bias", "dig:%d" % (n if n < 20 else 20), "groups:" + "-".join(map(str, groups[:6])), "ngroups:%d" % min(len(groups), 6),
         "seps:" + "".join(sorted(set(re.sub(r"\w", "", s)))), "at:%d" % s.count("@"), "len:%d" % min(len(s) // 8, 6)]
    if letters:
        f.append("letters")
        f.append("space:%d" % min(s.count(" "), 3))
        f.append("tld:%d" % bool(re.search(r"(\.|dot )[A-Za-z]{2,6}$", s)))
    if s[0] == "+":
        f.append("plus")
    if 13 <= n <= 19:
        f.append("luhn:%d" % luhn(digits))
    if len(groups) == 4 and s.count(".") == 3 and not letters:
        f.append("quad:%d" % all(len(g) <= 3 and int(g) <= 255 for g in runs))
    f.append("cue:" + (before if before in _CUES else "-"))
    f.append("edge:%d%d" % (before[-1:] in tuple("0123456789.-@+"), after[:1] in tuple("0123456789@-")))
    return f


def candidates(text: str, toks: list[tuple[int, int]], j: int, first: int = 0) -> Iterator[tuple[int, list[str]]]:
    """The candidate spans that end at token ``j`` and start at ``first`` or later:
    (length, features). No span crosses a line break."""
    for k in range(1, min(MAX_SPAN, j - first + 1) + 1):
        i = j - k + 1
        s = text[toks[i][0]:toks[j][1]]
        if "\n" in s:
            break
        before = text[toks[i - 1][0]:toks[i - 1][1]].lower() if i else ""
        glued = i > 0 and toks[i - 1][1] == toks[i][0]
        after = text[toks[j][1]:toks[j][1] + 1]
        f = span_features(s, before if not glued else before[-1:], after)
        if f is not None:
            yield k, f


def lattice(text: str, toks: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
    """All candidate spans by end token; for short windows, as training uses."""
    return [list(candidates(text, toks, j)) for j in range(len(toks))]


def _one(text: str, span: tuple[int, int]) -> list[str]:
    """Features of a single token outside any entity."""
    t = text[span[0]:span[1]]
    return ["o:dig%d" % min(len(t), 20)] if t[0] in "0123456789" else ["o:@"] if t == "@" else ["o:w"]


class Field:
    """Weights of the semi-Markov field; label 0 spans one token."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.w = weights or {}
        self._by_feature: dict[str, list[float]] | None = None

    def scores(self, feats: list[str]) -> list[float]:
        """The scores of all labels at once; only for a field that learns no more."""
        if self._by_feature is None:
            self._by_feature = {}
            for (y, f), w in self.w.items():
                self._by_feature.setdefault(f, [0.0] * (len(KINDS) + 1))[y] = w
        known = self._by_feature
        rows = [known[f] for f in feats if f in known]
        return [sum(c) for c in zip(*rows)] if rows else [0.0] * (len(KINDS) + 1)

    def score(self, y: int, feats: list[str]) -> float:
        w = self.w
        return sum([w.get((y, f), 0.0) for f in feats])

    def best(self, text: str, toks: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """Jointly best spans: (first token, last token, label).

        Lines are independent, as no span crosses a line break. Inside one, the
        candidates of a token are made when the program reaches it, and two numbers
        a token are kept for the way back."""
        first = 0
        for j in range(1, len(toks) + 1):
            if j == len(toks) or "\n" in text[toks[j - 1][1]:toks[j][0]]:
                yield from self._best_of_line(text, toks, first, j)
                first = j

    def _best_of_line(self, text: str, toks: list[tuple[int, int]], first: int, stop: int) -> list[tuple[int, int, int]]:
        n = stop - first
        top = [0.0] + [-math.inf] * n
        length, label = bytearray(n + 1), bytearray(n + 1)
        for j in range(n):
            end = j + 1
            top[end], length[end] = top[j] + self.scores(_one(text, toks[first + j]))[OTHER], 1
            for k, feats in candidates(text, toks, first + j, first):
                for y, s in enumerate(self.scores(feats)):
                    if y != OTHER and top[end - k] + s > top[end]:
                        top[end], length[end], label[end] = top[end - k] + s, k, y
        out, j = [], n
        while j > 0:
            k, y = length[j], label[j]
            if y != OTHER:
                out.append((first + j - k, first + j - 1, y))
            j -= k
        return out[::-1]

    def gradient(self, text: str, toks: list[tuple[int, int]], gold: dict[int, tuple[int, int]]) -> dict:
        """Observed minus expected features of one labelled window.

        ``gold`` maps an end token to (length, label); other tokens are label 0.
        """
        lat = lattice(text, toks)
        n = len(toks)
        arcs: list[list[tuple[int, int, list[str], float]]] = []
        for j in range(n):
            o = _one(text, toks[j])
            here = [(1, OTHER, o, self.score(OTHER, o))]
            here += [(k, y, f, self.score(y, f)) for k, f in lat[j] for y in range(1, len(KINDS) + 1)]
            arcs.append(here)
        fwd = [0.0] + [-math.inf] * n
        for j in range(n):
            vals = [fwd[j + 1 - k] + s for k, _, _, s in arcs[j]]
            m = max(vals)
            fwd[j + 1] = m + math.log(sum(math.exp(v - m) for v in vals))
        bwd = [-math.inf] * n + [0.0]
        for j in range(n - 1, -1, -1):
            for k, _, _, s in arcs[j]:
                i, v = j + 1 - k, s + bwd[j + 1]
                hi, lo = (bwd[i], v) if bwd[i] > v else (v, bwd[i])
                bwd[i] = hi + math.log1p(math.exp(lo - hi)) if lo > -math.inf else hi
        g: dict = {}
        for j in range(n):
            for k, y, f, s in arcs[j]:
                p = math.exp(min(0.0, fwd[j + 1 - k] + s + bwd[j + 1] - fwd[n]))
                if p > 1e-6:
                    for x in f:
                        g[(y, x)] = g.get((y, x), 0.0) - p
        j = n - 1
        while j >= 0:
            k, y = gold.get(j, (1, OTHER))
            f = next((f for kk, yy, f, _ in arcs[j] if kk == k and yy == y), None)
            if f is None:  # the labelled span is no candidate
                k, f, y = 1, arcs[j][0][2], OTHER
            for x in f:
                g[(y, x)] = g.get((y, x), 0.0) + 1.0
            j -= k
        return g


def labelled_window(text: str, spans: list[tuple[int, int, int]]):
    """Tokens and gold segments of a window whose spans are given by characters."""
    toks = [m.span() for m in _TOKEN.finditer(text)]
    first = {a: i for i, (a, _) in enumerate(toks)}
    last = {b: i for i, (_, b) in enumerate(toks)}
    gold, done = {}, -1
    for a, kind, b in spans:
        if a in first and b in last and first[a] > done and last[b] - first[a] < MAX_SPAN:
            gold[last[b]] = (last[b] - first[a] + 1, kind + 1)
            done = last[b]
    return text, toks, gold


def generated_windows(seed: int = 7, each: int = 22) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled examples made by rule: entities of every kind, in plain and in
    disguised forms, and numbers that are none."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = r.choice("3456") + digits(14)
        d = next(d + c for c in "0123456789" if luhn(d + c))
        return r.choice(["", " ", "-"]).join(d[i:i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = r.choice([("@", "."), ("@", "."), (" [at] ", "."), (" (at) ", "."), (" @ ", ".")])
        return f"{word()}{r.choice(['', '.', '_'])}{digits(2)}{at}{word()}{dot}{word()}.{r.choice(['com', 'org', 'net', 'io'])}"

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"{a}-{b}-{c}", f"001 {a} {b} {c}"])

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def none() -> str:
        return r.choice([lambda: digits(4), lambda: f"19{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
                         lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)}.{digits(1)}", lambda: digits(r.randint(1, 7)),
                         lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(3)}",
                         lambda: f"{digits(4)} {digits(2)} {digits(2)}", lambda: digits(24), lambda: digits(11)])()

    out = []
    for make, kind in ((email, 0), (ip, 1), (card, 2), (phone, 3), (none, None), (none, None)):
        for _ in range(each):
            left = " ".join(word() for _ in range(r.randint(1, 4))) + " "
            x = make()
            right = r.choice([" ", ". ", ", ", "\n"]) + " ".join(word() for _ in range(r.randint(1, 4)))
            out.append((left + x + right, [] if kind is None else [(len(left), kind, len(left) + len(x))]))
    return out


def fit_field(windows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, rate: float = 0.4,
              l2: float = 1e-3, seed: int = 11) -> Field:
    """Maximum conditional likelihood by stochastic gradient steps (AdaGrad)."""
    field, seen = Field(), {}
    data = [labelled_window(t, s) for t, s in windows]
    data = [d for d in data if d[1]]
    r = random.Random(seed)
    for _ in range(epochs):
        r.shuffle(data)
        for text, toks, gold in data:
            for key, g in field.gradient(text, toks, gold).items():
                g -= l2 * field.w.get(key, 0.0)
                seen[key] = seen.get(key, 1e-6) + g * g
                field.w[key] = field.w.get(key, 0.0) + rate * g / math.sqrt(seen[key])
    return Field({k: round(v, 9) for k, v in field.w.items() if abs(v) > 1e-4})


def corpus_windows(docs: DataFrame, text_col: str = "text", bound: int = SAMPLE_WINDOWS) -> list[str]:
    """At most ``bound`` windows of 160 characters around a document's first long
    digit group or ``@``, chosen by content hash (the same rows in any layout)."""
    t = text_of(docs[text_col])
    at = F.regexp_instr(t, F.lit(r"[0-9]{4,}|[0-9]\.[0-9]|@"))
    rows = (docs.select(t.alias("t"), at.alias("at")).where("at > 0")
            .select(F.expr("substring(t, greatest(at - 60, 1), 160)").alias("w")).distinct()
            .orderBy(F.xxhash64("w"), "w").limit(bound).collect())
    return [x["w"] for x in rows]


def train(docs: DataFrame, text_col: str = "text", bound: int = SAMPLE_WINDOWS) -> Field:
    """The field fitted on generated examples and the corpus sample, whose labels
    are the base spans."""
    windows = generated_windows()
    for w in corpus_windows(docs, text_col, bound):
        kept, done = [], 0
        for a, kind, b in sorted(base_spans(w), key=lambda s: (s[0], -s[2])):
            if a >= done:
                kept.append((a, kind, b))
                done = b
        windows.append((w, kept))
    return fit_field(windows)


def field_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    out = []
    for lo, hi in regions(text):
        toks = tokens_of(text, lo, hi)
        for i, j, y in field.best(text, toks):
            out.append((toks[i][0], y - 1, toks[j][1]))
    return out


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans plus the field's that touch no earlier one."""
    if not _MAYBE.search(text):
        return [], []
    base = base_spans(text)
    taken: list[list[int]] = []  # the stretches that base spans cover, apart from one another
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    extra, k, done = [], 0, 0
    for a, kind, b in sorted(field_spans(text, field)):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= done and not (k < len(taken) and taken[k][0] < b):
            extra.append((a, kind, b))
            done = b
    return base, sorted(base + extra)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the counts of base spans by kind, the digest of
    the base spans, all spans, and how many the field added. No shuffle."""
    ready(docs.sparkSession)
    weights = (field or train(docs, text_col)).w
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs[text_col]).alias("text"))
    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
              "n_added long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(weights)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                base, spans = all_spans(value.as_py(), model)
                for k in range(4):
                    cols[k].append(sum(s[1] == k for s in base))
                cols[4].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                cols[5].append(spans_text(spans))
                cols[6].append(len(spans) - len(base))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)],
                                             names=[f.split()[0] for f in schema.split(", ")])

    return src.mapInArrow(run, schema)


def redact_text(text: str, field: Field) -> str:
    """The text with every span replaced by its kind in brackets; overlapping
    spans become one."""
    out, done = [], 0
    for a, kind, b in all_spans(text, field)[1]:
        if a < done:
            done = max(done, b)
            continue
        out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text; a null text stays null."""
    ready(docs.sparkSession)
    weights = (field or train(docs, text_col)).w

    @F.pandas_udf("string")
    def clean(texts):
        model = Field(weights)
        return texts.map(lambda t: None if t is None else redact_text(t, model))

    return docs.withColumn(text_col, clean(docs[text_col]))
