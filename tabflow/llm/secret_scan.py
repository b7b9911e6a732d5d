"""Secret scanning with DataFrame operations only.

Base spans come from three fixed patterns. Two character Markov models are
counted over the whole corpus, one from labelled random strings (the values of
base matches, and digests made by rule) and one from ordinary identifiers (long
runs of letters in one case that touch no base match); a run whose log-likelihood ratio speaks
for "random" becomes a further span of kind ``markov``.

Positions come without user code: cutting a text at the matches gives the gaps,
extracting them gives the matches, and running sums of both lengths give every
start. The sums are taken in two levels, so thousands of matches in one text
stay cheap. The models are two tables of at most 128 x 128 counts, whatever the
corpus size.

Defined results: a null text is the empty text (no spans); repeated rows are
scanned like any other; an empty table gives an empty result; with no labelled
string at all the random model is uniform; other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.common import ready, text_of

# Fixed patterns of the base kinds, in the order in which kinds sort.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# The same matches where only long ones count: a match is a maximal run, and a run
# that is too short holds no longer one.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{24,}"
MIN_VALUE = 6
#: runs that the models score, and runs that count as ordinary identifiers in training
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"
IDENTIFIER = CANDIDATE
#: a run is random if its mean log-likelihood ratio per transition and the total reach these
MIN_MEAN, MIN_TOTAL = 0.5, 12.0
_STEP = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row: a lambda's body would
    compute an expression it mentions again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """Starts of consecutive stretches: array<struct<gap,len>> -> array<int>, one
    per entry, each after its own gap. Blocks of ``_STEP`` entries keep the array
    building linear. ``lengths`` must be a column or a bound value."""
    numbers = F.sequence(F.lit(0), F.ceil(F.size(lengths) / _STEP).cast("int") - 1)
    block = lambda b: F.slice(lengths, b * _STEP + 1, _STEP)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["gap"] + x["len"])
    heads = F.aggregate(numbers, F.array(F.lit(0)),
                        lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + total(block(b)))))
    return let(heads, lambda at: F.flatten(F.transform(numbers, lambda b: F.aggregate(
        block(b), F.struct(F.get(at, b).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"),
                                F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts")),
        lambda acc: acc["starts"]))))


_NONE = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, maybe: Column, pattern: str, kind: str, value_group: int = 0, min_value: int = 1) -> Column:
    """Matches of ``pattern`` as (start, kind, end, value), leftmost and not
    overlapping; those with a shorter value are dropped after matching."""
    found = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), 1, 1 << 30), F.length).alias("gap"),
        F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length),
                 F.array(F.lit(0))).alias("len"),
        F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), F.array(F.lit(""))).alias("value"))
    placed = let(found, lambda m: F.transform(
        F.arrays_zip(_running(m).alias("start"), m.alias("m")),
        lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                           (x["start"] + x["m"]["len"]).alias("end"), x["m"]["value"].alias("value"))))
    return (F.when(maybe, F.filter(placed, lambda s: F.length(s["value"]) >= min_value))
            .otherwise(F.array().cast(_NONE)))


def base_spans(text: Column) -> dict[str, Column]:
    """The three base kinds; every pattern runs only where a cheap needed sign is."""
    sign = text.contains("=") | text.contains(":")
    return {
        "assign": _spans(text, sign & text.rlike(ASSIGN), ASSIGN, "assign", 2, MIN_VALUE),
        "access": _spans(text, text.contains("AKIA"), ACCESS_LONG, "access"),
        "hex": _spans(text, text.rlike(r"[0-9a-f]{24}"), HEX_LONG, "hex"),
    }


def _free(runs: Column, base: Column) -> Column:
    """Runs that touch no base span. Runs come in order and do not overlap, so a block
    of them only meets the base spans of its own stretch of the text."""
    touches = lambda s, start, end: (s["start"] < end) & (s["end"] > start)
    clear = lambda part, near: F.filter(part, lambda r: ~F.exists(near, lambda s: touches(s, r["start"], r["end"])))
    block = lambda rs, bs, b: let(F.slice(rs, b * _STEP + 1, _STEP), lambda part: let(
        F.filter(bs, lambda s: touches(s, F.get(part, F.lit(0))["start"], F.element_at(part, -1)["end"])),
        lambda near: clear(part, near)))
    numbers = F.sequence(F.lit(0), F.ceil(F.size(runs) / _STEP).cast("int") - 1)
    return F.when((F.size(runs) == 0) | (F.size(base) == 0), runs).otherwise(
        let(runs, lambda rs: let(base, lambda bs: F.flatten(F.transform(numbers, lambda b: block(rs, bs, b))))))


def _chars(value: Column) -> Column:
    return F.split(value, "")


def generated(spark: SparkSession, n: int = 500) -> DataFrame:
    """Labelled random strings made by rule (digests in base 64 and base 16), so
    that alphabets which the corpus's base matches lack are known too."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    forms = F.array(F.regexp_replace(F.base64(F.unhex(digest)), "=+$", ""), digest, F.upper(digest))
    return spark.range(n).select(F.lit(1).alias("random"), F.explode(forms).alias("v"))


def train(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Log-likelihood ratio of every character pair (random over ordinary), as a
    flat 128 x 128 table, from all rows."""
    rows = docs.select(text_of(docs[text_col]).alias("t"))
    rows = rows.select("t", F.concat(*base_spans(F.col("t")).values()).alias("base"))
    long_run = F.col("t").rlike(IDENTIFIER)
    runs = F.when(F.size("base") == 0, F.when(long_run, F.regexp_extract_all("t", F.lit(IDENTIFIER), F.lit(0)))) \
        .otherwise(F.transform(_free(_spans(F.col("t"), long_run, IDENTIFIER, "markov"), F.col("base")), lambda r: r["value"]))
    samples = rows.select(F.explode(F.concat(
        F.transform(F.col("base"), lambda s: F.struct(F.lit(1).alias("random"), s["value"].alias("v"))),
        F.transform(F.coalesce(runs, F.array().cast("array<string>")),
                    lambda v: F.struct(F.lit(0).alias("random"), v.alias("v"))))).alias("s"))
    samples = samples.select("s.random", "s.v").unionByName(generated(docs.sparkSession))
    # a run counts as ordinary if it has no digit and its letters keep one case (but for the first):
    # what else is free of base matches may be an unknown secret and would teach the wrong model
    v, rest = F.col("v"), F.expr("substring(v, 2)")
    plain = ~v.rlike("[0-9]") & ((v == F.upper(v)) | (rest == F.lower(rest)))
    samples = samples.where((F.col("random") == 1) | plain)
    c = _chars(F.col("v"))
    pairs = samples.select("random", c.alias("c")).where(F.size("c") > 1).select("random", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("c") - 2),
        lambda i: F.ascii(F.get("c", i)) * 128 + F.ascii(F.get("c", i + 1)))).alias("pair"))
    counts = pairs.where("pair >= 0 and pair < 16384").groupBy("random", "pair").count().collect()
    return ratios([(r["random"], r["pair"], r["count"]) for r in counts])


def ratios(counts: list[tuple[int, int, int]], symbols: int = 66, strength: float = 5.0) -> list[float]:
    """Transition log probabilities of the two models, subtracted. A transition's
    probability leans on its second character's own share with ``strength`` counts,
    so characters that ordinary identifiers hardly use count as evidence even after
    a character that they never use."""
    pair = {0: {}, 1: {}}
    first = {0: [0] * 128, 1: [0] * 128}
    second = {0: [0] * 128, 1: [0] * 128}
    for kind, p, k in counts:
        pair[kind][p] = k
        first[kind][p >> 7] += k
        second[kind][p & 127] += k

    def log_p(kind: int, p: int) -> float:
        share = (second[kind][p & 127] + 0.5) / (sum_of[kind] + 0.5 * symbols)
        return math.log((pair[kind].get(p, 0) + strength * share) / (first[kind][p >> 7] + strength))
    sum_of = {k: sum(v) for k, v in second.items()}
    return [round(log_p(1, p) - log_p(0, p), 6) for p in range(128 * 128)]


def random_runs(text: Column, model: list[float]) -> Column:
    """Runs that the models call random, as spans of kind ``markov``."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")

    def score(run: Column) -> Column:
        return let(_chars(run["value"]), lambda c: F.aggregate(
            F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0),
            lambda a, i: a + F.get(table, F.ascii(F.get(c, i)) * 128 + F.ascii(F.get(c, i + 1)))))
    runs = _spans(text, text.rlike(CANDIDATE), CANDIDATE, "markov")
    scored = F.transform(runs, lambda r: F.struct(r.alias("r"), score(r).alias("s")))
    good = F.filter(scored, lambda x: (x["s"] >= MIN_TOTAL) & (x["s"] >= MIN_MEAN * (F.length(x["r"]["value"]) - 1)))
    return F.transform(good, lambda x: x["r"])


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: base counts by kind, the digest of the base
    spans, and all spans. No shuffle beside the model's counts."""
    ready(docs.sparkSession)
    model = model or train(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs[text_col]).alias("t"))
    t = F.col("t")
    rows = rows.select("doc_id", "t", *[c.alias(k) for k, c in base_spans(t).items()])
    rows = rows.select("doc_id", "assign", "access", "hex", F.concat("assign", "access", "hex").alias("base"),
                       random_runs(t, model).alias("runs"))
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                       F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       _listed(F.concat("base", _free(F.col("runs"), F.col("base")))).alias("spans"))
