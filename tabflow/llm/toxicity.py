"""Toxicity by weak supervision.

1. Lexicon: words and word beginnings are counted by label over the labelled
   training texts, each distinct text once; all that speak for the toxic label
   with statistical safety become entries, whatever the language (at most
   ``MAX_ENTRIES``, the strongest, as the lexicon is shipped to every worker).
2. Voters: each of the ``MAX_VOTERS`` strongest entries is a voter of its own, and so
   is each pattern: a fixed list of insults, masked swearing, shouting, several entries
   at once, calm writing, long texts. A voter fires on a text or it does not, and
   speaks for the label under which it fires more often.
3. Label model: a generative model of all rows, in which the label draws the voters
   along a tree: a voter's firing rate depends on the label and on one other voter.
   The tree is the one that keeps the most of the voters' mutual information given
   the label (correlated voters are so not counted twice); rates, tree and the
   prior are estimated by expectation maximisation over the counts of firing sets,
   each step one pass on the workers. A given training label is one more voter, right
   with probability ``TRUTH``.
4. A logistic regression on entry counts and patterns is fitted to the posterior
   labels of a bounded sample (``FIT_ROWS``) and scores every whole text.

Labels are read only where ``crc32(doc_id) mod 5`` is not 0; language, source
and id are no inputs of a score.

Defined results: a null or empty text is scored as a text without words;
repeated rows get equal scores; labels that contradict each other for one id
count by their mean, for the lexicon also those for copies of one text; null labels or ids are no labels; with no labelled row
there is no lexicon and the fixed patterns alone vote; an empty table gives an
empty result; other columns are left out of ``predict`` and kept by ``reject``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import ready, small_side, store, text_of

#: bound of the sample that the classifier is fitted on
FIT_ROWS = 12_000
PREFIXES = (4, 5)
MAX_ENTRIES = 100_000
MAX_VOTERS = 512
MIN_LONG = 200       # words of a long text
EM_STEPS = 6
TRUTH = 0.999        # share of the given labels that count as right
RIDGE = 1e-4
HOLD_OUT = 5
_WORD = re.compile(r"[^\W\d_]+")
# Fixed list of general insults, in four languages.
INSULTS = frozenset("""
idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown vermin filth
idiote imbécile crétin débile ordure salaud connard abruti
idiot dummkopf trottel arschloch abschaum versager widerlich
idiota imbécil estúpido basura escoria inútil asqueroso payaso
""".split())
_MASKED = re.compile(r"\b[A-Za-z]{1,3}[*@#$]{2,}[A-Za-z]{0,4}\b|\b[A-Za-z][*]+[A-Za-z]+\b")
_CAPS = re.compile(r"[A-ZÀ-Þ]{3}")
_SHOUT = re.compile(r"(?:\b[A-ZÀ-Þ]{3,}\b\W+){5}|!{3,}")
N_PATTERNS = 6


def masked(text: str) -> bool:
    return any(c in text for c in "*@#$") and _MASKED.search(text) is not None


def shouted(text: str) -> bool:
    return "!!!" in text or _CAPS.search(text) is not None and _SHOUT.search(text) is not None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False))


def entries_of(text: str) -> set[str]:
    """A text's words and word beginnings (the lexicon's units), marked by kind."""
    words = set(_WORD.findall(text.lower()))
    out = {"w:" + w for w in words}
    for k in PREFIXES:
        out.update([f"{k}:{x}" for x in {w[:k] for w in words if len(w) > k}])
    return out


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``(_id, _toxic)`` of the rows that may be learnt from, one per id."""
    rows = labels.select(labels[id_col].cast("long").alias("_id"), labels[label_col].cast("double").alias("_toxic"))
    return (rows.where(F.col("_id").isNotNull() & F.col("_toxic").isNotNull() & ~held_out(F.col("_id")))
            .groupBy("_id").agg(F.avg("_toxic").alias("_toxic")))


def learn_lexicon(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> list[str]:
    """Entries that occur in toxic training texts far beyond chance, strongest first.

    Counted over all distinct training texts, as copies of one are no further
    evidence on its words; tasks pre-add their batches, and only the selected
    entries reach the driver."""
    rows = (docs.select(docs[id_col].cast("long").alias("_id"), text_of(docs[text_col]).alias("_text"))
            .join(small_side(labels, "toxic-labels"), "_id")
            .groupBy(F.sha2(F.col("_text").cast("binary"), 256).alias("_digest"))
            .agg(F.avg("_toxic").alias("_toxic"), F.first("_text").alias("_text")).select("_toxic", "_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            n_toxic = 0
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (toxic if y >= 0.5 else clean).update(entries_of(text.as_py()))
                n_toxic += y >= 0.5
            n = len(batch.column(0))
            keys = ["", *set(toxic).union(clean)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([n_toxic, *[toxic[k] for k in keys[1:]]], pa.int64()),
                 pa.array([n - n_toxic, *[clean[k] for k in keys[1:]]], pa.int64())], names=["entry", "toxic", "clean"])

    totals = store(rows.mapInArrow(count, "entry string, toxic long, clean long")
                   .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
                   .where("entry = '' or toxic >= 3"), "toxic-entries")
    base = totals.where("entry = ''").first()
    if base is None or not base["toxic"] or not base["clean"]:
        return []
    p, q = base["toxic"], base["clean"]
    # lower confidence bound of the log odds ratio (half a count added to each cell)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (p + 0.5 - F.col("toxic")) * (q + 0.5 - F.col("clean")) / b)
    low = odds - 2.6 * F.sqrt(1 / a + 1 / (p + 0.5 - F.col("toxic")) + 1 / b + 1 / (q + 0.5 - F.col("clean")))
    got = (totals.where("entry <> ''").withColumn("low", low).where("low > 1.5")
           .orderBy((F.col("low") * F.sqrt("toxic")).desc(), "entry").limit(MAX_ENTRIES).collect())
    return [r["entry"] for r in got]


@dataclass
class Model:
    lexicon: list[str]
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def __post_init__(self):
        self.index = {e: i for i, e in enumerate(self.lexicon)}
        # every entry's word starts with one of these
        self.starts = {e[2:][:PREFIXES[0]] for e in self.lexicon}

    @property
    def voters(self) -> int:
        return min(len(self.lexicon), MAX_VOTERS) + N_PATTERNS

    def features(self, text: str) -> tuple[dict[int, float], list[int]]:
        """Sparse features (entry counts, then patterns) and the voters that fire."""
        index = self.index
        found = _WORD.findall(text.lower())
        words = set(found)
        hits: dict[int, int] = {}
        near = {w for w in words if w[:PREFIXES[0]] in self.starts}
        for w, n in Counter([w for w in found if w in near]).items() if near else ():
            for key in ("w:" + w, *[f"{k}:{w[:k]}" for k in PREFIXES if len(w) > k]):
                i = index.get(key)
                if i is not None:
                    hits[i] = hits.get(i, 0) + n
        insult, mask, shout = not INSULTS.isdisjoint(words), masked(text), shouted(text)
        patterns = (insult, mask, shout, len(hits) > 1, bool(words) and not (mask or shout or "!" in text), len(found) >= MIN_LONG)
        lexicon, single = len(self.lexicon), self.voters - N_PATTERNS
        out = {i: float(np.log1p(n)) for i, n in hits.items()}
        out.update({lexicon + j: 1.0 for j, fires in enumerate(patterns) if fires})
        return out, sorted([i for i in hits if i < single] + [single + j for j, fires in enumerate(patterns) if fires])

    def score(self, text: str) -> float:
        f, _ = self.features(text)
        z = self.bias + sum(self.weights[i] * v for i, v in f.items())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


@dataclass
class LabelModel:
    """Rates of ``n`` voters given the label (0 clean, 1 toxic) and their parent."""

    n: int
    prior: np.ndarray                   # of the labels
    rate: np.ndarray                    # (label, voter), whatever the parent does
    parent: np.ndarray                  # voter, or -1
    given: np.ndarray                   # (label, parent fires, voter)

    @classmethod
    def start(cls, n: int) -> LabelModel:
        """Before any row is seen: firing speaks for toxic."""
        rate = np.stack([np.full(n, 0.02), np.full(n, 0.4)])
        return cls(n, np.array([0.9, 0.1]), rate, np.full(n, -1), np.stack([rate, rate], axis=1))

    def matrix(self, votes: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(votes), self.n))
        for k, own in enumerate(votes):
            x[k, own] = 1
        return x

    def posterior(self, x: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Probability of toxic for rows of votes and given labels (-1: none)."""
        up = np.where(self.parent >= 0, x[:, self.parent], 0.0)
        both = x * up
        ll = []
        for y in (0, 1):
            p = np.clip(self.given[y], 1e-6, 1 - 1e-6)
            no, yes = np.log(1 - p), np.log(p)
            ll.append(np.log(self.prior[y]) + no[0].sum() + x @ (yes[0] - no[0]) + up @ (no[1] - no[0]) + both @ (yes[1] - yes[0] - no[1] + no[0])
                      + np.where(label < 0, 0.0, np.log(np.where(label == y, TRUTH, 1 - TRUTH))))
        return 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -60, 60)))

    def refit(self, s: dict) -> LabelModel:
        """The maximum of the expected likelihood; thin counts lean on the plain rates."""
        mass = np.maximum(s["mass"], 1e-9)
        rate = (s["fire"] + np.array([[0.05], [0.1]])) / (mass[:, None] + 1)
        given = np.stack([rate, rate], axis=1)
        at = np.flatnonzero(self.parent >= 0)
        if len(at):
            up, both, lean = s["fire"][:, self.parent[at]], s["edge"][:, at], 5.0
            given[:, 1, at] = (both + lean * rate[:, at]) / (up + lean)
            given[:, 0, at] = (s["fire"][:, at] - both + lean * rate[:, at]) / (mass[:, None] - up + lean)
        return LabelModel(self.n, (s["mass"] + 1) / (s["mass"].sum() + 2), rate, self.parent, given)


def dependency_tree(mass: np.ndarray, fire: np.ndarray, pair: np.ndarray, least: float = 5.0) -> np.ndarray:
    """Parents of the voters: the forest with the largest mutual information given the
    label, out of pairs that fire together more often than alone (``least`` times)."""
    n = fire.shape[1]
    total = max(mass.sum(), 1e-9)
    gain = np.zeros((n, n))
    for y in (0, 1):
        m = max(mass[y], 1e-9)
        pj = np.clip(fire[y] / m, 1e-9, 1 - 1e-9)
        both = np.clip(pair[y] / m, 0, 1)
        cells = (both, pj[:, None] - both, pj[None, :] - both, 1 - pj[:, None] - pj[None, :] + both)
        plain = (pj[:, None] * pj[None, :], pj[:, None] * (1 - pj[None, :]), (1 - pj[:, None]) * pj[None, :], (1 - pj[:, None]) * (1 - pj[None, :]))
        for c, q in zip(cells, plain, strict=True):
            c = np.maximum(c, 1e-12)
            gain += mass[y] / total * c * np.log(c / q)
    gain[(pair.sum(axis=0) < least)] = 0
    np.fill_diagonal(gain, 0)
    parent = np.full(n, -1)
    group = np.arange(n)
    near: dict[int, list[int]] = {}
    i, j = np.nonzero(np.triu(gain) > 0)
    for k in np.argsort(-gain[i, j], kind="stable"):
        a, b = int(i[k]), int(j[k])
        if group[a] != group[b]:
            group[group == group[a]] = group[b]
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    seen: set[int] = set()
    for root in range(n):       # direct every tree away from its first voter
        stack = [] if root in seen else [root]
        seen.update(stack)
        while stack:
            a = stack.pop()
            for b in near.get(a, ()):
                if b not in seen:
                    parent[b] = a
                    seen.add(b)
                    stack.append(b)
    return parent


def expected_counts(sets: DataFrame, model: LabelModel, labelled_only: bool = False, pairs: bool = False) -> dict:
    """One pass over the firing sets ``votes, y, n``: rows by posterior label, voters that
    fire, voters that fire with their parent (with ``pairs``: with any other), and
    labelled rows. ``labelled_only`` takes the given labels for true."""
    n = model.n
    shared = sets.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total: dict[str, np.ndarray] = {"mass": np.zeros(2), "fire": np.zeros((2, n)), "edge": np.zeros((2, n)), "labelled": np.zeros(1)}
        if pairs:
            total["pair"] = np.zeros((2, n, n))
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x, y, count = m.matrix(batch.column(0).to_pylist()), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float)
                if labelled_only:
                    post, count = (y == 1).astype(float), count * (y >= 0)
                else:
                    post = m.posterior(x, y)
                for label, w in ((0, count * (1 - post)), (1, count * post)):
                    total["mass"][label] += w.sum()
                    total["fire"][label] += w @ x
                    total["edge"][label] += w @ (x * np.where(m.parent >= 0, x[:, m.parent], 0.0))
                    if pairs:
                        total["pair"][label] += (x * w[:, None]).T @ x
                total["labelled"][0] += count[y >= 0].sum()
        for name, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(v.ravel()[at])], names=["name", "at", "v"])

    out = {"mass": np.zeros(2), "fire": np.zeros((2, n)), "edge": np.zeros((2, n)), "labelled": np.zeros(1), "pair": np.zeros((2, n, n))}
    for r in sets.mapInArrow(run, "name string, at long, v double").groupBy("name", "at").agg(F.sum("v").alias("v")).collect():
        out[r["name"]].ravel()[r["at"]] = r["v"]
    return {k: v[0] if v.size == 1 else v for k, v in out.items()}


def fit_label_model(sets: DataFrame, n: int, steps: int = EM_STEPS) -> LabelModel:
    """Start from the labelled rows (voters apart), learn the tree from all rows under
    that model, then expectation maximisation."""
    model = LabelModel.start(n)
    first = expected_counts(sets, model, labelled_only=True)
    if first["labelled"]:
        model = model.refit(first)
    every = expected_counts(sets, model, pairs=True)
    parent = dependency_tree(every["mass"], every["fire"], every["pair"])
    every["edge"] = np.where(parent >= 0, every["pair"][:, np.arange(n), parent], 0.0)
    model = replace(model, parent=parent).refit(every)
    for _ in range(steps):
        model = model.refit(expected_counts(sets, model))
    return model


def fit_logistic(row: np.ndarray, col: np.ndarray, val: np.ndarray, width: int, y: np.ndarray, w: np.ndarray,
                 l2: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Newton steps on weighted soft labels; the last coefficient is the bias.

    The features are given by their non-zero cells, and each step is solved by
    conjugate gradients, so that the cost follows the cells, not the width."""
    n = len(y)
    row, col, val = np.append(row, np.arange(n)), np.append(col, np.full(n, width)), np.append(val, np.ones(n))
    times = lambda b: np.bincount(row, val * b[col], n)
    back = lambda r: np.bincount(col, val * r[row], width + 1)
    b = np.zeros(width + 1)
    w = w / max(w.sum(), 1e-9)
    ridge = np.append(np.full(width, l2), 0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(b), -30, 30)))
        g = back(w * (p - y)) + ridge * b
        c = w * np.maximum(p * (1 - p), 1e-6)
        damp = np.append(np.full(width, l2), 1e-9)
        scale = np.bincount(col, val ** 2 * c[row], width + 1) + damp
        d, r = np.zeros(width + 1), g.copy()
        z = r / scale
        q, rz = z.copy(), r @ z
        stop = 1e-20 * rz
        for _ in range(2 * (width + 1)):
            if rz <= stop:
                break
            hq = back(c * times(q)) + damp * q
            a = rz / (q @ hq)
            d, r = d + a * q, r - a * hq
            z = r / scale
            rz, old = r @ z, rz
            q = z + rz / old * q
        b -= d * min(1.0, 4 / (np.abs(d).max() + 1e-12))
        if np.abs(d).max() < 1e-6:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    ready(docs.sparkSession)
    known = training_labels(labels)
    model = Model(learn_lexicon(docs, known, text_col, id_col))
    src = docs.select(docs[id_col].cast("long").alias("_id"), text_of(docs[text_col]).alias("_text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, val, votes = [], [], []
            for text in batch.column(1):
                f, v = model.features(text.as_py())
                idx.append(list(f))
                val.append(list(f.values()))
                votes.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float64())),
                 pa.array(votes, pa.list_(pa.int32()))], names=["_id", "idx", "val", "votes"])

    rows = src.mapInArrow(featurise, "_id long, idx array<int>, val array<double>, votes array<int>")
    y = F.when(F.col("_toxic").isNull(), -1).otherwise((F.col("_toxic") >= 0.5).cast("int"))
    rows = store(rows.join(small_side(known, "toxic-known"), "_id", "left").select("_id", "idx", "val", "votes", y.alias("y")), "toxic-features")
    sets = store(rows.groupBy("votes", "y").agg(F.count("*").alias("n")), "toxic-sets")
    if sets.isEmpty():
        return Model([], [0.0] * N_PATTERNS, 0.0)
    judge = docs.sparkSession.sparkContext.broadcast(fit_label_model(sets, model.voters))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = judge.value
        for batch in batches:
            post = [m.posterior(m.matrix(part.column(0).to_pylist()), part.column(1).to_numpy())
                    for part in (batch.slice(k, 2048) for k in range(0, batch.num_rows, 2048))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(post) if post else [], pa.float64())],
                                             names=["votes", "y", "n", "post"])

    posts = store(sets.mapInArrow(judged, "votes array<int>, y int, n long, post double"), "toxic-posterior")
    # the sample: likely toxic and other rows by content hash, weighted back to their shares
    rows = rows.join(posts.select("votes", "y", "post"), ["votes", "y"])
    order = F.xxhash64("_id", "idx", "val")
    parts = []
    for side in (F.col("post") >= 0.5, F.col("post") < 0.5):
        n = posts.where(side).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        sample = rows.where(side).select("idx", "val", "post", order.alias("o")).orderBy("o").limit(fit_rows // 2).toPandas()
        parts.append(sample.assign(w=n / max(len(sample), 1)))
    sample = pd.concat(parts, ignore_index=True)
    sizes = [len(idx) for idx in sample["idx"]]
    cells = lambda name, kind: np.array([v for vs in sample[name] for v in vs], kind)
    b = fit_logistic(np.repeat(np.arange(len(sample)), sizes), cells("idx", int), cells("val", float),
                     len(model.lexicon) + N_PATTERNS, sample["post"].to_numpy(float), sample["w"].to_numpy(float), RIDGE)
    return Model(model.lexicon, [round(float(v), 9) for v in b[:-1]], round(float(b[-1]), 9))


def scores(text: Column, model: Model) -> Column:
    lexicon, weights, bias = model.lexicon, model.weights, model.bias

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        m = Model(lexicon, weights, bias)
        return texts.map(m.score).astype("float64")
    return run(text_of(text))


def predict(docs: DataFrame, labels: DataFrame, model: Model | None = None, text_col: str = "text",
            id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``."""
    model = model or fit(docs, labels, text_col, id_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), scores(docs[text_col], model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, model: Model | None = None, text_col: str = "text",
           id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows called toxic; all columns as they were."""
    model = model or fit(docs, labels, text_col, id_col)
    return docs.where(scores(docs[text_col], model) < 0.5)
