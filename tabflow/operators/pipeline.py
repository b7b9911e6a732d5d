"""Fitted preprocessing pipeline (E19-E21, D1-D9 composed).

``Preprocessor.fit(train)`` learns every statistic on the training rows only,
stage by stage (each stage is fitted on the output of the previous ones);
``PreprocessorModel.transform`` applies them to any frame (validation, test,
scoring batches or a stream) as projections plus size-checked lookup joins.
The learned state is a small JSON document plus lookup tables, saved under one
folder (Parquet + JSON) and loaded back unchanged.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.functions.columns import is_datetime, is_numeric, is_string
from tabflow.functions.ranking import top_k_per_group
from tabflow.operators import clean as CL
from tabflow.operators import features as FE
from tabflow.operators import text as TX
from tabflow.operators.stats import APPROX_ACCURACY, EXACT_QUANTILE_MAX_ROWS, exact_quantiles_large

WEIGHT_COL = "_sample_weight"


@dataclass
class PreprocessorConfig:
    target: str
    keep_columns: list = field(default_factory=list)        # passed through untouched (row keys), never features
    drop_columns: list = field(default_factory=list)
    ranges: dict = field(default_factory=dict)              # column -> [min, max]
    dedupe: bool = True
    drop_null_target: bool = True
    missing_drop_threshold: float | None = None
    numeric_impute: str = "median"
    categorical_impute: str = "mode"
    numeric_constant: float = 0.0
    categorical_constant: str = "missing"
    log_skew_threshold: float = 1.0
    feature_engineering: bool = True
    outlier_strategy: str = "iqr"
    scaler: str = "auto"
    rare_threshold: int = FE.RARE_THRESHOLD
    one_hot_max: int = FE.ONE_HOT_MAX
    target_encoding_min: int = FE.TARGET_ENCODING_MIN
    te_smoothing: float = FE.TE_SMOOTHING
    missing_indicator: bool = True
    missing_indicator_rate: float = FE.MISSING_INDICATOR_RATE
    datetime_cyclical: bool = True
    correlation_threshold: float = FE.CORRELATION_THRESHOLD
    low_variance_threshold: float = FE.LOW_VARIANCE_THRESHOLD
    enable_pca: bool = False
    pca_variance: float = FE.PCA_VARIANCE
    text_features: bool = False     # embeddings `{col}_emb_i` of text columns
    text_dims: int = 16
    text_max_terms: int = TX.MAX_TERMS
    legacy_order: bool = False      # learn encodings before rare-merge, as the reference does
    exact: object = "auto"          # True / False / "auto" (exact up to 10M training rows)


class Preprocessor:
    """Fits all statistics with a few fused passes over the training rows:

    1. one aggregate: feature roles, missing rates, raw quantiles (median fill,
       IQR fences), moments (mean fill, skewness for log columns, min/max), target mean;
    2. one ``(column, value)`` shuffle for all categorical columns: counts and
       target sums per value → modes, rare sets, one-hot lists, target encodings;
    3. one numeric aggregate: pooled outlier share (scaler choice) and the
       quantiles of the median-filled values (robust scaler);
    4. one scan of the transformed features for correlations, one for variances.

    Text columns, where asked for, are learned beside passes 2 and 3 (:mod:`text`).
    """

    def __init__(self, config: PreprocessorConfig):
        self.config = config

    def _rules(self, df: DataFrame) -> DataFrame:
        c = self.config
        df = CL.drop_columns(df, list(c.drop_columns))
        if c.ranges:
            df = CL.range_constraint(df, {k: tuple(v) for k, v in c.ranges.items() if k in df.columns})
        return df

    def fit(self, train: DataFrame) -> "PreprocessorModel":
        c = self.config
        t = c.target
        state: dict = {"config": asdict(c), "raw_schema": train.schema.json()}
        tables: dict[str, DataFrame] = {}
        # cleaning rules in the reference's order: dedupe, null target (only when the
        # target is present), high-missing columns (learned), listed columns, ranges
        base = train
        if t in base.columns:
            if c.dedupe:
                base = CL.drop_duplicates(base)
            if c.drop_null_target:
                base = CL.drop_null_target(base, t)
        if c.missing_drop_threshold is not None:
            state["missing_drop"] = CL.fit_high_missing(base, c.missing_drop_threshold, t)
            base = CL.drop_columns(base, state["missing_drop"])
        base = self._rules(base)
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
        model = PreprocessorModel(c, state, tables)
        kept = None
        try:
            n = base.count()                               # also materialises the cached rows
            # quantile mode: inline exact map (small), exact selection (large), or sketch (exact=False)
            self._qmode = "approx" if c.exact is False else ("inline" if n <= EXACT_QUANTILE_MAX_ROWS else "select")
            self._pass1(base, state)
            roles = state["roles"]
            # passes 2 (categorical) and 3 (numeric) only depend on pass 1: run them concurrently
            from concurrent.futures import ThreadPoolExecutor
            with ThreadPoolExecutor(max_workers=2) as pool:
                futs = []
                if roles["categorical"]:
                    futs.append(pool.submit(self._pass2_categorical, base, state, tables))
                if c.feature_engineering and roles["numeric"]:
                    futs.append(pool.submit(self._pass3_numeric, base, state))
                if c.feature_engineering and c.text_features:
                    futs += [pool.submit(self._pass_text, base, x, state, tables) for x in roles["text"]]
                for fu in futs:
                    fu.result()
            if c.feature_engineering:
                cur = model._stage_text(model._stage_dates(model._stage_encode(model._stage_rare(model._stage_scale(
                    model._stage_log(model._stage_fill(base)))))))
                feats = model._numeric_features(cur)
                if state.get("text"):   # the scans below must not embed the texts again
                    cur = kept = cur.select(*feats).persist(StorageLevel.MEMORY_AND_DISK)
                if feats:
                    self._pass4_selection(cur, feats, state)
                cur = model._stage_drop(cur)
                feats = model._numeric_features(cur)
                if c.enable_pca and len(feats) >= 10:
                    pca, k, ratios, means = FE.fit_pca(cur.select(*[F.col(x).cast("double") for x in feats]), feats,
                                                       variance=c.pca_variance)
                    state["pca"] = {"columns": feats, "k": k, "means": means,
                                    "components": pca[:, :k].tolist()}
            state["feature_columns"] = model._numeric_features(model.transform(base.limit(0)))
        finally:
            base.unpersist()
            if kept is not None:
                kept.unpersist()
        return model

    # ---- pass 1: one aggregate over the cleaned training rows
    def _pass1(self, base: DataFrame, state: dict) -> None:
        c = self.config
        t = c.target
        feats = [x for x in base.columns if x not in (t, WEIGHT_COL) and x not in c.keep_columns]
        num = [x for x in feats if is_numeric(base.schema[x].dataType, include_bool=True)]
        dt = [x for x in feats if is_datetime(base.schema[x].dataType)]
        strs = [x for x in feats if is_string(base.schema[x].dataType)]
        probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        aggs = [F.count(F.lit(1)).alias("n")]
        if t in base.columns and is_numeric(base.schema[t].dataType, include_bool=True):
            aggs.append(F.avg(F.col(t).cast("double")).alias("tmean"))
        for i, x in enumerate(strs):
            aggs += [F.approx_count_distinct(x).alias(f"sd{i}"),
                     F.avg(F.length(F.coalesce(F.col(x), F.lit("None")))).alias(f"sl{i}")]
        for i, x in enumerate(feats):
            aggs.append(F.avg(F.col(x).isNull().cast("double")).alias(f"mr{i}"))
        for i, x in enumerate(num):
            v = F.col(x).cast("double")
            if self._qmode != "select":
                q = F.percentile(v, probs) if self._qmode == "inline" else F.percentile_approx(v, [0.25, 0.5, 0.75], APPROX_ACCURACY)
                aggs.append(q.alias(f"q{i}"))
            aggs += [F.count(v).alias(f"nn{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}"),
                     F.min(v).alias(f"lo{i}"), F.skewness(v).alias(f"g{i}")]
        row = base.agg(*aggs).first()
        sel = exact_quantiles_large(base, num, [0.25, 0.5, 0.75]) if self._qmode == "select" and num else {}
        n = max(row["n"], 1)
        text = [x for i, x in enumerate(strs) if row[f"sd{i}"] / n > 0.5 and (row[f"sl{i}"] or 0) > 15]
        cats = [x for x in strs if x not in text]
        state["roles"] = {"numeric": num, "categorical": cats, "text": text, "datetime": dt}
        state["n_train"] = row["n"]
        state["target_mean"] = row["tmean"] if "tmean" in row.asDict() else None
        mr = {x: row[f"mr{i}"] or 0.0 for i, x in enumerate(feats)}
        state["indicators"] = [x for x in num + cats + dt if mr[x] > c.missing_indicator_rate] \
            if c.missing_indicator and c.feature_engineering else []
        fills, stats = {}, {}
        for i, x in enumerate(num):
            q = sel[x] if x in sel else row[f"q{i}"]
            st = {"q1": q[0] if q else None, "med": q[1] if q else None, "q3": q[2] if q else None,
                  "nn": row[f"nn{i}"], "mean": row[f"m{i}"], "var": row[f"v{i}"], "min": row[f"lo{i}"], "g1": row[f"g{i}"]}
            stats[x] = st
            if c.numeric_impute == "median":
                fills[x] = st["med"] if st["med"] is not None else 0.0
            elif c.numeric_impute == "mean":
                fills[x] = st["mean"] if st["mean"] is not None else 0.0
            else:
                fills[x] = c.numeric_constant
        state["fills"] = fills
        state["numeric_stats"] = stats
        logs = []
        for x, st in stats.items():
            nn, g1 = st["nn"], st["g1"]
            if st["min"] is not None and st["min"] >= 0 and g1 is not None and nn > 2 and not math.isnan(g1):
                if g1 * math.sqrt(nn * (nn - 1)) / (nn - 2) > c.log_skew_threshold:
                    logs.append(x)
        state["log_columns"] = logs
        state["bounds"] = {x: (st["q1"] - 1.5 * (st["q3"] - st["q1"]), st["q3"] + 1.5 * (st["q3"] - st["q1"]))
                           for x, st in stats.items() if st["q1"] is not None} if c.outlier_strategy == "iqr" else {}

    # ---- pass 2: one (column, value) shuffle for every categorical column
    def _pass2_categorical(self, base: DataFrame, state: dict, tables: dict) -> None:
        c = self.config
        t = c.target
        cats = state["roles"]["categorical"]
        num_target = t in base.columns and is_numeric(base.schema[t].dataType, include_bool=True)
        y = F.col(t).cast("double") if num_target else F.lit(None).cast("double")
        pairs = F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("value")) for x in cats])
        vt = (base.select(F.inline(pairs), y.alias("_y")).groupBy("column", "value")
                  .agg(F.count(F.lit(1)).alias("cnt"), F.sum("_y").alias("sy"), F.count("_y").alias("ny"))
                  .persist(StorageLevel.MEMORY_AND_DISK))
        # fills (D7): most frequent non-null value, smallest on ties
        if c.categorical_impute == "mode":
            top = top_k_per_group(vt.where(F.col("value").isNotNull()), ["column"],
                                  [F.col("cnt").desc(), F.col("value").asc()], 1)
            got = {r["column"]: r["value"] for r in top.collect()}        # one row per column
            fill = {x: got.get(x, "missing") for x in cats}
        else:
            fill = {x: c.categorical_constant for x in cats}
        state["fills"] = {**state["fills"], **fill}
        if not c.feature_engineering:
            return
        fmap = F.create_map(*[v for x in cats for v in (F.lit(x), F.lit(fill[x]))])
        src = vt.where(F.col("value").isNotNull()) if c.legacy_order else \
            vt.withColumn("value", F.coalesce(F.col("value"), fmap[F.col("column")])) \
              .groupBy("column", "value").agg(F.sum("cnt").alias("cnt"), F.sum("sy").alias("sy"), F.sum("ny").alias("ny"))
        rare = src.where(F.col("cnt") < c.rare_threshold).select("column", "value").persist(StorageLevel.MEMORY_AND_DISK)
        tables["rare"] = rare
        state["n_rare"] = rare.count()
        enc = src if c.legacy_order else \
            src.withColumn("value", F.when(F.col("cnt") < c.rare_threshold, F.lit(FE.OTHER)).otherwise(F.col("value"))) \
               .groupBy("column", "value").agg(F.sum("cnt").alias("cnt"), F.sum("sy").alias("sy"), F.sum("ny").alias("ny"))
        enc = enc.persist(StorageLevel.MEMORY_AND_DISK)
        nd = {r["column"]: r["k"] for r in enc.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
        small = [x for x in cats if nd.get(x, 0) <= c.one_hot_max]
        oh: dict[str, list[str]] = {x: [] for x in small}
        for r in enc.where(F.col("column").isin(small)).select("column", "value").collect():   # ≤ one_hot_max per column
            oh[r["column"]].append(r["value"])
        state["one_hot"] = {x: sorted(v) for x, v in oh.items()}
        te_cols = [x for x in cats if nd.get(x, 0) >= c.target_encoding_min] if num_target else []
        if te_cols:
            g = state["target_mean"]
            te = enc.where(F.col("column").isin(te_cols) & (F.col("ny") > 0)).select(
                "column", "value", ((F.col("sy") + F.lit(g) * c.te_smoothing) / (F.col("ny") + c.te_smoothing)).alias("te"))
            tables["te"] = te.persist(StorageLevel.MEMORY_AND_DISK)
            state["te_columns"], state["te_global"], state["n_te"] = te_cols, g, tables["te"].count()

    # ---- text columns: an embedding table each, learned on the training texts
    def _pass_text(self, base: DataFrame, col: str, state: dict, tables: dict) -> None:
        table, values = TX.fit_embedding(base, col, self.config.text_dims, self.config.text_max_terms)
        if values:
            tables[f"text_{col}"] = table
            state.setdefault("text", {})[col] = len(values)

    # ---- pass 3: scaler choice (pooled outliers on raw values) and filled quantiles
    def _pass3_numeric(self, base: DataFrame, state: dict) -> None:
        c = self.config
        num = state["roles"]["numeric"]
        b, fills, stats = state["bounds"], state["fills"], state["numeric_stats"]
        kind = c.scaler
        aggs = []
        if kind == "auto":
            out = sum((F.coalesce(F.sum(((F.col(x) < b[x][0]) | (F.col(x) > b[x][1])).cast("bigint")), F.lit(0))
                       for x in num if x in b), F.lit(0))
            tot = sum((F.count(F.col(x)) for x in num if x in b), F.lit(0))
            aggs += [out.alias("o"), tot.alias("tot")]
        filled_q = {}
        if kind in ("auto", "robust"):
            if self._qmode == "select":
                filled = base.select(*[F.coalesce(F.col(x).cast("double"), F.lit(fills[x])).alias(x) for x in num])
                filled_q = exact_quantiles_large(filled, num, [0.25, 0.5, 0.75]) if kind == "robust" else {}
            else:
                for i, x in enumerate(num):
                    v = F.coalesce(F.col(x).cast("double"), F.lit(fills[x]))
                    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) if self._qmode == "inline" \
                        else F.percentile_approx(v, [0.25, 0.5, 0.75], APPROX_ACCURACY)
                    aggs.append(q.alias(f"fq{i}"))
        row = base.agg(*aggs).first() if aggs else None
        if kind == "auto":
            kind = "robust" if (row["o"] / max(row["tot"], 1)) > FE.ROBUST_SWITCH_SHARE else "standard"
            if kind == "robust" and self._qmode == "select":
                filled = base.select(*[F.coalesce(F.col(x).cast("double"), F.lit(fills[x])).alias(x) for x in num])
                filled_q = exact_quantiles_large(filled, num, [0.25, 0.5, 0.75])
        state["scaler_kind"] = kind
        n = state["n_train"]
        params = {}
        for i, x in enumerate(num):
            st = stats[x]
            f = fills[x]
            if kind == "robust":
                q1, q2, q3 = filled_q[x] if x in filled_q else row[f"fq{i}"]
                params[x] = {"fill": f, "center": q2, "scale": (q3 - q1) if q3 != q1 else 1.0}
            elif kind == "standard":
                # moments of the median-filled values from the non-null moments (stable pooled form)
                nn = st["nn"] or 0
                mean_nn = st["mean"] if st["mean"] is not None else f
                var_nn = st["var"] or 0.0
                mean_f = (nn * mean_nn + (n - nn) * f) / max(n, 1)
                var_f = (nn * (var_nn + (mean_nn - mean_f) ** 2) + (n - nn) * (f - mean_f) ** 2) / max(n, 1)
                sd = math.sqrt(max(var_f, 0.0))
                params[x] = {"fill": f, "center": mean_f, "scale": sd if sd > 0 else 1.0}
        if kind == "minmax":
            mm = base.agg(*[F.min(F.coalesce(F.col(x).cast("double"), F.lit(fills[x]))).alias(f"a{i}") for i, x in enumerate(num)],
                          *[F.max(F.coalesce(F.col(x).cast("double"), F.lit(fills[x]))).alias(f"b{i}") for i, x in enumerate(num)]).first()
            for i, x in enumerate(num):
                lo, hi = mm[f"a{i}"], mm[f"b{i}"]
                params[x] = {"fill": fills[x], "center": lo, "scale": (hi - lo) if hi != lo else 1.0}
        state["scaler"] = params if kind != "none" else {}

    # ---- pass 4: correlation / variance filters on the transformed features
    def _pass4_selection(self, cur: DataFrame, feats: list[str], state: dict) -> None:
        c = self.config
        corr = FE.correlation_matrix(cur, feats, fill_median=False)
        var = FE.variance_table(cur, feats, c.low_variance_threshold)
        rows = [(r["col_a"], r["col_b"], r["corr"]) for r in corr.collect()]     # p(p-1)/2 numbers
        state["corr_drop"] = [d for d, _ in FE.correlation_drop(rows, feats, c.correlation_threshold)]
        state["var_drop"] = [r["column"] for r in var.where("dropped").collect()]


class PreprocessorModel:
    def __init__(self, config: PreprocessorConfig, state: dict, tables: dict[str, DataFrame]):
        self.config, self.state, self.tables = config, state, tables

    # ---- stages
    def _stage_fill(self, df):
        ind = [c for c in self.state.get("indicators", []) if c in df.columns]
        df = FE.add_missing_indicators(df, ind) if ind else df
        return CL.apply_fill(df, {k: v for k, v in self.state.get("fills", {}).items() if k in df.columns})

    def _stage_log(self, df):
        cols = [c for c in self.state.get("log_columns", []) if c in df.columns]
        return CL.add_log_columns(df, cols) if cols else df

    def _stage_scale(self, df):
        b = {k: v for k, v in self.state.get("bounds", {}).items() if k in df.columns}
        df = FE.clip_to_bounds(df, b) if b else df
        p = {k: v for k, v in self.state.get("scaler", {}).items() if k in df.columns}
        return FE.apply_scaler(df, p) if p else df

    def _stage_rare(self, df):
        cats = [c for c in self.state["roles"]["categorical"] if c in df.columns]
        if "rare" not in self.tables or not cats:
            return df
        return FE.apply_rare_merge(df, self.tables["rare"], cats, n_rare=self.state.get("n_rare"))

    def _stage_encode(self, df):
        oh = {k: v for k, v in self.state.get("one_hot", {}).items() if k in df.columns}
        df = FE.apply_one_hot(df, oh) if oh else df
        te = [c for c in self.state.get("te_columns", []) if c in df.columns]
        if te:
            df = FE.apply_target_encoding(df, self.tables["te"], te, self.state["te_global"], n_rows=self.state.get("n_te"))
        return df

    def _stage_dates(self, df):
        cols = [c for c in self.state["roles"]["datetime"] if c in df.columns]
        return FE.add_date_parts(df, cols, self.config.datetime_cyclical) if cols else df

    def _stage_text(self, df):
        for col, dims in sorted(self.state.get("text", {}).items()):
            if col in df.columns:
                df = df.withColumn("_tf_emb", TX.embedding(self.tables[f"text_{col}"], col, dims))
                df = df.select(*[x for x in df.columns if x != "_tf_emb"], *[F.col("_tf_emb")[i].alias(f"{col}_emb_{i}") for i in range(dims)])
        return df

    def _stage_drop(self, df):
        return df.drop(*(self.state.get("corr_drop", []) + self.state.get("var_drop", [])))

    def _stage_pca(self, df):
        p = self.state.get("pca")
        if not p:
            return df
        cols, comps, means = p["columns"], p["components"], p["means"]
        outs = []
        for j in range(p["k"]):
            e = sum(((F.col(c).cast("double") - F.lit(means[i])) * F.lit(comps[i][j]) for i, c in enumerate(cols)), F.lit(0.0))
            outs.append(e.alias(f"pca_{j}"))
        keep = [c for c in df.columns if c not in cols]
        return df.select(*keep, *outs)

    def _numeric_features(self, df):
        t = self.config.target
        return [f.name for f in df.schema.fields if f.name not in (t, WEIGHT_COL)
                and f.name not in self.config.keep_columns and is_numeric(f.dataType, include_bool=True)]

    @property
    def feature_columns(self) -> list[str]:
        return self.state.get("feature_columns", [])

    def transform(self, df: DataFrame) -> DataFrame:
        c = self.config
        df = CL.drop_columns(df, list(c.drop_columns) + self.state.get("missing_drop", []))
        if c.ranges:
            df = CL.range_constraint(df, {k: tuple(v) for k, v in c.ranges.items() if k in df.columns})
        df = self._stage_log(self._stage_fill(df))
        if c.feature_engineering:
            df = self._stage_scale(df)
            df = self._stage_encode(self._stage_rare(df))
            df = self._stage_drop(self._stage_text(self._stage_dates(df)))
            df = self._stage_pca(df)
        return df

    # ---- persistence
    def save(self, path: str) -> str:
        spark = next(iter(self.tables.values())).sparkSession if self.tables else SparkSession.getActiveSession()
        self.state["tables"] = sorted(self.tables)
        spark.createDataFrame([(json.dumps(self.state),)], "state string").coalesce(1).write.mode("overwrite").json(f"{path}/state")
        for name, t in self.tables.items():
            t.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PreprocessorModel":
        state = json.loads(spark.read.json(f"{path}/state").first()["state"])
        config = PreprocessorConfig(**state["config"])
        # the state names the tables that were saved: one that cannot be read is an error
        return cls(config, state, {name: spark.read.parquet(f"{path}/tables/{name}") for name in state["tables"]})
