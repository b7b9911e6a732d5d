"""Small generators of oracle SQL text for per-column rules (the oracle is
plain DuckDB SQL; these only repeat a per-column fragment)."""

from __future__ import annotations


def union_all(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def iqr_sql(src: str, cols: list[str], keep_zero: bool = True) -> str:
    """Per numeric column quartiles, fences and outlier counts."""
    parts = []
    for c in cols:
        parts.append(f"""select '{c}' as "column", q1, q3, q1 - 1.5*(q3-q1) as lower_bound, q3 + 1.5*(q3-q1) as upper_bound,
  (select cast(count(*) as bigint) from {src} s where s.{c} < q1 - 1.5*(q3-q1) or s.{c} > q3 + 1.5*(q3-q1)) as outlier_count,
  nn as non_null
from (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3, cast(count({c}) as bigint) as nn from {src})""")
    body = union_all(parts)
    where = "" if keep_zero else "where outlier_count > 0"
    return f"""select *, round(outlier_count / greatest(non_null, 1), 4) as outlier_ratio from ({body}) x {where}"""


def accuracy_sql(src: str, cols: list[str]) -> str:
    return f"""select cast({len(cols)} as bigint) as numeric_columns, cast(count(*) as bigint) as outlier_columns,
  round(1 - coalesce(sum(outlier_ratio), 0) / {float(max(len(cols), 1))}, 4) as score
from ({iqr_sql(src, cols, keep_zero=False)}) a"""


# strftime equivalents of tabflow.functions.columns.DATETIME_FORMATS
DUCK_DATE_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M",
                     "%Y-%m-%d", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d", "%m/%d/%Y", "%d.%m.%Y"]
DATE_GUARD = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"


def date_ratio_sql(c: str) -> str:
    fmts = "[" + ", ".join(f"'{f}'" for f in DUCK_DATE_FORMATS) + "]"
    return (f"avg(case when {c} is not null then (regexp_matches(trim({c}), '{DATE_GUARD}') "
            f"and try_strptime(trim({c}), {fmts}) is not null)::int::double end)")


def id_name_sql(name_expr: str) -> str:
    pats = ["id", "idx", "index", "key", "uuid", "serial", "code", "no", "num"]
    return "(" + " or ".join(f"contains(lower({name_expr}), '{p}')" for p in pats) + ")"


def profile_sql(src: str, cols: list[tuple[str, str]]) -> str:
    """Per-column stats in SQL: (col, kind) pairs; kind in integer/float/bool/string/datetime."""
    parts = []
    for i, (c, kind) in enumerate(cols):
        dr = date_ratio_sql(c) if kind == "string" else "cast(null as double)"
        if kind == "integer":
            seq = (f"(select case when count(*) > 1 then (select count(*) from (select distinct {c} as v from {src} where {c} is not null) a "
                   f"where exists (select 1 from {src} b where b.{c} = a.v + 1)) / greatest(count(*) - 1, 1) else 0.0 end "
                   f"from {src} where {c} is not null)")
        else:
            seq = "0.0"
        al = f"avg(length({c}))" if kind == "string" else "cast(null as double)"
        parts.append(f"select '{c}' as \"column\", {i} as idx, '{kind}' as kind, count(*) as n_rows, count({c}) as non_null, "
                     f"count(distinct {c}) as nunique, {dr} as date_ratio, {seq} as seq_ratio, {al} as avg_len "
                     f"from {src}")
    return "select *, nunique / greatest(n_rows, 1) as unique_ratio, " + id_name_sql('"column"') + " as id_name from (" + union_all(parts) + ")"


FIELD_TYPE_CASE = """case
  when kind = 'datetime' then 'datetime'
  when kind = 'string' and coalesce(date_ratio, 0) >= 0.7 then 'datetime'
  when kind in ('integer', 'float', 'bool') then
    case when kind = 'integer' and unique_ratio > 0.9 and (id_name or seq_ratio > 0.95) then 'id'
         when nunique = 2 then 'binary'
         when nunique <= least(10, greatest(2, floor(n_rows * 0.05))) then 'categorical'
         else 'numeric' end
  when nunique = 2 then 'binary'
  when (nunique > 100000 or (unique_ratio > 0.95 and nunique > 10000)) and (id_name or unique_ratio > 0.99) then 'id'
  when unique_ratio > 0.5 and nunique > 100 then 'text'
  else 'categorical' end"""
