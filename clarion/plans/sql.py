"""DuckDB SQL for the bindings, used only by the oracle side of the checks.

Generated from the same constants as the Spark bindings so both sides agree
by construction.  Every rounded output goes through ``r6`` (round to 6 places,
then ``+ 0.0`` so that a negative zero compares equal to zero).
"""

from __future__ import annotations

from clarion.sources.bindings import DEFECT_COLUMNS, LINE_FEATURES, SCORERS, WORD_SPLIT


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def _cents(c: str) -> str:
    return f"CAST(CAST(floor({c} * 100 + 0.5) AS BIGINT) AS VARCHAR)"


def _line_select(keep_orderkey: bool = False) -> str:
    key = ("md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), "
           "CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
           f"{_cents('l_quantity')}, {_cents('l_extendedprice')}, {_cents('l_discount')}, "
           f"{_cents('l_tax')}, l_returnflag, l_linestatus))")
    net = "(l_extendedprice * (1 - l_discount))"
    cols = [f"{key} AS row_id", "l_quantity AS quantity", "l_extendedprice AS ext",
            "l_discount AS discount", "l_tax AS tax", f"{net} AS net", f"({net} * (1 + l_tax)) AS charge",
            "(l_extendedprice / l_quantity) AS unit", "CAST(l_returnflag = 'R' AS INTEGER) AS label"]
    if keep_orderkey:
        cols.append("l_orderkey")
    return "SELECT " + ", ".join(cols) + " FROM lineitem"


LINE_FEATURES_CTE = f"line_features AS ({_line_select()})"


def with_missing_cte() -> str:
    sel = ", ".join(
        f"CASE WHEN l_orderkey % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE {c} END AS {c}" if c in DEFECT_COLUMNS
        else c for c in LINE_FEATURES)
    return (f"_lf_ok AS ({_line_select(True)}), "
            f"_damaged AS (SELECT row_id, {sel}, label, l_orderkey FROM _lf_ok), "
            "with_missing AS (SELECT * EXCLUDE (l_orderkey) FROM _damaged "
            "UNION ALL SELECT * EXCLUDE (l_orderkey) FROM _damaged WHERE l_orderkey % 23 = 0)")


def _lit(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def scorer_logit_sql(name: str) -> str:
    b0, w = SCORERS[name]
    expr = _lit(b0)
    for feat, coef in w.items():
        expr = f"({expr} + {_lit(coef)} * {feat})"
    return expr


def squash_sql(z: str) -> str:
    return f"(0.5 + 0.5 * ({z}) / (1.0 + abs({z})))"


def scored_cte(source: str = "line_features") -> str:
    parts = [f"SELECT row_id, '{n}' AS model, label, {squash_sql(scorer_logit_sql(n))} AS score "
             f"FROM {source}" for n in SCORERS]
    return "scored AS (" + " UNION ALL ".join(parts) + ")"


def split_cte(source: str = "line_features", fraction: float = 0.2, seed: int = 42, name: str = "split_rows") -> str:
    """T1 in SQL: rank within class by md5(seed|row_id), largest-remainder quota."""
    return f"""
_cnt_{name} AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
_tot_{name} AS (SELECT CAST(sum(n) AS BIGINT) AS total,
                 CAST(ceil(CAST({fraction!r} AS DOUBLE) * CAST(sum(n) AS BIGINT)) AS BIGINT) AS kall FROM _cnt_{name}),
_q0_{name} AS (SELECT label, n, kall, (kall * n) // total AS fl, (kall * n) % total AS rem
               FROM _cnt_{name}, _tot_{name}),
_q_{name} AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
                                   <= kall - sum(fl) OVER () THEN 1 ELSE 0 END AS k FROM _q0_{name}),
_rk_{name} AS (SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}' || '|' || row_id)) AS _rk
               FROM {source} s),
{name} AS (SELECT r.* EXCLUDE (_rk), CASE WHEN r._rk <= q.k THEN 'test' ELSE 'train' END AS split
           FROM _rk_{name} r JOIN _q_{name} q USING (label))
"""


def doc_features_cte(target: str = "quality") -> str:
    label = "(1 - l.quality)" if target == "quality" else "l.toxic"
    return f"""
_docs AS (SELECT d.doc_id, d.n_chars, d.text,
                 list_filter(regexp_split_to_array(d.text, '{WORD_SPLIT}'), lambda w: w <> '') AS words,
                 {label} AS label
          FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
doc_features AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(len(words) AS DOUBLE) AS n_words,
   CASE WHEN len(words) = 0 THEN 0.0 ELSE
        CAST(list_sum(list_transform(words, lambda w: length(w))) AS BIGINT) / len(words) END AS mean_word_len,
   CASE WHEN length(text) = 0 THEN 0.0 ELSE
        length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) END AS digit_share,
   CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_distinct(words)) / len(words) END AS unique_share,
   CAST(label AS INTEGER) AS label FROM _docs)
"""


VECTORS_CTE = ("vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, "
               "label AS true_label FROM embeddings)")

GRIDS_CTE = VECTORS_CTE + """,
_gx AS (SELECT vec_id AS image_id, list_min(v) AS mn, list_max(v) AS mx,
               unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM vectors),
grids AS (SELECT image_id, CAST(pos // 8 AS INTEGER) AS r, CAST(pos % 8 AS INTEGER) AS c,
                 CAST(CASE WHEN mx = mn THEN 0 ELSE floor((x - mn) / (mx - mn) * 255) END AS INTEGER) AS level
          FROM _gx)"""

HEAT_MASK_CTE = GRIDS_CTE + """,
_nxt AS (SELECT image_id - 1 AS image_id, r, c, level AS nlevel FROM grids),
_has AS (SELECT DISTINCT image_id - 1 AS image_id, TRUE AS has_mask FROM grids),
heat_mask AS (SELECT g.image_id, g.r, g.c, g.level / 255.0 AS heat,
                     CASE WHEN n.nlevel > 127 THEN 1 ELSE 0 END AS mask,
                     coalesce(h.has_mask, FALSE) AS has_mask
              FROM grids g LEFT JOIN _nxt n USING (image_id, r, c) LEFT JOIN _has h USING (image_id))"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
