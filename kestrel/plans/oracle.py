"""DuckDB SQL oracles for the registered queries (same names, same columns).

The online trainers are recursive CTEs: one recursion step = one iteration, the
step index ``s`` gives the window (``s div T``); the per-window sums of products
are joined in (or, for the logistic rule, the window's rows are aggregated in the
recursive member).  Those inputs are MATERIALIZED CTEs so the recursion does not
recompute them at every step.
"""

from __future__ import annotations

from kestrel.plans import params as P


def _f(v: float) -> str:
    return f"{float(v)!r}::DOUBLE"


# ---- shared CTE pieces --------------------------------------------------------

PTS = """pts AS (
  SELECT event_id AS seq, ts, user_id, value,
         date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day,
         [(user_id % 10) / 10, value / 100, 1.0::DOUBLE] AS x,
         (CASE WHEN event_type = 'purchase' THEN 1.0 ELSE -1.0 END)::DOUBLE AS y,
         event_id % 10 = 0 AS holdout
  FROM events),
train AS (SELECT * FROM pts WHERE NOT holdout)"""

EMB = """train AS (
  SELECT vec_id AS seq,
         list_concat(list_transform(embedding, lambda v: v::DOUBLE), [1.0::DOUBLE]) AS x,
         (CASE WHEN label % 2 = 0 THEN -1.0 ELSE 1.0 END)::DOUBLE AS y
  FROM embeddings)"""


def _windows(B: int) -> str:
    return f"""ord AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // {B} AS block FROM train),
win AS MATERIALIZED (SELECT * FROM ord WHERE block < (SELECT count(*) // {B} FROM ord))"""


def _gram_narrow(dim: int, src: str, key: str) -> str:
    rows = ", ".join("[" + ", ".join(f"sum(x[{i}] * x[{j}])" for j in range(1, dim + 1)) + "]"
                     for i in range(1, dim + 1))
    c = ", ".join(f"sum(x[{i}] * y)" for i in range(1, dim + 1))
    return f"""SELECT {key}, count(*)::DOUBLE AS n, [{rows}] AS gm, [{c}] AS c FROM {src} GROUP BY {key}"""


def _gram_exact(scale: int = 0) -> str:
    """Sums of products of the events points in exact decimals (tenths, cents and ones), each
    read back as the nearest double; ``scale``: features times 10^scale."""
    cols = [("a", -1), ("b", -2), ("o", 0)]

    def total(expr: str, power: int) -> str:
        return f"(sum({expr})::VARCHAR || 'e{power}')::DOUBLE"
    rows = ", ".join("[" + ", ".join(total(f"{u} * {v}", p + q + 2 * scale) for v, q in cols) + "]" for u, p in cols)
    c = ", ".join(total(f"{u} * yd", p + scale) for u, p in cols)
    return f"""wd AS (SELECT block, (user_id % 10)::DECIMAL(18, 0) AS a, value::DECIMAL(18, 6) AS b,
              1::DECIMAL(18, 0) AS o, y::DECIMAL(18, 0) AS yd FROM win),
g AS MATERIALIZED (SELECT block, count(*)::DOUBLE AS n, [{rows}] AS gm, [{c}] AS c FROM wd GROUP BY block)"""


def _gram_wide(dim: int) -> str:
    return f"""e AS (SELECT block, seq, y, unnest(x) AS xv, unnest(generate_series(1, {dim})) AS i FROM win),
gij AS (SELECT a.block, a.i, b.i AS j, sum(a.xv * b.xv) AS v
        FROM e a JOIN e b ON a.block = b.block AND a.seq = b.seq GROUP BY a.block, a.i, b.i),
grow AS (SELECT block, i, list(v ORDER BY j) AS r FROM gij GROUP BY block, i),
gc AS (SELECT block, i, sum(xv * y) AS cv, count(*) AS n FROM e GROUP BY block, i),
g AS MATERIALIZED (SELECT grow.block, list(grow.r ORDER BY grow.i) AS gm, list(gc.cv ORDER BY grow.i) AS c,
             any_value(gc.n)::DOUBLE AS n
      FROM grow JOIN gc ON grow.block = gc.block AND grow.i = gc.i GROUP BY grow.block)"""


def _zero(dim: int) -> str:
    return "[" + ", ".join(["0.0::DOUBLE"] * dim) + "]"


def _v1_fold(dim: int, T: int, step: float, reg: float, penalty: str, eps: float = 0.0) -> str:
    if penalty == "l2":
        pen = "it.w[i]"
    else:
        pen = (f"(CASE WHEN it.w[i] > {_f(eps)} THEN 1.0::DOUBLE WHEN it.w[i] < -{_f(eps)} "
               f"THEN -1.0::DOUBLE ELSE it.w[i] / {_f(eps)} END)")
    return f"""it(s, w) AS (
  SELECT 0, {_zero(dim)}
  UNION ALL
  SELECT s + 1, CASE WHEN nrm = 0 THEN w
                     ELSE list_transform(w, lambda wi, i: wi - (gv[i] / nrm) * {_f(step)}) END
  FROM (SELECT s, w, gv, sqrt(list_sum(list_transform(gv, lambda v: v * v))) AS nrm
        FROM (SELECT it.s, it.w,
                     list_transform(g.gm, lambda r, i:
                         (list_sum(list_transform(r, lambda rv, j: rv * it.w[j])) - g.c[i]) / g.n
                         + {_f(reg)} * {pen}) AS gv
              FROM it JOIN g ON g.block = it.s // {T}) a) b)"""


def _weights_out(T: int, dim: int, src: str = "it", extra: str = "") -> str:
    return f"""SELECT (s // {T} - 1)::BIGINT AS version, unnest(generate_series(0, {dim - 1})) AS idx,
       round(unnest(w), 6) AS weight
FROM {src} WHERE s % {T} = 0 AND s > 0 {extra}"""


def _v1_query(dim: int, penalty: str, reg: float, source: str = "events",
              latest: bool = False, scale: int = 0) -> str:
    T = P.ITERATIONS
    src = PTS if source == "events" else EMB
    gram = _gram_exact(scale) if source == "events" else _gram_wide(dim)
    extra = "AND s = (SELECT max(s) FROM it)" if latest else ""
    return f"""WITH RECURSIVE {src},
{_windows(P.WINDOW)},
{gram},
{_v1_fold(dim, T, P.STEP, reg, penalty, P.LASSO_EPS)}
{_weights_out(T, dim, extra=extra)}"""


# ---- V1 count-window queries --------------------------------------------------

def count_windows_sql() -> str:
    B = P.WINDOW
    return f"""WITH {PTS},
ord AS (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // {B} AS block FROM train),
nc AS (SELECT count(*) // {B} AS n_closed FROM ord)
SELECT block::BIGINT AS block, count(*) AS n_rows, any_value(block < (SELECT n_closed FROM nc)) AS closed,
       min(seq) AS first_seq, max(seq) AS last_seq
FROM ord GROUP BY block"""


def window_gram_sql() -> str:
    dim = P.POINTS_DIM
    p = dim + 1
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    zs = ", ".join(f"x[{i + 1}] AS z{i}" for i in range(dim)) + f", y AS z{dim}"
    sums = ", ".join(f"sum(z{i} * z{j})" for i, j in pairs)
    ii = ", ".join(str(i) for i, _ in pairs)
    jj = ", ".join(str(j) for _, j in pairs)
    return f"""WITH {PTS},
{_windows(P.WINDOW)},
g AS (SELECT block, count(*) AS n, [{sums}] AS s FROM (SELECT block, {zs} FROM win) GROUP BY block)
SELECT block::BIGINT AS block, n, unnest([{ii}]::BIGINT[]) AS i, unnest([{jj}]::BIGINT[]) AS j,
       round(unnest(s), 8) AS value
FROM g"""


def online_ridge_sql() -> str:
    return _v1_query(P.POINTS_DIM, "l2", P.RIDGE_REG)


def online_ridge_small_scale_sql() -> str:
    return _v1_query(P.POINTS_DIM, "l2", 0.0, scale=P.SMALL_SCALE)


def online_lasso_sql() -> str:
    return _v1_query(P.POINTS_DIM, "huber", P.LASSO_REG)


def latest_model_sql() -> str:
    return _v1_query(P.POINTS_DIM, "l2", P.RIDGE_REG, latest=True)


def wide_ridge_sql() -> str:
    return _v1_query(P.WIDE_DIM, "l2", P.RIDGE_REG, source="embeddings")


def model_preview_sql() -> str:
    T, dim = P.ITERATIONS, P.WIDE_DIM
    q = _v1_query(dim, "l2", P.RIDGE_REG, source="embeddings", latest=True)
    # first 100 weights at most
    return q.replace(f"unnest(generate_series(0, {dim - 1})) AS idx,\n       round(unnest(w), 6)",
                     f"unnest(generate_series(0, least({dim}, 100) - 1)) AS idx,\n"
                     f"       round(unnest(w[1:100]), 6)")


def ridge_holdout_trace_sql() -> str:
    T = P.ITERATIONS
    base = _v1_query(P.POINTS_DIM, "l2", P.RIDGE_REG)
    head = base[:base.rindex("SELECT (s //")]
    return head + f""",
vers AS (SELECT (s // {T} - 1)::BIGINT AS version, w FROM it WHERE s % {T} = 0 AND s > 0),
hold AS (SELECT x, y FROM pts WHERE holdout),
scored AS (SELECT version, CASE WHEN (CASE WHEN list_inner_product(hold.x, vers.w) > 0
                                             THEN 1.0 ELSE -1.0 END) <> hold.y THEN 1 ELSE 0 END AS miss
           FROM vers, hold)
SELECT version, count(*) AS n_test, sum(miss)::BIGINT AS n_err,
       round(sum(miss) / count(*), 6) AS error_rate
FROM scored GROUP BY version"""


def ridge_holdout_trace_pruned_sql() -> str:
    return f"SELECT *, true AS fewer FROM ({ridge_holdout_trace_sql()})"


def model_preview_cut_sql() -> str:
    dim = 2 * P.WIDE_DIM - 1
    squares = EMB.replace("[1.0::DOUBLE])", "list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE), [1.0::DOUBLE])")
    q = _v1_query(dim, "l2", P.RIDGE_REG, source="embeddings", latest=True).replace(EMB, squares)
    return q.replace(f"unnest(generate_series(0, {dim - 1})) AS idx,\n       round(unnest(w), 6)",
                     "unnest(generate_series(0, 99)) AS idx,\n       round(unnest(w[1:100]), 6)")


def predict_other_stream_sql() -> str:
    T, base = P.ITERATIONS, _v1_query(P.POINTS_DIM, "l2", P.RIDGE_REG)
    head = base[:base.rindex("SELECT (s //")].replace("WHERE NOT holdout", "WHERE seq % 2 = 0")
    return head + f""",
vers AS (SELECT (s // {T} - 1)::BIGINT AS version, w FROM it WHERE s % {T} = 0 AND s > 0),
ended AS (SELECT block AS version, max(ts) AS ended FROM win GROUP BY block),
-- of versions that ended at one time the largest counts
last AS (SELECT max(version)::BIGINT AS version, ended FROM ended GROUP BY ended),
hit AS (SELECT p.seq, p.x, e.version FROM pts p ASOF JOIN last e ON p.ts >= e.ended WHERE p.seq % 2 = 1)
SELECT hit.seq, hit.version, round(list_inner_product(hit.x, vers.w), 6) AS prediction FROM hit JOIN vers USING (version)"""


def online_logistic_shared_sql() -> str:
    return online_logistic_sql(P.LARGE_WINDOW)


def online_logistic_sql(window: int = P.WINDOW) -> str:
    T, dim = P.ITERATIONS, P.POINTS_DIM
    gs = ", ".join(f"sum(x[{i}] * sc)" for i in range(1, dim + 1))
    return f"""WITH RECURSIVE {PTS},
{_windows(window)},
it(s, w) AS (
  SELECT 0, {_zero(dim)}
  UNION ALL
  SELECT s + 1, CASE WHEN nrm = 0 THEN w
                     ELSE list_transform(w, lambda wi, i: wi - (gv[i] / nrm) * {_f(P.STEP)}) END
  FROM (SELECT s, w, gv, sqrt(list_sum(list_transform(gv, lambda v: v * v))) AS nrm
        FROM (SELECT s, w, list_transform(gs, lambda v, i: v / n + {_f(P.LOGISTIC_REG)} * w[i]) AS gv
              FROM (SELECT s, w, count(*)::DOUBLE AS n, [{gs}] AS gs
                    FROM (SELECT it.s, it.w, win.x,
                                 (1.0 / (1.0 + exp(-win.y * list_inner_product(win.x, it.w))) - 1.0)
                                   * win.y AS sc
                          FROM it JOIN win ON win.block = it.s // {T}) r
                    GROUP BY s, w) a) b) c)
{_weights_out(T, dim)}"""


# ---- V2 micro-batch (per day) queries -----------------------------------------

def _sgd_update(updater: str, reg: float) -> str:
    if updater == "none":
        return "wi + (-st) * gv[i]"
    if updater == "l2":
        return f"wi * (1.0 - st * {_f(reg)}) + (-st) * gv[i]"
    if updater == "l1":
        v = "(wi + (-st) * gv[i])"
        return f"sign({v}) * greatest(0.0::DOUBLE, abs({v}) - {_f(reg)} * st)"
    raise ValueError(updater)


def _day_blocks(keys: str = "day") -> str:
    dim = P.POINTS_DIM
    return f"""gk AS ({_gram_narrow(dim, 'src', keys)}),
g AS MATERIALIZED (SELECT (dense_rank() OVER (ORDER BY {keys}) - 1) AS block, {keys}, n, gm, c FROM gk)"""


def _v2_fold(updater: str, reg: float, sampled: bool = False) -> str:
    T, dim = P.SGD_ITERATIONS, P.POINTS_DIM
    join = "LEFT JOIN" if sampled else "JOIN"
    cond = (f"g.block = it.s // {T} AND g.t = it.s % {T} + 1" if sampled
            else f"g.block = it.s // {T}")
    stop = f"WHERE it.s < (SELECT count(*) FROM days) * {T}" if sampled else ""
    return f"""it(s, w) AS (
  SELECT 0, {_zero(dim)}
  UNION ALL
  SELECT s + 1, CASE WHEN n IS NULL OR n = 0 THEN w
                     ELSE list_transform(w, lambda wi, i: {_sgd_update(updater, reg)}) END
  FROM (SELECT s, w, n, st,
               list_transform(gm, lambda r, i: (list_inner_product(r, w) - c[i]) / n) AS gv
        FROM (SELECT it.s, it.w, g.n, g.gm, g.c, {_f(P.SGD_STEP)} / sqrt(it.s % {T} + 1) AS st
              FROM it {join} g ON {cond} {stop}) a) b)"""


def _v2_query(updater: str, reg: float) -> str:
    return f"""WITH RECURSIVE {PTS},
src AS (SELECT * FROM train),
{_day_blocks()},
{_v2_fold(updater, reg)}
{_weights_out(P.SGD_ITERATIONS, P.POINTS_DIM)}"""


def linear_sgd_sql() -> str:
    return _v2_query("none", 0.0)


def ridge_sgd_sql() -> str:
    return _v2_query("l2", P.SGD_L2_REG)


def lasso_sgd_sql() -> str:
    return _v2_query("l1", P.SGD_L1_REG)


def linear_sgd_sampled_sql() -> str:
    T, dim = P.SGD_ITERATIONS, P.POINTS_DIM
    return f"""WITH RECURSIVE {PTS},
days AS MATERIALIZED (SELECT day, (dense_rank() OVER (ORDER BY day) - 1) AS block
                      FROM (SELECT DISTINCT day FROM train)),
src AS (SELECT days.block, t.t, train.x, train.y
        FROM train JOIN days USING (day), generate_series(1, {T}) t(t)
        WHERE ((train.seq * {P.HASH_A} + t.t * {P.HASH_B}) % {P.HASH_M}) / {P.HASH_M} < {_f(P.SAMPLE_FRACTION)}),
g AS MATERIALIZED ({_gram_narrow(dim, 'src', 'block, t')}),
{_v2_fold("none", 0.0, sampled=True)}
{_weights_out(T, dim)}"""


def _predict_sql(shift: int) -> str:
    T = P.SGD_ITERATIONS
    return f"""WITH RECURSIVE {PTS},
src AS (SELECT * FROM train),
{_day_blocks()},
{_v2_fold("none", 0.0)},
vers AS (SELECT (s // {T} - 1)::BIGINT AS version, w FROM it WHERE s % {T} = 0)
SELECT train.seq, round(list_inner_product(train.x, vers.w), 6) AS prediction
FROM train JOIN g ON train.day = g.day JOIN vers ON vers.version = g.block - {shift}"""


def predict_after_train_sql() -> str:
    return _predict_sql(0)


def predict_prequential_sql() -> str:
    return _predict_sql(1)


def stream_predict_while_training_sql() -> str:
    return f"""SELECT *, (SELECT count(*) FROM events WHERE event_id % 10 = 0) AS n_scored, 0::BIGINT AS n_wrong
FROM ({online_ridge_sql()})"""


def stream_metrics_sql() -> str:
    return f"""WITH {PTS},
p AS ({predict_prequential_sql().replace("round(list_inner_product(train.x, vers.w), 6)", "list_inner_product(train.x, vers.w)")}),
d AS (SELECT train.day, count(*) AS n, count(*) FILTER ((CASE WHEN p.prediction > 0 THEN 1.0 ELSE -1.0 END) <> train.y) AS n_err
      FROM train JOIN p USING (seq) GROUP BY train.day)
SELECT (row_number() OVER (ORDER BY day) - 1)::BIGINT AS version, (sum(n) OVER (ORDER BY day))::BIGINT AS n_seen, n_err
FROM d"""


def stream_sampled_sources_sql() -> str:
    T, dim = P.SGD_ITERATIONS, P.POINTS_DIM
    return f"""WITH RECURSIVE {PTS},
ranked AS (SELECT *, CASE WHEN hour(ts) < 12 THEN 0 ELSE 1 END AS source_rank FROM train),
days AS MATERIALIZED (SELECT day, source_rank, (dense_rank() OVER (ORDER BY day, source_rank) - 1) AS block
                      FROM (SELECT DISTINCT day, source_rank FROM ranked)),
src AS (SELECT days.block, t.t, ranked.x, ranked.y
        FROM ranked JOIN days USING (day, source_rank), generate_series(1, {T}) t(t)
        WHERE ((ranked.seq * {P.HASH_A} + t.t * {P.HASH_B}) % {P.HASH_M}) / {P.HASH_M} < {_f(P.SAMPLE_FRACTION)}),
g AS MATERIALIZED ({_gram_narrow(dim, 'src', 'block, t')}),
{_v2_fold("none", 0.0, sampled=True)}
{_weights_out(T, dim)}"""


def multi_stream_train_sql() -> str:
    return f"""WITH RECURSIVE {PTS},
src AS (SELECT *, CASE WHEN hour(ts) < 12 THEN 0 ELSE 1 END AS source_rank FROM train),
{_day_blocks("day, source_rank")},
{_v2_fold("none", 0.0)}
{_weights_out(P.SGD_ITERATIONS, P.POINTS_DIM)}"""


def predict_multi_stream_sql() -> str:
    T = P.SGD_ITERATIONS
    return f"""WITH RECURSIVE {PTS},
src AS (SELECT *, CASE WHEN hour(ts) < 12 THEN 0 ELSE 1 END AS source_rank FROM train),
{_day_blocks("day, source_rank")},
{_v2_fold("none", 0.0)},
vers AS (SELECT (s // {T} - 1)::BIGINT AS version, w FROM it WHERE s % {T} = 0),
last AS (SELECT day, max(block) AS block FROM g GROUP BY day)
SELECT train.seq, round(list_inner_product(train.x, vers.w), 6) AS prediction
FROM train JOIN last ON train.day = last.day JOIN vers ON vers.version = last.block"""


# ---- ratings ------------------------------------------------------------------

RATINGS = """r AS (
  SELECT o_custkey::INTEGER AS "user", l_partkey::INTEGER AS item,
         least(5.0::DOUBLE, 1.0::DOUBLE + floor((l_quantity - 1) / 10)) AS rating,
         date_trunc('month', o_orderdate)::DATE AS month,
         l_orderkey % 10 = 0 AS is_test, l_orderkey AS orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
train AS (SELECT * FROM r WHERE NOT is_test),
test AS (SELECT "user", item, rating FROM r WHERE is_test)"""

RATING_LINES = RATINGS + """,
rl AS (SELECT concat_ws('::', "user"::VARCHAR, item::VARCHAR, rating::INTEGER::VARCHAR) AS value FROM r)"""


def ratings_summary_sql() -> str:
    return f"""WITH {RATINGS}
SELECT CASE WHEN is_test THEN 'test' ELSE 'initial' END AS rating_set, count(*) AS n_ratings,
       count(DISTINCT "user") AS n_users, count(DISTINCT item) AS n_items
FROM r GROUP BY 1"""


def ratings_growth_sql() -> str:
    return f"""WITH {RATINGS}
SELECT month, n_new,
       (sum(n_new) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS n_total
FROM (SELECT month, count(*) AS n_new FROM train GROUP BY month)"""


def rmse_fixed_n_sql() -> str:
    return f"""WITH {RATINGS},
means AS (SELECT item, avg(rating) AS prediction FROM train GROUP BY item),
preds AS (SELECT t."user", t.item, m.prediction FROM test t JOIN means m ON t.item = m.item),
j AS (SELECT p.prediction AS p, t.rating AS r FROM preds p
      JOIN test t ON p."user" = t."user" AND p.item = t.item)
SELECT round(sqrt(coalesce(sum((p - r) * (p - r)), 0) / (SELECT count(*) FROM test)), 6) AS rmse_ref,
       round(sqrt(sum((p - r) * (p - r)) / count(*)), 6) AS rmse_scored,
       count(*) AS n_joined, (SELECT count(*) FROM test) AS n_test
FROM j"""


def cold_start_counts_sql() -> str:
    return f"""WITH {RATINGS}
SELECT count(*) AS n_test,
       sum(CASE WHEN u.uu IS NULL THEN 1 ELSE 0 END)::BIGINT AS cold_user,
       sum(CASE WHEN i.ii IS NULL THEN 1 ELSE 0 END)::BIGINT AS cold_item,
       sum(CASE WHEN u.uu IS NULL OR i.ii IS NULL THEN 1 ELSE 0 END)::BIGINT AS cold_either
FROM test t
LEFT JOIN (SELECT DISTINCT "user" AS uu FROM train) u ON t."user" = u.uu
LEFT JOIN (SELECT DISTINCT item AS ii FROM train) i ON t.item = i.ii"""


def als_counts_sql() -> str:
    return f"""WITH {RATINGS},
scored AS (SELECT t."user", t.item FROM test t
           WHERE t."user" IN (SELECT "user" FROM train) AND t.item IN (SELECT item FROM train))
SELECT (SELECT count(*) FROM test) AS n_test, (SELECT count(*) FROM scored) AS n_scored,
       (SELECT count(*) FROM scored s JOIN test t ON s."user" = t."user" AND s.item = t.item) AS n_joined"""


def als_retrain_counts_sql() -> str:
    return f"""WITH {RATINGS},
m AS (SELECT month, count(*) AS n_new FROM train GROUP BY month),
fu AS (SELECT "user", min(month) AS um FROM train GROUP BY 1), fi AS (SELECT item, min(month) AS im FROM train GROUP BY 1),
k AS (SELECT "user", item, count(*) AS k FROM test GROUP BY ALL),
warm AS (SELECT greatest(um, im) AS month, sum(k * k) AS n FROM k JOIN fu USING ("user") JOIN fi USING (item) GROUP BY 1)
SELECT (year(month) * 100 + month(month))::BIGINT AS interval, n_new,
       (sum(n_new) OVER (ORDER BY month))::BIGINT AS n_total,
       (SELECT coalesce(sum(n), 0) FROM warm WHERE warm.month <= m.month)::BIGINT AS n_joined
FROM m"""


def als_normal_equations_sql() -> str:
    return f"""WITH {RATINGS} SELECT count(DISTINCT "user") AS n_users, count(DISTINCT "user") AS n_solved FROM train"""


def ratings_growth_distinct_sql() -> str:
    return f"""WITH {RATINGS},
m AS (SELECT DISTINCT month FROM train),
c AS (SELECT m.month, (SELECT count(DISTINCT "user") FROM train t WHERE t.month <= m.month) AS total_users,
             (SELECT count(DISTINCT item) FROM train t WHERE t.month <= m.month) AS total_items FROM m)
SELECT month, total_users - coalesce(lag(total_users) OVER (ORDER BY month), 0) AS new_users,
       total_items - coalesce(lag(total_items) OVER (ORDER BY month), 0) AS new_items, total_users, total_items
FROM c"""


def history_union_sql() -> str:
    return f"""WITH {RATINGS},
bag AS (SELECT * FROM train UNION ALL SELECT * FROM train WHERE year(month) = {P.UNION_YEAR})
SELECT rating, count(*) AS n_ratings, count(DISTINCT ("user", item)) AS n_pairs FROM bag GROUP BY rating"""


# ---- text parsing -------------------------------------------------------------

POINT_LINES = """lines AS (
  SELECT event_id AS seq,
         CASE WHEN event_type = 'error'
                THEN concat_ws(',', lbl, (user_id % 10)::VARCHAR, value::VARCHAR, props)
              WHEN event_type = 'signup' THEN concat_ws(',', lbl, (user_id % 10)::VARCHAR)
              ELSE concat_ws(',', lbl, (user_id % 10)::VARCHAR, value::VARCHAR) END AS value
  FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN '1' ELSE '0' END AS lbl FROM events)),
f AS (SELECT seq, value, string_split(regexp_replace(value, ',+$', ''), ',') AS p FROM lines)"""


def points_parse_sql() -> str:
    return f"""WITH {POINT_LINES}
SELECT seq,
       (CASE WHEN trunc(TRY_CAST(p[1] AS DOUBLE))::BIGINT % 2 = 0 THEN -1.0 ELSE 1.0 END)::DOUBLE AS y,
       TRY_CAST(p[2] AS DOUBLE) AS x1, TRY_CAST(p[3] AS DOUBLE) AS x2, 1.0::DOUBLE AS x3
FROM f
WHERE value IS NOT NULL AND TRY_CAST(p[1] AS DOUBLE) IS NOT NULL AND len(p) - 1 = {P.TEXT_D}
  AND TRY_CAST(p[2] AS DOUBLE) IS NOT NULL AND TRY_CAST(p[3] AS DOUBLE) IS NOT NULL"""


def points_reject_counts_sql() -> str:
    d = P.TEXT_D
    return f"""WITH {POINT_LINES}
SELECT reason, count(*) AS n_lines FROM (
  SELECT CASE WHEN value IS NULL THEN 'bad_format'
              WHEN length(value) < {10 + d} THEN 'short_line'
              WHEN TRY_CAST(p[1] AS DOUBLE) IS NULL THEN 'bad_label'
              WHEN len(p) - 1 > {d + 1} THEN 'too_many_fields'
              WHEN len(list_filter(p[2:], lambda s: TRY_CAST(s AS DOUBLE) IS NULL)) > 0 THEN 'bad_feature'
              ELSE 'ok' END AS reason
  FROM f) GROUP BY reason"""


def lines_explode_trim_sql() -> str:
    return rf"""WITH {RATING_LINES},
sends AS (SELECT chr(0) || chr(0) || ' ' || value || chr(10) || substring(value, 1, 3)
                 || chr(0) || chr(0) AS value FROM rl),
x AS (SELECT unnest(string_split(value, chr(10))) AS raw FROM sends),
t AS (SELECT regexp_replace(raw, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS line FROM x),
sp AS (SELECT line, string_split(line, '::') AS p FROM t)
SELECT line FROM sp
WHERE length(line) >= 5 AND len(p) >= 3
  AND regexp_matches(p[1], '^[+-]?[0-9]+$') AND regexp_matches(p[2], '^[+-]?[0-9]+$')
  AND TRY_CAST(p[1] AS INTEGER) IS NOT NULL AND TRY_CAST(p[2] AS INTEGER) IS NOT NULL
  AND TRY_CAST(p[3] AS DOUBLE) IS NOT NULL"""


def ratings_parse_sql() -> str:
    return f"""WITH {RATING_LINES},
sp AS (SELECT string_split(value, '::') AS p FROM rl)
SELECT TRY_CAST(p[1] AS INTEGER) AS "user", TRY_CAST(p[2] AS INTEGER) AS item,
       TRY_CAST(p[3] AS DOUBLE) AS rating
FROM sp
WHERE len(p) >= 3 AND regexp_matches(p[1], '^[+-]?[0-9]+$') AND regexp_matches(p[2], '^[+-]?[0-9]+$')
  AND TRY_CAST(p[1] AS INTEGER) IS NOT NULL AND TRY_CAST(p[2] AS INTEGER) IS NOT NULL
  AND TRY_CAST(p[3] AS DOUBLE) IS NOT NULL"""


def points_arity_sql() -> str:
    d = P.TEXT_D
    x = ", ".join(f"CASE WHEN outcome = 'ok' THEN coalesce(TRY_CAST(p[{i + 2}] AS DOUBLE), 0.0) END AS x{i + 1}" for i in range(d))
    return f"""WITH e AS (
  SELECT event_id, event_id % 8 AS kind, CASE WHEN event_type = 'purchase' THEN '1' ELSE '0' END AS lbl,
         (user_id % 10)::VARCHAR AS a, value::VARCHAR AS b FROM events),
lines AS (
  SELECT event_id AS seq, CASE kind WHEN 1 THEN concat_ws(',', lbl, a) WHEN 2 THEN concat_ws(',', lbl, a, b, '7.5')
    WHEN 3 THEN concat_ws(',', lbl, a, b, '7.5', '8.5') WHEN 4 THEN concat_ws(',', 'none', a, b)
    WHEN 5 THEN concat_ws(',', lbl, 'n/a', b) WHEN 6 THEN lbl WHEN 7 THEN NULL ELSE concat_ws(',', lbl, a, b) END AS value FROM e),
f AS (SELECT seq, value, string_split(value, ',') AS p FROM lines),
o AS (
  SELECT *, CASE WHEN value IS NULL THEN 'bad_format' WHEN length(value) < {P.ARITY_LENGTH} THEN 'short_line'
    WHEN TRY_CAST(p[1] AS DOUBLE) IS NULL THEN 'bad_label' WHEN len(p) - 1 > {d + 1} THEN 'too_many_fields'
    WHEN len(list_filter(p[2:], lambda s: TRY_CAST(s AS DOUBLE) IS NULL)) > 0 THEN 'bad_feature' ELSE 'ok' END AS outcome FROM f)
SELECT seq, outcome,
  CASE WHEN outcome = 'ok' THEN CASE WHEN trunc(TRY_CAST(p[1] AS DOUBLE))::BIGINT % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END END AS y,
  {x}, CASE WHEN outcome = 'ok' THEN 1.0::DOUBLE END AS x{d + 1}
FROM o"""


def ratings_rejects_sql() -> str:
    return f"""WITH {RATINGS},
l AS (SELECT CASE orderkey % 7 WHEN 1 THEN concat_ws('::', "user", item) WHEN 2 THEN concat_ws('::', "user", 'item', rating)
    WHEN 3 THEN concat_ws('::', "user", item, 'five') WHEN 4 THEN substring(rating::VARCHAR, 1, 2)
    WHEN 5 THEN concat_ws('::', "user", item, rating, '978300760') ELSE concat_ws('::', "user", item, rating) END AS value FROM r),
o AS (SELECT value, string_split(value, '::') AS p FROM l),
q AS (SELECT p, CASE WHEN length(value) < 5 THEN 'fragment' WHEN len(p) < 3 THEN 'arity'
    WHEN TRY_CAST(p[1] AS INTEGER) IS NULL OR TRY_CAST(p[2] AS INTEGER) IS NULL OR TRY_CAST(p[3] AS DOUBLE) IS NULL THEN 'bad_field'
    ELSE 'ok' END AS outcome FROM o)
SELECT outcome, count(*) AS n_lines, sum(CASE WHEN outcome = 'ok' THEN p[3]::DOUBLE END) AS rating_sum FROM q GROUP BY outcome"""
