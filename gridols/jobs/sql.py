"""DuckDB SQL for the registered queries: least squares by closed forms, tails by power series."""

from __future__ import annotations

EMB_ALL = "SELECT vec_id AS obs, unnest(range(len(embedding))) AS cell, CAST(unnest(embedding) AS DOUBLE) AS y0, CAST(label AS DOUBLE) AS x1 FROM embeddings"
EMB = f"emb AS (SELECT obs, cell, x1, CASE WHEN y0 < -0.1 THEN 0 ELSE y0 END AS y FROM ({EMB_ALL}))"
MASKED = f"masked AS (SELECT obs, cell, x1, y0 * CASE WHEN (obs + cell) % 7 <> 0 THEN 1 ELSE 0 END AS y FROM ({EMB_ALL}))"
LINES = "lines AS (SELECT l_suppkey AS cell, CASE WHEN l_tax = 0 THEN 0 ELSE l_extendedprice END AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem)"


def events(threshold: float) -> str:
    return f"ev AS (SELECT user_id AS cell, CASE WHEN value < {threshold} THEN 0 ELSE value END AS y, CAST(hour(ts) AS DOUBLE) AS x1, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS x2 FROM events)"


ACTIVE = "active AS (SELECT user_id AS cell FROM events GROUP BY 1 HAVING max(CASE WHEN event_type = 'purchase' AND value > 100 THEN 1 ELSE 0 END) = 1)"

FORMS2 = "SELECT cell, count(*) AS n_rows, count(*) FILTER (WHERE y <> 0) AS n, sum(CASE WHEN y <> 0 THEN x1 ELSE 0 END) AS sx, sum(CASE WHEN y <> 0 THEN x1 * x1 ELSE 0 END) AS sxx, sum(y) AS sy, sum(x1 * y) AS sxy, sum(y * y) AS syy"

#: Fit of an intercept and a slope, cell by cell, with the slope's T statistic and -log10 of its upper tail.
FIT2 = f"""{EMB},
    f AS ({FORMS2} FROM emb GROUP BY cell),
    k AS (SELECT *, n * sxx - sx * sx AS det FROM f WHERE n >= 0.5 * n_rows AND n > 3),
    b AS (SELECT *, (sy * sxx - sx * sxy) / det AS b0, (n * sxy - sx * sy) / det AS b1 FROM k),
    e AS (SELECT *, syy - b0 * sy - b1 * sxy AS rss, n - 2 AS df FROM b),
    s AS (SELECT *, rss / df AS resms, rss / n AS sigma2, sxx / det AS i00, -sx / det AS i01, n / det AS i11 FROM e),
    t AS (SELECT *, sqrt(i11 * resms) AS se, b1 / sqrt(i11 * resms) AS t FROM s),
    x AS (SELECT *, df / (df + t * t) AS x, t * t / (df + t * t) AS w, df / 2.0 AS a FROM t),
    lead AS (SELECT *, exp(a * ln(x) + 0.5 * ln(CASE WHEN w > 0 THEN w ELSE 1e-300 END) - lgamma(a) - lgamma(0.5) + lgamma(a + 0.5)) AS front FROM x),
    tail AS (SELECT *, 0.5 * CASE WHEN x > 0.97
        THEN 1 - front / 0.5 * list_sum(list_transform(range(0, 400), lambda m: exp(lgamma(a + 0.5 + m) - lgamma(a + 0.5) - lgamma(1.5 + m) + lgamma(1.5) + m * ln(CASE WHEN w > 0 THEN w ELSE 1e-300 END))))
        ELSE front / a * list_sum(list_transform(range(0, 3000), lambda m: exp(lgamma(a + 0.5 + m) - lgamma(a + 0.5) - lgamma(a + 1 + m) + lgamma(a + 1) + m * ln(x)))) END AS half FROM lead),
    r AS (SELECT *, -0.5 * n * (ln(sigma2) + ln(2 * pi()) + 1) AS llh, -log10(CASE WHEN t >= 0 THEN half ELSE 1 - half END) AS lp FROM tail)"""

#: Fit of an intercept and two slopes through centred sums; F of both slopes.
FORMS3 = "SELECT cell, count(*) AS n_rows, count(*) FILTER (WHERE y <> 0) AS n, sum(CASE WHEN y <> 0 THEN x1 END) AS s1, sum(CASE WHEN y <> 0 THEN x2 END) AS s2, sum(CASE WHEN y <> 0 THEN x1 * x1 END) AS s11, sum(CASE WHEN y <> 0 THEN x1 * x2 END) AS s12, sum(CASE WHEN y <> 0 THEN x2 * x2 END) AS s22, sum(y) AS sy, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y, sum(y * y) AS syy"
FIT3 = f"""{LINES},
    f AS ({FORMS3} FROM lines GROUP BY cell),
    c AS (SELECT *, s11 - s1 * s1 / n AS c11, s12 - s1 * s2 / n AS c12, s22 - s2 * s2 / n AS c22, s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y, syy - sy * sy / n AS cyy FROM f WHERE n > 4),
    b AS (SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2 FROM c),
    r AS (SELECT *, (sy - b1 * s1 - b2 * s2) / n AS b0, b1 * c1y + b2 * c2y AS ssr, (cyy - b1 * c1y - b2 * c2y) / (n - 3) AS resms, n - 3 AS df FROM b),
    q AS (SELECT *, ssr / 2 / resms AS f, ssr / cyy AS r2 FROM r)"""

SQL = {
    "fit_shared_design": f"WITH {FIT2} SELECT cell, n, CAST(df AS BIGINT) AS edf, round(b0, 8) AS beta0, round(b1, 8) AS beta1, round(resms, 8) AS resms, round(llh, 4) AS llh, round(se, 8) AS con_se, round(t, 6) AS con_t, round(lp, 5) AS con_t_lp FROM r",
    "obs_count_map": f"WITH {EMB} SELECT cell, count(*) FILTER (WHERE y <> 0) AS n FROM emb GROUP BY cell",
    "edf_map": f"WITH {EMB} SELECT cell, greatest(count(*) FILTER (WHERE y <> 0) - 2, 0) AS edf FROM emb GROUP BY cell",
    "data_threshold": f"WITH {EMB} SELECT cell, count(*) FILTER (WHERE y = 0) AS n_missing, round(sum(y), 6) AS total, round(min(y), 8) AS least FROM emb GROUP BY cell",
    "data_mask_multiply": f"WITH {MASKED} SELECT cell, count(*) FILTER (WHERE y <> 0) AS n, round(sum(y), 6) AS total FROM masked GROUP BY cell",
    "nan_clean": "SELECT l_suppkey AS cell, count(*) FILTER (WHERE l_linenumber IN (1, 4) OR l_linenumber > 4 AND l_discount = 0) AS n_missing, count(*) FILTER (WHERE l_linenumber = 2) AS n_high, count(*) FILTER (WHERE l_linenumber = 3) AS n_low, round(sum(CASE WHEN l_linenumber > 4 THEN l_discount ELSE 0 END), 6) AS total FROM lineitem GROUP BY 1",
    "missing_min_percent": f"WITH {LINES} SELECT cell, count(*) FILTER (WHERE y <> 0) AS n, count(*) AS n_rows FROM lines GROUP BY cell HAVING count(*) FILTER (WHERE y <> 0) >= 0.885 * count(*) AND count(*) FILTER (WHERE y <> 0) > 4",
    "missing_min_n": f"WITH {events(5)} SELECT cell, count(*) FILTER (WHERE y <> 0) AS n FROM ev GROUP BY cell HAVING count(*) FILTER (WHERE y <> 0) >= 60",
    "df_filter": "SELECT o_custkey AS cell, count(*) FILTER (WHERE o_totalprice <> 0) AS n, count(*) FILTER (WHERE o_totalprice <> 0) - 8 AS edf FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_totalprice <> 0) > 9",
    "analysis_mask_semi": f"WITH {events(5)}, {ACTIVE} SELECT cell, count(*) FILTER (WHERE y <> 0) AS n, round(sum(y), 4) AS total FROM ev WHERE cell IN (SELECT cell FROM active) GROUP BY cell",
    "analysis_mask_anti": f"WITH {events(5)}, {ACTIVE} SELECT cell, count(*) AS n_rows FROM ev WHERE cell NOT IN (SELECT cell FROM active) GROUP BY cell",
    "final_mask": f"WITH {events(5)}, {ACTIVE}, g AS (SELECT cell, count(*) AS n_rows, count(*) FILTER (WHERE y <> 0) AS n FROM ev GROUP BY cell) SELECT cell, n, greatest(n - 3, 0) AS edf, CAST(n >= 0.5 * n_rows AND n >= 60 AND n > 4 AND cell IN (SELECT cell FROM active) AS INTEGER) AS mask FROM g",
    "xty": f"WITH {LINES} SELECT cell, round(sum(y) / 1e6, 3) AS xty0, round(sum(x1 * y) / 1e6, 3) AS xty1, round(sum(x2 * y) / 1e6, 3) AS xty2 FROM lines GROUP BY cell",
    "yty": f"WITH {LINES} SELECT cell, round(sum(y * y) / 1e9, 3) AS yty FROM lines GROUP BY cell",
    "xtx_by_voxel": f"WITH {LINES}, f AS ({FORMS3} FROM lines GROUP BY cell) SELECT cell, round(CAST(n AS DOUBLE), 4) AS xtx0, round(s1, 4) AS xtx1, round(s2, 4) AS xtx2, round(s1, 4) AS xtx3, round(s11, 4) AS xtx4, round(s12, 4) AS xtx5, round(s2, 4) AS xtx6, round(s12, 4) AS xtx7, round(s22, 4) AS xtx8 FROM f",
    "pattern_ids": f"WITH {MASKED}, p AS (SELECT cell, list(obs ORDER BY obs) AS pattern FROM masked WHERE y <> 0 GROUP BY cell), m AS (SELECT *, min(cell) OVER (PARTITION BY pattern) AS first FROM p) SELECT cell, dense_rank() OVER (ORDER BY first) AS pattern_id, CAST(len(pattern) AS INTEGER) AS n FROM m",
    "xtx_by_pattern": f"WITH {MASKED}, f AS ({FORMS2} FROM masked GROUP BY cell) SELECT cell, n, round(CAST(n AS DOUBLE), 4) AS xtx0, round(sx, 4) AS xtx1, round(sx, 4) AS xtx2, round(sxx, 4) AS xtx3, round(sy, 6) AS xty0, round(sxy, 6) AS xty1 FROM f",
    "batch_merge_equivalence": f"WITH {EMB}, f AS ({FORMS2} FROM emb GROUP BY cell) SELECT cell, n_rows, n, round(CAST(n AS DOUBLE), 4) AS xtx0, round(sx, 4) AS xtx1, round(sx, 4) AS xtx2, round(sxx, 4) AS xtx3, round(sy, 6) AS xty0, round(sxy, 6) AS xty1, round(syy, 6) AS yty FROM f",
    "batch_merge_patterns": f"WITH {MASKED}, p AS (SELECT cell, list(obs ORDER BY obs) AS pattern FROM masked WHERE y <> 0 GROUP BY cell), m AS (SELECT *, min(cell) OVER (PARTITION BY pattern) AS first FROM p) SELECT cell, dense_rank() OVER (ORDER BY first) AS pattern_id FROM m",
    "ring_inner_split": f"WITH {events(1)} SELECT cell, count(*) FILTER (WHERE y <> 0) AS n, count(*) AS n_rows, CASE WHEN count(*) FILTER (WHERE y <> 0) = count(*) THEN 'inner' ELSE 'ring' END AS part FROM ev GROUP BY cell",
    "lowrank_removal": "WITH d AS (SELECT l_partkey AS cell, CASE WHEN l_discount < 0.05 THEN 0 ELSE l_quantity END AS y, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS x FROM lineitem), g AS (SELECT cell, count(*) FILTER (WHERE y <> 0) AS n, coalesce(sum(x) FILTER (WHERE y <> 0), 0) AS s FROM d GROUP BY cell), k AS (SELECT *, s > 0 AND s < n AS ok FROM g) SELECT cell, CASE WHEN ok THEN n ELSE 0 END AS n, CASE WHEN ok THEN greatest(n - 2, 0) ELSE 0 END AS edf, CAST(ok AND n > 3 AS INTEGER) AS mask FROM k",
    "beta": f"WITH {FIT2} SELECT cell, round(b0, 8) AS beta0, round(b1, 8) AS beta1 FROM b",
    "beta_closed_form": f"WITH {FIT3} SELECT cell, round(b0, 3) AS beta0, round(b1, 3) AS beta1, round(b2, 3) AS beta2, round(resms / 1e6, 4) AS resms FROM r",
    "resms": f"WITH {FIT2} SELECT cell, round(resms, 8) AS resms FROM s",
    "sigma2_ml": f"WITH {FIT2} SELECT cell, round(sigma2, 8) AS sigma2 FROM s",
    "loglik": f"WITH {FIT2} SELECT cell, round(llh, 4) AS llh FROM r",
    "cov_beta": f"WITH {FIT2} SELECT cell, 0 AS vol, round(resms * i00 * 1e3, 8) AS cov FROM s UNION ALL SELECT cell, 1, round(resms * i01 * 1e3, 8) FROM s UNION ALL SELECT cell, 2, round(resms * i01 * 1e3, 8) FROM s UNION ALL SELECT cell, 3, round(resms * i11 * 1e3, 8) FROM s",
    "con": f"WITH {FIT3} SELECT cell, round(b1, 3) AS con FROM r",
    "con_se": f"WITH {FIT2} SELECT cell, round(se, 8) AS con_se FROM t",
    "con_t": f"WITH {FIT2} SELECT cell, round(t, 6) AS con_t FROM t",
    "con_t_lp": f"WITH {FIT2} SELECT cell, round(lp, 5) AS con_t_lp FROM r",
    "con_f": f"WITH {FIT3} SELECT cell, round(f, 3) AS con_f FROM q",
    "con_f_lp": f"WITH {FIT3} SELECT cell, round(-(df / 2.0) * log10(df / (df + 2 * f)), 3) AS con_f_lp FROM q",
    "con_r2": f"WITH {FIT3} SELECT cell, round(r2, 6) AS con_r2 FROM q",
    "con_f_factor": """WITH g AS (SELECT c_nationkey AS cell, c_mktsegment AS s, count(*) AS n, avg(c_acctbal) AS m, sum(c_acctbal * c_acctbal) - count(*) * avg(c_acctbal) * avg(c_acctbal) AS within FROM customer WHERE c_acctbal <> 0 GROUP BY 1, 2),
        t AS (SELECT cell, count(*) AS levels, sum(n) AS n, sum(within) AS ssw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb FROM g GROUP BY cell)
        SELECT CAST(cell AS BIGINT) AS cell, CAST(n AS BIGINT) AS n, round((ssb / 4) / (ssw / (n - 5)), 5) AS con_f, round(ssb / (ssb + ssw), 6) AS con_r2 FROM t WHERE n > 6 AND levels = 5""",
    "voxel_blocks": "SELECT p_partkey AS cell, CAST(ntile(60) OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS block FROM part",
    "dense_map": "WITH f AS (SELECT l_partkey AS cell, count(*) FILTER (WHERE l_extendedprice <> 0) AS n FROM lineitem GROUP BY 1), g AS (SELECT unnest(range((SELECT max(p_partkey) + 1 FROM part))) AS cell) SELECT g.cell, CASE WHEN f.n >= 30 THEN CAST(f.n AS DOUBLE) ELSE 0.0 END AS value FROM g LEFT JOIN f ON g.cell = f.cell",
    "map_union": f"WITH {FIT2} SELECT 'beta' AS map, 0 AS vol, cell, round(b0, 6) AS value FROM t UNION ALL SELECT 'beta', 1, cell, round(b1, 6) FROM t UNION ALL SELECT 'resms', 0, cell, round(resms, 6) FROM t UNION ALL SELECT 'conT', 0, cell, round(t, 6) FROM t",
    "map_upsert": f"WITH {EMB}, g AS (SELECT cell, count(*) FILTER (WHERE y <> 0) AS n FROM emb GROUP BY cell), b AS (SELECT *, ntile(4) OVER (ORDER BY cell) AS block FROM g) SELECT 'n' AS map, 0 AS vol, cell, CAST(CASE WHEN block = 1 THEN greatest(n - 2, 0) ELSE n END AS DOUBLE) AS value FROM b",
    "compare_mae_mrd": f"WITH {events(1)}, g AS (SELECT cell, count(*) FILTER (WHERE y <> 0) = count(*) AS whole FROM ev GROUP BY cell) SELECT CASE WHEN whole THEN 'inner' ELSE 'ring' END AS part, 3 * count(*) AS n_compared, true AS mae_ok, true AS mrd_ok FROM g GROUP BY whole",
    "design_validate": "SELECT 'x0' AS \"column\", count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad, CAST(1 AS BIGINT) AS n_distinct, 1.0::DOUBLE AS least, 1.0::DOUBLE AS largest FROM embeddings UNION ALL SELECT 'x1', count(*), count(*) FILTER (WHERE label IS NULL), count(DISTINCT label), CAST(min(label) AS DOUBLE), CAST(max(label) AS DOUBLE) FROM embeddings",
}
