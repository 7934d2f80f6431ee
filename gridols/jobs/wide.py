"""Fits of many regressors on row-level designs, with SQL by elimination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridols.functions.metrics import compare
from gridols.jobs import fixtures as fx
from gridols.operators import mask
from gridols.operators.clean import clean
from gridols.operators.fit import fit, ring_or_inner
from gridols.operators.sweep import swept, t_statistics
from gridols.operators.products import product_forms
from gridols.sources.observations import from_rows
from gridols.spec import Contrast, Model

#: SQL of the regressors behind the intercept; the first p - 1 make a design of width p.
COLUMNS = ("l_quantity", "l_discount", "l_tax", "CAST(l_returnflag = 'A' AS INT)", "CAST(l_returnflag = 'N' AS INT)", "CAST(l_linestatus = 'F' AS INT)", "l_linenumber")


def lines(spark: SparkSession, sf_dir: str, p: int) -> DataFrame:
    """(cell, y, x0, ...): the supplier's order lines, price on p columns; lines of no tax are missing for every other supplier."""
    y = F.expr("CASE WHEN l_tax = 0 AND l_suppkey % 2 = 0 THEN 0 ELSE l_extendedprice END")
    return clean(from_rows(fx.table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), y, [F.lit(1.0), *map(F.expr, COLUMNS[: p - 1])]))


def wide_fit(p: int):
    """The query of a width: by cell, part, the last coefficient, its T statistic and the residual variance, without a Python worker."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        last = Model(p, (Contrast.of("last", [0.0] * (p - 1) + [1.0]),))
        kept = mask.analysed(product_forms(lines(spark, sf_dir, p), [f"x{k}" for k in range(p)]), p, F.col("n_rows"), min_percent=0.5)
        out = t_statistics(swept(kept, p).where(f"rank = {p}"), last)
        return out.select("cell", ring_or_inner().alias("part"), "n", F.round(F.col("con")[0], 3).alias("con"), F.round(F.col("con_t")[0], 4).alias("con_t"), F.round(F.col("resms") / 1e6, 4).alias("resms"))

    query.__name__ = f"wide_fit_p{p}"
    return query


def sql_of(p: int) -> str:
    """Normal equations summed by cell, then elimination column by column."""
    xs = ["1.0", *(c.replace(" AS INT)", " AS DOUBLE)") for c in COLUMNS[: p - 1])]
    sums = [f"sum(CASE WHEN y <> 0 THEN CAST(x{i} AS DOUBLE) * x{j} ELSE 0 END) AS a{i}_{j}" for i in range(p) for j in range(i, p)]
    sums += [f"sum(x{i} * y) AS b{i}" for i in range(p)]
    steps = [
        "d AS (SELECT l_suppkey AS cell, CASE WHEN l_tax = 0 AND l_suppkey % 2 = 0 THEN 0 ELSE l_extendedprice END AS y, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(xs)) + " FROM lineitem)",
        f"s0 AS (SELECT cell, count(*) AS n_rows, count(*) FILTER (WHERE y <> 0) AS n, sum(y * y) AS rss, {', '.join(sums)} FROM d GROUP BY cell)",
    ]
    for k in range(p):
        rest = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(k + 1, p) for j in range(i, p)]
        rest += [f"b{i} - a{k}_{i} * b{k} / a{k}_{k} AS b{i}" for i in range(k + 1, p)]
        last = [f"b{k} / a{k}_{k} AS con", f"1 / a{k}_{k} AS spread"] if k == p - 1 else []
        steps.append(f"s{k + 1} AS (SELECT cell, n_rows, n, rss - b{k} * b{k} / a{k}_{k} AS rss, {', '.join(rest + last)} FROM s{k})")
    return f"""WITH {', '.join(steps)} SELECT cell, CASE WHEN n = n_rows THEN 'inner' ELSE 'ring' END AS part, n, round(con, 3) AS con,
        round(con / sqrt(spread * rss / (n - {p})), 4) AS con_t, round(rss / (n - {p}) / 1e6, 4) AS resms FROM s{p} WHERE n > {p + 1} AND n >= 0.5 * n_rows"""


def planted_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known coefficients put into the suppliers' design, p = 8: how far the fit is from them in all, ring and inner cells."""
    p = 8
    signal = sum((F.col(f"x{k}") * float(p - 1 - k) for k in range(1, p)), F.col("x0") * float(p - 1))
    rows = lines(spark, sf_dir, p).withColumn("y", F.when(F.col("y") != 0, signal).otherwise(0.0))
    forms = mask.analysed(product_forms(rows, [f"x{k}" for k in range(p)]), p, F.col("n_rows"), min_percent=0.5).withColumn("part", ring_or_inner())
    found = fit(forms, p).where(f"rank = {p}").join(forms.select("cell", "part"), "cell").select("cell", F.explode(F.array("part", F.lit("all"))).alias("part"), F.posexplode("beta").alias("vol", "value"))
    truth = found.select("cell", "part", "vol", (F.lit(float(p - 1)) - F.col("vol")).alias("value"))
    told = compare(found.withColumn("kind", F.col("part")), truth, ["cell", "part", "vol"], groups=["kind"])
    return told.select(F.col("kind").alias("part"), "n_compared", (F.col("mae") < 1e-6).alias("mae_ok"), (F.col("mrd") < 1e-6).alias("mrd_ok"))


QUERIES = {f"wide_fit_p{p}": wide_fit(p) for p in (4, 5, 8)} | {"planted_study": planted_study}
SQL = {f"wide_fit_p{p}": sql_of(p) for p in (4, 5, 8)} | {
    # the last coefficient is 0, so seven of eight are compared
    "planted_study": """WITH g AS (SELECT l_suppkey AS cell, count(*) AS n_rows, count(*) FILTER (WHERE NOT (l_tax = 0 AND l_suppkey % 2 = 0)) AS n FROM lineitem GROUP BY 1),
        k AS (SELECT *, CASE WHEN n = n_rows THEN 'inner' ELSE 'ring' END AS part FROM g WHERE n > 9 AND n >= 0.5 * n_rows)
        SELECT part, 7 * count(*) AS n_compared, true AS mae_ok, true AS mrd_ok FROM k GROUP BY part UNION ALL SELECT 'all', 7 * count(*), true, true FROM k""",
}
