"""Queries on how studies are simulated, smoothed, masked, laid out for other programs and checked, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridols.jobs import fixtures as fx
from gridols.jobs.sql import EMB_ALL
from gridols.operators import validate
from gridols.operators.clean import attach_design, clean
from gridols.operators.fit import fit, inverses
from gridols.operators.products import product_forms
from gridols.operators.sweep import swept
from gridols.operators.wide import pivot_block
from gridols.sources import simulate
from gridols.sources.observations import from_arrays, from_rows

SHAPE = (4, 4, 4)
FWHM, REACH = 2.5, 2
#: Scales put on two regressors, ten to the eighth apart from the first.
LARGE, SMALL = 1e8, 1e-8


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as volumes of 4 by 4 by 4 cells."""
    rows = from_arrays(fx.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rows.select("obs", "cell", F.col("y").cast("double").alias("y"))


def smoothed_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.smooth(volumes(spark, sf_dir), SHAPE, FWHM, REACH).select("obs", "cell", F.round("y", 9).alias("y"))


def irregular_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By volume the mask that an ellipsoid with the vector as noise leaves, smoothed and cut: how many cells, and which."""
    base = simulate.ellipsoid(spark, SHAPE)
    rough = volumes(spark, sf_dir).join(F.broadcast(base), "cell").select("obs", "cell", (F.col("mask") + 8 * F.col("y")).alias("y"))  # 64 cells
    masks = simulate.cut_smooth(rough, SHAPE, FWHM, REACH)
    return masks.groupBy("obs").agg(F.sum("mask").alias("inside"), F.sum(F.col("mask") * F.col("cell") * F.col("cell")).alias("squares"))


def smoothed_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed vectors inside their irregular masks, fitted on the label."""
    smooth = simulate.smooth(volumes(spark, sf_dir), SHAPE, FWHM, REACH)
    base = simulate.ellipsoid(spark, SHAPE)
    rough = volumes(spark, sf_dir).join(F.broadcast(base), "cell").select("obs", "cell", (F.col("mask") + 8 * F.col("y")).alias("y"))
    masks = simulate.cut_smooth(rough, SHAPE, FWHM, REACH)
    rows = attach_design(clean(smooth.join(masks, ["obs", "cell"]), mask="mask"), fx.embedding_design(spark, sf_dir))
    fitted = swept(product_forms(rows, ["x0", "x1"]).where("n > 3"), 2).where("rank = 2")
    return fitted.select("cell", "n", F.round(F.col("beta")[0], 8).alias("beta0"), F.round(F.col("beta")[1], 8).alias("beta1"), F.round("resms", 8).alias("resms"))


def planted_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings simulated on the embeddings' design, three regressors, twenty cells: counts and sums."""
    design = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs"), F.lit(1.0).alias("x0"), F.col("label").cast("double").alias("x1"), (F.col("vec_id") % 11).cast("double").alias("x2"))
    rows = simulate.planted(design, 3, 20, seed=5)
    return rows.groupBy("cell").agg(F.count_if(F.col("y") != 0).alias("n"), F.round(F.sum("y"), 4).alias("total"), F.round(F.sum(F.col("y") * F.col("obs")) / 1e3, 4).alias("weighted"))


def observations_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by line numbers, the block of the first four; the price is missing where there is no tax, and the fourth line in too many orders."""
    y = F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_extendedprice"))
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("obs"), F.col("l_linenumber").cast("long").alias("cell"), y.alias("y"))
    wide = pivot_block(rows, [1, 2, 3, 4], min_percent=0.55)
    return wide.select("obs", *(F.round(f"c{c}", 4).alias(f"c{c}") for c in (1, 2, 3, 4)))


def scaled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' lines with regressors 1e8 times as large and as small."""
    y = F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_extendedprice"))
    return clean(from_rows(fx.table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), y, [F.lit(1.0), F.col("l_quantity") * LARGE, F.col("l_discount") * SMALL]))


def scaled_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse and log-determinant of X'X whose columns differ by 1e16 in scale, from the stacked kernel, and the log-determinant of the sweep."""
    forms = product_forms(scaled_lines(spark, sf_dir), ["x0", "x1", "x2"])
    told = inverses(forms, 3).where("inverse IS NOT NULL").select("cell", "inverse", "log_det")
    other = swept(forms, 3).select("cell", F.col("log_det").alias("swept"))
    size = {(0, 0): 1.0, (0, 1): LARGE, (1, 1): LARGE * LARGE, (2, 2): SMALL * SMALL, (0, 2): SMALL, (1, 2): 1.0}
    return told.join(other, "cell").select("cell", *(F.round(F.col("inverse")[3 * i + j] * s * 1e3, 6).alias(f"inv{i}{j}") for (i, j), s in size.items()), F.round("log_det", 6).alias("log_det"), F.round("swept", 6).alias("swept"))


def scaled_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of those lines: a scale is no reason to take a design for one of low rank."""
    fitted = fit(product_forms(scaled_lines(spark, sf_dir), ["x0", "x1", "x2"]).where("n > 4"), 3)
    return fitted.select("cell", "rank", F.round(F.col("beta")[1] * LARGE, 4).alias("beta1"), F.round(F.col("beta")[2] * SMALL, 3).alias("beta2"), F.round(F.col("resms") / 1e6, 4).alias("resms"))


def rank_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a part's cell: a design of low rank is refused where every reading is there, and dropped where some are missing."""
    y = F.when(F.col("l_discount") < 0.02, 0.0).otherwise(F.col("l_quantity"))
    rows = clean(from_rows(fx.table(spark, sf_dir, "lineitem"), F.col("l_partkey"), y, [F.lit(1.0), (F.col("l_linenumber") == 1).cast("int")]))
    told = swept(product_forms(rows, ["x0", "x1"]).where("n > 0"), 2)
    rule = F.when(F.col("rank") == 2, "kept").when(F.col("n") == F.col("n_rows"), "refused").otherwise("dropped")
    return told.select("cell", "n", "n_rows", rule.alias("rule"))


def study_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies by the size of parts: their parts are the responses, dear ones have a row of the design, and so on; which checks refuse each."""
    dear, odd = F.col("p_retailprice") > 902, F.col("p_partkey") % 2 == 1
    told = fx.table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("study")).agg(
        F.count("*").alias("responses"), F.count_if(dear).alias("design_rows"), F.count_if(odd & (F.col("p_size") % 3 > 0)).alias("masks"), (F.avg("p_retailprice") / 953).alias("min_percent"), F.count_if(odd).alias("k"),
    )
    row = lambda *v: F.array(*(x.cast("double") for x in v))
    one = row(F.lit(1), F.col("responses"), F.lit(0))
    contrast = F.when(F.col("study") % 4 == 0, F.array(one, row(F.lit(2), F.col("responses") * 2, F.lit(0)))).when(F.col("study") % 4 == 1, F.array(row(F.lit(0), F.col("k")))).otherwise(F.array(one, row(F.lit(0), F.lit(0), F.col("k"))))
    return validate.study_faults(told.select("study", "responses", "design_rows", "masks", F.lit(3).alias("width"), "min_percent", contrast.alias("contrast"))).select("study", F.array_join("faults", ",").alias("faults"))


QUERIES = {f.__name__: f for f in (smoothed_volumes, irregular_masks, smoothed_study, planted_readings, observations_by_cells, scaled_inverse, scaled_fit, rank_rule, study_faults)}

WEIGHTS = ", ".join(map(repr, simulate.kernel(FWHM, REACH)))
PLACES = f"vox AS (SELECT obs, cell, x1, y0, cell // 16 AS i, cell // 4 % 4 AS j, cell % 4 AS k FROM ({EMB_ALL}))"


def smooth_sql(source: str, value: str, name: str) -> str:
    """One separable step for all three axes: each cell's neighbours with the product of their weights."""
    near = " AND ".join(f"abs(a.{x} - b.{x}) <= {REACH}" for x in "ijk")
    weight = " * ".join(f"[{WEIGHTS}][b.{x} - a.{x} + {REACH + 1}]" for x in "ijk")
    return f"{name} AS (SELECT a.obs, a.cell, any_value(a.x1) AS x1, sum(b.{value} * {weight}) AS y FROM {source} a JOIN {source} b ON a.obs = b.obs AND {near} GROUP BY a.obs, a.cell)"


ROUGH = f"rough AS (SELECT *, CASE WHEN ((2 * (i + 0.5) / 4 - 1)**2 + (2 * (j + 0.5) / 4 - 1)**2 + (2 * (k + 0.5) / 4 - 1)**2) <= 1 THEN 1 ELSE 0 END + 8 * y0 AS r FROM vox), {smooth_sql('rough', 'r', 'noisy')}, cut AS (SELECT obs, cell, CASE WHEN y > 0.6 THEN 1 ELSE 0 END AS mask FROM noisy)"
UNIFORM = "(CAST('0x' || substr(md5({seed} || ':' || obs || ':' || cell), 1, 10) AS BIGINT) + 0.5) / 1099511627776.0"
SCALED = """l AS (SELECT l_suppkey AS cell, CASE WHEN l_tax = 0 THEN 0 ELSE l_extendedprice END AS y, l_quantity AS a, l_discount AS b FROM lineitem),
    s AS (SELECT cell, count(*) FILTER (WHERE y <> 0) AS n, sum(a) FILTER (WHERE y <> 0) AS sa, sum(b) FILTER (WHERE y <> 0) AS sb, sum(a * a) FILTER (WHERE y <> 0) AS saa, sum(a * b) FILTER (WHERE y <> 0) AS sab, sum(b * b) FILTER (WHERE y <> 0) AS sbb,
                 sum(y) AS sy, sum(a * y) AS say, sum(b * y) AS sby, sum(y * y) AS syy FROM l GROUP BY cell),
    c AS (SELECT *, saa * sbb - sab * sab AS c00, sab * sb - sa * sbb AS c01, sa * sab - saa * sb AS c02, n * sbb - sb * sb AS c11, sa * sb - n * sab AS c12, n * saa - sa * sa AS c22 FROM s),
    d AS (SELECT *, n * c00 + sa * c01 + sb * c02 AS det FROM c)"""
SQL = {
    "smoothed_volumes": f"WITH {PLACES}, {smooth_sql('vox', 'y0', 'smooth')} SELECT obs, cell, round(y, 9) AS y FROM smooth",
    "irregular_masks": f"WITH {PLACES}, {ROUGH} SELECT obs, CAST(sum(mask) AS BIGINT) AS inside, CAST(sum(mask * cell * cell) AS BIGINT) AS squares FROM cut GROUP BY obs",
    "smoothed_study": f"""WITH {PLACES}, {ROUGH}, {smooth_sql('vox', 'y0', 'smooth')}, r AS (SELECT cell, x1, y * mask AS y FROM smooth JOIN cut USING (obs, cell)),
        f AS (SELECT cell, count(*) FILTER (WHERE y <> 0) AS n, sum(CASE WHEN y <> 0 THEN x1 ELSE 0 END) AS sx, sum(CASE WHEN y <> 0 THEN x1 * x1 ELSE 0 END) AS sxx, sum(y) AS sy, sum(x1 * y) AS sxy, sum(y * y) AS syy FROM r GROUP BY cell),
        b AS (SELECT *, n * sxx - sx * sx AS det FROM f WHERE n > 3), e AS (SELECT *, (sy * sxx - sx * sxy) / det AS b0, (n * sxy - sx * sy) / det AS b1 FROM b WHERE det > 1e-9)
        SELECT cell, n, round(b0, 8) AS beta0, round(b1, 8) AS beta1, round((syy - b0 * sy - b1 * sxy) / (n - 2), 8) AS resms FROM e""",
    "planted_readings": f"""WITH g AS (SELECT vec_id AS obs, unnest(range(20)) AS cell, 2.0 + label AS signal FROM embeddings),
        y AS (SELECT obs, cell, CASE WHEN {UNIFORM.format(seed=12)} < 0.1 THEN 0 ELSE signal + 10 * sqrt(-2 * ln({UNIFORM.format(seed=8)})) * cos(2 * pi() * {UNIFORM.format(seed=9)}) END AS y FROM g)
        SELECT cell, count(*) FILTER (WHERE y <> 0) AS n, round(sum(y), 4) AS total, round(sum(y * obs) / 1e3, 4) AS weighted FROM y GROUP BY cell""",
    "observations_by_cells": """WITH r AS (SELECT l_orderkey AS obs, l_linenumber AS cell, CASE WHEN l_tax = 0 THEN 0 ELSE l_extendedprice END AS y FROM lineitem),
        k AS (SELECT cell FROM r WHERE y <> 0 GROUP BY cell HAVING count(DISTINCT obs) >= 0.55 * (SELECT count(DISTINCT obs) FROM r)),
        m AS (SELECT obs, cell, CASE WHEN cell IN (SELECT cell FROM k) THEN y ELSE 0 END AS y FROM r),
        p AS (PIVOT m ON cell IN (1, 2, 3, 4) USING sum(y) GROUP BY obs)
        SELECT obs, round(coalesce("1", 0), 4) AS c1, round(coalesce("2", 0), 4) AS c2, round(coalesce("3", 0), 4) AS c3, round(coalesce("4", 0), 4) AS c4 FROM p""",
    "scaled_inverse": f"""WITH {SCALED} SELECT cell, round(c00 / det * 1e3, 6) AS inv00, round(c01 / det * 1e3, 6) AS inv01, round(c11 / det * 1e3, 6) AS inv11, round(c22 / det * 1e3, 6) AS inv22, round(c02 / det * 1e3, 6) AS inv02, round(c12 / det * 1e3, 6) AS inv12,
        round(ln(det), 6) AS log_det, round(ln(det), 6) AS swept FROM d WHERE n > 2""",
    "scaled_fit": f"""WITH {SCALED}, e AS (SELECT *, (c00 * sy + c01 * say + c02 * sby) / det AS b0, (c01 * sy + c11 * say + c12 * sby) / det AS b1, (c02 * sy + c12 * say + c22 * sby) / det AS b2 FROM d WHERE n > 4)
        SELECT cell, 3 AS rank, round(b1, 4) AS beta1, round(b2, 3) AS beta2, round((syy - b0 * sy - b1 * say - b2 * sby) / (n - 3) / 1e6, 4) AS resms FROM e""",
    "rank_rule": """WITH r AS (SELECT l_partkey AS cell, CASE WHEN l_discount < 0.02 THEN 0 ELSE l_quantity END AS y, CAST(l_linenumber = 1 AS INT) AS x FROM lineitem),
        g AS (SELECT cell, count(*) FILTER (WHERE y <> 0) AS n, count(*) AS n_rows, count(DISTINCT x) FILTER (WHERE y <> 0) AS levels FROM r GROUP BY cell)
        SELECT cell, n, n_rows, CASE WHEN levels = 2 THEN 'kept' WHEN n = n_rows THEN 'refused' ELSE 'dropped' END AS rule FROM g WHERE n > 0""",
    "study_faults": """WITH s AS (SELECT CAST(p_size AS BIGINT) AS study, count(*) AS responses, count(*) FILTER (WHERE p_retailprice > 902) AS design_rows, count(*) FILTER (WHERE p_partkey % 2 = 1 AND p_size % 3 > 0) AS masks,
                                    avg(p_retailprice) / 953 AS share, count(*) FILTER (WHERE p_partkey % 2 = 1) AS k FROM part GROUP BY p_size)
        SELECT study, array_to_string(list_filter([CASE WHEN study % 4 = 0 OR k = 0 THEN 'contrast_rank' END, CASE WHEN study % 4 = 1 THEN 'contrast_width' END, CASE WHEN responses <> design_rows THEN 'design_rows' END,
                                                   CASE WHEN masks NOT IN (0, responses) THEN 'mask_count' END, CASE WHEN share > 1 THEN 'min_percent' END], lambda f: f IS NOT NULL), ',') AS faults FROM s""",
}
