"""Registered queries over the given tables, with their SQL counterparts.

Figures are rounded on both sides: engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridols.functions.metrics import compare
from gridols.jobs import fixtures as fx
from gridols.operators import contrasts, maps, mask, validate
from gridols.operators.clean import clean, outside, within
from gridols.operators.fit import closed_form, fit, full_rank, low_rank_removed, ring_or_inner
from gridols.operators.patterns import combine_patterns, forms_by_pattern, patterns
from gridols.operators.products import add_forms, product_forms
from gridols.sources.observations import from_arrays, from_rows
from gridols.spec import Contrast, Model

X2, X3, X4, X5 = ([f"x{k}" for k in range(p)] for p in (2, 3, 4, 5))
SLOPE = Model(2, (Contrast.of("label", [0, 1]),))
LINES = Model(3, (Contrast.of("both", [[0, 1, 0], [0, 0, 1]]), Contrast.of("quantity", [0, 1, 0])))


def r(column, digits=8):
    return F.round(column, digits)


def emb_forms(spark, sf_dir):
    return product_forms(fx.embeddings(spark, sf_dir), X2)


def emb_total(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").count()


def emb_inferred(spark, sf_dir):
    return contrasts.infer(full_rank(fit(mask.analysed(emb_forms(spark, sf_dir), 2, F.col("n_rows"), min_percent=0.5), 2), 2), SLOPE)


def line_inferred(spark, sf_dir):
    return contrasts.infer(fit(mask.analysed(product_forms(fx.supplier_lines(spark, sf_dir), X3), 3, F.col("n_rows")), 3), LINES)


def fit_shared_design(spark, sf_dir):
    a = F.col
    return emb_inferred(spark, sf_dir).select(
        "cell", "n", mask.edf(2).alias("edf"), r(a("beta")[0]).alias("beta0"), r(a("beta")[1]).alias("beta1"), r("resms").alias("resms"), r("llh", 4).alias("llh"),
        r(a("con_se")[0]).alias("con_se"), r(a("con_t")[0], 6).alias("con_t"), r(a("con_t_lp")[0], 5).alias("con_t_lp"),
    )


def obs_count_map(spark, sf_dir):
    return emb_forms(spark, sf_dir).select("cell", "n")


def edf_map(spark, sf_dir):
    return emb_forms(spark, sf_dir).select("cell", mask.edf(2).alias("edf"))


def data_threshold(spark, sf_dir):
    rows = clean(from_arrays(fx.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), threshold=fx.THRESHOLD)
    return rows.groupBy("cell").agg(F.count_if(F.col("y") == 0).alias("n_missing"), r(F.sum("y"), 6).alias("total"), r(F.min("y")).alias("least"))


def data_mask_multiply(spark, sf_dir):
    return fx.masked_embeddings(spark, sf_dir).groupBy("cell").agg(F.count_if(F.col("y") != 0).alias("n"), r(F.sum("y"), 6).alias("total"))


def nan_clean(spark, sf_dir):
    largest = 1.7976931348623157e308
    rows = fx.strange_values(spark, sf_dir)
    return rows.groupBy("cell").agg(F.count_if(F.col("y") == 0).alias("n_missing"), F.count_if(F.col("y") == largest).alias("n_high"), F.count_if(F.col("y") == -largest).alias("n_low"), r(F.sum(F.when(F.abs("y") < 1, F.col("y"))), 6).alias("total"))


def event_forms(spark, sf_dir):
    return product_forms(fx.user_events(spark, sf_dir), X3)


def missing_min_percent(spark, sf_dir):
    return mask.analysed(product_forms(fx.supplier_lines(spark, sf_dir), X3), 3, F.col("n_rows"), min_percent=0.885).select("cell", "n", "n_rows")


def missing_min_n(spark, sf_dir):
    return mask.analysed(event_forms(spark, sf_dir), 3, F.col("n_rows"), min_n=60).select("cell", "n")


def df_filter(spark, sf_dir):
    small = from_rows(fx.table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_totalprice"), [F.lit(1.0)] * 8)
    return mask.analysed(product_forms(small, [f"x{k}" for k in range(8)]), 8, F.col("n_rows")).select("cell", "n", mask.edf(8).alias("edf"))


def analysis_mask_semi(spark, sf_dir):
    return within(fx.user_events(spark, sf_dir), fx.active_users(spark, sf_dir)).groupBy("cell").agg(F.count_if(F.col("y") != 0).alias("n"), r(F.sum("y"), 4).alias("total"))


def analysis_mask_anti(spark, sf_dir):
    return outside(fx.user_events(spark, sf_dir), fx.active_users(spark, sf_dir)).groupBy("cell").agg(F.count("*").alias("n_rows"))


def final_mask(spark, sf_dir):
    return mask.count_maps(event_forms(spark, sf_dir), 3, F.col("n_rows"), min_percent=0.5, min_n=60, analysis_mask=fx.active_users(spark, sf_dir))


def xty(spark, sf_dir):
    return product_forms(fx.supplier_lines(spark, sf_dir), X3).select("cell", *(r(F.col("xty")[k] / 1e6, 3).alias(f"xty{k}") for k in range(3)))


def yty(spark, sf_dir):
    return product_forms(fx.supplier_lines(spark, sf_dir), X3).select("cell", r(F.col("yty") / 1e9, 3).alias("yty"))


def xtx_by_voxel(spark, sf_dir):
    return product_forms(fx.supplier_lines(spark, sf_dir), X3).select("cell", *(r(F.col("xtx")[k], 4).alias(f"xtx{k}") for k in range(9)))


def pattern_ids(spark, sf_dir):
    found = patterns(fx.masked_embeddings(spark, sf_dir))
    return found.select("cell", "pattern_id", F.col("n").cast("int").alias("n"))


def xtx_by_pattern(spark, sf_dir):
    forms = forms_by_pattern(fx.masked_embeddings(spark, sf_dir), fx.embedding_design(spark, sf_dir), X2)
    return forms.select("cell", "n", *(r(F.col("xtx")[k], 4).alias(f"xtx{k}") for k in range(4)), *(r(F.col("xty")[k], 6).alias(f"xty{k}") for k in range(2)))


def batch_merge_equivalence(spark, sf_dir):
    """Product forms of five batches of observations, added up."""
    parts = product_forms(fx.embeddings(spark, sf_dir).withColumn("batch", F.col("obs") % 5), X2, ("batch", "cell"))
    return add_forms(parts, 2).select("cell", "n_rows", "n", *(r(F.col("xtx")[k], 4).alias(f"xtx{k}") for k in range(4)), *(r(F.col("xty")[k], 6).alias(f"xty{k}") for k in range(2)), r("yty", 6).alias("yty"))


def batch_merge_patterns(spark, sf_dir):
    """The patterns of two batches of observations combined tell cells apart as those of all observations do."""
    rows = fx.masked_embeddings(spark, sf_dir)
    return combine_patterns(patterns(rows.where("obs % 2 = 0")), patterns(rows.where("obs % 2 = 1")))


def ring_inner_split(spark, sf_dir):
    return product_forms(fx.user_events(spark, sf_dir, threshold=1.0), X3).select("cell", "n", "n_rows", ring_or_inner().alias("part"))


def lowrank_removal(spark, sf_dir):
    """The second regressor is the order line's number where it is 1, so a cell without such lines has low rank."""
    rows = clean(from_rows(fx.table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.when(F.col("l_discount") < 0.05, 0.0).otherwise(F.col("l_quantity")), [F.lit(1.0), (F.col("l_linenumber") == 1).cast("int")]))
    forms = product_forms(rows, X2)
    counts = mask.count_maps(forms, 2, F.col("n_rows"))
    return low_rank_removed(counts, fit(forms, 2), 2)


def beta(spark, sf_dir):
    return emb_inferred(spark, sf_dir).select("cell", r(F.col("beta")[0]).alias("beta0"), r(F.col("beta")[1]).alias("beta1"))


def beta_closed_form(spark, sf_dir):
    """Column expressions alone."""
    fitted = closed_form(mask.analysed(product_forms(fx.supplier_lines(spark, sf_dir), X3), 3, F.col("n_rows")), 3)
    return fitted.select("cell", *(r(F.col("beta")[k], 3).alias(f"beta{k}") for k in range(3)), r(F.col("resms") / 1e6, 4).alias("resms"))


def resms(spark, sf_dir):
    return emb_inferred(spark, sf_dir).select("cell", r("resms").alias("resms"))


def sigma2_ml(spark, sf_dir):
    return emb_inferred(spark, sf_dir).select("cell", r("sigma2").alias("sigma2"))


def loglik(spark, sf_dir):
    return emb_inferred(spark, sf_dir).select("cell", r("llh", 4).alias("llh"))


def cov_beta(spark, sf_dir):
    return emb_inferred(spark, sf_dir).select("cell", F.explode(F.array(*(F.struct(F.lit(i * 2 + j).alias("vol"), r(contrasts.covariance(2, i, j) * 1e3).alias("cov")) for i in range(2) for j in range(2)))).alias("v")).select("cell", "v.vol", "v.cov")


def con(spark, sf_dir):
    return line_inferred(spark, sf_dir).select("cell", r(F.col("con")[0], 3).alias("con"))


def con_se(spark, sf_dir):
    return emb_inferred(spark, sf_dir).select("cell", r(F.col("con_se")[0]).alias("con_se"))


def con_t(spark, sf_dir):
    return emb_inferred(spark, sf_dir).select("cell", r(F.col("con_t")[0], 6).alias("con_t"))


def con_t_lp(spark, sf_dir):
    return emb_inferred(spark, sf_dir).select("cell", r(F.col("con_t_lp")[0], 5).alias("con_t_lp"))


def con_f(spark, sf_dir):
    return line_inferred(spark, sf_dir).select("cell", r(F.col("con_f")[0], 3).alias("con_f"))


def con_f_lp(spark, sf_dir):
    return line_inferred(spark, sf_dir).select("cell", r(F.col("con_f_lp")[0], 3).alias("con_f_lp"))


def con_r2(spark, sf_dir):
    return line_inferred(spark, sf_dir).select("cell", r(F.col("con_r2")[0], 6).alias("con_r2"))


def con_f_factor(spark, sf_dir):
    """F over a factor of five levels, p = 5, in the cells that have every level."""
    model = Model(5, (Contrast.of("segment", [[0, 1, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 1]]),))
    out = contrasts.infer(fit(mask.analysed(product_forms(fx.nation_customers(spark, sf_dir), X5), 5, F.col("n_rows")), 5), model)
    return out.where("rank = 5").select("cell", "n", r(F.col("con_f")[0], 5).alias("con_f"), r(F.col("con_r2")[0], 6).alias("con_r2"))


def voxel_blocks(spark, sf_dir):
    return maps.blocks(fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell")), 60)


def dense_map(spark, sf_dir):
    """The readings of every part number from 0 on, 0 where no model was fitted."""
    fitted = fit(mask.analysed(product_forms(fx.part_lines(spark, sf_dir), X4), 4, F.col("n_rows"), min_n=30), 4)
    cells = fx.table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    return maps.dense(spark, fitted.select("cell", F.when(F.col("rank") == 4, F.col("n").cast("double")).alias("value")), cells)


def map_union(spark, sf_dir):
    out = emb_inferred(spark, sf_dir)
    return maps.stacked_maps(out, {"resms": F.col("resms")}, {"beta": F.col("beta"), "conT": F.col("con_t")}).withColumn("value", r("value", 6))


def map_upsert(spark, sf_dir):
    """The count map with the cells of a first block of four replaced by their degrees of freedom."""
    counts = mask.count_maps(emb_forms(spark, sf_dir), 2, F.col("n_rows"))
    old = maps.long_map(counts, "n", F.col("n"))
    block = maps.blocks(counts, 4).where("block = 0").select("cell")
    return maps.upsert(old, maps.long_map(counts.join(block, "cell"), "n", F.col("edf")))


def compare_mae_mrd(spark, sf_dir):
    """The kernel's coefficients against the closed form's, in ring and inner cells."""
    forms = product_forms(fx.user_events(spark, sf_dir, threshold=1.0), X3).withColumn("part", ring_or_inner())
    a = fit(forms, 3).join(forms.select("cell", "part"), "cell").select("cell", "part", F.posexplode("beta").alias("vol", "value"))
    b = closed_form(forms, 3).select("cell", F.posexplode("beta").alias("vol", "value"))
    return compare(a, b, ["cell", "vol"], groups=["part"]).select("part", "n_compared", (F.col("mae") < 1e-6).alias("mae_ok"), (F.col("mrd") < 1e-6).alias("mrd_ok"))


def design_validate(spark, sf_dir):
    return validate.design_summary(fx.embedding_design(spark, sf_dir), X2)


QUERIES = {
    f.__name__: f
    for f in (
        fit_shared_design, obs_count_map, edf_map, data_threshold, data_mask_multiply, nan_clean, missing_min_percent, missing_min_n, df_filter, analysis_mask_semi, analysis_mask_anti, final_mask,
        xty, yty, xtx_by_voxel, pattern_ids, xtx_by_pattern, batch_merge_equivalence, batch_merge_patterns, ring_inner_split, lowrank_removal, beta, beta_closed_form, resms, sigma2_ml, loglik,
        cov_beta, con, con_se, con_t, con_t_lp, con_f, con_f_lp, con_r2, con_f_factor, voxel_blocks, dense_map, map_union, map_upsert, compare_mae_mrd, design_validate,
    )
}

from gridols.jobs import files, stored, studies, wide  # noqa: E402
from gridols.jobs.sql import SQL  # noqa: E402

QUERIES |= files.QUERIES | stored.QUERIES | studies.QUERIES | wide.QUERIES
SQL |= files.SQL | stored.SQL | studies.SQL | wide.SQL
