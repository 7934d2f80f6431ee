"""Queries over what is kept in storage (maps, product forms) and over patterns and their merging, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridols.jobs import fixtures as fx
from gridols.jobs.sql import EMB, EMB_ALL, FORMS2, LINES, MASKED
from gridols.operators import maps, mask, patterns, store
from gridols.operators.products import product_forms
from gridols.sources.folders import kept, shared_folder

X2, X3 = ["x0", "x1"], ["x0", "x1", "x2"]


def counts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.count_maps(product_forms(fx.supplier_lines(spark, sf_dir), X3), 3, F.col("n_rows"))


def map_upsert_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' counts as a stored map; the first fifth of the cells is replaced by their degrees of freedom, then the second by its numbers doubled."""
    counts = kept(counts_of(spark, sf_dir), "counts")
    path = shared_folder(spark, "maps")
    store.save_maps(maps.long_map(counts, "n", F.col("n")).unionByName(maps.long_map(counts, "edf", F.col("edf"))), path, width=16)
    parts = maps.blocks(counts, 5)
    store.upsert_stored(maps.long_map(counts.join(parts.where("block = 0"), "cell"), "n", F.col("edf")), path)
    again = store.read_maps(spark, path).where("map = 'n'").join(parts.where("block = 1").select("cell"), "cell")
    store.upsert_stored(again.withColumn("value", F.col("value") * 2), path)
    return store.read_maps(spark, path).select(F.col("map").cast("string").alias("map"), "vol", "cell", "value")


def rerun_replaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of a run, written where an earlier run with other maps was."""
    counts, path = counts_of(spark, sf_dir), shared_folder(spark, "maps")
    every = {name: maps.long_map(counts, name, F.col(name)) for name in ("n", "edf", "mask")}
    maps.write(every["n"].unionByName(every["mask"]), path)
    maps.write(every["n"].unionByName(every["edf"]).where("cell % 2 = 0"), path)
    return spark.read.parquet(path).groupBy(F.col("map").cast("string").alias("map")).agg(F.count("*").alias("n_cells"), F.sum("value").alias("total"))


def stored_forms(spark: SparkSession, sf_dir: str, buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """(product forms of the embeddings' five batches, cells with an even number of readings), as tables in the same buckets."""
    rows = fx.embeddings(spark, sf_dir).withColumn("batch", F.col("obs") % 5)
    name, base = f"gridols_{uuid.uuid4().hex}", shared_folder(spark, "forms")
    stored = store.save_forms(product_forms(rows, X2, ("batch", "cell")), f"{name}_forms", f"{base}/forms", buckets)
    even = stored.groupBy("cell").agg(F.sum("n").alias("n")).where("n % 2 = 0")
    return stored, store.save_keys(even, f"{name}_keys", f"{base}/keys", buckets)


def rounded(forms: DataFrame) -> DataFrame:
    return forms.select("cell", "n_rows", "n", *(F.round(F.col("xtx")[k], 4).alias(f"xtx{k}") for k in range(4)), *(F.round(F.col("xty")[k], 6).alias(f"xty{k}") for k in range(2)), F.round("yty", 6).alias("yty"))


def forms_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored batches' forms of some cells, looked up and added; the plan has no exchange."""
    return rounded(store.look_up(*stored_forms(spark, sf_dir), 2))


def forms_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a range of cells, whose row groups alone are read."""
    return rounded(store.look_up(stored_forms(spark, sf_dir)[0], (10, 29), 2))


def batch_merge_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns and X'X of five batches of observations, merged one after the other without their readings; looked up by cell."""
    rows, design = fx.masked_embeddings(spark, sf_dir), fx.embedding_design(spark, sf_dir)
    merged = None
    for k in range(5):
        batch = patterns.batch_forms(rows.where(F.pmod("obs", F.lit(5)) == k), design, X2)
        merged = batch if merged is None else patterns.merge(merged, batch)
    cells, known = merged
    return cells.join(known, "pattern_id").select("cell", "pattern_id", F.col("n").cast("long").alias("n"), *(F.round(F.col("xtx")[k], 4).alias(f"xtx{k}") for k in range(4)))


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked readings, those of every third observation twice."""
    rows = fx.masked_embeddings(spark, sf_dir)
    return rows.unionByName(rows.where("obs % 3 = 0"))


def pattern_ids_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.patterns(repeated(spark, sf_dir))


def pattern_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each missingness pattern against the next one; readings below zero are missing too, so that most cells differ."""
    rows = repeated(spark, sf_dir).withColumn("y", F.when(F.col("y") < 0, 0.0).otherwise(F.col("y")))
    known = kept(patterns.dictionary(kept(patterns.cell_bits(rows), "bits")), "patterns")
    return patterns.overlap(known, known.where("pattern_id > 1").select((F.col("pattern_id") - 1).alias("a"), F.col("pattern_id").alias("b")))


QUERIES = {f.__name__: f for f in (map_upsert_stored, rerun_replaces, forms_lookup, forms_range, batch_merge_products, pattern_ids_repeated, pattern_overlap)}

COUNTS = f"{LINES}, g AS (SELECT cell, count(*) FILTER (WHERE y <> 0) AS n FROM lines GROUP BY cell)"
FORMS = f"{EMB}, f AS ({FORMS2} FROM emb GROUP BY cell)"
ROUNDED = "SELECT cell, n_rows, n, round(CAST(n AS DOUBLE), 4) AS xtx0, round(sx, 4) AS xtx1, round(sx, 4) AS xtx2, round(sxx, 4) AS xtx3, round(sy, 6) AS xty0, round(sxy, 6) AS xty1, round(syy, 6) AS yty FROM f"
PATTERNS = "p AS (SELECT cell, list(DISTINCT obs ORDER BY obs) AS pattern FROM seen WHERE y <> 0 GROUP BY cell), m AS (SELECT *, min(cell) OVER (PARTITION BY pattern) AS first FROM p), d AS (SELECT *, dense_rank() OVER (ORDER BY first) AS pattern_id FROM m)"
SQL = {
    "map_upsert_stored": f"""WITH {COUNTS}, b AS (SELECT *, ntile(5) OVER (ORDER BY cell) AS block FROM g)
        SELECT 'n' AS map, 0 AS vol, cell, CAST(CASE block WHEN 1 THEN greatest(n - 3, 0) WHEN 2 THEN 2 * n ELSE n END AS DOUBLE) AS value FROM b
        UNION ALL SELECT 'edf', 0, cell, CAST(greatest(n - 3, 0) AS DOUBLE) FROM b""",
    "rerun_replaces": f"""WITH {COUNTS} SELECT 'n' AS map, count(*) AS n_cells, CAST(sum(n) AS DOUBLE) AS total FROM g WHERE cell % 2 = 0
        UNION ALL SELECT 'edf', count(*), CAST(sum(greatest(n - 3, 0)) AS DOUBLE) FROM g WHERE cell % 2 = 0""",
    "forms_lookup": f"WITH {FORMS} {ROUNDED} WHERE n % 2 = 0",
    "forms_range": f"WITH {FORMS} {ROUNDED} WHERE cell BETWEEN 10 AND 29",
    "batch_merge_products": f"""WITH {MASKED}, seen AS (SELECT * FROM masked), {PATTERNS}, f AS ({FORMS2} FROM masked GROUP BY cell)
        SELECT cell, pattern_id, n, round(CAST(n AS DOUBLE), 4) AS xtx0, round(sx, 4) AS xtx1, round(sx, 4) AS xtx2, round(sxx, 4) AS xtx3 FROM f JOIN d USING (cell)""",
    "pattern_ids_repeated": f"WITH {MASKED}, seen AS (SELECT * FROM masked UNION ALL SELECT * FROM masked WHERE obs % 3 = 0), {PATTERNS} SELECT cell, pattern_id, len(pattern) AS n FROM d",
    "pattern_overlap": f"""WITH seen AS (SELECT obs, cell, CASE WHEN (obs + cell) % 7 <> 0 AND y0 > 0 THEN y0 ELSE 0 END AS y FROM ({EMB_ALL})), {PATTERNS}, u AS (SELECT DISTINCT pattern_id, pattern FROM d),
        o AS (SELECT x.pattern_id AS a, y.pattern_id AS b, len(list_intersect(x.pattern, y.pattern)) AS common, len(x.pattern) AS na, len(y.pattern) AS nb FROM u x JOIN u y ON y.pattern_id = x.pattern_id + 1)
        SELECT a, b, common, na - common AS only_a, nb - common AS only_b, na + nb - 2 * common AS distance, common = na AS a_within_b FROM o""",
}
