"""Cross-site boilerplate lines, by the number of distinct sites (sources) that a line is on.

A line is what stands between line feeds, without spaces, tabs and carriage returns at its ends; blank lines are never
boilerplate. HyperLogLog sketches of sites, one a line hash, merge by aggregation. Lines whose estimate is near the
threshold get an exact distinct count. Lines on at least ``min_sites`` sites are taken out of every document, whatever
their share of it; a document of such lines alone keeps only its blank lines. With ``spare_copies`` two kinds of document
are left whole: those whose whole text is that of several documents, and those of which only blank lines would stay. They
are copies of a document, not documents that carry boilerplate; the pipeline leaves them to near-duplicate removal, which
would otherwise find them empty. DataFrame functions only.

Nulls and the like: a null text stays null and has no lines; an empty one has one blank line; a null source is no site; a
null doc_id is an ordinary row; repeated rows are each cleaned alike, and as copies of each other if copies are spared; a
line on exactly ``min_sites`` sites is boilerplate; long texts are cut in time that grows with their length; columns of any
name stay, but for ``lines_in`` and ``lines_cut``, which the counts replace where they are asked for; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridols.llm.common import materialize

EDGE = " \t\r"


def split_lines(text):
    return F.split(text, "\n", -1)


def line_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, source, pos, line, n): one row for each line that is not blank; line and n identify it."""
    trimmed = F.btrim("raw", F.lit(EDGE))
    return (
        documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("source"), "text")  # one hash a text, not one a line
        .select("doc_id", "text_hash", "source", F.posexplode(split_lines(F.col("text"))).alias("pos", "raw"))
        .select("doc_id", "text_hash", "source", "pos", F.xxhash64(trimmed).alias("line"), F.octet_length(trimmed).alias("n"))
        .where("n > 0")
    )


def boilerplate(rows: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """(line, n) of the lines on at least ``min_sites`` distinct sites."""
    margin = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)  # four standard errors of the sketch, or one site
    spread = rows.groupBy("line", "n").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", lg_k)).alias("sites"))
    likely = materialize(spread.where(F.col("sites") >= F.lit(min_sites - margin)), "likely-lines")
    near = likely.where(F.col("sites") <= F.lit(min_sites + margin)).select("line", "n")
    pairs = rows.where("source IS NOT NULL").groupBy("line", "n", "source").agg(F.lit(1).alias("one"))  # summed before the join, so a line on all documents is a few rows
    exact = pairs.join(near, ["line", "n"], "left_semi").groupBy("line", "n").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("line", "n")
    return materialize(likely.where(F.col("sites") > F.lit(min_sites + margin)).select("line", "n").unionByName(exact), "boilerplate")


def as_column(rows: DataFrame, name: str, value) -> DataFrame:
    """The rows with a column that is computed once a row: a generator's output is not put into the expressions that use it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def remove_boilerplate(documents: DataFrame, min_sites: int = 10, spare_copies: bool = False, counts: bool = True) -> DataFrame:
    """The documents with boilerplate lines taken out of ``text``, and the counts lines_in and lines_cut.

    All other columns stay, but for one that has the name of a count where counts are asked for.
    """
    rows = line_rows(documents)
    cut = rows.join(boilerplate(rows, min_sites), ["line", "n"], "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("at"))
    if spare_copies:  # copies have the same lines, so all of them are here, and are counted before the shuffle
        one = cut.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("at").alias("at"))
        cut = one.where("copies = 1")
    cut = cut.select(F.col("doc_id").alias("cut_doc"), F.col("text_hash").alias("cut_hash"), "at")
    place = {c: f"given_{i}" for i, c in enumerate(documents.columns)}  # names that clash with none of the below
    doc, given = F.col(place["doc_id"]), F.col(place["text"])
    whole = documents.select(*(F.col(f"`{c}`").alias(p) for c, p in place.items())).withColumn("hash", F.xxhash64(given))
    joined = whole.join(cut, doc.eqNullSafe(F.col("cut_doc")) & (F.col("hash") == F.col("cut_hash")), "left")
    joined = as_column(joined, "lines", split_lines(given))
    stay = F.when(F.col("at").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "at"))  # by hashes, in order
    joined = as_column(joined, "stay", stay)
    joined = as_column(joined, "cleaned", F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
    few = F.col("at").isNotNull() & (F.btrim("cleaned", F.lit(EDGE + "\n")) != "") if spare_copies else F.col("at").isNotNull()
    text = F.when(few, F.col("cleaned")).otherwise(given)
    told = {"lines_in": F.coalesce(F.size("lines"), F.lit(0)), "lines_cut": F.when(few, F.size("at")).otherwise(F.lit(0))} if counts else {}
    kept = [(text if c == "text" else F.col(p)).alias(c) for c, p in place.items() if c not in told]
    return joined.select(*kept, *(v.alias(k) for k, v in told.items()))
