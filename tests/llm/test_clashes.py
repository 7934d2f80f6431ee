"""Every operator and stage beside columns that are named after what the operators call their own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridols.llm import decontam, jaccard, langid, lines, negatives, phrases, pieces, sharding, simhash, suffixes, topk, toxicity
from gridols.llm.registry import vocabulary

SF = "/root/testdata/sf0.001"
NAMES = """gone gone_ key own alias at cut_doc cut_hash hash lines stay cleaned lines_in lines_cut given_0 given_1 line pos raw n fp rep bands bucket t k part parts other lo hi component
component_id fingerprint node a b u v x y m size text_crc32 law shard slot grown_shard block base within class number places spans kept n_bytes toxic score predicted held_out weight h r salt
stem w features lang_pred bits_per_byte gram item_id cosine common term ids alternatives ids_crc32 decoded_crc32 start n_tokens blob label one c near asks vec_id rank query_id pack d source_ text_ GONE_X
grp blocks starts high low q_n q_ids r told key_alias alias of_a salts kind lo hi last h w j owner first gone search label q_label bits along rest size conv_id turn role fresh letters totals""".split()
NAMES = list(dict.fromkeys(NAMES))


@pytest.fixture(scope="module")
def crowded(documents):
    few = documents.limit(60)
    return few.select("*", *(F.lit(k).cast("string").alias(c) for k, c in enumerate(NAMES))).cache()


@pytest.fixture(scope="module")
def plain(crowded):
    return crowded.select("doc_id", "text", "lang", "source", "n_chars").cache()


def rows(df, *columns):
    return sorted(repr(tuple(r)) for r in (df.select(*columns) if columns else df).collect())


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, crowded, plain, k):
    stage = corpus_pipeline.STAGES[k][1]
    got, want = stage(spark, crowded, SF), stage(spark, plain, SF)
    if k < 4:
        assert got.columns == crowded.columns
        assert rows(got, "doc_id", "text", *NAMES[:3]) == rows(want.select("doc_id", "text", *(F.lit(i).cast("string") for i in range(3))))
    else:
        assert rows(got) == rows(want)


def test_operators(spark, crowded, plain):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    more = labels.select("*", *(F.lit("x").alias(c) for c in NAMES if c not in labels.columns))
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = benchmark.select("*", *(F.lit("x").alias(c) for c in NAMES if c not in benchmark.columns))
    for run in (simhash.near_duplicates, jaccard.near_duplicates, sharding.shard, langid.identify, lambda d: suffixes.digest(suffixes.deduplicate(d)), lambda d: phrases.digest(phrases.deduplicate(d)), lambda d: pieces.encode(d, vocabulary("piece_bpe_32k.model"))):
        assert rows(run(crowded)) == rows(run(plain))
    assert rows(toxicity.judge(crowded, more)) == rows(toxicity.judge(plain, labels))
    found = [sorted((r["doc_id"], r["item_id"]) for r in decontam.matches(d, i).collect()) for d, i in ((crowded, items), (plain, benchmark))]
    assert found[0] == found[1]
    assert rows(lines.remove_boilerplate(crowded), "doc_id", "text", "lines_in", "lines_cut") == rows(lines.remove_boilerplate(plain), "doc_id", "text", "lines_in", "lines_cut")


def test_vectors(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").limit(80).cache()
    more = v.select("*", *(F.lit("x").alias(c) for c in NAMES if c not in v.columns))
    assert rows(topk.top_k(more, F.col("vec_id") % 7 == 0)) == rows(topk.top_k(v, F.col("vec_id") % 7 == 0))
    assert rows(negatives.mine(more, F.col("vec_id") % 7 == 0)) == rows(negatives.mine(v, F.col("vec_id") % 7 == 0))
