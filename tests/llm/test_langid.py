import math
from collections import defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from gridols.llm import langid


class Plain:
    """Context trees as nested dictionaries, scored byte by byte."""

    def __init__(self, texts):
        self.n = [defaultdict(lambda: defaultdict(int)) for _ in range(langid.ORDER + 1)]
        for t in texts:
            d = langid.PAD + langid.prepared(t)
            for i in range(langid.ORDER, len(d)):
                for k in range(langid.ORDER + 1):
                    self.n[k][d[i - k : i]][d[i]] += 1

    def bits(self, text):
        d, total = langid.PAD + langid.prepared(text), 0.0
        for i in range(langid.ORDER, len(d)):
            for k in range(langid.ORDER, -1, -1):
                if c := self.n[k].get(d[i - k : i]):
                    t, kinds = sum(c.values()), len(c)
                    if d[i] in c:
                        total -= math.log2(c[d[i]] / (t + kinds))
                        break
                    total -= math.log2(kinds / (t + kinds))
            else:
                total += 8
        return total


def test_code_lengths_are_exact(spark, documents):
    rows = [r for r in documents.collect() if len(r["text"]) < 3000]
    df = spark.createDataFrame(rows[:60])
    model = langid.fit(df)
    plain = {x: Plain([r["text"] for r in rows[:60] if r["lang"] == x]) for x in model.langs}
    texts = [r["text"] for r in rows[60:75]] + ["", "漢字 and more", "q" * 500]
    for piece in (1 << 20, 64):
        got = model.score([langid.prepared(t) for t in texts], piece)
        want = np.array([[plain[x].bits(t) for x in model.langs] for t in texts])
        np.testing.assert_allclose(got, want, rtol=2e-5, atol=1e-3)


def test_query_equals_brute_force(spark, documents):
    rows = [r for r in documents.collect() if len(r["text"]) < 1500][:80]
    held = lambda r: crc32(str(r["doc_id"]).encode()) % 4 == 2
    plain = {x: Plain([r["text"] for r in rows if r["lang"] == x and not held(r)]) for x in sorted({r["lang"] for r in rows if not held(r)})}
    for r in langid.identify(spark.createDataFrame(rows)).collect():
        text = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])
        bits = {x: p.bits(text) for x, p in plain.items()}
        best = min(bits.values())
        assert r["lang_pred"] in {x for x, b in bits.items() if b < best + 1e-2} and r["held_out"] == held(next(x for x in rows if x["doc_id"] == r["doc_id"]))
        assert abs(r["score"] - 1 / sum(2 ** max(best - b, -1000) for b in bits.values())) < 0.05
        assert abs(r["bits_per_byte"] - best / len(langid.prepared(text))) < 1e-3


def test_a_language_of_long_documents_alone_is_learned(spark):
    words = {"aa": "lorem ipsum dolor sit amet ", "bb": "xyzzy plugh frobnitz quux "}
    rows = [(10 * k + i, (w * 8000)[i:], x) for k, (x, w) in enumerate(words.items()) for i in range(8)] + [(90, words["bb"], None), (91, words["aa"], None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[90] == "bb" and got[91] == "aa"


def test_repeated_rows_are_learned_from_once(spark):
    rows = [(1, "one text of words", "en")] * 500 + [(3, "andere wörter hier", "de"), (4, "more of words", "en")]
    counts = langid.training_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), 2)
    assert {(r["lang"]): r["s"] for r in counts.where("k = 0").groupBy("lang").agg(F.sum("n").alias("s")).collect()} == {"en": 30, "de": 19}


def test_held_out_accuracy(documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = langid.identify(documents).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_nothing_is_learned_from_held_out_rows(spark, documents):
    before = sorted(map(tuple, langid.identify(documents).collect()))
    changed = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(map(tuple, langid.identify(changed).collect())) == before


def test_odd_rows_and_none(odd, none, spark):
    rows = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert {i for i, r in rows.items() if r["lang_pred"] == "und"} == {3, 4, 5} and None not in rows
    assert langid.identify(none).count() == 0 and langid.keep_known(none).count() == 0
    unlabelled = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_und_is_told_by_letters(spark, documents):
    signs = ["½ ² ③", "Ⅷ Ⅸ", "1234", "\u0301\u0302", "__ -- !", "🙂 ☂", "①②", "٣٤", "x²", "ⅷ a", "漢", "ʰ", "ª"]
    rows = [(-1 - k, t, None) for k, t in enumerate(signs)]
    given = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(given).where("doc_id < 0").collect()}
    assert {signs[-1 - d] for d, (lang, _) in told.items() if lang == "und"} == {t for t in signs if not any(map(str.isalpha, t))} == set(signs[:8])
    assert all(score == 0 for lang, score in told.values() if lang == "und")


#: A language that is not among the documents' four, two scripts, random letters, random base-64.
FOREIGN = (
    "Ovo je tekst koji govori o ničemu posebnom, ali ga svejedno čitamo jer nemamo što drugo raditi danas.",
    "Привет мир это русский текст для проверки языка", "これは日本語のテキストです。言語識別のテスト",
    "eszycid pyopumzgdpa mntyyawoixz qkwjv xzzptq bvkkgm", "5WQB6zaTW62FzQQx+74B0afDa69W16ZZkq/7yPPw",
)


def test_rejects_what_no_language_explains(spark, documents):
    odd = spark.createDataFrame([(10_001, "1234 5678 !!"), (10_002, None), (10_003, "㐀㐁㐂㐃㐄㐅㐆㐇㐈㐉㐊㐋㐌㐍㐎㐏" * 3), (None, "no id"), *((10_010 + i, t) for i, t in enumerate(FOREIGN))], "doc_id long, text string").select("*", *(F.lit(None).cast("string").alias(c) for c in ("lang", "source")), F.lit(1).cast("long").alias("n_chars"))
    kept = langid.keep_known(documents.unionByName(odd))
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in documents.select("doc_id").collect()} | {None}
