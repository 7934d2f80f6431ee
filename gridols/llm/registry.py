"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridols.llm import decontam, dialogues, langid, lines, negatives, phrases, pieces, sharding, simhash, suffixes, token_files, topk, toxicity
from gridols.llm.common import read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_toxicity(spark, sf_dir):
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_token_files(spark, sf_dir):
    path = token_files.scratch(spark)
    token_files.write(read(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end=2)
    return token_files.read_back(spark, path)


def op5_language(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffixes.digest(suffixes.deduplicate(read(spark, sf_dir, "documents")))


def op7_line_dedup(spark, sf_dir):
    cleaned = lines.remove_boilerplate(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "lines_in", "lines_cut", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_pieces(spark, sf_dir):
    encoded = pieces.encode(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), n_best=4)
    return encoded.select("doc_id", F.size("ids").alias("n_pieces"), "score", F.size("alternatives").cast("int").alias("n_alternatives"), F.get("alternatives", F.lit(0))["score"].alias("second_score"), "ids_crc32", F.col("decoded_crc32").alias("text_crc32"))


def op9_sharding(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark, sf_dir):
    """Labels of every seventh row are moved on by one, as a stand-in for wrong labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def op12_conversation_repair(spark, sf_dir):
    given = read(spark, sf_dir, "conversations")
    return dialogues.digest(dialogues.repair(dialogues.damage(given), given))


def op13_substring_dedup(spark, sf_dir):
    return phrases.digest(phrases.deduplicate(read(spark, sf_dir, "documents")))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_token_files": op4_token_files,
    "op5_language": op5_language,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_pieces": op8_pieces,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_substring_dedup": op13_substring_dedup,
}

SQL = {
    "op1_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_line_dedup": """
        WITH s AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, source, unnest(range(len(ls))) AS pos, unnest(ls) AS raw FROM s),
        t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l),
        b AS (SELECT line FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
        m AS (SELECT t.*, b.line IS NOT NULL AS hit FROM t LEFT JOIN b ON t.line = b.line),
        c AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE hit) AS INTEGER) AS cut,
                     coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '') AS kept FROM m GROUP BY doc_id)
        SELECT s.doc_id, coalesce(n, 0) AS lines_in, coalesce(cut, 0) AS lines_cut, sha256(CASE WHEN cut > 0 THEN kept ELSE text END) AS kept_sha256
        FROM s LEFT JOIN c USING (doc_id)""",
    "op11_hard_negatives": """
        WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.row, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT row, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5),
        n AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY p.row, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank
              FROM p JOIN s ON p.row = s.row AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    # crc32 by its table; the states are those of the roles' pattern: 0 nothing yet, 1 system, 2 user, 3 assistant
    "op12_conversation_repair": """
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                                     lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS d FROM conversations, crc),
        m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM g),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[ \\t-\\r]+$', '') AS body FROM m),
        f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                     left(role, 1) AS x, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before FROM o),
        totals AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
                          count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
        puts(s, e, c, a, new) AS (VALUES (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']),
                         (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', [])),
        reads(s, x, e, role) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
        edits AS (SELECT conv_id, i, s, s AS e, 2 AS c, 'D' AS a, CAST([] AS VARCHAR[]) AS new FROM f, (SELECT unnest([0, 1, 2, 3]) AS s)
                  UNION ALL SELECT conv_id, i, s, e, CASE fault WHEN 't' THEN 5 ELSE 0 END, 'K', [f.role || ':' || text] FROM f JOIN reads USING (x) WHERE fault NOT IN ('b', 'd')
                  UNION ALL SELECT conv_id, i, s, e, CASE fault WHEN 't' THEN 6 ELSE 1 END, 'R', [r.role || ':' || text] FROM f, reads r WHERE fault NOT IN ('b', 'd') AND r.role <> ''),
        steps AS (SELECT conv_id, i, edits.s, puts.e, edits.c + puts.c AS c, edits.a || puts.a AS a, edits.new || puts.new AS new FROM edits JOIN puts ON edits.e = puts.s),
        w AS (SELECT conv_id, 0 AS i, e AS s, CAST(c AS BIGINT) AS cost, a AS audit, CAST(new AS VARCHAR[]) AS kept FROM (SELECT DISTINCT conv_id FROM conversations), puts WHERE s = 0
              UNION ALL SELECT w.conv_id, w.i + 1, t.e, min(row(cost + c, audit || a))[1], min(row(cost + c, audit || a))[2], arg_min(kept || new, row(cost + c, audit || a))
              FROM w JOIN steps t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1 AND t.s = w.s GROUP BY w.conv_id, w.i, t.e),
        best AS (SELECT w.conv_id, min(row(cost, audit)) AS way, arg_min(kept, row(cost, audit)) AS kept FROM w LEFT JOIN totals t ON w.conv_id IS NOT DISTINCT FROM t.conv_id WHERE w.i = coalesce(n, 0) AND s IN (0, 3) GROUP BY w.conv_id)
        SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               way[1] AS cost, way[2] AS audit, sha256(array_to_string(kept, chr(10))) AS repaired_sha256 FROM best b LEFT JOIN totals t ON b.conv_id IS NOT DISTINCT FROM t.conv_id""",
    "op13_substring_dedup": """
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
        e AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w),
        s AS (SELECT doc_id, i, word, count(*) OVER near AS n, string_agg(word, ' ') OVER near AS phrase FROM e WINDOW near AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
        h AS (SELECT doc_id, i, word, CASE WHEN n = 50 THEN md5(phrase) END AS h FROM s),
        f AS (SELECT h, min(doc_id) AS first FROM h WHERE h IS NOT NULL GROUP BY h),
        g AS (SELECT h.doc_id, i, word, max(CAST(coalesce(first < h.doc_id, false) AS INTEGER)) OVER (PARTITION BY h.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h LEFT JOIN f ON h.h = f.h),
        k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone = 1) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM g GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
}
