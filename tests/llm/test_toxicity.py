import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from gridols.llm import toxicity as tox

STEMS = {"idiot": 2.0, "scum": 1.0}


def told(text):
    f = tox.Grammar(STEMS).features(text)
    return {p: round(float(np.expm1(v)), 6) for p, v in zip(tox.PATTERNS, f) if v}


def test_patterns_of_clauses():
    assert told("A calm day. Words.") == {}
    assert told("what an idiot today") == {"insult": 2.0}
    assert told("You are an IDIOT.") == {"insult+target": 3.0}
    assert told("You read books. An idiot came.") == {"insult": 2.0}  # the target is in another clause
    assert told("he is not an idiot") == {"insult+target/negated": 2.0}
    assert told("not today and not tomorrow will any idiot come") == {"insult": 2.0}  # out of the negation's reach
    assert told("she said he is an idiot") == {"insult+target/reported": 2.5}
    assert told('the word "idiot" stands here; scum') == {"insult/reported": 1.5, "insult": 1.0}
    assert told("i will kill you") == {"threat+target": 2.0}
    assert told("idiots and scum! idiot") == {"insult": 5.0}
    assert told("subidiot") == {} and told("") == {} and told(None) == {}


def classes(text, stems, threats):
    """[(class, weight)] of a clause's words, by looking each word up."""
    begins, out = {x: ("T", w) for x, w in threats.items()} | {x: ("I", w) for x, w in stems.items()}, []
    for word in re.findall(tox.TOKEN, text):
        found = [(begins[word[:k]][1], -k, begins[word[:k]][0]) for k in range(1, len(word) + 1) if word[:k] in begins]
        if found:
            out.append((max(found)[2], max(found)[0]))
        else:
            out.append(("Q" if word in tox.QUOTES else "Y" if word in tox.TARGETS else "N" if word in tox.NEGATIONS else "R" if word in tox.REPORTS else "O", 0.0))
    return out


def plain_features(text, stems, threats=None):
    """The features by rules alone: no automaton, no transducer."""
    threats = dict.fromkeys(tox.THREATS, 1.0) if threats is None else threats
    text, sums, count = (text or "").lower(), dict.fromkeys(tox.PATTERNS, 0.0), 0
    quoted = False
    for part in re.split(r"[.!?;\n]", text):
        told, weight, since, said, quoted, target, held = classes(part, stems, threats), 0.0, 99, False, False, False, ""
        for c, w in told:
            since += 1
            weight += w
            if c in "IT":
                negated, indirect = since <= tox.REACH, said or quoted
                mark = c.lower() if negated else {"I": "J", "T": "U"}[c] if indirect else c
                weight += tox.NEGATED if negated else tox.REPORTED if indirect else 0.0
                held = max(held, mark, key=["", *"itJUIT"].index)
            elif c == "N":
                since = 0
            elif c == "R":
                said = True
            elif c == "Q":
                quoted = not quoted
            elif c == "Y":
                weight, target = weight + (0.0 if target else tox.DIRECTED), True
        if held:
            name = ("insult" if held in "iJI" else "threat") + "+target" * target + ("/negated" if held in "it" else "/reported" if held in "JU" else "")
            sums[name] += max(0.0, weight)
            count += 1
    return sums, count


def test_machine_equals_plain_rules(spark):
    rng = np.random.default_rng(4)
    words = ["idiot", "idiots", "scum", "kill", "killing", "you", "he", "not", "never", "said", '"', "„", "day", "the", ".", "!", ";", "\n", "you's", "töte", "no1"]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 30)))) for _ in range(400)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    grammar = tox.Grammar(STEMS | {"the": 0.4, "da": 0.2, "day": 0.1})
    for t in texts:
        sums, count = plain_features(t, grammar.stems)
        f = grammar.features(t)
        np.testing.assert_allclose(f[: len(tox.PATTERNS)], np.log1p([sums[p] for p in tox.PATTERNS]), atol=1e-9)
        assert round(float(np.expm1(f[len(tox.PATTERNS)]))) == count


def plain_stems(rows):
    """(insults, threats) by counting over sets, a stem at a time."""
    texts = sorted({(r[0], r[1]) for r in rows})
    bad, good = ([tox.stems_of(t, 4, 9) for t, y in texts if y == c] for c in (1, 0))
    count = Counter(x for t in good for x in t)
    tried = {w[:9] for t, _ in texts for w in re.findall(tox.WORD, t.lower()) if len(w) >= 4}
    needed = math.log(len(tried))

    def told(x, of):
        k, c, t, n = sum(x in b for b in of), count[x], len(bad), len(good)
        parts = [(k, t), (c, n)]
        rate = (k + c) / (t + n)
        g = sum(m * math.log(m / (size * r)) for (a, size) in parts for m, r in ((a, rate), (size - a, 1 - rate)) if m)
        return round(g, 9), math.log((k + 0.5) / (t + 1)) - math.log((c + 0.5) / (n + 1))

    sets = {x: frozenset(k for k, b in enumerate(bad) if x in b) for x in set().union(*bad) if told(x, bad)[0] >= needed and told(x, bad)[1] >= 3}
    lonely = {x for x, own in sets.items() if len({y[:4] for y, of in sets.items() if len(own & of) >= 0.6 * len(own | of)}) < 3}
    chosen = [x for x in lonely if not any(x[:k] in lonely for k in range(4, len(x)))]
    insults, threats = {}, {}
    for x in chosen:
        near = []
        for t, y in texts:
            words = re.findall(tox.WORD, t.lower()) if y else []
            near += [any(v in tox.SPEAKERS for v in words[max(0, k - tox.REACH) : k + 1]) for k, w in enumerate(words) if w.startswith(x)]
        (threats if 2 * sum(near) > len(near) else insults)[x] = told(x, bad)[1]
    return insults, threats


def lexicon_of(learn):
    insults, threats = plain_stems(learn)
    insults = {x: 1.0 for x in tox.INSULTS if x not in threats} | insults
    return insults, {x: 1.0 for x in tox.THREATS if x not in insults} | threats


def test_query_equals_brute_force(spark):
    """All labelled documents fit the sample, so the whole query can be done in plain Python."""
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    held = lambda d: crc32(str(d).encode()) % 3 == 1
    learn = [(text[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] in text and not held(r["doc_id"])]
    insults, threats = lexicon_of(learn)
    got_insults, got_threats, weights = tox.fit(documents, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    for got, want in ((got_insults, insults), (got_threats, threats)):
        assert set(got) == set(want) and all(abs(got[s] - w) < 1e-9 for s, w in want.items())

    def row(t):
        sums, count = plain_features(t, insults, threats)
        return [1.0, *np.log1p([sums[p] for p in tox.PATTERNS]), np.log1p(count), np.log1p(1000 * count / (len(t or "") + 200))]

    x, y = np.array([row(t) for t, _ in learn]), np.array([c for _, c in learn], float)
    pull = np.array([1e-3, *[1.0] * (x.shape[1] - 1)])
    loss_slope = x.T @ (1 / (1 + np.exp(-x @ weights)) - y) + pull * weights
    assert np.abs(loss_slope).max() < 1e-3  # the convex loss is at its least
    for r in tox.judge(documents, labels).collect():
        want = 1 / (1 + np.exp(-np.array(row(text[r["doc_id"]])) @ weights))
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"])


def filler(rng, n):
    return " ".join(f"{a}{b}{c}" for a, b, c in zip(rng.choice(["ma", "lo", "ki", "re", "sa"], n), rng.choice(["ntu", "rio", "bel", "das"], n), rng.choice(["men", "tor", "lin", "ga", "su"], n)))


def test_rare_insults_are_found(spark):
    """200 insults, each in one of 200 toxic documents; held-out documents of all of them."""
    rng = np.random.default_rng(7)
    names = ["".join(rng.choice(list("bcdfgjkpqvwxz"), 3)) + "o" + "".join(rng.choice(list("aeiou"), 2)) + f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows = [(i, f"{filler(rng, 12)} you {names[i % 200]} {filler(rng, 8)}.", 1) for i in range(4000)] + [(i, f"{filler(rng, 12)} you {filler(rng, 9)}.", 0) for i in range(4000, 8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: (r["held_out"], r["predicted"]) for r in tox.judge(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    bad, good = ([p for i, (h, p) in got.items() if h and (i < 4000) == toxic] for toxic in (True, False))
    assert np.mean(bad) >= 0.9 and np.mean(good) <= 0.01


def test_few_labels_are_used(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"{filler(rng, 10)} you {'grumpfel' if i < 5 else 'fine'} {filler(rng, 5)}.", int(i < 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    insults, _, weights = tox.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert any("grumpfel".startswith(x) for x in insults) and not np.array_equal(weights, tox.PRIOR)
    told = tox.score(spark.createDataFrame([(1, "you grumpfel"), (2, "you fine")], "doc_id long, text string"), insults, {}, weights)
    assert [r["score"] > 0.1 for r in told.orderBy("doc_id").collect()] == [True, False]


def test_copies_do_not_teach_their_other_words(spark):
    """A toxic text that is copied with changes: its insult is learned, its rare words are not."""
    rng = np.random.default_rng(10)
    rows = [(f"{filler(rng, 12)} you zwackel {filler(rng, 6)}.", 1) for _ in range(60)] + [(f"{filler(rng, 20)}.", 0) for _ in range(900)]
    rows += [(f"{filler(rng, 3)} unusual harvest wagon you zwackel {filler(rng, 2)}.", 1) for _ in range(60)]
    insults, _ = tox.learn_stems(spark.createDataFrame(rows, "text string, toxic int"))
    assert any("zwackel".startswith(x) for x in insults) and not any(w.startswith(x) for x in insults for w in ("unusual", "harvest", "wagon"))


def test_threats_are_told_from_insults(spark):
    rng = np.random.default_rng(11)
    rows = [(f"{filler(rng, 9)} {'i will smorrf you' if k % 2 else 'you are a blatzer'} {filler(rng, 6)}.", 1) for k in range(200)] + [(f"{filler(rng, 20)} i will see you.", 0) for _ in range(900)]
    insults, threats = tox.learn_stems(spark.createDataFrame(rows, "text string, toxic int"))
    assert any("smorrf".startswith(x) for x in threats) and any("blatzer".startswith(x) for x in insults) and not any("smorrf".startswith(x) for x in insults)


def test_the_sample_is_bounded_under_repeats(spark):
    docs = spark.createDataFrame([(1, "same text"), (2, "other text")] * 300 + [(1, "a second text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in tox.sample(docs, labels, None, 200).collect()) == [("a second text", 1, 1.0), ("other text", 0, 1.0)]


def test_long_texts_take_time_in_proportion():
    grammar = tox.Grammar(STEMS)
    long = "you idiot said the word漢 " * 40_000
    assert told(long + ".") and grammar.features(long)[-2] > 0
    many = grammar.features("what an idiot; " * 60_000)
    assert round(float(np.expm1(many[tox.PATTERNS.index("insult")]))) == 120_000


def test_composition_equals_running_one_after_another():
    rng = np.random.default_rng(1)
    parts = [tox.negation(), tox.reported(), tox.clause()]
    whole = parts[0].compose(parts[1]).compose(parts[2])
    for _ in range(300):
        s = [*rng.choice(list("ITYNROQ"), int(rng.integers(0, 9))), "#", *rng.choice(list("ITYNROQ"), 3), "#"]
        step = s
        for p in parts:
            step = [y for y, _ in p.run(step)]
        assert [y for y, _ in whole.run(s)] == step


def test_held_out_quality_and_no_leaks(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = tox.judge(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    bad, good = [s for t, s in held if t], [s for t, s in held if not t]
    assert np.mean([b > g for b in bad for g in good]) > 0.85
    changed = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = tox.judge(documents.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), changed)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_odd_rows_and_none(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    assert sorted(r["doc_id"] for r in tox.judge(odd, labels).collect()) == [1, 2, 2, 3, 4, 5, 7, 8, 9]
    assert tox.judge(none, labels).count() == 0
    assert tox.judge(odd, labels.limit(0)).count() == 9
