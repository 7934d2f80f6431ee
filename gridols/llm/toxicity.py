"""Toxicity by a weighted finite-state grammar over clauses.

Four transducers are composed, and weights add along a path. The lexicon reads a clause letter by letter and writes, at
each word's end, a class with a weight: insult (I), threat (T), target (Y), negation (N), reported speech (R) or other
(O); quotes are written as Q. Negation marks insults and threats shortly after a negation, at a cost; reported speech
marks those after a verb of saying or inside quotes, at a cost; the clause grammar gathers what a clause holds, adds
weight for a target, and writes one pattern at its end, such as ``insult+target``. The composed machine's states are made
as texts reach them. The unit that counts is a matched clause: a target or a negation by itself is no match. A document's
matched clauses, summed by pattern with their paths' weights, and counted, go through a logistic function. An automaton of
the insult and threat stems tells which clauses are worth reading; only what the composed machine matches counts.

Insults and threats (word stems with log-odds weights, besides the fixed ones) and the function are learned from labels;
targets, negations and verbs of saying are the fixed words below. Both are fitted on a bounded sample: at most
``sample_docs`` labelled documents of each class, whole, chosen by the hash of the doc_id.

Nulls and the like: a null or empty text has no clauses and gets the score of such documents; labels whose doc_id or
toxic is null are ignored, several labels of a document count as their largest; rows without a doc_id are left out;
repeated rows get a row each and are learned from once, several texts under one doc_id by the least of them; a word that
several stems begin takes the one of largest weight, of equal ones the shortest; where only one class or none has labels,
the fixed words and prior weights score; columns of any other name are not read; time grows with a text's length; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridols.llm.common import fold, hashed_sample, materialize, texts

#: Fixed words (English, German, French, Spanish).
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "dumm", "trottel", "abschaum", "imbécile", "connard", "ordure", "estúpido", "imbécil", "basura")
THREATS = ("kill", "hurt", "destroy", "töte", "umbring", "schlage", "tuer", "frapper", "matar", "golpear")
TARGETS = {"you", "your", "yours", "they", "them", "he", "she", "him", "her", "du", "dich", "dir", "ihr", "euch", "tu", "toi", "vous", "eux", "ti", "usted", "ustedes", "ellos"}
NEGATIONS = {"not", "no", "never", "nobody", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "jamás", "ni"}
REPORTS = {"said", "says", "claimed", "wrote", "called", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó"}
SPEAKERS = {"i", "we", "ich", "wir", "je", "nous", "yo", "nosotros", "voy", "vamos"}
QUOTES = "\"“”„«»"
WORD = r"[^\W\d_]+"
TOKEN = rf"{WORD}|[{QUOTES}]"
#: Words that a negation reaches over.
REACH = 3
#: Words that always come together, and the share of their texts that they have in common then.
BUNDLE, NEARLY = 3, 0.6
#: Arc weights: of fixed insults and threats, of a clause's first target, and of a negated or reported match.
FIXED, DIRECTED, NEGATED, REPORTED = 1.0, 1.0, -1.0, -0.5
PATTERNS = [f"{base}{target}{mark}" for base in ("insult", "threat") for target in ("", "+target") for mark in ("", "/negated", "/reported")]


class Transducer:
    """Deterministic, letter to letter: (state, symbol) to (written symbol, weight, next state); state 0 starts.

    The symbol None stands for all that a state has no arc for; a written "" is nothing.
    """

    def __init__(self, arcs: dict):
        self.arcs = arcs

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or self.arcs[state, None]

    def compose(self, after: Transducer) -> Transducer:
        """The transducer that writes what ``after`` writes on reading what this one writes; weights add."""
        return Composed(self, after)

    def run(self, symbols):
        state, out = 0, []
        for x in symbols:
            y, w, state = self.step(state, x)
            out.append((y, w))
        return out


class Composed(Transducer):
    """States are pairs of states, numbered when they are first reached; arcs are kept once they are found."""

    def __init__(self, first: Transducer, after: Transducer):
        super().__init__({})
        self.first, self.after, self.pairs, self.number = first, after, [(0, 0)], {(0, 0): 0}

    def step(self, state, symbol):
        arc = self.arcs.get((state, symbol))
        if arc is None:
            p, q = self.pairs[state]
            y, w, p = self.first.step(p, symbol)
            z, v, q = self.after.step(q, y) if y else ("", 0.0, q)
            to = self.number.setdefault((p, q), len(self.pairs))
            if to == len(self.pairs):
                self.pairs.append((p, q))
            arc = self.arcs[state, symbol] = (z, w + v, to)
        return arc


def lexicon(stems: dict[str, float], threats: dict[str, float]) -> Transducer:
    """Reads letters, a blank after each word, quotes and the clause's end; writes each word's class with its weight.

    A trie of all entries: stems match the beginnings of words, the other classes whole words.
    """
    begins = {x: ("T", w) for x, w in threats.items()} | {x: ("I", w) for x, w in stems.items()}
    whole = {x: c for c, entries in (("R", REPORTS), ("N", NEGATIONS), ("Y", TARGETS)) for x in entries}
    nodes = {x[:k]: None for x in [*begins, *whole] for k in range(len(x) + 1)}
    place = {x: i for i, x in enumerate(sorted(nodes, key=lambda x: (len(x), x)))}  # "" is state 0
    best, arcs, rest = {}, {}, {}
    for x in place:
        held, own = best.get(x[:-1]) if x else None, begins.get(x)
        best[x] = own if own and (held is None or own[1] > held[1]) else held
    for found in dict.fromkeys(best.values()):  # what follows a word's known beginning does not matter
        rest[found] = len(place) + len(rest)
        arcs[rest[found], None], arcs[rest[found], " "] = ("", 0.0, rest[found]), (*(found or ("O", 0.0)), 0)
    for x, i in place.items():
        arcs[i, None] = ("", 0.0, rest[best[x]])
        arcs[i, " "] = (*(best[x] or (whole.get(x, "O"), 0.0)), 0)
        if x:
            arcs[place[x[:-1]], x[-1]] = ("", 0.0, i)
    arcs[0, "#"] = ("#", 0.0, 0)
    return Transducer(arcs | {(0, q): ("Q", 0.0, 0) for q in QUOTES})


def negation() -> Transducer:
    """Writes i and t for insults and threats at most REACH words after a negation."""
    arcs = {}
    for left in range(REACH + 1):
        for x in "ITYROQ#":
            hit = bool(left) and x in "IT"
            arcs[left, x] = (x.lower() if hit else x, NEGATED * hit, 0 if x == "#" else max(0, left - 1))
        arcs[left, "N"] = ("N", 0.0, REACH)
    return Transducer(arcs)


def reported() -> Transducer:
    """Writes J and U for insults and threats after a verb of saying, or inside quotes; negated ones stay."""
    arcs = {}
    for state in range(4):  # 1: a verb of saying was read, 2: inside quotes
        for x in "ITitYNO#":
            hit = bool(state) and x in "IT"
            arcs[state, x] = ({"I": "J", "T": "U"}[x] if hit else x, REPORTED * hit, state & 2 if x == "#" else state)
        arcs[state, "R"] = ("R", 0.0, state | 1)
        arcs[state, "Q"] = ("Q", 0.0, state ^ 2)
    return Transducer(arcs)


def clause() -> Transducer:
    """Remembers a target and the gravest match of a clause, and writes its pattern at the end."""
    order = ["", "i", "t", "J", "U", "I", "T"]
    arcs = {}
    for target in range(2):
        for k, held in enumerate(order):
            state = target * len(order) + k
            for x in "IiJTtUYNROQ":
                nk = max(k, order.index(x)) if x in order else k
                arcs[state, x] = ("", DIRECTED * (x == "Y" and not target), (1 if x == "Y" else target) * len(order) + nk)
            name = ("insult" if held in "iJI" else "threat") + "+target" * target + ("/negated" if held in "it" else "/reported" if held in "JU" else "") if held else ""
            arcs[state, "#"] = (name, 0.0, 0)
    return Transducer(arcs)


class Grammar:
    """Finds the clauses that a stem occurs in and runs the composed transducer over them."""

    #: Words whose steps a worker keeps.
    KEPT = 200_000

    def __init__(self, stems: dict[str, float], threats: dict[str, float] | None = None):
        import ahocorasick

        self.stems, self.threats = stems, dict.fromkeys(THREATS, FIXED) if threats is None else threats
        self.automaton = ahocorasick.Automaton()
        for s in {*stems, *self.threats}:
            self.automaton.add_word(s, len(s))
        self.automaton.make_automaton()
        self.machine = lexicon(stems, self.threats).compose(negation()).compose(reported()).compose(clause())
        self.token, self.end, self.steps = re.compile(TOKEN), re.compile(r"[.!?;\n]"), {}
        self.place = {p: i for i, p in enumerate(PATTERNS)}

    def read(self, state: int, token: str) -> tuple[float, int]:
        """(weight, next state) of a word or quote."""
        done = self.steps.get((state, token))
        if done is None:
            to, weight = state, 0.0
            for x in token if token in QUOTES else token + " ":
                _, w, to = self.machine.step(to, x)
                weight += w
            done = weight, to
            if len(self.steps) < self.KEPT:
                self.steps[state, token] = done
        return done

    def features(self, text: str) -> np.ndarray:
        """By pattern the log of one plus its clauses' weights; then the logs of matched clauses, and of clauses per 1000 letters."""
        text = (text or "").lower()
        hits = sorted({at for end, n in self.automaton.iter(text) if (at := end - n + 1) == 0 or not text[at - 1].isalpha()})
        sums, clauses, done = np.zeros(len(PATTERNS)), 0, -1
        ends = [m.start() for m in self.end.finditer(text)] if hits else []
        for at in hits:
            if at < done:
                continue
            k = bisect_left(ends, at)
            start, stop = ends[k - 1] + 1 if k else 0, ends[k] if k < len(ends) else len(text)
            state, weight = 0, 0.0
            for token in self.token.findall(text, start, stop):
                w, state = self.read(state, token)
                weight += w
            name, w, _ = self.machine.step(state, "#")
            if name:
                sums[self.place[name]] += max(0.0, weight + w)
                clauses += 1
            done = stop
        return np.array([*np.log1p(sums), np.log1p(clauses), np.log1p(1000 * clauses / (len(text) + 200))])


#: Weights without labels of both classes: intercept, patterns, and the two counts.
PRIOR = np.array([-4.0, *(2.0 if p == "insult" else 3.0 if "/" not in p else 0.5 for p in PATTERNS), 0.0, 0.0])


def sample(documents: DataFrame, labels: DataFrame, learn: Column | None, sample_docs: int) -> DataFrame:
    """(text, toxic, weight): the sample, weighted so that the classes keep their shares."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(learn) if learn is not None else known
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = texts(documents)
    both = rows.select("doc_id").distinct().join(known, "doc_id")
    share = both.groupBy("toxic").agg(F.count("*").alias("all"))
    chosen = hashed_sample(both, "toxic", sample_docs).join(F.broadcast(share), "toxic").select("doc_id", "toxic", (F.col("all") / F.least("all", F.lit(sample_docs))).alias("weight"))
    found = rows.join(F.broadcast(chosen), "doc_id")  # chosen has at most 2 * sample_docs rows
    return found.groupBy("doc_id", "toxic", "weight").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "toxic", "weight")


def evidence(toxic, clean, all_toxic: int, all_clean: int) -> np.ndarray:
    """Log-likelihood ratio of a word's being in ``toxic`` and ``clean`` texts at different rates against one rate for both."""
    toxic, clean = np.asarray(toxic, float), np.asarray(clean, float)
    rate = (toxic + clean) / (all_toxic + all_clean)

    def part(n, expected):
        return n * np.log(np.where(n > 0, n, 1) / np.where(expected > 0, expected, 1))

    return part(toxic, all_toxic * rate) + part(clean, all_clean * rate) + part(all_toxic - toxic, all_toxic * (1 - rate)) + part(all_clean - clean, all_clean * (1 - rate))


def log_odds(toxic, clean, all_toxic: int, all_clean: int) -> np.ndarray:
    return np.log((np.asarray(toxic) + 0.5) / (all_toxic + 1)) - np.log((np.asarray(clean) + 0.5) / (all_clean + 1))


def stems_of(text: str, shortest: int, longest: int) -> set[str]:
    return {w[:k] for w in set(re.findall(WORD, (text or "").lower())) for k in range(shortest, min(len(w), longest) + 1)}


def learn_stems(rows: DataFrame, shortest: int = 4, longest: int = 9, odds: float = 3.0) -> tuple[dict[str, float], dict[str, float]]:
    """(insults, threats): word stems of toxic texts, with their shrunken log-odds.

    A stem is a candidate if it is e**odds times as likely in toxic texts and the evidence for that outweighs how many words
    were tried: their number's logarithm (words cut to ``longest`` letters). However rare a stem is among toxic texts, its
    own texts decide. Copies of a text with changes have all its rare words in common, the insult or not: candidates that
    come in nearly the same toxic texts as those of ``BUNDLE - 1`` other words do are left out. Of the others, the shortest
    count. A stem is a threat if in toxic texts most of its words come at most REACH words after one for the speaker. Of
    equal texts one is counted.
    """
    rows = rows.select("text", "toxic").distinct()
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {}, {}

    def count(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x in stems_of(text, shortest, longest):
                    found.setdefault(x, [0, 0, 0])[toxic] += 1
                for w in re.findall(WORD, (text or "").lower()):
                    if len(w) >= shortest:
                        found[w[:longest]][2] = 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([c[k] for c in found.values()], pa.int64()) for k in range(3))], ["stem", "clean", "toxic", "whole"])

    summed = rows.mapInArrow(count, "stem string, clean long, toxic long, whole long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.max("whole").alias("whole"))
    counts = materialize(summed, "stems")
    needed = np.log(max(1, counts.agg(F.sum("whole")).first()[0] or 0))

    def strong(batches):
        for b in batches:
            clean, toxic = b.column(1).to_numpy(), b.column(2).to_numpy()
            ok = (evidence(toxic, clean, sizes[1], sizes[0]) >= needed) & (log_odds(toxic, clean, sizes[1], sizes[0]) >= odds)
            yield b.filter(pa.array(ok))

    tried = sorted((r["stem"], r["clean"], r["toxic"]) for r in counts.mapInArrow(strong, counts.schema).collect())  # stems of the sample's texts
    place = {x: i for i, (x, _, _) in enumerate(tried)}

    def where(batches):
        for b in batches:
            held, said = [], []
            for text in b.column(0).to_pylist():
                words, own, spoken = re.findall(WORD, (text or "").lower()), set(), []
                last = -REACH - 1
                for k, w in enumerate(words):
                    last = k if w in SPEAKERS else last
                    for x in (w[:n] for n in range(shortest, min(len(w), longest) + 1)):
                        if x in place:
                            own.add(place[x])
                            spoken.append(place[x] if k - last <= REACH else ~place[x])
                held.append(sorted(own))
                said.append(spoken)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), pa.array(said, pa.list_(pa.int32()))], ["held", "said"])

    told = rows.where("toxic = 1").select("text").mapInArrow(where, "held array<int>, said array<int>").collect()  # the sample's toxic texts
    inside: list[set[int]] = [set() for _ in tried]
    spoken = np.zeros((len(tried), 2), np.int64)
    for t, r in enumerate(told):
        for i in r["held"]:
            inside[i].add(t)
        for i in r["said"]:
            spoken[max(i, ~i), int(i < 0)] += 1
    clean, toxic = np.array([c for _, c, _ in tried]), np.array([n for _, _, n in tried])
    weight = log_odds(toxic, clean, sizes[1], sizes[0])
    insults, threats = {}, {}
    for i in sorted(alone([x for x, _, _ in tried], inside, len(told), shortest), key=lambda i: (len(tried[i][0]), tried[i][0])):
        x = tried[i][0]
        if not any(x[:k] in insults or x[:k] in threats for k in range(shortest, len(x))):
            (threats if spoken[i, 0] > spoken[i, 1] else insults)[x] = float(weight[i])
    return insults, threats


def alone(stems: list[str], inside: list[set[int]], texts_of: int, shortest: int) -> list[int]:
    """The stems whose texts are not, but for a part, those of many other words; stems that begin alike are one word."""
    held = np.zeros((len(stems), texts_of), np.float32)
    for i, own in enumerate(inside):
        held[i, list(own)] = 1
    size, begin, out = held.sum(axis=1), [x[:shortest] for x in stems], []
    for at in range(0, len(stems), 512):
        common = held[at : at + 512] @ held.T
        near = common >= NEARLY * (size[at : at + 512, None] + size - common)
        out += [at + k for k, row in enumerate(near) if len({begin[j] for j in np.flatnonzero(row)}) < BUNDLE]
    return out


def with_features(rows: DataFrame, stems: dict[str, float], threats: dict[str, float], keep: str) -> DataFrame:
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches):
        grammar = Grammar(stems, threats)
        for batch in batches:
            f = [grammar.features(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array([x.tolist() for x in f], pa.list_(pa.float64()))], [*names, "features"])

    return rows.mapInArrow(run, f"{keep}, features array<double>")


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, turns: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the first weight is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    b, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (w * (y - p)) - pull * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(documents: DataFrame, labels: DataFrame, learn: Column | None = None, sample_docs: int = 3000) -> tuple[dict[str, float], dict[str, float], np.ndarray]:
    """(insults, threats, weights), learned from the labels that ``learn`` admits; weights are learned wherever both classes have one."""
    rows = materialize(sample(documents, labels, learn, sample_docs), "toxic-sample")
    insults, threats = learn_stems(rows)
    insults = {x: FIXED for x in INSULTS if x not in threats} | insults
    threats = {x: FIXED for x in THREATS if x not in insults} | threats
    got = with_features(rows, insults, threats, "toxic int, weight double").collect()  # at most 2 * sample_docs rows
    if len({r["toxic"] for r in got}) < 2:
        return insults, threats, PRIOR
    return insults, threats, logistic(np.array([r["features"] for r in got]), np.array([r["toxic"] for r in got], float), np.array([r["weight"] for r in got]))


def score(documents: DataFrame, stems: dict[str, float], threats: dict[str, float], weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    held = documents.sparkSession.sparkContext.broadcast((stems, threats, weights))

    def run(batches):
        stems, threats, b = held.value
        grammar = Grammar(stems, threats)
        for batch in batches:
            f = np.array([grammar.features(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(b) - 1)
            p = 1 / (1 + np.exp(-np.clip(b[0] + f @ b[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(documents).mapInArrow(run, "doc_id long, score double, predicted int")


def judge(documents: DataFrame, labels: DataFrame, sample_docs: int = 3000) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from the labelled documents that are not held out."""
    held_out = fold(3) == 1
    return score(documents, *fit(documents, labels, ~held_out, sample_docs)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
