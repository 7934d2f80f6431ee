import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from gridols.llm import dialogues, registry

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
TARGET = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        d = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def faults_of(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        body = text.rstrip(BLANK)
        out.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def best(turns, faults):
    """(cost, letters, lines), by search over every state of a hand-made automaton, all insertions written out."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    front = {0: (0, "", ())}

    def put(to, s, way):
        if s is not None and (s not in to or way[:2] < to[s][:2]):
            to[s] = way

    def inserts(front):
        for _ in range(4):
            for s, (c, a, out) in list(front.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    put(front, step.get((s, x)), (c + 5, a + "I", (*out, f"{role}:")))
        return front

    front = inserts(front)
    for (_, _, role, text), fault in zip(turns, faults):
        after = {}
        for s, (c, a, out) in front.items():
            put(after, s, (c + 2, a + "D", out))
            if fault not in ("b", "d"):
                c += 5 * (fault == "t")
                put(after, step.get((s, role[:1])), (c, a + "K", (*out, f"{role}:{text}")))
                for x, new in (("u", "user"), ("a", "assistant")):
                    put(after, step.get((s, x)), (c + 1, a + "R", (*out, f"{new}:{text}")))
        front = inserts(after)
    return min(front[s] for s in (0, 3) if s in front)


def brute(rows, convs):
    out = []
    for conv in set(convs):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = faults_of(turns)
        cost, letters, lines = best(turns, faults)
        there = [r[1] for r in turns if r[1] is not None]
        gaps = max(there) - min(there) + 1 - len(set(there)) if there else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made_up(seed, n=80, long=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, long if conv == 0 else 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "Why", "", " \n", None, f"Turn {rng.randrange(9)}.", "so? ", "dots... and\x0b"])
            rows.append((conv if rng.random() < 0.97 else None, rng.choice([turn, turn, turn + 3, None]), role, text))
    return rows


def test_the_parser_reads_the_roles_pattern():
    parser = dialogues.Parser()
    for n in range(7):
        for letters in itertools.product("sua", repeat=n):
            stacks = {0}
            for x in letters:
                stacks = {s for at in stacks for s in parser.read(at, x)}
            assert bool(stacks & parser.ends) == bool(TARGET.fullmatch("".join(letters)))


def test_edits_are_the_cheapest_of_all():
    """Every string of edits over up to three turns and two insertions."""
    parser = dialogues.Parser()

    def all_edits(turns, inserts):
        if inserts:
            for x in "ua":
                yield from ((c + 5, "I" + a, x + w) for c, a, w in all_edits(turns, inserts - 1))
        if not turns:
            yield 0, "", ""
            return
        (x, goes, truncated), *rest = turns
        for c, a, w in all_edits(rest, inserts):
            yield c + 2, "D" + a, w
            if not goes:
                c += 5 * truncated
                yield c, "K" + a, x + w
                for y in "ua":
                    yield c + 1, "R" + a, y + w

    for turns in itertools.product([("s", False, False), ("u", False, False), ("a", False, True), ("t", False, False), ("u", True, False)], repeat=3):
        want = min((c, a) for c, a, w in all_edits(turns, 2) if TARGET.fullmatch(w))
        front = dialogues.read_block(parser, dialogues.inserted(parser, {0: (0, "")}), turns)
        assert min(front[s] for s in front if s in parser.ends) == want


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = made_up(seed)
    given = spark.createDataFrame(rows, SCHEMA)
    assert found(dialogues.digest(dialogues.repair(dialogues.damage(given), given))) == brute(damaged(rows), [r[0] for r in rows])
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert found(dialogues.digest(dialogues.repair(given))) == brute(plain, [r[0] for r in rows])


def test_long_conversations_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(dialogues, "ROWS", 3)
    rows = made_up(5, n=12, long=200)
    given = spark.createDataFrame(rows, SCHEMA)
    assert found(dialogues.digest(dialogues.repair(given))) == brute([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], [r[0] for r in rows])


def test_ranks_settle_ties_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(dialogues, "ROWS", 2)
    rng = random.Random(9)
    rows = [(0, t, rng.choice(["user", "assistant", "tool"]), f"{t}.") for t in range(300)] + [(1, t, "user", "same.") for t in range(100)]
    given = spark.createDataFrame(rows, SCHEMA)
    assert found(dialogues.digest(dialogues.repair(given))) == brute(rows, [0, 1])


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = c.sql(registry.SQL["op12_conversation_repair"]).df()
    got = registry.QUERIES["op12_conversation_repair"](spark, SF).toPandas()
    order = list(want.columns)
    assert sorted(map(tuple, got[order].values.tolist())) == sorted(map(tuple, want.values.tolist())) and len(want)


def test_repaired_turns_follow_the_pattern(spark):
    turns = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Well"), (1, 3, "assistant", "Good."), (2, 5, "tool", ""), (3, 0, "assistant", "Yes."), (3, 1, "assistant", "No.")]
    out = {}
    for r in dialogues.repair(spark.createDataFrame(turns, SCHEMA)).orderBy("block").collect():
        letters, kept = out.get(r["conv_id"], ("", []))
        out[r["conv_id"]] = letters + r["letters"], kept + [(t["edit"], t["role"], t["text"]) for t in r["turns"]]
    assert out == {1: ("KDDK", [("K", "user", "Hi."), ("K", "assistant", "Good.")]), 2: ("D", []), 3: ("RK", [("R", "user", "Yes."), ("K", "assistant", "No.")])}


def test_clashing_names_and_no_rows(spark):
    turns = [(1, 0, "user", "Hi.", "x", 1), (1, 1, "assistant", "Good.", "y", 2)]
    more = spark.createDataFrame(turns, f"{SCHEMA}, block string, kind int")
    assert found(dialogues.digest(dialogues.repair(dialogues.damage(more), more))) == found(dialogues.digest(dialogues.repair(dialogues.damage(more.select("conv_id", "turn", "role", "text")), more)))
    assert found(dialogues.digest(dialogues.repair(spark.createDataFrame([], SCHEMA)))) == []
