"""Repair of conversation structure by generalised LR parsing over the grammar of roles, with weighted edits.

A conversation is a row of turns; the first letters of their roles are to form ``(s?(ua)+)?``: maybe a system turn, then
exchanges of user and assistant, or nothing at all. A turn may be kept (0), given the role user or assistant (``REROLE``), or
deleted (``DELETE``, the only choice for blank and repeated turns), and an empty turn may be put in anywhere (``INSERT``); a
truncated turn that is not deleted adds ``TRUNCATED``. The cheapest edits win, of equally cheap ones the string of their
letters (D, I, K, R) that comes first.

The parser reads the turns with all edits at once. Its stacks share their lower parts as nodes of one graph; stacks with
equal tops over equal nodes merge, and the least (cost, letters) stays. Tables of states and actions come from the grammar
(``GRAMMAR``); reductions are made when the next letter asks for them. The grammar is left-recursive, so only a few different
stacks exist, and a stretch of turns can be read from each of them by itself.

So no conversation need fit a task: turns are dealt out by ranges of (conversation, turn), cut into blocks of at most
``ROWS`` turns, and each block is read from every stack that it may begin with. What a block makes of each is then put
together block by block, and the chosen edits are applied to the blocks' texts. First occurrences of repeated turns are
found by an aggregate over (role, digest of the text). The hash of a whole conversation is by nature taken in order: its
blocks' texts stream through one task, one at a time.

Nulls and the like: a null role or text counts as one space, so a null text is blank; turns go by number, nulls first, and at
equal numbers by role and text; rows with a null conv_id are a conversation of their own; a role that begins with no letter
of the grammar can be deleted or given another role, not kept; repeated rows are repeated turns; a conversation without rows
left has no turns, no edits and costs nothing; columns other than conv_id, turn, role and text are not read; an empty table
gives an empty result. A text of any length is one turn.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridols.llm.common import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: Rules of the role grammar; the first one's left side is what a conversation has to be.
GRAMMAR = (("C", ()), ("C", ("E",)), ("C", ("s", "E")), ("E", ("E", "X")), ("E", ("X",)), ("X", ("u", "a")))
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
ROWS, BYTES = 1024, 1 << 20
BLOCK = "conv_id long, block long, begins boolean, turns array<long>, roles array<string>, kinds array<int>, digests array<binary>, texts array<string>"
TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Parser:
    """Stacks by number: what each becomes by reading a letter, and which ones may end here."""

    def __init__(self, grammar=GRAMMAR):
        self.rules = (("", (grammar[0][0],)), *grammar)
        self.names = {left for left, _ in self.rules}
        self.follow = self.followers()
        self.states = [self.closure({(0, 0)})]
        self.stacks: list[tuple[int, int]] = [(0, -1)]  # (state, stack below)
        self.number = {(0, -1): 0}
        self.known: dict[tuple[int, str], tuple[int, ...]] = {}
        letters = sorted({x for _, right in self.rules for x in right} - self.names)
        for at, _ in enumerate(self.stacks):  # grows meanwhile
            for letter in letters:
                self.read(at, letter)
            if at > 1000:
                raise ValueError("the grammar has too many stacks to read stretches by themselves")
        self.letters = set(letters)
        self.between = sorted({0}.union(*self.known.values()))  # the stacks that turns leave behind
        self.ends = {at for at in range(len(self.stacks)) if any(self.states[self.stacks[s][0]] >= {(0, 1)} for s in self.reduced(at, "$"))}

    def closure(self, items):
        items, size = set(items), -1
        while size != len(items):
            size = len(items)
            wanted = {self.rules[r][1][dot] for r, dot in items if dot < len(self.rules[r][1])}
            items |= {(r, 0) for r, (left, _) in enumerate(self.rules) if left in wanted}
        return frozenset(items)

    def followers(self):
        """What may come behind each name; names of this grammar that derive nothing stand alone."""
        first = {n: set() for n in self.names}
        follow = {n: set() for n in self.names}
        follow[""].add("$")
        for _ in range(len(self.rules) ** 2):
            for left, right in self.rules:
                if right:
                    first[left] |= first.get(right[0], {right[0]})
                for x, then in zip(right, [*right[1:], None]):
                    if x in self.names:
                        follow[x] |= follow[left] if then is None else first.get(then, {then})
        return follow

    def push(self, stack: int, x: str):
        items = {(r, dot + 1) for r, dot in self.states[self.stacks[stack][0]] if self.rules[r][1][dot : dot + 1] == (x,)}
        if not items:
            return None
        items = self.closure(items)
        if items not in self.states:
            self.states.append(items)
        node = self.states.index(items), stack
        if node not in self.number:
            self.number[node] = len(self.stacks)
            self.stacks.append(node)
        return self.number[node]

    def reduced(self, stack: int, letter: str) -> set[int]:
        """The stack and all that its reductions before the letter make of it."""
        found, left = {stack}, [stack]
        while left:
            at = left.pop()
            for r, dot in self.states[self.stacks[at][0]]:
                name, right = self.rules[r]
                if dot == len(right) and r and letter in self.follow[name]:
                    below = at
                    for _ in right:
                        below = self.stacks[below][1]
                    new = self.push(below, name)
                    if new is not None and new not in found:
                        found.add(new)
                        left.append(new)
        return found

    def read(self, stack: int, letter: str) -> tuple[int, ...]:
        if (stack, letter) not in self.known:
            pushed = {self.push(s, letter) for s in self.reduced(stack, letter)} - {None}
            self.known[stack, letter] = tuple(sorted(pushed))
        return self.known[stack, letter]


def least(front: dict, stack: int, weight: tuple[int, str]) -> bool:
    """Merge equal stacks by the minimum of (cost, letters)."""
    if stack in front and front[stack] <= weight:
        return False
    front[stack] = weight
    return True


def inserted(parser: Parser, front: dict) -> dict:
    """All stacks that more empty turns lead to."""
    left = sorted(front, key=front.get)
    while left:
        stack = left.pop(0)
        cost, letters = front[stack]
        for letter in ROLES:
            left += [s for s in parser.read(stack, letter) if least(front, s, (cost + INSERT, letters + "I"))]
    return front


def read_block(parser: Parser, front: dict, turns: list[tuple[str, bool, bool]]) -> dict:
    """stack: (cost, letters) after the turns (first letter of the role, whether it must go, whether it is truncated)."""
    for initial, goes, truncated in turns:
        after: dict[int, tuple[int, str]] = {}
        for stack, (cost, letters) in front.items():
            least(after, stack, (cost + DELETE, letters + "D"))
            if not goes:
                stays = cost + (TRUNCATED if truncated else 0)
                if initial in parser.letters:
                    for s in parser.read(stack, initial):
                        least(after, s, (stays + KEEP, letters + "K"))
                for letter in ROLES:
                    for s in parser.read(stack, letter):
                        least(after, s, (stays + REROLE, letters + "R"))
        front = inserted(parser, after)
    return front


def apply_edits(parser: Parser, stack: int, letters: str, roles: list[str], texts: list[str]):
    """(edit, role, text) of what stays of a block that begins with the stack."""
    at = 0
    for edit in letters:
        role, text = (roles[at], texts[at]) if edit != "I" else ("", "")
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = next(ROLES[x] for x in ROLES if parser.read(stack, x))
        (stack,) = parser.read(stack, role[:1])
        yield edit, role, text


class Fold:
    """A conversation's blocks put together: by stack the cheapest way there, as (cost, rank, letters since), and a chain of what each block does on it.

    Letters are compared by rank instead of whole: of ways with the same turns behind them, letters up to the last that
    belongs to a turn are equal or differ at some place, so their order is settled for good and numbered.
    """

    def __init__(self, parser: Parser):
        self.parser, self.ways = parser, None
        self.totals = dict.fromkeys(TOTALS, 0)
        self.low = self.high = self.turn = self.initial = None
        self.turns = 0

    def add(self, block: int, t: dict) -> None:
        after: dict[int, tuple] = {}
        began = {-1: (0, 0, "", None)} if self.ways is None else self.ways
        for stack, (cost, rank, since, chain) in began.items():
            for to, (more, letters) in t["ways"][str(stack)].items():
                way = cost + more, rank, since + letters, (chain, block, stack, letters)
                if int(to) not in after or way[:3] < after[int(to)][:3]:
                    after[int(to)] = way
        order = {k: r for r, k in enumerate(sorted({(w[1], w[2].rstrip("I")) for w in after.values()}))}
        self.ways = {s: (c, order[r, x.rstrip("I")], x[len(x.rstrip("I")) :], chain) for s, (c, r, x, chain) in after.items()}
        for k in ("blank", "duplicate", "truncated", "illegal"):
            self.totals[k] += t[k]
        if t["n"]:
            self.totals["illegal"] += self.initial is not None and self.initial + t["first"] not in LEGAL
            self.initial = t["last"]
        if t["turns"]:
            self.turns += t["turns"] - (self.turn == t["low"])
            self.low = t["low"] if self.low is None else self.low
            self.turn = self.high = t["high"]

    def rows(self):
        """(block, stack that it begins with, letters, totals on the last block)."""
        cost, _, _, chain = min((w for s, w in self.ways.items() if s in self.parser.ends), key=lambda w: w[:3])
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        totals, out = self.totals | {"cost": cost, "gaps": gaps}, []
        while chain:
            chain, block, stack, letters = chain
            out.append((block, max(stack, 0), letters))
        out.reverse()
        return [(*r, [totals[k] for k in TOTALS] if k == len(out) - 1 else None) for k, r in enumerate(out)]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), nulls of role and text as one space."""
    c = F.col
    return conversations.select(c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), F.coalesce(c("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(c("text").cast("string"), F.lit(" ")).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Test damage, chosen by the crc32 of ``conv_id:turn``: of 20 remainders 0 drops a turn, 1 empties it, 2 takes its ends of sentences, 3 repeats it, 4 makes it the user's."""
    space = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    rows = turns_of(conversations).withColumn("d", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20)
    text = F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1)
    role = F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("one")).drop("one")


def make_blocks(turns: DataFrame, every: DataFrame) -> DataFrame:
    """BLOCK: turns in order; kinds are 0 blank, 1 truncated, 2 whole. every: (conv_id) of conversations that have a block in any case."""
    end = F.rtrim("text", F.lit(BLANKS))
    kind = F.when(end == "", 0).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 2).otherwise(1)
    there = turns.select("conv_id", "turn", "role", "text", kind.cast("int").alias("kind"), F.unhex(F.sha2("text", 256)).alias("digest"))
    marks = every.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(-1).alias("kind"), F.lit(None).cast("binary").alias("digest"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = there.unionByName(marks).repartitionByRange(parts, "conv_id", "turn", "role", F.left("text", F.lit(32)))

    def run(batches):
        from pyspark import TaskContext

        made, of, held, size = TaskContext.get().partitionId() << 30, None, [], 0

        def packed(begins):
            nonlocal made
            rows = [h for h in held if h[4] >= 0]
            cols = [of[0], made, begins, *([r[k] for r in rows] for k in (1, 2, 4, 5, 3))]
            made += 1
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cols, kinds, strict=True)], ["conv_id", "block", "begins", "turns", "roles", "kinds", "digests", "texts"])

        begins = False  # the first conversation of a task may have begun in another one
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if of is None or of[0] != r[0] or len(held) == ROWS or size >= BYTES:
                    if held:
                        yield packed(begins)
                        held, size = [], 0
                        begins = of[0] != r[0]
                    of = (r[0],)
                held.append(r)
                size += len(r[3])
        if held:
            yield packed(begins)

    order = ["conv_id", "turn", "role", "text"]
    return materialize(dealt.sortWithinPartitions(*order).select(*order, "kind", "digest").mapInArrow(run, BLOCK), "turns")


def block_edits(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, stack, letters, and on a conversation's last block its totals): the chosen edits of every block."""
    one = F.explode(F.transform(F.arrays_zip("roles", "digests", "kinds"), lambda x, i: F.struct(x["roles"].alias("role"), x["digests"].alias("digest"), x["kinds"].alias("kind"), (F.col("block") * ROWS + i).alias("place"))))
    seen = blocks.select("conv_id", one.alias("x")).where("x.kind <> 0").groupBy("conv_id", "x.role", "x.digest").agg(F.min("x.place").alias("place"))
    fresh = seen.groupBy(F.floor(F.col("place") / ROWS).alias("of")).agg(F.collect_list((F.col("place") % ROWS).cast("int")).alias("fresh"))
    light = blocks.drop("digests", "texts").join(fresh, blocks["block"] == fresh["of"], "left").drop("of")

    def summarise(batches):
        parser = Parser()
        for b in batches:
            out = []
            for r in b.to_pylist():
                new = set(r["fresh"] or [])
                initials, kinds = [x[:1] for x in r["roles"]], r["kinds"]
                again = [k > 0 and at not in new for at, k in enumerate(kinds)]
                turns = [(x, k == 0 or g, k == 1) for x, k, g in zip(initials, kinds, again)]
                ways = {-1: inserted(parser, {0: (0, "")})}
                if not r["begins"]:
                    ways |= {s: {s: (0, "")} for s in parser.between}
                there = [t for t in r["turns"] if t is not None]
                told = {"n": len(kinds), "blank": kinds.count(0), "duplicate": sum(again), "truncated": sum(k == 1 and not g for k, g in zip(kinds, again))}
                told |= {"illegal": sum(x + y not in LEGAL for x, y in zip(initials, initials[1:])), "first": initials[0] if initials else "", "last": initials[-1] if initials else ""}
                told |= {"turns": len(set(there)), "low": min(there, default=0), "high": max(there, default=0)}
                told["ways"] = {s: read_block(parser, front, turns) for s, front in ways.items()}
                out.append((r["conv_id"], r["block"], json.dumps(told)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "block", "told"])

    def fold(batches):
        parser = Parser()
        of, made = None, None
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()))

        def chosen():
            rows = [(of[0], *r) for r in made.rows()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "block", "stack", "letters", "totals"])

        for b in batches:
            for conv, block, told in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if of is None or of[0] != conv:
                    if of:
                        yield chosen()
                    of, made = (conv,), Fold(parser)
                made.add(block, json.loads(told))
        if of:
            yield chosen()

    summed = light.mapInArrow(summarise, "conv_id long, block long, told string")
    return summed.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(fold, "conv_id long, block long, stack int, letters string, totals array<long>")


def repair(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(conv_id, block, letters, totals, turns array of (edit, role, text)): the repaired conversations in blocks, whose numbers give their order.

    turns: (conv_id, turn, role, text); every: (conv_id) of conversations to be listed even if they have no turns. totals are
    on a conversation's last block, in the order of ``TOTALS``.
    """
    rows = turns_of(turns)
    blocks = make_blocks(rows, rows if every is None else every.select(F.col("conv_id").cast("long").alias("conv_id")))
    edits = block_edits(blocks)
    joined = blocks.select(F.col("block").alias("of"), "roles", "texts").join(edits, F.col("of") == F.col("block")).select("conv_id", "block", "stack", "letters", "totals", "roles", "texts")
    turn = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        parser = Parser()
        for b in batches:
            cols = [b.column(k).to_pylist() for k in (2, 3, 5, 6)]
            made = [[{"edit": e, "role": r, "text": t} for e, r, t in apply_edits(parser, *x)] for x in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(made, pa.list_(turn))], ["conv_id", "block", "letters", "totals", "turns"])

    return joined.mapInArrow(run, "conv_id long, block long, letters string, totals array<long>, turns array<struct<edit:string,role:string,text:string>>")


def digest(repaired: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, the totals, audit (letters of its edits), repaired_sha256 (its turns as ``role:text``, a line each)."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")

    def run(batches):
        of, state, letters, begun, totals, out = None, None, [], False, None, []

        def done():
            return (of[0], *totals, "".join(letters), state.hexdigest())

        def batch():
            kinds = (*[pa.int64()] * (1 + len(TOTALS)), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", *TOTALS, "audit", "repaired_sha256"])

        for b in batches:
            for conv, more, told, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if of is None or of[0] != conv:
                    if of:
                        out.append(done())
                    of, state, letters, begun = (conv,), hashlib.sha256(), [], False
                letters.append(more)
                totals = told or totals
                text = text.as_py().encode()
                if text:
                    state.update(b"\n" + text if begun else text)
                    begun = True
            if len(out) >= 4096:
                yield batch()
                out = []
        if of:
            out.append(done())
        if out:
            yield batch()

    told = repaired.select("conv_id", "block", "letters", "totals", lines.alias("lines")).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    columns = ", ".join(f"{k} long" for k in TOTALS)
    return told.select("conv_id", "letters", "totals", "lines").mapInArrow(run, f"conv_id long, {columns}, audit string, repaired_sha256 string")
