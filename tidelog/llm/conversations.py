"""Conversation repair: the cheapest edits that make roles alternate, by the auction algorithm for shortest paths.

A conversation is a lattice: node (row, state) means that the rows before it are edited and the output ends in that state (nothing yet, system, user, assistant).
Arcs are the edits with their integer costs. The auction keeps a price per node and one path from an origin: where the path's last node costs less than its cheapest
way on, its price rises to it and the path contracts; else the path extends by that way. On reaching a node of final price, all prices on the path are final. Every
node is an origin in turn, so all prices end as exact costs to the goal; an edit is cheapest where its arc is tight, and the trace takes the first tight letter.

Rows are sorted by conversation and turn in range partitions. A conversation wholly inside one partition and at most BLOCK rows long is solved there. Others are cut
into blocks, which are solved for each border state, joined by their 4 x 4 costs, and traced apart; then each conversation's blocks are read once in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import slices, staged

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the output: nothing yet, after system, after user, after assistant. The role that may be added next, and the state after it.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = [USER, USER, ASSISTANT, USER]
ROLE = ["", "system", "user", "assistant"]
KEEP = {(START, "s"): SYSTEM} | {(q, ROLE[n][0]): n for q, n in enumerate(NEXT)}
#: What the goal costs from each state at the end, and the inserts that reach it.
END_COST, END_EDITS = [0, 2 * INSERT, INSERT, 0], ["", "II", "I", ""]
#: Rows of a block, rows over which one auction runs, and the price of a border state that is not wanted; a block ends before it holds BLOCK_BYTES and one text more.
BLOCK, STRETCH, FAR = 2048, 16, 10**12
BLOCK_BYTES = 8_000_000


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost) after the test damage, set by crc32(`conv_id:turn`) % 20; null roles, texts, ids and turns read as one space.

    0: the row is lost (it stays as a mark of its conversation, `lost` true); 1: empty text; 2: text without its `.!?`; 3: the row twice; 4: role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"), "kind",
    )
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("*", times.alias("again")).select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("lost"))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, first) of rows: equal rows of a turn folded into one with their number, and whether role and text occur in no earlier turn.

    A conversation's lost rows fold into one mark with copies 0. Both counts are map-side; hot (conversation, role, text) keys are left to the skew join.
    """
    kept = ~F.col("lost")
    only = lambda c: F.when(kept, F.col(c)).alias(c)
    folded = rows.select("conv_id", only("turn"), only("role"), only("text"), kept.cast("long").alias("n")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))
    # length-prefixed, so different (conversation, role, text) never give one key
    key = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text"), 256)
    mark = F.concat(F.lit("lost "), F.coalesce(F.col("conv_id").cast("string"), F.lit("-")))  # not one null key for all marks
    folded = staged(folded.withColumn("key", F.coalesce(key, mark)), "conversation-rows")
    when = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    seen = folded.filter("copies > 0").groupBy("key").agg(F.min(when).alias("earliest"), F.count("*").alias("turns")).filter("turns > 1").select("key", "earliest")
    earliest: Column = F.col("earliest").isNull() | ((F.col("earliest.some") == F.col("turn").isNotNull()) & F.col("earliest.turn").eqNullSafe(F.col("turn")))
    return folded.join(seen, "key", "left").select("conv_id", "turn", "role", "text", "copies", earliest.alias("first"))


class Block:
    """Rows of one conversation in order, with the counts that add up over its blocks."""

    def __init__(self):
        self.roles, self.texts, self.faults = [], [], []  # fault: blank b, duplicate d, truncated t or nothing
        self.turns, self.low, self.high, self.bytes = 0, None, None, 0

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        end = text.rstrip(BLANKS)
        self.faults.append("b" if not end else "d" if not first else "" if end[-1] in ENDS else "t")
        self.roles.append(role)
        self.texts.append(text if self.faults[-1] in "t" else "")  # blank and duplicate rows always go
        self.bytes += len(self.texts[-1]) + 64
        if turn is not None and turn != self.high:  # turns come in order
            self.turns += 1
            self.high = turn
            self.low = turn if self.low is None else self.low

    def illegal(self) -> int:
        return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(self.roles, self.roles[1:]))


def arcs(roles: list[str], faults: list[str], i: int, q: int) -> list[tuple[int, str, int, int]]:
    """(cost, letter, row, state) of the edits open at node (i, q), letters in ASCII order."""
    out = [(DELETE, "D", i + 1, q), (INSERT, "I", i, NEXT[q])]
    if faults[i] not in ("b", "d"):
        extra = TRUNCATED if faults[i] else 0
        if (to := KEEP.get((q, roles[i][:1]))) is not None:
            out.append((extra, "K", i + 1, to))
        out.append((REROLE + extra, "R", i + 1, NEXT[q]))
    return out


def prices(roles: list[str], faults: list[str], border: list[int], stretch: int = STRETCH) -> list[list[int]]:
    """Exact cost of the cheapest way from each node (row, state) to the border after the last row, whose states cost `border`.

    Stretches of rows are solved from the last one back, so that later prices are final. Starting prices are the least border cost that a state
    can still reach; no arc undercuts them, as the auction needs.
    """
    n = len(roles)
    p: list[list[int]] = [[0] * 4 for _ in range(n)] + [list(border)]
    done = [[False] * 4 for _ in range(n)] + [[True] * 4]
    for high in range(n, 0, -stretch):
        low = max(0, high - stretch)
        ends = p[high]
        least = [min(ends), min(ends[1:]), min(ends[2:]), min(ends[2:])]
        for i in range(low, high):
            p[i] = least.copy()
        ways = [[arcs(roles, faults, i, q) for q in range(4)] for i in range(low, high)]
        origins = [(low, q) for q in range(4)] + [(i, q) for i in reversed(range(low, high)) for q in range(4)]
        for origin in origins:
            path = [origin]
            while path:
                i, q = path[-1]
                if done[i][q]:
                    for a, b in path:
                        done[a][b] = True
                    break
                cost, to = min((w[0] + p[w[2]][w[3]], w[2:]) for w in ways[i - low][q])
                if p[i][q] < cost:
                    p[i][q] = cost
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(to)
    return p


def trace(roles: list[str], faults: list[str], p: list[list[int]], q: int) -> tuple[str, int]:
    """(edits, state at the border) of the cheapest way from (0, q): at each node the first letter whose arc is tight."""
    i, letters = 0, []
    while i < len(roles):
        letter, i, q = next((w[1], w[2], w[3]) for w in arcs(roles, faults, i, q) if p[i][q] == w[0] + p[w[2]][w[3]])
        letters.append(letter)
    return "".join(letters), q


def lines(edits: str, roles: list[str], texts: list[str], q: int) -> Iterator[str]:
    """`role:text` of the repaired rows that the edits leave, from state q on."""
    i = 0
    for letter in edits:
        if letter == "I":
            q = NEXT[q]
            yield ROLE[q] + ":"
            continue
        if letter == "K":
            q = KEEP[q, roles[i][:1]]
            yield f"{roles[i]}:{texts[i]}"
        elif letter == "R":
            q = NEXT[q]
            yield f"{ROLE[q]}:{texts[i]}"
        i += 1


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PARTS = "part long, block long, roles array<string>, texts array<string>, faults array<string>, turns long, low long, high long"
NAMES = [f.split()[0] for f in f"{RESULT}, {PARTS}".split(", ")]


def whole(conv: int | None, b: Block) -> tuple:
    p = prices(b.roles, b.faults, END_COST)
    edits, q = trace(b.roles, b.faults, p, START)
    audit = edits + END_EDITS[q]
    text = "\n".join(lines(audit, b.roles, b.texts, START))
    gaps = b.high - b.low + 1 - b.turns if b.turns else 0
    return (conv, gaps, *(b.faults.count(f) for f in "bdt"), b.illegal(), p[0][START], audit, hashlib.sha256(text.encode()).hexdigest())


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def arrow_schema(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def solve(sorted_rows: DataFrame, block: int) -> DataFrame:
    """RESULT and PARTS: one finished row per conversation that lies inside a partition and a block, else one row per block (part is not null)."""
    schema = arrow_schema(f"{RESULT}, {PARTS}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, held, conv, number, apart = TaskContext.get().partitionId(), [], None, None, 0, True

        def unsolved() -> tuple:
            nonlocal number
            number += 1  # over the partition, so (part, block) names one block
            return (conv, *[None] * 8, part, number, held.roles, held.texts, held.faults, held.turns, held.low, held.high)

        # apart: the conversation needs more than one block, or is the partition's first, which may have begun in the one before
        for rows in slices(batches):
            for c, turn, role, text, copies, first in zip(*[x.to_pylist() for x in rows.columns], strict=True):
                if held is None or c != conv:
                    if held is not None:
                        out.append(unsolved() if apart else (*whole(conv, held), *[None] * 8))
                        apart = False
                    conv, held = c, Block()
                for k in range(copies):
                    if len(held.roles) >= block or held.bytes >= BLOCK_BYTES:
                        yield batch([unsolved()], schema)
                        held, apart = Block(), True
                    held.add(turn, role, text, first and k == 0)
            if out:
                yield batch(out, schema)
                out = []
        if held is not None:  # and the last one may go on in the next
            yield batch([unsolved()], schema)

    return sorted_rows.mapInArrow(run, f"{RESULT}, {PARTS}")


def block_costs(blocks: DataFrame) -> DataFrame:
    """blocks with `costs`: 16 numbers, from each state before the block to each after it; FAR or more where there is no way."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                conv, part, number, roles, faults = (x[k].as_py() for x in rows.columns)
                ways = [prices(roles, faults, [0 if q == e else FAR for q in range(4)])[0] for e in range(4)]
                yield batch([(conv, part, number, [ways[e][q] for q in range(4) for e in range(4)])], schema)

    text = "conv_id long, part long, block long, costs array<long>"
    schema = arrow_schema(text)
    return blocks.select("conv_id", "part", "block", "roles", "faults").mapInArrow(run, text)


def borders(costs: DataFrame) -> DataFrame:
    """(part, block, ahead): the cheapest cost to the goal from each state after the block; each conversation's blocks are read from the last one back."""
    text = "part long, block long, ahead array<long>"
    schema = arrow_schema(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ahead = object(), END_COST
        for rows in batches:
            out = []
            for c, part, number, m in zip(*[x.to_pylist() for x in rows.columns], strict=True):
                if c != conv:
                    conv, ahead = c, END_COST
                out.append((part, number, ahead))
                ahead = [min(m[4 * q + e] + ahead[e] for e in range(4)) for q in range(4)]
            if out:
                yield batch(out, schema)

    return costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block")).mapInArrow(run, text)


def traced(blocks: DataFrame) -> DataFrame:
    """Each block with its edits, state after it, cost and repaired text for each state before it, and its counts."""
    text = "conv_id long, part long, block long, counts array<long>, ends array<string>, turns array<long>, edits array<string>, after array<long>, repaired array<string>, cost array<long>"
    schema = arrow_schema(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                conv, part, number, roles, texts, faults, turns, low, high, ahead = (x[k].as_py() for x in rows.columns)
                p = prices(roles, faults, ahead)
                ways = [trace(roles, faults, p, q) for q in range(4)]
                repaired = ["\n".join(lines(e, roles, texts, q)) if any(x in e for x in "IKR") else None for q, (e, _) in enumerate(ways)]
                b = Block()
                b.roles = roles
                counts = [*(faults.count(f) for f in "bdt"), b.illegal(), turns]
                yield batch([(conv, part, number, counts, [r[:1] for r in (roles[0], roles[-1])] if roles else [], [low, high], [e for e, _ in ways], [s for _, s in ways], repaired, p[0])], schema)

    return blocks.select("conv_id", "part", "block", "roles", "texts", "faults", "turns", "low", "high", "ahead").mapInArrow(run, text)


def assembled(blocks: DataFrame) -> DataFrame:
    """RESULT of conversations of several blocks: each is read once in order, holding its edits and a running digest."""
    schema = arrow_schema(RESULT)

    class State:
        def __init__(self, conv):
            self.conv, self.q, self.cost, self.edits, self.digest, self.some = conv, START, None, [], hashlib.sha256(), False
            self.counts, self.low, self.high, self.turns, self.end = [0, 0, 0, 0], None, None, 0, None

        def write(self, text: str) -> None:
            self.digest.update(("\n" if self.some else "").encode() + text.encode())
            self.some = True

        def add(self, counts, ends, turns, edits, after, repaired, cost) -> None:
            q = self.q
            self.cost = cost[q] if self.cost is None else self.cost
            self.edits.append(edits[q])
            if repaired[q] is not None:
                self.write(repaired[q])
            self.q = after[q]
            self.counts = [a + b for a, b in zip(self.counts, counts)]
            if ends:
                self.counts[3] += self.end is not None and self.end + ends[0] not in ("su", "ua", "au")
                self.end = ends[1]
            low, high = turns
            if low is not None:
                self.turns += counts[4] - (low == self.high)
                self.low, self.high = low if self.low is None else self.low, high

        def row(self) -> tuple:
            for line in lines(END_EDITS[self.q], [], [], self.q):
                self.write(line)
            gaps = self.high - self.low + 1 - self.turns if self.turns else 0
            return (self.conv, gaps, *self.counts, self.cost, "".join(self.edits) + END_EDITS[self.q], self.digest.hexdigest())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for rows in batches:
            out = []
            for k in range(rows.num_rows):
                conv, *rest = (x[k].as_py() for x in rows.columns)
                if state is None or conv != state.conv:
                    if state:
                        out.append(state.row())
                    state = State(conv)
                state.add(*rest)
            if out:
                yield batch(out, schema)
        if state:
            yield batch([state.row()], schema)

    cols = ["counts", "ends", "turns", "edits", "after", "repaired", "cost"]
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").select("conv_id", *cols).mapInArrow(run, RESULT)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text, lost), the null one too: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn (null first), then role and text; `lost` rows only name their conversation. Roles count by their first character: others than s, u and a are
    illegal and must be rerolled or deleted. A row that is blank, or repeats an earlier role and text, must be deleted. Of equally cheap repairs, the audit that is
    least as ASCII text is taken. A conversation without rows has zeros, an empty audit and the digest of nothing; no rows give no rows. Other columns are not read.

    The digest of a whole repaired conversation is one running hash, so its blocks are read in order by one task, a block at a time; everything else
    about long conversations is spread over blocks of `block` rows.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    ready = marked(rows).repartitionByRange(n, *order).sortWithinPartitions(*order).select(*order, "copies", "first")
    solved = staged(solve(ready, block), "conversations")
    blocks = solved.filter("part is not null")
    ahead = borders(staged(block_costs(blocks), "conversation-costs"))
    split = assembled(staged(traced(blocks.join(ahead, ["part", "block"])), "conversation-blocks"))
    return solved.filter("part is null").select(*NAMES[:9]).unionByName(split)
