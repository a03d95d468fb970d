"""Repair of the structure of conversations by generalised LR parsing.

A conversation is right if its roles' initials are ``(s?(ua)+)?``. The grammar is::

    conversation -> nothing | body | s body        body -> u a | body u a

A row may be kept, given another role, or deleted, and rows may be inserted, each at a cost. All edits are followed at
once: the frontier is a graph-structured stack, whose nodes are told by the LR state on top and the stack below, and nodes
that are equal are merged by the least (cost, audit). An audit is the string of edits so far. All audits of a frontier
have the same number of rows behind them and end with a row's letter, so none begins with another, and to compare
longer ones, the order of those that they began with is enough (``rank``); no audit is copied on the way.

Long conversations are cut into pieces of ``PIECE`` rows. Each is parsed for itself from every stack that it may be
entered with; pieces are then chained, so one conversation is spread over many tasks. Texts take no part in that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

PIECE = 1024
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The LR table: shifts, reductions (left side, number of symbols), gotos and accepting states.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (4, "u"): 6, (5, "u"): 6, (6, "a"): 7}
REDUCE = {3: ("body", 2), 7: ("body", 3)}
GOTO = {(0, "body"): 4, (1, "body"): 5}
ACCEPT = {0, 4, 5}
#: A stack that costs over this more than another can't win: 4 make any stack a whole body, 2 open a turn, 3 delete the s that only an empty stack takes.
HOPELESS = 9

Stack = tuple[int, ...]
Frontier = tuple[tuple[Stack, int, int], ...]  # stack, cost over the least, rank of its audit
START: Frontier = (((0,), 0, 0),)


def shifted(stack: Stack, symbol: str) -> Stack | None:
    """The stack after ``symbol`` and all reductions; None if it can't follow."""
    state = SHIFT.get((stack[-1], symbol))
    if state is None:
        return None
    stack = (*stack, state)
    while stack[-1] in REDUCE:
        name, n = REDUCE[stack[-1]]
        stack = stack[:-n]
        stack = (*stack, GOTO[stack[-1], name])
    return stack


def inserted(frontier: Frontier) -> list[tuple[Stack, int, int, str, int]]:
    """The frontier with what insertions make of it: stack, cost, rank, inserted letters, number of the entry it came from."""
    best = {stack: (cost, rank, "", i) for i, (stack, cost, rank) in enumerate(frontier)}
    fresh = list(best)
    while fresh:
        found = []
        for stack in fresh:
            cost, rank, letters, i = best[stack]
            for symbol in "ua":
                to, way = shifted(stack, symbol), (cost + INSERT, rank, letters + "I", i)
                if to and way[0] <= HOPELESS and (to not in best or way[:3] < best[to][:3]):
                    best[to] = way
                    found.append(to)
        fresh = found
    return [(stack, *way) for stack, way in best.items()]


def stepped(frontier: Frontier, initial: str, forced: bool, truncated: bool) -> tuple[Frontier, int, tuple[tuple[int, str], ...]]:
    """The frontier after one row; what the least cost has grown by; for each new entry the one it came from and its letters."""
    best: dict[Stack, tuple[int, int, str, int]] = {}
    for stack, cost, rank, letters, i in inserted(frontier):
        ways = [(stack, cost + DELETE, "D")]
        if not forced:
            ways += [(shifted(stack, initial), cost + KEEP + TRUNCATED * truncated, "K")]
            ways += [(shifted(stack, symbol), cost + RENAME + TRUNCATED * truncated, "R") for symbol in "ua"]
        for to, spent, letter in ways:
            way = (spent, rank, letters + letter, i)
            if to and (to not in best or way < best[to]):
                best[to] = way
    least = min(way[0] for way in best.values())
    kept = [(stack, way) for stack, way in best.items() if way[0] - least <= HOPELESS]
    order = {audit: k for k, audit in enumerate(sorted({way[1:3] for _, way in kept}))}
    kept.sort(key=lambda x: (order[x[1][1:3]], x[0]))
    return tuple((stack, way[0] - least, order[way[1:3]]) for stack, way in kept), least, tuple((way[3], way[2]) for _, way in kept)


class Parser:
    """Steps that have been worked out once are looked up: few frontiers occur."""

    def __init__(self):
        self.steps: dict = {}

    def parse(self, entry: Stack, rows: list[tuple[str, bool, bool, int]]) -> list[tuple[Stack, int, list[str]]]:
        """Stacks after ``rows`` (initial, must go, truncated, copies), entered with ``entry``: cost and the letters of each row, its copies' deletions behind them."""
        frontier, total, back = ((entry, 0, 0),), 0, []
        for initial, forced, truncated, copies in rows:
            key = (frontier, initial, forced, truncated)
            if key not in self.steps:
                self.steps[key] = stepped(*key)
            frontier, grown, from_ = self.steps[key]
            # Copies must go. All entries pay the same, and an insertion is least behind a deletion, so nothing else changes.
            total += grown + (copies - 1) * DELETE
            back.append(from_)
        out = []
        for i, (stack, cost, _) in enumerate(frontier):
            letters = []
            for from_, row in zip(reversed(back), reversed(rows)):
                i, letter = from_[i]
                letters.append(letter + "D" * (row[3] - 1))
            out.append((stack, total + cost, letters[::-1]))
        return out


def entries() -> list[Stack]:
    """All stacks that can stand between rows."""
    found: list[Stack] = [(0,)]
    for stack in found:
        found += [to for symbol in "sua" if (to := shifted(stack, symbol)) and to not in found]
    return found


STACKS = entries()


class Chain:
    """The frontier between pieces: cost and rank of each stack, and which entry each piece was taken by."""

    def __init__(self):
        self.now: dict[Stack, tuple[int, int]] = {(0,): (0, 0)}
        self.back: list[dict[Stack, tuple[Stack, int]]] = []  # by exit: entry, number of the piece's way

    def piece(self, ways: list[tuple[Stack, Stack, int, str]]) -> None:
        """``ways``: entry, exit, cost, letters."""
        best: dict[Stack, tuple[int, int, str, Stack, int]] = {}
        for k, (entry, to, cost, letters) in enumerate(ways):
            if entry in self.now:
                way = (self.now[entry][0] + cost, self.now[entry][1], letters, entry, k)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
        order = {audit: k for k, audit in enumerate(sorted({way[1:3] for way in best.values()}))}
        self.now = {to: (way[0], order[way[1:3]]) for to, way in best.items()}
        self.back.append({to: (way[3], way[4]) for to, way in best.items()})

    def end(self) -> tuple[int, str, list[int]]:
        """Least cost, letters inserted behind the last row, and the way taken through each piece."""
        least = min(cost for cost, _ in self.now.values())
        frontier = tuple((stack, cost - least, rank) for stack, (cost, rank) in self.now.items())
        cost, _, letters, i = min(way[1:] for way in inserted(frontier) if way[0][-1] in ACCEPT)
        stack, ways = frontier[i][0], []
        for back in reversed(self.back):
            stack, k = back[stack]
            ways.append(k)
        return least + cost, letters, ways[::-1]


_BLANK = r"[\x20\x09-\x0D]"
_WAY = "array<struct<entry:int,exit:int,cost:long,letters:array<string>>>"


def keyed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows as they're repaired: conv, turn, role, text, digest. A null role or text is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"))
    return rows.withColumn("digest", F.unhex(F.md5("text")))


def faults(rows: DataFrame) -> DataFrame:
    """One row for each distinct (conv, turn, role, text) of ``keyed`` rows: ``copies``, initial, blank, repeated (seen in an earlier turn) and truncated."""
    text = F.regexp_replace("text", f"^{_BLANK}+|{_BLANK}+\\z", "")
    own = rows.select("conv", "turn", "role", "digest", (text == "").alias("blank"), (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("truncated"))
    each = own.groupBy("conv", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    when = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    first = each.groupBy("conv", "role", "digest").agg(F.min(when).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "at")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    repeated = F.coalesce(when != F.col("at"), F.lit(False))
    return each.join(first, same, "left").select("conv", "turn", "role", "digest", "copies", F.substring("role", 1, 1).alias("initial"), "blank", repeated.alias("repeated"), "truncated")


def pieces(found: DataFrame, size: int = PIECE) -> DataFrame:
    """``faults`` in the order of their conversations, cut into pieces: ``piece``, ``seq`` and, on a piece's last row, its ``ways``.

    Rows are dealt by ranges of (conv, turn, role, digest), so a long conversation is in many partitions. Saved, as the numbers
    depend on the ranges.
    """
    schema = shared.schema_with(found, ("piece", "long"), ("seq", "long"), ("ways", _WAY), ("illegal", "long"), ("head", "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, no, parser, number = TaskContext.get().partitionId() << 40, 0, Parser(), {s: i for i, s in enumerate(STACKS)}
        held: list[tuple] = []
        started = False

        def close() -> tuple:
            rows = [(r[5] if r[5] in ("s", "u", "a") else "", r[6] or r[7], r[8], r[4]) for r in held]
            from_ = STACKS if not started else STACKS[:1]
            ways = [(number[e], number[to], cost, letters) for e in from_ for to, cost, letters in parser.parse(e, rows)]
            wrong = sum(r[4] - 1 for r in held) + sum(a[5] + b[5] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
            return ways, wrong, held[0][5]

        def out() -> pa.RecordBatch:
            nonlocal held, no
            ways, wrong, head = close()
            n = len(held)
            rows = [(*r, base + no, k, None, None, None) for k, r in enumerate(held)]
            rows[-1] = (*held[-1], base + no, n - 1, [dict(zip(("entry", "exit", "cost", "letters"), w)) for w in ways], wrong, head)
            held, no = [], no + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

        kinds = None
        for batch in batches:
            if kinds is None:
                way = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("letters", pa.list_(pa.string()))]))
                kinds = pa.schema([*batch.schema, pa.field("piece", pa.int64()), pa.field("seq", pa.int64()), pa.field("ways", way), pa.field("illegal", pa.int64()), pa.field("head", pa.string())])
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[-1][0]:
                    yield out()
                    started = True  # what follows begins its conversation; the partition's first piece may go on with one
                elif len(held) == size:
                    yield out()
                    started = False
                held.append(row)
        if held:
            yield out()

    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    return shared.saved(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "turn-pieces")


def chain(cut: DataFrame) -> DataFrame:
    """conv, piece, ``letters`` of each row of the piece, ``tail`` (letters behind the conversation) and, on its last piece, cost and illegal.

    A task holds a few numbers for each piece of the conversation that it's at.
    """
    last = cut.filter("ways is not null").select("conv", "piece", F.transform("ways", lambda w: F.struct(w["entry"].alias("entry"), w["exit"].alias("exit"), w["cost"].alias("cost"), F.array_join(w["letters"], "").alias("letters"))).alias("ways"), "illegal", "head", F.col("initial").alias("foot"))
    kind = cut.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, numbers, wrong, foot = object(), None, [], 0, None

        def out(kinds: pa.DataType) -> pa.RecordBatch:
            cost, tail, ways = state.end()
            n = len(ways)
            gone = [None] * (n - 1)
            return pa.RecordBatch.from_arrays([pa.array([conv] * n, kinds), pa.array(numbers, pa.int64()), pa.array(ways, pa.int32()), pa.array([""] * (n - 1) + [tail]), pa.array([*gone, cost], pa.int64()), pa.array([*gone, wrong], pa.int64())], names=["conv", "number", "way", "tail", "cost", "illegal"])

        kinds = pa.null()
        for batch in batches:
            kinds = batch.schema.field(0).type
            for c, piece, ways, illegal, head, end in zip(*(x.to_pylist() for x in batch.columns)):
                if state is None or c != conv:
                    if state is not None:
                        yield out(kinds)
                    conv, state, numbers, wrong, foot = c, Chain(), [], 0, None
                state.piece([(STACKS[w["entry"]], STACKS[w["exit"]], w["cost"], w["letters"]) for w in ways])
                numbers.append(piece)
                wrong += illegal + (foot is not None and foot + head not in ("su", "ua", "au"))
                foot = end
        if state is not None:
            yield out(kinds)

    ordered = last.repartition("conv").sortWithinPartitions("conv", "piece")
    taken = ordered.mapInArrow(run, f"conv {kind}, number long, way int, tail string, cost long, illegal long")
    of = cut.filter("ways is not null").select("piece", "ways")
    return taken.join(of, F.col("number") == F.col("piece")).select("conv", "piece", F.get("ways", F.col("way"))["letters"].alias("letters"), "tail", "cost", "illegal")


def decided(cut: DataFrame, chained: DataFrame) -> DataFrame:
    """Each row of ``pieces`` with its ``edits`` (letters, insertions before it included; the tail's on the last row of a conversation)."""
    own = chained.select(F.col("piece").alias("p"), "letters", "tail")
    tail = F.when(F.col("seq") == F.size("letters") - 1, F.col("tail")).otherwise("")
    return cut.join(own, F.col("piece") == F.col("p")).select("conv", "turn", "role", "digest", "piece", "seq", F.concat(F.get("letters", F.col("seq").cast("int")), tail).alias("edits"))


def rebuilt(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations, each one's rows together and in order: conv, no (from 0), edit, role, text."""
    d = edits.filter("edits rlike '[^D]'").select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"), "piece", "seq", "edits")
    texts = rows.groupBy("conv", "turn", "role", "digest").agg(F.first("text").alias("text"))
    same = [F.col("conv").eqNullSafe(F.col("c")), F.col("turn").eqNullSafe(F.col("t")), F.col("role") == F.col("r"), F.col("digest") == F.col("d")]
    ordered = texts.join(d, same).select("conv", "piece", "seq", "edits", "role", "text").repartition("conv").sortWithinPartitions("conv", "piece", "seq")
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, no, last = object(), 0, ""
        for batch in batches:
            out = []
            for c, edits, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5))):
                if c != conv or no is None:
                    conv, no, last = c, 0, ""
                for letter in edits:
                    if letter == "D":
                        continue
                    wanted = "assistant" if last == "u" else "user"
                    name, said = (role if letter == "K" else wanted), ("" if letter == "I" else text)
                    out.append((c, no, letter, name, said))
                    no, last = no + 1, name[:1]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:])], names=["conv", "no", "edit", "role", "text"])

    return ordered.mapInArrow(run, f"conv {kind}, no long, edit string, role string, text string")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of each conversation: its rows in order (conv, no, edit, role, text), and its report.

    The report: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. Rows are read by turn (nulls first), ties by role
    and the text's digest; a null role or text is one space, and rows with a null id are one conversation. A row that's blank
    or equal to an earlier one in role and text must go; one whose text has no end mark costs ``TRUNCATED`` if it stays. Of equally cheap
    repairs the one of least audit is taken. Other columns of ``turns`` are left out. The rows of one conversation
    are put together by one task, one after the other.
    """
    shared.tune(turns.sparkSession, 4096)
    rows = keyed(turns, conv, turn, role, text)
    found = faults(rows)
    cut = pieces(found, size)
    chained = shared.saved(chain(cut), "turn-chains")
    fixed = rebuilt(rows, decided(cut, chained))

    judged = cut.withColumn("first", ~F.col("blank") & ~F.col("repeated"))
    n = lambda c: F.sum(c).cast("long")
    counts = judged.groupBy("conv").agg(
        n(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        n(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.col("first").cast("long"))).alias("duplicate"),
        n((F.col("first") & F.col("truncated")).cast("long")).alias("truncated"),
    )
    each = cut.filter("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    said = F.struct("piece", F.concat(F.array_join("letters", ""), "tail").alias("letters"))
    audits = chained.groupBy("conv").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["letters"]), "").alias("audit"))
    on = lambda a, b: a["conv"].eqNullSafe(b["conv"])
    report = counts.join(audits, on(counts, audits)).drop(audits["conv"])
    report = report.join(each, on(report, each), "left").drop(each["conv"])
    return fixed, report.select("conv", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def digests(fixed: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its ``role:text``, newline-joined, of ``repair``'s rows as they come, each conversation's together and in order."""
    kind = fixed.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), None

        def out(done: list, kinds: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kinds), pa.array([h for _, h in done], pa.string())], names=["conv", "repaired_sha256"])

        kinds = pa.null()
        for batch in batches:
            done, kinds = [], batch.schema.field(0).type
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4))):
                if state is None or c != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield out(done, kinds)
        if state is not None:
            yield out([(conv, state.hexdigest())], kinds)

    return fixed.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``conversations`` (nulls: one space), damaged by crc32("conv_id:turn") % 20: 0 dropped, 1 emptied, 2 without end marks, 3 twice, 4 said by the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every original conversation's report and the digest of its repair, after ``damaged``. A conversation without rows left: zeros, empty audit, the empty string's hash.

    Nulls are read as ``damaged`` and ``repair`` say; a null conv_id is one conversation.
    """
    turns = shared.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed, report = repair(damaged(turns))
    every, told = turns.select("conv_id").distinct(), digests(fixed)
    report, told = report.withColumnRenamed("conv", "c1"), told.withColumnRenamed("conv", "c2")
    out = every.join(report, F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(told, F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    none = hashlib.sha256().hexdigest()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
