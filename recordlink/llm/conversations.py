"""Conversation structure repair: generalised LR over the role grammar, with weighted edits.

The grammar of role initials is compiled to LR(0) tables. A parse keeps a graph of stacks: a top is a state with a link to the node below it, equal nodes
are one node, and tops that meet keep the minimum (cost, audit). Each row may be kept, given another role or deleted, and turns may be inserted between rows; reductions
are made as soon as a state allows them. Since the grammar is left-recursive the graph has a handful of nodes, however long the conversation is.

Rows are range-partitioned by conversation, turn, role and text (their beginnings and a digest), so that a long conversation is spread over tasks. What a task has whole it repairs at once. Of a conversation that a task's
border cuts, or that has more than ``PIECE_ROWS`` rows, each piece is parsed from every top that can stand at its start; the minima of its pieces are then composed in order (they are few
and without texts), and only these pieces are edited in a second pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlink.llm import common

SPACES = " \t\n\x0b\f\r"
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows and characters of a piece that one task holds at once.
PIECE_ROWS, PIECE_CHARS = 1_000, 4_000_000
#: ``dialogue -> nothing | turns | s turns``, ``turns -> u a | turns u a``.
GRAMMAR = (("D", ()), ("D", ("T",)), ("D", ("s", "T")), ("T", ("u", "a")), ("T", ("T", "u", "a")))


class Tables:
    """LR(0) states of a grammar whose first rule names its start: shifts, gotos, and the reduction of a state that has only one complete item."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar, start = grammar, grammar[0][0]
        heads = {h for h, _ in grammar}

        def closure(items: frozenset) -> frozenset:
            items = set(items)
            while True:
                after = {grammar[r][1][d] for r, d in items if d < len(grammar[r][1])}
                more = {(r, 0) for r, (h, _) in enumerate(grammar) if h in after} - items
                if not more:
                    return frozenset(items)
                items |= more

        first = closure(frozenset((r, 0) for r, (h, _) in enumerate(grammar) if h == start))
        self.states, self.move, todo = {first: 0}, {}, [first]
        while todo:
            items = todo.pop()
            for x in sorted({grammar[r][1][d] for r, d in items if d < len(grammar[r][1])}):
                to = closure(frozenset((r, d + 1) for r, d in items if grammar[r][1][d : d + 1] == (x,)))
                if to not in self.states:
                    self.states[to] = len(self.states)
                    todo.append(to)
                self.move[self.states[items], x] = self.states[to]
        complete = {n: [r for r, d in items if d == len(grammar[r][1])] for items, n in self.states.items()}
        self.reduce = {n: rs[0] for n, rs in complete.items() if rs and grammar[rs[0]][0] != start}
        self.accepting = {n for n, rs in complete.items() if any(grammar[r][0] == start for r in rs)}
        self.terminals = sorted({x for _, body in grammar for x in body} - heads)


class Graph:
    """The graph of stacks: node -> (state, node below). Nodes are made when first met; equal ones are one."""

    def __init__(self, tables: Tables):
        self.tables, self.nodes, self.at, self.memo = tables, [(0, -1)], {(0, -1): 0}, {}
        self.tops: list[int] = []

    def node(self, state: int, below: int) -> int:
        if (state, below) not in self.at:
            self.at[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.at[state, below]

    def shift(self, top: int, symbol: str) -> int | None:
        """The top after a symbol and all reductions; None if the grammar forbids it."""
        state = self.tables.move.get((self.nodes[top][0], symbol))
        if state is None:
            return None
        top = self.node(state, top)
        while (rule := self.tables.reduce.get(self.nodes[top][0])) is not None:
            head, body = self.tables.grammar[rule]
            for _ in body:
                top = self.nodes[top][1]
            top = self.node(self.tables.move[self.nodes[top][0], head], top)
        return top

    def inserted(self, tops: dict) -> dict:
        """``tops`` and all that insertions reach from them, each with its minimum (cost, audit)."""
        tops, todo = dict(tops), sorted(tops, key=tops.get)
        while todo:
            top = todo.pop(0)
            cost, audit = tops[top]
            for x in ROLES:
                to = self.shift(top, x)
                if to is not None and (to not in tops or (cost + INSERT, audit + "I") < tops[to]):
                    tops[to] = (cost + INSERT, audit + "I")
                    todo.append(to)
        return tops

    def row(self, top: int, initial: str, must_go: bool, truncated: bool) -> list:
        """(top, cost, audit) after one row and the insertions behind it; kept, since few kinds of rows exist."""
        kind = (top, initial if initial in self.tables.terminals else "", must_go, truncated)
        if kind not in self.memo:
            out: dict = {top: (DELETE, "D")}
            if not must_go:
                for cost, audit, symbols in ((0, "K", kind[1]), (REROLE, "R", ROLES)):
                    for to in filter(lambda t: t is not None, (self.shift(top, x) for x in symbols)):
                        out[to] = min(out.get(to, (9, "")), (cost + TRUNCATED * truncated, audit))
            self.memo[kind] = [(t, *v) for t, v in self.inserted(out).items()]
        return self.memo[kind]

    def parse(self, tops: dict, rows: Iterable[tuple[str, bool, bool]]) -> dict:
        """Tops with their minima after ``rows`` (initial, must be deleted, truncated)."""
        for kind in rows:
            new: dict = {}
            for top, (cost, audit) in tops.items():
                for to, c, a in self.row(top, *kind):
                    if to not in new or (cost + c, audit + a) < new[to]:
                        new[to] = (cost + c, audit + a)
            tops = new
        return tops

    def start(self) -> dict:
        return self.inserted({0: (0, "")})

    def best(self, tops: dict) -> tuple[int, str, int]:
        """(cost, audit, top) of the cheapest tops that end a dialogue."""
        return min((*v, t) for t, v in tops.items() if self.nodes[t][0] in self.tables.accepting)

    def led(self, top: int) -> bool:
        """Whether the dialogue began with a kept system turn."""
        while self.nodes[top][1] > 0:
            top = self.nodes[top][1]
        return self.nodes[top][0] == self.tables.move.get((0, "s"))


@lru_cache(1)
def graph() -> Graph:
    """A graph in which every node is made in one order, so that tasks mean the same by a node's number."""
    g = Graph(Tables())
    known, todo = {0}, [0]
    while todo:
        top = todo.pop(0)
        for x in g.tables.terminals:
            to = g.shift(top, x)
            if to is not None and to not in known:
                known.add(to)
                todo.append(to)
    g.tops = sorted(known)
    return g


def edited(roles: list, texts: list, audit: str, outputs: int) -> list[tuple[str, str]]:
    """(role, text) of the rows after the edits; ``outputs``: turns before, without a system turn."""
    out, i = [], 0
    for op in audit:
        if op in "IR":
            out.append((ROLES["ua"[(outputs + len(out)) % 2]], "" if op == "I" else texts[i]))
        elif op == "K":
            out.append((roles[i], texts[i]))
        i += op != "I"
    return out


def joined(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in rows)


LONG, INT, TEXT = pa.int64(), pa.int32(), pa.string()
MINIMUM = pa.struct([("a", INT), ("b", INT), ("cost", LONG), ("audit", TEXT)])
PIECE = pa.schema(
    [("conv_id", LONG), ("part", INT), ("piece", INT), ("whole", pa.bool_()), ("n", INT), ("blank", LONG), ("duplicate", LONG), ("truncated", LONG), ("illegal", LONG), ("first", TEXT), ("last", TEXT)]
    + [("least_turn", LONG), ("most_turn", LONG), ("turns", LONG), ("cost", LONG), ("audit", TEXT), ("transcript", TEXT), ("roles", pa.list_(TEXT)), ("texts", pa.list_(TEXT)), ("minima", pa.list_(MINIMUM))]
)
CHAIN = pa.schema(
    [("part", INT), ("piece", INT), ("outputs", LONG), ("piece_audit", TEXT), ("conv_id", LONG), ("gaps", LONG)]
    + [("blank", LONG), ("duplicate", LONG), ("truncated", LONG), ("illegal", LONG), ("cost", LONG), ("audit", TEXT)]
)


def ddl(schema: pa.Schema) -> str:
    """The schema as Spark writes it."""
    names = {LONG: "long", INT: "int", TEXT: "string", pa.bool_(): "boolean", pa.list_(TEXT): "array<string>", pa.list_(MINIMUM): "array<struct<a:int,b:int,cost:long,audit:string>>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def rows_of(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in columns])


def _piece(g: Graph, conv, part: int, number: int, rows: list[tuple], whole: bool) -> tuple:
    """One row of ``PIECE`` for rows (turn, role, text, fault); fault None marks a row that the conversation lost."""
    live = [r for r in rows if r[3] is not None]
    kinds = [(r[1][:1], r[3] in ("blank", "duplicate"), r[3] == "truncated") for r in live]
    turns = [r[0] for r in live if r[0] is not None]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    faults = [sum(r[3] == f for r in live) for f in ("blank", "duplicate", "truncated")]
    head = (conv, part, number, whole, len(live), *faults, illegal, kinds[0][0] if kinds else None, kinds[-1][0] if kinds else None, min(turns, default=None), max(turns, default=None), len(set(turns)))
    if whole:
        cost, audit, top = g.best(g.parse(g.start(), kinds)) if live else (0, "", 0)
        text = joined(edited([r[1] for r in live], [r[2] for r in live], audit, -g.led(top)))
        return (*head, cost, audit, text, None, None, None)
    minima = [{"a": a, "b": b, "cost": c, "audit": s} for a in g.tops for b, (c, s) in g.parse({a: (0, "")}, kinds).items()]
    return (*head, None, None, None, [r[1] for r in live], [r[2] for r in live], minima)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one partition, in order. The first and the last conversation may go on in another partition, so they are never whole here."""
    g, part = graph(), TaskContext.get().partitionId()
    out, size, held, number, first = [], 0, None, 0, True  # held: the last conversation, of which it is not known yet whether the partition ends with it
    for conv, group in groupby(rows_of(batches, ["conv_id", "turn", "role", "text", "fault"]), key=lambda r: r[0]):
        if held:
            out.append(_piece(g, *held))
        some, chars, cut = [], 0, first
        for _, *r in group:
            if len(some) >= PIECE_ROWS or some and chars + len(r[2]) > PIECE_CHARS:
                out.append(_piece(g, conv, part, number, some, False))
                number, some, chars, cut = number + 1, [], 0, True
            some.append(r)
            chars, size = chars + len(r[2]), size + len(r[2])
            if len(out) >= 500 or out and size >= 4 * PIECE_CHARS:
                yield batch(out, PIECE)
                out, size = [], 0
        held, number, first = (conv, part, number, some, not cut), number + 1, False
    if held:
        yield batch([*out, _piece(g, *held[:4], False)], PIECE)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Composes the minima of each conversation's pieces in order. What all tops' audits have in common is settled and leaves them, so that only their ends are compared."""
    g = graph()
    columns = ["conv_id", "part", "piece", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "least_turn", "most_turn", "turns", "minima"]
    for conv, group in groupby(rows_of(batches, columns), key=lambda r: r[0]):
        tops, settled, pieces = g.start(), [], []
        sums, before, turns, least, most = [0, 0, 0, 0], None, 0, None, None
        for _, part, piece, n, *counts, head, tail, low_turn, high_turn, some_turns, minima in group:
            pieces.append((part, piece, n))
            new: dict = {}
            for m in minima:
                if m["a"] in tops:
                    cost, audit = tops[m["a"]]
                    if m["b"] not in new or (cost + m["cost"], audit + m["audit"]) < new[m["b"]]:
                        new[m["b"]] = (cost + m["cost"], audit + m["audit"])
            low, high = min(a for _, a in new.values()), max(a for _, a in new.values())
            k = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
            settled.append(low[:k])
            tops = {t: (c, a[k:]) for t, (c, a) in new.items()}
            sums = [x + y for x, y in zip(sums, counts)]
            if n:
                sums[3] += before is not None and before + head not in ("su", "ua", "au")
                before = tail
            if low_turn is not None:
                turns += some_turns - (most == low_turn)
                least, most = low_turn if least is None else least, high_turn
        cost, audit, top = g.best(tops)
        audit = "".join(settled) + audit
        if not any(n for *_, n in pieces):
            cost, audit, top = 0, "", 0
        gaps = most - least + 1 - turns if least is not None else 0
        out, at, done = [], 0, -g.led(top)
        for i, (part, piece, n) in enumerate(pieces):  # each piece's edits: as many as it has rows, and the insertions around them
            end = at
            while end < len(audit) and (n > 0 or audit[end] == "I"):
                n -= audit[end] != "I"
                end += 1
            edits = audit[at:end]
            out.append((part, piece, done, edits, *((conv, gaps, *sums, cost, audit) if i == 0 else (None,) * 8)))
            done, at = done + len(edits) - edits.count("D"), end
            if len(out) >= 500:
                yield batch(out, CHAIN)
                out = []
        if out:
            yield batch(out, CHAIN)


def _edited(roles: pd.Series, texts: pd.Series, audit: pd.Series, outputs: pd.Series) -> pd.Series:
    return pd.Series([joined(edited(list(r), list(t), a, int(o))) for r, t, a, o in zip(roles, texts, audit, outputs)], dtype=object)


def repair(rows: DataFrame, lost: Column | None = None, copy: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, transcripts) of ``rows`` (conv_id, turn, role, text).

    reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row per conversation. transcripts: conv_id, part, piece, transcript: the repaired ``role:text`` lines of each
    piece; pieces of a conversation follow each other by (part, piece), and one without lines is empty.
    ``lost`` marks rows that only name their conversation (one of which nothing is left gets zeros); ``copy`` marks rows that repeat another one.
    Rows stand by turn (nulls first), ties by the beginnings of role and text, then by their digest; null roles and texts count as one space. A null conv_id is a conversation like any other. Repeated rows are duplicates.
    Other columns are not read, so their names cannot clash. Empty input gives empty tables.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    marks = [F.lit(False) if m is None else m for m in (lost, copy)]
    df = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), marks[0].alias("lost"), marks[1].alias("copy"))
    df = df.withColumn("same", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).withColumn("id", F.monotonically_increasing_id())
    # a row is a duplicate unless it is its conversation's first with this role and text; the few groups of several rows are looked up
    groups = df.filter("not lost and not copy").groupBy("conv_id", "same").agg(F.count("*").alias("n"), F.min(F.struct("turn", "id"))["id"].alias("first"))
    many = common.written(groups.filter("n > 1").select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first"), "conversation-repeats")
    df = df.join(common.small(many), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    blank = F.rtrim("text", F.lit(SPACES)) == ""
    truncated = ~F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1).isin(".", "!", "?")
    fault = F.when(F.col("lost"), None).when(blank, "blank").when(F.col("copy") | (F.col("first") != F.col("id")), "duplicate").when(truncated, "truncated").otherwise("")
    keys = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 32), F.substring("text", 1, 32), F.col("same"), F.col("id")]  # short, since bounds of ranges are sampled
    order = [f"k{i}" for i in range(len(keys))]
    ranged = df.select("conv_id", "turn", "role", "text", fault.alias("fault"), *[k.alias(o) for k, o in zip(keys, order)]).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = common.written(ranged.mapInArrow(_pieces, ddl(PIECE)), "conversation-pieces")
    report = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = pieces.filter("whole").withColumn("gaps", F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0)))
    cut = pieces.filter("not whole").drop("roles", "texts", "transcript", "audit", "cost", "whole")
    chained = common.written(cut.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_chained, ddl(CHAIN)), "conversation-chains")
    reports = whole.select(*report).unionByName(chained.filter("audit is not null").select(*report))
    edits = chained.select(F.col("part").alias("p"), F.col("piece").alias("k"), "outputs", "piece_audit")
    rest = pieces.filter("not whole").select("conv_id", "part", "piece", "roles", "texts").join(edits, (F.col("part") == F.col("p")) & (F.col("piece") == F.col("k")))
    told = rest.select("conv_id", "part", "piece", F.pandas_udf(_edited, "string")("roles", "texts", "piece_audit", "outputs").alias("transcript"))
    return reports, whole.select("conv_id", "part", "piece", "transcript").unionByName(told)


DIGEST = pa.schema([("conv_id", LONG), ("repaired_sha256", TEXT)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's transcript, piece after piece."""
    for conv, group in groupby(rows_of(batches, ["conv_id", "transcript"]), key=lambda r: r[0]):
        h, begun = hashlib.sha256(), False
        for _, text in group:
            if text:
                h.update((("\n" if begun else "") + text).encode())
                begun = True
        yield batch([(conv, h.hexdigest())], DIGEST)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: crc32 of ``conv_id:turn`` modulo 20 drops (marked ``lost``), empties, unstops, repeats (marked ``copy``) or turns a row to user."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(value("text"), ".!?", "")).otherwise(value("text"))
    role = F.when(kind == 4, "user").otherwise(value("role"))
    df = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("lost"), F.explode(F.when(kind == 3, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("copy"))
    return df


def query(spark, sf_dir: str) -> DataFrame:
    df = damaged(common.table(spark, sf_dir, "conversations"))
    reports, told = repair(df, F.col("lost"), F.col("copy"))
    told = common.written(told, "conversation-transcripts")
    several = common.small(common.written(told.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("c")), "conversations-cut"))
    is_cut = F.col("conv_id").eqNullSafe(F.col("c"))
    one = told.join(several, is_cut, "left_anti").select("conv_id", F.sha2("transcript", 256).alias("repaired_sha256"))
    more = told.join(several, is_cut, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_digests, ddl(DIGEST))
    digest = one.unionByName(more).withColumnRenamed("conv_id", "d")
    return reports.join(digest, F.col("conv_id").eqNullSafe(F.col("d"))).drop("d")
