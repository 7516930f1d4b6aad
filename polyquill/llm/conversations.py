"""Repair of conversations by signatures.

Each row of a conversation becomes one letter: what its role begins with and what is wrong with it.  The letters of a conversation
are its signature.  Every distinct signature is solved once: the cheapest edits that leave roles ``(s?(ua)+)?``.  The
solutions, which are audits (one letter an edit), are joined back to the conversations by signature, and the audits are replayed over the rows.

The recurrence runs over suffixes of a signature and is memoised: what a row adds depends on its letter and on how the costs after it differ by
state, of which there are few cases, so a row costs one look-up however long the conversation is.

Rows pass twice through a shuffle by conversation, and are then streamed in order: a task holds one batch of rows and a byte a row of the audit it
replays, never a conversation.  One conversation is one task's stream, as the digest of its text can only be made in order.  A signature that
many conversations share is joined by broadcast: at most ``HOT_PARTS`` short ones have so large a share.

Defined results: a null role or text is one space; a null conv_id is a conversation of its own, whose id is null; null turns come first; rows of one turn are
ordered by role and text; a role that doesn't begin with s, u or a (an empty one too) can't be kept; a conversation without rows has zeros, an empty
audit and the digest of the empty string; among equally cheap edits the audit that is least in ASCII counts; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .shared import HOT_PARTS, cut

#: Costs of the edits, and what a truncated row adds that isn't deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: One letter per beginning of a role (s, u, a, any other) and fault (none, blank, duplicate, truncated).
ROLES, FAULTS = "sua?", ("none", "blank", "duplicate", "truncated")
LETTERS = {(r, f): chr(ord("a") + 4 * i + j) for i, r in enumerate(ROLES) for j, f in enumerate(FAULTS)}
MEANING = {letter: key for key, letter in LETTERS.items()}
#: States of what is left so far: nothing, a system row, ending in user, ending in assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_NEXT = (USER, USER, ASSISTANT, USER)
#: A signature up to this length may be broadcast.
SHORT = 64
SPACE = " \t\n\x0b\x0c\r"


def _settled(base: tuple) -> tuple:
    """Costs by state once inserted rows may stand here too."""
    return tuple(min(base[q], INSERT + base[_NEXT[q]], 2 * INSERT + base[_NEXT[_NEXT[q]]]) for q in range(4))


class Solver:
    """Solves signatures; what it has worked out for a letter before given costs serves all of them."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, tuple], tuple[tuple, int, str]] = {}
        infinite = 1 << 40
        self.end = _settled((0, infinite, infinite, 0))
        self.at_end = self._choices(self.end, None, None, None)

    @staticmethod
    def _choices(costs: tuple, deleted: tuple | None, kept: tuple | None, reroled: tuple | None) -> str:
        """The least letter of a cheapest way in each state; a dot where nothing more is to be done."""
        out = ""
        for q in range(4):
            if deleted is not None and deleted[q] == costs[q]:
                out += "D"
            elif costs[q] == INSERT + costs[_NEXT[q]]:
                out += "I"
            elif kept is not None and kept[q] == costs[q]:
                out += "K"
            else:
                out += "R" if reroled is not None else "."
        return out

    def step(self, letter: str, after: tuple) -> tuple[tuple, int, str]:
        """Costs by state (less their least), that least, and the choices, before a row with the given costs after it."""
        if (letter, after) in self.known:
            return self.known[letter, after]
        role, fault = MEANING[letter]
        infinite = 1 << 40
        deleted = tuple(DELETE + c for c in after)
        kept = reroled = (infinite,) * 4
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            kept = tuple(KEEP + more + after[_AFTER[role, q]] if (role, q) in _AFTER else infinite for q in range(4))
            reroled = tuple(REROLE + more + after[_NEXT[q]] for q in range(4))
        costs = _settled(tuple(map(min, deleted, kept, reroled)))
        least = min(costs)
        found = tuple(c - least for c in costs), least, self._choices(costs, deleted, kept, reroled)
        self.known[letter, after] = found
        return found

    def solve(self, signature: str) -> tuple[int, str]:
        """The cost of the cheapest edits, and their letters."""
        costs, total, choices = self.end, 0, [self.at_end]
        for letter in reversed(signature):
            costs, least, choice = self.step(letter, costs)
            total += least
            choices.append(choice)
        choices.reverse()
        total += costs[START]
        state, out = START, []
        for i, choice in enumerate(choices):
            while choice[state] == "I":
                out.append("I")
                state = _NEXT[state]
            if i < len(signature):
                out.append(edit := choice[state])
                if edit == "R":
                    state = _NEXT[state]
                elif edit == "K":
                    state = _AFTER[MEANING[signature[i]][0], state]
        return total, "".join(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with nulls of role and text as spaces and damage by the hash of conversation and turn; ``gone`` marks rows that are dropped, whose text is null."""
    space = F.lit(" ")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    d = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("_h"))
    h = F.col("_h")
    d = d.withColumn("text", F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace("text", "[.!?]", "")).when(h != 0, F.col("text")))
    d = d.withColumns({"role": F.when(h == 4, F.lit("user")).otherwise(F.col("role")), "gone": h == 0})
    return d.withColumn("_twice", F.explode(F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1)))).drop("_h", "_twice")


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "text")


_TABLE = T.StructType([T.StructField("signature", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))])


def _table_of(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv_id", id_type), *_TABLE.fields])


class _Conversation:
    """What is known of a conversation while its rows stream past."""

    def __init__(self) -> None:
        self.letters: list[np.ndarray] = []
        self.least = self.most = None
        self.turns = 0

    def add(self, letters: np.ndarray, turns: np.ndarray) -> None:
        self.letters.append(letters)
        if len(turns):
            self.turns += int(np.count_nonzero(turns[1:] != turns[:-1])) + int(self.most is None or turns[0] != self.most)
            self.least = int(turns[0]) if self.least is None else self.least
            self.most = int(turns[-1])

    def row(self) -> tuple:
        code = np.concatenate(self.letters) if self.letters else np.zeros(0, np.int64)
        role, fault = code // 4, code % 4
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        pairs = [(0, 1), (1, 2), (2, 1)]
        legal = np.any([(role[:-1] == a) & (role[1:] == b) for a, b in pairs], axis=0) if len(code) > 1 else np.zeros(0, bool)
        return (code + ord("a")).astype(np.uint8).tobytes().decode(), gaps, *(int(np.count_nonzero(fault == k)) for k in (1, 2, 3)), int(np.count_nonzero(~legal))


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text, gone): signature, gaps, blank, duplicate, truncated, illegal."""
    begins = F.substring("role", 1, 1)
    role = F.when(begins == "s", 0).when(begins == "u", 1).when(begins == "a", 2).otherwise(3)
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(last == "", 1).when(F.col("_again"), 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    # the window and the order below both need rows of a conversation together: one shuffle serves them
    d = rows.repartition("conv_id").withColumn("_again", again).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "_again")  # the first of equal rows first
    coded = d.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("gone"), None).otherwise(4 * role + fault).cast("long").alias("code"))
    schema = _table_of(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, done = None, None, []
        for b in batches:
            ids, turn, code = b.column("conv_id").to_pylist(), b.column("turn"), b.column("code").to_numpy(zero_copy_only=False)
            timed = turn.is_valid().to_numpy(zero_copy_only=False)
            turn = turn.fill_null(0).to_numpy(zero_copy_only=False)
            there = ~np.isnan(code.astype(float))
            n = len(ids)
            edges = [i for i in range(n) if i == 0 or ids[i] != ids[i - 1]] + [n]
            for lo, hi in zip(edges, edges[1:]):
                if own is None or ids[lo] != now:
                    if own is not None:
                        done.append((now, *own.row()))
                    now, own = ids[lo], _Conversation()
                here = there[lo:hi]
                own.add(code[lo:hi][here].astype(np.int64), turn[lo:hi][here & timed[lo:hi]])
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema=arrow)
                done = []
        if own is not None:
            done.append((now, *own.row()))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema=arrow)

    arrow = to_arrow_schema(schema)
    return coded.mapInArrow(run, schema)


def solutions(found: DataFrame) -> DataFrame:
    """signature, n (conversations that have it), cost and audit of every distinct signature."""
    distinct = found.groupBy("signature").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for b in batches:
            solved = [solver.solve(s) for s in b.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("signature"), b.column("n"), pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())], ["signature", "n", "cost", "audit"])

    return distinct.mapInArrow(run, "signature string, n long, cost long, audit string")


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit; stored, as it is used for more than one thing."""
    found = cut(signatures(rows))
    solved = cut(solutions(found))
    total = found.count()
    hot = (F.col("n") * HOT_PARTS >= total) & (F.length("signature") <= SHORT)
    often, seldom = F.broadcast(solved.where(hot).drop("n")), solved.where(~hot).drop("n")
    joined = found.join(often, "signature", "left")
    rest = joined.where("cost is null").drop("cost", "audit").join(seldom, "signature")
    return cut(joined.where("cost is not null").unionByName(rest).drop("signature"))


def replayed(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """All edits in order: conv_id, edit, role and text (of deleted rows: as they were); first of each conversation a row with edit null and its audit as text.

    Rows of a conversation stay together and in order, so that what follows can stream them."""
    heads = audited.select("conv_id", F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(rows.where("not gone").select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "text"))
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, at, asked = None, "", 0, "user"
        for b in batches:
            ids, edits, roles, texts = [], [], [], []

            def put(edit, role, text):
                nonlocal asked
                ids.append(now), edits.append(edit), roles.append(role), texts.append(text)
                if edit not in (None, "D"):
                    asked = "assistant" if role[:1] == "u" else "user"

            def inserted():
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    put("I", asked, "")
                    at += 1

            for conv, kind, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "_kind", "role", "text"))):
                if not kind:
                    now, audit, at, asked = conv, text, 0, "user"
                    put(None, None, audit)
                    inserted()
                else:
                    edit = audit[at]
                    at += 1
                    put(edit, asked if edit == "R" else role, text)
                    inserted()
            columns = [pa.array(ids, b.column("conv_id").type), *(pa.array(x, pa.string()) for x in (edits, roles, texts))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "edit", "role", "text"])

    return _in_order(both, "_kind").select("conv_id", "_kind", "role", "text").mapInArrow(run, schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired rows of a table as it is (conv_id, turn, role, text): conv_id, edit, role, text, in order within each partition."""
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(False).alias("gone"))
    return replayed(rows, audits(rows)).where("edit <> 'D'")


def digests(edits: DataFrame) -> DataFrame:
    """Per conversation repaired_sha256 of its ``role:text`` lines, hashed as they stream past."""
    schema = T.StructType([edits.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, some = None, None, False
        for b in batches:
            ids, out = [], []
            for conv, edit, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text"))):
                if edit is None:
                    if state is not None:
                        ids.append(now), out.append(state.hexdigest())
                    now, state, some = conv, hashlib.sha256(), False
                elif edit != "D":
                    state.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                    some = True
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("conv_id").type), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    kind = to_arrow_type(edits.schema["conv_id"].dataType)
    return edits.mapInArrow(run, schema)


def report(conversations: DataFrame) -> DataFrame:
    """Every conversation of the damaged table with its faults, the cheapest edits and the digest of what they leave."""
    rows = damaged(conversations)
    audited = audits(rows)
    hashed = digests(replayed(rows, audited))
    same = audited["conv_id"].eqNullSafe(hashed["conv_id"])
    return audited.join(hashed, same).select(audited["conv_id"], *(F.col(c).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), "audit", "repaired_sha256")
