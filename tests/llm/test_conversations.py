"""Repair of conversations against an enumeration of all edits."""

import hashlib
import itertools
import re
import zlib

import pytest

from polyquill.llm import conversations as C

SHAPE = re.compile(r"(s?(ua)+)?")


def enumerated(rows, most):
    """(cost, audit, kept rows) over all edit sequences of at most so high a cost; rows: (role, text, fault)."""
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        if cost > most or (best is not None and cost > best[0]):
            return
        if i == len(rows) and SHAPE.fullmatch("".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, list(out))
        for role in ("user", "assistant"):
            go(i, cost + 3, audit + "I", [*out, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, cost + more, audit + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 3 + more, audit + "R", [*out, (new, text)])

    go(0, 0, "", [])
    return best


def test_every_short_signature_is_solved_as_by_enumeration():
    solver = C.Solver()
    roles = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}
    for n in range(4):
        for keys in itertools.product([(r, f) for r in "sua?" for f in ("none", "truncated")] + [("u", "blank")], repeat=n):
            rows = [(roles[r], f"t{i}", f) for i, (r, f) in enumerate(keys)]
            cost, audit = solver.solve("".join(C.LETTERS[k] for k in keys))
            assert enumerated(rows, cost)[:2] == (cost, audit), keys


def plain(table):
    """The whole report in plain Python."""
    by = {}
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        kept = by.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        kept += [] if h == 0 else [(turn, role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulty = set(), []
        for _, role, text in rows:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "none" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        first = [r[:1] for _, r, _ in rows]
        cost, audit = C.Solver().solve("".join(C.LETTERS[r[:1] if r[:1] in ("s", "u", "a") else "?", f] for r, _, f in faulty))
        left, at, asked = [], 0, "user"
        for e in audit:
            role, text = faulty[at][:2] if e != "I" else (asked, "")
            at += e != "I"
            if e != "D":
                left.append(f"{role if e == 'K' else asked}:{text}")
                asked = "assistant" if left[-1][0] == "u" else "user"
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == k for _, _, f in faulty) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def table():
    rows = [(c, t, ("system", "user", "assistant", "tool", None, "", "user")[(c * 5 + t * 3) % 7], (f"line {t}.", f"again {c % 3}!", "cut off here", None, "", " \n", "é?\t")[(c + t * t) % 7]) for c in range(60) for t in range(c % 9)]
    rows += [(7, None, "user", "null turn."), (7, None, "assistant", "null turn."), (7, 2, "user", "twice"), (7, 2, "user", "twice"), (None, 1, "user", "x."), (None, None, None, None), (8, 40, "assistant", "y" * 300_000 + ".")]
    return [*rows, *((1000, t, "ua"[t % 2] + "x", f"row {t}.") for t in range(3000))]


def test_report_equals_plain_python(spark, table):
    df = spark.createDataFrame([(*r, 1, 2) for r in table], "conv_id long, turn long, role string, text string, audit int, cost int")
    got = {r.conv_id: tuple(r)[1:] for r in C.report(df.repartition(5)).collect()}
    assert got == plain(table)


def test_repaired_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "late."), (1, 1, "user", "q?"), (1, 2, "user", "q?"), (2, 0, "system", "only.")], "conv_id int, turn int, role string, text string")
    got = [tuple(r) for r in C.repaired(df).where("conv_id = 1").collect()]
    assert [r[2] for r in got if r[1]] in (["user", "assistant"], ["user", "assistant", "user", "assistant"])
    assert C.report(df.where("false")).count() == 0
