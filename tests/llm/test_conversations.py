"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from recordlink.llm import conversations

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int"
DIALOGUE = re.compile("(s?(ua)+)?")


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def after_damage(rows):
    """conv -> rows (turn, role, text) after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:32], r[2][:32], digest(r[1], r[2])))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired rows) by Dijkstra over (rows read, roles so far as a prefix of the grammar)."""

    def fits(roles):  # the grammar's prefixes, folded to what matters for what follows
        if roles == "":
            return "0"
        s = roles[0] == "s"
        body = roles[s:]
        return ("s" if s else "0") + ("u" if len(body) % 2 else "p" if body else "") if body == ("ua" * len(roles))[: len(body)] else None

    heap, done = [(0, "", 0, "0", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and (state == "0" or state.endswith("p")):
            return cost, audit, out
        roles = "".join(r[:1] or "-" for r, _ in out)
        options = [("I", r, "", 2, 0) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            options.append(("D", None, None, 3, 1))
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                options += [("K", role, text, more, 1)] + [("R", r, text, 2 + more, 1) for r in ("user", "assistant")]
        for op, role, text, c, step in options:
            new = out if role is None else (*out, (role, text))
            state2 = fits(roles + ((role[:1] or "-") if role is not None else ""))
            if state2 is not None:
                heapq.heappush(heap, (cost + c, audit + op, i + step, state2, new))
    raise AssertionError


def expected(rows):
    out = {}
    for conv, mine in after_damage(rows).items():
        found = faults(mine)
        turns = {t for t, *_ in mine if t is not None}
        cost, audit, repaired = cheapest(mine, found)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, sha)
    return out


def run(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = conversations.query(spark, str(tmp_path)).collect()
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}, len(got)


def random_rows(n, longest, seed=7):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, longest)):
            text = r.choice(["Yes.", "No", "Why?", "", " \n", "Fine! ", f"Word {r.randrange(9)}.", f"other {r.randrange(99)}", None])
            rows.append((conv * 7, turn if r.random() < 0.95 else r.choice([None, turn + 3, 0]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), text))
    return rows


@pytest.mark.parametrize("rows", [4, 1_000])
def test_repair_is_the_cheapest(spark, tmp_path, monkeypatch, rows):
    """Also where every conversation is cut to pieces of a few rows."""
    monkeypatch.setattr(conversations, "PIECE_ROWS", rows)
    data = random_rows(60, 14) + [(None, 1, "user", "Hm."), (None, None, "assistant", "Ha.")] + [(5000, t, "user", "Same.") for t in range(9)] + [(5001, 3, "system", "a" * 100_000)] * 5
    want = expected(data)
    got, n = run(spark, data, tmp_path)
    assert n == len(want) and {k: v for k, v in got.items() if v != want[k]} == {}


def test_a_long_conversation_is_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_ROWS", 50)
    monkeypatch.setattr(conversations, "PIECE_CHARS", 400)
    data = random_rows(1, 2) + [(1, t, ["user", "assistant", "user", "system"][t % 4], f"Turn {t // 3}" + ".!x"[t % 3]) for t in range(600)]
    got, _ = run(spark, data, tmp_path)
    assert got == expected(data)


def test_tables_of_the_grammar():
    g = conversations.graph()
    for word in map("".join, itertools.chain.from_iterable(itertools.product("sua", repeat=k) for k in range(7))):
        top = 0
        for x in word:
            top = top if top is None else g.shift(top, x)
        accepted = top is not None and g.nodes[top][0] in g.tables.accepting
        assert accepted == bool(DIALOGUE.fullmatch(word))


def test_query(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    want = expected(rows)
    got = conversations.query(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id]


def test_no_rows(spark, tmp_path):
    assert run(spark, [], tmp_path) == ({}, 0)
