"""Conversation repair against a cheapest-path search over whole audits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from exprmat.llm import conversation
from exprmat.llm.conversation import conversation_digests, repair, span_cell
from exprmat.llm.queries import QUERIES, damaged

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(who, what):
    """Least cost, then least audit, by Dijkstra over (cost, audit)."""
    heap, best, done = [(0, "", 0, "")], None, set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if (i, state, audit) in done:
            continue
        done.add((i, state, audit))
        if i == len(who) and state in ("", "a") and (best is None or (cost, audit) < best):
            best = (cost, audit)
        ways = [(cost + 2, audit + "I", i, role) for role in "ua" if (state, role) in NEXT]
        if i < len(who):
            ways.append((cost + 3, audit + "D", i + 1, state))
            if what[i] in "kt":
                more = what[i] == "t"
                ways += [(cost + 2 + more, audit + "R", i + 1, role) for role in "ua" if (state, role) in NEXT]
                if (state, who[i]) in NEXT:
                    ways.append((cost + more, audit + "K", i + 1, who[i]))
        for w in ways:
            if w[1].count("I") <= len(who) + 2:
                heapq.heappush(heap, w)
    return best


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation, nulls already one blank."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, what = set(), ""
    for _, role, text in rows:
        core = text.strip(conversation.BLANKS)
        what += "b" if not core else "d" if (role, text) in seen else "k" if core[-1] in ".!?" else "t"
        seen.add((role, text))
    turns = {r[0] for r in rows} - {None}
    who = [r[1][:1] for r in rows]
    cost, audit = cheapest(who, what)
    out, left = [], iter(rows)
    for x in audit:
        want = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if x == "I":
            out.append((want, ""))
            continue
        _, role, text = next(left)
        if x != "D":
            out.append((role if x == "K" else want, text))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, what.count("b"), what.count("d"), what.count("t"),
            sum(x + y not in ("su", "ua", "au") for x, y in zip(who, who[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def repaired(df):
    out = repair(df)
    digests = {r.conv: r.digest for r in conversation_digests(out.rows).collect()}
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv, hashlib.sha256(b"").hexdigest()))
            for r in out.conversations.collect()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suao"), st.sampled_from("kktbd")), min_size=1, max_size=7))
def test_cells_hold_the_cheapest_audits(rows):
    who, what = "".join(r[0] for r in rows), "".join(r[1] for r in rows)
    cell = span_cell(who, what)
    assert min(cell[k] for k in ((0, 0), (0, 3)) if k in cell) == cheapest(who, what)


def random_conversations(seed, n=40, most=9):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", " "])
            text = rng.choice(["Hi.", "Hi.", "ok", "Why?  ", " \n", "", "é!\t"]) + rng.choice(["", "", str(rng.random()) + "."])
            rows.append((conv, rng.choice([turn * 2, turn * 2, None]) if rng.random() < 0.1 else turn + (turn > 3), role, text))
    return rows


@pytest.mark.parametrize(("block", "fan"), [(9, 3), (1, 1), (0, 2)])
def test_repair_equals_search(spark, monkeypatch, block, fan):
    monkeypatch.setattr(conversation, "BLOCK_BITS", block)
    monkeypatch.setattr(conversation, "FAN_BITS", fan)
    rows = random_conversations(block)
    seen, once = set(), []
    for r in rows:  # rows with equal turns have no fixed order in the plain version
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            once.append(r)
    want: dict = {}
    for conv, turn, role, text in once:
        want.setdefault(conv, []).append((turn, role, text))
    df = spark.createDataFrame([(*r, 1, "x") for r in once], "conv_id long, turn long, role string, text string, pos int, who string").repartition(5)
    assert repaired(df) == {c: plain_repair(v) for c, v in want.items()}


def test_one_long_conversation_spans_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation, "BLOCK_BITS", 3)
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"line {t}.") for t in range(600)]
    got = repaired(spark.createDataFrame(rows, "conv_id int, turn long, role string, text string"))
    who = "".join(r[2][0] for r in rows)
    cell = span_cell(who, "k" * 600)
    assert got[1][5:7] == min(cell[0, 3], cell.get((0, 0), (10**9, "")))


def test_nulls_repeats_and_empty(spark):
    schema = "conv_id string, turn long, role string, text string"
    rows = [("a", None, None, None), ("a", 1, "user", "Hi."), ("a", 1, "user", "Hi."), ("a", 1, "user", "Hi."), ("b", None, "assistant", "No")]
    got = repaired(spark.createDataFrame(rows, schema))
    assert got["a"][:7] == (0, 1, 2, 0, 3, 11, "DKDDI")
    assert got["b"][:7] == (0, 0, 0, 1, 0, 3, "D")
    assert repaired(spark.createDataFrame([], schema)) == {}


def test_query_equals_plain(spark, tmp_path):
    rows = [(c, t, r, x) for c, t, r, x in random_conversations(3, 60) if t is not None] + [(7, 90, None, None), (None, 91, "user", None)]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want: dict = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            want[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    got = QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {c: plain_repair(v) for c, v in want.items()}
    assert damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet").where("false")).count() == 0
