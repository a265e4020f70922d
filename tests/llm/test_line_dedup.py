"""Line dedup: the filter by itself, whole rounds against a plain version, and undoing insertions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from exprmat.llm import line_dedup
from exprmat.llm.line_dedup import CuckooFilter, dedup, delete, empty_state, insert

SCHEMA = "doc_id long, text string, k1 string, lost int"


def key(line):
    core = line.strip(" \t\n\x0b\x0c\r")
    core = "".join(c.lower() if "A" <= c <= "Z" else c for c in core)
    return core if len(core) >= 10 else None


def plain_dedup(rows):
    first: dict = {}
    holders = defaultdict(set)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")} - {None}:
            holders[k].add(i)
    for k, ids in holders.items():
        if len(ids) > 1:
            first[k] = min(ids, key=lambda i: (i is None, i or 0))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in first or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(4)


def got(state, docs):
    return sorted((tuple(r) for r in dedup(state, docs).collect()), key=repr)


def tables(state):
    return (sorted(map(tuple, state.refs.collect())), sorted((tuple(r) for r in state.posts.collect()), key=repr))


def corpus(seed, n=60):
    rng = random.Random(seed)
    shared = [f"  Shared Line number {k} é\t" for k in range(30)] + ["short", "", "ÀÉ 45678901", "àé 45678901", "x" * 9, "漢字漢字漢字漢字漢字"]
    rows = []
    for i in range(n):
        lines = [rng.choice(shared).swapcase() if rng.random() < 0.2 else rng.choice(shared) if rng.random() < 0.6 else f"own line {i} {rng.random()}"
                 for _ in range(rng.randint(0, 12))]
        rows.append((i, "\n".join(lines)))
    return rows


EDGE = [(None, "a null id holds this line\nand this one"), (None, "a null id holds this line"), (500, "and this one\r\nand this one"), (501, None),
        (502, ""), (503, "twice in one row\ntwice in one row"), (504, "same id other row"), (504, "same id other row"), (505, "\n\n")]


def test_cuckoo_filter_adds_and_takes_out():
    rng = np.random.default_rng(5)
    k = rng.integers(-2**63, 2**63 - 1, (2, 40_000))
    f = CuckooFilter.sized(20_000)
    assert f.insert(k[0, :20_000], k[1, :20_000])
    assert f.has(k[0, :20_000], k[1, :20_000]).all()
    assert f.has(k[0, 20_000:], k[1, 20_000:]).mean() < 0.002
    f.delete(k[0, :5000], k[1, :5000])
    assert f.has(k[0, 5000:20_000], k[1, 5000:20_000]).all()
    assert f.has(k[0, :5000], k[1, :5000]).mean() < 0.002
    assert (f.slots != 0).sum() == 15_000
    full = f.slots.copy()
    assert not f.insert(np.tile(k[0], 2), np.tile(k[1], 2)) and (f.slots == full).all()


@pytest.mark.parametrize("filter_bytes", [line_dedup.FILTER_BYTES, 0])
def test_dedup_equals_plain(spark, monkeypatch, filter_bytes):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", filter_bytes)
    rows = corpus(1) + EDGE
    docs = frame(spark, rows)
    assert got(insert(empty_state(spark), docs), docs) == plain_dedup(rows)


def test_insertions_and_deletions_are_reversible(spark):
    rows = corpus(2, 90)
    parts = [rows[0::3] + EDGE[:1], rows[1::3] + EDGE[2:], rows[2::3]]
    states = [empty_state(spark)]
    for p in parts:
        states.append(insert(states[-1], frame(spark, p)))
    everything = sum(parts, [])
    assert got(states[3], frame(spark, everything)) == plain_dedup(everything)
    back = delete(states[3], frame(spark, parts[1]))
    assert tables(back) == tables(insert(states[1], frame(spark, parts[2])))
    assert got(back, frame(spark, parts[0] + parts[2])) == plain_dedup(parts[0] + parts[2])
    again = insert(back, frame(spark, parts[1]))
    assert tables(again) == tables(states[3])
    assert tables(delete(delete(back, frame(spark, parts[0])), frame(spark, parts[2]))) == ([], [])


def test_filters_hold_the_repeated_keys(spark):
    docs = frame(spark, corpus(3))
    state = insert(empty_state(spark), docs)
    keys = [tuple(r) for r in state.refs.where(line_dedup.repeated()).select("k1", "k2").collect()]
    held = 0
    for s in range(state.shards):
        f = line_dedup._read_filter(state.filters, s)
        own = np.array([k for k in keys if k[0] % state.shards == s], np.int64).reshape(-1, 2)
        if f is not None:
            held += int((f.slots != 0).sum())
            assert f.has(np.ascontiguousarray(own[:, 0]), np.ascontiguousarray(own[:, 1])).all()
    assert held == len(keys)


def test_empty_table(spark):
    docs = frame(spark, EDGE).where("false")
    state = insert(empty_state(spark), docs)
    assert got(state, docs) == [] and tables(state) == ([], [])


def test_query_digest(spark):
    from exprmat.llm.queries import QUERIES

    out = QUERIES["op13_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_dedup([tuple(r) for r in docs]))
    assert sorted(map(tuple, out)) == want
