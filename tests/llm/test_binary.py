"""Simple-8b coding, token shards, WARC archives and exact top-k against brute force."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from exprmat.llm import simple8b
from exprmat.llm.token_ids import Encoder, pack_shard, read_token_ids, unpack_shard, write_token_ids
from exprmat.llm.topk import exact_topk
from exprmat.llm.warc import format_record, parse_record, read_warc, write_warc

EDGE_TEXTS = [
    "", " ", "a  b", "a \n b", "\n\n x", "it's  we'll 's  's\n's o'clock ''s !'s x'S I've'd 'll", "don't's", "12ab 34 !!? ab12",
    "tail   ", "a\tb\r\nc", "é ñ … — “q” 漢字 x", "a<|endoftext|>b", "x'", "x'l l", " 's", "x\n's", "!\n\n!", "$$$ ###a",
    "\U0001F600 hi", "²³ ½٣", "​x y\x1cz",
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50_000) | st.just(0), max_size=3000), st.sampled_from([1, 7, 64, 1024]))
def test_simple8b_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, offsets, escapes = simple8b.encode(v, block)
    assert simple8b.decode(words, offsets, escapes, len(v), block).tolist() == values


def test_simple8b_packs_and_escapes():
    words, _, escapes = simple8b.encode(np.array([1] * 60, np.uint64))
    assert len(words) == 1 and not len(escapes)
    _, _, escapes = simple8b.encode(np.array([2**60 - 1, 2**60], np.uint64))
    assert escapes.tolist() == [2**60]


def test_shard_round_trip():
    ids = np.arange(5000, dtype=np.uint32) * 7
    d, n, back = unpack_shard(pack_shard([None, 3, 9], np.array([0, 4000, 1000]), ids))
    assert d == [None, 3, 9] and n.tolist() == [0, 4000, 1000] and (back == ids).all()


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'slreveé 1.!\n\t\r漢 \x85\U0001F600")), max_size=30), max_size=6))
def test_encoder_equals_library(tokenizer, texts):
    e = Encoder(tokenizer)
    ids, sizes = e.encode([*texts, *EDGE_TEXTS])
    for text, part in zip([*texts, *EDGE_TEXTS], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert part.tolist() == [*e.library.encode(text, add_special_tokens=False).ids, 0]


def test_token_files(spark, tokenizer):
    long = "word " * 30_000
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(None, "no id"), (500, None), (3, "twice"), (3, "twice"), (400, long)]
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in rows], "doc_id long, text string, shard int, id string")
    got = read_token_ids(spark, write_token_ids(docs, tokenizer, shard_bytes=400)).collect()
    library = Encoder(tokenizer).library
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    empty = docs.where("false")
    assert read_token_ids(spark, write_token_ids(empty, tokenizer)).count() == 0


def test_warc_record_round_trip():
    body = "é\r\n\r\nx".encode()
    fields, back = parse_record(format_record(7, "http://x/ä b%\n", body, "D", None))
    assert back == body and fields["WARC-Type"] == "response" and fields["Content-Length"]


def test_warc_archive(spark):
    html = [(1, "http://a/", "<p>x"), (2, "http://a/2", "<p>x"), (3, None, None), (4, "http://b/ä b", ""), (5, "u", "é" * 50_000),
            (6, "u", "é" * 50_000), (2, "http://a/2", "<p>x"), (None, "n", "<p>x"), (9, "n", "only")]
    pages = spark.createDataFrame([(*r, b"clash", 1) for r in html], "page_id long, url string, html string, body binary, sha int")
    index = write_warc(pages, file_bytes=2000)
    assert index.select("file").distinct().count() > 1
    got = read_warc(index).collect()
    first = {}
    for i, _, h in sorted(html, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault((h or "").encode(), i)
    want = []
    for i, u, h in html:
        b = (h or "").encode()
        ref = None if first[b] == i else first[b]
        want.append((i, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref,
                     b if ref is None else None))
    key = lambda r: str(r[:6])
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    some = read_warc(index.where("page_id = 5")).collect()
    assert len(some) == 1 and bytes(some[0].payload) == ("é" * 50_000).encode()
    assert write_warc(pages.where("false")).count() == 0
    small = write_warc(pages, min_bytes=5).where("page_id = 2").first()
    assert small.record_type == "response"


def test_topk_equals_brute_force(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    vectors += [(700 + i, [0.5] * 8) for i in range(200)]  # one very common vector: ties go to the smaller id
    vectors += [(1000, [0.25] * 3), (1001, None), (1002, [1.0, None]), (1003, [float("nan")] * 8), (1004, [float("inf")]), (1005, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, "s") for i, v in vectors], "vec_id long, embedding array<double>, score int, rank string")
    ok = [(i, np.floor(64 * np.pad(v, (0, 8 - len(v)))).astype(int)) for i, v in vectors
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for block, round_ in ((64, 2), (100_000, 1000)):
        got = exact_topk(df, F.col("vec_id") % 100 == 0, k=5, scale=64.0, block_rows=block, round_queries=round_).collect()
        want = []
        for q, v in ok:
            if q % 100 == 0:
                best = sorted((-int(v @ w), i) for i, w in ok if i != q)[:5]
                want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert exact_topk(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    wide = spark.createDataFrame([(0, [2.0**30, 1.0]), (1, [2.0**30, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = exact_topk(wide, F.col("vec_id") == 0, k=1).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**60 + 1)]
