"""Cross-tokenizer alignment against a plain version that encodes whole texts."""

import hashlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from exprmat.llm import token_align
from exprmat.llm.token_align import Aligner, _byte_of, align, divide

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")

TEXTS = [
    None, "", " ", "a", "the cat  sat\n on the mat.\n\nDon't; x;\r\ny );\r\r z", "one\ntwo\nthree", "\nstarts", "ends \n", "tab\there  \t x",
    "é à la né école naïve — ﬁ", "漢字 と かな", "▁ piece mark", "a<|endoftext|>b <s> </s>", "a b　c d\u0085e\x1cf​ g",
    "\U0001F600\U0001F600 ok", "x\0y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "  deep   spaces    end   ", "1234567 89,01", "'s 'll x's",
]


@lru_cache(1)
def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B), _byte_of(), Aligner(A, B)


def plain_align(rows):
    a, b, byte_of, _ = tools()

    def spelt_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    found, docs = [], Counter()
    for key, text in rows:
        e = a.encode(" " + (text or ""), add_special_tokens=False)
        ia, ib, bytes_a = e.ids, b.encode(text or ""), [bytes(byte_of[c] for c in t) for t in e.tokens]
        bytes_b, raw = [spelt_b(i) for i in ib], (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            found.append((key, 0, 0, [], []))
            continue
        of_a, of_b = [k for k, x in enumerate(bytes_a) for _ in x], [k for k, x in enumerate(bytes_b) for _ in x]
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, x, y = [], 0, 0
        after_a, after_b = {c: i + 1 for i, c in enumerate(ends_a)}, {c: i + 1 for i, c in enumerate(ends_b)}
        for cut in sorted(set(ends_a) & set(ends_b)):
            i, j = after_a[cut], after_b[cut]
            groups.append((ia[x:i], ib[y:j]))
            x, y = i, j
        links = [(ia[i], ib[j]) for i, j in sorted(set(zip(of_a, of_b)))]
        docs.update(set(links))
        found.append((key, len(ia), len(ib), groups, links))
    best = defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    return [(k, na, nb, len(g), len(li), sum(docs[p] == best[p[0]] for p in li), sum(docs[p] for p in li),
             ";".join(",".join(map(str, i)) + "|" + ",".join(map(str, j)) for i, j in g)) for k, na, nb, g, li in found]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()), key=repr)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_divide_finds_every_common_end(a, b):
    ea, eb = np.cumsum(a), np.cumsum(b)
    if ea[-1] != eb[-1]:
        eb = np.append(eb[eb < ea[-1]], ea[-1])
    a0, a1, b0, b1 = divide(ea, eb, [0], [len(ea)], [0], [len(eb)])
    assert ea[a1 - 1].tolist() == eb[b1 - 1].tolist() == np.intersect1d(ea, eb).tolist()
    assert a0.tolist() == [0, *a1[:-1].tolist()] and b0.tolist() == [0, *b1[:-1].tolist()]


def test_divide_without_a_common_end():
    ea, eb = np.append(np.arange(1, 400, 2), 400), np.arange(2, 401, 2)
    assert [x.tolist() for x in divide(ea, eb, [0], [len(ea)], [0], [len(eb)])] == [[0], [len(ea)], [0], [len(eb)]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'sé;) \n\n  \r\t\x85 ▁漢.")), max_size=40), max_size=5))
def test_parts_equal_whole_texts(texts):
    al = tools()[3]
    of, counts = al.parts([t.encode() for t in texts])
    got = []
    for part in np.split(of, np.cumsum(counts)[:-1]) if texts else []:
        (a, _), (b, _), (na, _), (nb, _) = (flat.rows(part) for flat in (al.ids_a, al.ids_b, al.per_a, al.per_b))
        x, y = np.split(a, np.cumsum(na)[:-1]), np.split(b, np.cumsum(nb)[:-1])
        spelt = ";".join(",".join(map(str, i)) + "|" + ",".join(map(str, j)) for i, j in zip(x, y, strict=True))
        got.append(spelt if al.good[part].all() else "")
    want = [r[-1] for r in plain_align(enumerate(texts))]
    assert [g if t else "" for g, t in zip(got, texts)] == want


@pytest.mark.parametrize("known", [token_align.KNOWN_PAIRS, 8, 0])
def test_align_equals_plain(spark, known):
    rows = list(enumerate(TEXTS)) + [(3, "a"), (None, "the cat  sat"), (99, "word and " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, groups string, n_a int").repartition(3)
    got = rows_of(align(docs, A, B, known_pairs=known))
    assert got == sorted(plain_align(rows), key=repr)
    assert align(docs.where("false"), A, B, known_pairs=known).count() == 0


def test_query_digests(spark):
    from exprmat.llm.queries import QUERIES

    got = QUERIES["op11_token_align"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r[0]: (*r[1:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in plain_align([tuple(d) for d in docs])}
    assert {r[0]: tuple(r[1:]) for r in got} == want
