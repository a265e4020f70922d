"""Memory that stays beside an executor's next tasks: what workers give back, what is laid out at once."""

import re
from pathlib import Path

import pytest


def held_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_release_memory():
    from exprmat.llm.common import release_memory

    some = [bytes(1000) for _ in range(200_000)]
    some = some[::1000]  # a few that stay keep the rest from going back by itself
    full = held_mb()
    release_memory()
    assert full - held_mb() > 100


def test_words_go_to_the_library_in_bounded_steps():
    pytest.importorskip("public_tokenizers")
    from exprmat.llm import token_ids
    from exprmat.llm.queries import tokenizer_path

    encoder, sizes = token_ids.Encoder(tokenizer_path()), []
    library = encoder.library

    class Counted:
        def encode_batch_fast(self, words, **options):
            sizes.append(len(words))
            return library.encode_batch_fast(words, **options)

    text = " ".join("".join(chr(0x430 + (k >> s & 31)) for s in (0, 5, 10)) for k in range(7_000))
    encoder.library = Counted()
    ids, _ = encoder.encode([text])
    assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
    assert len(sizes) > 3 and max(sizes) <= token_ids.AT_ONCE


def test_fit_reads_in_small_batches(spark, monkeypatch):
    from exprmat.llm import quality

    name, seen = "spark.sql.parquet.columnarReaderBatchSize", []
    before = spark.conf.get(name)
    monkeypatch.setattr(quality, "_fit", lambda *a: seen.append(int(spark.conf.get(name))))
    docs = spark.createDataFrame([(1, "a", "en", "s")], "doc_id long, text string, lang string, source string")
    quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert seen == [quality.READ_ROWS] and spark.conf.get(name) == before
