"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the 128-bit xxh3 of the line, stripped of ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased; lines of fewer than ``MIN_POINTS`` code points have none. A state holds, for the documents
inserted so far,

- ``refs(k1, k2, refs, least, most, unknown)``: per key how many documents hold it, the least and the
  most of their ids, and how many of them have no id. A key is *repeated* when it is held under
  different ids.
- ``posts(k1, k2, doc, refs)``: the holders of the repeated keys, needed when a holder goes.
- a cuckoo filter per shard of the key space, one row each, of the repeated keys. Inserting adds the keys
  that became repeated; deleting takes out those that no longer are (a Bloom filter could not).

``insert`` and ``delete`` return a new state and leave the old one readable; deleting what was inserted
gives the tables of before. Documents are tested against the filters line by line, so lines that are not
repeated, nearly all, are never shuffled: only hits meet the exact tables, which decide, so that a false
hit changes nothing. While all filters together hold at most ``FILTER_BYTES`` each task reads those
it needs from the shared folder; beyond that the keys are first range-partitioned by shard, so that
a task needs only a few. Either way the rows are the same.

``dedup`` drops the lines of repeated keys but in the document with the least id that holds the key.

Cases: null and empty texts are one empty line; a null id is one document, after all others; rows that
share an id count as one document for repetition (never against each other) and each stays a row;
repeated lines within one document all stay unless another document held the key first; lines that
are too short always stay; a text of any length is read whole; empty tables give no rows; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from exprmat.llm.common import fresh_folder, pin

MIN_POINTS = 10
BLANKS = b" \t\n\x0b\x0c\r"
#: Repeated keys per shard that sharding aims at, fingerprints per bucket, and bytes of filters a task may hold.
SHARD_KEYS = 1 << 19
SLOTS = 4
FILTER_BYTES = 256 << 20
STEP_ROWS = 1 << 16

KEY = ["k1", "k2"]


# ------------------------------------------------------------------ cuckoo filter


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Buckets of ``SLOTS`` 16-bit fingerprints; a key may lie in two buckets, each found from the other
    by its fingerprint, so that keys can move and be taken out. 0 is an empty slot. All operations take
    arrays of keys (two 64-bit halves). A filter that cannot place a key refuses the whole insertion."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots.reshape(buckets, SLOTS)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Room for ``keys`` at a load of at most a half."""
        need = max(1, -(-2 * keys // SLOTS))
        return cls(1 << (need - 1).bit_length())

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (k2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        return mark, (_mix(k1.view(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(mark) & np.uint64(self.buckets - 1)).astype(np.int64)

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, b = self._places(k1, k2)
        found = (self.slots[b] == mark[:, None]).any(axis=1)
        rest = np.flatnonzero(~found)
        found[rest] = (self.slots[self._other(b[rest], mark[rest])] == mark[rest, None]).any(axis=1)
        return found

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Add keys; False (and nothing added) when they do not fit."""
        before = self.slots.copy()
        mark, at = self._places(k1, k2)
        for turn in range(500):
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
            begin = np.flatnonzero(first)
            rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            full = self.slots[at] != 0
            free = SLOTS - full.sum(axis=1)
            fits = rank < free
            # the rank-th empty slot of the bucket
            slot = np.argsort(full, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            self.slots[at[fits], slot[fits]] = mark[fits]
            mark, at = mark[~fits], at[~fits]
            if not len(mark):
                return True
            if turn:  # the first one left of each bucket changes places with a resident
                one = np.concatenate([[True], at[1:] != at[:-1]])
                s = (turn + at[one]) % SLOTS
                mark[one], self.slots[at[one], s] = self.slots[at[one], s], mark[one].copy()
            at = self._other(at, mark)
        self.slots = before
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take out keys that were inserted."""
        mark, b = self._places(k1, k2)
        for m, x, y in zip(mark, b.tolist(), self._other(b, mark).tolist(), strict=True):
            for bucket in (x, y):
                hit = np.flatnonzero(self.slots[bucket] == m)
                if len(hit):
                    self.slots[bucket, hit[0]] = 0
                    break
            else:
                raise KeyError("a key that was never inserted")


# ------------------------------------------------------------------ lines and keys


def line_key(line: bytes) -> bytes | None:
    """The 16 bytes that stand for a line, or None where it is too short."""
    import xxhash

    core = line.strip(BLANKS).lower()  # bytes: only A-Z change
    if len(core) < MIN_POINTS or (not core.isascii() and len(core.decode()) < MIN_POINTS):
        return None
    return xxhash.xxh3_128_digest(core)


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of some documents, and their different keys: the place of the document, and the key's halves."""
    for b in batches:
        ids, docs, keys = [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            found = {line_key(x) for x in (text.as_py() or b"").split(b"\n")}
            found.discard(None)
            docs += [len(ids)] * len(found)
            ids.append(i)
            keys += found
            if len(keys) >= STEP_ROWS:
                yield ids, np.array(docs, np.int64), *_halves(keys)
                ids, docs, keys = [], [], []
        if keys:
            yield ids, np.array(docs, np.int64), *_halves(keys)


def _key_rows(ids: list, docs: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(ids, pa.int64()).take(pa.array(docs))], names=["k1", "k2", "doc"])


def document_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``k1, k2, doc``: each document's different keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _documents(batches):
            yield _key_rows(*found)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(keys, "k1 long, k2 long, doc long")


def _counted(keys: DataFrame) -> DataFrame:
    return keys.groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("doc").alias("least"), F.max("doc").alias("most"),
                                  F.sum(F.col("doc").isNull().cast("long")).alias("unknown"))


def repeated() -> Column:
    """Whether a row of ``refs`` is held under different ids."""
    return (F.col("least") < F.col("most")) | ((F.col("unknown") > 0) & F.col("least").isNotNull())


# ------------------------------------------------------------------ state


@dataclass
class LineState:
    """The lines of the documents inserted so far. ``filters`` is a folder of one file per shard."""

    spark: SparkSession
    refs: DataFrame
    posts: DataFrame
    filters: str
    shards: int
    filter_bytes: int


REFS = "k1 long, k2 long, refs long, least long, most long, unknown long"
POSTS = "k1 long, k2 long, doc long, refs long"


def empty_state(spark: SparkSession) -> LineState:
    return LineState(spark, spark.createDataFrame([], REFS), spark.createDataFrame([], POSTS), "", 1, 0)


def _shard(k1: Column, shards: int) -> Column:
    return F.pmod(k1, F.lit(shards)).cast("int")


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _read_filter(folder: str, shard: int) -> CuckooFilter | None:
    """A shard's filter from the shared folder; None where it has no key."""
    if not folder:
        return None
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(folder)
    file = f"{path}/shard-{shard:06d}"
    if fs.get_file_info(file).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(file) as f:
        data = f.read()
    return CuckooFilter(len(data) // (2 * SLOTS), np.frombuffer(data, np.uint16).copy())


def _change_filters(old: LineState, change: DataFrame, shards: int) -> tuple[str, int]:
    """New filter files after taking out and adding keys (``k1, k2, add``); a filter that is full is built anew
    with twice the buckets. All of a shard's repeated keys meet in one task: at most a few SHARD_KEYS."""
    from exprmat.llm.token_ids import put_file

    folder = _uri(fresh_folder(old.spark, "line-filters"))
    keep = old.filters if shards == old.shards else ""

    def build(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        k1, k2 = (np.ascontiguousarray(rows.column(c).to_numpy()) for c in KEY)
        add, known = (rows.column(c).to_numpy().astype(bool) for c in ("add", "known"))
        f = _read_filter(keep, shard)
        if f is not None:
            out = known & ~add
            f.delete(k1[out], k2[out])
            new = add & ~known
            f = f if f.insert(k1[new], k2[new]) else None
        if f is None:
            f = CuckooFilter.sized(int(add.sum()))
            while not f.insert(k1[add], k2[add]):
                f = CuckooFilter(2 * f.buckets)
        put_file(f"{folder}/shard-{shard:06d}", f.slots.tobytes())
        return pa.table({"bytes": pa.array([f.slots.nbytes], pa.int64())})

    rows = change.withColumn("shard", _shard(F.col("k1"), shards))
    size = rows.groupBy("shard").applyInArrow(build, "bytes long").agg(F.sum("bytes")).first()[0] or 0
    return folder, size


def _hits(state: LineState, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``k1, k2, doc`` of the keys that the filters may hold."""
    folder, shards = state.filters, state.shards
    bound = max(1, FILTER_BYTES * shards // max(state.filter_bytes, 1))  # filters a task may hold

    def test(batches: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, CuckooFilter | None] = {}
        for ids, docs, k1, k2 in batches:
            shard = k1 % shards
            hit = np.zeros(len(k1), bool)
            order = np.argsort(shard, kind="stable")
            kinds, begin = np.unique(shard[order], return_index=True)
            for s, rows in zip(kinds.tolist(), np.split(order, begin[1:]), strict=True):
                if s not in filters:
                    if len(filters) >= bound:
                        filters.clear()
                    filters[s] = _read_filter(folder, s)
                if filters[s] is not None:
                    hit[rows] = filters[s].has(k1[rows], k2[rows])
            yield _key_rows(ids, docs[hit], k1[hit], k2[hit])

    if state.filter_bytes <= FILTER_BYTES:
        return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(lambda b: test(_documents(b)), "k1 long, k2 long, doc long")

    def ready(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield (b.column("doc").to_pylist(), np.arange(b.num_rows),
                   np.ascontiguousarray(b.column("k1").to_numpy()), np.ascontiguousarray(b.column("k2").to_numpy()))

    by = [_shard(F.col("k1"), shards), F.col("k1"), F.col("k2"), F.col("doc")]
    keys = document_keys(docs, id_col, text_col).repartitionByRange(*by).sortWithinPartitions(by[0])
    return keys.mapInArrow(lambda b: test(ready(b)), "k1 long, k2 long, doc long")


def _shards_for(spark: SparkSession, refs: DataFrame, old: LineState) -> int:
    """Enough shards for the repeated keys; a state keeps its shards until they hold four times too many."""
    n = refs.where(repeated()).count()
    need = max(1, -(-n // SHARD_KEYS), spark.sparkContext.defaultParallelism)
    return old.shards if old.filters and n <= 4 * SHARD_KEYS * old.shards else need


def _with_filters(old: LineState, refs: DataFrame, posts: DataFrame | None) -> LineState:
    """The state of new ``refs``: filters follow what became or ceased to be repeated."""
    shards = _shards_for(old.spark, refs, old)
    now = refs.where(repeated()).select(*KEY, F.lit(True).alias("add"))
    before = old.refs.where(repeated()).select(*KEY, F.lit(True).alias("known"))
    change = now.join(before, KEY, "full").select(*KEY, F.coalesce("add", F.lit(False)).alias("add"), F.coalesce("known", F.lit(False)).alias("known"))
    folder, size = _change_filters(old, change, shards)
    return LineState(old.spark, refs, old.posts if posts is None else posts, folder, shards, size)


def insert(state: LineState, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineState:
    """The state after adding documents. Ids should be new; rows of a known id add to it."""
    new = _counted(document_keys(docs, id_col, text_col))
    if state.filters:  # merge with the counts of before
        new = state.refs.unionByName(new).groupBy(*KEY).agg(
            F.sum("refs").alias("refs"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("unknown").alias("unknown"))
    out = _with_filters(state, pin(new, "line-refs"), None)
    held = _hits(out, docs, id_col, text_col).groupBy(*KEY, "doc").agg(F.count("*").alias("refs"))
    if state.filters:
        # holders of keys that only now became repeated: all of them share one id
        alone = state.refs.where(~F.coalesce(repeated(), F.lit(False))).select(*KEY, F.col("least").alias("doc"), "refs")
        held = state.posts.unionByName(held).unionByName(alone).groupBy(*KEY, "doc").agg(F.sum("refs").alias("refs"))
    out.posts = pin(held.join(out.refs.where(repeated()).select(*KEY), KEY, "left_semi"), "line-posts")
    return out


def delete(state: LineState, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineState:
    """The state after removing the given documents (all rows of their ids, with the texts inserted)."""
    gone = pin(document_keys(docs, id_col, text_col).groupBy(*KEY, "doc").agg(F.count("*").alias("minus")), "line-gone")
    g = gone.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.col("doc").alias("gdoc"))
    same = (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")) & F.col("doc").eqNullSafe(F.col("gdoc"))
    posts = state.posts.join(g, same, "left_anti")
    left = posts.groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.min("doc").alias("least"), F.max("doc").alias("most"),
                                   F.sum(F.when(F.col("doc").isNull(), F.col("refs")).otherwise(0)).alias("unknown"))
    touched = gone.select(*KEY).distinct()
    # keys of one id go with it; repeated ones are counted again from their holders
    refs = (state.refs.join(touched, KEY, "left_anti")
            .unionByName(left.join(touched, KEY, "left_semi")))
    refs = pin(refs, "line-refs")
    posts = pin(posts.join(refs.where(repeated()).select(*KEY), KEY, "left_semi"), "line-posts")
    return _with_filters(state, refs, posts)


def dropped(state: LineState) -> DataFrame:
    """``doc`` and its keys whose lines it loses, as one string of 16 bytes each: keys held under an
    id before it. The groups are one document's keys, not more than its text."""
    first = state.refs.where(repeated()).select(*KEY, F.col("least").alias("first"))
    lost = state.posts.select(*KEY, "doc").join(first, KEY).where("doc is null or doc > first")
    return lost.groupBy("doc").agg(F.collect_list(F.struct(*KEY)).alias("lost"))


def dedup(state: LineState, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_lines``, ``n_dropped`` and the ``kept`` text. The state must hold them."""
    lost = dropped(state).withColumnRenamed("doc", "lost_doc")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("txt"))
    rows = rows.join(lost, F.col("doc").eqNullSafe(F.col("lost_doc")), "left").select("doc", "txt", "lost")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                lost = b.column("lost")
                inner = lost.flatten()
                flat = np.stack([inner.field("k1").to_numpy(), inner.field("k2").to_numpy()], axis=1).astype("<i8").tobytes()
                sizes = np.nan_to_num(pc.list_value_length(lost).to_numpy(zero_copy_only=False)).astype(int)
                ends = np.cumsum(sizes)
                n_lines, n_dropped, kept = [], [], []
                for text, n, end in zip(b.column("txt").cast(pa.binary()), sizes.tolist(), ends.tolist(), strict=True):
                    lines = (text.as_py() or b"").split(b"\n")
                    stay = lines
                    if n:
                        keys = {flat[16 * i:16 * i + 16] for i in range(end - n, end)}
                        stay = [x for x in lines if line_key(x) not in keys]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc", "n_lines", "n_dropped", "kept"])

    out = rows.mapInArrow(keep, "doc long, n_lines long, n_dropped long, kept string")
    return out.select(F.col("doc").alias(id_col), "n_lines", "n_dropped", "kept")
