"""N-gram Jaccard join with set-relation skipping.

A document's set holds hashes of its distinct word shingles. Equal sets are one class from the start,
represented by the smallest id; the join works on classes.

1. Sets that are highly similar are found by short sketches and checked against one leader of their
   sketch group (a star, never all pairs); the exact distance to the leader is kept.
2. Every class puts its prefix (the rarest quarter of its shingles: two sets of the wanted similarity
   share one of them) into inverted lists. A list is laid out by set size and walked in blocks of
   position; a set, block or pair whose sizes or positions cannot reach the threshold is skipped. Lists of
   one class, and lists whose sets are already connected, give nothing; for some rounds, one set of each
   component in a list is checked against one of the list's first component, which connects families of copies.
3. Answers are derived from the leaders' answers: Jaccard distance is a metric, so sets x and y can
   only link if their leaders' distance is at most the threshold plus both distances to the leaders.
   Leaders are compared once; linked leaders connect all their sets without comparing these, leaders
   too far apart rule all of them out, and only sets of the narrow rest are compared themselves, in the
   lists where the two leaders met.

Links that are skipped join sets that are already connected or provably do not link, so components are
exact. Frequent shingles are put last by their corpus counts; the counts sent to the tasks are the
``FREQUENT`` largest, and the rarer ones are ordered by hash (any common order is right).

Cases: a text of fewer words than ``n`` is one shingle, a text without words (or null) has an empty set
and links with nothing; repeated rows each get a row and form one class; rows
with null ids link only with rows of an equal set (their component is null if none of these has an id);
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from exprmat.llm.common import components, pin, session_conf, small_side

N = 5
#: The threshold as a fraction: 100 * intersection >= 75 * union.
NUM, DEN = 75, 100
SKETCHES = 6
#: Rounds in which the components that meet in a list are compared with one of them, before all are.
STAR_ROUNDS = 4
#: A round that adds less than this part of the links so far is the last.
ROUND_GAIN = 20
FREQUENT = 1 << 19
#: Ranges of the hash space by which counts and lists are gathered, per shuffle partition.
RANGES = 4
#: Bytes of one vectorised step, and rows that a task holds sets of at a time: bounds on its memory.
STEP_BYTES = 1 << 19
STEP_ROWS = 1_500

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base squared, and so on; kept from step to step."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES), base, np.uint64)
        have[0] = 1
        have = _POWERS[int(base)] = np.multiply.accumulate(have)
    return have[:n]


def shingle_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, vectorised over all its bytes."""
    out: list[np.ndarray] = []
    some, size = [], 0
    for t in [*texts, None]:
        if some and (t is None or size > STEP_BYTES):
            out += _sets(some, n)
            some, size = [], 0
        if t is not None:
            some.append(t)
            size += len(t) + 1
    return out


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[raw]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    words_until = np.searchsorted(begin, ends)
    # a word's hash: a polynomial over its letters, brought to exponent 0
    terms = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[_LOWER[raw]] * _powers(_BASE, len(raw)), out=terms[1:])
    word = _mix((terms[end] - terms[begin]) * _powers(_BACK, len(raw))[begin])
    out = []
    shingle = np.zeros(max(len(word) - n + 1, 0), np.uint64)
    for j in range(n):
        shingle = shingle * _BASE + word[j:j + len(shingle)]
    shingle = _mix(shingle)
    at = 0
    for until in words_until.tolist():
        if until - at >= n:
            one = np.sort(shingle[at:until - n + 1])
            new = np.empty(len(one), bool)
            new[0] = True
            np.not_equal(one[1:], one[:-1], out=new[1:])
            out.append(one[new])
        elif until > at:
            few = np.uint64(until - at)
            with np.errstate(over="ignore"):
                for w in word[at:until]:
                    few = few * _BASE + w
            out.append(_mix(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at = until
    return out


def _class_of(s: np.ndarray) -> int:
    """Hash of a whole set."""
    h = _mix(s * _BASE + np.uint64(len(s)))
    return int(np.add.reduce(h, dtype=np.uint64).astype(np.int64)) if len(s) else 0


#: One-permutation sketching: the least shingle of each of these equal parts of the hash space.
_PARTS = np.array([(i << 64) // (2 * SKETCHES) for i in range(2 * SKETCHES)], np.uint64)


def _sketch(s: np.ndarray) -> list[int]:
    """Each sketch joins the least shingles of two parts; an empty part takes the next one's."""
    at = np.searchsorted(s, _PARTS)
    least = s[np.where(at < len(s), at, 0)]
    return (_mix(least[::2] * _BASE + least[1::2]) + np.arange(SKETCHES, dtype=np.uint64)).view(np.int64).tolist()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, STEP_ROWS):
            yield b.slice(k, STEP_ROWS)


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in b.column("txt").to_pylist()]


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("txt"))


def describe(docs: DataFrame, id_col: str, text_col: str, n: int = N) -> DataFrame:
    """Of each text its id, class, set size and sketches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = shingle_sets(_texts(b), n)
            rows = [(i, _class_of(s), len(s), _sketch(s) if len(s) else None)
                    for i, s in zip(b.column("id").to_pylist(), sets, strict=True)]
            yield _batch(rows, ["id", "cls", "size", "sketch"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())])

    return _read(docs, id_col, text_col).mapInArrow(run, "id long, cls long, size long, sketch array<long>")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _starts(ranges: int) -> np.ndarray:
    return np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)


#: Shingles are counted by the upper 32 bits of their hash: a shared count only moves a shingle in the order.
_KEY_SHIFT = np.uint64(32)
#: Lists are kept by the upper 40 bits: two shingles that share a list only bring candidates, never a link.
_TOKEN_SHIFT = np.uint64(24)


def _pack(keys: np.ndarray) -> bytes:
    """Ascending numbers as 2-byte steps; a step of 65535 or more goes on in the next one."""
    more, last = np.divmod(np.diff(keys.astype(np.int64), prepend=0), 65535)
    steps = np.full(int(more.sum()) + len(keys), 65535, "<u2")
    steps[np.cumsum(more + 1) - 1] = last
    return steps.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, "<u2")
    return np.cumsum(steps, dtype=np.int64)[steps < 65535].astype(np.uint64)


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str, ranges: int, n: int = N, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts (over all texts) of the most frequent shingles of each hash range, at most ``most``
    in all. Each batch sends, per range, its keys as packed offsets and the counts of those met again."""
    per_range = max(1, most // ranges)
    firsts = _starts(ranges) >> _KEY_SHIFT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = shingle_sets(_texts(b), n)
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]) >> _KEY_SHIFT, return_counts=True)
            cuts = np.searchsorted(keys, firsts)
            rows = []
            for r, (k, c) in enumerate(zip(np.split(keys, cuts[1:]), np.split(counts, cuts[1:]), strict=True)):
                if len(k):
                    again = np.flatnonzero(c > 1)
                    rows.append((r, _pack(k - firsts[r]), again.astype("<u4").tobytes(), c[again].astype("<u4").tobytes()))
            yield _batch(rows, ["range", "keys", "again", "counts"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    def top(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, weights = [], []
        for b in batches:
            for k, again, c in zip(b.column("keys"), b.column("again"), b.column("counts"), strict=True):
                parts.append(_unpack(k.as_py()))
                w = np.ones(len(parts[-1]), np.int64)
                w[np.frombuffer(again.as_py(), "<u4")] = np.frombuffer(c.as_py(), "<u4")
                weights.append(w)
        keys, w = np.concatenate(parts), np.concatenate(weights)
        o = np.argsort(keys, kind="stable")
        keys, w = keys[o], w[o]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.add.reduceat(w, at)
        values = keys[at] + firsts[key[0].as_py()]
        keep = np.flatnonzero(counts > 2)
        if len(keep) > per_range:
            keep = keep[np.argpartition(-counts[keep], per_range)[:per_range]]
        yield pa.RecordBatch.from_arrays([pa.array([values[keep].tobytes()], pa.binary()), pa.array([counts[keep].tobytes()], pa.binary())],
                                         names=["keys", "counts"])

    seen = _read(docs, id_col, text_col).mapInArrow(count, "range long, keys binary, again binary, counts binary")
    rows = seen.groupBy("range").applyInArrow(top, "keys binary, counts binary").collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in rows)])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in rows)])
    o = np.argsort(keys)
    return keys[o], counts[o]


def prefix_size(n: int) -> int:
    """How many of n ordered shingles must be indexed: a linked set shares at least ceil(0.75 n)."""
    return n - -(-NUM * n // DEN) + 1


_POSTING = np.dtype([("token", "<u8"), ("cls", "<i8"), ("size", "<u4"), ("at", "<u4")])


def _columns(posts: np.ndarray, first: np.uint64) -> bytes:
    """Postings as columns: token offsets, classes, and the lower and upper halves of sizes and places."""
    halves = [h for c in ("size", "at") for h in (posts[c] & 0xFFFF, posts[c] >> 16)]
    return b"".join([(posts["token"] - first).astype("<u4").tobytes(), posts["cls"].tobytes(), *(h.astype("<u2").tobytes() for h in halves)])


def _postings(columns: bytes, first: np.uint64) -> np.ndarray:
    n = len(columns) // 20
    out = np.empty(n, _POSTING)
    out["token"] = np.frombuffer(columns, "<u4", n).astype(np.uint64) + first
    out["cls"] = np.frombuffer(columns, "<i8", n, 4 * n)
    halves = np.frombuffer(columns, "<u2", 4 * n, 12 * n).reshape(4, n).astype(np.uint32)
    out["size"], out["at"] = halves[0] | halves[1] << 16, halves[2] | halves[3] << 16
    return out


def prefix_lists(docs: DataFrame, id_col: str, text_col: str, frequent: tuple[np.ndarray, np.ndarray], ranges: int, n: int = N) -> DataFrame:
    """``token, cls, size, at`` of the lists that hold more than one class."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    firsts = _starts(ranges) >> _TOKEN_SHIFT

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = sent.value
        for b in _slices(batches):
            parts = []
            for s in shingle_sets(_texts(b), n):
                if not len(s):
                    continue
                p = prefix_size(len(s))
                if len(keys):
                    k = s >> _KEY_SHIFT
                    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                    often = np.where(keys[at] == k, counts[at], 0)
                    chosen = s[np.lexsort((s, often))[:p]] if often.any() else s[:p]
                else:
                    chosen = s[:p]
                one = np.empty(p, _POSTING)
                one["token"], one["cls"], one["size"], one["at"] = chosen >> _TOKEN_SHIFT, _class_of(s), len(s), np.arange(p)
                parts.append(one)
            if parts:
                # copies within the batch post once
                all_ = np.concatenate(parts)
                all_ = all_[np.lexsort((all_["at"], all_["size"], all_["cls"], all_["token"]))]
                new = np.ones(len(all_), bool)
                new[1:] = (all_["token"][1:] != all_["token"][:-1]) | (all_["cls"][1:] != all_["cls"][:-1])
                all_ = all_[new]
                cuts = np.searchsorted(all_["token"], firsts)
                pieces = np.split(all_, cuts[1:])
                yield _batch([(r, _columns(x, firsts[r])) for r, x in enumerate(pieces) if len(x)], ["range", "posts"], [pa.int64(), pa.binary()])

    def lists(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = np.concatenate([_postings(x.as_py(), firsts[key[0].as_py()]) for b in batches for x in b.column("posts")])
        all_ = all_[np.lexsort((all_["at"], all_["cls"], all_["size"], all_["token"]))]
        same = np.zeros(len(all_), bool)
        same[1:] = (all_["token"][1:] == all_["token"][:-1]) & (all_["cls"][1:] == all_["cls"][:-1]) & (all_["size"][1:] == all_["size"][:-1])
        all_ = all_[~same]
        first = np.ones(len(all_), bool)
        first[1:] = all_["token"][1:] != all_["token"][:-1]
        of = np.cumsum(first) - 1
        # within a list (by size), a set whose neighbours are all too small or too large links nowhere here
        size = all_["size"].astype(np.int64)
        up = np.zeros(len(all_), bool)
        up[:-1] = (of[1:] == of[:-1]) & (NUM * size[1:] <= DEN * size[:-1])
        down = np.concatenate([[False], up[:-1]])
        # by position: what either set holds from this shingle on must reach the overlap; exact in a list of
        # two, else with the smallest size and the most that any set of the list still holds
        starts = np.flatnonzero(first)
        rest = size - all_["at"]
        small = np.maximum(np.minimum.reduceat(size, starts)[of], -(-NUM * size // DEN))
        most = np.maximum.reduceat(rest, starts)[of]
        least = np.minimum.reduceat(rest, starts)[of]
        two = np.diff(np.append(starts, len(all_)))[of] == 2
        both = np.add.reduceat(size, starts)[of]
        can = np.where(two, (NUM + DEN) * least >= NUM * both, (NUM + DEN) * np.minimum(rest, most) >= NUM * (size + small))
        kept = all_[(up | down) & can]
        yield pa.RecordBatch.from_arrays([pa.array(kept[c].astype(np.int64) if c != "token" else kept[c].view(np.int64), pa.int64())
                                          for c in ("token", "cls", "size", "at")], names=["token", "cls", "size", "at"])

    posts = _read(docs, id_col, text_col).mapInArrow(post, "range long, posts binary")
    return posts.groupBy("range").applyInArrow(lists, "token long, cls long, size long, at long")


def sets_of(docs: DataFrame, wanted: DataFrame, rows: int, id_col: str, text_col: str, unique: bool, n: int = N) -> DataFrame:
    """``cls, s`` (its shingles) of the wanted ``id`` representatives; ``unique``: no wanted id has two rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = shingle_sets(_texts(b), n)
            yield _batch([(_class_of(s), s.view(np.int64)) for s in sets], ["cls", "s"], [pa.int64(), pa.list_(pa.int64())])

    texts = _read(docs, id_col, text_col).join(small_side(wanted, rows), "id")
    sets = texts.mapInArrow(run, "cls long, s array<long>")
    return sets if unique else sets.dropDuplicates(["cls"])


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, inter, na, nb`` of class pairs, from their whole sets; sets that are in no pair are not shuffled."""
    rows = pairs.count()
    left = sets.join(small_side(pairs.select("a", "b"), rows), F.col("cls") == F.col("a")).select("a", "b", F.col("s").alias("sa"))
    right = sets.join(small_side(pairs.select(F.col("b").alias("cls")).distinct(), rows), "cls", "left_semi").select(
        F.col("cls").alias("b"), F.col("s").alias("sb"))
    return (left.join(right, "b")
            .select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("inter"),
                    F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb")))


def _reaches(p: str, q: str) -> Column:
    """Whether postings ``p`` and ``q`` (``size, at``) of a list can be the first common shingle of a linked
    pair: what either set holds from there on must reach the overlap, and the sizes must allow it."""
    size, other = F.col(f"{p}.size"), F.col(f"{q}.size")
    rest = F.least(size - F.col(f"{p}.at"), other - F.col(f"{q}.at"))
    return (NUM * size <= DEN * other) & (NUM * other <= DEN * size) & (rest * (NUM + DEN) >= NUM * (size + other))


def _open_lists(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the lists whose sets are not all connected yet, with their component."""
    placed = rows.join(small_side(known.withColumnRenamed("node", "cls"), known.count()), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return placed.join(mixed, "token").select("token", "cls", "size", "at", "lead", "d", "comp")


LINKED = f"{DEN} * inter >= {NUM} * (na + nb - inter)"


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id, n_links`` per row; class_id is the smallest id with
    the same set, n_links the checked links of its class to other sets."""
    # texts reach the Python workers in small batches, so that a task's memory is bounded
    with session_conf(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(STEP_ROWS)):
        top = docs.agg(F.max(F.col(id_col).cast("long")).alias("m"), F.count_if(F.col(id_col).isNull()).alias("n")).first()
        if not top["n"]:
            return _join(docs, id_col, text_col, n)
        # rows without an id link like others: here they go by ids past all real ones, equal texts by one
        past = F.lit((top["m"] if top["m"] is not None else -1) + 1)
        given = F.coalesce(F.col(id_col).cast("long"), past + F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 40)))
        out = _join(docs.select(given.alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", n)
        return out.withColumns({c: F.when(F.col(c) < past, F.col(c)) for c in ("doc_id", "component_id", "class_id")})


def _join(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    spark = docs.sparkSession
    # enough ranges that a key's offset in its range fits 4 bytes, and that a range is a fraction of a partition
    ranges = max(256, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pin(describe(docs, id_col, text_col, n), "jaccard-described")
    classes = pin(rows.where("size > 0").groupBy("cls", "size").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")), "jaccard-classes")
    frequent = frequent_shingles(docs, id_col, text_col, ranges, n)

    # stars of highly similar sets: in each sketch group, the members and their leader
    keys = classes.select("cls", "size", F.posexplode("sketch").alias("j", "key"))
    heads = keys.groupBy("j", "key").agg(F.min("cls").alias("b"), F.count("*").alias("k")).where("k > 1")
    most = F.max(F.struct("n", "b"))  # the leader that a set shares most sketches with
    stars = pin(keys.join(heads, ["j", "key"]).where("cls <> b").groupBy("cls", "b").agg(F.count("*").alias("n"))
                .groupBy(F.col("cls").alias("a")).agg(most.alias("m")).select("a", F.col("m.b").alias("b")), "jaccard-stars")

    lists = pin(prefix_lists(docs, id_col, text_col, frequent, ranges, n), "jaccard-lists")
    named = stars.select(F.col("a").alias("cls")).union(stars.select("b")).union(lists.select("cls")).distinct()
    wanted = pin(classes.join(named, "cls").where("id is not null").select("id").distinct(), "jaccard-wanted")
    n_wanted = wanted.count()
    unique = rows.join(small_side(wanted, n_wanted), "id").count() == n_wanted
    sets = pin(sets_of(docs, wanted, n_wanted, id_col, text_col, unique, n), "jaccard-sets")

    star = pin(distances(stars, sets).where(LINKED), "jaccard-star-links")
    known = components(star, "a", "b", "jaccard-star")
    # a set that does not link with a leader leads itself, at distance 0
    near = star.select(F.col("a").alias("cls"), F.col("b").alias("lead"),
                       (1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("d"))
    left = lists.join(small_side(near, star.count()), "cls", "left").select("token", "cls", "size", "at", F.coalesce("lead", "cls").alias("lead"),
                                                  F.coalesce("d", F.lit(0.0)).alias("d"))
    links, left = star.select("a", "b"), pin(_open_lists(left, known), "jaccard-open")
    met, n_links = None, star.count()
    for _ in range(STAR_ROUNDS):
        # of each component in a list one set meets the list's first one: links found here connect whole components
        first = left.groupBy("token", "comp").agg(F.min(F.struct("at", "cls", "size")).alias("m"))
        heads = first.groupBy("token").agg(F.min(F.struct("comp", "m.*")).alias("h"))
        spokes = (first.join(heads, "token").where((F.col("comp") != F.col("h.comp")) & _reaches("m", "h"))
                  .select(F.col("m.cls").alias("a"), F.col("h.cls").alias("b")).distinct())
        # pairs of earlier rounds have their answer
        spokes = pin(spokes if met is None else spokes.join(met, ["a", "b"], "left_anti"), "jaccard-spokes")
        met = spokes if met is None else met.union(spokes)
        found = pin(distances(spokes, sets).where(LINKED).select("a", "b"), "jaccard-spoke-links")
        n_found = found.count()
        if not n_found:
            break
        links = pin(links.union(found), "jaccard-links")
        if n_found * ROUND_GAIN < n_links:  # the leaders below do the rest
            break
        n_links += n_found
        known = components(links, "a", "b", "jaccard-star")
        left = pin(_open_lists(left.drop("comp"), known), "jaccard-open")
    # blocks of a list: sets of one leader and component, with their reach
    blocks = left.groupBy("token", "lead", "comp").agg(F.min("size").alias("small"), F.max("size").alias("large"),
                                                       F.min("at").alias("at"), F.max("d").alias("d"))
    x, y = blocks.alias("x"), blocks.alias("y")
    can = ((F.col("x.comp") != F.col("y.comp")) & (F.col("x.lead") < F.col("y.lead"))
           & (NUM * F.col("x.small") <= DEN * F.col("y.large")) & (NUM * F.col("y.small") <= DEN * F.col("x.large")))
    # position: a linked pair is found at its first common shingle, from which on either set must hold the overlap
    reach = (F.least(F.col("x.large") - F.col("x.at"), F.col("y.large") - F.col("y.at")) * (NUM + DEN)
             >= NUM * (F.col("x.small") + F.col("y.small")))
    meets = pin(x.join(y, F.col("x.token") == F.col("y.token")).where(can & reach)
                .select("x.token", F.col("x.lead").alias("a"), F.col("y.lead").alias("b"), F.col("x.d").alias("da"), F.col("y.d").alias("db")), "jaccard-meets")
    pairs = pin(meets.groupBy("a", "b").agg(F.max(F.col("da") + F.col("db")).alias("slack")), "jaccard-leads")
    judged = pin(distances(pairs, sets).join(pairs, ["a", "b"]).select(
        "*", (1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("far"), F.expr(LINKED).alias("linked")), "jaccard-judged")
    # a pair of the last round may have been judged again, the other way round
    edges = links.union(judged.where("linked").select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = pin(edges.distinct(), "jaccard-links")
    # families that their leaders now connect need no further comparison
    left = pin(_open_lists(left.drop("comp"), components(edges, "a", "b", "jaccard-star")), "jaccard-open")

    # leaders that just miss: compare those sets whose own distances leave it open
    limit = 1 - NUM / DEN
    unsure = judged.where(~F.col("linked") & (F.col("far") <= F.col("slack") + limit + 1e-9)).select("a", "b", "far")
    # only in the lists where both leaders have sets whose distances there leave it open
    near = (meets.join(small_side(unsure, unsure.count()), ["a", "b"]).where(F.col("far") <= F.col("da") + F.col("db") + limit + 1e-9)
            .select(F.col("token").alias("t"), F.col("a").alias("la"), F.col("b").alias("lb"), "far", "db"))
    u, v = left.alias("u"), left.alias("v")
    rest = (near.join(u, (F.col("t") == F.col("u.token")) & (F.col("la") == F.col("u.lead")) & (F.col("far") <= F.col("u.d") + F.col("db") + limit + 1e-9))
            .join(v, (F.col("t") == F.col("v.token")) & (F.col("lb") == F.col("v.lead"))
                  & (F.col("u.comp") != F.col("v.comp")) & (F.col("far") <= F.col("u.d") + F.col("v.d") + limit + 1e-9) & _reaches("u", "v")
                  & ~((F.col("u.cls") == F.col("la")) & (F.col("v.cls") == F.col("lb"))))
            .select(F.col("u.cls").alias("a"), F.col("v.cls").alias("b")).distinct())
    more = distances(pin(rest, "jaccard-rest"), sets).where(LINKED).select("a", "b")
    edges = pin(edges.union(more).distinct(), "jaccard-edges")

    joined = components(edges, "a", "b", "jaccard")
    degree = edges.select(F.col("a").alias("cls")).union(edges.select("b")).groupBy("cls").agg(F.count("*").alias("n_links"))
    labelled = pin(classes.join(joined.withColumnRenamed("node", "cls"), "cls", "left").join(degree, "cls", "left")
                   .select("cls", "size", F.col("id").alias("class_id"), F.coalesce("component", "cls").alias("comp"),
                           F.coalesce("n_links", F.lit(0)).alias("n_links")), "jaccard-classes")
    least = labelled.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    named = labelled.join(least, "comp").select("cls", "size", "class_id", "component_id", "n_links")
    named = pin(named, "jaccard-named")
    return (rows.select(F.col("id").alias("doc_id"), "cls", "size").join(named, ["cls", "size"], "left")
            .select("doc_id", F.col("size").alias("n_shingles"),
                    F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component; of rows with that id, one."""
    found = jaccard_components(docs, id_col, text_col)
    gone = pin(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "jaccard-gone")
    kept = docs.join(small_side(gone, gone.count()), F.col(id_col) == F.col("gone"), "left_anti")
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.limit(1).count():
        return kept
    first = W.partitionBy(id_col).orderBy(text_col)
    return kept.withColumn("_nth", F.row_number().over(first)).where((F.col("_nth") == 1) | F.col(id_col).isNull()).drop("_nth")
