"""Token-id / binary output: byte-level BPE ids of whole texts in Simple-8b shard files.

``write_token_ids`` range-partitions the documents by id, so shard files in partition order hold
ids in ascending doc_id order; each task encodes its texts and writes one file. ``read_token_ids``
reads the files back.

Shard file, little-endian: magic ``S8BSHRD1``; six uint64 (documents, ids, words, blocks + 1,
escapes, ids per block); int64 doc ids; uint8 1 where the doc id is not null; int64 ids per
document; int64 word offset per block; uint64 escapes; uint64 words (see ``simple8b``).

Texts are cut at the tokenizer's own pre-token boundaries (vectorised over code points), every
different pre-token is encoded once per worker by the tokenizers library, and the ids are gathered.
Byte-level BPE never merges across those boundaries, so this equals encoding the whole text. Texts
that hold an added token's string, or characters whose class may differ between Unicode versions,
go through the library whole.

Cases: a null or empty text has only the end id; rows with equal doc ids keep one entry each
(ordered by their text); null doc ids come first; an empty table writes no file and reads as no rows.
"""

from __future__ import annotations

import posixpath
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W

from exprmat.llm import simple8b
from exprmat.llm.common import fresh_folder, pin, release_memory

MAGIC = b"S8BSHRD1"
END_ID = 0
#: Bytes of text per shard file and code points per vectorised step: bounds on a task's memory.
SHARD_BYTES = 8 << 20
STEP_CHARS = 5 << 19
#: Different pre-tokens a worker remembers; the store starts anew beyond it.
REMEMBERED = 400_000
#: Pre-tokens handed to the library at once: each comes back as an object of its own.
AT_ONCE = 2_000

#: A pre-token that may be a line among others: letters or digits with at most a blank before them.
LINE = re.compile("(?: ?[0-9A-Za-zÀ-ÖØ-öø-ÿ]+)")

LETTER, NUMBER, OTHER, SPACE, UNSURE = 0, 1, 2, 3, 4


def _char_classes() -> np.ndarray:
    """Class of each code point below U+3000; UNSURE where Unicode versions or tools may disagree."""
    old = unicodedata.ucd_3_2_0

    def kind(cat: str) -> int:
        return LETTER if cat[0] == "L" else NUMBER if cat[0] == "N" else SPACE if cat[0] == "Z" else OTHER

    out = np.full(0x3001, UNSURE, np.uint8)
    for c in range(0x3000):
        now, then = unicodedata.category(chr(c)), old.category(chr(c))
        if "Cn" not in (now, then) and kind(now) == kind(then):
            out[c] = kind(now)
    out[0x1C:0x20] = UNSURE
    out[0x85] = UNSURE
    out[9:14] = SPACE
    return out


class Encoder:
    """Ids of many texts at once, with a store of the pre-tokens met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [str(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _char_classes()
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)  # word k has ids[begin[k]:begin[k + 1]]
        self.words = 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and how many each has; as lines of texts, which costs less than text by text."""
        ids, sizes = [], []
        for at in range(0, len(words), 300):
            some = words[at:at + 300]
            flat = np.array(self.library.encode_batch_fast(["\n" + "\n".join(some)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(flat == self.line_end)
            if len(cuts) != len(some):
                raise ValueError("the tokenizer joins line ends to what stands beside them")
            ids.append(flat[flat != self.line_end].astype(np.uint32))
            sizes.append(np.diff(cuts, append=len(flat)) - 1)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _learn(self, words: list[str]) -> None:
        lines = [w for w in words if LINE.fullmatch(w)]
        if lines:
            self._keep(lines, *self._encoded(lines))
        if len(lines) < len(words):
            known = set(lines)
            rest = [w for w in words if w not in known]
            for at in range(0, len(rest), AT_ONCE):
                some = rest[at:at + AT_ONCE]
                found = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                self._keep(some, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at, k = int(self.begin[self.words]), self.words
        while at + int(sizes.sum()) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(words) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.ids[at:at + int(sizes.sum())] = ids
        self.begin[k + 1:k + 1 + len(words)] = at + np.cumsum(sizes)
        self.index.update(zip(words, range(k, k + len(words)), strict=True))
        self.words += len(words)

    def _starts(self, cp: np.ndarray, kind: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: runs of one class, a blank joined to the run after it, white
        space before a run cut before its last character, and the contractions of the pattern."""
        n = len(cp)
        first = np.zeros(n, bool)
        first[doc_at[doc_at < n]] = True
        before = np.empty(n, np.uint8)
        before[0], before[1:] = UNSURE, kind[:-1]
        changed = first | (kind != before)
        blank = np.zeros(n, bool)
        blank[1:] = cp[:-1] == 32
        blank &= ~first
        space = kind == SPACE
        ends = np.ones(n, bool)  # the next character is of another document or no white space
        ends[:-1] = first[1:] | (kind[1:] != SPACE)
        last_of_doc = np.ones(n, bool)
        last_of_doc[:-1] = first[1:]
        start = np.where(space, changed | (ends & ~last_of_doc), changed & ~blank)
        quotes = np.flatnonzero(cp == 39)
        if len(quotes):
            more = np.concatenate([cp, np.zeros(2, cp.dtype)])
            doc_end = np.append(doc_at[1:], n)[np.searchsorted(doc_at, quotes, "right") - 1]
            one, two = more[quotes + 1], more[quotes + 2]
            short = np.isin(one, [ord(c) for c in "stmd"]) & (quotes + 1 < doc_end)
            pair = one.astype(np.int64) << 21 | two
            long = np.isin(pair, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")]) & (quotes + 2 < doc_end)
            opens = start[quotes] & (short | long)
            q, size = quotes[opens], np.where(short[opens], 2, 3)
            start[q + 1] = False
            nxt = q + size
            start[nxt[nxt < n]] = True
            # a blank or white-space run after a contraction already starts there by its own rule
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by END_ID, and how many each text has."""
        out_ids, out_n, some, chars = [], [], [], 0
        for text in [*texts, None]:
            if some and (text is None or chars > STEP_CHARS):
                ids, n = self._step(some)
                out_ids.append(ids)
                out_n.append(n)
                some, chars = [], 0
            if text is not None:
                some.append(text)
                chars += len(text)
        return (np.concatenate([np.zeros(0, np.uint32), *out_ids]), np.concatenate([np.zeros(0, np.int64), *out_n]))

    def _step(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.words > REMEMBERED:
            self._forget()
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc_at = np.cumsum(lens) - lens
        kind = self.classes[np.minimum(cp, 0x3000)]
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(doc_at, np.flatnonzero(kind == UNSURE), "right") - 1] = True
        odd |= np.fromiter((any(a in t for a in self.added) for t in texts), bool, len(texts))
        if odd.any():
            whole = {}
            plain = [i for i in range(len(texts)) if not odd[i]]
            ids, n = self._step([texts[i] for i in plain]) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            cuts = dict(zip(plain, np.split(ids, np.cumsum(n)[:-1]) if plain else [], strict=True))
            for i in np.flatnonzero(odd):
                e = self.library.encode(texts[i], add_special_tokens=False)
                whole[i] = np.array([*e.ids, END_ID], np.uint32)
            parts = [whole[i] if i in whole else cuts[i] for i in range(len(texts))]
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        if not len(cp):
            return np.full(len(texts), END_ID, np.uint32), np.ones(len(texts), np.int64)
        starts = self._starts(cp, kind, doc_at)
        wide = 1 + (cp >= 0x80).astype(np.int32) + (cp >= 0x800)
        at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(wide, out=at[1:])
        offsets = np.append(at[starts], at[-1]).astype(np.int32)
        raw = "".join(texts).encode("utf-8")
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        kinds = words.dictionary.to_numpy(zero_copy_only=False)
        if new := [w for w in kinds if w not in self.index]:
            self._learn(new)
        of = np.fromiter(map(self.index.__getitem__, kinds), np.int64, len(kinds))[words.indices.to_numpy()]
        # ids of all words in order, with room for each document's end id
        per_word = self.begin[of + 1] - self.begin[of]
        total = np.zeros(len(of) + 1, np.int64)
        np.cumsum(per_word, out=total[1:])
        until = np.searchsorted(starts, doc_at + lens)  # words before each document's end
        n = np.diff(total[until], prepend=0)
        ends = total[until] + np.arange(len(texts))
        ids = np.empty(int(total[-1]) + len(texts), np.uint32)
        gap = np.ones(len(ids), bool)
        gap[ends] = False
        ids[ends] = END_ID
        place = np.repeat(self.begin[of] - total[:-1], per_word)
        place += np.arange(len(place))
        ids[gap] = self.ids[place]
        return ids, n + 1


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_shard(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escapes = simple8b.encode(ids)
    head = np.array([len(doc_ids), len(ids), len(words), len(offsets), len(escapes), simple8b.BLOCK], np.uint64)
    return b"".join([
        MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], np.int64).tobytes(),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.asarray(sizes, np.int64).tobytes(),
        offsets.tobytes(), escapes.tobytes(), words.tobytes()])


def unpack_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, ids per document and all ids of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, n, words, offsets, escapes, block = np.frombuffer(data, np.uint64, 6, 8).astype(int).tolist()
    at = 56

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    doc_ids, known, sizes = take(np.int64, docs), take(np.uint8, docs), take(np.int64, docs)
    offs, escs, ws = take(np.int64, offsets), take(np.uint64, escapes), take(np.uint64, words)
    ids = simple8b.decode(ws, offs, escs, n, block).astype(np.uint32)
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], sizes, ids


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file, visible under its name only when complete; a retried task writes the same."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    import uuid

    part = f"{posixpath.dirname(path)}/.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def write_token_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                    shard_bytes: int = SHARD_BYTES) -> str:
    """Encode ``docs`` and write shard files in ascending id order; returns their folder."""
    spark = docs.sparkSession
    folder = fresh_folder(spark, "token-shards")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    size = rows.agg(F.sum(F.octet_length("txt"))).first()[0] or 0
    ranged = rows.repartitionByRange(max(1, -(-size // shard_bytes)), "id").sortWithinPartitions("id", "txt")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, doc_ids, sizes, ids = _encoder(tokenizer), [], [], []
        for b in batches:
            i, n = encoder.encode(b.column("txt").to_pylist())
            doc_ids += b.column("id").to_pylist()
            sizes.append(n)
            ids.append(i.astype(np.uint16) if len(i) and i.max() < 1 << 16 else i)
        if doc_ids:
            k = TaskContext.get().partitionId()
            put_file(f"{uri}/shard-{k:08d}.s8b", pack_shard(doc_ids, np.concatenate(sizes), np.concatenate(ids)))
            yield pa.RecordBatch.from_pydict({"shard": [k], "docs": [len(doc_ids)]})

    ranged.mapInArrow(write, "shard long, docs long").agg(F.sum("docs")).collect()
    return uri


def read_token_ids(spark, folder: str) -> DataFrame:
    """One row per document in file order: shard, place in it, doc id, ids of the documents
    before it over all shards (``start``), ``n_tokens`` and the checksum of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                doc_ids, sizes, ids = unpack_shard(data.as_buffer())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - s):4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                shard = int(posixpath.basename(path).split("-")[1].split(".")[0])
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(doc_ids), pa.int64()), pa.array(np.arange(len(doc_ids))),
                    pa.array(doc_ids, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["shard", "place", "doc_id", "within", "n_tokens", "ids_crc32"])
                del data, ids, raw
        release_memory()  # here, after the encoding on the same workers: between its tasks the memory is taken up again

    schema = "shard long, place long, doc_id long, within long, n_tokens long, ids_crc32 long"
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
             if _has_files(folder) else spark.createDataFrame([], "path string, content binary"))
    docs = pin(files.select("path", "content").mapInArrow(read, schema), "token-docs")
    # one row per shard file, not per document, meets in this window
    shards = docs.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    base = shards.select("shard", (F.sum("ids").over(W.orderBy("shard")) - F.col("ids")).alias("base"))
    return (docs.join(base, "shard")
            .select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard", "place"))


def _has_files(folder: str) -> bool:
    fs, path = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return any(f.path.endswith(".s8b") for f in found)
