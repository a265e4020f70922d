"""Cross-tokenizer alignment: texts are divided at byte offsets where tokens of both tokenizers end.

Tokenizer A (byte-level BPE, ``tokenizers``) reads a blank and the text, tokenizer B (BPE with byte
fallback, ``sentencepiece``) the text, before which it puts a blank itself. An interval holds the
tokens of both over the same bytes. It is divided at the common end nearest to its middle A token,
found by bisecting B's ends, and both halves go on; an interval without a common end inside is a
group. All intervals of one depth are handled at once in numpy (``divide``).

Words repeat, so a text is first cut where both tokenizers surely end a token: before a blank or a
line end that follows a visible character, after a single line end, and before a mark that follows a
letter and that no piece of B holds there. No pre-token of A and no piece of B reaches over such a place, so the parts can be encoded and divided one by one, and every
different part only once per worker (``Aligner``). Where a tokenizer gives no such certainty, the whole
text is one part.

Texts are encoded and divided once; their ids and group sizes are written as packed columns. Two cheap
passes read them: the first counts in how many documents each (A id, B id) pair is linked, the second
adds the counts up per document. Counts of the pairs held by most documents, at most ``KNOWN_PAIRS``, go
to the tasks as files in the shared folder; links of the other pairs, which few documents hold, are
joined by Spark. Both ways give the same sums.

Cases: a null or empty text, and a text whose tokens do not spell its bytes in either tokenizer, has no
tokens: zeros and an empty group text. Repeated rows and ids stay rows of their own, and each counts
as a document; ids may be null. An empty table gives no rows. Strings of special tokens are ordinary
text. Texts are never cut short; a text of any length only takes more steps. Ties of the highest count
are all best. Other columns of the input play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from exprmat.llm.common import fresh_folder, pin, session_conf

#: Bytes of text per vectorised step, and different parts a worker remembers before it starts anew.
STEP_BYTES = 3 << 20
REMEMBERED = 180_000
#: Parts longer than this are not remembered.
LONG_PART = 200
#: A part that may be a line among others: no white space but a blank before it, visible at both ends.
LINE = re.compile("(?: ?[!-~À-ÿ](?:\\S*[!-~À-ÿ])?)")
#: Pairs whose counts every task reads (17 bytes each); links of rarer pairs are joined.
KNOWN_PAIRS = 3_000_000
#: Rows that reach a task at once, and tokens of A whose links are laid out at once.
ROWS = 256
STEP_TOKENS = 1 << 19


def divide(ends_a: np.ndarray, ends_b: np.ndarray, a0, a1, b0, b1) -> tuple[np.ndarray, ...]:
    """Divide intervals of tokens ``a0:a1`` and ``b0:b1`` at their common ends; the groups in order.

    ``ends_a`` and ``ends_b`` are the rising byte offsets where tokens end. Every round looks at the
    open intervals' ends near the middle; the first probes go one by one to both sides, then
    all other inner ends of the intervals left are bisected together and the nearest hit is taken.
    """
    open_ = np.stack([np.asarray(x, np.int64) for x in (a0, a1, b0, b1)])
    leaves = []
    while open_.shape[1]:
        single = (open_[1] - open_[0] < 2) | (open_[3] - open_[2] < 2)
        leaves.append(open_[:, single])
        open_ = open_[:, ~single]
        left, right = open_[0], open_[1] - 1  # inner ends: left .. right - 1
        middle = (left + right - 1) >> 1
        cut_a = np.full(len(left), -1)
        cut_b = np.zeros(len(left), np.int64)
        todo = np.arange(len(left))
        for step in (0, -1, 1, -2, 2):
            at = middle[todo] + step
            ok = (at >= left[todo]) & (at < right[todo])
            rows, at = todo[ok], at[ok]
            place = np.searchsorted(ends_b, ends_a[at])
            hit = ends_b[place] == ends_a[at]
            cut_a[rows[hit]], cut_b[rows[hit]] = at[hit], place[hit]
            todo = todo[cut_a[todo] < 0]
        todo = todo[right[todo] - left[todo] > 5]
        if len(todo):
            many = right[todo] - left[todo]
            begin = np.cumsum(many) - many
            at = np.repeat(left[todo] - begin, many) + np.arange(int(many.sum()))
            place = np.searchsorted(ends_b, ends_a[at])
            far = np.abs(at - np.repeat(middle[todo], many))
            far = np.where(ends_b[place] == ends_a[at], 2 * far + (at > np.repeat(middle[todo], many)), np.int64(1) << 60)
            best = np.minimum.reduceat(far, begin)
            some = best < 1 << 60
            rows, best = todo[some], best[some]
            cut_a[rows] = middle[rows] + np.where(best & 1, best >> 1, -(best >> 1))
            cut_b[rows] = np.searchsorted(ends_b, ends_a[cut_a[rows]])
        whole = cut_a < 0
        leaves.append(open_[:, whole])
        o, ca, cb = open_[:, ~whole], cut_a[~whole] + 1, cut_b[~whole] + 1
        open_ = np.concatenate([np.stack([o[0], ca, o[2], cb]), np.stack([ca, o[1], cb, o[3]])], axis=1)
    out = np.concatenate(leaves, axis=1) if leaves else open_
    return tuple(out[:, np.argsort(out[0], kind="stable")])


def linked(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the A and B tokens whose byte ranges overlap: one pair per stretch between
    neighbouring ends of either kind, which lies within one token of each."""
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes a byte that is visible in Latin-1 as itself, the others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def _joined(values: pa.StringArray, ends: np.ndarray, by: str) -> pa.StringArray:
    """Neighbouring values up to each end as one string."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), by)


class _Flat:
    """Rows of different lengths kept end to end in one growing array."""

    def __init__(self, dtype: type):
        self.data = np.zeros(1 << 12, dtype)
        self.at = np.zeros(1, np.int64)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.at[-1])
        while used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[used:used + len(values)] = values
        self.at = np.concatenate([self.at, used + np.cumsum(sizes)])

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of rows ``which`` end to end, and how many each row has."""
        begin, sizes = self.at[which], self.at[which + 1] - self.at[which]
        total = np.cumsum(sizes)
        place = np.repeat(begin - total + sizes, sizes) + np.arange(int(total[-1]) if len(total) else 0)
        return self.data[place], sizes


def _width(lengths: np.ndarray) -> type:
    return np.uint16 if len(lengths) <= 1 << 16 else np.uint32


class Aligner:
    """Encodes and divides the parts of texts, remembering the parts met so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_of()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        self.can_cut = self._parts_are_safe(pieces)
        self.mark = self._marks_after_letters(pieces)
        self.forget()

    def _parts_are_safe(self, pieces: list[str]) -> bool:
        plain = all("▁" not in p.lstrip("▁") and "\n" not in p for p in pieces)
        mark = self.b.encode("\n")
        same = plain and len(mark) == 2 and self.bytes_b[mark[0]] + self.bytes_b[mark[1]] == b" \n"
        back = b"".join(self.bytes_b[i] for i in self.b.encode(" a  ﬁ\n\n b "))
        first = self.a.encode("\n", add_special_tokens=False).ids
        self.end_a, self.end_b = first[0], mark[-1]
        return (same and len(first) == 1 and back == "  a  ﬁ\n\n b ".encode() and self.a.normalizer is None
                and "ByteLevel" in repr(self.a.pre_tokenizer))

    @staticmethod
    def _marks_after_letters(pieces: list[str]) -> np.ndarray:
        """Which ASCII marks no piece of B holds right after a letter, so that none reaches over."""
        out = np.zeros(256, bool)
        out[[ord(c) for c in ".,;:!?()[]{}\"|/"]] = True
        for p in pieces:
            for x, y in zip(p[:-1], p[1:], strict=True):
                if x.isalpha() and y.isascii():
                    out[ord(y)] = False
        return out

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.ids_a, self.ids_b = _Flat(_width(self.len_a)), _Flat(_width(self.len_b))
        self.per_a, self.per_b = _Flat(np.uint32), _Flat(np.uint32)  # tokens per group

    def _lines(self, parts: list[str]) -> list[np.ndarray]:
        """Ids and how many each part has, of A and of B: the parts are encoded as lines of one text."""
        out: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(0, len(parts), 400):
            some = parts[at:at + 400]
            text = "\n" + "\n".join(some)
            ids_a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ids_b = np.array(self.b.encode(text)[1:], np.int64)  # the first is the blank put before
            for k, (ids, end) in enumerate(((ids_a, self.end_a), (ids_b, self.end_b))):
                cuts = np.flatnonzero(ids == end)
                if len(cuts) != len(some):
                    raise ValueError("a tokenizer joins line ends to what stands beside them")
                out[2 * k].append(ids[ids != end])
                out[2 * k + 1].append(np.diff(cuts, append=len(ids)) - 1)
        return [np.concatenate(x) for x in out]

    def _alone(self, parts: list[str]) -> list[np.ndarray]:
        """The same, part by part."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        skip = 2 if self.can_cut else 0  # read after a line end, whose blank and byte come first
        ids_b = [e[skip:] for e in self.b.encode(["\n" + p if skip else p[1:] for p in parts], num_threads=1)]
        out = []
        for ids in (ids_a, ids_b):
            n = np.fromiter(map(len, ids), np.int64, len(parts))
            out += [np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n]
        return out

    def learn(self, parts: list[str]) -> None:
        """Tokens, groups and links of parts not met before. Parts without white space but one blank before
        them are encoded as lines of one text, the others one by one."""
        lines = [p for p in parts if self.can_cut and LINE.fullmatch(p)]
        if lines:
            self._learn(lines, *self._lines(lines))
        if len(lines) < len(parts):
            known = set(lines)
            rest = [p for p in parts if p not in known]
            self._learn(rest, *self._alone(rest))

    def _learn(self, parts: list[str], flat_a: np.ndarray, na: np.ndarray, flat_b: np.ndarray, nb: np.ndarray) -> None:
        raw = "".join(parts).encode()
        good = np.ones(len(parts), bool)
        size = np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in parts), np.int64, len(parts))
        for flat, n, lens, spelt in ((flat_a, na, self.len_a, self.bytes_a), (flat_b, nb, self.len_b, self.bytes_b)):
            total = np.concatenate([[0], np.cumsum(lens[flat])])
            upto = np.cumsum(n)
            good &= total[upto] - total[upto - n] == size
            if b"".join([spelt[i] for i in flat.tolist()]) != raw:
                ids = np.split(flat, upto[:-1])
                good &= np.fromiter((p.encode() == b"".join([spelt[i] for i in x.tolist()]) for p, x in zip(parts, ids, strict=True)), bool, len(parts))
        if not good.all():
            flat_a, flat_b = flat_a[np.repeat(good, na)], flat_b[np.repeat(good, nb)]
            na, nb = np.where(good, na, 0), np.where(good, nb, 0)
        ends_a, ends_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        upto_a, upto_b = np.cumsum(na), np.cumsum(nb)
        some = na > 0
        a0, a1, b0, b1 = divide(ends_a, ends_b, (upto_a - na)[some], upto_a[some], (upto_b - nb)[some], upto_b[some])
        groups = np.bincount(np.searchsorted(upto_a, a0, "right"), minlength=len(parts))
        for flat, values, n in ((self.ids_a, flat_a, na), (self.ids_b, flat_b, nb), (self.per_a, a1 - a0, groups), (self.per_b, b1 - b0, groups)):
            flat.extend(values, n)
        self.good = np.concatenate([self.good, good])
        self.index.update(zip(parts, range(len(self.good) - len(parts), len(self.good)), strict=True))

    def parts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each part of all texts in order, and how many parts each text has."""
        if len(self.index) > REMEMBERED or int(self.ids_a.at[-1]) > 16 * REMEMBERED:
            self.forget()
        raw = b"".join([b" " + t for t in texts])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        start = np.zeros(len(raw), bool)
        if self.can_cut:
            c = np.frombuffer(raw, np.uint8)
            shown = (c > 32) & (c < 127)  # visible for sure: ASCII, and U+00C0 to U+00FF
            after, first = shown.copy(), shown | (c == 0xC3)
            after[1:] |= (c[1:] >= 0x80) & (c[:-1] == 0xC3)
            start[1:] = after[:-1] & ((c[1:] == 32) | (c[1:] == 10))
            letter = ((c | 32) >= 97) & ((c | 32) <= 122)
            letter[1:] |= (c[:-1] == 0xC3) & (c[1:] != 0x97) & (c[1:] != 0xB7)
            start[1:] |= letter[:-1] & self.mark[c[1:]]
            start[2:] |= after[:-2] & (c[1:-1] == 10) & first[2:]
        start[np.cumsum(sizes) - sizes] = True
        begin = np.flatnonzero(start)
        if len(raw) >= 1 << 31:
            raise ValueError("a text of 2 GB or more")
        words = pa.StringArray.from_buffers(
            len(begin), pa.py_buffer(np.append(begin, len(raw)).astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        kinds = words.dictionary.to_pylist()
        found = list(map(self.index.get, kinds))
        if new := [w for w, k in zip(kinds, found, strict=True) if k is None]:
            self.learn(new)
            found = list(map(self.index.__getitem__, kinds))
            for w in new:
                if len(w) > LONG_PART:
                    del self.index[w]
        of = np.array(found, np.int64)[words.indices.to_numpy(zero_copy_only=False)]
        counts = np.diff(np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)])))
        return of, counts


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of some documents at a time, at most about ``STEP_BYTES``."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            t = t.as_py() or b""
            if texts and size + len(t) > STEP_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t) + 1
    if texts:
        yield ids, texts


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _whole(al: Aligner, texts: list[bytes], of: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which texts have tokens: not empty, and every part spelt by both tokenizers."""
    bad = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=~al.good[of], minlength=len(texts)) > 0
    return ~bad & (np.fromiter(map(len, texts), np.int64, len(texts)) > 0)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


TOKENS = "id long, n_a long, n_b long, n_groups long, a binary, b binary, per_a binary, per_b binary"


def tokens_of(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Per document: its tokens of both, and the groups they are divided into, as little-endian numbers: ids of
    2 bytes (4 where a vocabulary is larger), tokens per group of 1 byte (4 where a group has more than 255)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligner(path_a, path_b)
        for ids, texts in _steps(batches):
            of, counts = al.parts(texts)
            whole = _whole(al, texts, of, counts)
            of = of[np.repeat(whole, counts)]
            ends = np.cumsum(np.where(whole, counts, 0))
            columns, sizes = [], []
            for flat in (al.ids_a, al.ids_b, al.per_a, al.per_b):
                values, n = flat.rows(of)
                upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends])]
                sizes.append(np.diff(upto))
                cuts = list(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True))
                if values.dtype == np.uint32 and flat in (al.per_a, al.per_b):
                    columns.append([(x if x.max(initial=0) > 255 else x.astype(np.uint8)).tobytes() for x in (values[i:j] for i, j in cuts)])
                else:
                    columns.append([values[i:j].tobytes() for i, j in cuts])
            numbers = [pa.array(x.astype(np.int64)) for x in sizes[:3]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *numbers, *(pa.array(c, pa.binary()) for c in columns)],
                                             names=["id", "n_a", "n_b", "n_groups", "a", "b", "per_a", "per_b"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, TOKENS)


def _numbers(b: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(name).to_pylist()), kind).astype(np.int64)


def _groups(b: pa.RecordBatch, name: str) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint8 if len(x) == n else np.uint32).astype(np.int64)
             for x, n in zip(b.column(name).to_pylist(), b.column("n_groups").to_pylist(), strict=True)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _token_steps(al: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some documents at a time, at most about ``STEP_TOKENS`` tokens of A; what the encoder remembered goes."""
    al.forget()
    for b in batches:
        at = np.concatenate([[0], np.cumsum(b.column("n_a").to_numpy())])
        begin = 0
        while begin < b.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + STEP_TOKENS, "right")) - 1)
            yield b.slice(begin, end - begin)
            begin = end


def _links_of(al: Aligner, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all links of some documents in order, and how many each document has."""
    a, t = _numbers(b, "a", _width(al.len_a)), _numbers(b, "b", _width(al.len_b))
    at_a, at_b = linked(np.cumsum(al.len_a[a]), np.cumsum(al.len_b[t]))
    upto = np.searchsorted(at_a, np.concatenate([[0], np.cumsum(b.column("n_a").to_numpy())]))
    return a[at_a] << 32 | t[at_b], np.diff(upto)


def count_pairs(tokens: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``pair`` (A id << 32 | B id) and the number of documents that hold it linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligner(path_a, path_b)
        held, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in _token_steps(al, batches):
            pairs, n = _links_of(al, b)
            kinds, number = np.unique(pairs, return_inverse=True)
            once = _distinct(np.repeat(np.arange(len(n)), n) << 32 | number)
            more = np.bincount(once & 0xFFFFFFFF, minlength=len(kinds))
            both = np.concatenate([held, kinds])
            order = np.argsort(both, kind="stable")
            both, added = both[order], np.concatenate([times, more])[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            held, times = both[first], np.add.reduceat(added, first) if len(first) else added
            if len(held) > KNOWN_PAIRS // 4:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(times)], names=["pair", "docs"])
                held, times = held[:0], times[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(times)], names=["pair", "docs"])

    return tokens.select("n_a", "a", "b").mapInArrow(count, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def _write_known(counted: DataFrame, known_pairs: int) -> tuple[str, int]:
    """Files of the pairs held by at least so many documents that at most ``known_pairs`` are left,
    and that number of documents. ``counted`` has pair, docs and best."""
    spark = counted.sparkSession
    # pairs by the power of two of their number of documents: at most 64 rows
    steps = dict(counted.groupBy((F.length(F.bin("docs")) - 1).alias("power")).count().collect())
    least, total = 1 << 62, 0
    for power in sorted(steps, reverse=True):
        if total + steps[power] > known_pairs:
            break
        least, total = 1 << power, total + steps[power]
    folder = fresh_folder(spark, "known-pairs")
    counted.where(F.col("docs") >= least).write.parquet(folder)
    return folder, least  # every pair is in the files when this is 1


_KNOWN: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _known(folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order, their documents, and whether they are their A id's most frequent."""
    if folder not in _KNOWN:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        _KNOWN.clear()
        fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")]
        tables = [pq.read_table(f, filesystem=fs, columns=["pair", "docs", "best"]) for f in sorted(files)]
        t = pa.concat_tables(tables) if tables else pa.table({"pair": pa.array([], pa.int64()), "docs": pa.array([], pa.int64()), "best": pa.array([], pa.bool_())})
        pair = t.column("pair").to_numpy()
        order = np.argsort(pair)
        _KNOWN[folder] = pair[order], t.column("docs").to_numpy()[order], t.column("best").to_numpy()[order]
    return _KNOWN[folder]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """Per document: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2,b3``),
    ``n_best`` (links whose pair is the A id's most frequent) and ``count_sum`` (documents holding each
    link's pair, added over the links)."""
    spark = docs.sparkSession
    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(ROWS)):
        tokens = pin(tokens_of(docs, path_a, path_b, id_col, text_col), "aligned-tokens")
        counted = pin(count_pairs(tokens, path_a, path_b), "pair-counts")
        top = counted.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
        counted = pin(counted.withColumn("a", F.shiftright("pair", 32)).join(top, "a")
                      .select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-best")
        folder, least = _write_known(counted, known_pairs)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            al = _aligner(path_a, path_b)
            known, times, best = _known(folder)
            for b in _token_steps(al, batches):
                pairs, n = _links_of(al, b)
                kinds, number = np.unique(pairs, return_inverse=True)
                at = np.minimum(np.searchsorted(known, kinds), max(len(known) - 1, 0))
                hit = known[at] == kinds if len(known) else np.zeros(len(kinds), bool)
                docs_of = np.where(hit, times[at], 0) if len(known) else np.zeros(len(kinds), np.int64)
                is_best = hit & best[at] if len(known) else hit
                upto = np.concatenate([[0], np.cumsum(n)])
                added = [np.diff(np.concatenate([[0], np.cumsum(x[number])])[upto]) for x in (is_best, docs_of)]
                texts = [_joined(pa.array(_numbers(b, c, _width(lens))).cast(pa.string()), np.cumsum(_groups(b, f"per_{c}")), ",")
                         for c, lens in (("a", al.len_a), ("b", al.len_b))]
                spelt = _joined(pc.binary_join_element_wise(*texts, "|"), np.cumsum(b.column("n_groups").to_numpy()), ";")
                rare: list = [[]] * len(n)
                if not hit.all():
                    loose = ~hit[number]
                    cuts = np.concatenate([[0], np.cumsum(loose)])[upto].tolist()
                    found = pairs[loose]
                    rare = [found[i:j].tolist() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("n_a"), b.column("n_b"), b.column("n_groups"), pa.array(n), *(pa.array(x) for x in added),
                     spelt, pa.array(rare, pa.list_(pa.int64()))],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "rare"])

        schema = ("id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                  "groups string, rare array<long>")
        out = tokens.mapInArrow(sums, schema)
        if least > 1:
            out = pin(out.withColumn("row", F.monotonically_increasing_id()), "aligned")
            links = out.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").count()
            more = links.join(counted.where(F.col("docs") < least), "pair").groupBy("row").agg(
                F.sum(F.when(F.col("best"), F.col("count")).otherwise(0)).alias("b"), F.sum(F.col("count") * F.col("docs")).alias("s"))
            out = out.join(more, "row", "left").withColumns({
                "n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))})
        return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
