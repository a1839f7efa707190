"""Substring dedup by recompression.

A window is ``size`` consecutive words of a document; a word is removed when a window over
it also starts in a document with a smaller doc_id.

Recompression names words, then in rounds names maximal runs of one symbol and pairs of a
left and a right symbol (a bit of each symbol's name deals the sides).  Names are hashes of
what they stand for, so they are global: every task gives equal substrings the same interior
symbols.  For every symbol the words that decided it are known (its context); a symbol whose
context lies inside a window is the same wherever that window's words stand.  So each window
takes as its anchor the highest symbol it decides (of several, the one with the least hash),
and equal windows meet under the hash of the anchor's context in one shuffle, where 48 more
bits of a hash of the whole window verify them.  Consecutive windows share their anchor, so what is shuffled
is one record for a run of windows, packed by task and bucket.

Before the shuffle each task resolves what it can see: of equal windows it sends only those
of its smallest doc_id, so a group of copies costs a record a task and bucket, not one a
copy.  Positions come back by document and are applied in a join on doc_id.

Defined cases: a null text has no words; a document shorter than a window keeps all; rows
with the same doc_id do not remove each other's words; rows without doc_id keep all and
remove nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.llm.common import arrow, fresh, map_rows, map_texts, slices, texts
from landshift.llm.near_dedup import PRIME_MIX, mixed, word_hashes

ROUNDS = 2
#: Buckets of anchors at least: a document's marks come back in a row for each bucket that has one.
BUCKETS = 256
#: Words that a task names at one time.
CHUNK = 350_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RECORDS = "bucket int, doc_id long, tag int, starts binary, payload binary"
MARKS = "doc_id long, tag int, starts binary"


class Symbols:
    """A level of the parse over some documents' words: names, and the first and last word of each context."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.name, self.low, self.high, self.doc = name, low, high, doc
        self.first, self.last = first, last  # of each document: its first word less one, its last word plus one

    def before(self) -> np.ndarray:
        """Where the context of the symbol to the left starts; outside the document if there is none."""
        out = np.empty_like(self.low)
        out[1:] = self.low[:-1]
        edge = np.flatnonzero(np.diff(self.doc, prepend=-1))
        out[edge] = self.first[self.doc[edge]]
        return out

    def after(self) -> np.ndarray:
        out = np.empty_like(self.high)
        out[:-1] = self.high[1:]
        edge = np.flatnonzero(np.diff(self.doc, append=-1))
        out[edge] = self.last[self.doc[edge]]
        return out

    def runs(self, salt: int) -> Symbols:
        """Names maximal runs.  A symbol depends on its neighbours: they differ from it."""
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(new)) - 1
        length = (stop - start + 1).astype(np.uint64)
        name = self.name[start]
        name = np.where(length > 1, mixed(name * PRIME_MIX + length + np.uint64(salt)), name)
        return Symbols(name, self.before()[start], self.after()[stop], self.doc[start], self.first, self.last)

    def pairs(self, salt: int) -> Symbols:
        """Names pairs of a left and a right symbol.  One that stays alone depends on the neighbour it might have joined."""
        left = (mixed(self.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(left), bool)
        joins[:-1] = left[:-1] & ~left[1:] & (self.doc[1:] == self.doc[:-1])
        second = np.zeros(len(left), bool)
        second[1:] = joins[:-1]
        low = np.where(~left & ~second, self.before(), self.low)
        high = np.where(left & ~joins, self.after(), self.high)
        high[:-1] = np.where(joins[:-1], self.high[1:], high[:-1])
        name = self.name.copy()
        at = np.flatnonzero(joins)
        name[at] = mixed(self.name[at] * PRIME_MIX + self.name[at + 1] + np.uint64(salt))
        keep = ~second
        return Symbols(name[keep], low[keep], high[keep], self.doc[keep], self.first, self.last)


def levels(words: np.ndarray, sizes: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The parse of the documents' words, from the words themselves upward."""
    at, doc, ends = np.arange(len(words)), np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    out = [Symbols(words, at, at, doc, ends - sizes - 1, ends)]
    for k in range(rounds):
        out.append(out[-1].runs(2 * k + 1).pairs(2 * k + 2))
    return out


def anchors(parse: list[Symbols], starts: np.ndarray, size: int) -> np.ndarray:
    """For each window its anchor: the symbol's place times the number of levels, and its level."""
    which = np.zeros(len(starts), np.int64)
    open_ = np.arange(len(starts))
    for level in range(len(parse) - 1, -1, -1):
        s, here = parse[level], starts[open_]
        begin = np.searchsorted(s.low, here)
        count = np.searchsorted(s.high, here + size - 1, side="right") - begin
        best, rank = begin.copy(), np.append(mixed(s.name ^ PRIME_MIX), np.uint64(0))
        least = rank[np.minimum(begin, len(s.name))]
        for k in range(1, int(count.max(initial=0))):
            more = np.flatnonzero(count > k)
            r = rank[begin[more] + k]
            less = r < least[more]
            best[more[less]], least[more[less]] = begin[more[less]] + k, r[less]
        has = count > 0
        which[open_[has]] = best[has] * len(parse) + level
        open_ = open_[~has]
        if not len(open_):
            break
    return which


def context_names(parse: list[Symbols], words: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Hashes of the words of the anchors' contexts."""
    out = np.zeros(len(which), np.uint64)
    low, high = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
    for level, s in enumerate(parse):
        mine = np.flatnonzero(which % len(parse) == level)
        low[mine], high[mine] = s.low[which[mine] // len(parse)], s.high[which[mine] // len(parse)]
    open_ = np.arange(len(which))
    while len(open_):
        out[open_] = mixed(out[open_] * PRIME_MIX + words[low[open_]])
        low[open_] += 1
        open_ = open_[low[open_] <= high[open_]]
    return out


def window_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        h = mixed(h * PRIME_MIX + words[k : k + len(h)])
    return h[starts]


def cut48(hashes: np.ndarray) -> bytes:
    """The low 48 bits of each."""
    return hashes.astype("<u4").tobytes() + (hashes >> np.uint64(32)).astype("<u2").tobytes()


def joined48(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4", n, at).astype(np.uint64) | np.frombuffer(raw, "<u2", n, at + 4 * n).astype(np.uint64) << np.uint64(32)


def grouped(docs: np.ndarray, starts: np.ndarray) -> list[tuple[int, bytes]]:
    """(document, its starts as 32-bit integers) of pairs in any order."""
    if not len(docs):
        return []
    order = np.argsort(docs, kind="stable")
    docs, starts = docs[order], starts[order].astype("<u4")
    cuts = np.flatnonzero(np.diff(docs)) + 1
    return [(int(d), part.tobytes()) for d, part in zip(docs[np.r_[0, cuts]], np.split(starts, cuts), strict=True)]


def records(ids: np.ndarray, tags: np.ndarray, found: list[np.ndarray], size: int, buckets: int):
    """Rows of RECORDS for one chunk: (bucket, None, None, None, payload), and (negative bucket, doc_id, tag, starts, None) for what it resolves."""
    order = np.argsort(ids, kind="stable")
    ids, tags, found = ids[order], tags[order], [found[k] for k in order]
    sizes = np.array([len(x) for x in found])
    words = np.concatenate(found)
    n_windows = np.maximum(sizes - size + 1, 0)
    doc = np.repeat(np.arange(len(ids)), n_windows)
    offset = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    starts = (np.cumsum(sizes) - sizes)[doc] + offset
    if not len(starts):
        return
    whole = window_hashes(words, starts, size)
    by = np.argsort(whole, kind="stable")  # so the smallest doc_id of equal windows comes first
    new = np.diff(whole[by], prepend=whole[by[0]] ^ np.uint64(1)) != 0
    owner = np.empty(len(by), np.int64)
    owner[by] = ids[doc[by[np.flatnonzero(new)]]][np.cumsum(new) - 1]
    here = owner == ids[doc]
    for d, mine in grouped(doc[~here], offset[~here]):
        yield -1 - int(ids[d]) % buckets, int(ids[d]), int(tags[d]), mine, None
    parse = levels(words, sizes)
    which = anchors(parse, starts[here], size)
    whole, doc, offset = whole[here], doc[here], offset[here]
    breaks = np.flatnonzero((np.diff(which, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0) | (np.diff(offset, prepend=-2) != 1))
    count = np.diff(np.append(breaks, len(which)))
    name, doc_of, at = context_names(parse, words, which[breaks]), doc[breaks], offset[breaks]
    bucket = (name >> np.uint64(24)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    squeeze = zstandard.ZstdCompressor(level=1)
    for b in range(buckets):
        mine = order[edges[b] : edges[b + 1]]
        if not len(mine):
            continue
        n = count[mine]
        each = np.repeat(breaks[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        used, index = np.unique(doc_of[mine], return_inverse=True)
        same = np.diff(index, prepend=0) == 0
        step = np.where(same, np.diff(at[mine], prepend=0), at[mine]).astype("<i4")
        small = b"".join(x.tobytes() for x in (np.diff(ids[used], prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.copy(), tags[used].astype("<u4"), index.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy(), step.view(np.uint8).reshape(-1, 4).T.copy(), n.astype("<u2")))
        small = squeeze.compress(small)
        head = np.array([len(mine), len(used), len(each), len(small)], "<u4").tobytes()
        yield b, None, None, None, head + small + cut48(name[mine]) + cut48(whole[each])


def opened(payload: bytes) -> tuple[np.ndarray, ...]:
    """doc_id, tag, start and the two names (of the anchor, of the window; 48 bits each) of each window of a payload."""
    m, n_docs, total, length = np.frombuffer(payload, "<u4", 4).tolist()
    small = zstandard.ZstdDecompressor().decompress(payload[16 : 16 + length])
    at = 0

    def take(dtype: str, n: int, planes: bool = False) -> np.ndarray:
        nonlocal at
        width = np.dtype(dtype).itemsize
        raw = np.frombuffer(small, np.uint8, width * n, at)
        at += width * n
        return (np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1) if planes else raw).view(dtype)

    ids, tags = np.cumsum(take("<i8", n_docs, True)), take("<u4", n_docs)
    index, step, n = take("<u4", m, True).astype(np.int64), take("<i4", m, True).astype(np.int64), take("<u2", m).astype(np.int64)
    name, check = joined48(payload, m, 16 + length), joined48(payload, total, 16 + length + 6 * m)
    first = np.diff(index, prepend=-1) != 0
    first[:1] = True
    run = np.cumsum(step)
    base = np.repeat((run - step)[first], np.diff(np.append(np.flatnonzero(first), m)))
    start = np.where(np.arange(m) == 0, step, run - base)
    of = np.repeat(np.arange(m), n)
    inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    return ids[index][of], tags[index][of].astype(np.int64), start[of] + inside, name[of], check


def resolved(payloads: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(doc_id, tag, starts) of the windows of one bucket that a smaller doc_id has too."""
    parts = [opened(p) for p in payloads]
    ids, tags, starts, name, check = (np.concatenate([p[k] for p in parts]) for k in range(5))
    order = np.lexsort((name, check))
    name, check = name[order], check[order]
    first = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (check[1:] != check[:-1])))
    least = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(order))))
    gone = order[ids[order] > least]
    key, back = np.unique(np.stack([ids[gone], tags[gone]]), axis=1, return_inverse=True)
    return [(int(key[0, d]), int(key[1, d]), mine) for d, mine in grouped(back.reshape(-1), starts[gone])]


def marks(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, tag and the starts of removed windows, several rows a document."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS, 4 * partitions)
    sent, told = arrow(RECORDS), arrow(MARKS)

    def send(batches):
        ids, tags, found, held = [], [], [], 0

        def flush():
            rows = records(np.array(ids, np.int64), np.array(tags, np.int64), found, size, buckets)
            held_rows, weight = [], 0
            for row in rows:
                held_rows.append(row)
                weight += len(row[4] or row[3])
                if weight > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held_rows, strict=True), sent, strict=True)], schema=sent)
                    held_rows, weight = [], 0
            if held_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held_rows, strict=True), sent, strict=True)], schema=sent)

        for whole in batches:
            for batch in slices(whole):
                for i, t, x in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    words = (x or b"").split()
                    if len(words) < size:
                        continue
                    ids.append(i)
                    tags.append(t)
                    found.append(word_hashes(words))
                    held += len(words)
                    if held >= CHUNK:
                        yield from flush()
                        ids, tags, found, held = [], [], [], 0
        if found:
            yield from flush()

    def meet(batches):
        held, bucket = [], None
        for batch in batches:
            back = []
            for b, i, t, s, p in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if b < 0:
                    back.append((i, t, s))
                    continue
                if b != bucket and held:
                    back += resolved(held)
                    held = []
                bucket = b
                held.append(p)
            if back:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*back, strict=True), told, strict=True)], schema=told)
        if held and (back := resolved(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*back, strict=True), told, strict=True)], schema=told)

    packed = docs.where(F.col("doc_id").isNotNull()).mapInArrow(send, RECORDS)
    return packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, MARKS)


def without(text: bytes, gone: np.ndarray) -> bytes:
    """The text less the words that are gone, each with the white space after it."""
    spans = [m.span() for m in WORD.finditer(text)]
    ends = [s for s, _ in spans[1:]] + [len(text)]
    return (text[: spans[0][0]] if spans else b"") + b"".join(text[a:e] for (a, _), e, g in zip(spans, ends, gone, strict=True) if not g)


def marked(docs: DataFrame, size: int, name: str) -> DataFrame:
    """The documents with the column ``name``, the starts of their removed windows (null: none)."""
    doc, tag = fresh(docs, "doc_of_marks"), fresh(docs, "tag_of_marks")
    of = F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    found = marks(texts(docs, of.alias("tag")), size)
    found = found.groupBy(F.col("doc_id").alias(doc), F.col("tag").alias(tag)).agg(F.collect_list("starts").alias(name))  # of one document: at most its windows
    return docs.join(found, (F.col("doc_id").cast("long") == F.col(doc)) & (of == F.col(tag)), "left").drop(doc, tag)


def removed(n: int, starts: list[bytes], size: int) -> np.ndarray:
    """Which of n words lie in the windows."""
    depth = np.zeros(n + size + 1, np.int32)
    at = np.frombuffer(b"".join(starts), "<u4").astype(np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + size, -1)
    return np.cumsum(depth)[:n] > 0


def remove_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the kept words joined by one space."""

    def make():
        def one(text: bytes, starts: list[bytes] | None) -> tuple:
            words = text.split()
            if not starts:
                return len(words), 0, b" ".join(words).decode()
            gone = removed(len(words), starts, size)
            return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode()

        def run(batch, values):
            rows = [one(x or b"", s) for x, s in zip(values, batch.column("starts_of_marks").to_pylist(), strict=True)]
            return dict(zip(("n_words", "n_removed", "kept"), zip(*rows, strict=True), strict=True)) | {"doc_id": batch.column("doc_id")}

        return run

    return map_texts(texts(marked(docs.select("doc_id", "text"), size, "starts_of_marks"), "starts_of_marks"), make, "doc_id long, n_words long, n_removed long, kept string")


def cut_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """The documents, all their columns, with the removed words cut from ``text`` and ``n_chars`` (if there) made to follow.

    The white space after a removed word goes with it; a text that loses nothing stays as it
    is, and so does a null.
    """
    name = fresh(docs, "starts_of_marks")
    counted = "n_chars" in docs.columns
    both = docs.withColumns({"text": F.col("text").cast("string")} | ({"n_chars": F.col("n_chars").cast("long")} if counted else {}))

    def make():
        def run(batch, values):
            texts_, sizes = [], batch.column("n_chars").to_pylist() if counted else []
            for k, (raw, starts) in enumerate(zip(values, batch.column(name).to_pylist(), strict=True)):
                if raw is None or not starts:
                    texts_.append(raw and raw.decode())
                    continue
                texts_.append(without(raw, removed(len(raw.split()), starts, size)).decode())
                if counted:
                    sizes[k] = len(texts_[-1])
            texts_ = [None if raw is None else x or "" for raw, x in zip(values, texts_, strict=True)]
            return {"text": texts_} | ({"n_chars": sizes} if counted else {})

        return run

    out = map_rows(marked(both, size, name), make, "text string" + (", n_chars long" if counted else ""))
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in docs.schema))
