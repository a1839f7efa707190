"""LM scoring by cross-entropy difference.

Two bigram models, of target texts and of the whole corpus (the background), share one
vocabulary, the words of the corpus and an end of text, and are smoothed alike.  A word is a
run of letters and digits with A-Z lower-cased, a run of ASCII marks, or a line feed, so that
menus, symbols and line ends count as what they are and not only what stands between them:

    p(w) = (c(w) + a) / (N + a V),    p(w | v) = (c(v w) + KAPPA p(w)) / (c(v) + KAPPA),

where V is the vocabulary's size and a spreads WORDS counts over it, one to each word at
most; c(v) counts what follows v, so that probabilities sum to 1.  A document's score is the
mean over its words and its end of log p_target - log p_background.  A document's own counts
are taken out of the models that hold it before it is scored, so target texts and others are
scored alike.

Counts are exact for every word and pair of words of all documents, under keys of 64 bits.
Documents are packed to groups of about GROUP bytes of text.  Each group sends its distinct
keys with their counts to the buckets that the keys' first bits name; the number of buckets
grows with the corpus, so that each holds the keys of about BUCKET bytes of text.  A bucket
adds up the counts and gives each group the totals of its keys back; there the losses of
each document are added up.  No key is gathered in more than one row a group.

``n_words`` counts the words so defined, without the end.

Defined cases: a null or empty text has no words, losses of 0 and a score of 0, and counts
nowhere; repeated rows count and are scored each; rows without doc_id are scored and belong
to no target; every row of a target's doc_id is a target text; a text of any length is in
one group; without target texts the target model is uniform; an empty table gives an empty
one; other columns of the table are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.llm.common import LOWER_AZ, arrow, lists, slices, stored, texts
from landshift.llm.near_dedup import PRIME_MIX, mixed, word_hashes

#: Words, in a text of lower case: letters and digits, marks, line feeds.
TOKENS = re.compile(rb"[0-9a-z\x80-\xff]+|[!-/:-@\[-`{-~]+|\n")
#: Counts that smoothing adds to all words together, at most one to each.
WORDS = 1 << 18
KAPPA = 50.0
#: Bytes of text that are counted and scored at one time, and that a bucket's keys come from.
GROUP, BUCKET = 8_000_000, 16_000_000
#: Bytes of a text that are cut to words, and places that are scored, at one time.
PIECE, STRETCH = 1 << 18, 1 << 18
START, END = np.uint64(1), np.uint64(0xE4D05A2B91C36F77)
GROUPS = "group long, doc_ids array<long>, sizes array<long>, body binary"
KEYS = "bucket int, group long, keys binary, background binary, target binary"
FOUND = "bucket int, group long, background binary, target binary, n_background long, n_target long, n_kinds long"
SCORES = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def keys(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words and the end (odd), and of the pairs of each and what stands before it (even)."""
    low, at, found = text.translate(LOWER_AZ), 0, []
    while at < len(low):
        end = low.find(b" ", at + PIECE)  # no word holds a space
        end = len(low) if end < 0 else end
        found.append(word_hashes(TOKENS.findall(low, at, end)))
        at = end
    h = np.concatenate([*found, np.array([END])])
    if len(h) == 1:
        return h[:0], h[:0]
    return h | np.uint64(1), mixed(np.append(START, h[:-1]) * PRIME_MIX + h) & ~np.uint64(1)


def packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def opened(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def packed_keys(ordered: np.ndarray) -> bytes:
    return packed(np.diff(ordered, prepend=np.uint64(0)))


def opened_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(opened(raw), dtype=np.uint64)


def cuts(ordered: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of each bucket that has keys."""
    bucket = (ordered >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(ordered), np.int64)
    at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
    return ((int(bucket[i]), i, j) for i, j in zip(at[:-1], at[1:], strict=True))


def row(schema: pa.Schema, *values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def bucket_bits(docs: DataFrame) -> int:
    """The buckets' number as a power of two, by the size of the corpus."""
    size = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(0, int(size) // BUCKET).bit_length()


def grouped(docs: DataFrame) -> DataFrame:
    """Rows of about GROUP bytes of text, stored, so that every later pass has the same groups."""
    schema = arrow(GROUPS)

    def run(batches):
        from pyspark import TaskContext

        def close():
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), lists(pa.array(ids, pa.int64()), [len(ids)], pa.int64()), lists(np.array(list(map(len, held)), np.int64), [len(ids)], pa.int64()), pa.array([body], pa.binary())], schema=schema)

        group, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        for whole in batches:
            for batch in slices(whole):
                for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    ids.append(i)
                    held.append(x or b"")
                    size += len(held[-1]) + 64
                    if size >= GROUP:
                        yield close()
                        group, ids, held, size = group + 1, [], [], 0
        if ids:
            yield close()

    return stored(texts(docs).mapInArrow(run, GROUPS))


def group_keys(body: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a group's words, those of its pairs, and the number of either of each document."""
    text = zstandard.ZstdDecompressor().decompress(body)
    ends = np.cumsum(sizes).tolist()
    both = [keys(text[end - size : end]) for size, end in zip(sizes.tolist(), ends, strict=True)]
    return np.concatenate([w for w, _ in both]), np.concatenate([p for _, p in both]), np.array([len(w) for w, _ in both])


def own_counts(doc: np.ndarray, place: np.ndarray, kinds: int) -> np.ndarray:
    """For each occurrence, how often its key stands in its document."""
    _, back, n = np.unique(doc.astype(np.int64) * max(1, kinds) + place, return_inverse=True, return_counts=True)
    return n.astype(np.int32)[back]


def placed(keys_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and where each key stands among them."""
    key, place = np.unique(keys_, return_inverse=True)
    return key, place.astype(np.int32)  # a task's keys are far fewer than 2**31


def counted(groups: DataFrame, places: DataFrame, bits: int) -> DataFrame:
    """The stored answers of the buckets: FOUND rows of the groups, and one without a group for each bucket's sums."""
    sent, answered = arrow(KEYS), arrow(FOUND)

    def send(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                words, pairs, lengths = group_keys(batch.column("body")[k].as_py(), np.array(batch.column("sizes")[k].as_py(), np.int64))
                key, place = placed(np.append(words, pairs))
                del words, pairs
                n = np.bincount(place, minlength=len(key))
                chosen = np.zeros(len(lengths), bool)
                chosen[batch.column("places")[k].as_py() or []] = True
                target = np.bincount(place[np.tile(np.repeat(chosen, lengths), 2)], minlength=len(key))
                for b, i, j in cuts(key, bits):
                    yield row(sent, b, batch.column("group")[k].as_py(), packed_keys(key[i:j]), packed(n[i:j]), packed(target[i:j]))

    def answer(batches):
        def close():
            key, place = placed(np.concatenate(ks))
            totals = [np.bincount(place, np.concatenate(ns), len(key)).astype(np.int64) for ns in (bs, ts)]
            word, at = (key & np.uint64(1)).astype(bool), 0
            for g, k in zip(gs, ks, strict=True):
                mine = place[at : at + len(k)]
                at += len(k)
                yield row(answered, bucket, g, packed(totals[0][mine]), packed(totals[1][mine]), 0, 0, 0)
            yield row(answered, bucket, None, None, None, int(totals[0][word].sum()), int(totals[1][word].sum()), int(word.sum()))

        bucket, gs, ks, bs, ts = None, [], [], [], []
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.column("bucket")[k].as_py()
                if b != bucket:
                    if gs:
                        yield from close()
                    bucket, gs, ks, bs, ts = b, [], [], [], []
                gs.append(batch.column("group")[k].as_py())
                ks.append(opened_keys(batch.column("keys")[k].as_py()))
                bs.append(opened(batch.column("background")[k].as_py()).astype(np.uint32))  # of one group
                ts.append(opened(batch.column("target")[k].as_py()).astype(np.uint32))
        if gs:
            yield from close()

    asked = groups.select("group", "sizes", "body").join(places, "group", "left").mapInArrow(send, KEYS)
    return stored(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, FOUND))


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, the mean losses in nats and ``score``, background less target: higher is liker the target.

    ``target`` names the target documents in its column doc_id; the background is all of docs.
    """
    groups, result = grouped(docs), arrow(SCORES)
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    at = groups.select("group", F.posexplode("doc_ids").alias("place", "doc_id"))
    places = stored(at.join(ids, "doc_id").groupBy("group").agg(F.collect_list("place").alias("places")))  # of one group: at most its documents
    found = counted(groups, places, bucket_bits(docs))
    sums = found.where("group IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_background", "n_target", "n_kinds"))).first()
    totals, kinds = (int(sums["n_background"]), int(sums["n_target"])), max(1, int(sums["n_kinds"]))
    share = min(1.0, WORDS / kinds)

    def add(batches):
        def close():
            words, pairs, lengths = group_keys(body, sizes)
            chosen = np.zeros(len(lengths), bool)
            chosen[places_] = True
            if not len(words):
                none = np.zeros(len(lengths))
                return pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(lengths, pa.int64()), *(pa.array(none) for _ in range(3))], schema=result)
            n, doc = len(words), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            key, place = placed(np.append(words, pairs))
            del words, pairs
            start = np.diff(doc, prepend=-1) > 0
            own = own_counts(doc, place[:n], len(key)), own_counts(doc, place[n:], len(key))
            end = np.searchsorted(key, END)
            means = []
            for m in (0, 1):
                count = np.concatenate([f[m] for f in answers]).astype(np.float64)
                total = np.zeros(len(lengths))
                for i in range(0, n, STRETCH):
                    at = slice(i, i + STRETCH)
                    d = doc[at]
                    mine = 1.0 if m == 0 else chosen[d].astype(np.float64)
                    word = count[place[:n][at]] - mine * own[0][at]
                    # what stands before the first place of a stretch is of the same document, or not looked at
                    before = np.append(count[place[i - 1]] - (m == 0 or chosen[d[0]]) * own[0][i - 1] if i else 0.0, word[:-1])
                    before = np.where(start[at], count[end] - mine, before)
                    pair = count[place[n:][at]] - mine * own[1][at]
                    p = (word + share) / (totals[m] - mine * lengths[d] + share * kinds)
                    total += np.bincount(d, -np.log((pair + KAPPA * p) / (before + KAPPA)), minlength=len(lengths))
                means.append(total / np.maximum(1, lengths))
            b, t = means
            return pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(np.maximum(0, lengths - 1), pa.int64()), pa.array(t), pa.array(b), pa.array(b - t)], schema=result)

        body = None
        for batch in batches:
            for k in range(batch.num_rows):
                bucket = batch.column("bucket")[k].as_py()
                if bucket == -2:  # a group's texts come first, then its target documents, then its counts
                    if body is not None:
                        yield close()
                    ids_, sizes, body = batch.column("doc_ids")[k].as_py(), np.array(batch.column("sizes")[k].as_py(), np.int64), batch.column("body")[k].as_py()
                    places_, answers = [], []
                elif bucket == -1:
                    places_ = batch.column("places")[k].as_py()
                else:
                    answers.append([opened(batch.column(c)[k].as_py()) for c in ("background", "target")])
        if body is not None:
            yield close()

    both = groups.withColumn("bucket", F.lit(-2)).unionByName(places.withColumn("bucket", F.lit(-1)), allowMissingColumns=True)
    both = both.unionByName(found.where("group IS NOT NULL").select("bucket", "group", "background", "target"), allowMissingColumns=True)
    return both.repartition("group").sortWithinPartitions("group", "bucket").mapInArrow(add, SCORES)
