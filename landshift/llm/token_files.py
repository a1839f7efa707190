"""Token ids in binary files, with their bits dealt to planes.

Layout: one Parquet row is a chunk of whole documents.  Its payload holds blocks of BLOCK
ids (the last one shorter); a block's little-endian 32-bit ids are transposed to four byte
planes and each plane is a zstandard frame.  The chunk's index has, for every block, the
number of ids and the length of its planes, and, for every document, its number of ids.
Parts follow one another in the order of doc_id, and so do the chunks of a part, so a
part's offset is the sum of the parts before it.

Defined cases: a null text is empty and gets the end id alone; rows without doc_id come
first; rows of one doc_id follow one another by text, and repeated rows are stored each; a
text of any length is in one chunk; an empty table gives files without chunks; other columns
of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landshift.llm.bpe import default_vocabulary
from landshift.llm.common import SLICE_BYTES, arrow, slices, texts

BLOCK = 65_536
#: Ids at which a chunk is closed, after the document at hand.
CHUNK = 4 * BLOCK
#: Pieces of words that a worker meets before it forgets those not met since as many before.
CACHE = 300_000
#: Bytes of text whose words are looked up at one time.
SLICE = 2 * SLICE_BYTES
#: ``bpe.PLAIN`` and ``bpe.PIECES`` as Arrow's expressions write them: in these letters case and classes are settled.
PLAIN = r"^[\x00-\x7F\x{C0}-\x{12F}\x{131}-\x{17F}]*$"
LETTERS = r"^\p{L}+$"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
CHUNKS = "part int, chunk int, n_ids long, doc_ids array<long>, doc_sizes array<long>, block_sizes array<int>, plane_bytes array<int>, payload binary"


def pack(ids: np.ndarray, level: int = 1) -> tuple[list[int], list[int], bytes]:
    """Sizes of the blocks, bytes of their planes in turn, and the planes."""
    squeeze = zstandard.ZstdCompressor(level=level)
    sizes, lengths, out = [], [], []
    for at in range(0, len(ids), BLOCK):
        block = np.ascontiguousarray(ids[at : at + BLOCK], "<u4")
        sizes.append(len(block))
        for plane in np.ascontiguousarray(block.view(np.uint8).reshape(-1, 4).T):
            out.append(squeeze.compress(plane.tobytes()))
            lengths.append(len(out[-1]))
    return sizes, lengths, b"".join(out)


def unpack(sizes: list[int], lengths: list[int], payload: bytes) -> np.ndarray:
    loosen, at, blocks = zstandard.ZstdDecompressor(), 0, []
    for k, n in enumerate(sizes):
        planes = np.empty((4, n), np.uint8)
        for i, length in enumerate(lengths[4 * k : 4 * k + 4]):
            planes[i] = np.frombuffer(loosen.decompress(payload[at : at + length], max_output_size=n), np.uint8)
            at += length
        blocks.append(np.ascontiguousarray(planes.T).reshape(-1).view("<u4"))
    return np.concatenate(blocks) if blocks else np.empty(0, "<u4")


def objects(values: pa.Array) -> list:
    """``values.to_pylist()``, several times as fast."""
    return values.to_numpy(zero_copy_only=False).tolist()


def laid_out(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``ids[begin : begin + size]`` one after another, and where each of them ends there."""
    ends = np.cumsum(sizes)
    places = np.repeat(begins - ends + sizes, sizes)
    places += np.arange(len(places))
    return ids[places], ends


class Recent(dict):
    """A dict that forgets what was not asked for lately; ``before`` is what it held at its last turn."""

    def __init__(self):
        super().__init__()
        self.before: dict = {}

    def each(self, keys: list, learn: Callable[[list], None]) -> list:
        """The values of the keys; ``learn`` adds those not met before."""
        if len(self) > CACHE:
            self.before = dict(self)
            self.clear()
        new = []
        for k in [k for k in keys if k not in self]:
            if k in self.before:
                self[k] = self.before[k]
            else:
                new.append(k)
        learn(new)
        return [*map(self.__getitem__, keys)]


class LibraryWords:
    """The tokenizers library's ids, word by word: no pattern or merge of the file crosses white space.

    Words of ASCII and accented Latin are cut to pieces, a slice of the table at a time, and
    the pieces not met before go to the library in long texts; there each piece ends with the
    one token that carries the end of a word.  All other words go to the library as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        #: ids as 32-bit integers by piece, or by word that is not cut
        self.pieces = Recent()
        #: those of the words given to ``learn``
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: Iterable[bytes]) -> None:
        """Puts the words' ids into ``known``."""
        words = list(words)
        ids, begins, sizes = self.spell(pa.array(words, pa.binary()).cast(pa.string()))
        self.known |= {w: ids[b : b + n].tobytes() for w, b, n in zip(words, begins, sizes, strict=True)}

    def spell(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words in some order, and where those of each word begin and how many they are."""
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))  # special tokens stay whole
        low = pc.utf8_lower(words)
        one = pc.and_(plain, pc.match_substring_regex(low, LETTERS))
        more = pc.and_not(plain, one)
        cut = pc.ascii_split_whitespace(pa.concat_arrays([low.filter(one), pc.replace_substring_regex(low.filter(more), PIECE, r"\0 ")]))
        named, whole = cut.flatten().dictionary_encode(), objects(words.filter(pc.invert(plain)))
        each = self.pieces.each(objects(named.dictionary), self.learn_pieces)
        at = np.append(named.indices.to_numpy(), np.arange(len(each), len(each) + len(whole)))
        each += self.pieces.each(whole, self.learn_whole)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        ids, ends = laid_out(np.frombuffer(b"".join(each), "<u4"), (np.cumsum(sizes) - sizes)[at], sizes[at])
        counts = np.append(cut.value_lengths().to_numpy(), np.ones(len(whole), np.int64))  # of pieces, one at least
        stops = ends[np.cumsum(counts) - 1]
        order = np.concatenate([np.flatnonzero(kind.to_numpy(zero_copy_only=False)) for kind in (one, more, pc.invert(plain))])
        begins, sizes = np.empty((2, len(words)), np.int64)
        sizes[order] = np.diff(stops, prepend=0)
        begins[order] = stops - sizes[order]
        return ids, begins, sizes

    def learn_whole(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            for w, found in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.pieces[w] = np.array(found.ids, "<u4").tobytes()

    def learn_pieces(self, pieces: list[str]) -> None:
        self.pieces[""] = b""
        pieces = [p for p in pieces if p]
        for at in range(0, len(pieces), 2000):
            some = pieces[at : at + 2000]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            raw, begin = ids.tobytes(), 0
            for p, stop in zip(some, (4 * stops).tolist(), strict=True):
                self.pieces[p] = raw[begin:stop]
                begin = stop

    def encode(self, values: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text (null: none) and the end id.  Arrow tells the words apart, so that only distinct pieces become Python objects."""
        cut = pc.ascii_split_whitespace(pc.fill_null(values, ""))
        named = cut.flatten().dictionary_encode()
        ids, begins, sizes = self.spell(named.dictionary)
        stops = np.cumsum(cut.value_lengths().to_numpy())
        at = np.insert(named.indices.to_numpy(), stops, len(sizes))
        ids, ends = laid_out(np.append(ids, np.uint32(end_id)), np.append(begins, len(ids))[at], np.append(sizes, 1)[at])
        return np.split(ids, ends[stops + np.arange(len(stops))][:-1])


@lru_cache(2)
def loaded(path: str) -> LibraryWords:
    return LibraryWords(path)


def write(docs: DataFrame, to: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Encodes the documents in the order of doc_id and writes their chunks to the folder ``to``."""
    path, schema = vocabulary or default_vocabulary(), arrow(CHUNKS)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), loaded(path)
        chunk, held, ids, names = 0, 0, [], []

        def close() -> pa.RecordBatch:
            sizes, lengths, payload = pack(np.concatenate(ids))
            row = {"part": part, "chunk": chunk, "n_ids": held, "doc_ids": names, "doc_sizes": [len(x) for x in ids], "block_sizes": sizes, "plane_bytes": lengths, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for whole in batches:
            for batch in slices(whole, most=SLICE):
                for doc, one in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text"), end_id), strict=True):
                    names.append(doc)
                    ids.append(one)
                    held += len(one)
                    if held >= CHUNK:
                        yield close()
                        chunk, held, ids, names = chunk + 1, 0, [], []
        if names:
            yield close()

    texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, CHUNKS).write.mode("overwrite").parquet(to)


def chunk_starts(spark: SparkSession, at: str) -> DataFrame:
    """part, chunk and ``start``, the ids of all chunks before it.  Reads the index alone; one row a part meets in one task."""
    chunks = spark.read.parquet(at).select("part", "chunk", "n_ids")
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("part", "chunk", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    return chunks.join(parts, "part").select("part", "chunk", (F.col("part_start") + F.col("inside")).alias("start"))


def read_documents(spark: SparkSession, at: str) -> DataFrame:
    """part, chunk, ``offset`` of the document in its chunk, doc_id, n_tokens and ``ids`` (binary, little-endian 32-bit)."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = unpack(row["block_sizes"], row["plane_bytes"], row["payload"])
                ends = np.cumsum(row["doc_sizes"])
                begins = ends - row["doc_sizes"]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * len(ends), pa.int32()),
                        "chunk": pa.array([row["chunk"]] * len(ends), pa.int32()),
                        "offset": pa.array(begins, pa.int64()),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "n_tokens": pa.array(row["doc_sizes"], pa.int64()),
                        "ids": pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
                    }
                )

    return spark.read.parquet(at).mapInArrow(run, "part int, chunk int, offset long, doc_id long, n_tokens long, ids binary")
