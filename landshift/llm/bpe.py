"""BPE encoding and decoding of whole texts with a published merge list.

Words are cut as the vocabulary file says (NFC, lower case, letters / single digits / other
marks, byte-level symbols with a word end): ASCII and accented Latin words by a pattern, all
others by the library's own normaliser and pre-tokeniser, whose Unicode tables may be newer than Python's.
Inside a word a priority queue of merge ranks
works over a doubly linked list of symbols; entries whose symbols have changed since they
were queued are stale and skipped.  Decoding joins the vocabulary's strings with a space.

No merge and no pattern crosses white space, so a task keeps the ids of the words it has met
(CACHE words at most, then it starts over); a worker that goes on to other work holds the
vocabulary alone.

Defined cases: a null text is empty and has no ids; its decoded text is empty; repeated rows
and any length of text are encoded each for itself, with or without doc_id; of pairs of one
rank the left one merges first; an empty table gives an empty one; other columns of the table
are not looked at.
"""

from __future__ import annotations

import heapq
import json
from copy import copy
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from landshift.llm.common import lists, map_texts, texts

#: Words, and pieces of words, whose ids a task keeps.
CACHE = 500_000
#: ASCII and the Latin letters up to U+017F, but the dotted capital I: here NFC changes nothing, lower case is one character and the classes are settled.
PLAIN = regex.compile(r"[\x00-\x7F\u00C0-\u012F\u0131-\u017F]*")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.strings: dict[int, str] = {i: s for s, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        symbols = byte_symbols()
        self.byte = {s: b for b, s in enumerate(symbols)}
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        #: (left id << 20 | right id): rank << 52 | merged id; with place << 20 that is an entry of the queue
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 52 | vocab[a + b] for rank, (a, b) in enumerate(map(tuple, spec["model"]["merges"]))}
        #: ids as int32 by the bytes of a word, and by those of a piece
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.names = np.array([self.strings.get(i, "") for i in range(max(self.strings) + 1)], object)

    def emptied(self) -> WordBpe:
        """The same vocabulary with caches of its own."""
        out = copy(self)
        out.words, out.pieces = {}, {}
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """The ids that are left when no adjacent pair has a rank."""
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [m + (i << 20) for i in range(n - 1) if (m := merges.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, merged = entry >> 20 & 0xFFFFFFFF, entry & 0xFFFFF
            j = after[i]
            if ids[i] < 0 or j < 0 or merges.get(ids[i] << 20 | ids[j], -1) & 0xFFFFF != merged:
                continue  # stale
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get(merged << 20 | ids[k]):
                    heapq.heappush(queue, m + (i << 20))
            h = before[i]
            if h >= 0 and (m := merges.get(ids[h] << 20 | merged)):
                heapq.heappush(queue, m + (h << 20))
        return [x for x in ids if x >= 0]

    def piece(self, b: bytes) -> bytes:
        """The merged ids of a piece's bytes, as int32."""
        ids = self.pieces.get(b)
        if ids is None:
            ids = self.pieces[b] = np.array(self.merge([*map(self.inner.__getitem__, b[:-1]), self.last[b[-1]]]), np.int32).tobytes()
        return ids

    def word(self, raw: bytes) -> bytes:
        """Ids of a stretch of text without ASCII white space, as int32."""
        if raw.isalpha():  # letters a-z and A-Z alone: one piece
            return self.piece(raw.lower())
        text, out = raw.decode("utf-8"), []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
            elif part.isascii() or PLAIN.fullmatch(part):
                out += [self.piece(p.encode("utf-8")) for p in PIECES.findall(part.lower())]
            else:  # the library spells a piece in byte-level symbols; its bytes name it here, as everywhere
                spelled = self.cutter.pre_tokenize_str(self.normalizer.normalize_str(part))
                out += [self.piece(bytes(map(self.byte.__getitem__, p))) for p, _ in spelled]
        return b"".join(out)

    def encode(self, text: bytes) -> np.ndarray:
        words = text.split()
        known = self.words
        if len(known) > CACHE:
            known.clear()
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w)
        return np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.names[ids].tolist())


@lru_cache(2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ``ids`` of each text."""
    path = vocabulary or default_vocabulary()

    def make():
        bpe = loaded(path).emptied()

        def run(batch, values):
            each = [bpe.encode(x or b"") for x in values]
            return {"doc_id": batch.column("doc_id"), "ids": lists(np.concatenate(each), [len(x) for x in each], pa.int32())}

        return run

    return map_texts(texts(docs), make, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ``ids`` and ``decoded``, as ``decode(encode(docs))`` gives them, by one worker a task instead of two."""
    path = vocabulary or default_vocabulary()

    def make():
        bpe = loaded(path).emptied()

        def run(batch, values):
            each = [bpe.encode(x or b"") for x in values]
            return {"doc_id": batch.column("doc_id"), "ids": lists(np.concatenate(each), [len(x) for x in each], pa.int32()), "decoded": [bpe.decode(x) for x in each]}

        return run

    return map_texts(texts(docs), make, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The table with ``decoded``, the text of its ``ids`` (null: empty)."""
    path = vocabulary or default_vocabulary()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType

    schema = encoded.drop("decoded").schema.add("decoded", StringType())
    to = to_arrow_schema(schema)

    def run(batches):
        bpe = loaded(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = batch.column("ids").fill_null([])
                flat, cuts = ids.flatten().to_numpy(), np.cumsum(ids.value_lengths().to_numpy())
                text = [bpe.decode(x) for x in np.split(flat, cuts[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(text, to.field(n).type) if n == "decoded" else batch.column(n).cast(to.field(n).type) for n in to.names], schema=to)

    return encoded.drop("decoded").mapInArrow(run, schema)
