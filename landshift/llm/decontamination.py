"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles into classes that double in size.  For a
class of at most ``high`` shingles a document is cut into windows of 2 * high shingles, each
beginning half a window after the last, so an item's passage lies within one window and
the Jaccard similarity of the two is 0.19 or more at a containment of 0.8.  Windows are
minima of minima over BASE shingles, so the HASHES hash functions run over the text once for
all classes.  A window that shares any minimum with an item is a candidate (of 64 hashes,
all miss with a chance of 1.4e-6), and candidates are verified by the exact share of the
item's shingles that the whole document has.  Items of fewer than BASE shingles are looked up
exactly: a document that has any shingle of theirs is a candidate.  Items of fewer words than
a shingle are searched for by their whole word sequence, and contained or not.

Items are a test set, small beside the corpus; they go to the tasks in blocks of at most
BLOCK_CHARS characters, one pass over the documents a block.

Defined cases: words are runs of letters and digits with A-Z lower-cased; an item without
words is not searched for; null and empty documents hold nothing; of items with the same id
each is searched for; repeated rows each give their pairs; a text of any length is searched
whole; a share of just ``containment`` is a find; without documents or items there are no pairs;
other columns of either table, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.llm.common import PLAIN_WORDS, map_texts, texts
from landshift.llm.near_dedup import PRIME_MIX, mixed, word_hashes

HASHES, BASE = 64, 16
#: Characters of items that go to the tasks at one time.
BLOCK_CHARS = 16_000_000
#: Shingles hashed at one time.
CHUNK = 1 << 16


def hashed_words(text: bytes) -> np.ndarray:
    return word_hashes(text.translate(PLAIN_WORDS).split())


def ordered_shingles(h: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out = mixed(out * PRIME_MIX + h[k : k + len(out)])
    return out


def base_minima(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(HASHES, blocks): minima over each BASE shingles of a whole number of blocks."""
    low = (sh >> np.uint64(20)).astype(np.uint32).reshape(-1, BASE).T.copy()
    out = np.empty((len(a), low.shape[1]), np.uint32)
    for k in range(len(a)):
        x = low * a[k]
        x += b[k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        out[k] = x.min(axis=0)
    return out


class SizeClass:
    """Items of high / 2 to high - 1 shingles, and their minima by hash function."""

    def __init__(self, blocks: int, items: list[int], minima: np.ndarray):
        self.blocks = blocks  # of BASE shingles, in half a window
        self.values, self.items, self.seen = [], [], np.zeros((HASHES, 1 << 16), bool)
        for k in range(HASHES):
            order = np.argsort(minima[:, k], kind="stable")
            self.values.append(minima[order, k])
            self.items.append(np.array(items)[order])
            self.seen[k, minima[:, k] & np.uint32(0xFFFF)] = True


class Lookup:
    """Hashes with the items that they belong to."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items, self.seen = hashes[order], items[order], np.zeros(1 << 20, bool)
        self.seen[hashes & np.uint64(0xFFFFF)] = True

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``hashes``, item) of all that are equal, ordered by place."""
        at = np.flatnonzero(self.seen[hashes & np.uint64(0xFFFFF)])
        begin, stop = np.searchsorted(self.hashes, hashes[at]), np.searchsorted(self.hashes, hashes[at], side="right")
        n = stop - begin
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.items[np.repeat(begin, n) + step]


class ItemIndex:
    def __init__(self, items: list[tuple[object, str]], size: int):
        rng = np.random.default_rng(64)
        self.a, self.b = rng.integers(1, 2**32, HASHES, np.uint32) | np.uint32(1), rng.integers(0, 2**32, HASHES, np.uint32)
        self.size, self.ids, self.sets = size, [], []
        classes: dict[int, list[int]] = {}
        minima, small, short = {}, [], {}
        for item, text in items:
            h = hashed_words((text or "").encode())
            s = np.unique(ordered_shingles(h, size))
            if 0 < len(h) < size:
                short.setdefault(len(h), []).append((ordered_shingles(h, len(h))[0], len(self.ids)))
                self.ids.append(item)
                self.sets.append(s)
            elif 0 < len(s) < BASE:
                small.append(len(self.ids))
                self.ids.append(item)
                self.sets.append(s)
            elif len(s):
                blocks = 1
                while blocks * BASE <= len(s):
                    blocks *= 2
                classes.setdefault(blocks, []).append(len(self.ids))
                self.ids.append(item)
                self.sets.append(s)
                filled = np.append(s, np.repeat(s[-1:], -len(s) % BASE))
                minima[len(self.ids) - 1] = base_minima(filled, self.a, self.b).min(axis=1)
        self.small = Lookup(np.concatenate([self.sets[k] for k in small]), np.repeat(small, [len(self.sets[k]) for k in small])) if small else None
        self.short = {n: Lookup(np.array([h for h, _ in some], np.uint64), np.array([k for _, k in some])) for n, some in short.items()}
        self.classes = [SizeClass(n, ks, np.stack([minima[k] for k in ks])) for n, ks in sorted(classes.items())]

    def candidates(self, found: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) that share a window's minimum, or of a small item any shingle."""
        pairs: set[tuple[int, int]] = set()
        n_blocks = np.array([-(-len(s) // BASE) for s in found])
        if not n_blocks.sum():
            return pairs
        flat = np.concatenate([np.append(s, np.repeat(s[-1:], -len(s) % BASE)) for s in found if len(s)])
        if self.small:
            at, items = self.small.found(flat)
            both = np.unique(np.repeat(np.arange(len(found)), n_blocks * BASE)[at] << 32 | items)
            pairs.update(zip((both >> 32).tolist(), (both & 0xFFFFFFFF).tolist(), strict=True))
        if not self.classes:
            return pairs
        base = base_minima(flat, self.a, self.b)
        ends = np.cumsum(n_blocks)
        for c in self.classes:
            halves = -(-n_blocks // c.blocks)
            doc = np.repeat(np.arange(len(found)), halves)
            at = (np.arange(len(doc)) - np.repeat(np.cumsum(halves) - halves, halves)) * c.blocks + (ends - n_blocks)[doc]
            half = np.minimum.reduceat(base, at, axis=1) if c.blocks > 1 else base
            window = half.copy()
            window[:, :-1] = np.where(doc[1:] == doc[:-1], np.minimum(half[:, :-1], half[:, 1:]), half[:, :-1])
            for k in range(HASHES):
                hit = np.flatnonzero(c.seen[k][window[k] & np.uint32(0xFFFF)])
                value = window[k, hit]
                begin, stop = np.searchsorted(c.values[k], value), np.searchsorted(c.values[k], value, side="right")
                for h in np.flatnonzero(stop > begin):
                    pairs.update((int(doc[hit[h]]), int(i)) for i in c.items[k][begin[h] : stop[h]])
        return pairs


def search(docs: DataFrame, items: DataFrame, size: int = 5, containment: float = 0.8) -> DataFrame:
    """doc_id, item_id, containment and ``first_word`` (where the item's first shingle found stands) of every pair that meets the threshold."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + int(chars) // BLOCK_CHARS
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) if blocks > 1 else items
        index = ItemIndex([(r["item_id"], r["text"]) for r in mine.collect()], size)
        found = search_block(docs, index, kind, containment)
        out = found if out is None else out.unionByName(found)
    return out


def search_block(docs: DataFrame, index: ItemIndex, kind: str, containment: float) -> DataFrame:
    def make():
        def run(batch, values):
            out: dict[str, list] = {"doc_id": [], "item_id": [], "containment": [], "first_word": []}
            ids = batch.column("doc_id").to_pylist()

            def close(at: int, found: list[np.ndarray]) -> None:
                by_doc: dict[int, list[int]] = {}
                for d, k in index.candidates(found):
                    by_doc.setdefault(d, []).append(k)
                for d, ks in sorted(by_doc.items()):
                    have = np.unique(found[d])
                    for k in sorted(ks):
                        shared = np.intersect1d(index.sets[k], have, assume_unique=True)
                        if len(shared) >= containment * len(index.sets[k]) - 1e-9:
                            out["doc_id"].append(ids[at + d])
                            out["item_id"].append(index.ids[k])
                            out["containment"].append(len(shared) / len(index.sets[k]))
                            out["first_word"].append(int(np.flatnonzero(np.isin(found[d], shared))[0]))

            held, begin, total = [], 0, 0
            for i, x in enumerate(values):
                h = hashed_words(x or b"")
                for size, lookup in index.short.items():
                    place, items = lookup.found(ordered_shingles(h, size))
                    items, first = np.unique(items, return_index=True)
                    for k, at in zip(items.tolist(), place[first].tolist(), strict=True):
                        out["doc_id"].append(ids[i])
                        out["item_id"].append(index.ids[k])
                        out["containment"].append(1.0)
                        out["first_word"].append(at)
                held.append(ordered_shingles(h, index.size))
                total += len(held[-1])
                if total >= CHUNK:
                    close(begin, held)
                    held, begin, total = [], i + 1, 0
            if held:
                close(begin, held)
            return out

        return run

    return map_texts(texts(docs), make, f"doc_id long, item_id {kind}, containment double, first_word long")
