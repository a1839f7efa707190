"""Source divergence audit: what the sources of a language say unlike each other.

Every task counts the terms of its documents in byte tries, one a language, with a counter a
source at each leaf and the number of documents that hold the term.  A trie is read out in byte
order, which is the order of UTF-8, and forgotten when it grows large.  The leaves are merged by
ranges of prefixes, which Spark cuts by the leaves themselves, so that no prefix is too large
for a task; a merged range streams the kept terms in order past the sums of all pairs of sources
and past each source's ten best candidates, whose ties the order settles.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

import gc
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landshift.llm.common import arrow, slices, stored

#: Lower-cases A-Z and turns every other ASCII byte that is not a-z into a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Counters, and leaves, that a task holds before it reads its tries out.
COUNTERS, LEAVES = 800_000, 400_000
#: Cells of a block of terms x sources x sources.
CELLS = 1 << 21
LEAF = "lang string, term string, docs long, sources array<string>, counts array<long>"


class Trie:
    """A radix trie over bytes: a node is [label, children by first byte, leaf]; a leaf counts by source, and its documents under None."""

    def __init__(self):
        self.root, self.leaves = [b"", {}, None], 0

    def leaf(self, term: bytes) -> dict:
        """The leaf of a term, made if it is new; an edge that the term leaves half-way is cut there."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            children = node[1]
            if children is None:
                children = node[1] = {}
            child = children.get(term[at])
            if child is None:
                node = children[term[at]] = [term[at:], None, None]
                break
            label = child[0]
            if not term.startswith(label, at):
                n, most = 1, min(len(label), end - at)
                while n < most and label[n] == term[at + n]:
                    n += 1
                middle = children[term[at]] = [label[:n], {label[n]: child}, None]
                child[0] = label[n:]
                child, label = middle, middle[0]
            node, at = child, at + len(label)
        if node[2] is None:
            node[2] = {None: 0}
            self.leaves += 1
        return node[2]

    def merge(self, other: Trie) -> None:
        for term, counts in other:
            leaf = self.leaf(term)
            for source, n in counts.items():
                leaf[source] = leaf.get(source, 0) + n

    def __iter__(self) -> Iterator[tuple[bytes, dict]]:
        """Terms and leaves in byte order."""
        stack = [(b"", self.root)]
        while stack:
            prefix, (label, children, leaf) = stack.pop()
            word = prefix + label
            if leaf is not None:
                yield word, leaf
            if children:
                stack += [(word, children[b]) for b in sorted(children, reverse=True)]


class Counts:
    """The tries of a task, by language, and the plain counters that feed them."""

    def __init__(self):
        self.tries: dict[str, Trie] = defaultdict(Trie)
        self.clear()

    def clear(self) -> None:
        self.terms: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.docs: dict[str, Counter] = defaultdict(Counter)

    def add(self, lang: str, source: str, text: bytes) -> None:
        found = text.translate(LETTERS).split()
        self.terms[lang, source].update(found)
        self.docs[lang].update(set(found))

    def full(self) -> bool:
        return sum(map(len, self.terms.values())) > COUNTERS

    def settle(self) -> bool:
        """Moves the counters to the leaves of the tries; whether these are to be read out."""
        met: dict[str, dict[bytes, dict]] = {}
        for lang, docs in self.docs.items():
            find, of = self.tries[lang].leaf, met.setdefault(lang, {})
            for term, n in docs.items():
                leaf = of[term] = find(term)
                leaf[None] += n
        for (lang, source), terms in self.terms.items():
            of = met[lang]
            for term, n in terms.items():
                leaf = of[term]
                leaf[source] = leaf.get(source, 0) + n
        self.clear()
        return sum(t.leaves for t in self.tries.values()) > LEAVES

    def read_out(self, to: pa.Schema) -> Iterator[pa.RecordBatch]:
        for lang in sorted(self.tries):
            terms, docs, sources, counts, ends = [], [], [], [], [0]
            for term, by in self.tries[lang]:
                terms.append(term)
                docs.append(by.pop(None))
                sources += by
                counts += by.values()
                ends.append(len(counts))
            offsets = pa.array(ends, pa.int32())
            cols = [pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(sources, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]
            whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, to, strict=True)], schema=to)
            for at in range(0, len(terms), 20_000):
                yield whole.slice(at, 20_000)
        self.tries.clear()


def leaves(docs: DataFrame) -> DataFrame:
    """The leaves of all tasks' tries: lang, term, documents that hold it, and its counts by source."""
    to = arrow(LEAF)
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        gc.disable()  # tries have no cycles, and the collector would walk them again and again
        try:
            for whole in batches:
                for batch in slices(whole):
                    for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                        held.add(lang, source, text)
                    if held.full() and held.settle():
                        yield from held.read_out(to)
            held.settle()
            yield from held.read_out(to)
        finally:
            gc.enable()

    return named.mapInArrow(run, LEAF)


def added(rows: pa.Table, least: int) -> pa.Table:
    """Sorted leaves with those of one term added up; terms in fewer than ``least`` documents go."""
    rows = rows.combine_chunks()
    lang, term, docs = rows["lang"], rows["term"], rows["docs"].to_numpy()
    new = np.ones(len(docs), bool)
    new[1:] = pa.compute.or_(pa.compute.not_equal(lang[1:], lang[:-1]), pa.compute.not_equal(term[1:], term[:-1])).to_numpy()
    first = np.flatnonzero(new)
    total = np.add.reduceat(docs, first) if len(first) else docs
    keep = total >= least
    flat = rows["sources"].combine_chunks()
    names = flat.flatten().dictionary_encode()
    n = flat.value_lengths().to_numpy()
    run = np.repeat(np.cumsum(new) - 1, n)
    on = keep[run]
    code = names.indices.to_numpy()[on].astype(np.int64)
    run = (np.cumsum(keep) - 1)[run[on]]
    width = max(len(names.dictionary), 1)
    cell, inverse = np.unique(run * width + code, return_inverse=True)
    counts = np.zeros(len(cell), np.int64)
    np.add.at(counts, inverse, rows["counts"].combine_chunks().flatten().to_numpy()[on])
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(cell // width, minlength=int(keep.sum())))]), pa.int32())
    at = pa.array(first[keep])
    return pa.table(
        {
            "lang": lang.take(at), "term": term.take(at), "docs": pa.array(total[keep]), "sources": pa.ListArray.from_arrays(offsets, names.dictionary.take(pa.array(cell % width)) if len(cell) else pa.array([], pa.string())),
            "counts": pa.ListArray.from_arrays(offsets, pa.array(counts)),
        }
    )


def kept_terms(docs: DataFrame, least: int = 10) -> DataFrame:
    """The terms that ``least`` documents of their language hold, with counts by source and the ``part`` of the order they are in."""
    fields = LEAF + ", part int"
    to = arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            lang, term = rows["lang"], rows["term"]
            # The last term may go on in the next batch.
            last = pa.compute.and_(pa.compute.equal(lang, lang[-1]), pa.compute.equal(term, term[-1]))
            cut = pa.compute.index(last, True).as_py()
            held = rows.slice(cut)
            if cut:
                yield from out(added(rows.slice(0, cut), least), part)
        if held is not None:
            yield from out(added(held, least), part)

    def out(t: pa.Table, part: int) -> Iterator[pa.RecordBatch]:
        t = t.append_column("part", pa.array([part] * t.num_rows, pa.int32()))
        yield from pa.Table.from_arrays([t[f.name].cast(f.type) for f in to], schema=to).to_batches()

    by = ("lang", "term")
    return stored(stored(leaves(docs)).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, fields))


def shares(counts: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 x (count + 2) / of), by long division in thousands, so that nothing overflows."""
    whole, rest = np.divmod(counts + 2, of)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digit
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by what sets the two apart, and the terms that a source has more of than its language.

    Defined cases: a null text, lang or source is an empty string, which is a language or source
    like others; a source without terms has every kept term 0 times; a language without kept
    terms has pairs of value 0 and no terms; one with a single source has no pairs; equal values
    rank by the item's bytes; repeated rows are documents of their own; a text or term of any
    length counts as a whole; an empty table gives an empty one; other columns are not looked at.
    """
    kept = kept_terms(docs, least)
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    pairs = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    sums = pairs.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = stored(named.groupBy("lang", "source").agg(F.count("*").alias("_")).join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    parts = kept.groupBy("lang", "part").agg(F.count("*").alias("v"))
    v = parts.groupBy("lang").agg(F.sum("v").alias("v"))
    about = langs.join(v, "lang", "left").join(parts.select("lang", "part"), "lang", "left")
    about = about.select("lang", F.coalesce("part", F.lit(-1)).alias("part"), "groups", F.coalesce("v", F.lit(0)).alias("v"))
    fields = "lang string, source string, kind string, item string, value long"
    to = arrow(fields)

    def one(terms: pa.Table, info: pa.Table) -> pa.Table:
        its = info.to_pylist()[0]
        names = [g["source"] for g in its["groups"]]
        n, s = np.array([g["n"] for g in its["groups"]], np.int64), len(names)
        of, of_all = n + 2 * its["v"], int(n.sum()) + 2 * its["v"]
        terms = terms.take(pa.compute.sort_indices(terms, [("term", "ascending")])).combine_chunks()
        words, lists = terms["term"], terms["sources"].combine_chunks() if terms.num_rows else None
        sums, best = np.zeros((s, s), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))] * s
        if terms.num_rows:
            place = {x: k for k, x in enumerate(names)}
            codes = lists.flatten().dictionary_encode()
            code = np.array([place[x] for x in codes.dictionary.to_pylist()], np.int64)[codes.indices.to_numpy()]
            row = np.repeat(np.arange(terms.num_rows), lists.value_lengths().to_numpy())
            count = terms["counts"].combine_chunks().flatten().to_numpy()
            step = max(1, CELLS // max(s, 1) // max(min(s, 64), 1))
            for at in range(0, terms.num_rows, step):
                lo, hi = np.searchsorted(row, [at, min(at + step, terms.num_rows)])
                c = np.zeros((min(step, terms.num_rows - at), s), np.int64)
                c[row[lo:hi] - at, code[lo:hi]] = count[lo:hi]
                p, q = shares(c, of), shares(c.sum(1), of_all)
                for b in range(0, s, 64):
                    sums[b : b + 64] += apart(p[:, b : b + 64, None], p[:, None, :]).sum(0)
                for k in range(s):
                    on = np.flatnonzero((c[:, k] > 0) & (p[:, k] > q))
                    value = np.concatenate([best[k][0], apart(p[on, k], q[on])])
                    index = np.concatenate([best[k][1], on + at])
                    first = np.argsort(-value, kind="stable")[:top]  # terms come in order, so ties fall to the lesser
                    best[k] = value[first], index[first]
        a, b = np.nonzero(~np.eye(s, dtype=bool))
        source = [names[k] for k in a] + [names[k] for k in range(s) for _ in best[k][0]]
        item = [names[k] for k in b] + [words[int(j)].as_py() for k in range(s) for j in best[k][1]]
        value = np.concatenate([sums[a, b], *(x[0] for x in best)])
        kind = ["pair"] * len(a) + ["term"] * (len(item) - len(a))
        return pa.table([[its["lang"]] * len(item), source, kind, item, value], schema=to)

    found = stored(kept.select("lang", "part", "term", "sources", "counts").groupBy("lang", "part").cogroup(about.groupBy("lang", "part")).applyInArrow(one, fields))
    ranked = F.row_number().over(Window.partitionBy("lang", "source", "kind").orderBy(F.desc("value"), "item"))
    pair = found.where("kind = 'pair'").groupBy("lang", "source", "kind", "item").agg(F.sum("value").alias("value")).withColumn("rank", ranked)
    term = found.where("kind = 'term'").withColumn("rank", ranked).where(F.col("rank") <= top)
    return pair.unionByName(term).withColumnRenamed("kind", "part")
