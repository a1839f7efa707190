"""Mixing sources to target weights: exact quotas of word blocks, dealt to shards by a splitting tree.

The words of a source, its documents in order, are one stream that is cut to blocks of BLOCK
words.  A source's quota of words is its target; its blocks are drawn in the order of a keyed
permutation, a second pass after the first, and the last one drawn is cut, so the quota is met
to the word.  The draws of all sources are dealt to output shards of equal numbers of blocks by
a multivariate-hypergeometric splitting tree: at each node the blocks that go to the left half
of its shards are split among the sources as a draw without replacement would, source by source
along a second tree over the sources.  Every draw depends on a hash of its node alone, so each
source finds its own counts with nothing but the sums of the groups beside its path; no task
holds a table of sources times shards, and reruns agree.  A shard's blocks are an interval of
the source's permuted positions, so the shards are disjoint; inside a shard the blocks lie in
the order of a hash.

Places in the streams come from a range sort and its partitions' sums, so a source that holds a
third of all rows is spread over a third of the tasks.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landshift.llm.common import arrow, slices, stored

#: Words of a block; words of an output shard.
BLOCK, SHARD = 256, 1 << 24
#: Weights of the sources, repeating in their order; the share of all words that is drawn; how often a source may be drawn.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def unit(*key: int | str) -> float:
    """A number in [0, 1) that the key alone decides."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=7).digest(), "big") / (1 << 56)


def hypergeometric(good: int, bad: int, sample: int, u: float) -> int:
    """How many of ``sample`` drawn without replacement are good: the quantile ``u``, for counts of any size.

    Summed over the middle of the distribution, 12 standard deviations each way, by ratios of neighbours.
    """
    least, most = max(0, sample - bad), min(good, sample)
    if least == most:
        return least
    total = good + bad
    mean = sample * (good / total)
    sd = math.sqrt(max(mean * (bad / total) * ((total - sample) / max(total - 1, 1)), 0.0))
    lo, hi = max(least, int(mean - 12 * sd) - 12), min(most, int(mean + 12 * sd) + 12)
    k = np.arange(lo + 1, hi + 1, dtype=float)
    ratio = np.log((good - k + 1) * (sample - k + 1)) - np.log(k * (bad - sample + k))
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.cumsum(np.exp(logs - logs.max()))
    return lo + min(int(np.searchsorted(p, u * p[-1], "right")), hi - lo)


def permuted(index: np.ndarray, n: int, key: tuple) -> np.ndarray:
    """The places of ``index`` under a keyed permutation of 0..n-1: a four-round Feistel network, walked until it falls inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int(unit(*key, r) * (1 << 56)) | 1) for r in range(4)]
    out, left = index.astype(np.uint64), np.ones(len(index), bool)
    while left.any():
        x = out[left]
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            h = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((h ^ (h >> np.uint64(32))) & mask)
        out[left] = a << np.uint64(half) | b
        left = out >= np.uint64(n)
    return out.astype(np.int64)


def quota(size: int, words: int, block: int, key: tuple) -> tuple[int, int]:
    """Draws that take ``words`` of a source, pass after pass, and what is left of the last of them.

    The stream's last block may be short; where it stands in a pass decides how far the others reach.
    """
    blocks, passes = -(-size // block), words // max(size, 1)
    left, drawn = words - passes * size, passes * blocks
    if not left:
        return drawn, block
    short, at = size - (blocks - 1) * block, int(permuted(np.array([blocks - 1]), blocks, (*key, passes))[0])
    if at * block < left <= at * block + short:
        return drawn + at + 1, left - at * block
    if left > at * block:  # the short block is among those before
        left, drawn = left - short, drawn + 1
    n = -(-left // block)
    return drawn + n, left - (n - 1) * block


def intervals(draws: int, beside: list[int], rank: int, shards: int, seed: int) -> tuple[list[int], list[int]]:
    """The shards that get some of a source's draws, in order, and the first draw of each, by the splitting tree.

    ``beside`` has the draws of the groups of sources beside this one's path, nearest first: the
    one source, then two, four and so on, in the order of ranks.
    """
    total = draws + sum(beside)
    edge = lambda k: total * k // shards
    names, begins, done = [], [], 0
    stack = [(0, shards, draws, beside)]
    while stack:
        a, b, own, sides = stack.pop()
        if not own:
            continue
        if b - a == 1:
            names.append(a)
            begins.append(done)
            done += own
            continue
        m = (a + b) // 2
        groups = [own]  # of the path, from the source up
        for s in sides:
            groups.append(groups[-1] + s)
        x, left = edge(m) - edge(a), [0] * len(sides)
        for level in range(len(sides) - 1, -1, -1):
            odd = rank >> level & 1
            first, second = (sides[level], groups[level]) if odd else (groups[level], sides[level])
            drawn = hypergeometric(first, second, x, unit(seed, "split", a, b, level, rank >> level + 1))
            mine = x - drawn if odd else drawn
            left[level], x = x - mine, mine
        stack.append((m, b, own - x, [s - t for s, t in zip(sides, left, strict=True)]))
        stack.append((a, m, x, left))
    return names, begins


def targets(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Sources (``source_size``, ``weight``) with their ``target``: by weight, ``share`` of all sizes in sum, no more than ``epochs`` sizes each.

    What a source can't take is shared again by weight among the others.  Two sums a round come
    to the driver; a round caps one source at least.
    """
    capped = F.col("source_size") * F.lit(epochs)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = None
    while True:
        # Sources below the level of the last round stay capped: the level only rises.
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > capped
        caps, weights = sources.agg(F.coalesce(F.sum(F.when(full, capped)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        new = (total - caps) / weights if weights else math.inf
        if new == level or not weights:
            break
        level = new
    if level is None:
        return sources.withColumn("target", capped.cast("double"))
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), capped.cast("double")))


def in_order(df: DataFrame, parts: int) -> DataFrame:
    """Rows by source (null last), doc_id and text, stored with the ``part`` of the order that they are in."""
    by = [F.asc_nulls_last("source"), F.asc_nulls_last("doc_id"), F.asc("size"), F.asc("tie")]
    return stored(df.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()))


def streams(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, and the document's place in its source's stream: ``part``, ``before`` (words of the source in earlier parts)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie"), *keep)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_order(stored(sized), parts)


def source_table(ordered: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> tuple[DataFrame, DataFrame]:
    """The sources with rank and target, and of each part and source the words before it.

    A part's sources lie in order, so a source's rank is the number of sources that begin in
    earlier parts, and its place among those that begin in its own.
    """
    per = stored(ordered.groupBy("part", "source").agg(F.sum("size").alias("words")))
    begin = per.groupBy("source").agg(F.min("part").alias("part"), F.sum("words").alias("source_size"))
    begun = begin.groupBy("part").agg(F.count("*").alias("n"))
    earlier = begun.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))  # a row a part
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    ranked = begin.withColumn("place", place).join(earlier, "part").select("source", "source_size", (F.col("earlier") + F.col("place") - 1).alias("rank"))
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    sources = stored(targets(stored(ranked.withColumn("weight", weight)), share, epochs))
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sources, per.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).drop("words")


def dealt(sources: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """The sources with ``draws``, ``last`` (what is left of the last draw), and the ``shards`` that get them with the first draw of each."""

    @F.pandas_udf("draws long, last long")
    def drawn(rank: pd.Series, size: pd.Series, target: pd.Series) -> pd.DataFrame:
        out = [quota(int(s), int(np.rint(t)), block, (seed, "order", int(r))) for r, s, t in zip(rank, size, target, strict=True)]
        return pd.DataFrame(out, columns=["draws", "last"])

    sources = stored(sources.withColumn("q", drawn("rank", "source_size", "target")).select("*", "q.*").drop("q"))
    top, words = sources.agg(F.coalesce(F.max("rank"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    levels, shards = int(top).bit_length(), max(1, math.ceil(words / shard))
    # The sums of the groups of 1, 2, 4 ... sources, each met by the sources whose path it lies beside.
    level = sources.select("rank", "draws", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    sums = level.groupBy("level", F.expr("shiftright(rank, level)").alias("group")).agg(F.sum("draws").alias("n"))
    met = level.select("rank", "level", F.expr("shiftright(rank, level) ^ 1").alias("group")).join(sums, ["level", "group"], "left")
    beside = met.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("level", F.coalesce("n", F.lit(0)).alias("n")))).alias("beside"))

    @F.pandas_udf("shards array<int>, begins array<long>")
    def split(rank: pd.Series, draws: pd.Series, beside: pd.Series) -> pd.DataFrame:
        out = [intervals(int(d), [int(x) for x in s][:levels], int(r), shards, seed) for r, d, s in zip(rank, draws, beside, strict=True)]
        return pd.DataFrame(out, columns=["shards", "begins"])

    both = sources.join(beside, "rank").withColumn("i", split("rank", "draws", F.transform("beside", lambda x: x["n"])))
    return both.select("rank", "source", "source_size", "target", "draws", "last", "i.*")


def spread(start: np.ndarray, size: np.ndarray, info: dict, block: int, seed: int) -> tuple[np.ndarray, ...]:
    """The drawn pieces of documents of one source: document, shard, place in the shard, first word, words, place in the stream."""
    some = np.flatnonzero(size)
    first, last = start[some] // block, (start[some] + size[some] - 1) // block
    n = last - first + 1
    doc = np.repeat(some, n)
    cut = np.repeat(first, n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    lo, hi = np.maximum(start[doc], cut * block), np.minimum(start[doc] + size[doc], (cut + 1) * block)
    blocks, draws, out = -(-info["source_size"] // block), info["draws"], []
    for turn in range(-(-draws // blocks) if blocks else 0):
        at = permuted(cut, blocks, (seed, "order", info["rank"], turn)) + turn * blocks
        end = np.where(at == draws - 1, np.minimum(hi, cut * block + info["last"]), hi)
        on = (at < draws) & (end > lo)
        to = info["shards"][np.searchsorted(info["begins"], at[on], "right") - 1]
        place = (at[on].astype(np.uint64) + np.uint64(int(unit(seed, "place", info["rank"]) * (1 << 56)))) * np.uint64(0x9E3779B97F4A7C15)
        place = ((place ^ (place >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
        out.append((doc[on], to, place, (lo - start[doc])[on], (end - lo)[on], lo[on]))
    parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 6
    order = np.lexsort((parts[5], parts[0]))
    return tuple(x[order] for x in parts)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, block: int = BLOCK, shard: int = SHARD, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its source's size and target, ``taken`` (the words that the mix takes of it, repeats counted) and the ``pieces`` taken.

    A piece is ``words`` words from the word ``first`` on, at ``place`` of ``shard``.  ``keep``
    names further columns of the table to bring along.

    Defined cases: a null text has no words, a null doc_id stands last in its source, a null
    source is a source of its own and the last one; repeated rows and rows of one doc_id are each
    a document; documents of any length are cut to blocks like others; a source without words has
    the target 0; an empty table gives an empty one; columns not named in ``keep`` are not looked
    at, and those named come along as they are.
    """
    kept = [F.col(k).alias(f"kept_{k}") for k in keep]
    ordered = streams(docs.select("doc_id", "source", "text", *kept), tuple(f"kept_{k}" for k in keep))
    sources, before = source_table(ordered, weights, share, epochs)
    plan = stored(dealt(sources, block, shard, seed))
    info = before.join(plan, before["source"].eqNullSafe(plan["source"])).select(before["part"], before["source"], "before", "rank", "source_size", "target", "draws", "last", "shards", "begins")
    fields = "doc_id long, source string, size long, source_size long, target double, taken long, pieces array<struct<shard: int, place: long, first: long, words: long, at: long>>"
    more = "".join(f", kept_{k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    to = arrow(fields + more)

    def one(rows: pa.Table, about: pa.Table) -> pa.Table:
        rows = rows.take(pa.compute.sort_indices(rows, [("doc_id", "ascending"), ("size", "ascending"), ("tie", "ascending")]))
        size, its = rows["size"].to_numpy(), {k: about[k][0].as_py() for k in about.column_names}
        its |= {k: np.array(its[k], np.int64) for k in ("shards", "begins")}
        doc, *piece = spread(its["before"] + np.cumsum(size) - size, size, its, block, seed)
        kinds = (pa.int32(), *[pa.int64()] * 4)
        values = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(piece, kinds, strict=True)], fields=list(to.field("pieces").type.value_type))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(size)))])
        cols = {
            "doc_id": rows["doc_id"], "source": rows["source"], "size": rows["size"], "source_size": pa.array([its["source_size"]] * len(size), pa.int64()), "target": pa.array([its["target"]] * len(size), pa.float64()),
            "taken": pa.array(np.bincount(doc, piece[3], len(size)).astype(np.int64)), "pieces": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
        }
        return pa.Table.from_arrays([(cols[f.name] if f.name in cols else rows[f.name]).cast(f.type) for f in to], schema=to)

    out = ordered.groupBy("part", "source").cogroup(info.groupBy("part", "source")).applyInArrow(one, fields + more)
    return out.withColumnsRenamed({f"kept_{k}": k for k in keep if k not in out.columns})


def write(docs: DataFrame, path: str, **how) -> None:
    """Writes the shards: Parquet folders by ``shard`` with ``source``, ``doc_id``, the first word, the number of words and their ``text``, in the shards' order.

    A piece's text runs from its first word to its last, as it stands in the document.
    """
    mixed = mix(docs.select("doc_id", "source", "text", F.col("text").alias("body")), keep=("body",), **how)
    schema = "shard int, place long, at long, source string, doc_id long, first long, words long, text string"
    to, word = arrow(schema), re.compile(rb"[^\x20\x09-\x0D]+")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "body"):
                rows = []
                for r in batch.to_pylist():
                    body = (r["body"] or "").encode()
                    spans = [m.span() for m in word.finditer(body)] if r["pieces"] else []
                    for p in r["pieces"]:
                        text = body[spans[p["first"]][0] : spans[p["first"] + p["words"] - 1][1]].decode()
                        rows.append(p | {"source": r["source"], "doc_id": r["doc_id"], "text": text})
                yield pa.RecordBatch.from_pylist(rows, schema=to)

    cut = mixed.select("source", "doc_id", "pieces", "body").mapInArrow(run, schema)
    cut.repartition("shard").sortWithinPartitions("shard", "place", "source", "at").drop("place", "at").write.partitionBy("shard").parquet(path)
