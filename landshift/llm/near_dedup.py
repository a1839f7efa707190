"""b-bit MinHash near-dedup with links confirmed on full sets.

1. Every text becomes its set of distinct word shingles, hashed; the first BANDED of HASHES
   minima give the bands, and the lowest BITS bits of each minimum the packed signature.
2. Texts with the same set form a class; only its smallest doc_id goes on.
3. Classes that share a band are candidates.  The share of equal b-bit minima, corrected
   for chance collisions, estimates the similarity; pairs whose estimate is SLACK below
   the threshold (five standard deviations) are left out.
4. Candidates are confirmed on the shingle sets of the texts themselves.
5. A band of many classes is not expanded to pairs: in each of the first rounds its classes
   meet one hub, and components are joined on the links found so far.
6. What is left are candidates whose ends are in different components.  Bands of at most
   SMALL classes are expanded, each pair in the first band that it shares.  The classes of
   larger bands are joined exactly by what sets them apart (``apart``), which does not grow
   with the square of a group.  So no link between components is lost; pairs inside a
   component could not change it.

With ROWS rows a band and BANDED / ROWS bands, a pair at the threshold 0.85 shares no band
with a chance of 4e-7.

Defined cases: a null text, or one without words, has an empty set and is linked with
nothing; a text of fewer words than a shingle is one shingle; texts of any length are taken
whole; texts of equal sets are one class, whose smallest doc_id stands for it; of rows with
the same doc_id the one with the largest set is the document, and repeated rows count once;
rows without doc_id are left out; an empty table gives an empty one; other columns of the
table are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landshift.llm.common import LOWER_AZ, lists, map_texts, stored, texts

#: Minima, those of them that make bands, minima of a band, bits kept of a minimum.
HASHES, BANDED, ROWS, BITS = 256, 100, 4, 2
#: Longs of a bit plane; a signature is BITS planes.
PLANE = -(-HASHES // 64)
SLACK = 0.14
#: Classes of a band up to which its pairs are written out.
SMALL = 16
PRIME_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = (text or b"").translate(LOWER_AZ).split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    m = max(1, len(h) - size + 1)
    out = np.full(m, np.uint64(len(h) if len(h) < size else size))
    for k in range(min(size, len(h))):
        out = mixed(out * PRIME_MIX + h[k : k + m])
    return np.unique(out)


def sketch(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """HASHES minima of 32-bit hashes."""
    low = (found >> np.uint64(16)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        x = low[at : at + 256, None] * a + b
        x ^= x >> np.uint32(15)
        out = np.minimum(out, (x * np.uint32(0x85EBCA6B)).min(axis=0))
    return out


def packed(minima: np.ndarray) -> np.ndarray:
    """Bit planes of the lowest BITS bits of the minima, each filled up to whole longs."""
    planes = np.zeros((BITS, PLANE * 64), np.uint8)
    planes[:, : len(minima)] = (minima >> np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(planes, axis=1).reshape(-1).view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, ``same`` (128 bits of the whole set), ``signature`` and ``bands``; empty sets have no bands."""
    rng = np.random.default_rng(20)
    a, b = rng.integers(1, 2**32, HASHES, np.uint32) | np.uint32(1), rng.integers(0, 2**32, HASHES, np.uint32)

    def make():
        def run(batch, values):
            sets = [shingles(x, size) for x in values]
            same, signature, bands, n_bands = [], [], [], []
            for s in sets:
                same.append(xxhash.xxh3_128_digest(s.tobytes()))
                minima = sketch(s, a, b)
                signature.append(packed(minima))
                n_bands.append(BANDED // ROWS if len(s) else 0)
                if len(s):
                    bands += [xxhash.xxh3_64_intdigest(r.tobytes(), seed=k) - 2**63 for k, r in enumerate(minima[:BANDED].reshape(-1, ROWS))]
            return {
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_shingles": [len(s) for s in sets], "same": same,
                "signature": lists(np.concatenate(signature), [BITS * PLANE] * len(sets), pa.int64()), "bands": lists(np.array(bands, np.int64), n_bands, pa.int64()),
            }

        return run

    return map_texts(docs.select("doc_id", "text", "text_hash"), make, "doc_id long, text_hash long, n_shingles long, same binary, signature array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two signatures: the share of equal minima beyond those equal by chance."""
    different = F.lit(0)
    for at in range(PLANE):
        differs = a[at].bitwiseXOR(b[at])
        for p in range(1, BITS):
            differs = differs.bitwiseOR(a[p * PLANE + at].bitwiseXOR(b[p * PLANE + at]))
        different = different + F.bit_count(differs)
    chance = 0.5**BITS
    return (1 - different / HASHES - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) from edges (u, v): large and small stars by turns until nothing changes.

    Stars keep one edge a node, minima are pre-aggregated, and every step is written to the
    shared folder, so no group is gathered and a lost executor costs one step.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets satisfy 100 * intersection >= percent * union."""
    both = pairs.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(docs.select(F.col("doc_id").alias("a"), "text"), "a")

    def make():
        last: list = [None, None]

        def run(batch, values):
            a, b = [], []
            for x, y, t, u in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), values, batch.column("text_b").cast(pa.binary()).to_pylist(), strict=True):
                if last[0] != t:
                    last[:] = t, shingles(t, size)
                s, r = last[1], shingles(u, size)
                shared = len(np.intersect1d(s, r, assume_unique=True))
                if 100 * shared >= percent * (len(s) + len(r) - shared):
                    a.append(x)
                    b.append(y)
            return {"a": a, "b": b}

        return run

    return map_texts(both.select("a", "b", "text", "text_b"), make, "a long, b long")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, family and ``set``, the hashes of the shingles."""

    def make():
        def run(batch, values):
            sets = [shingles(x, size).view(np.int64) for x in values]
            return {"doc_id": batch.column("doc_id"), "family": batch.column("family"), "set": lists(np.concatenate(sets), [len(s) for s in sets], pa.int64())}

        return run

    return map_texts(docs.select("doc_id", "text", "family"), make, "doc_id long, family long, set array<long>")


def apart(placed: DataFrame, near: DataFrame, size: int, percent: int, roots: DataFrame) -> DataFrame:
    """All links (a, b) between different roots that matter, among classes that meet in bands: an exact join on differences.

    ``placed`` has band, doc_id and root.  Classes that meet in bands, directly or by others,
    are a family.  Its centre is the set of shingles that more than half of its members have
    (any set would do), and a member with the set X of n shingles differs from the centre by
    delta, so |X ^ Y| = |delta x| + |delta y| - 2 |both deltas|.  With
    surplus = (100 + percent) |delta| - (100 - percent) n, two members are linked if
    2 (100 + percent) |both deltas| >= surplus x + surplus y.

    If two surpluses add up to 0 or less, both members are linked to the member of the least
    surplus, which is told at once.  Every other link needs shared differences, of which most
    members have few beside their own alone: each member gets the least number it must share
    with one of another root, by the least surplus there and by the length filter, and is
    looked up by so many of its rarest shared differences that one must meet (prefix filter);
    where they meet, what is left must suffice (positional filter).  Candidates are verified
    on the differences, that is, on full sets.
    """
    double = 2 * (100 + percent)
    edges = placed.join(placed.groupBy("band").agg(F.min("doc_id").alias("v")), "band").select(F.col("doc_id").alias("u"), "v")
    family = components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("family"))
    whole = family.select("family").distinct().select(F.col("family").alias("doc_id"), "family").unionByName(family).distinct()
    sets = stored(shingle_sets(near.join(whole, "doc_id"), size))
    sizes = sets.groupBy("family").agg(F.count("*").alias("members"))
    centre = sets.select("family", F.explode("set").alias("e")).groupBy("family", "e").agg(F.count("*").alias("n")).join(sizes, "family").where("2 * n > members")
    centre = centre.groupBy("family").agg(F.collect_list("e").alias("centre"))  # at most two average sets
    differ = F.concat(F.array_except("set", "centre"), F.array_except("centre", "set"))
    delta = sets.join(centre, "family", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<long>"))).select("family", "doc_id", F.size("set").cast("long").alias("n"), differ.alias("delta"))
    delta = stored(delta.withColumn("surplus", (100 + percent) * F.size("delta") - (100 - percent) * F.col("n")))
    least = delta.groupBy("family").agg(F.min(F.struct("surplus", "doc_id")).alias("least"))
    star = delta.join(least, "family").where((F.col("surplus") + F.col("least.surplus") <= 0) & (F.col("doc_id") != F.col("least.doc_id")))
    star = stored(star.select(F.least("doc_id", "least.doc_id").alias("a"), F.greatest("doc_id", "least.doc_id").alias("b")))
    # Roots so far, with the star's links: the least member's root stands for what it reaches.
    at = delta.select("family", "doc_id", "n", "surplus").join(roots, "doc_id")
    hub = least.select("family", F.col("least.doc_id").alias("doc_id"), F.col("least.surplus").alias("low")).join(roots, "doc_id").select("family", "low", F.col("root").alias("hub"))
    joined = at.join(hub, "family").where("surplus + low <= 0").select("family", "root", "hub").distinct()
    at = stored(at.join(joined, ["family", "root"], "left").select("family", "doc_id", "n", "surplus", F.coalesce("hub", "root").alias("root")))
    first = at.groupBy("family").agg(F.min(F.struct("surplus", "root")).alias("first"))
    lows = at.join(first, "family").groupBy("family").agg(F.min("first").alias("first"), F.min(F.when(F.col("root") != F.col("first.root"), F.col("surplus"))).alias("second"))
    other = F.when(F.col("root") == F.col("first.root"), F.col("second")).otherwise(F.col("first.surplus"))
    need = F.greatest(
        F.lit(1), F.ceil((F.col("surplus") + other) / double), F.ceil((F.col("surplus") - (100 - percent) * F.floor(100 * F.col("n") / percent)) / (100 + percent))
    )
    asking = at.join(lows.where("second IS NOT NULL"), "family").select("doc_id", "root", "n", "surplus", need.cast("int").alias("need"))
    each = delta.select("family", "doc_id", F.explode("delta").alias("e"))
    common = each.groupBy("family", "e").agg(F.count("*").alias("n")).where("n > 1")
    ranked = each.join(common, ["family", "e"]).groupBy("family", "doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("es"))  # of one member: at most its differences
    ranked = stored(ranked.select("family", "doc_id", F.col("es.e").alias("es")).join(asking, "doc_id").withColumn("shared", F.size("es")).where("shared >= need"))
    keyed = ranked.select("family", "doc_id", "root", "n", "surplus", "shared", F.posexplode(F.slice("es", F.lit(1), F.col("shared") - F.col("need") + 1)).alias("place", "e"))
    x, y = (keyed.select("family", "e", *(F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "root", "n", "surplus", "shared", "place"))) for side in "xy")
    left = F.least(F.col("shared_x") - F.col("place_x"), F.col("shared_y") - F.col("place_y"))
    pairs = x.join(y, ["family", "e"]).where(
        (F.col("doc_id_x") < F.col("doc_id_y"))
        & (F.col("root_x") != F.col("root_y"))
        & (percent * F.greatest("n_x", "n_y") <= 100 * F.least("n_x", "n_y"))
        & (double * left >= F.col("surplus_x") + F.col("surplus_y"))
    )
    pairs = stored(pairs.select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b")).distinct())
    ends = ranked.select("doc_id", "es", "surplus")
    full = pairs.join(ends.toDF("a", "es_a", "surplus_a"), "a").join(ends.toDF("b", "es_b", "surplus_b"), "b")
    met = full.where(double * F.size(F.array_intersect("es_a", "es_b")) >= F.col("surplus_a") + F.col("surplus_b"))
    return star.unionByName(met.select("a", "b"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, hub_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, ``kept`` and text_hash (xxhash64 of the row's text) for every document."""
    docs = texts(docs).where(F.col("doc_id").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    found = sketches(docs, size).groupBy("doc_id").agg(F.max(F.struct("n_shingles", "same", "text_hash", "signature", "bands")).alias("x"))
    found = stored(found.select("doc_id", "x.*"))
    full = found.where("n_shingles > 0")
    classes = stored(full.groupBy("same").agg(F.min(F.struct("doc_id", "text_hash", "signature", "bands")).alias("x")).select("same", "x.*"))
    bands = classes.select("doc_id", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = stored(bands.join(shared, "band"))
    ends = members.select("doc_id").distinct()
    signatures = stored(classes.select("doc_id", "text_hash", "signature").join(ends, "doc_id"))
    near = stored(docs.join(signatures.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text"))
    least = percent / 100 - SLACK

    def by_estimate(pairs: DataFrame) -> DataFrame:
        sides = signatures.select("doc_id", "signature")
        both = pairs.join(sides.toDF("a", "sa"), "a").join(sides.toDF("b", "sb"), "b")
        return both.where(estimate(F.col("sa"), F.col("sb")) >= least).select("a", "b")

    def joined(links: DataFrame) -> DataFrame:
        reached = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        return stored(signatures.select("doc_id").join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root")))

    roots = signatures.select("doc_id", F.col("doc_id").alias("root"))
    tried = links = signatures.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
    for turn in range(hub_rounds):
        placed = members.join(roots, "doc_id")
        pick = F.struct((F.xxhash64("doc_id", F.lit(turn)) if turn else F.col("doc_id")).alias("k"), "doc_id", "root")
        hubs = placed.groupBy("band").agg(F.min(pick).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        pairs = placed.join(hubs, "band").where("root <> hub.root").select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")).distinct()
        pairs = stored(by_estimate(pairs.join(tried, ["a", "b"], "left_anti")))
        if pairs.isEmpty():
            break
        new = stored(confirmed(pairs, near, size, percent))
        tried, links = tried.union(pairs), links.union(new)
        roots = joined(links)
    placed = members.join(roots, "doc_id")
    parts = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    placed = stored(placed.join(parts.select("band", "n"), "band"))
    large = placed.where(F.col("n") > SMALL).select("band", "doc_id", "root")
    if not large.isEmpty():
        links = stored(links.union(apart(large, near, size, percent, roots)))
        roots = joined(links)
    sides = classes.select("doc_id", "signature", "bands")
    few = placed.where(F.col("n") <= SMALL).select("band", "doc_id").join(roots, "doc_id").join(sides, "doc_id")
    few = few.withColumn("earlier", F.slice("bands", F.lit(1), F.array_position("bands", F.col("band")).cast("int") - 1))
    x, y = (few.select("band", *(F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "root", "signature", "earlier"))) for side in "xy")
    pairs = x.join(y, "band").where(
        (F.col("doc_id_x") < F.col("doc_id_y"))
        & (F.col("root_x") != F.col("root_y"))
        & (estimate(F.col("signature_x"), F.col("signature_y")) >= least)
        & ~F.arrays_overlap("earlier_x", "earlier_y")
    )
    pairs = stored(pairs.select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b")).join(tried, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        roots = joined(stored(links.union(confirmed(pairs, near, size, percent))))
    firsts = classes.select("same", F.col("doc_id").alias("first"))
    of_class = stored(firsts.join(roots.withColumnRenamed("doc_id", "first"), "first", "left").select("same", F.coalesce("root", "first").alias("component")))
    out = found.select("doc_id", "n_shingles", "text_hash", F.when(F.col("n_shingles") > 0, F.col("same")).alias("same")).join(of_class, "same", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"), "text_hash")
