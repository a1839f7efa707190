"""Mixing, prefix trie and divergence audit against brute force, on odd rows and on the small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landshift.llm import divergence, mixing, prefix_trie, queries
from landshift.llm.common import read, scratch


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# mixing

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType()), T.StructField("target", T.StringType()), T.StructField("part", T.StringType())])


@pytest.fixture(scope="session")
def sourced(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{j}" for j in range(int(rng.integers(0, 90)))), str(rng.choice(["hot", "b", "c", "ß", "z"], p=[0.6, 0.2, 0.1, 0.05, 0.05]))) for k in range(400)]
    rows += [(None, "no number here", "b"), (None, "no number here", "b"), (7, rows[7][1], rows[7][2]), (900, None, "c"), (901, "", None), (902, "null source has words", None), (903, " \n ", "empty"), (904, "v " * 20_000, "")]
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], DOCS)


def expected_targets(sizes):
    """Fractions, by sharing again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, left, free = {}, Fraction(3, 2) * sum(sizes.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return out | share
        for s in above:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        free -= above
    return out


def check_mix(docs, got):
    sizes = Counter()
    for r in docs.select("text", "source").collect():
        sizes[r["source"]] += len(words(r["text"]))
    want, taken = expected_targets(sizes), Counter()
    by_id = {(r["doc_id"], len(words(r["text"])), r["source"]) for r in docs.select("doc_id", "text", "source").collect()}
    for r in got:
        assert (r["doc_id"], r["size"], r["source"]) in by_id
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["words"] for p in r["pieces"])
        spans = Counter(k for p in r["pieces"] for k in range(p["first"], p["first"] + p["words"]))
        assert not spans or (min(spans) >= 0 and max(spans) < r["size"] and max(spans.values()) <= 2)
        taken[r["source"]] += r["taken"]
    assert {s: taken[s] for s in want} == {s: round(float(x)) for s, x in want.items()}
    return want


def test_mix_meets_every_quota_to_the_word(sourced, spark, sf_dir):
    for docs, how in ((sourced, {"block": 16, "shard": 500}), (read(spark, sf_dir, "documents"), {"block": 64, "shard": 10_000}), (sourced, {})):
        got = mixing.mix(docs, **how).collect()
        assert len(got) == docs.count()
        check_mix(docs, got)
        again = mixing.mix(docs.repartition(3), **how).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_have_equal_blocks_and_mixed_sources(sourced):
    got = mixing.mix(sourced, block=16, shard=500).collect()
    draws = defaultdict(set)
    for r in got:
        for p in r["pieces"]:
            draws[p["shard"]].add((r["source"], p["place"]))
    sizes = [len(x) for x in draws.values()]
    assert len(sizes) > 20 and max(sizes) - min(sizes) <= 1 and sorted(draws) == list(range(len(draws)))
    total = Counter(s for x in draws.values() for s, _ in x)
    hot = [sum(s == "hot" for s, _ in x) / len(x) for x in draws.values()]
    assert abs(np.mean(hot) - total["hot"] / sum(total.values())) < 0.02 and np.std(hot) < 0.2


def test_written_shards_hold_the_pieces(sourced, spark):
    path = scratch(spark)
    mixing.write(sourced, path, block=16, shard=500)
    rows = spark.read.parquet(path).collect()
    texts = defaultdict(set)
    for r in sourced.collect():
        texts[r["doc_id"], r["source"]].add(tuple(words(r["text"])))
    for r in rows:
        assert any(tuple(words(r["text"])) == t[r["first"] : r["first"] + r["words"]] for t in texts[r["doc_id"], r["source"]]) and len(words(r["text"])) == r["words"]
    assert sum(r["words"] for r in rows) == sum(r["taken"] for r in mixing.mix(sourced, block=16, shard=500).collect())


def test_permutation_and_splits():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, ("k",))) == list(range(n))
    drawn = [mixing.hypergeometric(30, 70, 50, (k + 0.5) / 2000) for k in range(2000)]
    assert abs(np.mean(drawn) - 15) < 0.05 and abs(np.var(drawn) - 50 * 0.3 * 0.7 * 50 / 99) < 0.2
    assert abs(mixing.hypergeometric(10**12, 3 * 10**12, 10**12, 0.5) - 25 * 10**10) < 10**6
    # Sources side by side: every shard's draws of all sources add up to its blocks.
    counts = [40, 0, 7, 900, 55]
    padded = counts + [0] * 3
    groups = [padded]
    while len(groups[-1]) > 1:
        groups.append([a + b for a, b in zip(groups[-1][::2], groups[-1][1::2], strict=True)])
    filled = Counter()
    for rank, own in enumerate(counts):
        beside = [groups[level][(rank >> level) ^ 1] for level in range(3)]
        names, begins = mixing.intervals(own, beside, rank, 13, 0)
        for name, a, b in zip(names, begins, [*begins, own][1:], strict=True):
            filled[name] += b - a
    assert [filled[k] for k in range(13)] == [sum(counts) * (k + 1) // 13 - sum(counts) * k // 13 for k in range(13)]
    for size in (1, 15, 16, 17, 100, 160):
        for want in range(2 * size + 1):
            draws, last = mixing.quota(size, want, 16, ("q", 1))
            blocks, got = -(-size // 16), 0
            for turn in range(2):
                at = mixing.permuted(np.arange(blocks), blocks, ("q", 1, turn)) + turn * blocks
                for b, x in enumerate(at):
                    got += 0 if x >= draws else min(min(16, size - b * 16), last if x == draws - 1 else 16)
            assert got == want


def test_mix_of_nothing(sourced):
    assert mixing.mix(sourced.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(sourced.where("doc_id IN (900, 903)")).collect()] == [0, 0]


# prefix trie

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("depth", T.StringType()), T.StructField("words", T.StringType())])


def expected_trie(rows):
    """Every prefix of every rebuilt conversation, by plain dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    new = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + (len(members[p]) - 1) * len(words(p[-1][1]) if p else [])
    out = []
    for p, m in members.items():
        end = ",".join(map(str, sorted(c for c in m if len(new[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(end.encode()).hexdigest()))
    return sorted(map(str, out))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def odd_turns():
    rng = np.random.default_rng(9)
    rows = []
    for c in range(300):
        shape = int(rng.integers(6))
        for k in range(int(rng.integers(1, 9))):
            text = "hot first turn" if k == 0 and shape < 3 else "same text here" if shape in (1, 4) else f"turn {k} of {c % 7} {'word ' * (c % 5)}"
            rows.append((c, k, ("user", "assistant")[k % 2], text))
    rows += [(1000 + c, 0, "user", "one turn") for c in range(40)] + [(2000 + c, k, "user", "copied conversation") for c in range(60) for k in range(3)]
    rows += [(5000, None, None, None), (5000, 1, "user", None), (5000, 1, "user", None), (5001, 0, None, ""), (None, 0, "user", "nobody"), (5002, 3, "user", "long " * 30_000), (5003, 0, "", "x"), (5003, 0, "a", "x")]
    return rows


def test_trie_is_the_brute_force_one(spark, sf_dir, monkeypatch):
    made = spark.createDataFrame([(*r, "x", "x") for r in odd_turns()], TURNS)
    given = read(spark, sf_dir, "conversations")
    try:
        for parts in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for turns in (made, given):
                got = prefix_trie.trie(turns).select(COLUMNS).collect()
                assert sorted(str(tuple(r)) for r in got) == expected_trie([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_lists_of_ends_may_be_cut_anywhere(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    keyed = spark.createDataFrame([("a" if c % 3 else "b", c) for c in range(200)], "key_name string, conv_id long")
    got = {r["key_name"]: r["ends_sha256"] for r in prefix_trie.ends(keyed).collect()}
    for k in "ab":
        assert got[k] == hashlib.sha256(",".join(str(c) for c in range(200) if (k == "a") == bool(c % 3)).encode()).hexdigest()


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    one = spark.createDataFrame([(c, 0, "user", "t", "x", "x") for c in range(1, 20)], TURNS)
    got = prefix_trie.trie(one).collect()  # no conversation 0: most lose their only turn
    assert {r["depth"] for r in got} == {0, 1} and [r["n_convs"] for r in got if not r["depth"]] == [19]


# divergence audit


def expected_audit(rows, least=10):
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        count[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in seen[lang].items() if n >= least), key=str.encode)
        tables = {s: [count[lang, s][t] for t in kept] for s in sources}
        tables[None] = [sum(tables[s][k] for s in sources) for k in range(len(kept))]
        p = {s: [1 + 10**9 * (c + 2) // (sum(cs) + 2 * len(kept)) for c in cs] for s, cs in tables.items()}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = sorted(((sum(map(f, p[s], p[t])), t) for t in sources if t != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(a, b), t) for a, b, t, c in zip(p[s], p[None], kept, tables[s], strict=True) if c and a > b), key=lambda x: (-x[0], x[1].encode()))[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(map(str, out))


AUDIT = ["lang", "source", "part", "item", "value", "rank"]


def odd_texts():
    rng = np.random.default_rng(6)
    vocabulary = [f"w{''.join(chr(97 + int(x)) for x in rng.integers(0, 3, 3))}" for _ in range(60)] + ["ÉTÉ", "été", "naïve", "中文", "İx", "the", "THE", "a1b", "th"]
    rows = [(" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))), str(rng.choice(["en", "de"])), str(rng.choice(["hot", "s1", "s2", "é", "Z"], p=[0.5, 0.2, 0.1, 0.1, 0.1]))) for _ in range(250)]
    rows += [("x y", "xx", "a"), ("x y", "xx", "b"), (None, None, None), ("", "en", "no terms"), ("word " * 12, None, "s1"), ("b" * 20_000, "en", "hot"), *[("tie one two", "tt", s) for s in "ab" for _ in range(6)]]
    return rows


def test_audit_is_the_brute_force_one(spark, sf_dir, monkeypatch):
    made = spark.createDataFrame([(k, *r, "x", "x") for k, r in enumerate(odd_texts())], "doc_id long, text string, lang string, source string, part string, value string")
    for docs, cells in ((made, 1 << 21), (made, 50), (read(spark, sf_dir, "documents"), 1 << 21)):
        monkeypatch.setattr(divergence, "CELLS", cells)
        got = divergence.audit(docs).select(AUDIT).collect()
        assert sorted(str(tuple(r)) for r in got) == expected_audit([tuple(r) for r in docs.select("text", "lang", "source").collect()])
    assert divergence.audit(made.limit(0)).count() == 0


def test_tries_that_are_read_out_early_merge_alike(spark, sf_dir):
    rows, counts, to = odd_texts(), divergence.Counts(), __import__("landshift.llm.common", fromlist=["arrow"]).arrow(divergence.LEAF)
    whole, halves = divergence.Counts(), []
    for k, (text, lang, source) in enumerate(rows):
        whole.add(lang or "", source or "", (text or "").encode())
        counts.add(lang or "", source or "", (text or "").encode())
        if k % 20 == 19:
            counts.settle()
            halves += list(counts.read_out(to))
    counts.settle()
    halves += list(counts.read_out(to))
    whole.settle()
    tries = defaultdict(divergence.Trie)
    for batch in halves:
        for r in batch.to_pylist():
            one = divergence.Trie()
            one.leaf(r["term"].encode()).update({None: r["docs"]} | dict(zip(r["sources"], r["counts"], strict=True)))
            tries[r["lang"]].merge(one)
    for lang, trie in whole.tries.items():
        assert list(trie) == list(tries[lang])
        assert [t for t, _ in trie] == sorted(t for t, _ in trie)


def test_shares_do_not_overflow():
    big = np.array([0, 5, 10**12, 4 * 10**15], np.int64)
    of = 5 * 10**15
    assert divergence.shares(big, of).tolist() == [1 + 10**9 * (int(c) + 2) // of for c in big]


def test_queries_of_the_new_operators(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    assert queries.op11_source_mixing(spark, sf_dir).columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert queries.op11_source_mixing(spark, sf_dir).count() == docs.count()
    assert queries.op12_prefix_trie(spark, sf_dir).columns == COLUMNS
    assert set(queries.op13_divergence(spark, sf_dir).columns) == set(AUDIT)
    assert queries.op13_divergence(spark, sf_dir).where(F.col("part") == "pair").count() > 0
