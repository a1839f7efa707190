"""Operators against brute force, on odd rows and on the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landshift.llm import bpe, decontamination, licenses, lm_scoring, near_dedup, quality_model, quality_rules, queries, substring_dedup, token_files, toxicity
from landshift.llm.common import PLAIN_WORDS, read, scratch
from tests.llm.conftest import ODD, PROSE

EMPTY = []


def rows(df, *key):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str([r[k] for k in key or ("doc_id",)]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# quality rules


def base(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    count = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {k + j for k in range(len(w) - 2) if count[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(map((text or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(again)


def test_line_cleaning_base(odd, spark, sf_dir):
    for df in (odd, read(spark, sf_dir, "documents")):
        texts_ = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        want = sorted((str(i), *base(t)) for i, t in texts_)
        got = quality_rules.line_cleaning(df).collect()
        assert want == sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])


def test_line_cleaning_verdict(documents):
    good = ". ".join(" ".join(f"word{chr(97 + k % 26)}{j * j + k}" for j in range(9)) for k in range(12)) + "."
    menu = "\n".join(f"Home | News {k} | About | Contact | Search | Login | Help {k} | Terms" for k in range(30))
    shout = "\n".join(f"BUY{k}!! NOW{k}!! ALL{k}!! OF{k}!! THESE{k}!! THINGS{k}!! TODAY{k}!!" for k in range(30))
    got = {r["doc_id"]: r for r in quality_rules.line_cleaning(documents([(1, good), (2, menu), (3, shout), (4, good + "\nAll rights reserved."), (5, good + "\n" + menu)])).collect()}
    assert [got[k]["kept"] for k in range(1, 6)] == [True, False, False, True, False]
    assert got[4]["cleaned"] == good and got[4]["lines_failed"] == 1


def test_menus_of_every_separator(documents):
    good = ". ".join(" ".join(f"word{chr(97 + k % 26)}{j * j + k}" for j in range(9)) for k in range(12)) + "."
    separators = sorted(x.decode() for x in quality_rules.SEPARATORS)
    menus = [f" {x} ".join(["Home", "News", "About", "Contact", "Help"]) for x in separators]
    for menu in menus:
        assert quality_rules.LineRules().failed(menu.encode(), menu.encode().split()) == "navigation"
        assert quality_model.measure(menu.encode())[quality_model.STATISTICS.index("separators_per_word")] == 4 / 9
    got = {r["doc_id"]: r for r in quality_rules.line_cleaning(documents([(k, f"{good}\n{m}") for k, m in enumerate(menus)])).collect()}
    assert all(got[k]["cleaned"] == good and got[k]["lines_failed"] == 1 for k in range(len(menus)))


@pytest.mark.parametrize("size", [2, 3])
def test_repeated_words_long_and_tied(size):
    w = [b"a", b"b"] * 50 + [b"c"] + [b"a"] * 7
    grams = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
    count = Counter(grams)
    assert quality_rules.repeated_words(w, size) == len({k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(size)})


def test_line_cleaning_of_an_empty_table(spark, documents):
    assert quality_rules.line_cleaning(documents(EMPTY)).count() == 0


# decontamination


def plain(text, size=5):
    w = (text or "").encode().translate(PLAIN_WORDS).split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def test_decontamination_finds_all(spark, documents):
    rng = np.random.default_rng(3)
    lexicon = [f"v{k}" for k in range(5000)]
    items = [(k, " ".join(rng.choice(lexicon, 12 + 9 * k))) for k in range(30)] + [(100, None), (101, "too short"), (102, "")]
    texts_ = []
    for k in range(120):
        body = list(rng.choice(lexicon, 400 + 5 * k))
        if k % 3 == 0:
            item = items[k % 30][1].split()
            if k % 2:
                item[len(item) // 2] = "changed"
            body[77:77] = [w.upper() + "," for w in item]
        texts_.append((k, " ".join(body)))
    docs = documents([*texts_, (None, texts_[0][1]), (500, None), (501, "")])
    want = {(d, i) for d, t in [*texts_, (None, texts_[0][1])] for i, x in items if plain(x) and len(plain(t) & plain(x)) >= 0.8 * len(plain(x))}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 20


def test_decontamination_finds_short_items(spark, documents):
    rng = np.random.default_rng(5)
    lexicon = [f"v{k}" for k in range(5000)]
    items = [(k, " ".join(rng.choice(lexicon, 5 + k % 3))) for k in range(450)] + [(1000 + k, " ".join([f"s{k}", "and", "So", "on!"][: 1 + k % 4])) for k in range(40)] + [(2000, "?!")]
    docs = []
    for k, (_, item) in enumerate(items):
        body = list(rng.choice(lexicon, 600))
        at = int(rng.integers(0, 600))
        body[at:at] = item.upper().split()
        docs.append((k, " ".join(body), at))
    got = {(r["doc_id"], r["item_id"]): (r["containment"], r["first_word"]) for r in decontamination.search(documents([(k, t) for k, t, _ in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, items[k][0]): (1.0, at) for k, _, at in docs[:-1]}


def test_decontamination_blocks_and_empty(spark, documents, monkeypatch):
    items = spark.createDataFrame([(1, PROSE), (2, PROSE + " more of it follows here now")], "item_id long, text string")
    docs = documents([(1, PROSE), (2, "nothing of the kind")])
    whole = rows(decontamination.search(docs, items), "doc_id", "item_id")
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 100)
    assert rows(decontamination.search(docs, items), "doc_id", "item_id") == whole and len(whole) >= 1
    assert decontamination.search(docs, items.limit(0)).count() == 0
    assert decontamination.search(documents(EMPTY), items).count() == 0


# LM scoring


def lm_losses(texts_, chosen):
    """(n_words, target loss, background loss) of each text by the formula, its own counts taken out."""
    split = [(s or "").split() for _, s in texts_]
    kinds = len({w for s in split for w in s}) + any(split)
    share = min(1.0, lm_scoring.WORDS / max(1, kinds))
    models = []
    for inside in (chosen, [True] * len(split)):
        mine = [["^", *s, "$"] for s, c in zip(split, inside, strict=True) if c and s]
        models.append((inside, Counter(w for s in mine for w in s[1:]), Counter(p for s in mine for p in zip(s, s[1:], strict=False)), len(mine)))
    out = []
    for k, s in enumerate(split):
        seq, means = ["^", *s, "$"], []
        for inside, uni, bi, n in models:
            uni, bi, n = Counter(uni), bi, n
            own_uni, own_bi = (Counter(seq[1:]), Counter(zip(seq, seq[1:], strict=False))) if inside[k] else (Counter(), Counter())
            size, total = sum(uni.values()) - own_uni.total(), 0.0
            for v, w in zip(seq, seq[1:], strict=False) if s else ():
                p = (uni[w] - own_uni[w] + share) / (size + share * kinds)
                history = n - inside[k] if v == "^" else uni[v] - own_uni[v]
                total -= math.log((bi[v, w] - own_bi[v, w] + lm_scoring.KAPPA * p) / (history + lm_scoring.KAPPA))
            means.append(total / (len(s) + 1) if s else 0.0)
        out.append((len(s), *means))
    return out


def test_lm_scores_follow_the_formula(spark, documents, odd):
    texts_ = [(1, "a b a b c"), (2, "c c d"), (3, ""), (4, None), (5, "a b a b c"), (None, "a b"), (6, "d d d d")]
    ids = spark.createDataFrame([(1,), (2,), (4,), (None,), (77,)], "doc_id long")
    got = {r["doc_id"]: (r["n_words"], r["target_loss"], r["background_loss"]) for r in lm_scoring.score(documents(texts_), ids).collect()}
    for (i, _), want in zip(texts_, lm_losses(texts_, [i in (1, 2, 4) for i, _ in texts_]), strict=True):
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert lm_scoring.score(odd, ids).count() == len(ODD)
    assert lm_scoring.score(documents(EMPTY), ids).count() == 0
    assert lm_scoring.score(documents([(1, None), (2, " ")]), ids).where("score = 0").count() == 2


def test_lm_scores_see_marks_and_lines(spark, documents):
    """Menus and symbols between the same words are told apart from prose, by each other alone."""
    prose = [(k, f"we went to the river, and word{k} came.\nIt was late.") for k in range(40)]
    menus = [(100 + k, f"we | went | to ### the ### river | and | word{k} | came") for k in range(40)]
    got = {r["doc_id"]: r for r in lm_scoring.score(documents(prose + menus), documents(prose[::2]).select("doc_id")).collect()}
    held = [got[k]["score"] for k, _ in prose[1::2]]
    assert min(held) > max(got[k]["score"] for k, _ in menus)
    assert got[1]["n_words"] == 15 and got[100]["n_words"] == 15


def test_lm_counts_are_exact_beyond_any_fixed_size(spark, documents, monkeypatch):
    rng = np.random.default_rng(21)
    lexicon = [f"x{k}" for k in range(40_000)]
    texts_ = [(k, " ".join(rng.choice(lexicon, 15_000))) for k in range(40)]
    texts_ += [(100, "often seen " * 300), (101, "x1 x2 never often"), (102, None), (None, "x3 x4")]
    monkeypatch.setattr(lm_scoring, "GROUP", 300_000)
    monkeypatch.setattr(lm_scoring, "BUCKET", 500_000)
    monkeypatch.setattr(lm_scoring, "PIECE", 1000)
    monkeypatch.setattr(lm_scoring, "STRETCH", 777)
    docs = documents(texts_)
    assert lm_scoring.bucket_bits(docs) > 2
    got = {r["doc_id"]: (r["n_words"], r["target_loss"], r["background_loss"]) for r in lm_scoring.score(docs, docs.where("doc_id < 8 OR doc_id > 100")).collect()}
    assert len(got) == len(texts_)
    for (i, _), want in zip(texts_, lm_losses(texts_, [i is not None and (i < 8 or i > 100) for i, _ in texts_]), strict=True):
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_lm_probabilities_sum_to_one():
    """Over the vocabulary and the end, after any word, as the smoothing is written."""
    kinds, share = 3 + 1, 1.0
    uni, after = {"a": 4, "b": 2, "c": 0, "$": 3}, {"a": 1, "b": 2, "c": 0, "$": 1}
    p = {w: (n + share) / (sum(uni.values()) + share * kinds) for w, n in uni.items()}
    assert sum((after[w] + lm_scoring.KAPPA * p[w]) / (uni["a"] + lm_scoring.KAPPA) for w in uni) == pytest.approx(1)


def test_op3_scores_target_and_held_out_texts_alike(spark):
    """Own counts are out: trained-on good rows don't stand out beside held-out good rows."""
    sf = "/root/testdata/sf0.01"
    scored = {r["doc_id"]: r["score"] for r in queries.op3_lm_scoring(spark, sf).collect()}
    good = [r["doc_id"] for r in read(spark, sf, "labels").where("quality = 1").collect()]
    held = [scored[i] for i in good if zlib.crc32(str(i).encode()) % 5 == 0]
    trained = [scored[i] for i in good if zlib.crc32(str(i).encode()) % 5]
    assert abs(np.median(held) - np.median(trained)) < 0.15
    bad = [scored[r["doc_id"]] for r in read(spark, sf, "labels").where("quality = 0").collect()]
    assert np.mean([[g > b for b in bad] for g in held]) > 0.8  # held-out good rows against bad ones, which no target text holds


# BPE and token files


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_is_the_librarys(odd, spark, sf_dir):
    t = library()
    for df in (odd, read(spark, sf_dir, "documents")):
        want = sorted((str(r["doc_id"]), ids := t.encode(r["text"] or "", add_special_tokens=False).ids, t.decode(ids, skip_special_tokens=False)) for r in df.select("doc_id", "text").collect())
        for both in (bpe.decode(bpe.encode(df)), bpe.round_trip(df)):
            assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in both.collect()) == want


def test_bpe_queue_skips_stale_entries():
    ours, t = bpe.loaded(bpe.default_vocabulary()), library()
    for w in ("aaaaaaaaaaaaaaa", "ababababababab", "banana", "thethethethe", "é" * 40, "x" * 5000, "inininin", "mississippi"):
        assert ours.encode(w.encode()).tolist() == t.encode(w, add_special_tokens=False).ids


def test_bpe_starts_over_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 2)
    ours, t = bpe.WordBpe(bpe.default_vocabulary()), library()
    for text in (PROSE, PROSE[::-1], PROSE):
        assert ours.encode(text.encode()).tolist() == t.encode(text, add_special_tokens=False).ids


def test_ids_do_not_depend_on_what_came_before():
    """Control characters beside every script: the symbols that stand for them are letters of other words; in one shared instance, in both orders."""
    t, rng = library(), np.random.default_rng(11)
    pools = [range(32), range(128), range(0x80, 0x250), range(0x300, 0x340), range(0x370, 0x600), range(0x4E00, 0x4E40), range(0x1F600, 0x1F640), [0x130, 0x131, 0x17F, 0x180, 0x1E9E, 0x345, 0x3C2]]
    texts = ["ą ę", "中\x05", "中\x07 中\x1b", "ě ć"]
    for _ in range(15_000):
        some = [pools[k] for k in rng.choice(len(pools), int(rng.integers(1, 4)), replace=False)]
        texts.append("".join(chr(p[int(rng.integers(len(p)))]) for p in (some[int(rng.integers(len(some)))] for _ in range(int(rng.integers(1, 13))))))
    for order in (1, -1):
        own = bpe.loaded(bpe.default_vocabulary()).emptied()
        for text in texts[::order]:
            assert own.encode(text.encode()).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_ids_of_every_code_point_and_of_random_strings():
    """Both encoders against the library: every code point in a word and alone, and strings of all scripts."""
    path, t = bpe.default_vocabulary(), library()
    own, files = bpe.WordBpe(path), token_files.LibraryWords(path)
    rng = np.random.default_rng(3)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    blocks = [" ".join(f"a{chr(c)}b {chr(c)}" for c in points[at : at + 20_000]) for at in range(0, len(points), 20_000)]
    scripts = np.r_[np.arange(32, 0x600), np.arange(0x900, 0xD00), np.arange(0x1E00, 0x2100), [0x130, 0x327, 0x301, 0x3A3, 0x307, 0x558, 0x88F, 0x16EAB, 0x1F600]]
    blocks += ["".join(map(chr, rng.choice(scripts, int(rng.integers(1, 30))))) for _ in range(30_000)]
    for text in blocks:
        want, raw = t.encode(text, add_special_tokens=False).ids, text.encode()
        assert own.encode(raw).tolist() == want, text[:50]
        files.learn(set(raw.split()))
        assert b"".join(map(files.known.__getitem__, raw.split())) == np.array(want, "<u4").tobytes(), text[:50]
        files.known.clear()


def test_token_files_round_trip(odd, spark, monkeypatch):
    t, path = library(), scratch(spark)
    token_files.write(odd, path)
    starts = {(r["part"], r["chunk"]): r["start"] for r in token_files.chunk_starts(spark, path).collect()}
    got = sorted((starts[r["part"], r["chunk"]] + r["offset"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_files.read_documents(spark, path).collect())
    at = 0
    for (start, doc, ids), (want, text) in zip(got, sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        assert (start, doc) == (at, want) and ids == [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at += len(ids)


def test_token_files_give_the_library_each_piece_once():
    """Accented words are cut to pieces like ASCII ones, so no piece is encoded again for its marks or its capitals."""
    files, given = token_files.LibraryWords(bpe.default_vocabulary()), []
    inner, t = files.library, library()

    class Spy:
        def encode(self, text, **more):
            given.append(text)
            return inner.encode(text, **more)

        def encode_batch_fast(self, some, **more):
            given.extend(some)
            return inner.encode_batch_fast(some, **more)

    files.library = Spy()
    words = ["über", "Über,", "ÜBER.", "über9", "it's", "IT'S,", "straße", "Straße,"]
    files.learn({w.encode() for w in words[:4]})
    files.learn({w.encode() for w in words})
    assert all(np.frombuffer(files.known[w.encode()], "<u4").tolist() == t.encode(w, add_special_tokens=False).ids for w in words)
    assert sorted(" ".join(given).split()) == sorted(["über", ",", ".", "9", "it", "'s", "straße"])


def test_token_files_forget_and_learn_again(monkeypatch):
    t, texts_ = library(), [*(text for _, text in ODD), "", None, " \x0b\x1c a\x85b\u00a0c ", "<|endoftext|> x<|startoftext|>Ü", "İ ſ'ſ 'S", PROSE, PROSE[::-1], PROSE]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts_]
    for most in (token_files.CACHE, 3):
        monkeypatch.setattr(token_files, "CACHE", most)
        files = token_files.LibraryWords(bpe.default_vocabulary())
        assert [x.tolist() for x in files.encode(pa.array(texts_, pa.string()), 2)] == want
        for x, ids in zip(texts_, want, strict=True):
            assert [y.tolist() for y in files.encode(pa.array([x], pa.string()), 2)] == [ids]


def test_token_files_of_nothing(documents, spark):
    path = scratch(spark)
    token_files.write(documents(EMPTY), path)
    assert token_files.read_documents(spark, path).count() == 0 and token_files.chunk_starts(spark, path).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, token_files.BLOCK - 1, token_files.BLOCK, 2 * token_files.BLOCK + 5):
        ids = rng.integers(0, 2**32, n, np.uint32)
        assert (token_files.unpack(*token_files.pack(ids)) == ids).all()


def test_op4_and_op10_digests(spark, sf_dir):
    t, at = library(), 0
    texts_ = sorted((r["doc_id"], r["text"]) for r in read(spark, sf_dir, "documents").collect())
    four = {r["doc_id"]: r for r in queries.op4_bpe(spark, sf_dir).collect()}
    ten = {r["doc_id"]: r for r in queries.op10_token_files(spark, sf_dir).collect()}
    for doc, text in texts_:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert four[doc]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert four[doc]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        ids.append(2)
        assert (ten[doc]["start"], ten[doc]["n_tokens"], ten[doc]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# substring dedup


def cut(pairs, size):
    """Brute force: the words that stay, by row."""
    first = {}
    for i, t in pairs:
        w = words(t)
        for k in range(len(w) - size + 1) if i is not None else ():
            first[tuple(w[k : k + size])] = min(i, first.get(tuple(w[k : k + size]), i))
    out = []
    for i, t in pairs:
        w = words(t)
        gone = {k + j for k in range(len(w) - size + 1) if i is not None and first[tuple(w[k : k + size])] < i for j in range(size)}
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("size", [2, 5, 13])
def test_substring_dedup_is_brute_force(documents, odd, size):
    rng = np.random.default_rng(size)
    pairs = list(ODD)
    parts = [[f"p{k}x{j}" for j in range(int(rng.integers(2, 60)))] for k in range(6)]
    for k in range(20, 80):
        body = [str(x) for x in rng.integers(0, 6, int(rng.integers(0, 60)))]
        body[3:3] = parts[int(rng.integers(0, 6))]
        pairs.append((k, " ".join(body + ["a"] * int(rng.integers(0, 30)))))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(documents(pairs), size).collect())
    assert got == cut(pairs, size)


def test_substring_dedup_across_chunks(documents, monkeypatch):
    pairs = [(k, " ".join(f"w{(k * 7 + j) % 90}" for j in range(50))) for k in range(60)]
    ids, found = np.arange(60), [near_dedup.word_hashes([w.encode() for w in t.split()]) for _, t in pairs]
    for chunk in (7, 60):
        back = {}
        buckets = {}
        for at in range(0, 60, chunk):
            for b, doc, _, starts, payload in substring_dedup.records(ids[at : at + chunk], np.zeros(len(ids[at : at + chunk]), np.int64), found[at : at + chunk], 13, 4):
                if b < 0:
                    back.setdefault(doc, set()).update(np.frombuffer(starts, "<u4").tolist())
                else:
                    buckets.setdefault(b, []).append(payload)
        for payloads in buckets.values():
            for doc, _, starts in substring_dedup.resolved(payloads):
                back.setdefault(doc, set()).update(np.frombuffer(starts, "<u4").tolist())
        for doc, text in pairs:
            n, gone = 50, sorted(back.get(doc, ()))
            keep = ~substring_dedup.removed(n, [np.array(gone, "<u4").tobytes()], 13)
            assert (str(doc), n, int((~keep).sum()), " ".join(np.array(text.split())[keep])) in cut(pairs, 13)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    core = rng.integers(0, 2**63, 13).astype(np.uint64)
    core[4:7] = core[4]
    seen = set()
    for _ in range(200):
        left, right = rng.integers(0, 2**63, int(rng.integers(0, 9))).astype(np.uint64), rng.integers(0, 2**63, int(rng.integers(0, 9))).astype(np.uint64)
        left[len(left) // 2 :] = core[0]
        doc = np.concatenate([left, core, right])
        parse = substring_dedup.levels(doc, np.array([len(doc)]), 3)
        seen.add(int(substring_dedup.context_names(parse, doc, substring_dedup.anchors(parse, np.array([len(left)]), 13))[0]))
    assert len(seen) == 1


def test_cut_repeats_keeps_columns_and_spaces(documents):
    passage = " ".join(f"p{k}" for k in range(20))
    df = documents([(1, f"a\n{passage}\nb"), (2, f"c  {passage}\t\td\ne"), (3, None), (4, "x  y")])
    out = {r["doc_id"]: r for r in substring_dedup.cut_repeats(df, 13).collect()}
    assert out[2]["text"] == "c  d\ne" and out[2]["n_chars"] == 6 and out[1]["text"] == f"a\n{passage}\nb" and out[4]["text"] == "x  y" and out[3]["text"] is None
    assert substring_dedup.cut_repeats(df, 13).columns == df.columns
    assert substring_dedup.remove_repeats(documents(EMPTY)).count() == 0


# near-dedup


def components(pairs, size, percent):
    sets = {}
    for i, t in pairs:
        w = (t or "").encode().translate(near_dedup.LOWER_AZ).split()
        if i is not None:
            s = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
            sets[i] = max(s, sets.get(i, set()), key=len)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_near_dedup_is_brute_force(documents):
    rng = np.random.default_rng(5)
    pairs = list(ODD)
    at = 100
    for _ in range(4):
        text = [f"z{x}" for x in rng.integers(0, 10**6, 120)]
        for _ in range(25):  # a chain: each a step from the last, the ends far apart
            pairs.append((at, " ".join(text)))
            at += 1
            text = list(text)
            text[int(rng.integers(0, 120))] = f"n{at}"
    pairs += [(at + k, pairs[15][1].upper()) for k in range(30)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(documents(pairs), 3, 85).collect())
    assert got == components(pairs, 3, 85)


def test_near_dedup_of_a_large_group_around_the_threshold(documents):
    """2000 texts of one origin, most pairs of them between 0.7 and 0.87 alike, some of them versions of one another."""
    rng = np.random.default_rng(17)
    origin, pairs, made = [f"g{x}" for x in rng.integers(0, 10**6, 150)], [], []
    for k in range(2000):
        text = list(made[int(rng.integers(0, len(made)))] if k % 3 == 2 else origin)
        for at in rng.integers(0, 150, int(rng.integers(1, 4 if k % 3 == 2 else 12))):
            text[at] = f"e{k}x{at}" if rng.random() < 0.7 else f"common{at % 3}"
        made.append(text)
        pairs.append((k + 1, " ".join(text)))
    for i in (17, 400):  # repeated rows, other texts of the same doc_id and none of any
        pairs += [pairs[i], (pairs[i][0], "a short text"), (None, pairs[i][1])]
    index: dict = {}
    sets = [{index.setdefault(tuple(t[k : k + 3]), len(index)) for k in range(148)} for t in made]
    has = np.zeros((len(sets), len(index)), np.float32)
    for k, s in enumerate(sets):
        has[k, list(s)] = 1
    both, n = has @ has.T, has.sum(1)
    linked = 100 * both >= 85 * (n[:, None] + n[None, :] - both) - 1e-3
    root = np.arange(len(sets))
    while True:
        low = np.where(linked, root[None, :], len(sets)).min(1)
        if (low == root).all():
            break
        root = low
    assert 50 < len(set(root.tolist())) < 1500
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(documents(pairs), 3, 85).collect()}
    assert got == {k + 1: (len(sets[k]), int(root[k]) + 1) for k in range(len(sets))}


def test_near_dedup_of_nothing(documents):
    assert near_dedup.near_duplicates(documents(EMPTY)).count() == 0
    assert near_dedup.near_duplicates(documents([(1, None), (2, "")])).where("kept").count() == 2


def test_estimates_are_near_the_truth(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(1, 2**32, near_dedup.HASHES, np.uint32) | np.uint32(1), rng.integers(0, 2**32, near_dedup.HASHES, np.uint32)
    cases = []
    for share in (0.0, 0.5, 0.85, 1.0):
        both = rng.integers(0, 2**63, int(1000 * share)).astype(np.uint64)
        x, y = (np.unique(np.r_[both, rng.integers(0, 2**63, (1000 - len(both)) // 2).astype(np.uint64)]) for _ in range(2))
        cases.append((share, near_dedup.packed(near_dedup.sketch(x, a, b)).tolist(), near_dedup.packed(near_dedup.sketch(y, a, b)).tolist()))
    df = spark.createDataFrame(cases, "share double, x array<long>, y array<long>")
    for r in df.select("share", near_dedup.estimate(F.col("x"), F.col("y")).alias("e")).collect():
        assert abs(r["e"] - r["share"]) < 0.2


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(500, 400), (500, 400)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(2, 41)} | {k: 100 for k in range(101, 130)} | {500: 400}


# licenses


def test_license_scan(documents, odd):
    texts_ = [
        (1, "x\nReleased under the MIT License. Also under the mit license"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "CC BY-NC"),
        (5, "no license here"),
        (6, "underthe mit license"),
        (7, "This work is licensed\nunder the GNU General Public License, version 3."),
        (8, "Released under the BSD license"),
        (9, "Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated\n * documentation files"),
        (10, " ".join(f"{w} {' '.join(f'x{k}y{j}' for j in range(9))}" for k, w in enumerate("this work is licensed under the gnu general public license version 3".split()))),
        (11, "Licensed under the GNU Lesser General Public License"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(documents(texts_)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["score"]) == (2, 2, 7, "mit", 1.0)
    assert (got[2]["n_base"], got[2]["base_labels"], got[2]["labels"]) == (1, "apache-2", "apache-2")
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["base_labels"], got[3]["labels"], got[3]["score"]) == (0, None, "", "gpl-3", 1.0)
    assert got[4]["base_labels"] == "cc-by-nc" and got[5]["labels"] == "" and got[6]["n_base"] == 0
    assert got[7]["labels"] == "gpl-3" and got[9]["labels"] == "mit" and got[11]["labels"] == "lgpl"
    assert got[8]["labels"] == got[10]["labels"] == ""
    assert [(b["first_word"], b["last_word"]) for b in got[7]["blocks"]] == [(0, 11)]
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(documents(EMPTY)).count() == 0


def test_license_filters_lose_nothing(documents):
    rng = np.random.default_rng(2)
    lexicon = [f"t{k}" for k in range(40)]
    templates = [(f"L{k}", " ".join(rng.choice(lexicon, int(rng.integers(1, 12)), replace=False))) for k in range(15)]
    texts_ = [(k, "\n".join(" ".join(rng.choice(lexicon, int(rng.integers(1, 25)))) for _ in range(5))) for k in range(60)]
    got = {r["doc_id"]: [(b["first_word"], b["last_word"], b["label"], round(b["containment"], 9)) for b in r["blocks"]] for r in licenses.scan(documents(texts_), templates, {}, 0.8).collect()}
    for k, text in texts_:
        w, want = text.split(), []
        for label, t in templates:
            have, span, stretches = set(t.split()), int(np.ceil(len(t.split()) / 0.8 - 1e-9)), []
            for i in range(len(w)):
                hits = [j for j in range(i, min(len(w), i + span)) if w[j] in have]
                share = len({w[j] for j in hits}) / len(have)
                if share >= 0.8 - 1e-9 and w[i] in have:
                    if stretches and i <= stretches[-1][1]:
                        stretches[-1] = (stretches[-1][0], max(stretches[-1][1], hits[-1]), label, max(stretches[-1][3], round(share, 9)))
                    else:
                        stretches.append((i, hits[-1], label, round(share, 9)))
            want += stretches
        assert sorted(got[k]) == sorted(want)
    assert any(got.values())


# quality model and toxicity


def test_quality_model_on_held_out(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    scored = queries.op6_quality_classifier(spark, sf).join(read(spark, sf, "labels"), "doc_id").where("held_out")
    right = scored.where("predicted = quality").count() / scored.count()
    assert right > 0.95


def test_quality_model_odd(odd, documents, spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(None, 1, 0), (3, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train(odd, labels)
    got = quality_model.score(odd, model)
    assert got.count() == len(ODD) and got.where("score BETWEEN 0 AND 1").count() == len(ODD)
    none = quality_model.train(odd, labels.limit(0))
    assert none.rules == () and quality_model.score(documents(EMPTY), none).count() == 0
    assert quality_model.keep(odd, none, 0.3).columns == odd.columns and quality_model.keep(odd, none, 0.3).count() == len(ODD)


def test_rules_compiled_to_columns_agree_with_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.random((600, len(quality_model.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.6)).astype(float)
    model = quality_model.fit(x, y)
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{s} double" for s in quality_model.STATISTICS))
    got = np.array([r[0] for r in df.select(model.column()).collect()])
    margin = model.intercept + sum(w * quality_model.holds(r, x) for r, w in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-margin))) and ((got > 0.5) == (y > 0.5)).mean() > 0.97


def test_toxicity_finds_disguised_insults(documents, spark):
    rng = np.random.default_rng(8)
    lexicon = ["".join(rng.choice(list("abdeghinorstu"), int(rng.integers(3, 9)))) for _ in range(900)]
    insults = ["blockhead", "nitwit", "scoundrel"]
    texts_, labels = [], []
    for k in range(500):
        w = list(rng.choice(lexicon, 40))
        if k % 4 == 0:
            for i in rng.choice(insults, 2):
                w.insert(int(rng.integers(0, 40)), str(i))
        texts_.append((k, " ".join(w) + "."))
        labels.append((k, 1, int(k % 4 == 0)))
    docs, labels = documents(texts_), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    held = toxicity.score(docs, model).join(labels, "doc_id").where("crc32(string(doc_id)) % 5 = 0")
    assert held.where("(score >= 0.5) = (toxic = 1)").count() >= 0.95 * held.count()
    clean = " ".join(lexicon[:30])
    probes = documents([(1, f"{clean} block.head"), (2, f"{clean} NITWIT!"), (3, f"{clean} scoun*drel"), (4, clean), (5, None), (6, "")])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(probes, model).collect()}
    assert min(got[1], got[2], got[3]) > 0.5 > max(got[4], got[5], got[6])
    disguise = [lambda w: ".".join(w), lambda w: "--".join(w), lambda w: " ".join(w), lambda w: w.upper() + "!!", lambda w: w[:3] + "x" + w[3:]]
    spread = [(k, f"{clean} {f(w)} {' '.join(lexicon[30:40])}") for k, (f, w) in enumerate((f, w) for f in disguise for w in insults)]
    assert toxicity.score(documents(spread), model).where("score >= 0.5").count() == len(spread)
    plain = [(k, " ".join(rng.choice(lexicon, 40))) for k in range(60)] + [(60, " ".join("abdefghi" * 500)), (61, "ab" * 50_000)]
    assert toxicity.score(documents(plain), model).where("score >= 0.5").count() <= 1


def test_toxicity_windows_cover_every_place():
    assert toxicity.units(b"An I d. i o t, or x y") == [b"an", b"i", b"d.", b"i", b"o", b"t,", b"or", b"x", b"y", b"idiot"]
    place, seen = toxicity.windows([b"a.b", b"", b"x" * 100 + b"idiot" + b"y" * 200])
    assert seen[:2] == [b"ab", b""] and list(place[:3]) == [0, 1, 2] and max(map(len, seen)) == toxicity.UNIT
    assert any(b"idiot" in w for w in seen) and seen[-1].endswith(b"y")


def test_toxicity_odd(odd, documents, spark):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert toxicity.score(documents(EMPTY), toxicity.train(odd, labels.limit(0))).count() == 0


def test_kernel_is_the_dot_product_of_its_subsequences():
    a, b = [b"idiot", b"id.iot", b"river", b"a", b""], [b"idiot", b"riverbank"]
    k = toxicity.Landmarks(b).kernel(a)
    assert k[0, 0] == pytest.approx(1) and 0.2 < k[1, 0] < 1 and k[2, 1] > 0.3 > k[2, 0] and (k[4] == 0).all()
