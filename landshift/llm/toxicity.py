"""Toxicity: a support vector machine over a gapped subsequence string kernel.

Two words are alike by the subsequences of four characters that they share, where each step
may skip one character, which costs a factor DECAY, so
inserted characters lower the likeness and do not end it.  Landmarks are words; the Nyström
map of a word is K(word, landmarks) K(landmarks, landmarks)^-1/2, and a linear machine with
squared hinge loss is fitted there.  As the kernel is a dot product of subsequence weights,
the fitted machine is one weight for each subsequence, which scores any word.

Marks inside a word are skipped free of charge, so are the spaces of a word whose letters
stand alone ("i d i o t").  A document is scored by its most toxic word, or by what SEVERAL
of its words reach, whichever says more, against its length.
Labels are of documents, so the words to learn from come from labelled sentences: those that
stand in several different contexts in toxic documents only (the word itself, or the words
that begin with the same four letters), against words of clean ones; the clean words that a
fitted machine takes for toxic join the next fit.

The labelled sample is bounded (SAMPLE documents, WORDS words); scores cover whole texts of
all documents.

Defined cases: a null or empty text has the score of no evidence; words of over UNIT bytes are
seen through windows, so a text of any length is scored whole; equal decisions count each; without labels of both
classes every score is the smoothed share of label 1; repeated rows are scored each.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.llm.common import map_texts, stored, texts
from landshift.llm.quality_model import labelled_sample

#: Labelled documents to learn from, at most.
SAMPLE = 20_000
#: Words of each class to fit on, at most.
WORDS = 4_000
LANDMARKS = 900
DECAY = 0.8
#: Distances between the four characters of a subsequence.
STEPS = [(a, b, c) for a in (1, 2) for b in (1, 2) for c in (1, 2)]
CODES = 1 << 20
#: Words that together can make a document toxic where none does alone.
SEVERAL = 2
#: Words whose decision a worker keeps.
CACHE = 600_000
SENTENCE = re.compile(rb"[.!?\n]+(?:\s|$)")

#: Marks, which a kernel skips free of charge wherever they stand.
MARKS = bytes(b for b in range(128) if not chr(b).isalnum())
#: Three letters or more that stand alone, as in a word spaced out.
SPACED = re.compile(rb"(?<!\S)(?:[a-z][^\sa-z0-9]*\s+){2,}[a-z](?![^\s.,;:!?])")
#: Bytes of a unit; longer ones are seen through windows of that length, half a window apart.
UNIT = 48

#: Classes of bytes: letters without case 1-26, start of a word 27, its end 0, digits 28, other ASCII 29; bytes of other letters share 1-26.
CLASS = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 28 if 48 <= b <= 57 else 1 + b % 26 if b >= 128 else 29 for b in range(256)], np.int64)


def units(text: bytes) -> list[bytes]:
    """The words of a text without case, and its words that are spaced out, as one each."""
    low = text.lower()
    found = low.split()
    for run in SPACED.findall(low):
        joined = run.translate(None, MARKS)
        found += [joined[k : k + UNIT // 2] for k in range(0, max(1, len(joined) - UNIT // 4), UNIT // 4)]
    return found


def windows(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(place of the word, what the kernel sees of it): without marks, long ones in windows."""
    place, seen = [], []
    for k, w in enumerate(words):
        w = w.translate(None, MARKS)
        for at in range(0, max(1, len(w) - UNIT // 2), UNIT // 2):
            place.append(k)
            seen.append(w[at : at + UNIT])
    return np.array(place, np.int64), seen


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight), each pair once, ordered; a word's weights have a norm of 1."""
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    letters = CLASS[np.frombuffer(b"".join(b"\0%b\0" % w for w in words) + bytes(8), np.uint8)]
    letters[ends - sizes] = 27
    letters[ends - 1] = 0
    owner = np.repeat(np.arange(len(words)), sizes)
    stop = ends[owner]
    at = np.arange(ends[-1])
    codes, weights = [], []
    for a, b, c in STEPS:
        inside = at[at + a + b + c < stop]
        codes.append(owner[inside] << 20 | letters[inside] << 15 | letters[inside + a] << 10 | letters[inside + a + b] << 5 | letters[inside + a + b + c])
        weights.append(np.full(len(inside), DECAY ** (a + b + c - 3)))
    code, weight = np.concatenate(codes), np.concatenate(weights)
    order = np.argsort(code, kind="stable")
    code, weight = code[order], weight[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    weight = np.add.reduceat(weight, first)
    word, sub = code[first] >> 20, code[first] & (CODES - 1)
    norm = np.sqrt(np.bincount(word, weight**2, minlength=len(words)))
    return word, sub, weight / norm[word]


class Landmarks:
    """Weights of the landmarks' subsequences: a row for each that any landmark has, and a last one of zeros."""

    def __init__(self, words: list[bytes]):
        word, sub, weight = subsequences(words)
        self.words, self.subs = words, np.unique(sub)
        self.row = np.full(CODES, len(self.subs), np.int32)
        self.row[self.subs] = np.arange(len(self.subs))
        self.table = np.zeros((len(self.subs) + 1, len(words)), np.float32)
        self.table[self.row[sub], word] = weight

    def kernel(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)))
        for at in range(0, len(words), 200):
            word, sub, weight = subsequences(words[at : at + 200])
            shared = self.row[sub] < len(self.subs)
            word, sub, weight = word[shared], sub[shared], weight[shared]
            if len(word):
                first = np.flatnonzero(np.diff(word, prepend=-1))
                out[at + word[first]] = np.add.reduceat(weight[:, None] * self.table[self.row[sub]], first, axis=0)
        return out

    def weights(self, alpha: np.ndarray) -> np.ndarray:
        """One weight for each subsequence, of a sum of landmarks."""
        out = np.zeros(CODES, np.float32)
        out[self.subs] = self.table[:-1] @ alpha
        return out


@dataclass(frozen=True)
class ToxicModel:
    """decision = weights . word + bias; score = sigmoid(a x + b log(1 + words) + c), x the worst word's decision or what SEVERAL words reach, whichever says more.

    The more words a document has, the larger is its largest decision by chance, so its length counts against it.
    """

    weights: np.ndarray = field(default_factory=lambda: np.zeros(CODES, np.float32))
    bias: float = 0.0
    fits: tuple[tuple[float, float, float], ...] = ((0.0, 0.0, 0.0), (0.0, 0.0, 0.0))

    def decisions(self, words: list[bytes]) -> np.ndarray:
        place, seen = windows(words)
        each = np.full(len(seen), self.bias)
        for at in range(0, len(seen), 4000):
            word, sub, weight = subsequences(seen[at : at + 4000])
            each[at : at + 4000] += np.bincount(word, weight * self.weights[sub], minlength=len(each[at : at + 4000]))
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, place, each)
        return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps; y is -1 or 1."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        a = x[on] * weight[on, None]
        step = np.linalg.solve(a.T @ x[on] + np.diag(keep) * weight.sum() / 100, a.T @ (y[on] * slack[on]) - keep * w * weight.sum() / 100)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def perturbed(words: list[bytes], seed: int = 11) -> list[bytes]:
    """Each word with a character put in at one place, and with it between all characters."""
    rng, out = np.random.default_rng(seed), []
    for w in words:
        if len(w) > 3:
            a, c = rng.integers(1, len(w)), bytes([rng.choice(list(b"xjqzhe"))])
            out += [w[:a] + c + w[a:], c.join(bytes([x]) for x in w)]
    return out


def sentence_words(sample: DataFrame) -> DataFrame:
    """word, n_toxic, n_clean: after how many different words of its sentences it stands in toxic documents only, and in clean ones.

    Copies of a document repeat a word after the same word, so they don't count again.
    """

    def make():
        def run(batch, values):
            labels, words, before = [], [], []
            for text, label in zip(values, batch.column("label").to_pylist(), strict=True):
                pairs = set()
                for s in SENTENCE.split((text or b"").lower()):
                    found = [w for x in s.split() if (w := x.translate(None, MARKS))]
                    pairs.update(zip(found, [b"", *found], strict=False))
                labels += [label] * len(pairs)
                words += [w.decode() for w, _ in pairs]
                before += [xxhash.xxh64_intdigest(v) - 2**63 for _, v in pairs]
            return {"label": labels, "word": words, "before": before}

        return run

    pairs = map_texts(sample.select("doc_id", "text", "label"), make, "label double, word string, before long")
    one = pairs.groupBy("word", "before").agg(F.min("label").alias("toxic"))
    return one.groupBy("word").agg(F.sum("toxic").cast("long").alias("n_toxic"), F.sum(1 - F.col("toxic")).cast("long").alias("n_clean"))


def chosen_words(counted: DataFrame, support: int, evidence: float, clean_share: float) -> tuple[list[bytes], list[bytes]]:
    """At most WORDS of each class.  A word is toxic by its own counts or by those of the words that begin alike."""

    def telling(toxic, clean):
        ratio = F.log((toxic + 0.01) / ((clean + 0.5) * F.lit(clean_share)))
        return (toxic >= support) & (toxic * ratio >= evidence) & (clean <= 0.05 * toxic)

    stem = F.when(F.length("word") >= 5, F.substring("word", 1, 4))
    stems = counted.where(stem.isNotNull()).groupBy(stem.alias("stem")).agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c"))
    toxic = counted.withColumn("stem", stem).join(stems.where(telling(F.col("t"), F.col("c"))), "stem", "left")
    toxic = toxic.where((F.col("n_toxic") > 0) & (telling(F.col("n_toxic"), F.col("n_clean")) | F.col("t").isNotNull()) & (F.col("n_clean") <= 0.05 * F.col("n_toxic")))
    clean = counted.where((F.col("n_clean") > 0) & (F.col("n_toxic") <= F.greatest(F.lit(1.0), F.lit(4 * clean_share) * F.col("n_clean"))))
    a = toxic.orderBy(F.desc("n_toxic"), "word").limit(WORDS).collect()
    b = clean.orderBy(F.desc("n_clean"), "word").limit(WORDS // 2).collect() + clean.orderBy(F.xxhash64("word")).limit(WORDS // 2).collect()
    return [r["word"].encode() for r in a], sorted({r["word"].encode() for r in b})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE, support: int = 3, evidence: float = 12.0) -> ToxicModel:
    sample = labelled_sample(docs, labels, label, rows)
    counted = stored(sentence_words(sample))
    totals = counted.agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c")).first()
    share = (totals["t"] or 0) / max(1, totals["c"] or 0)
    toxic, clean = chosen_words(counted, support, evidence, share) if share else ([], [])
    classes = sample.groupBy().agg(F.count("*").alias("n"), F.sum("label").alias("t")).first()
    prior = ((classes["t"] or 0) + 1) / (classes["n"] + 2)
    if not toxic or not clean:
        return ToxicModel(fits=((0.0, 0.0, math.log(prior / (1 - prior))),) * 2)
    model = machine(toxic, clean, [])
    for _ in range(3):  # what the machine still takes for toxic among the clean words
        clean = list(dict.fromkeys([*hardest(counted, model), *clean]))[: 3 * WORDS]
        model = machine(toxic, clean, clean[:WORDS])
    seen = decide(sample.select("doc_id", "text"), model).join(sample.select("doc_id", "label"), "doc_id").select("decision", "several", "n_words", "label").toPandas()
    return ToxicModel(model.weights, model.bias, tuple(platt(seen[c].to_numpy(), seen["n_words"].to_numpy(), seen["label"].to_numpy()) for c in ("decision", "several")))


def machine(toxic: list[bytes], clean: list[bytes], hard: list[bytes]) -> ToxicModel:
    """The fitted machine; the hard ones among the clean words are landmarks too."""
    toxic, clean, hard = ([*dict.fromkeys(v for w in ws for v in windows([w])[1])] for ws in (toxic, clean, hard))
    bad = toxic + perturbed(toxic)
    landmarks = list(dict.fromkeys([*toxic[: LANDMARKS // 2], *hard[: LANDMARKS // 3], *clean[:: max(1, 5 * len(clean) // LANDMARKS)]]))[:LANDMARKS]
    marks = Landmarks(landmarks)
    values, vectors = np.linalg.eigh(marks.kernel(landmarks))
    good = values > 1e-4 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.vstack([marks.kernel(bad), marks.kernel(clean)]) @ root
    y = np.r_[np.ones(len(bad)), -np.ones(len(clean))]
    weight = np.where(y > 0, 0.5 / len(bad), 0.5 / len(clean)) * len(y)
    w, b = svm(x, y, weight)
    return ToxicModel(weights=marks.weights(root @ w), bias=b)


def hardest(counted: DataFrame, model: ToxicModel) -> list[bytes]:
    """The WORDS // 2 clean words with the largest decisions."""
    words = counted.where((F.col("n_clean") > 0) & (F.col("n_toxic") <= 0.3 * F.col("n_clean"))).select(F.lit(0).cast("long").alias("doc_id"), F.col("word").alias("text"))

    def make():
        def run(batch, values):
            return {"word": [v.decode() for v in values], "decision": model.decisions(values)}

        return run

    return [r["word"].encode() for r in map_texts(words, make, "word string, decision double").orderBy(F.desc("decision"), "word").limit(WORDS // 2).collect()]


def platt(d: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic fit of the labels on the decisions and the logarithm of the length, by Newton steps with a little ridge."""
    x, w, ridge = np.column_stack([np.clip(d, -5, 5), np.log1p(n), np.ones(len(d))]), np.zeros(3), np.array([1e-1, 1e-1, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def decide(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, ``decision`` (of the most toxic word, -5 if there is none), that ``word``, ``n_words`` seen, and ``several``, which SEVERAL words reach (-5 with fewer words)."""
    floor = -5.0

    def make():
        known: dict[bytes, float] = {}

        def run(batch, values):
            each = [units(x) if x else [] for x in values]
            if len(known) > CACHE:
                known.clear()
            new = list({w for ws in each for w in ws}.difference(known))
            known.update(zip(new, model.decisions(new).tolist(), strict=True))
            worst = [heapq.nlargest(SEVERAL, ws, key=known.__getitem__) for ws in each]
            values = [[max(floor, known[w]) for w in ws] for ws in worst]
            return {
                "doc_id": batch.column("doc_id"),
                "decision": [v[0] if v else floor for v in values],
                "several": [v[-1] if len(v) == SEVERAL else floor for v in values],
                "n_words": [len(ws) for ws in each],
                "word": [ws[0].decode(errors="replace") if ws else None for ws in worst],
            }

        return run

    return map_texts(texts(docs), make, "doc_id long, decision double, several double, n_words long, word string")


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, decision, several, n_words, word and ``score``."""
    fits = zip(("decision", "several"), model.fits, strict=True)
    margin = F.greatest(*(F.least(F.col(c), F.lit(5.0)) * slope + F.log1p("n_words") * length + offset for c, (slope, length, offset) in fits))
    return decide(docs, model).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), margin))))
