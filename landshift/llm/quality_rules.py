"""Line-first cleaning.

Every line is judged on its own by punctuation, navigation and boilerplate rules; lines
that fail are removed, and a document that loses too much of its text is rejected.

Defined cases: a null text has no words and fails the base test; a line without a word is
neither kept nor lost; a text or line of any length is judged whole; a line or text that just
reaches a rule's share fails it, a document that loses just ``max_loss`` stays; repeated rows are
judged alike, each for itself; an empty table gives an empty one; other columns of the table,
whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from landshift.llm.common import map_texts, texts

#: The characters that the base counts as symbols.
SYMBOLS = b"#*$%&|<>"
#: What separates the entries of menus.
SEPARATORS = {b"|", b"\xc2\xbb", b"\xe2\x80\xba", b"\xe2\x80\xa2", b"\xc2\xb7", b">", b"<", b"/", b"*", b"-"}
#: Phrases of page furniture, in lower case.
BOILERPLATE = re.compile(
    rb"all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|click here|read more|sign (?:in|up)\b"
    rb"|log ?in\b|subscribe|newsletter|javascript|lorem ipsum|powered by|skip to (?:main )?content|share (?:this|on)\b|back to top"
)
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SPACE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineRules:
    #: Symbols or exclamation marks for each word at which a line fails.
    marks_per_word: float = 0.3
    #: Share of ASCII punctuation among a line's bytes at which it fails.
    punctuation_share: float = 0.3
    #: Share of menu separators among a line's words at which it fails (from three on).
    separator_share: float = 0.15
    #: Words up to which a line with a boilerplate phrase is page furniture.
    boilerplate_words: int = 20
    #: Share of one word among a line's words at which it fails (from min_repeat words on).
    repeat_share: float = 0.4
    min_repeat: int = 8
    #: Share of its text that a document may lose.
    max_loss: float = 0.5

    def failed(self, line: bytes, words: list[bytes]) -> str | None:
        n = len(words)
        marks = sum(map(line.count, b"#*$%&|<>~^_{}!"))
        if n >= 3:
            seps = sum(map(SEPARATORS.__contains__, words))
            if seps >= 3 and seps >= self.separator_share * n:
                return "navigation"
            if marks >= self.marks_per_word * n:
                return "punctuation"
        if n >= 3 and len(line) - len(line.translate(None, PUNCTUATION)) >= self.punctuation_share * (len(line) - n + 1):
            return "punctuation"
        if n >= self.min_repeat and n - len(set(words)) >= self.repeat_share * n and max(map(words.count, set(words))) >= self.repeat_share * n:
            return "boilerplate"
        if n <= self.boilerplate_words and BOILERPLATE.search(line.lower()):
            return "boilerplate"
        return None


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in windows of ``size`` words found twice or more in the text."""
    n = len(words)
    if n <= size:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    m = n - size + 1
    if len(seen) == n:
        return 0
    key = ids[:m]
    span = len(seen)
    for k in range(1, size):
        if span > 2**62 // len(seen):  # name the windows so far anew, so that the key fits
            named, key = np.unique(key, return_inverse=True)
            span = len(named)
        key, span = key * len(seen) + ids[k : k + m], span * len(seen)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(size):
        cover[k : k + m] |= twice
    return int(cover.sum())


def line_cleaning(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """doc_id, the base counts, ``base_failed``, ``lost_share``, ``lines_failed``, ``kept`` and the ``cleaned`` text."""

    def make():
        def one(text: bytes) -> tuple:
            words = text.split()
            n = len(words)
            lines = text.split(b"\n")
            full = [x for x in lines if x.strip(SPACE)]
            n_symbols = sum(map(text.count, SYMBOLS))
            spaces = sum(map(text.count, SPACE))
            chars = len(text.decode("utf-8")) - spaces
            again = repeated_words(words)
            base_failed = n < 50 or 100 * again > 50 * n
            lost, failed, kept = 0, 0, []
            for line in full:
                if rules.failed(line, line.split()):
                    lost += len(line)
                    failed += 1
                else:
                    kept.append(line)
            share = lost / max(1, sum(map(len, full)))
            return (n, chars, n_symbols, len(full) - len(set(full)), again, base_failed, failed, share, not base_failed and share <= rules.max_loss, b"\n".join(kept).decode())

        def run(batch, values):
            rows = [one(x or b"") for x in values]
            cols = list(zip(*rows, strict=True))
            return dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines_failed", "lost_share", "kept", "cleaned"), cols, strict=True)) | {"doc_id": batch.column("doc_id")}

        return run

    return map_texts(
        texts(docs),
        make,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines_failed long, lost_share double, kept boolean, cleaned string",
    )
