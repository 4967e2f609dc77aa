"""License scan: identifier tags and notice phrases in whole texts, and the value of licence expressions.

An Aho-Corasick automaton runs over the words of a text (A-Z folded; a word is a run of ASCII letters, digits and
characters beyond ASCII), so a phrase is found wherever its words stand next to each other. Where the identifier tag
occurs, the expression behind it in the original text goes through a shunting-yard parser: ``with`` binds tighter than
``and``, ``and`` tighter than ``or``.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.llm.common import by_rows
from pageloom.llm.words import bytes_of

#: Phrases that are counted and whose places are reported.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: More notices, for labels alone.
NOTICE_PHRASES = {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: How freely a text under the licence may be used: 1 without conditions worth naming, 0 not at all.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "apache": 1.0, "cc-by": 0.9, "mpl": 0.7,
    "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "reserved": 0.0,
}
UNKNOWN = 0.5

_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_TAGGED = re.compile(rb"(?i)spdx[^0-9A-Za-z\x80-\xff]+license[^0-9A-Za-z\x80-\xff]+identifier[ \t]*:?[ \t]*([^\r\n]*)")
_SYMBOL = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {**BASE_PHRASES, **NOTICE_PHRASES, TAG: ""}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def family(identifier: str) -> str | None:
    """The longest known label that the identifier begins with."""
    name = identifier.lower()
    fits = [k for k in FREEDOM if name == k or re.match(re.escape(k) + r"[-.+0-9]", name)]
    return max(fits, key=len, default=None)


def postfix(text: str) -> list[str] | None:
    """An expression's symbols in postfix order (operators as ``or``, ``and``, ``with``); None if it is not well formed.

    Reading stops at the first symbol that cannot continue the expression, as when a comment goes on behind it.
    """
    strength = {"or": 1, "and": 2, "with": 3}
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether an operand has just ended
    for symbol in _SYMBOL.findall(text):
        word = symbol.lower()
        if word in strength:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and strength[waiting[-1]] >= strength[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = False
        elif symbol == ")":
            if not operand or "(" not in waiting:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif operand:
            break
        elif symbol == "(":
            waiting.append("(")
        else:
            out.append(symbol)
            operand = True
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(symbols: list[str]) -> tuple[float, list[str]]:
    """Freedom of a postfix expression and the labels in it: ``and`` is the stricter side, ``or`` the freer one, and an
    exception (``with``) lifts half of what its licence withholds."""
    stack: list[tuple[float, list[str]]] = []
    for s in symbols:
        if s in ("and", "or", "with"):
            (right, more), (left, labels) = stack.pop(), stack.pop()
            if s == "with":
                stack.append((left + (1 - left) / 2, labels))
            else:
                stack.append(((min if s == "and" else max)(left, right), labels + more))
        else:
            known = family(s)
            stack.append((FREEDOM.get(known, UNKNOWN), [known or f"spdx:{s.lower()}"]))
    return stack[0]


def scan_text(raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = raw.translate(_BYTES).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    first = last = None
    n_base, at, count = 0, 0, 0
    base: set[str] = set()
    labels: set[str] = set()
    scores: list[float] = []
    tagged = False
    for end, phrase in automaton().iter(line):
        if phrase == TAG:
            tagged = True
            continue
        label = BASE_PHRASES.get(phrase)
        if label is None:
            label = NOTICE_PHRASES[phrase]
        else:
            begin = end - len(phrase) - 1
            if begin >= at:
                count += line.count(" ", at, begin)
                at = begin
                word = count
            else:
                word = line.count(" ", 0, begin)
            n_base += 1
            first = word if first is None else min(first, word)
            last = word if last is None else max(last, word)
            base.add(label)
        labels.add(label)
        scores.append(FREEDOM[label])
    if tagged:
        for m in _TAGGED.finditer(raw):
            symbols = postfix(m[1].decode("latin-1"))
            if symbols:
                value, names = evaluate(symbols)
                scores.append(value)
                labels.update(names)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0)


_SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double"
)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the least freedom among all evidence (notices, and the value of each tagged expression), 0 without any.
    A null or empty text has no words, null places, empty labels and score 0; repeated rows give repeated results, a null
    key stays null, other columns are ignored. A tag without a well-formed expression counts for nothing.
    """

    def run(batch: pa.RecordBatch) -> dict:
        buffer, offsets = bytes_of(batch.column("text"))
        raw = memoryview(np.ascontiguousarray(buffer))
        rows = [scan_text(bytes(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        n_words, n_base, first, last, base, labels, score = zip(*rows, strict=True) if rows else [()] * 7
        return {
            "doc_id": batch.column("key"), "n_words": pa.array(n_words, pa.int64()), "n_base": pa.array(n_base, pa.int64()),
            "first_word": pa.array(first, pa.int64()), "last_word": pa.array(last, pa.int64()),
            "base_labels": pa.array(base, pa.string()), "labels": pa.array(labels, pa.string()), "score": pa.array(score, pa.float64()),
        }

    return by_rows(docs.selectExpr(f"cast(`{key}` as bigint) as key", f"`{text}` as text"), run, _SCHEMA)
