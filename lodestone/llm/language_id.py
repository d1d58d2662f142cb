"""Language identification by cross-parsing: suffix automata of labelled text, greedy longest matches, phrase counts.

For each language a suffix automaton holds a bounded sample of training text, over all letters that any sample has; its
moves are stored sparsely. A document is cut into pieces of 256
letters and spaces, and each piece is parsed into the fewest longest matches (phrases) of that automaton; all pieces
of a batch advance together, one table lookup per character. A language's count is divided by the phrases per
character that its own training text takes; the smallest ratio wins.

Edge cases: a null text or one without a letter is `und` with score 0; other texts always get a learned language
(the first by name on ties); without training rows every text is `und`; columns besides doc_id, text and lang are
ignored, and lang is read for training only.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import fold, map_texts, with_texts

PIECE = 256
#: Places that a state tries before it goes behind all others.
TRIES = 64
FLAG, MASK = np.int32(1 << 28), np.int32((1 << 28) - 1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Automaton:
    """Sparse moves: those of state s stand in shared rows at base[s] + code, where owner says whose they are.

    A missing move leads to root[code], with FLAG: a new phrase. The last state stands outside any phrase: at the start,
    and after a symbol that the sample lacks, which is a phrase of its own.
    """

    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    root: np.ndarray

    def phrases(self, pieces: np.ndarray) -> np.ndarray:
        """Phrases of each column of pieces [places, columns]; the last code is filling."""
        state = np.full(pieces.shape[1], len(self.base) - 1, np.int32)
        count = np.zeros(pieces.shape[1], np.int32)
        for row in pieces:
            at = self.base[state] + row
            v = np.where(self.owner[at] == state, self.target[at], self.root[row])
            count += v >= FLAG
            state = v & MASK
        return count


def packed(moves: list[dict[int, int]], alphabet: int) -> Automaton:
    """Lays the states' moves into one row without overlap, states of many moves first."""
    n = len(moves)
    owner, target = [-1] * (alphabet + 1), [0] * (alphabet + 1)
    r = random.Random(n)
    base, first = [0] * (n + 1), alphabet  # no move stands below `first`, so that every place can serve every code
    for s in sorted(range(n), key=lambda s: -len(moves[s])):
        codes = sorted(moves[s])
        if not codes:
            break
        while first < len(owner) and owner[first] >= 0:
            first += 1
        b = first - codes[0]
        for k in range(TRIES):
            if all(b + c >= len(owner) or owner[b + c] < 0 for c in codes):
                break
            b = b + 1 if k < TRIES // 2 else r.randrange(max(first - codes[0], 0), len(owner))
        else:
            b = len(owner) - codes[0]  # behind all others
        if b + codes[-1] >= len(owner):
            more = b + codes[-1] + 1 - len(owner)
            owner += [-1] * more
            target += [0] * more
        for c in codes:
            owner[b + c], target[b + c] = s, moves[s][c]
        base[s] = b
    owner += [-1] * (alphabet + 1)
    target += [0] * (alphabet + 1)
    root = np.full(alphabet + 1, n, np.int32)
    for c, s in moves[0].items():
        root[c] = s
    root[:alphabet] |= FLAG
    return Automaton(np.array(base, np.int32), np.array(owner, np.int32), np.array(target, np.int32), root)


def suffix_automaton(symbols: list[int], alphabet: int) -> Automaton:
    """The automaton of all substrings of the texts in symbols; separators (-1) end one text, and the next one starts anew."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        if c < 0:
            last = 0
            continue
        if c in nxt[last]:  # only after a separator: the generalised automaton already has this string
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                last = q
                continue
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[last] + 1)
            link[q] = clone
            p = last
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            last = clone
            continue
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[cur] = clone
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        last = cur
    return packed(nxt, alphabet)


class Parser:
    """The automata of all languages, and the code of each character: the letters of all samples, one for other letters, and the space for all else."""

    def __init__(self, letters: str):
        self.letters, self.alphabet = letters, len(letters) + 2
        self.langs: list[str] = []
        self.tables: list[Automaton] = []
        self.rates: list[float] = []

    def codes(self, text: str) -> tuple[np.ndarray, bool]:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = _letters()[points]
        code = np.where(is_letter, self._lut()[points], 0)
        keep = (code > 0) | (np.diff(code, prepend=1) != 0)  # one space for a run of others
        return code[keep], bool(is_letter.any())

    def _lut(self) -> np.ndarray:
        if getattr(self, "_table", None) is None:
            self._table = np.full(0x110000, self.alphabet - 1, np.int32)
            for k, c in enumerate(self.letters):
                self._table[ord(c)] = k + 1
        return self._table

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def pieces(self, coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces as columns, filled up, and the text each belongs to."""
        n = [max(1, -(-len(c) // PIECE)) for c in coded]
        out = np.full((sum(n), PIECE), self.alphabet, np.int32)
        flat, at = out.reshape(-1), 0
        for c, k in zip(coded, n, strict=True):
            flat[at : at + len(c)] = c
            at += k * PIECE
        return np.ascontiguousarray(out.T), np.repeat(np.arange(len(coded)), n)

    def rate(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases for each text and language, divided by what the language's own text takes at that length."""
        pieces, owner = self.pieces(coded)
        size = np.maximum([len(c) for c in coded], 1)
        return np.stack([np.bincount(owner, t.phrases(pieces), len(coded)) / size / r for t, r in zip(self.tables, self.rates, strict=True)], 1)


def _joined(texts: list[np.ndarray]) -> list[int]:
    return [x for t in texts for x in (*t.tolist(), -1)]


def train_languages(df: DataFrame, texts_per_language: int = 100, chars_per_language: int = 24000) -> Parser:
    """Fits the automata on at most texts_per_language texts (by a hash of the id) of each language, and on at most chars_per_language characters of these.

    All languages and all letters of the samples take part. An automaton has at most 2 * chars_per_language states (about
    a megabyte), so the model grows with the number of languages, not with the corpus.

    Pieces of the sample that another language's half sample parses better (as in texts of two languages) are left out.
    """
    rows = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("k", F.row_number().over(w)).where(F.col("k") <= texts_per_language).select("doc_id")
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(ids.distinct()), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")  # texts_per_language for each language
    by: dict[str, list[str]] = {}
    for r in sample.toLocalIterator():
        held = by.setdefault(r["lang"], [])
        if sum(map(len, held)) < 4 * chars_per_language:
            held.append(r["text"][: 4 * chars_per_language])  # more of one text can't be among the characters taken
    letters: dict[str, int] = {}
    for texts in by.values():
        for t in texts:
            for c in t.lower():
                if c.isalpha():
                    letters[c] = letters.get(c, 0) + 1
    parser = Parser("".join(sorted(letters)))
    pieces: dict[str, list[np.ndarray]] = {}
    for lang in sorted(by):
        # Short pieces of many texts rather than a few long texts.
        cut = [[c[k : k + PIECE] for k in range(0, len(c), PIECE)] for c in (parser.codes(t)[0] for t in by[lang])]
        pieces[lang] = [c[k] for k in range(max(map(len, cut), default=0)) for c in cut if k < len(c)]
    kept = pieces
    for _ in range(2):
        kept = _cleaned(parser, pieces, kept, chars_per_language)
    _fit(parser, kept, chars_per_language)
    return parser


def _fit(parser: Parser, pieces: dict[str, list[np.ndarray]], chars: int, part: int = 0, of: int = 1) -> None:
    parser.langs, parser.tables, parser.rates = [], [], []
    for lang, all_ in pieces.items():
        own, n = [], 0
        for k, p in enumerate(all_):
            if k % of == part and n < chars // of:
                own.append(p)
                n += len(p)
        rest = [p for k, p in enumerate(all_) if (k % of != part if of > 1 else k >= len(own))][:400] or own
        parser.langs.append(lang)
        parser.tables.append(suffix_automaton(_joined(own), parser.alphabet))
        parser.rates.append(1.0)
        got, owner = parser.pieces(rest or [np.zeros(1, np.int32)])
        parser.rates[-1] = float(np.median(parser.tables[-1].phrases(got) / np.maximum([len(p) for p in rest] or [1], 1)))


def _cleaned(parser: Parser, pieces: dict, kept: dict, chars: int) -> dict[str, list[np.ndarray]]:
    out: dict[str, dict[int, np.ndarray]] = {lang: {} for lang in pieces}
    for part in (0, 1):
        _fit(parser, kept, chars, part, 2)
        for j, lang in enumerate(parser.langs):
            other = [(k, p) for k, p in enumerate(pieces[lang]) if k % 2 != part]
            if other:
                best = parser.rate([p for _, p in other]).argmin(1)
                out[lang] |= {k: p for (k, p), b in zip(other, best, strict=True) if b == j}
    return {lang: [got[k] for k in sorted(got)] or pieces[lang] for lang, got in out.items()}


def language_id(df: DataFrame, parser: Parser) -> DataFrame:
    """One row per document: held_out, lang_pred, score (how far the second language's ratio lies above the first's, 0 to 1), and the ratio."""

    out = map_texts(df, lambda ids, texts: {"doc_id": ids, **_decided(parser, texts)}, "doc_id long, lang_pred string, score double, ratio double")
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", F.col("ratio").alias("phrase_ratio"))


def with_language(df: DataFrame, parser: Parser, name: str) -> DataFrame:
    """df's columns and the language of each row's text."""
    return with_texts(df, name, StringType(), lambda texts: _decided(parser, texts)["lang_pred"])


def _decided(parser: Parser, texts: list[bytes]) -> dict:
    coded, lettered = zip(*(parser.codes(t.decode("utf-8", "replace")) for t in texts), strict=True)
    if not parser.langs:
        return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "ratio": [None] * len(texts)}
    rate = parser.rate(list(coded))
    best = rate.argmin(1)
    ordered = np.sort(rate, 1)
    margin = np.ones(len(texts)) if rate.shape[1] < 2 else 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1e-9)
    score = np.clip(0.5 + margin, 0, 1)
    return {
        "lang_pred": [parser.langs[b] if y else "und" for b, y in zip(best.tolist(), lettered, strict=True)],
        "score": [float(s) if y else 0.0 for s, y in zip(score, lettered, strict=True)],
        "ratio": [float(r) if y else None for r, y in zip(ordered[:, 0], lettered, strict=True)],
    }
