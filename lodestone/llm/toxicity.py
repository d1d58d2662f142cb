"""Toxicity: a weighted finite-state grammar over clauses.

Four transducers read a clause's words and are composed into one machine:

* lexicon: a trie over characters; a word becomes an insult or threat with a weight, a target, a negation, a verb of
  saying, a quote, or a plain symbol. Stems (words' beginnings of 4 to 7 letters) end in a state that any letter keeps;
* negation: within three words after a negation an insult or threat is marked as negated;
* reported speech: after a verb of saying or inside quotes it is marked as reported;
* target: an insult or threat whose clause names a target, before or after it, is marked as aimed.

Each final output symbol (insult or threat, with its marks) has a weight. A clause's score is the sum of its words'
weights times those of their symbols; a text's logit adds, for each symbol, its weight times the logarithm of 1 + the
words' weights under that symbol in all clauses. The symbols' weights and the bias are fitted together, on the same
bounded sample of labelled rows that the insult stems are learned from, around prior weights that hold where a
symbol has no examples.

Edge cases: a null text is an empty one and gets the score of a text without evidence; rows repeat as they come;
without labelled rows the lexicon holds the fixed words, and the symbols their prior weights; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import exp, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_texts

# Word classes in English, German, French and Spanish.
THREATS = frozenset("kill hurt destroy smash stab shoot beat murder burn töten vernichten schlagen tuer tuerai frapper brûler matar matarte golpear quemar".split())
TARGETS = frozenset("you your yours yourself u he she they them him her dich dir du euch ihr tu te toi vous votre ton usted ustedes te ti tú".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca tampoco ningún".split())
SPEECH = frozenset("said says say called calls wrote quoted claimed reportedly sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó".split())

CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]")
QUOTES = frozenset("\"“”«»„")

Table = dict[tuple[int, str], tuple[int, str]]
SYMBOLS = ("I", "H", "T", "N", "R", "Q", "o")  # insult, harm (threat), target, negation, report, quote, other


def _negation() -> Table:
    t: Table = {}
    for s in range(4):
        for x in SYMBOLS:
            t[s, x] = (3, x) if x == "N" else (max(0, s - 1), x + "-" if s and x in "IH" else x)
    return t


def _marked(symbols: set[str]) -> set[str]:
    return {x for x in symbols if x[0] in "IH"}


def _report(symbols: set[str]) -> Table:
    """State 1 after a verb of saying, 2 inside quotes (3 both)."""
    t: Table = {}
    for s in range(4):
        for x in symbols:
            t[s, x] = (s | 1, x) if x == "R" else (s ^ 2, x) if x == "Q" else (s, x + '"' if s and x in _marked(symbols) else x)
    return t


def _target(symbols: set[str]) -> Table:
    """A target marks what follows it; what came before it is aimed by the symbol T itself, as that leaves state 1 with T!."""
    t: Table = {}
    for s in range(3):  # 0: neither; 1: an insult or threat came; 2: a target came
        for x in symbols:
            if x == "T":
                t[s, x] = (2, "T!" if s == 1 else x)
            elif x in _marked(symbols):
                t[s, x] = (2 if s == 2 else 1, x + "!" if s == 2 else x)
            else:
                t[s, x] = (s, x)
    return t


def outputs(t: Table) -> set[str]:
    return {out for _, out in t.values()}


def compose(a: Table, b: Table) -> Table:
    """The machine that feeds a's output to b; states are renumbered from 0 (the start)."""
    number, todo, out = {(0, 0): 0}, [(0, 0)], {}
    inputs = {x for _, x in a}
    while todo:
        p, q = here = todo.pop()
        for x in inputs:
            p2, mid = a[p, x]
            q2, sym = b[q, mid]
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            out[number[here], x] = (number[p2, q2], sym)
    return out


def grammar() -> Table:
    n = _negation()
    r = compose(n, _report(outputs(n)))
    return compose(r, _target(outputs(r)))


class Lexicon:
    """A transducer from a word's characters to its symbol and weight, as a trie; a stem's last state takes any further letters."""

    def __init__(self, stems: dict[str, float]):
        self.root: dict = {}
        # Later entries win: the grammar's own words before learned ones.
        for word, weight in sorted(stems.items()):
            self._add(word, "I", weight)
        for words, symbol in ((SPEECH, "R"), (NEGATIONS, "N"), (TARGETS, "T"), (QUOTES, "Q"), (THREATS, "H")):
            for word in words:
                self._add(word, symbol, 1.0)
        self.cache: dict[str, tuple[str, float]] = {}

    def _add(self, word: str, symbol: str, weight: float) -> None:
        node = self.root
        for c in word.rstrip("*"):
            node = node.setdefault(c, {})
        node["*" if word.endswith("*") else ""] = (symbol, weight)

    def __call__(self, word: str) -> tuple[str, float]:
        """The output of the whole word, or of the longest stem that it begins with."""
        out = self.cache.get(word)
        if out is None:
            node, out = self.root, ("o", 0.0)
            for c in word:
                node = node.get(c)
                if node is None:
                    break
                out = node.get("*", out)
            else:
                out = node.get("", out)
            if len(self.cache) > 1 << 18:
                self.cache.clear()
            self.cache[word] = out
        return out


#: Output symbols of insults (I) and threats (H) with their marks: negated, reported, aimed; and their prior weights.
PRIOR = {"I": 6.0, "I!": 8.0, 'I"': 2.5, 'I"!': 3.5, "I-": 1.0, "I-!": 1.5, 'I-"': 0.5, 'I-"!': 0.75, "H": 0.5, "H!": 10.0, 'H"': 0.2, 'H"!': 3.0, "H-": 0.1, "H-!": 1.0, 'H-"': 0.1, 'H-"!': 0.5}
MARKED, BIAS = tuple(PRIOR), -4.0


@dataclass
class ToxicityModel:
    stems: dict[str, float]
    bias: float = BIAS
    weights: tuple[float, ...] = tuple(PRIOR.values())

    def __post_init__(self):
        self.machine, self.lexicon = grammar(), Lexicon(self.stems)
        self.place = {s: k for k, s in enumerate(MARKED)}

    def clause(self, words: list[str]) -> list[float]:
        """The words' weights under each marked symbol, as the composed machine gives them."""
        state, found, last = 0, [0.0] * len(MARKED), None
        for w in words:
            x, weight = self.lexicon(w)
            state, out = self.machine[state, x]
            if out[0] in "IH":
                found[self.place[out]] += weight
                last = None if "!" in out else (out, weight)
            elif out == "T!" and last:  # the target that came behind aims it
                found[self.place[last[0]]] -= last[1]
                found[self.place[last[0] + "!"]] += last[1]
                last = None
        return found

    def evidence(self, text: str) -> tuple[list[float], float]:
        """The logarithm of 1 + the weights under each symbol over all clauses, and the largest clause score."""
        low = text.lower()
        if not any(self.lexicon(w)[0] in "IH" for w in set(WORD.findall(low))):
            return [0.0] * len(MARKED), 0.0
        clauses = [self.clause(WORD.findall(c)) for c in CLAUSE.split(low)]
        top = max(sum(w * x for w, x in zip(self.weights, c, strict=True)) for c in clauses)
        return [log(1 + max(0.0, sum(x))) for x in zip(*clauses, strict=True)], top

    def score(self, evidence: list[float]) -> float:
        """The probability of the label by the logistic function."""
        x = self.bias + sum(w * e for w, e in zip(self.weights, evidence, strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, x))))


def _features(text: str) -> set[str]:
    out = set()
    for w in set(WORD.findall(text.lower())):
        if len(w) >= 4:
            out.add(w)
            out.update(w[:n] + "*" for n in range(4, 8) if len(w) > n)
    return out


def choose(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int, least: float) -> dict[str, float]:
    """Stems by log odds: a longer one is kept only beyond what a chosen shorter one already covers."""
    weighed = sorted((len(f.rstrip("*")), f, log((t + 0.5) / (n_toxic + 1)) - log((c + 0.5) / (n_clean + 1))) for f, t, c in rows)
    out: dict[str, float] = {}
    for n, f, w in weighed:
        word = f.rstrip("*")
        if w >= least and not any(word[:k] + "*" in out for k in range(4, n + (f[-1] != "*"))):
            out[f] = min(w, 8.0) / 8
    return out


def train_toxicity(df: DataFrame, labels: DataFrame, sample: int = 12000, least_support: int = 6, least_odds: float = 3.0) -> ToxicityModel:
    """Learns stems and the logistic function from at most `sample` labelled rows outside the held-out fold (chosen by a hash of the id)."""
    seen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    train = df.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most `sample` ids

    def count(_, texts, toxic):
        n = {0: Counter(), 1: Counter()}
        for raw, y in zip(texts, toxic, strict=True):
            n[int(y > 0)].update({"", *_features(raw.decode("utf-8", "replace"))})
        both = list(n[0].keys() | n[1].keys())
        return {"f": both, "t": [n[1][f] for f in both], "c": [n[0][f] for f in both]}

    counts = map_texts(train, count, "f string, t long, c long", ("toxic",)).groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    kept = counts.where((F.col("f") == "") | ((F.col("t") >= least_support) & (F.col("t") > 12 * F.col("c")))).collect()  # at most the words of `sample` texts over least_support
    total = next(((r["t"], r["c"]) for r in kept if r["f"] == ""), (0, 0))
    model = ToxicityModel(choose([(r["f"], r["t"], r["c"]) for r in kept if r["f"]], *total, least_odds))

    def evidence(_, texts, toxic):
        return {"y": [int(y > 0) for y in toxic], "x": [model.evidence(t.decode("utf-8", "replace"))[0] for t in texts]}

    rows = map_texts(train, evidence, "y int, x array<double>", ("toxic",)).collect()
    if rows and 0 < sum(r["y"] for r in rows) < len(rows):
        fitted = _logistic(np.array([[1, *r["x"]] for r in rows]), np.array([r["y"] for r in rows]), np.array([BIAS, *PRIOR.values()]))
        model.bias, model.weights = fitted[0], fitted[1:]
    return model


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, rounds: int = 60, ridge: float = 0.05) -> tuple[float, ...]:
    """Weights of the largest posterior around the prior ones, by damped Newton steps; those of evidence are not negative."""
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * (w - prior))
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        w[1:] = np.maximum(w[1:], 0.0)
    return tuple(float(v) for v in w)


def toxicity(df: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: held_out, score, predicted (score of at least 0.5), and the largest clause score."""

    def run(ids, texts):
        found = [model.evidence(t.decode("utf-8", "replace")) for t in texts]
        score = [model.score(e) for e, _ in found]
        return {"doc_id": ids, "score": score, "predicted": [int(s >= 0.5) for s in score], "clause": [top for _, top in found]}

    out = map_texts(df, run, "doc_id long, score double, predicted int, clause double")
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.col("clause").alias("top_clause_score"))
