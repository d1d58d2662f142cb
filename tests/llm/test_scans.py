"""Licence, secret, toxicity, language and quality operators against brute force and held-out truth."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm.language_id import language_id, suffix_automaton, train_languages
from lodestone.llm.license_scan import TEMPLATES, compile_template, license_scan
from lodestone.llm.quality_rules import cover, learn_rules, quality_rules
from lodestone.llm import secret_scan as secrets
from lodestone.llm.secret_scan import CharCnn, secret_scan
from lodestone.llm.secret_scan import train as train_secrets
from lodestone.llm.toxicity import ToxicityModel, grammar, toxicity, train_toxicity
from lodestone.llm.words import ALNUM, SPACED, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_words_are_the_regex_words():
    r = random.Random(1)
    texts = ["".join(r.choice("aB é\t\n\x0b.1İ-") for _ in range(r.randint(0, 60))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    for kind, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, WORD.pattern)):
        doc, s, e, h, data = words(raw, kind)
        got = [[] for _ in texts]
        for d, a, b in zip(doc, s, e):
            got[d].append(bytes(data[a:b]).decode())
        assert got == [re.findall(pattern, low(t)) for t in texts]
        by = {}
        for d, a, b, x in zip(doc, s, e, h):
            by.setdefault(int(x), set()).add(bytes(data[a:b]))
        assert all(len(v) == 1 for v in by.values())


def test_license_places_against_brute_force(docs):
    texts = ["The MIT License. mit-license MIT\nlicense", "Apache License, General Public License; public license", "xmit license", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", None, "İMIT LICENSE"]
    got = {r.doc_id: r for r in license_scan(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(low(t or ""))
        at = [(k, lab) for p, lab in ((["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl")) for k in range(len(w)) if w[k : k + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({b for _, b in at})))
        assert (r.first_word, r.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert got[3].labels == "mit,mit-notice" and got[4].labels == "cc-by-nc-4.0-notice"


def test_template_automaton_wants_the_mandatory_wording():
    a = compile_template("x", "[[this {{2}} is]] licensed under [[the]] foo license")
    ok = lambda t: a.accept(t.encode().split(), 0) == len(t.split())
    assert ok("licensed under foo license") and ok("this is licensed under the foo license") and ok("this big work is licensed under foo license")
    assert not ok("this very big work is licensed under foo license") and not ok("licensed under a foo license") and not ok("licensed foo license")


def plainest(markup):
    """A template's wording without optional parts, with a word in each replaceable region."""
    while "[[" in markup:
        markup = re.sub(r"\[\[(?:(?!\[\[|\]\]).)*\]\]", " ", markup, flags=re.S)
    return " ".join(re.sub(r"\{\{\d+\}\}", " acme ", markup).split())


def test_whole_licences(docs):
    """Each template's text is accepted; with a word changed, missing or inserted it isn't; nor inside another sentence."""
    r = random.Random(17)
    rows, want = [], []
    for label, markup in TEMPLATES:
        w = plainest(markup).split()
        k = r.choice([i for i, x in enumerate(w) if x != "acme" and w[max(0, i - 1)] != "acme" and w[min(i + 1, len(w) - 1)] != "acme"])
        for text, ok in ((" ".join(w), True), ("Some file.\n" + " ".join(w).upper() + ".\nMore text", True), (" ".join([*w[:k], "zebra", *w[k + 1 :]]), False), (" ".join([*w[:k], "zebra", *w[k:]]), False), ("never take this " + " ".join(w), False), (" ".join(w) + " except on sundays", False)):
            rows.append((len(rows), text))
            want.append((label, ok))
    rows.append((len(rows), "do not use this under the mit license"))
    want.append(("mit-notice", False))
    rows.append((len(rows), "This small library is released under the terms of the MIT license!"))
    want.append(("mit-notice", True))
    got = {x.doc_id: x.labels.split(",") for x in license_scan(docs(rows)).collect()}
    for (i, text), (label, ok) in zip(rows, want):
        # what begins or ends with a replaceable region takes more words there
        w = plainest(dict(TEMPLATES).get(label, "x")).split()
        if (text.endswith("sundays") and w[-1] == "acme") or (text.startswith("never") and w[0] == "acme"):
            continue
        assert (label in got[i]) == ok, (label, ok, text[:200])


def brute_secrets(t):
    out = [("assign", m.start(), m.end(), 0) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], x[3]))


def test_secret_base_against_brute_force(docs):
    r = random.Random(2)
    bits = ["é", " ", "token = \"", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef0", "Password:", "api_key=", "a1b2c3d4e5f6", "\n", "x", "ſecret=", "secret' : '", "deadbeef"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 14))) for _ in range(150)] + [None]
    got = {x.doc_id: x for x in secret_scan(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = brute_secrets(t or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e, _ in want)
        x = got[i]
        assert x.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (t, said, x.spans)
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(w[3] == k for w in want) for k in range(3)]
        assert set(filter(None, said.split(","))) <= set(filter(None, x.spans.split(",")))


def test_network_learns_and_keeps_recall():
    r = np.random.default_rng(0)
    x = r.integers(0, 26, (600, 40))
    y = r.integers(0, 2, 600).astype(float)
    x[y == 1, 10:14] = [30, 31, 30, 31]
    m = CharCnn().fit(x, y)
    p = m.probability(x)
    assert ((p >= m.threshold) == (y == 1)).mean() > 0.95
    assert (p[y == 1] >= m.threshold).mean() >= 0.95


def test_network_sees_every_candidate(docs):
    """Keys behind words that the base patterns don't know are found; long words are not; recall is measured."""
    r = random.Random(13)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n, a=alnum: "".join(r.choices(a, k=n))
    words = ["internationalisation", "straightforwardly", "the", "of", "misunderstanding", "well-known-people", "a", "river"]
    rows = [(i, " ".join(r.choices(words, k=30)) + (f' token = "{key(40, alnum[26:])}" and more' if i % 3 else "")) for i in range(400)]
    planted = [(1000 + i, f'then client_secret="{key(32)}" ' if i % 2 else f'Authorization: bearer {key(40)} ok') for i in range(20)]
    alone = [(2000 + i, f'then bearer {key(40, alnum[:52])} and so on') for i in range(20)]
    d = docs(rows + planted + alone)
    model = train_secrets(d)
    assert model.recall >= 0.9 and model.false_alarms <= 0.1
    got = {x.doc_id: x for x in secret_scan(d, model).collect()}
    assert sum(got[i].n_cnn > 0 for i, _ in alone) >= 15
    assert sum(got[i].n_confirmed == got[i].n_assign == 1 for i, _ in rows if i % 3) >= 0.9 * sum(i % 3 > 0 for i, _ in rows)
    assert sum(got[i].n_cnn for i, _ in rows if not i % 3) <= 10


def test_network_learns_from_all_windows(docs, monkeypatch):
    """Every distinct window is dealt to a shard once, with its label, and the model doesn't depend on how rows are dealt out."""
    monkeypatch.setattr(secrets, "SHARD", 1000)
    monkeypatch.setattr(secrets, "MADE", 100)
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=14))
    d = docs([(i, f"{word()} {word()} then {word()}" + (f' token = "{"".join(r.choices("0123456789ghijk", k=20))}"' if i % 5 == 0 else "")) for i in range(1500)])
    found = secrets.labelled(d).collect()
    assert len({x.x for x in found}) == len(found) == 4800 and sum(x.y for x in found) == 300
    rows = secrets._packed(secrets.labelled(d), 5).collect()
    assert sum(len(x.y) for x in rows) == 4800 and len(rows) == 5 and sum(sum(x.y) for x in rows) == 300
    one, many = (train_secrets(d.repartition(k)) for k in (1, 5))
    assert all(np.array_equal(one.p[k], many.p[k]) for k in one.p) and one.threshold == many.threshold


def test_grammar_marks_clauses():
    m = ToxicityModel({"idiot": 1.0, "scumm*": 1.0})
    one = lambda t: m.evidence(t)[1]
    score = lambda t: m.score(m.evidence(t)[0])
    assert one("you idiot") > one("idiot") > one("he said idiot") > one("he said not idiot") > 0
    assert one("not an idiot") < one("idiot") and one("nothing here") == 0
    assert one("kill") < one("idiot") and one("i will kill you") > one("idiot")
    assert score("i will kill you") >= 0.5 > score("kill") and score("you are an idiot") >= 0.5 > score("nothing here")
    assert score("he said you are not an idiot") < score("he said you are an idiot") < score("you are an idiot")
    assert m.lexicon("idiots") == ("o", 0.0) and m.lexicon("scummy") == ("I", 1.0) and m.lexicon("kill") == ("H", 1.0) and m.lexicon("nie") == ("N", 1.0)
    assert one("what scummering") == one("idiot")
    assert {x for _, x in grammar()} == {"I", "H", "T", "N", "R", "Q", "o"}


def test_toxicity_on_held_out_rows(spark, docs):
    r = random.Random(4)
    filler = [f"word{k}" for k in range(50)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = r.choices(filler, k=30) + (r.choices(["idiot", "vequant", "vequito"], k=2) if toxic else [])
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(rows + [(9000, None), (9001, "")])
    out = toxicity(d, train_toxicity(d, lab))
    got = out.where("held_out").join(lab, "doc_id").collect()
    assert got and sum(x.predicted == x.toxic for x in got) / len(got) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out.collect())


def test_automaton_counts_phrases():
    def greedy(text, sample):
        n, i = 0, 0
        while i < len(text):
            k = 1
            while i + k <= len(text) and text[i : i + k] in sample:
                k += 1
            i += max(1, k - 1)
            n += 1
        return n

    r = random.Random(5)
    sample = [r.randint(0, 3) for _ in range(300)]
    automaton = suffix_automaton(sample, 5)
    word = "".join(map(str, sample))
    for _ in range(30):
        text = [r.randint(0, 4) for _ in range(80)]
        got = automaton.phrases(np.array(text, np.int32)[:, None])[0]
        assert got == greedy("".join(map(str, text)), word)


def test_language_held_out(docs):
    r = random.Random(6)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "éüabx"}
    rows = [(i, " ".join("".join(r.choices(alphabets[k], k=4)) for _ in range(40)), k) for i in range(240) for k in [list(alphabets)[i % 3]]]
    d = docs(rows + [(900, "123 ...", "aa"), (901, None, "aa"), (902, "", None)])
    out = language_id(d, train_languages(d)).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in out if x.held_out and x.doc_id < 900]
    assert held and sum(x.lang == x.lang_pred for x in held) / len(held) > 0.95
    assert {x.doc_id: x.lang_pred for x in out if x.doc_id >= 900} == {900: "und", 901: "und", 902: "und"}


def test_scripts_of_many_letters(docs):
    """Three scripts of 2,500 letters each, and a brute-force decision on the same phrase counts."""
    r = random.Random(16)
    scripts = {"aa": 0x4E00, "bb": 0x5A00, "cc": 0xAC00}
    rows = [(i, " ".join("".join(chr(scripts[k] + min(2499, int(r.expovariate(1 / 500)))) for _ in range(3)) for _ in range(60)), k) for i in range(300) for k in [list(scripts)[i % 3]]]
    d = docs(rows)
    parser = train_languages(d)
    out = language_id(d, parser).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert out and sum(x.lang == x.lang_pred for x in out) / len(out) >= 0.95
    texts = dict((i, t) for i, t, _ in rows)
    for x in out[:10]:
        code = parser.codes(texts[x.doc_id])[0]
        ratios = []
        for automaton, rate in zip(parser.tables, parser.rates):
            n = 0
            for piece in (code[k : k + 256] for k in range(0, len(code), 256)):
                state = len(automaton.base) - 1
                for c in piece.tolist():
                    at = automaton.base[state] + c
                    v = automaton.target[at] if automaton.owner[at] == state else automaton.root[c]
                    n, state = n + (v >= 1 << 28), v & ((1 << 28) - 1)
            ratios.append(n / len(code) / rate)
        best = min(range(3), key=lambda k: ratios[k])
        assert x.lang_pred == parser.langs[best] and abs(x.phrase_ratio - ratios[best]) < 1e-9


def test_quality_base_against_brute_force(docs):
    r = random.Random(7)
    space = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [" ".join(r.choices(["a", "b", "c#", "é"], k=r.randint(0, 60))) + r.choice(["", "\n\nx y\nx y\n \n"]) for _ in range(120)] + [None, "w " * 5000, "\x0b a\x0cb "]
    got = {x.doc_id: x for x in quality_rules(docs(list(enumerate(texts))), []).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = space.findall(t)
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        covered = {q for ps in seen.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
        lines = [x for x in t.split("\n") if space.search(x)]
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert x.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and x.kept == (not x.base_failed)


def test_decision_list_finds_a_conjunction():
    r = random.Random(8)
    names = ["n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "line_words"]
    rows = [{n: r.random() for n in names} for _ in range(900)]
    bad = [x["upper_share"] > 0.7 and x["digit_share"] <= 0.4 for x in rows]
    rules = cover(rows, bad)
    fires = [any(all((x[l.feature] > l.threshold) == l.above for l in rule) for rule in rules) for x in rows]
    assert sum(a == b for a, b in zip(fires, bad)) / len(bad) > 0.95


def test_edge_rows_have_results(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = edge.limit(0)
    for f in (license_scan, secret_scan, lambda d: toxicity(d, train_toxicity(d, none)), lambda d: language_id(d, train_languages(d)), lambda d: quality_rules(d, learn_rules(d, none))):
        assert f(edge).count() == edge.count()
        assert f(empty).count() == 0
