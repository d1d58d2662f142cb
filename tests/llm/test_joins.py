"""Join-shaped operators and models against brute force."""

import collections
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestone.llm.components import components
from lodestone.llm import common
from lodestone.llm.decontaminate import Filter, Index, canonical, decontaminate, item_rows, without_benchmark
from lodestone.llm.line_dedup import dedup_lines, edit_distance, line_verdicts
from lodestone.llm.lm_score import lm_score
from lodestone.llm.words import words
from lodestone.llm.mixing import ENOUGH, OTHER, _bucket_counts, calibrate, fit, mixing, rake, sample, train_topics, uniform
from lodestone.llm.ngram_join import first_of_groups, meet, ngram_join
from lodestone.llm.pitman_yor import log_stirling, seat, seat_alike, sweep


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_ngram_join_against_brute_force(docs):
    r = random.Random(1)
    vocab = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(25):
        base = r.choices(vocab, k=r.randint(1, 90))
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocab)
            texts.append(" ".join(t))
    texts += [None, "", "a b c", "A b  C", "x"] + ["same old text again"] * 5
    want, sizes = brute_components(texts)
    got = {x.doc_id: x for x in ngram_join(docs(list(enumerate(texts)))).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes


def test_ngram_join_in_tiles(docs, monkeypatch):
    import lodestone.llm.ngram_join as m

    monkeypatch.setattr(m, "BLOCK", 160)
    monkeypatch.setattr(m, "BUCKET", 50)
    r = random.Random(2)
    base = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(40)] = f"z{r.randrange(30)}"
        texts.append(" ".join(t))
    got = {x.doc_id: x.component_id for x in ngram_join(docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(60)] == brute_components(texts)[0]


def test_meetings_find_all_components():
    r = random.Random(11)
    for case in range(150):
        base = list(range(60))
        sets = []
        for _ in range(r.randint(2, 40)):
            s = set(base)
            for _ in range(r.randint(0, 7)):
                s.discard(r.choice(base))
                s.add(100 + r.randrange(12))
            sets.append(np.array(sorted(s), np.int64))
        n = len(sets)
        want = list(range(n))
        for i in range(n):
            for j in range(n):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 85 * len(a | b):
                    old, new = max(want[i], want[j]), min(want[i], want[j])
                    want = [new if x == old else x for x in want]
        got = list(range(n))
        for a, b in meet(list(range(n)), sets, [len(s) for s in sets], list(range(n)), [0] * n, 85):
            old, new = max(got[a], got[b]), min(got[a], got[b])
            got = [new if x == old else x for x in got]
        assert got == want, case


def test_ngram_join_of_other_widths(docs):
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(f"z{r.randrange(50)}" if r.random() < 0.02 else w for w in base) for _ in range(30)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    label = list(range(30))
    for i in range(30):
        for j in range(30):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    got = {x.doc_id: x.component_id for x in ngram_join(docs(list(enumerate(texts))), 80, 5).collect()}
    assert [got[i] for i in range(30)] == label


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def mutated(r, t, edits):
    t = list(t)
    for _ in range(edits):
        k, o = r.randrange(len(t)), r.random()
        if o < 0.33:
            t.insert(k, r.choice("abc dé"))
        elif o < 0.66:
            del t[k]
        else:
            t[k] = r.choice("abc dé")
    return "".join(t)


def test_banded_edit_distance(spark):
    r = random.Random(3)
    rows = []
    for _ in range(600):
        a = "".join(r.choices("abc dé", k=r.randint(8, 40)))
        rows.append((a, mutated(r, a, r.randint(0, 4))))
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        for a, b, d in df.select("a", "b", edit_distance(F.col("a"), F.col("b"), k)).collect():
            x = lev(a, b)
            assert d == x if x <= k else d is None or d > k


def test_line_dedup_against_brute_force(docs):
    r = random.Random(4)
    lines = ["".join(r.choices("abc dé", k=r.randint(40, 60))) for _ in range(40)]
    lines += [mutated(r, r.choice(lines), r.randint(1, 3)) for _ in range(60)]
    rows = [(i, "\n".join(r.choices(lines + ["", "short"], k=r.randint(0, 8)))) for i in range(60)] + [(90, None)]
    first, seen = {}, []
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            if len(x) >= 40:
                first.setdefault(x, (i, p))
                seen.append((i, p, x))
    gone = {a for a in first for b in first if first[b] < first[a] and abs(len(a) - len(b)) <= 2 and lev(a, b) <= 2}
    keep = collections.defaultdict(list)
    for i, p, x in seen:
        if first[x] == (i, p) and x not in gone:
            keep[i].append(p)
    assert gone
    d = docs(rows)
    got = {x.doc_id: x.kept_places for x in line_verdicts(d).collect()}
    assert got == {i: ",".join(map(str, keep[i])) for i, _ in rows}
    out = {x.doc_id: x for x in dedup_lines(d).collect()}
    for i, t in rows:
        if t is None:
            assert out[i].text is None
            continue
        want = "\n".join(x for p, x in enumerate(t.split("\n")) if len(x) < 40 or p in keep[i])
        if want.strip(" ") or not t.strip(" "):
            assert out[i].text == want and out[i].n_chars == len(want)
        else:
            assert i not in out
    assert dedup_lines(d).columns == d.columns


def test_short_lines_against_brute_force(spark, docs, tmp_path):
    from corpus_pipeline import lines as stage
    from lodestone.llm.queries import op4_line_dedup

    r = random.Random(12)
    lines = ["".join(r.choices("abc dé", k=r.randint(1, 24))) for _ in range(70)]
    lines += [mutated(r, r.choice([x for x in lines[:70] if len(x) > 3]), r.randint(1, 3)) for _ in range(110)]
    lines += ["", "  ", "}", "--", "Released under the MIT License.", "Released under the MIT Licence.", "4"]
    rows = [(i, "\n".join(r.choices(lines, k=r.randint(0, 9)))) for i in range(70)] + [(90, None)]
    first, seen = {}, []
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            if any(c.isalnum() for c in x):
                first.setdefault(x, (i, p))
                seen.append((i, p, x))

    def near(a, b):
        least = min(len(a), len(b))
        return least >= 3 and lev(a, b) <= (1 if least < 20 else 2)

    gone = {a for a in first for b in first if first[b] < first[a] and near(a, b)}
    keep = collections.defaultdict(list)
    for i, p, x in seen:
        if first[x] == (i, p) and x not in gone:
            keep[i].append(p)
    assert {min(len(x), 20) for x in gone} >= {3, 5, 12, 19, 20}
    d = docs(rows)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: x.kept_places for i, x in got.items()} == {i: ",".join(map(str, keep[i])) for i, _ in rows}
    out = {x.doc_id: x.text for x in stage(spark, d, str(tmp_path)).collect()}
    for i, t in rows:
        cut = (t or "").split("\n")
        assert got[i].n_checked == sum(any(c.isalnum() for c in x) for x in cut)
        want = "\n".join(x for p, x in enumerate(cut) if not any(c.isalnum() for c in x) or p in keep[i])
        if t is not None and (want.strip(" ") or not t.strip(" ")):
            assert out[i] == want


def test_templates():
    toks, raw = canonical("Then Tom ate 3 apples in 5 min. He left.")
    assert toks == ["then", "<name>", "ate", "<num>", "apples", "in", "<num>", "<unit>", "he", "left"] and raw[1] == "tom"
    ix = Index([(7, "Tom has 5 pears and gives 2 pears to Mary. How many pears does Tom have left after 3 days?")])
    kind = lambda t: [(m[0], m[4]) for m in ix.matches(t)]
    assert kind("x. Tom has 5 pears and gives 2 pears to Mary. How many pears does Tom have left after 3 days? y") == [(7, "exact")]
    assert kind("x. Tom has 9 pears and gives 4 pears to Mary. How many pears does Tom have left after 7 days?") == [(7, "changed")]
    assert kind("and Ann has 5 pears and gives 2 pears to Eve. How many pears does Ann have left after 3 days?") == [(7, "changed")]
    assert kind("And ann has 5 pears and gives 2 pears to mary. How many pears does tom have left after 3 days?") == [(7, "exact")]  # all but the first word
    assert kind("and Ann has 5 pears and gives 2 pears to Eve. How many pears does Zoe have left after 3 days?") == []
    assert kind("TOM HAS 5 PEARS AND GIVES 2 PEARS TO MARY. HOW MANY PEARS DOES TOM HAVE LEFT AFTER 3 DAYS?") == [(7, "exact")]
    iy = Index([(8, "A bag of 3 kg of rice costs 5 euros and a bag of 7 kg costs more")])
    assert [m[4] for m in iy.matches("so a bag of 4 lb of rice costs 9 dollars and a bag of 6 lb costs more")] == ["changed"]
    assert kind("nothing of the kind stands here at all today") == []


def test_decontamination_against_brute_force(spark, docs, monkeypatch):
    r = random.Random(5)
    vocab = [f"{a}{b}" for a in "abcdef" for b in "uvwxyz"]
    items = [(k, " ".join(r.choices(vocab, k=r.randint(10, 30)))) for k in range(12)]
    rows, want = [], {}
    for i in range(80):
        t = r.choices(vocab, k=60)
        some = r.sample(items, i % 3)
        text = " ".join(t[:20]) + ". " + ". ".join(x for _, x in some) + ". " + " ".join(t[20:])
        rows.append((i, text))
        want[i] = ",".join(map(str, sorted(k for k, _ in some)))
    d = docs(rows + [(99, None)])
    b = spark.createDataFrame(items + [(50, None), (51, "")], "item_id long, text string")
    for small in (200_000, 0):  # by broadcasts, and by shuffles alone
        monkeypatch.setattr(common, "SMALL", small)
        got = {x.doc_id: x.item_ids for x in decontaminate(d, b).collect()}
        assert got == want | {99: ""}
    assert decontaminate(d, b.limit(0)).where("contaminated").count() == 0


def test_items_with_inserted_and_missing_words():
    item = "the old baker sells 5 loaves of bread every morning before he walks 3 miles along the river to town"
    ix = Index([(1, item)])
    found = lambda t: [(m[0], m[4]) for m in ix.matches(f"so it was. {t}. and so on")]
    assert found(item) == [(1, "exact")]
    assert found(item.replace("morning before", "single morning before")) == [(1, "changed")]
    assert found(item.replace("morning ", "")) == [(1, "changed")]
    assert found(item.replace("5 loaves of bread every morning before", "5 loaves of bread every morning long before")) == [(1, "changed")]
    # Values that differ in the item may meet in one; equal ones may not part.
    assert found(item.replace("5", "4").replace("3", "4")) == [(1, "changed")]
    iy = Index([(2, "the baker sells 5 loaves of bread every morning and then 5 cakes in the late evening")])
    two = lambda a, b: [m[4] for m in iy.matches(f"the baker sells {a} loaves of bread every morning and then {b} cakes in the late evening")]
    assert two(7, 7) == ["changed"] and two(7, 8) == []
    units = Index([(3, "he first ran 5 km along the shore and later on he swam 7 miles across the wide lake")])
    assert [m[4] for m in units.matches("he first ran 5 km along the shore and later on he swam 7 km across the wide lake")] == ["changed"]
    spelt = Index([(4, "in one box of the shop there are just 5 pears that the farmer sold to us last week")])
    assert [m[4] for m in spelt.matches("in one box of the shop there are just twenty five pears that the farmer sold to us last week")] == ["changed"]
    # Halves in the wrong order, or far apart, are no copy.
    w = item.split()
    assert found(" ".join(w[10:] + w[:10])) == [] and found(" ".join(w[:10]) + " x" * 60 + " " + " ".join(w[10:])) == []
    # A repeated item is found each time.
    assert found(f"{item}. {item.replace('morning ', '')}. {item}") == [(1, "exact"), (1, "changed"), (1, "exact")]


def test_decontamination_keeps_rows(spark, docs, monkeypatch):
    items = [(k, " ".join(f"{a}{'uvwxyz'[k]}x" for a in "abcdefghijkl")) for k in range(6)]
    d = docs([(1, items[0][1]), (1, items[3][1]), (1, "nothing"), (None, items[2][1]), (None, None), (None, items[5][1])])
    b = spark.createDataFrame(items + [(9, items[5][1]), (9, items[5][1])], "item_id long, text string")
    for small in (200_000, 0):
        monkeypatch.setattr(common, "SMALL", small)
        got = sorted((str(x.doc_id), x.item_ids, x.n_runs) for x in decontaminate(d, b).collect())
        assert [x[1] for x in got] == ["", "0", "3", "", "2", "5,9"]
        left = d.withColumn("row", F.lit("x")).withColumn("windows", F.lit("y"))
        kept = without_benchmark(left, b)
        assert kept.columns == left.columns and sorted((str(x.doc_id), x.text, x.row, x.windows) for x in kept.collect()) == [("1", "nothing", "x", "y"), ("None", None, "x", "y")]


def test_the_filter_loses_no_window(spark):
    """Windows of the filter against all windows of the index, on texts full of the benchmark's words and odd characters."""
    r = random.Random(41)
    vocab = ["tom", "Ann", "has", "pears", "three", "é", "über", "naïve", "the", "of", "river", "km"]
    items = [(k, " ".join(r.choice(vocab) if r.random() < 0.8 else str(r.randint(1, 99)) for _ in range(r.choice([3, 12, 20])))) for k in range(25)]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.col("item_id"))
    chosen, index = Filter(item_rows(b)), Index(items)
    glue = [" ", " ", ", ", ". ", "—", "“", "-", "_", "÷", "’", " 3.5 ", "\n"]
    hits = 0
    for _ in range(400):
        text = "".join(x for _ in range(r.randint(3, 40)) for x in (r.choice([*vocab, r.choice(items)[1], "zebra", "x1y2"]), r.choice(glue)))
        text = r.choice([text, text.upper(), text.title()])
        found = index.matches(text)
        hits += bool(found)
        if found:
            assert chosen.plausible([text.encode()])[0] and chosen.windows(text), text
    assert hits > 50


def test_raking_meets_the_marginals(spark, docs):
    tokens = {(a, b): float(10 * x + y + 1) for x, a in enumerate("pqr") for y, b in enumerate("st")}
    w, _ = rake(tokens, [{"p": 0.2, "q": 0.3, "r": 0.5}, {"s": 0.6, "t": 0.4}])
    assert abs(sum(v for k, v in w.items() if k[0] == "q") - 0.3) < 1e-6 and abs(sum(v for k, v in w.items() if k[1] == "s") - 0.6) < 1e-6
    # p has 3 tokens, so that its fifth allows a sample of 15: the budget shrinks, and the marginals hold.
    _, p, _ = calibrate(tokens, [{"p": 0.2, "q": 0.3, "r": 0.5}, {"s": 0.6, "t": 0.4}], 0.5)
    taken = {k: p[k] * tokens[k] for k in tokens}
    assert 14 < sum(taken.values()) < 15.3 and max(p.values()) <= 1
    assert all(abs(sum(v for k, v in taken.items() if k[d] == name) / sum(taken.values()) - want) < 0.004 for d, name, want in ((0, "p", 0.2), (0, "r", 0.5), (1, "s", 0.6)))
    # What no sample can give, as the cells for it don't exist, is given as far as it goes.
    _, p, _ = calibrate({("a", "x"): 10.0, ("b", "y"): 10.0}, [{"a": 0.9, "b": 0.1}, {"x": 0.1, "y": 0.9}], 0.5)
    assert all(0 <= v <= 1 for v in p.values()) and sum(10 * v for v in p.values()) > 1
    r = random.Random(6)
    themes = [[f"{c}{k}" for k in range(40)] for c in "abc"]
    d = docs([(i, " ".join(r.choices(themes[i % 3], k=r.randint(1, 40))), r.choice(["en", "de", "de", None])) for i in range(1500)] + [(5000, None), (None, "x y")])
    mix = fit(d, {"lang": {"en": 0.5, "de": 0.4, "none": 0.1}}, budget=0.02)
    assert abs(mix.marginal("lang")["en"] - 0.5) < 1e-6 and sum(x[3] for x in mix.rows if x[5] == 1) < 0.01 * sum(x[3] for x in mix.rows)
    out = mixing(mix).collect()
    assert len(out) == 1502 and sample(d, mix).columns == d.columns
    assert sorted(str(x.doc_id) for x in sample(d, mix).collect()) == sorted(str(x.doc_id) for x in out if x.sampled)
    # What is expected meets the targets but for cells that are taken whole, what is sampled about so; each token's weight adds up.
    expected, got = collections.Counter(), collections.Counter()
    for x in out:
        expected[x.lang_cell] += x.probability * x.n_tokens
        got[x.lang_cell] += x.sampled * x.n_tokens
    assert abs(expected["en"] / sum(expected.values()) - 0.5) < 0.02 and got["en"] > 0
    assert abs(sum(x.token_weight * x.n_tokens for x in out) - 1) < 1e-9
    chance = lambda x: x.probability / 0.02 * 0.3  # a larger draw of the same proportions, by the same numbers of the ids
    u = {r.doc_id: r.u for r in d.select("doc_id", uniform().alias("u")).collect()}
    got = collections.Counter()
    for x in out:
        got[x.lang_cell] += (u[x.doc_id] < chance(x)) * x.n_tokens
    assert abs(got["en"] / sum(got.values()) - 0.5) < 0.12
    # Within a language topics follow the themes: almost all texts of a theme that are long enough have topics that no other theme has.
    of = collections.defaultdict(collections.Counter)
    for x in out:
        if x.n_tokens >= 8:
            of[x.lang_cell, x.topic_cell][x.doc_id % 3] += 1
    assert sum(max(c.values()) for c in of.values()) >= 0.95 * sum(sum(c.values()) for c in of.values())
    assert set(mix.topics.models) == {"other", "en", "de", "none"}
    for lang, model in (("en", "en"), ("xx", "other"), (None, "other")):
        offset, word = mix.topics.models[model]
        brute = [25 * sum(float(word[int(h) >> 52, k]) for h in words(["a1 b2 c3 a1".encode()])[3]) + offset[k] for k in range(8)]
        assert mix.topics.of([b"a1 b2 c3 a1"], [lang]) == ([f"topic{int(np.argmax(brute))}"], [4])
    assert mixing(fit(d.limit(0))).count() == 0


def test_the_sample_meets_the_marginals(spark):
    """On the given table the sampled tokens are within 0.02 of the targets, in all three dimensions, and topics aren't languages."""
    from lodestone.llm.queries import TARGETS

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mix = fit(d, TARGETS)
    got = [collections.Counter() for _ in range(3)]
    by_topic = collections.defaultdict(collections.Counter)
    for x in mixing(mix).collect():
        for c, v in zip(got, (x.source_cell, x.lang_cell, x.topic_cell), strict=True):
            c[v] += x.sampled * x.n_tokens
        by_topic[x.topic_cell][x.lang_cell] += x.n_tokens
    for c, d in zip(got, ("source", "lang", "topic"), strict=True):
        s = sum(c.values())
        assert all(abs(c[v] / s - want) <= 0.021 and abs(c[v] / s - share) < 1e-9 for v, (want, _, share) in mix.shares[d].items())
    assert sum(got[0].values()) > 0.3 * sum(x[3] for x in mix.rows)
    assert all(len([1 for n in c.values() if n > 0.01 * sum(c.values())]) >= 3 for c in by_topic.values())


def test_topics_learn_from_all_documents(docs):
    """A language with just enough among thousands of documents has topics; words of each document count, however rows are dealt out."""
    r = random.Random(8)
    themes = ["river stone water fish", "market price stock trade", "engine wheel motor road"]
    rows = [(i, " ".join(r.choices(themes[i % 3].split(), k=12)), "en") for i in range(2600)]
    rows += [(10_000 + i, " ".join(r.choices(themes[i % 3].split(), k=12)), "de") for i in range(ENOUGH)] + [(None, "sole words of a row", "fr"), (7, None, "en")]
    d = docs(rows)
    one, many = (train_topics(x, topics=3) for x in (d.repartition(1), d.repartition(7)))
    assert set(one.models) == {"en", "de", OTHER} == set(many.models)
    for m in one.models:
        assert all(np.array_equal(x, y) for x, y in zip(one.models[m], many.models[m], strict=True))
    named = one.of([x[1].encode() for x in rows[:2600]], ["en"] * 2600)[0]
    assert len(set(zip(named, [i % 3 for i in range(2600)], strict=True))) == 3  # a theme is a topic
    absent, sole = one.models[OTHER][1][[h for h in range(4096) if h not in set(_bucket_counts([b"sole words of a row", *(t.encode() for t in themes)])[1].tolist())][0]], one.models[OTHER][1][_bucket_counts([b"sole"])[1][0]]
    assert sole.max() > absent.max() + 0.5  # one row without an id is learnt from


def test_a_round_of_the_topics_reads_blocks(docs):
    """Documents are laid out once, in few rows of one language, and a round's sums are those of the words that each document has, exactly."""
    from lodestone.llm import mixing as m

    r = random.Random(11)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(60)], k=r.randint(1, 50))), r.choice(["en", "de", "xx"])) for i in range(600)] + [(900, "often " * 700 + "seldom", "en"), (901, None, "en")]
    counted = m.written(m.counts(docs(rows)))[0].where("tokens > 0").coalesce(1)
    laid = m._lay(counted, ["en", "de"])
    assert laid.count() <= 6 and {x.model for x in laid.collect()} == {"en", "de", OTHER}
    rng = np.random.default_rng(3)
    models = {x: np.rint(np.log((rng.random((4096, 3)) + 0.1) / 4096) * m.LOGS) / m.LOGS for x in ("en", "de", OTHER)}
    shares = {x: np.log(np.array([0.2, 0.3, 0.5])) for x in models}
    got, want = m._sums(laid, models, shares), {x: np.zeros((4097, 3)) for x in models}
    for _, text, lang in rows:
        n = np.bincount(_bucket_counts([(text or "").encode()])[1], minlength=4096)
        for x in {lang if lang in models else OTHER, OTHER} if n.any() else ():
            like = n @ models[x] + shares[x]
            p = np.exp(like - like.max())
            p = np.rint(p / p.sum() * m.SHARES)
            want[x] += np.concatenate([np.outer(n, p), p[None]])
    assert all(np.array_equal(got[x], want[x]) for x in models)


def test_rounds_of_components_leave_nothing_behind(spark):
    """What a round replaces is removed from the shared folder: a path takes many rounds and leaves two tables, its edges and the last labels."""
    n, shared = 300, f"{common.shared_dir(spark).removeprefix('file:')}/lodestone"
    there = lambda: set(os.listdir(shared)) if os.path.isdir(shared) else set()
    old = there()
    out = components(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {(r.id, r.root) for r in out.collect()} == {(i, 0) for i in range(n)}
    assert len(there() - old) <= 3


def test_rounds_of_components_are_few_jobs(spark):
    """Labels of few ids are broadcast: a round shuffles once, so that the driver doesn't hold a thread for each of a dozen exchanges."""
    n, sc = 300, spark.sparkContext
    sc.setJobGroup("few jobs", "components of a path")
    try:
        out = components(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
        assert len(sc.statusTracker().getJobIdsForGroup("few jobs")) <= 60
    finally:
        for k in ("spark.jobGroup.id", "spark.job.description"):
            sc.setLocalProperty(k, None)
    assert {(r.id, r.root) for r in out.collect()} == {(i, 0) for i in range(n)}


def test_components_of_many_ids_are_those_of_few(spark, monkeypatch):
    """Self-links, nulls and repeated links, with labels broadcast and shuffled."""
    import lodestone.llm.components as m

    edges = [(1, None), (None, 2), (5, 5), (7, 5), (-3, 7), (9, 8), (9, 8), (8, 9), *((i, i + 1) for i in range(20, 60))]
    want = {5: -3, 7: -3, -3: -3, 9: 8, 8: 8} | {i: 20 for i in range(20, 61)}
    for small in (m.SMALL, 0):
        monkeypatch.setattr(m, "SMALL", small)
        rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(rows) == len(want) and {r.id: r.root for r in rows} == want


def test_the_driver_hashes_no_words_for_the_benchmarks_filter(spark):
    """Tables of hashing (62 MB with what they take to make) belong to workers: the driver makes none."""
    from lodestone.llm import words

    words._powers.cache_clear()
    items = spark.createDataFrame([(1, "It ran 20 miles in three hours, and then two more.")], "item long, text string")
    chosen = Filter(item_rows(items))
    assert words._powers.cache_info().currsize == 0
    assert chosen.plausible([b"It ran 20 miles in three hours, and then two more.", b"none of it"]).tolist() == [True, False]


def test_workers_get_few_long_texts_at_once(spark, docs):
    """A batch that a worker gets, and a step's share of it, is bounded by bytes: 200 texts of 0.1 MB come in several."""
    d = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    seen = common.with_texts(d, "x", LongType(), lambda texts: [len(t) for t in texts])
    assert seen.agg(F.sum("x")).first()[0] == 200 * 100_000
    assert max(r["n"] for r in d.mapInArrow(sizes, "n long").collect()) <= 2 * common.BATCH_BYTES


def test_rows_without_id_draw_for_themselves(docs):
    d = docs([(None, f"w{k} text") for k in range(400)])
    mix = fit(d, {"lang": {"en": 1.0}}, budget=0.5)
    assert 140 < sample(d, mix).count() < 260


def test_lm_base_against_brute_force(docs):
    r = random.Random(7)
    vocab = [f"v{k}" for k in range(400)]
    weight = [1 / (k + 1) for k in range(400)]
    follow = {w: r.choices(vocab, weight, k=2) for w in vocab}

    def text(n):
        out = r.choices(vocab, weight)
        while len(out) < n:
            out.append(r.choice(follow[out[-1]]) if r.random() < 0.8 else r.choices(vocab, weight)[0])
        return " ".join(out[:n])

    rows = [(i, text(r.randint(0, 60))) for i in range(150)] + [(200, None), (201, "NEW words Only")]
    toks = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    c = collections.Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    out = lm_score(docs(rows)).collect()
    assert len(out) == len(rows)
    for x in out:
        t = toks[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert abs(x.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
        assert x.score < 0
    held = [x for x in out if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    assert lm_score(docs([])).count() == 0


def test_lm_scores_against_the_written_model(spark, docs, monkeypatch):
    """Scores from the model's tables by plain dictionaries, with split contexts and many shards and packs."""
    import lodestone.llm.lm_score as m

    monkeypatch.setattr(m, "SHARD", 60)
    monkeypatch.setattr(m, "PACK", 90)
    r = random.Random(31)
    rows = [(i, " ".join(r.choices(["a", "a", "b", "c", "d", f"x{r.randrange(30)}"], k=r.randint(0, 25)))) for i in range(60)] + [(7, "a b a b"), (7, "a b a b"), (None, "a c"), (200, None)]
    made = []
    model = m.PitmanYorModel
    monkeypatch.setattr(m, "PitmanYorModel", lambda *a: made.append(model(*a)) or made[0])
    out = m.lm_score(docs(rows)).collect()
    py = made[0]
    assert py.shards > 3 and len(py.hot) >= 1
    tok = lambda t: m.tokens([(t or "").encode()])[1].tolist()
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c1, c2 = collections.Counter(), collections.Counter()
    for t in train:
        w = tok(t)
        c1.update(w)
        c2.update(zip([int(m.END), *w[:-1]], w))
    # The written table of each shard: every pair's customers less discounts, and what a context leaves to the parent.
    shards = [row_frame(row).iloc[0] for row in py.tables.collect()]

    def looked_up(v, w):
        """(customers less discounts, share of the parent, customers and strength) of a pair."""
        for row in shards:
            k, n = len(row["a"]) // 16, len(row["c"]) // 10
            contexts = np.frombuffer(row["a"], np.uint64, k).tolist()
            if v in contexts:
                at = contexts.index(v)
                back, over = np.frombuffer(row["a"], np.float32, 2 * k, 8 * k).reshape(2, k)[:, at]
                key = int(m._pair_keys(np.array([at]), np.array([w >> 16], np.uint64))[0])
                if key in m.get48(row["b"]).tolist():
                    return 1 - py.d, float(back), float(over)
                others = m.get48(row["c"][: 6 * n]).tolist()
                if key in others:
                    return float(np.frombuffer(row["c"], np.float32, n, 6 * n)[others.index(key)]), float(back), float(over)
                found = (0.0, float(back), float(over))
        return found if any(v in np.frombuffer(row["a"], np.uint64, len(row["a"]) // 16).tolist() for row in shards) else (0.0, 1.0, 1.0)

    for (v, w), c in c2.items():
        held, back, over = looked_up(v, w)
        assert over == m.STRENGTH + c1[v]
        assert abs(held - (1 - py.d)) < 1e-6 if c == 1 else c - py.d * c - 1e-5 <= held <= c - py.d + 1e-5
    assert looked_up(int(m.END), 12345 << 16)[0] == 0
    for v in {v for v, _ in c2}:  # a context's dishes and what it leaves to its parent add up
        mine = [looked_up(v, w) for x, w in c2 if x == v]
        assert abs(sum(x[0] for x in mine) / mine[0][2] + mine[0][1] - 1) < 1e-4
    prior = {}
    for row in py.parent.collect():
        h = np.sort(np.concatenate([np.frombuffer(x["a"], np.uint64) for x in py.words.where(F.col("key") == row["key"]).collect()]))
        prior |= dict(zip(h.tolist(), py.predict(np.frombuffer(row["a"], np.int64), np.frombuffer(row["b"], np.float32)).tolist()))
    unseen = float(py.predict(np.zeros(1), np.zeros(1))[0])
    assert abs(sum(prior.values()) + unseen - 1) < 1e-6

    def logp(t):
        total, before = 0.0, int(m.END)
        for w in tok(t):
            held, back, over = looked_up(before, w)
            total += math.log10(held / over + back * prior.get(w, unseen))
            before = w
        return total

    assert len(out) == len(rows)
    got, want = sorted((str(x.doc_id), x.score) for x in out), sorted((str(i), logp(t)) for i, t in rows)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 for a, b in zip(got, want))


def row_frame(row):
    import pandas as pd

    return pd.DataFrame([row.asDict()])


def test_seating_follows_the_exact_distribution():
    """Draws against an enumeration of all seatings."""
    d, others, p0 = 0.6, 2.5, 0.3

    def seatings(c):
        ways = [((1,), others * p0)]
        for _ in range(c - 1):
            ways = [x for tables, w in ways for x in [*((tuple(n + (j == k) for j, n in enumerate(tables)), w * (tables[k] - d)) for k in range(len(tables))), (tables + (1,), w * (others + d * len(tables)) * p0)]]
        return ways

    for c in (2, 3, 5):
        weight = collections.Counter()
        for tables, w in seatings(c):
            weight[len(tables)] += w
        total = sum(weight.values())
        t = seat(np.full(40000, c), np.full(40000, p0), np.full(40000, others), d, np.random.default_rng(c))
        for k in range(1, c + 1):
            assert abs((t == k).mean() - weight[k] / total) < 0.012
        t = seat_alike(np.full(40000, c), p0, others, d, np.random.default_rng(c + 50))
        assert all(abs((t == k).mean() - weight[k] / total) < 0.012 for k in range(1, c + 1))
    assert np.isclose(np.exp(log_stirling(0.5)[3, 1]), 0.5 * 1.5)
    big = seat(np.array([500, 70, 1, 0]), np.full(4, 0.01), np.full(4, 5.0), d, np.random.default_rng(1))
    assert 1 <= big[0] <= 500 and 1 <= big[1] <= 70 and big[2] == 1 and big[3] == 0
    mean, last = sweep(np.array([0, 0, 1]), 2, np.array([4, 9, 2]), np.array([3.0, 0.0]), np.full(3, 0.1), d, 1.0, np.random.default_rng(2), 6, 2)
    assert (mean >= 1).all() and (mean <= [4, 9, 2]).all() and (last >= 1).all()


def test_edge_rows_have_results(spark, edge):
    b = spark.createDataFrame([(1, "some item text that is long enough to match")], "item_id long, text string")
    empty = edge.limit(0)
    for f in (line_verdicts, ngram_join, lm_score, lambda d: decontaminate(d, b), lambda d: mixing(fit(d))):
        assert f(edge).count() == edge.count()
        assert f(empty).count() == 0
    assert dedup_lines(empty).count() == 0


def test_nested_sets_of_one_family(docs):
    """Texts that each add a word: a deep tree, and one component."""
    words = [f"w{k}" for k in range(2600)]
    sets = [np.arange(600 + k) for k in range(2000)]
    got = meet(list(range(2000)), sets, [len(s) for s in sets], list(range(2000)), [0] * 2000, 85)
    root = list(range(2000))
    for a, b in got:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if x == old else x for x in root]
    assert set(root) == {0} and len(got) == 1999
    texts = [" ".join(words[: 300 + k]) for k in range(120)]
    assert {x.component_id for x in ngram_join(docs(list(enumerate(texts)))).collect()} == {0}


def test_ngrams_that_most_texts_have(docs, monkeypatch):
    import lodestone.llm.ngram_join as m

    monkeypatch.setattr(m, "HOT", 20)
    monkeypatch.setattr(m, "BUCKET", 60)
    r = random.Random(21)
    common = "all of these texts begin with one and the same passage of words"
    texts = [common + " " + " ".join(f"x{r.randrange(30)}" for _ in range(r.choice([3, 40]))) for _ in range(70)]
    texts += [t.replace("same", "other", 1) for t in texts[:20]] + texts[:10]
    got = {x.doc_id: x.component_id for x in ngram_join(docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)[0]


def test_components_of_hubs_and_giants(spark, monkeypatch):
    import lodestone.llm.components as m

    monkeypatch.setattr(m, "SPLIT", 8)
    for small in (0, 1000):
        monkeypatch.setattr(m, "SMALL", small)
        edges = [(500, i) for i in range(100, 160)] + [(i, i + 1) for i in range(160, 200)] + [(160, 159), (3, 500), (900, 901)]
        got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got.pop(900) == got.pop(901) == 900 and set(got.values()) == {3} and len(got) == 103


def test_reserved_names_are_kept(spark):
    """Columns of the names that the operators use inside stay as they are."""
    schema = "doc_id long, text string, lang string, source string, kept_id string, kept_places string, short string, _short string, key string, line string"
    rows = [(1, "a line of some length that is there twice\nand one more line", "en", "s", *"123456"), (2, "a line of some length that is there twice\nsomething else", None, None, *"abcdef"), (None, None, "en", "s", *"uvwxyz")]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r for r in dedup_lines(df, min_chars=1).collect()}
    assert got[2].text == "something else" and tuple(got[2])[4:] == tuple("abcdef") and got[None].text is None
    assert got[1].asDict().keys() == set(df.columns)
    more = df.withColumns({n: F.lit(n) for n in ("source_cell", "lang_cell", "topic_cell", "token_weight", "probability", "found", "same", "cls", "tokens")})
    for out in (sample(more, fit(more, budget=1.0)), first_of_groups(more)):
        assert out.columns == more.columns and all(r.found == "found" and r.cls == "cls" for r in out.collect()) and out.count() == 3


def test_one_row_of_each_group(docs):
    r = random.Random(51)
    base = [[f"w{r.randrange(200)}" for _ in range(50)] for _ in range(6)]
    near = lambda k: " ".join([*base[k][:25], f"z{r.randrange(9)}", *base[k][26:]])
    texts = [(i, near(i % 6)) for i in range(30)] + [(3, near(0)), (3, near(0)), (None, near(1)), (None, "only here " * 9), (None, "only here " * 9), (None, None), (None, None), (70, ""), (71, "x"), (71, "x")]
    kept = first_of_groups(docs(texts), 60, 5).collect()
    ids = [x.doc_id for x in kept]
    assert sorted(str(i) for i in ids) == sorted(map(str, [0, 1, 2, 3, 4, 5, 70, 71, None, None, None]))
    plain = first_of_groups(docs(texts[:30]), 60, 5)
    assert sorted(x.doc_id for x in plain.collect()) == [0, 1, 2, 3, 4, 5]
