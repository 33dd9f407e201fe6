"""Language ID and toxicity: held-out accuracy and edge cases; mixing against brute force."""

import random
import zlib
from collections import defaultdict
from hashlib import md5

import numpy as np

from tessella.llm import langid, mixing, toxicity

SYLLABLES = {"aa": ["ka", "lo", "mi", "tan", "re"], "bb": ["sch", "ung", "er", "ö", "ke"], "cc": ["que", "ón", "ado", "el", "z"]}


def word(rng, lang):
    return "".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4)))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join(word(rng, lang) for _ in range(rng.randrange(12, 200))), lang, "x"))
    rows += [(900, None, "aa", "x"), (901, "123 --", "bb", "x"), (902, "", None, "x"), (903, rows[0][1], None, "x"), (903, rows[0][1], None, "x"), (904, "kalo mitan " * 9000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_best string")
    found = langid.identify(docs, langid.learn(docs)).collect()
    assert len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    test = [(r[0], r[2]) for r in rows[:300] if held(r[0])]
    assert sum(by[i][0].lang_best == lang for i, lang in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 for r in found)
    assert all(by[i][0].lang_best == "und" and by[i][0].score == 0 for i in (900, 901, 902))
    assert [r.lang_best for r in by[903]] == [rows[0][2]] * 2 and by[904][0].lang_best == "aa"
    nothing = langid.identify(docs, langid.learn(docs.limit(0)))
    assert {r.lang_best for r in nothing.collect()} == {"und"}


def test_language_sample_of_copies_and_odd_lengths(spark):
    rng = random.Random(3)
    ids = [i for i in range(3000) if not held(i)]
    text = lambda lang, n: " ".join(word(rng, lang) for _ in range(n))
    few = [text("aa", 40) for _ in range(12)]
    # Every text of aa stands 150 times, bb has short texts only, cc long ones only.
    rows = [(ids[k], few[k % 12], "aa") for k in range(1800)] + [(ids[1800 + k], text("bb", 4), "bb") for k in range(30)] + [(ids[1900 + k], text("cc", 2500), "cc") for k in range(20)]
    assert all(len(t) < 40 if c == "bb" else len(t) > 4000 for _, t, c in rows if c != "aa")
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    by = dict(zip(learned.names, learned.texts, strict=True))
    assert all(langid.letters(t).encode() in by["aa"] for t in few) and len(by["bb"]) > 200 and len(by["cc"]) > 4000


def test_toxicity(spark):
    rng = random.Random(2)
    bad, rows, labels = ["vile", "rotten", "snarlo", "snarlix", "snarlum"], [], []
    for i in range(700):
        words, toxic = [word(rng, "aa") for _ in range(rng.randrange(5, 80))], int(rng.random() < 0.3)
        for _ in range(toxic * rng.randrange(1, 5)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, 1, toxic))
    rows += [(990, "", 0.0), (991, None, 0.0), (992, "9 9", 0.0), (993, "kalo. Vile!", 0.0), (994, "mi " * 30000 + "rotten", 0.0), (993, "kalo. Vile!", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    table = spark.createDataFrame([*labels, (5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, table)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    test = [(i, t) for i, _, t in labels if held(i)]
    assert sum((got[i].score >= 0.5) == bool(t) for i, t in test) >= 0.97 * len(test)
    assert max(got[i].score for i in (990, 991, 992)) < 0.5 and got[994].score >= 0.5
    assert [(s.start, s.stop) for s in got[993].spans] == [(6, 10)]
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if r.score < 0.5}
    blank = toxicity.learn(docs, table.limit(0))
    assert {r.score < 0.51 for r in toxicity.score(docs, blank).collect()} == {True}


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    e, step, start = rng.normal(size=5), rng.normal(size=(2, 2)), 0.3
    weights = {}
    for n in range(32):
        path = [n >> t & 1 for t in range(5)]
        s = start * path[0] + sum(e[t] * path[t] for t in range(5)) + sum(step[path[t], path[t + 1]] for t in range(4))
        weights[n] = np.exp(s)
    z = sum(weights.values())
    want = [sum(w for n, w in weights.items() if n >> t & 1) / z for t in range(5)]
    got, moves, log_z = toxicity.forward_backward(np.stack([e, np.append(e[:3], [9, 9])], axis=1), np.array([5, 3]), step, start)
    assert np.allclose(got[:, 0], want) and np.isclose(moves.sum(), 4 + 2)
    assert log_z > np.log(z)


def water_fill(total, children):
    """children: name -> (cap, weight). Whole shares by rounds: who cannot use a share takes the cap and
    leaves the rest to the others; tokens lost by rounding go to the largest fractions."""
    out, left = {n: 0 for n, (cap, wt) in children.items() if not wt or not cap}, total
    open_ = {n: x for n, x in children.items() if n not in out}
    while open_:
        w = sum(x[1] for x in open_.values())
        full = {n for n, (cap, wt) in open_.items() if cap * w <= left * wt}
        if not full:
            exact = {n: left * wt / w for n, (_, wt) in open_.items()}
            shares = {n: int(x) for n, x in exact.items()}
            for n in sorted(exact, key=lambda n: (shares[n] - exact[n], n))[: left - sum(shares.values())]:
                shares[n] += 1
            return out | shares
        # The least ratio first, as the running sums do.
        n = min(full, key=lambda x: (open_[x][0] / open_[x][1], x))
        out[n], left = open_[n][0], left - open_[n][0]
        del open_[n]
    return out


def test_a_budget_under_a_node_of_weight_zero_goes_to_others(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 100), ("d0", "en", "z", 900), ("d1", "en", "b", 1000)], "__domain string, __lang string, __source string, tokens long")
    weights = spark.createDataFrame([(2, "z", 0.0)], "level int, name string, weight double")
    deal = lambda total: {r["__source"]: r.budget for r in mixing.budgets(leaves, total, weights=weights, max_epochs=1).collect()}
    assert deal(1000) == {"a": 100, "z": 0, "b": 900} and deal(5000) == {"a": 100, "z": 0, "b": 1000} and deal(151) == {"a": 76, "z": 0, "b": 75}


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["en", "de", None]), rng.choice(["s0"] * 4 + [f"s{k}" for k in range(1, 8)])) for i in range(400)]
    clash = "epoch int, whole int, edge string, budget long, remain long, cut string, rank string"
    docs = spark.createDataFrame([(*r, 1, 2, "e", 3, 4, "c", "r") for r in rows], f"doc_id long, text string, lang string, source string, {clash}")
    weights = {(0, "d1"): 3.0, (0, "d2"): 0.5, (1, "en"): 4.0, (2, "s0"): 2.0, (2, "s3"): 0.0}
    cases = [(0.5, 2, {}, 1 << 20), (1.4, 2, {}, 5), (3.0, 2, {}, 1 << 20), (0.3, 1, {}, 1), (0.5, 2, weights, 1 << 20), (1.7, 2, weights, 3)]
    for fraction, epochs, w, fine in cases:
        named = spark.createDataFrame([(*k, v) for k, v in w.items()], "level int, name string, weight double") if w else None
        taken = mixing.mix(docs, mixing.plan(docs, fraction, epochs, weights=named, buckets_hex=1, fine_rows=fine)).collect()
        assert all((r.whole, r.edge, r.budget, r.remain, r.cut, r["rank"]) == (2, "e", 3, 4, "c", "r") for r in taken)
        leaves = defaultdict(list)
        for i, t, lang, source in rows:
            d = f"d{int(md5(source.encode()).hexdigest()[0], 16) % 4}"
            leaves[d, lang or "", source].append((i, len(t.split())))
        tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
        total = min(int(sum(tokens.values()) * fraction), epochs * sum(tokens.values()))
        cap = {k: epochs * v * all(w.get((j, k[j]), 1.0) > 0 for j in range(3)) for k, v in tokens.items()}
        budget = {(): min(total, sum(cap.values()))}
        for depth in range(3):
            for node in [k for k in budget if len(k) == depth]:
                below = sorted({k[: depth + 1] for k in tokens if k[:depth] == node})
                caps = {n: (sum(cap[k] for k in tokens if k[: depth + 1] == n), w.get((depth, n[-1]), 1.0)) for n in below}
                budget |= water_fill(budget[node], caps)
        assert sum(v for k, v in budget.items() if len(k) == 3) == budget[()]
        want = []
        for leaf, docs_ in leaves.items():
            if not tokens[leaf]:
                continue
            whole, rest = divmod(budget[leaf], tokens[leaf])
            want += [(i, e) for i, _ in docs_ for e in range(whole)]
            for i, n in sorted(docs_, key=lambda x: md5(f"7:{whole}:{x[0]}".encode()).hexdigest()):
                if n > rest:
                    break
                rest -= n
                want.append((i, whole))
        assert sorted((r.doc_id, r.epoch) for r in taken) == sorted(want), (fraction, epochs, w)
    assert mixing.mix(docs.limit(0), mixing.plan(docs.limit(0))).collect() == []


def test_of_several_texts_under_one_id_one_is_learned_whatever_the_order(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(i % 40, " ".join(random.Random(i).choices(words, k=30)) + (" bad slur" if i % 40 % 4 == 0 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    models = []
    for parts, order in ((1, rows), (7, rows[::-1])):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        models.append(toxicity.learn(docs, labels, min_docs=2, min_contexts=1, purity=2))
    a, b = models
    assert a.words == b.words and np.array_equal(a.weight, b.weight) and np.array_equal(a.blend, b.blend)
