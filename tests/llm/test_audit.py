import random
import re
from collections import Counter
from itertools import permutations

from tessella.llm import audit


def brute(docs, labels):
    """Every order walked document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    fails, parts = [], []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        own += "E" * any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append(own)
        parts.append(lang or "")
    out = {}
    for part in set(parts):
        here = [(f, d[0]) for f, p, d in zip(fails, parts, docs, strict=True) if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                redundant = sum(f in x and any(g in x for g in order[: step - 1]) for x, _ in here)
                out[part, order, step] = [len(left), len(gone), redundant, sum(x == f for x, _ in here), sum(i in good for _, i in gone), sum(i in bad for _, i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def check(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    got = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got}
    assert len(found) == len(got) and found == brute(docs, labels)


def test_against_brute_force(spark):
    rng = random.Random(5)
    pieces = ["word", "other", "Many", "UPPER", "#tag", "a|b", "\t", "\n", "é", *(f"w{i}" for i in range(400))]
    docs = [(i, " ".join(rng.choices(pieces, k=rng.choice([0, 3, 190, 199, 200, 210, 400]))), rng.choice(["en", "de", None])) for i in range(120)]
    docs += [(200 + i, docs[i % 7][1], "en") for i in range(40)] + [(300, None, None), (301, "", "en"), (302, " \n\t ", "en"), (None, docs[3][1], "en"), (None, docs[3][1], "en"), docs[5], docs[5]]
    docs += [(400, " ".join(f"u{i}" for i in range(30_000)), "fr"), (401, "same " * 20_000, "fr")]
    labels = [(i, rng.randrange(2), rng.choice([0, 1, None])) for i in range(0, 180, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    check(spark, docs, labels)


def test_one_text_on_a_third_of_all_rows(spark):
    docs = [(i, f"own {i}" if i % 3 else "the same text", "en") for i in range(600)]
    check(spark, docs, [])


def test_many_texts_none_of_them_hot(spark, monkeypatch):
    monkeypatch.setattr(audit, "HOT_SHARE", 2)
    check(spark, [(i, f"own {i % 40}", "en") for i in range(200)], [(3, 1, 0)])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_all_orders_and_steps_stand_for_each_part(spark):
    docs = spark.createDataFrame([(1, "x", "en"), (2, "y", None)], "doc_id long, text string, lang string")
    got = audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.count() == 2 * 600 and got.where("kept = 1 and removed = 0 and step = 1").count() == 2 * 24 * 4
