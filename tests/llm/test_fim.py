import hashlib
import random
import re

import pytest

from tessella.llm import fim


def brute(doc_id, text, seed=7, rate=100, spm=50):
    text, digest = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    a, b, z = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(m in text for m in fim.SENTINELS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{z}<M>{b}"


def texts():
    rng = random.Random(3)
    some = ["".join(rng.choice("ab\n\n é\U0001f600<PS>") for _ in range(rng.randrange(40))) for _ in range(300)]
    return [None, "", "\n", "\n\n\n", "no end", "x<P>y\nz", "<S>", "a<", "<\n>P<\nS>", "\r\n\r\n", "ends in <P", "\n".join(f"line {i}" for i in range(20_000)), "w" * 100_000, *some]


@pytest.mark.parametrize("how", [{}, {"seed": 11, "rate": 60, "spm": 20}])
def test_against_brute_force(spark, how):
    rows = list(enumerate(texts())) + [(None, "a\nb\nc"), (None, None), (5, "another text\nunder 5"), (11, texts()[11]), (11, texts()[11])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fim.restore(fim.transform(docs, **how)).collect()
    want = [(i, *brute(i, t, **how), t or "") for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_sentinels_that_overlap_are_refused(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    for bad in (("", "<S>", "<M>"), ("<>", "<S", "S<"), ("aa", "b", "c"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            fim.transform(docs, sentinels=bad)
    assert fim.transform(docs, sentinels=("[pre]", "[suf]", "[mid]")).collect() == []


def test_other_sentinels(spark):
    docs = spark.createDataFrame([(i, "a.\nb*\n(c)") for i in range(20)], "doc_id long, text string")
    marks = ("(*", "[+", ".?")
    assert all(r.restored == "a.\nb*\n(c)" for r in fim.restore(fim.transform(docs, sentinels=marks), marks).collect())
