import random
import time

from tessella.llm import linededup


def words(line):
    return len(line.split())


def brute(docs, least):
    """For every pair of places, every run of equal lines with enough words that do not overlap: the later goes."""
    places = [(i, k, line.strip(" \t\n\x0b\x0c\r")) for i, (_, t) in enumerate(docs) for k, line in enumerate((t or "").split("\n"))]
    rows = {}
    for i, _, line in places:
        rows.setdefault(i, [])
    for i, k, line in places:
        if line:
            rows[i].append((k, line))
    gone = {i: set() for i in rows}
    flat = [(i, k) for i in rows for k in range(len(rows[i]))]
    for x, (i, p) in enumerate(flat):
        for j, q in flat[:x]:
            size = 0
            room = p - q if i == j else len(rows[j])
            while size < room and p + size < len(rows[i]) and q + size < len(rows[j]) and rows[i][p + size][1] == rows[j][q + size][1]:
                size += 1
            if size and sum(words(line) for _, line in rows[i][p : p + size]) >= least:
                gone[i].update(k for k, _ in rows[i][p : p + size])
    return ["\n".join(line for k, line in enumerate((t or "").split("\n")) if k not in gone[i]) if gone[i] else t for i, (_, t) in enumerate(docs)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    for least in (4, 9):
        pool = [" ".join(rng.choices("abcdef", k=rng.randrange(1, 6))) for _ in range(14)] + ["", "  "]
        docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(0, 25)))) for i in range(14)]
        docs += [(20, docs[3][1]), (21, docs[3][1] + "\nend of it"), (22, None), (23, ""), (24, "a\na\na\na\na\na\na\na\na\na\na\na")]
        df = spark.createDataFrame([(i, t, 7, "z") for i, t in docs], "doc_id long, text string, n_chars long, k string").repartition(3)
        got = {r.doc_id: r for r in linededup.dedup(df, least).collect()}
        want = brute(docs, least)
        assert [got[i].text for i, _ in docs] == want
        assert all(r.n_chars == len(r.text or "") and r.k == "z" for r in got.values())
        assert all(got[i].n_removed == len([x for x in (t or "").split("\n") if x.strip()]) - len([x for x in (w or "").split("\n") if x.strip()]) for (i, t), w in zip(docs, want, strict=True))


def test_clean_repeated_and_empty(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, line), (1, line), (2, "other\n" + line), (None, "x " + line)]
    got = sorted((str(r.doc_id), r.text) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", line), ("1", line), ("2", "other"), ("None", "x " + line)]
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_copies_on_the_spot_leave_one_whole(spark):
    """Lines that repeat in place keep the first 50 words; with two lines in turn, both first copies."""
    ten, other = " ".join("abcdefghij"), " ".join("klmnopqrst")
    docs = [(1, "\n".join([ten] * 60)), (2, "\n".join([ten, other] * 30)), (3, "new words\n" + "\n".join([other] * 12))]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, n int, gone string, k int")
    got = {r.doc_id: r for r in linededup.dedup(df).collect()}
    assert got[1].text == "\n".join([ten] * 5) and got[1].n_removed == 55
    assert got[2].text == "\n".join([ten, other] * 3)
    assert got[3].text == "new words\n" + "\n".join([other] * 5)
    assert [got[i].text for i, _ in docs] == brute(docs, 50)
    assert (got[1].n, got[1].gone, got[1].k) == (1, "x", 2)


def test_texts_of_two_hundred_thousand_lines_in_seconds(spark):
    """All lines repeat, within a text and across two; one pass over them, not one for each lost line."""
    lines = [f"w{i % 50_000} and x{i % 777}" for i in range(200_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*lines[100:150_000], "its own end"])), (3, "short")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in linededup.dedup(docs).collect()}
    assert time.perf_counter() - began < 90
    assert got[2].text == "its own end" and got[2].n_removed == 149_900 and got[3].text == "short" and got[1].n_removed == 0


def test_no_table_goes_through_the_driver(spark, monkeypatch):
    """Every join is by sorting: a small file can hold many rows, and copies that a generator makes are in no estimate."""
    plans, write = {}, linededup.materialize
    monkeypatch.setattr(linededup, "materialize", lambda df, label: (plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()), write(df, label))[1])
    text = "\n".join(f"a{i} b" for i in range(6))
    docs = spark.createDataFrame([(1, text), (2, text + "\nend"), (3, None)], "doc_id long, text string")
    out = linededup.dedup(docs, 12)
    assert {r.doc_id: r.text for r in out.collect()} == {1: text, 2: "end", 3: None}
    plans["result"] = out._jdf.queryExecution().executedPlan().toString()
    assert {"line-live", "line-ranks", "line-found", "line-gone"} <= {*plans}
    assert [k for k, plan in plans.items() if "Broadcast" in plan] == []
    assert all("SortMergeJoin" in plans[k] for k in ("line-live", "line-ranks", "line-found", "line-gone", "result"))
