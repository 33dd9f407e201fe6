"""The write log against a plain loop: killed writers, repeated batches, snapshots."""

import random

import duckdb
import pytest

from tessella.operators import _versions, writelog

RNG = random.Random(3)
TEMPLATES = [[RNG.randrange(-7, 8) for _ in range(24)] for _ in range(5)]
SCHEMA = "key string, seq long, concept int, amplitude double"


def plain(rows, channels=4, rate=0.1, decay=100):
    """rows in order: (key, concept, amplitude). Every step by lists."""
    free, taken = [list(map(float, t)) for t in TEMPLATES], [[0.0] * 5 for _ in range(5)]
    for c in range(5):
        for i in range(5):
            if i != c:
                taken[c][i] = sum(a * b for a, b in zip(free[c], TEMPLATES[i], strict=True)) / sum(x * x for x in TEMPLATES[i])
                free[c] = [a - taken[c][i] * b for a, b in zip(free[c], TEMPLATES[i], strict=True)]
    out = {}
    for key, concept, amplitude in rows:
        s = out.setdefault(key, {"cells": [0] * 24, "co": [0.0] * 5, "n": [0] * 5, "last": [0] * 5, "clock": 0, "absorbed": []})
        s["clock"] += 1
        s["n"][concept] += 1
        s["last"][concept] = s["clock"]
        curve = lambda n: next((v for upto, v in ((2, 0.5), (5, 0.8), (20, 1.0), (50, 0.5), (200, 0.2)) if n <= upto), 0.1)
        p = [0.3 if s["clock"] - last > decay else curve(n) for n, last in zip(s["n"], s["last"], strict=True)]
        a, got, full = amplitude * p[concept], 0.0, 0.0
        for j in range(concept % channels, 24, channels):
            w = a * free[concept][j]
            r = w * (1 - abs(s["cells"][j]) / 127)
            x = s["cells"][j] + r
            s["cells"][j] = max(-128, min(127, int(x + (0.5 if x >= 0 else -0.5))))
            got, full = got + abs(r), full + abs(w)
        share = got / full if full > 1e-10 else 1.0
        s["absorbed"].append(share)
        for i in range(5):
            s["co"][i] += a * share if i == concept else rate * p[i] * taken[concept][i]
    return out


def same(states, want):
    got = {r.key: r for r in states.collect()}
    assert got.keys() == want.keys()
    for k, s in want.items():
        assert (list(got[k].cells), list(got[k].counts), list(got[k].last), got[k].clock) == (s["cells"], s["n"], s["last"], s["clock"])
        assert max(abs(a - b) for a, b in zip(got[k].coefficients, s["co"], strict=True)) < 1e-9


def batch(spark, rows):
    return spark.createDataFrame([(k, i, c, a) for i, (k, c, a) in enumerate(rows)], SCHEMA).repartition(3)


def test_replay_snapshot_and_killed_writers(spark, tmp_path, monkeypatch):
    rng, path = random.Random(1), f"{tmp_path}/log"
    parts = [[(rng.choice("abc"), rng.randrange(5), rng.choice([0.5, 1.0, 9.0])) for _ in range(60)] for _ in range(4)]
    assert writelog.append(batch(spark, parts[0]), path, "w1", 0) == 1
    assert writelog.append(batch(spark, parts[1]), path, "w2", 0) == 2
    assert writelog.append(batch(spark, parts[1]), path, "w2", 0) == 2  # sent again
    # A writer that is killed after its rows are written and before its manifest is.
    real = _versions.commit
    monkeypatch.setattr(_versions, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        writelog.append(batch(spark, parts[2]), path, "w1", 1)
    monkeypatch.setattr(_versions, "commit", real)
    same(writelog.replay(spark, path, TEMPLATES), plain(parts[0] + parts[1]))
    # It starts again; another writer comes in between its reading and its commit.
    def late(spark_, path_, before, manifest):
        monkeypatch.setattr(_versions, "commit", real)
        writelog.append(batch(spark, parts[3]), path, "w3", 7)
        return real(spark_, path_, before, manifest)
    monkeypatch.setattr(_versions, "commit", late)
    assert writelog.append(batch(spark, parts[2]), path, "w1", 1) == 4
    everything = parts[0] + parts[1] + parts[3] + parts[2]
    want = plain(everything)
    same(writelog.replay(spark, path, TEMPLATES), want)
    each = writelog.replay(spark, path, TEMPLATES, each=True)
    found = {}
    for r in sorted(each.collect(), key=lambda r: r.clock):
        found.setdefault(r.key, []).append(r.absorption)
    assert all(max(abs(a - b) for a, b in zip(found[k], s["absorbed"], strict=True)) < 1e-9 for k, s in want.items())
    # From a snapshot on: nothing differs, old versions neither, and old batches are still known.
    assert writelog.compact(spark, path, TEMPLATES) == 5 and writelog.writes(spark, path) is None
    same(writelog.replay(spark, path, TEMPLATES), want)
    assert writelog.append(batch(spark, parts[0]), path, "w1", 1) == 5
    more = [("a", 1, 2.0), ("new", 4, 1.0)] * 9
    writelog.append(batch(spark, more), path, "w1", 2)
    same(writelog.replay(spark, path, TEMPLATES), plain(everything + more))
    same(writelog.replay(spark, path, TEMPLATES, version=2), plain(parts[0] + parts[1]))


def test_plasticity_actions_and_residual(spark, tmp_path):
    rng, path = random.Random(2), f"{tmp_path}/log"
    rows = [("k", 0 if i % 3 else 1, 6.0) for i in range(260)] + [("other", rng.randrange(5), 1.0) for _ in range(9)] + [("k", 3, 1.0)] * 30
    writelog.append(batch(spark, rows + [("k", 9, 1.0), ("k", None, 1.0), (None, 1, 1.0), ("k", 1, None)]), path, "w", 0)
    want = plain(rows)
    states = writelog.replay(spark, path, TEMPLATES)
    same(states, want)  # unknown concepts and nulls are left out
    told = writelog.with_plasticity(writelog.writes(spark, path).where("key = 'k' and concept = 0")).collect()
    assert sorted((r["count"], r.plasticity) for r in told)[::40] == [(n, 0.5 if n <= 2 else 1.0 if n <= 20 else 0.5 if n <= 50 else 0.2) for n in range(1, len(told) + 1, 40)]
    actions = writelog.absorption_actions(writelog.replay(spark, path, TEMPLATES, each=True), 8).where("key = 'k'").collect()
    for r in actions:
        last = want["k"]["absorbed"][max(0, r.clock - 8) : r.clock]
        low, mean = min(last), sum(last) / len(last)
        assert r.action == ("emergency" if low < 0.1 else "hard" if mean < 0.4 else "soft" if mean < 0.7 else "none")
    assert len({r.action for r in actions}) > 1
    # The residual by SQL.
    s, t = states.toPandas(), [(c, p, x) for c, v in enumerate(TEMPLATES) for p, x in enumerate(v)]
    duck = duckdb.connect()
    duck.sql("CREATE TABLE t (concept INT, p INT, x DOUBLE)")
    duck.executemany("INSERT INTO t VALUES (?, ?, ?)", t)
    duck.register("s", s)
    sql = duck.sql("""WITH c AS (SELECT key, unnest(cells) AS cell, generate_subscripts(cells, 1) - 1 AS p FROM s),
      w AS (SELECT key, unnest(coefficients) AS w, generate_subscripts(coefficients, 1) - 1 AS concept FROM s)
      SELECT c.key, c.p, any_value(cell) - coalesce(sum(w * x) FILTER (t.p % 4 = t.concept % 4), 0) FROM c JOIN w USING (key) JOIN t ON t.concept = w.concept AND t.p = c.p GROUP BY ALL""").fetchall()
    got = {(r.key, r.position): r.value for r in writelog.residual(states, TEMPLATES).collect()}
    assert len(got) == len(sql) == 48 and all(abs(got[k, p] - v) < 1e-9 for k, p, v in sql)


def test_empty(spark, tmp_path):
    with pytest.raises(ValueError):
        writelog.replay(spark, f"{tmp_path}/none", TEMPLATES)
    writelog.append(batch(spark, []), f"{tmp_path}/log", "w", 0)
    assert writelog.replay(spark, f"{tmp_path}/log", TEMPLATES).collect() == []
