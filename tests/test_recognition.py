import numpy as np

from tessella.operators import recognition


def test_generator_and_planes():
    def plain(seed, n):
        out, m = [], (1 << 64) - 1
        for _ in range(n):
            seed = (seed + 0x9E3779B97F4A7C15) & m
            z = ((seed ^ (seed >> 30)) * 0xBF58476D1CE4E5B9) & m
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
            out.append(z ^ (z >> 31))
        return out

    assert recognition.splitmix64(42, 9).tolist() == plain(42, 9)
    g = recognition.gaussian_planes(8, 16, 3)
    assert g.shape == (8, 16) and np.allclose((g**2).sum(axis=0), 1, atol=1e-5)
    u = recognition.uniform_planes(8, 16, 3)
    assert u.min() >= -1 and u.max() < 1


def test_recognition(spark):
    templates = np.array([[1, 0, 0, 0], [1, 1, 0, 0], [0, 0, 1, 0]], float)
    rows = [(0, [5, 0, 0, 0]), (1, [0, 0, -4, 0]), (2, [0, 0, 0, 9]), (3, [0, 0, 0, 0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<int>")
    got = {r.id: r for r in recognition.recognize_orthogonal(df, templates, "vec_id", "v").collect()}
    assert (got[0].best, got[0].score, got[0].novel) == (0, 5.0, False)
    assert (got[1].best, got[1].score, got[1].novel) == (2, -4.0, False)
    assert got[2].novel and got[2].residual == 1.0 and got[3].novel
    planes = recognition.gaussian_planes(4, 64, 1)
    prints = recognition.project(df.where("vec_id < 2"), planes, "vec_id", "v", msb_first=True)
    codes = [np.packbits(np.array(v, np.float32) @ planes >= 0).tobytes() for _, v in rows[:2]]
    best = {r.id: (r.best, r.score) for r in recognition.recognize_hamming(prints, codes).collect()}
    assert best == {0: (0, 1.0), 1: (1, 1.0)}
