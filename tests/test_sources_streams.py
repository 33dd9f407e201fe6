
import pytest
from pyspark.sql import functions as F

from tessella.functions import bits, vectors
from tessella.functions.register import register_all
from tessella.sources import graphs, records
from tessella.streaming import shift


def test_records_round_trip_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(bytes([i] * 16),) * 4 for i in range(3)], "meta binary, cam binary, btree binary, embed binary")
    path = str(tmp_path / "r")
    records.write_records(df, path, 16)
    records.append_records(df, path, 16)
    assert records.read_records(spark, path).count() == 6
    with pytest.raises(Exception, match="already exists"):
        records.write_records(df, path, 16)
    with pytest.raises(Exception, match="16 bytes"):
        records.write_records(df.withColumn("cam", F.lit(b"x")), str(tmp_path / "s"), 16)
    word = df.select(records.words("meta", 2).alias("w")).collect()
    assert word[1].w == [int.from_bytes(bytes([1] * 8), "little")] * 2


def test_script(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("// comment\nMERGE (a:Agent {name: 'Ada', rank: 3})\nCREATE (a:Agent)-[:KNOWS {since: 2020}]->(b:Agent)\n")
    lines = graphs.script_lines(spark, str(p))
    assert {r.verb: r.n for r in graphs.verbs(lines).collect()} == {"MERGE": 1, "CREATE": 1}
    assert graphs.nodes(lines).where("alias = 'a' and size(properties) > 0").first().properties == {"name": "Ada", "rank": "3"}
    e = graphs.edges(lines).first()
    assert (e.src, e.relation, e.dst, e.properties) == ("a", "KNOWS", "b", {"since": "2020"})


def test_binary_functions(spark):
    register_all(spark)
    df = spark.createDataFrame([(b"\x0f\x01", b"\x00\x01"), (b"", b""), (None, b"a")], "a binary, b binary")
    got = df.selectExpr("bin_hamming(a, b) h", "bin_popcount(a) p", "bin_similarity(a, b) s", "bin_xor_bind(a, b) x").collect()
    assert [tuple(r) for r in got] == [(4, 5, 0.75, bytearray(b"\x0f\x00")), (0, 0, 1.0, bytearray(b"")), (None, None, None, None)]


def test_edges_of_array_functions(spark):
    one = spark.range(1)
    empty = F.array().cast("array<double>")
    r = one.select(vectors.mean(empty).alias("m"), vectors.var(empty).alias("v"), vectors.dot(empty, empty).alias("d"), vectors.cosine(vectors.zeros(3), vectors.ones(3)).alias("c"), vectors.div(vectors.ones(2), vectors.zeros(2)).alias("q")).first()
    assert r.m != r.m and (r.v, r.d, r.c) == (0.0, 0.0, 0.0) and r.q == [float("inf")] * 2
    for bad in (vectors.add(vectors.ones(2), vectors.ones(3)), vectors.log(vectors.zeros(1)), vectors.top_k(vectors.ones(2), 3), vectors.item(vectors.ones(2))):
        with pytest.raises(Exception):  # noqa: B017
            one.select(bad).collect()
    wide = bits.literal([(1 << 64) - 1, 1])
    assert one.select(bits.popcount(wide)).first()[0] == 65
    back = bits.permute(bits.permute(wide, 70, 2), 58, 2)
    assert one.select(bits.hamming(back, wide)).first()[0] == 0


def test_soak_and_normalize_streams(spark, tmp_path):
    rows = [(i, f"k{i % 2}", float(i)) for i in range(40)]
    schema = "t long, k string, v double"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    out = shift.run_available(shift.soak(stream, "k", "t", "v"), "update", str(tmp_path / "c1"))
    assert {(r.k, r.level, r.n) for r in out.collect()} == {("k0", 127, 20), ("k1", 127, 20)}
    out = shift.run_available(shift.normalize(stream, "k", "t", "v"), "append", str(tmp_path / "c2"))
    assert out.count() == 40
