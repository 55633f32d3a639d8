import pytest
from pyspark.sql import functions as F

from tessera.operators import store as S
from tessera.operators import vector

ROWS = [
    ("1", [0.1, 0.2, 0.3, 0.4], "main.py", "/test/project"), ("2", [0.5, 0.6, 0.7, 0.8], "app.js", "/test/project"), ("3", [0.9, 0.1, 0.2, 0.3], "queries.sql", "/other/project"),
    ("4", None, "x.py", "/test/project"), ("5", [0.0] * 4, "y.py", "/test/project"), ("6", [1.0, 2.0], "z.py", "/test/project"), ("7", [None, 1.0, 1.0, 1.0], "n.py", "/test/project"),
]


@pytest.fixture
def points(spark):
    return spark.createDataFrame(ROWS, "id string, vector array<float>, file_path string, directory string")


def test_topk(points):
    got = vector.topk(points, [0.1, 0.2, 0.3, 0.4], 2).collect()
    assert [r["file_path"] for r in got] == ["main.py", "app.js"] and got[0]["score"] == 1.0
    assert vector.topk(points, [0.1, 0.2, 0.3, 0.4], 9).count() == 3


def test_filters(points):
    q = [0.1, 0.2, 0.3, 0.4]
    assert {r["id"] for r in vector.topk(points, q, 9, where=vector.matches("/test/project")).collect()} == {"1", "2"}
    assert [r["id"] for r in vector.topk(points, q, 9, where=vector.matches(path_contains=".py")).collect()] == ["1"]
    assert vector.topk(points.where("false"), q, 5).count() == 0


def test_repeated_ids(points):
    twice = points.union(points)
    assert vector.topk(twice, [0.1, 0.2, 0.3, 0.4], 2, unique=False).count() == 2


def test_delete(points):
    assert S.delete_where(points, "/test/project", "main.py").count() == 6
    assert S.delete_where(points, "/wrong", "main.py").count() == 7
    assert S.delete_where(points, "/other/project").count() == 6
    assert S.stats(points, 4).first()["total_points"] == 7
    assert S.is_indexed(points, "/other/project") and not S.is_indexed(points, "/none")


def test_latest_and_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    got = S.upsert(old, S.latest(new, ["k"], [F.col("v")]), ["k"])
    assert {(r["k"], r["v"]) for r in got.collect()} == {("a", 1), ("b", 3), ("c", 1)}


def test_store(spark, tmp_path):
    st = S.Store(spark, str(tmp_path / "t"))
    assert st.load() is None and not st.exists()
    assert S.ensure(st, 4, "id string, vector array<float>") and not S.ensure(st, 4, "id string, vector array<float>")
    st.write(spark.createDataFrame([("a", [1.0])], "id string, vector array<float>"))
    st.write(st.read().union(st.read()))
    assert st.read().count() == 2 and st.state()["properties"]["dim"] == 4
    st.clean(1)
    assert st.read().count() == 2
    assert S.ensure(st, 8, "id string, vector array<float>") and st.read().count() == 0
    (tmp_path / "t" / "current.json").write_text("{broken")
    (tmp_path / "t" / ".current.json.crc").unlink(missing_ok=True)
    assert st.state() is None


def test_update_touches_only_the_buckets_of_changed_keys(spark, tmp_path):
    st = S.Store(spark, str(tmp_path / "k"), ("k",), 16)
    schema = "k string, v int"
    st.write(spark.createDataFrame([(f"k{i}", i) for i in range(200)], schema))
    before = st.state()["parts"]
    gone = spark.createDataFrame([("k1", 0), ("k2", 0), ("new", 0)], schema)
    new = spark.createDataFrame([("k1", -1), ("new", -2)], schema)
    touched = st.update(gone, lambda old: S.delete(old, gone, ["k"]).unionByName(new), note="x")
    after = st.state()["parts"]
    assert {int(b) for b in after if after[b] != before.get(b)} == set(touched) and len(touched) <= 3 and st.state()["properties"]["note"] == "x"
    rows = {r["k"]: r["v"] for r in st.read().collect()}
    assert len(rows) == 200 and rows["k1"] == -1 and rows["new"] == -2 and "k2" not in rows
    st.update(gone, lambda old: S.delete(old, gone, ["k"]).unionByName(new))
    assert {r["k"]: r["v"] for r in st.read().collect()} == rows
    st.clean()
    assert st.read().count() == 200 and st.update(gone.where("false"), lambda old: old) == []
    st.write(st.read().where("false"))
    assert st.read().count() == 0 and st.read().columns == ["k", "v"]


def test_stored_at_length_one(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("z", [0.0, 0.0]), ("n", None)], "id string, vector array<float>")
    got = {r["id"]: r["u"] for r in df.select("id", vector.unit(F.col("vector")).alias("u")).collect()}
    assert got["n"] is None and got["z"] == [0.0, 0.0] and abs(got["a"][0] - 0.6) < 1e-6
    u = df.select("id", vector.unit(F.col("vector")).alias("vector")).where("id = 'a'")
    assert vector.topk(u, [1.0, 0.0], 3, scaled=True).first()["score"] == vector.topk(df.where("id = 'a'"), [1.0, 0.0], 3).first()["score"] == 0.6
