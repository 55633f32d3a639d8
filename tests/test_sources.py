import os
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import embeddings
from tessera.operators import diff, ingest, overview, structure
from tessera.operators import store as S
from tessera.sources import extract, filetree, gitignore, registry
from tessera.streaming import incremental

TREE = {
    "main.py": b'"""Entry."""\nimport config.settings\nfrom src import utils\n\n\ndef run(a: int, b=2) -> int:\n    """Adds."""\n    return a + b\n\n\nclass App(Base):\n    async def go(self):\n        pass\n',
    "app.js": b"import x from './src/lib.js';\nconst express = require('express');\nexport const f = (a, b) => a;\nfunction g(q) {}\nclass K extends L {}\n",
    "config/settings.py": b"X = 1\n", "config/__init__.py": b"", "config.yaml": b"a: 1\nb: 2\n", "README.md": b"# One\ntext\n## Two\nmore\n", ".gitignore": b"__pycache__/\n*.pyc\nnode_modules/\n.env\n",
    "image.png": b"\x89PNG\r\n\x1a\n" + bytes(100), "src/utils.py": b"def helper():\n    pass\n", "src/lib.ts": b"export interface I extends A, B {}\n", "node_modules/x.js": b"x", "a.pyc": b"x", ".hidden/y.py": b"x", "notes.unknown": b"x",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    for p, data in TREE.items():
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    return str(root)


def names(df):
    return {r["rel_path"] for r in df.select("rel_path").collect()}


def test_scan(spark, tree):
    every = names(filetree.files(spark, tree))
    assert every == {"main.py", "app.js", "config/settings.py", "config/__init__.py", "config.yaml", "README.md", ".gitignore", "image.png", "src/utils.py", "src/lib.ts"}
    assert names(filetree.files(spark, tree, include=".py")) == {"main.py", "src/utils.py", "config/settings.py", "config/__init__.py"}
    assert "README.md" not in names(filetree.files(spark, tree, exclude="MD"))
    assert names(filetree.files(spark, tree, maxsize="5")) == {"config/__init__.py"}
    assert filetree.normalise_extensions(["py", ".GO", ""]) == {".py", ".go"} and filetree.normalise_extensions([]) is None


def test_gitignore(spark):
    rules = gitignore.compile_lines(["*.log", "build/", "/top.txt", "!keep.log", "a/**/b", "# no", "", "x?.c"])
    cases = {"x.log": True, "d/x.log": True, "keep.log": False, "build/f": True, "s/build/f": True, "build": False, "top.txt": True, "d/top.txt": False, "a/b": True, "a/q/r/b": True, "xy.c": True, "xyz.c": False}
    assert {p: gitignore.is_ignored(p, rules) for p in cases} == cases
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r["p"]: r["i"] for r in df.select("p", gitignore.ignored(F.col("p"), rules).alias("i")).collect()} == cases


def test_registry(spark):
    df = spark.createDataFrame([("Dockerfile",), ("a/b.PY",), ("x.tsv",), ("r.RST",), (".gitignore",), ("who.knows",), (None,), ("i.png",)], "file_path string")
    got = {r["file_path"]: (r["extractor"], r["content_type_"], r["language"], r["format"]) for r in registry.dispatch(df).collect()}
    assert got["Dockerfile"] == ("code", "code", "dockerfile", None) and got["a/b.PY"] == ("code", "code", "python", None)
    assert got["x.tsv"] == ("structured", "structured_data", None, "csv") and got["r.RST"] == ("markdown", "markdown", None, "RST")
    assert got[".gitignore"] == ("code", "code", "unknown", None) and got["who.knows"] == ("text", "plain_text", None, None) == got[None] and got["i.png"][0] == "image"


def test_extract(spark, tree):
    got = {r["rel_path"]: r for r in extract.extract(filetree.files(spark, tree)).collect()}
    assert got["main.py"]["meta"] == {"language": "python"} and got["config.yaml"]["content_type"] == "structured_data"
    assert got["image.png"]["error"].startswith("missing_dependency") and got["image.png"]["text"] is None


def test_structure(spark):
    py = structure.signatures_of("m.py", TREE["main.py"].decode())
    assert [(s[0], s[1], s[2]) for s in py] == [("run", "function", 6), ("App", "class", 11), ("go", "async_function", 12)]
    assert py[0][3:6] == (["a: int", "b"], "int", "Adds.") and py[1][6] == ["Base"]
    js = {(s[0], s[1], s[2]) for s in structure.signatures_of("a.js", TREE["app.js"].decode())}
    assert js == {("f", "arrow_function", 3), ("g", "function", 4), ("K", "class", 5)}
    go = structure.signatures_of("a.go", "func (s *Srv) Run(a int, b string) error {\n}\ntype T struct {\n}\ntype I interface {\n}\nfunc main() {\n}")
    assert {(s[0], s[1], s[5 - 1]) for s in go} >= {("Srv.Run", "method", "error"), ("T", "struct", None), ("I", "interface", None)}
    jv = structure.signatures_of("A.java", "public class A extends B {\n  public static int f(int x) { }\n}")
    assert {(s[0], s[1]) for s in jv} == {("A", "class"), ("f", "method")}
    assert structure.signatures_of("x.rs", "fn go(a: i32) {}")[0][:3] == ("go", "function", 1) and structure.signatures_of("x.py", "def (") == []
    assert structure.imports_of("a.py", "import os, sys\nfrom . import x\nfrom a.b import c") == ["os", "sys", "a.b"]
    assert structure.imports_of("a.go", 'import (\n "fmt"\n "x/y"\n "zzz"\n)') == ["fmt", "x/y"]


def test_edges_broadcast_no_estimate(spark, tmp_path):
    rows = [(f"pkg/m{i}.py", "".join(f"import pkg.m{(i + j) % 50}\n" for j in range(20))) for i in range(50)]
    spark.createDataFrame(rows, "file_path string, text string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))  # a scan has a size, so that joins with it may be planned as broadcasts
    e = structure.edges(structure.imports(files, ["file_path"]), files)
    assert "BroadcastHashJoin" not in (plan := e._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" in plan
    assert len(e.collect()) == 50 * 19


def test_planted_graph_broadcasts_no_estimate(spark, data):
    from tessera.plans import planted

    assert "BroadcastHashJoin" not in planted.planted_graph(spark, data)._jdf.queryExecution().executedPlan().toString()


def test_planted_graph_broadcasts_nothing_as_it_runs(spark, data):
    from tessera.plans import planted

    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}  # only what is measured at run time may turn the join into a broadcast
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        df = planted.planted_graph(spark, data)
        assert df.collect()
        ran = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert "isFinalPlan=true" in ran and "SortMergeJoin" in ran and "Broadcast" not in ran


def test_udtf(spark):
    structure.register(spark)
    got = spark.sql("SELECT s.name FROM VALUES ('a.py', 'def f(): pass') AS t(p, x), LATERAL signatures(p, x) s").collect()
    assert [r["name"] for r in got] == ["f"]


def test_graph(spark, tree):
    files = filetree.files(spark, tree).select(F.col("rel_path").alias("file_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    e = {(r["src"], r["dst"]) for r in structure.edges(structure.imports(files, ["file_path"]), files).collect()}
    assert ("main.py", "config/settings.py") in e and all(a != b for a, b in e)


def test_overview(spark, tree):
    f = filetree.files(spark, tree, everyfile="true").select(F.lit("d").alias("directory"), F.col("rel_path").alias("file_path"), "size", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    stats = {r["extension"]: (r["files"], r["lines"]) for r in overview.extension_stats(f, ["directory"]).collect()}
    assert stats[".py"] == (4, 16) and stats["(.gitignore)"] == (1, 4)
    assert {(r["category"], r["file_path"]) for r in overview.key_files(f, ["directory"]).collect()} == {("entry_points", "main.py"), ("docs", "README.md")}
    lines = [r["line"] for r in overview.tree(f, ["directory"]).orderBy("position").collect()]
    assert lines[:5] == ["config/", "  __init__.py", "  settings.py", "src/", "  lib.ts"]
    assert overview.parse_manifest("go.mod", "module a/b\n\ngo 1.22\nrequire (\n\tx/y v1\n)\n") == ("go", "a/b", "unknown", ["x/y"], [])
    assert overview.parse_manifest("package.json", '{"name": "n", "dependencies": {"e": "1"}}')[3] == ["e"] and overview.parse_manifest("package.json", "{") is None
    two = spark.createDataFrame([("d", "a", 5), ("d", "b", 6), ("d", "s/c", 9)], "directory string, file_path string, size long")
    assert overview.fingerprint(two, ["directory"]).first()["fingerprint"] == "2:11"


def test_tree_caps(spark):
    rows = [("d", f"f{i:02d}.py") for i in range(25)] + [("d", "a/b/c/d/e.py")]
    lines = [r["line"] for r in overview.tree(spark.createDataFrame(rows, "directory string, file_path string"), ["directory"]).orderBy("position").collect()]
    assert lines[:4] == ["a/", "  b/", "    c/", "      d/"] and lines[-1] == "... (5 more files)" and len(lines) == 25


def test_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "rel_path string, md5 string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), ("c", None)], "rel_path string, md5 string")
    d = diff.changes(now, old)
    assert {(r["rel_path"], r["change"]) for r in d.collect()} == {("b", "modified"), ("d", "new")}
    gone = diff.changes(now.where("false"), old)
    assert diff.report(gone).first().asDict() == {"has_changes": True, "changed_files": 0, "deleted_files": 3}
    assert diff.report(diff.changes(old, old)).first()["has_changes"] is False


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("1" * 200)
    (tmp_path / "b.txt").write_text("2")
    run("add", ".")
    run("commit", "-qm", "one")
    first = diff.head(str(tmp_path))
    assert diff.uses_git(str(tmp_path)) and diff.git_changes(spark, str(tmp_path), first).count() == 0
    run("mv", "a.txt", "c.txt")
    run("commit", "-qm", "two")
    os.remove(tmp_path / "b.txt")
    (tmp_path / "new.txt").write_text("x")
    got = {(r["rel_path"], r["change"]) for r in diff.git_changes(spark, str(tmp_path), first).collect()}
    assert got == {("a.txt", "deleted"), ("c.txt", "new"), ("b.txt", "deleted"), ("new.txt", "new")}


def test_providers():
    h = embeddings.Hash(384)
    v = h.embed(["a", "a", "b"])
    assert v[0] == v[1] != v[2] and len(v[0]) == 384 and abs(sum(x * x for x in v[0]) - 1) < 1e-9
    with pytest.raises(ValueError):
        embeddings.open_provider(embeddings.Spec("nope"))
    with pytest.raises(ValueError):
        embeddings.open_provider(embeddings.Spec("openai", model="text-embedding-3-small"))
    hosted = embeddings.Hosted("voyage", "u", "voyage-3-lite", "k", lambda u, b, t, k: {"data": [{"embedding": [t]} for _ in b["input"]]})
    assert hosted.embed(["a", "b"]) == [[30], [30]] and hosted.dim == 512
    calls = []

    def old_server(url, body, timeout):
        calls.append(url)
        if url.endswith("/api/embed"):
            raise KeyError
        return {"embedding": [1.0, 2.0]}

    o = embeddings.Ollama("http://h/", "m", old_server)
    assert o.embed(["x", "y"]) == [[1.0, 2.0]] * 2 and len(calls) == 3 and o.dim == 2


def test_requests_and_failures_of_providers(monkeypatch):
    sizes = []
    hosted = embeddings.Hosted("voyage", "u", "voyage-3-lite", "k", lambda u, b, t, k: sizes.append(len(b["input"])) or {"data": [{"embedding": [1.0]} for _ in b["input"]]})
    assert len(hosted.embed(["x"] * 300)) == 300 and sizes == [128, 128, 44]
    sent = []
    o = embeddings.Ollama("http://h", "m", lambda url, body, timeout: sent.append(url) or {"embeddings": [[2.0]] * len(body["input"])})
    assert o.embed(["x"] * 130) == [[2.0]] * 130 and len(sent) == 2
    tries = []
    monkeypatch.setattr(embeddings, "open_provider", lambda spec: tries.append(spec) or (_ for _ in ()).throw(OSError("no model")))
    spec = embeddings.Spec("onnx", model="/nowhere")
    for _ in range(3):
        with pytest.raises(OSError):
            embeddings.provider(spec)
    assert len(tries) == 1
    embeddings.reset()
    with pytest.raises(OSError):
        embeddings.provider(spec)
    assert len(tries) == 2
    embeddings.reset()


def test_pooling():
    import numpy as np

    got = embeddings.pooled(np.array([[[1.0, 0.0], [3.0, 0.0], [9.0, 9.0]]]), np.array([[1, 1, 0]]))
    assert got.tolist() == [[1.0, 0.0]]


def test_index(spark, tree, tmp_path):
    ix = ingest.Index(spark, str(tmp_path / "ix"))
    assert not ix.is_indexed(tree)
    first = ix.ingest(tree)
    assert first["files"] == 10 and first["failed"] == 1 and ix.is_indexed(tree)
    assert ix.chunks.read().where("file_path = 'README.md'").count() == 2
    again = ix.ingest(tree)
    assert again["files"] == 1 and again["deleted"] == 0  # the unreadable image is tried again
    os.remove(os.path.join(tree, "src/utils.py"))
    with open(os.path.join(tree, "main.py"), "ab") as fh:
        fh.write(b"\n\ndef added():\n    return 'quokka'\n")
    assert api.check_status(ix, tree).first()["recommendation"] == "consider re-indexing"
    third = ix.ingest(tree)
    assert third["deleted"] == 1 and ix.chunks.read().where("file_path = 'src/utils.py'").count() == 0
    hits = api.search(ix, tree, "quokka", 3)
    assert "main.py" in {r["file_path"] for r in hits.collect()} and hits.count() <= 3
    assert "--- main.py (score:" in api.render_hits(hits, "quokka", tree)
    only = api.search_by_file(ix, tree, "anything", "config", 5).collect()
    assert only and all("config" in r["file_path"] for r in only)
    assert api.stats(ix).first()["total_points"] == ix.chunks.read().count()
    assert ix.chunks.read().select("id").distinct().count() == ix.chunks.read().count()
    assert "## main.py" in api.render_signatures(api.get_file_signatures(ix, tree))
    assert "main.py" in api.render_graph(api.get_dependency_graph(ix, tree))
    assert api.get_context(ix, tree)["total_files"] > 8
    assert api.render_hits(hits.where("false"), "q", "d").startswith("No results found")
    with pytest.warns(DeprecationWarning):
        assert api.collection_stats(ix).first()["total_points"] > 0
    before = ix.chunks.state()["version"]
    with pytest.raises(TimeoutError):
        ix.ingest(tree, force=True, seconds=0)
    assert ix.chunks.state()["version"] == before


def test_stream(spark, tmp_path):
    src, st = str(tmp_path / "in"), S.Store(spark, str(tmp_path / "out"))
    schema = "k string, t int, v string"
    for i, rows in enumerate([[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")], [("a", 0, "late")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/p{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        incremental.upsert_stream(stream, st, ["k"], ["t"], str(tmp_path / "cp"))
    assert {(r["k"], r["v"]) for r in st.read().collect()} == {("a", "z"), ("b", "y")}
    sink = incremental.apply_batch(st, ["k"], ["t"])
    sink(spark.createDataFrame([("c", 1, "w")], schema), st.state()["properties"]["batch"])
    assert st.read().count() == 2  # a replayed batch changes nothing


def test_file_stream(spark, tree, tmp_path):
    seen = []
    q = incremental.watch_files(spark, tree).writeStream.foreachBatch(lambda df, i: seen.append(names(df))).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        with open(os.path.join(tree, "src/more.py"), "w") as fh:
            fh.write("y = 2\n")
        q.processAllAvailable()
    finally:
        q.stop()
    assert "main.py" in set().union(*seen) and seen[-1] == {"src/more.py"}


def test_deadline_keeps_what_was_finished(spark, tree, tmp_path, monkeypatch):
    from tessera.config import Settings

    ix = ingest.Index(spark, str(tmp_path / "ix"), Settings(ingest_batch=3))
    step, seen = ix._step, []

    def slow(directory, files, delta, done):
        if len(seen) == 2:
            raise RuntimeError("cancelled")
        seen.append(1)
        step(directory, files, delta, done)
        if len(seen) == 2:
            late[0].set()

    late, event = [], threading.Event
    monkeypatch.setattr(ingest.threading, "Event", lambda: late.append(event()) or late[-1])
    monkeypatch.setattr(ix, "_step", slow)
    r = ix.ingest(tree)
    assert r["timed_out"] and r["files"] + r["skipped"] == 10 and 0 < r["skipped"] < 10
    kept = {x["file_path"] for x in ix.chunks.read().select("file_path").distinct().collect()}
    assert kept and ix.manifest.read().count() == r["files"] - r["failed"]
    monkeypatch.undo()
    again = ix.ingest(tree)
    assert not again["timed_out"] and again["files"] == r["skipped"] + r["failed"]
    assert kept < {x["file_path"] for x in ix.chunks.read().select("file_path").distinct().collect()}


def test_git_tells_the_changes(spark, tmp_path):
    root = tmp_path / "work"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=root, check=True, capture_output=True)
    run("init", "-q")
    (root / "a.py").write_text("x = 1\n")
    (root / "b.py").write_text("y = 1\n")
    run("add", ".")
    run("commit", "-qm", "one")
    ix = ingest.Index(spark, str(tmp_path / "ix"))
    ix.ingest(str(root))
    assert ix.changes(str(root)).count() == 0 and ix._commit(str(root)) == diff.head(str(root))
    (root / "b.py").write_text("y = 2\n")
    os.remove(root / "a.py")
    (root / "c.py").write_text("z = 1\n")
    assert {(r["rel_path"], r["change"]) for r in ix.changes(str(root)).collect()} == {("a.py", "deleted"), ("b.py", "modified"), ("c.py", "new")}
    assert api.check_status(ix, str(root)).first()["recommendation"] == "consider re-indexing"


def test_overview_is_kept_while_the_fingerprint_stays(spark, tree, tmp_path):
    ix = ingest.Index(spark, str(tmp_path / "ix"))
    first = api.get_context(ix, tree)
    ix.save_overview(os.path.abspath(tree), first | {"total_files": -1}, ix.overviews.read().first()["fingerprint"])
    assert api.get_context(ix, tree)["total_files"] == -1 and api.get_context(ix, tree, fresh=True)["total_files"] == first["total_files"]
    with open(os.path.join(tree, "new_at_root.py"), "w") as fh:
        fh.write("x = 1\n")
    assert api.get_context(ix, tree)["total_files"] == first["total_files"] + 1
    text = api.render_context(first)
    assert text.startswith(f"Directory: {os.path.abspath(tree)}\nTotal files: ") and "\n## Languages (by file count)\n" in text and "\n## Directory Structure\n" in text
    many = first | {"languages": [{"extension": f".e{i}", "files": 1, "lines": 2} for i in range(15)], "structure": [f"f{i}" for i in range(60)], "dependencies": [{"ecosystem": "go", "name": "m", "version": "unknown", "requires": [f"d{i}" for i in range(20)]}]}
    text = api.render_context(many)
    assert ".e9 " in text and ".e10" not in text and "    ... and 5 more" in text and "  ... (10 more entries)" in text


def test_stream_of_files_keeps_the_index(spark, tree, tmp_path):
    ix, cp = ingest.Index(spark, str(tmp_path / "ix")), str(tmp_path / "cp")
    options = {"listings": str(tmp_path / "listings")}
    incremental.index_files(ix, tree, cp, **options).awaitTermination()
    assert ix.chunks.read().where("file_path = 'src/utils.py'").count() == 1
    os.remove(os.path.join(tree, "src/utils.py"))
    with open(os.path.join(tree, "main.py"), "w") as fh:
        fh.write("def only():\n    return 1\n")
    incremental.index_files(ix, tree, cp, **options).awaitTermination()
    now = {r["file_path"]: r["text"] for r in ix.chunks.read().collect()}
    assert "src/utils.py" not in now and "def only" in now["main.py"] and "README.md" in now


def test_search_ranks_terms_within_the_directory(spark, tmp_path):
    ix = ingest.Index(spark, str(tmp_path / "ix"))
    for d, texts in (("one", ["alpha beta", "alpha gamma", "delta"]), ("two", ["alpha"] * 9)):
        (tmp_path / d).mkdir()
        for i, t in enumerate(texts):
            (tmp_path / d / f"f{i}.md").write_text(t)
        ix.ingest(str(tmp_path / d))
    here = ix.chunks.read().where(F.col("directory") == str(tmp_path / "one"))
    from tessera.operators import lexical

    want = {r["id"] for r in lexical.topk(here.select("id", "tokens", "dl"), "beta alpha", 4).collect()}
    got = {r["id"] for r in api.search(ix, str(tmp_path / "one"), "beta alpha", 2).collect()}
    assert len(want) == 2 and got & want
    held = ix.corpus(str(tmp_path / "one"))
    assert ix.corpus(str(tmp_path / "one")) is held and held.count() == 3
    (tmp_path / "one" / "more.md").write_text("epsilon")
    ix.ingest(str(tmp_path / "one"))
    assert ix.corpus(str(tmp_path / "one")) is not held and ix.corpus(str(tmp_path / "one")).count() == 4


def test_partitions_are_bounded_by_bytes(tmp_path, monkeypatch):
    for i, n in enumerate([40, 40, 40, 500, 10]):
        (tmp_path / f"f{i}.py").write_text("x" * n)
    monkeypatch.setattr(filetree, "BYTES_PER_PARTITION", 100)
    assert filetree.packed(str(tmp_path), [f"f{i}.py" for i in range(5)]) == [["f0.py", "f1.py"], ["f2.py"], ["f3.py"], ["f4.py"]]
    monkeypatch.setattr(filetree, "FILES_PER_PARTITION", 1)
    assert len(filetree.packed(str(tmp_path), ["f0.py", "f4.py", "gone.py"])) == 3


def test_extractor_plug_in_and_registry(spark):
    files = spark.createDataFrame([("a.toy", bytearray(b"x")), ("b.py", bytearray(b"y\r\nz")), ("c.pdf", bytearray(b"no"))], "rel_path string, content binary")
    assert [r["k"] for r in files.select(registry.can_extract(F.col("rel_path")).alias("k")).collect()] == [False, True, True]
    extract.register_reader("toy", lambda data: (data.decode().upper(), {"made": "by toy"}))
    try:
        got = {r["rel_path"]: r for r in extract.extract(files, [registry.Entry(".toy", "toy", "plain_text", 9)]).collect()}
    finally:
        extract.READERS.pop("toy")
    assert got["a.toy"]["text"] == "X" and got["a.toy"]["meta"]["made"] == "by toy" and got["b.py"]["text"] == "y\nz"
    assert got["c.pdf"]["text"] is None and got["c.pdf"]["error"]


def test_saved_corpus_gives_the_same_ranking(spark, tmp_path):
    from tessera.operators import lexical

    docs = spark.createDataFrame([("a", "rust memory rust"), ("b", "python"), ("c", None)], "id string, text string")
    corpus = lexical.corpus(docs, "id", "text")
    st = S.Store(spark, str(tmp_path / "bm25"), ("id",))
    assert st.load() is None
    st.write(corpus)
    assert lexical.topk(st.read(), "rust memory").collect() == lexical.topk(corpus, "rust memory").collect()
    st._write_text(f"{st.path}/current.json", "{broken")
    assert not st.exists() and st.load() is None
