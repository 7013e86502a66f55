"""Stems, guard, repository walk, index store, service, command line and streams."""

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions.embed import PrefixedEmbedder, hash_embedding
from lodestone.functions.stem import stem_word, stems
from lodestone.operators.replies import guarded, kept_length, loop_cut
from lodestone.service import ScriptedGenerator, SearchSettings, Service
from lodestone.sources.repository import Ignore, decode, list_files, read_repository
from lodestone.sources.store import IndexMismatch, IndexStore
from lodestone.streaming.arriving import guard_replies, index_arrivals


def test_stems(spark):
    want = dict(zip("consistency knackeries kneeling retry headers cancelled repetition happily dying generate skis as".split(), "consist knackeri kneel retri header cancel repetit happili die generat ski as".split()))
    assert {w: stem_word(w) for w in want} == want
    df = spark.createDataFrame([("headers",), (None,)], "w string")
    assert [r.s for r in df.select(stems(F.col("w")).alias("s")).collect()] == ["header", None]


def test_hash_embedding(spark):
    df = spark.createDataFrame([("parseHTTP x",), ("",), (None,)], "t string")
    a, b, c = [r.v for r in df.select(hash_embedding(F.col("t")).alias("v")).collect()]
    assert abs(sum(x * x for x in a) - 1) < 1e-9 and b == c == [1.0] + [0.0] * 63


def test_guard(spark):
    line = "a line that is long enough\n"
    text = "start\n" + line + "other words here\n" + line + line
    assert kept_length(text, 5) == len(("start\n" + line + "other words here\n").rstrip())
    assert kept_length("intro " + "ab cd ef " * 9) is not None and kept_length("short\n" * 9 + "x") is None
    assert kept_length("```python\n" * 5) is None and kept_length(None) is None
    assert "".join(guarded(["x" * 5, "abcdefgh" * 6, "more"])).endswith("gh")
    df = spark.createDataFrame([(text,), ("fine",), (None,)], "t string")
    assert [r.n for r in df.select(loop_cut(F.col("t")).alias("n")).collect()] == [kept_length(text), None, None]


@pytest.mark.parametrize("data, want", [(b"\xef\xbb\xbfx", "x"), ("# coding: latin-1\né".encode("latin-1"), "# coding: latin-1\né"), (b"\xff", "�"), (b"# coding: nonsense\nx", "# coding: nonsense\nx")])
def test_decode(data, want):
    assert decode(data) == want


def test_walk(spark, tmp_path):
    for name, text in {
        "b.py": "x = 1\n", "a/__init__.py": "", "a/skip.py": "y", "a/keep.py": "z = 2\n", "venv/v.py": "n", "c.txt": "n", "._d.py": "n", "out/o.py": "n", "big.py": "#" * 99, "zero.py": "a\0b",
        ".gitignore": "out/\nskip*\n", "a/.gitignore": "!skip.py\nskip_*.py\n", "a/skip_2.py": "n",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "link.py").symlink_to(tmp_path / "b.py")
    assert list_files(tmp_path) == ["a/__init__.py", "a/keep.py", "a/skip.py", "b.py", "big.py", "zero.py"]
    got = {r.path for r in read_repository(spark, tmp_path, max_bytes=50).collect()}
    assert got == {"a/__init__.py", "a/keep.py", "a/skip.py", "b.py"}
    assert Ignore("/x\n").verdict("x", False) and Ignore("/x\n").verdict("a/x", False) is None


CORE = "def open_pool():\n    '''Opens the pool of files.'''\n    return read_file()\n\n\ndef read_file():\n    return 1\n\n\nclass Pool:\n    def close(self):\n        return open_pool()\n"


@pytest.fixture
def repo(tmp_path):
    (tmp_path / "core.py").write_text(CORE)
    (tmp_path / "other.py").write_text("def unrelated_thing():\n    pass\n")
    return tmp_path


def test_store_and_service(spark, repo, tmp_path):
    store = IndexStore(spark, tmp_path / "index")
    first = store.build(read_repository(spark, repo), "r")
    assert (first.files, first.chunks, first.embedded, first.reused, first.deleted, first.changed) == (2, 5, 5, 0, 0, True)
    data = store.manifest()["data"]
    assert not store.build(read_repository(spark, repo), "r").changed and store.manifest()["data"] == data
    service = Service(store)
    (repo / "core.py").write_text(CORE.replace("return 1", "return 2"))
    (repo / "other.py").unlink()
    second = store.build(read_repository(spark, repo), "r")
    assert (second.embedded, second.reused, second.deleted) == (1, 3, 1)
    assert [n for n in store.files.names() if n.startswith("gen-")] == [store.manifest()["data"]] != [data]
    service.refresh()
    asked = spark.createDataFrame([(1, "open pool"), (2, " ")], "qid long, query string")
    for settings in (SearchSettings(), SearchSettings("fused", 1), SearchSettings("bm25")):
        hits = service.search(asked, 3, settings).orderBy("hit_rank").collect()
        assert hits[0].chunk_id == "core.py::open_pool" and {h.qid for h in hits} == {1}
    assert SearchSettings().describe() == "dense+graph(hops=2, weight=2)"
    assert service.get_chunk("core.py::Pool.close")["start_line"] == 11
    assert service.list_symbols("./core", limit=2)["truncated"]
    for bad in (lambda: service.search(asked, 0), lambda: SearchSettings("x"), lambda: service.list_symbols(limit=0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(LookupError):
        service.get_chunk("none")
    with pytest.raises(IndexMismatch):
        store.build(read_repository(spark, repo), "another")
    with pytest.raises(IndexMismatch):
        IndexStore(spark, store.root, PrefixedEmbedder("x", 64, hash_embedding)).table("chunks")


def test_moved_chunks_are_written_again(spark, repo, tmp_path):
    store = IndexStore(spark, tmp_path / "index")
    store.build(read_repository(spark, repo), "r")
    (repo / "core.py").write_text("\n\n\n" + CORE)
    stats = store.build(read_repository(spark, repo), "r")
    assert (stats.embedded, stats.reused, stats.changed) == (0, 5, True)
    assert Service(store).get_chunk("core.py::open_pool")["start_line"] == 4


def test_a_failing_build_leaves_the_old_index(spark, repo, tmp_path):
    store = IndexStore(spark, tmp_path / "index")
    store.build(read_repository(spark, repo), "r")
    before = store.files.names()
    (repo / "core.py").write_text(CORE.replace("1", "2"))
    short = IndexStore(spark, tmp_path / "index", PrefixedEmbedder("hash-64", 63, hash_embedding))
    with pytest.raises(Exception, match="another length"):
        short.build(read_repository(spark, repo), "r")
    assert store.files.names() == before


def test_questions_are_answered(spark, repo, tmp_path):
    store = IndexStore(spark, tmp_path / "index")
    store.build(read_repository(spark, repo), "r")
    service = Service(store)
    asked = spark.createDataFrame([(1, "open pool"), (2, "read file"), (3, " ")], "qid long, query string")
    good = "Evidence:\n[C1] `return read_file()`\nAnswer:\nIt reads the file [C1]."
    script = ScriptedGenerator([("Question: open pool", good), ("Question: read", good.replace("read_file()", "nothing_here()"))])
    got = {r.qid: r for r in service.ask(asked, script, 2, SearchSettings("fused", 0), quoting=True).collect()}
    assert (got[1].verification, list(got[1].citations), got[1].text) == ("verified", ["C1"], good)
    assert (got[2].verification, got[2].status) == ("unverified", "abstained") and got[3].status == "abstained"
    loud = ScriptedGenerator([(".", "See [C1], [C9]. " + "again and again " * 9)])
    (one,) = [r for r in service.ask(asked, loud, 2, SearchSettings("bm25")).collect() if r.qid == 1]
    assert (list(one.citations), list(one.unknown_tags), one.status) == (["C1"], ["C9"], "answered") and one.kept < 60
    with pytest.raises(ValueError):
        service.ask(asked, script, 21)
    hit = service.search(asked, 2, SearchSettings("fused", 1)).where("qid = 1 and hit_rank = 1").head()
    assert hit.sources == ["bm25", "dense", "graph"] and set(hit.raw_scores) == {"bm25", "dense"} and (hit.first_line, hit.last_line) == (1, 3)


def test_long_chunks_are_cut_into_parts(spark, tmp_path):
    store = IndexStore(spark, tmp_path, max_tokens=20)
    files = spark.createDataFrame([("a.py", "def f():\n" + "".join(f"    x{i} = 1\n" for i in range(30)))], "path string, source string")
    parts = store.parts_of(store.chunks_of(files)).orderBy("part_no").collect()
    assert len(parts) > 3 and parts[0].first_line == 0 and all(a.last_line + 1 == b.first_line for a, b in zip(parts, parts[1:]))
    assert all(p.text.startswith("# file: a.py\n# symbol: f (function)\n") for p in parts)


def test_command_line(repo, capsys, spark):
    assert cli.main(["index", str(repo)]) == 0
    assert cli.main(["search", str(repo), "open pool", "-k", "2"]) == 0
    assert "core.py::open_pool" in capsys.readouterr().out
    assert cli.main(["symbols", str(repo), "--limit", "0"]) == 1


def test_arrivals_are_indexed(spark, tmp_path):
    store = IndexStore(spark, tmp_path / "index")
    put = lambda rows: spark.createDataFrame(rows, "path string, source string, delivered string").withColumn("delivered", F.to_timestamp("delivered")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: index_arrivals(spark, str(tmp_path / "in"), store, "r", str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    put([("a.py", "def f(): pass\n", "2026-01-01")])
    go()
    assert store.table("chunks").count() == 1
    put([("a.py", "def f(): return 1\n", "2026-01-02"), ("b.py", "def g(): pass\n", "2026-01-02")])
    go()
    assert sorted(r.source for r in store.table("chunks").collect()) == ["def f(): return 1", "def g(): pass"]


def test_stream_guard(spark, tmp_path):
    pieces = [(1, i, "the same phrase again ") for i in range(12)] + [(2, i, f"word {i} ") for i in range(12)]
    schema = "answer_id long, seq long, piece string"
    spark.createDataFrame(pieces, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = guard_replies(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("loops").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.answer_id for r in spark.table("loops").collect()] == [1]
