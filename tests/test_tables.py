"""Tables by key: what changes cost, what stays of them, and one commit over several."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight import engine, jobs
from quarrylight.sources import tables

SCHEMA = "id string, kind string, v int"


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def folders(path):
    return set(os.listdir(f"{path}/data"))


@pytest.fixture
def rows(spark):
    return lambda *x: spark.createDataFrame(list(x), SCHEMA).coalesce(1)


def held(table, parts=None):
    return sorted(map(tuple, table.read(parts).collect()))


def test_changes_and_reads(spark, rows, tmp_path):
    table = tables.Table(spark, str(tmp_path / "t"), SCHEMA, part="kind")
    assert held(table) == []
    table.delete(F.lit(True))
    table.upsert(rows(("a", "x", 1), ("b", "x", 2), ("c", "y", 3), ("d", None, 4)))
    table.upsert(rows(("a", "x", 9)))
    assert held(table) == [("a", "x", 9), ("b", "x", 2), ("c", "y", 3), ("d", None, 4)] and held(table, [""]) == [("d", None, 4)]
    table.upsert(rows(("a", "y", 7)))  # from one part to another
    assert held(table, ["y"]) == [("a", "y", 7), ("c", "y", 3)] and held(table, ["x"]) == [("b", "x", 2)]
    table.delete((F.col("v") == 4) | F.col("v").isNull())
    table.delete_ids(spark.createDataFrame([("b",), ("b",), ("none",)], "id string"))
    table.purge("y")  # the row of part x that one of part y replaced stays hidden
    assert held(table) == []
    table.upsert(rows(("b", "x", 5)))
    assert held(table) == [("b", "x", 5)]
    with pytest.raises(ValueError, match="2 times"):
        table.upsert(rows(("z", "x", 1), ("z", "y", 2)))
    with pytest.raises(ValueError):
        table.delete(None)
    assert held(table) == [("b", "x", 5)]


def test_random_changes_match_a_dictionary(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MOST_FOLDERS", 3)
    table, plain, rng = tables.Table(spark, str(tmp_path / "t"), SCHEMA, part="kind"), {}, np.random.default_rng(2)
    base = [(f"k{i}", "xyz"[i % 3], i) for i in range(40)]
    table.upsert(rows(*base))
    plain.update({r[0]: r for r in base})
    for step in range(14):
        kind = rng.integers(0, 4)
        if kind < 2:
            new = {f"k{i}": (f"k{i}", "xyz"[rng.integers(0, 3)], 100 * step + int(i)) for i in rng.integers(0, 50, 4)}
            table.upsert(rows(*new.values()))
            plain.update(new)
        elif kind == 2:
            gone = [f"k{i}" for i in rng.integers(0, 50, 3)]
            table.delete_ids(spark.createDataFrame([(g,) for g in gone], "id string").coalesce(1))
            plain = {k: r for k, r in plain.items() if k not in gone}
        elif step in (7, 8, 12):
            table.purge("y")
            plain = {k: r for k, r in plain.items() if r[1] != "y"}
        if step % 3 == 2 or step == 13:
            assert held(table) == sorted(plain.values()), step
        assert len(table._entries()) <= 4
    table.merge(everything=True)
    assert held(table) == sorted(plain.values()) and len(table._entries()) <= 1


def test_an_upsert_writes_its_rows_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = tables.Table(spark, path, "id long, t string", key="id")
    table.upsert(spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1))
    before = size(path)
    for i in range(4):
        table.upsert(spark.range(i, i + 20).select("id", F.lit("new").alias("t")).coalesce(1))
    assert size(path) - before < before / 1_000
    assert table.read().count() == 200_000 and table.read().filter("t = 'new'").count() == 23


def test_what_no_manifest_names_goes_after_a_time(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MOST_FOLDERS", 2)
    path = str(tmp_path / "t")
    table = tables.Table(spark, path, SCHEMA, ledger=tables.Ledger(spark, path, retention=3600))
    for i in range(6):
        table.upsert(rows((f"k{i}", "x", i)))
    many = len(folders(path))
    assert many > len(table._entries())
    for f in folders(path):  # as if written two hours ago
        os.utime(f"{path}/data/{f}", (time.time() - 7200,) * 2)
    table.upsert(rows(("k9", "x", 9)))
    named = {e["folder"] for n in table.ledger._numbers()[-2:] for e in table.ledger._manifest(n)["tables"]["rows"]}
    assert named <= folders(path) and len(folders(path)) <= len(named) + 2 < many and len(held(table)) == 7
    assert len(table.ledger._numbers()) <= 3


def test_another_writer_was_first(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    one, two = (tables.Table(spark, path, SCHEMA) for _ in range(2))
    one.upsert(rows(("a", "x", 1)))
    with pytest.raises(FileExistsError):
        with two.ledger.transaction():
            one.upsert(rows(("b", "x", 2)))
            two.upsert(rows(("c", "x", 3)))
    assert held(one) == held(two) == [("a", "x", 1), ("b", "x", 2)]


@pytest.mark.parametrize("fails", ["chunks", "artifacts", "state", "commit"])
def test_a_failure_between_writes_changes_nothing(spark, tmp_path, monkeypatch, fails):
    store = engine.VectorStore(spark, str(tmp_path / "c"), 16)
    ingest = jobs.Ingest(spark, store, engine.HashedBag(16), str(tmp_path / "s"))
    html = lambda n: "<article>" + "".join(f"<h2>Heading number {i} of the page</h2><p>Text {n} under heading {i} that is long enough</p>" for i in range(n)) + "</article>"
    load = lambda n: ingest.pages(spark.createDataFrame([("https://www.example.com/blog/a", html(n))], "url string, html string"), "blog")
    load(3)
    every = lambda: [sorted(map(str, t.read().collect())) for t in (store.table, ingest.state, ingest.artifacts)]
    before = every()
    assert [len(x) for x in before] == [3, 1, 1]

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        table = {"chunks": store.table, "artifacts": ingest.artifacts, "state": ingest.state}.get(fails)
        m.setattr(table or store.table.ledger, "upsert" if table else "_commit", broken)
        with pytest.raises(OSError, match="lost"):
            load(2)
    assert every() == before
    assert load(2)["changed"] == 1 and [len(x) for x in every()] == [2, 1, 1]
