import shutil
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylight import queries
from quarrylight.operators import pages
from quarrylight.sources import files, sinks
from quarrylight.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_cases(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    good = '{"id": "%s", "query": "q", "ground_truth": "g", "tags": ["%s"]}'
    path.write_text(f"# note\n\n{good % ('1', 'a')}\n  {good % ('2', 'b')}\n")
    assert [r.id for r in files.cases(spark, str(path)).collect()] == ["1", "2"]
    assert [r.id for r in files.cases(spark, str(path), ["b", "c"]).collect()] == ["2"]
    path.write_text('{"id": "1"}\n')
    with pytest.raises(Exception, match="missing query"):
        files.cases(spark, str(path)).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x":\n 1}')
    (tmp_path / "b.json").write_text("{broken")
    assert [tuple(r) for r in files.entities(spark, str(tmp_path / "*.json"), "x int").collect()] == [(1, "a.json")]
    for name, raw in (("u.csv", "﻿é,b\n,\"c, d\"\n".encode()), ("l.csv", "é,b\r\n,\"c, d\"".encode("latin-1"))):
        (tmp_path / name).write_bytes(raw)
    assert {r.text for r in files.csv_text(spark, str(tmp_path / "*.csv")).collect()} == {"é | b\nc, d"}
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns:r="q"><sheets><sheet name="S" r:id="i1"/></sheets></w>')
        z.writestr("xl/_rels/workbook.xml.rels", '<r><x Id="i1" Target="worksheets/s.xml"/></r>')
        z.writestr("xl/sharedStrings.xml", "<s><si><t>one</t></si></s>")
        z.writestr("xl/worksheets/s.xml", '<s><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.0</v></c><c r="D1"><v>2.5</v></c></row></s>')
    assert [(r.sheet, r.row, r.cells) for r in files.xlsx_rows(spark, str(tmp_path / "*.xlsx")).collect()] == [("S", 0, ["one", "", "3", "2.5"])]


def test_blocks_and_rich_text():
    html = "<h2>A <b>b</b></h2><script>no</script><p>one<p>two &amp; x<ul><li>i<ul><li>n</li></ul></li><li>j</ul><table><tr><th>h<td>1</tr><tr><td>2</table><nav><p>menu</p></nav>"
    assert pages.blocks_of(html) == [(0, "h2", "A b"), (1, "p", "one"), (2, "p", "two & x"), (3, "list", "- i n\n- j"), (4, "table", "h | 1\n2")]
    assert pages.blocks_of(None) == pages.blocks_of("") == []
    deep = '{"text": "a", "children": [' * 300 + '"z"' + ', {"text": "b"}]}' * 300
    assert pages.plain_of(deep) == "a" * 300 + "z" + "b" * 300 and pages.plain_of(None) == pages.plain_of("{") == ""


def test_table_pairs(spark):
    line = spark.read.parquet(f"{SF}/lineitem.parquet").toPandas()
    line["top"], line["text"] = line.l_partkey % 1000, line.l_returnflag + " " + line.l_linenumber.astype(str)
    want = []
    for page, rows in line.sort_values(["top", "text"]).groupby("l_orderkey"):
        free = [(t, x) for t, x, n in zip(rows.top, rows.text, rows.l_linenumber) if n % 2 == 0]
        for top, text in [(t, x) for t, x, n in zip(rows.top, rows.text, rows.l_linenumber) if n % 2]:
            near = min(free, key=lambda f: max(0, abs(f[0] - top) - 40), default=None)
            if near and max(0, abs(near[0] - top) - 40) <= 200:
                free.remove(near)
                want.append((page, text, near[1]))
            else:
                want.append((page, text, ""))
    assert sorted(map(tuple, queries.QUERIES["table_pairs"](spark, SF).collect())) == sorted(want)


@pytest.fixture
def stream(spark, tmp_path):
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values("ts")
    for i, part in enumerate(np.array_split(np.arange(len(events)), 4)):
        spark.createDataFrame(events.iloc[part]).coalesce(1).write.mode("append").parquet(str(tmp_path / f"made{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"made{i}").glob("*.parquet"):
            shutil.move(f, tmp_path / "in" / f"{i}.parquet")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_session_stream(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    found = jobs.sessions(stream, "user_id", "ts", "6 HOURS", "1 hour", most=5, least=2)
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination(150)
    mine = set(map(tuple, spark.read.parquet(out).collect()))
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).orderBy("user_id", "t").collect()
    last, pause, want = max(r.t for r in rows), 6 * 3600 * 10**6, []
    for user, t in rows:
        if want and want[-1][0] == user and t - want[-1][2] <= pause and want[-1][3] < 5:
            want[-1][2:] = t, want[-1][3] + 1
        else:
            want.append([user, t, t, 1])
    whole = {tuple(x) for x in want if x[3] >= 2}
    assert {x for x in whole if x[2] < last - pause - 2 * 3600 * 10**6} <= mine <= whole and mine


def test_ingest(spark, stream, tmp_path):
    target = str(tmp_path / "t")
    jobs.ingest(stream, spark, target, str(tmp_path / "c"), "user_id", "event_type").awaitTermination(150)
    got, events = spark.read.parquet(target), spark.read.parquet(f"{SF}/events.parquet")
    assert got.select("user_id").distinct().count() == events.select("user_id").distinct().count()
    jobs.ingest(stream, spark, target, str(tmp_path / "c"), "user_id", "event_type").awaitTermination(150)
    assert spark.read.parquet(target).count() == got.count()


def test_daily_usage_stream(spark, stream, tmp_path):
    out = str(tmp_path / "days")
    found = jobs.daily_usage(stream, "ts", "event_type", "value")
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cd")).trigger(availableNow=True).start(out).awaitTermination(150)
    mine = {(r.day.date(), r.event_type): (r.n, round(r.total, 4)) for r in spark.read.parquet(out).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet")
    whole = {(r.day, r.event_type): (r.n, round(r.total, 4)) for r in events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    last = max(day for day, _ in whole)
    assert mine and all(whole[k] == v for k, v in mine.items()) and {k for k in whole if (last - k[0]).days > 1} <= set(mine)


def test_late_rows(spark, tmp_path):
    import datetime

    (tmp_path / "in").mkdir()
    day = datetime.datetime(2024, 1, 1)
    for i, hours in enumerate(([0, 5], [6, 1], [7, 5])):
        spark.createDataFrame([(f"{i}-{h}", day + datetime.timedelta(hours=h)) for h in hours], "id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"m{i}"))
        for f in (tmp_path / f"m{i}").glob("*.parquet"):
            shutil.move(f, tmp_path / "in" / f"{i}.parquet")
            import os

            os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = []
    jobs.late_rows(stream, spark, "ts", 2 * 3600, str(tmp_path / "late"), str(tmp_path / "c"), lambda batch, _: kept.extend(r.id for r in batch.collect())).awaitTermination(150)
    assert {r.id for r in spark.read.parquet(str(tmp_path / "late")).collect()} == {"1-1"} and sorted(kept) == ["0-0", "0-5", "1-6", "2-5", "2-7"]


def test_values_run_out(spark, stream, tmp_path):
    out = str(tmp_path / "cache")
    found = jobs.newest_with_expiry(stream, "user_id", "ts", "event_type", "1 hour", "10 minutes")
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cc")).trigger(availableNow=True).start(out).awaitTermination(150)
    rows = spark.read.parquet(out).collect()
    newest = {str(r.user_id): r.t for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t")).collect()}
    assert {r.key for r in rows if r.live} == set(newest) and all(r.at <= newest[r.key] for r in rows) and any(not r.live for r in rows)


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfName,Note\r\n"Ann ""A""","two\nlines"\n,\n')
    (tmp_path / "b.csv").write_bytes("Caf\xe9,1".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.csv_text(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {"a.csv": 'Name | Note\nAnn "A" | two\nlines', "b.csv": "Caf\xe9 | 1"}
    cells = [r.cells for r in files.csv_rows(spark, str(tmp_path / "a.csv")).orderBy("row").collect()]
    assert cells == [["Name", "Note"], ['Ann "A"', "two\nlines"], ["", ""]]
    (tmp_path / "x.xlsx").write_bytes(b"no workbook")
    assert [(r.sheet, r.row) for r in files.xlsx_rows(spark, str(tmp_path / "x.xlsx")).collect()] == [(None, -1)]
    (tmp_path / "p.pdf").write_bytes(b"one|two")
    (tmp_path / "q.pdf").write_bytes(b"x")

    def pages_of(content):
        if content == b"x":
            raise OSError("no pages")
        return content.decode().split("|")

    assert sorted((r.text, r.pages) for r in files.pdf_texts(spark, str(tmp_path / "*.pdf"), pages_of).collect()) == [("", 0), ("one\n\ntwo", 2)]
    names = spark.createDataFrame([("1", "a.pdf", None, "Root/Fees/a.pdf"), ("2", "b.txt", None, "Root/b.txt"), ("3", "c", "text/csv", "Root/fees/c")], "id string, name string, mime string, path string")
    assert [r.id for r in files.readable(names, "fees", ["1"]).collect()] == ["3"]


def test_exports(spark, tmp_path):
    scored = spark.createDataFrame([("a", 1.0), ("b", None)], "case_id string, hit double")
    sinks.report(scored, str(tmp_path / "r"), ["hit"])
    sinks.freeze(spark, str(tmp_path / "r"), str(tmp_path / "base"))
    assert [(r.metric, r.value) for r in spark.read.json(str(tmp_path / "base")).collect()] == [("hit", 1.0)]
    index = spark.createDataFrame([("PM100", "1", "Title: A service of ours\nPM100"), ("PM101", "1", "Title: A service of ours"), ("PM101", "2", "none")], "code string, chunk_id string, chunk_text string")
    assert sinks.lexical_index(index, str(tmp_path / "i")) == {"codes": 2, "rows": 2, "titled": 1}
    assert sinks.index_or_extracts(spark, str(tmp_path / "no"), str(tmp_path / "i"), "code string, chunk_id string, chunk_text string").count() == 3
    assert sinks.index_or_extracts(spark, None, None, "code string").count() == 0
    listing = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a")], "service string, pos int, name string")
    sinks.catalog(listing, str(tmp_path / "cat"), "service", "pos", ["name"])
    row = spark.read.json(str(tmp_path / "cat")).first()
    assert row["count"] == 2 and [x.name for x in row["items"]] == ["a", "b"]
    sinks.table_report(listing, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert sinks.markdown(listing.orderBy("pos"), "Listing").split("\n")[-1] == "| s | 2 | b |"
    sinks.usage(spark.read.parquet(f"{SF}/events.parquet").limit(5), str(tmp_path / "u"))
    sinks.artifacts(spark.createDataFrame([("https://x.org/a", "<p>", "{}")], "url string, html string, extracted string"), str(tmp_path / "art"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 5 and spark.read.parquet(str(tmp_path / "art" / "raw_pages")).first().name == "x_org_a"
