"""Press releases, events, curated records and case studies: what is read of them and what the commands do."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quarrylight import cli, config
from quarrylight.operators import announcements

SF = "/root/testdata/sf0.001"
BASE = "https://www.example.com/announcement"


def page(record, lines, h1="", tail="<p>View article</p><p>More that is not part of the text at all, however long it is.</p>"):
    script = "<script>self.push(" + json.dumps(json.dumps(record, separators=(",", ":"))) + ")</script>" if record else ""
    return f"<html><body><nav><p>Home</p></nav>{script}<h1>{h1}</h1>" + "".join(f"<p>{x}</p>" for x in lines) + tail + "</body></html>"


PRESS = ["The Daily Line", "2026-06-09", "We have launched a platform for Business Banking &amp; more, which does a lot of things. Read More", "short crumb", "A second paragraph of the release that has enough characters to count as text."]
PAGES = [
    (f"{BASE}/press-releases/new-platform", page({"slug": "new-platform", "type": "press", "title": "New platform", "date": "2026-06-09", "location": "The Daily Line", "description": "$12"}, PRESS, "New platform")),
    (f"{BASE}/press-releases/bare-page/", page(None, PRESS, "Bare &amp; page")),
    (f"{BASE}/events/summit", page({"slug": "summit", "type": "archived", "title": "The summit", "date": "2024-02-21", "startTime": "12:00:00", "endTime": "14:00:00", "location": "Town", "partners": ["One", {"name": "Two"}, {"title": "Three"}, " "], "description": "What was said at the summit, in a few words that are many enough."}, [], "The summit")),
    (f"{BASE}/events/soon", page({"slug": "soon", "type": "upcoming event", "title": "Soon", "description": "Will be held at some time that is to come, so much is sure."}, [], "Soon")),
    (f"{BASE}/events/flagged", page({"slug": "flagged", "type": "x", "title": "Flagged", "isUpcomingEvents": True}, [], "Flagged")),
    (f"{BASE}/events/form", page(None, ["Notify Me"], "Form", "")),
    (f"{BASE}/press-releases/empty", page(None, [], "Empty", "")),
    ("https://www.example.com/contact-us", page(None, PRESS, "No announcement")),
]


@pytest.fixture(scope="module")
def told(spark):
    rows = announcements.details(spark.createDataFrame(PAGES, "url string, html string")).collect()
    return {r.url.rstrip("/").rsplit("/", 1)[-1]: r for r in rows}


def test_details(told):
    assert set(told) == {"new-platform", "bare-page", "summit", "soon", "flagged", "form", "empty"}
    r = told["new-platform"]
    assert (r.kind, r.title, r.date, r.place, r.partners, r.problem) == ("press_release", "New platform", "2026-06-09", "The Daily Line", None, None)
    # a short first line is no text; what follows is, less crumbs and what ends articles
    assert r.body == "We have launched a platform for Business Banking & more, which does a lot of things. \n\nA second paragraph of the release that has enough characters to count as text."
    assert told["bare-page"].title == "Bare & page" and told["bare-page"].body == r.body
    e = told["summit"]
    assert (e.kind, e.date, e.time, e.place, e.partners) == ("event", "2024-02-21", "12:00:00 – 14:00:00", "Town", ["One", "Two", "Three"])
    assert e.body.startswith("What was said") and e.problem is None
    assert {k: told[k].problem for k in ("soon", "flagged", "form", "empty")} == {"soon": "an event to come", "flagged": "an event to come", "form": "a form", "empty": "no text"}


def test_lines_match_a_loop(spark):
    """The state machine over whole documents against a loop, line by line."""

    def plain(lines, name):
        at = next((i for i, x in enumerate(lines) if name and (name in x.lower() or x.lower() in name)), None)
        if at is None:
            return [x for x in lines if len(x) >= 80][:12]
        body = []
        for x in lines[at + 1 :]:
            if any(x.lower().startswith(s) for s in config.ANNOUNCEMENT_ENDS):
                break
            if len(x) < 40 and body:
                if (len(body[0]) < 60 and len(body) <= 2) or re.match(r"\d{4}-\d{2}-\d{2}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}", x):
                    body.append(x)
                continue
            if len(x) < 20 and not body:
                continue
            body.append(x)
            if len(body) >= 40:
                break
        return body

    odd = [(-1, "Title\n" + "\n".join(f"2024-05-0{i % 9} short" if i % 3 else f"A line of the text, the {i}th, that is long enough." for i in range(99))), (-2, None), (-3, "Title\nsome words in a short line\nMay 1, 2024\nView article now\nnever seen in the result at all, though it is long"), (-4, "Title")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.trim), lambda x: x != "")
    rows = docs.select("doc_id", lines.alias("lines")).withColumn("name", F.lower(F.coalesce(F.get("lines", F.lit(0)), F.lit("")))).withColumn("taken", announcements.taken_lines(F.col("lines"), F.col("name"))).collect()
    assert len(rows) > 200
    for r in rows:
        assert r.taken.lines == plain(r.lines, r.name), r.doc_id
    assert {r.doc_id: len(r.taken.lines) for r in rows}[-1] == 42  # dates count, but do not end it


def test_visible_lines(spark):
    html = "<style>a{}</style><script>var x = '<p>no</p>';</script><p> one &amp;&nbsp;two<br>three</p><!-- <p>gone</p> --><noscript>off</noscript><ul><li>four<li> </ul>"
    assert spark.createDataFrame([(html,), (None,)], "h string").select(announcements.visible_lines(F.col("h")).alias("l")).collect()[0].l == ["one & two".replace("& ", "&\xa0"), "three", "four"]


def run(spark, tmp_path, command, df, *more):
    path = str(tmp_path / command)
    df.write.mode("overwrite").parquet(path)
    return cli.run(spark, [command, "--input", path, "--store", str(tmp_path / "store"), "--dim", "16", *more])


def test_commands(spark, tmp_path):
    got = run(spark, tmp_path, "announcement-content-ingest", spark.createDataFrame(PAGES, "url string, html string"))
    assert got["new"] == 3 and got["left_out"] == {"an event to come": 2, "a form": 1, "no text": 1}
    records = [("bio", "Ann Example", "CEO", "Founded it.", None, None, None, None), ("qa", None, None, None, "Who?", "Ann.", None, None), ("press", None, None, None, None, None, "In the news", "A lot was said.")]
    team = spark.createDataFrame(records, "kind string, name string, role string, bio string, question string, answer string, title string, summary string")
    assert run(spark, tmp_path, "team-leadership-ingest", team, "--required", "Ann Example", "--questions", "1")["new"] == 3
    for wrong in (("--required", "Bob", "--questions", "1"), ("--required", "Ann Example", "--questions", "2")):
        with pytest.raises(ValueError):
            run(spark, tmp_path, "team-leadership-ingest", team, *wrong)
    node = lambda kind, said: {"type": kind, "children": [{"type": "text", "text": said}]}
    first = {"title": "A case", "industry": {"name": "Finance"}, "description": [node("heading", "Challenge"), node("paragraph", "The client needed a structure of two entities for holding and operations."), node("heading", "Solution"), node("paragraph", "We designed one with clear pathways for licences and banking.")]}
    second = {"title": "Another", "description": [node("paragraph", "A first paragraph about warehouses and customs, long enough."), node("paragraph", "A second paragraph about outcomes for partners, long enough.")]}
    studies = spark.createDataFrame([("https://www.example.com/case-studies/a", json.dumps(first)), ("https://www.example.com/case-studies/b", json.dumps({"attributes": second}))], "key string, payload string")
    assert run(spark, tmp_path, "case-study-ingest", studies)["new"] == 2
    kept = cli.run(spark, ["inspect", "--store", str(tmp_path / "store"), "--dim", "16"])
    assert kept["state"] == {"new": 8}
    from quarrylight.engine import VectorStore

    rows = VectorStore(spark, str(tmp_path / "store" / "chunks"), 16).rows().collect()
    assert {"Challenge", "Solution"} <= {r.heading_path.split(" > ")[-1] for r in rows} and {r.page_kind for r in rows} == {"press_release", "event", "leadership", "case_study"}
