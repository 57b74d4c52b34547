"""JSON APIs as batches and streams, against a local server."""

import collections
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from quarrylight import cli
from quarrylight.sources import api


@pytest.fixture(scope="module")
def server():
    asked, logs, failing = collections.Counter(), collections.defaultdict(list), {"n": 1}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            path, q = urlsplit(self.path).path, {k: int(v[0]) for k, v in parse_qs(urlsplit(self.path).query).items()}
            asked[path, q.get("page", q.get("offset"))] += 1
            status, said = 200, {}
            if path == "/items":  # 23 rows of ten a page; pages beyond the last repeat it
                page = min(q["page"], 3)
                said = {"data": {"list": [{"id": i, "name": f"n{i}", "more": {"x": i}} for i in range(10 * page - 10, min(10 * page, 23))]}}
            elif path == "/flaky":
                failing["n"] += 1
                status, said = (503, {}) if failing["n"] == 2 else (200, {"data": {"list": [{"id": 1}] if q["page"] == 1 else []}})
            elif path == "/empty":
                said = {"data": None}
            elif path.startswith("/chats/"):
                log = logs[path]
                said = {"total": len(log), "messages": log[q["offset"] : q["offset"] + q["limit"]]}
            else:
                status = 404
            data = json.dumps(said).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", asked, logs
    made.shutdown()


def listed(spark, base, path, schema, **options):
    return api.registered(spark).read.format("json_api").schema(schema).options(url=f"{base}{path}?page={{page}}", rows="data.list", wait="0.01", **options).load()


def test_pages_until_nothing_is_new(spark, server):
    base, asked, _ = server
    asked.clear()
    rows = listed(spark, base, "/items", "id long, name string, more string, payload string, absent double").collect()
    assert sorted(r.id for r in rows) == list(range(23))
    assert rows[3].more == '{"x": 3}' and json.loads(rows[3].payload)["name"] == "n3" and rows[3].absent is None
    assert {p for _, p in asked} == {1, 2, 3, 4}
    asked.clear()
    assert listed(spark, base, "/items", "id long", size="10").count() == 23 and {p for _, p in asked} == {1, 2, 3}
    assert listed(spark, base, "/items", "id long", most="2").count() == 20
    assert listed(spark, base, "/empty", "id long").count() == 0


def test_failures_are_tried_again(spark, server):
    assert [r.id for r in listed(spark, server[0], "/flaky", "id long").collect()] == [1]
    with pytest.raises(Exception, match="404"):
        listed(spark, server[0], "/none", "id long").collect()


def test_a_stream_goes_on_where_it_stopped(spark, server, tmp_path):
    base, asked, logs = server
    for n in (1, 2):
        logs[f"/chats/{n}"][:] = [{"id": 100 * n + i, "body": f"b{i}"} for i in range(25)]

    def run():
        stream = api.registered(spark).readStream.format("json_api").schema("endpoint string, id long, body string").options(url=base + "/{endpoint}?offset={offset}&limit={limit}", endpoints='["chats/1", "chats/2"]', rows="messages", size="7", span="10").load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).start(str(tmp_path / "out"))
        query.processAllAvailable()
        query.stop()
        return sorted((r.endpoint, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(f"chats/{n}", 100 * n + i) for n in (1, 2) for i in range(25)]
    asked.clear()
    logs["/chats/2"] += [{"id": 900 + i, "body": "late"} for i in range(3)]
    assert run()[-3:] == [("chats/2", 900), ("chats/2", 901), ("chats/2", 902)] and len(run()) == 53
    # only totals (from 0) and what is new were asked for
    assert {at for _, at in asked} == {0, 25} and asked["/chats/2", 25] == 1


def test_commands_read_apis(spark, server, tmp_path):
    base, _, logs = server
    logs["/chats/7"][:] = [{"message_id": i, "body": f"Message {i} about the fee for PM1234", "sent_at": f"2024-01-01T10:0{i}:00Z", "deleted": False, "from_me": False} for i in range(4)]
    argv = ["--url", base + "/{endpoint}?offset={offset}&limit={limit}", "--endpoint", "chats/7", "--rows", "messages", "--key", "message_id", "--store", str(tmp_path), "--dim", "16"]
    got = cli.run(spark, ["whatsapp-sync", *argv]).collect()
    assert [r.chat_id for r in got] == ["chats/7"] * 4
    assert cli.run(spark, ["whatsapp-ingest", *argv])["new"] == 1
    scanned = cli.run(spark, ["api-scan", "--url", base + "/items?page={page}", "--rows", "data.list", "--store", str(tmp_path)])
    assert scanned.count() == 23 and scanned.columns == ["endpoint", "payload"]
