"""Crawls over the web: a local server, redirects, caps by listing, and going on after a stop."""

import collections
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quarrylight import cli
from quarrylight.operators import crawl
from quarrylight.sources.tables import Table


def links(*targets):
    return "<html><body>" + "".join(f'<a href="{t}">x</a>' for t in targets) + "</body></html>"


PAGES = {
    "/": links("/news/", "/old/", "/broken/", "https://elsewhere.example/", "mailto:a@b.c", "/cart/"),
    "/news/": links("/news/a/", "/news/b/", "/news/page/2/"),
    "/news/page/2/": links("/news/c/", "/news/d/", "/news/a/"),
    "/news/a/": links("/deep/"),
    "/news/b/": links("/"),
    "/news/c/": links(),
    "/news/d/": links(),
    "/new/": links("/from-new/"),
    "/from-new/": links(),
    "/deep/": links(),
}


@pytest.fixture(scope="module")
def site():
    asked, broken = collections.Counter(), {"on": True}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            asked[self.path] += 1
            if self.path == "/old/":
                self.send_response(301)
                self.send_header("Location", "/new/")
                self.end_headers()
                return
            body = PAGES.get(self.path, "").encode()
            self.send_response(200 if body and not (self.path == "/news/c/" and broken["on"]) else 404)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_command_crawls_a_site(spark, site, tmp_path):
    base, asked = site
    asked.clear()
    argv = ["crawl", "--seed", base, "--domains", base[7:], "--store", str(tmp_path), "--levels", "2", "--delay", "0"]
    got = {r.url[len(base) :]: r for r in cli.run(spark, argv).collect()}
    assert {u: r.level for u, r in got.items()} == {"/": 0, "/news/": 1, "/old/": 1, "/new/": 1, "/broken/": 1, "/news/a/": 2, "/news/b/": 2, "/news/page/2/": 2, "/from-new/": 2}
    assert got["/old/"].final_url == got["/new/"].url and got["/new/"].found_on == base + "/old/" and got["/from-new/"].found_on == base + "/new/"
    assert got["/broken/"].status == 404 and got["/news/a/"].found_on == base + "/news/"
    assert all(n == 1 for u, n in asked.items() if u != "/broken/"), asked
    before = dict(asked)
    deeper = {r.url[len(base) :]: r.level for r in cli.run(spark, [*argv[:-4], "--levels", "3", "--delay", "0"]).collect()}
    # a deeper crawl goes on: nothing that came before is asked for again
    assert deeper == {u: r.level for u, r in got.items()} | {"/deep/": 3, "/news/c/": 3, "/news/d/": 3}
    assert dict(asked) == before | {"/deep/": 1, "/news/c/": 1, "/news/d/": 1}
    with pytest.raises(ValueError, match="seed"):
        cli.run(spark, ["crawl", "--store", str(tmp_path)])


def pages_of(spark, pages):
    """A boundary without a network: (url, status, final_url, html) of addresses, counting what was asked for."""
    table = spark.createDataFrame([(f"https://s.example{u}", *v) for u, v in pages.items()], "url string, status int, final_url string, html string")
    asked = []

    def fetch(wanted):
        asked.append(sorted(r.url for r in wanted.collect()))
        return table.join(wanted, "url")

    return fetch, asked


def test_a_listing_is_capped_over_all_its_pages(spark):
    pages = {"/l/": (200, None, links("/a/", "/b/", "/l/page/2/")), "/l/page/2/": (200, None, links("/c/", "/d/", "/e/")), "/a/": (200, None, "x"), "/b/": (200, None, "x"), "/c/": (200, None, "x")}
    fetch, asked = pages_of(spark, pages)
    seeds = spark.createDataFrame([("https://s.example/l",)], "url string")
    got = {r.url[17:]: (r.level, r.status) for r in crawl.crawl_live(seeds, fetch, 3, 4).collect()}
    assert got == {"/l/": (0, 200), "/a/": (1, 200), "/b/": (1, 200), "/l/page/2/": (1, 200), "/c/": (2, 200)}


def test_a_stopped_crawl_goes_on(spark, tmp_path):
    pages = {"/": (200, None, links("/a/", "/b/")), "/a/": (200, None, links("/c/")), "/b/": (200, "https://s.example/a/", links("/c/")), "/c/": (0, None, None)}
    state = Table(spark, str(tmp_path / "state"), crawl.SEEN, key="url")
    seeds = spark.createDataFrame([("s.example",), ("https://s.example/",)], "url string").filter(F.col("url").startswith("http"))
    fetch, asked = pages_of(spark, pages)

    def stops(wanted):
        if len(asked) == 1:
            raise OSError("stopped")
        return fetch(wanted)

    with pytest.raises(OSError):
        crawl.crawl_live(seeds, stops, 2, state=state)
    assert sorted((r.url, r.status) for r in state.read().collect()) == [("https://s.example/", 200), ("https://s.example/a/", None), ("https://s.example/b/", None)]
    crawl.crawl_live(seeds, fetch, 2, state=state)
    again = {r.url: (r.status, r.final_url) for r in crawl.crawl_live(seeds, fetch, 2, state=state).collect()}
    # what did not come is asked for again, nothing else is
    assert asked == [["https://s.example/"], ["https://s.example/a/", "https://s.example/b/"], ["https://s.example/c/"], ["https://s.example/c/"]]
    assert again["https://s.example/b/"] == (200, "https://s.example/a/") and again["https://s.example/c/"][0] == 0
