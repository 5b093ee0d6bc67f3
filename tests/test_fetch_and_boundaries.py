"""Pages by origin, learned abbreviations, first places."""

import http.server
import math
import threading
import time
from collections import Counter

from pyspark.sql import functions as F

from millrace.functions import session
from millrace.functions.session import saved
from millrace.operators import boundaries, records
from millrace.sources import fetch


def test_one_origin_fails_and_the_others_stay(spark):
    urls = [(f"http://{h}/{k}",) for h in ("a", "b", "c") for k in range(5)] + [(None,), ("no origin",)]

    def answer(url):
        if url.startswith("http://b/"):
            raise TimeoutError("too slow")
        return (404, "gone") if url.endswith("/3") else (200, None) if url.endswith("/4") else (200, f"body of {url}")

    rows = {r.url: r for r in fetch.pages(spark.createDataFrame(urls, "url string"), answer, delay=0).collect()}
    assert len(rows) == 17 and rows[None].problem == "no address"
    assert all(rows[f"http://b/{k}"].problem == "TimeoutError: too slow" and rows[f"http://b/{k}"].html is None for k in range(5))
    assert (rows["http://a/1"].status, rows["http://a/1"].html, rows["http://a/1"].problem) == (200, "body of http://a/1", None)
    assert (rows["http://c/3"].status, rows["http://c/3"].html, rows["http://c/3"].problem) == (404, None, "status 404")
    assert (rows["http://c/4"].html, rows["http://c/4"].problem) == (None, None)


def test_an_origin_has_pauses_and_order(spark):
    urls = spark.createDataFrame([(f"http://{h}/{k}",) for k in range(3) for h in ("a", "b")], "url string")
    rows = fetch.pages(urls, lambda url: (200, str(time.time())), delay=0.3).collect()
    for h in ("a", "b"):
        at = [float(r.html) for r in sorted((r for r in rows if r.url.startswith(f"http://{h}/")), key=lambda r: r.url)]
        assert all(y - x >= 0.29 for x, y in zip(at, at[1:], strict=False))


def test_robots_rules_are_asked_first(spark):
    urls = spark.createDataFrame([("http://a/x/1",), ("http://a/2",), ("http://b/1",)], "url string")
    policies = spark.createDataFrame([("http://a", 200, "User-agent: *\nDisallow: /x/"), ("http://b", 401, None)], "origin string, status int, body string")

    def answer(url):
        assert url == "http://a/2"
        return 200, "ok"

    assert {r.url: r.problem for r in fetch.pages(urls, answer, 0, policies=policies).collect()} == {"http://a/x/1": "robots rules forbid it", "http://a/2": None, "http://b/1": "robots rules forbid it"}


def test_fetching_from_a_server(spark):
    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(500 if self.path == "/bad" else 200)
            self.send_header("Content-Type", "text/html; charset=iso-8859-1")
            self.end_headers()
            self.wfile.write(f"é {self.path} {self.headers['User-Agent']}".encode("latin-1"))

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    rows = {r.url: r for r in saved(fetch.pages(spark.createDataFrame([(f"{base}/a",), (f"{base}/bad",), ("http://127.0.0.1:1/x",)], "url string"), fetch.web(5, "me/1"), 0), "f").collect()}
    server.shutdown()
    assert rows[f"{base}/a"].html == "é /a me/1" and rows[f"{base}/bad"].problem == "status 500" and "URLError" in rows["http://127.0.0.1:1/x"].problem


TEXT = "Dr. Obura met Mr. Otieno on Mon. and left. He had pain (e.g. A headache). Dr. Obura said rest. Mr. Otieno went home. We rest. They left. All went home. A nurse came. Dr. Wanja wrote. The rest stayed at home with us and left early "


def test_abbreviations_are_learned(spark):
    docs = spark.createDataFrame([(1, TEXT * 3), (2, "Mr. Kamau is here. Dr. Njeri left."), (3, None), (4, ""), (5, "No stop at all")], "doc_id long, text string")
    known = {r.word: r for r in boundaries.abbreviations(docs).collect()}
    assert {"dr", "mr", "e.g"} <= set(known) and not {"left", "home", "rest"} & set(known)
    tokens = [x for _, s in ((1, TEXT * 3), (2, "Mr. Kamau is here. Dr. Njeri left."), (5, "No stop at all")) for x in s.split()]
    stops = sum(x.rstrip(")").endswith(".") for x in tokens)
    n = Counter(x.lower().strip("().") for x in tokens)
    assert known["dr"].n == n["dr"] and known["dr"].n_stop == n["dr"]
    p, k = stops / len(tokens), n["dr"]
    assert math.isclose(known["dr"].score, -2 * k * (math.log(p) - math.log(0.99)) * math.exp(-2), rel_tol=1e-9)
    got = boundaries.sentences(docs, ["doc_id"], boundaries.abbreviations(docs)).where("doc_id > 1").orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.text) for r in got] == [(2, 0, "Mr. Kamau is here."), (2, 1, "Dr. Njeri left."), (3, 0, ""), (4, 0, ""), (5, 0, "No stop at all")]
    assert boundaries.abbreviations(docs.where("doc_id > 2")).count() == 0 and boundaries.abbreviations(docs.limit(0)).count() == 0


def test_first_places_hash_and_do_not_sort(spark):
    rows = [(k * 7 % 50 - 20, k % 5 - 2, f"key {k % 13}" if k % 9 else None) for k in range(300)] + [(1 << 60, 2, "far"), (-(1 << 60), -(1 << 31), "far"), (5, (1 << 31) - 1, "lone")]
    df = spark.createDataFrame(rows, "a long, b int, k string")
    got = sorted((r.a, r.b) for r in records.first_places(df, ["k"], ["a", "b"]).collect())
    want = {}
    for a, b, k in rows:
        want[k] = min(want.get(k, (a, b)), (a, b))
    assert got == sorted(want.values())
    assert got == sorted((r.a, r.b) for r in records.first_per(df, ["k"], ["a", "b"]).collect())
    plan = records.first_places(df, ["k"], ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_caps_that_differ_by_key(spark):
    df = spark.range(400).select((F.col("id") % 4).alias("k"), "id", F.when(F.col("id") % 4 < 3, F.col("id") % 4 * 5).alias("most"))
    got = Counter(r.k for r in records.cap_per(df, ["k"], ["id"], F.col("most")).collect())
    assert got == {1: 5, 2: 10, 3: 100}
    assert sorted(r.id for r in records.cap_per(df, ["k"], ["id"], F.col("most")).where("k = 2").collect()) == [2 + 4 * k for k in range(10)]
    assert Counter(r.k for r in records.cap_per(df, ["k"], ["id"], 3).collect()) == {0: 3, 1: 3, 2: 3, 3: 3}


def test_sweep_deletes_what_scratch_gave(spark, monkeypatch):
    monkeypatch.setattr(session, "_GIVEN", [])
    df = saved(spark.range(5), "some")
    session.scratch(spark, "never-written")
    assert df.count() == 5 and len(session._GIVEN) == 2
    assert session.sweep(spark) == 1 and session._GIVEN == []
    assert session.sweep(spark) == 0


def test_keys_with_nulls_stay_apart(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, None, None), (4, "a", "a"), (5, "", None), (6, "a", None)], "n int, x string, y string")
    assert sorted(r.n for r in records.first_per(df, ["x", "y"], ["n"]).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.n for r in records.first_per(df, [F.upper("x")], ["n"]).collect()) == [1, 2, 5]
