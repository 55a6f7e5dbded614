from pyspark.sql import functions as F

from halyard.llm.warc import canonical_url, resolve_revisits, with_bodies

SCHEMA = ("record_id long, url string, ts long, type string, etag string, last_modified string, digest string, "
          "n_chars long, headers map<string,string>, status string")


def rec(i, url, ts, kind, etag=None, mod=None, digest=None, headers=None):
    return (i, url, ts, kind, etag, mod, digest, 7 if kind == "response" else None, headers, "x")


def test_canonical(spark):
    urls = {"HTTP://WWW.Ex.org:80/a/?b=2&a=1#f": "ex.org/a?a=1&b=2", "https://ex.org/a?a=1&b=2": "ex.org/a?a=1&b=2",
            "https://ex.org": "ex.org", "https://ex.org/#top": "ex.org", "ex.org/A?": "ex.org/A", "": "", "?": ""}
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in rows.select("u", canonical_url(F.col("u")).alias("c")).collect()} == urls


def test_as_of_validators_and_headers(spark):
    u = "http://a.org/x"
    rows = [rec(1, u, 10, "response", '"e1"', "m1", "d1", {"etag": '"e1"', "content-length": "7", "age": "1"}),
            rec(2, u, 20, "response", '"e2"', None, "d2", None), rec(3, u, 20, "response", '"e3"', "m3", "d3", {}),
            rec(4, u + "#f", 15, "revisit", 'W/"e1"', headers={"age": "5", "content-length": "0", "new": "n", "void": None}),
            rec(5, u, 20, "revisit", '"e1"'), rec(6, u, 25, "revisit", '"e2"'), rec(7, u, 25, "revisit", None, "m3"),
            rec(8, u, 10, "revisit", '"e1"'), rec(9, u, 200_000, "revisit", None, None, "d3"), rec(10, u, 300_000, "revisit"),
            rec(11, None, 5, "revisit", '"e1"'), rec(12, u, None, "revisit", '"e1"'), rec(13, "http://b.org", 99, "revisit"),
            rec(14, u, 26, "request"), rec(4, u + "#f", 15, "revisit", 'W/"e1"', headers={"age": "5", "content-length": "0", "new": "n"})]
    frame = spark.createDataFrame(rows, SCHEMA)
    for width in (1, 7, 86_400, 10 ** 9):
        got = {}
        for r in resolve_revisits(frame, width).collect():
            got.setdefault(r.record_id, []).append(r)
        assert {i: (x[0].status, x[0].response_id) for i, x in got.items()} == {
            4: ("resolved", 1), 5: ("resolved", 1), 6: ("mismatch", 3), 7: ("resolved", 3), 8: ("no_response", None),
            9: ("resolved", 3), 10: ("no_validator", 3), 11: ("no_response", None), 12: ("no_response", None),
            13: ("no_response", None)}
        assert len(got[4]) == 2 and got[4][0].headers == {"etag": '"e1"', "content-length": "7", "age": "5", "new": "n"}
        assert got[6][0].headers is None and got[7][0].headers == {}
    bodies = spark.createDataFrame([(1, "body")], "record_id long, html string")
    assert with_bodies(resolve_revisits(frame), bodies, "html").filter("body = 'body'").count() == 3
    assert resolve_revisits(frame.filter("false")).count() == 0


def test_hot_url_equals_a_plain_scan(spark):
    rows = [rec(k, "h.org/" if k % 3 else f"o.org/{k}", (k * 7919) % 5000, "response" if k % 4 == 0 else "revisit", f"e{k % 5}")
            for k in range(2000)]
    got = {r.record_id: (r.status, r.response_id) for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA), 100).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[1].rstrip("/"), []).append(r)
    for r in rows:
        if r[3] == "revisit":
            best = max(((x[2], x[0], x[4]) for x in by[r[1].rstrip("/")] if x[3] == "response" and x[2] < r[2]), default=None)
            want = ("no_response", None) if best is None else ("resolved" if best[2] == r[4] else "mismatch", best[1])
            assert got[r[0]] == want
