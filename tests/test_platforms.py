"""Polling sources against a fake server that speaks both platforms' languages."""

import json
import threading
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from loomgraph.sources import log_source, platforms
from loomgraph.streaming import ingest as ing

HOUR = 3_600_000
START = 1_704_067_200_000


class Server(ThreadingHTTPServer):
    """deployments: by id their logs, (ms, level, message, row id or None), in order."""

    def __init__(self):
        self.deployments, self.now, self.broken, self.asked = {}, START, 0, []
        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server_address[1]}"


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def date_time_string(self, timestamp=None):
        return super().date_time_string(self.server.now / 1000)

    def answer(self, body, code=200):
        raw = body if isinstance(body, bytes) else json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def refused(self):
        s = self.server
        s.asked.append((self.path, self.headers["Authorization"]))
        if s.broken:
            s.broken -= 1
            self.answer({"error": "later"}, 503)
            return True
        if self.headers["Authorization"] != "Bearer key":
            self.answer({"error": "who"}, 403)
            return True

    def do_GET(self):
        if self.refused():
            return
        s, at, q = self.server, urlparse(self.path), parse_qs(urlparse(self.path).query)
        if at.path == "/v6/deployments":
            limit, until = min(int(q["limit"][0]), 2), int(q.get("until", [1 << 60])[0])
            found = sorted(((min([x[0] for x in v], default=START), k) for k, v in s.deployments.items()), reverse=True)
            page = [x for x in found if x[0] < until][:limit]
            more = any(x[0] < page[-1][0] for x in found) if page else False
            self.answer({"deployments": [{"uid": k, "created": c - 1, "state": "READY", "url": f"{k}.x", "meta": {"githubCommitSha": "c" + k}} for c, k in page], "pagination": {"next": page[-1][0] if more else None}})
        else:
            lines = s.deployments[at.path.split("/")[-2]]
            self.answer(b"not json\n\n" + b"\n".join(json.dumps({"timestampInMs": t, "level": w, "message": m, "rowId": i, "responseStatusCode": 500}).encode() for t, w, m, i in lines if t <= s.now) + b"\n[1]\n")

    def do_POST(self):
        if self.refused():
            return
        s, body = self.server, json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        v = body["variables"]
        iso = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        if "me {" in body["query"]:
            self.answer({"data": {"me": {"name": "x"}}})
        elif "deployments(" in body["query"]:
            ids = sorted(s.deployments)
            at = ids.index(v["after"]) + 1 if v["after"] else 0
            page = ids[at : at + 2]
            nodes = [{"node": {"id": k, "status": "CRASHED", "createdAt": iso(min([x[0] for x in s.deployments[k]], default=START) - 1), "meta": {"branch": "main"}}} for k in page]
            self.answer({"data": {"deployments": {"edges": nodes, "pageInfo": {"hasNextPage": at + 2 < len(ids), "endCursor": page[-1] if page else None}}}})
        elif v["deploymentId"] == "bad":
            self.answer({"errors": [{"message": "no such thing"}]})
        else:
            since = platforms._ms(v["startDate"])
            found = [x for x in s.deployments[v["deploymentId"]] if since <= x[0] <= s.now][: v["limit"]]
            self.answer({"data": {"deploymentLogs": [{"timestamp": iso(t), "severity": w, "message": m} for t, w, m, _ in found]}})


@pytest.fixture
def server(monkeypatch):
    monkeypatch.setattr(platforms, "PAUSES", (0.01, 0.01))
    s = Server()
    yield s
    s.shutdown()


def source(server, platform="p1", **more):
    return {"name": platform, "platform": platform, "url": server.url, "project": "shop", "service": "web", "token": "key", **more}


def filled(server):
    words = ("error", "warning", "log")
    for d in range(5):
        server.deployments[f"d{d}"] = [(START + d * HOUR + 1000 * i, words[i % 3], f"m{i}", f"d{d}-{i}") for i in range(30)]
    server.deployments["empty"] = []
    server.now = START + 10 * HOUR


@pytest.mark.parametrize("name", ["p1", "p2"])
def test_adapters_page_through_all(server, name):
    filled(server)
    p = platforms.platform(source(server, name))
    assert {d["id"] for d in p.deployments()} == set(server.deployments) and p.horizon() == server.now
    got = list(p.logs("d1", START + HOUR + 5000, START + HOUR + 20_000))
    assert [x["timestamp"] for x in got] == [START + HOUR + 1000 * i for i in range(6, 21)] and len({x["id"] for x in got}) == 15
    assert p.check()["ok"] and not platforms.platform(source(server, name, token="no")).check()["ok"]


def test_pages_of_equal_times_and_repeated_lines(server):
    """More lines of one time than a page holds, equal ones among them."""
    server.deployments["d"] = [(START, "info", "same", None)] * 700 + [(START, "info", f"m{i}", None) for i in range(700)] + [(START + 1, "info", "later", None)] * 3
    server.now = START + 5
    for name in ("p1", "p2"):
        got = list(platforms.platform(source(server, name)).logs("d", START - 1, START + 5))
        assert len(got) == len({x["id"] for x in got}) == 1403
        again = list(platforms.platform(source(server, name)).logs("d", START, START + 5))
        assert [x["message"] for x in again] == ["later"] * 3


def test_failures(server):
    filled(server)
    server.broken = 2
    assert len(list(platforms.platform(source(server)).deployments())) == 6
    server.broken = 9
    with pytest.raises(RuntimeError, match="503"):
        list(platforms.platform(source(server)).deployments())
    server.broken = 0
    with pytest.raises(RuntimeError, match="no such thing"):
        list(platforms.platform(source(server, "p2")).logs("bad", 0, 1))
    with pytest.raises(ValueError, match="unknown platform"):
        platforms.platform({"platform": "x"})


def test_an_adapter_of_ones_own():
    @platforms.adapter("own")
    class Own(platforms.Platform):
        def deployments(self):
            return iter([{"id": "a", "created": 5}])

    try:
        assert platforms.platform({"platform": "own"}).check() == {"ok": True, "newest": 5}
    finally:
        del platforms.ADAPTERS["own"]


def test_batch(spark, server):
    filled(server)
    both = [source(server), source(server, "p2")]
    rows = log_source.logs(spark, both).collect()
    assert len(rows) == 300 and {(r.source, r.level) for r in rows} >= {("p1", "error"), ("p1", "warn"), ("p1", "info"), ("p2", "error")}
    assert {r.metadata["status"] for r in rows if r.source == "p1"} == {"500"} and {r.metadata["service"] for r in rows if r.source == "p2"} == {"web"}
    some = log_source.logs(spark, both, since=START + HOUR, until=START + HOUR + 2000).collect()
    assert len(some) == 4
    d = {(r.source, r.deployment_id): r for r in log_source.deployments(spark, both).collect()}
    assert len(d) == 12 and d["p1", "d1"].status == "ready" and d["p1", "d1"].commit_sha == "cd1" and d["p2", "d1"].branch == "main"
    with pytest.raises(Exception, match="unknown platform"):
        log_source.logs(spark, [source(server) | {"platform": "x"}]).collect()
    with pytest.raises(Exception, match="none twice"):
        log_source.logs(spark, [source(server), source(server)]).collect()
    server.deployments.clear()
    assert log_source.logs(spark, both).count() == 0


def test_stream_goes_on_after_a_restart(spark, server, tmp_path):
    """Each line once, over runs that end, new lines of old and new deployments, a source that joins later, and a run that failed."""
    filled(server)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drain(*sources):
        ing.to_files(log_source.logs(spark, list(sources), streaming=True), out, state).awaitTermination()
        return sorted((r.source, r.deployment_id, r.ts, r.message) for r in spark.read.parquet(out).collect())

    first = source(server)
    server.now = START + 2 * HOUR + 10_000
    got = drain(first)
    assert len(got) == 30 + 30 + 11
    server.now = START + 3 * HOUR
    server.deployments["d0"].append((START + 2 * HOUR + 10_500, "error", "late in an old deployment", "x"))
    got = drain(first)
    assert len(got) == len(set(got)) == 90 + 1 + 1
    server.broken = 50
    with pytest.raises(Exception):
        drain(first)
    server.broken, server.now = 0, START + 10 * HOUR
    server.deployments["new"] = [(START + 9 * HOUR, "warn", "n", "n1")]
    got = drain(first, source(server, "p2"))
    assert len(got) == len(set(got)) == 2 * (150 + 1 + 1)
    assert drain(first, source(server, "p2")) == got
