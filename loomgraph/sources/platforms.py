"""Platforms that keep deployments and their logs, and how to ask them. Adapters are found by name; `adapter` adds one.

An adapter asks for whole pages until there are no more and passes lines on as they come, so that no answer is held as a whole. A failed request is tried
again after growing pauses; then the error goes up, as a page that is left out would be a silent gap.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from typing import Any

import pyarrow.fs as pafs

#: Deployments and log lines of a page; seconds until a request counts as failed, and before it is tried again.
DEPLOYMENTS, LINES, TIMEOUT, PAUSES = 100, 500, 30, (0.5, 2.0, 8.0)

ADAPTERS: dict[str, type[Platform]] = {}


def adapter(name: str):
    """Makes a class the adapter of a platform of this name."""

    def add(cls: type[Platform]) -> type[Platform]:
        ADAPTERS[name] = cls
        return cls

    return add


def platform(config: dict[str, Any]) -> Platform:
    """The adapter of a source: config has platform, and what that needs."""
    name = config.get("platform")
    if name not in ADAPTERS:
        raise ValueError(f"unknown platform {name!r}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name](config)


class Platform:
    """A source's platform. Times are milliseconds since 1970."""

    def __init__(self, config: dict[str, Any]):
        self.config = config

    def horizon(self) -> int:
        """The time up to which logs are complete now."""
        raise NotImplementedError

    def deployments(self) -> Iterator[dict[str, Any]]:
        """id, state, created, ready, branch, commit, url; of several of one id the platform's last word comes last. first and last bound its logs, where known."""
        raise NotImplementedError

    def logs(self, deployment: str, since: int, until: int) -> Iterator[dict[str, Any]]:
        """id, timestamp, type, message, function, metadata of the lines after since, up to until."""
        raise NotImplementedError

    def check(self) -> dict[str, Any]:
        """Whether the platform answers: ok, with the newest deployment's time, or else the error."""
        try:
            newest = max((d["created"] or 0 for d in self.deployments()), default=None)
            return {"ok": True, "newest": newest}
        except Exception as e:
            return {"ok": False, "error": str(e)}

    # requests

    def _open(self, path: str, body: dict | None = None):
        headers = {"Authorization": f"Bearer {self.config.get('token', '')}", "Content-Type": "application/json"}
        data = None if body is None else json.dumps(body).encode()
        for pause in (*PAUSES, None):
            try:
                return urllib.request.urlopen(urllib.request.Request(self.config["url"].rstrip("/") + path, data, headers), timeout=TIMEOUT)
            except urllib.error.HTTPError as e:
                # the platform is busy or broken; other refusals stay what they are
                if pause is None or e.code != 429 and e.code < 500:
                    raise RuntimeError(f"{path.partition('?')[0]}: {e.code} {e.read(500).decode(errors='replace')}") from None
            except urllib.error.URLError as e:
                if pause is None:
                    raise RuntimeError(f"{path.partition('?')[0]}: {e.reason}") from None
            time.sleep(pause)

    def _server_time(self, answer) -> int:
        said = answer.headers.get("Date")
        return int(parsedate_to_datetime(said).timestamp() * 1000) if said else int(time.time() * 1000)


def _ms(value: Any) -> int | None:
    """Milliseconds of a number, or of an ISO time (UTC, if it names no zone)."""
    if value is None or isinstance(value, (int, float)):
        return None if value is None else int(value)
    t = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return int(t.timestamp() * 1000) if t.tzinfo else int(t.replace(tzinfo=timezone.utc).timestamp() * 1000)


def line_id(*parts: Any) -> str:
    """Of a line that its platform gives no id."""
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:32]


@adapter("p1")
class RestPlatform(Platform):
    """REST with pages of deployments, and logs as lines of JSON. config: url, project, token, settle (ms that lines may come late)."""

    def horizon(self) -> int:
        with self._open(f"/v6/deployments?projectId={urllib.parse.quote(self.config['project'])}&limit=1") as a:
            return self._server_time(a) - int(self.config.get("settle", 0))

    def deployments(self) -> Iterator[dict[str, Any]]:
        until = None
        while True:
            query = {"projectId": self.config["project"], "limit": DEPLOYMENTS} | ({} if until is None else {"until": until})
            with self._open(f"/v6/deployments?{urllib.parse.urlencode(query)}") as a:
                page = json.load(a)
            for d in page.get("deployments") or []:
                meta = d.get("meta") or {}
                created = _ms(d.get("created") or d.get("createdAt"))
                yield {
                    "id": d["uid"], "state": d.get("state") or d.get("readyState"), "created": created, "ready": _ms(d.get("ready")), "first": created,
                    "branch": meta.get("githubCommitRef"), "commit": meta.get("githubCommitSha"), "url": f"https://{d['url']}" if d.get("url") else None,
                }
            until = (page.get("pagination") or {}).get("next")
            if until is None:
                return

    def logs(self, deployment: str, since: int, until: int) -> Iterator[dict[str, Any]]:
        path = f"/v1/projects/{urllib.parse.quote(self.config['project'])}/deployments/{urllib.parse.quote(deployment)}/runtime-logs"
        seen: dict[tuple, int] = {}
        with self._open(path) as a:
            for raw in a:
                try:
                    x = json.loads(raw)
                except ValueError:
                    continue
                if not isinstance(x, dict):
                    continue
                at = _ms(x.get("timestampInMs") or x.get("created"))
                if at is None or not since < at <= until:
                    continue
                word, message = x.get("level") or x.get("type") or "info", x.get("message") or x.get("text") or ""
                key = x.get("rowId")
                if key is None:
                    n = seen[at, word, message] = seen.get((at, word, message), 0) + 1
                    key = line_id(deployment, at, word, message, n)
                meta = {k: x.get(v) for k, v in (("path", "requestPath"), ("method", "requestMethod"), ("status", "responseStatusCode"), ("domain", "domain"))}
                yield {"id": key, "timestamp": at, "type": word, "message": message, "function": x.get("source"), "metadata": {k: str(v) for k, v in meta.items() if v is not None}}


#: The questions that the second platform's interface knows.
WHO = "query { me { name } }"
LIST = "query deployments($input: DeploymentListInput!, $after: String) { deployments(input: $input, first: %d, after: $after) { edges { node { id status createdAt updatedAt staticUrl meta } } pageInfo { hasNextPage endCursor } } }" % DEPLOYMENTS
LOG_LINES = "query deploymentLogs($deploymentId: String!, $limit: Int, $startDate: DateTime) { deploymentLogs(deploymentId: $deploymentId, limit: $limit, startDate: $startDate) { timestamp message severity } }"


@adapter("p2")
class GraphPlatform(Platform):
    """GraphQL. config: url, project, service, environment (may be missing), token, settle."""

    def _ask(self, query: str, variables: dict) -> tuple[dict, int]:
        with self._open("/graphql/v2", {"query": query, "variables": variables}) as a:
            got = json.load(a)
            at = self._server_time(a)
        if got.get("errors"):
            raise RuntimeError(f"{query.split('(')[0]}: {got['errors'][0].get('message')}")
        return got.get("data") or {}, at

    def horizon(self) -> int:
        return self._ask(WHO, {})[1] - int(self.config.get("settle", 0))

    def deployments(self) -> Iterator[dict[str, Any]]:
        wanted = {"projectId": self.config["project"], "serviceId": self.config.get("service")} | ({"environmentId": self.config["environment"]} if self.config.get("environment") else {})
        after = None
        while True:
            page = self._ask(LIST, {"input": wanted, "after": after})[0].get("deployments") or {}
            for e in page.get("edges") or []:
                d, meta = e["node"], e["node"].get("meta") or {}
                created = _ms(d.get("createdAt"))
                yield {
                    "id": d["id"], "state": d.get("status"), "created": created, "ready": _ms(d.get("updatedAt")), "first": created,
                    "branch": meta.get("branch"), "commit": meta.get("commitHash"), "url": f"https://{d['staticUrl']}" if d.get("staticUrl") else None,
                }
            info = page.get("pageInfo") or {}
            after = info.get("endCursor")
            if not info.get("hasNextPage"):
                return

    def logs(self, deployment: str, since: int, until: int) -> Iterator[dict[str, Any]]:
        """Pages begin at the time of the last line of the page before; lines of that time which were passed on already are known by their ids."""
        at, limit, done = since, LINES, set()
        while True:
            begin = datetime.fromtimestamp(at / 1000, timezone.utc).isoformat(timespec="milliseconds")
            page = self._ask(LOG_LINES, {"deploymentId": deployment, "limit": limit, "startDate": begin})[0].get("deploymentLogs") or []
            seen: dict[tuple, int] = {}
            last, new = at, set()
            for x in page:
                when = _ms(x["timestamp"])
                n = seen[when, x["severity"], x["message"]] = seen.get((when, x["severity"], x["message"]), 0) + 1
                key = line_id(deployment, when, x["severity"], x["message"], n)
                last = max(last, when)
                new.add((when, key))
                if since < when <= until and (when, key) not in done:
                    meta = {k: self.config[k] for k in ("service", "environment") if self.config.get(k)}
                    yield {"id": key, "timestamp": when, "type": x["severity"], "message": x["message"] or "", "function": None, "metadata": meta}
            if len(page) < limit or last > until:
                return
            # a page of one time only says nothing of what comes after it: it is asked for again with room for more
            at, limit, done = (last, LINES, {k for k in new if k[0] == last}) if last > at else (at, 2 * limit, done | new)


@adapter("export")
class ExportPlatform(Platform):
    """Logs that a platform has left in a store: `deployments` has lines of JSON (id, state, created, ready, branch, commit, first, last), `logs/deployment=ID` those of
    each (id, timestamp, type, message). config: url of the folder."""

    def _lines(self, folder: str) -> Iterator[dict[str, Any]]:
        fs, root = pafs.FileSystem.from_uri(self.config["url"])
        found = fs.get_file_info(pafs.FileSelector(f"{root}/{folder}", allow_not_found=True))
        for f in sorted(x.path for x in found if x.type == pafs.FileType.File and x.base_name[0] not in "._"):
            with fs.open_input_stream(f) as s:
                rest = b""
                while part := s.read(1 << 20):
                    *lines, rest = (rest + part).split(b"\n")
                    yield from map(json.loads, filter(None, lines))
                if rest:
                    yield json.loads(rest)

    def horizon(self) -> int:
        return max((d["last"] for d in self.deployments()), default=0)

    def deployments(self) -> Iterator[dict[str, Any]]:
        for d in self._lines("deployments"):
            yield {k: d.get(k) for k in ("id", "state", "created", "ready", "first", "last", "branch", "commit", "url")}

    def logs(self, deployment: str, since: int, until: int) -> Iterator[dict[str, Any]]:
        for x in self._lines(f"logs/deployment={deployment}"):
            if since < x["timestamp"] <= until:
                yield {"id": str(x["id"]), "timestamp": x["timestamp"], "type": x.get("type"), "message": x.get("message") or "", "function": x.get("function"), "metadata": x.get("metadata") or {}}
