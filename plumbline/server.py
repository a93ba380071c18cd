"""A small HTTP service over :mod:`plumbline.api`: validation, stored results, suggested jobs.

Routes below ``/api``: POST ``validation/job-config``, ``validation/app-config``
and ``config/heuristics``; GET ``storage/jobs``, ``storage/jobs/<id>/state``
and ``storage/jobs/<id>/results`` with ``start-dt`` and ``end-dt``.
"""

from __future__ import annotations

import json
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame

from . import api
from .sources.storage import Storage

MAX_BODY = 16 << 20


def _rows(df: DataFrame | None) -> list[dict[str, Any]]:
    return [] if df is None else [r.asDict(recursive=True) for r in df.collect()]  # a job's results within a few days


class Service:
    """What the routes do; ``answer`` gives a status and a JSON value."""

    def __init__(self, storage: Storage | None = None):
        self.storage = storage

    def answer(self, method: str, url: str, body: str = "") -> tuple[int, Any]:
        at = urlsplit(url)
        parts = [unquote(p) for p in at.path.strip("/").split("/")]
        if parts[:1] == ["api"]:
            parts = parts[1:]
        try:
            if method == "POST" and parts in (["validation", "job-config"], ["validation", "app-config"]):
                ok, faults = (api.validate_job if parts[1] == "job-config" else api.validate_application)(body)
                return (200, {"valid": True}) if ok else (406, {"valid": False, "faults": faults})
            if method == "POST" and parts == ["config", "heuristics"]:
                return 200, api.suggest_job(body)
            if method == "GET" and parts[:2] == ["storage", "jobs"]:
                if self.storage is None:
                    return 503, {"error": "no result storage"}
                query = parse_qs(at.query)
                when = lambda k: datetime.fromisoformat(query[k][0]) if k in query else None
                if len(parts) == 2:
                    return 200, _rows(api.jobs(self.storage, when("start-dt"), when("end-dt")))
                if len(parts) == 4 and parts[3] == "state":
                    return 200, _rows(api.job_state(self.storage, parts[2], when("dt")))
                if len(parts) == 4 and parts[3] == "results":
                    return 200, {t: _rows(df) for t, df in api.job_results(self.storage, parts[2], when("start-dt"), when("end-dt")).items()}
        except ValueError as e:
            return 400, {"error": str(e)}
        return 404, {"error": f"no route {method} {at.path}"}


def serve(storage: Storage | None = None, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server for the service; call ``serve_forever()`` on it."""
    service = Service(storage)

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length", 0))
            status, value = (413, {"error": "too large"}) if size > MAX_BODY else service.answer(self.command, self.path, self.rfile.read(size).decode())
            raw = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _do

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
