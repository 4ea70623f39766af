"""Collections over HTTP: a thin JSON front of a catalog, for small requests. Bulk data goes through DataFrames.

``python -m simloom.sources.service --data-dir DIR`` serves the collections under a folder until it is told to end.
"""

from __future__ import annotations

import argparse
import json
import re
import signal
import threading
import time
from bisect import bisect_left
from contextlib import nullcontext
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from simloom.functions.terms import load
from simloom.operators.evaluate import DURATIONS

from .catalog import Catalog

#: Most neighbours a request may ask for (fixed).
MOST = 10_000
_CREATE = ("metric", "M", "ef_construction", "quantization", "rerank")
_ROUTES = [
    ("GET", r"/health", "health"),
    ("GET", r"/metrics", "metrics"),
    ("GET", r"/collections", "list"),
    ("POST", r"/collections", "create"),
    ("GET", r"/collections/([\w-]+)", "stats"),
    ("DELETE", r"/collections/([\w-]+)", "drop"),
    ("POST", r"/collections/([\w-]+)/(upsert|query|delete|checkpoint)", None),
    ("GET", r"/collections/([\w-]+)/points/(\d+)", "point"),
]


#: One at a time for each collection (creation: for all).
_WRITES = {"create", "drop", "upsert", "delete", "checkpoint"}


class Refused(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def _need(ok: bool, text: str) -> None:
    if not ok:
        raise Refused(400, text)


def _whole(x, least: int = 0) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= least


def _ids(body: dict) -> list[int]:
    _need(isinstance(body.get("ids"), list) and all(map(_whole, body["ids"])), "ids must be an array of integers of 0 or more")
    return body["ids"]


def _vectors(found, dim: int) -> list[list[float]]:
    numeric = lambda v: isinstance(v, list) and len(v) == dim and all(isinstance(x, int | float) and not isinstance(x, bool) for x in v)
    _need(isinstance(found, list) and all(map(numeric, found)), f"a vector is an array of {dim} numbers")
    return [[float(x) for x in v] for v in found]


class Service:
    """Answers requests without a socket: :meth:`answer` takes method, path and body and gives status and JSON (or text)."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.spark, self.lock, self.seen = catalog, catalog.spark, threading.RLock(), {}
        self.writing: dict[str, threading.RLock] = {}

    def answer(self, method: str, path: str, body: str = "") -> tuple[int, dict | str]:
        for verb, pattern, name in _ROUTES:
            got = re.fullmatch(pattern, path, re.ASCII) if verb == method else None
            if got:
                name, rest = (name, got.groups()) if name else (got[2], got.groups()[:1])
                break
        else:
            return 404, {"error": "no such route"}
        start = time.perf_counter()
        try:
            asked = load(body) if method == "POST" else {}
            with self._writer(rest[0] if rest else "") if name in _WRITES else nullcontext():  # readers go on meanwhile
                status, out = getattr(self, f"_{name}")(asked, *rest)
        except Refused as e:
            status, out = e.status, {"error": str(e)}
        except FileExistsError as e:
            status, out = 409, {"error": f"{e} exists"}
        except KeyError as e:
            status, out = 404, {"error": f"no collection {e}"}
        except ValueError as e:
            status, out = 400, {"error": str(e)}
        except Exception as e:  # noqa: BLE001  a request must not end the service
            status, out = 500, {"error": str(e)}
        if name != "metrics":
            self._count(name, status, time.perf_counter() - start)
        return status, out

    def _writer(self, name: str) -> threading.RLock:
        with self.lock:
            return self.writing.setdefault(name, threading.RLock())

    def _count(self, name: str, status: int, took: float) -> None:
        with self.lock:
            m = self.seen.setdefault(name, {"requests": 0, "errors": 0, "seconds": 0.0, "buckets": [0] * (len(DURATIONS) + 1)})
            m["requests"] += 1
            m["errors"] += status >= 400
            m["seconds"] += took
            m["buckets"][bisect_left(DURATIONS, took)] += 1

    def _health(self, body):
        return 200, {"status": "ok", "version": self.spark.version, "simd": "jvm"}

    def _metrics(self, body):
        lines = []
        for name, m in sorted(self.seen.items()):
            lines += [f'requests_total{{route="{name}"}} {m["requests"]}', f'errors_total{{route="{name}"}} {m["errors"]}']
            total = 0
            for bound, n in zip([*map(str, DURATIONS), "+Inf"], m["buckets"], strict=True):
                total += n
                lines.append(f'request_seconds_bucket{{route="{name}",le="{bound}"}} {total}')
            lines += [f'request_seconds_sum{{route="{name}"}} {m["seconds"]:.6f}', f'request_seconds_count{{route="{name}"}} {total}']
        return 200, "\n".join(lines) + "\n"

    def _list(self, body):
        return 200, {"collections": [self.catalog.get(n).stats() for n in self.catalog.names()]}

    def _create(self, body):
        _need(isinstance(body.get("name"), str) and _whole(body.get("dim"), 1), "name and dim are needed")
        return 201, self.catalog.create(body["name"], body["dim"], **{o: body[o] for o in _CREATE if o in body}).stats()

    def _stats(self, body, name):
        return 200, self.catalog.get(name).stats()

    def _drop(self, body, name):
        self.catalog.drop(name)
        return 200, {"dropped": name}

    def _upsert(self, body, name):
        c, ids = self.catalog.get(name), _ids(body)
        vectors, meta = _vectors(body.get("vectors"), c.config["dim"]), body.get("metadata")
        meta = [{}] * len(ids) if meta is None else meta
        _need(len(vectors) == len(ids), "ids and vectors differ in length")
        _need(isinstance(meta, list) and len(meta) == len(ids) and all(isinstance(m, dict) for m in meta), "metadata is one object an id")
        rows = [(i, v, json.dumps(m), n) for n, (i, v, m) in enumerate(zip(ids, vectors, meta, strict=True))]
        if rows:
            c.upsert(self.spark.createDataFrame(rows, "id long, vector array<float>, metadata string, pos long"))
        return 200, {"upserted": len(ids)}

    def _query(self, body, name):
        c, single = self.catalog.get(name), "vector" in body
        asked = _vectors([body["vector"]] if single else body.get("vectors"), c.config["dim"])
        k, ef, meta = body.get("k", 10), body.get("ef", 0), body.get("include_metadata", True)
        _need(_whole(k, 1) and k <= MOST, f"k must be 1 to {MOST}")
        _need(_whole(ef), "ef must be 0 or more")
        out = [[] for _ in asked]
        if asked:
            q = self.spark.createDataFrame(list(enumerate(asked)), "query_id long, vector array<float>")
            for h in c.query(q, k, body.get("filter"), bool(meta), ef).orderBy("query_id", "rank").toLocalIterator():
                out[h.query_id].append({"id": h.id, "distance": h.distance} | ({"metadata": json.loads(h.metadata)} if meta else {}))
        return 200, {"results": out[0] if single else out}

    def _delete(self, body, name):
        c, ids = self.catalog.get(name), _ids(body)
        return 200, {"deleted": c.delete(self.spark.createDataFrame([(i,) for i in ids], "id long")) if ids else 0}

    def _point(self, body, name, id_):
        row = self.catalog.get(name).get(int(id_)).first() if int(id_) < 1 << 63 else None
        if row is None:
            raise Refused(404, "no such id")
        return 200, {"id": row.id, "vector": row.vector, "metadata": json.loads(row.metadata)}

    def _checkpoint(self, body, name):
        self.catalog.get(name).checkpoint()
        return self._stats(body, name)

    def close(self) -> None:
        """Checkpoints every collection."""
        for name in self.catalog.names():
            self.catalog.get(name).checkpoint()


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server bound to ``host`` and ``port`` (0: any free one); run its ``serve_forever``, then ``service.close``."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, out = service.answer(self.command, self.path.split("?")[0], self.rfile.read(size).decode("utf-8", "replace"))
            raw = (out if isinstance(out, str) else json.dumps(out)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; version=0.0.4" if isinstance(out, str) else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_DELETE = _do

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="simloom.sources.service", description=__doc__.split("\n")[0])
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--data-dir", required=True)
    p.add_argument("--threads", type=int, default=0, help="cores of a local Spark (0: all, or the cluster's as configured)")
    p.add_argument("--no-fsync", action="store_true", help="commits need not reach the disk at once")
    got = p.parse_args(args)
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("simloom")
    spark = (builder.master(f"local[{got.threads}]") if got.threads else builder).getOrCreate()
    service = Service(Catalog(spark, got.data_dir, fsync=not got.no_fsync))
    server = serve(service, got.host, got.port)
    for number in (signal.SIGINT, signal.SIGTERM):
        signal.signal(number, lambda *_: threading.Thread(target=server.shutdown).start())
    print(f"serving {got.data_dir} on {got.host}:{server.server_address[1]}", flush=True)
    try:
        server.serve_forever()
    finally:
        server.server_close()
        service.close()
        spark.stop()


if __name__ == "__main__":
    main()
