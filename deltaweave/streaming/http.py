"""``serve``: POST /inputs/<table> feeds JSON lines, GET /outputs/<name> streams later changes, GET /healthz answers ok."""

from __future__ import annotations

import queue
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.sql import SparkSession

from ..operators.zset import W, ZSet
from ..plans.circuit import Plan
from ..sources.codec import decode, encode, header
from .engine import Engine


class Service:
    """One engine behind a lock; every subscriber has a queue of lines."""

    def __init__(self, spark: SparkSession, plan: Plan, outputs: list[str]) -> None:
        self.spark, self.plan, self.outputs = spark, plan, outputs
        self.engine = Engine(spark, plan, outputs)
        self.lock = threading.Lock()
        self.listeners: dict[str, list[queue.Queue]] = {o: [] for o in outputs}

    def post(self, table: str, body: str) -> None:
        """All lines of a body or none."""
        lines = [(x,) for x in body.split("\n")]
        rows = decode(self.spark.createDataFrame(lines, "value string"), self.plan.sources[table])
        rows = self.spark.createDataFrame(rows.collect(), rows.schema)  # a bad line fails here, before anything is fed
        with self.lock:
            for name, changes in self.engine.step({table: rows}).items():
                out = [r["value"] for r in encode(ZSet.of(changes, W), self.plan.type_of(name)).collect()]
                for q in self.listeners[name]:
                    for line in out:
                        q.put(line)

    def subscribe(self, name: str) -> queue.Queue:
        q: queue.Queue = queue.Queue()
        with self.lock:
            self.listeners[name].append(q)
        q.put(header(self.plan.type_of(name)))
        return q


def server(service: Service, host: str, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def reply(self, code: int, text: str = "") -> None:
            data = text.encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            kind, _, name = unquote(self.path).strip("/").partition("/")
            if kind != "inputs" or name not in service.plan.sources:
                return self.reply(404, "no such input")
            try:
                service.post(name, body)
            except Exception as e:
                return self.reply(400, str(e)[:500])
            return self.reply(204)

        def do_GET(self) -> None:
            kind, _, name = unquote(self.path).strip("/").partition("/")
            if kind == "healthz":
                return self.reply(200, "ok")
            if kind != "outputs" or name not in service.outputs:
                return self.reply(404, "no such output")
            q = service.subscribe(name)
            self.send_response(200)
            self.send_header("Content-Type", "application/x-ndjson")
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            try:
                while (line := q.get()) is not None:
                    data = line.encode() + b"\n"
                    self.wfile.write(f"{len(data):x}\r\n".encode() + data + b"\r\n")
                    self.wfile.flush()
                self.wfile.write(b"0\r\n\r\n")
            except OSError:
                pass
            finally:
                with service.lock:
                    service.listeners[name].remove(q)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
