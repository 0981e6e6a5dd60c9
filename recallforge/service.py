"""A JSON-RPC service of the engine's tools, over lines or Content-Length frames, and over HTTP."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import Any, BinaryIO

from pyspark.sql import functions as F

from recallforge.engine import MemoryEngine
from recallforge.schema import MEMORY_TYPES, MemoryQuery, StoreError

# Codes of the protocol, its version, and the bounds of a query's limit.
UNKNOWN_METHOD, BAD_PARAMS, FAILED, UNREADABLE = -32601, -32602, -32000, -32700
VERSION, LIMITS = "2024-11-05", (1, 100, 8)


class BadParams(ValueError):
    """Arguments that a tool can't take."""


def text_of(args: dict, name: str, other: str | None = None) -> str:
    value = args.get(name, other)
    if not isinstance(value, str) or (other is None and not value.strip()):
        raise BadParams(f"{name} must be a text")
    return value


def query_of(args: dict) -> MemoryQuery:
    """A query of arguments; its limit is held within its bounds, unknown types are an error."""
    least, most, usual = LIMITS
    limit, types = args.get("limit", usual), args.get("memory_types", [])
    if not isinstance(limit, int) or isinstance(limit, bool):
        raise BadParams("limit must be a number")
    if not isinstance(types, list) or any(t not in MEMORY_TYPES for t in types):
        raise BadParams(f"memory_types must be among {', '.join(MEMORY_TYPES)}")
    return MemoryQuery(text_of(args, "query"), text_of(args, "namespace", "default"), types, min(max(limit, least), most))


_TEXT = {"type": "string"}
_QUERY = {"query": _TEXT, "namespace": _TEXT, "limit": {"type": "integer", "minimum": LIMITS[0], "maximum": LIMITS[1]}, "memory_types": {"type": "array", "items": {"type": "string", "enum": list(MEMORY_TYPES)}}}
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "remember": ("Store a text and the memories that it gives", {"text": _TEXT, "namespace": _TEXT, "actor": _TEXT, "metadata": {"type": "object"}}, ["text"]),
    "search": ("Find memories", _QUERY, ["query"]),
    "build_context": ("Find memories and give them as one text", _QUERY, ["query"]),
    "delete_memory": ("Delete a memory of a namespace", {"memory_id": _TEXT, "namespace": _TEXT}, ["memory_id"]),
}


def definitions() -> list[dict]:
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]


class Service:
    """Answers requests one after the other."""

    def __init__(self, engine: MemoryEngine, name: str = "recallforge"):
        self.engine, self.name = engine, name

    def call(self, tool: str, args: dict) -> Any:
        if tool == "remember":
            given = args.get("metadata") or {}
            if not isinstance(given, dict):
                raise BadParams("metadata must be an object")
            meta = {k: v for k, v in given.items() if isinstance(v, str)}
            row = (text_of(args, "text"), text_of(args, "namespace", "default"), text_of(args, "actor", "user"), meta)
            events = self.engine.store.spark.createDataFrame([row], "text string, namespace string, actor string, metadata map<string,string>")
            return [r.id for r in self.engine.ingest(events).select("id").orderBy("id").collect()]
        if tool == "search":
            hits = self.engine.search([query_of(args)]).orderBy("rank")
            return [r.asDict(recursive=True) for r in hits.select("id", "content", "memory_type", "source_event_id", F.round("score", 6).alias("score"), "confidence", "reasons", "metadata").collect()]
        if tool == "build_context":
            return self.engine.build_context(query_of(args))
        if tool == "delete_memory":
            self.engine.delete_memories(text_of(args, "namespace", "default"), [text_of(args, "memory_id")])
            return {"deleted": True}
        raise BadParams(f"unknown tool: {tool}")

    def answer(self, method: str, params: dict) -> Any:
        """The result of a method; null for those that are unknown."""
        plain = {"ping": {}, "tools/list": {"tools": definitions()}, "resources/list": {"resources": []}, "prompts/list": {"prompts": []}}
        if method == "initialize":
            return {"protocolVersion": params.get("protocolVersion", VERSION), "serverInfo": {"name": self.name, "version": "1"}, "capabilities": {"tools": {}}}
        if method == "tools/call":
            found = self.call(text_of(params, "name"), params.get("arguments") or {})
            return {"content": [{"type": "text", "text": found if isinstance(found, str) else json.dumps(found, ensure_ascii=False)}], "isError": False}
        return plain.get(method)

    def handle(self, request: Any) -> dict | None:
        """The response to a request; none for notifications."""
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": BAD_PARAMS, "message": "a request has a method"}}
        if "id" not in request:
            return None
        out: dict[str, Any] = {"jsonrpc": "2.0", "id": request["id"]}
        try:
            params = request.get("params") or {}
            if not isinstance(params, dict):
                raise BadParams("params must be an object")
            found = self.answer(request["method"], params)
            return out | ({"result": found} if found is not None else {"error": {"code": UNKNOWN_METHOD, "message": f"unknown method: {request['method']}"}})
        except BadParams as e:
            return out | {"error": {"code": BAD_PARAMS, "message": str(e)}}
        except StoreError as e:
            return out | {"error": {"code": FAILED, "message": str(e)}}

    def handle_text(self, text: str | bytes) -> dict | None:
        try:
            return self.handle(json.loads(text))
        except ValueError as e:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": UNREADABLE, "message": str(e)}}

    def serve_stream(self, read: BinaryIO, write: BinaryIO) -> None:
        """Messages of a stream, a JSON line each or framed by Content-Length; answers are framed."""
        while (message := read_message(read)) is not None:
            if (found := self.handle_text(message)) is not None:
                write_message(write, found)

    def serve_http(self, host: str = "127.0.0.1", port: int = 8765) -> HTTPServer:
        """A server for POST /mcp; call its ``serve_forever``."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                if self.path != "/mcp":
                    self.send_error(404)
                    return
                found = service.handle_text(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                body = b"" if found is None else json.dumps(found, ensure_ascii=False).encode()
                self.send_response(202 if found is None else 200)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args: Any) -> None:
                pass

        return HTTPServer((host, port), Handler)


def read_message(stream: BinaryIO) -> bytes | None:
    """The next message, or null at the end."""
    while line := stream.readline():
        if not line.strip():
            continue
        if line.lower().startswith(b"content-length:"):
            length = int(line.split(b":", 1)[1])
            while stream.readline().strip():
                pass
            return stream.read(length)
        return line.strip()
    return None


def write_message(stream: BinaryIO, message: dict) -> None:
    body = json.dumps(message, ensure_ascii=False).encode()
    stream.write(b"Content-Length: %d\r\n\r\n%s" % (len(body), body))
    stream.flush()
