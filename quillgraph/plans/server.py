"""A thin HTTP server over the query surface, with the standard library."""

from __future__ import annotations

import hmac
import json
import logging
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from quillgraph.plans.answers import GraphTables, Request, answer_question, hybrid_search, stub_answer
from quillgraph.plans.guard import QueryRejected, QueryTimeout, ResultTooLarge, run_query
from quillgraph.sources.config import Api, Config, ConfigError, Retrieval
from quillgraph.sources.office import ParserError

log = logging.getLogger(__name__)


def status_of(error: BaseException) -> tuple[int, str]:
    """HTTP status and code of an error."""
    for kinds, status, code in (((QueryRejected,), 400, "validation_error"), ((ResultTooLarge, QueryTimeout), 413, "query_too_large"), ((ParserError,), 422, "parser_error"), ((ConfigError,), 500, "config_error"), ((ConnectionError,), 503, "storage_unavailable"), ((ValueError,), 400, "validation_error")):
        if isinstance(error, kinds):
            return status, code
    return 500, "internal_error"


def error_body(error: BaseException) -> tuple[int, dict]:
    """What a client is told: nothing of the inside where the fault is ours."""
    status, code = status_of(error)
    return status, {"error": {"code": code, "message": "Internal server error" if status >= 500 else str(error)}}


def authorized(header: str | None, token: str) -> bool:
    m = re.fullmatch(r"Bearer\s+(.+)", header or "", re.I)
    return bool(m) and hmac.compare_digest(m[1].strip().encode(), token.encode())


def retrieval_routes(tables: GraphTables, embed: Callable[[str], list[float]], config: Config, answer: Callable[[tuple[str, str]], dict] = stub_answer) -> dict:
    """/api/v1/rag and /api/v1/hybrid-search {question, paragraphTopK?, entityTopK?, hops?, window?, maxContextTokens?, alpha?}
    over the graph; None, so that they tell they are off, where the settings switch them off."""
    names = {"paragraphTopK": "paragraph_top_k", "entityTopK": "entity_top_k", "hops": "hops", "window": "window", "maxContextTokens": "max_context_tokens", "alpha": "alpha"}

    def request(body: dict, own: Retrieval, most_k: int) -> Request:
        if not isinstance(body.get("question"), str) or not 1 <= len(body["question"]) <= 4000 or any(not isinstance(body[k], (int, float)) for k in names if k in body):
            raise ValueError("question of 1 to 4000 characters, and numbers")
        base = {"paragraph_top_k": own.paragraph_top_k, "entity_top_k": own.entity_top_k, "hops": own.max_hops, "window": own.layout_window, "max_context_tokens": own.max_context_tokens, "alpha": own.rank_alpha}
        return Request(**(base | {v: body[k] for k, v in names.items() if k in body}), most_k=most_k)

    def rag(body: dict) -> dict:
        out = answer_question(tables, body.get("question", ""), embed, answer, request(body, config.rag, 50))
        return {"answer": out["answer"], "citations": out["citations"], "confident": out["confident"], "sources": out["sources"], "orphanCitations": out["orphan_citations"], "trace": {"contextTokens": out["trace"]["context_tokens"], "seconds": out["trace"]["seconds"]}}

    def hybrid(body: dict) -> dict:
        r = request(body, config.hybrid, 100)
        # Anchors are most_k at most; what is expanded from them goes out up to the row limit of the API.
        return {k: [x.asDict() for x in df.limit(config.api.max_rows).collect()] for k, df in hybrid_search(tables, embed(body["question"]), r).items()}

    return {"/api/v1/rag": rag if config.rag.enabled else None, "/api/v1/hybrid-search": hybrid if config.hybrid.enabled else None}


def create_server(spark: SparkSession, api: Api, routes: dict | None = None, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """GET /health and /api/v1/health are open; POST /api/v1/query {query, maxRows?, timeoutMs?} and the `routes` (path -> function of the body,
    or None where switched off) need the bearer token."""
    if not api.token or len(api.token) < 8:
        raise ConfigError("the token has 8 characters at least")

    def query(body: dict) -> dict:
        rows, ms = body.get("maxRows", api.max_rows), body.get("timeoutMs", api.timeout_ms)
        if not isinstance(body.get("query"), str) or not 0 < rows <= 100_000 or not 0 < ms <= 300_000:
            raise ValueError("query, maxRows up to 100000, timeoutMs up to 300000")
        out = run_query(spark, body["query"], rows, ms / 1000)
        return {"rows": [json.loads(r) for r in out["rows"]], "rowCount": out["row_count"], "queryHash": out["query_hash"]}

    paths = {"/api/v1/query": query} | (routes or {})

    class Handler(BaseHTTPRequestHandler):
        def send(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.send(*((200, {"status": "ok"}) if self.path in ("/health", "/api/v1/health") else (404, {"error": {"code": "not_found", "message": "no such path"}})))

        def do_POST(self) -> None:
            if not authorized(self.headers.get("Authorization"), api.token):
                return self.send(401, {"error": {"code": "unauthorized", "message": "a bearer token is wanted"}})
            if self.path not in paths:
                return self.send(404, {"error": {"code": "not_found", "message": "no such path"}})
            if paths[self.path] is None:
                return self.send(503, {"error": {"code": "disabled", "message": "switched off"}})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if not isinstance(body, dict):
                    raise ValueError("an object is wanted")
                return self.send(200, paths[self.path](body))
            except Exception as e:
                log.exception("request failed")
                return self.send(*error_body(e))

        def log_message(self, *args) -> None:
            log.debug("%s", args)

    return ThreadingHTTPServer((host, port), Handler)
