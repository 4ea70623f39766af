"""A client of the HTTP routes of :mod:`simloom.sources.service`."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request


class Failed(Exception):
    """An answer of 400 or above."""

    def __init__(self, status: int, text: str):
        super().__init__(f"{status}: {text}")
        self.status = status


class Client:
    def __init__(self, url: str = "http://127.0.0.1:8080", timeout: float = 60.0):
        self.url, self.timeout = url.rstrip("/"), timeout

    def _ask(self, method: str, path: str, body: dict | None = None):
        data = None if body is None else json.dumps(body).encode()
        asked = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"}, method=method)
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                raw = answer.read().decode()
                return json.loads(raw) if answer.headers.get_content_type() == "application/json" else raw
        except urllib.error.HTTPError as e:
            raw = e.read().decode("utf-8", "replace")
            try:
                raw = json.loads(raw)["error"]
            except (ValueError, KeyError, TypeError):
                pass
            raise Failed(e.code, raw) from None

    @staticmethod
    def _at(name: str, rest: str = "") -> str:
        return f"/collections/{urllib.parse.quote(name, safe='')}{rest}"

    def health(self) -> dict:
        return self._ask("GET", "/health")

    def metrics(self) -> str:
        return self._ask("GET", "/metrics")

    def collections(self) -> list[dict]:
        return self._ask("GET", "/collections")["collections"]

    def create(self, name: str, dim: int, **options) -> dict:
        return self._ask("POST", "/collections", {"name": name, "dim": dim} | options)

    def stats(self, name: str) -> dict:
        return self._ask("GET", self._at(name))

    def drop(self, name: str) -> None:
        self._ask("DELETE", self._at(name))

    def upsert(self, name: str, ids: list[int], vectors: list[list[float]], metadata: list[dict] | None = None) -> int:
        return self._ask("POST", self._at(name, "/upsert"), {"ids": ids, "vectors": vectors} | ({} if metadata is None else {"metadata": metadata}))["upserted"]

    def query(self, name: str, vectors: list, k: int = 10, **options) -> list:
        """Hits of one vector, or a list of hits for each of several. ``options``: ``ef``, ``filter``, ``include_metadata``."""
        single = bool(vectors) and not isinstance(vectors[0], list)
        return self._ask("POST", self._at(name, "/query"), {"vector" if single else "vectors": vectors, "k": k} | options)["results"]

    def delete(self, name: str, ids: list[int]) -> int:
        return self._ask("POST", self._at(name, "/delete"), {"ids": ids})["deleted"]

    def get(self, name: str, id_: int) -> dict | None:
        """A point, or None."""
        try:
            return self._ask("GET", self._at(name, f"/points/{id_}"))
        except Failed as e:
            if e.status != 404:
                raise
            return None

    def checkpoint(self, name: str) -> dict:
        return self._ask("POST", self._at(name, "/checkpoint"))
