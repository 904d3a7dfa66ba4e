"""An end-to-end run over a small folder of its own, as eleven named scenarios that each say whether they hold."""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidepool.operators import vectors
from tidepool.plans.ingest import Store
from tidepool.service import serve

FILES = {
    "work/retrieval/vector_notes.txt": "Notes on vector search: an index of embeddings answers which texts are alike.",
    "work/retrieval/evaluation.md": "# Evaluation\n\nRecall and reciprocal rank of the search over forty questions.",
    "home/recipes/soup.txt": "A soup of pumpkin, ginger and cream for six guests, to be served hot.",
}


class Scenarios:
    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.store = os.path.join(folder, "files"), Store(spark, os.path.join(folder, "store"))
        for name, content in FILES.items():
            path = os.path.join(self.files, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(content)
        self.counts = self.store.ingest(self.files, time.time_ns() // 1000)

    def found(self, query: str, **more) -> list:
        rows = self.store.engine().search(query, 10, **more)
        return [] if rows is None else rows.orderBy("position").collect()

    def a_indexing(self):
        again = self.store.ingest(self.files, time.time_ns() // 1000)
        return self.counts["indexed"] == len(FILES) and self.counts["errors"] == 0 and again["indexed"] == 0 and again["skipped"] == len(FILES)

    def b_derivation(self):
        return min(self.counts[k] for k in ("events", "episodes", "memories")) > 0

    def c_lexical(self):
        return [r["file_name"] for r in self.found("pumpkin")][:1] == ["soup.txt"]

    def d_semantic(self):
        rows = self.found("vector search notes, index of embeddings for texts")
        return bool(rows) and rows[0]["file_name"] == "vector_notes.txt" and (rows[0]["semantic"] or 0) > 0

    def e_temporal(self):
        return {r["file_name"] for r in self.found("today")} == {os.path.basename(n) for n in FILES}

    def f_filters(self):
        kinds = {r["mime_type"] for r in self.found("search", filters={"mime_types": ["text/markdown"]})}
        return kinds == {"text/markdown"} and not self.found("search", filters={"date_to": 1})

    def g_evidence(self):
        return all(any(e["type"] == "event" and e["path"] for e in r["evidence"]) for r in self.found("pumpkin"))

    def h_confidence(self):
        kinds = {e["type"]: e["confidence_type"] for r in self.found("pumpkin") for e in r["evidence"]}
        return kinds.get("event") == "FACT" and kinds.get("episode") == "INFERENCE" and set(kinds.values()) <= {"FACT", "INFERENCE", "GUESS"}

    def i_feedback(self):
        before = {r["id"]: r["score"] for r in self.found("search", rerank=True)}
        target = min(before)
        self.store.record_feedback("search", str(target), "pin", time.time_ns() // 1_000_000)
        after = {r["id"]: r["score"] for r in self.found("search", rerank=True)}
        return after[target] > before[target] and all(abs(after[i] - before[i]) < 1e-9 for i in before if i != target)

    def j_http(self):
        server = serve(self.store, 0)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        try:
            ask = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}/search", json.dumps({"query": "pumpkin", "k": 3}).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(ask, timeout=300) as answer:
                said = json.loads(answer.read())
        finally:
            server.shutdown()
        return answer.status == 200 and [r["file_name"] for r in said["results"]] == ["soup.txt"] and said["query_embedding_id"] is None

    def k_model(self):
        said = vectors.validate_model(os.path.join(self.files, "no-model"))
        missing = self.store.read("vector_chunks").filter(F.col("model_id") != self.store.embedder.model_id).count()
        return said["available"] is False and said["error"] is not None and missing == 0


def run(spark: SparkSession, folder: str) -> list[dict]:
    """name, passed and error of each scenario, A to K; one that fails does not end the others."""
    context, out = Scenarios(spark, folder), []
    checks: list[tuple[str, Callable]] = [(n, getattr(context, n)) for n in sorted(dir(Scenarios)) if n[1:2] == "_" and n[0] in "abcdefghijk"]
    for name, check in checks:
        try:
            out.append({"name": f"{name[0].upper()} {name[2:]}", "passed": bool(check()), "error": None})
        except Exception as e:
            out.append({"name": f"{name[0].upper()} {name[2:]}", "passed": False, "error": type(e).__name__})
    return out
