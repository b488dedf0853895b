"""Tools over stored memory by JSON-RPC, a line of JSON a message, on standard input and output."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import apps, linker, prose
from .operators import belief as B
from .operators.memory import Memory

UNKNOWN_METHOD, BAD_PARAMS = -32601, -32602


class Tools:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def memory(self) -> Memory:
        return Memory.load(self.spark, self.folder)

    def _asked(self, m: Memory, name: str):
        return B.ask(m, self.spark.createDataFrame([(name,)], "name string")).first()

    @staticmethod
    def _rows(df) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def ask_project(self, name: str) -> dict:
        m = self.memory()
        asked = self._asked(m, name)
        if asked["outcome"] != "answered":
            return {"answered": False, "reason": asked["outcome"]}
        return {"answered": True, "text": prose.told(m).where(F.col("class_id") == asked["class_id"]).first()["prose"]}

    def project_timeline(self, name: str) -> list[dict]:
        m = self.memory()
        return self._rows(B.timeline(m).where(F.col("class_id") == self._asked(m, name)["class_id"]).orderBy("place"))

    def project_dependents(self, name: str) -> list[dict]:
        m = self.memory()
        return self._rows(B.dependents(m).where(F.col("class_id") == self._asked(m, name)["class_id"]).orderBy(F.desc("support"), "label"))

    def check_constraint(self, subject: str, predicate: str, object: str) -> dict:
        bad, unknown = apps.check_compliance(self.memory(), self.spark.createDataFrame([(subject, predicate, object)], "subject string, predicate string, object string"))
        return {"violations": self._rows(bad), "unknown": unknown.count()}

    def project_brief(self, limit: int = 10) -> dict:
        return {k: self._rows(v) for k, v in apps.brief(self.memory(), limit).items()}

    def correct_fact(self, fact_id: str, reason: str, author: str, on: str) -> dict:
        after, artifact = linker.retract(self.memory(), fact_id, reason, author, on)
        after.save(self.folder)
        return {"artifact": artifact}


TOOLS = ("ask_project", "project_timeline", "project_dependents", "check_constraint", "project_brief", "correct_fact")


def handle(tools: Tools, message: dict) -> dict:
    """The answer to one request."""
    out = {"jsonrpc": "2.0", "id": message.get("id")}
    method, params = message.get("method"), message.get("params") or {}
    if method == "tools/list":
        return out | {"result": {"tools": [{"name": t} for t in TOOLS]}}
    if method == "tools/call":
        method, params = params.get("name"), params.get("arguments") or {}
    if method not in TOOLS:
        return out | {"error": {"code": UNKNOWN_METHOD, "message": f"no such method: {method}"}}
    try:
        return out | {"result": getattr(tools, method)(**params)}
    except (TypeError, KeyError, ValueError) as e:
        return out | {"error": {"code": BAD_PARAMS, "message": str(e)}}


def serve(tools: Tools, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip():
            print(json.dumps(handle(tools, json.loads(line)), ensure_ascii=False, default=str), file=out, flush=True)
