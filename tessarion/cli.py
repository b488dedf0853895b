"""Command line over the same functions: ``python -m tessarion.cli VERB …``.

Exit status 1: unanswered, not compliant, or a wrong pilot answer; 2: a malformed triple.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vocabulary as V
from .operators import apps, compiler, linker, prose, reports
from .operators import belief as B
from .operators import memory as M
from .operators.memory import Memory
from .sources import files
from .streaming import ingest


def session() -> SparkSession:
    return SparkSession.builder.appName("tessarion").getOrCreate()


def show(df: DataFrame, out) -> None:
    """A small result as JSON lines."""
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str), file=out)


def _class_of(m: Memory, name: str) -> tuple[str, str | None]:
    asked = B.ask(m, m.facts.sparkSession.createDataFrame([(name,)], "name string")).first()
    return asked["outcome"], asked["class_id"]


def _triple(text: str) -> tuple[str, str, str]:
    parts = tuple(p.strip() for p in text.split("|"))
    if len(parts) != 3 or not all(parts) or parts[1] not in V.PREDICATES:
        raise ValueError(f"not a triple 'subject|predicate|object': {text}")
    return parts


def main(argv: list[str] | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="tessarion", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **options) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        if name not in ("compile",):
            p.add_argument("--memory", required=True)
        for a in args:
            p.add_argument(a, **options.get(a.strip("-"), {}))
        return p

    verb("compile", "path", "--type")
    verb("ingest", "path")
    verb("pull", "folder", "--checkpoint", checkpoint={"required": True})
    for name in ("ask", "explain", "timeline", "dependents"):
        verb(name, "name")
    for name in ("health", "brief", "stats", "decisions", "serve"):
        verb(name)
    verb("correct", "fact", "--reason", "--author", "--on", reason={"required": True}, author={"default": "unknown"}, on={"required": True})
    verb("check", "triples", triples={"nargs": "+"})
    verb("migrate", "renames", renames={"nargs": "+"})
    verb("pilot", "questions")
    verb("eval", "labels")
    a = parser.parse_args(argv)
    spark = session()

    if a.verb == "compile":
        show(compiler.compile_artifacts(files.load_artifact(spark, a.path, a.type)).to_json(), out)
        return 0
    if a.verb == "ingest":
        print(json.dumps({"ingested": ingest.apply_batch(files.load_scenario(spark, a.path), a.memory)}), file=out)
        return 0
    if a.verb == "pull":
        ingest.ingest_stream(ingest.markdown_stream(spark, a.folder), a.memory, a.checkpoint)
        print(json.dumps({"applied": ingest.applied(spark, a.memory).count()}), file=out)
        return 0

    m = Memory.load(spark, a.memory)
    if a.verb in ("ask", "explain", "timeline", "dependents"):
        outcome, class_id = _class_of(m, a.name)
        if outcome != "answered" and a.verb in ("ask", "explain"):
            print(f"no recorded position on {a.name!r}: {outcome}", file=out)
            return 1
        own = F.col("class_id") == class_id
        if a.verb == "ask":
            print(prose.rendered(m, spark.createDataFrame([(class_id,)], "class_id string")).first()["text"], file=out)
        elif a.verb == "explain":
            print(prose.told(m).where(own).first()["prose"], file=out)
        elif a.verb == "timeline":
            show(B.timeline(m).where(own).orderBy("place"), out)
        else:
            show(B.dependents(m).where(own).orderBy(F.desc("support"), "label"), out)
    elif a.verb == "health":
        show(B.health_notes(B.health(m)), out)
    elif a.verb == "stats":
        show(M.stats(m), out)
    elif a.verb == "decisions":
        show(B.decisions(m).orderBy("subject", "object"), out)
    elif a.verb == "brief":
        print(reports.brief_text(apps.brief(m)), file=out)
    elif a.verb == "serve":
        from .server import Tools, serve

        serve(Tools(spark, a.memory), out=out)
    elif a.verb == "correct":
        after, artifact = linker.retract(m, a.fact, a.reason, a.author, a.on)
        after.save(a.memory)
        print(json.dumps({"artifact": artifact}), file=out)
    elif a.verb == "check":
        try:
            triples = [_triple(t) for t in a.triples]
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        bad, unknown = apps.check_compliance(m, spark.createDataFrame(triples, "subject string, predicate string, object string"))
        print(reports.compliance_summary(len(triples), bad, unknown), file=out)
        return 0 if bad.isEmpty() else 1
    elif a.verb == "migrate":
        show(apps.Renames(dict(r.split("=", 1) for r in a.renames)).plan(m.facts), out)
    elif a.verb == "pilot":
        asked = spark.read.json(a.questions, multiLine=True, schema="questions array<struct<ask: string, expect: string>>").select(F.explode("questions").alias("q")).select("q.*")
        done = apps.run_pilot(m, asked)
        summary = apps.pilot_summary(done)
        print(reports.pilot_text(done, summary), file=out)
        summary = summary.first()
        return 1 if summary["wrong"] else 0
    elif a.verb == "eval":
        triples = "labels array<array<string>>, known_unreachable array<array<string>>"
        given = spark.read.json(a.labels, multiLine=True, schema=triples)
        rows = lambda c: given.select(F.explode(c).alias("t")).select(F.lit("case").alias("case"), *[F.col("t")[k].alias(n) for k, n in enumerate(apps.TRIPLE)])
        print(reports.score_text(apps.score_extraction(apps.predicted_triples(m).withColumn("case", F.lit("case")), rows("labels"), rows("known_unreachable"))), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
