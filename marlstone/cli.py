"""Command line: ``python -m marlstone.cli INDEX VERB …``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans.engine import Config, Engine
from marlstone.sources import files


def _print(df: DataFrame, as_json: bool) -> None:
    rows = df.collect()
    for r in rows:
        d = r.asDict(recursive=True)
        print(json.dumps(d, ensure_ascii=False) if as_json else "  ".join(f"{v:.3f}" if isinstance(v, float) else str(v) for v in d.values()))
    if not rows:
        print("No confident matches.", file=sys.stderr)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="marlstone")
    p.add_argument("index")
    p.add_argument("--archived", action="append", default=[])
    p.add_argument("--archived-weight", type=float, default=1.0)
    p.add_argument("--json", action="store_true")
    verbs = p.add_subparsers(dest="verb", required=True)
    ingest = verbs.add_parser("ingest")
    ingest.add_argument("root")
    ingest.add_argument("dirs", nargs="+")
    ingest.add_argument("--exclude", action="append", default=[])
    ingest.add_argument("--list-skipped", action="store_true")
    for verb in ("ask", "find", "answer", "graph"):
        v = verbs.add_parser(verb)
        v.add_argument("text")
        v.add_argument("--top", type=int, default=5)
    verbs.add_parser("explain").add_argument("doc")
    path = verbs.add_parser("path")
    path.add_argument("a")
    path.add_argument("b")
    path.add_argument("--hops", type=int, default=2)
    verbs.add_parser("doctor")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("marlstone").getOrCreate()
    engine = Engine(spark, a.index, Config(archived=tuple(a.archived), archived_weight=a.archived_weight))
    if a.verb == "ingest":
        found = files.scan(spark, a.root, a.dirs, a.exclude)
        if a.list_skipped:
            _print(files.skipped(found).orderBy("path"), a.json)
        else:
            print(json.dumps(engine.ingest(files.documents(found))))
    elif a.verb == "doctor":
        print(json.dumps(engine.doctor()))
    elif a.verb == "path":
        _print(engine.path(a.a, a.b, a.hops), a.json)
    elif a.verb == "explain":
        _print(engine.explain(a.doc), a.json)
    elif a.verb in ("answer", "graph"):
        _print(getattr(engine, a.verb)(a.text), a.json)
    else:
        _print(getattr(engine, a.verb)(a.text, a.top), a.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
