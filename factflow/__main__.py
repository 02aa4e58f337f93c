"""Command line: ``python -m factflow ping | req FILE | tx FILE | gql QUERY FILE``.

``req`` runs a file of messages (a JSON list of requests is one message, a JSON
line each); ``tx`` transacts a file of datoms over attributes that are created as
met; ``gql`` transacts a file and pulls a selection from it.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from factflow.functions.values import decode
from factflow.operators.attributes import AttributeConfig
from factflow.plans.ast import GraphQl
from factflow.streaming.domain import Datom
from factflow.streaming.engine import Engine


def _load(engine: Engine, path: str) -> None:
    facts = json.loads(Path(path).read_text())
    for _, a, v, *_ in facts:
        if not engine.domain.has(a):
            engine.create_attribute(a, AttributeConfig("Distinct", value_type=decode(v)[0]))
    for out in engine.transact([Datom.from_json(f) for f in facts]):
        print(json.dumps(out.__dict__))


def main(args: list[str]) -> int:
    if not args or args[0] not in ("ping", "req", "tx", "gql"):
        print(__doc__)
        return 2
    engine = Engine(SparkSession.builder.appName("factflow").getOrCreate())
    if args[0] == "ping":
        print(json.dumps(engine.status()))
    elif args[0] == "req":
        text = Path(args[1]).read_text()
        try:
            messages = [json.loads(text)]
        except ValueError:
            messages = [json.loads(line) for line in text.splitlines() if line.strip()]
        for m in messages:
            for out in engine.json_message(json.dumps(m)):
                print(json.dumps(out.__dict__))
    elif args[0] == "tx":
        _load(engine, args[1])
        print(json.dumps(engine.status()))
    else:
        _load(engine, args[2])
        for row in engine.query(GraphQl(args[1])).orderBy("path", "attr", "value").toLocalIterator():
            print(json.dumps([*row["path"], row["attr"], row["value"]]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
