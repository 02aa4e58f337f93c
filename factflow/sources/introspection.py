"""The engine's own activity as attributes."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from factflow.functions.values import RANK
from factflow.operators.attributes import AttributeConfig
from factflow.plans.analyze import children, dependencies, name_uses
from factflow.plans.ast import Hector, Join, Plan
from factflow.streaming.domain import Datom, Domain

#: Attribute -> value type of what a query's progress tells.
PROGRESS = {
    "query/name": "String", "query/batch": "Number", "query/input-rows": "Number",
    "query/state-rows": "Number", "query/state-bytes": "Number", "query/duration-ms": "Number", "query/shutdown": "Bool",
}
#: Attribute -> value type of what an epoch of the engine tells: how long a rule
#: took; its physical operators (``rule/number``) and the channels between them
#: (by the operator that reads); tuples of its joins (``rule/number``); facts of
#: the attributes that it reads.
ACTIVITY = {
    "schedule/elapsed-ms": "Number", "operator/name": "String", "operator/rule": "String", "channel/from": "String", "channel/to": "String",
    "join/tuples": "Number", "index/tuples": "Number",
}


def create(domain: Domain) -> None:
    for name, kind in (PROGRESS | ACTIVITY).items():
        assert kind in RANK
        if not domain.has(name):
            domain.create_attribute(name, AttributeConfig.tx_time("LastWriteWins", value_type=kind, entity_type="String"))


def progress_datoms(query: StreamingQuery) -> list[Datom]:
    """Facts of a query's last progress report."""
    p = query.lastProgress
    if p is None:
        return []
    who = str(query.id)
    state = p["stateOperators"]
    return [
        Datom.add(who, "query/name", query.name or who),
        Datom.add(who, "query/batch", int(p["batchId"])),
        Datom.add(who, "query/input-rows", int(p["numInputRows"])),
        Datom.add(who, "query/state-rows", sum(int(s["numRowsTotal"]) for s in state)),
        Datom.add(who, "query/state-bytes", sum(int(s["memoryUsedBytes"]) for s in state)),
        Datom.add(who, "query/duration-ms", int(p["durationMs"].get("triggerExecution", 0))),
    ]


class ProgressListener(StreamingQueryListener):
    """Collects every query's progress; ``drain`` hands the facts over."""

    def __init__(self):
        self.waiting: list[Datom] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.waiting.append(Datom.add(str(event.id), "query/name", event.name or str(event.id)))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        who = str(p.id)
        state = p.stateOperators
        self.waiting += [
            Datom.add(who, "query/batch", int(p.batchId)), Datom.add(who, "query/input-rows", int(p.numInputRows)),
            Datom.add(who, "query/state-rows", sum(int(s.numRowsTotal) for s in state)),
            Datom.add(who, "query/state-bytes", sum(int(s.memoryUsedBytes) for s in state)),
            Datom.add(who, "query/duration-ms", int(p.durationMs.get("triggerExecution", 0))),
        ]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.waiting.append(Datom.add(str(event.id), "query/shutdown", True))

    def drain(self) -> list[Datom]:
        out, self.waiting = self.waiting, []
        return out


def _joins(plan: Plan) -> list[Plan]:
    """The joins of a plan, the outermost first."""
    own = [plan] if isinstance(plan, (Join, Hector)) else []
    return own + [j for child, _ in children(plan) for j in _joins(child)]


def sizes(domain: Domain, epoch: int, plans: dict[str, Plan]) -> list[Datom]:
    """Operators and channels of the rules' physical plans, sizes of their joins
    and of the attributes that they read. Counting is work of its own: this is
    for looking into an engine, not for every day."""
    compiler = domain.compiler(epoch)
    out: list[Datom] = []
    read: set[str] = set()
    for name, plan in plans.items():
        read |= set(closure_attributes(plan, domain))
        rows = compiler.rule(name).df._jdf.queryExecution().sparkPlan().toString().splitlines()
        above: list[tuple[int, str]] = []
        for k, line in enumerate(r for r in rows if r.strip()):
            depth = len(line) - len(line.lstrip(" :+-*"))
            who = f"{name}/{k}"
            while above and above[-1][0] >= depth:
                above.pop()
            out += [Datom.add(who, "operator/name", line.lstrip(" :+-*").split(" ")[0].split("(")[0]), Datom.add(who, "operator/rule", name)]
            if above:
                out += [Datom.add(f"{above[-1][1]}<{who}", "channel/from", who), Datom.add(f"{above[-1][1]}<{who}", "channel/to", above[-1][1])]
            above.append((depth, who))
        for k, j in enumerate(_joins(plan)):
            if not any(n in domain.rules and n == name for n, _ in name_uses(j)):
                out.append(Datom.add(f"{name}/{k}", "join/tuples", compiler.plan(j).df.count()))
    for a in sorted(read):
        out.append(Datom.add(a, "index/tuples", compiler.source.pairs(a)[0].count()))
    return out


def closure_attributes(plan: Plan, domain: Domain) -> list[str]:
    own = dependencies(plan)
    return sorted({*own.attributes, *(a for n in own.names if n in domain.rules for a in dependencies(domain.rules[n].plan).attributes)})
