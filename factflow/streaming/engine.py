"""The engine: requests in, result changes out.

A message is a list of requests and one epoch: it is applied whole, then (unless
advanced by hand) the epoch moves on and every result that a client is
interested in is brought up to date once, shared by all its clients.
"""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.errors import FactflowError, FaultError, IncorrectError, NotFoundError, UnsupportedError
from factflow.functions.time import coarsen, coarsen_column
from factflow.operators.attributes import TIME, AttributeConfig
from factflow.plans.analyze import closure
from factflow.plans.ast import GraphQl, MatchA, PullLevel, Rule, plan_from_json
from factflow.plans.compile import Compiler, result_columns
from factflow.plans.graphql import derived_attributes, parse, to_pull
from factflow.sinks.core import AssocIn, FileSink, MemorySink, Sink, TheVoid
from factflow.sources import introspection
from factflow.sources.files import CsvFile, JsonFile, ParquetTable
from factflow.sources.introspection import ProgressListener
from factflow.streaming.domain import Datom, Domain
from factflow.streaming.incremental import epoch_diffs


#: Outputs of earlier messages that stay readable.
KEPT_OUTPUTS = 10_000


@dataclass
class Output:
    """What a client is told: ``kind`` is diff, json, message or error."""

    kind: str
    name: str
    body: Any
    time: int | None = None
    diff: int | None = None


@dataclass
class Interest:
    name: str
    clients: set[str]
    sink: Sink | None = None
    granularity: int | None = None
    shown_until: int = -1
    waiting: list[DataFrame] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, manual_advance: bool = False, set_mode: bool = False, tick: int | None = None):
        self.spark, self.manual_advance, self.tick = spark, manual_advance, tick
        self.domain = Domain(spark, set_mode=set_mode)
        self.interests: dict[str, Interest] = {}
        self.outputs: list[Output] = []
        self.streams: list = []
        self.running = True
        self.listener: ProgressListener | None = None
        self.timings: list[Datom] = []

    @staticmethod
    def from_config(spark: SparkSession, config: dict) -> Engine:
        """``tick`` (milliseconds), ``manual_advance``, ``enable_logging`` (the
        engine's own attributes). The optimizer setting is ignored: rules are
        rewritten only where their meaning stays."""
        tick = config.get("tick")
        if isinstance(tick, dict):
            tick = tick.get("secs", 0) * 1000 + tick.get("nanos", 0) // 1_000_000
        engine = Engine(spark, bool(config.get("manual_advance")), tick=tick)
        if config.get("enable_logging"):
            engine.register_introspection()
        return engine

    # -- requests --------------------------------------------------------------
    def message(self, requests: list[Callable[[], Any]], client: str = "self") -> list[Output]:
        """Apply requests as one epoch; an error ends the message and is told."""
        del self.outputs[:-KEPT_OUTPUTS]
        before = len(self.outputs)
        try:
            for r in requests:
                r()
            if not self.manual_advance:
                self.flush()
        except FactflowError as e:
            self.outputs.append(Output("error", client, e.as_dict(), self.domain.epoch))
        except PySparkException as e:
            self.outputs.append(Output("error", client, FaultError(str(e)[:500]).as_dict(), self.domain.epoch))
        return self.outputs[before:]

    def json_message(self, text: str, client: str = "self") -> list[Output]:
        try:
            body = json.loads(text)
            calls = [self._decode(r, client) for r in (body if isinstance(body, list) else [body])]
        except (FactflowError, ValueError, KeyError, TypeError, AttributeError) as e:
            error = e if isinstance(e, FactflowError) else IncorrectError(f"not a request: {e}")
            self.outputs.append(Output("error", client, error.as_dict(), self.domain.epoch))
            return self.outputs[-1:]
        return self.message(calls, client)

    def _decode(self, r: Any, client: str) -> Callable[[], Any]:
        if isinstance(r, str):
            r = {r: None}
        if not isinstance(r, dict) or len(r) != 1:
            raise IncorrectError(f"not a request: {r!r}")
        [(kind, body)] = r.items()
        match kind:
            case "CreateAttribute":
                return lambda: self.create_attribute(body["name"], AttributeConfig.from_json(body.get("config", {})))
            case "Transact":
                datoms = [Datom.from_json(d) for d in body]
                return lambda: self.domain.transact(datoms)
            case "Register":
                rules = [Rule(x["name"], plan_from_json(x["plan"])) for x in body["rules"]]
                return lambda: self.domain.register(*rules)
            case "Interest":
                sink = sink_from_json(body.get("sink"))
                return lambda: self.interest(body["name"], client, sink, body.get("granularity"))
            case "Uninterest":
                return lambda: self.uninterest(body, client)
            case "Subscribe":
                return lambda: self.subscribe(body, client)
            case "Derive":
                return lambda: self.derive(*body)
            case "RegisterSource" if body in ("Introspection", {"Introspection": None}):
                return self.register_introspection
            case "RegisterSource":
                return lambda: self.register_source(source_from_json(body))
            case "AdvanceDomain":
                name, to = body
                return lambda: self.advance_domain(name, to if isinstance(to, int) else next(iter(to.values())))
            case "Tick":
                return self.advance_tick
            case "CloseInput":
                return lambda: self.domain.close_input(body)
            case "Disconnect":
                return lambda: self.disconnect(client)
            case "Status":
                return lambda: self.outputs.append(Output("message", client, self.status(), self.domain.epoch))
            case "Shutdown":
                return self.shutdown
            case "Setup":
                raise UnsupportedError("setup")
        raise IncorrectError(f"unknown request {kind!r}")

    def create_attribute(self, name: str, config: AttributeConfig | None = None) -> None:
        self.domain.create_attribute(name, config)

    def transact(self, datoms: list[Datom]) -> list[Output]:
        return self.message([lambda: self.domain.transact(datoms)])

    def register(self, *rules: Rule) -> None:
        self.domain.register(*rules)

    def register_source(self, source: CsvFile | JsonFile | ParquetTable, name: str | None = None) -> None:
        """Attach files: wide tables stay where they are, others become changes."""
        if isinstance(source, ParquetTable):
            columns = {n: F.expr(c) for n, c in source.attributes.items()}
            self.domain.add_table(name or source.path, source.read(self.spark), source.key, columns, source.unique)
            return
        rows = source.read(self.spark)
        for n, config in source.configs().items():
            self.domain.create_attribute(n, config)
            self.domain.transact_frame(n, source.pairs(rows, n))

    def register_introspection(self) -> ProgressListener:
        """The engine's own activity as attributes, brought up to date at the end
        of every epoch."""
        if self.listener is None:
            introspection.create(self.domain)
            self.listener = ProgressListener()
            self.spark.streams.addListener(self.listener)
        return self.listener

    def serve(self, messages: Iterator[str], client: str = "self") -> Iterator[Output]:
        """Messages as they come; with ``tick``, an epoch ends every that many
        milliseconds, also while no message arrives."""
        if not self.tick:
            for text in messages:
                yield from self.json_message(text, client)
                if not self.running:
                    return
            return
        come: queue.Queue = queue.Queue(maxsize=1024)
        end = object()

        def read() -> None:
            for text in messages:
                come.put(text)
            come.put(end)

        threading.Thread(target=read, daemon=True).start()
        due = time.monotonic() + self.tick / 1000
        while self.running:
            try:
                text = come.get(timeout=max(0.0, due - time.monotonic()))
            except queue.Empty:
                yield from self.message([self.advance_tick], client) if self.manual_advance else self._told(self.flush)
                due = time.monotonic() + self.tick / 1000
                continue
            if text is end:
                return
            yield from self.json_message(text, client)

    def _told(self, act: Callable[[], Any]) -> list[Output]:
        before = len(self.outputs)
        act()
        return self.outputs[before:]

    def subscribe(self, attribute: str, client: str = "self", sink: Sink | None = None) -> None:
        """Interest in a whole attribute."""
        if not self.domain.has(attribute):
            raise NotFoundError(f"no attribute {attribute!r}")
        name = f"subscribe/{attribute}"
        self.domain.register(Rule(name, MatchA(0, attribute, 1)))
        self.interest(name, client, sink)

    def interest(self, name: str, client: str = "self", sink: Sink | None = None, granularity: int | None = None) -> None:
        """From now on the client is told a rule's changes; a first interest gets
        the history so far as one change."""
        closure(name, self.domain.rules, self.domain.has)
        if name in self.interests:
            self.interests[name].clients.add(client)
        else:
            self.interests[name] = Interest(name, {client}, sink, granularity)

    def uninterest(self, name: str, client: str = "self") -> None:
        if name not in self.interests or client not in self.interests[name].clients:
            raise NotFoundError(f"client {client!r} has no interest in {name!r}")
        own = self.interests[name]
        own.clients.discard(client)
        if not own.clients:
            del self.interests[name]

    def disconnect(self, client: str) -> None:
        for name in [n for n, i in self.interests.items() if client in i.clients]:
            self.uninterest(name, client)

    def derive(self, namespace: str, query: str) -> list[str]:
        """New attributes ``namespace/attribute`` with the facts that a selection
        reaches."""
        made = []
        for selection in parse(query):
            for a in derived_attributes(selection):
                name = f"{namespace}/{a}"
                levels = [x for x in to_pull(GraphQl(query)).paths if a in x.pull_attributes]
                if not self.domain.has(a):
                    raise NotFoundError(f"no attribute {a!r}")
                self.domain.add_view(name, lambda compiler, a=a, levels=levels: _derived_pairs(compiler, a, levels))
                made.append(name)
        return made

    # -- time ------------------------------------------------------------------
    def advance_domain(self, name: str | None, to: int) -> None:
        if name is not None:
            raise UnsupportedError("named domains")
        while self.domain.epoch < to:
            self.flush()
        self.domain.advance_epoch(to)

    def advance_tick(self) -> None:
        if self.manual_advance:
            self.flush()

    def flush(self) -> None:
        """Tell what the current epoch changed, then begin the next; an epoch that
        an open input has not passed yet goes on."""
        epoch = self.domain.epoch
        if self.domain.inputs and min(self.domain.inputs.values()) <= epoch:
            return
        if self.listener is not None:
            plans = {n: self.domain.rules[n].plan for n in self.interests if n in self.domain.rules}
            self.domain.transact([*self.listener.drain(), *introspection.sizes(self.domain, epoch, plans), *self.timings])
            self.timings = []
        for i in list(self.interests.values()):
            began = time.monotonic()
            self._show(i, epoch)
            if self.listener is not None:
                self.timings.append(Datom.add(i.name, "schedule/elapsed-ms", int((time.monotonic() - began) * 1000)))
        self.domain.advance_epoch(epoch + 1)
        self.domain.advance()

    def _show(self, i: Interest, epoch: int) -> None:
        if i.shown_until < epoch - 1:
            # the first time: everything there is, at this epoch
            r = self.domain.query(i.name, epoch).with_weights().consolidated()
            diffs = r.df.select(*r.columns, F.lit(epoch).cast("long").alias(TIME), F.col("_w").cast("long").alias("_diff"))
        else:
            diffs = epoch_diffs(self.domain, i.name, epoch)
        i.shown_until = epoch
        if i.granularity:
            i.waiting.append(diffs.withColumn(TIME, coarsen_column(F.col(TIME), i.granularity)))
            if epoch + 1 < coarsen(epoch, i.granularity):
                return
            diffs = i.waiting[0]
            for d in i.waiting[1:]:
                diffs = diffs.union(d)
            i.waiting = []
            columns = [c for c in diffs.columns if c != "_diff"]
            diffs = diffs.groupBy(*columns).agg(F.sum("_diff").alias("_diff")).where(F.col("_diff") != 0)
        if i.sink is not None:
            for name, body, t, diff in i.sink.write(i.name, diffs, epoch):
                self.outputs.append(Output("json", name, body, t, diff))
            return
        columns = [c for c in diffs.columns if c not in (TIME, "_diff")]
        for row in diffs.toLocalIterator():
            self.outputs.append(Output("diff", i.name, tuple(row[c] for c in columns), row[TIME], row["_diff"]))

    # -- streams ---------------------------------------------------------------
    def attach_stream(self, stream: DataFrame, to_changes: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, **trigger):
        """Every micro-batch of a streaming DataFrame is one message:
        ``to_changes`` makes each attribute's (e, v[, _w]) of a batch."""

        def batch(df: DataFrame, _: int) -> None:
            df.persist()
            try:
                for name, changes in to_changes(df).items():
                    from factflow.storage import settle

                    self.domain.transact_frame(name, settle(changes))
                self.flush()
            finally:
                df.unpersist()

        writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        query = (writer.trigger(**trigger) if trigger else writer).start()
        self.streams.append(query)
        return query

    def attach_csv(self, source: CsvFile, checkpoint: str, **trigger):
        for n, config in source.configs().items():
            if not self.domain.has(n):
                self.domain.create_attribute(n, config)
        return self.attach_stream(source.stream(self.spark), lambda df: {n: source.pairs(df, n) for n in source.schema}, checkpoint, **trigger)

    # -- the rest --------------------------------------------------------------
    def status(self) -> dict[str, Any]:
        return {
            "epoch": self.domain.epoch, "attributes": sorted([*self.domain.logs, *self.domain.tables, *self.domain.derived, *self.domain.views]),
            "rules": sorted(self.domain.rules), "interests": {n: sorted(i.clients) for n, i in self.interests.items()},
        }

    def query(self, plan, epoch: int | None = None) -> DataFrame:
        return result_columns(self.domain.query(plan, epoch))

    def shutdown(self) -> None:
        for s in self.streams:
            s.stop()
        if self.listener is not None:
            self.spark.streams.removeListener(self.listener)
            self.listener = None
        self.interests.clear()
        self.running = False


def _derived_pairs(compiler: Compiler, attribute: str, levels) -> DataFrame:
    """The attribute's facts of the entities that a selection's levels reach."""
    out = None
    for level in levels:
        df, weighted = compiler.source.pairs(attribute)
        if weighted:
            df = df.where(F.col("_w") > 0)
        if isinstance(level, PullLevel):
            r = compiler.plan(level.plan)
            df = df.join(r.df.select(F.col(r.column(level.pull_variable)).alias("e")).distinct(), "e", "left_semi")
        df = df.select("e", "v")
        out = df if out is None else out.union(df)
    return out.distinct()


def sink_from_json(body: Any) -> Sink | None:
    if body is None:
        return None
    [(kind, value)] = body.items() if isinstance(body, dict) else [(body, None)]
    match kind:
        case "TheVoid":
            return TheVoid(value)
        case "AssocIn":
            return AssocIn((value or {}).get("stateful"))
        case "CsvFile":
            return FileSink(value["path"])
        case "Memory":
            return MemorySink()
    raise IncorrectError(f"unknown sink {kind!r}")


def source_from_json(body: dict) -> CsvFile | JsonFile | ParquetTable:
    [(kind, value)] = body.items()
    match kind:
        case "CsvFile":
            schema = value["schema"]
            if isinstance(schema, list):
                schema = {n: (c, next(iter(k)) if isinstance(k, dict) else k) for n, (c, k) in schema}
            more = {k: value[k] for k in ("eid_offset", "has_headers", "delimiter", "comment", "timestamp_offset") if value.get(k) is not None}
            return CsvFile(value["path"], {n: tuple(x) for n, x in schema.items()}, **more)
        case "JsonFile":
            return JsonFile(value["path"], value["schema"])
        case "ParquetTable":
            return ParquetTable(value["path"], value["key"], value["attributes"], value.get("unique", True))
    raise IncorrectError(f"unknown source {kind!r}")
