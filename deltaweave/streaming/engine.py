"""Continuous evaluation: batches of changes in, changes of the outputs out.

The net state of every table and output is kept as a version per batch in a folder of the shared store. A step reads the last
version, so it can be repeated after a failure: a batch that is already committed returns its stored changes again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.types import spark_schema
from ..operators import replay
from ..operators.zset import W, ZSet
from ..plans.circuit import Plan
from ..plans.staging import shared_folder

Sink = Callable[[str, DataFrame, int], None]


class Engine:
    def __init__(self, spark: SparkSession, plan: Plan, outputs: list[str], folder: str | None = None) -> None:
        import uuid

        self.spark, self.plan, self.outputs = spark, plan, outputs
        for o in outputs:
            plan.node(o)
        self.folder = folder or f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}"
        self.delays = any(n.op == "delay" for n in plan.graph.nodes)
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.last = max((int(s.getPath().getName()[1:]) for s in (self.fs.listStatus(self.path(self.folder)) if self.fs.exists(self.path(self.folder)) else []) if self.fs.exists(self.path(f"{s.getPath().toString()}/_DONE"))), default=-1)

    def at(self, epoch: int, kind: str, name: str) -> str:
        return f"{self.folder}/v{epoch}/{kind}-{name.replace('.', '__')}"

    def held(self, epoch: int, kind: str, name: str, schema) -> ZSet | None:
        path = self.at(epoch, kind, name)
        if epoch < 0 or not self.fs.exists(self.path(path)):
            return None
        return ZSet.of(self.spark.read.schema(schema.add(W, "long") if W not in schema.fieldNames() else schema).parquet(path), W)

    def step(self, batch: dict[str, DataFrame], epoch: int | None = None) -> dict[str, DataFrame]:
        """Apply one batch (table -> declared columns and ``__w``) and return each output's changes."""
        epoch = self.last + 1 if epoch is None else epoch
        if epoch > self.last:
            self._advance(batch, epoch)
        return {o: self.spark.read.parquet(self.at(epoch, "delta", o)) for o in self.outputs}

    def _advance(self, batch: dict[str, DataFrame], epoch: int) -> None:
        previous = self.last
        tables: dict[str, ZSet] = {}
        for name, t in self.plan.sources.items():
            schema = spark_schema(t)
            names = schema.fieldNames()
            given = batch.get(name)
            fresh = self.spark.createDataFrame([], spark_schema(t).add(W, "long")) if given is None else given.select(*names, F.col(W).cast("long").alias(W))
            if self.delays:
                fresh = fresh.withColumn(replay.E, F.lit(epoch).cast("long"))
                old = None if previous < 0 else self.spark.read.parquet(self.at(previous, "log", name))
                whole = fresh if old is None else old.unionByName(fresh)
                whole.write.mode("overwrite").parquet(self.at(epoch, "log", name))
                tables[name] = self.spark.read.parquet(self.at(epoch, "log", name))
            else:
                old = self.held(previous, "state", name, spark_schema(t))
                z = ZSet.of(fresh, W)
                z = (z if old is None else old.plus(z)).norm()
                z.df.write.mode("overwrite").parquet(self.at(epoch, "state", name))
                tables[name] = self.held(epoch, "state", name, spark_schema(t))
        if self.delays:
            for o, z in self.plan.replay(self.spark, tables, self.outputs, epoch).items():
                z.df.where(F.col(replay.E) == epoch).drop(replay.E).write.mode("overwrite").parquet(self.at(epoch, "delta", o))
        else:
            for o, z in self.plan.snapshot(self.spark, tables, self.outputs).items():
                now = z.norm()
                now.df.write.mode("overwrite").parquet(self.at(epoch, "out", o))
                schema = now.df.schema
                new, old = self.held(epoch, "out", o, schema), self.held(previous, "out", o, schema)
                (new if old is None else new.minus(old)).weighted().write.mode("overwrite").parquet(self.at(epoch, "delta", o))
        self.fs.create(self.path(f"{self.folder}/v{epoch}/_DONE")).close()
        self.last = epoch
        if previous > 0:  # the version before the last is enough to repeat a step
            self.fs.delete(self.path(f"{self.folder}/v{previous - 1}"), True)

    def follow(self, streams: dict[str, DataFrame], sink: Sink, checkpoint: str | None = None, **trigger):
        """Run over a streaming DataFrame (one table; ``__w`` optional); each micro-batch is an epoch."""
        ((name, stream),) = streams.items()
        if W not in stream.columns:
            stream = stream.withColumn(W, F.lit(1).cast("long"))

        def each(df: DataFrame, batch_id: int) -> None:
            for o, d in self.step({name: df}, batch_id).items():
                sink(o, d, batch_id)

        writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or f"{self.folder}-progress")
        return (writer.trigger(**trigger) if trigger else writer).start()
