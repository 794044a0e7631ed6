"""Continuous sample intake: files dropped in a folder are placed batch by batch against a snapshot."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborspark.operators import grow, place
from arborspark.plans import store
from arborspark.plans.analog import Bundle

SAMPLES = "sample string, pos int, ref int, allele int"


def placement_service(spark: SparkSession, b: Bundle, inbox: str, outbox: str, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """SM-1, SM-3, QX-20: reads Parquet files of samples in order of arrival and appends their placements.

    The checkpoint records finished files, so a restart neither loses nor repeats a batch's files; the
    batch number names the output folder, so a batch that is run again replaces its own output.
    """

    def run(batch: DataFrame, number: int) -> None:
        place.best(b, batch).write.mode("overwrite").parquet(f"{outbox}/batch={number}")

    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false").parquet(inbox)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def growing_service(spark: SparkSession, versions: str, inbox: str, outbox: str, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """SM-3, SM-5: as ``placement_service`` on a tree that grows: each batch's samples join the tree that the next batch sees.

    Trees are complete versions below ``versions`` (``store.save``); version 0 is the first one. A batch reads its own
    number's version, so one that is run again starts from the same tree, and a tree that was replaced
    in the folder is read at the next batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        b = store.load(spark, f"{versions}/version={number}")
        place.best(b, batch).write.mode("overwrite").parquet(f"{outbox}/batch={number}")
        store.save(grow.place_all(b, batch), f"{versions}/version={number + 1}")

    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false").parquet(inbox)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def requests(lines: DataFrame) -> DataFrame:
    """SM-2: ``lines(value, at)`` of a connection in order -> (request, words): a blank line ends a request, which holds one word per line."""
    from pyspark.sql.window import Window as W

    # one connection's lines are one order; they are a handful of words per request
    ends = F.sum((F.trim("value") == "").cast("int")).over(W.orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    numbered = lines.withColumn("request", F.coalesce(ends, F.lit(0)))
    return numbered.where(F.trim("value") != "").groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("words"))


def within_time(spark: SparkSession, name: str, seconds: float, work: Callable[[], object]) -> object:
    """SM-4: the result of ``work``; after ``seconds`` its jobs are cancelled and it is a TimeoutError."""
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(name)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(name)
    timer.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"{name} took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(name)
