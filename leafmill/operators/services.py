"""Rows answered by a rate-limited service: bounded concurrency, a shared pause, retries.

A service is any callable from a payload to a ``Reply``; what it raises counts as a
broken connection.  Each task asks with a pool of threads behind one gate: when the
service refuses (429), is busy (500, 502, 503, 504) or cannot be reached, the gate shuts
for all of the task's threads until the wait is over.  At most ``jobs`` requests are open
in the whole cluster, since ``tasks`` tasks share them.  A row that fails for good is a
row with an error.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.functions import text

#: Tries of a request, states of a server that recover, and the longest pause in seconds.
TRIES, BUSY, LONGEST = 10, (500, 502, 503, 504), 120.0
ANSWER = "body string, attempts int, waited_ms bigint, error string"


class Reply(NamedTuple):
    status: int
    body: str
    retry_after: str | None = None


Service = Callable[[bytes], Reply]


def _seconds(value: str | None) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def asked_wait(header: str | None, body: str, attempt: int) -> float:
    """Seconds that a refusal asks for: its header's, else those its body names, else 5 an attempt; 0.1 to LONGEST."""
    found = re.search(r"try again in ([^s]*)", body)
    first, minute, rest = (found[1] if found else "").partition("m")
    named = _seconds(first) * 60 + _seconds(rest) if minute else _seconds(first)
    told = _seconds(header)
    return min(max(told if told > 0 else named if named > 0 else 5.0 * attempt, 0.1), LONGEST)


class Gate:
    """Shut for all who pass until the last wait that was asked for is over; ``second`` is a second's length."""

    def __init__(self, second: float = 1.0):
        self.second, self.lock, self.open_at = second, threading.Lock(), 0.0

    def enter(self) -> None:
        while True:
            with self.lock:
                left = self.open_at - time.monotonic()
            if left <= 0:
                return
            time.sleep(left)

    def shut(self, seconds: float) -> None:
        with self.lock:
            self.open_at = max(self.open_at, time.monotonic() + seconds * self.second)


def ask(service: Service, payload: bytes, gate: Gate, tries: int = TRIES) -> tuple[str | None, int, int, str | None]:
    """(body, attempts, milliseconds of waits asked for, error) of one request."""
    waited = 0
    for attempt in range(1, tries + 1):
        gate.enter()
        wait = 2.0 * attempt
        try:
            reply = service(payload)
        except Exception as broken:
            error = f"{type(broken).__name__}: {broken}"
        else:
            if 200 <= reply.status < 300:
                return reply.body, attempt, waited, None
            error = f"status {reply.status}: {reply.body}"
            if reply.status == 429:
                wait = asked_wait(reply.retry_after, reply.body, attempt)
            elif reply.status not in BUSY:
                return None, attempt, waited, error
        if attempt < tries:
            gate.shut(wait)
            waited += round(wait * 1000)
    return None, tries, waited, error


def answered(rows: DataFrame, payload: str, service: Service, *, jobs: int = 4, tasks: int = 1, tries: int = TRIES, second: float = 1.0) -> DataFrame:
    """``rows`` without ``payload``, with ``body``, ``attempts``, ``waited_ms`` and ``error`` of the request for each.

    A null payload is not asked for: its answer is null and its attempts are 0.  Columns
    of those names are replaced.
    """
    made = {f.name for f in StructType.fromDDL(ANSWER)}
    kept = [f for f in rows.schema if f.name != payload and f.name.lower() not in made]
    names = [f.name for f in kept]
    threads = max(1, jobs // tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = Gate(second)
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                wanted = batch.column("__payload")
                one = lambda i: ask(service, wanted[i].as_py(), gate, tries) if wanted[i].is_valid else (None, 0, 0, None)  # noqa: B023, E731
                answers = list(pool.map(one, range(len(wanted))))
                columns = [pa.array([a[k] for a in answers], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], names=[*names, "body", "attempts", "waited_ms", "error"])

    asked = rows.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{payload}`").cast("binary").alias("__payload")).repartition(tasks)
    return asked.mapInArrow(run, StructType([*kept, *StructType.fromDDL(ANSWER)]))


def chat_answer(body: Column) -> Column:
    """``struct<answer, complete>`` of a chat completion: its content without reasoning; null if it has none.

    An answer that was cut off at the service's limit ends with a note and is not complete.
    """
    content = F.get_json_object(body, "$.choices[0].message.content")
    found = text.strip_think(F.regexp_replace(content, r"(?U)^\s+|\s+$", ""))
    cut = F.coalesce(F.get_json_object(body, "$.choices[0].finish_reason") == "length", F.lit(False))
    shown = F.when(cut & found["complete"], F.concat(found["answer"], F.lit(text.TRUNCATED))).otherwise(found["answer"])
    return F.when(content.isNotNull(), F.struct(shown.alias("answer"), (found["complete"] & ~cut).alias("complete")))


def chat_recogniser(service: Service, **limits) -> Callable[[DataFrame], DataFrame]:
    """For ``plans.recognition``: ``(key, payload, error)`` of rows ``(key, image)``; an answer that is cut off has both."""

    def run(missing: DataFrame) -> DataFrame:
        told = answered(missing.select("key", "image"), "image", service, **limits).withColumn("found", chat_answer(F.col("body")))
        problem = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("found").isNull(), "the answer has no content").when(~F.col("found.complete"), "the answer is cut off")
        return told.select("key", F.col("found.answer").alias("payload"), problem.alias("error"))

    return run
