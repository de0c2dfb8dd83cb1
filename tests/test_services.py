import threading
import time

import pytest
from pyspark.sql import functions as F

from leafmill.functions import parsers
from leafmill.operators import services
from leafmill.operators.services import Reply


class Scripted:
    """Replies by a script for each payload; the last reply stays."""

    def __init__(self, script):
        self.script, self.seen = script, {}

    def __call__(self, payload):
        n = self.seen[payload] = self.seen.get(payload, 0) + 1
        reply = self.script[payload.decode()]
        reply = reply[min(n, len(reply)) - 1]
        if isinstance(reply, Exception):
            raise reply
        return reply


SCRIPT = {
    "good": [Reply(200, "ok")],
    "twice": [Reply(429, "", "1.5"), Reply(503, "down"), Reply(204, "late")],
    "lost": [ConnectionError("gone"), Reply(200, "back")],
    "never": [Reply(500, "broken")],
    "wrong": [Reply(401, "who?")],
    "cut": [ConnectionError("gone")],
}


def test_each_row_is_answered_once_or_has_an_error(spark):
    rows = spark.createDataFrame([(k, k, 1) for k in SCRIPT] + [("none", None, 1), ("good", "good", 2)], "name string, payload string, attempts int")
    found = {}
    for r in services.answered(rows, "payload", Scripted(SCRIPT), jobs=2, second=0.0).collect():
        found.setdefault(r.name, []).append((r.body, r.attempts, r.waited_ms, r.error))
    ups = sum(range(1, 10)) * 2000
    assert found == {
        "good": [("ok", 1, 0, None)] * 2,
        "twice": [("late", 3, 1500 + 4000, None)],
        "lost": [("back", 2, 2000, None)],
        "never": [(None, 10, ups, "status 500: broken")],
        "wrong": [(None, 1, 0, "status 401: who?")],
        "cut": [(None, 10, ups, "ConnectionError: gone")],
        "none": [(None, 0, 0, None)],
    }
    assert services.answered(rows.limit(0), "payload", Scripted(SCRIPT)).count() == 0


def test_threads_are_bounded_and_a_refusal_stops_them_all():
    lock, state, calls = threading.Lock(), {"open": 0, "most": 0, "refused": False}, []

    def service(payload):
        with lock:
            state["open"] += 1
            state["most"] = max(state["most"], state["open"])
            refuse, state["refused"] = not state["refused"] and len(calls) == 5, state["refused"] or len(calls) == 5
            calls.append((time.monotonic(), refuse))
        time.sleep(0.02)
        with lock:
            state["open"] -= 1
        return Reply(429, "", "5") if refuse else Reply(200, "")

    from concurrent.futures import ThreadPoolExecutor

    gate = services.Gate(second=0.1)
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda i: services.ask(service, b"%d" % i, gate), range(30)))
    assert state["most"] <= 3 and all(e is None for *_, e in done) and sorted(a for _, a, *_ in done)[-2:] == [1, 2]
    (refused,) = [t for t, r in calls if r]
    # those that were open already end; nobody asks again before the wait is over
    assert not [t for t, _ in calls if refused + 0.1 < t < refused + 0.5]


@pytest.mark.parametrize("header, body, attempt", [("2.5", "", 1), (None, "try again in 3.75s", 1), ("700", "", 2), (None, "Try later", 4), (None, "please try again in 2m4.5s ok", 1), ("-1", "try again in x", 2), ("0.01", "", 1), (None, "try again in 1m", 1)])
def test_waits_equal_the_column_expression(spark, header, body, attempt):
    row = spark.createDataFrame([(header, body, attempt)], "header string, body string, attempt int")
    (told,) = row.select(parsers.retry_milliseconds(F.col("header"), F.col("body"), F.col("attempt"))).first()
    assert round(services.asked_wait(header, body, attempt) * 1000) == told


def test_chat_answers(spark):
    bodies = ['{"choices":[{"message":{"content":" a <think>b</think>"}}]}', '{"choices":[{"message":{"content":"x"},"finish_reason":"length"}]}', '{"choices":[]}', "no json", None]
    found = spark.createDataFrame([(b,) for b in bodies], "body string").select(services.chat_answer(F.col("body")).alias("a")).collect()
    assert [r.a and (r.a.answer.split("\n")[0], r.a.complete) for r in found] == [("a", True), ("x", False), None, None, None]
