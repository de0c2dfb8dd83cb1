"""Registered queries of requests to a service, which is stood in for by one that refuses by a rule."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import services
from leafmill.plans.queries import _table, query


class Moody:
    """Refuses the first ``n % 12`` tries of a payload ``id:n``, in turn with a header, with a body and as busy; 400 where 13 divides n."""

    def __init__(self):
        self.tries: dict[bytes, int] = {}

    def __call__(self, payload: bytes) -> services.Reply:
        n = int(payload.decode().rpartition(":")[2])
        tried = self.tries[payload] = self.tries.get(payload, 0) + 1
        if n % 13 == 0:
            return services.Reply(400, "no")
        if tried > n % 12:
            message = {"content": f"<think>{tried}</think> read {n} "} if n % 7 else {}
            return services.Reply(200, json.dumps({"choices": [{"message": message, "finish_reason": "stop" if n % 5 else "length"}]}))
        if tried % 3 == 0:
            return services.Reply(503, "busy")
        return services.Reply(429, "wait", str(tried / 2)) if tried % 3 == 1 else services.Reply(429, f"Please try again in {tried}.25s.")


@query("""WITH d AS (SELECT doc_id, n_chars AS n, n_chars % 12 AS r, n_chars % 13 = 0 AS bad FROM documents),
t AS (SELECT *, CASE WHEN bad THEN 1 ELSE least(r + 1, 10) END AS attempts, NOT bad AND r < 10 AS ok FROM d)
SELECT doc_id, CAST(attempts AS INT) AS attempts,
  CAST(list_sum(list_transform(range(1, attempts), lambda a: CASE a % 3 WHEN 0 THEN 2000 * a WHEN 1 THEN 500 * a ELSE 1000 * a + 250 END)) AS BIGINT) AS waited_ms,
  CASE WHEN ok AND n % 7 <> 0 THEN 'read ' || n || CASE WHEN n % 5 = 0 THEN chr(10) || chr(10) || '*[Warning: the model''s answer was cut off by the token limit]*' ELSE '' END END AS answer,
  CASE WHEN ok AND n % 7 <> 0 THEN n % 5 <> 0 END AS complete,
  CASE WHEN bad THEN 'status 400: no' WHEN r >= 10 THEN 'status 429: wait' END AS error
FROM t""".replace("CAST(list_sum(", "CAST(coalesce(list_sum(").replace("END)) AS BIGINT)", "END)), 0) AS BIGINT)"))
def service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a service that refuses, with the tries and waits of each request."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", "doc_id", "n_chars").alias("payload"))
    told = services.answered(rows, "payload", Moody(), jobs=8, tasks=4, second=0.0)
    found = services.chat_answer(F.col("body"))
    return told.select("doc_id", "attempts", "waited_ms", found["answer"].alias("answer"), found["complete"].alias("complete"), "error")
