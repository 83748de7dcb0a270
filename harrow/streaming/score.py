"""Score a stream of queries: cleaning and the join with the index are stateless, ranks are taken per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harrow.functions.text import normalize_text
from harrow.operators.evaluate import make_answer
from harrow.operators.rank import top_k


def answer_stream(queries: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 10, **trigger) -> StreamingQuery:
    """Start a query that answers each micro-batch of ``queries(query_id, query_text)``.

    ``score`` maps cleaned queries to ``(query_id, doc_id, score)``; ``sink`` gets ``(query_id, answer)``
    and the batch id, which makes a repeated batch recognisable.
    """

    def batch(rows: DataFrame, number: int) -> None:
        clean = rows.withColumn("query_clean", normalize_text(F.col("query_text")))
        sink(make_answer(top_k(score(clean), k), k), number)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
