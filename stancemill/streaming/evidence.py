"""The evidence threshold over a stream of labelled pages: a query's pages go on as soon as it has enough answers of one kind."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "search_query string, answer_id long, stance string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Evidence(StatefulProcessor):
    """For each query the numbers of its yes and no pages, and the pages that wait for the threshold: less than twice least."""

    def __init__(self, least: int, patience_ms: int | None):
        self.least, self.patience_ms = least, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "yes long, no long, due long")
        self.waiting = handle.getListState("waiting", "answer_id long, stance string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yes, no, due = self.counts.get() if self.counts.exists() else (0, 0, 0)
        enough, out, wait = max(yes, no) >= self.least, [], []
        for batch in rows:
            for answer_id, stance in zip(batch["answer_id"], batch["stance"]):
                if stance not in ("yes", "no"):
                    continue
                yes, no = yes + (stance == "yes"), no + (stance == "no")
                (out if enough else wait).append((int(answer_id), stance))
                if not enough and max(yes, no) >= self.least:
                    enough = True
                    if self.waiting.exists():
                        out += [(int(a), s) for a, s in self.waiting.get()]
                        self.waiting.clear()
                    out, wait = out + wait, []
        if wait:
            self.waiting.appendList(wait)
            if self.patience_ms is not None and not due:
                due = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
                self.handle.registerTimer(due)
        self.counts.update((yes, no, due))
        if out:
            yield pd.DataFrame({"search_query": [key[0]] * len(out), "answer_id": [a for a, _ in out], "stance": [s for _, s in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A query that did not get enough in time is forgotten, its pages and counts too; one that did goes on."""
        yes, no, _ = self.counts.get() if self.counts.exists() else (0, 0, 0)
        if max(yes, no) < self.least:
            self.waiting.clear()
            self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def evidence_stream(pages: DataFrame, least: int, patience_ms: int | None = None) -> DataFrame:
    """(search_query, answer_id, stance) of the yes and no rows of a stream pages (search_query, answer_id, stance, ...) once their query has least yes or least no rows.

    Over the whole stream the rows are those of the batch operator. With patience_ms a query has so long from the first
    page that waits; pages that come after it count anew. Null queries and answer_ids are left out. The session's
    spark.sql.streaming.stateStore.providerClass has to be PROVIDER.
    """
    known = pages.select("search_query", "answer_id", "stance").filter("search_query is not null and answer_id is not null")
    mode = "ProcessingTime" if patience_ms is not None else "None"
    return known.groupBy("search_query").transformWithStateInPandas(Evidence(least, patience_ms), OUTPUT, "Append", mode)
