"""Progress of running work: how many pages of each document are done, failed and to come, while a stream reads them."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "page_progress"


def watched(results: DataFrame, documents: list[str], name: str = NAME) -> DataFrame:
    """Page results (doc, page, error) whose counts are told with each batch's progress: for each of the documents watched the pages done (without an error)
    and failed, and both for all documents. The counts are made as the rows pass; documents are those that someone waits for, a few."""
    bad = F.col("error").isNotNull()
    of = [m for i, d in enumerate(documents) for m in (F.count_if((F.col("doc") == d) & ~bad).alias(f"done_{i}"), F.count_if((F.col("doc") == d) & bad).alias(f"failed_{i}"))]
    return results.observe(name, F.count_if(~bad).alias("done"), F.count_if(bad).alias("failed"), *of)


class Progress(StreamingQueryListener):
    """What a stream of watched results has told so far: per document pages done, failed and pending, and whether the stream runs. A batch that is replayed
    after a restart counts once."""

    def __init__(self, pages: dict[str, int], name: str = NAME):
        self.pages, self.name, self.lock = dict(pages), name, threading.Lock()
        self.batches: dict[tuple[str, int], dict[str, int]] = {}
        self.running: set[str] = set()
        self.error: str | None = None

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics.get(self.name)
        if told is not None:
            with self.lock:
                self.batches[str(event.progress.id), event.progress.batchId] = told.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.running.discard(str(event.runId))
            self.error = event.exception or self.error

    def state(self) -> dict:
        """{"running", "error", "done", "failed", "documents": {doc: (done, failed, pending)}}"""
        with self.lock:
            add = lambda key: sum(b.get(key) or 0 for b in self.batches.values())
            documents = {}
            for i, (doc, n) in enumerate(self.pages.items()):
                done, failed = add(f"done_{i}"), add(f"failed_{i}")
                documents[doc] = (done, failed, max(0, n - done - failed))
            return {"running": bool(self.running), "error": self.error, "done": add("done"), "failed": add("failed"), "documents": documents}
