"""Pages of documents that arrive over several micro-batches: a keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

READY = "document_id bigint, page int, text string, complete boolean"


class PageBuffer(StatefulProcessor):
    """Holds a document's pages until all have come, or until no page has come for a while.

    State is a map of the pages held, how many there should be, and when to
    give up. It exists only for documents that tell their number of pages and
    lack some of them, and for no longer than the patience, so it is bounded by
    what arrives within that time.
    """

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "text string")
        self.expected = handle.getValueState("expected", "count int, until bigint")

    def _release(self, document_id: int, complete: bool) -> Iterator[Row]:
        for (page,), (text,) in sorted(self.pages.iterator()):
            yield Row(document_id=document_id, page=page, text=text, complete=complete)
        if self.expected.exists() and self.expected.get()[1] is not None:
            self.handle.deleteTimer(self.expected.get()[1])
        self.pages.clear()
        self.expected.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        fresh: dict[int, str] = {}
        count, arrived = None, 0
        for r in rows:
            fresh[r.page] = max(fresh.get(r.page, ""), r.text or "")  # of two texts of one page in a batch the greater
            count = max(count or 0, r.page_count or 0) or None
            arrived = max(arrived, int(r.arrived.timestamp() * 1000))
        held = dict((p, t) for (p,), (t,) in self.pages.iterator())
        known = self.expected.get() if self.expected.exists() else (None, None)
        if any(p in held and held[p] != t for p, t in fresh.items()):
            self.pages.clear()  # a page with another text: the document is sent anew
            held, known = {}, (None, known[1])
        for page, text in fresh.items():
            self.pages.updateValue((page,), (text,))
        count = count or known[0]
        if known[1] is not None:
            self.handle.deleteTimer(known[1])
        if count is None or len(held | fresh) >= count:
            self.expected.clear()
            yield from self._release(key[0], True)
            return
        until = arrived + self.patience
        self.handle.registerTimer(until)
        self.expected.update((count, until))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._release(key[0], False)

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Maps and timers need the state store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def buffered(pages: DataFrame, patience_ms: int) -> DataFrame:
    """(document_id, page, text, complete) of a stream of pages (document_id, page, text, page_count).

    Pages of a document that tells its page_count come out together, once all
    have come, or with complete = false when none has come for the patience.
    Pages without a page_count come out in their own batch. Time is that of
    arrival, so no page is too late. Rows without a document or a page number
    have no place and are left out.
    """
    arrived = pages.where("document_id is not null and page is not null").withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    return arrived.groupBy("document_id").transformWithState(PageBuffer(patience_ms), READY, "append", "eventTime")
