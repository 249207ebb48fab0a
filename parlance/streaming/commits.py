"""First-wins commits on a stream: of the questions of one form the first by order wins, whatever order the files come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegralType, LongType, StringType, StructField, StructType

from parlance.functions.text import normalize_question

#: Fixed value: the state store that keeps lists, timers and values of a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns that go with a row to the processor, behind its own: its form, its time in milliseconds and its form's bucket.
FORM, TIME, BUCKET = "question_key", "question_ms", "question_bucket"
#: Fixed value: buckets that forms are dealt to. A batch reads and writes those that its rows and due times touch, whole.
BUCKETS = 1024


def use_store(spark: SparkSession) -> None:
    """Streams that are started from now on in this session keep their state in the store that commits need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class FirstWins(StatefulProcessor):
    """For the forms of a bucket: of each the best row so far until the time to commit has come, then only a mark that it is taken.

    A row that loses is told at once, by the row that beats it or when it comes; the winner is told when the watermark has
    passed the first row's time by ``hold``. The mark goes when it has passed by ``forget`` more, if that is given.
    Calls of the state and frames cost far more than rows, so those are made for a bucket, not for a form: it has two lists,
    read once in a batch that has rows of it and written if they change, and a timer for what is due in it first.
    """

    def __init__(self, columns: list[str], kinds: StructType, order: str, hold_ms: int, forget_ms: int | None) -> None:
        self.columns, self.kinds, self.order, self.hold_ms, self.forget_ms = columns, kinds, order, hold_ms, forget_ms
        self.whole = {k for k, f in enumerate(kinds) if isinstance(f.dataType, IntegralType)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = StructType([StructField("form", StringType()), StructField("due", LongType()), StructField("row", self.kinds)])
        self.open = handle.getValueState("open", StructType([StructField("forms", ArrayType(held))]))
        self.taken = handle.getValueState("taken", "forms array<struct<form:string,at:bigint>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, taken = self._held()
        before, at, fresh, beaten = self._next(best, taken), self.columns.index(self.order), {}, False
        for batch in rows:
            told = []
            # By place, as columns may come under other names here.
            for *row, form, ms, _ in batch.itertuples(index=False, name=None):
                held = best.get(form)
                if form in taken:
                    told.append((row, "in_run"))
                elif held is None:
                    best[form], fresh[form] = (0, row), ms
                elif row[at] < held[1][at]:
                    told.append((held[1], "in_batch"))
                    best[form] = held[0], row
                    beaten = True
                    if form in fresh:
                        fresh[form] = ms
                else:
                    told.append((row, "in_batch"))
            if told:
                yield self._frame(told)
        if fresh or beaten:
            # A form is due by the best row of the batch in which it came.
            self._keep(best | {form: (ms + self.hold_ms, best[form][1]) for form, ms in fresh.items()})
            after = min(fresh.values(), default=None)
            if after is not None and (before is None or after + self.hold_ms < before):
                self.handle.registerTimer(after + self.hold_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best, taken = self._held()
        expired = expiredTimerInfo.getExpiryTimeInMs()
        now = max(expired, timerValues.getCurrentWatermarkInMs() - 1)
        left = taken if self.forget_ms is None else {form: at for form, at in taken.items() if at + self.forget_ms > now}
        due = {form: held for form, held in best.items() if held[0] <= now}
        best = {form: held for form, held in best.items() if form not in due}
        if due:
            self._keep(best)
        if due or len(left) < len(taken):
            left = left | {form: held[0] for form, held in due.items()}
            self.taken.update((list(left.items()),)) if left else self.taken.clear()
        after = self._next(best, left)
        if after is not None:
            # The timer that has gone off is taken away behind this.
            self.handle.registerTimer(max(after, expired + 1))
        if due:
            yield self._frame([(held[1], "accepted") for held in due.values()])

    def close(self) -> None:
        pass

    def _held(self) -> tuple[dict, dict]:
        """What the bucket holds: by form what is due when and the best row, and by form the time of its mark."""
        best, taken = self.open.get(), self.taken.get()
        return {form: (due, tuple(row)) for form, due, row in best[0]} if best else {}, {form: at for form, at in taken[0]} if taken else {}

    def _keep(self, best: dict) -> None:
        self.open.update(([(form, held[0], self._plain(held[1])) for form, held in best.items()],)) if best else self.open.clear()

    def _next(self, best: dict, taken: dict) -> int | None:
        """When something is due in the bucket next."""
        times = [held[0] for held in best.values()]
        if self.forget_ms is not None:
            times += [at + self.forget_ms for at in taken.values()]
        return min(times, default=None)

    def _plain(self, row: tuple) -> tuple:
        """A row as the state takes it: numbers and times of Python, null for what pandas calls missing; whole numbers stay whole."""
        values = (None if pd.api.types.is_scalar(v) and pd.isna(v) else int(v) if k in self.whole else v for k, v in enumerate(row))
        return tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v for v in values)

    def _frame(self, told: list[tuple[tuple, str]]) -> pd.DataFrame:
        columns = zip(*((*self._plain(row), outcome) for row, outcome in told))
        return pd.DataFrame({c: pd.Series(v, dtype="Int64") if k in self.whole else pd.Series(v) for k, (c, v) in enumerate(zip([*self.columns, "outcome"], columns))})


def milliseconds(span: str) -> int:
    """A span such as ``2 hours`` or ``10 days``."""
    return int(pd.Timedelta(span).total_seconds() * 1000)


def first_wins_stream(stream: DataFrame, *, question: str = "question", order: str = "conversation_index", time: str = "ts", delay: str = "1 hour", forget: str | None = None) -> DataFrame:
    """Rows of a stream with ``outcome``: accepted, in_batch, in_run or blank, as ``dedup.first_wins`` gives them for a table.

    A row may come later than one of a higher order or a later ``time``, by ``delay`` at most; rows behind that are
    dropped by the watermark. A winner is told once the watermark, ``delay`` behind the latest time, has passed its
    form's first row by another ``delay``; rows of its form that come after that are in_run. State lies in the checkpoint, so a restart
    goes on where the stream was. ``use_store`` must have been called. The order must not be null; repeated orders are
    settled by arrival.
    """
    form = F.md5(F.coalesce(normalize_question(F.col(question)), F.lit("")))
    rows = stream.withWatermark(time, delay).withColumn(FORM, form)
    columns = stream.columns
    processor = FirstWins(columns, stream.schema, order, milliseconds(delay), None if forget is None else milliseconds(forget))
    told = StructType([*stream.schema.fields]).add("outcome", "string")
    blank = F.md5(F.lit(""))
    # Blank questions have no form; each is told as it comes, in a group for each order.
    asked = rows.filter(F.col(FORM) != blank).withColumns({TIME: F.unix_millis(time), BUCKET: F.pmod(F.xxhash64(FORM), F.lit(BUCKETS))})
    # pandas takes whole numbers for floats where some are null; as decimals they arrive as they are.
    exact = {f.name: F.col(f.name).cast("decimal(19,0)") for f in stream.schema if isinstance(f.dataType, LongType) and f.name != order}
    judged = asked.withColumns(exact).groupBy(BUCKET).transformWithStateInPandas(processor, told, "Append", "EventTime")
    return judged.unionByName(rows.filter(F.col(FORM) == blank).select(*columns, F.lit("blank").alias("outcome")))
