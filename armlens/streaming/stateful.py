"""Chunk fold with own state: a row leaves after the terminal line or at the timeout."""

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from armlens import schema as S
from armlens.operators import chunks
from armlens.streaming import jobs

TOTALS = (
    "system string, gpu_type string, start_us bigint, first_us bigint, end_us bigint, chunks bigint,"
    " chars bigint, usage_tokens int, usage_seq bigint, closed boolean, error string"
)
STATE = "requests string, timer_ms bigint"
FIELDS = [part.split()[0] for part in TOTALS.split(", ")]


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


def together(a: dict, b: dict) -> dict:
    """The totals of two sets of one request's lines, whichever comes first."""
    newer = b if a["usage_seq"] is None or b["usage_seq"] is not None and b["usage_seq"] > a["usage_seq"] else a
    return {
        "system": _least(a["system"], b["system"]),
        "gpu_type": _least(a["gpu_type"], b["gpu_type"]),
        "start_us": _least(a["start_us"], b["start_us"]),
        "first_us": _least(a["first_us"], b["first_us"]),
        "end_us": _most(a["end_us"], b["end_us"]),
        "chunks": a["chunks"] + b["chunks"],
        "chars": a["chars"] + b["chars"],
        "usage_tokens": newer["usage_tokens"],
        "usage_seq": newer["usage_seq"],
        "closed": a["closed"] or b["closed"],
        "error": _most(a["error"], b["error"]),
    }


class ChunkFold(StatefulProcessor):
    """Adds up the totals of an open request's windows in one small row, among the rows of its group.
    A request leaves when the watermark has passed the windows up to its end, or up to its timeout;
    what comes then is ignored for twice the timeout.

    A call to the state and a field that is handed over cost more than a request's sums. So a trigger
    reads and writes a group's rows once, a group has one timer, for the first of its requests that is
    due, and rows come, stay and leave as JSON."""

    def __init__(self, timeout_s: float, window_s: float) -> None:
        self.timeout_ms = int(timeout_s * 1000)
        self.window_ms = int(window_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, timer = self._known()
        met = {}
        for row in rows:
            new = json.loads(row[1])
            request, new = new.get("request_id"), {name: new.get(name) for name in FIELDS}
            totals = met[request] if request in met else known[request][0] if request in known else None
            met[request] = new if totals is None else together(totals, new)
        for request, totals in met.items():
            left = request in known and known[request][2]
            if not left and totals["start_us"] is not None:
                known[request] = totals, self._due(totals), False
        return iter(self._go_on(known, timer, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known, timer = self._known()
        yield from self._go_on(known, None, timerValues)  # Spark deletes the timer that it fires

    def close(self) -> None:
        pass

    def _known(self) -> tuple[dict, int | None]:
        """Totals, due time and whether it has left, of each request of the group; the group's timer."""
        found = self.group.get()
        if found is None:
            return {}, None
        return {request: (dict(zip(FIELDS, totals)), *rest) for request, totals, *rest in json.loads(found[0])}, found[1]

    def _due(self, totals: dict) -> int:
        wanted = totals["start_us"] // 1000 + self.timeout_ms
        if totals["closed"]:
            wanted = min(wanted, totals["end_us"] // 1000)
        return wanted + self.window_ms + 1

    def _go_on(self, known: dict, timer: int | None, timerValues) -> list[Row]:
        """Lets go the requests that the watermark has passed, forgets those that left long ago, and keeps the others."""
        watermark, gone = timerValues.getCurrentWatermarkInMs(), []
        for request, (totals, due, left) in [*known.items()]:
            if due <= watermark and left:
                del known[request]
            elif due <= watermark:
                forget = max(totals["start_us"] // 1000 + 2 * self.timeout_ms, watermark) + self.window_ms + 1
                known[request] = totals, forget, True
                gone.append({"request_id": request, **totals})
        first = min((due for _, due, _ in known.values()), default=None)
        if first != timer and timer is not None:
            self.handle.deleteTimer(timer)
        if first != timer and first is not None:
            self.handle.registerTimer(first)
        if known:
            self.group.update((json.dumps([(request, [*totals.values()], *rest) for request, (totals, *rest) in known.items()]), first))
        else:
            self.group.clear()
        return [Row(requests=json.dumps(gone))] if gone else []


def window_totals(log: DataFrame, delay: str, timeout_s: float, window: str) -> DataFrame:
    """Each request's lines up to the terminal one as one row of totals per window of time."""
    parsed = chunks.sized(chunks.parse_lines(log.withWatermark("ts", delay)))
    # As long as a request that has left is remembered, its end cuts what still comes.
    lines = jobs.until_terminal(parsed, delay, f"{int(3 * timeout_s)} seconds")
    has_usage = F.col("usage_tokens").isNotNull()
    return lines.groupBy("request_id", F.window("ts", window)).agg(
        F.min("system").alias("system"),
        F.min("gpu_type").alias("gpu_type"),
        *chunks.line_totals(),
        F.max(F.when(has_usage, F.col("seq"))).alias("usage_seq"),
        *chunks.closing(),
    )


def fold_stateful(
    log: DataFrame,
    delay: str = "120 seconds",
    timeout_s: float = S.REQUEST_TIMEOUT_S,
    window_s: int = 60,
    groups: int = 1024,
) -> DataFrame:
    """Metrics row of each request once it ended, or failed by timeout.

    Lines of an open request may come in any order within ``delay``; lines after its end and in
    windows after its timeout do not count. They are added up per request and window in built-in aggregates; the state's
    own code sees one row per request and window and keeps one small row per request. Requests share a value of the
    state with the others of their group, one of ``groups`` by a hash of the id: some per shuffle partition, enough
    that a group's rows stay few, and as many for the life of a checkpoint.
    """
    totals = window_totals(log, delay, timeout_s, f"{window_s} seconds")
    group = F.pmod(F.xxhash64("request_id"), F.lit(groups)).cast("int").alias("group")
    rows = totals.select(group, F.to_json(F.struct("request_id", *FIELDS)).alias("totals"))
    left = rows.groupBy("group").transformWithState(
        statefulProcessor=ChunkFold(timeout_s, window_s),
        outputStructType="requests string",
        outputMode="append",
        timeMode="EventTime",
    )
    folded = left.select(F.inline(F.from_json("requests", f"array<struct<request_id string, {TOTALS}>>")))
    return chunks.request_metrics(folded, timeout_s, require_terminal=True)


# A stream starts its processor in a process that does not see shipped packages, so
# the processor travels with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
