"""Handlers of claimed jobs: the user's functions by job name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CALLS = "id string, worker_id string, attempt int, failed boolean, retryable boolean, error string, result binary"


class NoRetry(Exception):  # noqa: N818
    """Raised by a handler for a failure that no other attempt can mend."""


def handle(claimed: DataFrame, handlers: dict[str, Callable[[bytes | None], bytes | None]]) -> DataFrame:
    """The calls that ``lifecycle.finish`` takes, one for each claimed job (id, name, worker_id, attempts, payload).

    What a handler returns is the job's result; what it raises is a failure. A job
    without a handler fails for good.
    """

    def one(name: str, payload: bytes | None) -> tuple[bool, bool, str | None, bytes | None]:
        try:
            if name not in handlers:
                raise NoRetry(f"no handler for {name}")
            return False, True, None, handlers[name](payload)
        except NoRetry as e:
            return True, False, str(e), None
        except Exception as e:  # noqa: BLE001  whatever user code raises is the job's failure
            return True, True, str(e) or type(e).__name__, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["id"], r["worker_id"], r["attempts"], *one(r["name"], r["payload"])) for r in b.to_pylist()]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.binary()]
            cols = list(zip(*rows)) or [()] * len(kinds)
            names = ["id", "worker_id", "attempt", "failed", "retryable", "error", "result"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return claimed.select("id", "name", "worker_id", "attempts", "payload").mapInArrow(run, CALLS)
