import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from armlens import schema as S  # noqa: E402
from armlens.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("tests", "8", 8)
    yield session
    session.stop()


DEFAULTS = {
    "task": "chat",
    "concurrency": 1,
    "system": "baseline",
    "gpu_type": "L4",
    "trial": 1,
    "ttft_ms": 50.0,
    "tpot_ms": 10.0,
    "total_latency_ms": 1000.0,
    "output_tokens": 100,
    "tokens_per_sec": 100.0,
    "gpu_cost_usd": 0.001,
    "output_text": "text",
    "acceptance_rate": None,
    "error": None,
}


@pytest.fixture(scope="session")
def requests_of(spark):
    """Request rows from the columns that matter to a test."""

    def make(*rows):
        full = []
        for i, row in enumerate(rows):
            values = {**DEFAULTS, "request_id": f"p{i:03d}_c1_t1", **row}
            full.append(tuple(values[f.name] for f in S.REQUEST.fields))
        return spark.createDataFrame(full, S.REQUEST)

    return make


def rows(df, *order):
    """Plain tuples in the order of the given columns."""
    found = [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]
    return found
