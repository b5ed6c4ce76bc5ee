import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from tidemark.model import CHANGES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

T0 = dt.datetime(2024, 1, 1, 12, 0, 0, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def spark():
    # Tiny inputs: few tasks, and no time spent on compiling plans that run once.
    conf = {"spark.default.parallelism": "2", "spark.sql.shuffle.partitions": "3", "spark.sql.codegen.wholeStage": "false"}
    session = local_session("tests", 8, conf)
    yield session
    session.stop()


def cells(pairs):
    """Cells from a dict or a list of (name, value) or (name, type, value)."""
    if pairs is None:
        return None
    items = pairs.items() if isinstance(pairs, dict) else pairs
    return [(i[0], None, i[1]) if len(i) == 2 else i for i in items]


@pytest.fixture(scope="session")
def make(spark):
    """Change rows from dicts; unset fields get defaults, ``at`` is seconds after T0."""

    def build(*rows):
        out = []
        for i, r in enumerate(rows):
            at = T0 + dt.timedelta(seconds=r.get("at", i))
            out.append(
                (
                    r.get("seq", i + 1), r.get("lsn", i + 1), at, r.get("wal_ts", at), r.get("action", "INSERT"),
                    r.get("schema", "public"), r.get("table", "users"), cells(r.get("columns", {})),
                    cells(r.get("old_keys")), r.get("meta"), r.get("relation_id"),
                )
            )
        return spark.createDataFrame(out, CHANGES)

    return build


def seqs(df):
    return sorted(r.seq for r in df.select("seq").collect())


def values(df, name):
    """The value of a column per row in arrival order, from the cells."""
    return [
        next((c["value"] for c in r["columns"] if c["name"] == name), None) for r in df.orderBy("seq").collect()
    ]


def metas(df, key):
    return [(r["meta"] or {}).get(key) for r in df.orderBy("seq").collect()]
