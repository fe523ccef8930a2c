import json
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from logloom import configure

    session = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="logloom-tests-")).getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    return configure(session)


@pytest.fixture
def write(tmp_path):
    """Write log files: every row is a record or a raw line."""
    def put(name, rows, text=None):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        lines = [r if isinstance(r, str) else json.dumps(r) for r in rows]
        path.write_text(text if text is not None else "\n".join(lines) + "\n", encoding="utf-8")
        return str(path)
    return put


def at(n):
    return f"2026-01-01T00:{n // 60:02d}:{n % 60:02d}.000Z"


def event(n, kind, **payload):
    return {"timestamp": at(n), "type": kind, "payload": payload}


def rows(df, *names):
    picked = df.select(*names) if names else df
    return [tuple(r) for r in picked.collect()]
