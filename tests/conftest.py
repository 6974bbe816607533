from __future__ import annotations

import logging
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent
sys.path[:0] = [str(ROOT.parent), str(ROOT)]

from evalspark.session import build_session  # noqa: E402

# Workloads with failing queries are part of the tests; their traces are not of interest.
logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL)


@pytest.fixture(scope="session")
def spark():
    session = build_session(shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
