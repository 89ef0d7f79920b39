from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from helpers import Tiny  # noqa: E402

from tuneledger.session import build_session  # noqa: E402
from tuneledger.sources import sample_warehouse  # noqa: E402
from tuneledger.sources.warehouse import Star, Warehouse  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", "tuneledger-tests", "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder() -> str:
    return FOLDER


@pytest.fixture(scope="session")
def warehouse(spark) -> Warehouse:
    return sample_warehouse.build(spark, FOLDER)


@pytest.fixture(scope="session")
def star(warehouse) -> Star:
    return warehouse.star()


@pytest.fixture(scope="session")
def tiny(spark) -> Tiny:
    return Tiny(spark)
