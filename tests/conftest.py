from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ebbline.session import get_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("scratch")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True, scope="module")
def compile_only_large_plans(request, spark):
    """Tiny inputs run faster without compiling each plan; the catalog is tested with compilation."""
    compiled = request.module.__name__.endswith("test_catalog")
    spark.conf.set("spark.sql.codegen.wholeStage", str(compiled).lower())
    spark.conf.set("spark.sql.shuffle.partitions", "8" if compiled else "3")


@pytest.fixture
def rows():
    """All rows of a frame as dicts."""
    return lambda df: [row.asDict(recursive=True) for row in df.collect()]
