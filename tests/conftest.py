import os
import sys
import uuid
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the workers
    from basalt.session import local

    shared = tmp_path_factory.mktemp("shared")
    session = local(4, 4, "4g", **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"file://{shared}/warehouse"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def engine(spark, tmp_path):
    from basalt.engine import Engine

    e = Engine(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", "proj-a", "main")
    e.catalog.create_project("proj-a")
    e.catalog.create_dataset("proj-a", "main")
    return e


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
