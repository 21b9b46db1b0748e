import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillwork.session import local_session, shared_folder  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    shared_folder(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    from tillwork.plans.stages import stages

    return stages(spark, sf_dir)


@pytest.fixture
def sales(spark):
    """Build raw lines from (rid, invoice, code, quantity, ts, price, customer[, description, country])."""
    from datetime import datetime

    from tillwork.params import RAW_SCHEMA

    schema = "rid bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_SCHEMA)

    def make(*rows):
        full = []
        for rid, invoice, code, quantity, ts, price, customer, *rest in rows:
            description, country = (list(rest) + ["thing", "Here"][len(rest):])
            full.append((rid, invoice, code, description, quantity, datetime.fromisoformat(ts), price,
                         customer, country))
        return spark.createDataFrame(full, schema)

    return make
