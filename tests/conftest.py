import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opsloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("opsloom-tests", cores=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    from opsloom.registry import Views

    return Views(spark, SMALL)


def rows(df, *order):
    """Rows as dicts, sorted by the given columns."""
    found = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(found, key=lambda r: tuple(r[c] for c in order)) if order else found
