import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tablescout.session import local_session

    session = local_session("8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of a few rows, so that small tables cross block and group edges."""
    from tablescout.plans import sequence

    monkeypatch.setattr(sequence, "BLOCK_ROWS", 7)
    monkeypatch.setattr(sequence, "BLOCKS_PER_GROUP", 3)


def rows(df, *order):
    """Collected rows as dicts, sorted by the given columns."""
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[c]) for c in order)) if order else out


def only(df):
    got = df.collect()
    assert len(got) == 1, got
    return got[0].asDict()
