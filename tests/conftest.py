import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    s = build_session("local[*]", app_name="ledgerline-tests", shuffle_partitions=8, extra={"spark.checkpoint.dir": shared})
    yield s
    s.stop()


def rows(df, *order):
    """Collect a small test frame as a list of dicts, sorted."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    if order:
        out.sort(key=lambda r: tuple(r[o] for o in order))
    return out
