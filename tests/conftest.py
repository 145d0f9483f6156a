import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tabprep.session import checkpoint_dir, get_spark
    s = get_spark("local[*]", app="tabprep-tests", shuffle_partitions=8)
    checkpoint_dir(s)  # tests set their own shared folder when none is named
    yield s


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
