import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from chronoweave.session import local_session

    session = local_session(4, shuffle_partitions=4, memory="4g")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session


@pytest.fixture
def split_rows(spark):
    """Set the rows above which an entity is cut; put back afterwards."""
    from chronoweave.session import ROWS_PER_SPLIT

    def use(rows):
        spark.conf.set(ROWS_PER_SPLIT, str(rows))

    yield use
    spark.conf.unset(ROWS_PER_SPLIT)


def collected(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
