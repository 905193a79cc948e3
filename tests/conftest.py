import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from webstrata.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "webstrata-tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def pages(spark):
    from webstrata.plans import fixture
    # some rows without content, as binary files are
    return fixture.load_pages(spark, DATA).withColumn("content", F.when(F.col("type") != "img", F.col("content"))).cache()


@pytest.fixture(scope="session")
def documents(spark):
    from webstrata.plans import fixture
    return fixture.load_documents(spark, DATA).cache()


def rows_by(df, key):
    return {r[key]: r for r in df.collect()}
