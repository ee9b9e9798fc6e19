import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from offerscore.session import DEFAULT_CONF, ensure_checkpoint_dir
    b = SparkSession.builder.master("local[4]").appName("offerscore-tests") \
        .config("spark.sql.shuffle.partitions", "8")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def sample(spark):
    from tests.sample_offers import sample_frame
    return sample_frame(spark)


@pytest.fixture(scope="session")
def cleaned(sample):
    from offerscore.operators import prepare as P
    return P.coerce_numeric(P.compliant_only(sample))


@pytest.fixture(scope="session")
def raw_all(sample):
    from offerscore.operators import prepare as P
    return P.coerce_numeric(sample)
