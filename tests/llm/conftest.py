import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rows import ODD, SCHEMA


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns with names that the operators use themselves."""
    extra = ["block", "key", "t", "n_words", "n_removed", "kept", "posterior", "base_failed", "code", "seen", "n_symbols", "copies", "number",
             "k", "cell", "a", "b", "n", "keeper", "text_hash", "row_number", "group", "salt", "held", "size", "target", "chance", "seed"]
    from pyspark.sql import functions as F
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(c) for c in extra})
