import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gearledger.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "gearledger-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def moved(spark):
    """What the exchanges of a plan move where nothing is broadcast: the list of columns of each."""
    import re

    def columns(df):
        text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return [re.findall(r"(\w+)#", line) for line in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)]

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield columns
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
