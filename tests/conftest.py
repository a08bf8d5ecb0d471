import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from revcast.session import local_session
    s = local_session("*", app="revcast-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def features_small(spark):
    from revcast.plans.daily import feature_daily
    return feature_daily(spark, SF0001)


@pytest.fixture(scope="session")
def forecast_small(spark, features_small):
    from revcast.operators.forecast import forecast
    from revcast.plans.daily import materialize
    return materialize(forecast(features_small), "test-forecast")
