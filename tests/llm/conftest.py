"""The session of the other tests, prepared for these queries."""

import pytest

from gridscan.llm.common import ready


@pytest.fixture(autouse=True)
def prepared(spark):
    ready(spark)
