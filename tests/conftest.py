import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from triage.session import configure  # noqa: E402
from triage.sources import captures  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g"))
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def exchange(spark):
    """Exchange rows from (source_file, entries) captures given as plain dicts."""
    import json

    def make(*captures_given):
        rows = [(name, json.dumps({"log": {"version": "1.2", "entries": entries}})) for name, entries in captures_given]
        return captures.exchanges_from_har(spark.createDataFrame(rows, "source_file string, text string"))
    return make


def entry(url, method="GET", status=200, req=(), resp=(), body=None, text="", mime="application/json", params=(), cookies=(),
          set_cookies=()):
    pairs = lambda given: [{"name": n, "value": v} for n, v in given]
    request = {"method": method, "url": url, "headers": pairs(req), "cookies": pairs(cookies), "queryString": []}
    if body is not None or params:
        request["postData"] = {"text": body or "", "params": pairs(params)}
    return {"request": request, "response": {"status": status, "headers": pairs(resp), "cookies": list(set_cookies),
                                             "content": {"mimeType": mime, "text": text}}}


def texts(spark, *given):
    """Artifacts from (file name, text) pairs."""
    rows = [(n, "." + n.rsplit(".", 1)[-1], t) for n, t in given]
    return spark.createDataFrame(rows, "source_file string, suffix string, text string")
