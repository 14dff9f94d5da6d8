import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from citegrain.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def each(spark):
    """Evaluate a column function on a list of rows of strings."""

    def run(function, rows):
        width = 1 if isinstance(rows[0], str) or rows[0] is None else len(rows[0])
        data = [(i, r) if width == 1 else (i, *r) for i, r in enumerate(rows)]
        names = [f"c{n}" for n in range(width)]
        df = spark.createDataFrame(data, "i int, " + ", ".join(f"{n} string" for n in names))
        out = df.select("i", function(*[F.col(n) for n in names]).alias("v")).collect()
        return [r.v for r in sorted(out, key=lambda r: r.i)]

    return run
