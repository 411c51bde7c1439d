import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    import check

    s = check.session(4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over literal columns."""
    def run(expr, **cols):
        from pyspark.sql import functions as F

        df = spark.range(1).select(*[
            (v if not isinstance(v, (str, int, float, list, type(None))) else F.lit(v)).alias(k)
            for k, v in cols.items()])
        return df.select(expr.alias("x")).head().x
    return run
