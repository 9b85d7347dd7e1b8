import tempfile

import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """Writes named tables to a folder that a query can be pointed at."""
    def write(**frames):
        where = tempfile.mkdtemp(dir=tmp_path)
        for name, df in frames.items():
            df.write.parquet(f"{where}/{name}.parquet")
        return where
    return write
