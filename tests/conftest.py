import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docmetrics.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(
        "tests", "local[8]",
        **{"spark.driver.memory": "6g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="docmetrics-tests-")},
    )


@pytest.fixture
def scan(spark):
    """Items of inline sources: scan({'a.py': '...'}) or scan('...')."""
    from docmetrics.schema import SOURCE_FILES
    from docmetrics.sources.extract import extract_items

    def run(files, **modes):
        if isinstance(files, str):
            files = {"main.py": files}
        rows = [("demo", "latest", f"/src/{n}", n, n.rsplit("/")[-1][:-3], s) for n, s in files.items()]
        df = extract_items(spark.createDataFrame(rows, SOURCE_FILES), **modes)
        return df.orderBy("file_path", "item_ordinal").collect()

    return run


@pytest.fixture
def make_items(spark):
    """Item rows from dicts; missing fields are null."""
    from docmetrics.schema import DOC_ITEMS

    def make(rows):
        names = DOC_ITEMS.fieldNames()
        base = {"project": "demo", "snapshot_id": "latest", "file_path": "/main.py"}
        data = []
        for i, r in enumerate(rows):
            full = {**base, "item_ordinal": i, **r}
            data.append(tuple(full.get(n) for n in names))
        return spark.createDataFrame(data, DOC_ITEMS)

    return make
