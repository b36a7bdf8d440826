import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from packloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("packloom-tests", cores="4", partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"


@pytest.fixture
def corpus(spark):
    """Builds a files table from {path: text} or {(repo, path): text}."""

    def build(files: dict):
        rows = []
        for key, text in files.items():
            repo, path = key if isinstance(key, tuple) else ("r", key)
            rows.append((repo, path, len(text.encode()), text))
        return spark.createDataFrame(rows, "repo string, path string, size_bytes bigint, content string")

    return build


@pytest.fixture
def select(spark):
    """Builds a selection; a path ending in / is a directory."""

    def build(*paths, export_id=1, repo="r"):
        rows = [(export_id, repo, i, p.rstrip("/"), p.endswith("/")) for i, p in enumerate(paths)]
        return spark.createDataFrame(rows, "export_id bigint, repo string, root_ordinal int, path string, is_dir boolean")

    return build


def paths(df, column="path"):
    return sorted(r[column] for r in df.select(column).collect())
