"""A query that is the first one of its session writes its files into a folder that nothing has made yet."""

import io
import os
from types import SimpleNamespace

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from strandlake import api, session
from strandlake.plans import registry
from strandlake.sources import files, writers
from strandlake.sources.readers import read_pileup
from tests.parity import FOLDER, assert_same
from tests.test_sources import pileup_line

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(params=["", "file://"])
def fresh(tmp_path, monkeypatch, request):
    """A shared folder that doesn't exist."""
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"{request.param}{tmp_path}/shared")
    return tmp_path / "shared"


def test_path_can_be_written(spark, fresh):
    assert not fresh.exists()
    path = session.scratch(spark, "one")
    with files.open_write(path) as f:
        f.write(b"text")
    with files.open_read(path) as f:
        assert f.read() == b"text"


@needs_tables
@pytest.mark.parametrize("name", ["pileup_extract", "pileup_single_file"])
def test_query_comes_first(spark, fresh, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE[name])


def test_extract_in_order_without_partitions_in_the_driver(spark, fresh, tmp_path, monkeypatch):
    lines = {c: [pileup_line(c, i, fraction="50") for i in range(2000)] for c in ("a", "b", "c")}
    bed = tmp_path / "p.bed"
    bed.write_text("\n".join(x for c in lines for x in lines[c]) + "\n")
    writers.write_bgzf_folder(read_pileup(spark, str(bed)), str(tmp_path / "f"), 4)

    def refused(*_):
        raise AssertionError("a partition came to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    for path in (str(bed), str(tmp_path / "f")):
        out = io.StringIO()
        api.extract_pileup(path, out, ["c", "a"], spark=spark)
        assert out.getvalue().splitlines() == lines["c"] + lines["a"]


def test_temporary_folder_of_a_local_session():
    """Without setting the folder in the session, which Spark refuses."""
    unset = SimpleNamespace(get=lambda *_: None)
    local = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="local[2]", applicationId="app-unset"))
    folder = session.shared_dir(local)
    assert files.is_folder(folder) and session.shared_dir(local) == folder
