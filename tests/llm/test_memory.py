"""Workers give back what a task needed, whether it ends or breaks."""

import pyarrow as pa
import pytest

from lonja.llm import common


def test_a_task_that_ends_releases_its_memory(monkeypatch):
    gone = []
    monkeypatch.setattr(common, "release", lambda: gone.append(1))
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    assert list(common.frugal(lambda some: some)(iter(batches))) == batches and gone == [1]

    def broken(some):
        raise ValueError(next(some))

    with pytest.raises(ValueError):
        list(common.frugal(broken)(iter(batches)))
    assert gone == [1, 1]


def test_release_runs_in_any_process():
    common.release()
