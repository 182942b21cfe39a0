"""The tail of growing files: every line once, whatever is appended, cut or replaced, over restarts."""

from __future__ import annotations

import os

import pyarrow.fs as pafs
import pytest

from tallyspark.sources import tail
from tallyspark.sources.shared import shared_dir


def put(path, text, mode="a"):
    with open(path, f"{mode}b") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


class Run:
    """Batches over one folder from one checkpoint, a new query each time."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = tail.register(spark), str(folder), options
        self.at = f"{shared_dir(spark)}/tail-{os.path.basename(self.folder)}"

    def new(self):
        rows = []
        stream = self.spark.readStream.format("tail").options(**self.options).load(self.folder)
        q = stream.writeStream.foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", self.at).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((os.path.basename(r.path), r.offset, r.value) for r in rows)


def test_appended_lines_are_read_once_over_restarts(spark, tmp_path):
    run = Run(spark, tmp_path)
    assert run.new() == []
    put(tmp_path / "a.jsonl", '{"a":1}\n\n  \r\n{"a":2}\r\n{"a":')
    put(tmp_path / "other.txt", "no\n")
    put(tmp_path / "_hidden.jsonl", "no\n")
    assert run.new() == [("a.jsonl", 0, '{"a":1}'), ("a.jsonl", 13, '{"a":2}')]
    assert run.new() == []
    put(tmp_path / "a.jsonl", "3")
    assert run.new() == []  # the line hasn't ended
    (tmp_path / "sub").mkdir()
    put(tmp_path / "sub" / "b.jsonl", "é\n")
    put(tmp_path / "a.jsonl", '}\n{"a":4}\n')
    assert run.new() == [("a.jsonl", 22, '{"a":3}'), ("a.jsonl", 30, '{"a":4}'), ("b.jsonl", 0, "é")]


def test_replaced_and_shortened_files_are_read_anew(spark, tmp_path):
    run = Run(spark, tmp_path)
    put(tmp_path / "a.jsonl", "one\ntwo\n")
    put(tmp_path / "b.jsonl", "x" * 5000 + "\nend\n")
    assert [r[2][:3] for r in run.new()] == ["one", "two", "xxx", "end"]
    put(tmp_path / "a.jsonl", "ONE\ntwo\nthree\n", "w")  # as long or longer, another head
    put(tmp_path / "b.jsonl", "x" * 5000 + "\n", "w")  # shorter, the same head
    assert [r[2][:3] for r in run.new()] == ["ONE", "two", "thr", "xxx"]
    os.remove(tmp_path / "a.jsonl")
    assert run.new() == []
    put(tmp_path / "a.jsonl", "ONE\n")
    assert [r[2] for r in run.new()] == ["ONE"]


def test_a_batch_that_is_run_again_reads_the_same_bytes(spark, tmp_path):
    """A batch that fails is planned again from the same two offsets, though the file has grown since."""
    run = Run(spark, tmp_path)
    put(tmp_path / "a.jsonl", "1\n2\n")
    stream = run.spark.readStream.format("tail").load(run.folder)

    def fail(b, _):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        stream.writeStream.foreachBatch(fail).option("checkpointLocation", run.at).trigger(availableNow=True).start().awaitTermination()
    put(tmp_path / "a.jsonl", "3\n")
    assert [r[2] for r in run.new()] == ["1", "2"]
    assert [r[2] for r in run.new()] == ["3"]
    assert run.new() == []


@pytest.mark.parametrize("split", [1, 3, 7, 64])
def test_ranges_of_any_size_share_out_the_lines(tmp_path, split):
    text = b"a\n\nbcd\n" + b"e" * 40 + b"\nfg\n" + b"h" * 9 + b"\nlast without an end"
    put(tmp_path / "a.jsonl", text)
    now = tail.found(str(tmp_path), ".jsonl", {})
    got = [(o, v) for s in tail.spans({}, now, split) for b in tail.read_span(str(tmp_path), s, 30) for o, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    assert got == [(0, "a"), (3, "bcd"), (48, "fg"), (51, "h" * 9)]


def test_long_lines_hold_no_more_than_a_block(tmp_path):
    put(tmp_path / "a.jsonl", b"x" * (3 << 20) + b"\nshort\n")
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "a.jsonl")) as f:
        n = (3 << 20) + 7
        assert list(tail.lines(f, 0, n, 1 << 20)) == [((3 << 20) + 1, b"short")]
        assert [o for o, _ in tail.lines(f, 0, n)] == [0, (3 << 20) + 1]
        assert list(tail.lines(f, 2 << 20, n, 1 << 20)) == [((3 << 20) + 1, b"short")]


def test_a_file_replaced_after_planning_gives_nothing(tmp_path):
    put(tmp_path / "a.jsonl", "old old\n")
    plan = tail.spans({}, tail.found(str(tmp_path), ".jsonl", {}), 100)
    put(tmp_path / "a.jsonl", "new new new\n", "w")
    assert [b for s in plan for b in tail.read_span(str(tmp_path), s, 100)] == []


def test_as_a_batch_source(spark, tmp_path):
    put(tmp_path / "a.jsonl", "1\n2\n3")
    got = tail.register(spark).read.format("tail").option("split", 2).load(str(tmp_path))
    assert sorted(r.value for r in got.collect()) == ["1", "2"]
