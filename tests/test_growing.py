"""Growing files: every line once, over appends, restarts, renames and cuts."""

import os

import pytest

from wardlog.operators.classify import SSH
from wardlog.sources.growing import Folder, follow_logs, read_logs
from wardlog.streaming.logs import read_events, start_collector
from test_streaming import EPOCH, RULES, line


def append(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "ab") as file:
        file.write(text if isinstance(text, bytes) else text.encode())


def read_range(folder, ranges):
    return [row for part in ranges for batch in folder.batches(part) for row in batch.column("value").to_pylist()]


def test_stream_follows_growing_files(spark, tmp_path):
    logs, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "ck")

    def drain():
        stream = follow_logs(spark, str(logs), pattern="*.log*", splitBytes=16)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.value for r in spark.read.parquet(out).collect())

    append(logs / "a.log", "first of a\nsecond of a\nthird, not")
    append(logs / "empty.log", "")
    assert drain() == ["first of a", "second of a"]
    append(logs / "a.log", " ended\r\nfourth\n")
    append(logs / "b" / "a.log", "first of a\n")
    expected = ["first of a", "first of a", "fourth", "second of a", "third, not ended"]
    assert drain() == sorted(expected)
    assert drain() == sorted(expected)
    # Rotated: the old file still gets a line under its new name, the new one starts at 0.
    os.rename(logs / "a.log", logs / "a.log.1")
    append(logs / "a.log.1", "last of a\n")
    append(logs / "a.log", "new a\n")
    expected += ["last of a", "new a"]
    assert drain() == sorted(expected)
    # Cut to nothing and written anew.
    (logs / "a.log").write_text("newer a\n")
    expected += ["newer a"]
    assert drain() == sorted(expected)
    rows = spark.read.parquet(out)
    assert rows.select("cursor").distinct().count() == len(expected)
    again = read_logs(spark, str(logs), pattern="*.log*")
    assert again.join(rows, "cursor", "left_anti").isEmpty()


def test_ranges_cut_anywhere_give_every_line_once(tmp_path):
    content = b"head\n\nx" + b"y" * 40 + b"\r\n" + b"long" * 30 + b"\n\xff\xfe\nlast\nopen"
    append(tmp_path / "a.log", content)
    folder = Folder(str(tmp_path), limit=50)
    whole = [b"head", b"", b"x" + b"y" * 40, (b"long" * 30)[-52:], b"\xff\xfe", b"last"]
    for split in (1, 2, 3, 7, 50, 1_000):
        ranges = folder.ranges({}, folder.offset(), split)
        assert read_range(folder, ranges) == whole
        cursors = [c for part in ranges for batch in folder.batches(part) for c in batch.column("cursor").to_pylist()]
        assert len(set(cursors)) == len(whole)


def test_equal_first_lines(tmp_path):
    """Header lines do not confuse a rotated file with its successor, even a longer one."""
    folder = Folder(str(tmp_path))
    append(tmp_path / "a.log", "#head\none\n")
    append(tmp_path / "b.log", "#head\ntwo\n")
    start = folder.offset()
    os.rename(tmp_path / "a.log", tmp_path / "a.log.1")
    append(tmp_path / "a.log", "#head\nthree\nfour\n")
    append(tmp_path / "b.log", "five\n")
    ranges = folder.ranges(start, folder.offset(), 1 << 20)
    assert sorted(read_range(folder, ranges)) == [b"#head", b"five", b"four", b"three"]


def test_renamed_and_deleted_between_planning_and_reading(tmp_path):
    folder = Folder(str(tmp_path))
    append(tmp_path / "a.log", "one\ntwo\n")
    ranges = folder.ranges({}, folder.offset(), 1 << 20)
    os.rename(tmp_path / "a.log", tmp_path / "z.log")
    assert read_range(folder, ranges) == [b"one", b"two"]
    os.remove(tmp_path / "z.log")
    with pytest.raises(FileNotFoundError):
        read_range(folder, ranges)


def test_collector_on_a_growing_file(spark, tmp_path):
    logs, store = tmp_path / "logs", str(tmp_path / "store")

    def drain():
        start_collector(
            follow_logs(spark, str(logs)), "cowrie", store, str(tmp_path / "ck"), "sensor-one", EPOCH, RULES
        ).awaitTermination()
        return sorted(r.username for r in read_events(spark, store).collect())

    append(logs / "a.log", line(1) + "\n" + line(1) + "\n" + line(2)[:20])
    assert drain() == ["u1", "u1"]
    append(logs / "a.log", line(2)[20:] + "\n{broken\n" + line(3) + "\n")
    assert drain() == drain() == ["u1", "u1", "u2", "u3"]
    assert read_events(spark, store).where(f"kind = '{SSH}'").count() == 4
    assert spark.read.parquet(f"{store}/rejects").count() == 1


def test_no_files(spark, tmp_path):
    assert read_logs(spark, str(tmp_path / "missing")).isEmpty()
