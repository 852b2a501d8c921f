"""Tables of snapshots: all or nothing, whoever else reads or writes."""

import threading

import pytest

from timeloom.sources import snapshots
from timeloom.sources.snapshots import commit, compact, read_snapshot, vacuum
from timeloom.sources.tables import replace_partition
from timeloom.streaming.tables import swap_analyses

KIND = "id int, video_id int, text string"


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def rows(spark, *given):
    return spark.createDataFrame(list(given), KIND)


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_versions(spark, path):
    assert commit(rows(spark, (1, 1, "a"), (2, 2, "b"), (3, None, "c")), path, "video_id") == 1
    assert commit(rows(spark, (4, 2, "d")), path, "video_id") == 2
    assert replace_partition(rows(spark, (5, 2, "e"), (6, None, "f")), path) == 3
    assert content(read_snapshot(spark, path)) == [(1, 1, "a"), (5, 2, "e"), (6, None, "f")]
    # a video whose new analysis has no rows is gone; what is added later stays
    assert replace_partition(rows(spark), path, keys=rows(spark, (0, 1, ""))) == 4
    commit(spark.createDataFrame([(7, 1, "g", 0.5)], KIND + ", extra double"), path, "video_id")
    now = content(read_snapshot(spark, path))
    assert now == [(5, 2, "e", None), (6, None, "f", None), (7, 1, "g", 0.5)]
    assert content(read_snapshot(spark, path, 2)) == [(1, 1, "a"), (2, 2, "b"), (3, None, "c"), (4, 2, "d")]
    assert compact(spark, path) == 6 == compact(spark, path) and content(read_snapshot(spark, path)) == now
    assert "Join" not in read_snapshot(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    commit(rows(spark, (8, 8, "h")), path, "video_id")
    vacuum(spark, path)
    assert content(read_snapshot(spark, path)) == [*now, (8, 8, "h", None)] and snapshots._versions(spark, path) == [7]
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, path + "2")


def test_a_reader_during_a_swap_sees_one_version(spark, path, monkeypatch):
    """What was read before the swap can still be used after it; and until the manifest has its name, the old rows are there."""
    commit(rows(spark, *[(i, i % 3, "old") for i in range(30)]), path, "video_id")
    early, seen, publish = read_snapshot(spark, path), [], snapshots._publish

    def watched(*args):
        seen.append(content(read_snapshot(spark, path)))  # files are written, the version is not
        return publish(*args)

    monkeypatch.setattr(snapshots, "_publish", watched)
    replace_partition(rows(spark, *[(100 + i, i % 3, "new") for i in range(5)]), path)
    assert seen == [content(early)] and {r[2] for r in seen[0]} == {"old"} and len(early.collect()) == 30
    assert {r[2] for r in content(read_snapshot(spark, path))} == {"new"}


def test_a_failed_commit_leaves_nothing(spark, path, monkeypatch):
    commit(rows(spark, (1, 1, "a")), path, "video_id")
    monkeypatch.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        replace_partition(rows(spark, (2, 1, "b")), path)
    assert content(read_snapshot(spark, path)) == [(1, 1, "a")]


def test_writers_at_the_same_time_lose_nothing(spark, path):
    commit(rows(spark, (0, 0, "x")), path, "video_id")
    todo = [threading.Thread(target=lambda i=i: replace_partition(rows(spark, (i, i, "t")), path)) for i in range(1, 6)]
    for t in todo:
        t.start()
    for t in todo:
        t.join()
    assert content(read_snapshot(spark, path)) == [(0, 0, "x")] + [(i, i, "t") for i in range(1, 6)] and len(snapshots._versions(spark, path)) == 6
    # the number of a version is given once
    assert not snapshots._publish(spark, path, 6, {}) and snapshots._versions(spark, path)[-1] == 6


class _Meeting:
    """A session whose user waits for the other writers at each turn to the JVM, the last time before its draft."""

    def __init__(self, spark, barrier):
        self.spark, self.barrier = spark, barrier

    def __getattr__(self, name):
        if name == "_jvm":
            self.barrier.wait()
        return getattr(self.spark, name)


def test_a_number_is_given_once(spark, path, tmp_path):
    """To the one whose manifest is there, which can be read; on a local file system the checksum of another's draft could come to lie beside it."""
    n, versions, won = 6, range(1, 101), {}
    barrier = threading.Barrier(n, timeout=60)

    def write(i):
        for v in versions:
            won[v, i] = snapshots._publish(_Meeting(spark, barrier), path, v, {"by": i, "more": "x" * i})

    todo = [threading.Thread(target=write, args=(i,)) for i in range(n)]
    for t in todo:
        t.start()
    for t in todo:
        t.join(120)
    for v in versions:
        assert [i for i in range(n) if won[v, i]] == [snapshots._manifest(spark, path, v)["by"]]
    assert sorted(f.name for f in (tmp_path / "table" / "manifests").iterdir()) == [f"{v:012d}.json" for v in versions]


def test_a_batch_counts_once(spark, path):
    one = rows(spark, (1, 1, "a"))
    assert [commit(one, path, "video_id", batch=b) for b in ("x:0", "x:0", "x:1", "x:0")] == [1, 1, 2, 2]
    assert len(content(read_snapshot(spark, path))) == 2


def test_a_stream_swaps(spark, path, tmp_path):
    """A video without a segment in its new analysis, and a batch that is run twice."""
    commit(rows(spark, (1, 1, "a"), (2, 2, "b"), (3, 3, "c")), path, "video_id")
    source = f"{tmp_path}/in"
    rows(spark, (9, 1, "new"), (None, 2, None)).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(KIND).parquet(source)
    for _ in range(2):
        swap_analyses(stream, path, f"{tmp_path}/ck").awaitTermination(120)
    assert content(read_snapshot(spark, path)) == [(3, 3, "c"), (9, 1, "new")]
    assert replace_partition(rows(spark, (7, 3, "z")), path, batch=f"{tmp_path}/ck:0") == 2 and len(content(read_snapshot(spark, path))) == 2
