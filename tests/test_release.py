"""Releases: what verification finds, and swaps that are cut short at any move."""

import pytest

from corvane.operators import release as R
from corvane.runtime import scratch_dir


def put(spark, folder, **tables):
    for name, n in tables.items():
        spark.range(n).coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def sizes(spark, folder):
    return {t: spark.read.parquet(f"{folder}/{t}").count() for t in R.Files(spark, folder).names() if not t.startswith("backup")}


@pytest.fixture
def ready(spark):
    data = put(spark, scratch_dir(spark, "data"), a=3, b=4, own=9)
    new = put(spark, scratch_dir(spark, "release"), a=30, b=40, c=50)
    R.publish(spark, new, "v2")
    return data, new


def test_a_whole_update(spark, ready):
    data, new = ready
    assert R.update(spark, new, data, ["a", "b"], ["c", "d"]) == "v2"
    assert sizes(spark, data) == {"a": 30, "b": 40, "c": 50, "own": 9}


def test_what_verification_finds(spark, ready):
    data, new = ready
    assert {r["state"] for r in R.checked(spark, new).collect()} == {R.OK}
    with pytest.raises(FileNotFoundError, match="d, e"):
        R.verify(spark, new, ["a", "e", "d"])
    spark.range(41).coalesce(1).write.mode("overwrite").parquet(f"{new}/b")
    assert {r["state"] for r in R.checked(spark, new).where("file like 'b/%'").collect()} == {R.ABSENT, R.UNLISTED}
    with pytest.raises(ValueError, match="b/"):
        R.update(spark, new, data, ["a", "b"], ["c"])
    assert sizes(spark, data) == {"a": 3, "b": 4, "own": 9}
    R.Files(spark, new).drop(R.MANIFEST)
    with pytest.raises(FileNotFoundError, match=R.MANIFEST):
        R.verify(spark, new, ["a"])


def test_a_changed_file(spark, ready):
    _, new = ready
    at = R.Files(spark, new)
    m = at.read(R.MANIFEST)
    first = sorted(m["checksums"])[0]
    at.write(R.MANIFEST, m | {"checksums": m["checksums"] | {first: "sha256:" + "0" * 64}})
    assert [r["file"] for r in R.checked(spark, new).where(f"state = '{R.CHANGED}'").collect()] == [first]


@pytest.mark.parametrize("stop", range(5))
def test_a_swap_cut_short_is_undone(spark, ready, stop):
    data, new = ready
    moves = []

    def die(*move):
        moves.append(move)
        if len(moves) > stop:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        R.swap(spark, new, data, ["a", "b", "c"], die)
    assert R.recover(spark, data) and not R.recover(spark, data)
    assert sizes(spark, data) == {"a": 3, "b": 4, "own": 9}


def test_a_release_that_does_not_start_is_taken_back(spark, ready):
    data, new = ready
    with pytest.raises(RuntimeError, match="no start"):
        R.update(spark, new, data, ["a", "b"], ["c"], ready=lambda: (_ for _ in ()).throw(RuntimeError("no start")))
    assert sizes(spark, data) == {"a": 3, "b": 4, "own": 9} and not [n for n in R.Files(spark, data).names() if n.startswith("backup")]
