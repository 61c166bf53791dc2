"""Tables in buckets: only the buckets of a change's keys are written anew."""

import pytest

from corpusql import errors
from corpusql.sources import buckets as b

SCHEMA = "k long, v string"


def table(spark, path):
    return {r.k: r.v for r in b.read(spark, path, SCHEMA).collect()}


def files(path):
    out = {}
    for p in path.rglob("*.parquet"):
        out.setdefault(int(str(p).split("bucket=")[1].split("/")[0]), set()).add((p.name, p.stat().st_mtime_ns))
    return out


def test_changes(spark, tmp_path):
    at = str(tmp_path / "t")
    b.create(spark.range(200).selectExpr("id AS k", "'old' AS v"), at, "k", buckets=20)
    before = files(tmp_path / "t")
    new = spark.createDataFrame([(3, "new"), (777, "added"), (None, "no key")], SCHEMA)
    touched = b.upsert(at, SCHEMA, new, "k", buckets=20)
    after = files(tmp_path / "t")
    assert 1 <= len(touched) <= 2 and {x for x in before if before[x] != after.get(x)} | {x for x in after if x not in before} == set(touched)
    assert table(spark, at) == {i: "old" for i in range(200)} | {3: "new", 777: "added"}
    # Again: the same.
    assert b.upsert(at, SCHEMA, new, "k", buckets=20) == touched and len(table(spark, at)) == 201
    # All rows of a bucket go.
    own = [r.k for r in b._all(spark, at, SCHEMA).where(f"bucket = {touched[0]}").collect()]
    assert b.delete(at, SCHEMA, spark.createDataFrame([(k,) for k in own], "k long"), "k", buckets=20) == [touched[0]]
    assert table(spark, at) == {k: v for k, v in ({i: "old" for i in range(200)} | {3: "new", 777: "added"}).items() if k not in own}
    assert b.delete(at, SCHEMA, spark.createDataFrame([], "k long"), "k", buckets=20) == []


def test_duplicates(spark, tmp_path):
    at = str(tmp_path / "t")
    b.create(spark.createDataFrame([(1, "a")], SCHEMA), at, "k", buckets=4)
    two = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k long, v string, o int")
    with pytest.raises(errors.VectorStoreError):
        b.upsert(at, SCHEMA, two.drop("o"), "k", buckets=4)
    assert table(spark, at) == {1: "a"}
    b.upsert(at, SCHEMA, two, "k", buckets=4, order="o")
    assert table(spark, at) == {1: "y"}


def test_a_broken_change_can_be_finished(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    b.create(spark.range(50).selectExpr("id AS k", "'old' AS v"), at, "k", buckets=4)
    kept = b.apply

    def broken(spark_, path, schema, staged, touched):
        # The bucket's old files are gone and nothing has taken their place.
        for p in (tmp_path / "t" / f"bucket={touched[0]}").glob("*"):
            p.unlink()
        raise OSError("lost")

    monkeypatch.setattr(b, "apply", broken)
    with pytest.raises(errors.VectorStoreError, match="apply") as e:
        b.upsert(at, SCHEMA, spark.createDataFrame([(7, "new")], SCHEMA), "k", buckets=4)
    assert len(table(spark, at)) < 50
    staged = str(e.value).split(" with ")[1].split(" ")[0]
    touched = [int(p.name.split("=")[1]) for p in __import__("pathlib").Path(staged).glob("bucket=*")]
    for _ in range(2):
        kept(spark, at, SCHEMA, staged, touched)
        assert table(spark, at) == {i: "old" for i in range(50)} | {7: "new"}
