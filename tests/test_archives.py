"""Tar archives: round trips, pushed filters, commits, streams."""

import io
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources import archives

ODD = [("a/1", b""), ("a/2", b"\0\xff" * 300), ("b/" + "long" * 90, b"x"), ("ü\n ", b"y" * 20000), ("a/2", b"again"), ("c", b"z" * 512)]


@pytest.fixture
def source(spark):
    archives.register(spark)
    return spark.read.format("archives")


def write(df, path, mode="append", **options):
    df.write.format("archives").options(**options).mode(mode).save(str(path))


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "name string, data binary").repartition(3)


def got(df):
    return sorted((r.name, bytes(r.data)) for r in df.select("name", "data").collect())


def test_members_come_back_as_they_were(spark, source, tmp_path):
    write(rows(spark, ODD), tmp_path / "t", archiveBytes=1000)
    back = source.load(str(tmp_path / "t"))
    assert got(back) == sorted(ODD)
    assert all(r.size == len(r.data) for r in back.collect())
    assert back.select("archive").distinct().count() > 3  # begun anew at 1000 bytes
    with tarfile.open(tmp_path / "t" / back.first().archive) as t:  # what others read
        assert t.getnames()


def test_filters_are_pushed_and_columns_left_out(spark, source, tmp_path):
    write(rows(spark, ODD), tmp_path / "t")
    back = source.load(str(tmp_path / "t"))
    for condition, want in [("name = 'a/2'", {"a/2"}), ("name like 'a/%'", {"a/1", "a/2"}), ("name like '%2'", {"a/2"}), ("name in ('c', 'd')", {"c"}), ("name like '%lon%' and size = 1", {ODD[2][0]}), ("name is null", set()), ("name > 'b'", {ODD[2][0], "c", "ü\n "})]:
        df = back.where(condition)
        assert {r.name for r in df.collect()} == want, condition
    assert "Filter (" not in back.where("name like 'a/%'")._jdf.queryExecution().executedPlan().toString()
    one = back.first().archive
    assert {r.archive for r in back.where(F.col("archive") == one).collect()} == {one}
    assert sorted(r[0] for r in source.schema("size long").load(str(tmp_path / "t")).collect()) == sorted(len(d) for _, d in ODD)


def test_folders_of_others_and_empty_ones(spark, source, tmp_path):
    for name, mode in [("x.tar", "w"), ("y.tar.gz", "w:gz"), ("z.tgz", "w:gz")]:
        with tarfile.open(tmp_path / name, mode) as t:
            for member, data in [("d", None), ("d/" + name, name.encode())]:
                info = tarfile.TarInfo(member)
                info.type = tarfile.DIRTYPE if data is None else tarfile.REGTYPE
                info.size = len(data or b"")
                t.addfile(info, io.BytesIO(data or b""))
    (tmp_path / "notes.txt").write_text("not an archive")
    assert got(source.load(str(tmp_path))) == [(f"d/{n}", n.encode()) for n in ("x.tar", "y.tar.gz", "z.tgz")]
    assert {r.place for r in source.load(f"file://{tmp_path}").collect()} == {1}
    assert source.load(str(tmp_path / "none")).count() == 0
    write(rows(spark, []), tmp_path / "empty")
    assert source.load(str(tmp_path / "empty")).count() == 0


def test_only_what_is_committed_counts(spark, source, tmp_path):
    path = tmp_path / "t"
    write(rows(spark, [("a", b"1")]), path)
    folder = archives.Folder(str(path))
    batch = pa.RecordBatch.from_pylist([{"name": "twice", "data": b"2"}])
    writer = archives.Writer(folder, 1 << 20, False)
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))  # a task that is run twice
    assert got(source.load(str(path))) == [("a", b"1")]
    writer.commit([again, None])
    assert got(source.load(str(path))) == [("a", b"1"), ("twice", b"2")]
    writer.abort([first, None])
    assert not (path / first.archives[0]).exists()
    write(rows(spark, [("b", b"3")]), path, "overwrite")
    write(rows(spark, [("c", b"4")]), path)
    assert got(source.load(str(path))) == [("b", b"3"), ("c", b"4")]


@pytest.mark.parametrize("bad", [(None, b"x"), ("", b"x"), ("d/", b"x"), ("a\0", b"x"), ("n", None)])
def test_rows_that_are_no_members_fail_and_leave_nothing(spark, source, tmp_path, bad):
    with pytest.raises(Exception, match="not a name of a member|no data"):
        write(spark.createDataFrame([("ok", b"1"), bad], "name string, data binary").coalesce(1), tmp_path / "t")
    assert source.load(str(tmp_path / "t")).count() == 0
    assert not list((tmp_path / "t").glob("*.tar"))


def test_other_columns_are_an_error(spark, source, tmp_path):
    with pytest.raises(Exception, match="name and data"):
        write(rows(spark, ODD).withColumn("more", F.lit(1)), tmp_path / "t")


def test_streams_go_on_where_they_were(spark, source, tmp_path):
    path, out, log = tmp_path / "t", tmp_path / "out", str(tmp_path / "log")
    write(rows(spark, [("a", b"1"), ("b", b"2")]), path)
    write(rows(spark, [("c", b"3")]), path)

    def copy():
        stream = spark.readStream.format("archives").option("commitsPerBatch", 1).load(str(path)).select("name", "data")
        query = stream.writeStream.format("archives").option("writer", "copy").option("checkpointLocation", log).start(str(out))
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    copy()
    assert got(source.load(str(out))) == [("a", b"1"), ("b", b"2"), ("c", b"3")]
    write(rows(spark, [("d", b"4")]), path)
    copy()
    copy()
    assert got(source.load(str(out))) == [("a", b"1"), ("b", b"2"), ("c", b"3"), ("d", b"4")]
    folder = archives.Folder(str(out))
    before = folder.commits()
    assert len(before) >= 3  # a commit a batch
    writer = archives.StreamWriter(folder, 1 << 20, False, "copy")
    again = writer.write(iter([pa.RecordBatch.from_pylist([{"name": "d", "data": b"4"}])]))
    writer.commit([again], int(before[-1].split("-")[1].split(".")[0]))  # a batch that is run again after its commit
    assert folder.commits() == before
    assert len(got(source.load(str(out)))) == 4
