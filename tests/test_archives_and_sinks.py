import os
import stat
import zipfile

import pytest

from foliograph import sinks
from foliograph.sources import archives


def made(tmp_path, entries):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content, *mode in entries:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            if mode:
                info.external_attr = mode[0] << 16
            z.writestr(info, content)
    return path


def test_entries_by_ranges(spark, tmp_path):
    spark.dataSource.register(archives.ArchiveEntries)
    path = made(tmp_path, [(f"docs/{k}.md", f"text {k} " * k) for k in range(25)] + [("docs/", ""), ("empty", "")])
    got = spark.read.format("archive_entries").option("entriesPerPartition", "4").load(path)
    assert got.rdd.getNumPartitions() == 7
    rows = {r["name"]: bytes(r["content"]).decode() for r in got.collect()}
    assert rows == {f"docs/{k}.md": f"text {k} " * k for k in range(25)} | {"empty": ""}
    assert spark.read.format("archive_entries").load("file://" + path).count() == 26


@pytest.mark.parametrize(("entries", "options", "problem"), [
    ([("../up", "x")], {}, "traversal"), ([("/etc/x", "x")], {}, "traversal"), ([("C:\\x", "x")], {}, "traversal"), ([("a/..\\b", "x")], {}, "traversal"), ([("l", "target", stat.S_IFLNK | 0o777)], {}, "link"),
    ([("bomb", "0" * 3_000_000)], {"mostRatio": "100"}, "ratio"), ([("big", os.urandom(5000))], {"mostEntryBytes": "4999"}, "size"), ([("a", "xx"), ("b", "xx")], {"mostBytes": "3"}, "4 bytes"), ([("a", ""), ("b", "")], {"mostEntries": "1"}, "2 entries"),
])
def test_refused_before_anything_is_inflated(spark, tmp_path, entries, options, problem):
    spark.dataSource.register(archives.ArchiveEntries)
    with pytest.raises(Exception, match=problem):
        spark.read.format("archive_entries").options(**options).load(made(tmp_path, entries)).count()


def test_batches_count_once(spark, tmp_path):
    path, schema = str(tmp_path / "ledger"), "node long, kind string"
    rows = lambda a, b: spark.range(a, b, 1, 3).selectExpr("id AS node", "'kept' AS kind")
    assert sinks.ledger(spark, path, schema).count() == 0
    sinks.append(rows(0, 10), path, "one")
    sinks.append(rows(10, 30), path, "two")
    sinks.append(rows(0, 12), path, "one")
    sinks.append(rows(0, 0), path, "none")
    assert sorted(r["node"] for r in sinks.ledger(spark, path, schema).collect()) == sorted([*range(12), *range(10, 30)])
    assert {k: m["rows"] for k, m in sinks.manifests(path).items()} == {"one": 12, "two": 20, "none": 0}
    with pytest.raises(Exception, match="batch"):
        sinks.append(rows(0, 1), path, "../x")


def test_a_task_that_fails_after_writing_leaves_nothing(spark, tmp_path):
    """One task ends badly when its file is there already; the batch never counts, and writing it again counts once."""
    path, schema = str(tmp_path / "ledger"), "node long, kind string"
    rows = spark.range(0, 30, 1, 3).selectExpr("id AS node", "'kept' AS kind")

    class Failing(sinks.LedgerWriter):
        def write(self, iterator):
            done = super().write(iterator)
            from pyspark import TaskContext

            if TaskContext.get().partitionId() == 2:
                raise RuntimeError("lost after writing")
            return done

    class FailingSink(sinks.LedgerSink):
        @classmethod
        def name(cls):
            return "failing_ledger"

        def writer(self, schema, overwrite):
            return Failing(dict(self.options))

    spark.dataSource.register(FailingSink)
    with pytest.raises(Exception, match="lost after writing"):
        rows.write.format("failing_ledger").mode("append").option("batch", "one").save(path)
    assert len(os.listdir(f"{path}/data")) >= 1 and sinks.ledger(spark, path, schema).count() == 0
    sinks.append(rows, path, "one")
    assert sorted(r["node"] for r in sinks.ledger(spark, path, schema).collect()) == list(range(30))


def test_pages_as_files(spark, tmp_path):
    pages = spark.createDataFrame([("guide/start", "# Start\n"), ("/index", None), ("a/b/c/", "é")], "route string, text string")
    got = {r["route"]: r for r in sinks.write_pages(pages, str(tmp_path)).collect()}
    sinks.write_pages(pages, str(tmp_path)).collect()
    assert (tmp_path / "guide/start.mdx").read_text() == "# Start\n" and (tmp_path / "index.mdx").read_bytes() == b"" and got["a/b/c/"]["bytes"] == 2
    assert sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*") if f.is_file()) == ["a/b/c.mdx", "guide/start.mdx", "index.mdx"]
    for bad in ("../x", "a/../b", "", None):
        with pytest.raises(Exception, match="no file for route"):
            sinks.write_pages(spark.createDataFrame([(bad, "x")], "route string, text string"), str(tmp_path)).collect()
