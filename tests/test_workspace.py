from foliograph import workspace


def test_written_tables_are_shared_and_can_go(spark):
    df = workspace.written(spark.range(5), "numbers")
    assert sorted(r[0] for r in df.collect()) == list(range(5))
    folder = workspace._own_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(path) and folder.startswith(workspace.shared_dir(spark))
    workspace.drop_written(spark)
    assert not files.exists(path)


def test_empty_tables_keep_their_columns(spark):
    assert workspace.written(spark.range(0).selectExpr("id", "cast(null as string) as s"), "none").columns == ["id", "s"]


def test_batches_are_bounded_once(spark):
    workspace.bounded_batches(spark.range(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "32m"
