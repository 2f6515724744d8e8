import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tastemill.sources import delimited, sinks


def spec(path, **options):
    return delimited.specs_from_lists("users", str(path), ["user_id", "name"], [int, str], **options)


def test_mixed_encodings(spark, tmp_path):
    (tmp_path / "u.dat").write_bytes("1::Zoé\n".encode() + "2::Zoé\n".encode("latin-1"))
    assert [tuple(r) for r in delimited.read_delimited(spark, spec(tmp_path / "u.dat")).orderBy("user_id").collect()] == [(1, "Zoé"), (2, "Zoé")]


def test_header_and_bad_rows(spark, tmp_path):
    (tmp_path / "u.csv").write_text("user_id,name\n1,a\nx,b\n")
    s = spec(tmp_path / "u.csv", sep=",", header=True)
    with pytest.raises(Exception):
        delimited.read_delimited(spark, s).collect()
    out = delimited.read_delimited(spark, s, "PERMISSIVE")
    assert out.where("_corrupt is not null").count() == 1
    assert [r.name for r in out.where("_corrupt is null").select("name").collect()] == ["a"]  # whatever columns are asked for


def test_specs_are_checked(tmp_path):
    for bad in ({"name": "actors"}, {"path": ""}, {"fields": ()}, {"fields": (("a", int), ("a", int))}, {"fields": (("a", list),)}, {"sep": ""}):
        with pytest.raises(ValueError):
            delimited.SourceSpec(**({"name": "users", "path": "p", "fields": (("a", int),)} | bad))
    with pytest.raises(ValueError):
        delimited.specs_from_lists("users", "p", ["a", "b"], [int])
    assert spec("p").schema == StructType([StructField("user_id", LongType()), StructField("name", StringType())])


def test_casts(spark):
    text = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "user_id string, name string")
    out = delimited.cast_typed(text, spec("p").schema, "reject").collect()
    assert [(r.user_id, r.rejected) for r in out] == [(1, []), (None, ["user_id"]), (None, [])]
    with pytest.raises(Exception):
        delimited.cast_typed(text, spec("p").schema).collect()


def test_sinks_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 7, 1 + i % 5, 1000 - i, "train" if i % 2 else "test") for i in range(40)], "user_id long, movie_id long, rating int, timestamp long, split string")
    sinks.export_ratings(rows, str(tmp_path / "full"))
    back = spark.read.parquet(str(tmp_path / "full"))
    assert sinks.readback_problems(back.drop("sentiment"), rows) == []
    assert back.where("sentiment = 'liked'").count() == rows.where("rating > 3").count()
    sinks.export_ratings(rows, str(tmp_path / "full"), mode="ignore")
    sinks.export_ratings(rows.limit(5), str(tmp_path / "full"), "tiny", mode="overwrite")
    assert spark.read.parquet(str(tmp_path / "full")).count() == 5
    sinks.write_delimited(rows.select("user_id", "split"), str(tmp_path / "text"), header=True, sep=",")
    assert spark.read.option("header", True).csv(str(tmp_path / "text")).count() == 40
    table = spark.createDataFrame([(1, [0.5, 1.5])], "id int, embedding array<double>")
    sinks.write_embeddings(table, str(tmp_path / "emb"), single=True)
    assert spark.read.parquet(str(tmp_path / "emb")).dtypes == [("id", "int"), ("embedding", "array<float>")]


def test_sources_that_split_themselves(spark, tmp_path):
    (tmp_path / "u.csv").write_text("".join(f"{i},n{i}\n" for i in range(500)))
    rows = delimited.read_split(spark, spec(tmp_path / "u.csv", sep=",")).collect()
    sizes = {s: sum(r.split == s for r in rows) for s in ("train", "eval", "test")}
    assert sum(sizes.values()) == 500 and sizes["train"] > 350 and min(sizes.values()) > 20
    assert {r.split for r in delimited.read_split(spark, spec(tmp_path / "u.csv", sep=","), {"all": 1}, ("user_id",)).collect()} == {"all"}
    both = delimited.read_relations(spark, [spec(tmp_path / "u.csv", sep=",")])
    assert list(both) == ["users"] and both["users"].count() == 500
    both["users"].coalesce(1).write.parquet(str(tmp_path / "p" / "users-1.parquet"))
    assert delimited.read_parquet_prefix(spark, str(tmp_path / "p"), "users").count() == 500


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from types import SimpleNamespace

    from tastemill.sources import folders

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        folders.shared_folder(cluster)
    assert folders.shared_path(spark, "x") != folders.shared_path(spark, "x")


def test_shards_are_published_together(spark, tmp_path):
    from tastemill.sources import shards

    path, schema = str(tmp_path / "out"), "id long, text string, tags array<string>"
    rows = spark.createDataFrame([(i, "é\n\"" if i % 3 else None, ["a", "b"][: i % 3]) for i in range(2500)], schema).repartition(5)
    shards.write_shards(rows, path)
    assert sorted(shards.read_shards(spark, path, schema).collect()) == sorted(rows.collect())
    # a task that fails leaves nothing behind, and what was there stays
    broken = rows.withColumn("id", F.when(F.col("id") == 1234, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        shards.write_shards(broken, path, "overwrite")
    assert [p.name[:4] for p in (tmp_path / "out").iterdir()] == ["job-"]
    assert shards.read_shards(spark, path, schema).count() == 2500
    shards.write_shards(rows.where("id < 10"), path)  # appends a job
    assert shards.read_shards(spark, path, schema).count() == 2510
    shards.write_shards(rows.where("id < 10"), path, "overwrite")
    assert shards.read_shards(spark, path, schema).count() == 10


def test_a_second_attempt_leaves_no_duplicate(tmp_path, monkeypatch):
    from pyspark.sql import Row

    from tastemill.sources import shards

    class Task:
        attempt = 0

        def partitionId(self):  # noqa: N802
            return 7

        def taskAttemptId(self):  # noqa: N802
            return Task.attempt

    monkeypatch.setattr(shards.TaskContext, "get", classmethod(lambda cls: Task()))
    writer = shards.ShardWriter(str(tmp_path / "out"), False, 2)

    def breaks():
        yield Row(x=1)
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(breaks())
    found = []
    for Task.attempt in (1, 2):  # the second of these is a speculative copy, of which Spark hears nothing
        found.append(writer.write(iter([Row(x=1), Row(x=2), Row(x=3)])))
    writer.commit([found[0]])
    files = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert [p.name for p in files] == ["shard-00007-1.json.gz"] and found[0].rows == 3
    import gzip

    assert gzip.decompress(files[0].read_bytes()).decode().splitlines() == ['{"x": 1}', '{"x": 2}', '{"x": 3}']


def test_an_object_is_loaded_once_a_worker(spark, tmp_path):
    from tastemill.operators import scoring

    spark.range(1).write.parquet(str(tmp_path / "model"))
    out = scoring.score_with(spark.range(0, 4000, 1, 40), scoring.read_table, str(tmp_path / "model"), loads_so_far, "pid long, loads long").distinct().collect()
    pids = {r.pid for r in out}
    assert len(pids) <= 8 and all(r.loads == 1 for r in out)  # 40 tasks


def loads_so_far(model, batch):
    import os

    import pyarrow as pa

    from tastemill.operators import scoring

    assert model.num_rows == 1
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([pa.array([os.getpid()] * n), pa.array([sum(scoring.LOADS.values())] * n)], names=["pid", "loads"])
