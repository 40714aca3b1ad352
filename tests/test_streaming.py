import os
import tempfile

from pyspark.sql import functions as F

from codeatlas.streaming.resume import processed, resume_stream


def test_resume_stream_processes_each_key_once(spark):
    root = tempfile.mkdtemp(prefix="stream-")
    work, done, ckpt = (os.path.join(root, d) for d in ("work", "done", "ckpt"))
    schema = "instance_key string, payload string"
    spark.createDataFrame([("a", "1"), ("b", "2")], schema).write.mode("append").parquet(work)

    def process(df):
        return df.withColumn("result", F.upper(F.concat("instance_key", "payload")))

    resume_stream(spark, work, spark.createDataFrame([], schema).schema, done, ["instance_key"], process, ckpt)
    # second drop: "a" again (already done) and a new "c"
    spark.createDataFrame([("a", "9"), ("c", "3")], schema).write.mode("append").parquet(work)
    resume_stream(spark, work, spark.createDataFrame([], schema).schema, done, ["instance_key"], process, ckpt)
    got = sorted((r["instance_key"], r["result"]) for r in processed(spark, done).collect())
    assert got == [("a", "A1"), ("b", "B2"), ("c", "C3")]

    # The commit of the last batch is lost: its retry finds its own output and still keeps every row.
    os.remove(os.path.join(ckpt, "commits", "1"))
    crc = os.path.join(ckpt, "commits", ".1.crc")
    if os.path.exists(crc):
        os.remove(crc)
    resume_stream(spark, work, spark.createDataFrame([], schema).schema, done, ["instance_key"], process, ckpt)
    assert sorted((r["instance_key"], r["result"]) for r in processed(spark, done).collect()) == got
