"""Operators on empty inputs return empty results instead of failing."""

from codeatlas.operators.elements import code_elements
from codeatlas.operators.graph import doc_waves
from codeatlas.operators.packing import pack_batches
from codeatlas.operators.sampling import keyframes


def test_empty_inputs(spark):
    items = spark.createDataFrame([], "g string, k long, size long")
    assert pack_batches(items, ["g"], ["k"], "size", budget=10).count() == 0
    frames = spark.createDataFrame([], "g string, k long, v double")
    assert keyframes(frames, ["g"], ["k"], "v", threshold=1.0).count() == 0
    files = spark.createDataFrame([], "instance_key string, rel_path string, content string")
    assert code_elements(files).count() == 0
    nodes = spark.createDataFrame([], "id long")
    refs = spark.createDataFrame([], "src_id long, dst_id long")
    assert doc_waves(nodes, refs, ["id"]).count() == 0
