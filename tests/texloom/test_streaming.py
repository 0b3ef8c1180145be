import json

from texloom.streaming import changes


def test_revisions(spark, tmp_path):
    rows = [("a", 0, False, "x", 1), ("a", 1, False, "y", 2), ("a", 1, False, "late", 3), ("b", 0, True, None, 1), ("b", 1, False, "z", 2)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"id": i, "revision": r, "deleted": d, "comment": c, "at": f"2024-01-01T00:00:0{s}"}) for i, r, d, c, s in rows))
    stream = changes.patched(changes.read_changes(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("patched").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert sorted(map(tuple, spark.table("patched").collect())) == [("a", 2, False, "y", 2, 1), ("b", 1, True, None, 1, 1)]
