"""The document source and sink: shapes, partitions, and runs that fail."""

import json
import os

import pytest
from pyspark.sql import functions as F

from kinograph.sources import documents as D


def doc(clip, n=1, **more):
    return json.dumps({"clip_id": clip, "config_hash": "h", "interactions": [{"interaction_id": f"{clip}__i{k:03d}"} for k in range(n)]} | more)


def put(folder, **texts):
    for name, text in texts.items():
        (folder / name.replace("__", ".")).write_bytes(text if isinstance(text, bytes) else text.encode())


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "name string, value string")


def visible(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


SCHEMA = "clip_id string, config_hash string, interactions array<struct<interaction_id: string>>"


def test_files_are_known_by_their_shape(spark, tmp_path):
    put(tmp_path, a__json=doc("a"), b__json="{", c__json=b"\xff\xfe{}", d__json="[1]", e__json='{"clip_id": 3, "interactions": []}', f__json='{"clip_id": "f", "interactions": {}}', g__json=doc("h"), a__debug__json="{}", notes__txt="x", _hidden__json=doc("_hidden"), i__json="", j__json="[" * 100_000)
    (tmp_path / "k.json").mkdir()
    got = {r.name: (r.status, r.clip_id) for r in D.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a": ("document", "a"), "a.debug": ("debug", None), "b": ("damaged", None), "c": ("damaged", None), "d": ("other", None), "e": ("other", None), "f": ("other", None), "g": ("mismatch", "h"), "i": ("damaged", None), "j": ("damaged", None)}


def test_an_include_list_names_what_is_missing(spark, tmp_path):
    put(tmp_path, a__json=doc("a"), b__json=doc("b"))
    files = D.read_documents(spark, f"file://{tmp_path}", include=["a", "z", "a", ""])
    assert sorted((r.name, r.status) for r in files.collect()) == [("a", "document"), ("z", "missing")]
    every = D.with_missing(D.read_documents(spark, str(tmp_path)), spark.createDataFrame([("a",), ("z",), ("z",)], "clip_id string"))
    assert sorted((r.name, r.status) for r in every.collect()) == [("a", "document"), ("b", "document"), ("z", "missing")]
    assert D.read_documents(spark, f"{tmp_path}/nothing").count() == 0


def test_partitions_hold_files_up_to_a_size(tmp_path):
    put(tmp_path, **{f"c{k:02d}__json": doc(f"c{k:02d}", 20) for k in range(30)}, big__json=doc("big", 2000))
    size = os.path.getsize(tmp_path / "c00.json")
    parts = D.DocumentReader({"path": str(tmp_path), "partitionBytes": str(4 * size)}).partitions()
    assert [len(p.paths) for p in parts] == [1, *[4] * 7, 2] and sum(len(p.paths) for p in parts) == 31


def test_written_documents_come_back(spark, tmp_path):
    D.write_documents(rows(spark, *[(f"c{k}.json", doc(f"c{k}", k)) for k in range(40)], ("vlm/c1.json", None)).repartition(5), str(tmp_path))
    assert {r.name: r.value for r in D.read_documents(spark, str(tmp_path)).collect()} == {f"c{k}": doc(f"c{k}", k) for k in range(40)}
    assert len(visible(tmp_path)) == 42 and (tmp_path / "vlm" / "c1.json").read_text() == ""
    got = D.pooled_documents(D.read_documents(spark, str(tmp_path)), SCHEMA).collect()
    assert sum(len(r.document.interactions) for r in got) == sum(range(40))


def test_appending_replaces_and_overwriting_removes_what_was_listed(spark, tmp_path):
    put(tmp_path, own__json="stays")
    D.write_documents(rows(spark, ("a.json", "1"), ("b.json", "1")), str(tmp_path))
    D.write_documents(rows(spark, ("b.json", "2"), ("c.json", "2")), str(tmp_path))
    assert visible(tmp_path) == ["_documents.json", "a.json", "b.json", "c.json", "own.json"] and (tmp_path / "b.json").read_text() == "2"
    D.write_documents(rows(spark, ("c.json", "3")), str(tmp_path), overwrite=True)
    assert visible(tmp_path) == ["_documents.json", "c.json", "own.json"] and json.loads((tmp_path / "_documents.json").read_text()) == ["c.json"]


@pytest.mark.parametrize("bad", ["task", "name", "twice"])
def test_a_run_that_fails_leaves_what_was_there(spark, tmp_path, bad):
    D.write_documents(rows(spark, ("a.json", "1")), str(tmp_path))
    new = rows(spark, *[(f"n{k}.json", "new") for k in range(50)], ("a.json", "new"))
    if bad == "task":
        new = new.withColumn("value", F.when(F.col("name") == "n33.json", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    elif bad == "name":
        new = new.withColumn("name", F.when(F.col("name") == "n33.json", "../out.json").otherwise(F.col("name")))
    else:
        new = new.union(new.where("name = 'n7.json'"))
    with pytest.raises(Exception):
        D.write_documents(new.repartition(4), str(tmp_path))
    assert visible(tmp_path) == ["_documents.json", "a.json"] and (tmp_path / "a.json").read_text() == "1"
    assert not [x for x in os.listdir(tmp_path) if x.startswith("_staging")]


def test_a_commit_that_fails_half_way_puts_everything_back(tmp_path):
    from pyspark.sql.types import StructType

    put(tmp_path, a__json="old")
    (tmp_path / "_documents.json").write_text('["a.json"]')
    schema = StructType.fromDDL("name string, value string")
    writer = D.DocumentWriter({"path": str(tmp_path)}, schema, True)
    done = writer.write(iter([("a.json", "new"), ("b.json", "new")]))
    lost = D.Written([(f"{tmp_path}/{writer.staging}/nothing", "c.json")])
    with pytest.raises(OSError):
        writer.commit([done, None, lost])
    writer.abort([done, None, lost])
    assert visible(tmp_path) == ["_documents.json", "a.json"] and (tmp_path / "a.json").read_text() == "old"


def test_pooling_refuses_what_would_pass_for_complete(spark, tmp_path):
    put(tmp_path, a__json=doc("a"), b__json=doc("b"), broken__json="{")
    clips = spark.createDataFrame([("a",), ("b",), ("z",)], "clip_id string")
    files = D.with_missing(D.read_documents(spark, str(tmp_path)), clips)
    with pytest.raises(Exception, match="z is missing"):
        D.pooled_documents(files, SCHEMA).collect()
    assert sorted(r.name for r in D.pooled_documents(files, SCHEMA, allow_partial=True).collect()) == ["a", "b"]
    put(tmp_path, c__json=doc("a"))
    with pytest.raises(Exception, match="c is mismatch"):
        D.pooled_documents(D.read_documents(spark, str(tmp_path)), SCHEMA).collect()
    put(tmp_path, c__json=doc("c", config_hash="other"))
    with pytest.raises(Exception, match="several configurations"):
        D.pooled_documents(D.read_documents(spark, str(tmp_path)), SCHEMA).collect()
