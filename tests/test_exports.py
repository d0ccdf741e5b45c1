"""The query over export files writes and reads real files, large ones in pieces."""

from __future__ import annotations

import json
from functools import partial

import check_oracles
from conftest import SF_SMALL
from pyspark.sql import functions as F
from watchlake.plans import ingest as plan
from watchlake.sources import large_files
from watchlake.workload import mapping, queries


def test_exports_are_read_in_pieces(spark, monkeypatch):
    """With a low limit all files count as large; the result stays that of the SQL."""
    opened = []

    def pieces(files, **settings):
        opened.extend(r["file_path"] for r in files.select("file_path").distinct().collect())
        return explode_large(files, **settings)

    explode_large = plan.explode_large
    monkeypatch.setattr(plan, "explode_large", pieces)
    monkeypatch.setattr(queries, "ingest", partial(plan.ingest, variant_bytes=1000))
    connection = check_oracles.oracle_connection(SF_SMALL)
    result, rows, _ = check_oracles.compare(spark, connection, SF_SMALL, "ingest_files")
    assert result == "ok"
    # all but the empty arrays
    assert rows == 30 and len(opened) == 25


def test_export_files(spark, tmp_path):
    rows = [(str(u), p, json.dumps({"p": p}), ending) for u, ending in enumerate(("closed", "cut", "empty")) for p in range(500)]
    records = spark.createDataFrame(rows, "user_id string, src_pos int, json string, ending string")
    mapping.export_files(records.orderBy(F.rand(1)), str(tmp_path), "a.json")
    texts = {f.relative_to(tmp_path).as_posix(): f.read_text() for f in tmp_path.rglob("*") if f.is_file() and f.suffix != ".crc"}
    assert sorted(texts) == ["raw/0/a.json", "raw/1/a.json", "raw/2/a.json"]
    expected = [{"p": p} for p in range(500)]
    assert json.loads(texts["raw/0/a.json"]) == expected
    assert json.loads(texts["raw/1/a.json"] + "]") == expected
    assert json.loads(texts["raw/2/a.json"]) == []


def test_export_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Users that lie in several tasks, within one, and at their edges; an older file under the same name is longer."""
    monkeypatch.setattr(mapping, "EXPORT_ROWS", 40)
    kinds = ["closed", "cut", "empty"]
    rows = [(f"{kinds[u % 3]}{u}", p, json.dumps({"é": p}, ensure_ascii=False), kinds[u % 3]) for u in range(9) for p in range([300, 1, 37][u // 3])]
    (tmp_path / "raw/closed0").mkdir(parents=True)
    (tmp_path / "raw/closed0/a.json").write_text("x" * 100_000)
    records = spark.createDataFrame(rows, "user_id string, src_pos int, json string, ending string")
    sorted_rows = []
    stored = mapping.cut_lineage
    monkeypatch.setattr(mapping, "cut_lineage", lambda df: sorted_rows.append(stored(df)) or sorted_rows[-1])
    mapping.export_files(records.orderBy(F.rand(2)), str(tmp_path), "a.json")
    of_task = sorted_rows[0].groupBy("task").count().collect()
    assert len(of_task) > 20 and max(r["count"] for r in of_task) < 150
    for u in range(9):
        kind, n = kinds[u % 3], [300, 1, 37][u // 3]
        text = (tmp_path / f"raw/{kind}{u}/a.json").read_text()
        lines = ",\n".join(json.dumps({"é": p}, ensure_ascii=False) for p in range(n))
        assert text == {"closed": f"[{lines}]\n", "cut": f"[{lines}\n", "empty": "[]\n"}[kind]


def test_export_files_of_other_file_systems_are_the_same(spark, tmp_path, monkeypatch):
    rows = [(u, p, json.dumps({"p": p}), "closed") for u in ("1", "a:b", None) for p in range(50)]
    records = spark.createDataFrame(rows, "user_id string, src_pos int, json string, ending string")
    mapping.export_files(records, str(tmp_path / "tasks"), "a.json")
    monkeypatch.setattr(mapping, "on_disk", lambda *_: False)
    mapping.export_files(records, str(tmp_path / "writer"), "a.json")
    found = [{f.relative_to(tmp_path / way).as_posix(): f.read_text() for f in (tmp_path / way).rglob("a.json")} for way in ("tasks", "writer")]
    assert len(found[0]) == 3 and found[0] == found[1]


def test_tasks_of_large_files_are_bounded(spark, tmp_path, monkeypatch):
    """A file of one split of the scan is cut into blocks over tasks by size; elements stay whole across them."""
    monkeypatch.setattr(large_files, "BLOCK_BITS", 5)
    monkeypatch.setattr(large_files, "TASK_BYTES", 2_000)
    records = [{"title": f"t{i} }}{{ \"q\\", "subtitles": [{"name": "{[" * (i % 7)}, {"url": "u"}]} for i in range(1_000)]
    (tmp_path / "raw/u").mkdir(parents=True)
    (tmp_path / "raw/u/a.json").write_text(json.dumps(records))
    most = []
    stored = large_files.cut_lineage

    def store(df):
        df = stored(df)
        if "value" in df.columns and "element" in df.columns:
            most.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        return df

    monkeypatch.setattr(large_files, "cut_lineage", store)
    found = plan.read_records(spark, str(tmp_path), variant_bytes=1_000).select("src_pos", "title").collect()
    assert sorted(map(tuple, found)) == [(i, r["title"]) for i, r in enumerate(records)]
    assert sum(most) > 3_000 and max(most) < 500
