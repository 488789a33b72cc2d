"""Large documents in segments give what a JSON parser gives."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.plans import queries
from tracelake.sources import large_json, readers

ODD = ["", "}", "{", '"', "\\", '\\"', "[{]}", 'a"}b', "\\\\}", "line\nbreak", "é\U0001f600", "},{", '"}', "]"]


def objects(n, seed=2):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(5 if depth < 2 else 2)
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randrange(3))]
        if kind == 3:
            return {rng.choice(ODD): value(depth + 1) for _ in range(rng.randrange(3))}
        return rng.choice([*ODD, 1, None, True, -2.5])

    return [{"instance_id": f"i{k}", "x": value(0), rng.choice(ODD) + "k": value(0)} for k in range(n)]


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_lists(spark, tmp_path, small_blocks, indent, ascii_only):
    data = {f"f{k}": objects(n, k) for k, n in enumerate((0, 1, 400))}
    for name, rows in data.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    assert spark.read.option("lineSep", "}").text(f"{tmp_path}/*.json").rdd.getNumPartitions() > 5
    got = {}
    for r in large_json.read_objects(spark, f"{tmp_path}/*.json").orderBy("path", "element").collect():
        assert "\n" not in r.value
        got.setdefault(r.path.split("/")[-1][:2], []).append(json.loads(r.value))
    assert got == {name: rows for name, rows in data.items() if rows}


@pytest.mark.parametrize("n", [0, 1, 300])
def test_a_list_in_an_object(spark, tmp_path, small_blocks, n):
    index = {"run_id": "r{}", "note": 'a "records": [{', "total": 3, "records": objects(n), "end": ["x", {"y": 1}], "log_path": "}"}
    (tmp_path / "index.json").write_text(json.dumps(index))
    rest, found = large_json.read_list_in_object(spark, f"{tmp_path}/index.json", "records")
    assert [json.loads(r.value) for r in found.orderBy("element").collect()] == index["records"]
    assert [json.loads(r.value) for r in rest.collect()] == [{**index, "records": []}]


def test_predictions_of_one_line(spark, tmp_path, small_blocks):
    rows = [{"instance_id": f"i{n}", "model_patch": f"--- a\n+}}{n}\n" * 20, "n": n} for n in range(200)]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    found = readers.read_predictions(spark, f"{tmp_path}/p.json").orderBy("n").collect()
    assert [r.asDict() for r in found] == rows
    # An object, a file that is no JSON and an empty list are read as before.
    (tmp_path / "one.json").write_text(json.dumps(rows[0]))
    assert readers.read_predictions(spark, f"{tmp_path}/one.json").first().asDict() == rows[0]


def test_each_segment_is_read_and_worked_out_once(spark, tmp_path, small_blocks):
    """The files are listed once, and the numbers come from blocks, without quantiles or counts of whole files."""
    (tmp_path / "p.json").write_text(json.dumps(objects(400)))
    segments = large_json.read_segments(spark, f"{tmp_path}/p.json")
    assert segments.select("block").distinct().count() > 5
    rows = large_json.split_list(spark, f"{tmp_path}/p.json", segments=segments)
    want = [json.dumps(x) for x in objects(400)]
    got = [r.value for r in rows.orderBy("element").collect()]
    assert got == ["[" + want[0], *(", " + x for x in want[1:]), "]"]


def test_compressed_documents_are_read_as_their_texts(spark, tmp_path, small_blocks):
    whole = json.dumps({"run_id": "r{}", "records": objects(40), "log_path": "}"})
    texts = [whole, whole + "\n", whole[:-1], whole[:-2], "[" + whole + "]", "}", "{", "x}", '"}"', '{"a": "}{', "{}}", "\u00e9{}"]
    got = {}
    for kind in ("json", "json.gz"):
        folder = tmp_path / kind
        folder.mkdir()
        for n, text in enumerate(texts):
            data = text.encode()
            (folder / f"{n}.{kind}").write_bytes(gzip.compress(data) if kind == "json.gz" else data)
        rows = large_json.split_list(spark, str(folder), 2).collect()
        got[kind] = sorted((r.path.split("/")[-1].split(".")[0], r.element, r.value) for r in rows)
    assert got["json"] == got["json.gz"]
    # Nothing is lost: a file's elements are its text.
    for n, text in enumerate(texts):
        assert "".join(v for name, _, v in got["json.gz"] if name == str(n)) == text
    rest, found = large_json.read_list_in_object(spark, f"{tmp_path}/json.gz/0.json.gz", "records")
    assert [json.loads(r.value) for r in found.orderBy("element").collect()] == objects(40)
    assert [json.loads(r.value) for r in rest.collect()] == [{"run_id": "r{}", "records": [], "log_path": "}"}]


def test_index_documents_are_stored_compressed(spark, tmp_path):
    """What the query writes stays below a part of its text."""
    rows = spark.range(2500).selectExpr("id AS instance_id", "concat('text ', id) AS text")
    entry, size = F.to_json(F.struct("instance_id", "text")), {}
    for codec in ("none", "gzip"):
        queries._documents_of(rows, F.col("instance_id"), entry, F.lit('{"records": ['), "]}", str(tmp_path / codec), codec)
        files = [f for f in (tmp_path / codec).rglob("part-*") if f.is_file()]
        assert len(files) == 3
        size[codec] = sum(f.stat().st_size for f in files)
    assert size["gzip"] < size["none"] / 4
    _, found = large_json.read_list_in_object(spark, str(tmp_path / "gzip"), "records")
    assert found.count() == 2500
