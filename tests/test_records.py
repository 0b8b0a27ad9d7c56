"""Records over many splits against the built-in one-task readers."""

from __future__ import annotations

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from tablewright.sources import readers, records

SMALL_SPLITS = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in SMALL_SPLITS}
    for k, v in SMALL_SPLITS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def csv_text(rows, end):
    quoted = lambda v: '"' + str(v).replace('"', '""') + '"' if any(c in str(v) for c in '",\n\r') else str(v)
    return end.join([",".join(quoted(v) for v in r) for r in rows]) + end


def one_task(spark, path, **options):
    reader = spark.read.option("header", True).option("nullValue", "NA").option("emptyValue", None).option("escape", '"').option("multiLine", True)
    return readers.normalize_missing(reader.options(**options).option("inferSchema", True).csv(path))


def same(a, b):
    assert a.dtypes == b.dtypes
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_over_many_splits(small_splits, tmp_path, end):
    spark, rnd = small_splits, random.Random(end)
    for name in ("a", "b"):
        rows = [("id", "free text", "x\ny")] + [(k, "".join(rnd.choice(["w", " ", '"', ",", "\n", '""', "long words "]) for _ in range(rnd.randrange(1, 60))),
                                                 rnd.choice([1.5, "NA", ""])) for k in range(150)]
        rows[40] = (7, "line\n" * 900, 1.5)  # a record longer than several splits
        rows = [tuple(v.replace("\n", end) if isinstance(v, str) else v for v in r) for r in rows]  # the built-in reader guesses one line end
        (tmp_path / f"{name}.csv").write_bytes(csv_text(rows, end).encode())
    texts = records._texts(spark, str(tmp_path), "\n")
    assert records.split_effects(texts, "\n").count() > 30
    got = readers.read_csv(spark, str(tmp_path), multi_line=True)
    if end == "\n":
        same(got, one_task(spark, str(tmp_path)))
    want = []
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.csv", newline="") as f:
            want += [tuple(None if v in ("", "NA") else v for v in r) for r in list(csv.reader(f))[1:]]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*[F.col(f"`{c}`").cast("string") for c in got.columns]).collect())


@pytest.mark.parametrize("text", ["", "a,b\n", "a,b", 'a,"b\nc"\n1,2\n', 'a,b\n1,"open to the end\nof the file', 'a,b\n1,"open', "a,a\n1,2\n\n\n3,4", 'a\n"x\n\ny"\n"z"\n', "a,b\n1,2,3\n4\n"])
def test_csv_edges(small_splits, tmp_path, text):
    spark = small_splits
    (tmp_path / "t.csv").write_bytes(text.encode())
    got, want = readers.read_csv(spark, str(tmp_path / "t.csv"), multi_line=True), one_task(spark, str(tmp_path / "t.csv"))
    assert got.columns == want.columns
    assert sorted(map(str, got.select(*[F.col(f"`{c}`").cast("string") for c in got.columns]).collect())) == sorted(
        map(str, want.select(*[F.col(f"`{c}`").cast("string") for c in want.columns]).collect()))


def test_csv_schema_and_separators(small_splits, tmp_path):
    spark = small_splits
    (tmp_path / "t.tsv").write_text('a\tb\n1\t"x\x1e\ny"\n' * 1)
    got = readers.read_tsv(spark, str(tmp_path / "t.tsv"), multi_line=True, schema="a bigint, b string").collect()
    assert [tuple(r) for r in got] == [(1, "x\x1e\ny")]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_array_over_many_splits(small_splits, tmp_path, indent):
    spark, rnd = small_splits, random.Random(3)
    rows = [{"id": k, "s": "".join(rnd.choice(["a", "{", "}", "[", "]", '"', "\\", "\n", ",", "é", "word "]) for _ in range(rnd.randrange(40))),
             "o": {"p": [{"q": "}"}, {"q": "{"}], "r": {}}, "n": rnd.choice([None, 1.5])} for k in range(200)]
    rows[50]["s"] = "deep } text " * 700  # longer than several splits
    (tmp_path / "t.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    texts = records._texts(spark, str(tmp_path / "t.json"), "}")
    assert records.split_effects(texts, "}").count() > 20
    same(readers.load(spark, str(tmp_path / "t.json")), readers.normalize_missing(spark.read.option("multiLine", True).json(str(tmp_path / "t.json"))))


@pytest.mark.parametrize("text", ["[]", '[{"a": 1}]', ' \n[\n{"a": {"b": "}"}}, {"a": null}\n]\n', '[{"a": 1}, {"a": 2}'])
def test_json_edges(small_splits, tmp_path, text):
    spark = small_splits
    (tmp_path / "t.json").write_text(text)
    got = readers.load(spark, str(tmp_path / "t.json"))
    assert got.count() == text.count('"a"')


def test_states_beyond_the_broadcast_bound(small_splits, tmp_path, monkeypatch):
    spark = small_splits
    (tmp_path / "t.csv").write_text("id,t\n" + "".join(f'{k},"a\n""{k}"\n' for k in range(400)))
    monkeypatch.setattr(records, "BROADCAST_SPLITS", 0)
    same(readers.read_csv(spark, str(tmp_path / "t.csv"), multi_line=True), one_task(spark, str(tmp_path / "t.csv")))
