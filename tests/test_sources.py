"""Readers, configurations and the streaming form of the windows."""

import json

import pytest
from pyspark.sql import functions as F

from tallow.plans import configs
from tallow.sources import readers
from tallow.streaming import events


def test_formats(spark, tmp_path):
    rows = [{"instruction": f"i{n}", "output": f"o{n}", "other": n} for n in range(3)]
    (tmp_path / "a.json").write_text("﻿" + json.dumps(rows))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)))
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    for name in ("a.json", "b.jsonl", "c.json", "d", "e.parquet"):
        got = readers.read_pool(spark, str(tmp_path / name))
        assert sorted((r.instruction, r.input, r.output) for r in got.collect()) == [(f"i{n}", "", f"o{n}") for n in range(3)]
    with pytest.raises(readers.SchemaError):
        readers.require(spark.createDataFrame(rows), "missing")


def test_chat_layouts(spark):
    a = spark.createDataFrame([(["q", "r"],)], "conversations array<string>")
    b = spark.createDataFrame([([("user", "q"), ("assistant", "r")],)], "messages array<struct<role:string,content:string>>")
    c = spark.createDataFrame([("q", "r")], "prompt string, response string")
    for rows in (a, b, c):
        assert [tuple(r) for r in readers.normalise_chat(rows).collect()] == [("q", "", "r")]


def test_squad(spark, tmp_path):
    data = {"data": [{"paragraphs": [{"context": "c", "qas": [{"id": "en-1", "question": "q", "answers": [{"text": "x"}]}, {"id": "en-2", "question": "p", "answers": []}]}]}]}
    (tmp_path / "s.json").write_text(json.dumps(data))
    got = {r.id: (r.answers, r.language) for r in readers.read_squad(spark, str(tmp_path / "s.json")).collect()}
    assert got == {"en-1": (["x"], "en"), "en-2": (["No answer"], "en")}


def test_identity(spark, tmp_path):
    path = str(tmp_path / "t")
    readers.write_table(spark.range(3), path, {"model": "m"})
    assert readers.read_table(spark, path, {"model": "m"}).count() == 3
    with pytest.raises(readers.SchemaError):
        readers.read_table(spark, path, {"model": "n"})


def test_configs(monkeypatch):
    monkeypatch.setenv("TALLOW_X", "7")
    config = configs.resolve_env(configs.merge({"a": {"b": 1, "c": "${oc.env:TALLOW_X,1}"}, "d": "${oc.env:TALLOW_Y,z}"}, {"a": {"b": 2}}))
    assert config == {"a": {"b": 2, "c": "7"}, "d": "z"}
    assert configs.override(config, "a.b=3.5", "e=true")["a"]["b"] == 3.5 and configs.flatten(config)["a.c"] == "7"


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = events.window_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = ["start", "event_type", "n"]
    assert sorted(map(tuple, spark.table("windows").select(key).collect())) == sorted(map(tuple, events.window_counts(source).select(key).collect()))


def test_run_folders(spark, tmp_path):
    from tallow.operators.results import IntegrityError
    from tallow.sources import runs

    for seed, value, limit in ((1, 60.0, None), (2, 62.0, None), (3, 64.0, 8)):
        folder = tmp_path / "m" / f"seed{seed}" / "20240101_000000"
        folder.mkdir(parents=True)
        (folder / "a-gsm8k.json").write_text(json.dumps({"benchmark": "gsm8k", "accuracy": value}))
        (folder / "a-eval_summary.json").write_text(json.dumps({"limit": limit, "summaries": [{"benchmark": "gsm8k", "accuracy": value}, {"benchmark": "bbh", "accuracy": 1.0}]}))
        (folder / "_complete").write_text("")
    (tmp_path / "m" / "seed2" / "20240101_000000" / "cfg.json").write_text(json.dumps({"seed": 7}))
    root = str(tmp_path)
    wanted = spark.createDataFrame([(f"{root}/m/seed{i}/20240101_000000",) for i in (1, 2)], "run string")
    got = {(r.seed, r.benchmark): r.accuracy for r in runs.accuracies(spark, root, wanted).collect()}
    assert got == {(1, "gsm8k"): 60.0, (1, "bbh"): 1.0, (7, "gsm8k"): 62.0, (7, "bbh"): 1.0}
    with pytest.raises(IntegrityError, match="limited"):
        runs.accuracies(spark, root)
    with pytest.raises(IntegrityError, match="sealed"):
        runs.accuracies(spark, root, spark.createDataFrame([(f"{root}/none",)], "run string"))
    pins = spark.createDataFrame([("s", "m", "x", 1, "m/seed1/20240101_000000")], "set string, model string, method string, seed int, run_dir string")
    assert runs.pinned(spark, root, pins).count() == 2
    with pytest.raises(IntegrityError, match="another seed"):
        runs.pinned(spark, root, pins.withColumn("seed", F.lit(9)))
    (tmp_path / "m" / "seed1" / "20240101_000000" / "b-gsm8k.json").write_text(json.dumps({"benchmark": "gsm8k", "accuracy": 61.0}))
    with pytest.raises(IntegrityError):
        runs.accuracies(spark, root, wanted)
    tags = spark.createDataFrame([("a", "1", "1"), ("a", "2", "1"), ("b", "1", None), ("b", "2", None)], "cell string, tag string, target string")
    assert {r.cell: r.tag for r in runs.latest(tags, ["cell"], target="target").collect()} == {"a": "1", "b": "2"}
    shards = [spark.createDataFrame([(i, "c") for i in part], "pool_id int, config string") for part in ((0, 1), (2,))]
    assert runs.merged(shards, 3).count() == 3
    with pytest.raises(IntegrityError):
        runs.merged(shards, 4)


def test_config_files(tmp_path, monkeypatch):
    from tallow.plans import configs

    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": 2}, "p": "${oc.env:TALLOW_T,home}/d"}))
    (tmp_path / "own.json").write_text(json.dumps({"defaults": "base.json", "a": {"y": 3}}))
    assert configs.load(str(tmp_path / "own.json")) == {"a": {"x": 1, "y": 3}, "p": "home/d"}
    monkeypatch.setenv("TALLOW_T", "there")
    assert configs.load("own.json", (str(tmp_path),))["p"] == "there/d"
    assert configs.override({"a": {"x": 1}}, "a.x=2.5", "b.c=True", "d=text") == {"a": {"x": 2.5}, "b": {"c": True}, "d": "text"}
    with pytest.raises(configs.ConfigError):
        configs.override({"a": 1}, "a.b=2")
    (tmp_path / "loop.json").write_text(json.dumps({"defaults": ["loop.json"]}))
    with pytest.raises(configs.ConfigError):
        configs.load(str(tmp_path / "loop.json"))
    with pytest.raises(configs.ConfigError):
        configs.require_known({"a": 1, "b": 2}, {"a"})


def test_files_are_found(spark, tmp_path):
    from tallow.sources import files

    for name in ("train-0001-abc", "train-0000-abc", "valid-0000"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"instruction": name, "output": "o"}) + "\n")
    rows = readers.read_in_order(spark, f"{tmp_path}/train-*.jsonl").orderBy("file_order").collect()
    assert [r.instruction for r in rows] == ["train-0000-abc", "train-0001-abc"]
    assert len(files.resolved(spark, f"{tmp_path}/train-0000-other.json")) == 2
    with pytest.raises(files.NoSuchFiles):
        files.resolved(spark, f"{tmp_path}/none-*.json")
    with pytest.raises(files.NoSuchFiles):
        readers.read_records(spark, f"{tmp_path}/gone.json")
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert [r.line for r in files.bad_lines(spark, f"{tmp_path}/bad.jsonl").collect()] == [3]
    for subject in ("a", "b", "c", "d"):
        spark.createDataFrame([(subject, 1)], "question string, answer int").coalesce(1).write.parquet(str(tmp_path / "tmp" / subject))
        (tmp_path / "mmlu" / subject).mkdir(parents=True)
        part = next((tmp_path / "tmp" / subject).glob("part-*.parquet"))
        part.rename(tmp_path / "mmlu" / subject / "test-00000.parquet")
    assert sorted(r.subject for r in readers.union_subjects(spark, f"{tmp_path}/mmlu").collect()) == ["a", "b", "c", "d"]
    assert files.lacking(spark, f"{tmp_path}/mmlu/a", ["dev-*|test-*", "train-*"]) == ["train-*"] and files.one_of_many(spark, f"{tmp_path}/mmlu/a", ["test-*"])
    assert any(p.endswith("/mmlu/a") for p in files.suggestions(spark, str(tmp_path), ["test-00000.parquet"]))
    assert readers.read_sharded(spark, f"{tmp_path}/mmlu/a", ("question",)).first().question == "a"


def test_question_layouts(spark, tmp_path):
    flat = [{"id": "en-1", "question": "q", "context": "c", "answers": {"text": ["x"], "answer_start": [0]}}, {"id": "7", "question": "p", "context": "c", "answers": {"text": [], "answer_start": []}}]
    (tmp_path / "list.json").write_text(json.dumps(flat))
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, flat)))
    spark.read.option("multiLine", True).json(str(tmp_path / "list.json")).coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    for name in ("list.json", "lines.jsonl", "p.parquet"):
        got = {r.id: (r.answers, r.language) for r in readers.read_squad(spark, str(tmp_path / name), empty=None).collect()}
        assert got == {"en-1": (["x"], "en"), "7": ([], "unknown")}
    tasks = spark.createDataFrame([("t", "a", "b"), ("t", "c", "d")], "task string, input string, target string")
    (tmp_path / "t.json").write_text(readers.task_documents(tasks, "task").first().json)
    assert sorted(map(tuple, readers.read_tasks(spark, str(tmp_path / "t.json")).collect())) == [("t", "a", "b"), ("t", "c", "d")]
    import gzip

    with gzip.open(tmp_path / "code.jsonl.gz", "wt") as f:
        f.write(json.dumps({"task_id": "1", "prompt": "p", "entry_point": "f", "test": "t"}) + "\n")
    assert readers.read_code_tasks(spark, str(tmp_path / "code.jsonl.gz")).count() == 1
    mixed = spark.createDataFrame([("i", "o", None), (None, None, ["q", "r"])], "instruction string, output string, conversations array<string>")
    assert sorted(map(tuple, readers.normalise_chat(mixed).collect())) == [("i", "", "o"), ("q", "", "r")]
    assert readers.fingerprint(spark, str(tmp_path / "lines.jsonl")) != readers.fingerprint(spark, str(tmp_path / "list.json"))
    readers.same_corpus(spark, str(tmp_path / "p.parquet"), str(tmp_path / "p.parquet"))
