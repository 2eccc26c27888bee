"""File sources: trace files, prompt files, phrase inventories."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tracelens.functions import lexicon
from tracelens.sources import files, inventory

INVENTORY = '''Here is the list.
```json
{"hedge_words": [{"phrase": "perhaps / it might be", "usage_context": "guessing", "reasoning_purpose": "soften"}],
 "verification_words": [{"phrase": "let me recheck", "usage_context": "review", "reasoning_purpose": "verify"}],
 "reasoning_patterns": {"math": ["plug the value back in"]}}
```
'''


def _write(folder, name, content):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write(content)


def test_trace_and_prompt_files(spark):
    d = tempfile.mkdtemp(prefix="traces-")
    _write(d, "a.txt", "  Maybe the sum is off.\nLet me check the sum.\n")
    _write(d, "b.txt", " \n\t ")
    ok, rejects = files.scan_trace_files(spark, d)
    got = {os.path.basename(r.file_path): r.text for r in ok.collect()}
    assert got == {"a.txt": "Maybe the sum is off.\nLet me check the sum."}
    assert [os.path.basename(r.file_path) for r in rejects.collect()] == ["b.txt"]
    prompts = {os.path.basename(r.file_path): r.prompt for r in files.scan_prompt_files(spark, d).collect()}
    assert list(prompts) == ["a.txt"]  # a blank prompt file is rejected
    assert files.scan_prompt_files(spark, None).collect()[0].prompt == lexicon.DEFAULT_PROMPT


def test_inventory(spark):
    d = tempfile.mkdtemp(prefix="inv-")
    _write(d, "answer.txt", INVENTORY)
    rows = sorted((r.category, r.phrase) for r in inventory.scan_lexicon_inventory(spark, d).collect())
    assert rows == [("hedge", "it might be"), ("hedge", "perhaps"), ("math", "plug the value back in"), ("verification", "let me recheck")]


def test_missing_blank_and_badly_encoded_files_are_told_apart(spark, tmp_path):
    folder = tmp_path / "traces"
    (folder / "sub").mkdir(parents=True)
    for name, content in {"a.txt": b" One.\n", "b.txt": b" \n\t", "c.txt": b"caf\xe9", "d.txt": b"", "other.txt": b"x", "sub/e.txt": "été".encode()}.items():
        (folder / name).write_bytes(content)
    names = ["a.txt", "b.txt", "c.txt", "d.txt", "gone.txt", "a.txt", None]
    requested = spark.createDataFrame([(n and f"file:{folder}/{n}",) for n in names], "file_path string")
    ok, rejects = files.scan_trace_files(spark, str(folder), requested)
    assert [r.text for r in ok.collect()] == ["One."]
    assert sorted((r.file_path.rsplit("/", 1)[1], r.reason) for r in rejects.collect()) == [("b.txt", "empty_file"), ("c.txt", "not_utf8"), ("d.txt", "missing_file"), ("gone.txt", "missing_file")]
    ok, rejects = files.scan_trace_files(spark, str(folder))
    assert sorted(r.text for r in ok.collect()) == ["One.", "x"] and rejects.count() == 2
    ok, _ = files.scan_trace_files(spark, f"{folder}/sub", spark.createDataFrame([(f"{folder}/sub/",)], "file_path string"))
    assert [r.text for r in ok.collect()] == ["été"]


def test_trace_files_are_written_by_all_tasks(spark, tmp_path):
    """Small texts are many files: they stay dealt to the shuffle width and are all there."""
    df = spark.createDataFrame([(f"t{k}", f"text {k}") for k in range(64)], "trace_id string, text string")
    path = str(tmp_path / "traces")
    files.write_trace_files(df, path)
    parts = {f.split("-")[1] for _, _, names in os.walk(path) for f in names if f.startswith("part-")}
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    ok, rejects = files.scan_trace_files(spark, path)
    assert sorted(r.text for r in ok.collect()) == sorted(f"text {k}" for k in range(64)) and rejects.count() == 0


def test_many_small_files_need_few_tasks_and_no_folders(spark, tmp_path):
    """Files lie side by side, and are read by as many tasks as a shuffle has, not by a few files each."""
    df = spark.createDataFrame([(f"t{k}", f"text {k}") for k in range(400)], "trace_id string, text string").repartition(1)
    path = str(tmp_path / "traces")
    files.write_trace_files(df, path)
    assert not [d for _, dirs, _ in os.walk(path) for d in dirs]
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 400 and not [f for f in os.listdir(path) if f.endswith(".tmp")]
    scanned = files.scan_text_files(spark, path)
    assert scanned.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scanned.select(files.id_in_path(scanned["file_path"]).alias("id"), "text").collect()
    assert sorted((r.id, r.text) for r in found) == sorted((f"t{k}", f"text {k}") for k in range(400))
    files.write_trace_files(df.limit(3), f"file://{path}/")  # what was there goes
    assert files.scan_text_files(spark, path).count() == 3


@pytest.mark.parametrize("mounted", [True, False])
def test_odd_ids_and_bytes_are_written_and_read(spark, tmp_path, monkeypatch, mounted):
    """Also where only Spark can open the folder, which then has a folder for each id."""
    if not mounted:
        monkeypatch.setattr(files, "_mounted", lambda spark, path: None)
    rows = [("a/b", "One."), ("a:b%", "Two."), ("x.txt", "Three."), ("-1", " \u2003 "), ("7", None), ("8", "caf\u00e9\n"), ("9", "same"), ("9", "same"), (None, "none"), ("", "empty"), ("10", "bad")]
    df = spark.createDataFrame(rows, "trace_id string, text string")
    df = df.withColumn("text", F.when(F.col("text") == "bad", F.expr("cast(X'61FF' AS STRING)")).otherwise(F.col("text")))
    path = str(tmp_path / "traces")
    files.write_trace_files(df, path)
    everything = files.scan_trace_files(spark, path)[0].select(files.id_in_path(F.col("file_path")).alias("id"), "text").where(F.col("id") == files.NO_ID)
    assert sorted(line for r in everything.collect() for line in r.text.split("\n")) == ["empty", "none"]
    # a null id names no file
    df = df.where("trace_id IS NULL OR trace_id <> ''")
    requested = df.select(files.trace_file(spark, path, F.col("trace_id")).alias("file_path")).unionByName(spark.createDataFrame([(f"{path}/gone.txt",)], "file_path string"))
    ok, rejects = files.scan_trace_files(spark, path, requested)
    got = {r.id: r.text for r in ok.select(files.id_in_path(F.col("file_path")).alias("id"), "text").collect()}
    assert got == {"a%2Fb": "One.", "a%3Ab%25": "Two.", "x.txt": "Three.", "8": "caf\u00e9", "9": "same\nsame"}
    found = rejects.select(files.id_in_path(F.col("file_path")).alias("id"), "reason").collect()
    assert sorted((r.id, r.reason) for r in found) == [("", "missing_file"), ("-1", "empty_file"), ("10", "not_utf8"), ("7", "empty_file")]


def test_mounted_folders_are_listed_as_spark_lists_them(spark, tmp_path):
    """Hidden names, folders of one column, folders in these, and mixed folders, which are left to Spark."""
    flat, parts, mixed = tmp_path / "flat", tmp_path / "parts", tmp_path / "mixed"
    names = {
        flat: ["a.txt", "_x.txt", "_x=1.txt", ".a.txt.crc", "_SUCCESS", "b c%20.txt", "e._COPYING_", "_metadata"],
        parts: ["id=1/a.txt", "id=1/.b.txt", "id=2/sub/c.txt", "id=2/_sub/d.txt", "_SUCCESS", "_logs/e.txt", ".hidden/f.txt"],
        mixed: ["a.txt", "sub/b.txt", "sub/sub/c.txt"],
    }
    for folder, own in names.items():
        for name in own:
            (folder / name).parent.mkdir(parents=True, exist_ok=True)
            (folder / name).write_text(name)
        (folder / "empty.txt" if folder != parts else folder / "id=1" / "empty.txt").write_text("")
        for path in (str(folder), f"file:{folder}", f"file://{folder}/"):
            expected = sorted((r.path, bytes(r.content)) for r in spark.read.format("binaryFile").load(path).collect())
            assert sorted((r.path, bytes(r.content)) for r in files._binary_files(spark, path).select("path", "content").collect()) == expected and expected
    one = str(flat / "a.txt")
    assert [r.text for r in files.scan_text_files(spark, one).collect()] == ["a.txt"]
    assert {os.path.basename(r.file_path) for r in files.scan_text_files(spark, f"{flat}/[ab]*.txt").collect()} == {"a.txt", "b c%20.txt"}
