"""Sources, sinks and streams on small files."""

import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfield.functions.images import encode_png
from inkfield.sinks import files as sinks
from inkfield.sources import archives, files
from inkfield.streaming import streams

PNG = encode_png(np.zeros((2, 2, 3), np.uint8))


def test_csv_shards(spark, tmp_path):
    (tmp_path / "a.csv").write_text("example_number,combination_number,image_similarity,code_similarity,combined_score,original_image_path,generated_image_path,original_code_path,generated_code_path\n1,main,0.5,0.25,0.3,a,b,c,d\n2,3,oops,,,,,,\n")
    (tmp_path / "b.csv").write_text("example_file,image_similarity,code_similarity,combined_score,original_image_path,generated_image_path,original_code_path,generated_code_path\nexample_9_combination_4.png,0.1,0.2,0.3,a,b,c,d\n")
    rows = {(r.example_number, r.example_file): r for r in files.shards_csv(spark, str(tmp_path)).collect()}
    assert rows[1, None].image_similarity == 0.5 and rows[2, None].image_similarity is None and rows[None, "example_9_combination_4.png"].code_similarity == 0.2
    from inkfield.operators.difficulty import normalised

    assert normalised(files.results_csv(spark, str(tmp_path / "b.csv"), by_file=True)).select("example_number", "combination_number").first()[:] == (9, 4)
    (tmp_path / "none").mkdir()
    assert files.shards_csv(spark, str(tmp_path / "none")).count() == 0 and files.done_keys(spark, str(tmp_path / "missing")).count() == 0


def test_tree(spark, tmp_path):
    for name in ("example_1/code/combination_1.tex", "example_1/code/original.tex", "example_2/code/original.tex"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    for name in ("example_1/png/combination_1.png", "example_1/png/main.png", "example_1/png/combination_7.png", "example_2/png/main.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(PNG)
    got = {r.id: r.code for r in files.decomposed_tree(spark, str(tmp_path)).collect()}
    assert got == {"example_1_combination_1": "example_1/code/combination_1.tex", "example_1_main": "example_1/code/original.tex"}


def test_flat_images(spark, tmp_path):
    for j in (2, 10, 1):
        (tmp_path / f"example_3_combination_{j}.png").write_bytes(PNG)
    (tmp_path / "other.png").write_bytes(PNG)
    assert [r.combination_number for r in files.flat_images(spark, str(tmp_path), 0, 2).orderBy("name").collect()] == [1, 10]


def test_json(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([["a", "b"], [], ["c"]]))
    assert {tuple(r) for r in files.predictions_json(spark, str(tmp_path / "p.json")).collect()} == {(0, 0, "a"), (0, 1, "b"), (2, 0, "c")}
    (tmp_path / "s.json").write_text(json.dumps({"log_history": [{"epoch": 1.0}, {"epoch": 2.5}]}))
    assert files.trainer_state(spark, str(tmp_path / "s.json")).first()[0] == 2.5
    sinks.write_predictions(spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (0, 5, "z")], "i int, s int, c string"), str(tmp_path / "out"), "i", "s", "c")
    assert {tuple(r) for r in files.predictions_json(spark, str(tmp_path / "out")).collect()} == {(0, 0, "z"), (1, 0, "x"), (1, 1, "y")}


def test_archives(spark, tmp_path):
    meta = [{"figure_id": "f1", "captions": ["c", "m1", "m2"], "ocr_result": {"ocr_result": [{"text": "t"}]}}, {"figure_id": "f9", "captions": [], "ocr_result": {"ocr_result": []}}]
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, body in (("x/meta.json", json.dumps(meta).encode()), ("x/f1.png", PNG), ("x/f2.png", PNG)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    (tmp_path / "bad.tar.gz").write_bytes(b"junk")
    pattern = str(tmp_path / "*.tar.gz")
    r = archives.paper_figures(spark, pattern).collect()
    assert [(x.caption, x.mention, x.ocr, bytes(x.image)) for x in r] == [("c", [["m1", "m2"]], ["t"], PNG)]
    assert [x.figure_id for x in archives.orphans(spark, pattern).collect()] == ["f2"]
    with zipfile.ZipFile(tmp_path / "i.zip", "w") as z:
        z.writestr("d/p.png", PNG)
    (tmp_path / "s.json").write_text(json.dumps({"images": [{"id": "1", "file_name": "k/p.png", "ocr": ["o"]}], "annotations": [{"image_id": "1", "caption_no_index": "cap", "mention": [["m"]], "paragraph": ["q"]}]}))
    x = archives.science_figures(spark, str(tmp_path / "s.json"), str(tmp_path / "*.zip")).first()
    assert (x.caption, x.mention, x.paragraph, x.ocr, bytes(x.image)) == ("cap", [["m"]], ["q"], ["o"], PNG)
    whole = (tmp_path / "i.zip").read_bytes()
    (tmp_path / "w.z01").write_bytes(whole[:50])
    (tmp_path / "w.zip").write_bytes(whole[50:])
    assert [n for n, _ in archives.members(str(tmp_path / "w.zip"))] == ["d/p.png"]


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(1, -1, 0.1, 0.2, 0.13, 1), (2, 3, None, 0.5, 0.85, 2)], "example_number int, combination_number int, image_similarity double, code_similarity double, combined_score double, rank bigint")
    page = sinks.html_report(table, 1)
    assert page.count("<tr>") == 4 and "lowest_score" in page and "<td></td>" in page
    assert "| rows | 2 |" in sinks.dataset_card(table)
    assert sinks.shard_bytes(10) == 100_000_000 and sinks.shard_bytes(10**11) == 10**9 and sinks.shard_bytes(5 * 10**9) == 5 * 10**8
    sinks.write_parquet(table, str(tmp_path / "p"), total_bytes=10, partition_by=["example_number"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    f = spark.createDataFrame([("a/b.bin", b"1"), ("c", None), ("../../out", b"2")], "p string, b binary")
    assert {r.path: r.written for r in sinks.write_files(f, str(tmp_path / "f"), "p", "b").collect()} == {"a/b.bin": True, "c": False, "../../out": False}
    calls = []
    build = lambda df: calls.append(1) or df.groupBy("c").count()
    corpus = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    for df in (corpus, corpus.orderBy("c"), corpus.limit(2)):
        sinks.cached(df, "c", str(tmp_path / "cache"), build).count()
    assert len(calls) == 2
    out = str(tmp_path / "app")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "example_file string, v int")
    assert (sinks.append_new(rows.filter("v < 2"), out, "example_file"), sinks.append_new(rows, out, "example_file"), sinks.append_new(rows, out, "example_file")) == (1, 1, 0)
    assert [r.line for r in sinks.tree_dot(spark.createDataFrame([(1, None, 'a"b')], "n int, p int, l string"), "n", "p", "l").collect()] == ['n1 [label="a\\"b"];']


def test_slices(spark):
    df = spark.range(500)
    assert files.first_rows(df, [F.col("id")], n=3).count() == 3 and files.first_rows(df, [F.col("id")], share=0.01).count() == 5
    assert files.corpus_sample(df, "id", 20).count() == 20 and files.corpus_sample(df, "id", 9999).count() == 500
    files.register_source("mine", lambda s, p: s.range(2))
    assert files.resolve(spark, "mine").count() == 2


def test_streams(spark, tmp_path):
    tokens = [("a", 1, "one\ntw"), ("a", 2, "o\nthr"), ("b", 3, "x"), ("a", 4, "ee"), ("a", 5, None)]
    for i, part in enumerate((tokens[:2], tokens[2:])):
        spark.createDataFrame(part, "k string, o int, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema("k string, o int, t string").parquet(str(tmp_path / "in"))
        streams.append_stream(streams.rechunk_lines(src, "k", "o", "t"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((r.k, r.line, r.last) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "one\n", False), ("a", "three", True), ("a", "two\n", False)]
    seen = []
    src = spark.readStream.schema("k string, o int, t string").parquet(str(tmp_path / "in"))
    streams.fan_out(src, [lambda b, i: seen.append(b.count()), lambda b, i: seen.append(b.count())], str(tmp_path / "state2")).awaitTermination()
    assert sum(seen) == 10


def test_late_keys(spark, tmp_path):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    schema = "k int, image_similarity double, code_similarity double, at timestamp_ntz"
    for part in ([(1, 0.5, 0.5, day(1)), (1, 0.7, 0.7, day(1))], [(2, None, 0.1, day(20))], [(1, 0.9, 0.9, day(2)), (3, 0.1, 0.1, day(21))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.append_stream(streams.scored_stream(src, ["k"], "at"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.k: round(r.combined_score, 3) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {1, 2, 3} and got[2] == pytest.approx(0.73) and spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_predictions_in_ranges(spark, tmp_path):
    rows = [(i, j, f"code {i} {j}" * 3) for i in range(40) for j in range(i % 3 + 1)]
    sinks.write_predictions(spark.createDataFrame(rows, "i int, s int, c string"), str(tmp_path / "out"), "i", "s", "c", document_bytes=400)
    assert len(list((tmp_path / "out").glob("part=*"))) > 3
    assert sorted(tuple(r) for r in files.predictions_json(spark, str(tmp_path / "out")).collect()) == rows


def test_write_archives(spark, tmp_path):
    rows = [(f"d/{i}.png", bytes([i])) for i in range(30)] + [(None, b"x"), ("y.png", None)]
    df = spark.createDataFrame(rows, "p string, b binary").repartition(3)
    for kind in ("tar.gz", "zip"):
        assert sum(r.members for r in sinks.write_archives(df, str(tmp_path / kind), "p", "b", kind).collect()) == 30
        got = {r.name: bytes(r.content) for r in archives.archive_members(spark, str(tmp_path / kind / f"*.{kind}")).collect()}
        assert got == dict(rows[:30])


def test_small_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.text_files(spark, str(tmp_path / "*.txt")).collect()}
    assert got["a.txt"] == "one\ntwo" and not got.get("b.txt")
    assert {tuple(r) for r in files.shard_archives(spark, {"s1": "z1", "s0": "z1"}).collect()} == {("s0", "z1"), ("s1", "z1")}
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert files.resolve(spark, str(tmp_path / "p")).count() == 3
