"""Consolidation: names, contents, sizes, reconciliation, swap."""

import pytest
from pyspark.sql import functions as F

from inkfield.operators import compaction as K

COLUMNS = "file_id bigint, path string, n_bytes bigint, body binary, extra string"


def files(spark, rows):
    return spark.createDataFrame([(i, p, None, b, "x") for i, p, b in rows], COLUMNS)


def test_paths(spark):
    names = {
        "merged_results/original/example_17_combination_3.tex": ("original_code", 17, 3),
        "./merged_results//generated/example_1_combination_main.TEX": ("generated_code", 1, -1),
        "merged_results\\original\\example_2_combination_4.png": ("original_image", 2, 4),
        "original/example_2_combination_4 (2).png": ("original_image", 2, 4),
        "merged_results/./original/example_2_combination_4.retry1.tex": ("original_code", 2, 4),
        "original/example_2_combination_4_copy.tex": ("original_code", 2, 4),
        "original/example_2_combination_4~1.tex": ("original_code", 2, 4),
        "original/./example_2_main.tex": ("original_code", 2, -1),
        "generated/example_2_combination_4.png": (None, 2, 4),
        "example_2_combination_4.png": (None, None, None),
        "original/notes.txt": (None, None, None),
    }
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "p string")
    got = {r.p: (r["field"], r["example_number"], r["combination_number"]) for r in K.parse_path(df, "p").collect()}
    assert {k: v for k, v in got.items() if k} == names and got[None] == (None, None, None)


def test_compact(spark, tmp_path):
    rows = [(i, f"merged_results/original/example_{i % 7}_combination_{i % 3}.tex", f"body {i % 11}".encode() * 40) for i in range(300)]
    rows += [(1000, "original/example_1_combination_1.tex", None), (1001, "original/example_1_combination_1_copy.tex", b""), (1002, "junk", b"x"), (None, "original/example_1_main.tex", b"y"), (1003, None, b"z")]
    target = str(tmp_path / "out")
    done = K.compact(files(spark, rows), target, target_bytes=4000)
    records = done.records(spark)
    named = {(r[1].rsplit("/", 1)[1].replace("_copy", ""), r[2] or b"") for r in rows if r[0] is not None and r[1] and r[1] != "junk"}
    assert records.count() == len(named) == done.contents and done.files == 302 and done.parts > 1
    assert done.unnamed == 3 and sorted((r.file_id or 0, r.path, bytes(r.body)) for r in done.rest(spark).fillna("", "path").collect()) == [(0, "original/example_1_main.tex", b"y"), (1002, "junk", b"x"), (1003, "", b"z")]
    sets = {r.file_id: (r.first_file, r.copies) for r in K.file_sets(done.origins(spark)).collect()}
    assert len(sets) == 302 and sets[1001] == (1000, 2)
    assert {(r.example_number, r.combination_number, bytes(r.body)) for r in records.collect()} == {(int(n.split("_")[1]), int(n.split("_")[3][:-4]), b) for n, b in named}
    pairs = {tuple(r) for r in K.equal_files(done.origins(spark)).collect()}
    key = lambda r: (r[1].rsplit("/", 1)[1].replace("_copy", ""), r[2] or b"")
    ok = [r for r in rows if r[0] is not None and r[1] and r[1] != "junk"]
    assert pairs == {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and key(a) == key(b)}
    report = K.file_report(done, spark).collect()
    assert len(report) <= done.parts and sum(r.records for r in report) == done.contents
    sorted_ok = records.withColumn("f", F.input_file_name()).groupBy("f").agg(F.collect_list("example_number").alias("e")).collect()
    assert all(r.e == sorted(r.e) for r in sorted_ok)
    again = K.compact(files(spark, rows[:5]), target)
    assert again.records(spark).count() == 5 and not (tmp_path / "out.old").exists() and not (tmp_path / "out.new").exists()
    empty = K.compact(files(spark, []), str(tmp_path / "empty"))
    assert empty.contents == 0 and empty.records(spark).count() == 0 and K.equal_files(empty.origins(spark)).count() == 0


def test_target_survives_a_difference(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    K.compact(files(spark, [(1, "original/example_1_main.tex", b"a")]), target)
    monkeypatch.setattr(K, "LISTED", 1)  # no copy is dropped by the list, so that the broken window lets it through
    monkeypatch.setattr(K, "order_key", lambda: F.concat(F.lit("k"), F.monotonically_increasing_id().cast("string"), F.substring("digest", 1, 8)))
    real = K.Window.partitionBy
    monkeypatch.setattr(K.Window, "partitionBy", lambda *c: real("file_id"))
    with pytest.raises(RuntimeError):
        K.compact(files(spark, [(1, "original/example_2_main.tex", b"a"), (2, "original/example_2_main.tex", b"a")]), target)
    assert [r.example_number for r in spark.read.parquet(f"{target}/records").collect()] == [1]


def test_unnamed_files_are_reconciled(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    K.compact(files(spark, [(1, "original/example_1_main.tex", b"a")]), target)
    real = K.parsed
    monkeypatch.setattr(K, "parsed", lambda *a: real(*a).filter("path <> 'lost'"))
    with pytest.raises(RuntimeError):
        K.compact(files(spark, [(1, "original/example_2_main.tex", b"a"), (2, "lost", b"a")]), target)
    assert [r.example_number for r in spark.read.parquet(f"{target}/records").collect()] == [1]


def test_copies_are_dropped_before_the_shuffle(spark, tmp_path):
    rows = [(i, "original/example_1_main.tex", b"same" * 100) for i in range(2000)] + [(5000 + i, f"original/example_{i}_main.tex", b"x%d" % i) for i in range(50)]
    done = K.compact(files(spark, rows), str(tmp_path / "out"), target_bytes=100)
    assert done.contents == 51 and done.files == 2050
    assert K.equal_files(done.origins(spark)).count() == 2000 * 1999 // 2


def test_swap_and_recovery(spark, tmp_path, monkeypatch):
    def made(name, text):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_text(text)

    target, read = str(tmp_path / "t"), lambda: (tmp_path / "t" / "f").read_text()
    made("t.old", "before")  # a crash between the two moves
    made("t.new", "staged")
    K.recover(spark, target)
    assert read() == "before" and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()
    made("t.old", "older")  # a crash after them
    K.recover(spark, target)
    assert read() == "before" and not (tmp_path / "t.old").exists()
    with pytest.raises(OSError):
        K.swap(spark, target)  # nothing is staged
    assert read() == "before"
    made("t.new", "after")
    K.swap(spark, target)
    assert read() == "after" and not (tmp_path / "t.old").exists()


def test_boundaries_repeat(spark):
    rows = spark.range(5000).select(F.format_string("%08d", "id").alias("at"), (F.col("id") % 50).alias("w"))
    cuts = K.boundaries(rows, "at", "w", 10_000, sample_keys=400)
    assert cuts == K.boundaries(rows.repartition(7), "at", "w", 10_000, sample_keys=400) and len(cuts) == 11
