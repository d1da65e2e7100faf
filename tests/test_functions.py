"""Golden cases of the functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfield.functions import curriculum as C
from inkfield.functions import images as I
from inkfield.functions import sequences as Q
from inkfield.functions import similarity as S
from inkfield.functions import text as T
from inkfield.functions import vectors as V

A = r"\draw[red, thick] (0,0) -- (1.5, -2) to[bend] (3,4); \node[blue] at ( 1 , 2 ) {A}; \edge[->] (a) -- (b);"
B = r"\draw[red] (0,0) -- (1.5, -2); \node[blue] at (3,4) {B};"


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(*columns).first()


def test_code_pair(spark):
    df = S.with_overlaps(spark.createDataFrame([(A, B)], "a string, b string"), "a", "b")
    df = df.withColumn("sequence", Q.sequence_ratio_column(T.clean_code(F.col("a")), T.clean_code(F.col("b"))))
    parts = {k: F.col(k) for k in S.OVERALL}
    r = df.select("*", S.blended(parts, S.OVERALL).alias("overall"), S.blended(parts, S.CUSTOM).alias("custom")).first()
    assert (r["command"], r["edge"], r["coordinate"], r["style"], r["sequence"]) == (1.0, 0.25, 0.75, 0.4, 0.6625)
    assert r["overall"] == pytest.approx(0.605625) and r["custom"] == pytest.approx(0.253125)


def test_features(spark):
    r = one(spark, T.commands(F.col("c")), T.edges(F.col("c")), T.coordinates(F.col("c")), T.styles(F.col("c")), c=A)
    assert r[0] == ["draw", "node"]
    assert set(r[1]) == {"(0,0) -- (1.5, -2)", "(a) -- (b)", r"\edge[->] (a) -- (b)", "to[bend] (3,4)"}
    assert set(r[2]) == {"(0,0)", "(1.5, -2)", "(3,4)", "( 1 , 2 )"}
    assert set(r[3]) == {"red", "thick", "bend", "blue", "->"}


def test_weights_without_edges(spark):
    parts = {k: F.lit(None).cast("double") if k == "edge" else F.lit(1.0) for k in S.OVERALL}
    r = one(spark, *(v.alias(k) for k, v in S.redistributed(parts, S.OVERALL).items()))
    assert [round(r[k], 3) for k in ("command", "coordinate", "style", "sequence", "edge")] == [0.325, 0.325, 0.225, 0.125, 0]
    with pytest.raises(ValueError):
        S.Weights({"a": 0.5})


def test_difficulty(spark):
    rows = spark.createDataFrame([(0.2, 0.5), (None, 0.3), (1.7, None), (0.2, 0.1), (float("nan"), -1.0)], "i double, c double")
    got = [round(r[0], 6) for r in rows.select(S.difficulty(F.col("i"), F.col("c"))).collect()]
    assert got == [0.29, 0.79, 1.0, 0.17, 0.4]


def test_clean(spark):
    r = one(spark, T.clean_code(F.col("c")), T.preprocess(F.col("c")), c=" a %x\n\u00a0 b\r\n( 1 , -2.5 ) %end")
    assert tuple(r) == ("a b ( 1 , -2.5 ) %end", "a b (1,-2.5) %end")
    assert one(spark, T.clean_code(F.col("c")), c=None)[0] is None


def test_ngrams(spark):
    g = lambda n, **k: one(spark, T.ngrams(T.words(F.lit("a b c")), n, **k))[0]
    assert g(2) == [["a", "b"], ["b", "c"]] and g(4) == [] and g(2, left="<")[0] == ["<", "a"]
    assert one(spark, T.words(F.lit("")), T.words(F.lit(None).cast("string")))[:] == ([], [])


def test_log_map(spark):
    log = "(r\nr:3:! A\nother.sty:9:! B\nr:3:! C\n"
    r = one(spark, T.error_lines(F.lit(log), F.lit("r")), T.error_lines(F.lit(None).cast("string"), F.lit("r")))
    assert r[0] == {3: "! C", 0: "! B"} and list(r[1]) == [0]


def test_text_tools(spark):
    r = one(spark, *(T.ordinal(F.lit(n)) for n in (1, 2, 3, 4, 11, 21, 112)))
    assert list(r) == ["1st", "2nd", "3rd", "4th", "11th", "21st", "112th"]
    assert one(spark, T.rechunk(F.lit("a\nb\nc")), T.rechunk(F.lit("a\n")))[:] == (["a\n", "a\nb\n", "a\nb\nc"], ["a\n"])
    assert one(spark, T.insert_header(F.lit("a\nb"), "H"))[0] == "a\nH\nb"
    assert one(spark, T.remove_token(F.lit(" x <t> y "), "<t>"))[0] == "xy"
    assert one(spark, T.line_difference(F.lit("a\nb\nc"), F.lit("b")))[0] == ["a", "c"]
    assert one(spark, T.flatten_text(F.lit(""), F.array(F.array(F.lit("m"))), F.array(F.lit("o"), F.lit(None))))[0] == "m o"
    assert one(spark, T.merged_path(F.lit("a/b")), T.merged_path(F.lit("merged_results/a")), T.merged_path(F.lit("")))[:] == ("merged_results/a/b", "merged_results/a", None)


def test_schedules(spark):
    epochs = spark.range(4).select(F.col("id").cast("double").alias("e"))
    got = {k: [round(r[0], 4) for r in epochs.select(C.threshold(k, F.col("e"), **o)).collect()] for k, o in (("root_p", {"grow": 3, "start": 0.3, "p": 3}), ("linear", {"grow": 3, "start": 0.3}), ("geometric", {"grow": 3, "start": 0.3}), ("baby_step", {"grow": 3}), ("other", {}))}
    assert got["root_p"] == [0.3, 0.7056, 0.8775, 1] and got["linear"] == [0.3, 0.5333, 0.7667, 1]
    assert got["geometric"] == [0.3, 0.4196, 0.587, 0.8211] and got["baby_step"] == [0.2, 0.4, 0.8, 1] and got["other"] == [1] * 4
    assert [one(spark, C.visible_size(F.lit(t), F.lit(10)))[0] for t in (0.05, 0.4514, 1.0)] == [1, 4, 10]


def test_labels(spark):
    mask = lambda *ids: one(spark, C.label_mask(F.array(*map(F.lit, ids)), F.lit(7)))[0]
    assert mask(7, 7, 7, 4, 5) == [-100, -100, -100, 4, 5] and mask(4, 5) == [-100, -100] and mask(7, 7) == [-100, -100] and mask(1, 7, 2, 7) == [-100, -100, 2, 7]
    r = one(spark, C.with_patches(F.array(F.lit(1), F.lit(2)), 9, 2, 3), C.padded(F.array(F.lit(1)), F.lit(9), 0))
    assert r[0] == [9, 9, 1] and r[1] == [1] + [0] * 15
    assert C.accumulation(256, 2, 4) == 32


def test_labels_of_whole_documents(spark, tmp_path):
    from inkfield.queries import catalogue

    spark.createDataFrame([(1, "ab " * 300), (2, None), (3, "abc")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.labels.split() for r in catalogue.QUERIES["label_masks_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: ["-100"] * 2 + ["2"] * 300, 2: ["-100"] * 2, 3: ["-100"] * 2 + ["3"]}


def test_sequences():
    assert Q.option_block("[a={[b]},c] x") == "[a={[b]},c]" and Q.option_block(" [a]") == "[a]" and Q.option_block("x") == "" == Q.option_block("  ")
    assert Q.statements("\\draw (0,0);\n\\begin{scope}\n\\draw (1,1);\n\\end{scope}\nx") == ["\\draw (0,0);", "\\begin{scope}\n\\draw (1,1);\n\\end{scope}", "x"]
    assert Q.statements("\\begin{scope}\n\\end{scope};")[-1] == "" and Q.statements(None) == []
    assert Q.edit_distance("abc", "abc") < Q.edit_distance("abd", "abc") < Q.edit_distance("xyz", "abc") <= 1 and Q.edit_distance("a", "") == 1
    assert Q.sequence_ratio(None, "a") is None
    assert Q.decompose("x") == {"preamble": "", "options": "", "elements": []}
    d = Q.decompose("P\\begin{document}\\begin{tikzpicture}[a]\n\\draw;\n\\end{tikzpicture}\\end{document}")
    assert d["options"] == "[a]" and d["elements"] == ["\\draw;"]


def plain_edit_distance(hyp, ref):
    row = [0.0] + [1.0] * len(hyp)
    visits = [-1] * len(row)
    for c in ref:
        new = [row[0] + 1]
        for i, h in enumerate(hyp):
            new.append(min(new[i] + Q.DELETION, row[i] + (h != c), row[i + 1] + Q.INSERTION))
        best = new.index(min(new))
        visits[best] += 1
        if c == " ":
            new = [min(x, Q.JUMP + new[best]) for x in new]
        row = new
    extra = Q.COVERAGE * sum(v if v >= 0 else 1 for v in visits)
    return min(1, (row[-1] + extra) / (len(ref) + extra))


@pytest.mark.parametrize("a,b", [("the cat sat", "a cat sat down"), ("x", "yy yy"), ("\\draw ( 0 , 1 )", "\\draw ( 1 , 0 ) ;"), ("", "abc")])
def test_edit_distance_brute_force(a, b):
    assert Q.edit_distance(a, b) == pytest.approx(plain_edit_distance(a, b))


def flooded(mask):
    left, out = {tuple(p) for p in np.argwhere(mask).tolist()}, []
    while left:
        todo, area = [left.pop()], 0
        while todo:
            y, x = todo.pop()
            area += 1
            for near in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if near in left:
                    left.remove(near)
                    todo.append(near)
        out.append(area)
    return sorted(out)


def test_regions_of_stacks():
    rng = np.random.default_rng(2)
    for n, h, w in ((5, 8, 8), (3, 1, 9), (2, 40, 31)):
        for share in (0.0, 0.2, 0.45, 0.8, 1.0):
            masks = rng.random((n, h, w)) < share
            of, area = I.region_areas(masks)
            assert [sorted(area[of == i].tolist()) for i in range(n)] == [flooded(m) for m in masks]
    snake = np.zeros((1, 65, 65), bool)
    snake[0, ::2] = True
    snake[0, 1::4, -1] = snake[0, 3::4, 0] = True
    assert I.component_areas(snake[0]) == flooded(snake[0]) == [int(snake.sum())]


def test_structure_and_stacks():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (2, 6, 11, 9, 3), np.uint8)
    b[0] = a[0]
    win = np.lib.stride_tricks.sliding_window_view
    for x, y, got in zip(a, b, I.ssim_map(a, b)):
        px, py = (np.pad(z.astype(float), ((3, 3), (3, 3), (0, 0)), mode="symmetric") for z in (x, y))
        wx, wy = win(px, (7, 7), (0, 1)).reshape(11, 9, 3, 49), win(py, (7, 7), (0, 1)).reshape(11, 9, 3, 49)
        mx, my = wx.mean(-1), wy.mean(-1)
        cov = ((wx - mx[..., None]) * (wy - my[..., None])).sum(-1) / 48
        want = (2 * mx * my + 6.5025) * (2 * cov + 58.5225) / ((mx**2 + my**2 + 6.5025) * (wx.var(-1, ddof=1) + wy.var(-1, ddof=1) + 58.5225))
        assert np.allclose(got, want)
    rows = I.compare_stacks(a, b)
    assert np.allclose(rows[0, [0, 1, 2, 3, 4]], 0) and all(np.allclose(rows[i], I.compare_stacks(a[i : i + 1], b[i : i + 1])[0]) for i in range(6))
    i = 3
    mask = I.foreground(a[i], b[i])
    d = (a[i].astype(float) - b[i]) / 255
    assert rows[i, 0] == pytest.approx(np.sqrt((d[mask] ** 2).mean())) and rows[i, 2] == pytest.approx(np.abs(d[mask]).mean())
    areas = np.array(flooded((np.abs(d).mean(-1) * mask) > I.APART), float)
    assert rows[i, 3] == len(areas) and rows[i, 4] == pytest.approx(areas[areas > areas.mean()].sum() / 99 * (1 + rows[i, 5]))
    png = [I.encode_png(x) for x in (*a, *b)] + [None, b"no"]
    got = I.compare_many(png[:6] + png[:2] + [png[12], png[13]], png[6:12] + png[6:8] + png[:2])
    assert np.allclose(got[:6], rows) and np.allclose(got[6:8], rows[:2]) and np.isnan(got[8:]).all()


def test_edges():
    square = np.full((1, 16, 16, 3), 255, np.uint8)
    square[0, 4:12, 4:12] = 0
    found = I.edges(square)[0]
    assert len(flooded(found)) == 1 and not found[6:10, 6:10].any() and not found[:2].any()
    assert all(1 <= found[y, :8].sum() <= 2 for y in range(6, 10))  # thin along a straight side
    weak = np.full((1, 9, 9, 3), 255, np.uint8)
    weak[0, :, 5:] = 225  # gradients between the thresholds, nothing over the upper one
    assert not I.edges(weak).any() and I.complexity(weak[0]) == 0


def raw_png(depth, color, lines, width, height, laced=0, extra=b""):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, laced)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_forms():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (9, 13, 3), np.uint8)
    wide = np.zeros((9, 13, 3, 2), np.uint8)
    wide[..., 0], wide[..., 1] = pixels, rng.integers(0, 256, (9, 13, 3))
    assert np.array_equal(I.decode_png(raw_png(16, 2, b"".join(b"\0" + r.tobytes() for r in wide.reshape(9, -1)), 13, 9)), pixels)
    laced = b"".join(b"\0" + row.tobytes() for y, x, dy, dx in I._PASSES for part in (pixels[y::dy, x::dx],) if part.size for row in part)
    assert np.array_equal(I.decode_png(raw_png(8, 2, laced, 13, 9, laced=1)), pixels)
    before = np.zeros((9, 13, 3), np.int64)
    before[:, 1:] = pixels[:, :-1]
    above = np.zeros((9, 13, 3), np.int64)
    above[1:] = pixels[:-1]
    corner = np.zeros((9, 13, 3), np.int64)
    corner[1:, 1:] = pixels[:-1, :-1]
    near = before + above - corner
    paeth = np.where((abs(near - before) <= abs(near - above)) & (abs(near - before) <= abs(near - corner)), before, np.where(abs(near - above) <= abs(near - corner), above, corner))
    for kind, guess in ((1, before), (2, above), (3, (before + above) // 2), (4, paeth)):
        lines = b"".join(bytes([kind]) + r.astype(np.uint8).tobytes() for r in ((pixels - guess) & 255).reshape(9, -1))
        assert np.array_equal(I.decode_png(raw_png(8, 2, lines, 13, 9)), pixels), kind
    bits = rng.integers(0, 2, (5, 11))
    assert np.array_equal(I.decode_png(raw_png(1, 0, b"".join(b"\0" + np.packbits(r).tobytes() for r in bits), 11, 5))[..., 0], bits * 255)


def test_images():
    white = np.full((8, 8, 3), 255, np.uint8)
    dot = white.copy()
    dot[2, 2] = 0
    two = dot.copy()
    two[5:7, 5:7] = 0
    assert np.array_equal(I.decode_png(I.encode_png(two)), two) and I.decode_png(b"x") is None and I.decode_png(None) is None
    same = I.compare(two, two)
    assert same[0] == 0 and same[1] == pytest.approx(0) and same[3] == 0 and same[6] == pytest.approx(0)
    assert I.compare(white, white)[1] is None and I.compare(white, None)[0] is None
    assert I.compare(dot, white)[4] == 0  # one region alone is never above its own mean
    m = I.compare(two, white)
    assert m[3] == 2 and m[4] == pytest.approx(4 / 64 * (1 + m[5])) and m[0] == 1
    assert I.component_areas(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0]], bool)) == [3]
    big = np.kron(two, np.ones((2, 2, 1), np.uint8))
    assert I.resize(big, 8, 8).shape == (8, 8, 3) and np.array_equal(I.resize(big, 8, 8), two)
    assert I.compare(two, big)[0] == 0
    assert I.trimmed_square(dot, 4).max() == 0 and I.trimmed_square(white, 4).min() == 255


def test_vectors():
    rng = np.random.default_rng(0)
    from itertools import permutations

    cost = rng.random((5, 5))
    assert V.assignment(cost) == pytest.approx(min(sum(cost[i, p[i]] for i in range(5)) for p in permutations(range(5))))
    a = rng.random((4, 3))
    assert V.transport_similarity(a, a[::-1]) == pytest.approx(1) and V.transport_similarity(a, -a) < 0
    x = rng.standard_normal((40, 8))
    assert abs(V.mmd(x[:20], x[20:])) < V.mmd(x, x + 2)
