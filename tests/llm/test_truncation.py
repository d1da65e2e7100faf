import pytest

from inkfield.llm import truncation as X

DOC = "\\documentclass[tikz,border=2mm]{standalone}\n\\usetikzlibrary{calc}\n\\begin{document}\n\\begin{tikzpicture}[x=1cm,y=0.5cm]\n\\begin{scope}[shift={(1.0,2.0)}]\n  \\draw[->] (0,0) -- (1,1);\n\\end{scope}\n\\foreach \\i in {1,2,...,5} { \\draw (\\i,0) -- ++(0,1); }\n\\node at (0,0) {a; $x_1$ 50\\% \\{};\n\\end{tikzpicture}\n\\end{document}\n"
PICTURE = DOC[DOC.index("\\begin{tikz") : DOC.index("\\end{document}")]


@pytest.mark.parametrize("code", [
    DOC, PICTURE, DOC + "% end of figure ...", DOC + "that is all", DOC.replace("\n", "\r\n"), "\\draw (0,0) -- (1,1);\n", "\\tikz[scale=1.0]{\n\\draw (0,0);\n% \\begin{scope} gone\n}\n", "\\tikz \\draw (0,0);",
    "\\draw (0,0); % \\draw (1,", "\\begin{tikzpicture}\n% only this\n\\end{tikzpicture}", "plain words", "", "\\definecolor{a}{RGB}{1,2,3}\n\\draw (0,0);", "\\begin{document}Some text.\\begin{tikzpicture}\\draw;\\end{tikzpicture}\\end{document}",
])
def test_whole(code):
    assert X.left_open(code) == ""


@pytest.mark.parametrize("code", [
    "\\documentclass{article}\\begin{document}\\section{A}\\end{document}", "\\title{X}\n" + PICTURE, "\\graphicspath{{a/}}\n\\usepackage[x=y]{z}\n" + PICTURE, "\\usepgfplotslibrary{groupplots}",
    "\\begin{tabular}{ll} a & b \\\\ c & d \\end{tabular}", "\\Large Hello \\textbf{x}.", "\\begin{document}First; then \\textbf{x} (see \\LaTeX).\\end{document}",
    "\\begin{tikzpicture}\\begin{axis}[a=b]\\addplot {x};\\end{axis}\\tikzset{a/.style={b}}\\end{tikzpicture}", "\\begin{circuitikz}\\node {\\begin{tabular}{l} a \\\\ b\\end{tabular}};\\end{circuitikz}",
])
def test_no_command_needs_a_list(code):
    assert X.judge(code) == ("", False)


def test_bare_text():
    assert X.judge("Plain text that breaks off mid-wor") == ("", True) and X.judge("\\node at") == ("", True)
    assert not any(X.judge(t)[1] for t in ("It ends.", "(it ends)", "Is it? ", "\\draw (0,0);", PICTURE, "", "% only this", PICTURE + " and so o"))


@pytest.mark.parametrize("tail", ["\\draw (0,0) -- (1", "\\node at", "\\", "\\dr", "\\coordinate (c)\n", "\\draw[re"])
@pytest.mark.parametrize("after", ["", "\n", "...", "\n% [cut]", "\n\\end{tikzpicture}\n", "\n\\end{tikzpicture}\n\\end{document}\n% rendered ok"])
def test_cut_in_a_picture(tail, after):
    start = DOC[: DOC.index("\\node")]
    assert X.left_open(start + tail + after) != ""


def test_every_cut_of_a_document_shows():
    whole_from = len(DOC.rstrip())
    for n in range(DOC.index("\\documentclass") + 20, whole_from):
        assert X.left_open(DOC[:n]) != "", DOC[n - 30 : n]
    statement = "\\draw (0,0) -- (1,1);"
    assert all(X.left_open(statement + "\n" + statement[:n]) for n in range(2, len(statement)))


def test_reasons():
    assert X.left_open(DOC[: DOC.index("\\end{document}")]) == "document" and X.left_open(PICTURE[: PICTURE.index("\\end{tikz")]) == "picture"
    assert X.left_open("\\tikz{\\draw (0,0);") == "group" and X.left_open("\\draw (0,0)") == "statement" and X.left_open(DOC + DOC[:200]) == "document"


def test_detect(spark):
    pad = lambda n: ("\\begin{tikzpicture}\n" + "\\draw (0,0) -- (1,1);\n" * 100)[:n]
    rows = [(i, "g1", pad(500)) for i in range(30)] + [(100 + i, "g1", pad(400 + i) + "\\end{tikzpicture}") for i in range(0, 60)]
    rows += [(200, "g2", pad(321)), (200, "g2", pad(321)), (201, None, pad(100)), (202, "g2", None), (203, "g2", ""), (None, "g1", pad(10)), (300, "g2", "é" * 3 + DOC)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_id bigint, generator string, generated_code string, cut string")
    got = {r.row_id: r for r in X.detect(df).collect()}
    assert set(got) == {r[0] for r in rows if r[0] is not None}
    assert all(got[i].cut and got[i].cause == "field_limit" for i in range(30)) and got[200].cause == "transfer" and got[201].cut
    assert not got[202].cut and not got[203].cut and not got[300].cut
    s = X.spikes(X.scan(df, "row_id", "generator", "generated_code"), "generator").collect()
    assert {(r.generator, r.unit, r.length, r.n, r.longest) for r in s} == {("g1", "chars", 500, 30, True), ("g1", "bytes", 500, 30, True)}
    rates = {r.generator: r for r in X.rates(X.detect(df), "generator").collect()}
    assert rates["g2"].records == 4 and rates["g2"].cut == 1 and rates["g1"].at_limit == 30 and rates[None].cut == 1
    assert X.detect(df.limit(0)).count() == 0


def test_spikes_decide_on_plain_text(spark):
    words = "the quick brown fox jumps over a lazy dog and then it rests "
    rows = [(i, "g1", (words[i % 7 :] * 9)[:200].strip().ljust(200, "x")) for i in range(40)] + [(100 + i, "g1", (words * 9)[: 60 + i]) for i in range(80)]
    rows += [(300 + i, "g1", (words * 9)[:199] + ".") for i in range(20)] + [(400, "g2", (words * 9)[:200])]
    got = {r.row_id: r for r in X.detect(spark.createDataFrame(rows, "row_id bigint, generator string, generated_code string")).collect()}
    assert len(got) == len(rows) and {k for k, r in got.items() if r.cut} == set(range(40))
    assert all(got[k].open == "text" and got[k].cause == "field_limit" for k in range(40)) and got[400].cause is None


def test_rates_against_brute_force(spark, data):
    from collections import Counter

    from inkfield.llm import queries

    rows = {r.row_id: r for r in spark.read.parquet(f"{data}/upload_data.parquet").select("row_id", "generator", "generated_code").collect()}.values()
    cut = [r for r in rows if r.generated_code and X.left_open(r.generated_code)]
    have = {r.generator: (r.records, r.cut) for r in queries.p3_rates(spark, data).collect()}
    all_of, cut_of = Counter(r.generator for r in rows), Counter(r.generator for r in cut)
    assert have == {g: (n, cut_of[g]) for g, n in all_of.items()}
    assert {r.row_id for r in queries.p3_found(spark, data).collect()} == {r.row_id for r in cut}
