import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import structure


def found(spark, md):
    rows = structure.sections(spark.createDataFrame([("d", md)], "doc string, md string")).orderBy("start_line").collect()
    return [(r.title, r.level, r.start_line, r.end_line) for r in rows]


def test_sections(spark):
    assert found(spark, "# Introduction\ntext") == [("Introduction", 1, 1, 2)]
    assert found(spark, "intro\n## A\nx\n### B\ny\n") == [("A", 2, 2, 3), ("B", 3, 4, 6)]
    assert found(spark, "#x\n####### y\n#\tT") == [("T", 1, 3, 3)]
    assert found(spark, "#    ") == [("", 1, 1, 1)]
    assert len(found(spark, "# " + "a" * 250)[0][0]) == 200
    assert found(spark, "```\n# in a fence\n```") == [("in a fence", 1, 2, 3)]
    assert found(spark, "") == []


def test_chunk_starts():
    body = ["# H", *["w"] * 520, "", *["w"] * 20]
    assert [x[0] for x in structure.fold_chunks("\n".join(body))] == [1, 523]
    assert [x[0] for x in structure.fold_chunks("\n".join(["w"] * 30 + body))] == [1, 553]
    assert next(structure.fold_chunks("\n".join(body)))[2] == 521 or next(structure.fold_chunks("\n".join(body)))[2] == 522


def slow_fold(lines, target=512):
    out, own, words, start = [], [], 0, 1
    for number, line in enumerate(lines, 1):
        own.append(line)
        words += len(line.split())
        heading = line.startswith("#")
        if (words >= target and (heading or not line.strip())) or (heading and words > 50) or number == len(lines):
            text = "\n".join(own).strip()
            if text and words > 10:
                out.append((start, number, words, text))
            own, words, start = [], 0, number + 1
    return out


def test_fold_against_a_restatement():
    r = random.Random(0)
    for _ in range(200):
        lines = [r.choice(["", "# h", "#include", "a b c " * r.randint(1, 30), "  "]) for _ in range(r.randint(0, 60))]
        assert list(structure.fold_chunks("\n".join(lines), 40)) == slow_fold("\n".join(lines).split("\n"), 40)


def test_line_to_section(spark):
    s = spark.createDataFrame([("d", 1, "a", 1, 10, 19), ("d", 2, "b", 1, 20, 24), ("e", 1, "c", 1, 5, None), ("f", 1, "z", 1, 5, 0)], "doc string, section_no int, title string, level int, start_line int, end_line int")
    c = spark.createDataFrame([("d", n) for n in (5, 10, 19, 20, 24, 25)] + [("e", 99), ("f", 7)], "doc string, start_line int")
    got = {(r.doc, r.start_line): r.section_no for r in structure.with_section(c, s).collect()}
    assert got == {("d", 5): None, ("d", 10): 1, ("d", 19): 1, ("d", 20): 2, ("d", 24): 2, ("d", 25): None, ("e", 99): 1, ("f", 7): 1}


def test_density_and_index_like(spark):
    rows = spark.createDataFrame([("",), ("abcdef",), ("123456",), ("hi!",), ("Table of Contents " + "word " * 9,), ("é" * 9 + "Ⅷ",)], "t string")
    got = rows.select(T.density(F.col("t")).alias("d"), T.index_like(F.col("t")).alias("i")).collect()
    assert [round(r.d, 6) for r in got][:4] == [0, 1, 0, round(2 / 3, 6)]
    assert [r.i for r in got] == [True, False, True, False, True, False]
    assert got[5].d == 1


def test_candidates(spark):
    sizes = [0, 20, 50, 100, 150, 3000, 10_000, 30_000, 10**6]
    rows = spark.createDataFrame([(x,) for x in sizes], "n long").select(T.candidates(F.col("n"), 10).alias("c")).collect()
    assert [r.c for r in rows] == [50, 50, 50, 100, 150, 150, 500, 1500, 1500]


def test_bonus(spark):
    rows = spark.createDataFrame([("Foo BAR baz", "foo bar"), ("foo", "foo bar"), ("x", "привет"), ("ÄB", "äb"), ("a", "a"), ("bb", "bb bb zz")], "t string, q string")
    got = [round(r.b, 4) for r in rows.select(T.exact_bonus(F.col("t"), F.col("q")).alias("b")).collect()]
    assert got == [0.45, 0.075, 0, 0, 0, 0.1]


def test_neighbours_and_prompts(spark):
    rows = spark.createDataFrame([("d", 1, "a" * 600, None), ("d", 9, "b" * 1200, "S"), ("d", 20, "c" * 600, "")], "doc string, start_line int, text string, title string")
    got = [r.prompt for r in structure.context_prompts(rows, "{doc}|{section}|{prev}|{chunk}|{next}").orderBy("start_line").collect()]
    assert got[0] == "d|(no section)|(start of document)|" + "a" * 600 + "|" + "b" * 500
    assert got[1] == "d|S|" + "a" * 500 + "|" + "b" * 1000 + "|" + "c" * 500
    assert got[2].startswith("d|(no section)|") and got[2].endswith("(end of document)")
