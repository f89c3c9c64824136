"""CSV text to records, with files cut into small splits as a cluster would cut large ones."""

import pytest
from pyspark.sql import functions as F

from csvharbor.sources import records


def read(spark, tmp_path, data, columns=None, split=None, **options):
    files = data if isinstance(data, dict) else {"a.csv": data}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split or 134217728))
    try:
        found = records.scan(spark, str(tmp_path), columns, **options)
        tokens = found.records.select("file", "record_no", records.tokenize(F.col("raw")).alias("t"))
        rows = sorted((r.file.rsplit("/", 1)[1], r.record_no, r.t) for r in tokens.collect())
        heads = {r.file.rsplit("/", 1)[1]: (r.header_no, r.header) for r in found.headers.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return rows, heads


CASES = {
    "simple": ("a,b,c\n1,2,3\n", [["a", "b", "c"], ["1", "2", "3"]]),
    "quoted": ('"a","b"\n"1","2"', [["a", "b"], ["1", "2"]]),
    "quoted comma": ('a,b\n"x,y",z\n', [["a", "b"], ["x,y", "z"]]),
    "variable width": ("a,b,c\n1,2\nx,y,z,w\n", [["a", "b", "c"], ["1", "2"], ["x", "y", "z", "w"]]),
    "single cell": ("hello", [["hello"]]),
    "crlf": ("a,b\r\n1,2\r\n", [["a", "b"], ["1", "2"]]),
    "newline in quotes": ('a,b\n"x\ny",z\n1,2\n', [["a", "b"], ["x\ny", "z"], ["1", "2"]]),
    "blank line in quotes": ('a,b\n"x\n\ny",z\n\n1,2\n', [["a", "b"], ["x\n\ny", "z"], ["1", "2"]]),
    "empty cells": ("a,,c\n,,\n", [["a", "", "c"], ["", "", ""]]),
    "escaped quotes": ('"say ""hi""",b\n', [['say "hi"', "b"]]),
    "bare quotes": ('5" pipe,b\n"a "b" c",d\n', [['5" pipe', "b"], ['a "b" c', "d"]]),
    "unclosed": ('a,b\n"x,y\nz', [["a", "b"], ["x,y\nz"]]),
    "bom": (b"\xef\xbb\xbfa,b\n1,2\n", [["a", "b"], ["1", "2"]]),
    "bad bytes": (b"a,he\x80lo\n", [["a", "he\ufffdlo"]]),
}


@pytest.mark.parametrize("name", CASES)
def test_csv_text(spark, tmp_path, name):
    text, expected = CASES[name]
    rows, _ = read(spark, tmp_path, text)
    assert [(n, t) for _, n, t in rows] == list(enumerate(expected, 1))


def test_empty_file(spark, tmp_path):
    assert read(spark, tmp_path, "") == ([], {})


@pytest.mark.parametrize("split", [40, 97, 1000])
@pytest.mark.parametrize("spanning", [False, True])
def test_splits_do_not_change_records(spark, tmp_path, split, spanning):
    expected, lines = [], []
    for i in range(300):
        note = f'note "{i}", part\n\n"two"' if spanning and i % 7 == 3 else f"n{i}"
        expected.append([str(i), note, f"end{i}"])
        text = '"' + note.replace('"', '""') + '"' if spanning and i % 7 == 3 else note
        lines.append(f"{i},{text},end{i}")
        if i % 11 == 0:
            lines.append("")
    rows, _ = read(spark, tmp_path, "\n".join(lines), split=split)
    assert [(n, t) for _, n, t in rows] == list(enumerate(expected, 1))


def test_header_search(spark, tmp_path):
    files = {
        "first.csv": "Id,Name\n1,x\n",
        "titled.csv": 'Report\n,\n="id", NAME ,extra\n1,x,y\n',
        "spanning.csv": '"a\nb"\nid,"name"\n1,x\n',
        "late.csv": "t\n" * 20 + "id,name\n1,x\n",
        "absent.csv": "name,id\n1,x\n",
    }
    _, heads = read(spark, tmp_path, files, ["id", "name"])
    assert {k: v[0] for k, v in heads.items()} == {"first.csv": 1, "titled.csv": 3, "spanning.csv": 2}
    assert heads["titled.csv"][1] == ['="id"', " NAME ", "extra"]


def test_replacement_character(spark, tmp_path):
    rows, _ = read(spark, tmp_path, b"he\x80lo\n", replacement="?")
    assert rows[0][2] == ["he?lo"]


def test_moved_splits_fail_loudly(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    lines = records.read_lines(spark, str(tmp_path)).withColumn("at", F.monotonically_increasing_id())
    splits = records._split_summary(lines, F.lit(True)).withColumn("part", F.col("part") + 1)
    with pytest.raises(Exception, match="changed between passes"):
        records._plain_records(lines, splits).collect()


def test_changed_files_fail_loudly(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\n\ny"\n')
    lines = records.read_lines(spark, str(tmp_path))
    splits = records._split_summary(lines.filter("line != ''").withColumn("at", F.monotonically_increasing_id()), F.lit(True))
    splits = spark.createDataFrame(splits.collect(), splits.schema)
    assert [r.raw for r in records._spanning_records(lines, splits).orderBy("record_no").collect()] == ["a,b", '1,"x\n\ny"']
    (tmp_path / "a.csv").write_text('a,b\n1,"x\n\ny"\n2,z\n')
    lines = records.read_lines(spark, str(tmp_path))
    with pytest.raises(Exception, match="changed between passes"):
        records._spanning_records(lines, splits).collect()


def test_strict_quotes(spark):
    rows = spark.createDataFrame([('a,"b ""x""",c',), ('a,5" b',), ('"a" b,c',), ("plain,x",)], "raw string")
    found = [r.e is None for r in rows.select(records.strict_error(F.col("raw")).alias("e")).collect()]
    assert found == [True, False, False, True]


def lenient(text):
    """Character by character: what the records of a text are."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    text = "\n".join(line[:-1] if line.endswith("\r") else line for line in lines)
    found, at = [], 0
    while at < len(text):
        if text[at] == "\n":
            at += 1
            continue
        record = []
        while True:
            cell = ""
            if at < len(text) and text[at] == '"':
                at += 1
                while at < len(text):
                    following = text[at + 1] if at + 1 < len(text) else "\n"
                    if text[at] == '"' and following == '"':
                        cell, at = cell + '"', at + 2
                    elif text[at] == '"' and following in ",\n":
                        at += 1
                        break
                    else:
                        cell, at = cell + text[at], at + 1
            else:
                while at < len(text) and text[at] not in ",\n":
                    cell, at = cell + text[at], at + 1
            record.append(cell)
            if at >= len(text) or text[at] == "\n":
                at += 1
                break
            at += 1
        found.append(record)
    return found


@pytest.mark.parametrize("split", [1_000_000, 7])
def test_random_texts(spark, tmp_path, split):
    import random

    rng = random.Random(11)
    texts = {f"{i:03d}.csv": "".join(rng.choices('ab,"\n\r', weights=[4, 2, 3, 4, 2, 1], k=rng.randint(1, 60))) for i in range(120)}
    rows, _ = read(spark, tmp_path, texts, split=split)
    got = {}
    for name, number, cells in rows:
        assert number == len(got.setdefault(name, [])) + 1
        got[name].append(cells)
    wrong = [(texts[n], got.get(n, []), lenient(texts[n])) for n in texts if got.get(n, []) != lenient(texts[n])]
    assert not wrong, (len(wrong), wrong[:3])
