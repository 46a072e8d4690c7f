"""Records of CSV files against Python's csv module, in splits of many sizes."""

from __future__ import annotations

import csv
import io
import random

import pytest

from itemlake.sources import frequency
from itemlake.sources.records import read_records

PIECES = ['"', '"', '""', ",", "\n", "\r\n", "\r", "a", "é,", '"a,"', " ", 'b"c', '\n"', "\\", "﻿x"]


def wanted(text: str) -> list[list[str]]:
    return [c or [""] for c in csv.reader(io.StringIO(text, newline=""))]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Random files, one with a long quoted cell, one that begins with a byte-order mark, one empty."""
    folder, r, texts = tmp_path_factory.mktemp("csv"), random.Random(7), {}
    for k in range(60):
        texts[f"{k}.csv"] = "".join(r.choice(PIECES) for _ in range(r.randint(1, 70))).removeprefix("﻿")
    texts["long.csv"] = "1,a\n2,\"" + "line,\n\"\"x\"\"\n" * 400 + '",z\n' + "3,b\n" * 2 + "".join(f'{i},"q{i}\r\n"\r\n' for i in range(200))
    texts["mark.csv"] = '"a\n",b\n'
    texts["open.csv"] = 'a,b\n"c,d\n' + "e,f\n" * 300
    for name, text in texts.items():
        (folder / name).write_bytes((b"\xef\xbb\xbf" if name == "mark.csv" else b"") + text.encode())
    (folder / "none.csv").write_bytes(b"")
    return folder, texts


@pytest.mark.parametrize("size", [128 << 20, 700, 64, 13])
def test_records_are_those_of_the_csv_module(spark, files, size):
    folder, texts = files
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        names = [str(folder / n) for n in (texts if size > 64 else [*list(texts)[:30], "mark.csv"])]
        got: dict[str, dict[int, tuple[list[str], bool]]] = {}
        for r in read_records(spark, names).collect():
            assert r.line_no not in got.setdefault(r.file.rsplit("/", 1)[1], {})
            got[r.file.rsplit("/", 1)[1]][r.line_no] = (r.cells, r.unclosed)
        for name, found in got.items():
            want = wanted(texts[name])
            assert sorted(found) == list(range(1, len(want) + 1)), name
            for i, cells in enumerate(want, 1):
                have, unclosed = found[i]
                if unclosed:  # the file's last line end may belong to the cell
                    assert i == len(want)
                    have, cells = [*have[:-1], have[-1].rstrip("\r\n")], [*cells[:-1], cells[-1].rstrip("\r\n")]
                assert have == cells, (name, i)
        assert len(got) == len(names)
        if size > 64:
            assert [u for _, u in got["open.csv"].values()] == [False, True] and not any(u for _, u in got["long.csv"].values())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_splits_share_a_file(spark, files):
    folder, _ = files
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.option("lineSep", "\n").text(str(folder / "long.csv")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_answer_key_keeps_quoted_lines_and_tells_of_the_rest(spark, tmp_path):
    (tmp_path / "k.csv").write_text('﻿問題,正答肢\r\n1,"a\nb"\r\n2,c\r\n\r\n3\r\nx,d\r\n 4 ,"d""e"\r\n5,"a\r\n6,b\r\n', newline="")
    got = sorted((r.position, r.correct) for r in frequency.read_answer_key(spark, str(tmp_path)).collect())
    assert got == [(1, "ab"), (2, "c"), (4, "de"), (5, "ab")]
    issues = sorted((r.line_no, r.code) for r in frequency.key_issues(spark, str(tmp_path)).collect())
    assert issues == [(5, "one_cell"), (6, "no_position"), (8, "unclosed_quote")]


def test_scan_of_quoted_cells(spark, tmp_path):
    (tmp_path / "s.csv").write_text('#試験名,"A, ""B""\nC"\n\n"問\n題",問題,正答肢,正答率,"a"\n1,"x\ny",a,0.5,"1"\n2,2,b,0.25,"3\n', newline="")
    scan = frequency.scan_item_stats(spark, str(tmp_path))
    assert scan.meta.first().exam_name == 'A, "B"\nC'
    assert sorted((r.line_no, r.code) for r in scan.issues.collect()) == [(5, "unclosed_quote")]
    assert sorted((r.line_no, r.correct, r.p_reported) for r in scan.all_rows.collect()) == [(4, "a", 0.5), (5, "b", 0.25)]
    assert sorted((r.line_no, r.pattern, r.cnt) for r in scan.counts.filter("pattern = 'a'").collect()) == [(4, "a", 1.0), (5, "a", 3.0)]
