"""CSV, workbook and JSONL reading and writing."""

import datetime as dt
import itertools
import json
import os
import zipfile

import pytest
from pyspark.sql import types as T

from tabloom.functions.examples import to_chat_jsonl, to_instruction_jsonl
from tabloom.sources.delimited import read_csv, unique_names
from tabloom.sources.excel import read_excel_as, stream_excel
from tabloom.sources.files import publish_dataset, read_jsonl, read_table, write_csv
from tabloom.streaming.apply import write_stream


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_messy(spark, tmp_path):
    path = write(
        tmp_path / "m.csv",
        'id,name,name,v,flag,d\n1,"a ""q""\nb",x,1.5,True,2024-01-01\n\n2,N/A,y,nan,false,2024-01-02\n3,z\n',
    )
    df, info = read_table(spark, path)
    assert df.columns == ["id", "name", "name.1", "v", "flag", "d"]
    assert [t for _, t in df.dtypes] == ["bigint", "string", "string", "double", "boolean", "string"]
    assert rows(df) == [
        (1, 'a "q"\nb', "x", 1.5, True, "2024-01-01"),
        (2, None, "y", None, False, "2024-01-02"),
        (3, "z", None, None, None, None),
    ]
    assert info.shape == (3, 6) and info.extension == ".csv" and info.filename == "m.csv"


@pytest.mark.parametrize("row", ["1,2,3", "1,2,", '1,"a,b",', "1,2,,x"])
def test_csv_row_with_too_many_fields(spark, tmp_path, row):
    path = write(tmp_path / "long.csv", f"a,b\n1,2\n{row}\n")
    with pytest.raises(Exception, match="expected 2 fields"):
        read_csv(spark, path, encoding="UTF-8", types={"a": T.StringType(), "b": T.StringType()}).select("a").collect()


def test_csv_quoted_separators_are_not_extra_fields(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b,c\n"1,2,3"\n')
    assert rows(read_csv(spark, path)) == [("1,2,3", None, None)]


def test_csv_integers_with_gaps_become_double(spark, tmp_path):
    path = write(tmp_path / "i.csv", "i,j,k\n1,1,99999999999999999999\n,2,1\n")
    df = read_csv(spark, path)
    assert [t for _, t in df.dtypes] == ["double", "bigint", "double"]


@pytest.mark.parametrize("encoding", ["latin-1", "utf-16", "utf-8", "utf-8-sig"])
def test_csv_encodings(spark, tmp_path, encoding):
    path = write(tmp_path / "e.csv", "name,v\ncafé,1\nthé,2\n", encoding)
    df = read_csv(spark, path)
    assert df.columns == ["name", "v"] and rows(df) == [("café", 1), ("thé", 2)]


def test_csv_folder_with_mixed_encodings(spark, tmp_path):
    write(tmp_path / "a.csv", "name,v\ncafé,1\n", "latin-1")
    write(tmp_path / "b.csv", "name,v\nthé,2\n", "utf-8")
    assert sorted(rows(read_csv(spark, str(tmp_path)))) == [("café", 1), ("thé", 2)]


def test_unique_names():
    assert unique_names(["a", "a", "", "a", None, "a.1"]) == ["a", "a.1", "Unnamed: 2", "a.2", "Unnamed: 4", "a.1.1"]


def test_unsupported_extension(spark):
    with pytest.raises(ValueError, match="Unsupported file type: .pdf"):
        read_table(spark, "/tmp/x.pdf")


def workbook(path, sheet_rows):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        )
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><t>x &amp; y</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet_rows}</sheetData></worksheet>')


def test_excel_folder(spark, tmp_path):
    header = (
        '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c>'
        '<c r="C1" t="inlineStr"><is><t>day</t></is></c><c r="D1" t="inlineStr"><is><t>ok</t></is></c></row>'
    )
    workbook(
        tmp_path / "a.xlsx",
        header
        + '<row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c><c r="C2" s="1"><v>45292</v></c><c r="D2" t="b"><v>1</v></c></row>'
        + '<row><c r="A3" t="inlineStr"><is><t>N/A</t></is></c><c r="C3" s="2"><v>45293.5</v></c></row>',
    )
    workbook(tmp_path / "b.xlsx", header + '<row><c r="A2" t="inlineStr"><is><t>q</t></is></c><c r="B2"><v>4.5</v></c></row>')
    df, info = read_table(spark, str(tmp_path), fmt="xlsx")
    assert dict(df.dtypes) == {"name": "string", "n": "double", "day": "timestamp_ntz", "ok": "boolean"}
    got = sorted(((r.name or "", r.n, str(r.day), r.ok) for r in df.collect()))
    assert got == [
        ("", None, "2024-01-02 12:00:00", None),
        ("q", 4.5, "None", None),
        ("x & y", 3.0, "2024-01-01 00:00:00", True),
    ]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, "line\nbreak")], "i bigint, s string")
    write_csv(df, str(tmp_path / "out"))
    assert sorted(rows(read_csv(spark, str(tmp_path / "out")))) == sorted(rows(df))


def test_examples_have_the_json_value_of_the_cells(spark):
    df = spark.createDataFrame(
        [('say "hi"\n', "é", 1, 0.1, True, None), ("b", None, 2, 1e7, False, "z")],
        "a string, b string, i int, x double, t boolean, n string",
    )
    lines = [json.loads(r.value) for r in to_instruction_jsonl(df, ["a", "b", "nope"], ["i", "x", "t", "n"]).collect()]
    assert lines[0] == {"instruction": 'say "hi"\n\né', "output": "1\n0.1\nTrue\n"}
    assert lines[1] == {"instruction": "b\n", "output": "2\n10000000.0\nFalse\nz"}
    lines = [json.loads(r.value) for r in to_instruction_jsonl(df, ["n"], input_cols=["a"], null_text="nan").collect()]
    assert lines[0] == {"instruction": "nan", "input": 'say "hi"\n', "output": ""}
    chat = [json.loads(r.value) for r in to_chat_jsonl(df, ["b"], ["i"], system_prompt="S").collect()]
    assert chat[0] == {
        "messages": [
            {"role": "system", "content": "S"},
            {"role": "user", "content": "é"},
            {"role": "assistant", "content": "1"},
        ]
    }
    assert len(json.loads(to_chat_jsonl(df, ["a"]).first().value)["messages"]) == 1


@pytest.mark.parametrize("x", [0.0, 1.0, -2.5, 1e7, 12345678.9, 1e15, 1e16, 1.5e-4, 2e-5, 1e-10, 3e100, 1e22, 123456789012345.6])
def test_numbers_read_like_printed_numbers(spark, x):
    df = spark.createDataFrame([(x,)], "x double")
    assert json.loads(to_instruction_jsonl(df, ["x"]).first().value)["instruction"] == str(x)


def test_publish_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("q1", "a1"), ("q2", "a2")], "q string, a string")
    target = publish_dataset(df, str(tmp_path / "ds"), ["q"], ["a"])
    back = read_jsonl(spark, target)
    assert sorted(rows(back.select("instruction", "output"))) == [("q1", "a1"), ("q2", "a2")]
    target = publish_dataset(df, str(tmp_path / "chat"), ["q"], ["a"], fmt="chat")
    assert read_jsonl(spark, target).columns == ["messages"]


def test_layout_scan(spark, tmp_path):
    from tabloom.sources.delimited import scan_layout

    flat = write(tmp_path / "flat.csv", 'a,b\n"x ""y""","z"\n1,2\n')
    tall = write(tmp_path / "tall.csv", 'a,b\n"x\ny",2\n')
    assert scan_layout(spark, flat) == ({}, False) and scan_layout(spark, tall) == ({}, True)
    assert rows(read_csv(spark, flat)) == [('x "y"', "z"), ("1", "2")]
    assert rows(read_csv(spark, tall)) == [("x\ny", 2)]
    assert rows(read_csv(spark, flat, encoding="UTF-8", multiline=False)) == rows(read_csv(spark, flat))


def test_csv_folder_with_two_header_orders(spark, tmp_path):
    write(tmp_path / "a b.csv", "id,name\n1,x\n")
    write(tmp_path / "c.csv", 'name,id\n"y\nz",2\n')
    df = read_csv(spark, str(tmp_path))
    assert df.columns == ["id", "name"] and sorted(rows(df)) == [(1, "x"), (2, "y\nz")]
    write(tmp_path / "d.csv", "id,other\n3,q\n")
    with pytest.raises(ValueError, match="other files have"):
        read_csv(spark, str(tmp_path))


def test_excel_columns_by_name_and_cells_beyond_the_header(spark, tmp_path):
    text = lambda *cells: "<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in cells) + "</row>"
    workbook(tmp_path / "a.xlsx", text("id", "name") + text("i1", "x", "extra"))
    workbook(tmp_path / "b.xlsx", text("name", "id") + text("y", "i2"))
    df, _ = read_table(spark, str(tmp_path), fmt="xlsx")
    assert df.columns == ["id", "name", "Unnamed: 2"]
    assert sorted(rows(df)) == [("i1", "x", "extra"), ("i2", "y", None)]
    workbook(tmp_path / "c.xlsx", text("name", "key") + text("y", "i2"))
    with pytest.raises(ValueError, match="other workbooks have"):
        read_table(spark, str(tmp_path), fmt="xlsx")


def test_csv_folder_of_any_number_of_header_orders(spark, tmp_path):
    names = [f"c{i}" for i in range(6)]
    orders = list(itertools.permutations(names))[:250]
    expected = []
    for i, order in enumerate(orders):
        # some files in another encoding, some with a cell of two lines
        values = {n: f"é{i}{n}" if i % 5 == 0 else f"{i}{n}" for n in names}
        if i % 7 == 0:
            values["c3"] = f"{i}\nx"
        text = ",".join(f'"{n}"' for n in order) + "\n" + ",".join(f'"{values[n]}"' for n in order) + "\n"
        write(tmp_path / f"{i:03}.csv", text, "latin-1" if i % 2 else "utf-8")
        expected.append(tuple(values[n] for n in names))
    write(tmp_path / "blank.csv", "\n\n")
    df = read_csv(spark, str(tmp_path))
    assert df.columns == names
    assert sorted(rows(df)) == sorted(expected)
    write(tmp_path / "zz.csv", "c0,c1,c2,c3,c4,c5,c6\n1,2,3,4,5,6,7\n")
    with pytest.raises(ValueError, match="zz.csv has columns"):
        read_csv(spark, str(tmp_path))


def test_csv_files_with_column_names_of_two_lines(spark, tmp_path):
    write(tmp_path / "a.csv", '"a\nb",c\n1,2\n')
    write(tmp_path / "b.csv", 'c,"a\nb"\n3,4\n5\n')
    df = read_csv(spark, str(tmp_path))
    assert df.columns == ["a\nb", "c"]
    assert sorted(rows(df), key=str) == [(1.0, 2), (4.0, 3), (None, 5)]


def test_csv_row_with_too_many_fields_in_one_of_several_layouts(spark, tmp_path):
    write(tmp_path / "a.csv", "a,b\n1,2\n")
    write(tmp_path / "b.csv", "b,a\n1,2,3\n")
    with pytest.raises(Exception, match="expected 2 fields"):
        read_csv(spark, str(tmp_path)).collect()


def test_workbooks_of_any_number_of_header_orders(spark, tmp_path):
    text = lambda *cells: "<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in cells) + "</row>"
    names = [f"c{i}" for i in range(6)]
    expected = []
    for i, order in enumerate(list(itertools.permutations(names))[:250]):
        workbook(tmp_path / f"{i:03}.xlsx", text(*order) + text(*[f"{i}{n}" for n in order]))
        expected.append(tuple(f"{i}{n}" for n in names))
    df, _ = read_table(spark, str(tmp_path), fmt="xlsx")
    assert df.columns == names and sorted(rows(df)) == sorted(expected)


def test_workbooks_by_a_schema(spark, tmp_path):
    text = lambda *cells: "<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in cells) + "</row>"
    schema = "id int, `a.b` string, day timestamp_ntz, x double, ok boolean"
    good = text("x", "id", "a.b", "day", "more", "ok") + "<row></row>"
    good += '<row><c><v>1.5</v></c><c><v>3.0</v></c><c t="inlineStr"><is><t> q</t></is></c><c s="1"><v>45292</v></c><c/><c t="b"><v>1</v></c></row>'
    good += text("NaN", "4") + text(" 1E2 ", "5E0", "N/A", "2024-05-01 10:00:00", "z", "false")
    workbook(tmp_path / "a.xlsx", good)
    workbook(tmp_path / "b.xlsx", text("id", "x", "ok", "a.b", "day"))
    workbook(tmp_path / "c.xlsx", "")
    expected = [
        (3, " q", dt.datetime(2024, 1, 1), 1.5, True), (4, None, None, None, None),
        (5, None, dt.datetime(2024, 5, 1, 10), 100.0, False),
    ]
    got = read_excel_as(spark, str(tmp_path), schema)
    assert got.schema.simpleString() == "struct<id:int,a.b:string,day:timestamp_ntz,x:double,ok:boolean>"
    assert sorted(rows(got)) == expected
    assert sorted(tuple(r)[:5] for r in read_excel_as(spark, str(tmp_path), schema, rescued="r").where("r is null").collect()) == expected
    with pytest.raises(ValueError, match="column of the schema"):
        read_excel_as(spark, str(tmp_path), schema, rescued="x")

    workbook(tmp_path / "d.xlsx", text("id", "x", "ok", "a.b", "day") + text("3.5", "?", "true", "t", "") + text("7", "1", "true", "u", ""))
    with pytest.raises(Exception, match=r"d.xlsx: row 1: .*3.5"):
        read_excel_as(spark, str(tmp_path), schema).collect()
    workbook(tmp_path / "e.xlsx", text("id", "x"))
    (tmp_path / "f.xlsx").write_bytes(b"no archive")
    kept = read_excel_as(spark, str(tmp_path), schema, rescued="r").where("r is not null").orderBy("r.path").collect()
    assert [(r.id, r["a.b"], r.ok, os.path.basename(r.r.path), r.r.row, r.r.cells) for r in kept] == [
        (None, "t", True, "d.xlsx", 1, {"id": "3.5", "x": "?"}), (None, None, None, "e.xlsx", None, {}), (None, None, None, "f.xlsx", None, {}),
    ]
    assert [r.r.error for r in kept][:2] == [None, "ValueError: columns ['a.b', 'day', 'ok'] are missing"]
    assert kept[2].r.error.startswith("BadZipFile")


def test_workbooks_as_they_arrive(spark, tmp_path):
    text = lambda *cells: "<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in cells) + "</row>"
    books, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    books.mkdir()

    def run():
        stream = stream_excel(spark, str(books), "id long, name string", files_per_batch=1)
        write_stream(stream, out, progress, once=True).awaitTermination()
        return sorted(rows(spark.read.schema("id long, name string").parquet(out)))

    workbook(books / "a.xlsx", text("id", "name") + text("1", "x") + text("2", "y"))
    workbook(books / "b.xlsx", text("name", "id") + text("z", "3"))
    assert run() == [(1, "x"), (2, "y"), (3, "z")]
    assert run() == [(1, "x"), (2, "y"), (3, "z")]
    workbook(books / "c.xlsx", text("name", "more", "id") + text("w", "-", "4"))
    assert run() == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]


def test_a_workbook_damaged_in_the_middle(spark, tmp_path):
    """The rows before the damage and one row that tells of it; without a place for it, an error."""
    text = lambda *cells: "<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in cells) + "</row>"
    workbook(tmp_path / "a.xlsx", text("id") + text("1") + text("2") + "<row><c>")
    got = read_excel_as(spark, str(tmp_path), "id long", rescued="r").collect()
    told = [(r.id, r.r and r.r.row, r.r and r.r.error.split(":")[0]) for r in got]
    assert sorted(told, key=str) == [(1, None, None), (2, None, None), (None, None, "ParseError")]
    with pytest.raises(Exception, match="a.xlsx: ParseError"):
        read_excel_as(spark, str(tmp_path), "id long").collect()
