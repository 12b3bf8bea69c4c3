"""Readers: CSV with banners / BOM / drifting headers, polymorphic JSON."""

import pytest
from pyspark.sql import functions as F

from civitas.session import work_dir
from civitas.sources.csv_bulk import (bom_header_clean, conform_schema, rename_if_present,
                                      scan_csv_headered, scan_csv_skip_banner, text_schema)
from civitas.sources.json_records import singleton_to_list


def _write(path, text, encoding="utf-8"):
    import os
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_banner_and_repeated_header(spark):
    root = work_dir(spark, "t-csv")
    _write(f"{root}/a.csv", "Relatório de despesas\nANO;MES;VALOR\n2024;1;1,50\nANO;MES;VALOR\n2024;2\n",
           "latin-1")
    df = scan_csv_skip_banner(spark, f"{root}/a.csv", ["ANO", "MES", "VALOR"], "Relatório")
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("2024", "1", "1,50"), ("2024", "2", None)]  # short row padded


def test_bom_header_rename_conform(spark):
    root = work_dir(spark, "t-csv2")
    _write(f"{root}/b.csv", '﻿"idDeputado" ; nome \n1;Ana\n')
    raw = spark.read.option("sep", ";").option("header", "true").csv(f"{root}/b.csv")
    clean = bom_header_clean(raw)
    assert clean.columns == ["IDDEPUTADO", "NOME"]
    out = conform_schema(rename_if_present(clean, {"id": ["IDE_CADASTRO", "IDDEPUTADO"],
                                                   "nome": "NOME"}),
                         text_schema(["id", "nome", "uf"]))
    assert [tuple(r) for r in out.collect()] == [("1", "Ana", None)]


def test_headered_reader_two_spellings(spark):
    root = work_dir(spark, "t-csv3")
    _write(f"{root}/x/a.csv", "﻿ID;VAL\n1;a\n")
    _write(f"{root}/x/b.csv", "VAL;CODE\nb;2\n")
    _write(f"{root}/x/c_BRASIL.csv", "ID;VAL\n9;z\n")
    df = scan_csv_headered(spark, f"{root}/x/*.csv", {"id": ["ID", "CODE"], "val": ["VAL"]},
                           exclude_pattern="_BRASIL")
    assert sorted((r.id, r.val) for r in df.collect()) == [("1", "a"), ("2", "b")]


def test_singleton_to_list(spark):
    df = spark.createDataFrame([('{"m": {"k": 1}}',), ('{"m": [{"k": 1}, {"k": 2}]}',), ("{}",)],
                               "j string")
    r = df.select(F.size(singleton_to_list("j", "$.m", "struct<k: int>")).alias("n")).collect()
    assert [x.n for x in r] == [1, 2, 0]


def test_csv_roundtrip_readers_agree(spark):
    from conftest import SF_SMALL
    from civitas.plans.ingest import q_csv_roundtrip
    a = q_csv_roundtrip(spark, SF_SMALL, estado_reader="headered")
    b = q_csv_roundtrip(spark, SF_SMALL, estado_reader="header_option")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)
    assert a.count() > 0


def test_schema_sniff_validate(spark):
    from civitas.sources.csv_bulk import schema_sniff_validate
    root = work_dir(spark, "t-sniff")
    _write(f"{root}/ok/a.csv", "A;B\n1;2\n3;4\n")
    _write(f"{root}/one/a.csv", "ONLY\n1\n")
    assert schema_sniff_validate(spark, f"{root}/ok/*")["ok"]
    bad = schema_sniff_validate(spark, f"{root}/one/*")
    assert not bad["ok"] and bad["columns"] == 1


def test_headered_reader_width_header_words_and_unknown_headers(spark):
    root = work_dir(spark, "t-csv4")
    mapping = {"id": ["ID"], "val": ["VAL"], "far": ["FAR"]}
    _write(f"{root}/a.csv", "ID;X;Y;Z;VAL;FAR\nID;1;2;3;a;z\n2;;;;b\n")  # a value like a header word
    df = scan_csv_headered(spark, f"{root}/*.csv", mapping)
    assert sorted(((r.id, r.val, r.far) for r in df.collect()), key=str) == [
        ("2", "b", None), ("ID", "a", "z")]
    _write(f"{root}/b.csv", "CODIGO;VALOR\n2;b\n")
    with pytest.raises(Exception, match="no known header in .*b.csv"):
        scan_csv_headered(spark, f"{root}/*.csv", mapping).collect()


def _put(root, name, data):
    import os
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/{name}", "wb") as f:
        f.write(data)


def test_one_garbage_file_of_a_folder_is_told(spark):
    from civitas.sources.csv_bulk import inspect_csv_files, schema_sniff_validate, split_csv_files
    root = work_dir(spark, "t-inspect").removeprefix("file:") + "/a b"
    good = "\ufeffCHAVE;NOME\n1;José\n2;\"x;y\"\n".encode()
    _put(root, "a.csv", good)
    assert schema_sniff_validate(spark, root)["ok"]
    _put(root, "b.csv", bytes(range(256)) * 20)
    _put(root, "c.csv", b"CHAVE,NOME\n1,a\n")
    _put(root, "d.csv", b"CHAVE;NOME\n1;a;b\n2;c\n")
    _put(root, "e.csv", "CHAVE;NOME\n1;Jos\u00e9\n".encode("latin-1"))
    _put(root, "f.csv", b"CHAVE;OUTRO\n1;a\n")
    _put(root, "g.csv", b"")
    _put(root, "h.csv", b"CHAVE;NOME\n")
    res = schema_sniff_validate(spark, root)
    assert not res["ok"]
    files, bad = split_csv_files(spark, root, required=["CHAVE", "NOME"])
    name = lambda f: f.rsplit("/", 1)[1]
    assert [name(f) for f in files] == ["a.csv"]
    assert {name(f): r for f, r in bad.items()} == {
        "b.csv": "encoding", "c.csv": "separator", "d.csv": "ragged", "e.csv": "encoding", "f.csv": "header",
        "g.csv": "empty", "h.csv": "no rows"}
    assert spark.read.text(files).count() == 3
    latin = inspect_csv_files(spark, f"{root}/e.csv", encoding="ISO-8859-1").first()
    assert latin.ok and latin.lines == 2 and latin["columns"] == 2
    some = inspect_csv_files(spark, f"{root}/d.csv", max_bad_rate=0.5).first()
    assert some.ok and some.bad_width == 1


def test_json_records_that_drift(spark):
    from civitas.sources.json_records import observed_schema, scan_json_drifting
    root = work_dir(spark, "t-drift").removeprefix("file:")
    lines = ['{"id":1,"v":2.5,"p":{"q":"a"}}', '{"id":"2","v":"3.5"}', '{"id":3,"v":{"x":1},"p":"no object"}', '{"id":4',
             '[{"id":5}]', '{"v":1}', '{"id":null}', '{"id":"x"}', "", "7", '{"id":8,"v":null}']
    _put(root, "a.json", "\n".join(lines).encode())
    rows = scan_json_drifting(spark, root, {"id": ("$.id", "bigint"), "v": ("$.v", "double"), "q": ("$.p.q", "string")},
                              required=["id"]).collect()
    assert len(rows) == len([x for x in lines if x])
    got = {r.raw: (r.id, r.v, r.q, r.drifted, r.rejected) for r in rows}
    assert got[lines[0]] == (1, 2.5, "a", [], None)
    assert got[lines[1]] == (2, 3.5, None, [], None)
    assert got[lines[2]] == (3, None, None, ["v"], None)
    assert got[lines[10]] == (8, None, None, [], None)
    assert {raw: g[4] for raw, g in got.items() if g[4]} == {
        lines[3]: "broken", lines[4]: "shape", lines[5]: "missing", lines[6]: "missing", lines[7]: "missing", "7": "shape"}
    assert observed_schema(spark, f"{root}/a.json")
    assert spark.createDataFrame([], "a int").count() == 0
