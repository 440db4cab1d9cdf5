"""Configuration, file scans, lookups and the analysis as an object."""

import zipfile

import pytest

from weftgraph.config import parse_properties, read_config
from weftgraph.operators import lookup
from weftgraph.session import Engine
from weftgraph.sources import scan


def test_properties():
    text = "# note\n! note\na=1\nb : x\\\n   y\nc d\ne=\\u00e9\\tz\nk\\=x=v\n\nempty=\n"
    assert parse_properties(text) == {"a": "1", "b": "xy", "c": "d", "e": "é\tz", "k=x": "v", "empty": ""}


def test_config(tmp_path):
    (tmp_path / "c.properties").write_text("project.root=app\nsource.folders=src, gen;more\nmax.depth=7\noutput.bom=false\nexclude.packages=java.**,**\nx.y=z\noutput.folder=/abs\n")
    c = read_config(str(tmp_path / "c.properties"))
    assert c.source_folders == [f"{tmp_path}/app/{x}" for x in ("src", "gen", "more")] and c.max_depth == 7 and c.output_bom is False and c.output_folder == "/abs"
    assert c.other == {"x.y": "z"} and c.problems() == [("exclude_packages", "**", "WILDCARD_ONLY")] and c.expand_max_candidates == 3
    (tmp_path / "bad.properties").write_text("max.depth=x")
    with pytest.raises(ValueError, match="max.depth"):
        read_config(str(tmp_path / "bad.properties"))


def test_scans(spark, tmp_path):
    for name, text in (("s1/a/B.java", "class B"), ("s1/C.java", "é"), ("s2/a/B.java", "x"), ("s1/n.txt", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(r.folder_ord, r.path, r["size"], r.text) for r in scan.source_files(spark, [f"{tmp_path}/s1", f"{tmp_path}/s2"]).collect()}
    assert got == {(0, "a/B.java", 7, "class B"), (0, "C.java", 2, "é"), (1, "a/B.java", 1, "x")}
    for name, entries in (("one.jar", ["p/A.class", "p/q/B.class", "META-INF/x.class", "r.txt"]), ("two.jar", ["p/q/B.class", "p/A.class", "META-INF/x.class", "r.txt"]), ("three.jar", ["Top.class"])):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for e in entries:
                z.writestr(e, "content of " + e)
    (tmp_path / "bad.jar").write_bytes(b"not an archive")
    rows = scan.library_facts(scan.library_entries(spark, [f"{tmp_path}/{n}.jar" for n in ("one", "two", "three", "bad")])).collect()
    by = {r.lib.rsplit("/", 1)[-1]: r for r in rows}
    assert by["one.jar"].fingerprint == by["two.jar"].fingerprint != by["three.jar"].fingerprint and by["bad.jar"].fingerprint == ""
    assert by["one.jar"].packages == ["p", "p.q"] and by["three.jar"].packages == [""] and by["bad.jar"].packages == []


@pytest.fixture
def engine(spark):
    edges = spark.createDataFrame([("a.A#m(int)", "a.A#n()"), ("a.A#n()", "b.B#x(int,int)"), ("c.C#z()", "a.A#m(int)")], "caller string, callee string")
    methods = spark.createDataFrame([("a.A#m(int)", "A", 1, 20), ("a.A#n()", "A", 5, 8), ("b.B#x(int,int)", "B", 1, 9), ("b.B#y(int)", "B", 10, 12), ("b.B#y(long)", "B", 13, 14), ("c.C#z()", "C", 1, 2)], "key string, file string, lo long, hi long")
    accesses = spark.createDataFrame([("A", 6, "a.A", "f", "a.A#n()", "read"), ("A", 6, "a.P", "f", "a.A#n()", "write"), ("B", 3, "a.A", "f", "b.B#x(int,int)", "write")], "file string, line long, owner string, field string, accessor string, access string")
    fields = spark.createDataFrame([("A", "a.A", "f"), ("A", "a.A", "g")], "file string, type string, field string")
    return Engine(spark, edges, methods, accesses, fields)


def test_engine(engine, tmp_path):
    assert engine.status() == {"methods": 6, "edges": 3}
    assert engine.find("a.A#n()") == ("a.A#n()", "exact") and engine.find("a.A#m(java.lang.Integer)") == ("a.A#m(int)", "loose")
    assert engine.find("b.B#y(short)") is None and engine.find("b.B#q()") is None and engine.find("nonsense") is None
    assert engine.at("A", 6) == "a.A#n()" and engine.at("A", 20) == "a.A#m(int)" and engine.at("A", 21) is None
    assert engine.field_at("A", 6, "f") == ("access", ["a.A#f", "a.P#f"]) and engine.field_at("A", 30, "g") == ("declaration", ["a.A#g"])
    assert engine.field_at("A", 7, "g") is None and engine.field_at("Z", 1, "g") is None
    with pytest.raises(ValueError):
        engine.field_at("A", 0, "g")
    assert {(r.depth, r.node) for r in engine.tree("c.C#z()").collect()} == {(1, "a.A#m(int)"), (2, "a.A#n()"), (3, "b.B#x(int,int)")}
    assert {r.node for r in engine.tree("a.A#n()", up=True).collect()} == {"a.A#m(int)", "c.C#z()"}
    with pytest.raises(KeyError):
        engine.tree("no#such()")
    assert {(r.accessor, r.access, r.caller) for r in engine.field_tree("a.A", "f").collect()} == {("a.A#n()", "read", "a.A#m(int)"), ("b.B#x(int,int)", "write", "a.A#n()")}
    engine.export("c.C#z()", f"{tmp_path}/out", depth=1)
    text = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part")).read_text(encoding="utf-8")
    assert text == "﻿depth,method,file,line,reason,note\n1,a.A#m(int),A,1,,depth-limit\n"


def test_lookups_in_bulk(spark):
    methods = spark.createDataFrame([("A#m(int)",), ("A#m(int,int)",), ("A#n()",)], "key string")
    wanted = spark.createDataFrame([("A#m(long)",), ("A#m(x,y)",), ("A#n()",), ("A#n(int)",)], "wanted string")
    assert {tuple(r) for r in lookup.find(methods, wanted).collect()} == {("A#m(long)", "A#m(int)", "loose"), ("A#m(x,y)", "A#m(int,int)", "loose"), ("A#n()", "A#n()", "exact")}


def test_command_line(engine, tmp_path, capsys):
    from weftgraph.__main__ import main

    for name in ("edges", "methods", "accesses", "fields"):
        getattr(engine, name).write.parquet(f"{tmp_path}/facts/{name}")
    (tmp_path / "c.properties").write_text("exclude.packages=**\n")

    def said(*argv):
        code = main([str(tmp_path / "c.properties"), f"{tmp_path}/facts", *argv])
        return code, capsys.readouterr().out.strip()

    assert said("check") == (1, "exclude_packages: **: WILDCARD_ONLY") and said("status") == (0, "methods=6 edges=3")
    assert said("find", "a.A#m(long)") == (False, "loose a.A#m(int)") and said("find", "x#y()") == (True, "not found")
    assert said("callees", "a.A#n()") == (0, "b.B#x(int,int)") and said("callers", "a.A#m(int)") == (0, "c.C#z()")
    assert said("nonsense")[0] == 2 and main([]) == 2
