import json

import pytest

from plumbline.model import Registry
from plumbline.plans import commands, declared
from plumbline.sources.registry import ConfigError, SchemaError, load_tables


def f(name, type="int", **v):
    return {"name": name, "type": type, "nullable": False} | v


def test_merge_writes_drops_and_settles(spark, tmp_path):
    folder = str(tmp_path / "tables")
    commands.init_dbml(spark, "Table a.x {\n id int [pk]\n old int\n}\nTable a.gone {\n id int\n}", folder)
    live = Registry.of(spark, [{"name": "a.x", "fields": [f("id"), f("new")], "primary_key": ["id"]}, {"name": "a.y", "fields": [f("id")]}, {"name": "b.z", "fields": [f("id")]}])
    repo = lambda: Registry.of(spark, load_tables(spark, folder))
    assert commands.drift(repo(), live, "a").code == 1
    dry = commands.merge_into(repo(), live, folder, "a", dry_run=True)
    assert dry.code == 1 and len(dry.files) == 2 and len(load_tables(spark, folder)) == 2
    with pytest.raises(ConfigError):
        commands.merge_into(repo(), live, folder, remove_tables=True)
    done = commands.merge_into(repo(), live, folder, "a", remove_columns=True, remove_tables=True)
    assert done.code == 0 and [t["name"] for t in load_tables(spark, folder)] == ["a.x", "a.y"]
    assert [x["name"] for x in load_tables(spark, folder)[0]["fields"]] == ["id", "new"]
    again = commands.merge_into(repo(), live, folder, "a")
    assert again.files == [] and commands.drift(repo(), live, "a").code == 0


def test_init_keeps_files_unless_told(spark, tmp_path):
    folder = str(tmp_path)
    assert len(commands.init_dbml(spark, "Table t {\n id int\n}\nTableGroup g {\n t\n}", folder + "/t", sections_folder=folder + "/s").files) == 1
    assert json.loads((tmp_path / "s/g.json").read_text()) == {"name": "g", "tables": ["t"]}
    assert commands.init_dbml(spark, "Table t {\n id bigint\n}", folder + "/t").files in ((), [])
    assert json.loads((tmp_path / "t/t.json").read_text())["fields"][0]["type"] == "int"
    commands.init_dbml(spark, "Table t {\n id bigint\n}", folder + "/t", overwrite=True)
    assert json.loads((tmp_path / "t/t.json").read_text())["fields"][0]["type"] == "bigint"


def test_check_and_document(spark, tmp_path):
    rules = Registry.of(spark, declared.rule_documents(), declared.SECTIONS, declared.ENDPOINTS)
    assert commands.check(rules).code == 1 and commands.check(rules, cross=True).code == 1
    clean = Registry.of(spark, [{"name": "t", "fields": [f("id", is_match_column=True) | {"nullable": True}]}])
    assert commands.check(clean).code == 0 and commands.check(clean, strict=True).code == 1
    commands.document(rules, "dbml", str(tmp_path / "d.dbml"))
    assert (tmp_path / "d.dbml").read_text().startswith("Table")
    assert [commands.exit_code(e) for e in (SchemaError(), ConfigError(), OSError())] == [2, 4, 5]


def test_failures_have_codes_at_the_boundary():
    def fail(error):
        raise error

    codes = {SchemaError("a"): 2, commands.ReleaseError("b"): 3, ConfigError("c"): 4, OSError("d"): 5}
    assert {e: commands.guarded(fail, e).code for e in codes} == codes and commands.guarded(commands.version).code == 0
    assert commands.guarded(commands.version).text.startswith("plumbline ")
    assert json.loads(commands.schema("table").text)["type"] == "object"


def test_live_comes_from_a_folder_or_a_connection(spark, tmp_path):
    commands.init_dbml(spark, "Table a.x {\n id int [pk]\n}", str(tmp_path))
    assert [r["name"] for r in commands.live_of(spark, folder=str(tmp_path)).documents.collect()] == ["a.x"]
    for bad in ({}, {"connection": "jdbc:x", "folder": str(tmp_path)}, {"connection": "jdbc:x", "provider": "oracle"}):
        assert commands.guarded(commands.live_of, spark, **bad).code == 4


def test_init_captures_small_tables(spark, tmp_path):
    live = Registry.of(spark, [{"name": "state", "fields": [f("id"), f("name", "text")], "primary_key": ["id"]}, {"name": "big", "fields": [f("id")]}, {"name": "sick", "fields": [f("id")]}])
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "id int, name string")
    sick = spark.range(3).selectExpr("cast(raise_error('no') as bigint) id")
    done = commands.init_live(live, str(tmp_path / "t"), sections_folder=str(tmp_path / "s"), rows={"state": rows, "big": spark.range(500), "sick": sick})
    assert len(done.files) == 3 and (tmp_path / "s/All Tables.json").is_file()
    assert json.loads((tmp_path / "t/state.json").read_text())["data"] == [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}, {"id": 3, "name": None}]
    assert "data" not in json.loads((tmp_path / "t/big.json").read_text()) and "data" not in json.loads((tmp_path / "t/sick.json").read_text())


def test_a_merge_names_documents_outside_of_its_folder(spark, tmp_path):
    commands.init_dbml(spark, "Table a.x {\n id int [pk]\n}", str(tmp_path / "far"))
    repo = Registry.of(spark, load_tables(spark, str(tmp_path / "far")))
    live = Registry.of(spark, [{"name": "a.x", "fields": [f("id", "bigint")], "primary_key": ["id"]}])
    done = commands.merge_into(repo, live, str(tmp_path / "near"), report=str(tmp_path / "report.md"))
    assert "Outside of" in done.text and "far/a.x.json" in done.text and (tmp_path / "report.md").read_text() == done.text


def test_endpoints_are_counted(spark):
    rules = Registry.of(spark, declared.rule_documents(), declared.SECTIONS, declared.ENDPOINTS)
    assert json.loads(commands.check(rules, cross=True).text)["summary"]["apisScanned"] == 1
