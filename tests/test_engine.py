import json

import pytest

from ledgerline import Engine, execute_request

ROWS = "id,Name,role,team,pay\n1,Ada,Engineer,Core,700\n2,Ben,Manager,Sales,900\n\n3,Cid,Engineer,Core,80\n4,\"Doe, Di\",NULL,Sales,\n5,Eve,Analyst,Data,5d\n"


@pytest.fixture()
def path(tmp_path):
    file = tmp_path / "staff.csv"
    file.write_bytes(ROWS.encode())
    return str(file)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_predicates(spark, path):
    q = Engine(spark).find(path)
    assert ids(q.where({"TEAM": "Core"}).all()) == ["1", "3"]
    assert ids(q.where(["!=", "team", "Core"]).all()) == ["2", "4", "5"]
    assert ids(q.where([">", "pay", "8"]).all()) == ["2", "3"]  # as text
    assert ids(q.numeric().where([">", "pay", 100]).all()) == ["1", "2"]
    assert ids(q.where(["LIKE", "name", "E"]).all()) == ["2", "4", "5"]
    assert ids(q.where(["IS NULL", "role"]).all()) == ["4"]
    assert ids(q.where(["IS NULL", "pay"]).all()) == ["4"]
    assert ids(q.where(["IS NOT NULL", "pay"]).all()) == ["1", "2", "3", "5"]
    assert ids(q.where(["IN", "id", [1, 5.0]]).all()) == ["1", "5"]
    assert ids(q.where({"team": "Core"}).or_where({"team": "Data"}).and_where(["!=", "id", 3]).all()) == ["1", "5"]
    assert ids(q.where({}).all()) == ["1", "2", "3", "4", "5"] and ids(q.where({"operator": "OR", "children": []}).all()) == []
    for bad in (["=", "nope", 1], ["~", "id", 1], 5):
        with pytest.raises(ValueError):
            q.where(bad).all()


def test_aggregates(spark, path):
    q = Engine(spark).find(path)
    assert q.count() == 5 and q.where({"team": "Sales"}).count() == 2 and q.limit(2).offset(4).count() == 1
    assert {r["team"]: r["value"] for r in q.group_by("team").aggregate("avg", "pay").all().collect()} == {"Core": 390.0, "Sales": 450.0, "Data": 0.0}
    assert q.group_by("team").count() == {"Core": 2, "Sales": 2, "Data": 1}
    assert q.sum("pay") == 1680.0 and q.min("pay") == 0.0 and q.max("pay") == 900.0
    assert sorted(r[0] for r in q.distinct("team").collect()) == ["Core", "Data", "Sales"]
    assert q.order_by("id", "DESC").one()["id"] == "5" and q.where({"id": "9"}).one() is None
    with pytest.raises(ValueError):
        q.group_by("team").aggregate("median", "pay").all()


def test_locators(spark, path):
    q = Engine(spark).find(path, locators=True)
    assert [tuple(r) for r in q.locators().orderBy("line").collect()] == [(22, 2), (46, 3), (71, 5), (94, 6), (118, 7)]
    assert [r["line"] for r in q.limit(2).offset(1).locators().collect()] == [3, 5]


def test_updates_and_index_agree(spark, path, tmp_path):
    engine = Engine(spark, index_dir="file://" + str(tmp_path / "index"))
    plain = ids(Engine(spark).find(path).where({"team": "Core", "role": "Engineer"}).and_where([">", "pay", "75"]).all())
    for columns in (["team"], ["role", "team"], ["team", "pay"]):
        engine.create_index(path, columns)
        q = engine.find(path).where({"team": "Core", "role": "Engineer"}).and_where([">", "pay", "75"])
        assert ids(q.all()) == plain == ["3"] and engine.find(path).count() == 5
    assert "Index: role__team" in q.explain()
    meta = engine.catalog(path).meta()
    assert meta["totalRows"] == 5 and meta["indexes"]["team"]["distinctCount"] == 3
    (tmp_path / "staff_updates.json").write_text(json.dumps({"rows": {"3": {"team": "Core", "role": "Engineer", "pay": "99"}}}))
    assert ids(engine.find(path).where({"team": "Core", "role": "Engineer"}).and_where([">", "pay", "75"]).all()) == ["2", "3"]
    (tmp_path / "staff_updates.json").unlink()
    with open(path, "a") as f:
        f.write("6,Fay,Engineer,Core,8\n")
    assert engine.find(path).count() == 6  # the index is stale


def test_requests(spark, path, tmp_path):
    assert execute_request(spark, {"action": "count", "csv": path, "where": {"team": "Core"}}) == {"status": "ok", "count": 2}
    out = execute_request(spark, json.dumps({"action": "query", "csv": path, "where": {"operator": "=", "column": "team", "value": "Sales"}}))
    assert sorted(tuple(r) for r in out["data"].collect()) == [(46, 3), (94, 6)]
    assert execute_request(spark, {"action": "index", "csv": path, "cols": '["team", ["team", "role"]]', "indexDir": "file://" + str(tmp_path / "i")}) == {"status": "ok"}
    assert execute_request(spark, {"action": "drop", "csv": path})["status"] == "error"


def test_files(spark, tmp_path):
    bom = tmp_path / "bom.csv"
    bom.write_bytes(b"\xef\xbb\xbfa;A;\"b\"\r\n1;2;x\r\n3;4\r\n")
    df = Engine(spark, sep=";").find(str(bom)).all()
    assert df.columns == ["A", "b"] and sorted(tuple(r) for r in df.collect()) == [("2", "x"), ("4", None)]
    assert [tuple(r) for r in Engine(spark, sep=";").find(str(bom), locators=True).locators().orderBy("line").collect()] == [(12, 2), (19, 3)]
    for name, data, n in (("empty", b"", 0), ("head", b"a,b\n", 0), ("tail", b"a,b\n1,2", 1)):
        (tmp_path / f"{name}.csv").write_bytes(data)
        assert Engine(spark).find(str(tmp_path / f"{name}.csv")).count() == n
    folder = str(tmp_path / "out.csv")
    frame = spark.createDataFrame([("x", 'q"1')], "a string, b string")
    Engine(spark).append(frame, folder)
    Engine(spark).append(frame, folder)
    assert [tuple(r) for r in Engine(spark).find(folder).all().collect()] == [("x", 'q"1')] * 2
    with pytest.raises(ValueError):
        Engine(spark).append(frame.withColumnRenamed("a", "c"), folder)


def test_quoted_line_feeds(spark, tmp_path):
    file = tmp_path / "notes.csv"
    rows = [(str(i), ('say ""hi""\n\nand, go ' * (i % 3) + str(i)), "x") for i in range(400)]
    file.write_bytes(("id,note,z\n" + "".join(f'{i},"{n}",{z}\n' for i, n, z in rows) + '9,"cut off\n').encode())
    want = sorted((i, n.replace('""', '"'), z) for i, n, z in rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for most in (old, "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            engine = Engine(spark)
            got = engine.find(str(file), locators=True).df
            assert sorted((r["id"], r["note"], r["z"]) for r in got.collect()) == want
            data = file.read_bytes()
            for r in got.collect():
                assert data[r["offset"] :].startswith(f'{r["id"]},"'.encode()) and r["line"] == int(r["id"]) + 2
            if most != old:
                assert got.select("offset").rdd.getNumPartitions() > 1 and sorted(tuple(r) for r in engine.find(str(file)).df.collect()) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sidecars_and_numbers(spark, path, tmp_path):
    engine = Engine(spark, index_dir="file://" + str(tmp_path / "index"))
    engine.save_schema(path, {"site": "north", "team": "ignored"})
    q = engine.find(path)
    assert {r["site"] for r in q.all().collect()} == {"north"} and q.where({"site": "north", "team": "Core"}).count() == 2 and q.where({"site": "south"}).count() == 0
    assert q.group_by("site").count() == {"north": 5} and q.group_by("team").groups_json() == '{"Core": 1.0, "Data": 1.0, "Sales": 1.0}'
    assert [r["pay"] for r in q.numeric().order_by("pay", "DESC").limit(2).all().collect()] == ["900", "700"] and [r["pay"] for r in q.order_by("pay", "DESC").limit(2).all().collect()] == ["900", "80"]
    engine.save_updates(path, {2: {"pay": "5"}})
    assert engine.find(path).sum("pay") == 985.0
    with pytest.raises(ValueError):
        engine.save_updates("x.parquet", {})


def test_indexes_of_like_names_and_changed_sources(spark, tmp_path):
    engine = Engine(spark, index_dir="file://" + str(tmp_path / "index"))
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "t.csv").write_text("k,v\n" + "".join(f"{i % 7},{d}{i}\n" for i in range(70)))
        engine.create_index(str(tmp_path / d / "t.csv"), ["k"])
    for d in ("a", "b"):
        q = engine.find(str(tmp_path / d / "t.csv")).where({"k": 3})
        assert q.explain().startswith("Index: k") and {r["v"][0] for r in q.all().collect()} == {d}
    # the same size and time, another text
    file, stat = tmp_path / "a" / "t.csv", (tmp_path / "a" / "t.csv").stat()
    file.write_text(file.read_text().replace("a3", "c3"))
    import os

    os.utime(file, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert engine.find(str(file)).where({"k": 3}).explain().startswith("Index: none")
    engine.create_index(str(file), ["k"], covering=False)
    q = engine.find(str(file)).where({"k": 3})
    assert q.explain().startswith("Index: none") and q.count() == 10 and engine.find(str(file), locators=True).where({"k": 3}).group_by("k").count() == {"3": 10}
    assert engine.catalog(str(file)).best({"k": "3"}, needed=["K"])[1].columns == ["k", "offset", "line"]
