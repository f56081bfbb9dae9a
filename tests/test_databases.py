import pytest

from orrery.operators.databases import Databases


def test_databases(spark, tmp_path):
    dbs = Databases(spark, f"file://{tmp_path}/root")
    dbs.create("a", "u1", ["u2", "u2"]).vectors("v").add("k", {"x": 1}, [1.0, 2.0])
    dbs.create("b", "u3")
    assert dbs.names() == ["a", "b"] and dbs.names("u2", is_admin=False) == ["a"] and dbs.names("u9", is_admin=False) == []
    for bad in ("a", "", "../x", "system"):
        with pytest.raises(ValueError):
            dbs.create(bad)
    assert tuple(dbs.details("a").first()) == ("v", 1, 2, 8, 8)
    info = {r["name"]: r for r in dbs.info().collect()}
    assert (info["a"]["owner"], info["a"]["users"], info["a"]["vectors"], info["a"]["size"], info["a"]["collections"]) == ("u1", ["u2"], 1, 16, ["v"])
    assert info["a"]["file_bytes"] > info["b"]["file_bytes"] > 0 and info["b"]["vectors"] == 0 and info["b"]["collections"] == []
    assert Databases(spark, f"file://{tmp_path}/none").info().count() == 0
    dbs.delete("a")
    for call in (dbs.open, dbs.delete):
        with pytest.raises(KeyError):
            call("a")
    assert dbs.names() == ["b"] and len(dbs.create("a").vectors("v")) == 0
