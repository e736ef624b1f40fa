from __spark_entry__ import queries


def test_every_operator_is_registered():
    names = {name.split("_")[0] for name in queries() if name.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in queries()
