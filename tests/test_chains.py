import pytest

from symweave.operators import chains


@pytest.fixture(scope="module")
def world(spark):
    project = spark.createDataFrame([("p.Order", None), ("p.Item", None), ("p.Box", ["T"])], "fqn string, type_params array<string>")
    library = spark.createDataFrame([("java.util.List", ["E"]), ("java.util.Map", ["K", "V"]), ("java.lang.String", None), ("p.Box", ["WRONG"]), ("java.util.Collection", ["E"])], "fqn string, type_params array<string>")
    classes = chains.class_type_params(project, library)
    members = spark.createDataFrame(
        [
            ("p.Order", "items", "List<Item>", None), ("p.Order", "index", "Map<String, Box<Item>>", None), ("p.Item", "name", "String", None), ("p.Box", "get", "T", None),
            ("java.util.List", "get", "E", None), ("java.util.Collection", "first", "E", None), ("java.util.Map", "values", "List<V>", None), ("java.util.List", "collect", "List<R>", ["R"]), ("p.Item", "size", "int", None),
        ],
        "parent_name string, short_name string, returns string, method_params array<string>",
    )
    own = [(f, f, []) for f in ("p.Order", "p.Item", "p.Box", "java.util.List", "java.util.Map", "java.lang.String", "java.util.Collection")]
    reach = spark.createDataFrame([*own, ("java.util.List", "java.util.Collection", [0])], "child string, ancestor string, path array<int>")
    return classes, reach, members


def test_project_type_parameters_come_first(world):
    got = {r.fqn: r.type_params for r in world[0].collect()}
    assert got["p.Box"] == ["T"] and got["java.util.Map"] == ["K", "V"] and got["p.Item"] == []


def test_chains_carry_type_arguments(spark, world):
    rows = [(1, "Order", ["items", "get", "name"]), (2, "Order", ["index", "values", "get", "get"]), (3, "p.Order", ["items", "first"]), (4, "Order", ["nothing", "name"]), (5, "Item", []), (6, "Map<K, V>", ["values"]), (7, "Order", ["items"] * 9), (8, "Unknown", ["x"])]
    got = {r.site: r.type_text for r in chains.walk(spark.createDataFrame(rows, "site int, type_text string, steps array<string>"), *world, 5).collect()}
    assert got == {1: "String", 2: "Item", 3: "Item", 4: "java.lang.Object", 5: "Item", 6: "List<V>", 7: None, 8: "java.lang.Object"}


def test_lambdas_bind_the_method_and_not_the_class(spark, world):
    rows = [(1, "Order", ["items", "collect"], ["name"]), (2, "Order", ["items", "collect"], ["size"]), (3, "List<Item>", ["collect"], None), (4, "List<Item>", ["get"], ["name"])]
    got = {r.site: (r.type_text, r.lambda_param) for r in chains.walk_with_lambda(spark.createDataFrame(rows, "site int, type_text string, steps array<string>, body array<string>"), *world, 4).collect()}
    assert got == {1: ("List<String>", "Item"), 2: ("List<int>", "Item"), 3: ("List<R>", "Item"), 4: ("Item", "Item")}
