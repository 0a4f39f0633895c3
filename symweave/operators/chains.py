"""Member chains with generic types: a.items().first().name, and what lambdas return or take, one join per step.

A chain is an array of step names below a starting type text such as 'Map<String, List<Item>>'. Each step finds the
member on the type or its supertypes, takes its (generic) return type and puts the receiver's type arguments in
place of the type variables of the receiver's class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import stored
from ..functions.types import parse_type_udf, substitute_udf
from .rank import first_by, prioritised

OBJECT = "java.lang.Object"
_NONE = "cast(array() as array<string>)"


def class_type_params(symbols: DataFrame, external: DataFrame) -> DataFrame:
    """fqn, type_params: of the project's type, else of the library's; classes without any have an empty list.

    Both need fqn and type_params (array or null).
    """
    parts = [x.select("fqn", F.coalesce("type_params", F.expr(_NONE)).alias("type_params")) for x in (symbols, external)]
    return prioritised(["fqn"], [F.size("type_params").desc(), F.array_join("type_params", ",")], *parts).select("fqn", "type_params")


def _owner(types: DataFrame, classes: DataFrame) -> DataFrame:
    """types(type_text) -> type_text, owner, owner_params, args."""
    parsed = types.select("type_text").distinct().withColumn("t", parse_type_udf("type_text")).select("type_text", F.col("t.base").alias("base"), F.col("t.args").alias("args"))
    named = classes.select("fqn", "type_params", F.explode(F.array_distinct(F.array("fqn", F.substring_index("fqn", ".", -1)))).alias("base"))
    first = first_by(named, ["base"], ["fqn"])
    return parsed.join(first, "base").select("type_text", F.col("fqn").alias("owner"), F.col("type_params").alias("owner_params"), "args")


def _members(asked: DataFrame, reach: DataFrame, members: DataFrame) -> DataFrame:
    """asked(owner, step) -> owner, step, returns, method_params of the first type in depth-first order that has the member."""
    places = asked.select("owner", "step").distinct().join(reach.select(F.col("child").alias("owner"), F.col("ancestor").alias("parent_name"), "path"), "owner")
    offers = members.where("returns is not null").select("parent_name", F.col("short_name").alias("step"), "returns", F.coalesce("method_params", F.expr(_NONE)).alias("method_params"))
    return first_by(places.join(offers, ["parent_name", "step"]), ["owner", "step"], ["path", "returns"]).select("owner", "step", "returns", "method_params")


def step_types(now: DataFrame, classes: DataFrame, reach: DataFrame, members: DataFrame, bound: Column | None = None) -> DataFrame:
    """now(type_text, step, ...) with type_text replaced by what the step gives, or java.lang.Object where it gives nothing.

    bound, where given, is the type that the method's first own type variable stands for; it never overrides a
    variable of the receiver's class.
    """
    owned = now.join(_owner(now, classes), "type_text", "left")
    typed = owned.join(_members(owned.where("owner is not null"), reach, members), ["owner", "step"], "left")
    own = F.coalesce("owner_params", F.expr(_NONE))
    args = F.coalesce("args", F.expr(_NONE))
    n = F.least(F.size(own), F.size(args))
    params, values = F.slice(own, F.lit(1), n), F.slice(args, F.lit(1), n)
    if bound is not None:
        extra = F.when(bound.isNotNull() & (F.size("method_params") > 0), F.slice("method_params", 1, 1)).otherwise(F.expr(_NONE))
        params, values = F.concat(params, F.coalesce(extra, F.expr(_NONE))), F.concat(values, F.when(F.size(extra) > 0, F.array(bound)).otherwise(F.expr(_NONE)))
    got = F.coalesce(substitute_udf("returns", params, values), F.lit(OBJECT))
    return typed.withColumn("__new", got).drop("type_text", "owner", "owner_params", "args", "returns", "method_params").withColumnRenamed("__new", "type_text")


def walk(start: DataFrame, classes: DataFrame, reach: DataFrame, members: DataFrame, most_steps: int) -> DataFrame:
    """start(type_text, steps array, ...) with type_text at the end of each chain. Chains longer than most_steps give null."""
    # each step reads its input several times, so it is stored: the plan stays one step deep
    now = stored(start, "chain")
    for i in range(most_steps):
        if now.where(F.size("steps") > i).isEmpty():
            break
        moving = now.where(F.size("steps") > i).withColumn("step", F.get("steps", F.lit(i)))
        done = now.where(F.size("steps") <= i)
        now = stored(done.unionByName(step_types(moving, classes, reach, members).select(*done.columns)), "chain")
    return now.withColumn("type_text", F.when(F.size("steps") <= most_steps, F.col("type_text")))


def walk_with_lambda(start: DataFrame, classes: DataFrame, reach: DataFrame, members: DataFrame, most_steps: int) -> DataFrame:
    """start(site, type_text, steps, body) where body is the chain of the last step's lambda, without its parameter.

    The parameter has the receiver's last type argument (an element, or a map's value); what the body gives stands
    for the method's own type variable, as in items.collect { it.name }: List<String>. A null body binds nothing.
    """
    before = walk(start.withColumn("all", F.col("steps")).withColumn("steps", F.slice("steps", F.lit(1), F.greatest(F.lit(0), F.size("steps") - 1))), classes, reach, members, most_steps)
    at = before.withColumn("t", parse_type_udf("type_text")).withColumn("element", F.get("t.args", F.size("t.args") - 1)).drop("t")
    inner = at.where("body is not null and element is not null").select("site", F.col("element").alias("type_text"), F.col("body").alias("steps"))
    result = walk(inner, classes, reach, members, most_steps).select("site", F.col("type_text").alias("lambda_type"))
    last = stored(at.join(result, "site", "left").withColumn("step", F.element_at("all", -1)), "chain")
    return step_types(last, classes, reach, members, F.col("lambda_type")).select("site", "type_text", F.col("element").alias("lambda_param"))
