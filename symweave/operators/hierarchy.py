"""The supertype graph: closure in depth-first order, components, inherited members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import discard, stored
from .rank import first_by

#: Member names that every type has.
OBJECT_METHODS = ("equals", "hashCode", "toString", "getClass", "notify", "notifyAll", "wait", "clone", "finalize")


#: Rows up to which the shorter side of a composition is broadcast.
BROADCAST_ROWS = 200_000
#: Edges beyond which types that nothing extends get their ways from their parents' after those were found, and the share of
#: edges above them up to which that is done.
PEELED_ROWS, PEELED_SHARE = 50_000, 0.8


def closure(edges: DataFrame, broadcast_rows: int = BROADCAST_ROWS, peeled_rows: int = PEELED_ROWS) -> DataFrame:
    """edges(child, parent, ordinal) -> child, ancestor, depth, path: the first way to each ancestor in depth-first order.

    path is the list of edge ordinals; lists compare element by element, so their order is pre-order. A round puts
    ways together with ways and keeps the first to each ancestor, so the longest way doubles and a graph of n levels takes
    about log2 n rounds, however many ways lead through it. In large graphs that is done for the top alone: types that nothing
    extends are set aside, then those that only they extend, and so on, and get their ways from their parents' in one step each, so
    that a way is made once for each parent that leads to it. Types that reach a cycle (an error in the sources) are walked
    level by level instead, as there a first way may be no way of first ways: each ancestor gets a way that visits no
    type twice, though not always the first of all such ways.
    """
    edges = stored(_edges(edges), "edges")
    return _measured(_closed(edges, edges, None, broadcast_rows, peeled_rows))


def _measured(ways: DataFrame) -> DataFrame:
    return ways.select("child", "ancestor", F.size("path").alias("depth"), "path")


def _edges(edges: DataFrame) -> DataFrame:
    return edges.where("parent is not null and child <> parent").groupBy("child", "parent").agg(F.min("ordinal").alias("ordinal"))


def _extended(own: DataFrame, above: DataFrame) -> DataFrame:
    """First ways (child, ancestor, path), stored, of the children of own, given those of all their parents (above)."""
    first = own.select("child", F.col("parent").alias("ancestor"), F.array("ordinal").alias("path"))
    steps = above.select(F.col("child").alias("parent"), "ancestor", "path")
    further = own.join(steps, "parent").select("child", "ancestor", F.concat(F.array("ordinal"), "path").alias("path"))
    return stored(first.unionByName(further).groupBy("child", "ancestor").agg(F.min("path").alias("path")), "ways")


def _closed(edges: DataFrame, own: DataFrame, beyond: DataFrame | None, broadcast_rows: int, peeled_rows: int = PEELED_ROWS) -> DataFrame:
    """First ways (child, ancestor, path), stored, of the children of own, given all edges that they reach; beyond has
    the first ways of all types that they reach and that are not children of own."""
    if beyond is not None:
        back = beyond.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("child"))
        if not beyond.join(back, ["child", "ancestor"], "left_semi").isEmpty():
            return _by_levels(edges, own.select("child").distinct())
    leaves = []  # edges of types that none of the types left extends
    while (n := own.count()) > peeled_rows:
        upper = stored(own.join(own.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"), "own-edges")
        if upper.count() > PEELED_SHARE * n:
            break
        leaves.append(own.join(upper.select("child").distinct(), "child", "left_anti"))
        own = upper
    ways = _doubled(edges, own, beyond, broadcast_rows)
    for part in reversed(leaves):
        above = ways if beyond is None else ways.unionByName(beyond.select("child", "ancestor", "path"))
        ways = ways.unionByName(_extended(part, above))
    return ways


def _doubled(edges: DataFrame, own: DataFrame, beyond: DataFrame | None, broadcast_rows: int) -> DataFrame:
    """The same by doubling, where ways of beyond lead into no cycle."""
    ways = stored(own.select("child", F.col("parent").alias("ancestor"), F.array("ordinal").alias("path"), F.lit(True).alias("fresh")), "ways")
    turning = None  # children that reach a cycle
    while True:
        steps = ways if beyond is None else ways.unionByName(beyond.select("child", "ancestor", "path", F.lit(False).alias("fresh")))
        steps = steps.select(F.col("child").alias("via"), F.col("ancestor").alias("to"), F.col("path").alias("onward"), F.col("fresh").alias("new_step"))
        steps = F.broadcast(steps) if steps.count() <= broadcast_rows else steps
        longer = ways.join(steps, (F.col("ancestor") == F.col("via")) & (F.col("fresh") | F.col("new_step")))
        longer = longer.select("child", F.col("to").alias("ancestor"), F.concat("path", "onward").alias("path"), F.lit(True).alias("fresh"))
        best = ways.withColumn("fresh", F.lit(False)).unionByName(longer).groupBy("child", "ancestor").agg(F.min(F.struct("path", "fresh")).alias("w"))
        before, ways = ways, stored(best.select("child", "ancestor", "w.path", "w.fresh"), "ways")
        discard(before)
        round_ = ways.where("child = ancestor").select("child")
        if turning is not None or not round_.isEmpty():
            turning = round_ if turning is None else round_.unionByName(turning)
            turning = stored(turning.unionByName(ways.join(turning.select(F.col("child").alias("ancestor")).distinct(), "ancestor", "left_semi").select("child")).distinct(), "turning")
            ways = stored(ways.join(turning, "child", "left_anti"), "ways")
        if ways.where("fresh").isEmpty():
            break
    ways = ways.drop("fresh")
    if turning is None:
        return ways
    return stored(ways.unionByName(_by_levels(edges, turning)), "closure")


def _by_levels(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """First ways of starts(child). Ways are extended from the last level's gains alone, each with the types it has
    visited; each level is a stored table, so the plan stays one join deep."""
    way = ["child", "ancestor", "path", "visited"]
    first = edges.join(starts, "child", "left_semi")
    gains = stored(first.select("child", F.col("parent").alias("ancestor"), F.array("ordinal").alias("path"), F.array("child", "parent").alias("visited")), "gains")
    known = stored(gains.select("child", "ancestor", "path"), "closure")
    step = edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"), "ordinal")
    while True:
        further = gains.join(step, "ancestor").where(~F.array_contains("visited", F.col("next")))
        further = further.select("child", F.col("next").alias("ancestor"), F.concat("path", F.array("ordinal")).alias("path"), F.concat("visited", F.array("next")).alias("visited"))
        further = further.groupBy("child", "ancestor").agg(F.min_by(F.struct("path", "visited"), "path").alias("w")).select("child", "ancestor", "w.path", "w.visited")
        old = known.withColumnRenamed("path", "old")
        before, gains = gains, stored(further.join(old, ["child", "ancestor"], "left").where("old is null or path < old").select(*way), "gains")
        discard(before)
        if gains.isEmpty():
            return known
        # one table of the best ways so far: what a round reads is that and the last round's gains
        merged = stored(known.unionByName(gains.select("child", "ancestor", "path")).groupBy("child", "ancestor").agg(F.min("path").alias("path")), "closure")
        discard(known)
        known = merged


def entered(below: DataFrame, own: DataFrame) -> DataFrame:
    """child: the types that edges own(child, parent) of below(child) lead to and that are not below themselves."""
    return own.where("parent is not null").select(F.col("parent").alias("child")).distinct().join(below, "child", "left_anti")


def rederived(below: DataFrame, closed: DataFrame, edges: DataFrame, broadcast_rows: int = BROADCAST_ROWS, own: DataFrame | None = None, peeled_rows: int = PEELED_ROWS) -> DataFrame:
    """child, ancestor, depth, path anew for below(child): all types whose edges changed and all that reached one of them.

    closed is the closure from before, edges(child, parent, ordinal) those of now. All ways of those types are dropped and
    found again from their edges and, where they leave them, from what closed has for types that nothing changed for;
    of both only rows that they reach are used. Where the caller has the edges of below at hand (own), others are only
    read if there are cycles.
    """
    below = stored(below.select("child").distinct(), "below")
    edges = _edges(edges)
    own = stored((edges if own is None else _edges(own)).join(below, "child", "left_semi"), "own-edges")
    beyond = stored(closed.join(entered(below, own), "child", "left_semi").select("child", "ancestor", "path"), "beyond")
    reached = below.unionByName(entered(below, own)).unionByName(beyond.select(F.col("ancestor").alias("child"))).distinct()
    return _measured(_closed(edges.join(reached, "child", "left_semi"), own, beyond, broadcast_rows, peeled_rows))


def updated_closure(closed: DataFrame, edges: DataFrame, changed: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The closure after a batch: closed from before, edges(child, parent, ordinal) of now, changed(child) the types whose
    edges are others than before. Equals closure(edges); the rows of types above and beside the changed ones are kept."""
    changed = stored(changed.select("child").distinct(), "changed")
    below = changed.unionByName(closed.join(changed.select(F.col("child").alias("ancestor")), "ancestor", "left_semi").select("child")).distinct()
    below = stored(below, "below")
    again = rederived(below, closed, edges, broadcast_rows)
    return closed.join(below, "child", "left_anti").select("child", "ancestor", "depth", "path").unionByName(again)


def joint_closure(edges: DataFrame, nested: DataFrame, scopes: DataFrame, broadcast_rows: int = BROADCAST_ROWS, peeled_rows: int = PEELED_ROWS) -> tuple[DataFrame, DataFrame]:
    """edges(child, name, parent, ordinal), nested(owner, name, fqn), scopes(child, scope, level) -> the edges with parents
    found, and their closure.

    A type declared inside another (scope; level 1 is the innermost around it) may name a parent that stands in no import:
    a type that the scope, or one of its ancestors, declares inside itself. So what a name means follows from the
    closure, and the closure from what names mean. Both are found together: edges without a parent get the type of that
    name that the innermost scope offers, itself first, then by its ancestors in depth-first order as known by then; types
    below them are derived again, and only scopes among those are asked in the next round. A name that no scope offers
    stays without a parent.

    Rounds have to do with the types alone that can stand above a scope, and with those that ask; the ways of all others are
    made once, when all names are settled.
    """
    edges = stored(edges.select("child", "name", "parent", "ordinal"), "edges")
    asking = stored(edges.where("parent is null").select("child", "name", "ordinal").join(scopes.select("child", "scope", "level"), "child"), "asking")
    inner = edges.where("parent is not null").select(F.col("parent").alias("child"))
    for more in (nested.select("fqn"), asking.select("scope"), asking.select("child")):
        inner = inner.union(more)
    inner = stored(inner.distinct(), "inner")
    outer = edges.join(inner, "child", "left_anti")
    edges = stored(edges.join(inner, "child", "left_semi"), "edges")
    closed = closure(edges, broadcast_rows, peeled_rows)
    offering = asking.select(F.col("scope").alias("owner"), "scope", F.expr("cast(array() as array<int>)").alias("path")).distinct()
    offering = offering.unionByName(_offering(closed, asking))
    while True:
        offers = asking.join(offering.join(nested.select("owner", "name", "fqn"), "owner"), ["scope", "name"]).where("fqn <> child")
        found = stored(first_by(offers, ["child", "name", "ordinal"], ["level", "path", "fqn"]).select("child", "name", "ordinal", F.col("fqn").alias("found")), "found")
        if found.isEmpty():
            break
        edges = stored(edges.join(found, ["child", "name", "ordinal"], "left").select("child", "name", F.coalesce("parent", "found").alias("parent"), "ordinal"), "edges")
        asking = stored(asking.join(found, ["child", "name", "ordinal"], "left_anti"), "asking")
        changed = found.select("child").distinct()
        below = stored(changed.unionByName(closed.join(changed.select(F.col("child").alias("ancestor")), "ancestor", "left_semi").select("child")).distinct(), "below")
        gained = rederived(below, closed, edges, broadcast_rows, peeled_rows=peeled_rows)
        closed = stored(closed.join(below, "child", "left_anti").select("child", "ancestor", "depth", "path").unionByName(gained), "closure")
        offering = _offering(gained, asking)
    rest = _measured(_extended(_edges(outer), closed))
    return edges.unionByName(outer), closed.unionByName(rest)


def _offering(closed: DataFrame, asking: DataFrame) -> DataFrame:
    """scope, owner, path: the ways of the scopes asked."""
    ways = closed.join(asking.select(F.col("scope").alias("child")).distinct(), "child", "left_semi")
    return ways.select(F.col("child").alias("scope"), F.col("ancestor").alias("owner"), F.col("path").cast("array<int>").alias("path"))


def with_self(closed: DataFrame, types: DataFrame) -> DataFrame:
    """The closure together with each type(fqn) itself at depth 0."""
    own = types.select(F.col("fqn").alias("child"), F.col("fqn").alias("ancestor"), F.lit(0).alias("depth"), F.expr("cast(array() as array<int>)").alias("path"))
    return closed.select("child", "ancestor", F.col("depth").cast("int").alias("depth"), F.col("path").cast("array<int>").alias("path")).unionByName(own)


def reachable_names(reach: DataFrame, members: DataFrame) -> DataFrame:
    """Names of the members, fields among them, that a type has or inherits (reach includes the type itself). With
    members from lookups.with_external, and ways to library types in reach, those of libraries count as well."""
    names = members.select(F.col("parent_name").alias("ancestor"), F.col("short_name").alias("name")).distinct()
    return reach.join(names, "ancestor").select(F.col("child").alias("type_fqn"), "name").distinct()


def nearest_return(reach: DataFrame, members: DataFrame) -> DataFrame:
    """type_fqn, name, from_fqn, return_type: of the first type in depth-first order that declares the method with a return
    type. A generic return type is preferred where members have one."""
    gives = F.coalesce("generic_return_type", "return_type") if "generic_return_type" in members.columns else F.col("return_type")
    own = members.where("kind = 'Function'").withColumn("gives", gives).where("gives is not null").groupBy("parent_name", "short_name").agg(F.min("gives").alias("return_type"))
    found = reach.join(own, reach["ancestor"] == own["parent_name"]).select(F.col("child").alias("type_fqn"), F.col("short_name").alias("name"), F.col("ancestor").alias("from_fqn"), "return_type", "path")
    return first_by(found, ["type_fqn", "name"], ["path", "from_fqn"]).drop("path")


def required_methods(types: DataFrame, members: DataFrame) -> DataFrame:
    """Functions that a subtype must implement: abstract ones, and an interface's that are neither default nor static."""
    owner = types.select(F.col("fqn").alias("parent_name"), F.col("kind").alias("owner_kind"))
    has = lambda m: F.array_contains("modifiers", m)
    return members.where("kind = 'Function'").join(owner, "parent_name").where(has("abstract") | ((F.col("owner_kind") == "Interface") & ~has("default") & ~has("static")))


def without_private(symbols: DataFrame) -> DataFrame:
    """External symbols without private ones: what stands in a private type belongs to the nearest type around it that is
    not private, else to the package, and is named after it. symbols(jar_path, fqn, short_name, parent_name, kind, modifiers,
    ...), where a # parts what stands in a type and a dot a type from its package.

    Pointers to the type around double their reach each round, so types nested n deep take about log2 n rounds.
    """
    private = F.array_contains(F.coalesce("modifiers", F.expr("cast(array() as array<string>)")), "private")
    own = F.when(private, F.expr("cast(array() as array<string>)")).otherwise(F.array("short_name"))
    types = symbols.where(~F.col("kind").isin("Function", "Field"))
    # of several rows of a type in one jar, one that is not private counts
    up = first_by(types.select("jar_path", "fqn", F.col("parent_name").alias("up"), own.alias("tail")), ["jar_path", "fqn"], [F.size("tail").desc(), "up"])
    up = stored(up, "up")
    while True:
        over = up.select("jar_path", F.col("fqn").alias("up"), F.col("up").alias("next"), F.col("tail").alias("head"))
        joined = up.join(over, ["jar_path", "up"], "left")
        new = stored(joined.select("jar_path", "fqn", F.coalesce("next", "up").alias("up"), F.concat(F.coalesce("head", F.expr("cast(array() as array<string>)")), "tail").alias("tail"), F.col("next").isNotNull().alias("moved")), "up")
        discard(up)
        up = new
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
        up.stored_at = new.stored_at
    # where each type's members belong: its package and the kept names down to it
    place = up.select("jar_path", F.col("fqn").alias("parent_name"), F.col("up").alias("package"), F.col("tail").alias("around"))
    kept = symbols.where(~private).join(place, ["jar_path", "parent_name"], "left")
    names = F.coalesce("around", F.expr("cast(array() as array<string>)"))
    package = F.coalesce("package", "parent_name")
    parent = F.when(F.size(names) > 0, F.concat_ws(".", package, F.array_join(names, "#"))).otherwise(package)
    fqn = F.when(F.col("package").isNull(), F.col("fqn")).otherwise(F.concat(parent, F.when(F.size(names) > 0, "#").otherwise("."), "short_name"))
    return kept.withColumns({"fqn": fqn, "parent_name": parent}).select(*symbols.columns)


def loose_edges(edges: DataFrame, types: DataFrame, packages: DataFrame) -> DataFrame:
    """edges(child, name, parent) with parents, and, where one is missing, the type of that short name if exactly one type
    in sight has it: in the packages(child, package) that the child's file sees, or in one of its ancestors' packages.
    types(fqn, short_name, package_name); a name that several of those packages have gives no edge."""
    known = edges.where("parent is not null").select("child", "parent")
    open_ = edges.where("parent is null").select("child", "name").distinct()
    of = types.select(F.col("fqn").alias("ancestor"), F.col("package_name").alias("package")).distinct()
    closed = closure(known.withColumn("ordinal", F.lit(0)))
    sight = packages.select("child", "package").join(open_, "child", "left_semi")
    sight = sight.unionByName(closed.join(open_.select("child").distinct(), "child", "left_semi").join(of, "ancestor").select("child", "package")).distinct()
    named = types.select(F.col("short_name").alias("name"), F.col("package_name").alias("package"), "fqn").distinct()
    found = open_.join(named, "name").join(sight, ["child", "package"]).groupBy("child", "name").agg(F.count(F.lit(1)).alias("n"), F.min("fqn").alias("parent")).where("n = 1")
    return known.unionByName(found.select("child", "parent"))


def component(edges: DataFrame) -> DataFrame:
    """edges(child, parent) -> fqn, component: types linked upwards or downwards, named by the least of them."""
    pairs = edges.where("parent is not null").select(F.least("child", "parent").alias("a"), F.greatest("child", "parent").alias("b")).where("a <> b").distinct()
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).select(both["a"].alias("node"), "root").unionByName(labels.select("node", "root"))
        low = seen.groupBy("node").agg(F.min("root").alias("root"))  # its exchange serves both sides of the join below
        up = low.select(F.col("node").alias("via"), F.col("root").alias("top"))
        old = labels.select("node", F.col("root").alias("old"))
        new = stored(low.join(up, low["root"] == up["via"]).select("node", F.least("root", "top").alias("root")).join(old, "node"), "labels")
        discard(labels)
        labels = new
        if new.where("root <> old").isEmpty():
            return labels.select(F.col("node").alias("fqn"), F.col("root").alias("component"))
