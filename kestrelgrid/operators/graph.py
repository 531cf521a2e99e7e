"""Calls, usages and dependencies: alias-resolving joins, dead code, bounded closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

# Names that are never reported as unused.
STOP_FUNCTIONS = ("__init__", "main")
#: Steps from the hub of a graph within which its largest cycles are looked for.
KNOT_STEPS = 8
#: Parts of a component's nodes, so that those of a large one are dealt out.
MEMBER_PARTS = 16


def resolve(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """calls(caller_module, callee_module, ...) with ``target``: alias resolved, local calls (null) in the own module."""
    names = aliases.select(F.col("module").alias("caller_module"), F.col("alias").alias("callee_module"), F.col("target").alias("_target"))
    out = calls.join(names, ["caller_module", "callee_module"], "left")
    return out.withColumn("target", F.coalesce("_target", "callee_module", "caller_module")).drop("_target")


def call_sites(calls: DataFrame, functions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolved calls joined to the definitions (module, name, arity) that they reach."""
    own = functions.select(F.col("module").alias("target"), F.col("name").alias("callee"), "arity").distinct()
    return resolve(calls, aliases).join(own, ["target", "callee", "arity"])


def reverse_calls(calls: DataFrame) -> DataFrame:
    """(key, n, sites): how many calls reach each ``module.function``, and its places (caller_module, line, times) in order.

    Calls of one place are counted map-side first, so what is gathered for a function is its distinct places.
    """
    key = F.concat(F.coalesce("target", F.lit("")), F.lit("."), F.col("callee"))
    places = calls.groupBy(key.alias("key"), "caller_module", "line").agg(F.count("*").alias("times"))
    return places.groupBy("key").agg(F.sum("times").alias("n"), F.array_sort(F.collect_list(F.struct("caller_module", "line", "times"))).alias("sites"))


def loose_callers(calls: DataFrame, names: DataFrame) -> DataFrame:
    """Calls whose last name part equals the function's, whatever the module; (module, function, line) once each."""
    last = F.element_at(F.split("callee", r"\."), -1)
    return calls.withColumn("name", last).join(names.select("name").distinct(), "name", "left_semi").dropDuplicates(["caller_module", "callee", "line"])


def consolidate(sites: DataFrame, key: list[str], by: str, order: list[str]) -> DataFrame:
    """The first site of each calling module."""
    rest = [c for c in sites.columns if c not in (*key, by)]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return sites.groupBy(*key, by).agg(first.alias("_f")).select(*key, by, "_f.*")


def usages(refs: DataFrame, target: Column) -> DataFrame:
    """(kind, module): modules that mention the target by alias, import, require, use or value, but not itself."""
    return refs.where((F.col("target") == target) & (F.col("module") != target)).select("kind", "module").distinct()


def unused(functions: DataFrame, sites: DataFrame, key: list[str]) -> DataFrame:
    """Definitions that no call reaches."""
    return functions.join(sites.select(*key).distinct(), key, "left_anti")


def dead_code(functions: DataFrame, sites: DataFrame, mentions: DataFrame, key: list[str]) -> DataFrame:
    """Public functions outside tests without a caller, with a confidence.

    low: the module uses macros or behaviours; medium: the module is mentioned
    as a value; else high. ``functions`` has is_public, is_test, is_impl,
    dynamic (module uses or implements behaviours); mentions(module).
    """
    wanted = functions.where(F.col("is_public") & ~F.col("is_test") & ~F.col("is_impl") & ~F.col("name").isin(*STOP_FUNCTIONS))
    lonely = unused(wanted, sites, key)
    as_value = mentions.select("module").distinct().withColumn("as_value", F.lit(True))
    graded = lonely.join(as_value, "module", "left")
    grade = F.when(F.col("dynamic"), "low").when(F.coalesce("as_value", F.lit(False)), "medium").otherwise("high")
    return graded.withColumn("confidence", grade)


def at_least(confidence: Column, level: str) -> Column:
    kept = {"high": ["high"], "medium": ["high", "medium"], "low": ["high", "medium", "low"]}[level]
    return confidence.isin(kept)


def closure(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth) of edges(src, dst): nodes within ``depth`` hops at their least depth, direct ones at 1.

    Breadth first, one join a level; nodes met before are dropped at each level,
    so a level holds each (root, node) once. Levels are written, so the plan of a
    level doesn't hold those before it; it ends early where a level is empty.
    """
    step = roots.select(F.col("root"), F.col("root").alias("node"))
    seen = step.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        nxt = step.join(edges, step["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        step = nxt.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        if d < depth:
            step = written(step)
            if step.isEmpty():
                break
        seen = seen.unionByName(step.withColumn("depth", F.lit(d)))
    return seen.where("depth > 0")


def _knot(edges: DataFrame) -> DataFrame:
    """(node): nodes around the hub of edges(src, dst) that reach it and are reached from it, within KNOT_STEPS: all of one cycle or another.

    The hub is the node with most edges on the side where it has fewer. Both searches
    are breadth first and meet each node once, so they cost no more than the edges.
    """
    ends = edges.where("src <> dst")
    ways = ends.select(F.lit(True).alias("ahead"), F.col("src").alias("node"), F.col("dst").alias("to")).union(ends.select(F.lit(False), "dst", "src"))
    hub = ways.groupBy("node").agg(F.least(F.count_if("ahead"), F.count_if(~F.col("ahead"))).alias("n")).agg(F.max_by("node", F.struct("n", "node"))).first()[0]
    found = step = edges.sparkSession.range(2).select((F.col("id") == 0).alias("ahead"), F.lit(hub).cast(edges.schema["src"].dataType).alias("node"))
    for _ in range(KNOT_STEPS):
        step = written(step.join(ways, ["ahead", "node"]).select("ahead", F.col("to").alias("node")).distinct().join(found, ["ahead", "node"], "left_anti"))
        if step.isEmpty():
            break
        found = found.union(step)
    return found.groupBy("node").count().where("count = 2").select("node")


def condense(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst), all pairs of components of which one reaches the other, and (node, component) of all nodes.

    Walks of doubled length, so a graph of n levels takes about log2(n) joins: with R
    the pairs within 2^k steps and S those of exactly 2^k, R grows by S followed by R,
    and S by S followed by itself. Nodes that reach each other become one at once,
    under the smaller name, so a cycle's pairs are not made for long. The cycles around
    the hub become one node before, as the walks through them are by far the most.
    """
    edges = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    members = written(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("component", F.col("node")))
    edges = written(edges)
    knot = written(_knot(edges))
    least = knot.agg(F.min("node")).first()[0]
    if least is not None:
        same = knot.where(F.col("node") != least).select(F.col("node").alias("src"), F.lit(least).cast(edges.schema["src"].dataType).alias("to"))
        members = written(_in_one(members, same))
        edges = written(_renamed(edges, same))
    reach, exact = edges.where("src <> dst"), edges
    pairs = reach.count()
    while True:
        behind = lambda x: x.select(F.col("src").alias("via"), F.col("dst").alias("to"))
        after = lambda x, y: x.join(behind(y), x["dst"] == F.col("via")).select("src", F.col("to").alias("dst")).distinct()
        more = written(reach.union(after(exact, reach).where("src <> dst")).distinct())
        exact = written(after(exact, exact))
        back = more.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        same = written(more.intersect(back).groupBy("src").agg(F.min("dst").alias("to")).where("to < src"))
        merged = not same.isEmpty()
        if merged:
            more, exact = (written(_renamed(x, same)) for x in (more, exact))
            more = more.where("src <> dst")
            members = written(_in_one(members, same))
        now = more.count()
        reach = more
        if now == pairs and not merged:
            return reach, members
        pairs = now


def _in_one(members: DataFrame, same: DataFrame) -> DataFrame:
    return members.join(same, members["component"] == same["src"], "left").select("node", F.coalesce("to", "component").alias("component"))


def _renamed(pairs: DataFrame, names: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        to = names.select(F.col("src").alias(end), "to")
        pairs = pairs.join(to, end, "left").withColumn(end, F.coalesce("to", end)).select("src", "dst")
    return pairs.distinct()


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of all nodes that roots(root) reach at any depth, but not themselves."""
    reach, members = condense(edges)
    own = roots.select("root").distinct().join(members, F.col("root") == F.col("node")).select("root", "component")
    far = own.join(reach, own["component"] == reach["src"]).select("root", F.col("dst").alias("component"))
    # a root meets a component once, and a component a node; the parts keep a large component out of one task
    parts = F.explode(F.sequence(F.lit(0), F.lit(MEMBER_PARTS - 1))).alias("part")
    dealt = members.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(MEMBER_PARTS)).cast("int"))
    return far.union(own).select("root", "component", parts).repartition(MEMBER_PARTS, "root", "part").join(dealt, ["component", "part"]).select("root", "node").where("root <> node")


def granular(calls: DataFrame) -> DataFrame:
    """(module, dep, functions): the distinct functions that a module uses of each other module."""
    outside = calls.where(F.col("target") != F.col("caller_module"))
    name = F.concat("callee", F.lit("/"), F.col("arity").cast("string"))
    return outside.groupBy(F.col("caller_module").alias("module"), F.col("target").alias("dep")).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("functions"))


def internal_external(calls: DataFrame) -> DataFrame:
    """Calls inside the own module and to others, by module."""
    inside = F.col("target") == F.col("caller_module")
    return calls.groupBy(F.col("caller_module").alias("module")).agg(F.count_if(inside).alias("internal"), F.count_if(~inside).alias("external"))
