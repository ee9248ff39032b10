"""The entity graph: nodes, edges, neighbourhoods, paths and correlated events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.storage import stored

from .entities import SPECS, labelled

#: Column of an event, label of its node.
CORE = (("hostname", "Host"), ("process", "Process"), ("component", "Component"), ("source_type", "SourceType"), ("severity", "Severity"), ("day", "Day"))
#: Structural edges between core nodes.
CORE_EDGES = (("process", "RUNS_ON", "hostname"), ("hostname", "IS_TYPE", "source_type"), ("component", "PART_OF", "process"))
#: Edges from an event to its core nodes.
EVENT_EDGES = (("EMITTED", "hostname"), ("FROM_SOURCE", "source_type"), ("EMITTED_BY", "process"), ("FROM_COMPONENT", "component"), ("HAS_SEVERITY", "severity"), ("ON_DAY", "day"))
#: Edges between the first entities of two types in one event, or to its host.
DERIVED = (
    ("user", "ACCESSED", "@host"), ("user", "MEMBER_OF", "domain"), ("session", "BELONGS_TO", "user"), ("security_id", "IDENTIFIES", "user"), ("device", "ATTACHED_TO", "@host"),
    ("datastore", "MOUNTED_ON", "@host"), ("vm", "HOSTED_ON", "@host"), ("network_interface", "INTERFACE_OF", "@host"), ("mac_address", "ASSIGNED_TO", "network_interface"),
    ("package", "INSTALLED_ON", "@host"), ("systemd_unit", "MANAGED_ON", "@host"), ("apparmor_profile", "ENFORCED_ON", "@host"), ("task", "EXECUTED_ON", "@host"), ("executable", "RAN_ON", "@host"),
    ("operation", "SEEN_ON", "@host"), ("pod", "IN_NAMESPACE", "namespace"), ("pod", "OF_SERVICE", "k8s_service"), ("container", "RUNS_IN", "pod"), ("object_key", "STORED_IN", "bucket"),
)
CORRELATING = ("operation", "trace", "task")


def union(frames):
    return reduce(DataFrame.unionByName, frames)


def nodes(log: DataFrame, m: DataFrame) -> DataFrame:
    """Core and entity nodes with the first and last time they were seen.

    All core nodes come from one pass: an event is exploded to its labels, and counted map-side.
    """
    core = log.select("timestamp", F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.col(c).alias("value")) for c, label in CORE))).alias("n")).select("n.*", "timestamp").where("value is not null")
    named = labelled(m).join(log.select(F.col("id").alias("log_id"), "timestamp"), "log_id").select("label", "value", "timestamp")
    return core.unionByName(named).groupBy("label", "value").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def named(log: DataFrame) -> DataFrame:
    """Different nodes (label, value) of events with ``entities``, as ``nodes`` has them: an event gives its own, and none is joined."""
    core = F.array(*(F.struct(F.lit(label).alias("label"), F.col(c).alias("value")) for c, label in CORE))
    label_of = F.create_map(*(F.lit(x) for kind, label, _ in SPECS for x in (kind, label)))
    own = F.transform("entities", lambda e: F.struct(F.coalesce(F.try_element_at(label_of, e["type"]), F.lit("Entity")).alias("label"), e["value"].alias("value")))
    # as in the graph, an event without an id has no entities
    every = F.concat(core, F.when(F.col("id").isNotNull() & F.col("entities").isNotNull(), own).otherwise(F.array().cast("array<struct<label:string,value:string>>")))
    return log.select(F.explode(every).alias("n")).select("n.*").where("value is not null").distinct()


def event_edges(log: DataFrame, m: DataFrame) -> DataFrame:
    """Edges from events to core nodes and entities."""
    labels = dict(CORE)
    kinds = F.array(*(F.struct(F.lit(rel).alias("rel"), F.lit(labels[c]).alias("dst_label"), F.col(c).alias("dst")) for rel, c in EVENT_EDGES))
    core = log.select(F.col("id").alias("log_id"), F.explode(kinds).alias("e")).select("log_id", "e.*").where("dst is not null")
    return core.unionByName(labelled(m).select("log_id", "rel", F.col("label").alias("dst_label"), F.col("value").alias("dst")).distinct())


def types_of(rels: tuple[str, ...]) -> tuple[str, ...]:
    """Entity types that the derived ones of these edges come from."""
    return tuple(sorted({t for a, rel, b in DERIVED if rel in rels for t in (a, b) if t != "@host"}))


def edges(log: DataFrame, m: DataFrame | None = None, rels: tuple[str, ...] | None = None) -> DataFrame:
    """Structural edges, each once; of all relationships, or of those asked for alone. Without mentions ``m``, entities
    are those in the log's own column ``entities``: events are read once, and only different edges are moved."""
    of_core, of_entities = ([x for x in y if rels is None or x[1] in rels] for y in (CORE_EDGES, DERIVED))
    sound = "src is not null and dst is not null and not (src_label = dst_label and src = dst)"
    label = {t: x for t, x, _ in SPECS} | dict(CORE) | {"@host": "Host"}
    if m is None and of_entities:
        return _own_edges(log, of_core, of_entities, label).where(sound).distinct()

    def each(rows: DataFrame, rules: list[tuple[str, str, str]], value) -> DataFrame:
        kinds = (F.struct(F.lit(label[a]).alias("src_label"), value(a).alias("src"), F.lit(rel).alias("rel"), F.lit(label[b]).alias("dst_label"), value(b).alias("dst")) for a, rel, b in rules)
        return rows.select(F.explode(F.array(*kinds)).alias("e")).select("e.*").where(sound)

    core = each(log, of_core, F.col) if of_core else None
    if not of_entities:
        return core.distinct()
    kinds_of = {k for a, _, b in of_entities for k in (a, b)}
    one = m.where(F.col("type").isin(*kinds_of)).groupBy("log_id", "type").agg(F.min_by("value", "ord").alias("value"))
    firsts = one.groupBy("log_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "value"))).alias("first"))  # a value for each type
    firsts = firsts.join(log.select(F.col("id").alias("log_id"), "hostname"), "log_id")
    derived = each(firsts, of_entities, lambda t: F.col("hostname") if t == "@host" else F.try_element_at("first", F.lit(t)))
    return (derived if core is None else core.unionByName(derived)).distinct()


def _own_edges(log: DataFrame, of_core: list, of_entities: list, label: dict[str, str]) -> DataFrame:
    """The edges of each event with ``entities``. Only rules whose two types an event has make a row; the first value of a type counts."""
    at = {c: f"@{c}" for c, _ in CORE} | {"hostname": "@host"}  # no entity's type begins so
    rules = [(label[a], at[a], rel, label[b], at[b]) for a, rel, b in of_core] + [(label[a], a, rel, label[b], b) for a, rel, b in of_entities]
    every = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("src_label", "a", "rel", "dst_label", "b"), r, strict=True))) for r in rules))
    core = [c for c in at if any(at[c] in r for r in rules)]
    entities = lambda part: F.coalesce(F.col("entities")[part], F.array().cast("array<string>"))
    own = log.select(F.concat(F.array(*(F.lit(at[c]) for c in core)), entities("type")).alias("types"), F.concat(F.array(*core), entities("value")).alias("values"))
    fits = F.filter(every, lambda r: F.array_contains("types", r["a"]) & F.array_contains("types", r["b"]))
    # outer, as in ``mentions``
    rows = own.select("types", "values", F.explode_outer(fits).alias("r"))
    value = lambda end: F.get("values", F.array_position("types", F.col(f"r.{end}")).cast("int") - 1)
    return rows.select("r.src_label", value("a").alias("src"), "r.rel", "r.dst_label", value("b").alias("dst"))


def both_ways(e: DataFrame) -> DataFrame:
    """Each edge from both of its ends, in one pass."""
    ends = (("src", "dst"), ("dst", "src"))
    ways = (F.struct(F.col(f"{a}_label").alias("a_label"), F.col(a).alias("a"), "rel", F.col(f"{b}_label").alias("b_label"), F.col(b).alias("b")) for a, b in ends)
    return e.select(F.explode(F.array(*ways)).alias("w")).select("w.*")


def neighbours(e: DataFrame, label: str, value: str, hops: int = 2) -> DataFrame:
    """Nodes within ``hops`` (1 to 3) undirected steps and the least number of them.

    The edges, both ways, are stored once; each step joins the frontier to them, leaves out what has been reached, and is
    stored, so that no plan grows with the number of steps.
    """
    step, spark = stored(both_ways(e), "steps"), e.sparkSession
    reached = frontier = spark.createDataFrame([(label, value, 0)], "label string, value string, hop int")
    for hop in range(1, max(1, min(hops, 3)) + 1):
        ahead = step.join(frontier, (step["a_label"] == frontier["label"]) & (step["a"] == frontier["value"])).select(F.col("b_label").alias("label"), F.col("b").alias("value")).distinct()
        frontier = stored(ahead.join(reached, ["label", "value"], "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        reached = reached.unionByName(frontier)
    return reached.where("hop > 0")


def shortest_path(e: DataFrame, start: tuple[str, str], end: tuple[str, str], max_hops: int = 6) -> DataFrame:
    """The shortest undirected path, the first in order of its nodes, as nodes and relationships."""
    step = stored(both_ways(e), "steps")
    node = lambda label, value: F.concat_ws(":", label, value)
    frontier = e.sparkSession.createDataFrame([(*start, [":".join(start)], [])], "label string, value string, nodes array<string>, rels array<string>")
    seen = frontier.select("label", "value")
    goal = (F.col("label") == end[0]) & (F.col("value") == end[1])
    found = frontier.where(goal)
    for _ in range(max_hops):
        if not found.isEmpty():
            break
        ahead = step.join(frontier, (step["a_label"] == frontier["label"]) & (step["a"] == frontier["value"])).select(
            F.col("b_label").alias("label"), F.col("b").alias("value"), F.concat("nodes", F.array(node("b_label", "b"))).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels"))
        best = ahead.groupBy("label", "value").agg(F.min(F.struct("nodes", "rels")).alias("p")).select("label", "value", "p.nodes", "p.rels")
        frontier = stored(best.join(seen, ["label", "value"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier.select("label", "value"))
        found = frontier.where(goal)
    return found.select("nodes", "rels", F.size("rels").alias("hops"))


def resolve(n: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """Nodes of a name: exact ones, or those that hold it in any case if there are none. Each is the first few
    of a filter; only these few meet."""
    def first(rows: DataFrame, exact: bool) -> DataFrame:
        return rows.select("label", "value", F.lit(exact).alias("exact")).orderBy("label", "value").limit(limit)

    same = first(n.where(F.col("value") == name), True)
    alike = first(n.where(F.lower("value").contains(name.lower())), False)
    none = same.agg((F.count("*") == 0).alias("none"))
    return same.unionByName(alike.join(F.broadcast(none)).where("none").drop("none")).orderBy("label", "value")


def blast_radius(e: DataFrame, n: DataFrame, name: str, hops: int = 2) -> DataFrame:
    """What lies around the first node of a name."""
    first = resolve(n, name, 1).first()
    return neighbours(e, first["label"], first["value"], hops) if first else neighbours(e, "", "", 1)


def correlated(log: DataFrame, m: DataFrame, log_id: str, limit: int = 50) -> DataFrame:
    """Events that share an operation, trace or task with one event."""
    own = m.where((F.col("log_id") == log_id) & F.col("type").isin(*CORRELATING)).select("type", "value").distinct()
    others = m.where(F.col("log_id") != log_id).join(F.broadcast(own), ["type", "value"]).groupBy("log_id").agg(F.min("type").alias("via"))
    return log.join(others, log["id"] == others["log_id"]).select("id", "timestamp", "hostname", "message", "via").orderBy("timestamp", "id").limit(limit)


def related(log: DataFrame, m: DataFrame, seeds: DataFrame, limit: int = 20) -> DataFrame:
    """Events two steps from the seeds through any entity, the worst first, seeds left out."""
    ids = seeds.select(F.col("id").alias("log_id"))
    via = m.join(ids, "log_id", "left_semi").select("type", "value").distinct()
    hits = m.join(via, ["type", "value"]).join(ids, "log_id", "left_anti").groupBy("log_id").agg(F.min(F.struct("type", "value")).alias("via"))
    return log.join(hits, log["id"] == hits["log_id"]).select("id", "severity_score", "timestamp", F.col("via.type").alias("via_type"), F.col("via.value").alias("via_value")).orderBy("severity_score", "timestamp", "id").limit(limit)


def composition(n: DataFrame) -> DataFrame:
    """Nodes for each label."""
    return n.groupBy("label").agg(F.count("*").alias("nodes"))


def relationship_counts(e: DataFrame) -> DataFrame:
    """Edges for each type."""
    return e.groupBy("rel").agg(F.count("*").alias("edges"))


def schema_triples(e: DataFrame) -> DataFrame:
    """Which labels each relationship joins."""
    return e.groupBy("src_label", "rel", "dst_label").agg(F.count("*").alias("edges"))
