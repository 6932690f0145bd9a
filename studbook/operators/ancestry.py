"""Ancestor expansion and inbreeding over a whole parent graph at once.

A path from a root is the sequence of parent edges taken, sire = 0 and dam = 1. It is held as the
number `bits` with its length `gen`. Two paths to one ancestor compare as text through `path_key`:
the bits aligned to the left end of a 57-bit field, then the length. Within the generation bound, at most
19 edges, keys are plain bigints, so grouping stays in hash aggregates and shuffles carry three numbers per
row. First paths can be longer than the bound: they are held as texts of 0 and 1 in the same order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import stack_rows
from ..session import settle

MAX_PATH = 57
LENGTH_BITS = 6
# Up to this depth every path is expanded at once; beyond it, each level keeps one path per ancestor.
ALL_PATHS_DEPTH = 4


def path_key(bits: Column, gen: Column) -> Column:
    aligned = F.call_function("shiftleft", bits, (F.lit(MAX_PATH) - gen).cast("int"))
    return F.shiftleft(aligned, LENGTH_BITS).bitwiseOR(gen.cast("bigint"))


def key_length(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)).cast("int")


def key_bits(key: Column) -> Column:
    aligned = F.shiftright(key, LENGTH_BITS)
    return F.call_function("shiftright", aligned, (F.lit(MAX_PATH) - key_length(key)).cast("int"))


def key_text(key: Column) -> Column:
    """The path of a key as a text of 0 and 1, which compares like the key and has no longest length."""
    return F.call_function("lpad", F.bin(key_bits(key)), key_length(key), F.lit("0"))


def path_text(bits: Column, gen: Column) -> Column:
    """`SD` for the sire's dam, the empty string for the root."""
    digits = F.call_function("lpad", F.bin(bits), gen.cast("int"), F.lit("0"))
    return F.when(gen == 0, "").otherwise(F.translate(digits, "01", "SD"))


def parent_edges(dogs: DataFrame) -> DataFrame:
    """(child, letter, parent) for every parent that exists as a row. Carries three columns only."""
    long = dogs.select(
        F.col("id").alias("child"),
        stack_rows(
            ["letter", "parent"],
            (F.lit(0).cast("bigint"), F.col("sire_id")), (F.lit(1).cast("bigint"), F.col("dam_id")),
        ),
    ).filter("parent is not null")
    return long.join(dogs.select(F.col("id").alias("parent")), "parent", "left_semi")


def _start(edges: DataFrame, roots: DataFrame | None) -> DataFrame:
    first = edges.select(F.col("child").alias("root"), F.col("parent").alias("node"), F.col("letter").alias("bits"))
    if roots is not None:
        first = first.join(roots.select(F.col("id").alias("root")), "root", "left_semi")
    return first.withColumn("gen", F.lit(1))


def _extend(paths: DataFrame, tails: DataFrame) -> DataFrame:
    """Join paths ending at an animal with the paths starting there."""
    tail = tails.select(
        F.col("root").alias("node"), F.col("node").alias("end"), F.col("bits").alias("tail_bits"), F.col("gen").alias("tail_gen")
    )
    joined = paths.alias("p").join(tail.alias("t"), "node")
    bits = F.call_function("shiftleft", F.col("bits"), F.col("tail_gen")).bitwiseOR(F.col("tail_bits"))
    return joined.select("root", F.col("end").alias("node"), bits.alias("bits"), (F.col("gen") + F.col("tail_gen")).alias("gen"))


def ancestor_paths(edges: DataFrame, depth: int, roots: DataFrame | None = None) -> DataFrame:
    """Every path of 1..depth edges as (root, node, bits, gen).

    For the whole table path lengths double with each join: lengths up to 2 joined to lengths up to 2
    give up to 4, so depth 7 takes three joins instead of six. With chosen roots the expansion goes
    level by level, because only their ancestors are wanted.
    """
    if depth < 1:
        return _start(edges, roots).filter(F.lit(False))
    if roots is not None:
        step = _start(edges, None)
        levels = [_start(edges, roots)]
        for _ in range(depth - 1):
            levels.append(_extend(levels[-1], step))
        return reduce(DataFrame.unionByName, levels)
    known, reach = _start(edges, None), 1
    longest = known
    while reach < depth:
        tails = known.filter(F.col("gen") <= depth - reach)
        grown = _extend(longest, tails)
        known = known.unionByName(grown)
        reach = min(2 * reach, depth)
        longest = grown.filter(F.col("gen") == reach)
    return known


def with_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Add each root as its own generation 0."""
    own = roots.select(
        F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).cast("bigint").alias("bits"), F.lit(0).alias("gen")
    )
    return own.unionByName(paths)


def lineage_tree(dogs: DataFrame, generations: int = 5, ids: DataFrame | None = None, max_generations: int = 8) -> DataFrame:
    """Ancestors over `generations` levels, the root included: (root, path, gen, all columns of the ancestor).

    A repeated ancestor appears once per path.
    """
    if not 1 <= generations <= max_generations:
        raise ValueError(f"generations lies in 1..{max_generations}")
    roots = dogs.select("id") if ids is None else dogs.select("id").join(ids.select("id"), "id", "left_semi")
    paths = ancestor_paths(parent_edges(dogs), generations - 1, None if ids is None else roots)
    tree = with_roots(paths, roots)
    return tree.join(dogs.withColumnRenamed("id", "node"), "node").withColumn("path", path_text(F.col("bits"), F.col("gen")))


def lineage_tree_by_uuid(dogs: DataFrame, uuids: DataFrame, generations: int = 5) -> DataFrame:
    ids = dogs.select("id", "uuid").join(uuids.select("uuid"), "uuid", "left_semi").select("id")
    return lineage_tree(dogs, generations, ids)


def lineage_list(dogs: DataFrame, generations: int = 5, ids: DataFrame | None = None) -> DataFrame:
    """Flat list with the position as text (`dam.sire`); `preorder` sorts a root's rows dam first."""
    tree = lineage_tree(dogs, generations, ids)
    position = F.replace(F.replace(F.regexp_replace("path", "(?<=.)(?=.)", "."), F.lit("S"), F.lit("sire")), F.lit("D"), F.lit("dam"))
    return tree.withColumn("position", position).withColumn("preorder", F.translate("path", "DS", "01"))


def lineage_nodes(dogs: DataFrame, generations: int = 5, ids: DataFrame | None = None) -> DataFrame:
    """Distinct animals per root with the smallest generation at which each appears."""
    roots = dogs.select("id") if ids is None else dogs.select("id").join(ids.select("id"), "id", "left_semi")
    paths = ancestor_paths(parent_edges(dogs), generations - 1, None if ids is None else roots)
    return with_roots(paths, roots).groupBy("root", "node").agg(F.min("gen").alias("gen"))


def lineage_members(dogs: DataFrame, generations: int = 5, ids: DataFrame | None = None) -> DataFrame:
    """Distinct animals over all trees, as `id`. Each level keeps every animal once, whatever root it came from."""
    if ids is None:
        return dogs.select("id")
    level = dogs.select("id").join(ids.select("id"), "id", "left_semi")
    up = parent_edges(dogs).select(F.col("child").alias("id"), "parent")
    levels = [level]
    for _ in range(generations - 1):
        level = level.alias("l").join(up.alias("u"), "id").select(F.col("parent").alias("id")).distinct()
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).distinct()


def lineage_graph(dogs: DataFrame, generations: int = 5, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with a label and edges among the collected nodes, per root, for drawing."""
    nodes = lineage_nodes(dogs, generations, ids)
    born = F.coalesce(F.date_format("date_of_birth", "yyyy-MM-dd"), F.lit(""))
    label = F.concat_ws("\n", F.coalesce("registered_name", F.lit("")), F.concat(F.lit("ID: "), F.col("node").cast("string")),
                        F.concat(F.lit("Sex: "), F.when(F.col("sex") == 1, "M").otherwise("F")), F.concat(F.lit("Born: "), born))
    facts = dogs.select(F.col("id").alias("node"), "registered_name", "sex", "date_of_birth")
    labelled = nodes.join(facts, "node").select("root", "node", label.alias("label"))
    up = parent_edges(dogs).select(F.col("child").alias("node"), "parent", F.when(F.col("letter") == 0, "sire").otherwise("dam").alias("label"))
    drawn = (
        nodes.select("root", "node").join(up, "node")
        .join(nodes.select("root", F.col("node").alias("parent")), ["root", "parent"], "left_semi")
        .select("root", F.col("parent").alias("from_id"), F.col("node").alias("to_id"), "label")
    )
    return labelled, drawn


# So many small tables of improved paths are folded into one.
FOLD = 8

# Rows below hold one line per (root, node) with a key for each side: `s_` over the sire, `d_` over the dam.
SIDES = {"s": 0, "d": 1}


def _collapse(paths: DataFrame, depth: int) -> DataFrame:
    """Per (root, node): the largest path key, and per side the smallest key and the smallest of exactly `depth` edges."""
    key = path_key(F.col("bits"), F.col("gen"))
    side = F.call_function("shiftright", F.col("bits"), (F.col("gen") - 1).cast("int"))
    keyed = paths.select("root", "node", key.alias("key"), side.alias("side"), (F.col("gen") == depth).alias("at_end"))
    lows = [F.min(F.when(F.col("side") == code, F.col("key"))).alias(f"{name}_low") for name, code in SIDES.items()]
    ends = [F.min(F.when((F.col("side") == code) & F.col("at_end"), F.col("key"))).alias(f"{name}_end") for name, code in SIDES.items()]
    return keyed.groupBy("root", "node").agg(*lows, *ends, F.max("key").alias("high"), F.max(F.when(F.col("at_end"), F.col("key"))).alias("high_end"))


def _longer(key: Column) -> Column:
    """The key with the joined edge's letter appended: the length grows by one and the letter takes the next bit."""
    place = (F.lit(MAX_PATH - 1 + LENGTH_BITS) - key_length(key)).cast("int")
    return (key + 1).bitwiseOR(F.call_function("shiftleft", F.col("letter"), place))


def _longer_text(key: Column) -> Column:
    return F.concat(key, F.col("letter").cast("string"))


def _climb(rows: DataFrame, edges: DataFrame, keys: list[str], longer: Callable[[Column], Column] = _longer) -> DataFrame:
    """Each row moved on to both parents, every key longer by that edge. Keys of equal length keep their order."""
    up = edges.select(F.col("child").alias("node"), "letter", "parent")
    joined = rows.alias("r").join(up.alias("e"), "node")
    return joined.select("root", F.col("parent").alias("node"), *[longer(F.col(k)).alias(k) for k in keys])


def bounded_levels(edges: DataFrame, generations: int, roots: DataFrame | None = None) -> DataFrame:
    """Ancestors within generations - 1 edges as (root, node, s_low, d_low, s_end, d_end, high).

    The `end` keys are the smallest paths of full length, null where the animal is only met earlier. Depth
    up to ALL_PATHS_DEPTH is one lazy plan with one grouping. Deeper levels keep one row per (root, node)
    and are written out, so the plan and the row count stay in step with distinct ancestors.
    """
    depth = generations - 1
    shallow = min(depth, ALL_PATHS_DEPTH)
    rows = _collapse(ancestor_paths(edges, shallow, roots), shallow)
    if depth == shallow:
        return rows.drop("high_end")
    rows = settle(rows)
    none = F.lit(None).cast("bigint")
    last = rows.filter("high_end is not null").select(
        "root", "node", F.col("s_end").alias("s_low"), F.col("d_end").alias("d_low"), F.col("high_end").alias("high"))
    levels = [rows.select("root", "node", "s_low", "d_low", none.alias("s_end"), none.alias("d_end"), "high")]
    for level in range(shallow, depth):
        last = settle(_climb(last, edges, ["s_low", "d_low", "high"]).groupBy("root", "node").agg(
            F.min("s_low").alias("s_low"), F.min("d_low").alias("d_low"), F.max("high").alias("high")))
        final = level == depth - 1
        levels.append(last.select("root", "node", "s_low", "d_low", (F.col("s_low") if final else none).alias("s_end"),
                                  (F.col("d_low") if final else none).alias("d_end"), "high"))
    return reduce(DataFrame.unionByName, levels).groupBy("root", "node").agg(
        *[F.min(c).alias(c) for c in ("s_low", "d_low", "s_end", "d_end")], F.max("high").alias("high"))


def lineage_bounded_set(dogs: DataFrame, generations: int = 5, ids: DataFrame | None = None) -> DataFrame:
    """Animals within generations - 1 edges of each root, with the depth of the last depth-first visit."""
    _check_generations(generations)
    roots = dogs.select("id") if ids is None else dogs.select("id").join(ids.select("id"), "id", "left_semi")
    edges = parent_edges(dogs)
    if generations - 1 > ALL_PATHS_DEPTH:
        edges = settle(edges)
    rows = bounded_levels(edges, generations, None if ids is None else roots)
    found = rows.select("root", "node", key_length(F.col("high")).alias("gen"))
    own = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("gen"))
    return own.unionByName(found)


def _check_generations(generations: int) -> None:
    if not 1 <= generations <= 20:
        raise ValueError("generations lies in 1..20")


def side_paths(dogs: DataFrame, generations: int = 5, ids: DataFrame | None = None) -> DataFrame:
    """First depth-first path from each root over its sire and over its dam to every ancestor in reach.

    Result: (root, node, s_low, d_low), paths as texts of 0 and 1 that are null where that side does not reach the node.
    Only animals within generations - 1 edges of the root take part, but a path among them may be longer
    than that. Such longer paths are grown round by round, and only where they reach a node on a new side
    or beat its path; a beaten path never leads to a first path, so the rounds die out. Where wrong data
    forms a cycle, a path that comes round again starts with the path it would have to beat and ends there.

    A round groups only the pairs it has reached and looks those up, so a late round costs little more than its rows.
    """
    _check_generations(generations)
    edges = settle(parent_edges(dogs))
    roots = None if ids is None else dogs.select("id").join(ids.select("id"), "id", "left_semi")
    keys = ["s_low", "d_low", "s_end", "d_end"]
    base = settle(bounded_levels(edges, generations, roots).select("root", "node", *[key_text(F.col(k)).alias(k) for k in keys]))
    known = base.select("root", "node", "s_low", "d_low")
    frontier = base.filter("s_end is not null or d_end is not null").select(
        "root", "node", F.col("s_end").alias("s_low"), F.col("d_end").alias("d_low"))
    better: list[DataFrame] = []
    while True:
        frontier = settle(_one_longer([known, *better], frontier, edges))
        if frontier.isEmpty():
            break
        better.append(frontier)
        if len(better) == FOLD:
            better = [settle(_least_paths(better))]
    if not better:
        return known
    late = settle(_least_paths(better)).withColumnsRenamed({"s_low": "s_late", "d_low": "d_late"})
    return known.join(late, ["root", "node"], "left").select(
        "root", "node", *[F.least(f"{k}_low", f"{k}_late").alias(f"{k}_low") for k in SIDES])


def _least_paths(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("root", "node").agg(F.min("s_low").alias("s_low"), F.min("d_low").alias("d_low"))


def _one_longer(known: list[DataFrame], frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of `known` that a frontier path reaches on a new side or by a smaller path, with those paths."""
    grown = _climb(frontier, edges, ["s_low", "d_low"], _longer_text)
    new = settle(grown.groupBy("root", "node").agg(F.min("s_low").alias("s_new"), F.min("d_low").alias("d_new")))
    # Written first, so the lookup knows the size of what was reached.
    met = reduce(DataFrame.unionByName, [table.join(new, ["root", "node"]) for table in known])
    least = met.groupBy("root", "node").agg(*[F.min(c).alias(c) for c in ("s_low", "d_low", "s_new", "d_new")])
    changed = [
        F.when(F.coalesce(F.col(f"{k}_new") < F.col(f"{k}_low"), F.col(f"{k}_low").isNull()), F.col(f"{k}_new")).alias(f"{k}_low")
        for k in SIDES
    ]
    return least.select("root", "node", *changed).filter("s_low is not null or d_low is not null")


def _long_sides(paths: DataFrame) -> DataFrame:
    """One row per (root, side, node) with its key."""
    long = paths.select("root", "node", stack_rows(
        ["side", "low"], (F.lit("sire"), F.col("s_low")), (F.lit("dam"), F.col("d_low"))))
    return long.filter("low is not null")


def _shared(paths: DataFrame) -> DataFrame:
    """Ancestors reached on both sides."""
    return paths.filter("s_low is not null and d_low is not null")


def lineage_closure(paths: DataFrame) -> DataFrame:
    """Ancestor set on each side of each root, the parent itself included: (root, side, node)."""
    return _long_sides(paths).select("root", "side", "node")


def lineage_first_path(paths: DataFrame) -> DataFrame:
    """(root, side, node, path, steps); the path starts with the parent's own letter, steps counts from the parent."""
    text = F.translate("low", "01", "SD")
    return _long_sides(paths).select("root", "side", "node", text.alias("path"), (F.length("low") - 1).alias("steps"))


def common_ancestors(paths: DataFrame, bounded: DataFrame, dogs: DataFrame) -> DataFrame:
    """Animals on both sides of a root, with name and generation."""
    names = dogs.select(F.col("id").alias("node"), "registered_name")
    return _shared(paths).select("root", "node").join(bounded, ["root", "node"]).join(names, "node")


def contributions(paths: DataFrame, dogs: DataFrame) -> DataFrame:
    """0.5 ^ (n1 + n2 + 1) * (1 + Fa) per common ancestor."""
    facts = dogs.select(
        F.col("id").alias("node"), F.col("registered_name").alias("ancestor_name"), F.coalesce("coi", F.lit(0.0)).alias("ancestor_coi")
    )
    n1, n2 = F.length("s_low") - 1, F.length("d_low") - 1
    share = F.pow(F.lit(0.5), (n1 + n2 + 1).cast("double")) * (1 + F.col("ancestor_coi"))
    return _shared(paths).join(facts, "node").select(
        "root", "node", "ancestor_name", n1.alias("generations_to_sire"), n2.alias("generations_to_dam"),
        "ancestor_coi", share.alias("contribution"), "s_low", "d_low",
    )


def inbreeding_from(paths: DataFrame, dogs: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per root; 0 when a parent is missing or the sides share nobody."""
    total = contributions(paths, dogs).groupBy("root").agg(
        F.sum("contribution").alias("coi"), F.count("*").alias("common_ancestors")
    )
    return (
        roots.select(F.col("id").alias("root")).join(total, "root", "left")
        .select("root", F.coalesce("coi", F.lit(0.0)).alias("coi"), F.coalesce("common_ancestors", F.lit(0)).alias("common_ancestors"))
    )


def inbreeding(dogs: DataFrame, generations: int = 10, ids: DataFrame | None = None) -> DataFrame:
    """Inbreeding coefficient by first paths, for all given roots in one plan and without a cap on their number."""
    roots = dogs.select("id") if ids is None else dogs.select("id").join(ids.select("id"), "id", "left_semi")
    return inbreeding_from(side_paths(dogs, generations, ids), dogs, roots)


def touched_by(dogs: DataFrame, changed: DataFrame) -> DataFrame:
    """(id): the changed animals and all their descendants, walked down the reversed parent edges.

    `dogs` is the table after the change. An animal whose old ancestry held a changed one is among them as well: on its way
    up to the nearest changed animal no edge has changed. A first path may be longer than the generation bound, so the walk
    has no bound. Each round joins the animals just reached with the edges, three columns wide.
    """
    links = settle(parent_edges(dogs).select(F.col("parent").alias("url"), F.col("child").alias("link")))
    seeds = dogs.select("id").join(changed.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("url"))
    return crawl_frontier(links, seeds, 1 << 30).select(F.col("url").alias("id"))


def inbreeding_after_changes(dogs: DataFrame, changed: DataFrame, generations: int = 10) -> DataFrame:
    """Coefficients of the animals that changes of parents, or of stored coefficients, can have altered; all others keep theirs."""
    return inbreeding(dogs, generations, touched_by(dogs, changed))


def inbreeding_details(paths: DataFrame, dogs: DataFrame) -> DataFrame:
    """Contribution rows with both paths as id lists, from the parent to the ancestor.

    Each prefix of a first path is the first path to the animal it ends at, so the ids come from a join
    of the prefixes with the same table; a list is as long as its path.
    """
    rows = contributions(paths, dogs)
    tails = rows.select("root", "node", stack_rows(
        ["kind", "full_key"], (F.lit("sire_path"), F.col("s_low")), (F.lit("dam_path"), F.col("d_low")),
    ))
    prefixes = tails.select("root", "node", "kind", "full_key", F.explode(F.sequence(F.lit(1), F.length("full_key"))).alias("step"))
    wanted = prefixes.select("root", "node", "kind", "step", F.col("full_key").substr(F.lit(1), F.col("step")).alias("low"))
    stops = _long_sides(paths).select("root", "low", F.col("node").alias("stop"))
    lists = wanted.join(stops, ["root", "low"]).groupBy("root", "node").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("step", "stop")))).alias(kind)
        for kind in ("sire_path", "dam_path")
    ])
    ids = [F.transform(kind, lambda s: s["stop"]).alias(kind) for kind in ("sire_path", "dam_path")]
    return rows.drop("s_low", "d_low").join(lists.select("root", "node", *ids), ["root", "node"])


def inbreeding_batch(dogs: DataFrame, ids: DataFrame, generations: int = 10) -> DataFrame:
    """Requested ids with success and value; an id that is not in the registry fails."""
    requested = ids.select(F.col("id").alias("root")).distinct()
    done = inbreeding(dogs, generations, ids).withColumn("success", F.lit(True))
    return requested.join(done, "root", "left").withColumn("success", F.coalesce("success", F.lit(False)))


def inbreeding_writeback(dogs: DataFrame, values: DataFrame, as_of: Column) -> DataFrame:
    """Registry with new coefficients and their date on the computed roots."""
    new = values.groupBy(F.col("root").alias("id")).agg(F.max("coi").alias("new_coi"))
    stamped = F.when(F.col("new_coi").isNotNull(), as_of)
    if "coi_updated_on" in dogs.columns:
        stamped = F.coalesce(stamped, F.col("coi_updated_on"))
    return (
        dogs.join(new, "id", "left")
        .withColumn("coi_updated_on", stamped)
        .withColumn("coi", F.coalesce("new_coi", "coi"))
        .drop("new_coi")
    )


def inbreeding_read(dogs: DataFrame) -> DataFrame:
    """Stored value, percentage (null for 0 or null) and whether a value exists."""
    return dogs.select(
        "id", "registered_name", "coi", (F.nullif(F.col("coi"), F.lit(0.0)) * 100).alias("coi_percentage"),
        F.col("coi").isNotNull().alias("has_coi"),
    )


def crawl_frontier(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Pages reachable from the seeds over (url, link) rows, each once, with its distance."""
    level = settle(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    seen = level
    steps = links.select(F.col("url").alias("url"), "link")
    for distance in range(1, depth + 1):
        following = level.join(steps, "url").select(F.col("link").alias("url")).distinct()
        level = settle(following.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(distance)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
