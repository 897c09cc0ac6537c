"""Hierarchies given as (child, parent) edges: closure, specificity, umbrellas, inheritance.

What lies above an item's terms is found block by block: a walk up from the blocks of items finds the part of the hierarchy above each block, every
node once a block, and the task of a block follows it for its items. So neither a closure nor the diamonds of an item's terms are ever shuffled.
Hierarchies of more than ``LEVELS`` levels are closed first, by doubling the length of ways. Each round is written to the checkpoint folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.session import cut

LEVELS = 40  # rounds of a walk; a deeper hierarchy is closed by doubling
BLOCK_TERMS = 500_000  # memberships of a block of items


def _doubled(edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """id, ancestor for every proper ancestor, in about log2(depth) rounds.

    Every pair carries its distance. Round r finds the pairs at distance 2**(r-1) + 1 .. 2**r: those at exactly 2**(r-1) are extended by all
    pairs known so far, as every longer way passes such a pair; a hierarchy of depth d needs about log2(d) rounds, each one job.
    """
    known = cut(edges.where("child <> parent").select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("d")).distinct())
    front, reach = known, 1
    while not front.isEmpty():
        if max_depth == 0:
            raise ValueError("hierarchy too deep")
        step = known.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("d").alias("more"))
        longer = (front.join(step, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("more") + reach).alias("d")).where("id <> ancestor")
                  .groupBy("id", "ancestor").agg(F.min("d").alias("d")))
        new = cut(longer.join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        known, reach = known.unionByName(new), 2 * reach
        front = new.where(F.col("d") == reach)
        max_depth //= 2
    return known.select("id", "ancestor")


def _walk(starts: DataFrame, steps: DataFrame, by: str, rounds: int | None = None) -> DataFrame | None:
    """by, node reached from ``starts`` (by, node) along ``steps`` (node, to), starts included; None after more than ``rounds`` rounds.

    Both joins are merge joins: what a round has found is never sent to the driver, as a broadcast would.
    """
    found = new = cut(starts.select(by, "node").distinct())
    steps = steps.where("node <> to").hint("merge")
    while not new.isEmpty():
        if rounds == 0:
            return None
        reached = new.join(steps, "node").select(by, F.col("to").alias("node")).distinct()
        new = cut(reached.join(found.hint("merge"), [by, "node"], "left_anti"))
        found = found.unionByName(new)
        rounds = None if rounds is None else rounds - 1
    return found


def _graph(child: np.ndarray, parent: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """The steps of nodes 0 .. n - 1 by child: child, parent, first and last step of a node, and which steps lie on or above a cycle."""
    by = np.argsort(child, kind="stable")
    child, parent = child[by], parent[by]
    begin, end = np.searchsorted(child, np.arange(n)), np.searchsorted(child, np.arange(n), side="right")
    on_cycle = np.ones(len(child), bool)  # peel off what nothing leads to, until only cycles and what lies above them remain
    while on_cycle.any():
        stays = on_cycle & (np.bincount(parent[on_cycle], minlength=n) > 0)[child]
        if stays.sum() == on_cycle.sum():
            break
        on_cycle = stays
    return child, parent, begin, end, on_cycle


CELLS = 8_000_000  # sets by nodes that are marked at a time


def _lifted(held: np.ndarray, n: int, graph: tuple[np.ndarray, ...], lowest: bool) -> np.ndarray:
    """For sets of nodes as ascending numbers set * n + node: the sets with everything above their nodes, or, if ``lowest``, the nodes above no other one of their set.
    Large sets are marked in a table of some sets by all nodes, small ones are merged as sorted numbers."""
    first = np.flatnonzero(np.diff(held // n, prepend=-1))
    if len(held) < 32 * len(first):
        return _climbed(held, n, graph, lowest, False)
    ends = np.append(first, len(held))
    found, i, step = [], 0, max(1, CELLS // n)
    while i < len(first):
        to = int(np.searchsorted(held[first], (held[first[i]] // n + step) * n))
        part = held[ends[i]:ends[to]]
        low = part[0] // n * n
        found.append(low + _climbed(part - low, n, graph, lowest, True))
        i = to
    return np.concatenate(found)


def _climbed(held: np.ndarray, n: int, graph: tuple[np.ndarray, ...], lowest: bool, marked: bool) -> np.ndarray:
    _, parent, begin, end, on_cycle = graph
    if marked:
        seen = np.zeros((int(held[-1]) // n + 1) * n, bool)
        seen[held] = True
        over = np.zeros_like(seen) if lowest else None
    new, all_, above, reached = held, held, np.empty(0, np.int64), [held]
    while len(new):
        node = new % n
        many = end[node] - begin[node]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[node], many)
        up = np.repeat(new - node, many) + parent[at]
        if marked:
            if lowest:
                over[up] = True
            new = np.unique(up[~seen[up]])
            seen[new] = True
            reached.append(new)
            continue
        up = np.unique(up)
        if lowest:
            above = np.union1d(above, up[np.isin(up, held, assume_unique=True)])
        new = np.setdiff1d(up, all_, assume_unique=True)
        all_ = np.union1d(all_, new)
    if not lowest:
        return np.sort(np.concatenate(reached)) if marked else all_
    if marked:
        above = held[over[held]]
    if on_cycle.any() and len(above):  # a term on a cycle lies above itself, which does not count
        round_, over = set(parent[on_cycle].tolist()), {}
        mine = {}
        for x in held.tolist():
            mine.setdefault(x // n, []).append(x % n)
        for x in above.tolist():
            if x % n not in round_:
                continue
            for o in mine[x // n]:
                if o not in over:
                    over[o], todo = set(), [o]
                    while todo:
                        now = todo.pop()
                        more = set(parent[begin[now]:end[now]].tolist()) - over[o]
                        over[o] |= more
                        todo += more
            if not any(o != x % n and x % n in over[o] for o in mine[x // n]):
                above = above[above != x]
    return np.setdiff1d(held, above, assume_unique=True)


def _ways(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """at, child, parent: the steps above the nodes of every block. starts: block, node."""
    steps = edges.toDF("node", "to")
    found = _walk(starts, steps, "block", LEVELS)
    if found is None:
        steps = cut(_doubled(edges)).toDF("node", "to")
        found = _walk(starts, steps, "block")
    return found.join(steps.hint("merge"), "node").select(F.col("block").alias("at"), F.col("node").alias("child"), F.col("to").alias("parent"))


def _above(item_terms: DataFrame, edges: DataFrame, kept: str, lists: bool = False) -> DataFrame:
    """item, term. ``kept``: 'all' for an item's terms with everything above them, 'lowest' for its terms that lie above no other of its terms.
    With ``lists`` one row per item: item, terms."""
    edges = edges.toDF("child", "parent").where("child <> parent").distinct()
    own = item_terms.groupBy("item").agg(F.collect_set("term").alias("terms"))
    n = item_terms.count()
    blocks = max(1, -(-n // BLOCK_TERMS), min(12, n // 20_000))
    own = cut(own.repartitionByRange(blocks, "item").withColumn("block", F.spark_partition_id()))
    ways = _ways(own.select("block", F.explode("terms").alias("node")), edges)
    kind = item_terms.schema["term"].dataType
    out = T.StructType([T.StructField("item", item_terms.schema["item"].dataType), T.StructField("terms", T.ArrayType(kind)) if lists else T.StructField("term", kind)])

    def judge(own: pa.Table, ways: pa.Table) -> pa.Table:
        of = own.schema.field("terms").type.value_type
        if not len(own):
            return pa.table({"item": pa.array([], own.schema.field("item").type), out.names[1]: pa.array([], pa.list_(of) if lists else of)})
        held = own["terms"].combine_chunks()
        size = np.diff(held.offsets.to_numpy())
        first = np.concatenate([[0], np.cumsum(size)])
        terms = held.flatten()
        names = pa.concat_arrays([terms, *(x.cast(terms.type) for c in ("child", "parent") for x in ways[c].chunks)]).dictionary_encode()
        code = names.indices.to_numpy().astype(np.int64)
        term, child, parent = code[:len(terms)], code[len(terms):len(terms) + len(ways)], code[len(terms) + len(ways):]
        n = len(names.dictionary)
        graph = _graph(child, parent, n)
        line, items, found, i = np.repeat(np.arange(len(size)), size), [], [], 0
        while i < len(size):  # some items at a time: about 50,000 terms
            to = max(i + 1, int(np.searchsorted(first, first[i] + 50_000, side="right")) - 1)
            all_ = _lifted(np.unique((line[first[i]:first[to]] - i) * n + term[first[i]:first[to]]), n, graph, kept == "lowest")
            items.append(i + all_ // n)
            found.append((all_ % n).astype(np.int32))
            i = to
        items, found = np.concatenate(items), names.dictionary.take(pa.array(np.concatenate(found)))
        if lists:
            begin = np.flatnonzero(np.diff(items, prepend=-1))
            return pa.table([own["item"].combine_chunks().take(pa.array(items[begin])), pa.ListArray.from_arrays(pa.array(np.append(begin, len(items)), pa.int32()), found)], out.names)
        return pa.table([own["item"].combine_chunks().take(pa.array(items)), found], out.names)
    # a block's task is as long as its terms, however few bytes they are: not merged with others
    return own.repartition(blocks, "block").groupBy("block").cogroup(ways.repartition(blocks, "at").groupBy("at")).applyInArrow(judge, out)


def strict_closure(edges: DataFrame) -> DataFrame:
    """id, ancestor for every proper ancestor."""
    nodes = edges.select(F.col("child").alias("item"), F.col("child").alias("term")).distinct()
    return _above(nodes, edges.select("child", "parent"), "all").where("item <> term").select(F.col("item").alias("id"), F.col("term").alias("ancestor"))


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id, ancestor for the nodes below each of a few roots (column ancestor), roots included: a walk down from them, not a closure."""
    down = edges.select(F.col("parent").alias("node"), F.col("child").alias("to"))
    return _walk(roots.select("ancestor", F.col("ancestor").alias("node")), down, "ancestor").select(F.col("node").alias("id"), "ancestor")


def closure(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, ancestor including each node itself; ``ids`` (column id) adds nodes without edges."""
    nodes = edges.select(F.col("child").alias("id")).unionByName(edges.select(F.col("parent").alias("id")))
    if ids is not None:
        nodes = nodes.unionByName(ids.select("id"))
    return strict_closure(edges).unionByName(nodes.distinct().select("id", F.col("id").alias("ancestor")))


def descendant_counts(above: DataFrame) -> DataFrame:
    """ancestor, n_below from the strict closure."""
    return above.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_below"))


def under_root(edges: DataFrame, root) -> DataFrame:
    """Nodes that have ``root`` among their ancestors, without the root itself."""
    start = edges.sparkSession.range(1).select(F.lit(root).alias("ancestor"))
    return descendants(edges, start).where(F.col("id") != F.lit(root)).select("id")


def expand_terms(item_terms: DataFrame, edges: DataFrame, lists: bool = False) -> DataFrame:
    """Each item's terms with all their ancestors: item, term, or with ``lists`` one row per item: item, terms. edges: child, parent; a closure does as well."""
    return _above(item_terms, edges, "all", lists)


def most_specific(item_terms: DataFrame, edges: DataFrame) -> DataFrame:
    """Drop every term that is a proper ancestor of another term of the same item. edges: child, parent; a closure does as well."""
    return _above(item_terms, edges, "lowest")


def umbrella_pairs(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """umbrella, below: a candidate (disease, gene) whose descendant candidate shares one of its genes. edges: child, parent; a closure does as well."""
    pairs = candidates.select("disease", "gene").where("gene IS NOT NULL").distinct()
    lifted = _above(pairs.select(F.struct("disease", "gene").alias("item"), F.col("disease").alias("term")), edges, "all")
    return (lifted.select(F.col("item.disease").alias("below"), F.col("item.gene").alias("gene"), F.col("term").alias("disease")).where("below <> disease")
            .join(pairs.hint("merge"), ["disease", "gene"], "left_semi").select(F.col("disease").alias("umbrella"), "below").distinct())


def split_entities(links: DataFrame, term_counts: DataFrame | None = None) -> DataFrame:
    """Gene-defined entities from candidate links (disease, gene, strong).

    A disease with one gene is an entity; a gene with no entity of its own gets one split out of its most specific
    multi-gene disease with strong evidence: fewest genes, then most recorded terms, then smallest id.
    Returns id, disease, gene, synthetic.
    """
    sizes = links.groupBy("disease").agg(F.countDistinct("gene").alias("n_genes"))
    sized = links.join(sizes, "disease")
    single = sized.where("n_genes = 1").select("disease", "gene").distinct()
    if term_counts is not None:
        sized = sized.join(term_counts, "disease", "left")
        richness = -F.coalesce(F.col("n_terms"), F.lit(0))
    else:
        richness = F.lit(0)
    options = (sized.where("n_genes > 1 AND strong")
               .join(single.select("gene").distinct(), "gene", "left_anti")
               .groupBy("gene").agg(F.min(F.struct("n_genes", richness.alias("richness"), "disease")).alias("best")))
    return (single.select(F.col("disease").cast("string").alias("id"), "disease", "gene", F.lit(False).alias("synthetic"))
            .unionByName(options.select(F.concat_ws("-", F.col("best.disease"), F.col("gene")).alias("id"),
                                        F.col("best.disease").alias("disease"), "gene", F.lit(True).alias("synthetic"))))


def inherit_terms(item_terms: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Terms that flow down: when a node has exactly one entity below it, that entity receives the node's terms it lacks.

    edges: child, parent; a closure does as well. Only the entities' own ancestors are looked up, and counted inside the tasks that find them.
    Returns item (the entity), term, via (the node; the smallest when several offer the term).
    """
    above = _above(entities.select("item", F.col("item").alias("term")), edges, "all").where("item <> term")
    only = above.groupBy(F.col("term").alias("ancestor")).agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("item")).where("n = 1")
    offered = (only.join(item_terms.select(F.col("item").alias("ancestor"), "term"), "ancestor")
               .groupBy("item", "term").agg(F.min("ancestor").alias("via")))
    return offered.join(item_terms, ["item", "term"], "left_anti")


def broader_profile(entities: DataFrame, edges: DataFrame, item_terms: DataFrame, below: DataFrame, ic: DataFrame,
                    min_terms: int = 3, max_below: int = 60, levels: int = 4, n: int = 20) -> DataFrame:
    """For entities without terms: the nearest broader node with a usable profile, and its n most informative terms.

    Nearest = fewest levels up (at most ``levels``), then smallest id. ``below`` is (ancestor, n_below).
    Returns item, source, depth, term, rank.
    """
    bare = entities.select("item").join(item_terms.select("item").distinct(), "item", "left_anti")
    usable = (item_terms.groupBy("item").agg(F.count(F.lit(1)).alias("n_terms")).where(F.col("n_terms") >= min_terms)
              .withColumnRenamed("item", "ancestor")
              .join(below, "ancestor", "left").where(F.coalesce("n_below", F.lit(0)) <= max_below)
              .select(F.col("ancestor").alias("source")))
    parents = edges.select(F.col("child").alias("node"), F.col("parent").alias("source")).distinct()
    frontier = bare.select("item", F.col("item").alias("node"))
    usable, found = cut(usable), None
    for depth in range(1, levels + 1):
        reached = cut(frontier.join(parents, "node").select("item", "source").distinct())
        hits = cut(reached.join(usable, "source").groupBy("item").agg(F.min("source").alias("source"))
                   .withColumn("depth", F.lit(depth)))
        found = hits if found is None else found.unionByName(hits)
        frontier = reached.join(hits.select("item"), "item", "left_anti").withColumnRenamed("source", "node")
    # a source's terms are ranked once, not again for every entity below it
    weight = (item_terms.join(ic.select("term", "ic"), "term", "left")
              .select(F.col("item").alias("source"), "term", F.coalesce("ic", F.lit(0.0)).alias("ic")).join(usable.hint("merge"), "source", "left_semi"))
    ranked = weight.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("ic"), "term"))).where(F.col("rank") <= n)
    lists = ranked.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("first"))
    return (found.join(lists.hint("merge"), "source").select("item", "source", "depth", F.explode("first").alias("t"))
            .select("item", "source", "depth", "t.term", "t.rank"))


def ancestor_groups(entities: DataFrame, above: DataFrame, low: int = 2, high: int = 800) -> DataFrame:
    """Groups = ancestors with low..high member entities; an entity counts in its own node only when synthetic.

    entities: item, node, synthetic. Returns grp, n_members, members (collected for groups within the bound only).
    """
    up = (entities.withColumnRenamed("node", "id").join(above, "id").select(F.col("ancestor").alias("grp"), "item")
          .unionByName(entities.where("synthetic").select(F.col("node").alias("grp"), "item")).distinct())
    kept = up.groupBy("grp").agg(F.count(F.lit(1)).alias("n_members")).where(F.col("n_members").between(low, high))
    return (up.join(kept, "grp").groupBy("grp", "n_members")
            .agg(F.array_sort(F.collect_list("item")).alias("members")))


def term_members(item_terms: DataFrame, low: int = 2, high: int = 300) -> DataFrame:
    """term, n_items, items for terms held by low..high items (counted first, listed only within the bound)."""
    kept = item_terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_items")).where(F.col("n_items").between(low, high))
    return (item_terms.join(kept, "term").groupBy("term", "n_items")
            .agg(F.array_sort(F.collect_list("item")).alias("items")))


def first_category(nodes: DataFrame, closed: DataFrame, categories: DataFrame) -> DataFrame:
    """node, category: the first category (lowest position) among the node's ancestors, else 'other'.

    categories: ancestor, name, position.
    """
    best = (closed.join(categories, "ancestor").groupBy("id")
            .agg(F.min_by("name", "position").alias("category")))
    return (nodes.select(F.col("node").alias("id")).join(best, "id", "left")
            .select(F.col("id").alias("node"), F.coalesce("category", F.lit("other")).alias("category")))
