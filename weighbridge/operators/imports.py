"""``@import`` graph: extract, resolve, join to the snapshot, close, claim.

Semantics (per repository): a discovered context file's import tree folds in
every *non-context* file reachable through ``@path`` lines, transitively and
cycle-safe, never re-entering the start file; an import that resolves to
another context file is not folded and not followed. A folded file is paid for
once, by the first importer in path order. Specs whose target does not exist
are reported per start file, distinct by spec text, at any depth of its tree.

Scale: the content column is scanned once, narrowly (regex on files that
contain ``@``); everything after that joins and shuffles only short keys.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge import dims
from weighbridge.functions.paths import path_order, resolve_import
from weighbridge.functions.text import basename, line_count
from weighbridge.operators.classify import classify_kind, discoverable
from weighbridge.session import discard, materialize

# ---- fixed values: the import line syntax ------------------------------------
# An import starts its line (indent allowed): "@" + path ending in a markdown or
# text extension, in any case. The audited pattern ends in an ASCII word
# boundary; Java's \b is Unicode-aware, so the boundary is spelled out.
IMPORT_RE = r"(?im)^[ \t]*@([./\w-]+\.(?:markdown|mdx|mdc|md|txt|rst))(?![A-Za-z0-9_])"
IMPORTABLE_NAME = dims.IMPORTABLE_NAME


def _is_context_path(path) -> F.Column:
    return classify_kind(basename(path)).isNotNull() & discoverable(path)


def target_scope(files: DataFrame) -> DataFrame:
    """Files that can be import targets. A spec always ends in an importable
    extension, so on a snapshot partitioned by ``path_class`` only those
    partitions (plus context files) are listed."""
    if "path_class" in files.columns:
        return files.where(F.col("path_class").isin("context", "importable"))
    return files


def text_facts(files: DataFrame) -> DataFrame:
    """``repo_id, rel_path, readable, bytes, lines, specs``: what imports, size rules and byte weights need of a text.

    One row per file that an import tree can hold: context files and files whose name has an importable
    extension, as every spec has. ``lines`` is null for files that are no context files, ``specs`` for texts without ``@``.
    A caller that needs more than one of them keeps these short rows, so each text is read once.
    """
    path, content = F.col("rel_path"), F.col("content")
    return target_scope(files).where(_is_context_path(path) | path.rlike(IMPORTABLE_NAME)).select(
        "repo_id",
        "rel_path",
        content.isNotNull().alias("readable"),
        F.octet_length(content).cast("long").alias("bytes"),
        F.when(_is_context_path(path), line_count(content)).alias("lines"),
        F.when(content.contains("@"), F.regexp_extract_all(content, F.lit(IMPORT_RE), 1)).alias("specs"),
    )


def extract_edges(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row per import line: ``repo_id, src_path, ord, spec, dst_path, dst_exists, dst_is_context``.

    Only files that can start or continue an import tree are read (:func:`text_facts`,
    given where the caller keeps it). ``dst_path`` is null when the spec leaves the snapshot root.
    """
    facts = text_facts(files) if facts is None else facts
    sources = facts.where(F.size("specs") > 0).select("repo_id", F.col("rel_path").alias("src_path"), F.posexplode("specs").alias("ord", "spec"))
    # Extracted once: the rows (keys and specs, no text) feed both the target
    # set and the join below, so they are kept rather than re-scanned.
    raw = sources.withColumn("dst_path", resolve_import(F.col("src_path"), F.col("spec"))).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    # Existence: stream the keys of possible targets (no text) against the set of
    # targets; unreadable files (null content) are no targets.
    targets = raw.where(F.col("dst_path").isNotNull()).select("repo_id", "dst_path").distinct()
    keys = facts.select("repo_id", F.col("rel_path").alias("dst_path"))
    unreadable = facts.where(~F.col("readable")).select("repo_id", F.col("rel_path").alias("dst_path"))
    existing = (
        keys.join(targets, ["repo_id", "dst_path"], "left_semi")
        .join(unreadable, ["repo_id", "dst_path"], "left_anti")
        .withColumn("dst_exists", F.lit(True))
    )
    edges = raw.join(existing, ["repo_id", "dst_path"], "left").withColumn(
        "dst_exists", F.coalesce(F.col("dst_exists"), F.lit(False))
    )
    out = edges.select(
        "repo_id",
        "src_path",
        F.col("ord").cast("int").alias("ord"),
        "spec",
        "dst_path",
        "dst_exists",
        (F.col("dst_exists") & _is_context_path(F.col("dst_path"))).alias("dst_is_context"),
    )
    out.raw_rows = raw  # for the caller to unpersist
    return out


def fold_edges(edges: DataFrame) -> DataFrame:
    """``repo_id, node_path, next_path, ord``: edges to existing non-context files, each with its first position, as a written table."""
    return materialize(
        edges.where(F.col("dst_exists") & ~F.col("dst_is_context"))
        .groupBy("repo_id", F.col("src_path").alias("node_path"), F.col("dst_path").alias("next_path"))
        .agg(F.min("ord").alias("ord")),
        "fold",
    )


def import_closure(fold: DataFrame, context: DataFrame, reach_checkpoint_every: int = 8) -> DataFrame:
    """``repo_id, root_path, node_path, depth``: non-context files folded into each context file.

    All pairs of start and folded file, for those who ask for them; claims and broken
    specs below do without. Semi-naive iteration: each round joins only the newest frontier with
    the foldable edges and drops pairs already reached (``left_anti``). Every
    round is written as a table in the session's checkpoint folder
    (:func:`weighbridge.session.materialize`), so the plan stays short and a
    lost executor recomputes one round at most.
    """
    frontier = context.select("repo_id", F.col("rel_path").alias("root_path"), F.col("rel_path").alias("node_path"))
    reach = None
    depth = 0
    while True:
        depth += 1
        step = (
            frontier.join(fold, ["repo_id", "node_path"])
            .select("repo_id", "root_path", F.col("next_path").alias("node_path"))
            .where(F.col("node_path") != F.col("root_path"))
            .distinct()
        )
        if reach is not None:
            step = step.join(reach.select("repo_id", "root_path", "node_path"), ["repo_id", "root_path", "node_path"], "left_anti")
        step = materialize(step.withColumn("depth", F.lit(depth)), f"reach{depth}")
        if step.isEmpty():
            break
        reach = step if reach is None else reach.unionByName(step)
        if depth % reach_checkpoint_every == 0:
            reach = materialize(reach, "reach")
        frontier = step.select("repo_id", "root_path", "node_path")
    if reach is None:
        schema = "repo_id string, root_path string, node_path string, depth int"
        return fold.sparkSession.createDataFrame([], schema)
    return reach


class ImportForest:
    """The files of an import graph that one file only imports, each below the file that heads its tree.

    Such a file is reached through its one importer alone, so whatever is true of the ways to it follows from the
    ways to its ``head``: the first file above that is imported by several files or by none. Heads are found by pointer
    doubling: table ``k`` of ``jumps`` leads ``2^k`` files up, and a tree of depth ``n`` takes ``log2(n)`` written tables, however many
    files it has. Files on or below a cycle of such files (``lost``) have no head, cannot be reached from outside, and are left out.
    """

    lost: DataFrame | None = None

    def __init__(self, edges: DataFrame):
        """``edges``: ``repo_id, node_path, next_path, place`` (positions of the imports it stands for), without loops."""
        one = edges.groupBy("repo_id", F.col("next_path").alias("node_path")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node_path", "place")).alias("e"))
        self.inner = materialize(one.where("n = 1").select("repo_id", "node_path", F.col("e.node_path").alias("prev_path"), "e.place"), "forest")
        self.jumps: list[DataFrame] = []
        up = self.inner.select("repo_id", "node_path", F.col("prev_path").alias("up"))
        jump = materialize(up.join(self.inner.select("repo_id", F.col("node_path").alias("up")), ["repo_id", "up"], "left_semi"), "forest-jump")
        n = jump.count()
        while n:
            above = jump.select("repo_id", F.col("node_path").alias("up"), F.col("up").alias("next_up"))
            twice = jump.join(above, ["repo_id", "up"]).select("repo_id", "node_path", F.col("next_up").alias("up"))
            twice = materialize(twice, "forest-jump")
            m = twice.count()
            if m == n:  # a tree loses files at each step up; what loses none runs in circles
                self.lost = jump.select("repo_id", "node_path")
                break
            self.jumps.append(jump)
            jump, n = twice, m
        self.tables = [self.inner, *self.jumps, jump]
        if self.lost is not None:
            self.inner = self.inner.join(self.lost, ["repo_id", "node_path"], "left_anti")
        self.heads = self._heads()
        if self.jumps:
            self.heads = materialize(self.heads, "forest-heads")
            self.tables.append(self.heads)

    def _climb(self, rows: DataFrame, step) -> DataFrame:
        """Moves column ``at`` of ``rows`` up by each table of jumps, the longest first; ``step(k, up)`` has the new columns."""
        for k in reversed(range(len(self.jumps))):
            jump = self.jumps[k].select("repo_id", F.col("node_path").alias("at"), "up")
            rows = rows.join(jump, ["repo_id", "at"], "left").withColumns(step(k, F.col("up"))).drop("up")
        return rows

    def _heads(self) -> DataFrame:
        rows = self.inner.select("repo_id", "node_path", F.col("node_path").alias("at"), F.lit(0).alias("depth"))
        rows = self._climb(rows, lambda k, up: {"at": F.coalesce(up, "at"), "depth": F.col("depth") + F.when(up.isNull(), 0).otherwise(1 << k)})
        top = self.inner.select("repo_id", F.col("node_path").alias("at"), F.col("prev_path").alias("head"))
        return rows.join(top, ["repo_id", "at"]).select("repo_id", "node_path", "head", "depth")

    def ways(self, nodes: DataFrame) -> DataFrame:
        """``repo_id, node_path, head, way``: for those of ``nodes`` that have a head, the positions from it down to them."""
        rows = self.heads.join(nodes, ["repo_id", "node_path"], "left_semi")
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), "depth")).alias("above"), F.col("node_path").alias("at"))
        rows = self._climb(rows, lambda k, up: {"at": F.when(F.col("above").bitwiseAND(F.lit(1 << k)) != 0, up).otherwise(F.col("at"))})
        rows = rows.join(self.inner.select("repo_id", F.col("node_path").alias("at"), "place"), ["repo_id", "at"])
        steps = F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("o"), "place")))
        return rows.groupBy("repo_id", "node_path", "head").agg(F.flatten(F.transform(steps, lambda s: s["place"])).alias("way"))

    def without_lost(self, rows: DataFrame) -> DataFrame:
        """``rows`` of files that can be reached."""
        return rows if self.lost is None else rows.join(self.lost, ["repo_id", "node_path"], "left_anti")

    def discard(self) -> None:
        discard(*self.tables)


def import_forest(fold: DataFrame) -> ImportForest:
    return ImportForest(_placed(fold))


def _placed(fold: DataFrame) -> DataFrame:
    return fold.where(F.col("node_path") != F.col("next_path")).select("repo_id", "node_path", "next_path", F.array("ord").alias("place"))


def contract(edges: DataFrame, broken: DataFrame, starts: DataFrame, forest: ImportForest) -> tuple[DataFrame, DataFrame]:
    """``edges`` and ``broken`` (``repo_id, node_path, spec, place``) with every tree of the forest drawn into its head.

    What a file of a tree imports, or holds broken, becomes its head's, at the positions on the way down. Two ways
    between the same files become the smaller one, which can leave a file with one importer again, so this is
    repeated, without files that no start file or no broken spec needs, until no tree is left. Trees, chains and ladders
    of any length vanish in a few rounds; left are files with several importers each.
    """
    at, last = ["repo_id", "node_path"], None
    while True:
        if forest.inner.isEmpty():
            return forest.without_lost(edges), broken
        edges, broken = forest.without_lost(edges), forest.without_lost(broken)
        leaving = edges.join(forest.inner.select("repo_id", F.col("node_path").alias("next_path")), ["repo_id", "next_path"], "left_anti")
        needed = leaving.select(*at).unionByName(broken.select(*at)).distinct()
        ways = materialize(forest.ways(needed), "forest-ways")

        def to_head(rows, ways=ways):
            moved = rows.join(ways, at, "left")
            place = F.when(F.col("way").isNull(), F.col("place")).otherwise(F.concat("way", "place"))
            return moved.withColumns({"node_path": F.coalesce("head", "node_path"), "place": place}).drop("head", "way")

        edges = to_head(leaving).where(F.col("node_path") != F.col("next_path")).groupBy(*at, "next_path").agg(F.min("place").alias("place"))
        broken = materialize(to_head(broken).groupBy(*at, "spec").agg(F.min("place").alias("place")), "broken")
        edges = materialize(edges, "core")
        useful = edges.select(*at).unionByName(broken.select(*at)).distinct().withColumnRenamed("node_path", "next_path")
        reached = edges.select("repo_id", F.col("next_path").alias("node_path")).unionByName(starts.select(*at)).distinct()
        pruned = edges.join(useful, ["repo_id", "next_path"], "left_semi").join(reached, at, "left_semi")
        pruned = materialize(pruned.select(*at, "next_path", "place"), "core")
        discard(ways, edges)
        if last is not None:
            last.discard()
        if pruned.isEmpty():
            return pruned, broken
        edges, forest = pruned, ImportForest(pruned)
        last = forest


def leading_to_broken(broken: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo_id, node_path``: files that hold a broken spec or reach one. One row per file, found backwards."""
    key = ["repo_id", "node_path"]
    back = edges.select("repo_id", F.col("next_path").alias("node_path"), F.col("node_path").alias("prev_path"))
    frontier = materialize(broken.select(*key).distinct(), "live")
    live, tables, rounds = frontier, [frontier], 0
    while not frontier.isEmpty():
        rounds += 1
        step = frontier.join(back, key).select("repo_id", F.col("prev_path").alias("node_path")).distinct()
        frontier = materialize(step.join(live, key, "left_anti"), "live")
        live = live.unionByName(frontier)
        tables.append(frontier)
        if rounds % 8 == 0:
            live = materialize(live, "live")
            discard(*tables[:-1])
            tables = [tables[-1], live]
    out = materialize(live, "live")
    discard(*tables)
    return out


def unresolved_imports(edges: DataFrame, fold: DataFrame, context: DataFrame, forest: ImportForest | None = None) -> DataFrame:
    """``repo_id, root_path, spec, place``: broken specs per start file, each at its first place in the import tree.

    The tree is walked depth first, each file once. A file's way in that walk is its
    smallest simple path by the positions of the imports on it, so ``place``, those
    positions and the spec's own, sorts broken specs as the walk meets them. Files with one importer are
    first drawn into the heads of their trees (:func:`contract`), a number of rounds that grows with the logarithm of the
    trees' depth. Among what is left, files with several importers each, paths are handed on while they
    improve (a written table per round), and only through files that lead to a broken spec.
    """
    at = ["repo_id", "node_path"]
    broken = edges.where(~F.col("dst_exists")).groupBy("repo_id", F.col("src_path").alias("node_path"), "spec")
    broken = materialize(broken.agg(F.array(F.min("ord")).alias("place")), "broken")
    starts = context.select("repo_id", F.col("rel_path").alias("node_path"))
    core, broken = contract(_placed(fold), broken, starts, forest or import_forest(fold))
    own = broken.join(starts, at, "left_semi").select("repo_id", F.col("node_path").alias("root_path"), "spec", "place")
    if core.isEmpty():
        return own
    further = core.select("repo_id", F.col("node_path").alias("next_path"))
    if core.join(further, ["repo_id", "next_path"], "left_semi").isEmpty():  # nothing lies beyond what start files import
        held = broken.select("repo_id", F.col("node_path").alias("next_path"), "spec", F.col("place").alias("held"))
        below = core.join(starts, at, "left_semi").join(held, ["repo_id", "next_path"])
        below = below.select("repo_id", F.col("node_path").alias("root_path"), "spec", F.concat("place", "held").alias("place"))
        return materialize(own.unionByName(below).groupBy("repo_id", "root_path", "spec").agg(F.min("place").alias("place")), "unresolved")
    live = leading_to_broken(broken, core)
    steps = core.withColumnRenamed("place", "step").join(live.withColumnRenamed("node_path", "next_path"), ["repo_id", "next_path"], "left_semi")
    start = starts.join(live, at, "left_semi").select(
        "repo_id",
        F.col("node_path").alias("root_path"),
        "node_path",
        F.array().cast("array<int>").alias("place"),
        F.array("node_path").alias("trail"),
    )
    key = ["repo_id", "root_path", "node_path"]
    way = F.struct(F.concat("place", "step").alias("place"), F.concat("trail", F.array("next_path")).alias("trail"))
    frontier = ways = materialize(start, "ways")
    tables, rounds = [ways], 0
    while not frontier.isEmpty():
        rounds += 1
        known = ways.groupBy(*key).agg(F.min("place").alias("known"))  # ways that were improved on stay, and never win
        step = (
            frontier.join(steps, at)
            .where(~F.array_contains("trail", F.col("next_path")))
            .groupBy("repo_id", "root_path", F.col("next_path").alias("node_path"))
            .agg(F.min(way).alias("way"))
            .select(*key, "way.place", "way.trail")
            .join(known, key, "left")
        )
        better = step.where(F.col("known").isNull() | (F.col("place") < F.col("known"))).drop("known")
        frontier = materialize(better, "ways")
        ways = ways.unionByName(frontier)
        tables.append(frontier)
        if rounds % 8 == 0:
            best = ways.groupBy(*key).agg(F.min(F.struct("place", "trail")).alias("way")).select(*key, "way.place", "way.trail")
            ways = materialize(best, "ways")
            discard(*tables[:-1])
            tables = [frontier, ways]
    held = broken.withColumnRenamed("place", "held")
    first = F.min(F.concat("place", "held")).alias("place")
    out = materialize(ways.join(held, at).groupBy("repo_id", "root_path", "spec").agg(first), "unresolved")
    discard(live, *tables)
    return out


def claim_imports(fold: DataFrame, context: DataFrame, collation: str = "UTF8_BINARY", forest: ImportForest | None = None) -> DataFrame:
    """``repo_id, importer_path, imported_path``: each folded file goes to its first importer in path order.

    Smallest-label propagation: a file holds the first importer known to reach it and
    hands it on when it improves, so the state is one row per file, whatever the number
    of start files. Only files with several importers take part; the others follow the head of their tree
    (:class:`ImportForest`). Path order is binary by default (what SQL engines sort by); ``collation``
    ``"UNICODE"`` uses ICU root collation, closer to a locale-aware compare; paths that it holds equal are in binary order.
    """
    key = ["repo_id", "node_path"]
    forest = forest or import_forest(fold)
    order = lambda c: path_order(F.col(c), collation)
    first = lambda c: F.min(F.struct(order(c).alias("o"), F.col(c).cast("string").alias("p")))["p"]
    heads = forest.heads.select(*key, "head")
    inner = heads.select("repo_id", F.col("node_path").alias("next_path"))
    core = fold.join(inner, ["repo_id", "next_path"], "left_anti").join(heads, key, "left")
    core = materialize(core.select("repo_id", F.coalesce("head", "node_path").alias("node_path"), "next_path").distinct(), "claim-core")
    starts = context.select("repo_id", F.col("rel_path").alias("node_path"), F.col("rel_path").alias("importer_path"))
    frontier, labels = starts, None
    while True:
        step = frontier.join(core, key).groupBy("repo_id", F.col("next_path").alias("node_path")).agg(first("importer_path").alias("importer_path"))
        if labels is not None:
            known = labels.withColumnRenamed("importer_path", "known")
            earlier = F.struct(order("importer_path"), F.col("importer_path")) < F.struct(order("known"), F.col("known"))
            step = step.join(known, key, "left").where(F.col("known").isNull() | earlier).drop("known")
        before, frontier = frontier, materialize(step, "claim")
        if labels is not None and before is not labels:
            discard(before)
        if frontier.isEmpty():
            discard(frontier)
            break
        before, labels = labels, frontier
        if before is not None:
            labels = materialize(before.join(frontier.select(*key), key, "left_anti").unionByName(frontier), "claims")
            discard(before)
    known = starts if labels is None else starts.unionByName(labels)
    below = heads.join(known.withColumnRenamed("node_path", "head"), ["repo_id", "head"]).select(*key, "importer_path")
    out = below if labels is None else below.unionByName(labels)
    return out.select("repo_id", "importer_path", F.col("node_path").alias("imported_path"))
