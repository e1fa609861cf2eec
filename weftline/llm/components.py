"""Problem 4: consolidating pairwise links into groups by rake and compress.

Each phase takes all vertices of degree one and two at once. They form chains, and every chain is ranked by pointer
doubling in both directions, which finds its smallest vertex and what it ends at: all its vertices get that smallest one
as parent and leave the graph. A chain that ends in a leaf hangs on its other end, one between two vertices that stay
leaves an edge between them, a path or cycle of its own is done. Trees and cycles vanish that way in a logarithmic number of
phases. When a phase no longer shrinks the graph by an eighth, what is left (nearly all of it of degree three or more) is
solved by alternating large-star and small-star steps. Labels are then restored by pointer doubling over the removed
vertices.

State lives in tables of the shared checkpoint folder, so a lost executor costs no more than its tasks. Nothing is
collected but counts, and every join of the loop is a merge join, so that no side of it passes through the driver. A hub
vertex costs no more than its edges: degrees are aggregated before shuffling and no step builds the list of a vertex's
neighbours.

Defined results: null ends and self loops make no link (and no row); repeated and reversed links count once; an empty
input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.values import plain_digest, plain_uuid
from weftline.operators.components import star_labels
from weftline.runtime import written

#: A phase must take away at least this share of the edges to be followed by another one.
SHRINK = 0.125


def simple_edges(links: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct undirected edges (``u`` < ``v``)."""
    return (
        links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col(a).isNotNull().alias("_a"), F.col(b).isNotNull().alias("_b"))
        .filter("_a and _b and u <> v")
        .select("u", "v")
        .distinct()
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))))


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A merge join, whatever the sides are thought to hold."""
    return left.join(right.hint("merge"), on, how)


def _thin_chains(edges: DataFrame) -> DataFrame:
    """``c``, ``low``, ``end1`` and ``end2`` of every vertex of degree one or two.

    ``low`` is the smallest vertex of its chain, the ends are the vertices that stay (null for leaves and cycles). The arc
    (u, v) stands at v, coming from u (null: v is where the chain begins). It points to the arc that leaves v on the other
    side; an arc that leaves for a vertex that stays, or for nowhere, is the end of its chain.
    """
    degree = _both_ways(edges).groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("a"), F.max("y").alias("b"))
    thin = written(degree.filter("n < 3").select(F.col("x").alias("c"), "a", F.when(F.col("n") == 2, F.col("b")).alias("b")))
    sides = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("pv")), F.struct(F.col("b").alias("u"), F.col("a").alias("pv")))
    hop = thin.select("c", F.inline(sides))
    state = hop.select("u", F.col("c").alias("v"), F.col("c").alias("pu"), "pv", F.col("pv").isNull().alias("ended"), F.col("c").alias("low"), F.lit(False).alias("news"))
    while True:
        state = written(_ranked(_ranked(state)))
        if state.filter("news").isEmpty():
            break
    return state.groupBy(F.col("v").alias("c")).agg(
        F.min("low").alias("low"), F.min(F.when(F.col("ended"), F.col("pv"))).alias("end1"), F.max(F.when(F.col("ended"), F.col("pv"))).alias("end2")
    )


def _ranked(state: DataFrame) -> DataFrame:
    """One step of pointer doubling: every arc takes over where the arc it points to has got to.

    An arc that points to none leaves for a vertex that stays and has ended; one that has ended meets none and stays as it is.
    """
    ahead = state.filter("u is not null").select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("pu").alias("nu"), F.col("pv").alias("nv"), F.col("ended").alias("n_ended"), F.col("low").alias("n_low"))
    here = (F.col("s.pu") == F.col("h.pu")) & (F.col("s.pv") == F.col("h.pv")) & ~F.col("s.ended")
    met = state.drop("news").alias("s").join(ahead.hint("merge").alias("h"), here, "left")
    last = F.col("n_ended").isNull()
    return met.select(
        "u", "v", F.coalesce("nu", "s.pu").alias("pu"), F.when(last, F.col("s.pv")).otherwise(F.col("nv")).alias("pv"), F.coalesce("n_ended", F.lit(True)).alias("ended"),
        F.least("low", "n_low").alias("low"), (~F.col("ended") & (last | F.col("n_ended") | (F.col("n_low") < F.col("low")))).alias("news"),
    )


def _peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removed vertices with their parents (``child``, ``parent``) and the edges left."""
    chains = written(_thin_chains(edges))
    heads = chains.filter("c = low and end1 is not null")
    removed = chains.select(F.col("c").alias("child"), F.when(F.col("c") != F.col("low"), F.col("low")).otherwise(F.col("end1")).alias("parent")).filter("parent is not null")
    kept = _merged(_merged(edges, chains.select(F.col("c").alias("u")), "u", "left_anti"), chains.select(F.col("c").alias("v")), "v", "left_anti").select("u", "v")
    bridges = heads.filter("end1 <> end2").select(F.least("end1", "end2").alias("u"), F.greatest("end1", "end2").alias("v"))
    return removed, written(kept.unionByName(bridges).distinct())


def connected_groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``record_id`` and ``group_id`` (the smallest record of its group) of every record with a link to another one."""
    edges = whole = written(simple_edges(links, a, b))
    forest: DataFrame | None = None
    left = edges.count()
    while left:
        removed, edges = _peel(edges)
        forest = removed if forest is None else forest.unionByName(removed)
        before, left = left, edges.count()
        if left >= before * (1 - SHRINK):
            break
    if left:
        core = star_labels(edges).filter("x <> label").select(F.col("x").alias("child"), F.col("label").alias("parent"))
        forest = core if forest is None else forest.unionByName(core)
    if forest is None:
        return whole.select(F.col("u").alias("record_id"), F.col("v").alias("group_id"))
    return _restore(forest)


def _restore(forest: DataFrame) -> DataFrame:
    """Give every vertex the smallest vertex of its tree, by pointer doubling from the removed ones to their roots.

    The forest of all phases is written first: doubling reads it many times, and the driver holds every copy of its plan.
    """
    forest = written(forest)
    roots = _merged(forest.select(F.col("parent").alias("child")).distinct(), forest.select("child"), "child", "left_anti")
    hop = forest.unionByName(roots.select("child", F.col("child").alias("parent")))
    member = chain_ends(written(hop), "child", "parent")
    name = member.groupBy("parent").agg(F.min("child").alias("group_id"))
    return _merged(member, name, "parent").select(F.col("child").alias("record_id"), "group_id")


def decided_links(pairs: DataFrame, blocked: DataFrame) -> DataFrame:
    """The links of problem 4 as (``a``, ``b``) in plain form.

    The latest row of a pair decides; rows of the same time are ordered by disposition and ends, so that ties have a
    defined result. A pair is known by its id; without a readable id by its two candidates.
    """
    edges = blocked.select(plain_digest(F.col("attempted_pair_id")).alias("a"), plain_digest(F.col("separation_pair_id")).alias("b"))
    ends = pairs.select(
        plain_digest(F.col("pair_id")).alias("p"), plain_uuid(F.col("left_candidate_id")).alias("l"), plain_uuid(F.col("right_candidate_id")).alias("r"), "disposition", "recorded_at_utc"
    )
    key = F.coalesce("p", F.concat_ws(",", F.least("l", "r"), F.greatest("l", "r")))
    last = ends.groupBy(key.alias("k")).agg(F.max_by(F.struct("p", "l", "r", "disposition"), F.struct("recorded_at_utc", "disposition", "l", "r")).alias("z")).select("z.*")
    live = last.filter(F.col("disposition").isin("auto_match", "manual_match")).join(edges.filter("a is not null").select(F.col("a").alias("p")).distinct(), "p", "left_anti")
    return live.select(F.col("l").alias("a"), F.col("r").alias("b")).unionByName(edges)


def p4_found(spark, sf_dir: str) -> DataFrame:
    """``record_id`` and ``group_id`` of every candidate and pair with a link."""
    pairs, blocked = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pairs", "blocked_edges"))
    return connected_groups(decided_links(pairs, blocked))


def chain_ends(hop: DataFrame, key: str, to: str) -> DataFrame:
    """``hop`` with every pointer ``to`` at the end of its chain, by pointer doubling until none moves.

    Each ``key`` has one row, ends point at themselves and no chain comes back. A column ``conf`` becomes the least of the
    steps taken.
    """
    extra = [c for c in hop.columns if c == "conf"]

    def jump(df: DataFrame) -> DataFrame:
        up = df.select(F.col(key).alias(to), F.col(to).alias("above"), *[F.col(c).alias("c") for c in extra])
        least = [F.when(F.col("above") == F.col(to), F.col("conf")).otherwise(F.least("conf", "c")).alias("conf")] if extra else []
        return _merged(df, up, to).select(key, F.col("above").alias(to), *least, (F.col("above") != F.col(to)).alias("moved"))

    hop = hop.select(key, to, *extra)
    while True:
        hop = written(jump(jump(hop)))
        if hop.filter("moved").isEmpty():
            return hop.drop("moved")
