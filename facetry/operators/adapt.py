"""Mesh adaptation in rounds: refinement by templates, independent collapses and swaps, smoothing, snapping, layers of prisms.

A mesh is down (elem, pos, vert) and vertex (vert, x, y, z). Every operation that changes a cavity is tried on all candidates at
once; those that win the least priority on all elements of their cavity are applied together, so a round is a few joins.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.operators import numbering, topology
from facetry.operators.graph import pinned

SPLIT, COLLAPSE = 1.5, 0.5
_EDGES = list(combinations(range(4), 2))


def template(code: int) -> list[tuple[int, ...]]:
    """The tets of a tet with a bit for each marked edge: 0-3 its corners in order of ids, 4-9 the middles of its edges.

    Marked edges are cut in one order everywhere, that of their ends' ids, so elements agree on the faces that they share.
    """
    tets = [(0, 1, 2, 3)]
    for e, (a, b) in enumerate(_EDGES):
        if code >> e & 1:
            cut = []
            for t in tets:
                cut += [tuple(4 + e if v == b else v for v in t), tuple(4 + e if v == a else v for v in t)] if a in t and b in t else [t]
            tets = cut
    return tets


TEMPLATES = [template(code) for code in range(64)]
CHILDREN = max(map(len, TEMPLATES))


def cells(down: DataFrame, vertex: DataFrame) -> DataFrame:
    """elem, p: corners with vert, x, y, z in order of position."""
    return down.join(vertex.select("vert", "x", "y", "z"), "vert").groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("pos", "vert", "x", "y", "z"))).alias("p"))


def corner(i: int, p: str = "p") -> Column:
    return F.get(p, F.lit(i))


def volume(p: str = "p") -> Column:
    return g.tet_volume([corner(i, p) for i in range(4)])


def oriented(elems: DataFrame, vertex: DataFrame) -> DataFrame:
    """down of elems (elem, verts), with two vertices of inverted tets exchanged."""
    d = elems.select("elem", F.posexplode("verts").alias("pos", "vert"))
    c = cells(d, vertex).withColumn("bad", volume() < 0)
    v = F.transform("p", lambda q: q["vert"])
    turned = F.when(F.col("bad"), F.array(v[0], v[1], v[3], v[2])).otherwise(v)
    return c.select("elem", F.posexplode(turned).alias("pos", "vert"))


def edges(down: DataFrame) -> DataFrame:
    """a, b: each edge once, a < b."""
    return topology.boundary(down, 2).select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b")).distinct()


def with_ends(e: DataFrame, vertex: DataFrame) -> DataFrame:
    """`e` (a, b) with pa and pb, the points of its ends."""
    p = F.struct("x", "y", "z")
    return e.join(vertex.select(F.col("vert").alias("a"), p.alias("pa")), "a").join(vertex.select(F.col("vert").alias("b"), p.alias("pb")), "b")


def metric_lengths(e: DataFrame, vertex: DataFrame, size: Column) -> DataFrame:
    """a, b, length: edge lengths in a size field (an expression of x, y, z), with the mean size of the ends."""
    h = vertex.select("vert", size.alias("h"))
    x = with_ends(e, vertex).join(h.select(F.col("vert").alias("a"), F.col("h").alias("ha")), "a").join(h.select(F.col("vert").alias("b"), F.col("h").alias("hb")), "b")
    return x.select("a", "b", (g.norm(g.vec(F.col("pa"), F.col("pb"))) / ((F.col("ha") + F.col("hb")) / 2)).alias("length"))


def refined(down: DataFrame, vertex: DataFrame, marked: DataFrame, transfer: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(down, vertex) with all marked edges (a < b) cut in the middle; columns of `transfer` are means of the ends."""
    carry = ["x", "y", "z", *(transfer or [])]
    first = vertex.agg((F.max("vert") + 1).alias("n")).first()["n"]
    mid = numbering.numbered(marked.select("a", "b").withColumn("all", F.lit(0)), "all", "a", "b").select("a", "b", (F.col("global_number") + first).alias("mid"))
    mid = pinned(mid)
    va, vb = (vertex.select(F.col("vert").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in carry]) for k in "ab")
    new = mid.join(va, "a").join(vb, "b").select(F.col("mid").alias("vert"), *[((F.col(f"{c}_a") + F.col(f"{c}_b")) / 2).alias(c) for c in carry])
    e = topology.boundary(down.select("elem", "pos", "vert"), 2)
    # edges by the order of ids: the place of an edge in it is what the templates count
    verts = topology.gathered(down).select("elem", F.array_sort("verts").alias("vs"))
    at = e.select("elem", F.col("key")[0].alias("a"), F.col("key")[1].alias("b")).join(mid, ["a", "b"])
    code = at.join(verts, "elem")
    bit = F.lit(0)
    for k, (i, j) in enumerate(_EDGES):
        bit = F.when((F.col("vs")[i] == F.col("a")) & (F.col("vs")[j] == F.col("b")), k).otherwise(bit)
    per = code.withColumn("k", bit).groupBy("elem").agg(F.map_from_entries(F.collect_list(F.struct("k", "mid"))).alias("mids"), F.sum(F.expr("shiftleft(1, k)")).cast("int").alias("code"))
    x = verts.join(per, "elem", "left").withColumn("code", F.coalesce("code", F.lit(0)))
    rules = F.array(*[F.array(*[F.array(*map(F.lit, t)) for t in ts]) for ts in TEMPLATES])
    kids = x.select("elem", "vs", "mids", F.posexplode(rules[F.col("code")]).alias("kid", "t"))
    vert = F.transform("t", lambda i: F.when(i < 4, F.get("vs", i)).otherwise(F.try_element_at("mids", i - 4)))
    table = vertex.select("vert", *carry).unionByName(new)
    elems = kids.select((F.col("elem") * CHILDREN + F.col("kid")).alias("elem"), vert.alias("verts"))
    table = pinned(table)
    return pinned(oriented(elems, table)), table


def _winners(cavity: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """The candidates (keys) of `cavity` (keys, elem) that come first on every element of their cavity."""
    pri = cavity.withColumn("pri", F.xxhash64(*keys, F.lit(seed)))
    best = pri.groupBy("elem").agg(F.min(F.struct("pri", *keys)).alias("best"))
    own = pri.join(best, "elem").withColumn("won", F.col("best") == F.struct("pri", *keys))
    return own.groupBy(*keys).agg(F.bool_and("won").alias("won")).where("won").select(*keys)


def fixed_axes(names: str = "xyz") -> list[Column]:
    """Whether a vertex of the unit box lies on a side across each axis, and so may not move along it."""
    return [F.col(c).isin(0.0, 1.0) for c in names]


def collapsed(down: DataFrame, vertex: DataFrame, marked: DataFrame, seed: int, least: float = 1e-12) -> tuple[DataFrame, DataFrame, int]:
    """(down, vertex, collapses): an independent set of marked edges (a, b) collapsed to one end.

    The end that goes must lie on no model entity that the other is not in the closure of; what is left of its cavity must be
    positive and fill the same volume.
    """
    both = marked.select(F.explode(F.array(F.struct(F.col("a").alias("gone"), F.col("b").alias("stay")), F.struct(F.col("b").alias("gone"), F.col("a").alias("stay")))).alias("c")).select("c.*")
    pts = vertex.select("vert", F.struct("x", "y", "z").alias("q"))
    x = both.join(pts.select(F.col("vert").alias("gone"), F.col("q").alias("pg")), "gone").join(pts.select(F.col("vert").alias("stay"), F.col("q").alias("ps")), "stay")
    for c in "xyz":
        x = x.where(~F.col(f"pg.{c}").isin(0.0, 1.0) | (F.col(f"pg.{c}") == F.col(f"ps.{c}")))
    c = pinned(cells(down, vertex).withColumn("vs", F.transform("p", lambda q: q["vert"])))
    cav = x.join(down.select("elem", F.col("vert").alias("gone")), "gone").join(c, "elem")
    moved = F.transform("p", lambda q: F.struct(F.when(q["vert"] == F.col("gone"), F.col("ps.x")).otherwise(q["x"]).alias("x"), F.when(q["vert"] == F.col("gone"), F.col("ps.y")).otherwise(q["y"]).alias("y"), F.when(q["vert"] == F.col("gone"), F.col("ps.z")).otherwise(q["z"]).alias("z")))
    cav = cav.withColumn("old", volume()).withColumn("m", moved).withColumn("new", F.when(F.array_contains("vs", F.col("stay")), F.lit(None)).otherwise(volume("m")))
    good = cav.groupBy("gone", "stay").agg(F.min("new").alias("least"), F.sum("new").alias("new"), F.sum("old").alias("old"))
    good = good.where((F.col("least") > least) & (F.abs(F.col("new") - F.col("old")) <= 1e-9 * F.col("old")))
    best = good.groupBy("gone").agg(F.min_by("stay", F.struct(-F.col("least"), F.col("stay"))).alias("stay"))
    cavity = best.join(down.select("elem", F.col("vert").alias("gone")), "gone").select("gone", "stay", "elem")
    won = pinned(_winners(cavity, ["gone", "stay"], seed))
    dead = won.join(c.select("elem", F.explode("vs").alias("gone")), "gone").join(c.select("elem", "vs"), "elem").where(F.array_contains("vs", F.col("stay"))).select("elem").distinct()
    out = down.join(dead, "elem", "left_anti").join(won.withColumnRenamed("gone", "vert"), "vert", "left").select("elem", "pos", F.coalesce("stay", "vert").alias("vert"))
    return pinned(out), pinned(vertex.join(won.select(F.col("gone").alias("vert")), "vert", "left_anti")), won.count()


def swapped(down: DataFrame, vertex: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """(down, swaps): inner edges with three or four tets around them replaced where that raises the least quality.

    Of three tets two are left, on both sides of the ring; of four, four around one of the ring's diagonals.
    """
    c = pinned(cells(down, vertex).withColumn("vs", F.transform("p", lambda q: q["vert"])))
    pairs = F.array(*[F.struct(F.least(F.col("vs")[i], F.col("vs")[j]).alias("a"), F.greatest(F.col("vs")[i], F.col("vs")[j]).alias("b")) for i, j in _EDGES])
    use = c.select("elem", "vs", g.tet_quality([corner(i) for i in range(4)]).alias("q"), volume().alias("v"), F.explode(pairs).alias("e")).select("elem", "vs", "q", "v", "e.a", "e.b")
    use = use.withColumn("ring", F.array_sort(F.array_except("vs", F.array("a", "b"))))
    r = use.groupBy("a", "b").agg(F.collect_list("ring").alias("links"), F.collect_list("elem").alias("es"), F.min("q").alias("q"), F.sum("v").alias("v")).withColumn("rv", F.array_sort(F.array_distinct(F.flatten("links"))))
    r = r.where(F.size("es").isin(3, 4) & (F.size("rv") == F.size("es")))  # closed rings: the edge is inside
    v = F.col("rv")
    three = F.array(F.array(v[0], v[1], v[2], F.col("a")), F.array(v[0], v[1], v[2], F.col("b")))
    # of four, the vertex that is not beside the first is across from it
    far = F.filter(F.slice("rv", 2, 3), lambda w: ~F.array_contains(F.col("links"), F.array_sort(F.array(F.col("rv")[0], w))))[0]
    r = r.withColumn("far", F.when(F.size("es") == 4, far)).withColumn("side", F.array_except("rv", F.array(F.col("rv")[0], F.col("far"))))
    s = F.col("side")
    around = lambda p, q, u, w: F.array(*[F.array(p, q, end, m) for end in (F.col("a"), F.col("b")) for m in (u, w)])
    one, two = around(v[0], F.col("far"), F.get("side", F.lit(0)), F.get("side", F.lit(1))), around(F.get("side", F.lit(0)), F.get("side", F.lit(1)), v[0], F.col("far"))
    cand = r.withColumn("way", F.explode(F.when(F.size("es") == 3, F.array(three)).otherwise(F.array(one, two))))
    cand = cand.select("a", "b", "es", "q", "v", F.posexplode(F.array("way")).alias("w", "way")).drop("w").withColumn("key", F.xxhash64("way"))
    t = cand.select("a", "b", "key", "q", "v", F.posexplode("way").alias("k", "verts")).select("*", F.posexplode("verts").alias("pos", "vert")).join(vertex.select("vert", "x", "y", "z"), "vert")
    t = t.groupBy("a", "b", "key", "q", "v", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))).alias("p"))
    t = t.groupBy("a", "b", "key", "q", "v").agg(F.min(F.abs(g.tet_quality([corner(i) for i in range(4)]))).alias("nq"), F.sum(F.abs(volume())).alias("nv"))
    good = t.where((F.col("nq") > F.col("q") * 1.001) & (F.abs(F.col("nv") - F.col("v")) <= 1e-9 * F.col("v")))
    best = good.groupBy("a", "b").agg(F.max_by("key", F.struct("nq", "key")).alias("key"))
    pick = pinned(cand.join(best, ["a", "b", "key"]).select("a", "b", "es", "way"))
    won = pinned(_winners(pick.select("a", "b", F.explode("es").alias("elem")), ["a", "b"], seed))
    done = pinned(pick.join(won, ["a", "b"]))
    dead = done.select(F.explode("es").alias("elem"))
    new = done.select("es", F.posexplode("way").alias("k", "verts")).select(F.get("es", F.col("k")).alias("elem"), "verts")
    return pinned(down.join(dead, "elem", "left_anti").select("elem", "pos", "vert").unionByName(oriented(new, vertex))), won.count()


def _moved(down: DataFrame, vertex: DataFrame, some: DataFrame, better: str, seed: int) -> tuple[DataFrame, int]:
    """(vertex, moves): an independent set of the inner vertices among `some` (vert) moved to their neighbours' mean where `better` holds of the
    least quality around them before and after (old, new). `down` has all elements around them."""
    e = edges(down)
    both = e.select(F.explode(F.array(F.struct(F.col("a").alias("vert"), F.col("b").alias("o")), F.struct(F.col("b").alias("vert"), F.col("a").alias("o")))).alias("s")).select("s.*")
    mean = both.join(vertex.select(F.col("vert").alias("o"), "x", "y", "z"), "o").groupBy("vert").agg(*[F.avg(k).alias(f"n{k}") for k in "xyz"])
    inner = vertex.where(" and ".join(f"{k} > 0 and {k} < 1" for k in "xyz")).select("vert").join(some, "vert", "left_semi")
    to = inner.join(mean, "vert")
    cav = to.join(down.select("elem", "vert"), "vert").join(cells(down, vertex), "elem")
    moved = F.transform("p", lambda q: F.struct(*[F.when(q["vert"] == F.col("vert"), F.col(f"n{k}")).otherwise(q[k]).alias(k) for k in "xyz"]))
    q = cav.withColumn("m", moved).groupBy("vert").agg(F.min(g.tet_quality([corner(i) for i in range(4)])).alias("old"), F.min(g.tet_quality([corner(i, "m") for i in range(4)])).alias("new"))
    won = pinned(_winners(q.where(better).select("vert").join(down.select("elem", "vert"), "vert"), ["vert"], seed))
    out = vertex.join(to.join(won, "vert"), "vert", "left")
    return pinned(out.select("vert", *[F.coalesce(f"n{k}", k).alias(k) for k in "xyz"])), won.count()


def smoothed(down: DataFrame, vertex: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """(vertex, moves): inner vertices moved to their neighbours' mean where that raises the least quality around them, an independent set at a time.

    Vertices of inverted elements come first, in rounds that each mend all elements around some, until such a move mends nothing more.
    """
    moves = 0
    while True:
        tangled = pinned(cells(down, vertex).where(volume() <= 0).select(F.explode("p.vert").alias("vert")).distinct())
        if tangled.isEmpty():
            break
        near = pinned(down.join(down.join(tangled, "vert", "left_semi").select("elem").distinct(), "elem", "left_semi"))
        vertex, n = _moved(near, vertex, tangled, "old <= 0 and new > 0", seed)
        moves += n
        if not n:
            break
    vertex, n = _moved(down, vertex, vertex.select("vert"), "new > old + 0.001 * abs(old)", seed)
    return vertex, moves + n


def snapped(down: DataFrame, vertex: DataFrame, target: DataFrame, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """(vertex, left): vertices moved to their target (vert, tx, ty, tz); those whose elements would turn over go half the way of before in each further round."""
    now, bad = vertex, target.select("vert")
    for k in range(rounds):
        share = 0.5**k
        aim = now.join(target, "vert").join(bad, "vert")
        aim = pinned(aim.select("vert", *[(F.col(c) + (F.col(f"t{c}") - F.col(c)) * share).alias(f"n{c}") for c in "xyz"]))
        tried = now.join(aim, "vert", "left").select("vert", *[F.coalesce(f"n{c}", c).alias(c) for c in "xyz"])
        wrong = cells(down, tried).where(volume() <= 1e-14).select(F.explode("p.vert").alias("vert")).distinct()
        bad = pinned(aim.select("vert").join(wrong, "vert", "left_semi"))
        keep = aim.join(bad, "vert", "left_anti")
        now = pinned(now.join(keep, "vert", "left").select("vert", *[F.coalesce(f"n{c}", c).alias(c) for c in "xyz"]))
        if bad.isEmpty():
            break
    far = now.join(target, "vert").where("abs(x - tx) + abs(y - ty) + abs(z - tz) > 1e-9").select("vert")
    return now, far


def prisms(flat: DataFrame, layers: int, verts: int) -> DataFrame:
    """elem, layer, verts: a flat mesh of triangles (elem, verts) extruded; ids of a layer are those below plus `verts`."""
    x = flat.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))))
    low = F.transform("verts", lambda v: v + F.col("layer") * verts)
    high = F.transform("verts", lambda v: v + (F.col("layer") + 1) * verts)
    return x.select((F.col("elem") * layers + F.col("layer")).alias("elem"), "layer", F.concat(low, high).alias("verts"))


def prism_tets(p: DataFrame) -> DataFrame:
    """elem, verts: each prism as three tets. Every quad is cut from its vertex of least id, so neighbours agree."""
    v = F.col("verts")
    turns = [(0, 1, 2, 3, 4, 5), (1, 2, 0, 4, 5, 3), (2, 0, 1, 5, 3, 4), (3, 5, 4, 0, 2, 1), (4, 3, 5, 1, 0, 2), (5, 4, 3, 2, 1, 0)]
    least = (F.array_position("verts", F.array_min("verts")) - 1).cast("int")
    turned = F.array(*[F.array(*[v[i] for i in t]) for t in turns])[least]  # the least vertex first
    x = p.withColumn("q", turned)
    q = F.col("q")
    one = F.array(F.array(q[0], q[1], q[2], q[5]), F.array(q[0], q[1], q[5], q[4]), F.array(q[0], q[4], q[5], q[3]))
    two = F.array(F.array(q[0], q[1], q[2], q[4]), F.array(q[0], q[4], q[2], q[5]), F.array(q[0], q[4], q[5], q[3]))
    cut = F.when(F.least(q[1], q[5]) < F.least(q[2], q[4]), one).otherwise(two)
    return x.select("elem", F.posexplode(cut).alias("k", "t")).select((F.col("elem") * 3 + F.col("k")).alias("elem"), F.col("t").alias("verts"))


def pyramid_tets(p: DataFrame) -> DataFrame:
    """elem, verts: pyramids (four base vertices, then the top) as two tets, the base cut from its least vertex."""
    v = F.col("verts")
    least = F.array_min(F.slice("verts", 1, 4))
    main = F.array(F.array(v[0], v[1], v[2], v[4]), F.array(v[0], v[2], v[3], v[4]))
    other = F.array(F.array(v[1], v[2], v[3], v[4]), F.array(v[1], v[3], v[0], v[4]))
    cut = F.when((v[0] == least) | (v[2] == least), main).otherwise(other)
    return p.select("elem", F.posexplode(cut).alias("k", "t")).select((F.col("elem") * 2 + F.col("k")).alias("elem"), F.col("t").alias("verts"))


def flipped(tri: DataFrame, vertex: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """(tri, flips): edges of a flat mesh (elem, verts) exchanged for the other diagonal where that raises the least quality."""
    v = F.col("verts")
    use = tri.select("elem", "verts", F.explode(F.array(*[F.struct(F.least(v[i], v[j]).alias("a"), F.greatest(v[i], v[j]).alias("b"), v[k].alias("c")) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))])).alias("e"))
    pair = use.groupBy("e.a", "e.b").agg(F.array_sort(F.collect_list(F.struct("elem", F.col("e.c").alias("c")))).alias("s")).where("size(s) = 2")
    pt = vertex.select("vert", F.struct("x", "y", F.lit(0.0).alias("z")).alias("q"))
    x = pair.select("a", "b", F.col("s")[0]["elem"].alias("e0"), F.col("s")[1]["elem"].alias("e1"), F.col("s")[0]["c"].alias("c"), F.col("s")[1]["c"].alias("d"))
    for k in "abcd":
        x = x.join(pt.select(F.col("vert").alias(k), F.col("q").alias(f"p{k}")), k)
    signed = lambda i, j, k: g.cross(g.vec(F.col(i), F.col(j)), g.vec(F.col(i), F.col(k)))[2]
    quality = lambda i, j, k: g.triangle_quality([F.col(i), F.col(j), F.col(k)])
    convex = signed("pc", "pd", "pa") * signed("pc", "pd", "pb") < -1e-15
    old, new = F.least(quality("pa", "pb", "pc"), quality("pa", "pb", "pd")), F.least(quality("pc", "pd", "pa"), quality("pc", "pd", "pb"))
    good = pinned(x.where(convex & (signed("pa", "pb", "pc") * signed("pa", "pb", "pd") < 0) & (new > old * 1.001)).select("a", "b", "c", "d", "e0", "e1", (signed("pc", "pd", "pa") > 0).alias("left")))
    won = pinned(_winners(good.select("a", "b", F.explode(F.array("e0", "e1")).alias("elem")), ["a", "b"], seed))
    done = pinned(good.join(won, ["a", "b"]))
    first = F.when(F.col("left"), F.array("c", "d", "a")).otherwise(F.array("d", "c", "a"))
    second = F.when(F.col("left"), F.array("d", "c", "b")).otherwise(F.array("c", "d", "b"))
    new_t = done.select(F.explode(F.array(F.struct(F.col("e0").alias("elem"), first.alias("verts")), F.struct(F.col("e1").alias("elem"), second.alias("verts")))).alias("t")).select("t.*")
    return pinned(tri.join(new_t.select("elem"), "elem", "left_anti").unionByName(new_t)), won.count()


def adapted(down: DataFrame, vertex: DataFrame, size: Column, rounds: int) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """(down, vertex, log of splits and collapses): rounds of coarsening, refining and swapping towards a size field."""
    log = []
    for k in range(rounds):
        lengths = pinned(metric_lengths(edges(down), vertex, size))
        down, vertex, n = collapsed(down, vertex, lengths.where(F.col("length") < COLLAPSE), k)
        lengths = pinned(metric_lengths(edges(down), vertex, size))
        long = lengths.where(F.col("length") > SPLIT)
        splits = long.count()
        if splits:
            down, vertex = refined(down, vertex, long)
        log.append((splits, n))
        if not splits and not n:
            break
        down, _ = swapped(down, vertex, k)
    return down, vertex, log


def report(down: DataFrame, vertex: DataFrame) -> DataFrame:
    """One row: volume, inverted elements, faces of more than two elements, Euler number (1 for a ball), vertices without elements."""
    c = cells(down, vertex).agg(F.round(F.sum(volume()), 9).alias("volume"), F.count_if(volume() <= 0).alias("inverted"), F.count(F.lit(1)).alias("t"))
    f = topology.entities(topology.boundary(down, 3)).agg(F.count(F.lit(1)).alias("f"), F.count_if(F.col("uses") > 2).alias("crowded"))
    e = edges(down).agg(F.count(F.lit(1)).alias("e"))
    v = vertex.agg(F.count(F.lit(1)).alias("v"))
    lone = vertex.select("vert").join(down.select("vert").distinct(), "vert", "left_anti").agg(F.count(F.lit(1)).alias("lone"))
    out = c
    for one in (f, e, v, lone):
        out = out.join(F.broadcast(one), F.lit(True))  # rows of one
    return out.select("volume", "inverted", "crowded", (F.col("v") - F.col("e") + F.col("f") - F.col("t")).alias("euler"), "lone")
