"""Map matching of traces to a network of edges in local metres.

Spark finds and ranks the candidates, cuts journeys into bounded requests and
brings each request its clipped part of the network. Only the sequential minimum
over one request runs in Python.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import groupby
from math import hypot, inf
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import point_segment, segment_fraction
from .gridjoin import box_cells, planar_cell, segment_cells
from ..session import cut_lineage
from .ordered import keep_parallel, quantiles


@dataclass(frozen=True)
class MatchPolicy:
    radius_m: float = 120.0
    candidates: int = 24
    request_points: int = 500
    margin_m: float = 160.0
    cell_m: float = 120.0


def edge_candidates(points: DataFrame, edges: DataFrame, policy: MatchPolicy = MatchPolicy(), keys: tuple[str, ...] = ("journey_id", "seq")) -> DataFrame:
    """Nearest edges of each point: up to `candidates` within `radius_m`, with offset fraction and gap. Points are unique by `keys`."""
    e = edges.select("edge_id", "ax", "ay", "bx", "by")
    right = segment_cells(e, "ax", "ay", "bx", "by", policy.cell_m, policy.radius_m)
    near = planar_cell(points, "x", "y", policy.cell_m).join(right, ["_cx", "_cy"])
    near = near.withColumn("gap", point_segment("x", "y", "ax", "ay", "bx", "by")).where(F.col("gap") <= policy.radius_m)
    near = near.withColumn("frac", segment_fraction("x", "y", "ax", "ay", "bx", "by")).drop("_cx", "_cy", "ax", "ay", "bx", "by")
    # One point's rivals only; WindowGroupLimit trims before the sort finishes.
    w = Window.partitionBy(*keys).orderBy("gap", "edge_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= policy.candidates)


def match_journeys(points: DataFrame, edges: DataFrame, policy: MatchPolicy = MatchPolicy()) -> DataFrame:
    """Snapped edge and offset per point; a point that cannot be matched says why.

    Points hold journey_id, seq (dense), x, y, accuracy_m. A request takes at most
    `request_points` points; neighbouring requests share their border point.
    A point without an edge within the radius is `no_candidates` and parts its
    request: the points before it and behind it are matched on their own. A
    part that no route connects is `disconnected` as a whole.
    """
    # Read by the candidates, the lattice and the boxes: written once.
    points = cut_lineage(points)
    step = policy.request_points - 1
    home = F.floor(F.col("seq") / step)
    shared = (F.col("seq") % step == 0) & (F.col("seq") > 0)
    p = points.withColumn("request", F.explode(F.when(shared, F.array(home - 1, home)).otherwise(F.array(home))))
    # Candidates are found once a position and travel as one short array a point.
    cands = edge_candidates(points.select("x", "y").distinct(), edges, policy, ("x", "y"))
    nearby = cands.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("gap", "edge_id", "frac"))).alias("nearby"))
    lattice = p.select("journey_id", "request", "seq", "x", "y", "accuracy_m").join(nearby, ["x", "y"], "left")
    boxes = p.groupBy("journey_id", "request").agg(*[f(c).alias(n) for n, f, c in (
        ("w", F.min, "x"), ("s", F.min, "y"), ("e", F.max, "x"), ("n", F.max, "y"))])
    m = policy.margin_m
    reach = box_cells(boxes, F.col("w") - m, F.col("s") - m, F.col("e") + m, F.col("n") + m, 1000.0)
    cells = segment_cells(edges, "ax", "ay", "bx", "by", 1000.0)
    hit = reach.join(cells, ["_cx", "_cy"]).where(
        (F.greatest("ax", "bx") >= F.col("w") - m) & (F.least("ax", "bx") <= F.col("e") + m)
        & (F.greatest("ay", "by") >= F.col("s") - m) & (F.least("ay", "by") <= F.col("n") + m))
    # An edge that meets a request in two cells comes twice; the graph takes it once.
    clipped = hit.select("journey_id", "request", "edge_id", "a_node", "b_node", "ax", "ay", "bx", "by")
    keys = ["journey_id", "request"]
    schema = f"journey_id {dict(points.dtypes)['journey_id']}, request long, seq long, edge_id long, frac double, status string"
    # Both sides descend from the same points: fresh column ids keep them apart.
    anew = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    left, right = keep_parallel(anew(lattice), keys), keep_parallel(anew(clipped), keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_match_request, schema)


def _match_request(lattice: pa.Table, network: pa.Table) -> pa.Table:
    head = (lattice if lattice.num_rows else network).select(["journey_id", "request"]).slice(0, 1)
    rows = []
    if lattice.num_rows:
        lattice, graph = lattice.sort_by("seq"), Graph(network.to_pydict())
        points = list(zip(*(lattice[c].to_pylist() for c in ("seq", "x", "y", "accuracy_m"))))
        nearby = lattice["nearby"].combine_chunks()
        flat = nearby.flatten()
        found = list(zip(*(flat.field(c).to_pylist() for c in ("edge_id", "frac", "gap"))))
        ends = np.cumsum([n or 0 for n in nearby.value_lengths().to_pylist()]).tolist()
        layers = [found[a:b] for a, b in zip([0, *ends], ends)]
        for near, part in groupby(zip(points, layers), key=lambda x: bool(x[1])):
            fixes, layer = zip(*part)
            # A fix without an edge ends one part, and the next begins behind it.
            chosen = best_sequence(fixes, layer, graph) if near else None
            status = "no_candidates" if not near else "matched" if chosen else "disconnected"
            rows += [(p[0], *(c[:2] if c else (None, None)), status) for p, c in zip(fixes, chosen or [None] * len(fixes))]
    columns = list(zip(*rows)) or [()] * 4
    kinds = {"seq": pa.int64(), "edge_id": pa.int64(), "frac": pa.float64(), "status": pa.string()}
    named = {n: pa.array(c, kind) for (n, kind), c in zip(kinds.items(), columns)}
    same = [pa.array([head[n][0].as_py()] * len(rows), head.schema.field(n).type) for n in head.column_names]
    return pa.table({**dict(zip(head.column_names, same)), **named})


class Graph:
    """Adjacency of one clipped network, with bounded searches from a snapped point."""

    def __init__(self, network):
        self.edges, self.at, self.next = {}, {}, {}
        names = ("edge_id", "a_node", "b_node", "ax", "ay", "bx", "by")
        for edge, a, b, ax, ay, bx, by in zip(*(network[n] for n in names)):
            if edge in self.edges:
                continue
            length = hypot(bx - ax, by - ay)
            self.edges[edge] = (a, b, length)
            self.at[a], self.at[b] = (ax, ay), (bx, by)
            self.next.setdefault(a, []).append((b, length))
            self.next.setdefault(b, []).append((a, length))

    def place(self, cand):
        a, b, _ = self.edges[cand[0]]
        (ax, ay), (bx, by) = self.at[a], self.at[b]
        return ax + (bx - ax) * cand[1], ay + (by - ay) * cand[1]

    def reach(self, cand, limit):
        """Distances and predecessors of the nodes within `limit` of a snapped point."""
        a, b, length = self.edges[cand[0]]
        dist, prev = {}, {}
        heap = [(cand[1] * length, a, -1), ((1 - cand[1]) * length, b, -1)]  # -1: the snapped point itself
        heapq.heapify(heap)
        while heap:
            d, node, before = heapq.heappop(heap)
            if node in dist or d > limit:
                continue
            dist[node], prev[node] = d, before
            for other, step in self.next[node]:
                if other not in dist:
                    heapq.heappush(heap, (d + step, other, node))
        return dist, prev

    def path(self, source, target, reached, limit):
        """(length, node path) between two snapped points, or None beyond the limit."""
        a, b, length = self.edges[target[0]]
        dist, prev = reached
        options = [(dist[n] + off, n) for n, off in ((a, target[1] * length), (b, (1 - target[1]) * length)) if n in dist]
        if source[0] == target[0]:
            options.append((abs(source[1] - target[1]) * length, None))
        if not options:
            return None
        total, node = min(options, key=lambda o: (o[0], o[1] is not None, o[1] or 0))
        if total > limit:
            return None
        nodes = []
        while node is not None and node != -1:
            nodes.append(node)
            node = prev[node]
        return total, nodes[::-1]


def transition_cost(start, end, route, travelled, uncertainty, continuity):
    """Length misfit, shape misfit and a travel prior of one route between two fixes."""
    observed = hypot(end[0] - start[0], end[1] - start[1])
    return _cost(observed, [_off(p, start, end) for p in route], travelled, uncertainty, continuity)


def _cost(observed, off, travelled, uncertainty, continuity):
    misfit = max(0.0, abs(travelled - observed) - 2 * uncertainty) / max(20.0, observed * 0.4, uncertainty * 2)
    if continuity:
        prior = travelled / continuity
    else:
        prior = travelled / max(20.0, 2 * uncertainty) if uncertainty else 0.0
    mean = max(0.0, sum(off) / len(off) - uncertainty)
    worst = max(0.0, max(off) - 2 * uncertainty)
    return misfit + prior + 2 * (mean / max(12.0, uncertainty)) ** 2 + 1.5 * (worst / max(25.0, uncertainty * 2)) ** 2


def _off(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
    return hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def _known(accuracy):
    return min(50.0, max(3.0, accuracy)) if accuracy and 0 < accuracy < inf else 0.0


def retrace_cost(before, point, after, length, uncertainty):
    """Price of riding straight back over an edge without a turn in the fixes."""
    u, v = (point[0] - before[0], point[1] - before[1]), (after[0] - point[0], after[1] - point[1])
    nu, nv = hypot(*u), hypot(*v)
    if nu and nv and (u[0] * v[0] + u[1] * v[1]) / (nu * nv) < -0.5 and min(nu, nv) >= max(8.0, 2 * uncertainty):
        return 0.0
    return length / max(5.0, uncertainty) if uncertainty else 8.0 + min(8.0, length / 10)


def best_sequence(points, layers, graph):
    """Cheapest connected choice of one candidate per point, or None.

    With a known accuracy all arrivals at a candidate merge. Without it the edge
    of arrival stays part of the state, because turning back costs extra. No cost is negative: what the
    few nearest candidates alone come to is a limit, and nothing above it is searched.
    """
    known = {}
    few = [layer[:3] for layer in layers]
    first = _search(points, few, graph, inf, known)
    if few == layers:
        return first and first[1]
    found = _search(points, layers, graph, first[0] if first else inf, known)
    return found and found[1]


def _search(points, layers, graph, most, known_routes):
    """(cost, choice) of the cheapest sequence, which costs `most` at most, or None. Searches of the network are kept in `known_routes`."""
    unc = [_known(p[3]) for p in points]
    known = [u for u in unc if u > 0]
    continuity = max(20.0, median(known)) if known else None

    def emission(gap, i):
        return (max(0.0, gap - unc[i]) / (unc[i] or 15.0)) ** 2

    # What the later points cost at least; a little is left for rounding.
    behind, rest = [0.0], most * (1 + 1e-9) + 1e-9
    for k in range(len(points) - 1, 0, -1):
        behind.append(behind[-1] + min(emission(c[2], k) for c in layers[k]))
    behind.reverse()
    # state: (candidate, edge of arrival, index the arrival started from) -> (cost, trail)
    states = {(i, None, None): (emission(c[2], 0), None) for i, c in enumerate(layers[0])}
    trails, spots = [], [graph.place(c) for c in layers[0]]
    for k in range(1, len(points)):
        start, end = points[k - 1][1:3], points[k][1:3]
        observed = hypot(end[0] - start[0], end[1] - start[1])
        limit = max(120.0, observed * 4 + 60)
        u, both = max(unc[k - 1], unc[k]), unc[k - 1] > 0 and unc[k] > 0
        emit = [emission(c[2], k) for c in layers[k]]
        before, spots = spots, [graph.place(c) for c in layers[k]]
        # The cost above which an arrival at a candidate is no use; a connected arrival lowers it.
        best, fresh = [rest - behind[k]] * len(layers[k]), {}
        wanted = [j for j, e in enumerate(emit) if e <= best[j]]
        off_before, off_spots = [_off(p, start, end) for p in before], [_off(p, start, end) for p in spots]
        least = _least_costs(before, spots, off_before, off_spots, observed, u, continuity) if both and continuity else None
        off_nodes = {}
        for prior in sorted(states, key=lambda s: (states[s][0], s[0])):
            cost, i = states[prior][0], prior[0]
            source = layers[k - 1][i]
            bounds = least[i] if least else None
            for j in wanted:
                if cost + emit[j] + (bounds[j] if bounds else 0.0) > best[j]:
                    continue  # a lower bound already loses
                target = layers[k][j]
                # Only candidates that may still win search the network.
                if (k, source) not in known_routes:
                    known_routes[k, source] = (graph.reach(source, limit), {})
                reached, scored = known_routes[k, source]
                if target not in scored:
                    found = graph.path(source, target, reached, limit)
                    if found:
                        off = [off_before[i]]
                        for n in found[1]:
                            if n not in off_nodes:
                                off_nodes[n] = _off(graph.at[n], start, end)
                            off.append(off_nodes[n])
                        off.append(off_spots[j])
                        found = _cost(observed, off, found[0], u, continuity) + emit[j], found
                    scored[target] = found
                if not scored[target]:
                    continue
                total, (travelled, nodes) = cost + scored[target][0], scored[target][1]
                state = (j, None, None)
                if not both:
                    moved = travelled > 0
                    if moved and prior[1] == source[0] and nodes and prior[2] is not None and nodes[0] == prior[3]:
                        total += retrace_cost(points[prior[2]][1:3], start, end, graph.edges[source[0]][2], max(unc[prior[2]], u))
                    state = (j, target[0], k - 1, nodes[-1] if nodes else None) if moved else (j, *prior[1:])
                if total < fresh.get(state, (inf, None))[0]:
                    fresh[state] = (total, prior)
                    if both:
                        best[j] = min(best[j], total)
        if not fresh:
            return None
        trails.append(fresh)
        states = fresh
    state = min(states, key=lambda s: (states[s][0], s[0]))
    cost, picked = states[state][0], [state[0]]
    for trail in reversed(trails):
        state = trail[state][1]
        picked.append(state[0])
    return cost, [layers[k][i] for k, i in enumerate(reversed(picked))]


def _least_costs(before, spots, off_before, off_spots, observed, uncertainty, continuity):
    """A lower bound of the cost of every transition: no route is shorter than the straight line, and both its ends count."""
    a, b = np.array(before), np.array(spots)
    straight = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    misfit = np.maximum(0.0, straight - observed - 2 * uncertainty) / max(20.0, observed * 0.4, uncertainty * 2)
    worst = np.maximum(0.0, np.maximum(np.array(off_before)[:, None], np.array(off_spots)[None, :]) - 2 * uncertainty)
    # A little less, so that rounding never puts a bound above its cost.
    return ((misfit + straight / continuity + 1.5 * (worst / max(25.0, uncertainty * 2)) ** 2) * (1 - 1e-9) - 1e-9).tolist()


def observed_intervals(fixes: DataFrame, edges: DataFrame, snap_m: float = 8.0, accuracy_m: float = 10.0,
                       gap_ms: int = 30_000, leg_m: float = 50.0) -> DataFrame:
    """Intervals of sections that at least three consecutive fixes support.

    A fix counts for its nearest section when no other section lies within
    max(3 m, accuracy) of it. Two fixes in a row on one section make a leg
    without detour; a leg needs a neighbouring leg. Everything is an equi-join
    on (journey, section, seq), so no journey is gathered anywhere.
    """
    e = edges.select("edge_id", "eligible", "ax", "ay", "bx", "by", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("len"))
    wide = snap_m + accuracy_m
    right = segment_cells(e, "ax", "ay", "bx", "by", 40.0, wide)
    near = planar_cell(fixes.where((F.col("accuracy_m") > 0) & (F.col("accuracy_m") <= accuracy_m)), "x", "y", 40.0).join(right, ["_cx", "_cy"])
    near = near.withColumn("d", F.round(point_segment("x", "y", "ax", "ay", "bx", "by"), 6)).where(F.col("d") <= wide)
    near = near.withColumn("at", segment_fraction("x", "y", "ax", "ay", "bx", "by") * F.col("len"))
    w = Window.partitionBy("journey_id", "seq")
    ranked = near.withColumn("best", F.min("d").over(w)).where("best <= %f AND d <= best + greatest(3, accuracy_m)" % snap_m)
    single = (ranked.groupBy("journey_id", "seq").agg(F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("edge_id", "eligible", "at", "x", "y", "t_ms")])
              .where("n = 1 AND eligible").drop("n", "eligible"))
    nxt = single.select("journey_id", "edge_id", (F.col("seq") - 1).alias("seq"), F.col("at").alias("at2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t_ms").alias("t2"))
    moved = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    legs = (single.join(nxt, ["journey_id", "edge_id", "seq"]).withColumn("m", moved)
            .where((F.col("t2") > F.col("t_ms")) & (F.col("t2") - F.col("t_ms") <= gap_ms) & F.col("m").between(1, leg_m)
                   & (F.abs(F.col("at2") - F.col("at")) <= F.col("m") * 1.5 + 3)))
    legs = legs.select("journey_id", "edge_id", "seq", "at", "at2")
    beside = legs.select("journey_id", "edge_id", (F.col("seq") - 1).alias("seq")).unionByName(legs.select("journey_id", "edge_id", (F.col("seq") + 1).alias("seq"))).distinct()
    return legs.join(beside, ["journey_id", "edge_id", "seq"], "left_semi").select(
        "journey_id", "edge_id", "seq", F.least("at", "at2").alias("lo_m"), F.greatest("at", "at2").alias("hi_m"))


def score_hypotheses(fixes: DataFrame, paths: DataFrame, witness_m: float = 25.0, margin: float = 0.1) -> DataFrame:
    """Score path hypotheses of each journey and name the best, or call them ambiguous.

    `paths` holds hypothesis, edge_id, base_m and the edge ends. A fix witnesses a
    path within `witness_m`; coverage of all thirds and rising offsets count.
    """
    right = segment_cells(paths, "ax", "ay", "bx", "by", 50.0, witness_m)
    near = planar_cell(fixes, "x", "y", 50.0).join(right, ["_cx", "_cy"])
    near = near.withColumn("d", F.round(point_segment("x", "y", "ax", "ay", "bx", "by"), 6)).where(F.col("d") <= witness_m)
    offset = F.col("base_m") + segment_fraction("x", "y", "ax", "ay", "bx", "by") * F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    one = near.groupBy("journey_id", "hypothesis", "seq").agg(F.min(F.struct("d", offset.alias("o"))).alias("b"))
    one = one.select("journey_id", "hypothesis", "seq", "b.d", "b.o")
    nxt = one.select("journey_id", "hypothesis", (F.col("seq") - 1).alias("seq"), F.col("o").alias("o2"))
    pairs = one.join(nxt, ["journey_id", "hypothesis", "seq"], "left")
    span = fixes.groupBy("journey_id").agg(F.count("*").alias("fixes"), F.max("seq").alias("last"))
    agg = (pairs.join(span, "journey_id").groupBy("journey_id", "hypothesis")
           .agg(F.count("*").alias("witnesses"), F.count_if(F.col("o2") > F.col("o")).alias("rising"), F.count("o2").alias("steps"),
                F.sum(F.greatest(F.lit(0.0), F.col("o2") - F.col("o"))).alias("metres"), F.any_value("fixes").alias("fixes"),
                F.countDistinct(F.floor(F.col("seq") * 3 / (F.col("last") + 1))).alias("thirds")))
    agg = agg.join(quantiles(one, ["journey_id", "hypothesis"], "d", {"median_m": 0.5}, 1.0), ["journey_id", "hypothesis"])
    scored = agg.withColumn("score", F.round(F.col("witnesses") / F.col("fixes") + F.coalesce(F.try_divide("rising", "steps"), F.lit(0.0)) - F.col("median_m") / 100, 6)).where("thirds = 3 AND witnesses >= 3")
    w = Window.partitionBy("journey_id").orderBy(F.desc("score"), "hypothesis")
    top = scored.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    return top.groupBy("journey_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("hypothesis"))).alias("hypothesis"), F.max("score").alias("score"),
        F.when(F.count("*") == 1, "best").when(F.max("score") - F.min("score") >= margin, "best").otherwise("ambiguous").alias("verdict"))
