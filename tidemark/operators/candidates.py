"""Candidate search as batch jobs: spaces, proposals, selection, budgets and trajectories.

A candidate is ``candidate_id, values map<string,double>, origin, generation, parents``. The
space is a short tuple of ``Parameter`` declarations, so per-parameter rules become column
expressions. Random draws hash ``(seed, id, parameter)``: the same candidate gets the same
draw whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.registry import Registry
from tidemark.operators.ranks import ranked, top_k
from tidemark.session import durable

# Share of a parameter's range used as perturbation scale.
MAGNITUDE = {"small": 0.05, "medium": 0.15, "large": 0.35}


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str  # continuous, integer, categorical, boolean
    low: float | None = None
    high: float | None = None
    choices: tuple[float, ...] = ()
    resolution: float = 0.01
    neutral: float = 0.0
    modality: str = "visual"

    def __post_init__(self) -> None:
        if self.kind in ("continuous", "integer"):
            if self.low is None or self.high is None or self.high <= self.low:
                raise ValueError(f"{self.name} needs increasing bounds")
        elif self.kind in ("categorical", "boolean"):
            if not self.choices or (self.kind == "boolean" and len(self.choices) != 2):
                raise ValueError(f"{self.name} needs its choices")
        else:
            raise ValueError(f"unknown parameter kind {self.kind}")

    @property
    def ranged(self) -> bool:
        return self.kind in ("continuous", "integer")


def check_space(space: Sequence[Parameter]) -> None:
    if len({p.name for p in space}) != len(space):
        raise ValueError("parameter names must be unique")


def uniform(seed: int, *parts: Column | str) -> Column:
    """Uniform draw on [0, 1) from a hash; stable under any partitioning."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def gaussian(seed: int, *parts: Column | str) -> Column:
    """Standard normal draw (Box-Muller on two hashed uniforms)."""
    u1 = F.greatest(uniform(seed, *parts, F.lit("u")), F.lit(1e-15))
    u2 = uniform(seed, *parts, F.lit("v"))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)


def quantize(p: Parameter, v: Column) -> Column:
    """Snap to the resolution; half-even like the declared rule."""
    if not p.ranged:
        return v
    if p.kind == "integer":
        return F.rint(v) + 0.0
    return F.round(F.rint(v / p.resolution) * p.resolution, 12) + 0.0  # no negative zero


def clamp(p: Parameter, v: Column) -> Column:
    if p.ranged:
        return quantize(p, F.greatest(F.lit(float(p.low)), F.least(F.lit(float(p.high)), v)))
    # Nearest choice; the first of equals.
    gaps = [F.struct(F.abs(v - float(c)).alias("g"), F.lit(i).alias("i"), F.lit(float(c)).alias("c")) for i, c in enumerate(p.choices)]
    return F.array_min(F.array(*gaps))["c"]


def in_domain(p: Parameter, v: Column) -> Column:
    if p.ranged:
        return v.between(float(p.low) - 1e-12, float(p.high) + 1e-12)
    return reduce(lambda a, b: a | b, [F.abs(v - float(c)) <= 1e-12 for c in p.choices])


def value_map(cols: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in sorted(cols.items()) for x in (F.lit(k), v.cast("double"))])


def get(p: Parameter, values: str = "values") -> Column:
    return F.element_at(F.col(values), F.lit(p.name))


def fingerprint(space: Sequence[Parameter], values: str = "values") -> Column:
    """Identity of a point: sha256 of its canonical ``name=value`` list."""
    parts = [F.concat(F.lit(p.name + "="), F.format_string("%.6f", get(p, values))) for p in sorted(space, key=lambda x: x.name)]
    return F.sha2(F.concat_ws(";", *parts), 256)


def key_problems(space: Sequence[Parameter], values: str = "values") -> tuple[Column, Column]:
    """(missing names, unknown names) of a candidate's map."""
    names = F.array(*[F.lit(p.name) for p in space])
    keys = F.map_keys(values)
    return F.array_except(names, keys), F.array_except(keys, names)


def violations(space: Sequence[Parameter], values: str = "values") -> Column:
    """Names of the parameters outside their declared domain."""
    return F.array_compact(F.array(*[F.when(~in_domain(p, get(p, values)), F.lit(p.name)) for p in space]))


def is_neutral(space: Sequence[Parameter], values: str = "values") -> Column:
    return reduce(lambda a, b: a & b, [get(p, values) == float(p.neutral) for p in space])


def frozen_violations(space: Sequence[Parameter], frozen: Sequence[str], values: str = "values") -> Column:
    """Parameters a candidate moves although their modality is frozen."""
    moved = [F.when(get(p, values) != float(p.neutral), F.lit(p.name)) for p in space if p.modality in set(frozen)]
    return F.array_compact(F.array(*moved)) if moved else F.array().cast("array<string>")


def distance(space: Sequence[Parameter], a: Column, b: Column) -> Column:
    """Mean of ranged |a - b| / width and categorical 0 / 1."""
    terms = []
    for p in space:
        x, y = F.element_at(a, F.lit(p.name)), F.element_at(b, F.lit(p.name))
        terms.append(F.abs(x - y) / float(p.high - p.low) if p.ranged else F.when(x == y, 0.0).otherwise(1.0))
    return reduce(lambda u, v: u + v, terms) / float(len(terms))


def literal_values(space: Sequence[Parameter], values: dict[str, float]) -> Column:
    return value_map({p.name: F.lit(float(values[p.name])) for p in space})


# --- proposals -------------------------------------------------------------------------


def cardinality(space: Sequence[Parameter], steps: int) -> float:
    total = 1.0
    for p in space:
        total *= len(p.choices) if not p.ranged else (int(p.high) - int(p.low) + 1 if p.kind == "integer" else max(steps, 1))
    return total


def space_size(space: Sequence[Parameter]) -> int | None:
    """How many different points a space has, exactly; None when it has no end.

    A continuous axis counts its bounds and the multiples of its resolution between them, as
    ``quantize`` and ``clamp`` leave no others. An axis without a positive resolution has no end.
    """
    total = 1
    for p in space:
        if p.kind == "integer":
            total *= int(p.high) - int(p.low) + 1
        elif not p.ranged:
            total *= len(set(p.choices))
        elif p.resolution and p.resolution > 0:
            low, high, step = (Fraction(str(x)) for x in (p.low, p.high, p.resolution))
            first, last = -(-low // step), high // step
            inside = max(0, int(last - first + 1))
            total *= inside + (low % step != 0) + (high % step != 0)
        else:
            return None
    return total


def space_left(evaluations: DataFrame, keys: Sequence[str], space: Sequence[Parameter], fp: str = "fp") -> DataFrame:
    """(keys, seen, size, left): distinct fingerprints of each search against the size of its space.

    ``fp`` is a column of fingerprints or is made of ``values``. Null size and left mean a space without end.
    """
    marked = evaluations if fp in evaluations.columns else evaluations.withColumn(fp, fingerprint(space))
    size = F.lit(None if (n := space_size(space)) is None else float(n)).cast("double")
    seen = marked.select(*keys, fp).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"))
    return seen.select(*keys, "seen", size.alias("size"), F.greatest(F.lit(0.0), size - F.col("seen")).alias("left"))


def axis_value(p: Parameter, steps: int, index: Column) -> Column:
    if not p.ranged:
        return F.element_at(F.array(*[F.lit(float(c)) for c in p.choices]), index.cast("int") + 1)
    if p.kind == "integer":
        return F.lit(float(int(p.low))) + index
    if steps < 2:
        return quantize(p, F.lit((p.low + p.high) / 2))
    return quantize(p, F.lit(float(p.low)) + F.lit(float(p.high - p.low)) * index / F.lit(float(steps - 1)))


def grid(spark: SparkSession, space: Sequence[Parameter], steps: int, limit: float) -> DataFrame:
    """Every grid point, refused above ``limit`` points. A row number is taken apart axis by axis, so nothing is joined."""
    check_space(space)
    size = cardinality(space, steps)
    if size > limit:
        raise ValueError(f"a grid of {size:.0f} points is above the limit of {limit:.0f}")
    rest, cols = F.col("id"), {}
    for p in reversed(space):
        n = int(cardinality([p], steps))
        cols[p.name] = axis_value(p, steps, F.pmod(rest, F.lit(n)))
        rest = F.floor(rest / F.lit(n))
    return spark.range(int(size)).select(F.col("id").alias("candidate_id"), value_map(cols).alias("values"))


def random_candidates(ids: DataFrame, key: str, space: Sequence[Parameter], seed: int) -> DataFrame:
    """One seeded point per id."""
    check_space(space)
    cols = {}
    for p in space:
        u = uniform(seed, key, F.lit(p.name))
        if p.kind == "continuous":
            cols[p.name] = quantize(p, float(p.low) + u * float(p.high - p.low))
        elif p.kind == "integer":
            cols[p.name] = F.floor(float(int(p.low)) + u * float(int(p.high) - int(p.low) + 1)).cast("double")
        else:
            cols[p.name] = F.element_at(F.array(*[F.lit(float(c)) for c in p.choices]), F.floor(u * len(p.choices)).cast("int") + 1)
    return ids.select(key, value_map(cols).alias("values"))


def neighbours_of(points: DataFrame, key: str, space: Sequence[Parameter], magnitude: str = "small", steps: Sequence[float] = (-1.0, 1.0)) -> DataFrame:
    """Axis-aligned neighbours: one parameter moves, clamped; unchanged and repeated ones drop."""
    moves = []
    for p in space:
        base = get(p)
        for s in steps:
            if p.ranged:
                moved = clamp(p, base + float((p.high - p.low) * MAGNITUDE[magnitude] * s))
            else:
                choices = F.array(*[F.lit(float(c)) for c in p.choices])
                at = F.greatest(F.array_position(choices, base), F.lit(1)) - 1
                moved = F.element_at(choices, F.pmod(at + int(s), F.lit(len(p.choices))).cast("int") + 1)
            moves.append(F.struct(F.lit(p.name).alias("parameter"), base.alias("old"), moved.alias("new")))
    long = points.select(key, "values", F.explode(F.array(*moves)).alias("m")).where("m.new <> m.old")
    moved_map = F.map_from_entries(
        F.transform(F.map_entries("values"), lambda e: F.struct(e["key"], F.when(e["key"] == F.col("m.parameter"), F.col("m.new")).otherwise(e["value"])))
    )
    return long.select(F.col(key).alias("parent_id"), "m.parameter", F.col("m.old").alias("old_value"), F.col("m.new").alias("new_value"), moved_map.alias("values")).dropDuplicates(
        ["parent_id", "parameter", "new_value"]
    )


MUTATIONS = Registry("mutation")
MUTATIONS.add(
    "continuous", lambda p, v, seed, key, scale: clamp(p, v + gaussian(seed, key, F.lit(p.name)) * float((p.high - p.low) * scale)),
    "gaussian step of the scaled range, clamped", "may return the same value after clamping",
)
MUTATIONS.add(
    "integer",
    lambda p, v, seed, key, scale: clamp(
        p,
        v + (F.floor(uniform(seed, key, F.lit(p.name), F.lit("n")) * max(1, round((p.high - p.low) * scale))) + 1)
        * F.when(uniform(seed, key, F.lit(p.name), F.lit("s")) < 0.5, -1).otherwise(1),
    ),
    "whole step of at least one", "clamping may undo it at a bound",
)


def _swap(p: Parameter, v: Column, seed: int, key: Column, scale: float) -> Column:
    others = F.filter(F.array(*[F.lit(float(c)) for c in p.choices]), lambda c: c != v)
    n = F.size(others)
    pick = F.floor(uniform(seed, key, F.lit(p.name)) * n).cast("int")
    return F.when(n > 0, F.get(others, pick)).otherwise(v)


MUTATIONS.add("categorical", _swap, "another choice, never the current one", "needs two choices")
MUTATIONS.add(
    "boolean", lambda p, v, seed, key, scale: F.when(v == float(p.choices[0]), float(p.choices[1])).otherwise(float(p.choices[0])),
    "the other of two values", "always changes the value",
)


def mutate(points: DataFrame, key: str, space: Sequence[Parameter], seed: int, magnitude: str = "medium", rate: float = 1.0) -> DataFrame:
    """One child per point; each parameter moves with chance ``rate``, at least one always does."""
    check_space(space)
    k = F.col(key)
    draws = [uniform(seed, k, F.lit(p.name), F.lit("touch")) for p in space]
    none = reduce(lambda a, b: a & b, [d > rate for d in draws])
    forced = F.floor(uniform(seed, k, F.lit("forced")) * len(space))
    cols = {}
    for i, p in enumerate(space):
        touched = (draws[i] <= rate) | (none & (forced == i))
        new = MUTATIONS.get(p.kind).build(p, get(p), seed, k, MAGNITUDE[magnitude])
        cols[p.name] = F.when(touched, new).otherwise(get(p))
    return points.select(k.alias("parent_id"), value_map(cols).alias("values"), F.lit("mutation").alias("origin"))


def crossover(pairs: DataFrame, space: Sequence[Parameter], seed: int) -> DataFrame:
    """Uniform crossover of ``left_id, left_values, right_id, right_values``."""
    cols = {
        p.name: F.when(uniform(seed, "left_id", "right_id", F.lit(p.name)) < 0.5, get(p, "left_values")).otherwise(get(p, "right_values"))
        for p in space
    }
    return pairs.select(F.array("left_id", "right_id").alias("parents"), value_map(cols).alias("values"), F.lit("crossover").alias("origin"))


def explore_rate(start: float, decay: float, floor: float, generation: int) -> float:
    return max(floor, start * decay**generation)


def next_generation(evaluations: DataFrame, space: Sequence[Parameter], elites: int, seed: int, explore: float) -> DataFrame:
    """Proposals per search: mutated and neighbouring elites, crossed elite pairs, a random share.

    Elites come from a per-group limit. Pairs are consecutive elites, so no pair product.
    """
    best = top_k(evaluations.where("eligible"), ["search_id"], [F.col("fitness").desc(), F.col("candidate_id")], elites, "elite_rank")
    base = best.select("search_id", F.concat_ws("-", F.col("search_id").cast("string"), F.col("candidate_id").cast("string")).alias("eid"), "values", "elite_rank")
    owner = base.select("search_id", "eid")
    mutated = mutate(base, "eid", space, seed).select(F.col("parent_id").alias("eid"), "values", "origin")
    near = neighbours_of(base, "eid", space).select(F.col("parent_id").alias("eid"), "values", F.lit("neighbour").alias("origin"))
    w = Window.partitionBy("search_id").orderBy("elite_rank")
    pairs = base.select("search_id", F.col("eid").alias("left_id"), F.col("values").alias("left_values"), F.lead("eid").over(w).alias("right_id"), F.lead("values").over(w).alias("right_values")).where("right_id IS NOT NULL")
    crossed = crossover(pairs, space, seed).select(F.col("parents")[0].alias("eid"), "values", "origin")
    lucky = base.where(uniform(seed, "eid", F.lit("explore")) < explore)
    fresh = random_candidates(lucky, "eid", space, seed + 1).select("eid", "values", F.lit("random_sample").alias("origin"))
    proposals = mutated.unionByName(near).unionByName(crossed).unionByName(fresh).join(owner, "eid")
    return proposals.where(~is_neutral(space)).withColumn("fp", fingerprint(space)).dropDuplicates(["search_id", "fp"])


def candidate_pool(
    ids: DataFrame, key: str, space: Sequence[Parameter], incumbents: DataFrame, evaluated: DataFrame, seed: int, local_share: float
) -> DataFrame:
    """Random points and perturbed incumbents, distinct, without what was already evaluated."""
    fresh = random_candidates(ids, key, space, seed).select("values", F.lit("random_sample").alias("origin"))
    local = mutate(incumbents.where(uniform(seed, "candidate_id", F.lit("local")) < local_share), "candidate_id", space, seed, "small").select("values", F.lit("neighbour").alias("origin"))
    pool = fresh.unionByName(local).where(~is_neutral(space)).withColumn("fp", fingerprint(space))
    return pool.dropDuplicates(["fp"]).join(evaluated.select("fp").distinct(), "fp", "left_anti")


# --- evaluation log --------------------------------------------------------------------


def with_state(evaluations: DataFrame) -> DataFrame:
    """Usable (a number), eligible (usable and feasible)."""
    usable = (F.col("status") == "evaluated") & F.col("fitness").isNotNull()
    return evaluations.withColumn("usable", usable).withColumn("eligible", usable & F.col("feasible"))


@dataclass(frozen=True)
class Guardrail:
    guardrail_id: str
    kind: str  # floor, ceiling, max_relative_drop, max_duration_change
    bound: float
    objective_id: str | None = None


def check_guardrails(
    candidates: DataFrame, rails: Sequence[Guardrail], roots: dict[str, float], raw: str = "raw_objectives", duration: str = "duration_change",
    unchecked_fails: bool = False,
) -> DataFrame:
    """Violated and unchecked guardrails of every candidate; unmeasured is neither pass nor fail."""
    broken, unknown = [], []
    for g in rails:
        name = F.lit(g.guardrail_id)
        if g.kind == "max_duration_change":
            broken.append(F.when(F.abs(duration) > g.bound + 1e-9, name))
            continue
        v = F.element_at(F.col(raw), F.lit(g.objective_id))
        if g.kind == "max_relative_drop":
            root = roots.get(g.objective_id)
            if not root:
                unknown.append(name)
                continue
            unknown.append(F.when(v.isNull(), name))
            broken.append(F.when((F.lit(float(root)) - v) / abs(root) > g.bound + 1e-12, name))
            continue
        unknown.append(F.when(v.isNull(), name))
        broken.append(F.when(v < g.bound if g.kind == "floor" else v > g.bound, name))
    empty = F.array().cast("array<string>")
    out = candidates.withColumn("violations", F.array_compact(F.array(*broken)) if broken else empty).withColumn(
        "unchecked", F.array_compact(F.array(*unknown)) if unknown else empty
    )
    ok = F.size("violations") == 0
    return out.withColumn("feasible", ok & (F.size("unchecked") == 0) if unchecked_fails else ok)


def best_of(evaluations: DataFrame, keys: Sequence[str], feasible: bool = True) -> DataFrame:
    """Best eligible candidate of each search (or best disqualified one); ties to the lower id."""
    pool = evaluations.where("eligible" if feasible else "usable AND NOT feasible")
    return pool.groupBy(*keys).agg(
        F.max_by(F.struct("candidate_id", "fitness"), F.struct("fitness", -F.col("candidate_id"))).alias("b")
    ).select(*keys, F.col("b.candidate_id").alias("best_id"), F.col("b.fitness").alias("best_fitness"))


def tied_with_best(evaluations: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Usable candidates within the threshold of the best."""
    best = best_of(evaluations, keys)
    return evaluations.where("usable").join(best, list(keys)).where(
        (F.col("candidate_id") != F.col("best_id")) & (F.abs(F.col("best_fitness") - F.col("fitness")) <= threshold)
    ).select(*keys, "candidate_id", "fitness")


def population(evaluations: DataFrame, keys: Sequence[str], keep: int | None = None, fraction: float | None = None, minimum: int = 1) -> DataFrame:
    """Rank eligible candidates, keep the top ones, and give every other its reason."""
    keys = list(keys)
    eligible = evaluations.where("eligible")
    order = [F.col("fitness").desc(), F.col("candidate_id").asc()]
    sizes = eligible.groupBy(*keys).agg(F.count(F.lit(1)).alias("of"))
    limit = F.lit(keep) if keep is not None else F.greatest(F.lit(minimum), F.floor(F.col("of") * float(fraction)).cast("int"))
    placed = ranked(eligible, keys, order, "rank").join(sizes, keys).withColumn("survives", F.col("rank") <= limit)
    label = F.when(F.col("survives"), "kept").otherwise("outside_beam" if keep is not None else "halved")
    kept = placed.select(*keys, "candidate_id", F.col("rank").cast("int").alias("rank"), "of", label.alias("reason"))
    others = evaluations.where("NOT eligible").select(
        *keys, "candidate_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("bigint").alias("of"),
        F.when(F.col("usable"), "guardrail").when(F.col("status") == "evaluation_failed", "failed").otherwise("not_measurable").alias("reason"),
    )
    return kept.unionByName(others)


def priority_order(candidates: DataFrame, pinned: Sequence[object], eliminated: Sequence[object], cached: DataFrame, elite_ids: Sequence[object], key: str = "candidate_id") -> DataFrame:
    """Scheduling score: pinned, cached, elite descendant, earlier generation, proposal order."""
    known = cached.select("fp").distinct().withColumn("_cached", F.lit(True))
    isin = lambda c, xs: c.isin(list(xs)) if xs else F.lit(False)
    queue = candidates.where(~isin(F.col(key), eliminated)).join(known, "fp", "left")
    elite = F.exists("parents", lambda p: isin(p, elite_ids))
    score = (
        F.when(isin(F.col(key), pinned), 1000.0).otherwise(0.0) + F.when(F.col("_cached"), 100.0).otherwise(0.0)
        + F.when(elite, 10.0).otherwise(0.0) + F.greatest(F.lit(0.0), 5.0 - F.col("generation")) - F.col("proposal_index") * 0.001
    )
    return queue.withColumn("priority", score).drop("_cached")


def pairwise_diversity(members: DataFrame, keys: Sequence[str], space: Sequence[Parameter]) -> DataFrame:
    """Mean mixed-type distance over all pairs, without forming a pair.

    For sorted values the summed |x - y| is a weighted sum of the values by rank; equal
    categories are counted. NULL below two members.
    """
    keys = list(keys)
    cells = members.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(p.name).alias("p"), get(p).alias("v")) for p in space])).alias("c")
    ).select(*keys, "c.p", "c.v")
    hist = cells.groupBy(*keys, "p", "v").agg(F.count(F.lit(1)).alias("c"))
    # One row per distinct quantised value: bounded by range / resolution.
    w = Window.partitionBy(*keys, "p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("c").over(Window.partitionBy(*keys, "p"))
    placed = hist.withColumn("_r", F.coalesce(F.sum("c").over(w), F.lit(0))).withColumn("_n", n)
    c, rank, total = F.col("c"), F.col("_r"), F.col("_n")
    ranged_sum = F.col("v") * (2 * (c * rank + c * (c + 1) / 2) - c * (total + 1))
    width = F.lit(None).cast("double")
    for p in space:
        if p.ranged:
            width = F.when(F.col("p") == p.name, F.lit(float(p.high - p.low))).otherwise(width)
    per = placed.groupBy(*keys, "p").agg(
        F.max("_n").alias("n"), F.sum(ranged_sum).alias("_abs"), F.sum(c * c).alias("_same")
    ).withColumn("_w", width)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    term = F.when(F.col("_w").isNotNull(), F.col("_abs") / F.col("_w")).otherwise((F.col("n") * F.col("n") - F.col("_same")) / 2)
    return per.groupBy(*keys).agg(
        F.max("n").alias("members"), F.when(F.max("n") >= 2, F.avg(F.when(F.col("n") >= 2, term / pairs))).alias("diversity")
    )


def greedy_batch(
    pool: DataFrame, key: str, space: Sequence[Parameter], score: Column, count: int, minimum_distance: float = 0.0, novelty_weight: float = 0.0
) -> list[dict]:
    """Pick ``count`` candidates one by one over the whole pool.

    With ``novelty_weight`` each pick maximises the mix of scaled score and distance to the
    chosen; else the best that is at least ``minimum_distance`` away, relaxed to fill. Each
    round is one aggregate; only the chosen rows (``count``) reach the driver.
    """
    # Written once: every round then reads plain narrow columns.
    slim = durable(
        pool.select(F.col(key).alias("_id"), score.cast("double").alias("_s"), *[get(p).alias(f"_v_{p.name}") for p in space]).where("_s IS NOT NULL")
    )
    spread = None
    if novelty_weight:
        spread = slim.agg(F.min("_s").alias("lo"), F.max("_s").alias("hi")).first()
    chosen: list[dict] = []

    def best(frame: DataFrame, by: Column) -> dict | None:
        # A sort with limit one keeps a single row per task.
        rows = frame.orderBy(by.desc(), "_id").limit(1).collect()
        return rows[0].asDict() if rows else None

    def gap(c: dict) -> Column:
        # As ``distance``, on plain columns: no map is made for a row.
        terms = []
        for p in space:
            x, y = F.col(f"_v_{p.name}"), F.lit(float(c[f"_v_{p.name}"]))
            terms.append(F.abs(x - y) / float(p.high - p.low) if p.ranged else F.when(x == y, 0.0).otherwise(1.0))
        return reduce(lambda u, v: u + v, terms) / float(len(terms))

    def far(frame: DataFrame) -> DataFrame:
        for c in chosen:
            frame = frame.where(gap(c) >= minimum_distance)
        return frame

    def novelty() -> Column:
        gaps = [gap(c) for c in chosen]
        return gaps[0] if len(gaps) == 1 else F.least(*gaps)

    while len(chosen) < count:
        left = slim.where(~F.col("_id").isin([c["_id"] for c in chosen])) if chosen else slim
        relaxed = False
        if not chosen:
            pick = best(left, F.col("_s"))
        elif novelty_weight:
            width = spread["hi"] - spread["lo"]
            scaled = (F.col("_s") - spread["lo"]) / width if width else F.lit(0.0)
            pick = best(left, (1 - novelty_weight) * scaled + novelty_weight * novelty())
        else:
            pick = best(far(left), F.col("_s"))
            if pick is None:
                pick, relaxed = best(left, F.col("_s")), True
        if pick is None:
            break
        chosen.append({**pick, "relaxed": relaxed})
    return chosen


def trajectory(evaluations: DataFrame, keys: Sequence[str], order: str, width: float | None = None) -> DataFrame:
    """Best eligible fitness so far along each search; the first to reach it holds it."""
    from tidemark.operators.sequence import running

    log = evaluations.withColumn("_f", F.when(F.col("eligible"), F.col("fitness")))
    seen = running(log, keys, [order], {"_prior": ("max", "_f")}, width, exclusive=True)
    fresh = F.col("_f").isNotNull() & (F.col("_prior").isNull() | (F.col("_f") > F.col("_prior")))
    marked = seen.withColumn("is_new_best", fresh).withColumn("best_fitness", F.greatest("_f", "_prior")).withColumn(
        "_holder", F.when(fresh, F.col("candidate_id"))
    )
    held = running(marked, keys, [order], {"best_id": ("last", "_holder")}, width)
    return held.drop("_f", "_prior", "_holder")


def patience(generations: DataFrame, keys: Sequence[str], minimum_improvement: float) -> DataFrame:
    """Generations since the last gain above the threshold over the last *believed* best.

    Small drift never resets the count. One row per generation (``generation, best_fitness``),
    folded as an array per search.
    """
    ordered = F.array_sort(F.collect_list(F.struct("generation", "best_fitness")))
    start = F.struct(F.lit(None).cast("double").alias("believed"), F.lit(0).alias("stale"))

    def step(acc: Column, g: Column) -> Column:
        gain = g["best_fitness"].isNotNull() & (acc["believed"].isNull() | (g["best_fitness"] - acc["believed"] > minimum_improvement))
        return F.struct(
            F.when(gain, g["best_fitness"]).otherwise(acc["believed"]).alias("believed"),
            F.when(gain, F.lit(0)).otherwise(acc["stale"] + 1).alias("stale"),
        )

    return generations.groupBy(*keys).agg(ordered.alias("_g")).select(
        *keys, F.aggregate("_g", start, step).alias("p")
    ).select(*keys, F.col("p.believed").alias("believed_best"), F.col("p.stale").alias("generations_without_gain"))


def efficiency(evaluations: DataFrame, keys: Sequence[str], order: str, root: str, threshold: float) -> DataFrame:
    """Best, gain over the root, evaluations and seconds to best, hit and failure rates, ties.

    ``root`` is the column holding the root's fitness; ``cached`` and ``wall_seconds`` come
    from the log.
    """
    keys = list(keys)
    best = best_of(evaluations, keys)
    facts = evaluations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluations"), F.max(root).alias("root_fitness"),
        F.avg(F.when(F.col("usable"), 0.0).otherwise(1.0)).alias("failure_rate"),
        F.avg(F.when(F.col("cached"), 1.0).otherwise(0.0)).alias("cache_hit_rate"), F.sum("wall_seconds").alias("wall_seconds"),
    )
    at = evaluations.join(best, keys).where(F.col("candidate_id") == F.col("best_id")).select(*keys, F.col(order).alias("_at"))
    upto = evaluations.join(at, keys).where(F.col(order) <= F.col("_at")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluations_to_best"), F.sum("wall_seconds").alias("wall_seconds_to_best")
    )
    ties = tied_with_best(evaluations, keys, threshold).groupBy(*keys).agg(F.count(F.lit(1)).alias("tied"))
    gain = F.col("best_fitness") - F.col("root_fitness")
    return (
        facts.join(best, keys, "left").join(upto, keys, "left").join(ties, keys, "left")
        .withColumn("improvement", gain).withColumn("resolvable", gain > threshold).withColumn("tied", F.coalesce("tied", F.lit(0)))
    )


def ledger(evaluations: DataFrame, keys: Sequence[str], limits: dict[str, float | None], cost_per_hour: float) -> DataFrame:
    """Spent, remaining and exhausted per limit of each search, in long form."""
    spent = evaluations.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("max_candidates"), F.sum(F.when(F.col("cached"), 0.0).otherwise(1.0)).alias("max_runs"),
        F.sum("wall_seconds").alias("max_wall_seconds"), (F.sum("wall_seconds") / 3600.0 * cost_per_hour).alias("max_cost"),
        (F.max("generation") + 1).cast("double").alias("max_generations"),
    )
    cells = [
        F.struct(F.lit(n).alias("limit"), F.col(n).alias("spent"), F.lit(limits.get(n)).cast("double").alias("ceiling"))
        for n in ("max_candidates", "max_runs", "max_wall_seconds", "max_cost", "max_generations")
    ]
    out = spent.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
    left = F.greatest(F.lit(0.0), F.col("ceiling") - F.col("spent"))
    remaining = F.when(F.col("ceiling").isNotNull(), left)
    return out.withColumn("remaining", remaining).withColumn("exhausted", F.coalesce(remaining <= 0, F.lit(False))).withColumn(
        "low", F.coalesce((remaining > 0) & (F.col("ceiling") > 0) & (remaining / F.col("ceiling") <= 0.2), F.lit(False))
    )


def admit(requested: Column, remaining_candidates: Column, remaining_runs: Column) -> Column:
    """How many of a batch may proceed under the two limits a new candidate consumes."""
    free = F.lit(2_147_483_647)
    allowed = F.least(F.coalesce(F.floor(remaining_candidates).cast("int"), free), F.coalesce(F.floor(remaining_runs).cast("int"), free))
    return F.greatest(F.lit(0), F.least(requested, allowed))


STOP_ORDER = ("max_candidates", "max_runs", "max_wall_seconds", "max_cost", "max_generations")


def stop_verdict(books: DataFrame, best: DataFrame, stale: DataFrame, keys: Sequence[str], target: float | None, patience_limit: int, user_stopped: bool = False, left: DataFrame | None = None) -> DataFrame:
    """First reason to stop: user, budgets, target, patience, a searched-out space (``space_left``); NULL to go on."""
    keys = list(keys)
    flags = books.groupBy(*keys).agg(*[F.max(F.when(F.col("limit") == n, F.col("exhausted"))).alias(f"_{n}") for n in STOP_ORDER])
    verdict = F.when(F.lit(user_stopped), "user_stopped")
    for n in STOP_ORDER:
        verdict = verdict.when(F.col(f"_{n}"), n)
    if target is not None:
        verdict = verdict.when(F.col("best_fitness") >= target, "target_reached")
    verdict = verdict.when(F.col("generations_without_gain") >= patience_limit, "no_improvement")
    joined = flags.join(best, keys, "left").join(stale, keys, "left")
    if left is not None:
        verdict = verdict.when(F.col("left") <= 0, "space_exhausted")
        joined = joined.join(left.select(*keys, "left"), keys, "left")
    return joined.select(*keys, verdict.alias("stop_reason"))


def cache_lookup(candidates: DataFrame, cache: DataFrame, prefix: Sequence[str]) -> DataFrame:
    """Reuse results by identity prefix and fingerprint; failures are never stored."""
    stored = cache.where("status <> 'evaluation_failed'").groupBy(*prefix, "fp").agg(
        F.max_by(F.struct("status", "fitness"), "sequence").alias("_c")
    )
    return candidates.join(stored, [*prefix, "fp"], "left").withColumn("hit", F.col("_c").isNotNull()).withColumn(
        "cached_fitness", F.col("_c.fitness")
    ).drop("_c")


def changed_parameters(candidates: DataFrame, key: str, space: Sequence[Parameter]) -> DataFrame:
    """One evidence row per parameter a candidate moves away from neutral."""
    cells = [F.struct(F.lit(p.name).alias("parameter"), get(p).alias("value"), F.lit(float(p.neutral)).alias("neutral"), F.lit(p.modality).alias("modality")) for p in space]
    long = candidates.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.*").where("value <> neutral")
    return long.withColumn("evidence_id", F.concat_ws("-", F.col(key).cast("string"), "parameter"))
