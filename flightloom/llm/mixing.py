"""Mixing sources to target weights by capped water-filling. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.llm.common import WORD_PATTERN, settled

WEIGHTS = (5.0, 2.0, 1.0)
#: Parts of a source's seeded order whose sizes are summed at a time while the cut is sought, twice over.
SLICE_BITS = 12
#: Rows of a plan that are broadcast; a larger one is joined by a shuffle, each source dealt over keys of so many rows.
PLAN_ROWS, KEY_ROWS = 100_000, 4_000_000


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = 3.0, budget: float | None = None) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): shares of all sizes, or of `budget`.

    Sources by code point, null last, weigh `weights` in turn. Targets stop at max_epochs times the source's size and the
    excess is shared again by weight until none is above. The end of those rounds is found directly: sources fill up in
    the order of cap / weight, and the level is the first at which what is left, by weight, fills no further source. If
    all sources fill up, all targets are caps. The table has one row a source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto = full.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    words = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(every)
    rows = rows.withColumn("capped", F.sum("cap").over(upto) - F.col("cap"))
    rows = rows.withColumn("open_weight", F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))
    rows = rows.withColumn("level", (words - F.col("capped")) / F.col("open_weight"))
    holds = F.col("level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("water", F.min(F.when(holds, F.struct(F.row_number().over(full).alias("at"), "level"))).over(every)["level"])
    return rows.select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


def _order(seed: int) -> Column:
    """A document's place in its source's seeded order, a long: by id and text, so only equal rows share one."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _slice(place: Column, level: int) -> Column:
    """Bits of the place that tell its part of the order: the first SLICE_BITS, then the next."""
    return F.shiftrightunsigned(place, 64 - SLICE_BITS * level).bitwiseAND((1 << SLICE_BITS) - 1).cast("int")


def _cut(rows: DataFrame, goal: DataFrame, at: Sequence[str]) -> DataFrame:
    """Of each source the part (columns `at`, in order) in which `need` words are reached: (source_key, *at, need), need
    being what is left for that part. Sums are partial before the shuffle; a window holds one source's sums."""
    sums = rows.groupBy("source_key", *at).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    running = Window.partitionBy("source_key").orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("words").over(running))
    inside = sums.join(goal, "source_key").where((F.col("need") > 0) & (F.col("upto") - F.col("words") < F.col("need")) & (F.col("upto") >= F.col("need")))
    return settled(inside.select("source_key", *at, "n", (F.col("need") - F.col("upto") + F.col("words")).alias("need")))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = 3.0, seed: int = 29, budget: float | None = None) -> tuple[DataFrame, DataFrame]:
    """What to take. First (source_key, source_size, target, rows, whole, cut_place): all documents `whole` times, and once
    more those whose place lies before cut_place. Second (source_key, place, quota, n): of the n equal rows at this place,
    not before the cut, `quota` are taken once more.

    Sizes are summed by source and part of the order: first 4,096 parts, then 4,096 within the part that holds the cut,
    then its places. So no task sees a whole source, nor all copies of a row. What is still short at the cut, less than
    one document, goes to the document that fits it best, if one does; so words taken differ from their target by less
    than half a document.
    """
    size = word_count(F.col("text").cast("string"))
    sized = settled(docs.select(F.col("source").cast("string"), _source_key().alias("source_key"), size.alias("size"), _order(seed).alias("place")))
    totals = settled(sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    goal = targets(totals.select("source", "source_size"), weights, max_epochs, budget).withColumn("source_key", _source_key())
    goal = goal.join(totals.select("source_key", "rows"), "source_key")
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    goal = settled(goal.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    near, found = sized, goal.select("source_key", "need")
    for level in (1, 2):
        part = f"part{level}"
        near = near.withColumn(part, _slice(F.col("place"), level))
        found = _cut(near, found, [part]).drop("n")
        near = near.join(found.select("source_key", part), ["source_key", part], "left_semi")
        found = found.drop(part)
    # The order of equal leading bits is the order of the places as unsigned numbers.
    near = near.withColumn("rest", F.shiftrightunsigned(F.shiftleft("place", 2 * SLICE_BITS), 2 * SLICE_BITS))
    ends = _cut(near, found, ["rest", "place", "size"])
    ends = ends.withColumn("quota", F.floor(F.col("need") / F.greatest("size", F.lit(1))).cast("long"))
    ends = settled(ends.withColumn("short", F.col("need") - F.col("quota") * F.col("size")))
    gap = F.abs(F.col("size") - F.col("short"))
    spread = F.broadcast(ends) if ends.count() <= PLAN_ROWS else ends
    others = sized.join(spread.select("source_key", F.col("place").alias("cut_place"), "short", "quota", F.col("n").alias("cut_n")), "source_key")
    others = others.where((F.col("short") > 0) & (gap < F.col("short")) & (_unsigned("place") >= _unsigned("cut_place")) & ((F.col("place") != F.col("cut_place")) | (F.col("quota") < F.col("cut_n"))))
    best = settled(others.groupBy("source_key").agg(F.min(F.struct(gap.alias("gap"), "place")).alias("best")).select("source_key", F.col("best.place").alias("place")))
    counted = sized.join(F.broadcast(best) if best.count() <= PLAN_ROWS else best, ["source_key", "place"], "left_semi").groupBy("source_key", "place").agg(F.count("*").alias("n"))
    quotas = ends.select("source_key", "place", "quota", "n").union(counted.select("source_key", "place", F.lit(1).cast("long").alias("quota"), "n"))
    quotas = quotas.groupBy("source_key", "place").agg(F.sum("quota").alias("quota"), F.max("n").alias("n")).where("quota > 0")
    plan_ = goal.join(ends.select("source_key", F.col("place").alias("cut_place")), "source_key", "left").select("source_key", "source_size", "target", "rows", "whole", "cut_place")
    return settled(plan_), settled(quotas)


def _unsigned(name: str) -> Column:
    """A long whose signed order is the unsigned order of column `name`."""
    return F.col(name).bitwiseXOR(F.lit(-(2**63)))


def _joined(rows: DataFrame, plan_: DataFrame) -> DataFrame:
    """`rows` with their source's plan. The plan has one row a source: a small one is broadcast, else both sides are dealt
    by source and a salt, as many as the largest source needs for keys of KEY_ROWS rows."""
    n, most = plan_.agg(F.count("*"), F.max("rows")).first()
    if n <= PLAN_ROWS:
        return rows.join(F.broadcast(plan_), "source_key")
    salts = max(1, -(-most // KEY_ROWS))
    spread = plan_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("place"), F.lit(salts))).join(spread, ["source_key", "salt"]).drop("salt")


def mixed(docs: DataFrame, planned: tuple[DataFrame, DataFrame], seed: int = 29, keep: Sequence[str] | None = None) -> DataFrame:
    """(row, size, source_size, target, copies, taken): row holds all columns of `docs`, or those of `keep`, and taken is
    copies times size.

    Rows are told by their place alone, but for those at a place of which only some are taken once more, where equal rows
    repeat: these few places' rows are written, numbered part by part, and the first of them taken.
    """
    plan_, quotas = planned
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    placed = [row.alias("row"), word_count(F.col("text").cast("string")).alias("size"), _source_key().alias("source_key"), _order(seed).alias("place")]
    small = quotas.count() <= PLAN_ROWS
    told = F.broadcast(quotas) if small else quotas
    rest = _joined(docs.select(placed), plan_).join(told.where("quota >= n").select("source_key", "place", F.lit(1).alias("taken_too")), ["source_key", "place"], "left")
    some = quotas.where("quota < n")
    before = F.coalesce(_unsigned("place") < _unsigned("cut_place"), F.lit(False))
    repeated = not some.isEmpty()
    some = F.broadcast(some) if small else some
    if repeated:
        rest = rest.join(some.select("source_key", "place"), ["source_key", "place"], "left_anti")
    out = rest.withColumn("copies", F.col("whole") + F.when(before | F.col("taken_too").isNotNull(), 1).otherwise(0))
    out = out.select("row", "size", "source_size", "target", "copies")
    if repeated:
        numbered = docs.select(*placed, F.monotonically_increasing_id().alias("number"))
        out = out.unionByName(_first_of(_joined(numbered, plan_).join(some, ["source_key", "place"]), before))
    return out.select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _first_of(rows: DataFrame, before: Column) -> DataFrame:
    """The first `quota` of each place's rows once more. A place may hold any number of equal rows: they are counted by
    the part of the input that they come from, and numbered within it."""
    rows = settled(rows.withColumn("part", F.shiftright("number", 33)))
    counts = rows.groupBy("source_key", "place", "part").agg(F.count("*").alias("here"))
    running = Window.partitionBy("source_key", "place").orderBy("part")
    starts = counts.withColumn("start", F.sum("here").over(running) - F.col("here")).drop("here")
    within = Window.partitionBy("source_key", "place", "part").orderBy("number")
    numbered = rows.join(starts, ["source_key", "place", "part"]).withColumn("at", F.col("start") + F.row_number().over(within))
    return numbered.select("row", "size", "source_size", "target", (F.col("whole") + F.when(before | (F.col("at") <= F.col("quota")), 1).otherwise(0)).alias("copies"))


def mix_sizes(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = 3.0, seed: int = 29) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of each row of `docs` (doc_id, source, text).

    Null texts and texts without words have size 0; a null source is a source. A source without words has target 0. Rows
    equal in doc_id and text share one place in their source's order: as many of them are taken once more as the target
    asks for. Null ids are ids. An empty table gives an empty table.
    """
    rows = docs.select("doc_id", "source", "text")
    out = mixed(rows, plan(rows, weights, max_epochs, seed), seed, keep=["doc_id"])
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = 3.0, seed: int = 29) -> DataFrame:
    """The mixture itself: each row of `docs` as often as it is taken, with the columns of `docs`, as for mix_sizes().
    Rows without words are taken like their neighbours in the order."""
    out = mixed(docs, plan(docs, weights, max_epochs, seed), seed).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
