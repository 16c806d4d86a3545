"""Mixing sources to target weights by pivotal dependent rounding (operator 3, native).

Every source gets a target size; each of its documents is then wanted
``target / size`` times.  The whole part is taken for certain.  The
fractional parts are rounded by pivotal steps: two documents pass mass
between them, in inverse proportion to their sizes so that the expected
words stay, until one's fraction is 0 or 1.  Which way the mass goes is
drawn so that each fraction keeps its expectation, from a hash of the two
ids, so reruns agree.

The steps run as a reduction tree.  Documents are dealt by hash, within
their source, into groups of about ``GROUP``; a fold settles all but at most
one document of a group; the unsettled ones enter the next round, until
each source has one group, whose last document is rounded to the nearer
side.  A source's total is therefore off by half of one document at most.

Repeated rows (same id, source and size) are one unit: their fractions add
up, whole copies go to the first of them, and only the remainder enters the
tree.  So neither a hot source nor a hot id makes a large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadkit.llm.graph import kept

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # times a source's size: the largest target, and the most a document is repeated
GROUP = 48


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn.  The
    total of all sizes is shared by weight; a target stops at ``most`` times
    its source's size and the excess is shared again by weight.  That fixed
    point is a water level: with sources in order of limit over weight, the
    first whose limit the level does not reach sets it.  The table has one
    row a source, so its windows are small whatever the number of documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = (per.withColumn("turn", turn)
              .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") + 1).cast("int")))
              .withColumn("limit", most * F.col("source_size")))
    by_level = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    stepped = ranked.withColumn("level", level)
    # Levels rise until the first source that is not full, and fall after it.
    return (stepped.withColumn("level", F.max("level").over(everything))
            .select("source", "source_size",
                    F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target")))


def _chance(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _settle(first: Column, second: Column, round_no: int) -> Column:
    """One pivotal step: struct(done, left); ``left`` has fraction 0 or 1 when both are settled."""
    wa, wb = first["weight"], second["weight"]
    pa, pb = first["part"], second["part"]
    up_a, up_b = (1 - pa) * wa, pb * wb  # mass that can go from second to first: until first is 1 or second 0
    down_a, down_b = pa * wa, (1 - pb) * wb
    up, down = F.least(up_a, up_b), F.least(down_a, down_b)
    rises = _chance(first["unit"], second["unit"], F.lit(round_no)) * (up + down) < down
    a_done = F.when(rises, up_a <= up_b).otherwise(down_a <= down_b)
    a_part = F.when(rises, F.when(up_a <= up_b, 1.0).otherwise(pa + up_b / wa)).otherwise(
        F.when(down_a <= down_b, 0.0).otherwise(pa - down_b / wa))
    b_part = F.when(rises, F.when(up_b <= up_a, 0.0).otherwise(pb - up_a / wb)).otherwise(
        F.when(down_b <= down_a, 1.0).otherwise(pb + down_a / wb))
    new_a = F.struct(first["unit"].alias("unit"), wa.alias("weight"), a_part.alias("part"))
    new_b = F.struct(second["unit"].alias("unit"), wb.alias("weight"), b_part.alias("part"))
    return F.struct(F.when(a_done, new_a).otherwise(new_b).alias("done"),
                    F.when(a_done, new_b).otherwise(new_a).alias("left"))


def _fold(units: Column, round_no: int) -> Column:
    """Settle an array of units by pivotal steps; the unit still open is the last of the result."""
    def step(done: Column, unit: Column) -> Column:
        last = F.element_at(done, -1)
        pair = F.array(_settle(last, unit, round_no))
        both = F.flatten(F.transform(pair, lambda p: F.array(p["done"], p["left"])))
        settled = (last["part"] <= 0) | (last["part"] >= 1)
        return F.when(settled, F.concat(done, F.array(unit))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), both))

    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), F.slice(units, 1, 1), step)


def round_parts(units: DataFrame, group: int = GROUP) -> DataFrame:
    """(unit, extra) with extra 0 or 1 for rows (source, unit, weight, part), 0 < part < 1."""
    open_units = kept(units, "mix-open")
    settled: list[DataFrame] = []
    round_no = 0
    while True:
        counts = open_units.groupBy("source").agg(F.count(F.lit(1)).alias("open"))
        most = counts.agg(F.max("open")).first()[0]
        if not most:
            break
        dealt = (open_units.join(counts, open_units.source.eqNullSafe(counts.source)).drop(counts.source)
                 .withColumn("group", F.pmod(F.xxhash64("unit", F.lit(round_no)),
                                             F.ceil(F.col("open") / group).cast("long"))))
        unit = F.struct(F.xxhash64("unit", F.lit(~round_no)).alias("order"), "unit", "weight", "part")
        folded = (dealt.groupBy("source", "group").agg(F.array_sort(F.collect_list(unit)).alias("units"))
                  .withColumn("units", F.transform("units", lambda u: F.struct(
                      u["unit"].alias("unit"), u["weight"].alias("weight"), u["part"].alias("part"))))
                  .withColumn("units", _fold(F.col("units"), round_no)))
        rows = kept(folded.select("source", F.inline("units")), "mix-round")
        done = rows.filter("part <= 0 or part >= 1")
        settled.append(done.select("unit", F.col("part").cast("int").alias("extra")))
        open_units = rows.filter("part > 0 and part < 1")
        round_no += 1
        if most <= group:  # one group a source: at most one open unit each
            settled.append(open_units.select("unit", F.when(F.col("part") >= 0.5, 1).otherwise(0).alias("extra")))
            break
    if not settled:
        return open_units.select("unit", F.lit(0).alias("extra"))
    out = settled[0]
    for other in settled[1:]:
        out = out.unionByName(other)
    return out


def copy_counts(sized: DataFrame, *, weights=WEIGHTS, most: int = MOST, group: int = GROUP) -> DataFrame:
    """Units of rows (doc_id, source, size, mark) with the copies they get.

    One row per distinct (doc_id, source, size, mark): rows (how many there
    are), source_size, target, base (copies of each row), extra (rows that
    get one copy more, the first ones).
    """
    unit = ["doc_id", "source", "size", "mark"]
    targets = source_targets(sized, weights, most)
    units = (sized.groupBy(*unit).agg(F.count(F.lit(1)).alias("rows"))
             .withColumn("unit", F.xxhash64(*unit)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.col("rows") * (F.col("rate") - F.col("base"))
    priced = (units.join(targets, units.source.eqNullSafe(targets.source)).drop(targets.source)
              .withColumn("rate", rate)
              .withColumn("base", F.least(F.floor("rate"), F.lit(most)).cast("long"))
              .withColumn("sure", F.floor(wanted).cast("long"))
              .withColumn("part", wanted - F.col("sure")))
    priced = kept(priced, "mix-units")
    # Two units may share a hash: both are then one unit of the tree, with one outcome.
    rounded = round_parts(priced.filter((F.col("part") > 0) & (F.col("size") > 0))
                          .groupBy("source", "unit")
                          .agg(F.sum("size").cast("double").alias("weight"), F.max("part").alias("part")), group)
    return (priced.join(rounded, "unit", "left")
            .select(*unit, "rows", "source_size", "target", "base",
                    (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("extra")))


def mix_sizes(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
              source_column: str = "source", **how) -> DataFrame:
    """One row per row of ``documents``: doc_id, size, source_size, target, taken, copies.

    ``size`` is the text's number of words (null: 0), ``taken`` the words the
    mix takes of it, copies counted.  A null source is a source of its own.
    Documents without words, and sources without any, take nothing.  An empty
    table gives no rows; other columns are ignored.
    """
    sized = documents.select(documents[id_column].alias("doc_id"), documents[source_column].alias("source"),
                             size_of(documents[text_column]).alias("size"), F.lit(0).alias("mark"))
    units = copy_counts(sized, **how)
    each = units.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    copies = F.col("base") + (F.col("row") <= F.col("extra")).cast("long")
    return (each.withColumn("copies", copies)
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                    "copies"))


def mix(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source", **how) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, columns unchanged.

    Rows equal in id, source, size and text share their copies: the extra
    ones repeat one of them.
    """
    columns = documents.columns
    mark = F.xxhash64(documents[text_column])
    marked = documents.select(
        F.struct(*[documents[c] for c in columns]).alias("row"), documents[id_column].alias("doc_id"),
        documents[source_column].alias("source"), size_of(documents[text_column]).alias("size"), mark.alias("mark"))
    units = kept(copy_counts(marked.select("doc_id", "source", "size", "mark"), **how), "mix-copies")
    unit = ["doc_id", "source", "size", "mark"]
    same = None
    renamed = units.select(*[F.col(c).alias(f"u_{c}") for c in unit], "rows", "base", "extra")
    for c in unit:
        match = marked[c].eqNullSafe(renamed[f"u_{c}"])
        same = match if same is None else same & match
    joined = marked.join(renamed, same)
    alone = (joined.withColumn("copies", F.col("base") + F.when(F.col("rows") == 1, F.col("extra")).otherwise(0))
             .filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))))
    if not units.filter("rows > 1 and extra > 0").limit(1).count():
        return alone.select("row.*")
    several = (joined.filter("rows > 1 and extra > 0")
               .groupBy(*[f"u_{c}" for c in unit]).agg(F.first("row").alias("row"), F.first("extra").alias("extra"))
               .select("row", F.explode(F.sequence(F.lit(1).cast("long"), "extra"))))
    return alone.select("row.*").unionByName(several.select("row.*"))
