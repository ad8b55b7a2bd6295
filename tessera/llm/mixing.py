"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Sizes are numbers of words. Each source gets a share of all words by its weight, at most ``cap`` times its own size;
the excess is reshared by weight until no source is above. For each source the document rates r solve

    minimise  sum of s/x * (r ln r - r)   subject to   sum of s * r = target,  0 <= r <= cap

with s the document's size and x = 1 + ln(1 + s / mean size of the source). The dual has one multiplier for each
source and the solution r = min(cap, exp(multiplier * x)): rates tilted exponentially, by more for longer documents.
Newton steps on the dual run for all sources at once, each as one aggregation over (source, size) counts; a step that
leaves its bracket is replaced by bisection. Whole parts of the rates become copies. The rest of a target goes to
documents in the order of hash / fraction, so that a document's chance of one more copy follows its fraction; the last
one gives the words that are still missing (a partial copy), so each source ends on its target, rounded down.

The order is found without bringing a source together: documents fall into hash slots per source, whose number grows
with the documents; the slots are summed first, and only inside one slot are single documents ordered.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
taken 0 times; rows that are equal in every respect may exchange their results; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.runtime import CHUNK, free_name, in_chunks, lookup, materialise, pick, row_key, running_total

WEIGHTS = (5, 2, 1)
#: Hash slots of each source at least, and documents for which there is one more.
SLOTS, SLOT_ROWS = 4096, 100_000
MAX_STEPS = 80


def words(text: Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(per_source: DataFrame, weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, source_size) -> the same with target. Each round of resharing is one aggregation to two numbers."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = running_total(per_source, order, F.lit(1), "_rank", "mix-sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = materialise(placed.withColumn("_w", F.get(cycle, (F.col("_rank") % len(weights)).cast("int"))), "mix-weights")
    most = F.col("source_size") * F.lit(float(cap))
    whole, free = placed.agg(F.sum("source_size"), F.sum("_w")).first()
    level = (whole or 0) / free if free else 0.0
    while True:
        # the level rises in every round in which another source meets its limit, so this ends
        held, free = placed.agg(
            F.sum(F.when(F.col("_w") * F.lit(level) >= most, most).otherwise(0.0)), F.sum(F.when(F.col("_w") * F.lit(level) < most, F.col("_w")).otherwise(0.0))
        ).first()
        above = (whole or 0) - (held or 0.0)
        if not free or above / free <= level * (1 + 1e-15):
            break
        level = above / free
    return placed.select("source", "source_size", F.least(F.col("_w") * F.lit(level), most).alias("target"))


def _rate(multiplier: Column, x: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(multiplier * x))


def multipliers(counts: DataFrame, goals: DataFrame, cap: int = 3, tolerance: float = 1e-9) -> DataFrame:
    """Newton on the dual. ``counts``: source, size, n, mean_size; ``goals``: source, target. -> source, multiplier."""
    log_cap = F.lit(cap).cast("double")
    x = F.lit(1.0) + F.log1p(F.col("size") / F.col("mean_size"))
    live = materialise(counts.where("size > 0").withColumn("_x", x), "mix-counts")
    sums = goals.where("target > 0").select("source", "target", "source_size")
    # all x exceed 1, so the multiplier lies between ln(target / size) and ln(cap)
    state = materialise(
        sums.select(
            F.col("source"),
            "target",
            F.lit(0.0).alias("multiplier"),
            F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))).alias("low"),
            F.log(log_cap).alias("high"),
        ),
        "mix-state",
    )
    for _ in range(MAX_STEPS):
        s = state.alias("s")
        joined = live.alias("l").join(s, F.col("l.source").eqNullSafe(F.col("s.source")))
        tokens = F.col("size") * F.col("n") * _rate(F.col("multiplier"), F.col("_x"), cap)
        inner = F.col("multiplier") * F.col("_x") < F.log(log_cap)
        step = (
            joined.groupBy(F.col("s.source").alias("source"), "target", "multiplier", "low", "high")
            .agg(F.sum(tokens).alias("got"), F.sum(F.when(inner, tokens * F.col("_x")).otherwise(0.0)).alias("slope"))
            .withColumn("gap", F.col("got") - F.col("target"))
            .withColumn("low", F.when(F.col("gap") <= 0, F.col("multiplier")).otherwise(F.col("low")))
            .withColumn("high", F.when(F.col("gap") >= 0, F.col("multiplier")).otherwise(F.col("high")))
            .withColumn("newton", F.when(F.col("slope") > 0, F.col("multiplier") - F.col("gap") / F.col("slope")))
        )
        # a bracket that can't be halved any more is as near as numbers go
        narrow = F.col("high") - F.col("low") <= F.lit(1e-14) * F.greatest(F.lit(1.0), F.abs("low"))
        good = (F.abs("gap") <= F.col("target") * F.lit(tolerance)) | narrow
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        step = step.withColumn(
            "next", F.when(good, F.col("multiplier")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        ).withColumn("_open", ~good)
        state = materialise(step.select("source", "target", F.col("next").alias("multiplier"), "low", "high", "_open"), "mix-state")
        if state.where("_open").isEmpty():
            break
        state = state.drop("_open")
    else:
        raise RuntimeError(f"the dual did not settle in {MAX_STEPS} steps")
    return state.select("source", "multiplier")


def _documents(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, key: list[Column]) -> DataFrame:
    docs = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("_k"),
        words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_hash"),
        key[0].alias("_k1"),
        key[1].alias("_k2"),
    )
    return materialise(docs, "mix-documents")


def mix(df: DataFrame, weights=WEIGHTS, cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, rate, copies, partial, taken.

    taken = copies * size + partial; partial words, fewer than size, are the start of one more, cut copy.
    """
    key = [F.lit(0).cast("long")] * 2  # rows need not be found again
    rows = _mixed(_documents(df, id_col, text_col, source_col, seed, key), weights, cap)
    return rows.drop("_k1", "_k2").withColumnsRenamed({"id": id_col, "source": source_col})


def copies(df: DataFrame, weights=WEIGHTS, cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself, in the columns of ``df``: each row as often as it is taken, and cut copies with their first words.

    A column n_chars, if there is one, follows the text of a cut copy; other columns may have any name. Rows are known
    by their content, so a second reading of ``df`` may be split in any way.
    """
    rows = _mixed(_documents(df, id_col, text_col, source_col, seed, row_key(df)), weights, cap)
    k1, k2, n, partial, times, first, cut = (free_name(df.columns, x) for x in ("k1", "k2", "copies", "partial", "times", "first", "cut"))
    # of all rows of a source at most one is taken in part
    plan = rows.where("taken > 0").groupBy(F.col("_k1").alias(k1), F.col("_k2").alias(k2))
    plan = plan.agg(F.sum("copies").alias(n), F.max("partial").alias(partial))
    sizes = rows.groupBy(F.col("_k1").alias(k1), F.col("_k2").alias(k2)).agg(F.count(F.lit(1)).alias(times))
    plan = materialise(plan.join(sizes, [k1, k2]), "mix-plan")
    total, most = plan.agg(F.coalesce(F.sum(times), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    keyed = df.withColumns(dict(zip((k1, k2), row_key(df), strict=True)))
    full = pick(keyed, plan, [k1, k2], times, total)
    part = full.where(F.col(partial) > 0).withColumn(cut, F.col(partial))
    whole = in_chunks(full, n, first, most)
    each = F.least(F.lit(CHUNK).cast("long"), F.col(n) - F.col(first)).cast("int")
    whole = whole.withColumn(cut, F.explode(F.array_repeat(F.lit(0).cast("long"), each))).drop(first)
    full = whole.unionByName(part)
    ws = r"[\x20\x09-\x0D]"
    start = F.array_join(F.slice(F.split(F.regexp_replace(F.col(text_col), f"^{ws}+", ""), f"{ws}+"), F.lit(1), F.greatest(F.col(cut), F.lit(1)).cast("int")), " ")
    full = full.withColumn(text_col, F.when(F.col(cut) > 0, start).otherwise(F.col(text_col)))
    if "n_chars" in df.columns:
        full = full.withColumn("n_chars", F.when(F.col(cut) > 0, F.length(text_col).cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return full.select(*[F.col(f"`{c}`") for c in df.columns])


def _mixed(docs: DataFrame, weights, cap: int) -> DataFrame:
    counts = docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    per_source = counts.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_docs")
    )
    per_source = materialise(per_source, "mix-sums")
    total = per_source.agg(F.coalesce(F.sum("source_docs"), F.lit(0))).first()[0]
    slots_of = max(SLOTS, -(-total // SLOT_ROWS))
    goals = materialise(targets(per_source.select("source", "source_size"), weights, cap), "mix-targets")
    means = per_source.select(F.col("source").alias("_s"), "source_docs", F.greatest(F.col("source_size") / F.col("source_docs"), F.lit(1e-9)).alias("mean_size"))
    counts = counts.join(means.drop("source_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    solved = multipliers(counts, goals, cap)
    facts = (
        goals.join(means, F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .join(solved.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        .drop("_s")
        .withColumn("_k", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
        .drop("source")
    )
    facts = materialise(facts, "mix-facts")
    rated = lookup(docs, facts, "_k", "source_docs", total).drop("_k", "source_docs")
    x = F.lit(1.0) + F.log1p(F.col("size") / F.col("mean_size"))
    rate = F.when((F.col("size") > 0) & F.col("multiplier").isNotNull(), _rate(F.col("multiplier"), x, cap)).otherwise(0.0)
    rated = rated.withColumn("rate", rate).withColumn("_base", F.floor(F.col("rate") + F.lit(1e-6)).cast("long"))
    fraction = F.greatest(F.col("rate") - F.col("_base"), F.lit(0.0))
    u = (F.pmod(F.col("_hash"), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    # order of further copies: u / fraction, with a place after all others for those without a fraction
    late = u / F.greatest(fraction, F.lit(1e-9))
    rated = rated.withColumn("_late", late).withColumn(
        "_slot", F.when(late < 2, F.floor(late * (slots_of // 2))).otherwise(F.lit(slots_of) + F.pmod(F.shiftright("_hash", 40), F.lit(slots_of))).cast("int")
    )
    room = F.when(F.col("_base") < cap, F.col("size")).otherwise(F.lit(0))
    rated = materialise(rated.withColumn("_room", room), "mix-rated")
    slots = rated.groupBy("source", "_slot", "target").agg(F.sum("_room").alias("_room"), F.sum(F.col("_base") * F.col("size")).alias("_sure"))
    ahead = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sure = slots.withColumn("_sure", F.sum("_sure").over(Window.partitionBy("source"))).withColumn("_ahead", F.coalesce(F.sum("_room").over(ahead), F.lit(0)))
    sure = sure.select(
        F.col("source").alias("_s"), F.col("_slot").alias("_k"), (F.floor(F.col("target") + F.lit(1e-6)).cast("long") - F.col("_sure") - F.col("_ahead")).alias("_left")
    )
    sure = materialise(sure, "mix-slots")
    placed = rated.join(sure, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slot") == F.col("_k")))
    inside = Window.partitionBy("source", "_slot").orderBy("_late", "_hash", F.col("id").asc_nulls_last(), "_k1", "_k2").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_left") - F.coalesce(F.sum("_room").over(inside), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(left, F.col("_room")))
    placed = placed.withColumn("_extra", extra)
    whole = F.when((F.col("_room") > 0) & (F.col("_extra") == F.col("_room")), 1).otherwise(0)
    return placed.select(
        "_k1",
        "_k2",
        "id",
        "source",
        "size",
        "source_size",
        "target",
        "rate",
        (F.col("_base") + whole).alias("copies"),
        F.when(whole == 1, F.lit(0)).otherwise(F.col("_extra")).cast("long").alias("partial"),
        (F.col("_base") * F.col("size") + F.col("_extra")).cast("long").alias("taken"),
    )
