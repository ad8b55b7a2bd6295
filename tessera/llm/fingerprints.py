"""Order MinHash fingerprints (DataFrame operations only).

The k-mers are runs of K words, each numbered by how often it occurred before, so that repeats count. Every numbered
k-mer has a hash; its top bits deal it into one of BUCKETS buckets. Of each bucket the TUPLE k-mers with the smallest
hashes are taken, put back in the order of the text, and hashed as a tuple: moving, adding or dropping words changes
tuples in step with the edit distance, also where the set of k-mers stays. The likeness of two fingerprints is the share
of equal tuples among the buckets that either fills.

Everything happens in arrays inside a row: a k-mer's hash and place are packed in one number, so plain sorts of numbers
group equal k-mers and buckets. Occurrence numbers come in rounds: a number that has reached the step of its round
looks whole steps back, and the step grows by STRIDE; for each text the rounds end when its longest run is covered. A
text is never exploded.

Defined results: a null text is empty; a text without words has no tuples, and two such are alike (1.0), with any
other 0.0; fewer than K words are one k-mer; equal texts have equal fingerprints; null ids come first in the order of
documents and rows of equal id are ordered by a hash of the text; a single document is its own next one; an empty
table gives an empty table; other columns are not read; a text of more than 134 million words is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import CHUNK, in_chunks, materialise, pick, row_key, running_total

K = 3
TUPLE = 2
BUCKET_BITS = 5
#: Bits of a place in the text: up to 134 million words.
PLACE_BITS = 27
PLACE = (1 << PLACE_BITS) - 1
#: Factor by which each round lengthens the runs that are covered.
STRIDE = 8


def _words(text: Column) -> Column:
    bare = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _further(step: int) -> Column:
    """Runs of up to STRIDE * step, from runs of up to step."""
    look = lambda c, i: F.aggregate(
        F.sequence(F.lit(1), F.lit(STRIDE - 1)), c, lambda sum_, j: F.when(sum_ == j * step, sum_ + F.coalesce(F.get(F.col("_c"), i - j * step), F.lit(0))).otherwise(sum_)
    )
    return F.transform("_c", lambda c, i: F.when(c == step, look(c, i)).otherwise(c))


def with_tuples(df: DataFrame, text_col: str, out: str = "tuples") -> DataFrame:
    """Add an ascending array of (bucket << 32 | hash of the tuple), one number per bucket that is not empty."""
    h = F.transform(_words(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.xxhash64(w))
    df = df.withColumn("_h", h)
    too_long = F.raise_error(F.lit(f"a text has more than {PLACE} words")).cast("array<bigint>")
    df = df.withColumn("_h", F.when(F.size("_h") > PLACE, too_long).otherwise(F.col("_h")))
    n = F.size("_h")
    runs = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(K)]))
    kmers = F.when(n >= K, runs).when(n > 0, F.array(F.xxhash64("_h"))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", kmers)
    packed = F.transform("_h", lambda x, i: x.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))
    df = df.withColumn("_s", F.sort_array(packed)).drop("_h")
    same = lambda i: F.shiftright(F.get(F.col("_s"), i), PLACE_BITS) == F.shiftright(F.get(F.col("_s"), i - 1), PLACE_BITS)
    df = df.withColumn("_c", F.transform("_s", lambda x, i: F.when((i > 0) & same(i), F.lit(1)).otherwise(F.lit(0))))
    step = 1
    while step < 1 << PLACE_BITS:
        df = df.withColumn("_c", F.when(F.coalesce(F.array_max("_c"), F.lit(0)) >= step, _further(step)).otherwise(F.col("_c")))
        step *= STRIDE
    # zip_with takes its arrays as they are; named once inside a function of elements, the last round would be repeated for each
    numbered = F.zip_with("_s", "_c", lambda x, c: F.xxhash64(F.shiftright(x, PLACE_BITS), c).bitwiseAND(F.lit(~PLACE)).bitwiseOR(x.bitwiseAND(F.lit(PLACE))))
    df = df.withColumn("_s", F.sort_array(numbered)).drop("_c")
    top = 64 - BUCKET_BITS
    least = F.filter("_s", lambda x, i: (i < TUPLE) | (F.shiftright(F.get(F.col("_s"), i - TUPLE), top) != F.shiftright(x, top)))
    # bucket, place, hash: sorting puts the chosen back in the order of the text
    hash_bits = top - PLACE_BITS
    bucket = lambda x: F.shiftrightunsigned(x, top)
    turned = F.transform(
        least,
        lambda x: F.shiftleft(F.shiftright(x, top), top)
        .bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(PLACE)), hash_bits))
        .bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS).bitwiseAND(F.lit((1 << hash_bits) - 1))),
    )
    df = df.withColumn("_s", F.sort_array(turned))
    value = lambda x: x.bitwiseAND(F.lit((1 << hash_bits) - 1))
    at = lambda i: F.get(F.col("_s"), i)
    firsts = F.filter(F.transform("_s", lambda x, i: i), lambda i: (i == 0) | (bucket(at(i - 1)) != bucket(at(i))))
    rest = lambda i: [F.when(bucket(at(i + k)) == bucket(at(i)), value(at(i + k))) for k in range(1, TUPLE)]
    tuples = F.transform(firsts, lambda i: F.shiftleft(bucket(at(i)), 32).bitwiseOR(F.xxhash64(value(at(i)), *rest(i)).bitwiseAND(F.lit(0xFFFFFFFF))))
    return df.withColumn(out, F.sort_array(tuples)).drop("_s")


def as_text(tuples: Column) -> Column:
    """Two hexadecimal digits of the bucket and eight of the hash for each tuple."""
    return F.array_join(F.transform(tuples, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    filled = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of a text column as a string."""
    return with_tuples(df, text_col, "_tuples").withColumn(out, as_text(F.col("_tuples"))).drop("_tuples")


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last quarter is the start of the next document.

    id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are known by a key made of id and text, so nothing depends on how a reading is split. Rows equal in both are
    one document with a number of copies: each copy's next one is its equal, but for the last. Texts are shuffled once,
    by key, together with what the document before needs of them.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    k1, k2 = row_key(docs)
    docs = docs.withColumn("k1", k1).withColumn("k2", k2)
    ids = docs.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("times"), F.first(F.length("text")).alias("n_chars"))
    placed = running_total(ids, [F.col("id").asc_nulls_first(), F.col("k1"), F.col("k2")], F.col("times"), "place", "fingerprint-order")
    placed = materialise(placed.select("k1", "k2", "id", "times", "place", F.floor(F.col("n_chars") / 4).cast("int").alias("need")), "fingerprint-places")
    total, most = placed.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.max("times"), F.lit(0))).first()
    after = F.pmod(F.col("place") + F.col("times"), F.lit(max(total, 1)))
    before = placed.select(after.alias("place"), F.col("k1").alias("to_k1"), F.col("k2").alias("to_k2"), F.col("place").alias("to_place"), F.col("need").alias("to_need"))
    plan = materialise(placed.join(before, "place"), "fingerprint-plan")
    # both uses take the same columns of the texts, so their shuffle is done once
    texts = docs.select("k1", "k2", "text")
    heads = pick(texts, plan.select("k1", "k2", "to_k1", "to_k2", "to_need", "times"), ["k1", "k2"], "times", total)
    heads = heads.select(F.col("to_k1").alias("k1"), F.col("to_k2").alias("k2"), F.substring("text", F.lit(1), F.col("to_need")).alias("head"))
    full = pick(texts, plan.select("k1", "k2", "place", "to_place", "need", "times"), ["k1", "k2"], "times", total).join(heads, ["k1", "k2"])
    cut = F.substring("text", F.lit(1), F.length("text") - F.col("need"))
    # 0: the text; 1: edited with the next document; 2: edited with its equal, if it has one
    kinds = F.array("text", F.concat(cut, F.col("head")))
    if most > 1:
        kinds = F.when(F.col("times") > 1, F.concat(kinds, F.array(F.concat(cut, F.substring("text", F.lit(1), F.col("need")))))).otherwise(kinds)
    both = full.select("place", "to_place", F.posexplode(kinds).alias("kind", "t"))
    both = both.select("place", "to_place", "kind", "t", F.length("t").alias("n"), F.when(F.col("kind") > 0, F.sha2("t", 256)).alias("sha"))
    made = with_tuples(both, "t").drop("t")
    # an original goes to its own place and, as the next one, to the place before
    to = lambda at, as_: F.struct(F.col(at).alias("at"), as_.cast("int").alias("as"))
    goes = F.when(F.col("kind") == 0, F.array(to("place", F.lit(0)), to("to_place", F.lit(3)))).otherwise(F.array(to("place", F.col("kind"))))
    sent = made.withColumn("_go", F.explode(goes)).select("_go.at", "_go.as", "n", "sha", "tuples")
    pick_ = lambda c, k: F.first(F.when(F.col("as") == k, F.col(c)), ignorenulls=True)
    rows = sent.groupBy("at").agg(
        pick_("n", 0).alias("n_chars"), pick_("sha", 1).alias("sha_1"), pick_("sha", 2).alias("sha_2"), *[pick_("tuples", k).alias(f"_{k}") for k in range(4)]
    )
    rows = rows.join(placed.select(F.col("place").alias("at"), "id", "times"), "at")
    line = lambda sha, edited, near: F.struct(
        F.col(sha).alias("edited_sha256"), as_text(F.col(edited)).alias("edited_fingerprint"), likeness(F.col("_0"), F.col(edited)).alias("near_edited"), near.alias("near_next")
    )
    rows = rows.withColumn("_last", line("sha_1", "_1", likeness(F.col("_0"), F.col("_3"))))
    if most > 1:
        rows = in_chunks(rows, "times", "_from", most).withColumn("_inner", line("sha_2", "_2", F.lit(1.0)))
        end = F.least(F.col("times"), F.col("_from") + CHUNK)
        rows = rows.withColumn("_k", F.explode(F.sequence(F.col("_from"), end - 1))).withColumn("_last", F.when(F.col("_k") == F.col("times") - 1, F.col("_last")).otherwise(F.col("_inner")))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n_chars").cast("long").alias("n_chars"),
        "_last.edited_sha256",
        as_text(F.col("_0")).alias("fingerprint"),
        "_last.edited_fingerprint",
        "_last.near_edited",
        "_last.near_next",
    )
