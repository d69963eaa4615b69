"""Mixing sources to target weights by entropy balancing.

Targets are words for each source. Besides, the mix is to keep the corpus' mean document length: with z = ln(1 + size), less its mean over
all words, the mix's words should have the mean 0 too. The rates w of the documents solve

    minimise  sum size * (w ln w - w)   subject to   sum over a source of size * w = its target,   sum of size * w * z = 0,   w <= most,

the last sum softly: a quadratic penalty on its multiplier gives a mild tilt also where the limits leave no solution. So a rate is an
exponential tilt, w = min(most, exp(lambda of the source + mu * z)). Newton's iterations solve the convex dual: each step sums size * w,
size * w * z and size * w * z^2 over all documents by source. The Hessian has the sources' sums on its diagonal and one full row, that
of mu; eliminating the sources leaves one equation for mu, after which each source has its own step, so no matrix is formed anywhere. A
source whose target is ``most`` times its size has all its rates at the limit and takes no part. Documents of one source and size are
alike, so the steps read their counts. Sums are of whole millionths of a word: they don't depend on the order of the rows, so reruns agree. A solve
that has not settled after NEWTON_STEPS says so, and is an error where a source is off by more than a thousandth.

Rates are then rounded to whole copies, 0 to 2, by systematic sampling: with a source's documents by falling size, a document gets
floor(R + 1/2) - floor(R - w + 1/2) copies, R the sum of the rates up to it, and a few documents are moved by one copy to close what is left.
Large sources are rounded in buckets of about BUCKET_ROWS documents, so that no task holds a source. No random numbers are drawn.

A null text has size 0; a null source is a source of its own, ordered last. Documents of size 0 get copies like others and add no words.
Repeated rows are separate documents, ties in size are ordered by id. An empty table, or one without words, gives rates 0 (an empty
table an empty table). Columns with the names of added ones are carried by mixed(), replaced by with_copies(). Everything is DataFrame
expressions. Very long texts are counted where they stand.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.common import WORD, Scratch, broadcast_if_small, written
from corpuslab.operators.ranges import numbered, running

BUCKET_ROWS = 256
NEWTON_STEPS = 40
CLOSING_MOVES = 5

#: Weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)

#: Billionths of a copy in rates: whole numbers, whose sums are exact.
NANO = 1_000_000_000

#: Sources whose order one task sorts.
MOST_IN_TASK = 100_000

#: The penalty on the length multiplier, as a share of the words' spread of lengths: high enough that no source is cut into all or nothing by length.
RIDGE = 0.5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """_source, source_size, n_docs, target from rows of (source, size).

    Target = min(most * source_size, theta * weight), theta such that the targets sum to share * all sizes: what sharing out the
    excess over the limits by weight, again and again, ends in. With the sources by rising limit / weight, theta follows
    from the first source whose limit is not reached.
    """
    sums = sizes.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sums = scratch.cut(sums)
    whole = sums.agg(F.count("*").alias("n"), F.sum("source_size").alias("words")).first()
    few = whole["n"] <= MOST_IN_TASK  # beyond it the same sums are carried from range to range of the order
    by_name, by_ratio = [F.col("_source").asc_nulls_last()], [F.col("ratio"), F.col("_source").asc_nulls_last()]
    sums = sums.withColumn("place", F.row_number().over(Window.orderBy(*by_name))) if few else numbered(sums, [], by_name, "place")
    sums = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))).drop("place")
    sums = sums.withColumn("limit", F.col("source_size") * most).withColumn("ratio", F.col("limit") / F.col("weight"))
    all_weights = len(weights) and sum(weights) * (whole["n"] // len(weights)) + sum(weights[: whole["n"] % len(weights)])
    if few:
        earlier = Window.orderBy(*by_ratio).rowsBetween(Window.unboundedPreceding, -1)
        placed = sums.withColumns({"before": F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)), "weights": F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))})
    else:
        placed = running(sums, [], by_ratio, {"before": F.col("limit"), "weights": F.col("weight")}, inclusive=False)
    theta = (F.lit(float(whole["words"] or 0) * share) - F.col("before")) / (F.lit(float(all_weights)) - F.col("weights"))
    first = placed.withColumn("theta", theta).filter("theta <= ratio").agg(F.min(F.struct("ratio", "theta")).alias("f")).first()["f"]
    reached = F.col("limit") if first is None else F.least(F.col("limit"), F.lit(first["theta"]) * F.col("weight"))
    return sums.withColumn("target", reached).select("_source", "source_size", "n_docs", "target")


def length(size: Column) -> Column:
    return F.ln(1 + size)


def whole(x: Column) -> Column:
    """In whole millionths, of which sums are exact."""
    return F.round(x, 6).cast("decimal(28,6)")


def tilts(sizes: DataFrame, targets: DataFrame, scratch: Scratch, most: float = 2.0, tolerance: float = 1e-6) -> DataFrame:
    """targets with lambda, mu and mean (of ln(1 + size) over all words), by Newton's iterations on the dual.

    Each iteration is one aggregation of all (source, size, documents) by source; the driver sees one row of it. It ends when the Newton decrement, the
    decrease that the next step promises, is tolerance ^ 2 of the words or less and no source is off by more than tolerance.
    """
    cells = scratch.cut(sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    mass = F.col("n") * F.col("size")
    one = cells.agg(F.sum(whole(mass * length(F.col("size")))).alias("m"), F.sum(mass).alias("n")).first()
    words = int(one["n"] or 0)
    mean = float(one["m"]) / words if words else 0.0
    z = length(F.col("size")) - F.lit(mean)
    ridge = RIDGE * max(1.0, float(cells.agg(F.sum(whole(mass * z * z)).alias("s")).first()["s"] or 0.0))
    free = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-9))
    start = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.ln(F.col("target") / F.col("source_size")))
    state = scratch.cut(targets.withColumns({"free": free, "lambda": start, "move": F.lit(0.0)}))
    mu, turn, part, best = 0.0, 0.0, 1.0, None
    names = ("g", "gz", "h", "hz", "hzz", "f")
    for step in range(NEWTON_STEPS + 1):
        at = mu + part * turn
        tried = state.withColumn("lambda", F.round(F.col("lambda") + F.lit(part) * F.col("move"), 12))
        rows = cells.join(tried, cells["source"].eqNullSafe(tried["_source"])).filter(F.col("lambda").isNotNull())
        eta = F.col("lambda") + F.when(F.col("free"), at * z).otherwise(0.0)
        kept = mass * F.least(F.lit(most), F.exp(eta))
        bend = F.when(F.col("free") & (F.exp(eta) < most), kept).otherwise(0.0)
        dual = F.when(F.col("free"), F.when(F.exp(eta) < most, kept).otherwise(mass * most * (1 + eta - math.log(most)))).otherwise(0.0)
        made = dict(zip(names, (kept, kept * z, bend, bend * z, bend * z * z, dual), strict=True))
        sums = rows.groupBy("source").agg(*[F.sum(whole(x)).cast("double").alias(a) for a, x in made.items()])
        joined = tried.join(sums, tried["_source"].eqNullSafe(sums["source"]), "left").drop("source").fillna(0.0, list(names))
        joined = joined.withColumns({"short": F.when(F.col("free"), F.col("target") - F.col("g")).otherwise(0.0), "h": F.greatest("h", F.col("g") / 50)})
        joined = scratch.cut(joined)
        over_h = lambda x: F.when(F.col("free"), x / F.col("h")).otherwise(0.0)
        total = lambda x: F.sum(whole(x)).cast("double")
        one = joined.agg(  # a row: the dual, the equation that is left for mu, and the largest share of a target that is missing
            total(F.when(F.col("free"), F.col("f") - F.col("target") * F.col("lambda")).otherwise(0.0)).alias("dual"),
            total(F.when(F.col("free"), 0.0).otherwise(F.col("gz"))).alias("fixed"),
            (-total(F.col("gz")) - total(over_h(F.col("hz") * F.col("short")))).alias("top"),
            (total(F.col("hzz")) - total(over_h(F.col("hz") * F.col("hz")))).alias("bottom"),
            total(over_h(F.col("short") * F.col("short"))).alias("gain"),
            F.max(F.abs("short") / F.greatest(F.col("target"), F.lit(1.0))).alias("off"),
            F.max(F.col("free")).alias("any_free"),
        ).first()
        if not one["any_free"]:
            break
        value = one["dual"] + at * one["fixed"] + ridge * at * at / 2
        if best is not None and value > best + 1e-12 * abs(best) + 1e-4 and part > 1e-3:
            part /= 2  # too far: half of the way
            continue
        mu, best, part = at, value, 1.0
        slope = one["top"] - ridge * mu
        turn = slope / (max(0.0, one["bottom"]) + ridge)
        state = joined
        if one["off"] <= tolerance and one["gain"] + turn * slope <= max(1e-4, tolerance * tolerance * words):
            break
        if step == NEWTON_STEPS:
            told = f"targets still off by {one['off']:.2g} after {NEWTON_STEPS} Newton steps"
            if one["off"] > 1e-3:
                raise RuntimeError(told)
            warnings.warn(told, stacklevel=2)
            break
        turn = round(max(-1.0, min(1.0, turn)), 12)
        move = over_h(F.col("short") - F.col("hz") * F.lit(turn))
        state = joined.withColumn("move", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), move))).drop(*names, "short")
    return state.select("_source", "source_size", "n_docs", "target", "free", "lambda").withColumns({"mu": F.lit(mu), "mean": F.lit(mean)})


def with_copies(rows: DataFrame, solved: DataFrame, id_col: str = "doc_id", most: float = 2.0, tie: Column | None = None) -> DataFrame:
    """rows (with source and size) with source_size, target, rate and copies; solved: see tilts. tie: orders rows of one size and id, which are alike otherwise."""
    rows = rows.withColumn("_tie", F.lit(0) if tie is None else tie)
    rows = rows.drop("source_size", "target", "rate", "copies", "_source", "_bucket", "_nano", "_upto", "_k", "_left", "_best", "_buckets")
    found = solved.select("_source", "source_size", "target", "free", "lambda", "mu", "mean", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS)).alias("_buckets"))
    at = F.conv(F.substring(F.md5(F.concat_ws("/", F.col(id_col).cast("string"), F.col("size").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    eta = F.col("lambda") + F.when(F.col("free"), F.col("mu") * (length(F.col("size")) - F.col("mean"))).otherwise(0.0)
    nano = F.round(F.when(eta.isNotNull(), F.least(F.lit(most), F.exp(eta))).otherwise(0.0) * NANO).cast("long")
    out = rows.join(broadcast_if_small(found), rows["source"].eqNullSafe(found["_source"])).withColumns({"_bucket": at % F.col("_buckets"), "_nano": nano})
    bucket = Window.partitionBy("source", "_bucket")
    order = bucket.orderBy(F.desc("size"), F.asc(id_col), "_tie")
    out = out.withColumns({"_k": F.row_number().over(order), "_upto": F.sum("_nano").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    copies_to = lambda x: F.floor((x + NANO // 2) / F.lit(NANO))
    out = out.withColumn("copies", copies_to(F.col("_upto")) - copies_to(F.col("_upto") - F.col("_nano")))
    out = out.withColumn("_left", F.round(F.sum(F.col("size") * F.col("_nano") / NANO - F.col("size") * F.col("copies")).over(bucket.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).cast("long"))
    for _ in range(CLOSING_MOVES):
        left = F.col("_left")
        free = F.when(left > 0, F.col("copies") < F.least(F.lit(2), F.ceil(F.col("_nano") / NANO))).otherwise(F.col("copies") > 0) & (F.col("size") > 0) & (F.col("size") <= F.abs(left))
        out = out.withColumn("_best", F.max(F.when(free, F.struct("size", "_k"))).over(bucket))
        moved = F.coalesce(F.col("_best")["_k"] == F.col("_k"), F.lit(False))
        out = out.withColumn("copies", F.col("copies") + F.when(moved, F.signum(left).cast("long")).otherwise(0)).withColumn(
            "_left", left - F.signum(left).cast("long") * F.coalesce(F.col("_best")["size"], F.lit(0))
        )
    out = out.withColumn("rate", F.col("_nano") / F.lit(float(NANO)))
    return out.drop("_source", "_buckets", "_bucket", "_nano", "_upto", "_k", "_left", "_best", "_tie", "free", "lambda", "mu", "mean")


def solved(sizes: DataFrame) -> DataFrame:
    """Targets and multipliers from all (source, size) rows: a row for each source, written."""
    scratch = Scratch(sizes.sparkSession, "mix")
    found = written(tilts(sizes, source_targets(sizes, scratch), scratch), "op8-tilts")
    scratch.drop()
    return found


def mixed(docs: DataFrame, sizes: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as many times as it has copies, with its own columns. sizes: its (source, size), which may be materialised."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
    hashed = [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = with_copies(rows, solved(sizes), tie=F.xxhash64(*[F.col("doc").getField(c) for c in hashed]))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
