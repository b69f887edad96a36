"""Identity, versions, chunking and audits of a corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.files import scratch_dir

PLIES_PER_PART = 18
#: Range of idx in which a running maximum is taken in one task.
SPAN = 1_000_000
#: Values of a group that one task may sort for its median, bins of a round for a larger group, and groups that may be broadcast.
MEDIAN_ROWS, BINS, MOST_HEAVY = 1_000_000, 1024, 100_000


def dedup_status(new: DataFrame, state: DataFrame) -> DataFrame:
    """``new`` (idx, fp, gid, evs) with ``status``, as if rows came in the order of idx against ``state`` (fp, gid, evs).

    DUPLICATE: fingerprint known or accepted earlier. Else, with a positive score: NEW GAME, UPGRADE (better than all
    versions before) or VERSION. Else REJECTED; without a fingerprint ERROR. Only the first row of a fingerprint can be accepted, so
    repeated content never gathers in one task; and the running maximum of a gid is taken in spans of idx (a whole number), over the
    best of the spans before, so neither does a gid that many fingerprints share.
    """
    rows = new.withColumn("evs", F.coalesce("evs", F.lit(0.0)))
    narrow = ["idx", "fp", "gid", "evs"]
    if set(rows.columns) == {*narrow}:
        rows = _written(rows)  # what they are made from is read once
    known = state.select("fp").where("fp is not null").distinct()
    # the first row of a fingerprint with a score; of one that is not known, it is accepted
    firsts = rows.where("evs > 0 and fp is not null").groupBy("fp").agg(F.min(F.struct("idx", "gid", "evs")).alias("f"))
    accepted = firsts.join(known, "fp", "left_anti").select("fp", "f.*", F.floor(F.col("f.idx") / SPAN).alias("span"))
    accepted = _written(accepted)
    before = lambda keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    spans = accepted.groupBy("gid", "span").agg(F.max("evs").alias("best"))
    spans = spans.select("gid", "span", F.max("best").over(before(["gid"], "span")).alias("earlier")).where("earlier is not null")
    best = state.groupBy("gid").agg(F.max("evs").alias("old"))
    ranked = accepted.withColumn("top", F.max("evs").over(before(["gid", "span"], "idx"))).join(spans, ["gid", "span"], "left").join(best, "gid", "left")
    ranked = ranked.withColumn("prior", F.greatest("top", "earlier", "old"))
    verdict = F.when(F.col("prior").isNull(), "NEW GAME").when(F.col("evs") > F.col("prior"), "UPGRADE").otherwise("VERSION")
    fate = ranked.select("fp", F.col("idx").alias("_first"), verdict.alias("_verdict")).unionByName(known.select("fp", F.lit(None).cast(rows.schema["idx"].dataType).alias("_first"), F.lit("DUPLICATE").alias("_verdict")))
    status = F.when(F.col("fp").isNull(), "ERROR").when((F.col("_verdict") == "DUPLICATE") | (F.col("idx") > F.col("_first")), "DUPLICATE").when(F.col("idx") == F.col("_first"), F.col("_verdict")).otherwise("REJECTED")
    return rows.join(fate, "fp", "left").withColumn("status", status).drop("_first", "_verdict")


def best_version(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The row of the highest value for each key, the lowest ``order`` among equals: an aggregate with map-side combination."""
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col(value), -F.col(order)))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_b")).select("_b.*")


def opening_key(moves: Column, plies: int = 20) -> Column:
    """Identity by a game's first moves (array): an alternative to the whole main line."""
    return F.md5(F.array_join(F.slice(moves, 1, plies), ""))


def played_key(moves: Column, white: Column, black: Column, result: Column) -> Column:
    """Identity by moves, players and result: an alternative to the main line alone."""
    return F.md5(F.concat_ws("\u001f", F.array_join(moves, ""), white, black, result))


def acceptance(rows: DataFrame) -> DataFrame:
    """(accepted, rejected, percent) of rows with a status; percent is 0 for no rows."""
    ok = F.col("status").isin("NEW GAME", "UPGRADE", "VERSION")
    out = rows.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
    every = F.col("accepted") + F.col("rejected")
    return out.withColumn("percent", F.when(every > 0, F.col("accepted") * 100.0 / every).otherwise(0.0))


def overlap_parts(rows: DataFrame) -> DataFrame:
    """Parts of ``rows`` (text, plies): ``part``, ``parts``, ``start``, ``end``, ``piece``, ``moves``.

    One part for 18 plies; each begins a tenth of a part earlier, but the first. No plies: one part, without a move range.
    """
    parts = F.greatest(F.ceil(F.col("plies") / PLIES_PER_PART), F.lit(1)).cast("long")
    base = rows.withColumn("parts", parts).withColumn("_c", F.floor(F.length("text") / F.col("parts"))).withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))))
    start = F.when(F.col("part") > 1, F.greatest((F.col("part") - 1) * F.col("_c") - F.floor(F.col("_c") / 10), F.lit(0))).otherwise(F.lit(0)).cast("long")
    end = F.when(F.col("part") < F.col("parts"), F.col("part") * F.col("_c")).otherwise(F.length("text")).cast("long")
    moves = F.concat(((F.col("part") - 1) * PLIES_PER_PART + 1).cast("string"), F.lit("-"), F.least(F.col("part") * PLIES_PER_PART, F.col("plies")).cast("string"))
    base = base.withColumns({"start": start, "end": end, "moves": F.when(F.col("plies") > 0, moves)})
    return base.withColumn("piece", F.substring("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))).drop("_c")


def breadcrumb(source: Column, *parts: tuple[str, Column]) -> Column:
    """``Source: Title Case`` and the parts that are not empty, joined by a triangle."""
    named = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}: "), c)) for n, c in parts]
    return F.concat_ws(" ▸ ", F.concat(F.lit("Source: "), F.initcap(F.replace(source, F.lit("_"), F.lit(" ")))), *named)


def medians(rows: DataFrame, by: str, value: str, most: int = MEDIAN_ROWS) -> DataFrame:
    """(``by``, ``median``): the exact median of the values of each group; null and NaN values are left out, and groups without others.

    Groups of up to ``most`` rows are settled at once. In a larger one, the range that holds a middle rank is cut into BINS bins, whose counts tell the one
    that holds it, until that has one value or up to ``most`` rows; each round reads the rows once. So no task holds more than ``most`` values of a group.
    """
    rows = rows.select(by, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sizes = _written(sizes.where(F.col("n") > most))
    count = sizes.count()
    middle = lambda df: df.groupBy(by).agg(F.percentile("v", F.lit(0.5)).alias("median"))
    if not count:
        return middle(rows)
    near = (lambda df: F.broadcast(df)) if 2 * count <= MOST_HEAVY else (lambda df: df)
    named = lambda df, *more: df.select(F.col(by).alias("_by"), *more)
    small = middle(rows.join(near(named(sizes)), F.col(by).eqNullSafe(F.col("_by")), "left_anti"))
    ranks = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))))
    open_ = _written(sizes.select(by, ranks.alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi", "n"))
    settled: list[DataFrame] = []
    while True:
        done = open_.where((F.col("lo") == F.col("hi")) | (F.col("n") <= most))
        settled.append(done)
        left = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") > most))
        if left.isEmpty():
            break
        span = named(left, "lo", "hi").distinct()
        part = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        inside = rows.join(near(span), F.col(by).eqNullSafe(F.col("_by")) & F.col("v").between(F.col("lo"), F.col("hi")))
        bins = inside.groupBy(by, "lo", "hi", F.least(F.floor(part * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last"))
        bins = bins.withColumn("before", F.sum("c").over(W.partitionBy(by, "lo", "hi").orderBy("bin")) - F.col("c"))
        wanted = named(left, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "rank", "below")
        at = F.col("rank") - F.col("below")
        hit = bins.join(wanted, bins[by].eqNullSafe(wanted["_by"]) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (at >= F.col("before")) & (at < F.col("before") + F.col("c")))
        open_ = _written(hit.select(by, "rank", (F.col("below") + F.col("before")).alias("below"), F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("c").alias("n")))
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    known = found.where("lo = hi").select(by, "rank", F.col("lo").alias("v"))
    few = named(found.where("lo < hi"), "rank", "below", "lo", "hi")
    # ``most`` rows of a group at most
    place = F.row_number().over(W.partitionBy(by, "rank").orderBy("v")) - 1
    among = rows.join(near(few), F.col(by).eqNullSafe(F.col("_by")) & F.col("v").between(F.col("lo"), F.col("hi"))).withColumn("place", place)
    known = known.unionByName(among.where("place = rank - below").select(by, "rank", "v"))
    return small.unionByName(known.groupBy(by).agg((F.min("v") + (F.max("v") - F.min("v")) * 0.5).alias("median")))


def _written(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again."""
    path = f"{scratch_dir(df.sparkSession)}/lectern-scratch-medians-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quality_summary(rows: DataFrame, by: str) -> DataFrame:
    """Counts by tier, mean and median score, mean density and plies for each group of scored ``rows`` (evs, density, plies)."""
    tenth = lambda c, d: F.floor(c * float(10**d) + 0.5).cast("double") / float(10**d)
    rows = rows.where("evs is not null")
    middle = medians(rows, by, "evs").select(F.col(by).alias("_by"), tenth(F.col("median"), 2).alias("median_evs"))
    out = rows.groupBy(by).agg(
        F.count("*").alias("games"),
        F.count_if(F.col("evs") >= 70).alias("high"),
        F.count_if((F.col("evs") >= 45) & (F.col("evs") < 70)).alias("medium"),
        F.count_if(F.col("evs") < 45).alias("low"),
        tenth(F.avg("evs"), 2).alias("avg_evs"),
        tenth(F.avg("density"), 3).alias("avg_density"),
        tenth(F.avg("plies"), 1).alias("avg_plies"),
    )
    return out.join(middle, out[by].eqNullSafe(middle["_by"]), "left").drop("_by")


def parse_thresholds(text: str) -> list[float]:
    """Numbers of a comma list; bad parts are passed over, none gives 70."""
    found = []
    for part in text.split(","):
        try:
            found.append(float(part))
        except ValueError:
            continue
    return found or [70.0]


def parse_buckets(items: list[str]) -> list[tuple[float, float, str]]:
    """``low-high=name`` items as (low, high, name); bad items are passed over."""
    found = []
    for item in items:
        span, _, name = item.partition("=")
        low, _, high = span.partition("-")
        try:
            found.append((float(low), float(high), name))
        except ValueError:
            continue
    return [x for x in found if x[2]]


def kept_at(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """A row for every threshold that a row's score reaches."""
    return rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where("evs >= threshold")


def in_buckets(rows: DataFrame, buckets: list[tuple[float, float, str]]) -> DataFrame:
    """A row for every bucket whose closed range holds a row's score; the buckets are a literal list."""
    listed = F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), F.lit(n).alias("bucket")) for a, b, n in buckets])
    fits = F.filter(listed, lambda b: (F.col("evs") >= b["low"]) & (F.col("evs") <= b["high"]))
    return rows.withColumn("_b", F.explode(fits)).withColumn("bucket", F.col("_b.bucket")).drop("_b")


def first_rows(rows: DataFrame, by: str, order: str, n: int, skip: int = 0) -> DataFrame:
    """The rows at places skip + 1 to skip + n of every group; groups are cut before they meet (the limit is pushed to the map side)."""
    w = W.partitionBy(by).orderBy(order)
    return rows.withColumn("place", F.row_number().over(w)).where((F.col("place") > skip) & (F.col("place") <= skip + n))
