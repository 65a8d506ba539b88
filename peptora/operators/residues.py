"""The residue table and everything that slides over it.

Sequences are dealt out by accession before they are exploded, so what is shuffled is one
row for each protein; the windows below all use the same partitioning and order and share
one sort. Values are whole numbers where the published tables allow, which makes window sums
exact in any order.

A long sequence is dealt out in chunks, each with a halo of the residues on either side, so that no window
of up to HALO places is cut and no task holds a sequence. ``_from`` and ``_to`` say which places are a chunk's own: the
halo's rows are there for windows only, and ``own`` drops them before anything is counted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptora.functions.sequence import mean_of_window_means
from peptora.functions.tables import COEFFICIENTS100, CORE, FOLD_C, FOLD_H, FOLD_R, FOLD_WINDOW, HYDROPATHY10, LENGTH_COEFFICIENT, NORMALISATION, PROFILE_RADIUS, RESIDUES, SCALE_NAMES, SCALES100, granule10000


#: Residues of a chunk, and those on either side that its windows reach: more than two smoothings over 41 and a neighbour's neighbour.
CHUNK, HALO = 1 << 16, 128


def by_position() -> Window:
    return Window.partitionBy("acc", "_from").orderBy("pos")


def own(table: DataFrame) -> DataFrame:
    """Each residue once: without the halos."""
    return table.where((F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_to")))


def residues(sequences: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """(acc, seq) to (acc, n, pos, aa, _from, _to), pos from 0; see ``own``. Null or empty sequences have no residues. No ``chunk``: sequences stay whole.

    An accession names one sequence: its residues stand at their positions, so a second row of it
    would stand between them. Repeated and null accessions therefore fail; see ``first_occurrences``.
    """
    n = F.length("seq")
    starts = F.sequence(F.lit(0), n - 1, F.lit(chunk)) if chunk else F.array(F.lit(0))
    whole = sequences.where(n > 0).select("acc", "seq", n.alias("n"), F.explode(starts).alias("_from"))
    to = F.least(F.col("_from") + chunk, F.col("n")) if chunk else F.col("n")
    first = F.greatest(F.col("_from") - HALO, F.lit(0))
    size = F.least(to + HALO, F.col("n")) - first
    # Of letters of one byte a part is found at once; characters must be counted from the beginning.
    part = F.when(F.octet_length("seq") == F.col("n"), F.substring(F.col("seq").cast("binary"), first + 1, size).cast("string")).otherwise(F.substring("seq", first + 1, size))
    dealt = whole.select("acc", "n", "_from", to.alias("_to"), first.alias("_first"), part.alias("seq")).repartition("acc", "_from")
    wrong = F.when(F.col("acc").isNull(), F.raise_error(F.lit("a sequence has no accession"))).when(
        F.count("*").over(Window.partitionBy("acc", "_from")) > 1, F.raise_error(F.concat(F.lit("several sequences of accession "), F.col("acc").cast("string")))
    )
    dealt = dealt.withColumn("_wrong", wrong).where("_wrong is null")
    each = dealt.select("acc", F.col("n").cast("long").alias("n"), "_from", "_to", "_first", F.posexplode(F.split("seq", "")).alias("_at", "aa")).where("aa != ''")
    return each.select("acc", "n", (F.col("_first") + F.col("_at")).alias("pos"), "aa", "_from", "_to")


def valued(scale: Mapping[str, float], aa: str = "aa") -> Column:
    """A residue's value by direct lookup; letters without one count 0."""
    kind = "long" if all(isinstance(v, int) for v in scale.values()) else "double"
    table = F.array(*[F.lit(scale.get(chr(65 + k), 0)).cast(kind) for k in range(26)])
    return F.coalesce(F.get(table, F.ascii(aa) - 65), F.lit(0).cast(kind))


def around(radius: int) -> Window:
    return by_position().rowsBetween(-radius, radius)


def width(radius: int) -> Column:
    """How many residues the centred window of this radius holds, cut at the ends."""
    return F.least(F.col("pos"), F.lit(radius)) + F.least(F.col("n") - 1 - F.col("pos"), F.lit(radius)) + 1


def residue_scores(table: DataFrame, radius: int = 3) -> DataFrame:
    """Adds score: the formula's window mean, from one window over the fused scales."""
    total = F.sum(valued(granule10000())).over(around(radius))
    return table.withColumn("score", total.cast("double") / width(radius) / 10000.0)


def protein_scores(sequences: DataFrame, route: str = "paper") -> DataFrame:
    """acc, n, raw (mean residue score + 0.25 ln n), score (normalised): one expression a row, no shuffle.

    Each row is scored by itself, so accessions may repeat or be null. Null and empty sequences have no row.
    """
    mean, sd = NORMALISATION[route]
    n = F.length("seq").cast("long")
    raw = mean_of_window_means(F.col("seq"), granule10000()) / 10000.0 + LENGTH_COEFFICIENT * F.log(n.cast("double"))
    return sequences.where(F.length("seq") > 0).select("acc", n.alias("n"), raw.alias("raw")).withColumn("score", (F.col("raw") - mean) / sd)


def profile(table: DataFrame, radius: int = PROFILE_RADIUS) -> DataFrame:
    """acc, pos, n, value: window means over residue scores at positions radius - 1 to n - radius - 2."""
    mean = F.avg("score").over(around(radius))
    return own(residue_scores(table).withColumn("value", mean)).where((F.col("pos") >= radius - 1) & (F.col("pos") <= F.col("n") - radius - 2)).select("acc", "n", "pos", "value")


def window_summaries(table: DataFrame, radii: tuple[int, ...] = (3, 7, 13, 25)) -> DataFrame:
    """acc and, for each radius and scale, mean, quartiles and deviation of the window means (one sort for all)."""
    means = {f"{n}{r}": (F.sum(valued({a: row[k] for a, row in SCALES100.items()})).over(around(r)).cast("double") / width(r) / 100.0) for r in radii for k, n in enumerate(SCALE_NAMES)}
    got = own(table.withColumns(means))
    aggs = []
    for name in means:
        q = F.percentile(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs += [F.avg(name).alias(f"{name}_mean"), *(q[k].alias(f"{name}_q{p}") for k, p in enumerate((25, 50, 75))), F.stddev_pop(name).alias(f"{name}_sd")]
    return got.groupBy("acc").agg(*aggs)


def profile_statistics(values: DataFrame) -> DataFrame:
    """Of (acc, value): moments, quantiles, range, share and mean of the positive values."""
    points = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
    q = F.percentile("value", F.array(*map(F.lit, points)))
    return values.groupBy("acc").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), *(q[k].alias(f"q{round(100 * p):02d}") for k, p in enumerate(points)),
        F.min("value").alias("low"), F.max("value").alias("high"), F.avg((F.col("value") > 0).cast("double")).alias("positive"),
        strength(F.col("value")).alias("strength"),
    )


def strength(value: Column) -> Column:
    """Mean of the positive values, 0 without any."""
    return F.coalesce(F.avg(F.when(value > 0, value)), F.lit(0.0))


def exposure(table: DataFrame, radius: int = 3) -> DataFrame:
    """acc, aa, weight: each residue's share in the windows that cover it, by amino acid."""
    share = F.sum(1.0 / F.col("w")).over(around(radius))
    return own(table.withColumn("w", width(radius)).withColumn("share", share)).groupBy("acc", "aa").agg(F.sum("share").alias("weight"))


def half_width(window: int) -> Column:
    return F.least(F.lit(window // 2), F.col("n") - 1)


def sliding_average(table: DataFrame, value: str, window: int, weighted: bool = False, shrink: bool = True, numerator: Column | None = None) -> Column:
    """Centred average that shrinks at the ends, or is null there.

    ``weighted``: a residue counts by the width of its own window, as in a second smoothing.
    ``numerator`` replaces the value in the sum but not in the widths.
    """
    h = window // 2
    frame = around(h)
    w = (1 + F.least(F.col("pos"), half_width(window)) + F.least(F.col("n") - 1 - F.col("pos"), half_width(window))).cast("long") if weighted else F.lit(1).cast("long")
    x = F.col(value) if numerator is None else numerator
    mean = F.sum(w * x).over(frame) / F.sum(w).over(frame)
    return mean if shrink else F.when((F.col("pos") >= h) & (F.col("pos") < F.col("n") - h), mean)


def proline_once(value: Column) -> Column:
    """0 for a proline right behind or one behind another, so that PP and PxP count once."""
    again = (F.col("aa") == "P") & ((F.coalesce(F.lag("aa", 1).over(by_position()), F.lit("")) == "P") | (F.coalesce(F.lag("aa", 2).over(by_position()), F.lit("")) == "P"))
    return F.when(again, 0).otherwise(value)


def best_window(table: DataFrame, value: Column, length: int, shorter: bool) -> DataFrame:
    """acc, best, first, last: the greatest sum over ``length`` residues, the earliest on ties.

    ``shorter``: a protein under that length is one window; else it has none (null).
    """
    ahead = by_position().rowsBetween(0, length - 1)
    fits = F.col("pos") + length <= F.col("n")
    fits = fits | ((F.col("n") < length) & (F.col("pos") == 0)) if shorter else fits
    if length > HALO:
        raise ValueError(f"windows ahead reach {HALO} residues at most")
    got = own(table.withColumn("_v", value).withColumn("_sum", F.when(fits, F.sum("_v").over(ahead))))
    best = F.max(F.when(F.col("_sum").isNotNull(), F.struct(F.col("_sum"), (-F.col("pos")).alias("back"))))
    got = got.groupBy("acc", "n").agg(best.alias("best"))
    first = -F.col("best.back")
    return got.select("acc", "n", F.col("best._sum").alias("best"), first.alias("first"), F.least(first + length, F.col("n")).alias("last"))


def best_subarray(table: DataFrame, value: Column) -> DataFrame:
    """acc, best: the greatest sum over any stretch: prefix sums less their least so far.

    Of each chunk the total, the best beginning, end and stretch; those of a sequence's chunks are combined in order.
    """
    running = by_position().rowsBetween(Window.unboundedPreceding, 0)
    got = own(table).withColumn("_sum", F.sum(value).over(running))
    before = F.least(F.coalesce(F.min("_sum").over(by_position().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    got = got.withColumn("_before", before).groupBy("acc", "_from").agg(F.max_by("_sum", "pos").alias("total"), F.max("_sum").alias("head"), F.min("_before").alias("_low"), F.max(F.col("_sum") - F.col("_before")).alias("best"))
    parts = F.array_sort(F.collect_list(F.struct("_from", "total", "head", (F.col("total") - F.col("_low")).alias("tail"), "best")))

    def joined(x: Column, y: Column) -> Column:
        return F.struct(
            y["_from"].alias("_from"), (x["total"] + y["total"]).alias("total"), F.greatest(x["head"], x["total"] + y["head"]).alias("head"),
            F.greatest(y["tail"], x["tail"] + y["total"]).alias("tail"), F.greatest(x["best"], y["best"], x["tail"] + y["head"]).alias("best"),
        )

    got = got.groupBy("acc").agg(parts.alias("parts"))
    return got.select("acc", F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.col("parts")[0], joined)["best"].alias("best"))


def runs(table: DataFrame, state: Column) -> DataFrame:
    """acc, n, first, last (excluded), size: maximal stretches where ``state`` holds.

    Stretches are found within chunks; those that touch a border between two, two a chunk at most, are joined to their neighbours.
    """
    got = own(table.withColumn("_in", F.coalesce(state, F.lit(False))))
    start = F.col("_in") & ~F.coalesce(F.lag("_in").over(by_position()), F.lit(False))
    got = got.withColumn("_run", F.sum(start.cast("long")).over(by_position().rowsBetween(Window.unboundedPreceding, 0))).where("_in")
    got = got.groupBy("acc", "n", "_from", "_to", "_run").agg(F.min("pos").cast("long").alias("first"), (F.max("pos") + 1).cast("long").alias("last"))
    open_ = ((F.col("first") == F.col("_from")) & (F.col("_from") > 0)) | ((F.col("last") == F.col("_to")) & (F.col("_to") < F.col("n")))
    got = got.select("acc", "n", "first", "last", open_.alias("_open"))
    order = Window.partitionBy("acc").orderBy("first")
    new = F.coalesce(F.lag("last").over(order) != F.col("first"), F.lit(True)).cast("long")
    met = got.where("_open").withColumn("_new", new).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    met = met.groupBy("acc", "n", "_group").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_group")
    return got.where("not _open").drop("_open").unionByName(met).withColumn("size", F.col("last") - F.col("first"))


def fold_index(table: DataFrame) -> DataFrame:
    """Adds fi: 2.785 H - |R| - 1.151 over windows of 41. H is (Kyte-Doolittle) / 9 + 0.5, R the mean charge."""
    charge = {"D": -1, "E": -1, "K": 1, "R": 1}
    frame = around(FOLD_WINDOW // 2)
    h = F.sum(valued(HYDROPATHY10)).over(frame).cast("double") / width(FOLD_WINDOW // 2) / 90.0 + 0.5
    r = F.abs(F.sum(valued(charge)).over(frame).cast("double") / width(FOLD_WINDOW // 2))
    return table.withColumn("fi", FOLD_H * h + FOLD_R * r + FOLD_C)


def disordered_runs(table: DataFrame, least: int = 5) -> DataFrame:
    """acc, n, first, last: stretches with fi < 0 inside the full-window span, of ``least`` residues or more.

    One that begins or ends the span is extended to the terminus.
    """
    h = F.least(F.lit((FOLD_WINDOW - 1) // 2), F.floor(F.col("n") / 2)).cast("long")
    inside = (F.col("pos") >= h) & (F.col("pos") < F.col("n") - h)
    got = runs(fold_index(table), inside & (F.col("fi") < 0))
    first = F.when(F.col("first") == h, F.lit(0).cast("long")).otherwise(F.col("first"))
    last = F.when(F.col("last") == F.col("n") - h, F.col("n")).otherwise(F.col("last"))
    return got.select("acc", "n", first.alias("first"), last.alias("last")).where(F.col("last") - F.col("first") >= least)


def core_domains(table: DataFrame, state: Column, value: Column, length: int = CORE) -> DataFrame:
    """acc, core, core_first, domain, domain_first, domain_last: the best window inside stretches of ``state``, and its stretch's sum.

    The best window is sought in the chunks; then only its own stretch is summed, and no stretch is numbered.
    """
    whole = runs(table, state)
    ahead = by_position().rowsBetween(0, length - 1)
    got = table.withColumn("_in", F.coalesce(state, F.lit(False))).withColumn("_v", value)
    inside = (F.min(F.col("_in").cast("int")).over(ahead) == 1) & (F.col("pos") + length <= F.col("n"))
    got = own(got.withColumn("_core", F.when(inside, F.sum("_v").over(ahead))))
    best = got.where("_core is not null").groupBy("acc").agg(F.max(F.struct("_core", (-F.col("pos")).alias("back"))).alias("best"))
    best = best.select("acc", F.col("best._core").alias("core"), (-F.col("best.back")).cast("long").alias("core_first"))
    domain = best.join(whole.select("acc", F.col("first").alias("domain_first"), F.col("last").alias("domain_last")), "acc").where("core_first >= domain_first and core_first < domain_last")
    sums = got.join(domain.select("acc", "domain_first", "domain_last"), "acc").where("pos >= domain_first and pos < domain_last").groupBy("acc").agg(F.sum("_v").alias("domain"))
    return domain.join(sums, "acc").select("acc", "core", "core_first", "domain", "domain_first", "domain_last")


def top_neighbourhood(table: DataFrame, value: str, top: int = 60, spread: int = 5) -> DataFrame:
    """acc, top_mean: the mean over the ``top`` best residues (and ties with the last) and all within ``spread`` of them."""
    # The best of each chunk, then the best of these.
    best = own(table).withColumn("_rank", F.row_number().over(Window.partitionBy("acc", "_from").orderBy(F.desc(value), "pos"))).where(F.col("_rank") <= top)
    ranked = best.withColumn("_rank", F.row_number().over(Window.partitionBy("acc").orderBy(F.desc(value), "pos")))
    cut = ranked.where(F.col("_rank") == F.least(F.lit(top), F.col("n"))).select("acc", F.col(value).alias("_cut"))
    got = table.join(cut, "acc").withColumn("_near", F.max((F.col(value) >= F.col("_cut")).cast("int")).over(around(spread)))
    return own(got).where("_near = 1").groupBy("acc").agg(F.avg(value).alias("top_mean"), F.count("*").alias("n_near"))


def spread_average(table: DataFrame, value: str, widths: tuple[int, ...] = (20, 40, 60)) -> DataFrame:
    """Adds avg_<w>: the mean of the w residues around, where they fit; elsewhere the nearest that fits."""
    out = table
    for w in widths:
        fits = (F.col("pos") >= w // 2) & (F.col("pos") + (w - w // 2) <= F.col("n"))
        out = out.withColumn("_m", F.when(fits, F.avg(value).over(by_position().rowsBetween(-(w // 2), w - w // 2 - 1))))
        # Backwards, as a frame up to the end would be summed anew for every row.
        behind = F.last("_m", ignorenulls=True).over(Window.partitionBy("acc", "_from").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
        before = F.last("_m", ignorenulls=True).over(by_position().rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(f"avg_{w}", F.coalesce("_m", before, behind)).drop("_m")
    return out


def letter_counts(table: DataFrame, k: int = 1) -> DataFrame:
    """gram, count over all proteins for words of ``k`` neighbouring residues."""
    gram = F.concat(F.col("aa"), *[F.lead("aa", j).over(by_position()) for j in range(1, k)])
    return own(table.withColumn("gram", gram)).where("gram is not null").groupBy("gram").agg(F.count("*").alias("count"))


def background(table: DataFrame, alpha: float) -> DataFrame:
    """aa, count, frequency: observed shares mixed with the yeast proteome's by ``alpha``."""
    from peptora.functions.tables import YEAST

    reference = F.get(F.array(*[F.lit(f / sum(YEAST)) for f in YEAST]), F.instr(F.lit(RESIDUES), F.col("aa")) - 1)
    got = own(table).groupBy("aa").agg(F.count("*").alias("count"))
    total = got.agg(F.sum("count").alias("total"))  # one row of twenty
    return got.join(total).select("aa", "count", (alpha * reference + (1 - alpha) * F.col("count").cast("double") / F.col("total")).alias("frequency"))


def state_share(table: DataFrame) -> DataFrame:
    """Of (acc, state, score): the share of state D, mean and greatest score."""
    return table.groupBy("acc").agg(F.avg((F.col("state") == "D").cast("double")).alias("share"), F.avg("score").alias("mean"), F.max("score").alias("high"))


def aligned_profile(profile_: DataFrame, single: DataFrame) -> DataFrame:
    """The profile shifted so that its mean is the protein's single score."""
    mean = F.avg("value").over(Window.partitionBy("acc"))
    return profile_.join(single, "acc").withColumn("value", F.col("value") + (F.col("single") - mean)).drop("single")


def batch_scores(sequences: DataFrame, route: str = "paper") -> DataFrame:
    """Every row with its own score, or with what is wrong with its sequence (null, empty, unsupported).

    Equal sequences are scored once, under their digest; accessions may repeat or be null.
    """
    from peptora.functions.sequence import is_standard

    fine = F.coalesce(is_standard(F.col("seq")), F.lit(False))
    error = F.when(F.coalesce(F.length("seq"), F.lit(0)) == 0, "empty sequence").when(~fine, "unsupported residues")
    rows = sequences.withColumn("error", error).withColumn("_key", F.when(fine, F.sha2("seq", 256)))
    distinct = rows.where("_key is not null").groupBy("_key").agg(F.first("seq").alias("seq"))
    scored = protein_scores(distinct.withColumnRenamed("_key", "acc"), route).select(F.col("acc").alias("_key"), "score")
    return rows.join(scored, "_key", "left").drop("_key")


def prion_propensity_peak(table: DataFrame, window: int = 41) -> DataFrame:
    """acc, papa, at: the greatest twice-smoothed propensity where the twice-smoothed fold index is negative.

    Null where the protein is under the window or nowhere disordered; the earliest on ties.
    """
    from peptora.functions.tables import prion_propensity

    h = (window - 1) // 2
    got = fold_index(table).withColumn("_p", valued(prion_propensity()))
    got = got.withColumn("_once", proline_once(F.col("_p")))
    got = got.withColumn("_papa", sliding_average(got, "_p", window, numerator=F.col("_once")))
    got = got.withColumn("_papa2", sliding_average(got, "_papa", window, weighted=True)).withColumn("_fi2", sliding_average(got, "fi", FOLD_WINDOW, weighted=True))
    fits = (F.col("pos") >= h) & (F.col("pos") < F.col("n") - h) & (F.col("_fi2") < 0)
    best = F.max(F.when(fits, F.struct("_papa2", (-F.col("pos")).alias("back"))))
    return own(got).groupBy("acc").agg(best.alias("b")).select("acc", F.col("b._papa2").alias("papa"), (-F.col("b.back")).cast("long").alias("at"))
