"""Operators on files, records, profiles and verdicts of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

#: The largest table of profiles that is broadcast.
MOST_PROFILES = 20_000
#: Beyond it, pictures are dealt into so many parts, and each part meets the profiles for any camera.
DEALT = 64
#: Pictures of a kind are dealt into so many shares, its verdicts into so many arrays, and what meets into so many tasks.
SHARES, ARRAYS, TASKS = 16, 64, 400


def _met_by_all(kinds: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every kind of picture with every one of the profiles, which are for any camera.

    All pairs are the result; the join has a key of its own, so it is neither a product nor one task."""
    small = profiles.limit(MOST_PROFILES + 1).count() <= MOST_PROFILES
    parts = 1 if small else DEALT
    dealt = profiles.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = kinds.withColumn("_part", F.pmod(F.xxhash64("_model", "planes"), F.lit(parts)).cast("int"))
    return asked.join(F.broadcast(dealt) if small else dealt, "_part").drop("_part")


def claims(jobs: DataFrame, target: str, order: list[str], name: str) -> DataFrame:
    """jobs with `claim` (kept or refused) and `holder`: the first job of a target has it, later ones are refused naming it.

    Order and name together must tell jobs apart."""
    first = F.struct(*order, F.col(name).alias("_name"))
    # One row a target, combined before it is exchanged: a target of very many jobs is no task of its own.
    holders = jobs.groupBy(target).agg(F.min(first).alias("_first"))
    met = jobs.join(holders, target)
    return met.withColumn("claim", F.when(first == F.col("_first"), "kept").otherwise("refused")).withColumn("holder", F.col("_first")["_name"]).drop("_first")


def distinct_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of equal ones, the first in order, with how many there were."""
    rest = [c for c in rows.columns if c not in keys]
    least = F.min(F.struct(order, *[c for c in rest if c != order])).alias("s")
    return rows.groupBy(*keys).agg(least, F.count("*").alias("twins")).select(*keys, *[f"s.{c}" for c in rest], "twins")


def select_profiles(pictures: DataFrame, profiles: DataFrame, any_camera: bool = False) -> DataFrame:
    """(picture columns, profile columns, verdict) of all profiles that fit a picture's camera.

    pictures: picture, model, planes. profiles: ord, profile, camera, profile_planes, policy. A
    profile fits if it names no camera, or the same by letters and digits. Then, in this order,
    it is refused for its planes, its policy (2: never embed) or a name taken by an earlier one.

    All that is settled once for each kind of picture (model and planes), of which there are few; pictures meet
    the verdicts of their kind last, so that the pairs, which are the result, are never exchanged or sorted. As there
    are few kinds, the pictures of each are dealt into shares, and each share meets the kind's verdicts, which
    travel as arrays and are laid out a picture at a time."""
    p = profiles.withColumn("_camera", text.normalised_name(F.col("camera")))
    i = pictures.withColumn("_model", text.normalised_name(F.col("model")))
    kinds = i.select("_model", "planes").distinct()
    if any_camera:
        met = _met_by_all(kinds, p)
    else:
        # Two equi-joins in place of an OR: profiles of the camera, and those for any. An empty
        # name stands for both, and a picture without a name has the second kind only.
        named = kinds.join(p.where("camera <> ''"), F.col("_model") == F.col("_camera"))
        met = named.unionByName(_met_by_all(kinds, p.where("camera = ''")))
    reason = F.when(F.col("planes") != F.col("profile_planes"), "planes").when(F.col("policy") == 2, "policy")
    judged = met.withColumn("_reason", reason)
    twins = Window.partitionBy("_model", "planes", "profile", F.col("_reason").isNull()).orderBy("ord")
    verdict = F.coalesce("_reason", F.when(F.row_number().over(twins) > 1, "twin"), F.lit("chosen"))
    each = F.struct(*profiles.columns, verdict.alias("verdict")).alias("_each")
    verdicts = judged.select("_model", "planes", F.pmod(F.xxhash64("ord"), F.lit(ARRAYS)).alias("_array"), each)
    verdicts = verdicts.groupBy("_model", "planes", "_array").agg(F.collect_list("_each").alias("_verdicts"))

    def dealt(rows: DataFrame, share: Column) -> DataFrame:
        """rows with their kind and share as keys that are never null, in as many tasks as the other side's."""
        keys = {"_k0": F.coalesce("_model", F.lit("")), "_k1": F.isnull("_model"), "_k2": F.coalesce("planes", F.lit(0)), "_k3": F.isnull("planes"), "_k4": share.cast("int")}
        return rows.withColumns(keys).repartition(TASKS, *keys)

    own = dealt(i, F.pmod(F.xxhash64("picture"), F.lit(SHARES))).select(*pictures.columns, *[f"_k{k}" for k in range(5)])
    met = dealt(verdicts.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), F.col("_share")).select("_verdicts", *[f"_k{k}" for k in range(5)])
    return own.join(met.hint("merge"), [f"_k{k}" for k in range(5)]).select(*pictures.columns, F.inline("_verdicts"))


def update_by_time(jobs: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """jobs (key, source_time, sidecar_time) with `state` against targets (key, target_time): new, up to date or stale."""
    newest = F.greatest("source_time", F.coalesce("sidecar_time", "source_time"))
    state = F.when(F.col("target_time").isNull(), "new").when(F.col("target_time") >= newest, "up to date").otherwise("stale")
    return jobs.join(targets, key, "left").withColumn("state", state)


def update_by_content(sources: DataFrame, records: DataFrame, key: str, digest: Column) -> DataFrame:
    """sources (key, size, sidecar_md5) with `state` and `what` against records (key, r_size, r_md5, r_sidecar).

    The digest, a column of sources, is taken where the content is read, so that only its 32
    letters travel to the one join. Sizes come first: where they differ, the digest doesn't count.
    Without a record nothing is known. The content itself isn't in the result."""
    slim = sources.select(key, "size", "sidecar_md5", digest.alias("_digest"))
    met = slim.join(records, key, "left")
    both = met.withColumn("_changed", (F.col("size") != F.col("r_size")) | (F.col("_digest") != F.col("r_md5"))).drop("_digest")
    # The texts of what has changed.
    note = (
        F.when(F.col("r_sidecar").isNotNull() & F.col("sidecar_md5").isNull(), "sidecar no longer there")
        .when(F.col("r_sidecar").isNull() & F.col("sidecar_md5").isNotNull(), "sidecar added")
        .when(F.col("r_sidecar") != F.col("sidecar_md5"), "sidecar changed")
    )
    known = F.col("r_size").isNotNull()
    what = F.concat_ws(", ", F.when(F.col("_changed"), "source changed"), note)
    return both.withColumn("what", F.when(known, what).otherwise("")).withColumn("state", F.when(~known, "no record").when(F.col("what") == "", "up to date").otherwise("changed")).drop("_changed")


def merge_missing(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """first, and of second what first lacks by its keys."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def overridden(camera: DataFrame, decoder: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The camera's values over the decoder's."""
    both = camera.withColumnRenamed(value, "_camera").join(decoder.withColumnRenamed(value, "_decoder"), keys, "full")
    return both.select(*keys, F.coalesce("_camera", "_decoder").alias(value), F.when(F.col("_camera").isNotNull(), "camera").when(F.col("_decoder").isNotNull(), "decoder").alias("origin"))


def segments(knots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high, r0, v0, slope) of curves' knots (keys, radius, value); the end segments reach on without end."""
    ordered = Window.partitionBy(*keys).orderBy("radius")
    near = knots.select(
        *keys,
        F.col("radius").alias("r0"),
        F.col("value").alias("v0"),
        F.lead("radius").over(ordered).alias("r1"),
        F.lead("value").over(ordered).alias("v1"),
        F.row_number().over(ordered).alias("i"),
        F.count("*").over(Window.partitionBy(*keys)).alias("n"),
    )
    used = near.where("i < n or n = 1")
    low = F.when(F.col("i") == 1, F.lit(float("-inf"))).otherwise(F.col("r0"))
    high = F.when(F.col("i") >= F.col("n") - 1, F.lit(float("inf"))).otherwise(F.col("r1"))
    slope = F.when(F.col("n") == 1, 0.0).otherwise((F.col("v1") - F.col("v0")) / F.nullif(F.col("r1") - F.col("r0"), F.lit(0.0)))
    return used.select(*keys, low.alias("low"), high.alias("high"), "r0", "v0", slope.alias("slope"))


def interpolated(points: DataFrame, knots: DataFrame, keys: list[str], at: str, out: str) -> DataFrame:
    """points with `out`, their curve's value at `at`: linear between knots and on beyond them; 0 without a curve.

    A curve's segments are gathered into one array (a lens has at most some hundred knots), so
    each point looks its segment up without a range join."""
    packed = segments(knots, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("low", "high", "r0", "v0", "slope"))).alias("_segments"))
    if keys:
        met = points.join(packed, keys, "left")
    else:
        met = points.join(F.broadcast(packed), F.lit(True), "left")  # one row
    r = F.col(at)
    own = F.filter("_segments", lambda s: (s["low"] <= r) & (r < s["high"]))[0]
    return met.withColumn("_s", own).withColumn(out, F.coalesce(F.col("_s.v0") + (r - F.col("_s.r0")) * F.col("_s.slope"), F.lit(0.0))).drop("_s", "_segments")


def required_sizes(extents: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """(keys, required, size, missing): how far a file's parts (offset, bytes) reach, and how much of that isn't there."""
    need = extents.groupBy(*keys).agg(F.max(F.col("offset") + F.col("bytes")).alias("required"), F.max(size).alias("size"))
    return need.withColumn("missing", F.greatest(F.lit(0), F.col("required") - F.col("size")))


def outcomes(reports: DataFrame, outcome: str, failed: list[str]) -> DataFrame:
    """(outcome, n, status): how often each, and the run's exit status by it."""
    counted = reports.groupBy(outcome).agg(F.count("*").alias("n"))
    return counted.withColumn("status", F.when(F.col(outcome).isin(failed), 1).otherwise(0))


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds, or null."""
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for reason, test in rules[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), reason)
    return out


def frame_rules() -> list[tuple[str, Column]]:
    """What a frame must keep to, in the order in which it is tested."""
    c = F.col
    outside = (c("bottom") > c("height")) | (c("right") > c("width")) | (c("top") >= c("bottom")) | (c("left") >= c("right"))
    crop = (c("crop_width") <= 0) | (c("crop_height") <= 0) | (c("crop_left") + c("crop_width") > c("right") - c("left")) | (c("crop_top") + c("crop_height") > c("bottom") - c("top"))
    return [
        ("empty frame", (c("width") <= 0) | (c("height") <= 0)),
        ("samples per pixel", ~c("spp").between(1, 4)),
        ("buffer length", c("samples") != c("width") * c("height") * c("spp")),
        ("colour planes", ~c("planes").between(1, 4)),
        ("mosaic samples", c("is_cfa") & (c("spp") != 1)),
        ("mosaic planes", c("is_cfa") & (c("planes") < 3)),
        ("linear planes", ~c("is_cfa") & (c("planes") != c("spp"))),
        ("active area", outside),
        ("default crop", crop),
        ("orientation", ~c("orientation").between(1, 8)),
        ("pixel scale", ~((c("scale_h") > 0) & (c("scale_v") > 0))),
    ]


def poly_moments(points: DataFrame, keys: list[str], x: Column, y: Column, weight: Column, degree: int) -> DataFrame:
    """Weighted sums of x^k and of y x^k: what a least-squares polynomial of that degree needs, partial sums first."""
    sums = [F.sum(weight * F.pow(x, F.lit(float(k)))).alias(f"s{k}") for k in range(2 * degree + 1)]
    sums += [F.sum(weight * y * F.pow(x, F.lit(float(k)))).alias(f"t{k}") for k in range(degree + 1)]
    return points.groupBy(*keys).agg(*sums)


def poly_fits(moments: DataFrame, keys: list[str], degree: int) -> DataFrame:
    """(keys, c0..c_degree) from poly_moments: one small system of equations a row."""
    import numpy as np
    import pandas as pd

    def solve(batches):
        for b in batches:
            out = b[keys].copy()
            a = np.stack([np.stack([b[f"s{i + j}"].to_numpy(float) for j in range(degree + 1)], 1) for i in range(degree + 1)], 1)
            t = np.stack([b[f"t{i}"].to_numpy(float) for i in range(degree + 1)], 1)
            # Scaled to a unit diagonal: powers of x differ by many orders.
            d = 1 / np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
            c = np.stack([np.linalg.lstsq(m * e[:, None] * e[None, :], v * e, rcond=None)[0] * e for m, v, e in zip(a, t, d)]) if len(b) else np.empty((0, degree + 1))
            for k in range(degree + 1):
                out[f"c{k}"] = c[:, k]
            yield pd.DataFrame(out)

    kinds = ", ".join(f"`{k}` {moments.schema[k].dataType.simpleString()}" for k in keys)
    return moments.mapInPandas(solve, ", ".join([*([kinds] if keys else []), *[f"c{k} double" for k in range(degree + 1)]]))
