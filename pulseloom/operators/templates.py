"""Ensemble templates of waves in long form (entity, wave, offset, value), their alignment and similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseloom.functions import kernels
from pulseloom.functions.common import join_summary, quoted
from pulseloom.operators.moving import _number, exact_median


def align_waves(waves: DataFrame, keys: list[str], wave: str, offset: str, value: str, anchor: str) -> DataFrame:
    """Shift waves so that their ``anchor`` offsets coincide, and their values so that they agree there.

    Adds ``aligned_offset`` (0 at the anchor) and ``aligned`` (the value minus the wave's own value at its anchor plus
    the entity's mean value there). Waves without a value at their anchor are dropped.
    """
    at_anchor = waves.where(quoted(offset) == quoted(anchor)).select(*map(quoted, keys), quoted(wave), _number(value).alias("__own")).where("__own is not null")
    level = at_anchor.groupBy(*map(quoted, keys)).agg(F.avg("__own").alias("__level"))
    joined = waves.join(at_anchor, [*keys, wave]).join(level, keys)
    return joined.withColumns({"aligned_offset": quoted(offset) - quoted(anchor), "aligned": _number(value) - F.col("__own") + F.col("__level")}).drop("__own", "__level")


def good_waves(waves: DataFrame, keys: list[str], wave: str, offset: str, value: str, multiplier: float = 2.5) -> DataFrame:
    """Drop waves whose length, peak height or peak position is unusual for their entity.

    Length: further than ``multiplier`` deviations from the median; peak height: twice, peak position: three times
    that from the mean. Entities of one wave keep it.
    """
    top = F.max(F.struct(_number(value).alias("v"), (-quoted(offset)).alias("p")))
    shape = waves.groupBy(*map(quoted, keys), quoted(wave)).agg(F.count("*").alias("__n"), top.alias("__top"))
    shape = shape.select(*map(quoted, keys), quoted(wave), "__n", F.col("__top.v").alias("__height"), (-F.col("__top.p")).alias("__at"))
    middle = exact_median(shape, keys, F.col("__n"), "__n_median")
    stats = shape.groupBy(*map(quoted, keys)).agg(*(f(c).alias(f"{c}_{name}") for c in ("__n", "__height", "__at") for name, f in (("avg", F.avg), ("std", F.stddev_samp))))
    scored = shape.join(stats, keys).join(middle, keys)
    near = lambda c, centre, times: (F.abs(F.col(c) - F.col(centre)) <= F.coalesce(F.col(f"{c}_std"), F.lit(0.0)) * multiplier * times) | F.col(f"{c}_std").isNull()
    kept = scored.where(near("__n", "__n_median", 1) & near("__height", "__height_avg", 2) & near("__at", "__at_avg", 3))
    return waves.join(kept.select(*map(quoted, keys), quoted(wave)), [*keys, wave], "left_semi")


def template(waves: DataFrame, keys: list[str], offset: str, value: str) -> DataFrame:
    """Median wave of each entity: keys, offset, template, n_waves. Missing values are skipped."""
    known = waves.where(_number(value).isNotNull())
    counted = known.groupBy(*map(quoted, keys), quoted(offset)).agg(F.count("*").alias("n_waves"))
    whole = join_summary(counted, exact_median(known, [*keys, offset], _number(value), "template"), [*keys, offset])
    return whole.select(*map(quoted, keys), quoted(offset), "template", "n_waves")


def wave_scores(waves: DataFrame, keys: list[str], wave: str, offset: str, value: str, *, limit: float = 0.30) -> DataFrame:
    """How odd each wave is among its entity's waves: keys, wave, score, bad.

    A value further than 2.5, 3 and 4 deviations from its offset's mean scores 1, 3 and 9 for each limit passed; the
    score is the mean over the wave's values.
    """
    at = Window.partitionBy(*map(quoted, keys), quoted(offset))
    v = _number(value)
    off = F.abs(v - F.avg(v).over(at)) / F.stddev_samp(v).over(at)
    points = F.when(off > 2.5, 1).otherwise(0) + F.when(off > 3, 3).otherwise(0) + F.when(off > 4, 9).otherwise(0)
    scored = waves.withColumn("__points", points)
    return scored.groupBy(*map(quoted, keys), quoted(wave)).agg(F.avg("__points").alias("score")).withColumn("bad", F.col("score") > limit)


def neighbour_differences(templates: DataFrame, keys: list[str], order: str, value: str, reach: int = 3) -> DataFrame:
    """Squared summed difference of each template to the next ``reach`` ones of its entity: keys, first, second, difference.

    ``templates`` is in long form with the template's number in ``order``; the difference of two templates is the square of
    the difference of their sums. Only neighbours are compared, never all pairs of an entity.
    """
    sums = templates.groupBy(*map(quoted, keys), quoted(order).alias("first")).agg(F.sum(_number(value)).alias("__sum"))
    w = Window.partitionBy(*map(quoted, keys)).orderBy("first")
    later = F.array(*(F.struct(F.lead("first", k).over(w).alias("second"), F.lead("__sum", k).over(w).alias("other")) for k in range(1, reach + 1)))
    wide = sums.withColumn("__later", later).withColumn("__pair", F.explode("__later")).where("__pair.second is not null")
    return wide.select(*map(quoted, keys), "first", F.col("__pair.second").alias("second"), F.pow(F.col("__sum") - F.col("__pair.other"), 2).alias("difference"))


def correlation_to_template(waves: DataFrame, templates: DataFrame, keys: list[str], wave: str, offset: str, value: str) -> DataFrame:
    """Pearson correlation of each wave with its entity's template, not below 0; null for flat waves."""
    joined = waves.join(templates.select(*map(quoted, keys), quoted(offset), "template"), [*keys, offset])
    both = joined.groupBy(*map(quoted, keys), quoted(wave)).agg(F.corr(_number(value), F.col("template")).alias("__r"))
    return both.select(*map(quoted, keys), quoted(wave), F.greatest(F.nanvl("__r", F.lit(None).cast("double")), F.lit(0.0)).alias("correlation")).where("correlation is not null")


def similarity_to_template(waves: DataFrame, ids: list[str], samples: str, reference: str, *, points: int = 64) -> DataFrame:
    """Similarity of array waves to array templates: ids, correlation, correlation_resampled, warp and frechet.

    Both arrays are brought to unit range; ``correlation`` takes the common first part, the other measures ``points``
    evenly spaced points of each. Null, empty and single-value arrays give null measures; flat ones null correlations.
    """
    schema = T.StructType([*waves.select(*map(quoted, ids)).schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("correlation", "correlation_resampled", "warp", "frechet"))])
    arrow = to_arrow_schema(schema)

    def corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
        return np.where(size > 0, (a * b).sum(1) / np.where(size > 0, size, 1), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((batch.num_rows, 4), np.nan)
            rows: list[int] = []
            a_all, b_all = [], []
            for i, (a, b) in enumerate(zip(batch.column("__a").to_pylist(), batch.column("__b").to_pylist(), strict=True)):
                a, b = (np.array([] if v is None else [np.nan if u is None else u for u in v], float) for v in (a, b))
                a, b = a[np.isfinite(a)], b[np.isfinite(b)]
                if len(a) < 2 or len(b) < 2:
                    continue
                n = min(len(a), len(b))
                out[i, 0] = corr(a[None, :n], b[None, :n])[0]
                unit = lambda v: (v - v.min()) / max(float(np.ptp(v)), 1e-12)
                rows.append(i)
                a_all.append(kernels.resampled(unit(a)[None], points)[0])
                b_all.append(kernels.resampled(unit(b)[None], points)[0])
            if rows:
                x, y = np.stack(a_all), np.stack(b_all)
                out[rows, 1], out[rows, 2], out[rows, 3] = corr(x, y), kernels.warp_distance(x, y) / points, kernels.frechet_distance(x, y)
            yield pa.record_batch([*(batch.column(c) for c in ids), *(pa.array(out[:, k], mask=np.isnan(out[:, k])) for k in range(4))], schema=arrow)

    return waves.select(*map(quoted, ids), quoted(samples).alias("__a"), quoted(reference).alias("__b")).mapInArrow(run, schema)


def nearest_stretches(df: DataFrame, ids: list[str], samples: str, query: list[float], k: int = 1) -> DataFrame:
    """The ``k`` stretches of each channel that are most like ``query``: ids, rank, idx, distance (z-normalised).

    Stretches overlap by less than half; missing samples are held; flat stretches and channels shorter than the query have none.
    """
    schema = T.StructType([*df.select(*map(quoted, ids)).schema.fields, T.StructField("rank", T.IntegerType()), T.StructField("idx", T.LongType()), T.StructField("distance", T.DoubleType())])
    arrow, wanted = to_arrow_schema(schema), np.asarray(query, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, ranks, places, distances = [], [], [], []
            for i, x in enumerate(batch.column("__x")):
                if not x.is_valid or not len(x.values):
                    continue
                profile = kernels.distance_profile(kernels.held(np.asarray(x.values.to_numpy(zero_copy_only=False), float)[None])[0], wanted)
                for rank in range(k):
                    if not np.isfinite(profile).any():
                        break
                    at = int(np.nanargmin(profile))
                    owner.append(i)
                    ranks.append(rank + 1)
                    places.append(at)
                    distances.append(float(profile[at]))
                    profile[max(0, at - len(wanted) // 2) : at + len(wanted) // 2 + 1] = np.nan
            if owner:
                yield pa.record_batch([*(batch.column(c).take(pa.array(owner)) for c in ids), pa.array(ranks, pa.int32()), pa.array(places, pa.int64()), pa.array(distances)], schema=arrow)

    return df.select(*map(quoted, ids), quoted(samples).alias("__x")).mapInArrow(run, schema)


def beat_quality(waves: DataFrame, keys: list[str], *, carry: tuple[str, ...] = ()) -> DataFrame:
    """Scores and class of each beat ``wave`` (keys, beat_no, wave, moving) against its key's template.

    The template is the median at the offsets that at least half of the key's beats reach. Columns: keys, carry, beat_no,
    direct, resampled (correlations, as 0..100), warped (100 less the mean distance along the warping of both in unit
    range), moving, frechet and quality_class. Beats of fewer than two samples and flat ones score 0.
    """
    long = waves.select(*map(quoted, keys), F.posexplode("wave").alias("pos", "value"))
    medians = template(long, keys, "pos", "value")
    sizes = waves.where(F.size("wave") > 0).groupBy(*map(quoted, keys)).agg(F.count("*").alias("__beats"))
    common = join_summary(medians, sizes, keys).where(F.col("n_waves") * 2 >= F.col("__beats"))
    whole = common.groupBy(*map(quoted, keys)).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "template"))), lambda s: s["template"]).alias("__reference"))
    ids = [*keys, *carry, "beat_no", "moving"]
    scored = similarity_to_template(join_summary(waves, whole, keys), ids, "wave", "__reference")
    score = lambda x: F.when(flat | x.isNull(), 0.0).otherwise(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)) * 100)
    flat = F.col("correlation").isNull()
    four = {"direct": score(F.col("correlation")), "resampled": score(F.col("correlation_resampled")), "warped": score(1 - F.col("warp")), "moving": F.coalesce("moving", F.lit(0.0))}
    rows = scored.select(*map(quoted, [*keys, *carry]), "beat_no", *(c.alias(n) for n, c in four.items()), "frechet")
    return rows.withColumn("quality_class", quality_class(*map(F.col, four)))


def quality_class(direct: Column, resampled: Column, warped: Column, moving: Column) -> Column:
    """E (excellent), A (acceptable) or Q (questionable) from four scores of 0..100.

    E: all at least 90. A: three at least 90; or the median of the first three at least 80, the first at least 50 and the
    fourth at least 70; or all at least 70.
    """
    scores = (direct, resampled, warped, moving)
    least = F.least(*scores)
    high = sum(((c >= 90).cast("int") for c in scores), F.lit(0))
    median = F.sort_array(F.array(direct, resampled, warped))[1]
    return F.when(least >= 90, "E").when((high >= 3) | ((median >= 80) & (direct >= 50) & (moving >= 70)) | (least >= 70), "A").otherwise("Q")
