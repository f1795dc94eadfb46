"""Registered queries of the run, interval and matching operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.common import broadcast_if_small, load
from pulseloom.operators import intervals as I
from pulseloom.operators import matching as M
from pulseloom.operators import runs as R
from pulseloom.operators.features import concatenated
from pulseloom.operators.interval_islands import PERIOD, merge_intervals
from pulseloom.plans.views import BEATS_SQL, EPOCHS_SQL, MARKINGS_SQL, MERGED_SQL, SEG, beats, epochs, events_of, events_sql, markings, rates, rounded, signal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SEG_TIMES_SQL = "st AS (SELECT DISTINCT rec_id, seg_id, ecg_begin / ecg_rate AS t0, ecg_end / ecg_rate AS t1 FROM segment)"
RUNS_SQL = f"""WITH {EPOCHS_SQL}, m AS (SELECT *, CASE WHEN lag(epoch_no) OVER w IS NULL OR stage IS DISTINCT FROM lag(stage) OVER w THEN 1 ELSE 0 END AS b
  FROM ep WINDOW w AS (PARTITION BY rec_id ORDER BY epoch_no)),
n AS (SELECT *, sum(b) OVER (PARTITION BY rec_id ORDER BY epoch_no) AS run_no FROM m),
runs AS (SELECT rec_id, run_no::BIGINT AS run_no, any_value(stage) AS stage, count(*) AS n, min(epoch_no) AS first_position, max(epoch_no) AS last_position FROM n GROUP BY rec_id, run_no)
"""


@query(RUNS_SQL + "SELECT * FROM runs")
def rle_encode(spark: SparkSession, d: str) -> DataFrame:
    """Run-length code of the stages of each recording."""
    return R.encode_runs(epochs(spark, d), ["rec_id"], "epoch_no", "stage")


@query(f"WITH {EPOCHS_SQL} SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY epoch_no) - 1 AS position, stage FROM ep")
def rle_decode(spark: SparkSession, d: str) -> DataFrame:
    """The round trip: stages decoded from their run-length code."""
    return R.decode_runs(rle_encode(spark, d), ["rec_id"], "run_no", "stage", "n")


@query(RUNS_SQL + ", s AS (SELECT *, unnest(range(0, (n - 1) // 4 + 1)) AS part_no FROM runs) SELECT rec_id, run_no, stage, least(4, n - part_no * 4)::BIGINT AS n, part_no FROM s")
def rle_byte_split(spark: SparkSession, d: str) -> DataFrame:
    """Runs cut at a largest count (4 here; 255 for one-byte counts)."""
    return R.split_long_runs(rle_encode(spark, d), "n", 4).select("rec_id", "run_no", "stage", "n", "part_no")


@query(f"""WITH {events_sql('ppg_valley', 'v')}, f AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY rec_id, seg_id ORDER BY idx) > 300 OR
  lag(idx) OVER (PARTITION BY rec_id, seg_id ORDER BY idx) IS NULL THEN 1 ELSE 0 END AS far FROM v),
c AS (SELECT *, sum(far) OVER (PARTITION BY rec_id, seg_id ORDER BY idx)::BIGINT AS cluster_no FROM f)
SELECT rec_id, seg_id, cluster_no, min(idx) AS first, max(idx) AS last, count(*) AS n FROM c GROUP BY ALL""")
def gap_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Valleys at most 300 samples apart as clusters."""
    return R.cluster_by_gap(events_of(spark, d, "ppg_valley"), SEG, "idx", 300)


@query("""WITH s AS (SELECT DISTINCT rec_id, seg_id, ecg_begin, ecg_end, round(sleep_stages[1]) AS stage0 FROM segment),
t AS (SELECT rec_id, seg_id, ecg_begin, ecg_end, CASE WHEN NOT isnan(stage0) THEN stage0 END AS stage FROM s),
m AS (SELECT *, CASE WHEN lag(seg_id) OVER w IS NULL OR stage IS DISTINCT FROM lag(stage) OVER w THEN 1 ELSE 0 END AS b FROM t WINDOW w AS (PARTITION BY rec_id ORDER BY seg_id)),
n AS (SELECT *, sum(b) OVER (PARTITION BY rec_id ORDER BY seg_id)::BIGINT AS group_no FROM m)
SELECT rec_id, group_no, any_value(stage) AS stage, min(ecg_begin) AS ecg_begin, max(ecg_end) AS ecg_end, count(*) AS n_segments FROM n GROUP BY rec_id, group_no""")
def glue_equal_segments(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring segments that begin in the same stage, glued."""
    stage = F.nanvl(F.round(F.try_element_at("sleep_stages", F.lit(1))), F.lit(None).cast("double")).alias("stage")
    own = load(spark, d, "segment").select(*SEG, "ecg_begin", "ecg_end", stage).distinct()
    return R.merge_equal_neighbours(own, ["rec_id"], "seg_id", "stage", "ecg_begin", "ecg_end")


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "segment").where("ppg_end is not null and ppg_begin is not null").select(*SEG, (F.col("ppg_end") - F.col("ppg_begin")).alias("length"))
    return rows.distinct()


LENGTHS_SQL = "lens AS (SELECT DISTINCT rec_id, seg_id, ppg_end - ppg_begin AS length FROM segment WHERE ppg_end IS NOT NULL AND ppg_begin IS NOT NULL)"
LAYOUT_SQL = f"""{LENGTHS_SQL}, c AS (SELECT *, greatest(CASE WHEN length % 4096 < 2048 THEN length // 4096 ELSE ceil(length / 4096)::BIGINT END, 1) AS n FROM lens WHERE length > 0),
u AS (SELECT *, unnest(range(0, n)) AS bin_no FROM c),
bins AS (SELECT rec_id, seg_id, bin_no, bin_no * 4096 AS low, CASE WHEN bin_no = n - 1 THEN length ELSE (bin_no + 1) * 4096 END AS high FROM u)"""


@query(f"WITH {LAYOUT_SQL} SELECT * FROM bins")
def bin_layout(spark: SparkSession, d: str) -> DataFrame:
    """Bins of 4096 samples over each segment; the last one absorbs a short rest."""
    return I.bin_layout(_lengths(spark, d), SEG, "length", 4096)


@query(f"WITH {events_sql('ppg_valley', 'v')} SELECT rec_id, seg_id, idx, least(idx // 4096, 11) AS bin_no FROM v")
def bin_of_index(spark: SparkSession, d: str) -> DataFrame:
    """Bin of each valley in a layout of twelve bins."""
    return events_of(spark, d, "ppg_valley").select(*SEG, "idx", I.bin_of(F.col("idx"), 4096, F.lit(12)).alias("bin_no"))


@query(f"WITH {LAYOUT_SQL} SELECT rec_id, seg_id, bin_no, low, CASE WHEN high = lead(low) OVER (PARTITION BY rec_id, seg_id ORDER BY low) THEN high - 1 ELSE high END AS high FROM bins")
def border_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Bins whose shared borders belong to the later one."""
    return I.separate_borders(bin_layout(spark, d), SEG, "low", "high")


@query(f"WITH {MARKINGS_SQL} SELECT * FROM nz WHERE e - s >= 5000")
def min_length_filter(spark: SparkSession, d: str) -> DataFrame:
    """Markings of at least 5 s."""
    return markings(spark, d).where("e - s >= 5000")


@query(f"""WITH {MARKINGS_SQL}, u AS (SELECT *, unnest(range(s // 60000, e // 60000 + 1)) AS bin_no FROM nz WHERE s < e)
SELECT rec_id, label, greatest(s, bin_no * 60000) AS s, least(e, (bin_no + 1) * 60000) AS e, bin_no FROM u WHERE bin_no * 60000 < e""")
def split_at_bins(spark: SparkSession, d: str) -> DataFrame:
    """Markings split at full minutes."""
    return I.split_at_bins(markings(spark, d), "s", "e", 60000)


@query(f"WITH {MERGED_SQL} SELECT rec_id, s, e FROM merged")
def merge_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Union of a recording's markings, whatever their type."""
    merged = merge_intervals(markings(spark, d), ["rec_id"], "s", "e", touch=0).where(F.col("kind") == PERIOD)
    return merged.select("rec_id", F.col("start").alias("s"), F.col("end").alias("e"))


FREE_SQL = f"""{MERGED_SQL}, lim AS (SELECT rec_id, max(e) + 100000 AS high FROM nz GROUP BY rec_id),
fr AS (SELECT rec_id, coalesce(lag(e) OVER (PARTITION BY rec_id ORDER BY s), 0) AS s, s AS e FROM merged UNION ALL SELECT rec_id, max(e), max(e) + 100000 FROM merged GROUP BY rec_id),
free AS (SELECT rec_id, s, e FROM fr WHERE s < e)"""


@query(f"WITH {FREE_SQL} SELECT * FROM free")
def complement_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Stretches without any marking, up to 100 s behind the last one."""
    bounds = markings(spark, d).groupBy("rec_id").agg(F.lit(0).cast("bigint").alias("low"), (F.max("e") + 100000).alias("high"))
    return I.complement(merge_overlaps(spark, d), bounds, ["rec_id"], "s", "e", "low", "high")


@query(f"WITH {MARKINGS_SQL} SELECT rec_id, label, greatest(s - 1500, 0) AS s, least(e + 1500, 200000000) AS e FROM nz")
def expand_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Markings widened by 1.5 s within fixed limits."""
    return I.expand_and_clamp(markings(spark, d), "s", "e", 1500, 0, 200000000)


POINTS_SQL = f"WITH {MERGED_SQL}, {BEATS_SQL}, pt AS (SELECT rec_id, seg_id, beat_no, round(sec * 1000)::BIGINT AS at FROM beats WHERE sec IS NOT NULL)"


def _beat_points(spark: SparkSession, d: str) -> DataFrame:
    return beats(spark, d).where("sec is not null").select(*SEG, "beat_no", F.round(F.col("sec") * 1000).cast("bigint").alias("at"))


@query(POINTS_SQL + " SELECT * FROM pt WHERE EXISTS (SELECT 1 FROM merged m WHERE m.rec_id = pt.rec_id AND pt.at BETWEEN m.s AND m.e)")
def points_in_noise(spark: SparkSession, d: str) -> DataFrame:
    """Beats inside a marking."""
    return I.points_in_intervals(_beat_points(spark, d), merge_overlaps(spark, d), ["rec_id"], "at", "s", "e", cell=60000)


@query(POINTS_SQL + " SELECT * FROM pt WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.rec_id = pt.rec_id AND pt.at BETWEEN m.s AND m.e)")
def points_outside_noise(spark: SparkSession, d: str) -> DataFrame:
    """Beats outside all markings."""
    return I.points_in_intervals(_beat_points(spark, d), merge_overlaps(spark, d), ["rec_id"], "at", "s", "e", cell=60000, keep="outside")


@query(POINTS_SQL + """, o AS (SELECT * FROM pt WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.rec_id = pt.rec_id AND pt.at BETWEEN m.s AND m.e))
SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY o.at, o.seg_id, o.beat_no) - 1 AS position FROM o""")
def noise_free_series(spark: SparkSession, d: str) -> DataFrame:
    """The beats outside all markings as one series of each recording, with its time axis."""
    return concatenated(points_outside_noise(spark, d), ["rec_id"], ["at", "seg_id", "beat_no"], cell=600_000)


@query(f"""WITH {MARKINGS_SQL}, a AS (SELECT rec_id, s, e FROM nz WHERE label = 'PPG'), b AS (SELECT rec_id, s, e FROM nz WHERE label = 'ECG')
SELECT a.rec_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM a JOIN b ON a.rec_id = b.rec_id AND a.s <= b.e AND b.s <= a.e""")
def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Common stretches of PPG and ECG markings."""
    all_ = markings(spark, d)
    pick = lambda label: all_.where(F.col("label") == label).select("rec_id", "s", "e")
    return I.intersect_intervals(pick("PPG"), pick("ECG"), ["rec_id"], "s", "e", cell=60000)


@query(f"""WITH {MARKINGS_SQL}, o AS (SELECT *, max(e) OVER (PARTITION BY rec_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM nz WHERE label IN ('PPG', 'ECG')),
g AS (SELECT *, sum(CASE WHEN s <= upto THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT rec_id, label, min(s) AS s, max(e) AS e FROM g GROUP BY rec_id, label, island),
a AS (SELECT * FROM m WHERE label = 'PPG'), b AS (SELECT * FROM m WHERE label = 'ECG'),
t AS (SELECT coalesce(x.rec_id, y.rec_id) AS rec_id, coalesce(p, 0) AS left_total, coalesce(q, 0) AS right_total FROM (SELECT rec_id, sum(e - s)::BIGINT AS p FROM a GROUP BY 1) x
  FULL JOIN (SELECT rec_id, sum(e - s)::BIGINT AS q FROM b GROUP BY 1) y ON x.rec_id = y.rec_id),
c AS (SELECT a.rec_id, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS shared FROM a JOIN b ON a.rec_id = b.rec_id AND a.s <= b.e AND b.s <= a.e GROUP BY 1)
SELECT rec_id, left_total, right_total, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / nullif(left_total + right_total - coalesce(shared, 0), 0), 6) AS jaccard FROM t LEFT JOIN c USING (rec_id)""")
def marking_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the PPG and the ECG markings of each recording."""
    all_ = markings(spark, d)
    pick = lambda label: I.merge_overlaps(all_.where(F.col("label") == label), ["rec_id"], "s", "e")
    found = I.overlap_agreement(pick("PPG"), pick("ECG"), ["rec_id"], "s", "e", cell=60000)
    return found.withColumn("jaccard", rounded("jaccard"))


PIECES_SQL = f"""{FREE_SQL}, pu AS (SELECT *, unnest(range(s // 900000, e // 900000 + 1)) AS bin_no FROM free),
pieces AS (SELECT rec_id, greatest(s, bin_no * 900000) AS s, least(e, (bin_no + 1) * 900000) AS e, bin_no FROM pu WHERE bin_no * 900000 < e),
lastbin AS (SELECT rec_id, max(bin_no) AS last_bin FROM pieces GROUP BY rec_id),
moved AS (SELECT p.*, CASE WHEN NOT e - s < 450000 THEN 'stay'
  WHEN bin_no = 0 AND (s + e) / 2 < bin_no * 900000 + 450000 OR bin_no = last_bin AND NOT (s + e) / 2 < bin_no * 900000 + 450000 THEN 'drop'
  WHEN bin_no = 0 THEN 'right' WHEN bin_no = last_bin THEN 'left' WHEN (s + e) / 2 < bin_no * 900000 + 450000 THEN 'left' ELSE 'right' END AS move
  FROM pieces p JOIN lastbin USING (rec_id))"""


def _moved(spark: SparkSession, d: str) -> DataFrame:
    size = 900_000
    pieces = I.split_at_bins(complement_intervals(spark, d), "s", "e", size)
    last = pieces.groupBy("rec_id").agg(F.max("bin_no").alias("last_bin"))
    both = pieces.join(last, "rec_id").withColumns({"low": F.col("bin_no") * size, "high": (F.col("bin_no") + 1) * size})
    return I.mark_for_moving(both, "s", "e", "low", "high", F.col("bin_no") == 0, F.col("bin_no") == F.col("last_bin"), size / 2)


@query(f"WITH {PIECES_SQL} SELECT rec_id, s, e, bin_no, move FROM moved")
def movement_marks(spark: SparkSession, d: str) -> DataFrame:
    """Clean pieces of 15-minute bins, with where the short ones move."""
    return _moved(spark, d).select("rec_id", "s", "e", "bin_no", "move")


@query(f"""WITH {PIECES_SQL}, st AS (SELECT *, sum((move = 'stay')::INT) OVER (PARTITION BY rec_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k,
  sum((move = 'stay')::INT) OVER (PARTITION BY rec_id) AS total FROM moved WHERE move <> 'drop'),
nb AS (SELECT *, CASE WHEN move = 'right' THEN k ELSE k - 1 END AS n FROM st)
SELECT rec_id, s, e, move, CASE WHEN n BETWEEN 0 AND total - 1 THEN n END::BIGINT AS final_bin FROM nb""")
def anneal_assign(spark: SparkSession, d: str) -> DataFrame:
    """Final bin of each clean piece once short pieces have moved to their neighbours."""
    return I.assign_moved(_moved(spark, d), ["rec_id"], "s").select("rec_id", "s", "e", "move", "final_bin")


@query(f"""WITH {PIECES_SQL}, a AS (SELECT * FROM moved WHERE move <> 'drop'),
b AS (SELECT *, CASE WHEN s = lag(e) OVER w AND move <> 'stay' AND coalesce(lag(move) OVER w, 'stay') <> 'stay' THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY rec_id ORDER BY s)),
c AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY s) AS chain FROM b),
d AS (SELECT *, sum(e - s) OVER x >= 450000 AND count(*) OVER x > 1 AND move <> 'stay' AS joined, min(s) OVER x AS low, max(e) OVER x AS high FROM c WINDOW x AS (PARTITION BY rec_id, chain))
SELECT rec_id, s, CASE WHEN joined THEN high ELSE e END AS e, CASE WHEN joined THEN 'stay' ELSE move END AS move FROM d WHERE NOT joined OR s = low""")
def merged_movers(spark: SparkSession, d: str) -> DataFrame:
    """Short clean pieces that touch, joined where they are long enough together."""
    return I.merge_moving(_moved(spark, d), ["rec_id"], "s", "e", 450_000)


@query(f"""WITH {MARKINGS_SQL}, st AS (SELECT DISTINCT rec_id, seg_id, round(ecg_begin / ecg_rate * 1000)::BIGINT AS low, round(ecg_end / ecg_rate * 1000)::BIGINT AS high FROM segment)
SELECT st.rec_id, seg_id, greatest(s, low) - low AS s, least(e, high) - low AS e FROM st JOIN nz ON st.rec_id = nz.rec_id AND s <= high AND low <= e""")
def clip_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Markings inside segments, counted from the segment's begin."""
    ms = lambda c: F.round(F.col(c) / F.col("ecg_rate") * 1000).cast("bigint")
    pieces = load(spark, d, "segment").select(*SEG, ms("ecg_begin").alias("low"), ms("ecg_end").alias("high")).distinct()
    return I.clip_intervals(markings(spark, d), pieces, ["rec_id"], "s", "e", "low", "high", cell=60000).select(*SEG, "s", "e")


@query(f"""WITH {EPOCHS_SQL}, {SEG_TIMES_SQL}, g AS (SELECT DISTINCT rec_id, seg_id, i - 1 AS k, round(x) AS stage FROM (SELECT *, sleep_stages[i] AS x FROM (SELECT *, unnest(range(1, len(sleep_stages) + 1)) AS i FROM segment)) WHERE NOT isnan(x)),
f AS (SELECT st.rec_id, seg_id, min(epoch_no) AS e0 FROM st JOIN ep ON st.rec_id = ep.rec_id JOIN recording r ON r.rec_id = ep.rec_id WHERE (epoch_no + 1) * epoch_sec BETWEEN t0 AND t1 GROUP BY ALL)
SELECT g.rec_id, g.seg_id, count(*) AS n, count(*) FILTER (g.stage = ep.stage) AS n_equal FROM g JOIN f ON g.rec_id = f.rec_id AND g.seg_id = f.seg_id JOIN ep ON ep.rec_id = g.rec_id AND ep.epoch_no = e0 + k GROUP BY ALL""")
def stage_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How many of a segment's stages equal those of the epochs from its first one on."""
    held = epochs(spark, d)
    timed = held.join(rates(spark, d), "rec_id").select("rec_id", "epoch_no", ((F.col("epoch_no") + 1) * F.col("epoch_sec")).alias("at"))
    first = I.join_points(_segment_times(spark, d), timed, ["rec_id"], "at", "t0", "t1", cell=600.0).groupBy(*SEG).agg(F.min("epoch_no").alias("e0"))
    own = load(spark, d, "segment").select(*SEG, F.posexplode("sleep_stages").alias("k", "x")).where(F.col("x").isNotNull() & ~F.isnan("x")).select(*SEG, "k", F.round("x").alias("own")).distinct()
    both = own.join(first, SEG).withColumn("epoch_no", F.col("e0") + F.col("k")).join(held, ["rec_id", "epoch_no"])
    return both.groupBy(*SEG).agg(F.count("*").alias("n"), F.count_if(F.col("own") == F.col("stage")).alias("n_equal"))


@query(f"""WITH {MERGED_SQL}, u AS (SELECT *, unnest(range(s // 1800000, e // 1800000 + 1)) AS section FROM merged WHERE s < e),
x AS (SELECT rec_id, section, least(e, (section + 1) * 1800000) - greatest(s, section * 1800000) AS ms FROM u WHERE section * 1800000 < e)
SELECT rec_id, section, sum(ms)::BIGINT AS excluded_ms, (1800000 - sum(ms))::BIGINT AS good_ms, round(100 * (1800000 - sum(ms)) / 1800000, 6) AS percent_good FROM x GROUP BY ALL""")
def section_quality(spark: SparkSession, d: str) -> DataFrame:
    """Excluded and good time of every half hour that has a marking."""
    cut = I.split_at_bins(merge_overlaps(spark, d), "s", "e", 1_800_000)
    by = cut.groupBy("rec_id", F.col("bin_no").alias("section")).agg(F.sum(F.col("e") - F.col("s")).alias("excluded_ms"))
    return by.withColumn("good_ms", 1_800_000 - F.col("excluded_ms")).withColumn("percent_good", rounded(F.col("good_ms") * 100 / 1_800_000))




def _segment_times(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "segment").select(*SEG, (F.col("ecg_begin") / F.col("ecg_rate")).alias("t0"), (F.col("ecg_end") / F.col("ecg_rate")).alias("t1")).distinct()


@query(f"""WITH {EPOCHS_SQL}, {SEG_TIMES_SQL} SELECT st.rec_id, seg_id, epoch_no, stage FROM st JOIN ep ON st.rec_id = ep.rec_id
JOIN recording r ON r.rec_id = ep.rec_id WHERE (epoch_no + 1) * epoch_sec BETWEEN t0 AND t1""")
def epochs_in_segments(spark: SparkSession, d: str) -> DataFrame:
    """Sleep epochs that end inside a segment."""
    own = epochs(spark, d).join(rates(spark, d), "rec_id").select("rec_id", "epoch_no", "stage", ((F.col("epoch_no") + 1) * F.col("epoch_sec")).alias("at"))
    return I.join_points(_segment_times(spark, d), own, ["rec_id"], "at", "t0", "t1", cell=600.0).select(*SEG, "epoch_no", "stage")


@query("""WITH x AS (SELECT DISTINCT rec_id, seg_id, ppg_begin, ppg_end FROM segment), b AS (SELECT DISTINCT rec_id, idx_begin FROM beat_feature WHERE idx_begin IS NOT NULL)
SELECT x.rec_id, seg_id, idx_begin - ppg_begin AS idx FROM x JOIN b ON x.rec_id = b.rec_id AND idx_begin BETWEEN ppg_begin AND ppg_end""")
def beats_in_segments(spark: SparkSession, d: str) -> DataFrame:
    """Beats inside a segment, counted from its begin."""
    pieces = load(spark, d, "segment").select(*SEG, "ppg_begin", "ppg_end").distinct()
    own = load(spark, d, "beat_feature").select("rec_id", "idx_begin").distinct()
    found = I.join_points(pieces, own.where("idx_begin is not null"), ["rec_id"], "idx_begin", "ppg_begin", "ppg_end", cell=65536)
    return found.select(*SEG, (F.col("idx_begin") - F.col("ppg_begin")).alias("idx"))


@query(f"""WITH {events_sql('r_peak', 'p')}, {events_sql('ppg_valley', 'v')}, a AS (SELECT rec_id, seg_id, count(*) AS n_r FROM p GROUP BY ALL), b AS (SELECT rec_id, seg_id, count(*) AS n_ppg FROM v GROUP BY ALL)
SELECT rec_id, seg_id, n_r, coalesce(n_ppg, 0) AS n_ppg, n_r < coalesce(n_ppg, 0) / 2 OR n_r > 1.5 * coalesce(n_ppg, 0) AS noisy FROM a LEFT JOIN b USING (rec_id, seg_id)""")
def plausibility_gate(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose R peaks are fewer than half or more than one and a half times their valleys."""
    count = lambda table, name: events_of(spark, d, table).groupBy(*SEG).agg(F.count("*").alias(name))
    both = count("r_peak", "n_r").join(count("ppg_valley", "n_ppg"), SEG, "left").fillna(0, ["n_ppg"])
    return both.withColumn("noisy", (F.col("n_r") < F.col("n_ppg") / 2) | (F.col("n_r") > F.col("n_ppg") * 1.5))


@query("""WITH x AS (SELECT DISTINCT rec_id, seg_id, ecg_begin, ecg_rate FROM segment), y AS (SELECT rec_id, coalesce(ppg_rate, ecg_rate) AS r FROM recording)
SELECT rec_id, seg_id, round(ecg_begin / ecg_rate * r)::BIGINT AS ppg_index FROM x JOIN y USING (rec_id)""")
def nearest_grid_index(spark: SparkSession, d: str) -> DataFrame:
    """PPG sample nearest to each segment's first ECG sample."""
    own = load(spark, d, "segment").select(*SEG, "ecg_begin", F.col("ecg_rate").alias("er")).distinct().join(rates(spark, d).select("rec_id", "ppg_rate"), "rec_id")
    return own.select(*SEG, M.nearest_grid_index(F.col("ecg_begin") / F.col("er"), F.col("ppg_rate")).alias("ppg_index"))


@query(f"""WITH {events_sql('r_peak', 'p')}, {events_sql('ppg_valley', 'v')}, pd AS (SELECT DISTINCT rec_id, seg_id, sec FROM p), b AS (SELECT pd.*, v.sec AS lo FROM pd ASOF LEFT JOIN v ON pd.rec_id = v.rec_id AND pd.seg_id = v.seg_id AND pd.sec >= v.sec),
a AS (SELECT b.*, v.sec AS hi FROM b ASOF LEFT JOIN v ON b.rec_id = v.rec_id AND b.seg_id = v.seg_id AND b.sec <= v.sec)
SELECT rec_id, seg_id, round(sec, 6) AS r_sec, round(CASE WHEN lo IS NULL OR hi - sec < sec - lo THEN hi ELSE lo END, 6) AS ppg_sec FROM a""")
def nearest_in_series(spark: SparkSession, d: str) -> DataFrame:
    """The pulse valley nearest to each R peak, however far."""
    peaks = events_of(spark, d, "r_peak").select(*SEG, F.col("sec").alias("r_sec"))
    rows = M.nearest_in_series(peaks, events_of(spark, d, "ppg_valley").select(*SEG, F.col("sec").alias("ppg_sec")), SEG, "r_sec", "ppg_sec", cell=600)
    return rows.select(*SEG, rounded("r_sec").alias("r_sec"), rounded("ppg_sec").alias("ppg_sec"))


PAIR_SQL = f"""WITH {events_sql('r_peak', 'p')}, {events_sql('ppg_valley', 'v')},
q AS (SELECT *, coalesce(lag(sec) OVER w, 0) AS lo, coalesce(lead(sec) OVER w, sec + 4) AS hi FROM p WINDOW w AS (PARTITION BY rec_id, seg_id ORDER BY sec)),
k AS (SELECT q.rec_id, q.seg_id, q.sec AS r_sec, v.sec AS ppg_sec, row_number() OVER (PARTITION BY q.rec_id, q.seg_id, q.sec ORDER BY abs(v.sec - q.sec), v.sec) AS place
  FROM q JOIN v ON q.rec_id = v.rec_id AND q.seg_id = v.seg_id AND v.sec BETWEEN q.lo AND q.hi),
pairs AS (SELECT p.rec_id, p.seg_id, p.sec AS r_sec, k.ppg_sec FROM p LEFT JOIN k ON k.place = 1 AND p.rec_id = k.rec_id AND p.seg_id = k.seg_id AND p.sec = k.r_sec)
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    peaks = events_of(spark, d, "r_peak").select(*SEG, F.col("sec").alias("r_sec"))
    return M.match_between_neighbours(peaks, _valley_times(spark, d), SEG, "r_sec", "ppg_sec")


def _valley_times(spark: SparkSession, d: str) -> DataFrame:
    return events_of(spark, d, "ppg_valley").select(*SEG, F.col("sec").alias("ppg_sec"))


@query(PAIR_SQL + "SELECT rec_id, seg_id, round(r_sec, 6) AS r_sec, round(ppg_sec, 6) AS ppg_sec FROM pairs")
def interval_argmin_match(spark: SparkSession, d: str) -> DataFrame:
    """Each R peak's nearest valley between its neighbouring R peaks."""
    return _pairs(spark, d).select(*SEG, rounded("r_sec").alias("r_sec"), rounded("ppg_sec").alias("ppg_sec"))


@query(PAIR_SQL + """SELECT v.rec_id, v.seg_id, round(v.sec, 6) AS ppg_sec FROM v WHERE NOT EXISTS
(SELECT 1 FROM pairs WHERE pairs.rec_id = v.rec_id AND pairs.seg_id = v.seg_id AND pairs.ppg_sec = v.sec)""")
def unmatched_valleys(spark: SparkSession, d: str) -> DataFrame:
    """Valleys that no R peak was paired with."""
    both = M.add_unmatched(_pairs(spark, d), _valley_times(spark, d), SEG, "r_sec", "ppg_sec")
    return both.where("r_sec is null").select(*SEG, rounded("ppg_sec").alias("ppg_sec"))


@query()
def settled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in which no valley serves two R peaks and every R peak has a time, with where that comes from."""
    both = M.add_unmatched(_pairs(spark, d), _valley_times(spark, d), SEG, "r_sec", "ppg_sec")
    samples = signal(spark, d).select(*SEG, (F.col("idx") / F.col("fs")).alias("sec"), "value")
    return M.settle_all(both, samples, SEG, "r_sec", "ppg_sec", "sec", "value").select(*SEG, rounded("r_sec").alias("r_sec"), rounded("ppg_sec").alias("ppg_sec"), "how")


TRANSIT_SQL = f"""WITH {events_sql('r_peak', 'p')}, {events_sql('ppg_valley', 'v')},
q AS (SELECT *, lead(sec) OVER (PARTITION BY rec_id, seg_id ORDER BY sec) AS nx FROM p),
f AS (SELECT q.rec_id, q.seg_id, q.sec AS r_sec, min(v.sec) AS ppg_sec FROM q LEFT JOIN v ON q.rec_id = v.rec_id AND q.seg_id = v.seg_id AND v.sec > q.sec AND v.sec <= q.sec + 2
  AND (q.nx IS NULL OR v.sec < q.nx) GROUP BY ALL)
"""


def _transit(spark: SparkSession, d: str) -> DataFrame:
    peaks = events_of(spark, d, "r_peak").select(*SEG, F.col("sec").alias("r_sec"))
    return M.next_within(peaks, _valley_times(spark, d), SEG, "r_sec", "ppg_sec", reach=2.0)


@query(TRANSIT_SQL + "SELECT rec_id, seg_id, round(r_sec, 6) AS r_sec, round(ppg_sec, 6) AS ppg_sec, round(ppg_sec - r_sec, 6) AS delay FROM f")
def next_after_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Pulse transit: the first valley after each R peak and before the next one."""
    return _transit(spark, d).select(*SEG, *(rounded(c).alias(c) for c in ("r_sec", "ppg_sec", "delay")))


@query(TRANSIT_SQL + "SELECT rec_id, seg_id, round(ppg_sec, 6) AS ppg_sec, round(max(r_sec), 6) AS r_sec FROM f WHERE ppg_sec IS NOT NULL GROUP BY rec_id, seg_id, ppg_sec")
def mutual_matches(spark: SparkSession, d: str) -> DataFrame:
    """R peaks and valleys that follow each other in turn."""
    found = M.mutual_matches(_transit(spark, d), SEG, "r_sec", "ppg_sec")
    return found.select(*SEG, rounded("ppg_sec").alias("ppg_sec"), rounded("r_sec").alias("r_sec"))


@query("SELECT DISTINCT rec_id, seg_id FROM segment INTERSECT SELECT DISTINCT rec_id, seg_id FROM r_peak INTERSECT SELECT DISTINCT rec_id, seg_id FROM beat_pair")
def id_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Segments with detected and with paired beats."""
    ids = [load(spark, d, t).select(*SEG).distinct() for t in ("segment", "r_peak", "beat_pair")]
    return ids[0].join(ids[1], SEG, "left_semi").join(ids[2], SEG, "left_semi")


@query(f"""WITH {MARKINGS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY s, e, label NULLS FIRST) AS place FROM nz)
SELECT r.rec_id, dataset, s, e, label FROM recording r LEFT JOIN f ON r.rec_id = f.rec_id AND place = 1""")
def left_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Each recording with its first marking, if any."""
    return M.first_match(load(spark, d, "recording").select("rec_id", "dataset"), markings(spark, d).select("rec_id", "s", "e", "label"), ["rec_id"], ["s", "e", "label"])


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def metadata_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the names of their customer and nation."""
    customer = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = broadcast_if_small(load(spark, d, "nation").select("n_nationkey", "n_name"))
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    joined = orders.join(broadcast_if_small(customer), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", "c_name", "n_name")


@query("SELECT rec_id, seg_id, (SELECT count(*) FROM beat_pair b WHERE b.rec_id = s.rec_id) AS n_members FROM (SELECT DISTINCT rec_id, seg_id FROM segment) s")
def count_members(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs there are of each segment's recording."""
    return M.count_members(load(spark, d, "segment").select(*SEG).distinct(), load(spark, d, "beat_pair").select("rec_id"), "rec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
