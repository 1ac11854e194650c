"""Content timelines: intervals of several kinds per user, fused, merged and summarised.

Users play the role of runs of 720 hours. Every event kind becomes one interval family.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import epoch, r
from tidemark.operators import intervals as I
from tidemark.operators.ranks import exact_quantiles, top_k
from tidemark.operators.sequence import chunk_width, neighbours
from tidemark.operators.timejoin import bucket_width, overlap_join, stab_join
from tidemark.plans.registry import query
from tidemark.session import durable
from tidemark.sources.tables import table

ORIGIN, DURATION = 1704067200.0, 720.0

CV = """cv AS (SELECT user_id AS run_id, event_id AS idx, event_type AS kind, value, (epoch_us(ts) / 1e6 - 1704067200) / 3600 AS t FROM events),
 du AS (SELECT DISTINCT run_id, 720.0::DOUBLE AS duration FROM cv)"""
SH = """sh AS (SELECT run_id, idx, t AS start_t, least(coalesce(lead(t) OVER (PARTITION BY run_id ORDER BY t), 720), 720) AS end_t, value FROM cv WHERE kind = 'view')"""
IV = """iv AS (SELECT run_id, 'shot' AS kind, idx, start_t, end_t, 'shot' AS label FROM sh
 UNION ALL SELECT run_id, 'speech', idx, t, t + value / 20, 'speech' FROM cv WHERE kind = 'click'
 UNION ALL SELECT run_id, 'overlay', idx, t, t + value / 40, 'overlay' FROM cv WHERE kind = 'signup'
 UNION ALL SELECT run_id, 'cta', idx, t, t + value / 100, 'cta' FROM cv WHERE kind = 'purchase'
 UNION ALL SELECT run_id, 'audio', idx, t, t + value / 10, CASE WHEN value < 20 THEN 'silence' WHEN value < 60 THEN 'music' ELSE 'other' END FROM cv WHERE kind = 'error')"""
BO = """bo AS (SELECT DISTINCT run_id, round(least(greatest(t, 0), duration), 6) AS t FROM
 (SELECT run_id, unnest([start_t, end_t]) AS t FROM iv UNION ALL SELECT run_id, unnest([0, duration]) FROM du) JOIN du USING (run_id)
 WHERE t >= -1e-6 AND t <= duration + 1e-6)"""
SN = """sn AS (SELECT * FROM (SELECT run_id, t AS span_start, lead(t) OVER (PARTITION BY run_id ORDER BY t) AS span_end FROM bo) WHERE span_end IS NOT NULL)"""
OV = """ov AS (SELECT sn.run_id, span_start, span_end, kind, idx, start_t, end_t, label FROM sn JOIN iv ON sn.run_id = iv.run_id
 AND start_t < span_end - 1e-6 AND end_t > span_start + 1e-6)"""
SG = """sg AS (SELECT sn.run_id, span_start, span_end, avg(value) AS signal_mean, count(value) AS signal_samples
 FROM sn JOIN cv ON sn.run_id = cv.run_id AND t >= span_start AND t < span_end GROUP BY ALL)"""
FU = """fu AS (SELECT sn.run_id, span_start, span_end,
 CASE WHEN bool_or(kind = 'cta') THEN 'cta' WHEN bool_or(kind = 'speech') THEN 'speech_segment' WHEN bool_or(kind = 'overlay') THEN 'text_overlay'
  WHEN arg_max(label, struct_pack(a := least(span_end, end_t) - greatest(span_start, start_t), b := -start_t)) FILTER (kind = 'audio') = 'silence' THEN 'silence'
  WHEN arg_max(label, struct_pack(a := least(span_end, end_t) - greatest(span_start, start_t), b := -start_t)) FILTER (kind = 'audio') = 'music' THEN 'music_segment'
  ELSE 'fused_interval' END AS event_type,
 arg_max(label, struct_pack(a := least(span_end, end_t) - greatest(span_start, start_t), b := -start_t)) FILTER (kind = 'audio') AS audio_label,
 concat_ws(',', CASE WHEN bool_or(kind = 'shot') THEN 'visual' END, CASE WHEN bool_or(kind = 'audio') THEN 'audio' END,
  CASE WHEN bool_or(kind = 'speech') THEN 'speech' END, CASE WHEN bool_or(kind = 'overlay') THEN 'on_screen_text' END) AS modalities,
 min(idx) FILTER (kind = 'shot') AS first_shot,
 coalesce(string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY start_t, idx) FILTER (kind = 'speech'), '') AS speech_text
 FROM sn LEFT JOIN ov USING (run_id, span_start, span_end) GROUP BY ALL)"""
BASE = f"WITH {CV}, {SH}, {IV}, {BO}, {SN}"


def _events(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("kind"),
        "value", ((epoch("ts") - ORIGIN) / 3600).alias("t"),
    )


def _durations(ev):
    return ev.select("run_id").distinct().withColumn("duration", F.lit(DURATION))


MEASURED = "measured"  # let the events decide whether runs are cut in chunks


def _shots(ev, width=MEASURED):
    width = chunk_width(ev, ["run_id"], "t") if width == MEASURED else width
    return I.spans_to(ev.where("kind = 'view'").select("run_id", "t", "idx", "value"), _durations(ev), width)


def _intervals(ev, width=MEASURED):
    """All intervals; callers that keep no shots pass no width, as theirs are pruned."""
    shots = _shots(ev, width).select("run_id", F.lit("shot").alias("kind"), "idx", "start_t", "end_t", F.lit("shot").alias("label"))
    v = F.col("value")
    kinds = F.create_map(*[F.lit(x) for x in ("click", "speech", "signup", "overlay", "purchase", "cta", "error", "audio")])
    length = F.when(F.col("kind") == "click", v / 20).when(F.col("kind") == "signup", v / 40).when(F.col("kind") == "purchase", v / 100).otherwise(v / 10)
    audio = F.when(v < 20, "silence").when(v < 60, "music").otherwise("other")
    rest = ev.where("kind <> 'view'").select(
        "run_id", F.element_at(kinds, F.col("kind")).alias("k"), "idx", F.col("t").alias("start_t"),
        (F.col("t") + length).alias("end_t"), F.when(F.col("kind") == "error", audio).alias("label"),
    )
    rest = rest.select("run_id", F.col("k").alias("kind"), "idx", "start_t", "end_t", F.coalesce("label", "k").alias("label"))
    return shots.unionByName(rest).withColumn("text", F.col("idx").cast("string"))


def _timeline(spark, d):
    ev = _events(spark, d)
    width = chunk_width(ev, ["run_id"], "t")
    iv = durable(_intervals(ev, width))  # both are read by several joins
    return ev, iv, durable(I.spans_between(I.boundaries(iv, _durations(ev)), width)), width


def _fused(spark, d):
    ev, iv, spans, width = _timeline(spark, d)
    bucket = bucket_width(iv, "start_t", "end_t")
    return ev, iv, I.fuse(spans, iv, ev, bucket), bucket, width


@query("u01_boundaries", f"{BASE} SELECT * FROM bo")
def u01(spark, d):
    ev = _events(spark, d)
    return I.boundaries(_intervals(ev, chunk_width(ev, ["run_id"], "t")), _durations(ev))


@query("w11_boundary_spans", f"WITH {CV}, {SH} SELECT run_id, idx, round(start_t, 6) AS start_t, round(end_t, 6) AS end_t FROM sh")
def w11(spark, d):
    ev = _events(spark, d)
    return _shots(ev, chunk_width(ev, ["run_id"], "t")).select("run_id", "idx", r("start_t").alias("start_t"), r("end_t").alias("end_t"))


@query("j06_interval_overlap", f"WITH {CV}, {SH}, {IV} SELECT a.run_id, a.idx AS speech_idx, b.idx AS audio_idx FROM iv a JOIN iv b ON a.run_id = b.run_id AND a.kind = 'speech' AND b.kind = 'audio' AND a.start_t < b.end_t - 1e-6 AND a.end_t > b.start_t + 1e-6")
def j06(spark, d):
    iv = _intervals(_events(spark, d))
    a = iv.where("kind = 'speech'").select("run_id", F.col("idx").alias("speech_idx"), F.col("start_t").alias("s1"), F.col("end_t").alias("e1"))
    b = iv.where("kind = 'audio'").select("run_id", F.col("idx").alias("audio_idx"), F.col("start_t").alias("s2"), F.col("end_t").alias("e2"))
    return overlap_join(a, b, ["run_id"], ("s1", "e1"), ("s2", "e2"), bucket_width(b, "s2", "e2"), 1e-6).select("run_id", "speech_idx", "audio_idx")


@query("j07_point_in_interval", f"{BASE}, pts AS (SELECT run_id, idx, t FROM cv UNION ALL SELECT run_id, -1, duration FROM du) SELECT pts.run_id, idx, span_start, span_end FROM pts JOIN sn ON pts.run_id = sn.run_id AND t >= span_start AND (t < span_end OR (t = 720 AND span_end = 720))")
def j07(spark, d):
    ev, iv, spans, _ = _timeline(spark, d)
    points = ev.select("run_id", "idx", "t").unionByName(_durations(ev).select("run_id", F.lit(-1).cast("long").alias("idx"), F.col("duration").alias("t")))
    return I.event_at(points, spans, "t", bucket_width(iv, "start_t", "end_t")).select("run_id", "idx", "span_start", "span_end")


@query("j08_rows_over_interval", f"WITH {CV}, {SH}, {IV} SELECT iv.run_id, iv.idx, min(cv.idx) AS first_row, max(cv.idx) AS last_row FROM iv JOIN cv ON iv.run_id = cv.run_id AND iv.kind = 'audio' AND cv.t < iv.end_t AND cv.t + 2 > iv.start_t GROUP BY ALL")
def j08(spark, d):
    ev = _events(spark, d)
    spans = _intervals(ev, None).where("kind = 'audio'").select("run_id", "idx", "start_t", "end_t")
    rows = ev.select("run_id", F.col("idx").alias("row_idx"), F.col("t").alias("row_start"), (F.col("t") + 2).alias("row_end"))
    hits = overlap_join(spans, rows, ["run_id"], ("start_t", "end_t"), ("row_start", "row_end"), bucket_width(spans, "start_t", "end_t"))
    return hits.groupBy("run_id", "idx").agg(F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))


ASSOC = """pe AS (SELECT run_id, idx AS event_idx, value AS score, greatest(0, t - 2) AS a, t + 2 AS b FROM cv WHERE kind = 'purchase'),
 nx AS (SELECT pe.run_id, event_idx, score, event_type, min(span_start) AS f, count(*) AS c FROM pe JOIN fu ON pe.run_id = fu.run_id AND span_start < b - 1e-9 AND span_end > a + 1e-9 GROUP BY ALL),
 asx AS (SELECT run_id, event_idx, score, CAST(sum(c) AS BIGINT) AS nearby, string_agg(event_type, '>' ORDER BY f) AS contexts FROM nx GROUP BY ALL)"""


def _associations(spark, d):
    ev, iv, fused, bucket, _ = _fused(spark, d)
    points = ev.where("kind = 'purchase'").select("run_id", F.col("idx").alias("event_idx"), F.col("value").alias("score"),
                                                   F.greatest(F.lit(0.0), F.col("t") - 2).alias("a"), (F.col("t") + 2).alias("b"))
    near = overlap_join(points, fused, ["run_id"], ("a", "b"), ("span_start", "span_end"), bucket, 1e-9)
    ordered = F.array_sort(F.collect_list(F.struct("span_start", "event_type")))
    return near.groupBy("run_id", "event_idx", "score").agg(
        F.count(F.lit(1)).alias("nearby"),
        F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["event_type"])), ">").alias("contexts"),
    )


@query("j09_context_join", f"{BASE}, {OV}, {FU}, {ASSOC} SELECT * FROM asx")
def j09(spark, d):
    return _associations(spark, d)


@query("k04_strongest_associations", f"{BASE}, {OV}, {FU}, {ASSOC}, k AS (SELECT run_id, event_idx, score, contexts, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, event_idx) AS rank FROM asx) SELECT * FROM k WHERE rank <= 5")
def k04(spark, d):
    out = top_k(_associations(spark, d), ["run_id"], [F.col("score").desc(), F.col("event_idx")], 5)
    return out.select("run_id", "event_idx", "score", "contexts", "rank")


@query("j16_straddled_boundary", f"WITH {CV}, {SH}, {IV} SELECT run_id, idx, round(start_t, 6) AS boundary FROM sh WHERE EXISTS (SELECT 1 FROM iv WHERE iv.run_id = sh.run_id AND iv.kind = 'speech' AND iv.start_t < sh.start_t AND sh.start_t < iv.end_t)")
def j16(spark, d):
    ev = _events(spark, d)
    shots = _shots(ev).select("run_id", "idx", "start_t")
    speech = _intervals(ev, None).where("kind = 'speech'").select("run_id", F.col("start_t").alias("s"), F.col("end_t").alias("e"))
    hit = stab_join(shots, speech, ["run_id"], "start_t", ("s", "e"), bucket_width(speech, "s", "e")).where("s < start_t")
    return hit.select("run_id", "idx", r("start_t").alias("boundary")).distinct()


@query("j22_attributes_to_shots", f"WITH {CV}, {SH} SELECT sh.run_id, sh.idx, count(cv.idx) AS attributes, round(avg(cv.value), 6) AS mean_value FROM sh LEFT JOIN cv ON cv.run_id = sh.run_id AND cv.kind = 'error' AND cv.t >= start_t AND cv.t < end_t GROUP BY ALL")
def j22(spark, d):
    ev = _events(spark, d)
    shots = _shots(ev).select("run_id", "idx", "start_t", "end_t")
    means = I.interval_means(ev.where("kind = 'error'"), shots, ("start_t", "end_t"), bucket_width(shots, "start_t", "end_t"))
    return shots.join(means, ["run_id", "start_t", "end_t"], "left").select(
        "run_id", "idx", F.coalesce("signal_samples", F.lit(0)).alias("attributes"), r("signal_mean").alias("mean_value"))


@query("j24_events_near_instant", f"{BASE} SELECT du.run_id, span_start, span_end FROM du JOIN sn ON du.run_id = sn.run_id AND span_start < 360 + 12 AND span_end > 360 - 12")
def j24(spark, d):
    ev, iv, spans, _ = _timeline(spark, d)
    return spans.where((F.col("span_start") < 372.0) & (F.col("span_end") > 348.0))


@query("s18_context_at_time", f"{BASE}, {OV}, {FU} SELECT run_id, span_start, event_type, modalities FROM fu WHERE span_start < 101 AND span_end > 99")
def s18(spark, d):
    _, _, fused, _, _ = _fused(spark, d)
    at = fused.where((F.col("span_start") < 101.0) & (F.col("span_end") > 99.0))
    return at.select("run_id", "span_start", "event_type", F.array_join("modalities", ",").alias("modalities"))


@query("a17_interval_mean", f"{BASE}, {SG} SELECT run_id, span_start, span_end, round(signal_mean, 6) AS signal_mean, signal_samples FROM sg")
def a17(spark, d):
    ev, iv, spans, _ = _timeline(spark, d)
    return I.interval_means(ev, spans, ("span_start", "span_end"), bucket_width(iv, "start_t", "end_t")).withColumn("signal_mean", r("signal_mean"))


COVER = """cl AS (SELECT run_id, kind, greatest(0, start_t) AS s, least(720, end_t) AS e FROM iv WHERE end_t > start_t),
 cr AS (SELECT *, max(e) OVER (PARTITION BY run_id, kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cl),
 ci AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, kind ORDER BY s, e) AS g FROM cr),
 co AS (SELECT run_id, kind, sum(l) AS covered FROM (SELECT run_id, kind, g, max(e) - min(s) AS l FROM ci GROUP BY ALL) GROUP BY ALL)"""


@query("a18_covered_length", f"WITH {CV}, {SH}, {IV}, {COVER} SELECT run_id, round(covered, 6) AS covered FROM co WHERE kind = 'audio'")
def a18(spark, d):
    ev = _events(spark, d)
    audio = _intervals(ev, None).where("kind = 'audio'")
    return I.covered_length(audio, _durations(ev), chunk_width(ev, ["run_id"], "t")).withColumn("covered", r("covered"))


SCENES = """b AS (SELECT DISTINCT sh.run_id, sh.idx FROM sh JOIN iv ON iv.run_id = sh.run_id AND iv.kind = 'speech' AND iv.start_t < sh.start_t AND sh.start_t < iv.end_t),
 o AS (SELECT sh.*, row_number() OVER w AS k, 1 - abs(value - lag(value) OVER w) / 503 AS sim, b.idx IS NOT NULL AS br FROM sh LEFT JOIN b USING (run_id, idx) WINDOW w AS (PARTITION BY sh.run_id ORDER BY start_t)),
 f AS (SELECT run_id, k, start_t AS head FROM o WHERE k = 1 UNION ALL SELECT o.run_id, o.k, CASE WHEN o.end_t - f.head > 150 THEN o.start_t WHEN o.sim >= 0.9 OR o.br THEN f.head ELSE o.start_t END FROM f JOIN o ON o.run_id = f.run_id AND o.k = f.k + 1)"""


def _scenes(ev, width):
    shots = _shots(ev, width)
    speech = _intervals(ev, width).where("kind = 'speech'").select("run_id", F.col("start_t").alias("s"), F.col("end_t").alias("e"))
    bridged = stab_join(shots.select("run_id", "idx", "start_t"), speech, ["run_id"], "start_t", ("s", "e"), bucket_width(speech, "s", "e")).where("s < start_t").select("run_id", "idx").distinct().withColumn("_b", F.lit(True))
    near = neighbours(shots, ["run_id"], ["start_t"], ["value"], width)
    ready = near.join(bridged, ["run_id", "idx"], "left").select("run_id", "start_t", "end_t", (1 - F.abs(F.col("value") - F.col("prev.value")) / 503).alias("similar"), F.coalesce("_b", F.lit(False)).alias("bridged"))
    return I.group_scenes(ready, 0.9, 150.0, width)


# An utterance has one to five words by its number.
@query("a19_content_summary", f"""WITH RECURSIVE {CV}, {SH}, {IV}, {SCENES}, ivf AS (SELECT run_id, CASE WHEN kind = 'audio' AND part = 2 THEN label ELSE kind END AS kind, start_t, end_t FROM iv, (VALUES (1), (2)) p(part) WHERE part = 1 OR kind = 'audio'),
 {COVER.replace("FROM iv WHERE", "FROM ivf WHERE")},
 s AS (SELECT run_id, count(*) AS shot_count, avg(end_t - start_t) FILTER (end_t > start_t) AS mean_shot, quantile_cont(end_t - start_t, 0.5) FILTER (end_t > start_t) AS median_shot FROM sh GROUP BY 1),
 c AS (SELECT run_id, count(*) FILTER (kind = 'speech') AS utterances, coalesce(sum(idx % 5 + 1) FILTER (kind = 'speech'), 0)::BIGINT AS word_count, count(*) FILTER (kind = 'overlay') AS overlay_count, count(*) FILTER (kind = 'cta') AS cta_count, min(start_t) FILTER (kind = 'cta') AS first_cta FROM iv GROUP BY 1),
 sc AS (SELECT run_id, count(DISTINCT head) AS scene_count FROM f GROUP BY 1),
 cf AS (SELECT run_id, sum(covered) FILTER (kind = 'speech') AS sp, sum(covered) FILTER (kind = 'audio') AS au, sum(covered) FILTER (kind = 'silence') AS si, sum(covered) FILTER (kind = 'music') AS mu FROM co GROUP BY 1),
 m AS (SELECT run_id, avg(value) AS mean_signal FROM cv GROUP BY 1)
 SELECT du.run_id, coalesce(shot_count, 0) AS shot_count, coalesce(scene_count, 0) AS scene_count, round(mean_shot, 6) AS mean_shot, round(median_shot, 6) AS median_shot, round((shot_count - 1) / 43200.0::DOUBLE, 8) AS cuts_per_minute,
 coalesce(utterances, 0) AS utterances, coalesce(word_count, 0) AS word_count, round(CASE WHEN word_count > 0 THEN word_count / 43200.0::DOUBLE END, 8) AS words_per_minute, coalesce(overlay_count, 0) AS overlay_count, coalesce(cta_count, 0) AS cta_count,
 round(first_cta, 6) AS first_cta, round(coalesce(sp, 0) / 720, 6) AS speech_fraction, round(coalesce(au, 0) / 720, 6) AS audio_fraction, round(coalesce(si, 0) / 720, 6) AS silence_fraction, round(coalesce(mu, 0) / 720, 6) AS music_fraction, round(mean_signal, 6) AS mean_signal
 FROM du LEFT JOIN c USING (run_id) LEFT JOIN s USING (run_id) LEFT JOIN sc USING (run_id) LEFT JOIN cf USING (run_id) LEFT JOIN m USING (run_id)""")
def a19(spark, d):
    ev = _events(spark, d)
    width = chunk_width(ev, ["run_id"], "t")
    spoken = F.when(F.col("kind") == "speech", F.expr("array_join(sequence(1, idx % 5 + 1), ' ')"))
    out = I.content_summary(_durations(ev), _intervals(ev, width).withColumn("text", spoken), _scenes(ev, width), ev, width, minutes_per_unit=60)
    per_minute = ("cuts_per_minute", "words_per_minute")
    rounded = {c: r(c, 8) for c in per_minute} | {c: r(c) for c in out.columns if c not in per_minute and out.schema[c].dataType.typeName() == "double"}
    return out.withColumns(rounded)


@query("a22_label_appearances", f"WITH {CV} SELECT run_id, kind AS label, round(min(t), 6) AS first_seen, round(max(t), 6) AS last_seen, least(720, count(DISTINCT t) * 0.5::DOUBLE) AS screen_seconds, count(*) AS detections, round(avg(value / 503), 8) AS mean_confidence FROM cv GROUP BY ALL HAVING count(DISTINCT t) >= 2")
def a22(spark, d):
    ev = _events(spark, d)
    out = I.label_appearances(ev.select("run_id", "t", F.col("kind").alias("label"), (F.col("value") / 503).alias("confidence")), _durations(ev), 0.5)
    return out.select("run_id", "label", r("first_seen").alias("first_seen"), r("last_seen").alias("last_seen"), "screen_seconds", "detections", r("mean_confidence", 8).alias("mean_confidence"))


@query("p14_persistence_filter", f"WITH {CV} SELECT kind AS label, count(*) AS runs FROM (SELECT run_id, kind FROM cv GROUP BY ALL HAVING count(DISTINCT t) >= 12) GROUP BY 1")
def p14(spark, d):
    seen = _events(spark, d).groupBy("run_id", F.col("kind").alias("label")).agg(F.countDistinct("t").alias("n")).where("n >= 12")
    return seen.groupBy("label").agg(F.count(F.lit(1)).alias("runs"))


@query("a23_labels_in_interval", f"WITH {CV}, {SH}, m AS (SELECT sh.run_id, sh.idx, cv.kind, max(cv.value) AS c FROM sh JOIN cv ON cv.run_id = sh.run_id AND cv.t >= start_t AND cv.t < end_t GROUP BY ALL) SELECT run_id, idx, string_agg(kind, ',' ORDER BY c DESC, kind) AS labels FROM m GROUP BY ALL")
def a23(spark, d):
    ev = _events(spark, d)
    shots = _shots(ev).select("run_id", F.col("idx").alias("shot"), "start_t", "end_t")
    best = stab_join(ev.select("run_id", "t", "kind", "value"), shots, ["run_id"], "t", ("start_t", "end_t"), bucket_width(shots, "start_t", "end_t")).groupBy("run_id", "shot", "kind").agg(F.max("value").alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("n"), "kind")))
    return best.groupBy("run_id", F.col("shot").alias("idx")).agg(F.array_join(F.transform(ordered, lambda x: x["kind"]), ",").alias("labels"))


@query("a39_histogram_entropy", f"WITH {CV}, b AS (SELECT run_id, least(floor(value / 503 * 64), 63) AS b, count(*) AS c FROM cv WHERE value / 503 BETWEEN 0 AND 1 GROUP BY ALL), n AS (SELECT *, sum(c) OVER (PARTITION BY run_id) AS n FROM b) SELECT run_id, round(-sum(c / n * log2(c / n)), 6) + 0.0 AS entropy FROM n GROUP BY run_id")
def a39(spark, d):
    ev = _events(spark, d).withColumn("level", F.col("value") / 503)
    return I.entropy_bits(ev, ["run_id"], "level").withColumn("entropy", r("entropy"))


@query("a42_shot_label_vectors", f"WITH {CV}, {SH}, a AS (SELECT sh.run_id, sh.idx, cv.t, cv.kind AS label, cv.value AS score FROM sh JOIN cv ON cv.run_id = sh.run_id AND cv.t >= start_t AND cv.t < end_t), f AS (SELECT run_id, idx, count(DISTINCT t) AS n FROM a GROUP BY ALL) SELECT run_id, idx, label, round(sum(score) / any_value(n), 6) AS score FROM a JOIN f USING (run_id, idx) GROUP BY ALL")
def a42(spark, d):
    ev = _events(spark, d)
    shots = _shots(ev).select("run_id", "idx", "start_t", "end_t")
    attrs = ev.select("run_id", "t", F.col("kind").alias("label"), F.col("value").alias("score"))
    vec = I.mean_label_vectors(shots.select("run_id", "start_t", "end_t"), attrs, bucket_width(shots, "start_t", "end_t"))
    return vec.join(shots.select("run_id", "start_t", "idx"), ["run_id", "start_t"]).select("run_id", "idx", "label", r("score").alias("score"))


@query("e02_fused_timeline", f"{BASE}, {OV}, {FU}, {SG} SELECT fu.*, round(signal_mean, 5) AS signal_mean, coalesce(signal_samples, 0) AS signal_samples FROM fu LEFT JOIN sg USING (run_id, span_start, span_end)")
def e02(spark, d):
    _, _, fused, _, _ = _fused(spark, d)
    return fused.select("run_id", "span_start", "span_end", "event_type", "audio_label", F.array_join("modalities", ",").alias("modalities"),
                        "first_shot", "speech_text", r("signal_mean", 5).alias("signal_mean"), "signal_samples")


@query("p12_interval_labels", f"{BASE}, {OV}, {FU} SELECT event_type, count(*) AS spans, round(sum(span_end - span_start), 4) AS hours FROM fu GROUP BY 1")
def p12(spark, d):
    _, _, fused, _, _ = _fused(spark, d)
    return fused.groupBy("event_type").agg(F.count(F.lit(1)).alias("spans"), r(F.sum(F.col("span_end") - F.col("span_start")), 4).alias("hours"))


@query("p25_state_at_time", f"{BASE}, {OV}, {FU} SELECT run_id, event_type, audio_label, speech_text <> '' AS is_speaking, first_shot FROM fu WHERE span_start <= 200 AND span_end > 200")
def p25(spark, d):
    _, _, fused, _, _ = _fused(spark, d)
    now = fused.where((F.col("span_start") <= 200.0) & (F.col("span_end") > 200.0))
    return now.select("run_id", "event_type", "audio_label", (F.col("speech_text") != "").alias("is_speaking"), "first_shot")


@query("p26_speech_spans", f"WITH {CV}, {SH}, {IV} SELECT run_id, round(start_t, 6) AS start_t, round(end_t, 6) AS end_t FROM iv WHERE kind = 'speech'")
def p26(spark, d):
    return _intervals(_events(spark, d), None).where("kind = 'speech'").select("run_id", r("start_t").alias("start_t"), r("end_t").alias("end_t"))


@query("e03_structural_markers", f"""WITH {CV}, {SH}, h AS (SELECT run_id, 'hook' AS event_type, min(start_t) AS start_t, arg_min(end_t, start_t) AS end_t, NULL AS label FROM sh GROUP BY 1),
 a AS (SELECT run_id, CASE kind WHEN 'click' THEN 'a car' WHEN 'signup' THEN 'a book' ELSE kind END AS label, min(t) AS f, max(t) AS l FROM cv GROUP BY ALL HAVING count(DISTINCT t) >= 2),
 v AS (SELECT run_id, 'product_reveal' AS event_type, min(f) AS start_t, arg_min(l, struct_pack(x := f, y := label)) AS end_t, arg_min(label, struct_pack(x := f, y := label)) AS label FROM a WHERE label IN ('a car', 'a book') AND l - f >= 0.5 GROUP BY 1)
 SELECT run_id, event_type, round(start_t, 6) AS start_t, round(least(end_t, 720), 6) AS end_t, label FROM (SELECT * FROM h UNION ALL SELECT * FROM v)""")
def e03(spark, d):
    ev = _events(spark, d)
    du = _durations(ev)
    label = F.when(F.col("kind") == "click", "a car").when(F.col("kind") == "signup", "a book").otherwise(F.col("kind"))
    seen = I.label_appearances(ev.select("run_id", "t", label.alias("label"), F.col("value").alias("confidence")), du, 0.5)
    out = I.structural_markers(_shots(ev), seen, du)
    return out.select("run_id", "event_type", r("start_t").alias("start_t"), r("end_t").alias("end_t"), "label")


@query("e04_partition_check", f"WITH {CV}, {SH}, {IV}, c AS (SELECT run_id, start_t, start_t - lag(end_t) OVER (PARTITION BY run_id ORDER BY start_t) AS gap FROM iv WHERE kind = 'audio') SELECT run_id, round(start_t, 6) AS span_start, round(gap, 6) AS gap FROM c WHERE abs(gap) > 1e-6")
def e04(spark, d):
    ev = _events(spark, d)
    audio = _intervals(ev, None).where("kind = 'audio'").select("run_id", F.col("start_t").alias("span_start"), F.col("end_t").alias("span_end"))
    out = I.partition_violations(audio, chunk_width(ev, ["run_id"], "t"))
    return out.select("run_id", r("span_start").alias("span_start"), r("gap").alias("gap"))


GRID = "gr AS (SELECT run_id, i AS step, least((i + 0.5) / 0.25, 720)::DOUBLE AS t FROM du, range(180) AS g(i))"


@query("x23_sample_times", f"WITH {CV}, {GRID} SELECT run_id, step, t FROM gr")
def x23(spark, d):
    return I.sample_times(_durations(_events(spark, d)), 0.25)


VISUAL = {  # columns of a visual sample, as Spark and DuckDB both read them
    "motion": "value", "motion_structural": "value * 0.6", "luminance_shift": "abs(value - 50)", "brightness": "value / (value + 50)",
    "brightness_p90": "least(value / 40, 1)", "contrast": "idx % 100 / 100", "saturation": "idx % 7 / 7", "entropy": "ln(1 + abs(value))",
}
AUDIO = {
    "audio_energy": "value", "spectral_centroid": "idx % 1000", "spectral_flatness": "idx % 13 / 13",
    "speech_activity": "CASE WHEN value > 50 THEN 1 ELSE 0 END",
}
ASKS = "(^| )[0-9]*7( |$)"  # an utterance whose number ends in 7 plays a call to action
STATES = ("speech_present", "music_present", "text_present", "cta_present", "object_count")


def _sample_sql(name, kind, columns):
    fields = ", ".join(f"'{c}': ({e})::DOUBLE" for c, e in columns.items())
    return f"{name} AS (SELECT run_id, t, {{'t': t, {fields}}} AS s FROM cv WHERE kind = '{kind}')"


def _between_sql(lo, hi, columns):
    w = f"((t - {lo}.t) / ({hi}.t - {lo}.t))"
    return ", ".join(
        f"round(coalesce(CASE WHEN {lo}.t IS NULL THEN {hi}.{c} WHEN {hi}.t IS NULL OR {hi}.t = {lo}.t THEN {lo}.{c} ELSE {lo}.{c} * (1 - {w}) + {hi}.{c} * {w} END, 0), 6) AS {c}"
        for c in columns
    )


@query("e05_feature_grid", f"""{BASE}, {OV}, {FU}, {GRID}, {_sample_sql("vs", "view", VISUAL)}, {_sample_sql("aus", "error", AUDIO)},
 g1 AS (SELECT gr.*, s AS vl FROM gr ASOF LEFT JOIN vs ON gr.run_id = vs.run_id AND gr.t >= vs.t),
 g2 AS (SELECT g1.*, s AS vh FROM g1 ASOF LEFT JOIN vs ON g1.run_id = vs.run_id AND g1.t <= vs.t),
 g3 AS (SELECT g2.*, s AS al FROM g2 ASOF LEFT JOIN aus ON g2.run_id = aus.run_id AND g2.t >= aus.t),
 g4 AS (SELECT g3.*, s AS ah FROM g3 ASOF LEFT JOIN aus ON g3.run_id = aus.run_id AND g3.t <= aus.t),
 sw AS (SELECT run_id, span_start, span_end, count(*) AS shown FROM ov WHERE kind = 'overlay' GROUP BY ALL),
 ct AS (SELECT DISTINCT run_id, least(greatest(round_even(start_t * 0.25 - 0.5, 0), 0), 179) AS step FROM sh)
 SELECT g4.run_id, g4.step, {_between_sql("vl", "vh", VISUAL)}, CASE WHEN vl.t IS NOT NULL AND vh.t IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS visual_available,
 {_between_sql("al", "ah", AUDIO)}, CASE WHEN al.t IS NOT NULL AND ah.t IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS audio_available,
 CASE WHEN fu.speech_text <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS speech_present, CASE WHEN fu.audio_label = 'music' THEN 1.0 ELSE 0.0 END::DOUBLE AS music_present,
 CASE WHEN sw.shown > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS text_present,
 CASE WHEN fu.event_type = 'cta' OR regexp_matches(fu.speech_text, '{ASKS}') THEN 1.0 ELSE 0.0 END::DOUBLE AS cta_present, coalesce(sw.shown, 0)::DOUBLE AS object_count,
 CASE WHEN fu.span_start IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS content_event_available, CASE WHEN ct.step IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS shot_change
 FROM g4 LEFT JOIN fu ON fu.run_id = g4.run_id AND g4.t >= fu.span_start AND (g4.t < fu.span_end OR (g4.t = 720 AND fu.span_end = 720))
 LEFT JOIN sw ON sw.run_id = fu.run_id AND sw.span_start = fu.span_start AND sw.span_end = fu.span_end LEFT JOIN ct ON ct.run_id = g4.run_id AND ct.step = g4.step""")
def e05(spark, d):
    """All 21 columns: interpolated signals, states of the fused timeline, impulses at cuts, availability."""
    ev, iv, fused, _, width = _fused(spark, d)
    samples = lambda kind, columns: ev.where(F.col("kind") == kind).select("run_id", "t", *[F.expr(e).alias(c) for c, e in columns.items()])
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    spans = fused.select(
        "run_id", "span_start", "span_end", one(F.col("speech_text") != "").alias("speech_present"), one(F.col("audio_label") == "music").alias("music_present"),
        one(F.size("on_screen_text") > 0).alias("text_present"), one((F.col("event_type") == "cta") | F.col("speech_text").rlike(ASKS)).alias("cta_present"),
        F.size("on_screen_text").alias("object_count"))
    signals = {"visual": (samples("view", VISUAL), list(VISUAL)), "audio": (samples("error", AUDIO), list(AUDIO))}
    cuts = _shots(ev, width).select("run_id", F.col("start_t").alias("t"))
    out = I.feature_grid(_durations(ev), 0.25, signals, spans, STATES, cuts, width)
    return out.select(*[r(c).alias(c) if c in VISUAL or c in AUDIO else c for c in out.columns])


RUNS = """rl AS (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS nw FROM cv WINDOW w AS (PARTITION BY run_id ORDER BY t, idx)),
 ri AS (SELECT *, sum(nw) OVER (PARTITION BY run_id ORDER BY t, idx) AS g FROM rl),
 rr AS (SELECT run_id, g, min(t) AS s, any_value(kind) AS label, avg(value) AS mean_value, count(*) AS frames FROM ri GROUP BY ALL),
 rs AS (SELECT run_id, label, CASE WHEN lag(s) OVER w IS NULL THEN 0 ELSE s END AS start_t, coalesce(lead(s) OVER w, 720) AS end_t, mean_value, frames FROM rr WINDOW w AS (PARTITION BY run_id ORDER BY s))"""


def _run_segments(spark, d):
    ev = _events(spark, d)
    width = chunk_width(ev, ["run_id"], "t")
    return I.run_segments(ev.select("run_id", "t", "idx", F.col("kind").alias("label"), "value"), _durations(ev), ["t", "idx"], width), width


@query("w07_run_length_segments", f"WITH {CV}, {RUNS} SELECT run_id, label, round(start_t, 6) AS start_t, round(end_t, 6) AS end_t, round(mean_value, 6) AS mean_value, frames FROM rs")
def w07(spark, d):
    seg, _ = _run_segments(spark, d)
    return seg.select("run_id", "label", r("start_t").alias("start_t"), r("end_t").alias("end_t"), r("mean_value").alias("mean_value"), "frames")


@query("w08_absorb_short_segments")
def w08(spark, d):
    """Repeated absorption into the longer neighbour; checked against brute force in the tests."""
    seg, width = _run_segments(spark, d)
    return I.absorb_short(seg, 6.0, width)


@query("w09_merge_short_spans", f"WITH RECURSIVE {CV}, {SH}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY start_t) AS k FROM sh), f AS (SELECT run_id, k, idx AS head FROM o WHERE k = 1 UNION ALL SELECT o.run_id, o.k, CASE WHEN o.end_t - o.start_t < 24 THEN f.head ELSE o.idx END FROM f JOIN o ON o.run_id = f.run_id AND o.k = f.k + 1) SELECT o.run_id, CAST(f.head AS VARCHAR) AS label, round(min(start_t), 6) AS start_t, round(max(end_t), 6) AS end_t, count(*) AS merged FROM f JOIN o USING (run_id, k) GROUP BY ALL")
def w09(spark, d):
    ev = _events(spark, d)
    width = chunk_width(ev, ["run_id"], "t")
    out = I.merge_short_spans(_shots(ev, width).withColumn("label", F.col("idx").cast("string")), 24.0, width)
    return out.select("run_id", "label", r("start_t").alias("start_t"), r("end_t").alias("end_t"), "merged")


DET = "dt AS (SELECT run_id, t, CASE kind WHEN 'view' THEN 'content' WHEN 'click' THEN 'adaptive' WHEN 'error' THEN 'threshold' ELSE 'other' END AS detector FROM cv)"


@query("w10_cluster_boundaries", f"""WITH RECURSIVE {CV}, {DET}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, detector) AS k FROM dt),
 f AS (SELECT run_id, k, t AS anchor FROM o WHERE k = 1 UNION ALL SELECT o.run_id, o.k, CASE WHEN o.t - f.anchor <= 5 THEN f.anchor ELSE o.t END FROM f JOIN o ON o.run_id = f.run_id AND o.k = f.k + 1),
 g AS (SELECT o.run_id, anchor, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detector FROM f JOIN o USING (run_id, k) GROUP BY ALL),
 h AS (SELECT *, min(anchor) OVER (PARTITION BY run_id) AS m FROM g)
 SELECT run_id, round(CASE WHEN anchor = m AND m <= 5 THEN 0 ELSE anchor END, 6) AS t, CASE WHEN anchor = m AND m <= 5 THEN 'start' WHEN detector LIKE '%threshold%' THEN 'fade' WHEN detector LIKE '%content%' THEN 'cut' WHEN detector LIKE '%adaptive%' THEN 'gradual' ELSE 'unknown' END AS transition, detector FROM h
 UNION ALL SELECT DISTINCT run_id, 0.0, 'start', 'implicit' FROM h WHERE m > 5""")
def w10(spark, d):
    ev = _events(spark, d)
    det = F.when(F.col("kind") == "view", "content").when(F.col("kind") == "click", "adaptive").when(F.col("kind") == "error", "threshold").otherwise("other")
    out = I.cluster_boundaries(ev.select("run_id", "t", det.alias("detector")), 5.0, chunk_width(ev, ["run_id"], "t"))
    return out.select("run_id", r("t").alias("t"), "transition", "detector")


@query("p13_transition_kind", f"WITH {CV}, {DET}, g AS (SELECT run_id, floor(t / 24) AS day, list(DISTINCT detector) AS s FROM dt GROUP BY ALL) SELECT run_id, CAST(day AS BIGINT) AS day, CASE WHEN list_contains(s, 'threshold') THEN 'fade' WHEN list_contains(s, 'content') THEN 'cut' WHEN list_contains(s, 'adaptive') THEN 'gradual' ELSE 'unknown' END AS transition FROM g")
def p13(spark, d):
    det = F.when(F.col("kind") == "view", "content").when(F.col("kind") == "click", "adaptive").when(F.col("kind") == "error", "threshold").otherwise("other")
    sets = _events(spark, d).groupBy("run_id", F.floor(F.col("t") / 24).alias("day")).agg(F.collect_set(det).alias("s"))
    return sets.select("run_id", "day", I.transition_kind(F.col("s")).alias("transition"))


@query("w12_merge_samples", f"WITH {CV}, q AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 8 THEN 0 ELSE 1 END AS nw FROM cv WHERE value < 50 WINDOW w AS (PARTITION BY run_id ORDER BY t)), g AS (SELECT *, sum(nw) OVER (PARTITION BY run_id ORDER BY t) AS g FROM q) SELECT run_id, round(min(t), 6) AS start_t, round(max(t), 6) AS end_t, count(*) AS samples, round(sum(value), 4) AS total FROM g GROUP BY run_id, g")
def w12(spark, d):
    ev = _events(spark, d)
    out = I.merge_samples(ev.where("value < 50"), 8.0, chunk_width(ev, ["run_id"], "t"))
    return out.select("run_id", r("start_t").alias("start_t"), r("end_t").alias("end_t"), "samples", r("total", 4).alias("total"))


WIN = "wi AS (SELECT run_id, idx, kind AS label, t AS start_t, t + value / 5 AS end_t, value / 503 AS probability FROM cv)"


def _windows(ev):
    return ev.select("run_id", "idx", F.col("kind").alias("label"), F.col("t").alias("start_t"), (F.col("t") + F.col("value") / 5).alias("end_t"), (F.col("value") / 503).alias("probability"))


@query("w13_merge_label_windows", f"WITH {CV}, {WIN}, q AS (SELECT *, CASE WHEN start_t > lag(end_t) OVER w OR lag(end_t) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM wi WHERE probability >= 0.05 WINDOW w AS (PARTITION BY run_id, label ORDER BY start_t, idx)), g AS (SELECT *, sum(nw) OVER (PARTITION BY run_id, label ORDER BY start_t, idx) AS g FROM q) SELECT run_id, label, round(min(start_t), 6) AS start_t, round(least(720, max(end_t)), 6) AS end_t, round(least(720, arg_max((start_t + end_t) / 2, struct_pack(a := probability, b := -start_t))), 6) AS peak_t, round(max(probability), 8) AS confidence, count(*) AS windows FROM g GROUP BY run_id, label, g")
def w13(spark, d):
    ev = _events(spark, d)
    out = I.merge_windows(_windows(ev), _durations(ev), 0.05, chunk_width(ev, ["run_id"], "t"))
    return out.select("run_id", "label", *[r(c).alias(c) for c in ("start_t", "end_t", "peak_t")], r("confidence", 8).alias("confidence"), "windows")


@query("w14_covering_maximum", f"""WITH {CV}, {WIN}, {GRID}, w AS (SELECT run_id, start_t, end_t, probability FROM wi WHERE label = 'error'),
 c AS (SELECT gr.run_id, step, max(probability) AS p FROM gr JOIN w ON w.run_id = gr.run_id AND start_t <= t AND t < end_t GROUP BY ALL),
 n AS (SELECT gr.run_id, gr.step, arg_min(probability, struct_pack(a := abs((start_t + end_t) / 2 - t), b := start_t)) AS p FROM gr JOIN w ON w.run_id = gr.run_id GROUP BY ALL)
 SELECT gr.run_id, gr.t, round(coalesce(c.p, n.p), 8) AS probability FROM gr LEFT JOIN c USING (run_id, step) LEFT JOIN n USING (run_id, step)""")
def w14(spark, d):
    ev = _events(spark, d)
    grid = I.sample_times(_durations(ev), 0.25).select("run_id", "t")
    w = _windows(ev).where("label = 'error'")
    out = I.covering_maximum(grid, w, bucket_width(w, "start_t", "end_t"), chunk_width(ev, ["run_id"], "t"))
    return out.withColumn("probability", r("probability", 8))


@query("p09_frame_labels", f"WITH {CV}, f AS (SELECT run_id, floor(t / 12) AS frame, max(value) FILTER (kind = 'view') / 200 AS m, max(value) FILTER (kind = 'click') / 200 AS sp, max(value) FILTER (kind = 'error') / 200 AS si, max(value) FILTER (kind = 'signup') / 200 AS sl FROM cv GROUP BY ALL), g AS (SELECT run_id, frame, coalesce(m, 0) AS m, coalesce(sp, 0) AS sp, coalesce(si, 0) AS si, coalesce(sl, 0) AS sl FROM f), h AS (SELECT *, sp >= 0.2 AND sp >= 1.2 * si AS ok FROM g) SELECT run_id, CAST(frame AS BIGINT) AS frame, CASE WHEN sl >= 0.2 AND m < 0.2 AND NOT ok THEN 'silence' WHEN ok AND sp >= m THEN 'speech' WHEN m >= 0.2 OR si >= 0.2 THEN 'music' WHEN ok THEN 'speech' ELSE 'other' END AS label FROM h")
def p09(spark, d):
    top = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("value"))) / 200, F.lit(0.0))
    frames = _events(spark, d).groupBy("run_id", F.floor(F.col("t") / 12).alias("frame")).agg(top("view").alias("m"), top("click").alias("sp"), top("error").alias("si"), top("signup").alias("sl"))
    return frames.select("run_id", "frame", I.frame_label(F.col("m"), F.col("sp"), F.col("si"), F.col("sl"), 0.2).alias("label"))


@query("p10_energy_labels", f"""WITH {CV}, q AS (SELECT run_id, quantile_cont(value, 0.95) * 0.2 AS cut, quantile_cont(sqrt(value), 0.6) AS fl FROM cv GROUP BY 1),
 s AS (SELECT DISTINCT cv.run_id, cv.idx FROM cv JOIN (SELECT run_id, t AS a, t + value / 20 AS b FROM cv WHERE kind = 'click') c ON c.run_id = cv.run_id AND cv.t >= a AND cv.t < b)
 SELECT cv.run_id, cv.idx, CASE WHEN s.idx IS NOT NULL THEN 'speech' WHEN value <= cut THEN 'silence' WHEN sqrt(value) < fl THEN 'music' ELSE 'other' END AS label FROM cv JOIN q USING (run_id) LEFT JOIN s USING (run_id, idx)""")
def p10(spark, d):
    ev = _events(spark, d).withColumn("flatness", F.sqrt("value"))
    q = exact_quantiles(ev, ["run_id"], "value", {"p95": 0.95}).join(exact_quantiles(ev, ["run_id"], "flatness", {"p60": 0.6}), "run_id")
    speech = ev.where("kind = 'click'").select("run_id", F.col("t").alias("a"), (F.col("t") + F.col("value") / 20).alias("b"))
    spoken = stab_join(ev.select("run_id", "idx", "t"), speech, ["run_id"], "t", ("a", "b"), bucket_width(speech, "a", "b")).select("run_id", "idx").distinct().withColumn("s", F.lit(True))
    label = F.when(F.col("s"), "speech").when(F.col("value") <= F.col("p95") * 0.2, "silence").when(F.col("flatness") < F.col("p60"), "music").otherwise("other")
    return ev.join(q, "run_id").join(spoken, ["run_id", "idx"], "left").select("run_id", "idx", label.alias("label"))


@query("p11_frame_kind", f"""WITH {CV}, {SH}, e AS (SELECT sh.run_id, sh.idx, sh.start_t, avg(cv.value) FILTER (cv.t >= sh.start_t - 3 AND cv.t < sh.start_t + 3) / 503 AS entropy FROM sh JOIN cv ON cv.run_id = sh.run_id GROUP BY ALL),
 x AS (SELECT DISTINCT sh.run_id, sh.idx FROM sh JOIN (SELECT run_id, t AS a, t + value / 10 AS b FROM cv WHERE kind = 'signup') o ON o.run_id = sh.run_id AND sh.start_t >= a AND sh.start_t < b)
 SELECT e.run_id, e.idx, CASE WHEN entropy IS NULL THEN 'unknown' WHEN entropy <= 0.02 THEN 'blank' WHEN entropy < 0.12 AND x.idx IS NOT NULL THEN 'graphic' ELSE 'photographic' END AS frame_kind FROM e LEFT JOIN x USING (run_id, idx)""")
def p11(spark, d):
    ev = _events(spark, d)
    frames = _shots(ev).select("run_id", "idx", F.col("start_t").alias("ft"), (F.col("start_t") - 3).alias("a"), (F.col("start_t") + 3).alias("b"))
    near = stab_join(ev.select("run_id", "t", "value"), frames, ["run_id"], "t", ("a", "b"), 12.0).groupBy("run_id", "idx").agg((F.avg("value") / 503).alias("entropy"))
    over = ev.where("kind = 'signup'").select("run_id", F.col("t").alias("oa"), (F.col("t") + F.col("value") / 10).alias("ob"))
    text = stab_join(frames.select("run_id", "idx", "ft"), over, ["run_id"], "ft", ("oa", "ob"), bucket_width(over, "oa", "ob")).select("run_id", "idx").distinct().withColumn("x", F.lit(True))
    e = F.col("entropy")
    kind = F.when(e.isNull(), "unknown").when(e <= 0.02, "blank").when((e < 0.12) & F.col("x").isNotNull(), "graphic").otherwise("photographic")
    return frames.select("run_id", "idx").join(near, ["run_id", "idx"], "left").join(text, ["run_id", "idx"], "left").select("run_id", "idx", kind.alias("frame_kind"))


@query("p24_overlap_flag", f"WITH {CV} SELECT run_id, idx, coalesce(CASE WHEN kind <> 'view' THEN value / 503 END >= 0.07, false) AS flagged FROM cv")
def p24(spark, d):
    p = F.when(F.col("kind") != "view", F.col("value") / 503)
    return _events(spark, d).select("run_id", "idx", F.coalesce(p >= 0.07, F.lit(False)).alias("flagged"))


@query("p30_content_time_of_row", f"WITH {CV}, m AS (SELECT run_id, t, row_number() OVER (PARTITION BY run_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM cv), k AS (SELECT du.run_id, g.i AS asked FROM du, (SELECT unnest([0, 10, 100000]) AS i) g) SELECT k.run_id, asked, round(t - 5, 6) AS content_time FROM k JOIN m ON m.run_id = k.run_id AND m.i = least(asked, n - 1)")
def p30(spark, d):
    from tidemark.operators.sequence import ordinal

    ev = _events(spark, d)
    rows = ordinal(ev.select("run_id", "t"), ["run_id"], ["t"], "i", chunk_width(ev, ["run_id"], "t"))
    sizes = ev.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    asked = sizes.select("run_id", "n", F.explode(F.array(F.lit(0), F.lit(10), F.lit(100000))).alias("asked"))
    at = asked.withColumn("i", F.least(F.col("asked").cast("long"), F.col("n") - 1))
    return at.join(rows, ["run_id", "i"]).select("run_id", "asked", r(F.col("t") - 5).alias("content_time"))


@query("w24_scene_grouping", f"""WITH RECURSIVE {CV}, {SH}, {IV}, {SCENES}
 SELECT o.run_id, round(f.head, 6) AS start_t, round(max(end_t), 6) AS end_t, CAST(count(*) AS INTEGER) AS shots FROM f JOIN o USING (run_id, k) GROUP BY o.run_id, f.head""")
def w24(spark, d):
    ev = _events(spark, d)
    out = _scenes(ev, chunk_width(ev, ["run_id"], "t"))
    return out.select("run_id", r("start_t").alias("start_t"), r("end_t").alias("end_t"), "shots")


@query("j21_box_suppression", """WITH RECURSIVE b AS (SELECT l_orderkey AS frame, l_returnflag AS label, l_linenumber AS idx, l_partkey, l_suppkey, l_tax * 100 AS x1, l_discount * 100 AS y1, l_tax * 100 + l_quantity AS x2, l_discount * 100 + l_quantity / 2 AS y2, l_extendedprice AS c FROM lineitem),
 o AS (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY c DESC, idx, l_partkey, l_suppkey) AS k FROM b),
 f AS (SELECT frame, label, k, [struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, k := k)] AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.frame, o.label, o.k, CASE WHEN list_bool_and(list_transform(f.kept, lambda q: CASE WHEN (o.x2 - o.x1) * (o.y2 - o.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - greatest(0, least(o.x2, q.x2) - greatest(o.x1, q.x1)) * greatest(0, least(o.y2, q.y2) - greatest(o.y1, q.y1)) > 0
   THEN greatest(0, least(o.x2, q.x2) - greatest(o.x1, q.x1)) * greatest(0, least(o.y2, q.y2) - greatest(o.y1, q.y1)) / ((o.x2 - o.x1) * (o.y2 - o.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - greatest(0, least(o.x2, q.x2) - greatest(o.x1, q.x1)) * greatest(0, least(o.y2, q.y2) - greatest(o.y1, q.y1))) ELSE 0 END <= 0.6))
   THEN list_append(f.kept, struct_pack(x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2, k := o.k)) ELSE f.kept END FROM f JOIN o ON o.frame = f.frame AND o.label = f.label AND o.k = f.k + 1),
 z AS (SELECT frame, label, arg_max(kept, k) AS kept FROM f GROUP BY ALL)
 SELECT o.frame, o.label, o.idx, o.c AS confidence FROM o JOIN z USING (frame, label) WHERE list_contains(list_transform(z.kept, lambda q: q.k), o.k)""")
def j21(spark, d):
    q, x, y = F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100
    boxes = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("idx"),
        x.alias("x1"), y.alias("y1"), (x + q).alias("x2"), (y + q / 2).alias("y2"), F.col("l_extendedprice").alias("confidence"))
    return I.suppress_boxes(boxes, ["frame", "label"]).select("frame", "label", "idx", "confidence")
