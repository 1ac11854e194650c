"""Language rules over conversations and documents; vector operators over embeddings.

Segments are conversation turns of ten seconds each, with an opening and a closing phrase
picked by turn so that every rule has something to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as TX
from tidemark.functions.scalar import r
from tidemark.operators import intervals as I
from tidemark.operators import vectors as V
from tidemark.operators.panel import ordered_list
from tidemark.operators.ranks import top_k
from tidemark.plans.registry import query
from tidemark.session import spread
from tidemark.sources.tables import table

OPENERS = ("", "First ", "Finally ", "Welcome ")
CLOSERS = (
    "sign up today", "Buy now!", "learn more", "Is it fast?", "It costs 20 dollars", "do not wait, act now",
    "Don't miss the last chance", "this will improve sales", "click the link", "download the app?",
    "a proven and optimal result", "it ends, then it stops",
)


def _sql_list(items):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


SEG = f"""sg AS (SELECT conv_id, turn, role, {_sql_list(OPENERS)}[(conv_id + turn) % 4 + 1] || text || ' ' || {_sql_list(CLOSERS)}[(conv_id * 3 + turn) % 12 + 1] AS txt,
 turn * 10.0::DOUBLE AS s, turn * 10.0::DOUBLE + 10 AS e, (max(turn) OVER (PARTITION BY conv_id) + 1) * 10.0::DOUBLE AS dur FROM conversations)"""
CTA = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower(txt), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for p, n in TX.CTA_PATTERNS) + ")"
URG = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(txt), '(^|[^\\p{{L}}\\p{{N}}_]){t.replace(chr(39), chr(39) * 2)}($|[^\\p{{L}}\\p{{N}}_])') THEN '{t.replace(chr(39), chr(39) * 2)}' END" for t in TX.URGENCY_TERMS
) + "], lambda x: x IS NOT NULL)"
CLAIM = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(txt, '(?i){p}') THEN '{n}' END" for p, n in TX.FORBIDDEN_CLAIMS) + "], lambda x: x IS NOT NULL)"
MARK = "CASE " + " ".join(
    f"WHEN starts_with(trim(lower(txt)), '{m.replace(chr(39), chr(39) * 2)}') OR contains(trim(lower(txt)), ', {m.replace(chr(39), chr(39) * 2)} ') THEN '{role}'"
    for role, ms in TX.DISCOURSE_MARKERS.items() for m in ms
) + " END"
ROLE = f"CASE WHEN ({MARK}) IS NOT NULL THEN ({MARK}) WHEN {CTA} IS NOT NULL THEN 'conclusion' WHEN (s + e) / 2 / dur < 0.25 THEN 'introduction' WHEN (s + e) / 2 / dur > 0.75 THEN 'conclusion' ELSE 'development' END"


def _pick(items, index):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (index % len(items)).cast("int") + 1)


def _segments(spark, d):
    c = spread(table(spark, d, "conversations"))
    last = c.groupBy("conv_id").agg(((F.max("turn") + 1) * 10.0).alias("dur"))
    txt = F.concat(_pick(OPENERS, F.col("conv_id") + F.col("turn")), F.col("text"), F.lit(" "), _pick(CLOSERS, F.col("conv_id") * 3 + F.col("turn")))
    return c.join(last, "conv_id").select(
        "conv_id", "turn", "role", txt.alias("txt"), (F.col("turn") * 10.0).alias("s"), (F.col("turn") * 10.0 + 10).alias("e"), "dur")


@query("x01_text_normalise", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents")
def x01(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(TX.normalise_text(F.col("text"))).alias("digest"))


@query("x02_sequence_similarity")
def x02(spark, d):
    """Similarity of each turn to the one before it (matching blocks have no SQL form)."""
    from tidemark.operators.sequence import chunk_width, neighbours

    c = table(spark, d, "conversations").withColumn("norm", TX.normalise_text(F.col("text")))
    near = neighbours(c, ["conv_id"], ["turn"], ["norm"], chunk_width(c, ["conv_id"], "turn"))
    score = TX.sequence_ratio(F.coalesce("prev.norm", F.lit("")), F.col("norm"))
    return near.select("conv_id", "turn", r(score).alias("similarity"))


@query("x03_cta_pattern", f"WITH {SEG} SELECT conv_id, turn, {CTA} AS pattern FROM sg")
def x03(spark, d):
    return _segments(spark, d).select("conv_id", "turn", TX.cta_pattern(F.col("txt")).alias("pattern"))


@query("x04_question_and_numeric", f"WITH {SEG} SELECT conv_id, turn, regexp_matches(txt, '\\?\\s*$') AS is_question, regexp_matches(txt, '(^|[^\\p{{L}}\\p{{N}}_])[0-9]+([.,][0-9]+)?\\s*(%|percent|x|times|dollars?|\\$|€|£)?($|[^\\p{{L}}\\p{{N}}_])') AS numeric_claim FROM sg")
def x04(spark, d):
    t = F.col("txt")
    return _segments(spark, d).select("conv_id", "turn", TX.is_question(t).alias("is_question"), TX.has_numeric_claim(t).alias("numeric_claim"))


@query("x05_urgency_terms", f"WITH {SEG} SELECT conv_id, turn, array_to_string({URG}, ',') AS terms FROM sg")
def x05(spark, d):
    return _segments(spark, d).select("conv_id", "turn", F.array_join(TX.urgency_terms(F.col("txt")), ",").alias("terms"))


@query("x07_structural_role", f"WITH {SEG} SELECT conv_id, turn, {ROLE} AS role FROM sg")
def x07(spark, d):
    t = F.col("txt")
    role = TX.structural_role(t, F.col("s"), F.col("e"), F.col("dur"), TX.cta_pattern(t).isNotNull())
    return _segments(spark, d).select("conv_id", "turn", role.alias("role"))


@query("x08_language_record", f"WITH {SEG} SELECT conv_id, turn, CASE WHEN {CTA} IS NOT NULL THEN 'urgent' ELSE 'unknown' END AS tone, regexp_matches(txt, '\\?\\s*$') AS is_question, {CTA} IS NOT NULL AS is_call_to_action, {CTA} AS matched_pattern, array_to_string({URG}, ',') AS urgency_markers, {ROLE} AS structural_role FROM sg")
def x08(spark, d):
    seg = _segments(spark, d)
    out = seg.select("conv_id", "turn", *TX.language_record(F.col("txt"), F.col("s"), F.col("e"), F.col("dur")))
    return out.select("conv_id", "turn", "tone", "is_question", "is_call_to_action", "matched_pattern", F.array_join("urgency_markers", ",").alias("urgency_markers"), "structural_role")


@query("x09_call_to_action_list", f"""WITH {SEG}, ov AS (SELECT (page_id % 100) AS conv_id, page_id AS turn, url || ' ' || {_sql_list(CLOSERS)}[page_id % 12 + 1] AS txt, page_id * 1.0::DOUBLE AS s FROM pages)
 SELECT conv_id, s AS start_t, modality, p AS matched_pattern, turn FROM (SELECT conv_id, s, 'speech' AS modality, {CTA} AS p, turn FROM sg UNION ALL SELECT conv_id, s, 'on_screen_text', {CTA}, turn FROM ov) WHERE p IS NOT NULL""")
def x09(spark, d):
    pages = table(spark, d, "pages")
    shown = pages.select((F.col("page_id") % 100).alias("conv_id"), F.col("page_id").cast("double").alias("s"), F.lit("on_screen_text").alias("modality"),
                         F.concat("url", F.lit(" "), _pick(CLOSERS, F.col("page_id"))).alias("txt"), F.col("page_id").alias("turn"))
    spoken = _segments(spark, d).select("conv_id", "s", F.lit("speech").alias("modality"), "txt", "turn")
    both = spoken.unionByName(shown).withColumn("matched_pattern", TX.cta_pattern(F.col("txt"))).where("matched_pattern IS NOT NULL")
    return both.select("conv_id", F.col("s").alias("start_t"), "modality", "matched_pattern", "turn")


@query("x10_forbidden_claims", f"WITH {SEG} SELECT conv_id, turn, array_to_string({CLAIM}, ';') AS reasons FROM sg")
def x10(spark, d):
    return _segments(spark, d).select("conv_id", "turn", F.array_join(TX.forbidden_claims(F.col("txt")), ";").alias("reasons"))


@query("a24_frequent_terms", f"""WITH w AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(lower(text), '[\\s\\p{{Z}}]+')), '[^\\p{{L}}]', '', 'g') AS word FROM documents),
 c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 4 AND word NOT IN ({", ".join("'" + x + "'" for x in TX.STOP_WORDS)}) GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word COLLATE C) AS rank FROM c) SELECT doc_id, word, n, rank FROM k WHERE rank <= 12 AND n >= 2""".replace(" COLLATE C", ""))
def a24(spark, d):
    # Letters and blanks only, once per text; then split.
    letters = F.regexp_replace(F.lower("text"), r"[^\p{L}\s\p{Z}]+", "")
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    words = docs.select("doc_id", F.explode(F.split(letters, r"[\s\p{Z}]+")).alias("word"))
    counts = words.where((F.length("word") >= 4) & ~F.col("word").isin(list(TX.STOP_WORDS))).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["doc_id"], [F.col("n").desc(), F.col("word")], 12).where("n >= 2").select("doc_id", "word", "n", "rank")


@query("w25_number_by_first_appearance", "SELECT conv_id, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY f) AS number FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL)")
def w25(spark, d):
    return V.number_by_first(table(spark, d, "conversations"), "conv_id", "role", "turn")


@query("j14_label_joins", f"WITH {SEG}, nb AS (SELECT conv_id, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY f) AS n FROM (SELECT conv_id, role, min(turn) AS f FROM conversations WHERE turn % 3 < 2 GROUP BY ALL)) SELECT sg.conv_id, sg.turn, CASE WHEN sg.turn % 3 < 2 THEN 'Speaker ' || n END AS speaker, CASE WHEN quality IS NOT NULL THEN round(quality * 0.5::DOUBLE + 0.1, 3) END AS probability FROM sg LEFT JOIN nb USING (conv_id, role) LEFT JOIN labels ON doc_id = conv_id * 10 + sg.turn")
def j14(spark, d):
    seg = _segments(spark, d)
    known = seg.where("turn % 3 < 2")
    names = V.number_by_first(known, "conv_id", "role", "turn")
    speakers = known.join(names, ["conv_id", "role"]).select("conv_id", "turn", F.concat(F.lit("Speaker "), F.col("number").cast("string")).alias("speaker"))
    # Probabilities are keyed by the segment's rounded span.
    scores = table(spark, d, "labels").select(F.floor(F.col("doc_id") / 10).alias("conv_id"), F.round((F.col("doc_id") % 10) * 10.0, 3).alias("span_start"), F.round(F.col("quality") * 0.5 + 0.1, 3).alias("probability"))
    return (seg.join(speakers, ["conv_id", "turn"], "left").withColumn("span_start", F.round("s", 3)).join(scores, ["conv_id", "span_start"], "left").select("conv_id", "turn", "speaker", "probability"))


@query("w26_merge_similar_texts")
def w26(spark, d):
    """On-screen texts merged while open and similar; checked against brute force in the tests."""
    from tidemark.operators.sequence import chunk_width

    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").cast("double").alias("t"), F.col("turn").alias("idx"),
        _pick(CLOSERS, F.col("conv_id") + F.floor(F.col("turn") / 3)).alias("text"), (F.length("text") % 97 / F.lit(97.0)).alias("confidence"))
    return I.merge_texts(c, 1.0, width=chunk_width(c, ["run_id"], "t"))


WORDS = f"""{SEG}, wd AS (SELECT conv_id, turn * 10.0::DOUBLE + (i - 1) * 0.25 AS ws, w, turn, i FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM conversations) WHERE w <> '')"""


def _words(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("i", "w")).where("w <> ''").select(
        "conv_id", (F.col("turn") * 10.0 + F.col("i") * 0.25).alias("ws"), "w", "turn", "i")


@query("x20_words_in_sentence", f"WITH {WORDS} SELECT sg.conv_id, sg.turn, count(w) AS n_words, md5(coalesce(string_agg(w, ' ' ORDER BY ws, wd.turn, i), '')) AS digest FROM sg LEFT JOIN wd ON wd.conv_id = sg.conv_id AND ws >= s - 1e-6 AND ws < e + 1e-6 GROUP BY ALL")
def x20(spark, d):
    from tidemark.operators.timejoin import stab_join

    seg = _segments(spark, d).select("conv_id", F.col("turn").alias("sentence"), (F.col("s") - 1e-6).alias("a"), (F.col("e") + 1e-6).alias("b"))
    inside = stab_join(_words(spark, d), seg, ["conv_id"], "ws", ("a", "b"), 10.0)
    packed = F.array_sort(F.collect_list(F.struct("ws", "turn", "i", "w")))
    lists = inside.groupBy("conv_id", "sentence").agg(F.transform(packed, lambda x: x["w"]).alias("words"))
    out = seg.select("conv_id", "sentence").join(lists, ["conv_id", "sentence"], "left")
    return out.select("conv_id", F.col("sentence").alias("turn"), F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0)).cast("long").alias("n_words"),
                      F.md5(F.coalesce(F.array_join("words", " "), F.lit(""))).alias("digest"))


@query("x21_transcript", f"""WITH {WORDS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, s AS start_t, e AS end_t, md5(text) AS digest FROM sg JOIN conversations USING (conv_id, turn) WHERE conv_id % 5 > 0
 UNION ALL SELECT conv_id, 0, min(ws), max(ws) + 0.25, md5(string_agg(w, ' ' ORDER BY ws, turn, i)) FROM wd WHERE conv_id % 5 = 0 GROUP BY conv_id""")
def x21(spark, d):
    """Sentences where a run has them, else one segment of all its words."""
    from tidemark.operators.sequence import chunk_width, ordinal

    seg = _segments(spark, d).join(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    sentences = ordinal(seg.where("conv_id % 5 > 0"), ["conv_id"], ["turn"], "idx", chunk_width(seg, ["conv_id"], "turn")).select("conv_id", "idx", F.col("s").alias("start_t"), F.col("e").alias("end_t"), F.md5("text").alias("digest"))
    words = _words(spark, d).join(sentences.select("conv_id").distinct(), "conv_id", "left_anti")
    packed = F.array_sort(F.collect_list(F.struct("ws", "turn", "i", "w")))
    whole = words.groupBy("conv_id").agg(
        F.min("ws").alias("start_t"), (F.max("ws") + 0.25).alias("end_t"), F.md5(F.array_join(F.transform(packed, lambda x: x["w"]), " ")).alias("digest"))
    return sentences.unionByName(whole.withColumn("idx", F.lit(0).cast("long")))


CENT = """ex AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS g(i)), ce AS (SELECT label, i, avg(v) AS c FROM ex GROUP BY ALL)"""


@query("x06_exemplar_classes", f"""WITH {CENT}, sc AS (SELECT vec_id, ce.label AS cls, sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))) AS s FROM ex JOIN ce USING (i) GROUP BY ALL),
 b AS (SELECT vec_id, arg_max(cls, s) AS c, max(s) AS m FROM sc GROUP BY 1) SELECT vec_id, CASE WHEN m < 0.30 THEN 'unknown' ELSE CAST(c AS VARCHAR) END AS class, round(m, 6) AS score FROM b""")
def x06(spark, d):
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("c")).groupBy("label").agg(ordered_list("i", "c").alias("embedding"))
    scored = V.class_scores(e.select("vec_id", "embedding"), mean, "embedding", "label")
    best = V.best_class(F.col("scores"), TX.TONE_FLOOR)
    return scored.select("vec_id", best["label"].alias("class"), r(best["score"]).alias("score"))


def _groups(spark, d):
    return table(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("grp"), "vec_id", "label", "embedding")


SEP = """u AS (SELECT vec_id, vec_id % 10 AS grp, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS g(i)), nn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM u GROUP BY 1),
 p AS (SELECT a.grp, a.vec_id, a.label, b.label AS bl, 1 - sum(a.v * b.v) / (any_value(na.n) * any_value(nb.n)) AS d FROM u a JOIN u b ON a.grp = b.grp AND a.i = b.i AND a.vec_id <> b.vec_id JOIN nn na ON na.vec_id = a.vec_id JOIN nn nb ON nb.vec_id = b.vec_id GROUP BY a.grp, a.vec_id, b.vec_id, a.label, b.label),
 q AS (SELECT grp, vec_id, label, avg(d) FILTER (label = bl) AS a, min(d) FILTER (label <> bl) AS b FROM p GROUP BY ALL)"""


@query("a44_cluster_separation", f"WITH {SEP} SELECT grp, round(coalesce(avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) END), 0), 6) AS separation, count(DISTINCT label) AS clusters FROM q GROUP BY 1")
def a44(spark, d):
    dist = V.nearest_other(_groups(spark, d), "grp", "vec_id", "embedding", "label")
    return V.separation(dist, "grp", "label").withColumn("separation", r("separation"))


@query("a44_nearest_other_cluster", f"WITH {SEP} SELECT grp, vec_id, round(a, 6) AS same_distance, round(b, 6) AS other_distance FROM q")
def a44n(spark, d):
    dist = V.nearest_other(_groups(spark, d), "grp", "vec_id", "embedding", "label")
    return dist.select("grp", "vec_id", r("same_distance").alias("same_distance"), r("other_distance").alias("other_distance"))


@query("e46_cluster_conversation_vectors")
def e46(spark, d):
    """Turns clustered in order to running centroids, withheld where separation is too low."""
    e = table(spark, d, "embeddings")
    total = e.agg(F.count(F.lit(1)).alias("n")).scalar()
    turns = table(spark, d, "conversations").select("conv_id", "turn", ((F.col("conv_id") * 8 + F.col("turn")) % total).alias("vec_id"))
    v = turns.join(e.select("vec_id", "embedding"), "vec_id")
    labels = V.cluster_in_order(v, "conv_id", "turn", "embedding")
    known = v.join(labels, ["conv_id", "turn"])
    sep = V.separation(V.nearest_other(known, "conv_id", "turn", "embedding", "cluster"), "conv_id", "cluster")
    names = V.number_by_first(labels, "conv_id", "cluster", "turn")
    trusted = (F.col("clusters") < 2) | (F.col("separation") >= V.MIN_SEPARATION)
    return labels.join(sep, "conv_id").join(names, ["conv_id", "cluster"]).select(
        "conv_id", "turn", F.when(trusted, F.concat(F.lit("Speaker "), F.col("number").cast("string"))).alias("speaker"), r("separation").alias("separation"))
