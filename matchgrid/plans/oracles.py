"""DuckDB SQL with the rows of each registry query, on the same tables."""

from __future__ import annotations

UTT = """utt AS (
  SELECT user_id AS video_key, event_id AS utt_id,
    CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS DOUBLE) / 3600 AS "start", event_type AS text FROM events),
utterance AS (SELECT video_key, utt_id, "start", "start" + 0.5::DOUBLE + (utt_id % 40) / 8::DOUBLE AS "end", text FROM utt)"""
SEG = """seg AS (
  SELECT v.video_key, CAST(k AS INT) AS seg_id, k * 5.0::DOUBLE AS "start", least(k * 5.0::DOUBLE + 5, 720) AS "end"
  FROM (SELECT DISTINCT user_id AS video_key FROM events) v, range(144) t(k))"""
HEARD_OF = f"""{SEG},
own AS (SELECT *, ("start" + "end") / 2 AS mid FROM utterance),
heard AS (
  SELECT video_key, CAST(CASE WHEN mid >= 0 AND mid < 720 THEN floor(mid / 5) ELSE 143 END AS INT) AS seg_id,
    string_agg(text, ' ' ORDER BY utt_id) AS heard FROM own GROUP BY 1, 2),
near AS (SELECT *, unnest(range(CAST(greatest(0, floor("start" / 5)) AS BIGINT), CAST(least(143, floor("end" / 5)) AS BIGINT) + 1)) AS seg_id FROM utterance),
context AS (
  SELECT s.video_key, s.seg_id, string_agg(u.text, ' ' ORDER BY u.utt_id) AS context
  FROM seg s JOIN near u ON u.video_key = s.video_key AND u.seg_id = s.seg_id AND u."start" < s."end" AND u."end" > s."start" GROUP BY 1, 2),
heard_seg AS (
  SELECT s.video_key, s.seg_id, s."start", s."end", coalesce(heard, '') AS heard, coalesce(context, '') AS context
  FROM seg s LEFT JOIN heard USING (video_key, seg_id) LEFT JOIN context USING (video_key, seg_id))"""
HEARD = f"{UTT}, {HEARD_OF}"
VID = """vid AS (
  SELECT p_partkey AS video_key, p_size * 1.25::DOUBLE AS duration, CAST(320 + (p_partkey % 37) * 53 AS INT) AS width,
    CAST(240 + (p_partkey % 23) * 37 AS INT) AS height FROM part)"""
FRAMES = """num AS (SELECT *, row_number() OVER (PARTITION BY video_key ORDER BY frame) - 1 AS i FROM src)"""
MOTION = "SELECT user_id AS video_key, event_id AS frame, CASE WHEN event_id % 97 = 0 THEN 9::DOUBLE ELSE value / 490 END AS v FROM events"
DIST = "SELECT user_id AS video_key, event_id AS frame, value / 490 AS v FROM events"
CLOCK = """CASE WHEN CAST(floor({t}) AS BIGINT) >= 3600
  THEN printf('%02d:%02d:%02d', CAST(floor({t}) AS BIGINT) // 3600, CAST(floor({t}) AS BIGINT) % 3600 // 60, CAST(floor({t}) AS BIGINT) % 60)
  ELSE printf('%02d:%02d', CAST(floor({t}) AS BIGINT) // 60, CAST(floor({t}) AS BIGINT) % 60) END"""


#: What a stub of a model answers to each segment, chunk and video: the length of its prompt.
SEEN = f"""{UTT.replace("utterance AS", "spoken AS")}, sp AS (SELECT video_key, "start" - 0.125 AS b, "start" + 2 AS e FROM spoken WHERE text IN ('view', 'click')),
sounds AS (SELECT video_key, utt_id, text, "start" + 0.0003::DOUBLE AS b, least(720, "end" + 0.0003::DOUBLE) AS e FROM spoken WHERE "start" + 0.0003::DOUBLE < 720),
utterance AS (
  SELECT s.video_key, utt_id, round_even(s.b, 2) AS "start", round_even(s.e, 2) AS "end", text FROM sounds s LEFT JOIN sp ON sp.video_key = s.video_key AND sp.b < s.e AND sp.e > s.b
  GROUP BY s.video_key, utt_id, s.b, s.e, text HAVING coalesce(sum(greatest(0, least(s.e, sp.e) - greatest(s.b, sp.b))) FILTER (sp.b IS NOT NULL), 0) >= least(0.2, (s.e - s.b) / 2)),
{HEARD_OF},
seen AS (
  SELECT video_key, seg_id, "start", "end", heard, concat(length(concat('Describe what is seen in 5 frames of ', {CLOCK.format(t='"start"')}, '–', {CLOCK.format(t='"end"')}, '.', chr(10),
    CASE WHEN context <> '' THEN concat('Heard at the same time: ', context, chr(10)) ELSE '' END)), ' characters') AS seen FROM heard_seg)"""


def _cuts(name: str) -> str:
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY video_key ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY video_key) AS n FROM ({MOTION})),
{name}_pad AS (
  SELECT video_key, i, v, n FROM {name}_n UNION ALL
  SELECT p.video_key, p.i, m.v, p.n FROM (
      SELECT video_key, n, i, (i % (2 * n) + 2 * n) % (2 * n) AS r FROM (
        SELECT video_key, n, unnest(list_concat(range(-15, 0), range(n, n + 15))) AS i FROM (SELECT DISTINCT video_key, n FROM {name}_n))) p
    JOIN {name}_n m ON m.video_key = p.video_key AND m.i = CASE WHEN r < p.n THEN r ELSE 2 * p.n - 1 - r END),
{name}_base AS (
  SELECT *, median(v) OVER (PARTITION BY video_key ORDER BY i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS base,
    greatest(lag(v, 2) OVER w, lag(v) OVER w, lead(v) OVER w, lead(v, 2) OVER w) AS near
  FROM {name}_pad WINDOW w AS (PARTITION BY video_key ORDER BY i)),
{name}_found AS (
  SELECT video_key, list(i ORDER BY i) AS l FROM {name}_base
  WHERE i >= 2 AND i < n - 2 AND v > 6 * greatest(base, 0.3) AND v > 1.5 AND v > 2.5 * near GROUP BY 1),
{name} AS (
  SELECT video_key, list_reduce(l[2:], lambda b, c: CASE WHEN c - list_last(b) >= 60 THEN list_append(b, c) ELSE b END, [l[1]]) AS cuts
  FROM (SELECT video_key, [CAST(x AS BIGINT) FOR x IN l] AS l FROM {name}_found))"""


def _shots(extra: bool) -> str:
    more = "list_concat(coalesce(cuts, CAST([] AS BIGINT[])), coalesce(more, CAST([] AS BIGINT[])))"
    join = f"LEFT JOIN (SELECT video_key, cuts AS more FROM jc) USING (video_key)" if extra else "CROSS JOIN (SELECT CAST([] AS BIGINT[]) AS more)"  # noqa: F541
    head = f"{_cuts('jc')}, " if extra else ""
    return f"""{head}dn AS (SELECT *, row_number() OVER (PARTITION BY video_key ORDER BY frame) - 1 AS i FROM ({DIST})),
dc AS (SELECT video_key, count(*) AS n, list(CAST(i AS BIGINT) ORDER BY i) FILTER (WHERE v > 0.9) AS cuts FROM dn GROUP BY 1),
du AS (SELECT video_key, n, list_sort(list_distinct({more})) AS cuts FROM dc {join}),
db AS (SELECT video_key, n, list_reduce(cuts, lambda b, c: CASE WHEN c - list_last(b) >= 18 THEN list_append(b, c) ELSE b END, [CAST(0 AS BIGINT)]) AS b FROM du),
de AS (SELECT video_key, list_append(CASE WHEN len(b) > 1 AND n - list_last(b) < 18 THEN b[:len(b) - 1] ELSE b END, n) AS b FROM db),
shots AS (
  SELECT video_key, CAST(k - 1 AS INT) AS shot_id, b[k] AS start_f, b[k + 1] AS end_f
  FROM (SELECT video_key, b, unnest(range(1, len(b))) AS k FROM de))"""


TRACK = """track AS (
  SELECT l_orderkey // 400 AS shot_id, CAST(l_linenumber % 4 AS INT) AS slot,
    row_number() OVER (PARTITION BY l_orderkey // 400, l_linenumber % 4 ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS frame,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_discount * 100 END AS x, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity * 0.4::DOUBLE END AS y FROM lineitem)"""
PIECES = f"""{TRACK},
tp AS (
  SELECT *, max(CASE WHEN x IS NOT NULL THEN frame END) OVER (w ROWS UNBOUNDED PRECEDING) AS pf,
    min(CASE WHEN x IS NOT NULL THEN frame END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qf
  FROM track WINDOW w AS (PARTITION BY shot_id, slot ORDER BY frame)),
tf AS (
  SELECT t.shot_id, t.slot, t.frame,
    p.x + (q.x - p.x) * CASE WHEN qf = pf THEN 0 ELSE (t.frame - pf) / (qf - pf) END AS x,
    p.y + (q.y - p.y) * CASE WHEN qf = pf THEN 0 ELSE (t.frame - pf) / (qf - pf) END AS y
  FROM tp t JOIN track p ON p.shot_id = t.shot_id AND p.slot = t.slot AND p.frame = pf
    JOIN track q ON q.shot_id = t.shot_id AND q.slot = t.slot AND q.frame = qf WHERE qf - pf <= 3),
pieces AS (
  SELECT shot_id, slot, frame, x, y, CAST(sum(new) OVER (PARTITION BY shot_id, slot ORDER BY frame) AS INT) AS piece
  FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY shot_id, slot ORDER BY frame) > 1 THEN 1
      WHEN lag(frame) OVER (PARTITION BY shot_id, slot ORDER BY frame) IS NULL THEN 1 ELSE 0 END AS new FROM tf))"""
def _smoothed(c: str) -> str:
    """A parabola's value at each place, from the explicit weights of its least-squares fit."""
    return f"""list_transform(range(n), lambda i: list_sum(list_transform(range(w), lambda j: {c}[greatest(h, least(i, n - 1 - h)) - h + j + 1] * (
      (q4 - q2 * pow(j - h, 2)) / (w * q4 - q2 * q2) + (j - h) * (i - greatest(h, least(i, n - 1 - h))) / q2
      + (w * pow(j - h, 2) - q2) * pow(i - greatest(h, least(i, n - 1 - h)), 2) / (w * q4 - q2 * q2)))))"""


SMOOTH = f"""{PIECES},
med AS (SELECT *, count(*) OVER (PARTITION BY shot_id, slot, piece) AS n,
    list_sort([coalesce(lag(x, 2) OVER w, 0), coalesce(lag(x) OVER w, 0), x, coalesce(lead(x) OVER w, 0), coalesce(lead(x, 2) OVER w, 0)])[3] AS mx,
    list_sort([coalesce(lag(y, 2) OVER w, 0), coalesce(lag(y) OVER w, 0), y, coalesce(lead(y) OVER w, 0), coalesce(lead(y, 2) OVER w, 0)])[3] AS my
  FROM pieces WINDOW w AS (PARTITION BY shot_id, slot, piece ORDER BY frame)),
arr AS (SELECT shot_id, slot, piece, any_value(n) AS n, list(frame ORDER BY frame) AS f, list(CASE WHEN n >= 9 THEN mx ELSE x END ORDER BY frame) AS xs,
    list(CASE WHEN n >= 9 THEN my ELSE y END ORDER BY frame) AS ys, least(15, any_value(n) // 2 * 2 - 1) AS w FROM med GROUP BY 1, 2, 3),
fit AS (SELECT *, h * (h + 1) * (2 * h + 1) / 3 AS q2, h * (h + 1) * (2 * h + 1) / 3 * (3 * h * h + 3 * h - 1) / 5 AS q4 FROM (SELECT *, (w - 1) // 2 AS h FROM arr)),
smooth AS (SELECT shot_id, slot, piece, unnest(f) AS frame, unnest(CASE WHEN n >= 9 THEN {_smoothed("xs")} ELSE xs END) AS x,
    unnest(CASE WHEN n >= 9 THEN {_smoothed("ys")} ELSE ys END) AS y FROM fit)"""
HITS = """hit AS (
  SELECT l_orderkey AS hit_id, l_linenumber AS n, l_quantity / 5 AS dist, l_discount * 6 AS speed, l_tax * 30 AS since_start,
    l_returnflag = 'A' AS overhead, l_partkey % 2 = 0 AS forehand, l_linenumber = 1 AS first_in_shot, l_suppkey % 3 > 0 AS wrist_low,
    ['low', 'high', 'head'][l_partkey % 3 + 1] AS height, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 4 > 1 END AS swing,
    l_quantity / 4 AS evidence, ['service', 'revers', 'smash', 'lob', 'tennis', NULL][l_suppkey % 6 + 1] AS answer
  FROM lineitem),
ruled AS (
  SELECT *, CASE WHEN serve THEN 'service' WHEN overhead AND dist < 5 AND speed > 0.45 THEN 'smash' WHEN overhead AND dist >= 5 AND speed < 0.35 THEN 'bandeja'
      WHEN overhead THEN 'vibora' WHEN dist < 4.5 AND forehand THEN 'volee_cd' WHEN dist < 4.5 THEN 'volee_revers' WHEN forehand THEN 'coup_droit' ELSE 'revers' END AS stroke,
    CAST(CASE WHEN serve THEN 0.6 WHEN overhead AND dist < 5 AND speed > 0.45 THEN 0.5 WHEN overhead AND dist >= 5 AND speed < 0.35 THEN 0.45
      WHEN overhead THEN 0.35 ELSE 0.6 END AS DOUBLE) AS confidence
  FROM (SELECT *, first_in_shot AND since_start < 2.5 AND dist >= 6.45 AND NOT overhead AND wrist_low AS serve FROM hit)),
allowed AS (
  SELECT *, CASE WHEN len(ok) = 0 THEN names ELSE ok END AS allowed FROM (
    SELECT *, list_filter(names, lambda s:
        (height <> 'low' OR s NOT IN ('bandeja', 'vibora', 'smash')) AND (height <> 'head' OR s IN ('bandeja', 'vibora', 'smash'))
        AND (height = 'low' OR s <> 'service') AND (dist <= 7 OR s NOT IN ('volee_cd', 'volee_revers'))
        AND (dist >= 3 OR s NOT IN ('coup_droit', 'revers', 'lob', 'sortie_vitre', 'service'))) AS ok
    FROM (SELECT *, ['service', 'coup_droit', 'revers', 'volee_cd', 'volee_revers', 'bandeja', 'vibora', 'smash', 'lob', 'sortie_vitre'] AS names FROM ruled)))"""
STATE = """state AS (
  SELECT o_custkey AS match, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS ord,
    CAST(o_orderkey // 4 % 7 AS INT) AS g0, CAST(o_orderkey // 24 % 7 AS INT) AS g1,
    ['0', '15', '30', '40', 'A', '7'][o_orderkey % 6 + 1] AS p0, ['0', '15', '30', '40'][o_orderkey // 7 % 4 + 1] AS p1 FROM orders),
vstate AS (
  SELECT *, CASE WHEN g0 = 6 AND g1 = 6 THEN regexp_full_match(p0, '[0-9]+') AND regexp_full_match(p1, '[0-9]+')
    ELSE p0 IN ('0', '15', '30', '40', 'A') END AS ok, 1000 + g0 + g1 AS prog FROM state)"""
LAB = """lab AS (
  SELECT source AS video, doc_id AS key, concat('c', quality + toxic) AS truth,
    concat('c', CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END + CASE WHEN n_chars > 4000 THEN 1 ELSE 0 END) AS pred,
    CASE WHEN lang = 'en' THEN concat('c', doc_id % 3) END AS vlm, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('c', n_chars % 2) END AS pose
  FROM documents JOIN labels USING (doc_id))"""
SHOT = """shot AS (
  SELECT o_custkey AS video_key, o_orderkey AS shot_id, o_orderkey * 10::DOUBLE AS "start", CAST(trunc(o_totalprice) AS BIGINT) % 600 * 1::DOUBLE AS duration,
    CASE WHEN o_orderstatus = 'F' THEN 'main' ELSE 'other' END AS kind, o_orderkey % 4 > 0 AS scoreboard, o_orderkey % 9 = 0 AS replay FROM orders)"""
PALETTE = """palette(i, w, r, g, b) AS (VALUES (0, 'rouge', 200, 50, 45), (1, 'orange', 230, 110, 50), (2, 'noir', 45, 45, 50), (3, 'blanc', 225, 225, 225),
  (4, 'bleu', 40, 70, 190), (5, 'vert', 50, 150, 70), (6, 'jaune', 230, 210, 60), (7, 'rose', 230, 120, 170), (8, 'gris', 130, 130, 130), (9, 'violet', 120, 60, 160))"""


def _rank(p: str) -> str:
    return f"(CASE {p} WHEN '0' THEN 0 WHEN '15' THEN 1 WHEN '30' THEN 2 WHEN '40' THEN 3 WHEN 'A' THEN 4 END)"


def _winner(b: str) -> str:
    """Winner between the row and its columns with suffix b."""
    step = lambda x0, y0, x1, y1: f"CASE WHEN {y0} - {x0} = 1 AND {y1} - {x1} = 0 THEN 0 WHEN {y0} - {x0} = 0 AND {y1} - {x1} = 1 THEN 1 END"
    r = [_rank(x) for x in ("p0", "p1", f"p0{b}", f"p1{b}")]
    n = [f"TRY_CAST({x} AS INT)" for x in ("p0", "p1", f"p0{b}", f"p1{b}")]
    lost = f"CASE WHEN {r[2]} - {r[0]} = -1 AND {r[3]} = {r[1]} AND {r[0]} = 4 THEN 1 WHEN {r[3]} - {r[1]} = -1 AND {r[2]} = {r[0]} AND {r[1]} = 4 THEN 0 END"
    named = " AND ".join(f"{x} IS NOT NULL" for x in r)
    same = f"CASE WHEN {named} THEN coalesce({step(r[0], r[2], r[1], r[3])}, {lost}) ELSE {step(n[0], n[2], n[1], n[3])} END"
    return f"""CASE WHEN g0{b} IS NULL THEN NULL WHEN g0 = g0{b} AND g1 = g1{b} THEN {same}
      WHEN p0{b} = '0' AND p1{b} = '0' THEN {step('g0', f'g0{b}', 'g1', f'g1{b}')} END"""


#: A recursive walk over the candidates ``c``; states hold value, last time and path.
VITERBI = """o AS (SELECT *, row_number() OVER (PARTITION BY video_key ORDER BY t, cand) AS k FROM c),
walk AS (
  SELECT video_key, CAST(0 AS BIGINT) AS k, 0::DOUBLE AS nv, -1e300::DOUBLE AS fv, -1e300::DOUBLE AS ev, -1e9::DOUBLE AS ft, -1e9::DOUBLE AS et,
    CAST([] AS INT[]) AS np, CAST([] AS INT[]) AS fp, CAST([] AS INT[]) AS ep FROM (SELECT DISTINCT video_key FROM o)
  UNION ALL
  SELECT video_key, k, nv + 3, greatest(fa, fb, fc), greatest(ea, eb, ec),
    CASE WHEN fa >= fb AND fa >= fc THEN t WHEN fb >= fc THEN ft ELSE t END,
    CASE WHEN ea >= eb AND ea >= ec THEN t WHEN eb >= ec THEN t ELSE et END,
    list_append(np, -1),
    CASE WHEN fa >= fb AND fa >= fc THEN list_append(np, 0) WHEN fb >= fc THEN list_append(fp, -1) ELSE list_append(ep, 0) END,
    CASE WHEN ea >= eb AND ea >= ec THEN list_append(np, 1) WHEN eb >= ec THEN list_append(fp, 1) ELSE list_append(ep, -1) END
  FROM (SELECT o.video_key, o.k, o.t, nv, np, fp, ep, ft, et, nv + s0 AS fa, CASE WHEN fv > -1e300 THEN fv + 3 ELSE -1e300 END AS fb,
      CASE WHEN ev > -1e300 AND o.t - et >= 0.45 THEN ev + s0 ELSE -1e300 END AS fc,
      nv + s1 AS ea, CASE WHEN fv > -1e300 AND o.t - ft >= 0.45 THEN fv + s1 ELSE -1e300 END AS eb, CASE WHEN ev > -1e300 THEN ev + 3 ELSE -1e300 END AS ec
    FROM walk w JOIN o ON o.video_key = w.video_key AND o.k = w.k + 1)),
last AS (SELECT video_key, CASE WHEN nv >= fv AND nv >= ev THEN np WHEN fv >= ev THEN fp ELSE ep END AS path
  FROM walk w WHERE k = (SELECT max(k) FROM o WHERE o.video_key = w.video_key)),
chosen AS (SELECT o.video_key, o.cand, nullif(path[o.k], -1) AS team FROM o JOIN last USING (video_key))"""


_CLEAN = """WITH RECURSIVE {state},
n AS (SELECT *, CASE WHEN ok THEN prog END AS p FROM vstate),
m AS (SELECT *, first_value(p IGNORE NULLS) OVER (PARTITION BY match ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM n),
walk AS (
  SELECT match, ord, CASE WHEN p IS NULL THEN NULL ELSE p END AS prev, p IS NOT NULL AS kept FROM m WHERE ord = 0
  UNION ALL
  SELECT m.match, m.ord, CASE WHEN k THEN m.p ELSE prev END, k FROM (
    SELECT m.*, w.prev, m.p IS NOT NULL AND NOT coalesce(w.prev IS NOT NULL AND m.nxt IS NOT NULL AND w.prev <= m.nxt AND (m.p < w.prev OR m.p > m.nxt), FALSE) AS k
    FROM walk w JOIN m ON m.match = w.match AND m.ord = w.ord + 1) m)
SELECT match, ord, kept FROM walk"""

ORACLES: dict[str, str] = {
    "timeline_segments": f"WITH {HEARD} SELECT * FROM heard_seg WHERE heard <> '' OR context <> ''",
    "segment_plan": f"""WITH {VID} SELECT video_key, CAST(k AS INT) AS seg_id, k * 5::DOUBLE AS "start", least(k * 5::DOUBLE + 5, duration) AS "end"
      FROM vid, range(200) t(k) WHERE k * 5 < duration - 1e-6""",
    "frame_assignment": f"""WITH {VID}, f AS (SELECT video_key, k::DOUBLE AS t, ceil((duration - 1e-6) / 5) AS n FROM vid, range(200) x(k)
        WHERE k < greatest(1, floor(duration + 0.5)))
      SELECT video_key, CAST(least(floor(t / 5), n - 1) AS INT) AS seg_id, count(*) AS n_frames, min(t) AS first_t, max(t) AS last_t FROM f GROUP BY 1, 2""",
    "utterance_filter": f"""WITH {UTT}, sp AS (SELECT video_key, "start" - 0.125 AS b, "start" + 2 AS e FROM utterance WHERE text IN ('view', 'click')),
      u AS (SELECT video_key, utt_id, trim(CASE WHEN utt_id % 7 = 0 THEN ' ... ' ELSE text END) AS text, greatest(0, "start" + 0.0003::DOUBLE) AS b, least(360::DOUBLE, "end" + 0.0003::DOUBLE) AS e FROM utterance)
      SELECT u.video_key, utt_id, round_even(u.b, 2) AS "start", round_even(u.e, 2) AS "end", text FROM u LEFT JOIN sp ON sp.video_key = u.video_key AND sp.b < u.e AND sp.e > u.b
      WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') AND u.e > u.b GROUP BY u.video_key, utt_id, u.b, u.e, text
      HAVING coalesce(sum(greatest(0, least(u.e, sp.e) - greatest(u.b, sp.b))) FILTER (sp.b IS NOT NULL), 0) >= least(0.2, (u.e - u.b) / 2)""",
    "timeline_lines": f"""WITH {HEARD} SELECT video_key, string_agg(concat('[', {CLOCK.format(t='"start"')}, '–', {CLOCK.format(t='"end"')}, '] SEEN: ',
        coalesce(nullif(CASE WHEN seg_id % 3 = 0 THEN NULL ELSE context END, ''), '—'), ' | HEARD: ', heard), chr(10) ORDER BY seg_id) AS text
      FROM heard_seg WHERE heard <> '' GROUP BY 1""",
    "segments_described": f"WITH {SEEN} SELECT video_key, seg_id, heard, seen FROM seen",
    "summaries_described": f"""WITH {SEEN},
      lines AS (SELECT video_key, seg_id // 40 AS chunk, min("start") AS a, max("end") AS e, string_agg(concat('[', {CLOCK.format(t='"start"')}, '–', {CLOCK.format(t='"end"')}, '] SEEN: ', seen,
          CASE WHEN heard <> '' THEN concat(' | HEARD: ', heard) ELSE '' END), chr(10) ORDER BY seg_id) AS text FROM seen GROUP BY 1, 2),
      parts AS (SELECT video_key, chunk, concat('[', {CLOCK.format(t="a")}, '–', {CLOCK.format(t="e")}, '] ', length(concat('Summarize this part (', {CLOCK.format(t="a")}, '–', {CLOCK.format(t="e")}, '):', chr(10), text)), ' characters') AS line FROM lines)
      SELECT video_key, concat(length(concat('Summarize this timeline:', chr(10), string_agg(line, concat(chr(10), chr(10)) ORDER BY chunk))), ' characters') AS summary FROM parts GROUP BY 1""",
    "timeline_documents": f"WITH {HEARD} SELECT video_key, seg_id AS pos, seg_id, heard FROM heard_seg WHERE heard <> ''",
    "summary_chunks": f'WITH {SEG} SELECT video_key, CAST(seg_id // 40 AS INT) AS chunk, count(*) AS n, max("end") AS until FROM seg GROUP BY 1, 2',
    "model_plan": f"""WITH {VID}, a AS (SELECT *, least(1.0::DOUBLE, 640::DOUBLE / greatest(width, height)) AS s FROM vid),
      b AS (SELECT *, greatest(2, CAST(round_even(width * s / 2, 0) * 2 AS INT)) AS frame_w, greatest(2, CAST(round_even(height * s / 2, 0) * 2 AS INT)) AS frame_h FROM a),
      c AS (SELECT *, greatest(1, CAST(round_even(frame_h / 32, 0) AS INT)) * greatest(1, CAST(round_even(frame_w / 32, 0) AS INT)) AS image_tokens FROM b)
      SELECT video_key, CAST(greatest(1, floor(duration + 0.5)) AS INT) AS n_frames, CAST(greatest(0, ceil((duration - 1e-6) / 5)) AS INT) AS n_segments, frame_w, frame_h, image_tokens,
        5 * (image_tokens + 2) + 150 AS prompt_tokens, round_even(10.45 + 1.1 + (5 * (image_tokens + 2) + 150) * 0.22::DOUBLE / 1000, 4) AS peak_gb FROM c""",
    "talk_time": f"""WITH {UTT} SELECT video_key, round_even(sum("start" + 2 - ("start" - 0.125)), 3) AS seconds FROM utterance WHERE text IN ('view', 'click') GROUP BY 1""",
    "clock_text": f"SELECT o_orderkey, {CLOCK.format(t='(o_totalprice / 16)')} AS clock FROM orders",
    "answer_json": """WITH a AS (SELECT conv_id, turn, concat('<think>', role, ' ', chr(10), ' {', turn, '}</think> ok ',
        CASE WHEN turn % 5 = 4 THEN '{broken' ELSE concat('{"type": "', role, '", "n": ', turn, '}') END, ' </think>') AS t FROM conversations),
      c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '</?think>', '', 'g')) AS clean FROM a),
      j AS (SELECT *, TRY_CAST(nullif(regexp_extract(clean, '(?s)\\{.*\\}', 0), '') AS JSON) AS j FROM c)
      SELECT conv_id, turn, clean, CASE WHEN j->>'type' IN ('user', 'assistant') THEN j->>'type' ELSE 'other' END AS kind, CAST(j->>'n' AS INT) AS n FROM j""",
    "probe_fields": """WITH a AS (SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'N/A' ELSE props->>'k' END AS DOUBLE) AS k, value FROM (SELECT event_id, CAST(props AS JSON) AS props, value FROM events))
      SELECT event_id, coalesce(CASE WHEN k > 0 THEN k END, CASE WHEN value > 0 THEN value END) AS duration,
        CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'transpose=2' WHEN 2 THEN 'hflip,vflip' ELSE 'transpose=1' END AS turn FROM a""",
    "text_keys": "SELECT doc_id, concat(regexp_replace(concat(source, ' _é:', lang), '[^A-Za-z0-9.-]+', '_', 'g'), '-', substr(sha1(concat(source, ':', strlen(text), text)), 1, 12)) AS file_key FROM documents",
    "plain_names": "SELECT doc_id, upper(strip_accents(upper(replace(text, 'ß', 'ss')))) AS name FROM documents",
    "frame_signals": """WITH e AS (SELECT vec_id // 128 AS video_key, vec_id AS frame, [CAST(x AS DOUBLE) FOR x IN embedding] AS vec FROM embeddings),
      h AS (SELECT *, list_transform(vec, lambda x: abs(x) / t) AS hist FROM (SELECT *, list_sum(list_transform(vec, lambda x: abs(x))) AS t FROM e)),
      l AS (SELECT *, lag(hist) OVER w AS h0, lag(vec) OVER w AS v0 FROM h WINDOW w AS (PARTITION BY video_key ORDER BY frame))
      SELECT video_key, frame, round_even(coalesce(list_sum([abs(hist[i] - h0[i]) FOR i IN range(1, 65)]) / 2, 0), 6) AS dist,
        round_even(coalesce(list_sum([abs(vec[i] - v0[i]) FOR i IN range(1, 65)]) / 64, 0), 6) AS motion FROM l""",
    "jump_cuts": f"WITH {_cuts('jc')} SELECT video_key, unnest(cuts) AS cut FROM jc",
    "split_shots": f"WITH {_shots(True)} SELECT * FROM shots",
    "shot_motion": f"""WITH {_shots(False)}, mn AS (SELECT *, row_number() OVER (PARTITION BY video_key ORDER BY frame) - 1 AS i FROM ({MOTION}))
      SELECT s.video_key, shot_id, start_f, end_f, round_even(coalesce(avg(v), 0), 6) AS motion FROM shots s
      LEFT JOIN mn ON mn.video_key = s.video_key AND i > start_f AND i < end_f GROUP BY 1, 2, 3, 4""",
    "shot_keyframes": f"WITH {_shots(False)} SELECT video_key, shot_id, k, CAST(start_f + floor((end_f - start_f) * r) AS BIGINT) AS frame FROM shots, (VALUES (0, 0.2::DOUBLE), (1, 0.5), (2, 0.8)) t(k, r)",
    "track_gaps": f"WITH {PIECES} SELECT shot_id, slot, frame, piece, round_even(x, 6) AS x, round_even(y, 6) AS y FROM pieces",
    "track_median": f"""WITH {PIECES}, m AS (SELECT *, count(*) OVER (PARTITION BY shot_id, slot, piece) AS n,
        list_sort([coalesce(lag(x, 2) OVER w, 0), coalesce(lag(x) OVER w, 0), x, coalesce(lead(x) OVER w, 0), coalesce(lead(x, 2) OVER w, 0)])[3] AS mx,
        list_sort([coalesce(lag(y, 2) OVER w, 0), coalesce(lag(y) OVER w, 0), y, coalesce(lead(y) OVER w, 0), coalesce(lead(y, 2) OVER w, 0)])[3] AS my
        FROM pieces WINDOW w AS (PARTITION BY shot_id, slot, piece ORDER BY frame))
      SELECT shot_id, slot, frame, round_even(CASE WHEN n >= 9 THEN mx ELSE x END, 6) AS x, round_even(CASE WHEN n >= 9 THEN my ELSE y END, 6) AS y FROM m""",
    "track_smooth": f"WITH {SMOOTH} SELECT shot_id, slot, frame, round_even(x, 6) AS x, round_even(y, 6) AS y FROM smooth",
    "player_stats": f"""WITH {SMOOTH}, s AS (SELECT slot, abs(y - 10) AS depth,
        sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM smooth WINDOW w AS (PARTITION BY shot_id, slot, piece ORDER BY frame)),
      a AS (SELECT slot, count(*) AS frames, coalesce(sum(d), 0) AS d, count(*) FILTER (depth < 4) AS net, count(*) FILTER (depth >= 4 AND depth < 6.95) AS mid,
        count(*) FILTER (depth >= 6.95) AS back FROM s GROUP BY 1)
      SELECT slot, frames, round_even(frames / 30, 1) AS seconds, round_even(d, 1) AS distance_m, round_even(d / greatest(frames / 30, 1e-6), 2) AS speed_m_s,
        round_even(net / frames, 3) AS net_share, round_even(mid / frames, 3) AS transition_share, round_even(back / frames, 3) AS back_share FROM a""",
    "player_heatmap": f"""WITH {SMOOTH}, p AS (SELECT *, row_number() OVER (PARTITION BY shot_id, slot, piece ORDER BY frame) - 1 AS k FROM smooth),
      q AS (SELECT slot, round_even(CASE WHEN slot < 2 THEN 10 - x ELSE x END, 6) AS a, round_even(abs(y - 10), 6) AS b FROM p WHERE k % 3 = 0)
      SELECT slot, CAST(least(19, floor(a * 20 / 10)) AS INT) AS bin_x, CAST(least(19, floor(b * 20 / 10)) AS INT) AS bin_y, count(*) AS n
      FROM q WHERE a BETWEEN 0 AND 10 AND b BETWEEN 0 AND 10 GROUP BY 1, 2, 3""",
    "slot_presence": f"WITH {TRACK} SELECT shot_id, slot, round_even(avg(CASE WHEN x IS NULL THEN 0 ELSE 1 END), 6) AS presence FROM track GROUP BY 1, 2",
    "slot_roles": f"""WITH {TRACK}, m AS (SELECT shot_id, slot, avg(x) AS m FROM track GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY shot_id, slot // 2 ORDER BY CASE WHEN c = n THEN m END NULLS FIRST, slot) AS r FROM
        (SELECT *, count(m) OVER (PARTITION BY shot_id, slot // 2) AS c, count(*) OVER (PARTITION BY shot_id, slot // 2) AS n FROM m))
      SELECT shot_id, slot, CASE WHEN (r = 1) = (slot < 2) THEN 'right' ELSE 'left' END AS role FROM k""",
    "speed_peaks": """WITH s AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS v FROM events),
      f AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY i) AS level FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY key ORDER BY i) THEN 0 ELSE 1 END AS new FROM s)),
      g AS (SELECT key, level, any_value(v) AS v, (min(i) + max(i)) // 2 AS i FROM f GROUP BY 1, 2),
      p AS (SELECT * FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM g WINDOW w AS (PARTITION BY key ORDER BY level)) WHERE v > a AND v > b AND v >= 100),
      l AS (SELECT key, list(CAST(i AS BIGINT) ORDER BY v DESC, i DESC) AS l FROM p GROUP BY 1)
      SELECT key, unnest(list_reduce(l[2:], lambda k, c: CASE WHEN len(list_filter(k, lambda o: abs(o - c) < 4)) = 0 THEN list_append(k, c) ELSE k END, [l[1]])) AS i FROM l""",
    "hit_sequence": f"""WITH RECURSIVE c AS (
  SELECT user_id AS video_key, event_id AS cand, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS DOUBLE) / 72000 AS t,
    CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) % 8 ELSE 1 END::DOUBLE AS s0,
    CASE WHEN event_id % 2 = 0 THEN 1 ELSE CAST(floor(value) AS BIGINT) % 8 END::DOUBLE AS s1 FROM events),
{VITERBI} SELECT video_key, cand, team FROM chosen""",
    "hits_detected": f"""WITH RECURSIVE SPEEDS
      sp AS (SELECT shot_id, slot, frame - 1 AS frame, speed, speed / greatest(coalesce(med, 1), 1e-3) AS ratio, CASE WHEN r > l THEN 1 ELSE 0 END AS arm FROM m),
      sounds AS (SELECT o_orderkey // 400 AS shot_id, o_orderkey % 400 / 40 AS t FROM orders WHERE o_orderkey // 400 % 3 > 0),
      heard AS (SELECT shot_id FROM sounds GROUP BY 1 HAVING count(*) > 1),
      fastest AS (SELECT shot_id, frame, max(ratio) AS v FROM sp WHERE shot_id NOT IN (FROM heard) GROUP BY 1, 2),
      flat AS (SELECT *, sum(new) OVER (PARTITION BY shot_id ORDER BY frame) AS level FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY shot_id ORDER BY frame) THEN 0 ELSE 1 END AS new FROM fastest)),
      top AS (SELECT shot_id, level, any_value(v) AS v, (min(frame) + max(frame)) // 2 AS i FROM flat GROUP BY 1, 2),
      peak AS (SELECT * FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM top WINDOW w AS (PARTITION BY shot_id ORDER BY level)) WHERE v > a AND v > b AND v >= 3),
      crowd AS (SELECT shot_id, list(CAST(i AS BIGINT) ORDER BY v DESC, i DESC) AS l FROM peak GROUP BY 1),
      silent AS (SELECT shot_id, unnest(list_reduce(l[2:], lambda k, c: CASE WHEN len(list_filter(k, lambda o: abs(o - c) < 13)) = 0 THEN list_append(k, c) ELSE k END, [l[1]])) AS i FROM crowd),
      cands AS (SELECT shot_id, t, 'audio+pose' AS source FROM sounds WHERE shot_id IN (FROM heard) UNION ALL SELECT shot_id, i / 30, 'pose' FROM silent),
      best AS (SELECT c.shot_id, c.t, CASE WHEN slot < 2 THEN 0 ELSE 1 END AS team, slot, frame, ratio, speed, arm FROM cands c
        JOIN sp ON sp.shot_id = c.shot_id AND frame BETWEEN greatest(0, trunc((t - 0.2) * 30)) AND trunc((t + 0.1) * 30)
        QUALIFY row_number() OVER (PARTITION BY c.shot_id, c.t, slot < 2 ORDER BY ratio DESC, slot, frame) = 1),
      c AS (SELECT shot_id AS video_key, t AS cand, t, coalesce(max(ratio) FILTER (team = 0), 0) AS s0, coalesce(max(ratio) FILTER (team = 1), 0) AS s1 FROM best GROUP BY 1, 2),
      {VITERBI}, {TRACK},
      hit AS (SELECT b.*, source FROM chosen JOIN best b ON b.shot_id = video_key AND b.t = cand AND b.team = chosen.team JOIN cands s ON s.shot_id = b.shot_id AND s.t = b.t),
      near AS (SELECT h.shot_id, h.slot, h.frame, p.x, p.y FROM (SELECT DISTINCT shot_id, slot, frame FROM hit) h JOIN track p ON p.shot_id = h.shot_id AND p.slot = h.slot AND p.x IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY h.shot_id, h.slot, h.frame ORDER BY abs(p.frame - h.frame), p.frame) = 1)
      SELECT shot_id, round_even(shot_id * 20 + t, 3) AS t, frame, slot, CASE WHEN team = 0 THEN 'far' ELSE 'near' END AS side, round_even(x, 2) AS x, round_even(y, 2) AS y, round_even(abs(y - 10), 2) AS dist_net,
        round_even(speed, 3) AS speed, round_even(ratio, 2) AS evidence, CASE WHEN arm = 1 THEN 'right' ELSE 'left' END AS arm, source FROM hit JOIN near USING (shot_id, slot, frame)""",
    "nearest_positions": f"""WITH {TRACK}, c AS (SELECT a.shot_id, a.slot, a.frame, b.x, b.y, row_number() OVER (PARTITION BY a.shot_id, a.slot, a.frame ORDER BY abs(b.frame - a.frame), b.frame) AS r
        FROM track a JOIN track b ON b.shot_id = a.shot_id AND b.slot = a.slot AND b.x IS NOT NULL WHERE a.x IS NULL)
      SELECT shot_id, slot, frame, round_even(x, 6) AS x, round_even(y, 6) AS y FROM c WHERE r = 1""",
    "strongest_slots": """WITH s AS (SELECT l_orderkey // 400 AS shot_id, CAST(l_linenumber % 4 AS INT) AS slot, l_partkey % 300 AS frame, max(l_quantity) AS speed FROM lineitem GROUP BY 1, 2, 3),
      c AS (SELECT o_orderkey // 400 AS shot_id, o_orderkey AS cand, (o_custkey % 80) / 8::DOUBLE AS t FROM orders),
      j AS (SELECT c.shot_id, cand, CASE WHEN slot < 2 THEN 0 ELSE 1 END AS team, slot, frame, speed, row_number() OVER (PARTITION BY c.shot_id, cand, slot < 2 ORDER BY speed DESC, slot, frame) AS r
        FROM c JOIN s ON s.shot_id = c.shot_id AND frame BETWEEN greatest(0, trunc((t - 0.2) * 30)) AND trunc((t + 0.1) * 30))
      SELECT shot_id, cand, team, slot, frame, speed FROM j WHERE r = 1""",
    "stroke_rules": f"WITH {HITS} SELECT hit_id, n, stroke, confidence FROM ruled",
    "strokes_allowed": f"WITH {HITS} SELECT hit_id, n, array_to_string(allowed, ',') AS allowed, CASE WHEN dist < 4 THEN 'net' WHEN dist < 6.95 THEN 'transition' ELSE 'back' END AS zone FROM allowed",
    "strokes_refined": f"""WITH {HITS} SELECT hit_id, n, CASE WHEN coalesce(list_contains(allowed, answer), FALSE) THEN answer WHEN list_contains(allowed, stroke) THEN stroke ELSE allowed[1] END AS stroke,
        CAST(CASE WHEN coalesce(list_contains(allowed, answer), FALSE) THEN CASE WHEN answer = stroke THEN 0.8 ELSE 0.6 END ELSE confidence END AS DOUBLE) AS confidence,
        CASE WHEN list_contains(names, answer) THEN answer END AS stroke_model
      FROM allowed WHERE NOT (coalesce(NOT swing, FALSE) AND evidence < 6)""",
    "strokes_reconciled": f"WITH {HITS} SELECT hit_id, n, CASE WHEN coalesce(list_contains(allowed, answer), FALSE) THEN answer ELSE stroke END AS stroke FROM allowed",
    "strokes_classified": f"""WITH {HITS}, l AS (SELECT *, CASE CAST(trunc(dist) AS INT) % 4 WHEN 0 THEN 'pas_une_frappe' WHEN 1 THEN 'bandeja_vibora' WHEN 2 THEN 'lob' END AS label, speed * 2 AS prob FROM ruled)
      SELECT hit_id, n, CASE WHEN label IS NULL OR label = 'pas_une_frappe' THEN stroke WHEN label = 'bandeja_vibora' THEN 'vibora' ELSE label END AS stroke,
        round_even(CASE WHEN label IS NULL OR label = 'pas_une_frappe' THEN confidence ELSE prob END, 6) AS confidence
      FROM l WHERE NOT coalesce(label = 'pas_une_frappe' AND prob >= 0.7, FALSE)""",
    "stroke_counts": f"""WITH {HITS} SELECT n AS player, CASE WHEN stroke IN ('bandeja', 'vibora') THEN 'bandeja_vibora' WHEN stroke IN ('service', 'coup_droit', 'smash', 'volee_cd') THEN stroke ELSE '?' END AS stroke,
        count(*) AS n FROM ruled GROUP BY 1, 2""",
    "score_readings": """WITH a AS (SELECT o_orderkey, upper(trim(concat(' t', o_custkey % 3))) AS t0, CAST(o_orderkey % 7 AS INT) AS a0, o_orderkey % 11 = 0 AS bad, o_orderkey % 13 = 0 AS short, CAST(o_custkey % 7 AS INT) AS b1 FROM orders)
      SELECT o_orderkey, CASE WHEN NOT bad AND NOT short THEN concat(t0, '|B') END AS teams, CASE WHEN NOT bad AND NOT short THEN concat(a0, '-3|2-', b1) END AS games,
        CASE WHEN NOT bad AND NOT short THEN 'AD|40' END AS points FROM a""",
    "score_clean": _CLEAN.format(state=STATE),
    "point_winners": f"""WITH {STATE}, n AS (SELECT *, {', '.join(f'lead({c}, {k}) OVER w AS {c}_{k}' for k in (1, 2) for c in ('g0', 'g1', 'p0', 'p1'))}
        FROM state WINDOW w AS (PARTITION BY match ORDER BY ord)) SELECT match, ord, CAST(coalesce({_winner('_1')}, {_winner('_2')}) AS INT) AS winner FROM n""",
    "score_stories": f"""WITH {STATE}, l AS (SELECT *, row_number() OVER (PARTITION BY match ORDER BY ord DESC) AS r, g0 = 6 AND g1 = 6 AS tb FROM vstate WHERE ok)
      SELECT match, concat('A vs B — set 1: ', g0, '-', g1, ' (', CASE WHEN tb THEN 'tie-break ' ELSE 'game ' END, p0, '-', p1, ')') AS line,
        CASE WHEN tb THEN concat('Set 1 at 6-6, tie-break: ', p0, '-', p1, CASE WHEN CAST(p0 AS INT) > CAST(p1 AS INT) THEN ' (A leads)' WHEN CAST(p1 AS INT) > CAST(p0 AS INT) THEN ' (B leads)' ELSE '' END, '.')
          ELSE concat('Set 1 under way: ', g0, '-', g1, CASE WHEN g0 > g1 THEN ' (A leads)' WHEN g1 > g0 THEN ' (B leads)' ELSE '' END, '.') END AS story
      FROM l WHERE r = 1""",
    "label_upsert": """WITH s AS (SELECT source AS video, doc_id AS key, lang AS label FROM documents WHERE doc_id % 3 <> 0),
      f AS (SELECT source AS video, doc_id AS key, 'en' AS label FROM documents WHERE doc_id % 8 = 0)
      SELECT video, key, coalesce(f.label, s.label) AS label FROM s FULL JOIN f USING (video, key)""",
    "labels_open": "SELECT source AS video, count(*) AS n, max(doc_id) AS last FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0) GROUP BY 1",
    "label_accuracy": f"""WITH {LAB} SELECT answer, count(v) AS n, round_even(coalesce(avg(CASE WHEN v IS NULL THEN NULL WHEN v = truth THEN 1 ELSE 0 END), 0), 6) AS accuracy
      FROM (SELECT truth, 'pred' AS answer, pred AS v FROM lab UNION ALL SELECT truth, 'vlm', vlm FROM lab UNION ALL SELECT truth, 'pose', pose FROM lab) GROUP BY 1""",
    "label_confusion": f"""WITH {LAB}, c(k) AS (VALUES ('c0'), ('c1'), ('c2'))
      SELECT a.k AS truth, b.k AS pred, count(lab.key) AS n FROM c a CROSS JOIN c b LEFT JOIN lab ON truth = a.k AND pred = b.k GROUP BY 1, 2""",
    "label_held_out": f"""WITH {LAB}, b AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY video) AS size FROM lab) WHERE size >= 15)
      SELECT coalesce(video, '(all)') AS video, count(*) AS n, round_even(avg(CASE WHEN pred = truth THEN 1 ELSE 0 END), 6) AS accuracy,
        count(*) FILTER (truth = 'c0' AND pred = 'c0') AS false_rejected, count(*) FILTER (truth = 'c0') AS false_hits,
        count(*) FILTER (truth <> 'c0' AND pred = 'c0') AS real_lost, count(*) FILTER (truth <> 'c0') AS real_hits,
        round_even(avg(CASE WHEN truth <> 'c0' THEN CASE WHEN pred = truth THEN 1 ELSE 0 END END), 6) AS stroke_accuracy
      FROM b GROUP BY ROLLUP (video) HAVING count(*) > 0""",
    "label_folds": f"""WITH {LAB}, k AS (SELECT greatest(2, least(5, min(n))) AS k FROM (SELECT count(*) AS n FROM lab GROUP BY truth))
      SELECT key, CAST((row_number() OVER (PARTITION BY truth ORDER BY md5(CAST(key AS VARCHAR)), key) - 1) % k AS INT) AS fold FROM lab, k""",
    "label_selection": f"""WITH {LAB}, a AS (SELECT video, key, pred AS stroke, key % 17 / 17 AS prob, md5(CAST(key AS VARCHAR)) AS h, {", ".join(
        f"['bandeja', 'vibora', 'lob', 'smash', '', 'incertain'][{x} % 6 + 1] AS {c}" for c, x in (("pose", "key"), ("vlm", "(key // 6)"), ("clf", "(key // 36)")))}
        FROM lab WHERE key % 11 <> 0),
      m AS (SELECT *, {", ".join(f"CASE {c} WHEN 'bandeja' THEN 'bv' WHEN 'vibora' THEN 'bv' WHEN 'incertain' THEN NULL ELSE {c} END AS m_{c}" for c in ("pose", "vlm", "clf"))} FROM a),
      t AS (SELECT *, CASE WHEN clf <> '' THEN prob ELSE 1 END AS sure,
        pose <> '' AND ((vlm <> '' AND m_vlm IS DISTINCT FROM m_pose) OR (clf <> '' AND m_clf IS DISTINCT FROM m_pose)) AS differs FROM m),
      f AS (SELECT 0 AS part, row_number() OVER (ORDER BY sure, h, video, key) AS turn, stroke, video, key, h FROM t WHERE differs QUALIFY turn <= 20),
      r AS (SELECT 1 AS part, row_number() OVER (PARTITION BY stroke ORDER BY h, video, key) AS turn, stroke, video, key, h FROM t WHERE NOT differs)
      SELECT CAST(part AS INT) AS part, stroke, video, key FROM (SELECT * FROM f UNION ALL SELECT * FROM r) ORDER BY part, turn, stroke, h, video, key LIMIT 40""",
    "colour_clusters": """WITH RECURSIVE p AS (SELECT p_partkey % 9 AS match, CAST(p_partkey * 7 % 256 AS DOUBLE) AS r, CAST(p_partkey * 13 % 256 AS DOUBLE) AS g, CAST(p_size * 5 AS DOUBLE) AS b FROM part),
      lo AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY match ORDER BY r + g + b, r, g, b) = 1), hi AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY match ORDER BY r + g + b DESC, r DESC, g DESC, b DESC) = 1),
      c AS (SELECT 0 AS k, match, lo.r AS r0, lo.g AS g0, lo.b AS b0, hi.r AS r1, hi.g AS g1, hi.b AS b1 FROM lo JOIN hi USING (match)
        UNION ALL
        SELECT k + 1, match, avg(r) FILTER (NOT one), avg(g) FILTER (NOT one), avg(b) FILTER (NOT one), avg(r) FILTER (one), avg(g) FILTER (one), avg(b) FILTER (one)
        FROM (SELECT k, p.*, sqrt((r - r0) ** 2 + (g - g0) ** 2 + (b - b0) ** 2) > sqrt((r - r1) ** 2 + (g - g1) ** 2 + (b - b1) ** 2) AS one FROM c JOIN p USING (match) WHERE k < 10) GROUP BY k, match)
      SELECT match, round_even(r0, 4) AS c0_r, round_even(g0, 4) AS c0_g, round_even(b0, 4) AS c0_b, round_even(r1, 4) AS c1_r, round_even(g1, 4) AS c1_g, round_even(b1, 4) AS c1_b FROM c WHERE k = 10""",
    "pixel_signals": """WITH f AS (SELECT vec_id // 128 AS video_key, vec_id AS frame, [CAST(least(255, greatest(0, floor(CAST(x AS DOUBLE) * 400 + 128))) AS INT) FOR x IN embedding[1:63]] AS p FROM embeddings),
      c AS (SELECT video_key, frame, unnest([(p[3 * i + 1] >> 5) * 64 + (p[3 * i + 2] >> 5) * 8 + (p[3 * i + 3] >> 5) FOR i IN range(21)]) AS c FROM f),
      h AS (SELECT video_key, frame, c, count(*) / 21 AS n FROM c GROUP BY 1, 2, 3),
      d AS (SELECT video_key, frame, sum(abs(n)) / 2 AS dist FROM (SELECT video_key, frame, c, sum(n) AS n FROM (SELECT * FROM h UNION ALL SELECT video_key, frame + 1, c, -n FROM h) GROUP BY 1, 2, 3) GROUP BY 1, 2),
      g AS (SELECT video_key, frame, [(p[3 * i + 1] + p[3 * i + 2] + p[3 * i + 3]) / 3 FOR i IN range(21)] AS g FROM f)
      SELECT CAST(a.video_key AS VARCHAR) AS video_key, a.frame, round_even(CASE WHEN b.frame IS NULL THEN 0 ELSE dist END, 6) AS dist,
        round_even(coalesce(list_sum([abs(a.g[i + 1] - b.g[i + 1]) FOR i IN range(21)]) / 21, 0), 6) AS motion
      FROM g a LEFT JOIN g b ON b.video_key = a.video_key AND b.frame = a.frame - 1 JOIN d ON d.video_key = a.video_key AND d.frame = a.frame""",
    "court_points": """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity * 20 AS px, l_discount * 3000 AS py FROM lineitem),
      q AS (SELECT *, 0.00001::DOUBLE * px + 0.0004::DOUBLE * py + 1 AS w FROM p),
      c AS (SELECT *, (0.02::DOUBLE * px + 0.001::DOUBLE * py - 3) / w AS x, (0.0005::DOUBLE * px + 0.03::DOUBLE * py - 1) / w AS y FROM q)
      SELECT l_orderkey, l_linenumber, round_even(x, 6) AS x, round_even(y, 6) AS y, round_even(px, 3) AS px, round_even(py, 3) AS py, x BETWEEN -0.6 AND 10.6 AND y BETWEEN -0.6 AND 20.6 AS inside FROM c""",
    "label_weights": f"WITH {LAB}, n AS (SELECT truth, count(*) AS n FROM lab GROUP BY 1) SELECT truth, n, round_even((SELECT sum(n) FROM n) / n / (SELECT count(*) FROM n), 6) AS weight FROM n",
    "hit_precision": f"WITH {LAB} SELECT count(*) AS n, round_even(count(*) FILTER (truth <> 'c0') / count(*), 6) AS precision FROM lab",
    "label_references": f"""WITH {LAB}, l AS (SELECT video, key, ['incertain', 'pas_une_frappe', 'lob', 'smash', 'service'][key % 5 + 1] AS label, CASE WHEN key % 2 = 0 THEN 'model' ELSE 'user' END AS annotator FROM lab)
      SELECT label, video, key, annotator FROM l WHERE label NOT IN ('incertain', 'pas_une_frappe') QUALIFY row_number() OVER (PARTITION BY label ORDER BY annotator DESC, video, key) = 1""",
    "colour_words": f"""WITH {PALETTE}, p AS (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b FROM part)
      SELECT p_partkey, w AS colour FROM (SELECT p_partkey, w, row_number() OVER (PARTITION BY p_partkey ORDER BY (p.r - c.r) ** 2 + (p.g - c.g) ** 2 + (p.b - c.b) ** 2, c.i) AS k FROM p, palette c) WHERE k = 1""",
    "team_votes": """WITH s AS (SELECT n_nationkey AS obs_id, CASE WHEN n_nationkey % 2 = 0 THEN concat('X ', n_name) ELSE concat('DE', n_name) END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'rouge' ELSE 'bleu' END AS colour FROM nation),
      p AS (SELECT DISTINCT n_name AS team, unnest(regexp_split_to_array(n_name, '[ /\\-]+')) AS part FROM nation),
      m AS (SELECT DISTINCT team, obs_id, colour FROM p JOIN s ON length(part) >= 4 AND (list_contains(string_split(name, ' '), part) OR name LIKE '%' || part))
      SELECT team, colour, count(*) AS votes FROM m GROUP BY 1, 2""",
    "court_line_rows": """WITH s AS (SELECT l_orderkey // 500 AS video_key, l_quantity * 10 AS x1, (l_partkey % 500)::DOUBLE AS y1, l_quantity * 10 + l_suppkey % 90 + 1 AS x2, (l_partkey % 500 + l_suppkey % 4)::DOUBLE AS y2 FROM lineitem),
      l AS (SELECT *, (y1 + y2) / 2 AS mid, 200 + video_key % 100 AS v FROM s WHERE abs(degrees(atan2(y2 - y1, x2 - x1))) < 4),
      b AS (SELECT video_key, round_even(mid / 4, 0) AS bin, v, sum(abs(x2 - x1)) AS total, median(mid) AS row FROM l WHERE mid BETWEEN 150 AND 350 GROUP BY 1, 2, 3)
      SELECT video_key, row, round_even(total, 4) AS total FROM b QUALIFY row_number() OVER (PARTITION BY video_key ORDER BY round_even(total, 6) DESC, abs(bin * 4 - v), bin) = 1""",
    "court_maps": """WITH q AS (SELECT p_partkey, (400 + p_partkey % 61)::DOUBLE AS x0, (200 + p_size % 7)::DOUBLE AS y0, (880 - p_partkey % 53)::DOUBLE AS x1, (203 + p_partkey % 5)::DOUBLE AS y1,
        (1150 + p_size)::DOUBLE AS x2, (600 + p_partkey % 37)::DOUBLE AS y2, (130 - p_size)::DOUBLE AS x3, (590 + p_partkey % 41)::DOUBLE AS y3, (500 + p_partkey % 211)::DOUBLE AS px, (300 + p_partkey % 97)::DOUBLE AS py FROM part),
      -- Weights of the corners: the cofactors of the three others (a, b, c) in homogeneous form, which make the fourth their sum.
      w AS (SELECT *, x0 * (y1 - y2) - x1 * (y0 - y2) + x2 * (y0 - y1) AS det, (x3 * (y1 - y2) - x1 * (y3 - y2) + x2 * (y3 - y1)) AS a, (x0 * (y3 - y2) - x3 * (y0 - y2) + x2 * (y0 - y3)) AS b, (x0 * (y1 - y3) - x1 * (y0 - y3) + x3 * (y0 - y1)) AS c FROM q),
      -- A point in this frame, then in that of the corners (0, 3.05), (10, 3.05), (10, 16.95) and (0, 16.95), where the fourth is the first less the second plus the third.
      f AS (SELECT *, (px * (y1 - y2) - x1 * (py - y2) + x2 * (py - y1)) / a AS u, (x0 * (py - y2) - px * (y0 - y2) + x2 * (y0 - py)) / b AS v, (x0 * (y1 - py) - x1 * (y0 - py) + px * (y0 - y1)) / c AS t FROM w),
      m AS (SELECT *, (10 * -v + 10 * t) / (u - v + t) AS x, (3.05::DOUBLE * (u - v) + 16.95::DOUBLE * t) / (u - v + t) AS y FROM f),
      -- The near right corner of the court, (10, 20), is 0 * first + (16.95 - 20) / 13.9 * second + (20 - 3.05) / 13.9 * third; back with the weights.
      n AS (SELECT *, -((16.95::DOUBLE - 20) / 13.9::DOUBLE) * b AS k1, ((20 - 3.05::DOUBLE) / 13.9::DOUBLE) * c AS k2 FROM m)
      SELECT p_partkey, round_even(x, 6) AS x, round_even(y, 6) AS y, px, py, round_even((k1 * x1 + k2 * x2) / (k1 + k2), 4) AS near_x, round_even((k1 * y1 + k2 * y2) / (k1 + k2), 4) AS near_y FROM n""",
    "longest_shots": f"""WITH {SHOT} SELECT video_key, shot_id, duration, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_key ORDER BY duration DESC, shot_id) AS r FROM shot) WHERE r <= 6""",
    "calibration_times": f"""WITH {SHOT}, k AS (SELECT *, least(8, greatest(1, floor(duration / 60))) AS k FROM shot)
      SELECT video_key, shot_id, CAST(i AS INT) AS i, round_even("start" + (i + 0.5) * duration / k, 6) AS t FROM k, range(8) t(i) WHERE i < k""",
    "overlay_replays": f"""WITH {SHOT} SELECT video_key, shot_id, replay OR (kind = 'main' AND NOT scoreboard AND coalesce(avg(CASE WHEN kind = 'main' THEN CASE WHEN scoreboard THEN 1 ELSE 0 END END)
        OVER (PARTITION BY video_key) >= 0.7, FALSE)) AS replay FROM shot""",
    "overlay_times": f"""WITH {SHOT}, r AS (SELECT *, "start" + 5 AS fin, coalesce(lead("start") OVER (PARTITION BY video_key ORDER BY "start", shot_id), 1e9) AS until FROM shot WHERE kind = 'main'),
      o AS (SELECT r.video_key, r.shot_id, max_by(s."start" + 5, s."start") AS o_end FROM r JOIN shot s ON s.video_key = r.video_key AND s.kind <> 'main' AND s."start" >= r.fin AND s."start" < r.until GROUP BY 1, 2)
      SELECT r.video_key, r.shot_id, round_even(coalesce(o_end, fin) - 0.4, 3) AS t FROM r LEFT JOIN o USING (video_key, shot_id)""",
    "window_counts": """SELECT user_id AS video_key, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS "start", CAST(floor(epoch(ts) / 3600) * 3600 + 3600 AS BIGINT) AS "end",
        count(*) AS n, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS texts FROM events GROUP BY 1, 2, 3""",
    "rally_sessions": """WITH g AS (SELECT user_id AS video_key, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 21600 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY video_key ORDER BY ts) AS k FROM g)
      SELECT video_key, CAST(floor(epoch(min(ts))) AS BIGINT) AS "start", CAST(floor(epoch(max(ts)) + 21600) AS BIGINT) AS "end", count(*) AS n FROM s GROUP BY video_key, k""",
    "wrist_speeds": """WITH p AS (SELECT l_orderkey // 400 AS shot_id, CAST(l_linenumber % 4 AS INT) AS slot, row_number() OVER w AS frame, l_quantity AS lx, l_discount * 100 AS ly, l_tax * 10 AS lc,
        CAST(l_partkey % 97 AS DOUBLE) AS rx, CAST(l_suppkey % 53 AS DOUBLE) AS ry, l_discount * 8 AS rc, l_quantity * 4 AS height FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey // 400, l_linenumber % 4 ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice)),
      d AS (SELECT *, coalesce(CASE WHEN lc >= 0.3 AND lag(lc) OVER w >= 0.3 AND height >= 20 THEN sqrt(pow(lx - lag(lx) OVER w, 2) + pow(ly - lag(ly) OVER w, 2)) / height END, 0) AS l,
        coalesce(CASE WHEN rc >= 0.3 AND lag(rc) OVER w >= 0.3 AND height >= 20 THEN sqrt(pow(rx - lag(rx) OVER w, 2) + pow(ry - lag(ry) OVER w, 2)) / height END, 0) AS r
        FROM p WINDOW w AS (PARTITION BY shot_id, slot ORDER BY frame)),
      s AS (SELECT *, greatest(l, r) AS v FROM d),
      t AS (SELECT *, CASE WHEN frame = 1 THEN 0 ELSE list_sort([CASE WHEN frame = 2 THEN 0 ELSE lag(v) OVER w END, v, coalesce(lead(v) OVER w, 0)])[2] END AS speed FROM s WINDOW w AS (PARTITION BY shot_id, slot ORDER BY frame)),
      m AS (SELECT *, median(CASE WHEN speed > 0 THEN speed END) OVER (PARTITION BY shot_id, slot) AS med FROM t)
      SELECT shot_id, slot, frame, round_even(speed, 6) AS speed, round_even(speed / greatest(coalesce(med, 1), 1e-3), 5) AS ratio, CASE WHEN r > l THEN 1 ELSE 0 END AS arm FROM m""",
    "hit_boxes": """WITH k AS (SELECT p_partkey AS key, k, (p_size * (k + 1))::DOUBLE AS x, (p_partkey * (k + 3) % 91)::DOUBLE AS y, (p_partkey * (k + 1) % 10) / 10 AS c
        FROM part, range(17) t(k)),
      b AS (SELECT key, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, greatest(max(x) - min(x), max(y) - min(y)) * 1.1::DOUBLE AS side FROM k WHERE c > 0.3::DOUBLE GROUP BY 1 HAVING count(*) >= 3),
      f AS (SELECT key, coalesce(avg(x) FILTER (c > 0.4::DOUBLE), -1) AS foot_x, coalesce(avg(y) FILTER (c > 0.4::DOUBLE), -2) AS foot_y FROM k WHERE k >= 15 GROUP BY 1)
      SELECT key, round_even(cx, 6) AS cx, round_even(cy, 6) AS cy, round_even(side, 6) AS side, round_even(foot_x, 6) AS foot_x, round_even(foot_y, 6) AS foot_y FROM b JOIN f USING (key)""",
    "shirt_colours": """WITH m AS (SELECT l_orderkey // 400 AS shot_id, l_linenumber % 4 AS slot, median((l_partkey * 7 % 256)::DOUBLE) AS r, median((l_suppkey * 13 % 256)::DOUBLE) AS g, median(l_quantity) AS b FROM lineitem GROUP BY 1, 2)
      SELECT shot_id, CASE WHEN slot < 2 THEN 'far' ELSE 'near' END AS side, round_even(avg(r), 6) AS r, round_even(avg(g), 6) AS g, round_even(avg(b), 6) AS b FROM m GROUP BY 1, 2""",
    "camera_angles": """WITH e AS (SELECT vec_id // 128 AS video_key, vec_id // 4 AS shot_id, vec_id % 4 AS k, unnest(range(64)) AS pos, unnest([CAST(x AS DOUBLE) FOR x IN embedding]) AS v FROM embeddings),
      s AS (SELECT DISTINCT vec_id // 128 AS video_key, vec_id // 4 AS shot_id, vec_id // 4 * 7 % 13 * 1.5 AS duration, CASE WHEN vec_id // 4 % 3 > 0 THEN 'main' ELSE 'other' END AS kind FROM embeddings),
      z AS (SELECT video_key, shot_id, k, pos, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6) AS z FROM e WINDOW w AS (PARTITION BY shot_id, k)),
      b AS (SELECT video_key, shot_id FROM s WHERE kind = 'main' QUALIFY row_number() OVER (PARTITION BY video_key ORDER BY duration DESC, shot_id) <= 8),
      r AS (SELECT video_key, pos, median(z) AS ref FROM z JOIN b USING (video_key, shot_id) WHERE k = 1 GROUP BY 1, 2 HAVING count(*) >= 2),
      c AS (SELECT video_key, shot_id, k, sum(z * ref) / 64 AS corr FROM z JOIN r USING (video_key, pos) JOIN s USING (video_key, shot_id) WHERE kind = 'main' GROUP BY 1, 2, 3)
      SELECT video_key, shot_id, round_even(max(corr), 5) AS corr, CASE WHEN max(corr) >= 0.2 THEN 'main' ELSE 'other_angle' END AS kind FROM c GROUP BY 1, 2""",
    "net_widths": """WITH s AS (SELECT l_orderkey // 500 AS video_key, l_quantity * 10 AS x1, (l_partkey % 500)::DOUBLE AS y1, l_quantity * 10 + l_suppkey % 90 + 1 AS x2, (l_partkey % 500 + l_suppkey % 4)::DOUBLE AS y2 FROM lineitem),
      b AS (SELECT video_key, CAST(round_even((y1 + y2) / 20, 0) AS INT) AS bin, sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS total, max(greatest(x1, x2)) - min(least(x1, x2)) AS width FROM s GROUP BY 1, 2)
      SELECT video_key, bin, width FROM (SELECT *, row_number() OVER (PARTITION BY video_key ORDER BY round(total, 6) DESC, bin DESC) AS r FROM b) WHERE r = 1""",
    "row_extents": """WITH s AS (SELECT l_orderkey // 500 AS video_key, l_quantity * 10 AS x1, (l_partkey % 500)::DOUBLE AS y1, l_quantity * 10 + l_suppkey % 90 + 1 AS x2, (l_partkey % 500 + l_suppkey % 4)::DOUBLE AS y2 FROM lineitem)
      SELECT video_key, min(least(x1, x2)) AS "left", max(greatest(x1, x2)) AS "right" FROM s WHERE abs(degrees(atan2(y2 - y1, x2 - x1))) < 4 AND abs((y1 + y2) / 2 - (245 + video_key % 10)) < 8 GROUP BY 1""",
    "sound_onsets": """WITH e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_id * 1000 + value AS value FROM events),
      r AS (SELECT key, i, greatest(0, coalesce(value - lag(value) OVER (PARTITION BY key ORDER BY i), 0)) AS rise FROM e)
      SELECT key, i, round_even(rise / (median(rise) OVER (PARTITION BY key) + 1e-9), 4) AS v FROM r""",
    "player_readings": """WITH a AS (SELECT CAST(substr(source, 4) AS INT) AS video_key, doc_id AS shot_id, CASE WHEN doc_id % 9 = 0 THEN 'NULL' ELSE upper(lang) || CASE WHEN doc_id % 2 = 0 THEN 'E' ELSE '' END END AS name,
        doc_id % 5 <> 0 AS known, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
      SELECT video_key, shot_id, name, 'rouge' AS colour FROM a WHERE r <= 10 AND known AND length(name) >= 3 AND name <> 'NULL'""",
    "team_order": """WITH v AS (SELECT o_custkey AS match, count(*) FILTER (o_orderkey % 2 = o_orderkey // 3 % 2) AS keep, count(*) FILTER (o_orderkey % 2 <> o_orderkey // 3 % 2) AS swap FROM orders GROUP BY 1)
      SELECT match, keep < swap AS swapped, greatest(keep, swap) AS votes FROM v""",
    "reading_sequence": """WITH b AS (SELECT o_custkey AS match, o_orderkey AS rally, 0 AS part, o_orderstatus AS reading FROM orders UNION ALL SELECT o_custkey, o_orderkey, 1, o_orderpriority FROM orders)
      SELECT match, rally, part, reading, CAST(row_number() OVER (PARTITION BY match ORDER BY rally, part) - 1 AS INT) AS ord FROM b""",
    "annotation_items": """SELECT key, concat('{"key":"', key, '","img":"img/', replace(key, ':', '_'), '.jpg","t":', t, ',"side":"', side, '","height":"', height, '","guess":"', stroke, '"}') AS item
      FROM (SELECT concat_ws(':', l_orderkey, l_partkey, l_linenumber) AS key, l_linenumber AS t, l_returnflag AS side, l_linestatus AS height, concat('s', l_suppkey % 4) AS stroke FROM lineitem)""",
    "rally_lines": """SELECT l_orderkey AS shot_id, string_agg(concat('p', l_linenumber % 4, ' s', l_suppkey % 4), ' → ' ORDER BY l_partkey * 10000000 + l_suppkey * 100 + l_linenumber, l_linenumber % 4) AS line FROM lineitem GROUP BY 1""",
    "stroke_table": """SELECT l_linenumber % 4 AS player, count(*) FILTER (l_suppkey % 4 = 0) AS s0, count(*) FILTER (l_suppkey % 4 = 1) AS s1, count(*) FILTER (l_suppkey % 4 = 2) AS s2 FROM lineitem GROUP BY 1""",
    "shot_kinds": f"WITH {SHOT} SELECT kind, count(*) AS n, count(*) FILTER (kind = 'main' AND NOT replay) AS rallies FROM shot GROUP BY 1",
    "player_tracks": """WITH RECURSIVE d AS (SELECT l_orderkey // 750 AS shot_id, l_partkey % 200 AS frame, l_discount * 100 AS x, l_quantity * 0.4::DOUBLE AS y, l_extendedprice AS conf FROM lineitem),
      b AS (SELECT *, CASE WHEN y < 10 THEN 0 ELSE 2 END AS side FROM d),
      f AS (SELECT shot_id, side, frame, list({'x': x, 'y': y} ORDER BY conf DESC, x, y)[1:2] AS p FROM b GROUP BY 1, 2, 3),
      n AS (SELECT shot_id, side, frame, p[1] AS p, p[2] AS q, row_number() OVER (PARTITION BY shot_id, side ORDER BY frame) AS k FROM f),
      s AS (
        SELECT 0::BIGINT AS k, shot_id, side, 0::BIGINT AS frame, NULL::STRUCT(x DOUBLE, y DOUBLE) AS a, 0::BIGINT AS af, NULL::STRUCT(x DOUBLE, y DOUBLE) AS b, 0::BIGINT AS bf, FALSE AS ta, FALSE AS tb FROM (SELECT DISTINCT shot_id, side FROM n)
        UNION ALL
        SELECT k, shot_id, side, frame, CASE WHEN ta THEN na ELSE a END, CASE WHEN ta THEN frame ELSE af END, CASE WHEN tb THEN nb ELSE b END, CASE WHEN tb THEN frame ELSE bf END, ta, tb FROM (
          -- A slot takes what is given to it if it has no place yet or that is near enough.
          SELECT *, na IS NOT NULL AND (a IS NULL OR sqrt((na.x - a.x) ** 2 + (na.y - a.y) ** 2) <= 2.5 + 8 * (frame - af) / 30) AS ta,
            nb IS NOT NULL AND (b IS NULL OR sqrt((nb.x - b.x) ** 2 + (nb.y - b.y) ** 2) <= 2.5 + 8 * (frame - bf) / 30) AS tb FROM (
            SELECT *, CASE WHEN straight THEN p ELSE q END AS na, CASE WHEN straight THEN q ELSE p END AS nb FROM (
              SELECT n.k, s.shot_id, s.side, n.frame, s.a, s.af, s.b, s.bf, n.p, n.q,
                CASE WHEN s.a IS NULL AND s.b IS NULL THEN n.q IS NULL OR n.p.x < n.q.x OR (n.p.x = n.q.x AND n.p.y <= n.q.y)
                ELSE coalesce(sqrt((n.p.x - s.a.x) ** 2 + (n.p.y - s.a.y) ** 2), 1) + CASE WHEN n.q IS NULL THEN 0 ELSE coalesce(sqrt((n.q.x - s.b.x) ** 2 + (n.q.y - s.b.y) ** 2), 1) END
                  <= coalesce(sqrt((n.p.x - s.b.x) ** 2 + (n.p.y - s.b.y) ** 2), 1) + CASE WHEN n.q IS NULL THEN 0 ELSE coalesce(sqrt((n.q.x - s.a.x) ** 2 + (n.q.y - s.a.y) ** 2), 1) END END AS straight
              FROM s JOIN n ON n.shot_id = s.shot_id AND n.side = s.side AND n.k = s.k + 1))))
      SELECT shot_id, frame, CAST(side AS INT) AS slot, a.x AS x, a.y AS y FROM s WHERE ta UNION ALL SELECT shot_id, frame, CAST(side + 1 AS INT), b.x, b.y FROM s WHERE tb""",
    "hit_features": """WITH b AS (SELECT l_orderkey // 400 AS shot_id, CAST(l_linenumber % 4 AS INT) AS slot,
        row_number() OVER (PARTITION BY l_orderkey // 400, l_linenumber % 4 ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS frame,
        l_quantity, l_discount, l_suppkey % 2 = 1 AS lefty, list_transform(range(17), lambda k: l_partkey * (k + 3) % 97 * 2::DOUBLE) AS kx,
        list_transform(range(17), lambda k: l_suppkey * (k + 5) % 89 * 2::DOUBLE + k * 4) AS ky, list_transform(range(17), lambda k: l_partkey * (k + 1) % 10 / 10) AS kc FROM lineitem),
      m AS (MEASURES),
      h AS (SELECT b.*, m.height, concat_ws(':', shot_id, frame, slot) AS key, last, CASE WHEN lefty <> (slot < 2) THEN -1 ELSE 1 END AS turn,
          CASE WHEN lefty THEN [9, 7, 5, 10, 0, 11, 12, 15, 16, 5, 6] ELSE [10, 8, 6, 9, 0, 11, 12, 15, 16, 5, 6] END AS points, len(list_filter(kc, lambda c: c > 0.3)) AS sure
        FROM b JOIN (SELECT shot_id, max(frame) AS last FROM b GROUP BY 1) USING (shot_id) JOIN m USING (shot_id, slot, frame)),
      -- Every point of every frame around a hit; a frame that is not there has no sure point.
      r AS (SELECT key, o, j, turn * coalesce(q.kx[points[j] + 1], 0) AS x, coalesce(q.ky[points[j] + 1], 0) AS y, coalesce(q.kc[points[j] + 1], 0) > 0.3 AS ok
        FROM (SELECT h.*, o, least(last, greatest(0, frame - 15 + o)) AS at FROM h, range(31) t(o)) a LEFT JOIN b q ON q.shot_id = a.shot_id AND q.slot = a.slot AND q.frame = a.at, range(1, 12) u(j)),
      w AS (SELECT *, max(CASE WHEN ok THEN o END) OVER (PARTITION BY key, j ORDER BY o) AS lo, min(CASE WHEN ok THEN o END) OVER (PARTITION BY key, j ORDER BY o DESC) AS hi FROM r),
      z AS (SELECT w.key, w.o, w.j, l.x * (1 - part) + g.x * part AS x, l.y * (1 - part) + g.y * part AS y
        FROM (SELECT *, coalesce(lo, hi) AS a, coalesce(hi, lo) AS e, CASE WHEN hi > lo THEN (o - lo) / (hi - lo) ELSE 0 END AS part FROM w) w
        JOIN r l ON l.key = w.key AND l.j = w.j AND l.o = w.a JOIN r g ON g.key = w.key AND g.j = w.j AND g.o = w.e),
      y AS (SELECT key, o, list_transform(range(1, 12), lambda k: struct_extract(list_extract(list_filter(l, lambda p: p.j = k), 1), 'x')) AS x,
          list_transform(range(1, 12), lambda k: struct_extract(list_extract(list_filter(l, lambda p: p.j = k), 1), 'y')) AS y
        FROM (SELECT key, o, list({'j': j, 'x': x, 'y': y}) AS l FROM z GROUP BY 1, 2)),
      v AS (SELECT key, o, [x[1], x[2], x[3], x[4], x[5], (x[6] + x[7]) / 2, (x[8] + x[9]) / 2] AS x, [y[1], y[2], y[3], y[4], y[5], (y[6] + y[7]) / 2, (y[8] + y[9]) / 2] AS y,
          coalesce(x[5], (x[10] + x[11]) / 2) AS hx, coalesce(y[5], (y[10] + y[11]) / 2) AS hy FROM y),
      c AS (SELECT key, x[6] AS cx, y[6] AS cy, CASE WHEN x[7] IS NULL THEN 2.2::DOUBLE * sqrt((hx - x[6]) ** 2 + (hy - y[6]) ** 2) ELSE sqrt((hx - x[7]) ** 2 + (hy - y[7]) ** 2) END AS tall FROM v WHERE o = 15),
      p AS (SELECT key, flatten(list(list_transform(flatten(list_transform(range(1, 8), lambda k: [(x[k] - cx) / tall, (y[k] - cy) / tall])), lambda q: coalesce(q, 0)) ORDER BY o)) AS path
        FROM v JOIN c USING (key) WHERE o % 3 = 0 AND cx IS NOT NULL AND tall >= 10 GROUP BY 1),
      f AS (SELECT key, list_transform(list_concat(path, [abs(l_quantity * 0.4::DOUBLE - 10) / 10, CASE WHEN slot < 2 THEN 10 - l_discount * 100 ELSE l_discount * 100 END / 10, (height = 'low')::INT, (height = 'high')::INT, (height = 'head')::INT,
          least(l_discount * 6, 2), least(l_quantity / 4, 20) / 10]), lambda q: CAST(CAST(q AS FLOAT) AS DOUBLE)) AS f FROM p JOIN h USING (key) WHERE sure >= 6)
      SELECT key, COLUMNS FROM f""",
    "hit_measures": """WITH b AS (SELECT l_orderkey // 400 AS shot_id, CAST(l_linenumber % 4 AS INT) AS slot,
        row_number() OVER (PARTITION BY l_orderkey // 400, l_linenumber % 4 ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS frame,
        l_quantity, l_discount, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 10 ELSE 9 END AS wk,
        list_transform(range(17), lambda k: l_partkey * (k + 3) % 97 * 2::DOUBLE) AS kx, list_transform(range(17), lambda k: l_suppkey * (k + 5) % 89 * 2::DOUBLE + k * 4) AS ky,
        list_transform(range(17), lambda k: l_partkey * (k + 1) % 10 / 10) AS kc FROM lineitem),
      t AS (SELECT h.shot_id, h.slot, h.frame, min(p.ky[h.wk + 1]) FILTER (p.kc[h.wk + 1] > 0.3) AS top
        FROM b h JOIN b p ON p.shot_id = h.shot_id AND p.slot = h.slot AND p.frame BETWEEN h.frame - 2 AND h.frame + 2 WHERE h.frame % 5 = 0 GROUP BY 1, 2, 3),
      m AS (SELECT b.*, coalesce(top, ky[wk + 1]) AS top, kx[wk + 1] AS wx, ky[wk + 1] AS wy, (kx[12] + kx[13]) / 2 AS hx, (ky[12] + ky[13]) / 2 AS hy,
          CASE WHEN kc[1] > 0.3 THEN ky[1] ELSE least(ky[6], ky[7]) - 0.25 * abs(ky[12] - ky[6]) END AS head FROM b JOIN t USING (shot_id, slot, frame)),
      n AS (SELECT *, greatest(abs(hy - head), 1) AS body FROM m),
      o AS (SELECT *, top < head - 0.05 * body AS overhead, CASE WHEN least(kc[6], kc[7]) > 0.3 THEN least(ky[6], ky[7]) ELSE head + 0.2 * body END AS shoulder,
          ((wx - hx) * (kx[13] - kx[12]) + (wy - hy) * (ky[13] - ky[12]) > 0) = (wk = 10) AS forehand, wy > hy - 0.3 * body AS wrist_low,
          abs(l_quantity * 0.4::DOUBLE - 10) AS dist, l_discount * 6 AS speed, min(frame) OVER (PARTITION BY shot_id) = frame AS first FROM n),
      p AS (SELECT *, first AND frame / 30 < 2.5 AND dist >= 6.45 AND NOT overhead AND wrist_low AS serve FROM o)
      SELECT shot_id, slot, frame, CASE WHEN overhead THEN 'head' WHEN top < shoulder THEN 'high' ELSE 'low' END AS height, overhead, forehand, wrist_low,
        CASE WHEN serve THEN 'service' WHEN overhead AND dist < 5 AND speed > 0.45 THEN 'smash' WHEN overhead AND dist >= 5 AND speed < 0.35 THEN 'bandeja'
          WHEN overhead THEN 'vibora' WHEN dist < 4.5 AND forehand THEN 'volee_cd' WHEN dist < 4.5 THEN 'volee_revers' WHEN forehand THEN 'coup_droit' ELSE 'revers' END AS stroke,
        CAST(CASE WHEN serve THEN 0.6 WHEN overhead AND dist < 5 AND speed > 0.45 THEN 0.5 WHEN overhead AND dist >= 5 AND speed < 0.35 THEN 0.45
          WHEN overhead THEN 0.35 ELSE 0.6 END AS DOUBLE) AS confidence FROM p""",
    "sound_peaks": """WITH e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value * CASE WHEN event_id % 9 = 0 THEN 40 ELSE 1 END AS env FROM events),
      r AS (SELECT key, i, greatest(0, coalesce(env - lag(env) OVER (PARTITION BY key ORDER BY i), 0)) AS rise FROM e),
      s AS (SELECT key, i, rise / (median(rise) OVER (PARTITION BY key) + 1e-9) AS v FROM r),
      l AS (SELECT *, greatest(8, quantile_cont(v, 0.95) OVER (PARTITION BY key)) AS least FROM s),
      p AS (SELECT * FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM l WINDOW w AS (PARTITION BY key ORDER BY i)) WHERE v > a AND v > b AND v >= least),
      c AS (SELECT key, list(CAST(i AS BIGINT) ORDER BY v DESC, i DESC) AS c FROM p GROUP BY 1),
      k AS (SELECT key, unnest(list_reduce(c[2:], lambda k, x: CASE WHEN len(list_filter(k, lambda o: abs(o - x) < 25)) = 0 THEN list_append(k, x) ELSE k END, [c[1]])) AS i FROM c)
      SELECT key AS shot_id, round_even(i * 0.01::DOUBLE, 4) AS t, round_even(least(v, 1e6), 4) AS v FROM k JOIN s USING (key, i)""",
    "net_base_rows": """WITH s AS (SELECT l_orderkey // 500 AS video_key, l_quantity * 10 AS x1, (l_partkey % 500)::DOUBLE AS y1, l_quantity * 10 + l_suppkey % 90 + 1 AS x2, (l_partkey % 500 + l_suppkey % 4)::DOUBLE AS y2 FROM lineitem),
      l AS (SELECT *, (y1 + y2) / 2 AS mid FROM s WHERE abs(degrees(atan2(y2 - y1, x2 - x1))) < 4),
      r AS (SELECT DISTINCT video_key, CAST(round_even(mid, 0) AS INT) AS row FROM l WHERE mid > 50 AND mid < 390),
      p AS (SELECT r.video_key, r.row, min(least(x1, x2)) AS a, max(greatest(x1, x2)) AS b FROM r JOIN l ON l.video_key = r.video_key AND abs(mid - r.row) < 3 GROUP BY 1, 2)
      SELECT video_key, max(row) AS row, -750::DOUBLE AS vanishing FROM p WHERE (b - a) / (300 + 0.4 * row) >= 0.6 GROUP BY 1""",
    "court_rows": """WITH p AS (SELECT p_partkey, 700 + p_size AS v1, 400 + p_partkey % 50 AS v2, 100 + p_size * 2 AS v0, p_partkey % 20 AS y FROM part),
      c AS (SELECT *, (v2 - v1) / (16.95::DOUBLE * (v1 - v0) - 10 * (v2 - v0)) AS c FROM p)
      SELECT p_partkey, round_even((v0 * c * y + v2 + c * 10 * (v2 - v0)) / (c * y + 1), 5) AS row FROM c""",
    "court_methods": """WITH f AS (SELECT o_custkey AS video_key, ['net', 'sidelines_low', 'net', 'sidelines'][o_orderkey % 4 + 1] AS method, o_orderkey % 97 + o_orderkey / 1e6::DOUBLE AS residual_px FROM orders)
      SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY video_key ORDER BY method <> 'sidelines', residual_px, method = 'sidelines_low') = 1""",
    "centre_lines": """WITH s AS (SELECT l_orderkey // 500 AS video_key, l_quantity * 10 AS x1, (l_partkey % 500)::DOUBLE AS y1, l_quantity * 10 + l_suppkey % 9 AS x2, (l_suppkey * 7 % 500)::DOUBLE AS y2 FROM lineitem),
      u AS (SELECT * FROM s WHERE abs(degrees(atan2(y2 - y1, x2 - x1))) > 60
        QUALIFY row_number() OVER (PARTITION BY video_key ORDER BY sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) DESC, x1 DESC, y1 DESC, x2 DESC, y2 DESC) = 1)
      SELECT video_key, CASE WHEN y1 <= y2 THEN x1 ELSE x2 END AS x_top, least(y1, y2) AS top, CASE WHEN y1 <= y2 THEN x2 ELSE x1 END AS x_bottom, greatest(y1, y2) AS bottom FROM u""",
    "document_markdown": f"""WITH {HEARD}, b AS (SELECT *, CASE WHEN seg_id % 7 = 0 THEN context ELSE '' END AS seen FROM heard_seg),
      t AS (SELECT video_key, string_agg(concat('### ', {CLOCK.format(t='"start"')}, ' – ', {CLOCK.format(t='"end"')}, chr(10), chr(10), CASE WHEN seen <> '' THEN concat('**Seen:** ', seen, chr(10), chr(10)) ELSE '' END,
        CASE WHEN heard <> '' THEN concat('**Heard:** ', heard, chr(10), chr(10)) ELSE '' END), '' ORDER BY seg_id) AS t FROM b GROUP BY 1),
      m AS (SELECT video_key, concat('# Timeline of v', video_key, chr(10), chr(10), 'Length 12:00; model `m`; 0.5 frames a second in segments of 5 s', chr(10), chr(10),
        CASE WHEN video_key % 2 = 0 THEN concat('## Summary', chr(10), chr(10), 'All of it.', chr(10), chr(10)) ELSE '' END, '## Segments', chr(10), chr(10), t) AS m FROM t)
      SELECT video_key, left(m, length(m) - 1) AS markdown FROM m""",
    "report_strokes": f"""WITH {HITS}, r AS (SELECT hit_id // 400 AS video_key, concat('p', n) AS player, CASE WHEN stroke IN ('bandeja', 'vibora') THEN 'bandeja_vibora' ELSE stroke END AS k FROM ruled)
      SELECT video_key, player, concat('| ', player, {", ".join(f"' | ', count(*) FILTER (k = '{k}')" for k in ("service", "coup_droit", "revers", "volee_cd", "volee_revers", "bandeja_vibora", "smash", "lob", "sortie_vitre"))}, ' |') AS line FROM r GROUP BY 1, 2""",
    "report_players": f"""WITH {HITS}, n AS (SELECT video_key, player, sum(n) AS hits FROM (SELECT hit_id // 400 AS video_key, concat('p', n) AS player, stroke, count(*) AS n FROM ruled GROUP BY 1, 2, 3) WHERE n > 3 GROUP BY 1, 2),
      s AS (SELECT l_orderkey // 400 AS video_key, concat('p', l_linenumber) AS player, sum(l_quantity) AS d, max(l_quantity) / 8 AS v, count(*) AS c FROM lineitem GROUP BY 1, 2)
      SELECT s.video_key, s.player, printf('| %s | %d | %d m | %.1f m/s | %d %% | %d %% | %d %% |', s.player, CAST(coalesce(hits, 0) AS INT), CAST(round_even(d, 0) AS INT), v,
        CAST(round_even(c % 7 / 16 * 100, 0) AS INT), CAST(round_even(c % 5 / 16 * 100, 0) AS INT), CAST(round_even(c % 3 / 16 * 100, 0) AS INT)) AS line FROM s LEFT JOIN n USING (video_key, player)""",
    "report_teams": """WITH r AS (SELECT o_custkey AS video_key, count(*) FILTER (o_orderkey % 3 = 0) AS a, count(*) FILTER (o_orderkey % 3 = 1) AS b, count(*) FILTER (o_orderkey % 3 = 2) AS u, count(*) AS n FROM orders GROUP BY 1)
      SELECT c_custkey AS video_key, concat('- **A**: shirt rouge; points known to be won: ', coalesce(a, 0), chr(10), '- **B**: shirt ?; points known to be won: ', coalesce(b, 0),
        CASE WHEN n IS NOT NULL THEN concat(chr(10), chr(10), 'No known winner in ', u, ' of the rallies, which are ', n) ELSE '' END) AS text FROM customer LEFT JOIN r ON video_key = c_custkey""",
    "stroke_summaries": f"""WITH {HITS}, n AS (SELECT concat('p', n) AS player, stroke, count(*) AS c FROM ruled GROUP BY 1, 2)
      SELECT player, string_agg(concat(stroke, ' ', c), ', ' ORDER BY c DESC, stroke) AS line FROM n GROUP BY 1""",
    "confusion_lines": f"""WITH {LAB}, c AS (SELECT truth, count(*) FILTER (pred = 'c0') AS a, count(*) FILTER (pred = 'c1') AS b, count(*) FILTER (pred = 'c2') AS d FROM lab GROUP BY 1),
      k(t, pos) AS (VALUES ('c0', 1), ('c1', 2), ('c2', 3))
      SELECT pos, concat('| **', t, '** | ', coalesce(a, 0), ' | ', coalesce(b, 0), ' | ', coalesce(d, 0), ' |') AS line FROM k LEFT JOIN c ON truth = t
      UNION ALL SELECT -1, '| true, predicted | c0 | c1 | c2 |' UNION ALL SELECT 0, '|---|---|---|---|'""",
    "accuracy_lines": f"""WITH {LAB} SELECT answer, CASE WHEN count(v) > 0 THEN printf('| %s | %d %% (n=%d) |', answer, CAST(round_even(avg(CASE WHEN v IS NULL THEN NULL WHEN v = truth THEN 1 ELSE 0 END) * 100, 0) AS INT), count(v)) ELSE concat('| ', answer, ' | — |') END AS line
      FROM (SELECT truth, 'pred' AS answer, pred AS v FROM lab UNION ALL SELECT truth, 'vlm', vlm FROM lab UNION ALL SELECT truth, 'none', NULL FROM lab) GROUP BY 1""",
    "label_counts": f"""WITH {LAB} SELECT counter, value, count(*) AS n FROM (SELECT 'truth' AS counter, truth AS value FROM lab UNION ALL SELECT 'pred', pred FROM lab UNION ALL SELECT 'vlm', vlm FROM lab) GROUP BY 1, 2""",
    "label_standard": f"""WITH {LAB}, r AS (SELECT key, key % 17 / 17 AS a, key::DOUBLE AS b FROM lab)
      SELECT key, round_even((a - avg(a) OVER ()) / (stddev_pop(a) OVER () + 1e-6), 6) AS a, round_even((b - avg(b) OVER ()) / (stddev_pop(b) OVER () + 1e-6), 6) AS b FROM r""",
    "label_imports": """WITH s AS (SELECT source AS video, CAST(doc_id AS VARCHAR) AS key, lang AS label FROM documents WHERE doc_id % 3 <> 0), f AS (SELECT source AS video, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id % 8 = 0)
      SELECT video, key, CASE WHEN f.key IS NOT NULL THEN 'en' ELSE s.label END AS label, CASE WHEN f.key IS NOT NULL THEN 'user' ELSE 'model' END AS annotator FROM s FULL JOIN f USING (video, key)""",
    "labels_certain": f"""WITH {LAB} SELECT video, key, n_chars, truth AS label FROM lab JOIN documents ON doc_id = key WHERE key % 5 <> 0""",
    "pose_rates": """SELECT event_id, round_even(CASE WHEN value / 8 > 31.5 THEN 30 ELSE value / 8 END, 6) AS fps, concat(upper(event_type[1]), lower(event_type[2:])) AS team FROM events""",
}

_SPEEDS = ORACLES["wrist_speeds"]
ORACLES["hits_detected"] = ORACLES["hits_detected"].replace("SPEEDS", _SPEEDS[len("WITH ") : _SPEEDS.index("SELECT shot_id, slot, frame, round_even(speed")].rstrip() + ",")
# The features of a hit need its height, and are as many columns.
ORACLES["hit_features"] = ORACLES["hit_features"].replace("MEASURES", ORACLES["hit_measures"]).replace("COLUMNS", ", ".join(f"f[{i + 1}] AS f{i}" for i in range(161)))
