"""ANSI SQL with the results of the queries, over the same projected views."""

from __future__ import annotations

from itemlake.functions.columns import LABELS
from itemlake.sources.project import with_views

_PLAIN = "regexp_replace({}, '<[^>]*>', '', 'g')"
_N = "CAST(translate(nullif(regexp_extract(stem_html, '([1-9一二三四五])\\s*つ(を)?選べ', 1), ''), '一二三四五', '12345') AS INTEGER)"
_ALL = "regexp_matches(stem_html, '(すべて|全て)(を)?選べ')"
_TYPE = f"CASE WHEN {_ALL} THEN 'XX' WHEN {_N} = 1 THEN 'A' WHEN {_N} BETWEEN 2 AND 4 THEN concat('X', {_N}) END"
_PROBLEM = f"CASE WHEN {_ALL} THEN NULL WHEN {_N} IS NULL THEN 'no_instruction' WHEN {_N} = 5 THEN 'five_of_five' WHEN {_N} > 5 THEN 'over_five' END"
_NEG = "contains(stem_html, '<strong>')"
_WORDS = "(contains(regexp_replace(stem_html, '<[^>]*>', '', 'g'), 'ない') OR contains(regexp_replace(stem_html, '<[^>]*>', '', 'g'), '誤っている'))"
_REQ = "CASE item_type WHEN 'A' THEN 1 WHEN 'X2' THEN 2 WHEN 'X3' THEN 3 WHEN 'X4' THEN 4 END"
_RANK = "CASE item_type WHEN 'A' THEN 0 WHEN 'X2' THEN 1 WHEN 'X3' THEN 2 WHEN 'X4' THEN 3 WHEN 'XX' THEN 4 ELSE 9 END"


def r(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name or expr}"


def i(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


_SEL = ", ".join(f"CAST(sum(CASE WHEN c.pattern NOT IN ('', '?') AND contains(c.pattern, '{x}') THEN c.cnt ELSE 0 END) AS DOUBLE) / sum(c.cnt) AS sel_{x}" for x in LABELS)
_DEAD = " OR ".join(f"(NOT contains(correct, '{x}') AND sel_{x} < 0.05)" for x in LABELS)

MORE = {
    "o_items": f"SELECT e.exam_id, e.position, e.qversion_id, e.correct_asked AS correct, v.question_id, v.version_no, v.choice_set_id, v.choice_order, v.stem_html, {_TYPE} AS item_type, {_NEG} AS negative FROM {{exam_items}} e JOIN {{question_versions}} v ON v.id = e.qversion_id",
    "o_wrong": "SELECT c.exam_id, c.qversion_id, c.pattern, c.cnt, row_number() OVER (PARTITION BY c.exam_id, c.qversion_id ORDER BY c.cnt DESC, p.k) AS rnk FROM {item_pattern_counts} c JOIN {o_items} t USING (exam_id, qversion_id) JOIN {patterns} p ON p.pattern = c.pattern WHERE p.k < 31 AND c.pattern <> t.correct",
    "o_stats": f"""SELECT s.*, w.pattern AS top_wrong_pattern, coalesce(w.cnt, 0) AS top_wrong_count FROM (
  SELECT c.exam_id, c.qversion_id, t.correct, t.item_type, sum(c.cnt) AS n, sum(CASE WHEN c.pattern = t.correct THEN c.cnt ELSE 0 END) AS n_correct,
    CAST(sum(CASE WHEN c.pattern = t.correct THEN c.cnt ELSE 0 END) AS DOUBLE) / sum(c.cnt) AS p, {_SEL},
    CAST(sum(CASE WHEN c.pattern = '' THEN c.cnt ELSE 0 END) AS DOUBLE) / sum(c.cnt) AS blank_rate, CAST(sum(CASE WHEN c.pattern = '?' THEN c.cnt ELSE 0 END) AS DOUBLE) / sum(c.cnt) AS other_rate,
    CASE WHEN t.item_type <> 'XX' THEN CAST(sum(CASE WHEN c.pattern NOT IN ('', '?') AND length(c.pattern) <> {_REQ} THEN c.cnt ELSE 0 END) AS DOUBLE) / sum(c.cnt) END AS overselect_rate
  FROM {{item_pattern_counts}} c JOIN {{o_items}} t USING (exam_id, qversion_id) GROUP BY c.exam_id, c.qversion_id, t.correct, t.item_type) s
  LEFT JOIN {{o_wrong}} w ON w.exam_id = s.exam_id AND w.qversion_id = s.qversion_id AND w.rnk = 1""",
    "o_dated": f"SELECT s.*, t.position, t.question_id, t.version_no, t.choice_set_id, t.choice_order, t.stem_html, t.negative, d.disc, e.exam_date, {_NEG} <> {_WORDS} AS emphasis_violation FROM {{o_stats}} s JOIN {{o_items}} t USING (exam_id, qversion_id) LEFT JOIN {{item_disc}} d USING (exam_id, qversion_id) JOIN {{exams}} e ON e.id = s.exam_id",
    "o_low": "SELECT exam_id, qversion_id, coalesce(disc IS NOT NULL AND count(disc) OVER q >= 2 AND sum(CASE WHEN disc < 0.1 THEN 1 ELSE 0 END) OVER q = count(disc) OVER q, false) AS low FROM {o_dated} WINDOW q AS (PARTITION BY question_id)",
    "o_flags": f"""SELECT d.exam_id, d.qversion_id, concat_ws(',', CASE WHEN {_DEAD} THEN 'dead_distractor' END, CASE WHEN top_wrong_count > n_correct THEN 'dominant_wrong' END,
  CASE WHEN emphasis_violation THEN 'emphasis_rule' END, CASE WHEN disc < 0 THEN 'negative_disc' END, CASE WHEN overselect_rate > 0.10 THEN 'overselect' END, CASE WHEN low THEN 'persistent_low_disc' END) AS flags
  FROM {{o_dated}} d JOIN {{o_low}} l USING (exam_id, qversion_id)""",
    "o_prev": "SELECT exam_id, qversion_id, o.p AS prev_p, o.disc AS prev_disc FROM (SELECT c.exam_id, c.qversion_id, o.p, o.disc, row_number() OVER (PARTITION BY c.exam_id, c.qversion_id ORDER BY o.exam_date DESC, o.exam_id DESC) AS rn FROM {o_dated} c JOIN {o_dated} o ON o.question_id = c.question_id AND o.exam_id <> c.exam_id AND o.exam_date < c.exam_date) o WHERE rn = 1",
    "o_texts": "SELECT DISTINCT choice_set_id, text_html FROM {choice_set_items}",
    "o_links": "SELECT a.choice_set_id AS set_a, b.choice_set_id AS set_b, count(*) AS shared, CASE WHEN count(*) >= 5 THEN 'identical' ELSE 'near' END AS relation FROM {o_texts} a JOIN {o_texts} b ON a.text_html = b.text_html AND a.choice_set_id < b.choice_set_id GROUP BY 1, 2 HAVING count(*) >= 3",
    "o_near": "SELECT set_a AS s, set_b AS o FROM {o_links} UNION SELECT set_b, set_a FROM {o_links} UNION SELECT choice_set_id, choice_set_id FROM {choice_set_items}",
    "o_latest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY version_no DESC, id DESC) AS rn FROM {question_versions}) q WHERE rn = 1",
    "o_tags": "SELECT q.id AS question_id, coalesce(string_agg(t.tag, ',' ORDER BY t.tag), '') AS tags FROM {questions} q LEFT JOIN {question_tags} t ON t.question_id = q.id GROUP BY q.id",
    "o_hist": "SELECT v.question_id, count(*) AS times_used, max(CAST(substr(e.exam_date, 1, 4) AS INTEGER)) AS last_exam_year FROM {exam_items} x JOIN {question_versions} v ON v.id = x.qversion_id JOIN {exams} e ON e.id = x.exam_id GROUP BY 1",
    "o_last": "SELECT question_id, p, disc, flags FROM (SELECT d.question_id, d.p, d.disc, f.flags, row_number() OVER (PARTITION BY d.question_id ORDER BY d.exam_date DESC, d.exam_id DESC) AS rn FROM {o_dated} d JOIN {o_flags} f USING (exam_id, qversion_id) WHERE d.p IS NOT NULL) x WHERE rn = 1",
    "o_cand": f"""SELECT q.id AS question_id, v.id AS qversion_id, v.stem_html, v.correct, v.choice_set_id, q.status, {_TYPE} AS item_type, {_NEG} AS negative, t.tags, h.last_exam_year, coalesce(h.times_used, 0) AS times_used, l.p, l.disc,
  array_to_string(list_sort(list_distinct(list_filter(string_split(coalesce(l.flags, ''), ',') || [CASE WHEN l.p IS NULL THEN 'no_stats' END, CASE WHEN {_NEG} <> {_WORDS} THEN 'emphasis_rule' END], lambda f: f IS NOT NULL AND f <> ''))), ',') AS flags
  FROM {{questions}} q JOIN {{o_latest}} v ON v.question_id = q.id JOIN {{o_tags}} t ON t.question_id = q.id LEFT JOIN {{o_hist}} h ON h.question_id = q.id LEFT JOIN {{o_last}} l ON l.question_id = q.id""",
    "o_pool": "SELECT * FROM {o_cand} WHERE status = 'active' AND item_type IS NOT NULL AND NOT list_contains(string_split(flags, ','), 'negative_disc')",
    "o_req": "SELECT * FROM (VALUES (1, 20, 0), (2, 30, NULL), (3, 12, 4)) AS t(request_id, total, new_target)",
    "o_quota": "SELECT r.request_id, t.item_type, t.quota FROM {o_req} r CROSS JOIN (VALUES ('A', 5), ('X2', 8), ('X3', 6), ('X4', 4), ('XX', 7)) AS t(item_type, quota)",
    "o_ranked": "SELECT q.request_id, r.total, r.new_target, q.quota, c.*, c.p IS NULL AS is_new FROM {o_pool} c JOIN {o_quota} q ON q.item_type = c.item_type JOIN {o_req} r ON r.request_id = q.request_id",
    "o_new": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY times_used, coalesce(last_exam_year, -1), question_id) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY request_id, item_type ORDER BY times_used, coalesce(last_exam_year, -1), question_id) AS r FROM {o_ranked} WHERE is_new AND new_target > 0) a WHERE r <= quota) b WHERE seq <= least(total, new_target)",
    "o_rest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY times_used, coalesce(last_exam_year, -1), question_id) AS s FROM (
  SELECT x.*, coalesce((SELECT count(*) FROM {o_new} n WHERE n.request_id = x.request_id), 0) AS took_all, coalesce((SELECT count(*) FROM {o_new} n WHERE n.request_id = x.request_id AND n.item_type = x.item_type), 0) AS took,
    row_number() OVER (PARTITION BY x.request_id, x.item_type ORDER BY x.times_used, coalesce(x.last_exam_year, -1), x.question_id) AS r FROM {o_ranked} x WHERE x.new_target IS NULL OR NOT x.is_new) a WHERE r <= quota - took) b WHERE s <= total - took_all""",
    "o_sel": "SELECT request_id, seq, question_id, qversion_id, item_type, times_used, last_exam_year FROM {o_new} UNION ALL SELECT request_id, s + took_all, question_id, qversion_id, item_type, times_used, last_exam_year FROM {o_rest}",
    "o_set_items": "SELECT choice_set_id, item_no, min(text_html) AS text_html FROM {choice_set_items} GROUP BY 1, 2",
    "o_app": "SELECT d.exam_id, d.qversion_id, d.choice_set_id, CAST(substr(d.choice_order, x.j, 1) AS BIGINT) AS item_no, contains(d.correct, substr('abcde', x.j, 1)) AS was_correct, CASE x.j WHEN 1 THEN sel_a WHEN 2 THEN sel_b WHEN 3 THEN sel_c WHEN 4 THEN sel_d ELSE sel_e END AS mark_rate, d.p AS question_p, i.text_html FROM {o_dated} d CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS x(j) JOIN {o_set_items} i ON i.choice_set_id = d.choice_set_id AND i.item_no = CAST(substr(d.choice_order, x.j, 1) AS BIGINT)",
    "o_pairs": "SELECT k.exam_id, k.qversion_id, k.text_html, k.item_no, w.text_html AS other, max(w.mark_rate) AS mark_rate FROM {o_app} k JOIN {o_app} w ON w.exam_id = k.exam_id AND w.qversion_id = k.qversion_id AND NOT w.was_correct AND w.text_html <> k.text_html WHERE k.was_correct GROUP BY ALL",
    "o_lead": "SELECT text_html, other, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY exam_id, qversion_id, text_html, item_no ORDER BY mark_rate DESC, other) AS rn FROM {o_pairs}) x WHERE rn = 1 GROUP BY 1, 2",
    "o_top": "SELECT text_html, other, n, (SELECT count(*) FROM {o_pairs} p WHERE p.text_html = x.text_html AND p.other = x.other) AS co FROM (SELECT *, row_number() OVER (PARTITION BY text_html ORDER BY n DESC, other) AS rn FROM {o_lead}) x WHERE rn = 1",
    "o_perf": "SELECT a.text_html, count(*) AS appearances, count(*) FILTER (WHERE was_correct) AS as_correct, count(*) FILTER (WHERE NOT was_correct) AS as_distractor, median(question_p) FILTER (WHERE was_correct) AS mp, median(mark_rate) FILTER (WHERE NOT was_correct) AS mr, any_value(t.other) AS other, coalesce(any_value(t.n), 0) AS n, coalesce(any_value(t.co), 0) AS co FROM {o_app} a LEFT JOIN {o_top} t ON t.text_html = a.text_html GROUP BY a.text_html",
    "o_lineage": "SELECT q.id AS question_id, v.question_id AS parent_id, q.derived_from FROM {questions} q JOIN {question_versions} v ON v.id = q.derived_from",
    "o_edges": "SELECT question_id AS a, parent_id AS b FROM {o_lineage} UNION SELECT parent_id, question_id FROM {o_lineage} UNION SELECT id, id FROM {questions}",
    "o_counted": "SELECT s.*, coalesce((SELECT sum(c.cnt) FROM {item_pattern_counts} c WHERE c.exam_id = s.exam_id AND c.qversion_id = s.qversion_id AND c.pattern = s.correct), 0) AS counted, d.disc, e.correct_asked FROM {stats_rows} s JOIN {item_disc} d USING (exam_id, qversion_id) LEFT JOIN {exam_items} e ON e.exam_id = s.exam_id AND e.position = s.position",
    "o_modal": "SELECT exam_id, total AS modal_total FROM (SELECT exam_id, total, row_number() OVER (PARTITION BY exam_id ORDER BY count(*) DESC, min(position)) AS rn FROM {stats_rows} GROUP BY exam_id, total) x WHERE rn = 1",
    "o_issues": """SELECT exam_id, CAST(NULL AS BIGINT) AS position, 'total_mismatch' AS code, true AS blocking FROM (SELECT DISTINCT s.exam_id FROM {stats_rows} s JOIN {o_modal} m USING (exam_id) WHERE s.total <> m.modal_total) a
  UNION ALL SELECT exam_id, NULL, 'n_not_declared', false FROM (SELECT DISTINCT exam_id FROM {stats_rows}) b
  UNION ALL SELECT exam_id, position, 'adjusted_item', false FROM {stats_rows} WHERE adjustment <> 'none'
  UNION ALL SELECT exam_id, position, 'correct_mismatch', true FROM {o_counted} WHERE correct <> correct_asked
  UNION ALL SELECT exam_id, position, 'p_mismatch', true FROM {o_counted} WHERE abs(CAST(counted AS DOUBLE) / total - p_reported) > 0.001
  UNION ALL SELECT exam_id, position, 'disc_off_grid', false FROM {o_counted} WHERE NOT coalesce(abs(disc - round_even(disc * floor(total * 0.25), 0) / floor(total * 0.25)) <= 0.001, false)""",
    "o_par": "SELECT doc_id, idx - 1 AS paragraph, line AS text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS idx FROM {documents}) d",
    "o_runs": "SELECT doc_id, paragraph, run_no, text, CASE length(text) % 3 WHEN 1 THEN 'i' WHEN 2 THEN 'strong' ELSE '' END AS fmt FROM (SELECT doc_id, paragraph, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) AS run_no FROM {o_par}) w",
    "o_isl": "SELECT doc_id, paragraph, island, string_agg(text, '' ORDER BY run_no) AS text, any_value(fmt) AS fmt FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, paragraph ORDER BY run_no) AS island FROM (SELECT *, CASE WHEN lag(fmt) OVER (PARTITION BY doc_id, paragraph ORDER BY run_no) = fmt THEN 0 ELSE 1 END AS new FROM {o_runs} WHERE text <> '') a) b GROUP BY 1, 2, 3",
}

_WS = "[\\s\\x{3000}]"
_PRINTED = "SELECT choice_set_id AS batch_key, list(text_html ORDER BY text_html) AS texts FROM {choice_set_items} GROUP BY 1 HAVING count(*) = 5"
_REV = f"""WITH b AS (SELECT l.question_id, l.version_no AS old_no, l.choice_order AS old_order, {_TYPE} AS old_type, l.correct, q.status,
    CASE WHEN l.question_id % 5 = 0 THEN regexp_replace(stem_html, '(すべて選べ|[1-9]つ選べ)。$', 'すべて選べ。') ELSE concat('再', stem_html) END AS new_stem, CASE WHEN l.question_id % 4 = 0 THEN '12345' ELSE l.choice_order END AS new_order
  FROM {{o_latest}} l JOIN {{questions}} q ON q.id = l.question_id),
t AS (SELECT *, {_TYPE.replace('stem_html', 'new_stem')} AS new_type FROM b),
f AS (SELECT *, (new_type IS DISTINCT FROM old_type OR new_order <> old_order) AS fresh, status <> 'draft' AND (new_type IS NULL OR (new_type <> 'XX' AND length(correct) <> {_REQ.replace('item_type', 'new_type')})) AS blocked FROM t)
SELECT question_id, CAST(old_no + CASE WHEN fresh AND NOT blocked THEN 1 ELSE 0 END AS BIGINT) AS version_no, fresh AND NOT blocked AS created_new_version, blocked FROM f"""

_EMPHASIS = f"""SELECT exam_id, position, 'emphasis_missing' AS code, false AS blocking FROM {{src}} WHERE {_WORDS} AND NOT {_NEG} UNION ALL SELECT exam_id, position, 'emphasis_unexpected', false FROM {{src}} WHERE {_NEG} AND NOT {_WORDS}"""

_NEW = f"""WITH b AS (SELECT id AS batch_key, CASE WHEN id % 30 = 2 THEN '' ELSE correct END AS correct, CASE WHEN question_id % 4 = 0 THEN 'draft' ELSE 'active' END AS status, id % 50 = 1 AS broken, {_TYPE} AS item_type FROM {{question_versions}}),
c AS (SELECT *, broken OR (status = 'active' AND (item_type IS NULL OR correct = '' OR (item_type <> 'XX' AND length(correct) <> {_REQ}))) AS blocked FROM b),
n AS (SELECT batch_key, (SELECT max(id) FROM {{questions}}) + row_number() OVER (ORDER BY batch_key) AS question_id FROM c WHERE NOT blocked)"""
_ASSIGN = """WITH b AS (SELECT exam_id, position, qversion_id + CASE WHEN position % 10 = 0 THEN 5 ELSE 0 END AS qversion_id FROM {exam_items} WHERE position % 3 <> 0),
j AS (SELECT b.*, v.correct FROM b LEFT JOIN {question_versions} v ON v.id = b.qversion_id)"""
_KEY = "CASE WHEN position % 4 = 0 THEN concat(correct, 'A') WHEN position % 7 = 0 THEN '' WHEN position % 11 = 0 THEN concat(correct, 'x') ELSE correct END"

SQL = {
    "pattern_counts": "SELECT exam_id, qversion_id, pattern, cnt FROM {item_pattern_counts}",
    "item_stats": f"SELECT exam_id, qversion_id, {i('n')}, {i('n_correct')}, {r('p')}, {', '.join(r('sel_' + x) for x in LABELS)}, {r('blank_rate')}, {r('other_rate')}, {r('overselect_rate')}, top_wrong_pattern, {i('top_wrong_count')}, correct, item_type FROM {{o_stats}}",
    "item_flags": "SELECT exam_id, qversion_id, flags FROM {o_flags}",
    "top_wrong_k": f"SELECT w.exam_id, w.qversion_id, rnk AS rank, pattern, {i('cnt')}, {r('CAST(cnt AS DOUBLE) / s.n', 'share')} FROM {{o_wrong}} w JOIN {{o_stats}} s USING (exam_id, qversion_id) WHERE rnk <= 5",
    "partial_credit": f"SELECT c.exam_id, c.qversion_id, CAST({' + '.join(f'''CASE WHEN contains(c.pattern, '{x}') AND contains(t.correct, '{x}') THEN 1 ELSE 0 END''' for x in LABELS)} AS BIGINT) AS hits, CAST(sum(c.cnt) AS BIGINT) AS persons FROM {{item_pattern_counts}} c JOIN {{o_items}} t USING (exam_id, qversion_id) GROUP BY 1, 2, 3",
    "exam_score_stats": f"SELECT exam_id, count(score) AS n, {r('avg(score)', 'mean')}, {r('stddev_pop(score)', 'sd')}, {r('median(score)', 'median')} FROM {{exam_scores}} GROUP BY exam_id",
    "persistent_low_disc": "SELECT exam_id, qversion_id, low AS persistent_low_disc FROM {o_low}",
    "persistent_low_disc_earlier": "SELECT exam_id, qversion_id, coalesce(disc IS NOT NULL AND count(disc) OVER q >= 2 AND sum(CASE WHEN disc < 0.1 THEN 1 ELSE 0 END) OVER q = count(disc) OVER q, false) AS persistent_low_disc FROM {o_dated} WINDOW q AS (PARTITION BY question_id ORDER BY exam_date, exam_id ROWS UNBOUNDED PRECEDING)",
    "previous_stats": f"SELECT d.exam_id, d.qversion_id, {r('prev_p')}, {r('prev_disc')} FROM {{o_dated}} d LEFT JOIN {{o_prev}} p USING (exam_id, qversion_id)",
    "modal_total": f"SELECT exam_id, {i('modal_total')} FROM {{o_modal}}",
    "trend_breaks": f"SELECT question_id, row_number() OVER q AS seq, exam_id, exam_date, {i('version_no')}, {r('p')}, {r('disc')}, coalesce(lag(version_no) OVER q <> version_no, false) AS version_break FROM {{o_dated}} WINDOW q AS (PARTITION BY question_id ORDER BY exam_date, exam_id, version_no)",
    "question_history": f"SELECT d.question_id, row_number() OVER q AS seq, exam_id, exam_date, {i('version_no')}, {r('p')}, {r('disc')}, coalesce(lag(version_no) OVER q <> version_no, false) AS version_break, l.parent_id, (SELECT count(*) FROM {{o_lineage}} k WHERE k.parent_id = d.question_id) AS n_children FROM {{o_dated}} d LEFT JOIN {{o_lineage}} l ON l.question_id = d.question_id WINDOW q AS (PARTITION BY d.question_id ORDER BY exam_date, exam_id, version_no)",
    "strata": f"""SELECT CASE WHEN gn = 0 THEN 'negative' WHEN gt = 0 THEN 'item_type' ELSE 'total' END AS stratum_kind, CASE WHEN gn = 0 THEN CASE WHEN negative THEN 'negative' ELSE 'positive' END WHEN gt = 0 THEN ty ELSE 'total' END AS stratum, n_items, {r('mean_p')}, {r('median_p')}, {r('mean_disc')}
FROM (SELECT grouping(negative) AS gn, grouping(ty) AS gt, negative, ty, count(*) AS n_items, avg(p) AS mean_p, median(p) AS median_p, avg(disc) AS mean_disc FROM (SELECT negative, coalesce(item_type, '?') AS ty, p, disc FROM {{o_dated}}) d GROUP BY GROUPING SETS ((negative), (ty), ())) g""",
    "crosswalk": f"SELECT t.exam_id, t.position, t.question_id, {i('t.version_no', 'version_no')}, t.item_type, t.negative, p.prev_p IS NULL AS is_new, t.correct, g.tags, CAST((SELECT max(CAST(substr(e.exam_date, 1, 4) AS INTEGER)) FROM {{o_items}} o JOIN {{exams}} e ON e.id = o.exam_id WHERE o.question_id = t.question_id AND o.exam_id <> t.exam_id) AS BIGINT) AS last_exam_year, {r('p.prev_p', 'last_p')}, t.choice_set_id FROM {{o_items}} t LEFT JOIN {{o_prev}} p USING (exam_id, qversion_id) LEFT JOIN {{o_tags}} g ON g.question_id = t.question_id",
    "report_rows": f"""SELECT d.exam_id, d.qversion_id, d.position, d.item_type, {i('d.n', 'n')}, {r('d.p', 'p')}, {r('d.disc', 'disc')}, {r('prev_p')}, {r('prev_disc')}, {r('d.p - prev_p', 'delta_p')}, f.flags, coalesce(w.t, '') AS top_wrong
FROM {{o_dated}} d LEFT JOIN {{o_prev}} USING (exam_id, qversion_id) LEFT JOIN {{o_flags}} f USING (exam_id, qversion_id) LEFT JOIN (SELECT exam_id, qversion_id, string_agg(concat(pattern, ':', cnt), ' ' ORDER BY rnk) AS t FROM {{o_wrong}} WHERE rnk <= 5 GROUP BY 1, 2) w USING (exam_id, qversion_id)""",
    "pattern_report": f"SELECT w.exam_id, w.qversion_id, rnk AS rank, w.pattern, {i('cnt')}, {r('CAST(cnt AS DOUBLE) / s.n', 'share')}, t.position, t.item_type, t.correct FROM {{o_wrong}} w JOIN {{o_stats}} s USING (exam_id, qversion_id) JOIN {{o_items}} t USING (exam_id, qversion_id) WHERE rnk <= 5",
    "comparison_report": f"SELECT d.exam_id, d.qversion_id, position, question_id, {r('p')}, {r('prev_p')}, {r('p - prev_p', 'delta_p')}, {r('disc')}, {r('prev_disc')} FROM {{o_dated}} d JOIN {{o_prev}} USING (exam_id, qversion_id) WHERE prev_p IS NOT NULL",
    "flag_report": f"SELECT d.exam_id, d.qversion_id, position, question_id, f.flags, {r('p')}, {r('disc')} FROM {{o_dated}} d JOIN {{o_flags}} f USING (exam_id, qversion_id) WHERE f.flags <> ''",
    "latest_version": f"SELECT id, question_id, {i('version_no')}, choice_set_id, choice_order, correct, stem_html FROM {{o_latest}}",
    "history_summary": f"SELECT question_id, times_used, {i('last_exam_year')} FROM {{o_hist}}",
    "candidates": f"SELECT question_id, qversion_id, correct, choice_set_id, status, item_type, negative, tags, {i('last_exam_year')}, {i('times_used')}, {r('p')}, {r('disc')}, flags FROM {{o_cand}}",
    "candidate_labels": "SELECT question_id, concat(coalesce(concat('正答率', CAST(round_even(p * 100, 0) AS INTEGER), '%'), '新作'), '(', coalesce(item_type, '?'), ')', CASE WHEN disc IS NULL THEN '' ELSE printf(' D=%.3f', disc) END, CASE WHEN negative THEN ' 否定形' ELSE '' END) AS label, concat(coalesce(concat(CAST(round_even(p * 100, 0) AS INTEGER), '%'), '—'), '(', coalesce(item_type, '?'), ')') AS p_label FROM {o_cand}",
    "bank_filter": f"SELECT question_id, {r('p')}, status FROM {{o_cand}} WHERE status NOT IN ('draft', 'retired') AND contains({_PLAIN.format('stem_html')}, '含まれ') AND p >= 0.2",
    "bank_list": "SELECT question_id, item_type, status FROM {o_cand} WHERE item_type = 'X2'",
    "eligible": "SELECT question_id, CASE WHEN status <> 'active' THEN concat('status=', status) WHEN item_type IS NULL THEN 'no_type' WHEN list_contains(string_split(flags, ','), 'negative_disc') THEN 'negative_disc' WHEN disc < 0.1 THEN 'low_disc' WHEN p NOT BETWEEN 0.2 AND 0.9 THEN 'p_out_of_range' WHEN last_exam_year > 2000 THEN 'recent' END AS excluded_reason FROM {o_cand}",
    "select_by_quota": f"SELECT {i('request_id')}, {i('seq')}, question_id, qversion_id, item_type FROM {{o_sel}}",
    "selected_by_type": f"SELECT {i('request_id')}, item_type, count(*) AS n_items, string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY seq) AS question_ids FROM {{o_sel}} GROUP BY request_id, item_type",
    "replacement_pool": f"SELECT {i('r.request_id', 'request_id')}, c.question_id FROM {{o_pool}} c CROSS JOIN (SELECT DISTINCT request_id FROM {{o_sel}}) r LEFT JOIN {{o_sel}} s ON s.request_id = r.request_id AND s.question_id = c.question_id WHERE s.question_id IS NULL",
    "assign_positions": f"SELECT {i('request_id')}, question_id, row_number() OVER (PARTITION BY request_id ORDER BY {_RANK}, times_used, coalesce(last_exam_year, -1), question_id) AS position FROM {{o_sel}}",
    "near_set_links": "SELECT set_a, set_b, shared, relation FROM {o_links}",
    "link_overrides": "SELECT l.set_a, l.set_b, l.shared, l.relation FROM {o_links} l WHERE set_b % 3 <> 0 AND set_a % 7 <> 0 UNION ALL SELECT set_a, set_b, CAST(1 AS BIGINT), 'manual' FROM {o_links} WHERE set_a % 7 = 0",
    "closed_neighbourhood": "SELECT s AS choice_set_id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS group_key FROM {o_near} GROUP BY s",
    "lineage": "SELECT question_id, parent_id, derived_from FROM {o_lineage}",
    "derivation_family": "WITH RECURSIVE reach(q, f) AS (SELECT a, b FROM {o_edges} UNION SELECT r.q, e.b FROM reach r JOIN {o_edges} e ON e.a = r.f) SELECT q AS question_id, min(f) AS family_id FROM reach WHERE q IN (SELECT id FROM {questions}) GROUP BY q",
    "set_signature": "SELECT choice_set_id, sha256(string_agg(text_html, chr(31) ORDER BY text_html)) AS signature FROM {choice_set_items} GROUP BY choice_set_id",
    "tagless_duplicates": "SELECT plain, string_agg(CAST(choice_set_id AS VARCHAR), ',' ORDER BY choice_set_id) AS set_ids FROM (SELECT DISTINCT text_html AS plain, choice_set_id FROM {choice_set_items}) d WHERE plain IN (SELECT text_html FROM {choice_set_items} GROUP BY 1 HAVING count(DISTINCT item_no = 1) > 1) GROUP BY plain",
    "set_item_matrix": f"""SELECT choice_set_id, question_id, qversion_id, {i('version_no')}, exam_id, {', '.join(r(f"CASE strpos(choice_order, '{n}') WHEN 1 THEN sel_a WHEN 2 THEN sel_b WHEN 3 THEN sel_c WHEN 4 THEN sel_d ELSE sel_e END", f'item_{n}') for n in range(1, 6))},
  array_to_string(list_sort(list_transform(string_split(correct, ''), lambda x: substr(choice_order, strpos('abcde', x), 1))), '') AS correct_item_nos FROM (SELECT *, row_number() OVER (PARTITION BY qversion_id ORDER BY exam_date DESC, exam_id DESC) AS rn FROM {{o_dated}}) d WHERE rn = 1""",
    "item_appearances": f"SELECT exam_id, qversion_id, choice_set_id, item_no, {r('mark_rate')}, {r('question_p')}, was_correct, text_html FROM {{o_app}}",
    "item_performance": f"SELECT text_html, appearances, as_correct, as_distractor, {r('mp', 'median_p_when_correct')}, {r('mr', 'median_mark_rate_when_distractor')}, other AS top_confused_with, {i('n', 'top_confused_count')}, {i('co', 'co_occurrences')} FROM {{o_perf}}",
    "term_verdicts": "SELECT text_html, CASE WHEN as_distractor = 0 OR mr IS NULL THEN 'none' WHEN mr < 0.05 THEN 'dead' WHEN mr >= 0.25 THEN 'strong' ELSE 'normal' END AS verdict FROM {o_perf} WHERE contains(text_html, 'a')",
    "unused_correct_items": "SELECT DISTINCT s.choice_set_id, s.item_no FROM {choice_set_items} s WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY choice_set_id, question_id ORDER BY version_no DESC) AS rn FROM {question_versions}) v CROSS JOIN (VALUES ('a'), ('b'), ('c'), ('d'), ('e')) AS l(x) WHERE v.rn = 1 AND v.choice_set_id = s.choice_set_id AND contains(v.correct, l.x) AND substr(v.choice_order, strpos('abcde', l.x), 1) = CAST(s.item_no AS VARCHAR))",
    "choice_set_summaries": "SELECT s.choice_set_id, (SELECT count(*) FROM {question_versions} v WHERE v.choice_set_id = s.choice_set_id) AS n_versions, string_agg(text_html, ' / ' ORDER BY item_no, text_html) AS items, string_agg(text_html, ' / ' ORDER BY item_no, text_html) FILTER (WHERE rn <= 4) AS preview, coalesce((SELECT string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) FROM {o_near} n WHERE n.s = s.choice_set_id AND n.o <> n.s), '') AS linked FROM (SELECT *, row_number() OVER (PARTITION BY choice_set_id ORDER BY item_no, text_html) AS rn FROM {choice_set_items}) s GROUP BY s.choice_set_id",
    "tag_usage": "SELECT t.tag, count(q.id) AS n_questions FROM {question_tags} t LEFT JOIN {questions} q ON q.id = t.question_id AND q.status = 'active' GROUP BY t.tag",
    "exam_summary": "SELECT e.id AS exam_id, exam_date, status, count(x.exam_id) AS n_items FROM {exams} e LEFT JOIN {exam_items} x ON x.exam_id = e.id GROUP BY 1, 2, 3",
    "booklet_rows": "SELECT t.exam_id, t.position, substr('abcde', x.j, 1) AS label, CAST(substr(t.choice_order, x.j, 1) AS BIGINT) AS item_no, i.text_html, i.text_html AS rendered FROM {o_items} t CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS x(j) JOIN {choice_set_items} i ON i.choice_set_id = t.choice_set_id AND i.item_no = CAST(substr(t.choice_order, x.j, 1) AS BIGINT)",
    "answer_key": "SELECT exam_id, position, correct_asked AS correct FROM {exam_items}",
    "validate_stats": "SELECT exam_id, position, code, blocking FROM {o_issues}",
    "validate_gate": "SELECT exam_id, bool_or(blocking) AS blocked, count(*) FILTER (WHERE blocking) AS n_blockers, count(*) FILTER (WHERE NOT blocking) AS n_warnings FROM {o_issues} GROUP BY exam_id",
    "validate_items": "SELECT choice_set_id, 'not_five' AS code FROM {choice_set_items} GROUP BY 1 HAVING count(*) <> 5 UNION ALL SELECT choice_set_id, 'duplicate' FROM {choice_set_items} GROUP BY 1 HAVING count(DISTINCT text_html) < count(text_html)",
    "cross_validate": f"""WITH q AS (SELECT * FROM {{o_items}} WHERE position % 37 <> 0), s AS (SELECT * FROM {{stats_rows}} WHERE position % 41 <> 0),
m AS (SELECT q.exam_id, q.position, q.stem_html, q.item_type, s.correct FROM q JOIN s USING (exam_id, position)), e AS (SELECT DISTINCT exam_id FROM {{stats_rows}})
SELECT exam_id, CAST(NULL AS BIGINT) AS position, 'question_count_mismatch' AS code, true AS blocking FROM e WHERE (SELECT count(*) FROM q WHERE q.exam_id = e.exam_id) <> (SELECT count(*) FROM s WHERE s.exam_id = e.exam_id)
UNION ALL SELECT q.exam_id, q.position, 'no_stats_row', true FROM q LEFT JOIN s USING (exam_id, position) WHERE s.correct IS NULL UNION ALL SELECT s.exam_id, s.position, 'no_question', true FROM s LEFT JOIN q USING (exam_id, position) WHERE q.stem_html IS NULL
UNION ALL SELECT exam_id, position, 'type_underivable', true FROM m WHERE item_type IS NULL
UNION ALL SELECT exam_id, position, 'type_correct_mismatch', true FROM m WHERE item_type IS NOT NULL AND item_type <> 'XX' AND length(correct) <> {_REQ} UNION ALL {_EMPHASIS.replace('{src}', 'm')}""",
    "validate_draft": f"""WITH d AS (SELECT t.*, q.status FROM {{o_items}} t JOIN {{questions}} q ON q.id = t.question_id),
x AS (SELECT exam_id, position, 'type_underivable' AS code, true AS blocking, status FROM d WHERE item_type IS NULL UNION ALL SELECT exam_id, position, 'type_unknown', true, status FROM d WHERE item_type IS NULL
UNION ALL SELECT exam_id, position, 'correct_count', true, status FROM d WHERE item_type <> 'XX' AND length(correct) <> {_REQ})
SELECT exam_id, position, code, blocking AND status <> 'draft' AS blocking FROM x UNION ALL {_EMPHASIS.replace('{src}', 'd')}""",
    "finalize_checks": f"""WITH RECURSIVE reach(q, f) AS (SELECT a, b FROM {{o_edges}} UNION SELECT r.q, e.b FROM reach r JOIN {{o_edges}} e ON e.a = r.f),
fam AS (SELECT q, min(f) AS f FROM reach GROUP BY q), t AS (SELECT i.*, q.status, fam.f FROM {{o_items}} i JOIN {{questions}} q ON q.id = i.question_id JOIN fam ON fam.q = i.question_id),
per AS (SELECT exam_id, count(*) AS n, count(*) FILTER (WHERE negative) AS neg, count(*) FILTER (WHERE item_type = 'A') AS a, count(*) FILTER (WHERE item_type = 'XX') AS xx FROM t GROUP BY 1)
SELECT exam_id, position, 'draft_included' AS code, true AS blocking FROM t WHERE status = 'draft' UNION ALL SELECT exam_id, position, 'retired_included', false FROM t WHERE status = 'retired'
UNION ALL SELECT exam_id, position, 'type_underivable', true FROM t WHERE item_type IS NULL UNION ALL SELECT exam_id, position, 'correct_count', true FROM t WHERE item_type <> 'XX' AND length(correct) <> {_REQ}
UNION ALL SELECT exam_id, position, 'duplicate_question', true FROM (SELECT *, row_number() OVER (PARTITION BY exam_id, question_id ORDER BY position) AS rn FROM t) d WHERE rn > 1
UNION ALL SELECT b.exam_id, b.position, 'derived_together', true FROM t a JOIN t b ON b.exam_id = a.exam_id AND b.f = a.f AND b.position > a.position AND b.question_id <> a.question_id
UNION ALL SELECT exam_id, NULL, 'set_group_over_limit', false FROM (SELECT x.exam_id, n.s FROM (SELECT DISTINCT exam_id, choice_set_id FROM t) x JOIN {{o_near}} n ON n.s = x.choice_set_id JOIN t ON t.exam_id = x.exam_id AND t.choice_set_id = n.o GROUP BY 1, 2 HAVING count(*) > 2) g
UNION ALL SELECT exam_id, NULL, 'negative_over_limit', false FROM per WHERE neg > 20 UNION ALL SELECT exam_id, NULL, 'negative_over_ratio', false FROM per WHERE CAST(neg AS DOUBLE) / n > 0.1
UNION ALL SELECT exam_id, NULL, 'type_distribution', false FROM per WHERE a <> 30 UNION ALL SELECT exam_id, NULL, 'type_distribution', false FROM per WHERE xx <> 10""",
    "unpivot_counts": "SELECT e.exam_id, e.qversion_id, p.pattern, round(CAST(c.cnt AS DOUBLE), 6) AS cnt, c.cnt IS NULL AS unreadable FROM (SELECT DISTINCT exam_id, qversion_id FROM {item_pattern_counts}) e CROSS JOIN {patterns} p LEFT JOIN {item_pattern_counts} c ON c.exam_id = e.exam_id AND c.qversion_id = e.qversion_id AND c.pattern = p.pattern",
    "strip_tags": "SELECT page_id, length(t) AS n, md5(t) AS text_md5 FROM (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<!--.*?-->|<[A-Za-z/!?][^>]*>', '', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS t FROM {pages}) x",
    "markup_census": "SELECT tag, count(*) AS removals FROM (SELECT lower(unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '<!-->', 'gs'), '<(!--|[A-Za-z][A-Za-z0-9]*)[^>]*>', 1))) AS tag FROM {pages}) t WHERE tag NOT IN ('p', 'li') GROUP BY tag",
    "contains_any": "SELECT doc_id, coalesce(contains(t, 'the') OR contains(t, 'der'), false) AS found FROM (SELECT doc_id, regexp_replace(text, '<!--.*?-->|<[A-Za-z/!?][^>]*>', '', 'gs') AS t FROM {documents}) d",
    "item_type": f"SELECT id, {_TYPE} AS item_type, {_PROBLEM} AS problem, {_NEG} AS negative, regexp_replace(stem_html, '(すべて選べ|[1-9]つ選べ)。$', '3つ選べ。') AS as_x3 FROM {{question_versions}}",
    "choice_orders": "SELECT id, array_to_string(list_sort(list_transform(string_split(correct, ''), lambda x: substr(choice_order, strpos('abcde', x), 1))), ',') AS nos, correct AS back, true AS valid, CAST(substr(choice_order, 2, 1) AS BIGINT) AS b_is, substr('abcde', strpos(choice_order, '2'), 1) AS two_is FROM {question_versions}",
    "merge_runs": "SELECT doc_id, count(*) AS islands, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE fmt <> '') AS formats FROM {o_isl} GROUP BY doc_id",
    "format_census": "SELECT CASE WHEN fmt = '' THEN 'plain' ELSE fmt END AS format, count(*) AS n_runs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM {o_runs} GROUP BY 1",
    "fragment_html": "SELECT doc_id, paragraph, md5(string_agg(CASE WHEN fmt = '' THEN esc ELSE concat('<', fmt, '>', esc, '</', fmt, '>') END, '' ORDER BY island)) AS html_md5 FROM (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS esc FROM {o_isl}) x GROUP BY 1, 2",
    "segment_questions": f"""WITH p AS (SELECT * FROM {{o_par}} WHERE NOT (regexp_matches(text, '^{_WS}*$') OR regexp_matches(text, '^\\s*[0-9]+\\s*$') OR regexp_matches(text, '^{_WS}*[<＜]\\s*以上') OR regexp_matches(text, '学年.*番号.*氏名') OR regexp_matches(text, '^{_WS}*氏\\s*名{_WS}*$'))),
m AS (SELECT *, regexp_matches(text, '^{_WS}*[0-9０-９]{{{{1,3}}}}[.．、]?{_WS}+[^\\s\\x{{{{3000}}}}]') AS q, regexp_extract(text, '^{_WS}*([ａ-ｅa-e])[.．、]?{_WS}*', 1) <> '' AS c FROM p),
n AS (SELECT *, sum(CASE WHEN q THEN 1 ELSE 0 END) OVER w AS nq FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY paragraph)),
k AS (SELECT *, CASE WHEN q THEN 'stem' WHEN c AND nq > 0 THEN 'choice' END AS mark FROM n),
l AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY paragraph) AS was FROM k)
SELECT doc_id, kind, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM (SELECT doc_id, CASE WHEN mark IS NOT NULL THEN mark WHEN was = 'stem' THEN 'continuation' ELSE 'stray' END AS kind,
  CASE mark WHEN 'stem' THEN regexp_replace(text, '^{_WS}*[0-9０-９]{{{{1,3}}}}[.．、]?{_WS}+', '') WHEN 'choice' THEN regexp_replace(text, '^{_WS}*[ａ-ｅa-e][.．、]?{_WS}*', '') ELSE text END AS body FROM l) x GROUP BY 1, 2""".replace("{{", "{").replace("}}", "}"),
    "resolve_choice_order": f"""WITH b AS ({_PRINTED}), p AS (SELECT batch_key, unnest(texts) AS text_html, generate_subscripts(texts, 1) AS j FROM b), pk AS (SELECT *, row_number() OVER (PARTITION BY batch_key, text_html ORDER BY j) AS k FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY choice_set_id, text_html ORDER BY item_no) AS k FROM {{choice_set_items}})
SELECT pk.batch_key, CASE WHEN count(s.item_no) = 5 AND count(DISTINCT s.item_no) = 5 THEN string_agg(CAST(s.item_no AS VARCHAR), '' ORDER BY pk.j) END AS choice_order FROM pk LEFT JOIN s ON s.choice_set_id = pk.batch_key AND s.text_html = pk.text_html AND s.k = pk.k GROUP BY pk.batch_key""",
    "find_duplicates": f"SELECT a.id AS batch_key, min(b.question_id) AS question_id FROM {{question_versions}} a JOIN {{question_versions}} b ON b.choice_set_id = a.choice_set_id AND {_PLAIN.format('b.stem_html')} = {_PLAIN.format('a.stem_html')} GROUP BY a.id",
    "revise_questions": _REV,
    "retire_questions": "SELECT id, CASE WHEN id % 3 = 0 THEN 'retired' ELSE status END AS status FROM {questions}",
    "register_questions": f"{_NEW} SELECT c.batch_key, c.blocked, {i('n.question_id', 'question_id')} FROM c LEFT JOIN n USING (batch_key)",
    "derive_questions": f"{_NEW} SELECT question_id, count(*) AS n_tags FROM (SELECT question_id, tag FROM {{question_tags}} UNION SELECT CAST(n.question_id AS BIGINT), t.tag FROM n JOIN {{question_versions}} v ON v.id = n.batch_key JOIN {{question_tags}} t ON t.question_id = v.question_id) x GROUP BY question_id",
    "set_tags": "SELECT question_id, tag FROM {question_tags} WHERE question_id % 2 <> 0 UNION ALL SELECT id, t FROM {questions} CROSS JOIN (VALUES ('x'), ('y')) AS v(t) WHERE id % 2 = 0",
    "delete_tags": "SELECT question_id, tag FROM {question_tags} WHERE tag NOT LIKE '%1'",
    "ensure_tags": "SELECT CAST(id AS BIGINT) AS id, tag FROM (VALUES (7, 'Brand#11'), (9, 'old')) AS t(id, tag) UNION ALL SELECT 9 + row_number() OVER (ORDER BY tag), tag FROM (SELECT DISTINCT tag FROM {question_tags} WHERE tag <> 'Brand#11') d",
    "create_exams": "SELECT id, exam_date, status FROM {exams} UNION ALL SELECT (SELECT max(id) FROM {exams}) + row_number() OVER (ORDER BY exam_date, name), exam_date, 'draft' FROM (SELECT DISTINCT concat('exam ', question_id) AS name, concat(exam_id, '-12-24') AS exam_date FROM {responses}) d",
    "set_exam_items": f"{_ASSIGN} SELECT exam_id, position, qversion_id, correct_asked FROM {{exam_items}} WHERE exam_id % 2 <> 0 UNION ALL SELECT exam_id, position, qversion_id, correct FROM j WHERE exam_id % 2 = 0 AND correct IS NOT NULL",
    "set_exam_items_issues": f"{_ASSIGN} SELECT exam_id, position, CASE WHEN exam_id % 2 <> 0 THEN 'exam_locked' ELSE 'version_unknown' END AS code FROM j WHERE exam_id % 2 <> 0 OR correct IS NULL",
    "finalize_exams": "SELECT e.id, CASE WHEN e.id % 2 = 0 AND EXISTS (SELECT 1 FROM {o_items} t JOIN {questions} q ON q.id = t.question_id WHERE t.exam_id = e.id AND (q.status = 'draft' OR t.item_type IS NULL)) THEN 'draft' ELSE 'finalized' END AS status FROM {exams} e",
    "apply_stats": f"SELECT d.exam_id, d.qversion_id, {i('d.n', 'n')}, {r('d.p', 'p')}, f.flags FROM {{o_dated}} d JOIN {{o_flags}} f USING (exam_id, qversion_id) WHERE d.exam_id % 2 <> 0 OR d.exam_id NOT IN (SELECT exam_id FROM {{o_issues}} WHERE blocking)",
    "correct_issues": f"""WITH k AS (SELECT exam_id, position, item_type, lower({_KEY}) AS raw FROM {{o_items}}), m AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(string_split(raw, ''), lambda c: contains('abcde', c) AND c <> ''))), '') AS norm FROM k)
SELECT exam_id, position, 'correct_bad_label' AS code, true AS blocking FROM m WHERE contains(raw, 'x') UNION ALL SELECT exam_id, position, 'correct_duplicate', true FROM m WHERE length(raw) <> len(list_distinct(string_split(raw, ''))) AND raw <> ''
UNION ALL SELECT exam_id, position, 'correct_empty', true FROM m WHERE norm = '' UNION ALL SELECT exam_id, position, 'type_unknown', true FROM m WHERE norm <> '' AND item_type IS NULL
UNION ALL SELECT exam_id, position, 'correct_count', true FROM m WHERE norm <> '' AND item_type <> 'XX' AND length(norm) <> {_REQ}""",
    "header_issues": """WITH c AS (SELECT DISTINCT exam_id, pattern AS key FROM {item_pattern_counts} WHERE NOT (exam_id % 2 = 0 AND pattern = 'ab')), d AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE key = 'cd' AND exam_id % 3 = 0),
h AS (SELECT exam_id, CASE WHEN key = 'bc' AND exam_id % 5 = 0 THEN 'zz' ELSE key END AS key FROM d), e AS (SELECT DISTINCT exam_id FROM h)
SELECT exam_id, CAST(NULL AS BIGINT) AS position, 'csv_missing_columns' AS code, true AS blocking FROM e
UNION ALL SELECT exam_id, NULL, 'pattern_columns_missing', true FROM e WHERE EXISTS (SELECT 1 FROM {patterns} p WHERE p.pattern <> '?' AND NOT EXISTS (SELECT 1 FROM h WHERE h.exam_id = e.exam_id AND h.key = p.pattern))
UNION ALL SELECT DISTINCT exam_id, NULL, 'pattern_columns_extra', true FROM h WHERE key = 'zz' UNION ALL SELECT DISTINCT exam_id, NULL, 'pattern_columns_duplicate', true FROM h WHERE key = 'cd' AND exam_id % 3 = 0""",
    "parsed_issues": f"""WITH n AS (SELECT t.exam_id, t.position, count(s.item_no) AS n, coalesce(string_agg(substr('abcde', CAST(s.item_no AS INTEGER) + CASE WHEN t.position % 8 = 0 AND s.item_no = 1 THEN 1 ELSE 0 END, 1), '' ORDER BY substr('abcde', CAST(s.item_no AS INTEGER) + CASE WHEN t.position % 8 = 0 AND s.item_no = 1 THEN 1 ELSE 0 END, 1)), '') AS labels
  FROM {{o_items}} t LEFT JOIN {{choice_set_items}} s ON s.choice_set_id = t.choice_set_id AND NOT (t.position % 9 = 0 AND s.item_no = 2) GROUP BY 1, 2)
SELECT exam_id, position, 'choice_count' AS code, true AS blocking FROM n WHERE n <> 5 UNION ALL SELECT exam_id, position, 'choice_labels', true FROM n WHERE n = 5 AND labels <> 'abcde'
UNION ALL SELECT exam_id, position, 'type_underivable', true FROM {{o_items}} WHERE item_type IS NULL UNION ALL {_EMPHASIS.replace('{src}', '{o_items}')}""",
    "rename_tags": "SELECT DISTINCT question_id, concat(substr(tag, 1, 7), '*') AS tag FROM {question_tags}",
    "upsert_choice_sets": f"""WITH g AS (SELECT choice_set_id, string_agg(text_html, chr(31) ORDER BY text_html) AS sig, count(*) AS n FROM {{choice_set_items}} GROUP BY 1), old AS (SELECT sig, min(choice_set_id) AS id FROM g WHERE choice_set_id % 2 = 0 GROUP BY sig),
new AS (SELECT sig, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY min(choice_set_id), sig) AS id FROM g WHERE n = 5 AND sig NOT IN (SELECT sig FROM old) GROUP BY sig)
SELECT g.choice_set_id AS batch_key, CAST(coalesce(o.id, n.id) AS BIGINT) AS choice_set_id, o.id IS NULL AS created FROM g LEFT JOIN old o ON o.sig = g.sig LEFT JOIN new n ON n.sig = g.sig WHERE g.n = 5""",
    "merge_choice_sets": """WITH ok AS (SELECT choice_set_id FROM {choice_set_items} WHERE choice_set_id % 10 = 3 GROUP BY 1 HAVING count(DISTINCT text_html) = count(*))
SELECT v.id, CASE WHEN v.choice_set_id % 10 = 3 AND o.choice_set_id IS NULL THEN v.choice_set_id + 1000000 ELSE v.choice_set_id END AS choice_set_id, CASE WHEN v.choice_set_id % 10 = 3 AND o.choice_set_id IS NOT NULL THEN translate(v.choice_order, '12345', '54321') ELSE v.choice_order END AS choice_order
FROM {question_versions} v LEFT JOIN ok o ON o.choice_set_id = v.choice_set_id""",
}


MORE |= {
    "o_copies": """SELECT choice_set_id AS s, text_html AS t FROM {choice_set_items} UNION ALL SELECT choice_set_id + 100000, text_html FROM {choice_set_items} WHERE choice_set_id % 3 = 1
    UNION ALL SELECT choice_set_id + 200000, CASE WHEN text_html LIKE 's%' THEN 'other' ELSE text_html END FROM {choice_set_items} WHERE choice_set_id % 4 = 2""",
    "o_classes": "SELECT s, min(s) OVER (PARTITION BY k) AS c, len(k) AS size FROM (SELECT s, list_sort(list(DISTINCT t)) AS k FROM {o_copies} GROUP BY s) x",
    "o_copy_links": "SELECT a.s AS a, b.s AS b, count(*) AS shared FROM (SELECT DISTINCT * FROM {o_copies}) a JOIN (SELECT DISTINCT * FROM {o_copies}) b ON a.t = b.t AND a.s <> b.s GROUP BY 1, 2 HAVING count(*) >= 3",
    "o_copy_near": "SELECT a AS s, list_sort(list(b)) AS k FROM (SELECT a, b FROM {o_copy_links} UNION SELECT s, s FROM {o_copies}) x GROUP BY a",
    "o_cells": "SELECT c.exam_id, c.position, c.pattern, CASE WHEN c.pattern = '' AND r.odd IS NOT NULL THEN TRY_CAST(r.odd AS DOUBLE) ELSE CAST(c.cnt AS DOUBLE) END AS cnt FROM {table_counts} c JOIN {table_rows} r ON r.exam_id = c.exam_id AND r.position = c.position WHERE NOT r.free",
    "o_scanned": """SELECT r.*, t.total, t.counted, CASE WHEN r.exam_id % 2 = 0 THEN CAST(r.permille AS DOUBLE) / 10 / 100 ELSE CAST(r.permille AS DOUBLE) / 1000 END AS p_reported
  FROM {table_rows} r LEFT JOIN (SELECT c.exam_id, c.position, coalesce(sum(c.cnt), 0) AS total, coalesce(sum(CASE WHEN c.pattern = q.correct THEN c.cnt END), 0) AS counted
    FROM {o_cells} c JOIN {table_rows} q ON q.exam_id = c.exam_id AND q.position = c.position GROUP BY c.exam_id, c.position) t ON t.exam_id = r.exam_id AND t.position = r.position""",
    "o_scan_exams": """SELECT x.exam_id, CASE WHEN x.exam_id % 2 = 1 THEN concat('exam ', x.exam_id) END AS exam_name, CASE WHEN x.exam_id % 2 = 1 THEN concat(x.exam_id, '-08-25') END AS exam_date,
    CASE WHEN x.exam_id % 2 = 1 THEN x.n + CASE WHEN x.exam_id % 5 = 0 THEN 1 ELSE 0 END END AS n_examinees, s.derived_n, s.kinds, s.n_free, s.n_rows, s.n_items, s.total
  FROM {exam_totals} x JOIN (SELECT exam_id, count(*) AS n_items, count(*) FILTER (WHERE free) AS n_free, count(*) FILTER (WHERE NOT free) AS n_rows, count(DISTINCT total) FILTER (WHERE NOT free) AS kinds, max(total) AS total,
      CASE WHEN count(DISTINCT CAST(trunc(total) AS BIGINT)) FILTER (WHERE total <> 0) = 1 THEN max(CAST(trunc(total) AS BIGINT)) FILTER (WHERE total <> 0) END AS derived_n FROM {o_scanned} GROUP BY exam_id) s ON s.exam_id = x.exam_id""",
    "o_scan_modal": "SELECT exam_id, total FROM (SELECT exam_id, total, row_number() OVER (PARTITION BY exam_id ORDER BY count(*) DESC, min(position)) AS rn FROM {o_scanned} WHERE NOT free GROUP BY exam_id, total) m WHERE rn = 1",
}
_OFF_GRID = "total > 0 AND NOT coalesce(abs(disc - round_even(disc * floor(trunc(total) * 0.25), 0) / floor(trunc(total) * 0.25)) <= 0.001, false)"
SQL |= {
    "scan_rows": f"SELECT exam_id, position, CASE WHEN free THEN '' ELSE correct END AS correct, {r('p_reported')}, CASE WHEN exam_id % 2 = 1 THEN n_correct END AS n_correct_reported, {r('disc')}, CASE WHEN free THEN 'non_mcq' ELSE 'mcq' END AS kind, {r('total')}, {r('counted')} FROM {{o_scanned}}",
    "scan_counts": f"SELECT exam_id, position, pattern, {r('cnt')}, cnt IS NULL AS unreadable FROM {{o_cells}}",
    "scan_columns": """SELECT x.exam_id, CAST(c.column_no AS BIGINT) AS column_no, c.role, c.key FROM {exam_totals} x JOIN (
    SELECT 1 AS odd, k + 5 AS column_no, 'count' AS role, pattern AS key FROM {patterns} UNION ALL SELECT 0, k + 7, 'count', pattern FROM {patterns}
    UNION ALL SELECT * FROM (VALUES (1, 0, 'position', NULL), (1, 1, 'correct', NULL), (1, 2, 'p', NULL), (1, 3, 'n_correct', NULL), (1, 4, 'disc', NULL), (0, 0, 'position', NULL), (0, 1, 'points', NULL),
      (0, 2, 'adjustment', NULL), (0, 3, 'correct', NULL), (0, 4, 'p', NULL), (0, 5, 'disc', NULL), (0, 6, 'ignored', NULL)) AS t(odd, column_no, role, key)) c ON c.odd = x.exam_id % 2""",
    "scan_meta": "SELECT exam_id, exam_name, exam_date, n_examinees, derived_n, coalesce(n_examinees, derived_n) AS effective_n, exam_id % 2 = 0 AS percent, CASE WHEN exam_id % 2 = 0 THEN 'ssdb' ELSE 'legacy' END AS dialect FROM {o_scan_exams}",
    "neighbourhood_groups": "SELECT s AS choice_set_id, min(s) OVER (PARTITION BY k) AS group_id, count(*) OVER (PARTITION BY k) AS n_sets FROM (SELECT s, list_sort(list(o)) AS k FROM {o_near} GROUP BY s) x",
    "set_classes": "SELECT s AS choice_set_id, c AS class_id, CAST(size AS BIGINT) AS size FROM {o_classes}",
    "class_links": "SELECT a AS set_a, b AS set_b, shared FROM {o_copy_links} WHERE a < b AND a IN (SELECT c FROM {o_classes}) AND b IN (SELECT c FROM {o_classes})",
    "link_counts": "SELECT s AS choice_set_id, (SELECT count(*) FROM {o_copy_links} l WHERE l.a = c.s) AS n_links FROM {o_classes} c",
    "set_groups": "SELECT s AS choice_set_id, min(s) OVER (PARTITION BY k) AS group_id, count(*) OVER (PARTITION BY k) AS n_sets FROM {o_copy_near}",
    "group_links": "WITH g AS (SELECT s, min(s) OVER (PARTITION BY k) AS g FROM {o_copy_near}) SELECT DISTINCT x.g AS group_id, y.g AS linked_id FROM (SELECT a, b FROM {o_copy_links} UNION SELECT s, s FROM g) l JOIN g x ON x.s = l.a JOIN g y ON y.s = l.b",
    "scan_quoted": """SELECT exam_id, position, position + CASE WHEN exam_id % 2 = 0 THEN 1 ELSE 4 END AS line_no, CASE WHEN exam_id % 2 = 1 THEN concat('"final", ', exam_id, chr(13), chr(10), 'part 2') END AS exam_name,
    CASE WHEN exam_id % 2 = 0 THEN CASE position % 9 WHEN 0 THEN concat('left out:', chr(10), '"', position, '",', chr(10), chr(10), 'see minutes') WHEN 1 THEN '5" rule' ELSE 'none' END END AS adjustment,
    CASE WHEN free THEN '' ELSE correct END AS correct FROM {table_rows}""",
    "quoted_key": """WITH k AS (SELECT exam_id, CAST(position AS BIGINT) AS position, correct_asked AS correct, CASE WHEN position % 10 = 0 THEN 'one_cell' WHEN position % 11 = 0 THEN 'no_position' END AS code FROM {exam_items}),
    m AS (SELECT exam_id, max(position) AS last FROM k WHERE exam_id % 3 = 0 GROUP BY exam_id)
    SELECT exam_id, CAST(NULL AS BIGINT) AS line_no, position, correct, CAST(NULL AS VARCHAR) AS code FROM k WHERE code IS NULL UNION ALL SELECT exam_id, position + 1, NULL, NULL, code FROM k WHERE code IS NOT NULL
    UNION ALL SELECT exam_id, NULL, last + 1, 'abe', NULL FROM m UNION ALL SELECT exam_id, last + 2, NULL, NULL, 'unclosed_quote' FROM m""",
    "validate_scan": f"""SELECT exam_id, CAST(NULL AS BIGINT) AS position, 'non_mcq_skipped' AS code, false AS blocking FROM {{o_scan_exams}} WHERE n_free > 0
  UNION ALL SELECT exam_id, NULL, 'row_count', true FROM {{o_scan_exams}} WHERE n_rows <> n_items
  UNION ALL SELECT exam_id, NULL, 'n_not_declared', false FROM {{o_scan_exams}} WHERE n_examinees IS NULL
  UNION ALL SELECT exam_id, NULL, 'n_mismatch', true FROM {{o_scan_exams}} WHERE kinds = 1 AND CAST(trunc(total) AS BIGINT) <> n_examinees
  UNION ALL SELECT exam_id, position, CASE odd WHEN 'x' THEN 'count_unreadable' WHEN '-2' THEN 'count_negative' ELSE 'count_not_integer' END, true FROM {{o_scanned}} WHERE odd IS NOT NULL AND NOT free
  UNION ALL SELECT DISTINCT s.exam_id, CAST(NULL AS BIGINT), 'total_mismatch', true FROM {{o_scanned}} s JOIN {{o_scan_modal}} m ON m.exam_id = s.exam_id WHERE NOT s.free AND s.total <> m.total
  UNION ALL SELECT exam_id, position, 'p_mismatch', true FROM {{o_scanned}} WHERE NOT free AND total > 0 AND abs(counted / total - p_reported) > 0.001
  UNION ALL SELECT exam_id, position, 'disc_off_grid', false FROM {{o_scanned}} WHERE NOT free AND {_OFF_GRID}""",
    "stored_key": SQL["answer_key"],
    "stored_counts": "SELECT exam_id, qversion_id, pattern, CAST(cnt * CASE WHEN exam_id % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS cnt FROM {item_pattern_counts}",
    "stored_stats": f"SELECT d.exam_id, d.qversion_id, {i('d.n', 'n')}, {r('d.p', 'p')}, f.flags FROM {{o_dated}} d JOIN {{o_flags}} f USING (exam_id, qversion_id)",
    "stored_crosswalk": SQL["crosswalk"],
    "stored_flags": SQL["flag_report"],
    "stored_comparison": SQL["comparison_report"],
    "stored_patterns": SQL["pattern_report"],
    "stored_strata": SQL["strata"],
    "pattern_grid": "SELECT e.id AS exam_id, p.pattern, p.k AS ord, p.size, CAST(coalesce(sum(c.cnt), 0) AS BIGINT) AS cnt FROM {exams} e CROSS JOIN {patterns} p LEFT JOIN {item_pattern_counts} c ON c.exam_id = e.id AND c.pattern = p.pattern WHERE p.k < 31 GROUP BY ALL",
    "skipped_paragraphs": """SELECT doc_id, paragraph, CASE k WHEN 0 THEN ' 12 ' WHEN 1 THEN '　＜ 以上 ＞' WHEN 2 THEN '学年 番号 氏名' WHEN 4 THEN ' 氏  名' ELSE text END AS text
    FROM (SELECT *, (doc_id + paragraph) % 17 AS k FROM {o_par}) p WHERE k IN (0, 1, 2, 4) OR (k <> 3 AND k <> 5 AND regexp_matches(text, '^\\s*[0-9]+\\s*$'))""",
    "nfkc": "SELECT doc_id, length(t) AS n, md5(t) AS text_md5 FROM (SELECT doc_id, nfc_normalize(text) AS t FROM {documents}) d",
    "changed_bank": f"""{_NEW}, m AS (SELECT *, (SELECT max(id) FROM {{question_versions}}) + row_number() OVER (ORDER BY batch_key) AS id FROM n),
    {_REV[5:_REV.rindex('SELECT question_id, CAST(old_no')].replace('b AS (', 'rb AS (', 1).replace('FROM b)', 'FROM rb)').replace('ON q.id = l.question_id)', 'ON q.id = l.question_id WHERE l.question_id % 10 = 0)').replace('SELECT l.question_id, l.version_no', 'SELECT l.question_id, l.id AS old_id, l.choice_set_id, l.version_no', 1).strip()},
    v AS (SELECT v.id, v.question_id, v.version_no, v.choice_set_id, v.choice_order, v.correct, coalesce(f.new_stem, v.stem_html) AS stem FROM {{question_versions}} v LEFT JOIN f ON f.old_id = v.id AND NOT f.fresh AND NOT f.blocked
    UNION ALL SELECT m.id, m.question_id, 1, o.choice_set_id, o.choice_order, c.correct, o.stem_html FROM m JOIN {{question_versions}} o ON o.id = m.batch_key JOIN c ON c.batch_key = m.batch_key
    UNION ALL SELECT (SELECT max(id) FROM m) + row_number() OVER (ORDER BY question_id), question_id, old_no + 1, choice_set_id, new_order, correct, new_stem FROM f WHERE fresh AND NOT blocked),
    q AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'retired' ELSE status END AS status FROM {{questions}} UNION ALL SELECT m.question_id, c.status FROM m JOIN c ON c.batch_key = m.batch_key)
    SELECT CAST(v.id AS BIGINT) AS id, CAST(v.question_id AS BIGINT) AS question_id, CAST(version_no AS BIGINT) AS version_no, choice_set_id, choice_order, correct, md5(stem) AS stem_md5, q.status FROM v JOIN q ON q.id = v.question_id""",
    "resolve_printed": """WITH g AS (SELECT choice_set_id, string_agg(text_html, chr(31) ORDER BY text_html) AS sig, count(*) AS n FROM {choice_set_items} GROUP BY 1), old AS (SELECT sig, min(choice_set_id) AS id FROM g WHERE choice_set_id % 2 = 0 GROUP BY sig),
new AS (SELECT sig, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY min(choice_set_id), sig) AS id FROM g WHERE n = 5 AND sig NOT IN (SELECT sig FROM old) GROUP BY sig),
m AS (SELECT g.choice_set_id AS batch_key, CAST(coalesce(o.id, n.id) AS BIGINT) AS choice_set_id, o.id IS NULL AS created FROM g LEFT JOIN old o ON o.sig = g.sig LEFT JOIN new n ON n.sig = g.sig WHERE g.n = 5),
p AS (SELECT m.*, i.text_html, row_number() OVER (PARTITION BY batch_key ORDER BY i.text_html) AS j FROM m JOIN {choice_set_items} i ON i.choice_set_id = m.batch_key),
pk AS (SELECT *, row_number() OVER (PARTITION BY batch_key, text_html ORDER BY j) AS k FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY choice_set_id, text_html ORDER BY item_no) AS k FROM {choice_set_items}),
u AS (SELECT pk.batch_key, pk.choice_set_id, pk.created, pk.j, CASE WHEN pk.created THEN pk.j ELSE s.item_no END AS no FROM pk LEFT JOIN s ON NOT pk.created AND s.choice_set_id = pk.choice_set_id AND s.text_html = pk.text_html AND s.k = pk.k)
SELECT batch_key, choice_set_id, CASE WHEN count(no) = 5 AND count(DISTINCT no) = 5 THEN string_agg(CAST(no AS VARCHAR), '' ORDER BY j) END AS choice_order, created FROM u GROUP BY batch_key, choice_set_id, created""",
    "report_order": f"SELECT exam_id, qversion_id, row_number() OVER (PARTITION BY exam_id ORDER BY {_RANK}, position) AS place FROM {{o_dated}}",
    "term_order": "SELECT text_html, row_number() OVER (ORDER BY appearances DESC, text_html) AS place FROM {o_perf}",
    "decode_flags": "SELECT exam_id, qversion_id, CAST(len(list_filter(string_split(flags, ','), lambda f: f <> '')) AS BIGINT) AS n_flags, array_to_string(list_filter(string_split(flags, ','), lambda f: f <> '') || ['a'], '|') AS back FROM {o_flags}",
}


_GREEDY = """WITH RECURSIVE reach(q, f) AS (SELECT a, b FROM {o_edges} UNION SELECT r.q, e.b FROM reach r JOIN {o_edges} e ON e.a = r.f), fam AS (SELECT q, min(f) AS f FROM reach GROUP BY q),
grp AS (SELECT s AS choice_set_id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS group_key FROM {o_near} GROUP BY s),
rq AS (SELECT * FROM (VALUES (1, 30, NULL, 2, NULL, MAP {'A': 5, 'X2': 10, 'X3': 10}, NULL), (2, 50, NULL, 2, 3, NULL, MAP {'Brand#13': 5, 'Brand#11': 7}), (3, 20, 4, 1, NULL, NULL, NULL)) AS t(request_id, total, new_target, most_group, most_negative, types, tags)),
c AS (SELECT p.question_id, p.qversion_id, p.item_type, string_split(p.tags, ',') AS c_tags, p.p IS NULL AS is_new, p.negative, f.f AS family, g.group_key, row_number() OVER (ORDER BY p.times_used, coalesce(p.last_exam_year, -1), p.question_id) AS ord
  FROM {o_pool} p JOIN fam f ON f.q = p.question_id JOIN grp g ON g.choice_set_id = p.choice_set_id),
run(request_id, turn, n, place, took, fams, groups, kinds, used, neg, fresh) AS (
  SELECT request_id, CASE WHEN new_target > 0 THEN 1 ELSE 2 END, 0, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0, 0 FROM rq
  UNION ALL
  SELECT request_id, CASE WHEN b IS NULL THEN 2 ELSE turn END, CASE WHEN b IS NULL THEN n ELSE n + 1 END, CASE WHEN b IS NULL THEN 0 ELSE b.ord END, b.ord,
    CASE WHEN b IS NULL THEN fams ELSE fams || [b.family] END, CASE WHEN b IS NULL THEN groups ELSE groups || [b.group_key] END, CASE WHEN b IS NULL THEN kinds ELSE kinds || [b.item_type] END,
    CASE WHEN b.tag IS NULL THEN used ELSE used || [b.tag] END, neg + CASE WHEN b.negative THEN 1 ELSE 0 END, fresh + CASE WHEN b.is_new THEN 1 ELSE 0 END
  FROM (SELECT s.request_id, s.turn, s.n, s.fams, s.groups, s.kinds, s.used, s.neg, s.fresh,
      arg_min({'ord': c.ord, 'family': c.family, 'group_key': c.group_key, 'item_type': c.item_type, 'negative': c.negative, 'is_new': c.is_new,
               'tag': list_min(list_filter(c.c_tags, lambda t: coalesce(r.tags[t], 0) > len(list_filter(s.used, lambda u: u = t))))}, c.ord) FILTER (WHERE
        c.ord > s.place AND (s.turn = 2 OR c.is_new) AND NOT list_contains(s.fams, c.family) AND NOT (c.is_new AND r.new_target IS NOT NULL AND s.fresh >= r.new_target)
        AND NOT (c.negative AND r.most_negative IS NOT NULL AND s.neg >= r.most_negative) AND len(list_filter(s.groups, lambda x: x = c.group_key)) < r.most_group
        AND (r.types IS NULL OR len(list_filter(s.kinds, lambda x: x = c.item_type)) < coalesce(r.types[c.item_type], 0))
        AND (r.tags IS NULL OR len(list_filter(c.c_tags, lambda t: coalesce(r.tags[t], 0) > len(list_filter(s.used, lambda u: u = t)))) > 0)) AS b
    FROM run s JOIN rq r ON r.request_id = s.request_id CROSS JOIN c WHERE s.n < r.total GROUP BY s.request_id, s.turn, s.n, s.fams, s.groups, s.kinds, s.used, s.neg, s.fresh) q
  WHERE b IS NOT NULL OR turn = 1)"""
SQL |= {
    "select_candidates": _GREEDY + """ SELECT CAST(run.request_id AS BIGINT) AS request_id, CAST(run.n AS BIGINT) AS seq, c.question_id, c.qversion_id, c.item_type FROM run JOIN c ON c.ord = run.took""",
    "unmet": _GREEDY + """, fin AS (SELECT DISTINCT ON (request_id) * FROM run ORDER BY request_id, n DESC, turn DESC),
short AS (SELECT r.request_id, 'total' AS kind, '' AS key, r.total - f.n AS shortfall FROM rq r JOIN fin f USING (request_id)
  UNION ALL SELECT r.request_id, 'new', '', r.new_target - f.fresh FROM rq r JOIN fin f USING (request_id) WHERE r.new_target IS NOT NULL
  UNION ALL SELECT request_id, 'type', k, types[k] - len(list_filter(kinds, lambda x: x = k)) FROM (SELECT r.request_id, r.types, f.kinds, unnest(map_keys(r.types)) AS k FROM rq r JOIN fin f USING (request_id) WHERE r.types IS NOT NULL) a
  UNION ALL SELECT request_id, 'tag', k, tags[k] - len(list_filter(used, lambda x: x = k)) FROM (SELECT r.request_id, r.tags, f.used, unnest(map_keys(r.tags)) AS k FROM rq r JOIN fin f USING (request_id) WHERE r.tags IS NOT NULL) b)
SELECT CAST(request_id AS BIGINT) AS request_id, kind, key, CAST(shortfall AS BIGINT) AS shortfall FROM short WHERE shortfall > 0""",
}


_MARKUP = "regexp_replace(html, '<!--.*?-->|<[A-Za-z/!?][^>]*>', '', 'gs')"
_NAMED = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "''"), ("&copy;?", "©"), ("&middot;?", "·"))
_DECODED = _MARKUP
for _name, _char in _NAMED:
    _DECODED = f"regexp_replace({_DECODED}, '{_name}', '{_char}', 'g')"
MORE |= {
    # & itself last, so that what it makes isn't decoded again
    "o_plain": f"SELECT page_id, regexp_replace({_DECODED}, '&amp;?', '&', 'g') AS t FROM {{pages}}",
    "o_prop_rows": """SELECT CASE WHEN n % 6 = 0 OR n % 6 = 1 OR n % 7 = 0 THEN 'strong' END AS f1, CASE WHEN n % 5 = 0 THEN 'i' END AS f2, CASE WHEN n = 2 THEN 'sup' END AS f3,
    CASE WHEN n % 11 = 0 THEN 'underline' END AS u1, CASE WHEN n > 12 THEN 'strike' END AS u2, CASE n % 4 WHEN 0 THEN 'size=10.5pt' WHEN 1 THEN 'size=12pt' END AS u3, CASE WHEN n % 9 = 0 THEN 'color=FF0000' END AS u4,
    CASE WHEN n = 6 THEN 'highlight=YELLOW' END AS u5, CASE WHEN n = 3 THEN 'all_caps' END AS u6, CASE n % 6 WHEN 0 THEN 'ＭＳ ゴシック' WHEN 1 THEN 'MS Gothic' WHEN 2 THEN 'ＭＳ 明朝' ELSE 'none' END AS ea,
    CASE WHEN n % 3 = 0 THEN 'Times New Roman' ELSE 'none' END AS asc_, n FROM (SELECT length(text) AS n FROM {o_runs}) w""",
}
SQL |= {
    "strip_tags": "SELECT page_id, length(t) AS n, md5(t) AS text_md5 FROM {o_plain}",
    "run_formats": "SELECT concat_ws('+', f1, f2, f3) AS formats, concat_ws('+', u1, u2, u3, u4, u5, u6) AS unexpected, count(*) AS n_runs FROM {o_prop_rows} GROUP BY 1, 2",
    "font_census": """SELECT entry, count(*) AS n_runs FROM (SELECT unnest(list_filter([concat('eastAsia=', ea), concat('ascii=', asc_), CASE WHEN n % 7 = 0 THEN 'bold' END, CASE WHEN n % 5 = 0 THEN 'italic' END, CASE WHEN n = 2 THEN 'sup' END,
    u1, u2, string_split(u3, '=')[1], string_split(u4, '=')[1], string_split(u5, '=')[1], u6], lambda x: x IS NOT NULL)) AS entry FROM {o_prop_rows} WHERE n > 0) e GROUP BY entry""",
}


SQL |= {
    "import_exams": f"""WITH imp AS (SELECT t.exam_id, t.position, t.item_type FROM {{o_items}} t JOIN (SELECT choice_set_id FROM {{choice_set_items}} GROUP BY 1 HAVING count(*) = 5) s ON s.choice_set_id = t.choice_set_id WHERE t.exam_id % 2 = 1 OR t.item_type IS NOT NULL),
per AS (SELECT exam_id, count(*) FILTER (WHERE item_type IS NOT NULL) AS n_items, bool_or(item_type IS NULL) AS refused FROM imp GROUP BY exam_id),
st AS (SELECT i.exam_id, count(*) AS n_stats, max(x.n) AS n, sum(CAST(r.n_correct AS DOUBLE) / x.n) AS sum_p FROM imp i JOIN per p ON p.exam_id = i.exam_id AND NOT p.refused JOIN {{table_rows}} r ON r.exam_id = i.exam_id AND r.position = i.position JOIN {{exam_totals}} x ON x.exam_id = i.exam_id GROUP BY i.exam_id)
SELECT e.id AS exam_id, CASE WHEN st.exam_id IS NOT NULL THEN 'imported' WHEN per.refused THEN 'draft' ELSE 'finalized' END AS status, st.n AS n_examinees, nullif(per.n_items, 0) AS n_items, st.n_stats, {r('st.sum_p', 'sum_p')}
FROM {{exams}} e LEFT JOIN per ON per.exam_id = e.id LEFT JOIN st ON st.exam_id = e.id""",
    "choice_emphasis": _EMPHASIS.replace("{src}", "{o_items}") + " UNION ALL SELECT t.exam_id, t.position, 'emphasis_in_choice', false FROM {o_items} t JOIN {choice_set_items} s ON s.choice_set_id = t.choice_set_id WHERE s.choice_set_id % 4 = 0 AND s.item_no = 3",
    "bank_filters": "WITH live AS (SELECT * FROM {o_cand} WHERE status <> 'retired') " + " UNION ALL ".join(
        f"SELECT '{name}' AS condition, question_id FROM {src} WHERE {rule}" for name, src, rule in (
            ("tag", "live", "list_contains(string_split(tags, ','), 'Brand#13')"), ("type", "live", "item_type = 'X2'"), ("negative", "live", "negative"), ("plain", "live", "NOT negative"), ("p_max", "live", "p <= 0.4"), ("disc", "live", "disc >= 0.3"),
            ("flag", "live", "list_contains(string_split(flags, ','), 'no_stats')"), ("year", "live", "last_exam_year = 1998"), ("unused", "live", "last_exam_year IS NULL"), ("set", "live", "choice_set_id = 7"), ("retired", "{o_cand}", "true"),
            ("several", "live", "item_type = 'X3' AND p BETWEEN 0.1 AND 0.8 AND NOT negative AND status <> 'draft'"),
        )
    ),
}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql, MORE) for name, sql in SQL.items()}


