"""The star-schema tables seen as an item bank: one SQL text per view, used by Spark and by oracles alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from itemlake.functions.columns import BLANK, OTHER, PATTERNS

_TABLES = ("part", "lineitem", "documents", "pages")

VIEWS = {
    "patterns": "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{p}', {0 if p in (BLANK, OTHER) else len(p)})" for k, p in enumerate([*PATTERNS, BLANK, OTHER])) + ") AS t(k, pattern, size)",
    "q_ids": "SELECT DISTINCT p_partkey % 200 AS question_id FROM {part}",
    "question_versions": """
SELECT q.question_id * 10 + v.version_no AS id, q.question_id, v.version_no, q.question_id % 40 AS choice_set_id,
  CASE (q.question_id + v.version_no) % 5 WHEN 0 THEN '12345' WHEN 1 THEN '31524' WHEN 2 THEN '54321' WHEN 3 THEN '24135' ELSE '45123' END AS choice_order,
  p.pattern AS correct,
  concat('Q', q.question_id, CASE WHEN q.question_id % 7 = 0 THEN '酸に溶け<strong>ない</strong>' WHEN q.question_id % 11 = 0 THEN '含まれない' ELSE '硬い' END,
    'のはどれか。', CASE WHEN q.question_id % 9 = 0 THEN 'すべて選べ。' ELSE concat(p.size, 'つ選べ。') END) AS stem_html
FROM {q_ids} q CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3)) AS t(version_no)) v JOIN {patterns} p ON p.k = q.question_id % 31""",
    "questions": """
SELECT question_id AS id, CASE WHEN question_id % 17 = 1 THEN 'draft' WHEN question_id % 23 = 1 THEN 'retired' ELSE 'active' END AS status,
  CASE WHEN question_id % 4 <> 0 THEN CAST(floor(question_id / 3) AS BIGINT) * 10 + 1 END AS derived_from FROM {q_ids}""",
    "question_tags": "SELECT DISTINCT p_partkey % 200 AS question_id, p_brand AS tag FROM {part}",
    "choice_set_items": "SELECT CAST(floor(p_partkey / 5) AS BIGINT) AS choice_set_id, p_partkey % 5 + 1 AS item_no, p_name AS text_html FROM {part}",
    "responses": """
SELECT exam_id, examinee_id, question_id, question_id * 10 + CASE WHEN exam_id < 1997 THEN 1 WHEN exam_id < 2000 THEN 2 ELSE 3 END AS qversion_id,
  CASE WHEN (examinee_id * 3 + line_no * 5 + question_id) % 10 < 3 + question_id % 6 THEN (question_id + CASE WHEN question_id % 21 = 5 THEN 7 ELSE 0 END) % 31
       ELSE (supp * 7 + line_no) % 33 END AS k
FROM (SELECT year(l_shipdate) AS exam_id, l_orderkey AS examinee_id, l_partkey % 200 AS question_id, l_suppkey AS supp, l_linenumber AS line_no FROM {lineitem}) r""",
    "item_pattern_counts": """
SELECT r.exam_id, r.qversion_id, p.pattern, count(*) AS cnt FROM {responses} r JOIN {patterns} p ON p.k = r.k GROUP BY r.exam_id, r.qversion_id, p.pattern""",
    "exams": "SELECT DISTINCT exam_id AS id, concat(exam_id, '-08-25') AS exam_date, 'imported' AS status FROM {responses}",
    "exam_items": """
SELECT i.exam_id, row_number() OVER (PARTITION BY i.exam_id ORDER BY i.qversion_id) AS position, i.qversion_id, v.correct AS correct_asked
FROM (SELECT DISTINCT exam_id, qversion_id FROM {responses}) i JOIN {question_versions} v ON v.id = i.qversion_id""",
    "item_disc": """
SELECT i.exam_id, i.qversion_id, CAST(CASE WHEN i.question_id % 13 = 0 THEN i.exam_id % 3 ELSE (i.question_id * 13 + i.exam_id * 7) % 35 - 6 END AS DOUBLE) / 34 AS disc
FROM (SELECT DISTINCT exam_id, qversion_id, question_id FROM {responses}) i""",
    "exam_scores": "SELECT r.exam_id, r.examinee_id, sum(CASE WHEN r.k = r.question_id % 31 THEN 1 ELSE 0 END) AS score FROM {responses} r GROUP BY r.exam_id, r.examinee_id",
    "stats_rows": """
SELECT e.exam_id, e.position, e.qversion_id, CASE WHEN e.position % 19 = 0 THEN 'a' ELSE e.correct_asked END AS correct,
  round(CAST(sum(CASE WHEN c.pattern = e.correct_asked THEN c.cnt ELSE 0 END) AS DOUBLE) / sum(c.cnt), 3) + CASE WHEN e.position % 29 = 0 THEN 0.01 ELSE 0 END AS p_reported,
  CASE WHEN e.position % 31 = 0 THEN '全員正解' ELSE 'none' END AS adjustment, sum(c.cnt) AS total
FROM {exam_items} e JOIN {item_pattern_counts} c ON c.exam_id = e.exam_id AND c.qversion_id = e.qversion_id GROUP BY e.exam_id, e.position, e.qversion_id, e.correct_asked""",
    # frequency tables as they come from a marking system: all items of an exam have one total, some have no options
    "item_totals": "SELECT exam_id, qversion_id, CAST(sum(cnt) AS BIGINT) AS total FROM {item_pattern_counts} GROUP BY exam_id, qversion_id",
    "exam_totals": "SELECT exam_id, max(total) AS n FROM {item_totals} GROUP BY exam_id",
    "table_counts": """
SELECT e.exam_id, e.position, p.pattern, CAST(coalesce(c.cnt, 0) + CASE WHEN p.pattern = '' THEN n.n - t.total ELSE 0 END AS BIGINT) AS cnt
FROM {exam_items} e CROSS JOIN {patterns} p JOIN {item_totals} t ON t.exam_id = e.exam_id AND t.qversion_id = e.qversion_id JOIN {exam_totals} n ON n.exam_id = e.exam_id
LEFT JOIN {item_pattern_counts} c ON c.exam_id = e.exam_id AND c.qversion_id = e.qversion_id AND c.pattern = p.pattern""",
    "table_rows": """
SELECT e.exam_id, e.position, CASE WHEN e.position % 25 = 0 THEN '記述式' ELSE e.correct_asked END AS correct, e.position % 25 = 0 AS free,
  CASE WHEN e.exam_id % 3 = 0 AND e.position % 40 = 3 THEN 'x' WHEN e.exam_id % 3 = 0 AND e.position % 40 = 5 THEN '-2' WHEN e.exam_id % 3 = 0 AND e.position % 40 = 7 THEN '0.5' END AS odd,
  c.cnt AS n_correct, CAST(floor(c.cnt * 1000 / n.n) AS BIGINT) AS permille, d.disc
FROM {exam_items} e JOIN {table_counts} c ON c.exam_id = e.exam_id AND c.position = e.position AND c.pattern = e.correct_asked JOIN {exam_totals} n ON n.exam_id = e.exam_id
JOIN {item_disc} d ON d.exam_id = e.exam_id AND d.qversion_id = e.qversion_id""",
}


def _needs(sql: str, views: dict[str, str] = VIEWS) -> list[str]:
    return [n for n in [*views, *_TABLES] if "{" + n + "}" in sql]


class Bank:
    """The views as DataFrames, made when asked for; `bank.item_pattern_counts` and so on, tables too."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self.made:
            if name in VIEWS:
                self.made[name] = self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in _needs(VIEWS[name])})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]


def with_views(body: str, more: dict[str, str] | None = None) -> str:
    """body after the CTEs of the views it names in braces (those in more included), and of those they need."""
    views = VIEWS | (more or {})
    order: list[str] = []

    def visit(sql: str) -> None:
        for n in _needs(sql, views):
            if n in views and n not in order:
                visit(views[n])
                order.append(n)

    visit(body)

    def named(sql: str) -> str:
        for n in [*views, *_TABLES]:
            sql = sql.replace("{" + n + "}", n)
        return sql.strip()

    ctes = ", ".join(f"{n} AS ({named(views[n])})" for n in order)
    body = named(body)
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
