"""Captures and a dated list derived from ``pages``, and the SQL form of the temporal list join.

``pages`` has neither fetch times nor a list.  Pages are fetched on a day that follows from their number; hosts, their parent
domains and first path parts are listed, removed and listed again on days that follow from the hash of their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.url_filters import PATH, host_of

#: (list, name hashed, pattern, action, days after the first day, condition); x<n> is the n-th byte of the hash of the name.
RULES = (
    ("a", "host", "host", "add", "x1", "x0 < 96"),
    ("a", "host", "host", "remove", "x1 + 60", "x0 < 96 and x2 < 128"),
    ("a", "host", "host", "add", "x1 + 150", "x0 < 96 and x2 < 64"),
    ("b", "host", "parent", "add", "x4", "x3 < 8 and parent <> ''"),
    ("b", "host", "parent", "remove", "x4 + 30", "x3 < 8 and parent <> ''"),
    ("b", "part", "part", "add", "x1", "x0 < 64 and part <> ''"),
)


def captures(pages: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 400).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def entries(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    first = F.get(F.filter(F.split(F.regexp_extract("url", PATH, 1), "/"), lambda x: x != ""), F.lit(0))
    names = pages.select(host.alias("host"), F.concat(host, F.lit("/"), first).alias("part")).where("host <> ''").distinct()
    names = names.withColumn("parent", F.expr("case when size(split(host, '[.]')) > 2 then substr(host, instr(host, '.') + 1) else '' end"))
    out = None
    for name, hashed, pattern, action, day, condition in RULES:
        byte = {f"x{i}": F.conv(F.substring(F.md5(hashed), 2 * i + 1, 2), 16, 10).cast("int") for i in range(5)}
        rows = names.withColumns(byte).where(condition).select(
            F.lit(name).alias("list"), F.col(pattern).alias("pattern"), F.lit(action).alias("action"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.expr(day)).alias("at"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _sql() -> str:
    byte = lambda of, i: f"('0x' || substr(md5({of}), {2 * i + 1}, 2))::INT"
    logs = " UNION ".join(
        f"""SELECT '{name}' AS list, {pattern} AS pattern, '{action}' AS action, DATE '2024-01-01' + ({day}) AS day
        FROM (SELECT *, {', '.join(f'{byte(hashed, i)} AS x{i}' for i in range(5))} FROM names) WHERE {condition}"""
        for name, hashed, pattern, action, day, condition in RULES
    )
    return f"""
WITH parsed AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 400)::INT AS fetched,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.+$', '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages
), names AS (
  SELECT DISTINCT host, host || '/' || parts[1] AS part,
    CASE WHEN len(string_split(host, '.')) > 2 THEN substr(host, instr(host, '.') + 1) ELSE '' END AS parent
  FROM parsed WHERE host <> ''
), log AS ({logs}
), once AS (SELECT list, pattern, day, min(action) = 'add' AND max(action) = 'add' AS adds FROM log WHERE pattern IS NOT NULL GROUP BY ALL
), ranked AS (SELECT *, lag(adds, 1, false) OVER (PARTITION BY list, pattern ORDER BY day) AS before FROM once
), spans AS (
  SELECT list, pattern, adds, day AS valid_from, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS valid_to
  FROM ranked WHERE adds <> before
), asked AS (
  SELECT DISTINCT page_id, fetched, unnest(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS pattern
  FROM parsed WHERE host <> ''
), found AS (
  SELECT page_id, count(*) AS n_active, first(s.pattern ORDER BY length(s.pattern) DESC, s.pattern) AS matched
  FROM asked a JOIN spans s ON a.pattern = s.pattern AND s.adds AND s.valid_from <= a.fetched AND (s.valid_to IS NULL OR a.fetched < s.valid_to)
  GROUP BY page_id
)
SELECT page_id, url, fetched, coalesce(n_active, 0)::BIGINT AS n_active, matched, matched IS NOT NULL AS blocked
FROM parsed LEFT JOIN found USING (page_id)"""


ORACLE = _sql()
