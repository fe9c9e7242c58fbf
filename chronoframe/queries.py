"""The engine's queries over the driver's tables, and SQL that gives the same rows.

Doubles are rounded to six decimals and NaN is shown as null on both sides, as sums depend on
the order of their terms. The SQL of a query is None where SQL can't express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import BINARY, NAN
from .operators import labels as L
from .operators import multi as M
from .operators import writes as W
from .operators.joins import asof_join, join_series, joined_range, reduce_pairs
from .operators.outliers.detect import fenced_outliers, outliers
from .operators.ranges import last_sample, read_after, samples_at, scan, tail
from .plans.query import RangeQuery, aggregation, range_query
from .sources.json_bulk import parse_bulk
from .sources.tables import event_samples, event_series, lineitem_samples, millis, order_samples, read
from .streaming import rules as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

START, END = 1704500000000, 1705500000000
DAY = 86_400_000

EVENTS = "samples AS (SELECT key, ts, max_by(value, event_id) AS value FROM (SELECT event_type || ':' || user_id AS key, (epoch_us(ts) // 1000) AS ts, value, event_id FROM events WHERE ts IS NOT NULL AND value IS NOT NULL) GROUP BY key, ts)"
SERIES = "series AS (SELECT DISTINCT event_type || ':' || user_id AS key, event_type AS name, user_id::VARCHAR AS usr, 't' || (user_id % 3) AS tier FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"
PAIRS = "pairs AS (SELECT key, '__name__' AS label, name AS value FROM series UNION ALL SELECT key, 'user', usr FROM series UNION ALL SELECT key, 'tier', tier FROM series)"
ITEMS = "samples AS (SELECT l_returnflag || l_linestatus AS key, (epoch_us(l_shipdate) // 1000) AS ts, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
ORDERS = "samples AS (SELECT o_orderpriority AS key, (epoch_us(o_orderdate) // 1000) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


def shown(df: DataFrame) -> DataFrame:
    """Doubles rounded, NaN as null, and no negative zero."""
    return df.select(*[(F.round(F.when(~F.isnan(c), F.col(c)), 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: shown(f(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _scan(query: RangeQuery) -> Query:
    """A range query over the event series, of which only what the query asks for is read."""
    return lambda s, d: scan(event_samples(s, d, query), query)


def bucket(d: int, origin: int = 0, ts: str = "ts") -> str:
    return f"({ts} - ((({ts} - {origin}) % {d} + {d}) % {d}))"


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


# Range scans and filters

query("range_window", f"WITH {EVENTS} SELECT key, ts, {r6('value')} AS value FROM samples WHERE ts BETWEEN {START} AND {END}")(_scan(range_query(START, END)))
query("range_inverted", f"WITH {EVENTS} SELECT key, ts, {r6('value')} AS value FROM samples WHERE false")(_scan(range_query(END, START)))
query("range_relative", f"WITH {EVENTS} SELECT key, ts, {r6('value')} AS value FROM samples WHERE ts BETWEEN {END} - 259200000 AND {END} - 172800000")(_scan(range_query("-3d", "+1d", now=END)))
query("range_by_value", f"WITH {EVENTS} SELECT key, ts, {r6('value')} AS value FROM samples WHERE value BETWEEN 20 AND 30.5")(_scan(range_query(by_value=(20, 30.5))))
STAMPS = [820454400000 + 30 * DAY * i for i in range(20)]
query("range_by_ts", f"WITH {ITEMS} SELECT key, ts, {r6('value')} AS value FROM samples WHERE ts IN ({', '.join(map(str, STAMPS))}) AND ts <= {STAMPS[15]}")(lambda s, d, q=range_query("-", STAMPS[15], by_ts=STAMPS): scan(lineitem_samples(s, d, q), q))
query("point_lookup", f"WITH {ITEMS} SELECT key, ts, {r6('value')} AS value FROM samples WHERE ts IN ({STAMPS[1]}, {STAMPS[4]})")(lambda s, d: samples_at(lineitem_samples(s, d, range_query(by_ts=[STAMPS[1], STAMPS[4]])), [STAMPS[1], STAMPS[4]]))
query("range_count", f"WITH {EVENTS} SELECT key, ts, {r6('value')} AS value FROM samples WHERE ts >= {START} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts) <= 3")(_scan(range_query(START, count=3)))
query("revrange_count", f"WITH {EVENTS} SELECT key, ts, {r6('value')} AS value FROM samples WHERE ts <= {END} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) <= 3")(_scan(range_query("-", END, count=3, reverse=True)))
query("tail_n", f"WITH {EVENTS} SELECT key, ts, {r6('value')} AS value FROM samples QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) <= 2")(lambda s, d: tail(event_samples(s, d), 2))
query("get_last", f"WITH {EVENTS} SELECT key, max(ts) AS ts, {r6('max_by(value, ts)')} AS value FROM samples WHERE key = 'click:1' GROUP BY key")(lambda s, d: last_sample(event_samples(s, d, key="click:1")))
query("mget_last", f"WITH {EVENTS}, {SERIES} SELECT key, max(ts) AS ts, {r6('max_by(value, ts)')} AS value FROM samples JOIN series USING (key) WHERE name = 'view' AND tier = 't1' GROUP BY key")(
    lambda s, d: M.multi_get(event_samples(s, d), event_series(s, d), ['view{tier="t1"}'])
)
query("read_cursor", f"WITH {EVENTS} SELECT key, ts, {r6('value')} AS value FROM samples WHERE ts >= {START} AND value > 40 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts) <= 4")(lambda s, d: read_after(event_samples(s, d, range_query(START)), START, ">", 40, 4))
query("read_newest", f"WITH {EVENTS} SELECT key, max(ts) AS ts, {r6('max_by(value, ts)')} AS value FROM samples GROUP BY key")(lambda s, d: read_after(event_samples(s, d), "+"))

# Aggregators: value by SQL, and the test whether a bucket is reported

PAIR = "(SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pt, row_number() OVER (PARTITION BY key, b ORDER BY ts DESC) AS back FROM base WINDOW w AS (PARTITION BY key, b ORDER BY ts))"
RISE = "sum(greatest(coalesce(value - pv, 0), 0))"
AGG_SQL = {
    "avg": "avg(value)", "sum": "sum(value)", "count": "count(value)::DOUBLE", "countall": "count(*)::DOUBLE", "min": "min(value)", "max": "max(value)", "range": "max(value) - min(value)",
    "first": "min_by(value, ts)", "last": "max_by(value, ts)", "std.p": "stddev_pop(value)", "std.s": "coalesce(stddev_samp(value), 0)", "var.p": "var_pop(value)", "var.s": "coalesce(var_samp(value), 0)",
    "increase": RISE, "rate": f"{RISE} / 172800", "irate": "max(CASE WHEN back = 1 AND value >= pv THEN (value - pv) / ((ts - pt) / 1000.0) END)",
    "countif(> 50)": "count(*) FILTER (value > 50)::DOUBLE", "sumif(<= 25)": "coalesce(sum(value) FILTER (value <= 25), 0)", "share(>= 30)": "count(*) FILTER (value >= 30) / count(*)",
    "all(> 5)": "bool_and(value > 5)::INT::DOUBLE", "any(> 90)": "bool_or(value > 90)::INT::DOUBLE", "none(> 90)": "(NOT bool_or(value > 90))::INT::DOUBLE",
    "count(!= 0)": "count(*) FILTER (value <> 0)::DOUBLE", "sum(< 10)": "coalesce(sum(value) FILTER (value < 10), 0)",
}


def _agg_query(text: str, sql: str):
    word = text.split("(")[0].strip()
    name = word.replace(".", "_") + ("_where" if text.startswith(("count(", "sum(")) else "")
    column = {"count": "countif", "sum": "sumif"}.get(word, word) if "(" in text else word
    column = column.replace(".", "_")
    source = f"WITH {EVENTS}, base AS (SELECT *, {bucket(2 * DAY)} AS b FROM samples WHERE ts >= {START}) SELECT key, b AS ts, {r6(sql)} AS \"{column}\" FROM {PAIR} GROUP BY key, b"
    query(f"agg_{name}", source)(_scan(range_query(START, aggregate=aggregation([text], "2d"))))


for _text, _sql in AGG_SQL.items():
    _agg_query(_text, _sql)
query("agg_countnan", f"WITH {EVENTS}, base AS (SELECT key, {bucket(DAY)} AS b, value FROM samples) SELECT key, b AS ts, count(*)::DOUBLE AS countnan FROM base WHERE value > 60 GROUP BY key, b")(
    lambda s, d: scan(event_samples(s, d).withColumn("value", F.when(F.col("value") > 60, NAN).otherwise(F.col("value"))), range_query(aggregate=aggregation("countnan", "1d")))
)
query(
    "agg_skip_nan",
    f"WITH {EVENTS}, base AS (SELECT key, {bucket(DAY)} AS b, value, ts FROM samples) SELECT key, b AS ts, {r6('sum(value) FILTER (value <= 60)')} AS sum, count(*) FILTER (value <= 60)::DOUBLE AS count, {r6('max_by(value, ts) FILTER (value <= 60)')} AS last FROM base GROUP BY key, b HAVING count(*) FILTER (value <= 60) > 0",
)(lambda s, d: scan(event_samples(s, d).withColumn("value", F.when(F.col("value") > 60, NAN).otherwise(F.col("value"))), range_query(aggregate=aggregation("sum,count,last", "1d"))))
query("agg_multi", f"WITH {EVENTS}, base AS (SELECT key, {bucket(DAY)} AS b, value FROM samples) SELECT key, b AS ts, {r6('avg(value)')} AS avg, {r6('max(value)')} AS max, count(*)::DOUBLE AS count FROM base GROUP BY key, b")(
    _scan(range_query(aggregate=aggregation("avg,max,count", "1d")))
)
query("agg_align_start", f"WITH {EVENTS}, base AS (SELECT key, {bucket(DAY, START)} AS b, value FROM samples WHERE ts BETWEEN {START} AND {END}) SELECT key, b AS ts, {r6('sum(value)')} AS sum FROM base GROUP BY key, b")(
    _scan(range_query(START, END, aggregate=aggregation("sum", "1d", align="start")))
)
query("agg_align_end", f"WITH {EVENTS}, base AS (SELECT key, {bucket(DAY, END)} AS b, value FROM samples WHERE ts BETWEEN {START} AND {END}) SELECT key, b + {DAY // 2} AS ts, {r6('min(value)')} AS min FROM base GROUP BY key, b")(
    _scan(range_query(START, END, aggregate=aggregation("min", "1d", align="+", report="mid")))
)
query("agg_align_ts", f"WITH {EVENTS}, base AS (SELECT key, {bucket(7 * DAY, 12345)} AS b, value FROM samples) SELECT key, b + {7 * DAY} AS ts, {r6('avg(value)')} AS avg FROM base GROUP BY key, b")(
    _scan(range_query(aggregate=aggregation("avg", "1w", align=12345, report="end")))
)
query("agg_count_reverse", f"WITH {EVENTS}, base AS (SELECT key, {bucket(DAY)} AS b, value FROM samples) SELECT key, b AS ts, {r6('sum(value)')} AS sum FROM base GROUP BY key, b QUALIFY row_number() OVER (PARTITION BY key ORDER BY b DESC) <= 2")(
    _scan(range_query(count=2, reverse=True, aggregate=aggregation("sum", "1d")))
)
EMPTY_SQL = f"""WITH {EVENTS}, passed AS (SELECT * FROM samples WHERE value BETWEEN 5 AND 95), inside AS (SELECT * FROM passed WHERE ts BETWEEN {START} AND {END}),
ext AS (SELECT key, bool_or(ts < {START}) AS leads, bool_or(ts > {END}) AS trails, min(ts) FILTER (ts BETWEEN {START} AND {END}) AS lo, max(ts) FILTER (ts BETWEEN {START} AND {END}) AS hi FROM passed GROUP BY key),
lim AS (SELECT key, CASE WHEN leads THEN {START} ELSE lo END AS a, CASE WHEN trails THEN {END} ELSE hi END AS z FROM ext WHERE lo IS NOT NULL OR (leads AND trails)),
spine AS (SELECT key, unnest(range({bucket(DAY // 2, 0, 'a')}, {bucket(DAY // 2, 0, 'z')} + 1, {DAY // 2})) AS b FROM lim),
agg AS (SELECT key, {bucket(DAY // 2)} AS b, sum(value) AS sum, avg(value) AS avg, max_by(value, ts) AS last FROM inside GROUP BY 1, 2),
seed AS (SELECT key, max_by(value, ts) AS seed FROM passed WHERE ts < {START - START % (DAY // 2)} GROUP BY key)
SELECT key, b AS ts, {r6('coalesce(sum, 0)')} AS sum, {r6('avg')} AS avg, {r6('coalesce(last_value(last IGNORE NULLS) OVER (PARTITION BY key ORDER BY b), seed)')} AS last FROM spine LEFT JOIN agg USING (key, b) LEFT JOIN seed USING (key)"""
query("agg_empty_fill", EMPTY_SQL)(_scan(range_query(START, END, by_value=(5, 95), aggregate=aggregation("sum,avg,last", "12h", empty=True))))

# Selectors and many series

SELECTORS = {
    "eq": (["view"], "name = 'view'"),
    "list": (['{user=("1","2","3")}'], "usr IN ('1','2','3')"),
    "ne": (["click", 'tier!="t0"'], "name = 'click' AND tier <> 't0'"),
    "ne_list": (["click", "{user!=(1,2)}"], "name = 'click' AND usr NOT IN ('1','2')"),
    "regex": (['{__name__=~"(cl|vi).*"}'], "regexp_full_match(name, '(cl|vi).*')"),
    "regex_words": (['{__name__=~"click|view"}'], "name IN ('click','view')"),
    "not_regex": (["view", '{user!~"1.*"}'], "name = 'view' AND NOT regexp_full_match(usr, '1.*')"),
    "prefix": (["{__name__^=(cl,er)}"], "starts_with(name,'cl') OR starts_with(name,'er')"),
    "not_prefix": (["signup", "{user^~1}"], "name = 'signup' AND NOT starts_with(usr,'1')"),
    "absent": (["click", '{region=""}'], "name = 'click'"),
    "or": (['view{tier="t0" or user="4"}'], "name = 'view' AND (tier = 't0' OR usr = '4')"),
    "or_selectors": (['click{tier="t1"} or error{tier="t2"}'], "(name = 'click' AND tier = 't1') OR (name = 'error' AND tier = 't2')"),
}
for _name, (_texts, _sql) in SELECTORS.items():
    query(f"selector_{_name}", f"WITH {SERIES} SELECT key FROM series WHERE {_sql}")(lambda s, d, t=_texts: L.query_index(event_series(s, d), t))
query("mrange", f"WITH {EVENTS}, {SERIES} SELECT key, ts, {r6('value')} AS value FROM samples JOIN series USING (key) WHERE name = 'click' AND ts BETWEEN {START} AND {END}")(
    lambda s, d, q=range_query(START, END): M.multi_range(event_samples(s, d, q), event_series(s, d), ["click"], q)
)
query("mrevrange_agg_count", f"WITH {EVENTS}, {SERIES} SELECT key, {bucket(DAY)} AS ts, {r6('avg(value)')} AS avg FROM samples JOIN series USING (key) WHERE tier = 't2' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY {bucket(DAY)} DESC) <= 2")(
    lambda s, d: M.multi_range(event_samples(s, d), event_series(s, d), ['{tier="t2"}'], range_query(count=2, reverse=True, aggregate=aggregation("avg", "1d")))
)
query("mrange_keep_empty", f"WITH {EVENTS}, {SERIES} SELECT key, ts, {r6('value')} AS value FROM series LEFT JOIN (SELECT * FROM samples WHERE value > 150) USING (key) WHERE name = 'view'")(
    lambda s, d: M.multi_range(event_samples(s, d), event_series(s, d), ["view"], range_query(by_value=(150.000001, 1e12)), keep_empty=True)
)
query("mrange_labels", f"WITH {EVENTS}, {SERIES} SELECT key, count(*) AS n, any_value(tier) AS tier, '' AS region FROM samples JOIN series USING (key) WHERE name = 'error' GROUP BY key")(
    lambda s, d: M.with_labels(M.multi_range(event_samples(s, d), event_series(s, d), ["error"], range_query()), event_series(s, d), ["tier", "region"])
    .groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("labels")["tier"]).alias("tier"), F.first(F.col("labels")["region"]).alias("region"))
)
GROUP = f"WITH {EVENTS}, {SERIES}, b AS (SELECT key, tier, {bucket(DAY)} AS b, avg(value) AS avg FROM samples JOIN series USING (key) WHERE name = 'view' GROUP BY 1, 2, 3)"
for _name, _sql in {"sum": "sum(avg)", "max": "max(avg)", "count": "count(avg)::DOUBLE", "std.p": "stddev_pop(avg)", "range": "max(avg) - min(avg)", "countif(> 50)": "count(*) FILTER (avg > 50)::DOUBLE"}.items():
    query(f"group_{_name.split('(')[0].replace('.', '_')}", f"{GROUP} SELECT 'tier=' || tier AS \"group\", b AS ts, {r6(_sql)} AS avg FROM b GROUP BY 1, 2")(
        lambda s, d, n=_name: M.group_range(event_samples(s, d), event_series(s, d), ["view"], range_query(aggregate=aggregation("avg", "1d")), "tier", n)
    )
query(
    "group_multi_sources",
    f"WITH {EVENTS}, {SERIES}, b AS (SELECT key, tier, {bucket(DAY)} AS b, avg(value) AS avg, max(value) AS max FROM samples JOIN series USING (key) WHERE name = 'view' GROUP BY 1, 2, 3), src AS (SELECT tier, string_agg(key, ',' ORDER BY key) AS source FROM series WHERE name = 'view' GROUP BY tier) SELECT 'tier=' || b.tier AS \"group\", b AS ts, {r6('min(avg)')} AS avg, {r6('min(max)')} AS max, any_value(source) AS source, 'min' AS reducer FROM b JOIN src ON src.tier = b.tier GROUP BY b.tier, b QUALIFY row_number() OVER (PARTITION BY b.tier ORDER BY b) <= 5",
)(lambda s, d: M.group_range(event_samples(s, d), event_series(s, d), ["view"], range_query(count=5, aggregate=aggregation("avg,max", "1d")), "tier", "min", sources=True))
query(
    "nrange_pivot",
    f"WITH {ITEMS}, t AS (SELECT DISTINCT ts FROM samples WHERE key IN ('AF','NF','RF')) SELECT t.ts AS ts, {r6('a.value')} AS v0, {r6('n.value')} AS v1, {r6('r.value')} AS v2, {r6('a.value')} AS v3 FROM t LEFT JOIN samples a ON a.ts = t.ts AND a.key = 'AF' LEFT JOIN samples n ON n.ts = t.ts AND n.key = 'NF' LEFT JOIN samples r ON r.ts = t.ts AND r.key = 'RF'",
)(lambda s, d: M.pivot(lineitem_samples(s, d, keys=["AF", "NF", "RF"]), ["AF", "NF", "RF", "AF"], range_query()))
query(
    "nrevrange_agg",
    f"WITH {ITEMS}, b AS (SELECT key, {bucket(30 * DAY)} AS b, avg(value) AS avg, count(*)::DOUBLE AS n FROM samples WHERE key IN ('AF','NO') GROUP BY 1, 2) SELECT b AS ts, {r6('max(avg) FILTER (key = $$NO$$)')} AS v0_avg, max(n) FILTER (key = 'NO') AS v0_count, {r6('max(avg) FILTER (key = $$AF$$)')} AS v1_avg, max(n) FILTER (key = 'AF') AS v1_count FROM b GROUP BY b ORDER BY b DESC LIMIT 40",
)(lambda s, d: M.pivot(lineitem_samples(s, d, keys=["NO", "AF"]), ["NO", "AF"], range_query(count=40, reverse=True, aggregate=aggregation("avg,count", "30d"))))
query("merge_streams", f"WITH {ITEMS} SELECT key, ts, {r6('value')} AS value, CASE key WHEN 'AF' THEN 0 ELSE 1 END AS source FROM samples WHERE key IN ('AF','NF')")(
    lambda s, d: M.merge_streams(*(lineitem_samples(s, d, keys=[k]).where(F.col("key") == k) for k in ("AF", "NF")))
)
for _name, _not in (("has_samples", False), ("lacks_samples", True)):
    query(f"series_{_name}", f"WITH {EVENTS}, {SERIES} SELECT key FROM series WHERE name = 'error' AND key {'NOT ' if _not else ''}IN (SELECT key FROM samples WHERE ts BETWEEN {START} AND {START + DAY})")(
        lambda s, d, n=_not: M.having_samples(M.select_series(event_series(s, d), ["error"]), event_samples(s, d, range_query(START, START + DAY)), range_query(START, START + DAY), n).select("key")
    )

# Joins


def _pair(spark: SparkSession, sf_dir: str, a: str = "AF", b: str = "NF") -> tuple[DataFrame, DataFrame]:
    return tuple(lineitem_samples(spark, sf_dir, keys=[k]).where(F.col("key") == k).select("ts", "value") for k in (a, b))


AB = f"WITH {ITEMS}, a AS (SELECT ts, value FROM samples WHERE key = 'AF'), b AS (SELECT ts, value FROM samples WHERE key = 'NF')"
for _kind in ("inner", "left", "right", "full"):
    query(f"join_{_kind}", f"{AB} SELECT coalesce(a.ts, b.ts) AS ts, {r6('a.value')} AS left_value, {r6('b.value')} AS right_value FROM a {_kind} JOIN b ON a.ts = b.ts")(lambda s, d, k=_kind: join_series(*_pair(s, d), k))
query("join_semi", f"{AB} SELECT ts, {r6('value')} AS value FROM a WHERE ts IN (SELECT ts FROM b)")(lambda s, d: join_series(*_pair(s, d), "semi"))
query("join_anti", f"{AB} SELECT ts, {r6('value')} AS value FROM a WHERE ts NOT IN (SELECT ts FROM b)")(lambda s, d: join_series(*_pair(s, d), "anti"))
query("join_count", f"{AB} SELECT a.ts AS ts, {r6('a.value')} AS left_value, {r6('b.value')} AS right_value FROM a LEFT JOIN b ON a.ts = b.ts ORDER BY a.ts DESC LIMIT 7")(lambda s, d: joined_range(*_pair(s, d), range_query(count=7, reverse=True), "left"))
query("join_reduce_agg", f"{AB} SELECT {bucket(30 * DAY, 0, 'a.ts')} AS ts, {r6('max(a.value - b.value)')} AS max FROM a JOIN b ON a.ts = b.ts GROUP BY 1")(lambda s, d: joined_range(*_pair(s, d), range_query(), "inner", "sub", aggregation("max", "30d")))
query("join_anti_agg", f"{AB} SELECT {bucket(30 * DAY)} AS ts, count(*)::DOUBLE AS count FROM a WHERE ts NOT IN (SELECT ts FROM b) GROUP BY 1")(lambda s, d: joined_range(*_pair(s, d), range_query(), "anti", None, aggregation("count", "30d")))

OP_SQL = {
    "abs_diff": "abs(l - r)", "avg": "(l + r) / 2", "cmp": "CASE WHEN r IS NULL THEN 1 WHEN l IS NULL THEN -1 WHEN l < r THEN -1 WHEN l > r THEN 1 ELSE 0 END", "coalesce": "coalesce(l, r)", "div": "CASE WHEN r = 0 THEN NULL ELSE l / r END",
    "mod": "CASE WHEN r = 0 THEN NULL ELSE l - r * trunc(l / r) END", "mul": "l * r", "pow": "pow(l, r / 10)", "sub": "l - r", "sum": "l + r", "min": "least(l, r)", "max": "greatest(l, r)",
    "eq": "CASE WHEN l = r OR (l IS NULL AND r IS NULL) THEN l END", "ne": "CASE WHEN l IS DISTINCT FROM r THEN l END", "gt": "CASE WHEN l > r THEN l END", "gte": "CASE WHEN l >= r THEN l END", "lt": "CASE WHEN l < r THEN l END", "lte": "CASE WHEN l <= r THEN l END",
    "pct_change": "CASE WHEN l = 0 THEN 0 ELSE (r - l) / l END", "sgn_diff": "CASE WHEN l - r < 0 THEN -1 WHEN l - r >= 0 THEN 1 END",
}
for _op, _sql in OP_SQL.items():
    query(f"reduce_{_op}", f"{AB}, p AS (SELECT coalesce(a.ts, b.ts) AS ts, a.value - 25 AS l, b.value - 25 AS r FROM a FULL JOIN b ON a.ts = b.ts) SELECT ts, {r6(f'({_sql})::DOUBLE') if _op != 'pow' else r6('CASE WHEN l = 1 OR r = 0 THEN 1 WHEN l >= 0 THEN pow(l, r / 10) END')} AS value FROM p")(
        lambda s, d, op=_op: reduce_pairs(
            join_series(*_pair(s, d), "full").withColumns({"left_value": F.col("left_value") - 25, "right_value": (F.col("right_value") - 25) / (10 if op == "pow" else 1)}).withColumn("left_value", F.when((F.col("left_value") >= 0) | F.lit(op != "pow"), F.col("left_value"))), op
        )
    )
assert set(OP_SQL) == set(BINARY)


def _by_user(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    s = event_samples(spark, sf_dir, kind=kind)
    return s.select(F.split_part("key", F.lit(":"), F.lit(2)).alias("user"), "ts", "value")


USERS = f"WITH {EVENTS}, u AS (SELECT split_part(key, ':', 1) AS name, split_part(key, ':', 2) AS usr, ts, value FROM samples), a AS (SELECT usr, ts, value FROM u WHERE name = 'click'), b AS (SELECT usr, ts, value FROM u WHERE name = 'view')"
SHOW = f"a.usr AS \"user\", a.ts AS ts, {r6('a.value')} AS left_value, b.ts AS right_ts, {r6('b.value')} AS right_value"
for _name, _sql, _args in (
    ("previous", f"SELECT {SHOW} FROM a ASOF JOIN b ON a.usr = b.usr AND a.ts >= b.ts", {}),
    ("next", f"SELECT {SHOW} FROM a ASOF JOIN b ON a.usr = b.usr AND a.ts <= b.ts", {"direction": "next"}),
    ("strict", f"SELECT {SHOW} FROM a ASOF JOIN b ON a.usr = b.usr AND a.ts > b.ts", {"exact": False}),
    ("tolerance", f"SELECT {SHOW} FROM a ASOF JOIN b ON a.usr = b.usr AND a.ts >= b.ts WHERE a.ts - b.ts <= 3600000", {"tolerance_ms": 3600000}),
    ("nearest", f"SELECT {SHOW} FROM a JOIN b ON a.usr = b.usr QUALIFY row_number() OVER (PARTITION BY a.usr, a.ts ORDER BY abs(a.ts - b.ts), b.ts DESC) = 1", {"direction": "nearest"}),
):
    query(f"asof_{_name}", f"{USERS} {_sql}")(lambda s, d, a=_args: asof_join(_by_user(s, d, "click"), _by_user(s, d, "view"), by=["user"], **a))
query("asof_unmatched", f"{USERS} SELECT {SHOW} FROM a ASOF LEFT JOIN b ON a.usr = b.usr AND a.ts >= b.ts")(lambda s, d: asof_join(_by_user(s, d, "click"), _by_user(s, d, "view"), by=["user"], keep_unmatched=True))

# Labels

query("label_names", "SELECT unnest(['__name__','tier','user']) AS value")(lambda s, d: L.query_labels(event_series(s, d)))
query("label_values", f"WITH {SERIES} SELECT DISTINCT tier AS value FROM series WHERE name = 'click'")(lambda s, d: L.query_labels(event_series(s, d), "tier", ["click"]))
query("card", f"WITH {SERIES} SELECT count(*) AS card FROM series WHERE tier = 't1'")(lambda s, d: L.cardinality(event_series(s, d), ['{tier="t1"}']))
query("search_names", f"WITH {SERIES}, {PAIRS} SELECT label AS value, 1.0::DOUBLE AS score, count(*) AS cardinality FROM pairs WHERE contains(label, 'er') GROUP BY label")(lambda s, d: L.search_labels(event_series(s, d), terms=["er"], sort_by="cardinality", descending=True))
query("search_values", f"WITH {SERIES} SELECT usr AS value, 1.0::DOUBLE AS score, count(*) AS cardinality FROM series WHERE name IN ('click','view') AND contains(usr, '1') GROUP BY usr ORDER BY usr LIMIT 8")(
    lambda s, d: L.search_labels(event_series(s, d), "user", terms=["1"], selectors=["{__name__=(click,view)}"], limit=8)
)
query("search_metrics_fuzzy", f"WITH {SERIES} SELECT name AS value, {r6('jaro_winkler_similarity(name, $$clack$$)')} AS score, count(*) AS cardinality FROM series WHERE jaro_winkler_similarity(name, 'clack') >= 0.6 GROUP BY name")(
    lambda s, d: L.search_metric_names(event_series(s, d), terms=["CLACK"], threshold=0.6, case_sensitive=False, sort_by="score", descending=True)
)
query("search_metrics_subsequence")(lambda s, d: L.search_metric_names(event_series(s, d), terms=["pch"], algorithm="subsequence", threshold=0.1, sort_by="score", descending=True))
query(
    "label_stats",
    f"""WITH {SERIES}, {PAIRS}, t AS (SELECT 'total' AS section, 'series' AS name, count(*) AS n FROM series UNION ALL SELECT 'total', 'labels', count(DISTINCT label) FROM pairs UNION ALL SELECT 'total', 'pairs', count(DISTINCT (label, value)) FROM pairs),
g AS (SELECT 'metric' AS section, value AS name, count(*) AS n FROM pairs WHERE label = '__name__' GROUP BY value UNION ALL SELECT 'label', label, count(*) FROM pairs GROUP BY label UNION ALL SELECT 'pair', label || '=' || value, count(*) FROM pairs GROUP BY label, value UNION ALL SELECT 'focus', value, count(*) FROM pairs WHERE label = 'tier' GROUP BY value)
SELECT * FROM t UNION ALL SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY section ORDER BY n DESC, name) <= 10""",
)(lambda s, d: L.label_stats(event_series(s, d), focus="tier"))

# Writes


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("key"), millis(F.col("o_orderdate")).alias("ts"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("arrival"))


ARRIVALS = "arr AS (SELECT o_orderpriority AS key, (epoch_us(o_orderdate) // 1000) AS ts, o_totalprice AS value, o_orderkey AS arrival FROM orders)"
for _policy, _sql in {"block": "min_by(value, arrival)", "first": "min_by(value, arrival)", "last": "max_by(value, arrival)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)"}.items():
    query(f"policy_{_policy}", f"WITH {ARRIVALS} SELECT key, ts, {r6(_sql)} AS value FROM arr GROUP BY key, ts")(lambda s, d, p=_policy: W.collapse(_arrivals(s, d), p))
query("merge_max", f"WITH {ARRIVALS} SELECT key, ts, {r6('max(value)')} AS value FROM arr GROUP BY key, ts")(
    lambda s, d: W.merge_samples(W.collapse(_arrivals(s, d).where("arrival % 2 = 0"), "max"), _arrivals(s, d).where("arrival % 2 = 1"), "max")
)
query("blocked_samples", f"WITH {ARRIVALS} SELECT key, ts, {r6('value')} AS value, arrival FROM arr WHERE arrival % 2 = 1 QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY arrival) > 1 OR (key, ts) IN (SELECT (key, ts) FROM arr WHERE arrival % 2 = 0)")(
    lambda s, d: W.blocked(W.collapse(_arrivals(s, d).where("arrival % 2 = 0"), "max"), _arrivals(s, d).where("arrival % 2 = 1"))
)
query("retention", f"WITH {EVENTS} SELECT key, ts, {r6('value')} AS value FROM samples QUALIFY ts >= max(ts) OVER (PARTITION BY key) - {5 * DAY}")(lambda s, d: W.retained(event_samples(s, d), 5 * DAY))
query("retention_gate", f"WITH {ARRIVALS} SELECT key, ts, {r6('value')} AS value, arrival, coalesce(ts >= max(ts) OVER (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {400 * DAY}, true) AS accepted FROM arr")(
    lambda s, d: W.retention_gate(_arrivals(s, d), 400 * DAY)
)
query(
    "ignore_repeats",
    f"""WITH RECURSIVE {EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i FROM samples),
r AS (SELECT key, i, ts, value, ts AS kept_ts, value AS kept, true AS stays FROM o WHERE i = 1 UNION ALL
SELECT key, i, ts, value, CASE WHEN stays THEN ts ELSE kept_ts END, CASE WHEN stays THEN value ELSE kept END, stays
FROM (SELECT o.*, kept_ts, kept, NOT (o.ts - kept_ts <= 43200000 AND abs(o.value - kept) <= 25) AS stays FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1))
SELECT key, ts, {r6('value')} AS value, ts AS arrival FROM r WHERE stays""",
)(lambda s, d: W.drop_repeats(event_samples(s, d).withColumn("arrival", F.col("ts")), 12 * 3_600_000, 25.0))
query(
    "increments",
    f"WITH {EVENTS}, st AS (SELECT * FROM samples WHERE ts < {START}), de AS (SELECT key, ts, value AS delta, row_number() OVER (PARTITION BY key ORDER BY ts) AS n FROM samples WHERE ts >= {START}), l AS (SELECT key, max_by(value, ts) AS v FROM st GROUP BY key) SELECT key, ts, {r6('coalesce(v, 0) + sum(delta) OVER (PARTITION BY key ORDER BY n)')} AS value FROM de LEFT JOIN l USING (key)",
)(lambda s, d: W.increments(event_samples(s, d, range_query("-", START - 1)), event_samples(s, d, range_query(START)).select("key", "ts", F.col("value").alias("delta"), F.col("ts").alias("arrival"))))
query("round_decimals", f"WITH {EVENTS} SELECT key, ts, round(value, 1) AS value FROM samples")(lambda s, d: W.rounded(event_samples(s, d), decimals=1))
query("round_significant", f"WITH {ORDERS} SELECT key, ts, CASE WHEN value = 0 THEN 0 ELSE {r6('round(value * pow(10.0, 2 - floor(log10(abs(value))))) / pow(10.0, 2 - floor(log10(abs(value))))')} END AS value FROM samples")(lambda s, d: W.rounded(order_samples(s, d), significant=3))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads made of each event series, every seventh broken."""
    s = event_samples(spark, sf_dir).groupBy("key").agg(F.collect_list(F.struct("ts", "value")).alias("s"))
    good = F.to_json(F.struct(F.transform("s", lambda x: x["value"]).alias("values"), F.transform("s", lambda x: x["ts"]).alias("timestamps")))
    return s.select("key", F.lit(0).cast("long").alias("arrival"), F.when(F.col("key").endswith("7"), '{"values": [1.0]}').otherwise(good).alias("payload"))


query(
    "bulk_json",
    f"WITH {EVENTS} SELECT key, CASE WHEN key LIKE '%7' THEN 'missing timestamps' WHEN count(*) > 1000 THEN 'too many samples' END AS error, CASE WHEN key LIKE '%7' OR count(*) > 1000 THEN 0 ELSE count(*) END AS n, CASE WHEN key NOT LIKE '%7' AND count(*) <= 1000 THEN {r6('sum(value)')} END AS total FROM samples GROUP BY key",
)(lambda s, d: parse_bulk(_payloads(s, d)).groupBy("key").agg(F.max("error").alias("error"), F.count("ts").alias("n"), F.sum("value").alias("total")))
query("delete_range", f"WITH {EVENTS} SELECT key, count(*) AS deleted FROM samples WHERE ts BETWEEN {START} AND {END} GROUP BY key")(lambda s, d: W.delete_range(event_samples(s, d), range_query(START, END))[1])
query("delete_matching", f"WITH {EVENTS}, {SERIES} SELECT key, ts, {r6('value')} AS value FROM samples JOIN series USING (key) WHERE NOT (tier = 't0' AND ts >= {END})")(
    lambda s, d: W.delete_range(event_samples(s, d), range_query(END), event_series(s, d), ['{tier="t0"}'])[0]
)
query("delete_series", f"WITH {EVENTS}, {SERIES} SELECT key, ts, {r6('value')} AS value FROM samples JOIN series USING (key) WHERE name <> 'view'")(lambda s, d: W.delete_series(event_series(s, d), event_samples(s, d), ["view"])[1])
query("series_info", f"WITH {EVENTS} SELECT key, count(*) AS total_samples, min(ts) AS first_ts, max(ts) AS last_ts, {r6('min_by(value, ts)')} AS first_value, {r6('max_by(value, ts)')} AS last_value FROM samples GROUP BY key")(
    lambda s, d: W.series_info(event_series(s, d), event_samples(s, d)).drop("labels")
)

# Down-sampling rules

KEY = "click:1"
OPEN = f"(SELECT {bucket(2 * DAY, 0, 'max(ts)')} FROM samples WHERE key = '{KEY}')"
query("rule_compact", f"WITH {EVENTS} SELECT 'd' AS key, {bucket(2 * DAY)} AS ts, {r6('avg(value)')} AS value FROM samples WHERE key = '{KEY}' GROUP BY 2 HAVING {bucket(2 * DAY)} < {OPEN}")(lambda s, d: R.compact(event_samples(s, d, key=KEY), R.rule(KEY, "d", "avg", "2d")))
query(
    "rule_chain",
    f"WITH {EVENTS}, d1 AS (SELECT {bucket(2 * DAY)} AS ts, avg(value) AS value FROM samples WHERE key = '{KEY}' GROUP BY 1 HAVING {bucket(2 * DAY)} < {OPEN}), d2 AS (SELECT {bucket(6 * DAY)} AS ts, max(value) AS value FROM d1 GROUP BY 1 HAVING {bucket(6 * DAY)} < (SELECT {bucket(6 * DAY, 0, 'max(ts)')} FROM d1)) SELECT 'd1' AS key, ts, {r6('value')} AS value FROM d1 UNION ALL SELECT 'd2', ts, {r6('value')} FROM d2",
)(lambda s, d: R.compact_all(event_samples(s, d, key=KEY), [R.rule("d1", "d2", "max", "6d"), R.rule(KEY, "d1", "avg", "2d")]))
query("rule_latest", f"WITH {EVENTS} SELECT 'd' AS key, {bucket(2 * DAY)} AS ts, {r6('sum(value)')} AS value FROM samples WHERE key = '{KEY}' GROUP BY 2")(
    lambda s, d: R.latest(R.compact(event_samples(s, d, key=KEY), R.rule(KEY, "d", "sum", "2d")), event_samples(s, d, key=KEY), R.rule(KEY, "d", "sum", "2d"))
)


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = event_samples(spark, sf_dir, key=KEY), R.rule(KEY, "d", "max", "2d")
    late = F.pmod("ts", F.lit(5)) == 0
    before = R.compact(s.where(~late), r)
    return R.refresh(before, s, s.where(late), r)


query("rule_late_data", f"WITH {EVENTS} SELECT 'd' AS key, {bucket(2 * DAY)} AS ts, {r6('max(value)')} AS value FROM samples WHERE key = '{KEY}' GROUP BY 2 HAVING {bucket(2 * DAY)} < {OPEN}")(_refreshed)

# Outliers

FENCE = "score AS (SELECT *, abs(value - c) AS e, CASE WHEN value >= c THEN hi - c ELSE c - lo END AS b FROM samples JOIN fence USING (key) WHERE n >= 3)"
SCORE = f"SELECT key, ts, {r6('value')} AS value, {r6('CASE WHEN e <= 0 OR b < 0 THEN 0 WHEN b = 0 THEN 1 ELSE e / (e + b) END')} AS score, CASE WHEN e > b AND b >= 0 THEN CASE WHEN value > c THEN 1 ELSE -1 END ELSE 0 END AS signal FROM score"
FENCES = {
    "zscore": "fence AS (SELECT key, count(*) AS n, avg(value) AS c, avg(value) - 3 * coalesce(stddev_samp(value), 0) AS lo, avg(value) + 3 * coalesce(stddev_samp(value), 0) AS hi FROM samples GROUP BY key)",
    "modified-zscore": "m AS (SELECT key, count(*) AS n, median(value) AS c FROM samples GROUP BY key), fence AS (SELECT key, any_value(n) AS n, any_value(c) AS c, any_value(c) - 3.5 / 0.6745 * median(abs(value - c)) AS lo, any_value(c) + 3.5 / 0.6745 * median(abs(value - c)) AS hi FROM samples JOIN m USING (key) GROUP BY key)",
    "mad": "m AS (SELECT key, count(*) AS n, median(value) AS c FROM samples GROUP BY key), fence AS (SELECT key, any_value(n) AS n, any_value(c) AS c, any_value(c) - 3 * median(abs(value - c)) AS lo, any_value(c) + 3 * median(abs(value - c)) AS hi FROM samples JOIN m USING (key) GROUP BY key)",
    "iqr": "m AS (SELECT key, count(*) AS n, list_sort(list(value)) AS v FROM samples GROUP BY key), q AS (SELECT key, n, v[n // 4 + 1] AS q1, v[3 * n // 4 + 1] AS q3 FROM m), fence AS (SELECT key, n, (q1 + q3) / 2 AS c, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)",
    "double-mad": "m AS (SELECT key, count(*) AS n, median(value) AS c FROM samples GROUP BY key), fence AS (SELECT key, any_value(n) AS n, any_value(c) AS c, any_value(c) - 3 * median(abs(value - c)) FILTER (value <= c) AS lo, any_value(c) + 3 * median(abs(value - c)) FILTER (value >= c) AS hi FROM samples JOIN m USING (key) GROUP BY key)",
}
for _method in ("zscore", "modified-zscore", "mad", "double-mad", "iqr"):
    query(f"outliers_{_method.replace('-', '_')}", f"WITH {EVENTS}, {FENCES[_method]}, {FENCE} {SCORE}")(lambda s, d, m=_method: fenced_outliers(event_samples(s, d), range_query(), m))
query("outliers_double_mad_batch", f"WITH {EVENTS}, {FENCES['double-mad']}, {FENCE} {SCORE}")(lambda s, d: outliers(event_samples(s, d), range_query(), "double-mad"))
query("outliers_iqr_simple", f"WITH {EVENTS}, {FENCES['iqr']}, {FENCE} SELECT * FROM ({SCORE}) WHERE signal = 1")(lambda s, d: fenced_outliers(event_samples(s, d), range_query(), "iqr", direction="positive", output="simple"))
query("outliers_mad_cleaned", f"WITH {EVENTS}, {FENCES['mad']}, {FENCE} SELECT key, ts, value FROM ({SCORE}) WHERE signal = 0")(lambda s, d: outliers(event_samples(s, d), range_query(), "mad", output="cleaned"))
# the recursions step by step: o has the samples in order, base the mean and deviation of the first half, of 100 at most
STEPS = f"""WITH RECURSIVE {EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i, count(*) OVER (PARTITION BY key) AS n FROM samples),
base AS (SELECT key, avg(value) AS t, coalesce(stddev_samp(value), 0) AS s FROM o WHERE i <= least(n // 2, 100) GROUP BY key), x AS (SELECT * FROM o JOIN base USING (key) WHERE n >= 3)"""
SHOWN = f"key, ts, {r6('value')} AS value, {r6('CASE WHEN e > 0 AND b >= 0 THEN CASE WHEN b = 0 THEN 1.0 ELSE e / (e + b) END ELSE 0.0 END')} AS score"
RECURSIONS = {
    "cusum": f"""{STEPS}, d AS (SELECT key, i, CASE WHEN s > 2.220446049250313e-16 THEN (value - t) / s END AS d FROM x),
r AS (SELECT key, i, greatest(0, d - 0.5) AS up, greatest(0, -d - 0.5) AS down FROM d WHERE i = 1 AND d IS NOT NULL UNION ALL SELECT d.key, d.i, greatest(0, up + d - 0.5), greatest(0, down - d - 0.5) FROM r JOIN d ON d.key = r.key AND d.i = r.i + 1)
SELECT {SHOWN}, CASE WHEN up > 5 THEN 1 WHEN down > 5 THEN -1 ELSE 0 END AS signal FROM (SELECT x.*, up, down, coalesce(greatest(up, down), 0) AS e, 5.0 AS b FROM x LEFT JOIN r USING (key, i))""",
    "ewma": f"""{STEPS}, r AS (SELECT key, i, 0.3 * value + 0.7 * t AS level FROM x WHERE i = 1 UNION ALL SELECT x.key, x.i, 0.3 * value + 0.7 * level FROM r JOIN x ON x.key = r.key AND x.i = r.i + 1)
SELECT {SHOWN}, CASE WHEN e > b THEN sign(level - t)::INT ELSE 0 END AS signal FROM (SELECT x.*, level, abs(level - t) AS e, nullif(greatest(3 * sqrt(s * s * 0.3 / 1.7 * (1 - pow(0.7, 2 * i))), 2.220446049250313e-16), 2.220446049250313e-16) AS b FROM x JOIN r USING (key, i))""",
    # a signal has no influence: the value before it goes on in the window of ten
    "smoothed-zscore": f"""{STEPS}, w AS (SELECT key, list(value ORDER BY i) AS w FROM x WHERE n > 10 AND i <= 10 GROUP BY key),
r AS (SELECT key, 10::BIGINT AS i, w, w[10] AS kept, 0.0::DOUBLE AS e, 0.0::DOUBLE AS b, 0 AS signal FROM w UNION ALL
SELECT key, i, list_append(w[2:10], CASE WHEN e > b THEN kept ELSE value END), CASE WHEN e > b THEN kept ELSE value END, e, b, CASE WHEN e > b THEN CASE WHEN value > m THEN 1 ELSE -1 END ELSE 0 END
FROM (SELECT x.key, x.i, w, kept, value, list_avg(w) AS m, abs(value - list_avg(w)) AS e, 3.5 * list_stddev_pop(w) AS b FROM r JOIN x ON x.key = r.key AND x.i = r.i + 1))
SELECT {SHOWN}, coalesce(signal, 0) AS signal FROM x LEFT JOIN (SELECT * FROM r WHERE i > 10) USING (key, i)""",
}
for _method in ("cusum", "ewma", "smoothed-zscore", "esd", "rcf"):
    query(f"outliers_{_method.replace('-', '_')}", RECURSIONS.get(_method))(lambda s, d, m=_method: outliers(event_samples(s, d), range_query(), m))
query("outliers_seasonal")(lambda s, d: outliers(scan(order_samples(s, d), range_query(aggregate=aggregation("sum", "7d", empty=True))).withColumnRenamed("sum", "value"), range_query(), "modified-zscore", seasonality=[52]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean of all event series."""
    return shown(scan(event_samples(spark, sf_dir), range_query(aggregate=aggregation("avg", 86_400_000))))
