"""The registered queries over the driver's tables, and the same in SQL.

What is edited is edited by expressions that both engines read alike.  The tables' keys and compared
texts are ASCII, which the queries say, so that no Python step is in their plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.config import DuplicatePolicy, KeyMapping, KeyOptions, NullPolicy, Rule, Tolerance, compare
from keyweave.functions import normalize, scalar
from keyweave.operators import dialect, mapping, profile, reconcile, views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rule(a: str, b: str | None = None, kind: str = "number", method: str = "exact", rule_id: str = "r1", **more) -> Rule:
    return Rule(rule_id, rule_id, a, b or a, kind, method, **more)


def run(a: DataFrame, b: DataFrame, keys, rules, **more) -> DataFrame:
    order = {k: more.pop(k) for k in ("order_a", "order_b", "with_trace", "key_only") if k in more}
    return reconcile.reconcile(a, b, compare(keys, rules, **more), assume_ascii=True, **order)


def outcome(result: DataFrame, *more) -> DataFrame:
    """Status and counts by key, and the first rule's status."""
    return result.select("key_display", "status", "a_count", "b_count", *more)


def first_rule(field: str) -> F.Column:
    return F.get(F.col("rules"), 0)[field].alias(f"r1_{field}")


# --- orders against an edited copy ------------------------------------------------------------------

_EDITED = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1.5 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey + 10000000, o_totalprice, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 13 = 0"


def edited_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    changed = orders.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1.5 ELSE o_totalprice END")).withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END"))
    added = orders.where("o_orderkey % 13 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return orders, changed.unionByName(added)


_PERTURBED = f"""
WITH b AS ({_EDITED}),
j AS (SELECT coalesce(CAST(a.o_orderkey AS VARCHAR), CAST(b.o_orderkey AS VARCHAR)) AS key_display, a.o_orderkey AS ka, b.o_orderkey AS kb,
             a.o_totalprice = b.o_totalprice AS p, a.o_orderstatus = b.o_orderstatus AS s, a.o_totalprice - b.o_totalprice AS d
      FROM orders a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey),
c AS (SELECT *, CASE WHEN kb IS NULL THEN 'A_ONLY' WHEN ka IS NULL THEN 'B_ONLY' WHEN p AND s THEN 'IDENTICAL' WHEN p OR s THEN 'PARTIAL_MISMATCH' ELSE 'FULL_MISMATCH' END AS status FROM j)
"""
_RULES = [rule("o_totalprice"), rule("o_orderstatus", kind="text", rule_id="r2")]


def perturbed(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    a, b = edited_orders(spark, sf_dir)
    return run(a, b, "o_orderkey", _RULES, **more)


_COUNTS = "CAST(ka IS NOT NULL AS BIGINT) AS a_count, CAST(kb IS NOT NULL AS BIGINT) AS b_count"


@query(f"{_PERTURBED} SELECT key_display, status, {_COUNTS}, round(d, 4) AS difference FROM c")
def recon_perturbed(spark, sf_dir):
    return outcome(perturbed(spark, sf_dir), F.round(first_rule("difference"), 4).alias("difference"))


for _join, _where in (("left", "ka IS NOT NULL"), ("right", "kb IS NOT NULL"), ("inner", "ka IS NOT NULL AND kb IS NOT NULL")):
    query(f"{_PERTURBED} SELECT key_display, status, {_COUNTS} FROM c WHERE {_where}", f"recon_{_join}")(lambda spark, sf_dir, how=_join: outcome(perturbed(spark, sf_dir, join_type=how)))

_TOTALS = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in {"total": "true", "comparable": "status NOT IN ('A_ONLY', 'B_ONLY')", "identical": "status = 'IDENTICAL'", "mismatch": "status IN ('PARTIAL_MISMATCH', 'FULL_MISMATCH')", "a_only": "status = 'A_ONLY'", "b_only": "status = 'B_ONLY'", "duplicate": "false", "conversion_failed": "false", "nm_pending": "false"}.items())


@query(f"{_PERTURBED} SELECT {_TOTALS}, count(*) FILTER (WHERE status = 'IDENTICAL') * 100.0 / count(*) FILTER (WHERE status NOT IN ('A_ONLY', 'B_ONLY')) AS match_rate FROM c")
def summary_counts(spark, sf_dir):
    return reconcile.summary(perturbed(spark, sf_dir)).drop("by_status")


@query(f"{_PERTURBED} SELECT status, count(*) AS n FROM c GROUP BY status")
def summary_by_status(spark, sf_dir):
    return reconcile.summary(perturbed(spark, sf_dir)).select(F.explode("by_status").alias("status", "n"))


_EQUALS = "CASE WHEN {a} = {b} THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, 1::BIGINT AS a_count, 1::BIGINT AS b_count"


@query("SELECT CASE e WHEN 3 THEN 'IDENTICAL' WHEN 0 THEN 'FULL_MISMATCH' ELSE 'PARTIAL_MISMATCH' END AS status, count(*) AS n FROM (SELECT CAST(a.o_totalprice = b.o_totalprice AS INT) + CAST(CAST(a.o_orderdate AS DATE) = CAST(b.o_orderdate AS DATE) AS INT) + CAST(trim(a.o_orderpriority) = trim(b.o_orderpriority) AS INT) AS e FROM orders a FULL OUTER JOIN orders b ON a.o_orderkey = b.o_orderkey) GROUP BY 1")
def recon_identical(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return run(orders, orders, "o_orderkey", [rule("o_totalprice"), rule("o_orderdate", kind="date", rule_id="r2"), rule("o_orderpriority", kind="text", rule_id="r3")]).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_PERTURBED} SELECT status, count(*) AS n FROM c WHERE status IN ('PARTIAL_MISMATCH', 'FULL_MISMATCH', 'A_ONLY') GROUP BY status")
def view_sheets(spark, sf_dir):
    sheets = views.sheets(perturbed(spark, sf_dir))
    return sheets["mismatched"].unionByName(sheets["a_only"]).unionByName(sheets["duplicated"]).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_PERTURBED} SELECT key_display, status, CASE WHEN status IN ('A_ONLY', 'B_ONLY') THEN 'UNAVAILABLE' WHEN p THEN 'EQUAL' ELSE 'DIFFERENT' END AS r1_status, CASE WHEN status IN ('A_ONLY', 'B_ONLY') THEN 'UNAVAILABLE' WHEN s THEN 'EQUAL' ELSE 'DIFFERENT' END AS r2_status FROM c")
def view_flat(spark, sf_dir):
    return views.flat(perturbed(spark, sf_dir), _RULES).select("key_display", "status", "r1_status", "r2_status")


@query(f"{_PERTURBED} SELECT key_display, status FROM c WHERE NOT p AND status IN ('PARTIAL_MISMATCH', 'FULL_MISMATCH')")
def view_rule_mismatch(spark, sf_dir):
    return views.with_mismatch(perturbed(spark, sf_dir), "r1").select("key_display", "status")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '99') OR contains(lower(c_mktsegment), '99') OR contains(CAST(c_custkey AS VARCHAR), '99')")
def view_containing(spark, sf_dir):
    return views.containing(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "99").select("c_custkey", "c_name")


# --- tolerances -------------------------------------------------------------------------------------

_SCALED = "SELECT o_orderkey, o_totalprice, o_totalprice * (1 + (o_orderkey % 5) / 100.0) AS scaled FROM orders"


def scaled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_totalprice"), orders.select("o_orderkey", F.expr("o_totalprice * (1 + (o_orderkey % 5) / 100D)").alias("scaled"))


for _name, _method, _options, _allowed in (
    ("abs", "absolute_tolerance", {"absolute": 2000.0}, "2000.0"), ("rel", "relative_tolerance", {"relative": 0.025}, "abs(scaled) * 0.025"),
    ("pct", "percentage", {"percentage": 1.5}, "abs(scaled) * (1.5 / 100)"), ("none", "other", {}, "0.0"),
):
    query(
        f"SELECT CAST(o_orderkey AS VARCHAR) AS key_display, CASE WHEN abs(o_totalprice - scaled) <= {_allowed} THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, 1::BIGINT AS a_count, 1::BIGINT AS b_count, round(CASE WHEN scaled <> 0 THEN abs(o_totalprice - scaled) / abs(scaled) ELSE 0 END, 6) AS rate FROM ({_SCALED})",
        f"recon_tolerance_{_name}",
    )(lambda spark, sf_dir, m=_method, o=_options: outcome(run(*scaled(spark, sf_dir), "o_orderkey", [rule("o_totalprice", "scaled", method=m, tolerance_options=Tolerance(**o))]), F.round(first_rule("difference_rate"), 6).alias("rate")))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key_display, CASE WHEN round(v, 0) = v THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, 1::BIGINT AS a_count, 1::BIGINT AS b_count FROM (SELECT o_orderkey, (o_orderkey % 10) + CASE WHEN o_orderkey % 3 = 0 THEN 0.25 ELSE 0.0 END AS v FROM orders) WHERE true")
def recon_exact_decimals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CAST(o_orderkey % 10 AS DOUBLE) + CASE WHEN o_orderkey % 3 = 0 THEN 0.25D ELSE 0D END").alias("v"))
    return outcome(run(rows, rows.withColumn("v", F.floor("v").cast("double")), "o_orderkey", [rule("v")]))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key_display, CASE WHEN o_orderkey % 4 = 3 THEN 'FULL_MISMATCH' ELSE 'IDENTICAL' END AS status, 1::BIGINT AS a_count, 1::BIGINT AS b_count FROM orders")
def recon_round(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).cast("double").alias("v"))
    other = rows.withColumn("v", F.expr("v + CASE WHEN o_orderkey % 4 = 3 THEN 0.75D ELSE 0.25D END"))
    return outcome(run(rows, other, "o_orderkey", [rule("v", method="round", tolerance_options=Tolerance(decimals=0))]))


# --- duplicate keys ---------------------------------------------------------------------------------

_ORDER_LINES = "SELECT o_orderkey, count(l_orderkey) AS n, CAST(min(o_orderstatus) AS VARCHAR) AS s, count(*) FILTER (WHERE o_orderstatus = l_linestatus) AS same FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"


def orders_and_lines(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus", "l_shipdate", "l_quantity")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), lines


_STATUS = rule("o_orderstatus", "l_linestatus", kind="text")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS key_display, CASE WHEN n = 0 THEN 'A_ONLY' WHEN n > 1 THEN 'DUPLICATE_BLOCKED' WHEN same = 1 THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, 1::BIGINT AS a_count, n AS b_count FROM ({_ORDER_LINES})")
def recon_1n(spark, sf_dir):
    return outcome(run(*orders_and_lines(spark, sf_dir), "o_orderkey", [_STATUS], join_type="left"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS key_display, CASE WHEN n > 1 THEN 'ONE_TO_MANY' WHEN same = 1 THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, 1::BIGINT AS a_count, n AS b_count, CAST(same AS INTEGER) AS n_equal, CAST(n AS INTEGER) AS n_rules FROM ({_ORDER_LINES}) WHERE n > 0")
def recon_1n_rowwise(spark, sf_dir):
    result = run(*orders_and_lines(spark, sf_dir), "o_orderkey", [_STATUS], join_type="inner", duplicate_policy_b=DuplicatePolicy("B", "row"))
    return outcome(result, F.size(F.filter("rules", lambda x: x.status == "EQUAL")).alias("n_equal"), F.size("rules").alias("n_rules"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS key_display, CASE WHEN n > 1 THEN 'MANY_TO_ONE' WHEN same = 1 THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, n AS a_count, 1::BIGINT AS b_count FROM ({_ORDER_LINES}) WHERE n > 0")
def recon_n1_rowwise(spark, sf_dir):
    orders, lines = orders_and_lines(spark, sf_dir)
    return outcome(run(lines, orders, "o_orderkey", [rule("l_linestatus", "o_orderstatus", kind="text")], join_type="inner", duplicate_policy_a=DuplicatePolicy("A", "error", allow_one_to_many=True)))


for _policy, _direction, _pick in (("representative", "desc", "max"), ("representative", "asc", "min"), ("first", "asc", "min"), ("last", "asc", "max"), ("last", "desc", "min")):
    query(
        f"SELECT CAST(o_orderkey AS VARCHAR) AS key_display, CASE WHEN n > 1 THEN CASE WHEN d <= 60 THEN 'DUP_EQUAL' ELSE 'DUP_DIFF' END WHEN d <= 60 THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, 1::BIGINT AS a_count, n AS b_count, CAST(d AS DOUBLE) AS days FROM (SELECT o_orderkey, count(*) AS n, abs(date_diff('day', CAST({_pick}(l_shipdate) AS DATE), CAST(min(o_orderdate) AS DATE))) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)",
        f"recon_{_policy}_{_direction}",
    )(lambda spark, sf_dir, p=_policy, d=_direction: outcome(run(*orders_and_lines(spark, sf_dir), "o_orderkey", [rule("o_orderdate", "l_shipdate", kind="date", tolerance_options=Tolerance(absolute=60))], join_type="inner", duplicate_policy_b=DuplicatePolicy("B", p, "l_shipdate", d)), first_rule("difference").alias("days")))

_PARTS = "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb, a.* EXCLUDE (k, n), b.* EXCLUDE (k, n) FROM (SELECT l_partkey AS k, count(*) AS n, {agg} AS va FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a FULL OUTER JOIN (SELECT l_partkey AS k, count(*) AS n, {agg} AS vb FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON a.k = b.k"
_NM = "SELECT CAST(k AS VARCHAR) AS key_display, CASE WHEN na = 0 THEN 'B_ONLY' WHEN nb = 0 THEN 'A_ONLY' WHEN na = 1 AND nb = 1 THEN CASE WHEN {one} THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END WHEN na = 1 OR nb = 1 THEN 'DUPLICATE_BLOCKED' WHEN {same} THEN 'DUP_EQUAL' ELSE 'DUP_DIFF' END AS status, na AS a_count, nb AS b_count FROM (" + _PARTS + ")"


def parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", F.col("l_quantity").alias("q"), F.to_date("l_shipdate").alias("d"))
    return lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'")


def many_to_many(spark, sf_dir, policy: str, column: str = "q", kind: str = "number", **options) -> DataFrame:
    return outcome(run(*parts(spark, sf_dir), "l_partkey", [rule(column, kind=kind, normalization_options=options)], nm_policy=policy))


for _name, _policy, _column, _kind, _options, _agg, _same in (
    ("set", "set", "q", "number", {}, "list_sort(list(DISTINCT l_quantity))", "va = vb"), ("multiset", "multiset", "q", "number", {}, "list_sort(list(l_quantity))", "va = vb"),
    ("sum", "aggregate", "q", "number", {"aggregation_method": "sum"}, "sum(l_quantity)", "va = vb"), ("mean", "aggregate", "q", "number", {"aggregation_method": "mean"}, "sum(l_quantity) / count(*)", "va = vb"),
    ("min", "aggregate", "q", "number", {"aggregation_method": "min"}, "min(l_quantity)", "va = vb"), ("max", "aggregate", "q", "number", {"aggregation_method": "max"}, "max(l_quantity)", "va = vb"),
    ("count", "aggregate", "q", "number", {"aggregation_method": "count"}, "count(l_quantity)", "va = vb"), ("nunique", "aggregate", "q", "number", {"aggregation_method": "nunique"}, "count(DISTINCT l_quantity)", "va = vb"),
):
    _one = "va = vb" if _name not in ("count", "nunique") else "la = lb"
    _sql = _NM.format(agg=_agg, one=_one, same=_same)
    if _name in ("count", "nunique"):
        _sql = _sql.replace(" AS va FROM", " AS va, min(l_quantity) AS la FROM").replace(" AS vb FROM", " AS vb, min(l_quantity) AS lb FROM")
    query(_sql, f"recon_nm_{_name}")(lambda spark, sf_dir, p=_policy, c=_column, k=_kind, o=_options: many_to_many(spark, sf_dir, p, c, k, **o))

for _name, _pick in (("first_date", "min"), ("last_date", "max")):
    query(_NM.format(agg=f"{_pick}(CAST(l_shipdate AS DATE))", one="va = vb", same="va = vb"), f"recon_nm_{_name}")(lambda spark, sf_dir, m=_name: many_to_many(spark, sf_dir, "aggregate", "d", "date", aggregation_method=m))


@query("SELECT CAST(k AS VARCHAR) AS key_display, CASE WHEN na = 0 THEN 'B_ONLY' WHEN nb = 0 THEN 'A_ONLY' WHEN na = 1 AND nb = 1 THEN CASE WHEN va = vb THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END WHEN na = 1 OR nb = 1 THEN 'DUPLICATE_BLOCKED' ELSE 'NM_PENDING' END AS status, na AS a_count, nb AS b_count FROM (" + _PARTS.format(agg="min(l_quantity)") + ")")
def recon_nm_pending(spark, sf_dir):
    return many_to_many(spark, sf_dir, "error")


@query("SELECT CAST(k AS VARCHAR) AS key_display, CASE WHEN na = 0 THEN 'B_ONLY' WHEN nb = 0 THEN 'A_ONLY' WHEN na = 1 AND nb = 1 THEN CASE WHEN va = vb THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END WHEN na = 1 THEN 'ONE_TO_MANY' WHEN nb = 1 THEN 'MANY_TO_ONE' WHEN va = vb THEN 'DUP_EQUAL' ELSE 'DUP_DIFF' END AS status, na AS a_count, nb AS b_count, CASE WHEN na > 0 AND nb > 0 AND na + nb > 2 THEN ua ELSE 0 END AS a_unique, CASE WHEN na > 0 AND nb > 0 AND na + nb > 2 THEN ub ELSE 0 END AS b_unique FROM (" + _PARTS.format(agg="list_sort(list(l_quantity))").replace(" AS va FROM", " AS va, count(DISTINCT l_quantity) AS ua FROM").replace(" AS vb FROM", " AS vb, count(DISTINCT l_quantity) AS ub FROM") + ")")
def recon_collections(spark, sf_dir):
    result = run(*parts(spark, sf_dir), "l_partkey", [rule("q")], nm_policy="multiset", duplicate_policy_a=DuplicatePolicy("A", "multiset"), duplicate_policy_b=DuplicatePolicy("B", "multiset"))
    return outcome(result, "a_unique", "b_unique")


_LINES = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL"


@query(f"SELECT CAST(l_orderkey AS VARCHAR) || ' | ' || CAST(l_linenumber AS VARCHAR) AS key_display, CASE WHEN nb = 0 THEN 'A_ONLY' WHEN n = 1 AND nb = 1 THEN 'IDENTICAL' WHEN n > 1 AND nb > 1 THEN 'NM_PENDING' ELSE 'DUPLICATE_BLOCKED' END AS status, n AS a_count, nb AS b_count FROM (SELECT a.*, coalesce(b.nb, 0) AS nb FROM ({_LINES}) a LEFT JOIN (SELECT l_orderkey, l_linenumber, count(*) AS nb FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber)")
def recon_composite_dup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").withColumn("c", F.lit(1))
    return outcome(run(lines, lines.where("l_returnflag <> 'N'"), ["l_orderkey", "l_linenumber"], [rule("c")]))


@query("SELECT CAST(conv_id AS VARCHAR) || ' | ' || CAST(turn AS VARCHAR) AS key_display, CASE WHEN turn % 3 = 1 AND role <> 'user' THEN 'FULL_MISMATCH' ELSE 'IDENTICAL' END AS status, 1::BIGINT AS a_count, 1::BIGINT AS b_count FROM conversations")
def recon_composite(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return outcome(run(rows, rows.withColumn("role", F.expr("CASE WHEN turn % 3 = 1 THEN 'user' ELSE role END")), ["conv_id", "turn"], [rule("role", kind="text")]))


# --- typed values -----------------------------------------------------------------------------------

for _name, _method, _equal, _options in (
    ("day", "exact", "shift = 0", {}), ("month", "month", "date_trunc('month', d) = date_trunc('month', d + shift)", {}), ("year", "year", "year(d) = year(d + shift)", {}), ("days", "days_tolerance", "shift <= 2", {"absolute": 2.0}),
):

    def _dates(spark, sf_dir, method=_method, options=_options):
        base = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
        text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(d, 'yyyy-MM-dd') WHEN 1 THEN date_format(d, 'yyyy/M/d') WHEN 2 THEN date_format(d, 'yyyy.MM.dd') ELSE concat(year(d), '년 ', month(d), '월 ', day(d), '일') END")
        later = base.select("o_orderkey", F.expr("date_add(d, CAST(o_orderkey % 6 AS INT))").alias("d"))
        return outcome(run(base.withColumn("d", text), later, "o_orderkey", [rule("d", kind="date", method=method, tolerance_options=Tolerance(**options))]))

    query(f"SELECT CAST(o_orderkey AS VARCHAR) AS key_display, CASE WHEN {_equal} THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, 1::BIGINT AS a_count, 1::BIGINT AS b_count FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 6 AS INTEGER) AS shift FROM orders)", f"recon_dates_{_name}")(_dates)


_BOOLEAN = "CASE WHEN lower(trim({v})) IN ('y', 'yes', 'true', '1') THEN true WHEN lower(trim({v})) IN ('n', 'no', 'false', '0') THEN false END"


@query(f"SELECT CAST(event_id AS VARCHAR) AS key_display, CASE WHEN x IS NULL OR y IS NULL THEN 'CONVERSION_FAILED' WHEN x = y THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, 1::BIGINT AS a_count, 1::BIGINT AS b_count FROM (SELECT event_id, {_BOOLEAN.format(v='a')} AS x, {_BOOLEAN.format(v='b')} AS y FROM (SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'maybe' WHEN event_id % 2 = 0 THEN ' Yes' ELSE 'N' END AS a, '1' AS b FROM events))")
def recon_bool(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    a = rows.withColumn("v", F.expr("CASE WHEN event_id % 5 = 4 THEN 'maybe' WHEN event_id % 2 = 0 THEN ' Yes' ELSE 'N' END"))
    return outcome(run(a, rows.withColumn("v", F.lit("1")), "event_id", [rule("v", kind="boolean")]))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key_display, CASE WHEN x IS NULL THEN 'CONVERSION_FAILED' WHEN x = b THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, 1::BIGINT AS a_count, 1::BIGINT AS b_count FROM (SELECT p_partkey, TRY_CAST(regexp_extract(regexp_replace(a, '[,₩원\\s]', '', 'g'), '[-+]?[0-9]+([.][0-9]*)?') AS DOUBLE) AS x, b FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'unknown' ELSE '₩' || format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) || '원 each' END AS a, floor(p_retailprice) + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS b FROM part))")
def recon_unit_number(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.floor("p_retailprice").alias("v"))
    a = rows.select("p_partkey", F.expr("CASE WHEN p_partkey % 9 = 0 THEN 'unknown' ELSE concat('₩', format_number(v, 0), '원 each') END").alias("v"))
    return outcome(run(a, rows.withColumn("v", F.expr("CASE WHEN p_partkey % 4 = 0 THEN v + 1 ELSE v END")), "p_partkey", [rule("v", kind="unit_number")]))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key_display, CASE c_custkey % 5 WHEN 0 THEN 'IDENTICAL' WHEN 1 THEN 'IDENTICAL' WHEN 2 THEN 'IDENTICAL' WHEN 3 THEN 'FULL_MISMATCH' ELSE 'CONVERSION_FAILED' END AS status, CASE c_custkey % 5 WHEN 0 THEN 'BOTH_EMPTY' WHEN 1 THEN 'EMPTY_IS_ZERO' WHEN 2 THEN 'EMPTY_IS_TEXT' WHEN 3 THEN 'ONE_EMPTY' ELSE 'NOT_CONVERTED' END AS r1_reason, 1::BIGINT AS a_count, 1::BIGINT AS b_count FROM customer")
def recon_null_policy(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    a = rows.withColumn("v", F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 < 4 THEN ' N/A ' ELSE 'abc' END"))
    b = rows.withColumn("v", F.expr("CASE c_custkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '0.0' WHEN 2 THEN ' free' WHEN 3 THEN '7' ELSE '8' END"))
    policy = NullPolicy(empty_equals_zero=True, empty_equals_text="free")
    return outcome(run(a, b, "c_custkey", [rule("v", null_policy=policy)]), first_rule("reason"))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS key_display, {_EQUALS.format(a='lower(trim(a))', b="lower(trim(replace(b, chr(10), ' ')))")} FROM (SELECT c_custkey, c_name AS a, CASE c_custkey % 3 WHEN 0 THEN '  ' || upper(c_name) || ' ' WHEN 1 THEN lower(c_name) || chr(10) ELSE c_name || '!' END AS b FROM customer)")
def recon_text_methods(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("v"))
    b = rows.withColumn("v", F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('  ', upper(v), ' ') WHEN 1 THEN concat(lower(v), chr(10)) ELSE concat(v, '!') END"))
    return outcome(run(rows, b, "c_custkey", [rule("v", kind="text", method="case_insensitive")]))


# --- keys -------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN c_custkey % 10 = 0 THEN '(빈값)' ELSE CAST(c_custkey AS VARCHAR) END AS key_display, CASE WHEN c_custkey % 10 = 0 THEN 'BLANK_KEY' ELSE 'IDENTICAL' END AS status, count(*) AS a_count, count(*) AS b_count FROM customer GROUP BY ALL")
def recon_blank_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.expr("CASE c_custkey % 30 WHEN 0 THEN '-' WHEN 10 THEN ' NA' WHEN 20 THEN '' ELSE CAST(c_custkey AS STRING) END").alias("k"), "c_acctbal")
    return outcome(run(rows, rows, "k", [rule("c_acctbal")]))


@query(f"SELECT coalesce(a.k, b.k) AS key_display, {_EQUALS.format(a='a.v', b='b.v')} FROM (SELECT lower(trim(replace('  ' || upper(n_name) || chr(10), chr(10), ' '))) || ' | ' || regexp_replace(n_nationkey || '.0', '[.]0$', '') AS k, n_regionkey AS v FROM nation) a FULL OUTER JOIN (SELECT lower(trim(lower(n_name))) || ' | ' || CAST(n_nationkey AS VARCHAR) AS k, n_regionkey AS v FROM nation) b ON a.k = b.k")
def recon_key_norm(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_name", "n_nationkey", "n_regionkey")
    a = nation.select(F.expr("concat('  ', upper(n_name), chr(10))").alias("k1"), F.expr("concat(n_nationkey, '.0')").alias("k2"), "n_regionkey")
    b = nation.select(F.expr("lower(n_name)").alias("k1"), F.col("n_nationkey").alias("k2"), "n_regionkey")
    return outcome(run(a, b, ["k1", "k2"], [rule("n_regionkey")], key_options=KeyOptions(case_insensitive=True)))


@query(f"SELECT coalesce(a.k, b.k) AS key_display, {_EQUALS.format(a='a.v', b='b.v')} FROM (SELECT CAST(CAST(CAST('0' || c_custkey || '.00' AS DOUBLE) AS BIGINT) AS VARCHAR) AS k, c_acctbal AS v FROM customer) a FULL OUTER JOIN (SELECT CAST(c_custkey AS VARCHAR) AS k, c_acctbal AS v FROM customer) b ON a.k = b.k")
def recon_key_numeric(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    a = rows.select(F.expr("concat('0', c_custkey, '.00')").alias("k"), "c_acctbal")
    return outcome(run(a, rows.withColumnRenamed("c_custkey", "k"), "k", [rule("c_acctbal")], key_options=KeyOptions(coerce_numeric_string=True)))


@query(f"SELECT CASE WHEN n = 0 THEN 'A_ONLY' WHEN n = 1 THEN 'ONE_TO_ONE' ELSE 'ONE_TO_MANY' END AS kind, count(*) AS n FROM ({_ORDER_LINES}) GROUP BY 1")
def cardinality(spark, sf_dir):
    orders, lines = orders_and_lines(spark, sf_dir)
    config = compare("o_orderkey", [_STATUS])
    counts = reconcile.cardinality(reconcile.keyed(orders, config.dataset_a, assume_ascii=True), reconcile.keyed(lines, config.dataset_b, assume_ascii=True))
    return counts.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (WHERE n = 1) AS one_to_one, count(*) FILTER (WHERE n > 1) AS one_to_many, 0::BIGINT AS many_to_one, 0::BIGINT AS many_to_many, count(*) FILTER (WHERE n = 0) AS a_only, 0::BIGINT AS b_only FROM ({_ORDER_LINES})")
def cardinality_summary(spark, sf_dir):
    orders, lines = orders_and_lines(spark, sf_dir)
    config = compare("o_orderkey", [_STATUS])
    return reconcile.cardinality_summary(reconcile.cardinality(reconcile.keyed(orders, config.dataset_a, assume_ascii=True), reconcile.keyed(lines, config.dataset_b, assume_ascii=True)))


# --- mapping ----------------------------------------------------------------------------------------

_GROUPS = {"BUY": ["purchase", " Buy ", "order"], "LOOK": ["view", "click"], "": ["nothing"], "ALONE": []}
_MAPPED = "CASE WHEN lower(event_type) IN ('purchase', 'order') THEN 'buy' WHEN lower(event_type) IN ('view', 'click') THEN 'look' ELSE lower(event_type) END"


@query(f"SELECT {_MAPPED} AS key_display, CASE WHEN count(*) > 1 THEN 'NM_PENDING' ELSE 'IDENTICAL' END AS status, count(*) AS a_count, count(*) AS b_count FROM events GROUP BY 1")
def mapping_apply(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    config = {"event_type": KeyMapping(enabled=True, groups=_GROUPS)}
    return outcome(run(rows.withColumn("event_type", F.upper("event_type")), rows, "event_type", [rule("value")], key_options=KeyOptions(case_insensitive=True, unicode_normalize=False), mappings=config))


#: Groups of a table with every kind of fault: blank canonical cells, groups without aliases, repeated rows, shared aliases, aliases that are canonical elsewhere.
_FAULTY = {
    "canonical": "CASE WHEN c_custkey % 40 = 0 THEN ' ' ELSE concat('C', c_custkey % 1000) END",
    "a1": "CASE WHEN c_custkey % 25 = 3 THEN NULL ELSE concat('x', c_custkey % 1000) END",
    "a2": "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('Y', CAST(floor(c_custkey % 1000 / 2) AS INT)) WHEN 2 THEN concat('c', (c_custkey + 1) % 1000) WHEN 3 THEN concat(' y', CAST(floor(c_custkey % 1000 / 2) AS INT)) WHEN 4 THEN concat('Y', c_custkey % 3) ELSE ' ' END",
}
_FAULTY_SQL = f"""
WITH w AS (SELECT c_custkey AS n, {', '.join(f'{e} AS {c}' for c, e in _FAULTY.items())} FROM customer),
g AS (SELECT n, canonical AS raw_canonical, CASE WHEN trim(canonical) <> '' THEN lower(trim(canonical)) END AS canonical, list_filter([a1, a2], lambda x: trim(x) <> '') AS named, list_transform([a1, a2], lambda x: CASE WHEN trim(x) <> '' THEN x ELSE '' END) AS signature FROM w),
r AS (SELECT n, raw_canonical, canonical, t.x.raw AS raw, t.x.own AS own, lower(trim(t.x.raw)) AS alias FROM g, unnest(list_prepend({{'raw': raw_canonical, 'own': true}}, list_transform(named, lambda x: {{'raw': x, 'own': false}}))) t(x) WHERE canonical IS NOT NULL),
ambiguous AS (SELECT raw FROM r GROUP BY raw HAVING count(DISTINCT raw_canonical) > 1),
targets AS (SELECT alias, list_sort(list(DISTINCT canonical)) AS canonicals, list_sort(list(DISTINCT n)) AS ns FROM r GROUP BY alias),
chained AS (SELECT * FROM targets WHERE alias IN (SELECT canonical FROM r WHERE own) AND len(list_filter(canonicals, lambda c: c <> alias)) > 0)
"""
_ISSUES = """
SELECT 'warning' AS severity, 'EMPTY_CANONICAL' AS code, NULL AS alias, CAST([] AS VARCHAR[]) AS canonicals, [n] AS ns FROM g WHERE canonical IS NULL
UNION ALL SELECT 'warning', 'ALIASLESS_GROUP', NULL, [raw_canonical], [n] FROM g WHERE canonical IS NOT NULL AND len(named) = 0
UNION ALL SELECT 'warning', 'DUPLICATE_ROW', NULL, [], list_sort(list(n)) FROM g WHERE canonical IS NOT NULL GROUP BY raw_canonical, signature HAVING count(*) > 1
UNION ALL SELECT 'warning', 'DUPLICATE_ALIAS', alias, [canonical], list_sort(list(DISTINCT n)) FROM r GROUP BY alias, canonical HAVING count(*) > 1
UNION ALL SELECT 'error', CASE WHEN alias IN (SELECT raw FROM ambiguous) THEN 'ALIAS_CONFLICT' ELSE 'NORMALIZED_ALIAS_CONFLICT' END, alias, canonicals, ns FROM targets WHERE len(canonicals) > 1
UNION ALL SELECT 'error', 'CANONICAL_ALIAS_CONFLICT', alias, list_sort(list_distinct(list_append(canonicals, alias))), ns FROM chained
"""


def faulty_mapping(spark, sf_dir) -> mapping.Mapping:
    wide = table(spark, sf_dir, "customer").selectExpr("c_custkey", *[f"{e} AS {c}" for c, e in _FAULTY.items()])
    return mapping.build(mapping.groups_from_wide(wide, "canonical", ["a1", "a2"], row_number="c_custkey"), KeyOptions(case_insensitive=True, unicode_normalize=False))


for _name, _severity in (("warnings", "warning"), ("issues", "error")):
    query(f"{_FAULTY_SQL} SELECT severity, code, alias, array_to_string(canonicals, ',') AS canonicals, array_to_string(ns, ',') AS row_numbers FROM ({_ISSUES}) WHERE severity = '{_severity}'", f"mapping_{_name}")(
        lambda spark, sf_dir, s=_severity: faulty_mapping(spark, sf_dir).issues.where(F.col("severity") == s).select("severity", "code", "alias", F.array_join("canonicals", ",").alias("canonicals"), F.array_join(F.col("row_numbers").cast("array<string>"), ",").alias("row_numbers"))
    )


@query(
    f"{_FAULTY_SQL} SELECT (SELECT count(DISTINCT canonical) FROM g) AS canonical_count, (SELECT count(*) FROM r WHERE NOT own) AS alias_count, (SELECT count(*) FROM targets WHERE len(canonicals) = 1 AND alias NOT IN (SELECT alias FROM chained)) AS mapping_item_count, "
    "(SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM r GROUP BY alias, canonical)) AS duplicate_alias_count, (SELECT CAST(sum(2) AS BIGINT) FROM g WHERE canonical IS NOT NULL) - (SELECT count(*) FROM r WHERE NOT own) AS empty_alias_cell_count, "
    "(SELECT count(*) FROM targets WHERE len(canonicals) > 1 OR alias IN (SELECT alias FROM chained)) AS collision_alias_count, (SELECT count(*) FROM g WHERE canonical IS NULL) AS empty_canonical_count, "
    "(SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM g WHERE canonical IS NOT NULL GROUP BY raw_canonical, signature)) AS duplicate_row_count, (SELECT count(*) FROM g WHERE canonical IS NOT NULL AND len(named) = 0) AS aliasless_group_count"
)
def mapping_stats(spark, sf_dir):
    return faulty_mapping(spark, sf_dir).stats


@query("SELECT count(DISTINCT t) AS unique_key_count, count(DISTINCT t) FILTER (WHERE m) AS mapped_key_count, count(DISTINCT t) FILTER (WHERE NOT m) AS unmapped_key_count, count(DISTINCT t) FILTER (WHERE m) * 100.0 / count(DISTINCT t) AS mapping_rate FROM (SELECT lower(event_type) AS t, lower(event_type) IN ('purchase', 'order', 'view', 'click') AS m FROM events)")
def mapping_application(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lower("event_type").alias("k"))
    built = mapping.build_mapping(spark, _GROUPS, KeyOptions(case_insensitive=True))
    return mapping.application_stats(mapping.applied(rows, "k", built, "standard", "canonical"), "k", "canonical")


# --- the stricter dialect ---------------------------------------------------------------------------


@query("WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_mktsegment) || '!' ELSE ' ' || c_mktsegment END AS v FROM customer WHERE c_custkey % 6 <> 0) SELECT '[{\"type\":\"int\",\"value\":\"' || CAST(a.c_custkey AS VARCHAR) || '\"}]' AS key, CASE WHEN b.c_custkey IS NULL THEN 'removed' WHEN a.c_custkey % 4 = 0 THEN 'changed' ELSE 'matched' END AS status, 1::BIGINT AS a_count, CAST(b.c_custkey IS NOT NULL AS BIGINT) AS b_count FROM customer a LEFT JOIN b ON a.c_custkey = b.c_custkey")
def dialect_typed(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    b = rows.where("c_custkey % 6 <> 0").withColumn("v", F.expr("CASE WHEN c_custkey % 4 = 0 THEN concat(upper(v), '!') ELSE concat(' ', v) END"))
    return dialect.compare_typed(rows, b, dialect.Options(["c_custkey"], rules=[dialect.text("v")])).select("key", "status", "a_count", "b_count")


@query("SELECT CASE WHEN c_custkey % 10 = 0 THEN 'invalid-key' ELSE 'matched' END AS status, CASE WHEN min(c_custkey % 10) = 0 THEN 2 * count(*) ELSE count(*) END AS n FROM customer GROUP BY 1")
def dialect_blank_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.expr("CASE c_custkey % 20 WHEN 0 THEN NULL WHEN 10 THEN ' ' ELSE CAST(c_custkey AS STRING) END").alias("k"), "c_acctbal")
    return dialect.compare_typed(rows, rows, dialect.Options(["k"], rules=[dialect.number("c_acctbal")])).groupBy("status").agg(F.count("*").alias("n"))


# --- profiles ---------------------------------------------------------------------------------------


@query("SELECT count(*) AS row_count, 4::BIGINT AS column_count, 0::BIGINT AS empty_rows, 1::BIGINT AS empty_columns, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag HAVING count(*) > 1)) AS duplicate_rows FROM lineitem")
def profile_table(spark, sf_dir):
    return profile.profile_table(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.lit(None).cast("string").alias("nothing")))


def _profiled(name: str, columns: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({e}) AS missing_count, (count(*) - count({e})) / count(*) AS missing_rate, count(DISTINCT {e}) AS unique_count, '{t}' AS inferred_type FROM {name}" for c, (e, t) in columns.items())


@query(_profiled("customer", {"c_custkey": ("c_custkey", "number"), "c_name": ("c_name", "unit_number"), "c_mktsegment": ("c_mktsegment", "text"), "part": ("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END", "number"), "flag": ("c_custkey % 2", "boolean"), "day": ("date '2024-01-01' + CAST(c_custkey % 400 AS INTEGER)", "unit_number"), "none": ("NULL", "mixed")}))
def profile_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS part", "CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'n' END AS flag", "concat('on ', date_add(date'2024-01-01', CAST(c_custkey % 400 AS INT)), ' 9') AS day", "CAST(NULL AS STRING) AS none")
    return profile.profile_columns(rows.withColumn("day", F.expr("concat(1000 + c_custkey % 400, ' kg')"))).drop("position")


@query("SELECT count(*) AS unique_key_count, count(*) FILTER (WHERE n > 1) AS duplicate_key_count, max(n) AS max_count, 0::BIGINT AS empty_key_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def profile_duplicates(spark, sf_dir):
    return profile.profile_duplicates(table(spark, sf_dir, "lineitem"), [F.col("l_orderkey")], ["l_returnflag"])


@query("SELECT l_orderkey AS k0, count(*) AS count, count(DISTINCT l_returnflag || l_linestatus) AS variation FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_variation(spark, sf_dir):
    return profile.duplicate_keys(table(spark, sf_dir, "lineitem"), [F.col("l_orderkey")], ["l_returnflag", "l_linestatus"]).where("count > 1")


@query("SELECT * FROM (VALUES ('rows', (SELECT count(*) FROM orders), (SELECT count(*) FROM lineitem)), ('unique_key_count', (SELECT count(DISTINCT o_orderkey) FROM orders), (SELECT count(DISTINCT l_orderkey) FROM lineitem)), ('duplicate_key_count', 0, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1))), ('max_count', 1, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))), ('empty_key_count', 0, 0)) t(metric, a, b)")
def key_diagnostics(spark, sf_dir):
    return profile.key_diagnostics(table(spark, sf_dir, "orders"), [F.col("o_orderkey")], table(spark, sf_dir, "lineitem"), [F.col("l_orderkey")])


@query("SELECT CAST(n_nationkey AS BIGINT) AS row_number, CASE WHEN n_nationkey = 2 THEN 4.0 WHEN n_nationkey = 1 THEN 2.0 ELSE 2 + 1.0 / 2 * 2 END AS score, CASE WHEN n_nationkey = 2 THEN 3 WHEN n_nationkey = 1 THEN 1 ELSE 2 END AS non_empty FROM nation WHERE n_nationkey BETWEEN 1 AND 6 AND n_nationkey <> 1")
def header_candidates(spark, sf_dir):
    grid = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS __row_no", "n_name AS c0", "CASE WHEN n_nationkey = 1 THEN '' ELSE CAST(n_regionkey AS STRING) END AS c1", "CASE WHEN n_nationkey = 2 THEN 'h' ELSE NULL END AS c2").where("__row_no >= 1")
    return profile.header_candidates(grid)


# --- scalars and values -----------------------------------------------------------------------------


@query("SELECT c_custkey, 1 AS version, CASE c_custkey % 3 WHEN 0 THEN 'null' ELSE 'string' END AS type, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE c_name END AS value FROM customer")
def scalar_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN NULL ELSE c_name END AS v")
    return rows.select("c_custkey", scalar.encode(F.col("v"), rows.schema["v"].dataType).alias("s")).select("c_custkey", "s.*")


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN -(o_orderkey % 1000) WHEN 1 THEN o_orderkey % 1000 WHEN 2 THEN o_orderkey % 1000 * 1000 WHEN 3 THEN (o_orderkey % 1000) / 100.0 ELSE NULL END AS DOUBLE) AS v FROM orders")
def parse_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_orderkey % 1000 AS INT) AS x")
    text = F.expr("CASE o_orderkey % 5 WHEN 0 THEN concat('(', x, ')') WHEN 1 THEN concat(' USD ', x, ' ') WHEN 2 THEN concat(x, ',000') WHEN 3 THEN concat(x, '%') ELSE '12abc' END")
    return rows.select("o_orderkey", normalize.parse_number(text, {"percent_string": True}).alias("v"))


# --- N:M picks, values in their order, other text methods, all kinds of keys --------------------------

_UNBLOCKED = _NM.replace("WHEN na = 1 OR nb = 1 THEN 'DUPLICATE_BLOCKED' ", "")

for _direction, _pick in (("desc", "max"), ("asc", "min")):
    query(_UNBLOCKED.format(agg=f"{_pick}(CAST(l_shipdate AS DATE))", one="va = vb", same="va = vb"), f"recon_nm_representative_{_direction}")(
        lambda spark, sf_dir, d=_direction: outcome(run(*parts(spark, sf_dir), "l_partkey", [rule("d", kind="date")], nm_policy="representative", **{f"duplicate_policy_{s.lower()}": DuplicatePolicy(s, "representative", "d", d) for s in "AB"}))
    )

_IN_ORDER = "(SELECT k, CAST(sum(c) AS BIGINT) AS n, string_agg(s, {by}) AS {va} FROM (SELECT l_partkey AS k, l_linestatus AS s, count(*) AS c, min(l_orderkey * 8 + l_linenumber) AS f FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY 1, 2) GROUP BY 1)"
for _name, _by in (("concat_unique", "' | ' ORDER BY f, s"), ("concat_sorted", "'|' ORDER BY s")):
    _tables = f"SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb, va, vb FROM {_IN_ORDER.format(by=_by, va='va', flag='R')} a FULL OUTER JOIN {_IN_ORDER.format(by=_by, va='vb', flag='A')} b ON a.k = b.k"
    query(_NM.replace(_PARTS, _tables).format(one="va = vb", same="va = vb"), f"recon_nm_{_name}")(lambda spark, sf_dir, m=_name: lines_in_order(spark, sf_dir, m))


def lines_in_order(spark, sf_dir, method: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_partkey", "l_returnflag", "l_linestatus AS s", "l_orderkey * 8 + l_linenumber AS o")
    return outcome(run(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), "l_partkey", [rule("s", kind="text", normalization_options={"aggregation_method": method})], nm_policy="aggregate", order_a="o", order_b="o"))


_SPELLED = "concat('Customer # ', c_custkey)"
_RESPELLED = f"CASE c_custkey % 6 WHEN 0 THEN concat('  ', {_SPELLED}, ' ') WHEN 1 THEN replace({_SPELLED}, ' ', '   ') WHEN 2 THEN replace({_SPELLED}, ' ', '') WHEN 3 THEN replace({_SPELLED}, '#', '') WHEN 4 THEN upper({_SPELLED}) ELSE {_SPELLED} END"
for _method, _norm in (("exact", "trim({v})"), ("trim", "trim({v})"), ("collapse_spaces", "trim(regexp_replace({v}, '\\s+', ' ', 'g'))"), ("remove_spaces", "regexp_replace({v}, '\\s+', '', 'g')"), ("remove_special", "regexp_replace(trim({v}), '[^0-9A-Za-z_\\s-]', '', 'g')"), ("ignore_case", "lower(trim({v}))")):
    query(f"SELECT CAST(c_custkey AS VARCHAR) AS key_display, CASE WHEN {_norm.format(v='a')} = {_norm.format(v='b')} THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, 1::BIGINT AS a_count, 1::BIGINT AS b_count, {_norm.format(v='b')} AS r1_normalized_b FROM (SELECT c_custkey, {_SPELLED} AS a, {_RESPELLED} AS b FROM customer)", f"recon_text_{_method}")(
        lambda spark, sf_dir, m=_method: respelled(spark, sf_dir, m)
    )


def respelled(spark, sf_dir, method: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    a, b = (rows.select("c_custkey", F.expr(v).alias("v")) for v in (_SPELLED, _RESPELLED))
    return outcome(run(a, b, "c_custkey", [rule("v", kind="text", method=method)]), first_rule("normalized_b"))


_KINDS = "CASE WHEN na = 0 THEN 'B_ONLY' WHEN nb = 0 THEN 'A_ONLY' WHEN na = 1 AND nb = 1 THEN 'ONE_TO_ONE' WHEN na = 1 THEN 'ONE_TO_MANY' WHEN nb = 1 THEN 'MANY_TO_ONE' ELSE 'MANY_TO_MANY' END"


@query(f"SELECT CAST(k AS VARCHAR) AS key, na AS a_count, nb AS b_count, {_KINDS} AS kind FROM ({_PARTS.format(agg='min(l_quantity)')})")
def cardinality_all_kinds(spark, sf_dir):
    a, b = parts(spark, sf_dir)
    config = compare("l_partkey", [rule("q")])
    counts = reconcile.cardinality(reconcile.keyed(a, config.dataset_a, assume_ascii=True), reconcile.keyed(b, config.dataset_b, assume_ascii=True))
    return counts.select(F.col("key.k0").alias("key"), "a_count", "b_count", "kind")


@query(f"SELECT count(*) FILTER (WHERE kind = 'ONE_TO_ONE') AS one_to_one, count(*) FILTER (WHERE kind = 'ONE_TO_MANY') AS one_to_many, count(*) FILTER (WHERE kind = 'MANY_TO_ONE') AS many_to_one, count(*) FILTER (WHERE kind = 'MANY_TO_MANY') AS many_to_many, count(*) FILTER (WHERE kind = 'A_ONLY') AS a_only, count(*) FILTER (WHERE kind = 'B_ONLY') AS b_only FROM (SELECT {_KINDS} AS kind FROM ({_PARTS.format(agg='min(l_quantity)')}))")
def cardinality_summary_all_kinds(spark, sf_dir):
    a, b = parts(spark, sf_dir)
    config = compare("l_partkey", [rule("q")])
    return reconcile.cardinality_summary(reconcile.cardinality(reconcile.keyed(a, config.dataset_a, assume_ascii=True), reconcile.keyed(b, config.dataset_b, assume_ascii=True)))


_TYPED = f"SELECT '[{{{{\"type\":\"int\",\"value\":\"' || CAST(k AS VARCHAR) || '\"}}}}]' AS key, CASE WHEN na = 0 THEN 'added' WHEN nb = 0 THEN 'removed' WHEN na = 1 AND nb = 1 THEN CASE WHEN {{one}} THEN 'matched' ELSE 'changed' END {{many}} END AS status, na AS a_count, nb AS b_count FROM ({_PARTS})"
_SAME = "WHEN va = vb THEN 'matched' ELSE 'changed'"
for _policy, _agg, _many, _rule in (
    ("report", "min(l_quantity)", "WHEN na = 1 OR nb = 1 THEN 'duplicate' ELSE 'nm-pending'", "q"), ("set", "list_sort(list(DISTINCT l_quantity))", _SAME, "q"), ("multiset", "list_sort(list(l_quantity))", _SAME, "q"),
    ("aggregate", "sum(l_quantity)", _SAME, "q"), ("representative", "max(CAST(l_shipdate AS DATE))", _SAME, "d"),
):
    query(_TYPED.format(agg=_agg, one="va = vb", many=_many), f"dialect_{_policy}")(lambda spark, sf_dir, p=_policy, c=_rule: typed_parts(spark, sf_dir, p, c))


def typed_parts(spark, sf_dir, policy: str, column: str) -> DataFrame:
    used = dialect.day("d") if column == "d" else dialect.number("q")
    return dialect.compare_typed(*parts(spark, sf_dir), dialect.Options(["l_partkey"], rules=[used], duplicate_policy=policy)).select("key", "status", "a_count", "b_count")


@query("SELECT '[{\"type\":\"int\",\"value\":\"' || CAST(o_orderkey AS VARCHAR) || '\"}]' AS key, round(abs(o_totalprice - b) / abs(o_totalprice), 9) AS rate_a, round(abs(o_totalprice - b) / abs(b), 9) AS rate_b FROM (SELECT o_orderkey, o_totalprice, o_totalprice * (1 + (o_orderkey % 5) / 100.0) AS b FROM orders)")
def dialect_rates(spark, sf_dir):
    a, b = scaled(spark, sf_dir)
    found = dialect.compare_typed(a, b, dialect.Options(["o_orderkey"], rules=[dialect.number("o_totalprice", b.columns[1])]))
    rate = lambda side: F.round(F.get(F.col("rates"), 0)[side], 9).alias(f"rate_{side}")
    return found.select("key", rate("a"), rate("b"))


_SCALAR = "CASE o_orderkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'bool' WHEN 3 THEN 'string' ELSE 'date' END"
_RAW = "CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS STRING) ELSE 'x1' END WHEN 1 THEN concat(o_orderkey % 100, '.5') WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'yes' END WHEN 3 THEN concat('s', o_orderkey) ELSE CASE WHEN o_orderkey % 2 = 0 THEN '2024-02-29' ELSE '2023-02-29' END END"


@query("SELECT o_orderkey, m NOT IN (5, 7, 9) AS ok, CASE WHEN m = 0 THEN o_orderkey END AS i, CASE WHEN m % 5 = 1 THEN o_orderkey % 100 + 0.5::DOUBLE END AS f, CASE WHEN m = 2 THEN true END AS b, CASE WHEN m % 5 = 3 THEN 's' || CAST(o_orderkey AS VARCHAR) END AS s, CASE WHEN m = 4 THEN DATE '2024-02-29' END AS d FROM (SELECT o_orderkey, o_orderkey % 10 AS m FROM orders)")
def scalar_decode(spark, sf_dir):
    made = F.struct(F.lit(1).alias("version"), F.expr(_SCALAR).alias("type"), F.expr(_RAW).alias("value"))
    tagged = table(spark, sf_dir, "orders").select("o_orderkey", made.alias("s"))
    return tagged.select("o_orderkey", scalar.valid(F.col("s")).alias("ok"), *[scalar.decode(F.col("s"), kind).alias(kind[0]) for kind in ("int", "float", "bool", "string", "date")])


_WIDE = "SELECT concat('c', c_custkey) AS canonical, concat('a', c_custkey) AS a1, concat('B', CAST(floor(c_custkey / 2) AS INT)) AS a2, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('A', c_custkey) END AS a3 FROM customer"


def wide_mapping(spark, sf_dir) -> mapping.Mapping:
    """A mapping of one group for each customer: shared, repeated and empty alias cells."""
    wide = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS canonical", "concat('a', c_custkey) AS a1", "concat('B', CAST(floor(c_custkey / 2) AS INT)) AS a2", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('A', c_custkey) END AS a3")
    return mapping.build(mapping.groups_from_wide(wide, "canonical", all_other_columns=True), KeyOptions(case_insensitive=True, unicode_normalize=False))


@query(f"SELECT alias, min(canonical) AS canonical FROM (SELECT lower(unnest([canonical, a1, a2, a3])) AS alias, canonical FROM ({_WIDE})) WHERE alias IS NOT NULL GROUP BY alias HAVING count(DISTINCT canonical) = 1")
def mapping_pairs_of_table(spark, sf_dir):
    return wide_mapping(spark, sf_dir).pairs.select("alias", "canonical")


@query(f"SELECT count(*) AS canonical_count, count(*) FILTER (WHERE a3 IS NULL) AS empty_alias_cell_count, CAST(sum(CASE WHEN a3 IS NULL THEN 2 ELSE 3 END) AS BIGINT) AS alias_count, count(*) FILTER (WHERE a3 IS NOT NULL) AS duplicate_alias_count, (SELECT count(*) FROM (SELECT a2 FROM ({_WIDE}) GROUP BY a2 HAVING count(*) > 1)) AS collision_alias_count FROM ({_WIDE})")
def mapping_stats_of_table(spark, sf_dir):
    return wide_mapping(spark, sf_dir).stats.select("canonical_count", "empty_alias_cell_count", "alias_count", "duplicate_alias_count", "collision_alias_count")


# --- rows in the table's own order, differences by value, row by row ----------------------------------

#: Rows of a table of one file in the order they stand in.
_PLACED = "(SELECT row_number() OVER () AS n, l_partkey AS k, l_returnflag AS f, l_linestatus AS s, l_quantity AS q, CAST(l_shipdate AS DATE) AS d FROM lineitem)"

for _policy, _pick in (("first", "arg_min"), ("last", "arg_max")):
    query(
        f"WITH l AS {_PLACED}, p AS (SELECT k, {_pick}(q, n) AS q, count(*) AS n FROM l GROUP BY k) "
        "SELECT CAST(p_partkey AS VARCHAR) AS key_display, CASE WHEN n IS NULL THEN 'A_ONLY' WHEN n > 1 THEN CASE WHEN q = p_size THEN 'DUP_EQUAL' ELSE 'DUP_DIFF' END WHEN q = p_size THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, 1::BIGINT AS a_count, coalesce(n, 0) AS b_count, p_size - q AS difference "
        "FROM part LEFT JOIN p ON p.k = p_partkey",
        f"recon_{_policy}_row",
    )(lambda spark, sf_dir, p=_policy: outcome(parts_and_rows(spark, sf_dir, p), first_rule("difference").alias("difference")))


def parts_and_rows(spark, sf_dir, policy: str) -> DataFrame:
    """Parts against their lines, of which the policy takes one by its place in the file."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    parts_ = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return run(parts_, lines, "p_partkey", [rule("p_size", "l_quantity")], join_type="left", duplicate_policy_b=DuplicatePolicy("B", policy))


_PLACED_VALUES = "(SELECT k, CAST(sum(c) AS BIGINT) AS n, string_agg(d, ' | ' ORDER BY f) AS v FROM (SELECT k, CAST(d AS VARCHAR) AS d, count(*) AS c, min(n) AS f FROM l WHERE f = '{flag}' GROUP BY 1, 2) GROUP BY 1)"


@query(
    f"WITH l AS {_PLACED} SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS key_display, a.v AS values_a, b.v AS values_b FROM {_PLACED_VALUES.format(flag='R')} a JOIN {_PLACED_VALUES.format(flag='A')} b ON a.k = b.k WHERE a.n > 1 AND b.n > 1"
)
def recon_values_in_row_order(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", F.col("l_shipdate").cast("date").alias("d"))
    result = run(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), "l_partkey", [rule("d", kind="date", normalization_options={"aggregation_method": "concat_unique"})], nm_policy="aggregate", join_type="inner")
    return result.where("cardinality = 'MANY_TO_MANY'").select("key_display", F.get("rules", 0).normalized_a.alias("values_a"), F.get("rules", 0).normalized_b.alias("values_b"))


_COUNTED = (
    "SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM (SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) a "
    "FULL OUTER JOIN (SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) b ON a.k = b.k AND a.v = b.v"
)


def value_table(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", F.col("l_shipdate").cast("date").alias("d"))
    return reconcile.value_differences(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), compare("l_partkey", [rule("d", kind="date")]), assume_ascii=True)


@query(f"SELECT CAST(k AS VARCHAR) AS key_display, 'r1' AS rule_id, CAST(v AS VARCHAR) AS value, x AS a_count, y AS b_count, CASE WHEN y = 0 THEN 'ONLY_A' WHEN x = 0 THEN 'ONLY_B' ELSE 'COMMON' END AS side, least(x, y) AS common, x - y AS difference FROM ({_COUNTED})")
def value_differences(spark, sf_dir):
    return value_table(spark, sf_dir).drop("key")


@query(
    f"SELECT CAST(k AS VARCHAR) AS key_display, count(*) FILTER (WHERE y = 0) AS n_only_a, count(*) FILTER (WHERE x = 0) AS n_only_b, count(*) FILTER (WHERE x > 0 AND y > 0) AS n_common, bool_and(x > 0 AND y > 0) AS same_set, bool_and(x = y) AS same_multiset, "
    "coalesce(array_to_string(list_sort(list(CAST(v AS VARCHAR)) FILTER (WHERE y = 0))[1:3], ','), '') AS only_a, coalesce(array_to_string(list_sort(list(CAST(v AS VARCHAR)) FILTER (WHERE x = 0))[1:3], ','), '') AS only_b, coalesce(array_to_string(list_sort(list(CAST(v AS VARCHAR)) FILTER (WHERE x > 0 AND y > 0))[1:3], ','), '') AS common "
    f"FROM ({_COUNTED}) GROUP BY k"
)
def difference_details(spark, sf_dir):
    details = reconcile.difference_details(value_table(spark, sf_dir), shown=3)
    return details.select("key_display", "n_only_a", "n_only_b", "n_common", "same_set", "same_multiset", *[F.array_join(c, ",").alias(c) for c in ("only_a", "only_b", "common")])


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS key_display, 'ONE_TO_MANY' AS cardinality, 'r1' AS rule_id, count(*) AS n_rows, count(*) FILTER (WHERE d <= 60) AS n_equal, count(*) FILTER (WHERE d > 60) AS n_different, 0::BIGINT AS n_failed, CAST(sum(d) AS DOUBLE) AS absolute_difference "
    "FROM (SELECT o_orderkey, abs(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY o_orderkey HAVING count(*) > 1"
)
def recon_1n_pairs(spark, sf_dir):
    config = compare("o_orderkey", [rule("o_orderdate", "l_shipdate", kind="date", tolerance_options=Tolerance(absolute=60))], duplicate_policy_b=DuplicatePolicy("B", "row"))
    return reconcile.row_totals(reconcile.row_pairs(*orders_and_lines(spark, sf_dir), config, assume_ascii=True))


# --- text beyond ASCII ---------------------------------------------------------------------------------

#: What a name is written as, and what compatibility forms, composition and case folding make of it.
_WIDE_FORMS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789#', 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９＃'"
_NARROW_FORMS = ", ".join(reversed(_WIDE_FORMS.split(", ")))
_NAMED = "concat(c_name, CASE c_custkey % 3 WHEN 0 THEN ' Café' WHEN 1 THEN ' Straße' ELSE ' ½ﬁ' END)"
_OTHERWISE = f"CASE c_custkey % 8 WHEN 0 THEN translate({_NAMED}, {_WIDE_FORMS}) WHEN 1 THEN replace({_NAMED}, 'é', concat('e', chr(769))) WHEN 2 THEN replace({_NAMED}, ' ', chr(12288)) WHEN 3 THEN replace({_NAMED}, ' ', chr(160)) WHEN 4 THEN replace(replace({_NAMED}, '½', '1⁄2'), 'ﬁ', 'fi') WHEN 5 THEN replace({_NAMED}, 'ß', 'SS') WHEN 6 THEN replace(translate({_NAMED}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'é', 'É') ELSE concat({_NAMED}, 'x') END"
_COMPATIBLE = f"trim(replace(replace(replace(replace(replace(translate({{v}}, {_NARROW_FORMS}), concat('e', chr(769)), 'é'), chr(12288), ' '), chr(160), ' '), '½', '1⁄2'), 'ﬁ', 'fi'))"
#: Small letters where each has one; SS stands for the sharp s.
_FOLDED = f"replace(lower(replace({_COMPATIBLE}, 'ß', 'ss')), 'É', 'é')"


def _spark_chr(sql: str) -> str:
    """The same expression for Spark, whose chr() ends at 255."""
    for code in (769, 12288, 160):
        sql = sql.replace(f"chr({code})", f"'{chr(code)}'")
    return sql


for _method, _form in (("exact", _COMPATIBLE), ("ignore_case", _FOLDED)):
    query(
        f"SELECT CAST(c_custkey AS VARCHAR) AS key_display, CASE WHEN {_form.format(v='a')} = {_form.format(v='b')} THEN 'IDENTICAL' ELSE 'FULL_MISMATCH' END AS status, 1::BIGINT AS a_count, 1::BIGINT AS b_count, {_form.format(v='b')} AS normalized FROM (SELECT c_custkey, {_NAMED} AS a, {_OTHERWISE} AS b FROM customer)",
        f"recon_unicode_{_method}",
    )(lambda spark, sf_dir, m=_method: outcome(named_otherwise(spark, sf_dir, m), first_rule("normalized_b").alias("normalized")))


def named_otherwise(spark, sf_dir, method: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    a, b = (rows.selectExpr("c_custkey", f"{_spark_chr(e)} AS v") for e in (_NAMED, _OTHERWISE))
    return reconcile.reconcile(a, b, compare("c_custkey", [rule("v", kind="text", method=method)]))


@query(f"SELECT {_FOLDED.format(v='b')} AS key_display, count(*) AS b_count FROM (SELECT {_OTHERWISE} AS b FROM customer) GROUP BY 1")
def key_unicode(spark, sf_dir):
    """Keys beyond ASCII, as both sides of a comparison write them."""
    rows = table(spark, sf_dir, "customer")
    a, b = (rows.selectExpr(f"{_spark_chr(e)} AS k", "c_acctbal") for e in (_NAMED, _OTHERWISE))
    result = reconcile.reconcile(a, b, compare("k", [rule("c_acctbal")], key_options=KeyOptions(case_insensitive=True)))
    return result.where("b_count > 0").select("key_display", "b_count")


# --- a result that is written once and read by sheet and page -------------------------------------------

_STATUSES = "SELECT 'mismatched' AS sheet, status, key_display FROM c WHERE status IN ('PARTIAL_MISMATCH', 'FULL_MISMATCH') UNION ALL SELECT 'a_only', status, key_display FROM c WHERE status = 'A_ONLY' UNION ALL SELECT 'b_only', status, key_display FROM c WHERE status = 'B_ONLY'"


@query(f"{_PERTURBED} SELECT sheet, count(*) AS n, min(key_display) AS first_key, max(key_display) AS last_key FROM ({_STATUSES}) GROUP BY sheet")
def view_stored_sheets(spark, sf_dir):
    stored = views.store(perturbed(spark, sf_dir))
    rows = [stored.sheet(name).select(F.lit(name).alias("sheet"), "key_display") for name in ("mismatched", "a_only", "b_only")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("sheet").agg(F.count("*").alias("n"), F.min("key_display").alias("first_key"), F.max("key_display").alias("last_key"))


@query(f"{_PERTURBED} SELECT key_display, status FROM c WHERE status IN ('PARTIAL_MISMATCH', 'FULL_MISMATCH') AND key_display >= '2' ORDER BY key_display LIMIT 50")
def view_stored_page(spark, sf_dir):
    return views.store(perturbed(spark, sf_dir)).page("mismatched", "2", 50).select("key_display", "status")


# --- one side prepared for several comparisons -----------------------------------------------------------


@query(f"{_PERTURBED} SELECT 'edited' AS against, status, count(*) AS n FROM c GROUP BY status UNION ALL SELECT 'itself', 'IDENTICAL', count(*) FROM orders")
def recon_prepared_side(spark, sf_dir):
    orders, edited = edited_orders(spark, sf_dir)
    config = compare("o_orderkey", _RULES)
    a = reconcile.prepare(orders, config, "A", assume_ascii=True)
    both = [reconcile.reconcile(a, b, config, assume_ascii=True).select(F.lit(name).alias("against"), "status") for name, b in (("edited", edited), ("itself", orders))]
    return both[0].unionByName(both[1]).groupBy("against", "status").agg(F.count("*").alias("n"))


# --- types by the first rows -------------------------------------------------------------------------------

_DAY = "concat('20', 10 + o_orderkey % 13, '-0', 1 + o_orderkey % 9, '-1', o_orderkey % 10)"
#: Days that show a time in every row, in some of the first, only in later ones, or behind many nulls.
_DAYS = {
    "always": f"concat({_DAY}, ' 10:30:00')", "early": f"CASE WHEN o_orderkey % 12 = 3 THEN concat({_DAY}, ' 08:00:00') ELSE {_DAY} END", "never": _DAY,
    "late": f"CASE WHEN o_orderkey > 400 THEN concat({_DAY}, ' 08:00:00') ELSE {_DAY} END", "sparse": f"CASE WHEN o_orderkey > 900 AND o_orderkey % 5 = 1 THEN CASE WHEN o_orderkey > 4000 THEN concat({_DAY}, ' 08:00') ELSE {_DAY} END END",
}


@query(
    f"WITH r AS (SELECT row_number() OVER () AS n, {', '.join(f'{e} AS {c}' for c, e in _DAYS.items())} FROM orders), u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", n, {c} AS v FROM r" for c in _DAYS) + "), "
    "f AS (SELECT \"column\", v, row_number() OVER (PARTITION BY \"column\" ORDER BY n) AS at FROM u WHERE v IS NOT NULL) "
    "SELECT \"column\", count(*) FILTER (WHERE v IS NULL) AS missing_count, count(DISTINCT v) AS unique_count, CASE WHEN (SELECT bool_or(contains(f.v, ' ')) FROM f WHERE f.at <= 20 AND f.\"column\" = u.\"column\") THEN 'datetime' ELSE 'date' END AS inferred_type FROM u GROUP BY \"column\""
)
def profile_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _DAYS.items()])
    return profile.profile_columns(rows).select("column", "missing_count", "unique_count", "inferred_type")
