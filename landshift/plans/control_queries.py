"""The control plane and the evaluation: nation is a portfolio, customer a polygon, orders runs, lineitem reviews, events audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.operators import control_plane as cp
from landshift.operators import evaluation, evidence
from landshift.operators.storage import scratch
from landshift.plans.registry import query, table
from landshift.sources import benchmark
from landshift.streaming import monitoring

STATUS = "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END"


def runs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("polygon_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), "o_totalprice")


def review_rows(spark, sf_dir):
    state = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "approved").otherwise("pending")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("finding_idx"), state.alias("state"), "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )


SEQ = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
REVIEWS = """WITH rv AS (SELECT l_orderkey AS run_id, l_linenumber AS finding_idx, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'approved' ELSE 'pending' END AS state, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
up AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, finding_idx ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS n FROM rv) WHERE n = 1)
"""


def reviews(spark, sf_dir):
    return cp.upserted(review_rows(spark, sf_dir), ["run_id", "finding_idx"], SEQ)


def portfolios(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("portfolio_id"), F.col("n_name").alias("name"))


def polygon_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("polygon_id"), F.col("c_nationkey").alias("portfolio_id"), F.col("c_name").alias("label"))


@query("SELECT n_nationkey AS portfolio_id, n_name AS name, count(c_custkey) AS n_polygons FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def portfolio_list(spark, sf_dir):
    return portfolios(spark, sf_dir).join(polygon_rows(spark, sf_dir), "portfolio_id", "left").groupBy("portfolio_id", "name").agg(F.count("polygon_id").alias("n_polygons"))


@query(f"SELECT c_nationkey AS portfolio_id, o_orderkey AS run_id, o_custkey AS polygon_id, {STATUS} AS status FROM orders JOIN customer ON c_custkey = o_custkey")
def run_list(spark, sf_dir):
    """The runs of every portfolio."""
    return runs(spark, sf_dir).join(polygon_rows(spark, sf_dir), "polygon_id").select("portfolio_id", "run_id", "polygon_id", "status")


@query("SELECT c_nationkey AS portfolio_id, coalesce(max(coalesce(TRY_CAST(nullif(regexp_extract(c_name, '(\\d+)\\s*$', 1), '') AS BIGINT), 0)), 0) + 1 AS next_number FROM customer GROUP BY 1")
def next_label(spark, sf_dir):
    """The number that a portfolio's next label gets."""
    return polygon_rows(spark, sf_dir).groupBy("portfolio_id").agg((F.max(cp.label_suffix(F.col("label"))) + 1).alias("next_number"))


@query(
    """WITH k AS (SELECT c_custkey AS id, sha256('key_' || CAST(c_custkey AS VARCHAR)) AS key_hash FROM customer), p AS (SELECT sha256('key_' || CAST(user_id AS VARCHAR)) AS key_hash, max(ts) AS seen, count(*) AS uses FROM events GROUP BY 1)
SELECT id, CAST(epoch_us(seen) AS BIGINT) AS last_used_us, coalesce(uses, 0) AS uses FROM k LEFT JOIN p USING (key_hash)"""
)
def api_key_touch(spark, sf_dir):
    keyed = lambda c: cp.key_hash(F.concat(F.lit("key_"), F.col(c).cast("string")))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), keyed("c_custkey").alias("key_hash"), F.lit(None).cast("timestamp").alias("last_used"))
    presented = table(spark, sf_dir, "events").select(keyed("user_id").alias("key_hash"), F.col("ts").cast("timestamp").alias("ts"))
    return cp.key_touched(keys, presented).select("id", F.unix_micros("last_used").alias("last_used_us"), "uses")


@query(
    REVIEWS
    + """, q AS (SELECT n_nationkey AS portfolio_id, CASE n_nationkey % 4 WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN 'pending' END AS wanted FROM nation)
SELECT portfolio_id, run_id, finding_idx, state FROM up JOIN orders ON o_orderkey = run_id JOIN customer ON c_custkey = o_custkey JOIN q ON portfolio_id = c_nationkey WHERE wanted IS NULL OR wanted = state"""
)
def reviews_of_portfolio(spark, sf_dir):
    k = F.col("portfolio_id") % 4
    asked = portfolios(spark, sf_dir).select("portfolio_id", F.when(k == 1, "approved").when(k == 2, "rejected").when(k == 3, "pending").alias("state"))
    return cp.reviews_of(reviews(spark, sf_dir), runs(spark, sf_dir), polygon_rows(spark, sf_dir), asked).select("portfolio_id", "run_id", "finding_idx", "state")


@query(
    """WITH p AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_ FROM events)
SELECT event_id, user_id FROM p WHERE status = 'completed' AND coalesce(before_, '') <> 'purchase'"""
)
def completion_edges(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "completed").otherwise("running")
    return cp.completion_edges(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", status.alias("status")), "user_id", ["ts", "event_id"]).select("event_id", "user_id")


@query("SELECT source, sum(octet_length(encode(text))) / 1e6 AS mb FROM documents GROUP BY source")
def directory_size(spark, sf_dir):
    """Megabytes of each directory's files; a source stands for a directory, a text for a file."""
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("directory"), F.octet_length(F.encode("text", "utf-8")).alias("length"))
    return evidence.directory_sizes(files).withColumnRenamed("directory", "source")


@query(REVIEWS + "SELECT run_id, finding_idx, state, l_partkey FROM up")
def review_upsert(spark, sf_dir):
    return reviews(spark, sf_dir).select("run_id", "finding_idx", "state", "l_partkey")


@query(REVIEWS + "SELECT state, count(*) AS n, count(DISTINCT run_id) AS n_runs FROM up GROUP BY state")
def reviews_by_state(spark, sf_dir):
    return reviews(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("n_runs"))


@query(REVIEWS + "SELECT run_id, finding_idx, state FROM up WHERE state <> 'pending'")
def feedback_export(spark, sf_dir):
    return reviews(spark, sf_dir).where("state <> 'pending'").select("run_id", "finding_idx", "state")


@query(REVIEWS + "SELECT o_custkey AS polygon_id, CAST(count_if(state = 'approved') AS BIGINT) AS approved, CAST(count_if(state = 'rejected') AS BIGINT) AS rejected, least(100e0, count_if(state <> 'pending') / 20e0 * 100) AS progress FROM up JOIN orders ON o_orderkey = run_id GROUP BY 1")
def review_progress(spark, sf_dir):
    both = reviews(spark, sf_dir).join(runs(spark, sf_dir), "run_id")
    done = F.count_if(F.col("state") != "pending")
    return both.groupBy("polygon_id").agg(F.count_if(F.col("state") == "approved").alias("approved"), F.count_if(F.col("state") == "rejected").alias("rejected"), F.least(F.lit(100.0), done / 20.0 * 100).alias("progress"))


@query(f"SELECT o_orderkey AS run_id, l_linenumber AS finding_idx, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {STATUS} = 'completed' GROUP BY 1, 2")
def findings_union(spark, sf_dir):
    done = runs(spark, sf_dir).where("status = 'completed'")
    return done.join(review_rows(spark, sf_dir), "run_id").groupBy("run_id", "finding_idx").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS portfolio_id, c_custkey AS polygon_id, n_name AS name, c_name AS label, 'pending' AS status FROM nation JOIN customer ON c_nationkey = n_nationkey")
def run_fanout(spark, sf_dir):
    return cp.fan_out(portfolios(spark, sf_dir), polygon_rows(spark, sf_dir)).select("portfolio_id", "polygon_id", "name", "label", "status")


@query(
    """WITH gone AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1), dp AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT k FROM gone)), dr AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM dp))
SELECT 'portfolios' AS tbl, count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT k FROM gone) UNION ALL SELECT 'polygons', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'runs', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM dp) UNION ALL SELECT 'reviews', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM dr)"""
)
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("portfolio_id"))
    left = cp.portfolio_deleted(portfolios(spark, sf_dir), polygon_rows(spark, sf_dir), runs(spark, sf_dir), review_rows(spark, sf_dir), gone)
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.union(one)
    return out


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'failed' ELSE 'completed' END AS status FROM orders")
def reconcile(spark, sf_dir):
    return cp.reconciled(runs(spark, sf_dir)).select("run_id", "status")


@query("SELECT event_id AS id, event_type AS action FROM events ORDER BY event_id DESC LIMIT 1000")
def audit_tail(spark, sf_dir):
    return monitoring.audit_rows(table(spark, sf_dir, "events")).orderBy(F.desc("id")).limit(1000).select("id", "action")


@query("SELECT c_custkey AS id, coalesce(TRY_CAST(nullif(regexp_extract(c_name, '(\\d+)\\s*$', 1), '') AS BIGINT), 0) AS suffix FROM customer")
def label_suffix(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), cp.label_suffix(F.col("c_name")).alias("suffix"))


@query(
    """WITH c AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS bf, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 5 AS INTEGER) AS bt, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 70 AS INTEGER) AS af, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS at_, (o_orderkey % 12) / 10e0 AS cloud FROM orders)
SELECT id, CASE WHEN id % 17 = 0 THEN 'bad date' WHEN bf > bt THEN 'before window reversed' WHEN af > at_ THEN 'after window reversed' WHEN bt >= af THEN 'windows overlap' WHEN NOT (cloud > 0 AND cloud <= 1) THEN 'bad cloud fraction' END AS error FROM c"""
)
def validate_portfolio(spark, sf_dir):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    later = lambda n: F.date_add(day, n.cast("int")).cast("string")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 17 == 0, "2024-02-30").otherwise(day.cast("string")).alias("before_from"), later(k % 40 - 5).alias("before_to"), later(k % 70).alias("after_from"), later(k % 90).alias("after_to"), (k % 12 / 10.0).alias("max_cloud_fraction")
    )
    return rows.select("id", cp.config_error().alias("error"))


@query("SELECT c_custkey AS id, sha256('key_' || CAST(c_custkey AS VARCHAR)) AS key_hash FROM customer")
def api_key_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), cp.key_hash(F.concat(F.lit("key_"), F.col("c_custkey").cast("string"))).alias("key_hash"))


@query(
    f"""SELECT o_orderkey AS run_id, v AS violated FROM orders, (SELECT unnest(['status', 'price']) AS v) WHERE (v = 'status' AND {STATUS} NOT IN ('pending', 'completed')) OR (v = 'price' AND NOT o_totalprice > 50000)"""
)
def constraint_audit(spark, sf_dir):
    checks = {"status": F.col("status").isin("pending", "completed"), "price": F.col("o_totalprice") > 50000}
    return cp.violations(runs(spark, sf_dir), checks).select("run_id", "violated")


FAULTY = """WITH po AS (SELECT CASE WHEN n_nationkey % 12 <> 11 THEN n_nationkey END AS id, CASE WHEN n_nationkey % 5 <> 4 THEN n_name END AS name FROM nation),
pp AS (SELECT c_custkey // (1 + CAST(c_custkey % 100 = 7 AS INTEGER)) AS id, CASE WHEN c_custkey % 40 <> 3 THEN c_nationkey END AS portfolio_id FROM customer),
ru AS (SELECT o_orderkey AS id, o_custkey + o_orderkey % 50 AS polygon_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'walking' ELSE 'completed' END AS status FROM orders),
rv AS (SELECT l_orderkey + l_linenumber // 7 * 100000000 AS run_id, CASE WHEN l_linenumber <> 5 THEN l_linenumber END AS finding_idx, CASE l_returnflag WHEN 'R' THEN 'uncertain' WHEN 'A' THEN 'approved' ELSE 'lost' END AS state FROM lineitem),
ak AS (SELECT sha256(CAST(c_custkey % 900 AS VARCHAR)) AS key_hash, c_name AS user_name FROM customer),
al AS (SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN event_type END AS action FROM events)
"""


def faulty(spark, sf_dir):
    """The six tables, written by nobody who looked at their constraints."""
    k, c, o, e = F.col("n_nationkey"), F.col("c_custkey"), F.col("o_orderkey"), F.col("event_id")
    line, state = F.col("l_linenumber"), F.col("l_returnflag")
    t = lambda name: table(spark, sf_dir, name)
    return {
        "portfolios": t("nation").select(F.when(k % 12 != 11, k).alias("id"), F.when(k % 5 != 4, F.col("n_name")).alias("name")),
        "portfolio_polygons": t("customer").select(F.when(c % 100 == 7, F.expr("c_custkey div 2")).otherwise(c).alias("id"), F.when(c % 40 != 3, F.col("c_nationkey")).alias("portfolio_id")),
        "runs": t("orders").select(o.alias("id"), (F.col("o_custkey") + o % 50).alias("polygon_id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "walking").otherwise("completed").alias("status")),
        "reviews": t("lineitem").select((F.col("l_orderkey") + F.when(line == 7, 100000000).otherwise(0)).alias("run_id"), F.when(line != 5, line).alias("finding_idx"), F.when(state == "R", "uncertain").when(state == "A", "approved").otherwise("lost").alias("state")).withColumn("id", F.col("run_id")),
        "api_keys": t("customer").select(F.sha2((c % 900).cast("string"), 256).alias("key_hash"), F.col("c_name").alias("user_name")),
        "audit_log": t("events").select(e.alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("action")),
    }


def _broken() -> str:
    """The SQL of every rule over the faulty tables."""
    named = {"portfolios": "po", "portfolio_polygons": "pp", "runs": "ru", "reviews": "(SELECT *, run_id AS id FROM rv)", "api_keys": "ak", "audit_log": "al"}
    have = {"portfolios": ("id", "name"), "portfolio_polygons": ("id", "portfolio_id"), "runs": ("id", "polygon_id", "status"), "reviews": ("id", "run_id", "finding_idx", "state"), "api_keys": ("key_hash", "user_name"), "audit_log": ("id", "action")}
    rule = lambda name, text, key, rest, n="count(*)": f"SELECT '{name}' AS \"table\", '{text}' AS rule, {key} AS key, {n} AS n FROM {named[name]} {rest}"
    out = []
    for name, cols in have.items():
        key = cp.UNIQUE[name][0][0]
        out += [rule(name, f"{c} not null", f"CAST({key} AS VARCHAR)", f"WHERE {c} IS NULL GROUP BY {key}") for c in cp.NOT_NULL[name] if c in cols]
        if name in cp.STATES:
            c, allowed = cp.STATES[name]
            out.append(rule(name, f"{c} check", f"CAST({key} AS VARCHAR)", f"WHERE {c} NOT IN {allowed} GROUP BY {key}"))
        for u in cp.UNIQUE[name]:
            out.append(rule(name, f"{', '.join(u)} unique", " || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in u), f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in u)} GROUP BY {', '.join(u)} HAVING count(*) > 1", "count(*) - 1"))
        for c, parent in cp.PARENTS.get(name, {}).items():
            if c in cols:
                out.append(rule(name, f"{c} references {parent}", f"CAST({c} AS VARCHAR)", f"WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {named[parent]} WHERE id IS NOT NULL) GROUP BY {c}"))
    return " UNION ALL ".join(out)


@query(FAULTY + _broken())
def integrity_audit(spark, sf_dir):
    """Every constraint of the six tables, NOT NULL, CHECK, UNIQUE and REFERENCES, against tables that break them."""
    return cp.audited(faulty(spark, sf_dir))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_changes FROM events GROUP BY user_id")
def run_state_latest(spark, sf_dir):
    return cp.latest_state(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT doc_id, octet_length(encode(text)) AS size, 'sha256:' || sha256(text) AS sha256 FROM documents")
def artifact_index(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("name"), F.encode("text", "utf-8").alias("content"))
    return evidence.artifact_index(files).select(F.substring_index("name", ".", 1).cast("long").alias("doc_id"), "size", "sha256")


@query("SELECT event_id, event_type IN ('view', 'click') AS fetchable FROM events")
def artifact_allowed(spark, sf_dir):
    named = F.when(F.col("event_type") == "view", "provenance.json").when(F.col("event_type") == "click", "findings.geojson").otherwise("../secret")
    return table(spark, sf_dir, "events").select("event_id", evidence.fetchable(named).alias("fetchable"))


def examples(spark, sf_dir, arm: int):
    """An example an order: n lines, m of them in range; the second arm finds more."""
    q = F.col("l_quantity")
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("example_id")).agg(
        F.count("*").alias("n"), F.count_if(q < 25 + 10 * arm).alias("m"), F.max("l_returnflag").alias("holdout_group")
    )
    k = F.col("example_id")
    return evaluation.counted(
        per.select(
            "example_id", "holdout_group", "n", "m", F.when(k % 5 == 0, "abstention").otherwise("findings").alias("expected"), F.when(k % 7 == arm, "abstention").otherwise("findings").alias("actual"),
            F.lit(1).cast("long").alias("min_count"), (k % 4 + 1).alias("max_count"),
        )
    )


def _ex(arm: int) -> str:
    return f"""e{arm} AS (SELECT *, CASE WHEN expected = 'findings' AND actual = 'findings' THEN least(m, hi) ELSE 0 END AS tp,
  CASE WHEN expected = 'findings' AND actual = 'findings' THEN n - m + greatest(0, m - hi) WHEN actual = 'findings' AND expected = 'abstention' THEN n ELSE 0 END AS fp,
  CASE WHEN expected = 'findings' AND actual = 'findings' THEN greatest(0, 1 - m) WHEN expected = 'findings' THEN 1 ELSE 0 END AS fn
  FROM (SELECT l_orderkey AS example_id, max(l_returnflag) AS holdout_group, count(*) AS n, count_if(l_quantity < {25 + 10 * arm}) AS m, l_orderkey % 4 + 1 AS hi,
    CASE WHEN l_orderkey % 5 = 0 THEN 'abstention' ELSE 'findings' END AS expected, CASE WHEN l_orderkey % 7 = {arm} THEN 'abstention' ELSE 'findings' END AS actual FROM lineitem GROUP BY l_orderkey))"""


_M = """round(coalesce(sum(tp) / nullif(CAST(sum(tp) + sum(fp) AS DOUBLE), 0), 1), 9) AS precision_at_k, round(coalesce(sum(tp) / nullif(CAST(sum(tp) + sum(fn) AS DOUBLE), 0), 1), 9) AS recall_at_k, round(sum(fp) * 100e0 / count(*), 6) AS fp_rate,
 round(coalesce(count_if(actual = 'abstention' AND expected = 'abstention') / nullif(CAST(greatest(count_if(actual = 'abstention'), count_if(expected = 'abstention')) AS DOUBLE), 0), 1), 9) AS abstention_accuracy, round(avg(n), 9) AS mean_finding_count, count(*) AS n_examples"""


def _rounded(df):
    digits = {"precision_at_k": 9, "recall_at_k": 9, "fp_rate": 6, "abstention_accuracy": 9, "mean_finding_count": 9}
    return df.withColumns({k: F.round(k, d) for k, d in digits.items()})


@query(f"WITH {_ex(0)} SELECT example_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM e0")
def tp_fp_fn(spark, sf_dir):
    return examples(spark, sf_dir, 0).select("example_id", "tp", "fp", "fn")


@query(f"WITH {_ex(0)} SELECT {_M} FROM e0")
def metrics(spark, sf_dir):
    return _rounded(examples(spark, sf_dir, 0).agg(*evaluation.metrics()))


@query(f"WITH {_ex(0)} SELECT holdout_group, {_M} FROM e0 GROUP BY holdout_group")
def holdout_metrics(spark, sf_dir):
    return _rounded(examples(spark, sf_dir, 0).groupBy("holdout_group").agg(*evaluation.metrics()))


@query(
    f"""WITH {_ex(0)}, {_ex(1)}, p AS (SELECT (SELECT sum(tp) / CAST(sum(tp) + sum(fp) AS DOUBLE) FROM e0) AS a, (SELECT sum(tp) / CAST(sum(tp) + sum(fp) AS DOUBLE) FROM e1) AS b, (SELECT count(*) FROM e0) AS n)
SELECT round(a, 9) AS baseline_precision, round(b, 9) AS other_precision, n AS n_examples, round(b - a, 9) AS delta_precision, CASE WHEN n < 10 THEN 'insufficient_data' WHEN b - a >= 0.10 THEN 'other_wins' WHEN b - a < 0 THEN 'baseline_wins' ELSE 'tie' END AS decision FROM p"""
)
def decision_gate(spark, sf_dir):
    out = evaluation.gate(examples(spark, sf_dir, 0), examples(spark, sf_dir, 1))
    return out.withColumns({k: F.round(k, 9) for k in ("baseline_precision", "other_precision", "delta_precision")})


@query(
    f"""WITH {_ex(0)}, {_ex(1)}, a AS (SELECT holdout_group, sum(tp) / CAST(sum(tp) + sum(fp) AS DOUBLE) AS p, count(*) AS n FROM e0 GROUP BY 1), b AS (SELECT holdout_group, sum(tp) / CAST(sum(tp) + sum(fp) AS DOUBLE) AS p FROM e1 GROUP BY 1)
SELECT holdout_group, printf('| %s | %.4f | %.4f | %+.4f | %d |', holdout_group, a.p, b.p, b.p - a.p, n) AS line FROM a JOIN b USING (holdout_group)"""
)
def eval_report(spark, sf_dir):
    precision = evaluation.ratio(F.sum("tp"), F.sum("tp") + F.sum("fp"), 1.0)
    a = examples(spark, sf_dir, 0).groupBy("holdout_group").agg(precision.alias("baseline_precision"), F.count("*").alias("n_examples"))
    b = examples(spark, sf_dir, 1).groupBy("holdout_group").agg(precision.alias("other_precision"))
    return evaluation.report_lines(a.join(b, "holdout_group"), "holdout_group")


@query(f"WITH {_ex(0)}, {_ex(1)} SELECT example_id, CAST(a.tp AS BIGINT) AS tp_baseline, CAST(b.tp AS BIGINT) AS tp_other, CAST(b.fp - a.fp AS BIGINT) AS fp_change FROM e0 a JOIN e1 b USING (example_id)")
def paired_arms(spark, sf_dir):
    out = evaluation.paired(examples(spark, sf_dir, 0), examples(spark, sf_dir, 1), "example_id")
    return out.select("example_id", "tp_baseline", "tp_other", (F.col("fp_other") - F.col("fp_baseline")).alias("fp_change"))


@query(
    f"""WITH {_ex(0)}, {_ex(1)}, a AS (SELECT {_M} FROM e0), b AS (SELECT {_M} FROM e1)
SELECT round(b.precision_at_k - a.precision_at_k, 6) AS delta_precision_at_k, round(b.recall_at_k - a.recall_at_k, 6) AS delta_recall_at_k, round(b.fp_rate - a.fp_rate, 3) AS delta_fp_rate,
 round(b.abstention_accuracy - a.abstention_accuracy, 6) AS delta_abstention_accuracy, round(b.mean_finding_count - a.mean_finding_count, 6) AS delta_mean_finding_count FROM a, b"""
)
def report_delta(spark, sf_dir):
    out = evaluation.deltas(examples(spark, sf_dir, 0), examples(spark, sf_dir, 1))
    return out.select(*(F.round(c, 3 if "fp_rate" in c else 6).alias(c) for c in out.columns))


@query(
    """WITH f AS (SELECT p_partkey // 4 AS k, ['aoi.geojson', 'expected.json', 'request.json', 'notes.txt'][p_partkey % 4 + 1] AS name, p_name AS content FROM part WHERE p_size <> 7)
SELECT 'example_' || k AS example, max(content) FILTER (name = 'aoi.geojson') AS aoi, max(content) FILTER (name = 'expected.json') AS expected, max(content) FILTER (name = 'request.json') AS request
FROM f GROUP BY k HAVING count_if(name = 'aoi.geojson') > 0 AND count_if(name = 'expected.json') > 0"""
)
def benchmark_examples(spark, sf_dir):
    """Examples of a directory tree that parts stand for: four files to a directory, some of them missing."""
    k, names = F.expr("p_partkey div 4").cast("string"), F.array(*map(F.lit, ("aoi.geojson", "expected.json", "request.json", "notes.txt")))
    files = table(spark, sf_dir, "part").where("p_size <> 7").select(F.concat(F.lit("bench/example_"), k, F.lit("/"), F.get(names, (F.col("p_partkey") % 4).cast("int"))).alias("path"), F.col("p_name").alias("content"))
    return benchmark.examples(files).select("example", "aoi", "expected", "request")


def _refilled(tokens: str, at: str, burst: float, rate: float) -> str:
    """SQL of a bucket's tokens at the time of the next event."""
    return f"CASE WHEN {at} IS NULL THEN {tokens} ELSE least({burst}e0, {tokens} + greatest(0e0, e.ts - {at}) * {rate}e0) END"


@query(
    f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, epoch_us(ts) / 1e6 / 50000 AS ts, event_type = 'purchase' AS is_run,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s(key, n, seq, ts, is_run, g, gt, r, rt, allowed, retry_after) AS (
  SELECT key, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), false, 120e0, CAST(NULL AS DOUBLE), 12e0, CAST(NULL AS DOUBLE), false, CAST(NULL AS BIGINT) FROM e WHERE n = 1
  UNION ALL
  SELECT key, n, seq, ts, is_run, CASE WHEN g1 >= 1 THEN g1 - 1 ELSE g1 END, ts, CASE WHEN NOT (g1 >= 1 AND is_run) THEN r0 WHEN r1 >= 1 THEN r1 - 1 ELSE r1 END, CASE WHEN g1 >= 1 AND is_run THEN ts ELSE rt END,
    g1 >= 1 AND (NOT is_run OR r1 >= 1), CAST(CASE WHEN g1 < 1 THEN ceil((1 - g1) / 2e0) WHEN is_run AND r1 < 1 THEN ceil((1 - r1) / 0.2e0) END AS BIGINT)
  FROM (SELECT e.*, {_refilled('g0', 'gt', 120, 2)} AS g1, {_refilled('r0', 'rt', 12, 0.2)} AS r1, r0, rt
    FROM (SELECT s.*, s.n + 1 AS next_, CASE WHEN f.ts - s.gt >= 600 THEN 120e0 ELSE s.g END AS g0, CASE WHEN f.ts - s.gt >= 600 THEN 12e0 ELSE s.r END AS r0
      FROM s JOIN e f ON f.key IS NOT DISTINCT FROM s.key AND f.n = s.n + 1) b JOIN e ON e.key IS NOT DISTINCT FROM b.key AND e.n = b.next_))
SELECT key, seq, ts, is_run, allowed, retry_after FROM s WHERE n > 0"""
)
def rate_limit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return monitoring.rate_limited(e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (ts / 50000).alias("ts"), (F.col("event_type") == "purchase").alias("is_run")))


@query("SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1")
def audit_stream(spark, sf_dir):
    """The audit log of a stream over the events' file, written and read back."""
    path = scratch(spark)
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    monitoring.audit_to(stream, f"{path}/log", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/log").groupBy("action").agg(F.count("*").alias("n"))
