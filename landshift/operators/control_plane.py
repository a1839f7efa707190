"""Tables of portfolios, polygons, runs, reviews, keys and audits: DML as DataFrame expressions.

Parquet has no row-level writes, so each function returns the table's new state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states that the tables' checks allow.
RUN_STATES = ("pending", "running", "completed", "abstained", "failed")
REVIEW_STATES = ("pending", "approved", "rejected", "uncertain")

SCHEMAS = {
    "portfolios": "id string, name string, task string, before_from string, before_to string, after_from string, after_to string, max_cloud_fraction double, created_at string",
    "portfolio_polygons": "id string, portfolio_id string, label string, geometry string, created_at string",
    "runs": "id string, portfolio_id string, polygon_id string, status string, output_dir string, created_at string, updated_at string",
    "reviews": "id long, run_id string, portfolio_id string, finding_idx int, state string, notes string, created_at string",
    "api_keys": "id string, key_hash string, user_name string, created_at string, last_used string",
    "audit_log": "id long, user_name string, action string, resource string, status int, created_at string",
}


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check of the row itself, with its name: what CHECK and NOT NULL would have refused.  ``audited`` has UNIQUE and FOREIGN KEY too."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("violated", F.explode(broken))


#: What the six tables demand: columns that may not be null, columns that are one row's alone, parents, and the states allowed.
NOT_NULL = {
    "portfolios": ("id", "name", "created_at"), "portfolio_polygons": ("id", "portfolio_id", "geometry", "created_at"), "runs": ("id", "status", "created_at"),
    "reviews": ("id", "run_id", "finding_idx", "state", "created_at"), "api_keys": ("key_hash", "user_name", "created_at"), "audit_log": ("id", "action", "status", "created_at"),
}
UNIQUE = {"portfolios": (("id",),), "portfolio_polygons": (("id",),), "runs": (("id",),), "reviews": (("id",), ("run_id", "finding_idx")), "api_keys": (("key_hash",),), "audit_log": (("id",),)}
PARENTS = {"portfolio_polygons": {"portfolio_id": "portfolios"}, "runs": {"portfolio_id": "portfolios", "polygon_id": "portfolio_polygons"}, "reviews": {"run_id": "runs", "portfolio_id": "portfolios"}}
STATES = {"runs": ("status", RUN_STATES), "reviews": ("state", REVIEW_STATES)}


def audited(tables: dict[str, DataFrame]) -> DataFrame:
    """What the tables' constraints would have refused: ``table``, ``rule``, ``key`` and the number ``n`` of rows that break it.

    A key is that of the row (NOT NULL, CHECK), the value that several rows have (UNIQUE, counted
    without the first of them), or the parent that is missing (REFERENCES); nulls are no value
    and need no parent.  Rows are counted by key before anything is exchanged, so a value that
    many rows share is one row, and parents are met by the distinct values asked for.  Columns
    that a table lacks are not looked at.
    """
    out = None

    def told(name: str, rule: str, rows: DataFrame, key: Column, n: Column) -> None:
        nonlocal out
        one = rows.select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), n.cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)

    for name, df in tables.items():
        have = set(df.columns)
        key = UNIQUE[name][0][0]
        for c in NOT_NULL[name]:
            if c in have:
                told(name, f"{c} not null", df.where(F.col(c).isNull()).groupBy(key).agg(F.count("*").alias("n")), F.col(key), F.col("n"))
        if name in STATES and STATES[name][0] in have:
            c, allowed = STATES[name]
            told(name, f"{c} check", df.where(~F.col(c).isin(*allowed)).groupBy(key).agg(F.count("*").alias("n")), F.col(key), F.col("n"))
        for cols in UNIQUE[name]:
            if have.issuperset(cols):
                many = df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")
                told(name, f"{', '.join(cols)} unique", many, F.concat_ws("/", *cols), F.col("n") - 1)
        for c, parent in PARENTS.get(name, {}).items():
            if c in have and parent in tables:
                asked = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
                ids = tables[parent].select(F.col("id").alias(c)).distinct()
                told(name, f"{c} references {parent}", asked.join(ids, c, "left_anti"), F.col(c), F.col("n"))
    return out


def upserted(rows: DataFrame, key: list[str], sequence: list[str]) -> DataFrame:
    """Of the rows with one key the last written."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(s) for s in sequence])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows that new ones don't replace, and the new ones."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def updated(df: DataFrame, match: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({k: F.when(match, v).otherwise(F.col(k)) for k, v in values.items()})


def portfolio_deleted(portfolios: DataFrame, polygons: DataFrame, runs: DataFrame, reviews: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the portfolios in ``gone`` (portfolio_id) and what hangs on them; reviews go by their run."""
    dead_polygons = polygons.join(gone, "portfolio_id", "left_semi").select("polygon_id")
    dead_runs = runs.join(dead_polygons, "polygon_id", "left_semi").select("run_id")
    return {
        "portfolios": portfolios.join(gone, "portfolio_id", "left_anti"),
        "polygons": polygons.join(gone, "portfolio_id", "left_anti"),
        "runs": runs.join(dead_polygons, "polygon_id", "left_anti"),
        "reviews": reviews.join(dead_runs, "run_id", "left_anti"),
    }


def reconciled(runs: DataFrame) -> DataFrame:
    """Runs that a restart interrupted have failed."""
    return updated(runs, F.col("status").isin("pending", "running"), {"status": F.lit("failed")})


def fan_out(portfolios: DataFrame, polygons: DataFrame) -> DataFrame:
    """One pending run a polygon, with its portfolio's configuration."""
    return portfolios.join(polygons, "portfolio_id").withColumn("status", F.lit("pending"))


def config_error() -> Column:
    """Dates that don't parse or don't follow one another (the windows must not touch), clouds outside (0, 1]."""
    d = {k: F.try_to_date(F.col(k), "yyyy-MM-dd") for k in ("before_from", "before_to", "after_from", "after_to")}
    parsed = d["before_from"].isNotNull() & d["before_to"].isNotNull() & d["after_from"].isNotNull() & d["after_to"].isNotNull()
    return (
        F.when(~parsed, "bad date")
        .when(d["before_from"] > d["before_to"], "before window reversed")
        .when(d["after_from"] > d["after_to"], "after window reversed")
        .when(d["before_to"] >= d["after_from"], "windows overlap")
        .when(~((F.col("max_cloud_fraction") > 0) & (F.col("max_cloud_fraction") <= 1)), "bad cloud fraction")
    )


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def key_touched(keys: DataFrame, presented: DataFrame) -> DataFrame:
    """The key table with ``last_used`` moved to the newest time at which a key of that hash was presented; unknown keys touch nothing."""
    seen = presented.groupBy("key_hash").agg(F.max("ts").alias("_seen"), F.count("*").alias("uses"))
    return keys.join(seen, "key_hash", "left").withColumns({"last_used": F.greatest("last_used", "_seen"), "uses": F.coalesce("uses", F.lit(0))}).drop("_seen")


def reviews_of(reviews: DataFrame, runs: DataFrame, polygons: DataFrame, asked: DataFrame) -> DataFrame:
    """The reviews of each asked portfolio and state (null: any state; a missing portfolio has none), one plan for all who ask."""
    placed = reviews.join(runs.select("run_id", "polygon_id"), "run_id").join(polygons.select("polygon_id", "portfolio_id"), "polygon_id")
    return placed.join(asked.withColumnRenamed("state", "_state"), "portfolio_id").where(F.col("_state").isNull() | (F.col("_state") == F.col("state"))).drop("_state")


def completion_edges(polls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Polls at which a key's status is completed and was not at the poll before: when its findings are to be read again."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    return polls.withColumn("_before", before).where((F.col("status") == "completed") & (F.coalesce("_before", F.lit("")) != "completed")).drop("_before")


def latest_state(log: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """State of each key by its last entry in an append-only log."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("n_changes"))


def label_suffix(label: Column) -> Column:
    """The number that ends a label, 0 if none does."""
    return F.coalesce(F.nullif(F.regexp_extract(label, r"(\d+)\s*$", 1), F.lit("")).cast("long"), F.lit(0))
