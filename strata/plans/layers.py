"""Layer, ingest, export and passthrough-materialisation queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.plans.medallion import (
    build_analytics_views,
    create_aggregation,
    dedup_with_audit,
    fresh_lake,
    layer_trace,
    medallion_flow,
)
from strata.plans.registry import TABLES, load, query
from strata.plans.sqlrun import transform
from strata.plans.tables import TABLE_COLUMNS, union_sql
from strata.session import scratch_path
from strata.sources import datagen as gen
from strata.sources import files as src

# ---------------------------------------------------------------- flagship


def _medallion_oracle() -> str:
    parts = []
    for t, cols in TABLE_COLUMNS.items():
        nulls = " + ".join(f"CAST(count(*) FILTER (WHERE {c} IS NULL) > 0 AS BIGINT)" for c in cols)
        parts.append(
            f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS bronze_rows, "
            f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS silver_rows, "
            f"'{t}_analytics' AS gold_view, "
            f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS gold_rows, "
            f"CAST({len(cols)} AS BIGINT) AS checks, "
            f"(SELECT {nulls} FROM (SELECT DISTINCT * FROM {t})) AS checks_failed"
        )
    return union_sql(parts)


@query("medallion_flow", oracle=_medallion_oracle())
def q_medallion_flow(spark: SparkSession, data_dir: str) -> DataFrame:
    """Bronze -> silver -> gold over every table file of the data folder."""
    return medallion_flow(spark, data_dir)


# ---------------------------------------------------------------- ingest


def _landing(spark: SparkSession, df: DataFrame, name: str, fmt: str) -> str:
    path = f"{scratch_path(spark, 'landing')}/{name}.{fmt}"
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


@query(
    "bronze_ingest_csv",
    oracle="SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def q_bronze_ingest_csv(spark: SparkSession, data_dir: str) -> DataFrame:
    lake = fresh_lake(spark, "b")
    path = _landing(spark, load(spark, data_dir, "customer"), "customer", "csv")
    src.ingest_csv(lake, "customer", path)
    return lake.table("bronze", "customer")


@query(
    "bronze_ingest_json",
    oracle="SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
)
def q_bronze_ingest_json(spark: SparkSession, data_dir: str) -> DataFrame:
    lake = fresh_lake(spark, "b")
    path = _landing(spark, load(spark, data_dir, "nation"), "nation", "json")
    src.ingest_json(lake, "nation", path)
    return lake.table("bronze", "nation")


# Landing formats for the directory ingest (every table, mixed formats).
_LANDING_FORMATS = {
    "region": "csv", "nation": "csv", "supplier": "csv", "customer": "csv", "part": "csv",
    "orders": "csv", "lineitem": "csv", "events": "json", "labels": "json", "benchmark": "json",
    "conversations": "json", "documents": "parquet", "embeddings": "parquet", "pages": "parquet",
}


_LANDINGS: dict[tuple[str, str], str] = {}


def _landing_folder(spark: SparkSession, data_dir: str) -> str:
    """Source files of every table in mixed formats, written once per application and data folder."""
    key = (spark.sparkContext.applicationId, data_dir)
    if key not in _LANDINGS or not src.path_exists(spark, _LANDINGS[key]):
        _LANDINGS[key] = _write_landing_folder(spark, data_dir)
    return _LANDINGS[key]


def _write_landing_folder(spark: SparkSession, data_dir: str) -> str:
    root = scratch_path(spark, "landing")
    for t, fmt in _LANDING_FORMATS.items():
        df = load(spark, data_dir, t)
        path = f"{root}/{t}.{fmt}"
        if fmt == "csv":
            df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        elif fmt == "json":
            df.write.mode("overwrite").json(path)
        else:
            df.write.mode("overwrite").parquet(path)
    return root


@query(
    "bronze_row_counts",
    oracle=union_sql(
        [f"SELECT '{t}' AS table_name, count(*) AS rows, {len(c)} AS n_columns FROM {t}" for t, c in TABLE_COLUMNS.items()]
    ),
)
def q_bronze_row_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Directory ingest dispatched by suffix, then rows and columns per bronze table."""
    lake = fresh_lake(spark, "b")
    counts = src.ingest_all(lake, _landing_folder(spark, data_dir))
    rows = [(t, int(n), len(lake.table("bronze", t).columns)) for t, n in sorted(counts.items())]
    return spark.createDataFrame(rows, "table_name string, rows bigint, n_columns int")


@query(
    "ingest_strict",
    oracle="SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, "
    "o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
)
def q_ingest_strict(spark: SparkSession, data_dir: str) -> DataFrame:
    lake = fresh_lake(spark, "s")
    path = _landing(spark, load(spark, data_dir, "orders"), "orders", "csv")
    src.ingest_strict(lake, "orders", path)
    return lake.table("bronze", "orders")


@query(
    "layer_tables",
    oracle="SELECT DISTINCT table_name FROM information_schema.tables WHERE table_name IN ("
    + ", ".join(f"'{t}'" for t in TABLE_COLUMNS) + ")",
)
def q_layer_tables(spark: SparkSession, data_dir: str) -> DataFrame:
    """Base tables of the bronze layer after ingesting every file of the data folder."""
    lake = fresh_lake(spark, "b")
    src.ingest_all(lake, data_dir)
    return spark.createDataFrame([(t,) for t in lake.tables("bronze")], "table_name string")


# ---------------------------------------------------------------- export / CTAS


@query("export_roundtrip", oracle="SELECT 'parquet' AS format, * FROM orders UNION ALL SELECT 'csv', * FROM orders")
def q_export_roundtrip(spark: SparkSession, data_dir: str) -> DataFrame:
    """Orders exported as Parquet and as CSV, both read back."""
    orders = load(spark, data_dir, "orders")
    root = scratch_path(spark, "export")
    parquet = spark.read.parquet(src.export_table(orders, f"{root}/orders.parquet", "parquet"))
    csv = src.read_csv(spark, src.export_table(orders, f"{root}/orders.csv", "csv"), schema=orders.schema)
    return parquet.select(F.lit("parquet").alias("format"), "*").unionByName(csv.select(F.lit("csv").alias("format"), "*"))


_CTAS_SQL = (
    "SELECT o_orderstatus, count(*) AS n_orders, "
    "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_price "
    "FROM orders GROUP BY o_orderstatus"
)


@query("transform_ctas", oracle=_CTAS_SQL)
def q_transform_ctas(spark: SparkSession, data_dir: str) -> DataFrame:
    """Materialise a SQL result as a table (create or replace)."""
    lake = fresh_lake(spark, "t")
    load(spark, data_dir, "orders").createOrReplaceTempView("orders")
    transform(lake, _CTAS_SQL, "order_status_totals")
    return lake.table("gold", "order_status_totals")


# ---------------------------------------------------------------- silver / gold


@query(
    "silver_dedup",
    oracle="SELECT DISTINCT l_orderkey, l_linenumber, TIMESTAMP '2024-01-01 00:00:00' AS _ingested_at, "
    "'lineitem' AS _source FROM lineitem",
)
def q_silver_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    """Key projection of lineitem (it holds real duplicate keys), de-duplicated and stamped."""
    keys = load(spark, data_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return dedup_with_audit(keys, "lineitem")


@query(
    "layer_trace",
    oracle="SELECT 'bronze' AS layer, count(*) AS rows, 6 AS n_columns FROM orders "
    "UNION ALL SELECT 'silver', count(*), 8 FROM (SELECT DISTINCT * FROM orders) "
    "UNION ALL SELECT 'gold', count(*), 8 FROM (SELECT DISTINCT * FROM orders)",
)
def q_layer_trace(spark: SparkSession, data_dir: str) -> DataFrame:
    lake = fresh_lake(spark, "l")
    src.ingest(lake, "orders", f"{data_dir.rstrip('/')}/orders.parquet", "parquet")
    lake.write(dedup_with_audit(lake.table("bronze", "orders"), "orders"), "silver", "orders")
    build_analytics_views(lake)
    return layer_trace(lake, "orders")


@query(
    "dataset_summary",
    oracle=union_sql(
        [
            f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS rows, "
            f"'{','.join(TABLE_COLUMNS[t])}' AS columns"
            for t in TABLES
        ]
    ),
)
def q_dataset_summary(spark: SparkSession, data_dir: str) -> DataFrame:
    """Report inputs: row count and column list of every table."""
    parts = []
    for t in TABLES:
        df = load(spark, data_dir, t)
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(t).alias("table_name"), "rows", F.lit(",".join(df.columns)).alias("columns")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_GOLD_SQL = (
    "SELECT c_mktsegment, count(*) AS customers, "
    "CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS balance "
    "FROM {customer} GROUP BY c_mktsegment"
)


@query("gold_view", oracle=_GOLD_SQL.format(customer="customer"))
def q_gold_view(spark: SparkSession, data_dir: str) -> DataFrame:
    lake = fresh_lake(spark, "g")
    src.ingest(lake, "customer", f"{data_dir.rstrip('/')}/customer.parquet", "parquet")
    return create_aggregation(lake, _GOLD_SQL.format(customer=lake.name("bronze", "customer")), "segment_balance")


@query(
    "gold_auto_views",
    oracle=union_sql(
        [f"SELECT '{t}_analytics' AS view_name, count(*) AS rows FROM (SELECT DISTINCT * FROM {t})" for t in TABLES]
    ),
)
def q_gold_auto_views(spark: SparkSession, data_dir: str) -> DataFrame:
    """One analytics view per silver table, with its row count."""
    lake = fresh_lake(spark, "g")
    lake.prepare()

    def to_silver(t: str) -> None:
        src.ingest(lake, t, f"{data_dir.rstrip('/')}/{t}.parquet", "parquet")
        lake.write(dedup_with_audit(lake.table("bronze", t), t), "silver", t)

    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(to_silver, TABLES))
    parts = [
        v.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("view_name"), "rows")
        for name, v in build_analytics_views(lake)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- generators


def _n(key: str, salt: str) -> str:
    return f"('0x' || substr(md5({key}::VARCHAR || ':42:{salt}'), 1, 13))::BIGINT"


def _pick(options: str, key: str, salt: str) -> str:
    words = ", ".join(f"'{w}'" for w in options.split())
    return f"list_extract([{words}], ({_n(key, salt)} % {len(options.split())} + 1)::INT)"


def _day(key: str, salt: str, days: int) -> str:
    return f"(DATE '2023-01-01' + ({_n(key, salt)} % {days})::INT)"


def _share(key: str, salt: str) -> str:
    return f"({_n(key, salt)}::DOUBLE / 4503599627370496)"


_FIRST, _LAST = "Ada Bruno Carla Davi Elena Felix Gita Hugo Ines Jonas Kaya Leon", "Almeida Berger Costa Duarte Evans Fischer Garcia Hansen Ito Jansen"
_GEN_CUSTOMERS_SQL = (
    f"SELECT c_custkey AS id, {_pick(_FIRST, 'c_custkey', 'first')} || ' ' || {_pick(_LAST, 'c_custkey', 'last')} AS name, "
    f"lower({_pick(_FIRST, 'c_custkey', 'first')} || '.' || {_pick(_LAST, 'c_custkey', 'last')}) || c_custkey || '@' || "
    f"{_pick('example.com example.org example.net', 'c_custkey', 'domain')} AS email, "
    f"{_pick('Curitiba Recife Manaus Santos Niteroi Olinda Londrina', 'c_custkey', 'city')} AS city, "
    f"{_pick('PR PE AM SP RJ PE PR', 'c_custkey', 'city')} AS state, "
    f"{_pick('consumer business enterprise vip', 'c_custkey', 'segment')} AS segment, {_day('c_custkey', 'created', 730)} AS created_at FROM customer"
)
_GEN_PRODUCTS_SQL = (
    f"SELECT p_partkey AS id, {_pick('Compact Durable Elegant Folding Quiet Robust Smart', 'p_partkey', 'adjective')} || ' ' || "
    f"{_pick('Lamp Backpack Kettle Notebook Speaker Jacket Racket Blender', 'p_partkey', 'noun')} AS name, "
    f"{_pick('electronics clothing food books home sports', 'p_partkey', 'category')} AS category, "
    f"(500 + {_n('p_partkey', 'price')} % 49501)::DOUBLE / 100 AS price, "
    f"{_pick('Norte Palma Quasar Ribeira Solano Tucano', 'p_partkey', 'brand')} AS brand, ({_n('p_partkey', 'stock')} % 501)::INT AS stock FROM part"
)
_ORDERED = _share("o_orderkey", "status")
_GEN_ORDERS_SQL = (
    f"WITH c AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM ({_GEN_CUSTOMERS_SQL})), "
    f"p AS (SELECT id, price, row_number() OVER (ORDER BY id) AS i FROM ({_GEN_PRODUCTS_SQL})), "
    f"o AS (SELECT o_orderkey AS id, {_n('o_orderkey', 'customer')} % (SELECT count(*) FROM c) + 1 AS ci, "
    f"{_n('o_orderkey', 'product')} % (SELECT count(*) FROM p) + 1 AS pi, ({_n('o_orderkey', 'qty')} % 5 + 1)::INT AS qty, "
    f"CASE WHEN {_ORDERED} < 0.7::DOUBLE THEN 'completed' WHEN {_ORDERED} < 0.85::DOUBLE THEN 'pending' "
    f"WHEN {_ORDERED} < 0.95::DOUBLE THEN 'cancelled' ELSE 'refunded' END AS status, "
    f"{_pick('web mobile pos api', 'o_orderkey', 'channel')} AS channel, {_day('o_orderkey', 'ordered', 365)} AS created_at FROM orders) "
    "SELECT o.id, c.id AS customer_id, p.id AS product_id, qty, round(price * qty, 2) AS total, status, channel, created_at "
    "FROM o JOIN c ON o.ci = c.i JOIN p ON o.pi = p.i"
)
_METHOD, _PAID = _share("event_id", "method"), _share("event_id", "pay_status")
_GEN_TRANSACTIONS_SQL = (
    f"WITH g AS ({_GEN_ORDERS_SQL}), r AS (SELECT id, total, row_number() OVER (ORDER BY id) AS i FROM g) "
    f"SELECT event_id AS id, r.id AS order_id, r.total AS amount, "
    f"CASE WHEN {_METHOD} < 0.4::DOUBLE THEN 'credit_card' WHEN {_METHOD} < 0.6::DOUBLE THEN 'debit_card' WHEN {_METHOD} < 0.8::DOUBLE THEN 'pix' "
    f"WHEN {_METHOD} < 0.9::DOUBLE THEN 'boleto' ELSE 'wallet' END AS method, "
    f"CASE WHEN {_PAID} < 0.1::DOUBLE THEN 'authorized' WHEN {_PAID} < 0.4::DOUBLE THEN 'captured' WHEN {_PAID} < 0.8::DOUBLE THEN 'settled' "
    f"WHEN {_PAID} < 0.95::DOUBLE THEN 'declined' ELSE 'refunded' END AS status, {_day('event_id', 'paid', 365)} AS created_at "
    f"FROM events JOIN r ON {_n('event_id', 'order')} % (SELECT count(*) FROM r) + 1 = r.i"
)


@query("generate_customers", oracle=_GEN_CUSTOMERS_SQL)
def q_generate_customers(spark: SparkSession, data_dir: str) -> DataFrame:
    """One synthetic customer per customer key."""
    return gen.generate_customers(load(spark, data_dir, "customer"), "c_custkey")


@query("generate_products", oracle=_GEN_PRODUCTS_SQL)
def q_generate_products(spark: SparkSession, data_dir: str) -> DataFrame:
    """One synthetic product per part key."""
    return gen.generate_products(load(spark, data_dir, "part"), "p_partkey")


@query("generate_orders", oracle=_GEN_ORDERS_SQL)
def q_generate_orders(spark: SparkSession, data_dir: str) -> DataFrame:
    """One synthetic e-commerce order per order key: generated customers and products, weighted status and channel."""
    return gen.generate_orders(load(spark, data_dir, "orders"), "o_orderkey", q_generate_customers(spark, data_dir), q_generate_products(spark, data_dir))


@query("generate_transactions", oracle=_GEN_TRANSACTIONS_SQL)
def q_generate_transactions(spark: SparkSession, data_dir: str) -> DataFrame:
    """One synthetic payment per event, each for one of the generated orders."""
    return gen.generate_transactions(q_generate_orders(spark, data_dir), keys=load(spark, data_dir, "events"), key="event_id")
