"""Adapter: ``contracts`` and ``clients`` derived from the TPC-H-style test tables.

The pipeline reads two inputs (see ``attrition.sources.tables``).  The test
data has neither, so they are derived, with plain joins and column
expressions, from ``lineitem``, ``orders`` and ``customer``:

* clients   = customer, with a NULL name every 7th key and a cancellation date
              for clients with a negative balance;
* contracts = lineitem ⋈ orders (inner, order key) ⟕ clients (customer key),
              one contract line per line item, with a product picked from
              ``PRODUCTS`` so that every rule branch is populated.

``derive`` is lazy and keeps no copy: every query reads the given tables.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.sources.tables import CLIENTS_SCHEMA, CONTRACTS_SCHEMA, conform

# The product catalogue of the test adapter, by index
# ``(o_custkey * 4 + l_partkey % 4) % 20``.  One entry per rule branch;
# index 16 uses a precomposed "Í".
PRODUCTS: list[str] = [
    "[PRO] Plano",
    "[LITE] Plano",
    "[STARTER] Plano",
    "[FILHA] Plano",
    "[BASIC] Plano",
    "Pacote 0 - 9 Igrejas",
    "Pacote 10+ Igrejas",
    "App Lite mensal",
    "App da Igreja",
    "Squad as a Service",
    "Consultoria avulsa",
    "[KIDS] Check-in",
    "[JORNADA] Trilha",
    "[LOJAINTELIGENTE] Loja",
    "[LOJAINTELIGENTE-INC] Loja",
    "[TOTEM] Quiosque",
    "[VÍDEOS] Acervo",
    "[STARTER] Módulo extra",
    "Setup inicial",
    "[PRO-RATA] Ajuste",
]

CANCEL_EPOCH = "2000-01-01"


def derive_clients(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        key.cast("string").alias("client_id"),
        F.when(key % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("client_name"),
        F.when(
            F.col("c_acctbal") < 0,
            F.date_add(F.lit(CANCEL_EPOCH).cast("date"), (key % 700).cast("int")),
        ).alias("cancel_date"),
    )


def product_dimension(spark: SparkSession) -> DataFrame:
    """``product_id, product``: the catalogue as a local table of ``len(PRODUCTS)`` rows."""
    ids = pa.array(range(len(PRODUCTS)), pa.int64())
    return spark.createDataFrame(pa.table({"product_id": ids, "product": pa.array(PRODUCTS)}))


def derive_contracts(lineitem: DataFrame, orders: DataFrame, clients: DataFrame) -> DataFrame:
    """One contract line per line item.

    The product is joined from the catalogue and each date is cast on its own
    side of the join, so that what reads the contracts finds plain columns: an
    expression here would be copied into every rule and bound above it.
    """
    li = lineitem.select(
        "l_orderkey", (F.col("l_partkey") % 4).alias("part"), "l_extendedprice", "l_returnflag", "l_linestatus",
        F.col("l_shipdate").cast("date").alias("ship_day"),
    )
    od = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("order_day"))
    later = F.greatest("order_day", "ship_day")
    lines = li.join(od, li.l_orderkey == od.o_orderkey, "inner").select(
        F.col("o_custkey").cast("string").alias("client_id"),
        ((F.col("o_custkey") * 4 + F.col("part")) % len(PRODUCTS)).alias("product_id"),
        F.least("order_day", "ship_day").alias("start_date"),
        F.when(F.col("l_linestatus") == "O", F.lit(None).cast("date"))
        .when(F.col("l_returnflag").isin("R", "A"), F.last_day(later))
        .otherwise(later)
        .alias("end_date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    # The catalogue has a fixed number of rows, so it is broadcast on that bound.
    named = lines.join(F.broadcast(product_dimension(lineitem.sparkSession)), "product_id", "left")
    cancel = clients.select("client_id", "cancel_date")
    return conform(named.join(cancel, "client_id", "left"), CONTRACTS_SCHEMA)


def derive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lazy derivation straight from the test tables (no write)."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    clients = conform(derive_clients(read("customer")), CLIENTS_SCHEMA)
    contracts = derive_contracts(read("lineitem"), read("orders"), clients)
    return contracts, clients
