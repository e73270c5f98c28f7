"""Hand-row builders for the trap tests."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from attrition.sources.tables import CLIENTS_SCHEMA, CONTRACTS_SCHEMA

D = date


def contract(
    client_id="c1",
    product="[PRO] Plano",
    start_date=D(2000, 1, 1),
    end_date=None,
    cancel_date=None,
    amount="100.00",
):
    return (
        client_id,
        product,
        start_date,
        end_date,
        cancel_date,
        None if amount is None else Decimal(amount),
    )


def client(client_id="c1", client_name="Client One", cancel_date=None):
    return (client_id, client_name, cancel_date)


def frames(spark, contracts, clients=None):
    clients = clients if clients is not None else [client()]
    return (
        spark.createDataFrame(contracts, CONTRACTS_SCHEMA),
        spark.createDataFrame(clients, CLIENTS_SCHEMA),
    )


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
