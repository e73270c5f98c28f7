"""Batch entry point: compute the loss report and write its datasets.

    zip -r attrition.zip attrition
    spark-submit --conf spark.checkpoint.dir=hdfs:///shared/ckpt \\
        --py-files attrition.zip attrition/__main__.py \\
        --contracts s3://…/contracts --clients s3://…/clients \\
        --as-of 2001-06-15 --out s3://…/loss-report

(locally: ``python -m attrition --master 'local[8]' …``).

``--format table`` reads catalog tables instead of paths.  ``--as-of``
defaults to today's date (UTC).  Run it on a schedule to refresh the report.
"""

from __future__ import annotations

import argparse
from datetime import date, datetime, timezone

from attrition.plans.page import LossPage
from attrition.session import build_session
from attrition.sources.tables import scan_clients, scan_contracts


def parse_args(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="attrition", description=__doc__.splitlines()[0])
    p.add_argument("--contracts", required=True)
    p.add_argument("--clients", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="parquet", help="reader format, or 'table' for catalog tables")
    p.add_argument("--as-of", type=date.fromisoformat, default=None)
    p.add_argument("--window-months", type=int, default=15)
    p.add_argument("--n-months", type=int, default=15, help="report period: 3, 6, 12, 15 or 0 (all)")
    p.add_argument("--frames", action="store_true", help="also write every report frame")
    p.add_argument("--master", default=None)
    return p.parse_args(argv)


def main(argv=None) -> dict[str, str]:
    args = parse_args(argv)
    spark = build_session(args.master)
    as_of = args.as_of or datetime.now(timezone.utc).date()
    contracts = scan_contracts(spark, args.contracts, args.format)
    clients = scan_clients(spark, args.clients, args.format)
    page = LossPage(
        contracts, clients, as_of, n_months=args.n_months, window_months=args.window_months
    )
    written = page.write(args.out)
    if args.frames:
        written.update(page.write_frames(f"{args.out.rstrip('/')}/frames"))
    return written


if __name__ == "__main__":
    for name, path in main().items():
        print(f"{name}\t{path}")
