"""Command line: ``python -m cartlift --train ... --clients ... --purchases ... --out ...``."""

from __future__ import annotations

import argparse
from dataclasses import fields

from cartlift.config import AnalysisConfig
from cartlift.plans.pipeline import run_from_paths
from cartlift.session import build_session


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cartlift", description=__doc__)
    for name in ("train", "clients", "purchases", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    p.add_argument("--master", default=None, help="unset: as spark-submit decides")
    p.add_argument("--sample-frac", type=float, default=None)
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="any field of AnalysisConfig")
    p.add_argument("--run-date", default=None, help="publish the outputs as one dated run")
    a = p.parse_args(argv)
    known = {f.name: f for f in fields(AnalysisConfig)}
    given = {}
    for pair in a.set:
        name, _, value = pair.partition("=")
        now = getattr(AnalysisConfig(), name) if name in known else p.error(f"unknown parameter {name}")
        given[name] = value == "true" if isinstance(now, bool) else type(now)(value) if now is not None else value
    cfg = AnalysisConfig(sample_frac=a.sample_frac).with_(**given)
    paths = {"train": a.train, "clients": a.clients, "purchases": a.purchases}
    for name in run_from_paths(build_session(a.master), paths, a.out, cfg, a.format, a.run_date):
        print(f"{a.out.rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
