"""Command line: generate two relations, choose a strategy, join and report.

python -m keelson.plans.cli --r=12800000 --s=12800000 --skew=0
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import joins, layout
from ..sources import generators as gen
from ..sources.tables import report
from .chooser import DEFAULT_BUDGET, STRATEGIES, Decision


def parse(args: Sequence[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0], allow_abbrev=False)
    p.add_argument("--r", type=int, default=12_800_000, help="rows of the primary-key relation")
    p.add_argument("--s", type=int, default=12_800_000, help="rows of the foreign-key relation")
    p.add_argument("--skew", type=float, default=0.0, help="Zipf exponent of the foreign keys")
    p.add_argument("--threads", type=int, default=0, help="local threads; 0 for all")
    p.add_argument("--budget", type=int, default=DEFAULT_BUDGET, help="bytes of the primary side that a worker may hold")
    p.add_argument("--strategy", default="auto", choices=("auto", *STRATEGIES))
    p.add_argument("--radix", type=int, help="bits of the partitioning, left as they are whatever the sizes and the skew")
    p.add_argument("--verify", action="store_true", help="sum matched keys instead of payloads")
    p.add_argument("--check-keys", action="store_true", help="refuse a primary-key relation that has a key twice")
    p.add_argument("--phases", action="store_true", help="time the join's phases, each in a run of its own")
    p.add_argument("--explain", action="store_true", help="print the plan")
    return p.parse_args(args)


def _seconds(run: Callable) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def phases(r: DataFrame, s: DataFrame, decision: Decision) -> dict[str, float]:
    """Seconds of the phases that a strategy has.

    Where both sides are dealt by key: Partitioning, and the rest as Build/Probe. Where R goes to
    every executor: Building, by which its rows are brought together, and the rest as Probing.
    """
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    whole = _seconds(lambda: joins.join(r, s, decision).write.format("noop").mode("overwrite").save())
    if decision.strategy == "broadcast":
        first, names = _seconds(lambda: drain(r.coalesce(1))), ("Building", "Probing")
    else:
        bits = decision.radix or joins.SKEW_RADIX
        first, names = _seconds(lambda: [drain(layout.partition_by_key(side, "key", bits)) for side in (s, r)]), ("Partitioning", "Build/Probe")
    return dict(zip(names, (first, max(0.0, whole - first))))


def main(args: Sequence[str], spark: SparkSession | None = None) -> dict:
    a = parse(args)
    spark = spark or SparkSession.builder.master(f"local[{a.threads or '*'}]").getOrCreate()
    r = gen.primary_keys(spark, a.r)
    s = gen.foreign_keys(spark, gen.RelationConfig(a.s, 54_321, a.skew, "S"), a.r).select("key")
    r = joins.checked(r) if a.check_keys else r
    decision = joins.decide(r, s, a.r, a.s, a.budget, a.strategy, a.radix)
    print(f"R={a.r} S={a.s} z={a.skew} {decision.describe()}")
    result = joins.summary(r, joins.join(r, s, decision), a.verify)
    if a.explain:
        result.explain("formatted")
    began = time.perf_counter()
    out = report(result)
    print(f"checksum={out['checksum']} matches={out['matches']} seconds={time.perf_counter() - began:.3f}")
    if a.phases:
        print(" ".join(f"{name}={seconds:.3f}" for name, seconds in phases(r, s, decision).items()))
    return out


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
