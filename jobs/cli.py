"""What the jobs' command lines share: a JSON file of settings, single settings over it, logging and a session."""

from __future__ import annotations

import argparse
import inspect
import json
import logging
from collections.abc import Callable


def settings(job: Callable, argv: list[str] | None = None) -> tuple[str | None, dict]:
    """The master, if one is given, and the job's arguments from a config file and from key=value words (values are JSON, or else text)."""
    known = [p for p in inspect.signature(job).parameters if p != "spark"]
    a = argparse.ArgumentParser(description=inspect.getdoc(job), formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("config", help="a JSON file of settings: " + ", ".join(known))
    a.add_argument("set", nargs="*", metavar="key=value", help="settings that go before those of the file")
    a.add_argument("--master", help="where to run, if spark-submit does not say so")
    got = a.parse_args(argv)
    with open(got.config, encoding="utf-8") as f:
        values = json.load(f)
    for word in got.set:
        key, _, value = word.partition("=")
        try:
            values[key] = json.loads(value)
        except json.JSONDecodeError:
            values[key] = value
    if lost := sorted(set(values) - set(known)):
        a.error(f"unknown settings {', '.join(lost)}; there are {', '.join(known)}")
    return got.master, values


def main(job: Callable, argv: list[str] | None = None) -> None:
    """Runs a job in a session of its own and prints what it returns, as JSON lines of 20 rows at most."""
    from lamina.session import session

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    master, values = settings(job, argv)
    spark = session(job.__module__, master)
    try:
        for line in job(spark, **values).limit(20).toJSON().collect():
            print(line)
    finally:
        spark.stop()
