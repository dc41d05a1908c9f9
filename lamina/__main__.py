"""python -m lamina: doctor, skills, show, run, chain, queries, data."""

from __future__ import annotations

import argparse
import json
import sys

from lamina import skills


def pairs(items: list[str]) -> dict[str, str]:
    """key=value arguments."""
    out = {}
    for x in items:
        k, eq, v = x.partition("=")
        if not eq:
            raise SystemExit(f"{x!r} is no key=value")
        out[k] = v
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lamina")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor", help="versions, and skills whose requirements are missing")
    sub.add_parser("skills", help="all skills")
    show = sub.add_parser("show", help="the parameters of a skill")
    show.add_argument("name")
    run = sub.add_parser("run", help="run a skill")
    run.add_argument("name")
    run.add_argument("parameters", nargs="*", metavar="key=value")
    run.add_argument("--out", default="runs")
    run.add_argument("--seed", type=int, default=42)
    run.add_argument("--origin", default="unknown", choices=skills.ORIGINS)
    chain = sub.add_parser("chain", help="run the skills of a JSON file [[name, {parameter: value}], ...]")
    chain.add_argument("file")
    chain.add_argument("--out", default="runs")
    query = sub.add_parser("query", help="run a registered query over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    data = sub.add_parser("data", help="status, lock or verify a manifest")
    data.add_argument("action", choices=("status", "lock", "verify"))
    data.add_argument("manifest")
    data.add_argument("--lock", default="data.lock.json")
    a = p.parse_args(argv)
    if a.command == "doctor":
        print(json.dumps({"versions": skills.versions(), "missing": {k: m for k, s in skills.discover().items() if (m := s.lacking())}}, indent=2))
    elif a.command == "skills":
        print(skills.markdown_table([{"name": k, "description": s.description} for k, s in skills.discover().items()], ["name", "description"]), end="")
    elif a.command == "show":
        print(json.dumps(skills.get(a.name).tool(), indent=2))
    elif a.command == "data":
        f = {"status": lambda: skills.dataset_status(a.manifest), "lock": lambda: skills.lock(a.manifest, a.lock), "verify": lambda: skills.verify(a.manifest, a.lock)}[a.action]
        print(json.dumps(f(), indent=2))
    else:
        from lamina.session import session

        spark = session()
        if a.command == "run":
            print(json.dumps(skills.plain(skills.run(spark, a.name, pairs(a.parameters), a.out, a.seed, a.origin)), indent=2))
        elif a.command == "chain":
            with open(a.file, encoding="utf-8") as f:
                done = skills.run_chain(spark, [(n, p) for n, p in json.load(f)], a.out)
            print(json.dumps(done, indent=2))
            return int(any(d["status"] != "ok" for d in done))
        else:
            from lamina import catalogue

            catalogue.queries()[a.name](spark, a.folder).show(20, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
