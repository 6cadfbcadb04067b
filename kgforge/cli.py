"""init, run, plan, status and reset of a workspace."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from kgforge.operators.lifecycle import STEPS
from kgforge.session import session
from kgforge.workflow.engine import Engine, Workspace
from kgforge.workflow.extractors import Recorded
from kgforge.workflow.remote import until_done


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="kgforge", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("init", "status", "reset"):
        commands.add_parser(name).add_argument("workspace")
    commands.choices["reset"].add_argument("--from", dest="step", choices=STEPS, default=STEPS[0])
    commands.choices["reset"].add_argument("--yes", action="store_true")
    for name in ("run", "plan"):
        p = commands.add_parser(name)
        p.add_argument("workspace")
        p.add_argument("data")
        p.add_argument("--config")
        p.add_argument("--responses", help="recorded responses, as JSON lines")
        p.add_argument("--extractor", help="module:function of the session that gives an extractor")
        p.add_argument("--service", help="module:function of the session that gives a service for batches")
        p.add_argument("--reset", action="store_true")
        p.add_argument("--add-documents", action="store_true")
    commands.choices["run"].add_argument("--until-done", action="store_true", help="run again until no unit waits for another try")
    commands.choices["run"].add_argument("--wait", type=float, default=60.0, help="seconds between such runs")
    return out


def named(place: str):
    """What module:name stands for."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    work = Workspace(a.workspace)
    try:
        if a.command == "init":
            print("\n".join(work.init()) or "nothing to do")
        elif a.command == "status":
            print(json.dumps(work.status(session() if work.state()["runs"] else None), indent=2))
        elif a.command == "reset":
            if not a.yes:
                print("--yes is needed: this deletes what was extracted", file=sys.stderr)
                return 1
            print("\n".join(work.reset(a.step)))
        else:
            spark = session()
            extractor = Recorded(spark, a.responses) if a.responses else named(a.extractor)(spark) if a.extractor else (lambda requests: requests.selectExpr("job_id", "CAST(NULL AS STRING) AS content", "'config' AS error_class", *[f"0L AS {t}_tokens" for t in ("input", "cached", "cache_write", "output", "reasoning")]))
            if a.reset:
                work.reset()
            engine = Engine(spark, work, a.data, extractor, a.config, named(a.service)(spark) if a.service else None)
            if a.command == "plan":
                print(json.dumps(engine.plan(), indent=2))
                return 0
            print("\n".join(engine.run(a.add_documents)))
            if a.until_done and not engine.done():
                until_done(lambda: bool(engine.run()) and engine.done() or engine.done(), wait=a.wait)
    except KeyboardInterrupt:
        return 130
    except (ValueError, OSError) as e:
        print(f"kgforge: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
