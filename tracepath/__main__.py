"""python -m tracepath RECORDINGS [--for finish|response] [--origin URL] [--producer NAME] [--budget N] [--maps FOLDER]

Exit 2 for a wrong call or a path that can't be read; a refusal is an answer, with exit 0.
"""

from __future__ import annotations

import argparse
import sys

from tracepath.plans.analyse import analyse
from tracepath.plans.report import report
from tracepath.plans.session import build_session
from tracepath.sources.vocabulary import BY_NAME


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("tracepath")
    p.add_argument("path", help="recordings in the Trace Event Format, one a file")
    p.add_argument("--for", dest="question", choices=("finish", "response"), default="finish")
    p.add_argument("--origin")
    p.add_argument("--producer", choices=sorted(BY_NAME), default="chrome")
    p.add_argument("--budget", type=int, default=5)
    p.add_argument("--maps", help="a folder of source maps; findings are then placed in source")
    p.add_argument("--most", type=int, default=20, help="recordings to print")
    a = p.parse_args(args)
    try:
        found = analyse(build_session(), a.path, a.producer, a.question, a.origin, a.maps)
        for r in found.summary.select("trace_id").union(found.refusals.select("trace_id")).distinct().orderBy("trace_id").limit(a.most).collect():
            print(report(found, r["trace_id"], a.budget))
    except Exception as e:  # a path that isn't there is only found by the engine
        print(f"tracepath: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
