"""Rankings from the shell: ``python -m encore FOLDER --view song --q "small ring" --page 1``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from encore.operators.rankings import VIEWS, search_rankings
from encore.session import session


def main(args: Sequence[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="encore", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("--view", choices=VIEWS, default="song")
    parser.add_argument("--q", default="")
    parser.add_argument("--scope", default="all")
    parser.add_argument("--range", dest="range_", choices=("all", "7d"), default="all")
    parser.add_argument("--metric", choices=("n", "videos"), default="n")
    parser.add_argument("--min-count", type=int, default=1)
    parser.add_argument("--niche-only", action="store_true")
    parser.add_argument("--hide-unknown", action="store_true")
    parser.add_argument("--page", type=int, default=1)
    parser.add_argument("--page-size", type=int, default=50)
    asked = vars(parser.parse_args(args))
    from encore.plans.common import searchable

    spark = session("encore probe")
    payload = search_rankings(searchable(spark, asked.pop("folder")), **asked).payload()
    print(json.dumps(payload, default=str))
    return payload


if __name__ == "__main__":
    main()
