"""What the jobs share: a JSON config under command-line options, and a log on standard error."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path


def options(description: str, config: Path, argv: list[str] | None, required: tuple[str, ...]) -> dict:
    """The config file's values, those given on the command line in their place. --config takes another file of this machine."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", default=str(config), help="JSON file of options")
    known = json.loads(config.read_text())
    for name in (*required, *known):
        parser.add_argument(f"--{name}", type=type(known.get(name, "")), default=None)
    given = vars(parser.parse_args(argv))
    out = known | json.loads(Path(given.pop("config")).read_text()) | {k: v for k, v in given.items() if v is not None}
    if missing := [k for k in required if not out.get(k)]:
        parser.error(f"missing: {', '.join(missing)}")
    return out


def log(name: str) -> logging.Logger:
    logger = logging.getLogger(name)
    if not logger.handlers and not logging.getLogger().handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(message)s"))
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
    return logger
