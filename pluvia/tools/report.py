"""A Markdown report of the bench's JSON line, with the machine it ran on: ``python bench.py | python -m pluvia.tools.report``."""

from __future__ import annotations

import json
import os
import platform
import re
import sys

import numpy
import pyarrow
import pyspark


def machine() -> dict[str, str]:
    """What the figures were taken on."""
    text = {}
    for name in ("cpuinfo", "meminfo"):
        try:
            with open(f"/proc/{name}") as f:
                text[name] = f.read()
        except OSError:
            text[name] = ""
    cpu = re.search(r"model name\s*:\s*(.+)", text["cpuinfo"])
    memory = re.search(r"MemTotal:\s*(\d+)", text["meminfo"])
    return {
        "system": platform.platform(),
        "processor": cpu[1].strip() if cpu else platform.processor() or "unknown",
        "cores": str(os.cpu_count()),
        "memory": f"{int(memory[1]) / 2**20:.1f} GiB" if memory else "unknown",
        "python": platform.python_version(),
        "pyspark": pyspark.__version__,
        "pyarrow": pyarrow.__version__,
        "numpy": numpy.__version__,
    }


def markdown(result: dict, host: dict[str, str]) -> str:
    lines = ["# Bench", "", f"{result['metric']}: {result['value']} {result['unit']} on {result['sf']}", "", "| query | seconds |", "|---|---|"]
    lines += [f"| {k} | {v} |" for k, v in result["queries"].items()]
    lines += ["", "| machine | |", "|---|---|", *[f"| {k} | {v} |" for k, v in host.items()]]
    return "\n".join(lines) + "\n"


def main() -> int:
    found = [x for x in sys.stdin if x.startswith("{")]
    if not found:
        print("no JSON line on standard input", file=sys.stderr)
        return 1
    print(markdown(json.loads(found[-1]), machine()), end="")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
