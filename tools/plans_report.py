"""Write the physical plan (operator tree, scan columns and pushed filters) of chosen queries.

usage: python tools/plans_report.py <sf_dir> <out.md> [query ...]
Plans are the static physical plans (adaptive execution switched off while
explaining, so whole-stage code generation stages are visible); at run time
adaptive execution re-optimises the same stages (join strategy, partition
coalescing, skew splits).
"""

from __future__ import annotations

import io
import sys
from contextlib import redirect_stdout
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DEFAULT = ["metric_table", "build_prompt", "over_budget", "batch_score", "stub_on_failure",
           "training_prompts", "sft_records", "last_response", "verify_manifest"]
KEEP = ("ReadSchema", "PushedFilters", "Arguments: ", "Join type", "Keys", "BuildRight", "BuildLeft")


def main():
    from scopekit.plans.catalog import QUERIES
    from scopekit.session import build_session
    sf, out = sys.argv[1], sys.argv[2]
    names = sys.argv[3:] or DEFAULT
    spark = build_session("local[8]", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    parts = ["# Physical plans\n",
             f"Static physical plans on `{sf}` (local[8]) with adaptive execution off while explaining, so "
             "code generation stages (`*`, `[codegen id]`) are visible; printed by `tools/plans_report.py`. "
             "At run time adaptive execution re-optimises these stages. Sizes here are small, so several "
             "joins are planned as broadcasts from the optimizer's size estimate; at scale the same code "
             "plans sort-merge joins.\n"]
    for name in names:
        df = QUERIES[name](spark, sf)
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree, details = text.split("\n\n", 1) if "\n\n" in text else (text, "")
        lines = [ln for ln in details.splitlines() if ln.startswith("(") or ln.startswith(KEEP)]
        parts.append(f"## {name}\n\n```\n{tree.strip()}\n\n" + "\n".join(lines) + "\n```\n")
    Path(out).write_text("\n".join(parts))


if __name__ == "__main__":
    main()
