"""Physical-plan census of every registered query (written to PLANS.md).

Counts, per query, the parquet scans, shuffle exchanges, broadcast exchanges,
sort-merge joins, sort aggregates, window operators and scalar subqueries of the
formatted plan (initial AQE plan, before run-time re-planning) on tables written
by ``Tables.materialize``.

Usage: python tools/plan_census.py [sf_dir] [out.md]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from presswork.plans.catalog import QueryParams, all_entries  # noqa: E402
from presswork.session import build_session  # noqa: E402
from presswork.sources.fixtures import derive_tables  # noqa: E402

NODES = {
    "scans": "Scan parquet",
    "reused_exchanges": "ReusedExchange",
    "cached_reads": "InMemoryTableScan",
    "shuffles": "Exchange",
    "broadcasts": "BroadcastExchange",
    "smj": "SortMergeJoin",
    "sort_agg": "SortAggregate",
    "window": "Window",
}
NODE_LINE = re.compile(r"^[\s:|+\-*]*([A-Za-z][A-Za-z ]*?) \((\d+)\)")


def _final_part(lines):
    """Of an adaptive plan tree keep the final plan (drop the initial plan that follows it)."""
    start = next((i for i, l in enumerate(lines) if "== Final Plan ==" in l), None)
    if start is None:
        return lines
    col = lines[start].index("== Final Plan ==")
    # the matching marker sits at the same indentation (nested plans of cached data have their own)
    end = next((i for i in range(start + 1, len(lines))
                if lines[i].find("== Initial Plan ==") == col), len(lines))
    return lines[start + 1:end]


def _tree_counts(lines, counts, seen):
    """Count plan nodes of one tree once per node id, leaving out the plan inside a cached
    relation (it runs once per author scope and is counted as a cached read). The nested
    plan of ``InMemoryRelation (r)`` holds the ids ``r+1 .. root`` of its first child."""
    nodes = [(m.group(1).strip(), int(m.group(2))) for m in map(NODE_LINE.match, _final_part(lines)) if m]
    hidden = [(nid, nodes[k + 1][1]) for k, (name, nid) in enumerate(nodes)
              if name == "InMemoryRelation" and k + 1 < len(nodes)]
    for name, nid in nodes:
        if nid in seen or name == "InMemoryRelation" or any(lo < nid <= hi for lo, hi in hidden):
            continue
        seen.add(nid)
        for key, node in NODES.items():
            if name == node or name.startswith(node + " "):
                counts[key] += 1


def census(df) -> dict:
    df.collect()  # run it: the formatted plan is then AQE's final plan, with subqueries reused
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue().splitlines()
    counts = {k: 0 for k in NODES}
    counts["subqueries"] = 0
    # main tree: from the first line to the first blank line
    i = next(n for n, l in enumerate(text) if l.startswith("AdaptiveSparkPlan") or NODE_LINE.match(l))
    j = next((n for n in range(i, len(text)) if not text[n].strip()), len(text))
    seen_nodes = set()
    _tree_counts(text[i:j], counts, seen_nodes)
    seen = set()
    n = 0
    while n < len(text):
        line = text[n]
        if line.startswith("Subquery:") and "ReusedSubquery" not in line:
            m = re.search(r"subquery#(\d+)", line)
            sid = m.group(1) if m else line
            end = next((k for k in range(n + 1, len(text)) if not text[k].strip()), len(text))
            if sid not in seen:
                seen.add(sid)
                counts["subqueries"] += 1
                _tree_counts(text[n + 1:end], counts, seen_nodes)
            n = end
        n += 1
    return counts


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(__file__)), "PLANS.md")
    spark = build_session("local[8]")
    tables = derive_tables(spark, sf_dir).materialize()
    rows = [(key, census(e.build(tables, QueryParams()))) for key, e in sorted(all_entries().items())]
    cols = list(NODES) + ["subqueries"]
    lines = [
        "# Plan census",
        "",
        "Generated by `tools/plan_census.py`: node counts of each registered query's final physical plan, after",
        "running it on materialized sf0.01 tables (AQE's run-time choices included, e.g. a sort-merge join turned",
        "into a broadcast). Reused exchanges and reused scalar subqueries are not counted again. `cached_reads` read",
        "the shared, persisted author scope; the work inside it runs once per author and period and is not counted.",
        "",
        "| query | " + " | ".join(cols) + " |",
        "| --- | " + " | ".join("---:" for _ in cols) + " |",
    ]
    for key, c in rows:
        lines.append(f"| `{key}` | " + " | ".join(str(c[k]) for k in cols) + " |")
    totals = {k: sum(c[k] for _, c in rows) for k in cols}
    lines.append("| **total** | " + " | ".join(str(totals[k]) for k in cols) + " |")
    with open(out, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    print(f"wrote {out}: {len(rows)} queries; totals {totals}")


if __name__ == "__main__":
    main()
