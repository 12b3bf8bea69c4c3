"""Write docs/PLANS.md: the executed plan shape of every registered query of
``civitas.plans``.

Each query runs (its rows are counted where they are, nothing is collected);
then ``DataFrame.explain(mode="formatted")`` shows the final adaptive plan, in
which exchanges that Spark has reused appear once.  Per query: shuffles, broadcasts, join strategies,
aggregate strategies, windows, top-k nodes, Python UDF nodes, and for every
Parquet scan the number of columns read and the filters pushed into it.

usage: python scripts/plan_report.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from civitas.session import build_session  # noqa: E402

OPS = {
    "shuffles": r"(?<![A-Za-z])Exchange(?: [^\n(]*)?\(\d+\)",
    "broadcasts": r"BroadcastExchange(?: [^\n(]*)?\(\d+\)",
    "bhj": r"BroadcastHashJoin(?: [^\n(]*)?\(\d+\)",
    "smj": r"SortMergeJoin(?: [^\n(]*)?\(\d+\)",
    "bnlj": r"BroadcastNestedLoopJoin(?: [^\n(]*)?\(\d+\)",
    "cartesian": r"CartesianProduct(?: [^\n(]*)?\(\d+\)",
    "hash_agg": r"(?<![A-Za-z])HashAggregate(?: [^\n(]*)?\(\d+\)",
    "sort_agg": r"SortAggregate(?: [^\n(]*)?\(\d+\)",
    "obj_agg": r"ObjectHashAggregate(?: [^\n(]*)?\(\d+\)",
    "window": r"(?<![A-Za-z])Window(?:GroupLimit)?(?: [^\n(]*)?\(\d+\)",
    "topk": r"TakeOrderedAndProject(?: [^\n(]*)?\(\d+\)",
    "python_udf": r"(?:BatchEvalPython|ArrowEvalPython)(?: [^\n(]*)?\(\d+\)",
}


def tree_part(text: str) -> str:
    return text.split("\n\n\n")[0]


def final_part(text: str) -> str:
    """Without the initial plan that an adaptive plan also prints, and without
    the details of its nodes."""
    tree, _, details = text.partition("\n\n\n")
    initial = tree.find("== Initial Plan ==")
    if initial < 0:
        return text
    final = tree[:initial]
    kept = set(re.findall(r"\((\d+)\)", final))
    blocks = re.split(r"\n(?=\(\d+\) )", "\n" + details)
    return final + "\n\n\n" + "\n".join(
        b for b in blocks if (m := re.match(r"\((\d+)\) ", b)) and m[1] in kept)


def analyse(text: str) -> dict:
    tree = tree_part(text)
    out = {k: len(re.findall(p, tree, flags=re.M)) for k, p in OPS.items()}
    scans = []
    for block in re.findall(r"\(\d+\) Scan parquet[^\n]*\n(.*?)(?=\n\(\d+\)|\Z)", text, flags=re.S):
        rs = re.search(r"ReadSchema: struct<(.*)>", block)
        pf = re.search(r"PushedFilters: \[(.*?)\]\n", block + "\n")
        loc = re.search(r"Location: \w+ \[[^\]]*/([^/\]]+)\]", block)
        ncols = len(re.findall(r"[a-z_0-9]+:", rs.group(1))) if rs else 0
        pushed = pf.group(1).strip() if pf else ""
        scans.append(((loc.group(1) if loc else "?"), ncols, pushed))
    out["scans"] = scans
    out["window_keys"] = re.findall(r"Arguments: \[.*?\], \[(.*?)\], \[", text)[:3]
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(
        "local[8]", shuffle_partitions=16, extra={"spark.sql.autoBroadcastJoinThreshold": "-1"})
    from civitas.plans import QUERIES  # noqa: PLC0415
    rows = []
    for key, fn in QUERIES.items():
        df = fn(spark, sf)
        df._jdf.queryExecution().toRdd().count()  # runs this plan, so AQE makes it final
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(mode="formatted")
        rows.append((key, analyse(final_part(buf.getvalue()))))
    lines = ["# Physical plans (executed plans)", "",
             f"Generated by `scripts/plan_report.py` at `{sf}` with 16 shuffle partitions.",
             "Final adaptive plans, after every query has run; jobs that a query runs before",
             "(written tables, streams, upserts) are not part of its last plan.  Columns: shuffles",
             "(Exchange), broadcasts, BHJ / SMJ / nested-loop / cartesian joins, hash /",
             "sort / object-hash aggregates, windows, TakeOrderedAndProject, Python UDF",
             "nodes; then each Parquet scan as table(columns read; pushed filters).", "",
             "| query | shuf | bcast | bhj | smj | bnlj | cart | hagg | sagg | oagg | win | topk | udf | scans |",
             "|---|---|---|---|---|---|---|---|---|---|---|---|---|---|"]
    for key, a in rows:
        scans = "; ".join(f"{t}({n}{'; ' + p if p else ''})" for t, n, p in a["scans"])
        lines.append(f"| {key} | {a['shuffles']} | {a['broadcasts']} | {a['bhj']} | {a['smj']} | "
                     f"{a['bnlj']} | {a['cartesian']} | {a['hash_agg']} | {a['sort_agg']} | "
                     f"{a['obj_agg']} | {a['window']} | {a['topk']} | {a['python_udf']} | {scans} |")
    os.makedirs(os.path.join(ROOT, "docs"), exist_ok=True)
    with open(os.path.join(ROOT, "docs", "PLANS.md"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    bad = [k for k, a in rows if a["python_udf"] or a["cartesian"] or a["bnlj"]]
    print("queries with python udf / cartesian / nested loop:", bad)


if __name__ == "__main__":
    main()
