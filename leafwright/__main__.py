"""Command line: run a query over a folder of tables, list the queries, or time the bench cases.

    python -m leafwright list
    python -m leafwright run document_markdown --tables DIR --out DIR [--format parquet|json|csv]
    python -m leafwright parse DIR --out DIR
    python -m leafwright bench --tables DIR [--cases layout_nms,table_html] [--warmup 1] [--iterations 5]
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
import time


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("leafwright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def queries() -> dict:
    from leafwright import catalogue

    return catalogue.queries()


def timed(case: str, tables: str) -> dict:
    """Seconds of one run of a case in a process of its own, so that cases can't disturb each other; `blocked` where it fails."""
    p = subprocess.run([sys.executable, "-m", "leafwright", "once", case, "--tables", tables], capture_output=True, text=True)
    lines = [x for x in p.stdout.splitlines() if x.startswith("{")]
    return json.loads(lines[-1]) if p.returncode == 0 and lines else {"case": case, "status": "blocked"}


def summary(seconds: list[float]) -> dict:
    """Count, least, mean, most, and p50 and p95 interpolated on rank p (n - 1); zeros for none."""
    s = sorted(seconds)

    def at(p: float) -> float:
        if not s:
            return 0.0
        r = p * (len(s) - 1)
        low = int(r)
        return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (r - low)

    return {"n": len(s), "min": s[0] if s else 0.0, "mean": sum(s) / len(s) if s else 0.0, "max": s[-1] if s else 0.0, "p50": at(0.5), "p95": at(0.95)}


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="leafwright")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("run", "once"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--tables", required=True)
        if name == "run":
            p.add_argument("--out", required=True)
            p.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
        else:
            p.add_argument("--warmup", type=int, default=1)
            p.add_argument("--iterations", type=int, default=5)
    p = sub.add_parser("parse")
    p.add_argument("folder")
    p.add_argument("--out", required=True)
    p = sub.add_parser("bench")
    p.add_argument("--tables", required=True)
    p.add_argument("--cases", default="layout_postprocess,reading_order,document_markdown,table_html,content_list")
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    if a.command == "list":
        print("\n".join(sorted(queries())))
    elif a.command == "bench":
        print(json.dumps([timed(c, a.tables) for c in a.cases.split(",")]))
    elif a.command in ("run", "once"):
        q = queries().get(a.query)
        if q is None:
            print(f"no query {a.query}", file=sys.stderr)
            return 2
        spark = session()
        if a.command == "run":
            q(spark, a.tables).write.mode("overwrite").format(a.format).save(a.out)
        else:
            seconds = []
            for _ in range(a.warmup + a.iterations):
                began = time.time()
                q(spark, a.tables).write.format("noop").mode("overwrite").save()
                seconds.append(time.time() - began)
            print(json.dumps({"case": a.query, "status": "ok", **summary(seconds[a.warmup :])}))
    else:
        from leafwright.sources import files

        files.folder(session(), a.folder).write.mode("overwrite").json(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
