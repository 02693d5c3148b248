"""python -m twinlake: compare, mark and db over stored catalogs.  Nothing is deleted or moved; mark writes an action plan."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="twinlake", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    compare = verbs.add_parser("compare", help="groups of a catalog's entries")
    mark = verbs.add_parser("mark", help="what a strategy would do with stored items")
    db = verbs.add_parser("db", help="clean, export or list a catalog")
    for p in (compare, db):
        p.add_argument("--catalog", required=True)
        p.add_argument("--include", action="append", default=[])
        p.add_argument("--exclude", action="append", default=[])
    compare.add_argument("--percent", type=float, default=96)
    compare.add_argument("--folders", choices=["none", "same", "different"], default="none")
    mark.add_argument("--items", required=True)
    mark.add_argument("--strategy", required=True)
    mark.add_argument("--action", default="delete")
    mark.add_argument("--target", default="")
    db.add_argument("--do", choices=["clean", "export", "diagnostic", "folders"], required=True)
    for p in (compare, mark, db):
        p.add_argument("--out", required=True)
    a = top.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import rank, results, scope, verdict
    from .plans import engine
    from .sources import readers, sinks

    spark = SparkSession.builder.appName("twinlake").getOrCreate()
    if a.verb == "mark":
        items = spark.read.parquet(a.items)
        gone = rank.deletions(items, a.strategy).select("group_id", "seq").withColumn("_gone", F.lit(True))
        marked = items.drop("checked").join(gone, ["group_id", "seq"], "left").withColumn("checked", F.coalesce("_gone", F.lit(False))).drop("_gone")
        results.action_plan(marked, a.action, a.target).write.mode("overwrite").json(a.out)
        return
    where = scope.Scope(include=a.include, blacklist=a.exclude)
    if a.verb == "compare":
        entries = spark.read.parquet(a.catalog)
        engine.compare(entries, engine.Settings(scope=where, matching=verdict.Matching(percent=a.percent), folders=a.folders)).write.mode("overwrite").parquet(a.out)
        return
    entries = readers.read_catalog(spark, a.catalog)
    if a.do == "clean":
        scope.cleaned(entries, where).write.mode("overwrite").parquet(a.out)
    else:
        sinks.write_json({"export": lambda e: e, "diagnostic": sinks.diagnostic, "folders": scope.folder_stats}[a.do](entries), a.out)


if __name__ == "__main__":
    main()
