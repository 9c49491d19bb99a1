"""lectern info | validate PATH | extract FILE | batch IN OUT: a thin command line over the plans."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from lectern.operators import records
from lectern.session import session
from lectern.sources import files
from lectern.sources.adapters import Options


def validate(path: str) -> int:
    """Reports of JSON files; 1 if one is not valid or does not meet the schema."""
    got = files.read_records(session(), path).select("path", records.validation(F.col("json")).alias("v"), records.schema_errors(F.col("json")).alias("e")).select("path", "v.*", "e")
    bad = 0
    for r in got.toLocalIterator():
        good = r.valid and not r.e
        bad += not good
        print(r.path, "valid" if good else "not valid", *(f"{e.path} {e.message}" for e in r.e), *r.field_issues, *r.warnings, sep="\n  ")
    return int(bad > 0)


def extract(path: str, target: str | None, identifiers: bool) -> int:
    """The record of one file, printed or written; 1 with the error if there is none."""
    from lectern.plans.files import records as made

    row = made(session(), path, options=Options(extract_identifiers=identifiers)).first()
    if row is None or row.json is None:
        print(f"{path}: {row.error if row else 'no file of a supported format'}", file=sys.stderr)
        return 1
    if target:
        with open(target, "w", encoding="utf-8") as f:
            f.write(row.json + "\n")
    else:
        print(row.json)
    return 0


def batch(source: str, target: str, patterns: str, identifiers: bool = False) -> int:
    """Records of all files that meet the patterns, with a result for each file; 1 if one of them failed."""
    from lectern.plans.files import records as made
    from lectern.session import staged

    got = staged(made(session(), source, patterns, Options(extract_identifiers=identifiers)))
    files.write_batch(got, target)
    failed = got.where("error is not null").count()
    print(f"{got.count() - failed} records, {failed} failed")
    return int(failed > 0)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lectern", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("info")
    sub.add_parser("validate").add_argument("path")
    b = sub.add_parser("batch")
    b.add_argument("source")
    b.add_argument("target")
    b.add_argument("--patterns", default="*.pdf,*.png,*.jpg,*.jpeg,*.txt,*.md")
    e = sub.add_parser("extract")
    e.add_argument("path")
    e.add_argument("--out")
    for x in (b, e):
        x.add_argument("--identifiers", action="store_true")
    got = parser.parse_args(args)
    if got.command == "info":
        print("lectern: records from documents on Spark; formats:", ", ".join(files.MEDIA))
        return 0
    if got.command == "extract":
        return extract(got.path, got.out, got.identifiers)
    return validate(got.path) if got.command == "validate" else batch(got.source, got.target, got.patterns, got.identifiers)


if __name__ == "__main__":
    sys.exit(main())
