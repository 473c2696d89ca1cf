"""Command line: ``python -m diskloom VERB FOLDER ...`` over all images of a folder.

Verbs: info, list, verify, copy, create, delete, attr, mkdir, rmdir.  Edits write new images
to ``--out``; the images read are never changed.  Exit code 1: an error, or an invalid image.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession


def _show(rows: DataFrame, as_json: bool) -> None:
    from .plans.corpus import reports

    for row in reports(rows).toLocalIterator():
        if as_json:
            print(row["value"])
        else:
            print("  ".join(f"{k}={v}" for k, v in json.loads(row["value"]).items() if not isinstance(v, (list, dict))))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="diskloom")
    parser.add_argument("verb", choices=["info", "list", "verify", "copy", "create", "delete", "attr", "mkdir", "rmdir"])
    parser.add_argument("folder", help="folder of images; for create, the new image")
    parser.add_argument("path", nargs="?", help="path inside the image, wildcards in its last part")
    parser.add_argument("more", nargs="*", help="attr: changes such as +R -A; create: variant")
    parser.add_argument("-r", "--recursive", action="store_true")
    parser.add_argument("--image", help="image to edit (its file name)")
    parser.add_argument("--partition", type=int, default=0)
    parser.add_argument("--source", help="copy: host file to write into the image")
    parser.add_argument("--out", help="folder for extracted files and new images")
    parser.add_argument("--label")
    parser.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("diskloom").getOrCreate()
    from pyspark.sql import functions as F

    from .operators import kernel
    from .plans.corpus import Corpus
    from .sources.sinks import write_files

    if args.verb == "create":
        try:
            variant = args.path or "double"
            image = kernel.blank("victor_floppy" if variant in kernel.VICTOR_FORMATS else "ibm_floppy", variant, args.label)
        except kernel.Problem as problem:
            print(problem, file=sys.stderr)
            return 1
        with open(args.folder, "wb") as file:
            file.write(image)
        return 0
    if not os.path.exists(args.folder) and "://" not in args.folder:
        print(f"Not found: {args.folder}", file=sys.stderr)
        return 1
    corpus = Corpus.scan(spark, args.folder)
    if args.verb == "info":
        _show(corpus.info(), args.json)
    elif args.verb == "list":
        _show(corpus.find(args.path, args.recursive) if args.path and any(c in args.path for c in "*?") else corpus.list(args.path, args.recursive), args.json)
    elif args.verb == "verify":
        _show(corpus.verify(), args.json)
        return int(not corpus.valid().where("not valid").isEmpty())
    elif args.verb == "copy" and not args.source:
        done = corpus.extract(args.path or "*", args.out or ".", args.recursive)
        _show(done, args.json)
    else:
        if not args.image or not args.path or not args.out:
            parser.error("edits need --image, a path and --out")
        if args.verb == "copy":
            with open(args.source, "rb") as file:
                made = corpus.write(args.image, args.path, file.read(), args.partition)
        elif args.verb == "attr":
            made = corpus.attr(args.image, args.path, args.more, args.partition)
        elif args.verb == "rmdir":
            made = corpus.rmdir(args.image, args.path, args.recursive, args.partition)
        else:
            made = getattr(corpus, args.verb)(args.image, args.path, args.partition)
        rows = made.collect()  # one image
        failed = [r["error_message"] for x in rows for r in x["results"] if r["error_message"]]
        if failed or not rows:
            print("; ".join(failed) or f"Not found: {args.image}", file=sys.stderr)
            return 1
        again = spark.createDataFrame([(x["image_id"], x["content"]) for x in rows], "relative string, content binary")
        _show(write_files(again.select(F.col("relative"), F.col("content")), args.out), args.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
