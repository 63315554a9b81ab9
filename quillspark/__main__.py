"""Command line: import, collections, suggest, search, show, links, random."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import render
from .plans import build, collections
from .plans.library import Library, search_head
from .sources.archive import archive_paths


def main() -> int:
    parser = argparse.ArgumentParser(prog="quillspark")
    sub = parser.add_subparsers(dest="command", required=True)
    add = sub.add_parser("import", help="build indexes of archives or folders of them")
    add.add_argument("files", nargs="+")
    add.add_argument("--out", required=True)
    add.add_argument("--force", action="store_true")
    add.add_argument("--any-producer", action="store_true")
    listed = sub.add_parser("collections", help="what is loaded and what is skipped")
    listed.add_argument("indexes", nargs="+")
    for name, what in (("suggest", "query"), ("search", "query"), ("show", "title"), ("links", "title")):
        one = sub.add_parser(name)
        one.add_argument("index")
        one.add_argument(what)
        one.add_argument("--limit", type=int, default=10)
        one.add_argument("--json", action="store_true")
    pick = sub.add_parser("random")
    pick.add_argument("index")
    pick.add_argument("--seed", type=int, default=0)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    if args.command == "import":
        made = build.build_all(spark, archive_paths(args.files), args.out, args.force, args.any_producer)
        for path, result in made.items():
            print(f"{path}: {result}")
        return int(any(isinstance(r, Exception) for r in made.values()))
    if args.command == "collections":
        print(collections.summary(collections.open_collections(spark, dict.fromkeys(args.indexes))))
        return 0
    library = Library(spark, args.index)
    if args.command == "suggest":
        for r in library.suggest(args.query, args.limit).collect():
            print(f"{r['inbound']:>8,}  {r['title']}" + (f" ({r['matched']})" if r["matched"] else "") + (f" #{r['fragment']}" if r["fragment"] else ""))
    elif args.command == "search":
        rows = library.search(args.query, args.limit).collect()
        print("\n".join([search_head(len(rows), args.limit, args.query), *(f"{r['title']}: {r['summary']}" for r in rows)]))
    elif args.command == "random":
        print(library.random(args.seed))
    else:
        found = library.resolve_title(args.title)
        if found.entry is None:
            begun = f" beginning with {found.prefix!r}" if found.prefix else ""
            print(f"Not found; titles{begun}: " + ", ".join(r["title"] for r in found.suggestions or []))
            return 1
        if args.command == "links":
            for r in library.links(found.entry, fragment=found.fragment).orderBy("rank").collect():
                print(r["target"])
        else:
            doc = library.article(found.entry)
            print(json.dumps(doc, ensure_ascii=False) if args.json else "\n".join(render.layout(doc, 100)[0]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
