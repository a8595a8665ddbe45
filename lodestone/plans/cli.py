"""Command line: search, locate, expand, find-related, clear, serve."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from lodestone.plans import render
from lodestone.plans.index import Index
from lodestone.session import local_session
from lodestone.sources import bundle
from lodestone.sources.embedders import Embedder, chosen_embedder


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple[str, dict]) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for flag, options in arguments:
            c.add_argument(flag, **options)
        c.add_argument("--content", action="append", default=[])
        c.add_argument("--json", action="store_true")
        c.add_argument("--embedding-url")
        c.add_argument("--embedding-model")
        c.add_argument("--embedding-dimensions", type=int)
        return c

    k = ("--top-k", {"type": int, "default": 5})
    place = (("path", {}), ("file", {}), ("line", {"type": int}))
    narrow = (("--language", {"action": "append", "default": []}), ("--path-prefix", {"action": "append", "default": []}))
    command("search", ("path", {}), ("query", {}), k, ("--alpha", {"type": float}), *narrow)
    command("locate", ("path", {}), ("literal", {"nargs": "+"}), ("--mode", {"choices": ["count", "locations", "lines"], "default": "lines"}), ("--limit", {"type": int}), ("--ignore-case", {"action": "store_true"}), ("--match-variants", {"action": "store_true"}), ("--include", {"action": "append", "default": []}), ("--exclude", {"action": "append", "default": []}), ("--context", {"type": int, "default": 0}))
    command("expand", *place, ("--before", {"type": int, "default": 1}), ("--after", {"type": int, "default": 1}))
    command("find-related", *place, k)
    command("clear", ("path", {}))
    command("serve")
    return p


def main(argv: Sequence[str] | None = None, embedder: Embedder | None = None) -> int:
    """Run one command; ``embedder`` overrides what options and environment name."""
    a = parser().parse_args(argv)
    spark = local_session()
    if a.command == "clear":
        bundle.clear(spark, a.path)
        return 0
    if a.command == "serve":
        from lodestone.plans.server import serve

        return serve(spark, sys.stdin, sys.stdout, embedder or chosen_embedder(a.embedding_url, a.embedding_model, a.embedding_dimensions))
    index = Index.from_source(spark, a.path, a.content, embedder or chosen_embedder(a.embedding_url, a.embedding_model, a.embedding_dimensions))
    if a.command == "locate":
        hits = index.locate(a.literal, ignore_case=a.ignore_case, variants=a.match_variants, include=a.include, exclude=a.exclude, context=a.context)
        payload = render.locate_payload(" | ".join(a.literal), hits, a.mode, a.limit)
        print(render.as_json(payload) if a.json else render.locate_text(payload))
        return 0
    if a.command == "expand":
        payload = render.expand_payload(a.file, a.line, index.expand(a.file, a.line, a.before, a.after), index.root)
        print(render.as_json(payload) if a.json else render.expand_text(payload))
        return 0
    if a.command == "search":
        payload = render.search_payload(a.query, index.snippets(index.search(a.query, a.top_k, a.alpha, a.language, a.path_prefix), a.query), index.root)
    else:
        payload = render.search_payload(a.file, index.find_related(a.file, a.line, a.top_k), index.root)
    print(render.as_json(payload) if a.json else render.search_text(payload))
    return 0


if __name__ == "__main__":
    sys.exit(main())
