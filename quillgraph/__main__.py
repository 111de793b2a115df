"""python -m quillgraph ingest FOLDER OUT [--config DIR] [--prices FILE] | serve OUT [--token T] [--port N] [--config DIR]

ingest takes what is new or changed in a folder into the next version of the graph below OUT; serve answers questions and
read-only SQL over the last version. Settings come from the TOML files of a folder and from variables."""

from __future__ import annotations

import argparse
from dataclasses import replace

from quillgraph.plans import engine, server
from quillgraph.plans.ingest import stub_embedder
from quillgraph.session import session
from quillgraph.sources.config import load_config, load_pricing

VIEWS = ("documents", "pages", "sections", "paragraphs", "entities", "relationships", "mentions", "merges", "calls", "statistics")


def main(args: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(prog="quillgraph", description=__doc__)
    sub = p.add_subparsers(dest="do", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("folder")
    a.add_argument("out")
    a.add_argument("--prices")
    b = sub.add_parser("serve")
    b.add_argument("out")
    b.add_argument("--token")
    b.add_argument("--port", type=int, default=3030)
    for x in (a, b):
        x.add_argument("--config")
    o = p.parse_args(args)
    spark, config = session(), load_config(o.config)
    if o.do == "ingest":
        return engine.run(spark, o.folder, o.out, config, prices=load_pricing(spark, o.prices) if o.prices else None)
    version = engine.current(spark, o.out)
    if version is None:
        p.error(f"no graph below {o.out}")
    at = f"{o.out}/{version}"
    for name in VIEWS:
        spark.read.parquet(f"{at}/{name}").createOrReplaceTempView(name)
    embed = stub_embedder()
    routes = server.retrieval_routes(engine.graph_tables(spark, at), lambda q: embed([q])[0], config)
    with server.create_server(spark, replace(config.api, token=o.token or config.api.token), routes, port=o.port) as s:
        s.serve_forever()
    return version


if __name__ == "__main__":
    print(main())
