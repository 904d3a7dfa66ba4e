"""Command line: python -m tidepool.cli STORE index FOLDER... | search QUERY | status | open ID | feedback QUERY ID ACTION |
model status, validate or install FOLDER | reembed | serve | acceptance."""

from __future__ import annotations

import argparse
import json
import time

from tidepool import acceptance
from tidepool.operators import vectors
from tidepool.plans.ingest import Store
from tidepool.service import serve
from tidepool.session import build_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidepool")
    p.add_argument("store")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("folders", nargs="+")
    index.add_argument("--reindex", action="store_true")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=20)
    sub.add_parser("status")
    opened = sub.add_parser("open")
    opened.add_argument("id", type=int)
    feedback = sub.add_parser("feedback")
    for name in ("query", "id", "action"):
        feedback.add_argument(name)
    model = sub.add_parser("model")
    model.add_argument("what", choices=["status", "validate", "install"])
    model.add_argument("folders", nargs="*")
    sub.add_parser("reembed")
    served = sub.add_parser("serve")
    served.add_argument("--port", type=int, default=8077)
    sub.add_parser("acceptance")
    args = p.parse_args(argv)
    if args.command == "model":
        said = vectors.install_model(*args.folders) if args.what == "install" else (vectors.model_status if args.what == "status" else vectors.validate_model)(*args.folders)
        print(json.dumps(said))
        return 0 if said["available"] else 1
    if args.command == "acceptance":
        results = acceptance.run(build_session(), args.store)
        print(json.dumps(results))
        return 0 if all(r["passed"] for r in results) else 1
    store, now_us = Store(build_session(), args.store), int(time.time() * 1_000_000)
    if args.command == "index":
        print(json.dumps(store.ingest_all(args.folders, now_us, args.reindex)))
    elif args.command == "search":
        results = store.engine().search(args.query, args.limit)
        for r in [] if results is None else results.orderBy("position").collect():
            print(f"{r['position']}. {r['file_name']} ({r['score']:.3f}) {r['path']}\n   {r['why']}")
    elif args.command == "status":
        print(json.dumps(store.status()))
    elif args.command == "open":
        found = store.open_document(args.id, now_us)
        print(json.dumps(found, default=str))
        return 0 if found else 1
    elif args.command == "reembed":
        print(json.dumps({"chunks": store.reembed()}))
    elif args.command == "serve":
        serve(store, args.port).serve_forever()
    else:
        store.record_feedback(args.query, args.id, args.action, now_us // 1000)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
