"""Command line: analyze, generate, dot, editor-xml, pnml."""

from __future__ import annotations

import argparse
import datetime
import logging
import os
import sys
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import SparkSession

from markspan.functions.vectors import spaced
from markspan.operators.reachability import explain_node, explore, repeated_markings
from markspan.sinks.text import editor_xml, net_dot, ordered, pnml, tree_dot, write_text
from markspan.sources.nets import generate_net, read_nets, write_net

log = logging.getLogger("markspan")


def _session(threads: int | None) -> SparkSession:
    """The session at hand, or one with the master that is configured; without one, local threads."""
    builder = SparkSession.builder.appName("markspan")
    if SparkSession.getActiveSession() is None and not SparkConf().contains("spark.master"):
        cores = os.cpu_count() or 1
        used = max(1, min(threads or cores, cores))
        builder = builder.master(f"local[{used}]").config("spark.sql.shuffle.partitions", str(used)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return builder.getOrCreate()


def analyze_options(words: list[str]) -> argparse.Namespace:
    """Options of ``analyze``: a value is the word after its option, whatever it looks like.

    An option that is the last word has no value and is ignored, as are words
    that are no option; the last of repeated options counts.
    """
    valued = {"--input": None, "--nthreads": None, "--output": None, "--markingid": None}
    switches = {"--debug": False, "--compat": False}
    ignored, left = [], list(words)
    while left:
        word = left.pop(0)
        if word in valued and left:
            valued[word] = left.pop(0)
            if word == "--nthreads":
                valued[word] = int(valued[word])
        elif word in switches:
            switches[word] = True
        else:
            ignored.append(word)
    if ignored:
        log.warning("ignored: %s", " ".join(ignored))
    if valued["--input"] is None:
        raise ValueError("an input file is needed: --input <file>")
    return argparse.Namespace(command="analyze", **{k[2:]: v for k, v in {**valued, **switches}.items()})


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="markspan", description=__doc__, allow_abbrev=False)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("analyze", add_help=False, help="enumerate the states of a net: --input FILE [--nthreads N] [--output DOT] [--debug [--markingid ID]] [--compat]")
    g = sub.add_parser("generate", help="write a fork/join net", allow_abbrev=False)
    g.add_argument("--branches", type=int, required=True)
    g.add_argument("--branches-len", required=True, help="comma-separated lengths")
    g.add_argument("--tail-length", type=int, required=True)
    g.add_argument("--omegas", action="store_true")
    g.add_argument("--output")
    for name in ("editor-xml", "pnml"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("output")
    sub.add_parser("dot", help="print a net's structure").add_argument("input")
    return parser


@contextmanager
def _reports(spark: SparkSession, first: float = 1.0, every: float = 5.0) -> Iterator[dict]:
    """Log the states so far and the tasks at work, after a second and then every five."""
    found, over = {"level": 0, "states": 1}, threading.Event()

    def report() -> None:
        wait = first
        while not over.wait(wait):
            wait, tracker = every, spark.sparkContext.statusTracker()
            stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
            log.info("level: %d, states: %d, active tasks: %d, queued tasks: %d", found["level"], found["states"], sum(s.numActiveTasks for s in stages), sum(s.numTasks - s.numActiveTasks - s.numCompletedTasks for s in stages))

    thread = threading.Thread(target=report, daemon=True)
    thread.start()
    try:
        yield found
    finally:
        over.set()
        thread.join()


def analyze(args: argparse.Namespace) -> None:
    spark = _session(args.nthreads)
    nets = read_nets(spark, args.input).cache()
    nets.count()
    started = time.perf_counter()
    with _reports(spark) as found:
        states = explore(nets, strict=not args.compat, progress=lambda level, total: found.update(level=level, states=total + 1))
        count = states.count()
        repeated = [r["marking"] for r in repeated_markings(states).select(spaced("marking").alias("marking")).toLocalIterator()]
    print(f"Time taken: {(time.perf_counter() - started) * 1000:.0f} ms")
    if repeated:
        log.warning("repeated markings: %s", ", ".join(repeated))
    else:
        log.info("repeated markings: none")
    log.info("states: %d", count)
    if args.debug:
        for row in explain_node(states, nets, args.markingid or "m0").orderBy("node_id", "step").toLocalIterator():
            print(f"[{row.node_id}] ancestor {row.ancestor_id}={row.ancestor} fired={row.fired}: {row.verdict} {row['mask']}")
    if args.output:
        write_text(tree_dot(states), args.output)
        log.info("DOT written to %s", args.output)


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    words = sys.argv[1:] if argv is None else argv
    try:
        if words[:1] == ["analyze"] and not {"-h", "--help"} & set(words[1:2]):
            args, unknown = analyze_options(words[1:]), []
        else:
            args, unknown = _parser().parse_known_args(words)
    except SystemExit as stop:
        return 0 if stop.code in (0, None) else 1
    except ValueError as error:
        log.error("%s", error)
        return 1
    if unknown:
        log.warning("ignored: %s", " ".join(unknown))
    try:
        if args.command == "generate":
            lengths = [int(x) for x in args.branches_len.split(",")]
            text = write_net(generate_net(args.branches, lengths, args.tail_length, args.omegas), args.output)
            if not args.output:
                print(text)
        elif args.command == "analyze" and hasattr(args, "input"):
            analyze(args)
        elif args.command == "analyze":
            _parser().print_help()
        else:
            nets = read_nets(_session(None), args.input)
            if args.command == "dot":
                for row in ordered(net_dot(nets)).toLocalIterator():
                    print(row["line"])
            elif args.command == "editor-xml":
                write_text(editor_xml(nets), args.output)
            else:
                write_text(pnml(nets, os.path.basename(args.output), f"generated on {datetime.datetime.now().isoformat()}"), args.output)
    except Exception as error:
        log.error("%s", error)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
