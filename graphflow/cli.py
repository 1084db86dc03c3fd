"""Commands: python -m graphflow.cli <command> ..."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphflow.functions import colour
from graphflow.operators import clusters as cl
from graphflow.operators import matrix, quality, render, similarity
from graphflow.plans import algorithms
from graphflow.schema import MatrixMeta, Params
from graphflow.scratch import Scratch
from graphflow.sources import abc, images


def session() -> SparkSession:
    return SparkSession.builder.appName("graphflow").getOrCreate()


def _params(p: argparse.ArgumentParser) -> None:
    p.add_argument("-I", "--inflation", type=float, default=Params.inflation)
    p.add_argument("-p", "--cutoff", type=float)
    p.add_argument("-P", "--inverse-cutoff", type=float, help="1/cutoff; only without -p")
    p.add_argument("-S", "--select", type=int, default=Params.select)
    p.add_argument("-a", "--auto-prune", action="store_true")


def _run_params(p: argparse.ArgumentParser) -> None:
    _params(p)
    p.add_argument("-b", "--balance", type=float, default=Params.balance)
    p.add_argument("--max-iter", type=int, default=Params.max_iter)
    p.add_argument("--chaos-limit", type=float, default=Params.chaos_limit)
    p.add_argument("--change-limit", type=float, default=Params.change_limit)
    p.add_argument("--force-iter", type=int, default=0)
    p.add_argument("-c", "--counters", help="folder for the counters of every iteration")
    p.add_argument("-l", "--logfile")
    p.add_argument("--abc", action="store_true", help="the input is an edge list, not a stored matrix")


def _of(a: argparse.Namespace) -> Params:
    options = {k: getattr(a, k) for k in ("inflation", "select", "auto_prune", "balance", "max_iter", "chaos_limit", "change_limit", "force_iter") if hasattr(a, k)}
    if a.cutoff is not None:
        options["cutoff"] = a.cutoff
    return Params.prune(a.inverse_cutoff, **options)


def _pixel_params(p: argparse.ArgumentParser) -> None:
    p.add_argument("-r", "--radius", type=float, default=3.0)
    p.add_argument("-sX", "--sigma-x", type=float, default=1.0)
    p.add_argument("-sF", "--sigma-f", type=float, default=1.0)
    p.add_argument("-a", "--analyse", action="store_true", help="show the range of each band only")


def cmd_abc(spark, a) -> None:
    m, meta = abc.build_matrix(abc.read_abc(spark, a.input), a.scale, a.nsub, "insert" if a.insert_loops else "error")
    abc.save_matrix(m, meta, a.output)
    print(f"n={meta.n} kmax={meta.kmax}")


def cmd_transpose(spark, a) -> None:
    m, meta = abc.load_matrix(spark, a.input)
    matrix.by_row(m, meta.nsub).write.mode("overwrite").parquet(a.output)


def cmd_step(spark, a) -> None:
    m, meta = abc.load_matrix(spark, a.input)
    scratch = Scratch(spark)
    previous = abc.load_matrix(spark, a.previous)[0] if a.previous else None
    new, stats = algorithms.step(m, abc.load_matrix(spark, a.factor)[0] if a.factor else m, _of(a), scratch, previous, meta.n)
    abc.save_matrix(new, MatrixMeta(meta.n, meta.nsub, stats.kmax), a.output)
    scratch.drop(new)
    print(stats)


def _flow(spark, a, balance: float | None) -> None:
    if a.logfile:
        logging.getLogger("graphflow").addHandler(logging.FileHandler(a.logfile))
    if a.abc:
        m, meta = abc.build_matrix(abc.read_abc(spark, a.input), missing_diagonal="insert")
    else:
        m, meta = abc.load_matrix(spark, a.input)
    p = _of(a) if balance is None else Params(**{**_of(a).__dict__, "balance": balance})
    limit, stats = algorithms.run(m, p, meta.n)
    found = cl.clusters(limit, spark.range(meta.n).withColumnRenamed("id", "node"))
    abc.write_clusters(found, a.output)
    if a.counters:
        abc.write_counters(spark, stats, a.counters)
    print(f"iterations={len(stats)} chaos={stats[-1].chaos if stats else 0:.6f}")


def cmd_load_img(spark, a) -> None:
    pixels = images.read_pixels(spark, a.input)
    w, h = pixels.agg(F.max("w"), F.max("h")).first()
    if a.analyse:
        colour.channel_range(pixels).show()
        return
    if a.cielab:
        pixels = colour.rgb_to_lab(pixels)
    print(abc.write_graph(similarity.image_similarity(pixels, w, h, a.radius, a.sigma_x, a.sigma_f), a.output))


def cmd_load_mat(spark, a) -> None:
    frame = images.read_tof(spark, a.input)
    w, h = frame.agg(F.max("w"), F.max("h")).first()
    if a.analyse:
        colour.channel_range(frame, ("X", "Y", "Z", "I")).show()
        return
    print(abc.write_graph(similarity.tof_similarity(frame, w, h, a.radius, a.sigma_x, a.sigma_f), a.output))


def cmd_result(spark, a) -> None:
    if a.component:
        frame = images.read_tof(spark, a.input, all_frames=True)
        w, h = frame.agg(F.max("w"), F.max("h")).first()
        grey = colour.greyscale(frame.withColumn("node", F.col("frame").cast("long") * (w * h) + F.col("node")), a.component, a.imin, a.imax)
        inner = F.col("node") % (w * h)
        pixels = grey.select(F.floor(F.col("node") / (w * h)).cast("int").alias("frame"), F.floor(inner / h).cast("int").alias("x"), (inner % h).cast("int").alias("y"), *(F.col("grey").cast("double").alias(f"c{k}") for k in range(3)))
    else:
        pixels = images.read_pixels(spark, a.input, all_frames=True)
        w, h = pixels.agg(F.max("w"), F.max("h")).first()
        pixels = pixels.select("frame", "x", "y", "c0", "c1", "c2")
    found = abc.read_clusters(spark, a.clusters)
    print(images.write_images(render.outline(pixels, found, w, h, a.line_colour, a.high_quality), a.output, a.thumbnail).count())


def cmd_ncut(spark, a) -> None:
    many: DataFrame | None = None
    for i, path in enumerate(a.clusterings):
        one = abc.read_clusters(spark, path).select(F.lit(i).alias("clustering"), "node", "cluster")
        many = one if many is None else many.union(one)
    for r in quality.ncut_many(abc.read_abc(spark, a.input), many).orderBy("clustering").collect():
        print(f"{a.clusterings[r['clustering']]}\tclusters={r['clusters']}\tncut={r['ncut']:.6f}\tavg={r['avg']:.6f}")


def cmd_abc_out(spark, a) -> None:
    print(abc.write_abc(abc.load_matrix(spark, a.input)[0], a.output, one_file=not a.hdfs))


def cmd_check(spark, a) -> None:
    print(spark.range(10).agg(F.sum("id")).first()[0] == 45)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphflow")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, f, files=("-i", "-o")):
        p = commands.add_parser(name)
        for flag in files:
            p.add_argument(flag, dest={"-i": "input", "-o": "output"}[flag], required=True)
        p.set_defaults(run=f)
        return p

    p = command("abc", cmd_abc)
    p.add_argument("-s", "--scale", type=int, default=1)
    p.add_argument("-nsub", type=int, default=128)
    p.add_argument("--insert-loops", action="store_true")
    command("transpose", cmd_transpose)
    p = command("step", cmd_step)
    p.add_argument("--factor")
    p.add_argument("--previous")
    _params(p)
    for name, balance in (("mcl", 1.0), ("rmcl", 0.0), ("bmcl", None)):
        _run_params(command(name, lambda s, a, b=balance: _flow(s, a, b)))
    p = command("load-img", cmd_load_img)
    _pixel_params(p)
    p.add_argument("-cielab", action="store_true")
    _pixel_params(command("load-mat", cmd_load_mat))
    p = command("result", cmd_result)
    p.add_argument("-c", "--clusters", required=True)
    p.add_argument("-lc", "--line-colour", type=float, default=1.0)
    p.add_argument("--component", choices=["X", "Y", "Z", "I"])
    p.add_argument("--imin", type=float, default=0.0)
    p.add_argument("--imax", type=float, default=1.0)
    p.add_argument("-q", "--high-quality", action="store_true")
    p.add_argument("-t", "--thumbnail", action="store_true")
    p = command("ncut", cmd_ncut, ("-i",))
    p.add_argument("clusterings", nargs="+")
    command("abc-out", cmd_abc_out).add_argument("-hdfs", action="store_true", help="a folder of files instead of one")
    command("check", cmd_check, ())
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(format="%(message)s")
    logging.getLogger("graphflow").setLevel(logging.INFO)
    a.run(spark or session(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
