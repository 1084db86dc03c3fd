import numpy as np

from graphflow import cli
from graphflow.sources import abc, images
from graphflow.streaming import cuts
from test_images import image, mat_file
from model import triangles


def test_edge_list_to_clusters_and_cuts(spark, tmp_path, capsys):
    p = lambda name: str(tmp_path / name)
    (tmp_path / "edges.abc").write_text("".join(f"{c}\t{r}\t{v}\n" for c, r, v in triangles()))
    run = lambda *a: cli.main(list(a), spark)
    run("abc", "-i", p("edges.abc"), "-o", p("m"), "-nsub", "4")
    run("transpose", "-i", p("m"), "-o", p("t"))
    assert spark.read.parquet(p("t")).count() == 20
    run("step", "-i", p("m"), "-o", p("s"), "-P", "10000")
    assert abc.load_matrix(spark, p("s"))[0].count() == 28
    run("mcl", "-i", p("m"), "-o", p("c"), "-c", p("counters"), "-l", p("log"))
    assert sorted(r[0] for r in spark.read.text(p("c")).collect()) == ["0\t1\t2", "3\t4\t5"]
    rows = spark.read.option("header", True).csv(p("counters"))
    assert rows.columns == ["iteration", "job", "group", "counter", "value"] and rows.where("counter = 'out_nnz'").count() == 14
    assert "chaos" in (tmp_path / "log").read_text()
    run("rmcl", "-i", p("edges.abc"), "--abc", "-o", p("c2"), "--force-iter", "5")
    run("bmcl", "-i", p("m"), "-o", p("c3"), "-b", "0.5", "--max-iter", "20")
    run("abc-out", "-i", p("m"), "-o", p("out"))
    assert spark.read.text(p("out")).count() == 20
    capsys.readouterr()
    run("ncut", "-i", p("edges.abc"), p("c"), p("c"))
    assert capsys.readouterr().out.count("clusters=2\tncut=0.026316\tavg=0.013158") == 2
    run("check")
    assert "True" in capsys.readouterr().out


def test_images_to_outlines(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    run = lambda *a: cli.main(list(a), spark)
    a = image(6, 5)
    a[:, :3] = 20
    a[:, 3:] = 200
    (tmp_path / "a.png").write_bytes(images.encode_png(a))
    run("load-img", "-i", p("a.png"), "-o", p("g"), "-r", "1.5", "-sX", "4", "-sF", "100")
    run("load-img", "-i", p("a.png"), "-o", p("lab.abc"), "-cielab")
    run("load-img", "-i", p("a.png"), "-o", p("x"), "-a")
    run("mcl", "-i", p("g/matrix.abc"), "--abc", "-o", p("c"))
    clusters = abc.read_clusters(spark, p("c"))
    halves = [{r["cluster"] for r in clusters.where(f).collect()} for f in ("node < 15", "node >= 15")]
    assert clusters.count() == 30 and not halves[0] & halves[1]
    run("result", "-i", p("a.png"), "-o", p("r"), "-c", p("c"), "-q")
    made = images.decode_png(bytes(spark.read.parquet(p("r")).first()["content"]))
    assert made.shape == (10, 12, 3) and (made[:, 5:7] == 255).all()
    rng = np.random.default_rng(1)
    (tmp_path / "f.mat").write_bytes(mat_file({c: rng.random((5, 6)) for c in "XYZI"}))
    run("load-mat", "-i", p("f.mat"), "-o", p("tof"), "-r", "1")
    assert abc.read_abc(spark, p("tof/matrix.abc")).count() == 30 + 2 * (5 * 5 + 4 * 6)
    run("result", "-i", p("f.mat"), "-o", p("r2"), "-c", p("c"), "--component", "Z", "-t")
    assert spark.read.parquet(p("r2")).count() == 2


def test_cuts_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    from graphflow.operators import quality
    from graphflow.schema import ABC

    edges = [(c, r, float(v)) for c, r, v in triangles()]
    for i in range(5):
        spark.createDataFrame(edges[i::5], ABC).coalesce(1).write.mode("append").option("sep", "\t").csv(str(tmp_path / "in"))
    many = spark.createDataFrame([(0, n, n // 3) for n in range(6)] + [(1, n, n) for n in range(6)], "clustering int, node long, cluster long")
    query = cuts.start(cuts.stream_abc(spark, str(tmp_path / "in"), 2), many, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = sorted((r["clustering"], r["clusters"], round(r["ncut"], 9)) for r in spark.read.parquet(str(tmp_path / "out/ncut")).collect())
    want = sorted((r["clustering"], r["clusters"], round(r["ncut"], 9)) for r in quality.ncut_many(spark.createDataFrame(edges, ABC), many).collect())
    assert got == want and want[0] == (0, 2, 0.026315789)
