"""The pipeline's stages against brute force, each on its own input."""

import os
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from graphflow.llm import mixing, packing, quality, queries, simhash
from test_mixing import edf
from test_packing import check as check_packing
from test_simhash import slow_similar

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]
    held = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        held[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    verdicts = quality.assess(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("kept").collect()
    assert Counter(r["doc_id"] for r in verdicts) == Counter(d for d, _ in rows(held["quality"]))

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/quality/*.parquet'")
    want = [(r[0], r[4]) for r in con.execute(queries.LINES_SQL).fetchall() if not r[2] or r[2] < r[1]]
    assert Counter(rows(held["lines"])) == Counter(want)
    assert all(r["n_chars"] == len(r["text"]) for r in held["lines"].collect())

    firsts = set(slow_similar(rows(held["lines"]), 0.8))
    assert Counter(rows(held["near_duplicates"])) == Counter((d, t) for d, t in rows(held["lines"]) if d in firsts)
    assert simhash.near_duplicates(held["near_duplicates"]).where("doc_id <> component_id").isEmpty()

    assert Counter(map(tuple, held["mixing"].collect())) == Counter(map(tuple, held["near_duplicates"].collect()))
    counts = Counter(r["source"] for r in held["mixing"].collect())
    slots = edf({s: -(-n // 8) for s, n in counts.items()}, {s: n**0.5 for s, n in counts.items()}, 1000)
    order = [r["source"] for p in sorted((tmp_path / "mixing").glob("*.parquet")) for r in spark.read.parquet(str(p)).collect()]
    by_slot = [s for (s, _), _ in sorted(slots.items(), key=lambda x: x[1])]
    at, seen = 0, Counter()
    for s in by_slot:
        n = min(8, counts[s] - seen[s])
        assert order[at : at + n] == [s] * n
        at, seen[s] = at + n, seen[s] + n

    t = Tokenizer.from_file(queries.tokenizer_path())
    check_packing(held["packing"].collect(), rows(held["mixing"]), t, packing.ROOM)

    run = corpus_pipeline.run(spark, SF)
    key = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(run) == key(held["packing"])


def test_sequences_follow_the_mix(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "SPAN_ROWS", 60)
    rows = [(i, " ".join(f"w{i * k % 97}" for k in range(120)), "a" if i < 240 else "b" if i < 360 else "c") for i in range(400)]
    docs = make(rows, "doc_id long, text string, source string")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        corpus_pipeline.source_mix(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    got = corpus_pipeline.best_fit(spark, spark.read.parquet(str(tmp_path / "mixed")), SF).collect()
    slots = {r["doc_id"]: r["slot"] for r in mixing.mix(docs).collect()}
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"] >> 32, []).append(slots[r["doc_id"]])
    order = [spans[k] for k in sorted(spans)]
    assert len(order) >= 4 and sum(map(len, order)) == len(rows)
    assert all(max(x) <= min(y) for x, y in zip(order, order[1:], strict=False))


def test_rest_works_without_this_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "graphflow"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "graphflow/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mcl_k3' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)


def test_empty_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, none, SF).count() == 0
    assert np.isfinite(corpus_pipeline.quality_rules(spark, none, SF).count())
