"""The pipeline's stages and run() against plain Python on a small fixture, and the registered queries on odd tables."""

import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lexground.llm import mixing, queries, quality, toxicity
from lexground.llm.tokens import WordEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies, near copies, junk, toxic ones, null and repeated ids, nulls in every column, and clashing names."""
    rng, place = random.Random(12), str(tmp_path_factory.mktemp("tables"))
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(500)]
    rows = [[i, " ".join(rng.choices(words, k=rng.randint(40, 120)) + (["vilest", "scum"] if i % 4 == 0 else [])), "en", f"s{i % 3}", i] for i in range(240)]
    clean = [r for r in rows if r[0] % 4]
    rows += [[1000 + k, clean[3][1], "en", "s0", 0] for k in range(5)]  # copies
    for k in range(6):  # near copies
        w = clean[7][1].split()
        w[k] = "edited"
        rows.append([2000 + k, " ".join(w), "en", "s1", 0])
    rows += [[clean[9][0], "vilest scum " * 12, "en", "s0", 0], [None, clean[11][1] + " end", "en", None, None], [None, None, None, None, None], [3000, "", "en", "s2", 0]]
    rows += [[3001, "one two three four five six " * 20, "de", "s2", 0], [3002, " ".join(rng.choices(words, k=9000)), "en", "s2", 0], clean[15][:], clean[15][:]]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("s"), "mix_rate": F.lit("m"), "kept": F.lit(3), "document": F.col("doc_id"), "grp": F.lit(None).cast("int")})
    d.coalesce(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place


def rows_of(df):
    return Counter(str(tuple(r)) for r in df.collect())


def test_stages(spark, tables, tmp_path):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    encoder = WordEncoder().tokenizer
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/{k}")
        out, before = spark.read.parquet(f"{tmp_path}/{k}"), docs.collect()
        after = out.collect()
        if k < 4:
            assert out.columns == docs.columns
        if name == "toxicity":
            model, weights = toxicity.train(docs, labels)
            z = {r["text"]: float(np.dot(weights, [*model.features(r["text"] or ""), 1.0])) for r in before}
            assert rows_of(out) == Counter(str(tuple(r)) for r in before if z[r["text"]] < 0)
            assert sum("vilest" in (r["text"] or "") for r in after) == 0 and len(after) > 150
        if name == "quality rules":
            verdict = {(r["doc_id"], r["n_words"], r["word_chars"]): r["kept"] for r in quality.judge(docs.drop("kept")).collect()}
            split = lambda t: [w for w in (t or "").split(" ") if w]
            assert rows_of(out) == Counter(str(tuple(r)) for r in before if verdict[r["doc_id"], len(split(r["text"])), sum(map(len, split(r["text"])))])
            assert all(len(split(r["text"])) >= 10 for r in after)
        if name == "near-dedup":
            shingles = [Counter(zip(*[(r["text"] or "").lower().split()[j:] for j in range(5)])) for r in before]
            group = list(range(len(before)))
            for i in range(len(before)):
                for j in range(i):
                    if (shingles[i] & shingles[j]).total() >= 0.8 * (shingles[i] | shingles[j]).total() and group[i] != group[j]:
                        old, new = group[i], group[j]
                        group = [new if g == old else g for g in group]
            assert len(after) == len(set(group)) < len(before)
            where = {str(tuple(r)): g for r, g in zip(before, group, strict=True)}
            assert sorted(where[str(tuple(r))] for r in after) == sorted(set(group))
        if name == "mixing":
            size = Counter()
            for r in before:
                size[r["source"]] += len(r["text"])
            rate = {s: n**0.5 / sum(x**0.5 for x in size.values()) * sum(size.values()) / n for s, n in size.items()}
            want = Counter()
            for r in before:
                from hashlib import md5
                from math import exp

                u = int(md5(f"{mixing.SEED}:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
                copies, p = 0, exp(-rate[r["source"]])
                cdf = p
                while cdf <= u:
                    copies += 1
                    p *= rate[r["source"]] / copies
                    cdf += p
                if copies:
                    want[str(tuple(r))] += copies
            assert rows_of(out) == want
        if name == "packing":
            pieces = Counter()
            for r in before:
                ids = [*encoder.encode(r["text"], add_special_tokens=False).ids, 1]
                for n, at in enumerate(range(0, len(ids), 4096)):
                    part = ids[at : at + 4096]
                    pieces[str((r["doc_id"], n, at, len(part), crc32(np.array(part, "<u4").tobytes())))] += 1
            assert rows_of(out.select("doc_id", "piece", "start", "length", "ids_crc32")) == pieces
        docs = out


def test_run(spark, tables, tmp_path):
    import os

    held = spark.sparkContext.getCheckpointDir()
    out = pipeline.run(spark, tables)
    n = out.count()
    assert n > 50 and out.filter("offset + length > 4096").count() == 0
    folders = [f for f in os.listdir((held or spark.sparkContext.getCheckpointDir()).removeprefix("file:")) if f.startswith("pipeline-")]
    assert folders  # of the last run only its rows stay
    newest = max((f"{held.removeprefix('file:')}/{f}" for f in folders), key=os.path.getmtime)
    assert [f for f in os.listdir(newest) if not f.startswith(".")] == ["4"]


def test_empty_tables(spark, tmp_path):
    place = str(tmp_path)
    for name, schema in {
        "documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string",
        "conversations": "conv_id long, turn long, role string, text string", "embeddings": "vec_id long, embedding array<float>, label int",
    }.items():
        spark.createDataFrame([], schema).write.parquet(f"{place}/{name}.parquet")
    for name, query in {**queries.QUERIES, "pipeline": pipeline.run}.items():
        assert query(spark, place).count() == (1 if name.startswith("op2") else 0), name


def test_tables_of_nulls(spark, tmp_path):
    """A row of nothing but nulls in every table, and two that are the same but for that."""
    place = str(tmp_path)
    docs = [(None, None, None, None, None), (1, "a word or two", "en", "s", 1), (1, "a word or two", "en", "s", 1)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(None, None, None), (1, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(None, None, None), (1, "http://h/x", "<p>t"), (1, "http://h/x", "<p>t")], "page_id long, url string, html string").write.parquet(f"{place}/pages.parquet")
    spark.createDataFrame([(None, None, None, None), (1, 0, "assistant", "t"), (1, 0, "assistant", "t")], "conv_id long, turn long, role string, text string").write.parquet(f"{place}/conversations.parquet")
    spark.createDataFrame([(None, None, None), (0, [1.0, 2.0], 1), (50, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{place}/embeddings.parquet")
    rows = {"op2": 3, "op6": None, "op7": 2, "op10": 2}
    for name, query in queries.QUERIES.items():
        n = query(spark, place).count()
        want = rows.get(name.split("_")[0], 3)
        assert want is None or n == want, (name, n)
    pipeline.run(spark, place).count()
