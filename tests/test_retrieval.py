"""Hand-computed literals, and the fast oracles at the smallest scale."""

import math

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexground.functions import entities as E
from lexground.functions import text as T
from lexground.operators import chunking, graph, search, spans
from lexground.plans import oracles, queries

from .conftest import DATA


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, text, want",
    [
        (E.article_refs, "Article 21A Art. 5 Part 7 art 9", ["Article_21A", "Article_5", "Article_7", "Article_9"]),
        (E.part_refs, "take part in it; part is", ["Part_in", "Part_is"]),
        (E.case_refs, "held in Maneka Gandhi v. Union of India (1978) and A vs B, x", ["held in Maneka Gandhi_v_Union of India"]),
        (E.concepts, "Personal Liberty and the State", ["liberty", "personal_liberty", "state"]),
        (T.remove_footers, "a\n12\nb\n\n 7 \n\nc 5\n9", "a\nb\nc 5"),
        (T.clean_title, " Of rights.,", "Of rights."),
        (T.clean_title, "abc.", "Unknown"),
        (T.document_title, "THE INDIAN  PENAL CODE, 1860\nx", "THE INDIAN PENAL CODE, 1860"),
        (T.token_count, " a  b\nc ", 3),
    ],
)
def test_functions(spark, f, text, want):
    assert one(spark, f, text) == want


def test_spans(spark):
    assert len(one(spark, spans.spans_of, "a b c d e f g")) == 10
    assert one(spark, spans.spans_of, "a b c d") == ["a b c d"]
    assert one(spark, spans.spans_of, "") == [""]
    assert one(spark, spans.is_generic, "according to the act")
    rows = spark.createDataFrame([(0.65,), (0.40,), (0.39999,)], "c double").select(spans.status(F.col("c")).alias("s"))
    assert [r["s"] for r in rows.collect()] == ["supported", "uncertain", "hallucinated"]


def test_spans_against_a_plain_comparison(spark):
    """Dimensions travel with the spans; texts may hold what marks them, and sentences be long."""
    import random
    import time

    from lexground.functions import vectors as V

    r = random.Random(11)
    some = ["state", "State", "life", "the", "provided", "based", "on", "\x01", "a\x0141", "ΣΑΣ", "İx", "1", "end.", "ask?", "\t", "\n", "life", "equal"]
    text = lambda n: " ".join(r.choices(some, k=r.randint(0, n)))
    rows = [(i, text(30), text(40)) for i in range(60)] + [(60, None, "life"), (61, "life and state here", None), (62, "", ""), (63, "life life life life", "life")]
    answers = spark.createDataFrame(rows, "answer_id long, answer string, context string")
    plain = answers.withColumn("dense", V.hashed_embedding(F.coalesce("context", F.lit("")))).select("answer_id", "dense", F.explode(spans.spans_of(F.col("answer"))).alias("span"))
    plain = plain.filter(~spans.is_generic(F.col("span"))).withColumn("c", V.sparse_cosine(V.word_dimensions("span"), F.col("dense"), V.norm("dense")))
    want = plain.select("answer_id", "span", F.round("c", 4).alias("confidence"), spans.status(F.round("c", 9)).alias("status")).collect()
    assert len(want) > 1000 and sorted(map(tuple, want)) == sorted(map(tuple, spans.detect(answers).collect()))
    began = time.time()
    n = 12_000
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i)), " ").alias("answer"))
    assert long.select(F.size(spans.spans_of(F.col("answer")))).first()[0] == 4 * n - 18
    assert time.time() - began < 15  # each of its 48,000 windows took another split of the sentence


def test_scores(spark):
    answers = spark.createDataFrame([(1,), (2,)], "answer_id long")
    found = spark.createDataFrame([(1, "a", 0.8, "supported"), (1, "b", 0.5, "uncertain"), (1, "c", 0.1, "hallucinated"), (1, "d", 0.7, "supported")], "answer_id long, span string, confidence double, status string")
    got = {r["answer_id"]: tuple(r)[1:] for r in spans.faithfulness(answers, found).collect()}
    assert got == {1: (0.5, 0.75, 0.5, 0.575), 2: (0.0, 0.0, 0.0, 0.0)}


def test_fusion(spark):
    hits = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "e", 2)], "query_id long, chunk_id string, rank int")
    links = [(1, "a", 0.0), (1, "b", math.inf), (1, "c", 1.0), (1, "d", 1.0), (1, "d", 1.0)]
    graph_hits = spark.createDataFrame(links, "query_id long, chunk_id string, graph_distance double")
    got = {r["chunk_id"]: r["final_score"] for r in search.fuse(hits, graph_hits, 5).collect()}
    assert got == {"a": 1.0, "b": 0.56, "e": 0.6, "c": 0.25, "d": 0.15}


def test_neighbours_and_distances(spark):
    edges = spark.createDataFrame([("A", "c"), ("B", "c"), ("B", "d")], "src string, dst string")
    near = graph.neighbours(edges, spark.createDataFrame([("A",)], "seed string"), 1)
    assert {r["entity"] for r in near.collect()} == {"A", "c", "B"}
    queries.from_checkpoint(spark)
    far = {r["entity"]: r["graph_distance"] for r in graph.directed_distances(edges, near, 4).collect()}
    assert far == {"A": 0.0, "c": 1.0, "B": math.inf}


def test_distances_of_a_long_chain(spark):
    queries.from_checkpoint(spark)
    edges = spark.createDataFrame([(f"Article_{i}", f"Article_{i + 1}") for i in range(30)], "src string, dst string")
    pairs = spark.createDataFrame([("Article_0", f"Article_{i}") for i in range(31)] + [("Article_30", "Article_0")], "seed string, entity string")
    got = {(r["seed"], r["entity"]): r["graph_distance"] for r in graph.directed_distances(edges, pairs).collect()}
    assert got == {("Article_0", f"Article_{i}"): float(i) for i in range(31)} | {("Article_30", "Article_0"): math.inf}


def test_chunking_and_relations(spark):
    body = " ".join(["word"] * 60)
    docs = spark.createDataFrame([(1, f"1. Equality.\n{body} Article 14 and Article 15 state\n2. Liberty.\n{body}")], "doc_id long, text string")
    chunks = chunking.article_chunks(docs)
    assert [(r["article"], r["title"]) for r in chunks.orderBy("pos").collect()] == [("1", "Equality"), ("2", "Liberty")]
    found = graph.with_entities(chunks.withColumn("chunk_id", F.concat(F.lit("article_"), "article")))
    rels = {tuple(r)[2:] for r in graph.relations(found).collect()}
    assert ("Article_14", "related_to", "Article_15") in rels and ("Article_1", "discusses", "state") in rels


def test_patterns_match_the_same(spark):
    """The article pattern by lines, and concepts and cases searched for in two steps, against the plain patterns."""
    import random

    r = random.Random(7)
    parts = ["\n", "\n\n", " ", "1", "12A", ".", "—", "-", "PART IV", "part x", "Title", "life", "State", "personal liberty", "PERSONAL LIBERTY", "states", " v. ", " vs ", "Alpha Beta", "(", ",", "\r", "\t", "x"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(4000)]
    assert len(chunking.ARTICLE_BY_LINES) and any("\n1." in t for t in texts)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.array_compact(F.array(*[F.when(F.col("t").rlike(rf"(?i)\b{k}\b"), F.lit(k.replace(" ", "_"))) for k in E.CONCEPTS]))
    pairs = F.arrays_zip(F.regexp_extract_all("t", F.lit(E.CASE), 1).alias("a"), F.regexp_extract_all("t", F.lit(E.CASE), 2).alias("b"))
    kept = F.filter(pairs, lambda p: (F.length(p["a"]) > 3) & (F.length(p["b"]) > 3))
    cases = F.array_distinct(F.transform(kept, lambda p: F.concat(T.strip(p["a"]), F.lit("_v_"), T.strip(p["b"]))))
    articles = [F.regexp_extract_all("t", F.lit(p), k) for k in (0, 1, 2, 3) for p in (chunking.ARTICLE, chunking.ARTICLE_BY_LINES)]
    for row in rows.select(*articles, plain, E.concepts("t"), cases, E.case_refs(F.col("t"))).collect():
        assert row[0::2] == row[1::2]


def test_graph_needs_no_content(spark):
    """The graph is made of what is extracted, so that no content is written out for it; own links also of repeated documents."""
    rows = [(1, 0, "1", "a", "Article 1 and Article 2 on life"), (1, 0, "2", "b", "Article 1 and Section 3"), (1, 1, "2", "c", "Article 2"), (2, 0, None, "d", "Article 1 of equality, Article 1")]
    found = graph.with_entities(spark.createDataFrame(rows, "doc_id long, pos int, article string, chunk_id string, content string")).drop("content")
    assert ("Article_1", "related_to", "Article_2") in {tuple(r)[2:] for r in graph.relations(found).collect()}
    known = graph.nodes(graph.entities(found))
    assert sorted((r["entity"], r["chunk_id"], r["own"]) for r in graph.entity_chunks(found, known).collect()) == [
        ("Article_1", "a", True), ("Article_1", "d", False), ("Article_2", "b", True), ("Article_2", "c", True), ("Section_3", "b", False), ("equality", "d", False), ("life", "a", False),
    ]


@pytest.mark.parametrize("name", ["vector_topk", "chunk_report", "recursive_chunks", "clean_raw_text", "article_refs", "graph_neighbors", "centroid_mean_pool", "hybrid_chunk", "text_embedding", "store_search", "fused_retrieval", "process_query", "answer_report"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(oracles.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    names = sorted(want.columns)
    rows = lambda d: sorted(tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r) for r in d[names].itertuples(index=False))
    assert rows(want) == rows(got)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_search_keeps_the_best_of_a_task(spark):
    """Only a task's best rows are shuffled, and queries in several blocks give the same hits."""
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows, asked = e.select(F.col("vec_id").alias("id"), "embedding"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = search.vector_search(rows, asked, 5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    held, search.BLOCK_BYTES = search.BLOCK_BYTES, 4000
    many = search.vector_search(rows, asked, 5)
    search.BLOCK_BYTES = held
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, hits.collect()))
    assert search.vector_search(rows, asked.limit(0), 5).count() == 0


def test_search_multiplies_blocks(spark):
    """No join makes the pairs; ties, zero vectors, and vectors that only a comparison can judge rank as they do one by one."""
    import random

    r = random.Random(3)
    some = [[r.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    vectors = [some[i % 40] if i % 3 else [r.gauss(0, 1) for _ in range(4)] for i in range(900)] + [[0.0] * 4] * 9 + [[2 * x for x in some[1]]] * 9
    odd = [None, [1.0, None, 0.0, 0.0], [1.0], [math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0], [1e200, 0.0, 0.0, 0.0], []]
    table = lambda vs, key: spark.createDataFrame(list(enumerate(vs)), f"{key} long, embedding array<double>")
    for rows, asked in ((vectors, vectors[:50]), (vectors, [[0.0] * 4] + odd), (vectors[:30] + odd + vectors[900:], vectors[:20] + odd + [[0.0] * 4]), (odd, vectors[:3])):
        stored, queries_ = table(rows, "id").withColumn("id", F.concat(F.lit("r"), "id")), table(asked, "query_id")
        hits = search.vector_search(stored, queries_, 5)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        if asked == vectors[:50]:
            assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
        pairs = search._compared(stored, queries_, 4)
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
        want = pairs.withColumn("rank", F.row_number().over(order) - 1).filter("rank < 5").select("query_id", "id", "rank", F.round("similarity", 4))
        assert sorted(map(str, map(tuple, hits.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_fusion_of_telling_hits(spark):
    """Of chunks with the same links only the first few and the vector hits are joined with queries; the fused rows are the same."""
    import random

    r = random.Random(5)
    names = [f"Article_{i}" for i in range(6)]
    links = [(e, f"c{c:04d}") for c in range(3000) for e in r.choices(names, k=r.randint(1, 3))]
    near = [(q, e, r.choice([0.0, 1.0, 2.0, math.inf])) for q in range(12) for e in r.sample(names, 3)]
    hits = [(q, f"c{c:04d}", i) for q in range(14) for i, c in enumerate(r.sample(range(3200), 3) + r.sample(range(5), 2))]
    links = spark.createDataFrame(links, "entity string, chunk_id string")
    near = spark.createDataFrame(near, "query_id long, entity string, graph_distance double")
    hits = spark.createDataFrame(hits, "query_id long, chunk_id string, rank int")
    every, few = near.join(links, "entity"), graph.telling_hits(near, links, hits, 5)
    assert few.count() < every.count() / 4
    assert sorted(map(tuple, search.fuse(hits, few, 5).collect())) == sorted(map(tuple, search.fuse(hits, every, 5).collect()))


def test_store(spark, tmp_path):
    from lexground.operators import embedding
    from lexground.sources.store import VectorStore

    chunks = spark.createDataFrame([(1, 0, "a", "the cat sat", 3), (1, 1, "b", "a dog ran", 3), (2, 0, "c", "", 0)], "doc_id long, pos int, chunk_id string, content string, token_count int")
    vectors = embedding.embed(chunks, ["doc_id", "pos"])
    store = VectorStore(spark, str(tmp_path / "s"), fresh_start=True)
    store.add_chunks(chunks, vectors)
    asked = embedding.embed(spark.createDataFrame([(7, "dog ran")], "query_id long, query string"), ["query_id"], "query")
    hit = store.search(asked, 1).first()
    assert (hit["id"], hit["content"], hit["token_count"]) == ("b_1_1", "a dog ran", "3") and store.stats()["count"] == 3
    store.add_chunks(chunks, vectors)
    assert store.stats()["count"] == 6
    other = vectors.withColumn("doc_id", F.col("doc_id") + 1)
    for wrong in (other, vectors.limit(2), vectors.unionByName(vectors.limit(1)), vectors.filter("doc_id = 2").unionByName(vectors.filter("doc_id = 2")).unionByName(vectors.filter("pos = 1"))):
        with pytest.raises(ValueError):
            store.add_chunks(chunks, wrong)
    VectorStore(spark, str(tmp_path / "s"), fresh_start=True).add_chunks(chunks, vectors)
    assert store.stats()["count"] == 3


def test_embedding(spark):
    from lexground.operators import embedding

    assert embedding.dimension(spark) == 64 and embedding.dimension(spark, dimensions=8) == 8
    with pytest.raises(ValueError):
        embedding.embed_one(spark, " \n")
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "x")], "id int, content string")
    got = {r["id"]: list(r["embedding"]) for r in embedding.embed(rows, ["id"], model=lambda texts: [[3.0, 4.0] for _ in texts]).collect()}
    assert got[2] == [0.0, 0.0] and got[1] == got[3] == pytest.approx([0.6, 0.8])
    tokens = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 0, [9.0, 9.0]), (1, 1, [3.0, 4.0]), (2, 0, [5.0, 5.0])], "text int, mask int, embedding array<double>")
    assert {r["text"]: r["embedding"] for r in embedding.mean_pool(tokens, ["text"], mask="mask").collect()} == {1: [2.0, 3.0], 2: [0.0, 0.0]}


def test_session(spark, tmp_path):
    """Index, graph and questions to scores, with a graph and without."""
    from lexground.config import Config
    from lexground.plans.session import Session

    queries.from_checkpoint(spark)
    body = "All persons have the right to life and personal liberty " * 8
    text = "\n".join(f"{i}. Title {i}.\n{body} See Article {i % 7 + 1} and Article {i % 5 + 1} on equality number{i}" for i in range(1, 10))
    docs = spark.createDataFrame([(1, f"THE TEST ACT, 1950\n{text}")], "doc_id long, text string")
    s = Session(spark, Config(store_path=str(tmp_path / "index"), top_k=3), fresh_start=True)
    assert s.build_index(docs)["count"] == 9
    trial = s.trial().collect()
    assert len(trial) == 12 and {r["hierarchy_level"] for r in trial} == {"unknown"}
    asked = spark.createDataFrame([(1, "What of number4 and equality?"), (2, "life")], "query_id long, query string")
    plain = s.ask(asked)
    assert plain["scores"].count() == 2 and {r["source"] for r in plain["hits"].collect()} == {"vector"}
    s.build_graph(docs)
    full = s.ask(asked)
    hits = full["hits"].collect()
    assert any(r["graph_weight"] > 0 for r in hits) and all(r["content"] for r in hits) and full["answers"].count() == 2
    for k in (0, 11):
        with pytest.raises(ValueError):
            Config(top_k=k)


def test_configuration(tmp_path, monkeypatch):
    from lexground import config

    (tmp_path / "c.yaml").write_text("retrieval:\n  top_k: 7\nstore_path: x\nunknown: 1\n")
    found = config.load_config(str(tmp_path / "c.yaml"))
    assert (found.top_k, found.store_path, found.max_chunk_size) == (7, "x", 512)
    monkeypatch.setenv("LEXGROUND_TEST", "v")
    assert config.get_env("LEXGROUND_TEST") == "v" and config.get_env("LEXGROUND_ABSENT", "d") == "d"
    with pytest.raises(EnvironmentError):
        config.get_env("LEXGROUND_ABSENT")
    config.ensure_dirs(str(tmp_path / "a" / "b"))
    assert (tmp_path / "a" / "b").is_dir()


def test_spread(spark, tmp_path):
    from lexground.sources.documents import spread

    held = lambda rows: rows.select(F.spark_partition_id()).distinct().count()
    for n in (1, 40):  # a file of one row group is dealt out, forty files are not
        spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t")).coalesce(1).repartition(n).write.parquet(f"{tmp_path}/{n}")
        rows = spark.read.parquet(f"{tmp_path}/{n}")
        dealt = spread(rows)
        assert held(dealt) == (6 if n == 1 else held(rows)) and sorted(r["id"] for r in dealt.select("id").collect()) == list(range(5000))
    assert ("Exchange" in dealt._jdf.queryExecution().executedPlan().toString()) is False
    pruned = spread(spark.read.parquet(f"{tmp_path}/1")).filter("id > 7").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in pruned and "GreaterThan(id,7)" in pruned
    assert spread(rows.filter("id < 0")).count() == 0


def test_files_and_stream(spark, tmp_path):
    from lexground.sources import documents
    from lexground.streaming.ingest import ingest_chunks

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo")
    assert [r["text"] for r in documents.read_text(spark, str(tmp_path / "t")).collect()] == ["one\ntwo"]
    (tmp_path / "t" / "b.pdf").write_bytes(b"p1|p2")
    pages = documents.read_pdf(spark, str(tmp_path / "t" / "b.pdf"), lambda b: b.decode().split("|"))
    assert [(r["page"], r["text"]) for r in pages.orderBy("page").collect()] == [(1, "p1"), (2, "p2")]
    assert documents.from_pages(pages).first()["text"] == "[PAGE_1]\np1\n[PAGE_2]\np2"
    text = "\n\n".join([" ".join(["word"] * 60)] * 2)
    for k in range(2):  # a second run takes only what is new
        spark.createDataFrame([(k, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/in/{k}")
        q = ingest_chunks(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/state")
        q.awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 2 * (k + 1)
