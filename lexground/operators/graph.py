"""Entities, relations and the graph they make; neighbourhoods and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entities import article_refs, case_refs, close_in_text, concepts, entity_type, part_refs, section_refs

KINDS = {"articles": article_refs, "sections": section_refs, "parts": part_refs, "cases": case_refs, "concepts": concepts}


def with_entities(chunks: DataFrame) -> DataFrame:
    """Adds an array per kind and ``related``, the pairs of articles that are close in the text, ordered by name: all that the graph
    needs of a content.  The generator makes them attributes, computed once however often they are used."""
    found = F.struct(*[f(F.col("content")).alias(name) for name, f in KINDS.items()])
    rows = chunks.select("*", F.explode(F.array(found)).alias("found")).select(*chunks.columns, "found.*")
    # pairs are made inside the row, so no self-join is needed, and the chunk is read once
    ordered = F.array_sort("articles")
    close = F.transform(ordered, lambda a: F.transform(F.filter(ordered, lambda b: (b > a) & close_in_text(F.col("content"), a, b)), lambda b: _relation(a, "related_to", b)))
    return rows.withColumn("related", F.flatten(close))


def entities(found: DataFrame) -> DataFrame:
    return found.select(F.explode(F.concat(*KINDS)).alias("entity")).distinct()


def _relation(src, kind: str, dst):
    return F.struct(src.alias("src"), F.lit(kind).alias("relationship_type"), dst.alias("dst"))


def relations(found: DataFrame) -> DataFrame:
    """doc_id, pos, src, relationship_type, dst; pairs of articles are ordered by name."""
    own = F.concat(F.lit("Article_"), "article")

    def of(kind: str, column: str):
        return F.transform(column, lambda x: _relation(own, kind, x))

    of_article = F.concat(of("discusses", "concepts"), of("interpreted_by", "cases"), of("refers_to", "sections"))
    none = F.filter(of_article, lambda x: F.lit(False))
    rows = found.select("doc_id", "pos", F.explode(F.concat(F.when(F.col("article").isNotNull(), of_article).otherwise(none), "related")).alias("r"))
    return rows.select("doc_id", "pos", "r.*")


def nodes(found_entities: DataFrame) -> DataFrame:
    return found_entities.select("entity", entity_type("entity").alias("entity_type"), F.replace("entity", F.lit("_"), F.lit(" ")).alias("label"))


def edges(rels: DataFrame, node_table: DataFrame) -> DataFrame:
    """src, dst, relationship_type, weight; both ends are nodes.  Aggregated first, so the joins see distinct edges."""
    rows = rels.groupBy("src", "dst", "relationship_type").agg(F.count(F.lit(1)).alias("weight"))
    for end in ("src", "dst"):
        rows = rows.join(node_table.select(F.col("entity").alias(end)), end, "left_semi")
    return rows.select("src", "dst", "relationship_type", "weight")


def entity_chunks(found: DataFrame, node_table: DataFrame) -> DataFrame:
    """entity, doc_id, pos, chunk_id, own: the own-article link is not merged with the mention of the same article."""
    own = found.filter("article is not null").select(F.concat(F.lit("Article_"), "article").alias("entity"), "doc_id", "pos", "chunk_id", F.lit(True).alias("own"))
    # a mention is not added where the own link is there already; only articles have one, nearly always in the same row
    mention = lambda names: found.select(F.explode(names).alias("entity"), "doc_id", "pos", "chunk_id", F.lit(False).alias("own"))
    other = mention(F.filter("articles", lambda x: ~x.eqNullSafe(F.concat(F.lit("Article_"), "article"))))
    named = mention(F.concat("sections", "concepts")).unionByName(other.join(own.select("entity", "doc_id", "pos"), ["entity", "doc_id", "pos"], "left_anti"))
    return own.unionByName(named).join(node_table.select("entity"), "entity", "left_semi")


def graph_stats(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """One row: counts by type, distinct relation types, average degree."""
    n = node_table.agg(F.count(F.lit(1)).alias("nodes"), *[F.count_if(F.col("entity_type") == t).alias(f"{t}_nodes") for t in ("article", "section", "part", "case", "concept")])
    e = edge_table.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total_weight"), F.array_join(F.array_sort(F.collect_set("relationship_type")), ",").alias("relationship_types"))
    degree = F.when(F.col("nodes") > 0, F.round(2 * F.col("edges") / F.col("nodes"), 4)).otherwise(0.0)
    return n.withColumn("one", F.lit(1)).join(e.withColumn("one", F.lit(1)), "one").drop("one").withColumn("avg_degree", degree)  # a row each


def neighbours(edge_table: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """seed, entity within depth + 1 undirected hops, the seed too if it has a neighbour.  ``seeds``: seed."""
    links = edge_table.select("src", "dst").union(edge_table.select("dst", "src")).distinct()
    front = seeds.select("seed", F.col("seed").alias("entity")).distinct()
    seen = None
    for _ in range(depth + 1):
        front = front.join(links, front["entity"] == links["src"]).select("seed", F.col("dst").alias("entity")).distinct()
        if seen is not None:  # a node's own neighbours are looked up once for a seed
            front = front.join(seen, ["seed", "entity"], "left_anti")
        seen = front if seen is None else seen.union(front)
    return seen


def directed_distances(edge_table: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """seed, entity, graph_distance: directed hops, infinite where no path (of up to ``most``, if given) leads there.

    Only a hop's new nodes are joined with the edges; every hop is written out, and an empty one ends the search."""
    links = edge_table.select("src", "dst").distinct().checkpoint()
    front = pairs.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("d")).checkpoint()
    reached, hop = front, 0
    while most is None or hop < most:
        hop += 1
        new = front.join(links, front["node"] == links["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = new.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("d", F.lit(hop)).checkpoint()
        if front.isEmpty():
            break
        reached = reached.union(front)
    found = reached.select("seed", F.col("node").alias("entity"), F.col("d").cast("double").alias("d"))
    return pairs.join(found, ["seed", "entity"], "left").select("seed", "entity", F.coalesce("d", F.lit(float("inf"))).alias("graph_distance"))


def stats_report(stats: DataFrame) -> DataFrame:
    """line: the statistics as lines to print."""
    types = ("article", "section", "part", "case", "concept")
    lines = [F.concat(F.lit("Nodes: "), "nodes"), F.concat(F.lit("Edges: "), "edges"), *[F.concat(F.lit(f"  {t}: "), f"{t}_nodes") for t in types]]
    lines += [F.concat(F.lit("Relationship types: "), "relationship_types"), F.concat(F.lit("Average degree: "), F.format_number("avg_degree", 2))]
    return stats.select(F.explode(F.array(*lines)).alias("line"))


def nearest(edge_table: DataFrame, seeds: DataFrame, depth: int = 1, top_k: int = 5) -> DataFrame:
    """query_id, entity, graph_distance of the top_k nearest articles near the seeds; the first seed that reaches one sets its
    distance.  ``seeds``: query_id, seed, seed_rank."""
    distinct = seeds.select("seed").distinct()
    near = neighbours(edge_table, distinct, depth).filter(F.col("entity").startswith("Article_")).checkpoint()
    far = directed_distances(edge_table, near)
    first = Window.partitionBy("query_id", "entity").orderBy("seed_rank")
    hits = seeds.join(far, "seed").withColumn("r", F.row_number().over(first)).filter("r = 1")
    best = Window.partitionBy("query_id").orderBy("graph_distance", "seed_rank", "entity")
    kept = hits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top_k)
    return kept.select("query_id", "entity", "graph_distance")


#: Rows up to which a side of a join goes to every task.
SENT = 500_000


def sent(rows: DataFrame) -> DataFrame:
    """``rows``, which are written out, for a join with a table that is not to be shuffled for them."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows


def graph_search(edge_table: DataFrame, links: DataFrame, seeds: DataFrame, depth: int = 1, top_k: int = 5) -> DataFrame:
    """query_id, entity, chunk_id, graph_distance: all chunks of the ``nearest`` articles.  ``links``: entity, chunk_id."""
    return links.join(sent(nearest(edge_table, seeds, depth, top_k).checkpoint()), "entity").select("query_id", "entity", "chunk_id", "graph_distance")


def telling_hits(near: DataFrame, links: DataFrame, vector_hits: DataFrame, top_k: int = 5) -> DataFrame:
    """Those rows of ``graph_search`` from which ``fuse`` finds the same top_k: all of chunks that are a vector hit of any query, and
    of the others the first top_k of each set of links.  ``near``: what ``nearest`` gives; both it and the hits are written out.

    Chunks linked to the same articles weigh the same in every query and then rank by chunk_id, so the rows follow the sets of
    links instead of queries times chunks."""
    named = links.join(sent(near.select("entity").distinct()), "entity", "left_semi")
    of_chunk = named.groupBy("chunk_id").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    of_chunk = of_chunk.join(sent(vector_hits.select("chunk_id").distinct()).withColumn("hit", F.col("chunk_id")), "chunk_id", "left")
    alike = Window.partitionBy("entities", "hit").orderBy("chunk_id")  # a hit is alone in its set
    few = of_chunk.withColumn("r", F.row_number().over(alike)).filter(F.col("r") <= top_k)
    few = few.select("chunk_id", F.explode("entities").alias("entity"))
    return few.join(sent(near), "entity").select("query_id", "entity", "chunk_id", "graph_distance")
