"""Queries of the knowledge graph and its communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.parsers import extraction_lines
from weft.operators import community, graph, retrieve
from weft.queries.base import ASKED, CORPUS, SPACE, asked, buckets_sql, corpus, cosine_sql, counts_sql, query, read, top_sql
from weft.streaming import ingest


def _name(x: str) -> str:
    return f"lower(regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g'))"


def extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations as extracted; exact copies of rows count once."""
    return read(spark, sf_dir, "entities").drop("extracted_at").distinct(), read(spark, sf_dir, "relations").distinct()


def canonical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entities, relations = extracted(spark, sf_dir)
    nodes = graph.canonical_entities(entities)
    return nodes, graph.canonical_relations(relations, nodes)


ENTITIES = f"""rawents AS (SELECT DISTINCT entity_id AS row_id, name, coalesce(type, '') AS type, coalesce(description, '') AS description, source_chunk_ids, coalesce(type, '') || ':' || {_name("name")} AS entity_id FROM entities WHERE coalesce({_name("name")}, '') <> ''),
heads AS (SELECT entity_id, type, arg_min(name, (row_id, name)) AS name FROM rawents GROUP BY ALL),
texts AS (SELECT entity_id, string_agg(description, '; ' ORDER BY f, description) AS description FROM (SELECT entity_id, description, min(row_id) AS f FROM rawents WHERE description <> '' GROUP BY ALL) GROUP BY entity_id),
sources AS (SELECT entity_id, list_sort(list(DISTINCT c)) AS source_chunk_ids FROM (SELECT entity_id, unnest(source_chunk_ids) AS c FROM rawents) WHERE c <> '' GROUP BY entity_id),
nodes AS (SELECT h.entity_id, h.name, h.type, coalesce(t.description, '') AS description, coalesce(s.source_chunk_ids, []) AS source_chunk_ids FROM heads h LEFT JOIN texts t USING (entity_id) LEFT JOIN sources s USING (entity_id))"""
RELATIONS = f"""rawrels AS (SELECT DISTINCT relation_id AS row_id, namespace, {_name("source")} AS s, {_name("target")} AS t, coalesce(relation, '') AS relation, coalesce(description, '') AS description, source_chunk_ids, CASE WHEN weight IS NULL OR isnan(weight) THEN 0 ELSE weight END AS weight FROM relations),
byname AS (SELECT {_name("name")} AS n, max(entity_id) AS id FROM nodes GROUP BY 1),
ends AS (SELECT r.*, a.id AS source, b.id AS target FROM rawrels r JOIN byname a ON a.n = r.s JOIN byname b ON b.n = r.t),
edges AS (SELECT source || '::' || relation || '::' || target AS relation_id, source, target, relation, arg_min(description, (row_id, description)) AS description, round(sum(weight), 6) AS weight, list_sort(list_distinct(flatten(list(source_chunk_ids)))) AS source_chunk_ids FROM ends GROUP BY source, target, relation)"""
GRAPH = f"{ENTITIES}, {RELATIONS}"


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("source_chunk_ids", F.array_join("source_chunk_ids", ","))


@query(f"WITH {ENTITIES} SELECT entity_id, name, type, description, array_to_string(source_chunk_ids, ',') AS source_chunk_ids FROM nodes")
def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(canonical(spark, sf_dir)[0])


@query(f"WITH {GRAPH} SELECT relation_id, source, target, relation, description, weight, array_to_string(source_chunk_ids, ',') AS source_chunk_ids FROM edges")
def canonical_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(canonical(spark, sf_dir)[1])


_TERMS = "terms AS (SELECT name, min(type) AS type FROM (SELECT DISTINCT name, type FROM entities WHERE lower(trim(type)) IN ('concept', 'location', 'place') AND coalesce(trim(name), '') <> '') GROUP BY name)"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "entities").where("lower(trim(type)) in ('concept', 'location', 'place') and coalesce(trim(name), '') <> ''").groupBy("name").agg(F.min("type").alias("type"))


@query(f"WITH {CORPUS}, {_TERMS} SELECT chunk_id, name, type FROM corpus JOIN terms ON contains(lower(content), lower(name))")
def gazetteer_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.gazetteer_entities(corpus(spark, sf_dir, "content"), _terms(spark, sf_dir))


@query(f"WITH {CORPUS}, {_TERMS}, found AS (SELECT chunk_id, name FROM corpus JOIN terms ON contains(lower(content), lower(name))) SELECT a.chunk_id, a.name AS source, b.name AS target, 'co-occurs' AS relation, 1.0 AS weight FROM found a JOIN found b ON a.chunk_id = b.chunk_id AND a.name < b.name")
def cooccur_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.co_occurrences(graph.gazetteer_entities(corpus(spark, sf_dir, "content"), _terms(spark, sf_dir)))


_MERGED = f"""{ENTITIES}, parts AS (SELECT *, row_id % 2 AS half FROM rawents),
named AS (SELECT entity_id, type, arg_min(name, (half, row_id, name)) AS name FROM parts GROUP BY ALL),
told AS (SELECT entity_id, string_agg(description, '; ' ORDER BY half, f, description) AS description FROM (SELECT entity_id, description, min(half) AS half, arg_min(row_id, (half, row_id)) AS f FROM parts WHERE description <> '' GROUP BY ALL) GROUP BY entity_id)"""


@query(f"WITH {_MERGED} SELECT n.entity_id, n.name, n.type, coalesce(t.description, '') AS description, array_to_string(coalesce(s.source_chunk_ids, []), ',') AS source_chunk_ids FROM named n LEFT JOIN told t USING (entity_id) LEFT JOIN sources s USING (entity_id)")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the even rows are stored, those of the odd rows arrive: the stored name stays, descriptions and sources unite."""
    rows, _ = extracted(spark, sf_dir)
    first, second = graph.canonical_entities(rows.where("entity_id % 2 = 0")), graph.canonical_entities(rows.where("entity_id % 2 = 1"))
    return graph.merge_entities(first, second).select("entity_id", "name", "type", "description", F.array_join(F.array_sort("source_chunk_ids"), ",").alias("source_chunk_ids"))


@query(f"""WITH {GRAPH}, relparts AS (SELECT *, row_id % 2 AS half, source || '::' || relation || '::' || target AS relation_id FROM ends),
sides AS (SELECT relation_id, half, arg_min(description, (row_id, description)) AS description, round(sum(weight), 6) AS weight FROM relparts GROUP BY ALL),
links AS (SELECT relation_id, list_sort(list(DISTINCT c)) AS cs FROM (SELECT relation_id, unnest(source_chunk_ids) AS c FROM relparts) WHERE c IS NOT NULL GROUP BY relation_id)
SELECT s.relation_id, coalesce(arg_min(description, half) FILTER (description <> ''), '') AS description, round(sum(weight), 6) AS weight, array_to_string(coalesce(any_value(l.cs), []), ',') AS source_chunk_ids FROM sides s LEFT JOIN links l USING (relation_id) GROUP BY s.relation_id""")
def relation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the even rows are stored, those of the odd rows arrive: weights add up, the stored description stays unless empty."""
    entities, relations = extracted(spark, sf_dir)
    nodes = graph.canonical_entities(entities)
    first, second = (graph.canonical_relations(relations.where(f"relation_id % 2 = {i}"), nodes) for i in (0, 1))
    return _joined(graph.merge_relations(first, second)).select("relation_id", "description", "weight", "source_chunk_ids")


@query(f"""WITH {GRAPH} SELECT kind, id, CAST(row_number() OVER (PARTITION BY kind ORDER BY id) AS INTEGER) AS place FROM (SELECT 'entity' AS kind, entity_id AS id FROM nodes UNION ALL SELECT 'relation', relation_id FROM edges)""")
def graph_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.snapshot(*canonical(spark, sf_dir))


@query(f"WITH {ENTITIES}, wanted AS (SELECT DISTINCT source AS name, {_name('source')} AS n FROM relations WHERE {_name('source')} <> '') SELECT w.name, e.entity_id, e.name AS entity_name FROM wanted w JOIN nodes e ON {_name('e.name')} = w.n")
def find_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that the sources of relations name."""
    return graph.find_entities(canonical(spark, sf_dir)[0], read(spark, sf_dir, "relations").select(F.col("source").alias("name")))


@query(f"""WITH {CORPUS}, {_TERMS}, after AS (SELECT * FROM corpus WHERE namespace <> 'handbook' OR chunk_id LIKE '%:0'),
found AS (SELECT DISTINCT chunk_id, type || ':' || {_name('name')} AS entity_id FROM after JOIN terms ON contains(lower(content), lower(name)))
SELECT entity_id, array_to_string(list_sort(list(chunk_id)), ',') AS source_chunk_ids FROM found GROUP BY entity_id""")
def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunks of the handbook are imported again in place of all its chunks: what only the others mention leaves the graph."""
    terms = _terms(spark, sf_dir)
    rows = corpus(spark, sf_dir, "content").withColumn("source_id", F.col("namespace"))
    none = "relation_id long, source string, target string, relation string, description string, weight double, source_chunk_ids array<string>"

    def extract(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = graph.gazetteer_entities(chunks, terms)
        return found.select(F.xxhash64("chunk_id", "name").alias("entity_id"), "name", "type", F.lit("").alias("description"), F.array("chunk_id").alias("source_chunk_ids")), spark.createDataFrame([], none)

    nodes, links = extract(rows)
    stored = graph.canonical_entities(nodes)
    arriving = rows.where("namespace = 'handbook' and chunk_id like '%:0'")
    after = ingest.import_graph(rows, arriving, stored, graph.canonical_relations(links, stored), extract)[1]
    return _joined(after.withColumn("source_chunk_ids", F.array_sort("source_chunk_ids"))).select("entity_id", "source_chunk_ids")


@query(f"""WITH {CORPUS}, {ENTITIES}, gone AS (SELECT chunk_id FROM corpus WHERE namespace = 'handbook'), kept AS (SELECT entity_id, list_sort(list_filter(source_chunk_ids, lambda c: c NOT IN (SELECT chunk_id FROM gone))) AS l FROM nodes)
SELECT n.entity_id, array_to_string(CASE WHEN len(n.source_chunk_ids) = 0 THEN n.source_chunk_ids ELSE k.l END, ',') AS source_chunk_ids FROM nodes n JOIN kept k USING (entity_id) WHERE len(k.l) > 0 OR len(n.source_chunk_ids) = 0""".replace(
    "kept AS (SELECT entity_id, list_sort(list_filter(source_chunk_ids, lambda c: c NOT IN (SELECT chunk_id FROM gone))) AS l FROM nodes)",
    "left_over AS (SELECT entity_id, list_sort(list(c)) AS l FROM (SELECT entity_id, unnest(source_chunk_ids) AS c FROM nodes) WHERE c NOT IN (SELECT chunk_id FROM gone) GROUP BY entity_id), kept AS (SELECT n.entity_id, coalesce(o.l, []) AS l FROM nodes n LEFT JOIN left_over o USING (entity_id))",
))
def graph_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = corpus(spark, sf_dir, "doc_id").where("namespace = 'handbook'").select("chunk_id")
    return _joined(graph.remove_sources(canonical(spark, sf_dir)[0], gone)).select("entity_id", "source_chunk_ids")


@query(f"""WITH {GRAPH}, both_ways AS (SELECT source AS entity_id, target AS neighbour, CASE WHEN weight > 0 THEN weight ELSE 1.0 END AS weight FROM edges WHERE source <> target UNION ALL SELECT target, source, CASE WHEN weight > 0 THEN weight ELSE 1.0 END FROM edges WHERE source <> target)
SELECT entity_id, neighbour, round(sum(weight), 6) AS weight FROM both_ways GROUP BY ALL""")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = canonical(spark, sf_dir)
    return graph.adjacency(edges, nodes)


_LINKED = f"""linked AS (SELECT DISTINCT query_id, entity_id FROM (SELECT query_id, unnest(list_distinct(list_concat(list_filter(regexp_split_to_array(lower(trim(query_text)), '{SPACE}'), lambda w: w <> ''), [lower(trim(query_text))]))) AS w FROM asked) q JOIN nodes n ON lower(trim(n.name)) = q.w)"""


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = canonical(spark, sf_dir)
    return retrieve.linked_entities(asked(spark, sf_dir), nodes), nodes, edges


@query(f"WITH {ASKED}, {ENTITIES}, {_LINKED} SELECT query_id, entity_id FROM linked")
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[0]


_HOOD = f"""{ASKED}, {GRAPH}, {_LINKED}, entries AS (SELECT source AS entity_id, target AS other FROM edges UNION ALL SELECT target, source FROM edges WHERE source <> target),
bounded AS (SELECT DISTINCT entity_id, other FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY other) AS n FROM entries) WHERE n <= 64),
h1 AS (SELECT DISTINCT l.query_id, b.other AS entity_id FROM linked l JOIN bounded b USING (entity_id)), h2 AS (SELECT DISTINCT h.query_id, b.other AS entity_id FROM h1 h JOIN bounded b USING (entity_id)),
hood AS (SELECT query_id, entity_id, CAST(min(d) AS INTEGER) AS depth FROM (SELECT query_id, entity_id, 0 AS d FROM linked UNION ALL SELECT query_id, entity_id, 1 FROM h1 UNION ALL SELECT query_id, entity_id, 2 FROM h2) GROUP BY ALL)"""


@query(f"WITH {_HOOD} SELECT query_id, entity_id, depth FROM hood")
def neighborhood_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, nodes, edges = _linked(spark, sf_dir)
    return graph.neighbourhood(seeds, edges, nodes, 2)


@query(f"""WITH {_HOOD}, near AS (SELECT h.query_id, c.chunk_id, min(h.depth) AS d FROM (SELECT * FROM hood WHERE depth <= 1) h JOIN (SELECT entity_id, unnest(source_chunk_ids) AS chunk_id FROM nodes) c USING (entity_id) GROUP BY ALL),
scored AS (SELECT n.query_id, n.chunk_id, a.top_k, round(power(0.5, n.d), 6) AS score FROM near n JOIN asked a USING (query_id)) SELECT query_id, chunk_id, score, rank FROM {top_sql("scored")}""")
def graph_leg_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, nodes, edges = _linked(spark, sf_dir)
    return retrieve.graph_hits(graph.neighbourhood(seeds, edges, nodes, 1), nodes, asked(spark, sf_dir))


@query(f"WITH {_HOOD} SELECT a.query_id, e.relation_id FROM edges e JOIN hood a ON a.entity_id = e.source AND a.depth <= 1 JOIN hood b ON b.entity_id = e.target AND b.query_id = a.query_id AND b.depth <= 1")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, nodes, edges = _linked(spark, sf_dir)
    return graph.induced_edges(graph.neighbourhood(seeds, edges, nodes, 1), edges)


_PATHS = f"""{GRAPH}, pairs AS (SELECT DISTINCT source || '|' || target AS query_id, least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target),
steps AS (SELECT relation_id AS r, source AS x, target AS y, CASE WHEN weight > 0 THEN weight ELSE 1.0 END AS w, source_chunk_ids AS c FROM edges WHERE source <> target UNION ALL SELECT relation_id, target, source, CASE WHEN weight > 0 THEN weight ELSE 1.0 END, source_chunk_ids FROM edges WHERE source <> target),
paths AS (SELECT query_id, a || ',' || b AS entities, r AS relations, round(w, 6) AS score FROM pairs JOIN steps ON x = a AND y = b
  UNION ALL SELECT p.query_id, p.a || ',' || s.y || ',' || p.b, s.r || ',' || t.r, round(0.5 * s.w * t.w * CASE WHEN list_has_any(s.c, t.c) THEN 1.1 ELSE 1.0 END, 6) FROM pairs p JOIN steps s ON s.x = p.a JOIN steps t ON t.x = s.y AND t.y = p.b WHERE s.y <> p.a AND s.y <> p.b)"""


@query(f"WITH {_PATHS} SELECT query_id, entities, relations, score FROM paths")
def path_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths between the ends of every relation, best first."""
    edges = canonical(spark, sf_dir)[1]
    pairs = edges.where("source <> target").select(F.concat_ws("|", "source", "target").alias("query_id"), F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return graph.rank_paths(pairs, edges).select("query_id", F.array_join("entities", ",").alias("entities"), F.array_join("relations", ",").alias("relations"), "score")


@query(f"WITH {ASKED}, {ENTITIES}, {_LINKED} SELECT DISTINCT x.query_id, x.entity_id AS a, y.entity_id AS b FROM linked x JOIN linked y ON x.query_id = y.query_id AND x.entity_id < y.entity_id")
def seed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.seed_pairs(_linked(spark, sf_dir)[0])


# ---------------------------------------------------------------- communities


def _by_namespace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and adjacency of the relations of each namespace."""
    nodes, _ = canonical(spark, sf_dir)
    names = nodes.groupBy(graph.normal_name(F.col("name")).alias("_n")).agg(F.max("entity_id").alias("id"))
    rows = read(spark, sf_dir, "relations").distinct().where("namespace is not null").select("namespace", "relation_id", graph.normal_name(F.col("source")).alias("s"), graph.normal_name(F.col("target")).alias("t"), F.when(F.isnan("weight"), 0.0).otherwise(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    ends = rows.join(names.select(F.col("_n").alias("s"), F.col("id").alias("source")), "s").join(names.select(F.col("_n").alias("t"), F.col("id").alias("target")), "t")
    edges = ends.select("namespace", F.col("relation_id").cast("string").alias("relation_id"), "source", "target", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0).alias("weight"))
    members = edges.select("namespace", F.explode(F.array("source", "target")).alias("entity_id")).distinct()
    both = edges.where("source <> target").select("namespace", F.col("source").alias("entity_id"), F.col("target").alias("neighbour"), "weight").unionByName(edges.where("source <> target").select("namespace", F.col("target").alias("entity_id"), F.col("source").alias("neighbour"), "weight"))
    return members, edges, both.groupBy("namespace", "entity_id", "neighbour").agg(F.sum("weight").alias("weight"))


def _communities(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    members, edges, weights = _by_namespace(spark, sf_dir)
    return community.communities(community.detect(members, weights, method), edges)


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _communities(spark, sf_dir, "louvain")


@query()
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _communities(spark, sf_dir, "labels")


_PLACED = f"""{GRAPH}, nsrel AS (SELECT e.namespace, CAST(e.row_id AS VARCHAR) AS relation_id, e.source, e.target FROM ends e WHERE e.namespace IS NOT NULL),
nsnode AS (SELECT DISTINCT namespace, entity_id FROM (SELECT namespace, source AS entity_id FROM nsrel UNION ALL SELECT namespace, target FROM nsrel)),
labelled AS (SELECT n.namespace, n.entity_id, d.type AS label FROM nsnode n JOIN nodes d USING (entity_id)),
grouped AS (SELECT namespace, label, list_sort(list(entity_id)) AS entity_ids FROM labelled GROUP BY ALL),
inner_rels AS (SELECT r.namespace, a.label, list_sort(list(DISTINCT r.relation_id)) AS relation_ids FROM nsrel r JOIN labelled a ON a.namespace = r.namespace AND a.entity_id = r.source JOIN labelled b ON b.namespace = r.namespace AND b.entity_id = r.target AND b.label = a.label GROUP BY ALL),
placed AS (SELECT g.namespace, 'L0-' || g.entity_ids[1] AS community_id, g.entity_ids, coalesce(i.relation_ids, []) AS relation_ids FROM grouped g LEFT JOIN inner_rels i USING (namespace, label)),
hashed AS (SELECT *, sha256(array_to_string(list_transform(entity_ids, lambda x: x || chr(31)), '') || chr(30) || array_to_string(list_transform(relation_ids, lambda x: x || chr(31)), '')) AS content_hash FROM placed)"""


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Communities by entity type, which SQL can make too, to check what follows detection; and the nodes."""
    members, edges, _ = _by_namespace(spark, sf_dir)
    nodes = canonical(spark, sf_dir)[0]
    labels = members.join(nodes.select("entity_id", F.col("type").alias("label")), "entity_id").withColumn("level", F.lit(0))
    return community.communities(labels, edges), nodes


@query(f"WITH {_PLACED} SELECT namespace, community_id, 0 AS level, '' AS parent_id, array_to_string(entity_ids, ',') AS entity_ids, array_to_string(relation_ids, ',') AS relation_ids FROM placed")
def communities_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = _typed(spark, sf_dir)
    return table.withColumn("entity_ids", F.array_join("entity_ids", ",")).withColumn("relation_ids", F.array_join("relation_ids", ","))


@query(f"WITH {_PLACED} SELECT namespace, community_id, content_hash FROM hashed")
def community_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.content_hash(_typed(spark, sf_dir)[0]).select("namespace", "community_id", "content_hash")


@query(f"WITH {_PLACED} SELECT namespace, community_id, content_hash FROM hashed WHERE len(entity_ids) % 2 = 0")
def stale_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports exist for communities of odd size; of the others the hash has changed."""
    table, _ = _typed(spark, sf_dir)
    reports = community.content_hash(table).withColumn("content_hash", F.when(F.size("entity_ids") % 2 == 1, F.col("content_hash")).otherwise("old"))
    return community.stale(table, reports).select("namespace", "community_id", "content_hash")


@query(f"""WITH {ASKED}, {_PLACED}, words AS (SELECT p.namespace, p.community_id, w, count(*) AS n FROM (SELECT namespace, community_id, unnest(entity_ids) AS entity_id FROM placed) p JOIN (SELECT entity_id, unnest(list_filter(regexp_split_to_array(lower(name), '{SPACE}'), lambda w: w <> '')) AS w FROM nodes) d USING (entity_id) GROUP BY ALL),
qwords AS (SELECT DISTINCT query_id, scope AS namespace, unnest(list_filter(regexp_split_to_array(lower(query_text), '{SPACE}'), lambda w: w <> '')) AS w FROM asked),
shared AS (SELECT q.query_id, w.community_id, sum(w.n) AS overlap FROM qwords q JOIN words w USING (namespace, w) GROUP BY ALL),
allpairs AS (SELECT a.query_id, p.community_id, CAST(coalesce(s.overlap, 0) AS BIGINT) AS overlap FROM asked a JOIN placed p ON p.namespace = a.scope LEFT JOIN shared s ON s.query_id = a.query_id AND s.community_id = p.community_id)
SELECT query_id, community_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, community_id) AS r FROM allpairs) WHERE r <= 3""")
def community_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, nodes = _typed(spark, sf_dir)
    return community.select_for(asked(spark, sf_dir).withColumnRenamed("scope", "namespace"), table, nodes, 3)


_RESOLVED = f"""RECURSIVE names AS (SELECT DISTINCT coalesce(type, '') AS type, trim(name) AS name FROM entities WHERE coalesce({_name("name")}, '') <> ''),
embedded AS (SELECT type, name, {_name("name")} AS n, {counts_sql("b")} AS v FROM (SELECT *, {buckets_sql("name")} AS b FROM names)),
alike AS (SELECT a.type, a.name AS a, b.name AS b FROM embedded a JOIN embedded b ON a.type = b.type AND (a.n = b.n OR round({cosine_sql("a.v", "b.v")}, 6) >= 0.92)),
reach AS (SELECT type, name, name AS other FROM names UNION SELECT r.type, r.name, k.b FROM reach r JOIN alike k ON k.type = r.type AND k.a = r.other),
resolved AS (SELECT type, name, arg_min(other, (-strlen(other), other)) AS canonical FROM reach GROUP BY ALL)"""


@query(f"WITH {_RESOLVED} SELECT type, name, canonical FROM resolved")
def resolve_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve(read(spark, sf_dir, "entities"))


@query(f"""WITH {_RESOLVED}, best AS (SELECT name, arg_min(canonical, (-strlen(canonical), canonical)) AS target FROM resolved GROUP BY name)
SELECT DISTINCT r.relation_id, coalesce(s.target, r.source) AS source, coalesce(t.target, r.target) AS target FROM relations r LEFT JOIN best s ON s.name = trim(r.source) LEFT JOIN best t ON t.name = trim(r.target)""")
def resolve_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose ends carry the resolved names."""
    entities, relations = read(spark, sf_dir, "entities"), read(spark, sf_dir, "relations")
    return graph.rewrite(entities, relations, graph.resolve(entities))[1].select("relation_id", "source", "target").distinct()


@query(f"""WITH {_HOOD.replace("WITH ", "")}, nsrel AS (SELECT e.namespace, CAST(e.row_id AS VARCHAR) AS relation_id, e.source, e.target FROM ends e WHERE e.namespace IS NOT NULL),
nsnode AS (SELECT DISTINCT namespace, entity_id FROM (SELECT namespace, source AS entity_id FROM nsrel UNION ALL SELECT namespace, target FROM nsrel)),
labelled AS (SELECT n.namespace, n.entity_id, d.type AS label FROM nsnode n JOIN nodes d USING (entity_id)),
member AS (SELECT entity_id, 'L0-' || min(entity_id) OVER (PARTITION BY namespace, label) AS community_id FROM labelled)
SELECT query_id, array_to_string(list_sort(list(DISTINCT community_id)), ',') AS communities FROM hood JOIN member USING (entity_id) WHERE depth <= 1 GROUP BY query_id""")
def communities_of_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, nodes, edges = _linked(spark, sf_dir)
    found = retrieve.communities_of(graph.neighbourhood(seeds, edges, nodes, 1), _typed(spark, sf_dir)[0])
    return found.withColumn("communities", F.array_join("communities", ","))


_REPLIES = "replies AS (SELECT DISTINCT entity_id, 'ENTITY | ' || coalesce(name, '') || ' | ' || coalesce(type, '') || chr(10) || chr(10) || 'noise' || chr(10) || 'relation|' || coalesce(name, '') || '|x|cites' AS reply FROM entities)"


@query(rf"""WITH {_REPLIES}, parts AS (SELECT entity_id, list_transform(string_split(l, '|'), lambda p: trim(p)) AS p FROM (SELECT entity_id, unnest(list_filter(list_transform(string_split(reply, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS l FROM replies))
SELECT entity_id, upper(p[1]) AS kind, p[2] AS a, coalesce(p[3], '') AS b, coalesce(p[4], '') AS c FROM parts WHERE (upper(p[1]) = 'ENTITY' AND len(p) >= 2 AND p[2] <> '') OR (upper(p[1]) = 'RELATION' AND len(p) >= 4 AND p[2] <> '' AND p[3] <> '' AND p[4] <> '')""")
def extraction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = F.coalesce("name", F.lit("")), F.coalesce("type", F.lit(""))
    reply = F.concat(F.lit("ENTITY | "), name, F.lit(" | "), kind, F.lit("\n\nnoise\nrelation|"), name, F.lit("|x|cites"))
    lines = read(spark, sf_dir, "entities").select("entity_id", reply.alias("r")).distinct().select("entity_id", F.explode(extraction_lines(F.col("r"))).alias("p"))
    part = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(""))
    rows = lines.select("entity_id", F.upper(part(0)).alias("kind"), part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), F.size("p").alias("n"))
    entity, relation = (F.col("kind") == "ENTITY") & (F.col("a") != ""), (F.col("kind") == "RELATION") & (F.col("n") >= 4) & (F.col("a") != "") & (F.col("b") != "") & (F.col("c") != "")
    return rows.where(entity | relation).drop("n")
