"""Plans of the habitat graph, and the queries that run an operator: paths, statements and the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Duck, Spark, round_js
from ..operators.graph import connected_components, reachability, shortest_paths
from ..operators.shared import folder, kept
from ..operators.statements import greedy_chunks, greedy_sql
from ..operators.store import write_batch
from ..sources.adapters import plan, run
from ..streaming.ingest import ingest, latest
from .queries import RADIUS_KM, K, haversine, query
from .records import _trip_evidence

#: Queries that are more than one plan, and their SQL.
OPERATED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
OPERATED_SQL: dict[str, str] = {}


def operated(sql: str):
    def register(f):
        OPERATED[f.__name__] = f
        OPERATED_SQL[f.__name__] = sql
        return f

    return register


def _rows(spark: SparkSession, sf_dir: str, uses: str, body: str) -> DataFrame:
    return run(spark, sf_dir, plan(Spark(), uses, body))


KM = haversine("lat1", "lon1", "lat2", "lon2", RADIUS_KM["graph"])


# -- edges


@query
def build_graph(d):
    """Edges with their length and an id of both ends and the kind."""
    return plan(d, "edges nodes", f"SELECT concat({d.text('e.src')}, '__', {d.text('e.dst')}, '__', 'region') AS id, e.src, e.dst, a.label AS src_label, b.label AS dst_label, {round_js(KM.replace('lat', 'e.lat').replace('lon', 'e.lon'), 3)} AS km, e.src % 3 > 0 AS both_ways FROM edges e JOIN nodes a ON a.node = e.src JOIN nodes b ON b.node = e.dst")


def _directed(d) -> str:
    return f"SELECT CASE k WHEN 0 THEN src ELSE dst END AS src, CASE k WHEN 0 THEN dst ELSE src END AS dst, k = 1 AS reversed FROM (SELECT src, dst, src % 3 > 0 AS both_ways FROM edges) AS e {d.explode(d.upto(2), 'k')} WHERE k = 0 OR both_ways"


@query
def directed_edges(d):
    return plan(d, "edges", f"SELECT * FROM ({_directed(d)}) AS a")


@query
def out_edges(d):
    return plan(d, "edges nodes", f"SELECT n.node, a.dst FROM nodes n JOIN ({_directed(d)}) AS a ON a.src = n.node")


@query
def in_edges(d):
    return plan(d, "edges nodes", f"SELECT n.node, a.src FROM nodes n JOIN ({_directed(d)}) AS a ON a.dst = n.node")


@query
def validate_graph(d):
    """What is wrong of a graph some of whose parts are made wrong: ids, coordinates, ends, loops, repeated arcs."""
    nodes = "SELECT CASE WHEN node % 23 = 0 THEN 1 ELSE node END AS node, CASE WHEN node % 11 = 0 THEN lat + 200 ELSE lat END AS lat, lon, CASE WHEN node % 7 = 0 THEN 'lagoon' ELSE 'coast' END AS kind FROM nodes"
    arcs = "SELECT src, CASE WHEN src % 6 = 5 THEN src WHEN src % 13 = 3 THEN dst + 1000 ELSE dst END AS dst, 1 AS of FROM arcs UNION ALL SELECT src, dst, 2 FROM arcs WHERE src % 5 = 2"
    rules = {
        "duplicate-node": f"SELECT {d.text('node')} AS what FROM ({nodes}) AS n GROUP BY node HAVING count(*) > 1",
        "coordinates": f"SELECT {d.text('node')} AS what FROM ({nodes}) AS n WHERE lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180",
        "unknown-kind": f"SELECT {d.text('node')} AS what FROM ({nodes}) AS n WHERE kind NOT IN ('coast', 'bay', 'river')",
        "self-loop": f"SELECT concat({d.text('src')}, '>', {d.text('dst')}) AS what FROM ({arcs}) AS a WHERE src = dst",
        "dangling": f"SELECT concat({d.text('a.src')}, '>', {d.text('a.dst')}) AS what FROM ({arcs}) AS a LEFT JOIN (SELECT DISTINCT node FROM ({nodes}) AS n) AS k ON k.node = a.dst WHERE k.node IS NULL",
        "duplicate-arc": f"SELECT concat({d.text('src')}, '>', {d.text('dst')}) AS what FROM ({arcs}) AS a GROUP BY src, dst HAVING count(*) > 1",
    }
    return plan(d, "nodes arcs", " UNION ALL ".join(f"SELECT '{k}' AS rule, what FROM ({x}) AS r" for k, x in rules.items()))


# -- what takes rounds

_ARCS = f"SELECT src, dst, {KM} AS km FROM arcs"
_COMPONENTS = plan(Duck(), "nodes arcs", "SELECT node, min(origin) AS component FROM walk GROUP BY node", "walk AS (SELECT node AS origin, node FROM nodes UNION SELECT w.origin, a.dst FROM walk w JOIN arcs a ON a.src = w.node)")


@operated(_COMPONENTS)
def components_of_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_rows(spark, sf_dir, "nodes", "SELECT node FROM nodes"), _rows(spark, sf_dir, "edges", "SELECT src, dst FROM edges"))


OPERATED["connected_components"] = OPERATED.pop("components_of_graph")
OPERATED_SQL["connected_components"] = OPERATED_SQL.pop("components_of_graph")

# one-way arcs, so that not every node of a component is reached
_ONE_WAY = "SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges WHERE src % 2 = 0"


@operated(plan(Duck(), "nodes edges", "SELECT n.node AS origin, m.node AS target, w.node IS NOT NULL AS reachable FROM nodes n CROSS JOIN nodes m LEFT JOIN walk w ON w.origin = n.node AND w.node = m.node", f"ways AS ({_ONE_WAY}), walk AS (SELECT node AS origin, node FROM nodes UNION SELECT w.origin, a.dst FROM walk w JOIN ways a ON a.src = w.node)"))
def reachability_of_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the registry from every other: reachable or not."""
    nodes = _rows(spark, sf_dir, "nodes", "SELECT node FROM nodes")
    found = reachability(nodes, _rows(spark, sf_dir, "edges", _ONE_WAY), nodes.withColumnRenamed("node", "origin"))
    pairs = nodes.select(F.col("node").alias("origin")).crossJoin(nodes.select(F.col("node").alias("target")))  # the registry's pairs are the answer
    return pairs.join(found.withColumnRenamed("node", "target"), ["origin", "target"], "left").select("origin", "target", F.col("hops").isNotNull().alias("reachable"))


OPERATED["reachability"] = OPERATED.pop("reachability_of_graph")
OPERATED_SQL["reachability"] = OPERATED_SQL.pop("reachability_of_graph")

_BEST = "SELECT origin, node, arg_min(km, (km, path)) AS km, arg_min(path, (km, path)) AS path FROM walk GROUP BY origin, node"


@operated(
    plan(
        Duck(), "nodes arcs",
        f"SELECT n.node AS origin, m.node AS target, {round_js('b.km', 3)} AS km, array_to_string(b.path, '>') AS path, len(b.path) - 1 AS edges FROM nodes n CROSS JOIN nodes m LEFT JOIN ({_BEST}) b ON b.origin = n.node AND b.node = m.node",
        f"walk AS (SELECT node AS origin, node, 0::DOUBLE AS km, [node] AS path FROM nodes UNION ALL SELECT w.origin, a.dst, w.km + a.km, list_append(w.path, a.dst) FROM walk w JOIN ({_ARCS}) a ON a.src = w.node WHERE NOT list_contains(w.path, a.dst))",
    )
)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _rows(spark, sf_dir, "nodes", "SELECT node FROM nodes")
    found = shortest_paths(nodes, _rows(spark, sf_dir, "arcs", _ARCS), nodes.withColumnRenamed("node", "origin"))
    path = F.when(F.col("path").isNotNull(), F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))
    return found.select("origin", F.col("node").alias("target"), F.expr(round_js("km", 3)).alias("km"), path.alias("path"), (F.size("path") - 1).cast("long").alias("edges")).withColumn("edges", F.when(F.col("path").isNotNull(), F.col("edges")))


@operated(plan(Duck(), "nodes arcs", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM arcs) / 2 AS edges, (SELECT count(DISTINCT component) FROM c) AS components, (SELECT count(*) FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM arcs a WHERE a.src = n.node)) AS isolated, " + round_js("(SELECT count(*) FROM arcs) / (SELECT count(*) FROM nodes)::DOUBLE", 3) + " AS degree", "walk AS (SELECT node AS origin, node FROM nodes UNION SELECT w.origin, a.dst FROM walk w JOIN arcs a ON a.src = w.node), c AS (SELECT node, min(origin) AS component FROM walk GROUP BY node)"))
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _rows(spark, sf_dir, "nodes", "SELECT node FROM nodes"), _rows(spark, sf_dir, "edges", "SELECT src, dst FROM edges")
    found = connected_components(nodes, edges).agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))
    joined = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    alone = nodes.join(joined, "node", "left_anti").agg(F.count("*").alias("isolated"))
    arcs = edges.agg(F.count("*").alias("edges"))
    one = found.crossJoin(F.broadcast(alone)).crossJoin(F.broadcast(arcs))  # one row each
    return one.select("nodes", F.col("edges").cast("double").alias("edges"), "components", "isolated", F.expr(round_js("2 * edges / nodes", 3)).alias("degree"))


# -- statements and the store

CHUNK_BYTES, STATEMENT_BYTES = 150_000, 4000
_SIZES = "SELECT doc_id, lang, {0} + CASE WHEN doc_id % 211 = 0 THEN 200000 ELSE 0 END AS n FROM documents"


@operated("WITH RECURSIVE " + greedy_sql(_SIZES.format(Duck().bytes("text")), "lang", "doc_id", "n", CHUNK_BYTES) + " SELECT doc_id, lang, n, chunk, chunk IS NULL AS oversize FROM chunked")
def chunk_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "", _SIZES.format(Spark().bytes("text")))
    return greedy_chunks(rows, "lang", "doc_id", "n", CHUNK_BYTES).withColumn("oversize", F.col("chunk").isNull())


#: Words that a statement of a backfill must not hold.
FORBIDDEN = r"(?i)\b(INSERT OR IGNORE|INSERT OR REPLACE|UPDATE|DELETE|DROP|ALTER|CREATE|BEGIN|COMMIT)\b"


def _tuples(d) -> str:
    return f"SELECT event_id, CAST(floor(h / 24) AS BIGINT) AS day, concat('(', {d.text('station')}, ', ', {d.text('h')}, ', ''', CASE WHEN event_id % 997 = 0 THEN 'DROP me' ELSE metric END, ''')') AS tuple FROM hydro WHERE station = 2 AND h BETWEEN 0 AND 600"


def _statements(d, dealt: str) -> str:
    body = d.listed("tuple", "event_id")
    return f"SELECT day, chunk AS part, count(*) AS n, CAST(sum(n) AS BIGINT) AS bytes, {d.sha(body)} AS sha, NOT {d.like(body, FORBIDDEN)} AS safe FROM {dealt} GROUP BY day, chunk"


def _sized(d) -> str:
    return f"SELECT event_id, day, tuple, {d.bytes('tuple')} + 2 AS n FROM ({_tuples(d)}) AS r"


@operated(plan(Duck(), "hydro", _statements(Duck(), "chunked"), greedy_sql(_sized(Duck()), "day", "event_id", "n", STATEMENT_BYTES)))
def tide_backfill_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one station and chosen days, packed into statements of bounded size, with a hash of each and the guard's verdict."""
    dealt = greedy_chunks(_rows(spark, sf_dir, "hydro", _sized(Spark())), "day", "event_id", "n", STATEMENT_BYTES)
    return spark.sql(_statements(Spark(), "{dealt}"), dealt=dealt)


_STORED = "SELECT report_id, facility, day, CASE WHEN report_id % 6 = 0 AND report_id % 4 > 0 THEN visitors + 1 ELSE visitors END AS visitors FROM reports WHERE day < 1200"
_GIVEN = "SELECT report_id, facility, day, visitors FROM reports WHERE report_id % 4 > 0 OR day >= 1200 OR report_id % 6 > 0"


@operated(plan(Duck(), "reports", f"SELECT n.report_id, CASE WHEN s.report_id IS NULL THEN 'insert' WHEN s.visitors IS NOT DISTINCT FROM n.visitors AND s.facility = n.facility AND s.day = n.day THEN 'duplicate' ELSE 'conflict' END AS outcome, s.report_id IS NULL OR s.visitors IS NOT DISTINCT FROM n.visitors AS is_stored FROM ({_GIVEN}) n LEFT JOIN ({_STORED}) s ON s.report_id = n.report_id"))
def idempotent_batch_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch against a store that holds part of it: what is new is written, once, and read back."""
    import uuid

    path = f"{folder(spark)}/store-{uuid.uuid4().hex}"
    _rows(spark, sf_dir, "reports", _STORED).write.parquet(path)
    given = _rows(spark, sf_dir, "reports", _GIVEN)
    outcome = write_batch(given, path, ["report_id"], on_conflict="keep")
    write_batch(given, path, ["report_id"], on_conflict="keep")  # a batch that comes twice adds nothing
    stored = spark.read.schema(given.schema).parquet(path)
    back = given.join(stored.withColumn("_s", F.lit(True)), [given[c].eqNullSafe(stored[c]) for c in given.columns], "left").select(given["report_id"].alias("id"), F.col("_s").isNotNull().alias("is_stored"))
    return outcome.join(back, outcome["report_id"] == back["id"]).select("report_id", "outcome", "is_stored")


def _preflight(d) -> str:
    """What each run (an operator's month) would write; a run in which one source event names two kinds of evidence writes nothing. Even days are stored already."""
    events = f"SELECT operator, {d.month('floor(start_h / 24)')} AS run, event_key, count(DISTINCT evidence_type) AS kinds, min(trip) AS trip, min(evidence_type) AS evidence_type, min(start_h) AS start_h FROM ({_trip_evidence(d)}) AS e GROUP BY operator, {d.month('floor(start_h / 24)')}, event_key"
    body = f"concat('{{\"event\":\"', event_key, '\",\"kind\":\"', evidence_type, '\",\"trip\":', {d.text('trip')}, '}}')"
    return f"SELECT operator, run, event_key, trip, {d.sha(body)} AS content_id, floor(start_h / 24) % 2 = 0 AS was_stored, CASE WHEN kinds > 1 THEN 'COLLISION' WHEN floor(start_h / 24) % 2 = 0 THEN 'EXISTING' ELSE 'WOULD_CREATE' END AS verdict, max(kinds) OVER (PARTITION BY operator, run) > 1 AS aborted FROM ({events}) AS t"


@operated(f"SELECT operator, run, event_key, trip, content_id, verdict, aborted, was_stored OR NOT aborted AND verdict = 'WOULD_CREATE' AS stored FROM ({_preflight(Duck())}) AS p")
def evidence_ingest_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preflight of every run, then, under the apply flag, its write and what the store holds after it."""
    import uuid

    path, row = f"{folder(spark)}/evidence-{uuid.uuid4().hex}", ["operator", "event_key", "content_id"]
    told = kept(_rows(spark, sf_dir, "", _preflight(Spark())), "preflight")
    told.where("was_stored").select(row).write.parquet(path)
    write_batch(told.where("NOT aborted AND verdict = 'WOULD_CREATE'").select(row), path, ["operator", "event_key"])
    stored = spark.read.schema(told.select(row).schema).parquet(path).withColumn("_s", F.lit(True))
    return told.join(stored, row, "left").select("operator", "run", "event_key", "trip", "content_id", "verdict", "aborted", F.col("_s").isNotNull().alias("stored"))


# -- the log as a stream

_LOG = "SELECT node, source, h, collected, min(value) AS value FROM snapshots GROUP BY node, source, h, collected"


@operated(plan(Duck(), "snapshots", f"SELECT node, source, h, collected, value FROM (SELECT *, row_number() OVER (PARTITION BY node, source, h ORDER BY collected DESC, value DESC) AS rn FROM ({_LOG}) AS l WHERE collected <= {K}) AS r WHERE rn = 1"))
def replayed_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log streamed in micro batches into a store, late and repeated rows among them, then read as of K."""
    import uuid

    at = f"{folder(spark)}/replay-{uuid.uuid4().hex}"
    log = _rows(spark, sf_dir, "snapshots", _LOG).withColumn("day", F.floor(F.col("h") / 24))
    log.where("collected % 3 > 0").write.parquet(f"{at}/log")
    log.where("collected % 3 < 2").write.mode("append").parquet(f"{at}/log")  # late rows, and some that came before
    ingest(spark, f"{at}/log", log.schema.simpleString()[7:-1].replace(":", " "), f"{at}/store", f"{at}/checkpoint", ["node", "source", "h", "collected", "day"], part="day")
    return latest(spark.read.schema(log.schema).parquet(f"{at}/store"), ["node", "source", "h"], "collected", K).select("node", "source", "h", "collected", "value")
