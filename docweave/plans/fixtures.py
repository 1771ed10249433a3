"""The graph model projected onto the TPC-H-like tables, as portable SQL.

Table names are placeholders in braces, which Spark binds to DataFrames and
which are plain view names elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.plans.materialize import settled

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")

NODES = """
SELECT CAST(r_regionkey AS BIGINT) AS node_id, concat('src/', r_name, '.ts#<file>:file') AS stable_id, 'file' AS type,
       concat('src/', r_name, '.ts') AS name, CAST(NULL AS STRING) AS qualified_name, concat('src/', r_name, '.ts') AS file_path FROM {region}
UNION ALL SELECT 500 + s_suppkey, concat('lib/s', CAST(s_suppkey AS STRING), '.ts#<file>:file'), 'file',
       concat('lib/s', CAST(s_suppkey AS STRING), '.ts'), NULL, concat('lib/s', CAST(s_suppkey AS STRING), '.ts') FROM {supplier}
UNION ALL SELECT 100000 + CAST(n_nationkey AS BIGINT), concat('src/', r_name, '.ts#', n_name, ':class'), 'class', n_name, n_name,
       concat('src/', r_name, '.ts') FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 1000000 + c_custkey, concat('src/', r_name, '.ts#', n_name, '.', c_name, ':method'), 'method', c_name, concat(n_name, '.', c_name),
       concat('src/', r_name, '.ts') FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 100000000 + p_partkey, concat('src/', r_name, '.ts#part', CAST(p_partkey AS STRING), ':function'), 'function', p_name,
       concat('part', CAST(p_partkey AS STRING)), concat('src/', r_name, '.ts') FROM {part} JOIN {region} ON p_partkey % 5 = r_regionkey
UNION ALL SELECT 10000000000 + doc_id, concat('docs/', CAST(doc_id AS STRING), '.md#<page>:documentation_page'), 'documentation_page',
       concat('docs/', CAST(doc_id AS STRING), '.md'), NULL, concat('docs/', CAST(doc_id AS STRING), '.md') FROM {documents}
UNION ALL SELECT 1000000000000 + doc_id * 100000 + line_no, concat('docs/', CAST(doc_id AS STRING), '.md#l', CAST(line_no AS STRING), ':documentation_section'),
       'documentation_section', substr(line, 1, 40), concat('l', CAST(line_no AS STRING)), concat('docs/', CAST(doc_id AS STRING), '.md')
       FROM {lines} WHERE line <> ''
"""

EDGES = """
SELECT CAST(r_regionkey AS BIGINT) AS source_id, 100000 + CAST(n_nationkey AS BIGINT) AS target_id, 'CONTAINS' AS type
       FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 100000 + CAST(c_nationkey AS BIGINT), 1000000 + c_custkey, 'CONTAINS' FROM {customer}
UNION ALL SELECT CAST(r_regionkey AS BIGINT), 100000000 + p_partkey, 'CONTAINS' FROM {part} JOIN {region} ON p_partkey % 5 = r_regionkey
UNION ALL SELECT 10000000000 + doc_id, 1000000000000 + doc_id * 100000 + line_no, 'CONTAINS' FROM {lines} WHERE line <> ''
UNION ALL SELECT CAST(r_regionkey AS BIGINT), CAST((r_regionkey + 1) % 5 AS BIGINT), 'IMPORTS' FROM {region}
UNION ALL SELECT 500 + s_suppkey, CAST(n_regionkey AS BIGINT), 'IMPORTS' FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 1000000 + c_custkey, 100000000 + l_partkey, 'CALLS' FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
       JOIN {orders} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_partkey % 5 = n_regionkey
UNION ALL SELECT source_id, CASE WHEN doc_id % 2 = 0 THEN 10000000000 + doc_id ELSE 1000000000000 + doc_id * 100000 + first_line END, 'DOCUMENTS'
       FROM (SELECT doc_id, 1000000 + c_custkey AS source_id FROM {documents} JOIN {customer} ON c_custkey = doc_id WHERE doc_id % 3 = 0
             UNION ALL SELECT doc_id, 100000 + doc_id % 25 FROM {documents} WHERE doc_id % 3 = 1
             UNION ALL SELECT doc_id, doc_id % 5 FROM {documents} WHERE doc_id % 3 = 2) s
       JOIN (SELECT doc_id AS d, min(line_no) AS first_line FROM {lines} WHERE line <> '' GROUP BY doc_id) f ON f.d = s.doc_id
"""

SNAPSHOT = """
SELECT concat('pkg/', CAST(o_custkey % 100 AS STRING), '.ts') AS path_pair, 'function' AS kind, concat('order', CAST(o_orderkey AS STRING)) AS qualified_name,
       concat('pkg/', CAST({shift} AS STRING), '.ts') AS path, concat('order', CAST(o_orderkey AS STRING)) AS name,
       concat(CAST(o_custkey AS STRING), '|', o_orderstatus, '|', o_orderpriority, {suffix}) AS text, o_orderkey AS ordinal
FROM {orders} WHERE {keep}
"""
BASE = {"shift": "o_custkey % 100", "suffix": "''", "keep": "o_orderkey % 11 <> 0"}
TARGET = {
    "shift": "o_custkey % 100 + CASE WHEN o_orderkey % 17 = 0 THEN 100 ELSE 0 END",
    "suffix": "CASE WHEN o_orderkey % 7 = 0 THEN '|v2' ELSE '' END",
    "keep": "o_orderkey % 13 <> 0",
}


class Fixtures:
    """The projected tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **more) -> DataFrame:
        names = {n: self.table(n) for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **names, **more)

    @property
    def lines(self) -> DataFrame:
        return self.table("documents").selectExpr("doc_id", "posexplode(split(text, '\\n', -1)) as (pos, line)").selectExpr(
            "doc_id", "pos + 1 as line_no", "line"
        )

    def keep(self) -> Fixtures:
        """From now on nodes and edges are written tables, as a store holds them:
        for queries that read them more than a few times."""
        if not self._kept:
            self._kept = {"nodes": settled(self.nodes), "edges": settled(self.edges)}
        return self

    @property
    def nodes(self) -> DataFrame:
        if "nodes" in self._kept:
            return self._kept["nodes"]
        return self._sql(NODES, lines=self.lines).selectExpr("*", "cast(null as int) as start_line", "cast(null as int) as end_line")

    @property
    def edges(self) -> DataFrame:
        if "edges" in self._kept:
            return self._kept["edges"]
        rows = self._sql(EDGES, lines=self.lines)
        return rows.selectExpr("*", "xxhash64(type, source_id, target_id) as edge_id")

    def _snapshot(self, how: dict) -> DataFrame:
        text = SNAPSHOT.replace("{shift}", how["shift"]).replace("{suffix}", how["suffix"]).replace("{keep}", how["keep"])
        return self._sql(text).selectExpr(
            # a symbol that came to another file has no pair there
            "path as path_pair", "kind", "qualified_name", "path", "concat(path, '#', qualified_name, ':', kind) as symbol_id", "name",
            "text", "sha2(text, 256) as text_hash", "ordinal",
        )

    @property
    def base(self) -> DataFrame:
        return self._snapshot(BASE)

    @property
    def target(self) -> DataFrame:
        return self._snapshot(TARGET)
