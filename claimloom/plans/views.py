"""Claim-shaped views over the star-schema tables.

Each view is one SQL text that Spark and DuckDB both read;
``{sha}`` stands for the engine's SHA-256 of a column.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession



def _atom(op: str, left: str, right: str, k: str) -> str:
    """SQL text of an atom ``left - right op k`` as JSON; without ``right``, of ``left op k``."""
    var = '{"kind":"var","name":"%s"}'
    side = '{"kind":"ctor","name":"-","args":[%s,%s]}' % (var % left, var % right) if right else var % left
    return f"""'{{"kind":"atomic","name":"{op}","args":[{side},{{"kind":"const","value":', CAST({k} AS STRING), '}}]}}'"""


F_OF_X_IS_F_OF_W = """'{"kind":"atomic","name":"=","args":[{"kind":"ctor","name":"f","args":[{"kind":"var","name":"x"}]},{"kind":"ctor","name":"f","args":[{"kind":"var","name":"w"}]}]}'"""
#: Posts of orders and preconditions of parts and suppliers as formula trees, beside the numbers they are made of.
ORDER_POSTS = f"""SELECT contract_cid, xy, yz, zx, xw, z0, opaque, concat('{{"kind":"and","operands":[', {_atom("<=", "x", "y", "xy")}, ',', {_atom("<=", "y", "z", "yz")}, ',', {_atom("<=", "z", "", "z0")},
          CASE WHEN zx IS NULL THEN '' ELSE concat(',', {_atom("<=", "z", "x", "zx")}) END, CASE WHEN xw = 1 THEN ',{{"kind":"atomic","name":"=","args":[{{"kind":"var","name":"x"}},{{"kind":"var","name":"w"}}]}}' ELSE '' END,
          CASE WHEN opaque = 1 THEN ',{{"kind":"atomic","name":"opaque","args":[]}}' ELSE '' END, ']}}') AS post
        FROM (SELECT concat('c:orders:', CAST(o_orderkey AS STRING)) AS contract_cid, o_orderkey % 7 - 2 AS xy, o_custkey % 9 - 3 AS yz, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 5 - 1 END AS zx,
          CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS xw, o_orderkey % 13 AS z0, CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END AS opaque FROM orders WHERE o_orderstatus <> 'P') n"""
CALLEE_PRES = f"""SELECT kit, name, contract_cid, load_seq, xz, x0, fxw, yz, CASE WHEN kit = 'supplier' THEN concat('{{"kind":"and","operands":[', {_atom("<", "y", "z", "yz")}, ']}}')
          ELSE concat('{{"kind":"and","operands":[', {_atom("<=", "x", "z", "xz")}, CASE WHEN x0 IS NULL THEN '' ELSE concat(',', {_atom("<=", "x", "", "x0")}) END, CASE WHEN fxw = 1 THEN concat(',', {F_OF_X_IS_F_OF_W}) ELSE '' END, ']}}') END AS pre
        FROM (SELECT 'part' AS kit, CAST(p_partkey AS STRING) AS name, concat('c:part:', CAST(p_partkey AS STRING)) AS contract_cid, p_partkey AS load_seq, p_size % 12 - 2 AS xz, CASE WHEN p_size % 2 = 0 THEN p_size END AS x0,
            CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS fxw, CAST(NULL AS BIGINT) AS yz FROM part WHERE p_size % 9 > 0
          UNION ALL SELECT 'supplier', CAST(s_suppkey AS STRING), concat('c:supplier:', CAST(s_suppkey AS STRING)), s_suppkey, NULL, NULL, 0, s_suppkey % 6 FROM supplier WHERE s_acctbal < 2000) n"""

_CALL = """concat('{"kind":"ctor","name":"part', CAST(l_partkey AS STRING), '","args":[', %s, ']}')"""
_NUMBER = """concat('{"kind":"const","value":', CAST(%s AS STRING), '}')"""
_SUM = """concat('{"kind":"ctor","name":"+","args":[{"kind":"var","name":"y"},', %s, ']}')"""
_EQUATION = """concat('{"kind":"atomic","name":"%s","args":[', %s, ',', %s, ']}')"""
_OK = """concat('{"kind":"ctor","name":"Ok","args":[', %s, ']}')"""
_Q, _EXPECTED = "CAST(l_quantity AS BIGINT)", "CAST(l_quantity AS BIGINT) + l_partkey % 4 * 7 + 1"
_Y = """'{"kind":"var","name":"y"}'"""
#: Bodies of functions named by parts: each calls the part before it, down to one divisible by 4; some call themselves, ask for something or give no value.
PART_BODIES = """SELECT concat('part', CAST(p_partkey AS STRING)) AS op, p_partkey AS n, CASE WHEN p_partkey % 50 = 7 THEN p_partkey WHEN p_partkey % 4 <> 0 THEN p_partkey - 1 END AS callee,
          CASE WHEN p_partkey % 4 = 0 THEN 1 WHEN p_partkey % 9 = 5 THEN 6 ELSE 7 END AS more, CASE WHEN p_partkey % 60 = 11 THEN 'pre-bearing' WHEN p_partkey % 70 = 13 THEN 'no-value' END AS flaw FROM part"""

VIEWS: dict[str, str] = {
    "part_bodies": PART_BODIES,
    "body_contracts": f"""
        SELECT op, concat('{{"kind":"atomic","name":"', CASE WHEN flaw = 'no-value' THEN '<' ELSE '=' END, '","args":[{{"kind":"var","name":"result"}},{{"kind":"ctor","name":"+","args":[',
          CASE WHEN callee IS NULL THEN '{{"kind":"var","name":"x"}}' ELSE concat('{{"kind":"ctor","name":"part', CAST(callee AS STRING), '","args":[{{"kind":"var","name":"x"}}]}}') END, ',{{"kind":"const","value":', CAST(more AS STRING), '}}]}}]}}') AS post,
          CASE WHEN flaw = 'pre-bearing' THEN '{{"kind":"atomic","name":"<","args":[{{"kind":"const","value":0}},{{"kind":"var","name":"x"}}]}}' WHEN n % 5 = 0 THEN '{{"kind":"atomic","name":"true","args":[]}}' END AS pre FROM ({PART_BODIES}) b""",
    "body_claims": f"""
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey, l_suppkey, {_Q} AS q, CASE l_linenumber WHEN 2 THEN {_EQUATION % ("=", _CALL % (_NUMBER % _Q), _CALL % (_NUMBER % _Q))} WHEN 3 THEN {_EQUATION % ("=", _OK % (_CALL % (_NUMBER % _Q)), _OK % (_NUMBER % _EXPECTED))}
          WHEN 4 THEN {_EQUATION % ("<", _CALL % (_NUMBER % _Q), _NUMBER % 99)} WHEN 5 THEN {_EQUATION % ("=", _OK % _Y, _Y)} WHEN 6 THEN {_EQUATION % ("=", _CALL % _Y, _SUM % (_NUMBER % "l_partkey % 4 * 7 + 1"))}
          ELSE {_EQUATION % ("=", _CALL % (_NUMBER % _Q), _NUMBER % _EXPECTED)} END AS formula FROM lineitem""",
    "order_posts": ORDER_POSTS,
    "callee_pres": CALLEE_PRES,
    "formula_contracts": f"""
        SELECT c.kit, c.name, c.contract_cid, p.pre, o.post, c.load_seq FROM (SELECT 'part' AS kit, CAST(p_partkey AS STRING) AS name, concat('c:part:', CAST(p_partkey AS STRING)) AS contract_cid, p_partkey AS load_seq FROM part
          UNION ALL SELECT 'supplier', CAST(s_suppkey AS STRING), concat('c:supplier:', CAST(s_suppkey AS STRING)), s_suppkey FROM supplier
          UNION ALL SELECT 'orders', CAST(o_orderkey AS STRING), concat('c:orders:', CAST(o_orderkey AS STRING)), o_orderkey FROM orders) c
        LEFT JOIN ({ORDER_POSTS}) o ON o.contract_cid = c.contract_cid LEFT JOIN ({CALLEE_PRES}) p ON p.contract_cid = c.contract_cid""",
    "claims_before": "SELECT concat(source, ':', CAST(doc_id AS STRING)) AS name, {sha:text} AS behaviour FROM documents",
    "claims_after": """
        SELECT concat(source, ':', CAST(doc_id AS STRING), CASE WHEN lang = 'de' THEN ':v2' ELSE '' END) AS name, {sha:body} AS behaviour
        FROM (SELECT doc_id, source, lang, CASE WHEN lang = 'fr' THEN concat(text, '.') ELSE text END AS body FROM documents) d""",
    "contracts": """
        SELECT 'part' AS kit, CAST(p_partkey AS STRING) AS name, concat('c:part:', CAST(p_partkey AS STRING)) AS contract_cid, CASE WHEN p_size > 25 THEN 'size>25' END AS pre, CASE WHEN p_size % 2 = 0 THEN 'ok' END AS post, p_partkey AS load_seq FROM part
        UNION ALL SELECT 'supplier', CAST(s_suppkey AS STRING), concat('c:supplier:', CAST(s_suppkey AS STRING)), CASE WHEN s_acctbal < 2000 THEN 'solvent' END, 'ok', s_suppkey FROM supplier
        UNION ALL SELECT 'orders', CAST(o_orderkey AS STRING), concat('c:orders:', CAST(o_orderkey AS STRING)), NULL, CASE o_orderstatus WHEN 'F' THEN 'size>25' WHEN 'O' THEN 'ok' END, o_orderkey FROM orders""",
    "call_edges": """
        SELECT concat('c:orders:', CAST(l_orderkey AS STRING)) AS source_cid, CASE WHEN l_linenumber = 1 THEN concat('c:part:', CAST(l_partkey AS STRING)) END AS target_cid,
          CASE WHEN l_quantity > 48 THEN concat('missing:', CAST(l_partkey AS STRING)) WHEN l_linenumber = 2 THEN concat(':', CAST(l_partkey AS STRING))
               WHEN l_linenumber % 3 = 0 THEN concat('supplier:', CAST(l_suppkey AS STRING)) ELSE concat('part:', CAST(l_partkey AS STRING)) END AS target_symbol,
          concat('f', CAST(l_orderkey % 50 AS STRING)) AS file, CAST(l_linenumber AS BIGINT) AS line FROM lineitem""",
    "assertions": """
        SELECT concat('part#euf#', CAST(l_partkey AS STRING)) AS name, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS claim_id,
          CASE WHEN l_linenumber = 1 THEN '=' WHEN l_linenumber = 2 THEN '!=' WHEN l_linenumber % 2 = 0 THEN '<=' WHEN l_linenumber = 7 THEN 'call' ELSE '>=' END AS op, CAST(l_quantity AS BIGINT) AS value FROM lineitem
        UNION ALL SELECT concat('supplier::', CAST(l_suppkey AS STRING)), concat('s', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)), '=', CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_linenumber = 1""",
    "report_rows": """
        SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'self-post' WHEN event_id % 13 = 0 THEN 'consistency' ELSE 'callsite' END AS row_class,
          CASE WHEN value < 20 THEN 'unsatisfied' WHEN value < 30 THEN 'refused' WHEN value < 40 THEN 'undecidable' ELSE 'discharged' END AS status,
          CASE event_id % 7 WHEN 0 THEN 'panic-safe' WHEN 1 THEN 'reflexive' WHEN 2 THEN 'vacuous' WHEN 3 THEN 'hash-tier' WHEN 4 THEN 'solver-substantive' WHEN 5 THEN 'other' END AS method,
          event_id % 5 = 0 AS panic_site, CASE WHEN event_id % 3 = 0 THEN 'vacuous' ELSE 'bridge' END AS obligation_class, event_type, user_id FROM events""",
    "implications": """
        SELECT concat('n', CAST(n_nationkey AS STRING)) AS src, concat('r', CAST(n_regionkey AS STRING)) AS dst FROM nation
        UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), concat('n', CAST((r_regionkey * 5 + 1) % 25 AS STRING)) FROM region
        UNION ALL SELECT concat('t', CAST(conv_id AS STRING), ':', CAST(turn AS STRING)), concat('t', CAST(conv_id AS STRING), ':', CAST(turn + 1 AS STRING)) FROM conversations""",
    "pool": """
        SELECT p_partkey AS load_seq, concat('c:part:', CAST(p_partkey AS STRING)) AS cid, concat('{"header":{"kind":"', CASE WHEN p_size % 4 = 0 THEN 'bridge' ELSE 'contract' END,
          CASE WHEN p_size % 6 = 1 THEN '","contractName":"' ELSE '","name":"' END, p_brand, '","invVerification":"', CASE WHEN p_size % 3 = 0 THEN 'obligation' ELSE 'assertion' END,
          '","inv":', CASE WHEN p_size % 5 = 0 THEN '"text"' ELSE concat('{"kind":"atomic","name":"<","args":[{"kind":"var","name":"x"},{"kind":"const","value":', CAST(p_size AS STRING), '}]}') END,
          CASE WHEN p_size % 7 = 0 THEN ',"evidence":{"proofType":"custom"}' ELSE '' END, '}}') AS body FROM part""",
    "ledger": """
        SELECT d.source AS file, CASE WHEN l.quality IS NULL THEN 'unclassified' WHEN l.toxic = 1 THEN 'refused' WHEN l.quality = 1 THEN 'discharged' ELSE 'other' END AS state
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "witnesses": "SELECT page_id, {sha:html} AS body_cid, CASE WHEN page_id % 9 = 0 THEN 'drifted' ELSE {sha:html} END AS pin, page_id % 4 <> 0 AS signed, CASE WHEN page_id % 17 = 0 THEN 'failed' ELSE 'passed' END AS outcome, page_id % 23 <> 0 AS found FROM pages",
    "members": "SELECT concat('b', CAST(l_orderkey % 97 AS STRING)) AS bundle_cid, concat('c:part:', CAST(l_partkey AS STRING)) AS member_cid, l_orderkey * 10 + l_linenumber AS load_seq FROM lineitem",
    "runs": """
        SELECT CAST(l_orderkey AS STRING) AS obligation, concat('s', CAST(l_suppkey % 4 AS STRING)) AS solver, CAST(l_linenumber AS BIGINT) AS step, CAST(l_quantity AS BIGINT) AS wall_ms,
          CASE WHEN l_linenumber % 4 = 0 THEN 'timeout' WHEN l_returnflag = 'R' THEN 'unsatisfied' WHEN l_returnflag = 'A' THEN 'discharged' ELSE 'undecidable' END AS verdict,
          concat('v', CAST(l_linenumber AS STRING)) AS version, l_orderkey * 10 + l_linenumber AS seq FROM lineitem""",
    "evidence": "SELECT user_id, CASE WHEN event_id % 29 = 0 THEN 'refuse' WHEN event_id % 6 = 0 THEN 'lossy' ELSE 'exact' END AS verdict, event_type AS dimension, concat('d', CAST(event_id % 4 AS STRING)) AS formula FROM events",
    "loci": "SELECT concat('s', CAST(p_size AS STRING)) AS file, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE concat(p_brand, '.', replace(p_type, ' ', '.')) END AS path, p_brand AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'warranted' ELSE 'refused' END AS status FROM part",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(name: str, engine: str) -> str:
    form = "sha2({}, 256)" if engine == "spark" else "sha256({})"
    return re.sub(r"\{sha:(\w+)\}", lambda m: form.format(m[1]), VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a table as a DataFrame; only the tables it names are read."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return over(spark, name, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))


def over(spark: SparkSession, name: str, table: Callable[[str], DataFrame]) -> DataFrame:
    """A view over tables that are given by name."""
    sql = text(name, "spark").replace("{", "{{").replace("}", "}}")
    used = {t: table(t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """DuckDB text with the views that it names as common tables."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({text(v, 'duckdb')})" for v in used)
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
