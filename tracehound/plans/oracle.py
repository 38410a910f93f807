"""DuckDB oracle SQL for :mod:`tracehound.plans.queries`.

Independent formulations: walks are recursive CTEs (``UNION`` + ``min(hop)``), caps are
``row_number`` over the whole walk, the catalog is rebuilt from the raw tables in SQL.
The fixed values (platforms, notes, symptoms, patterns) are imported from the library so
both sides use the same constants.
"""

from __future__ import annotations

from ..operators import containment as C
from ..functions import text as TX
from ..operators import ranking as R
from ..operators.signals import TEXT_RULES
from ..sources import fk_catalog as FK
from . import queries as Q
from . import report as RP

NL = "chr(10)"
LINE = "(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR))"


def _s(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def U(table: str, key_sql: str) -> str:
    return (f"('urn:li:dataset:(urn:li:dataPlatform:{FK.PLATFORM[table]},{table}.' || "
            f"CAST({key_sql} AS VARCHAR) || ',PROD)')")


def _note(key_sql: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {_s(t)}" for i, t in sorted(FK.NOTES.items()))
    return f"(CASE ({key_sql}) % {FK.NOTE_MOD} {whens} END)"


def _fields(table: str) -> str:
    return _s(", ".join(FK.SCHEMA_FIELDS[table]))


def _ncols(table: str) -> int:
    return len(FK.SCHEMA_FIELDS[table])


FK_EDGES = f"""fk_edges AS (
  SELECT DISTINCT upstream, downstream FROM (
    SELECT {U('region', 'n_regionkey')} AS upstream, {U('nation', 'n_nationkey')} AS downstream FROM nation
    UNION ALL SELECT {U('nation', 'c_nationkey')}, {U('customer', 'c_custkey')} FROM customer
    UNION ALL SELECT {U('nation', 's_nationkey')}, {U('supplier', 's_suppkey')} FROM supplier
    UNION ALL SELECT {U('customer', 'o_custkey')}, {U('orders', 'o_orderkey')} FROM orders
    UNION ALL SELECT {U('orders', 'l_orderkey')}, {U('lineitem', LINE)} FROM lineitem
    UNION ALL SELECT {U('supplier', 'l_suppkey')}, {U('lineitem', LINE)} FROM lineitem
  ) x WHERE upstream IS NOT NULL AND downstream IS NOT NULL)"""

_SYM_CASE = "CASE max(l_returnflag) " + " ".join(
    f"WHEN {_s(k)} THEN {_s(v)}" for k, v in sorted(FK.SYMPTOMS.items())) + " END"

FK_INCIDENTS = f"""fk_incidents AS (
  SELECT 'L' || {LINE} AS incident_id, {_SYM_CASE} AS symptom, {U('lineitem', LINE)} AS affected_urn
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _ent(table, key, desc, owners_str, owner_prop, note_key, frm):
    return (f"SELECT {U(table, key)} AS urn, '{table}.' || CAST({key} AS VARCHAR) AS name, "
            f"'{FK.PLATFORM[table]}' AS platform, {desc} AS description, {owners_str} AS owners_str, "
            f"{owner_prop} AS owner_prop, {_note(note_key)} AS note, {_ncols(table)} AS n_cols, "
            f"{_fields(table)} AS fields_str FROM {frm}")


FK_ENTITIES = "fk_entities AS (\n  " + "\n  UNION ALL ".join([
    _ent("region", "r_regionkey", "'Region ' || r_name", "''", "lower(r_name) || '@geo'", "r_regionkey", "region"),
    _ent("nation", "n_nationkey", "'Nation ' || n_name", "'urn:li:corpuser:' || lower(n_name)", "NULL",
         "n_nationkey", "nation"),
    _ent("customer", "c_custkey", "c_name || ' (' || c_mktsegment || ')'", "''", "lower(c_mktsegment) || '@crm'",
         "c_custkey", "customer"),
    _ent("supplier", "s_suppkey", "s_name", "'urn:li:corpuser:procurement'", "NULL", "s_suppkey", "supplier"),
    _ent("orders", "o_orderkey", "'Order status ' || o_orderstatus || ', priority ' || o_orderpriority", "''",
         "'sales@' || lower(o_orderpriority)", "o_orderkey", "orders"),
    _ent("lineitem", LINE, "'Order line, ' || CAST(n_rows AS VARCHAR) || ' row(s)'", "''", "NULL", "l_orderkey",
         "(SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2) li"),
]) + ")"

OWNER_LABEL = "COALESCE(NULLIF(owners_str, ''), NULLIF(owner_prop, ''), 'unknown')"
COLS_LABEL = "(CAST(n_cols AS VARCHAR) || ' cols')"
PROPS_LABEL = "('run_status=success' || CASE WHEN note IS NOT NULL THEN '  last_run_note=' || note ELSE '' END)"
NODE_TEXT = f"concat_ws({NL}, description, owner_prop, 'success', note)"


def SUMMARY(hop_sql: str) -> str:
    return (f"('[' || CAST({hop_sql} AS VARCHAR) || ' hop] ' || COALESCE(NULLIF(name, ''), urn) || ' (' || "
            f"COALESCE(NULLIF(platform, ''), '?') || ', ' || {COLS_LABEL} || ', owner: ' || {OWNER_LABEL} || ')' "
            f"|| CASE WHEN {PROPS_LABEL} <> '' THEN {NL} || '    properties: ' || {PROPS_LABEL} ELSE '' END)")


def ITEM(hop_sql: str) -> str:
    return (f"('- ' || {SUMMARY(hop_sql)} || {NL} || '    urn: ' || urn || "
            f"CASE WHEN NULLIF(description, '') IS NOT NULL THEN {NL} || '    description: ' || description ELSE '' END"
            f" || CASE WHEN n_cols > 0 THEN {NL} || '    columns: ' || fields_str ELSE '' END)")


def _walk(name: str, starts_sql: str, upstream: bool, max_hops: int | None, edges: str = "fk_edges") -> str:
    nxt, cur = ("upstream", "downstream") if upstream else ("downstream", "upstream")
    bound = f" WHERE {name}.hop < {max_hops}" if max_hops is not None else ""
    return (f"{name}(incident_id, urn, hop) AS (SELECT incident_id, urn, 0 FROM ({starts_sql}) s "
            f"UNION SELECT {name}.incident_id, e.{nxt}, {name}.hop + 1 FROM {name} JOIN {edges} e "
            f"ON e.{cur} = {name}.urn{bound})")


def _nodes(walk_name: str, out: str, cap: int | None = None) -> str:
    base = f"SELECT incident_id, urn, min(hop) AS hop FROM {walk_name} GROUP BY incident_id, urn"
    if cap is None:
        return f"{out} AS ({base})"
    return (f"{out} AS (SELECT incident_id, urn, hop FROM (SELECT *, row_number() OVER (PARTITION BY incident_id "
            f"ORDER BY hop, urn) AS rn FROM ({base}) b) r WHERE rn <= {cap})")


INC_STARTS = "SELECT incident_id, affected_urn AS urn FROM fk_incidents"


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


# ---- signals ---------------------------------------------------------------------------------

def _classes_sql(text_sql: str, which: int, veto: bool) -> list[tuple[str, str]]:
    out = []
    for r in TEXT_RULES:
        cond = f"COALESCE(regexp_matches({text_sql}, {_s(r[which])}), false)"
        if veto and r[3]:
            cond += f" AND NOT COALESCE(regexp_matches({text_sql}, {_s(r[3])}), false)"
        out.append((r[0], cond))
    return out


TEXT_SIGNALS = "tsig AS (" + " UNION ALL ".join(
    f"SELECT urn, {_s(cls)} AS class, 'text' AS source, COALESCE(note, description) AS detail "
    f"FROM fk_entities WHERE {cond}"
    for cls, cond in _classes_sql(NODE_TEXT, 1, True)) + ")"

FRESH = f"""fresh AS (
  SELECT {U('customer', 'o_custkey')} AS urn, max(CAST(o_orderdate AS DATE)) AS last_day,
         (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS as_of
  FROM orders GROUP BY o_custkey)"""

DATA_SIGNALS = (f"dsig AS (SELECT urn, 'stale' AS class, 'data' AS source, 'last data ' || "
                f"CAST(last_day AS VARCHAR) || ', ' || CAST(date_diff('day', last_day, as_of) AS VARCHAR) || "
                f"' days before ' || CAST(as_of AS VARCHAR) AS detail FROM fresh "
                f"WHERE date_diff('day', last_day, as_of) > {Q.STALE_DAYS})")


def _fits(sym_sql: str) -> str:
    return "CASE s.class " + " ".join(
        f"WHEN {_s(r[0])} THEN COALESCE(regexp_matches({sym_sql}, {_s(r[2])}), false)" for r in TEXT_RULES) + \
        " ELSE false END"


RANKED = [
    FK_EDGES, FK_INCIDENTS, FK_ENTITIES, FRESH,
    _walk("w", INC_STARTS, True, None),
    _nodes("w", "ev"),
    TEXT_SIGNALS, DATA_SIGNALS,
    "sig AS (SELECT DISTINCT urn, class, source, detail FROM (SELECT * FROM tsig UNION ALL SELECT * FROM dsig) u)",
    f"""hits AS (SELECT ev.incident_id, ev.urn, s.class, s.source, s.detail,
        CASE WHEN s.source = 'data' THEN CASE WHEN {_fits('i.symptom')} THEN 4 ELSE 3 END
             ELSE CASE WHEN {_fits('i.symptom')} THEN 2 ELSE 1 END END AS score
        FROM ev JOIN sig s ON s.urn = ev.urn JOIN fk_incidents i ON i.incident_id = ev.incident_id)""",
    """best AS (SELECT incident_id, urn, score, class, source, detail FROM (SELECT *, row_number() OVER (
        PARTITION BY incident_id, urn ORDER BY score DESC, class, source) AS r FROM hits) h WHERE r = 1)""",
    """scored AS (SELECT ev.incident_id, ev.urn, ev.hop, COALESCE(b.score, 0) AS score, b.class, b.source,
        b.detail
        FROM ev LEFT JOIN best b ON b.incident_id = ev.incident_id AND b.urn = ev.urn)""",
    """inner_e AS (SELECT a.incident_id, e.upstream, e.downstream FROM fk_edges e
        JOIN ev a ON a.urn = e.downstream JOIN ev b ON b.incident_id = a.incident_id AND b.urn = e.upstream)""",
    f"""d(incident_id, urn, dist) AS (SELECT incident_id, urn, 0 FROM scored WHERE score > 0
        UNION SELECT d.incident_id, i.downstream, d.dist + 1 FROM d JOIN inner_e i
        ON i.incident_id = d.incident_id AND i.upstream = d.urn WHERE d.dist < 40)""",
    "dmin AS (SELECT incident_id, urn, min(dist) AS dist FROM d GROUP BY incident_id, urn)",
    """ranked AS (SELECT * FROM (SELECT s.*, dm.dist, row_number() OVER (PARTITION BY s.incident_id
        ORDER BY s.score DESC, dm.dist ASC NULLS LAST, s.hop DESC, s.urn) AS rank
        FROM scored s LEFT JOIN dmin dm ON dm.incident_id = s.incident_id AND dm.urn = s.urn WHERE s.hop > 0) x
        WHERE rank <= 3)""",
    """conf AS (SELECT *, CASE WHEN score = 4 THEN 'high' WHEN score > 0 OR dist = 1 THEN 'medium'
        ELSE 'low' END AS confidence FROM ranked)""",
    """gated AS (SELECT incident_id, urn, confidence, source FROM conf
        WHERE rank = 1 AND lower(confidence) IN ('high', 'medium') AND urn IS NOT NULL AND source = 'data')""",
]

CONTAINED = RANKED + [
    "roots AS (SELECT DISTINCT urn AS root_urn FROM gated)",
    _walk("bw", "SELECT root_urn AS incident_id, root_urn AS urn FROM roots", False, None),
    _nodes("bw", "bnodes_all"),
    "bnodes AS (SELECT incident_id AS root_urn, urn, hop FROM bnodes_all WHERE hop > 0)",
    f"""requested AS (SELECT DISTINCT root_urn AS entity_urn, {_s(C.QUARANTINE_TAG)} AS tag_urn FROM roots
        UNION SELECT DISTINCT urn, {_s(C.IMPACT_TAG)} FROM bnodes)""",
]


def _blast_sql(names: bool = False) -> str:
    starts = (f"SELECT {U('nation', 'n_nationkey')} AS incident_id, {U('nation', 'n_nationkey')} AS urn FROM nation "
              f"UNION ALL SELECT {U('supplier', 's_suppkey')}, {U('supplier', 's_suppkey')} FROM supplier")
    dash = " OR ".join(f"COALESCE(strpos(platform, {_s(m)}) > 0, false)" for m in C.DASHBOARD_MARKERS)
    return _with(FK_EDGES, FK_ENTITIES, _walk("bw", starts, False, None), _nodes("bw", "bn")) + (f"""
SELECT bn.incident_id AS root_urn, CAST(count(*) AS BIGINT) AS impacted_count,
  CAST(count(*) FILTER (WHERE ({dash})) AS BIGINT) AS n_dashboards, CAST(count(*) FILTER (WHERE NOT ({dash})) AS BIGINT) AS n_assets
FROM bn LEFT JOIN fk_entities e ON e.urn = bn.urn WHERE bn.hop > 0 GROUP BY bn.incident_id""" if not names else f"""
SELECT bn.incident_id AS root_urn, bn.urn, CAST(bn.hop AS BIGINT) AS hop, COALESCE(NULLIF(e.name, ''), bn.urn) AS label,
  ({dash}) AS is_dashboard FROM bn LEFT JOIN fk_entities e ON e.urn = bn.urn WHERE bn.hop > 0""")


EVIDENCE = [FK_EDGES, FK_INCIDENTS, FK_ENTITIES, _walk("w", INC_STARTS, True, None), _nodes("w", "ev")]

_URN_NAME = ("CASE WHEN len(string_split(rtrim(string_split(urn, '(')[-1], ')'), ',')) >= 2 "
             "THEN trim(string_split(rtrim(string_split(urn, '(')[-1], ')'), ',')[-2]) ELSE urn END")

_EVENT_URN = "('urn:li:dataset:(urn:li:dataPlatform:kafka,events.' || {} || ',PROD)')"

FAULTY = """faulty AS (SELECT event_id, ts, user_id, event_type,
  CASE WHEN day(ts) = 10 AND event_id % 11 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN day(ts) BETWEEN 12 AND 15 THEN '{"src": 1, ' || substr(props, 2) ELSE props END AS props
  FROM events WHERE day(ts) <> 20 OR event_id % 4 = 0)"""

VOLUME = f"""{FAULTY},
vd AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n_rows FROM faulty GROUP BY ALL),
va AS (SELECT *, avg(n_rows) OVER (PARTITION BY event_type ORDER BY (day - DATE '1970-01-01')
        RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS prior_avg FROM vd),
vol AS (SELECT *, n_rows / prior_avg AS ratio, COALESCE(n_rows / prior_avg < {Q.DROP_RATIO}, false) AS flagged FROM va)"""

ZERO = """zd AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders GROUP BY ALL),
zspan AS (SELECT o_orderpriority, min(day) AS f, (SELECT max(day) FROM zd) AS l FROM zd GROUP BY 1),
zcal AS (SELECT o_orderpriority, CAST(unnest(generate_series(f, l, INTERVAL 1 DAY)) AS DATE) AS day FROM zspan),
zero AS (SELECT c.o_orderpriority, c.day FROM zcal c ANTI JOIN zd USING (o_orderpriority, day))"""


PLACE = """place AS (SELECT o_orderkey, o_custkey, n_nationkey, n_regionkey, CAST(o_orderdate AS DATE) AS day
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def _spikes(rates: str, by: str, rows: int) -> str:
    """X2 in SQL: the built-in windowed median and median absolute deviation."""
    return f"""rated AS (SELECT *, n_null / n_rows AS null_rate FROM {rates}),
based AS (SELECT *, median(null_rate) OVER w AS med, mad(null_rate) OVER w AS dev, count(*) OVER w AS c FROM rated
  WINDOW w AS (PARTITION BY {by}, "column" ORDER BY day ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)),
spikes AS (SELECT *, c >= 3 AND COALESCE(null_rate > med + greatest(5.0 * 1.4826 * dev, 0.02), false) AS spike FROM based)"""


RESULTS = f"""rv AS (SELECT n_regionkey, day, count(*) AS n FROM place WHERE day IS NOT NULL GROUP BY ALL),
rva AS (SELECT *, avg(n) OVER (PARTITION BY n_regionkey ORDER BY (day - DATE '1970-01-01') RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS prior FROM rv),
sl AS (SELECT l_orderkey, s_suppkey, s_nationkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, l_discount FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey WHERE l_shipdate IS NOT NULL),
nr AS (SELECT s_nationkey, m AS day, 'l_discount' AS "column", count(*) AS n_rows, sum(CASE WHEN l_discount IS NULL OR (month(m) IN (4, 10) AND l_orderkey % 5 = 0
  AND s_nationkey % 3 = 0) THEN 1 ELSE 0 END) AS n_null FROM sl GROUP BY 1, 2),
{_spikes('nr', 's_nationkey', 12)},
sm AS (SELECT s_suppkey, m, s_suppkey % 7 = 3 AND (12 * year(m) + month(m)) % 8 = 0 AS other FROM (SELECT DISTINCT s_suppkey, m FROM sl) x),
sc AS (SELECT *, COALESCE(other <> lag(other) OVER (PARTITION BY s_suppkey ORDER BY m), false) AS changed FROM sm),
cd AS (SELECT o_custkey, day, lead(day) OVER (PARTITION BY o_custkey ORDER BY day) AS nxt FROM (SELECT DISTINCT o_custkey, day FROM place WHERE day IS NOT NULL) x),
nd AS (SELECT DISTINCT n_nationkey, day FROM place WHERE day IS NOT NULL),
ncal AS (SELECT n_nationkey, CAST(unnest(generate_series(min(day), (SELECT max(day) FROM nd), INTERVAL 1 DAY)) AS DATE) AS day FROM nd GROUP BY 1),
nisl AS (SELECT n_nationkey, min(day) AS f, max(day) AS l FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY day) AS INT) AS island
  FROM ncal ANTI JOIN nd USING (n_nationkey, day)) x GROUP BY n_nationkey, island HAVING count(*) >= {Q.SILENT_DAYS}),
res AS (
  SELECT {U('region', 'n_regionkey')} AS urn, day AS as_of, 'volume' AS "check", 'volume' AS class, COALESCE(n / prior < {Q.FUSED_DROP}, false) AS flagged,
    n / prior AS measure, 'volume: rows ' || n AS detail FROM rva
  UNION ALL SELECT {U('nation', 's_nationkey')}, last_day(day), 'nulls', 'drift', spike, null_rate, 'nulls: l_discount null in ' || n_null FROM spikes
  UNION ALL SELECT {U('supplier', 's_suppkey')}, m, 'schema', 'drift', changed, CASE WHEN changed THEN 1.0 ELSE 0.0 END,
    'schema: ' || CASE WHEN changed THEN '1' ELSE '0' END || ' columns changed' FROM sc
  UNION ALL SELECT {U('customer', 'o_custkey')}, day, 'freshness', 'stale', false, 0.0, 'freshness: fresh' FROM cd
  UNION ALL SELECT {U('customer', 'o_custkey')}, day + {Q.STALE_DAYS + 1}, 'freshness', 'stale', true, {float(Q.STALE_DAYS + 1)}, 'freshness: no data since ' || day FROM cd
    WHERE day + {Q.STALE_DAYS + 1} < COALESCE(nxt, (SELECT max(day) FROM cd) + 1)
  UNION ALL SELECT {U('nation', 'n_nationkey')}, f + {Q.SILENT_DAYS - 1}, 'zero_rows', 'stale', true, {float(Q.SILENT_DAYS)}, 'zero_rows: no rows since ' || f FROM nisl
  UNION ALL SELECT {U('nation', 'n_nationkey')}, l + 1, 'zero_rows', 'stale', false, 0.0, 'zero_rows: rows again' FROM nisl WHERE l < (SELECT max(day) FROM nd))"""


def _table_of(col: str) -> str:
    return f"regexp_extract({col}, 'dataPlatform:[^,]+,([a-z]+)[.]', 1)"


def _turn(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FK.PLATFORM.items())
    return f"('urn:li:dataset:(urn:li:dataPlatform:' || CASE {col} {whens} END || ',' || {col} || ',PROD)')"


def _sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["walk_upstream"] = _with(FK_EDGES, FK_INCIDENTS, _walk("w", INC_STARTS, True, Q.UP_HOPS)) + \
        "SELECT incident_id, urn, CAST(min(hop) AS BIGINT) AS hop FROM w GROUP BY incident_id, urn"
    region_starts = f"SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS incident_id, {U('region', 'r_regionkey')} AS urn FROM region"
    s["walk_downstream"] = _with(FK_EDGES, _walk("w", region_starts, False, None)) + \
        "SELECT incident_id, urn, CAST(min(hop) AS BIGINT) AS hop FROM w GROUP BY incident_id, urn"
    order_starts = f"SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS incident_id, {U('orders', 'o_orderkey')} AS urn FROM orders"
    s["walk_multi_source"] = _with(FK_EDGES, _walk("w", order_starts, True, None)) + \
        "SELECT incident_id, urn, CAST(min(hop) AS BIGINT) AS hop FROM w GROUP BY incident_id, urn"
    cs_starts = (f"SELECT {U('customer', 'c_custkey')} AS incident_id, {U('customer', 'c_custkey')} AS urn FROM customer "
                 f"UNION ALL SELECT {U('supplier', 's_suppkey')}, {U('supplier', 's_suppkey')} FROM supplier")
    s["walk_capped"] = _with(FK_EDGES, _walk("w", cs_starts, False, Q.DOWN_HOPS), _nodes("w", "n", Q.DOWN_CAP)) + \
        "SELECT incident_id, urn, CAST(hop AS BIGINT) AS hop FROM n"
    ns_starts = (f"SELECT {U('nation', 'n_nationkey')} AS incident_id, {U('nation', 'n_nationkey')} AS urn FROM nation "
                 f"UNION ALL SELECT {U('supplier', 's_suppkey')}, {U('supplier', 's_suppkey')} FROM supplier")
    capped_edges = (f"capped_edges AS (SELECT upstream, downstream FROM (SELECT *, row_number() OVER "
                    f"(PARTITION BY upstream ORDER BY downstream) AS rn FROM fk_edges) x WHERE rn <= {Q.DRAW_PER_NODE})")
    s["walk_per_node_cap"] = _with(FK_EDGES, capped_edges, _walk("w", ns_starts, False, Q.DRAW_HOPS, "capped_edges"),
                                   _nodes("w", "n", Q.DRAW_CAP)) + \
        "SELECT incident_id, urn, CAST(hop AS BIGINT) AS hop FROM n"
    ev_edges = (f"ev_edges AS (SELECT DISTINCT {_EVENT_URN.format('event_type')} AS upstream, "
                f"{_EVENT_URN.format('next_type')} AS downstream FROM (SELECT event_type, lead(event_type) OVER "
                f"(PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events) t WHERE next_type IS NOT NULL)")
    ev_starts = f"SELECT DISTINCT event_type AS incident_id, {_EVENT_URN.format('event_type')} AS urn FROM events"
    s["walk_cyclic"] = _with(ev_edges, _walk("w", ev_starts, False, 0, "ev_edges").replace("w.hop < 0", "w.hop < (SELECT count(DISTINCT event_type) FROM events)")) + \
        "SELECT incident_id, urn, CAST(min(hop) AS BIGINT) AS hop FROM w GROUP BY incident_id, urn"
    s["walk_edges"] = _with(FK_EDGES, FK_INCIDENTS, _walk("w", INC_STARTS, True, Q.UP_HOPS), _nodes("w", "n")) + f"""
SELECT DISTINCT n.incident_id, e.upstream, e.downstream FROM n JOIN fk_edges e ON e.downstream = n.urn
JOIN n m ON m.incident_id = n.incident_id AND m.urn = e.upstream WHERE n.hop < {Q.UP_HOPS}"""
    s["chain_edges"] = f"""SELECT chain, upstream, downstream FROM (SELECT {U('customer', 'o_custkey')} AS chain,
  {U('orders', 'o_orderkey')} AS upstream, lead({U('orders', 'o_orderkey')}) OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate, o_orderkey) AS downstream FROM orders) t WHERE downstream IS NOT NULL"""
    s["entity_enrich"] = _with(*EVIDENCE) + f"""SELECT ev.incident_id, ev.urn, CAST(ev.hop AS BIGINT) AS hop, e.name,
  e.platform, e.description, {OWNER_LABEL} AS owner FROM ev LEFT JOIN fk_entities e ON e.urn = ev.urn"""
    s["node_summary"] = _with(*EVIDENCE) + f"""SELECT ev.incident_id, urn, {SUMMARY('least(ev.hop, 1)')} AS summary
FROM ev JOIN fk_entities e USING (urn)"""
    s["evidence_block"] = _with(*EVIDENCE) + f"""SELECT ev.incident_id, urn, CAST(ev.hop AS BIGINT) AS hop, {ITEM('ev.hop')} AS line
FROM ev JOIN fk_entities e USING (urn)"""
    s["evidence_count"] = _with(*EVIDENCE) + \
        "SELECT incident_id, CAST(count(*) AS BIGINT) AS evidence_nodes FROM ev GROUP BY incident_id"
    s["urn_parse"] = _with(FK_ENTITIES) + f"""SELECT urn, {_URN_NAME} AS name,
  regexp_extract(urn, 'dataPlatform:([^,]+)', 1) AS platform, rtrim(string_split(urn, '(')[-1], ')') AS tail,
  string_split(urn, ':')[-1] AS short
FROM (SELECT urn FROM fk_entities UNION SELECT owners_str FROM fk_entities WHERE owners_str <> '') u"""
    s["owner_label"] = _with(FK_ENTITIES) + f"SELECT urn, {OWNER_LABEL} AS owner_label, {COLS_LABEL} AS cols_label FROM fk_entities"
    s["props_label"] = _with(FK_ENTITIES) + f"SELECT urn, {PROPS_LABEL} AS props_label FROM fk_entities"
    s["props_map"] = """SELECT event_id, key, json_extract_string(props, '$."' || key || '"') AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) t WHERE key IS NOT NULL AND key <> ''"""
    s["blast_radius"] = _blast_sql()
    s["blast_nodes"] = _blast_sql(names=True)
    sym_cols = ", ".join(f"CASE WHEN {c} THEN {_s(cls)} END" for cls, c in _classes_sql("symptom", 2, False))
    s["symptom_class"] = _with(FK_INCIDENTS) + f"SELECT incident_id, concat_ws(',', {sym_cols}) AS classes FROM fk_incidents"
    s["signals"] = _with(FK_ENTITIES, TEXT_SIGNALS) + "SELECT urn, class, source FROM tsig"
    s["rank_suspects"] = _with(*RANKED) + """SELECT incident_id, CAST(rank AS BIGINT) AS rank, urn,
  CAST(score AS BIGINT) AS score, CAST(dist AS BIGINT) AS dist, confidence FROM conf"""
    s["act_gate"] = _with(*RANKED) + "SELECT incident_id, urn, confidence, source FROM gated"
    s["tags_add"] = _with(*CONTAINED) + "SELECT entity_urn, tag_urn FROM requested"
    s["tags_verify"] = _with(*CONTAINED) + f"""SELECT entity_urn, tag_urn, true AS applied, false AS rejected FROM requested
UNION ALL SELECT {U('region', 'r_regionkey')}, {_s(Q.UNKNOWN_TAG)}, false, true FROM region"""
    s["tags_remove"] = _with(*CONTAINED) + \
        f"SELECT entity_urn, tag_urn FROM requested WHERE tag_urn <> {_s(C.QUARANTINE_TAG)}"
    s["writeback_proof"] = _with(*CONTAINED) + """SELECT g.incident_id, true AS root_quarantined,
  CAST(COALESCE(c.n, 0) AS BIGINT) AS downstream_tagged, COALESCE(c.n, 0) >= 1 AS pass,
  (SELECT count(*) FROM customer) + (SELECT count(*) FROM region) AS tags_removed
FROM gated g LEFT JOIN (SELECT root_urn, count(*) AS n FROM bnodes GROUP BY root_urn) c ON c.root_urn = g.urn"""
    s["volume_anomaly"] = "WITH " + VOLUME + """
SELECT event_type, CAST(day AS VARCHAR) AS day, n_rows, round(prior_avg, 4) AS prior_avg, round(ratio, 4) AS ratio,
  flagged FROM vol"""
    cols = Q.EVENT_COLUMNS
    sums = ", ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {c}" for c in cols)
    s["null_rate"] = f"""WITH {FAULTY}, daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n_rows, {sums} FROM faulty GROUP BY 1),
long AS (UNPIVOT daily ON {', '.join(cols)} INTO NAME "column" VALUE n_null),
r AS (SELECT *, n_null / n_rows AS null_rate FROM long),
p AS (SELECT *, lag(null_rate) OVER (PARTITION BY "column" ORDER BY day) AS prev_rate FROM r)
SELECT CAST(day AS VARCHAR) AS day, "column", n_rows, CAST(n_null AS BIGINT) AS n_null, round(null_rate, 6) AS null_rate,
  round(prev_rate, 6) AS prev_rate, round(null_rate - prev_rate, 6) AS delta FROM p"""
    feed = [c for c in cols if c != "event_type"]
    sums = ", ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {c}" for c in feed)
    s["null_spikes"] = f"""WITH {FAULTY}, daily AS (SELECT event_type AS feed, CAST(f.ts AS DATE) AS day, count(*) AS n_rows, {sums} FROM faulty f GROUP BY 1, 2),
long AS (UNPIVOT daily ON {', '.join(feed)} INTO NAME "column" VALUE n_null),
{_spikes('long', 'feed', 14)}
SELECT feed AS event_type, CAST(day AS VARCHAR) AS day, "column", CAST(n_null AS BIGINT) AS n_null, round(null_rate, 6) AS null_rate,
  round(med, 6) AS median, round(dev, 6) AS mad, spike FROM spikes"""
    s["column_diff"] = """WITH p AS (SELECT event_type, CAST(ts AS DATE) AS day, day(ts) AS d FROM events WHERE day(ts) <> 17 AND props IS NOT NULL),
cols AS (SELECT DISTINCT event_type, day, unnest(CASE WHEN d < 15 THEN ['k'] ELSE ['key'] END) AS "column", 'number' AS type FROM p
  UNION SELECT DISTINCT event_type, day, unnest(CASE WHEN d < 22 THEN ['lat', 'lon'] ELSE ['latitude', 'longitude'] END) AS c,
    CASE WHEN d = 26 AND c = 'latitude' THEN 'text' ELSE 'number' END FROM p),
days AS (SELECT event_type, day, lag(day) OVER (PARTITION BY event_type ORDER BY day) AS prev FROM (SELECT DISTINCT event_type, day FROM cols) x),
added AS (SELECT n.event_type, n.day, d.prev, n."column", n.type FROM cols n JOIN days d USING (event_type, day) WHERE d.prev IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM cols o WHERE o.event_type = n.event_type AND o.day = d.prev AND o."column" = n."column")),
dropped AS (SELECT o.event_type, d.day, d.prev, o."column", o.type FROM days d JOIN cols o ON o.event_type = d.event_type AND o.day = d.prev
  WHERE NOT EXISTS (SELECT 1 FROM cols n WHERE n.event_type = d.event_type AND n.day = d.day AND n."column" = o."column")),
retyped AS (SELECT n.event_type, n.day, d.prev, n."column", n.type FROM cols n JOIN days d USING (event_type, day)
  JOIN cols o ON o.event_type = d.event_type AND o.day = d.prev AND o."column" = n."column" WHERE o.type <> n.type),
cand AS (SELECT a.event_type, a.day, a.prev, a.type, d."column" AS old, a."column" AS new, levenshtein(d."column", a."column") AS edits
  FROM dropped d JOIN added a USING (event_type, day, type) WHERE levenshtein(d."column", a."column") <= 6 OR contains(a."column", d."column")
    OR contains(d."column", a."column")),
ren AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand x WHERE x.event_type = c.event_type AND x.day = c.day AND x.type = c.type AND
  ((x.old = c.old AND (x.edits, x.new) < (c.edits, c.new)) OR (x.new = c.new AND (x.edits, x.old) < (c.edits, c.old)))))
SELECT event_type, CAST(day AS VARCHAR) AS snapshot, CAST(prev AS VARCHAR) AS prev_snapshot, change, "column", type, renamed_to FROM (
  SELECT event_type, day, prev, 'retyped' AS change, "column", type, NULL AS renamed_to FROM retyped
  UNION ALL SELECT event_type, day, prev, 'renamed', old, type, new FROM ren
  UNION ALL SELECT event_type, day, prev, 'added', "column", type, NULL FROM added a WHERE NOT EXISTS (
    SELECT 1 FROM ren WHERE ren.event_type = a.event_type AND ren.day = a.day AND ren.new = a."column" AND ren.type = a.type)
  UNION ALL SELECT event_type, day, prev, 'dropped', "column", type, NULL FROM dropped d WHERE NOT EXISTS (
    SELECT 1 FROM ren WHERE ren.event_type = d.event_type AND ren.day = d.day AND ren.old = d."column" AND ren.type = d.type)) x"""
    s["zero_row_runs"] = """WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate IS NOT NULL),
cal AS (SELECT o_custkey, CAST(unnest(generate_series(min(day), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1),
z AS (SELECT * FROM cal ANTI JOIN d USING (o_custkey, day)),
g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS INT) AS island FROM z)
SELECT o_custkey, CAST(min(day) AS VARCHAR) AS start, CAST(max(day) AS VARCHAR) AS "end", count(*) AS n_days,
  max(day) = (SELECT max(day) FROM d) AS open FROM g GROUP BY o_custkey, island"""
    s["volume_regions"] = "WITH " + PLACE + f""", vr AS (SELECT n_regionkey, day, count(*) AS n_rows FROM place GROUP BY ALL),
va AS (SELECT *, avg(n_rows) OVER (PARTITION BY n_regionkey ORDER BY (day - DATE '1970-01-01') RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS prior FROM vr)
SELECT n_regionkey, CAST(day AS VARCHAR) AS day, n_rows, round(prior, 4) AS prior_avg, COALESCE(n_rows / prior < {Q.FUSED_DROP}, false) AS flagged FROM va"""
    s["first_drop"] = _with(FK_EDGES, PLACE, f"""te AS (SELECT DISTINCT {_table_of('upstream')} AS u, {_table_of('downstream')} AS v FROM fk_edges),
ord AS (SELECT p.*, day(day) <> 20 OR o_orderkey % 4 = 0 AS kept, (SELECT count(*) FROM lineitem WHERE l_orderkey = p.o_orderkey) AS lines
  FROM place p WHERE day IS NOT NULL),
vol AS (SELECT day, unnest(['region', 'nation', 'customer', 'orders', 'supplier', 'lineitem']) AS t, unnest([count(*), count(*), count(*) FILTER (WHERE kept),
  count(*) FILTER (WHERE kept), CAST(sum(lines) AS BIGINT), CAST(COALESCE(sum(lines) FILTER (WHERE kept), 0) AS BIGINT)]) AS n FROM ord GROUP BY day),
hv AS (SELECT te.u, te.v, a.day, a.n AS up, b.n AS down, CASE WHEN a.n <> 0 THEN b.n / a.n END AS ratio FROM te JOIN vol a ON a.t = te.u JOIN vol b ON b.t = te.v AND b.day = a.day),
br AS (SELECT *, avg(ratio) OVER w AS usual, count(ratio) OVER w AS c FROM hv WINDOW w AS (PARTITION BY u, v ORDER BY (day - DATE '1970-01-01')
  RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
bad AS (SELECT *, row_number() OVER () AS id FROM br WHERE c >= 3 AND ratio < {Q.DROP_RATIO} * usual)""",
        "below(id, day, t, hop) AS (SELECT id, day, v, 1 FROM bad UNION SELECT b.id, b.day, te.v, b.hop + 1 FROM below b JOIN te ON te.u = b.t WHERE b.hop < 10)") + f"""
SELECT CAST(x.day AS VARCHAR) AS day, {_turn('x.u')} AS upstream, {_turn('x.v')} AS downstream, round(x.ratio, 4) AS ratio, round(x.usual, 4) AS usual,
  {_turn('b.t')} AS urn, CAST(min(b.hop) AS BIGINT) AS hops
FROM bad x JOIN below b ON b.id = x.id WHERE NOT EXISTS (SELECT 1 FROM below y WHERE y.day = x.day AND y.t = x.u)
GROUP BY x.id, x.day, x.u, x.v, x.ratio, x.usual, b.t"""
    s["check_results"] = "WITH " + PLACE + ", " + RESULTS + """
SELECT urn, CAST(as_of AS VARCHAR) AS as_of, "check", class, flagged, round(measure, 4) AS measure, detail FROM res"""
    s["rank_fused"] = _with(FK_EDGES, FK_INCIDENTS, FK_ENTITIES, _walk("w", INC_STARTS, True, None), _nodes("w", "ev"), TEXT_SIGNALS, PLACE, RESULTS,
        f"""dated AS (SELECT 'L' || {LINE} AS incident_id, CAST(max(l_shipdate) AS DATE) AS day FROM lineitem GROUP BY l_orderkey, l_linenumber),
pairs AS (SELECT DISTINCT urn, day FROM ev JOIN dated USING (incident_id)),
one AS (SELECT urn, "check", as_of, arg_max(struct_pack(class := class, flagged := flagged, detail := detail), (flagged, detail)) AS r FROM res GROUP BY 1, 2, 3),
ask AS (SELECT p.urn, p.day, c."check" FROM pairs p JOIN (SELECT DISTINCT urn, "check" FROM one) c USING (urn)),
seen AS (SELECT a.urn, a.day, o.as_of, o.r FROM ask a ASOF JOIN one o ON o.urn = a.urn AND o."check" = a."check" AND a.day >= o.as_of),
sig AS (SELECT urn, day, r.class AS class, 'data' AS source, r.detail AS detail FROM seen WHERE r.flagged AND date_diff('day', as_of, day) <= {Q.RESULT_AGE}
  UNION ALL SELECT DISTINCT p.urn, p.day, t.class, t.source, t.detail FROM pairs p JOIN tsig t USING (urn)),
hits AS (SELECT ev.incident_id, ev.urn, s.class, s.source, s.detail,
  CASE WHEN s.source = 'data' THEN CASE WHEN {_fits('i.symptom')} THEN 4 ELSE 3 END ELSE CASE WHEN {_fits('i.symptom')} THEN 2 ELSE 1 END END AS score
  FROM ev JOIN dated dt ON dt.incident_id = ev.incident_id JOIN sig s ON s.urn = ev.urn AND s.day = dt.day JOIN fk_incidents i ON i.incident_id = ev.incident_id),
best AS (SELECT incident_id, urn, score, class, source, detail FROM (SELECT *, row_number() OVER (
  PARTITION BY incident_id, urn ORDER BY score DESC, class, source, detail DESC) AS r FROM hits) h WHERE r = 1)""", *RANKED[11:17]) + """
SELECT incident_id, CAST(rank AS BIGINT) AS rank, urn, CAST(score AS BIGINT) AS score, CAST(dist AS BIGINT) AS dist, class, source, confidence,
  CASE WHEN score > 0 THEN source || ' signal (' || class || '): ' || COALESCE(detail, '') WHEN dist IS NOT NULL THEN 'downstream of a flagged node ('
    || CAST(dist AS VARCHAR) || ' hop(s)); no signal of its own' ELSE 'on the upstream path of the symptom; no signal found' END AS why FROM conf"""
    num = "CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT)"
    s["answers_entities"] = _with(FK_ENTITIES) + f""", k AS (SELECT *, {num} AS k, {num} % 6 AS v FROM fk_entities),
  r AS (SELECT *, CASE WHEN k % 11 = 10 THEN 'malformed' WHEN k % 13 = 12 THEN 'empty' WHEN k % 17 = 16 THEN 'malformed' END AS reject FROM k)
SELECT name AS answer_id, reject, urn_ AS urn, n AS name, p AS platform, d AS description, o AS owners, f AS fields, x AS props, g AS tags FROM (SELECT name, reject,
  CASE WHEN reject IS NULL THEN urn END AS urn_, CASE WHEN reject IS NULL THEN CASE v WHEN 0 THEN name || ' (stored)' ELSE name END END AS n,
  CASE WHEN reject IS NULL THEN platform END AS p,
  CASE WHEN reject IS NULL THEN CASE v WHEN 3 THEN 'edited: ' || description WHEN 4 THEN NULL ELSE description END END AS d,
  CASE WHEN reject IS NULL THEN owners_str END AS o, CASE WHEN reject IS NULL THEN fields_str END AS f,
  CASE WHEN reject IS NULL THEN CASE WHEN v = 4 THEN '' ELSE concat_ws('|', 'last_run_note=' || note, 'owner=' || owner_prop, 'run_status=success') END END AS x,
  CASE WHEN reject IS NULL THEN CASE WHEN k % 4 = 0 THEN {_s(C.IMPACT_TAG)} ELSE '' END END AS g FROM r) y"""
    s["answers_lineage"] = _with(FK_EDGES) + """, k AS (SELECT downstream, upstream,
  CAST(regexp_extract(downstream, 'dataPlatform:[^,]+,[a-z]+[.]([0-9]+)', 1) AS BIGINT) AS k FROM fk_edges)
SELECT downstream AS start_urn, upstream AS urn, NULL AS reject FROM k WHERE k % 7 <> 3 AND k % 5 <> 0
UNION ALL SELECT DISTINCT downstream, NULL, 'malformed' FROM k WHERE k % 7 = 3"""
    s["entity_lookup"] = _with(FK_ENTITIES) + f"""SELECT urn, name, platform FROM fk_entities
WHERE urn IN (SELECT {U('supplier', 'l_suppkey')} FROM lineitem)"""
    s["guarded_answers"] = _with(FK_EDGES, FK_INCIDENTS, _walk("w", INC_STARTS, True, None), _nodes("w", "ev"),
        f"""named AS (SELECT incident_id, 1 AS rank, {U('orders', "split_part(substr(incident_id, 2), '-', 1)")} AS urn FROM fk_incidents
  UNION ALL SELECT incident_id, 2, {U('customer', "split_part(incident_id, '-', 2)")} FROM fk_incidents)""") + """
SELECT n.incident_id, CAST(n.rank AS BIGINT) AS rank, n.urn FROM named n JOIN ev ON ev.incident_id = n.incident_id AND ev.urn = n.urn"""
    s["vocab_ensure"] = f"""SELECT 'urn:li:tag:' || n_name AS tag_urn, n_name AS name, 'of a nation' AS description FROM nation
UNION ALL SELECT {_s(C.QUARANTINE_TAG)}, 'ours', r_name FROM region WHERE r_regionkey = 0
UNION ALL SELECT {_s(C.IMPACT_TAG)}, {_s(C.IMPACT_TAG.split(":")[-1])}, 'Reads, directly or not, from a quarantined asset.'"""
    s["upsert_entities"] = f"""WITH o AS (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1)
SELECT COALESCE({U('customer', 'c_custkey')}, {U('customer', 'o_custkey')}) AS urn,
  CASE WHEN k IS NULL THEN c_name ELSE 'customer.' || o_custkey END AS name, CASE WHEN k IS NULL THEN 'never ordered' ELSE 'ordered ' || k || ' ' || p END AS description,
  COALESCE(k, -1) AS version FROM customer FULL JOIN o ON o_custkey = c_custkey"""
    expected = f"""expd AS (SELECT 'L' || {LINE} AS incident_id, 'supplier.' || max(l_suppkey) || ',' AS expected_root FROM lineitem GROUP BY l_orderkey, l_linenumber),
  scen AS (SELECT x.incident_id, x.expected_root, c.urn AS top_urn, COALESCE(strpos(c.urn, x.expected_root) > 0, false) AS ok
  FROM expd x LEFT JOIN conf c ON c.incident_id = x.incident_id AND c.rank = 1)"""
    s["scenario_results"] = _with(*RANKED) + ", " + expected + " SELECT incident_id, expected_root, top_urn, ok FROM scen"
    s["scenario_score"] = _with(*RANKED) + ", " + expected + """ SELECT CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS passed, count(*) AS total,
  bool_and(ok) AS all_passed FROM scen"""
    s["action_status"] = _with(*CONTAINED) + f"""SELECT entity_urn, string_split(tag_urn, ':')[-1] AS tag, '[OK] APPLIED' AS status FROM requested
UNION ALL SELECT {U('region', 'r_regionkey')}, {_s(Q.UNKNOWN_TAG.split(":")[-1])}, '[..] attempted' FROM region"""
    s["evidence_columns"] = _with(*EVIDENCE) + f"""SELECT ev.incident_id, urn, CAST(ev.hop AS BIGINT) AS hop,
  {ITEM('ev.hop').replace('|| fields_str', "|| array_to_string(string_split(fields_str, ', ')[1:4], ', ')")} AS line FROM ev JOIN fk_entities e USING (urn)"""
    s["incident_stream"] = _with(FK_INCIDENTS) + "SELECT incident_id, symptom, affected_urn FROM fk_incidents"
    s["schema_diff"] = "WITH " + FAULTY + """, keys AS (SELECT DISTINCT CAST(ts AS DATE) AS day, unnest(json_keys(props)) AS key FROM faulty WHERE day(ts) <> 12),
days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM faulty WHERE day(ts) <> 12),
pairs AS (SELECT a.day, max(b.day) AS prev_day FROM days a JOIN days b ON b.day < a.day GROUP BY a.day)
SELECT CAST(p.day AS VARCHAR) AS day, k.key, 'added' AS change FROM pairs p JOIN keys k ON k.day = p.day
  WHERE NOT EXISTS (SELECT 1 FROM keys b WHERE b.day = p.prev_day AND b.key = k.key)
UNION ALL
SELECT CAST(p.day AS VARCHAR), b.key, 'dropped' FROM pairs p JOIN keys b ON b.day = p.prev_day
  WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.day = p.day AND k.key = b.key)"""
    s["freshness"] = "WITH " + FRESH + f"""
SELECT urn, CAST(last_day AS VARCHAR) AS last_day, CAST(as_of AS VARCHAR) AS as_of,
  CAST(date_diff('day', last_day, as_of) AS BIGINT) AS lag_days, date_diff('day', last_day, as_of) > {Q.STALE_DAYS} AS stale
FROM fresh"""
    s["zero_row_days"] = "WITH " + ZERO + "\nSELECT o_orderpriority, CAST(day AS VARCHAR) AS day FROM zero"
    s["hop_volume"] = f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders),
mo AS (SELECT day, count(*) AS n FROM o GROUP BY day),
ml AS (SELECT o.day, count(*) AS n FROM lineitem l JOIN o ON l.l_orderkey = o.o_orderkey GROUP BY o.day)
SELECT {_s(Q.ORDERS_TABLE_URN)} AS upstream, {_s(Q.LINEITEM_TABLE_URN)} AS downstream, CAST(mo.day AS VARCHAR) AS day,
  mo.n AS up_rows, COALESCE(ml.n, 0) AS down_rows, round(COALESCE(ml.n, 0) / mo.n, 4) AS ratio
FROM mo LEFT JOIN ml ON ml.day = mo.day"""
    s["signals_union"] = "WITH " + VOLUME + ",\n" + ZERO + ",\n" + FRESH + f"""
SELECT {_EVENT_URN.format('event_type')} AS urn, CAST(day AS VARCHAR) AS as_of, 'volume' AS class,
  round(ratio, 4) AS measure, round({Q.DROP_RATIO}, 4) AS threshold, 'data' AS source FROM vol WHERE flagged
UNION ALL
SELECT urn, CAST(as_of AS VARCHAR), 'stale', round(CAST(date_diff('day', last_day, as_of) AS DOUBLE), 4),
  round({float(Q.STALE_DAYS)}, 4), 'data' FROM fresh WHERE date_diff('day', last_day, as_of) > {Q.STALE_DAYS}
UNION ALL
SELECT 'urn:li:dataset:(urn:li:dataPlatform:looker,orders.priority.' || o_orderpriority || ',PROD)',
  CAST(day AS VARCHAR), 'stale', 0.0, 0.0, 'data' FROM zero"""
    miss_case = "CASE " + " ".join(
        f"WHEN {c} THEN {_s(R.MISSING[cls])}" for cls, c in _classes_sql("i.symptom", 2, False)) + \
        f" ELSE {_s(R.MISSING_NONE)} END"
    inv_ctes = f"""top1 AS (SELECT c.incident_id, e.name, c.class, c.source,
    c.confidence, c.score, c.source || ' signal (' || c.class || '): ' || COALESCE(c.detail, '') AS why
    FROM conf c JOIN fk_entities e ON e.urn = c.urn WHERE c.rank = 1),
  cnt AS (SELECT incident_id, count(*) AS n FROM ev GROUP BY incident_id),
  ns AS (SELECT incident_id, count(*) AS n_sus, max(score) AS max_score FROM conf GROUP BY incident_id),
  inv AS (SELECT i.incident_id, i.symptom, i.affected_urn,
  CASE WHEN t.score > 0 THEN 'Most likely root cause: ' || t.name || ' (' || t.class || ', ' || t.source ||
    ' signal, confidence ' || t.confidence || '). ' || t.why
  ELSE 'No signal found in ' || CAST(COALESCE(cnt.n, 0) AS VARCHAR) ||
    ' upstream nodes; suspects are ranked by position only.' END AS summary,
  CASE WHEN COALESCE(ns.max_score, 0) = 0 THEN {miss_case} END AS missing_evidence,
  CAST(COALESCE(cnt.n, 0) AS BIGINT) AS evidence_nodes, CAST(COALESCE(ns.n_sus, 0) AS BIGINT) AS n_suspects
FROM fk_incidents i LEFT JOIN top1 t ON t.incident_id = i.incident_id
  LEFT JOIN cnt ON cnt.incident_id = i.incident_id LEFT JOIN ns ON ns.incident_id = i.incident_id)"""
    s["investigate"] = _with(*RANKED) + ", " + inv_ctes + \
        "\nSELECT incident_id, summary, missing_evidence, evidence_nodes, evidence_nodes - 1 AS upstream_nodes, n_suspects FROM inv"
    icon = "CASE lower(c.confidence) " + " ".join(f"WHEN {_s(k)} THEN {_s(v)}" for k, v in TX.CONF_ICONS.items()) + \
        f" ELSE {_s(TX.UNKNOWN_ICON)} END"
    nxt = "CASE c.class " + " ".join(f"WHEN {_s(k)} THEN {_s(v)}" for k, v in R.CHECK_NEXT.items()) + \
        f" ELSE {_s(R.CHECK_NEXT_NONE)} END"
    why = ("CASE WHEN c.score > 0 THEN c.source || ' signal (' || c.class || '): ' || COALESCE(c.detail, '') "
           "WHEN c.dist IS NOT NULL THEN 'downstream of a flagged node (' || CAST(c.dist AS VARCHAR) || "
           "' hop(s)); no signal of its own' ELSE 'on the upstream path of the symptom; no signal found' END")
    dash = " OR ".join(f"COALESCE(strpos(e.platform, {_s(m)}) > 0, false)" for m in C.DASHBOARD_MARKERS)
    dash_e = dash
    s["report_json"] = _with(*RANKED) + ", " + inv_ctes + """, first AS (SELECT incident_id, urn FROM conf WHERE rank = 1)
SELECT inv.incident_id, summary, missing_evidence, missing_evidence IS NULL AS missing_is_null, evidence_nodes, first.urn AS top_urn
FROM inv LEFT JOIN first ON first.incident_id = inv.incident_id"""
    s["report_text"] = _with(*CONTAINED) + ", " + inv_ctes + f""",
  sus AS (SELECT c.incident_id, string_agg('suspect ' || CAST(c.rank AS VARCHAR) || ': ' || e.name || ' ' || {icon} || ' confidence ' ||
      lower(COALESCE(c.confidence, 'unknown')) || '; ask ' || COALESCE(NULLIF({OWNER_LABEL}, ''), {_s(TX.OWNER_UNKNOWN)}) || {NL} ||
      '- evidence: ' || {why} || {NL} || '- check: ' || {nxt}, {NL} ORDER BY c.rank) AS lines
    FROM conf c JOIN fk_entities e ON e.urn = c.urn GROUP BY c.incident_id),
  blast AS (SELECT b.root_urn, count(*) AS n, count(*) FILTER (WHERE {dash_e}) AS d
    FROM bnodes b JOIN fk_entities e ON e.urn = b.urn GROUP BY b.root_urn),
  acted AS (SELECT g.incident_id, e.name AS root_name, COALESCE(bl.n, 0) AS n, COALESCE(bl.d, 0) AS d
    FROM gated g JOIN fk_entities e ON e.urn = g.urn LEFT JOIN blast bl ON bl.root_urn = g.urn)
SELECT v.incident_id, concat_ws({NL}, {_s(RP.TITLE + " on ")} || rtrim(string_split(v.affected_urn, '(')[-1], ')'),
  'reported: ' || COALESCE(v.symptom, ''), 'finding: ' || v.summary,
  'nodes read, itself included: ' || CAST(v.evidence_nodes AS VARCHAR), su.lines,
  CASE WHEN COALESCE(v.missing_evidence, '') <> '' THEN 'still open: ' || v.missing_evidence END,
  'tag {C.QUARANTINE_TAG.split(":")[-1]} on ' || a.root_name || {_s(": " + TX.STATUS_APPLIED)},
  'reach: ' || CAST(a.n AS VARCHAR) || ' below it, of them dashboards ' || CAST(a.d AS VARCHAR) || ', others ' ||
    CAST(a.n - a.d AS VARCHAR) || ', tagged ' || CAST(a.n AS VARCHAR)) AS report_text
FROM inv v LEFT JOIN sus su ON su.incident_id = v.incident_id LEFT JOIN acted a ON a.incident_id = v.incident_id"""
    def q_(x):
        return f"replace({x}, '\"', '\\\"')"
    role = ("CASE WHEN n.urn = i.root THEN CASE WHEN COALESCE(i.applied, false) THEN 'quarantine' ELSE 'suspect' END "
            "WHEN n.urn = i.affected_urn THEN 'symptom' WHEN n.impacted THEN 'impacted' ELSE 'other' END")
    suffix = "CASE role " + " ".join(f"WHEN {_s(k)} THEN {_s(v[0])}" for k, v in RP._STYLE.items()) + " END"
    style = "CASE role " + " ".join(f"WHEN {_s(k)} THEN {_s(v[1])}" for k, v in RP._STYLE.items()) + " END"
    name = _URN_NAME.replace("urn", "n.urn")
    s["lineage_dot"] = _with(*CONTAINED) + f""",
  top AS (SELECT incident_id, urn FROM conf WHERE rank = 1),
  inc AS (SELECT i.incident_id, i.affected_urn, COALESCE(g.urn, t.urn) AS root,
      CASE WHEN g.urn IS NOT NULL THEN true END AS applied
    FROM fk_incidents i LEFT JOIN gated g ON g.incident_id = i.incident_id
      LEFT JOIN top t ON t.incident_id = i.incident_id),
  bn AS (SELECT i.incident_id, b.urn, b.hop FROM inc i JOIN bnodes b ON b.root_urn = i.root),
  nodes AS (SELECT incident_id, urn, bool_or(impacted) AS impacted FROM (
      SELECT incident_id, urn, false AS impacted FROM ev UNION ALL SELECT incident_id, urn, true FROM bn) u
    GROUP BY incident_id, urn),
  down_nodes AS (SELECT incident_id, urn FROM bn UNION SELECT incident_id, root FROM inc WHERE root IS NOT NULL),
  e_up AS (SELECT a.incident_id, e.upstream, e.downstream FROM ev a JOIN fk_edges e ON e.downstream = a.urn
      JOIN ev b ON b.incident_id = a.incident_id AND b.urn = e.upstream ),
  e_down AS (SELECT a.incident_id, e.upstream, e.downstream FROM down_nodes a JOIN fk_edges e ON e.upstream = a.urn
      JOIN down_nodes b ON b.incident_id = a.incident_id AND b.urn = e.downstream),
  all_edges AS (SELECT DISTINCT x.incident_id, x.upstream, x.downstream FROM (
      SELECT * FROM e_up UNION ALL SELECT * FROM e_down) x
    JOIN nodes nu ON nu.incident_id = x.incident_id AND nu.urn = x.upstream
    JOIN nodes nd ON nd.incident_id = x.incident_id AND nd.urn = x.downstream),
  roled AS (SELECT n.incident_id, n.urn, {role} AS role,
      CASE WHEN regexp_extract(n.urn, 'dataPlatform:([^,]+)', 1) <> ''
        THEN regexp_extract(n.urn, 'dataPlatform:([^,]+)', 1) || ': ' || {name} ELSE {name} END AS label
    FROM nodes n JOIN inc i ON i.incident_id = n.incident_id),
  lines AS (SELECT incident_id, 1 AS part, '"' || {q_('urn')} || '" [label="' || {q_('label')} || {suffix} || '" fillcolor=' || {style} ||
      ']' AS line FROM roled
    UNION ALL SELECT incident_id, 2, '"' || {q_('upstream')} || '" -> "' || {q_('downstream')} || '"' FROM all_edges
    UNION ALL SELECT incident_id, 0, unnest([{", ".join(_s(x) for x in RP.DOT_HEAD)}]) FROM inc
    UNION ALL SELECT incident_id, 3, '}}' FROM inc)
SELECT incident_id, CAST(part AS BIGINT) AS part, line FROM lines"""
    s["drawing_lines"] = s["lineage_dot"][:s["lineage_dot"].index(",\n  bn AS (")] + f""",
  styled AS (SELECT 'incident' AS scope, incident_id AS id, root AS urn, CASE WHEN COALESCE(applied, false) THEN 'quarantine' ELSE 'suspect' END AS role FROM inc WHERE root IS NOT NULL
    UNION ALL SELECT 'incident', incident_id, affected_urn, 'symptom' FROM inc WHERE affected_urn IS DISTINCT FROM root
    UNION ALL SELECT DISTINCT 'evidence', urn, urn, 'other' FROM ev
    UNION ALL SELECT 'root', root_urn, urn, 'impacted' FROM bnodes),
  labelled AS (SELECT scope, id, urn, role, CASE WHEN regexp_extract(n.urn, 'dataPlatform:([^,]+)', 1) <> ''
    THEN regexp_extract(n.urn, 'dataPlatform:([^,]+)', 1) || ': ' || {name} ELSE {name} END AS label FROM styled n),
  reach AS (SELECT root_urn, urn FROM bnodes UNION SELECT root_urn, root_urn FROM roots)
SELECT scope, id, CAST(1 AS BIGINT) AS part, '"' || {q_('urn')} || '" [label="' || {q_('label')} || {suffix} || '" fillcolor=' || {style} || ']' AS line FROM labelled
UNION ALL SELECT 'evidence', downstream, 2, '"' || {q_('upstream')} || '" -> "' || {q_('downstream')} || '"' FROM fk_edges WHERE downstream IN (SELECT urn FROM ev)
UNION ALL SELECT 'root', r.root_urn, 2, '"' || {q_('upstream')} || '" -> "' || {q_('downstream')} || '"' FROM fk_edges e JOIN reach r ON r.urn = e.upstream
UNION ALL SELECT 'incident', incident_id, 0, unnest([{", ".join(_s(x) for x in RP.DOT_HEAD)}]) FROM inc
UNION ALL SELECT 'incident', incident_id, 3, '}}' FROM inc"""
    s["report_parse"] = f"""SELECT conv_id, turn,
  CASE WHEN conv_id % 7 = 3 THEN regexp_replace('{{"summary": ' || text, '^\\s+|\\s+$', '', 'g')
    WHEN turn % 3 = 2 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE text END AS summary,
  CASE WHEN conv_id % 7 = 3 OR turn % 3 = 2 THEN {_s(TX.FALLBACK_MISSING)} END AS missing_evidence,
  CAST(CASE WHEN conv_id % 7 = 3 OR turn % 3 = 2 THEN 0 ELSE conv_id % 4 END AS BIGINT) AS n_suspects
FROM conversations"""
    s["search_entities"] = f"SELECT doc_id FROM documents WHERE contains(lower(text), {_s(Q.SEARCH_TERM)})"
    return s


ORACLE_SQL = _sql()
