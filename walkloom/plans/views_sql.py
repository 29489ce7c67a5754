"""The views of sources.views as SQL for DuckDB."""

GRAPH = """WITH li AS (SELECT o.o_custkey AS graph_id, l.l_partkey, l.l_suppkey, l.l_returnflag
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
raw AS (SELECT DISTINCT graph_id, 0 AS kind, l_partkey AS k FROM li UNION ALL SELECT DISTINCT graph_id, 1 AS kind, l_suppkey AS k FROM li),
nodes AS (SELECT r.graph_id, r.kind, r.k, CAST(row_number() OVER (PARTITION BY r.graph_id ORDER BY r.kind, r.k) - 1 AS INT) AS node_id,
  CAST(CASE WHEN r.kind = 0 THEN p.p_size % 8 ELSE 8 + s.s_nationkey % 8 END AS INT) AS node_type
  FROM raw r LEFT JOIN part p ON r.kind = 0 AND r.k = p.p_partkey LEFT JOIN supplier s ON r.kind = 1 AND r.k = s.s_suppkey),
ue AS (SELECT graph_id, l_partkey, l_suppkey, MIN(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) AS edge_type FROM li GROUP BY ALL),
half AS (SELECT u.graph_id, a.node_id AS src, b.node_id AS dst, a.node_type AS src_type, b.node_type AS dst_type, u.edge_type
  FROM ue u JOIN nodes a ON a.graph_id = u.graph_id AND a.kind = 0 AND a.k = u.l_partkey JOIN nodes b ON b.graph_id = u.graph_id AND b.kind = 1 AND b.k = u.l_suppkey),
both_ways AS (SELECT * FROM half UNION ALL SELECT graph_id, dst, src, dst_type, src_type, edge_type FROM half),
edges AS (SELECT *, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) - 1 AS INT) AS edge_id FROM both_ways),
tri AS (SELECT src_type, edge_type, dst_type, COUNT(*) AS cnt FROM edges GROUP BY 1, 2, 3),
wt AS (SELECT e.*, t.cnt, log10(greatest(t.cnt, 1)) AS weight FROM edges e JOIN tri t USING (src_type, edge_type, dst_type)),
deg AS (SELECT n.graph_id, n.node_id, COUNT(e.src) AS degree FROM nodes n LEFT JOIN edges e ON e.graph_id = n.graph_id AND e.src = n.node_id GROUP BY 1, 2)
"""

RECURSIVE = GRAPH.replace("WITH", "WITH RECURSIVE", 1).rstrip()

#: comp: graph_id, node_id, root (least node of the component), rank (by size downwards). Only smaller roots spread.
COMPONENTS = RECURSIVE + """, reach AS (SELECT graph_id, node_id, node_id AS root FROM nodes UNION SELECT e.graph_id, e.dst, r.root FROM reach r JOIN edges e ON e.graph_id = r.graph_id AND e.src = r.node_id AND e.dst > r.root),
lab AS (SELECT graph_id, node_id, min(root) AS root FROM reach GROUP BY 1, 2), siz AS (SELECT graph_id, root, COUNT(*) AS n FROM lab GROUP BY 1, 2),
rnk AS (SELECT graph_id, root, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, root) - 1 AS INT) AS rank FROM siz),
comp AS (SELECT graph_id, node_id, root, rank FROM lab JOIN rnk USING (graph_id, root))
"""

#: walk: graph_id, tok, key of the nodes that a breadth-first walk from node 0 comes to, in order of key: the least path of ids among the shortest.
BFS = RECURSIVE + """, dst0 AS (SELECT DISTINCT graph_id, 0 AS node_id, 0 AS dist FROM edges UNION SELECT e.graph_id, e.dst, r.dist + 1 FROM dst0 r JOIN edges e ON e.graph_id = r.graph_id AND e.src = r.node_id WHERE r.dist < 40),
dis AS (SELECT graph_id, node_id, min(dist) AS dist FROM dst0 GROUP BY 1, 2),
pth AS (SELECT graph_id, node_id, dist, '0000' AS key FROM dis WHERE dist = 0 UNION SELECT e.graph_id, e.dst, d.dist, p.key || lpad(CAST(e.dst AS VARCHAR), 4, '0') FROM pth p JOIN edges e ON e.graph_id = p.graph_id AND e.src = p.node_id JOIN dis d ON d.graph_id = e.graph_id AND d.node_id = e.dst AND d.dist = p.dist + 1),
fst AS (SELECT graph_id, node_id, min(dist) AS dist, min(key) AS key FROM pth GROUP BY 1, 2),
walk AS (SELECT f.graph_id, 2 * n.node_type + 1 AS tok, lpad(CAST(f.dist AS VARCHAR), 4, '0') || f.key AS key FROM fst f JOIN nodes n ON n.graph_id = f.graph_id AND n.node_id = f.node_id)
"""

EVENTS = """WITH ev AS (SELECT user_id AS graph_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS tok FROM events),
nx AS (SELECT *, lead(tok) OVER (PARTITION BY graph_id ORDER BY pos) AS nxt FROM ev),
pc AS (SELECT tok AS left_, nxt AS right_, COUNT(*) AS cnt FROM nx WHERE nxt IS NOT NULL GROUP BY 1, 2)
"""

CHARS = """WITH ch AS (SELECT doc_id AS graph_id, string_split(text, '') AS cs FROM documents WHERE text <> ''),
dc AS (SELECT graph_id, CAST(pos AS INT) AS pos, unicode(c) AS tok FROM (SELECT graph_id, generate_subscripts(cs, 1) - 1 AS pos, unnest(cs) AS c FROM ch))
"""

VOCAB = CHARS.rstrip() + """, fr AS (SELECT tok, COUNT(*) AS cnt, MIN(graph_id * 10000000 + pos) AS first FROM dc GROUP BY 1),
vo AS (SELECT tok AS token, CAST(row_number() OVER (ORDER BY cnt DESC, first) + 7 AS INT) AS vocab_id, cnt AS freq FROM fr)
"""

#: Sequences of events as lists, and three merges: each takes the commonest pair and joins it from the left.
SEQS = EVENTS.rstrip() + ", s0 AS (SELECT graph_id, list(CAST(tok AS INT) ORDER BY pos) AS t FROM ev GROUP BY 1)"


def merges(n: int, seqs: str = "") -> str:
    """SQL of n merges by training, of sequences s0 (by default of events): s<k> (graph_id, t) after k of them, r<k> (l, r, new_id, cnt) the k-th rule."""
    out = (seqs or SEQS.replace("WITH", "WITH RECURSIVE", 1)) + ", top AS (SELECT max(list_max(t)) + 2 AS id FROM s0)"
    for k in range(n):
        out += f", p{k} AS (SELECT t[i] AS l, t[i + 1] AS r, COUNT(*) AS cnt FROM (SELECT t, unnest(range(1, len(t))) AS i FROM s{k}) GROUP BY 1, 2)"
        out += f", r{k} AS (SELECT l, r, CAST(id + {k} AS INT) AS new_id, cnt FROM p{k}, top WHERE cnt >= 2 ORDER BY cnt DESC, l, r LIMIT 1)"
        out += f", {apply(f's{k}', f'r{k}', f's{k + 1}')}"
    return out


def apply(source: str, rule: str, to: str) -> str:
    """SQL of one merge. Places of the pair in a row are numbered in runs, of which every other one is taken."""
    x = to
    return f"""x{x} AS (SELECT graph_id, i, t[i] AS tok, t[i] = l AND t[i + 1] = r AS hit, l = r AS twin, new_id FROM (SELECT graph_id, t, unnest(range(1, len(t) + 1)) AS i FROM {source}), {rule}),
y{x} AS (SELECT *, i - row_number() OVER (PARTITION BY graph_id, hit ORDER BY i) AS run FROM x{x}),
z{x} AS (SELECT *, coalesce(hit, false) AND (NOT twin OR (row_number() OVER (PARTITION BY graph_id, hit, run ORDER BY i)) % 2 = 1) AS take FROM y{x}),
w{x} AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY graph_id ORDER BY i), false) AS gone FROM z{x}),
{to} AS (SELECT graph_id, list(CASE WHEN take THEN new_id ELSE tok END ORDER BY i) AS t FROM w{x} WHERE NOT gone GROUP BY 1)"""


PRED = """WITH pr AS (SELECT conv_id AS graph_id, turn AS variant_id, CAST(length(text) % 50 AS DOUBLE) AS y_pred, CAST(conv_id * 13 % 50 AS DOUBLE) AS y_true FROM conversations)
"""

CLS = """WITH pc AS (SELECT doc_id AS graph_id, CAST(doc_id * 7 % 3 AS INT) AS y_true, CAST((doc_id * 37 + n_chars) % 3 AS INT) AS y_pred, CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS score, CAST((doc_id * 11) % 2 AS INT) AS y FROM documents)
"""

LABELLED = "WITH lab AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.n_chars, CASE WHEN d.doc_id % 10 < 8 THEN 'train' WHEN d.doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM labels l JOIN documents d USING (doc_id))\n"
