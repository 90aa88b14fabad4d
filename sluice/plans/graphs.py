"""Registered queries over graphs of transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import graph as R
from ..operators.joins import shared_infrastructure
from ..session import cut
from ..sources import adapters as A
from .aggregates import rounded
from .registry import query


def daily(spark, sf):
    """Transfers with the day they were sent; a day is one graph."""
    return A.transfers(spark, sf).withColumn("day", F.floor(F.col("epoch") / 86400))


def daily_links(spark, sf):
    t = daily(spark, sf)
    links = t.select("day", F.col("src").alias("account"), F.col("dst").alias("peer")).distinct()
    nodes = links.select("day", "account").union(links.select("day", "peer")).distinct()
    return nodes, links


DAILY = """
dl AS (SELECT DISTINCT epoch // 86400 AS day, src AS account, dst AS peer FROM c_transfers),
dn AS (SELECT day, account FROM dl UNION SELECT day, peer FROM dl)"""


INSIDE = """
il AS (SELECT DISTINCT i.incident, t.src AS account, t.dst AS peer FROM c_incidents i JOIN c_transfers t ON t.epoch <= i.complaint
  JOIN c_cand a ON a.incident = i.incident AND a.account = t.src JOIN c_cand b ON b.incident = i.incident AND b.account = t.dst)"""


def inside(spark, sf):
    """Links among each incident's candidates that its complaint may know."""
    inc, cand = A.incidents(spark, sf).select("incident", "complaint"), A.candidates(spark, sf).select("incident", "account")
    t = A.transfers(spark, sf).groupBy(F.col("src").alias("account"), F.col("dst").alias("peer")).agg(F.min("epoch").alias("first"))
    rows = cand.join(inc, "incident").join(t, "account").where("first <= complaint").select("incident", "account", "peer")
    return cand, rows.join(cand.withColumnRenamed("account", "peer"), ["incident", "peer"], "left_semi").select("incident", "account", "peer")


KNOWN = """
pf AS (SELECT src AS account, dst AS peer, min(epoch // 86400) AS first FROM c_transfers GROUP BY ALL),
dy AS (SELECT DISTINCT epoch // 86400 AS day FROM c_transfers)"""


def known_links(spark, sf):
    """(nodes, links): what is known by the end of each day. Links carry the day they were first used."""
    t = daily(spark, sf)
    links = cut(t.groupBy(F.col("src").alias("account"), F.col("dst").alias("peer")).agg(F.min("day").alias("first")))
    ends = links.select("account", "first").union(links.select("peer", "first")).groupBy("account").agg(F.min("first").alias("first"))
    nodes = t.select("day").distinct().join(ends, F.col("first") <= F.col("day")).select("day", "account")
    return nodes, links


@query("hops_from_victim", "2.9.10", f"""
WITH RECURSIVE {KNOWN}, b(day, account, hops) AS (SELECT DISTINCT t0 // 86400, victim, 0 FROM c_incidents UNION SELECT b.day, l.peer, b.hops + 1 FROM b JOIN pf l ON l.account = b.account AND l.first <= b.day WHERE b.hops < 40),
m AS (SELECT day, account, min(hops) AS h FROM b GROUP BY ALL),
nd AS (SELECT account, min(first) AS first FROM (SELECT account, first FROM pf UNION ALL SELECT peer, first FROM pf) GROUP BY account)
SELECT dy.day, nd.account, coalesce(m.h, 99)::DOUBLE AS hops_from_victim FROM dy JOIN nd ON nd.first <= dy.day LEFT JOIN m ON m.day = dy.day AND m.account = nd.account""")
def hops_from_victim(spark, sf):
    """Hops from the nearest of a day's victims over every transfer known by the end of that day."""
    nodes, links = known_links(spark, sf)
    starts = A.incidents(spark, sf).select(F.floor(F.col("t0") / 86400).alias("day"), F.col("victim").alias("account"))
    return R.hops_from(nodes, links, starts, ["day"], link_keys=[], usable=F.col("first") <= F.col("day"))


@query("hops_inside_candidates", "2.9.10", f"""
WITH RECURSIVE {INSIDE}, b(incident, account, hops) AS (SELECT incident, victim, 0 FROM c_incidents UNION SELECT b.incident, l.peer, b.hops + 1 FROM b JOIN il l ON l.incident = b.incident AND l.account = b.account WHERE b.hops < 40),
m AS (SELECT incident, account, min(hops) AS h FROM b GROUP BY ALL)
SELECT c.incident, c.account, coalesce(m.h, 99)::DOUBLE AS hops_from_victim FROM (SELECT DISTINCT incident, account FROM c_cand) c LEFT JOIN m ON m.incident = c.incident AND m.account = c.account""")
def hops_inside_candidates(spark, sf):
    """Hops from the victim among its incident's candidates."""
    nodes, links = inside(spark, sf)
    starts = A.incidents(spark, sf).select("incident", F.col("victim").alias("account"))
    return R.hops_from(nodes.distinct(), links, starts, ["incident"])


@query("hops_to_exit", "2.9.11", f"""
WITH RECURSIVE {INSIDE}, px AS (SELECT DISTINCT i.incident, t.src AS account FROM c_incidents i JOIN c_transfers t ON t.epoch <= i.complaint JOIN c_cand a ON a.incident = i.incident AND a.account = t.src WHERE t.dst % 25 = 7),
b(incident, account, hops) AS (SELECT incident, account, 0 FROM px UNION SELECT b.incident, l.account, b.hops + 1 FROM b JOIN il l ON l.incident = b.incident AND l.peer = b.account WHERE b.hops < 12),
m AS (SELECT incident, account, min(hops) AS h FROM b GROUP BY ALL)
SELECT c.incident, c.account, coalesce(m.h, 99)::DOUBLE AS hops_to_exit FROM (SELECT DISTINCT incident, account FROM c_cand) c LEFT JOIN m ON m.incident = c.incident AND m.account = c.account""")
def hops_to_exit(spark, sf):
    nodes, links = inside(spark, sf)
    paid = A.transfers(spark, sf).join(A.exits(spark, sf).select(F.col("account").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("account")).agg(F.min("epoch").alias("first"))
    payers = nodes.join(A.incidents(spark, sf).select("incident", "complaint"), "incident").join(paid, "account").where("first <= complaint").select("incident", "account").distinct()
    return R.hops_to_exit(nodes.distinct(), links, payers, ["incident"])


def pagerank_sql(rounds):
    sql = "SELECT account, 1.0 / n AS rank FROM c_accounts, c_n"
    body = [f"r0 AS ({sql})"]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        body.append(f"""r{i} AS (SELECT a.account, 0.15 / n + 0.85 * (coalesce(g.got, 0) + d.lost / n) AS rank FROM c_accounts a CROSS JOIN c_n
  CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM {p} WHERE account NOT IN (SELECT src FROM w)) d
  LEFT JOIN (SELECT w.dst, sum({p}.rank * w.s) AS got FROM w JOIN {p} ON {p}.account = w.src GROUP BY w.dst) g ON g.dst = a.account)""")
    return (f"WITH w AS (SELECT src, dst, sum(amount) / sum(sum(amount)) OVER (PARTITION BY src) AS s FROM c_transfers GROUP BY src, dst), " + ", ".join(body)
            + f" SELECT account, round(rank, 9) AS pagerank FROM r{rounds}")


@query("pagerank", "2.9.8", pagerank_sql(25))
def pagerank(spark, sf):
    nodes = A.accounts(spark, sf).select("account")
    return rounded(R.pagerank(nodes, R.pair_weights(A.transfers(spark, sf)), tolerance=1e-12), 9, "pagerank")


def betweenness_sql(pivots=64, seed=7, depth=12):
    """Path counts out and dependencies back, a level at a time, from the same pivots."""
    parts = [
        "l AS (SELECT DISTINCT src AS account, dst AS peer FROM c_transfers)", "n AS (SELECT account FROM l UNION SELECT peer FROM l)",
        f"pv AS (SELECT account AS origin FROM n ORDER BY md5('{seed}/' || account), account LIMIT {pivots})",
        f"d(origin, account, level) AS (SELECT origin, origin, 0 FROM pv UNION SELECT origin, peer, level + 1 FROM d JOIN l ON l.account = d.account WHERE level < {depth})",
        "m AS (SELECT origin, account, min(level) AS level FROM d GROUP BY origin, account)", "s0 AS (SELECT origin, origin AS account, 1.0::DOUBLE AS paths FROM pv)"]
    for k in range(1, depth + 1):
        parts.append(f"s{k} AS (SELECT s.origin, l.peer AS account, sum(s.paths) AS paths FROM s{k - 1} s JOIN l ON l.account = s.account JOIN m ON m.origin = s.origin AND m.account = l.peer AND m.level = {k} GROUP BY ALL)")
    parts.append(f"b{depth} AS (SELECT origin, account, 0.0::DOUBLE AS dep FROM s{depth})")
    for k in range(depth - 1, -1, -1):
        parts.append(f"""b{k} AS (SELECT s.origin, s.account, coalesce(x.dep, 0) AS dep FROM s{k} s LEFT JOIN (SELECT u.origin, u.account, sum(u.paths / v.paths * (1 + b.dep)) AS dep
 FROM s{k} u JOIN l ON l.account = u.account JOIN s{k + 1} v ON v.origin = u.origin AND v.account = l.peer JOIN b{k + 1} b ON b.origin = v.origin AND b.account = v.account GROUP BY ALL) x ON x.origin = s.origin AND x.account = s.account)""")
    every = " UNION ALL ".join(f"SELECT account, dep FROM b{k}" for k in range(1, depth + 1))
    return f"""WITH RECURSIVE {", ".join(parts)}, t AS (SELECT account, sum(dep) AS dep FROM ({every}) GROUP BY account), z AS (SELECT count(*)::DOUBLE AS n FROM n)
SELECT n.account, round(coalesce(dep, 0) * CASE WHEN z.n > 2 THEN z.n / least(z.n, {pivots}) / ((z.n - 1) * (z.n - 2)) ELSE 0 END, 9) AS betweenness FROM n CROSS JOIN z LEFT JOIN t ON t.account = n.account"""


@query("betweenness", "2.9.9", betweenness_sql())
def betweenness(spark, sf):
    links = A.transfers(spark, sf).select(F.col("src").alias("account"), F.col("dst").alias("peer")).distinct()
    nodes = links.select("account").union(links.select("peer")).distinct()
    return rounded(R.betweenness(nodes, links), 9, "betweenness")


RECIP = """
WITH d AS (SELECT DISTINCT src, dst FROM c_transfers), p AS (SELECT src AS account, dst AS peer FROM d UNION SELECT dst, src FROM d)
SELECT account, round(count(*) FILTER (o AND i) / count(*)::DOUBLE, 6) AS reciprocity, round(count(*) FILTER (o AND i) / (count(*) FILTER (o) + 1)::DOUBLE, 6) AS reciprocity_score
FROM (SELECT account, peer, EXISTS (SELECT 1 FROM d WHERE d.src = p.account AND d.dst = p.peer) AS o, EXISTS (SELECT 1 FROM d WHERE d.dst = p.account AND d.src = p.peer) AS i FROM p) GROUP BY account"""


@query("reciprocity", "2.9.12", RECIP)
def reciprocity(spark, sf):
    return rounded(R.reciprocity(A.transfers(spark, sf)), 6, "reciprocity", "reciprocity_score")


@query("recipient_jaccard", "2.9.13", """
WITH d AS (SELECT DISTINCT src, dst FROM c_transfers), n AS (SELECT src, count(*) AS n FROM d GROUP BY src),
c AS (SELECT x.src AS a, y.src AS b, count(*) AS c FROM d x JOIN d y ON x.dst = y.dst AND x.src <> y.src GROUP BY ALL)
SELECT n.src AS account, round(coalesce(max(c.c / (n.n + m.n - c.c)::DOUBLE), 0), 6) AS recipient_jaccard_max FROM n LEFT JOIN c ON c.a = n.src LEFT JOIN n m ON m.src = c.b GROUP BY n.src""")
def recipient_jaccard(spark, sf):
    return rounded(R.recipient_jaccard(A.transfers(spark, sf)), 6, "recipient_jaccard_max")


@query("same_window_openings", "2.9.14", """
WITH p AS (SELECT src AS account, dst AS peer FROM c_transfers UNION SELECT dst, src FROM c_transfers)
SELECT p.account, (count(*) FILTER (abs(a.open_day - b.open_day) <= 21))::DOUBLE AS same_window_openings FROM p JOIN c_accounts a ON a.account = p.account JOIN c_accounts b ON b.account = p.peer GROUP BY p.account""")
def same_window_openings(spark, sf):
    return R.same_window_openings(A.transfers(spark, sf), A.accounts(spark, sf))


PROJ = """
proj AS (SELECT a, b, sum(w) AS weight FROM (
  SELECT least(src, dst) AS a, greatest(src, dst) AS b, ln(1 + sum(amount)) AS w FROM c_transfers GROUP BY src, dst
  UNION ALL SELECT x.account, y.account, 2.5 FROM c_accounts x JOIN c_accounts y ON x.device = y.device AND x.account < y.account
  UNION ALL SELECT x.account, y.account, 2.5 FROM c_accounts x JOIN c_accounts y ON x.ip = y.ip AND x.account < y.account) GROUP BY a, b)"""


def projected(spark, sf):
    return R.projection(A.transfers(spark, sf), shared_infrastructure(A.accounts(spark, sf), ["device", "ip"], largest=25))


@query("projection_graph", "2.9.15", f"WITH {PROJ} SELECT a, b, round(weight, 6) AS weight FROM proj")
def projection_graph(spark, sf):
    return rounded(projected(spark, sf), 6, "weight")


@query("label_communities", "2.9.16")
def label_communities(spark, sf):
    return R.label_propagation(A.accounts(spark, sf).select("account"), projected(spark, sf))


@query("components", "2.9.16", """
WITH RECURSIVE p AS (SELECT src AS a, dst AS b FROM c_transfers UNION SELECT dst, src FROM c_transfers),
r(account, root) AS (SELECT account, account FROM c_accounts UNION SELECT r.account, p.b FROM r JOIN p ON p.a = r.root)
SELECT account, min(root) AS community FROM r GROUP BY account""")
def components(spark, sf):
    pairs = A.transfers(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return R.components(A.accounts(spark, sf).select("account"), pairs)


@query("modularity", "2.9.16", f"""
WITH {PROJ}, r AS (SELECT a % 20 AS ca, b % 20 AS cb, weight FROM proj), h AS (SELECT ca AS c, weight FROM r UNION ALL SELECT cb, weight FROM r), d AS (SELECT c, sum(weight) AS d FROM h GROUP BY c)
SELECT (SELECT count(*) FROM d) AS communities, round((SELECT sum(weight) FILTER (ca = cb) / sum(weight) FROM r) - (SELECT sum(d * d) FROM d) / (4 * (SELECT sum(weight) FROM r) ** 2), 6) AS modularity""")
def modularity(spark, sf):
    members = A.accounts(spark, sf).select("account", F.col("district").alias("community"))
    return rounded(R.modularity(members, projected(spark, sf)), 6, "modularity")


@query("community_fraud_rate", "2.9.17", """
SELECT a.account, a.district AS community, count(*) OVER w AS size, round(avg(CASE WHEN coalesce(l.is_mule, false) THEN 1.0 ELSE 0.0 END) OVER w, 6) AS rate,
 avg(CASE WHEN coalesce(l.is_mule, false) THEN 1.0 ELSE 0.0 END) OVER w > 0.3 AS high_risk FROM c_accounts a LEFT JOIN c_labels l ON l.account = a.account WINDOW w AS (PARTITION BY a.district)""")
def community_fraud_rate(spark, sf):
    members = A.accounts(spark, sf).select("account", F.col("district").alias("community"))
    return rounded(R.community_fraud_rate(members, A.labels(spark, sf).select("account", F.col("is_mule").alias("marked"))), 6, "rate")


@query("cluster_report", "2.4.42", """
WITH r AS (SELECT community, avg(is_fraud) AS rate, count(*) AS size FROM c_nodes GROUP BY community)
SELECT CASE WHEN rate <= 0 THEN 'none' WHEN rate <= 0.1 THEN '(0,.1]' WHEN rate <= 0.3 THEN '(.1,.3]' WHEN rate <= 0.6 THEN '(.3,.6]' ELSE '(.6,1]' END AS bucket, count(*) AS communities, CAST(sum(size) AS BIGINT) AS accounts FROM r GROUP BY 1""")
def cluster_report(spark, sf):
    from ..operators import reports
    return reports.cluster_buckets(A.nodes(spark, sf))


@query("cluster_top", "2.4.42", "SELECT community, round(avg(is_fraud), 6) AS rate, count(*) AS size FROM c_nodes GROUP BY community ORDER BY avg(is_fraud) DESC, community LIMIT 10")
def cluster_top(spark, sf):
    from ..operators import reports
    return rounded(reports.cluster_top(A.nodes(spark, sf)), 6, "rate")


@query("community_size_rate", "2.4.43", "SELECT node, community, count(*) OVER w AS size, round(avg(community_fraud_rate) OVER w, 6) AS mean_rate FROM c_nodes WINDOW w AS (PARTITION BY community)")
def community_size_rate(spark, sf):
    from ..operators import reports
    return rounded(reports.community_context(A.nodes(spark, sf)), 6, "mean_rate")


SCALED = ("balance_mean", "tx_count", "pagerank", "in_out_ratio")


@query("minmax_scaling", "2.4.44", "SELECT node, " + ", ".join(f"round(({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1 ELSE (max({c}) OVER () - min({c}) OVER ())::DOUBLE END, 6) AS {c}" for c in SCALED) + " FROM c_nodes")
def minmax_scaling(spark, sf):
    from ..operators import reports
    n = A.nodes(spark, sf)
    return rounded(reports.minmax_apply(n, reports.minmax_fit(n, SCALED), SCALED, ["node"]), 6, *SCALED)


@query("standard_scaling", "2.4.45", "SELECT node, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in SCALED) + " FROM c_nodes")
def standard_scaling(spark, sf):
    from ..operators import reports
    n = A.nodes(spark, sf)
    return rounded(reports.standard_apply(n, reports.standard_fit(n, SCALED), SCALED, ["node"]), 6, *SCALED)


@query("ring_records", "2.4.41", """
WITH o AS (SELECT src, sum(amount) AS outflow, coalesce(sum(amount) FILTER (dst % 25 = 7), 0) AS exitflow FROM c_transfers GROUP BY src), s AS (SELECT account, max(score) AS p FROM c_scores WHERE model = 1 GROUP BY account)
SELECT district AS community, count(*) AS size, count(DISTINCT bank) AS banks, count(DISTINCT device) AS devices, count(DISTINCT ip) AS ips, round(sum(coalesce(outflow, 0)), 2) AS outflow, round(sum(coalesce(exitflow, 0)), 2) AS exit_flow,
 round(avg(coalesce(p, 0)), 6) AS p_mean, round(min(coalesce(p, 0)), 6) AS p_min, round(median(coalesce(p, 0)), 6) AS p_median, CAST(median(open_day - prior_day) AS DOUBLE) AS dormancy_median,
 round(0.5 * avg(coalesce(p, 0)) + 0.3 * (1 - count(DISTINCT device) / count(*)::DOUBLE) + 0.2 / (1 + stddev_pop(open_day) / 21), 6) AS confidence
FROM c_accounts a LEFT JOIN o ON o.src = a.account LEFT JOIN s ON s.account = a.account GROUP BY district""")
def ring_records(spark, sf):
    from ..operators import reports
    members = A.accounts(spark, sf).select("account", F.col("district").alias("community"))
    scores = A.model_scores(spark, sf).where("model = 1").groupBy("account").agg(F.max("score").alias("p"))
    r = reports.ring_records(members, A.accounts(spark, sf), A.transfers(spark, sf), A.exits(spark, sf), scores)
    return rounded(rounded(r, 2, "outflow", "exit_flow"), 6, "p_mean", "p_min", "p_median", "confidence")


def cycle_sql(longest=6):
    parts = ["w AS (SELECT epoch // 86400 AS day, src, dst, sum(amount) AS w FROM c_transfers GROUP BY ALL)",
             "p2 AS (SELECT day, src AS s, dst AS l, [src, dst] AS path, w AS v FROM w WHERE src < dst)"]
    for k in range(3, longest + 1):
        parts.append(f"p{k} AS (SELECT p.day, p.s, w.dst AS l, list_append(p.path, w.dst) AS path, p.v + w.w AS v FROM p{k - 1} p JOIN w ON w.day = p.day AND w.src = p.l WHERE w.dst > p.s AND NOT list_contains(p.path, w.dst))")
    union = " UNION ALL ".join(f"SELECT p.day, list_sort(p.path) AS nodes, {k} AS size, p.v + w.w AS v FROM p{k} p JOIN w ON w.day = p.day AND w.src = p.l AND w.dst = p.s" for k in range(3, longest + 1))
    return ", ".join(parts) + f", cyc AS (SELECT day, nodes, size, round(max(v), 2) AS volume FROM ({union}) GROUP BY ALL)"


@query("short_cycles", "2.9.18", f"WITH {cycle_sql()} SELECT day, array_to_string(nodes, '-') AS ring, size, volume FROM cyc")
def short_cycles(spark, sf):
    return R.cycles(daily(spark, sf), ["day"]).select("day", F.array_join("nodes", "-").alias("ring"), "size", "volume")


@query("ring_membership", "2.9.18", f"WITH {cycle_sql()}, u AS (SELECT unnest(nodes) AS account, volume FROM cyc) SELECT account, count(*) AS rings, round(sum(volume), 2) AS ring_volume FROM u GROUP BY account")
def ring_membership(spark, sf):
    return R.ring_membership(R.cycles(daily(spark, sf), ["day"]))


WHOLE = """
w AS (SELECT src, dst, sum(amount) AS w FROM c_transfers GROUP BY ALL),
c3 AS (SELECT list_sort([a.src, a.dst, b.dst]) AS nodes, 3 AS size, a.w + b.w + c.w AS v FROM w a JOIN w b ON b.src = a.dst AND b.dst > a.src JOIN w c ON c.src = b.dst AND c.dst = a.src WHERE a.dst > a.src),
c4 AS (SELECT list_sort([a.src, a.dst, b.dst, c.dst]) AS nodes, 4 AS size, a.w + b.w + c.w + d.w AS v FROM w a JOIN w b ON b.src = a.dst AND b.dst > a.src JOIN w c ON c.src = b.dst AND c.dst > a.src AND c.dst <> a.dst JOIN w d ON d.src = c.dst AND d.dst = a.src WHERE a.dst > a.src)"""


@query("whole_graph_cycles", "2.9.18", f"WITH {WHOLE} SELECT array_to_string(nodes, '-') AS ring, size, round(max(v), 2) AS volume FROM (SELECT * FROM c3 UNION ALL SELECT * FROM c4) GROUP BY nodes, size")
def whole_graph_cycles(spark, sf):
    """Cycles of three and four accounts over all transfers; longer ones of a graph this dense are too many to list."""
    return R.meeting_cycles(A.transfers(spark, sf), 4).select(F.array_join("nodes", "-").alias("ring"), "size", "volume")


SHAPES = f"""{cycle_sql()}, mem AS (SELECT day, array_to_string(nodes, '-') AS ring, size, unnest(nodes) AS account FROM cyc), dd AS (SELECT DISTINCT day, src, dst FROM w),
deg AS (SELECT m.day, m.ring, m.size, m.account, count(x.account) AS d FROM mem m LEFT JOIN (SELECT a.day, a.ring, a.account FROM mem a JOIN dd ON dd.day = a.day AND dd.src = a.account JOIN mem b ON b.day = a.day AND b.ring = a.ring AND b.account = dd.dst) x ON x.day = m.day AND x.ring = m.ring AND x.account = m.account GROUP BY ALL),
shp AS (SELECT day, ring, size, CASE WHEN max(d) >= size * 0.6 THEN 'STAR' WHEN sum(d) / (size * (size - 1))::DOUBLE >= 0.6 THEN 'DENSE_CLUSTER' WHEN count(*) FILTER (d <= 1) >= size * 0.4 THEN 'CHAIN' ELSE 'CYCLE' END AS shape, arg_max(account, d * 1000000 - account) AS hub FROM deg GROUP BY day, ring, size)"""


@query("ring_shapes", "2.9.19", f"WITH {SHAPES} SELECT * FROM shp")
def ring_shapes(spark, sf):
    t = daily(spark, sf)
    return R.ring_shapes(R.cycles(t, ["day"]), t, ["day"])


@query("ring_roles", "2.9.19", f"""
WITH {SHAPES}, m3 AS (SELECT * FROM mem WHERE size = 3),
pr AS (SELECT x.day, x.ring, x.account AS a, y.account AS b FROM m3 x JOIN m3 y ON y.day = x.day AND y.ring = x.ring AND y.account <> x.account),
ms AS (SELECT pr.* FROM pr WHERE NOT EXISTS (SELECT 1 FROM dd WHERE dd.day = pr.day AND dd.src = pr.a AND dd.dst = pr.b)),
bc AS (SELECT m.day, m.ring, m.account, (SELECT count(*) FROM ms WHERE ms.day = m.day AND ms.ring = m.ring AND ms.a <> m.account AND ms.b <> m.account) AS k FROM m3 m)
SELECT b.day, b.ring, b.account, CASE WHEN b.account = s.hub THEN 'HUB' WHEN b.k > 2 * avg(b.k) OVER (PARTITION BY b.day, b.ring) THEN 'BRIDGE' ELSE 'MULE' END AS role FROM bc b JOIN shp s ON s.day = b.day AND s.ring = b.ring""")
def ring_roles(spark, sf):
    t = daily(spark, sf)
    rings = R.cycles(t, ["day"], 3)
    return R.ring_roles(rings, R.ring_shapes(rings, t, ["day"]), t, ["day"], 3)


@query("degree_centrality", "2.9.20", """
WITH p AS (SELECT src AS account, dst AS peer FROM c_transfers UNION SELECT dst, src FROM c_transfers)
SELECT a.account, round(count(p.peer) / (SELECT count(*) - 1 FROM c_accounts)::DOUBLE, 6) AS network_score FROM c_accounts a LEFT JOIN p ON p.account = a.account GROUP BY a.account""")
def degree_centrality(spark, sf):
    return rounded(R.degree_centrality(A.accounts(spark, sf), A.transfers(spark, sf)), 6, "network_score")


REACH = """WITH RECURSIVE s AS (SELECT account AS seed FROM c_labels WHERE is_mule), u AS (SELECT src AS a, dst AS b FROM c_transfers UNION SELECT dst, src FROM c_transfers),
w(seed, account, d) AS (SELECT seed, seed, 0 FROM s UNION SELECT seed, u.b, d + 1 FROM w JOIN u ON u.a = w.account WHERE d < 4),
r AS (SELECT seed, account, min(d) AS hops FROM w GROUP BY seed, account)"""


@query("neighbourhood_accounts", "2.9.21", f"{REACH} SELECT seed, account, hops FROM r")
def neighbourhood_accounts(spark, sf):
    seeds = A.labels(spark, sf).where("is_mule").select(F.col("account").alias("seed"))
    return R.neighbourhood(seeds, A.transfers(spark, sf), 4)[0]


@query("neighbourhood_edges", "2.9.21", f"""{REACH}, t AS (SELECT src, dst, count(*) AS n, round(sum(amount), 2) AS total FROM c_transfers GROUP BY src, dst)
SELECT h AS hops, a.seed, t.src, t.dst, t.n, t.total FROM t JOIN r a ON a.account = t.src JOIN r b ON b.seed = a.seed AND b.account = t.dst JOIN (SELECT unnest([1, 2, 3, 4]) AS h) ON h >= greatest(a.hops, b.hops)""")
def neighbourhood_edges(spark, sf):
    seeds = A.labels(spark, sf).where("is_mule").select(F.col("account").alias("seed"))
    return R.neighbourhood(seeds, A.transfers(spark, sf), 4)[1]


@query("decay_taint", "2.9.22", """
WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM c_transfers UNION SELECT dst, src FROM c_transfers),
r(seed, account, d) AS (SELECT account, account, 0 FROM c_labels WHERE is_mule UNION SELECT r.seed, u.b, r.d + 1 FROM r JOIN u ON u.a = r.account WHERE r.d < 4),
m AS (SELECT seed, account, min(d) AS d FROM r WHERE seed <> account GROUP BY ALL)
SELECT account, round(max(55.0 * power(0.62, d - 1)), 2) AS taint FROM m GROUP BY account""")
def decay_taint(spark, sf):
    return R.decay_taint(A.labels(spark, sf).where("is_mule"), A.transfers(spark, sf))


@query("cross_bank_hops", "2.9.23", """
WITH RECURSIVE f AS (SELECT incident, account, parent FROM (SELECT incident, dst AS account, src AS parent, row_number() OVER (PARTITION BY incident, dst ORDER BY offset_sec, txn_id) AS r FROM c_case) WHERE r = 1),
p AS (SELECT f.* FROM f JOIN c_incidents i ON i.incident = f.incident WHERE f.account <> i.victim),
c(incident, account, up, k, g) AS (SELECT incident, account, parent, CASE WHEN account % 8 <> parent % 8 THEN 1 ELSE 0 END, 1 FROM p UNION ALL SELECT c.incident, c.account, p.parent, c.k + CASE WHEN p.account % 8 <> p.parent % 8 THEN 1 ELSE 0 END, g + 1 FROM c JOIN p ON p.incident = c.incident AND p.account = c.up WHERE g < 32)
SELECT incident, account, CAST(max(k) AS BIGINT) AS crossings FROM c GROUP BY ALL UNION ALL SELECT incident, victim, 0 FROM c_incidents""")
def cross_bank_hops(spark, sf):
    from ..operators.cases import first_arrival
    parents = first_arrival(A.case_transfers(spark, sf)).select("incident", "account", "parent")
    return R.cross_bank_hops(parents, A.accounts(spark, sf), A.incidents(spark, sf))


@query("neighbour_means", "2.9.24", """
WITH l AS (SELECT DISTINCT src AS account, dst AS peer FROM c_transfers), f AS (SELECT account, own_balance AS b, CAST(open_day AS DOUBLE) AS o FROM c_accounts),
h1 AS (SELECT f.account, coalesce(avg(g.b), 0) AS b, coalesce(avg(g.o), 0) AS o FROM f LEFT JOIN l ON l.account = f.account LEFT JOIN f g ON g.account = l.peer GROUP BY f.account),
h2 AS (SELECT f.account, coalesce(avg(g.b), 0) AS b, coalesce(avg(g.o), 0) AS o FROM f LEFT JOIN l ON l.account = f.account LEFT JOIN h1 g ON g.account = l.peer GROUP BY f.account)
SELECT f.account, f.b AS own_balance, f.o AS open_day, round(h1.b, 4) AS own_balance_h1, round(h1.o, 4) AS open_day_h1, round(h2.b, 4) AS own_balance_h2, round(h2.o, 4) AS open_day_h2 FROM f JOIN h1 ON h1.account = f.account JOIN h2 ON h2.account = f.account""")
def neighbour_means(spark, sf):
    feats = A.accounts(spark, sf).select("account", "own_balance", F.col("open_day").cast("double").alias("open_day"))
    links = A.transfers(spark, sf).select(F.col("src").alias("account"), F.col("dst").alias("peer")).distinct()
    return rounded(R.neighbour_means(feats, links, ["own_balance", "open_day"]), 4, "own_balance_h1", "open_day_h1", "own_balance_h2", "open_day_h2")


@query("adjusted_rand", "2.9.45", """
WITH t AS (SELECT account, ring_id AS ring FROM c_labels WHERE is_mule), a AS (SELECT account, account % 3 AS community FROM c_accounts),
b AS (SELECT community, ring, count(*) AS n FROM a JOIN t ON t.account = a.account GROUP BY ALL),
s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2.0) AS idx FROM b), x AS (SELECT sum(n * (n - 1) / 2.0) AS a, count(*) AS c FROM (SELECT sum(n) AS n FROM b GROUP BY community)), y AS (SELECT sum(n * (n - 1) / 2.0) AS b, count(*) AS r FROM (SELECT sum(n) AS n FROM b GROUP BY ring))
SELECT round((idx - a * b / (n * (n - 1) / 2.0)) / ((a + b) / 2.0 - a * b / (n * (n - 1) / 2.0)), 6) AS ari, CAST(n AS BIGINT) AS accounts, c AS communities, r AS rings, round(n / (SELECT count(*) FROM t)::DOUBLE, 6) AS coverage FROM s, x, y""")
def adjusted_rand(spark, sf):
    truth = A.labels(spark, sf).where("is_mule").select("account", F.col("ring_id").alias("ring"))
    guess = A.accounts(spark, sf).select("account", (F.col("account") % 3).alias("community"))
    return rounded(E.adjusted_rand(guess, truth), 6, "ari", "coverage")
