"""One registered query per operator, over its whole table, and SQL checks where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, filter_audit, katz, language, licenses, maxscore, mixing, pieces, pii, polyhash, reputation, simhash, token_rollup
from .common import fresh, saved, table

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        RUN[name] = fn
        if sql is not None:
            CHECK[name] = sql
        return fn

    return add


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", *columns)


@query("op1_license_scan")
def license_scan(spark, folder):
    found = licenses.scan(documents(spark, folder, "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score", F.size("spans").cast("long").alias("n_spans"),
    )


@query("op2_katz_score")
def katz_score(spark, folder):
    return katz.score(documents(spark, folder, "text"), katz.held_out())


@query("op3_source_mix", sql="""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
           substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS cell
    FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
           CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
    FROM totals),
turns AS (
    SELECT *, row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS turn,
           (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE
            - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed),
chosen AS (SELECT arg_min(level, turn) AS level FROM turns WHERE level <= cap / w),
goals AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM chosen) * w, cap)) AS target FROM turns),
ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY size, cell, doc_id NULLS FIRST) AS k FROM sized s),
stepped AS (
    SELECT r.doc_id, r.size, g.source_size, g.target, r.k,
           CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
           ('0x' || substr(md5('mix-1/' || coalesce('=' || r.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
    FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate * k + u) - floor(rate * (k - 1) + u)) * size AS BIGINT) AS taken
FROM stepped""")
def source_mix(spark, folder):
    return mixing.mix(documents(spark, folder, "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_language_id")
def language_id(spark, folder):
    docs = documents(spark, folder, "text", "lang")
    found = language.identify(docs, train=~language.held_out())
    return found.withColumn("held_out", language.held_out()).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_simhash_neardup")
def simhash_neardup(spark, folder):
    found = simhash.groups(documents(spark, folder, "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op6_piece_codec")
def piece_codec(spark, folder):
    found = pieces.encoded(documents(spark, folder, "text"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_chars", F.xxhash64("ids").alias("ids_digest"), "lossless")


@query("op7_maxscore_topk", sql="""
WITH v AS (
    SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.uid, q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v d ON q.uid <> d.uid WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) <= 5""")
def maxscore_topk(spark, folder):
    return maxscore.top_k(maxscore.quantised(table(spark, folder, "embeddings")), F.col("vec_id") % 50 == 0)


@query("op8_url_reputation", sql="""
WITH cut AS (
    SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rhost, rpath, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
    SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(says, length(rhost || rpath)) AS says
    FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
judged AS (SELECT p.page_id, p.host, p.path, f.rule, f.says FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path),
h0 AS (
    SELECT host, CAST(count(says) AS DOUBLE) AS n, CAST(count(*) FILTER (says = 'allow') AS DOUBLE) AS g, string_split(host, '.') AS l FROM judged GROUP BY host),
h1 AS (
    SELECT host, n, g, l,
           CASE WHEN len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS k FROM h0),
h AS (SELECT host, n, g, array_to_string(l[-k:], '.') AS suffix, array_to_string(l[-(k + 1):], '.') AS domain FROM h1),
d AS (SELECT suffix, domain, sum(n) AS n, sum(g) AS g FROM h GROUP BY suffix, domain),
s AS (SELECT suffix, sum(n) AS n, sum(g) AS g FROM d GROUP BY suffix),
r AS (SELECT (sum(g) + 1) / (sum(n) + 2) AS p FROM s),
sb AS (
    SELECT count(*) AS k, (sum(n * pow(g / n - p, 2)) - max(p * (1 - p)) * (count(*) - 1)) / (sum(n) - sum(n * n) / sum(n)) AS spread, max(p * (1 - p)) AS noise
    FROM s, r WHERE n > 0),
s2 AS (
    SELECT suffix, (g + b * p) / (n + b) AS p FROM s, r,
         (SELECT coalesce(max(greatest(1.0, least(1000.0, CASE WHEN k > 1 AND spread > 0 THEN noise / spread - 1 ELSE 1000.0 END))), 1000.0) AS b FROM sb)),
dj AS (SELECT d.*, s2.p FROM d JOIN s2 USING (suffix)),
db AS (
    SELECT suffix, count(*) AS k, (sum(n * pow(g / n - p, 2)) - max(p * (1 - p)) * (count(*) - 1)) / (sum(n) - sum(n * n) / sum(n)) AS spread, max(p * (1 - p)) AS noise
    FROM dj WHERE n > 0 GROUP BY suffix),
d2 AS (
    SELECT dj.suffix, dj.domain, (g + b * p) / (n + b) AS p
    FROM (SELECT dj.*, coalesce(greatest(1.0, least(1000.0, CASE WHEN k > 1 AND spread > 0 THEN noise / spread - 1 ELSE 1000.0 END)), 1000.0) AS b FROM dj LEFT JOIN db USING (suffix)) dj),
hj AS (SELECT h.*, d2.p FROM h JOIN d2 USING (suffix, domain)),
hb AS (
    SELECT suffix, domain, count(*) AS k, (sum(n * pow(g / n - p, 2)) - max(p * (1 - p)) * (count(*) - 1)) / (sum(n) - sum(n * n) / sum(n)) AS spread, max(p * (1 - p)) AS noise
    FROM hj WHERE n > 0 GROUP BY suffix, domain),
h2 AS (
    SELECT host, n, (g + b * p) / (n + b) AS share, n + b AS m
    FROM (SELECT hj.*, CASE WHEN hb.k IS NULL THEN 1000.0 ELSE greatest(1.0, least(1000.0, CASE WHEN k > 1 AND spread > 0 THEN noise / spread - 1 ELSE 1000.0 END)) END AS b
          FROM hj LEFT JOIN hb USING (suffix, domain)) hj),
up AS (SELECT host, n, share, least(1.0, share + 1.64 * sqrt(share * (1 - share) / (m + 1))) AS upper FROM h2)
SELECT page_id, j.host, path, rule, coalesce(says, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n AS BIGINT) AS labelled, round(share, 6) AS good_share, round(upper, 6) AS upper_bound
FROM judged j JOIN up ON j.host = up.host""")
def url_reputation(spark, folder):
    return reputation.judge(table(spark, folder, "pages").select("page_id", "url"))


@query("op9_token_rollup", sql="""
WITH d AS (
    SELECT doc_id, source, lang, text,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS space_1,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\x20\\x09-\\x0D]')) AS BIGINT) AS word_2
    FROM documents),
kept AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id NULLS LAST) = 1),
both_ AS (
    SELECT source, lang, 'space-1' AS version, space_1 + 1 AS tokens FROM kept
    UNION ALL SELECT source, lang, 'word-2', word_2 FROM kept)
SELECT source, lang, version, CAST(count(*) AS BIGINT) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens FROM both_ GROUP BY ALL""")
def token_counts(spark, folder):
    """Five batches over the whole table: one insert per tokenizer version, a delete of all
    later copies, a recount of one version (an end token each) of what is left, and the
    delete sent once more, which changes nothing."""
    rows = documents(spark, folder, "text", "source", "lang")
    counted = saved(rows.select(
        "doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"),
        *[token_rollup.tokens(F.col("text"), pattern).alias(version) for version, pattern in token_rollup.VERSIONS.items()],
    ).withColumn("row", F.monotonically_increasing_id()), "token-counts")
    # one row of each text stays, whatever its id: null ids come last, rows of one id in their order
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = saved(counted.groupBy("sha").agg(F.min(order).alias("first")), "token-firsts")
    marked = saved(counted.join(firsts, "sha").withColumn("copy", F.col("row") != F.col("first.row")).drop("first"), "token-copies")

    def change(frame: DataFrame, version: str, extra: int = 0, delete: bool = False) -> DataFrame:
        return frame.select(
            F.col("row").alias("doc_id"), F.lit(version).alias("version"), "source", "lang", (F.col(f"`{version}`") + extra).alias("tokens"),
            F.lit(delete).alias("delete"), F.lit(0).alias("turn"))

    one, two = token_rollup.VERSIONS
    gone = change(marked.where("copy"), one, delete=True).unionByName(change(marked.where("copy"), two, delete=True))
    store = token_rollup.Rollup(spark, fresh(spark, "token-rollup"))
    store.commit(1, change(marked, one))
    store.commit(2, change(marked, two))
    store.commit(3, gone)
    store.commit(4, change(marked.where("NOT copy"), one, extra=1))
    store.commit(3, gone)
    return store.totals()


@query("op10_polynomial_dedup", sql="""
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def polynomial_dedup(spark, folder):
    return polyhash.classes(documents(spark, folder, "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op11_collocations", sql="""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
    SELECT lang, ws[i:i + m - 1] AS ph
    FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS m))),
f AS (SELECT lang, ph, count(*) AS f FROM g GROUP BY lang, ph HAVING count(*) >= 100),
c AS (SELECT lang, ph, f AS a FROM f WHERE len(ph) > 1),
cuts AS (SELECT lang, ph, a, unnest(range(1, len(ph))) AS k FROM c),
s AS (
    SELECT cuts.lang, cuts.ph, k, a, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.ph = cuts.ph[1:k] JOIN f y ON y.lang = cuts.lang AND y.ph = cuts.ph[k + 1:] JOIN totals t ON t.lang = cuts.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
inside AS (
    SELECT lang, ph, max(f) AS longer FROM (SELECT lang, ph[1:len(ph) - 1] AS ph, a AS f FROM c UNION ALL SELECT lang, ph[2:], a FROM c) GROUP BY lang, ph),
kept AS (
    SELECT low.lang, array_to_string(low.ph, ' ') AS phrase, a, l, r, n, score
    FROM low LEFT JOIN inside ON inside.lang = low.lang AND inside.ph = low.ph WHERE longer IS NULL OR longer < a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""")
def collocation_mining(spark, folder):
    return collocations.phrases(documents(spark, folder, "text", "lang"))


@query("op12_pii_scan")
def pii_scan(spark, folder):
    found = pii.detect(documents(spark, folder, "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in pii.BASE], F.sha2(listed(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))


@query("op13_filter_audit", sql="""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (
    SELECT doc_id, part,
           CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed
    FROM d),
m AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
c AS (
    SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM f LEFT JOIN m USING (doc_id) GROUP BY part, failed),
x(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (
    SELECT filter_order, step, max(own.b) AS own, coalesce(sum(past.b), 0) AS past
    FROM o CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) k JOIN x own ON own.l = substr(filter_order, step, 1)
    LEFT JOIN x past ON contains(substr(filter_order, 1, step - 1), past.l) GROUP BY filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (failed & CAST(own + past AS INTEGER) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (failed & own <> 0 AND failed & CAST(past AS INTEGER) = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (failed & own <> 0 AND failed & CAST(past AS INTEGER) <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (failed = own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (failed & own <> 0 AND failed & CAST(past AS INTEGER) = 0), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (failed & own <> 0 AND failed & CAST(past AS INTEGER) = 0), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(bit_count(failed), 1)) FILTER (failed & own <> 0), 0) AS BIGINT) AS shapley
FROM c CROSS JOIN s GROUP BY part, filter_order, step""")
def audit_filters(spark, folder):
    return filter_audit.audit(documents(spark, folder, "text", "source"), table(spark, folder, "labels"))
