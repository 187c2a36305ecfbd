"""Queries that exercise the operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import findings as fi
from gneiss.operators import graph, ratchet, relops, similarity, stats, temporal, text
from gneiss.plans.catalogue import query


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: str):
    return F.col(c).cast("bigint").alias(c)


# --- class A: claims without support -------------------------------------------------------------


@query(
    "unlabelled_documents",
    "SELECT 'doc/' || doc_id AS path, 'unlabelled' AS rule, 'no label covers this document' AS message, "
    "'unlabelled::doc/' || doc_id || '::no label covers this document' AS key "
    "FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def unlabelled_documents(s, d):
    bare = relops.without_support(t(s, d, "documents").select("doc_id"), t(s, d, "labels"), ["doc_id"])
    return fi.findings(bare, "unlabelled", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), "no label covers this document").drop("line")


@query("customers_without_urgent_orders", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def customers_without_urgent_orders(s, d):
    c = t(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return relops.without_support(c, t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), ["k"]).select(F.col("k").alias("c_custkey"), "c_name")


@query("parts_never_returned_in_bulk", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_returnflag = 'R' AND l_quantity > 40)")
def parts_never_returned_in_bulk(s, d):
    p = t(s, d, "part").select("p_partkey").withColumnRenamed("p_partkey", "k")
    return relops.without_support(p, t(s, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("k")), ["k"]).select(F.col("k").alias("p_partkey"))


@query("labelled_documents", "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def labelled_documents(s, d):
    return relops.with_support(t(s, d, "documents").select("doc_id", "lang"), t(s, d, "labels"), ["doc_id"])


@query(
    "suppressed_findings",
    "WITH f AS (SELECT 'o/' || o_orderkey AS path, o_orderkey % 7 AS line, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS rule FROM orders WHERE o_orderstatus = 'O') "
    "SELECT path, CAST(line AS INTEGER) AS line, rule FROM f WHERE NOT (rule = 'even' AND line = 3)",
)
def suppressed_findings(s, d):
    """A suppression with a reason hides its own rule at its own line; one without a reason, or for another rule, hides nothing."""
    o = t(s, d, "orders").where("o_orderstatus = 'O'")
    f = o.select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") % 7).cast("int").alias("line"), F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("rule"))
    reasons = s.createDataFrame([(3, "even", "known"), (4, "even", " "), (5, "other", "known")], "line int, rule string, reason string")
    return fi.suppress(f, reasons, ("line", "rule"))


# --- class P: parity -----------------------------------------------------------------------------


@query(
    "order_line_parity",
    "SELECT coalesce(o.k, l.k) AS k, CASE WHEN l.k IS NULL THEN 'left_only' ELSE 'right_only' END AS side "
    "FROM (SELECT DISTINCT o_orderkey AS k FROM orders) o FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k WHERE o.k IS NULL OR l.k IS NULL",
)
def order_line_parity(s, d):
    return relops.parity(t(s, d, "orders").select(F.col("o_orderkey").alias("k")), t(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query(
    "supplier_customer_nation_ledger",
    "WITH o AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), e AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) "
    "SELECT coalesce(o.k, e.k) AS k, o.n AS observed, e.n AS expected, CASE WHEN e.k IS NULL THEN 'unlisted' WHEN o.k IS NULL THEN 'missing' ELSE 'changed' END AS kind "
    "FROM o FULL OUTER JOIN e ON o.k = e.k WHERE e.k IS NULL OR o.k IS NULL OR o.n IS DISTINCT FROM e.n",
)
def supplier_customer_nation_ledger(s, d):
    o = t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    e = t(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return ratchet.ledger_parity(o, e, ["k"], "n")


# --- class E: equal keys, different values -------------------------------------------------------


@query(
    "order_total_mismatch",
    "WITH x AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS total FROM lineitem GROUP BY 1) "
    "SELECT o.o_orderkey AS k, round(o.o_totalprice, 2) AS total_left, round(x.total, 2) AS total_right FROM orders o JOIN x ON o.o_orderkey = x.k WHERE abs(o.o_totalprice - x.total) > 50000",
)
def order_total_mismatch(s, d):
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    x = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("total"))
    out = relops.differing(o, x, ["k"], ["total"], tolerance=50000.0)
    return out.select("k", F.round("total_left", 2).alias("total_left"), F.round("total_right", 2).alias("total_right"))


@query("document_length_mismatch", "SELECT doc_id, n_chars AS n_left, CAST(strlen(text) AS BIGINT) AS n_right FROM documents WHERE n_chars IS DISTINCT FROM strlen(text)")
def document_length_mismatch(s, d):
    """Documents whose characters aren't single bytes."""
    n = F.octet_length("text").cast("bigint")
    return t(s, d, "documents").where(~F.col("n_chars").eqNullSafe(n)).select("doc_id", F.col("n_chars").alias("n_left"), n.alias("n_right"))


# --- class G: groups -----------------------------------------------------------------------------


@query(
    "repeated_lines",
    "SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
)
def repeated_lines(s, d):
    # two partial aggregates: a line that many documents share is counted before it is shuffled
    one = text.lines(t(s, d, "documents"), F.col("doc_id")).where(F.length("text") > 0).groupBy("text", "path").agg(F.count("*").alias("k"))
    return relops.groups_having(one, ["text"], "docs > 1", docs=F.count("*"), n=F.sum("k")).withColumnRenamed("text", "line")


@query(
    "majority_outliers",
    "WITH m AS (SELECT s_nationkey AS family, s_suppkey AS member, s_acctbal > 0 AS guarded FROM supplier), f AS (SELECT family, count(*) AS family_size, count(*) FILTER (WHERE guarded) AS guarded_count FROM m GROUP BY 1) "
    "SELECT m.family, m.member, f.family_size, f.guarded_count FROM m JOIN f USING (family) WHERE NOT m.guarded AND family_size >= 3 AND guarded_count >= 0.6 * family_size AND guarded_count < family_size",
)
def majority_outliers(s, d):
    m = t(s, d, "supplier").select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("member"), (F.col("s_acctbal") > 0).alias("guarded"))
    return relops.majority_outliers(m, ["family"], "guarded").select("family", "member", "family_size", "guarded_count")


@query(
    "suppliers_in_all_regions",
    "WITH h AS (SELECT DISTINCT l.l_suppkey AS holder, n.n_regionkey AS value FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey) "
    "SELECT holder FROM h GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM region)",
)
def suppliers_in_all_regions(s, d):
    l, o, c, n = t(s, d, "lineitem"), t(s, d, "orders"), t(s, d, "customer"), t(s, d, "nation")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return relops.holders_of_all(j.select(F.col("l_suppkey").alias("holder"), F.col("n_regionkey").alias("value")), t(s, d, "region").select(F.col("r_regionkey").alias("value")), "holder", "value")


@query(
    "recurring_part_sets",
    "WITH s AS (SELECT l_orderkey AS site, min(l_suppkey) AS module, list_sort(list(DISTINCT l_returnflag)) AS v FROM lineitem GROUP BY 1) "
    "SELECT array_to_string(v, ',') AS v, count(*) AS sites, count(DISTINCT module) AS modules FROM s WHERE len(v) >= 2 GROUP BY 1 HAVING count(DISTINCT module) >= 2",
)
def recurring_part_sets(s, d):
    l = t(s, d, "lineitem")
    module = l.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("module"))
    rows = l.join(module, "l_orderkey").select(F.col("l_orderkey").alias("site"), "module", F.col("l_returnflag").alias("value"))
    return similarity.recurring_sets(rows, "site", "module", "value", 2).select(F.array_join("values", ",").alias("v"), "sites", "modules")


# --- class S: copies -----------------------------------------------------------------------------


@query(
    "exact_duplicate_documents",
    "WITH g AS (SELECT text, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT d.doc_id, g.first_id, g.copies FROM documents d JOIN g ON d.text = g.text WHERE d.doc_id > g.first_id",
)
def exact_duplicate_documents(s, d):
    return similarity.exact_copies(t(s, d, "documents"), "text", "doc_id")


@query(
    "benchmark_in_documents",
    "SELECT d.doc_id, b.item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(regexp_split_to_array(b.text, '\\s+')) >= 7",
)
def benchmark_in_documents(s, d):
    """Passages of seven words or more that lie whole in a document.

    A passage's second to sixth words stand in any text that holds it as whole words, so pairs meet in an
    equi-join of 5-word shingles, and only those are compared.
    """
    b = t(s, d, "benchmark").withColumn("w", F.split("text", r"\s+")).where(F.size("w") >= 7)
    b = b.select("item_id", F.col("text").alias("passage"), F.xxhash64(F.slice("w", 2, 5)).alias("h"))
    docs = t(s, d, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.split("text", r"\s+").alias("w")).where(F.size("w") >= 5)
    windows = words.select("doc_id", F.explode(similarity.shingles(F.col("w"), 5)).alias("h"))
    hits = windows.join(b.select("item_id", "h"), "h").select("doc_id", "item_id").distinct()
    return hits.join(b.select("item_id", "passage"), "item_id").join(docs, "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id")


@query("near_copies_of_documents")
def near_copies_of_documents(s, d):
    bodies = t(s, d, "documents").select(F.col("doc_id").alias("fn_id"), F.split("text", r"\s+").alias("tokens")).where(F.size("tokens") >= 20)
    return similarity.near_copies(bodies)


@query(
    "near_copy_candidates",
    "WITH w AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS ws FROM documents), "
    "s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 7), chr(1)) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 20)), "
    "m AS (SELECT doc_id, count(*) AS m FROM s GROUP BY 1), f AS (SELECT h FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 80), live AS (SELECT doc_id, h FROM s JOIN f USING (h)), "
    "p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM live x JOIN live y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2) "
    "SELECT a, b, shared FROM p JOIN m x ON x.doc_id = a JOIN m y ON y.doc_id = b WHERE shared >= 0.5 * least(x.m, y.m)",
)
def near_copy_candidates(s, d):
    bodies = t(s, d, "documents").select(F.col("doc_id").alias("fn_id"), F.split("text", r"\s+").alias("tokens")).where(F.size("tokens") >= 20)
    return similarity.near_candidates(bodies)


@query("drifted_part_names")
def drifted_part_names(s, d):
    p = t(s, d, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_type", "p_size").alias("body"))
    return similarity.drifted_copies(p, ["p_brand"], "p_partkey", "body", 0.8)


# --- class N: ratchets ---------------------------------------------------------------------------

HALVES = "WITH a AS (SELECT event_type || '/' || CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type || '/' || CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1) "


def halves(s, d):
    e = t(s, d, "events").select("event_id", F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"))
    return ratchet.counted(e.where("event_id % 2 = 0")), ratchet.counted(e.where("event_id % 2 = 1"))


@query(
    "multiset_diff_events",
    HALVES + "SELECT coalesce(a.key, b.key) AS key, CAST(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS INTEGER) AS n_new, CAST(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS INTEGER) AS n_stale "
    "FROM a FULL OUTER JOIN b ON a.key = b.key WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)",
)
def multiset_diff_events(s, d):
    return ratchet.multiset_diff(*halves(s, d))


@query(
    "shrink_only_events",
    HALVES + "SELECT coalesce(a.key, b.key) AS key, CAST(CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN least(a.n, b.n) END AS INTEGER) AS kept, (b.n IS NOT NULL AND (a.n IS NULL OR b.n > a.n + 1)) AS grown "
    "FROM a FULL OUTER JOIN b ON a.key = b.key WHERE (a.n IS NOT NULL AND b.n IS NOT NULL) OR (b.n IS NOT NULL AND (a.n IS NULL OR b.n > a.n + 1))",
)
def shrink_only_events(s, d):
    return ratchet.shrink_only(*halves(s, d), slack=1)


@query(
    "except_all_event_halves",
    "SELECT user_id, event_type FROM events WHERE event_id % 2 IS NOT DISTINCT FROM 0 EXCEPT ALL SELECT user_id, event_type FROM events WHERE event_id % 2 IS DISTINCT FROM 0",
)
def except_all_event_halves(s, d):
    """Two sides that hold every event between them."""
    e = t(s, d, "events")
    even = (F.col("event_id") % 2).eqNullSafe(F.lit(0))
    return e.where(even).select("user_id", "event_type").exceptAll(e.where(~even).select("user_id", "event_type"))


# --- class T: histories --------------------------------------------------------------------------


@query(
    "value_shrinks",
    "SELECT user_id, event_id, value, previous FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE value < previous",
)
def value_shrinks(s, d):
    return temporal.shrinks(t(s, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").drop("ts")


@query(
    "red_streaks",
    "WITH g AS (SELECT user_id, max((ts, event_id)) AS g FROM events WHERE event_type <> 'error' GROUP BY 1), r AS (SELECT e.user_id, e.ts, e.event_id, g.g FROM events e LEFT JOIN g USING (user_id) WHERE e.event_type = 'error') "
    "SELECT user_id, min(ts) AS red_since, count(*) AS n_red, bool_or(g IS NULL) AS lower_bound FROM r WHERE g IS NULL OR (ts, event_id) > g GROUP BY 1",
)
def red_streaks(s, d):
    e = t(s, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("conclusion"))
    return temporal.red_streaks(e, ["user_id"], id="event_id", at="ts")


#: A snapshot of the events of a half: a finder counts those of a value from its own limit on, and errs, without a count, if the half's largest event_id of it ends in 7.
SNAPSHOT = (
    "SELECT event_type AS repo, user_id % 97 AS finder, CASE WHEN max(event_id) % 10 = 7 THEN NULL ELSE count(*) FILTER (WHERE value >= user_id % 97) END AS n, CASE WHEN max(event_id) % 10 = 7 THEN 'e' END AS err FROM events, m "
)


@query(
    "drift_of_event_types",
    f"WITH m AS (SELECT (min(event_id) + max(event_id)) / 2 AS m FROM events), a AS ({SNAPSHOT} WHERE event_id < m GROUP BY 1, 2), b AS ({SNAPSHOT} WHERE event_id >= m GROUP BY 1, 2), "
    "j AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.finder, b.finder) AS finder, a.n AS before, b.n AS after, a.err AS be, b.err AS ae FROM a FULL OUTER JOIN b ON a.repo = b.repo AND a.finder = b.finder) "
    "SELECT * FROM (SELECT repo, finder, before, after, CASE WHEN ae IS NOT NULL THEN CASE WHEN be IS NOT NULL AND before IS NULL THEN 'still-errored' ELSE 'errored' END WHEN after IS NULL THEN CASE WHEN before IS NOT NULL THEN 'gone' END "
    "WHEN before IS NULL THEN CASE WHEN be IS NOT NULL THEN 'recovered' ELSE 'new' END WHEN before > 0 AND after = 0 THEN 'blind' WHEN after - before > 5 AND after > before * 1.2 THEN 'jump' END AS kind "
    "FROM j WHERE repo IN (SELECT repo FROM a) AND repo IN (SELECT repo FROM b)) WHERE kind IS NOT NULL",
)
def drift_of_event_types(s, d):
    """Both halves of all events; finders and their errors are made up from users and ids."""
    e = t(s, d, "events").select("event_id", "value", F.col("event_type").alias("repo"), (F.col("user_id") % 97).alias("finder"))
    m = e.agg(((F.min("event_id") + F.max("event_id")) / 2).alias("m"))
    e = e.crossJoin(F.broadcast(m))  # one row

    def snapshot(half):
        each = half.groupBy("repo", "finder").agg((F.max("event_id") % 10 == 7).alias("bad"), F.count(F.when(F.col("value") >= F.col("finder"), 1)).alias("n"))
        return each.select("repo", "finder", F.when(~F.col("bad"), F.col("n")).alias("count"), F.when(F.col("bad"), "e").alias("error"))

    return temporal.drift(snapshot(e.where("event_id < m")), snapshot(e.where("event_id >= m")), ["repo", "finder"], error="error", repo="repo")


@query(
    "price_trend",
    "SELECT o_orderpriority, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last, count(*) AS n, min(o_totalprice) <> max(o_totalprice) AS moved FROM orders GROUP BY 1",
)
def price_trend(s, d):
    o = t(s, d, "orders").select("o_orderpriority", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_totalprice")
    return ratchet.trend(o, "o_orderpriority", "at", "o_totalprice")


@query(
    "order_age_bands",
    "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS INTEGER) AS age_days, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') > 2000 THEN 'stale' ELSE 'warn' END AS band "
    "FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') > 1800",
)
def order_age_bands(s, d):
    o = t(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("at"))
    return temporal.age_bands(o, "at", F.to_date(F.lit("2001-08-01")), 2000, 200).where("band is not null").select("o_orderkey", "age_days", "band")


@query(
    "last_purchase_before_error",
    "SELECT e.event_id, (SELECT max_by(p.value, p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_value FROM events e WHERE e.event_type = 'error'",
)
def last_purchase_before_error(s, d):
    e = t(s, d, "events")
    rows = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return relops.last_before(rows, e.where("event_type = 'purchase'").select("user_id", "ts", "value"), ["user_id"], "ts", "value", "last_value").select("event_id", "last_value")


# --- statistics ----------------------------------------------------------------------------------


@query(
    "spearman_by_event_type",
    "WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rx, "
    "rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS ry FROM events WHERE value IS NOT NULL) "
    "SELECT event_type, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1",
)
def spearman_by_event_type(s, d):
    return stats.spearman(t(s, d, "events"), ["event_type"], "value", "user_id").withColumn("rho", F.round("rho", 6))


@query(
    "stable_moments",
    "WITH m AS (SELECT l_returnflag AS g, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1) "
    "SELECT g, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_extendedprice) / 1000, 3) AS variance, round(avg(power(l_extendedprice - m.mean, 3)) / power(sqrt(avg(power(l_extendedprice - m.mean, 2))), 3), 6) AS skewness "
    "FROM lineitem JOIN m ON l_returnflag = g GROUP BY 1",
)
def stable_moments(s, d):
    m = stats.moments(t(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return m.select(F.col("l_returnflag").alias("g"), "n", F.round("mean", 4).alias("mean"), F.round(F.col("variance") / 1000, 3).alias("variance"), F.round("skewness", 6).alias("skewness"))


# --- text ----------------------------------------------------------------------------------------


#: The first line of each document and, where it isn't empty, one after its last are planted with a marker or something like one.
PLANTED = (("TODO", "hack: later"), ("fixme (ann)", "see TODO"), ("XXXL", "xxx 2024-05-01"), ("none", "none"))


@query(
    "debt_markers",
    "WITH p AS (SELECT 'doc/' || doc_id AS path, '# ' || " + " || ".join(f"CASE doc_id % 4 {' '.join(f'WHEN {k} THEN {chr(39)}{x[i]}{chr(39)}' for k, x in enumerate(PLANTED))} END || " + end for i, end in ((0, "' ' || left(replace(text, chr(10), ' '), 20) || chr(10) || text || chr(10) || '# '"), (1, "''"))) + " AS x FROM documents), "
    "l AS (SELECT path, CAST(unnest(range(1, len(y) + 1)) AS INTEGER) AS line, unnest(y) AS text FROM (SELECT path, string_split(x, chr(10)) AS y FROM p)) "
    "SELECT path, line, upper(regexp_extract(text, '(?i)#\\s*(TODO|FIXME|XXX|HACK)\\b', 1)) AS marker, regexp_matches(text, '\\([^)]*\\)|\\d{4}-\\d{2}-\\d{2}|@\\w+') AS attributed FROM l WHERE regexp_matches(text, '(?i)#\\s*(TODO|FIXME|XXX|HACK)\\b')",
)
def debt_markers(s, d):
    """Markers in all lines of documents that carry a planted first and last line."""
    k = F.col("doc_id") % 4
    one = lambda i: F.when(k == 0, PLANTED[0][i]).when(k == 1, PLANTED[1][i]).when(k == 2, PLANTED[2][i]).when(k == 3, PLANTED[3][i])
    planted = F.concat(F.lit("# "), one(0), F.lit(" "), F.left(F.translate("text", "\n", " "), F.lit(20)), F.lit("\n"), F.col("text"), F.lit("\n# "), one(1))
    docs = t(s, d, "documents").select("doc_id", planted.alias("text"))
    found = text.markers(text.lines(docs, F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))))
    return found.select("path", "line", "marker", "attributed")


@query(
    "glyph_lines",
    "SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_matches(x, '[^\\x00-\\x7F]') GROUP BY 1",
)
def glyph_lines(s, d):
    return text.glyph_lines(text.lines(t(s, d, "documents"), F.col("doc_id"))).groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("n"))


@query(
    "keyed_lines",
    "WITH l AS (SELECT doc_id, line, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)), "
    "n AS (SELECT doc_id, line, t, row_number() OVER (PARTITION BY doc_id, t ORDER BY line) AS k FROM l) SELECT doc_id || '::' || t || ' #' || k AS key FROM n WHERE k > 1",
)
def keyed_lines(s, d):
    out = text.keyed_lines(text.lines(t(s, d, "documents"), F.col("doc_id").cast("string")))
    return out.where(F.col("key").rlike(r" #\d+$") & (F.length("key") > F.length(text.line_key(F.col("text"))) + F.length("path") + 2)).select("key")


CUES = (("toxic", "worthless"), ("toxic", "trash"), ("toxic", "pathetic"), ("mild", "or"))


@query(
    "cue_agreement",
    "WITH x AS (SELECT l.doc_id, CASE l.toxic WHEN 1 THEN 'toxic' ELSE '' END AS declared, regexp_matches(lower(d.text), '\\b(worthless|trash|pathetic)\\b') AS tox, regexp_matches(lower(d.text), '\\bor\\b') AS mild FROM labels l JOIN documents d USING (doc_id)) "
    "SELECT doc_id, declared, CASE WHEN tox THEN 'toxic' WHEN mild THEN 'mild' END AS cued, CASE WHEN declared = 'toxic' AND tox THEN 'agree' WHEN NOT tox AND NOT mild THEN 'uncheckable' ELSE 'contradict' END AS verdict, "
    "CASE WHEN (declared = 'toxic' AND tox) OR (NOT tox AND NOT mild) THEN NULL WHEN declared = '' THEN 'unfilled_but_cued' ELSE 'declared_opposes_text' END AS kind FROM x",
)
def cue_agreement(s, d):
    rows = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", F.regexp_replace("text", "[-_]", "\u0001").alias("text")), "doc_id")
    rows = rows.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("declared"), "text")
    return text.cue_agreement(rows, "doc_id", "declared", "text", CUES)


#: The upper half of the code page, in order; the byte that it leaves out is a letter that no run holds.
CP1251 = bytes(range(128, 256)).decode("cp1251", "replace").replace("\ufffd", "x")


@query(
    "mojibake_lines",
    "WITH d AS (SELECT doc_id AS path, string_split(CASE WHEN doc_id % 10 = 0 THEN 'РџСЂРёРІРµС‚ ' ELSE '' END || text, chr(10)) AS x FROM documents), "
    "l AS (SELECT path, unnest(x) AS t, CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS line FROM d), "
    "r AS (SELECT path, line, unnest(rs) AS was, unnest(range(0, len(rs))) AS k FROM (SELECT path, line, regexp_extract_all(t, '[^\\x00-\\x7F]{3,}') AS rs FROM l)), "
    f"h AS (SELECT *, array_to_string(list_transform(string_split(was, ''), lambda c: CASE WHEN strpos('{CP1251}', c) > 0 THEN printf('%02X', CAST(127 + strpos('{CP1251}', c) AS INTEGER)) ELSE 'ZZ' END), '') AS bytes FROM r), "
    "m AS (SELECT path, line, k, was, CASE WHEN contains(bytes, 'Z') THEN NULL ELSE TRY(decode(unhex(bytes))) END AS means FROM h) "
    "SELECT path, line, arg_min(was, k) AS was, arg_min(means, k) AS means FROM m WHERE means IS NOT NULL AND means <> was GROUP BY 1, 2",
)
def mojibake_lines(s, d):
    """Lines of documents, of which every tenth document's accents were read in the wrong code page first."""
    broken = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("РџСЂРёРІРµС‚ "), F.col("text"))).otherwise(F.col("text"))
    return text.mojibake(text.lines(t(s, d, "documents").select("doc_id", broken.alias("text")), F.col("doc_id"))).select("path", "line", "was", "means")


# --- class R: graphs -----------------------------------------------------------------------------

#: A region to its nations, a nation to its suppliers, and a supplier in the black back to its region; all rows of the three tables.
EDGES = (
    "WITH RECURSIVE e AS (SELECT 3 * r_regionkey::BIGINT AS src, 3 * n_nationkey::BIGINT + 1 AS dst FROM region JOIN nation ON n_regionkey = r_regionkey "
    "UNION SELECT 3 * s_nationkey::BIGINT + 1, 3 * s_suppkey + 2 FROM supplier UNION SELECT 3 * s_suppkey + 2, 3 * n_regionkey::BIGINT FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0), "
)


def supply_edges(s, d):
    n, sup = t(s, d, "nation"), t(s, d, "supplier")
    down = t(s, d, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("r_regionkey").cast("long") * 3).alias("src"), (F.col("n_nationkey").cast("long") * 3 + 1).alias("dst"))
    to = sup.select((F.col("s_nationkey").cast("long") * 3 + 1).alias("src"), (F.col("s_suppkey") * 3 + 2).alias("dst"))
    back = sup.where("s_acctbal > 0").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select((F.col("s_suppkey") * 3 + 2).alias("src"), (F.col("n_regionkey").cast("long") * 3).alias("dst"))
    return down.union(to).union(back).distinct()


@query(
    "reachable_from_a_region",
    EDGES + "r AS (SELECT min(src) AS node, 0 AS depth FROM e UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 6) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE node IS NOT NULL GROUP BY 1",
)
def reachable_from_a_region(s, d):
    """From the region of the smallest key; no way without a repeated node is longer than three steps."""
    e = supply_edges(s, d)
    return graph.reachable(e, e.agg(F.min("src").alias("node")).where("node is not null")).select("node", "depth")


@query(
    "supply_cycle_members",
    EDGES + "r AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b WHERE e.src <> e.dst) "
    "SELECT x.a AS node, least(x.a, min(x.b)) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1",
)
def supply_cycle_members(s, d):
    return graph.cycles(supply_edges(s, d))


@query(
    "supply_components",
    EDGES + "u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY 1",
)
def supply_components(s, d):
    return graph.components(supply_edges(s, d))


def trade_edges(s, d):
    """All orders and lines as links: a customer to its orders, an order to its parts, and a part back to the customer that returned it.

    Nodes are 3 * key for customers, 3 * key + 1 for orders and 3 * key + 2 for parts.
    """
    o = t(s, d, "orders").selectExpr("o_orderkey as k", "o_custkey * 3 as c", "o_orderkey * 3 + 1 as o")
    l = t(s, d, "lineitem").selectExpr("l_orderkey as k", "l_orderkey * 3 + 1 as o", "l_partkey * 3 + 2 as p", "l_returnflag")
    back = l.where("l_returnflag = 'R'").join(o.select("k", "c"), "k")
    links = o.selectExpr("c as src", "o as dst").union(l.select("o", "p")).union(back.select("p", "c"))
    return links.where("src is not null and dst is not null").distinct()


# no SQL: DuckDB's recursion keeps a row for each pair of nodes


@query("reachable_trade_nodes")
def reachable_trade_nodes(s, d):
    """From the first customer with an order."""
    start = t(s, d, "orders").agg((F.min("o_custkey") * 3).alias("node")).where("node is not null")
    return graph.reachable(trade_edges(s, d), start).select("node", "depth")


@query("trade_cycle_members")
def trade_cycle_members(s, d):
    return graph.cycles(trade_edges(s, d))


@query("trade_components")
def trade_components(s, d):
    return graph.components(trade_edges(s, d))


# --- audit rules over Python source --------------------------------------------------------------


def _rule_files(s, kind: str) -> DataFrame:
    from gneiss.plans.rules import RULES

    rows = [(f"{r.name}/{p}", x) for r in RULES.values() for p, x in getattr(r, kind).items()]
    return s.createDataFrame(rows, "path string, text string")


@query("code_audit_of_seeded_violations")
def code_audit_of_seeded_violations(s, d):
    """All rules over the corpus of their own seeded violations: rule and the number of findings."""
    from gneiss.plans import rules

    found, _ = rules.audit(s, _rule_files(s, "bad"))
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query(
    "rollup_revenue",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
def rollup_revenue(s, d):
    return t(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query(
    "table_digest",
    "SELECT sha256(string_agg(x, '' ORDER BY x)) AS digest FROM (SELECT sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) AS x FROM nation)",
)
def table_digest(s, d):
    """Digest of a small dimension, whole and in a fixed order; for large tables see ``contracts.digest``."""
    x = t(s, d, "nation").select(F.sha2(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey"), 256).alias("x"))
    return x.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), ""), 256).alias("digest"))


@query(
    "event_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
)
def event_props(s, d):
    return t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k is not null")


@query(
    "top_orders_per_segment",
    "SELECT c_mktsegment, o_orderkey, rn FROM (SELECT c_mktsegment, o_orderkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rn <= 3",
)
def top_orders_per_segment(s, d):
    """A rank filter, which the engine pushes below the shuffle as a per-task group limit."""
    from pyspark.sql import Window as W

    j = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rn = F.row_number().over(W.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return j.withColumn("rn", rn).where("rn <= 3").select("c_mktsegment", "o_orderkey", "rn")


@query(
    "index_cover",
    "WITH i AS (SELECT * FROM (VALUES ('a', ['x'], false), ('b', ['x', 'y'], false), ('c', ['y'], true), ('d', ['y', 'z'], false)) v(name, cols, is_unique)) "
    "SELECT a.name, min(b.name) AS covered_by FROM i a JOIN i b ON a.name <> b.name AND len(a.cols) < len(b.cols) AND b.cols[1:len(a.cols)] = a.cols AND NOT a.is_unique GROUP BY 1",
)
def index_cover(s, d):
    from gneiss.operators.schema import covering_indexes

    i = s.createDataFrame([("a", ["x"], False), ("b", ["x", "y"], False), ("c", ["y"], True), ("d", ["y", "z"], False)], "name string, cols array<string>, is_unique boolean")
    full = i.select("name", F.lit("btree").alias("method"), F.lit("t").alias("tbl"), F.col("cols").alias("columns"), F.transform("cols", lambda c: F.lit(False)).alias("descending"), F.transform("cols", lambda c: F.lit(False)).alias("nulls_first"), F.lit(None).cast("string").alias("predicate"), "is_unique", F.array().cast("array<string>").alias("include"))
    return covering_indexes(full).select("name", "covered_by")
