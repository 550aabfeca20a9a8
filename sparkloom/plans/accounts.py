"""Queries of repositories, grants, users, caches and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import accounts as A
from ..operators import memory as M
from ..sources import tables as S
from . import derived as D
from .derived import with_
from .registry import query

_VERSIONS = "repo AS (SELECT o_custkey % 25 AS repo_id, max(o_orderdate) - INTERVAL 400 DAY AS indexed_at FROM orders GROUP BY 1)"


def _orders(spark, d):
    return S.read(spark, d, "orders").withColumn("repo_id", F.col("o_custkey") % 25)


def _versions(spark, d):
    return _orders(spark, d).groupBy("repo_id").agg((F.max("o_orderdate") - F.expr("INTERVAL 400 DAYS")).alias("indexed_at"))


@query(f"WITH {_VERSIONS} SELECT o_orderkey, CASE WHEN o_orderdate < indexed_at THEN 'STALE' ELSE 'FRESH' END AS state FROM orders JOIN repo ON repo_id = o_custkey % 25")
def staleness_label(spark, d):
    memory = _orders(spark, d).select("repo_id", "o_orderkey", F.col("o_orderdate").alias("repo_indexed_at"))
    return A.staleness(memory, _versions(spark, d)).select("o_orderkey", "state")


@query("""SELECT 'turn_role' AS name, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS n FROM conversations
  UNION ALL SELECT 'long_text', count(*) FILTER (WHERE NOT length(text) < 200) FROM conversations""")
def check_violations(spark, d):
    checks = {"turn_role": A.CHECKS["turn_role"], "long_text": "length(text) < 200"}
    return A.violations(S.read(spark, d, "conversations"), checks)


_FOUND = """found AS (SELECT o_orderkey, o_custkey % 25 AS repo_id, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 's' || o_custkey END AS session_id, CASE WHEN o_orderkey % 11 > 0 THEN o_orderpriority END AS feature_name,
  o_orderstatus AS summary, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' END AS confidence FROM orders)"""


@query(f"WITH {_VERSIONS}, {_FOUND} SELECT o_orderkey, session_id, feature_name, summary, coalesce(confidence, 'medium') AS confidence, 'partial' AS exploration_status, indexed_at::TIMESTAMP AS repo_indexed_at FROM found JOIN repo USING (repo_id) WHERE session_id <> '' AND feature_name IS NOT NULL")
def cache_write(spark, d):
    k, o = F.col("o_orderkey"), _orders(spark, d)
    found = o.select(
        "o_orderkey", "repo_id", F.when(k % 7 == 0, "").when(k % 7 > 1, F.concat(F.lit("s"), F.col("o_custkey").cast("string"))).alias("session_id"),
        F.when(k % 11 > 0, F.col("o_orderpriority")).alias("feature_name"), F.col("o_orderstatus").alias("summary"),
        F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "low").alias("confidence"), F.lit(None).cast("string").alias("exploration_status"),
    )
    return A.cache_entries(found, _versions(spark, d)).select("o_orderkey", "session_id", "feature_name", "summary", "confidence", "exploration_status", "repo_indexed_at")


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS ord, event_type AS category, event_type || event_id AS fact FROM events")
def facts_in_order(spark, d):
    e = S.read(spark, d, "events").select("user_id", F.col("ts").alias("created_at"), F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.concat("event_type", F.col("event_id").cast("string")).alias("fact"))
    return A.ordered_facts(e, ["user_id"])


_URL = "CASE s_suppkey % 3 WHEN 0 THEN 'HTTP://github.com/acme/r' || s_nationkey || '.git' WHEN 1 THEN 'https://github.com/acme//r' || (s_nationkey + 10) ELSE '/home/u/p' || s_suppkey || '/' END"
_REPOS = "repos AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'https://github.com/acme/r' || n_nationkey END AS canonical_url, 'https://github.com/acme/r' || n_nationkey AS u, CASE n_nationkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'indexing' ELSE 'failed' END AS status FROM nation)"


def _repos(spark, d):
    k = F.col("n_nationkey")
    url = F.concat(F.lit("https://github.com/acme/r"), k.cast("string"))
    status = F.when(k % 3 == 0, "ready").when(k % 3 == 1, "indexing").otherwise("failed")
    return S.read(spark, d, "nation").select(T.repo_id(url).alias("repo_id"), F.when(k % 2 == 0, url).alias("canonical_url"), status.alias("status"), k.alias("k"))


@query(f"""WITH {_REPOS}, asked AS (SELECT s_suppkey AS user_id, CASE s_suppkey % 3 WHEN 0 THEN 'https://github.com/acme/r' || s_nationkey WHEN 1 THEN 'https://github.com/acme/r' || (s_nationkey + 10) ELSE '/home/u/p' || s_suppkey END AS c FROM supplier)
  SELECT user_id, substr(sha256(c), 1, 16) AS repo_id, regexp_extract(c, '[^/]*$') AS name, CASE WHEN r.canonical_url IS NOT NULL THEN 'url' WHEN r.u IS NOT NULL THEN 'id' ELSE 'new' END AS found_by,
    CASE WHEN r.status = 'ready' THEN 'ready' ELSE 'pending' END AS status, CASE WHEN r.status = 'ready' THEN 'viewer' ELSE 'owner' END AS role FROM asked LEFT JOIN repos r ON r.u = c""")
def repository_requests(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    source = F.when(k % 3 == 0, F.concat(F.lit("HTTP://github.com/acme/r"), n.cast("string"), F.lit(".git"))).when(k % 3 == 1, F.concat(F.lit("https://github.com/acme//r"), (n + 10).cast("string")))
    asked = S.read(spark, d, "supplier").select(k.alias("user_id"), source.otherwise(F.concat(F.lit("/home/u/p"), k.cast("string"), F.lit("/"))).alias("source"))
    return A.requested(asked, _repos(spark, d)).select("user_id", "repo_id", "name", "found_by", "status", "role")


@query(f"WITH {_REPOS} SELECT k, CASE WHEN status = 'indexing' AND k IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 0) THEN 'cancelled' ELSE status END AS status FROM repos")
def cancel_jobs(spark, d):
    repos = _repos(spark, d)
    asked = S.read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).join(repos, "k").select("repo_id")
    return A.cancelled(repos, asked).select("k", "status")


_GRANTS = "grants AS (SELECT DISTINCT c_custkey % 100 AS user_id, c_nationkey AS repo_id, CASE WHEN c_custkey % 100 % 4 = 0 THEN 'owner' ELSE 'viewer' END AS role FROM customer)"


def _grants(spark, d):
    u = F.col("c_custkey") % 100
    return S.read(spark, d, "customer").select(u.alias("user_id"), F.col("c_nationkey").alias("repo_id"), F.when(u % 4 == 0, "owner").otherwise("viewer").alias("role")).distinct()


@query(f"""WITH {_GRANTS}, asked AS (SELECT s_suppkey AS by, s_suppkey * 7 % 100 AS user_id, s_nationkey AS repo_id FROM supplier) SELECT * FROM grants g WHERE NOT EXISTS (
  SELECT 1 FROM asked a JOIN grants o ON o.user_id = a.by AND o.repo_id = a.repo_id AND o.role = 'owner' WHERE a.by <> a.user_id AND a.user_id = g.user_id AND a.repo_id = g.repo_id)""")
def revoke_grants(spark, d):
    asked = S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("by"), (F.col("s_suppkey") * 7 % 100).alias("user_id"), F.col("s_nationkey").alias("repo_id"))
    return A.revoked(_grants(spark, d), asked).select("user_id", "repo_id", "role")


@query(f"WITH {_GRANTS} SELECT g.* FROM grants g WHERE repo_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def list_grants(spark, d):
    repos = S.read(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("repo_id"))
    return A.grants_of(_grants(spark, d), repos).select("user_id", "repo_id", "role")


@query(f"""WITH {_GRANTS}, new AS (SELECT DISTINCT s_suppkey % 100 AS user_id, s_nationkey AS repo_id FROM supplier)
  SELECT user_id, repo_id, coalesce(CASE WHEN n.user_id IS NOT NULL THEN 'owner' END, role) AS granted, coalesce(g.role, 'viewer') AS ensured FROM grants g FULL JOIN new n USING (user_id, repo_id)""")
def grant_and_ensure(spark, d):
    g = _grants(spark, d)
    new = S.read(spark, d, "supplier").select((F.col("s_suppkey") % 100).alias("user_id"), F.col("s_nationkey").alias("repo_id")).distinct()
    granted = M.grant(g, new.withColumn("role", F.lit("owner"))).withColumnRenamed("role", "granted")
    ensured = M.ensure(g, new.withColumn("role", F.lit("viewer"))).withColumnRenamed("role", "ensured")
    return granted.join(ensured, ["user_id", "repo_id"])


@query("SELECT DISTINCT user_id AS external_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider, user_id % 3 = 0 AS old FROM events")
def user_upsert(spark, d):
    u = F.col("user_id")
    seen = S.read(spark, d, "events").select(u.cast("string").alias("external_id"), F.when(u % 2 == 0, "a").otherwise("b").alias("provider"), F.concat(F.col("event_type"), F.lit("@x")).alias("email"))
    users = seen.filter("cast(external_id as long) % 3 = 0").select(F.concat(F.lit("u"), "external_id").alias("id"), "external_id", "provider", F.lit("m").alias("email")).distinct()
    return A.upsert_users(users, seen).select(F.col("external_id").cast("long").alias("external_id"), "provider", F.col("id").startswith("u").alias("old"))


_KEY = b"a secret of the tests"
_PADS = ["'" + "".join(f"\\x{b ^ n:02X}" for b in _KEY.ljust(64, b"\0")) + "'::BLOB" for n in (0x36, 0x5C)]
_TOKEN = "'tk_' || substr(sha256(c_name), 1, 16) || '.' || c_custkey"


@query(f"SELECT c_custkey, sha256({_PADS[1]} || unhex(sha256({_PADS[0]} || encode(c_name)))) AS mac FROM customer")
def token_hmac(spark, d):
    return S.read(spark, d, "customer").select("c_custkey", A.hmac_sha256(_KEY, F.col("c_name")).alias("mac"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE substr(sha256(c_name), 1, 16) END AS named, c_custkey % 5 < 2 AS accepted FROM customer")
def users_by_token(spark, d):
    k, name = F.col("c_custkey"), F.substring(F.sha2(F.col("c_name"), 256), 1, 16)
    good = F.concat(F.lit("tk_"), name, F.lit("."), k.cast("string"))
    c = S.read(spark, d, "customer").select("c_custkey", name.alias("id"), good.alias("good"), F.when(k % 5 == 4, F.concat(F.lit("tk_short."), k.cast("string"))).when(k % 5 > 1, F.concat(good, F.lit("x"))).otherwise(good).alias("token"))
    users = c.select("id", A.hmac_sha256(_KEY, F.col("good")).alias("api_token_hash"))
    ok = A.users_of(c.select("token"), users, "tk_", _KEY).withColumn("accepted", F.lit(True))
    return c.join(ok, "token", "left").select("c_custkey", A.token_user(F.col("token"), "tk_").alias("named"), F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query("SELECT event_id, coalesce(ts > min(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id, ts::DATE), false) AS exhausted FROM events")
def quota_exhausted(spark, d):
    return M.exhausted(S.read(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error").select("event_id", "exhausted")


_NOW = "TIMESTAMP '2024-01-03 12:00:30'"


@query(f"""SELECT n.user_id, count(e.event_id) FILTER (WHERE ts > {_NOW} - INTERVAL 60 SECOND AND ts <= {_NOW}) AS rpm_last_60s, count(e.event_id) FILTER (WHERE ts::DATE = {_NOW}::DATE AND ts <= {_NOW}) AS rpd_today,
  CASE WHEN max(ts) FILTER (WHERE ts <= {_NOW}) > {_NOW} - INTERVAL 70 SECOND THEN 70 - epoch_us({_NOW} - max(ts) FILTER (WHERE ts <= {_NOW})) // 1000000 END AS rpm_ttl,
  CASE WHEN count(e.event_id) FILTER (WHERE ts::DATE = {_NOW}::DATE AND ts <= {_NOW}) > 0 THEN 43170 END::BIGINT AS rpd_ttl FROM (SELECT range AS user_id FROM range(0, 40)) n LEFT JOIN events e USING (user_id) GROUP BY 1""")
def quota_status(spark, d):
    models = spark.range(40).select(F.col("id").alias("user_id"))
    return M.quota_status(S.read(spark, d, "events"), models, "user_id", "ts", F.expr("TIMESTAMP_NTZ '2024-01-03 12:00:30'"))


@query("SELECT o_orderkey, coalesce(CASE o_custkey % 3 WHEN 0 THEN false WHEN 1 THEN true END, true) AS available FROM orders")
def quota_fail_open(spark, d):
    state = S.read(spark, d, "customer").filter("c_custkey % 3 < 2").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 3 == 1).alias("available"))
    return M.fail_open(S.read(spark, d, "orders").select("o_orderkey", "o_custkey"), state, "o_custkey").select("o_orderkey", "available")


@query("SELECT event_id, greatest(1, 86400 - (epoch_us(ts) // 1000000) % 86400)::BIGINT AS left_today, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def utc_times(spark, d):
    return S.read(spark, d, "events").select("event_id", T.seconds_to_midnight(F.col("ts")).alias("left_today"), T.iso(F.col("ts")).alias("iso"))


@query("SELECT DISTINCT user_id * 9 AS conv_id FROM events WHERE user_id * 9 NOT IN (SELECT conv_id FROM conversations) AND user_id IN (SELECT user_id FROM events WHERE event_type = 'view')")
def unseen_conversations(spark, d):
    e = S.read(spark, d, "events").withColumn("conv_id", F.col("user_id") * 9)
    return A.unseen_conversations(e.select("conv_id").distinct(), S.read(spark, d, "conversations"), e.filter("event_type = 'view'"))


@query("SELECT user_id, last FROM (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last FROM events GROUP BY user_id) ORDER BY last DESC NULLS LAST, user_id LIMIT 20")
def latest_nulls_last(spark, d):
    e = S.read(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last"))
    return e.orderBy(F.desc_nulls_last("last"), "user_id").limit(20)


@query(with_("entities edges links", "SELECT DISTINCT p.id FROM entities p JOIN links c ON c.source_id = p.id AND c.type = 'CONTAINS' WHERE c.target_id IN (SELECT source_id FROM edges WHERE type = 'CALLS')"))
def busy_children(spark, d):
    from ..operators.overview import busy_children as found

    return found(D.entities(spark, d), D.edges(spark, d).unionByName(D.contains(spark, d))).select("id")
