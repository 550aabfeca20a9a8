"""Repositories, grants, users and the versioned cache of sessions."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_source, repo_id, repo_name
from .ordered import running

# Predicates that tables keep.
CHECKS = {
    "relationship_target": "target_id IS NOT NULL OR external_target_name IS NOT NULL",
    "memory_confidence": "confidence IN ('high', 'medium', 'low')",
    "memory_exploration": "exploration_status IN ('partial', 'complete')",
    "turn_role": "role IN ('user', 'assistant')",
    "repository_status": "status IN ('pending', 'indexing', 'ready', 'failed', 'cancelled')",
    "grant_role": "role IN ('owner', 'viewer')",
}
TOKEN_PREFIX_CHARS = 16


def violations(rows: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """(name, n): how many rows each predicate is false of, all in one pass; null is no violation, as in a table's constraint."""
    counts = rows.agg(*[F.count_if(~F.expr(p)).alias(n) for n, p in checks.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*[F.col(n) for n in checks]))).alias("name", "n"))


def staleness(memory: DataFrame, repos: DataFrame) -> DataFrame:
    """Entries with STALE if their version of the repository is older than the present one, else FRESH."""
    both = memory.join(repos.select("repo_id", "indexed_at"), "repo_id")
    return both.withColumn("state", F.when(F.col("repo_indexed_at") < F.col("indexed_at"), "STALE").otherwise("FRESH"))


def cache_entries(found: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows to append to the cache: those with a session, a feature and a summary, with defaults and the repository's version."""
    has = F.coalesce(F.col("session_id"), F.lit("")) != ""
    rows = found.filter(has & F.col("feature_name").isNotNull() & F.col("summary").isNotNull())
    rows = rows.join(repos.select("repo_id", F.col("indexed_at").alias("repo_indexed_at")), "repo_id")
    return rows.withColumns({"confidence": F.coalesce("confidence", F.lit("medium")), "exploration_status": F.coalesce("exploration_status", F.lit("partial"))})


def ordered_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of each key in the order in which they were made: (keys, ord, category, fact); keys may be users, users and repositories, or either."""
    return running(facts, keys, ["created_at", "id"], {}).select(*keys, F.col("pos").cast("int").alias("ord"), "category", "fact")


def requested(requests: DataFrame, repos: DataFrame) -> DataFrame:
    """Requests (user_id, source) against repositories (repo_id, canonical_url, status): repo_id, name, found_by, status and role after it.

    Looked up by canonical URL, then by the id that follows from it. A ready repository
    stays as it is and its asker becomes a viewer; others are pending, their asker owner.
    """
    df = requests.withColumns({"canonical_url": canonical_source(F.col("source")), "_id": repo_id(F.col("source")), "name": repo_name(F.col("source"))})
    by_url = repos.filter("canonical_url is not null").groupBy("canonical_url").agg(F.min(F.struct("repo_id", "status")).alias("_u"))
    by_id = repos.select(F.col("repo_id").alias("_id"), F.struct("repo_id", "status").alias("_i"))
    df = df.join(by_url, "canonical_url", "left").join(by_id, "_id", "left")
    hit = F.coalesce("_u", "_i")
    ready = F.coalesce(hit["status"] == "ready", F.lit(False))
    by = F.when(F.col("_u").isNotNull(), "url").when(F.col("_i").isNotNull(), "id").otherwise("new")
    return df.select("user_id", "source", "canonical_url", F.coalesce(hit["repo_id"], F.col("_id")).alias("repo_id"), "name", by.alias("found_by"),
                     F.when(ready, "ready").otherwise("pending").alias("status"), F.when(ready, "viewer").otherwise("owner").alias("role"))


def cancelled(repos: DataFrame, asked: DataFrame) -> DataFrame:
    """Repositories with those asked for cancelled, if they are still pending or indexing."""
    df = repos.join(asked.select("repo_id").distinct().withColumn("_c", F.lit(True)), "repo_id", "left")
    stops = F.coalesce("_c", F.lit(False)) & F.col("status").isin("pending", "indexing")
    return df.withColumn("status", F.when(stops, "cancelled").otherwise(F.col("status"))).drop("_c")


def grants_of(grants: DataFrame, repos: DataFrame) -> DataFrame:
    """Grants of the repositories that are there, in the order of users."""
    return grants.join(repos.select("repo_id"), "repo_id", "left_semi").orderBy("repo_id", "user_id")


def revoked(grants: DataFrame, asked: DataFrame) -> DataFrame:
    """Grants without those that ``asked`` (by, user_id, repo_id) takes back: only an owner may, and not from themselves."""
    owners = grants.filter("role = 'owner'").select(F.col("user_id").alias("by"), "repo_id")
    may = asked.filter("by <> user_id").join(owners, ["by", "repo_id"], "left_semi")
    return grants.join(may.select("user_id", "repo_id").distinct(), ["user_id", "repo_id"], "left_anti")


def upsert_users(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Users with those of ``seen`` (external_id, provider, email) that are not there yet; one row each, the first by email."""
    new = seen.groupBy("external_id", "provider").agg(F.min("email").alias("email")).join(users, ["external_id", "provider"], "left_anti")
    made = F.substring(F.sha2(F.concat_ws("|", "provider", "external_id"), 256), 1, 16)
    return users.select("id", "external_id", "provider", "email").unionByName(new.select(made.alias("id"), "external_id", "provider", "email"))


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text, in hexadecimal, out of the engine's own hash."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda n: F.lit(bytes(b ^ n for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def token_user(token: Column, prefix: str) -> Column:
    """The user id in a token (prefix, 16 characters, a dot, a secret part); null if it is written otherwise."""
    rest = F.substring(token, F.lit(len(prefix) + 1), F.length(token))
    ok = token.startswith(prefix) & (F.instr(rest, ".") == TOKEN_PREFIX_CHARS + 1)
    return F.when(ok, F.substring(rest, 1, TOKEN_PREFIX_CHARS))


def users_of(tokens: DataFrame, users: DataFrame, prefix: str, secret: bytes) -> DataFrame:
    """Tokens with the user whose id they name, if the hash that the user has is theirs."""
    df = tokens.withColumn("id", token_user(F.col("token"), prefix)).join(users.select("id", "api_token_hash"), "id")
    return df.filter(F.col("api_token_hash") == hmac_sha256(secret, F.col("token"))).select("token", F.col("id").alias("user_id"))


def unseen_conversations(server: DataFrame, local: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversations of the server that are not here yet and have a turn."""
    return server.join(local.select("conv_id"), "conv_id", "left_anti").join(turns.select("conv_id").distinct(), "conv_id", "left_semi")
