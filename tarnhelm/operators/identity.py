"""Who sent a request, and which tenants an administrator may manage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnhelm.operators.policy import root_tenant

TOKEN_PREFIX = "dev:"  # fixed value: prefix of a session token


def _subject(token: Column) -> Column:
    body = F.substring(token, len(TOKEN_PREFIX) + 1, 1 << 20)
    return F.when(token.startswith(TOKEN_PREFIX) & (body != ""), body)


def resolve_actors(requests: DataFrame, actors: DataFrame, tenants: DataFrame) -> DataFrame:
    """First rung of the identity ladder that names a known actor.

    Requests: request_id, tenant_id, spiffe, authorization, cookie, claimed, user_agent.
    Each request offers at most eight (tenant, scope, kind, value) probes in ladder
    order; one equi-join finds them and the lowest rung wins.
    """
    c = F.col
    has_bearer = F.coalesce(F.lower("authorization").startswith("bearer "), F.lit(False))
    bearer = F.when(has_bearer, _subject(F.trim(F.substring("authorization", 8, 1 << 20))))
    cookie = _subject(c("cookie"))
    has_cookie = c("cookie").isNotNull()
    both = has_bearer & has_cookie
    conflict = both & (bearer.isNull() | cookie.isNull() | (bearer != cookie))
    r = requests.join(
        root_tenant(tenants).select("tenant_id", "root_id"), "tenant_id", "left"
    ).withColumns(
        {
            "_conflict": F.coalesce(conflict, F.lit(False)),
            "_subject": F.when(~F.coalesce(conflict, F.lit(False)), F.coalesce(bearer, cookie)),
        }
    )

    def probe(rung: int, source: str, tenant: str, scope: str, kind: str, value: str) -> Column:
        return F.struct(
            F.lit(rung).alias("rung"), F.lit(source).alias("source"),
            c(tenant).alias("actor_tenant"), F.lit(scope).alias("scope"),
            F.lit(kind).alias("kind"), c(value).alias("value"),
        )

    probes = F.array(
        probe(1, "mtls", "tenant_id", "tenant", "workload", "spiffe"),
        probe(2, "mtls", "root_id", "organisation", "workload", "spiffe"),
        probe(3, "session", "tenant_id", "tenant", "subject", "_subject"),
        probe(4, "session", "root_id", "organisation", "subject", "_subject"),
        probe(5, "interception_header", "tenant_id", "tenant", "subject", "claimed"),
        probe(6, "interception_header", "tenant_id", "tenant", "workload", "claimed"),
        probe(7, "interception_header", "root_id", "organisation", "subject", "claimed"),
        probe(8, "interception_header", "root_id", "organisation", "workload", "claimed"),
    )
    asked = r.select(
        "request_id",
        F.explode(F.filter(probes, lambda p: p["value"].isNotNull() & (p["value"] != "")))
        .alias("_p"),
    ).select("request_id", "_p.*")
    known = actors.select(
        c("id").alias("actor_id"), c("tenant_id").alias("actor_tenant"), "scope", "role",
        "groups",
        F.explode(
            F.array(
                F.struct(F.lit("subject").alias("kind"), c("idp_subject").alias("value")),
                F.struct(F.lit("workload").alias("kind"), c("workload_id").alias("value")),
            )
        ).alias("_k"),
    ).select("actor_id", "actor_tenant", "scope", "role", "groups", "_k.kind", "_k.value")
    found = asked.join(known, ["actor_tenant", "scope", "kind", "value"]).groupBy(
        "request_id"
    ).agg(
        F.min_by(
            F.struct("rung", "actor_id", "role", "groups", "source", "scope"), "rung"
        ).alias("_a")
    )
    hint = F.coalesce(
        F.nullif(c("claimed"), F.lit("")), F.nullif(c("user_agent"), F.lit("")),
        F.lit("anonymous"),
    )
    print_ = F.substring(F.sha2(F.concat_ws("|", c("tenant_id"), hint), 256), 1, 16)
    # A workload identity is looked at before the other credentials, so it also settles
    # requests whose bearer and cookie disagree.
    by_mtls = c("_a.rung") <= 2
    blocked = c("_conflict") & ~F.coalesce(by_mtls, F.lit(False))
    hit = c("_a").isNotNull() & ~blocked
    return r.join(found, "request_id", "left").select(
        "request_id", "tenant_id",
        F.when(blocked, "conflict").otherwise("ok").alias("status"),
        F.when(hit, c("_a.actor_id"))
        .when(~blocked, F.concat(F.lit("act_unreg_"), print_)).alias("actor_id"),
        F.when(hit, c("_a.role")).when(~blocked, F.lit("unregistered")).alias("role"),
        F.when(hit, c("_a.groups")).otherwise(F.array().cast("array<string>")).alias("groups"),
        hit.alias("registered"),
        F.when(hit, c("_a.source")).when(~blocked, F.lit("unregistered")).alias("source"),
        F.when(hit, c("_a.scope")).when(~blocked, F.lit("tenant")).alias("scope"),
    )


def admin_scope(actors: DataFrame, tenants: DataFrame) -> DataFrame:
    """(administrator, tenant) pairs that may be managed.

    Two equi-joins: organisation scope meets tenants on their root, tenant scope on the
    tenant itself.
    """
    admins = actors.filter("role = 'security_admin' and registered").select(
        F.col("id").alias("actor_id"), "tenant_id", "scope"
    )
    roots = root_tenant(tenants).filter("status = 'ok'").select(
        F.col("tenant_id").alias("target_id"), F.col("root_id").alias("tenant_id")
    )
    wide = admins.filter("scope = 'organisation'").join(roots, "tenant_id")
    own = admins.filter("scope = 'tenant'").join(
        tenants.select(F.col("id").alias("tenant_id")), "tenant_id"
    ).withColumn("target_id", F.col("tenant_id"))
    return wide.select("actor_id", "target_id").unionByName(own.select("actor_id", "target_id"))


def check_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """A named session has to belong to the same tenant and actor."""
    s = sessions.select(
        F.col("id").alias("session_id"), F.col("tenant_id").alias("_tenant"),
        F.col("actor_id").alias("_actor"),
    )
    status = (
        F.when(F.col("session_id").isNull(), "new")
        .when(F.col("_tenant").isNull(), "unknown")
        .when(
            (F.col("_tenant") != F.col("tenant_id")) | (F.col("_actor") != F.col("actor_id")),
            "mismatch",
        )
        .otherwise("ok")
    )
    return requests.join(s, "session_id", "left").withColumn("session_status", status).drop(
        "_tenant", "_actor"
    )


def onboarding(actors: DataFrame) -> DataFrame:
    """Unregistered actors to look at, in a stable order."""
    return actors.filter("role = 'unregistered'").orderBy("tenant_id", "id")


def groups_by_tenant(groups: DataFrame) -> DataFrame:
    return groups.orderBy("tenant_id", "name")
