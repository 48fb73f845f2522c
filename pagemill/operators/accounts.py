"""Accounts: lock-out after failed logins, sessions and what they join with, keys, and updates of the stores.

Stores are DataFrames; an update gives the new store. Times are epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import text as X

MAX_FAILURES, LOCK_SECONDS = 8, 300.0


def lockouts(attempts: DataFrame, most: int = MAX_FAILURES, seconds: float = LOCK_SECONDS) -> DataFrame:
    """State after each attempt (user_id, ts, success): failures, locked (the attempt met a lock) and until.

    A success clears an account; the failure that reaches `most` locks it, and while the lock holds attempts are
    refused without counting; the first attempt after it starts anew. Attempts of one user fold in time order,
    streamed through a sorted partition, so no user's history is held in memory."""
    schema = T.StructType([*attempts.schema.fields, T.StructField("failures", T.IntegerType()), T.StructField("locked", T.BooleanType()), T.StructField("until", T.DoubleType())])
    order = attempts.repartition("user_id").sortWithinPartitions("user_id", "ts")

    def fold(parts):
        user, count, until = None, 0, 0.0
        for pdf in parts:
            out = []
            for u, ts, ok in zip(pdf["user_id"], pdf["ts"], pdf["success"], strict=True):
                if u != user:
                    user, count, until = u, 0, 0.0
                locked = False
                if count >= most:
                    if ts >= until:
                        count, until = 0, 0.0
                    else:
                        locked = True
                if not locked:
                    if ok:
                        count, until = 0, 0.0
                    else:
                        count += 1
                        if count >= most:
                            until = ts + seconds
                out.append((count, locked, until))
            pdf["failures"], pdf["locked"], pdf["until"] = ([x[i] for x in out] for i in range(3))
            yield pdf

    return order.mapInPandas(fold, schema)


def live_sessions(sessions: DataFrame, now: float) -> DataFrame:
    return sessions.filter(F.col("expires_at") > now)


def users_by_session(sessions: DataFrame, users: DataFrame, tokens: DataFrame, now: float) -> DataFrame:
    """The user of each token (token) whose session has not expired."""
    asked = tokens.filter(F.length("token") > 0).select("token", X.token_hash(F.col("token")).alias("token_hash"))
    found = asked.join(live_sessions(sessions, now), "token_hash").select("token", "user_id")
    return found.join(users, found["user_id"] == users["id"]).select("token", "id", "username", (F.col("is_admin") == 1).alias("is_admin"), "created_at")


def renewed(sessions: DataFrame, now: float, ttl: float, min_remaining: float) -> DataFrame:
    """Sessions that live but end within min_remaining last ttl from now."""
    stale = (F.col("expires_at") > now) & (F.col("expires_at") < now + min_remaining)
    return sessions.withColumns({"renewed": stale, "expires_at": F.when(stale, F.lit(now + ttl)).otherwise(F.col("expires_at"))})


def create_session(sessions: DataFrame, rows: DataFrame, now: float, ttl: float) -> DataFrame:
    """rows: token, user_id."""
    return sessions.unionByName(rows.select(X.token_hash(F.col("token")).alias("token_hash"), "user_id", F.lit(now).alias("created_at"), F.lit(now + ttl).alias("expires_at")))


def delete_session(sessions: DataFrame, token: str) -> DataFrame:
    return sessions.filter(F.col("token_hash") != X.token_hash(F.lit(token)))


def delete_sessions(sessions: DataFrame, user_id, keep: str | None = None) -> DataFrame:
    mine = F.col("user_id") == user_id
    return sessions.filter(~mine | (F.col("token_hash") == X.token_hash(F.lit(keep)))) if keep else sessions.filter(~mine)


def create_users(users: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store with rows whose normalised names are new, and the rows that are refused. Of new rows with one
    name the first created stays."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("username_norm").orderBy("created_at", "id")
    first = rows.withColumn("_n", F.row_number().over(w))
    taken = users.select(F.col("username_norm").alias("_norm")).distinct().withColumn("_taken", F.lit(True))
    marked = first.join(taken, F.col("username_norm") == F.col("_norm"), "left")
    ok = F.col("_taken").isNull() & (F.col("_n") == 1)
    return users.unionByName(marked.filter(ok).select(*users.columns)), marked.filter(~ok).select(*users.columns)


def ensure_admin(users: DataFrame, row: DataFrame) -> DataFrame:
    """Without any admin, the named account becomes one, new if need be; never changes its password."""
    admins = users.agg(F.count_if(F.col("is_admin") == 1).alias("_admins"))
    wanted = row.join(F.broadcast(admins.filter("_admins = 0")), how="inner", on=F.lit(True)).drop("_admins")
    names = wanted.select(F.col("username_norm").alias("_norm"))
    promoted = users.join(F.broadcast(names), F.col("username_norm") == F.col("_norm"), "left").withColumn("is_admin", F.when(F.col("_norm").isNotNull(), 1).otherwise(F.col("is_admin"))).drop("_norm")
    new = wanted.join(users.select("username_norm"), "username_norm", "left_anti").withColumn("is_admin", F.lit(1))
    return promoted.unionByName(new.select(*users.columns))


def count_admins(users: DataFrame) -> DataFrame:
    return users.agg(F.count_if(F.col("is_admin") == 1).alias("admins"))


def deletable(users: DataFrame, actor: str) -> DataFrame:
    """Users that the admin `actor` may delete: not itself, and not the last admin."""
    admins = F.broadcast(count_admins(users))
    return users.join(admins, F.lit(True)).filter((F.col("id") != actor) & ((F.col("is_admin") != 1) | (F.col("admins") > 1))).drop("admins")


def list_users(users: DataFrame) -> DataFrame:
    return users.orderBy("created_at").select("id", "username", (F.col("is_admin") == 1).alias("is_admin"), "created_at")


def set_password(users: DataFrame, user_id, password_hash: str) -> DataFrame:
    return users.withColumn("password_hash", F.when(F.col("id") == user_id, F.lit(password_hash)).otherwise(F.col("password_hash")))


def delete_users(stores: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Stores without the users of gone (user_id): users and, by their keys, sessions and user_api_keys; jobs and
    segment_cache have no key, so they keep their rows until purge()."""
    out = dict(stores)
    out["users"] = stores["users"].join(gone, stores["users"]["id"] == gone["user_id"], "left_anti")
    for name in ("sessions", "user_api_keys"):
        out[name] = stores[name].join(gone, "user_id", "left_anti")
    return out


def purge(stores: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """delete_users() and the rows of jobs and segment_cache too."""
    out = delete_users(stores, gone)
    for name in ("jobs", "segment_cache"):
        out[name] = stores[name].join(gone, "user_id", "left_anti")
    return out


def update_api_keys(keys: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """changes: user_id and the other columns; null leaves a value, blank clears it; rows come to be."""
    fields = [c for c in keys.columns if c not in ("user_id", "updated_at")]
    some = F.coalesce(*[F.col(f).isNotNull() for f in fields[:1]], F.lit(False))
    for f in fields[1:]:
        some = some | F.col(f).isNotNull()
    c = changes.filter(some).select(F.col("user_id").alias("_user"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = keys.join(c, F.col("user_id") == F.col("_user"), "full_outer")
    value = lambda f: F.when(F.col(f"_{f}").isNull(), F.col(f)).otherwise(F.nullif(X.strip(F.col(f"_{f}")), F.lit("")))
    return both.select(F.coalesce("user_id", "_user").alias("user_id"), *[value(f).alias(f) for f in fields], F.when(F.col("_user").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))


def provider_keys(keys: DataFrame) -> DataFrame:
    """user_id, provider, api_key: two providers share one key."""
    pairs = F.array(F.struct(F.lit("gemini").alias("provider"), F.col("gemini_key").alias("api_key")), F.struct(F.lit("gemma").alias("provider"), F.col("gemini_key").alias("api_key")), F.struct(F.lit("qwen").alias("provider"), F.col("qwen_key").alias("api_key")))
    return keys.select("user_id", F.explode(pairs).alias("_x")).select("user_id", "_x.provider", F.nullif(F.col("_x.api_key"), F.lit("")).alias("api_key"))


def provider_options(keys: DataFrame) -> DataFrame:
    """user_id, provider and the options that only one provider has."""
    return keys.select("user_id", F.lit("qwen").alias("provider"), F.nullif("qwen_base_url", F.lit("")).alias("base_url"), F.nullif("qwen_model", F.lit("")).alias("model"))


def key_status(keys: DataFrame) -> DataFrame:
    k = provider_keys(keys)
    return k.select("user_id", "provider", F.col("api_key").isNotNull().alias("is_set"), X.mask_key(F.col("api_key")).alias("masked"))


def usable_providers(keys: DataFrame, default_base_url: str = "") -> DataFrame:
    """Whether each provider has its key and, where it takes one, a base address."""
    o = provider_options(keys).select("user_id", "provider", "base_url")
    base = X.strip(F.coalesce("base_url", F.lit(default_base_url)))
    return provider_keys(keys).join(o, ["user_id", "provider"], "left").select("user_id", "provider", (F.col("api_key").isNotNull() & ((F.col("provider") != "qwen") | (base != ""))).alias("usable"))


def default_provider(usable: DataFrame, order: list[str]) -> DataFrame:
    """provider of each user (user_id, provider, usable, chosen): the chosen one if it is usable, else the first
    usable one in display order, else empty."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("provider"))
    best = F.min_by("provider", F.when(F.col("usable"), F.when(F.col("provider") == F.col("chosen"), 0).otherwise(rank)))
    return usable.groupBy("user_id").agg(F.coalesce(best, F.lit("")).alias("provider"))


def admins_only(users: DataFrame) -> DataFrame:
    return users.filter(F.col("is_admin") == 1)


def rolling(now: Column, expires_at: Column, ttl: float) -> Column:
    """A session used in the second half of its life lasts ttl from now."""
    return F.when((expires_at > now) & (expires_at < now + ttl // 2), now + ttl).otherwise(expires_at)
