"""Tenants' state as replays of ordered events: metering, skills, members, shares, merge jobs, subscriptions.

A replay takes events with an order (`at`, then `id`) and works each key's events in order by windows or folds over the
key's own events; keys are tenants, jobs or requests, whose events are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import valid_skill


#: The roles of a member.
ROLES = ("member", "writer", "admin")


def admit(requests: DataFrame, cap: int, order: list[str]) -> DataFrame:
    """requests with admitted: the first cap of each team and period; a refused one doesn't count; cap 0 or less admits all."""
    if cap <= 0:
        return requests.withColumn("admitted", F.lit(True))
    return requests.withColumn("admitted", F.row_number().over(Window.partitionBy("team_id", "period").orderBy(*order)) <= cap)


def skill_history(writes: DataFrame) -> DataFrame:
    """(team_id, name, description, content, updated_by, version): the state after writes by writers and admins whose fields
    are in bounds; every write counts the version up."""
    good = writes.where(F.col("role").isin("writer", "admin") & valid_skill(F.col("name"), F.col("description"), F.col("content")))
    last = F.max_by(F.struct("description", "content", "updated_by"), F.struct("at", "id"))
    return good.groupBy("team_id", "name").agg(last.alias("s"), F.count("*").alias("version")).select("team_id", "name", "s.*", "version")


def list_skills(skills: DataFrame, team: str) -> DataFrame:
    return skills.where(F.col("team_id") == team).select("name", "description", "version").orderBy("name")


def skillset(writes: DataFrame) -> DataFrame:
    """(content, version): the one shared text after the writes of superadmins."""
    good = writes.where("is_super and trim(content) <> ''")
    return good.agg(F.max_by("content", F.struct("at", "id")).alias("content"), F.count("*").alias("version")).where("version > 0")


def members(memberships: DataFrame, users: DataFrame, team: str) -> DataFrame:
    """A team's members in the order in which they came; without a role they are members."""
    own = memberships.where(F.col("team_id") == team).join(users, "user_id")
    return own.select("user_id", "email", F.coalesce(F.nullif("role", F.lit("")), F.lit("member")).alias("role"), "created_at").orderBy("created_at", "user_id")


def my_teams(memberships: DataFrame, teams: DataFrame, user: str) -> DataFrame:
    return teams.join(memberships.where(F.col("user_id") == user).select("team_id"), "team_id", "left_semi").orderBy(F.desc("created_at"), "team_id")


def set_role(memberships: DataFrame, team: str, user: str, role: str | None) -> DataFrame:
    """memberships with one role changed, or the member removed where role is None; a team's last admin stays one."""
    if role is not None and role not in ROLES:
        raise ValueError(f"unknown role {role!r}")
    own = F.col("team_id") == team
    admins = memberships.where(own & (F.col("role") == "admin") & (F.col("user_id") != user)).isEmpty()
    was = not memberships.where(own & (F.col("user_id") == user) & (F.col("role") == "admin")).isEmpty()
    if was and admins and role != "admin":
        raise ValueError("the last admin can't go")
    hit = own & (F.col("user_id") == user)
    return memberships.where(~hit) if role is None else memberships.withColumn("role", F.when(hit, F.lit(role)).otherwise(F.col("role")))


def add_member(memberships: DataFrame, users: DataFrame, team: str, email: str, role: str, now: str) -> DataFrame:
    """memberships (team_id, user_id, role, created_at) with the user of an email, in any case, added; an unknown role or user, and
    one who is there, are errors."""
    if role not in ROLES:
        raise ValueError(f"unknown role {role!r}")
    new = users.where(F.lower(F.trim("email")) == email.strip().lower()).limit(1).select(F.lit(team).alias("team_id"), "user_id", F.lit(role).alias("role"), F.lit(now).alias("created_at"))
    if new.isEmpty():
        raise ValueError("no user has this email")
    if not memberships.join(new, ["team_id", "user_id"], "left_semi").isEmpty():
        raise ValueError("the user is a member already")
    return memberships.unionByName(new, allowMissingColumns=True)


def remove_member(memberships: DataFrame, keys: DataFrame, team: str, user: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(memberships, keys) without a member, whose keys of the team that still hold are revoked; a team's last admin stays."""
    mine = (F.col("team_id") == team) & (F.col("user_id") == user)
    if memberships.where(mine).isEmpty():
        raise ValueError("not a member")
    return set_role(memberships, team, user, None), keys.withColumn("revoked_at", F.when(mine & F.col("revoked_at").isNull(), F.lit(now)).otherwise(F.col("revoked_at")))


def team_caps(teams: DataFrame, plans: DataFrame) -> DataFrame:
    """(team_id, cap): the plan's monthly cap, 0 without a plan."""
    return teams.join(plans.select("plan_id", "monthly_cap"), "plan_id", "left").select("team_id", F.coalesce("monthly_cap", F.lit(0)).alias("cap"))


def shares(events: DataFrame) -> DataFrame:
    """(from_team, to_team, wing, requests, accepted, declined, status) after events (op: request, accept, decline, reopen).
    A triple has one pending request at a time: a request while one is pending, and an answer while none is, do nothing."""
    each = events.groupBy("from_team", "to_team", "wing").agg(F.array_sort(F.collect_list(F.struct("at", "id", "op"))).alias("ops"))
    begin = F.struct(F.lit("none").alias("status"), F.lit(0).alias("requests"), F.lit(0).alias("accepted"), F.lit(0).alias("declined"))

    def step(s, e):
        new = (e["op"] == "request") & (s["status"] != "pending")
        yes, no = (s["status"] == "pending") & (e["op"] == "accept"), (s["status"] == "pending") & (e["op"] == "decline")
        again = (e["op"] == "reopen") & (s["status"] == "accepted")
        status = F.when(new | again, "pending").when(yes, "accepted").when(no, "declined").otherwise(s["status"])
        return F.struct(status.alias("status"), (s["requests"] + new.cast("int")).alias("requests"), (s["accepted"] + yes.cast("int") - again.cast("int")).alias("accepted"), (s["declined"] + no.cast("int")).alias("declined"))

    done = each.where("from_team <> to_team").withColumn("s", F.aggregate("ops", begin, step))
    return done.select("from_team", "to_team", "wing", "s.*").where("requests > 0")


def incoming(requests: DataFrame, team: str) -> DataFrame:
    return requests.where((F.col("to_team") == team) & (F.col("status") == "pending")).orderBy(F.desc("created_at"), "id")


def claim_next(jobs: DataFrame) -> DataFrame:
    """The oldest queued merge job, at most one row."""
    return jobs.where("status = 'queued'").orderBy("created_at", "id").limit(1)


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, drawers): after events enqueue, claim, done, fail and release; each only from the state that allows it."""
    each = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "op", "drawers"))).alias("ops"))
    begin = F.struct(F.lit("none").alias("status"), F.lit(0).cast("long").alias("drawers"))
    moves = (("enqueue", "none", "queued"), ("claim", "queued", "running"), ("done", "running", "done"), ("fail", "running", "failed"), ("release", "running", "queued"))

    def step(s, e):
        status = s["status"]
        for op, before, after in moves:
            status = F.when((e["op"] == op) & (s["status"] == before), after).otherwise(status)
        ended = (e["op"] == "done") & (s["status"] == "running")
        return F.struct(status.alias("status"), F.when(ended, F.coalesce(e["drawers"], F.lit(0))).otherwise(s["drawers"]).cast("long").alias("drawers"))

    return each.withColumn("s", F.aggregate("ops", begin, step)).select("job_id", "s.*")


def subscriptions(events: DataFrame, free: str = "free") -> DataFrame:
    """(team_id, plan, status, created_at): after activate and cancel events in their own order (`seq`), whenever they came; an
    activation older than a cancel changes nothing, and a cancel goes back to the free plan."""
    last = F.max_by(F.struct("op", "plan"), F.struct("seq", "id"))
    done = events.groupBy("team_id").agg(last.alias("l"), F.min("at").alias("created_at"))
    on = F.col("l.op") == "activate"
    return done.select("team_id", F.when(on, F.col("l.plan")).otherwise(free).alias("plan"), F.when(on, "active").otherwise("canceled").alias("status"), "created_at")
