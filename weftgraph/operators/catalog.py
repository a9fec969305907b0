"""The project catalog: listing, search, paging, summaries, names, and its upkeep."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schemas as S

PAGE, MOST = 12, 100
SORTS = ("updated", "name")


class NotFound(LookupError):
    """No such row, or not the caller's: the two are not told apart."""


class NameTaken(ValueError):
    """The owner has a project of that name."""


def checked_paging(limit: int = PAGE, offset: int = 0, search: str = "", sort: str = "updated") -> None:
    if not 1 <= limit <= MOST or offset < 0 or len(search) > 255 or sort not in SORTS:
        raise ValueError(f"limit 1 to {MOST}, offset 0 or more, search up to 255 characters, sort one of {SORTS}")


def matching(projects: DataFrame, owner, search: str = "", project_type: str | None = None, owner_col: str = "owner_id", name_col: str = "name", type_col: str = "project_type") -> DataFrame:
    """An owner's projects, of one type if given, whose name holds the term literally, without regard to case."""
    out = projects.where(F.col(owner_col) == F.lit(owner))
    if project_type is not None:
        out = out.where(F.col(type_col) == project_type)
    term = search.strip().lower()
    return out.where(F.contains(F.lower(name_col), F.lit(term))) if term else out


def listing(projects: DataFrame, owner, search: str = "", sort: str = "updated", limit: int = PAGE, offset: int = 0, project_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one page, a row with the total); the page is a top-k, not a full sort."""
    checked_paging(limit, offset, search, sort)
    rows = matching(projects, owner, search, project_type)
    order = [F.lower("name").asc(), F.col("id").asc()] if sort == "name" else [F.col("updated_at").desc(), F.col("id").desc()]
    return rows.orderBy(*order).offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))


def owned(projects: DataFrame, owner: int, project: int) -> DataFrame:
    rows = projects.where((F.col("id") == project) & (F.col("owner_id") == owner))
    if rows.isEmpty():
        raise NotFound(f"project {project}")
    return rows


def find_user(users: DataFrame, id: int | None = None, email: str | None = None, username: str | None = None) -> DataFrame:
    rule = F.col("id") == id if id is not None else F.col("email") == email if email is not None else F.lower("username") == (username or "").lower()
    return users.where(rule).limit(1)


def name_key(name: Column | str) -> Column:
    return F.lower(F.trim(name))


def name_conflicts(projects: DataFrame, owner: str = "owner_id", name: str = "name") -> DataFrame:
    """Names that an owner uses more than once, without regard to case and outer blanks."""
    return projects.groupBy(F.col(owner).alias("owner"), name_key(name).alias("name_key")).agg(F.count("*").alias("n")).where("n > 1")


def check_name(projects: DataFrame, owner: int, name: str, exclude: int | None = None) -> None:
    rows = projects.where((F.col("owner_id") == owner) & (name_key("name") == name.strip().lower()))
    if exclude is not None:
        rows = rows.where(F.col("id") != exclude)
    if not rows.isEmpty():
        raise NameTaken(name.strip())


def opened(projects: DataFrame) -> DataFrame:
    """Stored JSON as typed documents; missing code inputs get empty ones."""
    inputs = F.coalesce(S.parsed(F.col("code_inputs"), S.CODE_INPUTS), F.from_json(F.lit("{}"), S.schema(S.CODE_INPUTS)))
    return projects.withColumns({"document": S.parsed(F.col("document"), S.CLASS_DOC), "activity_document": S.parsed(F.col("activity_document"), S.ACTIVITY_DOC), "code_inputs": inputs})


def stored(projects: DataFrame) -> DataFrame:
    """Typed documents as JSON text; nulls are written."""
    return projects.withColumns({c: F.when(F.col(c).isNotNull(), F.to_json(c, {"ignoreNullFields": "false"})) for c in ("document", "activity_document", "code_inputs")})


def summaries(projects: DataFrame) -> DataFrame:
    """Counts and the boxes of a thumbnail, which shows what the project type is about."""
    rows = opened(projects)
    box = lambda s: F.struct(s["position"]["x"].alias("x"), s["position"]["y"].alias("y"), s["size"]["width"].alias("width"), s["size"]["height"].alias("height"))
    shown = F.when((F.col("project_type") == "activity") & F.col("activity_document").isNotNull(), F.transform("activity_document.nodes", box)).otherwise(F.transform("document.classes", box))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return rows.select("id", "name", "project_type", "updated_at", size("document.classes").alias("class_count"), size("document.relationships").alias("relationship_count"), F.when(F.col("activity_document").isNull(), 0).otherwise(size("activity_document.nodes")).cast("long").alias("node_count"), shown.alias("class_boxes"))


def updated(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes by id: what is not null overwrites, and the row counts as updated then."""
    fields = [c for c in ("name", "document", "activity_document", "code_inputs") if c in changes.columns]
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = projects.join(new, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    return out.withColumn("updated_at", F.when(F.col("_hit"), F.current_timestamp().cast("timestamp_ntz")).otherwise(F.col("updated_at"))).select(*projects.columns)


def deleted(projects: DataFrame, ids: DataFrame) -> DataFrame:
    return projects.join(ids.select("id"), "id", "left_anti")


def without_users(users: DataFrame, projects: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users and projects after users are deleted; their projects go with them."""
    return users.join(gone.select("id"), "id", "left_anti"), projects.join(gone.select(F.col("id").alias("owner_id")), "owner_id", "left_anti").select(*projects.columns)


def evolved(table: DataFrame, ddl: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """A stored table with the columns it lacks added, nullable or with a default."""
    want = S.schema(ddl)
    have = set(table.columns)
    return table.withColumns({f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType) for f in want.fields if f.name not in have}).select(*want.fieldNames(), *[c for c in table.columns if c not in want.fieldNames()])


def backfilled_types(projects: DataFrame) -> DataFrame:
    """A project with an activity document and no classes is an activity project, any other stays."""
    no_class = F.coalesce(F.size(S.parsed(F.col("document"), "struct<classes:array<struct<id:string>>>")["classes"]), F.lit(0)) <= 0
    return projects.withColumn("project_type", F.when(F.col("activity_document").isNotNull() & no_class, "activity").otherwise(F.coalesce("project_type", F.lit("uml"))))


def username_base(email: Column | str) -> Column:
    kept = F.substring(F.regexp_replace(F.substring_index(email, "@", 1), "[^A-Za-z0-9_.-]", ""), 1, 30)
    return F.when(F.length(kept) < 3, "user").otherwise(kept)


def backfilled_usernames(users: DataFrame) -> DataFrame:
    """Usernames from the emails of accounts that have none, in the order of ids; usernames that are there stay and count as taken.

    Bases that no other row can reach are settled by a window; the others (a
    base that looks like another with a number, or was cut) are few, share a
    prefix, and go through a fold per prefix.
    """
    own = F.col("username") if "username" in users.columns else F.lit(None).cast("string")
    rows = users.withColumn("kept", own.isNotNull()).withColumn("base", F.coalesce(own, username_base("email")))
    # names of one stem - the base without a numeric tail, and short enough to take a number - can only meet each other
    rows = rows.withColumn("stem", F.regexp_replace(F.lower(F.substring("base", 1, 20)), "[0-9]+$", ""))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["kept", "id"], ascending=[False, True])
        taken, next_of, names = set(part.loc[part["kept"], "base"].str.lower()), {}, []
        for base, kept in zip(part["base"], part["kept"], strict=True):
            if kept:
                names.append(base)
                continue
            name, k = base, next_of.get(base.lower(), 1)
            while name.lower() in taken:
                k += 1
                name = base[: 30 - len(str(k))] + str(k)
            next_of[base.lower()] = k
            taken.add(name.lower())
            names.append(name)
        return pd.DataFrame({"id": part["id"], "username": names})

    n = F.count("*").over(Window.partitionBy("stem"))
    rows = rows.withColumn("n", n)
    alone = rows.where("n = 1").select("id", F.col("base").alias("username"))
    shared = rows.where("n > 1").select("id", "stem", "base", "kept").groupBy("stem").applyInPandas(fold, "id int, username string")
    return users.drop("username").join(alone.unionByName(shared), "id")


def valid_account(email: Column, username: Column, password: Column) -> Column:
    """array of problems of a new account's fields."""
    rules = [
        (email.rlike(r"^[^@]+@[^@]*\.[^@]*$"), "email"),
        (username.rlike("^[A-Za-z0-9_.-]{3,30}$"), "username"),
        (F.length(password) >= 8, "password"),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for ok, name in rules]))


def valid_project(name: Column, project_type: Column, has_document: Column, has_activity: Column) -> Column:
    """array of problems of a new project: a usable name, a known type, and the payload of that type."""
    rules = [
        (F.length(F.trim(name)).between(1, 255), "name"),
        (project_type.isin(*S.PROJECT_TYPES), "project_type"),
        (F.when(project_type == "activity", has_activity).otherwise(has_document), "payload"),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), what) for ok, what in rules]))


def taken_accounts(users: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose email is taken, or whose username is, without regard to case."""
    by_email = candidates.join(users.select("email"), "email", "left_semi").select("email", "username", F.lit("email").alias("taken"))
    names = users.select(F.lower("username").alias("_key")).distinct()
    by_name = candidates.join(names, F.lower(candidates["username"]) == F.col("_key"), "left_semi").select("email", "username", F.lit("username").alias("taken"))
    return by_email.unionByName(by_name)


def token_cut_off(issued_at: Column, password_changed_at: Column) -> Column:
    """Whether a token was issued before the password changed, in whole seconds."""
    return password_changed_at.isNotNull() & (F.unix_timestamp(issued_at) < F.unix_timestamp(password_changed_at))
