"""Projects, proposals, review sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklore.session import materialize

# The fields a proposal can set, with the default of a new project.
DEFAULTS = {
    "title": '"Untitled Project"', "description": '""', "goals": "[]", "status": '"active"', "myRole": '"informed"',
    "participants": "[]", "sources": "[]", "tags": "[]", "metadata": "{}",
}
FIELDS = list(DEFAULTS)
APPROVED = ["approved", "edited"]


def create_projects(requests: DataFrame, as_of: str, id_col: Column | None = None) -> DataFrame:
    """New projects with defaults for what the request leaves out.

    Fields hold JSON text.  ``id_col`` gives the id; without it one is drawn.
    """
    now = F.lit(as_of).cast("timestamp")
    have = set(requests.columns)
    value = lambda f: F.coalesce(F.col(f), F.lit(DEFAULTS[f])) if f in have else F.lit(DEFAULTS[f])
    return requests.select(
        (id_col if id_col is not None else F.uuid()).alias("project_id"), *[value(f).alias(f) for f in FIELDS],
        now.alias("created_at"), now.alias("updated_at"),
    )


def list_projects(df: DataFrame, status: str | None = None, role: str | None = None) -> DataFrame:
    if status:
        df = df.filter(F.col("status") == status)
    if role:
        df = df.filter(F.col("my_role") == role)
    return df.orderBy(F.desc("updated_at"), "project_id")


def patch(df: DataFrame, requests: DataFrame, as_of: str, key: str = "project_id") -> DataFrame:
    """Fields given in a request win; a patched row gets the new time."""
    fields = [c for c in requests.columns if c != key]
    r = requests.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = df.join(r, key, "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c))
    out = out.withColumn("updated_at", F.when(F.col("_hit"), F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at")))
    return out.drop("_hit", *[f"_new_{c}" for c in fields])


def list_proposals(df: DataFrame, session: str | None = None, status: str | None = None) -> DataFrame:
    if session:
        df = df.filter(F.col("session_id") == session)
    if status:
        df = df.filter(F.col("status") == status)
    return df.orderBy("created_at", "seq")


def review(proposals: DataFrame, actions: DataFrame, as_of: str) -> DataFrame:
    """``actions`` is (proposal_id, action, edited_value)."""
    a = actions.select("proposal_id", "action", "edited_value")
    said = F.when(F.col("action") == "edit", "edited").when(F.col("action") == "approve", "approved").otherwise("rejected")
    hit = F.col("action").isNotNull()
    return proposals.join(a, "proposal_id", "left").withColumns({
        "status": F.when(hit, said).otherwise(F.col("status")),
        "reviewed_at": F.when(hit, F.lit(as_of).cast("timestamp")),
        "new_value": F.when(F.col("action") == "edit", F.coalesce("edited_value", "new_value")).otherwise(F.col("new_value")),
    }).drop("action", "edited_value")


def batch_review(proposals: DataFrame, ids: DataFrame, action: str, as_of: str) -> DataFrame:
    actions = ids.select("proposal_id").distinct().select("proposal_id", F.lit(action).alias("action"), F.lit(None).cast("string").alias("edited_value"))
    return review(proposals, actions, as_of)


def group_key() -> Column:
    return F.coalesce("project_id", F.lit("new"))


def proposal_groups(proposals: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members): one row per session and project with its title and
    size; and the proposals under their group, which no row has to hold whole.
    """
    keyed = proposals.withColumn("group_id", group_key())
    sizes = keyed.groupBy("session_id", "group_id").agg(F.count(F.lit(1)).alias("n_proposals"), F.min("created_at").alias("first_at"))
    titles = projects.select(F.col("project_id").alias("group_id"), F.col("title").alias("project_title"))
    groups = sizes.join(titles, "group_id", "left").withColumn("is_new", F.col("group_id") == "new")
    return groups, keyed.select("session_id", "group_id", "proposal_id", "field", "new_value", "status", "created_at")


def approved_fields(proposals: DataFrame) -> DataFrame:
    """One row per session and project, a column per field, the last value wins."""
    ok = proposals.filter(F.col("status").isin(APPROVED)).withColumn("group_id", group_key())
    return ok.groupBy("session_id", "group_id").pivot("field", FIELDS).agg(F.max_by("new_value", F.struct("created_at", "seq")))


def apply_approved(proposals: DataFrame, projects: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(created projects, patched projects) of every session."""
    wide = approved_fields(proposals)
    created = create_projects(wide.filter(F.col("group_id") == "new"), as_of, F.concat(F.lit("new_"), "session_id"))
    changes = wide.filter(F.col("group_id") != "new").withColumnRenamed("group_id", "project_id")
    one = changes.groupBy("project_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("session_id"))).alias(f) for f in FIELDS])
    return created, patch(projects.join(one.select("project_id"), "project_id", "left_semi"), one, as_of)


def to_proposals(rows: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """One row per field that has a value."""
    return rows.unpivot(keys, fields, "field", "new_value").filter(F.col("new_value").isNotNull())


def update_proposals(requests: DataFrame, projects: DataFrame, fields: list[str]) -> DataFrame:
    """Requested changes with the value the project has now."""
    now = to_proposals(projects, fields, ["project_id"]).withColumnRenamed("new_value", "old_value")
    return requests.join(now, ["project_id", "field"], "left")


def sessions(proposals: DataFrame) -> DataFrame:
    """Per session: proposals, how many are open, done once none is."""
    per = proposals.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_proposals"), F.count_if(F.col("status") == "pending").alias("n_pending"),
        F.min("created_at").alias("started_at"), F.max("created_at").alias("_last"),
    )
    done = F.col("n_pending") == 0
    return per.withColumn("status", F.when(done, "completed").otherwise("running")).withColumn(
        "completed_at", F.when(done, F.col("_last"))
    ).drop("_last")


# Kind of a project source and the document column it names.
LINK_COLUMNS = {"jira_project": ("jira", "project"), "slack_channel": ("slack", "channel"), "drive_folder": ("drive", "folder_path"),
                "confluence_space": ("confluence", "space"), "gmail_label": ("gmail", "label")}


#: Links, and documents, of one identifier that meet in one cell.
CELL = 1000


def link_docs(links: DataFrame, docs: DataFrame, cell: int = CELL) -> DataFrame:
    """Documents of each project; ``links`` is (project_id, kind, identifier).

    Both sides are made distinct before they meet, so the pairs are not
    shuffled; only documents with several identifiers can meet a project twice,
    and only their pairs are made distinct.  Links and documents of one
    identifier meet in cells, so a common one is dealt out over many tasks.
    """
    kind = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for name, (source, column) in LINK_COLUMNS.items():
        if column in docs.columns:
            kind = F.when(F.col("source") == source, name).otherwise(kind)
            value = F.when(F.col("source") == source, F.col(column)).otherwise(value)
    key = ["kind", "identifier"]
    links = links.select("project_id", *key).distinct()
    keyed = docs.select("id", "source", kind.alias("kind"), value.alias("identifier")).join(links.select(*key).distinct(), key, "left_semi").distinct()
    keyed = materialize(keyed.withColumn("n_keys", F.count(F.lit(1)).over(Window.partitionBy("id", "source"))), "linked-docs")
    cells = lambda rows, name: rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / cell).alias(name))
    sizes = cells(links, "link_cells").join(cells(keyed, "doc_cells"), key)
    of = lambda column, n: F.pmod(F.xxhash64(column), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = links.join(sizes, key).select("project_id", *key, of("project_id", "link_cells").alias("_l"), each("doc_cells").alias("_d"))
    right = keyed.join(sizes, key).select("id", "source", "n_keys", *key, of("id", "doc_cells").alias("_d"), each("link_cells").alias("_l"))
    # Given by number: the cells are small, what they make is not, so tasks must not be put together by their input.
    left = left.repartition(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "_l", "_d")
    pairs = lambda rows: left.join(rows, [*key, "_l", "_d"]).select("project_id", "id", "source")
    once = pairs(right.filter(F.col("n_keys") == 1))
    if keyed.filter(F.col("n_keys") > 1).isEmpty():
        return once
    return once.unionByName(pairs(right.filter(F.col("n_keys") > 1)).distinct())


def project_signals(docs: DataFrame, sources: list[str], identifier: str = "identifier", person: str = "person") -> DataFrame:
    """Per identifier: activity by source, people, last seen."""
    counts = docs.groupBy(identifier).pivot("source", sources).agg(F.count(F.lit(1))).na.fill(0, sources)
    pairs = docs.groupBy(identifier, person).agg(F.max("seen_at").alias("_last"))
    people = pairs.groupBy(identifier).agg(F.count(person).alias("n_people"), F.max("_last").alias("last_seen"))
    return counts.join(people, identifier)


def signal_people(docs: DataFrame, identifier: str = "identifier", person: str = "person") -> DataFrame:
    """The people behind the signals, one row each."""
    return docs.filter(F.col(person).isNotNull()).groupBy(identifier, person).agg(F.count(F.lit(1)).alias("n"))
