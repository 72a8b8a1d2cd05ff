"""Queries P01 to P13: projects and proposals."""

from pyspark.sql import functions as F

from worklore.functions.text import epoch_ms
from worklore.operators import projects as P
from worklore.plans.q_sources import c
from worklore.plans.registry import query
from worklore.plans.standins import CHECK_VIEWS, ORDERS_AS_OF, standin

AS_OF_MS = "epoch_ms(TIMESTAMP '2001-08-02 00:00:00')"


def ms(name):
    return epoch_ms(c(name))


def projects(spark, sf):
    return standin(spark, sf, "v_projects")


def proposals(spark, sf):
    return standin(spark, sf, "v_proposals")


@query(
    "p01_create",
    f"""SELECT project_id, title, coalesce(description, '""') AS description, status, '"informed"' AS "myRole", '[]' AS goals, '{{}}' AS metadata, {AS_OF_MS} AS created_ms FROM v_projects""",
)
def p01(spark, sf):
    made = P.create_projects(projects(spark, sf).select("project_id", "title", "description", "status"), ORDERS_AS_OF, c("project_id"))
    return made.select("project_id", "title", "description", "status", "myRole", "goals", "metadata", ms("created_at").alias("created_ms"))


@query("p02_list", "SELECT project_id, title, epoch_ms(updated_at) AS updated_ms FROM v_projects WHERE status = 'active' AND my_role = 'informed'")
def p02(spark, sf):
    return P.list_projects(projects(spark, sf), "active", "informed").select("project_id", "title", ms("updated_at").alias("updated_ms"))


@query(
    "p03_patch",
    f"""WITH r AS (SELECT project_id, max_by('T' || seq, seq) AS title, max_by(CASE WHEN seq % 2 = 0 THEN 'D' || seq END, CASE WHEN seq % 2 = 0 THEN seq END) AS description
                 FROM v_proposals WHERE project_id IS NOT NULL GROUP BY project_id)
       SELECT p.project_id, coalesce(r.title, p.title) AS title, coalesce(r.description, p.description) AS description,
              CASE WHEN r.project_id IS NOT NULL THEN {AS_OF_MS} ELSE epoch_ms(p.updated_at) END AS updated_ms FROM v_projects p LEFT JOIN r ON p.project_id = r.project_id""",
)
def p03(spark, sf):
    pr = proposals(spark, sf).filter(c("project_id").isNotNull())
    even = c("seq") % 2 == 0
    req = pr.groupBy("project_id").agg(
        F.max_by(F.concat(F.lit("T"), "seq"), "seq").alias("title"),
        F.max_by(F.when(even, F.concat(F.lit("D"), "seq")), F.when(even, c("seq"))).alias("description"),
    )
    return P.patch(projects(spark, sf), req, ORDERS_AS_OF).select("project_id", "title", "description", ms("updated_at").alias("updated_ms"))


@query("p04_proposals", "SELECT proposal_id, field FROM v_proposals WHERE session_id = 's3' AND status = 'pending'")
def p04(spark, sf):
    return P.list_proposals(proposals(spark, sf), "s3", "pending").select("proposal_id", "field")


@query(
    "p05_review",
    f"""SELECT proposal_id, CASE seq % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'edited' ELSE status END AS status,
              CASE WHEN seq % 4 = 2 AND seq % 3 <> 0 THEN '"edited"' ELSE new_value END AS new_value, CASE WHEN seq % 4 < 3 THEN {AS_OF_MS} END AS reviewed_ms FROM v_proposals""",
)
def p05(spark, sf):
    pr = proposals(spark, sf)
    k = c("seq") % 4
    actions = pr.select(
        "proposal_id", F.when(k == 0, "approve").when(k == 1, "reject").when(k == 2, "edit").alias("action"),
        F.when(c("seq") % 3 != 0, '"edited"').alias("edited_value"),
    ).filter(c("action").isNotNull())
    return P.review(pr, actions, ORDERS_AS_OF).select("proposal_id", "status", "new_value", ms("reviewed_at").alias("reviewed_ms"))


@query("p06_batch_review", "SELECT proposal_id, CASE WHEN field = 'title' THEN 'rejected' ELSE status END AS status FROM v_proposals")
def p06(spark, sf):
    pr = proposals(spark, sf)
    return P.batch_review(pr, pr.filter(c("field") == "title"), "reject", ORDERS_AS_OF).select("proposal_id", "status")


@query(
    "p07_groups",
    """SELECT session_id, coalesce(g.project_id, 'new') AS group_id, p.title AS project_title, g.project_id IS NULL AS is_new, count(*) AS n_proposals, epoch_ms(min(created_at)) AS first_ms
       FROM v_proposals g LEFT JOIN v_projects p ON g.project_id = p.project_id GROUP BY ALL""",
)
def p07(spark, sf):
    groups, _ = P.proposal_groups(proposals(spark, sf), projects(spark, sf))
    return groups.select("session_id", "group_id", "project_title", "is_new", "n_proposals", ms("first_at").alias("first_ms"))


@query(
    "p07_members",
    """SELECT session_id, coalesce(project_id, 'new') AS group_id, proposal_id, field, new_value, status FROM v_proposals""",
)
def p07_members(spark, sf):
    _, members = P.proposal_groups(proposals(spark, sf), projects(spark, sf))
    return members.drop("created_at")


def last_sql(field, key):
    return f"max_by(new_value, {key}) FILTER (field = '{field}' AND status IN ('approved', 'edited'))"


CHECK_VIEWS["c_wide"] = (
    "SELECT session_id, coalesce(project_id, 'new') AS group_id, "
    + ", ".join(f'{last_sql(f, "(created_at, seq)")} AS "{f}"' for f in P.FIELDS)
    + " FROM v_proposals GROUP BY ALL HAVING count(*) FILTER (status IN ('approved', 'edited')) > 0"
)


@query(
    "p08_apply_new",
    "SELECT 'new_' || session_id AS project_id, "
    + ", ".join(f"""coalesce("{f}", '{d}') AS "{f}" """ for f, d in P.DEFAULTS.items())
    + " FROM c_wide WHERE group_id = 'new'",
)
def p08_new(spark, sf):
    created, _ = P.apply_approved(proposals(spark, sf), pool(spark, sf), ORDERS_AS_OF)
    return created.select("project_id", *P.FIELDS)


def pool(spark, sf):
    """Projects with every field as JSON text."""
    p = projects(spark, sf)
    base = {f: F.lit(d) for f, d in P.DEFAULTS.items()}
    base["title"], base["description"] = c("title"), c("description")
    base["status"], base["myRole"] = c("status"), c("my_role")
    return p.select("project_id", *[v.alias(k) for k, v in base.items()], "updated_at")


@query(
    "p08_apply_patch",
    """WITH one AS (SELECT group_id, max_by(title, session_id) FILTER (title IS NOT NULL) AS title, max_by(status, session_id) FILTER (status IS NOT NULL) AS status,
                         max_by(tags, session_id) FILTER (tags IS NOT NULL) AS tags FROM c_wide WHERE group_id <> 'new' GROUP BY group_id)
       SELECT p.project_id, coalesce(o.title, p.title) AS title, coalesce(o.status, p.status) AS status, coalesce(o.tags, '[]') AS tags FROM v_projects p JOIN one o ON p.project_id = o.group_id""",
)
def p08_patch(spark, sf):
    _, patched = P.apply_approved(proposals(spark, sf), pool(spark, sf), ORDERS_AS_OF)
    return patched.select("project_id", "title", "status", "tags")


LONG_SQL = """SELECT project_id, 'title' AS field, title AS value FROM v_projects UNION ALL SELECT project_id, 'description', description FROM v_projects WHERE description IS NOT NULL
       UNION ALL SELECT project_id, 'status', status FROM v_projects UNION ALL SELECT project_id, 'my_role', my_role FROM v_projects"""
FIELDS = ["title", "description", "status", "my_role"]


@query("p09_to_proposals", LONG_SQL)
def p09(spark, sf):
    return P.to_proposals(projects(spark, sf), FIELDS, ["project_id"]).withColumnRenamed("new_value", "value")


@query(
    "p10_update_proposals",
    f"""SELECT r.proposal_id, r.field, l.value AS old_value, r.new_value FROM v_proposals r LEFT JOIN ({LONG_SQL}) l ON r.project_id = l.project_id AND r.field = l.field WHERE r.project_id IS NOT NULL""",
)
def p10(spark, sf):
    req = proposals(spark, sf).filter(c("project_id").isNotNull())
    return P.update_proposals(req, projects(spark, sf), FIELDS).select("proposal_id", "field", "old_value", "new_value")


@query(
    "p11_sessions",
    """SELECT session_id, count(*) AS n_proposals, CASE WHEN count(*) FILTER (status = 'pending') = 0 THEN 'completed' ELSE 'running' END AS status,
              CASE WHEN count(*) FILTER (status = 'pending') = 0 THEN epoch_ms(max(created_at)) END AS completed_ms
       FROM (SELECT * REPLACE (session_id || field AS session_id, CASE WHEN field = 'tags' AND status = 'pending' THEN 'rejected' ELSE status END AS status) FROM v_proposals) GROUP BY session_id""",
)
def p11(spark, sf):
    pr = proposals(spark, sf).withColumn("session_id", F.concat("session_id", "field")).withColumn(
        "status", F.when((c("field") == "tags") & (c("status") == "pending"), "rejected").otherwise(c("status"))
    )
    return P.sessions(pr).select("session_id", "n_proposals", "status", ms("completed_at").alias("completed_ms"))


@query(
    "p12_link_docs",
    """SELECT DISTINCT p.project_id, d.id, d.source FROM v_projects p JOIN v_docs d
       ON (p.my_role = 'active' AND d.source = 'jira' AND d.folder = 'src' || (p.custkey % 20)) OR (p.my_role = 'informed' AND d.source = 'slack' AND d.folder = 'src' || (p.custkey % 20))""",
)
def p12(spark, sf):
    links = projects(spark, sf).filter(c("my_role").isin("active", "informed")).select(
        "project_id", F.when(c("my_role") == "active", "jira_project").otherwise("slack_channel").alias("kind"),
        F.concat(F.lit("src"), (c("custkey") % 20)).alias("identifier"),
    )
    docs = standin(spark, sf, "v_docs").select("id", "source", c("folder").alias("project"), c("folder").alias("channel"))
    return P.link_docs(links, docs)


@query(
    "p13_signals",
    """SELECT folder AS identifier, count(*) FILTER (source = 'jira') AS jira, count(*) FILTER (source = 'slack') AS slack, count(*) FILTER (source = 'gmail') AS gmail,
              count(DISTINCT author) AS n_people, epoch_ms(max(coalesce(updated_at, other_at, created_at))) AS last_ms FROM v_docs GROUP BY folder""",
)
def p13(spark, sf):
    docs = standin(spark, sf, "v_docs").select(
        c("folder").alias("identifier"), c("author").alias("person"), "source", F.coalesce("updated_at", "other_at", "created_at").alias("seen_at")
    )
    return P.project_signals(docs, ["jira", "slack", "gmail"]).select("identifier", "jira", "slack", "gmail", "n_people", ms("last_seen").alias("last_ms"))


@query("p13_people", "SELECT folder AS identifier, author AS person, count(*) AS n FROM v_docs GROUP BY ALL")
def p13_people(spark, sf):
    return P.signal_people(standin(spark, sf, "v_docs").select(c("folder").alias("identifier"), c("author").alias("person")))
