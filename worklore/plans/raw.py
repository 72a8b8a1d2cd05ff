"""Raw records in the landed shape, built from the stand-in views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklore.plans.standins import standin
from worklore.sources import chat, files, issues, mail, meetings, wiki

TIME = "yyyy-MM-dd HH:mm:ss"
c, lit, struct, array = F.col, F.lit, F.struct, F.array


def text(ts):
    return F.date_format(ts, TIME)


def named(value):
    return struct(value.alias("name"))


def person(value):
    return F.when(value.isNotNull(), struct(value.alias("displayName")))


def first_n(items, n):
    return F.slice(array(*items), lit(1), n)


def raw_issues(spark, sf) -> DataFrame:
    v = standin(spark, sf, "v_issues")
    key = lambda k: F.when(lit(True), struct(F.concat(lit("ORD-"), (c("n") + k)).alias("key")))
    none = F.when(lit(False), struct(lit("").alias("key")))
    link = lambda name, i, o: struct(named(lit(name)).alias("type"), i.alias("inwardIssue"), o.alias("outwardIssue"))
    comments = [
        struct(
            (c("n") * 10 + i).cast("string").alias("id"), lit(f"plain {i}").alias("body"),
            person(F.concat(lit("Clerk "), ((c("n") + i) % 9))).alias("author"),
            text(c("created")).alias("created"), text(c("updated")).alias("updated"),
        )
        for i in range(3)
    ]
    rendered = [struct(F.concat(lit("<p>Note <b>"), c("n"), lit(f"</b> &amp; {i}</p>")).alias("body")) for i in range(2)]
    return v.select(
        c("issue_key").alias("key"),
        struct(
            c("summary"), c("description"), named(lit("Task")).alias("issuetype"), named(c("status")).alias("status"),
            F.when(c("priority").isNotNull(), named(c("priority"))).alias("priority"),
            person(c("assignee")).alias("assignee"), person(c("reporter")).alias("reporter"),
            first_n([lit("red"), lit("blue")], c("n_labels")).alias("labels"),
            first_n([named(c("project"))], F.least(c("n_labels"), lit(1))).alias("components"),
            struct(c("project").alias("key")).alias("project"),
            text(c("created")).alias("created"), text(c("updated")).alias("updated"),
            first_n([named(lit(f"Sprint {i}")) for i in (1, 2, 3)], c("n_sprints")).alias("sprint"),
            first_n([link("Blocks", key(1), key(2)), link("Relates", none, none), link("Clones", none, key(3))],
                    F.when(c("n_links") > 0, c("n_links") + 1).otherwise(0)).alias("issuelinks"),
            struct(first_n(comments, c("n_comments")).alias("comments")).alias("comment"),
        ).alias("fields"),
        struct(
            F.when(c("n") % 3 == 0, F.concat(lit("<h2>Price</h2><p>"), c("n"), lit("</p>"))).alias("description"),
            struct(array(*rendered).alias("comments")).alias("comment"),
        ).alias("renderedFields"),
    )


def raw_messages(spark, sf) -> DataFrame:
    v = standin(spark, sf, "v_messages")
    r = lambda name, n: struct(lit(name).alias("name"), n.cast("int").alias("count"))
    return v.select(
        "channel_id", "ts", c("user_id").alias("user"), "subtype", "text", "thread_ts", "reply_count",
        F.when(c("n_reactions") > 0, first_n([r("up", c("conv_id") % 7), r("eyes", lit(3)), r("heart", c("turn")), r("ok", lit(2))], c("n_reactions"))).alias("reactions"),
        F.when(c("turn") % 6 == 5, array(struct(lit("f1").alias("id")))).alias("files"),
    )


def chat_users(spark, sf) -> DataFrame:
    return standin(spark, sf, "v_users")


def chat_channels(spark, sf) -> DataFrame:
    return chat.channels(standin(spark, sf, "v_channels"), chat_users(spark, sf))


def raw_mail(spark, sf) -> DataFrame:
    v = standin(spark, sf, "v_mail")
    html = F.base64(F.concat(lit("<html><p>"), c("body"), lit("</p></html>")).cast("binary"))
    plain = F.base64(c("body").cast("binary"))
    body = lambda data: struct(data.alias("data"))
    none = F.when(lit(False), lit(""))
    leaf_t = "struct<mimeType:string,filename:string,body:struct<data:string>>"
    leaf = lambda m, d: struct(lit(m).alias("mimeType"), lit("").alias("filename"), body(d).alias("body"))
    mid = lambda m, d, kids: struct(lit(m).alias("mimeType"), lit("").alias("filename"), body(d).alias("body"), kids.alias("parts"))
    no_kids = F.when(lit(False), array(leaf("", none))).cast(f"array<{leaf_t}>")
    alternative = array(mid("text/html", html, no_kids), mid("text/plain", plain, no_kids))
    no_mids = F.when(lit(False), alternative)
    nested = array(mid("multipart/alternative", none, alternative), mid("application/pdf", none, no_mids))
    html_only = array(mid("image/png", none, no_mids), mid("text/html", html, no_mids))
    pair = lambda n, x: struct(lit(n).alias("name"), x.alias("value"))
    # Forwarded and signed mail nests deeper: up to four more levels around the parts.
    levels = F.pmod(F.xxhash64("message_id"), lit(5)).cast("int")
    deeper = lambda x: F.concat(F.repeat(lit('[{"mimeType":"multipart/mixed","filename":"","body":{},"parts":'), levels), x, F.repeat(lit("}]"), levels))
    return v.select(
        c("message_id").alias("id"), c("thread_id").alias("threadId"), F.split("labels", ",").alias("labelIds"),
        struct(
            F.when(c("body_kind") == 1, "text/html").otherwise("multipart/mixed").alias("mimeType"),
            F.filter(
                array(pair("From", c("sender")), pair("TO", c("to_line")), pair("cc", c("cc_line")),
                      pair("Subject", c("subject")), pair("Date", F.date_format("sent_at", "EEE, d MMM yyyy HH:mm:ss Z"))),
                lambda h: h["value"].isNotNull(),
            ).alias("headers"),
            body(F.when(c("body_kind") == 1, html)).alias("body"),
            deeper(F.when(c("body_kind") == 0, F.to_json(nested)).when(c("body_kind") == 2, F.to_json(html_only))).alias("parts"),
        ).alias("payload"),
    )


def raw_files(spark, sf) -> DataFrame:
    v = standin(spark, sf, "v_files")
    return v.select(
        c("file_id").alias("id"), "name", c("mime_type").alias("mimeType"),
        F.when(c("parent_id").isNotNull(), array("parent_id")).alias("parents"),
        F.when(c("owner").isNotNull(), array(struct(c("owner").alias("displayName"), lit("x@corp.example").alias("emailAddress")))).alias("owners"),
        text(c("created_at")).alias("createdTime"), text(c("modified_at")).alias("modifiedTime"),
        F.concat(lit("https://files.example/"), "file_id").alias("webViewLink"), "body",
    )


def raw_wiki(spark, sf) -> DataFrame:
    v = standin(spark, sf, "v_wiki")
    note = [
        struct(
            F.concat("page_id", lit(f"_{i}")).alias("id"),
            (lit("<p> </p>") if i else F.concat(lit("<p>See <a href='x'>"), "space", lit("</a></p>"))).alias("body"),
            (F.when(c("page_id") % 2 == 0, "Reader").alias("author")),
            text(c("created_at")).alias("created"), text(c("updated_at")).alias("updated"),
        )
        for i in range(2)
    ]
    return v.select(
        c("page_id").cast("string").alias("id"), c("page_type").alias("type"), "title",
        struct(c("space").alias("key"), F.upper("space").alias("name")).alias("space"),
        struct(
            person(c("author")).alias("createdBy"), text(c("created_at")).alias("createdDate"),
            F.when(c("updated_at").isNotNull(), struct(text(c("updated_at")).alias("when"))).alias("lastUpdated"),
        ).alias("history"),
        first_n([struct(lit(f"Up {i}").alias("title")) for i in range(4)], c("n_ancestors")).alias("ancestors"),
        first_n([named(lit(x)) for x in ("how-to", "draft", "api")], c("n_labels")).alias("labels"),
        c("html").alias("body"), F.concat(lit("/p/"), "page_id").alias("webui"),
        first_n(note, c("n_comments")).alias("comments"),
    )


def raw_calendar(spark, sf) -> DataFrame:
    v = standin(spark, sf, "v_meetings")
    when = lambda t: struct(
        F.when(~c("all_day"), text(t)).alias("dateTime"), F.when(c("all_day"), F.date_format(t, "yyyy-MM-dd")).alias("date")
    )
    guests = [
        struct(F.when(lit(i != 1), F.concat(lit("user"), (c("user_id") + i), lit("@corp.example"))).alias("email")) for i in range(7)
    ]
    return v.select(
        c("meeting_id").alias("id"), "summary", "description", "location", "status",
        when(c("start_at")).alias("start"), when(c("end_at")).alias("end"),
        F.when(c("n_attendees") > 0, first_n(guests, c("n_attendees"))).alias("attendees"),
        F.when(c("organizer").isNotNull(), struct(c("organizer").alias("email"))).alias("organizer"),
        F.concat(lit("https://cal.example/"), "meeting_id").alias("htmlLink"),
        text(c("created_at")).alias("created"), text(c("updated_at")).alias("updated"),
    )


def folder_table(spark, sf) -> DataFrame:
    return standin(spark, sf, "v_folders")


def every_source(spark, sf) -> list[DataFrame]:
    """All normalisers over their stand-in raw tables."""
    issue, chats = raw_issues(spark, sf), raw_messages(spark, sf)
    users, chans = chat_users(spark, sf), chat_channels(spark, sf)
    pages = wiki.wiki_scope(raw_wiki(spark, sf))
    paths = files.folder_paths(files.folder_chains(folder_table(spark, sf)))
    return [
        issues.issues(issue), issues.issue_comments(issue),
        chat.messages(chats.filter(c("thread_ts").isNull()), users, chans), chat.thread_replies(chats, chats, users, chans),
        mail.emails(raw_mail(spark, sf)), files.files(raw_files(spark, sf), paths),
        wiki.wiki_pages(pages), wiki.wiki_comments(pages), meetings.calendar(raw_calendar(spark, sf)),
    ]
