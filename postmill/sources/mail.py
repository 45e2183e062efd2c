"""Alert mails: MIME bodies, sender routing, card and link parsing."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import fixed_values as fixed
from postmill.functions.text import (
    collapse_ws, filled, first_of_equal, html_to_lines, let, lines_of, match_percent, present, strip, strip_tags, unescape,
)
from postmill.functions.titles import classify_tags, clean_title, is_compound, split_compound
from postmill.functions.urls import (
    alert_key, is_http, is_linkedin, is_linkedin_job, jobright_id, jobright_url, linkedin_job_id, links,
)

MESSAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("sender", "subject", "date", "message_id", "html", "text")]
)


def _bodies(message) -> tuple[str, str]:
    """First HTML and first plain part, attachments left out."""
    found = {"text/html": "", "text/plain": ""}
    for part in message.walk():
        kind = part.get_content_type()
        if kind in found and not found[kind] and part.get_content_disposition() != "attachment":
            raw = part.get_payload(decode=True) or b""
            found[kind] = raw.decode(part.get_content_charset() or "utf-8", "replace")
    return found["text/html"], found["text/plain"]


@F.pandas_udf(MESSAGE)
def parse_message(content: pd.Series) -> pd.DataFrame:
    rows = []
    for raw in content:
        message = email.message_from_bytes(raw, policy=email.policy.default)
        html, text = _bodies(message)
        head = [str(message.get(h, "")) for h in ("from", "subject", "date", "message-id")]
        rows.append((*[" ".join(h.split()) for h in head], html, text))
    return pd.DataFrame(rows, columns=MESSAGE.names)


def read_mail_folder(spark: SparkSession, folder: str) -> DataFrame:
    """*.eml files as messages; `ordinal` is the file name, the order they are taken in."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("ordinal"), "content")
    )
    return files.select("ordinal", parse_message("content").alias("m")).select("ordinal", "m.*")


def mail_source(sender: Column | str) -> Column:
    text = F.lower(collapse_ws(sender))
    return F.when(text.contains("linkedin"), "linkedin").when(text.contains("jobright"), "jobright").otherwise("unknown")


def _looks_like_alert(sender: Column, subject: Column, html: Column, text: Column) -> Column:
    who, what = F.lower(collapse_ws(sender)), F.lower(collapse_ws(subject))
    corpus = F.lower(F.concat_ws("\n", filled(html), filled(text)))
    return (who.contains("linkedin") | what.contains("linkedin")) & (
        what.contains("job") | what.contains("alert") | (corpus.contains("linkedin") & corpus.contains("job"))
    )


def _field(section: Column, name: str) -> Column:
    return strip_tags(F.regexp_extract(section, '(?s)id="' + name + fixed.CARD_FIELD_TAIL, 1))


def card_jobs(messages: DataFrame) -> DataFrame:
    """Section-marked card mails: one job per card with a real link, first of equal ids per mail."""
    sections = messages.filter(filled("html").contains(fixed.CARD_SECTION)).select(
        "ordinal", "message_id", "date", "subject",
        F.posexplode(F.split("html", fixed.CARD_SECTION)).alias("at", "s"),
    ).filter("at > 0")
    s = F.col("s")
    tags = F.transform(F.regexp_extract_all(s, F.lit('(?s)id="job-tag' + fixed.CARD_FIELD_TAIL), F.lit(1)), strip_tags)
    cards = sections.select(
        "ordinal", "at", "message_id", "date", "subject", _field(s, "job-company-name").alias("company"),
        match_percent(F.regexp_extract(s, '(?s)id="job-match-percentage' + fixed.CARD_FIELD_TAIL, 1)).alias("percent"),
        strip(unescape(F.regexp_extract(s, fixed.CARD_TITLE_LINK, 1))).alias("raw_url"),
        strip_tags(F.regexp_extract(s, fixed.CARD_TITLE_LINK, 2)).alias("title"), classify_tags(tags).alias("tags"),
        strip(F.regexp_replace(_field(s, "job-time-posted"), r"[· ]+\z", "")).alias("posted"),
        _field(s, "job-company-categories").alias("categories"),
    ).filter(
        (F.col("title") != "") & (F.col("raw_url") != "") & ~F.lower("title").contains("view more")
        & ~F.col("raw_url").contains("/jobs/recommend")
    )
    from postmill.operators.keyed import top_k

    once = top_k(
        cards.withColumn("card", jobright_id("raw_url")), ["ordinal", "message_id", "card"], [F.col("at").asc()], 1
    )
    return once.select(
        "ordinal", "at", "title", "company", F.col("tags.location").alias("location"),
        F.when(F.lower("tags.location") == "remote", "remote").otherwise("").alias("modality"),
        F.lit("").alias("snippet"), F.lit("").alias("linkedin_url"), jobright_url("raw_url").alias("jobright_url"),
        F.array(jobright_url("raw_url")).alias("links"), F.array().cast("array<string>").alias("external_candidates"),
        F.col("message_id").alias("email_message_id"), F.col("date").alias("email_date"), "subject",
        F.lit("jobright_alert_email").alias("source"), F.col("tags.salary").alias("salary"),
        F.col("percent").alias("jobright_match_pct"), F.col("posted").alias("jobright_time_posted"),
        F.col("categories").alias("jobright_categories"), F.col("tags.referrals").alias("jobright_referrals"),
    )


def _pair_cards(anchors: Column, lines: Column) -> Column:
    """Walk a mail's job links in order and give each the text card that follows its title line.

    The cursor moves past every title line taken, so equal titles meet their own cards. A title
    line is the first equal line from the cursor on, else the first containing it; the card is
    the first of the next three lines with the separator.
    """
    both = F.struct(lines.alias("lines"), F.transform(lines, lambda x: F.lower(strip(x))).alias("low"))
    return let(both, lambda given: _walk(anchors, given["lines"], given["low"]))


def _walk(anchors: Column, lines: Column, low: Column) -> Column:
    result = "array<struct<title:string,company:string,location:string>>"
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(result).alias("cards"))

    def step(state: Column, anchor: Column) -> Column:
        hint = F.lower(strip(anchor["hint"]))
        # the remaining lines as a slice; array_position finds the first equal one by itself
        ahead = F.slice(low, state["cursor"] + 1, F.greatest(F.size(low), F.lit(1)))
        equal = F.nullif(F.array_position(ahead, hint), F.lit(0))
        holding = F.try_element_at(F.filter(ahead, lambda x: x.contains(hint)), F.lit(1))
        found = F.coalesce(equal, F.array_position(ahead, holding)).cast("int") + state["cursor"]
        at = F.when(anchor["open"] & (hint != ""), found)
        card = F.try_element_at(
            F.filter(F.slice(lines, F.coalesce(at, F.lit(0)) + 1, 3), lambda x: x.contains(fixed.CARD_SEPARATOR)), F.lit(1)
        )
        taken = F.struct(
            F.when(card.isNotNull(), anchor["hint"]).otherwise("").alias("title"),
            F.coalesce(strip(F.substring_index(card, fixed.CARD_SEPARATOR, 1)), F.lit("")).alias("company"),
            F.coalesce(strip(F.substr(card, F.instr(card, fixed.CARD_SEPARATOR) + len(fixed.CARD_SEPARATOR))), F.lit("")).alias("location"),
        )
        blank = F.struct(F.lit("").alias("title"), F.lit("").alias("company"), F.lit("").alias("location"))
        return F.struct(
            F.coalesce(at, state["cursor"]).alias("cursor"),
            F.concat(state["cards"], F.array(F.when(at.isNotNull(), taken).otherwise(blank))).alias("cards"),
        )

    return F.aggregate(anchors, start, step, lambda s: s["cards"])


def link_jobs(messages: DataFrame, companies: Iterable[str] | None = None) -> DataFrame:
    """Link-based alert mails: one job per distinct posting id, in document order."""
    base = messages.filter(_looks_like_alert(F.col("sender"), F.col("subject"), F.col("html"), F.col("text"))).select(
        "ordinal", "message_id", "date", "subject", links("html").alias("found"),
        F.when(F.size(html_to_lines("html")) > 0, html_to_lines("html")).otherwise(
            F.filter(lines_of(filled("text")), lambda x: strip(x) != "")
        ).alias("lines"),
    )
    jobs = F.transform(
        F.filter("found", lambda a: is_linkedin_job(a["href"]) & (linkedin_job_id(a["href"]) != "")),
        lambda a: F.struct(a["href"].alias("href"), linkedin_job_id(a["href"]).alias("id"), clean_title(a["text"]).alias("hint")),
    )
    listed = base.withColumn("jobs", jobs)
    once = listed.withColumn(
        "jobs", first_of_equal(F.col("jobs"), lambda j: j["id"])
    )
    split = once.withColumn(
        "jobs",
        F.transform(
            "jobs",
            lambda j: F.struct(
                j["href"].alias("href"), j["hint"].alias("hint"),
                F.when((j["hint"] != "") & is_compound(j["hint"]), split_compound(j["hint"], companies)).alias("parts"),
            ),
        ),
    )
    anchors = F.transform(
        "jobs",
        lambda j: F.struct(
            j["hint"].alias("hint"),
            ((filled(j["parts"]["title"]) == "") | (filled(j["parts"]["company"]) == "")).alias("open"),
        ),
    )
    paired = split.withColumn("cards", _pair_cards(anchors, F.col("lines")))
    each = paired.select(
        "ordinal", "message_id", "date", "subject", "found",
        F.posexplode(F.arrays_zip("jobs", "cards")).alias("at", "z"),
    )
    j, card = F.col("z")["jobs"], F.col("z")["cards"]
    parts = j["parts"]
    plain = F.when(parts.isNull(), j["hint"])

    def pick(*values: Column) -> Column:
        return F.coalesce(*[present(v) for v in values], F.lit(""))

    hrefs = F.transform(F.filter("found", lambda a: is_http(a["href"])), lambda a: a["href"])
    return each.select(
        "ordinal", "at", pick(parts["title"], plain, card["title"]).alias("title"),
        pick(parts["company"], card["company"]).alias("company"), pick(parts["location"], card["location"]).alias("location"),
        pick(parts["modality"]).alias("modality"), F.lit("").alias("snippet"), j["href"].alias("linkedin_url"),
        F.lit("").alias("jobright_url"), hrefs.alias("links"),
        F.filter(hrefs, lambda u: ~is_linkedin(u)).alias("external_candidates"),
        F.col("message_id").alias("email_message_id"), F.col("date").alias("email_date"), "subject",
        F.lit("linkedin_alert_email").alias("source"),
    ).filter("title != ''")


PARSERS = {"linkedin": link_jobs, "jobright": card_jobs}


def alert_jobs(messages: DataFrame) -> DataFrame:
    """Route by sender; unknown senders yield nothing."""
    routed = messages.withColumn("_route", mail_source("sender"))
    parsed = [parser(routed.filter(F.col("_route") == name).drop("_route")) for name, parser in PARSERS.items()]
    out = parsed[0]
    for other in parsed[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def finalize(jobs: DataFrame, now: Column) -> DataFrame:
    c = F.col
    key = alert_key(c("linkedin_url"), c("jobright_url"), c("title"), c("company"), c("location"), c("subject"))
    return jobs.withColumns({"job_key": key, "discovered_at": now, "needs_external_jd": F.lit(True)})


def reparse(jobs: DataFrame, companies: Iterable[str] | None = None) -> DataFrame:
    """Saved alert jobs again: drop rows without a posting id or with navigation titles, split titles."""
    kept = jobs.filter(
        (linkedin_job_id("linkedin_url") != "") & ~F.lower(strip(filled("title"))).isin(*fixed.GENERIC_LINK_TEXT)
    ).withColumn("_p", F.when(is_compound("title"), split_compound("title", companies)))
    fields = ("title", "company", "location", "modality")
    return kept.withColumns(
        {f: F.coalesce(present(F.col("_p")[f]), F.col(f)) for f in fields}
    ).drop("_p")
