"""Sixteen job boards: page payloads in, canonical job rows out.

Every adapter takes a DataFrame with `payload` (one page as text) and `page` (its number),
the company and the board's own settings, and reads the payload with a fixed schema. With a
`board` column and the company given as a column, one call reads all boards of a kind.
Fetching is separate (see `datasource`), so parsing is testable on recorded pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions.text import (
    col, collapse_ws, filled, first_present, html_to_text, norm, present, strip, unescape,
)
from postmill.functions.titles import feed_title
from postmill.functions.urls import scan_key
from postmill.operators.keyed import top_k

# --- fixed values: page sizes, page limits and hosts ----------------------
PAGING = {
    "pcsx": (20, 100), "apple_jobs": (None, 50), "amazon_jobs": (100, 50), "google_careers": (None, 30),
    "workday": (20, 50), "tiktok_careers": (50, 50), "tiktok_usds": (50, None), "phenom": (10, 200),
}
GOOGLE_LINK = (
    r"""(?i)href=["']((?:/about/careers/applications/)?jobs/results/(\d+)-[^"'?]*)[^"']*["']"""
    r"""[^>]*?aria-label="Learn more about ([^"]+)\""""
)
GOOGLE_BASE = "https://www.google.com/about/careers/applications/"
APPLE_STATE = r'(?s)window\.__staticRouterHydrationData\s*=\s*JSON\.parse\("(.*?)"\)\s*;?\s*</script>'
CURSOR_LINK = r"""(?is)<a[^>]*\s+href=["'](/careers/[^"']+)["'][^>]*>(.*?)</a>"""
CURSOR_TITLE = r"(?is)<p[^>]*>\s*([^<]+?)\s*</p>"
CURSOR_SPAN = r"(?is)<span[^>]*>\s*([^<]+?)\s*</span>"
CURSOR_CHROME = ("·", "Apply →", "Apply")

PAGES = ("payload", "page")


def build_job(
    title: Column, company: Column, location: Column, url: Column, jd_text: Column, ats: str,
    ats_id: Column, now: Column,
) -> list[Column]:
    """The canonical job row as a projection."""
    link = F.when(filled(url) != "", F.array(url)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    values = {
        "job_key": scan_key(url, company, title, ats_id), "title": title, "company": company,
        "location": location, "linkedin_url": F.lit(""), "links": link, "external_candidates": link,
        "snippet": F.lit(""), "source": F.lit("target_scan"), "ats": F.lit(ats),
        "ats_job_id": filled(ats_id), "discovered_at": now, "jd_text": jd_text,
        "jd_text_preview": F.substring(jd_text, 1, fixed.PREVIEW_CHARS), "jd_title": title,
        "jd_company": company, "jd_location": location, "external_jd_status": F.lit("ats_api"),
        "external_jd_url": filled(url), "external_jd_source": F.lit(ats),
        "jd_parser": F.lit(f"{ats}_api"), "search_queries": none,
    }
    return [value.alias(name) for name, value in values.items()]


def _items(pages: DataFrame, rows: Column) -> DataFrame:
    """One row per item with `page`, `at` (its place on the page) and `board` where given."""
    kept = [c for c in pages.columns if c in ("page", "board")]
    return pages.select(*kept, F.posexplode(rows).alias("at", "j"))


def _owner(company: str | Column) -> Column:
    return F.lit(company) if isinstance(company, str) else company


def _finish(
    items: DataFrame, ats: str, now: Column, *, title: Column, company: Column, location: Column,
    url: Column, ats_id: Column, jd_text: Column | None = None,
) -> DataFrame:
    """Name the fields first, so that the job row refers to plain columns."""
    place = [c for c in ("board", "page", "at") if c in items.columns]
    named = items.select(
        *place, title.alias("_t"), company.alias("_c"), location.alias("_l"), filled(url).alias("_u"),
        (F.lit("") if jd_text is None else jd_text).alias("_d"), ats_id.cast("string").alias("_i"),
    )
    c = F.col
    return named.select(*place, *build_job(c("_t"), c("_c"), c("_l"), c("_u"), c("_d"), ats, c("_i"), now))


def _once(jobs: DataFrame, key: str = "ats_job_id") -> DataFrame:
    keys = [key, "board"] if "board" in jobs.columns else [key]
    return top_k(jobs, keys, [F.col("page"), F.col("at")], 1)


def _name_of(value: Column, *fields: str) -> Column:
    """Text of an entry that is either plain text or an object with one of `fields`."""
    named = F.coalesce(*[present(F.get_json_object(value, f"$.{f}")) for f in fields])
    return F.when(value.startswith("{"), named).otherwise(present(value))


def _joined(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), " | ")


def greenhouse(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    schema = "jobs array<struct<id:string,title:string,absolute_url:string,location:struct<name:string>,content:string>>"
    j = F.col("j")
    return _finish(
        _items(pages, F.from_json("payload", schema)["jobs"]), "greenhouse", now,
        title=collapse_ws(j["title"]), company=_owner(company), location=collapse_ws(j["location"]["name"]),
        url=j["absolute_url"], jd_text=html_to_text(j["content"]), ats_id=j["id"],
    )


def lever(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    schema = "array<struct<id:string,text:string,hostedUrl:string,categories:struct<location:string>,description:string,descriptionPlain:string>>"
    j = F.col("j")
    return _finish(
        _items(pages, F.from_json("payload", schema)), "lever", now,
        title=collapse_ws(j["text"]), company=_owner(company), location=collapse_ws(j["categories"]["location"]),
        url=j["hostedUrl"], jd_text=html_to_text(first_present(j["description"], j["descriptionPlain"])), ats_id=j["id"],
    )


def pcsx(pages: DataFrame, company: str | Column, now: Column, team_filter: str = "") -> DataFrame:
    schema = """data struct<positions:array<struct<jobId:string,id:string,title:string,name:string,positionUrl:string,
      standardizedLocations:array<string>,locations:array<string>,businessGroup:string,orgFunction:string,discipline:string>>>"""
    j = F.col("j")
    title = collapse_ws(first_present(j["title"], j["name"]))
    items = _items(pages, F.from_json("payload", schema)["data"]["positions"])
    if team_filter.strip():
        fields = [F.lower(filled(f)) for f in (title, j["businessGroup"], j["orgFunction"], j["discipline"])]
        items = items.filter(F.concat_ws(" ", *fields).contains(team_filter.strip().lower()))
    known = F.when(F.size(j["standardizedLocations"]) > 0, j["standardizedLocations"]).otherwise(j["locations"])
    path = strip(filled(j["positionUrl"]))
    return _finish(
        items, "pcsx", now, title=title, company=_owner(company), location=F.coalesce(F.array_join(known, " | "), F.lit("")),
        url=F.when(path != "", F.concat(F.lit("https://apply.careers.microsoft.com"), path)),
        ats_id=first_present(j["jobId"], j["id"]),
    )


def apple_jobs(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    """State embedded in the page as a JSON text inside a script string."""
    inner = F.from_json(F.concat(F.lit('{"v":"'), F.regexp_extract("payload", APPLE_STATE, 1), F.lit('"}')), "v string")["v"]
    schema = """loaderData struct<search:struct<searchResults:array<struct<positionId:string,id:string,postingTitle:string,
      title:string,transformedPostingTitle:string,locations:array<string>>>,totalRecords:bigint>>"""
    j = F.col("j")
    ident = first_present(j["positionId"], j["id"])
    path = F.concat(F.lit("https://jobs.apple.com/en-us/details/"), ident, F.lit("/"), filled(j["transformedPostingTitle"]))
    jobs = _finish(
        _items(pages, F.from_json(inner, schema)["loaderData"]["search"]["searchResults"]), "apple_jobs", now,
        title=collapse_ws(first_present(j["postingTitle"], j["title"])), company=_owner(company),
        location=F.coalesce(_joined(F.transform(j["locations"], lambda v: _name_of(v, "name", "city"))), F.lit("")),
        url=F.when(ident != "", F.regexp_replace(path, r"/+\z", "")), ats_id=ident,
    )
    return _once(jobs)


def amazon_jobs(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    schema = "jobs array<struct<id:string,title:string,location:string,normalized_location:string,job_path:string,description:string,description_short:string>>"
    j = F.col("j")
    return _finish(
        _items(pages, F.from_json("payload", schema)["jobs"]), "amazon_jobs", now,
        title=collapse_ws(j["title"]), company=_owner(company),
        location=collapse_ws(first_present(j["normalized_location"], j["location"])),
        url=F.when(filled(j["job_path"]) != "", F.concat(F.lit("https://www.amazon.jobs"), j["job_path"])),
        jd_text=first_present(html_to_text(j["description"]), html_to_text(j["description_short"])), ats_id=j["id"],
    )


def google_careers(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    groups = [F.regexp_extract_all(filled("payload"), F.lit(GOOGLE_LINK), F.lit(g)).alias(n) for g, n in ((1, "href"), (2, "id"), (3, "title"))]
    j = F.col("j")
    jobs = _finish(
        _items(pages, F.arrays_zip(*groups)), "google_careers", now,
        title=collapse_ws(unescape(j["title"])), company=_owner(company), location=F.lit(""),
        url=F.when(j["href"].startswith("/"), F.concat(F.lit("https://www.google.com"), j["href"])).otherwise(
            F.concat(F.lit(GOOGLE_BASE), j["href"])
        ),
        ats_id=j["id"],
    )
    return _once(jobs)


def meta_careers(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    """Rendered on the client only; the listing is always empty."""
    return greenhouse(pages.filter(F.lit(False)), company, now)


def remoteok(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    schema = "array<struct<id:string,slug:string,company:string,position:string,location:string,description:string,apply_url:string,url:string>>"
    j = F.col("j")
    items = _items(pages, F.from_json("payload", schema)).filter((filled(j["id"]) != "") & (filled(j["company"]) != ""))
    return _finish(
        items, "remoteok", now, title=collapse_ws(j["position"]), company=collapse_ws(j["company"]),
        location=collapse_ws(first_present(j["location"], F.lit("Remote"))),
        url=first_present(strip(filled(j["apply_url"])), strip(filled(j["url"]))),
        jd_text=html_to_text(j["description"]), ats_id=first_present(j["id"], j["slug"]),
    )


def weworkremotely(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    """RSS feeds, one per page row; a broken feed yields nothing, links count once over all feeds."""
    schema = "channel struct<item:array<struct<title:string,link:string,description:string>>>"
    items = _items(pages, F.from_xml(F.col("payload"), schema)["channel"]["item"])
    items = items.withColumn("link", strip(filled(F.col("j")["link"]))).filter("link != ''")
    items = items.withColumn("named", feed_title(F.col("j")["title"]))
    jobs = _finish(
        items, "weworkremotely", now, title=F.col("named")["title"], company=F.col("named")["company"],
        location=F.lit("Remote"), url=F.col("link"), jd_text=html_to_text(F.col("j")["description"]),
        ats_id=F.regexp_extract("link", r"([^/]*)/*$", 1),
    )
    return _once(jobs, "external_jd_url")


def shopify_careers(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    schema = "job array<struct<partnerJobId:string,title:string,location:string,applyUrl:string,description:string>>"
    j = F.col("j")
    items = _items(pages, F.from_xml(F.col("payload"), schema)["job"]).filter(strip(filled(j["title"])) != "")
    return _finish(
        items, "shopify_careers", now, title=strip(j["title"]), company=_owner(company), location=strip(filled(j["location"])),
        url=strip(filled(j["applyUrl"])), jd_text=html_to_text(j["description"]), ats_id=strip(filled(j["partnerJobId"])),
    )


def ashby(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    schema = "jobs array<struct<id:string,title:string,location:string,locationName:string,descriptionHtml:string,jobUrl:string,applyUrl:string,secondaryLocations:array<string>>>"
    j = F.col("j")
    main = collapse_ws(_name_of(first_present(j["location"], j["locationName"]), "city", "country"))
    more = F.transform(j["secondaryLocations"], lambda v: _name_of(v, "locationName", "city"))
    place = F.when(F.size(j["secondaryLocations"]) > 0, F.regexp_replace(F.concat(main, F.lit(" | "), _joined(more)), r"^[ |]+|[ |]+\z", "")).otherwise(main)
    return _finish(
        _items(pages, F.from_json("payload", schema)["jobs"]), "ashby", now, title=collapse_ws(j["title"]),
        company=_owner(company), location=place, url=strip(first_present(j["jobUrl"], j["applyUrl"])),
        jd_text=html_to_text(j["descriptionHtml"]), ats_id=j["id"],
    )


def cursor_careers(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    found = F.arrays_zip(
        F.regexp_extract_all(filled("payload"), F.lit(CURSOR_LINK), F.lit(1)).alias("href"),
        F.regexp_extract_all(filled("payload"), F.lit(CURSOR_LINK), F.lit(2)).alias("body"),
    )
    j = F.col("j")
    spans = F.filter(
        F.transform(F.regexp_extract_all(j["body"], F.lit(CURSOR_SPAN), F.lit(1)), lambda s: collapse_ws(unescape(s))),
        lambda s: (s != "") & ~s.isin(*CURSOR_CHROME),
    )
    jobs = _finish(
        _items(pages, found), "cursor_careers", now,
        title=collapse_ws(unescape(F.regexp_extract(j["body"], CURSOR_TITLE, 1))), company=_owner(company),
        location=F.replace(F.coalesce(F.try_element_at(spans, F.lit(-1)), F.lit("")), F.lit(";"), F.lit(" | ")),
        url=F.concat(F.lit("https://cursor.com"), collapse_ws(j["href"])),
        ats_id=F.regexp_extract(collapse_ws(j["href"]), r"([^/]*)/*$", 1),
    )
    return _once(jobs, "external_jd_url").filter("title != ''")


def workday(pages: DataFrame, company: str | Column, now: Column, tenant: str = "", pod: str = "", site: str = "") -> DataFrame:
    schema = "jobPostings array<struct<title:string,locationsText:string,externalPath:string,bulletFields:array<string>,jobReqId:string>>, total bigint"
    j = F.col("j")
    usable = pages if tenant.strip() and pod.strip() and site.strip() else pages.filter(F.lit(False))
    return _finish(
        _items(usable, F.from_json("payload", schema)["jobPostings"]), "workday", now, title=collapse_ws(j["title"]),
        company=_owner(company), location=collapse_ws(j["locationsText"]),
        url=F.concat(F.lit(f"https://{tenant}.{pod}.myworkdayjobs.com/{site}"), strip(filled(j["externalPath"]))),
        ats_id=first_present(F.try_element_at(j["bulletFields"], F.lit(1)), j["jobReqId"]),
    )


def _tiktok(pages: DataFrame, company: str | Column, now: Column, ats: str, url: Callable[[Column], Column]) -> DataFrame:
    schema = """data struct<count:bigint,job_post_list:array<struct<id:string,title:string,description:string,requirement:string,
      city_info:struct<en_name:string,i18n_name:string,name:string,parent:struct<en_name:string>>,
      city_list:array<string>,locations:array<string>,location_list:array<string>,location:string>>>"""
    j = F.col("j")
    city = first_present(j["city_info"]["en_name"], j["city_info"]["i18n_name"], j["city_info"]["name"])
    place = F.concat_ws(", ", present(city), present(filled(j["city_info"]["parent"]["en_name"])))

    def listed(name: str) -> Column:
        return F.when(F.size(j[name]) > 0, j[name])

    legacy = F.coalesce(listed("city_list"), listed("locations"), listed("location_list"))
    names = F.transform(legacy, lambda v: _name_of(v, "name", "en_name", "location_name", "city_name"))
    older = F.coalesce(present(_joined(names)), collapse_ws(j["location"]))
    parts = [present(html_to_text(j[f])) for f in ("description", "requirement")]
    return _finish(
        _items(pages, F.from_json("payload", schema)["data"]["job_post_list"]), ats, now, title=collapse_ws(j["title"]),
        company=_owner(company), location=F.when(j["city_info"].isNotNull(), place).otherwise(older),
        url=F.when(filled(j["id"]) != "", url(j["id"])), jd_text=F.concat_ws("\n\n", *parts), ats_id=j["id"],
    )


def tiktok_careers(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    return _tiktok(pages, company, now, "tiktok_careers", lambda i: F.concat(F.lit("https://lifeattiktok.com/search/"), i))


def tiktok_usds(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    return _tiktok(
        pages, company, now, "tiktok_usds",
        lambda i: F.concat(F.lit("https://careers.tiktokusds.com/usds/position/"), i, F.lit("/detail")),
    )


def phenom(pages: DataFrame, company: str | Column, now: Column) -> DataFrame:
    schema = "positions array<struct<id:string,ats_job_id:string,name:string,posting_name:string,location:string,locations:array<string>,canonicalPositionUrl:string>>"
    j = F.col("j")
    places = F.when(F.size(j["locations"]) > 0, j["locations"]).otherwise(F.array(j["location"]))
    return _finish(
        _items(pages, F.from_json("payload", schema)["positions"]), "phenom", now,
        title=collapse_ws(first_present(j["name"], j["posting_name"])), company=_owner(company),
        location=_joined(F.transform(places, lambda p: collapse_ws(p))),
        url=F.substring_index(strip(filled(j["canonicalPositionUrl"])), "?", 1), ats_id=first_present(j["id"], j["ats_job_id"]),
    )


def detail_text(pages: DataFrame, ats: str) -> DataFrame:
    """Detail payloads (`url`, `payload`) to posting text, per board."""
    field = {"workday": "$.jobPostingInfo.jobDescription", "phenom": "$.job_description"}.get(ats)
    text = html_to_text("payload")
    if field:
        text = F.when(F.try_parse_json("payload").isNotNull(), html_to_text(F.get_json_object("payload", field))).otherwise(text)
    return pages.select("url", F.when(filled("url") == "", "").otherwise(text).alias("jd_text"))


# name -> (listing parser, whether details are fetched per posting)
ADAPTERS: dict[str, tuple[Callable[..., DataFrame], bool]] = {
    "greenhouse": (greenhouse, False), "lever": (lever, False), "ashby": (ashby, False),
    "shopify_careers": (shopify_careers, False), "cursor_careers": (cursor_careers, True),
    "pcsx": (pcsx, True), "apple_jobs": (apple_jobs, True), "amazon_jobs": (amazon_jobs, True),
    "google_careers": (google_careers, True), "meta_careers": (meta_careers, True),
    "workday": (workday, True), "phenom": (phenom, True), "tiktok_careers": (tiktok_careers, True),
    "tiktok_usds": (tiktok_usds, True), "remoteok": (remoteok, False), "weworkremotely": (weworkremotely, False),
}


# --- lookup side: openings of one board for scored matching ---------------


def _unquoted(value: Column) -> Column:
    return F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), value, F.lit('"}')), "v string")["v"], value)


def ashby_openings(pages: DataFrame, board: str) -> DataFrame:
    """Openings embedded in a board page; all places joined by ' | '."""
    groups = [F.regexp_extract_all(filled("payload"), F.lit(fixed.ASHBY_OPENING), F.lit(g)).alias(n) for g, n in enumerate(("id", "title", "place", "more"), 1)]
    j = F.col("j")
    more = F.regexp_extract_all(j["more"], F.lit(r'"locationName":"((?:\\.|[^"])*)"'), F.lit(1))
    places = F.transform(F.concat(F.array(j["place"]), more), lambda p: collapse_ws(_unquoted(p)))
    return _items(pages, F.arrays_zip(*groups)).select(
        F.lit(board).alias("board"), "page", "at", _unquoted(j["id"]).alias("id"), _unquoted(j["title"]).alias("title"),
        _joined(places).alias("location"), F.concat(F.lit(f"https://jobs.ashbyhq.com/{board}/"), j["id"]).alias("url"),
    )


def smartrecruiters_openings(pages: DataFrame, board: str, max_pages: int | None = None) -> DataFrame:
    """All openings, or those of the first `max_pages` pages (the original reads three)."""
    schema = "content array<struct<id:string,name:string,location:struct<fullLocation:string>>>"
    j = F.col("j")
    read = pages if max_pages is None else pages.filter(F.col("page") < max_pages)
    return _items(read, F.from_json("payload", schema)["content"]).select(
        F.lit(board).alias("board"), "page", "at", j["id"].alias("id"), j["name"].alias("title"),
        filled(j["location"]["fullLocation"]).alias("location"),
        F.concat(F.lit(f"https://jobs.smartrecruiters.com/{board}/"), j["id"]).alias("url"),
    )


SMARTRECRUITERS_DETAIL = """
name string, applyUrl string, postingUrl string, company struct<name:string>, location struct<fullLocation:string>,
jobAd struct<sections:struct<companyDescription:struct<title:string,text:string>,jobDescription:struct<title:string,text:string>,
qualifications:struct<title:string,text:string>,additionalInformation:struct<title:string,text:string>>>
"""


def search_results(pages: DataFrame) -> DataFrame:
    """Search feed items: url, title, description; items without a link are left out."""
    schema = "channel struct<item:array<struct<title:string,link:string,description:string>>>"
    j = F.col("j")
    found = _items(pages, F.from_xml(F.col("payload"), schema)["channel"]["item"])
    return found.select(
        "page", "at", collapse_ws(j["link"]).alias("url"), collapse_ws(j["title"]).alias("title"),
        collapse_ws(j["description"]).alias("description"),
    ).filter("url != ''")
