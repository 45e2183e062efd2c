"""URL tests, unwrapping and the hash keys built on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions.text import col, collapse_ws, filled, html_to_text, let, present, strip, unescape


def host_of(url: Column | str) -> Column:
    """Lower-case host without user or port; '' for anything that is not a URL."""
    return F.lower(
        F.regexp_extract(
            filled(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1
        )
    )


def is_http(url: Column | str) -> Column:
    return filled(url).rlike("^https?://")


def is_linkedin(url: Column | str) -> Column:
    host = host_of(url)
    return (host == "linkedin.com") | host.endswith(".linkedin.com") | (host == "lnkd.in")


def is_linkedin_job(url: Column | str) -> Column:
    bare = F.regexp_replace(filled(url), "#.*", "")
    path = F.lower(F.regexp_replace(bare, r"\?.*", ""))
    query = F.lower(F.regexp_extract(bare, r"\?(.*)", 1))
    return is_linkedin(url) & (
        path.contains("/jobs/") | query.contains("currentjobid=") | path.contains("/job/")
    )


def linkedin_job_id(url: Column | str) -> Column:
    return F.regexp_extract(filled(url), r"/jobs/view/(\d+)", 1)


def _decoded(value: Column, plus_is_space: bool) -> Column:
    source = value if plus_is_space else F.replace(value, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(source), value)


def _peel(url: Column) -> Column:
    """One redirect layer: the first key, in fixed order, whose first value is another URL."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pair = F.lit(rf"(?:^|&)({'|'.join(fixed.REDIRECT_KEYS)})=([^&]+)")
    found = F.struct(
        F.regexp_extract_all(query, pair, F.lit(1)).alias("keys"),
        F.regexp_extract_all(query, pair, F.lit(2)).alias("values"),
    )
    order = F.array(*[F.lit(key) for key in fixed.REDIRECT_KEYS])

    def pick(f: Column) -> Column:
        targets = F.transform(
            f["keys"],
            lambda key, at: F.struct(
                F.array_position(order, key).alias("rank"), at.alias("at"),
                (F.array_position(f["keys"], key) == at + 1).alias("first"),
                _decoded(_decoded(F.get(f["values"], at), True), False).alias("url"),
            ),
        )
        usable = F.filter(targets, lambda t: t["first"] & (t["url"] != "") & (t["url"] != url))
        return F.coalesce(F.array_min(usable)["url"], url)

    return let(found, pick)


def unwrap(url: Column | str) -> Column:
    """Complete the scheme, drop dead links, peel up to three redirect layers."""
    start = strip(unescape(filled(url)))

    def clean(u: Column) -> Column:
        full = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
        dead = u.startswith(fixed.DEAD_SCHEMES[0])
        for scheme in fixed.DEAD_SCHEMES[1:]:
            dead = dead | u.startswith(scheme)
        peeled = let(full, lambda a: let(_peel(a), lambda b: let(_peel(b), _peel)))
        return F.when(dead, F.lit("")).when(~u.contains("?"), full).otherwise(peeled)

    return let(start, clean)


def links(html: Column | str) -> Column:
    """Distinct (href, text) pairs in document order."""
    text = filled(html)
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(fixed.ANCHOR), F.lit(1)).alias("href"),
        F.regexp_extract_all(text, F.lit(fixed.ANCHOR), F.lit(2)).alias("text"),
    )
    cleaned = F.transform(
        pairs,
        lambda p: F.struct(
            unwrap(p["href"]).alias("href"), collapse_ws(html_to_text(p["text"])).alias("text")
        ),
    )
    return F.array_distinct(F.filter(cleaned, lambda p: p["href"] != ""))


def short_sha1(seed: Column) -> Column:
    return F.substring(F.sha1(seed), 1, 16)


def scan_key(url: Column | str, company: Column, title: Column, ats_id: Column) -> Column:
    return short_sha1(
        F.coalesce(present(url), F.concat_ws("|", filled(company), filled(title), filled(ats_id)))
    )


def alert_key(
    linkedin_url: Column, jobright_url: Column, title: Column, company: Column, location: Column, subject: Column
) -> Column:
    fallback = F.concat_ws("|", filled(title), filled(company), filled(location), filled(subject))
    return short_sha1(F.coalesce(present(linkedin_url), present(jobright_url), fallback))


def file_post_id(url: Column | str) -> Column:
    return F.substring(F.sha2(col(url), 256), 1, 16)


def post_key(source: Column, source_id: Column) -> Column:
    return F.concat_ws(":", source, source_id)


def jobright_id(url: Column | str) -> Column:
    return F.coalesce(present(F.regexp_extract(filled(url), fixed.CARD_CANONICAL, 1)), filled(url))


def jobright_url(url: Column | str) -> Column:
    key = F.regexp_extract(filled(url), fixed.CARD_CANONICAL, 1)
    return F.when(key != "", F.concat(F.lit("https://jobright.ai/jobs/info/"), key)).otherwise(filled(url))


def resource_filename(url: Column | str, content_type: Column | str) -> Column:
    """Last path segment, with an extension from the content type when it has none."""
    path = F.regexp_replace(filled(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*|[?#].*$", "")
    name = F.coalesce(present(F.regexp_extract(path, r"([^/]+)/*$", 1)), F.lit("resource"))
    kind = F.lower(F.trim(F.substring_index(filled(content_type), ";", 1)))
    extension = F.lit("")
    for mime, ext in fixed.EXTENSION_BY_CONTENT_TYPE.items():
        extension = F.when(kind == mime, ext).otherwise(extension)
    return F.when(name.contains("."), name).otherwise(F.concat(name, extension))


def workday_api_url(url: Column | str) -> Column:
    """Public posting URL to its data endpoint; null when the form is another."""
    return present(
        F.when(
            filled(url).rlike(r"^https://[^.]+\.wd\d+\.myworkdayjobs\.com/[^/]+/job/.+$"),
            F.regexp_replace(
                filled(url),
                r"^https://([^.]+)\.(wd\d+)\.myworkdayjobs\.com/([^/]+)(/job/.+)$",
                r"https://$1.$2.myworkdayjobs.com/wday/cxs/$1/$3$4",
            ),
        )
    )


def phenom_api_url(url: Column | str) -> Column:
    form = r"^https://([^/]+)/careers/job/(\d+).*$"
    return F.when(
        filled(url).rlike(form),
        F.regexp_replace(filled(url), form, r"https://$1/api/apply/v2/jobs/$2?domain="),
    )
