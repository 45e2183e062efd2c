"""Title and location tokens, match scores, compound-title splitting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions.text import (
    collapse_ws, contains_any, filled, first_of_equal, let, page_title, present, quote, strip,
)
from postmill.functions.urls import host_of, is_linkedin




def title_norm(value: Column | str) -> Column:
    """Lower-case alphanumeric tokens joined by single spaces, abbreviations spelled out."""
    text = F.replace(F.lower(filled(value)), F.lit("&"), F.lit(" and "))
    text = F.replace(text, F.lit("fullstack"), F.lit("full stack"))
    text = F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))
    text = F.regexp_replace(text, r"\bswe\b", "software engineer")
    return F.regexp_replace(text, r"\bsde\b", "software development engineer")


def tokens_of(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def title_tokens(value: Column | str) -> Column:
    return tokens_of(title_norm(value))


def location_norm(value: Column | str) -> Column:
    """The location's token set (three characters or numeric) as one sorted string."""
    kept = F.filter(title_tokens(value), lambda t: (F.length(t) >= 3) | t.rlike("^[0-9]+$"))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def generic_tokens() -> Column:
    return F.array(*[F.lit(t) for t in fixed.GENERIC_ROLE_TOKENS])


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def title_score(target_norm: Column, candidate_norm: Column) -> Column:
    """Integer match score of two normalised titles."""

    def score(sets: Column) -> Column:
        target, candidate = sets["target"], sets["candidate"]

        def total(shared: Column) -> Column:
            meaningful = F.size(F.array_except(shared, generic_tokens()))
            generic = F.size(shared) - meaningful

            def has(token: str) -> Column:
                return F.array_contains(shared, token)

            def differs(token: str) -> Column:
                return F.array_contains(target, token) != F.array_contains(candidate, token)

            both = (target_norm != "") & (candidate_norm != "")
            whole = F.when((target_norm != "") & (target_norm == candidate_norm), 20).when(
                both & (candidate_norm.contains(target_norm) | target_norm.contains(candidate_norm)), 10
            ).otherwise(0)
            return (
                whole + meaningful * 4 + generic
                + _points((meaningful > 0) & (F.size(shared) >= 3), 4)
                + _points(has("software") & has("engineer"), 3)
                + _points(has("full") & has("stack"), 2)
                + _points(has("ml"), 2)
                - _points(differs("manager"), 3)
                - _points(differs("engineer"), 2)
            )

        return let(F.array_intersect(target, candidate), total)

    sets = F.struct(
        tokens_of(target_norm).alias("target"), tokens_of(candidate_norm).alias("candidate")
    )
    return let(sets, score)


def location_score(target_norm: Column, candidate_norm: Column) -> Column:
    """4 when one sorted token string contains the other, 2 when tokens are shared, else 0."""
    shared = F.arrays_overlap(F.split(target_norm, " "), F.split(candidate_norm, " "))
    nested = candidate_norm.contains(target_norm) | target_norm.contains(candidate_norm)
    return (
        F.when((target_norm == "") | (candidate_norm == ""), 0)
        .when(~shared, 0)
        .when(nested, 4)
        .otherwise(2)
    )


def location_compatible(job_location: Column, candidate_location: Column) -> Column:
    here, there = collapse_ws(job_location), collapse_ws(candidate_location)
    return (
        (here == "")
        | (location_score(location_norm(here), location_norm(there)) > 0)
        | F.lower(there).contains("remote")
    )


def long_words(value: Column | str, minimum: int) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(filled(value)), r"[^a-z0-9]+", " "))
    return F.filter(F.split(spaced, " "), lambda t: F.length(t) >= minimum)


def company_aliases(company: Column | str) -> Column:
    """Up to four spellings of a company, first spelling of equal ones kept."""

    def build(raw: Column) -> Column:
        suffixless = collapse_ws(F.regexp_replace(raw, "(?i)" + fixed.COMPANY_SUFFIX, " "))
        words = F.split(raw, " ")
        first = F.element_at(words, 1)
        many = F.size(words) >= 2
        parts = F.transform(F.split(raw, r"[/|,()-]+"), collapse_ws)
        spellings = F.concat(
            F.array(
                raw,
                collapse_ws(F.regexp_replace(raw, r"(?<=[a-z])(?=[A-Z])", " ")),
                F.when(F.lower(suffixless) != F.lower(raw), suffixless).otherwise(""),
            ),
            parts,
            F.array(
                F.when(many, F.regexp_replace(raw, r" [^ ]*\z", "")).otherwise(""),
                F.when(
                    many & ~F.lower(first).isin("the", "a", "an") & (F.length(first) >= 3), first
                ).otherwise(""),
            ),
        )
        named = F.filter(spellings, lambda s: s != "")
        distinct = first_of_equal(named, F.lower)
        return F.slice(distinct, 1, fixed.MAX_COMPANY_ALIASES)

    return let(collapse_ws(company), build)


def company_terms(company: Column | str) -> Column:
    joined = F.array_join(company_aliases(company), " ")
    return F.array_distinct(long_words(joined, 3))


def title_terms(title: Column | str) -> Column:
    return long_words(title, 4)


def search_queries(title: Column | str, company: Column | str, domains: Iterable[str]) -> Column:
    """Up to ten distinct search phrases; none without both title and company."""
    domains = tuple(domains)
    quoted = F.concat(F.lit('"'), collapse_ws(title), F.lit('"'))

    def build(aliases: Column) -> Column:
        def phrase(alias: Column, tail: str) -> Column:
            return F.concat(quoted, F.lit(' "'), alias, F.lit(f'" {tail}'))

        one, two = F.try_element_at(aliases, F.lit(1)), F.try_element_at(aliases, F.lit(2))
        phrases = [phrase(one, "careers"), phrase(one, "jobs"), phrase(two, "careers")]
        for domain in domains:
            phrases += [phrase(one, f"site:{domain}"), phrase(two, f"site:{domain}")]
        built = F.transform(F.array_compact(F.array(*phrases)), collapse_ws)
        return F.slice(F.array_distinct(built), 1, fixed.MAX_SEARCH_QUERIES)

    both = (collapse_ws(title) != "") & (collapse_ws(company) != "")
    return F.when(both, let(company_aliases(company), build)).otherwise(F.array().cast("array<string>"))


def count_contained(terms: Column, haystack: Column) -> Column:
    return F.size(F.filter(terms, lambda t: haystack.contains(t)))


def candidate_score(
    title: Column, company: Column, url: Column, page: Column, description: Column,
    allowed: Iterable[str] = fixed.DEFAULT_SEARCH_DOMAINS,
) -> Column:
    """Score one search hit for one job; -100 for hosts that never carry postings."""
    allowed = tuple(allowed)

    def score(given: Column) -> Column:
        host, text = given["host"], given["text"]
        where = F.concat(host, F.lit(" "), F.lower(filled(url)))
        blocked = (host == "") | host.isin(*fixed.BAD_RESULT_HOSTS) | is_linkedin(url)
        for suffix in fixed.SEARCH_ENGINE_HOSTS:
            blocked = blocked | host.endswith(suffix)
        trusted = F.lit(False)
        for domain in allowed:
            trusted = trusted | host.endswith(domain)
        named = F.exists(given["names"], lambda t: text.contains(t) | where.contains(t))
        full = collapse_ws(F.lower(filled(title)))
        role_points = let(
            count_contained(title_terms(title), text), lambda n: F.when(n >= 2, 4).when(n == 1, 2).otherwise(0)
        )
        return F.when(blocked, -100).otherwise(
            _points(trusted, 6)
            + _points(contains_any(where, fixed.JOB_HOST_HINTS), 4)
            + _points(named, 4)
            + role_points
            + _points((full != "") & text.contains(full), 6)
            + _points(contains_any(text, ("job", "career", "opening")), 1)
        )

    text = F.concat_ws(" ", F.lower(collapse_ws(page)), F.lower(collapse_ws(description)))
    return let(
        F.struct(host_of(url).alias("host"), text.alias("text"), company_terms(company).alias("names")), score
    )


def looks_like_job_page(
    title: Column, company: Column, url: Column, html: Column, body: Column, heading: Column,
    parser: Column, allowed: Iterable[str] = fixed.DEFAULT_SEARCH_DOMAINS,
) -> Column:
    """Structured postings always pass; others need three of four signals and 500 characters."""
    allowed = tuple(allowed)
    shown = F.lower(collapse_ws(F.coalesce(present(heading), page_title(html))))

    def judge(given: Column) -> Column:
        page, text, where = given["page"], given["text"], given["url"]
        bad = contains_any(where, fixed.BAD_PAGE_HINTS) | contains_any(page, fixed.BAD_TITLE_HINTS)
        host = host_of(where)
        trusted = contains_any(where, fixed.JOB_HOST_HINTS)
        for domain in allowed:
            trusted = trusted | host.endswith(domain)
        opening = F.concat_ws(" ", page, F.substring(text, 1, 3000))

        def signals(parts: Column) -> Column:
            roles = parts["roles"]
            needed = F.greatest(F.lit(1), F.least(F.lit(2), F.size(roles)))
            named = F.exists(parts["names"], lambda t: parts["opening"].contains(t) | where.contains(t))
            hints = sum((parts["head"].contains(h).cast("int") for h in fixed.JOB_TEXT_HINTS), F.lit(0))
            met = (trusted, named, count_contained(roles, parts["opening"]) >= needed, hints >= 2)
            return sum((m.cast("int") for m in met), F.lit(0))

        parts = F.struct(
            opening.alias("opening"), F.substring(text, 1, 6000).alias("head"),
            title_terms(title).alias("roles"), company_terms(company).alias("names"),
        )
        return ~bad & (F.length(text) >= 500) & (let(parts, signals) >= 3)

    given = F.struct(
        shown.alias("page"), F.lower(collapse_ws(body)).alias("text"),
        F.lower(filled(url)).alias("url"),
    )
    return (filled(parser) == "jsonld_jobposting") | let(given, judge)


def feed_title(raw: Column | str) -> Column:
    """`Title at Company` (first ' at '), else `Company: Title`, else the text alone."""
    at, colon = r"(?i)^(.+?)\s+at\s+(.+)$", r"^([^:]+):\s+(.+)$"

    def split(s: Column) -> Column:
        def pair(company: Column, title: Column) -> Column:
            return F.struct(collapse_ws(company).alias("company"), collapse_ws(title).alias("title"))

        return (
            F.when(s.rlike(at), pair(F.regexp_extract(s, at, 2), F.regexp_extract(s, at, 1)))
            .when(s.rlike(colon), pair(F.regexp_extract(s, colon, 1), F.regexp_extract(s, colon, 2)))
            .otherwise(pair(F.lit(""), s))
        )

    return let(collapse_ws(raw), split)


def clean_title(raw: Column | str) -> Column:
    """Empty for navigation texts and anything over 160 characters."""
    return let(
        collapse_ws(raw),
        lambda t: F.when(F.lower(t).isin(*fixed.GENERIC_LINK_TEXT) | (F.length(t) > 160), "").otherwise(t),
    )


def is_compound(text: Column | str) -> Column:
    return filled(text).contains(fixed.CARD_SEPARATOR)


def known_companies(extra: Iterable[str] = ()) -> tuple[str, ...]:
    return tuple(sorted({*fixed.KNOWN_COMPANIES, *extra}, key=lambda name: (-len(name), name)))


def split_compound(raw: Column | str, companies: Iterable[str] | None = None) -> Column:
    """Split `Title Company · Location (Modality) button salary` into its four fields.

    The right edge of the left half is matched against known companies first; otherwise
    the last role word ends the title, carried on over connectors and brackets.
    """
    names = known_companies() if companies is None else tuple(companies)
    edge = r"(?iu)(?:^|\s)(" + "|".join(quote(n) for n in names) + r")\s*$"
    tail = r"[,\-–— ]+\z"

    def fields(title: Column, company: Column, location: Column, modality: Column) -> Column:
        return F.struct(
            title.alias("title"), company.alias("company"), location.alias("location"),
            modality.alias("modality"),
        )

    def by_role(words: Column, location: Column, modality: Column, left: Column) -> Column:
        count = F.size(words)
        last = F.array_max(
            F.filter(
                F.sequence(F.lit(1), count),
                lambda i: F.lower(F.regexp_replace(F.element_at(words, i), r"(?U)[^\w]+", "")).isin(
                    *fixed.ROLE_TOKENS
                ),
            )
        )

        def walk(state: Column, i: Column) -> Column:
            # `at` is the last word taken; positions behind it are judged one by one
            word, following = F.element_at(words, state["at"]), F.try_element_at(words, state["at"] + 1)
            closing = F.array_min(
                F.filter(
                    F.sequence(F.lit(1), count),
                    lambda k: (k > state["at"]) & F.element_at(words, k).endswith(")"),
                )
            )
            opens = following.startswith("(")
            carries = F.right(word, F.lit(1)).isin(*fixed.CONTINUATION_END_CHARS) | F.lower(following).isin(
                *fixed.CONTINUATION_WORDS
            )
            nxt = F.when(opens, closing).when(carries, state["at"] + 1)
            go = state["open"] & (state["at"] < count) & nxt.isNotNull()
            return F.struct(F.when(go, nxt).otherwise(state["at"]).alias("at"), go.alias("open"))

        def finish(end: Column) -> Column:
            rest = F.slice(words, end + 1, F.greatest(count, F.lit(1)))
            short = F.when(F.size(rest) > 5, F.slice(rest, -4, 4)).otherwise(rest)
            title = F.regexp_replace(F.array_join(F.slice(words, F.lit(1), end), " "), tail, "")
            return fields(title, F.array_join(short, " "), location, modality)

        ended = F.aggregate(
            F.sequence(F.lit(1), count),
            F.struct(last.alias("at"), F.lit(True).alias("open")),
            walk,
            lambda s: s["at"],
        )
        return F.when(last.isNull(), fields(left, F.lit(""), location, modality)).otherwise(let(ended, finish))

    def split(s: Column) -> Column:
        modality = F.replace(
            F.lower(F.regexp_extract(s, fixed.MODALITY, 1)), F.lit(" "), F.lit("-")
        )
        plain = strip(F.regexp_replace(s, fixed.MODALITY[:4] + r"\A(.*?)" + fixed.MODALITY[4:], "$1"))
        plain = collapse_ws(F.regexp_replace(plain, fixed.SALARY_TAIL, ""))

        def halves(p: Column) -> Column:
            left = F.trim(F.substring_index(p, fixed.CARD_SEPARATOR, 1))
            after = F.substr(p, F.instr(p, fixed.CARD_SEPARATOR) + len(fixed.CARD_SEPARATOR))
            location = F.regexp_replace(strip(after), r"\.+\z", "")
            company = F.regexp_extract(left, edge, 1)
            title = F.regexp_replace(F.trim(F.regexp_replace(left, edge, "")), tail, "")
            found = (company != "") & (title != "")
            return (
                F.when(~p.contains(fixed.CARD_SEPARATOR), fields(p, F.lit(""), F.lit(""), modality))
                .when(left == "", fields(F.lit(""), F.lit(""), location, modality))
                .when(found, fields(title, company, location, modality))
                .otherwise(let(F.split(left, " "), lambda words: by_role(words, location, modality, left)))
            )

        return let(plain, halves)

    peeled = strip(F.regexp_replace(collapse_ws(raw), fixed.BUTTON_SUFFIX, ""))
    return let(strip(F.regexp_replace(peeled, fixed.SALARY_SUFFIX, "")), split)


def classify_tags(tags: Column) -> Column:
    """Salary, referrals and location out of card tags; of equals the last one wins."""

    def is_pay(tag: Column) -> Column:
        return tag.contains("$") & tag.contains("/yr")

    def sort(named: Column) -> Column:
        def last(wanted) -> Column:
            return F.coalesce(F.try_element_at(F.filter(named, wanted), F.lit(-1)), F.lit(""))

        return F.struct(
            last(is_pay).alias("salary"),
            last(lambda t: ~is_pay(t) & ~t.rlike(fixed.CARD_REFERRALS)).alias("location"),
            last(lambda t: ~is_pay(t) & t.rlike(fixed.CARD_REFERRALS)).alias("referrals"),
        )

    return let(F.filter(F.transform(tags, strip), lambda t: t != ""), sort)
