"""Ordered rule chains over titles, companies and locations, as single CASE expressions.

Rule lists are configuration, so each becomes literal branches in the plan. A row first
meets one combined pattern; the ordered branches run only for rows that hit it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions.text import collapse_ws, filled, norm, quote, strip
from postmill.operators.keyed import mark_duplicates

PASSES, FILTERED, DUPLICATE, UNDECIDED = "passes_rules", "filtered_out", "duplicate", "undecided"
VERDICT = "struct<status:string,reason:string>"


@dataclass(frozen=True)
class GeoRules:
    enabled: bool = True
    unknown_policy: str = "pass"
    non_us_keywords: tuple[str, ...] = ()


@dataclass(frozen=True)
class CityRules:
    allowed_cities: tuple[str, ...] = ()
    allow_remote: bool = True


@dataclass(frozen=True)
class TitleRules:
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    override_companies: tuple[str, ...] = ()
    ambiguous_policy: str = "pending"


@dataclass(frozen=True)
class LevelRules:
    """(pattern, tier) lists per company and by default, tier ranks and the wanted band."""

    companies: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)
    default: tuple[tuple[str, str], ...] = ()
    order: dict[str, int] = field(default_factory=dict)
    min_tier: str | None = None
    max_tier: str | None = None
    unknown_policy: str = "in_band"


def first_keyword(text: Column, keywords: Sequence[str], whole_word: bool) -> Column:
    """First configured keyword found in `text`, or null; `text` is matched without case."""
    usable = [k for k in keywords if k.strip()]
    if not usable:
        return F.lit(None).cast("string")
    if whole_word:
        patterns = [r"\b" + quote(k.strip().lower()) + r"\b" for k in usable]
        reported = [k.strip().lower() for k in usable]
        hits = [text.rlike("(?iuU)" + p) for p in patterns]
        any_hit = text.rlike("(?iuU)(?:" + "|".join(patterns) + ")")
    else:
        lowered = F.lower(text)
        reported = list(usable)
        hits = [lowered.contains(k.strip().lower()) for k in usable]
        any_hit = lowered.rlike("|".join(quote(k.strip().lower()) for k in usable))
    chain = F.when(hits[0], reported[0])
    for hit, word in zip(hits[1:], reported[1:]):
        chain = chain.when(hit, word)
    return F.when(any_hit, chain)


def us_location(location: Column | str, rules: GeoRules) -> Column:
    """struct<is_us, reason>: US token, then first non-US keyword, then the policy."""
    text = strip(filled(location))
    passes = rules.unknown_policy.strip().lower() != "filter"

    def verdict(flag: bool, reason: Column | str | None) -> Column:
        value = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
        return F.struct(F.lit(flag).alias("is_us"), value.alias("reason"))

    keyword = first_keyword(text, rules.non_us_keywords, whole_word=True)
    return (
        F.when(text == "", verdict(passes, "empty" if passes else "empty (filter policy)"))
        .when(text.rlike("(?iuU)" + fixed.US_TOKEN), verdict(True, "us-mentioned"))
        .when(keyword.isNotNull(), verdict(False, keyword))
        .otherwise(verdict(passes, None if passes else "unknown (filter policy)"))
    )


def _names_city(location: Column, rules: CityRules) -> Column:
    lowered, hit = F.lower(location), F.lit(False)
    for city in rules.allowed_cities:
        hit = hit | lowered.contains(city.lower())
    return hit


def _away_words(location: Column) -> Column:
    return location.rlike(r"(?iU)\b(?:remote|hybrid)\b")


def passes_city_at_triage(location: Column | str, rules: CityRules) -> Column:
    """Blank and vague places pass; remote or hybrid as whole words pass when allowed."""
    if not rules.allowed_cities:
        return F.lit(True)
    text = strip(filled(location))
    out = (text == "") | text.rlike("(?iU)" + fixed.VAGUE_LOCATION) | _names_city(text, rules)
    return out | _away_words(text) if rules.allow_remote else out


def passes_city_at_scan(location: Column | str, rules: CityRules) -> Column:
    """As at triage, without the vague-place rule."""
    if not rules.allowed_cities:
        return F.lit(True)
    text = filled(location)
    out = (text == "") | _names_city(text, rules)
    return out | _away_words(text) if rules.allow_remote else out


def passes_city_in_rules(location: Column | str, rules: CityRules) -> Column:
    """Inside the rule chain: remote and hybrid count as substrings."""
    if not rules.allowed_cities:
        return F.lit(True)
    text = filled(location)
    out = (text == "") | _names_city(text, rules)
    lowered = F.lower(text)
    return out | lowered.contains("remote") | lowered.contains("hybrid") if rules.allow_remote else out


def _signals(
    title: Column, company: Column, location: Column, titles: TitleRules, geo: GeoRules
) -> dict[str, Column]:
    named = norm(title)
    return {
        "_place": filled(location), "_who": norm(company), "_us": us_location(location, geo),
        "_excluded": first_keyword(named, titles.exclude, whole_word=False),
        "_included": first_keyword(named, titles.include, whole_word=False),
    }


def _decide(signals: dict[str, Column], titles: TitleRules, geo: GeoRules, city: CityRules) -> Column:
    def verdict(status: str, *reason: Column | str) -> Column:
        parts = [r if isinstance(r, Column) else F.lit(r) for r in reason]
        return F.struct(F.lit(status).alias("status"), F.concat(*parts).alias("reason"))

    place, us = signals["_place"], signals["_us"]
    excluded, included = signals["_excluded"], signals["_included"]
    branches = []
    if geo.enabled:
        reason = F.coalesce(us["reason"], F.lit("None"))
        branches.append((~us["is_us"], verdict(FILTERED, "non-us location: ", reason)))
    branches.append(
        (~passes_city_in_rules(place, city), verdict(FILTERED, "onsite outside allowed cities: ", place))
    )
    for name in titles.override_companies:
        branches.append((signals["_who"] == name.strip().lower(), verdict(PASSES, f"override: {name}")))
    branches.append((excluded.isNotNull(), verdict(FILTERED, "matched exclude: ", excluded)))
    branches.append((included.isNotNull(), verdict(PASSES, "matched include: ", included)))
    chain = F.when(*branches[0])
    for condition, value in branches[1:]:
        chain = chain.when(condition, value)
    pending = titles.ambiguous_policy.lower() == "pending"
    return chain.otherwise(
        verdict(PASSES, "ambiguous; pending-policy passes through")
        if pending
        else verdict(UNDECIDED, "rules ambiguous")
    )


def classify(
    title: Column | str, company: Column | str, location: Column | str,
    titles: TitleRules, geo: GeoRules = GeoRules(), city: CityRules = CityRules(),
) -> Column:
    """struct<status, reason>: geography, city, company override, exclude, include, policy."""
    return _decide(_signals(title, company, location, titles, geo), titles, geo, city)


def classify_batch(
    jobs: DataFrame, ordinal: str, titles: TitleRules, geo: GeoRules = GeoRules(),
    city: CityRules = CityRules(), title: str = "title", company: str = "company",
    location: str = "location",
) -> DataFrame:
    """Classify a batch; later rows of one (company, title) are duplicates, blank pairs are not."""
    keys = {"company": norm(company), "title": norm(title)}
    blank = (norm(company) == "") & (norm(title) == "")
    marked = mark_duplicates(jobs, keys, ordinal, "_later", exempt=blank)
    signals = _signals(title, company, location, titles, geo)
    seen = marked.withColumns(signals)
    judged = seen.withColumn("_v", _decide({name: F.col(name) for name in signals}, titles, geo, city))
    return judged.withColumns(
        {
            "filter_status": F.when(F.col("_later"), DUPLICATE).otherwise(F.col("_v.status")),
            "filter_reason": F.when(F.col("_later"), "dedup within run").otherwise(F.col("_v.reason")),
            "ambiguous_resolved_by": F.lit(None).cast("string"),
        }
    ).drop("_v", "_later", *signals)


def classify_counts(classified: DataFrame) -> DataFrame:
    """Duplicates count as input only."""
    return classified.agg(
        F.count(F.lit(1)).alias("input_count"),
        F.count_if(F.col("filter_status") == PASSES).alias("passes_count"),
        F.count_if(F.col("filter_status") == FILTERED).alias("filtered_out_count"),
    )


def title_matches(title: Column | str, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Without an include list everything passes, excluded titles too; else exclude wins."""
    if not include:
        return F.lit(True)
    text = filled(title)

    def any_of(words: Sequence[str]) -> Column:
        if not words:
            return F.lit(False)
        return text.rlike("(?iu)" + "|".join(quote(w) for w in words))

    return ~any_of(exclude) & any_of(include)


def title_matches_by_company(
    title: Column | str, company: Column | str, include: Sequence[str], exclude: Sequence[str],
    own: dict[str, dict[str, Sequence[str]]],
) -> Column:
    """A company's own list replaces the global one, each list by itself."""
    out = title_matches(title, include, exclude)
    for name, lists in own.items():
        rule = title_matches(title, lists.get("include") or include, lists.get("exclude") or exclude)
        out = F.when(filled(company) == name, rule).otherwise(out)
    return out


def _first_tier(title: Column, rules: Sequence[tuple[str, str]]) -> Column:
    usable = [(p.lower(), t) for p, t in rules if p]
    if not usable:
        return F.lit(None).cast("string")
    chain = F.when(title.contains(usable[0][0]), usable[0][1])
    for pattern, tier in usable[1:]:
        chain = chain.when(title.contains(pattern), tier)
    return chain


def tier_of(title: Column | str, company: Column | str, rules: LevelRules) -> Column:
    """First matching pattern of the company's rules, falling through to the defaults."""
    text, who = F.lower(filled(title)), strip(filled(company))
    own = F.lit(None).cast("string")
    exact = list(rules.companies.items())
    loose: dict[str, tuple] = {}
    for name, patterns in exact:
        loose.setdefault(name.lower(), patterns)
    branches = [(who == n, p) for n, p in exact] + [(F.lower(who) == n, p) for n, p in loose.items()]
    if branches:
        own = F.when(branches[0][0], _first_tier(text, branches[0][1]))
        for condition, patterns in branches[1:]:
            own = own.when(condition, _first_tier(text, patterns))
    return F.coalesce(own, _first_tier(text, rules.default))


def _by_value(value: Column, table: dict[str, str], default: str) -> Column:
    """Literal lookup that mentions `value` once, however large the table is."""
    pairs = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return F.coalesce(F.try_element_at(pairs, value), F.lit(default))


def band_of(tier: Column, rules: LevelRules) -> Column:
    """Tier ranks and the wanted band are configuration, so each tier's verdict is known up front."""
    low, high = rules.order.get(rules.min_tier), rules.order.get(rules.max_tier)
    verdicts = {"": "in_band" if rules.unknown_policy == "in_band" else "unknown"}
    if low is not None and high is not None:
        for name, rank in rules.order.items():
            verdicts[name] = "too_low" if rank < low else "too_high" if rank > high else "in_band"
    return _by_value(F.coalesce(tier, F.lit("")), verdicts, "in_band")


def band_status(verdict: Column) -> Column:
    settled = {v: f"out_of_band_{v}" for v in ("too_high", "too_low")}
    return _by_value(verdict, settled, "unresolved")


def triage_gate(status: Column | str, description: Column | str, minimum: int = fixed.MIN_DESCRIPTION_CHARS) -> Column:
    """Null when the row may be scored, else why not."""
    state, length = strip(filled(status)), F.length(strip(filled(description)))
    return F.when(
        (state != "") & ~state.isin(*fixed.RESOLVED_STATUSES),
        F.concat(F.lit("unsupported external_jd_status: "), state),
    ).when(
        length < minimum,
        F.concat(F.lit("description too short: "), length.cast("string"), F.lit(f" < {minimum}")),
    )


def verdict_of(score: Column, strong: int = fixed.STRONG_MIN, medium: int = fixed.MEDIUM_MIN) -> Column:
    return (
        F.when(score >= strong, "strong_match").when(score >= medium, "medium_match").otherwise("weak_match")
    )


def is_table_row(line: Column, separator: str = "\t", minimum: int = 2, width: int = 80) -> Column:
    """At least `minimum` separators and only short fields."""
    fields = F.split(line, quote(separator))
    return (F.size(fields) > minimum) & F.forall(fields, lambda f: F.length(f) <= width)


def is_content_image(path: Column) -> Column:
    marked = F.lower(path).contains("course")
    for mark in fixed.CONTENT_IMAGE_MARKS:
        marked = marked | path.contains(mark)
    return marked


def select_companies(companies: DataFrame, only: str | None = None) -> DataFrame:
    """An explicit slug wins over the enabled flag."""
    return companies.filter(F.col("slug") == only) if only else companies.filter("enabled")


def resolver_for(company: Column | str, resolvers: dict[str, tuple[str, str]]) -> Column:
    """struct<type, board> of a configured company: exact name, else without case; null if none."""
    who = collapse_ws(company)

    def spec(kind: str, board: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(board).alias("board"))

    chain = F.when(who == "", F.lit(None))
    loose: dict[str, tuple[str, str]] = {}
    for name, (kind, board) in resolvers.items():
        chain = chain.when(who == name, spec(kind, board))
        loose.setdefault(name.lower(), (kind, board))
    for name, (kind, board) in loose.items():
        chain = chain.when(F.lower(who) == name, spec(kind, board))
    return chain


def company_setting(company: Column | str, configured: dict[str, str], default: Column) -> Column:
    """A configured value by company name without case, first entry winning, else a derived one."""
    table: dict[str, str] = {}
    for name, value in configured.items():
        table.setdefault(name.strip().lower(), value)
    if not table:
        return default
    pairs = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return F.coalesce(F.try_element_at(pairs, norm(company)), default)
