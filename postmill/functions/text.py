"""Whitespace, markup, entity, slug and truncation expressions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import fixed_values as fixed

WS = r"(?U)[\s\x1c-\x1f]"
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
COMMON_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
    ("&amp;", "&"),
)
CODE_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
)
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x0c <&#;]{1,32};?)"
ENDED_ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[^\t\n\x0c <&#;]{1,32});"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once inside `body`, however often `body` mentions it.

    Inside a lambda anything that is not bound is evaluated again for every element, so
    whatever is costly must come in through here.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_of_equal(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items whose key no earlier item has; order is kept."""

    def pick(pair: Column) -> Column:
        return F.filter(
            pair["items"], lambda item, at: F.array_position(pair["keys"], key(item)) == at + 1
        )

    return let(items, lambda xs: let(F.struct(xs.alias("items"), F.transform(xs, key).alias("keys")), pick))


def last_of_equal(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items whose key no later item has; order is kept."""
    return F.reverse(first_of_equal(F.reverse(items), key))


def filled(value: Column | str) -> Column:
    """Missing and empty are one thing: null becomes ''."""
    return F.coalesce(col(value), F.lit(""))


def present(value: Column | str) -> Column:
    """Null where the text is missing or empty, so that `coalesce` can fall through."""
    return F.nullif(col(value), F.lit(""))


def first_present(*values: Column | str) -> Column:
    return F.coalesce(*[present(v) for v in values], F.lit(""))


# every character str.isspace accepts
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(value: Column | str) -> Column:
    """Trim all Unicode whitespace, not only spaces."""
    return F.trim(col(value), F.lit(WS_CHARS))


def collapse_ws(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(filled(value), rf"{WS}+", " "))


def norm(value: Column | str) -> Column:
    return F.lower(strip(filled(value)))


def contains_any(value: Column, needles: tuple[str, ...] | list[str]) -> Column:
    if not needles:
        return F.lit(False)
    hit = value.contains(needles[0])
    for needle in needles[1:]:
        hit = hit | value.contains(needle)
    return hit


def quote(literal: str) -> str:
    """A Java regex matching `literal` as it stands."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def lines_of(value: Column) -> Column:
    """Split into lines at every line boundary; '' has no lines."""
    body = F.regexp_replace(value, rf"(?:\r\n|[{BREAKS}])\z", "")
    return F.when(F.length(value) > 0, F.split(body, rf"\r\n|[{BREAKS}]")).otherwise(
        F.array().cast("array<string>")
    )


def tidy_lines(value: Column) -> Column:
    """Collapse every line, drop blank ones, join with newlines: three regex passes, no arrays."""
    broken = F.regexp_replace(value, rf"{WS}*[{BREAKS}]{WS}*", "\n")
    spaced = F.regexp_replace(broken, r"(?U)[\s\x1f&&[^\n]]+", " ")
    return F.regexp_replace(spaced, r"^[ \n]+|[ \n]+\z", "")


#: Maps that the entity names are dealt into.
ENTITY_PARTS = 256


def _codepoint(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _decode_number(digits: Column, base: int) -> Column:
    cleaned = F.regexp_replace(digits, r"^0+(?=.)", "")
    number = F.when(F.length(cleaned) > 8, F.lit(0x110000)).otherwise(
        F.conv(cleaned, base, 10).cast("bigint")
    )
    # 0x80-0x9f are read as windows-1252, as browsers do; unassigned ones stay as they are
    latin = "".join(bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(0x80, 0xA0))

    def render(n: Column) -> Column:
        invalid = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        dropped = (
            n.between(0x1, 0x8) | n.isin(0xB, 0x7F) | n.between(0xE, 0x1F)
            | n.between(0xFDD0, 0xFDEF) | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE)
        )
        return (
            F.when(invalid, F.lit("\ufffd"))
            .when(n.between(0x80, 0x9F), F.substring(F.lit(latin), n.cast("int") - 127, F.lit(1)))
            .when(n == 0xD, F.lit("\r"))
            .when(dropped, F.lit(""))
            .otherwise(_codepoint(n))
        )

    return let(number, render)


def _entity_table() -> Column:
    """All entity names as small maps, dealt by a checksum: a map is searched key by key, so one of nine keys is read, not one of all."""
    parts: list[dict[str, str]] = [{} for _ in range(ENTITY_PARTS)]
    for name, char in html5.items():
        parts[zlib.crc32(name.encode()) % ENTITY_PARTS][name] = char
    return F.from_json(F.lit(json.dumps(parts)), "array<map<string,string>>")


def _entity_named(names: Column, name: Column) -> Column:
    return F.try_element_at(F.get(names, (F.crc32(name.cast("binary")) % ENTITY_PARTS).cast("int")), name)


def _decode_entity(entity: Column, names: Column, ended: bool) -> Column:
    """One entity by the HTML5 table, longest unterminated prefix included unless only `ended` ones count."""
    bare = F.substring(entity, 2, 40)
    prefixes = [
        F.concat(_entity_named(names, F.substring(bare, 1, n)), F.substring(bare, n + 1, 40))
        for n in range(6, 1, -1)
        if not ended
    ]
    named = F.coalesce(_entity_named(names, bare), *prefixes, entity)
    hexa = F.regexp_extract(entity, r"^&#[xX]([0-9a-fA-F]+);?$", 1)
    deci = F.regexp_extract(entity, r"^&#([0-9]+);?$", 1)
    out = F.when(entity == "&copy;", "©").when(entity == "&middot;", "·")
    for text, char in COMMON_ENTITIES:
        out = out.when(entity == text, char)
    return (
        out.when(hexa != "", _decode_number(hexa, 16))
        .when(deci != "", _decode_number(deci, 10))
        .otherwise(named)
    )


def replace_entities(value: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """A short entity list by plain replacement; `&amp;` must come last in `table`."""
    for text, char in table:
        value = F.replace(value, F.lit(text), F.lit(char))
    return value


def unescape(value: Column | str, ended: bool = False) -> Column:
    """Decode all HTML entities; where only `ended` ones count, those without ';' stay as they are.

    Text without '&' is untouched, text with only the common entities takes plain
    replacements; the table lookup runs only for rows that hold something rarer.
    """
    text = col(value)
    mark = ENDED_ENTITY if ended else ENTITY
    rare = text.rlike(r"&(?!(?:amp|lt|gt|quot|nbsp|#39);)[#A-Za-z]")
    table = _entity_table()
    found = F.regexp_extract_all(text, F.lit(mark), F.lit(0))
    decoded = F.transform(found, lambda e: let(table, lambda names: _decode_entity(e, names, ended)))
    woven = F.array_join(
        F.zip_with(F.split(text, mark), decoded, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), ""
    )
    return (
        F.when(~text.contains("&"), text)
        .when(~rare, replace_entities(text, COMMON_ENTITIES))
        .otherwise(woven)
    )


def html_to_text(value: Column | str, ended: bool = False) -> Column:
    """Block tags break lines, other tags are spaces, entities (all, or `ended` ones) decode, lines are tidied."""
    blocks = F.regexp_replace(filled(value), fixed.BLOCK_TAG, "\n")
    return tidy_lines(unescape(F.regexp_replace(blocks, fixed.ANY_TAG, " "), ended))


def html_to_lines(value: Column | str, ended: bool = False) -> Column:
    text = html_to_text(value, ended)
    return F.filter(F.split(text, "\n"), lambda line: line != "")


def html_fragment_to_text(value: Column | str, ended: bool = False) -> Column:
    """For escaped markup: decode first, then read as HTML."""
    return html_to_text(unescape(filled(value), ended), ended)


def strip_tags(value: Column | str) -> Column:
    """Tags vanish without leaving a space."""
    return strip(unescape(collapse_ws(F.regexp_replace(filled(value), fixed.ANY_TAG, ""))))


def inner_markup(html: Column | str, mark: str) -> Column:
    """Markup inside the first element whose opening tag holds what the pattern `mark` matches.

    Tags of the element's own name are counted, so nested ones are kept whole; an element that is never
    closed runs to the end. Null without such an element. Tags inside comments and scripts count, too.
    """
    opening = rf"(?is)<([a-z][a-z0-9]*)\b(?=[^>]*{mark})[^>]*>"

    def cut(page: Column) -> Column:
        parts = F.regexp_extract(page["text"], opening, 1)
        pattern = F.concat(F.lit(r"(?is).*?(</?"), parts, F.lit(r"\b[^>]*>|\z)"))
        pieces = F.arrays_zip(
            F.regexp_extract_all(page["rest"], pattern, F.lit(0)).alias("whole"), F.regexp_extract_all(page["rest"], pattern, F.lit(1)).alias("tag")
        )
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("taken"))

        def step(state: Column, piece: Column) -> Column:
            closes = piece["tag"].startswith("</")
            depth = state["depth"] + F.when(closes, -1).when(piece["tag"] == "", 0).otherwise(1)
            outer = F.when(depth == 0, F.length(piece["tag"])).otherwise(0)
            inside = F.struct(depth.alias("depth"), (state["taken"] + F.length(piece["whole"]) - outer).alias("taken"))
            return F.when(state["depth"] == 0, state).otherwise(inside)

        taken = F.aggregate(pieces, start, step, lambda state: state["taken"])
        return F.substr(page["rest"], F.lit(1), taken)

    return let(filled(html), lambda text: F.when(
        text.rlike(opening), let(F.struct(text.alias("text"), F.element_at(F.split(text, opening, 2), 2).alias("rest")), cut)
    ))


def page_title(html: Column | str) -> Column:
    return collapse_ws(F.regexp_extract(filled(html), fixed.PAGE_TITLE, 1))


def fallback_lines(html: Column | str, limit: int | None = None, ended: bool = False) -> Column:
    """Page text without short and boilerplate lines, all or the first `limit` (`fixed.FALLBACK_LINE_LIMIT` is usual)."""

    def useful(line: Column) -> Column:
        return (F.length(line) >= 2) & ~contains_any(F.lower(line), fixed.BOILERPLATE_LINES)

    found = F.filter(html_to_lines(html, ended), useful)
    return found if limit is None else F.slice(found, 1, limit)


def linkedin_description(html: Column | str) -> Column:
    return html_to_text(F.regexp_extract(filled(html), fixed.PUBLIC_JOB_MARKUP, 1))


def markdown_post_text(html: Column | str) -> Column:
    """Discussion markup to text with paragraph breaks kept."""
    text = F.regexp_replace(filled(html), r"<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"</p>", "\n\n")
    text = F.regexp_replace(text, fixed.ANY_TAG, "")
    order = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
    return strip(F.regexp_replace(replace_entities(text, order), r"\n{3,}", "\n\n"))


def truncate(value: Column | str, limit: int, mark: str = "") -> Column:
    text = filled(value)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit(mark))
    )


def trimmed_body(value: Column | str, limit: int = fixed.STAGE_BODY_CHARS) -> Column:
    return truncate(collapse_ws(value), limit, fixed.TRUNCATION_MARK)


def short_alt(value: Column | str, limit: int = 60) -> Column:
    """First sentence when short enough, else a cut at a word boundary with an ellipsis."""

    def pick(alt: Column) -> Column:
        # length up to and including the first sentence mark; 0 when there is none
        mark = F.length(F.regexp_extract(alt, r"(?s)^(.*?[.!?])\s", 1))
        head = F.substring(alt, 1, limit)
        cut = F.when(head.contains(" "), F.regexp_replace(head, r"(?s) [^ ]*\z", "")).otherwise(head)
        return (
            F.when((mark >= 8) & (mark + 1 <= limit + 20), F.substring(alt, F.lit(1), mark))
            .when(F.length(alt) <= limit, alt)
            .otherwise(F.concat(cut, F.lit("…")))
        )

    return let(collapse_ws(value), pick)


def excerpt(value: Column | str, max_lines: int = 8, max_chars: int = 600) -> Column:
    """Leading non-blank lines, ended by the first that would pass either limit.

    Only the first `max_lines` lines can survive, so the running total walks that slice.
    """
    lines = F.slice(F.filter(lines_of(filled(value)), lambda x: strip(x) != ""), 1, max_lines)
    start = F.struct(
        F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept")
    )

    def step(acc: Column, line: Column) -> Column:
        fits = acc["open"] & (acc["used"] + F.length(line) <= max_chars)
        return F.struct(
            F.when(fits, acc["used"] + F.length(line)).otherwise(acc["used"]).alias("used"),
            fits.alias("open"),
            F.when(fits, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(lines, start, step, lambda acc: F.array_join(acc["kept"], "\n"))


def sanitize_filename(value: Column | str) -> Column:
    cleaned = F.regexp_replace(filled(value), r'[\\/:*?"<>|]+', "-")
    return first_present(
        F.regexp_replace(strip(cleaned), r"^\.+|\.+\z", ""), F.lit("untitled")
    )


def kebab(value: Column | str) -> Column:
    """Unicode-keeping: drop other signs, join words with '-'."""
    kept = F.regexp_replace(filled(value), r"(?U)[^\w\s-]", "")
    return F.lower(F.regexp_replace(strip(kept), rf"{WS}+", "-"))


def name_slug(value: Column | str) -> Column:
    """ASCII-only: everything else becomes a single '-'."""
    dashed = F.regexp_replace(norm(value), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+\z", "")


def slugify(value: Column | str, limit: int = 60) -> Column:
    kept = F.lower(strip(F.regexp_replace(filled(value), r"(?U)[^\w\s-]", "")))
    joined = F.substring(F.regexp_replace(kept, r"(?U)[-\s]+", "-"), 1, limit)
    return F.regexp_replace(joined, r"^-+|-+\z", "")


def question_filename(rank: Column, number: Column, title: Column) -> Column:
    stem = first_present(F.substring(kebab(title), 1, 80), F.lit("untitled"))
    return F.concat(
        F.lit("LC-"), F.lpad(rank.cast("string"), 3, "0"), F.lit("-"),
        F.coalesce(number, F.lit(0)).cast("string"), F.lit("-"), stem, F.lit(".md"),
    )


def scored_filename(score: Column | None, company: Column, title: Column) -> Column:
    """`NN - Company - Title.md`; without a score the bare name."""
    bare = sanitize_filename(
        F.concat(
            first_present(company, F.lit("Company")), F.lit(" - "),
            first_present(title, F.lit("Untitled")), F.lit(".md"),
        )
    )
    if score is None:
        return bare
    text = score.cast("string")
    return F.concat(F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text), F.lit(" - "), bare)


def note_link(filename: Column) -> Column:
    return F.concat(
        F.lit("[[Opportunities/"), F.regexp_replace(filename, r"\.md\z", ""), F.lit("]]")
    )


def truthy(value: Column | str, default: bool = False) -> Column:
    return F.coalesce(norm_or_null(value).isin("1", "true", "yes", "y", "on"), F.lit(default))


def norm_or_null(value: Column | str) -> Column:
    return F.lower(strip(col(value)))


def match_percent(value: Column | str) -> Column:
    digits = F.trim(F.replace(strip_tags(value), F.lit("%"), F.lit("")))
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def clamp_score(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value.cast("int")))


ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?(?:[+-]\d{2}:\d{2}(?::\d{2})?)?)?$"
PLAIN_MOMENT = r"^\d{4}-\d{1,2}-\d{1,2}(?:T\d{1,2}:\d{1,2}:\d{1,2}| \d{1,2}:\d{1,2})?$"


def parse_date(value: Column | str, fallback: Column) -> Column:
    """A day, a day with `T` and seconds, or a day with a blank and minutes, parts padded or not;
    else strict ISO with an optional zone; else `fallback`. Times without a zone are the session's.

    The patterns are anchored, so years, months and bare times never reach the lenient cast.
    """

    def read(text: Column) -> Column:
        parts = F.transform(
            F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda d: F.when(F.length(d) < 2, F.lpad(d, 2, "0")).otherwise(d)
        )

        def built(p: Column) -> Column:
            day = F.concat_ws("-", F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)))
            clock = F.array_join(F.slice(p, 4, 3), ":")
            return F.when(clock == "", day).otherwise(F.concat_ws(" ", day, clock)).try_cast("timestamp")

        zoned = F.regexp_replace(F.replace(text, F.lit("Z"), F.lit("+00:00")), ",", ".")
        return F.when(text.rlike(PLAIN_MOMENT), let(parts, built)).when(
            zoned.rlike(ISO_MOMENT), zoned.try_cast("timestamp")
        )

    return F.coalesce(let(col(value), read), fallback)


def is_locked(body: Column | str) -> Column:
    return filled(body).rlike("|".join(f"(?:{p})" for p in fixed.LOCK_PATTERNS))


def without_comments(value: Column | str) -> Column:
    cleaned = F.regexp_replace(filled(value), r"(?s)<!--.*?-->", "")
    return strip(F.regexp_replace(cleaned, r"\n{3,}", "\n\n"))


def after_marker(value: Column | str, marker: str) -> Column:
    """Text behind the first `marker`, comments removed; '' when it is absent."""
    text = filled(value)
    at = F.instr(text, marker)
    tail = F.substr(text, at + F.lit(len(marker)))
    return F.when(at > 0, without_comments(tail)).otherwise("")


def line_after(value: Column | str, prefix: str) -> Column:
    """What follows `prefix` on the first line that starts with it."""
    lines = F.transform(lines_of(filled(value)), strip)
    hit = F.filter(lines, lambda line: line.startswith(prefix))
    return F.coalesce(strip(F.substring(F.try_element_at(hit, F.lit(1)), len(prefix) + 1, 1 << 30)), F.lit(""))


def cut_body(text: Column | str, start_regex: str | None, end_mark: str | None) -> Column:
    """Text after the first `start_regex` and before the first `end_mark` (not at position 0)."""
    body = filled(text)
    if start_regex:
        body = F.when(body.rlike(start_regex), F.regexp_replace(body, rf"(?s)\A.*?(?:{start_regex})", "")).otherwise(body)
    if end_mark:
        source = body
        body = let(source, lambda b: F.when(F.instr(b, end_mark) > 1, F.substr(b, F.lit(1), F.instr(b, end_mark) - 1)).otherwise(b))
    return F.regexp_replace(body, r"^\n+|\n+\z", "")


def front_matter(value: Column | str) -> Column:
    """`key: value` pairs of a leading block as a map; the last of equal keys wins."""
    block = F.regexp_extract(filled(value), r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.split(block, "\n"), lambda line: line.contains(":"))
    entries = F.transform(
        pairs,
        lambda line: F.struct(
            strip(F.substring_index(line, ":", 1)).alias("key"),
            F.regexp_replace(
                strip(F.regexp_replace(line, r"(?s)\A[^:]*:", "")), "^[\"']+|[\"']+\\z", ""
            ).alias("value"),
        ),
    )
    last = last_of_equal(entries, lambda e: e["key"])
    return F.map_from_entries(last)


def body_after_front_matter(value: Column | str) -> Column:
    return F.regexp_replace(filled(value), r"(?s)\A---\n.*?\n---\n", "")


def note_front_matter(score: Column, verdict: Column, mode: Column) -> Column:
    return F.concat(
        F.lit("---\nmatch_score: "), score.cast("string"), F.lit("\nverdict: "), verdict,
        F.lit("\ntriage_mode: "), mode, F.lit("\n---\n\n"),
    )


def update_note_front_matter(note: Column, score: Column, verdict: Column, mode: Column) -> Column:
    """Rewrite the three keys in place, add the mode when absent, prepend when no block exists."""
    head = F.regexp_extract(note, r"(?s)\A(---\n.*?---\n)", 1)
    body = F.substr(note, F.length(head) + 1)
    head = F.regexp_replace(head, F.lit(r"match_score:\s*\d+"), F.concat(F.lit("match_score: "), score.cast("string")))
    head = F.regexp_replace(head, F.lit(r"verdict:\s*\w+"), F.concat(F.lit("verdict: "), verdict))
    mode_line = F.concat(F.lit("triage_mode: "), mode)
    head = F.when(
        head.rlike(r"triage_mode:\s*\S+"), F.regexp_replace(head, F.lit(r"triage_mode:\s*\S+"), mode_line)
    ).otherwise(
        F.concat(F.regexp_replace(head, r"\n*-*\n*\z", ""), F.lit("\n"), mode_line, F.lit("\n---\n"))
    )
    return F.when(note.startswith("---\n"), F.concat(head, body)).otherwise(
        F.concat(note_front_matter(score, verdict, mode), note)
    )


def add_triage_mode(note: Column, mode: str = "metadata_only") -> Column:
    """Old notes get the mode key; notes that have it, or no block, stay as they are."""
    head = F.regexp_extract(note, r"(?s)\A(---\n.*?---\n)", 1)
    body = F.substr(note, F.length(head) + 1)
    extended = F.concat(
        F.regexp_replace(head, r"\s*-*\s*\z", ""), F.lit(f"\ntriage_mode: {mode}\n---\n"), body
    )
    return F.when((head == "") | head.rlike(r"(?m)^\s*triage_mode:\s*\w+"), note).otherwise(extended)


def append_section(existing: Column, addition: Column, heading: str) -> Column:
    """A document with one more section behind a divider; a new one starts with its heading."""
    before = F.regexp_replace(filled(existing), r"\s+\z", "")
    after = F.concat(F.regexp_replace(addition, r"\s+\z", ""), F.lit("\n"))
    return F.when(before != "", F.concat(before, F.lit("\n\n---\n\n"), after)).otherwise(
        F.concat(F.lit(f"# {heading}\n\n"), after)
    )
