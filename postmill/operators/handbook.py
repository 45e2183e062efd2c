"""Extracted questions to canonical questions: flatten, bucket, cluster, count, rank, link.

Thread lists stay in long form (one row per question and thread), whole and shuffled like
any table; only the first eight per question become a line of text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions.text import collapse_ws, present
from postmill.functions.titles import title_norm
from postmill.operators.keyed import number_rows, top_k, unseen
from postmill.session import stage


def flatten_questions(extracted: DataFrame) -> DataFrame:
    """thread_id, questions: array<struct<name, type, ...>> to one row per question."""
    return extracted.select("thread_id", F.posexplode("questions").alias("at", "q")).select(
        "thread_id", "at", "q.*"
    )


def bucket_of(kind: Column | str) -> Column:
    return F.coalesce(present(kind), F.lit("other"))


def type_buckets(questions: DataFrame, ordinal: str) -> DataFrame:
    """Question count per type, biggest first, equal sizes in order of appearance."""
    sized = questions.groupBy(bucket_of("type").alias("type")).agg(
        F.count(F.lit(1)).alias("questions"), F.min(ordinal).alias("first_at")
    )
    return sized.orderBy(F.desc("questions"), "first_at")


def pending_threads(posts: DataFrame, cache: DataFrame, retry_failed: bool = True) -> DataFrame:
    """Posts not yet extracted; failed ones come back unless `retry_failed` is off."""
    done = cache.filter(F.col("error").isNull()) if retry_failed and "error" in cache.columns else cache
    return unseen(posts, done, ["thread_id"])


def canonical_questions(
    questions: DataFrame,
    ordinal: str,
    cluster_key: Callable[[Column], Column] = lambda name: F.coalesce(
        present(title_norm(name)), collapse_ws(name)
    ),
) -> DataFrame:
    """One row per (type, cluster): first spelling, number of threads, number of spellings.

    Frequency is the count of distinct threads, taken in two combining steps.
    """
    keyed = questions.select(
        bucket_of("type").alias("type"), cluster_key(F.col("name")).alias("cluster"), "thread_id",
        "name", F.col(ordinal).alias("_o"),
    )
    per_thread = keyed.groupBy("type", "cluster", "thread_id").agg(
        F.min(F.struct("_o", "name")).alias("_first")
    )
    return (
        per_thread.groupBy("type", "cluster")
        .agg(F.count(F.lit(1)).alias("frequency"), F.min("_first").alias("_first"))
        .select("type", "cluster", F.col("_first.name").alias("name"), "frequency", F.col("_first._o").alias("first_at"))
    )


def _named(name: Column) -> Column:
    return F.coalesce(present(title_norm(name)), collapse_ws(name))


def question_facts(questions: DataFrame, ordinal: str, cluster_key: Callable[[Column], Column] = _named) -> DataFrame:
    """What the threads say of each cluster, in long form: (cluster, kind, value, threads, first_at), written once.

    `questions`: thread_id, name, type, round, examination_points, optionally difficulty, and `ordinal`,
    a unique number. Kinds are name, type, round, difficulty, point and thread, whose one value is empty
    and whose count is the cluster's frequency. `threads` counts distinct threads, in two combining steps
    over one reading of the questions. Rounds and difficulties that are not stated, blank points and
    questions without a name are left out.
    """

    def stated(name: str) -> Column:
        known = F.col(name) if name in questions.columns else F.lit(None).cast("string")
        return F.when(F.trim(known) != fixed.ROUND_UNSTATED, present(F.trim(known)))

    def fact(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    single = F.array(
        fact("thread", F.lit("")), fact("name", F.col("name")), fact("type", bucket_of("type")),
        fact("round", stated("round")), fact("difficulty", stated("difficulty")),
    )
    points = F.transform(
        F.filter(F.coalesce("examination_points", F.array().cast("array<string>")), lambda x: F.trim(x) != ""),
        lambda x: fact("point", x),
    )
    said = questions.filter(F.col("name").isNotNull()).select(
        cluster_key(F.col("name")).alias("cluster"), "thread_id", F.col(ordinal).alias("_o"),
        F.explode(F.concat(F.filter(single, lambda x: x["value"].isNotNull()), points)).alias("x"),
    )
    votes = said.groupBy("cluster", "x.kind", "x.value", "thread_id").agg(F.min("_o").alias("_o"))
    return stage(votes.groupBy("cluster", "kind", "value").agg(F.count(F.lit(1)).alias("threads"), F.min("_o").alias("first_at")))


#: Text columns of questions and what they become in a canonical row.
QUESTION_TEXTS = {"what": "description", "solution_hint": "common_solutions", "pitfalls": "common_pitfalls", "follow_ups": "follow_ups"}


def question_texts(questions: DataFrame, ordinal: str, cluster_key: Callable[[Column], Column] = _named) -> DataFrame:
    """One row per cluster: description, common_solutions, common_pitfalls, follow_ups, source_quality.

    Each text is the first that a question of the cluster states, whole; nothing is made up. The quality
    is high with a task and a solution or follow-up, medium with a task alone, and low without a task,
    whose description then says so. Text columns that `questions` lacks count as not stated.
    """
    known = {source: name for source, name in QUESTION_TEXTS.items() if source in questions.columns}
    told = F.array(*[F.struct(F.lit(name).alias("kind"), present(F.trim(source)).alias("text")) for source, name in known.items()])
    empty = F.array().cast("array<struct<kind:string,text:string>>")
    said = questions.filter(F.col("name").isNotNull()).select(
        cluster_key(F.col("name")).alias("cluster"), F.col(ordinal).alias("_o"),
        F.explode_outer(F.filter(told if known else empty, lambda x: x["text"].isNotNull())).alias("x"),
    )
    first = top_k(said.select("cluster", "_o", "x.*"), ["cluster", "kind"], [F.col("_o").asc()], 1)
    rows = first.groupBy("cluster").agg(
        *[F.max(F.when(F.col("kind") == name, F.col("text"))).alias(name) for name in QUESTION_TEXTS.values()]
    )
    task, answer = F.col("description").isNotNull(), F.coalesce("common_solutions", "follow_ups").isNotNull()
    return rows.withColumn(
        "source_quality", F.when(task & answer, "high").when(task, "medium").otherwise("low")
    ).withColumn("description", F.coalesce("description", F.lit(fixed.QUESTION_UNTOLD)))


def canonical_rows(facts: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per cluster over all types, with what its threads agree on.

    `facts`: rows of `question_facts`. The type, round and difficulty are those of most threads, the
    first seen among equals; the name is the first seen. Aliases and points are counted here and listed,
    a row each, by `canonical_values`, so that no row grows with the corpus. `texts`: rows of
    `question_texts`, without which the text columns are null.
    """

    def of(kind: str, value: Column | str) -> Column:
        return F.when(F.col("kind") == kind, value if isinstance(value, Column) else F.col(value))

    def most(kind: str) -> Column:
        return F.max_by("value", of(kind, F.struct("threads", -F.col("first_at"))))

    rows = facts.groupBy("cluster").agg(
        F.min_by("value", of("name", "first_at")).alias("name"), most("type").alias("type"), F.max(of("thread", "threads")).alias("frequency"),
        (F.count_if(F.col("kind") == "name") - 1).alias("aliases"), F.count_if(F.col("kind") == "point").alias("points"),
        F.coalesce(most("round"), F.lit(fixed.ROUND_UNSTATED)).alias("round"),
        F.coalesce(most("difficulty"), F.lit(fixed.ROUND_UNSTATED)).alias("difficulty"), F.min("first_at").alias("first_at"),
    )
    if texts is None:
        return rows.withColumns({c: F.lit(None).cast("string") for c in (*QUESTION_TEXTS.values(), "source_quality")})
    return rows.join(texts, "cluster", "left")


def canonical_values(facts: DataFrame) -> DataFrame:
    """Aliases and points of all clusters in long form: (cluster, kind alias or point, value, threads, first_at).

    An alias is every spelling but the first seen. That one is known by its ordinal, which is unique, so
    the anti join spreads evenly however many spellings one cluster has.
    """
    firsts = facts.filter("kind = 'thread'").select("cluster", "first_at")
    aliases = facts.filter("kind = 'name'").join(firsts, ["cluster", "first_at"], "left_anti").withColumn("kind", F.lit("alias"))
    return aliases.unionByName(facts.filter("kind = 'point'")).select("cluster", "kind", "value", "threads", "first_at")


def with_ids(canonical: DataFrame, buckets: DataFrame) -> DataFrame:
    """`q001`, `q002`, ... over buckets by size, then frequency, then name."""
    ordered = canonical.join(
        buckets.select("type", F.col("questions").alias("_size"), F.col("first_at").alias("_seen")), "type"
    )
    numbered = number_rows(
        ordered, [F.desc("_size"), F.asc("_seen"), F.desc("frequency"), F.asc("name"), F.asc("cluster")], "_n"
    )
    text = F.col("_n").cast("string")
    return numbered.withColumn(
        "id", F.concat(F.lit("q"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))
    ).drop("_n", "_size", "_seen")


def type_label(kind: Column | str) -> Column:
    source = F.col(kind) if isinstance(kind, str) else kind
    label = source
    for name, text in fixed.QUESTION_TYPE_LABELS.items():
        label = F.when(source == name, text).otherwise(label)
    return label


def section_ordinal(kind: Column | str) -> Column:
    """Fixed place of a type in the handbook body; null for types it leaves out."""
    source = F.col(kind) if isinstance(kind, str) else kind
    place = F.lit(None).cast("int")
    for at, name in enumerate(fixed.QUESTION_SECTION_ORDER, 1):
        place = F.when(source == name, at).otherwise(place)
    return place


def leaderboard(
    canonical: DataFrame, minimum: int = fixed.LEADERBOARD_MIN_FREQUENCY, size: int = fixed.LEADERBOARD_SIZE
) -> DataFrame:
    return (
        canonical.filter(F.col("frequency") >= minimum)
        .orderBy(F.desc("frequency"), "name", "type", "cluster")
        .limit(size)
    )


def thread_url(thread_id: Column) -> Column:
    return F.concat(
        F.lit("https://www.1point3acres.com/bbs/thread-"), thread_id.cast("string"), F.lit("-1-1.html")
    )


def source_links(members: DataFrame, listings: DataFrame, keys: list[str]) -> DataFrame:
    """First eight thread links per question as one line, with the number of further threads.

    `members`: keys + thread_id. `listings`: thread_id, href. Threads without a listing take
    the standard address.
    """
    distinct = members.select(*keys, "thread_id").distinct()
    counts = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("threads"))
    shown = top_k(distinct, keys, [F.col("thread_id").asc()], fixed.LINKS_SHOWN, rank="at")
    linked = shown.join(listings.select("thread_id", "href"), "thread_id", "left").withColumn(
        "link",
        F.concat(
            F.lit("[#"), F.col("thread_id").cast("string"), F.lit("]("),
            F.coalesce(F.col("href"), thread_url(F.col("thread_id"))), F.lit(")"),
        ),
    )
    lines = linked.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "link"))), lambda s: s["link"]), " · "
        ).alias("links")
    )
    more = F.col("threads") - fixed.LINKS_SHOWN
    return lines.join(counts, keys).withColumn(
        "links",
        F.when(more > 0, F.concat("links", F.lit(" + "), more.cast("string"), F.lit(" 帖"))).otherwise(F.col("links")),
    )


def handbook_counts(extracted: DataFrame, canonical: DataFrame) -> DataFrame:
    """Posts, raw questions, failed posts and distinct questions, one row."""
    raw = extracted.agg(
        F.count(F.lit(1)).alias("posts"),
        F.coalesce(F.sum(F.size(F.coalesce("questions", F.array().cast(extracted.schema["questions"].dataType)))), F.lit(0)).alias("raw_questions"),
        F.count_if(F.col("error").isNotNull()).alias("failed_posts"),
    )
    parts = raw.unionByName(canonical.agg(F.count(F.lit(1)).alias("questions")), allowMissingColumns=True)
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])


def handbook_lines(canonical: DataFrame, minimum: int = fixed.LEADERBOARD_MIN_FREQUENCY) -> DataFrame:
    """Handbook as ordered rows: leaderboard, questions in fixed section order, rare appendix.

    Types outside the fixed order stay in the leaderboard and leave the body. Rare questions are
    listed again at the end when the leaderboard leaves them out.
    """
    frequency = F.col("frequency").cast("string")
    columns = ("part", "section", "rank", "name", "line")

    def rows(part: int, source: DataFrame, section: Column, line: Column) -> DataFrame:
        return source.select(
            F.lit(part).alias("part"), section.alias("section"), (-F.col("frequency")).alias("rank"), "name", line.alias("line")
        ).select(*columns)

    board = leaderboard(canonical, minimum)
    body = canonical.withColumn("_section", section_ordinal("type")).filter("_section IS NOT NULL")
    out = rows(
        1, board, F.lit(0), F.concat(F.lit("| **"), "name", F.lit("** | "), type_label("type"), F.lit(" | "), frequency, F.lit(" |"))
    ).unionByName(
        rows(2, body, F.col("_section"), F.concat(F.lit("## "), "name", F.lit(" _(频次 "), frequency, F.lit(" · "), type_label("type"), F.lit(")_")))
    )
    if minimum > 1:
        rare = canonical.filter("frequency = 1")
        out = out.unionByName(rows(3, rare, F.lit(0), F.concat(F.lit("- **"), "name", F.lit("** _"), type_label("type"), F.lit("_"))))
    return out


def handbook_document(
    canonical: DataFrame,
    values: DataFrame,
    links: DataFrame,
    counts: DataFrame,
    company: str,
    day: str,
    minimum: int = fixed.LEADERBOARD_MIN_FREQUENCY,
    script: str | None = None,
    model: str | None = None,
) -> DataFrame:
    """The whole handbook as rows; order by (part, section, rank, name, cluster, at, item) to write it.

    `canonical`, `values`: rows of `canonical_rows` and `canonical_values`. `links`: cluster and its line
    of `source_links`. `counts`: the row of `handbook_counts`. `script` and `model` get a line each where
    given. The document stays rows, one for each alias and point, too (`item` orders them; aliases are
    lines of one paragraph). Only the leaderboard, which is bounded, is numbered as a whole.
    """
    alias, point = F.col("kind") == "alias", F.col("kind") == "point"
    spans = values.groupBy("cluster").agg(
        F.min(F.when(alias, F.col("value"))).alias("_first"), F.max(F.when(alias, F.col("value"))).alias("_last"), F.count_if(point).alias("_points")
    )
    held = stage(canonical.join(links.select("cluster", "links"), "cluster", "left").join(spans, "cluster", "left").withColumns({
        "label": type_label("type"), "count": F.col("frequency").cast("string"), "section": section_ordinal("type"), "rank": -F.col("frequency"),
    }))
    round_part = F.when(F.col("round") != fixed.ROUND_UNSTATED, F.concat(F.lit(" · "), "round")).otherwise("")
    heading = F.concat(F.lit("## "), "name", F.lit(" _(频次 "), "count", F.lit(" · "), "label", round_part, F.lit(")_"))
    badge = F.lit("")
    for quality, shown in fixed.HANDBOOK_BADGES.items():
        badge = F.when(F.col("source_quality") == quality, shown).otherwise(badge)

    def told(before: Column | str, name: str) -> list[Column]:
        line = F.concat(F.lit(before) if isinstance(before, str) else before, present(name))
        return [line, F.when(line.isNotNull(), "")]

    # Places in a question's block; lines that are null are left out. The aliases are at 2, the points at 5.
    block = [
        (0, heading), (1, F.lit("")), (3, F.when(F.col("_first").isNotNull(), "")),
        (4, F.when(F.col("_points") > 0, fixed.HANDBOOK_POINTS)), (6, F.when(F.col("_points") > 0, "")),
        *enumerate((
            *told(F.concat(F.lit(fixed.HANDBOOK_TASK[0]), badge, F.lit(fixed.HANDBOOK_TASK[1])), "description"),
            *told(fixed.HANDBOOK_SOLUTIONS, "common_solutions"), *told(fixed.HANDBOOK_PITFALLS, "common_pitfalls"),
            *told(fixed.HANDBOOK_FOLLOW_UPS, "follow_ups"), *told(fixed.HANDBOOK_SOURCES, "links"), F.lit("---"), F.lit(""),
        ), 7),
    ]
    first = F.regexp_extract(F.coalesce("links", F.lit("")), r"\]\(([^)]*)\)", 1)
    task = F.trim(F.coalesce("description", F.lit("")))
    short = F.when(F.length(task) > 120, F.concat(F.substring(task, 1, 120), F.lit("…"))).otherwise(task)
    once = F.concat(F.lit("- **["), "name", F.lit("]("), first, F.lit(")** _"), "label", F.lit("_ — "), short)
    rare = F.lit(minimum > 1) & (F.col("frequency") == 1)

    def placed(part: int, section: Column, at: Column, line: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), section.alias("section"), at.alias("at"), line.alias("line"))

    def lines(part: int, section: int, texts: Column) -> Column:
        return F.transform(texts, lambda line, at: placed(part, F.lit(section), at, line))

    own = F.array(
        *[placed(2, F.col("section"), F.lit(at), F.when(F.col("section").isNotNull(), line)) for at, line in block],
        placed(3, F.lit(1), F.lit(0), F.when(rare, once)),
    )
    key = ("rank", "name", "cluster")
    questions = held.select(*key, F.lit("").alias("item"), F.explode(F.filter(own, lambda x: x["line"].isNotNull())).alias("x"))
    listed_values = values.join(held.filter("section IS NOT NULL").select(*key, "section", "_first", "_last"), "cluster")
    lead = F.when(F.col("value") == F.col("_first"), fixed.HANDBOOK_ALIASES).otherwise("")
    trail = F.when(F.col("value") == F.col("_last"), "").otherwise(",")
    entries = listed_values.select(
        *key, F.col("value").alias("item"),
        placed(2, F.col("section"), F.when(alias, 2).otherwise(5), F.when(alias, F.concat(lead, "value", trail)).otherwise(F.concat(F.lit("- "), "value"))).alias("x"),
    )
    board = leaderboard(held, minimum)
    entry = F.struct("rank", "name", "type", "cluster", F.concat(
        F.lit(" | **"), "name", F.lit("** | "), "label", F.lit(" | "), "count", F.lit(" | "), "difficulty", F.lit(" | "), "round", F.lit(" |")
    ).alias("line"))
    no_key = (F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("name"), F.lit("").alias("cluster"), F.lit("").alias("item"))
    listed = board.agg(F.array_sort(F.collect_list(entry)).alias("e")).select(F.posexplode("e").alias("n", "e"))
    ranked = listed.select(
        *no_key, placed(1, F.lit(1), F.col("n"), F.concat(F.lit("| "), (F.col("n") + 1).cast("string"), "e.line")).alias("x")
    )
    sizes = counts.select("posts", "raw_questions", "failed_posts", "questions")
    for name, part in (("top", board), ("rare", held.filter(rare))):
        sizes = sizes.unionByName(part.agg(F.count(F.lit(1)).alias(name)), allowMissingColumns=True)
    totals = sizes.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("string").alias(c) for c in sizes.columns])

    def text(value: str) -> Column:
        return F.lit(value.format(company=company, slug=company.lower(), minimum=minimum))

    def number(before: str, name: str, after: str = "") -> Column:
        return F.concat(F.lit(before), F.col(name), F.lit(after))

    def given(around: tuple[str, str], value: str | None) -> Column:
        return F.lit(None if value is None else around[0] + value + around[1]).cast("string")

    title = text(fixed.HANDBOOK_BOARD) if minimum > 1 else number(fixed.HANDBOOK_BOARD_ALL[0], "top", fixed.HANDBOOK_BOARD_ALL[1])
    below = F.when(F.col("top") != "0", F.array(*map(F.lit, fixed.HANDBOOK_BOARD_HEAD))).otherwise(F.array(text(fixed.HANDBOOK_BOARD_NONE)))
    meta = fixed.HANDBOOK_META
    frame = F.flatten(F.array_compact(F.array(
        lines(0, 0, F.array(
            text(fixed.HANDBOOK_TITLE), F.lit(""), text(fixed.HANDBOOK_SOURCE), number(fixed.HANDBOOK_RANGE[0], "posts", fixed.HANDBOOK_RANGE[1]),
            F.lit(fixed.HANDBOOK_DAY + day), number(fixed.HANDBOOK_SIZE, "questions"), F.lit(""), F.lit("---"), F.lit(""),
        )),
        lines(1, 0, F.concat(F.array(title, F.lit("")), below)),
        lines(1, 2, F.array(F.lit(""), F.lit("---"), F.lit(""))),
        F.when(F.col("rare") != "0", lines(3, 0, F.array(
            number(fixed.HANDBOOK_RARE[0], "rare", fixed.HANDBOOK_RARE[1]), F.lit(""), F.lit(fixed.HANDBOOK_RARE_NOTE), F.lit("")
        ))),
        F.when(F.col("rare") != "0", lines(3, 2, F.array(F.lit("")))),
        lines(4, 0, F.array_compact(F.array(
            F.lit("---"), F.lit(""), F.lit(meta[0]), F.lit(""), given(fixed.HANDBOOK_SCRIPT, script), given(fixed.HANDBOOK_MODEL, model),
            number(meta[1], "posts"), number(meta[2], "raw_questions"), number(meta[3], "questions"),
            F.when(F.col("failed_posts") != "0", number(fixed.HANDBOOK_FAILED[0], "failed_posts", fixed.HANDBOOK_FAILED[1])),
        ))),
    )))
    static = totals.select(*no_key, F.explode(frame).alias("x"))
    out = static.unionByName(ranked).unionByName(questions).unionByName(entries)
    return out.select("x.part", "x.section", "rank", "name", "cluster", "x.at", "item", "x.line")
