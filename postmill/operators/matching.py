"""Scored lookup: best opening per job on its board, and ranked search candidates.

Scores depend only on normalised titles and location words, so scoring runs between distinct
titles. A title that stands inside the other is found by exact look-up of the contained title
among what the container holds. All others meet on the words they share, by postings with bounds:
a title's words stand in order of their frequency on the board, rarest first, and the sets of words
that a job can share are tried from one word on. A set that few openings hold is a leaf: the
job is scored against these. A longer posting is never paired: openings that share just this set
score alike but for two words that count when missing, so they are one candidate, and those
that share more hold the set and a later word of the job. What a set and all later words could add
bounds that branch: it ends once it cannot come within reach of the best score found. So a job meets at
most `leaf` openings for each set it tries, however many titles hold its words.

A job whose title stands verbatim on the board needs none of this: no other title can come within reach.
A place adds 0, 2 or 4. For each title the least ordinal at all, per word of its places, and per
place that contains the job's or lies in it are looked up, so places never meet in pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions.text import filled
from postmill.functions.titles import (
    generic_tokens, location_compatible, location_norm, title_norm, title_score,
    tokens_of,
)
from postmill.operators.keyed import top_k
from postmill.session import stage

LOCATION_REACH = 4  # the most a location adds to a score
#: The longest posting whose openings are scored one by one.
LEAF = 16


def contained_in(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs (board, outer, inner) where the text `inner` stands inside the different text `outer`.

    Both sides are distinct (board, t), words parted by single blanks. A contained text of several
    words begins with the end of a word, goes on in whole words and ends with the beginning of
    one; a single word lies in one. Which words end, begin or hold what is settled once per
    distinct word; each outer text then names the few inner texts that it can hold, and these are
    looked up whole.
    """
    words = F.split("t", " ")
    inside = inner.select(words.alias("w"), "t").distinct()
    many, one = inside.filter(F.size("w") > 1), inside.filter(F.size("w") == 1)
    vocabulary = outer.select(F.explode(words).alias("word")).filter("word != ''").distinct()
    starts = F.sequence(F.lit(1), F.length("word"))

    def related(kind: str, pieces: Column, wanted: DataFrame) -> DataFrame:
        held = vocabulary.select("word", F.explode(F.array_distinct(pieces)).alias("piece"))
        return held.join(wanted, "piece").select("word", F.lit(kind).alias("kind"), "piece")

    tails = F.transform(starts, lambda i: F.substr("word", i))
    heads = F.transform(starts, lambda i: F.substr("word", F.lit(1), i))
    within = F.flatten(F.transform(tails, lambda tail: F.transform(F.sequence(F.lit(1), F.length(tail)), lambda n: F.substr(tail, F.lit(1), n))))
    relations = (
        related("first", tails, many.select(F.get("w", F.lit(0)).alias("piece")).distinct())
        .unionByName(related("last", heads, many.select(F.element_at("w", -1).alias("piece")).distinct()))
        .unionByName(related("whole", within, one.select(F.col("t").alias("piece")).distinct()))
        .groupBy("word")
        .agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("piece"))).alias(k) for k in ("first", "last", "whole")])
    )
    placed = outer.select("board", "t", F.posexplode(words).alias("at", "word")).join(relations, "word", "left")
    none = F.array().cast("array<string>")
    kept = [F.coalesce(k, none).alias(k) for k in ("first", "last", "whole")]
    titles = placed.groupBy("board", "t").agg(F.array_sort(F.collect_list(F.struct("at", "word", *kept))).alias("ws"))
    last = F.size("ws")

    def spans(start: Column) -> Column:
        begin = F.get("ws", start - 1)

        def span(stop: Column) -> Column:
            middle = F.transform(F.slice("ws", start + 1, stop - start - 1), lambda x: x["word"])
            end = F.get("ws", stop - 1)
            return F.flatten(
                F.transform(
                    begin["first"],
                    lambda f: F.transform(end["last"], lambda z: F.array_join(F.concat(F.array(f), middle, F.array(z)), " ")),
                )
            )

        return F.flatten(F.transform(F.sequence(start + 1, last), span))

    several = F.when(last > 1, F.flatten(F.transform(F.sequence(F.lit(1), last - 1), spans))).otherwise(none)
    single = F.flatten(F.transform("ws", lambda x: x["whole"]))
    named = titles.select("board", F.col("t").alias("outer"), F.explode(F.array_distinct(F.concat(several, single))).alias("t"))
    return named.join(inner, ["board", "t"]).filter("t != outer").select("board", "outer", F.col("t").alias("inner"))


def _points(condition: Column, value: int) -> Column:
    return F.when(condition, value).otherwise(0)


def _shared_points(words: Column) -> Column:
    """What a set of shared words adds to a title's score; more words never add less."""
    solid = F.size(F.array_except(words, generic_tokens()))
    has = lambda w: F.array_contains(words, w)
    return (
        solid * 3 + F.size(words)
        + _points((solid > 0) & (F.size(words) >= 3), 4)
        + _points(has("software") & has("engineer"), 3)
        + _points(has("full") & has("stack"), 2) + _points(has("ml"), 2)
    )


def _with_words(titles: DataFrame, name: str, frequency: DataFrame) -> DataFrame:
    """Distinct (board, title) with those of its words that the board knows, rarest first, and its telling words.

    A title has few words; `frequency` (board, word, n) has one row per word.
    """
    words = titles.select("board", name, F.explode(F.array_distinct(tokens_of(F.col(name)))).alias("word"))
    known = words.join(frequency, ["board", "word"]).groupBy("board", name).agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ws"))
    holds = lambda w: F.concat(F.lit(" "), F.col(name), F.lit(" ")).contains(f" {w} ")
    return known.select(
        "board", name, F.transform("ws", lambda w: w["word"]).alias("ws"), holds("manager").alias("manager"), holds("engineer").alias("engineer"),
        F.lit(0).alias("at"), F.array().cast("array<string>").alias("held"),
    )


def _one_more(nodes: DataFrame) -> DataFrame:
    """Each node's set of words with each later word of its title; `at` is the last word's place."""
    later = F.when(F.col("at") < F.size("ws"), F.sequence(F.col("at") + 1, F.size("ws"))).otherwise(F.array().cast("array<int>"))
    grown = nodes.withColumn("at", F.explode(later)).withColumn("held", F.array_append("held", F.get("ws", F.col("at") - 1)))
    return grown.withColumn("key", F.array_join("held", " "))


def _as_one(key: str) -> Column:
    """The name under which all openings that share just the words of `key` are one candidate."""
    return F.concat(F.lit("#"), F.col(key), F.lit("#"), F.col("manager").cast("string"), F.lit("#"), F.col("engineer").cast("string"))


def _best_per_title(scored: DataFrame) -> DataFrame:
    return scored.groupBy("board", "jt").agg(F.max("title_score").alias("top"))


def _title_pairs(job_titles: DataFrame, open_titles: DataFrame, offered: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Scored title pairs (board, jt, ot, title_score), and `offered` rows of candidates that stand for many.

    Holds every pair that can come within reach of a job's best score.
    """
    lowest = fixed.MATCH_GATE - LOCATION_REACH
    words = open_titles.select("board", "ot", F.explode(F.array_distinct(tokens_of(F.col("ot")))).alias("word"))
    frequency = stage(words.groupBy("board", "word").agg(F.count(F.lit(1)).alias("n")))
    job_nodes, open_nodes = _with_words(job_titles, "jt", frequency), _with_words(open_titles, "ot", frequency)

    def scored(pairs: DataFrame) -> DataFrame:
        exact = pairs.distinct().withColumn("title_score", title_score(F.col("jt"), F.col("ot")))
        return exact.filter(F.col("title_score") >= lowest)

    jobs, opens = job_titles.select("board", F.col("jt").alias("t")), open_titles.select("board", F.col("ot").alias("t"))
    nested = contained_in(jobs, opens).select("board", F.col("outer").alias("jt"), F.col("inner").alias("ot")).unionByName(
        contained_in(opens, jobs).select("board", F.col("inner").alias("jt"), F.col("outer").alias("ot"))
    )
    found = stage(scored(nested))
    many: DataFrame | None = None
    depth = 0
    while True:
        depth += 1
        rest = F.concat("held", F.slice("ws", F.col("at") + 1, F.greatest(F.size("ws") - F.col("at"), F.lit(0))))
        tried = _one_more(job_nodes).join(_best_per_title(found), ["board", "jt"], "left")
        reach = F.greatest(F.coalesce("top", F.lit(0)), F.lit(fixed.MATCH_GATE)) - LOCATION_REACH
        tried = stage(tried.filter(_shared_points(rest) >= reach).drop("top"))
        if tried.isEmpty():
            break
        wanted = tried.select("board", "key").distinct()
        # A hot posting sends at most leaf + 1 of its openings from a task.
        posted = stage(_one_more(open_nodes).join(wanted, ["board", "key"], "left_semi"))
        first = top_k(posted.select("board", "key", "ot"), ["board", "key"], [F.col("ot").asc()], leaf + 1)
        first = first.groupBy("board", "key").agg(F.collect_list("ot").alias("ots"))
        met = stage(tried.join(first, ["board", "key"]))
        # The first few openings of long postings too are scored at the start: good scores end branches early.
        leaves = met if depth == 1 else met.filter(F.size("ots") <= leaf)
        more = scored(leaves.select("board", "jt", F.explode("ots").alias("ot")))
        job_nodes = met.filter(F.size("ots") > leaf).drop("ots")
        open_nodes = posted.join(job_nodes.select("board", "key").distinct(), ["board", "key"], "left_semi")
        kinds = open_nodes.select("board", "key", F.col("manager").alias("m"), F.col("engineer").alias("e")).distinct()
        alike = job_nodes.join(kinds, ["board", "key"])
        missing = _points(F.col("manager") != F.col("m"), 3) + _points(F.col("engineer") != F.col("e"), 2)
        alike = alike.withColumn("title_score", _shared_points(F.col("held")) - missing).filter(F.col("title_score") >= lowest)
        alike = alike.withColumns({"manager": F.col("m"), "engineer": F.col("e")})
        found = stage(found.unionByName(more).unionByName(alike.select("board", "jt", _as_one("key").alias("ot"), "title_score")))
        held = open_nodes.join(offered, ["board", "ot"]).groupBy("board", _as_one("key").alias("ot"), "ol").agg(F.min("ordinal").alias("ordinal"))
        many = held if many is None else many.unionByName(held)
    return found, many if many is not None else offered.limit(0)


def _places(pairs: DataFrame, places: DataFrame, offered: DataFrame) -> DataFrame:
    """Candidates (board, jt, jl, score, back) of scored title pairs; `back` is minus the ordinal.

    `places`: distinct (board, jt, jl) of the jobs. `offered`: (board, ot, ol, ordinal).
    """
    least = F.min("ordinal").alias("ordinal")
    asked = pairs.join(places, ["board", "jt"])
    kinds = [asked.join(offered.groupBy("board", "ot").agg(least), ["board", "ot"]).withColumn("adds", F.lit(0))]
    by_word = offered.select("board", "ot", "ordinal", F.explode(F.split("ol", " ")).alias("word")).filter("word != ''")
    by_word = by_word.groupBy("board", "ot", "word").agg(least)
    asked_words = asked.withColumn("word", F.explode(F.split("jl", " "))).filter("word != ''")
    kinds.append(asked_words.join(by_word, ["board", "ot", "word"]).withColumn("adds", F.lit(2)).drop("word"))
    # Which places hold which is settled once per distinct place.
    wanted = places.filter("jl != ''").select(F.lit("").alias("board"), F.col("jl").alias("t")).distinct()
    there = offered.filter("ol != ''").select(F.lit("").alias("board"), F.col("ol").alias("t")).distinct()
    same = wanted.join(there, ["board", "t"]).select(F.col("t").alias("jl"), F.col("t").alias("ol"))
    inside = contained_in(wanted, there).select(F.col("outer").alias("jl"), F.col("inner").alias("ol"))
    around = contained_in(there, wanted).select(F.col("inner").alias("jl"), F.col("outer").alias("ol"))
    related = same.unionByName(inside).unionByName(around).distinct().filter(F.arrays_overlap(F.split("jl", " "), F.split("ol", " ")))
    by_place = offered.join(related, "ol").groupBy("board", "ot", "jl").agg(least)
    kinds.append(asked.join(by_place, ["board", "ot", "jl"]).withColumn("adds", F.lit(4)))
    out = None
    for kind in kinds:
        rows = kind.select("board", "jt", "jl", (F.col("title_score") + F.col("adds")).alias("score"), (-F.col("ordinal")).alias("back"))
        out = rows if out is None else out.unionByName(rows)
    return out


def best_openings(jobs: DataFrame, openings: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Best opening per job with a score at the gate or above; equal scores go to the first.

    `jobs`: job_id, board, title, location. `openings`: board, ordinal, title, location.
    Ordinals order the openings of one board; boards may repeat each other's.
    Returns job_id, board, opening (its ordinal on that board), match_score.
    """
    wanted = jobs.select(
        "job_id", "board", title_norm("title").alias("jt"), location_norm("location").alias("jl")
    ).filter("jt != ''")
    # both profile tables feed several joins below: written once, read often
    offered = stage(
        openings.select(
            "board", F.col("ordinal").cast("bigint").alias("ordinal"), title_norm("title").alias("ot"), location_norm("location").alias("ol")
        )
        .filter("ot != ''")
        .groupBy("board", "ot", "ol")
        .agg(F.min("ordinal").alias("ordinal"))
    )
    places = stage(wanted.select("board", "jt", "jl").distinct())
    job_titles = places.select("board", "jt").distinct()
    open_titles = offered.select("board", "ot").distinct()
    verbatim = job_titles.join(
        open_titles.withColumn("jt", F.col("ot")), ["board", "jt"]
    ).select("board", "jt", "ot", title_score(F.col("jt"), F.col("ot")).alias("title_score"))
    others = job_titles.join(
        open_titles.select("board", F.col("ot").alias("jt")), ["board", "jt"], "left_anti"
    )
    met, as_one = _title_pairs(others, open_titles, offered, leaf)
    top = _best_per_title(met)
    near = (
        met.join(top, ["board", "jt"])
        .filter(F.col("title_score") >= F.col("top") - LOCATION_REACH)
        .drop("top")
    )
    best = (
        _places(verbatim.unionByName(near), places, offered.unionByName(as_one))
        .groupBy("board", "jt", "jl")
        .agg(F.max(F.struct("score", "back")).alias("best"))
        .filter(F.col("best.score") >= fixed.MATCH_GATE)
    )
    return wanted.join(best, ["board", "jt", "jl"]).select(
        "job_id", "board", (-F.col("best.back")).alias("opening"), F.col("best.score").alias("match_score")
    )


def gated_matches(
    jobs: DataFrame, openings: DataFrame, minimum_chars: int = fixed.MIN_DESCRIPTION_CHARS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Best opening per job, then the winner alone must fit the place and carry enough text.

    `openings` also holds `description`; a losing runner-up never takes the winner's place.
    `carry` names columns of the winning opening to hand on.
    """
    best = best_openings(jobs, openings)
    extra = [c for c in carry if c not in ("board", "ordinal")]
    winners = openings.select(
        "board",
        F.col("ordinal").alias("opening"),
        *extra,
        F.col("title").alias("opening_title"),
        F.col("location").alias("opening_location"),
        F.length(F.trim(filled("description"))).alias("_chars"),
    )
    return (
        best.join(winners, ["board", "opening"])
        .join(jobs.select("job_id", "location"), "job_id")
        .filter(location_compatible(F.col("location"), F.col("opening_location")))
        .filter(F.col("_chars") >= minimum_chars)
        .select("job_id", "board", "opening", "match_score", "opening_title", "opening_location", *extra)
    )


def rank_candidates(
    scored: DataFrame, limit: int = fixed.MAX_SEARCH_CANDIDATES, minimum: int = fixed.MIN_SEARCH_SCORE
) -> DataFrame:
    """Best hit per (job_id, url), then the first `limit` per job by (-score, url).

    `scored`: job_id, url, score, ordinal and any other columns.
    """
    rest = [c for c in scored.columns if c not in ("job_id", "url")]
    best = (
        scored.filter(F.col("score") >= minimum)
        .groupBy("job_id", "url")
        .agg(
            F.min_by(F.struct(*rest), F.struct(-F.col("score"), F.col("ordinal"))).alias("_hit")
        )
        .select("job_id", "url", "_hit.*")
    )
    return top_k(best, ["job_id"], [F.col("score").desc(), F.col("url").asc()], limit, rank="place")
