"""Scored lookup against brute force over all pairs."""

import random
import re

from postmill import fixed_values as fixed
from postmill.operators.matching import _title_pairs, best_openings, gated_matches, rank_candidates

WORDS = ["software", "engineer", "engineering", "manager", "senior", "staff", "lead", "ml", "full", "stack", "data", "art", "smart", "vp", "SWE", "SDE", "fullstack", "R&D", "ops", "devops"]
PLACES = ["", "Seattle, WA", "Seattle", "Remote", "New York, NY 10001", "NY"]


def tokens(text):
    out = []
    for token in re.findall("[a-z0-9]+", text.lower().replace("&", " and ").replace("fullstack", "full stack")):
        out += {"swe": ["software", "engineer"], "sde": ["software", "development", "engineer"]}.get(token, [token])
    return out


def title_points(a, b):
    ta, tb = tokens(a), tokens(b)
    na, nb, shared = " ".join(ta), " ".join(tb), set(ta) & set(tb)
    generic = shared & set(fixed.GENERIC_ROLE_TOKENS)
    solid = shared - generic
    points = 20 if na and na == nb else 10 if na and nb and (na in nb or nb in na) else 0
    points += 4 * len(solid) + len(generic) + 4 * bool(solid and len(shared) >= 3)
    points += 3 * ({"software", "engineer"} <= shared) + 2 * ({"full", "stack"} <= shared) + 2 * ("ml" in shared)
    return points - 3 * (("manager" in ta) != ("manager" in tb)) - 2 * (("engineer" in ta) != ("engineer" in tb))


def place_points(a, b):
    sa, sb = ({t for t in tokens(x) if len(t) >= 3 or t.isdigit()} for x in (a, b))
    if not sa or not sb or not sa & sb:
        return 0
    na, nb = " ".join(sorted(sa)), " ".join(sorted(sb))
    return 4 if na in nb or nb in na else 2


def sample(seed, jobs, openings):
    rng = random.Random(seed)
    title = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
    board = lambda: "hot" if rng.random() < 0.4 else rng.choice("ab")
    return (
        [(i, board(), title(), rng.choice(PLACES)) for i in range(jobs)],
        [(board(), i, title(), rng.choice(PLACES), "d" * rng.choice([10, 250])) for i in range(openings)],
    )


def frames(spark, jobs, openings):
    return (
        spark.createDataFrame(jobs, "job_id long, board string, title string, location string"),
        spark.createDataFrame(openings, "board string, ordinal long, title string, location string, description string"),
    )


def brute(jobs, openings):
    best = {}
    for job, board, title, place in jobs:
        for there, ordinal, other, where, text in openings:
            if there == board:
                score = title_points(title, other) + place_points(place, where)
                if job not in best or score > best[job][1]:
                    best[job] = (ordinal, score, place, where, text)
    return {j: v for j, v in best.items() if v[1] >= 8}


def test_best_openings_equal_brute_force(spark):
    jobs, openings = sample(7, 150, 120)
    got = {r["job_id"]: (r["opening"], r["match_score"]) for r in best_openings(*frames(spark, jobs, openings)).collect()}
    assert got == {j: v[:2] for j, v in brute(jobs, openings).items()}


def test_long_postings_are_one_candidate(spark):
    jobs, openings = sample(23, 120, 140)
    got = {r["job_id"]: (r["opening"], r["match_score"]) for r in best_openings(*frames(spark, jobs, openings), leaf=1).collect()}
    assert got == {j: v[:2] for j, v in brute(jobs, openings).items()}


def test_title_inside_a_word_is_met(spark):
    jobs = [(1, "b", "art", "Seattle"), (2, "b", "vp", "Seattle"), (3, "b", "engineer", "Seattle")]
    openings = [("b", 1, "smart people", "Seattle", ""), ("b", 2, "the svp desk", "Seattle", ""), ("b", 3, "engineering manager", "Seattle", "")]
    got = {r["job_id"]: (r["opening"], r["match_score"]) for r in best_openings(*frames(spark, jobs, openings)).collect()}
    assert got == {1: (1, 14), 2: (2, 14), 3: (3, 9)}


def test_gates_judge_the_winner_only(spark):
    jobs, openings = sample(11, 120, 90)
    got = {r["job_id"]: r["opening"] for r in gated_matches(*frames(spark, jobs, openings)).collect()}
    fits = lambda place, where: not place or place_points(place, where) > 0 or "remote" in where.lower()
    assert got == {j: v[0] for j, v in brute(jobs, openings).items() if fits(v[2], v[3]) and len(v[4]) >= 200}


def test_rank_candidates(spark):
    rows = [("j", "u1", 7, 1), ("j", "u1", 9, 2), ("j", "u1", 9, 3), ("j", "u0", 9, 4), ("j", "low", 5, 5)] + [("j", f"v{i}", 6, 10 + i) for i in range(9)]
    scored = spark.createDataFrame(rows, "job_id string, url string, score int, ordinal int")
    got = [(r["url"], r["ordinal"]) for r in rank_candidates(scored).orderBy("place").collect()]
    assert got[:2] == [("u0", 4), ("u1", 2)] and len(got) == 8 and got[2][0] == "v0"


def shared_words(seed, n):
    rng, words = random.Random(seed), [f"word{i:02d}" for i in range(20)]
    out = set()
    while len(out) < n:
        out.add(" ".join(rng.sample(words, 5)))
    return sorted(out)


def test_titles_of_words_that_all_share_meet_few_openings(spark):
    met = []
    for n in (300, 1200):
        jobs = spark.createDataFrame([("b", t) for t in shared_words(1, n)], "board string, jt string")
        openings = spark.createDataFrame([("b", t, "", i) for i, t in enumerate(shared_words(2, n))], "board string, ot string, ol string, ordinal long")
        found, _ = _title_pairs(jobs, openings.select("board", "ot"), openings, 8)
        met.append(found.count() / n)
    assert met[1] < 1.5 * met[0]
    jobs = [(i, "b", t, "") for i, t in enumerate(shared_words(3, 60))]
    openings = [("b", i, t, "", "") for i, t in enumerate(shared_words(4, 300))]
    got = {r["job_id"]: (r["opening"], r["match_score"]) for r in best_openings(*frames(spark, jobs, openings)).collect()}
    assert got == {j: v[:2] for j, v in brute(jobs, openings).items()}
