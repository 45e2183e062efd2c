"""Rule chains on worked examples."""

import pytest
from pyspark.sql import functions as F

from postmill.operators import rules as r

TITLES = r.TitleRules(
    exclude=("frontend", "ml engineer", "manager", "mobile", "ios"),
    include=("staff", "principal", "platform", "infrastructure"), override_companies=("Anthropic",),
)
GEO = r.GeoRules(
    non_us_keywords=(
        "canada", "india", "china", "poland", "spain", "brazil", "united kingdom", " uk", "mexico", "germany",
        "france", "netherlands", "amsterdam", "london", "tokyo", "japan", "bangalore", "são paulo", "sao paulo",
    )
)


def one(spark, expression, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "place", ["Remote-US", "Remote US", "Remote - USA", "United States", "U.S.A. only", "San Francisco, CA, US",
              "New York, NY", "US, Canada", "Remote (US, Canada, UK)", "Indianapolis, IN", "Truckee, CA", "USDS Joint Venture",
              "Atlantis", "", "   ", None],
)
def test_places_that_pass(spark, place):
    assert one(spark, r.us_location("p", GEO), p=place)["is_us"]


@pytest.mark.parametrize(
    "place,word",
    [("Remote Canada", "canada"), ("Bangalore, India", "india"), ("São Paulo, Brazil", "brazil"), ("SÃO PAULO", "são paulo"),
     ("Amsterdam, Netherlands", "netherlands"), ("Remote UK", "uk")],
)
def test_places_that_do_not(spark, place, word):
    got = one(spark, r.us_location("p", GEO), p=place)
    assert (got["is_us"], got["reason"]) == (False, word)


def test_blank_place_under_filter_policy(spark):
    assert not one(spark, r.us_location("p", r.GeoRules(unknown_policy="filter")), p="")["is_us"]


def test_city_rules_differ(spark):
    city = r.CityRules(allowed_cities=("seattle",))
    def all_three(place):
        return tuple(one(spark, f("p", city), p=place) for f in (r.passes_city_at_triage, r.passes_city_at_scan, r.passes_city_in_rules))
    assert all_three("Seattle, WA") == (True, True, True)
    assert all_three("2 locations") == (True, False, False)
    assert all_three("Remotely, TX") == (False, False, True)
    assert all_three("Hybrid - Austin") == (True, True, True)
    assert all_three("Austin") == (False, False, False)


def test_batch_of_ten(spark):
    rows = [
        ("a", "Staff Software Engineer", "GitHub", "Remote"), ("b", "Senior Frontend Engineer", "Figma", "Remote"),
        ("c", "ML Engineer, Recommendations", "Netflix", "Remote"), ("d", "Engineering Manager, Platform", "Walmart", "Bellevue, WA"),
        ("e", "Infrastructure Engineer, Sandboxing", "Anthropic", "Seattle, WA"), ("f", "Principal Software Engineer", "Microsoft", "Remote"),
        ("g", "iOS Engineer", "Snap", "Seattle, WA"), ("h", "Platform Engineer, Internal Tools", "AcmeCo", "Remote"),
        ("i", "Frontend Engineer (Anthropic Studio)", "Anthropic", "Remote"), ("j", "Solutions Architect", "AcmeCo", "Remote"),
    ]
    jobs = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "n int, job_key string, title string, company string, location string")
    done = r.classify_batch(jobs, "n", TITLES)
    status = {x["job_key"]: x["filter_status"] for x in done.collect()}
    assert {k for k, v in status.items() if v == "passes_rules"} == set("aefhij")
    counts = r.classify_counts(done).first()
    assert (counts["passes_count"], counts["filtered_out_count"]) == (6, 4)


def test_geography_beats_override_and_can_be_off(spark):
    say = lambda geo: one(spark, r.classify("t", "c", "l", TITLES, geo), t="Staff Engineer", c="Anthropic", l="Remote Canada")
    assert say(GEO)["reason"] == "non-us location: canada"
    assert say(r.GeoRules(enabled=False))["status"] == "passes_rules"


def test_duplicates_and_blank_pairs(spark):
    rows = [(1, "Staff Engineer", "GitHub"), (2, " staff engineer", "github "), (3, "", ""), (4, "", None)]
    jobs = spark.createDataFrame([(*row, "") for row in rows], "n int, title string, company string, location string")
    status = {x["n"]: x["filter_status"] for x in r.classify_batch(jobs, "n", TITLES).collect()}
    assert status[2] == "duplicate" and [status[n] for n in (1, 3, 4)] == ["passes_rules"] * 3


def test_hot_key_marks_all_but_the_first(spark):
    jobs = spark.range(3000).select(
        F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("title"),
        F.lit("c").alias("company"), F.lit("").alias("location"),
    )
    done = r.classify_batch(jobs, "n", TITLES)
    assert done.filter("filter_status = 'duplicate'").count() == 999
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


LEVELS = r.LevelRules(
    companies={"Amazon": (("principal", "senior_staff"), ("sde ii", "mid"), ("sde i", "junior")), "Snap": (("staff", "staff"),)},
    default=(("senior staff", "senior_staff"), ("staff", "staff"), ("senior", "senior")),
    order={"junior": 1, "mid": 2, "senior": 3, "staff": 4, "senior_staff": 5, "principal": 6},
    min_tier="staff", max_tier="senior_staff",
)


@pytest.mark.parametrize(
    "title,company,tier,band",
    [("Principal SDE", "amazon", "senior_staff", "in_band"), ("SDE II", "Amazon", "mid", "too_low"), ("SDE Intern", " Amazon ", "junior", "too_low"),
     ("Senior Engineer", "Snap", "senior", "too_low"), ("Senior Staff Engineer", "X", "senior_staff", "in_band"), ("Engineer", "X", None, "in_band")],
)
def test_levels(spark, title, company, tier, band):
    got = one(spark, F.struct(r.tier_of("t", "c", LEVELS).alias("tier"), r.band_of(r.tier_of("t", "c", LEVELS), LEVELS).alias("band")), t=title, c=company)
    assert (got["tier"], got["band"]) == (tier, band)


def test_resolver_lookup(spark):
    table = {"Stripe": ("greenhouse", "stripe"), "stripe": ("ashby", "other")}
    spec = r.resolver_for("c", table)
    assert one(spark, spec, c="Stripe")["type"] == "greenhouse"
    assert one(spark, spec, c="stripe")["type"] == "ashby"
    assert one(spark, spec, c=" STRIPE ")["board"] == "stripe"
    assert one(spark, spec, c="") is None and one(spark, spec, c="Nobody") is None


def test_gate(spark):
    gate = r.triage_gate("s", "d")
    assert one(spark, gate, s="resolved", d="x" * 200) is None
    assert "unsupported" in one(spark, gate, s="metadata_only", d="x" * 500)
    assert "too short" in one(spark, gate, s="", d=" x ")
