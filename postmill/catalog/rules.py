"""Rule chains over part, customer and orders."""

from pyspark.sql import functions as F

from postmill.catalog.registry import query, table
from postmill.operators import rules as r

TITLES = r.TitleRules(
    exclude=("anvil", "ring"), include=("red", "blue", "bolt"),
    override_companies=("Brand#7", "brand#12 "), ambiguous_policy="pending",
)
GEO = r.GeoRules(non_us_keywords=("promo", "economy"))
CITY = r.CityRules(allowed_cities=("standard", "small", "medium"))

CLASSIFIED = """
WITH keyed AS (
  SELECT p_partkey, p_name, p_brand, p_type,
         row_number() OVER (PARTITION BY lower(trim(p_brand)), lower(trim(p_name)) ORDER BY p_partkey) AS rn
  FROM part),
judged AS (
  SELECT p_partkey,
    CASE WHEN rn > 1 THEN 'duplicate'
         WHEN regexp_matches(p_type, '\\bpromo\\b', 'i') THEN 'filtered_out'
         WHEN regexp_matches(p_type, '\\beconomy\\b', 'i') THEN 'filtered_out'
         WHEN p_type <> '' AND NOT (contains(lower(p_type), 'standard') OR contains(lower(p_type), 'small')
              OR contains(lower(p_type), 'medium') OR contains(lower(p_type), 'remote')
              OR contains(lower(p_type), 'hybrid')) THEN 'filtered_out'
         WHEN lower(trim(p_brand)) IN ('brand#7', 'brand#12') THEN 'passes_rules'
         WHEN contains(lower(p_name), 'anvil') OR contains(lower(p_name), 'ring') THEN 'filtered_out'
         ELSE 'passes_rules' END AS filter_status,
    CASE WHEN rn > 1 THEN 'dedup within run'
         WHEN regexp_matches(p_type, '\\bpromo\\b', 'i') THEN 'non-us location: promo'
         WHEN regexp_matches(p_type, '\\beconomy\\b', 'i') THEN 'non-us location: economy'
         WHEN p_type <> '' AND NOT (contains(lower(p_type), 'standard') OR contains(lower(p_type), 'small')
              OR contains(lower(p_type), 'medium') OR contains(lower(p_type), 'remote')
              OR contains(lower(p_type), 'hybrid')) THEN 'onsite outside allowed cities: ' || p_type
         WHEN lower(trim(p_brand)) = 'brand#7' THEN 'override: Brand#7'
         WHEN lower(trim(p_brand)) = 'brand#12' THEN 'override: brand#12 '
         WHEN contains(lower(p_name), 'anvil') THEN 'matched exclude: anvil'
         WHEN contains(lower(p_name), 'ring') THEN 'matched exclude: ring'
         WHEN contains(lower(p_name), 'red') THEN 'matched include: red'
         WHEN contains(lower(p_name), 'blue') THEN 'matched include: blue'
         WHEN contains(lower(p_name), 'bolt') THEN 'matched include: bolt'
         ELSE 'ambiguous; pending-policy passes through' END AS filter_reason
  FROM keyed)
"""


def classified_parts(spark, sf):
    jobs = table(spark, sf, "part").select(
        F.col("p_partkey"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"),
        F.col("p_type").alias("location"),
    )
    return r.classify_batch(jobs, "p_partkey", TITLES, GEO, CITY)


@query("classify_titles", CLASSIFIED + "SELECT * FROM judged")
def classify_titles(spark, sf):
    return classified_parts(spark, sf).select("p_partkey", "filter_status", "filter_reason")


@query(
    "classify_counts",
    CLASSIFIED
    + """SELECT count(*) AS input_count,
         count(*) FILTER (WHERE filter_status = 'passes_rules') AS passes_count,
         count(*) FILTER (WHERE filter_status = 'filtered_out') AS filtered_out_count FROM judged""",
)
def classify_counts(spark, sf):
    return r.classify_counts(classified_parts(spark, sf))


PLACES = r.GeoRules(non_us_keywords=("asia", " europe", "nation_1"), unknown_policy="pass")
METRO = r.CityRules(allowed_cities=("America", "NATION_2"))


STRICT = r.GeoRules(non_us_keywords=PLACES.non_us_keywords, unknown_policy="filter")
NEAR_ONLY = r.CityRules(allowed_cities=METRO.allowed_cities, allow_remote=False)
PLACE_FORMS = """CASE c_custkey % 9 WHEN 0 THEN n_name || ', ' || r_name WHEN 1 THEN '' WHEN 2 THEN ' ' WHEN 3 THEN 'United States'
  WHEN 4 THEN n_name || ' Hybrid' WHEN 5 THEN n_name || ', remotely' WHEN 6 THEN r_name || ', USA' WHEN 7 THEN (c_custkey % 50) || ' Locations' ELSE n_name END"""


@query(
    "geo_filter",
    f"""
WITH placed AS (
  SELECT c_custkey, {PLACE_FORMS} AS location
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
told AS (SELECT *, trim(location) AS t, regexp_matches(location, '\\b(united states|usa)\\b', 'i') AS us,
  CASE WHEN regexp_matches(location, '\\basia\\b', 'i') THEN 'asia' WHEN regexp_matches(location, '\\beurope\\b', 'i') THEN 'europe'
       WHEN regexp_matches(location, '\\bnation_1\\b', 'i') THEN 'nation_1' END AS away,
  regexp_matches(location, 'america|nation_2', 'i') AS near, regexp_matches(location, '\\b(remote|hybrid)\\b', 'i') AS off_site FROM placed)
SELECT c_custkey, location,
  t = '' OR us OR away IS NULL AS is_us,
  CASE WHEN t = '' THEN 'empty' WHEN us THEN 'us-mentioned' ELSE coalesce(away, 'none') END AS reason,
  t <> '' AND us AS is_us_strict,
  CASE WHEN t = '' THEN 'empty (filter policy)' WHEN us THEN 'us-mentioned' ELSE coalesce(away, 'unknown (filter policy)') END AS reason_strict,
  t = '' OR near OR off_site OR regexp_matches(t, '^(united states|[0-9]+ locations)$', 'i') AS at_triage,
  location = '' OR near OR off_site AS at_scan,
  location = '' OR near OR regexp_matches(location, 'remote|hybrid', 'i') AS in_rules,
  location = '' OR near AS near_only
FROM told""",
)
def geo_filter(spark, sf):
    """Places in nine forms: blank, vague, with a US token, hybrid, and `remotely`, which holds a word only as a part."""
    placed = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.expr(PLACE_FORMS).alias("location"))
    )
    judged = placed.withColumn("_us", r.us_location("location", PLACES)).withColumn("_strict", r.us_location("location", STRICT))
    return judged.select(
        "c_custkey", "location", F.col("_us.is_us").alias("is_us"),
        F.coalesce("_us.reason", F.lit("none")).alias("reason"),
        F.col("_strict.is_us").alias("is_us_strict"), F.col("_strict.reason").alias("reason_strict"),
        r.passes_city_at_triage("location", METRO).alias("at_triage"),
        r.passes_city_at_scan("location", METRO).alias("at_scan"),
        r.passes_city_in_rules("location", METRO).alias("in_rules"),
        r.passes_city_at_scan("location", NEAR_ONLY).alias("near_only"),
    )


@query(
    "scan_title_filter",
    """
SELECT p_partkey,
  NOT regexp_matches(p_name, 'old|tiny', 'i') AND regexp_matches(p_name, 'bolt|gear|red', 'i') AS matches_global,
  CASE WHEN p_brand = 'Brand#3' THEN NOT regexp_matches(p_name, 'old|tiny', 'i') AND regexp_matches(p_name, 'anvil', 'i')
       WHEN p_brand = 'Brand#4' THEN NOT regexp_matches(p_name, 'bolt', 'i') AND regexp_matches(p_name, 'bolt|gear|red', 'i')
       ELSE NOT regexp_matches(p_name, 'old|tiny', 'i') AND regexp_matches(p_name, 'bolt|gear|red', 'i') END AS matches_own,
  true AS matches_without_include
FROM part""",
)
def scan_title_filter(spark, sf):
    include, exclude = ("Bolt", "gear", "red"), ("old", "tiny")
    own = {"Brand#3": {"include": ("anvil",)}, "Brand#4": {"exclude": ("bolt",)}}
    return table(spark, sf, "part").select(
        "p_partkey",
        r.title_matches("p_name", include, exclude).alias("matches_global"),
        r.title_matches_by_company("p_name", "p_brand", include, exclude, own).alias("matches_own"),
        r.title_matches("p_name", (), exclude).alias("matches_without_include"),
    )


LEVELS = r.LevelRules(
    companies={
        "F": (("urgent", "staff"), ("high", "senior")),
        "o": (("low", "principal"), ("medium", "staff")),
    },
    default=(("urgent", "principal"), ("high", "staff"), ("medium", "senior"), ("not", "junior")),
    order={"junior": 1, "mid": 2, "senior": 3, "staff": 4, "principal": 6},
    min_tier="senior", max_tier="staff", unknown_policy="in_band",
)


@query(
    "tier_band",
    """
WITH tiered AS (
  SELECT o_orderkey, lower(o_orderpriority) AS t,
    coalesce(
      CASE WHEN o_orderstatus = 'F' THEN CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'staff'
                                              WHEN contains(lower(o_orderpriority), 'high') THEN 'senior' END
           WHEN lower(o_orderstatus) = 'o' THEN CASE WHEN contains(lower(o_orderpriority), 'low') THEN 'principal'
                                              WHEN contains(lower(o_orderpriority), 'medium') THEN 'staff' END END,
      CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'principal'
           WHEN contains(lower(o_orderpriority), 'high') THEN 'staff'
           WHEN contains(lower(o_orderpriority), 'medium') THEN 'senior'
           WHEN contains(lower(o_orderpriority), 'not') THEN 'junior' END) AS level_tier
  FROM orders)
SELECT o_orderkey, coalesce(level_tier, 'none') AS level_tier,
  CASE WHEN level_tier IS NULL THEN 'in_band' WHEN level_tier = 'junior' THEN 'too_low'
       WHEN level_tier = 'principal' THEN 'too_high' ELSE 'in_band' END AS level_band_verdict
FROM tiered""",
)
def tier_band(spark, sf):
    tiered = table(spark, sf, "orders").select(
        "o_orderkey", r.tier_of("o_orderpriority", "o_orderstatus", LEVELS).alias("tier")
    )
    return tiered.select(
        "o_orderkey", F.coalesce("tier", F.lit("none")).alias("level_tier"),
        r.band_of(F.col("tier"), LEVELS).alias("level_band_verdict"),
    )


@query(
    "triage_gate",
    """
SELECT doc_id,
  CASE WHEN status <> '' AND status NOT IN ('resolved', 'linkedin_public', 'ats_api', 'user_supplied')
         THEN 'unsupported external_jd_status: ' || status
       WHEN length(trim(text)) < 200 THEN 'description too short: ' || length(trim(text)) || ' < 200'
       ELSE 'ok' END AS gate
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text,
        CASE lang WHEN 'en' THEN 'resolved' WHEN 'fr' THEN '' WHEN 'de' THEN 'ats_api' ELSE 'unresolved' END AS status
      FROM documents)""",
)
def triage_gate(spark, sf):
    status = F.when(F.col("lang") == "en", "resolved").when(F.col("lang") == "fr", "").when(
        F.col("lang") == "de", "ats_api"
    ).otherwise("unresolved")
    return table(spark, sf, "documents").select(
        "doc_id", F.coalesce(r.triage_gate(status, "text"), F.lit("ok")).alias("gate")
    )


NAMED = "CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN upper(source) ELSE ' ' || source || ' ' END"


@query(
    "company_choices",
    f"""
WITH d AS (SELECT doc_id, source, trim({NAMED}) AS who FROM documents)
SELECT doc_id,
  CASE WHEN who = 'src1' THEN 'greenhouse:one' WHEN who = 'SRC1' THEN 'lever:other' WHEN lower(who) = 'src2' THEN 'ashby:two' END AS resolver,
  CASE WHEN lower(who) = 'src3' THEN 'three' ELSE source || '-default' END AS setting,
  doc_id % 2 = 0 AS chosen, source = 'src4' AS chosen_by_name, doc_id % 4 = 1 AS goes_on
FROM d""",
)
def company_choices(spark, sf):
    """Companies in three spellings: their board by exact and by loose name, a setting, two ways to choose them, and what the rules let pass."""
    from postmill.operators.reports import passing_jobs

    named = table(spark, sf, "documents").select("doc_id", "source", F.expr(NAMED).alias("who"))
    spec = r.resolver_for("who", {"src1": ("greenhouse", "one"), "SRC1": ("lever", "other"), "src2": ("ashby", "two")})
    companies = named.select("doc_id", F.col("source").alias("slug"), (F.col("doc_id") % 2 == 0).alias("enabled"))
    status = F.when(F.col("doc_id") % 4 == 0, "filtered").when(F.col("doc_id") % 4 == 1, "passes_rules").when(F.col("doc_id") % 4 == 2, "ambiguous")
    out = named.withColumn("_spec", spec)
    for flag, kept in (
        ("chosen", r.select_companies(companies)), ("chosen_by_name", r.select_companies(companies, "src4")),
        ("goes_on", passing_jobs(named.select("doc_id", status.alias("filter_status")))),
    ):
        out = out.join(kept.select("doc_id", F.lit(True).alias(flag)), "doc_id", "left")
    return out.select(
        "doc_id", F.when(F.col("_spec").isNotNull(), F.concat_ws(":", "_spec.type", "_spec.board")).alias("resolver"),
        r.company_setting("who", {"Src3": "three", "src3": "late"}, F.concat("source", F.lit("-default"))).alias("setting"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("chosen", "chosen_by_name", "goes_on")],
    )
