"""Sources, inbox, models, sinks and streams end to end on small inputs."""

import json
from datetime import datetime
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from postmill import models, schemas
from postmill.operators import archive, handbook, inbox, keyed, rules
from postmill.plans import jobs as flow
from postmill.sinks import append_json, bad_json_lines, read_json_lines, read_snapshot, write_document, write_snapshot
from postmill.state import BucketedTable
from postmill.sources import boards, datasource, mail, posts



def now():
    return F.lit("2026-04-25 00:00:00").cast("timestamp")


def pages(spark, *payloads):
    texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "payload string, page int")


def test_adapter_table_is_complete():
    assert len(boards.ADAPTERS) == 16


def test_team_filter_and_missing_settings(spark):
    listing = {"data": {"positions": [
        {"jobId": "1", "title": "Software Engineer, Office", "positionUrl": "/job/1", "businessGroup": "M365"},
        {"jobId": "2", "title": "Principal Engineer, AI Platform", "positionUrl": "/job/2", "businessGroup": "X"},
        {"jobId": "3", "title": "Principal Engineer, Storage", "positionUrl": "/job/3", "businessGroup": "Cloud + AI"}]}}
    got = boards.pcsx(pages(spark, listing), "Microsoft AI", now(), team_filter="ai").select("ats_job_id").collect()
    assert {r[0] for r in got} == {"2", "3"}
    assert boards.workday(pages(spark, {"jobPostings": [{"title": "x"}]}), "X", now(), tenant="x").count() == 0
    assert boards.meta_careers(pages(spark, "<html>"), "Meta", now()).count() == 0


def test_feeds_survive_broken_pages_and_count_links_once(spark):
    feed = "<rss><channel><item><title>Eng at Acme</title><link>https://w/l/abc</link><description>d</description></item></channel></rss>"
    got = boards.weworkremotely(pages(spark, feed, "<not valid", feed), "WWR", now()).collect()
    assert [(r["company"], r["title"], r["ats_job_id"]) for r in got] == [("Acme", "Eng", "abc")]


def test_ids_count_once_over_pages(spark):
    page = '<a href="jobs/results/111-eng" aria-label="Learn more about Engineer"></a>'
    got = boards.google_careers(pages(spark, page, page), "Google", now()).collect()
    assert len(got) == 1 and got[0]["external_jd_url"].endswith("/jobs/results/111-eng")


def test_job_key_falls_back(spark):
    item = {"jobs": [{"id": 7, "title": "Eng", "absolute_url": "", "location": None, "content": None}]}
    row = boards.greenhouse(pages(spark, item), "X", now()).first()
    assert row["links"] == [] and row["job_key"] and row["location"] == ""


def test_paged_reader_stops_and_isolates(spark, tmp_path):
    listing = ['{"positions": [%s]}' % ", ".join('{"id": %d}' % i for i in ids) for ids in (range(10), (10, 11), (12,))]
    for n, text in enumerate(listing):
        (tmp_path / f"{n}.txt").write_text(text)
    specs = [{"name": "A", "ats": "phenom", "folder": str(tmp_path)}, {"name": "B", "ats": "pcsx"}, {"name": "C", "ats": "pcsx", "enabled": False}]
    got = {(r["company"], r["page"]): (r["payload"], r["error"]) for r in datasource.read_boards(spark, specs, "postmill.sources.datasource:recorded_page").collect()}
    assert got[("A", 0)][0] == listing[0] and got[("A", 1)][0] == listing[1] and got[("B", 0)][1] and len(got) == 3


DIGEST = [
    (4392832600, "Staff Software Engineer", "GitHub · United States (Remote)"), (4404476849, "Software Engineer, Habitat (Online Data)", "OpenAI · Seattle, WA"),
    (4208842500, "Software Engineer - Customer Service Platform", "Netflix · United States (Remote)"), (4320285569, "Principal Software Engineer", "Walmart · Bellevue, WA (On-site)"),
    (1111111111, "Software Engineer", "CompanyA · Seattle, WA"), (2222222222, "Software Engineer", "CompanyB · Bellevue, WA"),
]


def test_mail_folder_to_jobs_and_state(spark, tmp_path):
    message = EmailMessage()
    message["From"], message["Subject"], message["Message-Id"] = "jobs-noreply@linkedin.com", "Your job alert", "<d@l>"
    cards = "".join(f'<a href="https://www.linkedin.com/comm/jobs/view/{i}/?trk=f">{title}</a><p>{card}</p><p>Actively recruiting</p>' for i, title, card in DIGEST)
    message.add_alternative(f'<html><p>Your job alert for software engineer</p>{cards}<a href="https://www.linkedin.com/comm/jobs/search?k=s">See all jobs</a></html>', subtype="html")
    (tmp_path / "a.eml").write_bytes(bytes(message))
    (tmp_path / "b.eml").write_bytes(bytes(message))
    messages = mail.read_mail_folder(spark, str(tmp_path))
    empty = spark.createDataFrame([], schemas.SEEN_JOB)
    fresh, state = flow.ingest_alerts(messages, empty, now())
    rows = {r["linkedin_url"].split("/")[-2]: r for r in fresh.collect()}
    assert len(rows) == 6 and state.count() == 6
    for ident, title, card in DIGEST:
        assert (rows[str(ident)]["title"], rows[str(ident)]["company"]) == (title, card.split(" · ")[0])
    again, _ = flow.ingest_alerts(messages, state, now())
    assert again.count() == 0


def test_reparse_drops_and_splits(spark):
    rows = [("Staff Engineer Stripe · Seattle (Remote)", "https://l/jobs/view/1", ""), ("View jobs", "https://l/jobs/view/2", ""), ("Eng", "https://l/jobs/search", "")]
    df = spark.createDataFrame([(t, "", "", m, l) for t, l, m in rows], "title string, company string, location string, modality string, linkedin_url string")
    got = mail.reparse(df).collect()
    assert [(r["title"], r["company"], r["location"], r["modality"]) for r in got] == [("Staff Engineer", "Stripe", "Seattle", "remote")]


def scan_specs(spark):
    listing = lambda *titles: json.dumps({"jobs": [{"id": i, "title": t, "absolute_url": f"https://g/{t}/{i}", "location": {"name": "Remote"}, "content": ""} for i, t in enumerate(titles)]})
    rows = [("A", "greenhouse", 0, listing("Staff Engineer", "Sales", "Staff Data")), ("B", "greenhouse", 0, listing("Staff Ops", "Staff Dev", "Staff Net"))]
    specs = [{"name": "A", "ats": "greenhouse"}, {"name": "B", "ats": "greenhouse"}, {"name": "C", "ats": "nope"}]
    return spark.createDataFrame(rows, "company string, ats string, page int, payload string"), specs


def test_scan_filters_state_and_quota(spark):
    fetched, specs = scan_specs(spark)
    jobs = flow.scan_jobs(fetched, specs, now())
    empty = spark.createDataFrame([], schemas.SEEN_JOB)
    fresh, state = flow.scan_targets(jobs, empty, flow.ScanRules(include=("staff",), max_details=2), now())
    assert fresh.count() == 5 and fresh.filter("fetch_detail AND company = 'B'").count() == 2
    again, later = flow.scan_targets(jobs, state, flow.ScanRules(include=("staff",)), F.lit("2026-04-26").cast("timestamp"))
    assert again.count() == 0 and later.filter("last_seen_at > first_seen_at").count() == 5


def test_resolution_on_boards(spark):
    jobs = spark.createDataFrame(
        [("k1", "Staff Software Engineer", "Stripe", "Seattle"), ("k2", "Junior Cook", "stripe", "Seattle"), ("k3", "Principal Engineer", "Other", "")],
        "job_key string, title string, company string, location string",
    )
    levels = rules.LevelRules(default=(("principal", "principal"), ("staff", "staff")), order={"staff": 4, "principal": 6}, min_tier="staff", max_tier="staff")
    openings = spark.createDataFrame(
        [("stripe", 5, "Staff Software Engineer", "Seattle, WA", "https://s/5", "d" * 300, "direct_greenhouse_api")],
        "board string, ordinal long, title string, location string, url string, description string, source string",
    )
    done = flow.resolve_on_boards(flow.band_gate(jobs, levels), openings, {"Stripe": ("greenhouse", "stripe")})
    got = {r["job_key"]: (r["external_jd_status"], r["external_jd_url"]) for r in done.collect()}
    assert got == {"k1": ("resolved", "https://s/5"), "k2": ("unresolved", ""), "k3": ("out_of_band_too_high", "")}


def test_candidate_pages_first_valid_wins(spark):
    jobs = spark.createDataFrame([("k", "Staff Engineer", "Acme", "Here", ["https://a/1", "https://www.linkedin.com/x"], ["https://a/1", "https://b/2"])],
                                 "job_key string, title string, company string, location string, external_candidates array<string>, links array<string>")
    found = flow.external_candidates(jobs)
    assert [(r["url"], r["source"]) for r in found.orderBy("place").collect()] == [("https://a/1", "external_candidates"), ("https://b/2", "links")]
    posting = json.dumps({"@type": "JobPosting", "title": "T", "description": "<p>" + "word " * 60 + "</p>"})
    html = {"https://a/1": "<p>too short</p>", "https://b/2": f'<script type="application/ld+json">{posting}</script>'}
    fetched = found.join(spark.createDataFrame(list(html.items()), "url string, html string"), "url")
    row = flow.resolve_from_pages(jobs, fetched).first()
    assert (row["external_jd_url"], row["jd_title"], row["jd_company"], row["jd_parser"]) == ("https://b/2", "T", "Acme", "jsonld_jobposting")
    public = spark.createDataFrame([("k", "https://www.linkedin.com/jobs/view/1", '<div class="show-more-less-html__markup x">' + "<p>line</p>" * 60 + "</div>")], "job_key string, linkedin_url string, html string")
    assert flow.resolve_from_public_page(jobs, public).first()["external_jd_status"] == "linkedin_public"


def test_inbox_round_trip(spark):
    rows = [(i, f"k{i}", "C", f"T{i}", "", "https://x/", "", "", "unresolved") for i in range(3)] + [(9, "bad key", "C", "T", "", "", "", "", "unresolved")]
    jobs = spark.createDataFrame(rows, "n int, job_key string, company string, title string, location string, linkedin_url string, external_jd_url string, filter_reason string, external_jd_status string")
    none = spark.createDataFrame([], "job_key string")
    added = inbox.new_sections(jobs, none, "n", F.lit("2026-04-25")).orderBy("n").collect()
    assert [r["section"] is None for r in added] == [False, False, False, True]
    text = inbox.fixed.INBOX_HEADER + "> mine\n" + "".join(f"\n---\n\n{r['section']}\n" for r in added[:3])
    pasted = text.replace(inbox.fixed.INBOX_PLACEHOLDER, inbox.fixed.INBOX_PLACEHOLDER + "\n\n" + "long description " * 20, 1)
    doc = spark.createDataFrame([(pasted,)], "value string")
    found = inbox.read_sections(doc)
    assert [r["job_key"] for r in found.orderBy("at").collect()] == ["k0", "k1", "k2"]
    job = inbox.ready(found).first()
    assert (job["job_key"], job["title"], job["external_jd_status"]) == ("k0", "T0", "user_supplied")
    assert inbox.new_sections(jobs, found.select("job_key"), "n", F.lit("2026-04-26")).filter("section IS NOT NULL").count() == 0
    def cut(*keys):
        return doc.select(inbox.without_sections(F.col("value"), F.array(*[F.lit(k) for k in keys])).alias("v")).first()["v"]
    assert "k1" in cut("k0", "k2") and "id=k0" not in cut("k0", "k2") and "> mine" in cut("k0", "k2")
    gone = cut("k0", "k1", "k2")
    assert "JOB-START" not in gone and "---" not in gone


@pytest.mark.parametrize(
    "reply,status,reason",
    [('{"role_type_match": "pass"}', "passes_rules", "rules ambiguous; llm: pass"), ('x {"role_type_match": "Exclude"}', "filtered_out", "llm output invalid"),
     ('{"role_type_match": "exclude"}', "filtered_out", "rules ambiguous; llm: exclude"), ("nonsense", "filtered_out", "llm output invalid"), (None, "filtered_out", "llm error: RuntimeError")],
)
def test_tie_break_fails_closed(spark, reply, status, reason):
    def model(prompt):
        if reply is None:
            raise RuntimeError("down")
        return reply

    jobs = spark.createDataFrame([("Odd", "C", "undecided", "rules ambiguous", None), ("Staff", "C", "passes_rules", "x", None)],
                                 "title string, company string, filter_status string, filter_reason string, ambiguous_resolved_by string")
    got = {r["title"]: r for r in models.decide_undecided(jobs, model, "platform", model_name="m").collect()}
    assert (got["Odd"]["filter_status"], got["Odd"]["filter_reason"]) == (status, reason)
    assert got["Staff"]["filter_status"] == "passes_rules"
    blank = models.decide_undecided(jobs, model, " ").filter("title = 'Odd'").first()
    assert blank["filter_reason"] == "llm error: no profile available"


def test_scoring_gates_and_clamps(spark):
    jobs = spark.createDataFrame([("a", "T", "resolved", "x" * 300), ("b", "T", "resolved", "short"), ("c", "T", "metadata_only", "x" * 300)], "job_key string, title string, external_jd_status string, jd_text string")
    done = models.score_with_model(jobs, lambda prompt: 'Sure: {"match_score": 140, "top_strengths": ["s"]} bye', "resume")
    got = {r["job_key"]: r for r in done.collect()}
    assert (got["a"]["match_score"], got["a"]["verdict"], got["a"]["error"]) == (100, "strong_match", None)
    assert got["b"]["match_score"] is None and "short" in got["b"]["error"] and "unsupported" in got["c"]["error"]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_batch_extraction_marks_failures(spark):
    def model(batch):
        if any(p["thread_id"] == "13" for p in batch):
            raise ValueError("boom")
        return [{"thread_id": p["thread_id"], "questions": [{"name": p["title"], "type": "coding"}]} for p in batch]

    threads = spark.createDataFrame([(str(i), f"Q{i % 3}", "", "b") for i in range(20)], "thread_id string, title string, tag_line string, op_body string").coalesce(1)
    done = models.extract_in_batches(threads, model)
    assert done.filter("error IS NOT NULL").count() == 8
    flat = handbook.flatten_questions(done).withColumn("n", F.col("thread_id").cast("int"))
    canonical = handbook.canonical_questions(flat, "n")
    assert sum(r["frequency"] for r in canonical.collect()) == 12
    counts = handbook.handbook_counts(done, canonical).first()
    assert (counts["posts"], counts["raw_questions"], counts["failed_posts"], counts["questions"]) == (20, 12, 8, 3)


def test_snapshots_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "k string, v int")
    for day in (1, 2):
        write_snapshot(df, str(tmp_path), "jobs", datetime(2026, 1, day), {"job_count": 1, "other": 2})
    log = read_json_lines(spark, str(tmp_path / "history" / "jobs_log"), "run_slug string, summary map<string,string>")
    assert log.count() == 2 and log.first()["summary"] == {"job_count": "1"}
    assert spark.read.parquet(str(tmp_path / "history" / "jobs")).count() == 2
    assert read_snapshot(spark, str(tmp_path), "other") is None
    reader = read_snapshot(spark, str(tmp_path), "jobs")
    broken = df.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        write_snapshot(broken, str(tmp_path), "jobs", datetime(2026, 1, 3))
    write_snapshot(df.limit(0), str(tmp_path), "jobs", datetime(2026, 1, 4))
    # A reader that began before goes on with what it saw; a new one sees the newest whole snapshot.
    assert reader.count() == 1 and read_snapshot(spark, str(tmp_path), "jobs").count() == 0
    append_json(df, str(tmp_path / "log"))
    (tmp_path / "log" / "bad.json").write_text("{broken\n")
    assert read_json_lines(spark, str(tmp_path / "log"), "k string, v int").count() == 1
    (bad,) = bad_json_lines(spark, str(tmp_path / "log"), "k string, v int").collect()
    assert bad.line == "{broken" and bad.file.endswith("/log/bad.json")
    lines = spark.range(50).select(F.col("id"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    write_document(lines, [F.col("id").asc()], str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert text.splitlines() == [f"line {i}" for i in range(50)]


def test_upsert_is_monotone(spark):
    state = spark.createDataFrame([("a", 5, 9), ("b", 1, 2)], "k string, first_seen_at int, last_seen_at int")
    batch = spark.createDataFrame([("a", 3, 1), ("a", 12, 2), ("c", 7, 3), ("", 1, 4)], "k string, t int, n int")
    done = {r["k"]: (r["first_seen_at"], r["last_seen_at"]) for r in keyed.upsert_seen(state, batch, ["k"], F.col("t"), "n").collect()}
    assert done == {"a": (5, 12), "b": (1, 2), "c": (7, 7)}


def test_stream_in_two_runs_equals_one_upsert(spark, tmp_path):
    from postmill.streaming.incremental import run_seen_stream

    schema = "k string, t int, n int"
    first = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("a", 3, 3)], schema)
    second = spark.createDataFrame([("a", 9, 4), ("c", 9, 5)], schema)
    table = BucketedTable(spark, str(tmp_path / "state"), "k string, first_seen_at int, last_seen_at int", ["k"], 4)
    fresh = []
    for batch in (first, second):
        batch.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run_seen_stream(stream, table, ["k"], lambda: F.col("t"), "n", str(tmp_path / "cp"), on_new=lambda df, _: fresh.extend(r["k"] for r in df.collect()))
    assert {r["k"]: (r["first_seen_at"], r["last_seen_at"]) for r in table.read().collect()} == {"a": (1, 9), "b": (2, 2), "c": (9, 9)}
    assert sorted(fresh) == ["a", "b", "c"]


def test_a_second_stream_goes_on_from_the_newest_state(spark, tmp_path):
    from postmill.streaming.incremental import run_seen_stream

    table = BucketedTable(spark, str(tmp_path / "state"), "k string, first_seen_at int, last_seen_at int", ["k"], 4)

    def run(rows, folder, checkpoint, **options):
        spark.createDataFrame(rows, "k string, t int, n int").write.mode("append").parquet(str(tmp_path / folder))
        stream = spark.readStream.schema("k string, t int, n int").parquet(str(tmp_path / folder))
        run_seen_stream(stream, table, ["k"], lambda: F.col("t"), "n", str(tmp_path / checkpoint), **options)

    def keys():
        return sorted(r["k"] for r in table.read().collect())

    run([("a", 1, 1)], "one", "cp1")
    run([("b", 2, 2)], "one", "cp1")
    run([("d", 3, 3)], "two", "cp2")
    assert keys() == ["a", "b", "d"] and len(table.versions()) == 3
    mark = json.loads(table.folder.read(f"versions/{table.versions()[2]}"))["mark"]
    assert mark and table.marked(mark) and not table.marked("other-0")
    # rows whose writer was lost before its manifest are neither read nor in the way
    spark.createDataFrame([("x", 1, 1)], "k string, t int, n int").write.parquet(str(tmp_path / "state" / "data" / "lost"))
    assert keys() == ["a", "b", "d"]
    run([("e", 4, 4)], "two", "cp2", keep=2)
    assert keys() == ["a", "b", "d", "e"] and sorted(table.versions()) == [2, 3]


def test_a_listing_without_an_end_tells_so(monkeypatch):
    import sys

    module = type(datasource)("endless_stub")
    module.fetch = lambda spec, page: json.dumps({"data": {"job_post_list": [{"id": page * 100 + i} for i in range(100)]}})
    monkeypatch.setitem(sys.modules, "endless_stub", module)
    monkeypatch.setattr(datasource, "MOST_PAGES", 3)
    reader = datasource.PagedReader({"specs": "[]", "fetch": "endless_stub:fetch"})
    rows = list(reader.read(datasource.Board({"name": "n", "ats": "tiktok_usds"})))
    assert [r[2] for r in rows] == [0, 1, 2, 3] and rows[-1][3] is None and "goes on" in rows[-1][4]
    bounded = list(reader.read(datasource.Board({"name": "n", "ats": "tiktok_usds", "max_pages": 2})))
    assert [r[2] for r in bounded] == [0, 1] and not any(r[4] for r in bounded)


def test_paging_rules():
    def read(spec, pages):
        reader = datasource.PagedReader({"specs": "[]", "fetch": "x:y"})
        asked = []

        def fetch(_, page):
            asked.append(page)
            return pages[page] if page < len(pages) else pages[-1]

        module = type(datasource)("paging_stub")
        module.fetch = fetch
        import sys

        sys.modules["paging_stub"] = module
        reader.fetch = "paging_stub:fetch"
        rows = list(reader.read(datasource.Board({"name": "n", **spec})))
        return len(rows), len(asked)

    def jobs(*ids, total=None):
        import json

        return json.dumps({"jobs": [{"id": i} for i in ids], **({"hits": total} if total else {})})

    full = range(100)
    assert read({"ats": "amazon_jobs"}, [jobs()]) == (0, 1)
    assert read({"ats": "amazon_jobs"}, [jobs(*full), jobs(200)]) == (2, 2)
    assert read({"ats": "amazon_jobs"}, [jobs(*full, total=100)]) == (1, 1)
    assert read({"ats": "amazon_jobs"}, [jobs(*full)]) == (1, 2)
    assert read({"ats": "amazon_jobs"}, ["<html>"]) == (0, 1)
    assert read({"ats": "tiktok_usds"}, ['{"data": {"job_post_list": []}}']) == (0, 1)
    assert read({"ats": "google_careers"}, ["<a href='jobs/results/1-x'>", "<a href='jobs/results/2-x'>", "<a href='jobs/results/2-x'>"]) == (2, 3)
    assert read({"ats": "greenhouse"}, ["{}"]) == (1, 1)
    assert read({"ats": "workday", "max_pages": 2}, ['{"jobPostings": [%s]}' % ",".join('{"id": %d}' % (i + 20 * p) for i in range(20)) for p in range(5)]) == (2, 2)


def test_two_boards_with_one_payload_stay_apart(spark):
    from postmill.plans.jobs import ScanRules, scan_jobs, scan_targets

    payload = '{"jobs": [{"id": "1", "title": "Engineer", "absolute_url": "https://x.example/1", "location": {"name": "Remote"}, "content": ""}, {"id": "2", "title": "Engineer", "absolute_url": "https://x.example/2", "location": {"name": "Remote"}, "content": ""}]}'
    pages = spark.createDataFrame([(c, "greenhouse", 0, payload) for c in ("A", "B")], "company string, ats string, page int, payload string")
    specs = [{"name": c, "ats": "greenhouse"} for c in ("A", "B")]
    now = F.lit("2026-01-01").cast("timestamp")
    jobs = scan_jobs(pages, specs, now)
    seen = spark.createDataFrame([], "job_key string, first_seen_at timestamp, last_seen_at timestamp, title string, company string, location string, linkedin_url string, jobright_url string, external_jd_url string")
    fresh, state = scan_targets(jobs, seen, ScanRules(include=("engineer",), max_details=1), now)
    assert jobs.count() == 4 == fresh.count()
    assert sorted((r["board"], r["n"]) for r in fresh.groupBy("board").agg(F.count_if("fetch_detail").alias("n")).collect()) == [("A", 1), ("B", 1)]


def test_cutoff_stops_the_listing(spark):
    rows = [("b", 0, 0, "1", "2026-01-05"), ("b", 0, 1, "2", ""), ("b", 1, 0, "3", "2025-01-01 10:00"), ("b", 1, 1, "4", "2026-01-01"),
            ("a", 0, 0, "5", "2026-01-05"), ("a", 2, 0, "6", "2026-01-05"), (None, 3, 0, "7", ""), (None, 3, 1, "8", "2024-01-01")]
    listings = spark.createDataFrame(rows, "company string, page int, at int, tid string, posted_at string")
    kept = posts.before_cutoff(listings, F.lit("2025-06-01").cast("timestamp"))
    assert sorted(r["tid"] for r in kept.collect()) == ["1", "2", "5", "6", "7"]


def test_source_settings():
    got = posts.source_config("Byte Dance", overrides={"reddit": {"enabled": False}, "leetcode": {"search_terms": ["x"]}})
    assert got == {"1p3a": {"slug": "byte-dance"}, "leetcode": {"search_terms": ["x"]}, "glassdoor": {"slug": "byte-dance"}}


def test_two_key_merge(spark):
    base = spark.createDataFrame([("a", "u1"), ("", "u9")], "job_key string, url string")
    extra = spark.createDataFrame([("a", "u2", 1), ("b", "u1", 2), ("c", "", 3), (None, None, 4), ("d", "u4", 5), ("d", "u4", 6)], "job_key string, url string, n int")
    got = keyed.merge_unmatched(base, extra, ["job_key", "url"], "n")
    assert sorted(r["n"] for r in got.filter("n IS NOT NULL").collect()) == [3, 4, 5, 6] and got.count() == 6
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_runs(spark):
    df = spark.createDataFrame([([True, True, False, True, False, True, True, True],), ([],), ([False],)], "f array<boolean>")
    got = [[(r["start"], r["end"]) for r in row["x"]] for row in df.select(archive.runs(F.col("f")).alias("x")).collect()]
    assert got == [[(1, 2), (6, 8)], [], []]
