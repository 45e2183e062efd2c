"""Bucketed state, moving notes."""

import os

import pytest
from pyspark.sql import functions as F

from postmill.operators import keyed, notes
from postmill.state import BucketedTable


def table(spark, path, buckets=32):
    return BucketedTable(spark, str(path), "k int, v string", ["k"], buckets)


def replace(held, new):
    return held.join(new, "k", "left_anti").unionByName(new)


def test_a_batch_rewrites_its_own_buckets_only(spark, tmp_path):
    state = table(spark, tmp_path / "s")
    assert state.newest() == -1 and state.read().count() == 0
    state.merge(spark.range(500).select(F.col("id").cast("int").alias("k"), F.lit("old").alias("v")), replace)
    before = state.manifest()
    assert len(before) == 32
    batch = spark.createDataFrame([(k, "new") for k in range(0, 100, 10)], "k int, v string")
    state.merge(batch, replace)
    after = state.manifest()
    changed = {b for b in after if after[b] != before[b]}
    assert 0 < len(changed) <= 10 and changed == set(state.touched(batch))
    got = {r.k: r.v for r in state.read().collect()}
    assert got == {k: "new" if k < 100 and k % 10 == 0 else "old" for k in range(500)}
    assert {r.v for r in state.read(0).collect()} == {"old"}
    assert {r.k for r in state.read_for(batch).collect()} >= set(range(0, 100, 10))
    with pytest.raises(ValueError, match="holds 32 buckets"):
        table(spark, tmp_path / "s", 8).read()


def test_rows_can_leave_and_old_versions_go(spark, tmp_path):
    state = table(spark, tmp_path / "s", 4)
    rows = spark.createDataFrame([(k, "x") for k in range(40)], "k int, v string")
    state.merge(rows, replace)
    state.merge(rows.filter("k < 20"), lambda held, new: held.join(new, "k", "left_anti"), keep=1)
    assert sorted(r.k for r in state.read().collect()) == list(range(20, 40)) and list(state.versions()) == [1]
    state.merge(rows, lambda held, new: held.limit(0), keep=1)
    assert state.read().count() == 0 and state.manifest() == {}
    state.merge(rows.limit(0), replace)
    assert state.read().count() == 0 and state.newest() == 3


def test_a_lost_driver_leaves_the_state_before(spark, tmp_path, monkeypatch):
    state = table(spark, tmp_path / "s", 4)
    state.merge(spark.createDataFrame([(1, "a")], "k int, v string"), replace)
    batch = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")

    def lost(*args, **kwargs):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(state.folder, "write", lost)
        with pytest.raises(RuntimeError):
            state.merge(batch, replace, mark="run-1")
    assert {tuple(r) for r in table(spark, tmp_path / "s", 4).read().collect()} == {(1, "a")}
    for _ in range(2):
        assert state.merge(batch, replace, mark="run-1") == 1
    assert {tuple(r) for r in state.read().collect()} == {(1, "b"), (2, "c")} and state.marked("run-1")


def test_of_two_writers_the_second_fails(spark, tmp_path):
    one, two = table(spark, tmp_path / "s", 4), table(spark, tmp_path / "s", 4)
    one.merge(spark.createDataFrame([(1, "a")], "k int, v string"), replace)

    def overtaken(held, new):
        one.merge(spark.createDataFrame([(2, "b")], "k int, v string"), replace)
        return replace(held, new)

    with pytest.raises(FileExistsError):
        two.merge(spark.createDataFrame([(1, "z")], "k int, v string"), overtaken)
    assert {tuple(r) for r in two.read().collect()} == {(1, "a"), (2, "b")}


def test_whole_rows_are_replaced_by_bucket(spark, tmp_path):
    state = BucketedTable(spark, str(tmp_path / "s"), "k int, v string", ["k"], 4)
    batch = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 3)], "k int, v string, n int")
    state.merge(batch, lambda held, new: keyed.replace_rows(held, new, ["k"], "n").select("k", "v"))
    assert {tuple(r) for r in state.read().collect()} == {(1, "b"), (3, "c")}


def fresh(spark, rows):
    return spark.createDataFrame(
        [(name, folder, score, verdict, "jd_full", f"# {name}\n", stub, at, f"## Review {at}\n") for name, folder, score, verdict, stub, at in rows],
        "note_name string, folder string, score int, verdict string, mode string, note string, stub boolean, ordinal long, review string",
    )


def files(root):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names}


def test_notes_move_with_their_score_and_a_repeated_run_changes_nothing(spark, tmp_path):
    held = BucketedTable(spark, str(tmp_path / "notes"), notes.NOTES, ["note_name"], 4)
    reviews = BucketedTable(spark, str(tmp_path / "reviews"), notes.REVIEWS, ["note_name", "run_label", "ordinal"], 4)
    root = str(tmp_path / "vault")

    def run(rows, label):
        changes = notes.record_notes(held, reviews, fresh(spark, rows), label)
        notes.write_note_files(changes, reviews.read(), root)
        return {r.note_name: r.change for r in changes.collect()}

    low, stub = "Filtered/Low Score", "Filtered/Location"
    first = [("A.md", low, 65, "weak", False, 1), ("B.md", "", 80, "ok", False, 2), ("S.md", stub, 0, "location_filtered", True, 3)]
    assert run(first, "day 1") == {"A.md": "insert", "B.md": "insert", "S.md": "insert"}
    assert files(root) == {f"{low}/65 - A.md", "80 - B.md", f"{stub}/00 - S.md"}
    once = {f: open(os.path.join(root, f)).read() for f in files(root)}
    assert run(first, "day 1") == {"A.md": "keep", "B.md": "keep", "S.md": "keep"}
    assert {f: open(os.path.join(root, f)).read() for f in files(root)} == once
    second = [("A.md", "", 92, "strong", False, 4), ("B.md", "", 80, "fair", False, 5), ("B.md", stub, 0, "location_filtered", True, 6), ("S.md", "", 75, "ok", False, 7), ("S.md", "", 76, "ok", False, 8)]
    assert run(second, "day 2") == {"A.md": "move", "B.md": "update", "S.md": "move"}
    assert files(root) == {"92 - A.md", "80 - B.md", "76 - S.md"}
    text = open(os.path.join(root, "92 - A.md")).read()
    assert text.startswith("---\nmatch_score: 92\nverdict: strong\n") and text.endswith("# A.md\n\n## Review history\n\n## Review 1\n\n## Review 4\n\n")
    assert run(second, "day 2") == {"A.md": "keep", "B.md": "keep", "S.md": "keep"} and len(files(root)) == 3
    assert run([], "day 3") == {}


def test_a_cut_short_run_of_model_calls_goes_on(spark, tmp_path):
    from postmill import models

    calls = tmp_path / "calls"
    calls.mkdir()

    def model(posts):
        # The first post's name counts the calls of a batch over all workers.
        name = posts[0]["thread_id"]
        asked = len(list(calls.glob(f"{name}-*")))
        (calls / f"{name}-{asked}").touch()
        if name in ("t0", "t5") and asked < 2 or name == "t9":
            raise RuntimeError("gateway")
        return [{"thread_id": p["thread_id"], "questions": [{"name": f"q {p['title']}"}]} for p in posts]

    posts = spark.createDataFrame([(f"t{i}", f"title {i}", "", "body") for i in range(10)] + [("t1", "title 1", "", "body")], "thread_id string, title string, tag_line string, op_body string")
    attempts = BucketedTable(spark, str(tmp_path / "attempts"), models.ANSWERS, ["thread_id"], 4)
    # A run that ends after its first wave, as if the driver were lost.
    merged = BucketedTable.merge

    def lost(self, *args, **kwargs):
        merged(self, *args, **kwargs)
        raise RuntimeError("driver lost")

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(BucketedTable, "merge", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            models.extract_resumably(posts, model, attempts, size=1, wait=0.0, waves=4)
    first = {p.name for p in calls.iterdir()}
    assert 0 < attempts.read().count() < 10
    for _ in range(2):
        got = {r.thread_id: (r.error, r.tries, [q["name"] for q in r.questions]) for r in models.extract_resumably(posts, model, attempts, size=1, wait=0.0, waves=4).collect()}
    assert got["t0"] == (None, 3, ["q title 0"]) and got["t5"][1] == 3 and got["t1"] == (None, 1, ["q title 1"])
    assert got["t9"] == ("gateway", 3, []) and len(got) == 10
    count = {f"t{i}": len(list(calls.glob(f"t{i}-*"))) for i in range(10)}
    # Only the post whose calls all fail is asked again, three times a run.
    assert {t: n for t, n in count.items() if t != "t9"} == {t: 3 if t in ("t0", "t5") else 1 for t in count if t != "t9"}
    assert count["t9"] in (6, 9) and first <= {p.name for p in calls.iterdir()}


LISTING_CALLS = []


def listing_page(spec, page):
    LISTING_CALLS.append((spec["name"], page))
    rows = spec["pages"][page] if page < len(spec["pages"]) else []
    return "".join(
        f'<time title="{at}"></time><a href="https://www.1point3acres.com/bbs/thread-{tid}-1-1.html"><div class="flex-1">Thread {tid}</div></a>' for tid, at in rows
    ) or None


def test_listing_spans_follow_each_other():
    from postmill.streaming.listings import ListingReader, Span

    import json

    spec = {"name": "acme", "pages": [[(9, "2026-03-01 10:00"), (8, "2026-02-01 10:00")], [(7, "2025-06-01 10:00"), (6, "2024-12-01 10:00")], [(5, "2024-11-01 10:00")]]}
    options = {"specs": json.dumps([spec, {"name": "idle", "pages": []}]), "fetch": "test_state:listing_page", "until": "2026-02-15 00:00"}
    reader = ListingReader(options)
    end = reader.latestOffset()
    spans = {s.spec["name"]: s for s in reader.partitions(reader.initialOffset(), end)}
    assert spans["acme"].since == "2025-02-20T00:00:00+00:00" and spans["acme"].until == "2026-02-15T00:00:00+00:00"
    LISTING_CALLS.clear()
    assert [r[1] for r in reader.read(spans["acme"])] == [0, 1] and list(reader.read(spans["idle"])) == []
    assert LISTING_CALLS == [("acme", 0), ("acme", 1), ("idle", 0)]
    assert reader.partitions(end, end) == []
    later = ListingReader({**options, "until": "2026-04-01 00:00"})
    (span,) = [s for s in later.partitions(end, later.latestOffset()) if s.spec["name"] == "acme"]
    assert span.since == "2026-02-15T00:00:00+00:00" and [r[1] for r in later.read(span)] == [0]
    assert isinstance(span, Span)


def test_replies_are_repaired():
    import json

    from postmill.functions.repair import repaired

    for text, want in [
        ('{"a": "he said "hi", then left", "b": 1}', {"a": 'he said "hi", then left', "b": 1}), ('{"a": [1, 2, {"b": "x', {"a": [1, 2, {"b": "x"}]}),
        ('{"a": [1, 2}', {"a": [1, 2]}), ('{"a": 1, "b":', {"a": 1, "b": None}), ('[{"k": "v"}, {"k": "w", ', [{"k": "v"}, {"k": "w"}]),
        ('{"a": "line\nbreak\tx"}', {"a": "line\nbreak\tx"}), ('{"a": 1,, "b": 2,}', {"a": 1, "b": 2}), ('{"a": "x" "b": 2}', {"a": "x", "b": 2}),
        ('{"a": tru', {"a": True}), ("{a: 1, b: None}", {"a": 1, "b": None}), ('{"a": "end "quoted""}', {"a": 'end "quoted"'}),
        ('{"q": "What is "O(n)"?", "t": ["a "b" c", "d"]} and so on', {"q": 'What is "O(n)"?', "t": ['a "b" c', "d"]}),
        ("[", []), ("{", {}), ('{"a": "back\\', {"a": "back"}), ('{"a": "\\u00', {"a": ""}), ('{"a": "\\x"}', {"a": "\\x"}), ("[1 2 3]", [1, 2, 3]), ('{"a": "x"}}}', {"a": "x"}),
    ]:
        assert json.loads(repaired(text)) == want, text
    assert repaired("no json") is None and repaired(None) is None
    whole = json.dumps({"a": ["b, c", {"d": 'q: "z"'}, 1.5e3, None], "é": "\u0001"})
    assert json.loads(repaired(whole)) == json.loads(whole)
    for end in range(1, len(whole)):
        json.loads(repaired(whole[:end]))


def test_a_board_is_fetched_once_until_it_is_old(spark, tmp_path):
    import sys

    from postmill.sources import lookup

    calls = tmp_path / "calls"
    calls.mkdir()
    stub = tmp_path / "board_stub.py"
    stub.write_text(
        "import pathlib, uuid\n"
        "def fetch(spec, page):\n"
        f"    (pathlib.Path({str(calls)!r}) / (spec['name'] + '-' + uuid.uuid4().hex)).touch()\n"
        "    if spec['name'] == 'down':\n"
        "        raise ConnectionError('no answer')\n"
        "    return None if spec['name'] == 'bare' else '{\"jobs\": [{\"id\": \"' + spec['name'] + '\", \"title\": \" A  b\"}]}'\n"
    )
    spark.sparkContext.addPyFile(str(stub))
    sys.path.insert(0, str(tmp_path))
    cache = BucketedTable(spark, str(tmp_path / "cache"), lookup.CACHED, lookup.KEYS, 4)

    def ask(names, day):
        wanted = spark.createDataFrame([("greenhouse", n, None) for n in names], "ats string, board string, settings string")
        before = len(list(calls.iterdir()))
        pages = lookup.read_through(wanted, cache, "board_stub:fetch", F.lit(f"2026-01-{day:02d}").cast("timestamp"), max_age_days=5)
        found = {r.board: r.title for r in lookup.greenhouse_openings(pages.filter("payload IS NOT NULL")).collect()}
        return found, len(list(calls.iterdir())) - before

    assert ask(["a", "a", "b", "bare", "down", None], 1) == ({"a": "A b", "b": "A b"}, 4)
    assert ask(["a", "bare"], 2) == ({"a": "A b"}, 0)
    assert ask(["a", "c", "down"], 3) == ({"a": "A b", "c": "A b"}, 2)
    assert ask(["a", "c"], 7) == ({"a": "A b", "c": "A b"}, 1)
    assert ask([], 8) == ({}, 0)


def test_lookup_rows(spark):
    from postmill.sources import lookup

    card = '<a href="/careers/x"><p> Engineer </p><span>NY; SF</span><span>Apply</span></a>'
    pages = spark.createDataFrame([(card, 0), (card, 1)], "payload string, page int")
    (row,) = lookup.cursor_openings(pages, "cursor", F.lit("2026-01-01").cast("timestamp")).collect()
    assert (row.title, row.location, row.url) == ("Engineer", "NY |  SF", "https://cursor.com/careers/x")
    detail = '{"name": "N", "company": {"name": " C "}, "location": {"fullLocation": "L"}, "jobAd": {"sections": {"jobDescription": {"title": "T", "text": "<p>x</p>"}}}}'
    (one,) = lookup.smartrecruiters_detail(spark.createDataFrame([("7", detail), ("8", "broken")], "id string, payload string").filter("id = 7"), "b").collect()
    assert tuple(one) == ("7", "N", "C", "L", "https://jobs.smartrecruiters.com/b/7", "T\nx")


def test_long_listing_pages_are_read_in_linear_time(spark):
    import json
    import time

    from postmill.sources.posts import thread_listings
    from postmill.streaming.listings import PagedReader

    def page(first, count, each=1):
        return "".join(
            (f'<time title="2026-01-{1 + n % 28:02d} 10:00"></time>' if n % each == 0 else "")
            + f'<a href="https://www.1point3acres.com/bbs/thread-{n}-1-1.html"><div class="flex-1">Thread {n}</div></a>' for n in range(first, first + count)
        )

    both = spark.createDataFrame([("a", 0, page(0, 10, 5)), ("a", 1, page(10, 3, 99)), ("b", 0, page(20, 6, 2))], "company string, page int, payload string")
    dates = {int(r["tid"]): r["posted_at"][8:10] for r in thread_listings(both).collect()}
    assert dates == {**{n: "01" for n in range(5)}, **{n: "06" for n in range(5, 10)}, **{n: "" for n in range(10, 13)}, **{n: f"{1 + n // 2 * 2 % 28:02d}" for n in range(20, 26)}}
    long = spark.createDataFrame([("a", 0, page(0, 30000))], "company string, page int, payload string")
    started = time.time()
    assert thread_listings(long).filter("posted_at != ''").count() == 30000
    assert time.time() - started < 20
    spec = {"name": "acme", "pages": [[(9, "2026-03-01 10:00")], [(7, "2026-02-02 10:00")]]}
    reader = PagedReader({"specs": json.dumps([spec]), "fetch": "test_state:listing_page", "until": "2026-03-15 00:00"})
    batches = list(reader.read(reader.partitions(reader.initialOffset(), reader.latestOffset())[0]))
    assert [b.num_rows for b in batches] == [1, 1] and [b.column("page")[0].as_py() for b in batches] == [0, 1]


def test_a_long_listing_page_comes_in_parts_with_the_same_threads(spark):
    import json

    import pyarrow as pa

    from postmill.sources.posts import thread_listings
    from postmill.streaming.listings import PART, PagedReader, in_span, parts

    thread = '<a href="https://www.1point3acres.com/bbs/thread-{0}-1-1.html"><div class="flex-1">Thread {0}</div></a>'.format
    pages = [
        "".join(('<time title="2026-01-0%d 10:00"></time>' % (n % 9 + 1) if n % 4 == 0 else "") + thread(n) for n in range(40)),
        "top</a>" + "".join(thread(100 + n) for n in range(9)) + '<time title=""></time>' + thread(110) + "<abbr>x</a>" * 9 + "no mark" * 40,
        '<time title="2026-02-01 10:00></time>' + thread(200) + '<time title="a</a>b">' + thread(201)
        + thread(202).replace("<div", '<time title="2026-02-09 10:00"></time><div') + thread(203) + thread(204).replace("</a>", "") + thread(205) + thread(206),
        '<time title="2026-03-01 10:00"></time>' + thread(300) + thread("٣") + "<aé " + thread(301)[3:] + "".join(thread(302 + n) for n in range(5)),
    ]
    for most in (1, 150, 10**6):
        cut = [[*parts(page, most)] for page in pages]
        assert ["".join(text for _, _, text in c) for c in cut] == pages and (most > 1 or len(cut[0]) == 50)
        whole = thread_listings(spark.createDataFrame([("a", n, p) for n, p in enumerate(pages)], "company string, page int, payload string"))
        rows = [("a", n, *part) for n, c in enumerate(cut) for part in c]
        split = thread_listings(spark.createDataFrame(rows, "company string, page int, marks int, dated string, payload string"))
        assert split.dtypes == whole.dtypes and sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect())) and whole.count() > 60
    # The reader hands on no more than a part at once; a thread's date may stand in a part before its own.
    spec = {"name": "acme", "pages": [[(n, "2026-03-01 10:00") for n in range(4000)], [(4000, "2026-02-02 10:00"), (4001, "2026-01-02 10:00")]]}
    reader = PagedReader({"specs": json.dumps([spec]), "fetch": "test_state:listing_page", "until": "2026-02-15 00:00", "months": "1"})
    batches = list(reader.read(reader.partitions(reader.initialOffset(), reader.latestOffset())[0]))
    assert len(batches) > 2 and max(len(b.column("payload")[0].as_py()) for b in batches) < PART + 200
    read = spark.createDataFrame(pa.Table.from_batches(batches))
    assert [r["tid"] for r in in_span(read).collect()] == ["4000"] and thread_listings(read).count() == 4002
