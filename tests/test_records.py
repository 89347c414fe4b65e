"""Record operators on fixtures."""

import json
from functools import partial

import pytest
from pyspark.sql import functions as F

from stratamill import schema
from stratamill.functions import decisions as d
from stratamill.functions import scalars as s
from stratamill.operators import blocks, choose, normalize, seeded
from stratamill.sources import pages


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())] or [(1,)], list(values) or ["x"]) if values else spark.range(1)
    return row.select(column.alias("v")).first()[0]


def test_names(spark):
    rows = spark.createDataFrame([("  Ada ",), ("\t \n",), ("x" * 65,), (None,)], "n string")
    assert [tuple(r) for r in rows.select(s.valid_name(F.col("n")), s.name_error(F.col("n"))).collect()] == [("Ada", None), (None, "empty"), (None, "too long"), (None, "empty")]
    assert one(spark, s.greeting(F.lit(None).cast("string"))) == "Hello, world!"


def test_scalars(spark):
    assert one(spark, s.in_range(F.lit("70, 80"))) == [70, 80]
    assert one(spark, s.in_range(F.lit("70,301"))) is None and one(spark, s.in_range(F.lit("7x"))) is None
    options = lambda t: one(spark, s.options(F.lit(t)))
    assert options("%% draw-visual: --width '3 4' a\\ b \"c 'd\" e\ngraph") == ["--width", "3 4", "a b", "c 'd", "e"]
    assert options("graph\n%% draw-visual: x") == [] and options("' draw-visual: \"open" + "x" * 200) is None
    assert [one(spark, s.number_text(F.lit(x))) for x in (8.0, 0.5)] == ["8", "0.5"]
    assert [one(spark, s.short_count(F.lit(x))) for x in (999, 1499, 1500, 2500, 3500)] == ["999", "1k", "2k", "2k", "4k"]
    assert [one(spark, s.alarm(s.percent(F.lit(p), F.lit(1), F.lit(1)))) for p in (90.4, 90.6, 70.5, 71.0)] == ["yellow", "red", "green", "yellow"]
    assert [one(spark, s.duration_text(F.lit(x))) for x in (59, 61)] == ["59s", "1m01s"]
    assert one(spark, s.cost_text(F.lit(0.5))) == "$0.5000"
    assert [one(spark, s.seconds(F.lit(x).cast("string"))) for x in ("30s", "2m", "1h", None, "x")] == [30, 120, None, 180, None]
    assert one(spark, s.joined(F.lit("a"), F.lit(""), F.lit("b"))) == "a | b"
    token = one(spark, s.redacted(F.lit("x dop_v1_abc Bearer q.r")))
    assert token == "x [redacted] Bearer [redacted]" and one(spark, s.redacted(F.lit(token))) == token
    header = one(spark, s.redacted(F.lit("a\nAuthorization: abc def\nb")))
    assert header == "a\n[redacted]\nb" and one(spark, s.redacted(F.lit(header))) == header
    assert one(spark, s.without_keys(F.create_map(*map(F.lit, ("userData", "x", "k", "v"))))) == {"k": "v"}
    assert one(spark, s.user_data_ok(F.lit(b"ok"), F.lit("hetzner"))) is True
    assert one(spark, s.user_data_ok(F.lit(b"\xff"), F.lit("hetzner"))) is False
    assert one(spark, s.without_keys(F.create_map(F.lit("Token"), F.lit("x"), F.lit("a"), F.lit("b")))) == {"a": "b"}


@pytest.mark.parametrize(
    "action,status,expected",
    [("stop", "running", "Mutate"), ("stop", "off", "Noop"), ("start", "running", "Noop"), ("start", "off", "Mutate"), ("delete", "running", "Mutate"), ("delete", "off", "Mutate")]
    + [(a, x, "Conflict") for a in ("stop", "start", "delete") for x in ("transitioning", "unknown")],
)
def test_decide(spark, action, status, expected):
    assert one(spark, d.decide(F.lit(action), F.lit(status))) == expected


def test_decisions(spark):
    assert {k: one(spark, d.exit_code(F.lit(k))) for k in ("Usage", "Conflict", "LimitExceeded", "Auth", "IncompleteInventory", "NotFound", "Aborted", "WaitTimeout", "Internal")} == {"Usage": 2, "Conflict": 3, "LimitExceeded": 4, "Auth": 5, "IncompleteInventory": 5, "NotFound": 6, "Aborted": 7, "WaitTimeout": 9, "Internal": 1} and one(spark, d.exit_code(F.lit(None).cast("string"))) == 0
    assert [one(spark, d.response_class(F.lit(c))) for c in (200, 204, 302, 403, 404, 422, 429, 503, 418)] == [None, None, "ProviderRejected", "Auth", "NotFound", "ProviderRejected", "Transport", "Transport", "ProviderRejected"]
    retry = lambda attempt, elapsed: one(spark, d.retry_delay(F.lit(True), F.lit(attempt), F.lit(True), F.lit(elapsed), F.lit(None)))
    assert [retry(0, 0), retry(1, 87), retry(1, 88), retry(2, 0)] == [1.0, 3.0, None, None]
    assert one(spark, d.providers(F.lit(None).cast("string"), F.lit("all"))) == ["digitalocean", "hetzner"]
    assert one(spark, d.log_level(F.lit(None).cast("string"), F.lit(True))) == "Debug"
    once = d.settled(F.lit("transitioning"), F.lit("stopping"))
    assert one(spark, once) == "off" and one(spark, d.settled(once, F.lit("stopping"))) == "off"


TYPES = [("b", "b", 2, 4.0, 40.0, "x86", ["n", "f"]), ("a", "a", 2, 4.0, 40.0, "x86", ["n"]), ("arm", "arm", 2, 1.0, 40.0, "arm", ["n"]), ("big", "big", 4, 4.0, 200.0, "x86", ["n"]), ("far", "far", 1, 1.0, 10.0, "x86", ["f"])]


def test_smallest_fit_whatever_the_order(spark):
    image = spark.createDataFrame([("i", "i", "x86", None)], schema.IMAGE)
    for rows in (TYPES, TYPES[::-1]):
        types = spark.createDataFrame(rows, schema.VM_TYPE).repartition(3)
        pick = partial(choose.resolve_type, types, image, "n")
        assert [r.id for r in pick(1, 2.0, None, schema.DEFAULT_LIMITS).collect()] == ["a"]
        # the chosen type is refused, and no other takes its place
        assert pick(3, 2.0, None, schema.DEFAULT_LIMITS).count() == 0
        assert choose.named_or_known(types, "nope").first().asDict() == {"found": False, "known": ["a", "arm", "b", "big", "far"]}
    assert choose.first_violated({"vcpu": 9, "memory_gb": 99}, schema.DEFAULT_LIMITS) == "vcpu"


def test_sources_fail_apart(spark, tmp_path):
    good = lambda: spark.createDataFrame([("h", "1")], "provider string, id string")

    def bad():
        raise ValueError("no token")

    def materialize(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    rows, outcomes = choose.read_all({"h": good, "d": bad}, materialize)
    assert rows.count() == 1 and [(o["provider"], o["ok"]) for o in outcomes] == [("d", False), ("h", True)]


def test_sources_are_read_at_once(spark):
    """Each read waits for the other to begin; one that hangs is cancelled by its tag, and the other's rows stay."""
    import threading
    import time

    both = threading.Barrier(2, timeout=60)
    vms = lambda p: spark.range(4).select(F.lit(p).alias("provider"), F.col("id").cast("string").alias("id"), F.lit("n").alias("name"))

    def met(p):
        both.wait()
        return vms(p)

    rows, outcomes = choose.read_all({"h": lambda: met("h"), "d": lambda: met("d")})
    assert rows.count() == 8 and all(o["ok"] for o in outcomes)

    @F.udf("string")
    def slow(x):
        time.sleep(100)
        return x

    began = time.monotonic()
    rows, told = choose.listing({"h": lambda: vms("h"), "d": lambda: vms("d").withColumn("name", slow("name"))}, spark, seconds=12)
    assert [(r.position, r.id) for r in rows.orderBy("position").collect()] == [(1, "0"), (2, "1"), (3, "2"), (4, "3")] and time.monotonic() - began < 60
    told = told.first()
    assert (told.ok, told.exit_code, [(e.code, e.provider) for e in told.errors]) == (False, 5, [("transport", "d")])
    for _ in range(100):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_numbers_without_one_task(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbers_without_one_task(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def numbers_without_one_task(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("k"), F.array("id").alias("a"))
    found = choose.numbered(rows.repartition(7), ["k", "v"], "n")
    told = sorted((tuple(r) for r in found.select("n", "k", "v").collect()))
    expected = sorted(((r.k, r.v) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert told == [(n, *x) for n, x in enumerate(expected, 1)]
    hot = choose.numbered(spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("v")), ["k"], "n")
    assert sorted(r.n for r in hot.collect()) == list(range(1, 3001)) and hot.groupBy(F.spark_partition_id()).count().count() > 1
    assert choose.numbered(rows.limit(0), ["k"]).count() == 0
    outcome = spark.createDataFrame([(False, [("auth", "no", "d", None, None, None)])], f"ok boolean, errors {choose.ERROR}")
    lines = choose.envelope_lines(rows.select("k", "v"), ["v"], outcome).orderBy("line").collect()
    whole = json.loads("".join(r.text for r in lines))
    assert list(whole) == ["schemaVersion", "ok", "data", "errors"] and [x["v"] for x in whole["data"]] == list(range(3000)) and whole["errors"][0]["code"] == "auth"


def test_walks_over_stored_pages(spark):
    from stratamill.sources import stored

    pages = {("chain", str(i)): (str(i + 1) if i < 9 else None, 1.0) for i in range(10)}
    pages |= {("long", str(i)): (str(i + 1), 1.0) for i in range(120)} | {("exact", str(i)): (str(i + 1) if i < 99 else None, 0.0) for i in range(100)}
    pages |= {("loop", "a"): ("b", 0), ("loop", "b"): ("c", 0), ("loop", "c"): ("b", 0), ("self", "x"): ("x", 0), ("gap", "1"): ("2", 0), ("gap", "2"): ("nope", 0), ("slow", "1"): ("2", 100), ("slow", "2"): ("3", 100), ("slow", "3"): ("4", 1), ("other", "a"): (None, 0)}
    starts = {"chain": "0", "long": "0", "exact": "0", "loop": "a", "self": "x", "gap": "1", "slow": "1", "none": "1", "nothing": None}

    def plain(account, most=100, budget=180):
        at, seen, spent, reason = starts[account], [], 0, None
        while at is not None:
            reason = "cursor" if at in seen else "pages" if len(seen) >= most else "time" if spent > budget else "page" if (account, at) not in pages else None
            if reason:
                break
            seen.append(at)
            at, took = pages[account, at]
            spent += took
        return seen, reason

    df = spark.createDataFrame([(a, c, n, float(s_)) for (a, c), (n, s_) in pages.items()] + [("chain", "3", "4", 1.0)], "account string, cursor string, next string, seconds double")
    walk = stored.walked(df, spark.createDataFrame(list(starts.items()), "account string, cursor string")).collect()
    ends = {r.account: (r.pages_read, r.reason, r.error) for r in stored.ends(spark.createDataFrame(walk)).collect()}
    for account in starts:
        seen, reason = plain(account)
        assert [r.cursor for r in sorted(walk, key=lambda r: r.page) if r.account == account and not r.reason] == seen
        if starts[account] is not None:
            assert ends[account] == (len(seen), reason, reason and ("IncompleteInventory" if seen else "Transport"))
    assert {e[1] for e in ends.values()} == {None, "cursor", "pages", "time", "page"}


def test_walks_take_no_job_for_each_page(spark):
    """A walk in one row costs as many jobs as it does for walks of three pages, so no level shuffles all pages again."""
    from stratamill.sources import stored

    def jobs(most):
        pages = spark.range(3 * most).selectExpr("id % 3 AS account", "id div 3 AS cursor", f"IF(id div 3 < {most - 1}, id div 3 + 1, NULL) AS next")
        group = f"walks of {most}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert len(stored.walked(pages, pages.where("cursor = 0").select("account", "cursor")).collect()) == 3 * most
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert 0 < jobs(40) < jobs(3) + 10


@pytest.mark.parametrize("at_once", [0, 7, 10_000])
def test_walks_in_rows_and_in_the_recursive_plan(spark, at_once):
    """Both give what plain Python gives, with several starts of an account, repeated pages, and accounts of no pages."""
    import random

    from stratamill.sources import stored

    rng = random.Random(5)
    told = [(a, str(c), rng.choice([None, *map(str, range(30))]), rng.choice([None, 0.0, 0.5, 2.0])) for a in range(12) for c in rng.sample(range(30), rng.choice([1, 6, 29])) for _ in range(rng.choice([1, 1, 2]))] + [(None, "1", "2", 0.0)]
    asked = sorted({(a, str(rng.randrange(30))) for a in range(14) for _ in range(rng.randint(1, 3))}) + [(3, None), (None, "1")]
    pages = {}
    for a, c, n, took in told:
        page = (n is None, n or "", took is not None, took or 0.0)
        pages[a, c] = min(page, pages.get((a, c), page))
    expected = []
    for a, start in asked:
        at, seen, spent = start, [], 0.0
        while at is not None:
            reason = "cursor" if at in seen else "pages" if len(seen) >= 5 else "time" if spent > 2 else "page" if a is None or (a, at) not in pages else None
            expected.append((a, len(seen) + (reason is None), at, reason))
            if reason:
                break
            seen.append(at)
            last, following, _, took = pages[a, at]
            at, spent = None if last else following, spent + took
    walk = stored.walked(spark.createDataFrame(told, "account long, cursor string, next string, seconds double"), spark.createDataFrame(asked, "account long, cursor string"), 5, 2, at_once)
    assert walk.dtypes == [("account", "bigint"), ("page", "int"), ("cursor", "string"), ("reason", "string")]
    assert sorted(map(tuple, walk.collect()), key=repr) == sorted(expected, key=repr)
    assert {e[3] for e in expected} == {None, "cursor", "pages", "time", "page"}


SEEN = "wait_id string, at double, action_state string, status string, missing boolean, error string"
ASKED = "wait_id string, kind string, target string, timeout string, started double"


def waits(many=120):
    """Requests, observations, and the outcome of each by a plain fold."""
    import random

    rng = random.Random(3)
    asked = [(f"w{i}", rng.choice(["status", "absent", "created"]), rng.choice(["running", "off"]), rng.choice(["30s", "2m", "10m", None, "1s"]), float(rng.randint(0, 50))) for i in range(many)] + [("bad", "status", "off", "1h", 0.0), ("worse", "status", "off", "soon", 0.0), ("unseen", "absent", None, "30s", 5.0), ("busy", "status", "off", "30s", 0.0), ("crowd", "status", "off", "10m", 0.0)]
    seen = []
    for i in range(many):
        for _ in range(rng.randint(0, 14)):
            error = rng.choice([None] * 6 + ["Transport", "NotFound"] + ["Auth", "ProviderRejected"] * (rng.random() < 0.2))
            seen.append((f"w{i}", rng.randint(0, 400) / 4, None if error else rng.choice([None, "running", "success"] + ["error"] * (rng.random() < 0.1)), None if error else rng.choice(["running", "transitioning", "transitioning", "transitioning", "unknown", "off"]), error is None and rng.random() < 0.05, error))
    seen += [(w, k / per, None, "transitioning" if k < 850 else "off", False, None) for w, per in (("busy", 30), ("crowd", 2)) for k in range(900)] + [("nobody", 3.0, None, "off", False, None), ("bad", 1.0, None, "off", False, None)]
    seen += rng.sample(seen, len(seen) // 8)
    expected = {}
    for w, kind, target, timeout, started in asked:
        deadline = {"30s": 30, "2m": 120, "10m": 600, None: 180, "1s": 1}.get(timeout)
        if deadline is None:
            expected[w] = ("usage", "Usage", 0, None, None)
            continue
        times = {}
        for o in seen:
            if o[0] == w and started <= o[1] <= started + deadline:
                times.setdefault(o[1], []).append(o)
        outcome, error, polls, elapsed, status = "timeout", "WaitTimeout", 0, float(deadline), None
        for at in sorted(times)[: -(-deadline // 2) + 1]:
            _, _, action, now, missing, failed = min(times[at], key=lambda o: [(x is not None, x) for x in (o[5], o[2], o[3], o[4])])
            polls += 1
            gone = missing or failed == "NotFound"
            if failed in ("Auth", "ProviderRejected"):
                outcome, error, elapsed, status = "aborted", failed, at - started, None
                break
            if failed and failed != "NotFound":
                continue
            state = "failed" if action == "error" else ("settled" if gone else "pending") if kind == "absent" else ("pending" if kind == "created" else "failed") if gone else "settled" if (now == target if kind == "status" else now in ("running", "off")) else "pending"
            if state != "pending":
                outcome, error, elapsed, status = state, "ProviderRejected" if state == "failed" else None, at - started, None if failed else now
                break
            status = status if failed else now
        expected[w] = (outcome, error, polls, elapsed, status)
    return asked, seen, expected


def test_waits(spark):
    from stratamill.operators import waiting

    asked, seen, expected = waits()
    out = waiting.waited(spark.createDataFrame(asked, ASKED), spark.createDataFrame(seen, SEEN).repartition(5)).collect()
    assert {r.wait_id: (r.outcome, r.error, r.polls, r.elapsed_s, r.status) for r in out} == expected and len(out) == len(asked)
    assert {r.exit_code for r in out if r.outcome == "timeout"} == {9} and {r.outcome for r in out} == {"settled", "failed", "aborted", "timeout", "usage"}
    assert {r.wait_id: r.polls for r in out if r.wait_id in ('busy', 'crowd')} == {'busy': 16, 'crowd': 301}


def test_nested_records_are_redacted(spark):
    kind = "id int, token string, note string, user struct<name:string,user_data:string,Authorization:string,list:array<struct<token:string,v:string>>>, more map<string,array<string>>, only struct<token:string>, any variant"
    text = json.dumps({"a": [1.50, {"Token": "x", "b": "Bearer q", "n": 12345678901234567890.123, "deep": [["dop_v1_z9", None, True, {"userData": 1, "authorization": {"x": 1}}]]}], "s": "é\u2028"})
    rows = spark.range(1).select(F.expr(f"""named_struct('id', 7, 'token', 't', 'note', 'Bearer abc', 'user', named_struct('name', 'Authorization: z', 'user_data', 'u', 'Authorization', 'x', 'list', array(named_struct('token', 't', 'v', 'dop_v1_1'), null)),
      'more', map('Token', array('x'), 'k', array('Bearer y', null)), 'only', named_struct('token', 'x'), 'any', parse_json('{text}'))""".replace("\\", "\\\\")).alias("r"))
    out = rows.select(s.redacted_record(F.col("r"), rows.schema["r"].dataType).alias("r"))
    assert out.schema["r"].dataType.fieldNames() == ["id", "note", "user", "more", "only", "any"]
    told = json.loads(out.select(F.to_json("r", {"ignoreNullFields": "false"})).first()[0])
    assert told["note"] == "Bearer [redacted]" and told["user"] == {"name": "[redacted]", "list": [{"v": "[redacted]"}, None]} and told["more"] == {"k": ["Bearer [redacted]", None]} and told["only"] is None
    assert told["any"] == {"a": [1.5, {"b": "Bearer [redacted]", "deep": [["[redacted]", None, True, {}]], "n": 12345678901234567890.123}], "s": "é\u2028"}
    again = out.select(s.redacted_record(F.col("r"), out.schema["r"].dataType).alias("r"))
    assert again.select(F.to_json("r")).first() == out.select(F.to_json("r")).first() and kind


def test_pages_and_records(spark, tmp_path):
    server = {"id": 7, "name": "web", "status": "odd", "server_type": {"name": "cx", "memory": 4, "disk": 40}, "datacenter": {"location": {"name": "n"}}, "public_net": {"ipv4": {"ip": "1.2.3.4"}}, "labels": {"a": "b"}, "volumes": [5], "extra": 1}
    (tmp_path / "p1").write_text(json.dumps({"servers": [server], "next": "p2"}))
    (tmp_path / "p2").write_text(json.dumps({"servers": [server], "next": "p1"}))
    spark.dataSource.register(pages.PagedSource)
    rows = spark.read.format("paged_json").options(path=str(tmp_path), first="p1", items="servers", next="next", provider="hetzner").load().collect()
    assert [(r.reason, r.pages_read) for r in rows] == [(None, None), (None, None), ("cursor", 2)]
    vm = normalize.hetzner_vms(pages.strict_json(spark, str(tmp_path / "p1"), "servers", schema.HETZNER_SERVER)).first()
    assert (vm.id, vm.status, vm.raw_status, vm.memory_gb, vm.attached[0].id) == ("7", "unknown", "odd", 4.0, "5")
    droplet = [(1, "d", "active", "s", ("r",), ([("10.0.0.1", "private"), ("9.9.9.9", "public")], [("::1", "public")]), (3, None), None, ["t"], ["v"], 512.0, 10.0, 1)]
    vm = normalize.digitalocean_vms(spark.createDataFrame(droplet, schema.DO_DROPLET)).first()
    assert (vm.status, vm.memory_gb, vm.ipv4, vm.ipv6, vm.image, vm.tags) == ("running", 0.5, "9.9.9.9", "::1", "3", ["t"])
    (tmp_path / "bad").write_text('{"servers": [{"id": "seven"}]}')
    with pytest.raises(Exception):  # noqa: B017
        pages.strict_json(spark, str(tmp_path / "bad"), "servers", schema.HETZNER_SERVER).collect()


def test_settings(spark, tmp_path):
    (tmp_path / "c.toml").write_text("a = 2\n")
    found = pages.settings([str(tmp_path / "none"), str(tmp_path / "c.toml")], {"a": 1, "b": 3})
    assert found == {"a": {"value": 2, "source": "file"}, "b": {"value": 3, "source": "default"}}
    assert pages.merged({"b": 9}, found)["b"] == {"value": 9, "source": "flag"}
    with pytest.raises(ValueError):
        pages.settings([str(tmp_path / "c.toml")], {"b": 3})


def test_pages_of_both_providers(spark, tmp_path):
    item = lambda i: {"id": i}
    (tmp_path / "servers.page1.json").write_text(json.dumps({"servers": [item(1)], "meta": {"pagination": {"page": 1, "next_page": 2}}}))
    (tmp_path / "servers.page2.json").write_text(json.dumps({"servers": [item(2)], "meta": {"pagination": {"page": 2, "next_page": None}}}))
    (tmp_path / "droplets.page1.json").write_text(json.dumps({"droplets": [item(3)], "links": {"pages": {"next": "https://api.example/v2/droplets?per_page=200&page=2"}}}))
    (tmp_path / "droplets.page2.json").write_text(json.dumps({"droplets": [item(4)], "links": {}}))
    spark.dataSource.register(pages.PagedSource)
    read = lambda **o: [(r.item and json.loads(r.item)["id"], r.reason, r.pages_read) for r in spark.read.format("paged_json").options(path=str(tmp_path), **o).load().collect()]
    hetzner = {"first": "servers.page1.json", "items": "servers", "next": "meta.pagination.next_page", "file": "servers.page{}.json"}
    assert read(**hetzner) == [(1, None, None), (2, None, None)]
    assert read(**hetzner, max_pages="1") == [(1, None, None), (None, "pages", 1)]
    assert read(**hetzner, max_seconds="-1") == [(None, "time", 0)]
    assert read(first="droplets.page1.json", items="droplets", next="links.pages.next", cursor=r"[?&]page=(\d+)", file="droplets.page{}.json") == [(3, None, None), (4, None, None)]


def test_items_that_do_not_decode(spark):
    kind = "id bigint, name string, memory double, at struct<location:struct<name:string,rank:int>>, tags array<string>, labels map<string,string>"
    good = {"id": 1, "name": "a", "memory": 4, "at": {"location": {"name": "n", "rank": 2}}, "tags": ["x"], "labels": {"a": "b"}, "extra": [1]}
    items = {
        1: (good, None), 2: ({**good, "id": "seven"}, "$.id"), 3: ({**good, "at": {"location": {"name": "n", "rank": "two"}}}, "$.at.location.rank"), 4: ({**good, "memory": {"gb": 4}}, "$.memory"), 5: ({"name": "a"}, "$.id"),
        6: ({**good, "at": 5}, "$.at"), 7: ({**good, "tags": "x"}, "$.tags"), 8: ({"id": 3, "name": None, "at": None}, None), 9: ([1], "$"), 10: ({**good, "id": None}, "$.id"), 11: ({**good, "memory": "4", "id": "x"}, "$.id"),
    }
    rows = [(k, json.dumps(x), "keep") for k, (x, _) in items.items()] + [(20, '{"id": 1, "na', "keep"), (21, "", "keep"), (22, None, "keep"), (23, "7", "keep")]
    found = {r.k: r for r in pages.decoded(spark.createDataFrame(rows, "k int, item string, path string"), kind).collect()}
    assert {k: r.path for k, r in found.items()} == {k: p for k, (_, p) in items.items()} | {20: "$", 21: "$", 22: None, 23: "$"}
    assert all((r.error == "ProviderRejected") == (r.path is not None) for r in found.values())
    assert {k for k, r in found.items() if r.record is not None} == {1, 8} and found[1].record.at.location.rank == 2 and found[1].record.labels == {"a": "b"} and found[8].record.id == 3


def test_filters_and_ranges_of_pages(spark, tmp_path):
    """A region's filter keeps items back in the reader, another provider's reads nothing, and ranges are read apart."""
    for n in range(1, 8):
        droplets = [{"id": 10 * n + k, "name": "d", "status": "active", "region": {"slug": "abc"[(n + k) % 3]}} for k in range(10 if n < 7 else 4)] + ([{"id": "odd"}] if n == 2 else [])
        (tmp_path / f"droplets.page{n}.json").write_text(json.dumps({"droplets": droplets, "meta": {"total": 64}}))
    spark.dataSource.register(pages.FilteredPagedSource)
    options = {"path": str(tmp_path), "first": "droplets.page1.json", "items": "droplets", "next": "links.pages.next", "file": "droplets.page{}.json", "provider": "digitalocean", "total": "meta.total", "per_page": "10", "region": "region.slug"}
    read = lambda **more: spark.read.format("filtered_paged_json").options(**options | more).load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = read(pages_per_task="2")
        assert rows.rdd.getNumPartitions() == 4 and rows.count() == 65
        vms, short = pages.machines(rows, schema.DO_DROPLET, normalize.digitalocean_vms)
        assert sorted(int(r.id) for r in vms.collect()) == [10 * n + k for n in range(1, 8) for k in range(10 if n < 7 else 4)] and [tuple(r) for r in short.collect()] == [("digitalocean", "ProviderRejected", "$.id", None)]
        of_a = rows.where("region = 'a'")
        assert sorted(json.loads(r.item)["id"] for r in of_a.collect()) == sorted(10 * n + k for n in range(1, 8) for k in range(10 if n < 7 else 4) if (n + k) % 3 == 0)
        plan = of_a._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(region,a)" in plan or "region#" in plan and "Filter (region" not in plan.replace("isnotnull(region", "")
        # a file that can't be read shows what is not read at all
        (tmp_path / "droplets.page1.json").rename(tmp_path / "away")
        assert rows.where("provider = 'hetzner'").count() == 0
        with pytest.raises(Exception):  # noqa: B017
            rows.where("provider = 'digitalocean'").count()
        (tmp_path / "away").rename(tmp_path / "droplets.page1.json")
        ends = [(r.reason, r.pages_read) for r in read(max_pages="3", pages_per_task="2").where("reason is not null").collect()]
        assert ends == [("pages", 1)] and read(max_pages="3").where("item is not null").count() == 31
        (tmp_path / "droplets.page4.json").unlink()
        assert [(r.reason, r.pages_read) for r in read(pages_per_task="2").where("reason is not null").collect()] == [("page", 1)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_layers_of_settings(spark, tmp_path):
    from stratamill.sources import settings

    (tmp_path / "c.toml").write_text('defaultProvider = "hetzner"\n[limits]\nmaxVcpu = 4\n[providers.hetzner]\nregion = "fsn1"\nsshKeys = []\n')
    layer = settings.file_layer([str(tmp_path / "none"), str(tmp_path / "c.toml")])
    rows = settings.effective(spark, [("flag", {"providers.hetzner.region": "nbg1", "limits.maxVcpu": None}), layer, ("other", {"limits.maxVcpu": 2, "limits.maxDiskGb": 64})])
    found = {r.setting: (r.value, r.source) for r in settings.shown(rows).collect()}
    assert set(found) == set(settings.DEFAULTS)
    file = str(tmp_path / "c.toml")
    assert found["defaultProvider"] == ("hetzner", file) and found["limits.maxVcpu"] == ("4", file) and found["limits.maxDiskGb"] == ("64", "other") and found["limits.maxMemoryGb"] == ("8", "default")
    assert found["providers.hetzner.region"] == ("nbg1", "flag") and found["providers.hetzner.sshKeys"] == ("[]", file) and found["providers.digitalocean.tokenEnv"] == ("DIGITALOCEAN_TOKEN", "default") and found["providers.digitalocean.image"] == ("-", "default")
    assert sorted(map(tuple, settings.warnings(rows).collect())) == [("digitalocean", "no image is set"), ("digitalocean", "no region is set"), ("hetzner", "no image is set")]
    assert settings.file_layer([str(tmp_path / "none")]) is None
    for text, says in (("[reaper]\nttl = 1\n", "reaper.ttl; there is no expiry"), ("[limits]\nmaxVcpu = 0\n", "limits.maxVcpu"), ("[limits]\nmaxVcpu = inf\n", "limits.maxVcpu"), ("[providers.hetzner]\ntoken = 'x'\n", "providers.hetzner.token"), ("a = \n", "line 1")):
        (tmp_path / "bad.toml").write_text(text)
        with pytest.raises(settings.ConfigInvalid, match=says):
            settings.file_layer([], str(tmp_path / "bad.toml"))
    with pytest.raises(settings.ConfigInvalid, match="missing.toml"):
        settings.file_layer([], str(tmp_path / "missing.toml"))


def test_outcomes_and_requests(spark):
    outcome = lambda rows: choose.list_outcome(spark.createDataFrame(rows, "provider string, error string, reason string")).first()
    assert tuple(outcome([("h", None, None), ("d", None, None)])) == (True, [], 0)
    one_failed = outcome([("h", "NotFound", None), ("d", None, None)])
    # rows of d were read, so it is a partial inventory, whatever the error of h
    assert not one_failed.ok and [(e.code, e.provider) for e in one_failed.errors] == [("not-found", "h")] and one_failed.exit_code == 5
    assert outcome([("h", "NotFound", None)]).exit_code == 6 and outcome([("d", "Usage", None), ("h", "Auth", None)]).exit_code == 2
    assert outcome([("d", None, "cursor"), ("h", "Usage", None)]).exit_code == 5 and outcome([("d", None, "cursor")]).errors[0].message == "stopped by cursor"
    both = outcome([("h", "Auth", None), ("d", None, "pages")])
    assert [(e.code, e.provider) for e in both.errors] == [("incomplete-inventory", "d"), ("auth", "h")] and both.exit_code == 5
    schema_ = "command string, provider string, type string, vcpu double, memory double, disk double, timeout int, wait boolean, yes boolean, dry_run boolean"
    ask = lambda *r: choose.usage_errors(spark.createDataFrame([r], schema_)).first().usage
    assert ask("create", "hetzner", "t", None, None, None, 60, True, None, True) == []
    assert ask("list", "all", None, None, None, None, None, None, None, None) == []
    assert ask("show", "all", None, None, None, None, 700, None, True, True) == ["timeout requires wait", "timeout is over 10 minutes", "all providers are for list only", "yes is for stop and delete only", "dry-run is for changes only"]
    assert ask("create", None, "t", 1.5, None, -1.0, None, None, None, None) == ["type excludes vcpu and memory", "disk goes with vcpu and memory only", "vcpu is no positive whole number", "disk is not positive"]


def test_seeded_inventory(spark):
    rows = [("hetzner", "1", "n", "running"), ("hetzner", "2", "f", "off"), ("digitalocean", "3", "n", "running")]
    vms = spark.createDataFrame([(p, i, r, s_, s_) for p, i, r, s_ in rows], "provider string, id string, region string, status string, raw_status string")
    faults = lambda *f: spark.createDataFrame(list(f), "provider string, error string, reason string")
    read, outcomes = seeded.listed(vms, faults(("hetzner", "Auth", None)), "n")
    assert [r.id for r in read.collect()] == ["3"] and choose.list_outcome(outcomes).first().exit_code == 5
    read, outcomes = seeded.listed(vms, faults(("digitalocean", None, "pages")))
    assert read.count() == 3 and [e.code for e in choose.list_outcome(outcomes).first().errors] == ["incomplete-inventory"]
    moved = seeded.powered_on(seeded.shut_down(vms, "1"), "2")
    assert {r.id: r.status for r in moved.collect()} == {"1": "transitioning", "2": "transitioning", "3": "running"}
    states = lambda df: {r.id: r.status for r in df.collect()}
    assert states(seeded.settle(moved)) == states(seeded.settle(seeded.settle(moved))) == {"1": "off", "2": "running", "3": "running"}
    assert states(seeded.deleted(seeded.deleted(vms, "1"), "1")) == {"2": "off", "3": "running"}
    new = spark.createDataFrame([("hetzner", "9", "n", None, None)], vms.schema)
    assert states(seeded.settle(seeded.created(vms, new)))["9"] == "running"
    wanted = spark.createDataFrame([("hetzner", "1"), ("hetzner", "3")], "provider string, id string")
    assert {r.id: r.error for r in choose.found_or_error(vms, wanted).collect()} == {"1": None, "3": "NotFound"}


def test_details_and_receipts(spark):
    vm = spark.createDataFrame([("hetzner", "1", "a", "t", "r", "unknown", "odd", 8.0, 0.5, None, None, "i", None, {"b": "2", "a": "1"}, None, [("volume", "5", None)])], schema.VM)
    row = normalize.details(vm).first()
    assert (row.ram_gb, row.disk_gb, row.ipv4, row.created, row.labels, row.attached, row.raw_status) == ("8", "0.5", "-", "-", "a=1, b=2", "volume:5", "odd")
    raw = spark.createDataFrame([("1", "7", "running"), ("2", None, None), ("3", "8", "success")], "vm_id string, action_id string, status string")
    assert [r.status for r in normalize.receipts(raw, "hetzner").collect()] == ["accepted", "accepted", "completed"]
    told = json.loads(choose.envelope(None, [{"code": "auth", "message": "no token", "provider": "hetzner"}], spark).first().json)
    assert told == {"schemaVersion": 1, "ok": False, "data": None, "errors": [{"code": "auth", "message": "no token", "provider": "hetzner", "vmId": None, "actionId": None, "requestId": None}]}


def test_fences(spark):
    texts = {
        1: "# Lesson\r\n<!-- draw-visual: diagrams/boot.mmd -->\r\n```text\r\n┌─┐\r\n│A│\r\n└─┘\r\n```\r\n```sh\r\necho\r\n```\r\n",
        2: "  ~~~~ text\n```\nin\n~~~\n  ~~~~~\n## Two\n```text\n```\n```text\n\x1b[1mb\x1b[0m\n```",
        3: "```text\nunclosed", 4: "# none", 5: "```text\na\x07\n```",
    }
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    found = sorted((r.id, r.block, r.label, r.line, r.lines, r.error) for r in blocks.fenced(docs).collect())
    assert found == [
        (1, 1, "diagrams/boot.mmd", 4, ["┌─┐", "│A│", "└─┘"], None),
        (2, 1, "text", 2, ["```", "in", "~~~"], None), (2, 2, "Two", 10, ["b"], None),
        (3, None, None, None, None, "unclosed fence"), (4, None, None, None, None, "no block"), (5, None, None, None, None, "control character U+0007"),
    ]
    raw = {r.id: (r.lines, r.error) for r in blocks.fenced(spark.createDataFrame([(1, "a\nb\n"), (2, " \n")], "id int, text string"), raw=True).collect()}
    assert raw == {1: (["a", "b"], None), 2: (None, "empty input")}
    told = blocks.manifest(blocks.fenced(docs.where("id = 1")), [2, 20]).first()
    assert told.failed and [(m["content_width"], m["wrapped_lines"]) for m in json.loads(told.manifest)] == [(2, [4, 5, 6]), (20, [])]


def test_embeds(spark):
    marker = "<!-- draw-visual: {} -->\n"
    good = marker.format("a") + "```text\nx\n```\n" + marker.format("b") + "```\nold\n```\n" + marker.format("wide") + "```\n" + "w" * 111 + "\n```\n" + marker.format("none") + "```\n```"
    docs = spark.createDataFrame([(1, good), (2, marker.format("a") + "text"), (3, marker.format("a") + "```\nopen"), (4, "nothing")], "id int, text string")
    rendered = spark.createDataFrame([("a", ["x"]), ("b", ["new"]), ("wide", ["w" * 111])], "path string, lines array<string>")
    found = {(r.id, r.path): r.problem for r in blocks.embeds(docs, rendered).collect()}
    assert found == {(1, "a"): None, (1, "b"): "stale", (1, "wide"): "111 columns wide", (1, "none"): "not rendered", (2, None): "line 1: a marker without a fenced block", (3, None): "line 2: unclosed fence"}


def test_blocks(spark):
    docs = spark.createDataFrame([(1, "x\r\n```text\r\nab\tc\r\n```\r\n```sh\r\nls\r\n```"), (2, "```text\nopen"), (3, "none")], "id int, text string")
    found = {r.id: r for r in blocks.fenced(docs).collect()}
    assert (found[1].line, found[1].lines, found[1].error) == (3, ["ab\tc"], None)
    assert found[2].error == "unclosed fence" and found[3].error == "no block"
    m = {r.width: r for r in blocks.measured(blocks.fenced(docs.where("id = 1")), [8, 20]).collect()}
    assert (m[8].columns, m[8].wrapped_lines, m[8].overflow, m[20].overflow) == (9, [3], True, False)
    wraps = spark.createDataFrame([("12345", 5), ("123456", 5), ("界界X", 4), ("éabc", 3)], "t string, w int")
    assert [r[0] for r in wraps.select(blocks.wrap("t", "w")).collect()] == [["12345"], ["12345", "6"], ["界界", "X"], ["éab", "c"]]
